"""Structured Streaming counterparts of the order-sensitive operators."""
