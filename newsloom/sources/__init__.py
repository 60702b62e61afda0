"""Readers and writers."""

from newsloom.sources.tables import load

__all__ = ["load"]
