"""Operators for corpora and entity data: text forms, linking, joins, runs, groups, tokens, packing, abuse."""
