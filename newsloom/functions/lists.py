"""Array expressions: parallel lists, stable dedup, order checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(c: Column | str) -> Column:
    """List length, 0 for null."""
    return F.coalesce(F.size(c), F.lit(0)).cast("bigint")


def stable_unique(c: Column | str) -> Column:
    """First occurrences in order; nulls dropped; null list gives an empty one."""
    return F.array_distinct(F.array_compact(F.coalesce(c if isinstance(c, Column) else F.col(c), F.array())))


def stable_unique_keeping_null(c: Column | str) -> Column:
    """First occurrences in order, one null kept; null list gives an empty one."""
    return F.array_distinct(F.coalesce(c if isinstance(c, Column) else F.col(c), F.array()))


def adjacent(c: Column, test) -> Column:
    """How many neighbouring pairs (a, b) of a list satisfy ``test``."""
    n = F.size(c)
    pairs = F.zip_with(F.slice(c, 1, F.greatest(n - 1, F.lit(0))), F.slice(c, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.coalesce(test(a, b), F.lit(False)))
    return F.coalesce(F.size(F.filter(pairs, lambda x: x)), F.lit(0)).cast("bigint")


def labels(candidates: Column, targets: Column) -> Column:
    """1 for each candidate that is a target, else 0."""
    return F.transform(candidates, lambda x: F.array_contains(targets, x).cast("int"))


def text_of(c: Column) -> Column:
    """A list of numbers as text, for comparison and export."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
