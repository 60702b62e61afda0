"""Numbering rows, and looking at the row before, without bringing a table or a key's rows to one task.

Rows are range-partitioned by key and order, so a key that holds a third of all
rows spreads over as many tasks as its rows need.  What crosses the border of
two partitions is carried by a table with one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.runtime import Scratch


def global_row_number(df: DataFrame, order: list[Column | str], name: str, scratch: Scratch, start: int = 0) -> DataFrame:
    """``df`` with consecutive numbers in the given total order.

    The rows are range-partitioned and sorted; a row's number is its place in
    its partition plus the size of the partitions before.  The driver holds one
    number a partition.  The order must be total, or equal rows are numbered arbitrarily.
    """
    placed = scratch.keep(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offset, pairs = start, []
    for p in sorted(sizes):
        pairs += [F.lit(p), F.lit(offset)]
        offset += sizes[p]
    base = F.element_at(F.create_map(*pairs), part) if pairs else F.lit(0)
    return placed.withColumn(name, (base + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")).drop("__id")


def grouped_row_number(df: DataFrame, groups: list[str], order: list[Column | str], name: str, scratch: Scratch) -> DataFrame:
    """``df`` with numbers from 1 in the given total order within each group, groups of any size."""
    numbered = scratch.keep(global_row_number(df, [*groups, *order], "__at", scratch))
    first = numbered.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]).agg(F.min("__at").alias("__first"))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return numbered.join(first, same).select(*df.columns, (F.col("__at") - F.col("__first") + 1).alias(name))


class Ordered:
    """Rows ordered by (keys, order), cut into ranges of rows whatever the keys.

    ``before`` looks at the row before of the same keys, ``running`` sums up to
    a row.  ``rows`` holds the columns of the input and ``__p``, the range.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], scratch: Scratch):
        self.keys, self.order, self.scratch = keys, order, scratch
        ranged = df.repartitionByRange(*keys, *order)
        self.rows = scratch.keep(ranged.withColumn("__p", F.spark_partition_id()))  # written: the ranges are drawn once

    def _edge(self, rows: DataFrame, value: Column, name: str, total: bool) -> DataFrame:
        """``keys, __p, name``: what ranges before hold for the keys with which a range begins; one row a (range, key) that spans ranges."""
        per = rows.groupBy(*self.keys, "__p").agg(value.alias(name))
        # a key lies in several ranges only at their borders: all other rows go
        many = per.groupBy(*self.keys).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
        w = Window.partitionBy(*self.keys).orderBy("__p")
        prior = F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, -1)) if total else F.lag(name).over(w)
        return per.join(F.broadcast(many), self.keys, "left_semi").select(*self.keys, "__p", prior.alias(name))

    def before(self, columns: list[str], prefix: str = "prev_") -> Ordered:
        """Adds ``prefix + column``: the value in the row before of the same keys, null in a key's first row."""
        w = Window.partitionBy(*self.keys, "__p").orderBy(*self.order)
        here = self.rows
        last = F.max_by(F.struct(*columns), F.struct(*self.order))
        edge = self._edge(here, last, "__edge", False)
        joined = here.withColumn("__lag", F.lag(F.struct(*columns)).over(w)).join(edge, [*self.keys, "__p"], "left")
        value = F.coalesce("__lag", "__edge")
        self.rows = joined.withColumns({f"{prefix}{c}": value[c] for c in columns}).drop("__lag", "__edge")
        return self

    def running(self, column: str, name: str) -> Ordered:
        """Adds ``name``: the sum of ``column`` over a key's rows up to this one."""
        w = Window.partitionBy(*self.keys, "__p").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        here = self.scratch.keep(self.rows)
        edge = self._edge(here, F.sum(column), "__sum", True)
        self.rows = here.join(edge, [*self.keys, "__p"], "left").withColumn(name, F.sum(column).over(w) + F.coalesce("__sum", F.lit(0))).drop("__sum")
        return self
