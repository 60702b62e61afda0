"""References to records that do not exist (problem 6).

Method: fixpoint cascade.  The references of a foreign-key graph are resolved
against their parent tables; what finds no parent is a *direct* orphan.  Records
that hold a direct orphan taint their own children: the graph is walked down by
semi-joins until a round taints no further record, giving the *inherited* ones.

Resolving a reference table that is far larger than its parent is done in two
steps, so that the references themselves need not be shuffled by a skewed key:

1. the references are pre-aggregated to one row per referenced key (with the
   earliest time of reference) and outer-joined with the parent; this leaves
   the *suspects*: keys without a parent, or younger than a reference;
2. the references are joined with the suspects.  The suspects are counted
   first; up to ``limit`` they are broadcast, beyond it they are joined by
   shuffle, where adaptive execution splits skewed keys.

Defined results: a null reference is no reference; a null or missing reference
time gives day ``unknown`` and can only be ``absent``; repeated rows count once;
an empty reference table gives no rows; an empty parent makes all references
``absent``; a parent whose time is null exists and is never ``later``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.runtime import BROADCAST_ROWS, Scratch, maybe_broadcast

#: Columns of the reference tables handed to this operator.
REFERENCE_COLUMNS = ("ref_key", "parent_key", "ref_time")


@dataclass(frozen=True)
class Reference:
    """One edge of the foreign-key graph.

    ``rows`` has ``ref_key`` (the referring record), ``parent_key`` and
    ``ref_time`` (null where the reference has no time).  ``child`` and
    ``parent`` name tables; ``field`` is the name reported.
    """

    field: str
    child: str
    parent: str
    rows: DataFrame


def suspects(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Referenced keys that no parent has, or whose parent begins after a reference.

    ``parents``: ``parent_key``, ``born`` (null where unknown), one row per key.
    """
    wanted = refs.groupBy("parent_key").agg(F.min("ref_time").alias("first_ref"))
    return (
        wanted.join(parents.withColumn("known", F.lit(True)), "parent_key", "left")
        .where(F.col("known").isNull() | (F.col("born") > F.col("first_ref")))
        .select("parent_key", F.col("known").isNull().alias("absent"), "born")
    )


def direct_orphans(
    edges: list[Reference], parents: DataFrame, scratch: Scratch, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Orphan references of edges that share one parent table.

    Gives ``ref_field, child, ref_key, parent_key, orphan_kind, ref_day``, distinct.
    """
    tagged = None
    for e in edges:
        one = e.rows.where("parent_key is not null").select(
            F.lit(e.field).alias("ref_field"), F.lit(e.child).alias("child"), *REFERENCE_COLUMNS
        )
        tagged = one if tagged is None else tagged.unionByName(one)
    bad = scratch.keep(suspects(tagged, parents))
    n = bad.count()
    hit = tagged.join(maybe_broadcast(bad, n, limit), "parent_key")
    return (
        hit.where(F.col("absent") | (F.col("born") > F.col("ref_time")))
        .select(
            "ref_field",
            "child",
            "ref_key",
            "parent_key",
            F.when(F.col("absent"), "absent").otherwise("later").alias("orphan_kind"),
            F.coalesce(F.date_format("ref_time", "yyyy-MM-dd"), F.lit("unknown")).alias("ref_day"),
        )
        .distinct()
    )


def cascade(edges: list[Reference], parents: dict[str, DataFrame], scratch: Scratch, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Orphans of a whole foreign-key graph, direct and inherited.

    Gives ``child, ref_field, ref_key, parent_key, orphan_kind, ref_day, depth``:
    depth 0 for the direct orphans, one row a reference; an inherited orphan has
    the kind ``inherited``, no ``parent_key``, and the depth at which the taint
    reached it.  ``parents[t]`` has ``parent_key, born`` for each table that edges
    refer to.  A record is tainted if one of its references is ``absent``; its
    children are inherited orphans of depth 1, theirs of depth 2, and so on.  A
    record reached along several paths is reported once per field and day, at its
    smallest depth.  Rounds go on until one taints no further record: each taints
    records that weren't, so they end, in cycles too.
    """
    by_parent: dict[str, list[Reference]] = {}
    for e in edges:
        by_parent.setdefault(e.parent, []).append(e)
    direct = None
    for parent, group in by_parent.items():
        one = direct_orphans(group, parents[parent], scratch, limit)
        direct = one if direct is None else direct.unionByName(one)
    direct = scratch.keep(direct)
    tainted = scratch.keep(direct.where("orphan_kind = 'absent'").select(F.col("child").alias("parent"), F.col("ref_key").alias("parent_key")).distinct())
    tables = lambda df: {r["parent"] for r in df.select("parent").distinct().collect()}  # noqa: E731 - names of tables
    seen, found, depth, live = tainted, None, 0, tables(tainted)
    while live:
        depth += 1
        step = None
        for e in edges:
            if e.parent not in live:
                continue
            one = (
                e.rows.where("parent_key is not null")
                .join(tainted.where(F.col("parent") == e.parent).select("parent_key"), "parent_key", "left_semi")
                .select(
                    F.lit(e.child).alias("child"), F.lit(e.field).alias("ref_field"), "ref_key", F.lit(depth).alias("depth"),
                    F.coalesce(F.date_format("ref_time", "yyyy-MM-dd"), F.lit("unknown")).alias("ref_day"),
                )
            )
            step = one if step is None else step.unionByName(one)
        if step is None:  # no table refers to a tainted one
            break
        step = scratch.keep(step.distinct())
        found = step if found is None else found.unionByName(step)
        fresh = scratch.keep(
            step.select(F.col("child").alias("parent"), F.col("ref_key").alias("parent_key")).where("parent_key is not null").distinct().join(seen, ["parent", "parent_key"], "left_anti")
        )
        live = tables(fresh)
        # one table of all tainted records: the plan doesn't grow with the rounds
        seen = scratch.keep(seen.unionByName(fresh))
        tainted = fresh
    out = direct.withColumn("depth", F.lit(0))
    if found is not None:
        least = found.groupBy("child", "ref_field", "ref_key", "ref_day").agg(F.min("depth").alias("depth"))
        out = out.unionByName(least.withColumns({"orphan_kind": F.lit("inherited"), "parent_key": F.lit(None).cast("bigint")}))
    return out
