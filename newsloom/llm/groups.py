"""Consolidating pairwise matches into groups (problem 5).

Method: peel the giant component, then label what is left.

* Links are kept bipartite (record - match key), so that a key shared by a
  million records costs a million rows, never a million squared pairs.
* **Peel.** From the record of highest degree, frontier breadth-first joins mark
  all that it reaches.  A random graph's giant component is covered in a few
  rounds.  After ``peel_rounds`` rounds the marked part is contracted to one
  record (its smallest id) and all links inside it are anti-joined away, so
  that a component of long diameter is not walked link by link: its rest goes
  on in the second stage, still tied to the contracted record.
* **Minimum propagation.** Every record takes the smallest label among the
  records that share a key with it; the label's own record takes it too, and
  labels are then looked up once in themselves.  That shortcut makes the number
  of rounds logarithmic in the length of a chain.

Each round's result is written to the shared folder, so lineage stays short.

Defined results: a record without any link is its own group; a null key links
nothing; a null record is left out; repeated links count once; an empty table
gives no rows.  The group id is the smallest record of the group.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.runtime import Scratch


def peel(links: DataFrame, scratch: Scratch, rounds: int) -> DataFrame:
    """Records reached from the record of highest degree within ``rounds`` frontier joins (column ``a``)."""
    top = links.groupBy("a").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a").limit(1).select("a")
    seen = scratch.keep(top)
    frontier = seen
    for _ in range(rounds):
        keys = links.join(frontier, "a", "left_semi").select("k").distinct()
        fresh = scratch.keep(links.join(keys, "k", "left_semi").select("a").distinct().join(seen, "a", "left_anti"))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)  # as many tables as rounds, at most
        frontier = fresh
    return seen


def label_sum(labels: DataFrame) -> Decimal | None:
    """Sum of all labels, exact at any number of rows."""
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]


def propagate(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``a, label``: smallest record linked to each record, by minimum propagation with shortcuts."""
    labels = scratch.keep(links.select("a").distinct().withColumn("label", F.col("a")))
    total = label_sum(labels)
    for _ in range(max_rounds):
        at_key = links.join(labels, "a").groupBy("k").agg(F.min("label").alias("low"))
        near = links.join(at_key, "k").groupBy("a").agg(F.min("low").alias("low"))
        step = labels.join(near, "a").select("a", "label", "low")
        # the record whose id a label is learns of the smaller label as well
        hooked = (
            step.select("a", F.col("low").alias("label"))
            .unionByName(step.where("low < label").select(F.col("label").alias("a"), F.col("low").alias("label")))
            .groupBy("a")
            .agg(F.min("label").alias("label"))
        )
        hooked = scratch.keep(hooked)
        up = hooked.select(F.col("a").alias("label"), F.col("label").alias("upper"))
        new = scratch.keep(
            hooked.join(up, "label", "left").select("a", F.coalesce("upper", "label").alias("label"))
        )
        scratch.drop(labels, hooked)
        labels, before, total = new, total, label_sum(new)
        if total == before:  # labels only fall: an equal sum means that none has moved
            break
    else:
        raise RuntimeError(f"labels still move after {max_rounds} rounds")
    return labels


def consolidate(matches: DataFrame, record: str, key: str, scratch: Scratch, peel_rounds: int = 6) -> DataFrame:
    """``record, group_id`` for every non-null record of ``matches``."""
    rows = matches.select(F.col(record).cast("bigint").alias("a"), F.col(key).alias("k")).where("a is not null").distinct()
    records = rows.select("a").distinct()
    shared = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    links = scratch.keep(rows.join(shared, "k", "left_semi"))
    reached = peel(links, scratch, peel_rounds)
    giant = reached.agg(F.min("a").alias("root"))
    members = scratch.keep(reached.select("a", giant.scalar().alias("root")))
    # links of the peeled part: its keys that also lead outside keep one contracted record, all others go
    outside = links.join(members.select("a"), "a", "left_anti")
    bridge = (
        links.join(members, "a").select("k", F.col("root").alias("a")).distinct().join(outside.select("k").distinct(), "k", "left_semi")
    )
    rest = scratch.keep(outside.unionByName(bridge.select("a", "k")))
    labels = propagate(rest, scratch)
    joined = members.join(labels, members["root"] == labels["a"], "left").select(members["a"], F.coalesce("label", "root").alias("label"))
    inside = labels.join(members.select("a"), "a", "left_anti").unionByName(joined)
    return records.join(inside, "a", "left").select(F.col("a").alias(record), F.coalesce("label", "a").alias("group_id"))
