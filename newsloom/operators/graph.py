"""Connected components and closure of a class graph, by iterated joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.runtime import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``v, component`` for every end of an edge (``a, b``); the component is its smallest vertex.

    Each round a vertex takes the smallest label beside it, so does the vertex
    its label names, and labels are looked up once in themselves; rounds grow
    with the logarithm of the diameter.
    """
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = scratch.keep(both.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v")))
    total = labels.agg(_sum()).first()[0]
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(near, labels["v"] == near["a"]).select("v", "label", F.least("label", "low").alias("low"))
        hooked = scratch.keep(
            step.select("v", F.col("low").alias("label"))
            .unionByName(step.where("low < label").select(F.col("label").alias("v"), F.col("low").alias("label")))
            .groupBy("v")
            .agg(F.min("label").alias("label"))
        )
        up = hooked.select(F.col("v").alias("label"), F.col("label").alias("upper"))
        new = scratch.keep(hooked.join(up, "label", "left").select("v", F.coalesce("upper", "label").alias("label")))
        scratch.drop(labels, hooked)
        labels, before, total = new, total, new.agg(_sum()).first()[0]
        if total == before:  # labels only fall: an equal sum means that none has moved
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"labels still move after {max_rounds} rounds")


def _sum() -> Column:
    """Sum of all labels, exact at any number of rows."""
    return F.sum(F.col("label").cast("decimal(38,0)"))


def ancestors(edges: DataFrame, roots: DataFrame, scratch: Scratch, depth: int = 8) -> DataFrame:
    """``node, ancestor, depth``: everything above each root within ``depth`` steps, itself included.

    ``edges``: ``child, parent``; ``roots``: ``node``.  Cycles end because a pair is kept at its smallest depth only.
    """
    known = scratch.keep(roots.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).distinct())
    frontier = known
    for k in range(1, depth + 1):
        step = frontier.join(edges, frontier["ancestor"] == edges["child"]).select("node", F.col("parent").alias("ancestor")).distinct()
        frontier = scratch.keep(step.join(known, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        known = scratch.keep(known.unionByName(frontier))
    return known
