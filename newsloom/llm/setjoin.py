"""All similar pairs between set-valued records (problem 3).

Method: prefix-filtered join.

1. Tokens are ordered by rarity: counted, sorted by (count, token) over a range
   partitioning and numbered in that order, so a record's set becomes a sorted
   array of numbers, rarest first.
2. Two sets with Jaccard similarity of at least t share a token within their
   first ``n - ceil(t n) + 1`` ones; only these prefixes are indexed.
3. Candidates meet on (token, time slice).  A candidate pair is taken at its
   first common token only, so no pair needs to be made distinct afterwards;
   the length filter and the positional filter then discard what cannot reach
   the threshold.
4. The exact overlap of the whole sets decides.

Records with equal sets in one time slice are one node: a group of copies costs
one row in the join and is expanded in the result only.  A slice is as long as
the span, so partners stand in the same slice or in the next one.  Frequent
tokens come last in the order and rarely enter a prefix; a posting list that is
still long is split by adaptive skew handling of the sort-merge join.

Defined results: null elements are dropped, repeated ones count once; records
with fewer than ``min_size`` members, a null id or (with a span) a null time
have no partner; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.runtime import Scratch


def rarity_arrays(records: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, ts, tids``: the members of each set as numbers, rarest first."""
    members = records.select("id", "ts", F.explode("tokens").alias("token"))
    counts = members.groupBy("token").agg(F.count("*").alias("n"))
    # numbers must not change when a task is repeated: they are written before anything reads them
    numbered = scratch.keep(counts.orderBy("n", "token").select("token", F.monotonically_increasing_id().alias("tid")))
    return members.join(numbered, "token").groupBy("id", "ts").agg(F.sort_array(F.collect_list("tid")).alias("tids"))


def similar_pairs(
    records: DataFrame, scratch: Scratch, threshold: float = 0.5, span_micros: int | None = None, min_size: int = 1, other: DataFrame | None = None
) -> DataFrame:
    """``id_a, id_b, overlap, size_a, size_b`` of all pairs with Jaccard similarity >= ``threshold``.

    ``records``: ``id``, ``ts`` (microseconds), ``tokens`` (array).  Within one
    table ``id_a < id_b``; with ``other`` the pairs lead from ``records`` to ``other``.
    """
    two = other is not None

    def prepared(df: DataFrame, side: int) -> DataFrame:
        return (
            df.select("id", "ts", F.array_distinct(F.array_compact("tokens")).alias("tokens"))
            .where(F.col("id").isNotNull() & (F.size("tokens") >= min_size) & (F.col("ts").isNotNull() if span_micros else F.lit(True)))
            .select(F.struct(F.lit(side).alias("side"), "id").alias("id"), "ts", "tokens")
        )

    both = prepared(records, 0)
    if two:
        both = both.unionByName(prepared(other, 1))
    arrays = rarity_arrays(both, scratch)
    if span_micros:
        piece = F.floor(F.col("ts") / F.lit(span_micros))
    else:
        piece = F.floor(F.log(F.size("tids")) / F.lit(-math.log(threshold)) + 1e-9) if threshold < 1 else F.size("tids").cast("bigint")
    kept = scratch.keep(arrays.withColumn("slice", piece))
    nodes = scratch.keep(
        kept.groupBy("tids", "slice", F.col("id.side").alias("side"))
        .agg(F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    # a node's number is what stands in the file, so both sides and the members see the same one
    members = scratch.keep(
        kept.join(nodes.select("tids", "slice", "side", "node"), [kept["tids"] == nodes["tids"], kept["slice"] == nodes["slice"], kept["id.side"] == nodes["side"]])
        .select("node", F.col("id.id").alias("id"), "ts")
    )
    t = F.lit(threshold)
    n = F.size("tids")
    prefix = nodes.withColumn("n", n).select(
        "node", "side", "slice", "tids", "n", F.posexplode(F.slice("tids", 1, (n - F.ceil(t * n - 1e-9) + 1).cast("int"))).alias("pos", "tid")
    )
    left = prefix.select("tid", F.explode(F.array("slice", F.col("slice") + 1)).alias("meet"), *(F.col(c).alias(f"l_{c}") for c in ("node", "side", "slice", "tids", "n", "pos")))
    if two:  # a partner in the other table may stand in the slice before as well
        left = left.unionByName(left.where("meet = l_slice").withColumn("meet", F.col("l_slice") - 1)).where("l_side = 0")
    right = prefix.select("tid", F.col("slice").alias("meet"), *(F.col(c).alias(f"r_{c}") for c in ("node", "side", "tids", "n", "pos")))
    if two:
        right = right.where("r_side = 1")
    met = left.join(right, ["tid", "meet"])
    if not two:
        met = met.where("l_slice < meet or l_node < r_node")
    fits = (
        met.where((F.least("l_n", "r_n") >= t * F.greatest("l_n", "r_n") - 1e-9))
        # positional filter: overlap is at most this token and what follows it
        .where((F.lit(1) + F.least(F.col("l_n") - F.col("l_pos") - 1, F.col("r_n") - F.col("r_pos") - 1)) * (1 + t) >= t * (F.col("l_n") + F.col("r_n")) - 1e-9)
        # taken at the first common token only
        .where("not arrays_overlap(slice(l_tids, 1, l_pos), slice(r_tids, 1, r_pos))")
    )
    similar = fits.withColumn("overlap", F.size(F.array_intersect("l_tids", "r_tids"))).where(
        F.col("overlap") >= t * (F.col("l_n") + F.col("r_n") - F.col("overlap")) - 1e-9
    )
    links = similar.select(F.col("l_node").alias("node_a"), F.col("r_node").alias("node_b"), "overlap", F.col("l_n").alias("size_a"), F.col("r_n").alias("size_b"))
    if not two:  # copies within a node
        links = links.unionByName(nodes.where("copies > 1").select(F.col("node").alias("node_a"), F.col("node").alias("node_b"), n.alias("overlap"), n.alias("size_a"), n.alias("size_b")))
    a = members.select(F.col("node").alias("node_a"), F.col("id").alias("a"), F.col("ts").alias("ts_a"))
    b = members.select(F.col("node").alias("node_b"), F.col("id").alias("b"), F.col("ts").alias("ts_b"))
    pairs = links.join(a, "node_a").join(b, "node_b")
    if span_micros:
        pairs = pairs.where(F.abs(F.col("ts_a") - F.col("ts_b")) <= span_micros)
    if two:
        return pairs.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "overlap", "size_a", "size_b")
    swap = F.col("a") > F.col("b")
    return pairs.where("node_a <> node_b or a < b").select(
        F.least("a", "b").alias("id_a"),
        F.greatest("a", "b").alias("id_b"),
        "overlap",
        F.when(swap, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"),
        F.when(swap, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"),
    )
