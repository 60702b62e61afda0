"""Runs of consecutive equal events (problem 4).

Method: boundary interval lookup.  Within a chunk of the sequences the positions
at which a run begins are gathered into a sorted array; each event is assigned
to its run by binary search in that array, and runs are aggregated.

Layout: the events are cut into ranges of (seq, entity, ts, key) of about equal
*number*, so an entity with a third of all events spreads over as many chunks as
its events need, whatever their times.  A task walks its chunk in Arrow batches,
with only the run in progress carried from one batch to the next.  The first and
the last run of a chunk may go on in the neighbouring ones: these, at most two a
chunk, are merged afterwards.

Input columns: ``seq, entity, ts`` (microseconds, bigint), ``key`` (bigint,
order among equal times) and ``item`` (bigint), none of them null.

Defined results: an event repeated with equal (seq, entity, ts, key) counts
once; equal times are ordered by key; an empty table gives no rows; extra
columns are ignored.  Runs are maximal whatever the chunking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.runtime import Scratch

COLUMNS = ("seq", "entity", "ts", "key", "item")
PARTIAL = (
    "seq string, entity bigint, chunk bigint, item bigint, first_key bigint, last_key bigint, "
    "first_ts bigint, last_ts bigint, n_events bigint, at_start boolean, at_end boolean"
)


def _runs_of(batches: Iterator[pa.RecordBatch], max_gap: int, min_events: int) -> Iterator[pa.RecordBatch]:
    """Runs of a sorted chunk.  The last run of a batch waits for the next batch."""
    schema = pa.schema(
        [("seq", pa.string()), *((c, pa.int64()) for c in ("entity", "chunk", "item", "first_key", "last_key", "first_ts", "last_ts", "n_events")), ("at_start", pa.bool_()), ("at_end", pa.bool_())]
    )
    number = TaskContext.get().partitionId()
    held: list[np.ndarray] | None = None  # the run in progress: its columns with one row
    first = True  # no run of the chunk has been given out

    def emit(rows: list[np.ndarray], end: bool) -> pa.RecordBatch:
        nonlocal first
        seq, entity, item, k0, k1, t0, t1, n = rows
        at_start, at_end = np.zeros(len(n), bool), np.zeros(len(n), bool)
        if len(n):
            at_start[0], at_end[-1] = first, end
            first = False
        keep = (n >= min_events) | at_start | at_end
        numbers = np.full(int(keep.sum()), number, dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(seq[keep].astype(object), pa.string()), pa.array(entity[keep]), pa.array(numbers), *(pa.array(x[keep]) for x in (item, k0, k1, t0, t1, n)), pa.array(at_start[keep]), pa.array(at_end[keep])],
            schema=schema,
        )

    for b in batches:
        if b.num_rows == 0:
            continue
        seq = b.column(0).to_numpy(zero_copy_only=False)
        entity, ts, key, item = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
        if held is not None:  # its last event stands for the run that goes on
            seq, entity, item = np.concatenate((held[0], seq)), np.concatenate((held[1], entity)), np.concatenate((held[2], item))
            ts, key = np.concatenate((held[6], ts)), np.concatenate((held[4], key))
        same = np.concatenate(([False], (entity[1:] == entity[:-1]) & (seq[1:] == seq[:-1])))
        repeated = np.concatenate(([False], (ts[1:] == ts[:-1]) & (key[1:] == key[:-1]))) & same
        if repeated.any():
            fresh = ~repeated
            seq, entity, ts, key, item, same = (x[fresh] for x in (seq, entity, ts, key, item, same))
        joined = np.concatenate(([False], (item[1:] == item[:-1]) & (ts[1:] - ts[:-1] <= max_gap))) & same
        starts = np.flatnonzero(~joined)  # sorted array of the positions at which a run begins
        run = np.searchsorted(starts, np.arange(len(ts)), side="right") - 1  # each event's run, by binary search
        n = np.bincount(run, minlength=len(starts)).astype(np.int64)
        last = starts + n - 1
        k0, t0 = key[starts], ts[starts]
        if held is not None:  # the first run goes on with what was held
            n[0] += held[7][0] - 1
            k0[0], t0[0] = held[3][0], held[5][0]
        rows = [seq[starts], entity[starts], item[starts], k0, key[last], t0, ts[last], n]
        held = [x[-1:] for x in rows]
        yield emit([x[:-1] for x in rows], False)
    if held is not None:
        yield emit(held, True)


def collapse_runs(events: DataFrame, scratch: Scratch, max_gap_secs: int = 1800, min_events: int = 2, chunks: int | None = None) -> DataFrame:
    """Maximal runs of equal ``item`` whose neighbours are at most ``max_gap_secs`` apart.

    Gives ``seq, entity, item, first_key, last_key, n_events, span_secs`` for
    runs of at least ``min_events`` events.  ``chunks``: how many ranges the
    events are cut into; by default Spark decides.
    """
    gap = max_gap_secs * 1_000_000
    rows = events.select(*COLUMNS)
    order = ("seq", "entity", "ts", "key")
    ranged = rows.repartitionByRange(chunks, *order) if chunks else rows.repartitionByRange(*order)
    # written: the ranges are drawn once, and both ways below read the same runs
    partial = scratch.keep(ranged.sortWithinPartitions(*COLUMNS).mapInArrow(lambda it: _runs_of(it, gap, min_events), PARTIAL))
    edge = F.col("at_start") | F.col("at_end")
    along = Window.partitionBy("seq", "entity").orderBy("chunk", "first_ts", "first_key")  # at most two rows a chunk
    before = {c: F.lag(c).over(along) for c in ("item", "last_ts", "chunk", "at_end")}
    continues = F.coalesce(
        F.col("at_start") & before["at_end"] & (before["chunk"] < F.col("chunk")) & (before["item"] == F.col("item")) & (F.col("first_ts") - before["last_ts"] <= gap),
        F.lit(False),
    )
    stitched = (
        partial.where(edge)
        .withColumn("head", (~continues).cast("bigint"))
        .withColumn("run", F.sum("head").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("seq", "entity", "run", "item")
        .agg(
            F.min_by("first_key", F.struct("first_ts", "first_key")).alias("first_key"),
            F.max_by("last_key", F.struct("last_ts", "last_key")).alias("last_key"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            F.sum("n_events").alias("n_events"),
        )
    )
    names = ("seq", "entity", "item", "first_key", "last_key", "first_ts", "last_ts", "n_events")
    return (
        partial.where(~edge)
        .select(*names)
        .unionByName(stitched.select(*names))
        .where(F.col("n_events") >= min_events)
        .select("seq", "entity", "item", "first_key", "last_key", "n_events", F.expr("(last_ts - first_ts) div 1000000").alias("span_secs"))
    )
