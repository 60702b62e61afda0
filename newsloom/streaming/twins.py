"""Streaming counterparts of the batch operators that depend on order.

``session_counts`` groups a stream into sessions by event time and drops what
arrives after the watermark.  ``running_history`` keeps each user's history as
state: events wait until the watermark has passed them, are applied in the order
of (time, impression), and every applied event gives the history before it.  The
state of a user is their history, as long as it is, and what waits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY_OUT = "user_id bigint, impression_id bigint, event_time timestamp, history array<bigint>, clicks array<bigint>"
HISTORY_STATE = "history array<bigint>, waiting array<struct<t:bigint,impression_id:bigint,current:bigint,clicks:array<bigint>>>"


def session_counts(stream: DataFrame, key: str, time: str, gap: str = "72 hours", late: str = "1 hour") -> DataFrame:
    """``key, session_start, session_end, n``: sessions that end after ``gap`` without an event."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.session_window(time, gap).alias("w"), key)
        .agg(F.count("*").alias("n"))
        .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
    )


def apply_event(history: list[int], current: int | None, clicks: list[int]) -> list[int]:
    """Reads ``current`` unless it is the last element; returns the history before the clicks."""
    if current is not None and (not history or history[-1] != current):
        history.append(current)
    before = list(history)
    history.extend(clicks)
    return before


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    history, waiting = (list(x) if x is not None else [] for x in state.get) if state.exists else ([], [])
    waiting = [tuple(w) for w in waiting]
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            current = None if pd.isna(r.current) else int(r.current)
            waiting.append((int(pd.Timestamp(r.event_time).value // 1_000_000), int(r.impression_id), current, [int(x) for x in (r.clicks if r.clicks is not None else [])]))
    mark = state.getCurrentWatermarkMs()
    waiting.sort(key=lambda w: (w[0], w[1]))
    due = bisect_right(waiting, mark, key=lambda w: w[0])
    out = []
    for t, impression, current, clicks in waiting[:due]:
        before = apply_event(history, current, list(clicks))
        out.append((int(key[0]), impression, pd.Timestamp(t, unit="ms"), before, list(clicks)))
    waiting = waiting[due:]
    state.update((history, waiting))
    if waiting:
        state.setTimeoutTimestamp(max(waiting[0][0] + 1, mark + 1))
    if out:
        yield pd.DataFrame(out, columns=["user_id", "impression_id", "event_time", "history", "clicks"])


def running_history(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Histories of a stream ``user_id, impression_id, event_time, current, clicks`` (nulls already left out)."""
    return (
        stream.withWatermark("event_time", late)
        .groupBy("user_id")
        .applyInPandasWithState(_advance, HISTORY_OUT, HISTORY_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
