"""Merging intervals as they arrive, with late data bounded by a watermark.

``sessions`` is the built-in form for events that each last a fixed gap. ``merged_stream`` merges
intervals of any length: a key's state holds its islands that something could still touch, an
island is emitted once the watermark has passed its end, and rows that begin before the watermark
are late and dropped by it. State is bounded by what overlaps the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, ts: str, key: str, gap: str, delay: str) -> DataFrame:
    """key, lo, hi, n: events closer than ``gap`` in one session."""
    window = F.session_window(ts, gap)
    grouped = events.withWatermark(ts, delay).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.unix_micros("w.start").alias("lo"), F.unix_micros("w.end").alias("hi"), "n")


def absorbed(open_islands: list[tuple[int, int]], rows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Islands after more intervals, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted([*open_islands, *rows]):
        if lo >= hi:
            continue
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def merged_stream(intervals: DataFrame, delay: str) -> DataFrame:
    """key, lo, hi of a stream's islands; intervals: key (long), ts (timestamp of lo), lo, hi."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        rows = [] if state.hasTimedOut else [r for b in batches for r in zip(b["lo"].astype(int), b["hi"].astype(int))]
        islands = absorbed(held, rows)
        mark = state.getCurrentWatermarkMs() * 1000
        closed = [i for i in islands if i[1] < mark]
        left = [i for i in islands if i[1] >= mark]
        if left:
            state.update(([int(a) for a, _ in left], [int(b) for _, b in left]))
            state.setTimeoutTimestamp(max(min(b for _, b in left) // 1000 + 1, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], a, b) for a, b in closed], columns=["key", "lo", "hi"]).astype("int64")

    rows = intervals.withWatermark("ts", delay).select("key", "ts", "lo", "hi")
    return rows.groupBy("key").applyInPandasWithState(fold, "key long, lo long, hi long", "los array<long>, his array<long>", "append", GroupStateTimeout.EventTimeTimeout)
