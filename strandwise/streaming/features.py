"""Features of a signal that arrives as a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def energy(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(event_type, start, n, energy) of tumbling windows; events later than late are left out."""
    v = F.round(F.col("value") * 100)
    rows = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.avg(v * v).alias("energy")).select("event_type", F.col("w.start").alias("start"), "n", "energy")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, stop, n): runs of events with gaps below gap."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def segments(windows: DataFrame, least: int, most: int) -> DataFrame:
    """(series, offset, length) of segments as they close, from a stream of (series, win, n, edge): a segment ends at the
    first edge at least least samples from its start, or after most. State for each series: start and end so far."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end = state.get if state.exists else (0, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values("win").itertuples():
            if end > start and ((row.edge and end - start >= least) or end - start >= most):
                out.append((key[0], start, end - start))
                start = end
            end += int(row.n)
        state.update((start, end))
        yield pd.DataFrame(out, columns=["series", "offset", "length"])

    return windows.groupBy("series").applyInPandasWithState(run, "series long, offset long, length long", "start long, stop long", "append", GroupStateTimeout.NoTimeout)
