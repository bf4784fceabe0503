"""Streaming forms: frames compared with the one before, and counts by window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Rows and columns of the tile whose positions share one state.
TILE = 64


def excess_over_previous(px: DataFrame) -> DataFrame:
    """``(f, y, x, v, d)`` of a stream of samples: the excess over the last frame seen there.

    A state holds the last samples of a tile of 64 by 64 positions (-1: none
    yet), so it has a bounded size and a batch is one call a tile.  Frames must
    come in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = np.frombuffer(state.get[0], np.int32).copy() if state.exists else np.full(TILE * TILE, -1, np.int32)
        rows = pd.concat(list(batches)).sort_values(["y", "x", "f"], ignore_index=True)
        at = (rows["y"] % TILE * TILE + rows["x"] % TILE).to_numpy()
        v = rows["v"].to_numpy()
        first = np.append(True, at[1:] != at[:-1])
        before = np.where(first, last[at], np.append(-1, v[:-1]))
        d = pd.array(np.maximum(v - before, 0), dtype="Int32")
        d[before < 0] = pd.NA
        final = np.append(first[1:], True)
        last[at[final]] = v[final]
        state.update((last.tobytes(),))
        yield rows.assign(d=d)[["f", "y", "x", "v", "d"]]

    tiled = px.withColumn("ty", F.expr(f"y div {TILE}")).withColumn("tx", F.expr(f"x div {TILE}"))
    return tiled.groupBy("ty", "tx").applyInPandasWithState(
        step, "f bigint, y int, x int, v int, d int", "v binary", "append", GroupStateTimeout.NoTimeout
    )


def counts_by_window(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Observations by channel and window of event time; late rows are dropped by the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "ch").agg(F.count("*").alias("n"))
