"""Structured Streaming over event streams: sessions, windowed rates, peak detection with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rates(events: DataFrame, t: str = "ts", by: str = "event_type", late: str = "10 minutes", size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Event counts in sliding windows; later rows than the watermark are dropped."""
    return events.withWatermark(t, late).groupBy(F.window(t, size, slide), by).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, t: str = "ts", by: str = "user_id", late: str = "10 minutes", gap: str = "15 minutes") -> DataFrame:
    """Session windows per key."""
    return events.withWatermark(t, late).groupBy(F.session_window(t, gap), by).agg(F.count(F.lit(1)).alias("n"))


def lockout_peaks(samples: DataFrame, threshold: float, lockout: int) -> DataFrame:
    """Threshold crossings per channel of a stream ``(chan, ti, v)``, none within ``lockout`` samples of the last.

    The state of a channel is the end of its lockout and the last sample, so
    micro-batches of any size give the same peaks when samples come in order.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        locked, last = state.get if state.exists else (-1, 0.0)
        out = []
        pdf = pd.concat(list(batches)).sort_values("ti")
        for ti, v in zip(pdf["ti"].tolist(), pdf["v"].tolist(), strict=True):
            if abs(v) >= threshold > abs(last) and ti > locked:
                out.append((key[0], ti, v))
                locked = ti + lockout
            last = v
        state.update((int(locked), float(last)))
        yield pd.DataFrame(out, columns=["chan", "ti", "v"]).astype({"chan": np.int64, "ti": np.int64, "v": float})

    return samples.groupBy("chan").applyInPandasWithState(step, "chan long, ti long, v double", "locked long, last double", "append", GroupStateTimeout.NoTimeout)
