"""The filter and detection queries frame every channel, each 16 as a recording of its own."""

import numpy as np
import pandas as pd

from voltloom.operators import spikes as K
from voltloom.plans.catalog import QUERIES
import voltloom.plans.more  # noqa: F401


def test_all_channels_are_framed(spark, tmp_path):
    rng = np.random.default_rng(3)
    chans = [0, 1, 5, 15, 16, 20, 31, 40, 47]
    rows = [(c, k, float(rng.normal(20, 60))) for c in chans for k in range(70)]
    df = pd.DataFrame(rows, columns=["user_id", "k", "value"])
    df["event_id"] = np.arange(len(df))
    df["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(df["k"], unit="s")
    df["event_type"] = "click"
    df.drop(columns="k").to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    got = {(r.rec, r.block): r.rms for r in QUERIES["highpass_rms"](spark, str(tmp_path)).collect() if r.block == 0}
    want = {}
    for g in range(3):
        data = np.stack([df.value[df.user_id == c].to_numpy() - 20 for c in chans if c // 16 == g])
        want[(f"events-{g}", 0)] = np.sqrt((K.preprocess(data, 20_000.0, K.Settings())[:, :] ** 2).mean())
    assert set(got) == set(want)
    assert all(np.isclose(got[k], want[k]) for k in want)
    found = QUERIES["detect_spikes"](spark, str(tmp_path)).collect()
    assert {r.rec for r in found} == {"events-0", "events-1", "events-2"}
    assert {r.chan for r in found} <= set(chans) and all(r.rec == f"events-{r.chan // 16}" for r in found)
