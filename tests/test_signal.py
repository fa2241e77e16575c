"""The path from samples to features: absent and dead channels, and the filter at full length."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epochwise.functions import dsp
from epochwise.functions.constants import FEATURES
from epochwise.operators import signal

RATE, N = 64.0, 128


def long_rows(spark, channels):
    """(subject, recording, channel, idx, value) of a name -> values map."""
    parts = [
        pd.DataFrame({"subject": "s", "recording": "r", "channel": c, "idx": np.arange(len(v)), "value": v})
        for c, v in channels.items()
    ]
    return spark.createDataFrame(pd.concat(parts))


@pytest.fixture(scope="module")
def waves():
    t = np.arange(4 * N) / RATE
    rng = np.random.RandomState(2)
    return {c: np.sin(2 * np.pi * f * t) + 0.1 * rng.randn(len(t)) for c, f in (("a", 3.0), ("b", 11.0))}


def test_absent_channel_leaves_the_others_whole(spark, waves):
    wide = spark.createDataFrame(pd.DataFrame({"subject": "s", "recording": "r", "idx": np.arange(4 * N), **waves}))
    wide = wide.withColumn("c", F.lit(None).cast("double"))
    with_absent = signal.epoch_features(signal.segments(wide, ["a", "b", "c"], N), RATE, N)
    without = signal.epoch_features(signal.segments(wide, ["a", "b"], N), RATE, N)
    got, want = (d.orderBy("epoch").toPandas()[FEATURES].to_numpy() for d in (with_absent, without))
    assert np.isfinite(got).all() and np.allclose(got, want)


def test_dead_and_partly_absent_channels_do_not_count(spark, waves):
    none = spark.createDataFrame([], "subject string, recording string, start_s long, end_s long")
    taps = dsp.bandpass_taps(20, 0.5, 25.0, RATE)
    part = waves["b"].copy()
    part[N : 2 * N] = np.nan  # absent from the second epoch
    noisy = long_rows(spark, {**waves, "dead": np.full(4 * N, 7.0), "part": part}).filter(~F.isnan("value"))
    got = signal.raw_to_features(noisy, none, taps, N, RATE, N).orderBy("epoch").toPandas()
    assert len(got) == 4 and np.isfinite(got[FEATURES].to_numpy()).all()
    want = signal.raw_to_features(long_rows(spark, waves), none, taps, N, RATE, N).orderBy("epoch").toPandas()
    assert np.allclose(got[FEATURES].iloc[1], want[FEATURES].iloc[1])  # only a and b have that epoch


def test_long_filter_equals_direct_sum(spark):
    """0.5-40 Hz at 256 Hz needs more than a thousand taps."""
    rate, half = 256.0, 600
    taps = np.array(dsp.bandpass_taps(half, 0.5, 40.0, rate))
    rng = np.random.RandomState(1)
    x = rng.randn(9000)
    got = signal.fir(long_rows(spark, {"a": x}), ["subject", "recording", "channel"], list(taps), block=2048)
    got = got.orderBy("idx").toPandas()
    padded = np.concatenate([np.zeros(half), x, np.zeros(half)])
    want = np.array([padded[i : i + 2 * half + 1] @ taps for i in range(len(x))])
    assert got.idx.tolist() == list(range(9000)) and np.allclose(got.value, want, atol=1e-9)


def test_filter_takes_gaps_as_zero(spark):
    rows = long_rows(spark, {"a": np.ones(10)}).filter("idx <> 4")
    got = signal.fir(rows, ["subject", "recording", "channel"], [1.0, 1.0, 1.0], block=4).orderBy("idx").collect()
    assert [(r.idx, r.value) for r in got] == [(0, 2.0), (1, 3.0), (2, 3.0), (3, 2.0), (5, 2.0), (6, 3.0), (7, 3.0), (8, 3.0), (9, 2.0)]


def test_cwt_gives_long_rows_back_in_strips():
    """A batch of many segments doesn't become one batch that is as many times larger as there are scales."""
    import numpy as np
    import pyarrow as pa

    from epochwise.functions import dsp

    x = np.random.RandomState(3).randn(1000, 64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1000)), dsp.matrix_to_lists(x)], names=["id", "_x"])
    out = list(dsp.cwt_batches([1, 2, 4])(iter([batch])))
    assert max(b.num_rows for b in out) == 256 and sum(b.num_rows for b in out) == 1000
    got = np.concatenate([dsp.lists_to_matrix(b.column(1)) for b in out])
    want = np.concatenate([dsp.cwt_matrix(x, k) for k in dsp.morlet_kernels([1, 2, 4]).values()], axis=1)
    assert np.allclose(got, want, atol=1e-12)
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(1000))
