"""Hand-computed micro-fixtures and the properties the project's rules define."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epochwise.functions import dsp, stats
from epochwise.operators import compare, drift, evaluate, events, folds, prep, profile, signal
from epochwise.sources import annotations


def scored(spark, rows):
    return spark.createDataFrame([("m", s, y, float(p)) for s, y, p in rows], "model string, subject string, y int, p double")


def test_ties_get_half_credit(spark):
    df = scored(spark, [("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1)])
    assert evaluate.roc_auc(df, ["model"]).first().auc == pytest.approx(0.875)
    # thresholds 0.9, 0.5, 0.1: the tie is one threshold
    assert evaluate.pr_auc(df, ["model"]).first().pr_auc == pytest.approx(0.5 * 1.0 + 0.5 * 2 / 3)


def test_one_class_group_is_null(spark):
    df = scored(spark, [("a", 1, 0.5), ("a", 1, 0.7), ("b", 0, 0.2), ("b", 1, 0.3)])
    got = {r.subject: r.auc for r in evaluate.roc_auc(df, ["subject"]).collect()}
    assert got == {"a": None, "b": 1.0}
    assert evaluate.per_subject(df, ["model"]).filter("subject = 'a'").first().auc is None


def test_score_one_is_outside_the_last_bin(spark):
    df = scored(spark, [("a", 1, 1.0), ("a", 0, 0.25)])
    assert evaluate.ece(df, ["model"]).first().ece == pytest.approx(0.125)
    assert evaluate.ece(df, ["model"], include_right=True).first().ece == pytest.approx(0.125)
    assert evaluate.reliability(df, ["model"]).count() == 1
    assert evaluate.reliability(df, ["model"], include_right=True).count() == 2


def test_interval_on_an_edge(spark):
    epochs = spark.createDataFrame([("s", "r", i) for i in range(5)], "subject string, recording string, epoch long")
    ivl = spark.createDataFrame([("s", "r", 8, 16)], "subject string, recording string, start_s long, end_s long")
    index = prep.label_by_index(epochs, ivl, 8).filter("y = 1").select("epoch").collect()
    overlap = prep.label_by_overlap(epochs, ivl, 8).filter("y = 1").select("epoch").collect()
    assert sorted(r.epoch for r in index) == [1, 2]
    assert sorted(r.epoch for r in overlap) == [1]


def test_exact_multiple_loses_an_epoch(spark):
    df = spark.createDataFrame([("s", i, 0.0) for i in range(24)], "subject string, idx long, value double")
    assert prep.full_epochs(df, ["subject"], 8).count() == 3
    assert prep.full_epochs(df, ["subject"], 8, lose_last=True).count() == 2


def test_clock_over_midnight(spark):
    text = (
        "Registration start time: 22.00.00\nRegistration end time: 07.00.00\n"
        "Start time: 23:59:00\nEnd time: 00:01:30\nStart time: 21.00.00\nEnd time: 22.30.00\nStart time: 25.00.00\nEnd time: 01.00.00\n"
    )
    got = annotations.clock_offsets(spark.createDataFrame([("f", text)], "path string, text string")).collect()
    assert sorted((r.start_s, r.end_s) for r in got) == [(7140, 7290), (82800, 88200)]


def test_open_starts_are_dropped(spark):
    text = (
        "Seizure Start Time: 1 seconds\nFile Name: a.edf\nSeizure 1 Start Time: 10 seconds\nSeizure 2 Start Time: 20 seconds\n"
        "Seizure 2 End Time: 30 seconds\nSeizure 3 End Time: 31 seconds\nFile Name: b.edf\nSeizure Start Time: 5 seconds\n"
    )
    got = annotations.parse_intervals(spark.createDataFrame([("f", text)], "path string, text string")).collect()
    assert [(r.recording, r.start_s, r.end_s) for r in got] == [("a.edf", 20, 30)]


def test_constant_channel(spark):
    df = spark.createDataFrame([("s", "r", c, i, float(i % 3) if c == "live" else 2.0) for c in ("live", "dead") for i in range(8)], "subject string, recording string, channel string, idx long, value double")
    assert {r.channel for r in prep.drop_dead_channels(df).select("channel").distinct().collect()} == {"live"}
    row = signal.time_features(df.filter("channel = 'dead'"), ["channel"]).first()
    assert row.mobility == pytest.approx(1.0) and row.complexity == pytest.approx(1.0)


def test_sine_is_alpha(spark):
    x = np.sin(2 * np.pi * 10 * np.arange(2048) / 256)
    segs = spark.createDataFrame([("s", "r", 0, "c", x.tolist())], "subject string, recording string, epoch long, channel string, x array<double>")
    psd = signal.welch_psd(segs, 256.0, 512, 2048)
    assert signal.dominant_band(signal.band_power(psd, ["channel"])).first().dominant_band == "alpha"
    assert signal.dominant_band(signal.band_power_trapz(psd, ["channel"])).first().dominant_band == "alpha"
    feats = signal.epoch_features(segs, 256.0, 512).first()
    assert feats.alpha_mean > 0.95 and feats.alpha_std == 0.0
    assert feats.rms_mean == pytest.approx(math.log(math.sqrt(0.5)), abs=1e-9)


def test_welch_matches_direct_sum():
    rng = np.random.RandomState(0)
    x = rng.randn(2, 40)
    got = dsp.welch_matrix(x, 10.0, 16)
    win = dsp.hann(16)
    want = np.zeros((2, 9))
    for r in range(2):
        for s in (0, 8, 16, 24):
            seg = (x[r, s : s + 16] - x[r, s : s + 16].mean()) * win
            for k in range(9):
                f = abs(sum(seg[j] * np.exp(-2j * np.pi * j * k / 16) for j in range(16))) ** 2
                want[r, k] += f * (1 if k in (0, 8) else 2) / (10.0 * (win**2).sum()) / 4
    assert np.allclose(got, want)


def test_filter_blocks_do_not_matter(spark):
    rng = np.random.RandomState(1)
    v = rng.randn(100)
    df = spark.createDataFrame([("r", i, float(a)) for i, a in enumerate(v)], "rec string, idx long, value double")
    taps = dsp.bandpass_taps(4, 2.0, 20.0, 60.0)
    for block in (16, 4096):
        got = [r.value for r in signal.fir(df, ["rec"], taps, block).orderBy("idx").collect()]
        assert np.allclose(got, np.convolve(v, taps, mode="same"))


def test_psi_of_equal_windows(spark):
    rng = np.random.RandomState(2)
    rows = [("f", float(v), w) for v in rng.randn(200) for w in ("ref", "cur")]
    df = spark.createDataFrame(rows, "feature string, value double, win string")
    assert drift.psi(df).first().psi == pytest.approx(0.0, abs=1e-12)


def test_psi_with_an_empty_bin(spark):
    rows = [("f", float(i), "ref") for i in range(100)] + [("f", 1e6, "cur")] * 10
    got = drift.psi(spark.createDataFrame(rows, "feature string, value double, win string")).first().psi
    ref, cur = np.arange(100.0), np.full(10, 1e6)
    edges = np.percentile(ref, np.linspace(0, 100, 11))
    edges[0], edges[-1] = -np.inf, np.inf
    r = np.histogram(ref, edges)[0] / 100 + 1e-6
    c = np.histogram(cur, edges)[0] / 10 + 1e-6
    assert got == pytest.approx(float(((c - r) * np.log(c / r)).sum()))


def test_zero_differences(spark):
    df = spark.createDataFrame([("m", "a", 0.0), ("m", "b", 0.0)], "model string, subject string, d double")
    row = compare.wilcoxon(df, ["model"]).first()
    assert row.n == 0 and row.w is None and row.p is None


def test_signed_rank_exact(spark):
    d = [1.0, 2.0, 3.0, -4.0, 5.0, 6.0]
    df = spark.createDataFrame([("m", str(i), v / 10) for i, v in enumerate(d)], "model string, subject string, d double")
    row = compare.wilcoxon(df, ["model"]).first()
    # subsets of 1..6 with sum <= 4: {}, 1, 2, 3, 4, 1+2, 1+3
    assert row.w == 4.0 and row.p == pytest.approx(2 * 7 / 64)


def test_tails():
    assert stats.t_quantile_975(23) == pytest.approx(2.06866, abs=1e-5)
    assert stats.f_upper(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert stats.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_auc_is_unchanged_by_a_monotone_transform(spark):
    rng = np.random.RandomState(5)
    df = scored(spark, [("a", int(v > 0.6), p) for v, p in zip(rng.rand(300), rng.rand(300).round(2))])
    moved = df.withColumn("p", F.exp(3.0 * F.col("p")) / 25.0)
    assert evaluate.roc_auc(df, ["model"]).first().auc == pytest.approx(evaluate.roc_auc(moved, ["model"]).first().auc)


def test_pooled_is_the_sum_of_subjects(hub):
    both = evaluate.confusion_two_grains(hub.scored).toPandas()
    counts = ["tp", "tn", "fp", "fn"]
    pooled = both[both.pooled == 1].set_index(["model", "protocol"])[counts].sort_index()
    summed = both[both.pooled == 0].groupby(["model", "protocol"])[counts].sum().sort_index()
    pd.testing.assert_frame_equal(pooled, summed)
    assert (pooled.sum(axis=1) == hub.scored_wide.count()).all()


def test_changing_a_held_out_subject_leaves_its_training_statistics(hub):
    cols = ["f01", "f02"]
    changed = hub.emb.withColumns({c: F.when(F.col("subject") == "s3", F.col(c) * 100 + 7).otherwise(F.col(c)) for c in cols})
    for make in (folds.held_out_moments, folds.held_out_ranges):
        a = make(hub.emb, "subject", cols).filter("subject = 's3'").first()
        b = make(changed, "subject", cols).filter("subject = 's3'").first()
        assert a.a == pytest.approx(b.a, abs=1e-9) and a.b == pytest.approx(b.b, abs=1e-9)


def test_islands_cross_block_borders(spark):
    epochs = [0, 1, 2, 3, 4, 5, 9, 11, 12, 15, 16]
    df = spark.createDataFrame([("s", "r", e, int(e in epochs)) for e in range(20)], "subject string, recording string, epoch long, pred int")
    for block in (2, 4, 4096):
        got = sorted((r.first_epoch, r.last_epoch) for r in events.islands(df, block=block).collect())
        assert got == [(0, 5), (9, 9), (11, 12), (15, 16)]


def test_oversampling_balances(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(20)], "id long, y int")
    counts = {r.y: r["count"] for r in events.oversample(df, "id").groupBy("y").count().collect()}
    assert counts == {0: 17, 1: 17}


def test_histogram_top_edge(spark):
    df = spark.createDataFrame([("f", 0, float(v)) for v in range(5)], "feature string, y int, value double")
    got = {r.bin: r.n for r in profile.histogram(df, 4).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2}


# Tp, tn, fp, fn and area of the 24 published folds.
FOLDS = """
s01 1 48 0 5 0.9513888889
s02 8 88 0 3 1.0000000000
s03 24 447 1 32 0.9809271365
s04 4 414 2 48 0.9372457470
s05 61 575 25 14 0.9585888889
s06 13 132 100 16 0.6204667063
s07 32 331 5 10 0.9819302721
s08 21 960 0 99 0.8412065972
s09 35 308 4 4 0.9683596318
s10 38 479 9 23 0.9567152647
s11 51 821 11 53 0.9486351239
s12 17 1689 103 207 0.6496557119
s13 7 556 76 72 0.5334481654
s14 0 240 0 30 0.6245833333
s15 0 2160 0 270 0.4887122771
s16 1 164 4 20 0.7209467120
s17 2 311 1 37 0.8912721893
s18 12 376 0 35 0.8806303757
s19 21 272 0 13 0.9510164360
s20 1 360 0 44 0.6865123457
s21 5 224 0 23 0.9682716837
s22 18 231 1 11 0.9847651605
s23 14 480 0 46 0.9335937500
s24 49 631 1 30 0.8536692838
"""


def test_published_folds(spark):
    rows = [(p[0], *map(int, p[1:5]), float(p[5])) for p in (line.split() for line in FOLDS.split("\n")) if p]
    df = spark.createDataFrame(rows, "subject string, tp long, tn long, fp long, fn long, auc double")
    pooled = evaluate.with_metrics(df.agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])).first()
    assert (pooled.tp, pooled.tn, pooled.fp, pooled.fn) == (435, 12297, 343, 1145)
    want = {"accuracy": 0.8954, "ppv": 0.5591, "sensitivity": 0.2753, "specificity": 0.9729, "mcc": 0.3430, "kappa": 0.3190}
    for name, v in want.items():
        assert round(pooled[name], 4) == v
    per = evaluate.with_metrics(df).withColumn("m", F.lit("rf"))
    long = evaluate.long_metrics(per, ["accuracy", "sensitivity", "auc"], ["m"])
    spread = {r.metric: r for r in compare.spread(long, ["metric"]).collect()}
    assert round(spread["auc"]["mean"], 4) == 0.8464
    assert round(spread["sensitivity"]["mean"], 4) == 0.3508
    t = compare.t_test(long.filter("metric = 'accuracy'"), ["metric"]).first()
    assert round(t.t, 2) == 23.16
    worst = [r.subject for r in evaluate.worst_subjects(per, 4, ["m"]).orderBy("rank").collect()]
    assert worst[:2] == ["s14", "s15"]


# The two published pooled confusions (TN, FP, FN, TP) and their figures.
@pytest.mark.parametrize(
    "counts, want",
    [
        ((12555, 85, 793, 787), {"accuracy": 0.9383, "sensitivity": 0.4981, "specificity": 0.9933, "mcc": 0.6437}),
        ((12305, 335, 1145, 435), {"accuracy": 0.8959, "sensitivity": 0.2753, "specificity": 0.9735, "mcc": 0.3455}),
    ],
)
def test_published_confusions(spark, counts, want):
    tn, fp, fn, tp = counts
    row = evaluate.with_metrics(spark.createDataFrame([(tp, tn, fp, fn)], "tp long, tn long, fp long, fn long")).first()
    for name, v in want.items():
        assert round(row[name], 4) == v
