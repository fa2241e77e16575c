"""Wide quantiles, bins and the resampled means against numpy, and that rows aren't multiplied."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epochwise.operators import binning, compare, drift, profile
from epochwise.functions.exprs import stack_columns

COLS = ["smooth", "ties", "flat", "gaps"]


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.RandomState(1)
    n = 3000
    gaps = rng.randn(n)
    gaps[::3] = np.nan
    return pd.DataFrame(
        {
            "smooth": rng.randn(n) ** 3, "ties": rng.randint(0, 7, n).astype(float), "flat": np.full(n, 2.5), "gaps": gaps,
            "y": rng.randint(0, 2, n), "win": np.where(rng.rand(n) < 0.3, "ref", "cur"),
        }
    )


@pytest.fixture(scope="module")
def rows(spark, pdf):
    made = spark.createDataFrame(pdf)
    # a missing value is a null in one half of the rows and NaN in the other
    null = F.isnan("gaps") & (F.rand(1) < 0.5)
    return made.withColumn("gaps", F.when(~null, F.col("gaps"))).repartition(5).cache()


@pytest.mark.parametrize("accuracy", [100, 20_000])
def test_quantiles_are_exact(rows, pdf, accuracy):
    qs = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    got = {(r.feature, r.q): (r.x, r.n) for r in binning.column_quantiles(rows, COLS, qs, accuracy).collect()}
    for c in COLS:
        x = pdf[c].dropna()
        for q in qs:
            assert got[c, q] == pytest.approx((np.quantile(x, q), len(x)), rel=1e-12)


@pytest.mark.parametrize("of", [None, "ref"])
def test_quantile_bins(rows, pdf, of):
    got = {(r.feature, r.bin, r.cls): r.n for r in binning.quantile_bins(rows, COLS, "win", 10, of, 200).collect()}
    want = {}
    for c in COLS:
        x = pdf.dropna(subset=[c])
        edges = np.quantile(x[c] if of is None else x[c][x.win == of], [i / 10 for i in range(1, 10)])
        for b, w in zip(np.searchsorted(edges, x[c], side="right"), x.win):
            want[c, b, w] = want.get((c, b, w), 0) + 1
    assert got == want


def test_width_bins(rows, pdf):
    got = {(r.feature, r.bin, r.cls): r.n for r in binning.width_bins(rows, COLS, "y", 8).collect()}
    want = {}
    for c in COLS:
        x = pdf.dropna(subset=[c])
        low, width = x[c].min(), (x[c].max() - x[c].min()) / 8
        for v, y in zip(x[c], x.y):
            b = min(int((v - low) // width), 7) if width else 0
            want[c, b, str(y)] = want.get((c, b, str(y)), 0) + 1
    assert got == want


def test_equal_to_the_long_forms(rows):
    whole = rows.select("smooth", "ties", "y", "win")
    cols, long = COLS[:2], whole.select("y", "win", stack_columns(COLS[:2]))
    as_map = lambda d, *k: {tuple(r[c] for c in k): r for r in d.collect()}
    for new, old, keys, values in (
        (profile.column_mutual_info(whole, cols), profile.mutual_info_binned(whole, cols), ["feature"], ["mutual_info_binned"]),
        (drift.column_psi(whole, cols), drift.psi(long), ["feature"], ["psi"]),
        (profile.column_histogram(whole, cols, 6), profile.histogram(long, 6), ["feature", "y", "bin"], ["n", "density"]),
    ):
        a, b = as_map(new, *keys), as_map(old, *keys)
        assert set(a) == set(b)
        for k in a:
            assert [a[k][v] for v in values] == pytest.approx([b[k][v] for v in values], rel=1e-9)


def test_rows_are_not_multiplied(rows):
    for df in (binning.quantile_bins(rows, COLS, "win"), binning.width_bins(rows, COLS, "y", 8)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Expand" not in plan


def test_no_values(spark):
    empty = spark.createDataFrame([], "a double, y int")
    assert binning.quantile_bins(empty, ["a"], "y").collect() == []
    assert binning.width_bins(empty, ["a"], "y", 4).collect() == []
    nulls = spark.createDataFrame([(None, 1), (float("nan"), 0)], "a double, y int")
    assert binning.quantile_bins(nulls, ["a"], "y").collect() == []
    one = spark.createDataFrame([(5.0, 1)], "a double, y int")
    assert [tuple(r) for r in binning.quantile_bins(one, ["a"], "y").collect()] == [("a", 9, "1", 1)]


def plain_bootstrap(values, resamples, seed):
    n, means = len(values), []
    for b in range(resamples):
        drawn = [int(hashlib.md5(f"{seed}:{b}:{j}".encode()).hexdigest()[:8], 16) % n for j in range(n)]
        means.append(np.mean([values[i] for i in drawn]))
    return np.quantile(means, 0.025), np.quantile(means, 0.975)


@pytest.mark.parametrize("block, stretch", [(100_000, 1_000), (7, 5)])
def test_bootstrap_equals_drawing_one_by_one(spark, monkeypatch, block, stretch):
    """Also where a group takes several blocks and stretches."""
    monkeypatch.setattr(compare, "BLOCK", block)
    monkeypatch.setattr(compare, "STRETCH", stretch)
    rng = np.random.RandomState(3)
    groups = {"p": rng.rand(23), "q": rng.rand(1), "r": rng.rand(40)}
    data = [(g, f"s{j:03d}", float(v)) for g, vs in groups.items() for j, v in enumerate(vs)]
    frame = spark.createDataFrame(data, "g string, subject string, value double")
    got = {r.g: (r.n, r.mean, r.lo, r.hi) for r in compare.bootstrap(frame, ["g"], resamples=200, seed="9").collect()}
    for g, vs in groups.items():
        assert got[g] == pytest.approx((len(vs), vs.mean(), *plain_bootstrap(vs, 200, "9")), rel=1e-9)
