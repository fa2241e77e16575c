"""Ridge logistic fits of many folds, and isotonic calibration, against numpy on all rows at once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from conftest import SF_DIR
from epochwise.operators import experiments, irls, isotonic, models
from epochwise.plans.hubs import FEATS, Hub
from epochwise.session import materialise

COLS = ["a", "b", "c"]


def table(n=300, seed=5):
    rng = np.random.RandomState(seed)
    y = (rng.rand(n) < 0.3).astype("int32")
    return pd.DataFrame(
        {
            "id": np.arange(n), "subject": [f"s{i % 4}" for i in range(n)], "y": y,
            "a": rng.randn(n) + 1.5 * y, "b": 1e4 + 50 * rng.randn(n) - 20 * y, "c": np.full(n, 3.0),
        }
    )


@pytest.fixture(scope="module")
def rows(spark):
    return materialise(spark.createDataFrame(table()).withColumn("y", F.col("y").cast("int")), "linear")


def numpy_ridge(train, cols, reg=0.01, weighted=True):
    """Newton's method on one training side; (mean, spread, coefficients)."""
    x, y = train[cols].to_numpy(float), train.y.to_numpy(float)
    a, b = x.mean(0), x.std(0)
    b[b < 1e-9] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - a) / b])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if weighted else np.ones(len(y))
    t, penalty = np.zeros(z.shape[1]), np.r_[0.0, np.full(len(cols), reg)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ t))
        gradient = z.T @ (w * (p - y)) / w.sum() + penalty * t
        h = (z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + np.diag(penalty)
        t -= np.linalg.lstsq(h, gradient, rcond=None)[0]
    return a, b, t


def numpy_scores(pdf, cols, reg=0.01):
    out = {}
    for s in sorted(pdf.subject.unique()):
        a, b, t = numpy_ridge(pdf[pdf.subject != s], cols, reg)
        test = pdf[pdf.subject == s]
        p = 1 / (1 + np.exp(-(t[0] + ((test[cols].to_numpy(float) - a) / b) @ t[1:])))
        out |= dict(zip(test.id, p))
    return out


def test_folds_equal_fits_on_their_own(rows):
    scored = models.out_of_fold(rows, COLS, models.logistic())
    got = {r.id: r.p for r in scored.collect()}
    assert got == pytest.approx(numpy_scores(table(), COLS), abs=1e-7)
    assert {r.fold for r in scored.select("fold", "subject").filter("fold <> subject").collect()} == set()


def test_the_feature_table_by_value(spark):
    """Every out-of-fold score on the given embeddings."""
    pdf = Hub(spark, SF_DIR).emb.select("id", "subject", "y", *FEATS).toPandas()
    stored = materialise(Hub(spark, SF_DIR).emb, "linear-emb")
    got = {r.id: r.p for r in models.out_of_fold(stored, FEATS, models.logistic()).collect()}
    assert got == pytest.approx(numpy_scores(pdf, FEATS), abs=1e-6)


def test_close_to_the_library(rows):
    """Spark's own fit stops earlier and scales by the sample deviation, so it is near, not equal."""
    ready = models.Prepared(rows, COLS[:2], "subject")
    train = models.vectors(rows.filter("subject <> 's0'"), COLS[:2], ready.scale("standard")["s0"])
    theirs = models.fit(train, models.logistic(), 2, ready.weights["s0"])
    (ours,) = irls.fit(rows, COLS[:2], [irls.Cell((("subject", "s0"),))])
    scale = ready.scale("standard")["s0"]
    moved = [c * scale[n][1] for c, n in zip(ours.coefficients, COLS)]
    assert moved == pytest.approx(theirs.coefficients.toArray(), rel=0.02)


def test_nested_cells_scales_and_one_class(rows):
    nested = rows.withColumn("inner", (F.col("id") % 3).cast("string"))
    cells = [irls.Cell((("subject", "s1"), ("inner", "2"))), irls.Cell(()), irls.Cell((("subject", "s9"),))]
    found = irls.fit(nested, ["a"], cells)
    pdf = table()
    for model, keep in zip(found, ((pdf.subject != "s1") & (pdf.id % 3 != 2), pdf.id >= 0, pdf.id >= 0)):
        a, b, t = numpy_ridge(pdf[keep], ["a"])
        assert model.coefficients == pytest.approx(t[1:] / b, abs=1e-8)
        assert model.intercept == pytest.approx(t[0] - (t[1:] * a / b).sum(), abs=1e-8)
    held = irls.score(nested, ["a"], [(cells[0], found[0])], ["id", "subject", "inner"]).collect()
    assert {r.id for r in held} == set(pdf.id[(pdf.subject != "s1") & (pdf.id % 3 == 2)])
    given = irls.fit(nested, ["a"], [cells[1]], [([0.0], [2.0])], reg=0.0)[0]
    free = irls.fit(nested, ["a"], [cells[1]], reg=0.0)[0]
    assert given.coefficients == pytest.approx(free.coefficients, abs=1e-7)
    assert irls.fit(nested.filter("y = 0"), ["a"], [cells[1]]) == [None]
    separable = irls.fit(nested.withColumn("a", F.col("y") * 1.0), ["a"], [cells[1]])[0]
    assert np.isfinite(separable.coefficients).all()


def plain_isotonic(p, y):
    """(score, value) by pooling one row after the other."""
    order = np.argsort(p, kind="stable")
    blocks = []
    for s in sorted(set(p.tolist())):
        hit = y[p == s]
        blocks.append([s, s, len(hit), float(hit.sum())])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    assert len(order) == sum(b[2] for b in blocks)
    return blocks


@pytest.mark.parametrize("size", [5, 40, 50_000])
def test_isotonic_blocks(spark, size):
    """Ranges of any size give the blocks of all rows, with ties, for several groups at once."""
    rng = np.random.RandomState(2)
    data, want = [], {}
    for g in ("u", "v", "w"):
        p = np.round(rng.rand(250), 2 if g == "u" else 6)
        y = (rng.rand(250) < (p if g != "w" else 1 - p)).astype(int)
        data += [(g, float(a), int(b)) for a, b in zip(p, y)]
        want[g] = plain_isotonic(p, y)
    scores = spark.createDataFrame([*data, ("u", None, 1), ("v", 0.5, None)], "g string, p double, y int")
    got = {}
    for r in isotonic.blocks(scores, ["g"], size=size).orderBy("g", "lo").collect():
        got.setdefault(r.g, []).append([r.lo, r.hi, r.n, r.s])
    assert got == want


def test_isotonic_apply_equals_the_library(spark, monkeypatch):
    rng = np.random.RandomState(6)
    p = rng.rand(400)
    train = spark.createDataFrame([("u", float(a), int(rng.rand() < a)) for a in p], "g string, p double, y int")
    test = spark.createDataFrame([("u", float(a), i) for i, a in enumerate(np.r_[rng.rand(200), -1.0, 2.0])] + [("u", None, 900), ("z", 0.5, 901)], "g string, p double, i int")
    monkeypatch.setattr(isotonic, "PART", 50)
    fitted = isotonic.blocks(train, ["g"])
    got = {r.i: r.calibrated for r in isotonic.apply(test, fitted, ["g"]).collect()}
    known = test.filter("p IS NOT NULL AND g = 'u'")
    iso = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="v").fit(train.select("p", F.col("y").cast("double").alias("y")))
    want = {r.i: r.v for r in iso.transform(known).collect()}
    assert {i: v for i, v in got.items() if i < 900} == pytest.approx(want, abs=1e-12)
    assert got[900] is None and got[901] is None
    assert isotonic.blocks(train.limit(0), ["g"]).collect() == []


def test_calibrated_scores(rows):
    """Each subject's map comes from the others alone, and is the map of their inner scores."""
    out = experiments.calibrated(rows, COLS[:2], models.logistic())
    got = {r.id: (r.p, r.calibrated) for r in out.collect()}
    pdf = table()
    from epochwise.operators import folds

    inner = {r.id: r.fold for r in folds.group_kfold(rows, 3).collect()}
    pdf["g"] = [inner[i] for i in pdf.id]
    want = {}
    outer = numpy_scores(pdf, COLS[:2])
    for s in sorted(pdf.subject.unique()):
        train = pdf[pdf.subject != s]
        p, y = [], []
        for g in sorted(train.g.unique()):
            side, held = train[train.g != g], train[train.g == g]
            a, b, t = numpy_ridge(side, COLS[:2])
            p += (1 / (1 + np.exp(-(t[0] + ((held[COLS[:2]].to_numpy(float) - a) / b) @ t[1:])))).tolist()
            y += held.y.tolist()
        blocks = plain_isotonic(np.array(p), np.array(y))
        xs = [x for b in blocks for x in b[:2]]
        vs = [b[3] / b[2] for b in blocks for _ in (0, 1)]
        for i in pdf.id[pdf.subject == s]:
            want[i] = float(np.interp(outer[i], xs, vs))
    assert {i: c for i, (_, c) in got.items()} == pytest.approx(want, abs=1e-5)
