"""Out-of-fold scoring, closed forms, neighbours and selection on small separable data."""

import dataclasses

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from epochwise.operators import closed_form, evaluate, experiments, knn, models, selection
from epochwise.session import materialise

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """a separates the classes, b helps a little, c is noise; four subjects, one of them large."""
    rng = np.random.RandomState(11)
    n = 240
    y = (rng.rand(n) < 0.25).astype("int32")
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "subject": np.where(np.arange(n) % 2 == 0, "big", [f"s{i % 3}" for i in range(n)]),
            "y": y,
            "a": rng.randn(n) + 4.0 * y,
            "b": rng.randn(n) + 0.5 * y,
            "c": rng.randn(n) * 10.0,
        }
    )
    return materialise(spark.createDataFrame(pdf).withColumn("y", F.col("y").cast("int")), "t")


def auc(scored):
    return evaluate.roc_auc(scored, ["model"]).first().auc


@pytest.mark.parametrize("spec", [models.logistic(), models.random_forest(10, 4), models.linear_margin(iters=5)], ids=lambda s: s.name)
def test_models_find_the_signal_and_repeat(rows, spec):
    scored = models.out_of_fold(rows, COLS, spec)
    assert scored.count() == rows.count()
    assert auc(scored) > 0.95
    again = models.out_of_fold(rows, COLS, spec)
    assert scored.join(again.select("id", F.col("p").alias("q")), "id").filter("abs(p - q) > 1e-9").count() == 0


def test_one_class_training_side_is_an_error(rows):
    bad = rows.withColumn("y", F.when(F.col("subject") == "big", F.col("y")).otherwise(0))
    with pytest.raises(ValueError, match="one class"):
        models.out_of_fold(bad, COLS, models.logistic())


def numpy_lda(train, test):
    x0, x1 = train[train.y == 0][COLS].to_numpy(), train[train.y == 1][COLS].to_numpy()
    m0, m1 = x0.mean(0), x1.mean(0)
    within = (x0 - m0).T @ (x0 - m0) + (x1 - m1).T @ (x1 - m1)
    coef = np.linalg.solve(within / (len(train) - 2), m1 - m0)
    bias = -0.5 * (m0 + m1) @ coef + np.log(len(x1) / len(x0))
    return 1 / (1 + np.exp(-(test[COLS].to_numpy() @ coef + bias)))


def test_discriminant_equals_numpy(rows):
    got = closed_form.lda_scores(rows, COLS).toPandas().set_index("id").p
    pdf = rows.toPandas()
    for s in pdf.subject.unique():
        test = pdf[pdf.subject == s]
        assert np.allclose(got.loc[test.id].to_numpy(), numpy_lda(pdf[pdf.subject != s], test), atol=1e-9)


def test_neighbours_equal_brute_force_with_many_equal_rows(spark):
    """A third of the rows are copies, tiles and cells are small, groups are uneven."""
    rng = np.random.RandomState(4)
    n = 400
    x = rng.randn(n, 3) + rng.randint(0, 4, n)[:, None] * 5.0
    x[: n // 3] = x[0]
    pdf = pd.DataFrame(x, columns=COLS)
    pdf.insert(0, "id", np.arange(n))
    pdf["subject"] = [f"s{i % 3}" for i in range(n)]
    pdf["y"] = (rng.rand(n) < 0.3).astype("int32")
    got = knn.neighbours(spark.createDataFrame(pdf), COLS, 5, tile=32, pivots=16).toPandas()
    assert len(got) == 5 * n
    by_id = got.groupby("id").nid.apply(set)
    for i in range(n):
        d2 = ((x - x[i]) ** 2).sum(1)
        other = np.flatnonzero((pdf.subject != pdf.subject[i]).to_numpy())
        want = other[np.lexsort((other, d2[other]))[:5]]
        assert by_id[i] == set(want)


def test_selectors_keep_the_signal(rows):
    assert selection.k_best(1, COLS)(rows) == ["a"]
    assert "a" in selection.l1_columns(COLS, 0.05)(rows)
    assert selection.recursive_columns(COLS, 1, models.random_forest(10, 4), step=1)(rows) == ["a"]


def test_permutation_importance_ranks_the_signal_first(rows):
    train, test = rows.filter("subject <> 'big'"), rows.filter("subject = 'big'")
    got = selection.permutation_importance(train, test, COLS, models.random_forest(10, 4))
    assert got.orderBy(F.desc("auc_drop")).first().feature == "a"


def test_noise_repeats(rows):
    a = selection.noisy(rows, COLS).agg(*[F.sum(c) for c in COLS]).first()
    b = selection.noisy(rows.repartition(5), COLS).agg(*[F.sum(c) for c in COLS]).first()
    assert list(a) == pytest.approx(list(b))
    gap = selection.noisy(rows, ["a"]).join(rows.select("id", F.col("a").alias("o")), "id").agg(F.stddev_pop(F.col("a") - F.col("o"))).first()[0]
    assert 0.07 < gap < 0.13


def test_active_learning_grows_by_one_batch(rows):
    hist, log = experiments.active_learning(rows, COLS, models.random_forest(5, 3), seed_n=20, batch=15, rounds=3)
    assert [r.n_labelled for r in hist.orderBy("round").collect()] == [20, 35, 50]
    assert log.count() == 45  # every query of every round
    assert log.groupBy("round").count().filter("count <> 15").count() == 0


def test_failed_cells_are_reported(rows):
    broken = models.Spec("broken", lambda d: None)
    got = experiments.grid({"d": (rows, COLS, ["loso"])}, ["standard"], [models.logistic(), broken])
    state = {r.model: r.failure for r in got.collect()}
    assert state["logistic"] is None and state["broken"]
    done = got.filter("failure IS NULL").first()
    assert (done.n_scored, done.n_rows, done.folds_skipped) == (240, 240, 0)


def test_skipped_folds_are_counted(rows):
    """All positives in one subject: without it there is one class, so its fold can't be fitted."""
    one = materialise(rows.withColumn("y", F.when(F.col("subject") == "big", F.col("y")).otherwise(0)), "one")
    got = experiments.grid({"d": (one, COLS, ["loso"])}, ["standard"], [models.logistic()]).first()
    assert (got.n_scored, got.n_rows, got.folds_skipped) == (120, 240, 1)


def test_closed_forms_take_any_number_of_folds(rows):
    many = rows.withColumn("fold", F.col("id"))
    for scores in (closed_form.lda_scores, closed_form.gnb_scores):
        got = scores(many, COLS, fold="fold")
        assert got.count() == 240 and auc(got) > 0.95


def test_queries_keep_no_fitted_results(hub, monkeypatch):
    """Each call fits: nothing of an earlier one, or of the other query of a pair, is read."""
    from epochwise.operators import experiments as ops
    from epochwise.plans import q_models

    fits = []
    monkeypatch.setattr(q_models, "stored", lambda t: hub.emb)
    monkeypatch.setattr(q_models.models, "out_of_fold", lambda *a, **k: fits.append("oof") or hub.emb)
    monkeypatch.setattr(ops, "active_learning", lambda *a, **k: fits.append("active") or (hub.emb, hub.emb))
    for _ in range(2):
        q_models.out_of_fold(hub, q_models.SPECS["logistic"])
        q_models.active(hub, "uncertainty")
    assert fits == ["oof", "active"] * 2


def test_fit_partitions_follow_the_rows(spark, rows):
    """More shuffle partitions don't make a fit of few rows dearer, nor another one."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "200")
        many = models.in_place(rows)
        assert many.rdd.getNumPartitions() == models.FIT_PARTS
        spark.conf.set(key, "4")
        assert models.in_place(rows).rdd.getNumPartitions() == 4
    finally:
        spark.conf.set(key, before)


def test_neighbour_groups_are_bounded_and_whole():
    pivots = np.arange(12.0)[:, None]
    held = np.array([5, 3, 40, 1, 1, 1, 9, 9, 9, 2, 2, 2])
    place = knn._groups(pivots, held, 20, np.zeros(12, bool))
    among = np.bincount(place, held)
    assert among.sum() == held.sum() and len(set(place)) < len(held)
    assert all(n <= 20 or (place == g).sum() == 1 for g, n in enumerate(among))
    assert knn._groups(np.zeros((1, 1)), np.array([7]), 20, np.zeros(1, bool)).tolist() == [0]
    alone = knn._groups(pivots, held, 100, np.arange(12) == 0)
    assert (alone == alone[0]).sum() == 1 and len(set(alone)) == 2


def test_neighbours_travel_once_per_group(spark, monkeypatch):
    """Rows of one cloud see all cells, but only one tile."""
    rng = np.random.RandomState(5)
    pdf = pd.DataFrame(rng.rand(400, 3), columns=COLS).assign(id=np.arange(400), subject=[f"s{i % 4}" for i in range(400)], y=0)
    stored = []
    keep = knn.materialise
    monkeypatch.setattr(knn, "materialise", lambda df, label: stored.append((label, keep(df, label))) or stored[-1][1])
    found = knn.neighbours(spark.createDataFrame(pdf), COLS, 5).count()
    assert found == 2000
    assert dict(stored)["knn-load"].count() == 1
    assert dict(stored)["knn-visits"].count() == 400


class Probe:
    """An estimator that tells what it was given."""

    def fit(self, train):
        return train.rdd.getNumPartitions(), train.count(), train.agg(F.sum("y")).first()[0]


@pytest.mark.parametrize("spec", [models.random_forest(), models.boosting(), models.perceptron()], ids=lambda s: s.name)
def test_few_rows_are_fitted_in_few_partitions(spark, rows, spec):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    x = models.vectors(rows, COLS)
    positives = rows.agg(F.sum("y")).first()[0]
    n, wins = (2 * (240 - positives), 240 - positives) if spec.balance_rows else (240, positives)
    probed = dataclasses.replace(spec, build=lambda d: Probe())
    assert models.fit(x, probed, 3, {0: 1.0, 1: 1.0}) == (1, n, wins)
    small = dataclasses.replace(probed, rows=100)
    assert models.fit(x, small, 3, {0: 1.0, 1: 1.0}) == (-(-n // 100), n, wins)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_a_forest_in_pieces_is_one_model(rows, monkeypatch):
    """Every tree votes once, and a second fit gives the same trees."""
    monkeypatch.setattr(models, "PIECE_TREES", 4)
    spec, x = models.random_forest(10, 3), models.vectors(rows, COLS)
    model = models.fit(x, spec, 3, {0: 1.0, 1: 1.0})
    assert [p.getNumTrees for p in model.pieces] == [4, 3, 3]
    got = model.transform(x).select("id", vector_to_array("probability").alias("p"), "prediction").toPandas().set_index("id")
    assert np.allclose(got.p.map(sum), 1)
    assert (got.prediction == got.p.map(np.argmax)).all()
    votes = 0
    for piece in model.pieces:
        one = piece.setProbabilityCol("q").transform(x).select("id", vector_to_array("q")[1].alias("q")).toPandas()
        votes = votes + piece.getNumTrees * one.set_index("id").q
    assert np.allclose(votes.loc[got.index] / 10, got.p.map(lambda p: p[1]))
    trees = [t.featureImportances.toArray() for p in model.pieces for t in p.trees if t.numNodes > 1]
    assert np.allclose(model.featureImportances.toArray(), np.mean(trees, axis=0))
    again = models.fit(x, spec, 3, {0: 1.0, 1: 1.0})

    def grown(m):
        return [t.toDebugString.split("\n", 1)[1] for p in m.pieces for t in p.trees]

    assert grown(again) == grown(model) and len(set(grown(model))) > 5


def test_a_fold_is_scored_on_its_own(rows, monkeypatch):
    """A scoring stage holds the models of one fold: each of its tasks unpacks all that the stage holds."""
    written = []

    def noted(df, label, *args):
        written.append((label, df.select("fold").distinct().count() if "fold" in df.columns else 0))
        return materialise(df, label, *args)

    monkeypatch.setattr(models, "materialise", noted)
    scored = models.out_of_fold(rows, COLS, models.random_forest(4, 2))
    assert [w for w in written if w[0] == "scored-rf"] == [("scored-rf", 1)] * 4
    assert scored.count() == 240 and scored.select("fold").distinct().count() == 4


def test_a_margin_classifier_of_few_rows_has_one_partition(rows):
    """A step of its optimiser is then one task."""
    probed = dataclasses.replace(models.linear_margin(), build=lambda d: Probe())
    assert models.fit(models.vectors(rows, COLS), probed, 3, {0: 1.0, 1: 1.0})[:2] == (1, 240)
