"""Models, selection and experiments over the feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.functions.constants import FEATURES
from epochwise.operators import closed_form, evaluate, experiments, knn, models, selection
from epochwise.operators.attach import attach
from epochwise.plans.hubs import FEATS, Hub, with_views
from epochwise.plans.registry import query
from epochwise.session import materialise

# fixed values: the published settings
TREES, DEPTH = 300, 12
HIDDEN = (64, 32)


def stored(t: Hub):
    """The feature table, written once for the many scans of a fold loop; a subject's rows lie apart."""
    spread = t.emb.repartition("subject", F.pmod("id", F.lit(4)))
    return materialise(spread, "features", partition_by=["subject"])


def forest(trees: int = TREES, depth: int = DEPTH, name: str = "rf"):
    return models.random_forest(trees, depth, name=name)


def summary(scored, by=("model", "protocol")):
    out = evaluate.pooled_vs_macro(scored, list(by))
    return out.select(
        *by, "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("sensitivity", "specificity", "roc_auc", "macro_auc")]
    )


def out_of_fold(t: Hub, spec, protocol: str = "loso") -> DataFrame:
    """Scored rows of a model, fitted anew by each query: nothing is kept between calls."""
    rows, fold = models.with_folds(stored(t), protocol)
    if fold != "subject":
        rows = materialise(rows, "folded")
    return models.out_of_fold(rows, FEATS, spec, fold=fold, protocol=protocol)


def fold_facts(t: Hub, spec, protocol: str = "loso") -> DataFrame:
    """What must hold whatever the model: all rows scored, once, within [0, 1], subjects apart."""
    scored = out_of_fold(t, spec, protocol)
    spread = scored.groupBy("subject").agg(F.count_distinct("fold").alias("_folds"))
    per = attach(scored, spread, ["subject"]).groupBy("model", "protocol", "fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("id").alias("ids"),
        F.sum("y").cast("bigint").alias("positives"),
        F.sum((F.col("p").isNull() | F.isnan("p")).cast("bigint")).alias("unscored"),
        F.sum(((F.col("p") < 0) | (F.col("p") > 1)).cast("bigint")).alias("outside"),
        F.sum((F.col("_folds") > 1).cast("bigint")).alias("shared"),
    )
    return per.select("model", "protocol", "fold", "n", "ids", "positives", "unscored", "outside", "shared")


def fold_facts_sql(model: str, protocol: str) -> str:
    fold = "subject" if protocol == "loso" else "CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1) % 5 AS VARCHAR)"
    shared = "0" if protocol == "loso" else "CASE WHEN folds > 1 THEN 1 ELSE 0 END"
    return (
        with_views("emb", f=f"SELECT id, subject, y, {fold} AS fold FROM emb", s="SELECT subject, count(DISTINCT fold) AS folds FROM f GROUP BY subject")
        + f"""SELECT '{model}' AS model, '{protocol}' AS protocol, fold, count(*) AS n, count(DISTINCT id) AS ids, CAST(sum(y) AS BIGINT) AS positives,
        CAST(0 AS BIGINT) AS unscored, CAST(0 AS BIGINT) AS outside, CAST(sum({shared}) AS BIGINT) AS shared
        FROM f JOIN s ON f.subject = s.subject GROUP BY fold"""
    )


SPECS = {
    "random_forest": forest(),
    "logistic": models.logistic(),
    "boosting": models.boosting(),
    "linear_margin": models.linear_margin(),
    "perceptron": models.perceptron(HIDDEN),
    "gaussian_nb_ml": models.gaussian_nb(),
}


def _register(name: str, spec, protocol: str) -> None:
    label = f"oof_{name}" + ("" if protocol == "loso" else f"_{protocol}")
    query(label)(lambda t: summary(out_of_fold(t, spec, protocol)))
    query(f"{label}_folds", fold_facts_sql(spec.name, protocol))(lambda t: fold_facts(t, spec, protocol))


for _name, _spec in SPECS.items():
    _register(_name, _spec, "loso")
_register("random_forest", SPECS["random_forest"], "kfold")


@query("lda")
def lda(t: Hub):
    out = closed_form.lda_scores(t.emb, FEATS)
    return out.select("id", "subject", "y", F.round("p", 6).alias("p"))


_LL = " + ".join(
    f"-0.5e0 * (ln(2 * pi() * (v{{c}}_{f} + eps)) + power(e.{f} - m{{c}}_{f}, 2) / (v{{c}}_{f} + eps))" for f in FEATS
)


def _gnb_sql() -> str:
    aggs = ["count(*) AS n", "sum(o.y) AS n1"]
    for f in FEATS:
        for c in (0, 1):
            aggs.append(f"avg(CASE WHEN o.y = {c} THEN o.{f} END) AS m{c}_{f}")
            aggs.append(f"var_pop(CASE WHEN o.y = {c} THEN o.{f} END) AS v{c}_{f}")
    eps = ", ".join(f"var_pop(o.{f})" for f in FEATS)
    stats = f"""SELECT s.subject, {', '.join(aggs)}, 1e-9 * greatest({eps}) AS eps FROM (SELECT DISTINCT subject FROM emb) s
    JOIN emb o ON o.subject <> s.subject GROUP BY s.subject"""
    l1 = f"(ln(CAST(n1 AS DOUBLE) / n) + {_LL.format(c=1)})"
    l0 = f"(ln(CAST(n - n1 AS DOUBLE) / n) + {_LL.format(c=0)})"
    return (
        with_views("emb", st=stats)
        + f"SELECT e.id, e.subject, e.y, round(1 / (1 + exp({l0} - {l1})), 6) AS p FROM emb e JOIN st ON e.subject = st.subject"
    )


@query("gnb", _gnb_sql())
def gnb(t: Hub):
    out = closed_form.gnb_scores(t.emb, FEATS)
    return out.select("id", "subject", "y", F.round("p", 6).alias("p"))


@query(
    "knn",
    with_views(
        "emb",
        d=f"""SELECT a.id, a.subject, a.y, b.y AS ny, row_number() OVER (PARTITION BY a.id ORDER BY
        {' + '.join(f'(a.{f} - b.{f}) * (a.{f} - b.{f})' for f in FEATS)}, b.id) AS rn FROM emb a JOIN emb b ON a.subject <> b.subject""",
    )
    + "SELECT id, subject, y, round(avg(ny), 6) AS p FROM d WHERE rn <= 5 GROUP BY id, subject, y",
)
def knn_query(t: Hub):
    out = knn.knn_scores(t.emb, FEATS, 5)
    return out.select("id", "subject", "y", F.round("p", 6).alias("p"))


@query("multiclass_forest")
def multiclass_forest(t: Hub):
    rows = t.emb.select("id", F.col("cls").alias("y"), *FEATS)
    pred = experiments.multiclass_oof(rows, FEATS, 5, trees=TREES, depth=DEPTH)
    return evaluate.multiclass(pred, list(range(10)), 0)["recall"].withColumn("recall", F.round("recall", 6))


def epoch_rows(t: Hub) -> DataFrame:
    """The flagship's 20 features as a data set: id, subject, y."""
    named = F.concat_ws("/", "subject", "recording", F.col("epoch").cast("string"))
    return t.features.select(F.xxhash64(named).alias("id"), "subject", "y", *FEATURES)


@query("grid")
def grid(t: Hub):
    """Eight models, two scalings, three pairs of data set and protocol: 48 cells."""
    specs = [
        *(SPECS[n] for n in ("random_forest", "logistic", "boosting", "linear_margin", "perceptron")),
        models.Scorer("lda", lambda r, c, f: closed_form.lda_scores(r, c, f)),
        models.Scorer("gnb", lambda r, c, f: closed_form.gnb_scores(r, c, f)),
        models.Scorer("knn", lambda r, c, f: knn.knn_scores(r, c, 5, f).join(r.select("id", F.col(f).cast("string").alias("fold")), "id")),
    ]
    sets = {
        "embeddings": (stored(t), FEATS, ["loso", "kfold"]),
        "epochs": (materialise(epoch_rows(t), "epoch-rows"), FEATURES, ["kfold"]),
    }
    out = experiments.grid(sets, ["standard", "minmax"], specs)
    keys = ["dataset", "scaler", "model", "protocol"]
    return out.select(
        *keys, "failure", "n_scored", "n_rows", "folds_skipped", *[F.round(c, 6).alias(c) for c in ("accuracy", "sensitivity", "roc_auc")]
    )


@query("hyperparameters")
def hyperparameters(t: Hub):
    """Trees, depth and class weights; the inner folds choose, one subject tests."""
    specs = [
        models.random_forest(n, d, name=f"rf-{n}-{d}-{'weighted' if w else 'plain'}", weighted=w)
        for n in (100, 300)
        for d in (6, 12, 30)
        for w in (True, False)
    ]
    out = experiments.sweep(stored(t), FEATS, specs, "s0", inner=3)
    return out.select(
        "model", F.round("inner_auc", 6).alias("inner_auc"), "chosen", F.round("test_auc", 6).alias("test_auc"), "folds_skipped"
    )


@query("forest_importance")
def forest_importance(t: Hub):
    out = selection.forest_importance(stored(t), FEATS, forest())
    return out.select("feature", F.round("importance", 6).alias("importance"), "rank")


@query("permutation_importance")
def permutation_importance(t: Hub):
    rows = stored(t)
    train, test = rows.filter("subject <> 's0'"), rows.filter("subject = 's0'")
    out = selection.permutation_importance(train, test, FEATS, forest())
    return out.withColumn("auc_drop", F.round("auc_drop", 6))


def kept_table(t: Hub, kept):
    """(feature, kept) for every column, in a schema that does not follow the data."""
    return t.spark.createDataFrame([(c, int(c in kept)) for c in FEATS], "feature string, kept int")


@query("l1_selection")
def l1_selection(t: Hub):
    return kept_table(t, selection.l1_columns(FEATS)(stored(t)))


@query("recursive_elimination")
def recursive_elimination(t: Hub):
    return kept_table(t, selection.recursive_columns(FEATS, 10, forest(), step=6)(stored(t)))


@query("pca")
def pca(t: Hub):
    out = selection.explained_variance(t.emb, FEATS)
    return out.select("component", F.round("explained", 6).alias("explained"), F.round("cumulative", 6).alias("cumulative"), "needed")


@query("kmeans")
def kmeans(t: Hub):
    out = selection.clusters(selection.project(t.emb, FEATS, 2), 2)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


@query("validate_subsets")
def validate_subsets(t: Hub):
    selectors = {
        "all": None,
        "k_best": selection.k_best(10, FEATS),
        "l1": selection.l1_columns(FEATS),
        "rfe": selection.recursive_columns(FEATS, 10, forest(30, 5, "rfe"), step=6),
    }
    out = selection.validate(stored(t), FEATS, models.logistic(), selectors)
    return out.select("subset", F.round("sensitivity", 6).alias("sensitivity"), F.round("roc_auc", 6).alias("roc_auc"))


@query("ablation")
def ablation(t: Hub):
    """Groups of the 20 epoch features: bands, Hjorth, line length and RMS, then the spreads over channels."""
    means = [f for f in FEATURES if f.endswith("_mean")]
    hjorth = [f for f in means if f.startswith("hjorth")]
    size = [f for f in means if f.startswith(("line_length", "rms"))]
    groups = {
        "bands": [f for f in means if f not in hjorth + size],
        "plus_hjorth": hjorth,
        "plus_length_rms": size,
        "all": [f for f in FEATURES if f.endswith("_std")],
    }
    rows = epoch_rows(t).withColumn("fold", F.pmod(F.xxhash64("subject"), F.lit(5)).cast("int"))
    out = selection.ablation(materialise(rows, "epoch-rows"), groups, models.logistic(), fold="fold")
    return out.select("subset", F.round("sensitivity", 6).alias("sensitivity"), F.round("roc_auc", 6).alias("roc_auc"))


@query("robustness")
def robustness(t: Hub):
    out = selection.robustness(t.emb, FEATS, forest())
    return out.select("variant", *[F.round(c, 6).alias(c) for c in ("accuracy", "sensitivity", "roc_auc")])


def active(t: Hub, strategy: str) -> tuple[DataFrame, DataFrame]:
    """(history, audit) of a run at the published settings."""
    return experiments.active_learning(stored(t), FEATS, forest(), strategy)


@query("active_learning")
def active_learning(t: Hub):
    # the two runs don't need one another, and a round is many small jobs
    runs = models.concurrently([lambda: active(t, "uncertainty")[0], lambda: active(t, "random")[0]])
    return runs[0].unionByName(runs[1])


@query("active_learning_audit")
def active_learning_audit(t: Hub):
    """Every query of every round, from 150 labelled rows in steps of 100."""
    return active(t, "uncertainty")[1].select("round", "strategy", "queried_index", "human_label")


@query("calibration_isotonic")
def calibration_isotonic(t: Hub):
    """Every subject is held out once; inside each training side three folds give the scores of its map."""
    out = experiments.calibrated(stored(t), FEATS, models.logistic())
    return out.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2.0)), 6).alias("brier_raw"),
        F.round(F.avg(F.pow(F.col("calibrated") - F.col("y"), 2.0)), 6).alias("brier_calibrated"),
    )


@query("learning_curve")
def learning_curve(t: Hub):
    out = experiments.learning_curve(stored(t), FEATS, models.logistic(), ["s0", "s1"], [2, 4, 6])
    return out.select("n_subjects", F.round("sensitivity", 6).alias("sensitivity"), F.round("roc_auc", 6).alias("roc_auc"))


@query("cross_set")
def cross_set(t: Hub):
    rows = stored(t).withColumn("dataset", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    scored = experiments.cross_set(materialise(rows, "sets"), FEATS, models.logistic())
    return summary(scored, ("model", "fold"))


