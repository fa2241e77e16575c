"""Importance, selection, projection, ablation and robustness on top of out-of-fold scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.operators import evaluate, folds, models, ordering, profile
from epochwise.operators.models import Spec
from epochwise.session import materialise


def _weights(train: DataFrame) -> dict[int, float]:
    counts = {r.y: r["count"] for r in train.groupBy("y").count().collect()}  # one row per class
    n = sum(counts.values())
    return {c: n / (len(counts) * v) for c, v in counts.items()}


def standardised(rows: DataFrame, cols: Sequence[str]) -> dict:
    """{column: (mean, population deviation)} of the rows: one aggregate row."""
    r = rows.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    return {c: (r[i], r[len(cols) + i] or 1.0) for i, c in enumerate(cols)}


def forest_importance(rows: DataFrame, cols: Sequence[str], spec: Spec) -> DataFrame:
    """(feature, importance, rank) of a fitted forest."""
    model = models.fit(models.vectors(rows, cols), spec, len(cols), _weights(rows))
    imp = [(c, float(v)) for c, v in zip(cols, model.featureImportances.toArray())]
    table = rows.sparkSession.createDataFrame(imp, "feature string, importance double")
    return profile.rank_features(table, "importance", "rank")


def permutation_importance(train: DataFrame, test: DataFrame, cols: Sequence[str], spec: Spec, seed: str = "42", id_col: str = "id") -> DataFrame:
    """(feature, auc_drop): AUC lost when a test column is shuffled among the test rows.

    Two hash ranks give the shuffle, joined once; every row then carries one vector per feature
    and the model scores them together.
    """
    scale = standardised(train, cols) if spec.scaled else None
    model = models.fit(models.vectors(train, cols, scale), spec, len(cols), _weights(train), id_col)
    here = ordering.hash_rank(test, [], id_col, seed, out="_i")
    there = ordering.hash_rank(test, [], id_col, seed + "p", out="_i").select("_i", *[F.col(c).alias(f"_o_{c}") for c in cols])
    met = here.join(there, "_i")
    plain = [F.struct(F.lit("none").alias("feature"), *[F.col(c).alias(c) for c in cols])]
    mixed = [
        F.struct(F.lit(f).alias("feature"), *[(F.col(f"_o_{c}") if c == f else F.col(c)).alias(c) for c in cols]) for f in cols
    ]
    variants = met.select(id_col, "y", F.inline(F.array(*plain, *mixed)))
    scored = model.transform(models.vectors(variants, cols, scale)).select("feature", "y", models.class_one_score(model).alias("p"))
    auc = evaluate.roc_auc(scored, ["feature"])
    whole = auc.filter("feature = 'none'").select(F.col("auc").alias("_all"))
    # one row
    return auc.filter("feature <> 'none'").join(F.broadcast(whole)).select("feature", (F.col("_all") - F.col("auc")).alias("auc_drop"))


def k_best(k: int, cols: Sequence[str]) -> Callable[[DataFrame], list[str]]:
    """Selector by ANOVA F on the training rows."""

    def pick(train: DataFrame) -> list[str]:
        top = profile.rank_features(profile.anova(train, cols, with_p=False), "f", "rank", k)
        return [r.feature for r in top.orderBy("rank").collect()]  # k rows

    return pick


def l1_columns(cols: Sequence[str], reg: float = 0.02) -> Callable[[DataFrame], list[str]]:
    """Selector of non-zero coefficients of an L1 logistic fit on standardised training rows."""

    def pick(train: DataFrame) -> list[str]:
        sc = standardised(train, cols)
        model = models.fit(models.vectors(train, cols, sc), models.logistic(l1=1.0, reg=reg), len(cols), _weights(train))
        kept = [c for c, v in zip(cols, model.coefficients.toArray()) if v != 0.0]
        return kept or list(cols)

    return pick


def recursive_columns(cols: Sequence[str], k: int, spec: Spec, step: int = 2) -> Callable[[DataFrame], list[str]]:
    """Selector that refits and drops the ``step`` least important columns until k are left."""

    def pick(train: DataFrame) -> list[str]:
        use = list(cols)
        w = _weights(train)
        while len(use) > k:
            model = models.fit(models.vectors(train, use), spec, len(use), w)
            order = sorted(zip(model.featureImportances.toArray(), use))
            drop = {c for _, c in order[: min(step, len(use) - k)]}
            use = [c for c in use if c not in drop]
        return use

    return pick


def pca(rows: DataFrame, cols: Sequence[str], share: float = 0.95):
    """(model, number of components that explain ``share``, per-component shares)."""
    vec = models.vectors(rows, cols, standardised(rows, cols))
    model = PCA(k=len(cols), inputCol="_x", outputCol="_z").fit(vec)
    ratios = [float(v) for v in model.explainedVariance.toArray()]
    total, n = 0.0, 0
    for v in ratios:
        total, n = total + v, n + 1
        if total >= share - 1e-12:
            break
    return model, n, ratios


def explained_variance(rows: DataFrame, cols: Sequence[str], share: float = 0.95) -> DataFrame:
    """(component, explained, cumulative, needed) — ``needed`` marks components up to the share."""
    _, n, ratios = pca(rows, cols, share)
    out, total = [], 0.0
    for i, v in enumerate(ratios):
        total += v
        out.append((i + 1, v, total, int(i < n)))
    return rows.sparkSession.createDataFrame(out, "component int, explained double, cumulative double, needed int")


def project(rows: DataFrame, cols: Sequence[str], k: int = 2) -> DataFrame:
    """First k principal components of the standardised columns, as z1..zk and vector ``_z``."""
    vec = models.vectors(rows, cols, standardised(rows, cols))
    out = PCA(k=k, inputCol="_x", outputCol="_z").fit(vec).transform(vec)
    arr = vector_to_array("_z")
    return out.select(*rows.columns, "_z", *[arr[i].alias(f"z{i + 1}") for i in range(k)])


def clusters(projected: DataFrame, k: int = 2, seed: int = 42) -> DataFrame:
    """K-means label on the projection."""
    model = KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="cluster", maxIter=50).fit(projected)
    return model.transform(projected)


def validate(rows: DataFrame, cols: Sequence[str], spec: Spec, selectors: dict[str, Callable | None], fold: str = "subject") -> DataFrame:
    """(subset, metrics, auc): each selection repeated inside every fold and scored out of fold."""
    ready = models.Prepared(rows, cols, fold)
    parts = [
        models.out_of_fold(ready, cols, spec, select=select).withColumn("subset", F.lit(name))
        for name, select in selectors.items()
    ]
    return evaluate.pooled_vs_macro(reduce(DataFrame.unionByName, parts), ["subset"])


def ablation(rows: DataFrame, groups: dict[str, list[str]], spec: Spec, fold: str = "subject") -> DataFrame:
    """Growing column sets, each scored out of fold."""
    ready = models.Prepared(rows, [c for cols in groups.values() for c in cols], fold)
    parts, use = [], []
    for name, cols in groups.items():
        use = use + cols
        parts.append(models.out_of_fold(ready, use, spec).withColumn("subset", F.lit(name)))
    return evaluate.pooled_vs_macro(reduce(DataFrame.unionByName, parts), ["subset"])


def noisy(rows: DataFrame, cols: Sequence[str], sigma: float = 0.1, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Columns with N(0, sigma) noise from a hash of id and column, so a recomputed task repeats it."""

    def uniform(c: str, salt: int):
        h = F.pmod(F.xxhash64(F.col(id_col), F.lit(c), F.lit(seed), F.lit(salt)), F.lit(2**52))
        return (h.cast("double") + 0.5) / F.lit(float(2**52))

    def gauss(c: str):
        return F.sqrt(-2.0 * F.log(uniform(c, 1))) * F.cos(2.0 * F.pi() * uniform(c, 2))

    keep = [c for c in rows.columns if c not in cols]
    return rows.select(*keep, *[(F.col(c) + F.lit(sigma) * gauss(c)).alias(c) for c in cols])


def robustness(rows: DataFrame, cols: Sequence[str], spec: Spec, sigma: float = 0.1, test_share: float = 0.2) -> DataFrame:
    """Metrics of one hold-out model on clean and on noisy (standardised) test rows."""
    split = materialise(folds.holdout(rows, "id", test_share), "robust")
    train, test = split.filter("is_test = 0"), split.filter("is_test = 1")
    by = standardised(train, cols)

    def scaled(df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in cols]
        return df.select(*keep, *[((F.col(c) - F.lit(by[c][0])) / F.lit(by[c][1])).alias(c) for c in cols])

    model = models.fit(models.vectors(scaled(train), cols), spec, len(cols), _weights(train))
    clean = scaled(test)
    both = clean.withColumn("variant", F.lit("clean")).unionByName(noisy(clean, cols, sigma).withColumn("variant", F.lit("noisy")))
    scored = model.transform(models.vectors(both, cols)).select("variant", "subject", "y", models.class_one_score(model).alias("p"))
    stored = materialise(scored, "robust-scored")
    return evaluate.pooled_vs_macro(stored, ["variant"])
