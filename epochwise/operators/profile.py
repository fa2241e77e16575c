"""Profiling, feature scores and ranking over feature rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epochwise.functions import stats
from epochwise.functions.exprs import ratio, stack_columns
from epochwise.operators import binning, ordering
from epochwise.operators.attach import attach


def histogram(long: DataFrame, bins: int, key: str = "feature", value: str = "value", cls: str = "y") -> DataFrame:
    """Density per (feature, class, bin) on common edges; the top edge belongs to the last bin."""
    span = long.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    placed = attach(long, span, [key]).withColumn("_w", width)
    at = F.when(F.col("_w") == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("_lo")) / F.when(F.col("_w") == 0, 1.0).otherwise(F.col("_w"))), F.lit(bins - 1))
    )
    counts = placed.groupBy(key, cls, at.cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.max("_w").alias("_w")
    )
    total = F.sum("n").over(Window.partitionBy(key, cls))
    return counts.select(key, cls, "bin", "n", ratio(F.col("n"), total * F.col("_w")).alias("density"))


def column_histogram(rows: DataFrame, cols: Sequence[str], bins: int, cls: str = "y") -> DataFrame:
    """``histogram`` of wide columns: (feature, cls, bin, n, density) from two scans, without a row per column."""
    counts = binning.width_bins(rows, cols, cls, bins)
    kind = rows.schema[cls].dataType
    total = F.sum("n").over(Window.partitionBy("feature", "cls"))
    density = ratio(F.col("n"), total * F.col("width"))
    return counts.select("feature", F.col("cls").cast(kind).alias(cls), "bin", "n", density.alias("density"))


def class_balance(rows: DataFrame, group: str = "subject") -> DataFrame:
    """Rows and positives per subject, and in total (null subject)."""
    return rows.rollup(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("positives"), F.avg("y").alias("rate")
    )


def moments(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, population sd, skew and excess kurtosis per column, in one pass over the wide rows."""
    stats_of = {"mean": F.avg, "sd": F.stddev_pop, "skew": F.skewness, "kurtosis": F.kurtosis}
    wide = rows.agg(*[fn(c).alias(f"{c}__{s}") for c in cols for s, fn in stats_of.items()])
    cells = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{s}").alias(s) for s in stats_of]) for c in cols
    ]
    return wide.select(F.inline(F.array(*cells)))


def correlations(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All column pairs (f1 < f2 by position) with Pearson r.

    The Gram matrix is summed per partition and merged; only columns x columns numbers reach
    the driver, whatever the number of rows.
    """
    vec = VectorAssembler(inputCols=list(cols), outputCol="v").transform(rows).select("v")
    mat = Correlation.corr(vec, "v").head()[0].toArray()
    out = [
        (cols[i], cols[j], float(mat[i, j])) for i in range(len(cols)) for j in range(i + 1, len(cols))
    ]
    return rows.sparkSession.createDataFrame(out, "f1 string, f2 string, r double")


def top_correlations(rows: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    pairs = correlations(rows, cols)
    return pairs.orderBy(F.abs("r").desc(), F.col("f1").desc(), F.col("f2").desc()).limit(k)


def column_profile(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing count, minimum, maximum and mean per column."""
    wide = rows.agg(
        *[F.sum((F.col(c).isNull() | F.isnan(c)).cast("bigint")).alias(f"{c}__missing") for c in cols],
        *[F.min(c).alias(f"{c}__lo") for c in cols],
        *[F.max(c).alias(f"{c}__hi") for c in cols],
        *[F.avg(c).alias(f"{c}__mean") for c in cols],
    )
    cells = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{s}").alias(s) for s in ("missing", "lo", "hi", "mean")])
        for c in cols
    ]
    return wide.select(F.inline(F.array(*cells)))


def overall_profile(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: missing values, amplitude range and the range of column means."""
    return column_profile(rows, cols).agg(
        F.sum("missing").alias("missing"),
        F.min("lo").alias("amplitude_lo"),
        F.max("hi").alias("amplitude_hi"),
        F.min("mean").alias("mean_lo"),
        F.max("mean").alias("mean_hi"),
    )


def class_moments(rows: DataFrame, cols: Sequence[str], by: Sequence[str] = ("y",)) -> DataFrame:
    """(by, feature, n, m, v): count, mean and population variance per class and column."""
    wide = rows.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.avg(c).alias(f"{c}__m") for c in cols],
        *[F.var_pop(c).alias(f"{c}__v") for c in cols],
    )
    cells = [
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__m").alias("m"), F.col(f"{c}__v").alias("v")) for c in cols
    ]
    return wide.select(*by, "n", F.inline(F.array(*cells)))


def anova(rows: DataFrame, cols: Sequence[str], alpha: float = 0.05, with_p: bool = True) -> DataFrame:
    """One-way F per feature from class counts, means and variances."""
    cm = class_moments(rows, cols)
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    agg = cm.groupBy("feature").agg(
        F.sum("n").alias("_n"),
        F.count(F.lit(1)).cast("double").alias("_k"),
        F.sum(F.col("n") * F.col("v")).alias("_within"),
        grand.alias("_grand"),
        F.collect_list(F.struct("n", "m")).alias("_cells"),
    )
    # as many cells as classes
    between = F.aggregate(
        "_cells", F.lit(0.0), lambda a, c: a + c["n"] * F.pow(c["m"] - F.col("_grand"), F.lit(2.0))
    )
    d1, d2 = F.col("_k") - 1.0, F.col("_n") - F.col("_k")
    out = agg.select("feature", d1.alias("df1"), d2.alias("df2"), ratio(between / d1, F.col("_within") / d2).alias("f"))
    if not with_p:
        return out
    out = out.withColumn("p", stats.f_pvalue("f", "df1", "df2"))
    return out.withColumn("significant", (F.col("p") < alpha).cast("int"))


def pearson(rows: DataFrame, cols: Sequence[str], y: str = "y") -> DataFrame:
    """r of every column with the label, its t and p."""
    wide = rows.agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.corr(c, y).alias(c) for c in cols])
    long = wide.select("n", stack_columns(list(cols), "feature", "r"))
    t = F.col("r") * F.sqrt(ratio(F.col("n") - 2.0, 1.0 - F.col("r") * F.col("r")))
    out = long.withColumn("t", t)
    return out.withColumn("p", stats.t_pvalue("t", F.col("n") - 2.0))


def mutual_info_binned(rows: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Plug-in mutual information of each quantile-binned column with the label, in nats.

    A substitute for the nearest-neighbour estimator. Edges are exact quantiles; a
    value's bin is the number of inner edges not above it.
    """
    long = rows.select("y", stack_columns(list(cols)))
    inner = [i / bins for i in range(1, bins)]
    edges = ordering.quantiles(long, ["feature"], "value", inner)
    edges = edges.groupBy("feature").agg(F.sort_array(F.collect_list("x")).alias("_e"))
    placed = attach(long, edges, ["feature"]).withColumn("bin", F.size(F.filter("_e", lambda e: e <= F.col("value"))))
    joint = placed.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).cast("double").alias("c"))
    return _information(joint)


def column_mutual_info(rows: DataFrame, cols: Sequence[str], bins: int = 10, y: str = "y") -> DataFrame:
    """``mutual_info_binned`` from two scans of the wide rows, without a row per column."""
    counts = binning.quantile_bins(rows, cols, y, bins)
    return _information(counts.select("feature", "bin", F.col("cls").alias("y"), F.col("n").cast("double").alias("c")))


def _information(joint: DataFrame) -> DataFrame:
    """(feature, mutual_info_binned) of counts (feature, bin, y, c)."""
    n = F.sum("c").over(Window.partitionBy("feature"))
    nb = F.sum("c").over(Window.partitionBy("feature", "bin"))
    ny = F.sum("c").over(Window.partitionBy("feature", "y"))
    terms = joint.select("feature", (F.col("c") / n * F.log(F.col("c") * n / (nb * ny))).alias("_t"))
    return terms.groupBy("feature").agg(F.sum("_t").alias("mutual_info_binned"))


def rank_features(scores: DataFrame, by: str, out: str, k: int | None = None) -> DataFrame:
    """Rank from 1 by descending score, name as the tie-break. One row per feature column."""
    ranked = scores.withColumn(out, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col(by).desc(), "feature")))
    return ranked if k is None else ranked.filter(F.col(out) <= k)


def prune_correlated(rows: DataFrame, cols: Sequence[str], limit: float = 0.9) -> list[str]:
    """Greedy keep: a column stays unless it correlates above ``limit`` with one kept before."""
    pairs = {(r.f1, r.f2): r.r for r in correlations(rows, cols).collect()}  # columns x columns rows
    kept: list[str] = []
    for c in cols:
        if all(abs(pairs[(k, c)]) <= limit for k in kept):
            kept.append(c)
    return kept


def column_robust_stats(rows: DataFrame, cols: Sequence[str], key: str = "channel") -> DataFrame:
    """``robust_stats`` of wide columns: (key, mean, sd, n, median, iqr); quantiles exact, without a row per column."""
    wide = rows.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in cols])
    parts = [F.struct(F.lit(c).alias(key), F.col(c)["mean"].alias("mean"), F.col(c)["sd"].alias("sd")) for c in cols]
    q = binning.column_quantiles(rows, cols, [0.25, 0.5, 0.75]).withColumnRenamed("feature", key)
    at = lambda p: F.max(F.when(F.col("q") == p, F.col("x")))
    found = q.groupBy(key).agg(F.max("n").alias("n"), at(0.5).alias("median"), (at(0.75) - at(0.25)).alias("iqr"))
    return wide.select(F.inline(F.array(*parts))).join(found, key)


def robust_stats(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """n, mean, sd, median and interquartile range per key, quantiles exact."""
    base = long.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    q = ordering.quantiles(long, keys, value, [0.25, 0.5, 0.75])
    wide = q.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max(F.when(F.col("q") == 0.5, F.col("x"))).alias("median"),
        (F.max(F.when(F.col("q") == 0.75, F.col("x"))) - F.max(F.when(F.col("q") == 0.25, F.col("x")))).alias("iqr"),
    )
    return base.join(wide, list(keys))
