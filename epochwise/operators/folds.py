"""Fold assignment and statistics fitted on the training side of each fold only.

Training statistics of a fold are "all minus held-out": one pass collects sums per group, and
each group's training figures follow by subtraction. K folds cost one scan, not K.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epochwise.operators import ordering
from epochwise.operators.attach import attach


def holdout(rows: DataFrame, id_col: str, share: float = 0.2, seed: str = "42") -> DataFrame:
    """Stratified hold-out: ``is_test`` is 1 for the first ``share`` of each class by hash."""
    ranked = ordering.hash_rank(rows, ["y"], id_col, seed, out="_rn", total="_n")
    test = F.col("_rn") <= F.round(F.col("_n") * F.lit(share))
    return ranked.withColumn("is_test", test.cast("int")).drop("_rn", "_n")


def stratified_kfold(rows: DataFrame, id_col: str, k: int = 5, seed: str = "42") -> DataFrame:
    ranked = ordering.hash_rank(rows, ["y"], id_col, seed, out="_rn")
    return ranked.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")


def leave_one_group_out(rows: DataFrame, group: str = "subject") -> DataFrame:
    """``fold`` = rank of the group in name order."""
    groups = rows.select(group).distinct()
    ranked = ordering.exact_rank(groups, [], [F.col(group)], ordering.sketch_bucket(groups, group), out="_rn")
    numbered = ranked.select(group, (F.col("_rn") - 1).cast("int").alias("fold"))
    return attach(rows, numbered, [group])


def group_kfold(rows: DataFrame, k: int = 5, group: str = "subject", seed: str = "42") -> DataFrame:
    """All rows of a group share a fold; the fold is a hash of the group, so no shuffle."""
    h = F.conv(F.substring(ordering.hash_key(group, seed), 1, 8), 16, 10).cast("bigint")
    return rows.withColumn("fold", (h % k).cast("int"))


def _per_column(per: DataFrame, group: str, cols: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """(group, _n, i, parts): one row per group and column out of one wide row per group."""
    cells = [F.struct(F.lit(i).alias("i"), *[F.col(f"_{p}_{c}").alias(p) for p in parts]) for i, c in enumerate(cols)]
    return per.select(group, "_n", F.inline(F.array(*cells)))


def _as_arrays(long: DataFrame, group: str) -> DataFrame:
    """(group, n, a, b) with arrays in column order."""
    packed = long.groupBy(group).agg(F.max("rest").alias("n"), F.sort_array(F.collect_list(F.struct("i", "a", "b"))).alias("_p"))
    return packed.select(group, "n", F.col("_p.a").alias("a"), F.col("_p.b").alias("b"))


def held_out_moments(rows: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Per held-out group: (group, n, a, b), mean and population deviation of all other groups.

    Moments are merged from per-group count, mean and variance, which stays accurate where
    raw sums of squares would cancel. Only the first aggregate sees data rows; the windows run
    over one row per group and column.
    """
    per = rows.groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        *[F.avg(c).alias(f"_m_{c}") for c in cols],
        *[F.var_pop(c).alias(f"_v_{c}") for c in cols],
    )
    w = Window.partitionBy("i")
    long = _per_column(per, group, cols, ["m", "v"])
    long = long.withColumn("_tn", F.sum("_n").over(w)).withColumn("_g", F.sum(F.col("_n") * F.col("m")).over(w) / F.col("_tn"))
    gap = F.col("m") - F.col("_g")
    # second moments about the grand mean add up across groups
    long = long.withColumn("_q", F.col("_n") * (F.col("v") + gap * gap))
    rest = F.col("_tn") - F.col("_n")
    drift = -(F.col("_n") * gap) / rest
    var = (F.sum("_q").over(w) - F.col("_q")) / rest - drift * drift
    stats = long.select(
        group, "i", rest.alias("rest"), (F.col("_g") + drift).alias("a"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("b")
    )
    return _as_arrays(stats.filter("rest > 0"), group)


def held_out_ranges(rows: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Per held-out group: (group, n, a, b), minimum and range of all other groups.

    A group that owns the extreme takes the runner-up.
    """
    per = rows.groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        *[F.min(c).alias(f"_lo_{c}") for c in cols],
        *[F.max(c).alias(f"_hi_{c}") for c in cols],
    )
    long = _per_column(per, group, cols, ["lo", "hi"])
    whole = Window.partitionBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up, down = Window.partitionBy("i").orderBy("lo", group), Window.partitionBy("i").orderBy(F.desc("hi"), group)
    long = long.withColumns({"_ru": F.row_number().over(up), "_rd": F.row_number().over(down), "_tn": F.sum("_n").over(whole)})

    def place(col: str, rank: str, k: int) -> Column:
        return F.max(F.when(F.col(rank) == k, F.col(col))).over(whole)

    lo = F.when(F.col("_ru") == 1, place("lo", "_ru", 2)).otherwise(place("lo", "_ru", 1))
    hi = F.when(F.col("_rd") == 1, place("hi", "_rd", 2)).otherwise(place("hi", "_rd", 1))
    stats = long.select(group, "i", (F.col("_tn") - F.col("_n")).alias("rest"), lo.alias("a"), (hi - lo).alias("b"))
    return _as_arrays(stats.filter("rest > 0"), group)


def scale_held_out(rows: DataFrame, group: str, cols: Sequence[str], kind: str = "standard") -> DataFrame:
    """Each row scaled as a test row: by the statistics of all other groups."""
    stats = held_out_moments(rows, group, cols) if kind == "standard" else held_out_ranges(rows, group, cols)
    joined = attach(rows, stats.drop("n"), [group])
    div = [F.when(F.col("b")[i] == 0, 1.0).otherwise(F.col("b")[i]) for i in range(len(cols))]
    scaled = [((F.col(c) - F.col("a")[i]) / div[i]).alias(c) for i, c in enumerate(cols)]
    keep = [c for c in rows.columns if c not in cols]
    return joined.select(*keep, *scaled)


def class_weights(rows: DataFrame, group: str) -> DataFrame:
    """Per (held-out group, class): n_train / (k * n_class) over the other groups."""
    per = rows.groupBy(group, "y").agg(F.count(F.lit(1)).alias("_n"))
    # every (group, class) cell, so a group lacking a class still gets that class's weight
    classes = per.groupBy("y").agg(F.sum("_n").alias("_class_total"))
    wide = per.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("y", "_n"))).alias("_own"))
    totals = classes.agg(F.collect_list(F.struct("y", "_class_total")).alias("_all"))
    # classes are a fixed handful, so one row of totals is broadcast
    cells = wide.join(F.broadcast(totals)).select(group, "_own", F.inline("_all"))
    own = F.coalesce(F.try_element_at("_own", F.col("y")), F.lit(0))
    cells = cells.select(group, "y", (F.col("_class_total") - own).alias("n_class")).filter("n_class > 0")
    w = Window.partitionBy(group)
    return cells.withColumn(
        "weight", F.sum("n_class").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_class").cast("double"))
    )
