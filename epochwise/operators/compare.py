"""Spread over subjects, confidence intervals, resampling and paired tests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwise.functions import stats
from epochwise.functions.exprs import ratio
from epochwise.operators import ordering
from epochwise.session import materialise


#: Values of one block of a bootstrap's group, and places whose draws one task makes.
BLOCK, STRETCH = 100_000, 1_000


def spread(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """mean, sd (ddof 1), median, q1, q3, min, max per key; quantiles exact."""
    # the per-subject table is read by several passes
    long = materialise(long.select(*keys, value), "spread")
    base = long.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    q = ordering.quantiles(long, keys, value, [0.25, 0.5, 0.75])
    wide = q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == p, F.col("x"))).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    )
    return base.join(wide, list(keys))


def ci95(long: DataFrame, keys: Sequence[str], value: str = "value", fixed_t: float | None = None) -> DataFrame:
    """mean +- t * sd / sqrt(n). The t quantile follows n unless a constant is given."""
    base = long.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    t = F.lit(fixed_t) if fixed_t is not None else stats.t_critical((F.col("n") - 1).cast("double"))
    half = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(t * F.col("sd") / F.sqrt(F.col("n").cast("double")))
    return base.withColumn("_half", half).select(
        *keys, "n", "mean", (F.col("mean") - F.col("_half")).alias("lo"), (F.col("mean") + F.col("_half")).alias("hi")
    )


def t_test(long: DataFrame, keys: Sequence[str], value: str = "value", mu: float = 0.5) -> DataFrame:
    """One-sample t against ``mu`` with two-sided p."""
    base = long.groupBy(*keys).agg(
        F.count(value).cast("double").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    t = F.when(F.col("sd") > 0, (F.col("mean") - F.lit(mu)) / (F.col("sd") / F.sqrt("n")))
    out = base.withColumn("t", t)
    return out.withColumn("p", stats.t_pvalue("t", F.col("n") - 1.0)).select(*keys, "n", "mean", "t", "p")


def draw(b: Column, j: Column, seed: str) -> Column:
    """A portable draw in [0, 2**32) from (seed, b, j)."""
    text = F.concat(F.lit(f"{seed}:"), b.cast("string"), F.lit(":"), j.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _hit_sums(seed: str, resamples: int, places: range, n: int, at: int, held: np.ndarray) -> np.ndarray:
    """For each resample the sum of the values at ``at`` and on that the draws of these places hit; draws as in ``draw``."""
    head, md5 = f"{seed}:".encode(), hashlib.md5
    tails = [f":{j}".encode() for j in places]
    out = np.zeros(resamples)
    for b in range(resamples):
        start = head + str(b).encode()
        drawn = np.frombuffer(b"".join([md5(start + t).digest()[:4] for t in tails]), ">u4").astype(np.int64) % n - at
        out[b] = held[drawn[(drawn >= 0) & (drawn < len(held))]].sum()
    return out


def bootstrap(values: DataFrame, keys: Sequence[str], group: str = "subject", value: str = "value", resamples: int = 2000, seed: str = "42") -> DataFrame:
    """Subject-level bootstrap of the mean: (keys, n, mean, lo, hi), 2.5 and 97.5 percentiles.

    Every resample draws n subjects with replacement. A task takes the draws of a stretch of places in all resamples and
    adds the values they hit to one array of ``resamples`` sums; only those arrays' numbers are shuffled. The values are
    laid out in blocks of ``BLOCK``; a stretch meets each block once, so beyond one block the draws are made once per block.
    """
    values = materialise(values.select(*keys, group, value), "bootstrap")
    ranked = ordering.exact_rank(
        values, keys, [F.col(group)], ordering.sketch_bucket(values, group), out="_j", total="_n"
    ).withColumn("_j", F.col("_j") - 1)
    ranked = materialise(ranked, "bootstrap-ranked")
    block = F.floor(F.col("_j") / BLOCK).alias("_block")
    pair = F.struct("_j", F.col(value).cast("double").alias("v"))
    blocks = ranked.groupBy(*keys, block).agg(F.max("_n").alias("_n"), F.sort_array(F.collect_list(pair)).alias("_p"))
    blocks = blocks.select(*keys, "_n", (F.col("_block") * BLOCK).alias("_at"), F.col("_p.v").alias("_v"))
    # a stretch of places for each task, so that a large group is spread
    begin = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(STRETCH).cast("bigint"))).alias("_from")
    work = blocks.select(*keys, "_n", "_at", "_v", begin).repartition(*keys, "_from")
    fields = [work.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("_b", T.IntegerType()), T.StructField("_s", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                n, at, held, first = (batch.column(c)[r].as_py() for c in ("_n", "_at", "_v", "_from"))
                held = np.array([np.nan if v is None else v for v in held], float)
                sums = _hit_sums(seed, resamples, range(first, min(n, first + STRETCH)), n, at, held)
                own = [pa.array([batch.column(k)[r].as_py()] * resamples, batch.column(k).type) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(resamples, dtype=np.int32)), pa.array(sums)], names=schema.names)

    sums = work.mapInArrow(run, schema).groupBy(*keys, "_b").agg(F.sum("_s").alias("_s"))
    sizes = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"))
    means = sums.join(sizes, list(keys)).select(*keys, (F.col("_s") / F.col("_n")).alias("_m"))
    limits = means.groupBy(*keys).agg(
        F.percentile("_m", 0.025).alias("lo"), F.percentile("_m", 0.975).alias("hi")
    )
    base = values.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return base.join(limits, list(keys))


def paired(long: DataFrame, keys: Sequence[str], model: str = "model", reference: str = "rf", group: str = "subject", value: str = "value") -> DataFrame:
    """(keys, model, group, d): each model minus the reference on the same subject."""
    ref = long.filter(F.col(model) == reference).select(*keys, group, F.col(value).alias("_ref"))
    others = long.filter(F.col(model) != reference)
    met = others.join(ref, [*keys, group])
    return met.select(*keys, model, group, (F.col(value) - F.col("_ref")).alias("d"))


def wilcoxon(diffs: DataFrame, keys: Sequence[str], digits: int = 12, with_p: bool = True, method: str = "auto") -> DataFrame:
    """Signed-rank test on ``d``: (keys, n, w, mean_delta, p, p_method).

    ``method``: ``exact`` or ``normal``; ``auto`` takes the exact distribution where it is known and
    cheap, without ties and zeros and up to 50 pairs. ``p_method`` says which a row got; an
    exact p asked for in the presence of ties or zeros is null. Zero differences are dropped. Equal absolute differences are counted before they are
    ranked, and ranks come from bucketed running sums.
    """
    base = materialise(diffs.select(*keys, "d", F.round("d", digits).alias("_d")), "paired")
    overall = base.groupBy(*keys).agg(
        F.avg("d").alias("mean_delta"), F.sum((F.col("_d") == 0).cast("bigint")).alias("_zeros")
    )
    sizes = (
        base.filter("_d <> 0")
        .groupBy(*keys, F.abs("_d").alias("_a"))
        .agg(F.count(F.lit(1)).alias("_c"), F.sum((F.col("_d") > 0).cast("bigint")).alias("_plus"))
    )
    placed = ordering.with_level(materialise(sizes, "paired-sizes"), "_a", "_level")
    ranked = ordering.running(placed, keys, F.col("_level"), [F.col("_a")], {"c": F.col("_c")})
    mid = F.col("cum_c") - (F.col("_c") - 1) / 2.0
    sums = ranked.groupBy(*keys).agg(
        F.max("all_c").cast("bigint").alias("n"),
        F.sum(mid * F.col("_plus")).alias("_wp"),
        F.sum(mid * (F.col("_c") - F.col("_plus"))).alias("_wm"),
        F.sum(F.pow(F.col("_c").cast("double"), F.lit(3.0)) - F.col("_c")).alias("_ties"),
    )
    out = overall.join(sums, list(keys), "left").select(
        *keys, F.coalesce("n", F.lit(0)).alias("n"), F.least("_wp", "_wm").alias("w"), "mean_delta", "_ties", "_zeros"
    )
    if with_p:
        ties = F.coalesce("_ties", F.lit(0.0))
        known = (ties == 0) & (F.col("_zeros") == 0)
        if method == "auto":
            how = F.when(known & (F.col("n") <= 50), "exact").otherwise("normal")
        else:
            how = F.when(known | F.lit(method == "normal"), F.lit(method))
        n = F.col("n").cast("double")
        out = out.withColumn("p_method", how).withColumn(
            "p",
            F.when(F.col("p_method") == "exact", stats.signed_rank_exact_pvalue("w", n)).when(
                F.col("p_method") == "normal", stats.signed_rank_normal_pvalue("w", n, ties)
            ),
        )
    return out.drop("_ties", "_zeros")


def mcnemar(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Over (keys, y, a, b) with two predictions per row: discordant counts and chi-square."""
    ok_a, ok_b = F.col("a") == F.col("y"), F.col("b") == F.col("y")
    agg = pairs.groupBy(*keys).agg(
        F.sum((ok_a & ~ok_b).cast("bigint")).alias("only_a"), F.sum((~ok_a & ok_b).cast("bigint")).alias("only_b")
    )
    gap = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)).cast("double")
    out = agg.withColumn("chi2", ratio(gap * gap, F.col("only_a") + F.col("only_b")))
    return out.withColumn("p", stats.chi2_1_pvalue("chi2"))


def cohens_d(diffs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Paired effect size: mean difference over its sample deviation."""
    agg = diffs.groupBy(*keys).agg(F.avg("d").alias("_m"), F.stddev_samp("d").alias("_s"), F.count("d").alias("n"))
    return agg.select(*keys, "n", F.when(F.col("_s") > 0, F.col("_m") / F.col("_s")).alias("cohens_d"))
