"""Exact ranks, running sums and quantiles that never sort a whole group in one task.

A plain ``row_number() OVER (PARTITION BY g ORDER BY k)`` puts all rows of ``g`` into one task.
When one group holds a third of a large table that task never ends. Here every group is cut
into buckets that follow the order (time slots, hash prefixes, score ranges). Bucket totals are a
small map-side-combined aggregate, their running sum gives each bucket an offset, and only
the rows inside one bucket are sorted together. Results equal the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epochwise.operators.attach import attach

BUCKET = "_bucket"
ALL = "_all"


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Give a global problem a constant key so that grouped and global share one path."""
    if keys:
        return df, list(keys)
    return df.withColumn(ALL, F.lit(1)), [ALL]


def bucket_offsets(df: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Per (keys, bucket): totals of ``sums`` before the bucket and over the whole key."""
    totals = df.groupBy(*keys, BUCKET).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    upto = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    out = [F.coalesce(F.sum(f"_t_{n}").over(upto), F.lit(0)).alias(f"_before_{n}") for n in sums]
    out += [F.sum(f"_t_{n}").over(whole).alias(f"_whole_{n}") for n in sums]
    return totals.select(*keys, BUCKET, *out)


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    sums: dict[str, Column],
) -> DataFrame:
    """Add ``cum_<name>`` (inclusive) and ``all_<name>`` for each entry of ``sums``.

    ``bucket`` must be non-decreasing along ``order``; ``order`` must be total.
    """
    df, keys = _keyed(df, keys)
    df = df.withColumn(BUCKET, bucket)
    offsets = bucket_offsets(df, keys, sums)
    inside = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cums = [
        (F.sum(c).over(inside) + F.col(f"_before_{n}")).alias(f"cum_{n}") for n, c in sums.items()
    ]
    alls = [F.col(f"_whole_{n}").alias(f"all_{n}") for n in sums]
    joined = df.join(offsets, [*keys, BUCKET])
    keep = [c for c in df.columns if c not in (BUCKET, ALL)]
    return joined.select(*keep, *cums, *alls)


def exact_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    out: str = "rn",
    limit: Column | None = None,
    total: str | None = None,
) -> DataFrame:
    """``row_number`` per key, from 1. With ``limit`` only ranks up to it are kept.

    Buckets that lie wholly beyond the limit are dropped by the offset join, before any
    sort. ``total`` names an optional column with the size of the key group.
    """
    df, keys = _keyed(df, keys)
    df = df.withColumn(BUCKET, bucket)
    offsets = bucket_offsets(df, keys, {"n": F.lit(1)})
    if limit is not None:
        df = df.withColumn("_limit", limit)
    joined = df.join(offsets, [*keys, BUCKET])
    if limit is not None:
        joined = joined.filter(F.col("_before_n") < F.col("_limit"))
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    rank = (F.row_number().over(inside) + F.col("_before_n")).cast("bigint")
    joined = joined.withColumn(out, rank)
    if limit is not None:
        joined = joined.filter(F.col(out) <= F.col("_limit"))
    keep = [c for c in df.columns if c not in (BUCKET, ALL, "_limit")]
    extra = [F.col("_whole_n").cast("bigint").alias(total)] if total else []
    return joined.select(*keep, out, *extra)


def sketch_bucket(df: DataFrame, col: str, buckets: int = 256, seed: int = 17) -> Column:
    """A bucket that follows the order of ``col``, cut at quantiles of a small hash sample.

    Whatever the values look like (ids with one stem, scores crowded near 0), buckets hold about
    equally many distinct values. The sample only sets the cuts, so results don't depend on it; it
    has at most 16 values a bucket.
    """
    order = F.xxhash64(F.lit(seed), col)
    sample = df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(order, col).limit(16 * buckets)
    found = sorted(r[0] for r in sample.collect())
    cuts = found[16::16] if len(found) > 16 else []
    if not cuts:
        return F.lit(0)
    # nulls are not above any cut
    return F.size(F.filter(F.lit(cuts).cast(f"array<{df.schema[col].dataType.simpleString()}>"), lambda c: c <= F.col(col)))


def with_level(df: DataFrame, col: str, out: str, buckets: int = 512) -> DataFrame:
    """Add ``out``, a bucket number that follows the order of a numeric column, cut at its quantiles.

    The quantiles are those of a mergeable sketch; they only set the cuts. Nulls and NaN get the
    highest bucket.
    """
    sketch = F.percentile_approx(F.col(col).cast("double"), [i / buckets for i in range(1, buckets)], 10 * buckets)
    found = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).agg(sketch).first()[0]
    cuts = sorted(set(found or []) - {float("inf"), float("-inf")})
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)


def hash_key(id_col: str | Column, seed: str = "42") -> Column:
    """A portable pseudo-random order key: the md5 of seed and id, as hex text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string")).cast("binary"))


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    seed: str = "42",
    digits: int = 3,
    out: str = "rn",
    limit: Column | None = None,
    total: str | None = None,
) -> DataFrame:
    """Rank rows of each key in a seeded random order; 16**digits buckets per key."""
    df = df.withColumn("_h", hash_key(id_col, seed))
    ranked = exact_rank(
        df,
        keys,
        [F.col("_h"), F.col(id_col)],
        F.substring("_h", 1, digits),
        out=out,
        limit=limit,
        total=total,
    )
    return ranked.drop("_h")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    qs: Sequence[float],
    accuracy: int = 20000,
    small: int = 20000,
) -> DataFrame:
    """Exact linear-interpolated quantiles per key: (keys, q, x, n).

    Pass 1 brackets each quantile with a mergeable sketch, pass 2 counts the rows below each
    bracket exactly and shuffles only the (pre-counted) values inside a bracket, about
    ``n / accuracy`` of them. The counts prove the bracket; a miss raises an error.
    Groups of at most ``small`` rows are bracketed by their minimum and maximum.
    """
    base, keys = _keyed(df, keys)
    base = base.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    margin = 5.0 / accuracy
    lows = [max(0.0, q - margin) for q in qs]
    highs = [min(1.0, q + margin) for q in qs]
    probe = base.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", lows + highs, accuracy).alias("_s"),
    )
    m = len(qs)
    is_small = F.col("_n") <= small
    lo = [F.when(is_small, F.col("_min")).otherwise(F.col("_s")[i]) for i in range(m)]
    hi = [F.when(is_small, F.col("_max")).otherwise(F.col("_s")[m + i]) for i in range(m)]
    brackets = probe.select(
        *keys,
        "_n",
        *[c.alias(f"_lo{i}") for i, c in enumerate(lo)],
        *[c.alias(f"_hi{i}") for i, c in enumerate(hi)],
    )
    # values are counted before the shuffle, so repeated values cost one row
    counted = attach(base, brackets, keys)
    inside = [(F.col("_v") >= F.col(f"_lo{i}")) & (F.col("_v") <= F.col(f"_hi{i}")) for i in range(m)]
    any_inside = inside[0]
    for cond in inside[1:]:
        any_inside = any_inside | cond
    below = counted.groupBy(*keys).agg(
        *[F.sum((F.col("_v") < F.col(f"_lo{i}")).cast("bigint")).alias(f"_b{i}") for i in range(m)]
    )
    held = counted.filter(any_inside).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    grid = brackets.join(below, keys).select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("_qi"),
                        F.lit(float(q)).alias("q"),
                        F.col(f"_lo{i}").alias("_lo"),
                        F.col(f"_hi{i}").alias("_hi"),
                        F.col(f"_b{i}").alias("_b"),
                        F.col("_n").alias("_n"),
                        (F.lit(float(q)) * (F.col("_n") - 1)).alias("_pos"),
                    )
                    for i, q in enumerate(qs)
                ]
            )
        ).alias("g"),
    ).select(*keys, "g.*")
    rows = held.join(grid, keys).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    upto = Window.partitionBy(*keys, "_qi").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_last", F.col("_b") + F.sum("_c").over(upto) - 1)
    rows = rows.withColumn("_first", F.col("_last") - F.col("_c") + 1)

    def at(pos: Column) -> Column:
        hit = (F.col("_first") <= pos) & (F.col("_last") >= pos)
        return F.max(F.when(hit, F.col("_v")))

    low_pos, high_pos = F.floor("_pos"), F.ceil("_pos")
    picked = rows.groupBy(*keys, "_qi", "q", "_n", "_pos").agg(
        at(low_pos).alias("_a"), at(high_pos).alias("_z")
    )
    frac = F.col("_pos") - F.floor("_pos")
    x = F.when(
        F.col("_a").isNull() | F.col("_z").isNull(),
        F.raise_error(F.lit("quantile bracket missed; raise accuracy")).cast("double"),
    ).otherwise(F.col("_a") + (F.col("_z") - F.col("_a")) * frac)
    out = [k for k in keys if k != ALL]
    return picked.select(*out, "q", x.alias("x"), F.col("_n").alias("n"))
