"""Reshaping, filtering, labelling, capping and scaling of samples and epoch rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.functions.constants import EPS, NEGATIVE_FILES, NEGATIVES_PER_POSITIVE
from epochwise.operators import ordering
from epochwise.operators.attach import attach


def to_long(wide: DataFrame, ids: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Wide samples to (ids, channel, value); an Expand, no shuffle."""
    doubles = [F.col(c).cast("double").alias(c) for c in channels]
    return wide.select(*ids, *doubles).unpivot(list(ids), list(channels), "channel", "value")


def live_channels(samples: DataFrame, keys: Sequence[str] = ("subject", "recording", "channel"), floor: float = 1e-9) -> DataFrame:
    """(keys, sd) of channels whose population deviation exceeds ``floor``."""
    return samples.groupBy(*keys).agg(F.stddev_pop("value").alias("sd")).filter(F.col("sd") > floor)


def drop_dead_channels(samples: DataFrame, keys: Sequence[str] = ("subject", "recording", "channel"), floor: float = 1e-9) -> DataFrame:
    live = live_channels(samples, keys, floor).select(*keys)
    return attach(samples, live, keys, "left_semi")


def epoch_count(length: Column, n: int, lose_last: bool = False) -> Column:
    """Full epochs in a recording. ``lose_last`` stops one short on an exact multiple."""
    return F.ceil((length - n) / F.lit(float(n))) if lose_last else F.floor(length / F.lit(float(n)))


def full_epochs(samples: DataFrame, keys: Sequence[str], n: int, lose_last: bool = False) -> DataFrame:
    """(keys, epoch, rows, ...) for each complete epoch; the incomplete tail is dropped.

    The epoch is part of the grouping key, so a group never exceeds one epoch.
    """
    epochs = (
        samples.withColumn("epoch", F.floor(F.col("idx") / n))
        .groupBy(*keys, "epoch")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
        .filter(F.col("rows") == n)
    )
    if not lose_last:
        return epochs
    # idx is gapless from 0, so the length is the largest idx + 1
    length = samples.groupBy(*keys).agg((F.max("idx") + 1).alias("_len"))
    kept = epochs.join(length, list(keys)).filter(F.col("epoch") < epoch_count(F.col("_len"), n, True))
    return kept.drop("_len")


def covered_epochs(intervals: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Distinct (keys, epoch) with index in [floor(start/n), floor(end/n)]."""
    covered = F.sequence(F.floor(F.col("start_s") / n), F.floor(F.col("end_s") / n))
    return intervals.select(*keys, F.explode(covered).alias("epoch")).distinct()


def label_by_index(epochs: DataFrame, intervals: DataFrame, n: int, keys: Sequence[str] = ("subject", "recording")) -> DataFrame:
    """Inclusive index rule, as an equi join on the covered epochs."""
    hits = covered_epochs(intervals, keys, n).withColumn("y", F.lit(1))
    joined = epochs.join(hits, [*keys, "epoch"], "left")
    return joined.withColumn("y", F.coalesce("y", F.lit(0)))


def label_by_overlap(epochs: DataFrame, intervals: DataFrame, n: int, keys: Sequence[str] = ("subject", "recording")) -> DataFrame:
    """Open overlap rule t0 < end and t1 > start with t0 = epoch*n, t1 = t0+n.

    The intervals are exploded to candidate epochs first, so the range condition is a filter
    on an equi join and no pair outside the candidates is formed.
    """
    covered = F.sequence(F.floor(F.col("start_s") / n), F.floor(F.col("end_s") / n))
    hits = (
        intervals.select(*keys, "start_s", "end_s", F.explode(covered).alias("epoch"))
        .filter((F.col("epoch") * n < F.col("end_s")) & ((F.col("epoch") + 1) * n > F.col("start_s")))
        .select(*keys, "epoch")
        .distinct()
        .withColumn("y", F.lit(1))
    )
    joined = epochs.join(hits, [*keys, "epoch"], "left")
    return joined.withColumn("y", F.coalesce("y", F.lit(0)))


def resample(samples: DataFrame, keys: Sequence[str], factor: int) -> DataFrame:
    """Integer decimation by block mean (run the band-pass first); whole blocks only."""
    return (
        samples.withColumn("idx", F.floor(F.col("idx") / factor))
        .groupBy(*keys, "idx")
        .agg(F.avg("value").alias("value"), F.count("value").alias("_n"))
        .filter(F.col("_n") == factor)
        .drop("_n")
    )


def cap_negatives(rows: DataFrame, id_col: str, per_positive: int = NEGATIVES_PER_POSITIVE, seed: str = "42", digits: int = 3) -> DataFrame:
    """All positives and at most ``per_positive`` times as many negatives per subject.

    A subject without positives is left whole, as nothing is balanced there.
    """
    counts = rows.groupBy("subject").agg(F.sum("y").cast("bigint").alias("_pos"))
    negatives = attach(rows.filter("y = 0"), counts, ["subject"])
    limit = F.when(F.col("_pos") > 0, F.col("_pos") * per_positive).otherwise(F.lit(2**62))
    kept = ordering.hash_rank(negatives, ["subject"], id_col, seed, digits, out="_rn", limit=limit)
    return rows.filter("y = 1").unionByName(kept.select(*rows.columns))


def cap_files(recordings: DataFrame, negatives: int = NEGATIVE_FILES, seed: str = "42") -> DataFrame:
    """Per subject all recordings with positives and a few seeded-random others.

    Input (subject, recording, positives)."""
    others = recordings.filter("positives = 0")
    kept = ordering.hash_rank(others, ["subject"], "recording", seed, 1, out="_rn", limit=F.lit(negatives))
    return recordings.filter("positives > 0").unionByName(kept.select(*recordings.columns))


def with_positives(rows: DataFrame, key: str = "subject") -> DataFrame:
    """Keep only the rows of subjects that have a positive."""
    usable = rows.groupBy(key).agg(F.max("y").alias("_any")).filter("_any = 1").select(key)
    return attach(rows, usable, [key], "left_semi")


def balance(rows: DataFrame, id_col: str, per_class: int | None = None, seed: str = "42") -> DataFrame:
    """Equally many rows per class: the smallest class, or ``per_class``."""
    if per_class is not None:
        return ordering.hash_rank(rows, ["y"], id_col, seed, out="_rn", limit=F.lit(per_class)).select(*rows.columns)
    smallest = rows.groupBy("y").count().agg(F.min("count").alias("_m"))
    # a single-row aggregate, so the broadcast side has one row whatever the input
    limited = rows.join(F.broadcast(smallest))
    return ordering.hash_rank(limited, ["y"], id_col, seed, out="_rn", limit=F.col("_m")).select(*rows.columns)


def cap_rows(rows: DataFrame, keys: Sequence[str], id_col: str, cap: int, seed: str = "42") -> DataFrame:
    """At most ``cap`` seeded-random rows per key; the operator is a sampler by purpose."""
    return ordering.hash_rank(rows, keys, id_col, seed, out="_rn", limit=F.lit(cap)).select(*rows.columns)


def one_hot(col: str, categories: Sequence, prefix: str) -> list[Column]:
    return [(F.col(col) == F.lit(c)).cast("int").alias(f"{prefix}{c}") for c in categories]


def log_scale(names: Sequence[str], eps: float = EPS) -> list[Column]:
    return [F.log(F.col(n) + F.lit(eps)).alias(n) for n in names]


def tensor_zscore(df: DataFrame, value: str, eps: float = 1e-6, keys: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / (population sd + eps) over everything, or per key."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    joined = attach(df, stats, keys) if keys else df.join(F.broadcast(stats))
    return joined.withColumn(value, (F.col(value) - F.col("_m")) / (F.col("_s") + F.lit(eps))).drop("_m", "_s")
