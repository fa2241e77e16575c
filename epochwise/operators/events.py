"""Event-level evaluation, smoothing, audits and further features the project's rules ask for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epochwise.functions.exprs import ratio
from epochwise.operators import ordering

REC = ["subject", "recording"]


def _blocks(block: int):
    return F.floor(F.col("epoch") / block)


def smooth_k_of_n(pred: DataFrame, k: int, n: int, keys: Sequence[str] = tuple(REC), block: int = 4096) -> DataFrame:
    """``alarm`` = 1 where at least k of the last n epochs by number (this one included) are positive.

    Recordings are cut into blocks of epochs; the last n - 1 epochs of a block are copied to the
    next, so a long recording needs no single task.
    """
    b = F.col("epoch") / block
    spread = pred.select(
        *keys, "epoch", "pred", F.explode(F.sequence(F.floor(b), F.floor((F.col("epoch") + n - 1) / block))).alias("_b")
    )
    w = Window.partitionBy(*keys, "_b").orderBy("epoch").rangeBetween(-(n - 1), 0)
    out = spread.withColumn("hits", F.sum("pred").over(w)).filter(F.col("_b") == _blocks(block))
    return out.withColumn("alarm", (F.col("hits") >= k).cast("int")).drop("_b")


def islands(pred: DataFrame, keys: Sequence[str] = tuple(REC), flag: str = "pred", block: int = 4096) -> DataFrame:
    """Runs of consecutive positive epochs as (keys, first_epoch, last_epoch, epochs).

    Runs are found inside blocks, then runs that touch across a block border are joined. The
    second step sees at most a block's worth of border runs fewer rows than the first.
    """
    pos = pred.filter(F.col(flag) == 1).select(*keys, "epoch").withColumn("_b", _blocks(block))
    w = Window.partitionBy(*keys, "_b").orderBy("epoch")
    runs = (
        pos.withColumn("_g", F.col("epoch") - F.row_number().over(w))
        .groupBy(*keys, "_b", "_g")
        .agg(F.min("epoch").alias("a"), F.max("epoch").alias("z"))
    )
    # only a run that ends on a border can continue in the next block
    touches_left = F.col("a") == F.col("_b") * block
    touches_right = F.col("z") == (F.col("_b") + 1) * block - 1
    inner = runs.filter(~touches_left & ~touches_right).select(*keys, "a", "z")
    border = runs.filter(touches_left | touches_right)
    wk = Window.partitionBy(*keys).orderBy("a")
    start = F.when(F.lag("z").over(wk) == F.col("a") - 1, 0).otherwise(1)
    joined = (
        border.withColumn("_s", start)
        .withColumn("_g", F.sum("_s").over(wk))
        .groupBy(*keys, "_g")
        .agg(F.min("a").alias("a"), F.max("z").alias("z"))
        .select(*keys, "a", "z")
    )
    return inner.unionByName(joined).select(
        *keys, F.col("a").alias("first_epoch"), F.col("z").alias("last_epoch"), (F.col("z") - F.col("a") + 1).alias("epochs")
    )


def detections(intervals: DataFrame, pred: DataFrame, n: int, keys: Sequence[str] = tuple(REC)) -> DataFrame:
    """(interval, detected, latency_s): first positive epoch overlapping each interval.

    Intervals are exploded to their candidate epochs, which makes the overlap an equi join.
    Latency counts from the interval start to the start of that epoch, not below zero.
    """
    cand = intervals.select(
        *keys, "start_s", "end_s", F.explode(F.sequence(F.floor(F.col("start_s") / n), F.floor(F.col("end_s") / n))).alias("epoch")
    ).filter((F.col("epoch") * n < F.col("end_s")) & ((F.col("epoch") + 1) * n > F.col("start_s")))
    hit = pred.filter("pred = 1").select(*keys, "epoch").withColumn("_hit", F.lit(1))
    met = cand.join(hit, [*keys, "epoch"], "left")
    first = F.min(F.when(F.col("_hit") == 1, F.col("epoch")))
    return met.groupBy(*keys, "start_s", "end_s").agg(
        F.coalesce(F.max("_hit"), F.lit(0)).alias("detected"),
        F.greatest(first * n - F.col("start_s"), F.lit(0)).alias("latency_s"),
    )


def event_sensitivity(found: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    return found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("detected").cast("bigint").alias("detected"),
        F.avg("detected").alias("event_sensitivity"),
        F.avg("latency_s").alias("mean_latency_s"),
    )


def false_alarms_per_hour(runs: DataFrame, labels: DataFrame, epoch_s: float, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Alarm runs that touch no labelled epoch, per recorded hour.

    ``runs`` from ``islands``; ``labels`` holds (subject, recording, epoch, y) for every epoch.
    """
    spans = runs.select(*REC, "first_epoch", F.explode(F.sequence("first_epoch", "last_epoch")).alias("epoch"))
    truth = labels.filter("y = 1").select(*REC, "epoch").withColumn("_y", F.lit(1))
    judged = spans.join(truth, [*REC, "epoch"], "left").groupBy(*REC, "first_epoch").agg(
        F.max(F.coalesce("_y", F.lit(0))).alias("_true")
    )
    false = judged.groupBy(*keys).agg(F.sum(1 - F.col("_true")).alias("false_alarms"), F.count(F.lit(1)).alias("alarms"))
    hours = labels.groupBy(*keys).agg((F.count(F.lit(1)) * F.lit(epoch_s / 3600.0)).alias("hours"))
    return hours.join(false, list(keys), "left").select(
        *keys,
        F.coalesce("alarms", F.lit(0)).alias("alarms"),
        F.coalesce("false_alarms", F.lit(0)).alias("false_alarms"),
        "hours",
        (F.coalesce("false_alarms", F.lit(0)) / F.col("hours")).alias("per_hour"),
    )


def sliding_epochs(samples: DataFrame, keys: Sequence[str], n: int, hop: int) -> DataFrame:
    """Overlapping epochs of n samples every ``hop``: a sample goes to each epoch that holds it."""
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - n) / hop) + 1)
    spread = samples.select(*samples.columns, F.explode(F.sequence(first, F.floor(F.col("idx") / hop))).alias("epoch"))
    return (
        spread.groupBy(*keys, "epoch")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
        .filter(F.col("n") == n)
    )


def recording_audit(samples: DataFrame, rate: float, keys: Sequence[str] = tuple(REC)) -> DataFrame:
    """Duration, channels and samples per recording; channels are counted after a per-channel step."""
    per = samples.groupBy(*keys, "channel").agg(F.count(F.lit(1)).alias("_n"), F.max("idx").alias("_last"))
    return per.groupBy(*keys).agg(
        F.sum("_n").alias("samples"),
        F.count(F.lit(1)).alias("channels"),
        ((F.max("_last") + 1) / F.lit(rate)).alias("duration_s"),
    )


def split_leakage(assign: DataFrame, split: str = "split", group: str = "subject") -> DataFrame:
    """(a, b, shared): subjects common to each pair of splits; empty pairs are reported too.

    Splits are few and fixed (train, validation, test).
    """
    per = assign.groupBy(group).agg(F.collect_set(split).alias("_s"))
    names = ["train", "validation", "test"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    both = [
        F.sum((F.array_contains("_s", a) & F.array_contains("_s", b)).cast("bigint")).alias(f"_p{i}")
        for i, (a, b) in enumerate(pairs)
    ]
    counts = per.agg(*both)
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_p{i}").alias("shared")) for i, (a, b) in enumerate(pairs)
    ]
    return counts.select(F.inline(F.array(*cells)))


def split_classes(rows: DataFrame, split: str = "split", y: str = "y") -> DataFrame:
    """(split, n, positives, both_classes): a split with one class can't be trained on or scored."""
    counts = rows.groupBy(split).agg(F.count(y).alias("n"), F.sum((F.col(y) == 1).cast("bigint")).alias("positives"))
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    return counts.withColumn("both_classes", both.cast("int"))


def extra_features(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Zero crossings (about the epoch mean) and peak-to-peak per epoch; keys include the epoch."""
    w = Window.partitionBy(*keys)
    centred = samples.withColumn("_c", F.col("value") - F.avg("value").over(w))
    sign = F.signum("_c")
    prev = F.lag(sign).over(w.orderBy("idx"))
    flagged = centred.withColumn("_x", F.when(prev * sign < 0, 1).otherwise(0))
    return flagged.groupBy(*keys).agg(
        F.sum("_x").cast("bigint").alias("zero_crossings"), (F.max("value") - F.min("value")).alias("peak_to_peak")
    )


def spectral_extras(psd: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spectral entropy (nats) and the theta/beta and alpha/beta power ratios."""

    def band(lo: float, hi: float):
        return F.sum(F.when((F.col("freq") >= lo) & (F.col("freq") < hi), F.col("psd")).otherwise(0.0))

    share = F.col("psd") / F.sum("psd").over(Window.partitionBy(*keys))
    term = F.when(share > 0, -share * F.log(share)).otherwise(0.0)
    out = psd.withColumn("_e", term).groupBy(*keys).agg(
        F.sum("_e").alias("spectral_entropy"), band(4, 8).alias("_t"), band(8, 13).alias("_a"), band(13, 30).alias("_b")
    )
    return out.select(
        *keys, "spectral_entropy", ratio(F.col("_t"), F.col("_b")).alias("theta_beta"), ratio(F.col("_a"), F.col("_b")).alias("alpha_beta")
    )


def channel_correlation(wide: DataFrame, channels: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, c1, c2, r): channels side by side in one row, so no self join is formed."""
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i + 1 :]]
    agg = wide.groupBy(*keys).agg(*[F.corr(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(f"_r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return agg.select(*keys, F.inline(F.array(*cells)))


def disparate_impact(counts: DataFrame, by: Sequence[str], subgroup: str, limit: float = 0.8) -> DataFrame:
    """Selection rate of each subgroup over the highest rate, and whether it reaches the limit.

    Subgroups are an attribute with few values; input has tp, tn, fp, fn.
    """
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    rate = ratio(F.col("tp") + F.col("fp"), n)
    top = F.max("rate").over(Window.partitionBy(*by))
    out = counts.select(*by, subgroup, rate.alias("rate"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"))
    out = out.withColumn("impact", ratio(F.col("rate"), top, 1.0))
    return out.withColumn("fair", (F.col("impact") >= limit).cast("int"))


def oversample(rows: DataFrame, id_col: str, seed: str = "42") -> DataFrame:
    """Repeat rows of the smaller classes until every class has as many as the largest.

    Whole copies first, then the remainder by hash order; ``copy`` numbers the copies.
    """
    counts = rows.groupBy("y").agg(F.count(F.lit(1)).alias("_c"))
    largest = counts.agg(F.max("_c").alias("_m"))
    # class counts: one row per class, then one row
    plan = counts.join(F.broadcast(largest)).select(
        "y", F.floor(F.col("_m") / F.col("_c")).alias("_whole"), (F.col("_m") % F.col("_c")).alias("_rest")
    )
    planned = rows.join(F.broadcast(plan), "y")
    whole = planned.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("_whole"))).alias("copy"))
    rest = ordering.hash_rank(planned, ["y"], id_col, seed, out="_rn", limit=F.col("_rest"))
    return whole.unionByName(rest.select(*rows.columns, (F.col("_whole") + 1).alias("copy")))
