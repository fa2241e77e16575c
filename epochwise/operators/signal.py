"""Segments and spectral or time-domain features.

Samples are grouped by epoch (a bounded group: one epoch length of samples), all channels of an
instant travelling in one row, so the raw data are shuffled once. The spread over channels
follows in the same task and is combined there: after it, one row per epoch is left to move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epochwise.functions import dsp
from epochwise.functions.constants import BANDS, CHANNEL_FEATURES, EPS, NEGATIVES_PER_POSITIVE
from epochwise.operators import prep

KEYS = ["subject", "recording", "epoch"]


def segments(numbered: DataFrame, channels: Sequence[str], n: int) -> DataFrame:
    """(subject, recording, epoch, channel, x): whole epochs only, x sorted by index.

    A channel that is absent from an epoch, or has a gap in it, has no row for that epoch.
    """
    instant = F.struct("idx", *[F.col(c).cast("double").alias(c) for c in channels])
    grouped = (
        numbered.withColumn("epoch", F.floor(F.col("idx") / n))
        .groupBy(*KEYS)
        .agg(F.sort_array(F.collect_list(instant)).alias("s"))
        .filter(F.size("s") == n)
    )
    per_channel = [F.struct(F.lit(c).alias("channel"), F.col(f"s.{c}").alias("x")) for c in channels]
    return _without_gaps(grouped.select(*KEYS, F.inline(F.array(*per_channel))))


def _without_gaps(segs: DataFrame) -> DataFrame:
    return segs.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def long_segments(samples: DataFrame, n: int) -> DataFrame:
    """The same from long rows (subject, recording, channel, idx, value), as the readers give them.

    Channels may differ between recordings; each is cut on its own.
    """
    grouped = (
        samples.filter(F.col("value").isNotNull())
        .groupBy("subject", "recording", F.floor(F.col("idx") / n).alias("epoch"), "channel")
        .agg(F.sort_array(F.collect_list(F.struct("idx", F.col("value").cast("double").alias("value")))).alias("s"))
        .filter(F.size("s") == n)
    )
    return _without_gaps(grouped.select(*KEYS, "channel", F.col("s.value").alias("x")))


def raw_to_features(
    samples: DataFrame, intervals: DataFrame, taps: Sequence[float], n: int, rate: float, nperseg: int,
    per_positive: int = NEGATIVES_PER_POSITIVE, block: int = 4096,
) -> DataFrame:
    """Samples of any set of channels to labelled feature rows with capped negatives.

    Dead channels go first, as the filter would give a constant channel edges; then band-pass,
    epochs, features over the live channels of an epoch, labels, and the cap per subject.
    """
    channel = ["subject", "recording", "channel"]
    live = prep.drop_dead_channels(samples.filter(F.col("value").isNotNull()), channel)
    segs = long_segments(fir(live, channel, taps, block), n)
    labelled = prep.label_by_index(epoch_features(segs, rate, nperseg), intervals, n)
    named = labelled.withColumn("_id", F.concat_ws("/", *[F.col(k).cast("string") for k in KEYS]))
    return prep.cap_negatives(named, "_id", per_positive).drop("_id")


def channel_features(segs: DataFrame, rate: float, nperseg: int, log_scale: bool = True, eps: float = EPS, x: str = "x") -> DataFrame:
    """The ten features of each segment in one Arrow pass."""
    fn = dsp.channel_features_udf(rate, nperseg, log_scale, eps)
    keep = [c for c in segs.columns if c != x]
    return segs.select(*keep, fn(F.col(x)).alias("_f")).select(*keep, "_f.*")


def over_channels(feats: DataFrame, keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """Mean and population deviation of the ten features over the channels of an epoch."""
    return feats.groupBy(*keys).agg(
        *[F.avg(n).alias(f"{n}_mean") for n in CHANNEL_FEATURES],
        *[F.stddev_pop(n).alias(f"{n}_std") for n in CHANNEL_FEATURES],
    )


def epoch_features(segs: DataFrame, rate: float, nperseg: int, log_scale: bool = True, eps: float = EPS) -> DataFrame:
    return over_channels(channel_features(segs, rate, nperseg, log_scale, eps))


def welch_psd(segs: DataFrame, rate: float, nperseg: int, length: int, x: str = "x") -> DataFrame:
    """One row per (segment, frequency)."""
    nper = min(nperseg, length)
    keep = [c for c in segs.columns if c != x]
    psd = segs.select(*keep, F.posexplode(dsp.welch_udf(rate, nperseg)(F.col(x))).alias("k", "psd"))
    return psd.withColumn("freq", F.col("k") * F.lit(rate) / F.lit(float(nper)))


def band_of(freq: Column) -> Column:
    """The band holding a frequency, null outside all bands."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in BANDS.items():
        out = F.when((freq >= lo) & (freq < hi), F.lit(name)).otherwise(out)
    return out


def band_power(psd: DataFrame, keys: Sequence[str], eps: float = EPS) -> DataFrame:
    """Share of total density per band, one column per band."""
    total = F.sum("psd") + F.lit(eps)
    cols = [
        (F.sum(F.when((F.col("freq") >= lo) & (F.col("freq") < hi), F.col("psd")).otherwise(0.0)) / total).alias(b)
        for b, (lo, hi) in BANDS.items()
    ]
    return psd.groupBy(*keys).agg(*cols)


def band_power_trapz(psd: DataFrame, keys: Sequence[str], eps: float = EPS) -> DataFrame:
    """Trapezoid integral per band over the trapezoid integral of the whole spectrum."""
    w = Window.partitionBy(*keys).orderBy("k")
    prev_f, prev_p = F.lag("freq").over(w), F.lag("psd").over(w)
    area = (F.col("psd") + prev_p) / 2.0 * (F.col("freq") - prev_f)
    parts = psd.select(*keys, "freq", area.alias("_area"), prev_f.alias("_pf"))
    total = F.coalesce(F.sum("_area"), F.lit(0.0)) + F.lit(eps)

    def inside(lo: float, hi: float) -> Column:
        return (F.col("freq") >= lo) & (F.col("freq") < hi) & (F.col("_pf") >= lo) & (F.col("_pf") < hi)

    cols = [
        (F.sum(F.when(inside(lo, hi), F.col("_area")).otherwise(0.0)) / total).alias(b)
        for b, (lo, hi) in BANDS.items()
    ]
    return parts.groupBy(*keys).agg(*cols)


def dominant_band(powers: DataFrame) -> DataFrame:
    """The band of largest power; the first in band order on a tie."""
    best = F.greatest(*[F.col(b) for b in BANDS])
    out = F.lit(None).cast("string")
    for b in reversed(list(BANDS)):
        out = F.when(F.col(b) == best, F.lit(b)).otherwise(out)
    return powers.withColumn("dominant_band", out)


def differences(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First and second differences inside one epoch (keys must include the epoch)."""
    w = Window.partitionBy(*keys).orderBy("idx")
    d1 = F.col("value") - F.lag("value").over(w)
    first = samples.withColumn("d1", d1)
    return first.withColumn("d2", F.col("d1") - F.lag("d1").over(w))


def time_features(samples: DataFrame, keys: Sequence[str], eps: float = EPS) -> DataFrame:
    """Hjorth activity, mobility, complexity, line length and RMS, all by built-ins."""
    v0, v1, v2 = (F.var_pop(c) + F.lit(eps) for c in ("value", "d1", "d2"))
    mobility = F.sqrt(v1 / v0)
    return differences(samples, keys).groupBy(*keys).agg(
        v0.alias("activity"),
        mobility.alias("mobility"),
        (F.sqrt(v2 / v1) / mobility).alias("complexity"),
        F.sum(F.abs("d1")).alias("line_length"),
        F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"),
    )


def stft(segs: DataFrame, length: int, nperseg: int, noverlap: int, boundary: bool = True, x: str = "x") -> DataFrame:
    """One row per (segment, freq_bin, time_bin) with the magnitude."""
    _, size = dsp.stft_frames(length, nperseg, noverlap, boundary)
    frames = (size - nperseg) // (nperseg - noverlap) + 1
    keep = [c for c in segs.columns if c != x]
    flat = segs.select(*keep, F.posexplode(dsp.stft_udf(nperseg, noverlap, boundary)(F.col(x))).alias("_p", "mag"))
    return flat.select(
        *keep,
        F.floor(F.col("_p") / frames).alias("freq_bin"),
        (F.col("_p") % frames).cast("bigint").alias("time_bin"),
        "mag",
    )


def cwt(segs: DataFrame, length: int, scales: Sequence[int], x: str = "x") -> DataFrame:
    """One row per (segment, scale, t) with the Morlet magnitude."""
    scales = [int(s) for s in scales]
    keep = [c for c in segs.columns if c != x]
    rows = segs.select(*keep, F.col(x).cast("array<double>").alias("_x"))
    done = rows.mapInArrow(dsp.cwt_batches(scales), rows.schema)
    flat = done.select(*keep, F.posexplode("_x").alias("_p", "mag"))
    scale = F.element_at(F.array(*[F.lit(s) for s in scales]), F.floor(F.col("_p") / length).cast("int") + 1)
    return flat.select(*keep, scale.cast("bigint").alias("scale"), (F.col("_p") % length).cast("bigint").alias("t"), "mag")


def fir(samples: DataFrame, keys: Sequence[str], taps: Sequence[float], block: int = 4096) -> DataFrame:
    """Zero-phase FIR along ``idx``; zero padding at the ends of a recording and in gaps.

    A recording is cut into blocks. Rows within ``half`` of a border also go to the neighbouring
    block (at most two copies), so each block is filtered alone and a long recording is spread
    over many tasks. Blocks are convolved in Arrow batches.
    """
    half = len(taps) // 2
    block = max(block, 2 * half)
    first, last = F.floor((F.col("idx") - half) / block), F.floor((F.col("idx") + half) / block)
    known = samples.filter(F.col("value").isNotNull())
    spread = known.select(*keys, "idx", "value", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("_b"))
    grouped = spread.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("_s"))
    at, value = F.col("_s.idx").cast("array<bigint>"), F.col("_s.value").cast("array<double>")
    done = grouped.select(*keys, "_b", at.alias("_i"), dsp.fir_udf(list(taps))(at, value).alias("_y"))
    out = done.select(*keys, "_b", F.explode(F.arrays_zip("_i", "_y")).alias("_r"))
    own = F.floor(F.col("_r._i") / block) == F.col("_b")
    return out.filter(own).select(*keys, F.col("_r._i").alias("idx"), F.col("_r._y").alias("value"))
