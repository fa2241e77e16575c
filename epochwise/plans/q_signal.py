"""Spectral and time-domain features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from epochwise.functions import dsp
from epochwise.functions.constants import BANDS, CHANNEL_FEATURES, FEATURES, NEGATIVES_PER_POSITIVE, SEGMENT_RATE
from epochwise.operators import prep, profile, signal
from epochwise.plans.hubs import EPOCH_N, FEATS, NPERSEG, RATE, Hub, add_view, with_views
from epochwise.plans.q_prepare import _FILTERED, TAPS
from epochwise.plans.registry import query

SEG = ["subject", "recording", "epoch", "channel"]
SEG_SQL = ", ".join(SEG)
RAW_LEN = 64
PI = "pi()"


def psd_views(prefix: str, base: str, keys: str, length: int, nperseg: int, rate: float) -> None:
    """SQL views of a Welch spectrum by a plain discrete Fourier sum."""
    nper = min(nperseg, length)
    step = nper - nper // 2
    starts = ", ".join(f"({s})" for s in range(0, length - nper + 1, step))
    win = f"(0.5e0 - 0.5e0 * cos(2 * {PI} * j / {nper}))"
    power = rate * sum(float(v) ** 2 for v in dsp.hann(nper))
    one_sided = f"CASE WHEN k = 0 OR k = {nper // 2 if nper % 2 == 0 else -1} THEN 1 ELSE 2 END"
    add_view(
        f"{prefix}_cut",
        [base],
        f"""SELECT {keys}, st, i - st AS j, x - avg(x) OVER (PARTITION BY {keys}, st) AS x
        FROM {base}, (VALUES {starts}) AS v(st) WHERE i >= st AND i < st + {nper}""",
    )
    add_view(
        f"{prefix}_dft",
        [f"{prefix}_cut"],
        f"""SELECT {keys}, st, k, sum(x * {win} * cos(2 * {PI} * j * k / {nper})) AS re,
        sum(x * {win} * sin(2 * {PI} * j * k / {nper})) AS im
        FROM {prefix}_cut, unnest(generate_series(0, {nper // 2})) AS g(k) GROUP BY {keys}, st, k""",
    )
    add_view(
        prefix,
        [f"{prefix}_dft"],
        f"""SELECT {keys}, k, k * {rate}e0 / {nper} AS freq,
        avg((re * re + im * im) * {one_sided} / {power!r}e0) AS psd FROM {prefix}_dft GROUP BY {keys}, k""",
    )


psd_views("raw_psd", "raw", "id, cls", RAW_LEN, 128, SEGMENT_RATE)


def feature_views(p: str, seg: str, eps: str = "1e-12", log_scale: bool = True) -> None:
    """SQL views from segments to channel and epoch features; their names begin with ``p``."""
    psd_views(f"{p}psd", seg, SEG_SQL, EPOCH_N, NPERSEG, RATE)
    add_view(
        f"{p}bands",
        [f"{p}psd"],
        f"SELECT {SEG_SQL}, "
        + ", ".join(
            f"sum(CASE WHEN freq >= {lo} AND freq < {hi} THEN psd ELSE 0 END) / (sum(psd) + {eps}) AS {b}"
            for b, (lo, hi) in BANDS.items()
        )
        + f" FROM {p}psd GROUP BY {SEG_SQL}",
    )
    add_view(
        f"{p}diffs",
        [seg],
        f"""SELECT *, d1 - lag(d1) OVER w AS d2 FROM (SELECT *, x - lag(x) OVER w AS d1 FROM {seg}
        WINDOW w AS (PARTITION BY {SEG_SQL} ORDER BY i)) WINDOW w AS (PARTITION BY {SEG_SQL} ORDER BY i)""",
    )
    v0, v1, v2 = (f"(var_pop({c}) + {eps})" for c in ("x", "d1", "d2"))
    guard = "0" if log_scale else eps
    add_view(
        f"{p}tdom",
        [f"{p}diffs"],
        f"""SELECT {SEG_SQL}, {v0} AS activity, sqrt({v1} / {v0}) AS mobility,
        sqrt({v2} / {v1}) / (sqrt({v1} / {v0}) + {guard}) AS complexity,
        sum(abs(d1)) AS line_length, sqrt(avg(x * x)) AS rms FROM {p}diffs GROUP BY {SEG_SQL}""",
    )
    scaled = (lambda c: f"ln({c} + {eps})") if log_scale else (lambda c: c)
    add_view(
        f"{p}chfeat",
        [f"{p}bands", f"{p}tdom"],
        f"""SELECT {', '.join('b.' + c for c in SEG)}, delta, theta, alpha, beta, gamma, {scaled('activity')} AS hjorth_activity,
        mobility AS hjorth_mobility, complexity AS hjorth_complexity, {scaled('line_length')} AS line_length,
        {scaled('rms')} AS rms FROM {p}bands b JOIN {p}tdom t ON """
        + " AND ".join(f"b.{c} = t.{c}" for c in SEG),
    )
    add_view(
        f"{p}epfeat",
        [f"{p}chfeat", "annotations"],
        "SELECT subject, recording, epoch, "
        + ", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std" for c in CHANNEL_FEATURES)
        + f""", CAST(coalesce((SELECT max(1) FROM annotations a WHERE a.subject = c.subject AND a.recording = c.recording
        AND c.epoch BETWEEN a.start_s // {EPOCH_N} AND a.end_s // {EPOCH_N}), 0) AS INT) AS y
        FROM {p}chfeat c GROUP BY subject, recording, epoch""",
    )


feature_views("", "seg")
feature_views("plain_", "seg", eps="1e-9", log_scale=False)

# a constant channel, and one that half of the subjects lack
add_view(
    "mixed",
    ["samples", "numbered"],
    """SELECT subject, recording, channel, idx, value FROM samples
    UNION ALL SELECT subject, recording, 'station', idx, CAST(subject AS DOUBLE) FROM numbered
    UNION ALL SELECT subject, recording, 'second', idx, value * value / 100 FROM numbered WHERE CAST(subject AS BIGINT) % 2 = 0""",
)
add_view(
    "mixed_live",
    ["mixed"],
    """SELECT m.* FROM mixed m JOIN (SELECT subject, recording, channel FROM mixed GROUP BY ALL HAVING stddev_pop(value) > 1e-9) l
    ON m.subject = l.subject AND m.recording = l.recording AND m.channel = l.channel""",
)
add_view("mixed_filtered", ["mixed_live"], _FILTERED.replace("FROM samples", "FROM mixed_live"))
add_view(
    "mixed_seg",
    ["mixed_filtered", "full_epochs"],
    f"""SELECT s.subject, s.recording, s.idx // {EPOCH_N} AS epoch, channel, s.idx % {EPOCH_N} AS i, value AS x
    FROM mixed_filtered s JOIN full_epochs f ON s.subject = f.subject AND s.recording = f.recording
    AND s.idx // {EPOCH_N} = f.epoch""",
)
feature_views("mixed_", "mixed_seg")


@query(
    "raw_to_features",
    with_views(
        "mixed_epfeat",
        pos="SELECT subject, sum(y) AS n FROM mixed_epfeat GROUP BY subject",
        ranked="""SELECT e.*, row_number() OVER (PARTITION BY e.subject, y ORDER BY md5('42:' || e.subject || '/' || recording || '/' || epoch)) AS rn,
        p.n FROM mixed_epfeat e JOIN pos p ON p.subject = e.subject""",
    )
    + "SELECT subject, recording, epoch, y, "
    + ", ".join(f"round({c}, 5) AS {c}" for c in FEATURES)
    + f" FROM ranked WHERE y = 1 OR n = 0 OR rn <= {NEGATIVES_PER_POSITIVE} * n",
)
def raw_to_features(t: Hub):
    """From samples with a dead and a partly absent channel to capped feature rows."""
    keys = ["subject", "recording"]
    station = t.numbered.select(*keys, F.lit("station").alias("channel"), "idx", F.col("subject").cast("double").alias("value"))
    second = t.numbered.filter(F.col("subject").cast("bigint") % 2 == 0).select(
        *keys, F.lit("second").alias("channel"), "idx", (F.col("value") * F.col("value") / 100).alias("value")
    )
    samples = t.samples.select(*station.columns).unionByName(station).unionByName(second)
    out = signal.raw_to_features(samples, t.annotations, TAPS, EPOCH_N, RATE, NPERSEG, block=64)
    return out.select("subject", "recording", "epoch", "y", *[F.round(c, 5).alias(c) for c in FEATURES])


@query(
    "epoch_features",
    with_views("epfeat")
    + "SELECT subject, recording, epoch, y, "
    + ", ".join(f"round({c}, 5) AS {c}" for c in FEATURES)
    + " FROM epfeat",
)
def epoch_features(t: Hub):
    return t.features.select(
        "subject", "recording", "epoch", "y", *[F.round(c, 5).alias(c) for c in FEATURES]
    )


@query(
    "epoch_features_raw",
    with_views("plain_epfeat")
    + "SELECT subject, recording, epoch, "
    + ", ".join(f"round({c}, 5) AS {c}" for c in FEATURES)
    + " FROM plain_epfeat",
)
def epoch_features_raw(t: Hub):
    """The second dataset's scaling: activity, line length and RMS are left raw, the guard is 1e-9."""
    out = signal.epoch_features(t.segments, RATE, NPERSEG, log_scale=False, eps=1e-9)
    return out.select("subject", "recording", "epoch", *[F.round(c, 5).alias(c) for c in FEATURES])


@query("welch_psd", with_views("psd") + f"SELECT {SEG_SQL}, k, round(psd, 5) AS psd FROM psd")
def welch_psd(t: Hub):
    out = signal.welch_psd(t.segments, RATE, NPERSEG, EPOCH_N)
    return out.select(*SEG, F.col("k").cast("bigint").alias("k"), F.round("psd", 5).alias("psd"))


@query(
    "band_power",
    with_views("bands") + f"SELECT {SEG_SQL}, " + ", ".join(f"round({b}, 6) AS {b}" for b in BANDS) + " FROM bands",
)
def band_power(t: Hub):
    psd = signal.welch_psd(t.segments, RATE, NPERSEG, EPOCH_N)
    return signal.band_power(psd, SEG).select(*SEG, *[F.round(b, 6).alias(b) for b in BANDS])


add_view(
    "raw_trapz",
    ["raw_psd"],
    "SELECT id, cls, "
    + ", ".join(
        f"""sum(CASE WHEN freq >= {lo} AND freq < {hi} AND pf >= {lo} AND pf < {hi} THEN area ELSE 0 END)
        / (sum(area) + 1e-12) AS {b}"""
        for b, (lo, hi) in BANDS.items()
    )
    + """ FROM (SELECT *, lag(freq) OVER w AS pf, (psd + lag(psd) OVER w) / 2 * (freq - lag(freq) OVER w) AS area
    FROM raw_psd WINDOW w AS (PARTITION BY id ORDER BY k)) GROUP BY id, cls""",
)


def _raw_trapz(t: Hub):
    psd = signal.welch_psd(t.raw_segments, SEGMENT_RATE, 128, RAW_LEN)
    return signal.band_power_trapz(psd, ["id", "cls"])


@query(
    "band_power_trapz",
    with_views("raw_trapz") + "SELECT id, cls, " + ", ".join(f"round({b}, 6) AS {b}" for b in BANDS) + " FROM raw_trapz",
)
def band_power_trapz(t: Hub):
    return _raw_trapz(t).select("id", "cls", *[F.round(b, 6).alias(b) for b in BANDS])


@query(
    "dominant_band",
    with_views("raw_trapz")
    + "SELECT id, cls, CASE "
    + " ".join(f"WHEN {b} = greatest({', '.join(BANDS)}) THEN '{b}'" for b in BANDS)
    + " END AS dominant_band FROM raw_trapz",
)
def dominant_band(t: Hub):
    return signal.dominant_band(_raw_trapz(t)).select("id", "cls", "dominant_band")


def _epoch_samples(t: Hub):
    """Long samples of whole epochs."""
    per = t.segments.select(*SEG, F.posexplode("x").alias("idx", "value"))
    return per


@query(
    "hjorth",
    with_views("tdom")
    + f"""SELECT {SEG_SQL}, round(activity, 5) AS activity, round(mobility, 6) AS mobility,
    round(complexity, 6) AS complexity FROM tdom""",
)
def hjorth(t: Hub):
    out = signal.time_features(_epoch_samples(t), SEG)
    return out.select(
        *SEG,
        F.round("activity", 5).alias("activity"),
        F.round("mobility", 6).alias("mobility"),
        F.round("complexity", 6).alias("complexity"),
    )


@query("line_length", with_views("tdom") + f"SELECT {SEG_SQL}, round(line_length, 6) AS line_length FROM tdom")
def line_length(t: Hub):
    out = signal.time_features(_epoch_samples(t), SEG)
    return out.select(*SEG, F.round("line_length", 6).alias("line_length"))


@query("rms", with_views("tdom") + f"SELECT {SEG_SQL}, round(rms, 6) AS rms FROM tdom")
def rms(t: Hub):
    mean_square = F.avg(F.col("value") * F.col("value"))
    out = _epoch_samples(t).groupBy(*SEG).agg(F.sqrt(mean_square).alias("rms"))
    return out.select(*SEG, F.round("rms", 6).alias("rms"))


def _stft_sql(nperseg: int, noverlap: int) -> str:
    lead, size = dsp.stft_frames(RAW_LEN, nperseg, noverlap, True)
    hop = nperseg - noverlap
    frames = (size - nperseg) // hop + 1
    win = f"(0.5e0 - 0.5e0 * cos(2 * {PI} * j / {nperseg}))"
    cut = f"""SELECT id, f AS time_bin, i + {lead} - f * {hop} AS j, x FROM raw,
    unnest(generate_series(0, {frames - 1})) AS g(f) WHERE i + {lead} >= f * {hop} AND i + {lead} < f * {hop} + {nperseg}"""
    return (
        with_views("raw", cut=cut)
        + f"""SELECT id, k AS freq_bin, time_bin, round(sqrt(power(sum(x * {win} * cos(2 * {PI} * j * k / {nperseg})), 2)
    + power(sum(x * {win} * sin(2 * {PI} * j * k / {nperseg})), 2)) / {nperseg / 2}, 6) AS mag
    FROM cut, unnest(generate_series(0, {nperseg // 2})) AS g(k) GROUP BY id, k, time_bin"""
    )


def _stft(t: Hub, noverlap: int):
    out = signal.stft(t.raw_segments.select("id", "x"), RAW_LEN, 32, noverlap)
    return out.select("id", "freq_bin", "time_bin", F.round("mag", 6).alias("mag"))


@query("stft", _stft_sql(32, 24))
def stft(t: Hub):
    return _stft(t, 24)


@query("stft_image", _stft_sql(32, 16))
def stft_image(t: Hub):
    return _stft(t, 16)


CWT_SCALES = [1, 2, 4]


def _cwt_sql() -> str:
    kernels = dsp.morlet_kernels(CWT_SCALES)
    rows = []
    for s, ker in kernels.items():
        start, _ = dsp.centred(RAW_LEN, len(ker))
        rows += [f"({s}, {m - start}, {float(v)!r}::DOUBLE)" for m, v in enumerate(ker)]
    kern = f"SELECT * FROM (VALUES {', '.join(rows)}) AS v(scale, m, h)"
    # the full convolution at position t + start takes tap m + start with sample t - m
    return (
        with_views("raw", kern=kern)
        + """SELECT id, CAST(scale AS BIGINT) AS scale, CAST(i + m AS BIGINT) AS t, round(abs(sum(x * h)), 6) AS mag
    FROM raw, kern WHERE i + m BETWEEN 0 AND 63 GROUP BY id, scale, i + m"""
    )


@query("cwt", _cwt_sql())
def cwt(t: Hub):
    out = signal.cwt(t.raw_segments.select("id", "x"), RAW_LEN, CWT_SCALES)
    return out.select("id", "scale", "t", F.round("mag", 6).alias("mag"))


def _cwt_energy_sql(scales: int = 63) -> str:
    """The kernels by their rule: the wavelet's running sum on a grid, picked at each scale's places and differenced."""
    step = float(np.linspace(-8.0, 8.0, 1024)[1] + 8.0)
    return (
        with_views(
            "raw",
            prim=f"""SELECT j, sum(exp(-x * x / 2) * cos(5 * x)) OVER (ORDER BY j) * {step!r}e0 AS p
            FROM (SELECT j, -8.0e0 + j * {step!r}e0 AS x FROM generate_series(0, 1023) AS g(j))""",
            pick=f"""SELECT s, k, CAST(floor(k / (s * {step!r}e0)) AS BIGINT) AS j, count(*) OVER (PARTITION BY s) AS n
            FROM generate_series(1, {scales}) AS a(s), unnest(generate_series(0, 16 * s)) AS b(k) WHERE floor(k / (s * {step!r}e0)) < 1024""",
            stretched="SELECT s, n, n - 1 - k AS m, p FROM pick JOIN prim ON pick.j = prim.j",
            kern="""SELECT s, m - CAST(floor((n - 2) / 2.0e0) AS BIGINT) - 1 AS m, -sqrt(s) * d AS h FROM (
            SELECT s, n, m, p - coalesce(lag(p) OVER (PARTITION BY s ORDER BY m), 0) AS d FROM stretched
            UNION ALL SELECT s, n, n, -p FROM stretched WHERE m = n - 1)""",
            mag="""SELECT id, s, i + m AS t, sum(x * h) AS v FROM raw JOIN kern ON i + m BETWEEN 0 AND 63 AND m BETWEEN -63 AND 63
            GROUP BY id, s, i + m""",
        )
        + "SELECT id, CAST(s AS BIGINT) AS scale, round(sum(v * v) / 64, 6) AS energy FROM mag GROUP BY id, s"
    )


@query("cwt_all_scales", _cwt_energy_sql())
def cwt_all_scales(t: Hub):
    """All 63 scales, reduced to energy per scale."""
    out = signal.cwt(t.raw_segments.select("id", "x"), RAW_LEN, range(1, 64))
    return out.groupBy("id", "scale").agg(F.round(F.avg(F.col("mag") * F.col("mag")), 6).alias("energy"))


@query(
    "histogram",
    with_views("emb_long", r="SELECT feature, min(value) AS lo, max(value) AS hi FROM emb_long GROUP BY feature")
    + """SELECT feature, y, bin, n, round(n / (sum(n) OVER (PARTITION BY feature, y) * width), 6) AS density FROM (
    SELECT e.feature, y, least(CAST(floor((value - lo) / ((hi - lo) / 40)) AS BIGINT), 39) AS bin, count(*) AS n,
    max((hi - lo) / 40) AS width FROM emb_long e JOIN r ON e.feature = r.feature GROUP BY ALL)""",
)
def histogram(t: Hub):
    out = profile.column_histogram(t.emb, FEATS, 40)
    return out.select("feature", "y", "bin", "n", F.round("density", 6).alias("density"))


@query(
    "before_after_scaling",
    with_views("emb_long", m="SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM emb_long GROUP BY feature")
    + """SELECT e.feature, round(min(value), 5) AS raw_lo, round(max(value), 5) AS raw_hi, round(avg(value), 5) AS raw_mean,
    round(stddev_pop(value), 5) AS raw_sd, round(min((value - m) / s), 5) AS scaled_lo, round(max((value - m) / s), 5) AS scaled_hi,
    abs(round(avg((value - m) / s), 5)) AS scaled_mean, round(stddev_pop((value - m) / s), 5) AS scaled_sd
    FROM emb_long e JOIN m ON e.feature = m.feature GROUP BY e.feature""",
)
def before_after_scaling(t: Hub):
    """Raw against standardised columns: one aggregate gives the moments, another both sides' ranges and spreads."""
    found = t.emb.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in FEATS]).first()
    both = t.emb.select(*FEATS, *[((F.col(c) - found[c]["m"]) / found[c]["s"]).alias(f"{c}_z") for c in FEATS])
    parts = {"lo": F.min, "hi": F.max, "mean": F.avg, "sd": F.stddev_pop}
    wide = both.agg(*[fn(f"{c}{z}").alias(f"{c}{z}_{p}") for c in FEATS for z in ("", "_z") for p, fn in parts.items()])
    side = lambda c, z, name: [F.round(F.col(f"{c}{z}_{p}"), 5).alias(f"{name}_{p}") for p in parts]
    out = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), *side(c, "", "raw"), *side(c, "_z", "scaled")) for c in FEATS])))
    return out.withColumn("scaled_mean", F.abs("scaled_mean"))


@query(
    "band_by_class",
    with_views("epfeat")
    + "SELECT y, count(*) AS n, "
    + ", ".join(f"round(avg({b}_mean), 6) AS {b}" for b in BANDS)
    + " FROM epfeat GROUP BY y",
)
def band_by_class(t: Hub):
    return t.features.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"{b}_mean"), 6).alias(b) for b in BANDS]
    )


@query(
    "before_after",
    with_views("samples", filtered=_FILTERED)
    + """SELECT channel, count(*) AS n, round(avg(raw), 5) AS raw_mean, round(stddev_pop(raw), 5) AS raw_sd,
    round(avg(value), 5) AS filtered_mean, round(stddev_pop(value), 5) AS filtered_sd FROM filtered GROUP BY channel""",
)
def before_after(t: Hub):
    keys = ["subject", "recording", "channel"]
    after = signal.fir(t.samples, keys, TAPS, block=64).withColumnRenamed("value", "filtered")
    both = t.samples.join(after, [*keys, "idx"])
    return both.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("value"), 5).alias("raw_mean"),
        F.round(F.stddev_pop("value"), 5).alias("raw_sd"),
        F.round(F.avg("filtered"), 5).alias("filtered_mean"),
        F.round(F.stddev_pop("filtered"), 5).alias("filtered_sd"),
    )
