"""Scans, preprocessing and labelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise import session
from epochwise.functions import dsp
from epochwise.functions.constants import FEATURES
from epochwise.operators import folds, ordering, prep
from epochwise.plans.hubs import EPOCH_N, FEATS, Hub, with_views
from epochwise.plans.registry import query
from epochwise.sources import ingest
from epochwise.sources import samples as src

HOURS8 = 28800
REC = ["subject", "recording"]
H = "md5('42:' || CAST({} AS VARCHAR))"


@query(
    "scan_samples",
    with_views("samples")
    + """SELECT channel, count(*) AS n, count(DISTINCT subject) AS subjects, round(sum(value), 4) AS total,
    round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM samples GROUP BY channel""",
)
def scan_samples(t: Hub):
    # the index is not needed here, so the scan goes without numbering
    long = prep.to_long(t.wide, ["subject", "recording"], ["value", "k", "minute"])
    return long.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("subject").alias("subjects"),
        F.round(F.sum("value"), 4).alias("total"),
        F.round(F.min("value"), 6).alias("lo"),
        F.round(F.max("value"), 6).alias("hi"),
    )


@query(
    "ingest_samples",
    with_views("samples")
    + """SELECT channel, count(*) AS n, count(DISTINCT subject) AS subjects, round(sum(value), 4) AS total,
    round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM samples GROUP BY channel""",
)
def ingest_samples(t: Hub):
    """Samples written as files, validated against the ledger and read back; a second validation finds nothing new."""
    folder, ledger = session.scratch_path(t.spark, "samples"), session.scratch_path(t.spark, "ingest-ledger")
    t.samples.select(*[F.col(f.name).cast(f.dataType) for f in src.SAMPLES.fields]).write.parquet(folder)
    rows = ingest.read_samples(t.spark, folder, ledger)
    again = ingest.validate(t.spark, folder, ledger)
    if again:
        raise RuntimeError(f"{again} files were validated twice")
    return rows.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("subject").alias("subjects"),
        F.round(F.sum("value"), 4).alias("total"),
        F.round(F.min("value"), 6).alias("lo"),
        F.round(F.max("value"), 6).alias("hi"),
    )


@query(
    "scan_segments",
    with_views("raw")
    + """SELECT id, cls, CAST(cls = 1 AS INT) AS y, count(*) AS n, round(sum(x), 6) AS total,
    round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM raw GROUP BY id, cls""",
)
def scan_segments(t: Hub):
    seg = src.as_segments(t.raw_segments, positive=1)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return seg.select(
        "id",
        "cls",
        "y",
        F.size("x").cast("bigint").alias("n"),
        F.round(total, 6).alias("total"),
        F.round(F.array_min("x"), 6).alias("lo"),
        F.round(F.array_max("x"), 6).alias("hi"),
    )


_WITH_DEAD = """SELECT subject, recording, channel, value FROM samples
UNION ALL SELECT subject, recording, 'station', CAST(subject AS DOUBLE) FROM numbered"""


@query(
    "dead_channels",
    with_views("samples", all_ch=_WITH_DEAD)
    + """SELECT channel, count(*) AS recordings, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT subject, recording, channel, count(*) AS n FROM all_ch GROUP BY ALL HAVING stddev_pop(value) > 1e-9)
    GROUP BY channel""",
)
def dead_channels(t: Hub):
    wide = t.wide.withColumn("station", F.col("subject").cast("double"))
    long = prep.to_long(wide, REC, ["value", "k", "minute", "station"])
    live = prep.drop_dead_channels(long)
    per = live.groupBy(*REC, "channel").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("channel").agg(F.count(F.lit(1)).alias("recordings"), F.sum("n").alias("n"))


TAPS = dsp.bandpass_taps(5, 2.0, 20.0, 60.0)
_FIR_SQL = " + ".join(
    f"({tap!r}e0) * coalesce({'lag' if k < 0 else 'lead'}(value, {abs(k)}) OVER w, 0.0e0)"
    if "e" not in repr(tap)
    else f"({tap!r}) * coalesce({'lag' if k < 0 else 'lead'}(value, {abs(k)}) OVER w, 0.0e0)"
    for k, tap in zip(range(-5, 6), TAPS)
)
_FILTERED = f"""SELECT subject, recording, channel, idx, value AS raw, {_FIR_SQL} AS value FROM samples
WINDOW w AS (PARTITION BY subject, recording, channel ORDER BY idx)"""
KEYS_CH = [*REC, "channel"]


@query(
    "bandpass",
    with_views("samples", filtered=_FILTERED)
    + "SELECT subject, recording, channel, idx, round(value, 6) AS value FROM filtered",
)
def bandpass(t: Hub):
    from epochwise.operators import signal

    out = signal.fir(t.samples, KEYS_CH, TAPS, block=64)
    return out.select(*KEYS_CH, "idx", F.round("value", 6).alias("value"))


WIDE_TAPS = dsp.bandpass_taps(128, 0.5, 40.0, 256.0)


@query(
    "bandpass_wide",
    with_views(
        "samples",
        kern=f"SELECT unnest([{', '.join(repr(v) if 'e' in repr(v) else repr(v) + 'e0' for v in WIDE_TAPS)}]) AS h, unnest(generate_series(-128, 128)) AS k",
        conv="""SELECT s.subject, s.recording, s.channel, s.idx + kern.k AS idx, sum(s.value * kern.h) AS v FROM samples s, kern GROUP BY ALL""",
    )
    + """SELECT s.channel, s.recording, s.subject, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(min(v), 6) AS lo,
    round(max(v), 6) AS hi FROM samples s JOIN conv c ON s.subject = c.subject AND s.recording = c.recording AND s.channel = c.channel
    AND s.idx = c.idx GROUP BY ALL""",
)
def bandpass_wide(t: Hub):
    """The published band, 0.5 to 40 Hz at 256 samples a second, with 257 taps; figures per recording and channel."""
    from epochwise.operators import signal

    out = signal.fir(t.samples, KEYS_CH, WIDE_TAPS, block=1024)
    return out.groupBy(*KEYS_CH).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_pop("value"), 6).alias("sd"),
        F.round(F.min("value"), 6).alias("lo"),
        F.round(F.max("value"), 6).alias("hi"),
    )


@query(
    "resample",
    with_views("samples", filtered=_FILTERED)
    + """SELECT subject, recording, channel, idx // 2 AS idx, round(avg(value), 6) AS value FROM filtered
    GROUP BY subject, recording, channel, idx // 2 HAVING count(*) = 2""",
)
def resample(t: Hub):
    """After the band-pass, as its purpose asks."""
    from epochwise.operators import signal

    out = prep.resample(signal.fir(t.samples, KEYS_CH, TAPS, block=64), KEYS_CH, 2)
    return out.select(*KEYS_CH, "idx", F.round("value", 6).alias("value"))


@query(
    "epochs",
    with_views("numbered")
    + f"""SELECT subject, recording, idx // {EPOCH_N} AS epoch, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx
    FROM numbered GROUP BY ALL HAVING count(*) = {EPOCH_N}""",
)
def epochs(t: Hub):
    return prep.full_epochs(t.numbered, REC, EPOCH_N).withColumnRenamed("rows", "n")


@query(
    "epochs_lose_last",
    with_views("numbered")
    + f"""SELECT e.subject, e.recording, epoch, n FROM (
    SELECT subject, recording, idx // {EPOCH_N} AS epoch, count(*) AS n FROM numbered
    GROUP BY ALL HAVING count(*) = {EPOCH_N}) e
    JOIN (SELECT subject, recording, count(*) AS len FROM numbered GROUP BY ALL) l
    ON e.subject = l.subject AND e.recording = l.recording WHERE epoch * {EPOCH_N} < len - {EPOCH_N}""",
)
def epochs_lose_last(t: Hub):
    out = prep.full_epochs(t.numbered, REC, EPOCH_N, lose_last=True)
    return out.select(*REC, "epoch", F.col("rows").alias("n"))


# labelling on a time grid: eight-hour epochs, two-hour intervals, in whole seconds
_GRID = f"SELECT DISTINCT subject, recording, off_s // {HOURS8} AS epoch FROM wide"
_IVL = """SELECT subject, recording, off_s AS start_s, off_s + 7200 AS end_s FROM wide
WHERE event_type = 'error' AND value > 150"""


def _grid(t: Hub):
    return t.wide.select(*REC, F.floor(F.col("off_s") / HOURS8).alias("epoch")).distinct()


def _intervals(t: Hub):
    hit = (F.col("event_type") == "error") & (F.col("value") > 150)
    return t.wide.filter(hit).select(
        *REC, F.col("off_s").alias("start_s"), (F.col("off_s") + 7200).alias("end_s")
    )


@query(
    "label_index",
    with_views("wide", grid=_GRID, ivl=_IVL)
    + f"""SELECT g.subject, g.recording, g.epoch, CAST(coalesce(max(CASE WHEN i.start_s IS NOT NULL THEN 1 END), 0) AS INT) AS y
    FROM grid g LEFT JOIN ivl i ON g.subject = i.subject AND g.recording = i.recording
    AND g.epoch BETWEEN i.start_s // {HOURS8} AND i.end_s // {HOURS8} GROUP BY ALL""",
)
def label_index(t: Hub):
    return prep.label_by_index(_grid(t), _intervals(t), HOURS8)


@query(
    "label_overlap",
    with_views("wide", grid=_GRID, ivl=_IVL)
    + f"""SELECT g.subject, g.recording, g.epoch, CAST(coalesce(max(CASE WHEN i.start_s IS NOT NULL THEN 1 END), 0) AS INT) AS y
    FROM grid g LEFT JOIN ivl i ON g.subject = i.subject AND g.recording = i.recording
    AND g.epoch * {HOURS8} < i.end_s AND (g.epoch + 1) * {HOURS8} > i.start_s GROUP BY ALL""",
)
def label_overlap(t: Hub):
    return prep.label_by_overlap(_grid(t), _intervals(t), HOURS8)


# rows with an id, a subject and a label: every event is one row, an ``error`` is positive
_ROWS = """SELECT event_id AS id, CAST(user_id AS VARCHAR) AS subject,
CAST(event_type = 'error' AND value > 100 AS INT) AS y FROM events"""


def _rows(t: Hub):
    y = ((F.col("event_type") == "error") & (F.col("value") > 100)).cast("int")
    return t.table("events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("subject"), y.alias("y")
    )


@query(
    "neg_cap",
    with_views(
        rows_=_ROWS,
        r=f"""SELECT *, row_number() OVER (PARTITION BY subject, y ORDER BY {H.format('id')}, id) AS rn,
        sum(y) OVER (PARTITION BY subject) AS pos FROM rows_""",
    )
    + "SELECT id, subject, y FROM r WHERE y = 1 OR pos = 0 OR rn <= 8 * pos",
)
def neg_cap(t: Hub):
    return prep.cap_negatives(_rows(t), "id")


_RECS = """SELECT CAST(user_id AS VARCHAR) AS subject, CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%d') AS recording,
CAST(sum(CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM events GROUP BY 1, 2"""


def _recordings(t: Hub):
    hit = (F.col("event_type") == "error") & (F.col("value") > 100)
    subject = F.col("user_id").cast("string")
    return t.table("events").groupBy(
        subject.alias("subject"), F.concat(subject, F.lit("_"), F.date_format("ts", "dd")).alias("recording")
    ).agg(F.sum(hit.cast("bigint")).alias("positives"))


@query(
    "file_cap",
    with_views(recs=_RECS)
    + f"""SELECT subject, recording, positives FROM (SELECT *, row_number() OVER (PARTITION BY subject, positives > 0
    ORDER BY {H.format('recording')}, recording) AS rn FROM recs) WHERE positives > 0 OR rn <= 2""",
)
def file_cap(t: Hub):
    return prep.cap_files(_recordings(t))


@query(
    "usable_subjects",
    with_views(rows_=_ROWS)
    + """SELECT subject, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM rows_
    GROUP BY subject HAVING sum(y) > 0""",
)
def usable_subjects(t: Hub):
    kept = prep.with_positives(_rows(t))
    return kept.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


@query(
    "balanced_sample",
    with_views(
        rows_=_ROWS,
        r=f"SELECT *, row_number() OVER (PARTITION BY y ORDER BY {H.format('id')}, id) AS rn FROM rows_",
        m="SELECT min(n) AS m FROM (SELECT y, count(*) AS n FROM rows_ GROUP BY y)",
    )
    + "SELECT id, subject, y FROM r, m WHERE rn <= m",
)
def balanced_sample(t: Hub):
    return prep.balance(_rows(t), "id")


@query(
    "seed_sample",
    with_views(
        rows_=_ROWS,
        r=f"SELECT *, row_number() OVER (PARTITION BY y ORDER BY {H.format('id')}, id) AS rn FROM rows_",
    )
    + "SELECT id, subject, y FROM r WHERE rn <= 75",
)
def seed_sample(t: Hub):
    return prep.balance(_rows(t), "id", per_class=75)


@query(
    "holdout",
    with_views(
        rows_=_ROWS,
        r=f"""SELECT *, row_number() OVER (PARTITION BY y ORDER BY {H.format('id')}, id) AS rn,
        count(*) OVER (PARTITION BY y) AS n FROM rows_""",
    )
    + "SELECT id, y, CAST(rn <= round(n * 0.2e0) AS INT) AS is_test FROM r",
)
def holdout(t: Hub):
    return folds.holdout(_rows(t), "id", 0.2).select("id", "y", "is_test")


@query(
    "kfold",
    with_views(rows_=_ROWS)
    + f"""SELECT id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {H.format('id')}, id) - 1) % 5 AS INT) AS fold
    FROM rows_""",
)
def kfold(t: Hub):
    return folds.stratified_kfold(_rows(t), "id", 5).select("id", "y", "fold")


@query(
    "logo_folds",
    with_views(rows_=_ROWS)
    + """SELECT id, subject, CAST(dense_rank() OVER (ORDER BY subject) - 1 AS INT) AS fold FROM rows_""",
)
def logo_folds(t: Hub):
    return folds.leave_one_group_out(_rows(t)).select("id", "subject", "fold")


@query(
    "train_cap",
    with_views(rows_=_ROWS)
    + f"""SELECT id, subject, y FROM (SELECT *, row_number() OVER (ORDER BY {H.format('id')}, id) AS rn FROM rows_)
    WHERE rn <= 4000""",
)
def train_cap(t: Hub):
    return prep.cap_rows(_rows(t), [], "id", 4000)


@query(
    "binarize",
    with_views("scored")
    + """SELECT model, protocol, id, y, CAST(p >= 0.5e0 AS INT) AS pred, CAST(lang = 'en' AS INT) AS is_en FROM scored""",
)
def binarize(t: Hub):
    return t.scored.select(
        "model",
        "protocol",
        "id",
        "y",
        (F.col("p") >= 0.5).cast("int").alias("pred"),
        (F.col("lang") == "en").cast("int").alias("is_en"),
    )


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "onehot",
    "SELECT event_id AS id, "
    + ", ".join(f"CAST(event_type = '{c}' AS INT) AS is_{c}" for c in EVENT_TYPES)
    + " FROM events",
)
def onehot(t: Hub):
    return t.table("events").select(
        F.col("event_id").alias("id"), *prep.one_hot("event_type", EVENT_TYPES, "is_")
    )


def _per_fold(kind: str) -> str:
    """SQL: each row scaled by statistics of the rows of all other subjects."""
    aggs = []
    for c in FEATS:
        if kind == "standard":
            aggs += [f"avg(o.{c}) AS a_{c}", f"stddev_pop(o.{c}) AS b_{c}"]
        else:
            aggs += [f"min(o.{c}) AS a_{c}", f"max(o.{c}) - min(o.{c}) AS b_{c}"]
    stats = f"""SELECT s.subject, {', '.join(aggs)} FROM (SELECT DISTINCT subject FROM emb) s
    JOIN emb o ON o.subject <> s.subject GROUP BY s.subject"""
    cols = ", ".join(f"round((e.{c} - a_{c}) / CASE WHEN b_{c} = 0 THEN 1 ELSE b_{c} END, 6) AS {c}" for c in FEATS)
    return with_views("emb", st=stats) + f"SELECT e.id, e.subject, {cols} FROM emb e JOIN st ON e.subject = st.subject"


@query("standardize_fold", _per_fold("standard"))
def standardize_fold(t: Hub):
    scaled = folds.scale_held_out(t.emb, "subject", FEATS, "standard")
    return scaled.select("id", "subject", *[F.round(c, 6).alias(c) for c in FEATS])


@query("minmax_fold", _per_fold("minmax"))
def minmax_fold(t: Hub):
    scaled = folds.scale_held_out(t.emb, "subject", FEATS, "minmax")
    return scaled.select("id", "subject", *[F.round(c, 6).alias(c) for c in FEATS])


@query(
    "class_weights",
    with_views("emb")
    + """SELECT s.subject AS fold, o.y, count(*) AS n_class,
    round(sum(count(*)) OVER (PARTITION BY s.subject) / (2.0e0 * count(*)), 6) AS weight
    FROM (SELECT DISTINCT subject FROM emb) s JOIN emb o ON o.subject <> s.subject GROUP BY s.subject, o.y""",
)
def class_weights(t: Hub):
    w = folds.class_weights(t.emb, "subject")
    return w.select(F.col("subject").alias("fold"), "y", "n_class", F.round("weight", 6).alias("weight"))


@query(
    "log_features",
    "SELECT event_id AS id, round(ln(value + 1e-12), 6) AS value FROM events",
)
def log_features(t: Hub):
    logged = prep.log_scale(["value"])[0]
    return t.table("events").select(F.col("event_id").alias("id"), F.round(logged, 6).alias("value"))


@query(
    "tensor_zscore",
    with_views("emb_long", s="SELECT avg(value) AS m, stddev_pop(value) AS s FROM emb_long")
    + """SELECT id, feature, round((value - m) / (s + 1e-6), 6) AS value FROM emb_long, s""",
)
def tensor_zscore(t: Hub):
    from epochwise.functions.exprs import stack_columns

    long = t.emb.select("id", stack_columns(FEATS))
    out = prep.tensor_zscore(long, "value")
    return out.select("id", "feature", F.round("value", 6).alias("value"))


@query(
    "column_zscore",
    with_views("emb_long", s="SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM emb_long GROUP BY feature")
    + """SELECT id, e.feature, round((value - m) / (s.s + 1e-6), 6) AS value FROM emb_long e JOIN s ON e.feature = s.feature""",
)
def column_zscore(t: Hub):
    stats = t.emb.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATS], *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATS])
    # one row of statistics
    joined = t.emb.join(F.broadcast(stats))
    from epochwise.functions.exprs import stack_columns

    scaled = joined.select("id", *[((F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-6)).alias(c) for c in FEATS])
    return scaled.select("id", stack_columns(FEATS)).select("id", "feature", F.round("value", 6).alias("value"))
