"""Event-level evaluation, smoothing, audits, extra folds and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.operators import compare, evaluate, events, folds, prep, profile, signal
from epochwise.plans import q_signal  # noqa: F401  its SQL views are used here
from epochwise.plans.hubs import CHANNELS, EPOCH_N, FEATS, NPERSEG, RATE, Hub, add_view, with_views
from epochwise.plans.q_evaluate import counts_sql
from epochwise.plans.q_prepare import _GRID, _IVL, HOURS8, _grid, _intervals
from epochwise.plans.registry import query

REC = ["subject", "recording"]
SEG = [*REC, "epoch", "channel"]
SEG_SQL = ", ".join(SEG)

# a detector on the eight-hour grid: positive when an epoch holds a value above 120
add_view("grid", ["wide"], _GRID)
add_view("ivl", ["wide"], _IVL)
add_view(
    "pred",
    ["wide"],
    f"""SELECT subject, recording, off_s // {HOURS8} AS epoch, CAST(max(value) > 120 AS INT) AS pred
    FROM wide GROUP BY 1, 2, 3""",
)
add_view(
    "truth",
    ["grid", "ivl"],
    f"""SELECT g.subject, g.recording, g.epoch, CAST(coalesce(max(CASE WHEN i.start_s IS NOT NULL THEN 1 END), 0) AS INT) AS y
    FROM grid g LEFT JOIN ivl i ON g.subject = i.subject AND g.recording = i.recording
    AND g.epoch * {HOURS8} < i.end_s AND (g.epoch + 1) * {HOURS8} > i.start_s GROUP BY ALL""",
)
add_view(
    "runs",
    ["pred"],
    """SELECT subject, recording, min(epoch) AS first_epoch, max(epoch) AS last_epoch, count(*) AS epochs FROM (
    SELECT *, epoch - row_number() OVER (PARTITION BY subject, recording ORDER BY epoch) AS g FROM pred WHERE pred = 1)
    GROUP BY subject, recording, g""",
)


def pred_frame(t: Hub):
    return t.wide.groupBy(*REC, F.floor(F.col("off_s") / HOURS8).alias("epoch")).agg(
        (F.max("value") > 120).cast("int").alias("pred")
    )


def truth_frame(t: Hub):
    return prep.label_by_overlap(_grid(t), _intervals(t), HOURS8)


@query(
    "smoothing",
    with_views("pred")
    + """SELECT subject, recording, epoch, pred, CAST(sum(pred) OVER w AS BIGINT) AS hits, CAST(sum(pred) OVER w >= 2 AS INT) AS alarm
    FROM pred WINDOW w AS (PARTITION BY subject, recording ORDER BY epoch RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)""",
)
def smoothing(t: Hub):
    return events.smooth_k_of_n(pred_frame(t), k=2, n=12, block=64)


@query("islands", with_views("runs") + "SELECT * FROM runs")
def islands(t: Hub):
    return events.islands(pred_frame(t), block=64)


add_view(
    "found",
    ["ivl", "pred"],
    f"""SELECT i.subject, i.recording, start_s, end_s, CAST(count(p.epoch) > 0 AS INT) AS detected,
    greatest(min(p.epoch) * {HOURS8} - start_s, 0) AS lat FROM (SELECT DISTINCT * FROM ivl) i LEFT JOIN pred p ON i.subject = p.subject
    AND i.recording = p.recording AND p.pred = 1 AND p.epoch * {HOURS8} < i.end_s AND (p.epoch + 1) * {HOURS8} > i.start_s
    GROUP BY i.subject, i.recording, start_s, end_s""",
)


@query(
    "detection_latency",
    with_views("found")
    + "SELECT subject, recording, start_s, end_s, detected, CASE WHEN detected = 1 THEN lat END AS latency_s FROM found",
)
def detection_latency(t: Hub):
    out = events.detections(_intervals(t), pred_frame(t), HOURS8)
    return out.withColumn("latency_s", F.when(F.col("detected") == 1, F.col("latency_s")))


@query(
    "event_sensitivity",
    with_views("found")
    + """SELECT subject, count(*) AS events, CAST(sum(detected) AS BIGINT) AS detected,
    round(avg(detected), 6) AS event_sensitivity FROM found GROUP BY subject""",
)
def event_sensitivity(t: Hub):
    out = events.event_sensitivity(events.detections(_intervals(t), pred_frame(t), HOURS8))
    return out.select("subject", "events", "detected", F.round("event_sensitivity", 6).alias("event_sensitivity"))


@query(
    "false_alarms",
    with_views(
        "runs",
        "truth",
        judged="""SELECT r.subject, r.recording, first_epoch, max(coalesce(y, 0)) AS hit FROM runs r LEFT JOIN truth t
        ON r.subject = t.subject AND r.recording = t.recording AND t.epoch BETWEEN first_epoch AND last_epoch GROUP BY ALL""",
        fa="SELECT subject, count(*) AS alarms, CAST(sum(1 - hit) AS BIGINT) AS false_alarms FROM judged GROUP BY subject",
        hrs="SELECT subject, count(*) * 8.0e0 AS hours FROM truth GROUP BY subject",
    )
    + """SELECT h.subject, coalesce(alarms, 0) AS alarms, coalesce(false_alarms, 0) AS false_alarms, hours,
    round(coalesce(false_alarms, 0) / hours, 6) AS per_hour FROM hrs h LEFT JOIN fa f ON h.subject = f.subject""",
)
def false_alarms(t: Hub):
    runs = events.islands(pred_frame(t), block=64)
    out = events.false_alarms_per_hour(runs, truth_frame(t), HOURS8)
    return out.withColumn("per_hour", F.round("per_hour", 6))


@query(
    "sliding_epochs",
    with_views("samples")
    + """SELECT subject, recording, channel, e AS epoch, count(*) AS n, round(avg(value), 6) AS mean,
    round(stddev_pop(value), 6) AS sd FROM samples, unnest(generate_series(0, 100000)) AS g(e)
    WHERE idx >= e * 6 AND idx < e * 6 + 24 AND e <= idx // 6 GROUP BY ALL HAVING count(*) = 24""".replace(
        "unnest(generate_series(0, 100000)) AS g(e)",
        "LATERAL (SELECT unnest(generate_series(greatest(0, (idx - 24) // 6), idx // 6)) AS e) g",
    ),
)
def sliding_epochs(t: Hub):
    """75 % overlap: 24 samples every 6."""
    out = events.sliding_epochs(t.samples, [*REC, "channel"], 24, 6)
    return out.select(*REC, "channel", "epoch", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


_GF = "CAST(CAST('0x' || substr(md5('42:' || CAST({} AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS INT)"


@query("group_kfold", f"SELECT event_id AS id, CAST(user_id AS VARCHAR) AS subject, {_GF.format('user_id')} AS fold FROM events")
def group_kfold(t: Hub):
    rows = t.table("events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("subject"))
    return folds.group_kfold(rows, 5)


@query(
    "leave_recording_out",
    with_views("wide")
    + f"""SELECT event_id AS id, subject || '_' || CAST(off_s // 86400 AS VARCHAR) AS rec,
    {_GF.format("subject || '_' || CAST(off_s // 86400 AS VARCHAR)")} AS fold FROM wide""",
)
def leave_recording_out(t: Hub):
    """Recordings are user days; a recording never spans two folds."""
    rec = F.concat("subject", F.lit("_"), F.floor(F.col("off_s") / 86400).cast("string"))
    return folds.group_kfold(t.wide.select(F.col("event_id").alias("id"), rec.alias("rec")), 5, group="rec")


@query(
    "mcnemar",
    with_views("scored_wide", a="SELECT y, CAST(rf >= 0.5 AS INT) AS a, CAST(lr >= 0.5 AS INT) AS b FROM scored_wide")
    + """SELECT only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 0 ELSE
    power(greatest(abs(only_a - only_b) - 1, 0), 2) / CAST(only_a + only_b AS DOUBLE) END, 6) AS chi2 FROM (
    SELECT CAST(sum(CASE WHEN a = y AND b <> y THEN 1 ELSE 0 END) AS BIGINT) AS only_a,
    CAST(sum(CASE WHEN a <> y AND b = y THEN 1 ELSE 0 END) AS BIGINT) AS only_b FROM a)""",
)
def mcnemar(t: Hub):
    pairs = t.scored_wide.select("y", (F.col("rf") >= 0.5).cast("int").alias("a"), (F.col("lr") >= 0.5).cast("int").alias("b"))
    return compare.mcnemar(pairs, []).select("only_a", "only_b", F.round("chi2", 6).alias("chi2"))


@query(
    "cohens_d",
    with_views("auc_diffs")
    + """SELECT model, protocol, count(*) AS n, round(avg(d) / stddev_samp(d), 5) AS cohens_d FROM auc_diffs GROUP BY model, protocol""",
)
def cohens_d(t: Hub):
    auc = evaluate.roc_auc(t.scored, ["model", "protocol", "subject"]).filter("auc IS NOT NULL")
    out = compare.cohens_d(compare.paired(auc, ["protocol"], value="auc"), ["model", "protocol"])
    return out.withColumn("cohens_d", F.round("cohens_d", 5))


@query(
    "paired_bootstrap",
    with_views(
        "auc_diffs",
        v="""SELECT model, protocol, d AS v, row_number() OVER (PARTITION BY model, protocol ORDER BY subject) - 1 AS j,
        count(*) OVER (PARTITION BY model, protocol) AS n FROM auc_diffs""",
        dr="""SELECT model, protocol, b, CAST('0x' || substr(md5('7:' || CAST(b AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 8)
        AS BIGINT) % n AS j FROM v, unnest(generate_series(0, 1999)) AS g(b)""",
        m="""SELECT dr.model, dr.protocol, b, avg(v.v) AS m FROM dr JOIN v ON dr.model = v.model AND dr.protocol = v.protocol
        AND dr.j = v.j GROUP BY ALL""",
    )
    + """SELECT model, protocol, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi
    FROM m GROUP BY model, protocol""",
)
def paired_bootstrap(t: Hub):
    auc = evaluate.roc_auc(t.scored, ["model", "protocol", "subject"]).filter("auc IS NOT NULL")
    diffs = compare.paired(auc, ["protocol"], value="auc")
    out = compare.bootstrap(diffs, ["model", "protocol"], value="d", seed="7")
    return out.select("model", "protocol", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(
    "recording_audit",
    with_views("samples")
    + f"""SELECT subject, recording, count(*) AS samples, count(DISTINCT channel) AS channels,
    round((max(idx) + 1) / {RATE}e0, 6) AS duration_s FROM samples GROUP BY subject, recording""",
)
def recording_audit(t: Hub):
    out = events.recording_audit(t.samples, RATE)
    return out.withColumn("duration_s", F.round("duration_s", 6))


_SPLITS = f"""SELECT DISTINCT CAST(user_id AS VARCHAR) AS subject, CASE WHEN {_GF.format('user_id')} < 3 THEN 'train'
WHEN {_GF.format('user_id')} = 3 THEN 'validation' ELSE 'test' END AS split FROM events"""


def splits_frame(t: Hub):
    """Subject, split: a clean assignment by subject."""
    subjects = t.table("events").select(F.col("user_id").cast("string").alias("subject")).distinct()
    f = F.col("fold")
    split = F.when(f < 3, "train").when(f == 3, "validation").otherwise("test")
    return folds.group_kfold(subjects, 5).select("subject", split.alias("split"))


@query(
    "split_classes",
    with_views(
        s=_SPLITS,
        r="SELECT s.split, CAST(event_type = 'error' AND value > 150 AS INT) AS y FROM events e JOIN s ON CAST(e.user_id AS VARCHAR) = s.subject",
    )
    + """SELECT split, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(y) > 0 AND sum(y) < count(*) AS INT) AS both_classes FROM r
    GROUP BY split""",
)
def split_classes(t: Hub):
    """Both classes in every split; the split of a row follows from its subject."""
    y = ((F.col("event_type") == "error") & (F.col("value") > 150)).cast("int")
    rows = t.table("events").select(F.col("user_id").cast("string").alias("subject"), y.alias("y"))
    f = F.col("fold")
    split = F.when(f < 3, "train").when(f == 3, "validation").otherwise("test")
    return events.split_classes(folds.group_kfold(rows, 5).withColumn("split", split))


@query(
    "split_leakage",
    with_views(
        s=_SPLITS,
        dirty="SELECT * FROM s UNION ALL SELECT subject, 'test' FROM s WHERE split = 'train' AND subject LIKE '%7'",
        p="SELECT * FROM (VALUES ('train','validation'),('train','test'),('validation','test')) AS v(a, b)",
    )
    + """SELECT a, b, (SELECT count(*) FROM (SELECT subject FROM dirty WHERE split = a INTERSECT
    SELECT subject FROM dirty WHERE split = b)) AS shared FROM p""",
)
def split_leakage(t: Hub):
    clean = splits_frame(t)
    leaked = clean.filter("split = 'train' AND subject LIKE '%7'").select("subject", F.lit("test").alias("split"))
    return events.split_leakage(clean.unionByName(leaked))


@query(
    "robust_stats",
    with_views("samples")
    + """SELECT channel, count(*) AS n, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS sd,
    round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr
    FROM samples GROUP BY channel""",
)
def robust_stats(t: Hub):
    out = profile.column_robust_stats(t.wide, CHANNELS)
    return out.select(
        "channel", "n", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr")
    )


@query(
    "extra_features",
    with_views(
        "seg",
        c=f"SELECT *, x - avg(x) OVER (PARTITION BY {SEG_SQL}) AS c FROM seg",
        z=f"SELECT *, sign(c) * lag(sign(c)) OVER (PARTITION BY {SEG_SQL} ORDER BY i) AS q FROM c",
    )
    + f"""SELECT {SEG_SQL}, CAST(sum(CASE WHEN q < 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_crossings,
    round(max(x) - min(x), 6) AS peak_to_peak FROM z GROUP BY {SEG_SQL}""",
)
def extra_features(t: Hub):
    samples = t.segments.select(*SEG, F.posexplode("x").alias("idx", "value"))
    out = events.extra_features(samples, SEG)
    return out.withColumn("peak_to_peak", F.round("peak_to_peak", 6))


@query(
    "spectral_extras",
    with_views("psd", sh=f"SELECT *, psd / sum(psd) OVER (PARTITION BY {SEG_SQL}) AS s FROM psd")
    + f"""SELECT {SEG_SQL}, round(sum(CASE WHEN s > 0 THEN -s * ln(s) ELSE 0 END), 6) AS spectral_entropy,
    round(sum(CASE WHEN freq >= 4 AND freq < 8 THEN psd ELSE 0 END) / sum(CASE WHEN freq >= 13 AND freq < 30 THEN psd ELSE 0 END), 5) AS theta_beta,
    round(sum(CASE WHEN freq >= 8 AND freq < 13 THEN psd ELSE 0 END) / sum(CASE WHEN freq >= 13 AND freq < 30 THEN psd ELSE 0 END), 5) AS alpha_beta
    FROM sh GROUP BY {SEG_SQL}""",
)
def spectral_extras(t: Hub):
    psd = signal.welch_psd(t.segments, RATE, NPERSEG, EPOCH_N)
    out = events.spectral_extras(psd, SEG)
    return out.select(
        *SEG,
        F.round("spectral_entropy", 6).alias("spectral_entropy"),
        F.round("theta_beta", 5).alias("theta_beta"),
        F.round("alpha_beta", 5).alias("alpha_beta"),
    )


@query(
    "channel_correlation",
    with_views("wide")
    + " UNION ALL ".join(
        f"SELECT subject, recording, '{a}' AS c1, '{b}' AS c2, round(corr({a}, {b}), 6) AS r FROM wide GROUP BY subject, recording"
        for i, a in enumerate(CHANNELS)
        for b in CHANNELS[i + 1 :]
    ),
)
def channel_correlation(t: Hub):
    return events.channel_correlation(t.wide, CHANNELS, REC).withColumn("r", F.round("r", 6))


@query(
    "disparate_impact",
    with_views(
        "scored",
        c=f"SELECT model, protocol, lang, {counts_sql('p >= 0.5e0')} FROM scored GROUP BY model, protocol, lang",
        r="""SELECT model, protocol, lang, (tp + fp) / CAST(tp + tn + fp + fn AS DOUBLE) AS rate,
        CASE WHEN tp + fn = 0 THEN 0.0e0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS sens FROM c""",
        i="SELECT *, max(rate) OVER (PARTITION BY model, protocol) AS top FROM r",
    )
    + """SELECT model, protocol, lang, round(rate, 6) AS rate, round(sens, 6) AS sensitivity,
    round(CASE WHEN top = 0 THEN 1 ELSE rate / top END, 6) AS impact, CAST(CASE WHEN top = 0 THEN 1 ELSE rate / top END >= 0.8 AS INT) AS fair FROM i""",
)
def disparate_impact(t: Hub):
    counts = evaluate.confusion(t.scored, ["model", "protocol", "lang"])
    out = events.disparate_impact(counts, ["model", "protocol"], "lang")
    return out.select("model", "protocol", "lang", *[F.round(c, 6).alias(c) for c in ("rate", "sensitivity", "impact")], "fair")


_PLACE = "list_position([" + ", ".join(f"'{c}'" for c in FEATS) + "], {}.feature)"


@query(
    "corr_pruning",
    with_views("emb_long").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", pairs AS (
    SELECT {_PLACE.format('a')} AS i, {_PLACE.format('b')} AS j, corr(a.value, b.value) AS r
    FROM emb_long a JOIN emb_long b ON a.id = b.id AND a.feature <> b.feature GROUP BY ALL),
    against AS (SELECT j, list(i) AS them FROM pairs WHERE i < j AND abs(r) > 0.15 GROUP BY j),
    steps AS (
    SELECT 1 AS pos, [1] AS kept
    UNION ALL
    SELECT pos + 1, CASE WHEN g.them IS NULL OR NOT list_has_any(kept, g.them) THEN list_append(kept, pos + 1) ELSE kept END
    FROM steps s LEFT JOIN against g ON g.j = s.pos + 1 WHERE s.pos < {len(FEATS)})
    SELECT feature, CAST(list_contains((SELECT kept FROM steps WHERE pos = {len(FEATS)}), {_PLACE.format('f')}) AS INT) AS kept
    FROM (SELECT DISTINCT feature FROM emb_long) f""",
)
def corr_pruning(t: Hub):
    kept = set(profile.prune_correlated(t.emb, FEATS, 0.15))
    return t.spark.createDataFrame([(c, int(c in kept)) for c in FEATS], "feature string, kept int")


@query(
    "oversample",
    with_views(
        "emb",
        c="SELECT y, count(*) AS c FROM emb GROUP BY y",
        p="SELECT y, c, (SELECT max(c) FROM c) // c AS whole, (SELECT max(c) FROM c) % c AS rest FROM c",
        r="SELECT e.id, e.y, whole, rest, row_number() OVER (PARTITION BY e.y ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rn FROM emb e JOIN p ON e.y = p.y",
    )
    + "SELECT id, y, unnest(generate_series(1, whole + CASE WHEN rn <= rest THEN 1 ELSE 0 END)) AS copy FROM r",
)
def oversample(t: Hub):
    out = events.oversample(t.emb.select("id", "y"), "id")
    return out.select("id", "y", F.col("copy").cast("bigint").alias("copy"))


@query(
    "undersample",
    with_views(
        "emb",
        r="SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rn FROM emb",
        m="SELECT min(n) AS m FROM (SELECT count(*) AS n FROM emb GROUP BY y)",
    )
    + "SELECT id, y FROM r, m WHERE rn <= m",
)
def undersample(t: Hub):
    return prep.balance(t.emb.select("id", "y"), "id")
