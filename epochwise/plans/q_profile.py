"""Profiling, feature scores, drift and governance."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from epochwise.functions.constants import PSI_ALERT, SENSITIVITY_ALERT
from epochwise.operators import drift, evaluate, prep, profile
from epochwise.plans.hubs import CHANNELS, EPOCH_N, FEATS, NPERSEG, RATE, Hub, add_view, with_views
from epochwise.plans.registry import query


@query(
    "class_balance",
    with_views("emb")
    + """SELECT subject, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) AS rate
    FROM emb GROUP BY ROLLUP (subject)""",
)
def class_balance(t: Hub):
    return profile.class_balance(t.emb).withColumn("rate", F.round("rate", 6))


@query("class_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def class_counts(t: Hub):
    return t.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "moments",
    with_views("emb_long", m="SELECT feature, avg(value) AS m FROM emb_long GROUP BY feature")
    + """SELECT feature, round(mean, 6) AS mean, round(sqrt(m2), 6) AS sd, round(m3 / power(m2, 1.5e0), 5) AS skew,
    round(m4 / (m2 * m2) - 3, 5) AS kurtosis FROM (SELECT e.feature, avg(value) AS mean, avg(power(value - m, 2)) AS m2,
    avg(power(value - m, 3)) AS m3, avg(power(value - m, 4)) AS m4 FROM emb_long e JOIN m ON e.feature = m.feature
    GROUP BY e.feature)""",
)
def moments(t: Hub):
    out = profile.moments(t.emb, FEATS)
    return out.select(
        "feature",
        F.round("mean", 6).alias("mean"),
        F.round("sd", 6).alias("sd"),
        F.round("skew", 5).alias("skew"),
        F.round("kurtosis", 5).alias("kurtosis"),
    )


add_view(
    "corr_pairs",
    ["emb"],
    "SELECT * FROM (SELECT "
    + ", ".join(f"corr({a}, {b}) AS {a}_{b}" for i, a in enumerate(FEATS) for b in FEATS[i + 1 :])
    + " FROM emb) UNPIVOT (r FOR pair IN (*))",
)


@query(
    "top_corr",
    with_views("corr_pairs")
    + """SELECT substr(pair, 1, 3) AS f1, substr(pair, 5, 3) AS f2, round(r, 6) AS r FROM corr_pairs
    ORDER BY abs(r) DESC, pair DESC LIMIT 5""",
)
def top_corr(t: Hub):
    return profile.top_correlations(t.emb, FEATS, 5).withColumn("r", F.round("r", 6))


@query(
    "profile",
    with_views("emb_long")
    + """SELECT feature, CAST(sum(CASE WHEN value IS NULL OR isnan(value) THEN 1 ELSE 0 END) AS BIGINT) AS missing,
    round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean FROM emb_long GROUP BY feature""",
)
def profile_columns(t: Hub):
    out = profile.column_profile(t.emb, FEATS)
    return out.select("feature", "missing", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "mean")])


@query(
    "profile_overall",
    with_views("emb_long", f="SELECT feature, min(value) AS lo, max(value) AS hi, avg(value) AS m FROM emb_long GROUP BY feature")
    + """SELECT CAST(0 AS BIGINT) AS missing, round(min(lo), 6) AS amplitude_lo, round(max(hi), 6) AS amplitude_hi,
    round(min(m), 6) AS mean_lo, round(max(m), 6) AS mean_hi FROM f""",
)
def profile_overall(t: Hub):
    out = profile.overall_profile(t.emb, FEATS)
    return out.select("missing", *[F.round(c, 6).alias(c) for c in ("amplitude_lo", "amplitude_hi", "mean_lo", "mean_hi")])


add_view(
    "anova",
    ["emb_long"],
    """SELECT feature, CAST(count(*) - 1 AS DOUBLE) AS df1, CAST(sum(n) - count(*) AS DOUBLE) AS df2,
    (sum(n * power(m - g, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM (
    SELECT feature, y, count(*) AS n, avg(value) AS m, var_pop(value) AS v,
    sum(sum(value)) OVER (PARTITION BY feature) / sum(count(*)) OVER (PARTITION BY feature) AS g
    FROM emb_long GROUP BY feature, y) GROUP BY feature""",
)


@query("anova_f", with_views("anova") + "SELECT feature, df1, df2, round(f, 5) AS f FROM anova")
def anova_f(t: Hub):
    out = profile.anova(t.emb, FEATS, with_p=False)
    return out.select("feature", "df1", "df2", F.round("f", 5).alias("f"))


@query("anova_p")
def anova_p(t: Hub):
    return profile.anova(t.emb, FEATS).select("feature", F.round("p", 8).alias("p"), "significant")


MI_BINS = 10
_EDGES = ", ".join(f"quantile_cont(value, {i / MI_BINS})" for i in range(1, MI_BINS))
add_view(
    "mi",
    ["emb_long"],
    f"""SELECT feature, sum(c / n * ln(c * n / (nb * ny))) AS mi FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY feature) AS DOUBLE) AS n,
    sum(c) OVER (PARTITION BY feature, bin) AS nb, sum(c) OVER (PARTITION BY feature, y) AS ny FROM (
    SELECT e.feature, y, len(list_filter(q, lambda z: z <= value)) AS bin, count(*) AS c FROM emb_long e
    JOIN (SELECT feature, [{_EDGES}] AS q FROM emb_long GROUP BY feature) g ON e.feature = g.feature GROUP BY ALL)) GROUP BY feature""",
)


@query("mutual_info_binned", with_views("mi") + "SELECT feature, round(mi, 6) AS mutual_info_binned FROM mi")
def mutual_info_binned(t: Hub):
    out = profile.column_mutual_info(t.emb, FEATS, MI_BINS)
    return out.withColumn("mutual_info_binned", F.round("mutual_info_binned", 6))


@query(
    "pearson",
    with_views("emb_long") + "SELECT feature, round(corr(value, y), 6) AS r FROM emb_long GROUP BY feature",
)
def pearson(t: Hub):
    return profile.pearson(t.emb, FEATS).select("feature", F.round("r", 6).alias("r"))


@query("pearson_p")
def pearson_p(t: Hub):
    return profile.pearson(t.emb, FEATS).select("feature", F.round("t", 5).alias("t"), F.round("p", 8).alias("p"))


@query(
    "feature_rank",
    with_views("anova", "mi")
    + """SELECT a.feature, round(f, 5) AS f, round(mi, 6) AS mutual_info_binned,
    row_number() OVER (ORDER BY f DESC, a.feature) AS rank_f,
    row_number() OVER (ORDER BY mi DESC, a.feature) AS rank_mi FROM anova a JOIN mi ON a.feature = mi.feature
    QUALIFY rank_f <= 5 OR rank_mi <= 5""",
)
def feature_rank(t: Hub):
    scores = profile.anova(t.emb, FEATS, with_p=False).select("feature", "f").join(
        profile.column_mutual_info(t.emb, FEATS, MI_BINS), "feature"
    )
    # one row per feature column
    ranked = profile.rank_features(profile.rank_features(scores, "f", "rank_f"), "mutual_info_binned", "rank_mi")
    top = ranked.filter("rank_f <= 5 OR rank_mi <= 5")
    return top.select(
        "feature",
        F.round("f", 5).alias("f"),
        F.round("mutual_info_binned", 6).alias("mutual_info_binned"),
        F.col("rank_f").cast("bigint").alias("rank_f"),
        F.col("rank_mi").cast("bigint").alias("rank_mi"),
    )


@query("select_k_best", with_views("anova") + "SELECT feature, round(f, 5) AS f FROM anova ORDER BY f DESC, feature LIMIT 10")
def select_k_best(t: Hub):
    out = profile.rank_features(profile.anova(t.emb, FEATS, with_p=False), "f", "rank", 10)
    return out.select("feature", F.round("f", 5).alias("f"))


# drift: channels of the events before and after mid-month, and feature rows by subject halves
add_view(
    "drift_events",
    ["wide"],
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS value, CASE WHEN off_s < 1209600 THEN 'ref' ELSE 'cur' END AS win FROM wide"
        for c in CHANNELS
    ),
)
add_view(
    "emb_win",
    ["emb"],
    """SELECT e.*, CASE WHEN r <= n // 2 THEN 'ref' ELSE 'cur' END AS win FROM emb e JOIN (
    SELECT subject, row_number() OVER (ORDER BY subject) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT subject FROM emb)) s
    ON e.subject = s.subject""",
)
add_view(
    "drift_emb",
    ["emb_win"],
    " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, win FROM emb_win" for c in FEATS),
)
_EDGES10 = ", ".join(f"quantile_cont(value, {i / 10})" for i in range(1, 10))


def psi_sql(base: str) -> str:
    return f"""SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM (
    SELECT feature, ref_n / CAST(sum(ref_n) OVER (PARTITION BY feature) AS DOUBLE) + 1e-6 AS r,
    cur_n / CAST(sum(cur_n) OVER (PARTITION BY feature) AS DOUBLE) + 1e-6 AS c FROM (
    SELECT d.feature, len(list_filter(q, lambda z: z <= value)) AS bin, sum(CASE WHEN win = 'ref' THEN 1 ELSE 0 END) AS ref_n,
    sum(CASE WHEN win = 'cur' THEN 1 ELSE 0 END) AS cur_n FROM {base} d
    JOIN (SELECT feature, [{_EDGES10}] AS q FROM {base} WHERE win = 'ref' GROUP BY feature) g ON d.feature = g.feature
    GROUP BY ALL)) GROUP BY feature"""


add_view("psi_events", ["drift_events"], psi_sql("drift_events"))
add_view("psi_emb", ["drift_emb"], psi_sql("drift_emb"))


def _drift_events(t: Hub):
    return t.wide.select(*CHANNELS, F.when(F.col("off_s") < 1209600, "ref").otherwise("cur").alias("win"))


def _drift_emb(t: Hub):
    return drift.split_windows(t.emb).select("win", *FEATS)


@query("drift_windows", with_views("emb_win") + "SELECT id, subject, win FROM emb_win")
def drift_windows(t: Hub):
    return drift.split_windows(t.emb).select("id", "subject", "win")


@query("psi", with_views("psi_events") + "SELECT feature, round(psi, 6) AS psi FROM psi_events")
def psi(t: Hub):
    return drift.column_psi(_drift_events(t), CHANNELS).withColumn("psi", F.round("psi", 6))


@query("psi_features", with_views("psi_emb") + "SELECT feature, round(psi, 6) AS psi FROM psi_emb")
def psi_features(t: Hub):
    return drift.column_psi(_drift_emb(t), FEATS).withColumn("psi", F.round("psi", 6))


add_view(
    "psi_sum",
    ["psi_emb"],
    f"""SELECT max(psi) AS psi_max, avg(psi) AS psi_mean, CAST(sum(CASE WHEN psi > {PSI_ALERT} THEN 1 ELSE 0 END) AS BIGINT) AS n_drifted,
    CAST(max(psi) > {PSI_ALERT} AS INT) AS drift_alert FROM psi_emb""",
)


@query(
    "psi_summary",
    with_views("psi_sum")
    + "SELECT round(psi_max, 6) AS psi_max, round(psi_mean, 6) AS psi_mean, n_drifted, drift_alert FROM psi_sum",
)
def psi_summary(t: Hub):
    out = drift.psi_summary(drift.column_psi(_drift_emb(t), FEATS))
    return out.select(F.round("psi_max", 6).alias("psi_max"), F.round("psi_mean", 6).alias("psi_mean"), "n_drifted", "drift_alert")


def alerts_frame(t: Hub):
    summary = drift.psi_summary(drift.column_psi(_drift_emb(t), FEATS))
    macro = evaluate.macro(evaluate.per_subject(t.scored))
    return drift.alerts(summary, macro)


@query(
    "alerts",
    with_views("psi_sum", "subj")
    + f"""SELECT model, protocol, max(drift_alert) AS drift_alert, round(max(psi_max), 6) AS psi_max,
    round(avg(sensitivity), 6) AS mean_sensitivity, CAST(avg(sensitivity) < {SENSITIVITY_ALERT} AS INT) AS sensitivity_alert
    FROM subj, psi_sum WHERE tp + fn > 0 GROUP BY model, protocol""",
)
def alerts(t: Hub):
    out = alerts_frame(t)
    return out.select(
        "model",
        "protocol",
        "drift_alert",
        F.round("psi_max", 6).alias("psi_max"),
        F.round("mean_sensitivity", 6).alias("mean_sensitivity"),
        "sensitivity_alert",
    )


#: What the content was made with: this engine's own settings.
CONFIG = {"channels": CHANNELS, "epoch_samples": EPOCH_N, "rate": RATE, "welch_samples": NPERSEG}
_CONFIG_TEXT = json.dumps(CONFIG, sort_keys=True, separators=(",", ":"))
_EVENT = {
    "event_id": "event_id",
    "ts": "epoch_us(ts)",
    "user_id": "user_id",
    "event_type": "event_type",
    "value": "CAST(round(value * 1000000) AS BIGINT)",
    "props": "props",
}
_TEXT = " || ".join(f"coalesce(length(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR), '-')" for e in _EVENT.values())
_PART = f"CAST('0x' || substr(md5({_TEXT}), {{}}, 8) AS BIGINT)"


@query(
    "version_hash",
    f"""SELECT n, substr(sha256(n || ':' || s0 || ':' || s1 || '{_CONFIG_TEXT}'), 1, 12) AS version FROM (
    SELECT count(*) AS n, CAST(sum({_PART.format(1)}) AS VARCHAR) AS s0, CAST(sum({_PART.format(9)}) AS VARCHAR) AS s1 FROM events)""",
)
def version_hash(t: Hub):
    events = t.table("events").select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        "user_id",
        "event_type",
        F.round(F.col("value") * 1000000).cast("bigint").alias("value"),
        "props",
    )
    digest = drift.content_hash(events, list(_EVENT))
    return digest.select("n", drift.version_id(CONFIG, F.col("content")).alias("version"))
