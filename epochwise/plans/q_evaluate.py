"""Metrics, curves, calibration, operating points and statistics over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.functions.constants import SPECIFICITY_TARGETS, SWEEP_OPERATING, SWEEP_TENTHS, T_FIXED
from epochwise.functions import stats
from epochwise.functions.exprs import METRICS
from epochwise.operators import compare, evaluate
from epochwise.plans.hubs import Hub, add_view, with_views
from epochwise.plans.registry import query

BY = ["model", "protocol"]
COUNTS = ["tp", "tn", "fp", "fn"]
GRID19 = [round(0.05 * i, 2) for i in range(1, 20)]


def counts_sql(pred: str) -> str:
    return f"""CAST(sum(CASE WHEN y = 1 AND {pred} THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN y = 0 AND NOT {pred} THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(CASE WHEN y = 0 AND {pred} THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN y = 1 AND NOT {pred} THEN 1 ELSE 0 END) AS BIGINT) AS fn"""


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0e0 ELSE ({a}) / CAST({b} AS DOUBLE) END)"


def suite_sql() -> dict[str, str]:
    """The metric suite over tp, tn, fp, fn as SQL text."""
    d = {c: f"CAST({c} AS DOUBLE)" for c in COUNTS}
    tp, tn, fp, fn = (d[c] for c in COUNTS)
    n = f"({tp} + {tn} + {fp} + {fn})"
    acc, ppv = _ratio(f"{tp} + {tn}", n), _ratio(tp, f"({tp} + {fp})")
    sens, spec = _ratio(tp, f"({tp} + {fn})"), _ratio(tn, f"({tn} + {fp})")
    chance = _ratio(f"({tp} + {fp}) * ({tp} + {fn}) + ({tn} + {fn}) * ({tn} + {fp})", f"({n} * {n})")
    return {
        "accuracy": acc,
        "ppv": ppv,
        "sensitivity": sens,
        "specificity": spec,
        "npv": _ratio(tn, f"({tn} + {fn})"),
        "f1": _ratio(f"2 * {ppv} * {sens}", f"({ppv} + {sens})"),
        "balanced_accuracy": f"({sens} + {spec}) / 2",
        "mcc": _ratio(
            f"{tp} * {tn} - {fp} * {fn}", f"sqrt(({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))"
        ),
        "kappa": _ratio(f"{acc} - {chance}", f"(1 - {chance})"),
    }


SUITE = suite_sql()
SUITE_COLS = ", ".join(f"{e} AS {n}" for n, e in SUITE.items())
SUITE_ROUND = ", ".join(f"round({e}, 6) AS {n}" for n, e in SUITE.items())


def points_views(name: str, by: list[str]) -> None:
    keys = ", ".join(by)
    add_view(
        name,
        ["scored"],
        f"""SELECT *, CAST(sum(pos) OVER (PARTITION BY {keys} ORDER BY p DESC) AS BIGINT) AS cum_pos,
        CAST(sum(neg) OVER (PARTITION BY {keys} ORDER BY p DESC) AS BIGINT) AS cum_neg,
        CAST(sum(pos) OVER (PARTITION BY {keys}) AS BIGINT) AS all_pos,
        CAST(sum(neg) OVER (PARTITION BY {keys}) AS BIGINT) AS all_neg FROM (
        SELECT {keys}, p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY {keys}, p)""",
    )


AUC_SQL = """CASE WHEN max(all_pos) > 0 AND max(all_neg) > 0 THEN
sum(CAST(pos AS DOUBLE) * (CAST(all_neg - cum_neg AS DOUBLE) + CAST(neg AS DOUBLE) / 2))
/ (CAST(max(all_pos) AS DOUBLE) * CAST(max(all_neg) AS DOUBLE)) END"""
AP_SQL = "sum(CAST(pos AS DOUBLE) * cum_pos / (cum_pos + cum_neg)) / max(all_pos)"
points_views("pts", BY)
points_views("pts_s", [*BY, "subject"])
add_view("conf", ["scored"], f"SELECT model, protocol, {counts_sql('p >= 0.5e0')} FROM scored GROUP BY model, protocol")
add_view(
    "conf_s",
    ["scored"],
    f"SELECT model, protocol, subject, {counts_sql('p >= 0.5e0')} FROM scored GROUP BY model, protocol, subject",
)
add_view("auc_s", ["pts_s"], f"SELECT model, protocol, subject, {AUC_SQL} AS auc FROM pts_s GROUP BY ALL")
add_view(
    "subj",
    ["conf_s", "auc_s"],
    f"""SELECT c.model, c.protocol, c.subject, tp, tn, fp, fn, {SUITE_COLS}, auc FROM conf_s c JOIN auc_s a
    ON c.model = a.model AND c.protocol = a.protocol AND c.subject = a.subject""",
)
SPREAD = ["accuracy", "sensitivity", "specificity", "ppv", "npv", "f1", "auc"]
add_view(
    "subj_long",
    ["subj"],
    " UNION ALL ".join(
        f"SELECT model, protocol, subject, '{m}' AS metric, {m} AS value FROM subj WHERE {m} IS NOT NULL" for m in SPREAD
    ),
)


def _subj_long(t: Hub):
    return evaluate.long_metrics(evaluate.per_subject(t.scored), SPREAD)


@query(
    "confusion",
    with_views("scored")
    + f"""SELECT model, protocol, subject, CAST(grouping(subject) AS INT) AS pooled, {counts_sql('p >= 0.5e0')}
    FROM scored GROUP BY GROUPING SETS ((model, protocol, subject), (model, protocol))""",
)
def confusion(t: Hub):
    return evaluate.confusion_two_grains(t.scored)


@query("metric_suite", with_views("conf") + f"SELECT model, protocol, tp, tn, fp, fn, {SUITE_ROUND} FROM conf")
def metric_suite(t: Hub):
    out = evaluate.with_metrics(evaluate.confusion(t.scored))
    return out.select(*BY, *COUNTS, *[F.round(m, 6).alias(m) for m in METRICS])


@query(
    "metric_suite_eps",
    with_views("conf_s")
    + """SELECT model, protocol, subject, round(tp / (tp + fn + 1e-12), 6) AS sensitivity,
    round(tn / (tn + fp + 1e-12), 6) AS specificity, round(tp / (tp + fp + 1e-12), 6) AS ppv,
    round(tn / (tn + fn + 1e-12), 6) AS npv FROM conf_s""",
)
def metric_suite_eps(t: Hub):
    """The fold variant, which adds an epsilon to denominators."""
    out = evaluate.with_metrics(evaluate.confusion(t.scored, [*BY, "subject"]), eps=1e-12)
    return out.select(*BY, "subject", *[F.round(m, 6).alias(m) for m in ("sensitivity", "specificity", "ppv", "npv")])


# multiclass: the order priority guessed from the price digit
_PRED = """SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS y,
CAST(CASE WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 200000 THEN 2 WHEN o_totalprice < 300000 THEN 3
WHEN o_totalprice < 400000 THEN 4 ELSE 5 END AS INT) AS pred FROM orders"""


def _pred(t: Hub):
    price = F.col("o_totalprice")
    guess = (
        F.when(price < 100000, 1).when(price < 200000, 2).when(price < 300000, 3).when(price < 400000, 4).otherwise(5)
    )
    return t.table("orders").select(
        F.substring("o_orderpriority", 1, 1).cast("int").alias("y"), guess.cast("int").alias("pred")
    )


@query(
    "multiclass",
    with_views(pr=_PRED)
    + """SELECT y, """
    + ", ".join(f"CAST(sum(CASE WHEN pred = {c} THEN 1 ELSE 0 END) AS BIGINT) AS pred_{c}" for c in range(1, 6))
    + """, count(*) AS n, round(avg(CASE WHEN y = pred THEN 1.0e0 ELSE 0.0e0 END), 6) AS recall FROM pr GROUP BY y""",
)
def multiclass(t: Hub):
    parts = evaluate.multiclass(_pred(t), [1, 2, 3, 4, 5], 1)
    matrix = parts["matrix"].select("y", *[F.col(str(c)).alias(f"pred_{c}") for c in range(1, 6)])
    return matrix.join(parts["recall"], "y").withColumn("recall", F.round("recall", 6))


@query(
    "multiclass_overall",
    with_views(pr=_PRED)
    + """SELECT count(*) AS n, round(avg(CASE WHEN y = pred THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy,
    round(avg(CASE WHEN (y = 1) = (pred = 1) THEN 1.0e0 ELSE 0.0e0 END), 6) AS one_vs_rest_accuracy FROM pr""",
)
def multiclass_overall(t: Hub):
    out = evaluate.multiclass(_pred(t), [1, 2, 3, 4, 5], 1)["overall"]
    return out.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("one_vs_rest_accuracy", 6).alias("one_vs_rest_accuracy"))


@query("roc_auc", with_views("pts") + f"SELECT model, protocol, round({AUC_SQL}, 6) AS auc FROM pts GROUP BY model, protocol")
def roc_auc(t: Hub):
    return evaluate.roc_auc(t.scored).withColumn("auc", F.round("auc", 6))


@query("roc_auc_subject", with_views("auc_s") + "SELECT model, protocol, subject, round(auc, 6) AS auc FROM auc_s")
def roc_auc_subject(t: Hub):
    return evaluate.roc_auc(t.scored, [*BY, "subject"]).withColumn("auc", F.round("auc", 6))


@query("pr_auc", with_views("pts") + f"SELECT model, protocol, round({AP_SQL}, 6) AS pr_auc FROM pts GROUP BY model, protocol")
def pr_auc(t: Hub):
    return evaluate.pr_auc(t.scored).withColumn("pr_auc", F.round("pr_auc", 6))


@query(
    "roc_curve",
    with_views("pts")
    + """SELECT model, protocol, round(p, 9) AS threshold, round(cum_neg / CAST(all_neg AS DOUBLE), 6) AS fpr,
    round(cum_pos / CAST(all_pos AS DOUBLE), 6) AS tpr FROM pts
    UNION ALL SELECT DISTINCT model, protocol, CAST(NULL AS DOUBLE), 0.0e0, 0.0e0 FROM pts""",
)
def roc_curve(t: Hub):
    out = evaluate.roc_curve(t.scored)
    return out.select(*BY, F.round("threshold", 9).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(
    "pr_curve",
    with_views("pts")
    + """SELECT model, protocol, round(p, 9) AS threshold, round(cum_pos / CAST(cum_pos + cum_neg AS DOUBLE), 6) AS precision,
    round(cum_pos / CAST(all_pos AS DOUBLE), 6) AS recall FROM pts
    UNION ALL SELECT DISTINCT model, protocol, CAST(NULL AS DOUBLE), 1.0e0, 0.0e0 FROM pts""",
)
def pr_curve(t: Hub):
    out = evaluate.pr_curve(t.scored)
    return out.select(*BY, F.round("threshold", 9).alias("threshold"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("brier", with_views("scored") + "SELECT model, protocol, round(avg((p - y) * (p - y)), 6) AS brier FROM scored GROUP BY model, protocol")
def brier(t: Hub):
    return evaluate.brier(t.scored).withColumn("brier", F.round("brier", 6))


def _bins_sql(right: bool) -> str:
    edges = evaluate.bin_edges(10)
    at = " + ".join(f"CAST(p >= {e!r}e0 AS INT)" for e in edges[1:-1])
    inside = "p >= 0 AND p <= 1" if right else "p >= 0 AND p < 1"
    return f"""SELECT model, protocol, CASE WHEN {inside} THEN {at} END AS bin, count(*) AS n, avg(p) AS mean_p,
    avg(y) AS rate FROM scored GROUP BY ALL"""


_ECE = "round(sum(CASE WHEN bin IS NULL THEN 0 ELSE n * abs(rate - mean_p) END) / sum(n), 6)"


@query("ece", with_views("scored", b=_bins_sql(False)) + f"SELECT model, protocol, {_ECE} AS ece FROM b GROUP BY model, protocol")
def ece(t: Hub):
    return evaluate.ece(t.scored).withColumn("ece", F.round("ece", 6))


@query("ece_closed", with_views("scored", b=_bins_sql(True)) + f"SELECT model, protocol, {_ECE} AS ece FROM b GROUP BY model, protocol")
def ece_closed(t: Hub):
    return evaluate.ece(t.scored, include_right=True).withColumn("ece", F.round("ece", 6))


@query(
    "reliability",
    with_views("scored", b=_bins_sql(False))
    + "SELECT model, protocol, bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM b WHERE bin IS NOT NULL",
)
def reliability(t: Hub):
    out = evaluate.reliability(t.scored)
    return out.select(*BY, "bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"))


def _sweep_views(grid: list[float]) -> dict[str, str]:
    values = ", ".join(f"({t!r}::DOUBLE)" for t in grid)
    return {
        "sweep": f"""SELECT model, protocol, threshold, {counts_sql('p >= threshold')} FROM scored,
        (VALUES {values}) AS v(threshold) GROUP BY model, protocol, threshold"""
    }


_SWEEP_OUT = f"SELECT model, protocol, threshold, tp, tn, fp, fn, {SUITE_ROUND} FROM sweep"


def _sweep(t: Hub, grid: list[float]):
    out = evaluate.threshold_sweep(t.scored, grid)
    return out.select(*BY, "threshold", *COUNTS, *[F.round(m, 6).alias(m) for m in METRICS])


@query("threshold_sweep", with_views("scored", **_sweep_views(SWEEP_TENTHS)) + _SWEEP_OUT)
def threshold_sweep(t: Hub):
    return _sweep(t, SWEEP_TENTHS)


@query("threshold_sweep_operating", with_views("scored", **_sweep_views(SWEEP_OPERATING)) + _SWEEP_OUT)
def threshold_sweep_operating(t: Hub):
    return _sweep(t, SWEEP_OPERATING)


@query("threshold_tradeoff", with_views("scored", **_sweep_views(GRID19)) + _SWEEP_OUT)
def threshold_tradeoff(t: Hub):
    return _sweep(t, GRID19)


@query(
    "youden",
    with_views("scored", **_sweep_views(SWEEP_OPERATING))
    + f"""SELECT model, protocol, threshold, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity,
    round(j, 6) AS youden_j FROM (SELECT *, row_number() OVER (PARTITION BY model, protocol ORDER BY j DESC, threshold DESC) AS rn
    FROM (SELECT model, protocol, threshold, {SUITE['sensitivity']} AS sensitivity, {SUITE['specificity']} AS specificity,
    {SUITE['sensitivity']} + {SUITE['specificity']} - 1 AS j FROM sweep)) WHERE rn = 1""",
)
def youden(t: Hub):
    out = evaluate.youden(t.scored, SWEEP_OPERATING)
    return out.select(*BY, "threshold", *[F.round(c, 6).alias(c) for c in ("sensitivity", "specificity", "youden_j")])


@query(
    "sens_at_spec",
    with_views("pts")
    + f"""SELECT model, protocol, target, round(coalesce(max(CASE WHEN (all_neg - cum_neg) / CAST(all_neg AS DOUBLE) >= target
    THEN cum_pos / CAST(all_pos AS DOUBLE) END), 0), 6) AS sensitivity FROM pts,
    (VALUES {', '.join(f'({x}::DOUBLE)' for x in SPECIFICITY_TARGETS)}) AS v(target) GROUP BY model, protocol, target""",
)
def sens_at_spec(t: Hub):
    return evaluate.sens_at_spec(t.scored).withColumn("sensitivity", F.round("sensitivity", 6))


add_view(
    "pvm",
    ["conf", "pts", "subj"],
    f"""SELECT c.model, c.protocol, tp, tn, fp, fn, {SUITE_COLS}, roc_auc, pr_auc, subjects, macro_sensitivity, macro_auc
    FROM conf c JOIN (SELECT model, protocol, {AUC_SQL} AS roc_auc, {AP_SQL} AS pr_auc FROM pts GROUP BY model, protocol) a
    ON c.model = a.model AND c.protocol = a.protocol JOIN (SELECT model, protocol, count(*) AS subjects,
    avg(sensitivity) AS macro_sensitivity, avg(auc) AS macro_auc FROM subj WHERE tp + fn > 0 GROUP BY model, protocol) m
    ON c.model = m.model AND c.protocol = m.protocol""",
)
PVM = [*METRICS, "roc_auc", "pr_auc", "macro_sensitivity", "macro_auc"]


@query(
    "pooled_vs_macro",
    with_views("pvm")
    + "SELECT model, protocol, tp, tn, fp, fn, subjects, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in PVM)
    + " FROM pvm",
)
def pooled_vs_macro(t: Hub):
    out = evaluate.pooled_vs_macro(t.scored)
    return out.select(*BY, *COUNTS, "subjects", *[F.round(c, 6).alias(c) for c in PVM])


@query(
    "subject_spread",
    with_views("subj_long")
    + """SELECT model, protocol, metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
    round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.25), 6) AS q1,
    round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3
    FROM subj_long GROUP BY model, protocol, metric""",
)
def subject_spread(t: Hub):
    out = compare.spread(_subj_long(t), [*BY, "metric"])
    cols = ["mean", "sd", "min", "max", "q1", "median", "q3"]
    return out.select(*BY, "metric", "n", *[F.round(c, 6).alias(c) for c in cols])


@query(
    "ci95",
    with_views("subj_long")
    + f"""SELECT model, protocol, metric, count(*) AS n, round(avg(value), 6) AS mean,
    round(avg(value) - {T_FIXED}e0 * stddev_samp(value) / sqrt(count(*)), 6) AS lo,
    round(avg(value) + {T_FIXED}e0 * stddev_samp(value) / sqrt(count(*)), 6) AS hi
    FROM subj_long GROUP BY model, protocol, metric""",
)
def ci95(t: Hub):
    out = compare.ci95(_subj_long(t), [*BY, "metric"], fixed_t=T_FIXED)
    return out.select(*BY, "metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


_T_TABLE = ", ".join(f"({df}, {stats.t_quantile_975(df)!r}::DOUBLE)" for df in range(1, 201))


@query(
    "ci95_exact_t",
    with_views("subj_long", tq=f"SELECT * FROM (VALUES {_T_TABLE}) AS v(df, t)")
    + """SELECT model, protocol, metric, n, round(mean, 6) AS mean, round(mean - t * sd / sqrt(n), 6) AS lo,
    round(mean + t * sd / sqrt(n), 6) AS hi FROM (SELECT model, protocol, metric, count(*) AS n, avg(value) AS mean,
    stddev_samp(value) AS sd FROM subj_long GROUP BY model, protocol, metric) JOIN tq ON df = n - 1""",
)
def ci95_exact_t(t: Hub):
    """The quantile follows the number of subjects."""
    out = compare.ci95(_subj_long(t), [*BY, "metric"])
    return out.select(*BY, "metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


@query(
    "t_test",
    with_views("subj_long")
    + """SELECT model, protocol, CAST(count(*) AS DOUBLE) AS n, round(avg(value), 6) AS mean,
    round((avg(value) - 0.5e0) / (stddev_samp(value) / sqrt(count(*))), 5) AS t
    FROM subj_long WHERE metric = 'accuracy' GROUP BY model, protocol""",
)
def t_test(t: Hub):
    long = evaluate.long_metrics(evaluate.per_subject(t.scored), ["accuracy"])
    out = compare.t_test(long, BY)
    return out.select(*BY, "n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"))


@query("t_test_p")
def t_test_p(t: Hub):
    long = evaluate.long_metrics(evaluate.per_subject(t.scored), ["accuracy"])
    return compare.t_test(long, BY).select(*BY, F.round("p", 9).alias("p"))


BOOT = 2000


@query(
    "bootstrap",
    with_views(
        "subj",
        v="""SELECT model, protocol, sensitivity AS v, row_number() OVER (PARTITION BY model, protocol ORDER BY subject) - 1 AS j,
        count(*) OVER (PARTITION BY model, protocol) AS n FROM subj WHERE tp + fn > 0""",
        d=f"""SELECT model, protocol, b, CAST('0x' || substr(md5('42:' || CAST(b AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 8)
        AS BIGINT) % n AS j FROM v, unnest(generate_series(0, {BOOT - 1})) AS g(b)""",
        m="""SELECT d.model, d.protocol, b, avg(v.v) AS m FROM d JOIN v ON d.model = v.model AND d.protocol = v.protocol
        AND d.j = v.j GROUP BY ALL""",
    )
    + """SELECT model, protocol, (SELECT count(*) FROM v WHERE v.model = m.model AND v.protocol = m.protocol) AS n,
    (SELECT round(avg(v), 6) FROM v WHERE v.model = m.model AND v.protocol = m.protocol) AS mean,
    round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m GROUP BY model, protocol""",
)
def bootstrap(t: Hub):
    subj = evaluate.per_subject(t.scored).filter("tp + fn > 0")
    out = compare.bootstrap(subj.select(*BY, "subject", F.col("sensitivity").alias("value")), BY, resamples=BOOT)
    return out.select(*BY, "n", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


@query(
    "worst_subjects",
    with_views("subj")
    + """SELECT model, protocol, rank, subject, round(sensitivity, 6) AS sensitivity FROM (SELECT *, row_number() OVER (
    PARTITION BY model, protocol ORDER BY sensitivity, subject) AS rank FROM subj WHERE tp + fn > 0) WHERE rank <= 4""",
)
def worst_subjects(t: Hub):
    out = evaluate.worst_subjects(evaluate.per_subject(t.scored), 4)
    return out.withColumn("sensitivity", F.round("sensitivity", 6))


@query(
    "worst_per_metric",
    with_views("subj_long")
    + """SELECT model, protocol, metric, subject AS worst_subject, round(value, 6) AS value FROM (SELECT *, row_number() OVER (
    PARTITION BY model, protocol, metric ORDER BY value, subject) AS rn FROM subj_long) WHERE rn = 1""",
)
def worst_per_metric(t: Hub):
    return evaluate.worst_per_metric(_subj_long(t)).withColumn("value", F.round("value", 6))


add_view(
    "auc_diffs",
    ["auc_s"],
    """SELECT a.model, a.protocol, a.subject, a.auc - r.auc AS d FROM auc_s a JOIN auc_s r ON a.protocol = r.protocol
    AND a.subject = r.subject AND r.model = 'rf' WHERE a.model <> 'rf' AND a.auc IS NOT NULL AND r.auc IS NOT NULL""",
)


def _auc_diffs(t: Hub):
    auc = evaluate.roc_auc(t.scored, [*BY, "subject"]).filter("auc IS NOT NULL")
    return compare.paired(auc, ["protocol"], value="auc")


@query(
    "wilcoxon",
    with_views(
        "auc_diffs",
        nz="SELECT model, protocol, round(d, 12) AS d FROM auc_diffs WHERE round(d, 12) <> 0",
        rk="""SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY model, protocol, abs(d)) - 1) / 2.0e0 AS r FROM nz
        WINDOW w AS (PARTITION BY model, protocol ORDER BY abs(d))""",
        st="""SELECT model, protocol, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w
        FROM rk GROUP BY model, protocol""",
        ov="SELECT model, protocol, avg(d) AS mean_delta FROM auc_diffs GROUP BY model, protocol",
    )
    + """SELECT o.model, o.protocol, coalesce(n, 0) AS n, round(w, 4) AS w, round(mean_delta, 6) AS mean_delta
    FROM ov o LEFT JOIN st s ON o.model = s.model AND o.protocol = s.protocol""",
)
def wilcoxon(t: Hub):
    out = compare.wilcoxon(_auc_diffs(t), BY, with_p=False)
    return out.select(*BY, "n", F.round("w", 4).alias("w"), F.round("mean_delta", 6).alias("mean_delta"))


@query("wilcoxon_p")
def wilcoxon_p(t: Hub):
    out = compare.wilcoxon(_auc_diffs(t), BY)
    return out.select(*BY, "n", F.round("p", 6).alias("p"), (F.col("p") < 0.05).cast("int").alias("significant"))


DELTAS = ["accuracy", "sensitivity", "specificity", "roc_auc", "macro_sensitivity", "macro_auc"]


@query(
    "leakage_delta",
    with_views("pvm")
    + "SELECT k.model, "
    + ", ".join(f"round(k.{c} - l.{c}, 6) AS delta_{c}" for c in DELTAS)
    + " FROM pvm k JOIN pvm l ON k.model = l.model AND k.protocol = 'kfold' AND l.protocol = 'loso'",
)
def leakage_delta(t: Hub):
    out = evaluate.leakage_delta(t.scored)
    return out.select("model", *[F.round(f"delta_{c}", 6).alias(f"delta_{c}") for c in DELTAS])


@query(
    "soft_vote",
    with_views("scored_wide")
    + "SELECT id, subject, y, round((rf + lr + svm) / 3.0e0, 9) AS p FROM scored_wide",
)
def soft_vote(t: Hub):
    from epochwise.operators import ensemble

    members = t.scored.filter("protocol = 'loso' AND model IN ('rf', 'lr', 'svm')")
    out = ensemble.soft_vote(members, ["id", "subject", "y"])
    return out.select("id", "subject", "y", F.round("p", 9).alias("p"))


@query(
    "majority",
    with_views("scored_wide")
    + """SELECT a.id, a.subject, a.y, round((SELECT avg(y) FROM scored_wide b WHERE b.subject <> a.subject), 6) AS p,
    CAST((SELECT avg(y) FROM scored_wide b WHERE b.subject <> a.subject) >= 0.5 AS INT) AS pred FROM scored_wide a""",
)
def majority(t: Hub):
    from epochwise.operators import ensemble

    out = ensemble.majority(t.scored_wide.select("id", "subject", "y"))
    return out.select("id", "subject", "y", F.round("p", 6).alias("p"), "pred")
