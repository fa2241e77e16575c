"""Evaluation of scored rows (subject, y, p, and any grouping columns).

Rows are first reduced to counts per distinct score, so one shuffle of the pre-aggregated
table serves curves, areas and operating points; cumulative sums run over score buckets (see
``ordering``), never over all scores of a model in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epochwise.functions.constants import SPECIFICITY_TARGETS
from epochwise.functions.exprs import METRICS, confusion_aggs, metric_exprs, ratio
from epochwise.operators import ordering
from epochwise.session import materialise

BY = ["model", "protocol"]


def confusion(scored: DataFrame, by: Sequence[str] = tuple(BY), thr: float = 0.5) -> DataFrame:
    return scored.groupBy(*by).agg(*confusion_aggs("y", F.col("p") >= F.lit(float(thr))))


def confusion_two_grains(scored: DataFrame, by: Sequence[str] = tuple(BY), group: str = "subject", thr: float = 0.5) -> DataFrame:
    """Counts per group and pooled (group null, ``pooled`` 1) from one aggregation.

    The groups are aggregated first; the pooled rows are summed from the group rows, so the
    data are not expanded as a grouping-sets plan over raw rows would.
    """
    per = confusion(scored, [*by, group], thr)
    counts = ["tp", "tn", "fp", "fn"]
    cols = [F.col(c) for c in [*by, group]]
    return per.groupingSets([cols, cols[:-1]], *cols).agg(
        F.grouping(group).cast("int").alias("pooled"), *[F.sum(c).cast("bigint").alias(c) for c in counts]
    )


def with_metrics(counts: DataFrame, eps: float = 0.0) -> DataFrame:
    """Add the metric suite to a table with tp, tn, fp, fn."""
    return counts.select("*", *[c.alias(n) for n, c in metric_exprs(eps).items()])


def score_counts(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, p, pos, neg): one row per distinct score, combined map-side."""
    return scored.groupBy(*by, "p").agg(
        F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg")
    )


def operating_points(scored: DataFrame, by: Sequence[str] = tuple(BY), counted: bool = False) -> DataFrame:
    """Per distinct score, descending: cum_pos, cum_neg at p >= score, and all_pos, all_neg.

    Scores are counted once and stored. Buckets are cut at quantiles of the distinct scores, so
    scores crowded near 0 are spread like any others. ``counted`` says that ``scored`` already
    is a table of ``score_counts``.
    """
    counts = materialise(scored if counted else score_counts(scored, by), "score-counts")
    placed = ordering.with_level(counts, "p", "_level")
    points = ordering.running(
        placed, by, -F.col("_level"), [F.col("p").desc()], {"pos": F.col("pos"), "neg": F.col("neg")}
    )
    return points.drop("_level")


def _auc_sum() -> Column:
    # negatives strictly below the score plus half of those tied with it
    below = F.col("all_neg") - F.col("cum_neg")
    return F.sum(F.col("pos").cast("double") * (below.cast("double") + F.col("neg").cast("double") / 2.0))


def roc_auc(scored: DataFrame, by: Sequence[str] = tuple(BY), points: DataFrame | None = None) -> DataFrame:
    """Area under the ROC curve with half credit for ties; null when a class is missing."""
    pts = points if points is not None else operating_points(scored, by)
    cells = F.max("all_pos").cast("double") * F.max("all_neg").cast("double")
    return pts.groupBy(*by).agg(F.when(cells > 0, _auc_sum() / cells).alias("auc"))


def pr_auc(scored: DataFrame, by: Sequence[str] = tuple(BY), points: DataFrame | None = None) -> DataFrame:
    """Average precision: precision at each threshold weighted by the recall step."""
    pts = points if points is not None else operating_points(scored, by)
    precision = F.col("cum_pos").cast("double") / (F.col("cum_pos") + F.col("cum_neg"))
    total = F.max("all_pos").cast("double")
    return pts.groupBy(*by).agg(
        F.when(total > 0, F.sum(F.col("pos").cast("double") * precision) / total).alias("pr_auc")
    )


def roc_curve(scored: DataFrame, by: Sequence[str] = tuple(BY)) -> DataFrame:
    """(by, threshold, fpr, tpr) per distinct score, plus the origin (threshold null)."""
    pts = operating_points(scored, by)
    body = pts.select(
        *by,
        F.col("p").alias("threshold"),
        ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )
    return body.unionByName(_end_point(scored, by, fpr=0.0, tpr=0.0))


def _end_point(scored: DataFrame, by: Sequence[str], **values: float) -> DataFrame:
    keys = scored.select(*by).distinct()
    null = F.lit(None).cast("double").alias("threshold")
    return keys.select(*by, null, *[F.lit(v).alias(n) for n, v in values.items()])


def pr_curve(scored: DataFrame, by: Sequence[str] = tuple(BY)) -> DataFrame:
    """(by, threshold, precision, recall), plus the end point precision 1, recall 0."""
    pts = operating_points(scored, by)
    body = pts.select(
        *by,
        F.col("p").alias("threshold"),
        ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        ratio(F.col("cum_pos"), F.col("all_pos")).alias("recall"),
    )
    return body.unionByName(_end_point(scored, by, precision=1.0, recall=0.0))


def sens_at_spec(scored: DataFrame, by: Sequence[str] = tuple(BY), targets: Sequence[float] = tuple(SPECIFICITY_TARGETS), points: DataFrame | None = None) -> DataFrame:
    """(by, target, sensitivity): the best sensitivity whose specificity reaches the target."""
    pts = points if points is not None else operating_points(scored, by)
    spec = ratio(F.col("all_neg") - F.col("cum_neg"), F.col("all_neg"))
    sens = ratio(F.col("cum_pos"), F.col("all_pos"))
    best = pts.groupBy(*by).agg(
        *[F.coalesce(F.max(F.when(spec >= F.lit(t), sens)), F.lit(0.0)).alias(f"_b{i}") for i, t in enumerate(targets)]
    )
    cells = [F.struct(F.lit(t).alias("target"), F.col(f"_b{i}").alias("sensitivity")) for i, t in enumerate(targets)]
    return best.select(*by, F.inline(F.array(*cells)))


def brier(scored: DataFrame, by: Sequence[str] = tuple(BY)) -> DataFrame:
    d = F.col("p") - F.col("y")
    return scored.groupBy(*by).agg(F.avg(d * d).alias("brier"))


def bin_edges(bins: int) -> list[float]:
    """i * (1/bins), as floats: the edges an evenly spaced grid on [0, 1] has."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def calibration_bins(scored: DataFrame, by: Sequence[str] = tuple(BY), bins: int = 10, include_right: bool = False) -> DataFrame:
    """(by, bin, n, mean_p, rate). Bins are [lo, hi): p = 1 falls in none unless asked."""
    edges = bin_edges(bins)
    at = F.lit(0)
    for e in edges[1:-1]:
        at = at + (F.col("p") >= F.lit(e)).cast("int")
    inside = (F.col("p") >= 0.0) & ((F.col("p") <= 1.0) if include_right else (F.col("p") < 1.0))
    placed = scored.withColumn("bin", F.when(inside, at))
    return placed.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate")
    )


def reliability(scored: DataFrame, by: Sequence[str] = tuple(BY), bins: int = 10, include_right: bool = False) -> DataFrame:
    return calibration_bins(scored, by, bins, include_right).filter(F.col("bin").isNotNull())


def ece(scored: DataFrame, by: Sequence[str] = tuple(BY), bins: int = 10, include_right: bool = False) -> DataFrame:
    """Weighted gap between mean score and observed rate; weights are shares of all rows."""
    b = calibration_bins(scored, by, bins, include_right)
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("rate") - F.col("mean_p"))).otherwise(0.0)
    return b.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def threshold_counts(scored: DataFrame, thresholds: Sequence[float], by: Sequence[str] = tuple(BY)) -> DataFrame:
    """(by, threshold, tp, tn, fp, fn) for every threshold.

    Each row is counted once, in the gap between thresholds it falls into; the few gap counts
    are then spread over the thresholds. The data are never multiplied by the grid.
    """
    grid = sorted(float(t) for t in thresholds)
    gap = F.lit(0)
    for t in grid:
        gap = gap + (F.col("p") >= F.lit(t)).cast("int")
    gaps = scored.groupBy(*by, gap.alias("_gap")).agg(
        F.sum("y").cast("bigint").alias("_pos"), F.sum(1 - F.col("y")).cast("bigint").alias("_neg")
    )
    cells = [F.struct(F.lit(i + 1).alias("_i"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)]
    spread = gaps.select(*by, "_gap", "_pos", "_neg", F.inline(F.array(*cells)))
    above = F.col("_gap") >= F.col("_i")

    def total(cond: Column, col: str, name: str) -> Column:
        return F.sum(F.when(cond, F.col(col)).otherwise(0)).cast("bigint").alias(name)

    return spread.groupBy(*by, "threshold").agg(
        total(above, "_pos", "tp"), total(~above, "_neg", "tn"), total(above, "_neg", "fp"), total(~above, "_pos", "fn")
    )


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float], by: Sequence[str] = tuple(BY)) -> DataFrame:
    return with_metrics(threshold_counts(scored, thresholds, by))


def youden(scored: DataFrame, thresholds: Sequence[float], by: Sequence[str] = tuple(BY)) -> DataFrame:
    """The threshold of largest sensitivity + specificity - 1; the first listed wins a tie."""
    sweep = threshold_sweep(scored, thresholds, by)
    place = F.element_at(
        F.map_from_arrays(
            F.array(*[F.lit(float(t)) for t in thresholds]), F.array(*[F.lit(i) for i in range(len(thresholds))])
        ),
        F.col("threshold"),
    )
    j = F.col("sensitivity") + F.col("specificity") - 1.0
    best = F.max(F.struct(j.alias("j"), (-place).alias("o"), F.col("threshold"), F.col("sensitivity"), F.col("specificity")))
    return sweep.groupBy(*by).agg(best.alias("b")).select(
        *by, F.col("b.threshold"), F.col("b.sensitivity"), F.col("b.specificity"), F.col("b.j").alias("youden_j")
    )


def multiclass(pred: DataFrame, classes: Sequence, positive) -> dict[str, DataFrame]:
    """Over (y, pred): confusion matrix, recall per class, overall and one-vs-rest accuracy."""
    matrix = pred.groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))
    wide = matrix.groupBy("y").pivot("pred", list(classes)).agg(F.sum("n")).na.fill(0)
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    recall = matrix.groupBy("y").agg(
        F.sum("n").alias("n"), ratio(F.sum(hit), F.sum("n")).alias("recall")
    )
    same_side = (F.col("y") == F.lit(positive)) == (F.col("pred") == F.lit(positive))
    overall = matrix.agg(
        F.sum("n").alias("n"),
        ratio(F.sum(hit), F.sum("n")).alias("accuracy"),
        ratio(F.sum(F.when(same_side, F.col("n")).otherwise(0)), F.sum("n")).alias("one_vs_rest_accuracy"),
    )
    return {"matrix": wide, "recall": recall, "overall": overall}


def per_subject(scored: DataFrame, by: Sequence[str] = tuple(BY), group: str = "subject", thr: float = 0.5, counted: bool = False) -> DataFrame:
    """(by, group, counts, metric suite, auc): one row per subject.

    Counts at the threshold and the area come from the same table of operating points, so
    the scored rows are shuffled once.
    """
    keys = [*by, group]
    pts = operating_points(scored, keys, counted=counted)
    above = F.col("p") >= F.lit(float(thr))
    tp = F.sum(F.when(above, F.col("pos")).otherwise(0)).cast("bigint")
    fp = F.sum(F.when(above, F.col("neg")).otherwise(0)).cast("bigint")
    cells = F.max("all_pos").cast("double") * F.max("all_neg").cast("double")
    agg = pts.groupBy(*keys).agg(
        tp.alias("tp"),
        (F.max("all_neg") - fp).alias("tn"),
        fp.alias("fp"),
        (F.max("all_pos") - tp).alias("fn"),
        F.when(cells > 0, _auc_sum() / cells).alias("auc"),
    )
    return with_metrics(agg)


def macro(subjects: DataFrame, by: Sequence[str] = tuple(BY)) -> DataFrame:
    """Mean of the per-subject rows that have a positive; a one-class AUC is skipped."""
    usable = subjects.filter(F.col("tp") + F.col("fn") > 0)
    return usable.groupBy(*by).agg(
        F.count(F.lit(1)).alias("subjects"),
        F.avg("sensitivity").alias("macro_sensitivity"),
        F.avg("auc").alias("macro_auc"),
    )


def pooled_vs_macro(scored: DataFrame, by: Sequence[str] = tuple(BY), thr: float = 0.5) -> DataFrame:
    """Pooled counts, metrics and area next to the macro averages.

    The rows are counted per subject and score once; the pooled counts are sums of those.
    """
    counts = score_counts(scored, [*by, "subject"])
    pooled_counts = counts.groupBy(*by, "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pts = operating_points(pooled_counts, by, counted=True)
    above = F.col("p") >= F.lit(float(thr))
    tp = F.sum(F.when(above, F.col("pos")).otherwise(0)).cast("bigint")
    fp = F.sum(F.when(above, F.col("neg")).otherwise(0)).cast("bigint")
    cells = F.max("all_pos").cast("double") * F.max("all_neg").cast("double")
    precision = F.col("cum_pos").cast("double") / (F.col("cum_pos") + F.col("cum_neg"))
    pos_total = F.max("all_pos").cast("double")
    pooled = with_metrics(
        pts.groupBy(*by).agg(
            tp.alias("tp"),
            (F.max("all_neg") - fp).alias("tn"),
            fp.alias("fp"),
            (F.max("all_pos") - tp).alias("fn"),
            F.when(cells > 0, _auc_sum() / cells).alias("roc_auc"),
            F.when(pos_total > 0, F.sum(F.col("pos").cast("double") * precision) / pos_total).alias("pr_auc"),
        )
    )
    return pooled.join(macro(per_subject(counts, by, thr=thr, counted=True), by), list(by))


def long_metrics(subjects: DataFrame, names: Sequence[str], by: Sequence[str] = tuple(BY), group: str = "subject") -> DataFrame:
    """(by, group, metric, value), nulls left out as a NaN-skipping mean does."""
    return (
        subjects.select(*by, group, *[F.col(n).cast("double").alias(n) for n in names])
        .unpivot([*by, group], list(names), "metric", "value")
        .filter(F.col("value").isNotNull())
    )


def worst_subjects(subjects: DataFrame, k: int = 4, by: Sequence[str] = tuple(BY), metric: str = "sensitivity", group: str = "subject") -> DataFrame:
    """The k subjects of lowest metric; ties by name. Only subjects with positives count.

    A ranking filtered to a small constant lets Spark keep k rows per key in every partition
    before the shuffle (WindowGroupLimit), so no key is collected whole.
    """
    usable = subjects.filter((F.col("tp") + F.col("fn") > 0) & F.col(metric).isNotNull())
    order = Window.partitionBy(*by).orderBy(F.col(metric), F.col(group))
    ranked = usable.select(*by, group, metric, F.row_number().over(order).cast("bigint").alias("rank"))
    return ranked.filter(F.col("rank") <= k)


def worst_per_metric(long: DataFrame, by: Sequence[str] = tuple(BY), group: str = "subject") -> DataFrame:
    """(by, metric, worst subject): smallest value, name as tie-break."""
    low = F.min(F.struct("value", group))
    return long.groupBy(*by, "metric").agg(low.alias("w")).select(
        *by, "metric", F.col(f"w.{group}").alias("worst_subject"), F.col("w.value").alias("value")
    )


def leakage_delta(scored: DataFrame, by: str = "model", leaky: str = "kfold", honest: str = "loso") -> DataFrame:
    """Pooled and macro figures of the leaky protocol minus the honest one."""
    names = ["accuracy", "sensitivity", "specificity", "roc_auc", "macro_sensitivity", "macro_auc"]
    both = pooled_vs_macro(scored, [by, "protocol"])
    wide = both.groupBy(by).pivot("protocol", [leaky, honest]).agg(*[F.first(n).alias(n) for n in names])
    return wide.select(by, *[(F.col(f"{leaky}_{n}") - F.col(f"{honest}_{n}")).alias(f"delta_{n}") for n in names])


METRIC_NAMES = METRICS
