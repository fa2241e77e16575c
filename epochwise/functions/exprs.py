"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    """``num / den`` as double, ``empty`` where the denominator is zero."""
    den = den.cast("double")
    return F.when(den == 0.0, F.lit(empty)).otherwise(num.cast("double") / den)


def confusion_aggs(y: str = "y", pred: Column | None = None, weight: Column | None = None) -> list[Column]:
    """tp, tn, fp, fn as map-side-combined sums."""
    w = F.lit(1) if weight is None else weight
    pos, hit = F.col(y) == 1, pred

    def total(cond: Column, name: str) -> Column:
        return F.sum(F.when(cond, w).otherwise(0)).cast("bigint").alias(name)

    return [
        total(pos & hit, "tp"),
        total(~pos & ~hit, "tn"),
        total(~pos & hit, "fp"),
        total(pos & ~hit, "fn"),
    ]


METRICS = [
    "accuracy",
    "ppv",
    "sensitivity",
    "specificity",
    "npv",
    "f1",
    "balanced_accuracy",
    "mcc",
    "kappa",
]


def metric_exprs(eps: float = 0.0) -> dict[str, Column]:
    """The metric suite over columns tp, tn, fp, fn. ``eps`` > 0 adds it to denominators instead
    of guarding zero. Counts become doubles first, so products cannot overflow."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))

    def div(a: Column, b: Column) -> Column:
        return a / (b + F.lit(eps)) if eps > 0 else ratio(a, b)

    n = tp + tn + fp + fn
    acc = ratio(tp + tn, n)
    ppv, sens = div(tp, tp + fp), div(tp, tp + fn)
    spec, npv = div(tn, tn + fp), div(tn, tn + fn)
    chance = ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    return {
        "accuracy": acc,
        "ppv": ppv,
        "sensitivity": sens,
        "specificity": spec,
        "npv": npv,
        "f1": div(2.0 * ppv * sens, ppv + sens),
        "balanced_accuracy": (sens + spec) / 2.0,
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "kappa": ratio(acc - chance, 1.0 - chance),
    }


def rounded(names: list[str], digits: int = 6) -> list[Column]:
    return [F.round(F.col(n), digits).alias(n) for n in names]


def stack_columns(names: list[str], key: str = "feature", value: str = "value") -> Column:
    """Explode named columns of one row into (key, value) rows; stays within the stage."""
    pairs = [F.struct(F.lit(n).alias(key), F.col(n).cast("double").alias(value)) for n in names]
    return F.inline(F.array(*pairs))
