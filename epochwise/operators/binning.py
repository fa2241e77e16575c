"""Exact quantiles and bin counts of many columns from two scans of the wide rows.

The first scan brackets every quantile of every column by a mergeable sketch, all columns in one aggregate. In the second a
batch is one matrix: of the values outside all brackets of their column only numbers per gap between brackets and class are
kept, values inside a bracket are counted one by one. Exact quantiles follow from both, and so do the counts per bin, as a gap
lies in one bin as a whole. Rows aren't multiplied by columns; what is shuffled is columns x gaps x classes
counts per task and about ``20 / accuracy`` of the values.

Nulls and NaN don't count. The brackets are proved by the counts; one that missed its quantile is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 20_000
GAPS = "col int, gap int, value double, cls string, n long"


def _brackets(rows: DataFrame, cols: Sequence[str], qs: Sequence[float], where: Column | None, accuracy: int) -> list:
    """Of each column the disjoint (starts, ends) that hold its quantiles."""
    n = rows.count() if where is None else rows.filter(where).count()
    # the sketch's own error, and two places, as a quantile may lie between neighbours
    margin = 5.0 / accuracy + 3.0 / max(n, 1)
    lows, highs = [max(0.0, q - margin) for q in qs], [min(1.0, q + margin) for q in qs]
    # infinite values sort to the ends, NaN is no value
    valued = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    if where is not None:
        valued = {c: F.when(where, v) for c, v in valued.items()}
    found = rows.agg(*[F.percentile_approx(v, lows + highs, accuracy).alias(f"c{i}") for i, v in enumerate(valued.values())]).first()
    out = []
    for got in found:
        starts, ends = [], []
        for low, high in sorted(zip(got[: len(qs)], got[len(qs) :])) if got else []:
            if ends and low <= ends[-1]:
                ends[-1] = max(ends[-1], high)
            else:
                starts.append(low)
                ends.append(high)
        out.append((np.array(starts), np.array(ends)))
    return out


def _gap_counts(rows: DataFrame, cols: Sequence[str], cls: Column, brackets: list) -> DataFrame:
    """(col, gap, value, cls, n): gap g lies above g brackets; values inside a bracket have their value, others null."""
    thin = rows.select(F.coalesce(cls.cast("string"), F.lit("")).alias("_c"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outside: dict[tuple[int, str], np.ndarray] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            parts = []
            for i in range(len(cols)):
                starts, ends = brackets[i]
                x = batch.column(1 + i).to_numpy(zero_copy_only=False).astype(float)
                known = ~np.isnan(x)
                v, c = x[known], code[known]
                last = np.searchsorted(starts, v, side="right") - 1
                inside = (last >= 0) & (v <= ends[np.maximum(last, 0)]) if len(starts) else np.zeros(len(v), bool)
                gap = last + 1
                flat = np.bincount(gap[~inside] * len(names) + c[~inside], minlength=(len(starts) + 1) * len(names))
                for k, name in enumerate(names):
                    counts = flat.reshape(-1, len(names))[:, k]
                    key = (i, name)
                    outside[key] = outside[key] + counts if key in outside else counts
                if inside.any():
                    # one row for each value, class and column of the batch
                    order = np.lexsort((c[inside], v[inside]))
                    vs, ks = v[inside][order], c[inside][order]
                    new = np.flatnonzero(np.concatenate([[True], (vs[1:] != vs[:-1]) | (ks[1:] != ks[:-1])]))
                    parts.append((i, vs[new], [names[k] for k in ks[new]], np.diff(np.concatenate([new, [len(vs)]]))))
            for i, vs, ks, counts in parts:
                size = len(vs)
                columns = [pa.array(np.full(size, i, np.int32)), pa.nulls(size, pa.int32()), pa.array(vs), pa.array(ks, pa.string()), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["col", "gap", "value", "cls", "n"])
        for (i, name), counts in outside.items():
            size = len(counts)
            columns = [pa.array(np.full(size, i, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.nulls(size, pa.float64()), pa.array([name] * size), pa.array(counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["col", "gap", "value", "cls", "n"])

    counted = thin.mapInArrow(run, GAPS).filter("n > 0")
    return counted.groupBy("col", "gap", "value", "cls").agg(F.sum("n").alias("n"))


def _exact(group: pd.DataFrame, starts: np.ndarray, qs: Sequence[float], of: str | None) -> tuple[np.ndarray, int]:
    """The linear-interpolated quantiles of the rows of class ``of`` (all without it) and their number."""
    own = group if of is None else group[group["cls"] == of]
    inner = own[own["value"].notna()].groupby("value")["n"].sum()
    value, count = inner.index.to_numpy(dtype=float), inner.to_numpy(dtype=np.int64)
    outer = own[own["value"].isna()].groupby("gap")["n"].sum()
    below = np.zeros(len(starts) + 1, np.int64)
    below[outer.index.to_numpy(dtype=int)] = outer.to_numpy(dtype=np.int64)
    n = int(below.sum() + count.sum())
    if not n:
        return np.full(len(qs), np.nan), 0
    # rows before a value: those of smaller inner values, and of the gaps up to the value's bracket
    gaps = np.cumsum(below)[np.searchsorted(starts, value, side="right") - 1]
    first = gaps + np.concatenate([[0], np.cumsum(count)[:-1]])

    def at(place: int) -> float:
        i = int(np.searchsorted(first, place, side="right")) - 1
        if i < 0 or place >= first[i] + count[i]:
            raise ValueError("quantile bracket missed; raise accuracy")
        return value[i]

    out = []
    for q in qs:
        place = q * (n - 1)
        low, high = at(int(np.floor(place))), at(int(np.ceil(place)))
        out.append(low + (high - low) * (place - np.floor(place)))
    return np.array(out), n


def column_quantiles(rows: DataFrame, cols: Sequence[str], qs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(feature, q, x, n): exact quantiles of every column; null where a column has no values."""
    brackets = _brackets(rows, cols, qs, None, accuracy)
    names, qs = list(cols), [float(q) for q in qs]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        i = int(group["col"].iloc[0])
        x, n = _exact(group, brackets[i][0], qs, None)
        return pd.DataFrame({"feature": names[i], "q": qs, "x": x, "n": n})

    counted = _gap_counts(rows, cols, F.lit(""), brackets)
    return counted.groupBy("col").applyInPandas(one, "feature string, q double, x double, n long")


def quantile_bins(
    rows: DataFrame, cols: Sequence[str], cls: str, bins: int = 10, of: str | None = None, accuracy: int = ACCURACY
) -> DataFrame:
    """(feature, bin, cls, n): how many values of each class lie in each quantile bin of their column.

    The inner edges are the exact quantiles of all rows, or of those of class ``of``; a value's bin is the number of
    edges not above it. Bins without values have no row. A task holds the bracketed values of one column.
    """
    qs = [i / bins for i in range(1, bins)]
    brackets = _brackets(rows, cols, qs, None if of is None else F.col(cls) == F.lit(of), accuracy)
    names = list(cols)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        i = int(group["col"].iloc[0])
        starts, ends = brackets[i]
        edges, n = _exact(group, starts, qs, of)
        if not n:
            return pd.DataFrame({"feature": [], "bin": [], "cls": [], "n": []})
        edges = np.sort(edges)
        # a gap lies above all brackets before it, so above their edges, and below the others
        gap_bin = np.array([np.searchsorted(edges, ends[g - 1], side="right") if g else 0 for g in range(len(starts) + 1)])
        inner = group["value"].notna().to_numpy()
        placed = np.searchsorted(edges, group["value"].to_numpy(dtype=float), side="right")
        gaps = group["gap"].fillna(0).to_numpy(dtype=int)
        counted = group.assign(bin=np.where(inner, placed, gap_bin[gaps])).groupby(["bin", "cls"], as_index=False)["n"].sum()
        return counted.assign(feature=names[i])[["feature", "bin", "cls", "n"]]

    counted = _gap_counts(rows, cols, F.col(cls), brackets)
    return counted.groupBy("col").applyInPandas(one, "feature string, bin int, cls string, n long")


def width_bins(rows: DataFrame, cols: Sequence[str], cls: str, bins: int) -> DataFrame:
    """(feature, bin, cls, n, width): counts per class on ``bins`` equal bins between each column's extremes.

    The top edge belongs to the last bin; a column of one value has all in bin 0 and width 0.
    """
    valued = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols]
    r = rows.agg(*[F.min(v) for v in valued], *[F.max(v) for v in valued]).first()
    low = [float("nan") if v is None else v for v in r[: len(cols)]]
    width = [0.0 if v is None else (v - a) / float(bins) for v, a in zip(r[len(cols) :], low)]
    names = list(cols)
    thin = rows.select(F.coalesce(F.col(cls).cast("string"), F.lit("")).alias("_c"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str], np.ndarray] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            classes, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            for i in range(len(names)):
                x = batch.column(1 + i).to_numpy(zero_copy_only=False).astype(float)
                known = ~np.isnan(x)
                at = np.floor((x[known] - low[i]) / width[i]) if width[i] else np.zeros(int(known.sum()))
                at = np.minimum(at, bins - 1).astype(int)
                flat = np.bincount(at * len(classes) + code[known], minlength=bins * len(classes)).reshape(bins, -1)
                for k, name in enumerate(classes):
                    sums[i, name] = sums[i, name] + flat[:, k] if (i, name) in sums else flat[:, k]
        for (i, name), counts in sums.items():
            at = np.flatnonzero(counts)
            if len(at):
                columns = [pa.array([names[i]] * len(at)), pa.array(at.astype(np.int64)), pa.array([name] * len(at)), pa.array(counts[at].astype(np.int64)), pa.array(np.full(len(at), width[i]))]
                yield pa.RecordBatch.from_arrays(columns, names=["feature", "bin", "cls", "n", "width"])

    parts = thin.mapInArrow(run, "feature string, bin long, cls string, n long, width double")
    return parts.groupBy("feature", "bin", "cls").agg(F.sum("n").alias("n"), F.max("width").alias("width"))
