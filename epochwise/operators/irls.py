"""Logistic regressions of many training sides at once, by iteratively reweighted least squares.

A *cell* is one training side: all rows but those with some value of some column (a held-out fold, or an outer and
an inner fold). Each step is one scan of the rows: a batch adds, for every cell, the weighted Gram matrix and the
gradient of its rows there, and only those sums are shuffled. So k folds cost one scan per step, not k fits.

The loss of a cell is the mean of the weighted log losses plus ``reg / 2`` times the squared coefficients of the
scaled columns; the intercept isn't penalised. Columns are scaled and classes weighted by the cell's own rows.
A step that makes the loss of a cell larger is halved. A cell without rows of both classes has no model.

The driver holds one matrix of (columns + 1) squared per cell; the number of cells is checked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most training sides of one call.
MAX_CELLS = 1024


@dataclass(frozen=True)
class Cell:
    """A training side: the rows without these (column, value) pairs; values are compared as strings."""

    without: tuple[tuple[str, str], ...]


@dataclass
class Model:
    """Intercept and coefficients for the columns as they are."""

    intercept: float
    coefficients: np.ndarray
    steps: int


def _thin(rows: DataFrame, cols: Sequence[str], cells: Sequence[Cell]) -> tuple[DataFrame, list[str]]:
    by = sorted({c for cell in cells for c, _ in cell.without})
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_g{i}") for i, c in enumerate(by)]
    return rows.select(F.col("y").cast("double").alias("_y"), *groups, *[F.col(c).cast("double") for c in cols]), by


def _unpack(batch: pa.RecordBatch, by: Sequence[str]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    y = batch.column(0).to_numpy(zero_copy_only=False)
    names = {c: np.array(batch.column(1 + i).to_pylist(), object) for i, c in enumerate(by)}
    first = 1 + len(by)
    x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(first, batch.num_columns)])
    return y, x, names


def _inside(cell: Cell, names: dict[str, np.ndarray], n: int) -> np.ndarray:
    keep = np.ones(n, bool)
    for column, value in cell.without:
        keep &= names[column] != value
    return keep


def _summed(rows: DataFrame, cols: Sequence[str], cells: Sequence[Cell], width: int, add) -> np.ndarray:
    """One row of ``width`` sums per cell. ``add(cell number, x, y)`` gives those of the rows of one batch."""
    thin, by = _thin(rows, cols, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if not batch.num_rows:
                continue
            y, x, names = _unpack(batch, by)
            if sums is None:
                sums = np.zeros((len(cells), width))
            for i, cell in enumerate(cells):
                keep = _inside(cell, names, len(y))
                if keep.any():
                    sums[i] += add(i, x[keep], y[keep])
        if sums is not None:
            for i, flat in enumerate(sums):
                columns = [pa.array(np.full(width, i, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array(flat)]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "pos", "v"])

    totals = thin.mapInArrow(run, "cell int, pos int, v double").groupBy("cell", "pos").agg(F.sum("v").alias("v"))
    out = np.zeros((len(cells), width))
    for r in totals.collect():  # cells x width, both bounded
        out[r.cell, r.pos] = r.v
    return out


def fit(
    rows: DataFrame,
    cols: Sequence[str],
    cells: Sequence[Cell],
    scales: Sequence[tuple[np.ndarray, np.ndarray]] | None = None,
    reg: float = 0.01,
    weighted: bool = True,
    steps: int = 50,
    tol: float = 1e-10,
) -> list[Model | None]:
    """A model for each cell, in their order. ``rows`` (y, cols, the cells' columns) should be stored: each step scans them.

    ``scales``: (offsets, divisors) of the columns for each cell; without them, mean and population deviation of the cell's
    rows. A column without spread is only moved.
    """
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} training sides")
    cols, d = list(cols), len(cols)
    shift = np.array([float(v or 0.0) for v in rows.agg(*[F.avg(c) for c in cols]).first()])

    def moments(_: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = x - shift  # about the means of all rows, so the sums stay small
        return np.concatenate([[np.sum(y == 0), np.sum(y == 1)], z.sum(axis=0), (z * z).sum(axis=0)])

    sums = _summed(rows, cols, cells, 2 + 2 * d, moments)
    n = sums[:, :2]
    total = np.maximum(n.sum(axis=1), 1)
    mean = sums[:, 2 : 2 + d] / total[:, None]
    spread = np.sqrt(np.maximum(sums[:, 2 + d :] / total[:, None] - mean * mean, 0.0))
    low, width = shift + mean, spread
    if scales is not None:
        low, width = (np.array(v, float).reshape(len(cells), d) for v in zip(*scales))
    # a spread that is rounding alone is none
    width = np.where(width > 1e-12 * np.maximum(np.abs(low), 1.0), width, 1.0)
    by_class = total[:, None] / (2 * np.maximum(n, 1)) if weighted else np.ones_like(n)
    whole = (by_class * n).sum(axis=1)

    theta = np.zeros((len(cells), d + 1))
    last, least = theta.copy(), np.full(len(cells), np.inf)
    open_cells = [i for i in range(len(cells)) if n[i].min() > 0]
    taken = np.zeros(len(cells), int)
    for _ in range(steps):
        if not open_cells:
            break
        now = [cells[i] for i in open_cells]
        at = {k: (theta[i], low[i], width[i], by_class[i]) for k, i in enumerate(open_cells)}

        def newton(k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            t, a, b, w = at[k]
            z = np.column_stack([np.ones(len(x)), (x - a) / b])
            m = z @ t
            # log(1 + exp(-m)) and its derivatives, without overflow
            p = np.where(m >= 0, 1 / (1 + np.exp(-np.abs(m))), np.exp(-np.abs(m)) / (1 + np.exp(-np.abs(m))))
            c = w[y.astype(int)]
            loss = (c * (np.maximum(m, 0) - m * y + np.log1p(np.exp(-np.abs(m))))).sum()
            h = z.T @ (z * (c * p * (1 - p))[:, None])
            return np.concatenate([[loss], z.T @ (c * (p - y)), h.ravel()])

        sums = _summed(rows, cols, now, 1 + (d + 1) + (d + 1) ** 2, newton)
        still = []
        for k, i in enumerate(open_cells):
            taken[i] += 1
            penalty = np.full(d + 1, reg)
            penalty[0] = 0.0
            loss = sums[k, 0] / whole[i] + 0.5 * (penalty * theta[i] ** 2).sum()
            if loss > least[i] + 1e-12 * abs(least[i]):
                theta[i] = (theta[i] + last[i]) / 2
                if np.abs(theta[i] - last[i]).max() > tol:
                    still.append(i)
                continue
            gradient = sums[k, 1 : d + 2] / whole[i] + penalty * theta[i]
            h = sums[k, d + 2 :].reshape(d + 1, d + 1) / whole[i] + np.diag(penalty)
            step = np.linalg.lstsq(h, gradient, rcond=None)[0]
            least[i], last[i] = loss, theta[i].copy()
            theta[i] = theta[i] - step
            if np.abs(step).max() > tol:
                still.append(i)
        open_cells = still
    out: list[Model | None] = []
    for i in range(len(cells)):
        if n[i].min() == 0:
            out.append(None)
            continue
        coefficients = theta[i, 1:] / width[i]
        out.append(Model(float(theta[i, 0] - coefficients @ low[i]), coefficients, int(taken[i])))
    return out


def score(rows: DataFrame, cols: Sequence[str], models: Sequence[tuple[Cell, Model | None]], keep: Sequence[str]) -> DataFrame:
    """(keep, cell, p): every row by the models of the cells that hold it out, with the cell's number in ``models``.

    A row held out by several cells has a row for each, and one held out by none, or by cells without a model alone, has none.
    A cell holds a row out when the row has the value of the cell's last pair, and none of the values before.
    """
    cells, by = [c for c, _ in models], sorted({c for cell, _ in models for c, _ in cell.without})
    kept = rows.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)],
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_g{i}") for i, c in enumerate(by)],
        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)],
    )
    fields = [T.StructField(f"_k{i}", kept.schema[f"_k{i}"].dataType) for i in range(len(keep))]
    schema = T.StructType([*fields, T.StructField("cell", T.IntegerType()), T.StructField("p", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = len(keep)
            names = {c: np.array(batch.column(first + i).to_pylist(), object) for i, c in enumerate(by)}
            x = np.column_stack(
                [batch.column(first + len(by) + i).to_numpy(zero_copy_only=False) for i in range(len(cols))]
            )
            for i, (cell, model) in enumerate(models):
                if model is None:
                    continue
                *others, (column, value) = cell.without
                held = (names[column] == value) & _inside(Cell(tuple(others)), names, batch.num_rows)
                at = np.flatnonzero(held)
                if not len(at):
                    continue
                p = 1 / (1 + np.exp(-np.clip(model.intercept + x[at] @ model.coefficients, -700, 700)))
                part = [batch.column(j).take(pa.array(at)) for j in range(first)]
                yield pa.RecordBatch.from_arrays(
                    [*part, pa.array(np.full(len(at), i, np.int32)), pa.array(p)], names=schema.names
                )

    out = kept.mapInArrow(run, schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "cell", "p")
