"""Isotonic calibration by pooling adjacent violators, for any number of groups.

Rows are counted per (group, score) first. The scores are cut into ranges; each range is pooled on its own to blocks
of equal value, and the blocks of all ranges are pooled again. Pooling blocks gives what pooling the rows
gives, as a block is its count and sum. With labels 0 and 1 a range of n rows leaves at most about 2 n^(2/3) blocks, as
their means are different fractions whose denominators add up to n or less; that bounds what the last pooling of a
group holds: 10 million blocks for 10^10 rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct scores of one range, about.
RANGE = 50_000
#: Rows of one group that meet its blocks in one task, about.
PART = 500_000
BLOCK = "lo double, hi double, n double, s double"


def pooled(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, s: np.ndarray) -> pd.DataFrame:
    """Blocks in order of score, pooled until their means s / n grow."""
    out: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), n.tolist(), s.tolist()):
        now = list(block)
        # a mean that isn't above the one before: cross products, as the counts are whole numbers
        while out and out[-1][3] * now[2] >= now[3] * out[-1][2]:
            before = out.pop()
            now = [before[0], now[1], before[2] + now[2], before[3] + now[3]]
        out.append(now)
    return pd.DataFrame(out, columns=["lo", "hi", "n", "s"])


def blocks(scores: DataFrame, by: Sequence[str], p: str = "p", y: str = "y", size: int = RANGE) -> DataFrame:
    """(by, lo, hi, n, s): the blocks of each group's isotonic fit; the fitted value is s / n.

    ``scores`` (by, p, y): rows without a score or label don't count.
    """
    by = list(by)
    known = scores.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    counted = known.groupBy(*by, F.col(p).cast("double").alias("lo")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("s")
    )
    # ranges follow the scores of all groups, so that each holds about as many of them
    rows = counted.agg(F.count(F.lit(1))).first()[0]
    parts = max(1, -(-rows // size))
    cuts = counted.agg(F.percentile_approx("lo", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    edges = sorted(set(cuts))
    place = F.size(F.filter(F.lit(edges), lambda e: e <= F.col("lo"))) if edges else F.lit(0)
    schema = T.StructType([scores.schema[c] for c in by] + T.StructType.fromDDL(BLOCK).fields)

    def pool(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("lo", kind="stable")
        out = pooled(*(group[c].to_numpy() for c in ("lo", "hi", "n", "s")))
        for i, c in enumerate(by):
            out.insert(i, c, group[c].iloc[0])
        return out

    ranged = counted.withColumn("hi", F.col("lo")).withColumn("_range", place)
    once = ranged.groupBy(*by, "_range").applyInPandas(pool, schema)
    return once.groupBy(*by).applyInPandas(pool, schema) if by else once.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(pool, schema)


def apply(scores: DataFrame, fitted: DataFrame, by: Sequence[str], p: str = "p", out: str = "calibrated") -> DataFrame:
    """``scores`` with the fitted value of their group: constant within a block, on a line between blocks, flat outside.

    Rows of a large group are spread over tasks, each of which holds the group's blocks. A group without blocks, and a
    row without a score, has no value.
    """
    by = list(by)
    parts = max(1, scores.count() // PART)
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(parts))
    left = scores.withColumn("_part", spread)
    right = fitted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    schema = T.StructType([*scores.schema.fields, T.StructField(out, T.DoubleType())])

    def value(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="_part")
        if own.empty or rows.empty:
            return rows.assign(**{out: np.full(len(rows), np.nan)})
        own = own.sort_values("lo")
        x = np.column_stack([own["lo"], own["hi"]]).ravel()
        v = np.repeat((own["s"] / own["n"]).to_numpy(), 2)
        at = rows[p].to_numpy(dtype=float)
        return rows.assign(**{out: np.where(np.isnan(at), np.nan, np.interp(at, x, v))})

    met = left.groupBy(*by, "_part").cogroup(right.groupBy(*by, "_part")).applyInPandas(value, schema)
    return met.withColumn(out, F.when(~F.isnan(out), F.col(out)))
