"""Joins of all rows with a table of few, wide keys (folds, subjects, channels).

Hash-partitioning rows by such a key would put a subject with a third of all rows into one task. So
the table is stored and counted: up to a bound it is broadcast, beyond it the rows are salted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.session import materialise

MOST_ROWS = 100_000
#: Rows that salting may make of a table, if it isn't larger than half of that itself.
SALTED_ROWS = 6_400_000


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", most: int = MOST_ROWS, salts: int = 64) -> DataFrame:
    """``rows`` joined with ``table`` on ``keys``; ``rows`` is never hash-partitioned by ``keys`` alone.

    ``how`` may be inner, left, left_semi or left_anti. The salt of a row is a hash of the row. A larger table gets fewer
    salts. The planner takes a salted table for as small as its files, so it is told not to broadcast it.
    """
    small = materialise(table, "attached")
    count = small.count()
    if count <= most:
        return rows.join(F.broadcast(small), list(keys), how)
    salts = max(2, min(salts, SALTED_ROWS // count))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    return salted.join(small.select("*", every).hint("merge"), [*keys, "_salt"], how).drop("_salt")
