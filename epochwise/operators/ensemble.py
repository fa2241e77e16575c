"""Models that need no fitting beyond an average."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.operators.attach import attach


def soft_vote(members: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Average score per row over the member models."""
    return members.groupBy(*ids).agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("members"))


def majority(rows: DataFrame, group: str = "subject") -> DataFrame:
    """Constant score per held-out group: the positive rate of all other groups."""
    per = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_pos"))
    total = per.agg(F.sum("_n").alias("_tn"), F.sum("_pos").alias("_tp"))
    # one row of totals
    prior = per.join(F.broadcast(total)).select(
        group, ((F.col("_tp") - F.col("_pos")) / (F.col("_tn") - F.col("_n"))).alias("p")
    )
    out = attach(rows, prior, [group])
    return out.withColumn("pred", (F.col("p") >= 0.5).cast("int"))
