"""Chat formatting after collapsing cumulative snapshots of conversations.

Logs often hold a conversation once per turn, each time from its start. For each turn a rolling hash of
all turns up to it is kept: sums, over the positions, of hashes of (position, role, text). The hash
of a whole conversation is looked up among the hashes of proper prefixes of longer ones; an anti-join
keeps the conversations that are not found. Of equal conversations the one with the smallest
id is kept. What is kept is rendered.

Nulls: a null conversation id belongs to no conversation, its rows go. Null turns come first; ties
and repeated turns are ordered by role and text, and each counts. Null roles and texts are empty
and differ from no text. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.operators.ordering import exact_rank, running
from epochwise.session import materialise

#: Turns that are summed together; a conversation of any length is summed in pieces.
STRETCH = 512


def prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, role, text, h1, h2, turns): the hashes of all turns up to ``at``."""
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).filter(F.col("conv").isNotNull())
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    bucket = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 60)))
    ranked = exact_rank(rows, ["conv"], order, bucket, out="at", total="turns")
    exact = "decimal(38,0)"  # sums of any number of 64-bit values
    sums = {f"h{s}": F.xxhash64(F.lit(s), "at", "role", "text").cast(exact) for s in (1, 2)}
    out = running(ranked, ["conv"], F.floor(F.col("at") / STRETCH), [F.col("at")], sums)
    return out.select("conv", "at", "role", "text", F.col("cum_h1").alias("h1"), F.col("cum_h2").alias("h2"), "turns")


def maximal(prefix: DataFrame) -> DataFrame:
    """(conv, turns, copies): conversations that are no proper prefix of another, equal ones once."""
    key = ["at", "h1", "h2"]
    whole = prefix.filter(F.col("at") == F.col("turns")).groupBy(*key).agg(
        F.min("conv").alias("conv"), F.count("*").alias("copies")
    )
    begun = prefix.filter(F.col("at") < F.col("turns")).select(*key).distinct()
    return whole.join(begun, key, "left_anti").select("conv", F.col("at").alias("turns"), "copies")


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn between markers; markers inside a text are broken by a space."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), safe(role), F.lit("\n"), safe(text), F.lit("<|im_end|>\n"))


def collapse(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, copies, text) for every maximal conversation, rendered."""
    prefix = materialise(prefixes(turns, conv, turn, role, text), "chat-prefixes")
    kept = maximal(prefix)
    lines = prefix.join(kept.select("conv", "copies"), "conv").select(
        "conv", "copies", "turns", F.struct("at", rendered_turn(F.col("role"), F.col("text")).alias("line")).alias("t")
    )
    whole = lines.groupBy("conv", "copies", "turns").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select(
        F.col("conv").alias("conv_id"),
        F.col("turns").alias("n_turns"),
        "copies",
        F.concat_ws("", F.col("t.line")).alias("text"),
    )
