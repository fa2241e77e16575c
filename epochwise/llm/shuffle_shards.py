"""A uniform random shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. How many rows of each input partition go to each shard is drawn first: partition after
   partition, shard after shard, from the hypergeometric law given what is left. That is the law
   which these counts have in a uniform permutation of all rows, and shard sizes come out exactly.
2. Each partition is permuted locally, and its first rows go to shard 0, the next to shard 1, ...
3. After the exchange each shard is permuted, which gives the slots.

Only DataFrame and SQL functions are used. The matrix has ``PARTITIONS`` x shards entries whatever
the input; input partitions are folded into that many. Permutations are hash orders of a row number
that is written down once, so a task that runs again gets the same rows. No partition and no
shard is sorted in one task (see ``operators.ordering``), and equal rows are spread like any others.

Nulls and repeated rows are rows like any other; columns of the output's names are replaced. An
empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.operators.ordering import exact_rank
from epochwise.session import materialise

PARTITIONS = 256
#: The law is cut where a count is this many standard deviations (and 10) off its mode.
WIDTH = 9


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _draw(seed: int) -> str:
    """SQL of one hypergeometric count.

    ``s`` holds what is left: ``pool`` rows, of which ``need`` belong to this partition. Shard ``j``
    has ``a.free[j]`` free places. Weights relative to the mode follow by recursion, upwards and
    downwards; the inverse of their sum at a uniform number is the count.
    """
    rise = "x.p * (d.white - x.k) * (d.need - x.k) / ((x.k + 1) * (d.black - d.need + x.k + 1))"
    fall = "x.p * x.k * (d.black - d.need + x.k) / ((d.white - x.k + 1) * (d.need - x.k + 1))"
    start = "named_struct('p', 1D, 'sum', {first}, 'k', d.mode)"

    def total(step: str, move: int) -> str:
        return (
            f"aggregate(sequence(1, d.width), {start.format(first='0D')}, (x, i) -> "
            + _let("p", step, f"named_struct('p', p, 'sum', x.sum + p, 'k', x.k + {move}D)")
            + ", x -> x.sum)"
        )

    def find(step: str, move: int, first: str) -> str:
        return (
            f"aggregate(sequence(1, d.width), {start.format(first=first)}, (x, i) -> if(x.sum > t.at, x, "
            + _let("p", step, f"named_struct('p', p, 'sum', x.sum + p, 'k', x.k + {move}D)")
            + "), x -> x.k)"
        )

    uniform = f"shiftrightunsigned(xxhash64({seed}, b.part, j), 11) * 1.1102230246251565E-16D"
    chosen = (
        f"CASE WHEN t.at < 1D THEN d.mode WHEN t.at < 1D + t.up THEN {find(rise, 1, '1D')} "
        f"ELSE {find(fall, -1, '1D + t.up')} END"
    )
    weights = _let(
        "w",
        f"named_struct('up', {total(rise, 1)}, 'down', {total(fall, -1)})",
        _let("t", f"named_struct('up', w.up, 'at', {uniform} * (1D + w.up + w.down))", chosen),
    )
    sizes = (
        "named_struct('white', double(a.free[j]), 'black', double(s.pool - a.free[j]), 'need', double(s.need), "
        "'mode', double(least(a.free[j], s.need, greatest(0L, s.need - (s.pool - a.free[j]), "
        "bigint(floor((s.need + 1D) * (a.free[j] + 1D) / (s.pool + 2D)))))), "
        f"'width', 10 + int(ceil({WIDTH} * sqrt(double(s.need) * a.free[j] / greatest(1, s.pool) "
        "* (s.pool - a.free[j]) / greatest(1, s.pool) * (s.pool - s.need) / greatest(1, s.pool - 1)))))"
    )
    limits = "least(a.free[j], s.need, greatest(0L, s.need - (s.pool - a.free[j]), bigint({})))"
    return limits.format(_let("d", sizes, weights))


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, ends): for each partition the running sums of its counts by shard.

    ``counts`` has (part, n), at most ``PARTITIONS`` rows; they meet in one row.
    """
    one = counts.agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts"), F.sum("n").alias("rows"))
    one = one.filter("rows > 0").selectExpr(
        "parts",
        f"transform(sequence(0, {shards - 1}), j -> bigint(rows div {shards} + if(j < rows % {shards}, 1, 0))) AS free",
    )
    drawn = (
        f"aggregate(sequence(0, {shards - 1}), "
        "named_struct('need', b.n, 'pool', aggregate(a.free, 0L, (x, y) -> x + y), 'drawn', cast(array() as array<bigint>)), "
        "(s, j) -> "
        + _let(
            "k",
            _draw(seed),
            "named_struct('need', s.need - k, 'pool', s.pool - a.free[j], 'drawn', concat(s.drawn, array(k)))",
        )
        + ", s -> s.drawn)"
    )
    step = _let(
        "r",
        drawn,
        "named_struct('free', zip_with(a.free, r, (x, y) -> x - y), "
        "'rows', concat(a.rows, array(named_struct('part', b.part, 'counts', r))))",
    )
    rows = (
        "aggregate(parts, named_struct('free', free, 'rows', cast(array() as "
        f"array<struct<part:int,counts:array<bigint>>>)), (a, b) -> {step}, a -> a.rows)"
    )
    each = one.select(F.explode(F.expr(rows)).alias("r")).select("r.part", "r.counts")
    running = "transform(counts, (x, i) -> aggregate(slice(counts, 1, i + 1), 0L, (p, q) -> p + q))"
    return each.select("part", F.expr(running).alias("ends"))


def assign(df: DataFrame, shards: int, seed: int = 11) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (0, 1, ... in each shard)."""
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    # partition number and place in it, written down once
    rows = df.select(F.struct(*kept).alias("row"), F.monotonically_increasing_id().alias("uid"))
    rows = materialise(rows, "shuffle-rows")
    part = F.pmod(F.shiftright("uid", 33), F.lit(PARTITIONS)).cast("int")
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    matrix = materialise(communication_matrix(counts, shards, seed), "shuffle-matrix")
    local = rows.withColumn("h", F.xxhash64(F.lit(seed + 1), "uid"))
    local = exact_rank(local, ["part"], [F.col("h"), F.col("uid")], F.shiftright("h", 56), out="rank")
    sent = local.join(F.broadcast(matrix), "part")  # at most PARTITIONS rows
    passed = [(F.col("ends")[j] < F.col("rank")).cast("int") for j in range(shards)]
    sent = sent.select("row", "uid", functools.reduce(lambda x, y: x + y, passed).alias("shard"))
    sent = sent.withColumn("h", F.xxhash64(F.lit(seed + 2), "uid"))
    final = exact_rank(sent, ["shard"], [F.col("h"), F.col("uid")], F.shiftright("h", 52), out="rank")
    return final.select("row.*", F.col("shard"), (F.col("rank") - 1).alias("slot"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard, each ordered by slot within its files."""
    spread = assigned.repartition("shard", F.floor(F.col("slot") / 1_000_000))
    spread.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
