"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample: an exact neighbour graph, a balanced partitioning of it by recursive
bisection with swaps across the cut, and a small classifier from vectors to partitions. Every row
is then put into its most probable partition. A query goes to its ``probes`` most probable partitions,
where all rows are ranked by their exact distance. ``probes`` is the least number for which the part
of the sample that was not fitted finds ``RECALL`` of its neighbours.

Partitions are searched in blocks of rows against blocks of queries, so no task holds more than a
block of either, however many rows share a vector. More rows get more partitions.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with
a null id or with another dimension than most rows. Repeated rows count once. Ties go to the
smaller id. An empty table gives no rows; with fewer than ``k`` candidates all are given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from epochwise.session import materialise

#: Most vectors that the partitioning and the classifier are fitted on.
SAMPLE = 6000
RECALL = 0.95
NEIGHBOURS = 10
HIDDEN = 96
#: Rows and queries of one block.
BLOCK_ROWS, BLOCK_QUERIES = 16_000, 2_000


@dataclass
class Router:
    centre: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each vector, most probable first; ties to the smaller number."""
        return np.argsort(-self.log_odds(x), axis=1, kind="stable")


def neighbour_graph(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """The k nearest others of each row, exactly."""
    norm = (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), block):
        d = norm[None, :] - 2 * x[a : a + block] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + block] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, levels: int, rounds: int = 12) -> np.ndarray:
    """Part of each row, of ``2 ** levels``. Halves are cut at the median of the main direction;
    then rows with more neighbours across the cut are swapped in pairs, which keeps the balance."""
    part = np.zeros(len(x), np.int64)
    for _ in range(levels):
        nxt = part * 2
        for p in range(part.max() + 1):
            rows = np.flatnonzero(part == p)
            centred = x[rows] - x[rows].mean(0)
            main = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = np.argsort(centred @ main, kind="stable")
            side = np.zeros(len(rows), np.int64)
            side[order[len(rows) // 2 :]] = 1
            at = np.full(len(x), -1, np.int64)
            at[rows] = np.arange(len(rows))
            near = at[graph[rows]]  # -1: in another part already
            for _ in range(rounds):
                across = (side[near] != side[:, None]) & (near >= 0)
                gain = across.sum(1) - ((near >= 0) & ~across).sum(1)
                ups = [np.flatnonzero((side == s) & (gain > 0)) for s in (0, 1)]
                ups = [u[np.argsort(-gain[u], kind="stable")] for u in ups]
                n = min(map(len, ups)) // 2 + min(map(len, ups)) % 2
                if not n:
                    break
                for s in (0, 1):
                    side[ups[s][:n]] = 1 - s
            nxt[rows] += side
        part = nxt
    return part


def fit(x: np.ndarray, levels: int, seed: int = 5, steps: int = 500) -> Router:
    """The classifier learns the share of each partition among a row and its neighbours."""
    rng = np.random.default_rng(seed)
    parts, dim = 2**levels, x.shape[1]
    centre = x.mean(0)
    scale = float(x.std()) or 1.0
    r = Router(
        centre, scale,
        rng.normal(0, dim**-0.5, (dim, HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts),
        parts,
    )
    if levels == 0 or len(x) <= 4 * NEIGHBOURS:
        return r
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(x, graph, levels)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.arange(len(x))[:, None], part[np.column_stack([np.arange(len(x)), graph])]), 1 / (NEIGHBOURS + 1))
    tried = rng.random(len(x)) < 0.2  # not fitted; they set the number of probes
    rows = np.flatnonzero(~tried)
    names = ("w1", "b1", "w2", "b2")
    m = {n: np.zeros_like(getattr(r, n)) for n in names}
    v = {n: np.zeros_like(getattr(r, n)) for n in names}
    for step in range(1, steps + 1):
        pick = rng.choice(rows, min(256, len(rows)))
        z = (x[pick] - centre) / scale
        pre = z @ r.w1 + r.b1
        h = np.maximum(pre, 0)
        o = h @ r.w2 + r.b2
        p = np.exp(o - o.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - soft[pick]) / len(pick)
        dh = (d @ r.w2.T) * (pre > 0)
        grad = {"w2": h.T @ d, "b2": d.sum(0), "w1": z.T @ dh, "b1": dh.sum(0)}
        for n in names:
            m[n] = 0.9 * m[n] + 0.1 * grad[n]
            v[n] = 0.999 * v[n] + 0.001 * grad[n] ** 2
            getattr(r, n)[...] -= 0.01 * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    ranked = r.ranked(x)
    home, place = ranked[:, 0], np.argsort(ranked, axis=1)
    asked = np.flatnonzero(tried)
    if len(asked):
        at = np.sort(place[asked[:, None], home[graph[asked]]].ravel())
        r.probes = int(at[min(len(at) - 1, int(np.ceil(RECALL * len(at))))]) + 1
    return r


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, vec): the rows that take part, of the most frequent dimension, as doubles."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).alias("id"), v.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
    rows = rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("vec") == (first["d"] if first else 0))


def levels_for(rows: int) -> int:
    """Partitions grow with the square root of the rows: 8 up to 10,000 rows, 128 at most."""
    return int(np.clip(np.ceil(np.log2(max(1.0, rows) ** 0.5 / 12)), 3, 7)) if rows >= 1000 else 0


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row with ``is_query``.

    ``is_query`` may use the column ``id``. ``score`` is the Euclidean distance in doubles.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    total = rows.count()
    chosen = rows.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(SAMPLE).collect() if total else []
    router = fit(np.array([r["vec"] for r in chosen]), levels_for(total)) if total else None
    shared = spark.sparkContext.broadcast(router)
    kind = rows.schema["id"]
    placed = T.StructType([kind, T.StructField("vec", T.BinaryType()), T.StructField("parts", T.ArrayType(T.IntegerType()))])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch in batches:
            x = np.array(batch.column("vec").to_pylist()).reshape(batch.num_rows, -1)
            parts = r.ranked(x)[:, : r.probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(list(parts), pa.list_(pa.int32()))],
                names=placed.names,
            )

    routed = materialise(rows.mapInArrow(route, placed), "ann-rows")
    base = routed.select("id", "vec", F.col("parts")[0].alias("part"), F.monotonically_increasing_id().alias("u"))
    asks = routed.filter(is_query).select("id", "vec", F.explode("parts").alias("part"))
    n_rows = base.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("cb"))
    n_asks = asks.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("qb"))
    blocks = F.broadcast(n_rows.join(n_asks, "part"))  # one row a partition, 128 at most
    base = base.join(blocks, "part").select(
        "part", F.pmod(F.xxhash64("u"), F.col("cb")).cast("int").alias("c"),
        F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), "id", "vec",
    )
    asks = asks.select(F.col("part").alias("p"), F.col("id").alias("ask"), F.col("vec").alias("ask_vec"))
    asks = asks.join(blocks, asks["p"] == blocks["part"]).select(
        F.col("p"), F.explode(F.sequence(F.lit(0), F.col("cb") - 1)).alias("ask_c"),
        F.pmod(F.xxhash64("ask", "p"), F.col("qb")).cast("int").alias("ask_q"), "ask", "ask_vec",
    )
    out = T.StructType([T.StructField("query_id", kind.dataType), T.StructField("vec_id", kind.dataType), T.StructField("score", T.DoubleType())])

    def rank(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.drop_duplicates(["id", "vec"])
        asked = asked.drop_duplicates(["ask", "ask_vec"])
        if not len(held) or not len(asked):
            return pd.DataFrame({"query_id": asked["ask"][:0], "vec_id": held["id"][:0], "score": np.empty(0)})
        h, q = (np.frombuffer(b"".join(v), np.float64).reshape(len(v), -1) for v in (held["vec"], asked["ask_vec"]))
        ids, norm, found = held["id"].to_numpy(), (h * h).sum(1), []
        for qid, v in zip(asked["ask"].to_numpy(), q):
            near = norm - 2 * (h @ v)
            near[ids == qid] = np.inf
            most = min(k, len(near)) - 1
            limit = np.partition(near, most)[most]
            slack = 1e-9 * (abs(limit) if np.isfinite(limit) else 1.0) + 1e-9 * (v @ v)
            keep = np.flatnonzero((near <= limit + slack) & (near < np.inf))
            score = np.sqrt(((h[keep] - v) ** 2).sum(1))
            best = np.lexsort((ids[keep], score))
            one = list(dict.fromkeys(ids[keep][best]))[:k]
            least = dict(zip(ids[keep][best][::-1], score[best][::-1]))
            found += [(qid, i, least[i]) for i in one]
        return pd.DataFrame(found, columns=out.names)

    tops = asks.groupBy("p", "ask_c", "ask_q").cogroup(base.groupBy("part", "c", "q")).applyInPandas(rank, out)
    best = tops.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
