"""Quality classifier: a byte-level convolutional network in numpy over the whole document.

A document is cut into overlapping chunks of bytes that cover all of it. Each learned filter looks at
``WIDTH`` successive bytes, moves by ``STRIDE``, and keeps its maximum in the chunk; a small
dense layer turns the maxima into a logit. Mean, lowest and highest logit of the chunks are
combined into one probability.

A filter over one-hot bytes is a sum of ``WIDTH`` rows of weights, so the forward pass is
table look-ups and additions, and only the winning position of each filter gets a gradient.

Nulls and empty texts: one chunk of padding, so they have a score. Labels are read for fitting alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256
OVERLAP = 32
WIDTH = 6
STRIDE = 2
FILTERS = 24
HIDDEN = 12
PAD = 256
#: Most labelled rows of either class that the network is fitted on.
SAMPLE_PER_CLASS = 3000
STEPS = 1500
BATCH = 64
#: Chunks that are scored at once, which bounds a worker's memory whatever a text's length.
BLOCK = 512
THRESHOLD = 0.7


@dataclass
class Model:
    filters: np.ndarray  # WIDTH x 257 x FILTERS
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    combine: np.ndarray  # weights of mean, lowest and highest chunk logit, and a constant


def chunks(raw: bytes) -> np.ndarray:
    """Chunks x CHUNK byte values; the last chunk is padded, and no byte is left out."""
    data = np.frombuffer(raw, dtype=np.uint8)
    step = CHUNK - OVERLAP
    count = 1 + max(0, -(-(len(data) - CHUNK) // step))
    padded = np.full((count - 1) * step + CHUNK, PAD, dtype=np.int16)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def _convolve(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks x positions x filters is never kept for more than a block; gives maxima and places."""
    positions = (CHUNK - WIDTH) // STRIDE + 1
    out = np.take(model.filters[0], x[:, 0 : positions * STRIDE : STRIDE], axis=0)
    for k in range(1, WIDTH):
        out += np.take(model.filters[k], x[:, k : k + positions * STRIDE : STRIDE], axis=0)
    return out.max(axis=1) + model.bias, out


def chunk_logits(model: Model, x: np.ndarray) -> np.ndarray:
    out = []
    for a in range(0, len(x), BLOCK):
        pooled = np.maximum(_convolve(model, x[a : a + BLOCK])[0], 0)
        hidden = np.maximum(pooled @ model.w1 + model.b1, 0)
        out.append(hidden @ model.w2 + model.b2)
    return np.concatenate(out)


def _combined(logits: np.ndarray) -> np.ndarray:
    return np.array([logits.mean(), logits.min(), logits.max(), 1.0])


def probability(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def score_texts(model: Model, texts) -> np.ndarray:
    """One probability per text. Chunks of several texts are run together, in bounded blocks."""
    scores, held, owners = np.empty(len(texts)), [], []
    size = 0

    def flush() -> None:
        if held:
            logits = chunk_logits(model, np.concatenate(held) if len(held) > 1 else held[0])
            at = 0
            for i, x in zip(owners, held):
                scores[i] = _combined(logits[at : at + len(x)]) @ model.combine
                at += len(x)
            held.clear()
            owners.clear()

    for i, text in enumerate(texts):
        x = chunks((text or "").encode("utf-8", "replace"))
        held.append(x)
        owners.append(i)
        size += len(x)
        if size >= BLOCK:
            flush()
            size = 0
    flush()
    return probability(scores)


def fit(texts: list[str], labels: np.ndarray, seed: int = 7, steps: int = STEPS) -> Model:
    """Adam on chunks drawn evenly from both classes; then the combination on whole documents."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.15, (WIDTH, 257, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32),
        np.zeros(HIDDEN, np.float32),
        rng.normal(0, 0.3, HIDDEN).astype(np.float32),
        0.0,
        np.array([1.0, 0.0, 0.0, 0.0]),
    )
    labels = np.asarray(labels, dtype=np.float64)
    present = [np.flatnonzero(labels == c) for c in (0, 1)]
    if not all(len(p) for p in present):  # nothing to tell apart: a constant, the share of label 1
        share = (labels.sum() + 1.0) / (len(labels) + 2.0)
        model.combine = np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))])
        return model
    cut = [chunks((t or "").encode("utf-8", "replace")).copy() for t in texts]
    names = ("filters", "bias", "w1", "b1", "w2")
    first = {n: np.zeros_like(getattr(model, n)) for n in names}
    second = {n: np.zeros_like(getattr(model, n)) for n in names}
    for step in range(1, steps + 1):
        docs = np.concatenate([rng.choice(p, BATCH // 2) for p in present])
        x = np.stack([cut[d][rng.integers(len(cut[d]))] for d in docs])
        y = labels[docs].astype(np.float32)
        pooled, full = _convolve(model, x)
        place = full.argmax(axis=1)
        a0 = np.maximum(pooled, 0)
        h = a0 @ model.w1 + model.b1
        a1 = np.maximum(h, 0)
        d = (probability(a1 @ model.w2 + model.b2) - y).astype(np.float32) / len(y)
        dh = np.outer(d, model.w2) * (h > 0)
        dp = (dh @ model.w1.T) * (pooled > 0)
        grad = {"w2": a1.T @ d, "w1": a0.T @ dh, "b1": dh.sum(0), "bias": dp.sum(0)}
        grad["filters"] = np.zeros_like(model.filters)
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        for k in range(WIDTH):
            np.add.at(grad["filters"][k], (x[rows, place * STRIDE + k], np.broadcast_to(cols, place.shape)), dp)
        rate = 0.01 * (1 - 0.9 * step / steps)
        model.b2 -= rate * float(d.sum())
        for n in names:
            first[n] = 0.9 * first[n] + 0.1 * grad[n]
            second[n] = 0.999 * second[n] + 0.001 * grad[n] ** 2
            move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
            getattr(model, n)[...] -= rate * move
    model.combine = _fit_combination(np.stack([_combined(chunk_logits(model, x)) for x in cut]), labels)
    return model


def _fit_combination(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.array([0.5, 0.0, 0.0, 0.0])
    for _ in range(rounds):
        p = probability(x @ w)
        grad = x.T @ (p - y) / len(y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(4)
        move = np.linalg.solve(hess, grad)
        w = w - move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """The rows that no model is fitted on; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, per_class: int = SAMPLE_PER_CLASS
) -> DataFrame:
    """At most ``per_class`` labelled rows of either class, by a hash order, with their texts.

    The ids are picked from the labels alone, so at most ``2 * per_class`` ids are broadcast to
    the scan of the texts. Held-out ids, null labels and null ids take no part.
    """
    usable = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).filter(
        F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id"))
    )
    order = [F.xxhash64(F.lit("quality"), "_id"), F.col("_id"), F.col("_label")]
    picked = [usable.filter(F.col("_label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return found.join(F.broadcast(ids), "_id").select("_id", "_label", "_text")


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality"):
    """Fit on the driver, on the bounded sample of :func:`training_rows` in the order of ids."""
    rows = training_rows(docs, labels, doc_id, text, label).orderBy("_id", "_label", "_text").collect()
    share = usable_share(labels, doc_id, label)
    model = fit([r["_text"] for r in rows], np.array([r["_label"] for r in rows]))
    drawn = np.mean([r["_label"] for r in rows]) if rows else 0.5
    if 0 < drawn < 1 and 0 < share < 1:  # the sample is evened out; the probability follows all labels
        model.combine[3] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return model


def usable_share(labels: DataFrame, doc_id: str, label: str) -> float:
    """Share of label 1 among all rows that may be fitted on; 0.5 where there are none."""
    usable = labels.filter(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)) & F.col(label).isin(0, 1))
    return usable.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5


def scorer(spark, model: Model):
    """A function from a text column to the probability of label 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(score_texts(shared.value, s.to_list()), index=s.index)

    return lambda text: score(F.coalesce(text.cast("string"), F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``held_out``; columns of those names are replaced."""
    score = scorer(docs.sparkSession, train(docs, labels, doc_id, text))
    out = docs.withColumn("score", score(F.col(text)))
    return out.withColumns(
        {
            "predicted": (F.col("score") >= THRESHOLD).cast("int"),
            "held_out": held_out(F.col(doc_id)),
        }
    )
