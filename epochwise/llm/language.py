"""Language identification by Bayesian fusion of evidence.

The posterior of a record adds, per language, the logarithms of
* the likelihood of its text under hashed byte trigrams counted over all labelled documents, whose
  weight grows slowly with the length, as neighbouring trigrams aren't independent,
* the likelihood of the language that its markup declares, estimated from all records,
* the prior of its host, smoothed by that of its domain, that by its address suffix, and that by
  the whole. The counts are grouped sums of the posteriors from the text alone; a record's own
  share is taken out of its host's.

Nulls: a null or empty text says nothing, so the other evidence decides, or the prior of the
whole. A null or odd address has no host; such records get the prior of the whole. Repeated rows
count as often as they occur. Without labelled documents, or without records, there are no rows.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.session import materialise

BINS = 1 << 14
#: Languages that the model may hold; its size is that times BINS.
MOST_LANGUAGES = 256
ADD = 0.5
#: Pseudo-counts of each level's parent, and of the declared language.
STRENGTH, DECLARED_STRENGTH = 5.0, 2.0
#: A text of n trigrams weighs WEIGHT * ln(1 + n / WEIGHT) of them.
WEIGHT = 40.0
BLOCK = 1 << 16

_HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>")
_DECLARED = r"""(?i)<html[^>]*\blang\s*=\s*["']?\s*([a-z]{2,3})\b"""
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"


def visible_text(page: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags."""

    @F.pandas_udf("string")
    def strip(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in pages:
            yield pd.Series([html.unescape(_HIDDEN.sub(" ", p)) for p in s], index=s.index, dtype=object)

    return strip(F.coalesce(page, F.lit("")))


def declared(page: Column) -> Column:
    found = F.lower(F.regexp_extract(page, _DECLARED, 1))
    return F.when(found != "", found)


def host(url: Column) -> Column:
    found = F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit("."))
    return F.when(found != "", found)


def _bins(text: str) -> Iterator[np.ndarray]:
    """Bins of the byte trigrams of the lower-case text between spaces, in blocks."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    code = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) if text else raw[:0]
    for at in range(0, len(code), BLOCK):
        yield code[at : at + BLOCK] * np.uint32(2654435761) >> np.uint32(18)


def trigram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bin, n) over all labelled documents; each batch is counted before it is sent on."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                to = sums.setdefault(lang.as_py(), np.zeros(BINS, np.int64))
                for b in _bins(text.as_py()):
                    to += np.bincount(b, minlength=BINS)
            for name, c in sums.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())],
                    names=["lang", "bin", "n"],
                )

    return rows.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def model(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities of BINS x languages."""
    counts = materialise(trigram_counts(docs, text, lang), "trigrams")
    langs = [r[0] for r in counts.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.full((BINS, max(1, len(langs))), ADD)
    place = {name: i for i, name in enumerate(langs)}
    for r in counts.collect():  # BINS rows a language at most
        table[r["bin"], place[r["lang"]]] += r["n"]
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def text_evidence(text: Column, langs: list[str], table: np.ndarray, spark) -> Column:
    """Log-likelihood of each language, weighted by the length; zeros for an empty text."""
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("array<double>")
    def evidence(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        logp = shared.value
        for s in texts:
            out = []
            for t in s:
                total, n = np.zeros(len(langs)), 0
                for b in _bins(t):
                    total += logp[b].sum(0, dtype=np.float64)
                    n += len(b)
                out.append(total / n * WEIGHT * np.log1p(n / WEIGHT) if n else total)
            yield pd.Series(out, index=s.index, dtype=object)

    return evidence(F.coalesce(text, F.lit("")))


def _normalised(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    weights = [F.exp(x - top) for x in logs]
    total = functools.reduce(lambda a, b: a + b, weights)
    return [w / total for w in weights]


def _smoothed(counts: list[Column], parent: list[Column]) -> list[Column]:
    total = functools.reduce(lambda a, b: a + b, counts)
    return [(c + F.lit(STRENGTH) * p) / (total + STRENGTH) for c, p in zip(counts, parent)]


def fuse(records: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """``records`` (key columns, text, markup, host) with lang, probability and text_lang.

    A record with no host takes the prior of the whole. Hosts, domains and suffixes are
    summed before any shuffle, and hosts are joined on a key that adaptive execution may split.
    """
    n = len(langs)
    keys = [c for c in records.columns if c not in ("text", "markup", "host")]
    if not n:
        return records.select(*keys).limit(0).selectExpr("*", "'' lang", "0D probability", "'' text_lang")
    seen = records.select(
        *keys, "markup", "host", text_evidence(F.col("text"), langs, table, records.sparkSession).alias("e")
    )
    seen = materialise(seen, "language-evidence")
    post = _normalised([F.col("e")[i] for i in range(n)])
    seen = seen.select("*", *[p.alias(f"p{i}") for i, p in enumerate(post)])
    p, sums = [f"p{i}" for i in range(n)], lambda of: [F.sum(c).alias(c) for c in of]

    labels = F.split("host", r"\.")
    named = F.size(labels) > 1
    per_host = seen.filter(F.col("host").isNotNull()).groupBy("host").agg(*sums(p))
    per_host = per_host.select(
        "host", *p,
        F.when(named, F.concat_ws(".", F.slice(labels, -2, 2))).alias("domain"),
        F.when(named, F.element_at(labels, -1)).alias("suffix"),
    )
    per_host = materialise(per_host, "language-hosts")
    whole = seen.agg(*sums(p)).first()
    mass = [float(whole[c] or 0) + 1.0 for c in p]
    root = [F.lit(m / sum(mass)) for m in mass]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))

    def level(key: str, parent_key: str | None, parent: DataFrame | None) -> DataFrame:
        """(key, q0..): the smoothed prior of each value of ``key``."""
        own = per_host.filter(F.col(key).isNotNull()).groupBy(key, *([parent_key] if parent_key else [])).agg(*sums(p))
        if parent is None:
            above, rows = root, own
        else:
            rows = own.join(parent.select(parent_key, *[F.col(f"q{i}").alias(f"a{i}") for i in range(n)]), parent_key)
            above = [F.col(f"a{i}") for i in range(n)]
        q = _smoothed([F.col(c) for c in p], above)
        return rows.select(key, *[x.alias(f"q{i}") for i, x in enumerate(q)])

    suffix = level("suffix", None, None)
    domain = level("domain", "suffix", suffix)
    hosts = per_host.select("host", "domain", *[F.col(c).alias(f"h{i}") for i, c in enumerate(p)])
    hosts = hosts.join(domain, "domain", "left").select(
        F.col("host").alias("_host"), *[f"h{i}" for i in range(n)],
        *[F.coalesce(F.col(f"q{i}"), root[i]).alias(f"q{i}") for i in range(n)],
    )

    # what the markup declares, against the language of the text; two or three letters, so few values
    told = seen.filter(F.col("markup").isNotNull()).groupBy("markup").agg(*sums(p))
    all_told = told.agg(*sums(p)).first()
    told_mass = [float(all_told[c] or 0) for c in p]
    share = functools.reduce(lambda a, b: a + b, [F.col(c) for c in p]) / F.lit(max(sum(told_mass), 1e-9))
    told = told.select(
        F.col("markup").alias("_markup"),
        *[
            F.log((F.col(c) + DECLARED_STRENGTH * share) / F.lit(told_mass[i] + DECLARED_STRENGTH)).alias(f"m{i}")
            for i, c in enumerate(p)
        ],
    )
    joined = seen.join(F.broadcast(told), seen["markup"] == told["_markup"], "left")
    joined = joined.join(hosts, joined["host"] == hosts["_host"], "left")
    others = [F.greatest(zero(f"h{i}") - F.col(f"p{i}"), F.lit(0.0)) for i in range(n)]
    parent = [F.coalesce(F.col(f"q{i}"), root[i]) for i in range(n)]
    prior = _smoothed(others, parent)
    logs = [F.col("e")[i] + zero(f"m{i}") + F.log(prior[i]) for i in range(n)]
    final = joined.select(*keys, "e", F.array(*_normalised(logs)).alias("_post"))
    name = F.array(*[F.lit(x) for x in langs])
    best = F.array_max("_post")
    return final.select(
        *keys,
        F.element_at(name, F.array_position("_post", best).cast("int")).alias("lang"),
        best.alias("probability"),
        F.element_at(name, F.array_position("e", F.array_max("e")).cast("int")).alias("text_lang"),
    )


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    return pages.select(
        F.col(page_id).alias("page_id"),
        visible_text(F.col(page)).alias("text"),
        declared(F.col(page)).alias("markup"),
        host(F.col(url)).alias("host"),
    )
