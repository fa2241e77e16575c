"""Token counts behind a digest cache.

The cache holds one row per (content digest, tokenizer version): the number of tokens. A count takes the
digests of all texts, encodes one text for each distinct digest that the cache lacks, appends those
counts, and joins them back to every row.

* The *content digest* is the SHA-256 of the normalised text. Normalising must not change a count, so
  it follows the tokenizer: where the tokenizer's own definition makes one blank of any white space and
  drops it, runs of ASCII white space become one blank and those at the ends go; else the text
  stays as it is. Letters are never folded (a lower-case letter may compose with a mark
  that its capital doesn't compose with).
* The *tokenizer version* is the SHA-256 of the file, the library, its version and the normalisation,
  so another file, library or rule never meets old counts.

Counts are those of the library's plain call: no begin, end or added special tokens; special strings inside
a text as the library treats them by default; no truncation or padding.

Nulls: a null text is the empty text; a null key is a key like any other. Repeated rows and equal texts
are encoded once and each keep their row. Empty texts have no tokens, very long ones are encoded whole.
Only the key and the text are read, so further columns, whatever their names, are left out. An empty table
gives no rows and appends nothing.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator
from importlib import metadata

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwise.llm.token_files import WordEncoder
from epochwise.session import discard, materialise

CACHE = "digest binary, n_tokens long"
LIMIT = 2048
#: At most so many missing digests (32 bytes each) are sent to all executors to pick their texts.
SENT_DIGESTS = 100_000
#: Words whose counts a worker remembers; twice as many while it changes over.
WORDS = 400_000
LIBRARY = {"json": "tokenizers", "model": "sentencepiece"}


def library(path: str) -> str:
    """The library that reads the tokenizer file at ``path``."""
    kind = path.rpartition(".")[2]
    if kind not in LIBRARY:
        raise ValueError(f"no library for the tokenizer file {path}")
    return LIBRARY[kind]


@functools.cache
def drops_white_space(path: str) -> bool:
    """Whether the tokenizer's definition turns any white space into one blank, and drops that."""
    if library(path) != "tokenizers":
        return False
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    steps = [rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}]
    normal, cut = (s.get("normalizers") or s.get("pretokenizers") or [s] for s in steps)
    one_blank = any(
        s.get("type") == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in normal
    )
    # what lies between the matches is removed, so the pieces must be the matches and hold no blank
    pieces = any(s.get("type") == "Split" and s["behavior"] == "Removed" and s["invert"] for s in cut)
    if not (one_blank and pieces):
        return False
    encode = encoder(path)
    return encode(" a\t\n b,  c\x0b ") == encode("a b, c") and encode(" \n") == 0


def version(path: str) -> str:
    """The digest that names this tokenizer, its library and the normalisation of texts."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    name = library(path)
    digest.update(f"{name} {metadata.version(name)} white space {drops_white_space(path)}".encode())
    return digest.hexdigest()


def encoder(path: str) -> Callable[[str], int]:
    """The number of tokens of a text, by the library's plain call."""
    if library(path) == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


class _Counts(dict):
    """Numbers of tokens of words. When full, what was looked up since the last time is kept."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode, self.before = encode, {}

    def __missing__(self, word: str) -> int:
        count = self.before.get(word)
        if count is None:
            count = len(self.encode(word)) // 4
        if len(self) >= WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = count
        return count


@functools.cache
def _worker(path: str) -> Callable[[str], int]:
    """As ``encoder`` for normalised texts; where white space is dropped, words are encoded once and remembered."""
    if not drops_white_space(path):
        return encoder(path)
    words = _Counts(WordEncoder(path, "<u4").encode_word)
    return lambda text: sum(map(words.__getitem__, text.split(" ")))


def normalised(text: str | None, path: str) -> bytes:
    """The text in UTF-8 as it is digested and encoded."""
    raw = (text or "").encode()
    # bytes are split at the six white-space characters of ASCII
    return b" ".join(raw.split()) if drops_white_space(path) else raw


def digested(docs: DataFrame, text: str, path: str, key: str | None = None) -> DataFrame:
    """(key, n_bytes, digest) for every row of ``docs``; without ``key`` (digest, text), the text normalised."""
    given = F.col(text).cast("string").alias("text")
    rows = docs.select(given) if key is None else docs.select(F.col(key).alias("key"), given)
    fields = [T.StructField("digest", T.BinaryType())]
    if key is None:
        fields += [T.StructField("text", T.StringType())]
    else:
        fields = [rows.schema["key"], T.StructField("n_bytes", T.LongType())] + fields
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            norms = [normalised(t, path) for t in texts]
            digests = pa.array([hashlib.sha256(t).digest() for t in norms], pa.binary())
            if key is None:
                columns = [digests, pa.array(norms, pa.binary()).cast(pa.string())]
            else:
                sizes = pa.array([len((t or "").encode()) for t in texts], pa.int64())
                columns = [batch.column("key"), sizes, digests]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def read_cache(spark: SparkSession, cache_path: str, tokenizer_version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version, each digest once, also where two counts ran side by side."""
    try:
        stored = spark.read.schema(CACHE).parquet(f"{cache_path}/version={tokenizer_version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(
    docs: DataFrame, text: str, keyed: DataFrame, cache_path: str, path: str
) -> int:
    """Append the counts of the digests of ``keyed`` that the cache lacks; gives how many those were.

    The texts of equal digests are combined before they move, so a text that fills a third of all rows
    moves once per task that reads it. Where few digests are missing, only their texts are looked at.
    """
    spark, name = docs.sparkSession, version(path)
    known = read_cache(spark, cache_path, name).select("digest")
    misses = materialise(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "count-misses")
    count = misses.count()
    if count:
        texts = digested(docs, text, path)
        if count <= SENT_DIGESTS:
            texts = texts.join(F.broadcast(misses), "digest", "left_semi")
        todo = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if count > SENT_DIGESTS:
            todo = todo.join(misses, "digest", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = _worker(path)
            for batch in batches:
                counts = [tokens(t.as_py()) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"]
                )

        todo.select("digest", "text").mapInArrow(run, CACHE).write.mode("append").parquet(
            f"{cache_path}/version={name}"
        )
    discard(misses)
    return count


def count_tokens(
    docs: DataFrame, key: str, text: str, cache_path: str, tokenizer_path: str, limit: int = LIMIT
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of ``docs``; new counts are in the cache afterwards."""
    keyed = materialise(digested(docs, text, tokenizer_path, key), "count-digests")
    encode_misses(docs, text, keyed, cache_path, tokenizer_path)
    # stored, so that a digest with very many rows stands directly behind its shuffle and may be split
    counts = materialise(read_cache(docs.sparkSession, cache_path, version(tokenizer_path)), "counts")
    lost = F.raise_error(F.lit("a digest has no count")).cast("bigint")
    n_tokens = F.coalesce("n_tokens", lost)
    joined = keyed.join(counts, "digest", "left")
    joined = joined.select(F.col("key").alias(key), "n_bytes", n_tokens.alias("n_tokens"))
    return joined.withColumn("over_limit", F.col("n_tokens") > limit)
