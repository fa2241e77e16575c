"""Token ids as raw binary shards with a minimal perfect hash index over the document keys.

Files below one folder:

``payload-SSSSS.ids``   raw little-endian ids of the documents of shard S in ascending key order,
                        two bytes an id if the vocabulary has at most 65,536 entries, else four
``payload-SSSSS.off``   little-endian unsigned 64-bit: where each document begins, and the end
``index-BBBBB.mph``     the index of the keys of bucket B (see :class:`PerfectHash`)
``shards.parquet``      shard, documents, ids, and ids of all shards before it

An index maps a key to (shard, document number in the shard, number of documents with that key)
behind a stored fingerprint: a bucket by hash, a few bit tests, one table row. Files are written
under a name of the attempt and renamed, so a task that runs twice leaves one file.

Keys: any type that orders and hashes in Spark. Documents with a null key come first and are in the
payload but not in the index. Documents with equal keys lie together in one shard, in the order of
their texts. Null and empty texts hold the end id alone. Empty tables give no shard.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from epochwise.llm.byte_bpe import byte_alphabet
from epochwise.session import materialise

KEYS_PER_BUCKET = 20_000
CACHE_WORDS = 400_000
#: Letters of one piece whatever stands beside them, and what may follow them.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("number", "<u8"), ("count", "<u4")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays: a key sits at the first level where it hashes to a place of its own.

    Its number is the count of set bits before that place, so the numbers are 0..n-1 without a
    gap. About three bits a key and under two levels a look-up. A key that was never stored gets
    some number too, which the fingerprint gives away.
    """

    GAMMA = 2

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = []
        total = 0
        for bits in levels:
            ones = np.cumsum(bits, dtype=np.int64)
            self.before.append(np.concatenate([[0], ones[:-1]]) + total if len(bits) else ones)
            total += int(ones[-1]) if len(bits) else 0
        self.size = total

    @staticmethod
    def place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (_mix(hashes ^ salt) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        """``hashes``: distinct 64-bit values."""
        levels, rest = [], hashes
        while len(rest):
            size = max(64, cls.GAMMA * len(rest))
            at = cls.place(rest, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """-1 where no level has the key."""
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        for level, bits in enumerate(self.levels):
            at = self.place(hashes[todo], level, len(bits))
            hit = bits[at]
            out[todo[hit]] = self.before[level][at[hit]]
            todo = todo[~hit]
        return out

    def dump(self) -> bytes:
        head = struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(b)) for b in self.levels)
        return head + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> tuple[PerfectHash, int]:
        """The function and how many bytes it took."""
        (count,) = struct.unpack_from("<I", raw)
        sizes = struct.unpack_from(f"<{count}Q", raw, 4)
        at, levels = 4 + 8 * count, []
        for size in sizes:
            packed = np.frombuffer(raw, np.uint8, -(-size // 8), at)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        return cls(levels), at


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes + np.uint64(0xD1B54A32D192ED03)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def dump_index(hashes: np.ndarray, shard: np.ndarray, number: np.ndarray, count: np.ndarray) -> bytes:
    mph = PerfectHash.build(hashes)
    table = np.zeros(len(hashes), ENTRY)
    at = mph.number(hashes)
    for name, values in (("print", _fingerprint(hashes)), ("shard", shard), ("number", number), ("count", count)):
        table[name][at] = values
    return mph.dump() + table.tobytes()


def look_up(raw: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``hashes`` are stored, their entries)."""
    mph, at = PerfectHash.load(raw)
    table = np.frombuffer(raw, ENTRY, mph.size, at)
    number = mph.number(hashes)
    known = np.flatnonzero(number >= 0)
    entries = table[number[known]]
    same = entries["print"] == _fingerprint(hashes[known])
    return known[same], entries[same]


def _fs(path: str):
    """File system and path in it; also for the stores that pyarrow opens by their address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(path: str, parts) -> None:
    store, name = _fs(path)
    store.create_dir(os.path.dirname(name), recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    store.move(draft, name)


class _Words(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = self.encode(word)
        return out


class WordEncoder:
    """Packed ids of whole texts from a tokenizer whose tokens never cross white space.

    As in the library's plain call, the strings of its special tokens get their ids wherever they stand.

    Such a tokenizer gives the same ids for a text and for its words one by one, so words that are
    cut at plain spaces and line feeds are encoded by the library once and cached. Where it also
    lower-cases and cuts Latin letters from punctuation, which is tried once, the library's model is
    asked for the lower-case letters alone, which many words share.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.kind, self.tokenizer = kind, Tokenizer.from_file(path)
        self.alphabet = byte_alphabet()
        self.stems, self.marks, self.words = _Words(self._model), _Words(self._library), _Words(self.encode_word)
        self.plain = self._cuts_letters()

    def _cuts_letters(self) -> bool:
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normal is None or cut is None:
            return False
        pieces = [p for p, _ in cut.pre_tokenize_str(normal.normalize_str("\u00c9Tabc,.!"))]
        return pieces == [self._mapped("\u00e9tabc"), ",.!"]

    def _mapped(self, word: str) -> str:
        return word if word.isascii() else "".join(map(self.alphabet.__getitem__, word.encode()))

    def _model(self, stem: str) -> bytes:
        return np.array([t.id for t in self.tokenizer.model.tokenize(self._mapped(stem))], self.kind).tobytes()

    def _library(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()

    def encode_word(self, word: str) -> bytes:
        """Ids of a text without white space."""
        plain = _PLAIN.fullmatch(word) if self.plain else None
        if not plain:
            return self._library(word)
        return self.stems[plain[1].lower()] + self.marks[plain[2]]

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.words.__getitem__, (text or "").replace("\n", " ").split(" ")))


_encoders: dict[tuple[str, str], WordEncoder] = {}


def _encoder(path: str, kind: str) -> WordEncoder:
    if (path, kind) not in _encoders:
        _encoders[path, kind] = WordEncoder(path, kind)
    return _encoders[path, kind]


def id_kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write(
    docs: DataFrame, key: str, text: str, path: str, tokenizer_path: str, end_id: int, vocabulary: int,
    shards: int | None = None,
) -> DataFrame:
    """Write payloads, index and manifest below ``path``; gives the manifest.

    The texts are shuffled once, by ranges of keys; each task streams one shard to its file.
    """
    spark = docs.sparkSession
    kind = id_kind(vocabulary)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(shards, F.col("key").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    schema = T.StructType(
        [
            rows.schema["key"],
            T.StructField("shard", T.IntegerType()),
            T.StructField("number", T.LongType()),
            T.StructField("n_ids", T.LongType()),
        ]
    )
    end = np.array([end_id], kind).tobytes()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, kind)
        shard = TaskContext.get().partitionId()
        fs, name = _fs(f"{path}/payload-{shard:05d}.ids")
        fs.create_dir(os.path.dirname(name), recursive=True)
        draft, out = f"{name}.{uuid.uuid4().hex}", None
        begin, wide = [0], np.dtype(kind).itemsize
        for batch in batches:
            out = out or fs.open_output_stream(draft)
            first = len(begin) - 1
            for value in batch.column("text"):
                ids = encoder.encode(value.as_py())
                out.write(ids)
                out.write(end)
                begin.append(begin[-1] + len(ids) // wide + 1)
            sizes = np.diff(begin[first:])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(np.full(len(sizes), shard), pa.int32()),
                    pa.array(np.arange(first, first + len(sizes)), pa.int64()),
                    pa.array(sizes, pa.int64()),
                ],
                names=schema.names,
            )
        if out:
            out.close()
            fs.move(draft, name)
            _put(f"{path}/payload-{shard:05d}.off", [np.array(begin, "<u8").tobytes()])

    entries = materialise(rows.mapInArrow(store, schema), "token-entries")
    totals = entries.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_ids").alias("n_ids"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    manifest = totals.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(upto), F.lit(0)))
    manifest.write.parquet(f"{path}/shards.parquet")
    _write_index(entries, path)
    return spark.read.parquet(f"{path}/shards.parquet")


def bucket_count(path: str, spark) -> int:
    """Buckets of the index, from the number of documents in the manifest."""
    docs = spark.read.parquet(f"{path}/shards.parquet").agg(F.sum("n_docs")).first()[0] or 0
    return max(1, -(-docs // KEYS_PER_BUCKET))


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    h = F.xxhash64("key")
    return keys.withColumn("hash", h).withColumn("bucket", F.pmod(F.xxhash64(h, F.lit("bucket")), F.lit(buckets)).cast("int"))


def _write_index(entries: DataFrame, path: str) -> None:
    per_key = entries.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("shard").alias("shard"), F.min("number").alias("number"), F.count("*").alias("count")
    )
    hashed = _hashed(per_key, bucket_count(path, entries.sparkSession))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(group["bucket"].iloc[0])
        hashes = group["hash"].to_numpy(np.int64).view(np.uint64)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys have the same 64-bit hash")
        _put(f"{path}/index-{bucket:05d}.mph", [dump_index(hashes, *(group[c].to_numpy() for c in ("shard", "number", "count")))])
        return pd.DataFrame({"bucket": [bucket], "n": [len(group)]})

    made = hashed.select("hash", "bucket", "shard", "number", "count").groupBy("bucket")
    made.applyInPandas(build, "bucket int, n long").agg(F.sum("n")).first()


def read(path: str, keys: DataFrame, key: str, vocabulary: int) -> DataFrame:
    """(key, start, n_tokens, ids) of every stored document with one of the ``keys``.

    ``start``: ids of all documents before it; ``ids``: as stored. Each distinct key is looked up
    in the index; keys that aren't stored, and null, have no row.
    """
    spark = keys.sparkSession
    kind = id_kind(vocabulary)
    wanted = keys.select(F.col(key).alias("key")).filter(F.col("key").isNotNull()).distinct()
    hashed = _hashed(wanted, bucket_count(path, spark))
    place = T.StructType(
        [
            wanted.schema["key"],
            T.StructField("shard", T.IntegerType()),
            T.StructField("number", T.LongType()),
            T.StructField("count", T.LongType()),
        ]
    )

    def find(group: pd.DataFrame) -> pd.DataFrame:
        store, name = _fs(f"{path}/index-{int(group['bucket'].iloc[0]):05d}.mph")
        with store.open_input_file(name) as f:
            raw = f.read()
        known, entries = look_up(raw, group["hash"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame(
            {"key": group["key"].iloc[known].to_numpy()} | {c: entries[c].astype(np.int64) for c in ("shard", "number", "count")}
        )

    places = hashed.groupBy("bucket").applyInPandas(find, place)
    base = spark.read.parquet(f"{path}/shards.parquet").select("shard", "ids_before")
    placed = places.join(base, "shard").withColumn("part", F.floor(F.col("number") / 4096).cast("int"))
    out = T.StructType(
        [
            wanted.schema["key"],
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, open_shard, payload, offsets = np.dtype(kind).itemsize, None, None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512).to_pydict()
                cols = [[], [], [], []]
                for key, shard, number, count, before in zip(*(rows[c] for c in ("key", "shard", "number", "count", "ids_before"))):
                    if shard != open_shard:
                        store, name = _fs(f"{path}/payload-{shard:05d}")
                        payload, offsets = store.open_input_file(name + ".ids"), store.open_input_file(name + ".off")
                        open_shard = shard
                    begin = np.frombuffer(offsets.read_at(8 * (count + 1), 8 * number), "<u8").astype(np.int64)
                    for a, z in zip(begin[:-1], begin[1:]):
                        for c, v in zip(cols, (key, before + a, z - a, payload.read_at(int(z - a) * wide, int(a) * wide))):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], batch.schema.field("key").type)]
                    + [pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.binary()))],
                    names=out.names,
                )

    # a task reads stretches of 4,096 documents, each from one shard and in order
    near = placed.repartition("shard", "part").sortWithinPartitions("shard", "number")
    return near.select("key", "shard", "number", "count", "ids_before").mapInArrow(fetch, out)


def crc_of_ids(ids, vocabulary: int):
    """Unsigned CRC-32 of the ids as unsigned 32-bit integers, whatever width they are stored in."""
    kind = id_kind(vocabulary)

    @F.pandas_udf("bigint")
    def crc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([zlib.crc32(np.frombuffer(b, kind).astype("<u4").tobytes()) for b in s], index=s.index)

    return crc(ids)
