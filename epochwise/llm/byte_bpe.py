"""Byte-level BPE through a sentencepiece model that is serialised straight from the rank table.

Every byte is mapped to one printable character, so each token of the rank table becomes a
sentencepiece piece; its score is the negative rank and the normaliser is the identity. No
training takes place. Texts are cut by the given pattern, each match is encoded on its own and the
piece ids are mapped back to ranks; decoding goes through the pieces and the inverse byte map.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The cache of encoded words is emptied at this size, which bounds a worker's memory.
CACHE_WORDS = 400_000
#: A space after white space: there the cut at single spaces is not a match boundary.
_WIDE_SPACE = re.compile(r"\s ")


def byte_alphabet() -> list[str]:
    """One printable character per byte: itself where printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model file: piece 0 is unknown (it can't occur), piece ``r + 1`` is the token of rank r."""
    alphabet = byte_alphabet()
    ordered = sorted(ranks.items(), key=lambda kv: kv[1])
    if [r for _, r in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0..n-1")
    # fixed values: field numbers and enums of the sentencepiece model format
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, "\ue000".encode()) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _flag(3, unknown))]
    for token, rank in ordered:
        piece = "".join(map(alphabet.__getitem__, token)).encode()
        score = _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
        pieces.append(_field(1, _field(1, piece) + score + _flag(3, normal)))
    trainer = _flag(3, bpe) + _flag(4, len(pieces))
    normalizer = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class _Words(dict):
    """Encoded words by text; what isn't there is encoded and kept."""

    def __init__(self, encode, prefix: str):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = self.encode(self.prefix + word)
        return out


class Codec:
    """Encoder and decoder of one serialised model and one pre-token pattern."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(self.alphabet)}
        names = [self.pieces.id_to_piece(i) for i in range(1, self.pieces.get_piece_size())]
        self.bytes_of = [bytes(map(back.__getitem__, n)) for n in names]
        self.rank_of = {t: r for r, t in enumerate(self.bytes_of)}
        self.first, self.spaced = _Words(self._span, ""), _Words(self._span, " ")

    def _span(self, text: str) -> bytes:
        ids: list[int] = []
        for token in self.split(text):
            raw = token.encode()
            whole = self.rank_of.get(raw)
            if whole is not None:
                ids.append(whole)
            else:
                mapped = "".join(map(self.alphabet.__getitem__, raw))
                ids += [i - 1 for i in self.pieces.encode(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A single space after a visible character always starts a match of the pattern, so words
        cut there are encoded on their own and cached.
        """
        if _WIDE_SPACE.search(text):
            return self._span(text)
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


_codecs: dict[tuple[int, str], Codec] = {}  # of this worker; the last one only


def _codec(model, pattern: str) -> Codec:
    key = (hash(model.value), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model.value, pattern)
    return _codecs[key]


def encoder(spark, ranks_path: str, pattern: str):
    """A function from a text column to packed ids (binary, little-endian unsigned 32-bit).

    A null text counts as empty and gives no ids. The model, whose size is that of the
    vocabulary, is broadcast, so executors need no file.
    """
    model = spark.sparkContext.broadcast(serialise(read_ranks(ranks_path)))

    @F.pandas_udf("binary")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(model, pattern)
        for s in texts:
            yield pd.Series([codec.encode(t) for t in s], index=s.index, dtype=object)

    def column(text: Column) -> Column:
        return encode(F.coalesce(text.cast("string"), F.lit("")))

    return column


def decoder(spark, ranks_path: str, pattern: str):
    """A function from packed ids to the bytes they stand for; null ids give empty bytes."""
    model = spark.sparkContext.broadcast(serialise(read_ranks(ranks_path)))

    @F.pandas_udf("binary")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(model, pattern)
        for s in ids:
            yield pd.Series([codec.decode(i) for i in s], index=s.index, dtype=object)

    def column(ids: Column) -> Column:
        return decode(F.coalesce(ids, F.lit(b"")))

    return column


def round_trip(df, text: str, ranks_path: str, pattern: str):
    """``df`` with ``ids`` and ``decoded`` (binary); columns of those names are replaced.

    Both come from one pass, so that one worker process holds one model.
    """
    model = df.sparkSession.sparkContext.broadcast(serialise(read_ranks(ranks_path)))

    @F.pandas_udf("ids binary, decoded binary")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(model, pattern)
        for s in texts:
            ids = [codec.encode(t) for t in s]
            yield pd.DataFrame({"ids": ids, "decoded": [codec.decode(i) for i in ids]}, index=s.index)

    kept = [c for c in df.columns if c.lower() not in ("ids", "decoded")]
    coded = both(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_coded")
    return df.select(*kept, coded).select(*kept, "_coded.ids", "_coded.decoded")
