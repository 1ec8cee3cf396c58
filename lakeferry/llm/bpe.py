"""Byte-level BPE by a sentencepiece model that is written out directly from a rank file.

The model holds one piece for each rank: the token's bytes, each byte as one printable character, scored by the
negative rank. Merging the best-scored neighbours is then merging the lowest rank, which is how the rank file
is meant. Normalisation is the identity. Texts are first split by the vocabulary's pattern, and each match is
encoded on its own; ids are ranks. Decoding maps pieces back to bytes.

Nulls are empty texts and have no ids; an empty id list decodes to no bytes; a null id list too. Unknown ids
raise KeyError. Repeated rows are encoded each; other columns pass through untouched. A text of any length is
encoded whole.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeferry.llm.base import narrow_batches, refuse_taken, tidy

#: Pre-tokens of up to so many characters are remembered, and about so many of them at once.
CACHED_CHARS, CACHED = 40, 250_000
#: Characters of texts whose pre-tokens are held at once; a longer text is held alone.
TOGETHER = 1_000_000
#: Rows of an Arrow batch: ids take far more room as Python integers than texts do.
ROWS = 500


@lru_cache(1)
def byte_chars() -> dict[int, str]:
    """A printable character for each byte: itself where it prints in Latin-1, else the next free one from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: a varint, a 32-bit float or bytes."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece k is the token of rank k; the unknown piece, which it must have, comes last."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("each single byte must have a rank")
    chars, unknown = byte_chars(), len(ranks)
    normal, unk, bpe = 1, 2, 2
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, normal))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unk))
    trainer = _field(3, bpe) + _field(4, unknown + 1) + _field(40, unknown) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class Codec:
    """Encodes and decodes in one process."""

    def __init__(self, vocabulary: bytes, pattern: str):
        ranks = read_ranks(vocabulary)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.split = regex.compile(pattern).findall
        self.table = str.maketrans({chr(b): c for b, c in byte_chars().items()})
        back = {c: b for b, c in byte_chars().items()}
        self.bytes_of = {k: bytes(back[c] for c in self.model.id_to_piece(k)) for k in range(len(ranks))}
        tokens = sorted(ranks, key=ranks.get)
        # A token that no merges lead to is still one token where it is a whole match.
        self.whole = {t: [k] for k, (t, ids) in enumerate(zip(tokens, self._merged(tokens), strict=True)) if ids != [k]}
        self.known: dict[str, tuple[int, ...]] = {}
        self.ints = list(range(len(ranks) + 1))  # one object for each id, whatever holds it

    def _merged(self, pieces: list[bytes]) -> list[list[int]]:
        return self.model.encode([p.decode("latin-1").translate(self.table) for p in pieces], out_type=int, num_threads=1)

    def _learn(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        raw, shared = [p.encode() for p in pieces], self.ints.__getitem__
        return {p: tuple(map(shared, self.whole.get(r, ids))) for p, r, ids in zip(pieces, raw, self._merged(raw), strict=True)}

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Sequence[str]) -> Iterator[list[int]]:
        """The ids of each text. New pre-tokens of several texts are merged at once; texts are taken together up to TOGETHER characters."""
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= TOGETHER:
                size += len(texts[end])
                end += 1
            pieces = [self.split(t) for t in texts[at:end]]
            all_pieces = set().union(*pieces)
            new = all_pieces.difference(self.known)
            if len(self.known) + len(new) > CACHED:  # what is seen again just now is likely to be common
                self.known = {p: self.known[p] for p in all_pieces.intersection(self.known)}
            if new:
                self.known.update(self._learn(list(new)))
            ids = self.known.__getitem__
            for own in pieces:
                yield list(chain.from_iterable(map(ids, own)))
            for p in new:
                if len(p) > CACHED_CHARS:
                    del self.known[p]
            at = end

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def packed(ids: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


@lru_cache(2)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(vocabulary, pattern)


class ByteBPE:
    """The operator: columns of texts to columns of ids, and back.

    vocabulary: path of a rank file in tiktoken's format, read once by the driver and sent to the executors; its
    size is checked against max_bytes. pattern: what splits texts before merging.
    """

    def __init__(self, spark: SparkSession, vocabulary: str, pattern: str, max_bytes: int = 16_000_000):
        with open(vocabulary, "rb") as f:
            data = f.read(max_bytes + 1)
        if len(data) > max_bytes:
            raise ValueError(f"{vocabulary} has over {max_bytes} bytes")
        narrow_batches(spark, ROWS)
        sent = spark.sparkContext.broadcast(data)

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            own = codec(sent.value, pattern)
            return packed([np.array(x, np.int32) for x in own.encode_all([t or "" for t in texts.to_pylist()])])

        @F.arrow_udf("binary")
        def decode(ids: pa.Array) -> pa.Array:
            own, values, at = codec(sent.value, pattern), ids.values, ids.offsets.to_pylist()
            return pa.array([own.decode(values.slice(a, b - a).to_numpy(zero_copy_only=False).tolist()) for a, b in zip(at, at[1:], strict=False)], pa.binary())

        @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
        def both(texts: pa.Array) -> pa.Array:
            own, ids, back = codec(sent.value, pattern), [], []
            for x in own.encode_all([t or "" for t in texts.to_pylist()]):
                ids.append(np.array(x, np.int32))
                back.append(own.decode(x))
            out = pa.StructArray.from_arrays([packed(ids), pa.array(back, pa.binary())], ["ids", "decoded"])
            del ids, back
            tidy()
            return out

        self._encode, self._decode, self._both = encode, decode, both

    def encode(self, text: Column) -> Column:
        """array<int>: the ids of each text."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """binary: the bytes of each id list."""
        return self._decode(F.coalesce(ids, F.array().cast("array<int>")))

    def round_trip(self, text: Column) -> Column:
        """struct<ids, decoded>: the ids of each text, and the bytes that they decode to; both in one Python worker."""
        return self._both(text)


def encoded(df: DataFrame, bpe: ByteBPE, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with a column of ids, which it must not have already."""
    refuse_taken(df, ids_col)
    return df.withColumn(ids_col, bpe.encode(F.col(f"`{text_col}`").cast("string")))


def decoded(df: DataFrame, bpe: ByteBPE, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with a column of the bytes that the ids stand for, which it must not have already."""
    refuse_taken(df, bytes_col)
    return df.withColumn(bytes_col, bpe.decode(F.col(f"`{ids_col}`")))


def digest(df: DataFrame, bpe: ByteBPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, from the ids and the bytes that the operator returns."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), bpe.round_trip(F.col(f"`{text_col}`").cast("string")).alias("found"))
    return rows.select(
        "doc_id",
        F.size("found.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("found.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("found.decoded", 256).alias("decoded_sha256"),
    )
