"""Secret scans: three base patterns, and a token-efficiency test that exposes random strings.

Natural words, in any case, take few tokens of a public vocabulary for their length; random strings take many. So a run
of at least `min_chars` credential characters whose characters per token lie below `max_ratio` is a span of its own,
unless it is a known digest (hexadecimal, of a digest's length), a UUID or a plain number, or touches a base span. `=` may
stand before a run, as in NAME=value, and belongs to it only as padding at its end.

Spans are in code points, end exclusive, ordered by start and then by kind. Null and empty texts have none; each
repeated row gets its own; texts are scanned whole whatever their length; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeferry.llm.base import narrow_batches, refuse_taken

# The kinds in order, and the patterns of the base kinds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)", re.ASCII)
DIGEST_CHARS = (32, 40, 48, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")

SPANS = "array<struct<kind: string, start: int, end: int>>"


@lru_cache(2)
def tokenizer(vocabulary: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def _candidates(min_chars: int) -> re.Pattern:
    return re.compile(r"(?<![\w+/-])[A-Za-z0-9+/_-]{%d,}+={0,2}+(?![\w+/=-])" % min_chars)


def known(run: str) -> bool:
    """Is it a digest, a UUID or a number?"""
    return len(run) in DIGEST_CHARS and DIGEST.fullmatch(run) is not None or UUID.fullmatch(run) is not None or run.isdigit()


def spans(text: str, encoding: tiktoken.Encoding, min_chars: int, max_ratio: float) -> list[tuple[int, int, str]]:
    found = []
    if any(w in (low := text.encode("utf-8", "replace").lower()) for w in ASSIGN_WORDS) and low:
        # A match with a short value is passed over whole, as leftmost non-overlapping matches are taken first.
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    base = list(found)
    for m in _candidates(min_chars).finditer(text):
        a, b = m.span()
        if known(m[0]) or any(x < b and a < y for x, y, _ in base):
            continue
        if len(m[0]) < max_ratio * len(encoding.encode_ordinary(m[0])):
            found.append((a, b, 3))
    return sorted(found, key=lambda x: (x[0], x[2]))


class SecretScan:
    """vocabulary: path of a rank file, read once by the driver (its size is checked) and sent to the executors."""

    def __init__(self, spark: SparkSession, vocabulary: str, pattern: str, min_chars: int = 20, max_ratio: float = 1.75, max_bytes: int = 16_000_000):
        with open(vocabulary, "rb") as f:
            data = f.read(max_bytes + 1)
        if len(data) > max_bytes:
            raise ValueError(f"{vocabulary} has over {max_bytes} bytes")
        narrow_batches(spark)
        sent = spark.sparkContext.broadcast(data)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        @F.arrow_udf(SPANS)
        def scan(texts: pa.Array) -> pa.Array:
            encoding = tokenizer(sent.value, pattern)
            return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans(t or "", encoding, min_chars, max_ratio)] for t in texts.to_pylist()], kind)

        self._scan = scan

    def __call__(self, text: Column) -> Column:
        return self._scan(text)


def find_secrets(df: DataFrame, scan: SecretScan, text_col: str = "text", spans_col: str = "secret_spans") -> DataFrame:
    """df with a column of spans, which it must not have already."""
    refuse_taken(df, spans_col)
    return df.withColumn(spans_col, scan(F.col(f"`{text_col}`").cast("string")))


def report(df: DataFrame, scan: SecretScan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans and all spans as text."""
    rows = find_secrets(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), scan)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.filter("secret_spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )
