"""Benchmark decontamination: a hash set of normalised test n-grams, looked up at each window of the training texts.

Words are runs of ASCII letters and digits, lower-cased, and of anything beyond ASCII. A window of an item is `n` consecutive words
of it, or all of its words where they are fewer. The windows of all items form a hash set from window to items,
which is broadcast as long as its measured size stays within `max_broadcast` bytes. A text's windows are looked up where all
of their words occur in windows at all; a lookup compares the words themselves, so that a hit is verified and exact. A
larger set isn't broadcast: windows of both sides then meet in a join, before which a Bloom filter of at most `max_filter` bytes
keeps nearly all windows of texts that are in no item where they are.

Results: for each row the number of words, of hit words (those inside an occurrence of any window), and the ids of items with
an occurring window. Actions: `spans` cuts hit words out of the text, `documents` drops rows with `least_items` items or
more, `annotate` does neither.

A null text has no words; a null item id or item text gives no windows; items that repeat count once by id; ids are compared
as strings; repeated rows are each treated alike; an empty table on either side gives zero counts. Texts are scanned
whole whatever their length. Other columns pass through where the operator returns rows and are ignored otherwise.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lakeferry.llm.base import cut, fresh, keyed, narrow_batches, once, refuse_taken, strings, tidy

#: Separators become spaces, A-Z small letters; bytes of characters beyond ASCII stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

Grams = dict[int, dict[bytes, list[str]]]  # number of words -> window -> ids of items


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def windows(own: list[bytes], n: int) -> list[bytes]:
    if not own:
        return []
    return [b" ".join(own[k : k + n]) for k in range(max(1, len(own) - n + 1))]


class Scanner:
    """The hash set, and lookups in it."""

    def __init__(self, rows: list[tuple[bytes, list[str]]]):
        self.grams: Grams = {}
        self.vocabulary: set[bytes] = set()
        for gram, items in rows:
            own = gram.split(b" ")
            self.grams.setdefault(len(own), {})[gram] = items
            self.vocabulary.update(own)

    def scan(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The stretches of words that windows occur at, ascending, and the items hit. Overlapping ones of one length are put together."""
        inside = bytes(map(self.vocabulary.__contains__, own))
        hits, items = [], set()
        for n, grams in self.grams.items():
            full, of_length = b"\1" * n, []
            at = inside.find(full)
            while at >= 0:
                if (found := grams.get(b" ".join(own[at : at + n]))) is not None:
                    of_length.append((at, at + n))
                    items.update(found)
                at = inside.find(full, at + 1)
            hits += merged(of_length) if n > 1 else of_length
        return sorted(hits), items


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint stretches that hold the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Filter:
    """A Bloom filter in 64-bit words: four bits for each window, taken from one hash. It may take a window for a member that is none."""

    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(bits // 64, np.uint64)

    def places(self, windows: list[bytes]) -> np.ndarray:
        h = np.fromiter(map(xxh64_intdigest, windows), np.uint64, len(windows))
        with np.errstate(over="ignore"):
            return (h + np.arange(4, dtype=np.uint64)[:, None] * (h >> np.uint64(32) | np.uint64(1))) & np.uint64(self.bits - 1)

    def has(self, windows: list[bytes]) -> np.ndarray:
        p = self.places(windows)
        return (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).all(axis=0)


FOUND = "struct<n_words: long, n_hit: long, hits: array<struct<first: int, after: int>>, items: array<string>>"
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))), ("items", pa.list_(pa.string()))])


class Decontaminator:
    """benchmark: the items, by id and text. n: words of a window. max_broadcast: bytes of windows up to which they are broadcast;
    max_filter: bytes of the filter beyond that."""

    def __init__(self, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 8, max_broadcast: int = 64_000_000, max_filter: int = 32_000_000):
        spark = benchmark.sparkSession
        narrow_batches(spark)

        def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                found = [(g, k) for k, t in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True) if k is not None for g in dict.fromkeys(windows(words(t.encode()), n))]
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.binary()), pa.array([k for _, k in found], pa.string())], ["gram", "item"])

        items = keyed(benchmark, id_col, text_col).withColumn("id", F.col("id").cast("string"))
        self.windows = cut(items.mapInArrow(split, "gram binary, item string").groupBy("gram").agg(F.sort_array(F.collect_set("item")).alias("items")))
        size = self.windows.agg(F.sum(F.length("gram") + 64 + F.size("items") * 16 + F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x)))).first()[0] or 0
        self.n, self.sent, self.name = n, None, uuid.uuid4().hex
        if size <= max_broadcast:
            self.sent = spark.sparkContext.broadcast([(bytes(r.gram), r["items"]) for r in self.windows.collect()])
        else:
            self.filter = spark.sparkContext.broadcast(self._filter(max_filter))

    def _filter(self, most: int) -> Filter:
        """Ten bits and more a window, if there is room. Executors set them; what is collected are the filter's words."""
        out = Filter(1 << min((10 * self.windows.count()).bit_length(), (8 * most).bit_length() - 1))

        def bits(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                p = np.unique(out.places(b.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], ["word", "bits"])

        found = self.windows.select("gram").mapInArrow(bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        out.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return out

    def _scan(self, text: Column, cut: bool) -> Column:
        """struct<n_words, n_hit, hits, items, text>: text is the given one, or, to cut, without windows of n words."""
        sent, name, n = self.sent, self.name, self.n
        kind = pa.struct([*_ARROW, ("text", pa.string())])

        @F.arrow_udf(FOUND[:-1] + ", text: string>")
        def scan(texts: pa.Array) -> pa.Array:
            scanner, out = once(name, lambda: Scanner(sent.value)), []
            for t in texts.to_pylist():
                own = words((t or "").encode())
                hits, items = scanner.scan(own)
                full = merged([h for h in hits if h[1] - h[0] >= n]) if cut else []
                out.append({"n_words": len(own), "n_hit": sum(b - a for a, b in merged(hits)), "hits": [{"first": a, "after": b} for a, b in hits], "items": sorted(items), "text": removed(t, full) if full else t if cut else None})
            found = pa.array(out, kind)
            del out
            tidy()
            return found

        return scan.asNondeterministic()(text)  # so that a filter on the result doesn't make a second scan below it

    def annotate(self, df: DataFrame, text_col: str = "text", found_col: str = "found") -> DataFrame:
        """df with a column struct<n_words, n_hit, hits, items>: hits are stretches of words, of one length each, items are sorted ids."""
        refuse_taken(df, found_col)
        text = F.col(f"`{text_col}`").cast("string")
        if self.sent is None:
            return self._joined(df, text, found_col)
        return df.withColumn(found_col, self._scan(text, False)).withColumn(found_col, F.col(found_col).dropFields("text"))

    def _joined(self, df: DataFrame, text: Column, found_col: str) -> DataFrame:
        """For sets too large to broadcast: windows meet by hash. Rows get a number of their own, as ids may repeat."""
        row = fresh(df, "row")
        # At most n lengths; what has no such length never leaves the map side.
        lengths = [r.n for r in self.windows.select(F.size(F.split(F.col("gram").cast("string"), " ")).alias("n")).distinct().collect()]
        # Row numbers must hold when a lost task runs again: they are written, not computed twice.
        rows = cut(df.withColumn(row, F.monotonically_increasing_id()))

        members = self.filter

        def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                for k, t in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                    own = words(t.encode())
                    for at in range(0, len(own), 10_000):
                        found = [(i, m, b" ".join(own[i : i + m])) for i in range(at, min(at + 10_000, len(own))) for m in lengths if i + m <= len(own)]
                        found = [f for f, has in zip(found, members.value.has([f[2] for f in found]), strict=True) if has]
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int64()), *(pa.array([f[j] for f in found], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.binary())))], ["row", "first", "n", "gram"])

        hit = rows.select(row, text.alias("text")).mapInArrow(spread, "row long, first int, n int, gram binary")
        hit = hit.join(self.windows, "gram").select("row", "first", (F.col("first") + F.col("n")).alias("after"), "items")
        per = hit.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("first", "after"))).alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

        @F.arrow_udf("long")
        def covered(hits: pa.Array) -> pa.Array:
            return pa.array([sum(b - a for a, b in merged([(x["first"], x["after"]) for x in h])) for h in hits.to_pylist()], pa.int64())

        @F.arrow_udf("long")
        def count(texts: pa.Array) -> pa.Array:
            return pa.array([len(words((t or "").encode())) for t in texts.to_pylist()], pa.int64())

        per = per.select(F.col("row").alias(row), covered("hits").alias("__n"), F.col("hits").alias("__hits"), F.col("items").alias("__items"))
        none = F.array().cast("array<struct<first: int, after: int>>")
        found = F.struct(count(text).alias("n_words"), F.coalesce("__n", F.lit(0)).alias("n_hit"), F.coalesce("__hits", none).alias("hits"), F.coalesce("__items", F.array().cast("array<string>")).alias("items"))
        out = rows.join(per, row, "left").withColumn(found_col, found)
        return out.select(*(f"`{c}`" for c in df.columns), found_col)

    def clean(self, df: DataFrame, text_col: str = "text", action: str = "both", least_items: int = 2) -> DataFrame:
        """df without the contamination: `documents` drops rows with least_items items or more, `spans` cuts the windows of n words
        out of the texts (shorter items may occur by chance), `both` does the first and then the second."""
        if action not in ("documents", "spans", "both"):
            raise ValueError(f"unknown action {action}")
        found, n, text = fresh(df, "found"), self.n, F.col(f"`{text_col}`").cast("string")
        if self.sent is not None:
            out, cut = df.withColumn(found, self._scan(text, action != "documents")), F.col(f"{found}.text")
        else:

            @F.arrow_udf("string")
            def without(texts: pa.Array, hits: pa.Array) -> pa.Array:
                full = [merged([(x["first"], x["after"]) for x in h or [] if x["after"] - x["first"] >= n]) for h in hits.to_pylist()]
                return pa.array([removed(t, h) if h else t for t, h in zip(texts.to_pylist(), full, strict=True)], pa.string())

            out, cut = self.annotate(df, text_col, found), without(text, F.col(f"{found}.hits"))
        if action != "spans":
            out = out.where(F.size(f"{found}.items") < least_items)
        if action != "documents":
            out = out.withColumn(text_col, cut)
        return out.drop(found)


def removed(text: str, hits: list[tuple[int, int]]) -> str:
    """The text without these stretches of words and what stands between their words."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.lower())]
    out, end = [], 0
    for a, b in hits:
        out.append(raw[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, raw[end:]]).decode()


def report(df: DataFrame, clean: Decontaminator, id_col: str = "doc_id", text_col: str = "text", least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row."""
    rows = clean.annotate(keyed(df, id_col, text_col), "text", "found")
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.size("found.items") >= least_items).alias("contaminated"),
    )
