"""Language identification by interpolated Kneser-Ney character models, one for each language.

Texts are lower-cased, runs of anything but letters become one space, and one space stands at either end. For each language the
n-grams of the highest order are counted over all training texts (an aggregation with partial sums on the map side);
lower orders follow from them as Kneser-Ney continuation counts. All models together are sorted arrays of hashed n-grams, one
for each order, with a row of log-probabilities for the languages beside them; an n-gram that no language has backs off
by the interpolation weights of its context, which are sorted arrays too. All n-grams that were counted are in the models, so
what is collected and broadcast grows with the different n-grams of the training texts, unless `max_ngrams` bounds it.

A text's language is the one with the lowest cross-entropy a character. Confidence is the logistic of the margin to the next
one, times the square root of the length; rejection compares the cross-entropy with what texts of that language
and length have. Both are calibrated on all training texts and short pieces of them: executors score these with the models, and what
calibration needs of each is written; sums and order statistics of it are all that reaches the driver.

Null texts and texts without a letter are `und`, score 0, rejected. Ties go to the language that sorts first. Without training
rows all texts are `und`. Training rows that repeat count each; other columns change nothing; texts are read whole, in pieces of
bounded length.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeferry.llm.base import cut, narrow_batches, once, remove, tidy

ORDER = 4
#: Characters that are worked on at once.
PIECE = 1 << 19
SPACE = 32
#: Numbers of an array that has a row of all languages for each n-gram: 48 MB. Beyond that only what a language has is stored.
MAX_CELLS = 12_000_000
#: Log-probabilities that are worked on at once.
CELLS = 16 * PIECE
#: Characters of the pieces that calibration takes of each text, beside the whole of it.
SHORT = (8, 24, 96)
#: Order statistics are of values in units of 2^-UNIT_BITS, and each pass over these tells so many bits.
UNIT_BITS, STEP_BITS = 24, 12


@lru_cache(1)
def folding() -> np.ndarray:
    """For each code point of the basic plane: its small letter, or a space if it is none."""
    out = np.full(0x10000, SPACE, np.uint16)
    for c in range(0x10000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
    return out


def folded(text: str) -> np.ndarray:
    """The codes of a text, or none if it has no letter. Letters beyond the basic plane fall onto its private area."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = folding()[np.minimum(codes, 0xFFFF)]
    far = np.flatnonzero(codes > 0xFFFF)
    for k in far:
        if chr(codes[k]).isalpha():
            out[k] = 0xE000 + codes[k] % 0x1900
    out = np.concatenate(([SPACE], out, [SPACE])).astype(np.uint16)
    space = out == SPACE
    out = out[~(space & np.concatenate(([False], space[:-1])))]
    return out if len(out) > 2 or len(out) and out.max() != SPACE else out[:0]


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each place but the first, as one number; places before the text count as spaces."""
    x = np.concatenate((np.full(order - 2, SPACE, np.uint16), codes)).astype(np.uint64)
    n = len(codes) - 1
    out = np.zeros(n, np.uint64)
    for k in range(order):
        out = out << np.uint64(16) | x[k : k + n]
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)


def hashed(keys: np.ndarray) -> np.ndarray:
    """An invertible mix, so that n-grams of up to four codes never collide."""
    x = keys * _ODD
    return x ^ x >> np.uint64(32)


class Rows:
    """Rows of numbers for the languages, of which only those that are there are stored; the others are taken as they are given."""

    def __init__(self, at: np.ndarray, language: np.ndarray, value: np.ndarray, n: int):
        """at: the row of each number, in ascending order; n: rows."""
        self.start, self.language, self.value = np.searchsorted(at, np.arange(n + 1)), language.astype(np.int32), value.astype(np.float32)

    def __getitem__(self, by: np.ndarray) -> Rows:
        size = np.diff(self.start)[by]
        at = np.repeat(np.arange(len(by)), size)
        own = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[by], size)
        return Rows(at, self.language[own], self.value[own], len(by))

    def places(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))


class Model:
    """Sorted hash arrays, one for each order, and the log-probabilities (base e) of each language beside them: a row of all languages,
    or Rows where there are too many languages for that."""

    def __init__(self, languages: list[str]):
        self.languages, self.hashes, self.logp, self.contexts, self.logw = languages, [], [], [], []
        self.floor = 0.0
        self.typical: np.ndarray = np.zeros((len(languages), 2))
        self.margin = np.array([1.0, 0.0])

    def add(self, keys: np.ndarray, logp: np.ndarray | Rows, contexts: np.ndarray, logw: np.ndarray | Rows) -> None:
        for values, rows, hs, ps in ((keys, logp, self.hashes, self.logp), (contexts, logw, self.contexts, self.logw)):
            h = hashed(values)
            by = np.argsort(h)
            hs.append(h[by])
            ps.append(rows[by] if isinstance(rows, Rows) else rows[by].astype(np.float32))

    def logs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """The log-probability of each n-gram's last character in each language."""
        if order == 0:
            return np.full((len(keys), len(self.languages)), self.floor, np.float32)
        if isinstance(self.logp[order - 1], Rows):
            return self._sparse(keys, order)
        at = self.hashes[order - 1]
        h = hashed(keys)
        k = np.minimum(np.searchsorted(at, h), len(at) - 1)
        out = self.logp[order - 1][k]
        new = np.flatnonzero(at[k] != h)
        if len(new):
            below = keys[new]
            context = below >> np.uint64(16)
            mask = np.uint64((1 << 16 * (order - 1)) - 1)
            lower = self.logs(below & mask, order - 1)
            at, h = self.contexts[order - 1], hashed(context)
            c = np.minimum(np.searchsorted(at, h), len(at) - 1)
            lower += np.where((at[c] == h)[:, None], self.logw[order - 1][c], 0)
            out[new] = lower
        return out

    def _sparse(self, keys: np.ndarray, order: int) -> np.ndarray:
        mask = np.uint64((1 << 16 * (order - 1)) - 1)
        out = self.logs(keys & mask, order - 1)
        context = keys >> np.uint64(16) if order > 1 else np.zeros(len(keys), np.uint64)
        for values, at, rows, add in ((context, self.contexts, self.logw, True), (keys, self.hashes, self.logp, False)):
            h = hashed(values)
            k = np.minimum(np.searchsorted(at[order - 1], h), len(at[order - 1]) - 1)
            found = np.flatnonzero(at[order - 1][k] == h)
            own = rows[order - 1][k[found]]
            place = found[own.places()], own.language
            out[place] = out[place] + own.value if add else own.value
        return out

    def entropies(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The cross-entropy a character in each language, and the number of characters, of each text."""
        total, length = np.zeros((len(codes), len(self.languages))), np.array([max(1, len(c) - 1) for c in codes])
        parts, owners, size = [], [], 0
        piece = max(1024, min(PIECE, CELLS // max(1, len(self.languages))))

        def flush() -> None:
            nonlocal size
            if parts:
                logs = self.logs(np.concatenate(parts))
                at = np.cumsum([0, *map(len, parts)])[:-1]
                np.subtract.at(total, owners, np.add.reduceat(logs, at, axis=0, dtype=np.float64))
            parts.clear()
            owners.clear()
            size = 0

        for k, c in enumerate(codes):
            for a in range(0, max(0, len(c) - 1), piece):
                own = grams(c, ORDER) if len(c) <= piece else grams_between(c, a, min(a + piece, len(c) - 1))
                parts.append(own)
                owners.append(k)
                size += len(own)
                if size >= piece:
                    flush()
        flush()
        return total / length[:, None], length

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        codes = [folded(t) if t else np.zeros(0, np.uint16) for t in texts]
        if not self.languages:
            return [("und", 0.0, True)] * len(texts)
        entropy, length = self.entropies(codes)
        best = entropy.argmin(axis=1)
        rows = np.arange(len(texts))
        low = entropy[rows, best]
        margin = margins(entropy, best, low) * np.sqrt(length)
        score = 1 / (1 + np.exp(-np.clip(self.margin[0] * margin + self.margin[1], -30, 30)))
        mean, spread = self.typical[best].T
        rejected = low > mean + spread / np.sqrt(length)
        return [(self.languages[b], float(s), bool(r)) if len(c) else ("und", 0.0, True) for b, s, r, c in zip(best, score, rejected, codes, strict=True)]


def grams_between(codes: np.ndarray, a: int, b: int) -> np.ndarray:
    """The n-grams of places a to b of a long text."""
    own = grams(codes[max(0, a - ORDER) : b + 1], ORDER)
    return own[len(own) - (b - a) :]


def margins(entropy: np.ndarray, best: np.ndarray, low: np.ndarray) -> np.ndarray:
    if entropy.shape[1] < 2:
        return np.full(len(low), 10.0)
    other = entropy.copy()
    other[np.arange(len(low)), best] = np.inf
    return other.min(axis=1) - low


def kneser_ney(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]], max_cells: int | None = None) -> Model:
    """The model of each language's n-grams of the highest order and their counts. max_cells: beyond that an array is stored as Rows."""
    max_cells = MAX_CELLS if max_cells is None else max_cells
    model = Model(languages)
    alphabet = max(2, len(np.unique(np.concatenate([k & np.uint64(0xFFFF) for k, _ in counts]))))
    model.floor = -float(np.log(alphabet))
    per: list[list[tuple[np.ndarray, ...]]] = []  # by language and order: n-grams, discounted shares, contexts, weights
    for keys, n in counts:
        own, c = [], n.astype(np.float64)
        for order in range(ORDER, 0, -1):
            context = keys >> np.uint64(16) if order > 1 else np.zeros(len(keys), np.uint64)
            ones, twos = (c == 1).sum(), (c == 2).sum()
            d = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            contexts, inverse = np.unique(context, return_inverse=True)
            sums, types = np.bincount(inverse, c), np.bincount(inverse)
            own.append((keys, (c - d) / sums[inverse], contexts, d * types / sums))
            mask = np.uint64((1 << 16 * (order - 1)) - 1)
            keys, c = np.unique(keys & mask, return_counts=True)
            c = c.astype(np.float64)
        per.append(own[::-1])
    below: list[tuple[np.ndarray, np.ndarray]] = []  # by language: n-grams of the order before, and their probabilities
    for order in range(1, ORDER + 1):
        # A sorted array holds what any language has, so that one search serves all of them.
        keys = np.unique(np.concatenate([own[order - 1][0] for own in per]))
        contexts = np.unique(np.concatenate([own[order - 1][2] for own in per]))
        mask = np.uint64((1 << 16 * (order - 1)) - 1)
        if len(keys) * len(per) > max_cells:
            below = interpolated(per, order, below, alphabet)
            logp = [(np.searchsorted(keys, own), np.log(p)) for own, p in below]
            logw = [(np.searchsorted(contexts, own[order - 1][2]), np.log(own[order - 1][3])) for own in per]
            model.add(keys, rows_of(logp, len(keys)), contexts, rows_of(logw, len(contexts)))
            continue
        p, w = np.zeros((len(keys), len(per))), np.ones((len(contexts), len(per)))
        for k, own in enumerate(per):
            p[np.searchsorted(keys, own[order - 1][0]), k] = own[order - 1][1]
            w[np.searchsorted(contexts, own[order - 1][2]), k] = own[order - 1][3]
        context = keys >> np.uint64(16) if order > 1 else np.zeros(len(keys), np.uint64)
        at = np.searchsorted(contexts, context)
        lower = np.exp(model.logs(keys & mask, order - 1)) if order > 1 else 1 / alphabet
        model.add(keys, np.log(p + w[at] * lower), contexts, np.log(w))
        below = interpolated(per, order, below, alphabet)
    return model


def interpolated(per: list[list[tuple[np.ndarray, ...]]], order: int, below: list[tuple[np.ndarray, np.ndarray]], alphabet: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By language: its n-grams of an order and their probabilities. What an n-gram ends with is an n-gram of the order below, whose
    probabilities are given."""
    mask, out = np.uint64((1 << 16 * (order - 1)) - 1), []
    for k, own in enumerate(per):
        keys, share, contexts, weight = own[order - 1]
        context = keys >> np.uint64(16) if order > 1 else np.zeros(len(keys), np.uint64)
        lower = below[k][1][np.searchsorted(below[k][0], keys & mask)] if order > 1 else 1 / alphabet
        out.append((keys, share + weight[np.searchsorted(contexts, context)] * lower))
    return out


def rows_of(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> Rows:
    """parts: for each language the rows, and its numbers there."""
    at = np.concatenate([a for a, _ in parts])
    by = np.argsort(at, kind="stable")
    language = np.repeat(np.arange(len(parts), dtype=np.int32), [len(a) for a, _ in parts])
    return Rows(at[by], language[by], np.concatenate([v for _, v in parts])[by], n)


def scored(df: DataFrame, place: dict[str, int], model: Callable[[], Model]) -> DataFrame:
    """For each text of df (lang, text) in one of the model's languages, and for short pieces of it: place (the language's), own (the
    cross-entropy in it), length, margin (times the root of the length), hit (whether the best language is that one)."""

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            codes, right = [], []
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang in place and len(c := folded(t)):
                    for n in (*SHORT, len(c)):
                        codes.append(c[: n + 1])
                        right.append(place[lang])
            if codes:
                entropy, length = model().entropies(codes)
                best, want = entropy.argmin(axis=1), np.array(right)
                margin = margins(entropy, best, entropy.min(axis=1)) * np.sqrt(length)
                own = entropy[np.arange(len(want)), want]
                yield pa.RecordBatch.from_arrays([pa.array(want.astype(np.int32)), pa.array(own), pa.array(length.astype(np.int64)), pa.array(margin), pa.array(best == want)], ["place", "own", "length", "margin", "hit"])
        tidy()

    return df.mapInArrow(score, "place int, own double, length long, margin double, hit boolean")


def total(c: Column) -> Column:
    """A sum that is the same in whatever order rows come."""
    return F.sum(c.cast("decimal(38,18)"))


def calibrate(model: Model, pieces: DataFrame) -> None:
    """Confidence from the margins of all pieces (see scored(); a written table); rejection from the entropies in their own languages."""
    spark = pieces.sparkSession
    per = pieces.groupBy("place").agg(total(F.col("own") * F.col("length")).alias("own"), F.sum("length").alias("length"), F.count("*").alias("n")).collect()
    mean = {r.place: float(r.own / r.length) for r in per}
    means = F.broadcast(spark.createDataFrame(sorted(mean.items()), "place int, mean double"))
    above = (F.col("own") - F.col("mean")) * F.sqrt("length")
    values = pieces.join(means, "place").select("place", F.floor(above * (1 << UNIT_BITS) + 0.5).cast("long").alias("value"))
    at = {r.place: 0.999 * (r.n - 1) for r in per}
    ranks = {k: (int(h), int(np.ceil(h))) for k, h in at.items()}
    found = order_statistics(values, {(k, r) for k, own in ranks.items() for r in own})
    model.typical = np.tile([np.inf, 1.0], (len(model.languages), 1))
    for k, (low, high) in ranks.items():
        most = (found[k, low] + (at[k] - low) * (found[k, high] - found[k, low])) / (1 << UNIT_BITS)
        # A bound that the texts of a language keep, with room: texts of it are hardly ever rejected.
        model.typical[k] = mean[k] + 0.8, 1.5 * max(0.5, most)
    x, ab = F.col("margin"), np.array([1.0, 0.0])
    for _ in range(50):  # Newton's steps for a logistic regression with a small ridge
        p = 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.lit(float(ab[0])) * x + F.lit(float(ab[1]))))))
        off, weight = p - F.col("hit").cast("double"), F.greatest(p * (1 - p), F.lit(1e-9))
        xx, x1, one, gx, g1 = map(float, pieces.select(*map(total, (weight * x * x, weight * x, weight, off * x, off))).first())
        step = np.linalg.solve(np.array([[xx, x1], [x1, one]]) + 1e-2 * np.eye(2), np.array([gx, g1]) + 1e-2 * ab)
        ab = ab - step
        if np.abs(step).max() < 1e-6:
            break
    model.margin = np.array([max(ab[0], 1e-3), ab[1]])


def order_statistics(values: DataFrame, asked: set[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """values: place, value (long). For each place and rank (from 0) that is asked for: the value of that rank among the place's.

    Each pass counts values by further bits, so at most 2^STEP_BITS counts for each that is asked for reach the driver, but for the
    first pass, which counts by all bits above."""
    spark = values.sparkSession
    left, known = {a: a[1] for a in asked}, dict.fromkeys(asked, 0)  # the rank among values with the known first bits, and these
    for shift in range(36, -1, -STEP_BITS):
        rows = values
        if shift < 36:
            state = spark.createDataFrame(sorted({(k, known[k, r]) for k, r in asked}), "place int, known long")
            rows = values.join(F.broadcast(state.withColumnRenamed("place", "of")), (F.col("place") == F.col("of")) & (F.shiftright("value", shift + STEP_BITS) == F.col("known")))
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in rows.groupBy("place", F.shiftright("value", shift).alias("bits")).agg(F.count("*").alias("n")).collect():
            counts.setdefault(r.place, []).append((r.bits, r.n))
        first = dict(known)
        for own in counts.values():
            own.sort()
        for k, r in asked:
            for bits, n in counts[k]:
                if shift < 36 and bits >> STEP_BITS != first[k, r]:
                    continue
                if left[k, r] < n:
                    known[k, r] = bits
                    break
                left[k, r] -= n
    return known


def count_ngrams(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, gram, n over all rows; each task sums up before it sends."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def emit(lang: str) -> pa.RecordBatch:
            keys, n = summed(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for b in rows:
            texts: dict[str, list[np.ndarray]] = {}
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t and len(c := folded(t)):
                    texts.setdefault(lang, []).append(c)
            for lang, own in texts.items():
                parts, size = [], 0
                for c in own:
                    for a in range(0, len(c) - 1, PIECE):
                        parts.append(grams_between(c, a, min(a + PIECE, len(c) - 1)))
                        size += len(parts[-1])
                        if size >= PIECE:
                            held.setdefault(lang, []).append(np.unique(np.concatenate(parts), return_counts=True))
                            parts, size = [], 0
                if parts:
                    held.setdefault(lang, []).append(np.unique(np.concatenate(parts), return_counts=True))
                if len(held.get(lang, ())) > 8:
                    held[lang] = [summed(held[lang])]
                    if len(held[lang][0][0]) > 2_000_000:
                        yield emit(lang)
        for lang in list(held):
            yield emit(lang)
        tidy()

    rows = df.select(F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    return rows.where(rows[0].isNotNull()).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)


def least_count(counts: DataFrame, most: int) -> int:
    """The least power of two so that at most `most` n-grams have that count."""
    least = 1
    for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).count().orderBy(F.desc("step")).collect():
        most -= r["count"]
        if most < 0:
            least = 2 ** (r.step + 1)
            break
    return least


class LanguageID:
    """Fits on the rows of df with a language; then predicts for any texts.

    There may be any number of languages, and the models hold all their n-grams. max_ngrams: of the highest order, for all languages
    together, if the models are to be smaller than that; the rarest are left out then, and with them maybe small languages.
    """

    def __init__(self, df: DataFrame, lang_col: str = "lang", text_col: str = "text", max_ngrams: int | None = None):
        spark = df.sparkSession
        narrow_batches(spark)
        counts = cut(count_ngrams(df, lang_col, text_col))
        kept = (counts if max_ngrams is None else counts.where(F.col("n") >= least_count(counts, max_ngrams))).toArrow()
        names = kept.column("lang").combine_chunks().dictionary_encode()
        languages = sorted(names.dictionary.to_pylist())
        place = {k: i for i, k in enumerate(languages)}
        code = np.array([place[k] for k in names.dictionary.to_pylist()], np.int32)[names.indices.to_numpy(zero_copy_only=False)] if languages else np.zeros(0, np.int32)
        gram, n = kept.column("gram").to_numpy().view(np.uint64), kept.column("n").to_numpy()
        del kept, names
        by = np.lexsort((gram, code))
        ends = np.searchsorted(code[by], np.arange(len(languages) + 1))
        own = [(gram[by[a:b]], n[by[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        model = kneser_ney(languages, own) if languages else Model([])
        self.model, name = model, uuid.uuid4().hex
        # One copy goes to the executors; calibration, a few numbers, follows.
        sent = spark.sparkContext.broadcast(copy.copy(model))
        if languages:
            texts = df.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
            pieces = cut(scored(texts, place, lambda: once(name, lambda: sent.value)))
            calibrate(model, pieces)
            remove(spark, pieces)
        typical, margin = model.typical, model.margin

        def calibrated() -> Model:
            own = copy.copy(sent.value)
            own.typical, own.margin = typical, margin
            return own

        @F.arrow_udf("struct<lang: string, score: double, rejected: boolean>")
        def predict(texts: pa.Array) -> pa.Array:
            out = once(f"{name} calibrated", calibrated).predict(texts.to_pylist())
            tidy()
            return pa.StructArray.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))], ["lang", "score", "rejected"])

        self._predict = predict.asNondeterministic()  # a filter on the result must not predict once more below it

    def predict(self, text: Column) -> Column:
        """struct<lang, score, rejected>"""
        return self._predict(text)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **parameters) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learnt from the rows that aren't held out."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    model = LanguageID(rows.where(~out), **parameters)
    found = rows.select("doc_id", out.alias("held_out"), model.predict(F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"))
