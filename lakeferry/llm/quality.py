"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other on unlabelled rows.

The two views of a document share nothing: its content (what characters, words and lines the text is made of, and how long it is),
and its metadata, none of which is computed from the text (source, language and declared length). Each view has a
logistic regression on hashed and dense features. In each round both score all rows. Those that one is surest of, as many of either
kind as labels have it, become training rows of the other, unless that one contradicts them firmly: what is sure enough is
told by thresholds from counts over all rows. In the end both are calibrated on labelled rows that took no part in
training, and a row's score is the calibrated combination of both views.

Features are computed once, by the executors, and written; rounds and scores read them. Classifiers are fitted on bounded
samples, drawn by a hash: of about `max_labelled` labelled rows, and in each round of about `max_taught` of the rows with
pseudo-labels for each view. Texts of any length take part, whole.

Null and empty texts have the features of an empty text; null metadata are a value of their own. Without labels of both kinds each score is
the share of good labels, or 0.5. Labels that contradict each other both count. Repeated rows are scored each; columns other
than those named change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeferry.llm.base import bounded_sample, cut, narrow_batches, once, remove, tidy

WORD = re.compile(r"[^\W\d_]+")
#: Places of hashed features, beside the dense ones.
HASHED, SOURCES, LANGS = 256, 64, 16
TEXT_WIDTH, META_WIDTH = 25 + HASHED, 26 + SOURCES + LANGS
#: Log-odds are counted in so many steps a unit.
STEPS = 50


def text_view(text: str) -> np.ndarray:
    """Shares of kinds of characters, of repeated words, lines and beginnings, and hashed frequencies of short words and word ends."""
    out = np.zeros(TEXT_WIDTH)
    if not text:
        out[0] = 1
        return out
    n = len(text)
    words = WORD.findall(text)
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, text)) if text != text.lower() else 0
    m = max(1, len(words))
    distinct = set(words)
    chunks = text.split()
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    out[1:14] = (
        letters / n, upper / n, (n - letters - text.count(" ") - text.count("\n")) / n, sum(map(text.count, "!?")) / n, sum(map(text.count, "#$%&*|<>{}[]")) / n,
        sum(map(text.count, ".,;:")) / n, len(distinct) / m, doubled / m, min(3.0, letters / m / 5), sum(w.isupper() and len(w) > 1 for w in words) / m, sum(c[-1:] in "$%&*#|" for c in chunks) / max(1, len(chunks)),
        sum(map(text.count, "0123456789")) / n, len(chunks) / n * 5,
    )
    own = np.bincount([zlib.crc32(w[-3:].lower().encode()) % HASHED for w in words[:]], minlength=HASHED) if words else np.zeros(HASHED)
    lines = text.split("\n")
    sizes = np.array([len(x) for x in lines], float)
    out[14:25] = (
        np.log1p(n) / 5, np.log1p(len(lines)), np.log1p(sizes.mean()) / 5, np.log1p(sizes.std()) / 5, np.log1p(sizes.max()) / 5, np.log1p(sizes.min()) / 5,
        len(set(lines)) / len(lines), (sizes < 20).mean(), np.log1p(m) / 5, float(m == 1), float(n < 200),
    )
    out[25:] = np.sqrt(own / m)
    return out


def meta_view(source: str | None, lang: str | None, declared: int | None) -> np.ndarray:
    """Declared length, as a number and by its power of two, and hashed source and language."""
    out = np.zeros(META_WIDTH)
    n = max(0, declared or 0)
    out[0], out[1] = float(declared is None), np.log1p(n) / 5
    out[2 + min(23, n.bit_length())] = 1
    out[26 + zlib.crc32(f"s{source}".encode()) % SOURCES] = 1
    out[26 + SOURCES + zlib.crc32(f"l{lang}".encode()) % LANGS] = 1
    return out


class Logistic:
    """Ridge-penalised logistic regression on standardised features, by Newton's steps; rows of either kind weigh alike."""

    def __init__(self, ridge: float = 2.0):
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.c_[(x - self.mean) / self.spread, np.ones(len(x))]
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))
        self.w = np.zeros(z.shape[1])
        penalty = np.full(len(self.w), self.ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, z.T @ (weight * (p - y)) + penalty * self.w)
            # Newton's step, shortened where it would run away.
            self.w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-5:
                break
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        return np.clip(np.c_[(x - self.mean) / self.spread, np.ones(len(x))] @ self.w, -30, 30)


class CoTrained:
    """Both classifiers and their calibrated combination, in one process."""

    def __init__(self, share: float):
        self.share, self.views, self.both = share, None, None

    def __call__(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by the text, by the metadata and by both."""
        if self.views is None:
            return (np.full(len(a), self.share),) * 3
        raw = [v(x) for v, x in zip(self.views, (a, b), strict=True)]
        odds = [np.polyval(c, r) for c, r in zip(self.single, raw, strict=True)]
        both = np.c_[raw[0], raw[1], np.ones(len(a))] @ self.both
        return tuple(1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in (*odds, both))


def platt(raw: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns of raw, and a constant, that make calibrated log-odds of y."""
    z, w = np.c_[raw, np.ones(len(raw))], np.zeros(raw.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (p - y) + 0.1 * w)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


class Fitter:
    """Both classifiers while they are trained. views: features of the labelled rows; a fifth of them is kept for calibration."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray):
        self.views, self.y = views, y
        self.held = np.arange(len(y)) % 5 == 4
        self.share = float(y.mean()) if len(y) else 0.5
        self.fits = len(y) >= 10 and all(len(set(y[h].tolist())) == 2 for h in (self.held, ~self.held))
        if self.fits:
            self.good = float(y[~self.held].mean())
            self.own = [self._fitted(k, None) for k in (0, 1)]

    def _fitted(self, k: int, taught: tuple[np.ndarray, np.ndarray] | None) -> Logistic:
        x, y = self.views[k][~self.held], self.y[~self.held]
        return Logistic().fit(np.concatenate([x, taught[0]]), np.concatenate([y, taught[1]])) if taught else Logistic().fit(x, y)

    def learn(self, taught: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """One round: for each view the features and pseudo-labels of the rows that the other one teaches it."""
        self.own = [self._fitted(k, t if len(t[1]) else None) for k, t in enumerate(taught)]

    def done(self) -> CoTrained:
        out = CoTrained(self.share)
        if self.fits:
            raw = np.stack([self.own[k](self.views[k][self.held]) for k in (0, 1)], axis=1)
            out.views, out.both = self.own, platt(raw, self.y[self.held])
            out.single = [platt(raw[:, [k]], self.y[self.held]) for k in (0, 1)]
        return out


def sure_from(counts: np.ndarray, share: float, sign: int) -> float:
    """The log-odds from which on (sign 1), or down to which (-1), about that share of the counted rows lies, but 1 at least. counts: of
    rows by steps of log-odds, from -30 on."""
    own = counts[::-1] if sign > 0 else counts
    k = int(np.searchsorted(np.cumsum(own), share * counts.sum(), "right"))
    edge = (len(counts) - k if sign > 0 else k) / STEPS - 30
    return max(1.0, sign * edge)


def pseudo(odds: np.ndarray, limits: list[tuple[float, float]], k: int) -> np.ndarray:
    """The label that view k teaches the other one of each row: 1, 0, or -1 for none. odds: [row, view]; limits: of view k for either kind."""
    own, other = odds[:, k], odds[:, 1 - k]
    return np.where((own >= limits[0]) & (other > -1), 1, np.where((own <= -limits[1]) & (other < 1), 0, -1))


def _packed(texts: list, sources: list, langs: list, declared: list) -> tuple[list[bytes], list[bytes]]:
    """Features of either view, in half precision."""
    return [text_view(t or "").astype(np.float16).tobytes() for t in texts], [meta_view(s, g, n).astype(np.float16).tobytes() for s, g, n in zip(sources, langs, declared, strict=True)]


def _unpacked(rows, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float16).reshape(-1, width).astype(np.float64)


class Quality:
    """known: a, b (features() makes them) and label of labelled rows, a bounded number of them. pool: id, a and b of all rows, a table that is
    cheap to read again, as each round does. labelled: ids (column id) of rows that aren't to be taught, as their label is known."""

    def __init__(self, known: DataFrame, pool: DataFrame, labelled: DataFrame, max_taught: int = 8000, rounds: int = 4, share_a_round: float = 0.08):
        spark = known.sparkSession
        rows = sorted(((bytes(r.a), bytes(r.b), r.label) for r in known.collect()), key=lambda r: (zlib.crc32(r[0] + r[1]), r))
        fitter = Fitter((_unpacked([r[0] for r in rows], TEXT_WIDTH), _unpacked([r[1] for r in rows], META_WIDTH)), np.array([r[2] for r in rows], float))
        for n in range(1, rounds + 1 if fitter.fits else 0):
            taught = self._taught(pool, labelled, fitter, share_a_round * n, max_taught)
            if taught is None:
                break
            fitter.learn(taught)
        self.model = fitter.done()
        sent, name = spark.sparkContext.broadcast(self.model), uuid.uuid4().hex

        @F.arrow_udf("struct<text_score: double, meta_score: double, score: double>")
        def score(a: pa.Array, b: pa.Array) -> pa.Array:
            out = once(name, lambda: sent.value)(_unpacked(a.to_pylist(), TEXT_WIDTH), _unpacked(b.to_pylist(), META_WIDTH))
            return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in out], ["text_score", "meta_score", "score"])

        self._score = score.asNondeterministic()

    def _taught(self, pool: DataFrame, labelled: DataFrame, fitter: Fitter, share: float, most: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """For each view, a sample of the unlabelled rows that the other one is surest of: about `most`, at most twice as many."""
        own, bins = fitter.own, 60 * STEPS + 1

        def odds_of(a: pa.Array, b: pa.Array) -> np.ndarray:
            return np.stack([own[0](_unpacked(a.to_pylist(), TEXT_WIDTH)), own[1](_unpacked(b.to_pylist(), META_WIDTH))], axis=1)

        def counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, bins), np.int64)
            for b in rows:
                step = ((odds_of(b.column(0), b.column(1)) + 30) * STEPS).astype(np.int64)
                for k in (0, 1):
                    total[k] += np.bincount(step[:, k], minlength=bins)
            k, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[k, at])], ["view", "step", "n"])

        total = np.zeros((2, bins))
        for r in pool.select("a", "b").mapInArrow(counts, "view int, step int, n long").groupBy("view", "step").agg(F.sum("n").alias("n")).collect():
            total[r.view, r.step] = r.n
        if not total.any():
            return None
        limits = [(sure_from(t, share * fitter.good, 1), sure_from(t, share * (1 - fitter.good), -1)) for t in total]

        @F.arrow_udf("struct<from_text: int, from_meta: int>")
        def labels(a: pa.Array, b: pa.Array) -> pa.Array:
            odds = odds_of(a, b)
            return pa.StructArray.from_arrays([pa.array(pseudo(odds, limits[k], k).astype(np.int32)) for k in (0, 1)], ["from_text", "from_meta"])

        # About so many rows have a pseudo-label of either view: the draw by a hash takes their share. Copies fall together and count once.
        many = max(1.0, share * float(total[0].sum()))
        drawn = pool.where(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)) < int(min(1.0, most / many) * (1 << 40)))
        drawn = drawn.select("id", "a", "b", labels.asNondeterministic()("a", "b").alias("y")).where("y.from_text >= 0 OR y.from_meta >= 0")
        drawn = cut(drawn.groupBy("a", "b", "y").agg(F.min("id").alias("id")).limit(4 * most))
        # Few rows were drawn, so the labels' ids are filtered where they are.
        none = {r.id for r in labelled.join(F.broadcast(drawn.select("id")), "id", "left_semi").distinct().collect()}
        rows = sorted((bytes(r.a), bytes(r.b), r.y.from_text, r.y.from_meta) for r in drawn.collect() if r.id not in none)
        remove(pool.sparkSession, drawn)
        by_meta, by_text = [r for r in rows if r[3] >= 0], [r for r in rows if r[2] >= 0]
        return [
            (_unpacked([r[0] for r in by_meta], TEXT_WIDTH), np.array([r[3] for r in by_meta], float)),
            (_unpacked([r[1] for r in by_text], META_WIDTH), np.array([r[2] for r in by_text], float)),
        ]

    def score(self, a: Column, b: Column) -> Column:
        """struct<text_score, meta_score, score> of features."""
        return self._score(a, b)


def features(df: DataFrame, *keep: str) -> DataFrame:
    """keep, and a and b: features of text and of source, lang and n_chars; computed where the rows are."""
    narrow_batches(df.sparkSession, 500)

    @F.arrow_udf("struct<a: binary, b: binary>")
    def of(texts: pa.Array, sources: pa.Array, langs: pa.Array, declared: pa.Array) -> pa.Array:
        a, b = _packed(*(c.to_pylist() for c in (texts, sources, langs, declared)))
        tidy()
        return pa.StructArray.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return df.select(*keep, of("text", "source", "lang", "n_chars").alias("of")).select(*keep, "of.*")


def report(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", keep: float = 0.5, max_labelled: int = 8000, **parameters) -> DataFrame:
    """doc_id, text_score, meta_score, score and kept of each row."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), *(F.col(c).cast("string") for c in ("text", "source", "lang")), F.col("n_chars").cast("long"))
    own = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    table = cut(features(rows, "doc_id"))
    # The labelled sample is drawn from ids alone, and few enough to broadcast (at most twice the bound).
    known = table.join(F.broadcast(bounded_sample(own, max_labelled, "doc_id", "label")), "doc_id").select("a", "b", "label")
    model = Quality(known, table.select(F.col("doc_id").alias("id"), "a", "b"), own.select(F.col("doc_id").alias("id")), **parameters)
    found = table.select("doc_id", model.score(F.col("a"), F.col("b")).alias("found"))
    return found.select("doc_id", "found.text_score", "found.meta_score", "found.score", (F.col("found.score") >= keep).alias("kept"))
