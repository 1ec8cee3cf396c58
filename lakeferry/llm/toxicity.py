"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of lexicons, second-person words and their nearness to lexicon words, capitals, punctuation, and obfuscation
(characters put in place of letters, letters drawn out or spelled apart). There are two lexicons: a short fixed list
of insults, and one that is learnt from labelled texts: words and beginnings of words that are far more frequent in
toxic texts. Trees see each text as a lexicon learnt on others sees it, and calibration sees scores of trees grown on others, so
that neither trusts what was only memorised. All three are small and are sent to the executors; texts are scored whole.

Fitting takes a bounded sample of labelled rows: about `max_rows`, at most twice as many, chosen by a hash. Executors count their
words and compute their features, whole texts of any length; the driver gets counts of entries that toxic texts share, and
features, and grows the trees. Null and empty texts have zero features and a score like any other. Without labelled rows of both kinds each
score is the share of toxic ones, or 0.5. Rows without a label, or with an id that has no label, are never learnt from. Repeated
rows are scored each; labels that repeat for an id count once each; other columns change nothing.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeferry.llm.base import bounded_sample, cut, narrow_batches, once, remove

# Insults in four languages, and second-person words.
INSULTS = frozenset("""
idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown fool imbecile jerk bastard bitch
asshole shit fuck fucking crap dickhead whore slut retard filth vermin pig coward ugly liar shut hate kill die
dumm dummkopf trottel arschloch scheiße scheisse idioten wichser hure schlampe abschaum versager blödmann
connard connasse salope merde putain imbécile crétin abruti ordure enculé débile nul
estúpido estúpida imbécil tonto tonta basura mierda puta puto cabrón pendejo gilipollas inútil asqueroso
""".split())  # fmt: skip
SECOND = frozenset("you your yours yourself u ur ya youre du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes tus vosotros".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"})

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
CHUNK = re.compile(r"\S+")
MASKED = re.compile(r"[^\W\d_][@$!|€*#0-9]+[^\W\d_]")
DRAWN = re.compile(r"([^\W\d_])\1\1+")
SPELLED = re.compile(r"(?<!\w)[^\W\d_](?:[ .\-_*][^\W\d_]){3,}(?!\w)")
NAMES = ("log_words", "fixed", "fixed_hits", "learnt", "learnt_hits", "learnt_strong", "learnt_max", "learnt_share", "second", "near_second", "capitals", "capital_words", "punctuation", "exclamation", "masked", "drawn", "spelled", "undone", "longest", "distinct", "digits")
#: Beginnings of words that the learnt lexicon may hold.
PREFIXES = (3, 4, 5, 6)
NEAR = 5


def parts(word: str) -> list[str]:
    """A word and its beginnings, as entries of the learnt lexicon."""
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) > n)]


def entries(text: str) -> set[str]:
    return {p for w in set(WORD.findall(text.lower())) for p in parts(w)}


def fold_of(text: str, folds: int) -> int:
    """Texts are dealt into folds by a checksum, equal ones together."""
    return zlib.crc32(text.encode("utf-8", "replace")) // 7 % folds


def chosen(counts: Iterable[tuple[str, int, int]], n: tuple[int, int], least: int = 4, odds: float = 2.0) -> dict[str, float]:
    """Entries with their log-odds in toxic texts, where at least `least` of those have them and the odds stand out. counts: of texts with
    an entry, by label; n: texts of either label."""
    found = {}
    for p, clean, toxic in counts:
        if toxic >= least:
            score = np.log((toxic + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1))
            if score >= odds:
                found[p] = float(score)
    return dict(sorted(found.items()))


def lexicons(counts: dict[str, np.ndarray], n: np.ndarray) -> list[dict[str, float]]:
    """For each fold the lexicon learnt on the other ones, and in the end that of all. counts: for each entry texts by [fold, label], n: texts."""
    out = []
    for k in range(len(n) + 1):
        own = [f for f in range(len(n)) if f != k]
        out.append(chosen(((p, *c[own].sum(axis=0).tolist()) for p, c in counts.items()), tuple(n[own].sum(axis=0).tolist())))
    return out


Entry = tuple[float, bool, bool, bool] | tuple[()]


class Lexicon:
    """What each word counts for: () for most, else its learnt log-odds (0 without), and whether it is an insult, a second-person word, and
    all in capitals. Words that come often are remembered."""

    def __init__(self, learnt: dict[str, float]):
        self.learnt = learnt
        self.known: dict[str, Entry] = {}

    def __call__(self, word: str) -> Entry:
        low = word.lower()
        found = (max((self.learnt.get(p, 0.0) for p in parts(low)), default=0.0), low in INSULTS, low in SECOND, len(word) > 1 and word.isupper())
        return found if any(found) else ()

    def of(self, words: list[str]) -> list[tuple[int, Entry]]:
        """The places of words that count for something, and what for."""
        known = self.known
        if new := set(words).difference(known):
            if len(known) > 300_000:
                known.clear()
                new = set(words)
            known.update((w, self(w)) for w in new)
        return [(k, e) for k, e in enumerate(map(known.__getitem__, words)) if e]

    def hit(self, word: str) -> bool:
        """Is it an insult, or does it stand for one?"""
        return bool(e := self(word)) and (e[1] or e[0] >= 3)


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = WORD.findall(text)
    n = len(words)
    if not n:
        marks = sum(not c.isspace() for c in text)
        return [0.0] * NAMES.index("punctuation") + [float(marks > 0)] + [0.0] * (len(NAMES) - NAMES.index("punctuation") - 1)
    entries = lexicon.of(words)
    fixed = [k for k, e in entries if e[1]]
    learnt = [e[0] for _, e in entries if e[0]]
    hits = [k for k, e in entries if e[1] or e[0] >= 3]
    second = [k for k, e in entries if e[2]]
    near = 0
    if hits and second:
        at = np.array(second)
        k = np.searchsorted(at, hits)
        gap = np.minimum(np.abs(at[np.minimum(k, len(at) - 1)] - hits), np.abs(np.array(hits) - at[np.maximum(k - 1, 0)]))
        near = int((gap <= NEAR).sum())
    chars = len(text)
    small = text.lower()
    capitals = sum(map(str.isupper, text)) if small != text else 0
    odd = [c for c in CHUNK.findall(text) if MASKED.search(c)] if MASKED.search(text) else []
    undone = [c for c in odd if any(map(lexicon.hit, WORD.findall(c.lower().translate(LEET).replace("*", ""))))]
    drawn = [m for m in DRAWN.finditer(text)]
    undone += [m for m in drawn if any(w.lower() in INSULTS for w in WORD.findall(DRAWN.sub(r"\1", text[max(0, m.start() - 20) : m.end() + 20])))]
    spelled = [re.sub(r"[ .\-_*]", "", m[0]).lower() for m in SPELLED.finditer(text)]
    undone += [w for w in spelled if w in INSULTS]
    alnum = sum(map(len, words))
    return [
        np.log1p(n), len(fixed) / n, np.log1p(len(fixed)), sum(learnt) / n, np.log1p(len(learnt)), np.log1p(sum(s >= 4 for s in learnt)), max(learnt, default=0.0), len(hits) / n,
        len(second) / n, near / n, capitals / chars, sum(e[3] for _, e in entries) / n, max(0, chars - alnum - (n - 1)) / chars, text.count("!") / chars,
        len(odd) / n, len(drawn) / n, len(spelled) / n, np.log1p(len(undone)), min(40, max(map(len, words))), len(set(words)) / n, sum(map(str.isdigit, text)) / chars if any(c in text for c in "0123456789") else 0.0,
    ]


class Boosted:
    """Trees of logistic boosting over binned features."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 48, least: float = 1.5, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.edges: list[np.ndarray] = []
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, bin and value of each node, in heap order

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        b, p0 = self.binned(x), np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p0 / (1 - p0)))
        f, m = np.full(len(y), self.base), x.shape[1]
        place = b + np.arange(m) * self.bins
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            node, feature, split, value = np.zeros(len(y), np.int64), np.full(2 ** (self.depth + 1) - 1, -1), np.zeros(2 ** (self.depth + 1) - 1, np.int64), np.zeros(2 ** (self.depth + 1) - 1)
            for level in range(self.depth + 1):
                first, many = 2**level - 1, 2**level
                live = node >= first
                own = node[live] - first
                sg, sh = np.bincount(own, g[live], many), np.bincount(own, h[live], many)
                value[first : first + many] = -sg / (sh + self.ridge)
                if level == self.depth:
                    break
                at = (own[:, None] * (m * self.bins) + place[live]).ravel()
                hist = [np.bincount(at, np.repeat(z[live], m), many * m * self.bins).reshape(many, m, self.bins).cumsum(axis=2) for z in (g, h)]
                left_g, left_h = hist
                right_g, right_h = sg[:, None, None] - left_g, sh[:, None, None] - left_h
                gain = left_g**2 / (left_h + self.ridge) + right_g**2 / (right_h + self.ridge) - (sg**2 / (sh + self.ridge))[:, None, None]
                gain[(left_h < self.least) | (right_h < self.least)] = -1
                flat = gain.reshape(many, -1)
                best = flat.argmax(axis=1)
                good = flat[np.arange(many), best] > 1e-6
                feature[first : first + many] = np.where(good, best // self.bins, -1)
                split[first : first + many] = best % self.bins
                rows = np.flatnonzero(live)
                rows = rows[good[own]]
                k = node[rows]
                node[rows] = 2 * k + 1 + (b[rows, feature[k]] > split[k])
            self.trees.append((feature, split, value * self.rate))
            f += self.trees[-1][2][node]
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        b = self.binned(x)
        for feature, split, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                k = feature[node]
                inner = k >= 0
                node = np.where(inner, 2 * node + 1 + (b[np.arange(len(x)), np.maximum(k, 0)] > split[node]), node)
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising steps of least squares, by pooling adjacent violators: places, and values there; between them it is linear."""
    by = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[by], y[by], strict=True):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, a2 = blocks.pop()
            u = blocks[-1]
            blocks[-1] = [(u[0] * u[1] + v * n) / (u[1] + n), u[1] + n, (u[2] * u[1] + a2 * n) / (u[1] + n)]
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


class Scorer:
    """A fitted model in one process."""

    def __init__(self, lexicon: dict[str, float], trees: Boosted | None, places: np.ndarray, values: np.ndarray):
        self.learnt, self.trees, self.places, self.values = lexicon, trees, places, values
        self.lexicon = Lexicon(lexicon)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.values[0])
        raw = self.trees(np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), len(NAMES)))
        # A little of the plain log-odds keeps the order within the flat steps of calibration.
        return np.clip(0.98 * np.interp(raw, self.places, self.values) + 0.02 / (1 + np.exp(-raw)), 0, 1)


def trained(x: np.ndarray, y: np.ndarray, fold: np.ndarray, lexicon: dict[str, float]) -> Scorer:
    """x: features of texts, each as the lexicon of the other folds sees it. Calibration uses trees of the other folds."""
    if len(set(y.tolist())) < 2:
        return Scorer({}, None, np.zeros(1), np.array([y.mean() if len(y) else 0.5]))
    y, raw = y.astype(float), np.zeros(len(y))
    for k in np.unique(fold):
        own, other = fold == k, fold != k
        raw[own] = Boosted().fit(x[other], y[other])(x[own]) if other.any() else 0
    return Scorer(lexicon, Boosted().fit(x, y), *isotonic(raw, y))


def fit(texts: list[str], labels: np.ndarray, folds: int = 3) -> Scorer:
    """In one process what Toxicity does on executors."""
    fold, n, counts = np.array([fold_of(t, folds) for t in texts], int), np.zeros((folds, 2), int), {}
    for t, k, y in zip(texts, fold, labels, strict=True):
        n[k, y] += 1
        for p in entries(t):
            counts.setdefault(p, np.zeros((folds, 2), int))[k, y] += 1
    own = [Lexicon(x) for x in lexicons(counts, n)]
    x = np.array([features(t, own[k]) for t, k in zip(texts, fold, strict=True)]).reshape(len(texts), len(NAMES))
    by = np.lexsort((*x.T, labels, fold))
    return trained(x[by], labels[by], fold[by], own[-1].learnt)


class Toxicity:
    """labelled: rows with a text and a label 0 or 1. max_rows: None if they are bounded already."""

    def __init__(self, labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", max_rows: int | None = 12_000, folds: int = 3, least: int = 4):
        spark = labelled.sparkSession
        narrow_batches(spark)
        rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label IN (0, 1) AND text IS NOT NULL")
        rows = cut(rows if max_rows is None else bounded_sample(rows, max_rows, "text", "label"))

        def counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                found = [(p, fold_of(t, folds), y) for t, y in zip(*(c.to_pylist() for c in b.columns), strict=True) for p in ("", *entries(t))]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))], ["entry", "fold", "label"])

        # "" counts the texts themselves. Entries that fewer toxic texts have than a lexicon asks for stay behind.
        cells = [F.count_if((F.col("fold") == k) & (F.col("label") == y)) for k in range(folds) for y in (0, 1)]
        found = rows.mapInArrow(counts, "entry string, fold int, label int").groupBy("entry").agg(F.array(*cells).alias("n"), F.sum("label").alias("toxic"))
        found = {r.entry: np.array(r.n, int).reshape(folds, 2) for r in found.where((F.col("toxic") >= least) | (F.col("entry") == "")).select("entry", "n").collect()}
        own = lexicons({p: c for p, c in sorted(found.items()) if p}, found.get("", np.zeros((folds, 2), int)))
        words = spark.sparkContext.broadcast(own)

        def seen(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by = [Lexicon(x) for x in words.value]
            for b in parts:
                texts, labels = (c.to_pylist() for c in b.columns)
                fold = [fold_of(t, folds) for t in texts]
                x = [features(t, by[k]) for t, k in zip(texts, fold, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(labels, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["fold", "label", "x"])

        got = rows.mapInArrow(seen, "fold int, label int, x array<double>").toArrow()
        fold, y = (got.column(c).to_numpy() for c in ("fold", "label"))
        x = np.array(got.column("x").to_pylist(), float).reshape(len(y), len(NAMES))
        by = np.lexsort((*x.T, y, fold))  # whatever order rows come in
        self.scorer, name = trained(x[by], y[by], fold[by], own[-1]), uuid.uuid4().hex
        remove(spark, rows)
        sent = spark.sparkContext.broadcast(self.scorer)

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            return pa.array(once(name, lambda: sent.value)([t or "" for t in texts.to_pylist()]))

        self._score = score.asNondeterministic()

    def score(self, text: Column) -> Column:
        """double, 0 to 1: the calibrated chance that a text is toxic."""
        return self._score(text)


def labelled(df: DataFrame, labels: DataFrame, label_col: str, max_rows: int) -> DataFrame:
    """doc_id, text and label of about max_rows rows of labels (0 or 1), chosen by a hash: few enough to broadcast, so that texts stay where they are."""
    own = labels.select("doc_id", F.col(f"`{label_col}`").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    return df.select("doc_id", "text").join(F.broadcast(bounded_sample(own, max_rows, "doc_id", "label")), "doc_id")


def report(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, max_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score and predicted; learnt from the labelled rows that aren't held out."""
    held = lambda c: F.crc32(c.cast("string").cast("binary")) % 4 == 2
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    own = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).where(~held(F.col("doc_id")))
    model = Toxicity(labelled(rows, own, "label", max_rows), "text", "label", None)
    found = rows.select("doc_id", F.coalesce(held(F.col("doc_id")), F.lit(False)).alias("held_out"), model.score(F.col("text").cast("string")).alias("score"))
    return found.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
