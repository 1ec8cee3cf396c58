"""Personal data: found by pattern, validated, and replaced by keyed pseudonyms of the same format.

Each value is a number in the domain of its format: the digits of a card but its first and its check digit, the day of a
date, the four bytes of an address, the letters and digits of an e-mail name. A Feistel network over that
domain, keyed, with cycle walking, permutes it: E. The pseudonym of x is D(E(x) + k), D being the inverse of E:
a permutation too, but one without fixed points, so that no value stays as it was. Equal values of a kind get equal
pseudonyms in all documents, however they are punctuated; check digits are computed anew.

Kinds: email (name permuted, host kept), phone (country code kept), card (13-19 digits, Luhn), ssn, iban (mod 97), ip (four
bytes), date (a day of 1900-2099: 2001-02-03, 03.02.2001, 3/2/2001, 3-2-2001; where day and month can't be told apart the
first is the day). A date's format is the order of its parts and the digits of each, and its pseudonym is of the same: where the
month comes first, which only a day beyond 12 shows, the other day lies beyond 12 too. Equal dates of one format stay linked, and
all formats with two digits for day and month whose first part isn't the month share one permutation. What fails validation isn't touched. A null text stays null, an empty one empty, and texts without
personal data stay as they are; repeated rows are treated alike; other columns pass through untouched.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeferry.llm.base import narrow_batches

# The kinds, and the patterns of values.
KINDS = ("email", "phone", "card", "ssn", "iban", "ip", "date")
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", re.ASCII)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.ASCII)
#: Where numbers can be: whole runs of their characters, taken once, so that a scan is linear.
NUMBERS = re.compile(r"[0-9 .()/+-]{7,}+", re.ASCII)
NUMBER = re.compile(
    r"""
    (?P<date>(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?P<sep>[./-])[0-9]{1,2}(?P=sep)[0-9]{4})(?![0-9]))
  | (?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
  | (?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]))
  | (?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9]))
  | (?P<phone>(?:(?:(?<![0-9])\+?1[ .-]?)?\([0-9]{3}\)[ .-]?|(?<![0-9])(?:\+?1[ .-])?[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])
            | \+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?![0-9]))
    """.replace("[ .-]", r"[\x20.-]"),
    re.ASCII | re.VERBOSE,
)
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
ROUNDS = 10


class Feistel:
    """A keyed permutation, without fixed points, of 0 .. size - 1."""

    def __init__(self, key: bytes, tweak: str, size: int):
        if size < 2:
            raise ValueError("a domain has two values at least")
        self.key, self.tweak, self.size = key, tweak.encode(), size
        self.half = next(h for h in (int(size**0.5) - 1, 1) if h * h <= size) if size < 1 << 50 else 1 << (size.bit_length() - 1) // 2
        while self.half * self.half < size:
            self.half += 1 if size < 1 << 50 else self.half
        self.shift = 1 + self._f(-1, 0) % (size - 1)

    def _f(self, n: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%s|%d|%d|%d" % (self.tweak, self.size, n, x), key=self.key, digest_size=64).digest())

    def _walk(self, x: int, forth: bool) -> int:
        while True:
            a, b = divmod(x, self.half)
            for n in range(ROUNDS) if forth else reversed(range(ROUNDS)):
                a, b = (b, (a + self._f(n, b)) % self.half) if forth else ((b - self._f(n, a)) % self.half, a)
            x = a * self.half + b
            if x < self.size:
                return x

    def __call__(self, x: int) -> int:
        return self._walk((self._walk(x, True) + self.shift) % self.size, False)

    def inverse(self, x: int) -> int:
        return self._walk((self._walk(x, True) - self.shift) % self.size, False)


@lru_cache(512)
def feistel(key: bytes, tweak: str, size: int) -> Feistel:
    return Feistel(key, tweak, size)


def luhn(digits: str) -> int:
    """The check digit that belongs behind these digits."""
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(digits)))
    return -total % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _day(text: str) -> tuple[int, str, tuple[int, ...]] | None:
    """The day that a date names, the order of its parts and the digits of each."""
    parts = re.split("[./-]", text)
    order = "ymd" if len(parts[0]) == 4 else "mdy" if int(parts[1]) > 12 else "dmy"
    part = dict(zip(order, map(int, parts), strict=True))
    try:
        day = datetime.date(part["y"], part["m"], part["d"]).toordinal()
    except ValueError:
        return None
    return (day, order, tuple(map(len, parts))) if FIRST_DAY <= day <= LAST_DAY else None


@lru_cache(32)
def _days(least_day: int, most_day: int, most_month: int) -> np.ndarray:
    """The days that a format can write, ascending."""
    every = (datetime.date.fromordinal(n) for n in range(FIRST_DAY, LAST_DAY + 1))
    return np.array([d.toordinal() for d in every if least_day <= d.day <= most_day and d.month <= most_month])


def _classes(text: str) -> list[str]:
    """For each character, the characters that can stand in its place; for one that must stay, itself."""
    return [next((a for a in (string.ascii_lowercase, string.ascii_uppercase, string.digits) if c in a), c) for c in text]


def _mixed(key: bytes, tweak: str, text: str) -> str:
    """A permutation of the texts with letters and digits in the same places."""
    classes, size, x = _classes(text), 1, 0
    for a, c in zip(classes, text, strict=True):
        size, x = size * len(a), x * len(a) + a.index(c)
    if size < 2:
        return text
    x, out = feistel(key, tweak, size)(x), []
    for a in reversed(classes):
        x, k = divmod(x, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def _put(digits: str, form: str) -> str:
    """The digits in the places that digits have in form."""
    own = iter(digits)
    return "".join(next(own) if c.isdigit() else c for c in form)


@lru_cache(100_000)
def pseudonym(key: bytes, kind: str, value: str) -> str | None:
    """The value's pseudonym, or None if it isn't a valid value of its kind."""
    digits = "".join(c for c in value if c in string.digits)
    if kind == "email":
        name, _, host = value.partition("@")
        return f"{_mixed(key, kind, name)}@{host}"
    if kind == "phone":
        if not 8 <= len(digits) <= 15 or value.count("(") != value.count(")"):
            return None
        code = len(digits) - 10 if len(digits) > 10 else len(digits) - 7 if value[0] == "+" else 0
        code = min(max(code, 1 if value[0] == "+" else 0), 3)
        return _put(digits[:code] + _mixed(key, kind, digits[code:]), value)
    if kind == "card":
        if luhn(digits[:-1]) != int(digits[-1]) or digits[0] == "0":
            return None
        own = digits[0] + _mixed(key, kind, digits[1:-1])
        return _put(own + str(luhn(own)), value)
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(feistel(key, kind, 898 * 99 * 9999)(x), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "iban":
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or mod97(plain) != 1:
            return None
        own = _mixed(key, kind + plain[:2], plain[4:])
        check = 98 - mod97(f"{plain[:2]}00{own}")
        chars = iter(f"{plain[:2]}{check:02d}{own}")
        return "".join(c if c == " " else next(chars) for c in value)
    if kind == "ip":
        parts = value.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        x = feistel(key, kind, 1 << 32)(int.from_bytes(bytes(map(int, parts))))
        return ".".join(map(str, x.to_bytes(4)))
    if (found := _day(value)) is None:
        return None
    day, order, digits_of = found
    width = dict(zip(order, digits_of, strict=True))
    limits = 13 if order == "mdy" else 1, 31 if width["d"] == 2 else 9, 12 if width["m"] == 2 else 9
    own = _days(*limits)
    # All two-digit forms that aren't month-first have the same domain, and so the same permutation.
    d = datetime.date.fromordinal(int(own[feistel(key, kind, len(own))(int(np.searchsorted(own, day)))]))
    sep = next(c for c in value if not c.isdigit())
    return sep.join(f"{n:0{width[p]}d}" for p, n in zip(order, ({"y": d.year, "m": d.month, "d": d.day}[p] for p in order), strict=True))


def find(key: bytes, text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind and pseudonym of each valid value, by start; of values that overlap the first stays."""
    found = []
    if "@" in text:
        found += [(*m.span(), "email", m[0]) for m in EMAIL.finditer(text)]
    for run in NUMBERS.finditer(text):
        # From the first character that a number may start with to the last digit.
        a, b = run.end() - len(run[0].lstrip(" .)/-")), run.start() + len(run[0].rstrip(" .()/+-"))
        if b - a >= 7:
            found += [(*m.span(), m.lastgroup if m.lastgroup != "sep" else "date", m[0]) for m in NUMBER.finditer(text, a, b)]
    if found or any(c.isdigit() for c in text):
        found += [(*m.span(), "iban", m[0]) for m in IBAN.finditer(text)]
    out, end = [], 0
    for a, b, kind, value in sorted(found):
        if a >= end and (other := pseudonym(key, kind, value)) is not None:
            out.append((a, b, kind, other))
            end = b
    return out


SPANS = "array<struct<kind: string, start: int, end: int>>"


class Pseudonymiser:
    """key: the secret that the permutations depend on; keep it if pseudonyms must link across runs."""

    def __init__(self, spark: SparkSession, key: bytes):
        if not 16 <= len(key) <= 64:
            raise ValueError("a key has 16 to 64 bytes")
        narrow_batches(spark)
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        both = pa.struct([("text", pa.string()), ("spans", pa.list_(span))])

        @F.arrow_udf(f"struct<text: string, spans: {SPANS}>")
        def swap(texts: pa.Array) -> pa.Array:
            out = []
            for t in texts.to_pylist():
                found, parts, at = find(key, t or ""), [], 0
                for a, b, _, other in found:
                    parts += [t[at:a], other]
                    at = b
                out.append({"text": t if not found else "".join([*parts, t[at:]]), "spans": [{"kind": k, "start": a, "end": b} for a, b, k, _ in found]})
            return pa.array(out, both)

        self._swap = swap

    def __call__(self, text: Column) -> Column:
        """struct<text, spans>: the text with pseudonyms, and where in the given text they went."""
        return self._swap(text)


def pseudonymise(df: DataFrame, swap: Pseudonymiser, text_col: str = "text") -> DataFrame:
    """df with pseudonyms in its text column; columns and their order stay."""
    return df.withColumn(text_col, swap(F.col(f"`{text_col}`").cast("string"))["text"])


def report(df: DataFrame, swap: Pseudonymiser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, spans (kind:start:end in the given text, comma-joined) and the number of values of each kind."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), swap(F.col(f"`{text_col}`").cast("string")).alias("found"))
    count = lambda kind: F.size(F.filter("found.spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        F.col("found.text").alias("text"),
        F.array_join(F.transform("found.spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",").alias("spans"),
        F.size("found.spans").cast("long").alias("n_spans"),
        *(count(k).alias(f"n_{k}") for k in KINDS),
    )
