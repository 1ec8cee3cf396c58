import datetime
import ipaddress
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeferry.llm.pii import EMAIL, IBAN, NUMBER, Feistel, Pseudonymiser, find, luhn, mod97, pseudonym, pseudonymise, report

KEY = b"0123456789abcdef"
VALUES = {
    "email": ["34@mail7.example.com", "jane.Doe+x@host.example.org"],
    "phone": ["+1 (584) 555-6753", "(584) 555-6753", "584-555-6753", "+49 30 1234567"],
    "card": ["4311575929938279", "4311 5759 2993 8279"],
    "ssn": ["123-45-6789"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "ip": ["81.190.225.143"],
    "date": ["2001-02-03", "31.12.1999", "02/28/2004"],
}


@pytest.mark.parametrize("size", [2, 10, 26, 1000, 73049])
def test_permutes_without_fixed_points(size):
    f = Feistel(KEY, "t", size)
    seen = [f(x) for x in range(min(size, 3000))]
    assert len(set(seen)) == len(seen) and all(0 <= y < size and y != x and f.inverse(y) == x for x, y in enumerate(seen))


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 10**90), st.integers(0))
def test_any_domain(size, x):
    f = Feistel(KEY, "t", size)
    assert f.inverse(f(x % size)) == x % size != f(x % size) < size


def test_values():
    for kind, values in VALUES.items():
        for v in values:
            for text in (v, f"über {v}, and", f"x\n{v}\ny"):
                [(a, b, k, other)] = find(KEY, text)
                assert (text[a:b], k) == (v, kind) and other != v and find(KEY, other)[0][2] == kind
                assert [c.isdigit() for c in other] == [c.isdigit() for c in v] or kind in ("ip", "iban")
    assert pseudonym(KEY, "card", "4311 5759 2993 8279").replace(" ", "") == (c := pseudonym(KEY, "card", "4311575929938279"))
    assert luhn(c[:-1]) == int(c[-1]) and mod97(pseudonym(KEY, "iban", "DE89370400440532013000")) == 1


@pytest.mark.parametrize("text", ["4311575929938270", "2001-02-30", "31.13.1999", "256.1.1.1", "1.2.3.4.5", "000-45-6789", "Version 2.0, January 2004", "12345", "a@b", "9" * 5000, "GB82 WEST 1234 5698 7654 33"])
def test_what_is_not_valid_stays(text):
    assert find(KEY, text) == []


def test_frames(spark):
    swap = Pseudonymiser(spark, KEY)
    hot = "call +1 (584) 555-6753 or 81.190.225.143"
    rows = [(1, hot, "a"), (2, hot, "b"), (2, hot, "b"), (3, None, None), (4, "", "c"), (5, "clean", "d"), (6, "x " * 50_000 + hot, "e"), (None, "+1 (584) 555-6753", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pseudonymise(df, swap)
    assert got.columns == df.columns
    texts = [r.text for r in got.collect()]
    assert texts[0] == texts[1] == texts[2] != hot and texts[3:6] == [None, "", "clean"] and texts[6].endswith(texts[0]) and texts[7] in texts[0]
    found = report(df, swap).collect()
    assert [r.n_spans for r in found] == [2, 2, 2, 0, 0, 0, 2, 1] and found[0].spans == "phone:5:22,ip:26:40"
    assert report(df.limit(0), swap).count() == 0


def valid(kind, value):
    """Validity by other means than the operator's."""
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "card":
        return digits[0] != 0 and sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0
    if kind == "ssn":
        return value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000"
    if kind == "ip":
        try:
            return str(ipaddress.IPv4Address(value)) == value
        except ValueError:
            return False
    if kind == "date":
        sep = next(c for c in value if not c.isdigit())
        forms = ["%Y-%m-%d"] if value[:4].isdigit() else [f"%d{sep}%m{sep}%Y", f"%m{sep}%d{sep}%Y"]
        for f in forms:
            try:
                return 1900 <= datetime.datetime.strptime(value, f).year < 2100
            except ValueError:
                pass
        return False
    if kind == "phone":
        return 8 <= len(digits) <= 15 and value.count("(") == value.count(")")
    if kind == "iban":
        own = value.replace(" ", "")
        return 15 <= len(own) <= 34 and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1
    return True


def brute(text):
    """All patterns over the whole text, no stretch of it left out; of valid values that overlap the first stays."""
    found = [(m.span(), "email") for m in EMAIL.finditer(text)] + [(m.span(), "iban") for m in IBAN.finditer(text)]
    for run in re.finditer(r"[0-9 .()/+-]+", text):
        for cut in [run[0].rstrip(" .()/+-")]:
            found += [((m.start() + run.start(), m.end() + run.start()), "date" if m.lastgroup == "sep" else m.lastgroup) for m in NUMBER.finditer(cut)]
    out, end = [], 0
    for (a, b), kind in sorted(found):
        if a >= end and valid(kind, text[a:b]):
            out.append((a, b, kind))
            end = b
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([v for own in VALUES.values() for v in own] + ["1", "23", "456", "7890", "-", ".", " ", "(", ")", "+", "/", "x", "GB82", "@", "4311575929938270", "2001-02-30", "é"]), max_size=8).map("".join))
def test_finds_what_brute_force_does(text):
    assert [f[:3] for f in find(KEY, text)] == brute(text)


def test_pseudonyms_permute_each_format():
    r = random.Random(1)
    day = lambda: datetime.date(1900, 1, 1) + datetime.timedelta(r.randrange(73049))
    days = [day() for _ in range(4000)]
    forms = {
        "ymd": [f"{d:%Y-%m-%d}" for d in days],
        "padded": [f"{d:%d.%m.%Y}" for d in days],
        "short": [f"{d.day}/{d.month}/{d.year}" for d in days if d.day < 10 and d.month < 10],
        "short day": [f"{d.day}-{d.month:02d}-{d.year}" for d in days if d.day < 10],
        "month first": [f"{d:%m/%d/%Y}" for d in days if d.day > 12],
        "month first, short": [f"{d.month}/{d.day}/{d.year}" for d in days if d.day > 12 and d.month < 10],
    }
    for name, values in forms.items():
        out = {v: pseudonym(KEY, "date", v) for v in values}
        assert len(set(out.values())) == len(out) and all(v != o and [c.isdigit() or c for c in v] == [c.isdigit() or c for c in o] and valid("date", o) for v, o in out.items())
        if name.startswith("month"):
            assert all(int(o.split("/")[1]) > 12 for o in out.values())
    assert all(pseudonym(KEY, "date", f"{d:%Y-%m-%d}") == "-".join(reversed(pseudonym(KEY, "date", f"{d:%d.%m.%Y}").split("."))) for d in days[:500] if d.day <= 12)
    for kind, values in VALUES.items():
        for v in values:
            assert valid(kind, pseudonym(KEY, kind, v))


@pytest.mark.parametrize("text", ["(" * 1_000_000, "1 (" * 300_000, "a@" * 300_000, "a" * 1_000_000 + "@", "1.1." * 250_000, "GB82 " * 200_000, "+1 " * 300_000])
def test_scans_in_linear_time(text):
    began = time.perf_counter()
    find(KEY, text)
    assert time.perf_counter() - began < 5
