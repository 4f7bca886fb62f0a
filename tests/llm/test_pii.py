"""Pseudonyms against a plain Python version of the same network."""

import calendar
import hashlib
import random
import re
from datetime import date, timedelta

import pytest

from quillon.llm import pii

KEY = "k"


def mix(key, *parts):
    return int(hashlib.sha256("|".join([key, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def feistel(a, b, sa, sb, key):
    for i in range(pii.ROUNDS):
        size = sa if i % 2 == 0 else sb
        a, b = b, (a + mix(key, i, sa, sb, b) % size) % size
    return a, b


def digits(d, key):
    h = len(d) // 2
    a, b = feistel(int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h), key)
    return f"{a:0{h}d}{b:0{len(d) - h}d}"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))


def refill(shape, new):
    it = iter(new)
    return re.sub(r"\d", lambda _: next(it), shape)


def brute(v):
    d = re.sub(r"\D", "", v)
    if "@" in v:
        name = hashlib.sha256(f"{KEY}email|{v.lower()}".encode()).hexdigest()[:12].translate(str.maketrans("0123456789abcdef", "abcdefghijklmnop"))
        return f"{name}@{v.rpartition('@')[2]}"
    if re.fullmatch(r"(?:\d{1,3}\.){3}\d{1,3}", v):
        o = list(map(int, v.split(".")))
        if max(o) > 255:
            return v
        a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, KEY + "ip")
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", v):
        areas = [x for x in range(1, 900) if x != 666]
        a, b = feistel(areas.index(int(v[:3])) * 99 + int(v[4:6]) - 1, int(v[7:]) - 1, 898 * 99, 9999, KEY + "ssn")
        return f"{areas[a // 99]:03}-{a % 99 + 1:02}-{b + 1:04}"
    if "(" in v or re.fullmatch(r"(?:\+\d+ )?\d{3}-\d{3}-\d{4}", v):
        return refill(v, d[:-10] + digits(d[-10:], KEY + "phone"))
    if re.fullmatch(r"[\d -]+", v) and len(d) > 12:
        if luhn(d) % 10 or not re.match(pii.CARD, d):
            return v
        keep = 1 if d[0] == "4" else 2 if d[:2] in ("51", "52", "53", "54", "55", "34", "37") else 4
        body = d[:keep] + digits(d[keep:-1], KEY + "card")
        return refill(v, body + str(-luhn(body + "0") % 10))
    raise AssertionError(v)


def day(iso, months=12, first=1, days=31):
    y, m, d = map(int, iso.split("-"))
    a, b = y - 1900, (m - 1) * days + d - first
    while True:
        a, b = feistel(a, b, 200, months * days, f"{KEY}day")
        y, m, d = 1900 + a, b // days + 1, b % days + first
        if d <= calendar.monthrange(y, m)[1]:
            return y, m, d


VALUES = [
    "jan.doe+x@mail.example.com", "é.34@mail7.example.com", "10.0.255.1", "4845 1681 1440 7329", "4845168114407329", "378282246310005", "5555555555554444",
    "+1 (017) 555-7713", "(212) 555-0187", "212-555-0187", "123-45-6789",
]
STAY = ["9807915762804491", "4845168114407328", "256.1.1.1", "000-12-3456", "1.2.3.4.5", "2023-02-30", "13/13/2020", "12345", "a@b", "x" * 40, "1" * 40, "31.04.2020", "1 2 3"]


def replaced(spark, texts):
    docs = spark.createDataFrame([(i, t, "keep", 5, 6) for i, t in enumerate(texts)], "doc_id long, text string, `__found` string, n int, `__NEW` int")
    rows = pii.pseudonymised(docs, KEY, count_col="hits").orderBy("doc_id").collect()
    assert all(r["__found"] == "keep" and r.n == 5 and r["__NEW"] == 6 for r in rows)
    return [(r.text, r.hits) for r in rows]


def test_key_is_required(spark):
    docs = spark.createDataFrame([(1, "4845168114407329")], "doc_id long, text string")
    with pytest.raises(TypeError):
        pii.pseudonymised(docs)
    with pytest.raises(ValueError):
        pii.pseudonymised(docs, "")
    assert pii.pseudonymised(docs, "a").first().text != pii.pseudonymised(docs, "b").first().text


def test_pseudonyms_pass_their_own_checks(spark):
    """As wide as the value, valid by the same rules, and none twice."""
    rng = random.Random(1)
    cards = set()
    for prefix, n in [("4", 13), ("4", 16), ("4", 19), ("34", 15), ("37", 15), ("6011", 16), ("65", 16)] + [(str(p), 16) for p in (*range(51, 56), *range(3528, 3590, 3), *range(2221, 2721, 40))]:
        for _ in range(8):
            body = prefix + "".join(rng.choices("0123456789", k=n - len(prefix) - 1))
            cards.add(body + str(-luhn(body + "0") % 10))
    ssn = {f"{rng.choice([x for x in range(1, 900) if x != 666]):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}" for _ in range(600)}
    days = [date(1900, 1, 1) + timedelta(rng.randrange(73049)) for _ in range(900)]
    dates = {f"{x.month}/{x.day}/{x.year}" for x in days} | {f"{x:%m/%d/%Y}" for x in days} | {f"{x.day}.{x.month}.{x.year}" for x in days} | {f"{x:%Y-%m-%d}" for x in days} | {f"{x.day}/{x.month}/{x.year}" for x in days if x.day > 12}
    for values, valid in (
        (cards, lambda v: luhn(v) % 10 == 0 and re.match(pii.CARD, v)),
        (ssn, lambda v: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", v)),
        (dates, is_date),
    ):
        values = sorted(values)
        got = replaced(spark, values)
        assert all(n == 1 and valid(w) and re.sub(r"\d", "0", w) == re.sub(r"\d", "0", v) for v, (w, n) in zip(values, got))
        assert len({w for w, _ in got}) == len(values)


def is_date(v):
    p = list(map(int, re.split("[-/.]", v)))
    y, m, d = p if "-" in v else p[::-1] if "." in v or p[0] > 12 else (p[2], p[0], p[1])
    return 1900 <= y <= 2099 and bool(date(y, m, d))


def test_values(spark):
    got = replaced(spark, VALUES + [f"See {v}, then {v}." for v in VALUES])
    want = [brute(v) for v in VALUES]
    assert got[: len(VALUES)] == [(w, 1) for w in want]
    assert got[len(VALUES) :] == [(f"See {w}, then {w}.", 2) for w in want]
    assert all(w != v for v, w in zip(VALUES, want))
    for v, w in zip(VALUES[3:7], want[3:7]):
        assert luhn(re.sub(r"\D", "", w)) % 10 == 0 and re.match(pii.CARD, re.sub(r"\D", "", w)) and len(v) == len(w)


def test_dates(spark):
    texts = ["2020-02-29", "12/31/1999", "31/12/1999", "24.12.2001", "1/2/2003", "13/1/2003", "1.12.2003"]
    (a, b, c, d, e, f, g) = day("2020-02-29"), day("1999-12-31"), day("1999-12-31", 12, 13, 19), day("2001-12-24"), day("2003-01-02", 9, 1, 9), day("2003-01-13", 9, 13, 19), day("2003-12-01", 12, 1, 9)
    want = [f"{a[0]}-{a[1]:02}-{a[2]:02}", f"{b[1]:02}/{b[2]:02}/{b[0]}", f"{c[2]:02}/{c[1]:02}/{c[0]}", f"{d[2]:02}.{d[1]:02}.{d[0]}", f"{e[1]}/{e[2]}/{e[0]}", f"{f[2]}/{f[1]}/{f[0]}", f"{g[2]}.{g[1]:02}.{g[0]}"]
    assert [t for t, _ in replaced(spark, texts)] == want


def test_what_stays(spark):
    texts = [*STAY, None, "", "plain words", "License, Version 2.0.", "\n\n"]
    assert replaced(spark, texts) == [(t, 0) for t in texts]


def test_secrets(spark):
    a, b = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    (x, n), (y, _), (z, _) = replaced(spark, [f'token = "{a}"', b, f"again {a}"])
    assert n == 1 and a not in x and x[9:49] in z and re.fullmatch("[0-9A-F]{40}", y) and y != b


def test_permutation_has_no_collisions(spark):
    df = spark.range(10_000).select(pii.permuted_digits(pii.F.lpad(pii.F.col("id").cast("string"), 4, "0"), KEY).alias("d"))
    assert df.distinct().count() == 10_000


def test_long_text_and_empty_table(spark):
    long = "word " * 200_000 + "4845168114407329 " + "w" * 500_000 + " " + "9" * 100_000
    (got, n), *_ = replaced(spark, [long])
    assert n == 1 and got == long.replace("4845168114407329", brute("4845168114407329"))
    assert pii.pseudonymised(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0


@pytest.mark.parametrize("left", ["", "a ", "(", '"', "é "])
def test_context(spark, left):
    assert replaced(spark, [f"{left}10.0.0.1!"])[0] == (f"{left}{brute('10.0.0.1')}!", 1)
