"""Personal data to format-preserving pseudonyms, in DataFrame expressions only.

Validated numbers (cards, phones, social security numbers, IPv4 addresses) and dates are
permuted by a keyed Feistel network within their own format: a pseudonym is as wide as its value
and passes the same checks, equal values stay equal across documents and different ones stay
different. Where the values of a format are no full rectangle of numbers (dates), the network walks on until it
meets one. E-mail names and hexadecimal secrets have no
number format; they become keyed digests of the same shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm.common import free_name

ROUNDS = 8
#: Bound on cycle-walking: of the days that a date can fall on more than nine in ten exist, so a walk that long has a chance below 1e-15.
WALKS = 16
FIRST_YEAR, YEARS = 1900, 200

# Formats of the values looked for.
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*+)(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+"
_HEX = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
_IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
_PHONE = r"(?<![\d+])(?:\+?\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+-])(?:\+\d{1,3}[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{1,2}/\d{1,2}/\d{4}(?![\d/])|(?<![\d.])\d{1,2}\.\d{1,2}\.\d{4}(?!\d|\.\d)"
_CARD = r"(?<![\d])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|3\d{3}[ -]\d{6}[ -]\d{5})(?!\d)"
ANY = "|".join([_EMAIL, _HEX, _IP, _PHONE, _SSN, _DATE, _CARD])
#: Card networks by leading digits and length.
CARD = r"^(?:4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|6(?:011|5\d\d)\d{12}|35(?:2[89]|[3-8]\d)\d{12})$"


def _mix(key: str, *parts: Column) -> Column:
    """60 bits that depend on the key and the parts."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[x.cast("string") for x in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, size_left: Column, size_right: Column, key: str) -> Column:
    """struct(a, b): a keyed permutation of pairs with left < size_left and right < size_right.

    Sides swap their ranges each round, and ROUNDS is even, so the result has the ranges of
    the input.
    """

    def turn(x: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, size_left).otherwise(size_right)
        return F.struct(x["b"].alias("a"), F.pmod(x["a"] + F.pmod(_mix(key, i, size_left, size_right, x["b"]), size), size).alias("b"))

    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permuted_digits(digits: Column, key: str) -> Column:
    """A permutation of the digit strings of each length from 2 to 36."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    got = feistel(F.substring(digits, F.lit(1), half).cast("long"), F.substring(digits, half + 1, n - half).cast("long"), power(half), power(n - half), key)
    # One lambda variable, so that the network is evaluated once.
    out = F.transform(F.array(got), lambda x: F.concat(F.lpad(x["a"].cast("string"), half, "0"), F.lpad(x["b"].cast("string"), n - half, "0")))
    return F.element_at(out, 1)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit counting once."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _let(value: Column, f) -> Column:
    """f(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _refill(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced in order by `digits`."""

    def put(x: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(x["out"], F.when(is_digit, F.substring(digits, x["k"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (x["k"] + is_digit.cast("int")).alias("k"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    return F.aggregate(F.split(shape, ""), start, put, lambda x: x["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(value: Column, key: str) -> Column:
    """Leading digits that name the network stay; the last digit is the Luhn check of the new number."""

    def new(d: Column) -> Column:
        keep = F.when(d.startswith("4"), 1).when(d.rlike("^(?:5[1-5]|3[47])"), 2).otherwise(4)
        body = F.concat(F.substring(d, F.lit(1), keep), permuted_digits(F.substring(d, keep + 1, F.length(d) - keep - 1), f"{key}card"))
        return _let(body, lambda b: F.concat(b, F.pmod(10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    def check(d: Column) -> Column:
        return F.when(d.rlike(CARD) & (_luhn_sum(d) % 10 == 0), _refill(value, new(d)))

    return _let(_digits(value), check)


def _phone(value: Column, key: str) -> Column:
    """The ten digits of the national number are permuted; a country code stays."""

    def new(d: Column) -> Column:
        code = F.length(d) - 10
        return _refill(value, F.concat(F.substring(d, F.lit(1), code), permuted_digits(F.substring(d, code + 1, F.lit(10)), f"{key}phone")))

    return _let(_digits(value), new)


def _ssn(value: Column, key: str) -> Column:
    """Numbers that can be issued are a rectangle: 898 areas (none is 000, 666 or 9xx) by 99 groups, and 9999 serials."""
    valid = value.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")
    area, group, serial = (F.substring(value, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    place = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1

    def spelt(x: Column) -> Column:
        area = F.floor(x["a"] / 99) + 1
        area = area + F.when(area >= 666, 1).otherwise(0)
        parts = ((area, 3), (x["a"] % 99 + 1, 2), (x["b"] + 1, 4))
        return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in parts])

    sizes = (F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"))
    return F.when(valid, _let(feistel(place, serial - 1, *sizes, f"{key}ssn"), spelt))


def _ip(value: Column, key: str) -> Column:
    """An address is two halves of 16 bits."""
    four = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))

    def new(o: Column) -> Column:
        side = F.lit(65536).cast("long")
        got = feistel(F.get(o, 0) * 256 + F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3), side, side, f"{key}ip")
        parts = lambda x: [F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256]
        return _let(got, lambda x: F.concat_ws(".", *[p.cast("int").cast("string") for p in parts(x)]))

    return F.when(F.forall(four, lambda x: x <= 255), _let(four, new))


def _day(year: Column, month: Column, day: Column, months: Column, first: Column, days: Column, key: str) -> Column:
    """struct(year, month, day): a permutation of the dates of YEARS with month 1..months and day first..first+days-1."""
    years = F.lit(YEARS).cast("long")
    size = (months * days).cast("long")
    month_of = lambda b: (F.floor(b / days) + 1).cast("int")
    day_of = lambda b: (b % days + first).cast("int")
    last = lambda g: F.dayofmonth(F.last_day(F.make_date((g["a"] + FIRST_YEAR).cast("int"), month_of(g["b"]), F.lit(1))))

    def walk(x: Column, _: Column) -> Column:
        step = lambda g: F.struct(g["a"].alias("a"), g["b"].alias("b"), (day_of(g["b"]) <= last(g)).alias("done"))
        return F.when(x["done"], x).otherwise(_let(feistel(x["a"], x["b"], years, size, f"{key}day"), step))

    start = F.struct((year - FIRST_YEAR).cast("long").alias("a"), ((month - 1) * days + day - first).cast("long").alias("b"), F.lit(False).alias("done"))
    spelt = lambda x: F.struct((x["a"] + FIRST_YEAR).alias("year"), month_of(x["b"]).alias("month"), day_of(x["b"]).alias("day"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, walk, spelt)


def _date(value: Column, key: str) -> Column:
    """Year-month-day, month/day/year (day/month/year where only that is a date), day.month.year, from 1900 to 2099.

    Years, months and days keep their widths: a month of one digit becomes one of 1 to 9, and one of
    two digits any month, with a zero before it where it needs one; so days.
    """
    p = F.split(value, r"[-/.]")
    a, b, c = F.get(p, 0), F.get(p, 1), F.get(p, 2)

    def new(y: Column, m: Column, d: Column, spell, late: bool = False) -> Column:
        date = F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        ok = date.between(F.lit(f"{FIRST_YEAR}-01-01").cast("date"), F.lit(f"{FIRST_YEAR + YEARS - 1}-12-31").cast("date"))
        months = F.when(F.length(m) == 1, 9).otherwise(12)
        first, days = (F.lit(13), F.lit(19)) if late else (F.lit(1), F.when(F.length(d) == 1, 9).otherwise(31))
        got = _day(y.cast("int"), m.cast("int"), d.cast("int"), months, first, days, key)
        parts = lambda x: spell(x["year"].cast("string"), F.lpad(x["month"].cast("string"), F.length(m), "0"), F.lpad(x["day"].cast("string"), F.length(d), "0"))
        return F.when(ok, _let(got, parts))

    iso = new(a, b, c, lambda y, m, d: F.concat_ws("-", y, m, d))
    slash = F.coalesce(
        F.when(a.cast("int") <= 12, new(c, a, b, lambda y, m, d: F.concat_ws("/", m, d, y))),
        F.when(a.cast("int") > 12, new(c, b, a, lambda y, m, d: F.concat_ws("/", d, m, y), True)),
    )
    return F.when(value.contains("-"), iso).when(value.contains("/"), slash).otherwise(new(c, b, a, lambda y, m, d: F.concat_ws(".", d, m, y)))


def _email(value: Column, key: str) -> Column:
    """A name of twelve letters from a keyed digest of the lower-cased address; the domain stays."""
    name = F.translate(F.substring(F.sha2(F.concat(F.lit(f"{key}email|"), F.lower(value)), 256), 1, 12), "0123456789abcdef", "abcdefghijklmnop")
    return F.concat(name, F.lit("@"), F.substring_index(value, "@", -1))


def _secret(value: Column, key: str) -> Column:
    """Hexadecimal of the same length and case; plain words and numbers of one kind are no secret."""
    new = F.substring(F.sha2(F.concat(F.lit(f"{key}hex|"), F.lower(value)), 512), F.lit(1), F.length(value))
    return F.when(value.rlike("[0-9]") & value.rlike("[A-Fa-f]"), F.when(value.rlike("[A-F]"), F.upper(new)).otherwise(new))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one match of ANY, or null where the value is not valid."""
    is_ip = value.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$")
    is_date = value.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})$")
    return (
        F.when(value.contains("@"), _email(value, key))
        .when(is_ip, _ip(value, key))
        .when(is_date, _date(value, key))
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(value, key))
        .when(value.rlike(r"\)|^(?:\+\d{1,3}[ .-])?\d{3}[.-]\d{3}[.-]\d{4}$"), _phone(value, key))
        .when(value.rlike(r"^[\d -]+$"), _card(value, key))
        .otherwise(_secret(value, key))
    )


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """`docs` with personal data in `text_col` replaced; with `count_col`, how many values were.

    Who has the key can undo the permutations: it has no default, and an empty one is an error.
    Values that only look like one (a number that fails its check digit or network, an address
    with an octet over 255, a day that no calendar has) stay. A null text stays null with count
    0; an empty text stays empty; texts count whole, however long; rows are independent, so
    repeated rows give repeated results; an empty table gives none; other columns pass through
    as they are, whatever their names.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col(f"`{text_col}`")
    names = free_name(docs.columns, "__found"), free_name(docs.columns, "__new")
    was, new = map(F.col, names)
    found = F.when(text.rlike("[0-9@]|[0-9A-Fa-f]{32}"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    work = docs.withColumn(names[0], found)
    pairs = F.transform(was, lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new")))
    work = work.withColumn(names[1], F.when(F.size(was) > 0, pairs))
    between = F.split(text, ANY, -1)
    values = F.concat(F.transform(new, lambda x: F.coalesce(x["new"], x["old"])), F.array(F.lit("")))
    rebuilt = F.array_join(F.flatten(F.zip_with(between, values, lambda a, b: F.array(a, b))), "")
    work = work.withColumn(text_col, F.when(F.size(was) > 0, rebuilt).otherwise(text))
    if count_col:
        work = work.withColumn(count_col, F.coalesce(F.size(F.filter(new, lambda x: x["new"].isNotNull())), F.lit(0)))
    return work.drop(*names)
