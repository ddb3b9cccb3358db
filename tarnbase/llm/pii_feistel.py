"""PII: format-preserving Feistel pseudonyms, in DataFrame operations only.

Matches are validated (Luhn numbers, calendar dates, octets, shapes) and permuted under a key within their format: equal
values get equal pseudonyms in every document, different values different ones, and a valid value a valid one. Each format has a domain of its own that the
permutation keeps to: strings by a Feistel network that shifts each character within its class (digit, lower, upper; others stay); numbers by one on pairs:
dates as days of a 400-year cycle (146,097 = 189 * 773; slashed dates with a day above 12 in front, which only day first can be, as the 88,497 = 9 * 9,833 such days), IPv4 addresses as two
16-bit halves, social security numbers as area and the rest (898 * 989,901), Luhn numbers by all digits but the last, which follows.

The key is the caller's; there is none here. Defined cases: a null text stays null; a text without matches stays as it is; invalid look-alikes (leading zeros of octets included) stay; whole
texts of any length; equal rows give equal rows; an empty table gives an empty table; other columns pass through, one named like a result's is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# Patterns of the kinds, tried in this order at each place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}"
_PHONE_GIVEN = r"(?<![0-9])\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])"
# E.164 with optional separators, 8 to 15 digits in all; national numbers of ten digits with separators.
_PHONE_WORLD = r"(?<![0-9+])\+(?=[1-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])(?![ .()-]{1,2}[0-9]))[1-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,14}))+(?![0-9])"
_PHONE_NATIONAL = r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"
PHONE = "|".join((_PHONE_GIVEN, _PHONE_WORLD, _PHONE_NATIONAL))
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/.])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
PATTERN = "|".join((EMAIL, PHONE, DATE, SOCIAL, CARD, ADDRESS))
KINDS = ("email", "phone", "date", "social", "card", "address")


def bound(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is used: Spark would copy its expression to each place."""
    return F.transform(F.array(value), use)[0]


def _number(*parts: Column) -> Column:
    """A keyed number below 2^48."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12), 16, 10).cast("long")


def _shifted(part: Column, stream: Column, sign: int) -> Column:
    """Each character moved within its class by four hex digits of the stream."""

    def moved(i: Column) -> Column:
        c = F.substr(part, i, F.lit(1))
        k = F.conv(F.substr(stream, ((i - 1) % 15) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        out = c
        for low, high, n in (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26)):
            code = (F.ascii(c) - ord(low) + n + sign * (k % n)) % n + ord(low)
            out = F.when(c.between(low, high), F.char(code)).otherwise(out)
        return out

    return F.when(F.length(part) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(part))), moved), ""))


def permute_text(value: Column, kind: str, key: str, inverse: bool = False) -> Column:
    """Feistel permutation of a string that keeps the class of every character."""
    half = lambda v: F.floor(F.length(v) / 2).cast("int")
    start = bound(value, lambda v: F.struct(F.substr(v, F.lit(1), half(v)).alias("a"), F.substr(v, half(v) + 1).alias("b")))

    def forth(acc: Column, r: Column) -> Column:
        return F.struct(acc["b"].alias("a"), _shifted(acc["a"], F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), acc["b"]), 256), 1).alias("b"))

    def back(acc: Column, r: Column) -> Column:
        return F.struct(_shifted(acc["b"], F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), acc["a"]), 256), -1).alias("a"), acc["a"].alias("b"))

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, back if inverse else forth, lambda acc: F.concat(acc["a"], acc["b"]))


def permute_number(a: Column, b: Column, size_a: int, size_b: int, kind: str, key: str, inverse: bool = False) -> Column:
    """Feistel permutation of pairs (a, b) with a < size_a and b < size_b; a struct of both."""
    sign = -1 if inverse else 1

    def step(acc: Column, r: Column) -> Column:
        f_b = _number(F.lit(key), F.lit(kind), r.cast("string"), acc["b"].cast("string"))
        f_a = _number(F.lit(key), F.lit(kind), r.cast("string"), acc["a"].cast("string"))
        odd = r % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(acc["a"] + sign * (f_b % size_a), F.lit(size_a))).otherwise(acc["a"]).cast("long").alias("a"),
            F.when(odd, acc["b"]).otherwise(F.pmod(acc["b"] + sign * (f_a % size_b), F.lit(size_b))).cast("long").alias("b"),
        )

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def luhn_sum(digits: Column, skip: int = 0) -> Column:
    """Luhn sum of a string of digits, as if `skip` digits followed."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when((i + skip) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits))), F.lit(0), add)


def _date_parts(m: Column) -> tuple[Column, Column, Column, Column]:
    iso = F.substr(m, F.lit(5), F.lit(1)) == "-"
    cut = lambda i, n: F.substr(m, F.lit(i), F.lit(n)).cast("int")
    # The other form is month first, unless only day first can be a date.
    first, second = cut(1, 2), cut(4, 2)
    day_first = first > 12
    year = F.when(iso, cut(1, 4)).otherwise(cut(7, 4))
    month = F.when(iso, cut(6, 2)).otherwise(F.when(day_first, second).otherwise(first))
    day = F.when(iso, cut(9, 2)).otherwise(F.when(day_first, first).otherwise(second))
    return year, month, day, iso


def kind_of(match: Column) -> Column:
    """The kind of a valid match, else null."""

    def of(m: Column) -> Column:
        year, month, day, _ = _date_parts(m)
        real = year.between(1800, 2199) & month.between(1, 12) & (day >= 1)
        last = F.dayofmonth(F.last_day(F.make_date(F.greatest(F.lit(1800), F.least(F.lit(2199), year)), F.greatest(F.lit(1), F.least(F.lit(12), month)), F.lit(1))))
        return (
            F.when(m.contains("@"), "email")
            .when(m.startswith("+"), "phone")
            .when(m.rlike(r"^(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$"), "phone")
            .when(m.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})$"), F.when(real & (day <= last), "date"))
            .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~m.rlike("^(000|666|9)|-00-|-0000$"), "social"))
            .when(m.contains("."), F.when(F.forall(F.split(m, r"\."), lambda o: (o.cast("int") <= 255) & ((o == "0") | ~o.startswith("0"))), "address"))
            .otherwise(F.when(bound(F.regexp_replace(m, "[^0-9]", ""), luhn_sum) % 10 == 0, "card"))
        )

    return bound(match, of)


def _two(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _card(m: Column, key: str, inverse: bool) -> Column:
    """The domain is the set of Luhn-valid numbers: the check digit follows from the others."""
    check = lambda d: ((10 - luhn_sum(d, 1) % 10) % 10).cast("string")
    body = permute_text(F.substr(m, F.lit(1), F.length(m) - 1), "card", key, inverse)
    return bound(body, lambda b: F.concat(b, bound(F.regexp_replace(b, "[^0-9]", ""), check)))


def _address(m: Column, key: str, inverse: bool) -> Column:
    octet = lambda i: F.element_at(F.split(m, r"\."), i).cast("long")
    halves = permute_number(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 65536, 65536, "address", key, inverse)
    return bound(halves, lambda h: F.concat_ws(".", *[x.cast("string") for x in (F.floor(h["a"] / 256), h["a"] % 256, F.floor(h["b"] / 256), h["b"] % 256)]))


def _social(m: Column, key: str, inverse: bool) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    cut = lambda i, n: F.substr(m, F.lit(i), F.lit(n)).cast("long")
    area = cut(1, 3) - 1 - (cut(1, 3) > 666).cast("long")
    moved = permute_number(area, (cut(5, 2) - 1) * 9999 + cut(8, 4) - 1, 898, 99 * 9999, "social", key, inverse)
    shown = lambda d: F.concat_ws("-", _two(d["a"] + 1 + (d["a"] >= 665).cast("long"), 3), _two(F.floor(d["b"] / 9999) + 1, 2), _two(d["b"] % 9999 + 1, 4))
    return bound(moved, shown)


def _first_of(month: Column) -> Column:
    """Days of `ORIGIN` before a month, counted from January 1800."""
    return F.datediff(F.add_months(F.lit("1800-01-01").cast("date"), month.cast("int")), F.lit("1800-01-01").cast("date"))


def _date(m: Column, key: str, inverse: bool) -> Column:
    year, month, day, iso = _date_parts(m)
    origin = F.lit("1800-01-01").cast("date")
    number = F.datediff(F.make_date(year, month, day), origin)
    moved = bound(number, lambda n: permute_number(F.floor(n / 773), n % 773, 189, 773, "date", key, inverse))
    any_day = bound(moved, lambda d: F.date_add(origin, (d["a"] * 773 + d["b"]).cast("int")))
    # Days above 12 in front: each month has 12 days less, so the place of one among them is its day's number less twelve for each month up to its own.
    late = number - 12 * ((year - 1800) * 12 + month)
    late = bound(late, lambda n: permute_number(F.floor(n / 9833), n % 9833, 9, 9833, "day first", key, inverse))
    late = bound(late, lambda d: d["a"] * 9833 + d["b"])

    def back(n: Column) -> Column:
        near = F.floor(n / 18.4369).cast("int")
        months = F.sequence(F.greatest(F.lit(0), near - 2), F.least(F.lit(4799), near + 2))
        of = F.array_max(F.filter(months, lambda x: _first_of(x) - 12 * x <= n))
        return bound(of, lambda x: F.date_add(origin, (n + 12 * (x + 1)).cast("int")))

    day_first = F.substr(m, F.lit(1), F.lit(2)).cast("int") > 12
    return F.when(iso, F.date_format(any_day, "yyyy-MM-dd")).when(day_first, F.date_format(bound(late, back), "dd/MM/yyyy")).otherwise(F.date_format(any_day, "MM/dd/yyyy"))


def pseudonym(match: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of a valid match, in its own format."""
    # The country code of a phone stays; without a separator behind it only its first digit is known.
    country = lambda m: F.regexp_extract(m, r"^\+(?:[0-9]{1,3}(?=[ .(-])|[0-9])", 0)
    local = lambda m: F.substring_index(m, "@", 1)
    after = lambda m, front: F.substr(m, F.length(front) + 1)
    return bound(
        match,
        lambda m: F.when(kind == "email", F.concat(permute_text(local(m), "email", key, inverse), after(m, local(m))))
        .when(kind == "phone", F.concat(country(m), permute_text(after(m, country(m)), "phone", key, inverse)))
        .when(kind == "date", _date(m, key, inverse))
        .when(kind == "social", _social(m, key, inverse))
        .when(kind == "card", _card(m, key, inverse))
        .when(kind == "address", _address(m, key, inverse))
        .otherwise(m),
    )


def _is(kind: str):
    return lambda k: k == kind


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows with `text` pseudonymised and `n_<kind>` counts (long) of what was replaced."""
    if not key:
        raise ValueError("a key is needed: who knows it can undo the pseudonyms")
    names = [c for c in docs.columns if c not in {f"n_{k}" for k in KINDS} and c != text]
    row = [F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")] if names else []
    found = docs.select(*row, F.col(f"`{text}`").alias("__t"), F.regexp_extract_all(F.col(f"`{text}`"), F.lit(PATTERN), F.lit(0)).alias("__m"))
    found = found.withColumn("__k", F.transform("__m", kind_of))
    pieces = F.zip_with(F.zip_with("__m", "__k", lambda m, k: pseudonym(m, k, key)), F.split("__t", PATTERN), lambda r, p: F.concat(p, F.coalesce(r, F.lit(""))))
    rebuilt = F.when(F.coalesce(F.size("__m"), F.lit(0)) == 0, F.col("__t")).otherwise(F.array_join(pieces, ""))
    counts = [F.coalesce(F.size(F.filter("__k", _is(kind))), F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select(*[F.col("__row").getField(c).alias(c) for c in names], rebuilt.alias(text), *counts)
