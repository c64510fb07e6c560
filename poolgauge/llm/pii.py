"""Format-preserving Feistel pseudonyms for personal data (DataFrame functions only).

Found and validated values are replaced by the image of a keyed permutation of
their own format, so equal values stay linked across documents, different
values stay different, and the text keeps its shape:

* card numbers of 13 to 19 digits, if their check digit is right: the digits
  before it are permuted and the check digit is set anew; separators stay, and
  so do numbers that a separator divides from the card (date, code, count);
* dates that the calendar has (``YYYY-MM-DD``, ``DD.MM.YYYY``, ``MM/DD/YYYY``;
  1830 to 2129): permuted among the days of the same hundred years, each of
  which is a product of two numbers, so the network needs no cycle walking;
* IPv4 addresses with octets up to 255: permuted as 32-bit values;
* ``ddd-dd-dddd`` numbers whose parts can be issued (area 001 to 899 but 666,
  group and serial not zero): permuted among those numbers, which are a product
  of two numbers as well;
* telephone numbers with a country code: digits after it (by form alone: plans
  of many countries have no check); hexadecimal tokens of 32 to 64 digits,
  which carry nothing to check either;
* e-mail addresses: letters and digits of the local part, class by class.

The network has :data:`ROUNDS` rounds over the halves of the value; a round
shifts every character of one half, within its own class, by a stream that
SHA-256 derives from key, kind, round and the other half. Numbers that fail
validation (wrong check digit, 31 February, octet 300, area 666) are not
personal data of that format and stay.

The key's digest is a literal of the plan; pass a column (say, from a one-row
table that only this job may read) to keep it out of plans and logs.

Scale: one pass without shuffle; only texts with a digit or an at sign are
searched. Defined cases: null stays null; empty text stays; rows that repeat a
doc_id are each treated; clean text is returned as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolgauge.llm.common import UPPER, let

ROUNDS = 8
KINDS = ("email", "ip", "date", "card", "ssn", "phone", "token")
_DIGITS, _HEX = "0123456789", "0123456789abcdef"

#: Alternatives in the order in which a place of the text tries them; a card's may run on into a number after it, see :func:`_card`.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w)",
    "phone": r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+(?!1)\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)",
    "token": r"(?<!\w)[0-9a-f]{32,64}(?!\w)",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _number(hexed: Column) -> Column:
    return F.conv(hexed, 16, 10).cast("long")


def _prf(key: Column, *parts: Column | str | int) -> Column:
    return F.sha2(F.concat_ws("|", key, *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def _permuted(s: Column, key: Column, kind: str, classes: tuple[str, ...]) -> Column:
    """Feistel network over the halves of a string; characters outside ``classes`` stay in place."""

    def moved(c: Column, by: Column) -> Column:
        out = c
        for alphabet in classes:
            at = F.instr(F.lit(alphabet), c)
            out = F.when(at > 0, F.substring(F.lit(alphabet), (at - 1 + by) % len(alphabet) + 1, F.lit(1))).otherwise(out)
        return out

    def rounds(a: Column, r: Column) -> Column:
        def shifted(stream: Column) -> Column:
            by = lambda i: _number(F.substring(stream, (i % 32) * 2 + 1, F.lit(2))).cast("int")
            return F.array_join(F.transform(_chars(a["right"]), lambda c, i: moved(c, by(i))), "")

        stream = _prf(key, kind, r.cast("string"), a["left"])
        return F.struct(let(stream, shifted).alias("left"), a["left"].alias("right"))

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("left"), F.substring(s, half + 1, F.length(s)).alias("right"))
    # an even number of swaps gives each half its place back
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, rounds, lambda a: F.concat(a["left"], a["right"]))


def _luhn_sum(digits: Column) -> Column:
    """Check sum of a digit string whose last digit counts once."""

    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((F.length(digits) - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(_chars(digits), weighed), F.lit(0), lambda a, x: a + x)


def _bare(m: Column) -> Column:
    return F.translate(m, " -", "")


def _card(m: Column, key: Column) -> Column:
    """``m`` with the pseudonym of its longest reading that has a right check digit (of equal ones the first).

    A reading takes 13 to 19 digits and starts and ends at a separator or an end of ``m``.
    """

    def whole(r: Column, digits: Column) -> Column:
        body = _permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card", (_DIGITS,))
        checked = let(body, lambda b: F.concat(b, ((10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        place = lambda i: F.length(_bare(F.substring(r, F.lit(1), i + 1)))  # noqa: E731  digits up to here
        return let(checked, lambda d: F.array_join(F.transform(_chars(r), lambda c, i: F.when(F.instr(F.lit(_DIGITS), c) > 0, F.substring(d, place(i), F.lit(1))).otherwise(c)), ""))

    def right(digits: Column) -> Column:
        return F.when(F.length(digits).between(13, 19), _luhn_sum(digits) % 10 == 0).otherwise(F.lit(False))

    # the groups of digits: one is as long as all before it with their separators, and itself
    groups = F.split(m, "[ -]")
    upto = lambda g, k: F.aggregate(F.slice(g, F.lit(1), k), F.lit(0), lambda a, x: a + F.length(x) + 1)

    def readings(g: Column) -> Column:
        def ending(s: Column) -> Column:
            def reading(e: Column) -> Column:
                at = upto(g, s - 1) + 1
                part = F.substring(m, at, upto(g, e) - at)
                return F.struct((-F.length(_bare(part))).alias("less"), at.alias("at"), part.alias("part"))

            return F.transform(F.sequence(s, F.size(g)), reading)

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(g)), ending))

    def woven(best: Column) -> Column:
        done = let(_bare(best["part"]), lambda d: whole(best["part"], d))
        return F.concat(F.substring(m, F.lit(1), best["at"] - 1), done, F.substring(m, best["at"] + F.length(best["part"]), F.length(m)))

    best = F.array_min(F.filter(let(groups, readings), lambda x: let(_bare(x["part"]), right)))
    return let(best, lambda b: F.when(b.isNull(), m).otherwise(woven(b)))


def _ip(m: Column, key: Column) -> Column:
    def moved(octets: Column) -> Column:
        hexed = F.array_join(F.transform(octets, lambda o: F.lower(F.lpad(F.hex(o.cast("long")), 2, "0"))), "")
        back = lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substring(h, k * 2 + 1, F.lit(2)), 16, 10)), ".")
        return F.when(F.exists(octets, lambda o: o.cast("int") > 255), m).otherwise(let(_permuted(hexed, key, "ip", (_HEX,)), back))

    return let(F.split(m, r"\."), moved)


#: First day, and the two factors of the number of days, of each hundred years that dates are permuted in.
CENTURIES = (("1830-01-01", 92, 397), ("1930-01-01", 75, 487), ("2030-01-01", 92, 397))


def _paired(x: Column, y: Column, a: int, b: int, key: Column, *label: str) -> Column:
    """A pair (x, y) permuted among a * b of them: an additive network over Z_a and Z_b."""

    def draw(r: Column, other: Column, most: int) -> Column:
        return _number(F.substring(_prf(key, *label, r.cast("string"), other.cast("string")), F.lit(1), F.lit(12))) % most

    def rounds(s: Column, r: Column) -> Column:
        x = ((s["x"] + draw(r, s["y"], a)) % a).cast("long")
        return let(x, lambda x: F.struct(x.alias("x"), ((s["y"] + draw(r, x, b)) % b).cast("long").alias("y")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), rounds)


def _day_of(n: Column, key: Column, first: str, a: int, b: int) -> Column:
    """The n-th day from ``first`` permuted among a * b days."""
    day = lambda s: F.date_add(F.lit(first).cast("date"), (s["x"] * b + s["y"]).cast("int"))
    return let(_paired(F.floor(n / b), n % b, a, b, key, "date", first), day)


#: Areas that can be issued, groups to each of them, and serials to each group.
AREAS, GROUPS, SERIALS = 898, 99, 9999


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.substring(m, F.lit(at), F.lit(n)).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    # 000 and 666 are left out of the count
    place = (area - F.when(area > 666, 2).otherwise(1)) * GROUPS + group - 1

    def written(s: Column) -> Column:
        nth = F.floor(s["x"] / GROUPS)
        padded = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")
        return F.concat_ws("-", padded(nth + F.when(nth >= 665, 2).otherwise(1), 3), padded(s["x"] % GROUPS + 1, 2), padded(s["y"] + 1, 4))

    issued = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(issued, let(_paired(place, serial - 1, AREAS * GROUPS, SERIALS, key, "ssn"), written)).otherwise(m)


def _day(d: Column, key: Column) -> Column:
    """The permuted day of a valid date, or null beyond the hundred years of CENTURIES."""
    out = F.lit(None).cast("date")
    for first, a, b in CENTURIES:
        n = F.datediff(d, F.lit(first).cast("date"))
        out = F.when((n >= 0) & (n < a * b), _day_of(n, key, first, a, b)).otherwise(out)
    return out


def _date(m: Column, key: Column) -> Column:
    def in_layout(layout: str) -> Column:
        day = F.try_to_timestamp(m, F.lit(layout)).cast("date")
        return let(day, lambda d: F.coalesce(F.date_format(_day(d, key), layout), m))

    out = m
    for shape, layout in ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "MM/dd/yyyy")):
        out = F.when(m.rlike(shape), in_layout(layout)).otherwise(out)
    return out


def _email(m: Column, key: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(_permuted(local, key, "email", (_DIGITS, UPPER.lower(), UPPER)), F.substring(m, F.length(local) + 1, F.length(m)))


def _phone(m: Column, key: Column) -> Column:
    code = F.regexp_extract(m, r"^\+(?:1|[2-9]\d{0,2}?)(?=[ .(-]|\d)", 0)
    return F.concat(code, _permuted(F.substring(m, F.length(code) + 1, F.length(m)), key, "phone", (_DIGITS,)))


def _kind(m: Column) -> Column:
    out = F.lit("phone")
    for kind, test in (("token", r"^[0-9a-f]{32,64}\z"), ("card", r"^\d(?:[ -]?\d){12,18}\z"), ("ssn", r"^\d{3}-\d{2}-\d{4}\z"), ("date", r"^(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})\z"), ("ip", r"^\d+(?:\.\d+){3}\z"), ("email", "@")):
        out = F.when(m.rlike(test), F.lit(kind)).otherwise(out)
    return out


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one found value; the value itself if it fails validation."""
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(m.rlike(r"^\d+(?:\.\d+){3}\z"), _ip(m, key))
        .when(m.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})\z"), _date(m, key))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}\z"), _ssn(m, key))
        .when(m.rlike(r"^\d(?:[ -]?\d){12,18}\z"), _card(m, key))
        .when(m.rlike(r"^[0-9a-f]{32,64}\z"), _permuted(m, key, "token", (_HEX,)))
        .otherwise(_phone(m, key))
    )


def key_column(key: str | Column) -> Column:
    return key if isinstance(key, Column) else F.sha2(F.lit(key), 256)


def replaced(text: Column, key: Column) -> Column:
    """A struct: ``text`` with pseudonyms, and ``values``, an array of (kind, value, pseudonym) in order."""

    def woven(found: Column) -> Column:
        values = F.transform(found, lambda m: F.struct(_kind(m).alias("kind"), m.alias("value"), pseudonym(m, key).alias("pseudonym")))

        def joined(v: Column) -> Column:
            parts = F.zip_with(F.split(text, _ANY, -1), v, lambda gap, x: F.concat(gap, F.coalesce(x["pseudonym"], F.lit(""))))
            return F.struct(F.array_join(parts, "").alias("text"), v.alias("values"))

        return let(values, joined)

    none = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    untouched = F.struct(text.alias("text"), none.alias("values"))
    found = F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))
    return F.when(text.rlike("[0-9@]"), let(found, lambda f: F.when(F.size(f) > 0, woven(f)).otherwise(untouched))).otherwise(untouched)


def protect(docs: DataFrame, key: str | Column) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; other columns as they are."""
    rows = docs.select(F.struct("*").alias("row"), replaced(F.col("text"), key_column(key)).alias("done"))
    return rows.select(*[(F.col("done.text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def digest(docs: DataFrame, key: str | Column) -> DataFrame:
    """doc_id, text with pseudonyms, and per kind how many values were replaced."""
    rows = docs.select("doc_id", replaced(F.col("text"), key_column(key)).alias("done"))
    changed = lambda k: F.size(F.filter("done.values", lambda v: (v["kind"] == k) & (v["value"] != v["pseudonym"]))).cast("long")
    return rows.select("doc_id", F.col("done.text").alias("text"), *[changed(k).alias(f"n_{k}") for k in KINDS])
