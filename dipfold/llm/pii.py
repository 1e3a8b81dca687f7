"""Operator 9. PII: format-preserving Feistel pseudonyms, in DataFrame operations only.

Private values are found by one pattern and told apart by their form. Numbers and dates are validated (Luhn, mod 97, calendar,
ranges) and mapped by a keyed permutation within their own format: a Feistel network over Z_a x Z_b, where a * b is the
number of values of the format, so each value of a format has one pseudonym of that format, different values have different
ones, and equal values stay linked across documents. Check digits are made anew, so a card or an IBAN stays valid.
Phone numbers are compared by country code and national digits, so one number has one pseudonym in every spelling. Secrets get keyed
digests of their length, mail addresses a keyed name of sixteen digits at a reserved domain.

The key is an argument of every function: whoever has it can undo the permutations.

All of it is one projection: no shuffle, no join. Documents without a digit, an ``@``, a sign of assignment or ``AKIA`` are passed on unread.
"""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dipfold.llm.common import fresh, shared_dir
from dipfold.llm.token_counts import Ledger

ROUNDS = 8
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 319, 229  # 73,051 days, to 2100-01-03

# every repeat is bounded, or possessive (never given back), and begins only where a run begins, so long runs of one character cost no more
# than their length
_MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,63}"
_ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
# the name may be the end of a longer one (accessToken) and stand in quotes of its own; a quoted value may have blanks
_SECRET = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s*+[=:]\s*+(?:\"[^\"\n]{6,}+\"|'[^'\n]{6,}+'|[^\s\"']{6,}+)"
_BEARER = r"(?<![A-Za-z0-9])(?i:bearer)[ \t]++(?=[A-Za-z._~+/=-]*+[0-9])[A-Za-z0-9._~+/=-]{8,}+"
_IBAN = r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?:(?: [A-Za-z0-9]{4}){2,7}(?: [A-Za-z0-9]{1,3})?|[A-Za-z0-9]{11,30})(?![A-Za-z0-9])"
_IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
_IP6 = r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)(?=[A-Fa-f:]*+[0-9])[0-9A-Fa-f:]{3,39}+(?![0-9A-Za-z:.]?[0-9A-Za-z:])"
_DATE = r"(?<![0-9A-Za-z.-])(?:[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z-])"
_SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
_PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)(?:[ .-]?[0-9]{2,4}){2,3}|\+[0-9]{1,3}(?:[ .-][0-9]{2,8}){1,5}|\+[0-9]{8,15}"
    r"|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}|[0-9]{3} [0-9]{3} [0-9]{4})(?![0-9A-Za-z])"
)
_CARD = (
    r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}"
    r"|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9A-Za-z])"
)
PATTERN = "|".join((_MAIL, _ACCESS_KEY, _SECRET, _BEARER, _IBAN, _IP, _DATE, _SSN, _PHONE, _CARD, _IP6))
#: A text without any of these holds nothing that the pattern finds: a bearer's token has a digit.
SIGN = "[0-9@=:]|AKIA"
KINDS = ("mail", "key", "secret", "iban", "ip", "date", "ssn", "phone", "card", "ip6")


def installation_key(spark: SparkSession) -> str:
    """A random key of this installation, drawn once and kept in the folder that driver and executors share; whoever may read that folder has it."""
    folder = Ledger(spark, shared_dir(spark))
    folder.publish("pii-key/key", {"key": secrets.token_hex(32)})
    return json.loads(spark.read.text(f"{folder.path}/pii-key/key", wholetext=True).first().value)["key"]


def digest(key: str, tweak: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), *(p.cast("string") for p in parts)), 256)


def feistel(x: Column, y: Column, a: Column, b: Column, key: str, tweak: str, *more: Column) -> Column:
    """A keyed permutation of the pairs (x, y) with 0 <= x < a and 0 <= y < b, as a struct of longs."""

    def f(r: Column, v: Column) -> Column:
        return F.conv(F.substring(digest(key, tweak, r, v, *more), 1, 15), 16, 10).cast("long")

    def turn(s: Column, r: Column) -> Column:
        even = F.struct(F.pmod(s["x"] + F.pmod(f(r, s["y"]), a), a).alias("x"), s["y"].alias("y"))
        odd = F.struct(s["x"].alias("x"), F.pmod(s["y"] + F.pmod(f(r, s["x"]), b), b).alias("y"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ten_to(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def permuted_digits(d: Column, key: str, tweak: str, *more: Column) -> Column:
    """A string of up to 30 digits to another of the same length."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    left = F.coalesce(F.substring(d, F.lit(1), u).try_cast("long"), F.lit(0))
    right = F.coalesce(F.substring(d, u + 1, n - u).try_cast("long"), F.lit(0))
    pair = feistel(left, right, ten_to(u), ten_to(n - u), key, tweak, n, *more)
    return let(pair, lambda p: F.concat(F.when(u > 0, F.lpad(p["x"].cast("string"), u, F.lit("0"))).otherwise(F.lit("")), F.lpad(p["y"].cast("string"), n - u, F.lit("0"))))


def refilled(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced by ``digits`` in turn."""

    def at(i: Column) -> Column:
        c = F.substring(template, i, F.lit(1))
        k = F.length(digits_of(F.substring(template, F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substring(digits, k, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(template)), at), "")


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string whose last digit counts once."""

    def add(s: Column, i: Column) -> Column:
        v = F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return s + F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    def use(d: Column) -> Column:
        head, middle = F.substring(d, 1, 1), F.substring(d, F.lit(2), F.length(d) - 2)
        fresh = let(
            F.concat(head, permuted_digits(middle, key, "card", head)),
            lambda p: F.concat(p, F.pmod(10 - luhn_sum(F.concat(p, F.lit("0"))) % 10, F.lit(10)).cast("string")),
        )
        return F.when((luhn_sum(d) % 10 == 0) & (digits_of(d).rlike("[1-9]")), refilled(m, fresh)).otherwise(m)

    return let(digits_of(m), use)


def _mod97(s: Column) -> Column:
    """The remainder by 97 of an IBAN-like string with letters as 10 to 35."""

    def add(r: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(r * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))

    return F.aggregate(F.split(s, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, c)))


def _iban(m: Column, key: str) -> Column:
    """Letters stay where they are, in the case they have; both cases of one number have one pseudonym."""

    def use(s: Column) -> Column:
        country, body = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
        fresh = refilled(body, permuted_digits(digits_of(body), key, "iban", F.regexp_replace(body, "[0-9]", "0"), country))
        whole = let(fresh, lambda b: F.concat(F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        # the new digits go back into the old spaces
        out = F.concat(F.substring(m, 1, 2), refilled(F.substring(m, F.lit(3), F.length(m)), digits_of(whole)))
        # words in small letters that pass by chance hardly have as many digits
        told = (m == F.upper(m)) | (F.length(digits_of(body)) >= 8)
        return F.when(told & (_mod97(F.concat(body, F.substring(s, 1, 4))) == 1), out).otherwise(m)

    return let(F.upper(F.regexp_replace(m, " ", "")), use)


def _ip6(m: Column, key: str) -> Column:
    """Eight groups, or fewer with one ``::`` for the zeros between: a keyed address in the range reserved for documentation, one for every spelling."""
    halves = F.split(F.lower(m), "::")
    groups = lambda h: F.filter(F.split(h, ":"), lambda g: g != "")
    left, right = groups(halves[0]), F.when(F.size(halves) > 1, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    lack = 8 - F.size(left) - F.size(right)
    once = (F.size(halves) == 2) & (lack >= 1) & ~m.contains(":::")
    whole = (F.size(halves) == 1) & (lack == 0) & ~m.startswith(":") & ~m.endswith(":")
    every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(lack, F.lit(0))), right)
    short = F.forall(every, lambda g: F.length(g) <= 4)
    number = F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), "")
    fresh = let(digest(key, "ip6", number), lambda d: F.concat(F.lit("2001:db8"), *(x for k in range(6) for x in (F.lit(":"), F.substring(d, 4 * k + 1, 4)))))
    return F.when((once | whole) & short, fresh).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    def use(p: Column) -> Column:
        part = lambda i: p[i].cast("long")
        pair = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536), key, "ip")
        byte = lambda v, k: F.pmod(F.floor(v / k).cast("long"), F.lit(256)).cast("string")
        fresh = let(pair, lambda q: F.concat_ws(".", byte(q["x"], 256), byte(q["x"], 1), byte(q["y"], 256), byte(q["y"], 1)))
        return F.when(F.forall(p, lambda x: x.cast("int") <= 255), fresh).otherwise(m)

    return let(F.split(m, r"\."), use)


def _date(m: Column, key: str) -> Column:
    iso, big, slash = m.rlike("^[0-9]{4}-"), m.rlike("^[0-9]{4}/"), m.contains("/")
    written = F.when(iso, m).when(big, F.translate(m, "/", "-")).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))

    def use(d: Column) -> Column:
        n = F.datediff(d, F.lit(FIRST_DAY).cast("date"))
        pair = feistel(F.floor(n / DAYS_B), F.pmod(n, F.lit(DAYS_B)), F.lit(DAYS_A), F.lit(DAYS_B), key, "date")
        fresh = let(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["x"] * DAYS_B + p["y"]).cast("int")))
        shape = lambda f: F.date_format(fresh, f)
        out = F.when(iso, shape("yyyy-MM-dd")).when(big, shape("yyyy/MM/dd")).when(slash, shape("dd/MM/yyyy")).otherwise(shape("dd.MM.yyyy"))
        return F.when(d.isNotNull() & (n >= 0) & (n < DAYS_A * DAYS_B), out).otherwise(m)

    return let(written.try_cast("date"), use)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    x = area - F.when(area > 666, 2).otherwise(1)
    y = (group - 1) * 9999 + serial - 1

    def use(p: Column) -> Column:
        a = p["x"] + F.when(p["x"] >= 665, 2).otherwise(1)
        g, s = F.floor(p["y"] / 9999) + 1, F.pmod(p["y"], F.lit(9999)) + 1
        pad = lambda v, k: F.lpad(v.cast("long").cast("string"), k, "0")
        return F.concat_ws("-", pad(a, 3), pad(g, 2), pad(s, 4))

    return F.when(valid, let(feistel(x, y, F.lit(898), F.lit(99 * 9999), key, "ssn"), use)).otherwise(m)


#: Country codes of one and of two digits; all others have three.
CODES = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _american(d: Column, key: str) -> Column:
    """Ten digits to ten digits. Area and exchange keep to 2-9 or to 0-1 as their first digit, so a number that can be dialled stays one."""
    area, exchange, line = F.substring(d, 1, 3).try_cast("long"), F.substring(d, 4, 3).try_cast("long"), F.substring(d, 7, 4).try_cast("long")
    low = lambda v: F.when(v < 200, 0).otherwise(200)
    span = lambda v: F.when(v < 200, 200).otherwise(800)
    pair = feistel(area - low(area), (exchange - low(exchange)) * 10_000 + line, span(area), span(exchange) * 10_000, key, "phone", F.lit("1"), low(area), low(exchange))
    pad = lambda v, n: F.lpad(v.cast("long").cast("string"), n, "0")
    return let(pair, lambda p: F.concat(pad(p["x"] + low(area), 3), pad(F.floor(p["y"] / 10_000) + low(exchange), 3), pad(F.pmod(p["y"], F.lit(10_000)), 4)))


def _phone(m: Column, key: str) -> Column:
    """The country code stays, by which the number is read alike in every spelling; the national digits are permuted.

    Ten digits without a country code are American. A number in all must have eight to fifteen digits; a zero in brackets after the
    country code is a sign to the reader, not a digit of it, and stays.
    """
    plus, trunk = m.startswith("+"), m.rlike(r"^\+[0-9]{1,3}[ .-]?\(0\)")
    zero = F.when(trunk, F.regexp_extract(m, r"^(\+[0-9]{1,3}[ .-]?\(0\))", 1)).otherwise(F.lit(""))

    def use(d: Column) -> Column:
        code = F.when(plus, F.regexp_extract(d, CODES, 1)).otherwise(F.lit("1"))
        national = F.when(plus, F.substring(d, F.length(code) + 1, F.length(d))).otherwise(d)
        n = F.length(code) + F.length(national)
        new = F.when((code == "1") & (F.length(national) == 10), _american(national, key)).otherwise(permuted_digits(national, key, "phone", code))
        whole = F.when(plus, F.concat(code, new)).otherwise(new)
        # with a zero in brackets its digit is put back where it stood
        whole = F.when(trunk, F.concat(F.substring(whole, F.lit(1), F.length(digits_of(zero)) - 1), F.lit("0"), F.substring(whole, F.length(digits_of(zero)), F.length(whole)))).otherwise(whole)
        return F.when(n.between(8, 15), refilled(m, whole)).otherwise(m)

    return let(F.concat(F.regexp_replace(digits_of(zero), "0$", ""), digits_of(F.substring(m, F.length(zero) + 1, F.length(m)))), use)


def _stretched(hex_digits: Column, n: Column) -> Column:
    return F.substring(F.repeat(hex_digits, F.ceil(n / 64).cast("int")), F.lit(1), n)


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"(?s)^((?i:bearer)[ \t]+|.*?[=:]\s*[\"']?)", 1)
    tail = F.regexp_extract(m, r"([\"']?)$", 1)
    value = F.substring(m, F.length(head) + 1, F.length(m) - F.length(head) - F.length(tail))
    return F.concat(head, _stretched(digest(key, "secret", value), F.length(value)), tail)


def kind(m: Column) -> Column:
    """What a found string is, from its form alone."""
    return (
        F.when(m.rlike("(?i)^((password|passwd|pwd|secret|token|api[_-]?key)[\"']?\\s*[=:]|bearer[ \\t])"), "secret")
        .when(m.contains("@"), "mail")
        .when(m.rlike("^AKIA[0-9A-Z]{16}$"), "key")
        .when(m.rlike("^[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:"), "ip6")
        .when(m.rlike("^[A-Za-z]{2}[0-9]{2}"), "iban")
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(m.rlike(r"^([0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})$"), "date")
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^[+(]|^[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}$"), "phone")
        .otherwise("card")
    )


def pseudonym(m: Column, key: str) -> Column:
    k = kind(m)
    return (
        F.when(k == "secret", _secret(m, key))
        .when(k == "mail", F.concat(F.lit("u"), F.substring(digest(key, "mail", F.lower(m)), 1, 16), F.lit("@mail.invalid")))
        .when(k == "key", F.concat(F.lit("AKIA"), F.upper(F.substring(digest(key, "key", m), 1, 16))))
        .when(k == "iban", _iban(m, key))
        .when(k == "ip", _ip(m, key))
        .when(k == "ip6", _ip6(m, key))
        .when(k == "date", _date(m, key))
        .when(k == "ssn", _ssn(m, key))
        .when(k == "phone", _phone(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymised(docs: DataFrame, key: str, found: str = "pii_found") -> DataFrame:
    """``docs`` with its own columns and rows, private values in ``text`` replaced; adds ``found``, an array of kind and count.

    A null text stays null and an empty one empty; texts of any length are read whole; repeated rows are all kept and stay equal; ids play no
    part; columns of any name stay as they are (a column of ``docs`` that is called ``found`` is refused); an empty table gives an empty result;
    ``n_chars`` is left as it was. Values that do not validate (a number that fails its check sum, a day that is not in the
    calendar) are left alone and not counted.
    """
    if found.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {found!r}: choose another name for what is found")
    old, new, kinds = fresh(docs, "pii_old", "pii_new", "pii_changed")
    text = F.col("text")
    hits = F.when(text.rlike(SIGN), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    d = docs.withColumn(old, hits)
    d = d.withColumn(new, F.transform(old, lambda m: pseudonym(m, key)))
    woven = F.array_join(
        F.zip_with(F.split(text, PATTERN, -1), F.col(new), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), ""
    )
    changed = F.transform(
        F.filter(F.arrays_zip(F.col(old).alias("a"), F.col(new).alias("b")), lambda p: p["a"] != p["b"]), lambda p: kind(p["a"])
    )
    times = lambda k: F.size(F.filter(kinds, lambda x: x == k))
    counts = F.filter(
        F.array(*(F.struct(F.lit(k).alias("kind"), times(k).alias("n")) for k in KINDS)),
        lambda s: s["n"] > 0,
    )
    d = d.withColumn(kinds, changed).withColumn("text", F.when(F.size(old) > 0, woven).otherwise(text))
    return d.withColumn(found, counts).drop(old, new, kinds)


def judge(docs: DataFrame, key: str) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the ``text`` with pseudonyms, ``pii_count`` and ``pii_kinds`` (like ``card:2 mail:1``).

    Nulls, ties and odd texts as in :func:`pseudonymised`; other columns are ignored.
    """
    d = pseudonymised(docs.select("doc_id", "text"), key)
    count = F.aggregate("pii_found", F.lit(0).cast("long"), lambda s, p: s + p["n"])
    kinds = F.array_join(F.transform("pii_found", lambda p: F.concat_ws(":", p["kind"], p["n"].cast("string"))), " ")
    return d.select("doc_id", "text", count.alias("pii_count"), kinds.alias("pii_kinds"))
