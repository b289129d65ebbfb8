"""Format-preserving Feistel pseudonyms for personal numbers, dates and mail addresses, in DataFrame expressions.

A value that passes its kind's check is replaced by a keyed permutation of itself within its format:
digits by digits, letters by letters of the same case, separators kept. Equal values of a kind get equal
pseudonyms in every document, whatever separators they are written with, and different values different ones.

kind  | valid when                                   | permuted
card  | 13 to 19 digits that pass the Luhn check     | all digits but the last, which is recomputed
ip    | four numbers up to 255                       | the 32 bits
date  | a day from 1900 on, of three written formats | the day's number, over 73216 days
ssn   | three, two and four digits, none all zero    | the digits, within the valid numbers
iban  | check digits 02 to 98, right modulo 97       | what follows the check digits, which are recomputed
phone | ten digits with separators, or more with a + | the last ten digits
mail  | a local part, an at sign and a domain        | the local part

The network has an even number of rounds over two halves of the value; a round shifts each character of one half
within its class by SHA-256 of the key and the other half. Null texts stay null, empty texts empty; a match
that fails its check stays as it is. Null doc_ids and repeated rows are rows like others. Extra columns pass
through whatever their names, but one named like a column of counts (n_<kind>) gives way to it.

The key is an argument. ``session_key`` gives the one in the Spark setting ``weftlog.privacy.key`` or, where that is
unset, a random one for the session: pseudonyms then link documents within the session only.
"""

from __future__ import annotations

import hashlib
import secrets
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds of the network, and the steps after which a walk has met a valid number: one in 90 is not, so 40 never fail.
ROUNDS, WALK, KEY = 6, 40, "weftlog.privacy.key"
KINDS = ["mail", "ip", "date", "ssn", "iban", "phone", "card"]
#: Patterns of the kinds, tried in this order at each place.
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}|[0-9]{13,19})(?![0-9])",
}
_ALL = "|".join(PATTERNS[k] for k in KINDS)
_DATES = {"yyyy-MM-dd": "^[0-9]{4}-", "dd.MM.yyyy": r"^[0-9]{2}\.", "MM/dd/yyyy": "^[0-9]{2}/"}
_FIRST_DAY, _WIDE, _HIGH = "1900-01-01", 256, 286


def _bound(x: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _number(key: str, *parts: Column) -> Column:
    """A keyed pseudo-random number below 2 ** 60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def _shifted(half: Column, seed: Column) -> Column:
    """Each character moved on within its class by amounts taken from the hex string ``seed``."""

    def move(c: Column, i: Column, hexes: Column) -> Column:
        by = F.conv(F.substring(hexes, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        inside = lambda low, n: F.chr((F.ascii(c) - low + by) % n + low)
        return F.when(c.between("0", "9"), inside(48, 10)).when(c.between("a", "z"), inside(97, 26)).when(c.between("A", "Z"), inside(65, 26)).otherwise(c)

    return _bound(seed, lambda hexes: F.array_join(F.transform(F.split(half, ""), lambda c, i: move(c, i, hexes)), ""))


def permuted(value: Column, key: str, kind: str) -> Column:
    """The value under the network: same length, each character of its class."""

    def network(v: Column) -> Column:
        half = F.floor(F.length(v) / 2).cast("int")
        start = F.struct(F.substring(v, F.lit(1), half).alias("a"), F.substring(v, half + 1, F.length(v)).alias("b"))

        def turn(s: Column, r: Column) -> Column:
            seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.length(v).cast("string"), s["b"]), 256)
            return F.struct(s["b"].alias("a"), _shifted(s["a"], seed).alias("b"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))

    return _bound(value, network)


def _refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by those of ``digits``."""

    def fill(d: Column) -> Column:
        put = lambda c, i: F.when(c.between("0", "9"), F.substring(d, F.length(_digits(F.substring(form, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
        return F.array_join(F.transform(F.split(form, ""), put), "")

    return _bound(digits, fill)


def _luhn(digits: Column, first: int) -> Column:
    """The Luhn sum, the last digit counted ``first`` times and then in turn twice and once."""

    def total(d: Column) -> Column:
        def add(sum_: Column, i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, first).otherwise(3 - first)
            return sum_ + F.when(x > 9, x - 9).otherwise(x)

        return F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(d) - 1, F.lit(0))), F.lit(0), add)

    return _bound(digits, total)


def _mod97(text: Column) -> Column:
    """A string of digits and capitals (as 10 to 35) modulo 97."""

    def add(r: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    full = lambda body: F.concat(body, ((10 - _luhn(body, 2) % 10) % 10).cast("string"))
    new = lambda d: F.when(_luhn(d, 1) % 10 == 0, _refilled(m, _bound(permuted(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"), full)))
    return _bound(_digits(m), new)


def _ip(m: Column, key: str) -> Column:
    def new(parts: Column) -> Column:
        start = F.struct((parts[0] * 256 + parts[1]).cast("long").alias("a"), (parts[2] * 256 + parts[3]).cast("long").alias("b"))
        turn = lambda s, r: F.struct(s["b"].alias("a"), ((s["a"] + _number(key, F.lit("ip"), r, s["b"])) % 65536).alias("b"))
        join = lambda s: F.concat_ws(".", *[F.floor(s[h] / 256 if k == 0 else s[h] % 256).cast("long").cast("string") for h in ("a", "b") for k in (0, 1)])
        return F.when(F.forall(parts, lambda x: x <= 255), F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, join))

    return _bound(F.transform(F.split(m, "\\."), lambda x: x.cast("int")), new)


def _date(m: Column, key: str) -> Column:
    def turn(s: Column, r: Column) -> Column:
        odd = r % 2 == 1
        a = F.when(odd, (s["a"] + _number(key, F.lit("date"), r, s["b"])) % _WIDE).otherwise(s["a"])
        b = F.when(odd, s["b"]).otherwise((s["b"] + _number(key, F.lit("date"), r, s["a"])) % _HIGH)
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def moved(day: Column, form: str) -> Column:
        start = F.struct((day % _WIDE).alias("a"), F.floor(day / _WIDE).cast("long").alias("b"))
        new = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["a"] + s["b"] * _WIDE)
        return F.when(day.between(0, _WIDE * _HIGH - 1), F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), new.cast("int")), form))

    out = F.lit(None).cast("string")
    for form, looks in _DATES.items():
        day = F.datediff(F.try_to_date(m, form), F.lit(_FIRST_DAY).cast("date")).cast("long")
        out = F.when(m.rlike(looks), _bound(day, _with(moved, form))).otherwise(out)
    return out


def _with(body, form: str):
    return lambda x: body(x, form)


def _ssn(m: Column, key: str) -> Column:
    good = lambda d: ~d.rlike("^000|^...00|0000$")
    # from a valid number the network is walked on until it meets the next valid one: a permutation of the valid ones
    walk = lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), permuted(d, key, "ssn"), lambda s, _: F.when(good(s), s).otherwise(permuted(s, key, "ssn")))
    return _bound(_digits(m), lambda d: F.when(good(d), _refilled(m, walk(d))))


def _iban(m: Column, key: str) -> Column:
    land, rest = F.substring(m, 1, 2), F.substring(m, F.lit(5), F.length(m))
    whole = lambda body: F.concat(land, F.lpad((98 - _mod97(F.concat(body, land, F.lit("00")))).cast("string"), 2, "0"), body)
    return F.when((_mod97(F.concat(rest, F.substring(m, 1, 4))) == 1) & F.substring(m, 3, 2).between("02", "98"), _bound(permuted(rest, key, "iban"), whole))


def _phone(m: Column, key: str) -> Column:
    last = lambda d: F.concat(F.substring(d, F.lit(1), F.length(d) - 10), permuted(F.substring(d, F.length(d) - 9, F.lit(10)), key, "phone"))
    return _refilled(m, _bound(_digits(m), last))


def _mail(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    new = lambda name: F.when(F.length(name) == 1, F.translate(name, *_alphabets(key))).otherwise(permuted(name, key, "mail"))
    return F.concat(_bound(F.substring(m, F.lit(1), at - 1), new), F.substring(m, at, F.length(m)))


def _alphabets(key: str) -> tuple[str, str]:
    """Digits and letters, and the same with each class in a keyed order: for names of one character, which have no two halves."""
    classes = [string.digits, string.ascii_lowercase, string.ascii_uppercase]
    order = lambda c: hashlib.sha256(f"{key}|mail|{c}".encode()).digest()
    return "".join(classes), "".join(x for a in classes for x in sorted(a, key=order))


_MAKERS = {"mail": _mail, "ip": _ip, "date": _date, "ssn": _ssn, "iban": _iban, "phone": _phone, "card": _card}


def _replaced(m: Column, key: str) -> Column:
    """(kind, new) of a match: of the first kind whose pattern it is and whose check it passes; else no kind and the match."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new"))
    for kind in reversed(KINDS):
        # the whole match is looked at alone, so borders need no second look
        made = _with(lambda new, k: F.struct(F.when(new.isNotNull(), k).alias("kind"), F.coalesce(new, m).alias("new")), kind)
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), _bound(_MAKERS[kind](m, key), made)).otherwise(out)
    return out


def session_key(spark: SparkSession) -> str:
    """The key of this session: the setting's, or a random one that is drawn once."""
    found = spark.conf.get(KEY, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY, found)
    return found


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced, and n_<kind> columns with the number of values replaced."""
    found = F.when(F.col("t").rlike("[0-9@]"), F.regexp_extract_all(F.col("t"), F.lit(_ALL), F.lit(0)))
    # the row travels in one struct, so that no column of it can meet one of the steps here
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("t")).withColumn("found", found)
    out = out.withColumn("new", F.transform("found", lambda m: _replaced(m, key)))
    parts = F.split(F.col("t"), _ALL, -1)
    joined = F.array_join(F.zip_with(parts, F.col("new.new"), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    counts = [F.size(F.filter("new", lambda m: m["kind"] == kind)).cast("long") for kind in KINDS]
    some = F.col("found").isNotNull() & (F.size("found") > 0)
    kept = [c for c in docs.columns if c not in {f"n_{k}" for k in KINDS}]
    shown = [F.when(some, joined).otherwise(F.col("t")).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in kept]
    return out.select(*shown, *[F.when(some, c).otherwise(0).alias(f"n_{k}") for c, k in zip(counts, KINDS)])
