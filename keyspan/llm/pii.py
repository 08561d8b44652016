"""Personal data: format-preserving Feistel pseudonyms, in built-in expressions.

Numbers and dates are found by patterns and validated (Luhn, mod 97, octets, calendar, issued ranges). What is valid is
mapped by a keyed permutation of all values of its format, so equal values stay equal in every document, different ones
stay different, and the key's owner can map them back. What is not valid stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick

ROUNDS = 10
#: For tests and the queries only; production passes its own.
DEMO_KEY = "demo key"

#: A name has at most 127 labels; an open-ended repeat of a group would also use up the stack of Java's matcher.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?<![\d+])\+\d{1,3}[\x20.-]?(?:\(\d{2,4}\)|\d{2,4})[\x20.-]?\d{3,4}[\x20.-]?\d{3,4}(?!\d)|(?<!\d)\(\d{3}\)\x20?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}([.-])\d{3}\1\d{4}(?!\d)"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?!-?\d)|(?<![\d/])\d{2}/\d{2}/\d{4}(?!/?\d)|(?<![\d.])\d{2}\.\d{2}\.\d{4}(?!\.?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)"
CARD = r"(?<!\d)\d{4}([\x20-])\d{4}\2\d{4}\2\d{4}(?!\d)|(?<!\d)\d(?:[\x20-]?\d){12,18}(?!\d)"
ANY = "|".join((EMAIL, IBAN, PHONE, IP, DATE, SSN, CARD))
#: Date formats by pattern: Spark's format, and the first and last day of the permuted range.
DATES = ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"), (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"))
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 17, 4297  # 17 * 4297 days, up to 2099-12-31
KINDS = ("email", "iban", "phone", "ip", "date", "ssn", "card")


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, kind: str, inverse: bool = False) -> Column:
    """A keyed permutation of the pairs below (a, b), as struct (l, r): halves take turns in adding a keyed hash of the other, modulo their own range."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    a, b = a.cast("long"), b.cast("long")
    secret = F.lit(f"{key}\x00{kind}\x00")
    noise = lambda x, i: F.conv(F.substring(F.sha2(F.concat(secret, i.cast("string"), F.lit("\x00"), a.cast("string"), F.lit("\x00"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")
    turn = (lambda x, y: x - y) if inverse else (lambda x, y: x + y)

    def step(s: Column, i: Column) -> Column:
        odd = F.struct(s["l"].alias("l"), F.pmod(turn(s["r"], noise(s["l"], i) % b), b).alias("r"))
        even = F.struct(F.pmod(turn(s["l"], noise(s["r"], i) % a), a).alias("l"), s["r"].alias("r"))
        return F.when(i % 2 == 1, odd).otherwise(even)

    rounds = list(range(ROUNDS))[:: -1 if inverse else 1]
    return F.aggregate(F.array(*map(F.lit, rounds)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _permuted(digits: Column, key: str, kind: str, inverse: bool) -> Column:
    """The image of a string of 2 to 36 digits among all of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    ten = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    body = lambda h, n: let(feistel(F.substr(digits, F.lit(1), h), F.substr(digits, h + 1, n), ten(h), ten(n), key, kind, inverse), lambda s: F.concat(F.lpad(s["l"].cast("string"), h, "0"), F.lpad(s["r"].cast("string"), n, "0")))
    return let(half, lambda h: body(h, F.length(digits) - h))


def _placed(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced, in order, by `digits`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), F.when(is_digit, s["k"] + 1).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.split(shape, ""), start, step)["out"]


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10: 0 for valid numbers."""
    twice = lambda c, i: F.when(i % 2 == 1, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), twice), F.lit(0), lambda s, x: s + x) % 10


def _mod97(iban: Column) -> Column:
    """Of letters and digits without spaces, the country and check digits moved to the end."""
    moved = F.split(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)), "")
    worth = lambda s, c: F.when(c.rlike("^[0-9]$"), s * 10 + F.ascii(c) - 48).otherwise(s * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(moved, F.lit(0), worth)


def _email(x: Column, key: str, inverse: bool) -> Column:
    if inverse:
        return x
    # No number to permute: a keyed digest names the address, the same one everywhere.
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}\x00email\x00"), F.lower(x)), 256), 1, 16), F.lit("@example.invalid"))


def _iban(x: Column, key: str, inverse: bool) -> Column:
    def permuted(plain: Column) -> Column:
        body = F.substring(plain, 5, 40)
        digits = _digits(body)
        image = F.when(F.length(digits) >= 2, _placed(body, let(digits, lambda d: _permuted(d, key, "iban", inverse)))).otherwise(body)
        check = lambda b: F.lpad((98 - _mod97(F.concat(F.substring(plain, 1, 2), F.lit("00"), b))).cast("string"), 2, "0")
        return let(image, lambda b: F.concat(F.substring(plain, 1, 2), check(b), b))

    # Spaces back where they were: every character but the space is replaced in order.
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    refit = lambda new: F.aggregate(F.split(x, ""), start, lambda s, c: F.when(c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))).otherwise(F.struct(F.concat(s["out"], F.substr(new, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))))["out"]
    plain = F.replace(x, F.lit(" "), F.lit(""))
    return let(plain, lambda p: F.when(_mod97(p) == 1, let(permuted(p), refit)).otherwise(x))


def _phone(x: Column, key: str, inverse: bool) -> Column:
    code = F.regexp_extract(x, r"^\+\d{1,3}(?=[^0-9])", 0)  # a country code that stands apart stays
    rest = F.substr(x, F.length(code) + 1, F.length(x))
    return F.concat(code, let(rest, lambda r: _placed(r, let(_digits(r), lambda d: _permuted(d, key, "phone", inverse)))))


def _ip(x: Column, key: str, inverse: bool) -> Column:
    def moved(p: Column) -> Column:
        n = [F.get(p, F.lit(i)).cast("int") for i in range(4)]
        back = lambda s: F.concat_ws(".", *[y.cast("string") for h in ("l", "r") for y in (F.floor(s[h] / 256), s[h] % 256)])
        return let(feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, key, "ip", inverse), back)

    fits = lambda p: F.forall(p, lambda o: o.cast("int") <= 255)
    return let(F.split(x, r"\."), lambda p: F.when(fits(p), moved(p)).otherwise(x))


def _day_image(form: str, key: str, inverse: bool) -> Callable[[Column], Column]:
    back = lambda s: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAYS_B + s["r"]).cast("int")), form)
    return lambda d: F.when((d >= 0) & (d < DAYS_A * DAYS_B), let(feistel(F.floor(d / DAYS_B), d % DAYS_B, DAYS_A, DAYS_B, key, "date", inverse), back))


def _date(x: Column, key: str, inverse: bool) -> Column:
    out = x
    first = F.lit(FIRST_DAY).cast("date")
    for pattern, form in DATES:
        day = F.datediff(F.try_to_timestamp(x, F.lit(form)).cast("date"), first)
        out = F.when(x.rlike(pattern), F.coalesce(let(day, _day_image(form, key, inverse)), x)).otherwise(out)
    return out


def _ssn(x: Column, key: str, inverse: bool) -> Column:
    area, group, serial = (F.substring(x, i, n).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)  # of 898 areas
    back = lambda s: F.concat_ws("-", F.lpad((F.when(s["l"] >= 665, s["l"] + 2).otherwise(s["l"] + 1)).cast("string"), 3, "0"), F.lpad((F.floor(s["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["r"] % 9999 + 1).cast("string"), 4, "0"))
    return F.when(valid, let(feistel(rank, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn", inverse), back)).otherwise(x)


def _card(x: Column, key: str, inverse: bool) -> Column:
    check = lambda p: F.concat(p, ((10 - _luhn(F.concat(p, F.lit("0")))) % 10).cast("string"))
    image = lambda d: let(_permuted(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", inverse), lambda p: _placed(x, check(p)))
    return let(_digits(x), lambda d: F.when(_luhn(d) == 0, image(d)).otherwise(x))


_HOW: dict[str, tuple[str, Callable]] = {"email": (EMAIL, _email), "iban": (IBAN, _iban), "phone": (PHONE, _phone), "ip": (IP, _ip), "date": (DATE, _date), "ssn": (SSN, _ssn), "card": (CARD.replace(r"\2", r"\1"), _card)}


def _swapped(x: Column, key: str, inverse: bool) -> Column:
    """(kind, image) of a found value; kind is null where it is not valid."""
    out, kind = x, F.lit(None).cast("string")
    for name in reversed(KINDS):
        pattern, how = _HOW[name]
        is_it = x.rlike(f"^(?:{pattern})$")
        out, kind = F.when(is_it, how(x, key, inverse)).otherwise(out), F.when(is_it, F.lit(name)).otherwise(kind)
    return let(out, lambda y: F.struct(F.when(~x.eqNullSafe(y), kind).alias("kind"), y.alias("image")))


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """The rows and columns of `docs` with text replaced and n_found appended: the number of values replaced.

    With inverse, numbers and dates go back to what they were under the same key; addresses cannot. A value that the key
    maps to itself counts as not replaced. Columns named n_found are dropped; all others are kept as they are.

    Null stays null, empty stays empty, with n_found 0. Repeated rows stay repeated. An empty table gives none.
    """
    names = [c for c in dict.fromkeys(docs.columns) if c.lower() != "n_found"]
    rows = pick(docs, *names)
    # Found values are put between two \\x01; those of the text itself are spelled otherwise meanwhile.
    plain = F.replace(F.replace(F.col("text"), F.lit("\x02"), F.lit("\x02\x04")), F.lit("\x01"), F.lit("\x02\x03"))
    pieces = F.split(F.regexp_replace(plain, ANY, "\x01$0\x01"), "\x01")
    swapped = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, _swapped(p, key, inverse)).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), p.alias("image"))))
    unspelled = lambda t: F.replace(F.replace(t, F.lit("\x02\x03"), F.lit("\x01")), F.lit("\x02\x04"), F.lit("\x02"))
    told = lambda s: F.struct(unspelled(F.array_join(F.transform(s, lambda x: x["image"]), "")).alias("text"), F.size(F.filter(s, lambda x: x["kind"].isNotNull())).alias("n"))
    same = F.struct(F.col("text").alias("text"), F.lit(0).alias("n"))
    found = rows.withColumn("_made", F.when(F.col("text").rlike(r"@|\d.?.?\d"), let(swapped, told)).otherwise(same))
    return found.select(*[F.col("_made.text").alias("text") if c == "text" else F.col(c) for c in names], F.col("_made.n").cast("long").alias("n_found"))
