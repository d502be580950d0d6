"""PII: format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions only.

Numbers and dates that pass the checks of their format are replaced by others of the same format: payment
cards (Luhn), phone numbers (area, exchange and line as in North America, others after + and a country code), IPv4 addresses, social security numbers, calendar dates,
and mail addresses, whose letters and digits are permuted within their class. Each format's values are pairs
(left, right) of numbers below two bases; a round adds a keyed hash of one half to the other, modulo its base,
which can be undone with the key. So every value has one pseudonym, in every document, and no two values share
one. A number that fails its check is not one of these and stays; phone numbers have no check but their form.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import constant, table

#: Setting of the session that holds the key, and the key of tests where it is unset.
KEY_SETTING, KEY = "lumipep.pii.key", "lumipep-pseudonyms-1"
ROUNDS = 6
#: Dates are permuted within these many days from 1900-01-01 (until 2099-08-05); others stay.
DAYS = (270, 270)
#: Dates with the year last are permuted within 1901 to 2096, cycles of 1461 days; others stay.
CYCLES = 49


def _offsets() -> list[list[int]]:
    """Days of a cycle that one written form can hold: by digits of the day and of the month if both are at most 12 (11, 12, 21, 22), then by digits of the month if the day is above 12."""
    days = [(i, d.day, d.month) for i in range(1461) for d in [date(1901, 1, 1) + timedelta(i)]]
    low = [[i for i, d, m in days if d <= (9 if x == 1 else 12) and m <= (9 if y == 1 else 12)] for x in (1, 2) for y in (1, 2)]
    return low + [[i for i, d, m in days if d > 12 and m <= (9 if y == 1 else 12)] for y in (1, 2)]


OFFSETS = _offsets()

#: What a value may look like. Fixed values; the order is that of preference.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "phone": r"(?<![\w+])(?:\+1[ .-]?)?\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\w)|(?<![\w.+-])(?<!\d )(?:\+?1[ .-])?\d{3}[-. ]\d{3}[-. ]\d{4}(?![\w-])"
    r"|(?<![\w+])\+[1-9](?:[ .-]?\(?\d\)?){6,14}(?![\w-])",
    "date": r"(?<![\w./-])\d{4}(?:-\d{2}-|/\d{2}/|\.\d{2}\.)\d{2}(?:(?=T\d)|(?![\w/-]|\.\d))|(?<![\w./-])\d{1,2}(?:/\d{1,2}/|\.\d{1,2}\.|-\d{1,2}-)\d{4}(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w-])"
    r"|(?<![\w.-])[3-6](?:\d{3} \d{6} \d{4,5}|\d{3}-\d{6}-\d{4,5}|\d{3}-\d{4}-\d{4}-\d{4}-\d{1,3}|\d{12,18})(?![\w-])",
    "ip": r"(?<![\w.-])(?:\d{1,3}\.){3}\d{1,3}(?![\w-]|\.\d)",
}
ANY = "|".join(p.replace(r"([ -]?)", r"(?<sep>[ -]?)").replace(r"\1", r"\k<sep>") for p in FORMATS.values())


def _let(values: dict[str, Column], body) -> Column:
    """body(named values), each computed once."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body), F.lit(0))


def _permuted(key: str, fmt: str, left: Column, right: Column, a: int | Column, b: int | Column, inverse: bool, done) -> Column:
    """done(left', right') of a keyed permutation of the pairs with 0 <= left < a, 0 <= right < b; each round hashes one half, keyed, and adds it to the other."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(acc: Column, i: Column) -> Column:
        bits = lambda x: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(fmt), i.cast("string"), x.cast("string")), 256), 1, 12), 16, 10).cast("long")
        sign = F.lit(-1 if inverse else 1)
        left = F.pmod(acc["l"] + sign * (bits(acc["r"]) % a), F.lit(a))
        right = F.pmod(acc["r"] + sign * (bits(acc["l"]) % b), F.lit(b))
        return F.when(i % 2 == 0, F.struct(left.alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), right.alias("r")))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda acc: done(acc["l"], acc["r"]))


def _pad(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def _fill(v: Column, digits: Column, skip: int | Column = 0) -> Column:
    """v with its digits, after the first `skip`, replaced by `digits` in order."""
    chars = F.split(v, r"(?!\A)(?!\z)")
    start = F.struct(F.lit("").alias("out"), (F.lit(1) - skip).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.rlike(r"^\d$")
        new = F.when(is_digit & (acc["at"] >= 1), F.substring(digits, acc["at"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], new).alias("out"), F.when(is_digit, acc["at"] + 1).otherwise(acc["at"]).alias("at"))

    return F.aggregate(chars, start, step, lambda acc: acc["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of the digits as they stand before a check digit."""
    n = F.length(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when((n - i) % 2 == 0, (F.substring(digits, i, F.lit(1)).cast("int") * 2)).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))


@dataclass(frozen=True)
class Pseudonyms:
    key: str = KEY
    inverse: bool = False

    def card(self, v: Column) -> Column:
        d = _digits(v)
        check = lambda p: ((10 - luhn_sum(p) % 10) % 10).cast("string")
        done = lambda x, y: _let({"p": F.concat(_pad(x, 7), _pad(y, 8))}, lambda s: _fill(v, F.concat(s["p"], check(s["p"]))))
        new = _permuted(self.key, "card", F.substring(d, 1, 7), F.substring(d, 8, 8), 10**7, 10**8, self.inverse, done)
        # Of other lengths than 16 the first digit stays, as it is part of the format.
        n = F.length(d)
        h = F.floor((n - 2) / 2).cast("int")
        power = lambda k: F.pow(F.lit(10.0), k).cast("long")
        padded = lambda x, k: F.lpad(x.cast("string"), k, "0")
        other = lambda x, y: _let({"p": F.concat(F.substring(d, 1, 1), padded(x, h), padded(y, n - 2 - h))}, lambda s: _fill(v, F.concat(s["p"], check(s["p"]))))
        free = _permuted(self.key, "card", F.substring(d, F.lit(2), h), F.substring(d, h + 2, n - 2 - h), power(h), power(n - 2 - h), self.inverse, other)
        valid = check(F.substring(d, F.lit(1), n - 1)) == F.substring(d, n, F.lit(1))
        return F.when(valid, F.when(n == 16, new).otherwise(free)).otherwise(v)

    def phone(self, v: Column) -> Column:
        d = _digits(v)
        ten = F.substring(d, -10, 10)
        done = lambda x, y: _fill(v, F.concat(_pad(x, 5), _pad(y, 5)), F.length(d) - 10)
        american = _permuted(self.key, "phone", F.substring(ten, 1, 5), F.substring(ten, 6, 5), 10**5, 10**5, self.inverse, done)
        # Of all others the country code stays.
        code = F.length(F.regexp_extract(d, r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})", 0))
        n = F.length(d) - code
        h = F.floor(n / 2).cast("int")
        power = lambda k: F.pow(F.lit(10.0), k).cast("long")
        padded = lambda x, k: F.lpad(x.cast("string"), k, "0")
        far = lambda x, y: _fill(v, F.concat(padded(x, h), padded(y, n - h)), code)
        abroad = _permuted(self.key, "phone", F.substring(d, code + 1, h), F.substring(d, code + 1 + h, n - h), power(h), power(n - h), self.inverse, far)
        return F.when(v.startswith("+") & ~((F.length(d) == 11) & d.startswith("1")), abroad).otherwise(american)

    def ssn(self, v: Column) -> Column:
        """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
        d = _digits(v)
        area, group, serial = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 2).cast("long"), F.substring(d, 6, 4).cast("long")
        valid = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
        left = (F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + group - 1

        def done(x: Column, y: Column) -> Column:
            a = F.floor(x / 99)
            return F.concat_ws("-", _pad(F.when(a >= 665, a + 2).otherwise(a + 1), 3), _pad(x % 99 + 1, 2), _pad(y + 1, 4))

        return F.when(valid, _permuted(self.key, "ssn", left, serial - 1, 898 * 99, 9999, self.inverse, done)).otherwise(v)

    def ip(self, v: Column) -> Column:
        octets = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
        valid = F.forall(octets, lambda x: x <= 255) & ~v.rlike(r"(^|\.)0\d")
        done = lambda x, y: F.concat_ws(".", F.floor(x / 256), x % 256, F.floor(y / 256), y % 256)
        left, right = F.get(octets, 0) * 256 + F.get(octets, 1), F.get(octets, 2) * 256 + F.get(octets, 3)
        return F.when(valid, _permuted(self.key, "ip", left, right, 1 << 16, 1 << 16, self.inverse, done)).otherwise(v)

    def date(self, v: Column) -> Column:
        return F.when(v.rlike(r"^\d{4}"), self._year_first(v)).otherwise(self._year_last(v))

    def _year_last(self, v: Column) -> Column:
        """Day and month in either order: what is above 12 is the day; of two below, the first is taken for the month. The widths, the order and which part is above 12 stay."""
        one, two, year = (F.regexp_extract(v, r"^(\d+)\D(\d+)\D(\d+)$", i) for i in (1, 2, 3))
        day_first = one.cast("int") > 12
        day, month = F.when(day_first, one).otherwise(two), F.when(day_first, two).otherwise(one)
        when = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
        since = F.datediff(when, F.lit("1901-01-01").cast("date"))
        form = F.when(day.cast("int") > 12, F.length(month) + 3).otherwise((F.length(day) - 1) * 2 + F.length(month) - 1)
        days = F.get(constant(str(OFFSETS), "array<array<int>>"), form.cast("int"))

        def done(x: Column, y: Column) -> Column:
            new = F.date_add(F.lit("1901-01-01").cast("date"), (x * 1461 + F.get(days, y.cast("int"))).cast("int"))
            d, m = F.lpad(F.day(new).cast("string"), F.length(day), "0"), F.lpad(F.month(new).cast("string"), F.length(month), "0")
            return F.concat(F.when(day_first, d).otherwise(m), F.regexp_extract(v, r"\D", 0), F.when(day_first, m).otherwise(d), F.regexp_extract(v, r"\D", 0), F.year(new).cast("string"))

        new = _permuted(self.key, "date", F.floor(since / 1461), F.array_position(days, (since % 1461).cast("int")) - 1, CYCLES, F.size(days), self.inverse, done)
        return F.when((since >= 0) & (since < CYCLES * 1461), new).otherwise(v)

    def _year_first(self, v: Column) -> Column:
        between = F.substring(v, 5, 1)
        day = F.datediff(F.try_to_date(F.translate(v, "/.", "--"), "yyyy-MM-dd"), F.lit("1900-01-01").cast("date"))
        a, b = DAYS
        done = lambda x, y: F.replace(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (x * b + y).cast("int")), "yyyy-MM-dd"), F.lit("-"), between)
        new = _permuted(self.key, "date", F.floor(day / b), day % b, a, b, self.inverse, done)
        return F.when((day >= 0) & (day < a * b), new).otherwise(v)

    def email(self, v: Column) -> Column:
        """Letters and digits before the @ are permuted within their class, the domain's name as well; the last label stays."""
        last = F.regexp_extract(v, r"\.[A-Za-z0-9-]+$", 0)
        head = F.substring(v, F.lit(1), F.length(v) - F.length(last))
        n = F.length(head)
        half = F.floor((n + 1) / 2).cast("int")
        start = F.struct(F.substring(head, F.lit(1), half).alias("l"), F.substring(head, half + 1, n).alias("r"))
        sign = F.lit(-1 if self.inverse else 1)

        def shifted(s: Column, by: Column, i: Column) -> Column:
            def one(c: Column, k: Column) -> Column:
                pad = F.sha2(F.concat_ws("|", F.lit(self.key), F.lit("email"), i.cast("string"), by, F.floor(k / 16).cast("string")), 256)
                bits = F.conv(F.substring(pad, (k % 16 * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
                code = F.ascii(c)
                move = lambda base, size: F.char((F.pmod(code - base + sign * (bits % size), F.lit(size)) + base).cast("long"))
                return F.when(c.rlike("^[a-z]$"), move(97, 26)).when(c.rlike("^[A-Z]$"), move(65, 26)).when(c.rlike("^[0-9]$"), move(48, 10)).otherwise(c)

            return F.array_join(F.transform(F.split(s, r"(?!\A)(?!\z)"), one), "")

        def step(acc: Column, i: Column) -> Column:
            return F.when(i % 2 == 0, F.struct(shifted(acc["l"], acc["r"], i).alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), shifted(acc["r"], acc["l"], i).alias("r")))

        rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if self.inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(rounds, start, step, lambda acc: F.concat(acc["l"], acc["r"], last))

    def value(self, v: Column) -> Column:
        out = v
        whole = lambda name: v.rlike("^(?:" + _bare(FORMATS[name]) + ")$")
        for name in reversed(FORMATS):
            out = F.when(whole(name), getattr(self, name)(v)).otherwise(out)
        return out

    def text(self, t: Column) -> Column:
        """The text with every value replaced; the pieces between values stay as they are."""
        found = F.regexp_extract_all(t, F.lit(ANY), F.lit(0))
        between = F.split(t, ANY, -1)
        mixed = F.zip_with(between, found, lambda p, m: F.concat(p, F.coalesce(self.value(m), F.lit(""))))
        return F.when(F.size(found) > 0, F.array_join(mixed, "")).otherwise(t)


def _bare(pattern: str) -> str:
    """The pattern without its looks to either side: for a value that stands alone."""
    return re.sub(r"\(\?<?[!=](?:[^()\[\]]|\[[^\]]*\])*\)", "", pattern)


def pseudonymised(df: DataFrame, text: str = "text", key: str | None = None, inverse: bool = False) -> DataFrame:
    """df with the text column replaced, and n_found (values that look like one of FORMATS) added or replaced.

    A null text stays null and an empty one empty, with n_found 0. Values that fail their check stay as they
    are, and are counted. Without a key the session's setting KEY_SETTING is taken; none at all is an error, since a key that is public hides nothing. With inverse=True and the same key, pseudonyms turn back into values. Repeated rows get the same text;
    all other columns stay. Nothing is shuffled.
    """
    key = key or df.sparkSession.conf.get(KEY_SETTING, "")
    if not key:
        raise ValueError(f"pseudonyms need a key that only you know: set {KEY_SETTING} or give one")
    n = F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))), F.lit(0))
    return df.withColumns({"n_found": n, text: Pseudonyms(key, inverse).text(F.col(text))})


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, key=spark.conf.get(KEY_SETTING, KEY)).select("doc_id", "n_found", "text")


SQL: dict[str, str] = {}
QUERIES = {"op6_pii": op6_pii}
