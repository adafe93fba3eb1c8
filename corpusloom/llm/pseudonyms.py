"""Pseudonyms for personal data that keep its format.

One pattern finds candidates; each is validated for its kind (checksum, calendar, octets).
Its free characters are numbers to mixed bases (10 for digits, 26 for letters of either
case, 256 for address octets, day and cycle of a date) and pass a keyed Feistel network:
one half is shifted by a keyed hash of the other, in turns. Every step can be undone with
the key, so different values of one format get different pseudonyms, and equal values get
equal ones in every document. Check digits are computed anew, separators stay.

| Kind | Kept | Permuted |
|---|---|---|
| mail | separators, top-level domain | letters and digits |
| address (IPv4, octets up to 255) | dots | octets |
| date (valid, 1901 to 2099) | order and separators | the day |
| card (13 to 19 digits, Luhn) | grouping | all but the check digit, computed anew |
| phone, social security number | grouping | digits |
| iban (checksum 97) | country | account; check digits computed anew |
| secret (assigned, or a cloud key) | name and prefix | letters and digits |

Only built-in expressions run, and only on texts that hold a candidate character. Null
text stays null, text without candidates stays as it is, repeated rows get equal
answers, and other columns pass through ``pseudonymise``; ``n_replaced`` replaces a
column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import let
from corpusloom.llm.native import aside, table

KEY = "change-this-key"
ROUNDS = 8

# What candidates look like, in order of precedence. No pattern can
# backtrack over a long run: each starts only where its run starts.
MAIL = r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
YEAR_FIRST = r"(?<![\d.-])(?:19|20)\d\d([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])(?![\d-])"
DAY_FIRST = r"(?<![\d./-])\d{1,2}([-/.])\d{1,2}\1(?:19|20)\d\d(?!\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{8,15}(?!\d)"
NUMBER = r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)|(?<!\d)\d{13,19}(?!\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
CLOUD = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
ASSIGNED = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/.-]{8,}"
KINDS = (("mail", MAIL), ("date", YEAR_FIRST), ("date", DAY_FIRST), ("address", ADDRESS), ("social", SOCIAL), ("number", NUMBER), ("phone", PHONE), ("secret", CLOUD), ("iban", IBAN), ("secret", ASSIGNED))
SECRET_HEAD = r"^(?:AKIA|ASIA|(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)"
GATE = r"[0-9@=:]"

# 72,684 days from 1901-01-01 to 2099-12-31 are 108 cycles of 673 days.
FIRST_DAY, DAYS, CYCLE = "1901-01-01", 72_684, 673


def _without_groups(pattern: str, number: int) -> str:
    """``pattern`` for use as the ``number``-th alternative with one group of its own."""
    return pattern.replace("([-/.])", f"(?<s{number}>[-/.])").replace(r"\1", rf"\k<s{number}>")


ANY = "|".join(_without_groups(pattern, i) for i, (_, pattern) in enumerate(KINDS))


def feistel(digits: Column, bases: Column, key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of number lists with the given bases (arrays of int)."""

    def turn(state: Column, number: Column) -> Column:
        half = F.size(bases).cast("int")
        changes = lambda i: (i * 2 < half) == (number % 2 == 0)
        other = F.array_join(F.filter(state, lambda x, i: ~changes(i)).cast("array<string>"), ",")
        noise = lambda part: F.sha2(F.concat_ws("/", F.lit(key), F.lit(part), number.cast("string"), other), 512)

        def shifted(stream: Column) -> Column:
            add = lambda i: F.conv(F.substr(stream, (i % 60) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return F.transform(state, lambda x, i: F.when(changes(i), F.pmod(x + add(i), F.get(bases, i))).otherwise(x))

        return let(F.concat(noise("a"), noise("b")), shifted)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), digits.cast("array<int>"), turn)


def _base(code: Column) -> Column:
    letter = code.between(65, 90) | code.between(97, 122)
    return F.when(code.between(48, 57), 10).when(letter, 26).otherwise(0)


def _zero(code: Column) -> Column:
    return F.when(code <= 57, 48).when(code <= 90, 65).otherwise(97)


def permuted(value: Column, key: str, head: Column, tail: Column) -> Column:
    """Letters and digits permuted, but for ``head`` characters in front and ``tail`` behind."""

    def rebuilt(codes: Column) -> Column:
        inside = lambda i: (i >= head) & (i < F.size(codes) - tail)
        spots = F.filter(F.transform(codes, lambda c, i: F.when(inside(i) & (_base(c) > 0), i)), lambda i: i.isNotNull())

        def placed(at: Column) -> Column:
            digits = F.transform(at, lambda i: F.get(codes, i) - _zero(F.get(codes, i)))
            bases = F.transform(at, lambda i: _base(F.get(codes, i)))

            def written(new: Column) -> Column:
                where = lambda i: F.array_position(at, i).cast("int")
                return F.array_join(F.transform(codes, lambda c, i: F.when(where(i) > 0, F.char(F.get(new, where(i) - 1) + _zero(c))).otherwise(F.char(c))), "")

            return let(feistel(digits, bases, key), written)

        return let(spots, placed)

    return let(F.transform(F.split(value, ""), lambda c: F.ascii(c)), rebuilt)


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(double(c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _card(value: Column, key: str) -> Column:
    """The last digit makes the Luhn sum of the permuted number zero."""

    def checked(new: Column) -> Column:
        body = F.substr(new, F.lit(1), F.length(new) - 1)
        return F.concat(body, ((10 - _luhn(F.concat(_only_digits(body), F.lit("0")))) % 10).cast("string"))

    return let(permuted(value, key, F.lit(0), F.lit(1)), checked)


def _mod97(value: Column) -> Column:
    """Remainder by 97 of an account number with its first four characters moved behind."""
    turned = F.split(F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4))), "")

    def add(sum_: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code > 57, (sum_ * 100 + code - 55) % 97).otherwise((sum_ * 10 + code - 48) % 97)

    return F.aggregate(turned, F.lit(0), add)


def _iban(value: Column, key: str) -> Column:
    def checked(new: Column) -> Column:
        blank = F.concat(F.substr(new, F.lit(1), F.lit(2)), F.lit("00"), F.substr(new, F.lit(5)))
        return F.concat(F.substr(new, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(blank)).cast("string"), 2, "0"), F.substr(new, F.lit(5)))

    return let(permuted(value, key, F.lit(4), F.lit(0)), checked)


def _octets(value: Column, key: str) -> Column:
    parts = F.split(value, r"\.").cast("array<int>")
    return F.array_join(feistel(parts, F.array_repeat(F.lit(256), 4), key).cast("array<string>"), ".")


def _date(value: Column, key: str, year_first: bool) -> Column:
    """Null if the value is no date of the range. Day before month, unless only the other
    order is a date; the pseudonym is written in the order that was read."""
    mark = F.regexp_extract(value, r"\d([-/.])", 1)
    parts = F.split(value, r"[-/.]").cast("array<int>")

    def day(p: Column, year: int, month: int, number: int) -> Column:
        text = F.concat_ws("-", p[year].cast("string"), F.lpad(p[month].cast("string"), 2, "0"), F.lpad(p[number].cast("string"), 2, "0"))
        valid = p[month].between(1, 12) & p[number].between(1, 31)
        return F.when(valid, F.datediff(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date")))

    def moved(days: Column, order: tuple[int, int, int]) -> Column:
        new = feistel(F.array((days / CYCLE).cast("int"), days % CYCLE), F.array(F.lit(DAYS // CYCLE), F.lit(CYCLE)), key)

        def written(n: Column) -> Column:
            date = F.date_add(F.lit(FIRST_DAY).cast("date"), n[0] * CYCLE + n[1])
            fields = [F.date_format(date, "yyyy"), F.date_format(date, "MM"), F.date_format(date, "dd")]
            return F.concat(fields[order[0]], mark, fields[order[1]], mark, fields[order[2]])

        return F.when(days.between(0, DAYS - 1), let(new, written))

    def read(p: Column) -> Column:
        if year_first:
            return let(day(p, 0, 1, 2), lambda d: moved(d, (0, 1, 2)))
        return F.coalesce(let(day(p, 2, 1, 0), lambda d: moved(d, (2, 1, 0))), let(day(p, 2, 0, 1), lambda d: moved(d, (1, 2, 0))))

    return let(parts, read)


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of one candidate; the value itself if it proves to be no data of its kind."""
    is_a = lambda *patterns: value.rlike("^(?:" + "|".join(_without_groups(p, i) for i, p in enumerate(patterns)) + ")$")
    plain = permuted(value, key, F.lit(0), F.lit(0))
    last_dot = F.length(F.regexp_extract(value, r"\.[^.]*$", 0))
    octets_fit = F.forall(F.split(value, r"\.").cast("array<int>"), lambda o: o <= 255)
    number = F.when(_luhn(_only_digits(value)) == 0, _card(value, key))
    head = F.length(F.regexp_extract(value, SECRET_HEAD, 0))
    changed = (
        F.when(is_a(MAIL), permuted(value, key, F.lit(0), last_dot))
        .when(is_a(YEAR_FIRST), _date(value, key, True))
        .when(is_a(DAY_FIRST), _date(value, key, False))
        .when(is_a(ADDRESS), F.when(octets_fit, _octets(value, key)))
        .when(is_a(SOCIAL), plain)
        .when(is_a(NUMBER), number)
        .when(is_a(PHONE), plain)
        .when(is_a(CLOUD), permuted(value, key, head, F.lit(0)))
        .when(is_a(IBAN), F.when(_mod97(value) == 1, _iban(value, key)))
        .when(is_a(ASSIGNED), permuted(value, key, head, F.lit(0)))
    )
    return F.coalesce(changed, value)


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``n_replaced``."""
    docs, back = aside(docs, "_found", "_new")
    value = F.col(text)
    found = docs.withColumn("_found", F.when(value.rlike(GATE), F.regexp_extract_all(value, F.lit(ANY), F.lit(0))))
    found = found.withColumn("_new", F.when(F.size("_found") > 0, F.transform("_found", lambda v: pseudonym(v, key))))
    between = F.split(value, ANY, -1)
    woven = let(between, lambda b: F.array_join(F.flatten(F.transform(b, lambda part, i: F.array(part, F.coalesce(F.get("_new", i), F.lit(""))))), ""))
    replaced = F.coalesce(F.size(F.filter(F.arrays_zip("_found", "_new"), lambda z: z["_found"] != z["_new"])), F.lit(0)).cast("long")
    return found.withColumns({text: F.when(F.col("_new").isNotNull(), woven).otherwise(value), "n_replaced": replaced}).drop("_found", "_new").withColumnsRenamed(back)


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
