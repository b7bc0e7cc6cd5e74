"""Format-preserving Feistel pseudonyms (operator 5).

Validated numbers, dates and addresses in a text are replaced by others of the same format.  A value becomes a
list of symbols, each with a radix; a Feistel network over the two halves of the list adds keyed shifts
modulo the radices, so that it is a permutation of the format's values: equal values
stay equal in all documents, different ones different, and who has the key can invert it.  DataFrame functions only.

| kind | found as | validated by | permuted |
|---|---|---|---|
| email | name@host.domain | its pattern | letters and digits of the name, host as a tweak |
| ipv4 | four numbers | 0 to 255, no leading zeros | the four numbers |
| date | y-m-d, d.m.y, m/d/y or d/m/y, years 1600 to 2399 | the calendar | the day within its 400 years; d/m/y with a day over 12: month and year, the day stays |
| ssn | 3-2-4 digits | area 001-665, 667-899, group and serial not 0 | all three |
| phone | 10 digits with separators, +1 or 1 before or not | area from 200 | all but the country code, area stays from 200 |
| card | 13 to 19 digits unbroken, 4-4-4-4, 4-4-4-4-3, 4-6-4 or 4-6-5; in a row of groups of four each place is tried | Luhn | all but the first digit, the check digit is computed |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Digests give a shift of 16 bits for each of 16 symbols; longer halves use them again.
SHIFTS = 16

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_YEAR = r"(?:1[6-9]|2[0-3])\d\d"
#: Labels up to the last dot that letters follow.  Possessive: java.util.regex matches them in a loop, however long a host is; a greedy group recurses.
_HOST = r"(?:(?:[A-Za-z0-9-]++\.(?![A-Za-z]{2}))*+[A-Za-z0-9-]++\.(?=[A-Za-z]{2}))++[A-Za-z]{2,}"
#: In the order in which they are tried at a place of the text.
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@{_HOST}",
    "ipv4": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ymd": rf"(?<![\d-]){_YEAR}-\d\d-\d\d(?![\d-])",
    "dmy": rf"(?<![\d.])\d\d\.\d\d\.{_YEAR}(?!\d)",
    "mdy": rf"(?<![\d/])\d\d/\d\d/{_YEAR}(?![\d/])",
    "ssn": r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
    "phone": r"(?<![\d.])(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "card": r"(?<!\d)\d{4}(?:[ -]\d{4}){3,}(?:[ -]\d{3})?(?!\d|-\d{2,3}-\d|[ .-]\d{3}[ .-]\d{4}(?!\d))"
            r"|(?<!\d)\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)|(?<!\d)\d{13,19}(?!\d)",
}
ANY = "|".join(PATTERNS.values())
#: The places between two characters.
BETWEEN = "(?<=.)(?=.)"
#: 400 Gregorian years repeat, and their days are 189 * 773.
CYCLE, DAY_RADICES = 146_097, (189, 773)
EPOCH = "1600-01-01"


def let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def feistel(symbols: Column, radices: Column, tweak: Column, key: str) -> Column:
    """The permuted symbols (array<int>); ``radices``: array<int> of the same size, a symbol of radix 1 stays."""
    half = F.floor(F.size(symbols) / 2).cast("int")

    def halves(a: Column) -> tuple[Column, Column]:
        return F.slice(a, F.lit(1), half), F.slice(a, half + 1, F.size(a))

    (left, right), (lr, rr) = halves(symbols), halves(radices)
    start = F.struct(left.alias("l"), right.alias("r"), lr.alias("a"), rr.alias("b"))

    def one(s: Column, i: Column) -> Column:
        text = F.concat_ws("/", F.lit(key), tweak, i.cast("string"), F.array_join(F.transform(s["r"], lambda x: x.cast("string")), ","))

        def shifted(digest: Column) -> Column:
            return F.transform(s["l"], lambda x, j: ((x + F.conv(F.substr(digest, 1 + 4 * F.pmod(j, F.lit(SHIFTS)), F.lit(4)), 16, 10).cast("int")) % F.get(s["a"], j)).cast("int"))

        return F.struct(s["r"].alias("l"), let(F.sha2(text, 256), shifted).alias("r"), s["b"].alias("a"), s["a"].alias("b"))

    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    # an even number of rounds: both halves are back in their places
    return F.aggregate(rounds, start, one, lambda s: F.concat(s["l"], s["r"]))


def _characters(text: Column, tweak: Column, key: str, keep_first: Column, low_first: int | None = None) -> Column:
    """Permute the letters and digits of a text, each within its kind; ``keep_first``: how many characters stay.

    ``low_first``: least digit of the first one, which is permuted from there to 9.
    """
    def base(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        kind = F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).when(c.rlike("^[A-Z]$"), 65).otherwise(code)
        kind = F.when(i < keep_first, code).otherwise(kind)
        return (F.when(i == 0, 48 + low_first).otherwise(kind) if low_first is not None else kind).cast("int")

    def radix(c: Column, i: Column) -> Column:
        r = F.when(i < keep_first, 1).when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), 26).otherwise(1)
        return (F.when(i == 0, 10 - low_first).otherwise(r) if low_first is not None else r).cast("int")

    def run(chars: Column) -> Column:
        bases, radices = F.transform(chars, base), F.transform(chars, radix)
        symbols = F.zip_with(chars, bases, lambda c, b: (F.ascii(c) - b).cast("int"))
        return F.array_join(F.zip_with(feistel(symbols, radices, tweak, key), bases, lambda x, b: F.char(x + b)), "")

    return F.when(F.length(text) > 0, let(F.split(text, BETWEEN), run)).otherwise(F.lit(""))


def _email(m: Column, key: str) -> Column:
    host = F.substring_index(m, "@", -1)
    return F.concat(_characters(F.substring_index(m, "@", 1), F.concat(F.lit("email@"), F.lower(host)), key, F.lit(0)), F.lit("@"), host)


def _numbers(values: Column, radices: list[int], tweak: str, key: str) -> Column:
    return feistel(values, F.array(*[F.lit(r) for r in radices]), F.lit(tweak), key)


def _ipv4(m: Column, key: str) -> Column:
    values = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return F.array_join(F.transform(_numbers(values, [256] * 4, "ipv4", key), lambda x: x.cast("string")), ".")


def _date(m: Column, form: str, key: str) -> Column:
    """A date of one form; null if the calendar lacks it."""
    day = F.try_to_timestamp(m, F.lit(form)).cast("date")
    n = F.date_diff(day, F.lit(EPOCH).cast("date"))
    within = F.pmod(n, F.lit(CYCLE))
    values = F.array(F.floor(within / DAY_RADICES[1]).cast("int"), (within % DAY_RADICES[1]).cast("int"))
    new = let(_numbers(values, list(DAY_RADICES), "date", key), lambda v: F.date_format(
        F.date_add(F.lit(EPOCH).cast("date"), (n - within + v[0] * DAY_RADICES[1] + v[1]).cast("int")), form))
    return F.when(day.isNotNull(), new)


def _day_first(m: Column, key: str) -> Column:
    """d/m/y that m/d/y cannot be: the day stays, month and year change within 400 years where the day exists in all of them."""
    day = F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).cast("date")
    d, month, year = F.dayofmonth(day), F.month(day), F.year(day)
    cycle = F.floor(year / 400).cast("int") * 400
    months = (year - cycle) * 12 + month - 1
    any_month = let(_numbers(F.array(F.floor(months / 80).cast("int"), (months % 80).cast("int")), [60, 80], "month", key), lambda v: F.concat(
        F.substr(m, F.lit(1), F.lit(3)), F.lpad(((v[0] * 80 + v[1]) % 12 + 1).cast("string"), 2, "0"), F.lit("/"),
        (cycle + F.floor((v[0] * 80 + v[1]) / 12)).cast("string")))
    years = year - cycle
    same_month = let(_numbers(F.array(F.floor(years / 20).cast("int"), (years % 20).cast("int")), [20, 20], "year", key), lambda v: F.concat(
        F.substr(m, F.lit(1), F.lit(6)), (cycle + v[0] * 20 + v[1]).cast("string")))
    return F.when(d <= 28, any_month).when(month != 2, same_month)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    values = F.array((area - F.when(area < 666, 1).otherwise(2)).cast("int"), (group - 1).cast("int"), (serial - 1).cast("int"))
    new = let(_numbers(values, [898, 99, 9999], "ssn", key), lambda v: F.concat_ws(
        "-", F.lpad((v[0] + F.when(v[0] < 665, 1).otherwise(2)).cast("string"), 3, "0"), F.lpad((v[1] + 1).cast("string"), 2, "0"), F.lpad((v[2] + 1).cast("string"), 4, "0")))
    return F.when(valid, new)


def _phone(m: Column, key: str) -> Column:
    own = F.regexp_extract(m, r"([2-9]\d\d\)?[ .-]?\d{3}[ .-]\d{4})$", 1)
    return F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(own)), _characters(own, F.lit("phone"), key, F.lit(0), low_first=2))


def _luhn_sum(digits: Column, double_first: int) -> Column:
    """Luhn sum of digits from the right; every other one is doubled, beginning with ``double_first`` (0 or 1)."""
    values = F.transform(F.split(F.reverse(digits), BETWEEN), lambda c, i: F.when(i % 2 == double_first, c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: (a + F.when(v > 9, v - 9).otherwise(v)).cast("int"))


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, r"\D", "")
    body = _characters(F.substr(m, F.lit(1), F.length(m) - 1), F.lit("card"), key, F.lit(1))
    new = let(body, lambda b: F.concat(b, F.pmod(10 - _luhn_sum(F.regexp_replace(b, r"\D", ""), 0) % 10, F.lit(10)).cast("string")))
    return F.when(_luhn_sum(digits, 1) % 10 == 0, new)


def _cards(m: Column, key: str) -> Column:
    """Groups of four digits in a row, the last of three or not: each card of four groups (and the last) from the left; null without one."""
    k = F.floor((F.length(m) + 1) / 5).cast("int")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("next"), F.lit(False).alias("found"))

    def one(s: Column, i: Column) -> Column:
        at = i * 5 + 1
        long = F.when((i == k - 4) & (F.length(m) == k * 5 + 3), _card(F.substr(m, at, F.lit(23)), key))
        short = F.when(i <= k - 4, F.concat(_card(F.substr(m, at, F.lit(19)), key), F.substr(m, at + 19, F.lit(1))))
        new = F.array(F.struct(long.alias("long"), short.alias("short")))
        step = F.transform(new, lambda n: F.struct(
            F.concat(s["out"], F.coalesce(n["long"], n["short"], F.substr(m, at, F.lit(5)))).alias("out"),
            F.when(n["long"].isNotNull(), i + 5).when(n["short"].isNotNull(), i + 4).otherwise(i + 1).alias("next"),
            (s["found"] | n["long"].isNotNull() | n["short"].isNotNull()).alias("found")))[0]
        return F.when(i < s["next"], s).otherwise(step)

    places = F.sequence(F.lit(0), F.greatest(F.lit(0), k - 4))
    return F.aggregate(places, start, one, lambda s: F.when(s["found"], F.concat(s["out"], F.substr(m, s["next"] * 5 + 1, F.length(m)))))


def pseudonym(m: Column, key: str) -> Column:
    """What replaces a match of ANY: null if it is not valid, and stays."""
    return (F.when(m.contains("@"), _email(m, key))
            .when(m.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), _ipv4(m, key))
            .when(m.rlike(rf"^{_YEAR}-\d\d-\d\d$"), _date(m, "yyyy-MM-dd", key))
            .when(m.rlike(rf"^\d\d\.\d\d\.{_YEAR}$"), _date(m, "dd.MM.yyyy", key))
            .when(m.rlike(rf"^\d\d/\d\d/{_YEAR}$"), F.coalesce(_date(m, "MM/dd/yyyy", key), _day_first(m, key)))
            .when(m.rlike(r"^\d{3}-\d\d-\d{4}$"), _ssn(m, key))
            .when(m.rlike("^" + PATTERNS["phone"].split(")", 1)[1] + "$"), _phone(m, key))
            .when(m.rlike(r"^\d{4}(?:[ -]\d{4}){3}"), _cards(m, key))
            .otherwise(_card(m, key)))


def replace_pii(text: Column, key: str) -> tuple[Column, Column]:
    """(text with pseudonyms, number of replaced values); a null text stays null with 0."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    new = F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))
    return F.split(text, ANY, -1), new


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The documents with pseudonyms in ``text`` and n_replaced (long), the number of values replaced; all columns stay.

    A null text stays null, an empty one empty; texts of any length are worked on whole, rows one by one (also repeated ones).  An invalid
    candidate, such as a card number that fails Luhn, stays as it is.  A column n_replaced of the input is replaced.
    """
    text = F.col("text").cast("string")
    gaps, new = replace_pii(F.col("__text"), key)
    some = F.col("__text").rlike("[0-9@]")
    # a struct around the row: no column of the input can clash
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), text.alias("__text"))
    d = d.select("__row", "__text", F.when(some, gaps).alias("__gaps"), F.when(some, new).alias("__new"))
    after = F.slice("__gaps", F.lit(2), F.greatest(F.lit(0), F.size("__gaps") - 1))
    built = F.concat(F.get("__gaps", F.lit(0)), F.array_join(F.zip_with("__new", after, lambda p, g: F.concat(F.coalesce(p["new"], p["old"]), g)), ""))
    n = F.coalesce(F.size(F.filter("__new", lambda p: p["new"].isNotNull())), F.lit(0)).cast("long")
    columns = [F.when(some, built).otherwise(F.col("__text")).alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c != "n_replaced"]
    return d.select(*columns, F.when(some, n).otherwise(F.lit(0)).cast("long").alias("n_replaced"))
