"""Operator 3: format-preserving pseudonyms by keyed Feistel permutations.

Personal values are found by pattern, validated, and replaced by the image of a
keyed permutation of their own format, so that equal values stay equal in every
document and distinct values stay distinct within a format:

* card numbers (13 to 19 digits, Luhn): the first digit and the separators stay, the
  last digit is computed anew, so that the pseudonym is valid too;
* telephone numbers: the country code and the punctuation stay; North American
  area and exchange codes keep a first digit of 2 to 9, or of 0 and 1 after +1;
* IPv4 addresses: every octet keeps its width and a leading zero;
* US social security numbers (no area 000, 666 or 9xx, ...);
* IBANs (mod 97): letters and digits keep their places, check digits are anew;
* dates (2001-02-28, 28.02.2001, 02/28/2001; day first with slashes where only
  that is valid) from 1800 to 2199: with two digits each for day and month permuted
  within these 146,097 days, else within the days and months of the same widths and
  leading zeros, and the 400 years; a 29 February of these within the 97 leap years;
* e-mail addresses: letters and digits of the local part, upper case kept;
* credentials (key ids, values of password, secret and token): each character
  within its class.

The permutation is a Feistel network over mixed-radix digits: the digits are cut in
two halves which take turns in being shifted, digit by digit modulo its radix, by a
stream that SHA-512 makes of key, kind, round and the other half. Everything is
built from SQL functions; a text without a digit or @ is not looked at closely.

A null text stays null, an empty one empty; long texts are searched whole. Repeated rows
get the same pseudonyms, as does a value wherever it occurs. An empty table gives no rows.
Of overlapping candidates the leftmost is taken, of equal ones the kind that comes first.
``in_place`` carries further columns of any name, ``pseudonymised`` does not read them.

There is no default key: without ``CONF`` or an argument an error is raised. The key is part
of the plan as a digest for each kind: event logs are to be kept as safe as the key.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import carried

ROUNDS = 10
CONF = "spark.pagemill.pii.key"

#: Characters of an IBAN by country.
IBAN_LENGTH = {
    15: "NO", 16: "BE", 18: "DK FI NL", 19: "MK SI", 20: "AT EE LT LU", 21: "CH HR LI LV", 22: "BG DE GB IE ME RS", 23: "AE IL",
    24: "AD CZ ES PK RO SA SE SK TN", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO HU LB PL", 29: "BR UA", 30: "KW JO", 31: "MT",
}

#: No candidate may swallow what follows it: each pattern fixes how many digits it takes.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9])"
CARD = r"(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{4}([ \-])\d{6}\2\d{5})(?![0-9A-Za-z])"
SSN = r"\d{3}-\d{2}-\d{4}(?![0-9A-Za-z])"
DATE_ISO = r"\d{4}-\d{2}-\d{2}(?![0-9])"
DATE_DOT = r"\d{1,2}\.\d{1,2}\.\d{4}(?![0-9A-Za-z])"
DATE_SLASH = r"\d{1,2}/\d{1,2}/\d{4}(?![0-9A-Za-z])"
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
PHONE_NATIONAL = r"(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![0-9A-Za-z])"
PHONE_AMERICAN = r"\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?![0-9A-Za-z])"
#: With one separator throughout, or 8 to 15 digits with any; a number does not end where its digits go on.
PHONE = (
    r"\+[2-9](?:\d{0,2}(?:\d{6,12}|([ \-]?)\(?\d{1,5}\)?(?:\3\d{2,8}){1,4})(?<=\d" + r"[ ().\-]{0,2}\d" * 7 + r")(?![0-9A-Za-z]|[.\-][0-9])"
    r"|(?:(?:[ .\-]?\(?|\)[ .\-]?)\d){7,14}(?![0-9A-Za-z]|[.\-][0-9]))"
)
IBAN = "(?:" + "|".join(rf"(?:{names.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTH.items()) + ")(?![0-9A-Za-z])"
KEY_ID = r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
NAMES = "(?i:password|passwd|secret|token|api_key|apikey)"
NAMED_SECRET = rf"""(?<=[:= "'])(?=[A-Za-z0-9_\-]{{12}})(?<=(?:{NAMES})[ ]{{0,2}}[:=][ ]{{0,2}}["']{{0,1}})[A-Za-z0-9_\-]++"""
BEFORE = r"(?<![0-9A-Za-z]|[0-9][.\-/])"
FOUND = (
    f"{EMAIL}|(?=[0-9(]){BEFORE}(?:{CARD}|{SSN}|{DATE_ISO}|{IPV4}|{DATE_DOT}|{DATE_SLASH}|{PHONE_NATIONAL})"
    f"|(?=[A-Z]{{2}}){BEFORE}(?:{IBAN}|{KEY_ID})|(?=\\+)(?<![0-9A-Za-z+])(?:{PHONE_AMERICAN}|{PHONE})|{NAMED_SECRET}"
)
HINT = f"[0-9@]|AKIA|ASIA|(?:{NAMES})[ ]{{0,2}}[:=]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once."""
    return F.transform(F.array(value), body).getItem(0)


def longs(*values: int) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def feistel(digits: Column, radices: Column, key: str) -> Column:
    """The image of an array of longs below their radices under the permutation of ``key``."""

    def stream(other: Column, size: Column, turn: Column) -> Column:
        """32 hexadecimal bits for each of ``size`` digits."""
        said = F.concat(F.lit(f"{key}/"), turn.cast("string"), F.lit("/"), F.array_join(other.cast("array<string>"), ","))
        blocks = F.sequence(F.lit(0), F.floor(size / 16).cast("int"))
        return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat(said, F.lit("/"), b.cast("string")), 512)), "")

    def one(acc: Column, turn: Column) -> Column:
        shifted = let(
            stream(acc.b, F.size(acc.a), turn),
            lambda s: F.transform(
                F.arrays_zip(acc.a.alias("v"), acc.ra.alias("r")),
                lambda x, i: (x["v"] + F.conv(F.substring(s, i * 8 + 1, F.lit(8)), 16, 10).cast("long")) % x["r"],
            ),
        )
        return F.struct(acc.b.alias("a"), shifted.alias("b"), acc.rb.alias("ra"), acc.ra.alias("rb"))

    def run(x: Column) -> Column:
        half = F.floor(F.size(x["d"]) / 2).cast("int")
        rest = F.size(x["d"]) - half
        start = F.struct(
            F.slice(x["d"], F.lit(1), half).alias("a"), F.slice(x["d"], half + 1, rest).alias("b"),
            F.slice(x["r"], F.lit(1), half).alias("ra"), F.slice(x["r"], half + 1, rest).alias("rb"),
        )
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one, lambda acc: F.concat(acc.a, acc.b))

    return let(F.struct(digits.alias("d"), radices.alias("r")), run)


def characters(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def digits_of(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit("[0-9]"), F.lit(0)), lambda c: c.cast("long"))


def refill(value: Column, slot: str, symbols: Column) -> Column:
    """``value`` with the characters that match ``slot`` replaced by those of ``symbols`` in turn."""

    def run(x: Column) -> Column:
        gaps = F.split(x["v"], slot, -1)
        return F.array_join(F.transform(gaps, lambda g, i: F.concat(F.when(i > 0, F.element_at(x["s"], F.greatest(i, F.lit(1)))).otherwise(F.lit("")), g)), "")

    return let(F.struct(value.alias("v"), symbols.alias("s")), run)


def permuted_characters(value: Column, key: str, letters: int = 26) -> Column:
    """Every letter and digit (of ASCII) permuted within its class; ``letters``: 6 for hexadecimal digits."""
    free = F.regexp_extract_all(value, F.lit("[0-9A-Za-z]"), F.lit(0))
    is_digit = lambda c: c.between(F.lit("0"), F.lit("9"))
    symbol = lambda c: F.when(is_digit(c), F.ascii(c) - 48).otherwise(F.ascii(F.lower(c)) - 97).cast("long")
    radix = lambda c: F.when(is_digit(c), F.lit(10)).otherwise(F.lit(letters)).cast("long")

    def shown(c: Column, x: Column) -> Column:
        small = F.char(x + 97)
        return F.when(is_digit(c), x.cast("string")).when(c.between(F.lit("A"), F.lit("Z")), F.upper(small)).otherwise(small)

    image = lambda c: F.zip_with(c, feistel(F.transform(c, symbol), F.transform(c, radix), key), shown)
    return let(free, lambda c: refill(value, "[0-9A-Za-z]", image(c)))


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10, the last digit being the check digit."""
    double = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    terms = F.transform(F.reverse(digits), lambda x, i: F.when(i % 2 == 1, double(x)).otherwise(x))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x) % 10


def card(value: Column, key: str) -> Column:
    def image(d: Column) -> Column:
        inner = F.slice(d, F.lit(2), F.size(d) - 2)
        ten = F.transform(inner, lambda x: F.lit(10).cast("long"))
        body = F.concat(F.slice(d, 1, 1), feistel(inner, ten, key))
        whole = let(body, lambda b: F.concat(b, F.array((10 - luhn(F.concat(b, longs(0)))) % 10)))
        return F.when(luhn(d) == 0, refill(value, "[0-9]", whole.cast("array<string>"))).otherwise(value)

    return let(digits_of(value), image)


def ssn(value: Column, key: str) -> Column:
    def image(x: Column) -> Column:
        area, group, serial = x.getItem(0), x.getItem(1), x.getItem(2)
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        d = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
        show = lambda y: F.format_string(
            "%03d-%02d-%04d", F.when(y.getItem(0) >= 665, y.getItem(0) + 2).otherwise(y.getItem(0) + 1), y.getItem(1) + 1, y.getItem(2) + 1
        )
        return F.when(valid, let(feistel(d, longs(898, 99, 9999), key), show)).otherwise(value)

    return let(F.transform(F.split(value, "-"), lambda p: p.cast("long")), image)


def ipv4(value: Column, key: str) -> Column:
    def image(x: Column) -> Column:
        zero = lambda o: F.startswith(o, F.lit("0")) & (F.length(o) > 1)
        least = lambda o: F.when(zero(o) | (F.length(o) == 1), 0).when(F.length(o) == 2, 10).otherwise(100).cast("long")
        radix = lambda o: F.when(zero(o), F.pow(F.lit(10), F.length(o) - 1)).when(F.length(o) == 1, 10).when(F.length(o) == 2, 90).otherwise(156).cast("long")
        moved = feistel(F.transform(x, lambda o: o.cast("long") - least(o)), F.transform(x, radix), key)
        shown = F.zip_with(x, moved, lambda o, v: F.lpad((v + least(o)).cast("string"), F.length(o), F.lit("0")))
        return F.when(F.forall(x, lambda o: o.cast("long") < 256), F.array_join(shown, ".")).otherwise(value)

    return let(F.split(value, r"\."), image)


def phone(value: Column, key: str) -> Column:
    """With a leading + of 8 digits or more, or a North American number of 10."""

    def image(d: Column) -> Column:
        n = F.size(d)
        international = F.startswith(value, F.lit("+"))
        code = F.when(international & (d.getItem(0) == 1), 1).when(international, 2).otherwise(0)
        own = F.slice(d, code + 1, n - code)
        american = (F.size(own) == 10) & (code < 2) & ((code == 1) | ((own.getItem(0) > 1) & (F.element_at(own, 4) > 1)))
        valid = F.when(international & (code == 2), n >= 8).otherwise(american)
        first = lambda i: american & i.isin(0, 3)
        least = lambda v, i: F.when(first(i) & (v > 1), F.lit(2)).otherwise(F.lit(0)).cast("long")
        most = lambda v, i: F.when(first(i), F.when(v > 1, F.lit(8)).otherwise(F.lit(2))).otherwise(F.lit(10)).cast("long")

        def moved(x: Column) -> Column:
            start = F.transform(x, lambda v, i: v - least(v, i))
            radix = F.transform(x, most)
            least_ = F.transform(x, least)
            back = F.zip_with(feistel(start, radix, key), least_, lambda v, low: (v + low).cast("string"))
            return refill(value, "[0-9]", F.concat(F.slice(d, F.lit(1), code).cast("array<string>"), back))

        return F.when(F.coalesce(valid, F.lit(False)), let(own, moved)).otherwise(value)

    return let(digits_of(value), image)


#: Days of 400 years; 146,097 is their product.
DAY_RADICES = (189, 773)
FIRST_YEAR, YEARS = 1800, 400
LEAP_YEARS = [y for y in range(FIRST_YEAR, FIRST_YEAR + YEARS) if y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)]


def month_days(months: range, days: range) -> Column:
    """100 * month + day of a common year's days in both ranges."""
    last = lambda m: 28 if m == 2 else 30 if m in (4, 6, 9, 11) else 31
    return longs(*(100 * m + d for m in months for d in days if d <= last(m)))


def by_day(x: Column, key: str) -> Column:
    """The image of a date (y, m, d) among all days of the 400 years."""
    first = F.lit(f"{FIRST_YEAR}-01-01").cast("date")
    n = F.datediff(x["day"], first).cast("long")
    d = F.array(F.floor(n / DAY_RADICES[1]), n % DAY_RADICES[1])
    back = lambda y: F.date_format(F.date_add(first, (y.getItem(0) * DAY_RADICES[1] + y.getItem(1)).cast("int")).cast("timestamp_ntz"), "yyyy-MM-dd")
    return let(let(feistel(d, longs(*DAY_RADICES), key), back), lambda iso: F.struct(F.substring(iso, 1, 4).alias("y"), F.substring(iso, 6, 2).alias("m"), F.substring(iso, 9, 2).alias("d")))


def by_width(x: Column, key: str) -> Column:
    """The image of a date among those whose day and month have the same widths and leading zeros."""
    small, large, zero = range(1, 10), range(10, 13), lambda c: F.startswith(c, F.lit("0"))
    short = lambda c: F.length(c) == 1
    # A day first that would also be a month is read as a month, so that those days stay above 12.
    kind = (
        F.when((x["form"] == "day") & short(x["m"]), month_days(small, range(13, 32))).when(x["form"] == "day", month_days(range(1, 13), range(13, 32)))
        .when(short(x["m"]) & ~short(x["d"]) & ~zero(x["d"]), month_days(small, range(10, 32)))
        .when(short(x["d"]) & ~short(x["m"]) & ~zero(x["m"]), month_days(large, small)).otherwise(month_days(small, small))
    )

    def image(z: Column) -> Column:
        leap, year = z["at"] == 229, x["y"].cast("long")
        digits = F.when(leap, F.array(F.array_position(longs(*LEAP_YEARS), year) - 1)).otherwise(F.array(F.array_position(z["kind"], z["at"]) - 1, year - FIRST_YEAR))
        radices = F.when(leap, longs(len(LEAP_YEARS))).otherwise(F.array(F.size(z["kind"]).cast("long"), F.lit(YEARS).cast("long")))

        def back(o: Column) -> Column:
            place = (o.getItem(0) + 1).cast("int")
            at = F.when(leap, z["at"]).otherwise(F.element_at(z["kind"], place))
            y = F.when(leap, F.element_at(longs(*LEAP_YEARS), place)).otherwise(o.getItem(1) + FIRST_YEAR)
            show = lambda v, like: F.lpad(v.cast("string"), F.length(like), F.lit("0"))
            return F.struct(y.cast("string").alias("y"), show(F.floor(at / 100), x["m"]).alias("m"), show(at % 100, x["d"]).alias("d"))

        return let(feistel(digits, radices, f"{key}/width"), back)

    return let(F.struct((x["m"].cast("long") * 100 + x["d"].cast("long")).alias("at"), kind.alias("kind")), image)


def date(value: Column, key: str) -> Column:
    parts = F.split(value, r"[-./]")
    as_date = lambda y, m, d: F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")

    def row(form: str, y: int, m: int, d: int) -> Column:
        y_, m_, d_ = (parts.getItem(i) for i in (y, m, d))
        return F.struct(F.lit(form).alias("form"), y_.alias("y"), m_.alias("m"), d_.alias("d"), as_date(y_, m_, d_).alias("day"))

    form = (
        F.when(F.contains(value, F.lit("-")), row("iso", 0, 1, 2)).when(F.contains(value, F.lit(".")), row("dot", 2, 1, 0))
        .when(as_date(parts.getItem(2), parts.getItem(0), parts.getItem(1)).isNotNull(), row("month", 2, 0, 1)).otherwise(row("day", 2, 1, 0))
    )

    def image(x: Column) -> Column:
        valid = x["day"].isNotNull() & F.year(x["day"]).between(FIRST_YEAR, FIRST_YEAR + YEARS - 1)
        wide = (F.length(x["m"]) == 2) & (F.length(x["d"]) == 2) & (x["form"] != "day")
        layout = lambda o: (
            F.when(x["form"] == "iso", F.concat_ws("-", o["y"], o["m"], o["d"])).when(x["form"] == "dot", F.concat_ws(".", o["d"], o["m"], o["y"]))
            .when(x["form"] == "month", F.concat_ws("/", o["m"], o["d"], o["y"])).otherwise(F.concat_ws("/", o["d"], o["m"], o["y"]))
        )
        return F.when(valid & wide, let(by_day(x, key), layout)).when(valid, let(by_width(x, key), layout)).otherwise(value)

    return let(form, image)


def _mod97(text: Column) -> Column:
    """Of a text of digits and capitals, A counting as 10."""
    step = lambda a, c: F.when(c.between(F.lit("0"), F.lit("9")), (a * 10 + c.cast("long")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(characters(text), F.lit(0).cast("long"), lambda a, c: step(a, c).cast("long"))


def iban(value: Column, key: str) -> Column:
    def image(x: Column) -> Column:
        plain = F.regexp_replace(x, " ", "")
        rest = lambda p: F.concat(F.substring(p, 5, 1000), F.substring(p, 1, 2))
        valid = F.length(plain).between(15, 34) & (_mod97(F.concat(rest(plain), F.substring(plain, 3, 2))) == 1)
        body = permuted_characters(F.substring(x, 5, 1000), key)
        check = lambda b: F.lpad((98 - _mod97(F.concat(F.regexp_replace(b, " ", ""), F.substring(x, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return F.when(valid, let(body, lambda b: F.concat(F.substring(x, 1, 2), check(b), b))).otherwise(value)

    return let(value, image)


def email(value: Column, key: str) -> Column:
    return let(value, lambda v: F.concat(permuted_characters(F.substring_index(v, "@", 1), key), F.lit("@"), F.substring_index(v, "@", -1)))


def key_id(value: Column, key: str) -> Column:
    return F.concat(F.substring(value, 1, 4), permuted_characters(F.substring(value, 5, 100), key))


def secret(value: Column, key: str) -> Column:
    is_hex = F.rlike(value, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$"))
    return F.when(is_hex, permuted_characters(value, f"{key}/hex", 6)).otherwise(permuted_characters(value, key))


#: In the order in which a candidate is tried: its whole text decides.
KINDS: list[tuple[str, str, Callable[[Column, str], Column]]] = [
    ("email", EMAIL, email), ("card", CARD, card), ("ssn", SSN, ssn), ("date", DATE_ISO, date), ("ipv4", IPV4, ipv4), ("date", DATE_DOT, date),
    ("date", DATE_SLASH, date), ("phone", PHONE_AMERICAN, phone), ("phone", PHONE.replace(r"\3", r"\1"), phone), ("phone", PHONE_NATIONAL, phone), ("iban", IBAN, iban), ("key", KEY_ID, key_id), ("secret", r"[A-Za-z0-9_\-]+", secret),
]


def subkey(key: str, kind: str) -> str:
    return hmac.new(key.encode(), kind.encode(), hashlib.sha256).hexdigest()


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one candidate, or the candidate itself if it is not valid."""
    out = value
    for kind, pattern, image in reversed(KINDS):
        out = F.when(F.rlike(value, F.lit(f"^(?:{pattern})$")), image(value, subkey(key, kind))).otherwise(out)
    return out


def with_pseudonyms(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with the struct __pii: the new text and the number of values replaced."""
    text = F.col(column).cast("string")

    def run(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(FOUND), F.lit(0)), lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new")))
        gaps = F.split(t, FOUND, -1)
        joined = lambda m: F.array_join(F.transform(gaps, lambda g, i: F.concat(F.when(i > 0, F.element_at(m, F.greatest(i, F.lit(1)))["new"]).otherwise(F.lit("")), g)), "")
        changed = lambda m: F.size(F.filter(m, lambda x: x["old"] != x["new"]))
        return let(found, lambda m: F.struct(joined(m).alias("text"), changed(m).alias("n")))

    plain = F.struct(text.alias("text"), F.lit(0).alias("n"))
    return docs.withColumn("__pii", F.when(F.rlike(text, F.lit(HINT)), let(text, run)).otherwise(plain))


def key_of(docs: DataFrame) -> str:
    """The session's secret key; a run without one is refused, since anyone could invert its pseudonyms."""
    key = docs.sparkSession.conf.get(CONF, None)
    if not key:
        raise ValueError(f"set {CONF}")
    return key


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced of every row."""
    out = with_pseudonyms(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key_of(docs) if key is None else key)
    return out.select("doc_id", F.col("__pii.text").alias("text"), F.col("__pii.n").cast("long").alias("n_replaced"))


@carried
def in_place(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in its text; n_chars, where there is one, follows a text that changed."""
    out = with_pseudonyms(docs, key_of(docs) if key is None else key)
    columns = {"text": F.col("__pii.text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("__pii.n") > 0, F.length("__pii.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(columns).select(*docs.columns)
