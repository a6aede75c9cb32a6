r"""Operator 1: format-preserving pseudonyms for personal data, in DataFrame functions only.

One pattern finds candidates; each is validated by kind (a Luhn sum, the IBAN
remainder, the areas, groups and serials that are issued, octets below 256, a real
calendar date) and replaced by the image of
a keyed permutation of its own format, so the same value has the same pseudonym
in every document, and different values of a kind have different ones:

* payment numbers of 13 to 19 digits with a right Luhn digit: all digits but the
  last are permuted, and the last is made anew; other numbers of that form (order
  numbers, times in milliseconds, ISBNs) stay byte for byte;
* IBANs of right remainder: the digits after the fourth character are permuted
  and the two check digits made anew;
* social security numbers: area (001 to 899 but 666), group (01 to 99) and serial
  (0001 to 9999), as three digits of bases 898, 99 and 9999, so that a pseudonym is
  a number that could be issued too;
* telephone numbers, which have no check digit: the pattern decides, the country
  code stays, the last ten digits are permuted;
* IPv4 addresses: the four octets;
* e-mail addresses: letters and digits of the local part, each within its class;
  the domain stays in clear text;
* hexadecimal secrets of 32 to 128 digits: digits of base 16;
* dates (YYYY-MM-DD, DD.MM.YYYY, DD/MM/YYYY) of the years 1700 to 2099, the 146,097
  days of a Gregorian cycle: the day's number, as two digits of bases 189 and 773.

The permutation is an alternating Feistel network on a mixed-radix number: its
digits fall into two halves, and each of ten rounds adds to the digits of one
half, modulo their bases, a keyed SHA-512 of the other. Every round is
invertible, so the whole is a permutation of the format whatever the bases.

It is a projection: no shuffle, no state, no Python on the executors. The key is
a literal of the plan: a session whose plans are logged should name it in
``spark.sql.redaction.string.regex``. Patterns
begin behind a look-behind and use possessive runs, so that a long run of
characters costs time in proportion to its length.

Cases: a null text stays null with no finds; an empty text stays empty;
candidates that no validation accepts stay as they are, but one that is no IBAN is
searched for the other kinds that it may hold; other columns are left
out by ``pseudonyms`` and kept by ``pseudonymise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 10

# The patterns of the kinds.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{10,14}(?![0-9])"
NUMBER = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
ANY = "|".join((EMAIL, IBAN, SECRET, IPV4, DATE, SSN, PHONE, NUMBER))
#: What a text must hold to have a candidate.
SOME = r"[0-9@]|[a-f]{32}|[A-F]{32}"
#: What may stand in a candidate that is no IBAN after all.
WITHIN = "|".join((SSN, PHONE, NUMBER))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _whole(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def permute(values: Column, bases: Column, key: str, tweak: str) -> Column:
    """The keyed permutation of an array of digits, each below its base; a digit of base 1 stays."""
    half = F.size(values).bitwiseAND(F.lit(-2)) / 2
    first = lambda i: i < half

    def round_(v: Column, r: Column) -> Column:
        odd = r % 2 == 1
        other = F.array_join(F.transform(v, lambda x, i: F.when(first(i) != odd, x.cast("string")).otherwise("")), ",")
        seed = F.concat(F.lit(f"{key}|{tweak}|"), r.cast("string"), F.lit("|"), F.size(v).cast("string"), F.lit("|"), other)
        # 32 numbers of 16 bits from each hash, and as many hashes as digits need: no number serves two of them.
        stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 32).cast("int")), lambda n: F.sha2(F.concat(seed, F.lit("|"), n.cast("string")), 512)), "")

        def add(s: Column) -> Column:
            return F.zip_with(
                F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                bases,
                lambda p, b: F.when(
                    (first(p["i"]) == odd) & (b > 1),
                    F.pmod(p["x"] + F.conv(F.substr(s, p["i"] * 4 + 1, F.lit(4)), 16, 10).cast("int"), b),
                ).otherwise(p["x"]),
            )

        return _let(stream, add)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), values, round_)


def _digits(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda c: c.cast("int"))


def _tens(values: Column) -> Column:
    return F.transform(values, lambda _: F.lit(10))


def _refill(text: Column, digits: Column) -> Column:
    """The text with its digits replaced in order."""
    at = lambda i: F.length(F.regexp_replace(F.substr(text, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.element_at(digits, at(i)).cast("string")).otherwise(c)), "")


def _luhn(payload: Column) -> Column:
    """The digit that completes a payload."""
    doubled = F.transform(F.reverse(payload), lambda d, i: F.when(i % 2 == 1, d).when(d >= 5, 2 * d - 9).otherwise(2 * d))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, d: a + d), F.lit(10))


def _number(text: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        payload = F.slice(d, F.lit(1), F.size(d) - 1)
        return _let(permute(payload, _tens(payload), key, "number"), lambda p: F.concat(p, F.array(_luhn(p))))

    return _let(_let(_digits(text), made), lambda d: _refill(text, d))


def _phone(text: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        bases = F.transform(d, lambda _, i: F.when(i < F.size(d) - 10, 1).otherwise(10))
        return permute(d, bases, key, "phone")

    return _let(_let(_digits(text), made), lambda d: _refill(text, d))


def _ssn_parts(text: Column) -> Column:
    """Area, group and serial."""
    return F.transform(F.split(text, "-"), lambda x: x.cast("int"))


def _ssn_valid(text: Column) -> Column:
    return _let(_ssn_parts(text), lambda p: p[0].between(1, 899) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0))


def _ssn(text: Column, key: str) -> Column:
    ranked = _let(_ssn_parts(text), lambda p: F.array(p[0] - F.when(p[0] > 666, 2).otherwise(1), p[1] - 1, p[2] - 1))
    moved = _let(ranked, lambda r: permute(r, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn"))
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return _let(moved, lambda m: F.concat_ws("-", padded(m[0] + F.when(m[0] >= 665, 2).otherwise(1), 3), padded(m[1] + 1, 2), padded(m[2] + 1, 4)))


def _octets(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda x: x.cast("int"))


def _ipv4(text: Column, key: str) -> Column:
    return F.array_join(_let(_octets(text), lambda o: permute(o, F.transform(o, lambda _: F.lit(256)), key, "ipv4")).cast("array<string>"), ".")


def _characters(text: Column, key: str, tweak: str) -> Column:
    """Digits and ASCII letters, each within its class; the classes themselves are part of the format."""
    code = lambda c: F.ascii(c)
    low = lambda c: F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[A-Z]$"), 65).when(c.rlike("^[a-z]$"), 97).otherwise(code(c))
    base = lambda c: F.when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), 26).otherwise(1)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")

    def made(chars: Column) -> Column:
        values, bases = F.transform(chars, lambda c: code(c) - low(c)), F.transform(chars, base)
        return F.array_join(F.zip_with(permute(values, bases, key, tweak), chars, lambda v, c: F.when(base(c) > 1, F.char(v + low(c))).otherwise(c)), "")

    return F.when(shape != "", _let(F.split(text, ""), made)).otherwise(text)


def _email(text: Column, key: str) -> Column:
    return F.concat(_characters(F.substring_index(text, "@", 1), key, "email"), F.lit("@"), F.substring_index(text, "@", -1))


def _secret(text: Column, key: str) -> Column:
    values = F.transform(F.split(F.lower(text), ""), lambda c: F.conv(c, 16, 10).cast("int"))
    hexed = F.array_join(F.transform(_let(values, lambda v: permute(v, F.transform(v, lambda _: F.lit(16)), key, "secret")), lambda x: F.lower(F.conv(x.cast("string"), 10, 16))), "")
    return F.when(text.rlike("[A-F]"), F.upper(hexed)).otherwise(hexed)


def _remainder(iban: Column) -> Column:
    """Modulo 97 of an IBAN without spaces: four characters go last, letters count from 10."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, " ", "")


def _iban(text: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        # The first two digits are the check digits: zero until the others are known.
        rest = F.slice(d, F.lit(3), F.size(d) - 2)
        return F.concat(F.array(F.lit(0), F.lit(0)), permute(rest, _tens(rest), key, "iban"))

    blank = _let(_let(_digits(text), made), lambda d: _refill(text, d))
    return _let(blank, lambda t: F.concat(F.substr(t, F.lit(1), F.lit(2)), F.lpad((98 - _remainder(_bare(t))).cast("string"), 2, "0"), F.substr(t, F.lit(5))))


_EPOCH, _LAST = "DATE'1700-01-01'", "DATE'2099-12-31'"
_FORMATS = {"-": "yyyy-MM-dd", ".": "dd.MM.yyyy", "/": "dd/MM/yyyy"}


def _day(text: Column) -> Column:
    """The date that is written, or null if there is none."""
    part = lambda i, n: F.substr(text, F.lit(i), F.lit(n)).cast("int")
    iso = F.substr(text, F.lit(5), F.lit(1)) == "-"
    year, month, day = (F.when(iso, part(*a)).otherwise(part(*b)) for a, b in (((1, 4), (7, 4)), ((6, 2), (4, 2)), ((9, 2), (1, 2))))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.when(month.isin(4, 6, 9, 11), 30).when((month == 2) & leap, 29).when(month == 2, 28).otherwise(31)
    real = month.between(1, 12) & day.between(1, last) & year.between(1700, 2099)
    return F.when(real, F.make_date(year, month, day))


def _date(text: Column, key: str) -> Column:
    n = F.datediff(_day(text), F.expr(_EPOCH))
    digits = F.array(F.floor(n / 773).cast("int"), (n % 773).cast("int"))
    moved = _let(_let(digits, lambda d: permute(d, F.array(F.lit(189), F.lit(773)), key, "date")), lambda d: F.date_add(F.expr(_EPOCH), d[0] * 773 + d[1]))
    return F.when(text.contains("-"), F.date_format(moved, _FORMATS["-"])).when(text.contains("."), F.date_format(moved, _FORMATS["."])).otherwise(F.date_format(moved, _FORMATS["/"]))


def _luhn_valid(text: Column) -> Column:
    return _let(_digits(text), lambda d: F.element_at(d, -1) == _luhn(F.slice(d, F.lit(1), F.size(d) - 1)))


def kind(text: Column) -> Column:
    """The kind of a candidate, or null if its validation fails."""
    return (
        F.when(text.contains("@"), F.lit("email"))
        .when(_whole(text, IPV4), F.when(F.forall(_octets(text), lambda o: o < 256), F.lit("ipv4")))
        .when(_whole(text, DATE), F.when(_day(text).isNotNull(), F.lit("date")))
        .when(_whole(text, SSN), F.when(_ssn_valid(text), F.lit("ssn")))
        .when(_whole(text, PHONE), F.lit("phone"))
        .when(_whole(text, NUMBER), F.when(_luhn_valid(text), F.lit("number")))
        .when(_whole(text, SECRET), F.lit("secret"))
        .when(_whole(text, IBAN), F.when(_remainder(_bare(text)) == 1, F.lit("iban")))
    )


def pseudonym(text: Column, kind_: Column, key: str) -> Column:
    return (
        F.when(kind_ == "email", _email(text, key))
        .when(kind_ == "ipv4", _ipv4(text, key))
        .when(kind_ == "date", _date(text, key))
        .when(kind_ == "ssn", _ssn(text, key))
        .when(kind_ == "phone", _phone(text, key))
        .when(kind_ == "number", _number(text, key))
        .when(kind_ == "secret", _secret(text, key))
        .when(kind_ == "iban", _iban(text, key))
        .otherwise(text)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", finds_col: str = "finds") -> DataFrame:
    """The table with its text pseudonymised and ``finds_col``, an array of (kind, pseudonym) in order."""
    text = F.col(text_col)
    found = F.when(text.rlike(SOME), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    between = F.split(text, ANY, -1)
    pair = lambda gap, candidate: F.struct(gap.alias("gap"), candidate.alias("candidate"))
    # A candidate that is no IBAN makes way for what it holds of other kinds; an empty one stands for none.
    failed = lambda m: _whole(m, IBAN) & ~_whole(m, SECRET) & (_remainder(_bare(m)) != 1)
    within = lambda m: F.zip_with(F.split(m, WITHIN, -1), F.concat(F.regexp_extract_all(m, F.lit(WITHIN), F.lit(0)), F.array(F.lit(""))), pair)
    parts = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, m: F.when(failed(m), F.concat(F.array(pair(gap, F.lit(""))), within(m))).otherwise(F.array(pair(gap, m))))
    out = docs.withColumn("_parts", F.when(F.size(found) > 0, F.flatten(parts)))
    replaced = F.transform(F.col("_parts.candidate"), lambda m: _let(kind(m), lambda k: F.struct(k.alias("kind"), pseudonym(m, k, key).alias("pseudonym"))))
    out = out.withColumn("_found", replaced)
    joined = F.array_join(F.zip_with("_parts", "_found", lambda a, b: F.concat(a["gap"], b["pseudonym"])), "")
    out = out.withColumn(text_col, F.when(F.col("_parts").isNotNull(), F.concat(joined, F.element_at(between, -1))).otherwise(text))
    finds = F.filter(F.coalesce(F.col("_found"), F.array()), lambda x: x["kind"].isNotNull())
    return out.withColumn(finds_col, finds).drop("_found", "_parts")


def pseudonyms(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text (pseudonymised), finds, n_finds."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return pseudonymise(rows, key).withColumn("n_finds", F.size("finds").cast("long"))
