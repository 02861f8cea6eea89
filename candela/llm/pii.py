"""Format-preserving pseudonyms of personal data, with DataFrame functions only.

One pattern finds candidates; what validates (Luhn and IBAN check digits, real dates, octets) is replaced by a keyed
Feistel permutation within its own format: digits stay digits and letters stay letters of their case, separators stay,
check digits are made valid again, dates stay dates and addresses stay addresses. Equal values have equal pseudonyms in
all documents, and different values different ones. Kinds:

- e-mail addresses (all but the last domain label), phone and social-security numbers (a leading country code stays),
  cloud access keys, hexadecimal tokens and what follows password=, API_KEY: and the like: characters, by class
- card numbers of 13 to 19 digits with a valid Luhn digit: all other digits, then a new Luhn digit
- IBANs with valid check digits: the account part, then new check digits
- dates of 1900 to 2099 (2024-05-17, 17.05.2024, 17/05/2024): the day's number, among all days of these years
- IPv4 addresses: as 32-bit numbers
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The session's setting that holds the key, and the key of demonstrations and tests, which hides nothing and which callers have to ask for.
KEY_SETTING = "spark.candela.pseudonyms.key"
DEMONSTRATION_KEY = "a key that everybody knows"
ROUNDS = 8
# Fixed patterns, in the order in which they are tried at a place.
# Where a part may be long it is bounded and begins at a word's start, so a long text is searched in linear time.
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
SECRET_NAME = r"(?i:(?:[a-z0-9]{1,20}[_-]){0,4}(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))"
SECRET = r"(?<![A-Za-z0-9_-])" + SECRET_NAME + r"[\"']?\s*[=:]\s*[\"']?[A-Za-z0-9_\-/+=.!@#$%^&*~]{6,}"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})(?![0-9])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
HEX = r"(?<![A-Za-z0-9])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,64}(?![A-Za-z0-9])"
CANDIDATE = "|".join((EMAIL, SECRET, ACCESS_KEY, IBAN, IPV4, DATE, SSN, CARD, PHONE, HEX))
FIRST_DAY, DAYS = "1900-01-01", 73_049  # to 2099-12-31
DAY_RADICES = (17, 4297)  # their product is DAYS


def _rounds(start: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def key_of(spark: SparkSession, otherwise: str | None = None) -> str:
    """The session's key, or (unset) the one that the caller names; without either there are no pseudonyms to give."""
    key = spark.conf.get(KEY_SETTING, otherwise or "")
    if not key:
        raise ValueError(f"{KEY_SETTING} is not set")
    return key


def subkey(key: str, kind: str) -> str:
    """The key of one kind of values; plans and logs show these only."""
    return hashlib.sha256(f"{key}:{kind}".encode()).hexdigest()


def _digest(own: str, number: Column, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{own}:"), number.cast("string"), F.lit(":"), value), 256)


def permuted_number(x: Column, radices: tuple[int, int], own: str) -> Column:
    """A permutation, keyed by `own`, of the numbers under the product of the radices: a Feistel network on the two
    places."""
    a, b = radices

    def f(number: Column, value: Column, radix: int) -> Column:
        return F.conv(F.substring(_digest(own, number, value.cast("string")), 1, 14), 16, 10).cast("long") % radix

    def step(acc: Column, k: Column) -> Column:
        odd = k % 2 == 1
        left = F.when(odd, (acc["left"] + f(k, acc["right"], a)) % a).otherwise(acc["left"])
        right = F.when(odd, acc["right"]).otherwise((acc["right"] + f(k, acc["left"], b)) % b)
        return F.struct(left.alias("left"), right.alias("right"))

    x = x.cast("long")
    start = F.struct(F.floor(x / b).cast("long").alias("left"), (x % b).alias("right"))
    return F.transform(F.array(_rounds(start, step)), lambda s: s["left"] * b + s["right"])[0]


def _shifted(text: Column, stream: Column, letters: int) -> Column:
    """Each letter and digit moved within its class by the stream's number for its place."""

    def moved(c: Column, j: Column) -> Column:
        by, code = F.conv(F.substr(stream, (j % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int"), F.ascii(c)
        within = lambda first, n: F.char((F.lit(first) + (code - first + by) % n).cast("long"))
        return F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, letters)).when(c.between("A", "Z"), within(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), moved), "")


def permuted_text(text: Column, own: str, letters: int = 26) -> Column:
    """A keyed permutation of the texts with the same character classes in the same places: a Feistel network on the
    two halves. letters: how many lower-case letters there are (6 for hexadecimal digits)."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1, F.length(text)).alias("b"))

    def step(acc: Column, k: Column) -> Column:
        return F.struct(acc["b"].alias("a"), _shifted(acc["a"], _digest(own, k, acc["b"]), letters).alias("b"))

    return F.transform(F.array(_rounds(start, step)), lambda s: F.concat(s["a"], s["b"]))[0]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _refilled(form: Column, symbols: Column) -> Column:
    """The form with its letters and digits replaced, in order, by those of `symbols`."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    filled = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(acc["out"], F.substr(symbols, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
        lambda acc: acc["out"],
    )
    return filled


def _card(m: Column, key: str) -> Column:
    def renewed(digits: Column) -> Column:
        body = permuted_text(F.substr(digits, F.lit(1), F.length(digits) - 1), subkey(key, "card"))
        return _let(body, lambda p: F.concat(p, F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: F.call_function("luhn_check", F.concat(p, d)))[0]))

    return _let(F.regexp_replace(m, "[^0-9]", ""), lambda d: F.when(F.call_function("luhn_check", d), _refilled(m, renewed(d))).otherwise(m))


def _mod97(text: Column) -> Column:
    """The number that a text of digits and letters (A = 10 to Z = 35) stands for, modulo 97."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: str) -> Column:
    def renewed(plain: Column) -> Column:
        country, account = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.length(plain))
        return _let(permuted_text(account, subkey(key, "iban")), lambda p: F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(p, country, F.lit("00")))).cast("string"), 2, "0"), p))

    valid = lambda plain: _mod97(F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))) == 1
    return _let(F.regexp_replace(m, " ", ""), lambda plain: F.when(valid(plain), _refilled(m, renewed(plain))).otherwise(m))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
    dotted = lambda n: F.concat_ws(".", *(F.floor(n / 256**k).cast("long").bitwiseAND(F.lit(255)).cast("string") for k in (3, 2, 1, 0)))
    return F.when(F.forall(octets, lambda x: x < 256), _let(permuted_number(number, (65536, 65536), subkey(key, "ipv4")), dotted)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    day = F.when(iso, F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(F.regexp_replace(m, "/", "."), F.lit("d.M.yyyy"))).cast("date")
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))

    def told(n: Column) -> Column:
        d = F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
        wide = m.rlike("^[0-9]{2}[./][0-9]{2}")
        dotted = F.when(wide, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "d.M.yyyy"))
        return F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(m.contains("/"), F.regexp_replace(dotted, r"\.", "/")).otherwise(dotted)

    return _let(number, lambda n: F.when(n.between(0, DAYS - 1), _let(permuted_number(n, DAY_RADICES, subkey(key, "date")), told)).otherwise(m))


def _after(m: Column, lead: str, use: Callable[[Column], Column]) -> Column:
    """The match with what follows its leading pattern changed."""
    return _let(F.regexp_extract(m, lead, 0), lambda head: F.concat(head, use(F.substr(m, F.length(head) + 1, F.length(m)))))


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate, or the candidate if it doesn't validate."""
    kept = lambda x, kind, letters=26: permuted_text(x, subkey(key, kind), letters)
    email = _let(F.regexp_extract(m, r"\.[A-Za-z]+$", 0), lambda tail: F.concat(kept(F.substr(m, F.lit(1), F.length(m) - F.length(tail)), "email"), tail))
    named = "^" + SECRET_NAME + r"[\"']?\s*[=:]\s*[\"']?"
    return (
        F.when(m.rlike(named), _after(m, named, lambda x: F.when(x.rlike("^[0-9a-f]+$"), kept(x, "hex", 6)).otherwise(kept(x, "secret"))))
        .when(m.contains("@"), email)
        .when(m.rlike("^AKIA[0-9A-Z]{16}$"), _after(m, "^AKIA", lambda x: kept(x, "access")))
        .when(m.rlike("^[A-Z]{2}[0-9]{2}"), _iban(m, key))
        .when(m.rlike(_whole(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}")), _ip(m, key))
        .when(m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})$"), _date(m, key))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), kept(m, "ssn"))
        .when(m.rlike(_whole("[0-9](?:[ -]?[0-9]){12,18}")), _card(m, key))
        .when(m.rlike("^[0-9a-f]{16,64}$"), kept(m, "hex", 6))
        .otherwise(_after(m, r"^(?:\+[0-9]{1,3}(?=[ .(-]))?", lambda x: kept(x, "phone")))
    )


def pseudonymised(text: Column, key: str) -> Column:
    """A text with all validated candidates replaced; a null text stays null."""
    pattern = F.lit(CANDIDATE)
    names = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: pseudonym(m, key))
    # the text between the candidates has one part more than there are candidates
    joined = F.array_join(F.zip_with(F.split(text, CANDIDATE, -1), names, lambda part, name: F.concat(part, F.coalesce(name, F.lit("")))), "")
    return F.when(text.rlike("[0-9@=:]") & text.rlike(CANDIDATE), joined).otherwise(text)


def with_pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """The documents, all columns, with pseudonyms under a secret key in their text. Who knows the key can undo them.

    Null texts stay null and empty ones empty; repeated rows stay and get equal texts; texts of any length are searched
    whole; n_chars, where there is one, is kept as it was (pseudonyms of IP addresses and dates may differ in length);
    an empty table gives an empty result.
    """
    return docs.withColumn("text", pseudonymised(docs["text"], key))
