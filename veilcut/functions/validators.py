"""Validators of values as native boolean expressions over a string column."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .digest import constants
from .words import GIVEN, SURNAME

EMAIL = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+$"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
MAC = r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"
UUID = r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+[^\s]*$"
SEMVER = r"^v?[0-9]+\.[0-9]+\.[0-9]+(?:[-+][0-9A-Za-z.-]+)?$"
HEX_DIGEST = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
HOSTNAME = r"^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$"
SSN = r"^(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
NINO = r"^(?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{6}[A-D]$"
#: Prefix ranges of card issuers as (low, high, lengths), from the public issuer table.
CARDS = (
    ("34", "34", "15"), ("37", "37", "15"), ("5610", "5610", "16"), ("560221", "560225", "16"), ("31", "31", "19"), ("62", "62", "16-19"), ("30", "30", "14-19"), ("36", "36", "14-19"),
    ("38", "39", "14-19"), ("55", "55", "16"), ("6011", "6011", "16-19"), ("644", "649", "16-19"), ("65", "65", "16-19"), ("622126", "622925", "16-19"), ("60400100", "60420099", "16-19"),
    ("60", "60", "16"), ("65", "65", "16"), ("81", "82", "16"), ("508", "508", "16"), ("353", "353", "16"), ("356", "356", "16"), ("636", "636", "16-19"), ("637", "639", "16"),
    ("3528", "3589", "16-19"), ("357111", "357111", "16"), ("6304", "6304", "16-19"), ("6706", "6706", "16-19"), ("6709", "6709", "16-19"), ("6771", "6771", "16-19"), ("6759", "6759", "12-19"),
    ("676770", "676770", "12-19"), ("676774", "676774", "12-19"), ("5018", "5018", "12-19"), ("5020", "5020", "12-19"), ("5038", "5038", "12-19"), ("5893", "5893", "12-19"), ("6304", "6304", "12-19"),
    ("6759", "6759", "12-19"), ("6761", "6763", "12-19"), ("5019", "5019", "16"), ("4571", "4571", "16"), ("2200", "2204", "16-19"), ("2205", "2205", "16"), ("6054740", "6054744", "16"),
    ("2221", "2720", "16"), ("51", "55", "16"), ("6334", "6334", "16,18,19"), ("6767", "6767", "16,18,19"), ("4903", "4903", "16,18,19"), ("4905", "4905", "16,18,19"), ("4911", "4911", "16,18,19"),
    ("4936", "4936", "16,18,19"), ("564182", "564182", "16,18,19"), ("633110", "633110", "16,18,19"), ("6333", "6333", "16,18,19"), ("6759", "6759", "16,18,19"), ("65", "65", "16"), ("9792", "9792", "16"),
    ("4", "4", "13,16,19"), ("4026", "4026", "16"), ("417500", "417500", "16"), ("4844", "4844", "16"), ("4913", "4913", "16"), ("4917", "4917", "16"), ("1", "1", "15"), ("506099", "506198", "16,18,19"),
    ("650002", "650027", "16,18,19"), ("507865", "507964", "16,18,19"), ("8600", "8600", "16"), ("5614", "5614", "16"), ("9860", "9860", "16"), ("1946", "1946", "16,18,19"), ("50", "50", "16,18,19"),
    ("56", "56", "16,18,19"), ("58", "58", "16,18,19"), ("60", "63", "16,18,19"), ("9704", "9704", "16,19"), ("960046", "960046", "19"),
)
SPECIAL = ("religion", "catholic", "protestant", "muslim", "jewish", "hindu", "buddhist", "atheist", "ethnicity", "ethnic", "race", "diagnosis", "disability", "pregnant", "pregnancy", "hiv", "cancer", "diabetes", "depression", "gay", "lesbian", "bisexual", "transgender", "union member", "political party", "criminal record", "conviction", "biometric", "genetic")

bare = lambda x: F.regexp_replace(x, "[ ./ -]", "")


def email(x: Column) -> Column:
    return x.rlike(EMAIL) & (F.length(x) <= 320)


def phone(x: Column) -> Column:
    digits = F.length(F.regexp_replace(x, "[^0-9]", ""))
    return x.rlike(r"^\+[1-9][0-9 ().-]{6,}$") & digits.between(8, 15)


def ip(x: Column) -> Column:
    return x.rlike(IPV4) | x.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | (x.rlike(r"^[0-9A-Fa-f:]*::[0-9A-Fa-f:]*$") & (F.length(x) <= 39))


def luhn(x: Column) -> Column:
    return bare(x).rlike("^[0-9]{12,19}$") & F.call_function("luhn_check", bare(x))


def _range(low: str, high: str) -> str:
    """A regular expression for the numbers from low to high, both of one length."""
    if not low:
        return ""
    if low[0] == high[0]:
        return low[0] + _range(low[1:], high[1:])
    n = len(low) - 1
    parts = [low[0] + _range(low[1:], "9" * n)] if low[1:] != "0" * n else []
    first, last = int(low[0]) + bool(parts), int(high[0])
    tail = [high[0] + _range("0" * n, high[1:])] if high[1:] != "9" * n else []
    last -= bool(tail)
    middle = [(f"[{first}-{last}]" if first < last else str(first)) + (f"[0-9]{{{n}}}" if n else "")] if first <= last else []
    parts += middle + tail
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _sizes(lengths: str) -> tuple[int, ...]:
    low, _, high = lengths.partition("-")
    return tuple(range(int(low), int(high) + 1)) if high else tuple(int(x) for x in lengths.split(","))


def _issuers(exact: bool) -> str:
    """A regular expression for card numbers that begin like one of an issuer, and have one of its lengths if exact."""
    by_length: dict[tuple[int, ...], list[str]] = {}
    for low, high, lengths in CARDS:
        by_length.setdefault(_sizes(lengths) if exact else (), []).append(_range(low, high))
    ahead = lambda sizes: "(?=(?:" + "|".join(f"[0-9]{{{n}}}" for n in sizes) + ")$)" if sizes else ""
    return "^(?:" + "|".join(ahead(n) + "(?:" + "|".join(p) + ")" for n, p in by_length.items()) + ")"


def card(x: Column) -> Column:
    """Twelve to nineteen digits with a valid check digit that begin like an issuer's."""
    return luhn(x) & bare(x).rlike(_issuers(False))


def card_shape(x: Column) -> Column:
    """A card number of a length that its issuer has."""
    return luhn(x) & bare(x).rlike(_issuers(True))


def iban(x: Column) -> Column:
    s = F.upper(F.regexp_replace(x, " ", ""))
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    number = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (F.aggregate(F.split(turned, ""), F.lit(0), number) == 1)


def _weighted(x: Column, weights: tuple[int, ...]) -> Column:
    """Sum of digits times weights; null if x has no digit there."""
    out = F.lit(0)
    for i, w in enumerate(weights, 1):
        out = out + F.substring(x, i, 1).try_cast("int") * w
    return out


def _digit(x: Column, i: int) -> Column:
    return F.substring(x, i, 1).try_cast("int")


def _varied(x: Column) -> Column:
    return ~x.rlike(r"^(.)\1*$")


def pesel(x: Column) -> Column:
    return x.rlike("^[0-9]{11}$") & _varied(x) & ((10 - _weighted(x, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)) % 10) % 10 == _digit(x, 11))


def bsn(x: Column) -> Column:
    return x.rlike("^[0-9]{9}$") & _varied(x) & (F.pmod(_weighted(x, (9, 8, 7, 6, 5, 4, 3, 2, -1)), F.lit(11)) == 0)


def dni(x: Column) -> Column:
    s = F.upper(x)
    number = F.concat(F.translate(F.substring(s, 1, 1), "XYZ", "012"), F.substring(s, 2, 7)).try_cast("int")
    return s.rlike("^[0-9XYZ][0-9]{7}[A-Z]$") & (F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), number % 23 + 1, F.lit(1)) == F.substring(s, 9, 1))


def cpf(x: Column) -> Column:
    d = bare(x)
    check = lambda w: F.when(_weighted(d, w) * 10 % 11 == 10, 0).otherwise(_weighted(d, w) * 10 % 11)
    return d.rlike("^[0-9]{11}$") & _varied(d) & (check(tuple(range(10, 1, -1))) == _digit(d, 10)) & (check(tuple(range(11, 1, -1))) == _digit(d, 11))


def sin(x: Column) -> Column:
    d = bare(x)
    return d.rlike("^[0-9]{9}$") & _varied(d) & F.call_function("luhn_check", d)


def tfn(x: Column) -> Column:
    d = bare(x)
    return d.rlike("^[0-9]{9}$") & _varied(d) & (_weighted(d, (1, 4, 3, 7, 5, 8, 6, 9, 10)) % 11 == 0)


def nir(x: Column) -> Column:
    d = F.upper(bare(x))
    number = F.regexp_replace(F.regexp_replace(F.substring(d, 1, 13), "2A", "19"), "2B", "18").try_cast("decimal(20,0)")
    return d.rlike("^[1-478][0-9]{4}(?:[0-9]{2}|2A|2B)[0-9]{8}$") & (97 - number % 97 == F.substring(d, 14, 2).try_cast("int"))


#: Fixed tables of the Verhoeff check: the dihedral group D5 and its permutation.
_D5 = [[(a + b) % 5 if a < 5 and b < 5 else 5 + (a + b) % 5 if a < 5 else 5 + (a - b) % 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
_TURN = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def aadhaar(x: Column) -> Column:
    d = bare(x)
    table = constants(tuple(str(v) for row in _D5 for v in row)).cast("array<int>")
    power, c = list(range(10)), F.lit(0)
    for i in range(12):
        moved = F.element_at(constants(tuple(map(str, power))).cast("array<int>"), _digit(d, 12 - i) + 1)
        c = F.element_at(table, c * 10 + moved + 1)
        power = [_TURN[v] for v in power]
    shape = d.rlike("^[2-9][0-9]{11}$") & _varied(d)
    return F.when(shape, c == 0).otherwise(False)


def codice_fiscale(x: Column) -> Column:
    s = F.upper(x)
    #: fixed values of characters in odd places
    odd = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
    place = lambda c: F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    even = lambda c: F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 65)
    values = constants(tuple(map(str, odd))).cast("array<int>")
    total = F.lit(0)
    for i in range(1, 16):
        c = F.substring(s, i, 1)
        total = total + (F.element_at(values, place(c) + 1) if i % 2 else even(c))
    shape = s.rlike("^[A-Z]{6}[0-9LMNPQRSTUV]{2}[A-EHLMPRST][0-9LMNPQRSTUV]{2}[A-Z][0-9LMNPQRSTUV]{3}[A-Z]$")
    return F.when(shape, F.char(total % 26 + 65) == F.substring(s, 16, 1)).otherwise(False)


def entropy(x: Column) -> Column:
    """Shannon entropy of the characters, in bits a character."""
    chars = F.split(x, "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def secret(x: Column) -> Column:
    classes = sum((x.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]")), F.lit(0))
    plain = x.rlike(UUID) | x.rlike(URL) | x.rlike(SEMVER) | x.rlike(r"\s") | email(x)
    strong = F.when(x.rlike("^[0-9a-fA-F]{32,}$"), entropy(x) >= 3.0).otherwise((classes >= 2) & (entropy(x) >= 3.2))
    return F.when(F.length(x).between(16, 512) & ~plain, strong).otherwise(False)


def address(x: Column) -> Column:
    return (F.length(x) <= 200) & x.rlike("[0-9]") & (F.regexp_count(x, F.lit(r"[\p{L}]{2,}")) >= 2)


def two_letters(x: Column) -> Column:
    return x.rlike(r"^\p{L}{2}$")


_GIVEN, _SURNAME = (tuple(w.lower() for w in words) for words in (GIVEN, SURNAME))


def _in(words: tuple[str, ...]):
    known = constants(words)
    return lambda w: F.array_contains(known, w)


def _name_words(x: Column) -> Column:
    """The words of a value of at most 64 bytes that consists of one to three known names; else null."""
    words = F.filter(F.split(F.trim(F.lower(x)), r"[ \-'.,]+"), lambda w: w != "")
    return F.when((F.octet_length(F.trim(x)) <= 64) & F.size(words).between(1, 3) & F.forall(words, _in(_GIVEN + _SURNAME)), words)


def _given_then_surname(words: Column) -> Column:
    given, surname = _in(_GIVEN), _in(_SURNAME)
    return F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 1)), lambda i: F.coalesce(given(F.try_element_at(words, i)) & surname(F.try_element_at(words, i + 1)), F.lit(False)))


def names(x: Column) -> Column:
    """One to three known names and nothing else."""
    return F.coalesce(_name_words(x).isNotNull(), F.lit(False))


def name_shape(x: Column) -> Column:
    """Two or three known names and nothing else, a given name right before a surname among them."""
    return F.coalesce((F.size(_name_words(x)) >= 2) & _given_then_surname(_name_words(x)), F.lit(False))


def contains_name(x: Column) -> Column:
    """A known name of three letters or more as a word, or with a possessive ending."""
    words = F.split(F.lower(x), r"[^\p{L}']+")
    plain = F.transform(words, lambda w: F.regexp_replace(w, "('s|')$", ""))
    known = constants(tuple(w for w in dict.fromkeys(_GIVEN + _SURNAME) if len(w) >= 3))
    return F.coalesce(F.arrays_overlap(words, known) | F.arrays_overlap(plain, known), F.lit(False))


def prose(x: Column) -> Column:
    """Six words or more with a known name among them."""
    return (F.regexp_count(x, F.lit(r"\S+")) >= 6) & contains_name(x)


def prose_name(x: Column) -> Column:
    """Six words or more, a given name right before a surname among them, without the end of a clause between."""
    fields = F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")
    # a word that ends a clause keeps a mark, so it is no given name
    words = F.transform(fields, lambda w: F.concat(F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", ""), F.when(w.rlike("[.!?;:]$"), ".").otherwise("")))
    given, surname = _in(_GIVEN), _in(_SURNAME + tuple(w + "." for w in _SURNAME))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 1))
    pair = F.exists(at, lambda i: F.coalesce(given(F.try_element_at(words, i)) & surname(F.try_element_at(words, i + 1)), F.lit(False)))
    return F.coalesce((F.size(fields) >= 6) & pair, F.lit(False))


def national_id(x: Column) -> Column:
    """A number of any of the national forms."""
    every = (lambda v: v.rlike(SSN), lambda v: F.upper(v).rlike(NINO), pesel, codice_fiscale, bsn, dni, nir, cpf, sin, aadhaar, tfn)
    out = F.lit(False)
    for f in every:
        out = out | F.coalesce(f(x), F.lit(False))
    return out


def national_digits(x: Column) -> Column:
    """Bare digits that can be a national id: nine of a social security number, or eight of one without its leading zero that aren't a date; else national_id."""
    d = F.trim(x)
    dashed = lambda v: F.concat_ws("-", F.substring(v, 1, 3), F.substring(v, 4, 2), F.substring(v, 6, 4))
    day = F.try_to_date(F.when(d.rlike("^[0-9]{8}$"), d), "yyyyMMdd")
    is_date = F.coalesce(F.year(day).between(1900, 2099), F.lit(False))
    eight = d.rlike("^[0-9]{8}$") & ~is_date & dashed(F.concat(F.lit("0"), d)).rlike(SSN)
    return eight | (d.rlike("^[0-9]{9}$") & dashed(d).rlike(SSN)) | national_id(d)


def special(x: Column) -> Column:
    return x.rlike(r"(?i)\b(?:" + "|".join(SPECIAL) + r")\b")


def identifier(x: Column) -> Column:
    """Version, dotted date, digest, host name, path or file name: shapes that spare a value."""
    return x.rlike(SEMVER) | x.rlike(r"^[0-9]{4}[.][0-9]{1,2}[.][0-9]{1,2}$") | x.rlike(HEX_DIGEST) | x.rlike(HOSTNAME) | x.rlike(r"^(?:[.~]?/)?(?:[\w.-]+/)+[\w.-]*$") | x.rlike(r"^/[\w.-]+$") | x.rlike(r"^[\w-]+\.[a-z]{2,4}$")


_DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_WIDE = "".join(chr(0xFF01 + i) for i in range(94))  # full-width forms of the printable ASCII signs
_NARROW = "".join(chr(0x21 + i) for i in range(94))
#: A sign that a value may be another one's spelling.
ODD = r"(?i)[%<\[(\uFF01-\uFF5E]|\\u[0-9a-f]{4}|\bat\b|\bdot\b|^(?:mailto|tel|sms):|^[A-Za-z0-9+/]{8,}={0,2}$|\b(?:" + "|".join(_DIGIT_WORDS) + r"|oh)\b|[0-9] [0-9]"


def spoken_digits(x: Column) -> Column:
    """Digits spelled as words (double, treble, triple too) and digits in groups, run together."""
    word = "(" + "|".join((*_DIGIT_WORDS, "oh")) + ")"
    s = F.lower(x)
    s = F.regexp_replace(s, rf"\bdouble\s+{word}\b", "$1 $1")
    s = F.regexp_replace(s, rf"\b(?:treble|triple)\s+{word}\b", "$1 $1 $1")
    for i, w in enumerate((*_DIGIT_WORDS, "oh")):
        s = F.regexp_replace(s, rf"\b{w}\b", str(i % 10))
    return F.regexp_replace(s, r"(?<=[0-9+])[\s,-]+(?=[0-9])", "")


def candidates(x: Column) -> Column:
    """The value and its plain spellings: at and dot in words or brackets, angle brackets, schemes, percent, \\u and Base64 encodings, full-width signs, digits as words or in groups."""
    bracketed = lambda v, w, sign: F.regexp_replace(v, rf"(?i)\s*[\[({{<]\s*{w}\s*[\])}}>]\s*|\s+{w}\s+", sign)
    spelled = bracketed(bracketed(x, "at", "@"), "dot", ".")
    inside = F.regexp_extract(x, "<([^<>]+)>", 1)
    bare_scheme = F.regexp_replace(x, r"(?i)^(?:mailto|tel|sms):(?://)?", "")
    percent = F.when(F.contains(x, F.lit("%")), F.try_url_decode(x))
    escaped = F.when(x.rlike(r"\\u[0-9A-Fa-f]{4}"), F.get_json_object(F.concat(F.lit('{"v":"'), F.regexp_replace(x, '"', ""), F.lit('"}')), "$.v"))
    raw = F.when(x.rlike("^[A-Za-z0-9+/]{8,}={0,2}$") & (F.length(x) % 4 == 0), F.try_to_binary(x, F.lit("base64")))
    decoded = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    narrow = F.translate(x, _WIDE, _NARROW)
    digits = F.when(x.rlike("(?i)[0-9]|" + "|".join(_DIGIT_WORDS)), spoken_digits(x))
    return F.array_distinct(F.array_compact(F.array(x, spelled, F.nullif(inside, F.lit("")), bare_scheme, percent, escaped, decoded, narrow, digits)))


def any_spelling(valid: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A validator that takes a value in any of its spellings; only values with a sign of another spelling are tried again."""
    return lambda x: F.coalesce(valid(x), F.lit(False)) | F.when(x.rlike(ODD), F.exists(candidates(x), lambda c: F.coalesce(valid(c), F.lit(False)))).otherwise(False)


#: name -> (validator, category, strong: one hit counts)
VALIDATORS: dict[str, tuple[Callable[[Column], Column], str, bool]] = {
    "email": (email, "email", True), "card": (card, "financial_account", True), "card_shape": (card_shape, "financial_account", True), "iban": (iban, "financial_account", True), "ssn": (lambda x: x.rlike(SSN), "national_id", True),
    "nino": (lambda x: F.upper(x).rlike(NINO), "national_id", True), "pesel": (pesel, "national_id", False), "bsn": (bsn, "national_id", False), "dni": (dni, "national_id", True),
    "cpf": (cpf, "national_id", False), "sin": (sin, "national_id", False), "tfn": (tfn, "national_id", False), "nir": (nir, "national_id", True), "aadhaar": (aadhaar, "national_id", False),
    "codice_fiscale": (codice_fiscale, "national_id", True), "phone": (phone, "phone", True), "ip": (ip, "network_id", True), "mac": (lambda x: x.rlike(MAC), "network_id", True),
    "url": (lambda x: x.rlike(URL) & (F.length(x) <= 2048), "online_id", False), "uuid": (lambda x: x.rlike(UUID), "online_id", False), "secret": (secret, "credential", True),
    "special": (special, "special_category", True), "name": (names, "person_name", False), "address": (address, "address", False), "two_letters": (two_letters, "address", False),
    "name_shape": (name_shape, "person_name", False), "prose": (prose, "free_text", False), "prose_name": (prose_name, "free_text", False), "national_digits": (national_digits, "national_id", False),
}
