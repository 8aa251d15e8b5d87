"""Masking generators: a digest column and the input give the masked value; all are native expressions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .digest import Bound, Stream, block, let, sha256
from .words import AREAS, FILLER, GIVEN, HOSTS, STREET, SUFFIX, SURNAME

REDRAWS = 4


@dataclass(frozen=True)
class Limits:
    """What a column admits."""

    max_len: int | None = None
    labels: tuple[str, ...] = ()
    exact_len: int | None = None
    nullable: bool = True
    unique: bool = False
    role: str = "full"
    kind: str = "string"

    @property
    def numeric(self) -> bool:
        return self.kind.split("(")[0] in ("int", "bigint", "decimal")


def _fit(x: Column, limits: Limits) -> Column:
    return x if limits.max_len is None else F.substring(x, 1, limits.max_len)


#: Fewer names than these that fit a column would make persons alike.
LEAST_NAMES = 400


def names_that_fit(limits: Limits) -> list[tuple[str, int]]:
    """Of a full name: the given names that fit with a surname, each with how many (shortest first) surnames fit it."""
    most = limits.exact_len or limits.max_len
    by_length = sorted(SURNAME, key=lambda w: (len(w), w))
    out = [(g, sum(len(g) + 1 + len(w) <= most for w in by_length)) for g in GIVEN]
    return [(g, n) for g, n in out if n]


def person_name(h: Column, x: Column, limits: Limits) -> Column:
    """A name of the lists that fits the column whole; columns for fewer than LEAST_NAMES full names are refused by `room`."""
    s = Stream(h)
    most = limits.max_len
    if limits.role in ("given", "family"):
        words = GIVEN if limits.role == "given" else SURNAME
        return s.pick(tuple(w for w in words if most is None or len(w) <= most) or (words[0][:most],))
    if most is None or most >= max(map(len, GIVEN)) + 1 + max(map(len, SURNAME)):
        return F.concat_ws(" ", s.pick(GIVEN), s.pick(SURNAME))
    fit = names_that_fit(limits)
    at = (s.below(len(fit)) + 1).cast("int")
    given, count = (F.element_at(F.array(*(F.lit(f[k]) for f in fit)), at) for k in (0, 1))
    surname = F.element_at(F.array(*(F.lit(w) for w in sorted(SURNAME, key=lambda w: (len(w), w)))), (s.below_of(count.cast("long")) + 1).cast("int"))
    return F.concat_ws(" ", given, surname)


def room(masker: str, limits: Limits) -> str | None:
    """Why a masker has no room in a column, or None."""
    if masker == "person_name" and limits.max_len is not None and not limits.labels:
        if limits.role == "full" and sum(n for _, n in names_that_fit(limits)) < LEAST_NAMES:
            return f"fewer than {LEAST_NAMES} names fit"
        if limits.role != "full" and not any(len(w) <= limits.max_len for w in (GIVEN if limits.role == "given" else SURNAME)):
            return "no name fits"
    return None


def email(h: Column, x: Column, limits: Limits) -> Column:
    s = Stream(h)
    if limits.max_len is not None and limits.max_len < 32:
        return F.concat(s.base32(min(8, max(1, limits.max_len - 12))), F.lit("@example.com"))
    local = F.concat(F.lower(s.pick(GIVEN)), F.lit("."), F.lower(s.pick(SURNAME)))
    host = s.pick(HOSTS)
    return F.concat(local, F.lit("."), s.base32(13), F.lit("@"), host) if limits.unique else F.concat(local, F.lit("@"), host)


def phone(h: Column, x: Column, limits: Limits) -> Column:
    s = Stream(h)
    area, last = s.pick(AREAS), F.lpad(s.below(100).cast("string"), 2, "0")
    if limits.numeric or (limits.max_len is not None and limits.max_len < 15):
        return F.concat(F.lit("" if limits.max_len == 10 else "1"), area, F.lit("55501"), last)
    return F.concat(F.lit("+1 "), area, F.lit(" 555 01"), last)


def phone_unique(h: Column, x: Column, limits: Limits) -> Column:
    n = min(12, (limits.max_len or 14) - 2)
    return F.concat(F.lit("+1"), Stream(h).digits(n))


def address(h: Column, x: Column, limits: Limits) -> Column:
    s = Stream(h)
    if limits.max_len is not None and limits.max_len < 24:
        return s.base32(min(7, limits.max_len))
    return F.concat_ws(" ", (s.below(9000) + 1000).cast("string"), s.pick(STREET), s.pick(SUFFIX))


def geo(h: Column, x: Column, limits: Limits) -> Column:
    micro = Stream(h).below(180_000_001) - 90_000_000
    return F.format_string("%s%d.%06d", F.when(micro < 0, "-").otherwise(""), F.floor(F.abs(micro) / 1_000_000), F.abs(micro) % 1_000_000)


def person_date(h: Column, x: Column, limits: Limits) -> Column:
    """A day from 1940 to 2009; with a time of day in timestamps."""
    s = Stream(h)
    day = F.date_add(F.lit("1940-01-01").cast("date"), s.below(25_568).cast("int")).cast("string")
    if not limits.kind.startswith("timestamp"):
        return day
    at = s.below(86_400)
    return F.concat(day, F.format_string(" %02d:%02d:%02d", F.floor(at / 3600), F.floor(at / 60) % 60, at % 60))


def national_id(h: Column, x: Column, limits: Limits) -> Column:
    return Stream(h).digits(limits.exact_len or min(9, limits.max_len or 9))


def luhn_digit(body: Column) -> Column:
    """The check digit after a string of digits."""
    n = F.length(body)
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    digits = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 0, doubled(F.substring(body, i, F.lit(1)).cast("int"))).otherwise(F.substring(body, i, F.lit(1)).cast("int")))
    return ((10 - F.aggregate(digits, F.lit(0), lambda a, d: a + d) % 10) % 10).cast("string")


def financial_account(h: Column, x: Column, limits: Limits) -> Column:
    body = Stream(h).digits((limits.exact_len or min(16, limits.max_len or 16)) - 1)
    return F.concat(body, luhn_digit(body))


def network_id(h: Column, x: Column, limits: Limits) -> Column:
    """By shape of the input: documentation addresses of IPv4, IPv6 or MAC; a /n suffix becomes /32 or /128."""
    s = Stream(h)
    v4 = F.concat(s.pick(("192.0.2.", "198.51.100.", "203.0.113.")), s.below(256).cast("string"))
    t = Stream(h)
    v6 = F.concat(F.lit("2001:db8"), *(p for _ in range(6) for p in (F.lit(":"), F.lower(F.lpad(F.hex(t.below(65536)), 4, "0")))))
    mac = F.concat(F.lit("00:00:5e:00:53:"), F.lower(F.lpad(F.hex(Stream(h).below(256)), 2, "0")))
    cidr = F.contains(x, F.lit("/"))
    return (
        F.when(x.rlike(r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"), mac)
        .when(F.contains(x, F.lit(":")), F.concat(v6, F.when(cidr, "/128").otherwise("")))
        .otherwise(F.concat(v4, F.when(cidr, "/32").otherwise("")))
    )


def ip_unique(h: Column, x: Column, limits: Limits) -> Column:
    t = Stream(h)
    return F.concat(F.lit("2001:db8"), *(p for _ in range(6) for p in (F.lit(":"), F.lower(F.lpad(F.hex(t.below(65536)), 4, "0")))))


def online_id(h: Column, x: Column, limits: Limits) -> Column:
    """By shape of the input: a version 4 UUID, a URL below example.invalid, or a handle."""
    raw = F.lower(F.hex(F.substring(Stream(h).block(0), 1, 16)))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(raw, 17, 1), 16, 10).cast("int") % 4) + 1, 1)
    uuid = F.concat(F.substring(raw, 1, 8), F.lit("-"), F.substring(raw, 9, 4), F.lit("-4"), F.substring(raw, 14, 3), F.lit("-"), variant, F.substring(raw, 18, 3), F.lit("-"), F.substring(raw, 21, 12))
    s, t = Stream(h), Stream(h)
    url = F.concat(F.lit("https://example.invalid/"), t.base32(13))
    handle = F.concat(s.pick(FILLER), F.lit("_"), s.base32(13))
    return F.when(x.rlike(r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"), uuid).when(x.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), url).otherwise(_fit(handle, limits))


def credential(h: Column, x: Column, limits: Limits) -> Column:
    return _fit(F.lit("masked-credential"), limits)


def credential_unique(h: Column, x: Column, limits: Limits) -> Column:
    return _fit(F.concat(F.lit("veilcut-invalid-"), Stream(h).base32(13)), limits)


_LOOP = " ".join(FILLER) + " "
_STARTS = tuple(sum(len(w) + 1 for w in FILLER[:i]) + 1 for i in range(len(FILLER)))


def free_text(h: Column, x: Column, limits: Limits, most: int = 4096) -> Column:
    """Filler words from a drawn word on, round and round, up to the length of the input (at most 4,096 characters)."""
    n = F.lit(limits.exact_len) if limits.exact_len else F.least(F.length(x), F.lit(limits.max_len or most), F.lit(most))
    start = F.element_at(F.array(*(F.lit(s) for s in _STARTS)), (Stream(h).below(len(FILLER)) + 1).cast("int"))
    loop = F.concat(F.substring(F.lit(_LOOP), start, F.lit(len(_LOOP))), F.substring(F.lit(_LOOP), F.lit(1), start - 1))
    text = F.repeat(loop, (F.floor(n / len(_LOOP)) + 1).cast("int"))
    # no space at the end: it becomes the letter x, so the length stays
    return F.regexp_replace(F.substring(text, F.lit(1), n), " $", "x")


def special_category(h: Column, x: Column, limits: Limits) -> Column:
    return F.lit(limits.labels[0]) if limits.labels else null_value(h, x, limits)


#: What stands for nothing in a NOT NULL column, by type; '' for others.
ZERO = {"boolean": "false", "tinyint": "0", "smallint": "0", "int": "0", "bigint": "0", "decimal": "0", "float": "0", "double": "0", "date": "1970-01-01", "timestamp": "1970-01-01 00:00:00", "timestamp_ntz": "1970-01-01 00:00:00"}


def null_value(h: Column, x: Column, limits: Limits) -> Column:
    return F.lit(None).cast("string") if limits.nullable else F.lit(ZERO.get(limits.kind.split("(")[0], ""))


def derived_text(h: Column, x: Column, limits: Limits) -> Column:
    return F.lit("")


def closed(h: Column, x: Column, limits: Limits) -> Column:
    return Stream(h).pick(limits.labels)


Generator = Callable[["Column | Bound", Column, Limits], Column]
#: masker -> (category, generator, size of the set of outputs)
MASKERS: dict[str, tuple[str, Generator, int]] = {}


def register(name: str, category: str, generator: Generator, domain: int) -> None:
    """Add a masker; the extension point for categories of one's own."""
    MASKERS[name] = (category, generator, domain)


for _name, _category, _generator, _domain in (
    ("email", "email", email, len(GIVEN) * len(SURNAME) * len(HOSTS)),
    ("person_name", "person_name", person_name, len(GIVEN) * len(SURNAME)),
    ("phone", "phone", phone, len(AREAS) * 100),
    ("phone_unique", "phone", phone_unique, 9 * 10**11),
    ("address", "address", address, 9000 * len(STREET) * len(SUFFIX)),
    ("geo", "geo", geo, 180_000_001),
    ("person_date", "person_date", person_date, 25_568),
    ("national_id", "national_id", national_id, 9 * 10**8),
    ("financial_account", "financial_account", financial_account, 9 * 10**14),
    ("network_id", "network_id", network_id, 768),
    ("ip_unique", "network_id", ip_unique, 2**96),
    ("online_id", "online_id", online_id, 2**65),
    ("credential", "credential", credential, 1),
    ("credential_unique", "credential", credential_unique, 2**65),
    ("free_text", "free_text", free_text, len(FILLER)),
    ("special_category", "special_category", special_category, 1),
    ("null", "binary_personal", null_value, 1),
    ("derived_text", "derived_text", derived_text, 1),
):
    register(_name, _category, _generator, _domain)


#: Types besides text that a masker's values can be written to.
WRITES = {
    "phone": ("bigint", "decimal"), "phone_unique": ("bigint", "decimal"), "geo": ("double", "float", "decimal"), "person_date": ("date", "timestamp", "timestamp_ntz"),
    "national_id": ("int", "bigint", "decimal"), "financial_account": ("bigint", "decimal"), "credential": ("binary",), "null": tuple(ZERO) + ("binary",), "special_category": tuple(ZERO) + ("binary",),
}
TEXT = ("string", "varchar", "char")


def writable(masker: str, kind: str) -> bool:
    """Whether every value of a masker can be written to a column of a type (of an array, its elements)."""
    while kind.startswith("array<"):
        kind = kind[6:-1]
    base = kind.split("(")[0]
    if base in TEXT:
        return True
    if base != "decimal" or base not in WRITES.get(masker, ()):
        return base in WRITES.get(masker, ())
    precision, scale = (int(x) for x in kind[8:-1].split(","))
    digits = {"phone": 11, "phone_unique": 14, "geo": 2, "national_id": 9, "financial_account": 16}.get(masker, 1)
    return precision - scale >= digits


def required(n: int) -> int:
    """Least size of a masker's set of outputs for n distinct values that must stay distinct (odds of a clash of one in a million), at most int64."""
    return min(n * n * 500_000, 2**63 - 1)


def max_rows(domain: int) -> int:
    """The most distinct values a set of outputs can serve: the inverse of required."""
    n = int((domain / 500_000) ** 0.5)
    while required(n + 1) <= domain and required(n + 1) > required(n):
        n += 1
    while n and required(n) > domain:
        n -= 1
    return n


def small_domain(domain: int, distinct: int, is_closed: bool = False) -> bool:
    """Outputs so few that a masked value meeting a source value says nothing."""
    return is_closed or domain <= 64 or domain < 2 * distinct


def pick(category: str, unique: bool, distinct: int) -> str | None:
    """The masker of a category: the first that is large enough if values must stay distinct, else the first."""
    own = [(n, d) for n, (c, _, d) in MASKERS.items() if c == category]
    if category == "email" and unique:
        return "email"
    for name, domain in own:
        if not unique or domain >= required(distinct):
            return name
    return None


def echoes(name: str) -> bool:
    """Maskers that draw from a vocabulary, so that an output can be the input."""
    return name in ("person_name", "email", "address")


def generator(name: str, limits: Limits) -> Generator:
    return closed if limits.labels and name != "special_category" else MASKERS[name][1]


def again(h: Column, i: int) -> Column:
    """The digest of the i-th new draw."""
    return sha256(F.concat(h, F.lit(b"veilcut/redraw" + bytes([i]))))


def passed(x: Column, out: Column) -> Column:
    return F.when(x.isNull() | (x == ""), x).otherwise(out)


def masked(name: str, h: Column, x: Column, canonical: Column, limits: Limits = Limits()) -> Column:
    """The masked value: null and '' pass; vocabulary draws that echo the input are drawn again from a new digest."""
    make = generator(name, limits)

    def drawn(d: Column) -> Column:
        return let(block(d, 0), lambda first: make(Bound(d, first), x, limits))

    def redraw(d: Column, i: int):
        return lambda o: F.when(F.lower(o) == canonical, let(again(d, i), drawn)).otherwise(o)

    def draw(d: Column) -> Column:
        out = drawn(d)
        for i in range(1, REDRAWS if echoes(name) else 1):
            out = let(out, redraw(d, i))
        return out

    return passed(x, let(h, draw))
