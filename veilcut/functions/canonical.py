"""Canonical forms: what makes two spellings of a value one value, by category; (form, tag) columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def fold_ascii(x: Column) -> Column:
    """Case, runs of white space and outer white space away; equals `fold` on ASCII text."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


@F.pandas_udf(StringType())
def fold_unicode(x: pd.Series) -> pd.Series:
    """NFKC, case folding, white space collapsed."""
    return x.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split()))


def wide(x: Column) -> Column:
    """Whether a text holds more than ASCII."""
    return F.octet_length(x) > F.length(x)


def fold(x: Column) -> Column:
    """NFKC, case folding, white space collapsed: native for ASCII texts, through Arrow (where others go as null) for the rest."""
    return F.when(wide(x), fold_unicode(F.when(wide(x), x))).otherwise(fold_ascii(x))


def _low_bits_away(value: Column, keep: Column, width: int) -> Column:
    """An unsigned value of `width` bits with only its first `keep` bits left (keep is cut to 0..width)."""
    left = F.lit(width) - F.greatest(F.lit(0), F.least(F.lit(width), keep))
    step = F.pow(F.lit(2.0), left).cast("long")
    return F.floor(value / step).cast("long") * step


def ipv6(x: Column) -> Column:
    """An IPv6 address or network with all eight groups of four digits (host bits zero), zone away; null if it isn't one."""
    part = F.split(F.lower(x), "/")
    address, prefix = F.regexp_replace(part[0], "%.*$", ""), F.try_element_at(part, F.lit(2)).try_cast("int")
    octet = lambda i: F.regexp_extract(address, r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int")
    pair = lambda i: F.lower(F.hex(octet(i) * 256 + octet(i + 1)))
    address = F.when(F.contains(address, F.lit(".")), F.concat(F.regexp_replace(address, r"[0-9.]+$", ""), pair(1), F.lit(":"), pair(3))).otherwise(address)
    halves = F.split(address, "::")
    groups = lambda h: F.filter(F.split(h, ":"), lambda g: g != "")
    first, last = groups(halves[0]), F.coalesce(groups(F.try_element_at(halves, F.lit(2))), F.array().cast("array<string>"))
    short = F.size(halves) == 2
    every = F.concat(first, F.when(short, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(first) - F.size(last)))).otherwise(F.array().cast("array<string>")), last)
    value = lambda g, i: _low_bits_away(F.conv(g, 16, 10).cast("long"), F.coalesce(prefix, F.lit(128)) - 16 * i, 16)
    whole = F.array_join(F.transform(every, lambda g, i: F.lower(F.lpad(F.hex(value(g, i)), 4, "0"))), ":")
    fits = (F.size(every) == 8) & (F.size(halves) <= 2) & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    return F.when(fits, F.when(prefix.isNotNull(), F.concat(whole, F.lit("/"), prefix)).otherwise(whole))


def ipv4(x: Column) -> Column:
    """An IPv4 address or network without leading zeros (host bits zero); null if it isn't one."""
    part = F.split(x, "/")
    prefix = F.try_element_at(part, F.lit(2)).try_cast("int")
    octets = F.transform(F.split(part[0], r"\."), lambda o: o.try_cast("int"))
    kept = F.transform(octets, lambda o, i: _low_bits_away(o.cast("long"), F.coalesce(prefix, F.lit(32)) - 8 * i, 8).cast("string"))
    whole = F.array_join(kept, ".")
    fits = x.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?:/[0-9]{1,2})?$") & F.forall(octets, lambda o: o <= 255)
    return F.when(fits, F.when(prefix.isNotNull(), F.concat(whole, F.lit("/"), prefix)).otherwise(whole))


def phone(x: Column, region_code: str = "1") -> Column:
    """An approximation of E.164: + and digits; ten digits without + get the region's code."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.when(F.startswith(F.trim(x), F.lit("+")), F.concat(F.lit("+"), digits)).when(F.length(digits) == 10, F.concat(F.lit("+" + region_code), digits)).otherwise(F.regexp_replace(digits, "^0+", ""))


def alnum(x: Column) -> Column:
    """Upper-case letters and digits only; leading zeros of a number away."""
    bare = F.regexp_replace(F.upper(x), "[^0-9A-Z]", "")
    return F.when(bare.rlike("^0+$"), "0").when(bare.rlike("^[0-9]+$"), F.regexp_replace(bare, "^0+", "")).otherwise(bare)


def alnum_tag(x: Column) -> Column:
    return F.when(F.regexp_replace(F.upper(x), "[^0-9A-Z]", "").rlike("^[0-9]+$"), "decimal").otherwise("alnum")


#: Layouts of dates, tried in this order.
DATE_LAYOUTS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd")


def person_date(x: Column) -> Column:
    shaped = F.when((F.length(x) <= 40) & x.rlike(r"^[0-9]{1,4}[^0-9]|^[0-9]{8}$|^\p{L}"), x)  # years beyond four digits overflow the parser
    parsed = F.coalesce(*(F.try_to_timestamp(shaped, F.lit(p)) for p in DATE_LAYOUTS))
    day = F.date_format(parsed, "yyyy-MM-dd")
    whole = F.date_format(parsed, "HH:mm:ss") == "00:00:00"
    return F.coalesce(F.when(whole, day).otherwise(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss'Z'")), fold_ascii(x))


def geo(x: Column) -> Column:
    """Numbers as plain decimals with a digit after the point; those that 38 digits don't hold as Spark writes a double."""
    number, exact = x.try_cast("double"), x.cast("string").try_cast("decimal(38,18)")
    plain = F.regexp_replace(exact.cast("string"), r"(\.[0-9]+?)0+$", "$1")
    return F.coalesce(F.when(exact.cast("double") == number, plain), number.cast("string"), fold_ascii(x))


def network(x: Column) -> Column:
    """Addresses and networks of IPv4 and IPv6 in one spelling, MAC with colons, else folded."""
    mac = F.lower(F.regexp_replace(x, "-", ":"))
    is_mac = x.rlike(r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$")
    six = F.when(F.contains(x, F.lit(":")) & ~is_mac, x)
    return F.when(is_mac, mac).otherwise(F.coalesce(ipv6(six), ipv4(x), fold_ascii(x)))


def online(x: Column) -> Column:
    """A UUID without dashes; a URL with scheme and host in lower case, without a default port or a lone last slash; else folded."""
    uuid = F.lower(F.regexp_replace(x, "-", ""))
    trimmed = F.trim(x)
    head = F.lower(F.regexp_extract(trimmed, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.regexp_replace(F.regexp_replace(trimmed, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "^/$", "")
    is_url = trimmed.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+[^\s]*$")
    return F.when(x.rlike(r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"), uuid).when(is_url, F.concat(head, rest)).otherwise(fold_ascii(x))


def document(x: Column) -> Column:
    return F.coalesce(F.to_json(F.try_parse_json(x)), fold_ascii(x))


FORMS = {
    "phone": (phone, "e164"), "national_id": (alnum, None), "financial_account": (alnum, None), "person_date": (person_date, "date"), "geo": (geo, "number"),
    "network_id": (network, "network"), "online_id": (online, "online"), "semi_structured": (document, "json"),
}


def canonical(category: str, x: Column, unicode: bool = True) -> tuple[Column, str | Column]:
    """(canonical form, tag): the tag belongs to the form, so copies of a value in columns of different types mask alike.

    unicode: texts may hold more than ASCII; without it no Python runs, and only ASCII texts get their canonical form.
    """
    form, tag = FORMS.get(category, (fold if unicode else fold_ascii, "text"))
    return form(x), tag if tag is not None else alnum_tag(x)
