"""The category of a single value by its shape, in Python: for leaves and keys of documents."""

from __future__ import annotations

import ipaddress
import re

_EMAIL = re.compile(r"[^\s@<>]+@[^\s@<>.]+(?:\.[^\s@<>.]+)+")
_PHONE = re.compile(r"\+[1-9][0-9 ().-]{6,}")
_SSN = re.compile(r"(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}")
_MAC = re.compile(r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+\S*")
_IBAN = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}")
_SECRET = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|eyJ[\w-]+\.eyJ[\w-]+\.[\w-]+")


def luhn_digit_of(body: str) -> str:
    total = sum(d if i % 2 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def kind_of(value: str) -> str | None:
    """email, phone, financial_account, national_id, network_id, credential or online_id; None for other shapes."""
    v = value.strip()
    if not 6 <= len(v) <= 512:
        return None
    if "@" in v and _EMAIL.fullmatch(v):
        return "email"
    if v[0] == "+" and _PHONE.fullmatch(v) and 8 <= sum(c.isdigit() for c in v) <= 15:
        return "phone"
    bare = re.sub(r"[ ./\u00a0-]", "", v)
    if bare.isascii() and bare.isdigit() and 12 <= len(bare) <= 19 and luhn_digit_of(bare[:-1]) == bare[-1]:
        return "financial_account"
    iban = v.replace(" ", "").upper()
    if _IBAN.fullmatch(iban) and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1:
        return "financial_account"
    if _SSN.fullmatch(v):
        return "national_id"
    if _SECRET.fullmatch(v):
        return "credential"
    if _MAC.fullmatch(v):
        return "network_id"
    if ":" in v or v.count(".") == 3:
        try:
            ipaddress.ip_interface(v)
            return "network_id"
        except ValueError:
            pass
    return "online_id" if _UUID.fullmatch(v) or len(v) <= 2048 and _URL.fullmatch(v) else None
