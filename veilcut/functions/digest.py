"""Keyed digests as native expressions: HKDF on the driver, HMAC-SHA256 and its number stream in Catalyst.

A cell's digest is HMAC-SHA256(K_category, enc(tag) || enc(canonical)), each field with its length in front.  The HMAC is
written with sha2 over constant pads, so masking stays inside whole-stage code generation.  The stream after a
digest h is sha256(h || i) for i = 0, 1, ...; numbers are read as big-endian 64-bit words.  The bias of `word mod n`
is below n / 2**64 and is accepted.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

INFO = b"veilcut/v1/"
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def category_key(key: bytes, category: str) -> bytes:
    """HKDF-SHA256 (no salt), one block, with the category in the info."""
    extracted = hmac.new(b"\0" * 32, key, hashlib.sha256).digest()
    return hmac.new(extracted, INFO + category.encode() + b"\x01", hashlib.sha256).digest()


def key_fingerprint(key: bytes) -> str:
    return hashlib.sha256(key).hexdigest()[:8]


def pads(key: bytes) -> tuple[bytes, bytes]:
    block = key.ljust(64, b"\0") if len(key) <= 64 else hashlib.sha256(key).digest().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def sha256(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def hmac_sha256(key: bytes, message: Column) -> Column:
    inner, outer = pads(key)
    return sha256(F.concat(F.lit(outer), sha256(F.concat(F.lit(inner), message))))


def field(x: Column) -> Column:
    raw = F.encode(x, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 8, "0")), raw)


def digest(key: bytes, category: str, tag: str | Column, canonical: Column) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return hmac_sha256(category_key(key, category), F.concat(field(tag), field(canonical)))


def py_digest(key: bytes, category: str, tag: str, canonical: str) -> bytes:
    """The same digest in Python, for nested values."""
    enc = lambda s: len(s.encode()).to_bytes(4, "big") + s.encode()
    return hmac.new(category_key(key, category), enc(tag) + enc(canonical), hashlib.sha256).digest()


def constants(words: tuple[str, ...]) -> Column:
    """A constant array of strings: one literal, which Catalyst splits once (a literal a word would be slow to build and long in generated code)."""
    return F.split(F.lit("\x1f".join(words)), "\x1f")


class Bound:
    """A digest and its first block, both already computed (as columns of a table or variables of a lambda)."""

    def __init__(self, h: Column, first: Column):
        self.h, self.first = h, first


def block(h: Column, i: int) -> Column:
    return sha256(F.concat(h, F.lit(i.to_bytes(4, "big"))))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Stream:
    """Numbers drawn from a digest, each draw the next 64-bit word; draws of n <= 1 take no word."""

    def __init__(self, h: Column | Bound):
        self.h, self.first = (h.h, h.first) if isinstance(h, Bound) else (h, None)
        self.at = 0

    def block(self, i: int) -> Column:
        return self.first if i == 0 and self.first is not None else block(self.h, i)

    def below(self, n: int) -> Column:
        """The next word, a big-endian 64-bit number, modulo n (n < 2**31): by its halves, so that no decimals are needed."""
        if n <= 1:
            return F.lit(0)
        if n >= 1 << 31:
            raise ValueError("n must be below 2**31")
        i, k = divmod(self.at, 4)
        self.at += 1
        half = lambda at: F.conv(F.hex(F.substring(self.block(i), 1 + 8 * k + at, 4)), 16, 10).cast("long")
        return (half(0) % n * ((1 << 32) % n) + half(4)) % n

    def below_of(self, n: Column) -> Column:
        """The next word modulo a column n, 1 <= n < 2**31."""
        i, k = divmod(self.at, 4)
        self.at += 1
        half = lambda at: F.conv(F.hex(F.substring(self.block(i), 1 + 8 * k + at, 4)), 16, 10).cast("long")
        return (half(0) % n * (F.lit(1 << 32) % n) + half(4)) % n

    def pick(self, words: tuple[str, ...]) -> Column:
        return F.element_at(constants(tuple(words)), (self.below(len(words)) + 1).cast("int"))

    def digits(self, n: int, no_zero_first: bool = True) -> Column:
        return F.concat(*(((self.below(9) + 1) if i == 0 and no_zero_first else self.below(10)).cast("string") for i in range(n)))

    def base32(self, n: int) -> Column:
        return F.concat(*(F.substring(F.lit(BASE32), (self.below(32) + 1).cast("int"), 1) for _ in range(n)))

    def hexes(self, n: int) -> Column:
        return F.concat(*(F.lower(F.hex(self.below(16))) for _ in range(n)))


class PyStream:
    """The same stream in Python."""

    def __init__(self, h: bytes):
        self.h, self.at = h, 0

    def below(self, n: int) -> int:
        if n <= 1:
            return 0
        i, k = divmod(self.at, 4)
        self.at += 1
        return int.from_bytes(hashlib.sha256(self.h + i.to_bytes(4, "big")).digest()[8 * k : 8 * k + 8], "big") % n
