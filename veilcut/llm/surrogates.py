"""PII: keyed surrogates for detected entities.

1. Detect mentions in whole texts (pii_detect), once; the texts are written with them.
2. One table of entities by class and normal form: all mentions of a name, whatever its role, layout or case, are one
   entity, as are a phone number's national and international form.  A name's gender (or that it is a
   surname) is settled by its mentions over the whole corpus: the role seen most, ties by letter.
3. Each entity gets a surrogate of its class: an HMAC of key, class, form and attempt draws
   characters of the same class in the same places; checks (Luhn, IBAN) are made valid again, phone numbers keep
   the country code, addresses end in a reserved domain, names keep script and gender.
   Known names are permuted within their list by the key, so they stay distinct.
4. Collision checks on the table of entities: surrogates that two entities of a class share, or that equal another real
   entity, are drawn again with the next attempt (the least entity of a clash keeps its surrogate) until none are
   left.  Names of all roles are one class here, so a given name's surrogate is no other person's surname's.  Only
   a name that a permuted list gives may be another real name, which has a surrogate of its own.  A class that has no
   free form left (more entities than forms) is refused after ATTEMPTS rounds: a shared surrogate would join two persons.
5. Entities join their surrogates and texts that hold mentions are rewritten in the mention's own layout and case; other
   texts pass as they are, unshuffled.

The join of mentions and surrogates broadcasts the entities while they are few (shingle_join.FEW_ROWS), else adaptive
execution splits the mentions of an entity that a large part of the documents holds.

Defined cases: null text stays null, empty text empty; texts of any length are searched whole; a null id stays; repeated rows
each come out, alike; ties of a name's role go to the letter that comes first (f, m, s); an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, id_key, written
from .pii_detect import NAMES, detect, luhn, mod97
from .shingle_join import few

#: The key of the registered query only; the operator has no default.
DEMO_KEY = b"veilcut demonstration key"
ATTEMPTS = 50
_MENTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("canon", pa.string()), ("role", pa.string())])
_MENTIONS = "array<struct<start:int,end:int,kind:string,canon:string,role:string>>"


class Draw:
    """A stream of numbers from an HMAC."""

    def __init__(self, key: bytes, *parts: object):
        self.seed, self.at, self.pool = hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hashlib.sha256(self.seed + self.at.to_bytes(4, "big")).digest()
            self.at += 1
        x, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return x % n

    def like(self, c: str) -> str:
        """A character of the same class: digit, hexadecimal-free letter of the same case and script."""
        if c.isdigit() and c.isascii():
            return chr(48 + self.below(10))
        if "a" <= c <= "z" or "A" <= c <= "Z":
            return chr((97 if c.islower() else 65) + self.below(26))
        if "а" <= c <= "я":
            return chr(ord("а") + self.below(32))
        return c


_orders: dict[tuple, dict[str, str]] = {}


def _listed(key: bytes, script: str, cls: str) -> dict[str, str]:
    """A keyed permutation of a name list: one cycle, so no name stands for itself."""
    at = (key, script, cls)
    if at not in _orders:
        words = sorted(w.lower() for w in NAMES[script, cls])
        order = sorted(words, key=lambda w: hmac.new(key, f"{cls}\x1f{w}".encode(), hashlib.sha256).digest())
        _orders[at] = {w: order[(i + 1) % len(order)] for i, w in enumerate(order)}
    return _orders[at]


def _script(canon: str) -> str:
    return "cyrillic" if any("а" <= c <= "ё" for c in canon) else "latin"


def is_listed(canon: str, role: str) -> bool:
    return any(w.lower() == canon for w in NAMES[_script(canon), role])


def _name(key: bytes, canon: str, role: str, attempt: int) -> str:
    script = _script(canon)
    listed = _listed(key, script, role)
    if canon in listed and attempt == 0:
        return listed[canon]
    d = Draw(key, "name", canon, attempt)
    vowels, others = ("аеиоу", "бвгдклмнпрст") if script == "cyrillic" else ("aeiou", "bcdfghklmnprstvw")
    n, begin = max(len(canon), 4), d.below(2)
    name = "".join((vowels if (i + begin) % 2 else others)[d.below(len(vowels if (i + begin) % 2 else others))] for i in range(n))
    if role == "f":
        name = name[:-1] + ("а" if script == "cyrillic" else "a")
    return name


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0, role: str = "s") -> str:
    """The canonical form of the surrogate for an entity."""
    if kind == "name":
        return _name(key, canon, role, attempt)
    d = Draw(key, kind, canon, attempt)
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        tail = [labels[-2], labels[-1]] if labels[-2:] in (["example", "com"], ["example", "org"], ["example", "net"]) else ["example"]
        head = labels[: len(labels) - 2] if len(tail) == 2 else labels[:-1]
        return "".join(map(d.like, local)) + "@" + ".".join(["".join(map(d.like, x)) for x in head] + tail)
    if kind == "ip":
        a, *rest = canon.split(".")
        first = a if a in ("10", "127", "192", "172") else str(1 + d.below(223))
        if a == "192" and rest[0] == "168":
            return f"192.168.{d.below(256)}.{1 + d.below(254)}"
        if a == "172":
            return f"172.{rest[0]}.{d.below(256)}.{1 + d.below(254)}"
        return ".".join([first, str(d.below(256)), str(d.below(256)), str(1 + d.below(254))])
    if kind == "card":
        body = canon[0] + "".join(map(d.like, canon[1:-1]))
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))
    if kind == "iban":
        body = canon[:2] + "00" + "".join(map(d.like, canon[4:]))
        return f"{canon[:2]}{98 - mod97(body):02d}{body[4:]}"
    if kind == "ssn":
        return f"{1 + d.below(665):03d}{1 + d.below(99):02d}{1 + d.below(9999):04d}"
    if kind == "phone":
        plus, digits = canon[:1] == "+", canon.lstrip("+")
        keep = (1 if digits[0] in "17" else 2) if plus else 0
        out = digits[:keep] + "".join(str(2 + d.below(8)) if i == 0 or c != "0" and i == 3 else d.like(c) for i, c in enumerate(digits[keep:]))
        return ("+" if plus else "") + out
    if kind == "key":
        return canon[:4] + "".join(map(d.like, canon[4:]))
    if all(c in "0123456789abcdef" for c in canon):
        return "".join("0123456789abcdef"[d.below(16)] for _ in canon)
    return "".join(map(d.like, canon))


def render(mention: str, kind: str, value: str) -> str:
    """The surrogate in the layout and case of the mention."""
    if kind in ("card", "ssn", "phone", "iban"):
        # a national form has the last digits of the number
        chars = iter(value.lstrip("+")[-sum(map(str.isalnum, mention)) :])
        return "".join(next(chars) if c.isalnum() else c for c in mention)
    if kind == "name":
        return value.upper() if mention.isupper() else value.capitalize()
    return value.upper() if kind == "email" and mention.isupper() else value


def entities_of(each: DataFrame) -> DataFrame:
    """(kind, canon, role): the entities of mentions (kind, canon, role), the role that most mentions have."""
    votes = each.groupBy("kind", "canon", "role").agg(F.count("*").alias("n"))
    return votes.groupBy("kind", "canon").agg(F.min(F.struct((-F.col("n")).alias("n"), "role"))["role"].alias("role"))


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, surrogate) of distinct entities (kind, canon, role), without collisions."""

    @frugal
    def draw(batches):
        for b in batches:
            rows = [(k, c, r, n or int(k == "name" and not is_listed(c, r))) for k, c, r, n in zip(*(c.to_pylist() for c in b.columns))]
            rows = [(*r, surrogate(key, r[0], r[1], r[3], r[2])) for r in rows]
            columns = zip(*rows) if rows else [[]] * 5
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, types)], ["kind", "canon", "role", "attempt", "surrogate"])

    schema = "kind string, canon string, role string, attempt long, surrogate string"
    real = entities.select(F.col("kind").alias("k"), F.col("canon").alias("real"))
    drawn = entities.select("kind", "canon", "role", F.lit(0).cast("long").alias("attempt")).mapInArrow(draw, schema)
    for _ in range(ATTEMPTS):
        # a clash: another entity has the surrogate, or the surrogate is a real entity (but for listed names, which are permuted)
        owner = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("own"))
        j = drawn.join(owner, ["kind", "surrogate"]).join(real, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("real")), "left")
        taken = F.col("real").isNotNull() & ~((F.col("kind") == "name") & (F.col("attempt") == 0) & (F.col("surrogate") != F.col("canon")))
        j = j.select("kind", "canon", "role", "attempt", "surrogate", ((F.col("own.canon") != F.col("canon")) | taken).alias("clash"))
        j = written(j, "op3-clashes", small=True)
        again = j.where("clash")
        if again.isEmpty():
            return j.select("kind", "canon", "surrogate")
        fixed = j.where("not clash").drop("clash")
        drawn = fixed.unionByName(again.select("kind", "canon", "role", (F.col("attempt") + 1).alias("attempt")).mapInArrow(draw, schema))
    raise RuntimeError(f"surrogates still collide after {ATTEMPTS} attempts: a class has more entities than forms")


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text with surrogates, n_mentions, n_entities, kinds (array of the kinds found)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    @frugal
    def find(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                got = [[m._asdict() for m in detect(t)] if t else [] for t in part.column(1).to_pylist()]
                yield part.append_column("mentions", pa.array(got, pa.list_(_MENTION)))

    every = written(rows.mapInArrow(find, f"doc_id long, text string, mentions {_MENTIONS}"), "op3-mentions")
    held = every.where(F.size("mentions") > 0).withColumns({"at": id_key(), "th": F.xxhash64("text")})
    each = held.select("at", "th", F.explode("mentions").alias("m")).select("at", "th", "m.kind", "m.canon", "m.role")
    named = assign(written(entities_of(each), "op3-entities", small=True), key)
    owned = each.select("at", "th", "kind", "canon").distinct()
    map_of = owned.join(few(named), ["kind", "canon"]).groupBy("at", "th").agg(F.collect_list(F.struct("kind", "canon", "surrogate")).alias("names"))

    @frugal
    def rewrite(batches):
        for b in batches:
            ids, texts, counts, kinds, sizes = [], [], [], [], []
            for doc_id, text, found, names in zip(*(c.to_pylist() for c in b.columns)):
                table = {(n["kind"], n["canon"]): n["surrogate"] for n in names}
                out, at = [], 0
                for m in found:
                    out += [text[at : m["start"]], render(text[m["start"] : m["end"]], m["kind"], table[m["kind"], m["canon"]])]
                    at = m["end"]
                ids.append(doc_id)
                texts.append("".join(out) + text[at:])
                counts.append(len(found))
                sizes.append(len(table))
                kinds.append(sorted({m["kind"] for m in found}))
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(kinds, pa.list_(pa.string()))],
                ["doc_id", "text", "n_mentions", "n_entities", "kinds"],
            )

    schema = "doc_id long, text string, n_mentions long, n_entities long, kinds array<string>"
    changed = held.join(map_of, ["at", "th"]).select("doc_id", "text", "mentions", "names").mapInArrow(rewrite, schema)
    zero = F.lit(0).cast("long")
    same = every.where(F.size("mentions") == 0).select("doc_id", "text", zero.alias("n_mentions"), zero.alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return same.unionByName(changed)


def op3_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), DEMO_KEY)
