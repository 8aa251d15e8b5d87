"""Classification of columns from names, types and sampled values; runs on the driver over bounded samples."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.generators import pick
from ..functions.kinds import kind_of
from ..functions.validators import VALIDATORS
from ..model import Catalog, Confidence, Decision, Refusal
from .sampling import seeded_sample
from .verify import GENDERS, spellings

#: Validators in the order in which they are asked; the first with enough hits decides.
ORDER = (
    "email", "iban", "card_shape", "card", "ssn", "nino", "codice_fiscale", "dni", "nir", "pesel", "aadhaar", "bsn", "cpf", "sin", "tfn", "phone", "mac", "ip", "uuid", "url",
    "special", "name", "address", "prose", "secret", "national_digits", "two_letters",
)

#: (category, pattern over the normalised name, types that may hold it), by priority
TEXT = ("string", "varchar", "char")
RULES = (
    ("special_category", r"(?:^|_)(?:religion|ethnicity|race|gender_identity|sexual_orientation|diagnosis|disability|medical|blood_type|marital_status|union)(?:_|$)", TEXT),
    ("credential", r"(?:^|_)(?:password|passwd|pwd|secret|token|api_key|access_key|private_key|encrypted|otp|salt)(?:_|$)", TEXT + ("binary",)),
    ("national_id", r"(?:^|_)(?:ssn|national_id|tax_id|passport|nino|pesel|cpf|bsn|dni|aadhaar|sin_number|driver_licen[cs]e)(?:_|$)", TEXT + ("bigint", "int")),
    ("financial_account", r"(?:^|_)(?:iban|card_number|credit_card|account_number|bank_account|routing|sort_code)(?:_|$)", TEXT + ("bigint",)),
    ("email", r"(?:^|_)(?:e_?mail)(?:_|$)", TEXT),
    ("phone", r"(?:^|_)(?:phone|mobile|telephone|fax|msisdn|contact_number)(?:_|$)", TEXT + ("bigint",)),
    ("network_id", r"(?:^|_)(?:ip|ip_address|client_ip|remote_addr|mac|mac_address)(?:_|$)", TEXT),
    ("person_date", r"(?:^|_)(?:dob|birth|birthday|birth_date|date_of_birth|date_of_death)(?:_|$)", TEXT + ("date", "timestamp")),
    ("geo", r"(?:^|_)(?:lat|latitude|lng|lon|longitude|geo|coordinates)(?:_|$)", TEXT + ("double", "float", "decimal")),
    ("binary_personal", r"(?:^|_)(?:photo|avatar|fingerprint|signature|selfie)(?:_|$)", ("binary",)),
    ("address", r"(?:^|_)(?:address|street|addr|zip|zipcode|postal_code|postcode|city)(?:_|$)", TEXT),
    ("online_id", r"(?:^|_)(?:username|user_name|login|handle|screen_name|device_id|session_id|cookie)(?:_|$)", TEXT),
    ("person_name", r"(?:^|_)(?:first_name|last_name|given_name|family_name|surname|full_name|display_name|middle_name|contact_name)(?:_|$)", TEXT),
    ("bare_name", r"(?:^|[a-z]_)name$", TEXT),
    ("free_text", r"(?:^|_)(?:notes?|comments?|description|bio|message|remarks?)(?:_|$)", TEXT),
)
#: (pattern over the table's name, pattern over the column's, category): rules of single tables
TABLE_RULES = ((r"(?:^|_)(?:sessions?|logins?)$", r"^(?:data|payload)$", "credential"), (r"(?:^|_)(?:addresses|address)$", r"^(?:line_?[123]|name|region|state)$", "address"))
#: tables of log entries: their documents are emptied, not walked
LOG_TABLE = re.compile(r"(?:^|_)(?:logs?|audits?|audit_logs?|traces?|debug|requests?|webhooks?)$")
#: tables whose bare `name` column names people
PEOPLE = re.compile(r"(?:^|_)(?:customer|user|person|people|employee|contact|patient|member|author|staff)s?$")
STRONG, WEAK = 0.8, 0.5


def normalise(name: str) -> str:
    """snake_case of any spelling: camel humps, acronyms, digits and other signs become borders."""
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)
    return re.sub(r"[^a-z0-9]+", "_", s.lower()).strip("_")


def by_name(table: str, column: str, prefix: str = "") -> str | None:
    name = normalise(column)
    name = name[len(prefix) :] if prefix and name.startswith(prefix) else name
    for of_table, of_column, category in TABLE_RULES:
        if re.search(of_table, normalise(table)) and re.search(of_column, name):
            return category
    for category, pattern, _ in RULES:
        if re.search(pattern, name):
            if category != "bare_name":
                return category
            return "person_name" if PEOPLE.search(normalise(table)) else None
    return None


def accepts(category: str, kind: str) -> bool:
    while kind.startswith("array<"):
        kind = kind[6:-1]
    return any(kind.startswith(t) for c, _, types in RULES if c == category or (c == "bare_name" and category == "person_name") for t in types)


def by_values(hits: dict[str, tuple[int, int]], kind: str = "string") -> tuple[str | None, str]:
    """(category, strength) from {validator: (values, hits)}, in the declared ORDER; signals of categories that the type can't hold are silent."""
    best, strength = None, "none"
    for name in ORDER:
        n, k = hits.get(name, (0, 0))
        category, strong = VALIDATORS[name][1:]
        if not n or not k or not accepts(category, kind) or (category == "credential" and n < 5):
            continue
        if k / n >= STRONG:
            return category, "strong"
        if strong and n >= 3 and strength in ("none", "weak"):
            best, strength = "free_text", "some"
        elif k / n >= WEAK and best is None:
            best, strength = category, "weak"
    return best, strength


#: Reasons of decisions: templates without values, by which a reason can be read back.
REASONS = {
    "agree": "name and values agree", "special": "name of a special category", "other_values": "values of {category} under a name of {named}", "name": "name", "values": "values",
    "single": "single strong values", "some": "some values", "type": "name, but the type doesn't fit", "neighbour": "beside personal data", "unknown": "unknown text beside certain personal data",
    "refers": "refers to {table}.{column}", "same_name": "a column of this name holds personal data", "earlier": "earlier decision", "asked": "asked for", "document": "documents with leaves of {category}",
    "generated": "a generated column reads {category} from it", "none": "",
}


def reason(template: str, **names: str) -> str:
    return REASONS[template].format(**names)


def parse_reason(text: str) -> tuple[str, dict[str, str]] | None:
    """(template, names) of a reason; None for a text that no template gives."""
    for key, template in REASONS.items():
        pattern = re.sub(r"\\{(\w+)\\}", r"(?P<\1>[\\w ]+)", re.escape(template))
        if m := re.fullmatch(pattern, text):
            return key, m.groupdict()
    return None


def decide(named: str | None, fits: bool, valued: str | None, strength: str) -> tuple[str, Confidence, str]:
    """(category, confidence, reason) of what the name and the values say."""
    if named and fits:
        if named == "special_category" or (strength == "strong" and valued == named):
            return named, Confidence.CERTAIN, reason("agree" if valued else "special")
        if strength == "strong" and valued:
            return valued, Confidence.LIKELY, reason("other_values", category=valued, named=named)
        return named, Confidence.POSSIBLE, reason("name")
    if strength == "strong" and valued:
        return valued, Confidence.LIKELY, reason("values")
    if strength == "some":
        return "free_text", Confidence.POSSIBLE, reason("single")
    if strength == "weak" and valued:
        return valued, Confidence.LOW, reason("some")
    if named:
        return named, Confidence.LOW, reason("type")
    return "none", Confidence.NONE, reason("none")


def role(column: str) -> str:
    name = normalise(column)
    return "given" if re.search(r"(?:first|given|middle)_name", name) else "family" if re.search(r"(?:last|family|sur)_?name", name) else "full"


def samples(catalog: Catalog, frames: dict[str, DataFrame], size: int = 200) -> dict[str, list]:
    """At most `size` rows a table, seeded, of its keys and text or number columns; the only values that come to the driver."""
    out = {}
    for t in catalog.tables:
        key = t.primary_key or tuple(c.name for c in t.columns[:1])
        kinds = ("string", "varchar", "char", "bigint", "int")
        held = dict.fromkeys([*key, *(c.name for c in t.columns if c.type.split("(")[0] in (*kinds, "array<string>"))])
        out[t.name] = seeded_sample(frames[t.name].select(*(f"`{c}`" for c in held)), key, size).collect()
    return out


def _texts(value) -> list[str]:
    """A value as text; the elements of an array."""
    return [str(v) for v in (value if isinstance(value, list) else [value]) if v is not None]


def sample_hits(spark, sampled: dict[str, list], columns: dict[str, list[str]]) -> dict[tuple[str, str], dict[str, tuple[int, int]]]:
    """{(table, column): {validator: (values, hits)}} of the samples, in any spelling; one job for all tables."""
    rows = [(t, c, i, v) for t, cs in columns.items() for i, r in enumerate(sampled[t]) for c in cs for v in _texts(r[c])]
    if not rows:
        return {}
    df = spark.createDataFrame(rows, "t string, c string, i int, x string")
    each = df.select("t", "c", "i", F.explode(spellings(F.col("x"))).alias("x"))
    each = each.select("t", "c", "i", *(F.coalesce(VALIDATORS[v][0](F.col("x")), F.lit(False)).alias(v) for v in ORDER))
    found = each.groupBy("t", "c", "i").agg(*(F.bool_or(v).alias(v) for v in ORDER)).groupBy("t", "c").agg(F.count("*").alias("n"), *(F.count_if(v).alias(v) for v in ORDER))
    return {(r.t, r.c): {v: (r.n, r[v]) for v in ORDER} for r in found.collect()}


def classify(catalog: Catalog, frames: dict[str, DataFrame], prior: dict[tuple[str, str], Decision] | None = None, sample: int = 200, prefixes: dict[str, str] | None = None) -> list[Decision]:
    """Decisions for all columns: name and value rules, documents, neighbours, foreign keys, equal names, earlier decisions (which only tighten).

    An earlier opt-out (unmasked) holds while the column's fingerprint is the one it was given for.
    """
    out: dict[tuple[str, str], Decision] = {}
    keyed = {(f.child, c) for f in catalog.foreign_keys for c in f.child_columns} | {(f.parent, c) for f in catalog.foreign_keys for c in f.parent_columns}
    sampled = samples(catalog, frames, sample)
    spark = next(iter(frames.values())).sparkSession
    asked = {t.name: [c.name for c in t.columns if sampled[t.name] and c.name in sampled[t.name][0]] for t in catalog.tables}
    hits = sample_hits(spark, sampled, asked)
    values = {(t, c): [r[c] for r in sampled[t] if r[c] is not None] for t, cs in asked.items() for c in cs}
    for t in catalog.tables:
        for c in t.columns:
            named = by_name(t.name, c.name, (prefixes or {}).get(t.name, ""))
            valued, strength = by_values(hits.get((t.name, c.name), {}), c.type)
            category, confidence, why = decide(named, named is not None and accepts(named, c.type), valued, strength)
            leaves: tuple[tuple[str, str], ...] | None = None
            if c.type == "string" and (found := _documents(values.get((t.name, c.name), []))) is not None:
                if LOG_TABLE.search(normalise(t.name)):
                    leaves, category, confidence, why = (), "semi_structured", Confidence.POSSIBLE, reason("document", category="log entries")
                elif named and category not in ("none", "free_text"):  # a document under a telling name: all leaves are of its category
                    leaves = tuple((k, named) for k in sorted(found))
                    category, confidence, why = "semi_structured", Confidence.LIKELY, reason("document", category=named)
                elif any(v != "none" for v in found.values()):
                    leaves, category, confidence = tuple(sorted(found.items())), "semi_structured", Confidence.LIKELY
                    why = reason("document", category=min(v for v in found.values() if v != "none"))
                else:
                    leaves, category, confidence, why = tuple(sorted(found.items())), "none", Confidence.NONE, reason("none")
            never = c.generated is not None or t.framework or ((c.name in t.primary_key or (t.name, c.name) in keyed) and confidence.value < Confidence.POSSIBLE.value)
            out[t.name, c.name] = Decision(t.name, c.name, category, confidence, why, never=never, unique=(c.name,) == tuple(t.primary_key) or any(i.unique and i.columns == (c.name,) for i in t.indexes), role=role(c.name), leaves=leaves)
    _generated_leaves(catalog, out)
    _neighbours(catalog, out)
    _beside_certain(catalog, out, values)
    _along_keys(catalog, out)
    _same_names(catalog, out)
    _composite_unique(catalog, out)
    for at, d in out.items():
        old = (prior or {}).get(at)
        if old and old.confidence.value > d.confidence.value:
            d = replace(d, category=old.category, confidence=old.confidence, reason=reason("earlier"))
        if old and old.unmasked and old.fingerprint == catalog.table(d.table).column(d.column).fingerprint:
            d = replace(d, unmasked=True)
        if d.masked:
            d = replace(d, masker=d.category if d.category == "semi_structured" else pick(d.category, d.unique, catalog.table(d.table).rows or 0) or d.category)
        out[at] = d
    return [out[k] for k in sorted(out)]


def drift(catalog: Catalog, prior: dict[tuple[str, str], Decision], decisions: list[Decision]) -> list[str]:
    """Columns that an earlier record doesn't know, columns whose type it knew otherwise, and document keys that are new."""
    out = []
    for d in decisions:
        old = prior.get((d.table, d.column))
        if old is None:
            out.append(f"{d.table}.{d.column}: new")
        elif old.fingerprint and old.fingerprint != catalog.table(d.table).column(d.column).fingerprint:
            out.append(f"{d.table}.{d.column}: another type")
        elif old.leaves is not None:
            out += [f"{d.table}.{d.column}: new key {k}" for k, _ in d.leaves or () if k not in dict(old.leaves)]
    return sorted(out)


def _documents(values: list) -> dict[str, str] | None:
    """The leaf map of a column of JSON objects; None for other columns."""
    texts = [v for v in values if isinstance(v, str) and v]
    if not texts or sum(v.lstrip()[:1] == "{" for v in texts) < STRONG * len(texts):
        return None
    return leaf_map(texts)


_READS = re.compile(r"get_json_object\(\s*`?(\w+)`?\s*,\s*'\$\.(\w+)'\s*\)|`?(\w+)`?\s*->>?\s*'(\w+)'|`?(\w+)`?:(\w+)")


def _generated_leaves(catalog: Catalog, out: dict[tuple[str, str], Decision]) -> None:
    """A key of a document that a generated column reads takes that column's category."""
    for t in catalog.tables:
        for c in t.columns:
            if c.generated is None or (category := by_name(t.name, c.name)) is None:
                continue
            for m in _READS.finditer(c.generated):
                column, leaf = (x for x in m.groups() if x)
                d = out.get((t.name, column))
                if d is not None and d.leaves is not None:
                    leaves = tuple(sorted((dict(d.leaves) | {leaf: category}).items()))
                    out[t.name, column] = replace(d, category="semi_structured", confidence=max(d.confidence, Confidence.LIKELY, key=lambda x: x.value), leaves=leaves, reason=reason("generated", category=category))


def _neighbours(catalog: Catalog, out: dict[tuple[str, str], Decision]) -> None:
    """Beside a likely column, low ones become possible."""
    for t in catalog.tables:
        own = [out[t.name, c.name] for c in t.columns]
        if any(d.confidence.value >= Confidence.LIKELY.value for d in own):
            for d in own:
                if d.confidence is Confidence.LOW and not d.never:
                    out[d.table, d.column] = replace(d, confidence=Confidence.POSSIBLE, reason=reason("neighbour"))


_IDENTIFIER = re.compile(r"v?\d+\.\d+\.\d+(?:[-+][\w.-]+)?|\d{4}\.\d{1,2}\.\d{1,2}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}|(?:[.~]?/)?(?:[\w.-]+/)+[\w.-]*|/[\w.-]+|[\w-]+\.[a-z]{2,4}")
_TOKEN = re.compile(r"[A-Za-z0-9_. -]{1,40}")
_DATE = re.compile(r"\d{4}-\d\d-\d\d.*|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}")


def _spared(values: list) -> bool:
    """Whether sampled texts are identifiers of things, or an enumeration: few tokens, each repeated, none about a person."""
    texts = [str(v) for v in values]
    if texts and sum(bool(_IDENTIFIER.fullmatch(v)) for v in texts) >= STRONG * len(texts):
        return True
    count = Counter(texts)
    plain = all(_TOKEN.fullmatch(v) and not v.isdigit() and not _DATE.fullmatch(v) and v.lower() not in GENDERS for v in count)
    return len(texts) >= 10 and len(count) <= 20 and min(count.values()) >= 2 and plain


def _beside_certain(catalog: Catalog, out: dict[tuple[str, str], Decision], values: dict[tuple[str, str], list]) -> None:
    """Beside a certain personal column, text columns of which nothing is known become free text; keys, labelled and unique ones, identifiers and enumerations are spared."""
    keyed = {(f.child, c) for f in catalog.foreign_keys for c in f.child_columns} | {(f.parent, c) for f in catalog.foreign_keys for c in f.parent_columns}
    for t in catalog.tables:
        if not any(out[t.name, c.name].confidence is Confidence.CERTAIN for c in t.columns):
            continue
        unique = {i.columns[0] for i in t.indexes if i.unique and len(i.columns) == 1} | set(t.primary_key)
        for c in t.columns:
            d = out[t.name, c.name]
            if d.category == "none" and not d.never and c.type == "string" and not c.labels and c.name not in unique and (t.name, c.name) not in keyed and d.leaves is None and not _spared(values.get((t.name, c.name), [])):
                out[t.name, c.name] = replace(d, category="free_text", confidence=Confidence.POSSIBLE, reason=reason("unknown"))


def _composite_unique(catalog: Catalog, out: dict[tuple[str, str], Decision]) -> None:
    """Masked members of a composite unique key must stay distinct, unless a member that isn't masked keeps its rows apart."""
    for t in catalog.tables:
        for key in [t.primary_key, *(i.columns for i in t.indexes if i.unique)]:
            masked = [c for c in key if (t.name, c) in out and out[t.name, c].masked]
            if masked and len(masked) == len(key):
                for c in masked:
                    out[t.name, c] = replace(out[t.name, c], unique=True)


def _along_keys(catalog: Catalog, out: dict[tuple[str, str], Decision]) -> None:
    """A masked parent key masks the columns that refer to it, and those that refer to these; each column is set once.

    Refused: a column that refers to masked keys of different categories, and one whose type can't hold its parent's.
    """
    given: dict[tuple[str, str], tuple[str, str]] = {}
    problems: set[str] = set()
    todo = sorted((d.table, d.column) for d in out.values() if d.masked)
    while todo:
        at = todo.pop(0)
        b = out[at]
        for f in catalog.incoming(at[0]):
            for c, p in zip(f.child_columns, f.parent_columns):
                a = out[f.child, c]
                if p != at[1] or (f.child, c) == at or (a.masked and a.category == b.category):
                    continue
                if (f.child, c) in given:
                    problems.add(f"{f.child}.{c} refers to masked keys of {a.category} and {b.category}")
                elif not accepts(b.category, catalog.table(f.child).column(c).type):
                    problems.add(f"{f.child}.{c} refers to {at[0]}.{p}, but its type can't hold {b.category}")
                else:
                    given[f.child, c] = at
                    out[f.child, c] = replace(a, category=b.category, confidence=b.confidence, never=False, role=b.role, reason=reason("refers", table=at[0], column=p))
                    todo.append((f.child, c))
    if problems:
        raise Refusal(sorted(problems))


def _same_names(catalog: Catalog, out: dict[tuple[str, str], Decision]) -> None:
    """Columns of one normalised name share a category, at possible."""
    first: dict[str, Decision] = {}
    for d in list(out.values()):
        if d.masked and d.confidence.value >= Confidence.LIKELY.value:
            first.setdefault(normalise(d.column), d)
    for at, d in out.items():
        other = first.get(normalise(d.column))
        if other and not d.masked and not d.never and d.confidence.value < Confidence.POSSIBLE.value and other.table != d.table:
            out[at] = replace(d, category=other.category, confidence=Confidence.POSSIBLE, reason=reason("same_name"))


def leaf_map(documents: list[str]) -> dict[str, str]:
    """Key -> category (or none) of the leaves of sampled JSON documents, by the key's name and the shape of values (bounded by the sample)."""
    out: dict[str, str] = {}

    def visit(value) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                category = by_name("", k)
                if category is None and isinstance(v, str):
                    category = kind_of(v)
                if out.get(k, "none") == "none":
                    out[k] = category or "none"
                visit(v)
        elif isinstance(value, list):
            for v in value:
                visit(v)

    for d in documents:
        try:
            visit(json.loads(d))
        except (TypeError, ValueError, RecursionError):
            continue
    return out


def report(spark, decisions: list[Decision]) -> DataFrame:
    rows = [(d.table, d.column, d.category, d.confidence.name.lower(), d.masked, d.masker, d.reason) for d in decisions]
    return spark.createDataFrame(rows, "table_name string, column_name string, category string, confidence string, masked boolean, masker string, reason string")
