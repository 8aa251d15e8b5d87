"""Checks of the catalog itself: personal data in literals, calls that a target can't follow, composite columns, plan sizes."""

from __future__ import annotations

import re

from ..functions.domain import tokens
from ..functions.kinds import kind_of
from ..model import Catalog, Decision, Step

#: Functions that defaults, checks and generated columns may call.
KNOWN_CALLS = frozenset("now current_timestamp current_date lower upper length char_length coalesce nullif concat substring trim date_trunc round abs least greatest uuid nextval md5 cast any in and or not array".split())


def literals(text: str) -> list[str]:
    """The string constants of an expression."""
    return [v for k, v in tokens(text) if k == "string"]


def calls(text: str) -> list[str]:
    """The names before an opening parenthesis."""
    found = tokens(text)
    return [v for (k, v), after in zip(found, found[1:]) if k in ("word", "name") and after == ("sign", "(")]


def literal_hits(catalog: Catalog) -> list[tuple[str, str, str, str]]:
    """(table, column, place, kind) of defaults, checks, labels and generated expressions that hold personal data; no values.

    URLs and UUIDs are no sign of a person here, nor are the addresses that stand for no host.
    """
    out = []
    for t in catalog.tables:
        for c in t.columns:
            texts = [("default", x) for x in literals(c.default or "")] + [("check", x) for k in c.checks for x in literals(k)]
            texts += [("label", x) for x in c.labels] + [("generated", x) for x in literals(c.generated or "")]
            found = [(place, kind_of(x)) for place, x in texts if x not in ("127.0.0.1", "0.0.0.0", "::1", "::")]
            out += [(t.name, c.name, place, kind) for place, kind in found if kind not in (None, "online_id")]
    return sorted(set(out))


def unknown_calls(catalog: Catalog) -> list[tuple[str, str, str]]:
    """(table, column, function) of expressions that call a function which isn't recreated."""
    out = []
    for t in catalog.tables:
        for c in t.columns:
            for text in (c.default or "", c.generated or "", *c.checks):
                out += [(t.name, c.name, f) for f in calls(text) if f.lower() not in KNOWN_CALLS]
    return sorted(set(out))


def composite_documents(catalog: Catalog) -> list[tuple[str, str]]:
    """Columns of struct type that hold a map or a document: they can't be masked leaf by leaf and are refused when personal."""
    return sorted((t.name, c.name) for t in catalog.tables for c in t.columns if c.type.startswith("struct") and re.search(r"\b(?:map|variant|json)", c.type))


def key_pair_conflicts(catalog: Catalog, decisions: list[Decision]) -> list[str]:
    """Edges with a masked end and an end that stays as it is: their values would no longer meet."""
    masked = {(d.table, d.column): d.category for d in decisions if d.masked}
    out = []
    for f in catalog.foreign_keys:
        for c, p in zip(f.child_columns, f.parent_columns):
            if masked.get((f.child, c)) != masked.get((f.parent, p)):
                out.append(f.name)
    return sorted(set(out))


WIDTHS = {"boolean": 1, "int": 4, "bigint": 8, "double": 8, "float": 4, "date": 4, "timestamp": 8, "string": 32}


def estimate(catalog: Catalog, steps: dict[str, Step]) -> list[tuple[str, int, int]]:
    """(table, rows, bytes) of a plan by static widths."""
    return [(n, s.rows, s.rows * sum(WIDTHS.get(c.type, 64) if c.max_len is None else c.max_len for c in catalog.table(n).columns)) for n, s in sorted(steps.items())]
