"""Graph questions about a catalog: root ranking, lookups, components, load order, reach, equality groups."""

from __future__ import annotations

import heapq
import re

from ..model import Catalog, Confidence, Decision, ForeignKey, Mode

#: Tables that frameworks keep for themselves, and names that look like code lists.
FRAMEWORK = frozenset("schema_migrations ar_internal_metadata django_migrations alembic_version flyway_schema_history knex_migrations".split())
LOOKUP_NAME = re.compile(r"(?:^|_)(?:types?|status(?:es)?|kinds?|codes?|categor(?:y|ies)|countr(?:y|ies)|currenc(?:y|ies)|languages?|regions?|nations?)$")
PREFERRED = ("customer", "customers", "user", "users", "account", "accounts", "person", "people", "organization", "organizations", "tenant", "tenants")


def rank_roots(catalog: Catalog, lookup_rows: int = 1000) -> list[tuple[str, int, bool]]:
    """(table, inbound - outbound, candidate) in order of choice; lookup-shaped tables come only if all are."""
    found = []
    for t in catalog.tables:
        into = [f for f in catalog.incoming(t.name) if f.child != t.name]
        out = [f for f in catalog.outgoing(t.name) if f.parent != t.name]
        small = t.rows is not None and t.rows < lookup_rows and len({f.child for f in into}) <= 2
        shaped = t.name in FRAMEWORK or bool(LOOKUP_NAME.search(t.name)) or small
        found.append((t, len(into) - len(out), not shaped))
    if not any(ok for *_, ok in found):
        found = [(t, s, True) for t, s, _ in found]
    order = sorted(found, key=lambda x: (not x[2], -x[1], PREFERRED.index(x[0].name) if x[0].name in PREFERRED else len(PREFERRED), -(x[0].rows or 0), x[0].name))
    return [(t.name, score, ok) for t, score, ok in order]


def strong_components(nodes: list[str], edges: list[tuple[str, str]]) -> list[tuple[str, ...]]:
    """Strongly connected components with a cycle (self-loops too), sorted."""
    to: dict[str, list[str]] = {n: [] for n in nodes}
    back: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in edges:
        to[a].append(b)
        back[b].append(a)
    done: list[str] = []
    seen: set[str] = set()
    for n in sorted(nodes):
        todo = [(n, iter(sorted(to[n])))] if n not in seen else []
        seen.add(n)
        while todo:
            at, rest = todo[-1]
            following = next((x for x in rest if x not in seen), None)
            if following is None:
                done.append(at)
                todo.pop()
            else:
                seen.add(following)
                todo.append((following, iter(sorted(to[following]))))
    placed: set[str] = set()
    out = []
    for n in reversed(done):
        if n in placed:
            continue
        group, todo2 = [], [n]
        placed.add(n)
        while todo2:
            x = todo2.pop()
            group.append(x)
            for y in back[x]:
                if y not in placed:
                    placed.add(y)
                    todo2.append(y)
        if len(group) > 1 or (n, n) in set(edges):
            out.append(tuple(sorted(group)))
    return sorted(out)


def load_order(catalog: Catalog) -> list[tuple[int, str, int]]:
    """(position, table, component): parents before children, members of a cycle together, ties by name."""
    names = sorted(t.name for t in catalog.tables)
    edges = [(f.child, f.parent) for f in catalog.foreign_keys if not f.virtual]
    group = {n: n for n in names}
    for members in strong_components(names, edges):
        for m in members:
            group[m] = members[0]
    needs: dict[str, set[str]] = {g: set() for g in set(group.values())}
    follows: dict[str, set[str]] = {g: set() for g in needs}
    for c, p in edges:
        if group[c] != group[p]:
            needs[group[c]].add(group[p])
            follows[group[p]].add(group[c])
    ready = [g for g, n in needs.items() if not n]
    heapq.heapify(ready)
    order: list[str] = []
    while ready:
        order.append(heapq.heappop(ready))
        for g in follows[order[-1]]:
            needs[g].discard(order[-1])
            if not needs[g]:
                heapq.heappush(ready, g)
    out, at = [], 0
    for k, g in enumerate(order):
        for n in sorted(x for x in names if group[x] == g):
            out.append((at, n, k))
            at += 1
    return out


def static_reach(catalog: Catalog, root: str, depth: int, lookups: frozenset[str] = frozenset()) -> dict[tuple[str, Mode], int]:
    """Least depth at which a table can be reached in a mode, whatever the rows are."""
    best = {(root, Mode.CHILD_OK): 0}
    todo = [(root, Mode.CHILD_OK, 0)]
    while todo:
        table, mode, at = todo.pop(0)
        steps = [(f.parent, Mode.PARENT_ONLY, at) for f in catalog.outgoing(table)]
        if mode is Mode.CHILD_OK and at < depth:
            steps += [(f.child, Mode.CHILD_OK, at + 1) for f in catalog.incoming(table) if not f.virtual]
        for name, m, d in steps:
            if name not in lookups and best.get((name, m), d + 1) > d:
                best[name, m] = d
                todo.append((name, m, d))
    return best


def lookup_tables(catalog: Catalog, masked: set[str], approx_limit: int = 10_000) -> list[str]:
    """Tables that point nowhere, are pointed at, hold no masked column and are small by estimate: candidates for a bounded count."""
    return sorted(
        t.name
        for t in catalog.tables
        if t.framework or t.name in FRAMEWORK or (not catalog.outgoing(t.name) and catalog.incoming(t.name) and t.name not in masked and (t.rows is None or t.rows <= approx_limit))
    )


def equality_groups(catalog: Catalog, decisions: list[Decision]) -> list[tuple[str, tuple[tuple[str, str], ...]]]:
    """(category, columns) of masked columns that foreign keys make equal: they need one masker."""
    lead: dict[tuple[str, str], tuple[str, str]] = {}

    def find(x: tuple[str, str]) -> tuple[str, str]:
        while lead.setdefault(x, x) != x:
            lead[x] = x = lead[lead[x]]
        return x

    for f in catalog.foreign_keys:
        for c, p in zip(f.child_columns, f.parent_columns):
            a, b = find((f.child, c)), find((f.parent, p))
            lead[max(a, b)] = min(a, b)
    of = {(d.table, d.column): d for d in decisions if d.masked}
    groups: dict[tuple[tuple[str, str], str], list[tuple[str, str]]] = {}
    for at in lead:
        if at in of:
            groups.setdefault((find(at), of[at].category), []).append(at)
    return sorted((cat, tuple(sorted(cols))) for (_, cat), cols in groups.items() if len(cols) > 1)


_IRREGULAR = {"person": "people", "child": "children", "man": "men", "woman": "women", "mouse": "mice", "datum": "data"}


def plural(word: str) -> str:
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if re.search(r"[^aeiou]y$", word):
        return word[:-1] + "ies"
    return word + ("es" if re.search(r"(?:s|x|z|ch|sh)$", word) else "s")


def polymorphic_pairs(catalog: Catalog) -> list[tuple[str, str, str]]:
    """(table, type column, id column) of `x_type`/`x_id` and `content_type_id`/`object_id` pairs that no foreign key covers."""
    out = []
    for t in catalog.tables:
        names, keyed = {c.name for c in t.columns}, {c for f in catalog.outgoing(t.name) if not f.virtual for c in f.child_columns}
        for n in sorted(names):
            m = re.fullmatch(r"(.+)_type", n)
            if m and f"{m[1]}_id" in names and f"{m[1]}_id" not in keyed:
                out.append((t.name, n, f"{m[1]}_id"))
        if {"content_type_id", "object_id"} <= names and "object_id" not in keyed:
            out.append((t.name, "content_type_id", "object_id"))
    return out


def resolve_type_value(catalog: Catalog, value: str) -> str | None:
    """The table a type value names: class names are underscored and pluralised, the last part alone is tried, then the value in lower case."""
    snake = lambda s: re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", s).lower()
    tables = {t.name for t in catalog.tables}
    whole = snake(re.sub(r"::|[./]", "_", value)).replace("__", "_")
    last = snake(re.split(r"::|[./]", value)[-1])
    for guess in (plural(whole), whole, plural(last), last, value.lower()):
        if guess in tables:
            return guess
    return None


def polymorphic_edges(catalog: Catalog, pair: tuple[str, str, str], values: list[str] | dict[str, str], most: int = 50) -> list[ForeignKey]:
    """Virtual parent edges of a typed pair; more than `most` distinct values say it isn't one.  values: type values, or what names each."""
    table, kind, ident = pair
    if len(values) > most:
        return []
    out = []
    for v in sorted(values):
        parent = resolve_type_value(catalog, values[v] if isinstance(values, dict) else v)
        key = catalog.table(parent).primary_key if parent else ()
        if len(key) == 1:
            out.append(ForeignKey(f"{table}_{ident}_{parent}_virtual", table, (ident,), parent, key, virtual=True, discriminator=(kind, v)))
    return out


def unresolved(decisions: list[Decision]) -> list[str]:
    """Columns with personal data of at least likely confidence that stay unmasked; for the report."""
    return sorted(f"{d.table}.{d.column}" for d in decisions if d.confidence.value >= Confidence.LIKELY.value and not d.masked)
