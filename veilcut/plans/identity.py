"""Row identity: explicit key, primary key, narrowest unique index, probed pseudo-key, or refusal."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Catalog, Identity, IdentityKind, Refusal, Table

_KIND = re.compile(r"(?:^|_)(?:type|status|kind|state|code)$")


def duplicate_keys(df: DataFrame, key: tuple[str, ...], limit: int = 2) -> DataFrame:
    """Keys that more than one row has, with their count; at most `limit`."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(limit)


def key_counts(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows and distinct keys of the whole table: equal counts mean that the key identifies rows."""
    per_key = df.groupBy(*key).agg(F.count("*").alias("n"))  # combined before the shuffle, unlike count(distinct ...)
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.count("*").alias("n_keys"))


def bounded_count(df: DataFrame, most: int = 1001) -> DataFrame:
    """The number of rows, counted up to `most`."""
    return df.limit(most).agg(F.count("*").alias("n"))


def pseudo_candidates(catalog: Catalog, table: Table) -> tuple[str, ...]:
    """NOT NULL, non-generated foreign-key columns, then discriminators, in column order."""
    keyed = {c for f in catalog.outgoing(table.name) for c in f.child_columns}
    fit = [c for c in table.columns if not c.nullable and c.generated is None]
    return tuple(c.name for c in fit if c.name in keyed or c.type == "boolean" or c.labels or _KIND.search(c.name))


def resolve(catalog: Catalog, table: Table, df: DataFrame, explicit: tuple[str, ...] | None = None) -> Identity:
    if explicit:
        if duplicate_keys(df, explicit).take(1):
            raise Refusal([f"the key given for {table.name} isn't unique"])
        return Identity(IdentityKind.EXPLICIT, tuple(explicit))
    if table.primary_key:
        return Identity(IdentityKind.PRIMARY, table.primary_key)
    solid = {c.name for c in table.columns if not c.nullable}
    unique = [i for i in table.indexes if i.unique and not i.partial and not i.expression and set(i.columns) <= solid]
    if unique:
        return Identity(IdentityKind.UNIQUE, min(unique, key=lambda i: (len(i.columns), i.name)).columns)
    pseudo = pseudo_candidates(catalog, table)
    if pseudo:
        n = key_counts(df, pseudo).first()
        if n.n_rows == n.n_keys:
            return Identity(IdentityKind.PSEUDO, pseudo)
    raise Refusal([f"{table.name} has no key that identifies its rows"])


def key_hint(sample: list[dict], columns: list[str], most: int = 3) -> tuple[str, ...] | None:
    """The least set of columns that is unique in a (small) sample, for the text of a refusal."""
    for n in range(1, most + 1):
        for key in combinations(columns, n):
            values = [tuple(r[c] for c in key) for r in sample]
            if len(set(values)) == len(values):
                return key
    return None
