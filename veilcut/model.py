"""Catalog, keys, decisions and plans as plain data; everything here lives on the driver."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace
from enum import Enum


class Mode(Enum):
    """How far rows of a table are followed."""

    CHILD_OK = "child_ok"
    PARENT_ONLY = "parent_only"
    LOOKUP = "lookup"
    SCHEMA_ONLY = "schema_only"


class IdentityKind(Enum):
    EXPLICIT = "explicit"
    PRIMARY = "primary"
    UNIQUE = "unique"
    PSEUDO = "pseudo"


class Confidence(Enum):
    NONE = 0
    LOW = 1
    POSSIBLE = 2
    LIKELY = 3
    CERTAIN = 4


class Refusal(Exception):
    """A run that can't be done as asked; code follows the first cause, causes lists all of them."""

    def __init__(self, causes: list[str], code: int = 12):
        super().__init__("; ".join(causes))
        self.causes, self.code = causes, code


@dataclass(frozen=True, order=True)
class Column:
    name: str
    type: str = "string"
    nullable: bool = True
    generated: str | None = None
    max_len: int | None = None
    labels: tuple[str, ...] = ()
    checks: tuple[str, ...] = ()
    default: str | None = None

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(f"{self.type}\x1f{self.max_len}\x1f{self.nullable}\x1f{self.labels}".encode()).hexdigest()[:16]


@dataclass(frozen=True, order=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = True
    partial: bool = False
    expression: bool = False


@dataclass(frozen=True, order=True)
class ForeignKey:
    name: str
    child: str
    child_columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    validated: bool = True
    match_full: bool = False
    virtual: bool = False
    discriminator: tuple[str, str] | None = None  # (type column, value) of a polymorphic edge


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    indexes: tuple[Index, ...] = ()
    rows: int | None = None
    framework: bool = False
    sequences: tuple[str, ...] = ()  # columns that a sequence fills

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


@dataclass(frozen=True)
class Catalog:
    tables: tuple[Table, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()

    def table(self, name: str) -> Table:
        return next(t for t in self.tables if t.name == name)

    def outgoing(self, name: str) -> list[ForeignKey]:
        return sorted((f for f in self.foreign_keys if f.child == name), key=lambda f: f.name)

    def incoming(self, name: str) -> list[ForeignKey]:
        return sorted((f for f in self.foreign_keys if f.parent == name), key=lambda f: f.name)

    @property
    def fingerprint(self) -> str:
        text = json.dumps([[t.name, t.primary_key, [[c.name, c.type, c.nullable] for c in t.columns]] for t in sorted(self.tables, key=lambda t: t.name)])
        text += json.dumps(sorted([f.name, f.child, f.child_columns, f.parent, f.parent_columns] for f in self.foreign_keys))
        return hashlib.sha256(text.encode()).hexdigest()

    def without(self, names: set[str]) -> Catalog:
        return replace(self, tables=tuple(t for t in self.tables if t.name not in names), foreign_keys=tuple(f for f in self.foreign_keys if f.child not in names and f.parent not in names))


@dataclass(frozen=True)
class Identity:
    kind: IdentityKind
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Decision:
    """What was decided for a column; `reason` holds names and counts only, never values."""

    table: str
    column: str
    category: str = "none"
    confidence: Confidence = Confidence.NONE
    reason: str = ""
    masker: str | None = None
    never: bool = False
    unmasked: bool = False
    unique: bool = False
    role: str = "full"
    leaves: tuple[tuple[str, str], ...] | None = None  # of a document: (key, category); () empties it
    fingerprint: str = ""  # of the column, in decisions read from a record

    @property
    def masked(self) -> bool:
        return self.confidence.value >= Confidence.POSSIBLE.value and not self.never and not self.unmasked and self.category != "none"


@dataclass
class Step:
    table: str
    mode: Mode
    identity: tuple[str, ...]
    keys: object = None  # a DataFrame of identity columns
    rows: int = 0
    depth: int = 0
    why: str = ""


@dataclass
class Request:
    root: str | None = None
    take: int = 500
    where: str | None = None
    cap: int = 100
    caps: dict[str, int] = field(default_factory=dict)
    depth: int = 3
    row_budget: int = 1_000_000
    byte_budget: int = 256 << 20
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    skip: set[str] = field(default_factory=set)
    unmask: set[tuple[str, str]] = field(default_factory=set)
    mask: dict[tuple[str, str], str] = field(default_factory=dict)
    strict: bool = False  # refuse drift against an earlier record

    def check(self) -> None:
        wrong = [k for k in ("take", "cap", "depth", "row_budget", "byte_budget") if getattr(self, k) <= 0]
        wrong += [f"cap of {t}" for t, n in self.caps.items() if n <= 0]
        if wrong:
            raise Refusal([f"{k} must be positive" for k in wrong], code=2)
