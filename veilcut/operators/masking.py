"""Masking of tables: one select of native expressions; arrays by element, nested documents by a walk."""

from __future__ import annotations

import json
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

from ..functions import canonical as forms
from ..functions.digest import Bound, PyStream, block, digest, py_digest
from ..functions.generators import MASKERS, REDRAWS, TEXT, Limits, again, echoes, generator, masked, passed, room, writable
from ..functions.kinds import kind_of, luhn_digit_of
from ..functions.words import AREAS, FILLER, GIVEN, HOSTS, SURNAME
from ..model import Refusal


def mask_cell(key: bytes, masker: str, text: Column, form: Column, tag: str | Column, limits: Limits) -> Column:
    return masked(masker, digest(key, MASKERS[masker][0], tag, form), text, form, limits)


def mask_column(key: bytes, masker: str, x: Column, limits: Limits = Limits(), unicode: bool = False) -> Column:
    """The masked value of a scalar column (as a string); unicode as in canonical.canonical."""
    text = x.cast("string")
    form, tag = forms.canonical(MASKERS[masker][0], text, unicode)
    return mask_cell(key, masker, text, form, tag, limits)


def _folded(x: Column, kind: DataType) -> Column:
    """The Unicode fold of every string in (nested) arrays; in one Arrow call, as no Python can run inside a lambda."""
    import unicodedata

    def one(v):
        if v is None:
            return None
        return " ".join(unicodedata.normalize("NFKC", v).casefold().split()) if isinstance(v, str) else [one(e) for e in v]

    return F.pandas_udf(lambda s: s.map(one), kind)(x)


def _as_text(kind: DataType) -> DataType:
    return ArrayType(_as_text(kind.elementType), True) if isinstance(kind, ArrayType) else StringType()


def _nullable(kind: DataType) -> DataType:
    return ArrayType(_nullable(kind.elementType), True) if isinstance(kind, ArrayType) else kind


def mask_array(key: bytes, masker: str, x: Column, limits: Limits = Limits(), kind: DataType = ArrayType(StringType()), unicode: bool = False) -> Column:
    """Element by element, at any depth; null elements and arrays stay, equal elements mask alike, as in a scalar column."""
    category = MASKERS[masker][0]
    text = x.cast(_as_text(kind))

    def walk(v: Column, form: Column | None, k: DataType) -> Column:
        if isinstance(k, ArrayType):
            if form is None:
                return F.transform(v, lambda e: walk(e, None, k.elementType))
            return F.zip_with(v, form, lambda e, f: walk(e, f, k.elementType))
        return mask_column(key, masker, v, limits) if form is None else mask_cell(key, masker, v, form, "text", limits)

    folds = unicode and category not in forms.FORMS
    return walk(text, _folded(text, _as_text(kind)) if folds else None, kind)


def wide_columns(df: DataFrame, columns: list[str]) -> frozenset[str]:
    """The columns (text, or arrays of text) that hold more than ASCII: one scan of them, a row of booleans."""
    if not columns:
        return frozenset()
    text = {c: F.col(f"`{c}`").cast("string") if not isinstance(df.schema[c].dataType, ArrayType) else F.to_json(F.col(f"`{c}`")) for c in columns}
    row = df.agg(*(F.coalesce(F.bool_or(forms.wide(x)), F.lit(False)).alias(c) for c, x in text.items())).first()
    return frozenset(c for c in columns if row[c])


def _free_prefix(names: list[str]) -> str:
    """The start of column names that no column has."""
    prefix = "_"
    while any(n.startswith(prefix) for n in names):
        prefix += "_"
    return prefix


def mask_scalars(df: DataFrame, key: bytes, plan: dict[str, tuple[str, Limits]], wide: frozenset[str] | None = None) -> DataFrame:
    """df with scalar columns masked, in a few projections: canonical form, digest, first block, value, new draws.

    Each step names what the next uses more than once, so Catalyst keeps the projections apart and computes every
    digest once, inside one stage of generated code.  Names of the steps are such as df doesn't have.
    """
    names, prefix = list(df.columns), _free_prefix(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = {c: (f"{prefix}{i}", MASKERS[m][0], m, replace(limits, kind=types[c].simpleString())) for i, (c, (m, limits)) in enumerate(plan.items())}
    at_of = lambda kind, at: f"{at}{kind}"
    step = lambda make: df.withColumns({at_of(kind, at): col for c, (at, cat, m, limits) in cells.items() for kind, col in make(c, at, cat, m, limits).items()})
    is_binary = {c: isinstance(types[c], BinaryType) for c in cells}
    forms_of = {}
    for c, (at, cat, _, _) in cells.items():
        x = F.col(at_of("x", at))
        forms_of[c] = (x, "binary") if is_binary[c] else forms.canonical(cat, x, isinstance(types[c], StringType) and (wide is None or c in wide))
    df = step(lambda c, at, *_: {"x": F.hex(F.col(f"`{c}`")) if is_binary[c] else F.col(f"`{c}`").cast("string")})
    df = step(lambda c, *_: {"c": forms_of[c][0]})
    df = step(lambda c, at, cat, *_: {"h": digest(key, cat, forms_of[c][1], F.col(at_of("c", at)))})
    df = step(lambda c, at, *_: {"b": block(F.col(at_of("h", at)), 0)})
    df = step(lambda c, at, cat, m, limits: {"o": generator(m, limits)(Bound(F.col(at_of("h", at)), F.col(at_of("b", at))), F.col(at_of("x", at)), limits)})
    for i in range(1, REDRAWS):

        def redraw(c, at, cat, m, limits, i=i):
            out = F.col(at_of("o", at))
            if echoes(m):
                out = F.when(F.lower(out) == F.col(at_of("c", at)), generator(m, limits)(again(F.col(at_of("h", at)), i), F.col(at_of("x", at)), limits)).otherwise(out)
            return {"o": out}

        if any(echoes(m) for _, _, m, _ in cells.values()):
            df = step(redraw)
    value = lambda c: passed(F.col(at_of("x", cells[c][0])), F.col(at_of("o", cells[c][0]))).cast(types[c]).alias(c)
    return df.select(*(value(c) if c in cells else F.col(f"`{c}`") for c in names))


def unwritable(df: DataFrame, plan: dict[str, tuple[str, Limits]]) -> list[str]:
    """Why maskers can't write to their columns: the type doesn't hold their values, or there is no room."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [f"{c}: values of {m} can't be written to {types[c]}" for c, (m, _) in plan.items() if not writable(m, types[c])]
    return out + [f"{c}: {why}" for c, (m, limits) in plan.items() if (why := room(m, limits))]


def transform(df: DataFrame, key: bytes, plan: dict[str, tuple[str, Limits]], generated: dict[str, str] | None = None, wide: frozenset[str] | None = None, documents: dict[str, dict[str, str] | None] | None = None) -> DataFrame:
    """A table with its planned columns masked and cast back to their types; generated columns are computed anew.

    Only planned columns change; the others are passed through.  Maskers that can't write to their columns are refused.
    wide: columns that may hold more than ASCII (all texts if None; see wide_columns); only for these Python runs.
    documents: the leaf maps of planned columns of masker semi_structured.
    """
    if bad := unwritable(df, plan):
        raise Refusal(bad)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = df.columns
    done = df.drop(*(generated or {}))
    nested = {c: p for c, p in plan.items() if isinstance(kinds[c], ArrayType)}
    whole = {c for c, (m, _) in plan.items() if m == "semi_structured" and c not in nested}
    scalars = {c: p for c, p in plan.items() if c not in nested and c not in whole}
    if scalars:
        done = mask_scalars(done, key, scalars, wide)
    for c, (masker, limits) in nested.items():
        done = done.withColumn(c, mask_array(key, masker, F.col(f"`{c}`"), limits, kinds[c], wide is None or c in wide).cast(_nullable(kinds[c])))
    for c in whole:
        done = done.withColumn(c, mask_json(key, F.col(f"`{c}`"), (documents or {}).get(c)))
    for name, expression in (generated or {}).items():
        done = done.withColumn(name, F.expr(expression))
    return done.select(*(f"`{n}`" for n in names))


def emitted_counts(df: DataFrame, key: bytes, column: str, masker: str, limits: Limits = Limits()) -> DataFrame:
    """(c, n): how often masking gives each canonical output."""
    out = mask_column(key, masker, F.col(column), limits)
    return df.select(forms.canonical(MASKERS[masker][0], out, False)[0].alias("c")).groupBy("c").agg(F.count("*").alias("n"))


def _digits(shape: str, s: PyStream) -> str:
    """A number of the same shape: other digits, no leading zero where there was none, the exponent as it is."""
    mantissa, mark, exponent = shape.partition("e") if "e" in shape else shape.partition("E")
    out = ""
    for i, c in enumerate(mantissa):
        lead = c.isdigit() and not any(x.isdigit() for x in mantissa[:i])
        out += str(s.below(9) + 1) if lead and c != "0" else c if lead or not c.isdigit() else str(s.below(10))
    return out + mark + exponent


def _text_of(category: str, value: str, s: PyStream) -> str:
    digits = lambda n: str(s.below(9) + 1) + "".join(str(s.below(10)) for _ in range(n - 1))
    hexes = lambda n: "".join("0123456789abcdef"[s.below(16)] for _ in range(n))
    if category == "email":
        return f"{GIVEN[s.below(len(GIVEN))]}.{SURNAME[s.below(len(SURNAME))]}@{HOSTS[s.below(len(HOSTS))]}".lower()
    if category == "person_name":
        return f"{GIVEN[s.below(len(GIVEN))]} {SURNAME[s.below(len(SURNAME))]}"
    if category == "phone":
        return f"+1 {AREAS[s.below(len(AREAS))]} 555 01{s.below(100):02d}"
    if category == "national_id":
        return digits(9)
    if category == "financial_account":
        body = digits(15)
        return body + luhn_digit_of(body)
    if category == "network_id":
        if value.count(":") == 5 and "." not in value:
            return f"00:00:5e:00:53:{hexes(2)}"
        return "2001:db8:" + ":".join(hexes(4) for _ in range(6)) if ":" in value else ("192.0.2.", "198.51.100.", "203.0.113.")[s.below(3)] + str(s.below(256))
    if category == "online_id":
        return "https://example.invalid/" + hexes(13) if "://" in value else f"{hexes(8)}-{hexes(4)}-4{hexes(3)}-8{hexes(3)}-{hexes(12)}"
    if category == "person_date":
        return f"{1940 + s.below(70)}-{1 + s.below(12):02d}-{1 + s.below(28):02d}"
    if category == "credential":
        return "masked-credential"
    words: list[str] = []
    while sum(len(w) + 1 for w in words) < len(value) + 1:
        words.append(FILLER[s.below(len(FILLER))])
    return " ".join(words)[: len(value)].rstrip() or "x"


def _scalar(key: bytes, category: str, value):
    """A leaf of a document: strings become values of the category, numbers keep their shape, booleans take a digest bit."""
    if value is None or value == "":
        return value
    kind = "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "text"
    s = PyStream(py_digest(key, category, kind, json.dumps(value) if kind != "text" else " ".join(value.lower().split())))
    if kind == "bool":
        return bool(s.below(2))
    if kind == "number":
        return json.loads(_digits(json.dumps(value), s))
    return _text_of(category, value, s)


def _walk(key: bytes, value, leaf_map: dict[str, str] | None, held: str | None, known: bool, inside: bool = False):
    """held: category of the nearest key that has one; known: every key so far is known to hold nothing; inside: below a key."""
    if isinstance(value, dict):
        out = {}
        for k in sorted(value):
            category = (leaf_map or {}).get(k)
            below = held if category in (None, "none") else category
            name = k
            if (kind := kind_of(k)) in ("email", "phone", "financial_account") or (k.isdigit() and len(k) >= 12):
                name = _scalar(key, kind or "national_id", k)
            if name in out:
                raise ValueError("two masked keys of a document collide")
            out[name] = _walk(key, value[k], leaf_map, below, known and category == "none", True)
        return out
    if isinstance(value, list):
        return [_walk(key, v, leaf_map, held, known, inside) for v in value]
    if held:
        return _scalar(key, held, value)
    found = kind_of(value) if isinstance(value, str) else None
    if found:
        return _scalar(key, found, value)
    if leaf_map is not None and known and inside:
        return value
    return _scalar(key, "free_text", value)


def mask_json(key: bytes, x: Column, leaf_map: dict[str, str] | None = None, collapse: bool = False) -> Column:
    """A JSON text with its leaves masked.

    A leaf takes the category of the nearest enclosing key that has one, else that of its value's shape (kinds.kind_of); other leaves
    below keys that are all known as `none` are copied; everything else is masked as free text (without a map, all leaves are).
    Objects of any size and lists are walked whole.  collapse: the whole document becomes {}; so does one that can't be
    read (no JSON, or nested deeper than Python's parser goes), as nothing of it may come out.
    """
    if collapse:
        return F.when(x.isNull(), None).otherwise("{}")

    @F.pandas_udf(StringType())
    def walk(docs: pd.Series) -> pd.Series:
        def one(s):
            if s is None or s == "":
                return s
            try:
                return json.dumps(_walk(key, json.loads(s), leaf_map, None, True), separators=(",", ":"), ensure_ascii=False, sort_keys=True)
            except (ValueError, RecursionError) as e:
                if "collide" in str(e):
                    raise
                return "{}"

        return docs.map(one)

    return walk(x)


def mask_flat_json(key: bytes, x: Column, masker: str, keys: list[str]) -> Column:
    """Flat documents of strings or numbers, natively: the values of `keys` become masked, other keys are kept."""
    held = F.from_json(x, "map<string,string>")
    entries = F.transform(F.map_entries(held), lambda e: F.struct(e["key"].alias("key"), F.when(e["key"].isin(*keys), mask_column(key, masker, e["value"])).otherwise(e["value"]).alias("value")))
    return F.when(x.isNotNull(), F.to_json(F.map_from_entries(F.array_sort(entries))))
