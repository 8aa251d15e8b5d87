"""The life of a run: read the catalog, classify, plan, extract, mask, write, verify, record."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import canonical as forms
from .functions import domain
from .functions.digest import key_fingerprint
from .functions.generators import MASKERS, echoes, small_domain
from .model import Catalog, Confidence, Decision, Refusal, Request, Step
from .operators import catalog_checks, masking, verify
from .operators import classify as classification
from .plans import closure, graph
from .sources import catalog as catalogs
from .sources import sink


@dataclass
class Outcome:
    catalog: Catalog
    steps: dict[str, Step]
    decisions: list[Decision] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    failed: set[str] = field(default_factory=set)
    notes: list[str] = field(default_factory=list)
    sequences: dict[str, int] = field(default_factory=dict)

    @property
    def exit_code(self) -> int:
        return verify.exit_code(self.failed)

    def decision(self, table: str, column: str) -> Decision:
        return next((d for d in self.decisions if (d.table, d.column) == (table, column)), Decision(table, column))


def with_typed_edges(catalog: Catalog, frames: dict[str, DataFrame], most: int = 50) -> Catalog:
    """The catalog with the edges of its polymorphic pairs, by the type values that the tables hold (more than `most`: not a pair)."""
    edges = []
    for pair in graph.polymorphic_pairs(catalog):
        table, kind, _ = pair
        values = [r[0] for r in frames[table].select(F.col(f"`{kind}`").cast("string")).dropna().distinct().limit(most + 1).collect()]
        types = content_types(catalog, frames, values) if kind == "content_type_id" else values
        edges += graph.polymorphic_edges(catalog, pair, types, most)
    return replace(catalog, foreign_keys=catalog.foreign_keys + tuple(edges))


def content_types(catalog: Catalog, frames: dict[str, DataFrame], ids: list[str]) -> dict[str, str]:
    """Type ids -> names of their tables, by a content-type table (id, app_label, model), if there is one."""
    for name in ("django_content_type", "content_types"):
        if name in frames and {"id", "app_label", "model"} <= set(frames[name].columns):
            rows = frames[name].where(F.col("id").cast("string").isin(ids)).select("id", "app_label", "model").limit(len(ids)).collect()
            return {str(r.id): f"{r.app_label}.{r.model}" for r in rows}
    return {}


def plan(spark: SparkSession, catalog: Catalog, frames: dict[str, DataFrame], request: Request, lookups: frozenset[str] | None = None) -> Outcome:
    """The plan alone; no target is touched.  lookups: None for the code lists that the catalog shows, counted."""
    if request.root is None:
        request.root = graph.rank_roots(catalogs.with_rows(catalog, frames))[0][0]
    if lookups is None:
        lookups = closure.small_lookups([t for t in graph.lookup_tables(catalog, set()) if t != request.root and t not in request.skip], frames)
    steps = closure.walk(catalog, frames, request, lookups)
    closure.add_lookups(steps, catalog, frames, lookups)
    return Outcome(catalog, steps)


def decisions_of(catalog: Catalog, frames: dict[str, DataFrame], request: Request, prior: dict[tuple[str, str], Decision] | None = None) -> list[Decision]:
    """What classification, an earlier record and the request decide; the request's word is last."""
    known = {(t.name, c.name) for t in catalog.tables for c in t.columns}
    if strange := sorted(f"{t}.{c}" for t, c in {*request.unmask, *request.mask} - known):
        raise Refusal([f"{x} isn't a column" for x in strange], code=2)
    if wrong := sorted(m for m in request.mask.values() if m not in MASKERS and m != "semi_structured"):
        raise Refusal([f"{m} isn't a masker" for m in wrong], code=2)
    out = []
    for d in classification.classify(catalog, frames, prior):
        if (d.table, d.column) in request.unmask:
            d = replace(d, unmasked=True)
        if masker := request.mask.get((d.table, d.column)):
            category = "semi_structured" if masker == "semi_structured" else MASKERS[masker][0]
            d = replace(d, category=category, confidence=Confidence.CERTAIN, masker=masker, never=False, reason=classification.reason("asked"))
        out.append(d)
    return out


def refusals(catalog: Catalog, decisions: list[Decision], steps: dict[str, Step]) -> list[str]:
    """Everything about a plan's columns that stands against the run, in one pass."""
    out = [f"{n} has one end masked and the other not" for n in catalog_checks.key_pair_conflicts(catalog, decisions)]
    masked = {(d.table, d.column) for d in decisions if d.masked}
    out += [f"{t}.{c} is a composite that holds a document" for t, c in catalog_checks.composite_documents(catalog) if (t, c) in masked and t in steps]
    return out


def column_plans(catalog: Catalog, steps: dict[str, Step], decisions: list[Decision]) -> dict[str, dict[str, tuple]]:
    """{table: {column: (masker, limits)}}; columns that foreign keys make equal share masker and limits."""
    groups: dict[tuple[str, str], tuple] = {}
    problems = []
    for category, cols in graph.equality_groups(catalog, decisions):
        rows = max((steps[t].rows for t, _ in cols if t in steps), default=0)
        got = domain.group_masker(category, [catalog.table(t).column(c) for t, c in cols], rows, any(d.unique for d in decisions if (d.table, d.column) in cols))
        if isinstance(got, str):
            problems.append(f"{', '.join(f'{t}.{c}' for t, c in cols)}: {got}")
        else:
            groups |= {at: got for at in cols}
    out: dict[str, dict[str, tuple]] = {}
    for name in steps:
        spec = catalog.table(name)
        own = [d for d in decisions if d.table == name and d.masked]
        out[name] = {d.column: groups.get((name, d.column), (d.masker or d.category, domain.limits_of(spec.column(d.column), d.unique and d.category == "email", d.role))) for d in own}
    if problems:
        raise Refusal(problems)
    return out


def extract(catalog: Catalog, frames: dict[str, DataFrame], steps: dict[str, Step], decisions: list[Decision], key: bytes) -> dict[str, DataFrame]:
    """The rows of each step, masked, in load order; semi-join, then one select of expressions."""
    out, problems = {}, []
    plans = column_plans(catalog, steps, decisions)
    leaves = {(d.table, d.column): dict(d.leaves) for d in decisions if d.masked and d.leaves}
    emptied = {(d.table, d.column) for d in decisions if d.masked and d.leaves == () and d.category == "semi_structured"}
    for name in [t for _, t, _ in graph.load_order(catalog) if t in steps]:
        step = steps[name]
        rows = closure.selected_rows(frames[name], step.keys, step.identity)
        todo = plans[name]
        generated = {c.name: c.generated for c in catalog.table(name).columns if c.generated}
        problems += [f"{name}.{x}" for x in masking.unwritable(rows, todo)]
        if problems:
            continue
        texts = [c for c in todo if rows.schema[c].dataType.typeName() in ("string", "varchar", "char", "array")]
        wide = masking.wide_columns(rows, [c for c in texts if todo[c][0] != "semi_structured"])
        for c in (c for t, c in emptied if t == name):
            rows = rows.withColumn(c, masking.mask_json(key, F.col(f"`{c}`"), collapse=True))
            todo = {k: v for k, v in todo.items() if k != c}
        rows = masking.transform(rows, key, todo, generated, wide, {c: leaves.get((name, c)) for c in todo}) if todo or generated else rows
        out[name] = framework_rows(name, rows)
    if problems:
        raise Refusal(problems)
    return out


def framework_rows(name: str, rows: DataFrame) -> DataFrame:
    """The environment that a framework notes in its metadata table becomes `development`."""
    if name == "ar_internal_metadata" and {"key", "value"} <= set(rows.columns):
        return rows.withColumn("value", F.when(F.col("key") == "environment", "development").otherwise(F.col("value")))
    return rows


def run(spark: SparkSession, source: str, target: str, request: Request, key: bytes, tables: tuple[str, ...] | None = None, document: dict | None = None, prior: dict | None = None) -> Outcome:
    """Plan, extract, mask, write and verify a subset of a folder of tables.

    tables: those of the folder to read (None: all); document: its catalog (None: the folder's _catalog.json, or what is known of it);
    prior: the record of an earlier run, whose decisions only tighten and whose opt-outs hold for unchanged columns.
    """
    catalog, frames = catalogs.load(spark, source, tables, document)
    files = catalogs.snapshot(spark, frames)
    causes = [f"{t}.{c} has personal data in its {place}" for t, c, place, _ in catalog_checks.literal_hits(catalog)]
    causes += [f"{t}.{c} calls {f}, which isn't recreated" for t, c, f in catalog_checks.unknown_calls(catalog)]
    if causes:
        raise Refusal(causes)
    sink.gate(spark, source, target, catalog.fingerprint)
    if "lineitem" in frames and not catalog.table("lineitem").primary_key and set(catalogs.LINEITEM_KEY) <= set(frames["lineitem"].columns):
        request.keys.setdefault("lineitem", catalogs.LINEITEM_KEY)
    plain, catalog = catalog, with_typed_edges(catalog, frames)
    earlier = decisions_in(prior) if prior else {}
    decisions = decisions_of(catalog, frames, request, earlier)
    masked = {d.table for d in decisions if d.masked}
    candidates = [t for t in graph.lookup_tables(catalog, masked) if t != request.root and t not in request.skip]
    out = plan(spark, catalog, frames, request, closure.small_lookups(candidates, frames))
    out.decisions = decisions
    causes = refusals(catalog, decisions, out.steps)
    if prior and (changed := classification.drift(catalog, earlier, decisions)):
        out.notes += changed
        causes += [f"not in the earlier record: {x}" for x in changed] if request.strict else []
    if causes:
        raise Refusal(causes)
    with sink.lease(spark, target):
        for name, df in extract(catalog, frames, out.steps, out.decisions, key).items():
            out.tables[name] = sink.write(df, target, name)
        check(out, frames, key)
        if catalogs.snapshot(spark, frames) != files:
            out.failed.add("snapshot")
        sink.put(spark, f"{target}/_schema.json", _json(sink.schema_document(catalog, list(out.tables))))
        sink.record(spark, target, plain, describe(out, request, key) | {"files": files})
    if out.failed:
        raise Refusal([f"check failed: {x}" for x in sorted(out.failed)] + out.notes, code=out.exit_code)
    return out


def _json(document: dict) -> str:
    import json

    return json.dumps(document, indent=1, sort_keys=True)


def rerun(spark: SparkSession, source: str, target: str, key: bytes, **more) -> Outcome:
    """The run that a target's record describes, again: same root, numbers, requests and opt-outs."""
    record = sink.read_record(spark, target)
    if record is None:
        raise Refusal(["the target has no record"], code=2)
    if record["key"] != key_fingerprint(key):
        raise Refusal(["the record was made with another key"], code=2)
    at = lambda x: tuple(x.split(".", 1))
    request = Request(
        root=record["root"], take=record["take"], cap=record["cap"], depth=record["depth"], where=record["where"], caps=record["caps"], skip=set(record["skip"]),
        keys={t: tuple(k) for t, k in record["keys"].items()}, unmask={at(x) for x in record["unmask"]}, mask={at(x): m for x, m in record["mask"].items()},
    )
    return run(spark, source, target, request, key, prior=record, **more)


def decisions_in(record: dict) -> dict[tuple[str, str], Decision]:
    """The decisions that a record holds."""
    out = {}
    for name, c in record["columns"].items():
        table, column = name.split(".", 1)
        leaves = None if c.get("leaves") is None else tuple(sorted(c["leaves"].items()))
        out[table, column] = Decision(table, column, c["category"], Confidence[c["confidence"].upper()], masker=c["masker"], unmasked=c["unmasked"], leaves=leaves, fingerprint=c["fingerprint"])
    return out


def check(out: Outcome, frames: dict[str, DataFrame], key: bytes) -> None:
    """Foreign keys, row counts, unmasked columns, residual values, the second net and sequences of what was written."""
    report = verify.fk_report(out.catalog, out.tables)
    if report is not None and report.where("n_orphans > 0").take(1):
        out.failed.add("fk")
    if verify.row_counts(out.steps, out.tables).where("planned <> loaded").take(1):
        out.failed.add("row_count")
    plans, nets = column_plans(out.catalog, out.steps, out.decisions), {}
    for name, df in out.tables.items():
        step, own = out.steps[name], {d.column: d for d in out.decisions if d.table == name and d.masked}
        spec = out.catalog.table(name)
        if not any(k in own for k in step.identity):
            plain = [c for c in df.columns if c not in own and spec.column(c).generated is None]
            n = verify.unmasked_identical(framework_rows(name, frames[name]), df, step.identity, plain).first()
            if n.n_missing or n.n_differing:
                out.failed.add("unmasked_identical")
        for d in own.values():
            _check_masked(out, frames, key, name, d, plans[name][d.column])
        if not spec.framework:  # generated columns are made of what the others hold now
            nets[name] = (df, [c for c in df.columns if c not in own and c not in step.identity and not out.decision(name, c).unmasked and spec.column(c).generated is None])
        if spec.sequences:
            for r in verify.next_values(df, list(spec.sequences)).collect():
                out.sequences[f"{name}.{r.column_name}"] = r.next_value
    net = verify.second_nets(nets)
    if net is not None and (hits := net.where("fails").select("table_name", "column_name", "validator").collect()):
        out.failed.add("second_net")
        out.notes += sorted(f"{r.table_name}.{r.column_name}: looks like {r.validator}" for r in hits)


def _check_masked(out: Outcome, frames: dict[str, DataFrame], key: bytes, name: str, d: Decision, planned: tuple) -> None:
    """Values of a masked column that the source has too: none, where outputs are many; no more than masking gave, where they are few."""
    df, step, (masker, limits) = out.tables[name], out.steps[name], planned
    if d.category == "semi_structured" or df.schema[d.column].dataType.typeName() == "array":
        return
    wide = bool(masking.wide_columns(df, [d.column]) | masking.wide_columns(frames[name], [d.column])) if df.schema[d.column].dataType.typeName() == "string" else False
    canonical = lambda x: forms.canonical(d.category, x, wide)[0]
    if not (echoes(masker) or limits.labels or small_domain(MASKERS[masker][2], step.rows, bool(limits.labels))):
        if verify.residual(frames[name], df, d.column, canonical).first().n_residual:
            out.failed.add("residual")
    elif echoes(masker) and not limits.labels and not any(x.column in step.identity for x in out.decisions if x.table == name and x.masked):
        rows = closure.selected_rows(frames[name], step.keys, step.identity)
        emitted = masking.emitted_counts(rows, key, d.column, masker, limits)
        n = verify.vocabulary_explained(rows, df, step.identity, d.column, emitted, canonical).first()
        if n.n_unexplained or n.n_same_row:
            out.failed.add("residual")


def describe(out: Outcome, request: Request, key: bytes) -> dict:
    """The record of a run: names, counts and decisions, no values and no key."""
    fingerprints = {(t.name, c.name): c.fingerprint for t in out.catalog.tables for c in t.columns}
    return {
        "key": key_fingerprint(key), "root": request.root, "take": request.take, "cap": request.cap, "depth": request.depth, "where": request.where, "caps": request.caps,
        "skip": sorted(request.skip), "keys": {t: list(k) for t, k in request.keys.items()}, "unmask": sorted(".".join(x) for x in request.unmask), "mask": {".".join(x): m for x, m in sorted(request.mask.items())},
        "steps": {n: {"mode": s.mode.value, "rows": s.rows, "identity": list(s.identity)} for n, s in sorted(out.steps.items())},
        "estimate": {t: {"rows": n, "bytes": b} for t, n, b in catalog_checks.estimate(out.catalog, out.steps)},
        "columns": {
            f"{d.table}.{d.column}": {
                "category": d.category, "confidence": d.confidence.name.lower(), "masked": d.masked, "masker": d.masker, "unmasked": d.unmasked, "reason": d.reason,
                "fingerprint": fingerprints[d.table, d.column], "leaves": None if d.leaves is None else dict(d.leaves),
            }
            for d in out.decisions
        },
        "unresolved": graph.unresolved(out.decisions), "sequences": out.sequences, "notes": out.notes, "failed": sorted(out.failed),
    }


def introspect(spark: SparkSession, source: str, tables: tuple[str, ...] | None = None, document: dict | None = None) -> DataFrame:
    """The catalog of a folder as a table; no values."""
    return catalogs.introspect(spark, *catalogs.load(spark, source, tables, document))


def classify(spark: SparkSession, source: str, request: Request | None = None, tables: tuple[str, ...] | None = None, document: dict | None = None) -> DataFrame:
    """The decisions for a folder as a table; no values."""
    catalog, frames = catalogs.load(spark, source, tables, document)
    return classification.report(spark, decisions_of(catalog, frames, request or Request()))


def reverify(spark: SparkSession, source: str, target: str, key: bytes, tables: tuple[str, ...] | None = None, document: dict | None = None) -> Outcome:
    """The checks of a finished target against its source, by its record; failed names what doesn't hold."""
    record = sink.read_record(spark, target)
    if record is None:
        raise Refusal(["the target has no record"], code=2)
    catalog, frames = catalogs.load(spark, source, tables, document)
    from .model import Mode

    held = {n: spark.read.parquet(f"{target.rstrip('/')}/{n}.parquet") for n in record["steps"]}
    steps = {n: Step(n, Mode(s["mode"]), tuple(s["identity"]), held[n].select(*(f"`{c}`" for c in s["identity"])), s["rows"]) for n, s in record["steps"].items()}
    out = Outcome(catalog, steps, list(decisions_in(record).values()), held)
    check(out, frames, key)
    return out


def doctor(spark: SparkSession, source: str, tables: tuple[str, ...] | None = None, document: dict | None = None) -> list[str]:
    """What would stand against a run, without planning one: tables without identity, literals, calls, composite documents, orphans."""
    from .plans import identity

    catalog, frames = catalogs.load(spark, source, tables, document)
    out = [f"{t}.{c} has personal data in its {place}" for t, c, place, _ in catalog_checks.literal_hits(catalog)]
    out += [f"{t}.{c} calls {f}, which isn't recreated" for t, c, f in catalog_checks.unknown_calls(catalog)]
    out += [f"{t}.{c} is a composite that holds a document" for t, c in catalog_checks.composite_documents(catalog)]
    for t in catalog.tables:
        try:
            identity.resolve(catalog, t, frames[t.name])
        except Refusal as e:
            out += e.causes
    report = verify.fk_report(catalog, frames)
    out += [f"{r.edge} has {r.n_orphans} orphans" for r in report.where("n_orphans > 0").collect()] if report is not None else []
    return out
