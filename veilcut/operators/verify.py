"""Checks of a subset against its source; each returns a small report table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validators import ODD, VALIDATORS, candidates
from ..model import Catalog, ForeignKey, Step

#: Order of checks, and the exit code of the first that fails.
CHECKS = (("residual", 8), ("second_net", 8), ("catalog", 8), ("fk", 9), ("row_count", 10), ("sequences", 10), ("unmasked_identical", 11), ("snapshot", 11))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def orphans(child: DataFrame, parent: DataFrame, edge: ForeignKey) -> DataFrame:
    """Child rows whose reference has no parent.  MATCH SIMPLE: a null part refers to nothing; MATCH FULL: only all nulls do."""
    parts = [F.col(c).isNotNull() for c in edge.child_columns]
    refers = any_of(parts) if edge.match_full else reduce(lambda a, b: a & b, parts)
    refs = parent.select(*(F.col(p).alias(c) for c, p in zip(edge.child_columns, edge.parent_columns))).distinct()
    return child.where(refers).join(refs, list(edge.child_columns), "left_anti")


def fk_report(catalog: Catalog, frames: dict[str, DataFrame]) -> DataFrame:
    """(edge, child, parent, n_orphans) of every edge whose tables are at hand."""
    out = None
    for f in sorted(catalog.foreign_keys, key=lambda f: f.name):
        if f.child in frames and f.parent in frames and not f.virtual:
            one = orphans(frames[f.child], frames[f.parent], f).agg(F.count("*").alias("n_orphans"))
            one = one.select(F.lit(f.name).alias("edge"), F.lit(f.child).alias("child"), F.lit(f.parent).alias("parent"), "n_orphans")
            out = one if out is None else out.unionByName(one)
    return out


def row_counts(steps: dict[str, Step], target: dict[str, DataFrame]) -> DataFrame:
    """(table_name, mode, planned, loaded)."""
    out = None
    for name, s in sorted(steps.items()):
        one = target[name].agg(F.count("*").alias("loaded")).select(F.lit(name).alias("table_name"), F.lit(s.mode.value).alias("mode"), F.lit(s.rows).cast("long").alias("planned"), "loaded")
        out = one if out is None else out.unionByName(one)
    return out


def next_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, next_value): one above the maximum, 1 for an empty column."""
    row = df.agg(*(F.max(c).alias(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), (F.coalesce(F.col(c).cast("long"), F.lit(0)) + 1).alias("next_value")) for c in columns))).alias("x")).select("x.*")


def unmasked_identical(source: DataFrame, target: DataFrame, key: tuple[str, ...], columns: list[str]) -> DataFrame:
    """(n_rows, n_missing, n_differing): target rows against their source rows, null-safe, on columns that aren't masked."""
    s = source.select(*(F.col(k).alias(f"s_{k}") for k in key), F.struct(*columns).alias("s_row"))
    j = target.join(s, [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in key], "left")
    missing = F.col("s_row").isNull()
    differs = any_of([~F.col(c).eqNullSafe(F.col(f"s_row.{c}")) for c in columns])
    return j.agg(F.count("*").alias("n_rows"), F.count_if(missing).alias("n_missing"), F.count_if(~missing & differs).alias("n_differing"))


def density(df: DataFrame, column: str) -> DataFrame:
    """(n, n_distinct, low, high, dense): dense if the span of at least three values is at most twice their number."""
    d = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("n"), F.count("*").alias("n_distinct"), F.min(F.col(column).cast("decimal(38,0)")).alias("low"), F.max(F.col(column).cast("decimal(38,0)")).alias("high")
    )
    return d.select("n", "n_distinct", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), ((F.col("n_distinct") >= 3) & (F.col("high") - F.col("low") + 1 <= 2 * F.col("n_distinct"))).alias("dense"))


#: Words that are values of columns about a person, and so no mere enumeration.
GENDERS = ("m", "f", "male", "female", "man", "woman", "nonbinary", "divers", "diverse")


def enumeration_shape(df: DataFrame, column: str, token: str = r"^[A-Za-z0-9_. -]{1,40}$") -> DataFrame:
    """(n, n_distinct, least, enumeration): at least ten values, at most twenty different, each twice or more, all tokens that aren't numbers, dates, genders or names."""
    g = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("c"))
    personal = F.lower("v").isin(*GENDERS) | VALIDATORS["name"][0](F.col("v"))
    plain = F.col("v").rlike(token) & ~F.col("v").rlike("^[0-9]+$") & ~F.col("v").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}|^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}$")
    d = g.agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.min("c").alias("least"), F.bool_and(plain & ~personal).alias("tokens"))
    return d.select("n", "n_distinct", "least", (F.col("tokens") & (F.col("n") >= 10) & (F.col("n_distinct") <= 20) & (F.col("least") >= 2)).alias("enumeration"))


def sample_distinct(df: DataFrame, column: str) -> DataFrame:
    """(n, n_distinct, all_distinct) of the values that aren't null."""
    g = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"), F.count("*").alias("n_distinct"))
    return g.withColumn("all_distinct", F.col("n") == F.col("n_distinct"))


def spellings(x: Column) -> Column:
    """The value in all its spellings, for values that show a sign of another one; else the value alone."""
    return F.when(x.rlike(ODD), candidates(x)).otherwise(F.array(x))


def _in_any(column: str, valid) -> Column:
    return F.exists(column, lambda e: F.coalesce(valid(e), F.lit(False)))


def values_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, x): the values of columns, one below the other, elements of arrays one by one; nulls left out."""
    nested = [c for c in columns if df.schema[c].dataType.typeName() == "array"]
    flat = [F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("x")) for c in columns if c not in nested]
    flat += [F.struct(F.lit(c).alias("c"), F.lit(None).cast("string").alias("x")) for c in columns]  # so that every column has a row
    whole = df.select(F.explode(F.array(*flat)).alias("y")).select("y.*")
    for c in nested:
        whole = whole.unionByName(df.select(F.lit(c).alias("c"), F.explode(F.col(f"`{c}`").cast("array<string>")).alias("x")))
    return whole


def match_counts(df: DataFrame, columns: list[str], validators: list[str] | None = None) -> DataFrame:
    """As counts_of, of the columns of a table."""
    return counts_of(values_of(df, columns), validators)


def counts_of(values: DataFrame, validators: list[str] | None = None) -> DataFrame:
    """(column_name, validator, n_values, n_hits, n_distinct) of values in any spelling; one scan, combined before the shuffle.

    n_distinct, an estimate that is exact for the few values that matter, is counted for the validators of names and words only.
    """
    names = validators or list(VALIDATORS)
    x = values.select("c", "x", spellings(F.col("x")).alias("s"))
    hits = x.select("c", "x", *(F.coalesce(_in_any("s", VALIDATORS[v][0]), F.lit(False)).alias(f"h_{v}") for v in names))
    found = hits.groupBy("c").agg(
        F.count("x").alias("n"),
        *(F.count_if(f"h_{v}").alias(f"n_{v}") for v in names),
        *(F.approx_count_distinct(F.when(F.col(f"h_{v}"), F.lower("x"))).alias(f"d_{v}") for v in names if v in DICTIONARY),
    )
    rows = F.array(*(F.struct(F.lit(v).alias("validator"), F.col("n").alias("n_values"), F.col(f"n_{v}").alias("n_hits"), (F.col(f"d_{v}") if v in DICTIONARY else F.lit(None).cast("long")).alias("n_distinct")) for v in names))
    return found.select(F.col("c").alias("column_name"), F.explode(rows).alias("y")).select("column_name", "y.*")


#: Validators whose single hit in a column that should hold nothing is proof; dictionary validators, which need several different values.
PROOF = ("email", "card_shape", "iban", "ssn", "dni", "nir", "codice_fiscale", "phone", "mac", "ip")
DICTIONARY = ("name_shape", "prose_name", "special")
RATIO = ("secret", "nino", "pesel", "bsn", "cpf", "aadhaar")


def second_net(df: DataFrame, columns: list[str], ratio: float = 0.8, sure: float = 0.97) -> DataFrame | None:
    """As second_nets, of one table."""
    net = second_nets({"": (df, columns)}, ratio, sure)
    return None if net is None else net.drop("table_name")


def second_nets(tables: dict[str, tuple[DataFrame, list[str]]], ratio: float = 0.8, sure: float = 0.97) -> DataFrame | None:
    """Validator hits in columns that weren't masked, with the verdict, for all tables in one job (two with whole-number columns).

    One hit of a PROOF validator fails.  DICTIONARY validators need a share `ratio` of the values and three different ones; RATIO
    validators the share, or all of fewer than three values.  Bare digits that look like national ids need the share `sure`, and
    whole-number columns with dense values (sequences) are exempt.
    """
    kinds = {(t, c): df.schema[c].dataType.typeName() for t, (df, columns) in tables.items() for c in columns}
    number = {at for at, k in kinds.items() if k in ("integer", "long", "short", "decimal")}
    text = {at for at, k in kinds.items() if k in ("string", "varchar", "char", "array")}

    def values(wanted: set) -> DataFrame | None:
        out = None
        for t, (df, columns) in tables.items():
            if own := [c for c in columns if (t, c) in wanted]:
                one = values_of(df, own).select(F.struct(F.lit(t).alias("t"), "c").alias("c"), "x")
                out = one if out is None else out.unionByName(one)
        return out

    out = counts_of(values(text), [*PROOF, *DICTIONARY, *RATIO, "national_digits"]) if text else None
    if number:
        counted = counts_of(values(number), ["card_shape", "national_digits"])
        # only for the few columns that look like ids it matters whether they are dense
        suspects = {(r.column_name.t, r.column_name.c) for r in counted.where((F.col("n_values") >= 3) & (F.col("n_hits") >= sure * F.col("n_values"))).collect()}
        for t, c in sorted(suspects):
            if density(tables[t][0], c).first().dense:
                counted = counted.where((F.col("column_name.t") != t) | (F.col("column_name.c") != c))
        counted = counted.withColumn("number", F.lit(True))
        out = counted if out is None else out.withColumn("number", F.lit(False)).unionByName(counted)
    elif out is not None:
        out = out.withColumn("number", F.lit(False))
    if out is None:
        return None
    share = F.col("n_hits") / F.greatest(F.col("n_values"), F.lit(1))
    v = F.col("validator")
    fails = (
        F.when(v.isin(*PROOF), F.when(F.col("number"), (share >= sure) & (F.col("n_values") >= 3)).otherwise(F.col("n_hits") > 0))
        .when(v.isin(*DICTIONARY), (share >= ratio) & (F.col("n_distinct") >= 3))
        .when(v == "national_digits", (share >= sure) & (F.col("n_values") >= 3))
        .otherwise((F.col("n_hits") > 0) & ((share >= ratio) & (F.col("n_values") >= 3) | (F.col("n_hits") == F.col("n_values"))))
    )
    names = [F.col("column_name.t").alias("table_name"), F.col("column_name.c").alias("column_name")]
    return out.withColumn("fails", fails).select(*names, "validator", "n_values", "n_hits", "n_distinct", "fails")


def residual(source: DataFrame, target: DataFrame, column: str, canonical) -> DataFrame:
    """(column_name, n_values, n_residual): masked values whose canonical form is a value of the source column; exact, without a filter."""
    s = source.select(canonical(F.col(column).cast("string")).alias("c")).where("c is not null and c <> ''").distinct()
    t = target.select(canonical(F.col(column).cast("string")).alias("c")).where("c is not null and c <> ''")
    hit = t.join(s.withColumn("hit", F.lit(1)), "c", "left")
    return hit.agg(F.count("*").alias("n_values"), F.count("hit").alias("n_residual")).select(F.lit(column).alias("column_name"), "n_values", "n_residual")


def vocabulary_explained(source: DataFrame, target: DataFrame, key: tuple[str, ...], column: str, emitted: DataFrame, canonical) -> DataFrame:
    """(n_unexplained, n_same_row): target values that occur more often than masking emitted them, and rows that kept their own value.

    emitted: (c, n) how often masking gave each canonical value.
    """
    t = target.select(*key, canonical(F.col(column)).alias("c"))
    counts = t.groupBy("c").agg(F.count("*").alias("seen")).join(emitted, "c", "left")
    over = counts.agg(F.coalesce(F.sum(F.greatest(F.col("seen") - F.coalesce("n", F.lit(0)), F.lit(0))), F.lit(0)).alias("n_unexplained"))
    own = t.join(source.select(*key, canonical(F.col(column)).alias("s")), list(key)).agg(F.count_if(F.col("c") == F.col("s")).alias("n_same_row"))
    return over.crossJoin(own)  # one row each


def exists_exact_or_folded(values: DataFrame, column: str, source: DataFrame, source_column: str, fold) -> DataFrame:
    """The values with how they occur in a source column: exact, folded or absent."""
    exact = source.select(F.col(source_column).cast("string").alias(column)).distinct().withColumn("_exact", F.lit(True))
    folded = source.select(fold(F.col(source_column).cast("string")).alias("_f")).distinct().withColumn("_folded", F.lit(True))
    j = values.join(exact, column, "left").withColumn("_f", fold(F.col(column))).join(folded, "_f", "left")
    return j.select(column, F.when(F.col("_exact"), "exact").when(F.col("_folded"), "folded").otherwise("absent").alias("found"))


def exit_code(failed: set[str]) -> int:
    return next((code for name, code in CHECKS if name in failed), 0)
