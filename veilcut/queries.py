"""Registered queries over a folder of tables, one or more an operator, and the SQL that says what they must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import canonical as forms
from .functions import validators as v
from .functions.digest import Stream, category_key, digest, pads
from .functions.generators import MASKERS, Limits
from .functions.words import AREAS, FILLER, GIVEN, HOSTS, STREET, SUFFIX, SURNAME
from .model import Catalog, Confidence, Decision, ForeignKey, Index, Refusal, Request, Table
from .model import Column as Spec
from .operators import classify as classification
from .operators import masking, sampling, verify
from .plans import closure, graph, identity
from .sources import catalog as catalogs
from .sources.catalog import read
from .sources.storage import durable

KEY = b"veilcut demonstration key"
CORE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- subset

_SEED = "SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 50"


def _seed(spark, d, take=50):
    return closure.seed(read(spark, d, "customer"), ("c_custkey",), take, "c_acctbal > 0")


@query(_SEED)
def subset_seed(spark: SparkSession, d: str) -> DataFrame:
    return _seed(spark, d)


def _edge(child, column, parent, key) -> ForeignKey:
    return ForeignKey(f"{child}_{column}_fkey", child, (column,), parent, (key,))


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_custkey IN ({_SEED})) WHERE rn <= 5")
def subset_child_cap(spark, d):
    return closure.child_keys(read(spark, d, "orders"), _edge("orders", "o_custkey", "customer", "c_custkey"), _seed(spark, d), ("o_orderkey",), 5)


@query(f"SELECT DISTINCT n_nationkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey IN ({_SEED})")
def subset_parent(spark, d):
    rows = closure.selected_rows(read(spark, d, "customer"), _seed(spark, d), ("c_custkey",))
    return closure.parent_keys(rows, _edge("customer", "c_nationkey", "nation", "n_nationkey"), read(spark, d, "nation"), ("n_nationkey",))


@query(f"SELECT o.* FROM orders o WHERE o_custkey IN ({_SEED})")
def keyed_rows(spark, d):
    return closure.selected_rows(read(spark, d, "orders"), _seed(spark, d).withColumnRenamed("c_custkey", "o_custkey"), ("o_custkey",))


def _walk(spark, d, take=50, cap=5, depth=3):
    catalog, frames = catalogs.load(spark, d, CORE)
    request = Request(root="customer", take=take, cap=cap, depth=depth, keys={"lineitem": catalogs.LINEITEM_KEY})
    return catalog, frames, closure.walk(catalog, frames, request)


_LK = ", ".join(catalogs.LINEITEM_KEY)
_CLOSURE = f"""
WITH c AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 50),
e AS (SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE user_id IN (SELECT c_custkey FROM c)) WHERE rn <= 5),
o AS (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)) WHERE rn <= 5),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LK}) AS rn FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)) WHERE rn <= 5),
s AS (SELECT DISTINCT l_suppkey FROM l),
n AS (SELECT c_nationkey AS n FROM c UNION SELECT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM s)),
r AS (SELECT DISTINCT n_regionkey FROM nation WHERE n_nationkey IN (SELECT n FROM n))
"""


@query(
    _CLOSURE
    + """SELECT 'customer' AS table_name, 'child_ok' AS mode, (SELECT count(*) FROM c) AS n_rows UNION ALL SELECT 'events', 'child_ok', (SELECT count(*) FROM e) UNION ALL SELECT 'orders', 'child_ok', (SELECT count(*) FROM o)
UNION ALL SELECT 'lineitem', 'child_ok', (SELECT count(*) FROM l) UNION ALL SELECT 'part', 'parent_only', (SELECT count(DISTINCT l_partkey) FROM l) UNION ALL SELECT 'supplier', 'parent_only', (SELECT count(*) FROM s)
UNION ALL SELECT 'nation', 'parent_only', (SELECT count(*) FROM n) UNION ALL SELECT 'region', 'parent_only', (SELECT count(*) FROM r)"""
)
def subset_closure_counts(spark, d):
    return closure.report(_walk(spark, d)[2], spark).select("table_name", "mode", "n_rows")


@query(_CLOSURE + f"SELECT {_LK} FROM l")
def subset_closure_lineitem(spark, d):
    return _walk(spark, d)[2]["lineitem"].keys


@query("SELECT 0::BIGINT AS n_orphans")
def invariant_subset_has_no_orphans(spark, d):
    catalog, frames, steps = _walk(spark, d)
    held = {n: closure.selected_rows(frames[n], s.keys, s.identity) for n, s in steps.items()}
    return verify.fk_report(catalog, held).agg(F.sum("n_orphans").cast("long").alias("n_orphans"))


@query("SELECT true AS enough")
def invariant_root_has_take(spark, d):
    return closure.report(_walk(spark, d)[2], spark).where("table_name = 'customer'").select((F.col("n_rows") >= 50).alias("enough"))


# ---------------------------------------------------------------- sources and samples


@query(
    "SELECT doc_id, lang FROM documents ORDER BY md5('4242' || chr(31) || doc_id::VARCHAR), doc_id LIMIT 200"
)
def seeded_sample(spark, d):
    return sampling.seeded_sample(read(spark, d, "documents").select("doc_id", "lang"), ("doc_id",))


@query("SELECT * FROM nation ORDER BY n_nationkey LIMIT 1001")
def lookup_scan(spark, d):
    return sampling.lookup_scan(read(spark, d, "nation"), ("n_nationkey",))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, count(*) OVER () AS n_columns, (SELECT count(*) FROM {t}) AS n_rows FROM (DESCRIBE {t})" for t in CORE))
def introspect(spark, d):
    catalog, frames = catalogs.load(spark, d, CORE)
    r = catalogs.introspect(spark, catalog, frames)
    n = r.groupBy("table_name").agg(F.count("*").alias("n_columns"))
    return r.join(n, "table_name").select("table_name", "column_name", "n_columns", "n_rows")


@query("SELECT event_id, event_type, value * 2 AS doubled FROM events")
def generated_column(spark, d):
    df = read(spark, d, "events").select("event_id", "event_type", F.lit(0.0).alias("doubled"), "value")
    return masking.transform(df, KEY, {}, {"doubled": "value * 2"}).select("event_id", "event_type", "doubled")


# ---------------------------------------------------------------- keys


@query(
    " UNION ALL ".join(
        f"SELECT '{k}' AS candidate, count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT {k} FROM lineitem)) AS n_keys FROM lineitem"
        for k in ("l_orderkey, l_linenumber", "l_orderkey, l_partkey, l_suppkey", _LK)
    )
)
def identity_probe(spark, d):
    df, out = read(spark, d, "lineitem"), None
    for key in (("l_orderkey", "l_linenumber"), ("l_orderkey", "l_partkey", "l_suppkey"), catalogs.LINEITEM_KEY):
        one = identity.key_counts(df, key).select(F.lit(", ".join(key)).alias("candidate"), "n_rows", "n_keys")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return identity.duplicate_keys(read(spark, d, "lineitem"), ("l_orderkey", "l_linenumber"), 2**31 - 1)


@query("SELECT count(*) AS n FROM (SELECT 1 FROM lineitem LIMIT 1001)")
def bounded_count(spark, d):
    return identity.bounded_count(read(spark, d, "lineitem"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def key_subtract(spark, d):
    large = read(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").select("c_custkey").join(large, "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def key_absorb(spark, d):
    a = read(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey")
    b = read(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return a.unionByName(b).distinct()


@query("SELECT DISTINCT s_suppkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_quantity > 45")
def key_translate(spark, d):
    rows = read(spark, d, "lineitem").where("l_quantity > 45")
    return closure.parent_keys(rows, _edge("lineitem", "l_suppkey", "supplier", "s_suppkey"), read(spark, d, "supplier"), ("s_suppkey",))


@query("SELECT DISTINCT event_type FROM events")
def distinct_prefix(spark, d):
    return read(spark, d, "events").select("event_type").distinct()


# ---------------------------------------------------------------- graph reports


_E = "(VALUES " + ", ".join(f"('{c}', '{p}')" for c, _, p, _ in catalogs.EDGES if c in CORE and p in CORE) + ") AS e(child, parent)"
_T = "(" + " UNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS n" for t in CORE) + ") AS t"
_SHAPED = "types?|status(es)?|kinds?|codes?|categor(y|ies)|countr(y|ies)|currenc(y|ies)|languages?|regions?|nations?"


@query(
    f"""SELECT name AS table_name, ((SELECT count(*) FROM {_E} WHERE parent = name) - (SELECT count(*) FROM {_E} WHERE child = name))::INTEGER AS score,
NOT regexp_matches(name, '(^|_)({_SHAPED})$') AND NOT (n < 1000 AND (SELECT count(DISTINCT child) FROM {_E} WHERE parent = name) <= 2) AS candidate FROM {_T}"""
)
def root_ranking(spark, d):
    catalog, frames = catalogs.load(spark, d, CORE)
    return spark.createDataFrame(graph.rank_roots(catalogs.with_rows(catalog, frames)), "table_name string, score int, candidate boolean")


@query(f"SELECT child, parent, true AS parent_first, (SELECT count(*) FROM {_T}) AS n_places FROM {_E}")
def load_order(spark, d):
    catalog, _ = catalogs.load(spark, d, CORE)
    at = {t: p for p, t, _ in graph.load_order(catalog)}
    return spark.createDataFrame([(f.child, f.parent, at[f.parent] < at[f.child], len(set(at.values()))) for f in catalog.foreign_keys], "child string, parent string, parent_first boolean, n_places long")


@query("SELECT 'region' AS table_name, count(*) AS n FROM (SELECT 1 FROM region LIMIT 1001) UNION ALL SELECT 'part', count(*) FROM (SELECT 1 FROM part LIMIT 1001)")
def lookups(spark, d):
    catalog, frames = catalogs.load(spark, d, CORE)
    out = None
    for t in graph.lookup_tables(catalog, set()):
        one = identity.bounded_count(frames[t]).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH RECURSIVE s(a, b, up) AS (SELECT child, parent, true FROM {_E} UNION ALL SELECT parent, child, false FROM {_E}), r(name, mode, depth) AS (
  SELECT 'customer', 'child_ok', 0 UNION SELECT s.b, CASE WHEN up THEN 'parent_only' ELSE 'child_ok' END, depth + CASE WHEN up THEN 0 ELSE 1 END FROM r JOIN s ON s.a = r.name WHERE up OR mode = 'child_ok' AND depth < 3
) SELECT name AS table_name, mode, min(depth)::INTEGER AS depth FROM r GROUP BY ALL"""
)
def static_reach(spark, d):
    catalog, _ = catalogs.load(spark, d, CORE)
    return spark.createDataFrame([(t, m.value, n) for (t, m), n in graph.static_reach(catalog, "customer", 3).items()], "table_name string, mode string, depth int")


_LINKS = (("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("s", "s"), ("e", "f"))


@query(
    f"""WITH RECURSIVE e(x, y) AS (VALUES {", ".join(map(repr, _LINKS))}), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT a.x AS table_name, min(b.y) AS component FROM r a JOIN r b ON a.x = b.x AND EXISTS (SELECT 1 FROM r c WHERE c.x = b.y AND c.y = a.x) WHERE a.x = a.y GROUP BY a.x"""
)
def cycles(spark, d):
    names = sorted({x for e in _LINKS for x in e})
    rows = [(m, c[0]) for c in graph.strong_components(names, list(_LINKS)) for m in c]
    return spark.createDataFrame(rows, "table_name string, component string")


@query("SELECT * FROM (VALUES ('comments', 'owner_type', 'owner_id', 'Person', 'people'), ('comments', 'owner_type', 'owner_id', 'Shop::Order', 'orders'), ('tags', 'content_type_id', 'object_id', '7', 'orders')) AS t(table_name, type_column, id_column, type_value, parent)")
def polymorphic_edges(spark, d):
    """Typed pairs and the tables that their values name: class names, and a content-type table's."""
    t = lambda name, *columns: Table(name, tuple(Spec(c) for c in columns), ("id",))
    c = Catalog((t("people", "id"), t("orders", "id"), t("comments", "id", "owner_type", "owner_id"), t("tags", "id", "content_type_id", "object_id"), t("plain", "id", "kind_type")))
    values = {"comments": ["Ghost", "Person", "Shop::Order"], "tags": {"7": "shop.order", "8": "shop.ghost"}}
    rows = [(p[0], p[1], p[2], e.discriminator[1], e.parent) for p in graph.polymorphic_pairs(c) for e in graph.polymorphic_edges(c, p, values[p[0]])]
    return spark.createDataFrame(rows, "table_name string, type_column string, id_column string, type_value string, parent string")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_orderpriority = '1-URGENT'")
def typed_parents(spark, d):
    """Parents along an edge that holds only for rows of one type: orders that customers of nation 3 name, seen from the customer's side."""
    refs = read(spark, d, "orders").select(F.col("o_orderkey").alias("ref_id"), F.col("o_orderpriority").alias("ref_type"), "o_custkey")
    refs = refs.join(read(spark, d, "customer").where("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    edge = ForeignKey("refs_orders", "refs", ("ref_id",), "orders", ("o_orderkey",), virtual=True, discriminator=("ref_type", "1-URGENT"))
    return closure.parent_keys(refs, edge, read(spark, d, "orders"), ("o_orderkey",))


@query("SELECT * FROM (VALUES ('orders', 'primary', 'o_orderkey'), ('lineitem', 'explicit', 'l_orderkey,l_linenumber,l_partkey,l_suppkey,l_shipdate'), ('customer', 'unique', 'c_name'), ('supplier', 'refused', NULL)) AS t(table_name, kind, columns)")
def identity_ladder(spark, d):
    """Which columns identify the rows of four tables, declared with a key, given one, with a unique index only and with nothing."""
    catalog, frames = catalogs.load(spark, d, CORE)
    bare = lambda n, **more: Table(n, tuple(Spec(c.name, c.type, c.name not in ("c_name", "c_custkey")) for c in catalog.table(n).columns), **more)
    narrow = bare("customer", indexes=(Index("wide", ("c_custkey", "c_name")), Index("one", ("c_name",)), Index("part", ("c_custkey",), partial=True)))
    asked = ((catalog.table("orders"), None), (catalog.table("lineitem"), catalogs.LINEITEM_KEY), (narrow, None), (bare("supplier"), None))
    rows = []
    for t, explicit in asked:
        try:
            i = identity.resolve(Catalog((t,)), t, frames[t.name], explicit)
            rows.append((t.name, i.kind.value, ",".join(i.columns)))
        except Refusal:
            rows.append((t.name, "refused", None))
    return spark.createDataFrame(rows, "table_name string, kind string, columns string")


@query("SELECT 'email' AS category, 'labels.doc_id' AS column_name UNION ALL SELECT 'email', 'documents.doc_id'")
def equality_groups(spark, d):
    catalog, _ = catalogs.load(spark, d, ("documents", "labels"))
    ds = [Decision(t, "doc_id", "email", Confidence.CERTAIN) for t in ("documents", "labels")]
    rows = [(c, f"{t}.{col}") for c, cols in graph.equality_groups(catalog, ds) for t, col in cols]
    return spark.createDataFrame(rows, "category string, column_name string")


# ---------------------------------------------------------------- checks


@query(" UNION ALL ".join(f"SELECT '{c}_{col}_fkey' AS edge, '{c}' AS child, '{p}' AS parent, count(*) AS n_orphans FROM {c} WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT {pc} FROM {p})" for c, col, p, pc in catalogs.EDGES if c in CORE and p in CORE))
def fk_orphans(spark, d):
    return verify.fk_report(*catalogs.load(spark, d, CORE))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orphan_rows(spark, d):
    edge = _edge("orders", "o_custkey", "customer", "c_custkey")
    return verify.orphans(read(spark, d, "orders"), read(spark, d, "customer").where("c_acctbal > 0"), edge).select("o_orderkey", "o_custkey")


@query(_CLOSURE + "SELECT 'orders' AS table_name, 'child_ok' AS mode, count(*) AS planned, count(*) AS loaded FROM o")
def row_count_check(spark, d):
    _, frames, steps = _walk(spark, d)
    s = steps["orders"]
    return verify.row_counts({"orders": s}, {"orders": closure.selected_rows(frames["orders"], s.keys, s.identity)})


@query("SELECT 'o_orderkey' AS column_name, max(o_orderkey) + 1 AS next_value FROM orders UNION ALL SELECT 'o_custkey', max(o_custkey) + 1 FROM orders")
def sequence_next(spark, d):
    return verify.next_values(read(spark, d, "orders"), ["o_orderkey", "o_custkey"])


@query("SELECT count(*) AS n_rows, 0::BIGINT AS n_missing, count(*) FILTER (c_nationkey = 3) AS n_differing FROM customer")
def unmasked_identical(spark, d):
    df = read(spark, d, "customer")
    changed = df.withColumn("c_mktsegment", F.when(F.col("c_nationkey") == 3, "changed").otherwise(F.col("c_mktsegment")))
    return verify.unmasked_identical(df, changed, ("c_custkey",), ["c_nationkey", "c_mktsegment", "c_acctbal"])


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT o_custkey) AS n_distinct, min(o_custkey)::BIGINT AS low, max(o_custkey)::BIGINT AS high, count(DISTINCT o_custkey) >= 3 AND max(o_custkey) - min(o_custkey) + 1 <= 2 * count(DISTINCT o_custkey) AS dense FROM orders")
def density(spark, d):
    return verify.density(read(spark, d, "orders"), "o_custkey")


@query("SELECT sum(c)::BIGINT AS n, count(*) AS n_distinct, min(c)::BIGINT AS least, sum(c) >= 10 AND count(*) <= 20 AND min(c) >= 2 AS enumeration FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderpriority)")
def enumeration_shape(spark, d):
    return verify.enumeration_shape(read(spark, d, "orders"), "o_orderpriority")


@query("SELECT c_name, CASE WHEN c_nationkey % 3 = 0 THEN 'exact' WHEN c_nationkey % 3 = 1 THEN 'folded' ELSE 'absent' END AS found FROM (SELECT *, CASE c_nationkey % 3 WHEN 0 THEN c_name WHEN 1 THEN lower(c_name) ELSE c_name || '?' END AS w FROM customer) t(k, c_name0, c_nationkey, a, m, c_name)")
def existence_probe(spark, d):
    df = read(spark, d, "customer")
    kind = F.col("c_nationkey") % 3
    values = df.select(F.when(kind == 0, F.col("c_name")).when(kind == 1, F.lower("c_name")).otherwise(F.concat("c_name", F.lit("?"))).alias("c_name"))
    return verify.exists_exact_or_folded(values, "c_name", df, "c_name", forms.fold_ascii)


@query("SELECT bool_or(o_totalprice > 400000) AS any_large, string_agg(s, ',' ORDER BY s) AS statuses FROM (SELECT o_orderstatus AS s, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1)")
def ordered_aggregates(spark, d):
    g = read(spark, d, "orders").groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("top"))
    return g.agg(F.bool_or(F.col("top") > 400000).alias("any_large"), F.array_join(F.array_sort(F.collect_list("o_orderstatus")), ",").alias("statuses"))


# ---------------------------------------------------------------- digest, stream, generators


def _sql_digest(category: str, tag: str, canon: str) -> str:
    inner, outer = (p.hex() for p in pads(category_key(KEY, category)))
    field = lambda x: f"unhex(lpad(printf('%x', octet_length(encode({x}))), 8, '0')) || encode({x})"
    return f"unhex(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {field(repr(tag))} || {field(canon)}))))"


class SqlStream:
    """The number stream in DuckDB's SQL."""

    def __init__(self, h: str):
        self.h, self.at = h, 0

    def below(self, n: int) -> str:
        i, k = divmod(self.at, 4)
        self.at += 1
        return f"(('0x' || substr(sha256({self.h} || unhex('{i:08x}')), {16 * k + 1}, 16))::UBIGINT % {n})::BIGINT"

    def pick(self, words) -> str:
        return f"([{', '.join(repr(w) for w in words)}])[1 + {self.below(len(words))}]"

    def digits(self, n: int) -> str:
        return " || ".join(f"({self.below(9)} + 1)::VARCHAR" if i == 0 else f"{self.below(10)}::VARCHAR" for i in range(n))

    def base32(self, n: int) -> str:
        return " || ".join(f"substr('abcdefghijklmnopqrstuvwxyz234567', (1 + {self.below(32)})::INTEGER, 1)" for _ in range(n))


_FOLD = "trim(regexp_replace(lower(c_name), '\\s+', ' ', 'g'))"


@query(f"SELECT c_custkey, lower(hex({_sql_digest('person_name', 'text', _FOLD)})) AS h FROM customer")
def mask_digest(spark, d):
    df = read(spark, d, "customer")
    return df.select("c_custkey", F.lower(F.hex(digest(KEY, "person_name", "text", forms.fold_ascii(F.col("c_name"))))).alias("h"))


_CELLS = f"(SELECT c_custkey, c_name, {_FOLD} AS canon FROM customer)"


@query(f"SELECT c_custkey, {SqlStream('h').below(1000)} AS a FROM (SELECT c_custkey, {_sql_digest('person_name', 'text', 'canon')} AS h FROM {_CELLS})")
def mask_intn(spark, d):
    df = read(spark, d, "customer").select("c_custkey", digest(KEY, "person_name", "text", forms.fold_ascii(F.col("c_name"))).alias("h"))
    return df.select("c_custkey", Stream(F.col("h")).below(1000).alias("a"))


def _masked(df: DataFrame, plan: dict) -> DataFrame:
    """df with planned columns masked; Python runs only for columns that hold more than ASCII."""
    texts = [c for c in plan if df.schema[c].dataType.typeName() in ("string", "array")]
    return masking.transform(df, KEY, plan, wide=masking.wide_columns(df, texts))


def _masked_query(masker: str, sql_value, limits: Limits = Limits(), category: str | None = None, suffix: str = ""):
    category = category or MASKERS[masker][0]
    name = f"mask_{masker}{suffix}"
    sql = None
    if sql_value is not None:
        sql = f"SELECT c_custkey, {sql_value} AS masked FROM (SELECT c_custkey, c_name, {_sql_digest(category, 'text', 'canon')} AS h FROM {_CELLS})"

    def run(spark, d):
        df = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("masked"))
        return _masked(df, {"masked": (masker, limits)})

    query(sql, name)(run)


def _sql(f) -> str:
    return f(SqlStream("h"))


_masked_query("person_name", _sql(lambda s: f"{s.pick(GIVEN)} || ' ' || {s.pick(SURNAME)}"))
_masked_query("person_name", _sql(lambda s: s.pick(GIVEN)), Limits(role="given"), suffix="_given")
_masked_query("email", _sql(lambda s: f"lower({s.pick(GIVEN)}) || '.' || lower({s.pick(SURNAME)}) || '@' || {s.pick(HOSTS)}"))


def _unique_email(s: SqlStream) -> str:
    local, host, tail = f"lower({s.pick(GIVEN)}) || '.' || lower({s.pick(SURNAME)})", s.pick(HOSTS), s.base32(13)
    return f"{local} || '.' || {tail} || '@' || {host}"


_masked_query("email", _sql(_unique_email), Limits(unique=True), suffix="_unique")
_masked_query("address", _sql(lambda s: f"({s.below(9000)} + 1000)::VARCHAR || ' ' || {s.pick(STREET)} || ' ' || {s.pick(SUFFIX)}"))
_masked_query("credential", "'masked-credential'")
_masked_query("credential_unique", _sql(lambda s: f"'veilcut-invalid-' || {s.base32(13)}"))
_masked_query("null", "NULL::VARCHAR")
_masked_query("derived_text", "''")
_masked_query("special_category", "'none'", Limits(labels=("none", "some")))


def _identifier_query(masker: str, sql_value: str, category: str, form: str, tag: str, column: str, table: str = "customer", key: str = "c_custkey", limits: Limits = Limits()):
    sql = f"SELECT {key}, {sql_value} AS masked FROM (SELECT {key}, {_sql_digest(category, tag, 'canon')} AS h FROM (SELECT {key}, {form} AS canon FROM {table}))"

    def run(spark, d):
        df = read(spark, d, table).select(key, F.col(column).cast("string").alias("masked"))
        return _masked(df, {"masked": (masker, limits)})

    query(sql, f"mask_{masker}")(run)


_identifier_query("phone", _sql(lambda s: f"'+1 ' || {s.pick(AREAS)} || ' 555 01' || lpad({s.below(100)}::VARCHAR, 2, '0')"), "phone", "ltrim(c_custkey::VARCHAR, '0')", "e164", "c_custkey")
_identifier_query("phone_unique", _sql(lambda s: f"'+1' || {s.digits(12)}"), "phone", "ltrim(c_custkey::VARCHAR, '0')", "e164", "c_custkey")
_identifier_query("national_id", _sql(lambda s: s.digits(9)), "national_id", "CASE WHEN c_custkey = 0 THEN '0' ELSE c_custkey::VARCHAR END", "decimal", "c_custkey")
_identifier_query("person_date", _sql(lambda s: f"(DATE '1940-01-01' + ({s.below(25568)})::INTEGER)::VARCHAR"), "person_date", "CASE WHEN strftime(o_orderdate, '%H%M%S') = '000000' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END", "date", "o_orderdate", "orders", "o_orderkey")


def _geo(s: SqlStream) -> str:
    x = f"({s.below(180000001)} - 90000000)"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END) || (abs({x}) // 1000000)::VARCHAR || '.' || lpad((abs({x}) % 1000000)::VARCHAR, 6, '0')"


@query(f"SELECT c_custkey, {_sql(_geo)} AS masked FROM (SELECT c_custkey, {_sql_digest('geo', 'number', 'canon')} AS h FROM (SELECT c_custkey, c_custkey::VARCHAR || '.0' AS canon FROM customer))")
def mask_geo(spark, d):
    return read(spark, d, "customer").select("c_custkey", masking.mask_column(KEY, "geo", F.col("c_custkey")).alias("masked"))


def _value_query(name: str, masker: str, value: Callable[[], Column], canon: str, sql_value: str, category: str, tag: str):
    """Masked values of a text made of the customer's key, against the same draws in SQL; canon: the canonical form in SQL."""

    def run(spark, d):
        return _masked(read(spark, d, "customer").select("c_custkey", value().cast("string").alias("masked")), {"masked": (masker, Limits())})

    query(f"SELECT c_custkey, {sql_value} AS masked FROM (SELECT c_custkey, c_custkey % 3 AS k, {_sql_digest(category, tag, 'canon')} AS h FROM (SELECT c_custkey, {canon} AS canon FROM customer))", name)(run)


def _luhn_end(body: str) -> str:
    odd = f"list_sum(list_transform(range(1, length({body}) + 1), lambda i: CASE WHEN (length({body}) - i) % 2 = 1 THEN substr({body}, i, 1)::INTEGER ELSE 2 * substr({body}, i, 1)::INTEGER - CASE WHEN substr({body}, i, 1)::INTEGER > 4 THEN 9 ELSE 0 END END))"
    return f"{body} || ((10 - ({odd}) % 10) % 10)::VARCHAR"


_digits15 = _sql(lambda s: s.digits(15))
QUERIES["mask_financial_account"] = lambda spark, d: _masked(read(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("masked")), {"masked": ("financial_account", Limits())})
SQL["mask_financial_account"] = f"SELECT c_custkey, {_luhn_end('body')} AS masked FROM (SELECT c_custkey, {_digits15} AS body FROM (SELECT c_custkey, {_sql_digest('financial_account', 'decimal', 'canon')} AS h FROM (SELECT c_custkey, c_custkey::VARCHAR AS canon FROM customer)))"

def _mod() -> Column:
    return F.col("c_custkey") % 3


def _raw() -> Column:
    return F.md5(F.col("c_custkey").cast("string"))


_hex4 = lambda x: f"lower(lpad(printf('%x', {x}), 4, '0'))"


def _net_sql(_: SqlStream) -> str:
    v4, v6, mac = (SqlStream("h") for _ in range(3))
    four = f"{v4.pick(('192.0.2.', '198.51.100.', '203.0.113.'))} || {v4.below(256)}::VARCHAR"
    six = "'2001:db8' || " + " || ".join(f"':' || {_hex4(v6.below(65536))}" for _ in range(6))
    return f"CASE k WHEN 0 THEN {four} WHEN 1 THEN {six} ELSE '00:00:5e:00:53:' || lpad(printf('%x', {mac.below(256)}), 2, '0') END"


_value_query(
    "mask_network_id", "network_id",
    lambda: F.when(_mod() == 0, F.concat(F.lit("010.7."), F.col("c_custkey") % 250, F.lit(".9"))).when(_mod() == 1, F.concat(F.lit("FE80::"), F.hex(F.col("c_custkey") % 65536))).otherwise(F.concat(F.lit("AA-BB-CC-DD-EE-"), F.lpad(F.hex(F.col("c_custkey") % 256), 2, "0"))),
    "CASE c_custkey % 3 WHEN 0 THEN '10.7.' || (c_custkey % 250)::VARCHAR || '.9' WHEN 1 THEN 'fe80:0000:0000:0000:0000:0000:0000:' || lower(lpad(printf('%x', c_custkey % 65536), 4, '0')) ELSE 'aa:bb:cc:dd:ee:' || lower(lpad(printf('%x', c_custkey % 256), 2, '0')) END",
    _net_sql(None), "network_id", "network",
)


def _six(s: SqlStream) -> str:
    return "'2001:db8' || " + " || ".join(f"':' || {_hex4(s.below(65536))}" for _ in range(6))


_value_query("mask_ip_unique", "ip_unique", lambda: F.col("c_name"), "trim(regexp_replace(lower(c_name), '\\s+', ' ', 'g'))", _sql(_six), "network_id", "network")


def _online_sql() -> str:
    raw = "substr(sha256(h || unhex('00000000')), 1, 32)"
    uuid = f"substr({raw}, 1, 8) || '-' || substr({raw}, 9, 4) || '-4' || substr({raw}, 14, 3) || '-' || substr('89ab', 1 + (('0x' || substr({raw}, 17, 1))::INTEGER % 4), 1) || substr({raw}, 18, 3) || '-' || substr({raw}, 21, 12)"
    url, handle = SqlStream("h"), SqlStream("h")
    return f"CASE k WHEN 0 THEN {uuid} WHEN 1 THEN 'https://example.invalid/' || {url.base32(13)} ELSE {handle.pick(FILLER)} || '_' || {handle.base32(13)} END"


_value_query(
    "mask_online_id", "online_id",
    lambda: F.when(_mod() == 0, F.concat_ws("-", F.substring(_raw(), 1, 8), F.substring(_raw(), 9, 4), F.substring(_raw(), 13, 4), F.substring(_raw(), 17, 4), F.upper(F.substring(_raw(), 21, 12)))).when(_mod() == 1, F.concat(F.lit("HTTP://Site.test:80/"), _raw())).otherwise(F.concat(F.lit("User_"), F.col("c_custkey"))),
    "CASE c_custkey % 3 WHEN 0 THEN md5(c_custkey::VARCHAR) WHEN 1 THEN 'http://site.test/' || md5(c_custkey::VARCHAR) ELSE 'user_' || c_custkey::VARCHAR END", _online_sql(), "online_id", "online",
)


def _text_sql(s: SqlStream) -> str:
    loop = " ".join(FILLER) + " "
    starts = [sum(len(w) + 1 for w in FILLER[:i]) + 1 for i in range(len(FILLER))]
    at = f"({starts!r})[1 + {s.below(len(FILLER))}]"
    rotated = f"substr('{loop}', {at}) || substr('{loop}', 1, {at} - 1)"
    return f"regexp_replace(substr(repeat({rotated}, n // {len(loop)} + 1), 1, n), ' $', 'x')"


@query(f"SELECT p_partkey, {_sql(_text_sql)} AS masked FROM (SELECT p_partkey, length(p_name) AS n, {_sql_digest('free_text', 'text', 'canon')} AS h FROM (SELECT p_partkey, p_name, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS canon FROM part))")
def mask_free_text(spark, d):
    return _masked(read(spark, d, "part").select("p_partkey", F.col("p_name").alias("masked")), {"masked": ("free_text", Limits())})


@query("SELECT doc_id, least(length(text), 4096)::INTEGER AS n FROM documents")
def mask_free_text_documents(spark, d):
    """Whole documents of any script; SQL has no NFKC, so it says their lengths only."""
    m = _masked(read(spark, d, "documents").select("doc_id", "text"), {"text": ("free_text", Limits())})
    return m.select("doc_id", F.length("text").alias("n"))


@query(f"SELECT o_orderkey, strftime(TIMESTAMP '1940-01-01' + to_days({SqlStream('h').below(25568)}::INTEGER) + to_seconds(s), '%Y-%m-%d %H:%M:%S') AS masked FROM (SELECT o_orderkey, h, {(lambda s: (s.below(25568), s.below(86400))[1])(SqlStream('h'))} AS s FROM (SELECT o_orderkey, {_sql_digest('person_date', 'date', 'canon')} AS h FROM (SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%H%M%S') = '000000' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS canon FROM orders)))")
def mask_timestamp(spark, d):
    """Dates of people in a timestamp column, written back as timestamps."""
    m = _masked(read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at")), {"at": ("person_date", Limits())})
    return m.select("o_orderkey", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("masked"))


@query(f"SELECT c_custkey, ({_sql(lambda s: s.digits(9))})::BIGINT AS masked FROM (SELECT c_custkey, {_sql_digest('national_id', 'decimal', 'canon')} AS h FROM (SELECT c_custkey, c_custkey::VARCHAR AS canon FROM customer))")
def mask_numbers(spark, d):
    """A masked whole number goes back into a whole-number column."""
    return _masked(read(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("masked")), {"masked": ("national_id", Limits())})


@query("SELECT * FROM (VALUES ('date', 'person_name'), ('bigint', 'email'), ('smallint', 'national_id'), ('boolean', 'phone')) AS t(type, masker)")
def unwritable_columns(spark, d):
    """Of eight columns those whose type can't hold the values of their masker."""
    asked = (("date", "person_name"), ("bigint", "email"), ("smallint", "national_id"), ("boolean", "phone"), ("date", "person_date"), ("bigint", "phone"), ("decimal(9,6)", "geo"), ("boolean", "null"))
    out = []
    for kind, masker in asked:
        df = read(spark, d, "customer").select(F.lit(None).cast(kind).alias("x"))
        out += [(kind, masker)] if masking.unwritable(df, {"x": (masker, Limits())}) else []
    return spark.createDataFrame(out, "type string, masker string")


# ---------------------------------------------------------------- canonical forms


@query("SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR || '5550100') = 10 THEN '+1' || c_custkey::VARCHAR || '5550100' ELSE ltrim(c_custkey::VARCHAR || '5550100', '0') END AS canon FROM customer")
def canonical_phone(spark, d):
    x = F.concat(F.lit("("), F.col("c_custkey"), F.lit(") 555-0100"))
    return read(spark, d, "customer").select("c_custkey", forms.phone(x).alias("canon"))


@query("SELECT c_custkey, c_custkey::VARCHAR AS canon, 'decimal' AS tag FROM customer")
def canonical_identifier(spark, d):
    x = F.concat(F.lit("00-"), F.col("c_custkey"))
    return read(spark, d, "customer").select("c_custkey", forms.alnum(x).alias("canon"), forms.alnum_tag(x).alias("tag"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS canon FROM orders")
def canonical_date(spark, d):
    k, x = F.col("o_orderkey") % 3, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(x, "yyyy-MM-dd")).when(k == 1, F.date_format(x, "dd.MM.yyyy")).otherwise(F.date_format(x, "yyyyMMdd"))
    return read(spark, d, "orders").select("o_orderkey", forms.person_date(text).alias("canon"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS canon FROM part")
def canonical_fold(spark, d):
    x = F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t "))
    return read(spark, d, "part").select("p_partkey", forms.fold(x).alias("canon"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '2001:0db8:0000:0000:0000:0000:0000:' || lower(lpad(printf('%x', c_custkey % 65536), 4, '0')) WHEN 1 THEN '0000:0000:0000:0000:0000:ffff:0a01:' || lower(lpad(printf('%x', (c_custkey % 250) * 256 + 7), 4, '0')) WHEN 2 THEN '10.' || (c_custkey % 250)::VARCHAR || '.0.0/16' ELSE '2001:0db8:' || lower(lpad(printf('%x', c_custkey % 65536), 4, '0')) || ':0000:0000:0000:0000:0000/48' END AS canon FROM customer")
def canonical_network(spark, d):
    k, low = F.col("c_custkey") % 4, F.hex(F.col("c_custkey") % 65536)
    v = F.when(k == 0, F.concat(F.lit("2001:DB8::"), low)).when(k == 1, F.concat(F.lit("::ffff:10.1."), F.col("c_custkey") % 250, F.lit(".7"))).when(k == 2, F.concat(F.lit("10."), F.col("c_custkey") % 250, F.lit(".3.4/16"))).otherwise(F.concat(F.lit("2001:db8:"), low, F.lit(":9::1/48")))
    return read(spark, d, "customer").select("c_custkey", forms.network(v).alias("canon"))


def canonical_fold_all(spark: SparkSession, d: str) -> DataFrame:
    """The fold of all documents; NFKC and full case folding can't be said in SQL, tests hold it against Python's."""
    return read(spark, d, "documents").select("doc_id", forms.fold(F.col("text")).alias("canon"))


QUERIES["canonical_fold_all"] = canonical_fold_all


# ---------------------------------------------------------------- validators over tokens of documents

_TOKENS = r"(SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents)"


def _tokens(spark, d):
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return read(spark, d, "documents").select("doc_id", F.explode(words).alias("w"))


def _detect(name: str, sql: str, tokens: str = _TOKENS):
    def run(spark, d):
        return _tokens(spark, d).where(v.VALIDATORS[name][0](F.col("w"))).groupBy("doc_id").agg(F.count("*").alias("n_hits"))

    query(f"SELECT doc_id, count(*) AS n_hits FROM {tokens} WHERE {sql} GROUP BY doc_id", f"detect_{name}")(run)


_detect("email", r"regexp_full_match(w, '[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+')")
_detect("ip", r"regexp_full_match(w, '([0-9]{1,3}[.]){3}[0-9]{1,3}') AND list_bool_and(list_transform(string_split(w, '.'), lambda p: p::INTEGER <= 255))")
_LUHN = "list_sum(list_transform(range(1, length(w) + 1), lambda i: CASE WHEN (length(w) - i) % 2 = 0 THEN substr(w, i, 1)::INTEGER ELSE 2 * substr(w, i, 1)::INTEGER - CASE WHEN substr(w, i, 1)::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_ISSUER = "list_bool_or(list_transform([" + ", ".join(f"{{'lo': '{lo}', 'hi': '{hi}'}}" for lo, hi, _ in v.CARDS) + "], lambda r: substr(w, 1, length(r.lo)) BETWEEN r.lo AND r.hi))"
_detect("card", f"regexp_full_match(w, '[0-9]{{12,19}}') AND {_ISSUER} AND CASE WHEN regexp_full_match(w, '[0-9]{{12,19}}') THEN {_LUHN} ELSE false END", f"(SELECT doc_id, regexp_replace(w, '[ ./\u00a0-]', '', 'g') AS w FROM {_TOKENS})")


# values of twelve kinds made of the customers' keys, so that every validator has hits and misses
def _k() -> Column:
    return F.col("c_custkey")


def _contact() -> tuple[Column, ...]:
    return (
        F.concat(F.lit("user"), _k(), F.lit("@site.test")),
        F.concat(F.lit("+1 212 555 "), F.lpad((_k() % 10000).cast("string"), 4, "0")),
        F.regexp_replace(F.substring(F.md5(_k().cast("string")), 1, 12), "(..)(..)(..)(..)(..)(..)", "$1:$2:$3:$4:$5:$6"),
        F.concat(F.lpad((_k() * 7 % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad((_k() % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((_k() % 10000).cast("string"), 4, "0")),
        F.concat(F.lit("https://site.test/"), _k()),
        F.regexp_replace(F.md5(_k().cast("string")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"),
        F.concat(F.lit("4"), F.lpad(_k().cast("string"), 15, "0")),
        F.md5(_k().cast("string")),
        F.concat(_k().cast("string"), F.lit(" Oak Street")),
        F.concat(F.char(_k() % 26 + 65), F.char(_k() % 7 + 97)),
        F.concat(F.element_at(F.array(*map(F.lit, GIVEN)), (_k() % len(GIVEN) + 1).cast("int")), F.lit(" "), F.element_at(F.array(*map(F.lit, SURNAME)), (_k() % len(SURNAME) + 1).cast("int"))),
        F.concat(F.lit("my diagnosis is "), _k()),
    )


_CONTACT_SQL = (
    "'user' || c_custkey || '@site.test'", "'+1 212 555 ' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')", "regexp_replace(substr(md5(c_custkey::VARCHAR), 1, 12), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')",
    "lpad((c_custkey * 7 % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')", "'https://site.test/' || c_custkey",
    "regexp_replace(md5(c_custkey::VARCHAR), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5')", "'4' || lpad(c_custkey::VARCHAR, 15, '0')", "md5(c_custkey::VARCHAR)", "c_custkey || ' Oak Street'",
    "chr((c_custkey % 26 + 65)::INTEGER) || chr((c_custkey % 7 + 97)::INTEGER)", f"({list(GIVEN)!r})[c_custkey % {len(GIVEN)} + 1] || ' ' || ({list(SURNAME)!r})[c_custkey % {len(SURNAME)} + 1]", "'my diagnosis is ' || c_custkey",
)
_CONTACTS = "(SELECT c_custkey % 12 AS kind, CASE c_custkey % 12 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_CONTACT_SQL)) + " END AS w FROM customer)"


def _contacts(spark, d, spoil=None) -> DataFrame:
    x = F.lit(None).cast("string")
    for i in reversed(range(12)):
        x = F.when(_k() % 12 == i, _contact()[i]).otherwise(x)
    return read(spark, d, "customer").select((_k() % 12).alias("kind"), (spoil(x) if spoil else x).alias("w"))


def _detect_kinds(name: str, sql: str, validator: str | None = None):
    def run(spark, d):
        return _contacts(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(v.VALIDATORS[validator or name][0](F.col("w"))).alias("n_hits"))

    query(f"SELECT kind, count(*) AS n, count(*) FILTER ({sql}) AS n_hits FROM {_CONTACTS} GROUP BY kind", f"detect_{name}")(run)


_ENTROPY = "-list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: (length(w) - length(replace(w, c, ''))) / length(w) * log2((length(w) - length(replace(w, c, ''))) / length(w))))"
_NAMES = list(dict.fromkeys(x.lower() for x in GIVEN + SURNAME))
_IS_EMAIL = r"regexp_full_match(w, '[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+')"
_IS_URL = r"regexp_full_match(w, '[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+\S*')"
_IS_UUID = "regexp_full_match(w, '[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}')"
_IS_SSN = "regexp_full_match(w, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND substr(w, 1, 3) NOT IN ('000', '666') AND substr(w, 1, 1) <> '9' AND substr(w, 5, 2) <> '00' AND substr(w, 8, 4) <> '0000'"
_IS_SECRET = f"length(w) BETWEEN 16 AND 512 AND NOT {_IS_EMAIL} AND NOT {_IS_URL} AND NOT {_IS_UUID} AND NOT regexp_matches(w, '\\s') AND CASE WHEN regexp_full_match(w, '[0-9a-fA-F]{{32,}}') THEN {_ENTROPY} >= 3.0 ELSE regexp_matches(w, '[a-z]')::INTEGER + regexp_matches(w, '[A-Z]')::INTEGER + regexp_matches(w, '[0-9]')::INTEGER + regexp_matches(w, '[^A-Za-z0-9]')::INTEGER >= 2 AND {_ENTROPY} >= 3.2 END"
_detect_kinds("email_kinds", _IS_EMAIL, "email")
_detect_kinds("phone", r"regexp_full_match(w, '[+][1-9][0-9 ().-]{6,}') AND length(regexp_replace(w, '[^0-9]', '', 'g')) BETWEEN 8 AND 15")
_detect_kinds("mac", "regexp_full_match(w, '([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}')")
_detect_kinds("ssn", _IS_SSN)
_detect_kinds("url", f"{_IS_URL} AND length(w) <= 2048")
_detect_kinds("uuid", _IS_UUID)
_detect_kinds("card_issuers", f"regexp_full_match(w, '[0-9]{{12,19}}') AND {_ISSUER} AND CASE WHEN regexp_full_match(w, '[0-9]{{12,19}}') THEN {_LUHN} ELSE false END", "card")
_detect_kinds("secret", _IS_SECRET)
_detect_kinds("address", r"length(w) <= 200 AND regexp_matches(w, '[0-9]') AND len(regexp_extract_all(w, '\pL{2,}')) >= 2")
_detect_kinds("two_letters", r"regexp_full_match(w, '\pL{2}')")
_detect_kinds("name", f"octet_length(encode(w)) <= 64 AND len(regexp_extract_all(lower(w), '[^ \\-''.,]+')) BETWEEN 1 AND 3 AND list_bool_and(list_transform(regexp_extract_all(lower(w), '[^ \\-''.,]+'), lambda x: list_contains({_NAMES!r}, x)))")
_detect_kinds("special", "regexp_matches(w, '(?i)\\b(" + "|".join(v.SPECIAL) + ")\\b')")


@query(f"SELECT kind, count(*) AS n, count(*) FILTER (kind = 0) AS n_hits FROM {_CONTACTS} GROUP BY kind")
def detect_spelled_email(spark, d):
    """Addresses in other spellings: `at` and `dot` in words or brackets, percent and Base64 encodings, a scheme, angle brackets, full-width signs."""
    k = _k() % 7
    spoil = lambda x: (
        F.when(k == 0, F.regexp_replace(F.regexp_replace(x, "@", " (at) "), "[.]", " dot ")).when(k == 1, F.regexp_replace(x, "@", "%40")).when(k == 2, F.base64(F.encode(x, "UTF-8")))
        .when(k == 3, F.concat(F.lit("mailto:"), x)).when(k == 4, F.concat(F.lit("Name <"), x, F.lit(">"))).when(k == 5, F.translate(x, "@u", "\uff20\uff55")).otherwise(F.regexp_replace(x, "@", r"\\u0040"))
    )
    return _contacts(spark, d, spoil).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(v.any_spelling(v.email)(F.col("w"))).alias("n_hits"))


@query("SELECT c_custkey, c_custkey % 6 < 5 AS spared FROM customer")
def identifier_shapes(spark, d):
    """Versions, digests, hosts, paths and files, and sentences."""
    k = _k() % 6
    x = F.when(k == 0, F.concat(F.lit("1."), _k(), F.lit(".3"))).when(k == 1, F.md5(_k().cast("string"))).when(k == 2, F.concat(F.lit("host"), _k(), F.lit(".test"))).when(k == 3, F.concat(F.lit("/var/log/"), _k())).when(k == 4, F.concat(F.lit("file"), _k(), F.lit(".txt"))).otherwise(F.concat(F.lit("customer number "), _k()))
    return read(spark, d, "customer").select("c_custkey", v.identifier(x).alias("spared"))


def _weights(weights, n: int) -> str:
    return " + ".join(f"{w} * substr(x, {i}, 1)::INTEGER" for i, w in enumerate(weights[:n], 1))


_NUMBERS = "(SELECT lpad((c_custkey * 7919 % 100000000000)::VARCHAR, 11, '0') AS e, lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS n FROM customer)"
_SUMS = {
    "pesel": ("e", f"(10 - ({_weights((1, 3, 7, 9, 1, 3, 7, 9, 1, 3), 10)}) % 10) % 10 = substr(x, 11, 1)::INTEGER"),
    "bsn": ("n", f"({_weights((9, 8, 7, 6, 5, 4, 3, 2, -1), 9)}) % 11 = 0"),
    "tfn": ("n", f"({_weights((1, 4, 3, 7, 5, 8, 6, 9, 10), 9)}) % 11 = 0"),
    "sin": ("n", _LUHN.replace("w", "x")),
    "cpf": ("e", f"(({_weights(tuple(range(10, 1, -1)), 9)}) * 10 % 11) % 10 = substr(x, 10, 1)::INTEGER AND (({_weights(tuple(range(11, 1, -1)), 10)}) * 10 % 11) % 10 = substr(x, 11, 1)::INTEGER"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS validator, count(*) AS n, count(*) FILTER (({test}) AND NOT regexp_full_match(x, '({'|'.join(f'{i}+' for i in range(10))})')) AS n_valid FROM (SELECT {col} AS x FROM {_NUMBERS})" for k, (col, test) in _SUMS.items()))
def checksums(spark, d):
    """Numbers of which about one in ten has the check digits of a national id."""
    n = read(spark, d, "customer").select(F.lpad((_k() * 7919 % 100000000000).cast("string"), 11, "0").alias("e"), F.lpad((_k() * 7919 % 1000000000).cast("string"), 9, "0").alias("n"))
    out = None
    for k, (col, _) in _SUMS.items():
        one = n.agg(F.lit(k).alias("validator"), F.count("*").alias("n"), F.count_if(v.VALIDATORS[k][0](F.col(col))).alias("n_valid"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT doc_id, count(*) AS n_hits FROM {_TOKENS} WHERE {_IS_SECRET} AND NOT regexp_full_match(w, 'v?[0-9]+[.][0-9]+[.][0-9]+([-+][0-9A-Za-z.-]+)?') GROUP BY doc_id")
def secret_tokens(spark, d):
    return _tokens(spark, d).where(v.secret(F.col("w"))).groupBy("doc_id").agg(F.count("*").alias("n_hits"))


@query("SELECT c_custkey, round(-list_sum(list_transform(list_distinct(string_split(c_name, '')), lambda c: (length(c_name) - length(replace(c_name, c, ''))) / length(c_name) * log2((length(c_name) - length(replace(c_name, c, ''))) / length(c_name)))), 6) AS bits FROM customer")
def entropy(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.round(v.entropy(F.col("c_name")), 6).alias("bits"))


_NET = {"email": (_IS_EMAIL, True), "ssn": (_IS_SSN, True), "mac": ("regexp_full_match(w, '([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}')", True), "secret": (_IS_SECRET, False)}


@query(" UNION ALL ".join(f"SELECT '{k}' AS validator, count(*) AS n_values, count(*) FILTER ({test}) AS n_hits, count(*) FILTER ({test}) > 0 AND {str(proof).lower()} AS fails FROM {_CONTACTS}" for k, (test, proof) in _NET.items()))
def second_net_hits(spark, d):
    """The second net over a column of mixed contacts: one proof is enough, a secret's shape needs most of the values."""
    return verify.second_net(_contacts(spark, d), ["w"]).where(F.col("validator").isin(*_NET)).select("validator", "n_values", "n_hits", "fails")


_CHECKED = (("pesel", "44051401359"), ("bsn", "111222333"), ("dni", "12345678Z"), ("cpf", "52998224725"), ("sin", "046454286"), ("tfn", "123456782"), ("nir", "255081416802538"), ("aadhaar", "234123412346"), ("codice_fiscale", "RSSMRA85T10A562S"), ("nino", "AB123456C"), ("iban", "GB82WEST12345698765432"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS validator, true AS plain, false AS changed" for n, _ in _CHECKED))
def checksums_known(spark, d):
    """Known good numbers, and the same with the last sign changed."""
    out = None
    for n, x in _CHECKED:
        last = "1" if x[-1] != "1" else "2"
        wrong = x[:-1] + (last if x[-1].isdigit() else ("B" if x[-1] == "A" else "E" if n == "nino" else "A"))
        one = spark.range(1).select(F.lit(n).alias("validator"), F.lit(x).alias("a"), F.lit(wrong).alias("b"))
        f = v.VALIDATORS[n][0]
        one = one.select("validator", f(F.col("a")).alias("plain"), f(F.col("b")).alias("changed"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- classification


@query("SELECT 'customer' AS table_name, 'c_name' AS column_name, 'person_name' AS category, true AS masked")
def classify_columns(spark, d):
    catalog, frames = catalogs.load(spark, d, CORE)
    prefixes = {"customer": "c_", "supplier": "s_", "part": "p_", "nation": "n_", "region": "r_", "orders": "o_", "lineitem": "l_"}
    rows = classification.report(spark, classification.classify(catalog, frames, prefixes=prefixes))
    return rows.where("masked").select("table_name", "column_name", "category", "masked")


_PEOPLE = (
    ("people", "id", "none", "none", False), ("people", "email", "email", "certain", True), ("people", "contact", "phone", "likely", True), ("people", "ssn", "national_id", "certain", True), ("people", "remark", "free_text", "possible", True),
    ("people", "segment", "none", "none", False), ("people", "boss_email", "email", "certain", True), ("people", "profile", "semi_structured", "likely", True), ("visits", "id", "none", "none", False), ("visits", "person_email", "email", "certain", True),
)


@query("SELECT * FROM (VALUES " + ", ".join(str(x).replace("True", "true").replace("False", "false") for x in _PEOPLE) + ") AS t(table_name, column_name, category, confidence, masked)")
def classify_people(spark, d):
    """Names and values that agree, values under another name, unknown text beside certain columns, an enumeration, a document, a reference."""
    c = read(spark, d, "customer")
    mail = F.concat(F.lit("u"), _k(), F.lit("@site.test"))
    ssn = F.concat(F.lpad((_k() % 600 + 1).cast("string"), 3, "0"), F.lit("-12-"), F.lpad((_k() % 9000 + 1).cast("string"), 4, "0"))
    people = c.select(
        _k().alias("id"), mail.alias("email"), F.concat(F.lit("+1 212 555 "), F.lpad((_k() % 10000).cast("string"), 4, "0")).alias("contact"), ssn.alias("ssn"), F.concat(F.lit("met "), F.translate(F.md5(_k().cast("string")), "0123456789", "ghijklmnop")).alias("remark"),
        F.col("c_mktsegment").alias("segment"), mail.alias("boss_email"), F.concat(F.lit('{"plan":"gold","mail":"'), mail, F.lit('"}')).alias("profile"),
    )
    visits = c.select(_k().alias("id"), mail.alias("person_email"))
    frames = {"people": people, "visits": visits}
    specs = tuple(Table(n, tuple(Spec(f.name, f.dataType.simpleString(), f.name != "id") for f in df.schema.fields), ("id",), (Index("mail", ("email",)),) if n == "people" else ()) for n, df in frames.items())
    catalog = Catalog(specs, (ForeignKey("visits_person", "visits", ("person_email",), "people", ("email",)),))
    return classification.report(spark, classification.classify(catalog, frames)).select("table_name", "column_name", "category", "confidence", "masked")


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_distinct, count(*) = count(DISTINCT o_custkey) AS all_distinct FROM orders")
def sample_distinctness(spark, d):
    return verify.sample_distinct(read(spark, d, "orders"), "o_custkey")


# ---------------------------------------------------------------- nested values


def _shape_sql(most: int = 12) -> str:
    """A number's digits drawn anew: the first from 1 to 9 unless it is zero, the others from 0 to 9."""
    s, out = SqlStream("h"), []
    for i in range(most):
        plain = SqlStream("h")
        plain.at = i
        first = f"({plain.below(9)} + 1)" if i == 0 else None
        out.append(f"CASE WHEN length(x) <= {i} THEN '' ELSE {(f'CASE WHEN x[1] = {chr(39)}0{chr(39)} THEN {chr(39)}0{chr(39)} ELSE {first}::VARCHAR END') if i == 0 else f'{plain.below(10)}::VARCHAR'} END")
    return " || ".join(out)


@query(f"SELECT event_id, '{{\"k\":' || ({_shape_sql()}) || '}}' AS masked FROM (SELECT event_id, x, {_sql_digest('national_id', 'number', 'x')} AS h FROM (SELECT event_id, json_extract_string(props, '$.k') AS x FROM events))")
def mask_json_props(spark, d):
    return read(spark, d, "events").select("event_id", masking.mask_json(KEY, F.col("props"), {"k": "national_id"}).alias("masked"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS kept, true AS others_masked FROM events")
def mask_json_leaves(spark, d):
    """A leaf below keys known to hold nothing is copied; leaves with the shape of personal data, and unknown ones, are not, at any depth and size."""
    deep = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"who":"u'), F.col("event_id"), F.lit('@site.test","more":' + '{"a":' * 20 + '"text"' + "}" * 20 + "}"))
    m = read(spark, d, "events").select("event_id", masking.mask_json(KEY, deep, {"k": "none", "who": "none"}).alias("m"))
    inside = "$.more" + ".a" * 20
    masked = ~F.contains("m", F.lit("@site.test")) & (F.get_json_object("m", inside) != "text")
    return m.select("event_id", F.get_json_object("m", "$.k").alias("kept"), masked.alias("others_masked"))


_PROPS = f"SELECT event_id, '{{\"k\":\"' || {_sql(lambda s: s.digits(9))} || '\"}}' AS masked FROM (SELECT event_id, {_sql_digest('national_id', 'decimal', 'canon')} AS h FROM (SELECT event_id, CASE WHEN json_extract_string(props, '$.k') ~ '^0+$' THEN '0' ELSE ltrim(json_extract_string(props, '$.k'), '0') END AS canon FROM events))"


@query(_PROPS)
def mask_flat_json(spark, d):
    return read(spark, d, "events").select("event_id", masking.mask_flat_json(KEY, F.col("props"), "national_id", ["k"]).alias("masked"))


_NAME_SQL = _sql(lambda s: f"{s.pick(GIVEN)} || ' ' || {s.pick(SURNAME)}")


@query(f"SELECT c_custkey, [{_NAME_SQL}, NULL, {_NAME_SQL}] AS masked FROM (SELECT c_custkey, {_sql_digest('person_name', 'text', 'canon')} AS h FROM {_CELLS})")
def mask_array(spark, d):
    df = read(spark, d, "customer").select("c_custkey", F.array("c_name", F.lit(None).cast("string"), F.upper("c_name")).alias("masked"))
    return _masked(df, {"masked": ("person_name", Limits())})


@query(f"SELECT c_custkey, [[{_NAME_SQL}], NULL, [NULL, {_NAME_SQL}]] AS masked FROM (SELECT c_custkey, {_sql_digest('person_name', 'text', 'canon')} AS h FROM {_CELLS})")
def mask_nested_array(spark, d):
    one, none = F.array("c_name"), F.lit(None).cast("array<string>")
    df = read(spark, d, "customer").select("c_custkey", F.array(one, none, F.array(F.lit(None).cast("string"), F.lower("c_name"))).alias("masked"))
    return _masked(df, {"masked": ("person_name", Limits())})


# ---------------------------------------------------------------- residual


def _masked_customers(spark, d) -> DataFrame:
    """Customers with masked names, written as a run writes them before it checks them."""
    return durable(_masked(read(spark, d, "customer"), {"c_name": ("person_name", Limits())}), "masked-customers")


@query("SELECT 'c_name' AS column_name, count(*) AS n_values, 0::BIGINT AS n_residual FROM customer")
def residual_hits(spark, d):
    return verify.residual(read(spark, d, "customer"), _masked_customers(spark, d), "c_name", forms.fold_ascii)


@query("SELECT count(*) AS n_values, count(*) FILTER (c_nationkey < 5) AS n_residual, 'c_name' AS column_name FROM customer")
def residual_found(spark, d):
    df, m = read(spark, d, "customer"), _masked_customers(spark, d)
    leaky = m.where("c_nationkey >= 5").unionByName(df.where("c_nationkey < 5"))
    return verify.residual(df, leaky, "c_name", forms.fold_ascii)


@query("SELECT count(*) FILTER (c_nationkey = 7)::BIGINT AS n_unexplained, count(*) FILTER (c_nationkey = 7) AS n_same_row FROM customer")
def emitted_vs_target(spark, d):
    """Names that the target holds more often than masking gave them, and rows that kept their own: those of nation 7, left in clear."""
    df, m = read(spark, d, "customer"), _masked_customers(spark, d)
    leaky = m.where("c_nationkey <> 7").unionByName(df.where("c_nationkey = 7"))
    emitted = masking.emitted_counts(df, KEY, "c_name", "person_name")
    return verify.vocabulary_explained(df, leaky, ("c_custkey",), "c_name", emitted, forms.fold_ascii)


@query("SELECT 0::BIGINT AS n_differing")
def invariant_masking_repeats(spark, d):
    """Equal inputs mask alike, whatever the partitions."""
    df = read(spark, d, "customer").select("c_custkey", "c_name")
    a = _masked(df, {"c_name": ("person_name", Limits())})
    b = _masked(df.repartition(7, "c_name"), {"c_name": ("person_name", Limits())}).withColumnRenamed("c_name", "other")
    return a.join(b, "c_custkey").agg(F.count_if(F.col("c_name") != F.col("other")).alias("n_differing"))


@query("SELECT c_mktsegment, count(*) AS n, 1::BIGINT AS n_masked FROM customer GROUP BY 1")
def invariant_joins_survive_masking(spark, d):
    df = read(spark, d, "customer")
    m = df.select("c_mktsegment", masking.mask_column(KEY, "online_id", F.col("c_mktsegment")).alias("m"))
    g = m.groupBy("c_mktsegment", "m").agg(F.count("*").alias("n"))
    return g.groupBy("c_mktsegment").agg(F.sum("n").alias("n"), F.count("*").alias("n_masked"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A subset of 50 customers with masked names: (table_name, mode, n_rows, n_orphans)."""
    catalog, frames, steps = _walk(spark, d, cap=10)
    held = {n: closure.selected_rows(frames[n], s.keys, s.identity) for n, s in steps.items()}
    held["customer"] = _masked(held["customer"], {"c_name": ("person_name", Limits())})
    orphans = verify.fk_report(catalog, held).groupBy("child").agg(F.sum("n_orphans").alias("n_orphans"))
    counts = verify.row_counts(steps, held)
    return counts.join(orphans, counts["table_name"] == orphans["child"], "left").select("table_name", "mode", F.col("loaded").alias("n_rows"), F.coalesce("n_orphans", F.lit(0)).cast("long").alias("n_orphans"))


QUERIES["flagship"] = flagship
_COUNTS = SQL["subset_closure_counts"].replace("rn <= 5", "rn <= 10")
SQL["flagship"] = f"SELECT *, 0::BIGINT AS n_orphans FROM ({_COUNTS})"
