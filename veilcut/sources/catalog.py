"""The declared catalog of a folder of Parquet tables, table readers and the introspection report.

A folder's own catalog is the file `_catalog.json` in it, or a document of this form given to `load`:

    {"tables": {"users": {"primary_key": ["id"], "framework": false,
                          "columns": {"email": {"nullable": false, "max_len": 80, "labels": [], "checks": ["..."], "default": null, "generated": null}},
                          "indexes": [{"name": "users_email", "columns": ["email"], "unique": true, "partial": false, "expression": false}],
                          "sequences": ["id"]}},
     "foreign_keys": [{"child": "posts", "columns": ["user_id"], "parent": "users", "parent_columns": ["id"], "name": "...", "match_full": false, "validated": true}]}

Columns and types come from the Parquet schema; everything the file doesn't say has the defaults of model.Column, model.Index and
model.ForeignKey.  A folder without the file has the tables of its `*.parquet`, and of the test tables the keys and edges below.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Catalog, Column, ForeignKey, Index, Refusal, Table

#: Primary keys and NOT NULL columns that Parquet doesn't record.
PRIMARY = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "pages": ("page_id",),
    "benchmark": ("item_id",), "embeddings": ("vec_id",), "conversations": ("conv_id", "turn"),
}
LINEITEM_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
#: (child, columns, parent, columns)
EDGES = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("events", "user_id", "customer", "c_custkey"),
    ("labels", "doc_id", "documents", "doc_id"),
)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "benchmark", "embeddings", "conversations")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int, **options: str) -> DataFrame:
    """A database table in `parts` ranges of a numeric key; filters and columns are pushed to the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    return reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts).load()


def table_names(spark: SparkSession, folder: str) -> list[str]:
    """The tables of a folder: its `<name>.parquet` files or folders."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(n[: -len(".parquet")] for x in found if (n := x.getPath().getName()).endswith(".parquet"))


def declared(spark: SparkSession, folder: str) -> dict | None:
    """The document in `_catalog.json` of a folder, if there is one."""
    from .sink import _text

    text = _text(spark, f"{folder.rstrip('/')}/_catalog.json")
    return None if text is None else json.loads(text)


def _from_document(document: dict, frames: dict[str, DataFrame]) -> Catalog:
    specs, problems = [], []
    for name, df in frames.items():
        t = document.get("tables", {}).get(name, {})
        said = t.get("columns", {})
        problems += [f"{name}.{c} of the catalog isn't in the table" for c in [*said, *t.get("primary_key", [])] if c not in df.columns]
        columns = []
        for f in df.schema.fields:
            own = {k: tuple(v) if isinstance(v, list) else v for k, v in said.get(f.name, {}).items()}
            columns.append(Column(f.name, f.dataType.simpleString(), **({"nullable": f.name not in t.get("primary_key", ())} | own)))
        indexes = tuple(Index(i["name"], tuple(i["columns"]), i.get("unique", True), i.get("partial", False), i.get("expression", False)) for i in t.get("indexes", ()))
        specs.append(Table(name, tuple(columns), tuple(t.get("primary_key", ())), indexes, t.get("rows"), t.get("framework", False), tuple(t.get("sequences", ()))))
    edges = []
    for f in document.get("foreign_keys", ()):
        if f["child"] in frames and f["parent"] in frames:
            name = f.get("name") or f"{f['child']}_{'_'.join(f['columns'])}_fkey"
            edges.append(ForeignKey(name, f["child"], tuple(f["columns"]), f["parent"], tuple(f["parent_columns"]), f.get("validated", True), f.get("match_full", False)))
            problems += [f"{t}.{c} of {name} isn't in the table" for t, cs in ((f["child"], f["columns"]), (f["parent"], f["parent_columns"])) for c in cs if c not in frames[t].columns]
    if problems:
        raise Refusal(sorted(set(problems)), code=2)
    return Catalog(tuple(specs), tuple(edges))


def load(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] | None = TABLES, document: dict | None = None) -> tuple[Catalog, dict[str, DataFrame]]:
    """The catalog and the (unread) tables of a folder; only Parquet footers are touched.  tables: None for all that the folder has."""
    document = document or (declared(spark, sf_dir) if tables is None else None)
    tables = tuple(table_names(spark, sf_dir)) if tables is None else tables
    frames = {t: read(spark, sf_dir, t) for t in tables}
    if document is not None:
        return _from_document(document, frames), frames
    required = {c for _, c, _, _ in EDGES} | {k for ks in PRIMARY.values() for k in ks} | set(LINEITEM_KEY)
    specs = tuple(
        Table(t, tuple(Column(f.name, f.dataType.simpleString(), f.name not in required) for f in df.schema.fields), PRIMARY.get(t, ())) for t, df in frames.items()
    )
    edges = tuple(ForeignKey(f"{c}_{col}_fkey", c, (col,), p, (pc,)) for c, col, p, pc in EDGES if c in tables and p in tables)
    return Catalog(specs, edges), frames


def with_rows(catalog: Catalog, frames: dict[str, DataFrame]) -> Catalog:
    """The catalog with the number of rows of each table, from Parquet footers."""
    from dataclasses import replace

    return replace(catalog, tables=tuple(replace(t, rows=frames[t.name].count()) for t in catalog.tables))


def snapshot(spark: SparkSession, frames: dict[str, DataFrame]) -> dict[str, str]:
    """A fingerprint of the files each table was opened with (names, sizes, times): a run reads these, whatever is added later."""
    out = {}
    for name, df in frames.items():
        parts = []
        for f in sorted(df.inputFiles()):
            p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(f))
            status = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
            parts.append(f"{f}\x1f{status.getLen()}\x1f{status.getModificationTime()}")
        out[name] = hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]
    return out


def introspect(spark: SparkSession, catalog: Catalog, frames: dict[str, DataFrame]) -> DataFrame:
    """One row a column: table, position, column, type, nullable, in key, referenced table, rows of the table (counted in Spark)."""
    counts = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    rows = []
    for t in catalog.tables:
        refs = {c: f.parent for f in catalog.outgoing(t.name) for c in f.child_columns}
        rows += [(t.name, i, c.name, c.type, c.nullable, c.name in t.primary_key, refs.get(c.name)) for i, c in enumerate(t.columns)]
    columns = spark.createDataFrame(rows, "table_name string, position int, column_name string, type string, nullable boolean, in_key boolean, parent string")
    return columns.join(counts, "table_name")
