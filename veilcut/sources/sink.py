"""Targets: the gate before writing, staged Parquet output, run records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..model import Catalog, Refusal


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _text(spark: SparkSession, path: str) -> str | None:
    jvm, p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def gate(spark: SparkSession, source: str, target: str, fingerprint: str) -> None:
    """Refuse a target inside, around or equal to the source (as the file system names both), or one that is neither empty nor marked by a run of this schema."""
    whole = lambda path: str((x := _fs(spark, path))[2].makeQualified(x[1])).rstrip("/")
    a, b = whole(source), whole(target)
    if a == b or b.startswith(a + "/") or a.startswith(b + "/"):
        raise Refusal(["the target lies in the source"], code=7)
    _, p, fs = _fs(spark, target)
    if fs.exists(p) and len([x for x in fs.listStatus(p) if x.getPath().getName() != LEASE]):
        record = _text(spark, f"{target.rstrip('/')}/_run.json")
        if record is None or json.loads(record).get("schema") != fingerprint:
            raise Refusal(["the target isn't empty and has no marker of this schema"], code=7)


LEASE = "_lease"


class lease:
    """One run at a time writes to a target: a file that only one can create, taken away at the end."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.path = spark, f"{target.rstrip('/')}/{LEASE}"

    def __enter__(self):
        _, p, fs = _fs(self.spark, self.path)
        try:
            fs.create(p, False).close()
        except Exception as e:
            raise Refusal([f"another run holds {self.path}, or has died with it"], code=7) from e
        return self

    def __exit__(self, *_):
        _, p, fs = _fs(self.spark, self.path)
        fs.delete(p, False)


def write(df: DataFrame, target: str, table: str) -> DataFrame:
    """Write a table to a staging folder and rename it into place; what was there goes only when the new table stands.  Returns what was written."""
    spark, staged, final, old = df.sparkSession, f"{target}/_staging/{table}", f"{target}/{table}.parquet", f"{target}/_staging/{table}.old"
    df.write.mode("overwrite").parquet(staged)
    jvm, p, fs = _fs(spark, staged)
    to, back = jvm.org.apache.hadoop.fs.Path(final), jvm.org.apache.hadoop.fs.Path(old)
    fs.delete(back, True)
    had = fs.exists(to)
    if had and not fs.rename(to, back):
        raise OSError(f"can't move {final} aside")
    if not fs.rename(p, to):
        if had:
            fs.rename(back, to)
        raise OSError(f"can't move {staged}")
    fs.delete(back, True)
    return spark.read.parquet(final)


def put(spark: SparkSession, path: str, text: str) -> None:
    _, p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _ddl_type(kind: str, most: int | None) -> str:
    return f"varchar({most})" if kind == "string" and most else kind


def schema_document(catalog: Catalog, order: list[str]) -> dict:
    """What a database needs to hold the subset: statements before the data (tables) and after it (keys, indexes, foreign keys), in load order."""
    before, after = [], []
    for name in order:
        t = catalog.table(name)
        lines = []
        for c in t.columns:
            line = f"{c.name} {_ddl_type(c.type, c.max_len)}"
            line += f" GENERATED ALWAYS AS ({c.generated})" if c.generated else f" DEFAULT {c.default}" if c.default else ""
            lines.append(line + ("" if c.nullable else " NOT NULL") + "".join(f" CHECK ({k})" for k in c.checks))
        before.append(f"CREATE TABLE {name} (" + ", ".join(lines) + ")")
        if t.primary_key:
            after.append(f"ALTER TABLE {name} ADD PRIMARY KEY ({', '.join(t.primary_key)})")
        after += [f"CREATE {'UNIQUE ' if i.unique else ''}INDEX {i.name} ON {name} ({', '.join(i.columns)})" for i in t.indexes if not i.partial and not i.expression]
    for f in sorted(catalog.foreign_keys, key=lambda f: f.name):
        if not f.virtual and f.child in order and f.parent in order:
            full = " MATCH FULL" if f.match_full else ""
            after.append(f"ALTER TABLE {f.child} ADD CONSTRAINT {f.name} FOREIGN KEY ({', '.join(f.child_columns)}) REFERENCES {f.parent} ({', '.join(f.parent_columns)}){full}")
    return {"before": before, "after": after}


def record(spark: SparkSession, target: str, catalog: Catalog, document: dict) -> None:
    """The value-free record of a run, which also marks the target; written last."""
    put(spark, f"{target}/_run.json", json.dumps(document | {"schema": catalog.fingerprint}, indent=1, sort_keys=True))


def read_record(spark: SparkSession, target: str) -> dict | None:
    text = _text(spark, f"{target.rstrip('/')}/_run.json")
    return None if text is None else json.loads(text)
