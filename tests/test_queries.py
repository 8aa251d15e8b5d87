"""Every registered query of the core against its SQL."""

import pytest
from conftest import same

from veilcut.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, duck, name):
    same(QUERIES[name](spark, data), duck, SQL[name])


def test_flagship_has_rows_and_no_orphans(spark, data):
    rows = QUERIES["flagship"](spark, data).collect()
    assert len(rows) == 8 and all(r.n_orphans == 0 for r in rows) and all(r.n_rows > 0 for r in rows)


def test_closure_plan_prunes_groups_by_cap(spark, data):
    plan = QUERIES["subset_child_cap"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_geo_of_large_ids(spark, tmp_path):
    from pyspark.sql import functions as F

    from veilcut.functions import canonical

    ids = [1, 999999, 1000000, 9999999, 10000000, 123456789012, 2**53 + 1]
    df = spark.createDataFrame([(i,) for i in ids], "c_custkey long")
    assert [r.c for r in df.select(canonical.geo(F.col("c_custkey")).alias("c")).collect()] == [f"{i}.0" for i in ids]
    odd = ["1e7", "52.50", "-0.00001", "1E300", "a B", None]
    got = spark.createDataFrame([(x,) for x in odd], "x string").select(canonical.geo(F.col("x")).alias("c")).collect()
    assert [r.c for r in got] == ["10000000.0", "52.5", "-0.00001", "1.0E300", "a b", None]
    df.write.parquet(f"{tmp_path}/customer.parquet")
    assert sorted(r.c_custkey for r in QUERIES["mask_geo"](spark, str(tmp_path)).collect()) == ids


def test_fold_of_all_documents(spark, data, tmp_path):
    import unicodedata

    want = {1: "strasse ss", 2: "file x", 3: "éa", 4: "plain text", 5: None, 6: "abc"}
    rows = [(1, "Straße\u00a0ẞ"), (2, "ﬁle  X"), (3, "E\u0301\u0041"), (4, " Plain\ttext "), (5, None), (6, "ＡＢＣ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.canon for r in QUERIES["canonical_fold_all"](spark, str(tmp_path)).collect()} == want
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r.canon for r in QUERIES["canonical_fold_all"](spark, data).collect()}
    assert got == {d: t and " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for d, t in texts.items()}
