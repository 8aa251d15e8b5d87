"""Digests, generators, domains, nested values, classification, streams and whole runs."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from veilcut.functions import canonical as forms
from veilcut.functions.digest import category_key, digest, key_fingerprint, py_digest
from veilcut.functions.generators import MASKERS, Limits, max_rows, pick, required, small_domain
from veilcut.model import Confidence, Refusal, Request
from veilcut.operators import classify, masking, sampling

KEY = b"k" * 16


def test_digest_equals_hmac(spark):
    df = spark.createDataFrame([("",), ("a",), ("é日",), ("x" * 300,)], "x string")
    got = df.select("x", digest(KEY, "email", "text", F.col("x")).alias("h")).collect()
    enc = lambda s: len(s.encode()).to_bytes(4, "big") + s.encode()
    for r in got:
        assert bytes(r.h) == hmac.new(category_key(KEY, "email"), enc("text") + enc(r.x), hashlib.sha256).digest() == py_digest(KEY, "email", "text", r.x)
    assert key_fingerprint(KEY) == hashlib.sha256(KEY).hexdigest()[:8]


@pytest.mark.parametrize("masker", sorted(MASKERS))
def test_null_and_empty_pass_and_nothing_echoes(spark, masker):
    df = spark.createDataFrame([(None,), ("",), ("Ada Abbott",), ("12345",)], "x string")
    rows = df.select("x", masking.mask_column(KEY, masker, F.col("x")).alias("m")).collect()
    assert [r.m for r in rows[:2]] == [None, ""]
    assert all(r.m != r.x for r in rows[2:])


def test_limits(spark):
    df = spark.createDataFrame([("somebody@site.test",)], "x string")
    one = lambda m, **k: df.select(masking.mask_column(KEY, m, F.col("x"), Limits(**k)).alias("m")).first().m
    assert one("person_name", labels=("a", "b")) in ("a", "b")
    assert len(one("free_text", exact_len=40)) == 40
    assert len(one("email", max_len=20)) <= 20
    assert one("phone", max_len=10).isdigit() and len(one("phone", max_len=10)) == 10
    assert one("null", nullable=False) == ""


def test_domain_arithmetic():
    assert required(1) == 500_000 and required(2**40) == 2**63 - 1
    for d in (1, 10**6, 10**12, 2**63 - 1):
        n = max_rows(d)
        assert required(n) <= d or n == 0
    assert small_domain(60, 1) and small_domain(100, 80) and not small_domain(10**6, 10)
    assert pick("phone", True, 1000) == "phone_unique" and pick("phone", False, 1000) == "phone"
    assert pick("special_category", True, 10) is None


def test_fold_unicode(spark):
    df = spark.createDataFrame([("  STRASSE\tß ﬁ ",), (None,)], "x string")
    assert [r[0] for r in df.select(forms.fold(F.col("x"))).collect()] == ["strasse ss fi", None]
    net = spark.createDataFrame([("2001:DB8:0:0::1",), ("10.0.0.9/8",), ("x",)], "x string")
    assert [r[0] for r in net.select(forms.network(F.col("x"))).collect()] == ["2001:0db8:0000:0000:0000:0000:0000:0001", "10.0.0.0/8", "x"]


def test_spellings_of_one_value_mask_alike(spark):
    """NFC and NFD, short and long addresses, a URL with and without its port; in scalars and in (nested) arrays."""
    df = spark.createDataFrame([("Ren\u00e9e", "Rene\u0301e", "::1", "0:0:0:0:0:0:0:1", "HTTP://A.test:80/", "http://a.test")], "a string, b string, c string, d string, e string, f string")
    plan = {"a": ("person_name", Limits()), "b": ("person_name", Limits()), "c": ("network_id", Limits()), "d": ("network_id", Limits()), "e": ("online_id", Limits()), "f": ("online_id", Limits())}
    r = masking.transform(df, KEY, plan).first()
    assert r.a == r.b != "Ren\u00e9e" and r.c == r.d and r.e == r.f
    lists = df.select("a", "b", F.array(F.array("a", "b")).alias("x")).withColumn("y", F.array("b", F.lit(None)))
    got = masking.transform(lists, KEY, {k: ("person_name", Limits()) for k in ("a", "x", "y")}).first()
    assert got.x == [[got.a, got.a]] and got.y == [got.a, None] and masking.wide_columns(lists, ["a", "b", "y"]) == {"a", "b", "y"}
    assert masking.transform(df.select("c"), KEY, {"c": ("network_id", Limits())}, wide=frozenset()).first().c == r.c


def test_columns_of_any_name_pass(spark):
    df = spark.createDataFrame([("keepme", "Ada", "x", "c")], "h_0 string, c_name string, _0x string, `a.b` string")
    r = masking.transform(df, KEY, {"c_name": ("person_name", Limits()), "a.b": ("free_text", Limits())}).first()
    assert (r.h_0, r["_0x"]) == ("keepme", "x") and r.c_name != "Ada" and r["a.b"] != "c"


def test_what_a_column_cant_hold_is_refused(spark):
    df = spark.createDataFrame([(1, 2.5)], "n long, x double").withColumn("d", F.lit("2001-02-03").cast("date")).withColumn("p", F.lit(1).cast("decimal(5,4)"))
    for c, m in (("n", "email"), ("x", "phone"), ("d", "person_name"), ("p", "geo")):
        with pytest.raises(Refusal, match=c):
            masking.transform(df, KEY, {c: (m, Limits())})
    with pytest.raises(Refusal, match="names fit"):
        masking.transform(df.withColumn("s", F.lit("Ada Orr")), KEY, {"s": ("person_name", Limits(max_len=7))})
    r = masking.transform(df.withColumn("t", F.lit("2001-02-03 04:05:06").cast("timestamp")).withColumn("s", F.lit("Ada Orr")), KEY, {"n": ("national_id", Limits()), "x": ("geo", Limits()), "d": ("person_date", Limits()), "t": ("person_date", Limits()), "s": ("person_name", Limits(max_len=10))}).first()
    assert 10**8 <= r.n < 10**9 and -90 <= r.x <= 90 and 1940 <= r.d.year < 2010 and 1940 <= r.t.year < 2010 and len(r.s) <= 10 and " " in r.s
    none = masking.transform(df, KEY, {"n": ("null", Limits(nullable=False)), "d": ("null", Limits())}).first()
    assert none.n == 0 and none.d is None


def test_documents_of_any_size_are_walked(spark):
    doc = json.dumps({f"key{i}": f"value {i}" for i in range(5000)} | {"deep": json.loads('{"a":' * 40 + '{"b":"secret words"}' + "}" * 40), "a@b.test": "007", "n": [0, 10.05, -3e-7, True]})
    got = json.loads(spark.createDataFrame([(doc,)], "x string").select(masking.mask_json(KEY, F.col("x"))).first()[0])
    assert len(got) == 5003 and "a@b.test" not in got and all(got[f"key{i}"] != f"value {i}" for i in range(5000))
    assert "secret" not in json.dumps(got["deep"]) and json.dumps(got["deep"]).count('"a"') == 40
    n = got["n"]
    assert n[0] == 0 and 10 <= n[1] < 100 and -1e-6 < n[2] < 0 and isinstance(n[3], bool)
    leaves = json.dumps({"c": "4111 1111 1111 1111", "p": "+1 212 555 0123", "i": "10.0.0.7", "t": "gold"})
    kept = json.loads(spark.createDataFrame([(leaves,)], "x string").select(masking.mask_json(KEY, F.col("x"), {k: "none" for k in "cpit"})).first()[0])
    assert kept["t"] == "gold" and kept["c"] != "4111 1111 1111 1111" and kept["p"].startswith("+1 ") and kept["p"] != "+1 212 555 0123" and kept["i"] != "10.0.0.7"


def test_json_leaf_rules(spark):
    doc = json.dumps({"email": "a@b.c", "plan": "gold", "n": 42, "on": True, "tags": ["x", None], "deep": {"name": "Zoe"}, "note": ""})
    df = spark.createDataFrame([(doc,), ("not json",), (None,)], "x string")
    leafs = {"email": "email", "plan": "none", "n": "none", "on": "none", "tags": "free_text", "deep": "none", "name": "person_name", "note": "none"}
    a, b, c = (r[0] for r in df.select(masking.mask_json(KEY, F.col("x"), leafs)).collect())
    a = json.loads(a)
    assert a["plan"] == "gold" and a["n"] == 42 and a["on"] is True and a["note"] == ""
    assert a["email"].split("@")[1].startswith("example.") and a["tags"][1] is None and a["tags"][0] != "x" and a["deep"]["name"] != "Zoe"
    assert b == "{}" and c is None
    everything = json.loads(df.select(masking.mask_json(KEY, F.col("x"))).first()[0])
    assert everything["plan"] != "gold" and len(str(everything["n"])) == 2
    assert df.select(masking.mask_json(KEY, F.col("x"), collapse=True)).first()[0] == "{}"
    assert classify.leaf_map([doc])["email"] == "email" and classify.leaf_map([doc])["plan"] == "none"


def test_names_and_decisions():
    assert classify.normalise("HTTPUserName2") == "http_user_name2" and classify.by_name("customers", "Name") == "person_name"
    assert classify.by_name("products", "name") is None and classify.by_name("t", "EmailAddress") == "email"
    assert classify.decide("email", True, "email", "strong")[1] is Confidence.CERTAIN
    assert classify.decide("email", False, None, "none")[1] is Confidence.LOW
    assert classify.decide(None, False, "phone", "strong")[1] is Confidence.LIKELY
    assert classify.role("first_name") == "given" and classify.role("surname") == "family"


def test_sample_doesnt_depend_on_partitions(spark, data):
    df = spark.read.parquet(f"{data}/orders.parquet")
    take = lambda d: [r.o_orderkey for r in sampling.seeded_sample(d, ("o_orderkey",), 20).collect()]
    assert take(df) == take(df.repartition(7))


def test_stream_masks_as_batch(spark, data, tmp_path):
    from veilcut.streaming.mask_stream import mask_stream, write_stream

    schema = spark.read.parquet(f"{data}/customer.parquet").schema
    source = tmp_path / "in"
    spark.read.parquet(f"{data}/customer.parquet").write.parquet(str(source))
    plan = {"c_name": ("person_name", Limits())}
    q = write_stream(mask_stream(spark.readStream.schema(schema).parquet(str(source)), KEY, plan), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    batch = masking.transform(spark.read.parquet(f"{data}/customer.parquet"), KEY, plan)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_whole_run(spark, data, tmp_path):
    from veilcut.model import Mode
    from veilcut.run import rerun, reverify, run
    from veilcut.sources import sink

    target = f"file://{tmp_path}/target"
    request = lambda: Request(root="customer", take=20, cap=3, depth=3, mask={("customer", "c_name"): "person_name"})
    core = ("region", "nation", "customer", "orders")
    out = run(spark, data, target, request(), KEY, core)
    assert out.exit_code == 0 and out.tables["customer"].count() == 20
    names = {r.c_name for r in out.tables["customer"].collect()}
    assert not names & {r.c_name for r in spark.read.parquet(f"{data}/customer.parquet").collect()}
    first = sorted(map(str, out.tables["customer"].collect()))
    record = sink.read_record(spark, target)
    assert record["columns"]["customer.c_name"]["masked"] and record["failed"] == [] and record["steps"]["customer"]["rows"] == 20
    again = run(spark, data, target, request(), KEY, core)  # its own marker lets it write again, to the same rows
    assert sorted(map(str, again.tables["customer"].collect())) == first
    assert out.steps["region"].mode is Mode.LOOKUP and set(record["files"]) == set(core)
    third = rerun(spark, data, target, KEY, tables=core)
    assert sorted(map(str, third.tables["customer"].collect())) == first and not third.notes
    assert reverify(spark, data, target, KEY, tables=core).failed == set()
    assert "CREATE TABLE customer" in (tmp_path / "target" / "_schema.json").read_text()
    with pytest.raises(Refusal):
        rerun(spark, data, target, b"another key", tables=core)
    (tmp_path / "target" / "_lease").write_text("")
    with pytest.raises(Refusal, match="another run"):
        run(spark, data, target, request(), KEY, core)
    with pytest.raises(Refusal):
        sink.gate(spark, data, data + "/x", out.catalog.fingerprint)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("x")
    with pytest.raises(Refusal):
        sink.gate(spark, data, f"file://{tmp_path}/other", out.catalog.fingerprint)
