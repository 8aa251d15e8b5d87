"""Whole runs over made-up folders: a declared catalog, cycles, typed edges, documents, arrays, checks that fail and refusals."""

import json

import pytest
from pyspark.sql import functions as F

from veilcut import run as runs
from veilcut.model import Decision, Mode, Refusal, Request
from veilcut.sources import catalog as catalogs
from veilcut.sources import sink

KEY = b"k" * 16


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """A small schema with a cycle of two tables, a self-reference, a composite key, a typed pair, a document, an array and a generated column."""
    d = tmp_path_factory.mktemp("shop")
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    people = [(i, i // 2 if i else None, f"p{i}@site.test", [f"q{i}@site.test", None], '{"mail":"r%d@site.test","plan":"gold"}' % i, i * 10 if i else None, f"p{i}@site.test!") for i in range(40)]
    put("people", people, "id long, boss_id long, email string, other array<string>, profile string, last_order_id long, shown string")
    put("orders", [(i * 10, i, "2024-01-01") for i in range(40)], "id long, person_id long, day string")
    put("order_items", [(i * 10, n, f"sku{n}") for i in range(40) for n in range(3)], "order_id long, line int, sku string")
    put("notes", [(i, ("Person", "Order")[i % 2], (i, i * 10)[i % 2], "plain words") for i in range(40)], "id long, owner_type string, owner_id long, body string")
    put("statuses", [(i, f"s{i}") for i in range(5)], "id int, label string")
    put("tickets", [(i, i % 40, i % 5) for i in range(80)], "id long, person_id long, status_id int")
    document = {
        "tables": {
            "people": {"primary_key": ["id"], "columns": {"shown": {"generated": "concat(email, '!')"}, "email": {"nullable": False}}, "indexes": [{"name": "people_email", "columns": ["email"]}], "sequences": ["id"]},
            "orders": {"primary_key": ["id"]}, "order_items": {"primary_key": ["order_id", "line"]}, "notes": {"primary_key": ["id"]}, "statuses": {"primary_key": ["id"]}, "tickets": {"primary_key": ["id"]},
        },
        "foreign_keys": [
            {"child": "people", "columns": ["boss_id"], "parent": "people", "parent_columns": ["id"]}, {"child": "people", "columns": ["last_order_id"], "parent": "orders", "parent_columns": ["id"]},
            {"child": "orders", "columns": ["person_id"], "parent": "people", "parent_columns": ["id"]}, {"child": "order_items", "columns": ["order_id"], "parent": "orders", "parent_columns": ["id"]},
            {"child": "tickets", "columns": ["person_id"], "parent": "people", "parent_columns": ["id"]}, {"child": "tickets", "columns": ["status_id"], "parent": "statuses", "parent_columns": ["id"]},
        ],
    }
    (d / "_catalog.json").write_text(json.dumps(document))
    return f"file://{d}"


def test_run_of_a_declared_folder(spark, shop, tmp_path):
    target = f"file://{tmp_path}/out"
    out = runs.run(spark, shop, target, Request(root="notes", take=6, cap=2, depth=2), KEY)
    assert out.failed == set() and set(out.tables) == {"notes", "people", "orders", "statuses"}  # typed parents, their bosses and last orders
    assert out.steps["people"].mode is Mode.PARENT_ONLY and {r.id for r in out.tables["notes"].collect()} == set(range(6))
    wide = runs.run(spark, shop, f"file://{tmp_path}/wide", Request(root="people", take=4, cap=2, depth=2), KEY)
    assert wide.steps["statuses"].mode is Mode.LOOKUP and wide.tables["statuses"].count() == 5 and list(wide.tables)[-1] != "people"
    source = {r.id: r for r in spark.read.parquet(f"{shop}/people.parquet").collect()}
    for r in wide.tables["people"].collect():
        was, leaf = source[r.id], json.loads(r.profile)
        assert r.email != was.email and r.email.endswith(("example.com", "example.net", "example.org")) and r.shown == r.email + "!"
        assert leaf["plan"] == "gold" and "site.test" not in leaf["mail"] and r.other[1] is None and "site.test" not in r.other[0]
    record = sink.read_record(spark, f"file://{tmp_path}/wide")
    assert record["sequences"]["people.id"] == max(r.id for r in wide.tables["people"].collect()) + 1 and record["columns"]["people.profile"]["leaves"] == {"mail": "email", "plan": "none"}
    ddl = json.loads((tmp_path / "wide" / "_schema.json").read_text())
    assert any("GENERATED ALWAYS AS (concat(email, '!'))" in x for x in ddl["before"]) and any("FOREIGN KEY (boss_id) REFERENCES people (id)" in x for x in ddl["after"])


def test_second_net_and_leaks_fail(spark, shop, tmp_path, monkeypatch):
    blind = lambda catalog, *_: [Decision(t.name, c.name) for t in catalog.tables for c in t.columns]
    ask = lambda **more: Request(root="people", take=3, cap=1, depth=1, skip={"notes", "tickets"}, **more)
    with monkeypatch.context() as m:
        m.setattr(runs.classification, "classify", blind)
        with pytest.raises(Refusal, match="second_net") as e:
            runs.run(spark, shop, f"file://{tmp_path}/a", ask(), KEY)
        assert e.value.code == 8 and any("people.other: looks like email" in c for c in e.value.causes)
        out = runs.run(spark, shop, f"file://{tmp_path}/b", ask(unmask={("people", c) for c in ("email", "other", "profile", "shown")}), KEY)
    assert out.failed == set()  # what was asked to stay is no surprise
    sink.write(spark.read.parquet(f"{tmp_path}/b/orders.parquet").limit(0), f"file://{tmp_path}/b", "orders")
    assert {"row_count", "fk"} <= runs.reverify(spark, shop, f"file://{tmp_path}/b", KEY).failed


def test_dates_of_people_are_no_false_alarm(spark, data, tmp_path):
    request = Request(root="customer", take=20, cap=3, depth=1, mask={("orders", "o_orderdate"): "person_date", ("customer", "c_name"): "person_name"})
    out = runs.run(spark, data, f"file://{tmp_path}/t", request, KEY, ("customer", "orders", "nation", "region"))
    assert out.failed == set() and out.tables["orders"].schema["o_orderdate"].dataType == spark.read.parquet(f"{data}/orders.parquet").schema["o_orderdate"].dataType


def test_refusals_come_together(spark, shop, tmp_path):
    document = catalogs.declared(spark, shop)
    document["tables"]["orders"]["columns"] = {"day": {"default": "'root@site.test'"}}
    document["tables"]["tickets"]["columns"] = {"status_id": {"default": "next_free()"}}
    with pytest.raises(Refusal) as e:
        runs.run(spark, shop, f"file://{tmp_path}/x", Request(root="people"), KEY, document=document)
    assert e.value.causes == ["orders.day has personal data in its default", "tickets.status_id calls next_free, which isn't recreated"]
    assert len(runs.doctor(spark, shop, document=document)) == 2
    bad = catalogs.declared(spark, shop)
    bad["foreign_keys"].append({"child": "notes", "columns": ["ghost"], "parent": "people", "parent_columns": ["id"]})
    with pytest.raises(Refusal, match="ghost"):
        catalogs.load(spark, shop, None, bad)
    for request in (Request(root="people", mask={("people", "nope"): "email"}), Request(root="people", mask={("people", "email"): "nope"})):
        with pytest.raises(Refusal):
            runs.run(spark, shop, f"file://{tmp_path}/y", request, KEY)
    both = catalogs.declared(spark, shop)
    for t in ("notes", "tickets"):
        del both["tables"][t]["primary_key"]
    loaded = catalogs.load(spark, shop, None, both)
    with pytest.raises(Refusal) as e:
        runs.plan(spark, runs.with_typed_edges(*loaded), loaded[1], Request(root="people", take=2))
    assert [c for c in e.value.causes if "tickets" in c]


def test_strict_reruns_refuse_drift(spark, shop, tmp_path):
    target = f"file://{tmp_path}/t"
    runs.run(spark, shop, target, Request(root="orders", take=2, cap=1, depth=1), KEY)
    record = sink.read_record(spark, target)
    del record["columns"]["orders.day"]
    with pytest.raises(Refusal, match="orders.day: new"):
        runs.run(spark, shop, target, Request(root="orders", take=2, cap=1, depth=1, strict=True), KEY, prior=record)
    out = runs.run(spark, shop, target, Request(root="orders", take=2, cap=1, depth=1), KEY, prior=record)
    assert out.notes == ["orders.day: new"]


def test_a_large_lookup_is_not_cut(spark, shop):
    from veilcut.plans import closure

    catalog, frames = catalogs.load(spark, shop, None)
    frames = frames | {"statuses": spark.range(1500).select(F.col("id").cast("int"), F.lit("x").alias("label"))}
    assert closure.small_lookups(["statuses"], frames) == frozenset()
    with pytest.raises(Refusal, match="1000 rows"):
        closure.add_lookups({}, catalog, frames, frozenset({"statuses"}))


def test_a_table_stays_until_the_new_one_stands(spark, tmp_path, monkeypatch):
    target = f"file://{tmp_path}/t"
    sink.write(spark.range(3), target, "x")
    with pytest.raises(Exception):
        sink.write(spark.range(5).select((F.lit(1) / (F.col("id") - 4)).alias("id")), target, "x")
    assert spark.read.parquet(f"{target}/x.parquet").count() == 3
    assert sink.write(spark.range(5), target, "x").count() == 5
    with pytest.raises(Refusal):
        sink.gate(spark, target, f"{tmp_path}/t/../t", "")
