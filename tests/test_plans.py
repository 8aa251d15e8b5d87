"""Graphs, identities, predicates and the walk on small made-up schemas."""

import pytest
from pyspark.sql import functions as F

from veilcut.model import Catalog, Column, ForeignKey, Identity, IdentityKind, Index, Mode, Refusal, Request, Table
from veilcut.plans import closure, graph, identity
from veilcut.plans.where import check_predicate


def table(name, *columns, key=("id",), **more):
    return Table(name, tuple(Column(c, "bigint", c not in key) for c in columns), key, **more)


def fk(child, column, parent, **more):
    return ForeignKey(f"{child}_{column}", child, (column,), parent, ("id",), **more)


def test_components_and_load_order():
    c = Catalog((table("a", "id", "b_id"), table("b", "id", "c_id"), table("c", "id", "a_id"), table("s", "id", "s_id"), table("leaf", "id", "a_id")), (fk("a", "b_id", "b"), fk("b", "c_id", "c"), fk("c", "a_id", "a"), fk("s", "s_id", "s"), fk("leaf", "a_id", "a")))
    edges = [(f.child, f.parent) for f in c.foreign_keys]
    assert graph.strong_components([t.name for t in c.tables], edges) == [("a", "b", "c"), ("s",)]
    order = [t for _, t, _ in graph.load_order(c)]
    assert order.index("leaf") > max(order.index(x) for x in "abc")


@pytest.mark.parametrize("text,at", [("a = 1; drop", 6), ("a = '$x'", 6), ("((((((( 1 )))))))", 7), ("(a = 1", 1), ("a = 1)", 6), ("a -- b", 3), ("a /* b", 3), ("a = 1 -", 7), ("a = 'x", 5)])
def test_predicates_refused(text, at):
    assert check_predicate(text)[0] == at


@pytest.mark.parametrize("text", ["a = 1", "name = 'it''s; fine'".replace(";", ""), "((a > 1) and (b < 2))", ""])
def test_predicates_allowed(text):
    assert check_predicate(text) is None


def test_identity_ladder(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 1)], "a long, b long, c long")
    cols = (Column("a", "bigint", False), Column("b", "bigint", False), Column("c", "bigint"))
    plain = Table("t", cols)
    c = Catalog((plain,), (ForeignKey("t_a", "t", ("a",), "t", ("a",)), ForeignKey("t_b", "t", ("b",), "t", ("b",))))
    assert identity.resolve(c, plain, df) == Identity(IdentityKind.PSEUDO, ("a", "b"))
    assert identity.resolve(c, plain, df, ("a", "b")).kind is IdentityKind.EXPLICIT
    with pytest.raises(Refusal):
        identity.resolve(c, plain, df, ("a",))
    wide = Table("t", cols, indexes=(Index("z", ("a", "b")), Index("p", ("a",), partial=True), Index("n", ("c",))))
    assert identity.resolve(c, wide, df) == Identity(IdentityKind.UNIQUE, ("a", "b"))
    with pytest.raises(Refusal):
        identity.resolve(Catalog((plain,)), plain, df)
    assert identity.key_hint([{"a": 1, "b": 1}, {"a": 1, "b": 2}], ["a", "b"]) == ("b",)


def test_lineitem_without_key_is_refused_at_the_smallest_scale(spark, data):
    from veilcut.sources import catalog as catalogs

    c, frames = catalogs.load(spark, data)
    with pytest.raises(Refusal):
        identity.resolve(c, c.table("lineitem"), frames["lineitem"])


def test_walk_with_cycle_modes_depth_and_skip(spark):
    people = spark.createDataFrame([(i, i - 1 if i else None) for i in range(10)], "id long, boss_id long")
    pets = spark.createDataFrame([(i, i % 10) for i in range(50)], "id long, owner_id long")
    c = Catalog((table("people", "id", "boss_id"), table("pets", "id", "owner_id")), (fk("people", "boss_id", "people"), fk("pets", "owner_id", "people")))
    frames = {"people": people, "pets": pets}
    steps = closure.walk(c, frames, Request(root="people", where="id = 5", take=1, cap=2, depth=1))
    # bosses come in full as parents, one report as a child; pets only of rows that came as children
    assert {r.id for r in steps["people"].keys.collect()} == {0, 1, 2, 3, 4, 5, 6}
    assert {r.id % 10 for r in steps["pets"].keys.collect()} == {5} and steps["pets"].rows == 2
    assert steps["pets"].mode is Mode.CHILD_OK
    assert set(closure.walk(c, frames, Request(root="people", take=1, skip={"pets"}))) == {"people"}
    with pytest.raises(Refusal, match="budget"):
        closure.walk(c, frames, Request(root="people", take=10, row_budget=3))
    with pytest.raises(Refusal):
        Request(take=0).check()


def test_polymorphic_edges(spark):
    c = Catalog((table("notes", "id", "owner_type", "owner_id"), table("people", "id"), table("orders", "id")))
    assert graph.polymorphic_pairs(c) == [("notes", "owner_type", "owner_id")]
    edges = graph.polymorphic_edges(c, ("notes", "owner_type", "owner_id"), ["Person", "Shop::Order", "Ghost"])
    assert [(e.parent, e.discriminator[1]) for e in edges] == [("people", "Person"), ("orders", "Shop::Order")]
    notes = spark.createDataFrame([(1, "Person", 7), (2, "Shop::Order", 7), (3, "Ghost", 7)], "id long, owner_type string, owner_id long")
    ids = spark.createDataFrame([(7,)], "id long")
    full = Catalog(c.tables, tuple(edges))
    steps = closure.walk(full, {"notes": notes, "people": ids, "orders": ids.where("id < 0")}, Request(root="notes", take=1))
    assert set(steps) == {"notes", "people"}


def test_orphans_by_match_rule(spark):
    from veilcut.operators.verify import orphans

    child = spark.createDataFrame([(1, 1, 1), (2, 1, None), (3, None, None), (4, 9, 9)], "id long, a long, b long")
    parent = spark.createDataFrame([(1, 1)], "x long, y long")
    simple = ForeignKey("f", "c", ("a", "b"), "p", ("x", "y"))
    full = ForeignKey("f", "c", ("a", "b"), "p", ("x", "y"), match_full=True)
    assert {r.id for r in orphans(child, parent, simple).collect()} == {4}
    assert {r.id for r in orphans(child, parent, full).collect()} == {2, 4}
    assert parent.where(F.lit(False)).count() == 0
