"""Limits from declarations, catalog checks and the wider classification rules."""

from veilcut.functions.domain import check_labels, check_length, common_limits, group_masker, limits_of
from veilcut.model import Catalog, Column, Confidence, Decision, ForeignKey, Index, Mode, Step, Table
from veilcut.operators import catalog_checks, classify


def test_checks_become_limits():
    assert check_labels("(status IN ('new', 'it''s', 'done'))") == ("new", "it's", "done")
    assert check_labels("status = ANY (ARRAY['a'::text, 'b'::text])") == ("a", "b")
    assert check_labels("status <> ALL (ARRAY['a'])") == () and check_labels("n > 0") == ()
    assert check_length("length(code) = 9") == (9, None) and check_length("char_length(x) < 5") == (None, 4)
    assert check_labels("status IN ('a', 'b') AND kind <> 'x'") == ("a", "b") and check_labels("NOT (status IN ('a'))") == () and check_labels("(s = 'only')") == ("only",)
    assert check_labels("s IN ('a', 'b', 'c') AND (s = ANY (ARRAY['b'::character varying(3), 'c']))") == ("b", "c") and check_labels("s IN ('a') OR n > 1") == ()
    assert check_labels('"S" IN (\'and\', \'not\', \'it\'\'s\')') == ("and", "not", "it's")
    assert check_length('length("x"::text) <= 12 AND x <> \'\'') == (None, 12)
    c = limits_of(Column("s", max_len=20, checks=("s IN ('a','b','c')", "length(s) <= 8"), labels=("b", "c", "d")))
    assert c.labels == ("b", "c") and c.max_len == 8


def test_groups_need_a_common_masker():
    assert common_limits([Column("a", labels=("x",)), Column("b", labels=("y",))]) is None
    assert common_limits([Column("a", checks=("length(a) = 9",)), Column("b", max_len=5)]) is None
    name, limits = group_masker("phone", [Column("a", max_len=15), Column("b", max_len=12)], 1000, True)
    assert name == "phone_unique" and limits.max_len == 12
    assert isinstance(group_masker("person_name", [Column("a")], 10**6, True), str)
    assert isinstance(group_masker("email", [Column("a", labels=("x", "y"))], 3, True), str)


def test_catalog_literals_calls_and_documents():
    t = Table("t", (Column("a", default="'root@site.test'"), Column("b", checks=("b IN ('x', '123-45-6789')",)), Column("c", default="my_fn('now()')"), Column("d", "struct<a:map<string,string>>"), Column("e", default="now()")), ("a",))
    c = Catalog((t,))
    assert catalog_checks.literal_hits(c) == [("t", "a", "default", "email"), ("t", "b", "check", "national_id")]
    assert catalog_checks.unknown_calls(c) == [("t", "c", "my_fn")]
    assert catalog_checks.composite_documents(c) == [("t", "d")]
    assert catalog_checks.estimate(c, {"t": Step("t", Mode.CHILD_OK, ("a",), rows=10)}) == [("t", 10, 10 * (4 * 32 + 64))]


def test_key_conflicts():
    c = Catalog((Table("p", (Column("id"),), ("id",)), Table("q", (Column("p_id"),))), (ForeignKey("q_p", "q", ("p_id",), "p", ("id",)),))
    one = [Decision("p", "id", "email", Confidence.CERTAIN), Decision("q", "p_id")]
    assert catalog_checks.key_pair_conflicts(c, one) == ["q_p"]
    assert catalog_checks.key_pair_conflicts(c, [one[0], Decision("q", "p_id", "email", Confidence.CERTAIN)]) == []


def test_classification_of_a_small_schema(spark):
    people = Table("people", (Column("id", "bigint", False), Column("email"), Column("religion"), Column("extra"), Column("code")), ("id",), (Index("u", ("code",)),))
    logins = Table("logins", (Column("id", "bigint", False), Column("email"), Column("at")), ("id",))
    frames = {
        "people": spark.createDataFrame([(i, f"p{i}@site.test", "none", f"note {i}", f"c{i}") for i in range(12)], "id long, email string, religion string, extra string, code string"),
        "logins": spark.createDataFrame([(i, None, "x") for i in range(3)], "id long, email string, at string"),
    }
    d = {(x.table, x.column): x for x in classify.classify(Catalog((people, logins)), frames)}
    assert d["people", "email"].confidence is Confidence.CERTAIN and d["people", "email"].masker == "email"
    assert d["people", "religion"].category == "special_category" and d["people", "religion"].masked
    assert d["people", "extra"].category == "free_text" and not d["people", "code"].masked and not d["people", "id"].masked
    assert d["logins", "email"].masked and not d["logins", "at"].masked


def test_edges_with_two_masked_parents_are_refused(spark):
    """Columns that refer to masked keys of different categories end in a refusal, not in a loop; chains and cycles settle."""
    import pytest

    from veilcut.model import Refusal

    t = lambda n, *c: Table(n, tuple(Column(x) for x in c), (c[0],))
    fk = lambda child, c, parent, p: ForeignKey(f"{child}_{c}_{parent}", child, (c,), parent, (p,))
    tables = (t("a", "email"), t("b", "phone"), t("c", "id", "contact"))
    out = {(x.name, c.name): Decision(x.name, c.name) for x in tables for c in x.columns}
    out["a", "email"] = Decision("a", "email", "email", Confidence.CERTAIN)
    out["b", "phone"] = Decision("b", "phone", "phone", Confidence.CERTAIN)
    with pytest.raises(Refusal, match="c.contact"):
        classify._along_keys(Catalog(tables, (fk("c", "contact", "a", "email"), fk("c", "contact", "b", "phone"))), dict(out))
    chain = Catalog((*tables, t("d", "mail")), (fk("c", "contact", "a", "email"), fk("d", "mail", "c", "contact"), fk("a", "email", "d", "mail")))
    got = dict(out) | {("d", "mail"): Decision("d", "mail")}
    classify._along_keys(chain, got)
    assert got["d", "mail"].category == got["c", "contact"].category == "email" and got["c", "contact"].reason == "refers to a.email"
    numbers = Catalog((tables[0], Table("n", (Column("ref", "bigint"),))), (fk("n", "ref", "a", "email"),))
    with pytest.raises(Refusal, match="can't hold"):
        classify._along_keys(numbers, {("a", "email"): out["a", "email"], ("n", "ref"): Decision("n", "ref")})


def test_reasons_can_be_read_back():
    assert classify.parse_reason(classify.reason("refers", table="a", column="b")) == ("refers", {"table": "a", "column": "b"})
    assert all(classify.parse_reason(t.format(category="email", named="phone", table="t", column="c"))[0] == k for k, t in classify.REASONS.items() if k != "none")
    assert classify.parse_reason("values of ada@site.test under a name of x") is None


def test_documents_opt_outs_and_drift(spark):
    docs = Table("docs", (Column("id", "bigint", False), Column("body"), Column("mail", generated="get_json_object(body, '$.addr')")), ("id",))
    logs = Table("request_logs", (Column("id", "bigint", False), Column("body")), ("id",))
    body = '{"addr": "x", "plan": "gold"}'
    frames = {
        "docs": spark.createDataFrame([(i, body, "x") for i in range(5)], "id long, body string, mail string"),
        "request_logs": spark.createDataFrame([(i, body) for i in range(5)], "id long, body string"),
    }
    catalog = Catalog((Table("docs", (*docs.columns[:2], Column("email", generated="get_json_object(body, '$.addr')")), ("id",)), logs))
    frames["docs"] = frames["docs"].withColumnRenamed("mail", "email")
    d = {(x.table, x.column): x for x in classify.classify(catalog, frames)}
    assert d["docs", "body"].masker == "semi_structured" and dict(d["docs", "body"].leaves) == {"addr": "email", "plan": "none"} and d["docs", "email"].never
    assert d["request_logs", "body"].leaves == () and d["request_logs", "body"].masked
    known = catalog.table("docs").column("body").fingerprint
    prior = {("docs", "body"): Decision("docs", "body", unmasked=True, fingerprint=known, leaves=(("addr", "email"),)), ("docs", "id"): Decision("docs", "id", fingerprint="other")}
    again = classify.classify(catalog, frames, prior)
    by = {(x.table, x.column): x for x in again}
    assert by["docs", "body"].unmasked and not by["docs", "body"].masked
    assert "docs.id: another type" in classify.drift(catalog, prior, again) and "docs.body: new key plan" in classify.drift(catalog, prior, again) and "request_logs.id: new" in classify.drift(catalog, prior, again)
    stale = {("docs", "body"): Decision("docs", "body", unmasked=True, fingerprint="another")}
    assert {(x.table, x.column): x for x in classify.classify(catalog, frames, stale)}["docs", "body"].masked
