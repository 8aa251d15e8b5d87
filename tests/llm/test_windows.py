"""Substring and suffix dedup against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import same
from pyspark.sql import functions as F

from veilcut.llm import substring_dedup, suffix_dedup
from veilcut.llm.common import pack, text_buffer, unpack, words_of


@pytest.mark.parametrize("segment", [3, 7, 1000])
def test_words_of_any_segment(segment):
    rng = random.Random(1)
    for _ in range(60):
        docs = ["".join(rng.choice("ab é \n\t日") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
        data, offsets = text_buffer(pa.array(docs))
        s, e, h, first = words_of(data, offsets, segment)
        got = [[bytes(data[s[i] : e[i]]) for i in range(first[k], first[k + 1])] for k in range(len(docs))]
        assert got == [d.encode().split() for d in docs]
        by = {}
        assert all(by.setdefault(w, x) == x for w, x in zip(sum(got, []), h)) and len(set(by.values())) == len(by)


def test_pack_round_trip():
    x = unpack(pack(h=np.arange(5, dtype=np.uint64), a=-np.arange(7), b=np.zeros(0, np.int32)))
    assert x["a"].tolist() == [0, -1, -2, -3, -4, -5, -6] and len(x["b"]) == 0 and x["h"].tolist() == [0, 1, 2, 3, 4]


def test_substring_query_equals_sql(spark, data, duck):
    same(substring_dedup.op10_substring_dedup(spark, data), duck, substring_dedup.OP10_SQL)


def test_substring_defined_cases(spark):
    line = " ".join(f"w{i}" for i in range(25))
    rows = [(3, line), (1, "x " + line), (2, None), (4, ""), (None, line + " y"), (3, line), (5, " ".join(["a"] * 30)), (6, "short one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("kind", F.lit(1))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in substring_dedup.dedup_substrings(df).collect())
    assert got == sorted(
        [("3", 25, 25, ""), ("3", 25, 25, ""), ("1", 26, 25, "x"), ("2", 0, 0, ""), ("4", 0, 0, ""), ("None", 26, 0, line + " y"), ("5", 30, 29, "a"), ("6", 2, 0, "short one")]
    )
    assert substring_dedup.dedup_substrings(df.where("false")).count() == 0


def _bytes(rows, length):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for d, t in rows:
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        gone = np.cumsum(mark[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((str(d), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [400, 300])
def test_suffix_equals_brute_force(spark, data, length):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ijkl\n") for _ in range(3000))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    for k in range(25):
        i, n = rng.randint(0, 2000), rng.randint(380, 900)
        rows.append((10000 + k, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 500))) + base[i : i + n] + "é" + "q" * rng.randint(0, 500)))
    rows += [(20000, None), (20001, ""), (20002, "a" * 1500), (None, "ab" * 700 + base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(5)
    out = suffix_dedup.dedup_suffixes(df, length).withColumn("sha", F.sha2("kept", 256))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in out.collect()) == _bytes(rows, length)


def test_suffix_edges(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdef ") for _ in range(900))
    df = spark.createDataFrame([(1, text), (1, text), (2, "x")], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.dedup_suffixes(df).collect()] == [0, 0, 0]  # equal rows are one document
    assert suffix_dedup.dedup_suffixes(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup_suffixes(df, 100)


def test_long_document_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    part = "".join(rng.choice("abcdefghij ") for _ in range(700))
    text = "".join(rng.choice("klmnop ") for _ in range(3000)) + part + "".join(rng.choice("klmnop ") for _ in range(2500)) + part
    data = np.frombuffer(text.encode(), np.uint8)
    pieces = list(suffix_dedup._units(data, np.array([0, len(data)]), 400, 1000))
    starts = [b + i for _, b, d, _ in pieces for i in range(len(d) - 399)]
    assert starts == list(range(len(data) - 399))  # every window in exactly one piece
