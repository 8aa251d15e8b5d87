"""SimHash and line dedup against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilcut.llm import line_dedup, shingle_join, simhash
from veilcut.llm.components import components


def _fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", "A", "A b", "x\x1cy z É ë", "the The the the the", " ".join(f"w{i}" for i in range(99))])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _fingerprint(text)


def test_anchors_cover_all_pairs():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 600, dtype=np.int64).astype(np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for _ in range(rng.integers(0, 3)):
            y[i] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    sets = []
    for v in (x, y):
        own = collections.defaultdict(set)
        for r, a in zip(*simhash.anchors(v)):
            own[r].add(a)
        sets.append(own)
    assert all(sets[0][i] & sets[1][i] for i in range(len(x)))


def _groups(fps):
    n, lab = len(fps), list(range(len(fps)))

    def find(i):
        while lab[i] != i:
            i = lab[i]
        return i

    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 2):
            a, b = find(i), find(i + 1 + int(j))
            lab[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_dense_and_sparse_fingerprints(spark):
    rng = np.random.default_rng(2)
    base = np.uint64(rng.integers(0, 2**63))
    dense = [base ^ np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 12, rng.integers(0, 9))))) for _ in range(300)]
    fps = np.unique(np.array(dense + list(rng.integers(0, 2**63, 200).astype(np.uint64)), np.uint64))
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long").repartition(3)
    roots = {r.node: r.root for r in components(simhash.linked(df)).collect()}
    want, got = collections.defaultdict(set), collections.defaultdict(set)
    for v, g in zip(fps.view(np.int64).tolist(), _groups(fps)):
        want[g].add(v)
        got[roots.get(v, v)].add(v)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_simhash_query(spark, data):
    rows = simhash.op4_simhash(spark, data).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    fp = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert all(fp[d] == _fingerprint(t) for d, t in text.items())
    u = np.unique(np.array(list(fp.values()), np.uint64))
    group, least = dict(zip(u.tolist(), _groups(u))), {}
    for d in sorted(fp):
        least.setdefault(group[fp[d]], d)
    assert all(r.component_id == least[group[fp[r.doc_id]]] for r in rows)


def test_simhash_defined_cases(spark):
    df = spark.createDataFrame([(5, None), (3, ""), (None, "a b c d"), (9, "a b c d"), (9, "a b c d")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [("3", 3), ("5", 3), ("9", 9), ("9", 9), ("None", 9)]
    assert simhash.near_duplicates(df.where("false")).count() == 0
    kept = simhash.keep_one(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "9"]


def _near_kept(rows, similarity=0.8, k=5):
    """(id, text) that keep_one keeps, by comparing all pairs; ids without repeats."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in words]
    lab = list(range(len(rows)))

    def find(i):
        while lab[i] != i:
            i = lab[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or (both and both >= similarity * (len(a) + len(sets[j]) - both)):
                x, y = find(i), find(j)
                lab[max(x, y)] = min(x, y)
    best = {}
    for i, (d, t) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (d, t)), (d, t), key=lambda r: (r[0] is None, r[0]))
    return sorted(best.values(), key=str)


def _near_rows():
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    passage, rows = word(40), []
    for n in (6, 30, 60, 200, 400):
        for _ in range(8):
            base = word(n)
            rows.append(base)
            for edits in (1, max(1, n // 60), max(1, n // 40), max(1, n // 25)):
                own = list(base)
                for p in rng.integers(0, n, edits):
                    own[p] = f"X{rng.integers(0, 9999)}"
                rows.append(own)
    big = word(120)
    for _ in range(90):  # a large group of near copies, more than SMALL
        own = list(big)
        for p in rng.integers(0, 120, rng.integers(1, 5)):
            own[p] = f"Y{rng.integers(0, 99999)}"
        rows.append(own)
    for _ in range(60):  # a common passage in texts that differ otherwise
        rows.append(word(30) + passage + word(30))
    ids = rng.permutation(len(rows)).tolist()
    return [(i, " ".join(w)) for i, w in zip(ids, rows)] + [(9001, None), (9000, ""), (9003, "a b"), (9002, "A  b"), (9004, "a c")]


@pytest.mark.parametrize("small, common", [(32, 200_000), (4, 1)])
def test_near_dedup_stage_equals_brute_force(spark, monkeypatch, small, common):
    import corpus_pipeline as cp

    monkeypatch.setattr(shingle_join, "SMALL", small)
    monkeypatch.setattr(shingle_join, "COMMON", common)
    rows = _near_rows()
    docs = spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == _near_kept(rows) and len(got) < 250


def _shingles(x, k=7):
    return {x[i : i + k] for i in range(len(x) - k + 1)} if len(x) >= k else {x}


def test_shingles_equal_python_sets():
    texts = ["", "ab", "abcdefg", "abcdefgh", "日本語テキスト日本", "aaaaaaaaaaaa", "𝒳" * 9, "abcdefg"]
    s = line_dedup.Shingles(texts)
    assert s.size.tolist() == [len(_shingles(t)) for t in texts]
    u, v = (x.ravel() for x in np.meshgrid(np.arange(8), np.arange(8)))
    want = [len(_shingles(texts[a]) & _shingles(texts[b])) / len(_shingles(texts[a]) | _shingles(texts[b])) for a, b in zip(u, v)]
    assert np.allclose(s.similar(u, v), want)
    pairs = set(zip(*(x.tolist() for x in s.products(np.arange(8), 0.8))))
    assert pairs == {(int(a), int(b)) for a, b, j in zip(u, v, want) if a < b and j >= 0.8}


def test_line_dedup_equals_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()] + [(9000, None), (9001, ""), (9002, "ab\n\n ab \nabc\nx")]
    strip = lambda x: x.strip(" \t\n\r\x0b\x0c")
    at = sorted((d, i, strip(x)) for d, t in rows for i, x in enumerate((t or "").split("\n")) if strip(x))
    lines = sorted({x for _, _, x in at})
    sets, lab, held = [_shingles(x) for x in lines], list(range(len(lines))), collections.defaultdict(list)

    def find(i):
        while lab[i] != i:
            i = lab[i]
        return i

    for i, x in enumerate(sets):
        for q in x:
            held[q].append(i)
    count = collections.Counter((v[b], v[a]) for v in held.values() for a in range(len(v)) for b in range(a))
    for (a, b), n in count.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            lab[max(x, y)] = min(x, y)
    place, first = {x: i for i, x in enumerate(lines)}, {}
    for d, i, x in at:
        first.setdefault(find(place[x]), (d, i))
    want = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not strip(x) or first[find(place[strip(x)])] == (d, i)) for d, t in rows}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


def test_blocks_of_a_large_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 8)
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("abcdefgh "), 300))
    lines = [base[:p] + "#" + base[p + 1 :] for p in range(5, 245, 6)]
    held = spark.createDataFrame([(1, i) for i in range(len(lines))], "bucket long, line long")
    texts = spark.createDataFrame(list(enumerate(lines)), "line long, text string")
    roots = {r.node: r.root for r in components(line_dedup.bucket_links(held, texts)).collect()}
    assert len(roots) == len(lines) and len(set(roots.values())) == 1


def test_line_dedup_columns(spark):
    df = spark.createDataFrame([(2, "same line here\nother", "en", 20), (1, "same line here", "de", 14), (None, "x\n\nsame line here", None, None)], "doc_id long, text string, lang string, n_chars long")
    got = {str(r.doc_id): (r.text, r.lang, r.n_chars) for r in line_dedup.dedup_lines(df, length_col="n_chars", counts=False).collect()}
    assert got == {"2": ("other", "en", 5), "1": ("", "de", 0), "None": ("x\n\nsame line here", None, 17)}
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_keep_one_goes_by_component_not_by_least_id(spark):
    word = lambda c, n=60: [f"{c}{i}" for i in range(n)]
    near = word("n")
    near[30] = "other"
    rows = [(1, " ".join(word("a"))), (1, " ".join(word("b"))), (2, " ".join(word("b") + ["end"])), (None, " ".join(word("n"))), (None, " ".join(near)), (None, " ".join(word("z")))]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    # two different texts with one id both stay; of the two linked texts without an id one stays, and the unlinked one
    assert sorted(t.split()[0] for d, t in kept if d == 1) == ["a0", "b0"] and not [d for d, _ in kept if d == 2]
    assert sorted(t.split()[0] for d, t in kept if d is None) == ["n0", "z0"] and len(kept) == 4


def test_long_texts_and_clashing_names(spark):
    """Very long texts are taken whole; columns of docs named like helpers or counts change nothing."""
    long = " ".join(f"w{i}" for i in range(120_000))
    lines = "\n".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(20_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short one"), (4, lines), (5, lines)], "doc_id long, text string")
    for c in ("th", "fp", "component_id", "root", "n_lines", "n_removed", "line", "bucket"):
        df = df.withColumn(c, F.lit("clash"))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert out[4].n_lines == out[5].n_lines == 20_000 and out[5].n_removed == 20_000 and out[5].text == "" and out[3].root == "clash" and out[1].n_removed + out[2].n_removed == 1


def test_near_dedup_stage_goes_by_fingerprints(spark, monkeypatch):
    """Without the join that follows, near copies whose fingerprints are up to two bits apart are found all the same."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(30):
        base = [f"w{x}" for x in rng.integers(0, 3000, 300)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join([*base, f"end{k}"])), (10 * k + 2, " ".join([*base[:150], f"Z{k}", *base[151:]]))]
    fp = {d: simhash.fingerprint(t, 5) for d, t in rows}
    near = [(10 * k, 10 * k + i) for k in range(30) for i in (1, 2) if (fp[10 * k] ^ fp[10 * k + i]).bit_count() <= 2]
    assert len(near) > 30
    none = spark.createDataFrame([], "u long, v long"), spark.createDataFrame([], "h long, node long, size long, rank long")
    monkeypatch.setattr(shingle_join, "candidates", lambda *a: none)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept >= {10 * k for k in range(30)} and not kept & {b for _, b in near}


def test_close_pairs_meet_at_anchors(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 400, dtype=np.int64).astype(np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, 1 + i % 8, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    df = spark.createDataFrame([(int(v),) for v in np.concatenate([x, y]).view(np.int64)], "fp long").repartition(3)
    got = {tuple(sorted((r.u % 2**64, r.v % 2**64))) for r in simhash.close_pairs(df).collect()}
    assert all((a ^ b).bit_count() <= simhash.REACH for a, b in got)
    found = collections.Counter(1 + i % 8 for i in range(400) if tuple(sorted((int(x[i]), int(y[i])))) in got)
    assert found[1] == found[2] == 50 and min(found[d] for d in range(3, 9)) >= 30  # up to two bits all
