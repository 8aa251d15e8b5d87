"""Near copies by exact Jaccard similarity of word shingles: leads of fingerprints, then a prefix-filtered self-join that loses no pair.

The leads, pairs whose fingerprints a caller's search brings together, are confirmed first; the join looks only for
links between components that they leave apart.  Texts are sets of 64-bit hashes of `shingle` words in a row (ASCII letters lower-cased).  All hashes have one order.
Two sets whose similarity is s or more share one of the first n - ceil(s * n) + 1 hashes of either, so
only those prefixes are dealt by hash.  Of the pairs that meet in a hash three bounds, none of which loses a pair,
leave those worth a look: their sizes; what follows the hash in both (the first hash that two sets share has all
others that they share behind it); and parity bitmaps, some two bits a shingle: sets differ in at least as many hashes
as their bitmaps do in bits.  Pairs are ids and bitmaps until then; only those left are compared on their texts, first one
pair for each node, then those whose nodes aren't in one component yet.
The order is free: hashes that a sample of the documents shows often come last, which keeps
common passages out of the prefixes; the sample changes the time, never the result.

Equal sets are one node.  A hash with more than SMALL nodes is worked off in two rounds: the first links nodes to some
of their neighbours by size, the second compares the pairs that are still in different components, so a
large group of near copies costs in proportion to its size.

Defined cases: fewer than `shingle` words are one shingle; null and empty texts are one node, similar to nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOB_SCHEMA, CHUNK, U, blob_batch, blob_rows, deal, doc_chunks, frugal, gather, id_key, mix, part_of_hash, shuffle_parts, text_buffer, words_of, written
from .components import components
from .substring_dedup import window_hashes

SHINGLE = 5
SIMILARITY = 0.8
SMALL = 32
SAMPLE = 20_000
COMMON = 200_000
#: Bits of a parity bitmap, at least and at most; more bits only prune better.
BITS = (64, 1 << 17)
#: Rows of two longs that are broadcast at most; more are joined by a shuffle.
FEW_ROWS = 200_000
_CELL = U(0x5851F42D4C957F2D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE):
    """Distinct shingle hashes of documents: (document, hash), sorted by both."""
    _, _, words, first = words_of(_LOWER[data], offsets)
    size = np.diff(first)
    docs, hashes = [], []
    for k in sorted({min(shingle, int(n)) for n in np.unique(size) if n}):
        own = size >= shingle if k == shingle else size == k
        _, doc, h = window_hashes(words, first, k)
        docs.append(doc[own[doc]])
        hashes.append(h[own[doc]] + U(k))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, U)
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _nodes(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the sets of n documents, and their sizes."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h))])
    edge = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(edge)
    return mix(total[edge[1:]] - total[edge[:-1]] + mix(size.astype(U))), size


def _least_common(a: int | np.ndarray, similarity: float):
    """Least size of a set that can have the similarity with one of size a."""
    return np.ceil(a * similarity - 1e-9)


def _fits(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of sizes a and b may be similar if the first hash they share has places i and j in them."""
    need = np.ceil(similarity / (1 + similarity) * (a + b) - 1e-9)
    return np.minimum(a - i, b - j) >= need


def bitmaps(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Of every set a bit for each of a power of two of cells: whether an odd number of its hashes fall there."""
    bits = np.full(len(size), BITS[0], np.int64)
    while (small := (bits < 2 * size) & (bits < BITS[1])).any():
        bits[small] *= 2
    start = np.concatenate([[0], np.cumsum(bits)])
    cell = start[doc] + (mix(h ^ _CELL) & (bits[doc] - 1).astype(U)).astype(np.int64)
    odd = np.packbits((np.bincount(cell, minlength=start[-1]) & 1).astype(bool), bitorder="little").tobytes()
    return [odd[a >> 3 : b >> 3] for a, b in zip(start[:-1].tolist(), start[1:].tolist())]


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the shorter: no more than the sets differ in hashes."""
    x, y, n, m = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a), 8 * len(b)
    while n > m:
        n //= 2
        x = (x >> n) ^ (x & (1 << n) - 1)
    while m > n:
        m //= 2
        y = (y >> m) ^ (y & (1 << m) - 1)
    return (x ^ y).bit_count()


def nodes_of(docs: DataFrame, sketch: Callable[[bytes], int], shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id long, th long, node long, fp long, size long, bits binary), one row per row of docs; fp is the sketch of the text."""

    @frugal
    def run(batches):
        for ids, (th,), data, offsets in doc_chunks(batches, "id", "text", ("th",)):
            doc, h = shingle_sets(data, offsets, shingle)
            node, size = _nodes(doc, h, len(ids))
            fp = np.fromiter((sketch(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())), U, len(ids))
            cols = [ids, th, node.view(np.int64), fp.view(np.int64), size]
            yield pa.record_batch([*map(pa.array, cols), pa.array(bitmaps(doc, h, size), pa.binary())], ["id", "th", "node", "fp", "size", "bits"])

    rows = docs.select(id_key(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, th long, node long, fp long, size long, bits binary")


def leads(rows: DataFrame, met: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (u, v) of nodes with equal fingerprints, the least with each other, and of the least nodes of fingerprints that `met` pairs."""
    sketches = written(rows.select("node", "fp").distinct(), "near-sketches", small=True)
    first = written(sketches.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "near-sketch-first", small=True)
    equal = sketches.join(first.where("n > 1"), "fp").select(F.col("least").alias("u"), F.col("node").alias("v"))
    pairs = written(met(first.select("fp")), "near-met", small=True)
    for k in ("u", "v"):
        pairs = pairs.withColumnRenamed(k, "fp").join(first.select("fp", F.col("least").alias(k)), "fp").drop("fp")
    both = equal.unionByName(pairs)
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()


def common_hashes(docs: DataFrame, shingle: int, text_col: str) -> np.ndarray:
    """The hashes that a sample of about SAMPLE documents has most often, COMMON at most; only an order follows from them."""
    every = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64(text_col), F.lit(every)) == 0).select(F.lit(0).cast("long").alias("id"), F.col(text_col).alias("text"))

    @frugal
    def run(batches):
        for _, _, data, offsets in doc_chunks(batches, "id", "text"):
            h, n = np.unique(shingle_sets(data, offsets, shingle)[1], return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    top = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 4").orderBy(F.desc("n"), "h").limit(COMMON)
    return np.sort(np.array([r.h for r in top.select("h").collect()], np.int64).view(np.uint64))


def candidates(docs: DataFrame, shingle: int, similarity: float, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) to compare, and (h, node, size, rank) of hashes with many nodes."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    shared = spark.sparkContext.broadcast(common_hashes(docs, shingle, text_col))

    @frugal
    def prefixes(batches):
        often = shared.value
        for _, _, data, offsets in doc_chunks(batches, "id", "text"):
            doc, h = shingle_sets(data, offsets, shingle)
            node, size = _nodes(doc, h, len(offsets) - 1)
            late = np.isin(h, often)
            order = np.lexsort((h, late, doc))
            doc, h = doc[order], h[order]
            rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
            keep = rank <= size[doc] - _least_common(size[doc], similarity)
            doc, h, rank = doc[keep], h[keep], rank[keep]
            yield blob_batch(list(deal(part_of_hash(mix(h), parts), parts, 0, hh=h, hn=node[doc], size=size[doc].astype(np.int32), rank=rank.astype(np.int32))))

    @frugal
    def compare(batches):
        blobs = [blob for _, blob in blob_rows(batches)]
        if not blobs:
            return
        x = gather(blobs, ["hh", "hn", "size", "rank"])
        order = np.lexsort((x["hn"], x["size"], x["hh"]))
        h, node, size, rank = x["hh"][order], x["hn"][order], x["size"][order].astype(np.int64), x["rank"][order].astype(np.int64)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node, size, rank = h[new], node[new], size[new], rank[new]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(edge, len(h)))
        count = np.repeat(count, count)
        us, vs = [], []
        few = np.flatnonzero((count > 1) & (count <= SMALL))
        for k in range(1, SMALL):
            same = np.flatnonzero(h[few[k:]] == h[few[:-k]]) if k < len(few) else few[:0]
            if not len(same):
                break
            a, b = few[same], few[same + k]
            fine = _fits(size[a], size[b], rank[a], rank[b], similarity)
            us.append(node[a[fine]])
            vs.append(node[b[fine]])
        large = np.flatnonzero(count > SMALL)
        if len(large):  # the neighbour by size, and the first of each SMALL
            start = np.searchsorted(h, h[large])
            hub = start + (large - start) // SMALL * SMALL
            for a in (np.maximum(large - 1, start), hub, np.maximum(hub - SMALL, start)):
                fine = (a != large) & _fits(size[a], size[large], rank[a], rank[large], similarity)
                us.append(node[a[fine]])
                vs.append(node[large[fine]])
            for lo in range(0, len(large), 1 << 17):
                own = large[lo : lo + (1 << 17)]
                yield _rows(1, h[own], node[own], size[own], rank[own])
        u, v = _pairs(us, vs)
        for lo in range(0, len(u), 1 << 17):
            none = np.zeros(len(u[lo : lo + (1 << 17)]), np.int64)
            yield _rows(0, u[lo : lo + (1 << 17)], v[lo : lo + (1 << 17)], none, none)

    rows = docs.select(F.lit(0).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(prefixes, BLOB_SCHEMA).repartitionById(parts, "part").mapInArrow(compare, "kind int, u long, v long, n long, rank long")
    found = written(found, "near-candidates")
    return found.where("kind = 0").select("u", "v").distinct(), found.where("kind = 1").select(F.col("u").alias("h"), F.col("v").alias("node"), F.col("n").alias("size"), "rank")


def _rows(kind: int, u: np.ndarray, v: np.ndarray, n: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(u), kind, np.int32)), pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(n), pa.array(rank)], ["kind", "u", "v", "n", "rank"])


def _pairs(us: list, vs: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct unordered pairs."""
    if not us:
        return np.zeros(0, U), np.zeros(0, U)
    u, v = np.concatenate(us), np.concatenate(vs)
    u, v = np.minimum(u, v), np.maximum(u, v)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return u[new], v[new]


def open_pairs(members: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of a hash whose nodes are in different components and may be similar by size."""
    parts = shuffle_parts(members.sparkSession)
    held = members.join(roots, "node", "left").select("h", "node", "size", "rank", F.coalesce("root", "node").alias("root"))

    @frugal
    def deal_out(batches):
        for b in batches:
            h, node, size, rank, root = (np.asarray(c).view(np.uint64) for c in b.columns)
            yield blob_batch(list(deal(part_of_hash(mix(h), parts), parts, 0, hh=h, hn=node, hr=root, size=size.astype(np.int32), rank=rank.astype(np.int32))))

    @frugal
    def run(batches):
        blobs = [blob for _, blob in blob_rows(batches)]
        if not blobs:
            return
        x = gather(blobs, ["hh", "hn", "hr", "size", "rank"])
        order = np.lexsort((x["size"], x["hh"]))
        h, node, root, size, rank = x["hh"][order], x["hn"][order], x["hr"][order], x["size"][order].astype(np.int64), x["rank"][order].astype(np.int64)
        edge, us, vs, held = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), [], [], 0
        for lo, hi in zip(edge.tolist(), np.append(edge[1:], len(h)).tolist()):
            # of the largest component only the pairs with others: i runs over the nodes outside it
            roots, place, n = np.unique(root[lo:hi], return_inverse=True, return_counts=True)
            if len(roots) == 1:
                continue
            main = place == np.argmax(n)
            for i in np.flatnonzero(~main).tolist():
                i += lo
                a = lo + int(np.searchsorted(size[lo:hi], _least_common(size[i], similarity)))
                b = lo + int(np.searchsorted(size[lo:hi], math.floor(size[i] / similarity + 1e-9), "right"))
                fine = _fits(size[a:b], size[i], rank[a:b], rank[i], similarity)
                others = node[a:b][fine & (root[a:b] != root[i]) & (main[a - lo : b - lo] | (node[a:b] > node[i]))]
                us.append(others)
                vs.append(np.full(len(others), node[i]))
                held += len(others)
                if held > CHUNK:  # equal pairs of many hashes are one
                    u, v = _pairs(us, vs)
                    us, vs, held = [u], [v], 0 if len(u) < CHUNK // 2 else held
                    if held:
                        yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
                        us, vs, held = [], [], 0
        u, v = _pairs(us, vs)
        yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return held.mapInArrow(deal_out, BLOB_SCHEMA).repartitionById(parts, "part").mapInArrow(run, "u long, v long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs of nodes whose exact Jaccard similarity is at least `similarity`; texts is (node, text)."""

    @frugal
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                (d1, h1), (d2, h2) = (shingle_sets(*text_buffer(b.column(k)), shingle) for k in (2, 3))
                n1, n2 = np.bincount(d1, minlength=b.num_rows), np.bincount(d2, minlength=b.num_rows)
                doc, h = np.concatenate([d1, d2]), np.concatenate([h1, h2])
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                both = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (h[1:] == h[:-1])], minlength=b.num_rows)
                fine = both >= similarity * (n1 + n2 - both) - 1e-9
                yield pa.record_batch([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(fine))

    one = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    two = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs of nodes whose bitmaps allow the similarity; nodes is (node, size, bits)."""

    @frugal
    def run(batches):
        for b in batches:
            n = np.asarray(b.column(2)) + np.asarray(b.column(3))
            apart = np.fromiter((differing(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column(4), b.column(5))), np.int64, b.num_rows)
            common = (n - apart) / 2
            yield b.select(["u", "v"]).filter(pa.array(common >= similarity * (n - common) - 1e-9))

    one = nodes.select(F.col("node").alias("u"), F.col("size").alias("n"), F.col("bits").alias("a"))
    two = nodes.select(F.col("node").alias("v"), F.col("size").alias("m"), F.col("bits").alias("b"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "n", "m", "a", "b").mapInArrow(run, "u long, v long")


def few(rows: DataFrame) -> DataFrame:
    """A written table of some longs, to be broadcast if it has at most FEW_ROWS rows."""
    return F.broadcast(rows) if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS else rows


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) whose nodes are in different components."""
    for k in ("u", "v"):
        pairs = pairs.join(roots.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root")), k, "left")
    return pairs.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")


def near_groups(
    docs: DataFrame,
    sketch: Callable[[bytes], int],
    met: Callable[[DataFrame], DataFrame],
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, th, root) of every row of docs: root stands for the component of its text; id as of id_key, th a hash of the text.

    sketch: the fingerprint of a text; met: pairs (u, v) of a table of distinct fingerprints (fp) that are worth a look.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    rows = written(nodes_of(docs, sketch, shingle, id_col, text_col), "near-nodes")

    def worth(p: DataFrame) -> DataFrame:
        p = written(p, "near-pairs", small=True)
        named = p.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        nodes = rows.join(named, "node", "left_semi").groupBy("node").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
        return written(possible(p, nodes, similarity), "near-possible", small=True)

    def confirm(p: DataFrame) -> DataFrame:
        """p: a written table."""
        named = p.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        one = rows.join(named, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "th")).alias("x")).select("node", F.col("x.id").alias("id"), F.col("x.th").alias("th"))
        one = few(written(one, "near-named", small=True))
        held = docs.select(id_key(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
        texts = held.join(one, ["id", "th"]).groupBy("node").agg(F.first("text").alias("text"))
        return written(confirmed(p, written(texts, "near-texts", small=True), shingle, similarity), "near-links", small=True)

    def links_of(p: DataFrame, links: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The links confirmed so far and those among p, up to such within a component; their components."""
        p = worth(p)
        if not p.limit(1).count():
            return links, roots
        tree = written(p.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "near-tree", small=True)
        links = links.unionByName(confirm(tree))
        roots = components(links)
        apart = written(between(p.join(tree, ["u", "v"], "left_anti"), roots), "near-apart", small=True)
        if apart.limit(1).count():
            links = links.unionByName(confirm(apart))
            roots = components(links)
        return links, roots

    none = docs.sparkSession.createDataFrame
    links, roots = links_of(leads(rows, met), none([], "u long, v long"), none([], "node long, root long"))
    pairs, members = candidates(docs, shingle, similarity, text_col)
    members = written(members, "near-members", small=True)
    links, roots = links_of(between(pairs, roots), links, roots)
    if members.limit(1).count():
        links, roots = links_of(open_pairs(members, roots, similarity), links, roots)
    return rows.join(roots, "node", "left").select("id", "th", F.coalesce("root", "node").alias("root"))
