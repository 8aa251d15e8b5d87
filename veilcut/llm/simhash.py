"""SimHash near-dedup by anchor-point covering.

Fingerprints of 64 bits link at `threshold` or fewer differing bits.  The anchors are the words of a
covering code: bits 0-22 and 23-45 each carry the perfect binary Golay code (23, 12), whose covering
radius is 3; the other 18 bits are free.  The anchor of x is the code word nearest to x, in both
blocks at most 3 bits away.  A y that differs from x in d bits lies at most 3 + d1 and 3 + d2 bits from
that anchor, with d1 + d2 <= d.  So every fingerprint is replicated to all anchors (c1, c2) with
max(0, |y1 - c1| - 3) + max(0, |y2 - c2| - 3) <= threshold: within covering radius plus threshold.  All
linked pairs then meet at an anchor; there are 2**24 anchors and 68 replicas on average.

Only distinct fingerprints are replicated, so copies cost nothing.  Per anchor, small groups are compared
in a vectorised way; a group over SMALL is linked by shared one-bit variants (two fingerprints at most two
bits apart share a variant), which is linear in the group.  A partition hands on a spanning forest of
what it found, never all pairs, and a distributed union-find joins the forests.

`keep_one`, the stage of the pipeline, takes five-word fingerprints and the same anchors, compares what meets there up
to REACH bits and confirms by exact Jaccard similarity.  Texts 0.8 alike differ in ten bits on average and in any number
at worst, so no radius finds all of them: an exact join then finds the links between what is still apart.

Defined cases: null or empty text has fingerprint zero and links like any other; fewer than `shingle`
words are one shingle; a null id takes part but is never a component id unless it stands alone; repeated
rows each come out; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOB_SCHEMA, NULL_ID, U, blob_batch, blob_rows, deal, frugal, gather, id_key, mix, part_of_hash, shuffle_parts, written
from .components import components, local_components
from .shingle_join import SHINGLE as NEAR_SHINGLE
from .shingle_join import SIMILARITY, few, near_groups

SHINGLE = 3
THRESHOLD = 2
SEED = 42
SMALL = 48
#: Bits in which fingerprints that meet at an anchor may differ to be worth an exact check; up to THRESHOLD all meet.
REACH = 12
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = 23
_GOLAY = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator of the Golay code


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text: an unsigned 64-bit number."""
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    start = end - size
    h64 = xxhash.xxh64_intdigest
    starts, ends = start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    count, m = np.zeros(64, np.int64), len(starts)
    for at in range(0, m, 1 << 15):
        h = np.array([h64(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])], U)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.uint32)
    return int(((2 * count > m).astype(U) << np.arange(64, dtype=np.uint64)).sum(dtype=U))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id long, th long, fp long), one row per row of docs; th is a hash of the text."""

    @frugal
    def run(batches):
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            fp = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in texts), U, b.num_rows)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


class Golay:
    """Errors of weight 5 or less by syndrome, for each excess over the covering radius."""

    def __init__(self):
        unit = []
        for i in range(_BITS):
            x = 1 << i
            for k in range(_BITS - 1, 10, -1):
                if x >> k & 1:
                    x ^= _GOLAY << (k - 11)
            unit.append(x)
        self.by_byte = [np.zeros(256, np.int64) for _ in range(3)]
        for j in range(3):
            for v in range(256):
                for i in range(8):
                    if v >> i & 1 and 8 * j + i < _BITS:
                        self.by_byte[j][v] ^= unit[8 * j + i]
        found = [[[] for _ in range(2048)] for _ in range(THRESHOLD + 1)]
        for w in range(3 + THRESHOLD + 1):
            for bits in combinations(range(_BITS), w):
                s = e = 0
                for i in bits:
                    s ^= unit[i]
                    e |= 1 << i
                found[max(0, w - 3)][s].append(e)
        if {len(x) for x in found[0]} != {1}:
            raise AssertionError("the code isn't perfect")
        self.start = [np.concatenate([[0], np.cumsum([len(x) for x in f])]) for f in found]
        self.error = [np.array([e for x in f for e in x], np.int64) for f in found]

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.by_byte[0][x & 255] ^ self.by_byte[1][x >> 8 & 255] ^ self.by_byte[2][x >> 16]

    def near(self, x: np.ndarray, excess: int):
        """Code words whose distance to x is the covering radius plus `excess` (0: at most the radius): rows and words."""
        s = self.syndrome(x)
        lo, n = self.start[excess][s], self.start[excess][s + 1] - self.start[excess][s]
        row = np.repeat(np.arange(len(x)), n)
        at = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, x[row] ^ self.error[excess][at]


_golay: Golay | None = None


def anchors(fp: np.ndarray, threshold: int = THRESHOLD):
    """All anchors of fingerprints: rows of fp and anchor numbers."""
    global _golay
    _golay = _golay or Golay()
    one = (fp & U((1 << _BITS) - 1)).astype(np.int64)
    two = (fp >> U(_BITS) & U((1 << _BITS) - 1)).astype(np.int64)
    rows, words = [], []
    for i in range(threshold + 1):
        row, c1 = _golay.near(one, i)
        for j in range(threshold + 1 - i):
            at, c2 = _golay.near(two[row], j)
            rows.append(row[at])
            words.append(c1[at] | c2 << _BITS)
    return np.concatenate(rows), np.concatenate(words)


def _variants_link(fp: np.ndarray, passes: int):
    """Links of a large group: fingerprints that share a variant of at most one changed bit."""
    n, u, v = len(fp), [], []
    for c in range(passes):
        z, own = [], []
        for b in range(65):
            x = fp if b == 64 else fp ^ (U(1) << U(b))
            mine = np.arange(n) if passes == 1 else np.flatnonzero(mix(x) % U(passes) == U(c))
            z.append(x[mine])
            own.append(mine)
        z, own = np.concatenate(z), np.concatenate(own)
        by = np.argsort(z)
        z, own = z[by], own[by]
        same = np.flatnonzero(z[1:] == z[:-1])
        u.append(own[same])
        v.append(own[same + 1])
    return np.concatenate(u), np.concatenate(v)


def _found(anchor: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fingerprints that share an anchor, and pairs of them (places) at most `threshold` bits apart; of a large group those of _variants_link."""
    order = np.lexsort((fp, anchor))
    anchor, fp = anchor[order], fp[order]
    edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.append(edge, len(anchor)))
    many = np.repeat(size > 1, size)
    anchor, fp, size = anchor[many], fp[many], np.repeat(size, size)[many]
    none = np.zeros(0, np.int64)
    us, vs = [none], [none]
    few = np.flatnonzero(size <= SMALL)
    a, f = anchor[few], fp[few]
    for k in range(1, SMALL):
        if k >= len(f):
            break
        same = np.flatnonzero(a[k:] == a[:-k])
        if not len(same):
            break
        near = same[np.bitwise_count(f[same] ^ f[same + k]) <= threshold]
        us.append(few[near])
        vs.append(few[near + k])
    large = np.flatnonzero(size > SMALL)
    if len(large):
        cuts = np.flatnonzero(np.concatenate([[True], anchor[large][1:] != anchor[large][:-1]]))
        for own in np.split(large, cuts[1:]):
            u, v = _variants_link(fp[own], 1 + len(own) // 100_000)
            us.append(own[u])
            vs.append(own[v])
    return fp, np.concatenate(us), np.concatenate(vs)


def link_groups(anchor: np.ndarray, fp: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints that share an anchor."""
    fp, u, v = _found(anchor, fp, threshold)
    nodes, at = np.unique(fp, return_inverse=True)
    root = local_components(len(nodes), at[u], at[v])
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def nearest(anchor: np.ndarray, fp: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint the nearest lesser one that shares an anchor, if at most `reach` bits away: linear in a group."""
    fp, u, v = _found(anchor, fp, reach)
    low, high = np.minimum(fp[u], fp[v]), np.maximum(fp[u], fp[v])
    order = np.lexsort((low, np.bitwise_count(low ^ high), high))
    low, high = low[order], high[order]
    first = np.ones(len(high), bool)
    first[1:] = high[1:] != high[:-1]
    return low[first], high[first]


def linked(distinct_fp: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v) links that span the components of distinct fingerprints; column fp long."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("threshold must be 0, 1 or 2")
    return _met(distinct_fp, threshold, lambda anchor, fp: link_groups(anchor, fp, threshold))


def close_pairs(distinct_fp: DataFrame, reach: int = REACH) -> DataFrame:
    """(u, v) distinct fingerprints at most `reach` bits apart that met at an anchor; column fp long."""
    return _met(distinct_fp, THRESHOLD, lambda anchor, fp: nearest(anchor, fp, reach)).distinct()


def _met(distinct_fp: DataFrame, threshold: int, judge) -> DataFrame:
    """What `judge` says of fingerprints that are replicated to all anchors: (u, v)."""
    parts = shuffle_parts(distinct_fp.sparkSession)

    @frugal
    def replicate(batches):
        for b in batches:
            all_fp = np.asarray(b.column(0)).view(np.uint64)
            for lo in range(0, len(all_fp), 4096):
                fp = all_fp[lo : lo + 4096]
                row, anchor = anchors(fp, threshold)
                part = part_of_hash(mix(anchor.astype(U)), parts)
                yield blob_batch(list(deal(part, parts, 0, ha=anchor, hf=fp[row])))

    @frugal
    def compare(batches):
        blobs = [blob for _, blob in blob_rows(batches)]
        if blobs:
            x = gather(blobs, ["ha", "hf"])
            u, v = judge(x["ha"], x["hf"])
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    dealt = distinct_fp.select("fp").mapInArrow(replicate, BLOB_SCHEMA).repartitionById(parts, "part")
    return dealt.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, th, fp long, fingerprint (hex), component_id (least id reachable)."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "op4-fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = written(nodes, "op4-nodes", small=True)
    roots = components(linked(nodes, threshold))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    member = named.select("fp", "root").join(groups, "root").select("fp", "component_id")
    return fps.join(member, "fp").select("doc_id", "th", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns: of each component of near copies the row with the least id (null last), one row only.

    Near copies share `similarity` of their word shingles.  Fingerprints that meet at anchors lead to them, the exact
    similarity decides; links that no anchor leads to are found by near_groups among what is still apart.
    """
    found = written(near_groups(docs, lambda raw: fingerprint(raw, shingle), close_pairs, similarity, shingle, id_col, text_col), "op4-groups")
    first = found.groupBy("root").agg(F.min(F.struct((F.col("id") == NULL_ID).alias("none"), "id", "th")).alias("x"))
    first = written(first, "op4-first", small=True)  # so that adaptive execution can split the rows of a large group in the join
    own = found.join(first, "root").groupBy("id", "th").agg(F.count("*").alias("n"), F.max((F.col("x.id") == F.col("id")) & (F.col("x.th") == F.col("th"))).alias("stays"))
    # rows to drop, and those of which one of several equal rows stays; all others come out as they are, without a shuffle
    touched = written(own.where("not stays or n > 1").select(F.col("id").alias("_id"), F.col("th").alias("_th"), "stays"), "op4-touched", small=True)
    held = docs.select(id_key(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    single = held.join(few(touched), ["_id", "_th"], "left_anti").select("_row.*")
    again = held.join(few(touched.where("stays")), ["_id", "_th"], "left_semi").groupBy("_id", "_th").agg(F.first("_row").alias("_row")).select("_row.*")
    return single.unionByName(again)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "fingerprint", "component_id")
