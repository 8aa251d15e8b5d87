"""Line dedup: fuzzy lines by MinHash, one line kept per component.

1. Lines (stripped, with at least one word) are known by a 64-bit hash; equal lines collapse in the chunk
   before anything is sent, so a line that a third of the documents hold costs an entry a chunk.
2. Signatures: the set of character shingles (SHINGLE code points) is hashed, split over BANDS * ROWS bins, and
   each bin's minimum is kept; bins without a shingle are filled from further rounds of hashing (one-permutation
   MinHash: a bin agrees with odds equal to the similarity, for short lines too).  BANDS bands of ROWS values
   are the bucket keys; at similarity 0.8 a pair shares a bucket with odds of 99 %, at 0.9 of 99.99 %.
3. Buckets with the same lines count once.  All lines of a bucket are compared exactly where they meet: each
   with the first, then those still apart with all others; large buckets by products of line-by-shingle matrices.  A task hands on a spanning forest of
   the links of similarity `similar` or more, never pairs.  Buckets of more than BLOCK_LINES lines or
   BLOCK_CHARS characters are cut into blocks, and every two blocks meet in a group of their own, so no task
   holds an unbounded bucket and none gives up a link.
4. Components come from the distributed union-find; of each component the line that comes first (by
   document id, then place) stays.

Texts cross the network once, packed, to be rewritten, and those of candidate lines once more: a filter of at
most 2**28 bits over the candidate ids (its size follows their number up to that bound) tells which lines to send;
false hits are dropped by the join.

Defined cases: null text stays null, and lines without a word always stay; lines shorter than a shingle are one
shingle; a null id comes before all others; rows that repeat an id are ordered by a hash of the text, equal rows
count as one and come out alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BLOB_SCHEMA,
    CHUNK,
    U,
    blob_batch,
    blob_rows,
    deal,
    dealt_rows,
    doc_parts,
    frugal,
    gather,
    keyed,
    mix,
    part_of_hash,
    part_of_id,
    powers,
    rows_of,
    shuffle_parts,
    written,
)
from .components import components, local_components

SHINGLE = 7
BANDS = 12
ROWS = 5
SIMILAR = 0.8
FILTER_BITS = 1 << 28
ROUNDS = 16
PIECE = 1 << 17
BLOCK_LINES = 512
BLOCK_CHARS = 1 << 21
FEW = 64
_ROLL = 0xA0761D6478BD642F
_SPACE = " \t\n\r\x0b\x0c"


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


_CODE = mix(np.arange(1 << 16, dtype=np.uint64))


def shingle_hashes(texts: list[str], k: int = SHINGLE):
    """Hashes of all k-shingles of code points of each text, and how many each text has; shorter texts are one shingle."""
    size = np.array([len(t) for t in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    code = _CODE[cp] if not n or cp.max() < 1 << 16 else mix(cp.astype(U))
    total = np.zeros(n + 1, U)
    np.cumsum(code * powers(n, base=_ROLL), out=total[1:])
    inverse = powers(n + 1, True, base=_ROLL)
    end = np.cumsum(size)
    each = np.maximum(1, size - k + 1)
    if n >= k:
        h = (total[k:] - total[:-k]) * inverse[: n - k + 1]
        inside = np.ones(n, bool)  # starts whose shingle ends in the same text
        for d in range(1, k):
            at = end - d
            inside[at[(at >= 0) & (size >= d)]] = False
        h = h[inside[: n - k + 1]]
    else:
        h = np.zeros(0, U)
    short = np.flatnonzero(size < k)
    if len(short):
        stop = end[short]
        start = stop - size[short]
        own = (total[stop] - total[start]) * inverse[start] + size[short].astype(U)
        place = np.cumsum(np.where(size < k, 0, each))[short]
        h = np.insert(h, place, own)
    return mix(h), each


def _bins(h: np.ndarray, bins: int) -> np.ndarray:
    return ((h >> U(40)) * U(bins) >> U(24)).astype(np.int64)


def signatures(texts: list[str], k: int = SHINGLE, bins: int = BANDS * ROWS) -> np.ndarray:
    """One-permutation MinHash: (texts, bins) of values; a round of hashing fills the bins that those before left empty."""
    h, each = shingle_hashes(texts, k)
    row = np.repeat(np.arange(len(texts)) * bins, each)
    low = U((1 << 40) - 1)
    sig = np.zeros(len(texts) * bins, U)
    full = np.zeros(len(texts) * bins, bool)
    for r in range(ROUNDS):
        cell = row + _bins(h, bins)
        if r:
            new = ~full[cell]
            key = np.sort(cell[new].astype(U) << U(40) | h[new] & low)
        else:
            key = np.sort(cell.astype(U) << U(40) | h & low)
        at = (key >> U(40)).astype(np.int64)
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        at = at[first]
        sig[at], full[at] = (key[first] & low) + (U(r) << U(40)), True
        lacking = ~full.reshape(-1, bins).all(1)
        if not lacking.any():
            break
        more = lacking[row // bins]
        h, row = mix(h[more] + U(0x2545F4914F6CDD1D)), row[more]
    return mix(sig).reshape(-1, bins)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = []
    for b in range(bands):
        key = np.full(len(sig), b + 1, U)
        for r in range(rows):
            key = mix(key * U(0xC2B2AE3D27D4EB4F) + sig[:, b * rows + r])
        out.append(key)
    return np.stack(out, 1)


class Shingles:
    """Sets of shingle hashes of many texts (48 bits in a set), sorted."""

    def __init__(self, texts: list[str], k: int = SHINGLE):
        parts, sizes, at = [], [], 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (to == at or held + len(texts[to]) < PIECE):
                held += len(texts[to])
                to += 1
            h, each = shingle_hashes(texts[at:to], k)
            key = np.sort(np.repeat(np.arange(to - at).astype(U) << U(48), each) | h >> U(16))
            key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]
            sizes.append(np.bincount((key >> U(48)).astype(np.int64), minlength=to - at))
            parts.append(key & U((1 << 48) - 1))
            at = to
        self.h = np.concatenate(parts) if parts else np.zeros(0, U)
        self.size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def similar(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Exact Jaccard similarities of pairs of texts."""
        out, lo = np.zeros(len(u)), 0
        weight = np.cumsum(self.size[u] + self.size[v])
        while lo < len(u):
            hi = min(max(lo + 1, int(np.searchsorted(weight, (weight[lo - 1] if lo else 0) + PIECE))), lo + 60_000, len(u))
            both = np.stack([u[lo:hi], v[lo:hi]], 1).ravel()
            n = self.size[both]
            total = int(n.sum())
            take = np.repeat(self.at[both] - (np.cumsum(n) - n), n) + np.arange(total)
            pair = np.repeat(np.arange(hi - lo), n.reshape(-1, 2).sum(1)).astype(U)
            key = np.sort(pair << U(48) | self.h[take])
            common = np.bincount((key[:-1][key[1:] == key[:-1]] >> U(48)).astype(np.int64), minlength=hi - lo)
            out[lo:hi] = common / (self.size[u[lo:hi]] + self.size[v[lo:hi]] - common)
            lo = hi
        return out

    def products(self, own: np.ndarray, similar: float, columns: int = 2048):
        """Links among many texts: shared shingles counted by products of 0/1 matrices, some columns at a time."""
        size = self.size[own]
        h = np.concatenate([self.h[self.at[i] : self.at[i + 1]] for i in own])
        row = np.repeat(np.arange(len(own)), size)
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        at = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
        shared = np.bincount(at)[at] > 1
        row, at = row[shared], at[shared]
        at = np.cumsum(np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]) - 1
        common = np.zeros((len(own), len(own)), np.float32)
        for c in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
            lo, hi = np.searchsorted(at, c), np.searchsorted(at, c + columns)
            m = np.zeros((len(own), min(columns, int(at[hi - 1]) - c + 1)), np.float32)
            m[row[lo:hi], at[lo:hi] - c] = 1
            common += m @ m.T
        u, v = np.nonzero(np.triu(common / (size[:, None] + size[None, :] - common) >= similar, 1))
        return own[u], own[v]

    def links(self, groups: list[np.ndarray], similar: float):
        """Links that span the components of each group: everyone with the first, then what is still apart in a group."""
        first = np.concatenate([np.full(len(g) - 1, g[0]) for g in groups])
        rest = np.concatenate([g[1:] for g in groups])
        fine = self.similar(first, rest) >= similar
        us, vs, us2, vs2 = [first[fine]], [rest[fine]], [], []
        at = 0
        for g in groups:
            linked = fine[at : at + len(g) - 1]
            at += len(g) - 1
            if linked.all() or len(g) == 2:
                continue
            if len(g) > FEW:
                u, v = self.products(g, similar)
                us.append(u)
                vs.append(v)
                continue
            apart, near = g[1:][~linked], g[1:][linked]
            i, j = np.triu_indices(len(apart), 1)
            us2 += [apart[i], np.repeat(apart, len(near))]
            vs2 += [apart[j], np.tile(near, len(apart))]
        if us2:
            u, v = np.concatenate(us2), np.concatenate(vs2)
            fine = self.similar(u, v) >= similar
            us.append(u[fine])
            vs.append(v[fine])
        return np.concatenate(us), np.concatenate(vs)


def _lines(text: str):
    """(place, stripped line) of the lines that have a word."""
    for i, line in enumerate(text.split("\n")):
        if line := line.strip(_SPACE):
            yield i, line


def _chunks(batches, size: int):
    """Texts of (id, th, text) batches in runs of about `size` characters."""
    for b in batches:
        ids, ths = np.asarray(b.column(0)), np.asarray(b.column(1))
        lo, held, texts = 0, 0, []
        for i, t in enumerate(b.column(2)):
            t = t.as_py() or ""
            texts.append(t)
            held += len(t)
            if held >= size:
                yield ids[lo : i + 1], ths[lo : i + 1], texts
                lo, held, texts = i + 1, 0, []
        if texts:
            yield ids[lo:], ths[lo:], texts


def occurrences(key_docs: DataFrame) -> DataFrame:
    """(id, th, place, line long): every line that has a word."""

    @frugal
    def run(batches):
        for ids, ths, texts in _chunks(batches, CHUNK):
            rows = [(i, place, line_id(line)) for i, t in enumerate(texts) for place, line in _lines(t)]
            if rows:
                own, place, line = zip(*rows)
                own, line = np.array(own), np.fromiter(line, U, len(line))
                yield pa.record_batch([pa.array(ids[own]), pa.array(ths[own], pa.int32()), pa.array(place, pa.int32()), pa.array(line.view(np.int64))], ["id", "th", "place", "line"])

    return key_docs.mapInArrow(run, "id long, th int, place int, line long")


def buckets(key_docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """(bucket, line): the lines of every different bucket with two lines or more."""
    parts = shuffle_parts(key_docs.sparkSession)

    @frugal
    def sign(batches):
        for _, _, texts in _chunks(batches, 4 * CHUNK):
            lines = list({line: None for t in texts for _, line in _lines(t)})
            keys, at = [], 0
            while at < len(lines):
                to, held = at, 0
                while to < len(lines) and (to == at or held + len(lines[to]) < PIECE):
                    held += len(lines[to])
                    to += 1
                keys.append(band_keys(signatures(lines[at:to], k, bands * rows), bands, rows))
                at = to
            if not lines:
                continue
            key = np.concatenate(keys).reshape(-1)
            ids = np.repeat(np.array([line_id(x) for x in lines], U), bands)
            yield blob_batch(list(deal(part_of_hash(key, parts), parts, 0, hk=key, hi=ids)))

    @frugal
    def meet(batches):
        blobs = [b for _, b in blob_rows(batches)]
        x = gather(blobs, ["hk", "hi"])
        if not len(x["hk"]):
            return
        by = np.argsort(x["hk"])
        key = x["hk"][by]
        equal = key[1:] == key[:-1]
        by = by[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]
        key, line = x["hk"][by], x["hi"][by]
        order = np.lexsort((line, key))
        key, line = key[order], line[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])])[: len(key)]
        key, line = key[new], line[new]
        if not len(key):
            return
        lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(lead, len(key)))
        # the name of a bucket is a hash of its lines
        name = mix(np.add.reduceat(mix(line), lead) + size.astype(U))
        keep = np.repeat(size > 1, size)
        yield pa.record_batch([pa.array(np.repeat(name, size)[keep].view(np.int64)), pa.array(line[keep].view(np.int64))], ["bucket", "line"])

    dealt = key_docs.mapInArrow(sign, BLOB_SCHEMA).repartitionById(parts, "part")
    return dealt.mapInArrow(meet, "bucket long, line long").distinct()


def _filter(ids: DataFrame, most: int = FILTER_BITS):
    """A bit set over ids (column line), at most `most` bits, 64 bits an id below that; built by bit_or in Spark."""
    n = ids.count()
    bits = 1 << 16
    while bits < min(most, 64 * n):
        bits *= 2
    at = F.pmod(F.xxhash64("line"), F.lit(bits))
    words = ids.select(F.shiftright(at, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(line), {bits}) % 64 as int))").alias("b"))
    table = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(table.column("w").combine_chunks())] = np.asarray(table.column("b").combine_chunks())
    return bits, out


def texts_of_lines(key_docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(line, text) of the lines in ids (column line, distinct)."""
    bits, words = _filter(ids)
    shared = key_docs.sparkSession.sparkContext.broadcast(words)

    @frugal
    def lines(batches):
        for _, _, texts in _chunks(batches, CHUNK):
            found = {line_id(x): x for t in texts for _, x in _lines(t)}
            if found:
                yield pa.record_batch([pa.array(np.fromiter(found, U, len(found)).view(np.int64)), pa.array(list(found.values()), pa.string())], ["line", "text"])

    @frugal
    def keep(batches):
        for b in batches:
            at = np.asarray(b.column(1))
            hit = shared.value[at >> 6] >> (at & 63) & 1
            yield b.filter(pa.array(hit == 1)).select(["line", "text"])

    every = key_docs.mapInArrow(lines, "line long, text string")
    near = every.select("line", F.pmod(F.xxhash64("line"), F.lit(bits)).alias("at"), "text").mapInArrow(keep, "line long, text string")
    return near.join(ids.select("line"), "line", "left_semi").groupBy("line").agg(F.first("text").alias("text"))


def bucket_links(held: DataFrame, texts: DataFrame, similar: float = SIMILAR, k: int = SHINGLE) -> DataFrame:
    """(u, v): spanning forests of the lines of each bucket whose exact similarity reaches `similar`."""
    sized = held.join(texts, "line").select("bucket", "line", "text", F.length("text").alias("n"))
    total = held.join(texts.select("line", F.length("text").alias("n")), "line").groupBy("bucket").agg(F.count("*").alias("lines"), F.sum("n").alias("chars"))
    large = total.where((F.col("lines") > BLOCK_LINES) | (F.col("chars") > BLOCK_CHARS))
    large = large.select("bucket", F.ceil(F.greatest(F.col("lines") / (BLOCK_LINES // 2), F.col("chars") / (BLOCK_CHARS // 2))).cast("int").alias("blocks"))
    cut = sized.join(large, "bucket", "left")
    mine = F.pmod(F.xxhash64("line"), F.col("blocks"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, mine) * F.col("blocks") + F.greatest(x, mine))
    cut = cut.select("bucket", "line", "text", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(meets)).alias("pair"))
    parts = shuffle_parts(held.sparkSession)

    def work(groups, texts, lines):
        groups = [np.array(g) for g in groups if len(g) > 1]
        if not groups:
            return None
        u, v = Shingles(texts, k).links(groups, similar)
        ids, at = np.unique(np.array(lines), return_inverse=True)
        root = local_components(len(ids), at[u], at[v])
        moved = root != np.arange(len(ids))
        return pa.record_batch([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["u", "v"])

    @frugal
    def run(batches):
        groups, texts, lines, held, now = [], [], [], 0, None
        for b in batches:
            for bucket, pair, line, text in zip(*(c.to_pylist() for c in b.columns)):
                if (bucket, pair) != now:
                    if held > CHUNK // 2:
                        if (out := work(groups, texts, lines)) is not None:
                            yield out
                        groups, texts, lines, held = [], [], [], 0
                    groups.append([])
                    now = (bucket, pair)
                groups[-1].append(len(texts))
                texts.append(text)
                lines.append(line)
                held += len(text)
        if groups and (out := work(groups, texts, lines)) is not None:
            yield out

    dealt = cut.select("bucket", "pair", "line", "text").repartition(parts, "bucket", "pair").sortWithinPartitions("bucket", "pair")
    return dealt.mapInArrow(run, "u long, v long")


def line_components(key_docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(node, root) of the distinct lines that have a near line."""
    held = written(buckets(key_docs), "op5-buckets", small=True)
    texts = written(texts_of_lines(key_docs, held.select("line").distinct()), "op5-lines", small=True)
    return components(bucket_links(held, texts, similar))


def dedup_lines(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, counts: bool = True) -> DataFrame:
    """The rows and columns of docs, the text without repeated lines; with counts also n_lines and n_removed.

    length_col: a column that gets the new length in code points.  With counts, columns of docs named n_lines or n_removed
    give way to the counts.
    """
    if counts:
        docs = docs.drop("n_lines", "n_removed")
    key_docs = keyed(docs, id_col, text_col)
    at = written(occurrences(key_docs), "op5-occurrences")
    roots = line_components(key_docs, similar)
    firsts = at.groupBy("line").agg(F.min(F.struct("id", "th", "place")).alias("first"), F.count("*").alias("n"))
    named = firsts.join(roots.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
    kept = named.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("n")).where("n > 1")
    of = written(named.join(kept.drop("n"), "root").select("line", "kept"), "op5-kept", small=True)
    gone = at.join(of, "line").where((F.col("kept.id") != F.col("id")) | (F.col("kept.th") != F.col("th")) | (F.col("kept.place") != F.col("place"))).select("id", "th", "place")
    homes = doc_parts(docs.sparkSession)

    @frugal
    def send(batches):
        for b in batches:
            ids, th, place = (np.asarray(c) for c in b.columns)
            if len(ids):
                yield blob_batch(list(deal(part_of_id(ids, homes), homes, 0, doc=ids, th=th, place=place)))

    both = gone.mapInArrow(send, BLOB_SCHEMA).unionByName(dealt_rows(docs, id_col, text_col, homes))
    names = docs.columns
    where, length = names.index(text_col), names.index(length_col) if length_col else None

    @frugal
    def rewrite(batches):
        blobs, drop = [], None
        for kind, blob in blob_rows(batches):
            if kind == 0:
                blobs.append(blob)
                continue
            if drop is None:
                drop = gather(blobs, ["doc", "th", "place"])
                order = np.lexsort((drop["place"], drop["th"], drop["doc"])) if len(drop["doc"]) else []
                drop = {k: v[order] for k, v in drop.items()} if len(order) else drop
            b = rows_of(blob)
            texts, lines, lost = [], [], []
            for i, th, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2 + where).to_pylist()):
                lo, hi = np.searchsorted(drop["doc"], i), np.searchsorted(drop["doc"], i, "right")
                lo, hi = lo + np.searchsorted(drop["th"][lo:hi], th), lo + np.searchsorted(drop["th"][lo:hi], th, "right")
                own = t.split("\n") if t is not None else []
                n = sum(1 for x in own if x.strip(_SPACE))
                if hi > lo:
                    bad = set(drop["place"][lo:hi].tolist())
                    t = "\n".join(x for k, x in enumerate(own) if k not in bad)
                    lost.append(len(bad))
                else:
                    lost.append(0)
                texts.append(t)
                lines.append(n)
            columns = list(b.columns[2:])
            columns[where] = pa.array(texts, pa.string())
            if length is not None:
                columns[length] = pa.array([None if t is None else len(t) for t in texts], b.column(2 + length).type)
            fields = list(names)
            if counts:
                columns += [pa.array(lines, pa.int64()), pa.array(lost, pa.int64())]
                fields += ["n_lines", "n_removed"]
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    schema = docs.schema
    if counts:
        schema = type(schema)(list(schema.fields)).add("n_lines", "long").add("n_removed", "long")
    return both.repartitionById(homes, "part").sortWithinPartitions("kind").mapInArrow(rewrite, schema)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
