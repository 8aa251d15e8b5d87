"""Suffix dedup by bucket-pointer refinement: bytes covered by a repeated string of `length` bytes go.

The suffixes compared are the starts of all windows of `length` bytes.  A bucket holds suffixes that
agree in a prefix or a core; its identifier is refined with the identifiers of later offsets:

* identifiers: id_8 is the 8-byte word at an offset, id_2k(i) joins id_k(i) and id_k(i + k); what one
  step computed is reused by the next and by every longer string (two pointers cover any length
  between k and 2k).  Ranks of a global sort would need all suffixes in one order, eight bytes each
  and a shuffle a step; joined 64-bit identifiers name the same buckets without it.
* initial q-gram buckets: each window has an anchor, its q-gram (q = 128) of least identifier, so
  equal windows have equal anchors at equal offsets.  Consecutive windows with one anchor form a
  segment, and the anchor's q-gram is its bucket.
* refinement: a bucket of one segment is done (no repeat).  Segments of one bucket that agree over
  their whole context are done (all repeated); one of them stays as their representative.  Other
  segments are split by later offsets into blocks of 16 windows whose bucket is their common core,
  then blocks into single windows, each step sorting the active entries of a partition by
  (bucket, context) and passing on only what is still undecided.

Each level deals entries by bucket; a chunk sends one entry per distinct (bucket, context), so exact
copies cost one entry a chunk however many there are.  Decisions return to the partition of the
document.  Texts are never compared in pairs.

Defined cases: null text is empty; a null id is an id of its own; equal rows (id and text) count as one
document and each come out; documents shorter than `length` keep all; other columns are ignored.
Odds that two different strings among n share an identifier: n*n/2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BLOB_SCHEMA,
    CHUNK,
    NULL_ID,
    U,
    Ranges,
    blob_batch,
    blob_rows,
    deal,
    dealt_texts,
    doc_chunks,
    doc_parts,
    frugal,
    gather,
    keyed,
    mix,
    part_of_hash,
    part_of_id,
    shuffle_parts,
    texts_of,
    unpack,
    written,
)

LENGTH = 400
Q = 128
BLOCK = 16
DONE, TEXT, OPEN, ENTRY = 0, 1, 2, 3
_JOIN = U(0xC2B2AE3D27D4EB4F)
_LOW = U((1 << 24) - 1)


def join_ids(*ids: np.ndarray) -> np.ndarray:
    out = ids[0]
    for x in ids[1:]:
        out = mix(out * _JOIN + x)
    return out


def identifiers(data: np.ndarray, size: int, keep: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Bucket identifiers of all strings of 2**k bytes, up to `size`; those in keep are returned."""
    n, out = len(data), {}
    data = np.ascontiguousarray(data)
    have = mix(np.ndarray((max(0, n - 7),), "<u8", data, 0, (1,)).astype(np.uint64)) if n >= 8 else np.zeros(0, U)
    k = 8
    while True:
        if k in keep:
            out[k] = have
        if k >= size:
            return out
        have = join_ids(have[: max(0, len(have) - k)], have[k:])
        k *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[: len(x) - k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def segments(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of windows with one anchor: (document, first start, windows, anchor - first start, bucket, context)."""
    n = len(data)
    if n < length:
        return None
    ids = identifiers(data, 256, (Q, 256))
    anchor = sliding_min((ids[Q] & ~_LOW) | np.arange(len(ids[Q]), dtype=np.uint64), length - Q + 1) & _LOW
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + length <= end)
    if not len(start):
        return None
    anchor = anchor[start].astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    lead = np.flatnonzero(new)
    lo, a = start[lead], anchor[lead]
    hi = start[np.append(lead[1:], len(start)) - 1]
    whole = hi - lo + length
    big = ids[256]
    context = join_ids(big[lo], big[lo + (whole - 256) // 2], big[lo + whole - 256], ((a - lo) << 16 | whole).astype(U))
    doc = np.searchsorted(offsets, lo, "right") - 1
    return doc, lo, hi - lo + 1, a - lo, ids[Q][a], context


def _units(data: np.ndarray, offsets: np.ndarray, length: int, size: int = CHUNK):
    """Documents of a chunk in runs of about `size` bytes; longer documents in overlapping pieces: (first document, base, data, offsets)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1))
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= 2 * size:
            yield lo, 0, data[a:b], offsets[lo : hi + 1] - a
        else:
            for u in range(a, b, size):
                v = min(b, u + size + length - 1)
                yield lo, u - a, data[u:v], np.array([0, v - u])
                if v == b:
                    break
        lo = hi


def _first_rows(ids, th):
    """Mask of rows that aren't equal to an earlier row by (id, th)."""
    order = np.lexsort((th, ids))
    same = np.zeros(len(ids), bool)
    a, b = order[:-1], order[1:]
    same[b] = (ids[a] == ids[b]) & (th[a] == th[b])
    return ~same


def _done(doc, th, lo, n, length: int, homes: int):
    """Ranges of bytes that n windows from lo cover, dealt by document."""
    ranges = {"doc": doc, "th": th, "lo": lo.astype(np.uint32), "n": (n.astype(np.int64) + length - 1).astype(np.uint32)}
    return deal(part_of_id(doc, homes), homes, DONE, **ranges)


def _send(x: dict[str, np.ndarray], length: int, parts: int, homes: int):
    """Entries of a chunk to the partition of their bucket, one per (bucket, context); copies in the chunk are done."""
    both = join_ids(x["hb"], x["hc"])
    by = np.argsort(both)
    s = both[by]
    edge = np.concatenate([[True], s[1:] != s[:-1]])
    one = np.zeros(len(s), bool)
    one[np.minimum.reduceat(by, np.flatnonzero(edge))] = True
    many = np.zeros(len(s), bool)
    many[by] = ~edge | np.append(~edge[1:], False)
    if many.any():
        yield from _done(*(x[k][many] for k in ("doc", "th", "lo", "n")), length, homes)
    x = {k: v[one] for k, v in x.items()}
    # mixed anew: the identifiers of anchors are minima, so their leading bits are small
    yield from deal(part_of_hash(mix(x["hb"]), parts), parts, ENTRY, **x)


def _refine(blobs: list[bytes], length: int, homes: int):
    """Sort the entries of a partition by (bucket, context) and decide them."""
    x = gather(blobs, ["hb", "hc", "doc", "th", "lo", "n", "ao"])
    if not len(x["hb"]):
        return
    order = np.lexsort((x["lo"], x["th"], x["doc"], x["hc"], x["hb"]))
    x = {k: v[order] for k, v in x.items()}
    differs = lambda *names: np.concatenate([[True], np.logical_or.reduce([x[k][1:] != x[k][:-1] for k in names])])
    x = {k: v[keep] for keep in [differs("hb", "hc", "doc", "th", "lo")] for k, v in x.items()}  # an equal row in another chunk
    bucket, context = differs("hb"), differs("hb", "hc")
    lead = np.flatnonzero(context)
    copies = np.diff(np.append(lead, len(context)))
    full = np.repeat(copies > 1, copies)
    if full.any():
        yield from _done(*(x[k][full] for k in ("doc", "th", "lo", "n")), length, homes)
    kinds = np.add.reduceat(context.astype(np.int64), np.flatnonzero(bucket))
    still = (kinds > 1)[np.cumsum(bucket)[lead] - 1]
    if still.any():
        y = {k: x[k][lead[still]] for k in ("doc", "th", "lo", "n", "ao")}
        yield from deal(part_of_id(y["doc"], homes), homes, OPEN, **y)


def _decided(entries: DataFrame, length: int, parts: int) -> DataFrame:
    homes = doc_parts(entries.sparkSession)

    @frugal
    def run(batches):
        blobs = []
        for kind, blob in blob_rows(batches):
            if kind == ENTRY:
                blobs.append(blob)
            else:
                yield blob_batch([(int(part_of_id(unpack(blob)["doc"][:1], homes)[0]), kind, blob)])
        if rows := list(_refine(blobs, length, homes)):
            yield blob_batch(rows)

    return entries.repartitionById(parts, "part").mapInArrow(run, BLOB_SCHEMA)


def _entry(hb, hc, doc, th, lo, n, ao) -> dict[str, np.ndarray]:
    return {"hb": hb, "hc": hc, "doc": doc, "th": th, "lo": lo.astype(np.uint32), "n": n.astype(np.uint16), "ao": ao.astype(np.uint16)}


def _initial(key_docs: DataFrame, length: int, parts: int) -> DataFrame:
    homes = doc_parts(key_docs.sparkSession)

    @frugal
    def run(batches):
        for ids, (th,), data, offsets in doc_chunks(batches, "id", "text", ("th",), 4 * CHUNK):
            first, found = _first_rows(ids, th), []
            for at, base, part, inner in _units(data, offsets, length):
                if (got := segments(part, inner, length)) is not None:
                    doc, lo, n, ao, hb, hc = got
                    lo = lo - inner[doc] + base
                    keep = first[doc + at]
                    found.append(_entry(*(v[keep] for v in (hb, hc, ids[doc + at], th[doc + at], lo, n, ao))))
            if found:
                x = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
                if len(x["hb"]):
                    yield blob_batch(list(_send(x, length, parts, homes)))

    return key_docs.mapInArrow(run, BLOB_SCHEMA)


def _blocks(item: dict[str, np.ndarray], big: np.ndarray, at: np.ndarray, length: int):
    """Segments as blocks of BLOCK windows by their distance to the anchor; at: where the text lies in `big`."""
    lo, n, ao = (item[k].astype(np.int64) for k in ("lo", "n", "ao"))
    nearest = ao - n + 1
    count = ao // BLOCK - nearest // BLOCK + 1
    own = np.repeat(np.arange(len(lo)), count)
    k = nearest[own] // BLOCK + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    anchor = (lo + ao)[own]
    far, near = np.minimum(k * BLOCK + BLOCK - 1, ao[own]), np.maximum(k * BLOCK, nearest[own])
    start, windows, here = anchor - far, far - near + 1, at[own]
    core = length - BLOCK + 1
    x = here + anchor - k * BLOCK
    hb = join_ids(big[x], big[x + core - 256])
    whole = windows + length - 1
    hc = join_ids(big[here + start], big[here + start + whole - 256], whole.astype(U))
    return own, start, windows, hb, hc


def _windows(item: dict[str, np.ndarray], big: np.ndarray, at: np.ndarray, length: int):
    lo, n = item["lo"].astype(np.int64), item["n"].astype(np.int64)
    own = np.repeat(np.arange(len(lo)), n)
    start = lo[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    x = at[own] + start
    h = join_ids(big[x], big[x + length - 256])
    return own, start, np.ones(len(own), np.int64), h, h


def _finer(open_items: DataFrame, key_docs: DataFrame, split, length: int, parts: int) -> DataFrame:
    """Undecided entries, split by `split` with the identifiers of their documents at hand."""
    homes = doc_parts(key_docs.sparkSession)

    def send(found):
        x = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
        return blob_batch(list(_send(x, length, parts, homes)))

    @frugal
    def run(batches):
        blobs, item, found, entries = [], None, [], 0
        for kind, blob in blob_rows(batches):
            if kind != TEXT:
                blobs.append(blob)
                continue
            if item is None:
                item = gather(blobs, ["doc", "th", "lo", "n", "ao"])
                order = np.lexsort((item["lo"], item["th"], item["doc"])) if len(item["doc"]) else np.zeros(0, np.int64)
                item = {k: v[order] for k, v in item.items()}
            if not len(item["doc"]):
                continue
            ids, th, data, offsets = texts_of(blob)
            for i in np.flatnonzero(_first_rows(ids, th)):
                a, b = np.searchsorted(item["doc"], ids[i]), np.searchsorted(item["doc"], ids[i], "right")
                a, b = a + np.searchsorted(item["th"][a:b], th[i]), a + np.searchsorted(item["th"][a:b], th[i], "right")
                if a == b:
                    continue
                own = {k: v[a:b] for k, v in item.items()}
                more = _split_document(own, data[offsets[i] : offsets[i + 1]], split, length)
                found += more
                entries += sum(len(f["hb"]) for f in more)
            if entries >= 1 << 19:
                yield send(found)
                found, entries = [], 0
        if found:
            yield send(found)

    both = open_items.where(F.col("kind") == OPEN).unionByName(dealt_texts(key_docs, homes, TEXT))
    return both.repartitionById(homes, "part").sortWithinPartitions(F.col("kind") == TEXT).mapInArrow(run, BLOB_SCHEMA)


def _split_document(own: dict[str, np.ndarray], data: np.ndarray, split, length: int, size: int = CHUNK):
    """Entries of one document split; identifiers are made for stretches of about `size` bytes that hold entries."""
    out, at = [], 0
    lo, n = own["lo"].astype(np.int64), own["n"].astype(np.int64)
    margin = 2 * length
    while at < len(lo):
        base = max(0, int(lo[at]) - margin)
        to = at + max(1, int(np.searchsorted(lo[at:], base + size, "right")))
        end = min(len(data), int((lo[at:to] + n[at:to]).max()) + margin)
        big = identifiers(data[base:end], 256, (256,))[256]
        item = {k: v[at:to] for k, v in own.items()}
        j, start, windows, hb, hc = split(item, big, np.full(to - at, -base), length)
        out.append(_entry(hb, hc, item["doc"][j], item["th"][j], start, windows, np.zeros(len(j), np.int64)))
        at = to
    return out


def repeated_ranges(key_docs: DataFrame, length: int = LENGTH) -> list[DataFrame]:
    """Tables of blobs: the byte ranges that repeated windows cover, by level of refinement."""
    parts = shuffle_parts(key_docs.sparkSession)
    one = written(_decided(_initial(key_docs, length, parts), length, parts), "op2-segments")
    two = written(_decided(_finer(one, key_docs, _blocks, length, parts), length, parts), "op2-blocks")
    three = written(_decided(_finer(two, key_docs, _windows, length, parts), length, parts), "op2-windows")
    return [x.where(F.col("kind") == DONE) for x in (one, two, three)]


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans.  length: 271 to 512."""
    if not Q + BLOCK + 127 <= length <= 512:
        raise ValueError("length must be from 271 to 512")
    key_docs = keyed(docs, id_col, text_col)
    homes = doc_parts(docs.sparkSession)
    both = dealt_texts(key_docs, homes, TEXT)
    for x in repeated_ranges(key_docs, length):
        both = both.unionByName(x)
    schema = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"

    @frugal
    def rewrite(batches):
        blobs, ranges = [], None
        for kind, blob in blob_rows(batches):
            if kind == DONE:
                blobs.append(blob)
                continue
            ranges = ranges or Ranges(blobs)
            ids, th, data, offsets = texts_of(blob)
            rows = []
            for i in range(len(ids)):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                lo, hi = ranges.of(ids[i], th[i])
                edges = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                rows.append((None if ids[i] == NULL_ID else int(ids[i]), kept, len(raw), len(raw) - len(kept), len(lo)))
            cols = list(zip(*rows))
            yield pa.record_batch(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return both.repartitionById(homes, "part").sortWithinPartitions("kind").mapInArrow(rewrite, schema)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
