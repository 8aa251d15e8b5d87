"""Substring dedup: Rabin-Karp hashes of every window of `width` tokens, counted in Spark.

1. A map task hashes every window of its chunk (a rolling polynomial over word hashes) and keeps,
   of equal windows in the chunk, the earliest: the others are removed already.  So a window
   that a third of the corpus holds sends one entry a chunk, whatever the number of its copies.
2. Entries (hash, document, start) go to the partition of their hash as packed arrays; there all
   but the earliest entry of each hash are removed windows.
3. Removed windows go back to the partition of their document, where they merge into maximal
   intervals and the texts are rewritten.

Equality is that of 64-bit fingerprints: two different windows among n agree with odds of n*n/2**65.

Defined cases: null text is an empty document; a null id is a document of its own that comes before
all others; rows that repeat an id are ordered by a hash of their text, and equal rows count as one
document and each come out; a document of fewer than `width` words keeps all words; other columns
of the input are ignored.
"""

from __future__ import annotations

from itertools import compress

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
    powers,
    runs,
    shuffle_parts,
    texts_of,
    unpack,
    words_of,
)

WIDTH = 20
_ROLL = 0x9E3779B97F4A7C15


def window_hashes(words: np.ndarray, first: np.ndarray, width: int):
    """Starts (indices of words), documents and Rabin-Karp hashes of all windows inside documents."""
    n = len(words)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(np.arange(n) + width <= first[doc + 1]) if n else np.zeros(0, np.int64)
    total = np.zeros(n + 1, U)
    np.cumsum(words * powers(n, base=_ROLL), out=total[1:])
    h = (total[start + width] - total[start]) * powers(n + 1, True, base=_ROLL)[start]
    return start, doc[start], mix(h)


def _merge_starts(doc, th, start, width):
    """Windows sorted by (doc, th, start) as ranges of words; runs of starts become one range."""
    if not len(start):
        return {"doc": doc, "th": th, "lo": start.astype(np.uint32), "n": start.astype(np.uint32)}
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1] + 1)
    lo = np.flatnonzero(new)
    last = np.append(lo[1:], len(start)) - 1
    return {"doc": doc[lo], "th": th[lo], "lo": start[lo].astype(np.uint32), "n": (start[last] - start[lo] + width).astype(np.uint32)}


def _count_chunk(ids, th, data, offsets, width: int, parts: int, homes: int):
    _, _, hashes, first = words_of(data, offsets)
    rank_order = np.lexsort((th, ids))
    rank = np.empty(len(ids), np.int64)
    rank[rank_order] = np.arange(len(ids))
    same = np.zeros(len(ids), bool)  # rows equal to one before, by (id, th)
    a, b = rank_order[:-1], rank_order[1:]
    same[b] = (ids[a] == ids[b]) & (th[a] == th[b])
    start, doc, h = window_hashes(hashes, first, width)
    keep = ~same[doc]
    start, doc, h = start[keep], doc[keep], h[keep]
    order = np.argsort(rank[doc], kind="stable")
    start, doc, h = start[order] - first[doc[order]], doc[order], h[order]
    if not len(h):
        return
    by = np.argsort(h)
    edge = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]]))
    earliest = np.zeros(len(h), bool)
    earliest[np.minimum.reduceat(by, edge)] = True
    again = ~earliest
    ranges = _merge_starts(ids[doc[again]], th[doc[again]], start[again], width)
    yield from deal(part_of_id(ranges["doc"], homes), homes, 0, **ranges)
    start, doc, h = start[earliest], doc[earliest], h[earliest]
    yield from deal(part_of_hash(h, parts), parts, 1, h=h, doc=ids[doc], th=th[doc], start=start.astype(np.uint32))


def _earlier_windows(blobs: list[bytes], width: int, homes: int):
    x = gather(blobs, ["h", "doc", "th", "start"])
    if not len(x["h"]):
        return
    by = np.argsort(x["h"])
    hs = x.pop("h")[by]
    equal = hs[1:] == hs[:-1]
    group = np.concatenate([[0], np.cumsum(~equal)])
    many = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
    by, group = by[many], group[many]
    del hs, equal, many
    doc, th, start = x["doc"][by], x["th"][by], x["start"][by]
    order = np.lexsort((start, th, doc, group))
    doc, th, start, group = doc[order], th[order], start[order], group[order]
    lead = np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]
    head = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))
    removed = (doc != doc[head]) | (th != th[head]) | (start != start[head])  # the head's own repeats are equal rows
    doc, th, start = doc[removed], th[removed], start[removed].astype(np.int64)
    order = np.lexsort((start, th, doc))
    ranges = _merge_starts(doc[order], th[order], start[order], width)
    yield from deal(part_of_id(ranges["doc"], homes), homes, 0, **ranges)


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Blobs of word ranges covered by windows that start earlier too, dealt by document."""
    parts, homes = shuffle_parts(docs.sparkSession), doc_parts(docs.sparkSession)

    @frugal
    def count(batches):
        for ids, (th,), data, offsets in doc_chunks(batches, "id", "text", ("th",), 4 * CHUNK):
            if rows := list(_count_chunk(ids, th, data, offsets, width, parts, homes)):
                yield blob_batch(rows)

    @frugal
    def judge(batches):
        blobs = []
        for kind, blob in blob_rows(batches):
            if kind:
                blobs.append(blob)
            else:
                yield blob_batch([(int(part_of_id(unpack(blob)["doc"][:1], homes)[0]), 0, blob)])
        if rows := list(_earlier_windows(blobs, width, homes)):
            yield blob_batch(rows)

    dealt = docs.mapInArrow(count, BLOB_SCHEMA).repartitionById(parts, "part")
    return dealt.mapInArrow(judge, BLOB_SCHEMA)


def dedup_substrings(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text (kept words joined by one space), n_words, n_removed, n_spans."""
    key_docs = keyed(docs, id_col, text_col)
    homes = doc_parts(docs.sparkSession)
    both = repeated_windows(key_docs, width).unionByName(dealt_texts(key_docs, homes))
    schema = "doc_id long, text string, n_words long, n_removed long, n_spans long"

    @frugal
    def rewrite(batches):
        blobs, ranges = [], None
        for kind, blob in blob_rows(batches):
            if kind == 0:
                blobs.append(blob)
                continue
            ranges = ranges or Ranges(blobs)
            ids, th, data, offsets = texts_of(blob)
            rows = []
            for i in range(len(ids)):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                lo, hi = ranges.of(ids[i], th[i])
                keep = words
                if len(lo):
                    mark = np.zeros(len(words) + 1, np.int32)
                    np.add.at(mark, lo, 1)
                    np.add.at(mark, hi, -1)
                    keep = list(compress(words, np.cumsum(mark[:-1]) == 0))
                rows.append((None if ids[i] == NULL_ID else int(ids[i]), b" ".join(keep), len(words), len(words) - len(keep), len(lo)))
            cols = list(zip(*rows))
            yield pa.record_batch(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                ["doc_id", "text", "n_words", "n_removed", "n_spans"],
            )

    return both.repartitionById(homes, "part").sortWithinPartitions("kind").mapInArrow(rewrite, schema)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS rn FROM starts) WHERE rn > 1
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM again
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d
), kept AS (
  SELECT w.doc_id, count(*) AS n_kept, string_agg(w.word, ' ' ORDER BY w.pos) AS kept
  FROM words w ANTI JOIN covered c ON w.doc_id = c.doc_id AND w.pos = c.pos GROUP BY w.doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
