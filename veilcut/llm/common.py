"""Helpers shared by the training-data operators: shared storage, blobs, byte-level text tables.

The operators that count every window of a corpus move numpy arrays, not rows: a map task
turns a chunk of documents into sorted arrays, cuts them by partition and sends one binary
row per (chunk, partition).  `blob_schema` rows are (part int, kind int, blob binary) and are
dealt with `repartitionById`, so one reducer holds one partition and nothing else.
"""

from __future__ import annotations

import ctypes
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import table_path

BLOB_SCHEMA = "part int, kind int, blob binary"
#: Words are runs of characters other than these six bytes.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = (9, 10, 11, 12, 13, 32)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
NULL_ID = np.iinfo(np.int64).min
CHUNK = 1 << 20
U = np.uint64


def written(df: DataFrame, name: str = "step", small: bool = False) -> DataFrame:
    """Write df as a zstd Parquet table in the shared folder and read it again: lineage ends here.

    small: a table of keys, for which a quarter of the shuffle's partitions write, so that files aren't tiny.
    """
    spark = df.sparkSession
    if small:
        df = df.coalesce(doc_parts(spark))
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_parts(spark: SparkSession) -> int:
    """Partitions that documents are dealt to: fewer than those of hashes, for fewer and larger output files."""
    return max(1, -(-shuffle_parts(spark) // 4))


def id_key(col: str | Column = "doc_id") -> Column:
    """A long that stands for a nullable id; null sorts before every id."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(NULL_ID)).cast("long")


# ---------------------------------------------------------------- memory


def frugal(run):
    """A mapInArrow function that gives memory back when its partition ends, so idle workers stay small."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


# ---------------------------------------------------------------- blobs


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one blob: hashes (names starting `h`) raw, others under zstd by byte planes."""
    out = []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        if name[0] == "h" or not len(a):
            out.append((name, a.dtype.str, len(a), 0, a.tobytes() if len(a) else b""))
        else:
            planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
            out.append((name, a.dtype.str, len(a), len(planes), pa.compress(planes, codec="zstd", asbytes=True)))
    return pickle.dumps(out, protocol=5)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    out = {}
    for name, dtype, n, size, data in pickle.loads(blob):
        if size:
            planes = np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd"), np.uint8)
            out[name] = np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, n).T).view(dtype).reshape(n)
        else:
            out[name] = np.frombuffer(data, dtype)
    return out


def gather(blobs: list[bytes], names: list[str]) -> dict[str, np.ndarray]:
    """The arrays of many blobs, joined; blobs are used up."""
    parts = []
    while blobs:
        parts.append(unpack(blobs.pop()))
    return {k: np.concatenate([p.pop(k) for p in parts]) if parts else np.zeros(0, np.int64) for k in names}


def blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        ["part", "kind", "blob"],
    )


def deal(part: np.ndarray, parts: int, kind: int, **arrays: np.ndarray):
    """Cut arrays by partition number, order kept; yields (part, kind, blob) of the partitions that have rows."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    arrays = {k: a[order] for k, a in arrays.items()}
    for p in np.flatnonzero(np.diff(edges)):
        lo, hi = edges[p], edges[p + 1]
        yield int(p), kind, pack(**{k: a[lo:hi] for k, a in arrays.items()})


def part_of_hash(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U(32)) * U(parts) >> U(32)).astype(np.int32)


def part_of_id(ids: np.ndarray, parts: int) -> np.ndarray:
    return part_of_hash(mix(ids.astype(np.int64).view(np.uint64)), parts)


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits with good avalanche (splitmix64's finaliser)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_pows: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, inverse: bool = False, base: int = _BASE) -> np.ndarray:
    """base**i (or its inverse) modulo 2**64 for i < n, kept between calls."""
    key = (base, inverse)
    have = _pows.get(key)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        b = pow(base, -1, 1 << 64) if inverse else base
        have = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]))
        if size <= 1 << 22:
            _pows[key] = have
    return have[:n]


# ---------------------------------------------------------------- text tables


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of an Arrow string array; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_chunks(batches, ids: str, text: str, extra: tuple[str, ...] = (), size: int = CHUNK):
    """Arrow batches cut at document borders into chunks of about `size` bytes: (ids, extras, data, offsets)."""
    for b in batches:
        if not b.num_rows:
            continue
        data, offsets = text_buffer(b.column(b.schema.get_field_index(text)))
        key = np.asarray(b.column(b.schema.get_field_index(ids)).fill_null(NULL_ID))
        more = [np.asarray(b.column(b.schema.get_field_index(x))) for x in extra]
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
            hi = min(hi, b.num_rows)
            yield key[lo:hi], [m[lo:hi] for m in more], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def _cut(data: np.ndarray, offsets: np.ndarray, lo: int, segment: int) -> int:
    """End of a segment from lo: the last word or document border within `segment` bytes, else the next one."""
    n, hi = len(data), lo + segment
    if hi >= n:
        return n
    space = np.flatnonzero(IS_SPACE[data[lo:hi]])
    border = int(offsets[int(np.searchsorted(offsets, hi, "right")) - 1])
    best = max(border, lo + int(space[-1]) + 1 if len(space) else 0)
    if best > lo:
        return best
    limit = int(offsets[int(np.searchsorted(offsets, hi, "right"))])  # the last offset is n
    while hi < limit:
        space = np.flatnonzero(IS_SPACE[data[hi : min(limit, hi + segment)]])
        if len(space):
            return hi + int(space[0]) + 1
        hi += segment
    return limit


def words_of(data: np.ndarray, offsets: np.ndarray, segment: int = CHUNK):
    """Words of the documents in data: (starts, ends, hashes, first word of each document with one entry more).

    A word never crosses a document border.  Long input is worked off in segments that end at
    white space or a border, so memory follows the segment, not the longest document.
    """
    n = len(data)
    starts, ends, hashes = [], [], []
    lo = 0
    while lo < n:
        hi = _cut(data, offsets, lo, segment)
        seg = data[lo:hi]
        solid = ~IS_SPACE[seg]
        begin, stop = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        stop[:-1] &= ~solid[1:]
        inner = offsets[(offsets > lo) & (offsets < hi)] - lo
        begin[inner] = solid[inner]
        stop[inner - 1] = solid[inner - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        total = np.zeros(len(seg) + 1, U)
        np.cumsum(_BYTE[seg] * powers(len(seg)), out=total[1:])
        hashes.append(mix((total[e] - total[s]) * powers(len(seg) + 1, True)[s] + (e - s).astype(U)))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(len(offsets), np.int64)
    starts, ends, hashes = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# ---------------------------------------------------------------- documents dealt by id


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, th int, text): th tells rows that repeat an id apart."""
    return docs.select(
        id_key(id_col).alias("id"),
        F.coalesce(F.xxhash64(text_col).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(0)).cast("int").alias("th"),
        F.col(text_col).alias("text"),
    )


def dealt_texts(key_docs: DataFrame, parts: int, kind: int = 1, size: int = 4 * CHUNK) -> DataFrame:
    """Texts packed under zstd, one row per (chunk, partition of the id)."""

    @frugal
    def run(batches):
        for ids, (th,), data, offsets in doc_chunks(batches, "id", "text", ("th",), size):
            part = part_of_id(ids, parts)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            rows = []
            for p in np.flatnonzero(np.diff(edges)):
                own = order[edges[p] : edges[p + 1]]
                raw = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in own])
                rows.append((int(p), kind, pack(doc=ids[own], th=th[own], size=np.diff(offsets)[own], z=raw)))
            yield blob_batch(rows)

    return key_docs.mapInArrow(run, BLOB_SCHEMA)


def texts_of(blob: bytes):
    """(ids, ths, data, offsets) of a blob of dealt_texts."""
    x = unpack(blob)
    return x["doc"], x["th"], x["z"], np.concatenate([[0], np.cumsum(x["size"])])


def blob_rows(batches):
    for b in batches:
        for kind, blob in zip(b.column(1).to_pylist(), b.column(2)):
            yield kind, blob.as_py()


class Ranges:
    """Ranges [lo, hi) of documents, looked up by (id, th)."""

    def __init__(self, blobs: list[bytes]):
        x = gather(blobs, ["doc", "th", "lo", "n"])
        order = np.lexsort((x["lo"], x["th"], x["doc"])) if len(x["doc"]) else np.zeros(0, np.int64)
        self.doc, self.th, self.lo = x["doc"][order], x["th"][order], x["lo"][order].astype(np.int64)
        self.hi = self.lo + x["n"][order]

    def of(self, doc: int, th: int) -> tuple[np.ndarray, np.ndarray]:
        """Merged ranges, in order: starts and ends."""
        a, b = np.searchsorted(self.doc, doc), np.searchsorted(self.doc, doc, "right")
        c = a + np.searchsorted(self.th[a:b], th)
        d = a + np.searchsorted(self.th[a:b], th, "right")
        lo, hi = self.lo[c:d], np.maximum.accumulate(self.hi[c:d]) if d > c else self.hi[c:d]
        new = np.ones(d - c, bool)
        new[1:] = lo[1:] > hi[:-1]
        last = np.append(np.flatnonzero(new)[1:] - 1, d - c - 1) if d > c else np.zeros(0, np.int64)
        return lo[new], hi[last]


# ---------------------------------------------------------------- whole rows dealt by id


def dealt_rows(df: DataFrame, id_col: str, text_col: str, parts: int, kind: int = 1, rows: int = 2000) -> DataFrame:
    """All columns of df as zstd Arrow blobs, dealt by id like dealt_texts; columns _id and _th come first."""
    held = df.select(
        id_key(F.col(id_col)).alias("_id"),
        F.coalesce(F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(0)).cast("int").alias("_th"),
        *(F.col(f"`{c}`") for c in df.columns),
    )

    @frugal
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                b = whole.slice(lo, rows)
                part = part_of_id(np.asarray(b.column(0)), parts)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                out = []
                for p in np.flatnonzero(np.diff(edges)):
                    own = b.take(pa.array(order[edges[p] : edges[p + 1]]))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(own)
                    out.append((int(p), kind, sink.getvalue().to_pybytes()))
                yield blob_batch(out)

    return held.mapInArrow(run, BLOB_SCHEMA)


def rows_of(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()
