"""Deterministic sharded WARC writer and reader.

Writer.  Records are in the order of page id and payload digest.  A table of ids, digests and sizes (no payloads) is sorted and
its sizes summed up in that order; every `shard_bytes` a shard ends.  So shards are alike in bytes however ids lie, an outlying id
or many null ids notwithstanding, and the cut depends on the data only, not on partitions or sampling.  The driver holds one
border a shard (16 bytes for `shard_bytes` of payload: 13 MB for 100 TB); pages find their shard by binary search.  Every shard is
one partition, sorted; its task writes gzip members (one a record, no time stamp) to files that
roll when `roll_bytes` compressed bytes are reached.  All headers and digests are made anew.  A file is written
under a temporary name of its attempt and renamed when complete, so a retried or speculative attempt leaves the
same bytes under the same name; the manifest (file, records, bytes, SHA-256) is a table written after all
shards, and a file counts only if a manifest names it.  The same input gives the same archives byte for byte.

Of records with equal payloads of at least `least` bytes the one with the largest page id is the response,
the others are revisits that refer to it.  Digests and ids alone are shuffled to find them; the decisions
meet the pages in the shard (union, one exchange), so pages cross the network once and a hot payload is
summed before the shuffle.

Files go through pyarrow's file systems (file:, hdfs:, s3:, ...), so `path` must be a folder that executors share.

Defined cases: null html is an empty payload; a null page id sorts first, has no id header and is never the
response of others with an id; rows that repeat the largest page id and its payload are all responses; a null url
has no target header; an empty table writes a manifest without files; other columns are ignored, whatever their names; a
payload of any length is one record, held once in a task.  Rows that share both id and payload are in one shard, so a shard
is at most `shard_bytes` and the rows of one such pair.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import table_path
from .common import NULL_ID, frugal, id_key, written

SHARD_BYTES = 128 << 20
ROLL_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
_SCHEMA = "file string, shard int, roll int, records long, bytes long, sha256 string, first_id long, last_id long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    name = f"{page_id}\n{url}\n{digest}\n{copy}".encode()
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(name).digest()[:16], version=5)}>"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int = 0) -> bytes:
    """A WARC/1.1 record: a response with the payload, or a revisit with the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, url, digest, copy)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roller:
    """Files of one shard: temporary name while open, final name when complete."""

    def __init__(self, base: str, shard: int, roll_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(base)
        self.shard, self.roll_bytes, self.roll, self.out = shard, roll_bytes, 0, None
        self.attempt = uuid.uuid4().hex
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)

    def add(self, page_id: int, member: bytes):
        if self.out is None:
            self.temp = f"{self.root}/_temporary/{self.shard:06d}-{self.roll:06d}-{self.attempt}"
            self.out, self.sha, self.records, self.size, self.first = self.fs.open_output_stream(self.temp), hashlib.sha256(), 0, 0, page_id
        self.out.write(member)
        self.sha.update(member)
        self.records, self.size, self.last = self.records + 1, self.size + len(member), page_id
        return self.close() if self.size >= self.roll_bytes else None

    def close(self):
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        name = f"part-{self.shard:06d}-{self.roll:06d}.warc.gz"
        self.fs.move(self.temp, f"{self.root}/{name}")
        row = (name, self.shard, self.roll, self.records, self.size, self.sha.hexdigest(), self.first, self.last)
        self.roll += 1
        return row


def _borders(keys: DataFrame, shard_bytes: int) -> list[tuple[int, int]]:
    """The first (id, tie) of every shard; keys has id, tie and size."""
    each = keys.groupBy("id", "tie").agg(F.sum("size").alias("size")).orderBy("id", "tie").withColumn("part", F.spark_partition_id())
    each = written(each, "op6-order")
    before, total = {}, 0
    for part, size in sorted(each.groupBy("part").agg(F.sum("size")).collect()):  # a row a partition
        before[part], total = total, total + size
    if not before:
        return []
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in before.items() for x in kv)), F.col("part").cast("long"))
    at = offset + F.sum("size").over(Window.partitionBy("part").orderBy("id", "tie")) - F.col("size")
    first = each.withColumn("shard", F.floor(at / shard_bytes)).groupBy("shard").agg(F.min(F.struct("id", "tie")).alias("x"))
    return sorted((r.id, r.tie) for r in first.select("x.id", "x.tie").collect())


def _shard_of(borders: list[tuple[int, int]]) -> Column:
    """The number of the shard of columns id and tie: borders at or before them, less one, by binary search."""
    held = lambda k: F.split(F.lit(",".join(str(x[k]) for x in borders)), ",").cast("array<bigint>")  # noqa: E731  (folded to one constant)
    ids, ties, steps = held(0), held(1), [1 << k for k in range(len(borders).bit_length() - 1, -1, -1)]

    def step(n: Column, more: Column) -> Column:
        i, t = F.get(ids, n + more - 1), F.get(ties, n + more - 1)
        return F.when((i < F.col("id")) | (i == F.col("id")) & (t <= F.col("tie")), n + more).otherwise(n)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step) - 1


def write_warc(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least: int = 0, level: int = LEVEL, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as WARC files under path (a URI) and commit a manifest; returns the manifest."""
    rows = pages.select(id_key(id_col).alias("id"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("tie", F.xxhash64("sha"))
    keys = written(rows.select("id", "tie", F.octet_length("payload").cast("long").alias("size"), F.col("sha").alias("digest")), "op6-digests", small=True)
    borders = _borders(keys, shard_bytes) or [(NULL_ID, NULL_ID)]
    twins = keys.where(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("refers"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = keys.join(twins, "digest").where(F.col("id") < F.col("refers")).select("id", "tie", "digest", "refers").distinct()
    none = F.lit(None)
    facts = again.select("id", "tie", none.cast("long").alias("page_id"), none.cast("string").alias("url"), "digest", "refers")
    full = rows.select("id", "tie", "page_id", "url", F.col("payload").alias("digest"), none.cast("long").alias("refers"))
    both = facts.withColumn("kind", F.lit(0)).unionByName(full.withColumn("kind", F.lit(1))).withColumn("shard", _shard_of(borders))
    dealt = both.repartitionById(len(borders), "shard").sortWithinPartitions("id", "tie", "kind", "url", "digest")

    @frugal
    def run(batches):
        out, now, refs, before, copy = None, None, {}, None, 0
        found = []
        for b in batches:
            for key, page_id, url, data, refers, kind, shard in zip(*(c.to_pylist() for c in b.columns)):
                if key != now:
                    now, refs = key, {}
                if kind == 0:
                    refs[data] = refers
                    continue
                sha = hashlib.sha1(data).digest()
                digest = base64.b32encode(sha).decode()
                copy = copy + 1 if (key, url, sha) == before else 0
                before = (key, url, sha)
                out = out or _Roller(path, shard, roll_bytes)
                found.append(out.add(key, gzip_member(record(page_id, url, data, digest, refs.get(sha), copy), level)))
        if out is not None:
            found.append(out.close())
        if found := [r for r in found if r is not None]:
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), kinds)], [x.split()[0] for x in _SCHEMA.split(", ")])

    columns = ("id", "page_id", "url", "digest", "refers", "kind", "shard")
    manifest = dealt.select(*columns).mapInArrow(run, _SCHEMA)
    manifest.write.mode("overwrite").parquet(f"{path}/_manifest")  # Spark commits it by rename, with _SUCCESS
    return pages.sparkSession.read.schema(_SCHEMA).parquet(f"{path}/_manifest")


def members(data: bytes, step: int = 1 << 14):
    """The gzip members of a file, one after the other; read in small steps, as what follows a member is copied with each."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            piece = view[at : at + step]
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(out)


def parse(member: bytes) -> dict:
    """Fields of a record; the payload of a response is checked against its digest."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Block-Digest"].removeprefix("sha1:") != base32_sha1(block) or kind == "response" and (base32_sha1(payload) != digest or len(payload) != size):
        raise ValueError(f"digest of {fields['WARC-Record-ID']} doesn't fit")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if kind == "response" else None,
    }


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the files that the manifest of path names, digests checked."""
    manifest = spark.read.schema(_SCHEMA).parquet(f"{path}/_manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(manifest.select("file", "sha256"), "file")
    schema = _READ if payload else pa.schema(list(_READ)[:-1])

    @frugal
    def run(batches):
        for b in batches:
            for content, sha in zip(b.column(0), b.column(1).to_pylist()):
                data = content.as_py()
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError("a file differs from the manifest")
                rows, held = [], 0
                for m in members(data):
                    r = parse(m)
                    held += len(m) if payload else 0
                    rows.append({k: r[k] for k in schema.names})
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    return files.select("content", "sha256").mapInArrow(run, kinds)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = table_path(spark, "op6")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path, payload=False).drop("url")


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || substr(hex, i, 1))::INTEGER), 4, '0')), '') AS bits FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda k: substr(bits, (5 * i + k + 1)::INTEGER, 1)::INTEGER * (16 >> k::INTEGER)))::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM b)
"""
