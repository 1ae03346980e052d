"""Deterministic sharded WARC writer, and its reader.

Records are ordered by key and cut into shards by a histogram of payload bytes
over key ranges (ranges that hold too much are counted again, finer), so that
shards do not depend on how Spark deals rows out. Every shard is a partition of
its own, sorted, and written as gzip members, one a record; a new file begins
whenever a file has reached its compressed size. Headers, lengths and SHA-1
digests are made anew from the payload. A file is written under a temporary
name with the attempt in it and renamed by its task when it is whole; the
manifest, written last by the driver and moved into place, names the files that
count. Contents depend on the records alone, so an attempt that is repeated
after a lost executor gives the same files, and what a failed run left is named
by no manifest.

Among equal payloads of at least `least` bytes the one with the smallest key
(then address) is a response record and others are revisit records that refer to
it; these carry its digest and length but no payload. If the payloads that
occur again are too many to broadcast, decisions travel to the shards as rows
of their own, so that payloads are shuffled once either way.

Defined cases: a null payload is empty; rows with equal keys follow each other
by address and payload digest (among equal payloads all but one of them are
revisits of that key); a null key is written under the key "null", after all
others; a null address is written as urn:none, and control characters in an
address as percent escapes, in which form they are read back; an empty table
gives a manifest without files; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, bound_batches, materialize, small

#: Compressed bytes after which a file is closed, and key ranges counted at once.
ROLL_BYTES, RANGES = 256 << 20, 4096
#: Payload bytes of a shard: this part of all, within these bounds.
SHARD_PART, SHARD_LEAST, SHARD_MOST = 256, 8 << 20, 1 << 30
DATE = "2000-01-01T00:00:00Z"  # given, so that reruns agree


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path in it; s3a and s3n are Hadoop's names of s3."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def digest_b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def member(heads: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.1 record as a gzip member without time stamp."""
    head = "".join(f"{k}: {one_line(v)}\r\n" for k, v in (heads | {"Content-Length": str(len(block))}).items())
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as z:
        z.write(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n")
    return out.getvalue()


def urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts))}>"


def info(name: str) -> bytes:
    """The record that begins a file."""
    heads = {"WARC-Type": "warcinfo", "WARC-Record-ID": urn("info", name), "WARC-Date": DATE, "WARC-Filename": name, "Content-Type": "application/warc-fields"}
    return member(heads, b"format: WARC File Format 1.1\r\nsoftware: tributary\r\n")


def record(ident: str, key: str, url: str, payload: bytes, digest: str, size: int, refers: str | None) -> bytes:
    """A response record, or a revisit record if it refers to a key."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if refers is None else b"")
    heads = {
        "WARC-Type": "response" if refers is None else "revisit",
        "WARC-Record-ID": ident,
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "WARC-Source-Key": key,
        "WARC-Payload-Length": str(size),
        "Content-Type": "application/http;msgtype=response",
    }
    if refers is not None:
        heads |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": urn("payload", digest), "WARC-Refers-To-Date": DATE, "WARC-Refers-To-Source-Key": refers}
    return member(heads, block)


def one_line(value: str) -> str:
    """Header values are one line: control characters become percent escapes, all else stays as it is."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def shards(keys: DataFrame, shard_bytes: int | None = None) -> list[tuple[int, int]]:
    """Key ranges [from, to] whose payloads have about shard_bytes: a histogram over ranges of keys, in which ranges
    with more are counted again until they are small or hold a single key. keys has (key, size)."""
    lo, hi, total = keys.agg(F.min("key"), F.max("key"), F.sum("size")).first()
    if lo is None:
        return []
    shard_bytes = shard_bytes or min(SHARD_MOST, max(SHARD_LEAST, total // SHARD_PART))
    todo, found = [(lo, hi)], []
    while todo:
        a, b = todo.pop(0)
        width = max(1, -(-(b - a + 1) // RANGES))
        rows = keys.filter(F.col("key").between(a, b)).groupBy(F.floor((F.col("key") - a) / width).alias("r")).agg(F.sum("size").alias("bytes")).orderBy("r").collect()  # at most RANGES rows
        begin, total = a, 0
        for r, size in ((int(x["r"]), x["bytes"]) for x in rows):
            if total and total + size > shard_bytes:
                found.append((begin, a + r * width - 1))
                begin, total = a + r * width, 0
            total += size
            if size > 2 * shard_bytes and width > 1:
                if a + r * width > begin:
                    found.append((begin, a + r * width - 1))
                todo.append((a + r * width, min(b, a + (r + 1) * width - 1)))
                begin, total = a + (r + 1) * width, 0
        if begin <= b:
            found.append((begin, b))
    return sorted(found)


ROW = "shard int, key long, url string, digest string, tag int, payload binary, size long, first_key long, first_url string"
WRITTEN = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha1", pa.string())])


class Writer:
    """Records of one task to files, in the order given."""

    def __init__(self, base: str, attempt: str, roll: int):
        self.store, self.root = open_fs(base)
        self.temp = f"_temporary-{attempt}/{uuid.uuid4().hex}"
        self.store.create_dir(f"{self.root}/_temporary-{attempt}", recursive=True)
        self.roll, self.out, self.shard, self.seq, self.done = roll, None, None, 0, []

    def put(self, shard: int, ident: object, **what) -> None:
        if self.out is None or shard != self.shard or self.size >= self.roll:
            self.close()
            self.seq = self.seq + 1 if shard == self.shard else 0
            self.shard, self.size, self.n, self.sha = shard, 0, 0, hashlib.sha1()
            self.name = f"part-{shard:06d}-{self.seq:05d}.warc.gz"
            self.out = self.store.open_output_stream(f"{self.root}/{self.temp}-{self.name}", compression=None)
            self.write(info(self.name))
        self.write(record(urn("payload", what["digest"]) if ident is None else urn(self.name, self.n, ident), **what))
        self.n += 1

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(f"{self.root}/{self.temp}-{self.name}", f"{self.root}/{self.name}")
            self.done.append({"file": self.name, "bytes": self.size, "records": self.n, "sha1": self.sha.hexdigest()})
            self.out = None


def _write(base: str, attempt: str, roll: int, least: int):
    """Rows of ROW sorted by (shard, key, url, digest, tag) to files; yields what was written. Rows of tag 0 tell which
    record of a payload is its response, for the rows of tag 1 after them; those of tag 2 tell it themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Writer(base, attempt, roll)
        told, told_first, last = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                same = (r["shard"], r["key"], r["url"], r["digest"])
                first = (r["first_key"], r["first_url"]) if r["first_key"] is not None else None
                if r["tag"] == 0:
                    told, told_first = same, first
                    continue
                if r["tag"] == 1:
                    first = told_first if told == same else None
                key, big = "null" if r["key"] is None else str(r["key"]), r["size"] >= least
                response = first is None or (first == (r["key"], r["url"]) and same != last)
                last = same
                ident = None if response and big and r["key"] is not None else key  # one response a digest
                to.put(r["shard"], ident, key=key, url=r["url"], payload=r["payload"] or b"", digest=digest_b32(r["digest"]), size=r["size"], refers=None if response else str(first[0]))
        to.close()
        yield pa.RecordBatch.from_pylist(to.done, schema=WRITTEN)

    return run


def write(pages: DataFrame, base: str, least: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int | None = None) -> list[dict]:
    """Write pages (key long, url string, payload binary) as an archive at the URI base; returns the manifest's rows.

    The driver holds a row for each key range and each file, not for records."""
    spark = pages.sparkSession
    bound_batches(spark)
    rows = pages.select("key", F.coalesce("url", F.lit("urn:none")).alias("url"), F.coalesce(F.col("payload"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    keys = materialize(rows.select("key", "url", "digest", "size"), "warc-keys")
    cuts = shards(keys, shard_bytes)
    shard = shard_of([a for a, _ in cuts])
    rows = rows.withColumn("shard", shard(F.col("key")))
    one = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "url")))
    firsts = keys.filter(F.col("size") >= least).groupBy("digest").agg(one.alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1 and f is not null")
    firsts = materialize(firsts.select("digest", F.col("f.key").alias("first_key"), F.col("f.url").alias("first_url")), "warc-firsts")
    none = F.lit(None)
    if small(firsts):
        own = F.col("first_key").isNull() | (F.col("first_key").eqNullSafe(F.col("key")) & (F.col("first_url") == F.col("url")))
        dealt = attach(rows, firsts, ["digest"], "left").withColumns({"payload": F.when(own, F.col("payload")), "tag": F.lit(2)})
    else:
        told = attach(keys.select("key", "url", "digest").distinct(), firsts, ["digest"], "inner")
        told = told.withColumns({"shard": shard(F.col("key")), "tag": F.lit(0), "payload": none.cast("binary"), "size": F.lit(0).cast("long")})
        dealt = rows.withColumns({"tag": F.lit(1), "first_key": none.cast("long"), "first_url": none.cast("string")}).unionByName(told)
    names = [x.split()[0] for x in ROW.split(", ")]
    ordered = dealt.select(names).repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_last("key"), "url", "digest", "tag")
    attempt = uuid.uuid4().hex
    written = [r.asDict() for r in ordered.mapInArrow(_write(base, attempt, roll_bytes, least), "file string, bytes long, records long, sha1 string").collect()]  # a row a file
    written.sort(key=lambda w: w["file"])
    commit(base, attempt, written)
    return written


def shard_of(starts: list[int]):
    """A column function: key to the number of its range, null keys after all others. Eight bytes a shard are sent."""
    at = np.array(starts, np.int64)

    @F.arrow_udf("int")
    def find(keys: pa.Array) -> pa.Array:
        given = keys.fill_null(0).to_numpy(zero_copy_only=False)
        found = np.maximum(np.searchsorted(at, given, side="right") - 1, 0)
        return pa.array(np.where(keys.is_null().to_numpy(zero_copy_only=False), len(at), found).astype(np.int32))

    return find


def commit(base: str, attempt: str, written: list[dict]) -> None:
    """Put the manifest in place; temporary files of failed attempts go."""
    store, root = open_fs(base)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/_manifest-{attempt}", compression=None) as out:
        out.write(json.dumps({"files": written}, indent=1).encode())
    store.move(f"{root}/_manifest-{attempt}", f"{root}/MANIFEST.json")
    if store.get_file_info(f"{root}/_temporary-{attempt}").type == pafs.FileType.Directory:
        store.delete_dir(f"{root}/_temporary-{attempt}")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip stream."""
    with gzip.GzipFile(fileobj=stream, mode="rb") as z:
        while True:
            line = z.readline()
            if not line:
                return
            if line in (b"\r\n", b"\n"):
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            heads = {}
            while (line := z.readline()) not in (b"\r\n", b"\n", b""):
                k, _, v = line.decode().rstrip("\r\n").partition(": ")
                heads[k] = v
            yield heads, z.read(int(heads["Content-Length"]))


def _read(base: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(base)
        for batch in batches:
            for name, expected in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, held, n = [], 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for heads, block in parse(stream):
                        if heads["WARC-Type"] == "warcinfo":
                            continue
                        _, _, payload = block.partition(b"\r\n\r\n")
                        digest = heads["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = heads["WARC-Type"]
                        whole = kind == "response"
                        if whole and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{name}: a payload does not have its digest")
                        size = len(payload) if whole else int(heads["WARC-Payload-Length"])
                        key, refers = heads["WARC-Source-Key"], heads.get("WARC-Refers-To-Source-Key")
                        rows.append({"key": None if key == "null" else int(key), "url": heads["WARC-Target-URI"], "payload": payload if whole and payloads else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": None if refers is None else int(refers)})
                        n, held = n + 1, held + len(payload)
                        if held > 4 << 20 or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=READ)
                            rows, held = [], 0
                if n != expected:
                    raise ValueError(f"{name}: {n} records, the manifest has {expected}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=READ)

    return run


READ = pa.schema([("key", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(spark: SparkSession, base: str, payloads: bool = True) -> DataFrame:
    """The records of an archive: key, url, payload (null for revisits and if not wanted), payload_bytes, payload_digest, record_type,
    refers_to. Files stream through their tasks; digests and numbers of records are checked."""
    store, root = open_fs(base)
    with store.open_input_stream(f"{root}/MANIFEST.json", compression=None) as f:
        files = json.loads(f.read())["files"]
    rows = [(f["file"], f["records"]) for f in files]
    listed = spark.createDataFrame(rows, "file string, records long").repartition(max(1, len(rows))) if rows else spark.createDataFrame([], "file string, records long")
    return listed.mapInArrow(_read(base, payloads), "key long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
