"""WARC archives: a deterministic sharded writer and a reader.

Records are sorted by (page_id, url, payload digest), null ids last, and dealt to shards at fixed places of that order.
The places come from a hash sample of bounded size, weighed by bytes so that shards are about equally large, whatever
the pages' sizes and however many rows share an id; the same rows always give the same shards however Spark deals its
tasks. Each task writes its shard in order, a gzip member for each record, and rolls to the next file when the
compressed size passes ``roll_bytes``. Files get their final names by renaming once complete, and hold the same bytes on
every attempt (record ids derive from content and place, dates are a parameter), so a lost executor's shard is simply
written again. A manifest, written last and under a temporary name first, names the files that count; what failed
attempts left is removed.

Of records with equal payloads of at least ``min_dedup`` bytes the first is a response and the others are revisits
that refer to it; smaller payloads are all responses. The payload is the html in UTF-8 (null: empty); a response
block is an HTTP response with regenerated headers, digests are SHA-256.

Null url counts as empty. Rows that repeat a page_id get records each; among repeated rows with one payload the first
in order is the response. Rows equal in id, url and payload lie in one shard, which streams them. Empty tables give a
manifest without files. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.runtime import Scratch, checked_broadcast

MIN_DEDUP = 100
ROLL_BYTES = 64 << 20
#: Payload bytes aimed at in a shard, and most shards: beyond, shards are larger and roll to more files.
SHARD_BYTES = 12 << 20
MAX_SHARDS = 5_000
#: Rows sampled to place shard borders, about: bounds what comes to the driver.
SAMPLE = 50_000
DATE = "2024-01-01T00:00:00Z"
_FILES = "shard int, seq int, name string, bytes bigint, records bigint, sha256 string"
_NAME = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, url: str, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAME, f'{page_id}/{digest}/{nth}/{url}')}>"


def _record(kind: str, page_id: int | None, nth: int, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url, digest, nth)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url), f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest, 1)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(root: str, roll_bytes: int):
    def run(batches):
        fs, base = _fs(root)
        made: list[tuple] = []
        out = temp = None
        shard = seq = size = n = 0
        digest, last, nth = None, None, 0

        def close():
            nonlocal out
            if out is None:
                return
            out.close()
            name = f"shard-{shard:06d}-{seq:04d}.warc.gz"
            # a former attempt may have left the same file; not every file system renames onto one
            if fs.get_file_info(f"{base}/{name}").is_file:
                fs.delete_file(f"{base}/{name}")
            fs.move(temp, f"{base}/{name}")
            made.append((shard, seq, name, size, n, digest.hexdigest()))
            out = None

        for batch in batches:
            for r in batch.to_pylist():
                if out is not None and (r["shard"] != shard or size >= roll_bytes):
                    close()
                    seq = seq + 1 if r["shard"] == shard else 0
                elif out is None and r["shard"] != shard:
                    seq = 0
                if out is None:
                    shard = r["shard"]
                    temp = f"{base}/.{shard:06d}-{seq:04d}-{uuid.uuid4().hex}.tmp"
                    out, size, n, digest = fs.open_output_stream(temp), 0, 0, hashlib.sha256()
                payload, own = (r["html"] or "").encode(), (r["page_id"], r["url"], r["digest"])
                nth = nth + 1 if own == last else 1
                last = own
                # one response for each payload: its first record in order
                revisit = r["dedup"] and not (nth == 1 and (r["first_id"], r["first_url"]) == own[:2])
                kind = "revisit" if revisit else "response"
                member = gzip.compress(_record(kind, r["page_id"], nth, r["url"], payload, r["digest"], r["first_id"] if revisit else None, r["first_url"] or ""), 6, mtime=0)
                out.write(member)
                digest.update(member)
                size += len(member)
                n += 1
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["shard", "seq", "name", "bytes", "records", "sha256"])

    return run


def write(pages: DataFrame, root: str, roll_bytes: int = ROLL_BYTES, min_dedup: int = MIN_DEDUP, shard_bytes: int = SHARD_BYTES) -> str:
    """Write page_id, url, html rows as archives under root; returns the path of the manifest (a Parquet table)."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = p.withColumn("url", F.coalesce("url", F.lit(""))).withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256)).withColumn("size", F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint"))
    facts = scratch.keep(keyed.select("page_id", "url", "digest", "size"), "facts")
    # payloads that more than one row holds: their first record; min() combines before the shuffle
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    shared = facts.where(F.col("size") >= min_dedup).groupBy("digest").agg(first.alias("first"), F.count("*").alias("rows")).where("rows > 1")
    shared = scratch.keep(shared.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.lit(True).alias("shared")), "shared")
    total = facts.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    shards = max(1, min(MAX_SHARDS, -(-(total["bytes"] or 0) // shard_bytes)))
    part = max(1, -(-total["n"] // SAMPLE))
    # borders lie at equal shares of the sampled bytes; ids, digests and the first 200 characters of urls come to the driver
    place = lambda i, url, digest: (i is None, i or 0, url[:200], digest)
    sample = facts.where(F.pmod(F.xxhash64("page_id", "url", "digest"), F.lit(part)) == 0).groupBy("page_id", F.substring("url", 1, 200).alias("url"), "digest").agg(F.sum("size").alias("size")).limit(4 * SAMPLE).collect()
    sample = sorted((place(r["page_id"], r["url"], r["digest"]), r["size"] + 512) for r in sample)
    upto, borders = list(accumulate(x[1] for x in sample)), []
    for k in range(1, shards if sample else 1):
        border = sample[bisect_right(upto, upto[-1] * k // shards)][0]
        if not borders or border > borders[-1]:
            borders.append(border)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series, urls: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(borders, (i is None, i or 0, u[:200], d)) for i, u, d in zip((None if pd.isna(i) else int(i) for i in ids), urls, digests, strict=True)], dtype="int32")

    rows = keyed.join(checked_broadcast(shared), "digest", "left").withColumn("dedup", F.col("shared").isNotNull())
    # ids above 2**53 must not pass through floats, which is what a null among them makes of a series
    rows = rows.withColumn("shard", shard_of(F.col("page_id").cast("string"), "url", "digest")).repartitionById(len(borders) + 1, F.col("shard"))
    rows = rows.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), F.substring("url", 1, 200), "digest", "url")
    files = rows.select("shard", "page_id", "url", "html", "digest", "dedup", "first_id", "first_url").mapInArrow(_writer(root, roll_bytes), _FILES)
    fs, base = _fs(root)
    fs.create_dir(base, recursive=True)
    files.write.mode("overwrite").parquet(f"{root}/.manifest.tmp")
    conf = spark._jsc.hadoopConfiguration()
    path = spark._jvm.org.apache.hadoop.fs.Path
    hfs = path(root).getFileSystem(conf)
    hfs.delete(path(f"{root}/manifest.parquet"), True)
    hfs.rename(path(f"{root}/.manifest.tmp"), path(f"{root}/manifest.parquet"))
    for left in hfs.globStatus(path(f"{root}/.*.tmp")):
        hfs.delete(left.getPath(), False)
    scratch.keep_only()
    return f"{root}/manifest.parquet"


def _members(data):
    """The gzip members of a stream, decompressed one by one."""
    rest = b""
    d = zlib.decompressobj(31)
    got: list[bytes] = []
    while True:
        chunk = rest or data.read(1 << 20)
        rest = b""
        if not chunk:
            return
        got.append(d.decompress(chunk))
        if d.eof:
            yield b"".join(got)
            got, rest, d = [], d.unused_data, zlib.decompressobj(31)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; the declared lengths and digests are verified."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if hashlib.sha256(block).hexdigest() != h["WARC-Block-Digest"].partition(":")[2]:
        raise ValueError(f"block digest differs: {h['WARC-Record-ID']}")
    return h, block


def _reader(root: str):
    def run(batches):
        fs, base = _fs(root)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as data:
                    for member in _members(data):
                        h, block = parse_record(member)
                        digest, size = h["WARC-Payload-Digest"].partition(":")[2], int(h["X-Payload-Length"])
                        text = None
                        if h["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                                raise ValueError(f"payload differs: {h['WARC-Record-ID']}")
                            text = payload.decode()
                        num = lambda k: int(h[k]) if h.get(k) else None
                        rows.append((num("X-Page-ID"), h["WARC-Target-URI"], text, size, digest, h["WARC-Type"], num("X-Refers-To-Page-ID")))
                        if len(rows) >= 200:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return run


_READ = "page_id bigint, url string, html string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read(spark: SparkSession, root: str) -> DataFrame:
    """The records of a committed archive; html is null for revisits. Lengths and digests are verified on the way."""
    files = spark.read.schema(_FILES).parquet(f"{root}/manifest.parquet").select("name")
    n = max(1, files.count())
    return files.repartition(min(n, 10_000), "name").mapInArrow(_reader(root), _READ)

