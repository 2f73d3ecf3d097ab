"""WARC: a deterministic sharded writer, and a reader.

Payloads are digested first (SHA-1, natively). Of equal payloads of at least `least` bytes the row with the largest
page id is a response; the others become revisits that name it. Rows are then cut into shards by ranges of page id:
blocks of 1024 ids are summed and shards are cut on the running sum, so the cut depends on the data alone (rows without
an id are dealt to 4096 blocks by hash). A task sorts its shard by id and writes gzip members, one a record, rolling to the next file once a file has `roll`
compressed bytes; headers, lengths and digests are made anew from the payload. Dates come from `date`, ids from page
ids, so the same rows give the same bytes.

Files go to `<out>/_temporary/<attempt>/` with an attempt's own name. What each attempt has written comes back as
rows; those that were used are renamed to their final names and listed in `<out>/manifest.json`, which is written
last. A lost executor or a task that runs twice leaves only temporary files, which are deleted at the end.

Nulls: a null html is empty, a null url an empty target; a null page id has no number of its own (id `null`), can't
be named by a revisit while another row can, and comes first. Rows repeated with the largest id are all responses.
An empty table writes an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import kept, scratch, pieces

SHARD_BYTES, ROLL, DATE = 32 << 20, 4 << 20, "2024-01-01T00:00:00Z"
BLOCK = 1024


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One uncompressed record; a revisit has the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else str(page_id)
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(raw: bytes) -> Iterator[bytes]:
    while raw:
        z = zlib.decompressobj(31)
        yield z.decompress(raw) + z.flush()
        raw = z.unused_data


def parse(data: bytes) -> dict:
    """A record's named fields and block; digests are computed from the block, not believed."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{digest_of(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"{fields['WARC-Record-ID']}: the block's digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest_of(payload) != stated):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload's digest differs")
    return {"fields": fields, "payload": payload, "size": size, "digest": stated}


def revisits(rows: DataFrame, least: int = 0) -> DataFrame:
    """(block, page_id, sha, refers_to) of those of rows (block, page_id, html) that are revisits. Payloads are digested where they lie; only ids
    and digests are shuffled, and equal payloads are summed before."""
    own = kept(rows.where(F.octet_length("html") >= least).select("block", "page_id", F.sha1("html").alias("sha")), "warc-digests")
    last = own.groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1 AND last IS NOT NULL")
    last = kept(last.select("sha", "last"), "warc-last")  # written first, so that the join with a hot digest can be split
    return own.join(last, "sha").where(~F.col("page_id").eqNullSafe(F.col("last"))).select("block", "page_id", "sha", F.col("last").alias("refers_to")).distinct()


def _block(page_id: Column, url: Column, html: Column) -> Column:
    """Of 1024 ids; rows without an id are dealt by hash, before all others."""
    return F.coalesce(F.floor(page_id / BLOCK), F.pmod(F.xxhash64(url, html), F.lit(4096)) - (1 << 60)).cast("long")


def write_warc(pages: DataFrame, out: str, least: int = 0, shard_bytes: int = SHARD_BYTES, roll: int = ROLL, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes all pages under out, a folder that driver and executors share; returns the manifest (file, shard, records, bytes, sha256).

    Payloads move once, to their shard's task. What a revisit names comes there as a row of its own, sorted before the page.
    The defaults suit tables of some GB; a corpus of many TB wants shards of a GB and files of 100 MB.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("block", _block(F.col("page_id"), F.col("url"), F.col("html")))
    sizes = rows.groupBy("block").agg(F.sum(F.octet_length("html") + 512).alias("n"))
    # one row for 1024 ids: groups of 4096 such blocks are summed first, so that no window holds them all; one row for 4 million ids is left
    sizes = sizes.withColumn("far", F.floor(F.col("block") / 4096).cast("long"))
    far = sizes.groupBy("far").agg(F.sum("n").alias("n")).select("far", F.coalesce(F.sum("n").over(W.orderBy("far").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("far").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = kept(sizes.withColumn("_b", before).join(far, "far").select("block", F.floor((F.col("base") + F.col("_b")) / shard_bytes).cast("long").alias("shard")), "warc-shards")
    n = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    payload = rows.select("block", "page_id", F.sha1("html").alias("sha"), F.lit(1).alias("page"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    told = revisits(rows, least).select("block", "page_id", "sha", F.lit(0).alias("page"), F.lit("").alias("url"), F.lit("").alias("html"), "refers_to")
    placed = payload.unionByName(told).join(shards, "block").select("shard", "page_id", "sha", "page", "url", "html", "refers_to")
    placed = placed.repartition(min(int(n), 100_000), "shard").sortWithinPartitions("shard", "page_id", "sha", "page", "url")
    base = out.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pafs.FileSystem.from_uri(base)
        attempt = f"_temporary/{uuid.uuid4().hex}"
        open_file, done = None, []

        def close():
            nonlocal open_file
            if open_file:
                f, row, sha = open_file
                f.close()
                done.append((*row, sha.hexdigest()))
                open_file = None

        shard, seq, told, at = None, 0, None, None
        for batch in pieces(batches):
            for s, i, sha, page, u, h, ref in zip(*(c.to_pylist() for c in batch.columns)):
                if not page:
                    told, at = ref, (s, i, sha)
                    continue
                ref = told if at == (s, i, sha) else None
                if open_file and (s != shard or open_file[1][5] >= roll):
                    close()
                if s != shard:
                    shard, seq = s, 0
                if not open_file:
                    files.create_dir(f"{path}/{attempt}", recursive=True)
                    temp = f"{attempt}/{s:06d}-{seq:04d}.warc.gz"
                    open_file = [files.open_output_stream(f"{path}/{temp}", compression=None), [temp, f"part-{s:06d}-{seq:04d}.warc.gz", s, seq, 0, 0], hashlib.sha256()]
                    seq += 1
                data = member(record(i, u, h.encode(), ref))
                open_file[0].write(data)
                open_file[2].update(data)
                open_file[1][4] += 1
                open_file[1][5] += len(data)
        close()
        if done:
            names = ["temp", "file", "shard", "seq", "records", "bytes", "sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names)

    used = kept(placed.mapInArrow(write, "temp string, file string, shard long, seq long, records long, bytes long, sha256 string"), "warc-written")
    _commit(spark, base, used)
    return used.drop("temp")


def _commit(spark: SparkSession, base: str, used: DataFrame) -> None:
    """Renames what the attempts that count have written, and lists it in a manifest that is itself renamed."""
    jvm = spark.sparkContext._jvm
    path = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join([base, *p]))
    files = path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path())
    listed = []
    for r in used.orderBy("file").toLocalIterator():
        if not files.rename(path(r["temp"]), path(r["file"])):
            raise OSError(f"{r['temp']} can't be renamed to {r['file']}")
        listed.append({k: r[k] for k in ("file", "shard", "records", "bytes", "sha256")})
    stream = files.create(path("_manifest.json"), True)
    stream.write(bytearray(json.dumps({"files": listed}, indent=1).encode()))
    stream.close()
    files.rename(path("_manifest.json"), path("manifest.json"))
    files.delete(path("_temporary"), True)


def _number(record_id: str | None) -> int | None:
    """The page id in a record's id; null for ids of other forms."""
    m = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(m.group(1)) if m else None


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """Records of the files in a folder: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (empty for revisits)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(out).select("content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for raw in batch.column(0).to_pylist():
                rows, size = [], 0
                for data in members(raw):
                    r = parse(data)
                    f = r["fields"]
                    rows.append((_number(f["WARC-Record-ID"]), f["WARC-Target-URI"], f["WARC-Type"], _number(f.get("WARC-Refers-To")), r["size"], r["digest"], r["payload"]))
                    size += len(data)
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

    return found.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_GROUPS = " || ".join(
    f"""(SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::int + 1, 1), '' ORDER BY s DESC) FROM (SELECT ('0x' || substr(sha, {5 * i + 1}, 5))::bigint v), (VALUES (15), (10), (5), (0)) t(s))""" for i in range(8)
)
ORACLE = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') h, sha1(coalesce(html, '')) sha FROM pages),
    l AS (SELECT sha, max(page_id) last FROM p GROUP BY sha)
    SELECT page_id, strlen(h)::bigint payload_bytes, {_GROUPS} AS payload_digest,
        CASE WHEN page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
    FROM p JOIN l USING (sha)"""
