"""Deterministic sharded WARC writer, and a reader of what it wrote.

Records are sorted by (page_id, payload digest, url) over all shards. The shards' boundaries are quantiles of the keys
with the smallest hashes, a bounded sample that the same rows always give, so that two runs write the same bytes.
Each shard is one task, which writes one gzip member per record and rolls to a new file when the compressed size
passes `roll_bytes`. Headers, record ids and digests are made anew from the payload.

Commit: tasks write under temporary names that hold their attempt, and report what they wrote. The reports of the
attempts that Spark took, and no others, are written as a manifest; then each file in it is renamed to its final
name. Renaming again does no harm, so a lost executor costs a repeated task only. Readers follow the manifest.

The folder must be one that all executors see; any file system that pyarrow opens by address will do.

Payloads that are equal are stored once: the record with the largest page_id is the response, others are revisit
records that refer to it. Smaller payloads than `revisit_min_bytes` are all stored.

Defined results: null html is the empty payload, and equal to it. A null url leaves out the target header; blanks and
control characters in a url are percent-encoded. Null ids come first and lose against any id; rows that repeat the
largest id and payload are all responses. An empty table gives an empty archive. Other columns are ignored. Ids may be integers or
strings of printable characters without blanks at their ends; other types are refused. What is read back has the type that was written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import join_groups, scratch, text_of

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122 namespace for URLs
MANIFEST = "shard int, seq int, temporary string, name string, records bigint, bytes bigint"
CHUNK = 1 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(IDS, f'{page}/{digest}')}>"


def safe_url(url: str) -> str:
    return "".join(c if " " < c and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page: object, url: str | None, payload: bytes, refers_to: object, digest: str, full_bytes: int) -> bytes:
    """One WARC/1.1 record; refers_to: the response's page id, for a revisit."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {safe_url(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    head += [f"X-Page-ID: {page}"] if page is not None else []
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"] if revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """The same bytes for the same data: no name or time in the header."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _keys(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).alias("page_id"), F.octet_length(text_of(html_col)).cast("bigint").alias("n"), F.sha1(text_of(html_col)).alias("hex"))


def _revisits(keys: DataFrame, revisit_min_bytes: int) -> DataFrame:
    """(page_id, n, hex, refers_to) of the rows whose payload another page stores. No payload is moved for it."""
    large = keys.filter(F.col("n") >= revisit_min_bytes)
    best = large.groupBy("hex", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1")
    return join_groups(large, best, ["hex", "n"], "copies").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "n", "hex", "refers_to").distinct()


def _boundaries(rows: DataFrame, shards: int, each: int = 8, least: int = 4096) -> list[tuple]:
    """Quantiles of the keys (page_id, hex) of a sample of rows, those with the smallest hashes: `each` for a shard, `least` at least."""
    keys = rows.select("page_id", "hex").distinct().orderBy(F.xxhash64("page_id", "hex"), "page_id", "hex").limit(max(least, each * shards))
    got = sorted(_order(r.page_id, r.hex) for r in keys.collect())
    return sorted({got[k * len(got) // shards] for k in range(1, shards)}) if got else []


def _order(page: object, digest: str) -> tuple:
    """Spark's order of (page_id, hex): nulls first, strings by their bytes."""
    return (page is not None, page.encode() if isinstance(page, str) else page or 0, digest)


def write(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = 16 << 20, roll_bytes: int = 256 << 20, revisit_min_bytes: int = 0, most_shard_bytes: int = 1 << 30) -> DataFrame:
    """Writes the archive and returns its manifest as a table: shard, seq, name, records, bytes, path.

    Shards hold `shard_bytes` of payload up to 4,096 shards, then grow to `most_shard_bytes`, then their number grows.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    if kind not in READ_TYPES:
        raise TypeError(f"page ids are of type {kind}, not one of {', '.join(READ_TYPES)}")
    path = path or scratch(spark, "warc")
    fs, root = _open(path)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    keys = _keys(pages, id_col, html_col)
    total = keys.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // max(shard_bytes, min(total // 4096, most_shard_bytes))))
    # a boundary's shard starts at it
    bounds = _boundaries(keys, shards) if shards > 1 else []

    @F.arrow_udf("int")
    def shard_of(page: pa.Array, digest: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, _order(p, d)) for p, d in zip(page.to_pylist(), digest.to_pylist(), strict=True)], type=pa.int32())

    # A revisit's decision travels as a row of its own, sorted before the page's records: payloads are shuffled once.
    told = _revisits(keys, revisit_min_bytes).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "n", "hex", "refers_to", F.lit(0).alias("kind"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"), F.octet_length(text_of(html_col)).cast("bigint").alias("n"), F.sha1(text_of(html_col)).alias("hex"))
    rows = told.unionByName(rows.withColumn("refers_to", F.lit(None).cast(rows.schema["page_id"].dataType)).withColumn("kind", F.lit(1)))
    placed = rows.withColumn("shard", shard_of("page_id", "hex")).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "page_id", "hex", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        attempt, done, out, state, told = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}", [], None, None, None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append(state)
                out = None

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    told = r
                    continue
                refers_to = told["refers_to"] if told and (told["page_id"], told["hex"]) == (r["page_id"], r["hex"]) else None
                if out is not None and (state["shard"] != r["shard"] or state["bytes"] >= roll_bytes):
                    close()
                if out is None:
                    seq = sum(d["shard"] == r["shard"] for d in done)
                    state = {"shard": r["shard"], "seq": seq, "temporary": f"_temporary/{r['shard']:06d}-{seq:06d}-{attempt}", "name": f"part-{r['shard']:06d}-{seq:06d}.warc.gz", "records": 0, "bytes": 0}
                    out = fs.open_output_stream(f"{root}/{state['temporary']}")
                digest = base64.b32encode(bytes.fromhex(r["hex"])).decode()
                member = gzip_member(record(r["page_id"], r["url"], r["html"].encode(), refers_to, digest, r["n"]))
                out.write(member)
                state["records"] += 1
                state["bytes"] += len(member)
        close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    placed.mapInArrow(run, MANIFEST).write.parquet(f"{path}/_manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        for batch in batches:
            for r in batch.to_pylist():
                if fs.get_file_info(f"{root}/{r['temporary']}").type != pafs.FileType.NotFound:
                    fs.move(f"{root}/{r['temporary']}", f"{root}/{r['name']}")
                elif fs.get_file_info(f"{root}/{r['name']}").size != r["bytes"]:
                    raise OSError(f"{r['name']} is neither waiting nor committed")
            yield batch

    committed = manifest.mapInArrow(commit, MANIFEST).drop("temporary").withColumn("path", F.lit(path)).withColumn("id_type", F.lit(None).cast(kind))
    committed.write.parquet(f"{path}/_committed")
    fs.delete_dir(f"{root}/_temporary")  # also drops what failed attempts left
    return spark.read.parquet(f"{path}/_committed")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def members(stream) -> Iterator[bytes]:
    """The records of an archive file, one gzip member at a time."""
    left, z, parts = b"", None, []
    while True:
        data = left or stream.read(CHUNK)
        if not data:
            break
        z = z or zlib.decompressobj(31)
        parts.append(z.decompress(data))
        left = b""
        if z.eof:
            yield b"".join(parts)
            left, z, parts = z.unused_data, None, []
    if z is not None:
        raise OSError("the file ends inside a record")


def parse(data: bytes) -> dict:
    """Headers and payload of a record; its block digest and, for responses, its payload digest are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or kind == "response" and (base32_sha1(payload) != digest or len(payload) != full):
        raise OSError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": fields.get("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": full, "payload_digest": digest, "record_type": kind, "refers_to": fields.get("X-Refers-To-Page-ID"), "payload": payload if kind == "response" else None, "file": None}


#: Types that ids may have.
READ_TYPES = ("bigint", "int", "smallint", "tinyint", "string")
READ_ARROW = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("file", pa.string())])
READ = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary, file string"


def read(manifest: DataFrame, with_payload: bool = True, batch_bytes: int = 16 << 20) -> DataFrame:
    """The records of the files in a manifest, read as streams; payloads of revisits are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, root = _open(path)
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        rows.append(parse(data) | {"file": name} | ({} if with_payload else {"payload": None}))
                        size += len(data)
                        if size > batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema=READ_ARROW)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=READ_ARROW)

    files, kind = manifest.select("name", "path"), manifest.schema["id_type"].dataType
    found = files.repartition(max(1, min(files.count(), 100_000))).mapInArrow(run, READ)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
