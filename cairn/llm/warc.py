"""WARC archives: a writer with revisit records and a salvage reader (operator 9).

Writer: each record is a gzip member of its own (or plain, with gz=False) of WARC 1.1. Of rows with equal
payloads of at least `revisit_from` bytes, that with the smallest id becomes a response, the others become
revisits that refer to it. Tasks write archives of about `most_bytes` into a folder that all executors
share; an archive's name holds the task's attempt, and the returned manifest lists only archives of
attempts that succeeded, so a lost executor or a repeated task leaves nothing double.

Reader: archives are read as streams, in blocks. Every record's length and block digest are checked. After
a failed check (a broken member, a bad header, a wrong length or digest, an early end) the reader searches
for the next gzip member that decompresses to a version line, or the next plain version line; it goes on
there and logs the bytes between as a row of type `gap` with the reason. Memory is that of one record, by the
length it claims: a plain record with too large a length holds the archive's rest until it is found out, which
is at most `most_bytes` and a record for archives of this writer.

Hot payloads: the ids of repeated payloads come from a partial aggregation by digest and length; only
repeated digests are joined back, from a written table, so adaptive skew splitting can divide a hot one.

Cases: a null payload is empty; null ids never come before others (a response without an id is referred
to by null) and are written as an empty id; rows that repeat the smallest id are all responses; null
urls are written empty; an empty table gives no archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, shared_dir, table

MOST_BYTES, BLOCK = 64 << 20, 1 << 20
VERSION, MEMBER = b"WARC/1.", b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"
MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
RECORD = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("record_type", T.StringType()),
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("reason", T.StringType()),
])
ARROW = {T.StringType: pa.string(), T.LongType: pa.int64(), T.BinaryType: pa.binary()}


def schema(t: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, ARROW[type(f.dataType)]) for f in t])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header only; its digest and length are the full payload's."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join((url or "").split()), f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict, int] | str:
    """The record at the start of data and its length, or what is wrong with it."""
    stop = data.find(b"\r\n\r\n")
    if not data.startswith(VERSION) or stop < 0:
        return "header"
    head = {}
    for line in data[:stop].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return "header"
        head[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not size.isdigit():
        return "length"
    end = stop + 4 + int(size)
    block = data[stop + 4 : end]
    if len(block) < int(size) or data[end : end + 4] != b"\r\n\r\n":
        return "length"
    want = head.get("warc-block-digest")
    if want and want.removeprefix("sha1:") != base32_sha1(block):
        return "digest"
    kind = head.get("warc-type", "")
    number = lambda v: int(v[10:-1]) if v.startswith("<urn:page:") and v[10:-1].lstrip("-").isdigit() else None
    http, gap, payload = block.partition(b"\r\n\r\n")
    full = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:") and x.partition(b":")[2].strip().isdigit()), 0)
    whole = kind == "response"
    return {
        "record_type": kind, "page_id": number(head.get("warc-record-id", "")), "url": head.get("warc-target-uri", ""),
        "payload_digest": base32_sha1(payload) if whole else head.get("warc-payload-digest", "").removeprefix("sha1:"),
        "payload_bytes": len(payload) if whole else full, "refers_to": number(head.get("warc-refers-to", "")), "payload": payload if whole else None, "reason": None,
    }, end + 4


class Source:
    """Bytes of a stream from `base` on; earlier ones are given up."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.base, self.data, self.ended = read, 0, bytearray(), False

    def more(self) -> bool:
        block = b"" if self.ended else self.read(BLOCK)
        self.ended = not block
        self.data += block
        return bool(block)

    def need(self, end: int) -> bool:
        while self.base + len(self.data) < end and self.more():
            pass
        return self.base + len(self.data) >= end

    def drop(self, to: int) -> None:
        del self.data[: to - self.base]
        self.base = to


def member(source: Source, start: int, most: int | None = None) -> tuple[bytes, int] | str:
    """What the gzip member at start decompresses to (at most about `most` bytes) and its end, or what is wrong."""
    z, out, at = zlib.decompressobj(31), [], start
    size = 0
    while not z.eof:
        if not source.need(at + 1):
            return "truncated"
        block = bytes(source.data[at - source.base : at - source.base + (BLOCK if most is None else 4096)])
        try:
            out.append(z.decompress(block))
        except zlib.error:
            return "member"
        at += len(block) - len(z.unused_data)
        size += len(out[-1])
        if most is not None and size >= most:
            break
    return b"".join(out), at


def resumed(source: Source, start: int) -> int:
    """Where the next member or version line after start begins, else the end of the stream. Bytes passed by are dropped."""
    at = start + 1
    while True:
        data = source.data
        found = sorted(x for x in (data.find(MEMBER, at - source.base), data.find(b"\n" + VERSION, at - 1 - source.base), data.find(VERSION, at - source.base) if at == 0 else -1) if x >= 0)
        if found:
            p = source.base + found[0]
            if data[found[0] : found[0] + 3] == MEMBER:
                got = member(source, p, len(VERSION))
                if not isinstance(got, str) and got[0].startswith(VERSION):
                    return p
                at = p + 1
                continue
            return p + 1
        tail = source.base + max(0, len(source.data) - 8)
        at = max(at, tail)
        source.drop(max(source.base, min(at - 1, tail)))
        if not source.more():
            return source.base + len(source.data)


def salvage(read: Callable[[int], bytes]) -> Iterator[dict]:
    """Records of one archive in order, and a `gap` for each run of bytes that had to be left out."""
    source, at = Source(read), 0
    while source.need(at + 1):
        source.drop(at)
        source.need(at + 10)
        if source.data.startswith(MEMBER):
            got = member(source, at)
            if not isinstance(got, str):
                got = (parsed(got[0]), got[1])
                got = got[0] if isinstance(got[0], str) else (got[0][0], got[1])
        else:
            while isinstance(got := parsed(bytes(source.data)), str) and source.data.startswith(VERSION) and got in ("header", "length"):
                stop = source.data.find(b"\r\n\r\n")
                size = next((x.partition(b":")[2].strip() for x in bytes(source.data[: max(stop, 0)]).split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
                want = at + stop + 8 + int(size) if size.isdigit() else at + len(source.data) + BLOCK if stop < 0 and len(source.data) < BLOCK else 0
                if want <= source.base + len(source.data) or not source.need(want) and not source.ended:
                    break
                if source.ended and want > source.base + len(source.data):
                    break
            if not isinstance(got, str):
                got = (got[0], at + got[1])
        if isinstance(got, str):
            end = resumed(source, at)
            yield {"start": at, "end": end, "record_type": "gap", "payload_bytes": end - at, "reason": got}
        else:
            end = got[1]
            yield {"start": at, "end": end} | got[0]
        at = end


def opened(uri: str):
    """File system and path of a folder or file: anything that pyarrow knows (file, hdfs, s3, ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri if not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


def with_revisits(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """page_id, url, payload, and for revisits the id of the response (revisit, refers_to)."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("__digest", F.sha1("payload")).withColumn("__bytes", F.length("payload"))
    first = keyed.where(F.col("__bytes") >= revisit_from).groupBy("__digest", "__bytes").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    joined = keyed.join(materialise(first, "repeated-payloads"), ["__digest", "__bytes"], "left")
    revisit = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("__first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, gz: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Writes the records (as with_revisits gives them) and returns the written manifest, a row for each archive."""
    rows = schema(MANIFEST)

    def write(batches):
        context = TaskContext.get()
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        out, done, n, size = None, 0, 0, 0
        for batch in batches:
            for page_id, url, payload, revisit, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId():08d}-{done:05d}.warc" + ".gz" * gz
                    out, n, size = system.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                data = record(page_id, url, payload, revisit, refers_to)
                if gz:
                    z = zlib.compressobj(6, wbits=31)
                    data = z.compress(data) + z.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= most_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n, "bytes": size}], rows)
                    out, done = None, done + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n, "bytes": size}], rows)

    return materialise(records.mapInArrow(write, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, most_tasks: int = 10_000) -> DataFrame:
    """Rows of all records and gaps of the archives in column path."""
    rows = schema(RECORD)

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = opened(uri)
                with system.open_input_stream(path, compression=None) as stream:
                    some, size = [], 0
                    for r in salvage(stream.read):
                        some.append({"path": uri} | r)
                        size += len(r.get("payload") or b"") + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(some, rows)
                            some, size = [], 0
                    if some:
                        yield pa.RecordBatch.from_pylist(some, rows)

    tasks = max(1, min(manifest.count(), most_tasks))
    return manifest.select("path").repartition(tasks).mapInArrow(read, RECORD)


def salvaged(data: bytes) -> list[dict]:
    """Records and gaps of an archive in memory."""
    return list(salvage(io.BytesIO(data).read))


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/cairn/warc-{uuid.uuid4().hex}"
    manifest = write_archives(with_revisits(table(spark, sf_dir, "pages")), folder)
    found = read_archives(manifest).where("record_type in ('response', 'revisit')")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# DuckDB has no base32: the digest is built from the bits of the SHA-1, five at a time.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
b AS (SELECT *, array_to_string(list_transform(range(20), lambda i: right('0000000' || bin(('0x' || substr(h, (2 * i + 1)::INT, 2))::INT), 8)), '') AS bits FROM d),
r AS (SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (list_sum(list_transform(range(5), lambda j: (substr(bits, (5 * i + j + 1)::INT, 1) = '1')::INT * (16 >> j::INT))) + 1)::INT, 1)), '') AS payload_digest FROM b),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM r)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
