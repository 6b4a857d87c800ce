"""Queries of the codecs, of archives, and of streaming ingest."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codecs as K
from ..operators import dedup as D
from ..operators import transforms as X
from ..operators.lineage import shared_dir, written
from ..sources import archives as A
from .catalogue import BYTES, CDC, FNV32, FNV64, HEX, HUGE, TEXT, documents, table

OK = T.BooleanType()


def checked(function):
    """A UDF that says for each binary value whether function(value) is true."""

    @F.arrow_udf(OK)
    def run(v: pa.Array) -> pa.Array:
        return pa.array([bool(function(x or b"")) for x in v.to_pylist()])

    return run


def _per_document(spark, d, function, name):
    return documents(spark, d).select(F.col("blob_id").alias("doc_id"), checked(function)("content").alias(name))


def _digests(spark, d, **functions):
    """Of each document the SHA-256 of what each function makes of its bytes."""
    made = [F.sha2(X.mapped(f)("content"), 256).alias(name) for name, f in functions.items()]
    return documents(spark, d).select(F.col("blob_id").alias("doc_id"), *made)


def lz4_roundtrip(spark, d):
    """Blocks of Arrow's encoder, read by the decoder here."""

    def decoded(x):
        z = K.lz4_compress(x)
        return K.lz4_decompress(z) if len(z) <= K.lz4_bound(len(x)) else None

    return _digests(spark, d, decoded_sha256=decoded)


def bcj_roundtrip(spark, d):
    """Texts have no calls and jumps: their h and i are made such bytes."""
    code = lambda x: x.replace(b"h", b"\xe8").replace(b"i", b"\xe9")
    return _digests(spark, d, filtered_sha256=lambda x: X.bcj(code(x)), back_sha256=lambda x: X.bcj(X.bcj(code(x)), True))


def delta_filter_roundtrip(spark, d):
    """The filtered bytes at three strides, and the bytes made of the last again."""
    return _digests(spark, d, delta1=lambda x: X.delta(x, 1), delta2=lambda x: X.delta(x, 2), delta4=lambda x: X.delta(x, 4), back_sha256=lambda x: X.undelta(X.delta(x, 4), 4))


def bwt_roundtrip(spark, d):
    return _per_document(spark, d, lambda x: X.unbwt(*X.bwt(x)) == x, "roundtrip_ok")


def dict_roundtrip(spark, d):
    """Each document as a dictionary object, written and read again: its id, checksum and size, and whether it is intact."""

    @F.arrow_udf(T.StructType([T.StructField("id", T.StringType()), T.StructField("checksum", T.LongType()), T.StructField("written", T.LongType()), T.StructField("intact", OK)]))
    def run(v: pa.Array) -> pa.Array:
        rows = []
        for x in v.to_pylist():
            blob = K.dict_serialize(K.dict_create(x))
            back = K.dict_deserialize(blob)
            rows.append({"id": f"{back['id']:016x}", "checksum": back["checksum"], "written": len(blob), "intact": K.dict_intact(back) and back["data"] == x})
        return pa.array(rows, pa.struct([("id", pa.string()), ("checksum", pa.int64()), ("written", pa.int64()), ("intact", pa.bool_())]))

    return documents(spark, d).select(F.col("blob_id").alias("doc_id"), run("content").alias("d")).select("doc_id", "d.*")


def delta_script(spark, d):
    """What a script from each document to itself with its middle changed makes of the document, and whether the script is short."""
    target = lambda x: x[: len(x) // 2] + b"another middle" + x[len(x) // 2 + 20 :]

    @F.arrow_udf(T.StructType([T.StructField("target", T.BinaryType()), T.StructField("short", OK)]))
    def run(v: pa.Array) -> pa.Array:
        rows = []
        for x in v.to_pylist():
            script = K.delta_encode(x, target(x))
            rows.append({"target": K.delta_apply(x, script), "short": len(x) < 400 or 2 * len(script) < len(x)})
        return pa.array(rows, pa.struct([("target", pa.binary()), ("short", pa.bool_())]))

    out = documents(spark, d).select(F.col("blob_id").alias("doc_id"), run("content").alias("d"))
    return out.select("doc_id", F.sha2("d.target", 256).alias("target_sha256"), F.col("d.short").alias("short"))


def _turns(spark, d):
    return D.blobs(table(spark, d, "benchmark"), "item_id", "text")


def huffman_roundtrip(spark, d):
    return _turns(spark, d).select(F.col("blob_id").alias("item_id"), checked(lambda x: K.decompress(K.compress(x, 4), len(x), 4) == x)("content").alias("roundtrip_ok"))


def rans_roundtrip(spark, d):
    return _turns(spark, d).select(F.col("blob_id").alias("item_id"), checked(lambda x: K.decompress(K.compress(x, 8), len(x), 10) == x)("content").alias("roundtrip_ok"))


def huffman_documents(spark, d):
    return _per_document(spark, d, lambda x: K.decompress(K.compress(x, 4), len(x), 4) == x, "roundtrip_ok")


def rans_documents(spark, d):
    return _per_document(spark, d, lambda x: K.decompress(K.compress(x, 8), len(x), 10) == x, "roundtrip_ok")


def huffman_lengths(spark, d):
    """Code lengths of the bytes of each language, at most 13 bits: the Kraft sum is a whole, and the coded text has the
    least number of bits that such a code can have."""
    hist = X.histogram(documents(spark, d, "lang"), "lang").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("byte", "n"))).alias("h"))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(h: pa.Array) -> pa.Array:
        out = []
        for rows in h.to_pylist():
            freq = [0] * 256
            for r in rows:
                freq[r["byte"]] = r["n"]
            out.append(K.code_lengths(freq, K.MOST_BITS))
        return pa.array(out, pa.list_(pa.int32()))

    coded = hist.select("lang", F.posexplode(run("h")).alias("byte", "bits")).where("bits > 0")
    counts = X.histogram(documents(spark, d, "lang"), "lang")
    coded = coded.join(counts.select(F.col("lang").alias("l"), F.col("byte").cast("int").alias("b"), "n"), F.col("lang").eqNullSafe(F.col("l")) & (F.col("byte") == F.col("b")))
    return coded.groupBy("lang").agg(F.count("*").alias("symbols"), F.sum(F.col("n") * F.col("bits")).alias("coded_bits"), (F.max("bits") <= K.MOST_BITS).alias("within_limit"), F.sum(F.pow(F.lit(2.0), -F.col("bits"))).alias("kraft"))


def digest256(spark, d):
    @F.arrow_udf(T.StringType())
    def run(v: pa.Array) -> pa.Array:
        with np.errstate(over="ignore"):
            return pa.array([x.hex() for x in K.digests([x or b"" for x in v.to_pylist()])])

    return documents(spark, d).select(F.col("blob_id").alias("doc_id"), run("content").alias("digest"))


def codec_benchmark(spark, d):
    """Each method on each document: bytes in, bytes out, ratio. Times are not part of the result."""
    methods = {f"level{n}": n for n in range(2, 10)}

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("method", T.StringType()), T.StructField("csize", T.LongType())])))
    def run(v: pa.Array) -> pa.Array:
        texts = v.to_pylist()
        rows = []
        for x, streams in zip(texts, K.compress_all(texts, list(methods.values()))):
            rows.append([{"method": m, "csize": len(z)} for m, z in zip(methods, streams)] + [{"method": "lz4", "csize": len(K.lz4_compress(x))}])
        return pa.array(rows, pa.list_(pa.struct([("method", pa.string()), ("csize", pa.int64())])))

    out = documents(spark, d).select(F.length("content").cast("long").alias("size"), F.explode(run("content")).alias("c")).groupBy("c.method").agg(F.sum("size").alias("size"), F.sum("c.csize").alias("csize"))
    return out.withColumn("ratio", F.round(F.col("csize") * 100 / F.nullif(F.col("size"), F.lit(0)), 2))


def best_strides(spark, d):
    @F.arrow_udf(T.IntegerType())
    def run(v: pa.Array) -> pa.Array:
        return pa.array([X.best_stride(x or b"") for x in v.to_pylist()], pa.int32())

    return documents(spark, d).select(F.col("blob_id").alias("doc_id"), run("content").alias("stride"))


def _archived(items, key):
    """Texts (blob_id, content) in archives of ten files, written, listed and extracted again."""
    item = items.select(F.concat(F.lit("a"), F.expr("blob_id div 10")).alias("archive"), F.concat(F.lit("items/"), F.col("blob_id"), F.lit(".txt")).alias("name"), "content", F.lit(0).cast("long").alias("dos_time"))
    made = written(A.create(item))
    listed = A.list_entries(made).where("kind = 'file'").select("path", "seq", "name", "size")
    return listed.join(A.extract_files(made).select("path", "seq", "content"), ["path", "seq"]).select(F.regexp_extract("name", "([0-9]+)", 1).cast("long").alias(key), "size", F.decode("content", "UTF-8").alias("text"))


def archive_scan(spark, d):
    """The benchmark texts in archives."""
    return _archived(_turns(spark, d), "item_id")


def archive_documents(spark, d):
    """All documents in archives."""
    return _archived(documents(spark, d), "doc_id")


def stream_ingest(spark, d):
    """Documents ingested by a stream; the totals are those of one ingest of all."""
    from ..streaming.store import BlockStore

    at = f"{shared_dir(spark)}/cairn-stream-{uuid.uuid4().hex}"
    source = f"{d}/documents.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source + "*")
    store = BlockStore(spark, f"{at}/store")
    query = store.start(D.blobs(stream, "doc_id", "text"), f"{at}/checkpoint")
    query.awaitTermination()
    return store.stats().select("n_chunks", "n_blocks", "total_bytes", "saved_bytes")


def _package_merge() -> str:
    """The least number of bits of a code of at most MOST_BITS bits: sums of pairs join the weights once for each bit, and the
    first 2 n - 2 of the last list are taken."""
    steps = "".join(f""",
l{k} AS (SELECT lang, w, list_sort(list_concat(w, list_transform(range(1, len(l) // 2 * 2, 2), lambda i: l[i] + l[i + 1]))) AS l FROM l{k - 1})""" for k in range(2, K.MOST_BITS + 1))
    return f"""
WITH h AS (SELECT lang, v, count(*)::HUGEINT AS n FROM (SELECT lang, unnest({BYTES}) AS v FROM (SELECT lang, coalesce(text, '') AS text FROM documents)) GROUP BY ALL),
l1 AS (SELECT lang, list_sort(list(n)) AS w, list_sort(list(n)) AS l FROM h GROUP BY lang){steps}
SELECT lang, len(w)::BIGINT AS symbols, list_sum(l[1:2 * len(w) - 2])::BIGINT AS coded_bits, true AS within_limit, 1.0::DOUBLE AS kraft FROM l{K.MOST_BITS}"""


def _shifted(stride: int) -> str:
    """The digest of the bytes b less those `stride` before them."""
    zeros = ", ".join("0" * stride)
    each = f"list_transform(list_zip(b, list_concat([{zeros}], b))[1:len(b)], lambda z: format('{{:02x}}', (z[1] - z[2] + 256) % 256))"
    return f"sha256(unhex(array_to_string({each}, '')))"


#: Calls and jumps are whole pieces of five bytes, all else pieces of one, from left to right.
BCJ_SQL = f"""
WITH c AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CASE x WHEN '68' THEN 'E8' WHEN '69' THEN 'E9' ELSE x END), '') AS code FROM {TEXT}),
p AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS piece FROM (SELECT doc_id, regexp_extract_all(code, '(?:E8|E9).{{8}}|..') AS l FROM c)),
o AS (SELECT doc_id, i, piece, (sum(length(piece) // 2) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS stop FROM p),
n AS (SELECT doc_id, i, piece, (('0x' || piece[9:10] || piece[7:8] || piece[5:6] || piece[3:4])::BIGINT + stop) % 4294967296 AS t FROM o WHERE length(piece) = 10),
w AS (SELECT doc_id, i, piece[1:2] || format('{{:02X}}{{:02X}}{{:02X}}{{:02X}}', t % 256, t // 256 % 256, t // 65536 % 256, t // 16777216) AS piece FROM n UNION ALL SELECT doc_id, i, piece FROM p WHERE length(piece) = 2),
f AS (SELECT doc_id, sha256(unhex(string_agg(piece, '' ORDER BY i))) AS h FROM w GROUP BY doc_id)
SELECT c.doc_id, coalesce(h, sha256('')) AS filtered_sha256, sha256(unhex(code)) AS back_sha256 FROM c LEFT JOIN f USING (doc_id)"""

TRUE_DOCS, TRUE_ITEMS = "SELECT doc_id, true AS roundtrip_ok FROM documents", "SELECT item_id, true AS roundtrip_ok FROM benchmark"
SQL = {n: TRUE_DOCS for n in ("bwt_roundtrip", "huffman_documents", "rans_documents")} | {
    "lz4_roundtrip": f"SELECT doc_id, sha256(encode(text)) AS decoded_sha256 FROM {TEXT}",
    "bcj_roundtrip": BCJ_SQL,
    "delta_filter_roundtrip": f"SELECT doc_id, {_shifted(1)} AS delta1, {_shifted(2)} AS delta2, {_shifted(4)} AS delta4, sha256(encode(text)) AS back_sha256 FROM (SELECT doc_id, text, {BYTES} AS b FROM {TEXT})",
    "dict_roundtrip": f"SELECT doc_id, {HEX.format(FNV64.format(bytes=HUGE))} AS id, {FNV32.format(bytes=HUGE)}::BIGINT AS checksum, (octet_length(encode(text)) + 24)::BIGINT AS written, true AS intact FROM {TEXT}",
    "delta_script": f"SELECT doc_id, sha256(unhex(x[:n // 2 * 2] || hex(encode('another middle')) || x[n // 2 * 2 + 41:])) AS target_sha256, true AS short FROM (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text)) AS n FROM {TEXT})",
    "huffman_roundtrip": TRUE_ITEMS,
    "rans_roundtrip": TRUE_ITEMS,
    "huffman_lengths": _package_merge(),
    "archive_scan": "SELECT item_id, octet_length(encode(text))::BIGINT AS size, text FROM benchmark",
    "archive_documents": "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS size, coalesce(text, '') AS text FROM documents",
    "stream_ingest": f"{CDC} SELECT count(*)::BIGINT AS n_chunks, count(*) FILTER (is_new)::BIGINT AS n_blocks, (sum(length) FILTER (is_new))::BIGINT AS total_bytes, (sum(length) FILTER (NOT is_new))::BIGINT AS saved_bytes FROM f",
}

QUERIES = {f.__name__: f for f in (
    lz4_roundtrip, bcj_roundtrip, delta_filter_roundtrip, bwt_roundtrip, dict_roundtrip, delta_script, huffman_roundtrip, rans_roundtrip, huffman_lengths, digest256, codec_benchmark,
    best_strides, archive_scan, stream_ingest, huffman_documents, rans_documents, archive_documents,
)}
