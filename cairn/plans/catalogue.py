"""The engine's queries over the shared tables, and the same in SQL where SQL can say it."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import checksum, fnv32, fnv64, hex64
from ..functions.kernels import gear_table
from ..operators import catalog as C
from ..operators import dedup as D
from ..operators import transforms as X
from ..operators.lineage import written

BITS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return D.blobs(table(spark, sf_dir, "documents"), "doc_id", "text", *keep)


def chunks(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return D.chunked(documents(spark, sf_dir, *keep), BITS)


def chunk_table(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Chunks as a written table, for plans that read them more than once: the content is cut and hashed once."""
    return written(chunks(spark, sf_dir, *keep).select("blob_id", "chunk_ix", "hash64", "length", *keep))


# ---- checksums and hashes

def checksum_documents(spark, d):
    return documents(spark, d).select(F.col("blob_id").alias("doc_id"), F.length("content").cast("long").alias("size"), checksum("content").alias("csum"))


def fnv32_documents(spark, d):
    return documents(spark, d).select(F.col("blob_id").alias("doc_id"), fnv32("content").alias("fnv32"))


def fnv64_documents(spark, d):
    return documents(spark, d).select(F.col("blob_id").alias("doc_id"), hex64(fnv64("content")).alias("fnv64"))


def exact_dup_groups(spark, d):
    return D.exact_duplicates(documents(spark, d)).select(hex64(F.col("h")).alias("hash"), "size", "n", F.col("first_blob").alias("first_doc"))


def content_type(spark, d):
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    docs = documents(spark, d).select(F.lit("documents").alias("corpus"), C.content_type(head, F.length("content")).alias("kind"))
    pages = D.blobs(table(spark, d, "pages"), "page_id", "html").select(F.lit("pages").alias("corpus"), C.content_type(head, F.length("content")).alias("kind"))
    return docs.union(pages).groupBy("corpus", "kind").agg(F.count("*").alias("n"))


def magic_identify(spark, d):
    return documents(spark, d).select(F.col("blob_id").alias("doc_id"), C.identify(F.col("content")).alias("identity"))


# ---- entropy

def byte_histogram(spark, d):
    return X.histogram(documents(spark, d, "lang"), "lang")


def entropy_by_lang(spark, d):
    return X.entropy(byte_histogram(spark, d), "lang")


def rans_freq_table(spark, d):
    return X.frequency_table(byte_histogram(spark, d), "lang")


def default_lengths() -> list[int]:
    """Code lengths of the default tree, from (number of symbols, length) in a row. Fixed values."""
    runs = ((10, 9), (1, 7), (1, 9), (1, 7), (19, 9), (1, 7), (13, 8), (1, 7), (11, 8), (1, 7), (33, 8), (1, 7), (35, 8), (128, 10), (16, 6), (12, 7), (6, 8), (10, 9), (16, 10), (9, 4), (9, 5), (10, 6))
    return [v for n, v in runs for _ in range(n)]


def small_literal_csize(spark, d):
    """Compressed size of messages under 256 bytes, all of whose bytes are literals of the default tree."""
    lengths = F.array(*[F.lit(v) for v in default_lengths()[:256]])
    from ..functions.arrays import byte_values

    turns = D.blobs(table(spark, d, "conversations"), "conv_id", "text", "turn").where(F.length("content") < 256)
    bits = F.aggregate(byte_values(F.col("content")), F.lit(0), lambda a, b: a + F.element_at(lengths, b + 1))
    return turns.select(F.col("blob_id").alias("conv_id"), "turn", F.length("content").cast("long").alias("size"), (2 * F.ceil((bits + 29) / 16)).cast("long").alias("csize"))


# ---- transforms

def delta_filter_bytes(spark, d):
    rows = X.byte_rows(D.blobs(table(spark, d, "part"), "p_partkey", "p_name"))
    back = X.undelta_rows(X.delta_rows(rows, 2).withColumnRenamed("v", "was"), 2)
    return back.groupBy("blob_id").agg(F.sum("d").alias("sum_delta"), F.sum((F.col("pos") + 1) * F.col("d")).alias("weighted"), F.min((F.col("v") == F.col("was")).cast("int")).alias("inverse_ok"))


def delta_checksums(spark, d):
    """The checksum of each document's bytes less those four before, as a stream of that method stores it."""
    return documents(spark, d).select(F.col("blob_id").alias("doc_id"), checksum(X.mapped(lambda v: X.delta(v, 4))("content")).alias("csum"))


def dos_time_roundtrip(spark, d):
    o = table(spark, d, "events").select("event_id", "ts")
    packed = o.select("event_id", C.dos_time(F.col("ts")).alias("dos_time"))
    return packed.select("event_id", "dos_time", F.date_format(C.from_dos_time(F.col("dos_time")), "yyyy-MM-dd HH:mm:ss").alias("back"))


def dos_names(spark, d):
    path = F.concat(F.lower("p_brand"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit(".")))
    named = table(spark, d, "part").select("p_partkey", C.dos_name(path).alias("dos_name"), path.alias("path"))
    return named.select("p_partkey", "dos_name", C.display_name(F.col("dos_name")).alias("shown"), C.file_type_key(F.col("path")).alias("type_key"))


def bwt_short(spark, d):
    """The transform of part names by sorting rotations as rows."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("s"), F.length("p_name").alias("n"))
    turned = p.select("p_partkey", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.col("s").substr(i + 1, F.col("n")), F.col("s").substr(F.lit(1), i)))).alias("i", "rot"))
    w = Window.partitionBy("p_partkey").orderBy("rot", "i")
    ranked = turned.select("p_partkey", "i", F.substring("rot", -1, 1).alias("c"), (F.row_number().over(w) - 1).alias("rank"))
    return ranked.groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "c"))), lambda x: x["c"]), "").alias("last"), F.max(F.when(F.col("i") == 0, F.col("rank"))).cast("long").alias("row"))


def parity_sectors(spark, d):
    from ..functions.arrays import byte_values

    groups = documents(spark, d).select("blob_id", F.explode(X.parity("content")).alias("p")).select("blob_id", "p.*")
    weight = F.aggregate(F.zip_with(byte_values(F.col("parity")), F.sequence(F.lit(1), F.lit(X.SECTOR)), lambda b, i: b * i), F.lit(0), lambda a, x: a + x)
    return groups.select(F.col("blob_id").alias("doc_id"), "grp", "n_sectors", weight.cast("long").alias("weight"))


def parity_repair(spark, d):
    """Every document with one sector lost: whether parity brings it back."""
    from pyspark.sql import types as T

    @F.arrow_udf(T.BooleanType())
    def run(v):
        import numpy as np
        import pyarrow as pa

        out = []
        for x in v.to_pylist():
            s = X.sectors_of(x)
            g = X.groups_for(len(s))
            par = [np.bitwise_xor.reduce(s[i::g], axis=0).tobytes() for i in range(min(g, len(s)))]
            bad = len(s) // 2
            hurt = bytearray(x)
            hurt[bad * X.SECTOR : (bad + 1) * X.SECTOR] = bytes(len(hurt[bad * X.SECTOR : (bad + 1) * X.SECTOR]))
            out.append(not x or X.repair(bytes(hurt), par, [bad]) == x)
        return pa.array(out)

    return documents(spark, d).select(F.col("blob_id").alias("doc_id"), run("content").alias("repaired"))


# ---- chunks

def cdc_chunks(spark, d):
    return chunks(spark, d).select(F.col("blob_id").alias("doc_id"), "chunk_ix", "offset", "length")


def chunk_hashes(spark, d):
    return chunks(spark, d).groupBy(hex64(F.col("hash64")).alias("hash")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.min("blob_id").alias("first_doc"))


def merkle_root(spark, d):
    return D.merkle(documents(spark, d), BITS).select(F.col("blob_id").alias("doc_id"), "n_chunks", "bytes", hex64(F.col("root")).alias("root"))


def merkle_similarity(spark, d):
    """Each document against the next one by id."""
    c = chunk_table(spark, d)
    a = c.select(F.col("blob_id").alias("pair"), "hash64", "length")
    b = c.select((F.col("blob_id") - 1).alias("pair"), "hash64")
    return D.common_chunks(a, b, "blob_id", "blob_id", "pair").select(F.col("pair").alias("doc_id"), "n_chunks", "n_common", "common_bytes", F.round("similarity", 9).alias("similarity"))


def blockstore_ingest(spark, d):
    return D.ingested(chunk_table(spark, d)).withColumnRenamed("blob_id", "doc_id")


def blockstore_totals(spark, d):
    return D.ingested(chunk_table(spark, d)).agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_new").alias("n_blocks"), F.sum("stored_bytes").alias("total_bytes"), F.sum("saved_bytes").alias("saved_bytes"))


def store_delta(spark, d):
    """Documents ingested into a store that holds the chunks of all even ones."""
    c = chunk_table(spark, d)
    return D.ingested(c.where(F.col("blob_id") % 2 == 1), c.where(F.col("blob_id") % 2 == 0)).withColumnRenamed("blob_id", "doc_id")


def shared_chunk_files(spark, d):
    return D.shared(chunks(spark, d)).select(hex64(F.col("hash64")).alias("hash"), "n_files", F.col("first_blob").alias("first_doc"))


def source_overlap(spark, d):
    """Chunk sets of the sources: in how many hashes each pair of sources agrees."""
    sets = chunks(spark, d, "source").select("source", "hash64").distinct()
    by_hash = sets.groupBy("hash64").agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1)
    pair = F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    return by_hash.select(pair.alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n_common"))


def dedup_by_source(spark, d):
    """Flagship: chunks, unique chunks, bytes and saved bytes of each source."""
    found = D.new_and_known(chunk_table(spark, d, "source"), "source")
    saved = F.col("bytes") - F.col("stored_bytes")
    return found.select("source", F.col("n_chunks").alias("chunks"), F.col("n_new").alias("unique_chunks"), F.col("bytes").alias("total_bytes"), saved.alias("saved_bytes"), F.round(saved / F.col("bytes"), 6).alias("dedup_ratio"))


def simhash_benchmark(spark, d):
    return D.fingerprints(D.blobs(table(spark, d, "benchmark"), "item_id", "text")).select(F.col("blob_id").alias("item_id"), hex64(F.col("fp")).alias("fp"))


def simhash_documents(spark, d):
    return D.fingerprints(documents(spark, d)).select(F.col("blob_id").alias("doc_id"), hex64(F.col("fp")).alias("fp"))


def near_dup_classes(spark, d):
    """Classes of equal fingerprints of documents, each with the number of classes within 6 bits and the least distance."""
    batches = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if batches not in spark.conf.getAll:  # whole documents: a batch is held by the JVM and by Python
        spark.conf.set(batches, "1000")
    return D.near_classes(D.fingerprints(documents(spark, d)), 6).withColumnRenamed("rep", "doc_id")


def master_grouping(spark, d):
    assigned = D.grouped(documents(spark, d), BITS, written)
    return D.masters(written(assigned), documents(spark, d))


# ---- catalogs

def entries(spark, d):
    """Documents as files: the source is the directory, the language the name, the id the order of arrival."""
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("dir"), F.col("lang").alias("name"), F.length(F.encode("text", "UTF-8")).cast("long").alias("size"))


def catalog_listing(spark, d):
    e = C.versions(entries(spark, d), ["dir", "name"], "doc_id")
    return e.select(F.concat_ws("/", "dir", "name").alias("path"), "version", "size", "doc_id")


def latest_versions(spark, d):
    return C.select_version(catalog_listing(spark, d), 0)


def listing_totals(spark, d):
    e = entries(spark, d)
    return e.groupBy("dir").agg(F.count_distinct("name").alias("files"), F.count("*").alias("revisions"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.max_by("doc_id", F.struct("size", -F.col("doc_id"))).alias("largest_doc"))


def glob_select(spark, d):
    return C.select_paths(catalog_listing(spark, d), "src1?/[!e]*").select("path", "version", "doc_id")


def named_versions(spark, d):
    """Names with a version (name;N), with all versions (name;*), and the newest where none is said."""
    return C.select_named(catalog_listing(spark, d), ["src1/*;1", "src2/e*;*", "src[3-5]/de"]).select("path", "version", "doc_id")


def archive_totals(spark, d):
    """All in all: directories, names, revisions, bytes of all and of the newest, and the oldest version's number."""
    e = catalog_listing(spark, d)
    return e.agg(
        F.count_distinct(F.substring_index("path", "/", 1)).alias("dirs"), F.count_distinct("path").alias("files"), F.count("*").alias("revisions"), F.sum("size").alias("bytes"),
        F.sum(F.when(F.col("version") == 0, F.col("size"))).alias("newest_bytes"), F.max("version").alias("max_version"))


def walk_order(spark, d):
    """Pages' paths and the directories above them: each one's place in its directory, files before directories."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    files = table(spark, d, "pages").select(path.alias("path")).distinct()
    both = files.select("path", F.lit(False).alias("is_dir")).union(C.with_ancestors(files).select("dir", F.lit(True)))
    parent, *order = C.walk_order(both)
    return both.withColumn("place", F.row_number().over(Window.partitionBy(parent).orderBy(*order)).cast("long"))


def kept_revisions(spark, d):
    """The listing after a list of every third version was applied as a filter."""
    e = catalog_listing(spark, d)
    return C.keep_revisions(e, e.where("version % 3 = 1"), ["path"], "doc_id")


def master_numbers(spark, d):
    """The customers of orders, some of whom have a number already, and numbers for the others."""
    known = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("long").alias("key"), F.expr("c_custkey div 3 + 1").cast("long").alias("index"))
    return C.numbered(known, table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("key")), "key", "index")


def error_names(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.named((-(F.col("o_orderkey") % 9)).cast("int"), C.ERRORS, "Error").alias("message"))


def subtree_select(spark, d):
    return C.select_paths(catalog_listing(spark, d), "src[2-4]/").groupBy("path").agg(F.count("*").alias("n"))


def as_of_version(spark, d):
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return C.as_of(e, ["user_id", "event_type"], "ts", at, "event_id").select("user_id", "event_type", "event_id")


def dir_paths(spark, d):
    """All directories above the pages' URLs."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return C.with_ancestors(table(spark, d, "pages").select(path.alias("path"))).select("dir", (F.length("dir") - F.length(F.replace("dir", F.lit("/"), F.lit(""))) + 1).cast("long").alias("depth"))


def master_chain(spark, d):
    """Parts as dictionaries, each made with another one (or none): depth of the chain, and circles."""
    parts = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.lit(None)).when(F.col("p_partkey") % 97 == 5, F.col("p_partkey")).otherwise(F.expr("p_partkey div 2")).alias("master"))
    return C.chains(parts, "p_partkey")


def running_offsets(spark, d):
    """Where each document's data begins in an archive of its source: sizes before it, after a head of 29 bytes."""
    e = C.running_before(entries(spark, d), ["dir"], F.col("doc_id"), F.col("size"), "before")
    return e.select("dir", "doc_id", "size", (F.col("before") + 29).alias("offset"))


def _candidates(blobs, key):
    """Possible chunk ends by built-in functions: a window over the bytes of each blob."""
    gear = F.array(*[F.lit(int(g) & 255) for g in gear_table()])
    rows = X.byte_rows(blobs).withColumn("g", F.element_at(gear, F.col("v") + 1))
    w = Window.partitionBy("blob_id").orderBy("pos")
    h = sum((F.coalesce(F.lag("g", k).over(w), F.lit(0)) * (1 << k) for k in range(BITS)), F.lit(0))
    return rows.withColumn("h", h % (1 << BITS)).where("h = 0").select(F.col("blob_id").alias(key), F.col("pos").cast("long").alias("pos"))


def chunk_candidates(spark, d):
    """Possible chunk ends of the benchmark texts."""
    return _candidates(D.blobs(table(spark, d, "benchmark"), "item_id", "text"), "item_id")


def candidates_documents(spark, d):
    """Possible chunk ends of all documents."""
    return _candidates(documents(spark, d), "doc_id")


def parent_join(spark, d):
    """Customers as entries of their nations as directories; nations below their regions."""
    dirs = table(spark, d, "nation").where("n_nationkey % 5 <> 3").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("path"))
    files = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dir_id"))
    return C.with_parent(files, dirs).select("c_custkey", "dir_path", "lost")


def dir_tree(spark, d):
    """Paths of regions and nations as a tree, top down."""
    r = table(spark, d, "region").select((F.col("r_regionkey") + 1000).alias("id"), F.lit(0).alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("id"), (F.col("n_regionkey") + 1000).alias("parent"), F.col("n_name").alias("name"))
    return C.full_paths(r.union(n).select(F.col("id").cast("long").alias("id"), F.col("parent").cast("long").alias("parent"), "name"))


def listing_lines(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", C.listing_line(F.concat(F.lit("orders/"), F.col("o_orderkey")), F.floor("o_totalprice").cast("long"), F.col("o_orderdate"), (F.col("o_orderkey") % 64).cast("int"), F.col("o_orderkey") % 3).alias("line"))


def freshened(spark, d):
    """Newest event of each user and kind among the odd ones that is newer than all even ones."""
    e = table(spark, d, "events").select("event_id", F.concat_ws("/", F.col("user_id"), "event_type").alias("name"), "ts")
    return C.freshen(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "name", "ts", only_known=False).select("event_id", "name")


def signatures(spark, d):
    from ..functions.arrays import byte_values

    p = table(spark, d, "part")
    return p.select("p_partkey", C.name_bucket(byte_values(F.encode("p_name", "UTF-8"))).alias("bucket"), C.dump_signature(F.length("p_name").cast("long"), checksum(F.encode("p_name", "UTF-8"))).alias("signature"),
                    C.named((F.col("p_size") % 12).cast("int"), C.LEVELS, "Tight").alias("level"), C.store_path(hex64(fnv64(F.encode("p_name", "UTF-8")))).alias("store_path"))


def quota_heads(spark, d):
    """A dictionary's content from many files: of each source the heads of its documents, up to 4096 bytes in all."""
    e = entries(spark, d).withColumn("quota", F.least("size", F.lit(512)))
    e = C.running_before(e, ["dir"], F.col("doc_id"), F.col("quota"), "before")
    return e.where("before < 4096").select("dir", "doc_id", F.least("quota", 4096 - F.col("before")).alias("taken"))


def contains_text(spark, d):
    """Documents with a text in them, whatever its case."""
    return table(spark, d, "documents").where(F.upper("text").contains("TION")).groupBy("lang").agg(F.count("*").alias("n"))


# ---- SQL

TEXT = "(SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents)"
BYTES = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT)"
HEX = "lower(lpad(to_hex({}::UBIGINT), 16, '0'))"
FNV64 = "list_reduce({bytes}, lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT)"
FNV32 = "list_reduce({bytes}, lambda h, b: (xor(h, b) * 16777619::HUGEINT) % 4294967296::HUGEINT, 2166136261::HUGEINT)"
HUGE = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT::HUGEINT)"
MAGIC_SQL = "SELECT doc_id, CASE WHEN octet_length(encode(text)) < 4 THEN -1 WHEN hex(encode(text)[1:4]) <> '5543321A' THEN 0 ELSE 1 END::INT AS identity FROM documents"


GEAR = ", ".join(f"({b}, {int(g) & 255})" for b, g in enumerate(gear_table()))
LAGS = " + ".join(f"coalesce({1 << k} * lag(gv, {k}) OVER w, 0)" for k in range(BITS))


def _cdc() -> str:
    return f"""
WITH RECURSIVE gear(v, gv) AS (VALUES {GEAR}),
t AS MATERIALIZED (SELECT doc_id, source, encode(coalesce(text, '')) AS data, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
b AS MATERIALIZED (SELECT doc_id, unnest(range(n)) AS pos, unnest(list_transform(regexp_extract_all(hex(data), '..'), lambda x: ('0x' || x)::INT)) AS v FROM t WHERE n > 0),
c AS MATERIALIZED (SELECT doc_id, pos FROM (SELECT doc_id, pos, ({LAGS}) % {1 << BITS} AS h FROM b JOIN gear USING (v) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE h = 0),
ends AS MATERIALIZED (SELECT doc_id, list(pos ORDER BY pos) AS ps FROM c GROUP BY doc_id),
r(doc_id, n, ix, st, en, ps) AS (
  SELECT doc_id, n, 0, 0, least(coalesce(list_filter(ps, lambda p: p >= {1 << (BITS - 2)} AND p < least({1 << (BITS + 2)}, n))[1] + 1, {1 << (BITS + 2)}), n), ps FROM t LEFT JOIN ends USING (doc_id) WHERE n > 0
  UNION ALL
  SELECT doc_id, n, ix + 1, en, least(coalesce(list_filter(ps, lambda p: p >= en + {1 << (BITS - 2)} AND p < least(en + {1 << (BITS + 2)}, n))[1] + 1, en + {1 << (BITS + 2)}), n), ps FROM r WHERE en < n),
ch AS MATERIALIZED (SELECT r.doc_id, t.source, ix::BIGINT AS chunk_ix, st::BIGINT AS "offset", (en - st)::BIGINT AS length, hex(data)[(2 * st + 1):(2 * en)] AS body FROM r JOIN t USING (doc_id)),
f AS MATERIALIZED (SELECT *, min((doc_id, chunk_ix)) OVER (PARTITION BY body) = (doc_id, chunk_ix) AS is_new FROM ch)
"""


def _simhash_sql() -> str:
    """Fingerprints of documents: votes of distinct 4-byte shingles by how often they occur, a sum for each bit."""
    h = "14695981039346656037::HUGEINT"
    for v in ("v", "v1", "v2", "v3"):
        h = f"((xor({h}, {v}::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
    bits = " + ".join(f"(CASE WHEN 2 * sum(n) FILTER ((h >> {k}) & 1 = 1) > sum(n) THEN {1 << k}::HUGEINT ELSE 0 END)" for k in range(64))
    return f"""
a AS (SELECT doc_id, {BYTES} AS bs, {HUGE} AS hs FROM {TEXT}),
b AS (SELECT doc_id, generate_subscripts(bs, 1) AS pos, unnest(bs) AS v FROM a),
s AS (SELECT doc_id, v, lead(v, 1) OVER w AS v1, lead(v, 2) OVER w AS v2, lead(v, 3) OVER w AS v3 FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
d AS MATERIALIZED (SELECT doc_id, v, v1, v2, v3, count(*) AS n FROM s WHERE v3 IS NOT NULL GROUP BY ALL),
x AS (SELECT doc_id, {h}::UBIGINT AS h, n FROM d),
fp AS MATERIALIZED (SELECT doc_id, ({bits})::HUGEINT AS fp FROM x GROUP BY doc_id UNION ALL SELECT doc_id, {FNV64.format(bytes='hs')}::HUGEINT FROM a WHERE len(bs) < 4)"""


SIMHASH = _simhash_sql()
CDC = _cdc()
BODY = "list_transform(regexp_extract_all(body, '..'), lambda x: ('0x' || x)::INT::HUGEINT)"
BODY_HASH = HEX.format(FNV64.format(bytes=BODY))
INGEST = "SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (is_new) AS n_new, coalesce(sum(length) FILTER (is_new), 0)::BIGINT AS stored_bytes, coalesce(sum(length) FILTER (NOT is_new), 0)::BIGINT AS saved_bytes"
PART_PATH = "lower(p_brand) || '/' || replace(p_name, ' ', '.')"
LISTING = "(SELECT source || '/' || lang AS path, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) - 1 AS version, octet_length(encode(text))::BIGINT AS size, doc_id FROM documents)"
PARTS = "(SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 97 = 5 THEN p_partkey ELSE p_partkey // 2 END AS master FROM part)"
LENGTHS = "[" + ", ".join(map(str, default_lengths()[:256])) + "]"
HIST = f"(SELECT lang, v AS byte, count(*) AS n FROM (SELECT lang, unnest({BYTES}) AS v FROM {TEXT} WHERE text <> '') GROUP BY ALL)"


def _kind(corpus: str, column: str) -> str:
    text = f"coalesce({column}, '')"
    return f"""SELECT '{corpus}' AS corpus, CASE WHEN n < 4 THEN 0 WHEN h[1:4] = '4D5A' THEN 2 WHEN h[1:8] = '7F454C46' THEN 2
  WHEN len(list_filter(bs, lambda b: (b BETWEEN 32 AND 126) OR b IN (9, 10, 13))) * 100 // len(bs) > 85 THEN 1
  WHEN n >= 64 AND len(list_filter(bs, lambda b: b = 0)) * 100 // len(bs) > 20 THEN 3 ELSE 0 END AS kind
  FROM (SELECT octet_length(encode({text})) AS n, hex(encode({text})) AS h, list_transform(regexp_extract_all(hex(encode({text}))[1:8192], '..'), lambda x: ('0x' || x)::INT) AS bs FROM {corpus})"""


SQL = {
    "checksum_documents": f"""
WITH b AS (SELECT doc_id, generate_subscripts({BYTES}, 1) - 1 AS pos, unnest({BYTES}) AS v FROM {TEXT}),
x AS (SELECT doc_id, bit_xor((v << (8 * (pos % 2))::INT)::BIGINT) AS x FROM b GROUP BY doc_id)
SELECT t.doc_id, octet_length(encode(text))::BIGINT AS size, xor(42330::BIGINT, coalesce(x, 0)) AS csum FROM {TEXT} t LEFT JOIN x USING (doc_id)""",
    "fnv32_documents": f"SELECT doc_id, {FNV32.format(bytes=HUGE)}::BIGINT AS fnv32 FROM {TEXT}",
    "fnv64_documents": f"SELECT doc_id, {HEX.format(FNV64.format(bytes=HUGE))} AS fnv64 FROM {TEXT}",
    "exact_dup_groups": f"""
SELECT {HEX.format(FNV64.format(bytes=HUGE))} AS hash, octet_length(encode(text))::BIGINT AS size, n, first_doc
FROM (SELECT text, count(*) AS n, min(doc_id) AS first_doc FROM {TEXT} GROUP BY text HAVING count(*) > 1)""",
    "content_type": f"SELECT corpus, kind::INT AS kind, count(*) AS n FROM ({_kind('documents', 'text')} UNION ALL {_kind('pages', 'html')}) GROUP BY ALL",
    "magic_identify": MAGIC_SQL,
    "byte_histogram": f"SELECT lang, byte::BIGINT AS byte, n FROM {HIST}",
    "entropy_by_lang": f"""
WITH h AS (SELECT lang, n, sum(n) OVER (PARTITION BY lang) AS total FROM {HIST}),
e AS (SELECT lang, total::BIGINT AS total, -sum(n / total * log2(n / total)) AS bits FROM h GROUP BY ALL)
SELECT lang, total, round(bits, 6) AS bits, ceil(round(bits * total / 8, 3))::BIGINT AS ideal_bytes FROM e""",
    "rans_freq_table": f"""
WITH h AS (SELECT lang, byte::BIGINT AS byte, n, greatest((n * 4096 // (sum(n) OVER (PARTITION BY lang)))::BIGINT, 1) AS f FROM {HIST}),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f DESC, byte) AS rank, sum(f) OVER (PARTITION BY lang) AS s FROM h),
q AS (SELECT *, (f + CASE WHEN rank = 1 THEN 4096 - s ELSE 0 END)::BIGINT AS freq FROM r)
SELECT lang, byte, n, freq, coalesce(sum(freq) OVER (PARTITION BY lang ORDER BY byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cumfreq FROM q""",
    "small_literal_csize": f"""
SELECT conv_id, turn, octet_length(encode(text))::BIGINT AS size, (2 * ceil((coalesce(list_sum(list_transform({BYTES}, lambda b: {LENGTHS}[b + 1])), 0) + 29) / 16))::BIGINT AS csize
FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations) WHERE octet_length(encode(text)) < 256""",
    "delta_filter_bytes": f"""
WITH b AS (SELECT p_partkey AS blob_id, generate_subscripts({BYTES}, 1) - 1 AS pos, unnest({BYTES}) AS v FROM (SELECT p_partkey, p_name AS text FROM part)),
q AS (SELECT blob_id, pos, coalesce((v - lag(v, 2) OVER (PARTITION BY blob_id ORDER BY pos) + 256) % 256, v) AS d FROM b)
SELECT blob_id, sum(d)::BIGINT AS sum_delta, sum((pos + 1) * d)::BIGINT AS weighted, 1::INT AS inverse_ok FROM q GROUP BY blob_id""",
    "delta_checksums": f"""
WITH b AS (SELECT doc_id, generate_subscripts({BYTES}, 1) - 1 AS pos, unnest({BYTES}) AS v FROM {TEXT}),
q AS (SELECT doc_id, pos, coalesce((v - lag(v, 4) OVER (PARTITION BY doc_id ORDER BY pos) + 256) % 256, v) AS d FROM b),
x AS (SELECT doc_id, bit_xor((d << (8 * (pos % 2))::INT)::BIGINT) AS x FROM q GROUP BY doc_id)
SELECT t.doc_id, xor(42330::BIGINT, coalesce(x, 0)) AS csum FROM {TEXT} t LEFT JOIN x USING (doc_id)""",
    "dos_time_roundtrip": """
SELECT event_id, ((year(ts) - 1980) * 33554432 + month(ts) * 2097152 + day(ts) * 65536 + hour(ts) * 2048 + minute(ts) * 32 + second(ts) // 2)::BIGINT AS dos_time,
  strftime(date_trunc('minute', ts) + to_seconds(second(ts) // 2 * 2), '%Y-%m-%d %H:%M:%S') AS back FROM events""",
    "dos_names": f"""
WITH p AS (SELECT p_partkey, upper(string_split({PART_PATH}, '/')[-1]) AS base FROM part),
s AS (SELECT p_partkey, base, CASE WHEN contains(base, '.') THEN regexp_extract(base, '^(.*)\\.[^.]*$', 1) ELSE base END AS stem, CASE WHEN contains(base, '.') THEN regexp_extract(base, '([^.]*)$', 1) ELSE '' END AS ext FROM p)
SELECT p_partkey, rpad(stem[1:8], 8, ' ') || rpad(ext[1:3], 3, ' ') AS dos_name, lower(rtrim(stem[1:8]) || CASE WHEN ext <> '' THEN '.' || rtrim(ext[1:3]) ELSE '' END) AS shown,
  regexp_replace(CASE WHEN contains(base, '.') THEN ext[1:3] ELSE base[1:3] END, '[0-9]', '#', 'g') AS type_key FROM s""",
    "bwt_short": """
WITH r AS (SELECT p_partkey, i, substr(p_name, i::INT + 1) || substr(p_name, 1, i::INT) AS rot FROM (SELECT p_partkey, p_name, unnest(range(length(p_name))) AS i FROM part)),
k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY rot, i) - 1 AS rank FROM r)
SELECT p_partkey, string_agg(right(rot, 1), '' ORDER BY rank) AS last, (max(rank) FILTER (i = 0))::BIGINT AS row FROM k GROUP BY p_partkey""",
    "parity_sectors": f"""
WITH b AS (SELECT doc_id, octet_length(encode(text)) AS n, generate_subscripts({BYTES}, 1) - 1 AS pos, unnest({BYTES}) AS v FROM {TEXT}),
g AS (SELECT *, (n + 511) // 512 AS s, CASE WHEN (n + 511) // 512 < 200 THEN 1 WHEN (n + 511) // 512 < 400 THEN 2 WHEN (n + 511) // 512 < 800 THEN 4 WHEN (n + 511) // 512 < 1600 THEN 8 ELSE 16 END AS k FROM b),
p AS (SELECT doc_id, (pos // 512) % k AS grp, pos % 512 AS place, count(*) AS c, bit_xor(v) AS x FROM g GROUP BY ALL)
SELECT doc_id, grp::BIGINT AS grp, max(c)::BIGINT AS n_sectors, sum(x * (place + 1))::BIGINT AS weight FROM p GROUP BY doc_id, grp""",
    "parity_repair": "SELECT doc_id, true AS repaired FROM documents",
    "cdc_chunks": f'{CDC} SELECT doc_id, chunk_ix, "offset", length FROM ch',
    "chunk_hashes": f"{CDC}, g AS (SELECT body, count(*) AS n, sum(length)::BIGINT AS bytes, min(doc_id) AS first_doc FROM ch GROUP BY body) SELECT {BODY_HASH} AS hash, n, bytes, first_doc FROM g",
    "merkle_root": f"""{CDC},
k AS MATERIALIZED (SELECT DISTINCT body FROM ch),
kh AS MATERIALIZED (SELECT body, {FNV64.format(bytes=BODY)} AS h FROM k),
l AS (SELECT doc_id, count(*) AS n_chunks, sum(length)::BIGINT AS bytes, flatten(list(list_transform(range(8), lambda i: (h // (256::HUGEINT ** i)::HUGEINT) % 256) ORDER BY chunk_ix)) AS bs FROM ch JOIN kh USING (body) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(bytes, 0) AS bytes, CASE WHEN n_chunks IS NULL THEN repeat('0', 16) ELSE {HEX.format(FNV64.format(bytes='list_transform(bs, lambda x: x::HUGEINT)'))} END AS root FROM t LEFT JOIN l USING (doc_id)""",
    "merkle_similarity": f"""{CDC},
k AS (SELECT DISTINCT doc_id - 1 AS doc_id, body, 1 AS hit FROM ch)
SELECT doc_id, count(*) AS n_chunks, count(hit) AS n_common, coalesce(sum(length) FILTER (hit IS NOT NULL), 0)::BIGINT AS common_bytes, round(coalesce(sum(length) FILTER (hit IS NOT NULL), 0) / sum(length), 9) AS similarity
FROM ch LEFT JOIN k USING (doc_id, body) GROUP BY doc_id""",
    "blockstore_ingest": f"{CDC} {INGEST} FROM f GROUP BY doc_id",
    "blockstore_totals": f"{CDC} SELECT count(*) AS n_chunks, count(*) FILTER (is_new) AS n_blocks, sum(length) FILTER (is_new)::BIGINT AS total_bytes, sum(length) FILTER (NOT is_new)::BIGINT AS saved_bytes FROM f",
    "store_delta": f"""{CDC},
odd AS (SELECT doc_id, chunk_ix, length, min((doc_id, chunk_ix)) OVER (PARTITION BY body) = (doc_id, chunk_ix) AND NOT EXISTS (SELECT 1 FROM ch e WHERE e.body = ch.body AND e.doc_id % 2 = 0) AS is_new FROM ch WHERE doc_id % 2 = 1)
{INGEST} FROM odd GROUP BY doc_id""",
    "shared_chunk_files": f"{CDC}, g AS (SELECT body, count(DISTINCT doc_id) AS n_files, min(doc_id) AS first_doc FROM ch GROUP BY body HAVING count(DISTINCT doc_id) >= 2) SELECT {BODY_HASH} AS hash, n_files, first_doc FROM g",
    "source_overlap": f"{CDC}, s AS (SELECT DISTINCT source, body FROM ch) SELECT x.source AS a, y.source AS b, count(*) AS n_common FROM s x JOIN s y USING (body) WHERE x.source < y.source GROUP BY ALL",
    "dedup_by_source": f"""{CDC} SELECT source, count(*) AS chunks, count(*) FILTER (is_new) AS unique_chunks, sum(length)::BIGINT AS total_bytes, coalesce(sum(length) FILTER (NOT is_new), 0)::BIGINT AS saved_bytes,
  round(coalesce(sum(length) FILTER (NOT is_new), 0) / sum(length), 6) AS dedup_ratio FROM f GROUP BY source""",
    "simhash_benchmark": f"""
WITH b AS (SELECT item_id, coalesce(text, '') AS text FROM benchmark), a AS (SELECT item_id, {HUGE} AS bs FROM b),
s AS (SELECT item_id, {FNV64.format(bytes='bs[i:i + 3]')}::UBIGINT AS h FROM (SELECT item_id, bs, unnest(range(1, len(bs) - 2)) AS i FROM a WHERE len(bs) >= 4)),
v AS (SELECT item_id, k, sum(CASE WHEN (h >> k) & 1 = 1 THEN 1 ELSE -1 END) AS votes FROM s, (SELECT unnest(range(64))::UBIGINT AS k) GROUP BY ALL),
x AS (SELECT item_id, sum(CASE WHEN votes > 0 THEN (2::HUGEINT ** k)::HUGEINT ELSE 0 END) AS fp FROM v GROUP BY item_id)
SELECT item_id, {HEX.format('fp')} AS fp FROM x UNION ALL SELECT item_id, {HEX.format(FNV64.format(bytes='bs'))} FROM a WHERE len(bs) < 4""",
    "simhash_documents": f"WITH {SIMHASH} SELECT doc_id, {HEX.format('fp')} AS fp FROM fp",
    "near_dup_classes": f"""WITH {SIMHASH},
c AS MATERIALIZED (SELECT fp, min(doc_id) AS doc_id, count(*) AS n_rows FROM fp GROUP BY fp),
l AS (SELECT p.doc_id, count(*) AS n_links, min(bit_count(xor(p.fp, q.fp)))::BIGINT AS nearest FROM c p JOIN c q ON p.fp <> q.fp AND bit_count(xor(p.fp, q.fp)) <= 6 GROUP BY p.doc_id)
SELECT doc_id, n_rows, coalesce(n_links, 0) AS n_links, nearest FROM c LEFT JOIN l USING (doc_id)""",
    "walk_order": f"""
WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
u AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS path FROM (SELECT string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')))) AS i FROM p)),
e AS (SELECT path, false AS is_dir FROM p UNION ALL SELECT path, true FROM u)
SELECT path, is_dir, row_number() OVER (PARTITION BY CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END ORDER BY is_dir, path) AS place FROM e""",
    "named_versions": f"""SELECT path, version, doc_id FROM {LISTING} WHERE regexp_matches(path, '^src1/[^/]*$') AND version = 1 OR regexp_matches(path, '^src2/e[^/]*$') OR regexp_matches(path, '^src[3-5]/de$') AND version = 0""",
    "archive_totals": f"""SELECT count(DISTINCT split_part(path, '/', 1)) AS dirs, count(DISTINCT path) AS files, count(*) AS revisions, sum(size)::BIGINT AS bytes, (sum(size) FILTER (version = 0))::BIGINT AS newest_bytes, max(version) AS max_version FROM {LISTING}""",
    "kept_revisions": f"SELECT path, size, doc_id, row_number() OVER (PARTITION BY path ORDER BY doc_id DESC) - 1 AS version FROM {LISTING} WHERE version % 3 = 1",
    "master_numbers": """
WITH k AS (SELECT c_custkey AS key, c_custkey // 3 + 1 AS i FROM customer WHERE c_custkey % 3 = 0),
w AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey IS NOT NULL)
SELECT key::BIGINT AS key, i::BIGINT AS index, false AS is_new FROM w JOIN k USING (key)
UNION ALL SELECT key::BIGINT, greatest(2, coalesce((SELECT max(i) FROM k), 1) + 1) + row_number() OVER (ORDER BY key) - 1, true FROM w WHERE key NOT IN (SELECT key FROM k)""",
    "error_names": """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 2 THEN 'Callback fault' WHEN 3 THEN 'Bad state' WHEN 4 THEN 'Damaged archive' WHEN 5 THEN 'Truncated' WHEN 6 THEN 'Unimplemented' WHEN 7 THEN 'Internal error' ELSE 'Error' END AS message FROM orders""",
    "catalog_listing": f"SELECT * FROM {LISTING}",
    "latest_versions": f"SELECT * FROM {LISTING} WHERE version = 0",
    "listing_totals": """
WITH e AS (SELECT source AS dir, lang AS name, doc_id, octet_length(encode(text))::BIGINT AS size FROM documents)
SELECT dir, count(DISTINCT name) AS files, count(*) AS revisions, sum(size)::BIGINT AS bytes, max(size) AS largest, (list(doc_id ORDER BY size DESC, doc_id))[1] AS largest_doc FROM e GROUP BY dir""",
    "glob_select": f"SELECT path, version, doc_id FROM {LISTING} WHERE regexp_matches(path, '^src1[^/]/[^e][^/]*$')",
    "subtree_select": f"SELECT path, count(*) AS n FROM {LISTING} WHERE regexp_matches(path, '^src[2-4](/.*)?$') GROUP BY path",
    "as_of_version": """
SELECT user_id, event_type, event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1""",
    "dir_paths": """
WITH p AS (SELECT string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS parts FROM pages)
SELECT DISTINCT array_to_string(parts[1:i], '/') AS dir, i::BIGINT AS depth FROM (SELECT parts, unnest(range(1, len(parts))) AS i FROM p)""",
    "master_chain": f"""
WITH RECURSIVE m AS MATERIALIZED (SELECT * FROM {PARTS}), up(start, above, path, depth, cyclic) AS (
  SELECT p_partkey, master, [p_partkey], 0, false FROM m
  UNION ALL
  SELECT up.start, m.master, list_append(path, m.p_partkey), depth + 1, list_contains(path, m.p_partkey) FROM up JOIN m ON up.above = m.p_partkey WHERE NOT cyclic)
SELECT start AS p_partkey, max(depth)::BIGINT AS depth, bool_or(cyclic) AS cyclic FROM up GROUP BY start""",
    "running_offsets": """
SELECT source AS dir, doc_id, octet_length(encode(text))::BIGINT AS size, (29 + coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM documents""",
    "chunk_candidates": f"""
WITH gear(v, gv) AS (VALUES {GEAR}),
b AS (SELECT item_id, generate_subscripts({BYTES}, 1) - 1 AS pos, unnest({BYTES}) AS v FROM benchmark)
SELECT item_id, pos::BIGINT AS pos FROM (SELECT item_id, pos, ({LAGS}) % {1 << BITS} AS h FROM b JOIN gear USING (v) WINDOW w AS (PARTITION BY item_id ORDER BY pos)) WHERE h = 0""",
    "candidates_documents": f"""
WITH gear(v, gv) AS (VALUES {GEAR}),
b AS (SELECT doc_id, generate_subscripts({BYTES}, 1) - 1 AS pos, unnest({BYTES}) AS v FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
SELECT doc_id, pos::BIGINT AS pos FROM (SELECT doc_id, pos, ({LAGS.replace("item_id", "doc_id")}) % {1 << BITS} AS h FROM b JOIN gear USING (v) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE h = 0""",
    "parent_join": "SELECT c_custkey, coalesce(n_name, '') AS dir_path, n_name IS NULL AND c_nationkey <> 0 AS lost FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 3) ON c_nationkey = n_nationkey",
    "dir_tree": "SELECT (r_regionkey + 1000)::BIGINT AS id, r_name AS path, 1::BIGINT AS depth FROM region UNION ALL SELECT (n_nationkey + 1)::BIGINT, r_name || '/' || n_name, 2::BIGINT FROM nation JOIN region ON n_regionkey = r_regionkey",
    "listing_lines": """
SELECT o_orderkey, (CASE WHEN a & 32 <> 0 THEN 'a' ELSE '-' END) || (CASE WHEN a & 16 <> 0 THEN 'd' ELSE '-' END) || (CASE WHEN a & 8 <> 0 THEN 'l' ELSE '-' END) || (CASE WHEN a & 4 <> 0 THEN 's' ELSE '-' END)
  || (CASE WHEN a & 2 <> 0 THEN 'h' ELSE '-' END) || (CASE WHEN a & 1 <> 0 THEN 'r' ELSE '-' END) || chr(9) || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || chr(9) || floor(o_totalprice)::BIGINT || chr(9) || 'orders/' || o_orderkey
  || (CASE WHEN o_orderkey % 3 <> 0 THEN chr(9) || (o_orderkey % 3) ELSE '' END) AS line FROM (SELECT *, (o_orderkey % 64)::INT AS a FROM orders)""",
    "freshened": """
WITH e AS (SELECT event_id, user_id || '/' || event_type AS name, ts FROM events), k AS (SELECT name, max(ts) AS mine FROM e WHERE event_id % 2 = 0 GROUP BY name)
SELECT event_id, name FROM e LEFT JOIN k USING (name) WHERE event_id % 2 = 1 AND (mine IS NULL OR ts > mine)""",
    "signatures": f"""
WITH p AS (SELECT p_partkey, p_name AS text, p_size % 12 AS level FROM part),
b AS (SELECT p_partkey, bit_xor(v) & 63 AS bucket, xor(42330::BIGINT, bit_xor((v << (8 * (pos % 2))::INT)::BIGINT)) AS csum FROM (SELECT p_partkey, generate_subscripts({BYTES}, 1) - 1 AS pos, unnest({BYTES}) AS v FROM p) GROUP BY p_partkey)
SELECT p_partkey, bucket::INT AS bucket, xor(xor(length(text), 653762468::BIGINT), csum | (csum << 16)) AS signature,
  CASE level WHEN 2 THEN 'Fast' WHEN 3 THEN 'Normal' WHEN 4 THEN 'Tight' WHEN 5 THEN 'Ultra' WHEN 6 THEN 'rANS Fast' WHEN 7 THEN 'rANS Normal' WHEN 8 THEN 'rANS Tight' WHEN 9 THEN 'rANS Ultra' ELSE 'Tight' END AS level,
  h[1:2] || '/' || h AS store_path FROM (SELECT *, {HEX.format(FNV64.format(bytes=HUGE))} AS h FROM p) JOIN b USING (p_partkey)""",
    "quota_heads": """
WITH e AS (SELECT source AS dir, doc_id, least(octet_length(encode(text)), 512)::BIGINT AS quota FROM documents),
w AS (SELECT *, coalesce(sum(quota) OVER (PARTITION BY dir ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM e)
SELECT dir, doc_id, least(quota, 4096 - before) AS taken FROM w WHERE before < 4096""",
    "contains_text": "SELECT lang, count(*) AS n FROM documents WHERE contains(upper(text), 'TION') GROUP BY lang",
}

QUERIES = {f.__name__: f for f in (
    checksum_documents, fnv32_documents, fnv64_documents, exact_dup_groups, content_type, magic_identify, byte_histogram, entropy_by_lang, rans_freq_table, small_literal_csize,
    delta_filter_bytes, delta_checksums, dos_time_roundtrip, dos_names, bwt_short, parity_sectors, parity_repair, cdc_chunks, chunk_hashes, merkle_root, merkle_similarity, blockstore_ingest,
    blockstore_totals, store_delta, shared_chunk_files, source_overlap, dedup_by_source, simhash_benchmark, simhash_documents, near_dup_classes, master_grouping, catalog_listing,
    latest_versions, listing_totals, glob_select, named_versions, archive_totals, walk_order, kept_revisions, master_numbers, error_names, subtree_select, as_of_version, dir_paths, master_chain, running_offsets, contains_text,
    chunk_candidates, candidates_documents, parent_join, dir_tree, listing_lines, freshened, signatures, quota_heads,
)}
