"""SimHash near-duplicates found by Golay-code fuzzy hashing (operator 6).

A text's fingerprint has 64 bits: XXH64 (seed 42) of each 4-word shingle votes on each bit. Two
fingerprints link if at most 4 bits differ, and links make components.

Candidates. The fingerprint is cut into three segments A (23 bits), B (23 bits) and C (18 bits, padded with
zeros). The binary Golay code [23,12,7] is perfect: each 23-bit word decodes to the one codeword within 3
bits. A segment's keys are the codewords within 4 bits of it: one, or six if the nearest is 3 bits away.
Segments that differ in at most 2 bits share a key (take the word half way: its codeword is within 4
bits of both). With at most 4 differing bits over three segments one of these holds:
  (i)  some segment is equal, and of the other two one differs in at most 2 bits: keys (equal segment's
       bits, a Golay key of the other), 6 ordered pairs of segments;
  (ii) no segment is equal, so A and B each differ in 1 or 2 bits: keys (a Golay key of A, one of B).
A join on these keys finds every pair; the join's condition verifies the distance, so that only links
leave it. Equal fingerprints are one row before the join, so copies never meet in pairs. Keys have 24 to
35 bits and a fingerprint about 60 of them, whatever the data.

Components: alternating large-star and small-star passes over a table of links, each written to the
shared folder, until nothing changes; the table never grows and nothing is collected but its size and a
checksum. Roots of many nodes and fingerprints of many copies are joined apart from the others, so that no
key is one task's burden.

Cases: null or empty texts and those without a word have fingerprint 0, linked like any other; fewer than 4
words make one shingle; null ids keep a row and never lower a component id (a component of null ids only
has a null id); repeated rows share a component; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_declared, bounded_join, drop_tables, encoded, materialise, skewed_join, table, written

WORDS, SEED, DISTANCE = 4, 42, 4
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Small tables are written in one file for each so many rows of a bound that was counted.
FILE_ROWS = 5000
#: Fixed value: a generator polynomial of the binary Golay code of length 23.
GENERATOR = 0xC75


def fingerprint(text: str | None) -> int:
    w = encoded(text).lower().split()
    if not w:
        return 0
    grams = [b" ".join(g) for g in zip(*[w[i:] for i in range(WORDS)])] if len(w) >= WORDS else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(g, SEED) for g in grams], np.uint64, len(grams))
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        votes += np.unpackbits(h[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(h)).tobytes(), "big")


@F.arrow_udf(T.LongType())
def fingerprints(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in text.to_pylist()], np.uint64).view(np.int64), pa.int64())


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Of each 23-bit word's syndrome: the error of least weight, and the errors of weight at most 4 (-1: none)."""
    syndrome = np.zeros(23, np.int64)
    for i in range(23):
        r = 1 << i
        for b in range(22, 10, -1):
            if r >> b & 1:
                r ^= GENERATOR << (b - 11)
        syndrome[i] = r
    near: list[list[int]] = [[] for _ in range(2048)]
    from itertools import combinations

    for size in range(5):
        for bits in combinations(range(23), size):
            s = 0
            for b in bits:
                s ^= int(syndrome[b])
            near[s].append(sum(1 << b for b in bits))
    keys = np.full((2048, 6), -1, np.int64)
    for s, errors in enumerate(near):  # the lightest first; only words 3 bits from their codeword have more
        keys[s, : len(errors)] = errors
    return syndrome, keys


def golay_keys(word: np.ndarray) -> np.ndarray:
    """Codewords within 4 bits of each 23-bit word, as their 12 information bits; -1 where there are fewer than six."""
    syndrome, errors = golay()
    s = np.zeros(len(word), np.int64)
    for b in range(23):
        s ^= np.where(word >> b & 1, syndrome[b], 0)
    e = errors[s]
    return np.where(e >= 0, (word[:, None] ^ e) >> 11, -1)


def pair_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of fingerprints: kind, then the equal segment's bits or a Golay key, then a Golay key."""
    u = fp.view(np.uint64)
    seg = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    codes = [golay_keys(s) for s in seg]
    rows, keys = [], []
    kind = 0
    for x in range(3):
        for y in range(3):
            if x != y:
                c = codes[y]
                rows.append(np.broadcast_to(np.arange(len(fp))[:, None], c.shape)[c >= 0])
                keys.append(((np.int64(kind) << 40) | (seg[x][:, None] << 12) | c)[c >= 0])
                kind += 1
    a, b = codes[0][:, :, None], codes[1][:, None, :]
    ok = (a >= 0) & (b >= 0)
    rows.append(np.broadcast_to(np.arange(len(fp))[:, None, None], ok.shape)[ok])
    keys.append(((np.int64(kind) << 40) | (a << 12) | b)[ok])
    return np.concatenate(rows), np.concatenate(keys)


def first_kind(x: Column) -> Column:
    """Of the kinds of keys that a pair with difference x is sure to share, the first: only that one reports the pair."""
    errors = [F.bit_count(x.bitwiseAND(F.lit((((1 << n) - 1) << at) - (1 << 64 if at + n == 64 else 0)))) for at, n in SEGMENTS]
    ordered = [(a, b) for a in range(3) for b in range(3) if a != b]
    return F.coalesce(*[F.when((errors[a] == 0) & (errors[b] <= 2), F.lit(k)) for k, (a, b) in enumerate(ordered)], F.lit(len(ordered)))


def exploded(batches):
    for batch in batches:
        fp = np.asarray(batch.column(0))
        for i in range(0, len(fp), 4096):
            part = fp[i : i + 4096]
            row, key = pair_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(part[row], pa.int64())], ["key", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """Each pair (u, v), u < v, of different fingerprints at most DISTANCE bits apart. fps: distinct column fp."""
    first = written()
    keyed = fps.mapInArrow(exploded, T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())]))
    keyed = materialise(keyed, "golay-keys")
    a, b = keyed.select("key", F.col("fp").alias("u")), keyed.select("key", F.col("fp").alias("v"))
    x = F.col("u").bitwiseXOR(F.col("v"))
    found = a.join(b, "key").where((F.col("u") < F.col("v")) & (F.bit_count(x) <= DISTANCE) & (F.shiftright("key", 40) == first_kind(x)))
    found = materialise(found.select("u", "v").distinct(), "links")
    drop_tables(fps.sparkSession, first, -1)
    return found


def few_files(df: DataFrame, most: int) -> DataFrame:
    """df, of at most `most` rows, in partitions of about FILE_ROWS rows, if it has more partitions: a file for each
    partition of a shuffle would be thousands of files with a few rows, each with the buffers of its writer."""
    return df.coalesce(max(1, -(-most // FILE_ROWS)))


def components(pairs: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of the links (u, v), u != v."""
    spark, kind, first = pairs.sparkSession, pairs.schema["u"].dataType, written()
    edges = few_files(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), pairs.count())
    edges = materialise(edges, "star")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, after = None, state(edges)
    while after[0] and after != before:
        most = 2 * after[0]  # of rows of each table of this round
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.sum((F.col("v") > F.col("u")).cast("long")).alias("n"))
        low = materialise(few_files(low, most), "low")
        large = skewed_join(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialise(few_files(large, most), "large-star")
        low = materialise(few_files(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), most), "low")
        small = skewed_join(large, low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialise(few_files(small.select("e.*").where("u != v").distinct(), most), "star")
        drop_tables(spark, first, -1)
        before, after = after, state(edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).select(F.col("node").cast(kind), F.col("root").cast(kind))


def rooted(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (fp, best, n) from rows with column fp: the least struct of the columns `order` and the number of rows;
    and, for the fingerprints with a link, node, root and best."""
    nodes = few_files(rows.groupBy("fp").agg(F.min(F.struct(*order)).alias("best"), F.count("*").alias("n")), rows.count())
    nodes = materialise(nodes, "nodes")
    roots = components(links(nodes.select("fp")))
    found = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "best")
    return nodes, materialise(few_files(found, nodes.count()), "rooted")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of each row of docs. Equal fingerprints are one node; links join nodes."""
    rows = docs.select("doc_id", fingerprints(F.col("text").cast("string")).alias("fp")).withColumn("none", F.col("doc_id").isNull())
    rows = materialise(rows, "fingerprints")
    nodes, linked = rooted(rows, "none", "doc_id")
    most = nodes.count()
    least = materialise(few_files(linked.groupBy("root").agg(F.min("best").alias("least")), most), "least")
    named = bounded_join(linked.select("fp", "root"), least, ["root"]).select("fp", "least")
    named = nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("least", "best")["doc_id"].alias("component_id"))
    named = materialise(few_files(named, most), "named")
    return skewed_join(rows.select("doc_id", "fp"), named, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the row of the least id (null ids last); of equal ids that of the least
    hash of its text, and of equal rows the first. Rows are told apart by a number of their own, not by doc_id."""
    rows = docs.withColumn("__fp", fingerprints(F.col("text").cast("string"))).withColumn("__row", F.monotonically_increasing_id())
    rows = materialise(rows, "fingerprinted")
    order = [F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h"), F.col("__row").alias("row")]
    nodes, linked = rooted(rows.select(F.col("__fp").alias("fp"), *order), "none", "doc_id", "h", "row")
    alone = nodes.join(linked.select("fp"), "fp", "left_anti").select("best.row")
    first = linked.groupBy("root").agg(F.min("best").alias("best")).select("best.row")
    return as_declared(rows.join(alone.union(first), F.col("__row") == F.col("row"), "left_semi"), docs.schema)
