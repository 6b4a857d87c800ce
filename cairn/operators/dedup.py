"""Chunks, chunk lists with root hashes, overlap, the block store, grouping and near duplicates."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import cdc_chunks, digest_list, fnv64, simhash64
from .lineage import written

BITS = 8
#: A chunk counts as shared only among files of at least this size.
MIN_FILE = 1024
MAX_MASTER = 65_535


def blobs(df: DataFrame, key: str, value: str, *keep: str) -> DataFrame:
    """blob_id and the UTF-8 bytes of a column; null is empty."""
    return df.select(F.col(key).alias("blob_id"), F.encode(F.coalesce(F.col(value), F.lit("")), "UTF-8").alias("content"), *keep)


def chunked(df: DataFrame, bits: int = BITS, compat: bool = False, weak: bool = False, **limits) -> DataFrame:
    """A row for each chunk of column content: chunk_ix, offset, length, hash64, hash32. The content goes no further."""
    others = [c for c in df.columns if c != "content"]
    parts = df.select(*others, cdc_chunks(bits, compat=compat, weak=weak, **limits)("content").alias("__chunks"))
    return parts.select(*others, F.posexplode("__chunks").alias("chunk_ix", "c")).select(*others, F.col("chunk_ix").cast("long"), "c.*")


def chunk_data(df: DataFrame, bits: int = BITS, **limits) -> DataFrame:
    """Chunks with their bytes (blob_id, chunk_ix, hash64, length, data); the content is cut before rows are made."""
    lists = df.select("blob_id", "content", cdc_chunks(bits, weak=False, **limits)("content").alias("__chunks"))
    cut = F.transform("__chunks", lambda c: F.struct(c["hash64"].alias("hash64"), c["length"].alias("length"), F.substring(F.col("content"), c["offset"].cast("int") + 1, c["length"].cast("int")).alias("data")))
    return lists.select("blob_id", F.posexplode(cut).alias("chunk_ix", "c")).select("blob_id", F.col("chunk_ix").cast("long"), "c.*")


def merkle(df: DataFrame, bits: int = BITS, compat: bool = False, **limits) -> DataFrame:
    """A row for each blob: its number of chunks, bytes covered and root hash. No shuffle: the list stays in its row."""
    others = [c for c in df.columns if c != "content"]
    lists = df.select(*others, cdc_chunks(bits, compat=compat, weak=False, **limits)("content").alias("c"))
    return lists.select(*others, F.size("c").cast("long").alias("n_chunks"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("bytes"), digest_list(F.transform("c", lambda x: x["hash64"])).alias("root"))


def common_chunks(a: DataFrame, b: DataFrame, key_a: str, key_b: str, pair: str) -> DataFrame:
    """For each pair of blobs: chunks of a, those whose hash is in b (each of a's counts), their bytes, the byte-weighted overlap.

    a and b hold one chunk list for each value of `pair`; 0.0 where a has no bytes."""
    there = b.select(pair, "hash64").distinct().withColumn("__hit", F.lit(1))
    joined = a.join(there, [pair, "hash64"], "left")
    hit = F.col("__hit").isNotNull()
    return joined.groupBy(pair).agg(
        F.count("*").alias("n_chunks"), F.sum(hit.cast("long")).alias("n_common"), F.sum(F.when(hit, F.col("length")).otherwise(0)).alias("common_bytes"),
        F.coalesce(F.sum(F.when(hit, F.col("length")).otherwise(0)) / F.nullif(F.sum("length"), F.lit(0)), F.lit(0.0)).alias("similarity"))


def first_places(chunks: DataFrame, *order: str, keep: tuple[str, ...] = (), store: DataFrame | None = None) -> DataFrame:
    """For each hash that the store lacks the order columns of its first chunk, and the columns `keep`. A partial
    aggregation, so that a hash that a third of all files share sends a row for each task."""
    first = chunks.groupBy("hash64").agg(F.min(F.struct(*order, *keep)).alias("__first"))
    if store is not None:
        first = first.join(store.select("hash64").distinct(), "hash64", "left_anti")
    return first.select("__first.*")


def first_seen(chunks: DataFrame, *order: str, store: DataFrame | None = None) -> DataFrame:
    """Chunks with is_new: whether the hash comes first here in ingest order and is not in the store.

    First places are joined back by place (the order columns, which name a chunk), not by hash.
    """
    marks = first_places(chunks, *order, store=store).withColumn("is_new", F.lit(True))
    return chunks.join(marks, list(order), "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def new_and_known(chunks: DataFrame, group: str, store: DataFrame | None = None) -> DataFrame:
    """For each value of `group`: chunks, those that are new in order of blob_id, bytes, and bytes of the new ones.

    Totals and first places are added up apart, so that chunks meet by hash only and never by place. chunks is
    read twice: a written table."""
    others = [c for c in ("length", group) if c != "blob_id"]
    new = first_places(chunks, "blob_id", "chunk_ix", keep=tuple(others), store=store).groupBy(group).agg(F.count("*").alias("n_new"), F.sum("length").alias("stored_bytes"))
    total = chunks.groupBy(group).agg(F.count("*").alias("n_chunks"), F.sum("length").alias("bytes"))
    joined = total.withColumnRenamed(group, "__group").join(new, F.col("__group").eqNullSafe(F.col(group)), "left")
    return joined.select(F.col("__group").alias(group), "n_chunks", "bytes", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_new", "stored_bytes")])


def ingested(chunks: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """A row for each blob, as ingested in order of blob_id into a store of hashes: chunks, new ones, bytes stored and saved."""
    return new_and_known(chunks, "blob_id", store).select("blob_id", "n_chunks", "n_new", "stored_bytes", (F.col("bytes") - F.col("stored_bytes")).alias("saved_bytes"))


def shared(chunks: DataFrame, key: str = "hash64") -> DataFrame:
    """Chunk hashes found in two blobs or more: number of blobs and the first of them."""
    return chunks.select(key, "blob_id").distinct().groupBy(key).agg(F.count("*").alias("n_files"), F.min("blob_id").alias("first_blob")).where("n_files >= 2")


def settled(rows: list[tuple]) -> list[tuple]:
    """(blob_id, place) by the greedy rule itself, hash after hash. rows: (place, blob_id), a place for each hash."""
    holders: dict[tuple, list] = {}
    for place, blob in rows:
        holders.setdefault(tuple(place), []).append(blob)
    out, taken = [], set()
    for place in sorted(holders):
        members = [b for b in holders[place] if b not in taken]
        if len(members) >= 2:
            taken.update(members)
            out += [(b, place) for b in members]
    return out


def grouped(files: DataFrame, bits: int = 12, materialise=lambda df: df, rounds: int = 8, few: int = 300_000) -> DataFrame:
    """blob_id, size and the group of each file: which files share a dictionary.

    The rule is greedy: hashes are visited in the order of their first chunk; the files still free that
    have the hash form a group if they are two or more. Here it runs in rounds of aggregations: a hash is
    due when none of its free files has an earlier hash that could still take it, and all hashes that are due
    form their groups at once, with the same outcome. Long chains of files, each sharing chunks with the next only,
    would take a round for every two files: after `rounds` rounds, as soon as at most `few` rows (hash, file) are left,
    these are settled in order by the driver; until then rounds go on, however many. Files without a group
    share the default dictionary (null place). There is no cap on the files of a group.
    """
    sized = files.select("blob_id", F.length("content").cast("long").alias("size"))
    parts = chunked(files.where(F.length("content") >= MIN_FILE).select("blob_id", "content"), bits, weak=True)
    parts = materialise(parts.groupBy("hash32", "blob_id").agg(F.min("chunk_ix").alias("chunk_ix")))
    places = parts.groupBy("hash32").agg(F.min(F.struct("blob_id", "chunk_ix")).alias("place"), F.count("*").alias("n")).where("n >= 2").drop("n")
    free = materialise(parts.drop("chunk_ix").join(places, "hash32"))
    done, ran = None, 0
    while True:
        live = free.groupBy("hash32").agg(F.count("*").alias("n")).where("n >= 2").drop("n")
        member = materialise(free.join(live, "hash32"))
        left = member.count()
        if not left:
            break
        if ran >= rounds and left <= few:
            won = settled([(r.place, r.blob_id) for r in member.select("place", "blob_id").collect()])
            last = member.sparkSession.createDataFrame(won, member.select("blob_id", "place").schema)
            done = last if done is None else done.unionByName(last)
            break
        best = member.groupBy("blob_id").agg(F.min("place").alias("best"))
        due = member.join(best, "blob_id").groupBy("hash32").agg(F.min((F.col("place") == F.col("best")).cast("int")).alias("due")).where("due = 1").drop("due")
        won = materialise(member.join(due, "hash32").select("blob_id", "place"))
        done = won if done is None else done.unionByName(won)
        free = materialise(member.join(won.select("blob_id"), "blob_id", "left_anti"))
        ran += 1
    if done is None:
        return sized.withColumn("place", F.lit(None).cast("struct<blob_id:bigint,chunk_ix:bigint>"))
    return sized.join(done, "blob_id", "left")


def masters(assigned: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each dictionary: its index (2, 3, ... in order of the groups, the default last), the largest file
    (the first of equals) and its head as content, the files' number and bytes, and the head's 32-bit hash as key."""
    from ..functions.arrays import fnv32

    stats = assigned.groupBy("place").agg(F.sum("size").alias("ref_len"), F.count("*").alias("ref_ctr"), F.max_by("blob_id", F.struct("size", -F.col("blob_id"))).alias("largest"))
    stats = written(stats.withColumn("part", F.coalesce(F.col("place.blob_id"), F.lit(2**63 - 1))))
    # Numbers by ranges: each range numbers its own groups, and a row for each range is summed up.
    bounds = sorted(set(stats.agg(F.percentile_approx("part", [i / 64 for i in range(1, 64)], 1000)).first()[0] or []))
    stats = stats.withColumn("part", sum(((F.col("part") >= b).cast("int") for b in bounds), F.lit(0)))
    above = stats.groupBy("part").agg(F.count("*").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("place").asc_nulls_last()))
    numbered = stats.withColumn("own", own).join(F.broadcast(above.select("part", "above")), "part").withColumn("master", (F.col("own") + F.col("above") + 1).cast("int"))
    heads = files.select(F.col("blob_id").alias("largest"), F.substring("content", 1, MAX_MASTER).alias("head"))
    return numbered.join(heads, "largest").select("master", "largest", "ref_len", "ref_ctr", F.length("head").cast("long").alias("head_size"), fnv32("head").alias("key"))


def fingerprints(df: DataFrame) -> DataFrame:
    return df.select("blob_id", simhash64("content").alias("fp"))


def near_pairs(fps: DataFrame, within: int = 6, key: str = "blob_id", spare: int = 2) -> DataFrame:
    """Pairs of fingerprint classes at most `within` bits apart: of within + spare parts of the 64 bits at least `spare`
    agree, so each choice of `spare` parts is a key; verified in the join.

    fps: fp and id. Equal fingerprints are one class (named by its least id) before keys are made."""
    classes = fps.groupBy("fp").agg(F.min(key).alias("rep"))
    parts = within + spare
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(parts)]
    chosen = [sum(m) for m in combinations(masks, spare)]
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    keyed = classes.select("rep", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(signed(m)) for m in chosen])).alias("choice", "bits"))
    a, b = keyed, keyed.select("choice", "bits", F.col("rep").alias("rep_b"), F.col("fp").alias("fp_b"))
    x = F.col("fp").bitwiseXOR(F.col("fp_b"))
    first = F.coalesce(*[F.when(x.bitwiseAND(signed(m)) == 0, F.lit(i)) for i, m in enumerate(chosen)])
    joined = a.join(b, ["choice", "bits"]).where((F.col("rep") < F.col("rep_b")) & (F.bit_count(x) <= within) & (F.col("choice") == first))
    return joined.select(F.col("rep").alias("a"), F.col("rep_b").alias("b"), F.bit_count(x).cast("long").alias("distance"))


#: Fingerprints of a block in near_classes, and the most blocks; with more fingerprints blocks grow.
BLOCK, MOST_BLOCKS = 32_768, 64


def links_between(a: np.ndarray, b: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of the distinct fingerprints a, then of b, the number of the others at most `within` bits away and the least
    distance (255 at most). a and b may be the same; a fingerprint is no link of itself."""
    n_a, n_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    near_a, near_b = np.full(len(a), 255, np.uint8), np.full(len(b), 255, np.uint8)
    for i in range(0, len(a), 64):
        for j in range(0, len(b), 4096):
            d = np.bitwise_count(a[i : i + 64, None] ^ b[None, j : j + 4096])
            if a is b:
                d[d == 0] = 255
            at = np.flatnonzero(d <= within)
            row, column = np.divmod(at, d.shape[1])
            n_a[i : i + 64] += np.bincount(row, minlength=d.shape[0])
            n_b[j : j + 4096] += np.bincount(column, minlength=d.shape[1])
            np.minimum(near_a[i : i + 64], d.min(axis=1), out=near_a[i : i + 64])
            np.minimum(near_b[j : j + 4096], d.min(axis=0), out=near_b[j : j + 4096])
    return n_a, near_a, n_b, near_b


def near_classes(fps: DataFrame, within: int = 6, key: str = "blob_id") -> DataFrame:
    """A row for each class of equal fingerprints: its least id, its rows, the number of other classes at most `within`
    bits apart and the least distance (null without one).

    Fingerprints are dealt to blocks, and each pair of blocks is compared by one task, fingerprint by fingerprint: where texts
    lie close together keys of equal bits leave half of all pairs to verify. No pair becomes a row: a task gives
    a row for each fingerprint that has links there."""
    classes = written(fps.groupBy("fp").agg(F.min(key).alias("rep"), F.count("*").alias("n_rows")))
    blocks = min(MOST_BLOCKS, -(-classes.count() // BLOCK) or 1)

    def run(t: pa.Table) -> pa.Table:
        fp, block = np.asarray(t["fp"].combine_chunks()).view(np.uint64), np.asarray(t["block"].combine_chunks())
        a = fp[block == block.min()]
        b = fp[block == block.max()] if block.min() < block.max() else a
        n_a, near_a, n_b, near_b = links_between(a, b, within)
        both = [(a, n_a, near_a)] if a is b else [(a, n_a, near_a), (b, n_b, near_b)]
        f, n, near = (np.concatenate(x) for x in zip(*both))
        return pa.table({"fp": f[n > 0].view(np.int64), "n_links": n[n > 0], "nearest": near[n > 0].astype(np.int64)})

    one, other = F.col("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    dealt = classes.select("fp", F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int").alias("block")).select("fp", "block", other)
    tiles = dealt.select("fp", "block", (F.least(one, "other") * blocks + F.greatest(one, "other")).alias("tile"))
    found = tiles.repartition(blocks * (blocks + 1) // 2, "tile").groupBy("tile").applyInArrow(run, "fp long, n_links long, nearest long")
    linked = found.groupBy("fp").agg(F.sum("n_links").alias("n_links"), F.min("nearest").alias("nearest"))
    return classes.join(linked, "fp", "left").select("rep", "n_rows", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "nearest")


def root_order(df: DataFrame) -> DataFrame:
    """Ordered chunk lists from a table of chunks: the root by an ordered aggregate, for lists that are stored as rows."""
    ordered = df.groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("chunk_ix", "hash64"))).alias("l"))
    return ordered.select("blob_id", digest_list(F.transform("l", lambda x: x["hash64"])).alias("root"))


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Groups of equal content, by length and SHA-256; named by their 64-bit hash."""
    keyed = df.select("blob_id", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"), fnv64("content").alias("h"))
    return keyed.groupBy("digest", "size").agg(F.min("h").alias("h"), F.count("*").alias("n"), F.min("blob_id").alias("first_blob")).where("n > 1")
