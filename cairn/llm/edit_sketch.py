"""Document fingerprints by a randomised edit embedding (operator 8).

A shared random walk embeds each text: it stays at character c of the text for a random number of
steps that only c's class and the step decide, and writes c once a step. Texts at a small edit distance
fall back into step after an edit, so their embedded strings have a small Hamming distance. Bit sampling
then takes bands of that string: every octave [2**k, 2**(k+1)) of steps has BANDS bands of three places
(low octaves: of one) at fixed random steps, and each band's characters are hashed to a byte (0: beyond the text's end).

The fingerprint is a count of octaves and those bytes as hex; equal texts have equal fingerprints. The
likeness of two fingerprints (0 to 1) is the share of embedded steps whose bands agree, each octave
weighted by the steps it stands for.

Search (`near_documents`): equal fingerprints are one class; classes that share a whole band row (`band_keys`) that is
not beyond both ends are compared by the likeness of their whole fingerprints. A row that many classes
share is split into tiles, and each pair of tiles is one small group, so that all pairs are compared and no
task has a hot row. A pair is reported once, in its first shared row. Pairs that share no row are not found. The
result is a row for each document, with its class and the number of classes linked to it (`near_pairs` lists the links).

The next document in ascending id comes without one window over all rows: ids alone give the bounds of
ranges, each range's first document is also sent to the range before it, and each task reads its ranges in
order. Only one shuffle moves texts.

Cases: a null or empty text has the fingerprint of no octaves, and two of these are alike (1.0); rows
of equal id are ordered by text; null ids come first; the only row is its own next; very long texts are
walked whole; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, skewed_join, table

SENT = T.ArrayType(T.StructType([T.StructField("r", T.IntegerType()), T.StructField("guest", T.IntegerType())]))
SEED, CLASSES, PERIOD = 11, 128, 4096
LAST, BANDS = 40, 32  # octaves 2**0 to 2**LAST
#: The least likeness of a link.
LEAST = 0.5

FIELDS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


@cache
def walk_table() -> list[list[int]]:
    """For each class of characters and step from 0 to 2 * PERIOD, where the walk goes on after it has left the
    character: that step, counted from the last multiple of PERIOD at or below the first, so from 1 to 2 * PERIOD."""
    moves = np.random.default_rng(SEED).random((CLASSES, 2 * PERIOD)) < 0.5
    moves[:, PERIOD:] = moves[:, :PERIOD]
    out = []
    for row in moves:
        at = np.flatnonzero(row)
        row = at[np.searchsorted(at, np.arange(PERIOD))] + 1
        out.append([*row.tolist(), *row.tolist(), int(row[0])])
    return out


@cache
def places(octave: int) -> np.ndarray:
    """Steps of each band of an octave, BANDS x 3."""
    rng = np.random.default_rng((SEED, octave))
    start = (1 << octave) + np.sort(rng.integers(0, 1 << octave, BANDS))
    return start[:, None] + (np.array([0, 5, 11]) if octave > 5 else np.zeros(3, np.int64))


def walk(codes: np.ndarray, start: int = 0) -> np.ndarray:
    """For each character the step at which the walk leaves it (its first step is where the one before was left)."""
    rows = map(walk_table().__getitem__, (codes % CLASSES).tolist())
    left = np.fromiter(accumulate(rows, lambda j, row: row[j], initial=start % PERIOD), np.int64, len(codes) + 1)
    return start + np.cumsum(left[1:] - left[:-1] % PERIOD)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def banded(codes: np.ndarray, left: np.ndarray) -> str:
    """The fingerprint of characters and the steps at which the walk left them."""
    if not len(left):
        return "00"
    end, out, octave = int(left[-1]), [], 0
    while 1 << octave < end and octave <= LAST:
        p = places(octave)
        char = codes[np.minimum(np.searchsorted(left, p, side="right"), len(codes) - 1)].astype(np.uint64)
        mix = (char[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (char[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7)) ^ (char[:, 2] * np.uint64(0x165667B19E3779F9) << np.uint64(3))
        mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (mix >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
        out.append(np.where(p[:, 2] < end, h, 0).astype(np.uint8))
        octave += 1
    if not out:  # shorter than the first octave: the characters themselves
        return "00" + hashlib.blake2b(codes.tobytes(), digest_size=8).hexdigest()
    return f"{len(out):02x}" + np.concatenate(out).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The weighted share of bands that agree, of the bands that either text has."""
    if a == b:
        return 1.0
    if a[:2] == "00" or b[:2] == "00":
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(s[2:]), np.uint8).reshape(-1, BANDS) for s in (a, b))
    n = max(len(x), len(y))
    x, y = (np.vstack([v, np.zeros((n - len(v), BANDS), np.uint8)]) for v in (x, y))
    weight = (2.0 ** np.arange(n))[:, None] * ((x > 0) | (y > 0))
    return float((weight * (x == y)).sum() / max(weight.sum(), 1e-300))


def fingerprint(text: str | None) -> str:
    codes = codes_of(text or "")
    return banded(codes, walk(codes))


def band_keys(fp: str, rows: int = 4) -> list[str]:
    """Keys for a candidate join: `rows` bands in a row of the two highest octaves, with their place."""
    n = int(fp[:2], 16)
    size = 2 * BANDS
    return [f"{k}:{i}:{fp[2 + k * size + 2 * i : 2 + k * size + 2 * (i + rows)]}" for k in range(max(0, n - 2), n) for i in range(0, BANDS, rows)] or [fp]


def search_keys(fp: str) -> list[str]:
    """The band keys that say something: those of rows that are not wholly beyond the text's end. Texts
    of no octave are like their equals only, so they have none."""
    return [] if fp[:2] == "00" else [k for k in band_keys(fp) if k.rsplit(":", 1)[1].strip("0")]


class Walked:
    """A document with its walk and fingerprint."""

    __slots__ = ("doc", "text", "codes", "left", "fp")

    def __init__(self, doc: int | None, text: str):
        self.doc, self.text, self.codes = doc, text, codes_of(text)
        self.left = walk(self.codes)
        self.fp = banded(self.codes, self.left)

    def edited(self, following: str) -> tuple[str, str]:
        """The edited text and its fingerprint; the walk over the part that stays is not made again."""
        n = len(self.text)
        keep = n - n // 4
        text = self.text[:keep] + following[: n // 4]
        if text == self.text:
            return text, self.fp
        tail = codes_of(text[keep:])
        left = self.left[:keep]
        left = np.concatenate([left, walk(tail, int(left[-1]) if keep else 0)])
        return text, banded(np.concatenate([self.codes[:keep], tail]), left)

    def row(self, following: "Walked") -> tuple:
        text, fp = self.edited(following.text)
        sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        return self.doc, len(self.text), sha, self.fp, fp, likeness(self.fp, fp), likeness(self.fp, following.fp)


def ranges(ids: DataFrame, parts: int) -> tuple[list[int], dict[int | None, int]]:
    """Bounds of ranges of ids (an id's range is the number of bounds at or below it), and for the least id of each
    range the range before it that has rows; the last one for the least of all. From ids alone, parts numbers."""
    at = [i / parts for i in range(1, parts)] or [0.5]
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", at, 10_000)).first()[0] or []))
    found = ids.groupBy(ranged(bounds, {})("doc_id")[0]["r"].alias("r")).agg(F.min("doc_id").alias("m"), F.max(F.col("doc_id").isNull()).alias("null")).orderBy("r").collect()
    return bounds, {None if x["null"] else x.m: found[i - 1].r for i, x in enumerate(found)}


def ranged(bounds: list[int], guests: dict[int | None, int]):
    """Where an id's rows go: to its range, and as a guest to the range before if it is the least of its own."""
    sorted_bounds = np.array(bounds, np.int64)

    @F.arrow_udf(SENT)
    def to(ids: pa.Array) -> pa.Array:
        null = np.asarray(ids.is_null())
        r = np.where(null, 0, np.searchsorted(sorted_bounds, np.asarray(ids.fill_null(0)), side="right"))
        known = ids.to_pylist()
        return pa.array([[(int(a), 0), (guests[i], 1)] if i in guests else [(int(a), 0)] for a, i in zip(r, known)], pa.list_(pa.struct([("r", pa.int32()), ("guest", pa.int32())])))

    return to


def with_next(batches):
    """Rows (range, guest, doc_id, text) in order; the first guest is the document after the range's last."""
    types = {T.LongType: pa.int64(), T.StringType: pa.string(), T.DoubleType: pa.float64()}
    rows = pa.schema([(f.name, types[type(f.dataType)]) for f in FIELDS])
    made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), rows)], schema=rows)
    before, out = None, []
    for batch in batches:
        for r, guest, doc, text in zip(*[c.to_pylist() for c in batch.columns]):
            if guest and (not before or before[0] != r):
                continue  # of guests only the first counts
            now = Walked(doc, text)
            if before and before[0] == r:
                out.append(before[1].row(now))
            before = None if guest else (r, now)
            if len(out) >= 500:
                yield made(out)
                out = []
    if out:
        yield made(out)


def edit_sketches(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """A row for each document: its fingerprint, that of the edited text, and their likeness."""
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    to = ranged(*ranges(rows.select("doc_id"), parts))
    sent = rows.withColumn("__to", F.explode(to("doc_id"))).select("__to.r", "__to.guest", "doc_id", "text")
    return sent.repartition(parts, "r").sortWithinPartitions("r", "guest", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(with_next, FIELDS)


@F.arrow_udf(T.StringType())
def fingerprints(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def keys_of(fp: pa.Array) -> pa.Array:
    return pa.array([search_keys(x) for x in fp.to_pylist()], pa.list_(pa.string()))


PAIRS = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("likeness", T.DoubleType())])
ROWS = 4  # bands in a row of a key


def like_pairs(key: str, cross: bool, members: list[tuple], least: float):
    """(a, b, likeness) of the members (tile, node, fp) of one row or pair of tiles whose first shared row is this one."""
    octave, at = map(int, key.split(":")[:2])
    members.sort(key=lambda x: x[1])
    n = np.array([int(m[2][:2], 16) for m in members])
    grid = np.zeros((len(members), n.max(), BANDS), np.uint8)
    for i, m in enumerate(members):
        grid[i, : n[i]] = np.frombuffer(bytes.fromhex(m[2][2:]), np.uint8).reshape(-1, BANDS)
    # Rows before this one that are keys of a member (of its two highest octaves and not all zero); 0: none.
    before = [np.where(n <= k + 2, grid[:, k].copy().view("<u4")[:, i], 0) for k in range(max(0, octave - 1), octave + 1) for i in range(BANDS // ROWS) if (k, ROWS * i) < (octave, at)]
    before = np.stack(before, 1) if before else np.zeros((len(members), 0), np.uint32)
    tile, weight = np.array([m[0] for m in members]), 2.0 ** np.arange(n.max())
    for i in range(len(members) - 1):
        meet = ~((before[i] == before[i + 1 :]) & (before[i] > 0)).any(axis=1)
        if cross:
            meet &= tile[i + 1 :] != tile[i]
        others = i + 1 + np.flatnonzero(meet)
        x, y = grid[i], grid[others]
        there = (x > 0) | (y > 0)
        share = ((there & (x == y)).sum(axis=2) @ weight) / np.maximum(there.sum(axis=2) @ weight, 1e-300)
        for j in np.flatnonzero(share >= least).tolist():
            yield members[i][1], members[others[j]][1], float(share[j])


def compared(least: float):
    def run(batches):
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.float64()))], ["a", "b", "likeness"])
        out, place, members = [], None, []
        for batch in batches:
            for key, i, j, *member in zip(*[c.to_pylist() for c in batch.columns]):
                if place != (key, i, j):
                    if len(members) > 1:
                        out.extend(like_pairs(place[0], place[1] != place[2], members, least))
                    place, members = (key, i, j), []
                    if len(out) >= 10_000:
                        yield made(out)
                        out = []
                members.append(tuple(member))
        if len(members) > 1:
            out.extend(like_pairs(place[0], place[1] != place[2], members, least))
        if out:
            yield made(out)

    return run


def near_pairs(classes: DataFrame, least: float = LEAST, tile: int = 512) -> DataFrame:
    """(a, b, likeness), a < b: nodes of classes (node, fp), a materialised table, that share a band row and have a
    likeness of `least` or more."""
    keyed = materialise(classes.select("node", F.explode(keys_of("fp")).alias("key")), "edit-keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", "n", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    placed = skewed_join(keyed, materialise(shared, "edit-rows"), "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("node", "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile")
    members = sent.join(classes, "node").select("key", "i", "j", "tile", "node", "fp")
    return members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compared(least), PAIRS)


def near_documents(docs: DataFrame, least: float = LEAST, tile: int = 512) -> DataFrame:
    """doc_id, class_id (the least id of its fingerprint's class), n_copies (rows of the class), n_links (other classes
    of a likeness of `least` or more) and best_likeness (0 without a link) for each row."""
    rows = docs.select(F.col("doc_id").cast("long"), fingerprints(F.col("text").cast("string")).alias("fp"))
    rows = materialise(rows.withColumn("node", F.unhex(F.md5("fp"))), "edit-fingerprints")
    classes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.min("fp").alias("fp"), F.count("*").alias("n_copies")), "edit-classes")
    ends = near_pairs(classes.select("node", "fp"), least, tile).select(F.explode(F.array("a", "b")).alias("node"), "likeness")
    linked = ends.groupBy("node").agg(F.count("*").alias("n_links"), F.max("likeness").alias("best_likeness"))
    named = classes.join(linked, "node", "left").select(
        "node", "class_id", "n_copies", F.col("n_copies").alias("n"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("best_likeness", F.lit(0.0)).alias("best_likeness"))
    return skewed_join(rows.select("doc_id", "node"), materialise(named, "edit-named"), "node").drop("node")


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def sketch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_sketches(table(spark, sf_dir, "documents").select("doc_id", "text"))
