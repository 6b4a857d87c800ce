"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 10).

Features of a whole text, as a set: its words (A-Z lowered, outer punctuation stripped), pairs of
neighbours and pairs with one word between, each hashed to 2**BITS places. FTRL-proximal keeps a rate
for each coordinate, and its L1 term leaves few weights different from zero, so that the model sent to
the executors is small (its size does not grow with the data).

Bounds: the weights are fitted on at most `sample` labelled rows, those of the smallest id hash among the
rows outside the held-out fold (crc32 of the id as text, modulo 5, is 0), and of these on the first that have
MOST_PLACES features together. The executors make the features; the driver gets sets of numbers, no texts, and
leaves out those in so few rows that the L1 term keeps their weights zero whatever the order. Every document is scored.

Cases: a null or empty text has no features and its score is the intercept's; without labels of both
kinds the score is 0.0 for label 0 only, else 0.5; null ids are never labelled (their fold is that of
''); a repeated id is trained on once, with its least text; only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import encoded, fold, labels_of, materialise, table, thinned

BITS = 20
SAMPLE, PASSES = 8000, 8
#: Features of all training rows together, four bytes each on the driver.
MOST_PLACES = 20_000_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.1
STRIP = b".,;:!?\"'()[]{}#*$%&|<>~_-"
MOST_WORDS = 500_000


class Hasher:
    """Hashed features; hashes of words are kept, and forgotten when there are too many."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, words = self.known, encoded(text).lower().split()
        if len(known) > MOST_WORDS:
            known.clear()
        h = []
        for w in words:
            x = known.get(w)
            if x is None:
                x = known[w] = zlib.crc32(w.strip(STRIP) or w)
            h.append(x)
        a = np.array(h, np.uint64)
        mix = lambda x, y, m: ((x * np.uint64(0x9E3779B97F4A7C15) + y * np.uint64(m)) >> np.uint64(64 - BITS))
        zero = np.zeros(1, np.uint64)
        found = np.concatenate([mix(a, zero, 1), mix(a[:-1], a[1:], 0xC2B2AE3D27D4EB4F), mix(a[:-2], a[2:], 0x165667B19E3779F9)])
        mark = np.zeros(1 << BITS, bool) if len(found) > 50_000 else None
        if mark is None:
            return np.unique(found).astype(np.int64)
        mark[found.astype(np.int64)] = True
        return np.flatnonzero(mark)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the intercept has no L1 term."""

    def __init__(self, places: int = 1 << BITS):
        self.z, self.n = np.zeros(places), np.zeros(places)
        self.bz = self.bn = 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def intercept(self) -> float:
        return -self.bz / ((BETA + np.sqrt(self.bn)) / ALPHA)

    def learn(self, at: np.ndarray, y: int) -> None:
        """One row; only the few places whose weight is not zero need more than sums."""
        z = self.z[at]
        live = at[np.abs(z) > L1]
        w, b = self.weights(live), self.intercept()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - y
        n = self.n[live]
        self.z[at] = z + g
        self.z[live] -= (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g
        self.bz += g - (np.sqrt(self.bn + g * g) - np.sqrt(self.bn)) / ALPHA * b
        self.bn += g * g


def train(feats: list[np.ndarray], labels: list[int], passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """Places of the weights that are not zero, the weights, the intercept; feats: the sets of places of each row.

    A gradient is at most 1, so a place in n rows cannot leave zero unless n * passes is above L1.
    """
    none = np.zeros(0, np.int64), np.zeros(0)
    if len(set(labels)) < 2:
        return *none, -30.0 if set(labels) == {0} else 0.0
    rows = np.bincount(np.concatenate(feats).astype(np.int64), minlength=1 << BITS)
    live = np.flatnonzero(rows * passes > L1)
    number = np.full(1 << BITS, -1, np.int32)
    number[live] = np.arange(len(live))
    feats = [(n := number[f])[n >= 0] for f in feats]
    model, order = Ftrl(len(live)), np.random.default_rng(3)
    for _ in range(passes):
        for i in order.permutation(len(feats)):
            model.learn(feats[i], labels[i])
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    return live[at], w[at], model.intercept()


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def places(text: pa.Array) -> pa.Array:
    """The set of hashed features of each text."""
    global _HASHER
    _HASHER = _HASHER or Hasher()
    return pa.array([_HASHER(t).astype(np.int32) for t in text.to_pylist()], pa.list_(pa.int32()))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MOST_PLACES) -> tuple[list[np.ndarray], list[int]]:
    """Features and labels of the sample: chosen among the labels' ids first, so that only its texts move."""
    known = labels_of(labels, "toxic").where(fold() != 0)
    ids = thinned(known, sample, "doc_id").orderBy("__h", "doc_id").limit(sample)
    picked = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # at most `sample` rows of numbers
    picked = picked.groupBy("__h", "doc_id", "__label").agg(F.min("text").alias("text"))
    rows = materialise(picked.select("__h", "doc_id", "__label", places("text").alias("at")), "features")
    sizes = rows.select("__h", "doc_id", F.size("at").alias("n")).orderBy("__h", "doc_id").collect()
    fits = int((np.cumsum([r.n for r in sizes]) <= most).sum())
    if fits < len(sizes):
        h, doc = F.lit(sizes[fits]["__h"]), F.lit(sizes[fits].doc_id)
        rows = rows.where((F.col("__h") < h) | ((F.col("__h") == h) & (F.col("doc_id") < doc)))
    got = rows.orderBy("__h", "doc_id").select("__label", "at").toArrow()
    at = got["at"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    values, ends = np.asarray(at.values), np.asarray(at.offsets)
    return [values[s:e] for s, e in zip(ends[:-1], ends[1:])], got["__label"].to_pylist()


def toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], out: str = "score") -> DataFrame:
    """docs with the probability of label 1."""
    at, weights, intercept = model

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        global _DENSE, _HASHER
        if _DENSE is None or _DENSE[0] != zlib.crc32(weights.tobytes()):
            dense = np.zeros(1 << BITS)
            dense[at] = weights
            _DENSE, _HASHER = (zlib.crc32(weights.tobytes()), dense), _HASHER or Hasher()
        s = np.array([_DENSE[1][_HASHER(t)].sum() for t in text.to_pylist()], float) + intercept
        return pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))), pa.float64())

    return docs.withColumn(out, score(F.col("text").cast("string")))


_DENSE, _HASHER = None, None


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(*training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
