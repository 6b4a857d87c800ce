"""Quality rules: an isolation forest on rule statistics (operator 2).

Each document gets counts (words, symbols, repeated lines and word windows). Two base rules fail short
and repetitive texts. For the rest an isolation forest measures how quickly random splits separate a
document's ratios from those of the others: the score is 2 ** (-mean path length / expected length), and
nothing else enters it. A cut on that score, set from labelled rows, rejects outliers.

The ratios are logarithms, so that a split is as likely to fall among small values as beyond them, and the
trees are small (DRAWN rows each), so that a group of like outliers does not hide its members.

Bounds: the forest is built from at most `sample` rows of all that pass the base rules and are not labelled bad
(those of the smallest hash of id and counts), the cut from the scores of all labelled rows, as a histogram of BINS bins.
Everything else sees every row.

Cases: a null or empty text has no words and fails the base rules; null ids are scored but never
labelled; repeated rows get equal verdicts; without good labels only the base rules reject, without bad ones
the cut is set by the good rows alone; an empty table gives an empty result; columns of the input beside
doc_id and text are never read, and a clashing name cannot matter because results are in one struct column
of a reserved name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_declared, labels_of, materialise, table, thinned, threshold
from .textstats import text_stats

BINS = 1000
TREES, DRAWN, SEED = 200, 128, 7
SAMPLE = 8192
FALSE_REJECT = 0.002
COUNTS = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_lines", "n_upper", "n_bang", "n_digits", "n_ends", "n_distinct")


def features(s: pa.StructArray) -> np.ndarray:
    """Logarithms of ratios that do not depend on a text's length; small ones differ little."""
    v = {f: np.asarray(s.field(f).fill_null(0), float) for f in COUNTS}
    words, chars, lines = (np.maximum(v[f], 1) for f in ("n_words", "word_chars", "n_lines"))
    ratio = lambda a, b, least: np.log(v[a] / b + least)
    return np.stack([
        np.log(chars / words), ratio("n_symbols", words, 0.01), ratio("n_repeat_words", words, 0.01), ratio("n_bang", words, 0.01),
        ratio("n_upper", chars, 0.01), ratio("n_digits", chars, 0.01), ratio("n_ends", lines, 0.001),
        np.log(np.maximum(v["n_distinct"], 1) / words) / np.log(np.maximum(words, 2)),
    ], axis=1)


def unsuccessful(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Isolation trees as arrays; a leaf points to itself and holds its path length."""

    def __init__(self, x: np.ndarray, trees: int = TREES, drawn: int = DRAWN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n = min(drawn, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(n, 2)))))
        self.norm = max(unsuccessful(n), 1e-9)
        self.trees = [self._grow(x[rng.choice(len(x), n, replace=False)], rng) for _ in range(trees)]

    def _grow(self, x, rng):
        feature, cut, left, right, length = [], [], [], [], []

        def node(rows, depth):
            i = len(feature)
            for a, v in ((feature, 0), (cut, np.inf), (left, i), (right, i), (length, 0.0)):
                a.append(v)
            spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
            if depth >= self.depth or not len(spread):
                length[i] = depth + unsuccessful(len(rows))
                return i
            f = int(rng.choice(spread))
            c = rng.uniform(rows[:, f].min(), rows[:, f].max())
            feature[i], cut[i] = f, c
            side = rows[:, f] < c
            left[i] = node(rows[side], depth + 1)
            right[i] = node(rows[~side], depth + 1)
            return i

        node(x, 0)
        return tuple(np.array(a) for a in (feature, cut, left, right, length))

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        """The mean over the trees of the path length of each row."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = np.where(x[rows, feature[at]] < cut[at], left[at], right[at])
            total += length[at]
        return total / len(self.trees)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; larger is more anomalous."""
        return 2 ** (-self.path_lengths(x) / self.norm)


def with_stats(docs: DataFrame, out: str = "__stats") -> DataFrame:
    """docs with one struct column of counts of the whole text."""
    return docs.withColumn(out, text_stats(F.col("text").cast("string")))


def scored(df: DataFrame, model: tuple[Forest | None, int], out: str = "__rules", stats: str = "__stats") -> DataFrame:
    """df with struct `out`: base_failed, bin (the anomaly score in BINS steps), kept."""
    forest, cut = model

    @F.arrow_udf(T.IntegerType())
    def anomaly(s: pa.Array) -> pa.Array:
        x = features(s)
        return pa.array((forest.score(x) * BINS).astype(np.int32) if forest else np.zeros(len(x), np.int32), pa.int32())

    words, repeats = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    failed = (words < 50) | (100 * repeats > 50 * words)
    df = df.withColumn("__bin", anomaly(F.col(stats)))
    return df.withColumn(out, F.struct(failed.alias("base_failed"), F.col("__bin").alias("bin"), (~failed & (F.col("__bin") < cut)).alias("kept"))).drop("__bin")


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE, false_reject: float = FALSE_REJECT) -> tuple[Forest | None, int]:
    """The forest and the first rejected bin, from a materialised table of doc_id and __stats."""
    passing = stats.where("__stats.n_words >= 50 and 100 * __stats.n_repeat_words <= 50 * __stats.n_words")
    names = [f"__stats.{f}" for f in COUNTS]
    known = labels_of(labels, "quality")
    some = thinned(passing.select("doc_id", "__stats"), sample, "doc_id", *names).join(known.where("__label = 0"), "doc_id", "left_anti")
    rows = some.orderBy("__h", *names).select(*names).limit(sample).collect()
    if not rows:
        return None, BINS + 1
    x = features(pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))], COUNTS))
    forest = Forest(x)
    labelled = scored(passing.select("doc_id", "__stats").join(known, "doc_id"), (forest, BINS + 1))
    hist = labelled.groupBy("__rules.bin").agg(F.sum("__label").alias("good"), F.sum(1 - F.col("__label")).alias("bad")).collect()
    return forest, threshold([tuple(r) for r in hist], BINS, false_reject)


def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(with_stats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "rule-stats")
    model = fit(stats, table(spark, sf_dir, "labels"))
    return scored(stats, model).select(
        "doc_id", *[F.col(f"__stats.{f}").alias(f) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "__rules.base_failed", "__rules.kept", (F.col("__rules.bin") / BINS).alias("anomaly"),
    )


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their columns as they were. The counts are made once, beside the rows."""
    rows = materialise(with_stats(docs), "rule-stats")
    return as_declared(scored(rows, fit(rows, table(spark, sf_dir, "labels"))).where("__rules.kept"), docs.schema)
