"""What several operators share: tables, cut lineage, bounded joins, thresholds, word kernels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table of at most this many rows may be broadcast; its rows are counted first.
BROADCAST_ROWS = 20_000
#: Copies of the smaller side when a join on a hot key is salted instead.
SALTS = 32
#: A key with more rows than this is joined apart from the others.
HOT_ROWS = 1000
#: The ASCII white space that separates words everywhere in this subpackage.
SPACES = b" \t\n\v\f\r"


#: Rows of one Arrow batch. Texts may be long, and a Python worker holds a batch at a time.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it was given a size of its own."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where a local session names none (tests) is a temporary one made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cairn-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables that materialise() wrote and that are still there, oldest first.
_WRITTEN: list[str] = []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/cairn/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def as_declared(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema. A table read back forgets which of them are never null; for plain types they are so again."""
    plain = (T.NumericType, T.StringType, T.BooleanType)
    again = lambda f: F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name)
    return df.select(*[F.col(f.name) if f.nullable or not isinstance(f.dataType, plain) else again(f) for f in schema])


def written() -> int:
    """How many tables there are: where drop_tables may begin later."""
    return len(_WRITTEN)


def drop_tables(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Delete the tables that materialise() wrote, from number `first` to `last`. Results not yet read need theirs."""
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in _WRITTEN[first:last]:
        at = paths(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del _WRITTEN[first:last]


def bounded_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join a large table with a materialised one of unique keys.

    right is broadcast if it has at most `limit` rows (counted here); otherwise the keys of left are
    salted and right is repeated once for each salt, so that a hot key spreads over SALTS tasks.
    """
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), keys, how)
    salted = left.withColumn("__salt", F.pmod(F.hash(*[c for c in left.columns if c not in keys][:1] or keys), F.lit(SALTS)))
    copies = right.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def skewed_join(left: DataFrame, right: DataFrame, key: str, count: str = "n", hot: int = HOT_ROWS) -> DataFrame:
    """Inner equi-join on one key with a materialised table of unique keys whose column `count` holds the number of
    rows that left has of each. Keys of more than `hot` rows are joined by bounded_join, the others by a shuffle.

    left is read twice if there are hot keys. Column `count` is not in the result.
    """
    many = right.where(F.col(count) > hot).drop(count)
    if many.isEmpty():
        return left.join(right.drop(count), key)
    many = many.withColumn("__hot", F.lit(True))
    tagged = bounded_join(left, materialise(many, "hot"), [key])
    others = [c for c in many.columns if c != key]
    rest = tagged.where("__hot is null").drop(*others).join(right.where(F.col(count) <= hot).drop(count), key)
    return tagged.where("__hot").drop("__hot").unionByName(rest)


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and one 0/1 label; null ids and null labels go, repeated ids keep the smallest label."""
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("__label"))
        .where("doc_id is not null and __label is not null")
        .groupBy("doc_id").agg(F.min("__label").alias("__label"))
    )


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is the held-out part. Null ids count as ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def thinned(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """Rows whose keys' hash lies below a bound that leaves about 2 * most of them, with the hash in __h.

    Without it each task would send its `most` smallest rows to the driver, more with every task.
    """
    df = df.withColumn("__h", F.xxhash64(*keys))
    n = df.count()
    return df if n <= 2 * most else df.where(F.col("__h") < int(-(2**63) + 2**64 * (2 * most / n)))


def sample_rows(df: DataFrame, columns: list[str], most: int, *keys: str) -> list:
    """At most `most` rows, those of the smallest hash of the keys: the same rows in every run."""
    return thinned(df, most, *keys).select(*columns, "__h").orderBy("__h", *columns).limit(most).collect()


def threshold(hist: list[tuple[int, int, int]], bins: int, false_reject: float) -> int:
    """The lowest bin that is rejected, from (bin, good rows, bad rows) where high bins look bad.

    Among cuts that reject at most the share `false_reject` of the good rows, the one with the best
    difference of rejected shares, in the middle of a gap without rows. Without bad rows it is the lowest of
    these cuts; without good rows, or if no cut rejects a larger share of the bad rows, nothing is rejected.
    """
    good, bad = np.zeros(bins + 1), np.zeros(bins + 1)
    for b, g, x in hist:
        good[b] += g
        bad[b] += x
    if not good.sum():
        return bins + 1
    g = np.cumsum(good[::-1])[::-1] / good.sum()
    if not bad.sum():
        return int(np.argmax(np.append(g <= false_reject, True)))
    x = np.cumsum(bad[::-1])[::-1] / bad.sum()
    gain = np.where(g <= false_reject, x - g, -1.0)
    best = np.flatnonzero(gain == gain.max())
    best = best[: int(np.argmax(np.append(np.diff(best) > 1, True))) + 1]  # the first run
    return int(best[len(best) // 2]) if gain.max() > 0 else bins + 1


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method for logistic regression; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], l2)
    reg[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + reg * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; bytes.split() splits on just these characters."""
    return encoded(text).split()


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
