"""Reversible byte transforms, entropy statistics, and sector parity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import byte_values, flat
from ..functions.kernels import delta, undelta  # noqa: F401

SCALE = 4096
SECTOR = 512
# Below so many sectors there are so many parity groups.
GROUPS = ((200, 1), (400, 2), (800, 4), (1600, 8))
MOST_GROUPS = 16


def mapped(function: Callable[[bytes], bytes]):
    """A UDF that applies a function to each binary value; null stays null."""

    @F.arrow_udf(T.BinaryType())
    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else function(x) for x in v.to_pylist()], pa.binary())

    return run


def bcj(data: bytes, back: bool = False) -> bytes:
    """x86 calls and jumps: the 32-bit displacement after E8 or E9 becomes a target address, or is made one again."""
    out, i = bytearray(data), 0
    while i + 4 < len(out):
        if out[i] not in (0xE8, 0xE9):
            i += 1
            continue
        shift = -(i + 5) if back else i + 5
        out[i + 1 : i + 5] = ((int.from_bytes(out[i + 1 : i + 5], "little") + shift) & 0xFFFFFFFF).to_bytes(4, "little")
        i += 5
    return bytes(out)


def rotation_ranks(v: np.ndarray) -> np.ndarray:
    """Starts of the sorted rotations, by prefix doubling; equal rotations in order of their start."""
    n = len(v)
    rank, k = v.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < n:
        second = np.roll(rank, -k)
        order = np.lexsort((np.arange(n), second, rank))
        a, b = rank[order], second[order]
        fresh = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        k *= 2
    return order if n > 1 else np.zeros(n, np.int64)


def bwt(data: bytes) -> tuple[bytes, int]:
    """The last column of the sorted rotations and the row of the text itself."""
    if not data:
        return b"", 0
    v = np.frombuffer(data, np.uint8)
    order = rotation_ranks(v)
    return v[order - 1].tobytes(), int(np.flatnonzero(order == 0)[0])


def unbwt(data: bytes, row: int) -> bytes:
    v = np.frombuffer(data, np.uint8)
    following = np.argsort(v, kind="stable")
    out = bytearray()
    for _ in range(len(v)):
        row = int(following[row])
        out.append(v[row])
    return bytes(out)


def delta_rows(df: DataFrame, stride: int) -> DataFrame:
    """The same as delta() on rows (blob_id, pos, v), by a window: column d."""
    w = Window.partitionBy("blob_id").orderBy("pos")
    return df.withColumn("d", F.coalesce(F.pmod(F.col("v") - F.lag("v", stride).over(w), F.lit(256)), F.col("v")))


def undelta_rows(df: DataFrame, stride: int) -> DataFrame:
    """Column v again from d: a running sum for each phase of the stride."""
    w = Window.partitionBy("blob_id", F.col("pos") % stride).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("v", F.pmod(F.sum("d").over(w), F.lit(256)))


def byte_rows(df: DataFrame) -> DataFrame:
    """blob_id, pos and v of each byte of column content."""
    return df.select("blob_id", F.posexplode(byte_values(F.col("content"))).alias("pos", "v"))


def histogram(df: DataFrame, key: str) -> DataFrame:
    """key, byte and n. Each task adds up its batches by key, so the shuffle has 256 rows for each key and task."""
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("byte", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        total: dict = {}
        for batch in batches:
            data, at = flat(batch.column(1))
            names = batch.column(0).to_pylist()
            for name, s, e in zip(names, at[:-1], at[1:]):
                total[name] = total.get(name, 0) + np.bincount(data[s:e], minlength=256)
            if len(total) > 4096:
                yield from rows(total)
                total = {}
        yield from rows(total)

    def rows(total):
        keys = [(k, b, int(n)) for k, v in total.items() for b, n in enumerate(v) if n]
        if keys:
            k, b, n = zip(*keys)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b, pa.int64()), pa.array(n, pa.int64())], [key, "byte", "n"])

    return df.select(key, "content").mapInArrow(run, out).groupBy(key, "byte").agg(F.sum("n").alias("n"))


def entropy(hist: DataFrame, key: str) -> DataFrame:
    """Bits for each byte and the least whole bytes that an order-0 code needs."""
    total = hist.groupBy(key).agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return hist.join(total, key).groupBy(key, "total").agg((-F.sum(p * F.log2(p))).alias("bits")).select(key, "total", F.round("bits", 6).alias("bits"), F.ceil(F.round(F.col("bits") * F.col("total") / 8, 3)).alias("ideal_bytes"))


def frequency_table(hist: DataFrame, key: str, symbol: str = "byte") -> DataFrame:
    """Frequencies scaled to a sum of 4096: rounded down, at least 1, what is over or short goes to the first largest; with prefix sums."""
    w = Window.partitionBy(key)
    scaled = hist.withColumn("total", F.sum("n").over(w)).withColumn("f", F.greatest(F.expr(f"n * {SCALE} div total"), F.lit(1)))
    rank = F.row_number().over(w.orderBy(F.desc("f"), symbol))
    fixed = scaled.withColumn("rank", rank).withColumn("freq", F.col("f") + F.when(F.col("rank") == 1, SCALE - F.sum("f").over(w)).otherwise(0))
    before = F.coalesce(F.sum("freq").over(w.orderBy(symbol).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return fixed.select(key, symbol, "n", "freq", before.alias("cumfreq"))


def parity_groups(sectors: Column) -> Column:
    out = F.lit(MOST_GROUPS)
    for below, n in reversed(GROUPS):
        out = F.when(sectors < below, n).otherwise(out)
    return out


PARITY = T.ArrayType(T.StructType([T.StructField("grp", T.LongType()), T.StructField("n_sectors", T.LongType()), T.StructField("parity", T.BinaryType())]))


def sectors_of(data: bytes) -> np.ndarray:
    n = -(-len(data) // SECTOR)
    out = np.zeros((n, SECTOR), np.uint8)
    out.reshape(-1)[: len(data)] = np.frombuffer(data, np.uint8)
    return out


def groups_for(n: int) -> int:
    return next((g for below, g in GROUPS if n < below), MOST_GROUPS)


@F.arrow_udf(PARITY)
def parity(v: pa.Array) -> pa.Array:
    """The XOR of the sectors of each group; sector i is in group i modulo the number of groups, the last is padded with zeros."""
    out = []
    for x in v.to_pylist():
        s = sectors_of(x or b"")
        g = groups_for(len(s))
        out.append([{"grp": i, "n_sectors": len(s[i::g]), "parity": np.bitwise_xor.reduce(s[i::g], axis=0).tobytes()} for i in range(min(g, len(s)))])
    return pa.array(out, pa.list_(pa.struct([("grp", pa.int64()), ("n_sectors", pa.int64()), ("parity", pa.binary())])))


def repair(data: bytes, parities: list[bytes], bad: list[int]) -> bytes:
    """The value with its bad sectors (at most one in a group) rebuilt from the other ones and the parity."""
    s = sectors_of(data)
    g = groups_for(len(s))
    for i in bad:
        rest = np.bitwise_xor.reduce(np.delete(s[i % g :: g], i // g, axis=0), axis=0) if len(s[i % g :: g]) > 1 else np.zeros(SECTOR, np.uint8)
        s[i] = rest ^ np.frombuffer(parities[i % g], np.uint8)
    return s.reshape(-1)[: len(data)].tobytes()


def best_stride(data: bytes, most: int = 4, sample: int = 1450, gain: float = 0.05) -> int:
    """The delta stride (0: none) whose sample from the middle has the least order-0 cost; it must win by more than `gain` bits a byte.

    Runs of three zeros or more are not counted for strides from 1 on."""
    mid = max(0, len(data) // 2 - sample // 2)
    v = data[mid : mid + sample]
    best, cost = 0, order0(np.frombuffer(v, np.uint8))
    for s in range(1, min(most, len(v) - 1) + 1):
        d = np.frombuffer(delta(v, s), np.uint8)
        zero = d == 0
        run = np.zeros(len(d), bool)
        run[: len(d) - 2] |= zero[:-2] & zero[1:-1] & zero[2:]
        long_run = run | np.roll(run, 1) | np.roll(run, 2)
        c = order0(d[~long_run]) * (~long_run).sum() / max(len(d), 1)
        if c < cost - gain:
            best, cost = s, c
    return best


def order0(v: np.ndarray) -> float:
    """Shannon bits for each byte."""
    if not len(v):
        return 0.0
    p = np.bincount(v, minlength=256) / len(v)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())
