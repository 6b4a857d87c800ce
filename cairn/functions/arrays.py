"""Arrow UDFs over binary columns, and the columns that queries build from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary array; null counts as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.fill_null(b"").cast(pa.large_binary())
    buffers = values.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(values) + 1, values.offset * 8) if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


@F.arrow_udf(T.LongType())
def checksum(v: pa.Array) -> pa.Array:
    data, at = flat(v)
    return pa.array(kernels.checksum(data, at[:-1], np.diff(at)))


@F.arrow_udf(T.LongType())
def fnv32(v: pa.Array) -> pa.Array:
    data, at = flat(v)
    return pa.array(kernels.fnv(data, at[:-1], np.diff(at), 32).astype(np.int64))


@F.arrow_udf(T.LongType())
def fnv64(v: pa.Array) -> pa.Array:
    data, at = flat(v)
    return pa.array(kernels.fnv(data, at[:-1], np.diff(at)).view(np.int64))


@F.arrow_udf(T.LongType())
def simhash64(v: pa.Array) -> pa.Array:
    data, at = flat(v)
    return pa.array(np.array([kernels.simhash(data[s:e]) for s, e in zip(at[:-1], at[1:])], np.uint64).view(np.int64))


CHUNKS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("offset", "length", "hash64", "hash32")]))


def cdc_chunks(bits: int, least: int | None = None, most: int | None = None, gear: list[int] | None = None, compat: bool = False, weak: bool = True):
    """A UDF from bytes to their chunks with hashes: one pass finds the cuts and hashes all chunks of a batch.

    weak: whether the 32-bit hash is made too, else it is null.
    """
    table = None if gear is None else np.array(gear, np.uint32)

    @F.arrow_udf(CHUNKS)
    def run(v: pa.Array) -> pa.Array:
        data, at = flat(v)
        rows, off, size = kernels.chunks(data, at, bits, least, most, table, compat)
        start = at[rows] + off if len(rows) else off
        h64 = kernels.fnv(data, start, size).view(np.int64)
        h32 = pa.array(kernels.fnv(data, start, size, 32).astype(np.int64)) if weak else pa.nulls(len(rows), pa.int64())
        items = pa.StructArray.from_arrays([pa.array(off), pa.array(size), pa.array(h64), h32], ["offset", "length", "hash64", "hash32"])
        counts = np.bincount(rows, minlength=len(at) - 1) if len(at) > 1 else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), items)

    return run


def byte_values(binary: Column) -> Column:
    """The bytes of a binary column as an array of int, by built-in functions."""
    text = F.decode(binary, "ISO-8859-1")
    return F.when(F.length(binary) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c)))


def digest_list(hashes: Column) -> Column:
    """FNV-64 over the little-endian bytes of an ordered array of 64-bit hashes; 0 for none."""

    @F.arrow_udf(T.LongType())
    def run(v: pa.Array) -> pa.Array:
        if isinstance(v, pa.ChunkedArray):
            v = v.combine_chunks()
        offsets = np.asarray(v.offsets).astype(np.int64)
        data = np.asarray(v.values).astype("<i8").view(np.uint8)
        size = np.diff(offsets) * 8
        h = kernels.fnv(data, offsets[:-1] * 8, size)
        return pa.array(np.where(size > 0, h, np.uint64(0)).view(np.int64))

    return run(hashes)
