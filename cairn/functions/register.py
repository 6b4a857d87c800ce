"""The engine's functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import transforms as X
from . import codecs as K
from .arrays import cdc_chunks, checksum, fnv32, fnv64, simhash64


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Registers the functions in the session and returns their names."""
    functions = {
        "xor_checksum": checksum, "fnv32": fnv32, "fnv64": fnv64, "simhash64": simhash64, "cdc_chunks": cdc_chunks(8), "sector_parity": X.parity,
        "lz4_block": X.mapped(K.lz4_compress), "lz4_unblock": X.mapped(K.lz4_decompress), "bcj": X.mapped(X.bcj), "unbcj": X.mapped(lambda b: X.bcj(b, True)),
        "delta1": X.mapped(lambda b: X.delta(b, 1)), "undelta1": X.mapped(lambda b: X.undelta(b, 1)), "block_compress": X.mapped(K.compress),
        "dict_object": X.mapped(lambda b: K.dict_serialize(K.dict_create(b))),
    }
    for name, f in functions.items():
        spark.udf.register(prefix + name, f)
    return [prefix + n for n in functions]
