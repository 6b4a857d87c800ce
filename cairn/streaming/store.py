"""Incremental ingest: micro-batches of documents into a block store of chunks by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dedup as D


class BlockStore:
    """Two tables in a folder: blocks (hash and bytes, by batch and prefix) and ingests (a row for each blob).

    A batch's rows are written under its number, in overwrite mode, so a repeated batch replaces its own
    rows: exactly once, also after a failure between the two writes.
    """

    def __init__(self, spark, path: str, bits: int = D.BITS):
        self.spark, self.path, self.bits = spark, path.rstrip("/"), bits

    def _read(self, name: str, schema: str, batch: int | None = None) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            df = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing is there yet
            return self.spark.createDataFrame([], schema)
        return df if batch is None else df.where(F.col("batch") < batch)

    def blocks(self, before: int | None = None) -> DataFrame:
        return self._read("blocks", "hash64 bigint, length bigint, data binary, batch bigint, prefix string", before)

    def ingests(self) -> DataFrame:
        return self._read("ingests", "blob_id bigint, n_chunks bigint, n_new bigint, stored_bytes bigint, saved_bytes bigint, batch bigint")

    def ingest(self, blobs: DataFrame, batch: int) -> None:
        chunks = D.chunk_data(blobs.select("blob_id", "content"), self.bits)
        chunks.persist()
        try:
            known = self.blocks(batch).select("hash64")
            fresh = chunks.select("hash64", "length", "data").dropDuplicates(["hash64"]).join(known, "hash64", "left_anti")
            rows = D.ingested(chunks.drop("data"), known)
            rows.write.mode("overwrite").parquet(f"{self.path}/ingests/batch={batch}")
            prefix = F.lower(F.substring(F.lpad(F.hex("hash64"), 16, "0"), 1, 2))
            fresh.withColumn("prefix", prefix).write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/blocks/batch={batch}")
        finally:
            chunks.unpersist()

    def read(self, hex_hash: str) -> bytes | None:
        """The bytes of one block by its 16 hex digits; only its prefix's part of the table is read."""
        number = int(hex_hash, 16)
        row = self.blocks().where((F.col("prefix") == hex_hash[:2].lower()) & (F.col("hash64") == number - (1 << 64 if number >> 63 else 0))).select("data").first()
        return bytes(row.data) if row else None

    def has(self, hashes: DataFrame) -> DataFrame:
        """Those of the hashes (column hash64) that are stored."""
        return hashes.join(self.blocks().select("hash64"), "hash64", "left_semi")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Ingests a stream of (blob_id, content)."""
        return stream.writeStream.foreachBatch(lambda df, n: self.ingest(df, n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def stats(self) -> DataFrame:
        """Blobs, chunks, blocks, bytes stored and saved over all batches."""
        return self.ingests().agg(F.count("*").alias("blobs"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_new").alias("n_blocks"), F.sum("stored_bytes").alias("total_bytes"), F.sum("saved_bytes").alias("saved_bytes"))
