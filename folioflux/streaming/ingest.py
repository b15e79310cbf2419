"""Incremental ingestion: new segment files become chunks once, whatever is delivered again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..operators.chunking import chunk_segments
from ..operators.dedup import first_wins, not_stored
from ..shared import exists


def ingest(spark: SparkSession, incoming: str, schema, rules: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Chunk all Parquet segment files that have come in since the last call and append unseen chunks to `target`.

    A micro-batch is chunked, reduced to the first chunk of every content hash, compared with
    the stored hashes by an anti-join, and written under its batch id, so that a repeated batch
    overwrites itself."""

    def batch(df: DataFrame, batch_id: int) -> None:
        chunks = chunk_segments(df, rules).withColumn("content_hash", content_hash("text"))
        fresh = first_wins(chunks, F.col("content_hash"), "ord", "seq")
        if exists(spark, target):  # else no batch has been written yet
            stored = spark.read.schema("content_hash string, batch long").parquet(target).where(F.col("batch") != batch_id).select("content_hash")
            fresh = not_stored(fresh, F.col("content_hash"), stored)
        fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(incoming)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
