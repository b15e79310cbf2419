"""Embedding: the deterministic hash embedder, plug-in embedders, batch requests and their results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.text import tokens


def hash_embedded(df: DataFrame, dim: int = 64, text: str = "text") -> DataFrame:
    """df with an embedding of unit length: counts of its tokens by hash bucket; a blank or null text gives zeros.

    Catalyst expressions only; needs no model, and equal texts have equal embeddings."""
    def let(value, body):  # binds a value to a variable, so that it is worked out once
        return F.transform(F.array(value), body)[0]

    places = F.transform(tokens(F.coalesce(F.lower(text), F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    count = lambda p: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(p, lambda x: x == i)).cast("double"))
    unit = lambda c: let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))
    return df.withColumn("embedding", let(places, lambda p: let(count(p), unit)))


def embedded(df: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 64, text: str = "text") -> DataFrame:
    """df with an embedding by a plug-in: encoder() is called once a task and gives list of texts -> float32 (n, dim)."""
    columns = df.columns
    at = columns.index(text)

    def run(batches):
        encode = encoder()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            rows = [np.asarray(encode(texts[i : i + batch_size]), np.float32) for i in range(0, len(texts), batch_size)]
            vectors = pa.array([r.tolist() for part in rows for r in part], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*columns, "embedding"])

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return df.mapInArrow(run, schema)


def batch_requests(chunks: DataFrame, model: str) -> DataFrame:
    """(line): one JSON request a chunk, keyed by custom_id = chunk_id."""
    body = F.struct(F.lit(model).alias("model"), F.col("text").alias("input"), F.lit("float").alias("encoding_format"))
    request = F.struct(F.col("chunk_id").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/embeddings").alias("url"), body.alias("body"))
    return chunks.select(F.to_json(request).alias("line"))


def batch_results(lines: DataFrame) -> DataFrame:
    """(chunk_id, embedding) of JSON result lines with status 200; malformed lines and others are left out."""
    schema = "custom_id string, response struct<status_code:int,body:struct<data:array<struct<embedding:array<float>>>>>"
    row = F.from_json("line", schema)
    return lines.select(row.alias("r")).where("r.response.status_code = 200").select(F.col("r.custom_id").alias("chunk_id"), F.col("r.response.body.data")[0]["embedding"].alias("embedding"))


def by_doc_type(rows: DataFrame) -> DataFrame:
    """(doc_type, n): how many rows each index gets; rows without a type go to 'default'."""
    return rows.groupBy(F.coalesce("doc_type", F.lit("default")).alias("doc_type")).agg(F.count("*").alias("n"))


def matched(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """chunks that have a result (chunk_id, ...), joined to it."""
    return chunks.join(results, "chunk_id")


def missing(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """chunks without a result."""
    return chunks.where("chunk_id is not null").join(results.select("chunk_id"), "chunk_id", "left_anti")


def with_insight(text, summaries) -> F.Column:
    """Text with the image summaries appended, as it is embedded; unchanged where there are none."""
    note = F.array_join(summaries, " ")
    return F.when(F.size(summaries) > 0, F.concat(text, F.lit("\n\n[Image Insight]: "), note)).otherwise(text)


def enriched_or_base(base: DataFrame, enriched: DataFrame, key: str) -> DataFrame:
    """The enriched rows, and the base rows of keys that have none."""
    return enriched.unionByName(base.join(enriched.select(key).distinct(), key, "left_anti"))
