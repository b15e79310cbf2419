"""Image captions for chunks: a plug-in captioner, summaries on the chunk or as rows of their own."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def captions(chunks: DataFrame, captioner: Callable[[], Callable[[str, str], str | None]], prefix: int = 500) -> DataFrame:
    """(chunk_id, pos, image_path, description) of every image of every chunk, once each.

    chunks: (chunk_id, text, image_paths). captioner() is called once a task and gives a function
    of image path and the first characters of the text; None, '' and errors skip the image."""
    rows = chunks.select("chunk_id", F.substring("text", 1, prefix).alias("t"), F.posexplode("image_paths").alias("pos", "image_path")).where("image_path is not null")

    def run(batches):
        caption = captioner()
        for batch in batches:
            out = []
            for c, t, p, i in zip(*(x.to_pylist() for x in batch.columns)):
                try:
                    d = caption(i, t or "")
                except Exception:  # noqa: BLE001 - one image must not end the step
                    d = None
                if d:
                    out.append((c, p, i, d))
            cols = list(zip(*out)) or [[]] * 4
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["chunk_id", "pos", "image_path", "description"])

    return rows.mapInArrow(run, "chunk_id string, pos int, image_path string, description string")


def with_summaries(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """chunks with image_summaries, an array of (image_path, description) in the images' order; null where there are none."""
    each = found.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "image_path", "description"))).alias("s"))
    pairs = F.transform("s", lambda x: F.struct(x["image_path"].alias("image_path"), x["description"].alias("description")))
    return chunks.join(each.select("chunk_id", pairs.alias("image_summaries")), "chunk_id", "left")


def as_rows(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks and image rows in one schema, told apart by kind; image rows name their source_chunk_id."""
    images = found.select(F.lit("image").alias("kind"), F.sha2(F.concat_ws(chr(0), "chunk_id", "image_path"), 256).alias("chunk_id"), F.col("chunk_id").alias("source_chunk_id"), "image_path", "description")
    return chunks.withColumn("kind", F.lit("text")).unionByName(images, allowMissingColumns=True)


def flattened(enriched: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(source_chunk_id, image_path, description) of all non-empty summaries, with columns of the chunk to carry along."""
    rows = enriched.select(F.col("chunk_id").alias("source_chunk_id"), *carry, F.explode("image_summaries").alias("s")).select("source_chunk_id", "s.image_path", "s.description", *carry)
    return rows.where("description <> ''")


def enriched(chunks: DataFrame, captioner: Callable[[], Callable[[str, str], str | None]], output_mode: str = "append_to_chunk") -> DataFrame:
    """Chunks with their images' captions, as summaries on the chunk or (separate_chunk) as rows of their own; another mode raises."""
    modes = {"append_to_chunk": with_summaries, "separate_chunk": as_rows}
    if output_mode not in modes:
        raise ValueError(f"unknown output mode {output_mode!r}")
    return modes[output_mode](chunks, captions(chunks, captioner))
