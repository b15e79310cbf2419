"""Image descriptions: what is new, their index, nearest ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.text import content_hash
from .dedup import first_wins, not_stored
from .embedding import hash_embedded
from .retrieval import nearest

#: Document types whose images are indexed unless others are named. Fixed values.
IMAGE_TYPES = ("pptx", "pdf", "docx")


def new_descriptions(images: DataFrame, stored: DataFrame | None = None, order: str = "id") -> DataFrame:
    """Images (id, description, ...) with image_hash, the SHA-256 of the stripped description: empty ones, those
    whose hash is stored (image_hash) and all but the first of a hash are left out."""
    rows = images.where(F.coalesce("description", F.lit("")) != "").withColumn("image_hash", content_hash("description"))
    rows = first_wins(rows, F.col("image_hash"), order)
    return rows if stored is None else not_stored(rows, F.col("image_hash"), stored.select("image_hash"))


def image_index(summaries: DataFrame, stored: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] = hash_embedded, doc_types: tuple[str, ...] | None = IMAGE_TYPES) -> DataFrame:
    """Rows to append to an image index: (id, description, source_chunk_id, image_path, doc_type, ..., image_hash, embedding).

    summaries: flattened image summaries; id is a hash of parent and path. doc_types: those to take (None: all)."""
    rows = summaries if doc_types is None else summaries.where(F.col("doc_type").isin(list(doc_types)))
    rows = rows.withColumn("id", F.sha2(F.concat_ws(chr(0), "source_chunk_id", "image_path"), 256))
    fresh = new_descriptions(rows, stored)
    return embed(fresh.withColumn("text", F.col("description"))).drop("text")


def nearest_images(queries: DataFrame, index: DataFrame, k: int, dim: int = 64, where=None) -> DataFrame:
    """(query_id, id, distance, similarity, image_similarity, rank): the k nearest image descriptions of every query.

    similarity is 1 - distance as for texts; image_similarity is the distance itself (smaller is
    nearer), which is what a promoted text carries. index: (id, embedding, ...)."""
    base = index.select(F.xxhash64("id").alias("vec_pos"), F.lit("images").alias("doc_type"), F.col("id").alias("chunk_id"), "embedding", *(c for c in index.columns if c not in ("id", "embedding", "vec_pos", "doc_type", "chunk_id")))
    hits = nearest(queries, base, k, dim, where, order="chunk_id")
    return hits.select("query_id", F.col("chunk_id").alias("id"), "distance", (1 - F.col("distance")).alias("similarity"), F.col("distance").alias("image_similarity"), "rank")
