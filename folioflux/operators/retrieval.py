"""Exact nearest neighbours over per-type vector partitions, late fusion, image promotion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import content_hash

#: Query vectors that are broadcast at most; more are searched in blocks of so many.
QUERY_BLOCK = 4_096
_HITS = "query_id long, retriever string, vec_pos long, chunk_id string, distance double"
_HITS_ARROW = pa.schema([("query_id", pa.int64()), ("retriever", pa.string()), ("vec_pos", pa.int64()), ("chunk_id", pa.string()), ("distance", pa.float64())])


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors of exactly dim numbers, none null or NaN, not all zero; repeated rows once."""
    ok = (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_pos").isNotNull()).where(ok)
    return rows.select("vec_pos", F.coalesce("doc_type", F.lit("default")).alias("doc_type"), "chunk_id", "embedding").distinct()


def nearest(queries: DataFrame, index: DataFrame, k: int, dim: int = 64, where=None, order: str = "vec_pos") -> DataFrame:
    """(query_id, retriever, vec_pos, chunk_id, distance, rank): k nearest of every query in every partition (doc_type).

    distance is the squared Euclidean distance; ties go to the smaller vec_pos (or chunk_id, by
    order). queries: (query_id, embedding), of which those of the right length without NaN are asked. where: a filter
    on the index before the search. A few queries are broadcast; more are cut into blocks that meet
    every part of the index in a task of their own. Either way a task keeps k hits a query and
    partition, so only those are shuffled."""
    spark = index.sparkSession
    base = usable(index if where is None else index.where(where), dim)
    asked = queries.where((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))).select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    few = asked.limit(QUERY_BLOCK + 1).toArrow()
    if len(few) <= QUERY_BLOCK:
        shared = spark.sparkContext.broadcast((few["query_id"].to_numpy(), _matrix(few["embedding"].combine_chunks(), dim)))
        out = base.mapInArrow(_scan(shared, k, dim), _HITS)
    else:
        blocks, parts = -(-asked.count() // QUERY_BLOCK), spark.sparkContext.defaultParallelism
        left = asked.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        right = base.select("*", F.pmod(F.xxhash64("vec_pos", "chunk_id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

        def compare(key, q, x):
            import pandas as pd

            if not len(q) or not len(x):
                return pd.DataFrame({n: [] for n in ("query_id", "retriever", "vec_pos", "chunk_id", "distance")})
            rows = _near(q["query_id"].to_numpy(), np.array(q["embedding"].tolist(), np.float64), x["vec_pos"].to_numpy(), x["doc_type"].to_numpy(object), pa.array(x["chunk_id"], pa.string()), np.array(x["embedding"].tolist(), np.float64), k)
            return pa.Table.from_batches(list(rows), schema=_HITS_ARROW).to_pandas()

        out = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(compare, _HITS)
    w = Window.partitionBy("query_id", "retriever").orderBy("distance", order)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _near(ids, q, pos, kind, chunk, x, k: int):
    """Batches of the k nearest of every query in every kind, ties included."""
    qq = (q * q).sum(1)
    for t in sorted(set(kind)):
        own = np.nonzero(kind == t)[0]
        y = x[own]
        near = qq[:, None] + (y * y).sum(1)[None] - 2 * q @ y.T
        n = min(len(own), k)
        edge = np.partition(near, n - 1, axis=1)[:, n - 1] + 1e-9
        qs, es = np.nonzero(near <= edge[:, None])
        exact = ((q[qs] - y[es]) ** 2).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids[qs], pa.int64()), pa.array([t] * len(qs), pa.string()), pa.array(pos[own[es]]), chunk.take(pa.array(own[es])), pa.array(exact)], schema=_HITS_ARROW)


def _scan(shared, k: int, dim: int):
    def run(batches):
        ids, q = shared.value
        for batch in batches:
            if batch.num_rows and len(ids):
                yield from _near(ids, q, batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), batch.column(2), _matrix(batch.column(3), dim), k)

    return run


def late_fusion(hits: DataFrame, k: int) -> DataFrame:
    """The k best of a query over all partitions by similarity (1 - distance), with their rank."""
    w = Window.partitionBy("query_id").orderBy("distance", "vec_pos")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("similarity", 1 - F.col("distance"))


def collapsed(hits: DataFrame) -> DataFrame:
    """One row a query and chunk: position of its first hit, values of its last one (by rank)."""
    return hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.max_by("distance", "rank").alias("distance"))


def promoted(hits: DataFrame, images: DataFrame) -> DataFrame:
    """Hits with the images whose parent they are: image_summaries, promoted_by_image. Hits without images keep null and false."""
    own = images.where("source_chunk_id is not null and image_path is not null").select("source_chunk_id", "image_path", "description").distinct()
    grouped = own.groupBy("source_chunk_id").agg(F.array_sort(F.collect_list(F.struct("image_path", "description"))).alias("image_summaries"))
    out = hits.join(grouped, hits.chunk_id == grouped.source_chunk_id, "left").drop("source_chunk_id")
    return out.withColumn("promoted_by_image", F.col("image_summaries").isNotNull())


def orphans(images: DataFrame, hits: DataFrame) -> DataFrame:
    """Images whose parent is not among the hits (or is null)."""
    return images.join(hits.select(F.col("chunk_id").alias("source_chunk_id")).distinct(), "source_chunk_id", "left_anti")


def index_stats(vectors: DataFrame) -> DataFrame:
    """(doc_type, dim, vectors): largest length and number of rows of every partition."""
    return vectors.groupBy("doc_type").agg(F.max(F.size("embedding")).alias("dim"), F.count("*").alias("vectors"))


class IndexBroken(Exception):
    """Vectors and metadata of an index don't belong together."""


def discovered(index: DataFrame, metadata: DataFrame) -> DataFrame:
    """(doc_type): the partitions that have both vectors and metadata."""
    return index.select("doc_type").distinct().join(metadata.select("doc_type").distinct(), "doc_type", "left_semi")


def integrity(index: DataFrame, metadata: DataFrame) -> DataFrame:
    """(doc_type, vectors, metadata, ok): rows of both by partition; ok where they are as many."""
    count = lambda df, name: df.groupBy(F.coalesce("doc_type", F.lit("default")).alias("doc_type")).agg(F.count("*").alias(name))
    both = count(index, "vectors").join(count(metadata, "metadata"), "doc_type", "full")
    both = both.select("doc_type", F.coalesce("vectors", F.lit(0)).alias("vectors"), F.coalesce("metadata", F.lit(0)).alias("metadata"))
    return both.withColumn("ok", F.col("vectors") == F.col("metadata"))


def checked(index: DataFrame, metadata: DataFrame) -> DataFrame:
    """The index; raises IndexBroken where a partition has another number of vectors than of metadata rows."""
    wrong = integrity(index, metadata).where(~F.col("ok")).limit(10).collect()
    if wrong:
        raise IndexBroken("; ".join(f"{r.doc_type}: {r.vectors} vectors, {r.metadata} metadata rows" for r in wrong))
    return index


#: Retrieval strategies by name: (queries, index, k, dim, where) to ranked hits with similarity.
STRATEGIES = {"late_fusion": lambda queries, index, k, dim=64, where=None: late_fusion(nearest(queries, index, k, dim, where), k)}


def strategy(name: str):
    """The strategy of a name; an unknown one raises ValueError."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}")
    return STRATEGIES[name]


def asked_twice(questions: list[str], translate=None) -> list[tuple[int, int, str]]:
    """(query_id, q_ord, text): every question, and its translation where that says something else.

    A translation that fails is left out."""
    out = []
    for i, text in enumerate(questions):
        out.append((i, 0, text))
        if translate is not None:
            try:
                other = translate(text)
            except Exception:  # noqa: BLE001 - without a translation the question itself is asked
                other = text
            if other and other != text:
                out.append((i, 1, other))
    return out


def final_results(hits: DataFrame, images: DataFrame) -> DataFrame:
    """What a question gets out of the hits of all its query vectors, in order.

    hits: (query_id, q_ord, rank, chunk_id, text, similarity); images: (query_id, q_ord, rank, id,
    source_chunk_id, image_path, description, image_similarity). A text that several vectors found
    stands where the first did, with the values of the last. Images whose parent is among the texts
    are added to it (image_summaries in order, promoted_by_image, image_similarity of the last);
    the others follow after the texts. Rows without content, and all but the first with the same
    content, are left out. Gives (query_id, rank, kind, id, content, similarity, image_summaries,
    promoted_by_image, image_similarity); rank counts anew, nothing is cut off.
    """
    place = F.struct("q_ord", "rank")
    texts = hits.groupBy("query_id", "chunk_id").agg(F.min(place).alias("place"), F.max_by(F.struct("text", "similarity"), place).alias("v"))
    shown = images.select("query_id", place.alias("place"), "id", "source_chunk_id", "image_path", "description", "image_similarity")
    parents = texts.select("query_id", F.col("chunk_id").alias("source_chunk_id"))
    of_text = shown.join(parents, ["query_id", "source_chunk_id"], "left_semi").groupBy("query_id", F.col("source_chunk_id").alias("chunk_id")).agg(
        F.array_sort(F.collect_list(F.struct("place", "id", "image_path", "description"))).alias("s"), F.max_by("image_similarity", F.struct("place", "id")).alias("image_similarity")
    )
    summaries = F.transform("s", lambda x: F.struct(x["image_path"].alias("image_path"), x["description"].alias("description")))
    text_rows = texts.join(of_text, ["query_id", "chunk_id"], "left").select(
        "query_id", F.lit(0).alias("after"), "place", F.lit("text").alias("kind"), F.col("chunk_id").alias("id"), F.col("v.text").alias("content"), "v.similarity",
        summaries.alias("image_summaries"), F.col("s").isNotNull().alias("promoted_by_image"), "image_similarity",
    )
    image_rows = shown.join(parents, ["query_id", "source_chunk_id"], "left_anti").select(
        "query_id", F.lit(1).alias("after"), "place", F.lit("image").alias("kind"), "id", F.col("description").alias("content"), (1 - F.col("image_similarity")).alias("similarity"),
        F.lit(None).cast("array<struct<image_path:string,description:string>>").alias("image_summaries"), F.lit(False).alias("promoted_by_image"), "image_similarity",
    )
    order = F.struct("after", "place", "id")
    rows = text_rows.unionByName(image_rows).withColumn("o", order).withColumn("h", content_hash("content")).where("content <> ''")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "h").orderBy("o"))).where("r = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("o"))
    return rows.select("query_id", rank.alias("rank"), "kind", "id", "content", "similarity", "image_summaries", "promoted_by_image", "image_similarity")
