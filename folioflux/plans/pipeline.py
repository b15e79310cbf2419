"""Build and query pipelines out of the operators; models are plug-ins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.prompts import checked_template, context, context_item, source_name
from ..functions.text import content_hash
from ..operators.chunking import chunk_segments
from ..operators.dedup import first_wins, not_stored, with_content
from ..operators.embedding import hash_embedded
from ..operators.images import nearest_images
from ..operators.retrieval import asked_twice, final_results, strategy

TEMPLATE = "Answer from the context and name the source of every statement.\n\n{context_str}\n\nQuestion: {query_str}\nAnswer:"


def index_rows(chunks: DataFrame, stored: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] = hash_embedded, order: tuple[str, ...] = ("ord", "seq"), insight: bool = False) -> DataFrame:
    """Chunks with embeddings, ready to append: without empty and repeated texts, without stored hashes.

    Deduplication comes before the embedder, the costly step, which the optimiser would not move.
    insight: image summaries are embedded with the text, after hashing. vec_pos only orders ties; rows
    are told apart by chunk_id."""
    from ..operators.embedding import with_insight

    fresh = first_wins(with_content(chunks, "text").withColumn("content_hash", content_hash("text")), F.col("content_hash"), *order)
    if stored is not None:
        fresh = not_stored(fresh, F.col("content_hash"), stored.select("content_hash"))
    if insight and "image_summaries" in chunks.columns:
        plain = fresh.withColumn("__plain", F.col("text")).withColumn("text", with_insight(F.col("text"), F.transform("image_summaries", lambda s: s["description"])))
        done = embed(plain).withColumn("text", F.col("__plain")).drop("__plain")
    else:
        done = embed(fresh)
    return done.withColumn("vec_pos", F.xxhash64("chunk_id"))


def build_index(segments: DataFrame, rules: DataFrame, stored: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] = hash_embedded) -> DataFrame:
    """index_rows() of the chunks of segments."""
    return index_rows(chunk_segments(segments, rules), stored, embed)


def retrieve(
    spark: SparkSession, index: DataFrame, questions: list[str], k: int = 5, images: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] = hash_embedded, dim: int = 64,
    where=None, translate: Callable[[str], str] | None = None, strategy_name: str = "late_fusion",
) -> DataFrame:
    """final_results() for questions, with doc_id and page_number of what was found.

    index: (chunk_id, doc_id, text, embedding, vec_pos, ...). images: an image index; without one
    only texts are found. translate: asks every question in another form too. where: a filter on the index."""
    find = strategy(strategy_name)
    asked = asked_twice(questions, translate)
    rows = [(i, q, n, text) for n, (i, q, text) in enumerate(asked)]
    queries = embed(spark.createDataFrame(rows, "question long, q_ord int, query_id long, text string"))
    of = F.broadcast(queries.select(F.col("query_id").alias("vector_id"), "question", "q_ord"))
    page = lambda df: F.col("page_number") if "page_number" in df.columns else F.lit(None).cast("int")
    about = index.select("chunk_id", "doc_id", "text", page(index).alias("page_number"))
    hits = find(queries, index, k, dim, where).withColumnRenamed("query_id", "vector_id").join(of, "vector_id")
    hits = hits.join(about, "chunk_id").select(F.col("question").alias("query_id"), "q_ord", "rank", "chunk_id", "text", "similarity")
    sources = about.select(F.col("chunk_id").alias("id"), "doc_id", "page_number")
    if images is not None:
        shown = nearest_images(queries, images, k, dim).withColumnRenamed("query_id", "vector_id").join(of, "vector_id")
        shown = shown.join(images.select("id", "source_chunk_id", "image_path", "description"), "id")
        shown = shown.select(F.col("question").alias("query_id"), "q_ord", "rank", "id", "source_chunk_id", "image_path", "description", "image_similarity")
        name = F.col("source_filepath") if "source_filepath" in images.columns else F.lit(None).cast("string")
        sources = sources.unionByName(images.select("id", name.alias("doc_id"), page(images).alias("page_number")))
    else:
        shown = spark.createDataFrame([], "query_id long, q_ord int, rank int, id string, source_chunk_id string, image_path string, description string, image_similarity double")
    return final_results(hits, shown).join(sources, "id", "left")


@dataclass
class Answer:
    """An answer, its sources in the order of the context (a source that is used twice stands twice), and the prompt."""

    text: str
    sources: list[str]
    prompt: str


def answer_of(found: DataFrame, question: str, complete: Callable[[str], str], template: str = TEMPLATE) -> Answer:
    """Prompt and answer out of the retrieved rows of one question: (rank, doc_id, page_number, content). The rows are those of a top-k report."""
    checked_template(template)
    item = context_item(source_name(F.col("doc_id"), F.col("id")), F.col("content"), F.col("page_number"))
    source = F.concat(F.coalesce("doc_id", "id"), F.when(F.col("page_number") != 0, F.concat(F.lit(", page "), F.col("page_number").cast("string"))).otherwise(""))
    rows = found.select("rank", source.alias("source"), item.alias("item"))
    done = rows.agg(F.array_sort(F.collect_list(F.struct("rank", "source", "item"))).alias("r")).select(context(F.transform("r", lambda x: x["item"])).alias("c"), F.transform("r", lambda x: x["source"]).alias("s")).first()
    prompt = template.replace("{context_str}", done.c).replace("{query_str}", question)
    try:
        text = complete(prompt)
    except Exception as e:  # noqa: BLE001 - a model's failure is part of the answer
        text = f"[ERROR] {e}"
    return Answer(text, list(done.s), prompt)


def ask(spark: SparkSession, index: DataFrame, question: str, complete: Callable[[str], str], k: int = 5, template: str = TEMPLATE, where=None, dim: int = 64, embed: Callable[[DataFrame], DataFrame] = hash_embedded, **more) -> Answer:
    """Retrieve for a question, build the prompt, complete it; an error of the model is an answer '[ERROR] ...'. more: of retrieve()."""
    checked_template(template)
    return answer_of(retrieve(spark, index, [question], k, embed=embed, dim=dim, where=where, **more), question, complete, template)
