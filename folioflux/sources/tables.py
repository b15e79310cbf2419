"""Tables between stages: chunk TSV, metadata JSON lines, Parquet by document type, run artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import exists

CHUNKS = "chunk_id string, doc_id string, text string, token_count int, meta_json string"


def read_chunk_tsv(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Chunks of TSV files with a header; a malformed row raises, or is left out (lenient)."""
    reader = spark.read.schema(CHUNKS).options(sep="\t", header=True, quote='"', escape='"', multiLine=True, mode="DROPMALFORMED" if lenient else "FAILFAST")
    return reader.csv(path)


def write_chunk_tsv(chunks: DataFrame, path: str) -> None:
    """Chunks as TSV, a folder for each doc_type; only the types at hand are replaced."""
    out = chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_type")
    out.options(sep="\t", header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_metadata(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; malformed ones are left out, or raise (strict)."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_index(vectors: DataFrame, path: str) -> None:
    """Vectors with their metadata appended in one write, by document type."""
    vectors.write.mode("append").partitionBy("doc_type").parquet(path)


def with_meta(chunks: DataFrame, schema: str = "map<string,string>", strict: bool = False) -> DataFrame:
    """chunks with meta, parsed from meta_json. What is no JSON object gives null, or ends the job (strict)."""
    mode = {"mode": "FAILFAST"} if strict else {}
    return chunks.withColumn("meta", F.from_json("meta_json", schema, mode))


def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, doc_type) of the chunk files (or folders of parts) chunks_<doc_type>.tsv in a folder; the type is what follows the first underscore."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/chunks_*.tsv")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    paths = [(f.getPath().toString(), f.getPath().getName()[len("chunks_") : -len(".tsv")]) for f in found]
    return spark.createDataFrame(sorted(paths), "path string, doc_type string")


def read_chunk_files(spark: SparkSession, folder: str, lenient: bool = False) -> DataFrame:
    """Chunks of all chunk files in a folder, with the doc_type of their file."""
    rows = read_chunk_tsv(spark, f"{folder.rstrip('/')}/chunks_*.tsv", lenient)
    name = F.regexp_extract(F.input_file_name(), r"/chunks_([^/]*)\.tsv(?:/[^/]*)?$", 1)
    return rows.withColumn("doc_type", F.url_decode(name))


def write_enriched(chunks: DataFrame, path: str, overwrite: bool = False) -> list[str]:
    """Enriched chunks by document type; types that are there already are kept unless overwrite. Gives the types written."""
    spark = chunks.sparkSession
    there = set()
    if not overwrite and exists(spark, path):
        there = {r.doc_type for r in spark.read.schema("doc_type string").parquet(path).distinct().collect()}  # types of documents: a few
    kinds = [r.doc_type for r in chunks.select("doc_type").distinct().collect() if r.doc_type not in there]
    if kinds:
        chunks.where(F.col("doc_type").isin(kinds)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_type").parquet(path)
    return sorted(kinds)


def read_index(spark: SparkSession, path: str, doc_types: list[str] | None = None) -> DataFrame:
    """Vectors with their metadata, of some document types (only their folders are read) or all; raises FileNotFoundError where there is no index."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    rows = spark.read.parquet(path)
    return rows if doc_types is None else rows.where(F.col("doc_type").isin(doc_types))


def save_images(images: DataFrame, folder: str) -> int:
    """Write images (image_path, content) below a folder that all executors share; gives their number.

    The first of several with one path is kept."""

    def write(batches):
        import pyarrow as pa
        from pathlib import Path

        for batch in batches:
            for name, blob in zip(*(c.to_pylist() for c in batch.columns)):
                file = Path(folder) / name
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_bytes(blob)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    once = images.groupBy("image_path").agg(F.min_by("content", F.struct(*(c for c in ("path", "seq") if c in images.columns), "image_path")).alias("content"))
    return once.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def write_run(spark: SparkSession, path: str, run_id: str, chunks: DataFrame, prompt: str, response: str, images: DataFrame | None = None, **metadata) -> None:
    """A run's chunks, image matches, prompt, response and metadata under <path>/run_id=<run_id>."""
    where = f"{path}/run_id={run_id}"
    chunks.write.mode("overwrite").json(f"{where}/retrieved_chunks")
    if images is not None:
        images.write.mode("overwrite").json(f"{where}/image_matches")
    row = spark.range(1).select(F.lit(prompt).alias("prompt"), F.lit(response).alias("response"))
    row.write.mode("overwrite").json(f"{where}/answer")
    if metadata:
        row = spark.range(1).select(F.lit(run_id).alias("run"), *[F.lit(str(v)).alias(k) for k, v in metadata.items()])
        row.write.mode("overwrite").json(f"{where}/run_metadata")
