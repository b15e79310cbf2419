"""What the operators of this subpackage share: tables, the shared folder, spreading of work."""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..shared import exists, new_path, remove, written  # noqa: F401 - for the other modules

#: A word is a longest run of Unicode letters and digits in the lower-cased text.
_WORD = re.compile(r"[^\W_]+")
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Where the public vocabulary files lie; every operator takes a path of its own instead.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, by=None) -> DataFrame:
    """Repartition only where a scan gives fewer partitions than the cluster has cores.

    A small single-file input would otherwise keep one core busy; inputs of many splits stay as
    they are, without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *by) if by else df.repartition(cores)


def with_words(df: DataFrame, least: int, text: str = "text", counted: bool = False) -> DataFrame:
    """df with cls and words in place of a text: words are the text's lower-cased words between single
    spaces, cls a hash of them; both null where the text is null or has fewer than so many words.
    counted: with n, the number of the text's words, 0 for a null text."""
    keep = [c for c in df.columns if c != text]
    count = [T.StructField("n", T.IntegerType())] * counted
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("cls", T.LongType()), T.StructField("words", T.StringType()), *count])

    def run(batches):
        for batch in batches:
            cls, words, n = [], [], []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                own = _WORD.findall(t.lower()) if t else ()
                n.append(len(own))
                if len(own) >= max(1, least):
                    w = " ".join(own)
                    words.append(w)
                    cls.append(xxhash.xxh64_intdigest(w) - (1 << 63))
                else:
                    words.append(None)
                    cls.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(cls, pa.int64()), pa.array(words, pa.string()), *[pa.array(n, pa.int32())] * counted], names=schema.names)

    return spread(df.select(*keep, text)).mapInArrow(run, schema)


def shipped(spark: SparkSession, path: str):
    """A broadcast of a vocabulary file's bytes (a few MB), so that only the driver needs the file."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def norm_words(text) -> F.Column:
    """Lower-cased words of a text joined by single spaces ('' for a text without words)."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session; given explicitly where Python does the work after a shuffle,
    so that small rows with much work behind them aren't coalesced into one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
