"""Problem 1: token budget per file, source, language and domain."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import bpe
from .longest_match import load
from .runtime import TOKENIZERS, shipped, spread

VOCABULARY = f"{TOKENIZERS}/word_bpe_49k.json"
#: Spellings of languages beside the two-letter code. Fixed values.
LANGUAGES = {
    "english": "en", "eng": "en", "french": "fr", "fra": "fr", "fre": "fr", "german": "de", "deu": "de", "ger": "de",
    "spanish": "es", "spa": "es", "hebrew": "he", "heb": "he", "iw": "he",
}


def with_counts(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, exact: str | None = None) -> DataFrame:
    """df with ws_tokens and subword_tokens of a text column, and with bpe_tokens if exact is given.

    ws_tokens is the number of whitespace tokens, subword_tokens the number of pieces under the
    longest-match vocabulary; bpe_tokens is the number of ids that problem 8's encoder gives under
    the byte-pair vocabulary `exact`. A null text gives nulls, an empty or blank one 0 (bpe_tokens
    counts blanks). Other columns pass through untouched; columns already called so are replaced.
    Rows are neither dropped nor merged.
    """
    names = ["ws_tokens", "subword_tokens", *(["bpe_tokens"] if exact else [])]
    df = df.drop("ws_tokens", "subword_tokens", "bpe_tokens")
    schema = T.StructType([*df.schema, *(T.StructField(n, T.IntegerType() if n == "ws_tokens" else T.LongType()) for n in names)])
    file, ranks = shipped(df.sparkSession, vocabulary), shipped(df.sparkSession, exact) if exact else None

    def count(batches):
        counter = load(vocabulary, data=file.value)
        encoder = bpe.load(exact, ranks.value) if exact else None
        for batch in batches:
            out = []
            for t in batch.column(text).to_pylist():
                if t is None:
                    out.append((None,) * len(names))
                else:
                    tokens = t.split()
                    whole = (len(tokens), sum(map(counter.__getitem__, tokens)))
                    out.append((*whole, sum(map(len, map(encoder.__getitem__, bpe.PRETOKENS.findall(t))))) if exact else whole)
            counts = [pa.array(c, pa.int32() if n == "ws_tokens" else pa.int64()) for n, c in zip(names, zip(*out) if out else [[]] * len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts], names=[*batch.schema.names, *names])

    return df.mapInArrow(count, schema)


def json_text(column: str, key: str) -> F.Column:
    """A string value of a JSON object; a cut-off object still gives the keys that it holds whole."""
    cut = F.regexp_extract(column, f'"{key}"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)"', 1)
    return F.coalesce(F.get_json_object(column, f"$.{key}"), F.nullif(cut, F.lit("")))


def language(raw: F.Column) -> F.Column:
    """Two-letter code of a language however it is spelt; 'und' where there is none."""
    code = F.split(F.lower(F.trim(raw)), "[-_]")[0]
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    code = F.coalesce(known[code], code)
    return F.when(code.isNull() | (code == ""), "und").otherwise(code)


def slices(df: DataFrame) -> DataFrame:
    """df with source_filepath, source, lang and domain out of meta_json, in one spelling."""
    label = lambda c: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("unknown"))
    return df.select(
        "*",
        F.coalesce(json_text("meta_json", "source_filepath"), F.col("doc_id"), F.lit("unknown")).alias("source_filepath"),
        F.coalesce(F.nullif(F.trim(json_text("meta_json", "source")), F.lit("")), F.lit("unknown")).alias("source"),
        language(json_text("meta_json", "lang")).alias("lang"),
        label(json_text("meta_json", "domain")).alias("domain"),
    )


def counted(chunks: DataFrame, vocabulary: str = VOCABULARY, exact: str | None = None) -> DataFrame:
    return with_counts(spread(chunks), "text", vocabulary, exact)


def wrong_counts(chunks: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """chunk_id of chunks with a text whose token_count is null or not the number of whitespace tokens."""
    rows = counted(chunks.select("chunk_id", "text", "token_count").where(F.col("text").isNotNull()), vocabulary)
    return rows.where(~F.col("token_count").eqNullSafe(F.col("ws_tokens"))).select("chunk_id").distinct()


def totals(chunks: DataFrame, vocabulary: str = VOCABULARY, exact: str = bpe.VOCABULARY) -> DataFrame:
    """Totals by file, by source, by language, by domain, by all three, and of everything: chunks,
    whitespace tokens, longest-match pieces, and exact tokens of the byte-pair vocabulary `exact`.

    A chunk that is repeated, in its batch or in a later one, counts once: a chunk is its
    chunk_id with its text, and takes its slice from the delivery with the smallest meta_json
    (rows without one last). Chunks without a text count as chunks of 0 tokens. Counts are added
    up per (file, source, language, domain) before the slices are formed, so a source that holds
    most rows is summed where it is read.
    """
    rows = slices(counted(chunks.select("chunk_id", "doc_id", "text", "meta_json"), vocabulary, exact))
    once = rows.groupBy("chunk_id", F.xxhash64("text").alias("text_key"), F.length("text").alias("text_length")).agg(
        F.min(F.struct(F.col("meta_json").isNull().alias("late"), "meta_json", "source_filepath", "source", "lang", "domain")).alias("m"),
        F.max("ws_tokens").alias("ws_tokens"),
        F.max("subword_tokens").alias("subword_tokens"),
        F.max("bpe_tokens").alias("bpe_tokens"),
    )
    sums = [F.sum(c).cast("long").alias(c) for c in ("chunks", "ws_tokens", "subword_tokens", "bpe_tokens")]
    fine = (
        once.select("m.source_filepath", "m.source", "m.lang", "m.domain", F.lit(1).alias("chunks"), F.coalesce("ws_tokens", F.lit(0)).alias("ws_tokens"), F.coalesce("subword_tokens", F.lit(0)).alias("subword_tokens"), F.coalesce("bpe_tokens", F.lit(0)).alias("bpe_tokens"))
        .groupBy("source_filepath", "source", "lang", "domain").agg(*sums)
    )
    key = [F.col(c) for c in ("source_filepath", "source", "lang", "domain")]
    f, s, g, d = key
    return fine.groupingSets([[f], [s], [g], [d], [s, g, d], []], f, s, g, d).agg(*sums)
