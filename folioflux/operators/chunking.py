"""Splitting segments into items by strategy and merging items into chunks with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import cleaned, stripped, tokens
from ..functions.whitespace import WS
from .reporting import failed
from .rules import with_rule


def _pieces(parts: Column) -> Column:
    return F.filter(F.transform(parts, stripped), lambda x: x != "")


def by_paragraph(text) -> Column:
    """Items between blank lines; a line of white space only counts as blank."""
    return _pieces(F.split(text, f"\n{WS}*\n"))


def by_slide(text) -> Column:
    """Items between lines of exactly three hyphens."""
    return _pieces(F.split(text, "\n---\n"))


def by_sheet(text) -> Column:
    """The whole text as one item, none if it is blank."""
    return _pieces(F.array(text))


def by_blank_line(text) -> Column:
    """Items between two line feeds in a row; a line of white space only doesn't separate."""
    return _pieces(F.split(text, "\n\n"))


def by_row(text) -> Column:
    """One item a line."""
    return _pieces(F.split(text, "\n"))


def by_sentence(text) -> Column:
    """Sentences: cut at white space after a full stop, exclamation or question mark, also before closing quotes.

    An approximation of a trained sentence splitter, which the engine doesn't have.
    """
    return _pieces(F.split(text, f"(?<=[.!?…][\"'”’)]?){WS}+"))


#: Strategies by the names that rules use. Fixed values.
STRATEGIES = {
    "by_paragraph": by_paragraph, "paragraph": by_paragraph,
    "by_slide": by_slide, "slide": by_slide,
    "split_on_sheets": by_sheet, "sheet": by_sheet, "sheets": by_sheet,
    "blank_line": by_blank_line,
    "split_on_rows": by_row,
    "by_email_block": by_sentence, "eml": by_sentence,
}


def items(text: Column, strategy: Column) -> Column:
    """Items of a text by its row's strategy; null for an unknown one."""
    out = F.lit(None).cast("array<string>")
    for f in dict.fromkeys(STRATEGIES.values()):
        names = [k for k, v in STRATEGIES.items() if v is f]
        out = F.when(strategy.isin(names), f(text)).otherwise(out)
    return out


def reject_reason(doc_type: Column, strategy: Column) -> Column:
    """Why a segment cannot be chunked; null where it can."""
    return (
        F.when(doc_type.isNull() | (doc_type == ""), "doc_type is empty")
        .when(~strategy.isin(list(STRATEGIES)), F.concat(F.lit("unsupported strategy: "), strategy))
    )


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged(parts: Column, low: Column, high: Column, overlap: Column, has_images: Column) -> Column:
    """Chunks (text, token_count) of a segment's items, as a fold over them.

    The buffer is closed before an item with which it would reach `high` tokens (not counting the
    carried tail). A closed candidate - tail and buffer - is kept if it has `low` tokens or the
    segment has images; its last `overlap` tokens are the next tail in either case. The rest is
    kept whatever its size. So an item of `high` tokens is not split, a small candidate is lost
    but for its tail, and a first item of `high` tokens closes an empty candidate, which images
    (or low = 0) keep as an empty chunk. An empty list gives no chunk; null gives null.

    A candidate is always a run of the segment's tokens, so the fold goes over the items' token
    counts and carries places alone; texts are cut out once at the end.
    """
    zero = F.struct(F.array().cast("array<struct<at:int,n:int>>").alias("out"), F.lit(0).alias("from"), F.lit(0).alias("to"), F.lit(0).alias("n"))
    run = lambda acc: F.array(F.struct(acc["from"].alias("at"), (acc["to"] - acc["from"]).alias("n")))

    def step(acc: Column, k: Column) -> Column:
        full, held = acc["n"] + k >= high, acc["to"] - acc["from"]
        return F.struct(
            F.when(full & ((held >= low) | has_images), F.concat(acc["out"], run(acc))).otherwise(acc["out"]).alias("out"),
            F.when(full, acc["to"] - F.least(overlap, held)).otherwise(acc["from"]).alias("from"),
            (acc["to"] + k).alias("to"),
            F.when(full, k).otherwise(acc["n"] + k).alias("n"),
        )

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], run(acc))

    def chunks(each: Column) -> Column:
        runs = F.when(F.size(each) > 0, F.aggregate(F.transform(each, F.size), zero, step, finish)).otherwise(F.array().cast("array<struct<at:int,n:int>>"))
        cut = lambda every: F.transform(runs, lambda r: F.struct(F.array_join(F.slice(every, r["at"] + 1, r["n"]), " ").alias("text"), r["n"].alias("token_count")))
        return F.when(each.isNotNull(), let(F.flatten(each), cut))

    return let(F.transform(parts, tokens), chunks)


def chunk_id(doc_id, ord_, seq, text) -> Column:
    """Deterministic id: SHA-256 over document, segment, place and text, so that a repeated run gives the same ids."""
    return F.sha2(F.concat_ws(chr(0), doc_id, F.col(ord_).cast("string"), F.col(seq).cast("string"), text), 256)


def _typed(segments: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return segments.select(
        "ord", "content",
        F.coalesce("meta.doc_type", F.lit("default")).alias("doc_type"),
        F.coalesce("meta.source_filepath", "meta.doc_id", F.concat(F.lit("doc_"), F.col("ord").cast("string"))).alias("doc_id"),
        F.coalesce(F.size("meta.image_paths") > 0, F.lit(False)).alias("has_images"),
        *(F.col(f"meta.{c}").alias(c) for c in carry),
    )


def _ruled(segments: DataFrame, rules: DataFrame, strict: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """Segments with their rule and, where they can't be chunked, the reason."""
    rows = _typed(segments, carry)
    if not strict:
        rows = rows.withColumn("doc_type", F.coalesce(F.nullif("doc_type", F.lit("")), F.lit("default")))
    rows = with_rule(rows, rules)
    return rows.withColumn("reason", reject_reason(F.col("doc_type"), F.col("rule.strategy")))


def chunk_segments(segments: DataFrame, rules: DataFrame, clean: bool = True, strict: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, doc_id, doc_type, ord, seq, text, token_count) of all segments that have a runnable strategy.

    doc_type falls back to 'default' where it is missing, and, unless strict, where it is empty;
    doc_id falls back to 'doc_<ord>'. clean: mail cleaning of every type, as the data model has it;
    a document with a line 'From: ...' loses the rest. carry: fields of meta that the chunks keep.
    Null contents and rejects() give no chunk. One projection and one generator, no shuffle.
    """
    rows = _ruled(segments, rules, strict, carry).where("reason is null")
    text = cleaned(F.col("content")) if clean else F.col("content")
    parts = items(text, F.col("rule.strategy"))
    chunks = merged(parts, F.col("rule.min_tokens"), F.col("rule.max_tokens"), F.col("rule.overlap"), F.col("has_images"))
    out = rows.select("ord", "doc_id", "doc_type", *carry, F.posexplode(chunks).alias("seq", "c")).select("ord", "doc_id", "doc_type", *carry, "seq", "c.text", "c.token_count")
    return out.select(chunk_id("doc_id", "ord", "seq", "text").alias("chunk_id"), "doc_id", "doc_type", "ord", "seq", "text", "token_count", *carry)


def rejects(segments: DataFrame, rules: DataFrame, strict: bool = False) -> DataFrame:
    """(ord, doc_type, reason) of segments whose strategy is unsupported, or (strict) whose doc_type is empty."""
    return _ruled(segments, rules, strict).select("ord", "doc_type", "reason").where("reason is not null").distinct()


def outcomes(segments: DataFrame, rules: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_type, successes, errors, failed): how many segments could be chunked, and whether the step counts as failed under the soft policy."""
    rows = _ruled(segments, rules, strict).groupBy("doc_type").agg(F.count_if(F.col("reason").isNull()).alias("successes"), F.count_if(F.col("reason").isNotNull()).alias("errors"))
    return rows.select("doc_type", "successes", "errors", failed(F.col("errors"), F.col("successes")).alias("failed"))
