"""Problem 6: items above their rule's token limit, cut into pieces at natural boundaries.

One regular expression with bounded quantifiers consumes a piece. Its alternatives are ordered by
the strength of the boundary that closes the piece: line end, sentence end, clause end, any token
end; the first three must hold at least half of the limit, so that a strong boundary near the start
doesn't give a tiny piece. A last alternative cuts inside a token that is longer than the allowed
characters. Offsets into the item's tokens, looked back from each piece's start, supply the
overlap. Everything is SQL array functions; no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import stripped, token_count
from ..functions.whitespace import NOT_WS, WS, WS_CHARS
from ..operators.chunking import items, let
from ..operators.rules import with_rule

#: Characters of one token beyond which it is cut inside (a piece of a text without white space).
TOKEN_CHARS = 10_000
_SENTENCE_END = "(?:(?<=[.!?…؟。])|(?<=[.!?…؟。][\"'”’»)]))"
_CLAUSE_END = "(?<=[,;:–—])"
_LINE = f"(?=[{WS_CHARS.replace(chr(10), '')}]*+\n|{WS}*+$)"


def piece_pattern(fresh: Column) -> Column:
    """Regular expression of one piece of up to `fresh` tokens with the white space after it."""
    token, gap = f"{NOT_WS}{{1,{TOKEN_CHARS}}}+", f"{WS}++"
    low = F.greatest(F.lit(0), F.floor(fresh / 2).cast("int") - 1)
    count = lambda least: F.concat(F.lit(f"(?:{token}{gap}){{"), least.cast("string"), F.lit(","), (fresh - 1).cast("string"), F.lit(f"}}{token}(?!{NOT_WS})"))
    strong = [F.concat(count(low), F.lit(end)) for end in (_LINE, _SENTENCE_END, _CLAUSE_END)]
    weak = [count(F.lit(0)), F.lit(token)]
    return F.concat(F.lit("(?:"), F.concat_ws("|", *strong, *weak), F.lit(f"){WS}*+"))


def pieces(item: Column, most: Column, overlap: Column) -> Column:
    """Array of (text, tokens, overlap, start) of one item; an item within the limit is one piece.

    Every piece has at most `most` whitespace tokens, overlap included; neighbours share `overlap`
    tokens (fewer only where the item's start is nearer, or where `most` leaves no room: at most
    most - 1). Without the overlaps, the pieces joined are the item. In an item above the limit, a
    token of more than TOKEN_CHARS characters counts as several, each of so many characters at
    most. A blank item gives none, null gives null.
    """
    shared = F.greatest(F.lit(0), F.least(overlap, most - 1))
    kind = "array<struct<text:string,tokens:int,overlap:int,start:int>>"
    # Pieces are sliced from the same runs of characters as those of which they are counted.
    run = f"{NOT_WS}{{1,{TOKEN_CHARS}}}+"
    start = F.struct(F.array().cast("array<struct<start:int,n:int>>").alias("a"), F.lit(0).alias("at"))

    def cut(whole: Column) -> Column:
        counts = F.transform(F.regexp_extract_all(whole, piece_pattern(most - shared), F.lit(0)), lambda p: F.regexp_count(p, F.lit(run)))
        places = F.aggregate(
            counts, start, lambda acc, n: F.struct(F.concat(acc["a"], F.array(F.struct(acc["at"].alias("start"), n.alias("n")))).alias("a"), (acc["at"] + n).alias("at")), lambda acc: acc["a"]
        )

        def piece(spaced: Column, p: Column) -> Column:
            back = F.least(shared, p["start"])
            text = F.array_join(F.slice(spaced, p["start"] - back + 1, p["n"] + back), "")
            return F.struct(stripped(text).alias("text"), (p["n"] + back).alias("tokens"), back.alias("overlap"), p["start"].alias("start"))

        return let(F.regexp_extract_all(whole, F.lit(f"({run}{WS}*)"), F.lit(1)), lambda spaced: F.transform(places, lambda p: piece(spaced, p)))

    def of(whole: Column) -> Column:
        one = lambda n: F.array(F.struct(whole.alias("text"), n.alias("tokens"), F.lit(0).alias("overlap"), F.lit(0).alias("start")))
        choose = lambda n: F.when(n == 0, F.array()).when(n <= most, one(n)).otherwise(cut(whole))
        return let(F.regexp_count(whole, F.lit(f"{NOT_WS}+")), choose)

    return F.when(item.isNotNull(), let(stripped(item), of)).cast(kind)


def oversized(segments: DataFrame, rules: DataFrame, distinct: bool = True) -> DataFrame:
    """(ord, item_no, item, max_tokens, overlap) of the items above their rule's limit, repeated rows once.

    A segment's rule is that of exactly its doc_type, else 'default'; null contents have no items.
    """
    rows = with_rule(segments.select("ord", "content", F.col("meta.doc_type").alias("doc_type")).where("content is not null"), rules)
    # A content within the limit holds no item above it: most segments end here.
    rows = rows.where(token_count("content") > F.col("rule.max_tokens"))
    every = rows.select("ord", "rule", F.posexplode(items(F.col("content"), F.col("rule.strategy"))).alias("item_no", "item"))
    rows = every.where(token_count("item") > F.col("rule.max_tokens")).select("ord", "item_no", "item", "rule.max_tokens", "rule.overlap")
    return rows.distinct() if distinct else rows


def split_oversized(segments: DataFrame, rules: DataFrame, distinct: bool = True) -> DataFrame:
    """(ord, item_no, piece_no, text, tokens, overlap): the pieces of every oversized item."""
    rows = oversized(segments, rules, distinct).select("ord", "item_no", F.posexplode(pieces(F.col("item"), F.col("max_tokens"), F.col("overlap"))).alias("piece_no", "p"))
    return rows.select("ord", "item_no", "piece_no", "p.text", "p.tokens", "p.overlap")


def found(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """Problem 6's cases: (ord, item_no) of the items that had to be cut."""
    return split_oversized(segments, rules, distinct=False).select("ord", "item_no").distinct()
