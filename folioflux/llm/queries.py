"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, email_new_text, incremental, leakage, near_duplicates, privacy, spam_pages, splitting, token_budget, vector_neighbors
from .runtime import table

#: The 29 white-space characters as DuckDB's regex engine writes them. Fixed value.
WS_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def p1_found(spark, d):
    return token_budget.wrong_counts(table(spark, d, "chunks"))


def p1_totals(spark, d):
    return token_budget.totals(table(spark, d, "chunks"))


def p2_found(spark, d):
    return vector_neighbors.found_pairs(table(spark, d, "vectors"))


def p2_neighbours(spark, d):
    return vector_neighbors.query_neighbours(table(spark, d, "vectors"))


def p3_found(spark, d):
    return privacy.detected(privacy.records(table(spark, d, "segments"), table(spark, d, "chunks")), table(spark, d, "name_parts"))


def p3_redacted(spark, d):
    return privacy.redacted(privacy.records(table(spark, d, "segments"), table(spark, d, "chunks")), table(spark, d, "name_parts"), b"folioflux")


def p3_surrogates(spark, d):
    return privacy.redacted(privacy.records(table(spark, d, "segments"), table(spark, d, "chunks")), table(spark, d, "name_parts"), b"folioflux", surrogates=True)


def p4_found(spark, d):
    return incremental.found_rows(table(spark, d, "chunks"))


def p4_links(spark, d):
    return incremental.scored_links(table(spark, d, "chunks"))


def p4_clusters(spark, d):
    return incremental.clustered_rows(table(spark, d, "chunks"))


def p5_found(spark, d):
    return email_new_text.found(table(spark, d, "segments"))


def p5_new_text(spark, d):
    return email_new_text.new_text(table(spark, d, "segments"))


def p5_new_chunk_text(spark, d):
    return email_new_text.new_chunk_text(table(spark, d, "segments"), table(spark, d, "chunks"))


def p6_found(spark, d):
    return splitting.found(table(spark, d, "segments"), table(spark, d, "rules"))


def p6_pieces(spark, d):
    return splitting.split_oversized(table(spark, d, "segments"), table(spark, d, "rules"))


def p7_groups(spark, d):
    return near_duplicates.groups(table(spark, d, "chunks"))


def p7_members(spark, d):
    return near_duplicates.memberships(table(spark, d, "chunks"))


def p7_links(spark, d):
    return near_duplicates.class_pairs(table(spark, d, "chunks"))


def p7_found(spark, d):
    return near_duplicates.found_pairs(table(spark, d, "chunks"))


def p8_ids(spark, d):
    return bpe.encoded(table(spark, d, "documents"))


def p8_round_trip(spark, d):
    """Texts that differ from what their ids give back, with problem 8's encoder and decoder; none should."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = bpe.decoded(bpe.encoded(docs)).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").where(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("back"))).select("doc_id")


def p9_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_near(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), window=24, edits=2, recall=0.95)


def p10_found(spark, d):
    return spam_pages.found(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_totals": p1_totals,
    "p2_found": p2_found,
    "p2_neighbours": p2_neighbours,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p3_surrogates": p3_surrogates,
    "p4_found": p4_found,
    "p4_links": p4_links,
    "p4_clusters": p4_clusters,
    "p5_found": p5_found,
    "p5_new_text": p5_new_text,
    "p5_new_chunk_text": p5_new_chunk_text,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
    "p7_members": p7_members,
    "p7_links": p7_links,
    "p8_ids": p8_ids,
    "p8_round_trip": p8_round_trip,
    "p9_found": p9_found,
    "p9_near": p9_near,
    "p10_found": p10_found,
}

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_NEAR = f"""w AS (SELECT DISTINCT chunk_id, {_WORDS} AS w FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
    t AS (SELECT chunk_id, w, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 8),
    n AS (SELECT row_number() OVER () AS k, chunk_id, s, len(s) AS size FROM t),
    u AS (SELECT k, unnest(s) AS g FROM n),
    c AS (SELECT x.k AS a, y.k AS b, count(*) AS common FROM u AS x JOIN u AS y ON x.g = y.g AND x.k < y.k GROUP BY ALL),
    p AS (SELECT DISTINCT least(m.chunk_id, o.chunk_id) AS chunk_id_a, greatest(m.chunk_id, o.chunk_id) AS chunk_id_b
          FROM c JOIN n AS m ON m.k = c.a JOIN n AS o ON o.k = c.b WHERE m.chunk_id <> o.chunk_id AND 5 * common >= 3 * (m.size + o.size - common))"""


def _classes(width: int, num: int, den: int, least: int, both: str = "") -> str:
    """Common table expressions: rows (with their class), classes, links between classes, groups as (node, root)."""
    words = " || ' ' || ".join(["w[i]", *(f"w[i + {k}]" for k in range(1, width))])
    return f"""RECURSIVE r AS (SELECT DISTINCT {both}chunk_id, {_WORDS} AS w FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
    m AS (SELECT DISTINCT {both}chunk_id, md5(array_to_string(w, ' ')) AS class_id FROM r WHERE len(w) >= {least}),
    n AS (SELECT class_id, s, len(s) AS size FROM (SELECT md5(array_to_string(w, ' ')) AS class_id,
          list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: {words})) AS s FROM (SELECT DISTINCT w FROM r WHERE len(w) >= {least}))),
    u AS (SELECT class_id, unnest(s) AS g FROM n),
    c AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS common FROM u AS x JOIN u AS y ON x.g = y.g AND x.class_id < y.class_id GROUP BY ALL),
    l AS (SELECT a, b, common, p.size + q.size - common AS shingles FROM c JOIN n AS p ON p.class_id = a JOIN n AS q ON q.class_id = b WHERE {den} * common >= {num} * (p.size + q.size - common)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    t AS (SELECT class_id AS node, class_id AS root FROM n UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.node),
    g AS (SELECT node, min(root) AS root FROM t GROUP BY node)"""


def _groups(width: int, num: int, den: int, least: int) -> str:
    return f"""WITH {_classes(width, num, den, least)}
        SELECT m.chunk_id, m.class_id, g.root AS group_id, coalesce(d.links, 0) AS links, k.copies FROM m JOIN g ON g.node = m.class_id
        JOIN (SELECT class_id, count(*) AS copies FROM m GROUP BY 1) AS k ON k.class_id = m.class_id LEFT JOIN (SELECT a, count(*) AS links FROM e GROUP BY 1) AS d ON d.a = m.class_id"""


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{WS_SQL}+'), lambda t: t <> ''))"


_ITEMS = f"""s AS (SELECT DISTINCT ord, content, coalesce(r.strategy, f.strategy) AS strategy, coalesce(r.max_tokens, f.max_tokens) AS most, coalesce(r.overlap, f.overlap) AS lap
               FROM segments AS s LEFT JOIN rules AS r ON r.doc_type = s.meta.doc_type, (SELECT * FROM rules WHERE doc_type = 'default') AS f WHERE content IS NOT NULL),
    c AS (SELECT ord, most, lap, CASE strategy WHEN 'by_paragraph' THEN regexp_split_to_array(content, '\\n{WS_SQL}*\\n') WHEN 'by_slide' THEN string_split(content, chr(10) || '---' || chr(10))
          WHEN 'split_on_sheets' THEN [content] WHEN 'blank_line' THEN string_split(content, chr(10) || chr(10)) ELSE string_split(content, chr(10)) END AS parts FROM s),
    i AS (SELECT ord, most, lap, list_filter(list_transform(parts, lambda x: {_strip('x')}), lambda x: x <> '') AS items FROM c),
    n AS (SELECT ord, most, lap, unnest(range(len(items)))::INT AS item_no, unnest(items) AS item FROM i)"""


def _cut(at: str) -> str:
    """Tokens of the piece that begins after `at`: up to the last line, sentence or clause end of its second half, else as many as may be."""
    most = f"least(fresh, len(sp) - ({at}))"
    last = lambda kind: f"list_max(list_filter(range(low, {most} + 1), lambda j: ends[({at}) + j] = {kind} OR ({kind} = 3 AND ({at}) + j = len(sp))))"
    return f"coalesce({last(3)}, {last(2)}, {last(1)}, {most})"


ORACLES = {
    "p1_found": f"SELECT DISTINCT chunk_id FROM chunks WHERE text IS NOT NULL AND token_count IS DISTINCT FROM {_tokens('text')}",
    "p2_found": """
        WITH v AS (SELECT DISTINCT vec_pos, embedding::DOUBLE[] AS e FROM vectors WHERE len(embedding) = 64
                   AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        d AS (SELECT a.vec_pos AS a, b.vec_pos AS b, list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v AS a, v AS b WHERE a.vec_pos <> b.vec_pos),
        r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d)
        SELECT DISTINCT least(a, b) AS vec_pos_a, greatest(a, b) AS vec_pos_b FROM r WHERE r <= 10 AND d <= 0.2""",
    "p4_found": f"""
        WITH {_NEAR}, r AS (SELECT DISTINCT batch_id, chunk_id FROM chunks WHERE chunk_id IS NOT NULL),
        l AS (SELECT chunk_id_a AS x, chunk_id_b AS y FROM p UNION ALL SELECT chunk_id_b, chunk_id_a FROM p UNION ALL SELECT chunk_id, chunk_id FROM r)
        SELECT DISTINCT r.batch_id, r.chunk_id FROM r JOIN l ON l.x = r.chunk_id JOIN r AS q ON q.chunk_id = l.y AND q.batch_id < r.batch_id""",
    "p6_found": f"WITH {_ITEMS} SELECT DISTINCT ord, item_no FROM n WHERE {_tokens('item')} > most",
    "p6_pieces": f"""
        WITH RECURSIVE {_ITEMS}, o AS (SELECT row_number() OVER () AS k, ord, item_no, most - shared AS fresh, shared, sp, greatest(0, (most - shared) // 2 - 1) + 1 AS low,
            list_transform(sp, lambda x: CASE WHEN contains(x, chr(10)) THEN 3 WHEN regexp_matches({_strip('x')}, '[.!?…؟。]["''”’»)]?$') THEN 2 WHEN regexp_matches({_strip('x')}, '[,;:–—]$') THEN 1 ELSE 0 END) AS ends
            FROM (SELECT *, greatest(0, least(lap, most - 1)) AS shared, regexp_extract_all(item, '([^{WS_SQL[1:-1]}]+{WS_SQL}*)', 1) AS sp FROM (SELECT DISTINCT ord, item_no, item, most, lap FROM n WHERE {_tokens('item')} > most))),
        p AS (SELECT k, 0 AS piece_no, 0::BIGINT AS a, 0::BIGINT AS n FROM o UNION ALL
            SELECT p.k, piece_no + 1, a + p.n, {_cut('a + p.n')} FROM p JOIN o ON o.k = p.k WHERE a + p.n < len(sp))
        SELECT ord, item_no, piece_no - 1 AS piece_no, {_strip("array_to_string(sp[a - least(shared, a) + 1:a + p.n], '')")} AS text, (p.n + least(shared, a))::INT AS tokens, least(shared, a)::INT AS overlap
        FROM p JOIN o ON o.k = p.k WHERE piece_no > 0""",
    "p4_clusters": f"WITH {_classes(3, 3, 5, 8, 'batch_id, ')} SELECT m.batch_id, m.chunk_id, m.class_id, g.root AS cluster FROM m JOIN g ON g.node = m.class_id WHERE m.batch_id IS NOT NULL",
    "p7_groups": _groups(5, 4, 5, 5),
    "p7_members": _groups(3, 3, 5, 8),
    "p7_links": f"WITH {_classes(3, 3, 5, 8)} SELECT a AS class_id_a, b AS class_id_b, common, shingles FROM l",
    "p7_found": f"WITH {_NEAR} SELECT * FROM p",
    "p8_round_trip": "SELECT doc_id FROM documents WHERE false",
    "p9_found": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
        x AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM d),
        y AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM e)
        SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (g)""",
}
