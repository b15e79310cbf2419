"""Queries over the test tables, each with its SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import prompts as P, text as T
from .operators import chunking as C, dedup as D, embedding as M, enrich as E, images as I, reporting as R, retrieval as V, rules as U

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_EOL = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
QUERIES, ORACLES = {}, {}


def _tok(x):
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda t: t <> '')"


def _strip(x):
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _lines(x):
    parts = f"regexp_split_to_array({x}, '{_EOL}')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _text(spark, d):
    return _t(spark, d, "segments").select("ord", "content").distinct()


@query(f"SELECT ord, len({_tok('content')}) AS n FROM (SELECT DISTINCT ord, content FROM segments)")
def token_count(spark, d):
    return _text(spark, d).select("ord", T.token_count("content").alias("n"))


@query(f"SELECT ord, array_to_string({_tok('content')}, ' ') AS t FROM (SELECT DISTINCT ord, content FROM segments)")
def ws_normalize(spark, d):
    return _text(spark, d).select("ord", T.normalized("content").alias("t"))


@query(f"SELECT ord, sha256({_strip('content')}) AS h FROM (SELECT DISTINCT ord, content FROM segments)")
def content_hash(spark, d):
    return _text(spark, d).select("ord", T.content_hash("content").alias("h"))


@query(f"SELECT DISTINCT ord, sha256({_strip('content')} || coalesce(array_to_string(meta.image_paths, ','), '')) AS h FROM segments")
def segment_hash_images(spark, d):
    return _t(spark, d, "segments").select("ord", T.segment_hash(F.col("content"), F.col("meta.image_paths")).alias("h")).distinct()


@query("SELECT ord, CASE WHEN regexp_matches(content, '[\\x{590}-\\x{5ff}]') THEN 'rtl' WHEN content IS NOT NULL THEN 'ltr' END AS dir FROM (SELECT DISTINCT ord, content FROM segments)")
def text_direction(spark, d):
    return _text(spark, d).select("ord", T.direction("content").alias("dir"))


@query(f"SELECT ord, replace({_strip('content[1:80]')}, chr(10), ' ') AS p FROM (SELECT DISTINCT ord, content FROM segments)")
def preview(spark, d):
    return _text(spark, d).select("ord", T.preview("content").alias("p"))


@query("SELECT DISTINCT p AS path, replace(regexp_replace(regexp_extract(p, '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1'), ' ', '_') AS stem FROM (SELECT meta.source_filepath AS p FROM segments)")
def filename_stem(spark, d):
    return _t(spark, d, "segments").select(F.col("meta.source_filepath").alias("path"), T.stem("meta.source_filepath").alias("stem")).distinct()


@query("SELECT DISTINCT p AS path, nullif(regexp_extract(p, '^(.*?data/projects/[^/]+)(?:/|$)', 1), '') AS root FROM (SELECT meta.source_filepath AS p FROM segments)")
def project_root(spark, d):
    return _t(spark, d, "segments").select(F.col("meta.source_filepath").alias("path"), T.project_root("meta.source_filepath").alias("root")).distinct()


def _clean_sql(quoted, replies, signature):
    stops = [s for s, on in ((f"starts_with({_strip('x')}, '-- ')", signature), (f"regexp_matches({_strip('x')}, '^(On .+ wrote:|From: .+)$')", replies)) if on]
    kept = "l"
    if stops:
        first = f"list_position(list_transform(l, lambda x: {' OR '.join(stops)}), true)"
        kept = f"(CASE WHEN {first} > 0 THEN l[:{first} - 1] ELSE l END)"
    if quoted:
        kept = f"list_filter({kept}, lambda x: NOT starts_with({_strip('x')}, '>'))"
    joined = f"array_to_string({kept}, chr(10))"
    return f"SELECT ord, {_strip(joined)} AS t FROM (SELECT DISTINCT ord, {_lines('content')} AS l FROM segments)"


def _cleaner(name, quoted, replies, signature):
    def run(spark, d):
        return _text(spark, d).select("ord", T.cleaned("content", quoted, replies, signature).alias("t"))

    run.__name__ = name
    query(_clean_sql(quoted, replies, signature))(run)


_cleaner("clean_quoted", True, False, False)
_cleaner("clean_reply_cut", False, True, False)
_cleaner("clean_signature_cut", False, False, True)
_cleaner("clean_all", True, True, True)


def _splitter(name, f, sql):
    def run(spark, d):
        return _text(spark, d).select("ord", F.posexplode(f("content")).alias("item_no", "item"))

    run.__name__ = name
    pieces = f"list_filter(list_transform({sql}, lambda x: {_strip('x')}), lambda x: x <> '')"
    query(f"SELECT ord, unnest(range(len(p)))::INT AS item_no, unnest(p) AS item FROM (SELECT ord, {pieces} AS p FROM (SELECT DISTINCT ord, content FROM segments WHERE content IS NOT NULL))")(run)


_splitter("split_paragraph", C.by_paragraph, f"regexp_split_to_array(content, '\\n{_WS}*\\n')")
_splitter("split_slide", C.by_slide, "string_split(content, chr(10) || '---' || chr(10))")
_splitter("split_sheet", C.by_sheet, "[content]")
_splitter("split_blank_line", C.by_blank_line, "string_split(content, chr(10) || chr(10))")
_splitter("split_rows", C.by_row, "string_split(content, chr(10))")


@query(f"""SELECT ord, unnest(range(len(p)))::INT AS item_no, unnest(p) AS item FROM (SELECT ord, list_filter(list_transform(
       string_split(regexp_replace(content, '([.!?…]["''”’)]?){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') AS p
       FROM (SELECT DISTINCT ord, content FROM segments WHERE content IS NOT NULL))""")
def split_sentences(spark, d):
    return _text(spark, d).select("ord", F.posexplode(C.by_sentence("content")).alias("item_no", "item"))


@query("""SELECT DISTINCT s.ord, coalesce(r.strategy, f.strategy) AS strategy, coalesce(r.min_tokens, f.min_tokens) AS min_tokens,
       coalesce(r.max_tokens, f.max_tokens) AS max_tokens, coalesce(r.overlap, f.overlap) AS overlap
       FROM segments s LEFT JOIN rules r ON r.doc_type = s.meta.doc_type CROSS JOIN (SELECT * FROM rules WHERE doc_type = 'default') f""")
def rule_lookup(spark, d):
    s = _t(spark, d, "segments").select("ord", F.col("meta.doc_type").alias("doc_type"))
    return U.with_rule(s, _t(spark, d, "rules")).select("ord", "rule.*").distinct()


@query("SELECT DISTINCT doc_type FROM rules")
def rule_doc_types(spark, d):
    return U.doc_types(_t(spark, d, "rules"))


def _lines_cleaned(x):
    """Cleaned lines as one text, as T.cleaned() gives it."""
    lines = _lines(x)
    first = f"list_position(list_transform(l, lambda x: starts_with({_strip('x')}, '-- ') OR regexp_matches({_strip('x')}, '^(On .+ wrote:|From: .+)$')), true)"
    kept = f"list_filter((CASE WHEN {first} > 0 THEN l[:{first} - 1] ELSE l END), lambda x: NOT starts_with({_strip('x')}, '>'))"
    return lines, _strip(f"array_to_string({kept}, chr(10))")


def _merge_sql(sep="|| chr(0) ||"):
    """The merge fold as a recursive query: one step an item, chunks as runs of the segment's tokens."""
    lines, clean = _lines_cleaned("content")
    items = f"list_filter(list_transform(parts, lambda x: {_strip('x')}), lambda x: x <> '')"
    return f"""RECURSIVE raw AS (SELECT DISTINCT ord, content, meta FROM segments WHERE content IS NOT NULL),
    t AS (SELECT row_number() OVER () AS k, ord, {lines} AS l, coalesce(nullif(meta.doc_type, ''), 'default') AS doc_type, coalesce(meta.source_filepath, meta.doc_id, 'doc_' || ord) AS doc_id,
          coalesce(len(meta.image_paths) > 0, false) AS img FROM raw),
    c AS (SELECT k, ord, doc_type, doc_id, img, {clean} AS content FROM t),
    r AS (SELECT c.*, coalesce(r.strategy, f.strategy) AS strategy, coalesce(r.min_tokens, f.min_tokens) AS low, coalesce(r.max_tokens, f.max_tokens) AS high, coalesce(r.overlap, f.overlap) AS lap
          FROM c LEFT JOIN rules AS r ON r.doc_type = c.doc_type, (SELECT * FROM rules WHERE doc_type = 'default') AS f),
    p AS (SELECT *, CASE strategy WHEN 'by_paragraph' THEN regexp_split_to_array(content, '\\n{_WS}*\\n') WHEN 'by_slide' THEN string_split(content, chr(10) || '---' || chr(10)) WHEN 'split_on_sheets' THEN [content]
          WHEN 'blank_line' THEN string_split(content, chr(10) || chr(10)) WHEN 'by_email_block' THEN string_split(regexp_replace(content, '([.!?…]["''”’)]?){_WS}+', '\\1' || chr(1), 'g'), chr(1)) ELSE string_split(content, chr(10)) END AS parts FROM r),
    i AS (SELECT k, ord, doc_type, doc_id, img, low, high, lap, list_transform({items}, lambda x: {_tok('x')}) AS toks FROM p),
    x AS (SELECT *, flatten(toks) AS flat, list_transform(toks, lambda x: len(x)) AS counts FROM i WHERE len(toks) > 0),
    f AS (SELECT k, 0 AS i, 0 AS s, 0 AS p, 0 AS n, NULL::BIGINT AS os, NULL::BIGINT AS ol FROM x
          UNION ALL
          SELECT f.k, f.i + 1, CASE WHEN f.n + counts[f.i + 1] >= high THEN f.p - least(lap, f.p - f.s) ELSE f.s END, f.p + counts[f.i + 1],
                 CASE WHEN f.n + counts[f.i + 1] >= high THEN counts[f.i + 1] ELSE f.n + counts[f.i + 1] END,
                 CASE WHEN f.n + counts[f.i + 1] >= high AND (f.p - f.s >= low OR img) THEN f.s END, CASE WHEN f.n + counts[f.i + 1] >= high AND (f.p - f.s >= low OR img) THEN f.p - f.s END
          FROM f JOIN x ON x.k = f.k WHERE f.i < len(counts)),
    o AS (SELECT k, i AS nr, os, ol FROM f WHERE ol IS NOT NULL UNION ALL SELECT f.k, f.i + 1, f.s, f.p - f.s FROM f JOIN x ON x.k = f.k WHERE f.i = len(counts)),
    m AS (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY nr) - 1)::INT AS seq, os, ol FROM o),
    chunked AS (SELECT x.ord, x.doc_id, x.doc_type, m.seq, array_to_string(flat[os + 1:os + ol], ' ') AS text, ol::INT AS token_count FROM m JOIN x ON x.k = m.k)"""


def _chunked(spark, d):
    return C.chunk_segments(_t(spark, d, "segments").select("ord", "content", "meta").distinct(), _t(spark, d, "rules"))


@query(f"WITH {_merge_sql()} SELECT sha256(doc_id || chr(0) || ord || chr(0) || seq || chr(0) || text) AS chunk_id, doc_id, doc_type, ord, seq, text, token_count FROM chunked")
def chunk_merge(spark, d):
    return _chunked(spark, d)


@query(f"WITH {_merge_sql()} SELECT doc_type, count(*) AS chunks, sum(token_count)::BIGINT AS tokens, max(token_count) AS largest FROM chunked GROUP BY doc_type")
def chunk_stats_by_type(spark, d):
    return _chunked(spark, d).groupBy("doc_type").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("largest"))


@query(f"WITH {_merge_sql()} SELECT DISTINCT sha256({_strip('text')}) AS content_hash FROM chunked")
def stream_ingest(spark, d):
    """The contents that incremental ingestion has stored after all segments came in two deliveries."""
    from .operators.rules import rules_frame
    from .shared import new_path, remove
    from .streaming.ingest import ingest

    rules, where = _t(spark, d, "rules"), new_path(spark, "stream")
    rows = _t(spark, d, "segments").select("ord", "content", "meta")
    rows.where("ord % 2 = 0").write.parquet(f"{where}/in")
    for part in (None, "ord % 2 = 1"):
        if part:
            rows.where(part).write.mode("append").parquet(f"{where}/in")
        ingest(spark, f"{where}/in", rows.schema, rules, f"{where}/out", f"{where}/checkpoint").awaitTermination()
    remove(spark, where, at_exit=True)
    return spark.read.schema("content_hash string, batch long").parquet(f"{where}/out").select("content_hash").distinct()


_UNSUPPORTED = {k: v[0] for k, v in U.DEFAULT_RULES.items() if v[0] not in C.STRATEGIES}
_WHY = "CASE " + " ".join(f"WHEN t = '{k}' THEN 'unsupported strategy: {v}'" for k, v in _UNSUPPORTED.items()) + " WHEN t = '' THEN 'doc_type is empty' END"


@query(f"SELECT DISTINCT ord, t AS doc_type, {_WHY} AS reason FROM (SELECT ord, coalesce(meta.doc_type, 'default') AS t FROM segments) WHERE {_WHY} IS NOT NULL")
def chunk_rejects(spark, d):
    return C.rejects(_t(spark, d, "segments"), U.rules_frame(spark), strict=True)


@query(f"""SELECT t AS doc_type, count(*) FILTER ({_WHY} IS NULL) AS successes, count(*) FILTER ({_WHY} IS NOT NULL) AS errors, count(*) FILTER ({_WHY} IS NOT NULL) >= 0.2 * count(*) AS failed
       FROM (SELECT DISTINCT ord, content, meta, coalesce(meta.doc_type, 'default') AS t FROM segments) GROUP BY t""")
def chunk_outcomes(spark, d):
    return C.outcomes(_t(spark, d, "segments").select("ord", "content", "meta").distinct(), U.rules_frame(spark))


_FIRST = """SELECT ord FROM (SELECT ord, h, row_number() OVER (PARTITION BY h ORDER BY ord) AS r FROM
       (SELECT DISTINCT ord, {h} AS h FROM segments)) WHERE r = 1 OR h IS NULL"""


@query(_FIRST.format(h=f"sha256({_strip('content')} || coalesce(array_to_string(meta.image_paths, ','), ''))"))
def dedup_segments(spark, d):
    rows = _t(spark, d, "segments").select("ord", T.segment_hash(F.col("content"), F.col("meta.image_paths")).alias("h")).distinct()
    return D.first_wins(rows, F.col("h"), "ord").select("ord")


@query(f"""SELECT DISTINCT chunk_id FROM chunks WHERE batch_id > 0 AND
       (text IS NULL OR sha256({_strip('text')}) NOT IN (SELECT sha256({_strip('text')}) FROM chunks WHERE batch_id = 0 AND text IS NOT NULL))""")
def dedup_against_existing(spark, d):
    c = _t(spark, d, "chunks").select("chunk_id", "batch_id", T.content_hash("text").alias("h"))
    return D.not_stored(c.where("batch_id > 0"), F.col("h"), c.where("batch_id = 0").select("h")).select("chunk_id").distinct()


@query(f"SELECT batch_id, min(chunk_id) AS chunk_id FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL GROUP BY batch_id, sha256({_strip('text')})")
def dedup_batch(spark, d):
    c = _t(spark, d, "chunks").where("text is not null and chunk_id is not null").select("batch_id", "chunk_id", T.content_hash("text").alias("h"))
    return D.first_wins(c, F.struct("batch_id", "h"), "chunk_id").select("batch_id", "chunk_id")


@query("SELECT DISTINCT id FROM images WHERE coalesce(nullif(description, ''), nullif(image_path, '')) IS NOT NULL")
def empty_content_skip(spark, d):
    return D.with_content(_t(spark, d, "images"), "description", "image_path").select("id").distinct()


@query(f"""SELECT min(id) AS id, sha256({_strip('description')}) AS image_hash FROM images WHERE description <> '' AND doc_type IS DISTINCT FROM 'pptx'
       AND sha256({_strip('description')}) NOT IN (SELECT sha256({_strip('description')}) FROM images WHERE description <> '' AND doc_type = 'pptx') GROUP BY 2""")
def image_dedup(spark, d):
    images = _t(spark, d, "images").select("id", "description", "doc_type").distinct()
    stored = I.new_descriptions(images.where("doc_type = 'pptx'"))
    return I.new_descriptions(images.where(~F.col("doc_type").eqNullSafe("pptx")), stored).select("id", "image_hash")


@query(f"""SELECT sha256(source_chunk_id || chr(0) || image_path) AS id, h AS image_hash FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY sha256(source_chunk_id || chr(0) || image_path)) AS r
       FROM (SELECT DISTINCT source_chunk_id, image_path, sha256({_strip('description')}) AS h FROM images WHERE description <> '' AND source_chunk_id IS NOT NULL AND image_path IS NOT NULL AND doc_type IN ('pptx', 'pdf', 'docx'))) WHERE r = 1""")
def image_index_rows(spark, d):
    rows = _t(spark, d, "images").where("description <> '' and source_chunk_id is not null and image_path is not null").select("source_chunk_id", "image_path", "description", "doc_type").distinct()
    return I.image_index(rows).select("id", "image_hash")


@query("SELECT doc_type, max(len(embedding))::INT AS dim, count(*) AS vectors FROM vectors GROUP BY doc_type")
def index_stats(spark, d):
    return V.index_stats(_t(spark, d, "vectors"))


@query("""SELECT coalesce(v.doc_type, m.doc_type) AS doc_type, coalesce(v.n, 0) AS vectors, coalesce(m.n, 0) AS metadata, coalesce(v.n, 0) = coalesce(m.n, 0) AS ok
       FROM (SELECT coalesce(doc_type, 'default') AS doc_type, count(*) AS n FROM vectors GROUP BY 1) AS v
       FULL JOIN (SELECT coalesce(doc_type, 'default') AS doc_type, count(*) AS n FROM vectors WHERE chunk_id IS NOT NULL GROUP BY 1) AS m ON m.doc_type = v.doc_type""")
def index_integrity(spark, d):
    v = _t(spark, d, "vectors")
    return V.integrity(v, v.where("chunk_id is not null"))


@query("SELECT DISTINCT doc_type FROM vectors WHERE doc_type IN (SELECT doc_type FROM images)")
def retriever_discovery(spark, d):
    return V.discovered(_t(spark, d, "vectors"), _t(spark, d, "images"))


_USABLE = """v AS (SELECT DISTINCT vec_pos, coalesce(doc_type, 'default') AS doc_type, chunk_id, embedding::DOUBLE[] AS e FROM vectors
       WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
       d AS (SELECT q.vec_pos AS query_id, v.doc_type AS retriever, v.vec_pos, v.chunk_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance
       FROM v AS q, v WHERE q.vec_pos % 50 = 0)"""


def _asked(spark, d):
    return V.usable(_t(spark, d, "vectors"), 64).where("vec_pos % 50 = 0").select(F.col("vec_pos").alias("query_id"), "embedding")


def _hits(spark, d, k=5, where=None):
    return V.nearest(_asked(spark, d), _t(spark, d, "vectors"), k, where=where)


@query(f"WITH {_USABLE} SELECT query_id, retriever, vec_pos, r::INT AS rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id, retriever ORDER BY round(distance, 9), vec_pos) AS r FROM d) WHERE r <= 5")
def knn_per_index(spark, d):
    return _hits(spark, d).select("query_id", "retriever", "vec_pos", "rank", F.round("distance", 6).alias("distance"))


@query(f"WITH {_USABLE} SELECT query_id, vec_pos, r::INT AS rank, round(distance, 6) AS distance, round(1 - distance, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_pos) AS r FROM d) WHERE r <= 5")
def late_fusion(spark, d):
    return V.strategy("late_fusion")(_asked(spark, d), _t(spark, d, "vectors"), 5).select("query_id", "vec_pos", "rank", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_USABLE} SELECT query_id, vec_pos, r::INT AS rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_pos) AS r FROM d WHERE retriever = 'pdf') WHERE r <= 5")
def knn_filtered(spark, d):
    return _hits(spark, d, where="doc_type = 'pdf'").select("query_id", "vec_pos", "rank", F.round("distance", 6).alias("distance"))


#: An image's vector is here that of its parent chunk with the smallest position; two vectors, those at
#: 0 and 50 of every hundred positions, ask one question.
_IMAGE_HITS = f"""{_USABLE}, iv AS (SELECT id, source_chunk_id, image_path, description, e FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY vec_pos, coalesce(source_chunk_id, ''), coalesce(image_path, ''), coalesce(description, '')) AS r
       FROM (SELECT DISTINCT i.id, i.source_chunk_id, i.image_path, i.description, v.vec_pos, v.e FROM images AS i JOIN v ON v.chunk_id = i.source_chunk_id WHERE i.id IS NOT NULL)) WHERE r = 1),
       ih AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM (SELECT q.vec_pos AS query_id, iv.id, iv.source_chunk_id, iv.image_path, iv.description,
       list_sum(list_transform(list_zip(q.e, iv.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM v AS q, iv WHERE q.vec_pos % 50 = 0))"""


def _image_vectors(spark, d):
    v = V.usable(_t(spark, d, "vectors"), 64).select(F.col("chunk_id").alias("source_chunk_id"), "vec_pos", "embedding")
    rows = _t(spark, d, "images").where("id is not null").select("id", "source_chunk_id", "image_path", "description").join(v, "source_chunk_id")
    order = F.struct("vec_pos", "source_chunk_id", F.coalesce("image_path", F.lit("")), F.coalesce("description", F.lit("")))
    one = rows.groupBy("id").agg(F.min_by(F.struct("source_chunk_id", "image_path", "description", "embedding"), order).alias("v"))
    return one.select("id", "v.*")


@query(f"WITH {_IMAGE_HITS} SELECT query_id, id, rank::INT AS rank, round(distance, 6) AS image_similarity, round(1 - distance, 6) AS similarity FROM ih WHERE rank <= 5")
def image_knn(spark, d):
    hits = I.nearest_images(_asked(spark, d), _image_vectors(spark, d), 5)
    return hits.select("query_id", "id", "rank", F.round("image_similarity", 6).alias("image_similarity"), F.round("similarity", 6).alias("similarity"))


_FINAL = f"""WITH {_IMAGE_HITS},
    th AS (SELECT query_id // 100 AS g, (query_id % 100) // 50 AS q, chunk_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_pos) AS rank FROM d) WHERE rank <= 5 AND chunk_id IS NOT NULL),
    tx AS (SELECT g, chunk_id, min((q, rank)) AS place, arg_max(distance, (q, rank)) AS distance FROM th GROUP BY g, chunk_id),
    ii AS (SELECT query_id // 100 AS g, (query_id % 100) // 50 AS q, rank, id, source_chunk_id, image_path, description, distance FROM ih WHERE rank <= 5),
    pr AS (SELECT ii.g, ii.source_chunk_id AS chunk_id, count(*) AS shown, arg_max(ii.distance, (q, rank, id)) AS image_similarity FROM ii JOIN tx ON tx.g = ii.g AND tx.chunk_id = ii.source_chunk_id GROUP BY ALL),
    al AS (SELECT tx.g, 0 AS a, place, tx.chunk_id AS id, 'text' AS kind, tx.chunk_id AS content, coalesce(shown, 0) AS shown, image_similarity FROM tx LEFT JOIN pr ON pr.g = tx.g AND pr.chunk_id = tx.chunk_id
           UNION ALL SELECT g, 1, (q, rank), id, 'image', description, 0, distance FROM ii WHERE NOT EXISTS (SELECT 1 FROM tx WHERE tx.g = ii.g AND tx.chunk_id = ii.source_chunk_id)),
    fi AS (SELECT *, row_number() OVER (PARTITION BY g, sha256({_strip('content')}) ORDER BY a, place, id) AS r FROM al WHERE content <> '')"""


@query(f"{_FINAL} SELECT g AS query_id, row_number() OVER (PARTITION BY g ORDER BY a, place, id)::INT AS rank, kind, id, shown, round(image_similarity, 6) AS image_similarity FROM fi WHERE r = 1")
def retrieve_final(spark, d):
    """Two query vectors a question: texts and images, collapsed by id, promoted, without repeated contents (a text's content is here its chunk_id)."""
    question = lambda df: df.withColumn("q_ord", F.floor(F.col("query_id") % 100 / 50).cast("int")).withColumn("query_id", F.floor(F.col("query_id") / 100))
    texts = question(V.strategy("late_fusion")(_asked(spark, d), _t(spark, d, "vectors"), 5).where("chunk_id is not null").withColumn("text", F.col("chunk_id")))
    images = _image_vectors(spark, d)
    shown = question(I.nearest_images(_asked(spark, d), images, 5).join(images.drop("embedding"), "id"))
    out = V.final_results(texts, shown)
    return out.select("query_id", "rank", "kind", "id", F.coalesce(F.size("image_summaries"), F.lit(0)).cast("long").alias("shown"), F.round("image_similarity", 6).alias("image_similarity"))


@query("SELECT DISTINCT i.id FROM images i WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = i.source_chunk_id)")
def orphan_images(spark, d):
    return V.orphans(_t(spark, d, "images"), _t(spark, d, "chunks").where("chunk_id is not null")).select("id").distinct()


@query("""SELECT c.chunk_id, count(i.image_path) AS images, count(i.image_path) > 0 AS promoted_by_image
       FROM (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) c
       LEFT JOIN (SELECT DISTINCT source_chunk_id, image_path, description FROM images WHERE image_path IS NOT NULL) i ON i.source_chunk_id = c.chunk_id GROUP BY c.chunk_id""")
def image_promotion(spark, d):
    hits = _t(spark, d, "chunks").where("chunk_id is not null").select("chunk_id").distinct()
    out = V.promoted(hits, _t(spark, d, "images"))
    return out.select("chunk_id", F.coalesce(F.size("image_summaries"), F.lit(0)).cast("long").alias("images"), "promoted_by_image")


def _captioned(spark, d):
    """Chunks with the descriptions of the images that name them, in the form that a captioner gives."""
    i = _t(spark, d, "images").where("image_path is not null and source_chunk_id is not null").select(F.col("source_chunk_id").alias("chunk_id"), "image_path", F.coalesce("description", F.lit("")).alias("description")).distinct()
    found = i.withColumn("pos", F.lit(0))
    return E.with_summaries(_t(spark, d, "chunks").where("chunk_id is not null").select("chunk_id").distinct(), found)


_SHOWN = "(SELECT DISTINCT source_chunk_id AS chunk_id, image_path, coalesce(description, '') AS t FROM images WHERE image_path IS NOT NULL AND source_chunk_id IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL))"


@query(f"SELECT chunk_id, string_agg(image_path || '|' || t, ';' ORDER BY image_path, t) AS summaries FROM {_SHOWN} GROUP BY chunk_id")
def summaries_collect(spark, d):
    s = F.transform("image_summaries", lambda x: F.concat(x["image_path"], F.lit("|"), x["description"]))
    return _captioned(spark, d).where("image_summaries is not null").select("chunk_id", F.array_join(s, ";").alias("summaries"))


@query(f"SELECT chunk_id AS source_chunk_id, image_path, t AS description FROM {_SHOWN} WHERE t <> ''")
def summaries_explode(spark, d):
    return E.flattened(_captioned(spark, d))


@query(f"SELECT kind, count(*) AS n FROM (SELECT 'text' AS kind FROM (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) UNION ALL SELECT 'image' FROM {_SHOWN}) GROUP BY kind")
def separate_chunks(spark, d):
    i = _t(spark, d, "images").where("image_path is not null").select(F.col("source_chunk_id").alias("chunk_id"), "image_path", F.coalesce("description", F.lit("")).alias("description")).distinct()
    chunks = _t(spark, d, "chunks").where("chunk_id is not null").select("chunk_id").distinct()
    return E.as_rows(chunks, i.join(chunks, "chunk_id", "left_semi")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""SELECT c.chunk_id, md5(c.text || coalesce(chr(10) || chr(10) || '[Image Insight]: ' || s.t, '')) AS h FROM (SELECT DISTINCT chunk_id, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL) AS c
       LEFT JOIN (SELECT chunk_id, string_agg(t, ' ' ORDER BY image_path, t) AS t FROM {_SHOWN} GROUP BY chunk_id) AS s ON s.chunk_id = c.chunk_id""")
def insight_injection(spark, d):
    from .operators.embedding import with_insight

    texts = _t(spark, d, "chunks").where("chunk_id is not null and text is not null").select("chunk_id", "text").distinct().join(_captioned(spark, d), "chunk_id")
    said = with_insight(F.col("text"), F.transform("image_summaries", lambda x: x["description"]))
    return texts.select("chunk_id", F.md5(said.cast("binary")).alias("h"))


_ITEM = f"""'Source ID: [' || {_strip("replace(coalesce(nullif(meta.source_filepath, ''), meta.doc_id, ''), chr(10), ' ')")} || ']' || chr(10) || 'Content: ' || coalesce(content, '')
       || CASE WHEN meta.page_number <> 0 THEN chr(10) || 'Page: ' || meta.page_number ELSE '' END"""


def _items(spark, d):
    s = _t(spark, d, "segments")
    item = P.context_item(P.source_name(F.col("meta.source_filepath"), F.col("meta.doc_id")), F.col("content"), F.col("meta.page_number"))
    return s.select("ord", F.col("meta.source_filepath").alias("source"), item.alias("item")).distinct()


@query(f"SELECT DISTINCT ord, {_ITEM} AS item FROM segments")
def context_items(spark, d):
    return _items(spark, d).select("ord", "item")


#: Items in a context: what a top-k report shows.
_CONTEXT = 20


@query(f"""SELECT source, string_agg(item, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ord, item) AS context FROM
       (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord, item) AS r FROM (SELECT DISTINCT ord, meta.source_filepath AS source, {_ITEM} AS item FROM segments)) WHERE r <= {_CONTEXT} GROUP BY source""")
def context_join(spark, d):
    """The first items of every source as one context. Only a source's first items leave the tasks that number them."""
    rows = _items(spark, d).withColumn("place", F.struct("ord", "item"))
    first = R.numbered(rows, ["source"], "place").where(F.col("n") < _CONTEXT)
    return first.groupBy("source").agg(P.context(F.transform(F.array_sort(F.collect_list("place")), lambda x: x["item"])).alias("context"))


@query(f"SELECT ord, 'Context: ' || item || chr(10) || 'Question: {{x}} ' || ord AS prompt FROM (SELECT DISTINCT ord, {_ITEM} AS item FROM segments)")
def prompt_build(spark, d):
    return _items(spark, d).select("ord", P.prompt("Context: {context_str}\nQuestion: {query_str}", F.col("item"), F.concat(F.lit("{x} "), F.col("ord").cast("string"))).alias("prompt"))


@query("SELECT DISTINCT coalesce(meta.source_filepath, meta.doc_id) AS source FROM segments WHERE coalesce(meta.source_filepath, meta.doc_id) IS NOT NULL ORDER BY source")
def sources_distinct(spark, d):
    return R.sorted_sources(_t(spark, d, "segments"), F.coalesce("meta.source_filepath", "meta.doc_id"))


@query("SELECT coalesce(meta.source_filepath, meta.doc_id) || CASE WHEN meta.page_number <> 0 THEN ', page ' || meta.page_number ELSE '' END AS source, min(ord) AS rank FROM segments GROUP BY 1")
def sources_first_rank(spark, d):
    page = F.when(F.col("meta.page_number") != 0, F.concat(F.lit(", page "), F.col("meta.page_number").cast("string"))).otherwise("")
    return R.first_ranks(_t(spark, d, "segments"), F.concat(F.coalesce("meta.source_filepath", "meta.doc_id"), page), "ord")


@query("""SELECT ord, coalesce(meta.source_filepath, meta.doc_id) || CASE WHEN meta.page_number <> 0 THEN ', page ' || meta.page_number ELSE '' END AS source FROM segments""")
def sources_ordered(spark, d):
    page = F.when(F.col("meta.page_number") != 0, F.concat(F.lit(", page "), F.col("meta.page_number").cast("string"))).otherwise("")
    return _t(spark, d, "segments").select("ord", F.concat(F.coalesce("meta.source_filepath", "meta.doc_id"), page).alias("source")).orderBy("ord")


@query("""SELECT doc_type, errors, successes, (errors > 0 AND successes = 0) OR errors::DOUBLE / (errors + successes) >= 0.2 AS failed FROM
       (SELECT meta.doc_type AS doc_type, count(*) FILTER (content IS NULL OR content = '') AS errors, count(*) FILTER (content <> '') AS successes FROM segments GROUP BY 1)""")
def error_policy(spark, d):
    bad = F.col("content").isNull() | (F.col("content") == "")
    rows = _t(spark, d, "segments").groupBy(F.col("meta.doc_type").alias("doc_type")).agg(F.count_if(bad).alias("errors"), F.count_if(~bad).alias("successes"))
    return rows.select("doc_type", "errors", "successes", R.failed(F.col("errors"), F.col("successes")).alias("failed"))


@query("""SELECT source, group_no::INT AS group_no, count(*) AS n, min(ord) AS first_ord, max(ord) AS last_ord FROM
       (SELECT source, ord, (row_number() OVER (PARTITION BY source ORDER BY ord) - 1) // 50 AS group_no FROM (SELECT DISTINCT meta.source_filepath AS source, ord FROM segments)) GROUP BY ALL""")
def row_groups_50(spark, d):
    rows = R.row_groups(_t(spark, d, "segments").select(F.col("meta.source_filepath").alias("source"), "ord").distinct(), ["source"], "ord")
    return rows.groupBy("source", "group_no").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


@query("SELECT coalesce(doc_type, 'default') AS doc_type, count(*) AS n FROM vectors GROUP BY 1")
def group_by_doc_type(spark, d):
    return M.by_doc_type(_t(spark, d, "vectors"))


def _batch_lines(spark, d):
    """Result lines of a batch job: vectors of chunks with status 200, those of even positions; others failed."""
    v = _t(spark, d, "vectors").where("chunk_id is not null").select("chunk_id", "vec_pos", "embedding").distinct()
    body = F.struct(F.array(F.struct(F.transform("embedding", lambda x: F.nanvl(x, F.lit(0.0).cast("float"))).alias("embedding"))).alias("data"))
    answer = F.struct(F.when(F.col("vec_pos") % 2 == 0, 200).otherwise(500).alias("status_code"), body.alias("body"))
    return v.select(F.to_json(F.struct(F.col("chunk_id").alias("custom_id"), answer.alias("response"))).alias("line")).union(spark.createDataFrame([("{cut",)], "line string"))


@query("""SELECT c.chunk_id, count(*) AS results FROM (SELECT DISTINCT chunk_id FROM chunks) AS c
       JOIN (SELECT DISTINCT chunk_id, vec_pos, embedding FROM vectors) AS v ON v.chunk_id = c.chunk_id WHERE v.vec_pos % 2 = 0 GROUP BY c.chunk_id""")
def batch_result_join(spark, d):
    return M.matched(_t(spark, d, "chunks").select("chunk_id").distinct(), M.batch_results(_batch_lines(spark, d))).groupBy("chunk_id").agg(F.count("*").alias("results"))


@query("""SELECT DISTINCT c.chunk_id FROM chunks c WHERE c.chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM vectors v WHERE v.chunk_id = c.chunk_id AND v.vec_pos % 2 = 0)""")
def batch_result_missing(spark, d):
    return M.missing(_t(spark, d, "chunks").select("chunk_id").distinct(), M.batch_results(_batch_lines(spark, d)))


@query("""SELECT DISTINCT chunk_id AS custom_id, text AS input FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL""")
def batch_requests(spark, d):
    rows = M.batch_requests(_t(spark, d, "chunks").where("chunk_id is not null and text is not null"), "hash-64")
    return rows.select(F.get_json_object("line", "$.custom_id").alias("custom_id"), F.get_json_object("line", "$.body.input").alias("input")).distinct()


@query()
def hash_embeddings(spark, d):
    return M.hash_embedded(_t(spark, d, "chunks").where("text is not null").select("chunk_id", "text").distinct()).select("chunk_id", "embedding")


@query("""SELECT DISTINCT c.chunk_id, CASE WHEN i.source_chunk_id IS NOT NULL THEN 'enriched' ELSE 'base' END AS origin
       FROM chunks c LEFT JOIN (SELECT DISTINCT source_chunk_id FROM images) i ON i.source_chunk_id = c.chunk_id WHERE c.chunk_id IS NOT NULL""")
def enriched_or_base(spark, d):
    base = _t(spark, d, "chunks").where("chunk_id is not null").select("chunk_id", F.lit("base").alias("origin")).distinct()
    enriched = base.join(_t(spark, d, "images").select(F.col("source_chunk_id").alias("chunk_id")).distinct(), "chunk_id", "left_semi").withColumn("origin", F.lit("enriched"))
    return M.enriched_or_base(base, enriched, "chunk_id")


@query("SELECT ord, content[1:500] AS t FROM (SELECT DISTINCT ord, content FROM segments)")
def context_prefix(spark, d):
    return _text(spark, d).select("ord", T.context_prefix("content").alias("t"))


@query("SELECT ord, content[1:500] || '...' AS t FROM (SELECT DISTINCT ord, content FROM segments)")
def long_preview(spark, d):
    return _text(spark, d).select("ord", T.long_preview("content").alias("t"))


@query("SELECT ord, base64(encode(content)) AS t, sha256(encode(content)) AS h FROM (SELECT DISTINCT ord, content FROM segments)")
def blob_texts(spark, d):
    blob = F.col("content").cast("binary")
    return _text(spark, d).select("ord", T.base64_text(blob).alias("t"), T.bytes_hash(blob).alias("h"))


@query("SELECT ord, 'Seen: ' || coalesce(content[1:500], '') || ' {x}' AS t FROM (SELECT DISTINCT ord, content FROM segments)")
def template_fill(spark, d):
    return _text(spark, d).select("ord", T.filled("Seen: {{ context }} {x}", context=T.context_prefix("content")).alias("t"))


@query("""SELECT DISTINCT meta.source_filepath AS path, meta.page_number AS page, replace(regexp_replace(regexp_extract(meta.source_filepath, '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1'), ' ', '_') || '_page' || meta.page_number || '_img1.png' AS name
       FROM segments WHERE meta.page_number IS NOT NULL AND meta.source_filepath IS NOT NULL""")
def image_names(spark, d):
    s = _t(spark, d, "segments").where("meta.page_number is not null and meta.source_filepath is not null").select(F.col("meta.source_filepath").alias("path"), F.col("meta.page_number").alias("page")).distinct()
    return s.select("path", "page", T.image_name(F.col("path"), "page", F.col("page"), F.lit(1)).alias("name"))


@query("""SELECT model, sum(tokens)::BIGINT AS prompt_tokens, sum(half)::BIGINT AS completion_tokens, round(sum(tokens) / 1000 * CASE model WHEN 'a' THEN 0.5 WHEN 'b' THEN 0.25 END + sum(half) / 1000 * CASE model WHEN 'a' THEN 1.5 WHEN 'b' THEN 1 END, 6) AS cost
       FROM (SELECT ['a', 'b', 'c'][1 + batch_id % 3] AS model, token_count AS tokens, token_count // 2 AS half FROM chunks WHERE token_count >= 0 AND batch_id IS NOT NULL) GROUP BY model""")
def api_costs(spark, d):
    c = _t(spark, d, "chunks").where("token_count >= 0 and batch_id is not null")
    usage = c.select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("batch_id") % 3 + 1).cast("int")).alias("model"), F.col("token_count").alias("prompt_tokens"), F.expr("token_count div 2").alias("completion_tokens"))
    return R.costs(usage, {"a": (0.5, 1.5), "b": (0.25, 1.0)}).withColumn("cost", F.round("cost", 6))


@query("SELECT DISTINCT batch_id, chunk_id, trim(meta_json->>'source') AS source FROM chunks WHERE chunk_id IS NOT NULL AND json_valid(meta_json)")
def chunk_meta(spark, d):
    from .sources.tables import with_meta

    rows = with_meta(_t(spark, d, "chunks").where("chunk_id is not null").select("batch_id", "chunk_id", "meta_json"))
    return rows.where("meta is not null").select("batch_id", "chunk_id", F.trim(F.col("meta")["source"]).alias("source")).distinct()


# --- files: made of the segments' texts, then read by the loaders -------------------------------


def _files(spark, d, suffix, make, content=None):
    from .sources.export import as_files

    texts = _text(spark, d).where("content is not null")
    rows = texts.select(F.format_string(f"/data/projects/p/input/raw/%d.{suffix}", "ord").alias("path"), (F.col("content") if content is None else content).alias("text"))
    return as_files(rows, make)


def _loaded(files):
    from .sources.loaders import parsed

    return parsed(files).select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("ord"), "seq", "content", "meta", "ok")


#: What XML can't hold becomes a blank.
_XML = r"[\x00-\x08\x0b\x0c\x0e-\x1f\r]"
_XML_SQL = f"regexp_replace(content, '{_XML}', ' ', 'g')"
_WHOLE = "(SELECT DISTINCT ord, content FROM segments WHERE content IS NOT NULL)"
_EACH = f"(SELECT ord, unnest(l) AS line, unnest(range(len(l)))::INT AS i FROM (SELECT ord, string_split({_XML_SQL}, chr(10)) AS l FROM {_WHOLE}))"


def _xml():
    return F.regexp_replace("content", _XML, " ")


@query(f"SELECT ord, content, '/data/projects/p/input/raw/' || ord || '.txt' AS source_filepath, 'txt' AS doc_type FROM {_WHOLE}")
def load_txt(spark, d):
    rows = _loaded(_files(spark, d, "txt", str.encode))
    return rows.select("ord", "content", F.col("meta")["source_filepath"].alias("source_filepath"), F.col("meta")["doc_type"].alias("doc_type"))


@query(f"SELECT ord, content || chr(10) AS content FROM {_WHOLE}")
def load_csv(spark, d):
    from .sources.export import to_csv

    return _loaded(_files(spark, d, "csv", lambda t: to_csv([line.split(",") for line in t.split("\n")]))).select("ord", "content")


_STRIP_MAIL = _strip("regexp_replace(content, '\\r\\n?', chr(10), 'g')")


@query(f"SELECT ord, {_STRIP_MAIL} AS content, 'email' AS content_type FROM {_WHOLE}")
def load_eml(spark, d):
    from .sources.export import to_eml

    return _loaded(_files(spark, d, "eml", lambda t: to_eml(t, "subject"))).select("ord", "content", F.col("meta")["content_type"].alias("content_type"))


@query(f"SELECT ord, i + 1 AS paragraph_number, {_strip('line')} AS content FROM {_EACH} WHERE {_strip('line')} <> ''")
def load_docx(spark, d):
    from .sources.export import to_docx

    rows = _loaded(_files(spark, d, "docx", lambda t: to_docx(t.split("\n")), _xml()))
    return rows.select("ord", F.col("meta")["paragraph_number"].cast("int").alias("paragraph_number"), "content")


_CELLS = f"array_to_string(list_filter(list_transform(string_split(line, ','), lambda x: {_strip('x')}), lambda x: x <> ''), ' | ')"


@query(f"SELECT ord, string_agg({_CELLS}, chr(10) ORDER BY i) AS content FROM {_EACH} WHERE {_CELLS} <> '' GROUP BY ord")
def load_docx_tables(spark, d):
    from .sources.export import to_docx

    make = lambda t: to_docx([], [[line.split(",") for line in t.split("\n")]])
    return _loaded(_files(spark, d, "docx", make, _xml())).where(F.col("ok") & F.col("meta")["table_number"].isNotNull()).select("ord", "content")


_SHAPES = f"array_to_string(list_filter(list_transform(string_split(s, chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), chr(10))"
_SLIDES = f"(SELECT ord, unnest(range(len(l)))::INT + 1 AS slide_number, unnest(l) AS s FROM (SELECT ord, string_split({_XML_SQL}, chr(10) || chr(10)) AS l FROM {_WHOLE}))"


def _slides(t):
    from .sources.export import to_pptx

    slides = t.split("\n\n")
    return to_pptx([([x for x in s.split("\n") if x.strip()], s if i % 2 else "") for i, s in enumerate(slides)])


@query(f"SELECT ord, slide_number, {_SHAPES} AS content FROM {_SLIDES} WHERE {_SHAPES} <> ''")
def load_pptx(spark, d):
    rows = _loaded(_files(spark, d, "pptx", _slides, _xml())).where(F.col("meta")["type"] == "slide_content")
    return rows.select("ord", F.col("meta")["slide_number"].cast("int").alias("slide_number"), "content")


@query(f"SELECT ord, slide_number, 'Presenter Notes (Slide ' || slide_number || '):' || chr(10) || {_strip('s')} AS content FROM {_SLIDES} WHERE slide_number % 2 = 0 AND {_strip('s')} <> ''")
def load_pptx_notes(spark, d):
    rows = _loaded(_files(spark, d, "pptx", _slides, _xml())).where(F.col("meta")["type"] == "presenter_notes")
    return rows.select("ord", F.col("meta")["slide_number"].cast("int").alias("slide_number"), "content")


_ROW = "array_to_string(list_filter(string_split(line, chr(9)), lambda x: x <> ''), chr(9))"


@query(f"""SELECT ord, CASE WHEN g = 0 THEN 1 ELSE lag(to_row) OVER (PARTITION BY ord ORDER BY g) + 1 END || '-' || CASE WHEN n = 50 THEN to_row ELSE rows END AS row_range, content FROM
       (SELECT ord, g, count(*) AS n, max(i) + 1 AS to_row, any_value(rows) AS rows, string_agg(row, chr(10) ORDER BY i) AS content FROM
        (SELECT ord, i, row, rows, (row_number() OVER (PARTITION BY ord ORDER BY i) - 1) // 50 AS g FROM (SELECT ord, i, {_ROW} AS row, max(i) OVER (PARTITION BY ord) + 1 AS rows FROM {_EACH}) WHERE {_strip('row')} <> '') GROUP BY ord, g)""")
def load_xlsx(spark, d):
    from .sources.export import to_xlsx

    rows = _loaded(_files(spark, d, "xlsx", lambda t: to_xlsx({"S": [line.split("\t") for line in t.split("\n")]}), _xml()))
    return rows.select("ord", F.col("meta")["row_range"].alias("row_range"), "content")


_PDF_TEXT = f"array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '{_WS}+$', '')), lambda x: {_strip('x')} <> ''), chr(10))"


@query(f"SELECT ord, CASE WHEN {_PDF_TEXT} = '' THEN '[Image-only page]' ELSE {_PDF_TEXT} END AS content, 1 AS page_number, 'title of it' AS title FROM {_WHOLE}")
def load_pdf(spark, d):
    from .sources.export import to_pdf

    rows = _loaded(_files(spark, d, "pdf", lambda t: to_pdf([t], {"Title": "title of it"})))
    return rows.select("ord", "content", F.col("meta")["page_number"].cast("int").alias("page_number"), F.col("meta")["title"].alias("title"))


@query(f"SELECT ord, false AS ok FROM {_WHOLE}")
def load_broken(spark, d):
    """Texts that call themselves PDF, with one reject each."""
    return _loaded(_files(spark, d, "pdf", lambda t: ("no " + t).replace("%PDF", "").encode())).select("ord", "ok")


# --- tables between stages, written to the shared folder and read again -----------------------------


@query("SELECT DISTINCT chunk_id, doc_id, text, token_count, meta_json FROM chunks WHERE chunk_id <> '' AND text <> '' AND doc_id <> '' AND meta_json <> '' AND token_count IS NOT NULL")
def chunk_tsv(spark, d):
    """Chunks through the TSV writer and reader."""
    from .shared import new_path, remove
    from .sources.tables import read_chunk_tsv, write_chunk_tsv

    where = new_path(spark, "chunk-tsv")
    rows = _t(spark, d, "chunks").where("chunk_id <> '' and text <> '' and doc_id <> '' and meta_json <> '' and token_count is not null").select("chunk_id", "doc_id", "text", "token_count", "meta_json").distinct()
    write_chunk_tsv(rows.withColumn("doc_type", F.lit("any")), where)
    remove(spark, where, at_exit=True)
    return read_chunk_tsv(spark, f"{where}/doc_type=any")


@query("SELECT DISTINCT vec_pos, doc_type, chunk_id FROM vectors WHERE doc_type IN ('pdf', 'docx') AND vec_pos IS NOT NULL")
def index_round_trip(spark, d):
    """Vectors appended in two writes, then read by document type: only the folders asked for are read."""
    from .shared import new_path, remove
    from .sources.tables import append_index, read_index

    where, rows = new_path(spark, "index"), _t(spark, d, "vectors").where("doc_type is not null and vec_pos is not null").distinct()
    for part in ("vec_pos % 2 = 0", "vec_pos % 2 = 1"):
        append_index(rows.where(part), where)
    remove(spark, where, at_exit=True)
    return read_index(spark, where, ["pdf", "docx"]).select("vec_pos", "doc_type", "chunk_id").distinct()


@query("SELECT DISTINCT id, description FROM images WHERE id IS NOT NULL")
def metadata_lines(spark, d):
    """Image metadata as JSON lines, with broken lines among them that the lenient reader passes over."""
    from .shared import new_path, remove
    from .sources.tables import read_metadata

    where, rows = new_path(spark, "metadata"), _t(spark, d, "images").where("id is not null").select("id", "description").distinct()
    rows.select(F.to_json(F.struct("id", "description")).alias("value")).unionAll(spark.createDataFrame([('{"id": "cut',)], "value string")).write.text(where)
    remove(spark, where, at_exit=True)
    return read_metadata(spark, where, "id string, description string")


@query("""SELECT DISTINCT chunk_id, doc_type FROM (SELECT chunk_id, coalesce(meta_json[1:0] || split_part(doc_id, '.', -1), '') AS doc_type FROM chunks WHERE chunk_id IS NOT NULL AND doc_id IS NOT NULL AND meta_json IS NOT NULL) WHERE regexp_full_match(doc_type, '[a-z]+')""")
def chunk_files(spark, d):
    """Chunks in a file family by document type (here the suffix of their file), found by name and read again; rows cut short are passed over."""
    from .shared import new_path, remove
    from .sources.tables import chunk_files as files, read_chunk_files

    where = new_path(spark, "chunk-files")
    rows = _t(spark, d, "chunks").where("chunk_id is not null and doc_id is not null and meta_json is not null").select("chunk_id", F.substring_index("doc_id", ".", -1).alias("doc_type")).where("doc_type rlike '^[a-z]+$'").distinct()
    head, good = "chunk_id\tdoc_id\ttext\ttoken_count\tmeta_json", F.concat_ws("\t", "chunk_id", F.lit("d"), F.lit("t"), F.lit("1"), F.lit("{}"))
    for r in rows.select("doc_type").distinct().orderBy("doc_type").collect():  # suffixes of files: a few
        lines = rows.where(F.col("doc_type") == r.doc_type).select(F.concat(good, F.lit("\nshort\trow")).alias("value"), F.lit(1).alias("o"))
        spark.createDataFrame([(head, 0)], "value string, o int").unionAll(lines).repartition(1).sortWithinPartitions("o").select("value").write.text(f"{where}/chunks_{r.doc_type}.tsv")
    remove(spark, where, at_exit=True)
    return read_chunk_files(spark, where, lenient=True).where("doc_id = 'd'").join(files(spark, where).select("doc_type"), "doc_type").select("chunk_id", "doc_type").distinct()


@query(f"SELECT DISTINCT chunk_id, len(text)::INT AS characters, len({_tok('text')})::INT AS tokens FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL")
def embed_contract(spark, d):
    """A plug-in embedder whose vectors are (characters, tokens): called in batches, one vector a text, in order."""
    import numpy as np

    rows = _t(spark, d, "chunks").where("chunk_id is not null and text is not null").select("chunk_id", "text").distinct()
    done = M.embedded(rows, lambda: lambda texts: np.array([[len(t), len(t.split())] for t in texts], np.float32), batch_size=64)
    return done.select("chunk_id", F.col("embedding")[0].cast("int").alias("characters"), F.col("embedding")[1].cast("int").alias("tokens"))


@query(f"""WITH {_USABLE} SELECT query_id, chunk_id, min(rank)::INT AS rank, round(arg_max(distance, rank), 6) AS distance FROM
       (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_pos) AS rank FROM d) WHERE rank <= 20 AND chunk_id IS NOT NULL GROUP BY query_id, chunk_id""")
def id_collapse(spark, d):
    hits = V.strategy("late_fusion")(_asked(spark, d), _t(spark, d, "vectors"), 20).where("chunk_id is not null")
    return V.collapsed(hits).select("query_id", "chunk_id", "rank", F.round("distance", 6).alias("distance"))


@query("""SELECT chunk_id, (unnest(range(len(p))))::INT AS pos, unnest(p) AS image_path, unnest(p) || ': ' || n AS description FROM
       (SELECT c.chunk_id, list_sort(list(DISTINCT i.image_path)) AS p, len(any_value(c.t)[1:500]) AS n FROM (SELECT chunk_id, min(coalesce(text, '')) AS t FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1) AS c
        JOIN images AS i ON i.source_chunk_id = c.chunk_id WHERE i.image_path IS NOT NULL GROUP BY c.chunk_id)""")
def image_captions(spark, d):
    """A plug-in captioner that says an image's path and how much text stands beside it."""
    texts = _t(spark, d, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    paths = _t(spark, d, "images").where("image_path is not null").groupBy(F.col("source_chunk_id").alias("chunk_id")).agg(F.sort_array(F.collect_set("image_path")).alias("image_paths"))
    return E.captions(texts.join(paths, "chunk_id"), lambda: lambda path, text: f"{path}: {len(text)}")
