import hashlib
import io
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflux.functions import prompts as P, text as T
from folioflux.functions.whitespace import SPACES, WS_CHARS
from folioflux.operators import chunking as C, dedup as D, embedding as E, reporting as R, retrieval as V, rules as U

SEGMENT = "ord long, content string, meta struct<doc_type:string,doc_id:string,source_filepath:string,image_paths:array<string>>"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first().y


def test_whitespace_is_python_s(spark):
    assert len(SPACES) == 29 and sorted(map(ord, WS_CHARS)) == [c for c in range(0x3100) if chr(c).isspace()]
    text = "".join(f"w{i}{c}" for i, c in enumerate(WS_CHARS)) + "end"
    assert one(spark, text, T.tokens) == text.split()
    assert one(spark, WS_CHARS + "a b" + WS_CHARS, T.stripped) == "a b"
    assert one(spark, None, T.token_count) is None and one(spark, " \n", T.token_count) == 0


def test_cleaning(spark):
    mail = "Hello\r\n> quoted\nOn Monday we met\nbody\nOn 3 May X wrote:\nrest\nFrom: y"
    assert one(spark, mail, T.cleaned) == "Hello\nOn Monday we met\nbody"
    assert one(spark, "a\n-- \nb", T.cleaned) == "a\n-- \nb" and one(spark, "a\n-- Bob\nb", T.cleaned) == "a"
    assert one(spark, "a\n-- \nb", lambda x: T.cleaned(x, strict=False)) == "a"
    assert one(spark, None, T.cleaned) is None and one(spark, "", T.cleaned) == ""


def test_hashes_and_names(spark):
    assert one(spark, " é　", T.content_hash) == hashlib.sha256("é".encode()).hexdigest()
    assert one(spark, "a/b c.d.pdf", T.stem) == "b_c.d" and one(spark, "noext", T.stem) == "noext"
    assert one(spark, "/x/data/projects/p/data/projects/q/f", T.project_root) == "/x/data/projects/p"
    assert one(spark, "שלום", T.direction) == "rtl" and one(spark, None, T.direction) is None


def fold(parts, low, high, overlap, images):
    out, tail, buf = [], [], []
    for item in parts:
        own = item.split()
        if len(buf) + len(own) >= high:
            cand = tail + buf
            if len(cand) >= low or images:
                out.append(" ".join(cand))
            tail, buf = (cand[-overlap:] if overlap else []), []
        buf = buf + own
    if parts:
        out.append(" ".join(tail + buf))
    return out


def merge(spark, parts, low, high, overlap, images=False):
    df = spark.createDataFrame([(parts,)], "p array<string>")
    row = df.select(C.merged(F.col("p"), F.lit(low), F.lit(high), F.lit(overlap), F.lit(images)).alias("c")).first().c
    assert all(r.token_count == len(r.text.split()) for r in row)
    return [r.text for r in row]


@pytest.mark.parametrize(
    "sizes,low,high,overlap,images,golden",
    [([1, 1], 40, 300, 15, False, [2]), ([61, 51], 20, 60, 10, False, [61, 61]), ([57, 57], 20, 80, 5, False, [57, 62]), ([21, 16], 40, 100, 0, False, [37]), ([30] * 10, 30, 100, 0, False, [90, 90, 90, 30]),
     ([15] * 4, 10, 50, 5, False, [45, 20]), ([20] * 6, 10, 60, 5, False, [40, 45, 45]), ([100], 10, 80, 0, True, [0, 100]), ([5, 40], 10, 30, 3, False, [43]), ([14] + [20] * 50, 10, 30, 20, False, [14, 34] + [40] * 49)],
)
def test_merge_golden(spark, sizes, low, high, overlap, images, golden):
    parts = [" ".join(f"t{i}.{j}" for j in range(n)) for i, n in enumerate(sizes)]
    got = merge(spark, parts, low, high, overlap, images)
    assert [len(x.split()) for x in got] == golden and got == fold(parts, low, high, overlap, images)


def test_merge_random(spark):
    rng = random.Random(3)
    for _ in range(12):
        parts = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 12))]
        args = rng.choice([(10, 30, 20), (40, 300, 15), (10, 80, 0), (0, 25, 3)])
        images = rng.random() < 0.5
        assert merge(spark, parts, *args, images) == fold(parts, *args, images)


def test_splits(spark):
    text = " a \n 　\nb\n\nc\n---\nd \n\n\n"
    assert one(spark, text, C.by_paragraph) == ["a", "b", "c\n---\nd"]
    assert one(spark, text, C.by_blank_line) == ["a \n 　\nb", "c\n---\nd"]
    assert one(spark, text, C.by_slide) == ["a \n 　\nb\n\nc", "d"] and one(spark, text, C.by_row) == ["a", "b", "c", "---", "d"]
    assert one(spark, " ", C.by_sheet) == [] and one(spark, None, C.by_row) is None
    assert one(spark, 'One. Two! "Three?" Four', C.by_sentence) == ["One.", "Two!", '"Three?"', "Four"]


def test_segments_and_rejects(spark):
    rows = [(1, "a b\n\nc", ("txt", "d", None, None)), (2, None, ("txt", None, None, None)), (3, "x", ("md", None, None, None)), (4, "", (None, None, None, ["i.png"])), (5, "y z", ("", None, "f", None))]
    seg, rules = spark.createDataFrame(rows, SEGMENT), U.rules_frame(spark)
    got = C.chunk_segments(seg, rules).orderBy("ord").collect()
    assert [(r.ord, r.doc_id, r.doc_type, r.text) for r in got] == [(1, "d", "txt", "a b c"), (5, "f", "default", "y z")]
    assert got == C.chunk_segments(seg, rules).orderBy("ord").collect()
    assert [(r.ord, r.reason) for r in C.rejects(seg, rules).collect()] == [(3, "unsupported strategy: split_on_headings")]
    assert C.chunk_segments(seg.limit(0), rules).count() == 0


def test_rules():
    ok = {"default": dict(strategy="by_paragraph", min_tokens="5", max_tokens=9, overlap=1, extra=3)}
    assert U.validated(ok) == {"default": ("by_paragraph", 5, 9, 1)}
    for bad in ({"default": {"strategy": "x"}}, {"default": dict(strategy="x", min_tokens=9, max_tokens=9, overlap=0)}, {"a": ok["default"]}):
        with pytest.raises(ValueError):
            U.validated(bad)


def test_first_wins_and_anti_join(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, "b"), (5, "b")], "ord long, h string")
    assert sorted((r.ord, r.h) for r in D.first_wins(df, F.col("h"), "ord").collect() if r.h) == [(1, "a"), (5, "b")]
    assert D.first_wins(df, F.col("h"), "ord").count() == 4
    stored = spark.createDataFrame([("a",), (None,)], "h string")
    assert sorted(r.ord for r in D.not_stored(df, F.col("h"), stored).collect()) == [2, 4, 5, 5]
    assert D.with_content(spark.createDataFrame([("", None), (None, "x")], "a string, b string"), "a", "b").count() == 1


def test_retrieval(spark):
    rng = np.random.default_rng(1)
    vec = [(i, "ab"[i % 2] if i % 7 else None, f"c{i}", rng.normal(size=4).round(2).tolist()) for i in range(40)]
    vec += [(90, "a", "c90", vec[3][3]), (91, "a", "n", None), (92, "a", "w", [1.0]), (93, "a", "z", [0.0] * 4), (94, "a", "q", [float("nan")] * 4)]
    index = spark.createDataFrame(vec, "vec_pos long, doc_type string, chunk_id string, embedding array<float>")
    q = index.where("vec_pos in (3, 10)").select(F.col("vec_pos").alias("query_id"), "embedding")
    hits = V.nearest(q, index, 3, dim=4)
    x = {i: (t or "default", np.array(v, np.float32).astype(float)) for i, t, _, v in vec if v and len(v) == 4 and not np.isnan(v).any() and any(v)}
    for qi in (3, 10):
        for t in ("a", "b", "default"):
            want = sorted((((x[qi][1] - v) ** 2).sum(), i) for i, (k, v) in x.items() if k == t)[:3]
            got = hits.where((F.col("query_id") == qi) & (F.col("retriever") == t)).orderBy("rank").collect()
            assert [r.vec_pos for r in got] == [i for _, i in want] and np.allclose([r.distance for r in got], [d for d, _ in want])
    top = V.late_fusion(hits, 4).where("query_id = 3").orderBy("rank").collect()
    assert [r.vec_pos for r in top][:2] == [3, 90] and top[0].similarity == 1.0
    assert V.nearest(q.limit(0), index, 3, 4).count() == 0 and V.nearest(q, index.limit(0), 3, 4).count() == 0
    images = spark.createDataFrame([("i1", "c3", "p1", "x"), ("i2", "c3", "p2", None), ("i3", "zz", "p3", "y"), ("i4", None, "p4", "y")], "id string, source_chunk_id string, image_path string, description string")
    got = V.promoted(V.collapsed(hits).where("query_id = 3"), images).where("chunk_id = 'c3'").first()
    assert got.promoted_by_image and [s.image_path for s in got.image_summaries] == ["p1", "p2"]
    assert sorted(r.id for r in V.orphans(images, hits).collect()) == ["i3", "i4"]


def test_prompts(spark):
    df = spark.createDataFrame([("a\nb ", "t {x}", 2), (None, None, 0)], "s string, t string, p int")
    got = [r.i for r in df.select(P.context_item(P.source_name(F.col("s"), F.lit("d")), F.col("t"), F.col("p")).alias("i")).collect()]
    assert got == ["Source ID: [a b]\nContent: t {x}\nPage: 2", "Source ID: [d]\nContent: "]
    assert one(spark, [], P.context, "array<string>") == P.NO_CONTEXT and one(spark, ["a", "b"], P.context, "array<string>") == "a\n\n---\n\nb"
    with pytest.raises(ValueError):
        P.checked_template("{context_str}")


def test_error_policy_and_groups(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 4), (1, 5), (0, 3)], "e int, s int")
    assert [r.f for r in df.select(R.failed(F.col("e"), F.col("s")).alias("f")).collect()] == [False, True, True, False, False]
    assert [r.f for r in df.select(R.failed(F.col("e"), F.col("s"), soft=False).alias("f")).collect()] == [False, True, True, True, False]
    for n, groups in ((49, 1), (50, 1), (51, 2), (101, 3)):
        assert R.row_groups(spark.range(n).withColumn("k", F.lit(1)), ["k"], "id").select("group_no").distinct().count() == groups


def test_embedding(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "text string")
    rows = [r.embedding for r in E.hash_embedded(df, 16).collect()]
    assert abs(sum(x * x for x in rows[0]) - 1) < 1e-6 and not any(rows[1]) and not any(rows[2])
    got = E.embedded(df, lambda: lambda texts: np.array([[len(t), 1] for t in texts]), batch_size=2).collect()
    assert [r.embedding for r in got] == [[5.0, 1.0], [0.0, 1.0], [0.0, 1.0]]
    lines = spark.createDataFrame([('{"custom_id":"a","response":{"status_code":200,"body":{"data":[{"embedding":[1.0]}]}}}',), ('{"custom_id":"b","response":{"status_code":500}}',), ("{",)], "line string")
    assert [(r.chunk_id, r.embedding) for r in E.batch_results(lines).collect()] == [("a", [1.0])]


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_loaders(spark, tmp_path):
    from folioflux.sources.loaders import read_files

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    docx = zipped(**{"word/document.xml": f"<w:document {w}><w:body>{p(' one ')}{p('')}{p('three')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl></w:body></w:document>"})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rows = "".join(f'<row r="{i}"><c t="inlineStr"><is><t>v{i}</t></is></c><c><v>{i}</v></c></row>' if i != 7 else '<row r="7"/>' for i in range(1, 61))
    xlsx = zipped(**{"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><r Id="r1" Target="worksheets/s.xml"/></R>', "xl/worksheets/s.xml": f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>"})
    a = 'xmlns:p="x" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    body = lambda t: f"<p:x {a}><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:x>"
    pptx = zipped(**{"ppt/slides/slide1.xml": body("hi"), "ppt/slides/_rels/slide1.xml.rels": '<r Target="../notesSlides/n1.xml"/>', "ppt/notesSlides/n1.xml": body("note")})
    for name, data in {"a.txt": "é\n".encode(), "b.csv": b'x,"y,z"\r\n1,2\n', "c.eml": b"Subject: s\n\n body \n", "e.eml": b"Subject: s\n\n", "d.docx": docx, "s.xlsx": xlsx, "p.pptx": pptx, "bad.pptx": b"no", "x.TXT": b"no", "y.md": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in read_files(spark, str(tmp_path)).orderBy("path", "seq").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert sorted(got) == ["a.txt", "b.csv", "bad.pptx", "c.eml", "d.docx", "e.eml", "p.pptx", "s.xlsx"]
    text = {k: [r.content for r in v] for k, v in got.items()}
    assert text["a.txt"] == ["é\n"] and text["b.csv"] == ["x,y,z\n1,2\n"] and text["c.eml"] == ["body"] and text["e.eml"] == [""]
    assert text["d.docx"] == ["one", "three", "a | b"] and got["d.docx"][1].meta["paragraph_number"] == "3"
    assert text["p.pptx"] == ["hi", "Presenter Notes (Slide 1):\nnote"] and [r.meta["row_range"] for r in got["s.xlsx"]] == ["1-51", "52-60"]
    assert not got["bad.pptx"][0].ok and "UnsupportedFile" in got["bad.pptx"][0].error and got["a.txt"][0].meta["doc_type"] == "txt"


def test_tsv_and_stream(spark, tmp_path):
    from folioflux.sources.tables import append_index, read_chunk_tsv, read_metadata, write_chunk_tsv
    from folioflux.streaming.ingest import ingest

    chunks = spark.createDataFrame([("c1", "d", 'a "b"\tc', 3, "{}", "pdf"), ("c2", "d", "x", 1, "{}", "txt")], "chunk_id string, doc_id string, text string, token_count int, meta_json string, doc_type string")
    write_chunk_tsv(chunks, str(tmp_path / "t"))
    assert read_chunk_tsv(spark, str(tmp_path / "t" / "doc_type=pdf")).first().text == 'a "b"\tc'
    append_index(chunks, str(tmp_path / "i"))
    append_index(chunks, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 4
    (tmp_path / "m.jsonl").write_text('{"a":1}\n{bad\n{"a":2}\n')
    assert sorted(r.a for r in read_metadata(spark, str(tmp_path / "m.jsonl"), "a int").collect()) == [1, 2]
    rows = [(1, "a b c", ("txt", "d", None, None)), (2, "a b c", ("txt", "e", None, None))]
    seg = spark.createDataFrame(rows, SEGMENT)
    for n in range(3):
        if n < 2:
            seg.write.mode("append").parquet(str(tmp_path / "in"))
        q = ingest(spark, str(tmp_path / "in"), seg.schema, U.rules_frame(spark), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_pipeline(spark):
    from folioflux.plans.pipeline import ask, build_index

    rows = [(1, "valve pump report", ("txt", "d1", None, None)), (2, "budget and payroll", ("pdf", "d2", None, None)), (3, "valve pump report", ("txt", "d3", None, None)), (4, " ", ("txt", "d4", None, None))]
    index = build_index(spark.createDataFrame(rows, SEGMENT), U.rules_frame(spark)).cache()
    assert index.count() == 2
    got = ask(spark, index, "pump valve", lambda prompt: "ok", k=1)
    assert got.text == "ok" and got.sources == ["d1"] and "valve pump report" in got.prompt
    assert ask(spark, index, "x", lambda p: 1 / 0).text.startswith("[ERROR]")


def test_queries_run_on_small_tables(spark):
    duckdb = pytest.importorskip("duckdb")
    from folioflux.queries import ORACLES, QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("segments", "chunks", "images", "vectors", "rules"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("token_count", "clean_all", "split_paragraph", "dedup_segments", "knn_per_index", "context_join"):
        df = QUERIES[name](spark, d)
        want = con.sql(ORACLES[name])
        cols = sorted(df.columns)
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        rnd = lambda v: round(v, 5) if isinstance(v, float) else v
        assert sorted((tuple(rnd(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(rnd(r[i]) for i in at) for r in want.fetchall()), key=repr), name


def test_no_llm_import_in_the_core():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "folioflux"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", f.read_text()), f
