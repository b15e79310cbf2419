import io
import json
import logging

import pytest
from pyspark.sql import functions as F

from folioflux import cli, config
from folioflux.operators import embedders, images, reporting, retrieval
from folioflux.plans import completion
from folioflux.plans.pipeline import retrieve
from folioflux.plans.runner import Runner, StepFailed
from folioflux.sources import export


@pytest.fixture
def project(tmp_path):
    p = config.Project.create(tmp_path, "demo", agents={"image_insight": False})
    (p.path("raw") / "a.txt").write_text("valve pump report " * 20)
    (p.path("raw") / "b.txt").write_text("budget payroll " * 30)
    (p.path("raw") / "c.txt").write_text("valve pump report " * 20)  # the same again
    (p.path("raw") / "d.pdf").write_bytes(export.to_pdf(["first page on cranes " * 10, "second page on ships " * 10]))
    (p.path("raw") / "bad.pdf").write_bytes(b"no")
    return p


def test_full_pipeline(spark, project):
    runner = Runner(spark, project, complete=lambda prompt: f"seen {prompt.count('Source ID')}", run_id="r1")
    lines = list(runner.run_full_pipeline("pump valve report"))
    assert lines[0] == "ingest begins" and "4 segments, 0 images" in lines and lines[-1] == "ask is done"
    assert runner.answer.text == f"seen {runner.found.count()}" and runner.answer.sources[0].endswith("a.txt")
    assert spark.read.parquet(str(project.path("index"))).count() == 4
    run = project.path("logs") / "runs" / "run_id=r1"
    assert {p.name for p in run.iterdir()} == {"retrieved_chunks", "image_matches", "answer", "run_metadata"}
    assert spark.read.json(str(run / "run_metadata")).first().query == "pump valve report"
    logged = [json.loads(x) for x in project.log_path("pipeline").read_text().splitlines()]
    assert {"file left out"} <= {x["message"] for x in logged} and all(x["run_id"] == "r1" for x in logged)
    # again: nothing new is embedded; the query alone
    again = Runner(spark, project, complete=lambda p: 1 / 0, run_id="r2")
    again.add_step("embed")
    list(again.run_steps())
    assert spark.read.parquet(str(project.path("index"))).count() == 4
    list(again.run_query_only("ships"))
    assert again.answer.text.startswith("[ERROR]") and any("page 2" in s for s in again.answer.sources)
    with pytest.raises(ValueError):
        again.add_step("fly")
    assert project.readiness() == [] and project.preconditions(["ask"], "q") == ([], [])


def test_images_through_the_steps(spark, project):
    def caption():
        return lambda path, text: f"a picture of {path.rsplit('/', 1)[-1]}"

    runner = Runner(spark, project, caption=caption, complete=lambda p: "ok", run_id="r3")
    list(runner.step_ingest())
    seg = spark.read.parquet(str(project.path("segments")))
    shown = F.when(F.col("meta.doc_type") == "pdf", F.array(F.concat(F.lit("cache/images/i"), F.col("meta.page_number").cast("string"), F.lit(".png"))))
    rows = seg.select("ord", "content", F.col("meta").withField("image_paths", shown).alias("meta")).collect()
    spark.createDataFrame(rows, seg.schema).write.mode("overwrite").parquet(str(project.path("segments")))
    said = [list(getattr(runner, f"step_{step}")()) for step in ("chunk", "enrich", "index_images", "index_images", "embed")]
    assert said[1] == ["enriched: pdf, txt"] and said[2] == said[3] == ["2 images in the index"]
    assert list(runner.step_enrich()) == ["enriched: nothing new"]
    index = spark.read.parquet(str(project.path("image_index")))
    assert sorted(r.description for r in index.collect()) == ["a picture of i1.png", "a picture of i2.png"]
    list(runner.step_retrieve("first page on cranes", k=10))
    found = runner.found.collect()
    cranes = next(r for r in found if "cranes" in r.content)
    assert cranes.promoted_by_image and [s.image_path for s in cranes.image_summaries] == ["cache/images/i1.png"] and all(r.kind == "text" for r in found)
    list(runner.step_retrieve("first page on cranes", k=1))
    assert [r.kind for r in runner.found.orderBy("rank").collect()][0] == "text"


def test_chunking_gives_up(spark, project):
    runner = Runner(spark, project)
    rows = [(i, "text", ("md" if i < 2 else "txt", "d", f"f{i}", None, None)) for i in range(5)]
    spark.createDataFrame(rows, "ord long, content string, meta struct<doc_type:string,doc_id:string,source_filepath:string,image_paths:array<string>,page_number:int>").write.mode("overwrite").parquet(str(project.path("segments")))
    runner.add_step("chunk")
    with pytest.raises(StepFailed):
        list(runner.run_steps())


def test_command_line(spark, project, capsys):
    root = str(project.root)
    assert cli.main(["retrieve", root, "x"]) == 1 and "there is no index" in capsys.readouterr().out
    for command in ("ingest", "enrich-images", "index-images", "embed", "files"):
        assert cli.main([command, root]) == 0
    capsys.readouterr()
    assert cli.main(["ask", root, "ships page", "-k", "2"], complete=lambda p: "the answer") == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "the answer" and out[1].startswith("[1] ") and out[1].endswith("d.pdf, page 2")
    assert cli.main(["run", root], complete=lambda p: "") == 0


def test_multi_query_and_errors(spark):
    assert retrieval.asked_twice(["a", "b"], lambda t: t.upper()) == [(0, 0, "a"), (0, 1, "A"), (1, 0, "b"), (1, 1, "B")]
    assert retrieval.asked_twice(["a"], lambda t: 1 / 0) == [(0, 0, "a")]
    index = spark.createDataFrame([("c1", "d1", "pump valve"), ("c2", "d2", "pompe vanne"), ("c3", "d3", "")], "chunk_id string, doc_id string, text string")
    from folioflux.operators.embedding import hash_embedded

    index = hash_embedded(index).withColumn("vec_pos", F.xxhash64("chunk_id")).withColumn("doc_type", F.lit("txt"))
    got = retrieve(spark, index, ["pump valve"], 1, translate=lambda t: "pompe vanne").orderBy("rank").collect()
    assert [(r.rank, r.id, r.doc_id) for r in got] == [(1, "c1", "d1"), (2, "c2", "d2")]
    with pytest.raises(ValueError):
        retrieval.strategy("best")
    with pytest.raises(retrieval.IndexBroken):
        retrieval.checked(index, index.limit(1))
    assert retrieval.checked(index, index).count() == 3 and retrieval.discovered(index, index.limit(0)).count() == 0
    none = spark.createDataFrame([], "query_id long, q_ord int, rank int, id string, source_chunk_id string, image_path string, description string, image_similarity double")
    hits = spark.createDataFrame([], "query_id long, q_ord int, rank int, chunk_id string, text string, similarity double")
    assert retrieval.final_results(hits, none).count() == 0


def test_many_queries_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 64))
    index = spark.createDataFrame([(i, "a" if i % 2 else "b", f"c{i}", [float(v) for v in e]) for i, e in enumerate(x)], "vec_pos long, doc_type string, chunk_id string, embedding array<float>")
    queries = index.select(F.col("vec_pos").alias("query_id"), "embedding")
    columns = ["query_id", "retriever", "vec_pos", "rank", F.round("distance", 9)]
    whole = sorted(map(tuple, retrieval.nearest(queries, index, 3).select(*columns).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, retrieval.nearest(queries, index, 3).select(*columns).collect())) == whole and len(whole) == 240
    assert images.nearest_images(queries.limit(1), index.select(F.col("chunk_id").alias("id"), "embedding"), 2).first().rank == 1


def test_embedders(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", "x y"), ("b", "z")], "chunk_id string, text string")
    assert len(embedders.embedder({"provider": "hash", "dim": 8})(df).first().embedding) == 8
    for bad in ({"provider": "none"}, {"provider": "http", "endpoint": "http://h", "model": "m", "mode": "odd"}):
        with pytest.raises(ValueError):
            embedders.embedder(bad)(df)
    sent = {}

    class Answer(io.BytesIO):
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return None

    def opened(request, timeout):
        sent.update(json.loads(request.data), key=request.headers.get("Authorization"))
        return Answer(json.dumps({"data": [{"embedding": [len(t), 0]} for t in sent["input"]]}).encode())

    monkeypatch.setattr("urllib.request.urlopen", opened)
    monkeypatch.setenv("SOME_KEY", "k")
    assert embedders.HttpEncoder("http://h", "m", "SOME_KEY")(["abc"]).tolist() == [[3.0, 0.0]] and sent["key"] == "Bearer k" and sent["model"] == "m"

    class Service:
        def __init__(self, states):
            self.states = list(states)

        def submit(self, path, window):
            self.path = path
            return "job"

        def status(self, job):
            return self.states.pop(0)

        def results(self, job):
            lines = [json.loads(r.value) for r in spark.read.text(self.path).collect()]
            out = [json.dumps({"custom_id": x["custom_id"], "response": {"status_code": 200 if x["custom_id"] == "a" else 500, "body": {"data": [{"embedding": [1.0]}]}}}) for x in lines]
            (tmp_path / "out.jsonl").write_text("\n".join(out))
            return str(tmp_path / "out.jsonl")

    waits = []
    got = embedders.batch_embedded(df, Service(["queued", "running", "completed"]), "m", str(tmp_path / "in"), wait=waits.append).collect()
    assert [(r.chunk_id, r.embedding) for r in got] == [("a", [1.0])] and waits == [5.0, 5.0]
    with pytest.raises(embedders.BatchFailed):
        embedders.batch_embedded(df, Service(["failed"]), "m", str(tmp_path / "in"))
    embedders.register("own", lambda c: lambda d: d.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    assert embedders.embedder({"provider": "own"})(df).first().embedding == [1.0]


def test_completion(monkeypatch, tmp_path):
    assert completion.request_body("gpt-5-x", [], 0.3, 9) == {"model": "gpt-5-x", "messages": [], "max_completion_tokens": 9}
    assert completion.request_body("other", [], 0.3, 9) == {"model": "other", "messages": [], "temperature": 0.3, "max_tokens": 9}
    model = completion.HttpCompleter("http://127.0.0.1:9/none", "m", timeout=0.2)
    (tmp_path / "i.png").write_bytes(b"x")
    assert model("hi").startswith("[ERROR]") and model.translate("hé") == "hé" and model.caption(str(tmp_path / "i.png"), "p") is None and model.translate("") == ""
    monkeypatch.setattr(completion.HttpCompleter, "_asked", lambda self, messages, t: f" {messages[-1]['content'] if t == 0 else len(messages[0]['content'])} ")
    assert model.translate("x") == "x" and model.caption(str(tmp_path / "i.png"), "p") == " 2 "
    made = completion.captioner(model, "T {{ context }}", str(tmp_path))()
    assert made("i.png", "c") == " 2 " and made("none.png", "c") is None


def test_configuration(tmp_path):
    p = config.Project.create(tmp_path, "a b", completion={"model": "m1"})
    assert config.check_file(p.file) == [] and p.config["completion"]["model"] == "m1" and p.path("raw").is_dir()
    p.file.write_text("paths: [1]\n")
    assert any("paths" in x for x in config.check_file(p.file))
    p.file.write_text("a: [")
    assert "can't be read" in config.check_file(p.file)[0] and config.check_file(tmp_path / "none.yml")
    assert config.wrong_types({"retrieval": {"k": "5"}, "completion": {"temperature": 1}}) == ["retrieval.k is str, not int"]
    assert config.secure_name("../a b/ç") == "a_b" and config.schema()["embedding"]["dim"] is int
    assert (config.chosen_model("c", "s", {}), config.chosen_model(None, "s", {}), config.chosen_model(None, None, {"completion": {"model": "f"}}), config.chosen_model()) == ("c", "s", "f", "gpt-4o")
    assert config.log_path(tmp_path, "x", "r").relative_to(tmp_path).as_posix() == "runs/r/x.log"


def test_run_logger(tmp_path):
    a = config.run_logger("one", tmp_path / "l" / "one.log", "r1", "INFO", as_json=True)
    assert a is config.run_logger("one", tmp_path / "other.log", "r1") and a is not config.run_logger("one", tmp_path / "two.log", "r2")
    assert len(a.handlers) == 2 and {type(h) for h in a.handlers} == {logging.FileHandler, logging.StreamHandler} and not a.propagate
    a.debug("not this")
    a.info("hi", extra={"extra_data": {"k": 1}})
    line = json.loads((tmp_path / "l" / "one.log").read_text())
    assert line["message"] == "hi" and line["k"] == 1 and line["logger"] == "one-r1"


def test_numbered(spark):
    rows = [(f"s{i % 3 if i < 90 else 0}" if i % 11 else None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "source string, ord long").repartition(5)
    got = {(r.source, r.ord): r.n for r in reporting.numbered(df, ["source"], "ord").collect()}
    for source in {s for s, _ in rows}:
        assert [got[source, o] for o in sorted(o for s, o in rows if s == source)] == list(range(sum(s == source for s, _ in rows)))
    assert reporting.numbered(df.limit(0), ["source"], "ord").count() == 0
