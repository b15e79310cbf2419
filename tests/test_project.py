import json

import pytest

from folioflux import cli
from folioflux.config import DEFAULTS, Project, logger, lookup, problems
from folioflux.operators import enrich


def test_config(tmp_path):
    p = Project.create(tmp_path, " My demo ")
    assert p.root.name == "My_demo" and p.missing() == ["raw", "chunks", "index"] and problems(p.config) == []
    with pytest.raises(FileExistsError):
        Project.create(tmp_path, "My demo")
    for bad in ("x", "a/b", "y" * 51):
        with pytest.raises(ValueError):
            Project.create(tmp_path, bad)
    assert lookup(DEFAULTS, "retrieval.k") == 5 and lookup(DEFAULTS, "a.b", 3) == 3
    assert len(problems({"paths": 1})) == len(DEFAULTS) + 3


def test_log(tmp_path):
    log = logger("t", tmp_path / "l", run="r1")
    log.info("hi", extra_data={"run": "other", "n": 2})
    line = json.loads((tmp_path / "l").read_text())
    assert line["message"] == "hi" and line["run"] == "r1" and line["n"] == 2 and line["level"] == "INFO"


def test_enrich(spark):
    chunks = spark.createDataFrame([("a", "text", ["1.png", "bad", "2.png"]), ("b", None, None), ("c", "x", [])], "chunk_id string, text string, image_paths array<string>")

    def captioner():
        def caption(path, text):
            if path == "bad":
                raise OSError
            return f"{path}:{text}"

        return caption

    found = enrich.captions(chunks, captioner)
    rows = {r.chunk_id: r.image_summaries for r in enrich.with_summaries(chunks, found).collect()}
    assert [s.description for s in rows["a"]] == ["1.png:text", "2.png:text"] and rows["b"] is None and rows["c"] is None
    assert enrich.flattened(enrich.with_summaries(chunks, found)).count() == 2
    kinds = [r.kind for r in enrich.as_rows(chunks, found).collect()]
    assert sorted(kinds) == ["image", "image", "text", "text", "text"]


def test_cli(spark, tmp_path, capsys):
    root = tmp_path / "demo"
    assert cli.main(["create", str(root)]) == 0 and cli.main(["config", str(root)]) == 0
    (root / "input/raw/a.txt").write_text("valve pump report")
    (root / "input/raw/b.txt").write_text("budget payroll")
    assert cli.main(["ingest", str(root)]) == 0
    for _ in range(2):
        assert cli.main(["embed", str(root)]) == 0
    assert spark.read.parquet(str(root / "output/index")).count() == 2
    capsys.readouterr()
    assert cli.main(["retrieve", str(root), "pump valve", "-k", "1"]) == 0
    assert "valve pump report" in capsys.readouterr().out
