"""python -m folioflux.cli COMMAND PROJECT [QUERY]: create, config, ingest, enrich-images, index-images, embed, retrieve, ask, run, files."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession, functions as F

from .config import Project, check_file
from .operators.reporting import first_ranks
from .plans.runner import Runner
from .sources.loaders import raw_listing

COMMANDS = ("create", "config", "files", "ingest", "enrich-images", "index-images", "embed", "retrieve", "ask", "run")


def main(args: list[str] | None = None, **plugins) -> int:
    """Run a command; plugins are those of Runner, for use from Python."""
    p = argparse.ArgumentParser(prog="folioflux", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("project", type=Path)
    p.add_argument("query", nargs="?")
    p.add_argument("-k", type=int)
    p.add_argument("--model")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--doc-types", nargs="*")
    a = p.parse_args(args)
    if a.command == "create":
        print(Project.create(a.project.parent, a.project.name).root)
        return 0
    project = Project(a.project)
    if a.command == "config":
        wrong = check_file(project.file)
        print(json.dumps(project.config, indent=2) if not wrong else "\n".join(wrong))
        return int(bool(wrong))
    spark = SparkSession.builder.appName("folioflux").getOrCreate()
    if a.command == "files":
        for r in raw_listing(spark, str(project.path("raw"))).orderBy("kind", "name").toLocalIterator():
            print(f"{r.kind}\t{r.name}\t{r.size_kib:.2f} KiB")
        return 0
    runner = Runner(spark, project, **plugins)
    steps = {
        "ingest": [("ingest", {}), ("chunk", {})],
        "enrich-images": [("enrich", {"overwrite": a.overwrite})],
        "index-images": [("index_images", {"doc_types": tuple(a.doc_types)} if a.doc_types else {})],
        "embed": [("embed", {})],
        "retrieve": [("retrieve", {"query": a.query, "k": a.k})],
        "ask": [("retrieve", {"query": a.query, "k": a.k}), ("ask", {"query": a.query, "model": a.model})],
        "run": [(s, {}) for s in ("ingest", "chunk", "enrich", "index_images", "embed")] + ([("retrieve", {"query": a.query, "k": a.k}), ("ask", {"query": a.query, "model": a.model})] if a.query else []),
    }[a.command]
    errors, warnings = project.preconditions([s for s, _ in steps], a.query or "")
    for line in (*warnings, *errors):
        print(line)
    if errors:
        return 1
    for name, arguments in steps:
        runner.add_step(name, **arguments)
    for line in runner.run_steps():
        if a.command in ("ingest", "run", "enrich-images", "index-images", "embed"):
            print(line)
    if a.command == "retrieve":
        for r in runner.found.orderBy("rank").collect():  # a top-k report
            print(f"{r.rank}\t{r.kind}\t{r.similarity:.4f}\t{r.doc_id}\t{' '.join((r.content or '')[:500].split())}")
    if runner.answer:
        print(runner.answer.text)
        ranked = runner.found.select("rank", F.coalesce("doc_id", "id").alias("doc_id"), "page_number")
        page = F.when(F.col("page_number") != 0, F.concat(F.lit(", page "), F.col("page_number").cast("string"))).otherwise("")
        for r in first_ranks(ranked, F.concat(F.col("doc_id"), page), "rank").orderBy("rank").collect():
            print(f"[{r.rank}] {r.source}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
