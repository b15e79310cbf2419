"""A project's steps one after the other: ingest, chunk, enrich, index_images, embed, retrieve, ask."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Project, chosen_model, logger, lookup
from ..operators import chunking, enrich
from ..operators.dedup import first_wins
from ..operators.embedders import Embedder, embedder
from ..operators.embedding import enriched_or_base
from ..operators.images import image_index
from ..operators.rules import rules_frame
from ..functions.text import segment_hash
from ..sources.loaders import read_files, read_images
from ..sources.tables import read_index, save_images, write_enriched, write_run
from .completion import HttpCompleter, captioner
from .pipeline import Answer, answer_of, index_rows, retrieve

#: Fields of a segment's metadata and their types; others are left in the loader's map.
META = {
    "doc_type": "string", "doc_id": "string", "source_filepath": "string", "page_number": "int", "slide_number": "int", "paragraph_number": "int", "table_number": "int", "num_pages": "int",
    "type": "string", "sheet_name": "string", "row_range": "string", "title": "string", "author": "string", "created": "string", "modified": "string", "content_type": "string",
}
_CARRY = ("image_paths", "page_number", "source_filepath")
FULL = ("ingest", "chunk", "enrich", "index_images", "embed", "retrieve", "ask")


class StepFailed(Exception):
    """A step's errors are too many to go on."""


def segments_of(files: DataFrame) -> DataFrame:
    """Segments (ord, content, meta, seq) of read files; ord is a hash of path and place."""
    meta = F.struct(*[F.col("meta")[k].cast(t).alias(k) for k, t in META.items()], F.from_json(F.col("meta")["image_paths"], "array<string>").alias("image_paths"))
    return files.where("ok").select(F.xxhash64("path", "seq").alias("ord"), "content", meta.alias("meta"), "seq")


class Runner:
    """Runs the steps of a project; every step reads what the one before has written.

    embed, caption (path and text to a description, made once a task), complete and translate are
    plug-ins; without them they come from the configuration. run_id names the run's folder."""

    def __init__(self, spark: SparkSession, project: Project, embed: Embedder | None = None, caption: Callable | None = None, complete: Callable[[str], str] | None = None, translate: Callable[[str], str] | None = None, run_id: str | None = None):
        self.spark, self.project, self.config = spark, project, project.config
        self.embed = embed or embedder(lookup(self.config, "embedding", {}))
        self.caption, self.complete, self.translate = caption, complete, translate
        self.run_id, self.model, self.steps = run_id or time.strftime("run_%Y%m%d_%H%M%S"), None, []
        self.log = logger(f"runner.{project.root.resolve()}", project.log_path("pipeline"), run_id=self.run_id)
        self.found: DataFrame | None = None
        self.answer: Answer | None = None

    def set_model(self, model: str) -> None:
        self.model = model

    def add_step(self, name: str, **arguments) -> None:
        """Put a step at the end; an unknown one raises ValueError."""
        if not hasattr(self, f"step_{name}"):
            raise ValueError(f"unknown step {name!r}")
        self.steps.append((name, arguments))

    def run_steps(self) -> Iterator[str]:
        """What happens, a line at a time. The first error is logged and ends the run."""
        for name, arguments in self.steps:
            began = time.time()
            yield f"{name} begins"
            try:
                yield from getattr(self, f"step_{name}")(**arguments)
            except Exception as e:
                self.log.error(f"{name} failed", extra_data={"step": name, "error": str(e)})
                raise
            self.log.info(f"{name} done", extra_data={"step": name, "seconds": round(time.time() - began, 3)})
            yield f"{name} is done"

    def run_full_pipeline(self, query: str) -> Iterator[str]:
        """All steps, from the raw files to an answer."""
        self.steps = [(s, {"query": query} if s in ("retrieve", "ask") else {}) for s in FULL]
        yield from self.run_steps()

    def run_query_only(self, query: str) -> Iterator[str]:
        """The last two steps over the index as it is."""
        self.steps = [("retrieve", {"query": query}), ("ask", {"query": query})]
        yield from self.run_steps()

    def _read(self, key: str) -> DataFrame | None:
        return self.spark.read.parquet(str(self.project.path(key))) if self.project.held(key) else None

    def _write(self, df: DataFrame, key: str, mode: str = "overwrite", by: str | None = "doc_type") -> None:
        out = df.write.mode(mode)
        (out.partitionBy(by) if by else out).parquet(str(self.project.path(key)))

    def step_ingest(self) -> Iterator[str]:
        """Raw files to segments, the first of every content; images to the image folder."""
        raw = str(self.project.path("raw"))
        files = read_files(self.spark, raw)
        rows = segments_of(files)
        rows = rows.withColumns({"h": segment_hash(F.col("content"), F.col("meta.image_paths")), "file": F.col("meta.source_filepath")})
        rows = first_wins(rows, F.col("h"), "file", "seq").drop("h", "file", "seq")
        self._write(rows, "segments", by=None)
        for r in files.where(~F.col("ok")).select("path", "error").limit(100).collect():  # for the log
            self.log.warning("file left out", extra_data={"path": r.path, "error": r.error})
        saved = save_images(read_images(self.spark, raw), str(self.project.path("images").parent.parent))
        yield f"{self._read('segments').count()} segments, {saved} images"

    def step_chunk(self, fail_fast: bool = False) -> Iterator[str]:
        """Segments to chunks; raises StepFailed where the error policy says so."""
        segments, rules = self._read("segments"), rules_frame(self.spark)
        totals = chunking.outcomes(segments, rules).agg(F.sum("successes").alias("ok"), F.sum("errors").alias("bad")).first()
        ok, bad = totals.ok or 0, totals.bad or 0
        if (fail_fast and bad) or bad and (not ok or bad / (bad + ok) >= 0.2):
            raise StepFailed(f"{bad} of {bad + ok} segments can't be chunked")
        self._write(chunking.chunk_segments(segments, rules, strict=True, carry=_CARRY), "chunks")
        yield f"{ok} segments chunked, {bad} rejected"

    def step_enrich(self, overwrite: bool = False) -> Iterator[str]:
        """Captions of the chunks' images, as summaries on the chunk; types done before are kept unless overwrite."""
        caption = self.caption
        if caption is None and lookup(self.config, "agents.image_insight"):
            caption = captioner(self._completer(), lookup(self.config, "agents.image_prompt", ""), str(self.project.path("images").parent.parent))
        if caption is None:
            yield "no captioner, chunks stay as they are"
            return
        chunks = self._read("chunks")
        kinds = write_enriched(enrich.with_summaries(chunks, enrich.captions(chunks, caption)), str(self.project.path("enriched")), overwrite)
        yield f"enriched: {', '.join(kinds) or 'nothing new'}"

    def step_index_images(self, doc_types: tuple[str, ...] | None = ("pptx", "pdf", "docx")) -> Iterator[str]:
        """Descriptions of enriched chunks to the image index, those that it lacks."""
        rows = self._read("enriched")
        if rows is None:
            yield "nothing is enriched, no images to index"
            return
        fresh = image_index(enrich.flattened(rows, ("doc_type", "source_filepath", "page_number")), self._read("image_index"), self.embed, doc_types)
        self._write(fresh, "image_index", "append", None)
        stored = self._read("image_index")
        yield f"{stored.count() if stored is not None else 0} images in the index"

    def step_embed(self) -> Iterator[str]:
        """Chunks, enriched ones where there are, to the index; stored texts are left out unless the configuration says otherwise."""
        base, rich = self._read("chunks"), self._read("enriched")
        rows = base if rich is None else enriched_or_base(base.withColumn("image_summaries", F.lit(None).cast(rich.schema["image_summaries"].dataType)), rich, "doc_type")
        stored = self._read("index") if lookup(self.config, "embedding.skip_duplicates", True) else None
        self._write(index_rows(rows, stored, self.embed, insight=bool(lookup(self.config, "embedding.insight", False))), "index", "append")
        yield f"{self._read('index').count()} vectors in the index"

    def step_retrieve(self, query: str, k: int | None = None, where=None) -> Iterator[str]:
        """What the index has for a query; kept in found."""
        index = read_index(self.spark, str(self.project.path("index")))
        translate = self.translate or (self._completer().translate if lookup(self.config, "embedding.translate_query") else None)
        k, dim = k or lookup(self.config, "retrieval.k", 5), int(lookup(self.config, "embedding.dim", 64))
        name = lookup(self.config, "retrieval.strategy", "late_fusion")
        self.found = retrieve(self.spark, index, [query], k, self._read("image_index"), self.embed, dim, where, translate, name).cache()
        yield f"{self.found.count()} results"

    def step_ask(self, query: str, model: str | None = None) -> Iterator[str]:
        """An answer out of what was retrieved; prompt, response and results go to the run's folder."""
        if self.found is None:
            yield from self.step_retrieve(query)
        self.answer = answer_of(self.found, query, self.complete or self._completer(model))
        images = self.found.where("kind = 'image'")
        write_run(self.spark, str(self.project.path("logs") / "runs"), self.run_id, self.found.where("kind = 'text'"), self.answer.prompt, self.answer.text, images, query=query, model=chosen_model(model, self.model, self.config))
        yield self.answer.text

    def _completer(self, model: str | None = None) -> HttpCompleter:
        c = lookup(self.config, "completion", {})
        return HttpCompleter(c.get("endpoint", ""), chosen_model(model, self.model, self.config), c.get("temperature", 0.7), c.get("max_tokens", 500), c.get("key_variable", ""))
