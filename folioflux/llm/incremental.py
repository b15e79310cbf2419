"""Problem 4: new batches against everything that has come before.

A history is a folder of written tables, added to by every delivery and opened again by its path:
the blocking keys of all texts seen (index entries of the set-similarity join, with sizes and
bitmaps), the distinct texts, the rows' chunk_ids, the links, and the clusters as pointers from
representatives to those that they were joined to (union-find); beside them the frequency sketch
that fixed the order of the keys. A delivery's keys, classes and chunk_ids are marked in bit maps
of fixed size; of the stored tables only rows with a mark leave the place where they are read. So
what is shuffled, compared and written follows the delivery, not the history, and links move only
the representatives that they touch.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import membership, shingles as sh
from .components import components, flattened, resolved
from .near_duplicates import LEAST_WORDS, SIMILARITY, WIDTH, candidates, entries_still_needed, postings, sketch, verified
from .runtime import exists, new_path, remove, with_words, written

#: Tables of a history; each has a folder for every delivery, that of the state is written last.
TABLES = {
    "rows": "chunk_id string, batch_id int, doc_id string, cls long, n int",
    "texts": "cls long, words string, first_batch int",
    "keys": "token long, cls long, meta long, bits binary",
    "links": "a long, b long, common int, size_a int, size_b int",
    "parents": "node long, root long",
    "state": "part int, clustered boolean, within boolean, order binary, counted binary",
}


class History:
    """What is kept of the batches that have been admitted.

    path: a folder that all executors share; what has been admitted there goes on (default: a new
    one under spark.checkpoint.dir, deleted with the session). A delivery that broke off leaves no
    state and is written over. Batches must come in order; several may come at once, each row then
    counts as earlier than rows of a larger batch_id. Rows with a null batch_id are not admitted.
    clustered: whether the clusters are kept. within: whether the links within the first load are,
    which the clusters need (default: with them). repetitions() needs neither. A history that is
    opened again keeps what it was made with.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, clustered: bool = True, within: bool = False):
        self.spark, self.path, self.clustered, self.within = spark, path or new_path(spark, "history"), clustered, within or clustered
        self.temporary = path is None
        self.parts, self.order, self.counted = 0, np.zeros(0, np.uint16), np.zeros(0, np.uint16)
        if path and exists(spark, f"{path}/state/0/_SUCCESS"):
            while exists(spark, f"{path}/state/{self.parts}/_SUCCESS"):
                self.parts += 1
            first, last = self._part("state", 0).first(), self._part("state", self.parts - 1).first()
            self.clustered, self.within = first.clustered, first.within
            self.order, self.counted = np.frombuffer(first.order, np.uint16), np.frombuffer(last.counted, np.uint16)

    def _part(self, name: str, part: int) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/{part}")

    def _read(self, name: str) -> DataFrame:
        paths = [f"{self.path}/{name}/{k}" for k in range(self.parts)]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/{self.parts}")
        return self._part(name, self.parts)

    texts = property(lambda self: self._read("texts"))
    keys = property(lambda self: self._read("keys"))
    rows = property(lambda self: self._read("rows"))
    links = property(lambda self: self._read("links"))

    def admit(self, rows: DataFrame) -> None:
        """Take in rows (chunk_id, batch_id, text and, if there is one, doc_id): write their keys, texts, chunk_ids, links and what the links join."""
        doc_id = F.col("doc_id") if "doc_id" in rows.columns else F.lit(None).cast("string")
        rows = rows.where(F.col("batch_id").isNotNull()).select("chunk_id", "batch_id", doc_id.alias("doc_id"), "text")
        cut = with_words(rows, LEAST_WORDS, counted=True)
        delivery = new_path(self.spark, "delivery")
        cut.write.option("compression", "zstd").parquet(delivery)
        cut = self.spark.read.schema(cut.schema).parquet(delivery)
        self._write(cut.where("chunk_id is not null").select("chunk_id", "batch_id", "doc_id", "cls", "n").distinct(), "rows")
        fresh = cut.where("cls is not null").groupBy("cls", "words").agg(F.min("batch_id").alias("first_batch"))
        if self.parts:
            known = membership.split(self.texts.select("cls"), membership.of(cut.select("cls")))
            fresh = fresh.join(known, "cls", "left_anti")
        fresh = self._write(fresh, "texts")
        remove(self.spark, delivery)
        seen = sketch(fresh, WIDTH)
        if not self.parts:
            self.order, self.counted = seen, np.zeros_like(seen)
        drop = sh.alone(self.counted, seen)
        new = entries_still_needed(self._write(postings(fresh, self.order, WIDTH, SIMILARITY, fresh=True), "keys"), drop)
        if self.parts:
            # Only stored entries whose key the delivery may have.
            old = membership.split(self.keys, membership.of(new.select("token")), "token").withColumn("meta", F.col("meta").bitwiseAND(F.lit(~1)))
            texts = self.texts.unionByName(fresh).select("cls", "words")
            self._write(verified(candidates(old.unionByName(new), SIMILARITY, all_fresh=False), texts, WIDTH, SIMILARITY), "links")
        elif self.within:
            self._write(verified(candidates(new, SIMILARITY), fresh.select("cls", "words"), WIDTH, SIMILARITY), "links")
        else:  # links within the first load make no row a repetition
            self._write(self.spark.createDataFrame([], TABLES["links"]), "links")
        if self.clustered:
            self._join(self._part("links", self.parts))
        self.counted = sh.frequency_class(sh.class_least(self.counted) + sh.class_least(seen))
        order = self.order.tobytes() if not self.parts else None
        self._write(self.spark.createDataFrame([(self.parts, self.clustered, self.within, order, self.counted.tobytes())], TABLES["state"]), "state")
        if not self.parts and self.temporary:
            remove(self.spark, self.path, at_exit=True)
        self.parts += 1

    def _join(self, links: DataFrame) -> None:
        """Union-find over a delivery's links: the representatives that they join get a pointer to the smallest of them."""
        ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if self.parts:
            at = resolved(ends, self._read("parents"))
            to = lambda name: at.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
            links = links.join(to("a"), "a").join(to("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        self._write(components(links.select("a", "b")).where("node <> root"), "parents")

    def repetitions(self) -> DataFrame:
        """(batch_id, chunk_id) of the last delivery's rows whose chunk_id or a text like theirs came in an earlier batch.

        A text that the delivery brought has all its links among the delivery's own; one that came
        before is a repetition by itself. So the links of earlier deliveries are not read.
        """
        mine, links = self._part("rows", self.parts - 1), self._part("links", self.parts - 1).select("a", "b")
        hashed = self.rows.withColumn("h", F.xxhash64("chunk_id"))
        same_id = membership.split(hashed, membership.of(mine.select(F.xxhash64("chunk_id").alias("h"))), "h")
        first_id = same_id.groupBy("chunk_id").agg(F.min("batch_id").alias("first_id"))
        ends = links.unionAll(links.select("b", "a")).toDF("cls", "other")
        wanted = membership.of(mine.select("cls").where("cls is not null").unionAll(ends.select("other")))
        first = membership.split(self.texts.select("cls", "first_batch"), wanted)
        linked = ends.join(first.withColumnRenamed("cls", "other"), "other").groupBy("cls").agg(F.min("first_batch").alias("first_batch"))
        first_like = first.unionByName(linked).groupBy("cls").agg(F.min("first_batch").alias("first_like"))
        late = mine.join(first_id, "chunk_id", "left").join(first_like, "cls", "left").where("first_id < batch_id or first_like < batch_id")
        return late.select("batch_id", "chunk_id").distinct()

    def clusters(self) -> DataFrame:
        """(node, root): representative of every linked text class over all deliveries; classes without a link are left out."""
        if not self.clustered:
            raise ValueError("this history keeps no clusters")
        return flattened(self._read("parents"))


def clustered_rows(chunks: DataFrame) -> DataFrame:
    """(batch_id, chunk_id, class_id, cluster): the cluster of every row whose text has enough words, repeated rows once.

    class_id is the MD5 of the text's words between single spaces, cluster the smallest class_id
    that links lead to, the class's own where there is none. A chunk_id delivered with different
    texts has a row for each.
    """
    history = History(chunks.sparkSession)
    history.admit(chunks.where("batch_id = 0"))
    history.admit(chunks.where("batch_id > 0"))
    named = history.texts.select("cls", F.md5(F.col("words").cast("binary")).alias("class_id"))
    roots = history.clusters()
    heads = roots.join(named, F.col("node") == F.col("cls")).groupBy("root").agg(F.min("class_id").alias("head"))
    classes = named.join(roots, F.col("cls") == F.col("node"), "left").join(heads, "root", "left").select("cls", "class_id", F.coalesce("head", "class_id").alias("cluster"))
    rows = history.rows.where("cls is not null").select("batch_id", "chunk_id", "cls").distinct()
    return rows.join(classes, "cls").select("batch_id", "chunk_id", "class_id", "cluster")


def found_rows(chunks: DataFrame) -> DataFrame:
    """Problem 4's cases: batch 0 is the history, the later batches are probed against it and each other in order."""
    history = History(chunks.sparkSession, clustered=False)
    history.admit(chunks.where("batch_id = 0"))
    history.admit(chunks.where("batch_id > 0"))
    return history.repetitions()


def match_weights(patterns: list[tuple[tuple, int]], rounds: int = 50) -> list[dict]:
    """Fellegi-Sunter weights learned without labels: log2(m/u) of every value of every field.

    patterns: (values of the fields, number of pairs) of all pairs compared; their number is
    bounded by the fields' values, not by the pairs. EM over two latent classes under conditional
    independence; the class with the larger weight of the first field's largest value is 'match'.
    """
    if not patterns:
        return []
    fields = len(patterns[0][0])
    values = [sorted({p[k] for p, _ in patterns}) for k in range(fields)]
    m = [{v: (i + 1) / sum(range(1, len(vs) + 1)) for i, v in enumerate(vs)} for vs in values]
    u = [{v: (len(vs) - i) / sum(range(1, len(vs) + 1)) for i, v in enumerate(vs)} for vs in values]
    share, total = 0.5, sum(n for _, n in patterns)
    for _ in range(rounds):
        new_m, new_u, matched = [dict.fromkeys(v, 0.5) for v in values], [dict.fromkeys(v, 0.5) for v in values], 0.0
        for p, n in patterns:
            a = share * math.prod(m[k][p[k]] for k in range(fields))
            b = (1 - share) * math.prod(u[k][p[k]] for k in range(fields))
            w = n * a / (a + b) if a + b else 0.0
            matched += w
            for k in range(fields):
                new_m[k][p[k]] += w
                new_u[k][p[k]] += n - w
        share = min(0.999, max(0.001, matched / total))
        m = [{v: x / sum(d.values()) for v, x in d.items()} for d in new_m]
        u = [{v: x / sum(d.values()) for v, x in d.items()} for d in new_u]
    return [{v: math.log2(m[k][v] / u[k][v]) for v in values[k]} for k in range(fields)]


def earlier_pairs(history: History) -> DataFrame:
    """Rows of later batches beside earlier rows with their chunk_id or a text like theirs, with the compared fields.

    (batch_id, chunk_id, earlier_batch_id, earlier_chunk_id, jaccard, f0 .. f3): Jaccard in tenths
    (null and -1 where the texts are not linked), same file, same number of words within a tenth,
    same chunk_id. Of the earlier rows that agree in the fields the first is there, so that a text
    with many copies is a few partners: per linked class the first five of the rows that are
    among the first two chunk_ids of their file and the first two files of their chunk_id (a row's
    own file and chunk_id hide four at most), two by the row's file, and all texts of its chunk_id.
    """
    rows = history.rows.distinct()
    firsts = rows.groupBy("cls", "doc_id", "chunk_id", "n").agg(F.min("batch_id").alias("batch_id"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("batch_id", "chunk_id", F.col("doc_id").asc_nulls_last()))
    in_file = firsts.where("cls is not null").withColumn("r", rank("cls", "doc_id")).where("r <= 2").drop("r")
    heads = in_file.withColumn("r", rank("cls", "chunk_id")).where("r <= 2").withColumn("r", rank("cls")).where("r <= 5").drop("r")
    ends = history.links.select("a", "b", (F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))).alias("jaccard"))
    ends = ends.unionAll(ends.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    ends = ends.unionAll(history.texts.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("jaccard")))
    late = rows.where("batch_id > 0")
    linked = written(late.join(ends, F.col("cls") == F.col("a")), "linked-rows")
    of_class = linked.join(heads.select(F.col("cls").alias("b"), F.struct("batch_id", "chunk_id", "doc_id", "n").alias("e")), "b")
    of_file = linked.join(in_file.select(F.col("cls").alias("b"), "doc_id", F.struct("batch_id", "chunk_id", "doc_id", "n").alias("e")), ["b", "doc_id"])
    of_id = late.join(firsts.select("chunk_id", F.col("cls").alias("b"), F.struct("batch_id", "chunk_id", "doc_id", "n").alias("e")), "chunk_id")
    of_id = of_id.where("e.batch_id < batch_id").join(ends, (F.col("cls") == ends["a"]) & (of_id["b"] == ends["b"]), "left").drop("a", "b")
    columns = ["batch_id", "chunk_id", "doc_id", "n", "e", "jaccard"]
    pairs = of_class.select(*columns).unionByName(of_file.select(*columns)).unionByName(of_id.select(*columns)).where("e.batch_id < batch_id").distinct()
    return pairs.select(
        "batch_id", "chunk_id", F.col("e.batch_id").alias("earlier_batch_id"), F.col("e.chunk_id").alias("earlier_chunk_id"), "jaccard",
        F.coalesce(F.floor(F.col("jaccard") * 10).cast("int"), F.lit(-1)).alias("f0"),
        F.coalesce(F.col("e.doc_id") == F.col("doc_id"), F.lit(False)).cast("int").alias("f1"),
        (F.abs(F.col("e.n") - F.col("n")) * 10 <= F.col("n")).cast("int").alias("f2"),
        (F.col("e.chunk_id") == F.col("chunk_id")).cast("int").alias("f3"),
    )


def scored_links(chunks: DataFrame) -> DataFrame:
    """Each repeated row with its best earlier row: the one whose fields agree with the greatest learned weight.

    (batch_id, chunk_id, earlier_batch_id, earlier_chunk_id, jaccard, score), a row for each of
    found_rows(). Compared fields: Jaccard in tenths, same file, same number of words within a
    tenth, same chunk_id; jaccard is null where only the chunk_id is repeated.
    """
    history = History(chunks.sparkSession, clustered=False, within=True)
    history.admit(chunks.where("batch_id = 0"))
    history.admit(chunks.where("batch_id > 0"))
    pairs = written(earlier_pairs(history), "earlier-pairs")
    patterns = [((r.f0, r.f1, r.f2, r.f3), r.n) for r in pairs.groupBy("f0", "f1", "f2", "f3").agg(F.count("*").alias("n")).collect()]
    weights = match_weights(sorted(patterns))
    score = F.lit(0.0)
    for k, w in enumerate(weights):
        score = score + F.coalesce(F.create_map(*[F.lit(x) for kv in w.items() for x in kv])[F.col(f"f{k}")], F.lit(0.0))
    best = F.max(F.struct(F.round(score, 6).alias("score"), "jaccard", (-F.col("earlier_batch_id")).alias("b"), "earlier_chunk_id")).alias("best")
    return pairs.groupBy("batch_id", "chunk_id").agg(best).select(
        "batch_id", "chunk_id", (-F.col("best.b")).alias("earlier_batch_id"), "best.earlier_chunk_id", "best.jaccard", "best.score"
    )
