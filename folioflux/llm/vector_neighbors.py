"""Problem 2: the k most similar vectors of every vector, by an inverted multi-index.

Each half of the vectors has a codebook of its own; a vector's cell is the pair of its halves'
nearest centroids. A query goes through the pairs of centroids by the sum of the two distances, a
heap giving the next pair, until it has seen enough pairs and enough entries; the entries of those
cells, and of no others, are ranked by their exact distance. How many entries are enough is found
out beforehand: the true neighbours of a bounded sample of queries are looked up by a scan of all
entries, and the traversal goes as far as the recall that is asked for needs. Codebooks are fitted
on a bounded sample, every vector is indexed. Equal vectors are one entry with its smallest k + 1
positions.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .runtime import spread, written

#: Vectors on which the codebooks are fitted at least, and for each centroid: those with the smallest hash of their position.
SAMPLE, SAMPLE_EACH = 20_000, 40
#: Centroids of a half at least and at most. Beyond some 60 million vectors cells grow with the table.
LEAST_SIZE, MOST_SIZE = 16, 2_048
#: Pairs of centroids that every query visits at least, and entries after which it may stop.
LEAST_CELLS, LEAST_ENTRIES = 48, 512
#: Sampled queries whose true neighbours say how far to go, and recall that is asked for.
TRIALS, RECALL = 256, 0.97
#: Vectors (of one list) that one task compares, and a quarter of its queries; longer lists are cut into parts.
PART = 16_384
#: Queries that are compared at a time.
_BLOCK = 2_048


def codebook(x: np.ndarray, size: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of a sample by Lloyd's rounds from a seeded start; never more than there are distinct rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(size, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, c)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c.astype(np.float32)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], c).argmin(1) for i in range(0, max(1, len(x)), 4096)])


def traverse(d1: np.ndarray, d2: np.ndarray, filled: np.ndarray, least_cells: int, least_entries: int, wanted: set | None = None) -> list[tuple[int, int]]:
    """Cells in the order of the summed distance, until so many were seen and they hold so many entries, or the wanted ones were seen.

    filled[i, j]: entries of a cell. Empty cells are passed over without counting."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, out, entries = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and (len(out) < least_cells or entries < least_entries) and (wanted is None or wanted):
        _, i, j = heapq.heappop(heap)
        n = int(filled[o1[i], o2[j]])
        if n:
            out.append((int(o1[i]), int(o2[j])))
            entries += n
            if wanted is not None:
                wanted.discard(out[-1])
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_pos, embedding) of exactly dim elements, none null or NaN, not all zero; repeated rows once."""
    ok = (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    return vectors.where(F.col("vec_pos").isNotNull() & F.col("embedding").isNotNull()).where(ok).select("vec_pos", "embedding")


def codebook_size(count: int) -> int:
    """Centroids of each half: a power of two, so that a cell has some 15 entries, within the bounds."""
    return int(min(MOST_SIZE, max(LEAST_SIZE, 2 ** round(np.log2(max(1.0, count / 15) ** 0.5)))))


def entries_needed(entries: DataFrame, books, filled: np.ndarray, k: int, most: float | None, dim: int, recall: float) -> int:
    """Entries that a traversal must pass for the recall, by the true neighbours of a bounded sample of queries.

    The neighbours are found by one scan of all entries, of which every task sends k a query."""
    spark, half = entries.sparkSession, dim // 2
    sample = entries.select("h1", "h2", "v").orderBy(F.xxhash64("h1", "h2"), "h1", "h2").limit(TRIALS).collect()
    x = np.frombuffer(b"".join(bytes(r.v) for r in sample), np.float32).reshape(-1, dim)
    own = np.array([(r.h1, r.h2) for r in sample], np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((x, own))
    limit = np.inf if most is None else most

    def scan(batches):
        x, own = shared.value
        best, cells = np.full((len(x), k), np.inf), np.zeros((len(x), k, 2), np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, dim)
            d = distances(x, y).astype(np.float64)
            d[(own[:, :1] == batch.column(0).to_numpy()[None]) & (own[:, 1:] == batch.column(1).to_numpy()[None])] = np.inf
            here = np.broadcast_to(np.stack([batch.column(3).to_numpy(), batch.column(4).to_numpy()], 1), (len(x), len(y), 2))
            near = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
            d = np.concatenate([best, np.take_along_axis(d, near, 1)], 1)
            here = np.concatenate([cells, np.take_along_axis(here, near[:, :, None], 1)], 1)
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            best, cells = np.take_along_axis(d, near, 1), np.take_along_axis(here, near[:, :, None], 1)
        q, e = np.nonzero(best <= (limit if np.isfinite(limit) else np.finfo(np.float32).max))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best[q, e]), pa.array(cells[q, e, 0]), pa.array(cells[q, e, 1])], names=["q", "d", "c1", "c2"])

    near = entries.select("h1", "h2", "v", "c1", "c2").mapInArrow(scan, "q int, d double, c1 int, c2 int")
    near = near.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "c1", "c2"))), 1, k).alias("hits")).collect()  # k rows a sampled query
    d1, d2 = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
    before = []
    for r in near:
        wanted = [(h.c1, h.c2) for h in r.hits]
        passed, seen = 0, {}
        for cell in traverse(d1[r.q], d2[r.q], filled, filled.size, 0, set(wanted)):
            seen[cell] = passed
            passed += int(filled[cell])
        before += [seen[c] for c in wanted]
    if not before or recall >= 1:
        return int(filled.sum()) if recall >= 1 else 0
    return int(np.quantile(before, recall, method="higher")) + 1


def neighbours(
    vectors: DataFrame, k: int = 10, most: float | None = None, dim: int = 64, size: int | None = None, least_cells: int = LEAST_CELLS, least_entries: int = LEAST_ENTRIES,
    recall: float = RECALL, queries: str | Column | None = None,
) -> DataFrame:
    """(vec_pos, other, distance, rank): the k nearest other vectors by squared Euclidean distance.

    Ties go to the smaller vec_pos. Unusable vectors (null, of another length, with NaN or null
    elements, all zero) are ignored; an empty table gives no rows; a vec_pos with two different
    vectors has neighbours for each. most: keep only neighbours up to that distance. recall: the
    share of true neighbours that the traversal is led to find, 1 for all (every cell is then
    visited). queries: a filter on vec_pos; only these have rows, against all vectors.
    """
    spark = vectors.sparkSession
    half = dim // 2
    flat = F.transform("embedding", lambda x: x.cast("float"))
    rows = written(
        spread(usable(vectors, dim)).select("vec_pos", flat.alias("v"), F.xxhash64(flat).alias("h1"), F.xxhash64(F.lit(1), flat).alias("h2")).dropDuplicates(["vec_pos", "h1", "h2"]),
        "vectors",
    )
    count = rows.count()
    size = size or codebook_size(count)
    sample = rows.select("v", F.xxhash64("vec_pos", "h1").alias("o")).orderBy("o", "v").limit(max(SAMPLE, SAMPLE_EACH * size)).select("v").toArrow()["v"].combine_chunks()
    sample = _matrix(sample, dim)
    if not len(sample):
        return spark.createDataFrame([], "vec_pos long, other long, distance double, rank int")
    books = codebook(sample[:, :half], size), codebook(sample[:, half:], size)
    shared = spark.sparkContext.broadcast(books)

    # One entry per distinct vector: the head (h1, h2), its cell and its k + 1 smallest positions.
    first = F.row_number().over(_window(["h1", "h2"], ["vec_pos"]))
    heads = rows.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_pos")).alias("positions"))

    def assign(batches):
        b1, b2 = shared.value
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(3), pa.array(nearest(x[:, :half], b1).astype(np.int32)), pa.array(nearest(x[:, half:], b2).astype(np.int32))],
                names=["h1", "h2", "v", "positions", "c1", "c2"],
            )

    entries = written(heads.select("h1", "h2", "v", "positions").mapInArrow(assign, "h1 long, h2 long, v binary, positions array<long>, c1 int, c2 int"), "entries")
    cells = entries.groupBy("c1", "c2").agg(F.count("*").alias("n")).toArrow()  # at most size * size rows
    filled = np.zeros((len(books[0]), len(books[1])), np.int32)
    filled[cells["c1"].to_numpy(), cells["c2"].to_numpy()] = cells["n"].to_numpy()
    least_entries = max(least_entries, entries_needed(entries, books, filled, k, most, dim, recall))
    parts = np.maximum(1, -(-filled.sum(1) // PART))
    # A list that many queries visit is cut by queries too; how many will, a sample of them tells.
    trial = sample[:1024]
    d1, d2 = distances(trial[:, :half], books[0]), distances(trial[:, half:], books[1])
    visits = np.zeros(len(parts))
    if count > PART:
        for q in range(len(trial)):
            visits[sorted({i for i, _ in traverse(d1[q], d2[q], filled, least_cells, least_entries)})] += count / len(trial)
    ways = np.maximum(1, np.ceil(visits / (4 * PART)))
    lists = spark.createDataFrame(pa.table({"c1": pa.array(np.arange(len(parts), dtype=np.int32)), "parts": pa.array(parts.astype(np.int32)), "ways": pa.array(ways.astype(np.int32))}))
    lists = F.broadcast(lists)  # a row a centroid
    plan = spark.sparkContext.broadcast(filled)

    def probe(batches):
        b1, b2 = shared.value
        filled = plan.value
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, dim)
            d1, d2 = distances(x[:, :half], b1), distances(x[:, half:], b2)
            at, lists, seconds = [], [], []
            for q in range(len(x)):
                by_list: dict[int, list[int]] = {}
                for i, j in traverse(d1[q], d2[q], filled, least_cells, least_entries):
                    by_list.setdefault(i, []).append(j)
                for i, js in by_list.items():
                    at.append(q)
                    lists.append(i)
                    seconds.append(np.array(js, np.uint16).tobytes())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(lists, pa.int32()), pa.array(seconds, pa.binary())],
                names=["h1", "h2", "v", "c1", "seconds"],
            )

    asked = rows if queries is None else rows.where(queries)
    own = entries if queries is None else entries.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    probes = own.select("h1", "h2", "v").mapInArrow(probe, "h1 long, h2 long, v binary, c1 int, seconds binary").join(lists, "c1")
    probes = probes.select("h1", "h2", "v", "c1", "seconds", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod("h1", F.col("ways").cast("long")).cast("int").alias("way"))
    base = entries.select("v", "positions", "c1", "c2", "h2").join(lists, "c1").withColumn("part", F.pmod("h2", F.col("parts").cast("long")).cast("int"))
    base = base.select("v", "positions", "c1", "c2", "part", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))

    limit = float("inf") if most is None else most

    def compare(key, queries: pd.DataFrame, entries: pd.DataFrame):
        out = []
        if not len(queries) or not len(entries):
            return pd.DataFrame({"h1": [], "h2": [], "hits": []})
        y = np.frombuffer(b"".join(entries.v), np.float32).reshape(-1, dim)
        cell = entries.c2.to_numpy()
        order = np.argsort(cell, kind="stable")
        y, cell, positions = y[order], cell[order], entries.positions.to_numpy()[order]
        yy = (y.astype(np.float64) ** 2).sum(1)
        x = np.frombuffer(b"".join(queries.v), np.float32).reshape(-1, dim)
        xx = (x.astype(np.float64) ** 2).sum(1)
        here, begin = np.unique(cell, return_index=True)
        end = np.append(begin[1:], len(cell))
        js = [np.frombuffer(s, np.uint16) for s in queries.seconds]
        h1, h2 = queries.h1.to_numpy(), queries.h2.to_numpy()
        for start in range(0, len(x), _BLOCK):
            part = js[start : start + _BLOCK]
            q = np.repeat(np.arange(start, start + len(part)), [len(j) for j in part])
            at = np.searchsorted(here, c := np.concatenate(part))
            ok = at < len(here)
            ok[ok] = here[at[ok]] == c[ok]
            q, at = q[ok], at[ok]
            by = np.argsort(at, kind="stable")
            q, at = q[by], at[by]
            cuts = np.nonzero(np.diff(at))[0] + 1
            found = []
            for qs in np.split(np.arange(len(at)), cuts) if len(at) else []:  # one cell, and the queries that visit it
                i, mine = at[qs[0]], q[qs]
                lo, hi = begin[i], end[i]
                d = xx[mine][:, None] + yy[lo:hi][None] - 2 * (x[mine] @ y[lo:hi].T)
                a, b = np.nonzero(d <= limit + 1e-3) if np.isfinite(limit) else (np.repeat(np.arange(len(mine)), hi - lo), np.tile(np.arange(hi - lo), len(mine)))
                found.append((mine[a], lo + b, d[a, b]))
            if not found:
                continue
            qs, es, d = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((d, qs))
            qs, es, d = qs[order], es[order], d[order]
            if not np.isfinite(limit):
                first = np.searchsorted(qs, qs)
                last = np.minimum(first + k, np.searchsorted(qs, qs, "right") - 1)
                keep = d <= d[last] + 1e-4
                qs, es = qs[keep], es[keep]
            exact = ((x[qs].astype(np.float64) - y[es]) ** 2).sum(1)
            keep = exact <= limit
            qs, es, exact = qs[keep], es[keep], exact[keep]
            one = np.unique(qs)
            for q, a, b in zip(one.tolist(), np.searchsorted(qs, one, "left").tolist(), np.searchsorted(qs, one, "right").tolist()):
                hits = [(dist, int(p)) for dist, e in zip(exact[a:b].tolist(), es[a:b].tolist()) for p in positions[e]]
                if len(hits) > k + 1:
                    hits = heapq.nsmallest(k + 1, hits)
                out.append((h1[q], h2[q], [{"d": dist, "p": p} for dist, p in hits]))
        return pd.DataFrame(out, columns=["h1", "h2", "hits"])

    hits = probes.groupBy("c1", "part", "way").cogroup(base.groupBy("c1", "part", "way")).applyInPandas(compare, "h1 long, h2 long, hits array<struct<d double, p long>>")
    # At most (visited lists and parts) * (k + 1) hits a query: bounded, so they may be gathered.
    best = hits.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k + 1).alias("hits"))
    mine = asked.select("h1", "h2", "vec_pos").join(best, ["h1", "h2"])
    others = mine.select("vec_pos", F.slice(F.filter("hits", lambda h: h["p"] != F.col("vec_pos")), 1, k).alias("hits"))
    return others.select("vec_pos", F.posexplode("hits").alias("i", "h")).select("vec_pos", F.col("h.p").alias("other"), F.col("h.d").alias("distance"), (F.col("i") + 1).alias("rank"))


def _window(by, order):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(*order)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def found_pairs(vectors: DataFrame) -> DataFrame:
    """Problem 2's cases: pairs of which one is among the other's ten nearest, at squared distance up to 0.2."""
    near = neighbours(vectors, 10, 0.2, recall=0.999)
    return near.select(F.least("vec_pos", "other").alias("vec_pos_a"), F.greatest("vec_pos", "other").alias("vec_pos_b")).distinct()


def query_neighbours(vectors: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest of every vector whose vec_pos is divisible by 50, against all vectors, whatever their distance."""
    return neighbours(vectors, k, queries="vec_pos % 50 = 0")
