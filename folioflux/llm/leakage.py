"""Problem 9: corpus documents that hold passages of evaluation items.

Windows of words are embedded by a random walk (after Chakraborty, Goldenberg and Koucky): at
step t the embedding shows the word under the pointer, and the pointer moves on if a random bit
that depends on t and the word says so. Equal windows have equal embeddings, and windows a few
edits apart fall into step again soon, so few of their positions differ. Sampling some positions
gives the key of one table; several tables with other walks reach the recall that is asked for.
What shares a key is verified on the words themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import membership
from .runtime import norm_words, spread, written
from .shingles import _MIX, mix, word_array

#: A leak is a shared run of so many words.
RUN = 12
#: Sampled positions of an embedding in one key.
SAMPLED = 4
#: Tables whose keys are samples of one walk, which costs more than a sample.
WALK_TABLES = 5
#: Words of all items up to which their keys are broadcast (16 MB at most); beyond, keys are joined by shuffle.
BROADCAST_WORDS = 1 << 20
#: Bits (as a power of two) of the map of the items' keys by which a join's windows are sifted: 8 MB.
MARKS = 26


def sampled_steps(window: int, table: int, sampled: int = SAMPLED) -> list[int]:
    """Steps of the walk that the key of a table samples, spread over the window and drawn per table."""
    rng = np.random.default_rng(1000 + table)
    reach = 2 * window - 2  # the pointer of a walk has passed the window by then, or nearly
    cuts = np.linspace(0, reach, sampled + 1)
    return sorted({int(rng.integers(int(a), max(int(a) + 1, int(b)))) for a, b in zip(cuts, cuts[1:])})


def walk_keys(words: np.ndarray, window: int, tables: int, sampled: int = SAMPLED):
    """(table, key of every window by its first word) of all tables; WALK_TABLES of them sample one walk."""
    n = len(words) - window + 1
    if n <= 0:
        return
    first = np.arange(n)
    end = first + window
    words = np.append(words, np.zeros(1, np.uint64))  # where a pointer stands that has left the last window
    moved = np.empty(n, np.uint8)
    with np.errstate(over="ignore"):
        for walk in range(0, tables, WALK_TABLES):
            steps = {k: sampled_steps(window, k, sampled) for k in range(walk, min(tables, walk + WALK_TABLES))}
            keys, at = {k: np.zeros(n, np.uint64) for k in steps}, first.copy()
            for t in range(max(s[-1] for s in steps.values()) + 1):
                if t % 64 == 0:  # 64 random bits a word at a time
                    bits = mix(words + _MIX * np.uint64(977 * (walk + 1) + t // 64))
                due = [k for k, s in steps.items() if t in s]
                if due:
                    shown = np.where(at < end, words[at], np.uint64(0)) + np.uint64(t + 1)
                for k in due:
                    keys[k] = mix(keys[k] * _MIX + shown)
                np.take(((bits >> np.uint64(t % 64)) & np.uint64(1)).astype(np.uint8), at, out=moved, mode="clip")
                at += moved
                np.minimum(at, end, out=at)
            yield from keys.items()


def tables_for(window: int, edits: int, recall: float, sampled: int = SAMPLED) -> int:
    """Tables needed for a recall. Without edits one is enough: equal windows share every key."""
    if not edits:
        return 1
    # An edit costs the walk about as many steps as it takes to fall into step again (about 8 of
    # 2 * window on average); a key survives if none of its samples lies there.
    clean = max(0.02, 1 - 8 * edits / (2 * window)) ** sampled
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - clean)))
    # Samples of one walk fail together where the walk does: a walk's worth in reserve.
    return tables if tables <= 1 else (-(-tables // WALK_TABLES) + 1) * WALK_TABLES


def edit_distance(a, b, most: int) -> int:
    """Edit distance of two word sequences, most + 1 where it is larger; a band of that width."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    row = list(range(m + 1))
    for i in range(1, n + 1):
        lo, hi = max(1, i - most), min(m, i + most)
        new = [most + 1] * (m + 1)
        if lo == 1:
            new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (a[i - 1] != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        if min(new) > most:
            return most + 1
        row = new
    return min(row[m], most + 1)


class ItemIndex:
    """The windows of all items by key, one table for each walk."""

    def __init__(self, ids: list[int], texts: list[str], window: int, edits: int, tables: int):
        self.ids, self.window, self.edits = ids, window, edits
        self.words, sizes = word_array(texts)
        self.row = np.repeat(np.arange(len(ids)), sizes)
        n = max(0, len(self.words) - window + 1)
        whole = np.nonzero(self.row[:n] == self.row[window - 1 :][:n])[0] if n else np.zeros(0, np.int64)
        self.tables = []
        for _, keys in walk_keys(self.words, window, tables):
            keys = keys[whole]
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables.append((keys[order], whole[order], seen))

    def matches(self, texts: list[str]):
        """(row of texts, item id, edits) of windows verified on the words; equal pairs once, with the least edits."""
        words, sizes = word_array(texts)
        row = np.repeat(np.arange(len(sizes)), sizes)
        n = len(words) - self.window + 1
        best: dict[tuple[int, int], int] = {}
        if n <= 0:
            return best
        whole = row[:n] == row[self.window - 1 :]
        met = []
        for (keys, places, seen), (_, own) in zip(self.tables, walk_keys(words, self.window, len(self.tables))):
            at = np.nonzero(whole & seen[(own & np.uint64((1 << 20) - 1)).astype(np.int64)])[0]
            lo, hi = np.searchsorted(keys, own[at], "left"), np.searchsorted(keys, own[at], "right")
            count = hi - lo
            q = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            met.append(np.repeat(at, count) * len(self.words) + places[q])
        if not met:  # no item has a window
            return best
        met = np.unique(np.concatenate(met))  # what several tables bring together is verified once
        p, q = np.divmod(met, max(1, len(self.words)))
        for i in range(0, len(met), 50_000):
            d = edit_distances(words, p[i : i + 50_000], self.words, q[i : i + 50_000], self.window, self.edits)
            ok = d <= self.edits
            for pair, e in zip(zip(row[p[i : i + 50_000][ok]].tolist(), self.row[q[i : i + 50_000][ok]].tolist()), d[ok].tolist()):
                if e < best.get(pair, self.edits + 1):
                    best[pair] = e
        return best


def edit_distances(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, window: int, most: int) -> np.ndarray:
    """edit_distance() of the windows of a at p and of b at q, all pairs at once."""
    if not most:
        equal = np.ones(len(p), bool)
        for k in range(window):
            equal &= a[p + k] == b[q + k]
        return np.where(equal, 0, 1)
    far = most + 1
    row = [np.full(len(p), o if o >= 0 else far, np.int16) for o in range(-most, most + 1)]  # by the difference of the places
    for i in range(1, window + 1):
        mine, new = a[p + i - 1], []
        for o in range(-most, most + 1):
            j = i + o
            if j < 0 or j > window:
                new.append(np.full(len(p), far, np.int16))
                continue
            best = np.full(len(p), min(i, far), np.int16) if j == 0 else row[o + most] + (mine != b[q + j - 1])
            if o < most:
                best = np.minimum(best, row[o + most + 1] + 1)
            if o > -most and j > 0:
                best = np.minimum(best, new[-1] + 1)
            new.append(np.minimum(best, far).astype(np.int16))
        row = new
    return row[most]


def _plain(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), norm_words(F.col(text)).alias("words"))


def leaks(documents: DataFrame, items: DataFrame, window: int = RUN, edits: int = 0, recall: float = 0.95) -> DataFrame:
    """(doc_id, item_id, edits): documents and items that share a window of words up to so many edits.

    With edits=0 the result is exact: a shared run of at least `window` words. With edits it has
    the given recall and no false case. Null texts and texts of fewer words hold nothing; repeated
    items and rows give a pair once. A small set of items is broadcast after its size is checked;
    a larger one is joined by key.
    """
    tables = tables_for(window, edits, recall)
    plain = _plain(items, "item_id", "text").distinct()
    total = plain.agg(F.sum(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1)).first()[0] or 0
    docs = spread(_plain(documents, "doc_id", "text"))
    if total * tables <= BROADCAST_WORDS:
        rows = plain.collect()  # bounded by the check above
        shared = documents.sparkSession.sparkContext.broadcast(([r.id for r in rows], [r.words for r in rows]))

        def find(batches):
            index = ItemIndex(*shared.value, window, edits, tables)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out = []
                for i in range(0, len(texts), 2000):
                    out += [(ids[i + d], index.ids[q], e) for (d, q), e in index.matches(texts[i : i + 2000]).items()]
                cols = list(zip(*out)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["doc_id", "item_id", "edits"])

        hits = docs.mapInArrow(find, "doc_id long, item_id long, edits int")
    else:
        hits = _joined(docs, plain, window, edits, tables)
    return hits.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def _windows(df: DataFrame, window: int, tables: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for i in range(0, len(texts), 2000):
                part = texts[i : i + 2000]
                words, sizes = word_array(part)
                row = np.repeat(np.arange(len(sizes)), sizes)
                n = len(words) - window + 1
                if n <= 0:
                    continue
                whole = np.nonzero(row[:n] == row[window - 1 :])[0]
                for k, keys in walk_keys(words, window, tables):
                    keys = mix(keys[whole] + np.uint64(k))
                    runs = [words[p : p + window].tobytes() for p in whole.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 2000][row[whole]]), pa.array(keys.view(np.int64)), pa.array(runs, pa.binary())], names=["id", "key", "run"])

    return df.mapInArrow(cut, "id long, key long, run binary")


def _joined(docs: DataFrame, items: DataFrame, window: int, edits: int, tables: int) -> DataFrame:
    """The same by a join on keys, for items too many to broadcast; equal windows of a document once."""
    theirs = written(_windows(items, window, tables).distinct().withColumnsRenamed({"id": "item_id", "run": "item_run"}), "item-windows")
    # Windows whose key no item has stay where they are cut.
    mine = membership.split(_windows(docs, window, tables), membership.of(theirs.select("key"), MARKS), "key").distinct()
    pairs = mine.withColumnRenamed("id", "doc_id").join(theirs, "key")

    def check(batches):
        for batch in batches:
            d, r, i, s = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "run", "item_id", "item_run"))
            out = []
            for k in range(len(d)):
                e = 0 if r[k] == s[k] else edits + 1 if not edits else edit_distance(np.frombuffer(r[k], np.uint64).tolist(), np.frombuffer(s[k], np.uint64).tolist(), edits)
                if e <= edits:
                    out.append((d[k], i[k], e))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["doc_id", "item_id", "edits"])

    return pairs.mapInArrow(check, "doc_id long, item_id long, edits int")
