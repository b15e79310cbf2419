"""Problem 7: pairs and groups of texts whose shingle sets are largely the same.

An exact set-similarity join. Every set's shingles are put into one order, rare ones first by a
frequency sketch over all sets; two sets at the threshold share a shingle among the first few of
each, so only those are indexed. The index lists lie sorted by set size and are skipped in blocks:
an entry's position tells the largest partner it can still reach, a range of sizes is cut out for
each entry, and a block none of whose entries reaches the partner is passed over. What is left
must pass a bitmap bound on the overlap. Verification goes through anchors that share a shingle,
one after the other: the overlaps of an anchor are derived from those of the anchor before it, by
the few shingles in which the two differ.

Texts with the same words are one class and enter the join once, however many copies there are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import membership, shingles as sh
from .components import components
from .runtime import partitions, with_words, written

#: Words in a shingle and least Jaccard similarity of the given case; the general setting is five and 0.8.
WIDTH, SIMILARITY, LEAST_WORDS = 3, "0.6", 8
#: Copies up to which pairs of chunk ids are written out in full (larger groups: with their representative).
EXPAND_COPIES = 256
#: Entries of one index list that one task compares; longer lists are cut into pairs of parts.
LIST_PART = 4096
#: Candidates under one shingle that one task verifies; more are spread over tasks by their first class.
PAIRS_PART = 100_000
#: Tasks whose sketches one task adds up; more are added up in rounds.
FAN = 64
_SLICE, _PAIRS, _BLOCK = 2000, 1 << 21, 64
_POSTING = "token long, cls long, meta long, bits binary"
#: Bits of an entry's meta, from the lowest: fresh, side (2), salted, side of a later cut (2), position (28), size (29).
_SIDE, _SALTED, _LATER, _POS, _SIZE = 1, 3, 4, 6, 34


def class_texts(df: DataFrame, text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(cls, words) of the distinct texts of at least so many words; null texts are left out."""
    return with_words(df.select(text), least_words, text).where(F.col("cls").isNotNull()).distinct()


def sketch(classes: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Frequency class of every bucket of shingles, counted over all sets; 4 MB whatever the corpus.

    A task sends its counts as classes, which are exact up to 7 and within a tenth beyond; they are
    added up by FAN tasks at a time, so that no task gathers more than FAN sketches' blocks."""
    blocks = (1 << sh.SKETCH_BITS) // sh.SKETCH_BLOCK

    def count(batches):
        total = np.zeros(1 << sh.SKETCH_BITS, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), _SLICE):
                total += np.bincount(sh.bucket(sh.shingle_sets(texts[i : i + _SLICE], width)[1]), minlength=len(total))
        parts = [zlib.compress(x.tobytes(), 1) for x in sh.frequency_class(total).reshape(blocks, -1)]
        task = np.full(blocks, TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(np.arange(blocks, dtype=np.int32)), pa.array(parts, pa.binary())], names=["task", "block", "counts"])

    def add(key, rows):
        total = sum((sh.class_least(np.frombuffer(zlib.decompress(x), np.uint16)) for x in rows["counts"]), np.zeros(sh.SKETCH_BLOCK, np.int64))
        return rows.head(1).assign(task=int(key[0]), counts=[zlib.compress(sh.frequency_class(total).tobytes(), 1)])

    schema = "task int, block int, counts binary"
    rows = classes.select("words").mapInArrow(count, schema)
    tasks = rows.rdd.getNumPartitions()
    while True:
        rows = rows.groupBy(F.floor(F.col("task") / FAN).cast("int").alias("group"), "block").applyInPandas(add, schema)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    out = np.zeros((blocks, sh.SKETCH_BLOCK), np.uint16)
    for r in rows.collect():  # one row a block
        out[r.block] = np.frombuffer(zlib.decompress(r.counts), np.uint16)
    return out.reshape(-1)


def postings(classes: DataFrame, freq: np.ndarray, width: int = WIDTH, similarity: str = SIMILARITY, fresh: bool = True, drop: np.ndarray | None = None) -> DataFrame:
    """Index entries of the sets' prefixes: shingle, class, (size, position, cut, side, fresh) packed, bitmap.

    freq gives the order of the shingles; any sketch gives a right one, also of other sets. drop
    marks the buckets whose shingles no second set has, which need no entry (default: none is
    dropped). Lists that the sketch surely expects to be longer than LIST_PART are cut into parts
    here; an entry goes to every pair of parts with its own. What the sketch can't tell from a
    bucket's usual load is cut by its true length in candidates(). A set of 2 ** 29 shingles raises.
    """
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast((freq, drop))
    t = sh.Threshold(similarity)

    def index(batches):
        freq, drop = shared.value
        # A list is cut only if it stands out of the sketch's noise, the usual load of a bucket.
        noise = 4 * float(sh.class_count(np.percentile(freq, 90)))
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for i in range(0, len(texts), _SLICE):
                part = texts[i : i + _SLICE]
                row, h = sh.shingle_sets(part, width)
                if not len(h):
                    continue
                size = np.bincount(row, minlength=len(part))
                if size.max() >> (63 - _SIZE):
                    raise OverflowError("a text has more shingles than an index entry can say")
                payload = pa.array(sh.bitmaps(row, h, len(part)), pa.binary())
                cls = freq[sh.bucket(h)]
                order = np.lexsort((h, cls, row))
                row, h, cls = row[order], h[order], cls[order]
                pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                take = pos < t.prefix(size)[row]
                if drop is not None:
                    take &= ~drop[sh.bucket(h)]
                row, h, cls, pos = row[take], h[take], cls[take], pos[take]
                parts = np.maximum(1, np.ceil(sh.class_count(cls) / max(LIST_PART, noise))).astype(np.int64)
                own = (ids[i : i + _SLICE][row].astype(np.uint64) % parts.astype(np.uint64)).astype(np.int64)
                again = np.repeat(np.arange(len(row)), parts)
                other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
                row, h, pos, parts, own = row[again], h[again], pos[again], parts[again], own[again]
                low, high = np.minimum(own, other), np.maximum(own, other)
                side = np.where(own == other, 0, np.where(own == low, 1, 2))
                with np.errstate(over="ignore"):
                    key = np.where(parts > 1, sh.mix(h + (low * parts + high + 1).astype(np.uint64)), h)
                meta = (size[row] << _SIZE) | (pos << _POS) | ((parts > 1).astype(np.int64) << _SALTED) | (side << _SIDE) | int(fresh)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ids[i : i + _SLICE][row]), pa.array(meta), payload.take(pa.array(row))],
                    names=["token", "cls", "meta", "bits"],
                )

    return classes.select("cls", "words").mapInArrow(index, _POSTING)


def _bit_levels(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Bytes of each bitmap, and by width the bitmaps of at least that width, folded down to it."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    width = np.diff(offsets)
    levels, last = {}, None
    w = sh.WIDEST // 8
    while w >= 16:
        level = np.zeros((len(width), w), np.uint8)
        if last is not None:
            level[:] = last[:, :w] ^ last[:, w:]
        own = np.nonzero(width == w)[0]
        if len(own):
            level[own] = data[offsets[own][:, None] + np.arange(w)]
        levels[w], last = level, level
        w //= 2
    return width, {w: x.view(np.uint64) for w, x in levels.items()}


def _pairs_of(token, cls, meta, bits, t: sh.Threshold, all_fresh: bool):
    """Candidate pairs within the lists of a sorted run of index entries."""
    size, pos, fresh = meta >> _SIZE, (meta >> _POS) & ((1 << (_SIZE - _POS)) - 1), (meta & 1).astype(bool)
    side, later = (meta >> _SIDE) & 3, (meta >> _LATER) & 3
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    group = np.cumsum(new) - 1
    order = np.lexsort((size, group))
    token, cls, size, pos, side, later, fresh = (x[order] for x in (token, cls, size, pos, side, later, fresh))
    # An entry's largest partner: what is left behind its position must hold the least overlap.
    reach = np.minimum((size - pos) * (t.num + t.den) // t.num - size, size * t.den // t.num)
    span = int(size.max()) + 2
    key = group * span + size
    low = np.searchsorted(key, group * span + np.minimum(t.least_partner(size), span - 1), "left")
    high = np.minimum(np.searchsorted(key, group * span + np.clip(reach, 0, span - 1), "right"), np.arange(len(key)))
    count = np.maximum(high - low, 0)
    if not count.any():
        return
    # Blocks of entries, each with the largest partner that any of its entries reaches.
    top = np.maximum.reduceat(reach, np.arange(0, len(reach), _BLOCK))
    width, levels = _bit_levels(bits.take(pa.array(order)))
    at = np.nonzero(count)[0]
    ends = np.cumsum(count[at])
    start = 0
    while start < len(at):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _PAIRS, "right")))
        j = at[start:stop]
        first, last = low[j] // _BLOCK, (high[j] - 1) // _BLOCK
        blocks = last - first + 1
        jb = np.repeat(j, blocks)
        b = np.arange(len(jb)) - np.repeat(np.cumsum(blocks) - blocks, blocks) + np.repeat(first, blocks)
        live = top[b] >= size[jb]
        jb, b = jb[live], b[live]
        lo, hi = np.maximum(b * _BLOCK, low[jb]), np.minimum((b + 1) * _BLOCK, high[jb])
        n = hi - lo
        right = np.repeat(jb, n)
        left = np.arange(len(right)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        ok = (reach[left] >= size[right]) & (cls[left] != cls[right])
        for s in (side, later):  # parts of a list: pairs within the part, or between the two
            ok &= (s[left] != s[right]) | (s[left] == 0)
        if not all_fresh:
            ok &= fresh[left] | fresh[right]
        left, right = left[ok], right[ok]
        w = np.minimum(width[left], width[right])
        bound = size[left] + size[right] - 2 * t.overlap(size[left], size[right])
        passed = np.zeros(len(left), bool)
        for x in np.unique(w):
            of = np.nonzero(w == x)[0]
            differ = np.bitwise_count(levels[x][left[of]] ^ levels[x][right[of]]).sum(1, dtype=np.int64)
            passed[of] = differ <= bound[of]
        left, right = left[passed], right[passed]
        a, b = np.minimum(cls[left], cls[right]), np.maximum(cls[left], cls[right])
        yield token[left], a, b
        start = stop


def _paired(entries: DataFrame, t: sh.Threshold, all_fresh: bool, cut: bool) -> DataFrame:
    """(uncut, a, b, token, meta, bits): candidate pairs of the lists (uncut = 0), and, if cut, the
    entries themselves (uncut = 1; class in a) of lists longer than two parts, which are passed on as they come."""
    names = ["uncut", "a", "b", "token", "meta", "bits"]

    def pairs(batches):
        held: list[pa.RecordBatch] = []
        rows, passing = 0, None

        def passed_on(part: pa.Table):
            if len(part):
                n, none = len(part), pa.nulls(len(part), pa.int64())
                yield from pa.table([pa.array(np.ones(n, np.int32)), part["cls"], none, part["token"], part["meta"], part["bits"]], names=names).to_batches()

        def run(last: bool):
            nonlocal held, rows, passing
            whole = pa.Table.from_batches(held).combine_chunks()
            token = whole["token"].to_numpy()
            end = len(token) if last else int(np.searchsorted(token, token[-1], "left"))
            if cut and not last and len(token) - end > 2 * LIST_PART:
                passing, end = token[-1], len(token)
            part, rest = whole.slice(0, end), whole.slice(end)
            held, rows = (rest.to_batches() if len(rest) else []), len(rest)
            if not end:
                return
            token = token[:end]
            if cut:
                first = np.nonzero(np.concatenate([[True], token[1:] != token[:-1]]))[0]
                n = np.diff(np.append(first, end))
                long = np.repeat((n > 2 * LIST_PART) | (token[first] == passing if passing is not None else False), n)
                if long.any():
                    yield from passed_on(part.filter(pa.array(long)))
                    part = part.filter(pa.array(~long)).combine_chunks()
            if len(part) > 1:
                bits = part["bits"].combine_chunks()
                bits = bits.chunk(0) if isinstance(bits, pa.ChunkedArray) else bits
                out = list(_pairs_of(part["token"].to_numpy(), part["cls"].to_numpy(), part["meta"].to_numpy(), bits, t, all_fresh))
                if out:
                    k, a, b = (np.concatenate(x) for x in zip(*out))
                    order = np.lexsort((k, b, a))
                    k, a, b = k[order], a[order], b[order]
                    one = np.ones(len(a), bool)
                    one[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                    n = int(one.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(a[one]), pa.array(b[one]), pa.array(k[one]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)

        limit = 200_000
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= limit:
                yield from run(False)
                limit = max(200_000, 2 * rows)
        if held:
            yield from run(True)

    return entries.mapInArrow(pairs, "uncut int, a long, b long, token long, meta long, bits binary")


def candidates(entries: DataFrame, similarity: str = SIMILARITY, all_fresh: bool = True) -> DataFrame:
    """(a, b, token): pairs of classes that may reach the threshold, once each, with a shingle they share.

    A list of more than two parts is not compared where it is met: its entries are written, counted,
    and compared in pairs of parts, each in a task of its own. all_fresh=False gives only pairs of
    which at least one side is fresh."""
    t = sh.Threshold(similarity)
    tasks = partitions(entries.sparkSession)
    met = entries.select("token", "cls", "meta", "bits").repartition(tasks, "token").sortWithinPartitions("token")
    met = written(_paired(met, t, all_fresh, True), "pairs", "uncut")
    found, long = met.where("uncut = 0").select("a", "b", "token"), met.where("uncut = 1")
    if not long.isEmpty():
        parts = long.groupBy("token").agg(F.ceil(F.count("*") / LIST_PART).cast("int").alias("parts"))
        own = F.pmod("a", F.col("parts").cast("long")).cast("int")
        each = long.join(parts, "token").select("token", "a", "meta", "bits", "parts", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        each = each.select(F.xxhash64("token", low, high).alias("token"), F.col("a").alias("cls"), F.col("meta").bitwiseOR(F.shiftleft(side.cast("long"), _LATER)).alias("meta"), "bits")
        met = _paired(each.repartition(tasks, "token").sortWithinPartitions("token"), t, all_fresh, False)
        found = found.unionByName(met.select("a", "b", "token"))
    return found.groupBy("a", "b").agg(F.min("token").alias("token"))


def verified(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, similarity: str = SIMILARITY) -> DataFrame:
    """(a, b, common, size_a, size_b) of the pairs that reach the threshold, counted on the texts (cls, words)."""
    t = sh.Threshold(similarity)
    pairs = written(pairs, "candidates")
    crowded = pairs.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > PAIRS_PART)
    way = F.pmod("a", F.coalesce(F.ceil(F.col("n") / PAIRS_PART), F.lit(1)).cast("long")).cast("int")
    pairs = pairs.join(crowded, "token", "left").select("a", "b", "token", way.alias("way"))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    # Texts of no candidate stay where they are; the join below is exact whatever the map lets pass.
    texts = membership.split(texts.select("cls", "words"), membership.of(needed))
    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("words").alias("words_a")), "a").join(
        texts.select(F.col("cls").alias("b"), F.col("words").alias("words_b")), "b"
    )
    rows = both.select("token", "a", "words_a", "b", "words_b", "way").repartition(partitions(pairs.sparkSession), "token", "way").sortWithinPartitions("token", "a", "b")

    def check(batches):
        known: dict[int, frozenset] = {}

        def set_of(cls: int, words: str) -> frozenset:
            s = known.get(cls)
            if s is None:
                if len(known) > 4096:
                    known.clear()
                s = known[cls] = frozenset(sh.shingle_sets([words], width)[1].tolist())
            return s

        anchor, anchor_set, answers = None, frozenset(), {}
        before, plus, minus = {}, frozenset(), frozenset()
        for batch in batches:
            out = []
            a, wa, b, wb = (c.to_pylist() for c in batch.columns[1:5])
            for i in range(len(a)):
                if a[i] != anchor:
                    own = set_of(a[i], wa[i])
                    plus, minus = own - anchor_set, anchor_set - own
                    # Derive from the last anchor's answers where the two sets differ little.
                    before = answers if 2 * (len(plus) + len(minus)) < len(own) else {}
                    anchor, anchor_set, answers = a[i], own, {}
                other = set_of(b[i], wb[i])
                known_common = before.get(b[i])
                common = len(anchor_set & other) if known_common is None else known_common + len(plus & other) - len(minus & other)
                answers[b[i]] = common
                if t.reached(common, len(anchor_set), len(other)):
                    out.append((a[i], b[i], common, len(anchor_set), len(other)))
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["a", "b", "common", "size_a", "size_b"])

    return rows.mapInArrow(check, "a long, b long, common int, size_a int, size_b int")


def class_links(texts: DataFrame, width: int = WIDTH, similarity: str = SIMILARITY) -> DataFrame:
    """Links between the classes of a written table (cls, words): every pair that reaches the threshold."""
    freq = sketch(texts, width)
    entries = postings(texts, freq, width, similarity, drop=sh.alone(freq))
    return verified(candidates(entries, similarity), texts, width, similarity)


def entries_still_needed(entries: DataFrame, drop: np.ndarray) -> DataFrame:
    """Stored entries without those of shingles that no second set has."""
    salted = F.shiftright("meta", _SALTED).bitwiseAND(1) == 1
    return entries.where(salted | ~membership.holds(entries, drop, "token"))


def members_of(chunks: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(chunk_id, cls) of chunks whose text has enough words, repeated rows once."""
    rows = chunks.where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull()).select("chunk_id", "text")
    return with_words(rows, least_words).where(F.col("cls").isNotNull()).select("chunk_id", "cls").distinct()


def chunk_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of chunk ids out of linked classes and of copies.

    Members of classes of up to EXPAND_COPIES are written out in full. A class of more copies is
    written as its smallest chunk_id with each other member, and joined to another class through
    the representatives, so that no group of copies is multiplied out."""
    size = members.groupBy("cls").agg(F.count("*").alias("n"), F.min("chunk_id").alias("head"))
    linked = links.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    big = F.col("n") > EXPAND_COPIES
    many = members.join(size.where("n > 1"), "cls")
    twin = many.where(~big)
    copies = twin.select("cls", F.col("chunk_id").alias("x")).join(twin.select("cls", F.col("chunk_id").alias("y")), "cls").where("x < y").select("x", "y")
    stars = many.where(big & (F.col("head") < F.col("chunk_id"))).select(F.col("head").alias("x"), F.col("chunk_id").alias("y"))
    near = members.join(linked, "cls", "left_semi").join(size, "cls")
    few = near.where(~big | (F.col("chunk_id") == F.col("head")))
    side = lambda df, key, name: df.select(F.col("cls").alias(key), F.col("chunk_id").alias(name))
    full = links.select("a", "b").join(side(few, "a", "x"), "a").join(side(few, "b", "y"), "b").select("x", "y")
    rest, heads = near.where(big & (F.col("chunk_id") != F.col("head"))), few.where(F.col("chunk_id") == F.col("head"))
    left = links.select("a", "b").join(side(rest, "a", "x"), "a").join(side(heads, "b", "y"), "b").select("x", "y")
    right = links.select("a", "b").join(side(heads, "a", "x"), "a").join(side(rest, "b", "y"), "b").select("x", "y")
    every = copies.unionByName(stars).unionByName(full).unionByName(left).unionByName(right).where("x <> y")
    return every.select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b")).distinct()


def groups(chunks: DataFrame, width: int = 5, similarity: str = "0.8", least_words: int = 5) -> DataFrame:
    """One row per chunk with a text of enough words: chunk_id, class_id, group_id, links of its class, copies.

    class_id is the MD5 of the text's words between single spaces. Groups are the connected
    components of the links between classes; group_id is the smallest class_id of the component. A
    chunk_id delivered with different texts has a row for each class.
    """
    texts = written(class_texts(chunks, least_words=least_words), "group-texts")
    links = written(class_links(texts, width, similarity), "group-links")
    members = written(members_of(chunks, least_words), "group-members")
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    copies = members.groupBy("cls").agg(F.count("*").alias("copies"))
    named = texts.select("cls", F.md5(F.col("words").cast("binary")).alias("class_id"))
    roots = components(links.select("a", "b"))
    heads = roots.join(named, F.col("node") == F.col("cls")).groupBy("root").agg(F.min("class_id").alias("group_id"))
    classes = (
        named.join(copies, "cls").join(degree, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left").join(heads, "root", "left")
        .select("cls", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
    )
    return members.join(classes, "cls").select("chunk_id", "class_id", "group_id", "links", "copies")


def memberships(chunks: DataFrame) -> DataFrame:
    """Problem 7's classes, links and groups, at its own width and threshold, whatever the copies: see groups().

    With class_pairs() it says the same as found_pairs() without multiplying copies out."""
    return groups(chunks, WIDTH, SIMILARITY, LEAST_WORDS)


def class_pairs(chunks: DataFrame) -> DataFrame:
    """(class_id_a, class_id_b, common, shingles): the links between classes of different words at problem 7's threshold, a < b."""
    texts = written(class_texts(chunks), "near-texts")
    side = lambda x: texts.select(F.col("cls").alias(x), F.md5(F.col("words").cast("binary")).alias(f"class_{x}"))
    links = class_links(texts).join(side("a"), "a").join(side("b"), "b")
    return links.select(F.least("class_a", "class_b").alias("class_id_a"), F.greatest("class_a", "class_b").alias("class_id_b"), "common", (F.col("size_a") + F.col("size_b") - F.col("common")).alias("shingles"))


def found_pairs(chunks: DataFrame) -> DataFrame:
    """Problem 7's cases: pairs of chunk ids whose three-word shingle sets reach a Jaccard of 0.6."""
    texts = written(class_texts(chunks), "near-texts")
    links = written(class_links(texts), "near-links")
    return chunk_pairs(written(members_of(chunks), "near-members"), links)
