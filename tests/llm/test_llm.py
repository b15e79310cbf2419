import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflux.llm import bpe, components, email_new_text, gbt, incremental, leakage, longest_match, near_duplicates, privacy, shingles, spam_pages, splitting, token_budget, vector_neighbors

CHUNK = "chunk_id string, doc_id string, text string, token_count int, meta_json string, batch_id int, ws_tokens string"


def test_longest_match_is_the_naive_one():
    rng = random.Random(1)
    pieces = {tuple(rng.choices(range(3), k=rng.randint(1, 5))) for _ in range(25)} | {(0,), (1,)}
    m = longest_match.LongestMatch(pieces)
    for _ in range(3000):
        word = tuple(rng.choices(range(3), k=rng.randint(1, 14)))
        assert m.count(word) == len(m.naive(word)), word


def test_token_budget(spark):
    meta = '{"source_filepath": "f", "source": "s", "lang": "EN-us", "domain": " Sales"}'
    rows = [("a", "d", "one two", 2, meta, 0, "x"), ("a", "d", "one two", 2, meta, 0, "x"), ("a", "d", "one two", 2, meta[:60], 1, None), ("b", "d", " \x1c ", 1, None, 0, None), ("c", None, None, None, "{", 0, None), ("e", None, "x", None, '{"lang": "iw"}', 0, None), (None, None, "q", 5, None, 0, None)]
    df = spark.createDataFrame(rows, CHUNK)
    assert sorted(str(r.chunk_id) for r in token_budget.wrong_counts(df).collect()) == ["None", "b", "e"]
    total = {(r.source_filepath, r.source, r.lang, r.domain): (r.chunks, r.ws_tokens) for r in token_budget.totals(df).collect()}
    assert total[(None, None, None, None)] == (5, 4) and total[(None, None, "en", None)] == (1, 2) and total[(None, None, "he", None)] == (1, 1) and total[("f", None, None, None)] == (1, 2)
    assert token_budget.wrong_counts(df.limit(0)).count() == 0
    got = token_budget.with_counts(df.where("chunk_id = 'b'")).first()
    assert got.ws_tokens == 0 and got.subword_tokens == 0


def test_bpe_equals_the_library(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(2)
    parts = [*string.ascii_lowercase, " ", "\n", "the", "ing", "<|endoftext|>", "\x1c", "é", "ש", "😀", "'s", "  ", "12", "=", chr(0xA0), "----"]
    texts = ["", "a" * 5000, " " * 300, *("".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(400))]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)] + [(-1, None, "n")], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in bpe.encoded(df).collect()}
    assert got[-1] == [] and all(got[i] == t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts))
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(df)).collect()}
    assert back[-1] == "" and all(back[i] == x for i, x in enumerate(texts))
    assert bpe.encoded(df.limit(0)).count() == 0


def words(rng, n, vocabulary=60):
    return [f"w{rng.randint(0, vocabulary)}" for _ in range(n)]


def edited(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [f"e{rng.randint(0, 9)}"], [w[k], f"i{rng.randint(0, 9)}"]])
    return w


def near_data(seed, n=150):
    rng = random.Random(seed)
    base = [words(rng, rng.choice([6, 8, 20, 90, 400]), 40) for _ in range(n)]
    texts = base + [edited(rng, rng.choice(base), rng.randint(0, 9)) for _ in range(n)]
    rows = [(f"c{i}", " ".join(w).upper() if i % 5 == 0 else ", ".join(w)) for i, w in enumerate(texts)]
    return rows + rows[:5] + [("n", None), ("e", ""), (None, rows[0][1]), ("c1", rows[7][1])]


def brute_pairs(rows, width=3, num=3, den=5, least=8):
    sets = []
    for c, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if c is not None and len(w) >= least:
            sets.append((c, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}))
    return {(min(a, b), max(a, b)) for i, (a, s) in enumerate(sets) for b, u in sets[:i] if a != b and den * len(s & u) >= num * len(s | u)}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(near_duplicates, "LIST_PART", 8)  # long index lists in parts
    rows = near_data(seed)
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    assert {(r.chunk_id_a, r.chunk_id_b) for r in near_duplicates.found_pairs(df).collect()} == brute_pairs(rows)
    assert near_duplicates.found_pairs(df.limit(0)).count() == 0


def test_many_copies_stay_small(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "EXPAND_COPIES", 3)
    text = "a b c d e f g h i j k l m n o p"
    rows = [(f"x{i:02}", text) for i in range(20)] + [("y", text + " q")]
    got = near_duplicates.found_pairs(spark.createDataFrame(rows, "chunk_id string, text string")).collect()
    assert len(got) == 19 + 20 and {x for r in got for x in r} == {c for c, _ in rows}
    groups = near_duplicates.groups(spark.createDataFrame(rows, "chunk_id string, text string")).collect()
    assert len(groups) == 21 and len({r.group_id for r in groups}) == 1 and {r.copies for r in groups} == {20, 1}


def test_history_equals_brute_force(spark):
    rows = near_data(3, 80)
    rng = random.Random(4)
    rows = [(c, t, rng.choice([0, 0, 1, 2, 3])) for c, t in rows]
    df = spark.createDataFrame(rows, "chunk_id string, text string, batch_id int")
    pairs = brute_pairs([r[:2] for r in rows])
    batches = {}
    for c, _, b in rows:
        batches.setdefault(c, set()).add(b)
    linked = {}
    for a, b in pairs:
        linked.setdefault(a, set()).add(b)
        linked.setdefault(b, set()).add(a)
    # a chunk_id may come with several texts: the text of the row decides
    want = set()
    sets = {}
    for c, t, b in rows:
        for c2, t2, b2 in rows:
            if c is not None and c2 is not None and b2 < b and (c == c2 or brute_pairs([(c, t), (c2, t2)])):
                want.add((b, c))
    assert {(r.batch_id, r.chunk_id) for r in incremental.found_rows(df).collect()} == want
    h = incremental.History(spark)
    late = set()
    for b in range(4):
        h.admit(df.where(F.col("batch_id") == b))
        late |= {(r.batch_id, r.chunk_id) for r in h.repetitions().collect()}
    assert late == want and not sets
    assert incremental.scored_links(df.withColumn("doc_id", F.lit("d"))).count() > 0


def test_clusters_over_deliveries(spark):
    rng = random.Random(11)
    rows = [(c, t, rng.choice([0, 0, 0, 1, 2])) for c, t in near_data(5, 60)]
    base = [f"k{i}" for i in range(30)]
    # a and b are linked within the first load; c to a only, d to b only
    rows += [("a", " ".join(base), 0), ("b", " ".join(base[5:] + ["v1"]), 0), ("c", " ".join(["u1", "u2", "u3", "u4"] + base[:-4]), 1), ("d", " ".join(base[9:] + ["v1", "v2", "v3"]), 2)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, batch_id int")
    key = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    texts = sorted({key(t) for _, t, _ in rows if len(key(t).split()) >= 8})
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = brute_pairs([(t, t) for t in texts])
    for x, y in pairs:
        root[find(x)] = find(y)
    want = {}
    for c, t, b in rows:
        if c is not None and key(t) in root:
            want.setdefault(find(key(t)), set()).add((b, c))
    h = incremental.History(spark)
    for b in range(3):
        h.admit(df.where(F.col("batch_id") == b))
    cls = {r.words: r.cls for r in h.texts.collect()}
    to = {r.node: r.root for r in h.clusters().collect()}
    assert {(x, y) for x in texts for y in texts if find(x) == find(y)} == {(x, y) for x in texts for y in texts if to.get(cls[x], cls[x]) == to.get(cls[y], cls[y])}
    got = {}
    for r in incremental.clustered_rows(df).collect():
        got.setdefault(r.cluster, set()).add((r.batch_id, r.chunk_id))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert len({k for k, v in got.items() if v & {(0, "a"), (0, "b"), (1, "c"), (2, "d")}}) == 1


def test_links_are_those_of_the_found_rows(spark):
    rng = random.Random(12)
    rows = [(c, rng.choice(["f", "g", None]), t, rng.choice([0, 0, 1, 2])) for c, t in near_data(6, 50)]
    text = " ".join(f"q{i}" for i in range(20))
    rows += [("A", "f", text, 0), ("B", "g", text, 1), ("A", "g", text, 2), ("C", "g", text.upper(), 2), ("S", "f", "short", 0), ("S", "f", None, 1), ("S", "f", "shorter", 2)]
    rows += [(f"m{i}", "h", text, 0) for i in range(8)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, batch_id int")
    want = {(r.batch_id, r.chunk_id) for r in incremental.found_rows(df).collect()}
    got = incremental.scored_links(df).collect()
    assert {(r.batch_id, r.chunk_id) for r in got} == want >= {(2, "A"), (2, "S"), (1, "S")} and len(got) == len(want)
    assert all(r.earlier_batch_id < r.batch_id for r in got) and all((r.jaccard is None) <= (r.earlier_chunk_id == r.chunk_id) for r in got)
    history = incremental.History(spark, clustered=False, within=True)
    for b in ("batch_id = 0", "batch_id > 0"):
        history.admit(df.where(b))
    key = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    sets = lambda t: {tuple(key(t)[i : i + 3]) for i in range(len(key(t)) - 2)} if len(key(t)) >= 8 else set()
    first = {}
    for c, d, t, b in rows:
        for c2, d2, t2, b2 in rows:
            if c is not None and c2 is not None and 0 < b > b2:
                s, u, n = sets(t), sets(t2), len(key(t))
                j = 10 * len(s & u) // len(s | u) if s and u else 0
                j = j if j >= 6 else -1
                if j >= 0 or c == c2:
                    k = (b, c, j, int(d is not None and d == d2), int(abs(len(key(t2)) - n) * 10 <= n), int(c == c2))
                    first[k] = min(first.get(k, (99, "")), (b2, c2))
    have = {}
    for r in incremental.earlier_pairs(history).collect():
        k = (r.batch_id, r.chunk_id, r.f0, r.f1, r.f2, r.f3)
        have[k] = min(have.get(k, (99, "")), (r.earlier_batch_id, r.earlier_chunk_id))
    assert have == first and first[2, "A", 10, 1, 1, 0] == (1, "B")


def test_history_goes_on_where_it_was(spark, tmp_path):
    rows = [(c, t, b) for b in range(3) for c, t in near_data(21 + b, 25)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, batch_id int")
    whole, path = incremental.History(spark), f"file://{tmp_path}/history"
    for b in range(3):
        whole.admit(df.where(F.col("batch_id") == b))
        incremental.History(spark, path).admit(df.where(F.col("batch_id") == b))  # opened anew each time
    again = incremental.History(spark, path)
    assert again.parts == 3 and again.clustered
    for name in ("repetitions", "clusters"):
        assert sorted(getattr(again, name)().collect()) == sorted(getattr(whole, name)().collect())
    assert sorted(again.links.collect()) == sorted(whole.links.collect()) and again.links.count() > 0


def test_long_lists_are_cut_by_their_length(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "LIST_PART", 4)
    monkeypatch.setattr(near_duplicates, "PAIRS_PART", 5)
    monkeypatch.setattr(near_duplicates, "FAN", 2)
    rng = random.Random(8)
    head = [f"h{i}" for i in range(40)]
    rows = [(f"k{i:03}", " ".join(edited(rng, head, rng.randint(0, 5)))) for i in range(120)]  # all lists are long
    rows += [(f"z{i}", " ".join(f"t{i}x{j}" for j in range(12))) for i in range(30)]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    want = brute_pairs(rows)
    assert {(r.chunk_id_a, r.chunk_id_b) for r in near_duplicates.found_pairs(df).collect()} == want and len(want) > 1000
    links = near_duplicates.class_pairs(df).collect()
    assert len(links) == len({(r.class_id_a, r.class_id_b) for r in links}) and all(5 * r.common >= 3 * r.shingles for r in links)


def test_sketch_classes_hold_any_count():
    from folioflux.llm import shingles as sh

    counts = np.array([0, 1, 2, 7, 2**31, 2**32, 2**33, 10**11, 2**60])
    cls = sh.frequency_class(counts)
    assert (np.diff(cls.astype(int)) > 0).all() and (sh.class_least(cls) <= counts).all() and (sh.class_count(cls) >= counts).all() and not sh.alone(cls[2:]).any()


def test_match_weights():
    w = incremental.match_weights([((9, 1), 50), ((6, 0), 50), ((9, 0), 5), ((6, 1), 5)])
    assert w[0][9] > 0 > w[0][6] and w[1][1] > w[1][0] and incremental.match_weights([]) == []


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in components.components(df).collect()} == {x: find(x) for x in list(root)}
    step = components.merged(components.components(df.limit(30)), df)
    assert {r.node: r.root for r in step.collect() if r.node in root} == {x: find(x) for x in list(root)}


def test_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 64))
    x = [(c + rng.normal(size=64) * 0.03) / np.linalg.norm(c) for c in centres for _ in range(9)] + list(rng.normal(size=(60, 64)) / 8)
    rows = [(i, [float(v) for v in e], "t") for i, e in enumerate(x)]
    rows += [(500 + i, rows[0][1], None) for i in range(15)] + rows[:3]
    rows += [(900, None, "t"), (901, [], "t"), (902, [1.0] * 63, "t"), (903, [0.0] * 64, "t"), (904, [float("nan")] * 64, "t")]
    df = spark.createDataFrame(rows, "vec_pos long, embedding array<float>, h1 string")
    use = {i: np.array(e, np.float32).astype(float) for i, e, _ in rows if e and len(e) == 64 and any(e) and not np.isnan(e).any()}
    want = set()
    for i, a in use.items():
        near = sorted((((a - b) ** 2).sum(), j) for j, b in use.items() if j != i)[:10]
        want |= {(min(i, j), max(i, j)) for d, j in near if d <= 0.2}
    got = {(r.vec_pos_a, r.vec_pos_b) for r in vector_neighbors.found_pairs(df).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    assert vector_neighbors.found_pairs(df.limit(0)).count() == 0
    hits = vector_neighbors.neighbours(df, 3, size=16).where("vec_pos < 50").groupBy("vec_pos").count().collect()
    assert len(hits) == 50 and {r["count"] for r in hits} == {3}


def test_traverse_is_in_order():
    rng = np.random.default_rng(7)
    d1, d2 = rng.random(9), rng.random(9)
    got = vector_neighbors.traverse(d1, d2, np.ones((9, 9), int), 81, 0)
    sums = [d1[i] + d2[j] for i, j in got]
    assert len(set(got)) == 81 and sums == sorted(sums)


def test_leaks(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, 40, 500))) for i in range(6)] + [(6, None), (7, "too short")]
    docs = []
    for i in range(60):
        w = words(rng, 80, 500)
        k, n = rng.randrange(6), rng.randint(8, 20)
        p = rng.randrange(40 - n + 1)
        docs.append((i, " ".join(w[:30] + items[k][1].split()[p : p + n] + w[30:]).title()))
    docs += [(100, None), (101, ""), docs[0]]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + items[:1], "item_id long, text string")
    grams = {i: {tuple(t.lower().split()[k : k + 12]) for k in range(len(t.split()) - 11)} for i, t in items if t}
    want = {(d, i) for d, t in docs if t for i, g in grams.items() if g & {tuple(t.lower().split()[k : k + 12]) for k in range(len(t.split()) - 11)}}
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(df, it).collect()} == want and want
    try:
        leakage.BROADCAST_WORDS, kept = 0, leakage.BROADCAST_WORDS
        assert {(r.doc_id, r.item_id) for r in leakage.leaks(df, it).collect()} == want
    finally:
        leakage.BROADCAST_WORDS = kept
    assert leakage.leaks(df, it.limit(0)).count() == 0 and leakage.leaks(df.limit(0), it).count() == 0


def test_leaks_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BROADCAST_WORDS", 0)
    rng = random.Random(17)
    item = words(rng, 40, 300)
    docs = spark.createDataFrame([(1, " ".join(words(rng, 30, 300) + item[5:30])), (2, " ".join(words(rng, 80, 300))), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()] == [(1, 7)]
    assert [(r.doc_id, r.item_id) for r in leakage.leaks(docs, items, window=24, edits=2).collect()] == [(1, 7)]
    assert leakage.leaks(docs, items.limit(0)).count() == 0


def test_exact_budget(spark):
    import tiktoken

    texts = ["The pump's  valve №7 – ok", "", " ", None, "שלום עולם\n\nx"]
    rows = [(f"c{i}", "d", t, "{}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:2], "chunk_id string, doc_id string, text string, meta_json string")
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(bpe.VOCABULARY))}
    peer = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    total = next(r for r in token_budget.totals(df).collect() if r.source_filepath is None and r.source is None and r.lang is None and r.domain is None)
    assert total.chunks == 5 and total.bpe_tokens == sum(len(peer.encode_ordinary(t or "")) for t in texts)


def test_recall_is_reached(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64)).astype(np.float32)  # no clusters at all: the hardest case
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_pos long, embedding array<float>")
    got = {}
    for r in vector_neighbors.query_neighbours(df).collect():
        got.setdefault(r.vec_pos, set()).add(r.other)
    assert sorted(got) == list(range(0, 1500, 50)) and all(len(v) == 10 for v in got.values())

    def true(i):
        d = ((x - x[i]).astype(float) ** 2).sum(1)
        return set(np.argsort(np.where(np.arange(len(x)) == i, np.inf, d))[:10].tolist())

    assert sum(len(true(i) & v) for i, v in got.items()) >= 0.9 * 10 * len(got)
    exact = vector_neighbors.neighbours(df, 10, recall=1.0, queries="vec_pos < 40").collect()
    assert all({r.other for r in exact if r.vec_pos == i} == true(i) for i in range(40))


def test_new_text_of_chunks(spark):
    assert email_new_text.aligned("b c d x d".split(), "a b c d".split()) == [1, 2, 3, -1, 3] and email_new_text.aligned([], ["a"]) == [] and email_new_text.aligned(["a"], []) == [-1]
    rng = random.Random(4)
    for _ in range(200):
        a, b = [rng.choice("xyz") for _ in range(rng.randint(0, 12))], [rng.choice("xyzw") for _ in range(rng.randint(0, 9))]
        at, i = email_new_text.aligned(b, a), 0
        while i < len(b):
            starts = [(max(n for n in range(len(b) - i + 1) if b[i : i + n] == a[p : p + n]), -p) for p in range(len(a))]
            n, p = max(starts, default=(0, 0))
            assert at[i : i + max(1, n)] == ([*range(-p, n - p)] if n else [-1])
            i += n or 1
    assert email_new_text.aligned(["a"] * 60_000, ["a"] * 50_000)[-1] == 9_999  # long repetitions stay linear
    mail = "Hello Tom,\n\nthe pump is ready for the test today.\n\nOn 1/2/2025 at 10:30, Tom wrote:\n> is the pump ready for\n> the test?\n\nRegards\nAnna Blum"
    meta = "struct<content_type:string,source_filepath:string>"
    seg = spark.createDataFrame([(1, mail, ("email", "in/a.eml")), (2, mail, ("email", "in/a.eml")), (3, "Other text here.", ("email", "in/a.eml")), (4, None, ("email", "in/b.eml"))], f"ord long, content string, meta {meta}")
    words = mail.split()
    rows = [("w", "in/a.eml", " ".join(words)), ("w", "in/a.eml", " ".join(words)), ("p", "in/a.eml", " ".join(words[5:20])), ("q", "in/a.eml", "> is the pump ready for > the test?"), ("b", "in/b.eml", "x"), ("n", "in/a.eml", None), ("o", "in/a.txt", "x"), (None, "in/a.eml", "x")]
    got = {r.chunk_id: r for r in email_new_text.new_chunk_text(seg, spark.createDataFrame(rows, "chunk_id string, doc_id string, text string")).collect()}
    assert sorted(got) == ["b", "p", "q", "w"] and got["w"].text == "Hello Tom, the pump is ready for the test today." and got["w"].found == 1
    assert got["p"].text == "ready for the test today." and got["q"].text == "" and got["b"].text is None and got["b"].found == 0


def test_frequent_wordings_in_parts(spark, monkeypatch):
    seg = spark.createDataFrame([(i, f"Hello {i}, the pump number {i} is ready.\n\nRegards\nAnna {i % 2}", ("email",)) for i in range(30)], "ord long, content string, meta struct<content_type:string>")
    plain = sorted(email_new_text.with_counts(email_new_text.block_rows(seg)).select("ord", "block_no", "f").collect())
    monkeypatch.setattr(email_new_text, "HEAVY", 4)
    assert sorted(email_new_text.with_counts(email_new_text.block_rows(seg)).select("ord", "block_no", "f").collect()) == plain


def test_leaks_with_edits(spark):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, 60, 5000))) for i in range(10)]
    docs = []
    for i in range(100):
        k = i % 10
        w = items[k][1].split()[10:34]
        w[rng.randint(3, 20)] = "zzz"
        docs.append((i, " ".join(words(rng, 30, 5000) + w + words(rng, 30, 5000))))
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=24, edits=2, recall=0.95).collect()
    assert sum(r.doc_id % 10 == r.item_id for r in got) >= 95 and all(r.edits <= 2 for r in got)
    assert leakage.edit_distance([1, 2, 3], [1, 3], 2) == 1 and leakage.edit_distance([1] * 5, [2] * 5, 2) == 3


def test_splitting(spark):
    long = ("One two three, four five. " * 40).strip()
    rules = spark.createDataFrame([("txt", "by_paragraph", 5, 30, 4), ("default", "split_on_rows", 1, 3, 5)], "doc_type string, strategy string, min_tokens int, max_tokens int, overlap int")
    rows = [(1, f"short\n\n{long}", ("txt",)), (1, f"short\n\n{long}", ("txt",)), (2, None, ("txt",)), (3, "", (None,)), (4, "a b c\nd\x1ce f　g h", ("odd",)), (5, "x" * 25000, ("txt",))]
    seg = spark.createDataFrame(rows, "ord long, content string, meta struct<doc_type:string>")
    assert sorted((r.ord, r.item_no) for r in splitting.found(seg, rules).collect()) == [(1, 1), (4, 1)]
    got = splitting.split_oversized(seg, rules).orderBy("ord", "item_no", "piece_no").collect()
    first = [r for r in got if r.ord == 1]
    seen = []
    for r in first:
        w = r.text.split()
        assert len(w) == r.tokens <= 30 and r.overlap == (4 if seen else 0) and (not r.overlap or w[:4] == seen[-4:])
        assert r.text.endswith(".")
        seen += w[r.overlap :]
    assert seen == long.split()
    assert [r.text.split() for r in got if r.ord == 4] == [["d", ], ["d", "e"], ["d", "e", "f"], ["e", "f", "g"], ["f", "g", "h"]] and splitting.found(seg.limit(0), rules).count() == 0


def test_splitting_cuts_long_tokens(spark):
    rng = random.Random(13)
    blob = "".join(rng.choices(string.ascii_letters + string.digits, k=25000))
    item = f"One two three, four five. {blob} six seven eight. " + "nine ten, eleven. " * 12 + "z" * 10001
    rules = spark.createDataFrame([("default", "by_paragraph", 5, 12, 3)], "doc_type string, strategy string, min_tokens int, max_tokens int, overlap int")
    seg = spark.createDataFrame([(1, item, ("txt",))], "ord long, content string, meta struct<doc_type:string>")
    runs = [t[i : i + 10000] for t in item.split() for i in range(0, len(t), 10000)]
    seen = []
    for r in splitting.split_oversized(seg, rules).orderBy("piece_no").collect():
        w = [t[i : i + 10000] for t in r.text.split() for i in range(0, len(t), 10000)] if len(r.text) < 10000 else None
        n = r.tokens
        assert 0 < n <= 12 and r.overlap == (3 if seen else 0)
        own = runs[len(seen) - r.overlap : len(seen) - r.overlap + n]
        assert "".join(r.text.split()) == "".join(own) and len(own) == n and (w is None or w == own)
        seen += own[r.overlap :]
    assert seen == runs and [r.item_no for r in splitting.found(seg, rules).collect()] == [0]


MAIL = """Hi Anna,

From: gate four to gate nine, nothing moves.
On the phone the auditor wrote: nothing yet.

> is it so?
Yes.

Regards to the team.

Kind regards
Bo Blum
--
Bo Blum
T: 020 7946 0209

Sent from my phone

On Mon, 23 Dec 2025 at 18:03, Anna A
<anna@x.test> wrote:
old text

more old"""


def test_mail_blocks(spark):
    new = {1, 3, 4, 7, 9}
    rows = [(1, MAIL, ("email",)), (1, MAIL, ("email",)), (2, MAIL.replace("\n", "\r\n"), ("email",)), (3, None, ("email",)), (4, "", ("email",)), (5, "> x", (None,))]
    seg = spark.createDataFrame(rows, "ord long, content string, meta struct<content_type:string>")
    got = {}
    for r in email_new_text.found(seg).collect():
        got.setdefault(r.ord, set()).add(r.line_no)
    filled = {i for i, x in enumerate(MAIL.split("\n"), 1) if x.strip()}
    assert got == {1: filled - new, 2: filled - new}
    text = {r.ord: r.text for r in email_new_text.new_text(seg).collect()}
    assert text[1].startswith("Hi Anna,") and "Yes." in text[1] and "old" not in text[1]
    assert email_new_text.found(seg.limit(0)).count() == 0


def test_mail_notes_and_short_lines(spark):
    """Disclaimers and device notes without a sign-off are old, short new lines are new; every feature has a say."""
    note = "This message is intended only for the person named above and is confidential, so please delete it if you received it by mistake today or tomorrow."
    rows = [(1, f"Hi,\n\nplease see the file.\n\n{note}", {5}), (2, f"Hi,\n\nplease see it.\n\n> is it so?\n\n{note}", {5, 7}), (3, "Hi Bo,\n\nI will come tomorrow.\n\nYes, go ahead", set()), (4, "Hi Bo,\n\nI will come.\n\n> ok?\n\nYes, go ahead\n\nSent from my phone", {5, 9})]
    seg = spark.createDataFrame([(i, c, ("email",)) for i, c, _ in rows], "ord long, content string, meta struct<content_type:string>")
    got = {(r.ord, r.line_no) for r in email_new_text.found(seg).collect()}
    assert got == {(i, n) for i, _, old in rows for n in old}
    used = {node[0] for t in gbt.load(str(email_new_text.MODEL))["trees"] for node in t if len(node) > 1}
    assert {email_new_text.FEATURES[k] for k in used} >= {"contacts", "sender", "common", "ancestor", "device", "disclaimer", "headers", "rule"}
    mails = [(f"{t}\n\nok then\n\nBest\nBo Blum\nbo@x.test", k) for k, t in enumerate(("One is here.", "Two is here.", "Three is here."))] + [("ok then\n\nFour is here.\n\nBest\nAl Stein\nal@x.test", 3)]
    seg = spark.createDataFrame([(i, c, ("email",)) for c, i in mails], "ord long, content string, meta struct<content_type:string>")
    f = {(r.ord, r.texts[0]): dict(zip(email_new_text.FEATURES, r.f)) for r in email_new_text.with_counts(email_new_text.block_rows(seg)).collect()}
    assert f[0, "ok then"]["common"] == 2 and f[0, "ok then"]["sender"] == pytest.approx(np.log2(3)) and f[3, "ok then"]["sender"] == 0
    assert f[0, "ok then"]["ancestor"] == 1 and f[3, "ok then"]["ancestor"] == 0


def test_mail_trees_on_held_out_mails(spark):
    """The trees fitted on one table give the cautious rules' labels on the mails of another."""
    seg = spark.read.parquet("/root/testdata/sf0.01/segments.parquet")
    rows = email_new_text.with_counts(email_new_text.block_rows(seg)).select("f").collect()
    x = np.array([r.f for r in rows])
    y = np.array([email_new_text.sure_label(f) for f in x])
    assert ((gbt.predict(gbt.load(str(email_new_text.MODEL)), x) > 0) == y).mean() > 0.99


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((gbt.predict(gbt.fit(x[:500], y[:500]), x[500:]) > 0) == y[500:]).mean() > 0.95


NAMES = privacy.Names([("Anna", "given"), ("Dale", "given"), ("Bo", "given"), ("Blum", "family"), ("Korte", "family"), ("Stein", "family")])


@pytest.mark.parametrize(
    "text,items",
    [
        ("Mr Anna van Blum, Korte, Bo and B. Stein; dale. BLUM ANNA", {("name", "Anna van Blum"), ("name", "Korte, Bo"), ("name", "B. Stein"), ("name", "BLUM ANNA")}),
        ("the dale and Blum", set()),
        ("x.y+z@a-b.test, q (at) hq dot foo dot test and b[at]c.invalid; fluxkit@6.6.33", {("email", "x.y+z@a-b.test"), ("email", "q (at) hq dot foo dot test"), ("email", "b[at]c.invalid")}),
        ("call +44 (0)1632 960 495 or 020 7946 0209 or 555-0127 ext. 431, order 35-9491-912, 2025-02-01 22:28", {("phone", "+44 (0)1632 960 495"), ("phone", "020 7946 0209"), ("phone", "555-0127 ext. 431")}),
        ("SSN 952 58 4063, tax number 99/184/87193, passport no. P88150355, serial SN 9264-16-940", {("id_number", "952 58 4063"), ("id_number", "99/184/87193"), ("id_number", "P88150355")}),
        ("to 69 Copper Dr Unit 12,\nKessocourt, ZZ 00251 and Mühlenstr. 123, 00380 Brind", {("address", "69 Copper Dr Unit 12, Kessocourt, ZZ 00251"), ("address", "Mühlenstr. 123, 00380 Brind")}),
        ("9 bis rue de l'Écluse, 00522 Haver; Avda. del Olmo Seco 26, 00460 Alten", {("address", "9 bis rue de l'Écluse, 00522 Haver"), ("address", "Avda. del Olmo Seco 26, 00460 Alten")}),
        ("anna.blum@x.test", {("email", "anna.blum@x.test")}),
        ("", set()),
    ],
)
def test_personal_information(text, items):
    assert privacy.items(text, NAMES) == items


def test_replacement(spark):
    text = "Anna Blum, 020 7946 0209, met ANNA BLUM and Bo Stein."
    out = privacy.redact(text, NAMES, b"k")
    tags = re.findall(r"\[NAME-\w+\]", out)
    assert len(tags) == 3 and tags[0] == tags[1] != tags[2] and out.endswith(".") and "met" in out
    new = privacy.redact(text, NAMES, b"k", True)
    assert re.fullmatch(r"\w+ \w+, \d{3} \d{4} \d{4}, met [A-Z]+ [A-Z]+ and \w+ \w+\.", new) and new != text
    make = privacy.Surrogates(b"k", NAMES)
    assert sorted(make.permuted(i, 1000, "s") for i in range(1000)) == list(range(1000))
    assert privacy.redact(None, NAMES, b"k") is None
    seg = spark.createDataFrame([(1, "Anna Blum"), (1, "Anna Blum"), (2, None), (None, "Anna Blum")], "ord long, content string")
    chunks = spark.createDataFrame([("c", "x@y.test"), (None, "x@y.test")], "chunk_id string, text string")
    parts = spark.createDataFrame([("Anna", "given"), ("Blum", "family"), (None, "given")], "name_part string, part_kind string")
    records = privacy.records(seg, chunks)
    assert sorted(tuple(r) for r in privacy.detected(records, parts).collect()) == [("chunk", "c", "email", "x@y.test"), ("segment", "1", "name", "Anna Blum")]
    assert privacy.redacted(records, parts, b"k").count() == 3


def test_surrogates(spark):
    names = privacy.Names([("Anna", "given", "f"), ("Ida", "given", "f"), ("Bo", "given", "m"), ("Per", "given", "m"), ("Schmidt", "family"), ("Blum", "family"), ("דנה", "given", "f"), ("רות", "given", "f"), ("כהן", "family"), ("לוי", "family")])
    make = privacy.Surrogates(b"k", names)
    assert sorted(make.permuted(make.permuted(i, 777, "s"), 777, "s", True) for i in range(777)) == list(range(777))
    assert sorted(make.moved(i, 50, "s") for i in range(50)) == list(range(50)) and all(make.moved(i, 50, "s") != i for i in range(50))
    # one entity, several spellings
    a = make.replace("name", "Anna Schmidt")
    assert make.replace("name", "Schmidt, Anna") == ", ".join(reversed(a.split())) and a == "Ida Blum" and make.replace("name", "BO BLUM") == "PER SCHMIDT"
    digits = lambda x: re.sub(r"\D", "", x)
    assert digits(make.replace("phone", "+1 212 555 0100")) == digits(make.replace("phone", "+1-212-555-0100")) and make.replace("phone", "+44 (0)20 7946 0209").startswith("+44 (0)")
    m = make.replace("email", "a.b@x.com")
    assert make.replace("email", "a.b (at) x.com") == m.replace("@", " (at) ") and m.endswith(".com.example") and m != make.replace("email", "a.b@x.org")
    # no two get the same
    assert len({make.replace("name", f"{c}. Schmidt") for c in string.ascii_uppercase}) == 26
    assert len({make.replace("id_number", f"P{i:08}") for i in range(2000)}) == 2000
    # every part of an address goes, its format stays
    for address, form in (("12 Baker Street, London NW6 1XE", r"\d\d \w{5} Street, \w{6} [A-Z]{2}\d \d[A-Z]{2}"), ("Mühlenstr. 123, 00380 Brind", r"\w{5}nstr\. \d{3}, \d{5} \w{5}"), ("9 bis rue de l'Écluse, 00522 Haver", r"\d bis rue de l'\w{6}, \d{5} \w{5}")):
        new = make.replace("address", address)
        assert re.fullmatch(form.replace("\\w{5}nstr", "\\w{5,6}str"), new) and not set(re.findall(r"[A-Z]\w{4,}", address)) - {"Street"} & set(re.findall(r"\w+", new))
    # script stays, and what is outside of the table is replaced too
    assert make.replace("name", "דנה כהן") == "רות לוי" and make.replace("name", "Anna Quorten Blum").split()[1] not in ("Quorten", "Anna")
    make.replace("address", "12 High² street 5")
    tags = lambda t: re.findall(r"\[[A-Z_]+-\w+\]", privacy.redact(t, names, b"k"))
    assert len(set(tags("Anna Schmidt; Schmidt, Anna"))) == len(set(tags("a.b@x.com a.b (at) x.com"))) == len(set(tags("+1 212 555 0100 or +1-212-555-0100"))) == 1
    class Same(privacy.Surrogates):
        def replace(self, kind, item):
            return "(0)"

    assert privacy.redact("Anna Blum, Bo Blum, Anna Blum", names, b"k", True, Same(b"k", names)) == "(0), (0)', (0)"  # whatever comes out, it ends and stays distinct
    seg = spark.createDataFrame([(1, "Anna Blum and Bo Blum")], "ord long, content string")
    parts = spark.createDataFrame([("Anna", "given", "f"), ("Ida", "given", "f"), ("Bo", "given", "m"), ("Per", "given", "m"), ("Blum", "family", None), ("Korte", "family", None)], "name_part string, part_kind string, gender string")
    empty = spark.createDataFrame([], "chunk_id string, text string")
    assert privacy.redacted(privacy.records(seg, empty), parts, b"k", True).first().text == "Ida Korte and Per Korte"


def test_spam_pages(spark):
    prose = "The central pump report was sent to our customs desk after the audit. Each valve is tested by the crew before the shift."
    pages = {
        1: prose, 2: "\n".join(f"buy pump plan - AB-{i}12 - {i}9,99 EUR - www.shop{i}.test" for i in range(9)), 3: ", ".join(["cheap pump", "pump online", "pump", "best pump"] * 15),
        4: prose + "\n#pump #valve", 5: "\n".join(f"2025-01-{i:02} 10:00,Depot,AB-{i},1.5,ok" for i in range(10, 25)), 6: "buy buy buy", 7: None, 8: " ", 9: "\n".join(f"[pump](https://a{i}.test/x)" for i in range(12)),
        10: "- " + prose.replace(". ", "\n- "), 11: " ".join(f"Pump report http://a{i}.test/b" for i in range(30)),
    }
    df = spark.createDataFrame(list(pages.items()), "doc_id long, text string")
    assert {r.doc_id for r in spam_pages.found(df).collect()} == {2, 3, 9, 11}
    assert spam_pages.shares(df).count() == len(pages) and spam_pages.found(df.limit(0)).count() == 0


def test_shingle_bounds():
    row, h = shingles.shingle_sets(["a b c d a b c", "", "x y"], 3)
    assert list(row) == [0] * 4 and len(set(h.tolist())) == 4
    t = shingles.Threshold("0.6")
    assert t.least_partner(10) == 6 and t.overlap(10, 10) == 8 and t.reached(6, 8, 8) and not t.reached(5, 8, 8)
    counts = np.arange(0, 5000)
    least = shingles.class_least(shingles.frequency_class(counts))
    assert (least[:8] == counts[:8]).all() and (least <= counts).all() and (least >= counts * 0.9 - 1).all()
