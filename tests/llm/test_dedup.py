"""Exact, near, suffix and embedding dedup against brute force; nulls, ties, repeats, empty tables."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.llm import embedding_dedup, exact_dedup, near_dedup, queries, suffix_dedup
from tokenloom.llm import _shared as S


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, docs_schema):
    """Random documents with exact and near copies, shared passages, runs, short, empty, null and repeated rows."""
    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.randrange(1, 260))) for _ in range(60)]
    texts += [texts[3], texts[3], texts[9], "", "", "one", "one", "a\nb  c", None, None]
    passage = words(rng, 70)
    for _ in range(3):
        w = words(rng, 120)
        texts.append(" ".join(w[:30] + passage + w[30:]))
    for edits in (1, 2, 4, 6):
        w = texts[20 if len(texts[20].split()) > 100 else 3].split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += ["the " * 200, "ab " * 30 + "cd " * 90, "x" * 5000, "x" * 5000, "x" * 4999 + "y"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s", 1), (None, texts[3], "en", "s", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, docs_schema)


def groups_of(rows):
    by = defaultdict(list)
    for r in rows:
        if r["doc_id"] is not None and r["text"] is not None:
            by[r["text"]].append(r["doc_id"])
    return by


@pytest.mark.parametrize("widths", [exact_dedup.WIDTHS, (2, 90, 1200)])
def test_exact(corpus, widths):
    rows = corpus.collect()
    want = Counter((i, min(ids)) for ids in groups_of(rows).values() for i in sorted(ids)[1:])
    got = Counter(map(tuple, exact_dedup.exact_duplicates(corpus, widths=widths).collect()))
    assert got == want
    kept = exact_dedup.drop_exact(corpus.withColumn("id", F.lit(1)).withColumn("_go", F.lit(2)), widths=widths)
    assert kept.columns == [*corpus.columns, "id", "_go"]
    left = [r for r in kept.collect() if r["doc_id"] is not None and r["text"] is not None]
    assert sorted(r["doc_id"] for r in left) == sorted(min(ids) for ids in groups_of(rows).values())
    assert kept.where("doc_id is null or text is null").count() == corpus.where("doc_id is null or text is null").count()


def test_exact_repeated_id_with_other_texts(spark):
    df = spark.createDataFrame([(1, "a" * 100), (5, "a" * 100), (5, "b" * 100)], "doc_id bigint, text string")
    assert [tuple(r) for r in exact_dedup.exact_duplicates(df).collect()] == [(5, 1)]
    assert sorted(map(tuple, exact_dedup.drop_exact(df).collect())) == [(1, "a" * 100), (5, "b" * 100)]


def test_exact_hot_groups(spark):
    """A hundred thousand equal texts, ids that are strings, and groups too large for a broadcast."""
    rows = spark.range(100_000).select(F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("doc_id"), F.when(F.col("id") % 1000 == 1, F.repeat(F.col("id").cast("string"), 30)).otherwise(F.repeat(F.lit("hot"), 40)).alias("text"))
    rows = rows.unionByName(rows.where("doc_id < 'd000500'"))
    got = exact_dedup.exact_duplicates(rows, most=100, hot_rows=1000)
    n, least, most, ids = got.agg(F.count(F.lit(1)), F.min("duplicate_of"), F.max("duplicate_of"), F.countDistinct("doc_id")).first()
    assert (n, ids, least, most) == (100_500 - 101, 99_901, "d000000", "d000001")
    kept = exact_dedup.drop_exact(rows, most=100, hot_rows=1000)
    assert kept.count() == 101 and kept.where("doc_id = 'd000000'").count() == 1


def test_nothing_is_left_in_the_shared_folder(spark, corpus, tmp_path):
    """Operators delete their tables but for those that results read, and ``clean`` deletes those."""
    folder = S.checkpoint_dir(spark)[len("file://") :]
    S.clean(spark)
    assert not [f for f in os.listdir(folder) if "-" in f and len(f.rsplit("-", 1)[1]) == 32]
    few = corpus.limit(40)
    for make in (exact_dedup.drop_exact, near_dedup.drop_near, suffix_dedup.repeated_passages):
        make(few).count()
        assert len(S._paths) <= 8
        S.clean(spark)
    assert not [f for f in os.listdir(folder) if len(f.rsplit("-", 1)[-1]) == 32]


def test_exact_keeps_groups_of_one_id_apart(spark, tmp_path):
    """Groups that hold the same least id aren't mixed, neither in a round nor at the end."""
    x, y, long = "x" * 64, "y" * 64, 3000
    rows = [(1, x + "r" * long), (1, y + "s" * long), (2, x + "t" * long), (3, y + "t" * long)]
    rows += [(7, "a"), (8, "a"), (7, "b"), (9, "b"), (7, x + "u" * 9), (10, x + "u" * 9), (7, x + "v" * 9), (11, x + "v" * 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, exact_dedup.exact_duplicates(df).collect())) == [(8, 7), (9, 7), (10, 7), (11, 7)]
    assert {r["doc_id"] for r in exact_dedup.drop_exact(df).collect()} == {1, 2, 3, 7}
    df.unionByName(df.where("doc_id = 7")).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, queries.op5_exact_dedup(spark, str(tmp_path)).collect())) == [(8, 7), (9, 7), (10, 7), (11, 7)]


def test_empty_tables(spark, corpus):
    empty = corpus.where("false")
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.drop_near(empty).count() == 0
    assert suffix_dedup.repeated_passages(empty).count() == 0
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_dedup.near_pairs(vectors).count() == 0 and embedding_dedup.near_classes(vectors).count() == 0


def brute_pairs(ids, sig, radius):
    out = {}
    for i in range(len(ids)):
        for j in range(i + 1, len(ids)):
            d = int(np.bitwise_count(sig[i] ^ sig[j]).sum())
            if d <= radius:
                out[min(ids[i], ids[j]), max(ids[i], ids[j])] = d
    return out


@pytest.mark.parametrize("radius", [0, 5, 17])
def test_hamming_join_misses_none(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)
    rows = [base]
    for flips in range(0, 24, 2):
        near = base[:10].copy()
        for r in near:
            for b in rng.choice(128, flips, replace=False):
                r[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        rows.append(near)
    sig = np.unique(np.concatenate(rows), axis=0)
    ids = list(range(len(sig)))
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in zip(ids, sig.view(np.int64).tolist())], "id bigint, s0 bigint, s1 bigint")
    got = near_dedup.hamming_pairs(df, radius=radius).collect()
    assert len(got) == len({(r["id_a"], r["id_b"]) for r in got})
    assert {(r["id_a"], r["id_b"]): r["distance"] for r in got} == brute_pairs(ids, sig, radius)


def test_radius_is_bounded(spark):
    with pytest.raises(ValueError):
        near_dedup.hamming_pairs(spark.createDataFrame([], "id bigint, s0 bigint, s1 bigint"), radius=18)


def test_near_groups(corpus):
    rows = [r for r in corpus.collect() if r["doc_id"] is not None and r["text"] is not None]
    at, sig = near_dedup.signatures(pa.array([r["text"] for r in rows]))
    ids = [rows[i]["doc_id"] for i in at]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), _ in brute_pairs(ids, sig, near_dedup.RADIUS).items():
        a, b = sorted((find(a), find(b)))
        root[b] = a
    far = np.bitwise_count(sig[:, None] ^ sig[None, :]).sum(axis=2)
    links = (far <= near_dedup.RADIUS).sum(axis=1) - 1
    want = Counter((i, find(i), int(n)) for i, n in zip(ids, links) if n)
    assert Counter(map(tuple, near_dedup.near_duplicates(corpus).collect())) == want
    kept = near_dedup.drop_near(corpus.withColumn("_go", F.lit(1)).withColumn("_id", F.lit(2)))
    assert kept.columns == [*corpus.columns, "_go", "_id"]
    left = Counter(r["doc_id"] for r in corpus.collect()) - Counter(i for i, r, _ in want if i != r)
    left[3] = 1  # its rows are alike
    assert Counter(r["doc_id"] for r in kept.collect()) == left
    named = corpus.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 4, "0")))
    assert Counter(map(tuple, near_dedup.near_duplicates(named).collect())) == Counter({(f"d{i:04}", f"d{r:04}", n): k for (i, r, n), k in want.items()})


def test_near_repeated_ids(spark):
    """Rows are told apart by their signatures: a text that only one row has stays, whatever else has its id."""
    rng = random.Random(12)
    a, b, c = (" ".join(words(rng, 80, 5000)) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (5, None), (7, c), (7, c), (8, c + " x"), (None, a)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(map(tuple, near_dedup.drop_near(df).collect()), key=str)
    assert kept == sorted([(1, a), (5, b), (5, None), (7, c), (None, a)], key=str)
    kept = sorted(map(tuple, exact_dedup.drop_exact(df).collect()), key=str)
    assert kept == sorted([(1, a), (5, b), (5, None), (7, c), (8, c + " x"), (None, a)], key=str)


def test_near_recall(spark):
    """Copies with a twentieth of their words changed are found, unrelated documents aren't."""
    rng = random.Random(8)
    texts = []
    for _ in range(120):
        w = words(rng, rng.randrange(80, 400), 3000)
        copy = [f"z{rng.randrange(9999)}" if rng.random() < 0.04 else x for x in w]
        texts += [" ".join(w), " ".join(copy)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r["doc_id"], r["duplicate_of"]) for r in near_dedup.near_duplicates(df).collect() if r["links"] and r["doc_id"] != r["duplicate_of"]}
    right = {(2 * i + 1, 2 * i) for i in range(120)}
    assert len(got & right) >= 0.9 * len(right) and not got - right


def test_near_keeps_short_texts(spark):
    """Distinct texts of one or two words have one word pair each and nothing in common."""
    rng = random.Random(6)
    texts = sorted({"".join(rng.choices("abcdefghij", k=6)) + (f" w{rng.randrange(10**6)}" if i % 2 else "") for i in range(3000)})
    at, sig = near_dedup.signatures(pa.array(texts))
    assert len(at) == len(texts) == len(np.unique(sig, axis=0))
    assert min(np.bitwise_count(sig[:300, None] ^ sig[None, :300]).sum(axis=2)[np.triu_indices(300, 1)]) > near_dedup.RADIUS
    df = spark.createDataFrame(list(enumerate([*texts[:400], texts[0].upper()])), "doc_id bigint, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(df).collect())) == [(0, 0, 1), (400, 0, 1)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(12)]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = near_dedup.components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "id_a bigint, id_b bigint")).collect()
    assert dict(map(tuple, got)) == {i: find(i) for i in root if find(i) != i}


def brute_passages(rows, length):
    seen = defaultdict(list)
    for k, r in enumerate(rows):
        if r["doc_id"] is not None and r["text"] is not None:
            w = r["text"].encode().split()
            for i in range(len(w) - length + 1):
                seen[tuple(w[i : i + length])].append((k, i))
    starts = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                starts[rows[k]["doc_id"]].add(i)
    out = set()
    for doc, at in starts.items():
        at = sorted(at)
        begin = last = at[0]
        for i in [*at[1:], None]:
            if i is None or i - last > length:
                out.add((doc, begin, last - begin + length))
                begin = i
            last = i
    return out


@pytest.mark.parametrize(("length", "gram", "span", "hot"), [(50, 6, 40, 200_000), (12, 3, 8, 2), (5, 2, 4, 200_000)])
def test_passages(corpus, length, gram, span, hot):
    want = brute_passages(corpus.collect(), length)
    got = suffix_dedup.repeated_passages(corpus, length=length, gram=gram, span=span, hot_rows=hot, most=100 if hot == 2 else 1 << 20).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want
    if length == 5:
        named = corpus.where("doc_id < 70").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 4, "0")).alias("n_words"), "text")
        want = brute_passages(corpus.where("doc_id < 70").collect(), length)
        got = suffix_dedup.repeated_passages(named, id_col="n_words", length=length, gram=gram, span=span)
        assert got.columns == ["n_words", "start_word", "n_words_"] and {(int(i[1:]), a, n) for i, a, n in got.collect()} == want


def test_words_that_share_a_hash_are_told_apart():
    w = S.Words(pa.array(["a b a c"]))
    w.hash[:] = 7
    assert suffix_dedup._word_names(w).tolist() == [0, 1, 0, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", max_size=60), min_size=1, max_size=4))
def test_parse_begins_passages_alike(texts):
    """Each passage has one phrase beginning, and equal passages have it at the same distance."""
    p = suffix_dedup.Parse(pa.array(texts), 6, 2, 4)
    cover, seen = [], {}
    for a, low, high in zip(p.at.tolist(), p.low.tolist(), p.high.tolist()):
        for c in range(low, high + 1):
            cover.append(a - c)
            passage = tuple(p.words.hash[a - c : a - c + 6].tolist())
            assert seen.setdefault(passage, c) == c
    w = p.words
    assert sorted(cover) == [i for i in range(len(w.hash) - 5) if w.doc[i] == w.doc[i + 5]]


def test_parse_of_a_text_beyond_2_to_24_words():
    """Places of triggers have no limit: passages at the end of a very long text begin with phrases too."""
    n = (1 << 24) + 300
    text = bytearray(b"a " * n)
    text[::2] = np.random.default_rng(1).integers(97, 123, n, dtype=np.uint8).tobytes()
    p = suffix_dedup.Parse(pa.array([bytes(text)], pa.binary()), 50, 6, 40)
    assert p.low.min() >= 0 and p.high.max() < 40 and (np.diff(p.at) > 0).all()
    assert int((p.high - p.low + 1).sum()) == n - 49 and p.at[-1] > 1 << 24


def test_span_is_checked(corpus):
    with pytest.raises(ValueError):
        suffix_dedup.repeated_passages(corpus, length=10, gram=6, span=9)


@pytest.mark.parametrize(("threshold", "cell", "kind"), [(0.95, 30, "double"), (0.6, 25, "float"), (1.0 - 1e-9, 1000, "double")])
def test_embeddings(spark, threshold, cell, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(190, 8))
    x[100:120] = x[:20] + rng.normal(scale=0.05, size=(20, 8))
    x[120:130] = x[5]
    x[130:150] = x[7] * 3 + rng.normal(scale=0.2, size=(20, 8))
    x[150:] = x[9] + rng.normal(scale=1e-3, size=(40, 8))
    if kind == "float":
        x = x.astype(np.float32).astype(float)
    x[140] *= 2.0**20
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 8, 1), (503, [1.0, float("nan")], 1), (None, x[0].tolist(), 1), (504, [1.0, 2.0], 1), (505, [2.0, 4.0], 1), (506, [None, 1.0], 1), (5, x[5].tolist(), 3), (507, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int").withColumn("_id", F.lit("x"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    assert not (np.abs(u @ u.T - threshold)[~np.eye(190, dtype=bool)] < 1e-12).any() or threshold > 0.99
    equal = {i: min(j for j in range(190) if (x[i] == x[j]).all()) for i in range(190)}
    want = {(min(equal[i], equal[j]), max(equal[i], equal[j])) for i, j in zip(*np.nonzero(near)) if equal[i] != equal[j]} | {(504, 505)}
    pairs = [(r["vec_a"], r["vec_b"]) for r in embedding_dedup.near_pairs(df, threshold=threshold, cell_rows=cell).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    root = list(range(190))
    for _ in range(190):
        new = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(190)]
        if new == root:
            break
        root = new
    want = {i: (root[i], int(near[i].sum()) - 1) for i in range(190)} | {504: (504, 1), 505: (504, 1)}
    got = embedding_dedup.near_classes(df, threshold=threshold, cell_rows=cell).collect()
    assert len(got) == len(want) and {r["vec_id"]: (r["class_id"], r["links"]) for r in got} == want
    if kind == "float":
        named = df.withColumn("vec_id", F.lpad(F.col("vec_id").cast("string"), 4, "0"))
        got = embedding_dedup.near_classes(named, threshold=threshold, cell_rows=cell).collect()
        assert {int(r["vec_id"]): (int(r["class_id"]), r["links"]) for r in got} == want


def test_cover_tree_covers():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = embedding_dedup.cover_tree(x, np.arange(300), 0, 2.0)

    def check(node):
        far = np.linalg.norm(x[node.rows] - x[node.centre], axis=1)
        assert far.max() <= node.radius + 1e-6
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(node.rows.tolist())
            for c in node.children:
                check(c)

    check(tree)


def test_words():
    w = S.Words(pa.array(["ab  cd\n", None, "", "cd", " ab"]))
    assert [bytes(w.data[s:e]) for s, e in zip(w.start, w.end)] == [b"ab", b"cd", b"cd", b"ab"]
    assert w.hash[0] == w.hash[3] and w.hash[1] == w.hash[2] and w.first.tolist() == [0, 2, 2, 2, 3, 4]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19)), max_size=40), st.integers(1, 9))
def test_stars_connect_alike(edges, most):
    steps = [(np.array([a]), np.array([b]), np.zeros(1)) for a, b in edges]
    i, j = near_dedup._connect(iter(steps), 20, most)
    root = {}

    def label(pairs):
        root.clear()
        root.update((k, k) for k in range(20))
        for _ in range(20):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return dict(root)

    assert label(zip(i.tolist(), j.tolist())) == label(edges) and len(i) < 20
