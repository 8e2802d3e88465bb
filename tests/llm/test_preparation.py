"""Quality, BPE, mixing, WARC, sharding, HTML and the pipeline."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.llm import bpe, html_text, mixing, quality, sharding, warc


@pytest.fixture(scope="module")
def graded(spark, docs_schema):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(20, 120))]
        bad = i % 4 == 0
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + ".", "en", "s", 1))
        if i % 2 == 0 or i < 100:
            labels.append((i, 0 if bad else 1, 0))
    labels += [(0, None, 0), (None, 1, 0), (4, 0, 0), (9999, 1, 0)]
    return spark.createDataFrame(rows, docs_schema), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_held_out(spark, graded):
    docs, labels = graded
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs, model, columns=["doc_id"]).collect()
    right = sum(r["keep"] == (r["doc_id"] % 4 != 0) for r in scored if r["doc_id"] >= 100 and r["doc_id"] % 2)
    assert right >= 0.95 * 150 and len(scored) == 400
    order = sorted(scored, key=lambda r: r["score"])
    assert all(a["probability"] <= b["probability"] + 1e-12 for a, b in zip(order, order[1:]))
    assert quality.keep_quality(docs, model).columns == docs.columns
    assert quality.keep_quality(docs, model).count() == sum(r["keep"] for r in scored)
    again = quality.fit_quality(docs, labels, fit_rows=50)
    assert quality.score_quality(docs, again).count() == 400
    odd = docs.limit(1).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("score"), F.lit(2).alias("keep"))
    out = quality.score_quality(odd, model)
    assert out.columns == ["doc_id", "text", "score", "keep", "score_", "probability", "keep_"] and out.count() == 1


def test_quality_is_ridge_and_isotonic_by_brute_force(spark, graded):
    """Scores and probabilities of all documents, from collected rows by numpy alone."""
    docs, labels = graded
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.where("doc_id = 7").withColumn("text", F.lit(None).cast("string")))
    seed, features, ridge = 3, 32, 0.01
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels, seed=seed, features=features, ridge=ridge), columns=["doc_id", "text"]).collect()
    said = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None:
            said.setdefault(r["doc_id"], []).append(r["quality"])
    rows = [r for r in docs.select("doc_id", "text", F.xxhash64("doc_id", F.lit(seed)).alias("h")).collect() if r["doc_id"] in said]
    x = quality.document_statistics(pa.array([r["text"] for r in rows], pa.string()))
    y = np.array([np.mean(said[r["doc_id"]]) for r in rows])
    held = np.array([r["h"] % 4 == 0 for r in rows])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(x.shape[1], features)) / np.sqrt(x.shape[1])
    phases = rng.uniform(0, 2 * np.pi, features)

    def map_(x):
        return np.column_stack([np.cos(np.clip((x - mean) / scale, -8, 8) @ w + phases), np.ones(len(x))])

    # ridge as least squares of rows for the penalty below those of the data
    penalty = np.sqrt(np.append(np.full(features, ridge * len(y)), 1e-9))
    solved = np.linalg.lstsq(np.vstack([map_(x[~held]), np.diag(penalty)]), np.append(y[~held], np.zeros(features + 1)), rcond=None)[0]
    score = map_(x[held]) @ solved
    knots = np.unique(score)
    level = np.array([y[held][score == k].mean() for k in knots])
    many = np.array([(score == k).sum() for k in knots])
    n = len(knots)
    # the isotonic fit is the largest, over beginnings, of the smallest mean, over ends
    means = [[np.average(level[a : b + 1], weights=many[a : b + 1]) if b >= a else np.inf for b in range(n)] for a in range(n)]
    fit = np.array([max(min(means[a][b] for b in range(k, n)) for a in range(k + 1)) for k in range(n)])
    want = map_(quality.document_statistics(pa.array([r["text"] for r in scored], pa.string()))) @ solved
    assert np.allclose([r["score"] for r in scored], want, atol=1e-6)
    assert np.allclose([r["probability"] for r in scored], np.interp(want, knots, fit), atol=1e-4)
    assert len(scored) == 406


def test_quality_without_labels(graded):
    docs, labels = graded
    for some, p in ((labels.where("false"), 1.0), (labels.where("quality = 0"), 0.0)):
        model = quality.fit_quality(docs, some)
        assert {r["probability"] for r in quality.score_quality(docs, model).collect()} == {p}
    assert quality.score_quality(docs.where("false"), model).count() == 0


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    d, n = len(quality.STATISTICS), 20_000
    directions, phases = rng.normal(size=(d, n)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, n)
    x, y = rng.normal(size=(2, d))
    z = 2 / n * np.sum(np.cos(x @ directions + phases) * np.cos(y @ directions + phases))
    assert z == pytest.approx(np.exp(-np.sum((x - y) ** 2) / (2 * d)), abs=0.03)


def test_partition_sums_are_the_whole():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 4)), rng.normal(size=30)
    parts = [quality.normal_equations(x[i : i + 7], y[i : i + 7]) for i in range(0, 30, 7)]
    assert np.allclose(sum(p[0] for p in parts), x.T @ x) and np.allclose(sum(p[1] for p in parts), x.T @ y)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=1, max_size=25))
def test_isotonic_is_the_best_monotone_fit(points):
    x, y = (np.array(v, float) for v in zip(*points))
    knots, values = quality.isotonic(x, y)
    assert (np.diff(values) >= -1e-12).all()
    fit = np.interp(x, knots, values)
    for u in np.unique(x):  # min-max formula
        ends = [[y[(x >= a) & (x <= b)].mean() for b in np.unique(x) if b >= u] for a in np.unique(x) if a <= u]
        assert fit[x == u][0] == pytest.approx(max(min(e) for e in ends))


def test_statistics_of_edge_texts():
    s = quality.document_statistics(pa.array([None, "", " \n", "A", "é" * 50_000, "a b"]))
    assert np.isfinite(s).all() and (s[0] == s[1]).all()


def test_bpe_frames(spark):
    texts = [None, "", "hello world", "a" * 5000, "ab cd " * 2000, "é日本" * 3000 + " x", ("lkjh" * 900 + ".") * 5, "  \n\n x", "\x1c\x1d a b", "x" * 9999 + " " + "y" * 9999]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "again", "z"), (1, "", "z")], "doc_id bigint, text string, token_ids string")
    v = bpe.vocabulary()
    for long, raw in ((bpe.LONG, bpe.RAW), (500, 64), (64, 7)):
        rows = bpe.decode_bpe(bpe.encode_bpe(df, long=long, raw=raw), ids_col="token_ids_").collect()
        assert len(rows) == df.count()
        for r in rows:
            assert r["decoded"] == r["text"]
            assert r["token_ids_"] == (None if r["text"] is None else v.text(r["text"])), (long, r["doc_id"])
    assert bpe.decode_bpe(bpe.encode_bpe(df.where("false"))).count() == 0
    odd = spark.createDataFrame([([1, None, -5, 99_999_999, 2],), ([],), (None,)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode_bpe(odd, ids_col="ids").collect()] == [(v.bytes[1] + v.bytes[2]).decode(), "", None]


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=60).map(lambda b: bytes(97 + x % 3 for x in b)), st.integers(0, 500), st.integers(1, 9))
def test_tree_concatenation_is_exact(piece, seed, raw):
    """Against one encoding of the whole, for random vocabularies."""
    rng = random.Random(seed)
    ranks = {bytes([97 + i]): i for i in range(3)}
    for _ in range(12):
        a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
        ranks.setdefault(a + b, len(ranks))
    v = bpe.Vocabulary(ranks)
    assert v.tree([v.piece(p) for p in bpe.halves(piece, raw)]) == v.piece(piece)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.1, 100), st.floats(0.01, 10)), min_size=1, max_size=6), st.floats(0.1, 3), st.floats(0.5, 5))
def test_water_filling(sources, budget, epochs):
    sizes, weights = {i: s for i, (s, _) in enumerate(sources)}, {i: w for i, (_, w) in enumerate(sources)}
    total = budget * sum(sizes.values())
    got = mixing.water_fill(sizes, weights, total, epochs)
    assert all(got[s] <= epochs * sizes[s] * (1 + 1e-9) for s in sizes)
    assert sum(got.values()) == pytest.approx(min(total, epochs * sum(sizes.values())))
    open_ = [got[s] / weights[s] for s in sizes if got[s] < epochs * sizes[s] * (1 - 1e-9)]
    assert not open_ or max(open_) == pytest.approx(min(open_))
    assert all(got[s] / weights[s] <= max(open_) * (1 + 1e-9) for s in sizes) if open_ else True


def test_mixing(spark):
    rows = [(i, "x" * 10, "big" if i % 10 else None) for i in range(2000)] + [(5000 + i, "", "empty") for i in range(3)] + [(None, "abc", "odd"), (1, "x" * 10, "big")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("copy", F.lit("c"))
    epochs = {s: e for s, _, e in mixing.source_epochs(df)}
    out = mixing.mix_sources(df).collect()
    assert df.columns + ["copy_"] == list(out[0].asDict())
    n = sum(r["source"] == "big" for r in out)
    assert n == pytest.approx(1801 * epochs["big"], rel=0.06) and sum(r["source"] == "empty" for r in out) == 3
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(df).collect()))
    assert sum(r["source"] is None for r in out) == pytest.approx(200 * epochs[None], rel=0.2)
    given_ = mixing.mix_sources(df, weights={"big": 1.0, None: 1.0}, budget=1.0, max_epochs=2).collect()
    assert {r["source"] for r in given_} == {"big", None} and sum(r["source"] is None for r in given_) == 400
    assert mixing.mix_sources(df.where("false")).count() == 0


def test_warc(spark, tmp_path):
    df = spark.createDataFrame([(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, None, ""), (4, "u4", None), (None, "u5", "é"), (1, "u1", "<p>a</p>")], "page_id bigint, url string, html string")
    path = str(tmp_path / "archive")
    out = warc.archived_records(df, path).collect()
    assert len(out) == 6 and spark.read.parquet(path + "/payloads").count() == 3
    for r in out:
        header, body = bytes(r["bytes"]).split(b"\r\n\r\n", 1)
        body = body[: -len(warc.END)]
        assert int(warc.header_field(header + b"\r\n\r\n", b"content-length")) == len(body)
        assert r["digest"] in (None, hashlib.sha256(body).hexdigest())
    blob = b"".join(bytes(r["bytes"]) for r in out)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(blob)
    (tmp_path / "w" / "b.warc.gz").write_bytes(b"".join(gzip.compress(bytes(r["bytes"])) for r in out))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert back.count() == 12 and back.where("not declared_ok").count() == 0
    again = str(tmp_path / "again")
    warc.write_archive(back, again)
    made = warc.original_records(warc.read_archive(spark, again)).collect()
    for name in ("a.warc", "b.warc.gz"):
        part = sorted((r for r in made if name in r["record"]), key=lambda r: int(r["record"].rpartition("#")[2]))
        assert b"".join(bytes(r["bytes"]) for r in part) == blob
    (tmp_path / "w" / "a.warc").write_bytes(blob.replace(b"<p>a</p>", b"<p>b</p>"))
    assert warc.read_warc(spark, str(tmp_path / "w" / "a.warc")).where("not declared_ok").count() == 3
    forged = spark.createDataFrame([("0" * 64, 1, bytearray(b"x"))], "digest string, size int, payload binary")
    forged.write.mode("overwrite").parquet(again + "/payloads")
    with pytest.raises(Exception, match="lacks its digest"):
        warc.read_archive(spark, again).where("payload is not null").count()
        warc.read_archive(spark, again).collect()
    assert warc.archived_records(df.where("false"), str(tmp_path / "none")).count() == 0


WELL = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.mark.parametrize(
    ("data", "payloads", "errors"),
    [
        (WELL * 2, [b"abc"] * 2, [None] * 2),
        (WELL[:-2] + WELL, [b"abc"] * 2, [None] * 2),  # one line end between records
        (WELL[:-4], [b"abc"], [None]),
        (WELL.replace(b"\r\n", b"\n") * 2, [b"abc"] * 2, [None] * 2),
        (WELL.replace(b"Content-Length: 3\r\n", b"") + WELL, [b"abc", b"abc"], ["no content length", None]),
        (WELL.replace(b": 3", b": x3") + WELL, [b"abc", b"abc"], ["no content length", None]),
        (WELL.replace(b": 3", b": 2") + WELL, [b"ab", b"abc"], ["bytes after the record", None]),
        (WELL.replace(b": 3", b": 300"), [b"abc\r\n\r\n"], ["payload ends early"]),
        (b"junk\n" + WELL, [b"junk\n", b"abc"], ["no record", None]),
        (b"junk", [b"junk"], ["no record"]),
        (WELL + b"WARC/1.0\r\nA: b", [b"abc", b""], [None, "header without end"]),
        (WELL.replace(b"abc", b"\nWARC/1.0\r\n").replace(b": 3", b": 11"), [b"\nWARC/1.0\r\n"], [None]),
        (b"", [], []),
    ],
)
@pytest.mark.parametrize("step", [1, 7, 1000])
def test_warc_keeps_all_bytes(data, payloads, errors, step):
    found = list(warc.parse_records(data[i : i + step] for i in range(0, len(data), step)))
    assert [r.payload for r in found] == payloads and [r.error for r in found] == errors
    assert b"".join(r.header + r.payload + r.rest for r in found) == data


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([WELL, b"WARC/1.0\r\n", b"\r\n", b"\n", b"Content-Length: 5", b"abc", b"WARC/", b"\n\n"]), max_size=12), st.integers(1, 9))
def test_warc_parses_anything(parts, step):
    data = b"".join(parts)
    found = list(warc.parse_records(data[i : i + step] for i in range(0, len(data), step)))
    assert b"".join(r.header + r.payload + r.rest for r in found) == data and found == list(warc.parse_records(data))


def test_warc_declared_digests():
    sha1 = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"

    def check(fields, payload):
        return warc.declared_is_right(b"WARC/1.0\r\n" + fields.encode() + b"\r\n\r\n", payload)

    assert check(f"WARC-Payload-Digest: sha1:{sha1}", b"body") is True and check(f"WARC-Payload-Digest: sha1:{sha1}", b"bodY") is False
    assert check("WARC-Payload-Digest: sha1:AAAA", b"body") is None and check("", b"body") is None and check("WARC-Payload-Digest: crc:12", b"body") is None
    assert check(f"Content-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{sha1}", http) is True
    assert check(f"WARC-Type: revisit\r\nWARC-Payload-Digest: sha1:{sha1}", b"") is None
    assert check(f"WARC-Block-Digest: md5:{hashlib.md5(b'x').hexdigest()}\r\nWARC-Payload-Digest: sha1:{sha1}", b"body") is False


def test_warc_files_with_faults(spark, tmp_path):
    bad = gzip.compress(WELL) + gzip.compress(WELL)[:20]
    (tmp_path / "a.warc.gz").write_bytes(bad)
    (tmp_path / "b.warc").write_bytes(b"x\n" + WELL.replace(b": 3", b": -1"))
    for stream in (True, False):
        rows = warc.read_warc(spark, str(tmp_path), stream=stream).collect()
        assert sorted((r["record"].rpartition("/")[2], r["error"]) for r in rows if r["error"]) == [("a.warc.gz#1", "header without end"), ("a.warc.gz#2", "gzip: a member has no end"), ("b.warc#0", "no record"), ("b.warc#1", "no content length")]
        assert sum(bytes(r["payload"]) == b"abc" for r in rows) == 2
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(WELL) + b"\x1f\x8bno gzip")
    rows = warc.read_warc(spark, str(tmp_path / "a.warc.gz")).collect()
    assert [r["error"] is None for r in rows] == [True, False] and bytes(rows[1]["payload"]).endswith(b"no gzip")


@pytest.mark.parametrize("nulls", [0, 3])
def test_sharding_of_the_whole_range_of_longs(spark, nulls):
    """Keys up to the ends of the range, some 2^62 apart and some one apart, nulls beside them: shards as by brute force."""
    rng = random.Random(nulls)
    keys = [2**62 + i for i in range(64)] + [-(2**63), -(2**63) + 1, 2**63 - 1, 2**63 - 2, 0, -1] + [rng.randrange(-(2**63), 2**63) for _ in range(100)]
    rows = [(k, "x" * rng.randrange(1, 50)) for k in keys] + [(None, "n")] * nulls
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), shards=8).collect()
    total, below, want = sum(len(t) for k, t in rows if k is not None), 0, []
    for k, t in sorted((k, t) for k, t in rows if k is not None):
        want.append((k, min(7, below * 8 // total)))
        below += len(t)
    assert sorted((r["doc_id"], r["shard"]) for r in got if r["doc_id"] is not None) == want
    assert [r["shard"] for r in got if r["doc_id"] is None] == [0] * nulls


def test_sharding_by_strings(spark):
    rng = random.Random(5)
    rows = [(f"https://a.example/{rng.randrange(10**6)}", "x" * rng.randrange(100)) for _ in range(300)] + [(None, "x")]
    out = sharding.shard(spark.createDataFrame(rows, "url string, _key string").withColumnRenamed("_key", "text").withColumn("_key", F.lit(1)), key_col="url", shards=5)
    got = sorted((r["url"], r["shard"]) for r in out.collect() if r["url"])
    assert out.columns == ["url", "text", "_key", "shard"] and len(got) == 300 and {s for _, s in got} == set(range(5)) and [s for _, s in got] == sorted(s for _, s in got)


@pytest.mark.parametrize("tolerance", [0.0, 0.2])
def test_sharding(spark, tolerance):
    rng = random.Random(2)
    rows = [(rng.randrange(-(10**12), 10**12), "x" * rng.randrange(200)) for _ in range(900)] + [(7, "y" * 30_000), (7, None), (None, "z"), (8, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit("s")).repartition(5)
    out = sharding.shard(df, shards=9, tolerance=tolerance, shard_bytes=1)
    got = out.withColumn("p", F.spark_partition_id()).collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "text", "shard", "shard_"] and {r["p"] for r in got if True} <= set(range(9))
    assert all(r["p"] == r["shard_"] for r in got)
    keys = sorted((r["doc_id"], r["shard_"]) for r in got if r["doc_id"] is not None)
    assert [s for _, s in keys] == sorted(s for _, s in keys) and [r["shard_"] for r in got if r["doc_id"] is None] == [0]
    total = sum(len(r["text"] or "") for r in got if r["doc_id"] is not None)
    below = {}
    for k, t in sorted((k, len(t or "")) for k, t in rows if k is not None):
        below.setdefault(k, sum(len(t2 or "") for k2, t2 in rows if k2 is not None and k2 < k))
    if not tolerance:
        assert all(s == min(8, below[k] * 9 // total) for k, s in keys)
    else:
        sizes = [sum(len(r["text"] or "") for r in got if r["shard_"] == i) for i in range(9)]
        light = [x for x in sizes if x < 25_000]
        assert max(light) <= total / 9 * (1 + 2 * tolerance) + 200
    for p in {r["p"] for r in got}:
        part = [r["doc_id"] for r in got if r["p"] == p and r["doc_id"] is not None]
        assert part == sorted(part)
    assert sharding.shard(df.where("false"), shards=4).count() == 0
    assert {r["shard"] for r in sharding.shard(spark.createDataFrame([(1, ""), (2, None)], "doc_id bigint, text string")).collect()} == {0}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<title>t</title><p>a  b\n c<p>d", "a b c\n\nd"),
        ("<ul><li>a<li>b<ol start=9><li>x<li value=3>y</ol></ul>", "- a\n- b\n  9. x\n  3. y"),
        ("<table><tr><th>Name<th>N<tr><td>apple pie<td>3</table>", "Name      | N\napple pie | 3"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>cc</table>", "a | b\n  | cc"),
        ("<table><tr><td>a<br>b<td>c</table>", "a | c\nb"),
        ("<pre>\n a\n  b </pre>", " a\n  b"),
        ("a<script>if (a < b) {}</script>b<!-- c -->c<style>p{}</style>", "abc"),
        ("<style>.x, #y {display: none}</style><p class='q x'>no</p><p id=y>no</p><p>yes</p>", "yes"),
        ("<div hidden>no</div><div style='display : none'>no</div><details><summary>s</summary>no</details>", "s"),
        ("a<div>b</div>c", "a\nb\nc"),
        ("5 < 6 &amp; 7&nbsp;8 <3", "5 < 6 & 7 8 <3"),
        ("<dl><dt>k<dd>v<dt>l</dl>", "k\n    v\nl"),
        ("<b>x<p>y</b>z", "x\n\nyz"),
        ("</p>a</div></td>b", "ab"),
        ("<select><option>1<option>2</select>", "1\n2"),
        ("<a href='x>y'>z</a><br><br>w<br>", "z\n\nw"),
        ("<p>a<table><tr><td>b</table>c", "a\n\nb\n\nc"),
        ("<td>x</td>", "x"),
    ],
)
def test_html(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize(
    ("css", "hidden"),
    [
        ("@media print{.main, nav{display:none}}", ""),
        ("@media (max-width:600px){.main{display:none}} nav{display:none}", "nav"),
        ("@media screen and (min-width:40em){.main{display:none}}", ".main"),
        ("@media print, screen{nav{visibility:hidden}}", "nav"),
        ("@media not print{nav{display:none}}", "nav"),
        ("@media not all and (min-width:600px){nav{display:none}}", ""),
        ("@media (400px <= width < 900px){nav{display:none}}@media (width>900px){.main{display:none}}", ".main"),
        ("@media (orientation:portrait) or (prefers-color-scheme:dark){nav{display:none}}", ""),
        ("@media (unheard-of:1) {nav{display:none}} @media not (unheard-of:1){.main{display:none}}", ""),
        ("@supports (display:grid){@layer a{@media screen{nav{display:none}}}} @supports not (display:grid){.main{display:none}}", "nav"),
        (".main{display:none}@media (min-width:600px){.main{display:block}}", ""),
        (".main{display:none!important}.main{display:block}", ".main"),
        ("@keyframes k{from{visibility:hidden}} @import 'x;{'; nav{content:'}';display:none", "nav"),
        ("nav{@media print{display:none}} .main{@media screen{display:none}} nav{.main{color:red}}", ".main"),
        (".main{backface-visibility:hidden}/* nav{display:none} */", ""),
    ],
)
def test_html_rules_of_screens(css, hidden):
    assert html_text.hiding_selectors([css]) == frozenset(hidden.split())
    page = f"<style>{css}</style><style media=print>div{{display:none}}</style><style media='all'>i{{display:none}}</style><nav>n</nav><div class=main>m</div><i>i</i>"
    assert html_text.page_text(page) == "\n".join(t for t, s in (("n", "nav"), ("m", ".main")) if s not in hidden.split())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a <math><mi>x</mi> <mo>=</mo> <mfrac><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow><mn>2</mn></mfrac></math> b", "a x=(a+b)/2 b"),
        ("<p>so<math display=block><semantics><msup><mi>e</mi><mn>2</mn></msup><annotation>e^2 tex</annotation></semantics></math>end", "so\ne^2\nend"),
        ("<math><msqrt><mn>2</mn></msqrt><mtext> if <b>p</b></mtext><mphantom><mi>no</mi></mphantom></math>", "√(2) if p"),
        ("<table><math><mi>x</mi></math><tr><td><math><msub><mi>y</mi><mi>i</mi></msub></math></table>", "x\ny_i"),
        ("a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><metadata>no</metadata><rect/><g><text>L 1</text><text display=none>no</text><text><tspan x=1 dy=0>L</tspan><tspan x=1 dy='1.2em'>2</tspan></text></g></svg>b", "a\nL 1\nL\n2\nb"),
        ("<p>a<svg><foreignObject><div>d<p>e</p></div></foreignObject><text>f<![CDATA[<&amp;]]></text></svg><p>g", "a\nd\n\ne\nf<&amp;\n\ng"),
        ("<svg><switch><foreignObject><p>one</p></foreignObject><text>no</text></switch></svg>", "one"),
        ("<svg><title/><g><circle r=1 /><text>in</text><p>out", "in\n\nout"),
        ("<style>.h{display:none}</style><svg class=h><text>no</text></svg><svg visibility=hidden><text>no</text></svg>x", "x"),
        ("a <map name=m><p>in <a href=x>map</a></p><area alt=no></map> b", "a\n\nin map\n\nb"),
        ("a <svg viewBox='0 0 1 1'><path d='M0 0'/></svg>b", "a b"),
    ],
)
def test_html_draws_formulas_labels_and_maps(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div style='visibility:hidden'>no<p style='visibility: visible'>in<b>side</b></p>no</div>out", "inside\nout"),
        ("<style>.h{visibility:hidden}.v{visibility:visible}</style><p class=h>no <span class=v>in</span> no</p><p class='h v'>kept", "in\n\nkept"),
        ("<table><tr><td>a<td style='visibility:hidden'>bb<td>c<tr><td>d<td>ee<td>f</table>", "a |    | c\nd | ee | f"),
        ("<ol><li>a<li style='visibility:hidden'>no<li>c<li style='visibility:hidden'>no<p style='visibility:visible'>d</ol>", "1. a\n3. c\n   d"),
        ("<style>p{display:none}#k{display:block}</style><p>no<p id=k>kept", "kept"),
        ("<svg visibility=hidden><text>no</text><text visibility=visible>in</text></svg>x", "in\nx"),
        ("<p style='visibility:hidden'>no <math><mfrac><mi>a</mi><mi>b</mi></mfrac></math><p>x", "x"),
    ],
)
def test_html_visibility_is_inherited(page, text):
    assert html_text.page_text(page) == text


TREES = st.recursive(
    st.tuples(st.sampled_from(["w", "x", "yz"]), st.just(()), st.just("")),
    lambda inner: st.tuples(st.sampled_from(["div", "p", "span", "article", "b", "section"]), st.lists(inner, max_size=4).map(tuple), st.sampled_from(["", "", "", "display:none", "visibility:hidden", "visibility:visible", "color:red"])),
    max_leaves=14,
)


@settings(max_examples=200, deadline=None)
@given(TREES)
def test_html_shows_what_a_tree_shows(tree):
    """Words of a well-formed tree, by brute force: those without an element that isn't displayed around them, and whose nearest word on visibility is visible."""
    words = []

    def write(node, dark, gone, inside_p):
        tag, children, style = node
        if not children and not style and tag in ("w", "x", "yz"):
            words.append((f"{tag}{len(words)}", dark or gone))
            return f" {words[-1][0]} "
        tag = "span" if inside_p and tag != "b" else tag  # a paragraph would end at a block
        dark = {"visibility:hidden": True, "visibility:visible": False}.get(style, dark)
        inner = "".join(write(c, dark, gone or style == "display:none", inside_p or tag == "p") for c in children)
        return f"<{tag} style='{style}'>{inner}</{tag}>"

    page = write(tree, False, False, False)
    shown = [w for w in html_text.page_text(page).split() if w != "-"]
    assert shown == [w for w, hidden in words if not hidden]


def test_html_wide_tables_do_not_grow():
    """Padding is bounded; what isn't aligned keeps all its words."""
    head = "".join(f"<td>{'h' * 100}{i}" for i in range(200))
    page = f"<table><tr>{head}" + "<tr>" + "<tr>".join(f"<td colspan=199>a{i}<td>b{i}" for i in range(900)) + "</table>"
    text = html_text.page_text(page)
    assert len(text) < 3 * len(page) and text.endswith("\na899 | b899") and f"{'h' * 100}199" in text
    assert html_text.page_text("<table><tr><td>a<td>b<tr><td>ccc<td>d</table>") == "a   | b\nccc | d"


def test_html_long_lists_keep_their_numbers():
    assert html_text.page_text("<ol start=2001><li>a<li>b<li value=123456>c<li>d</ol>") == "2001. a\n2002. b\n123456. c\n123457. d"
    assert html_text.page_text("<ol start=-5000><li>a</ol>") == "-5000. a"
    assert html_text.page_text(f"<ol start={'9' * 4300}><li>a<li>b</ol>") == "1. a\n2. b"
    assert html_text.page_text("<table><tr><td colspan=99999999>a<td>b</table>").count("|") == 1


def test_html_frames(spark):
    deep = "<div>" * 3000 + "in" + "</div>" * 3000 + "out"
    rows = [(1, None, "x"), (2, "<p>a", "x"), (2, "<p>a", "x"), (None, "", "x"), (3, deep, "x"), (4, "<" * 5000 + '"' * 99 + "<a b='", "x")]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, html string, text string"))
    assert out.columns == ["page_id", "html", "text", "text_"]
    got = out.collect()
    assert [r["text_"] for r in got[:4]] == [None, "a", "a", ""] and "in" in got[4]["text_"] and "out" in got[4]["text_"]
    assert html_text.extract_text(out.where("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<b>", "</b>", "<div>", "</div>", "<br>", "w1", "w2 ", " w3"]), max_size=25))
def test_html_keeps_all_words(parts):
    text = html_text.page_text("".join(parts))
    assert sorted(c for c in text if c in "w123") == sorted(c for p in parts if p[0] != "<" for c in p if c in "w123")


def test_pipeline(spark, docs_schema, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(80):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(30, 90))]
        bad = i % 5 == 0
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w), "en", f"s{i % 3}", 1))
        labels.append((i, int(not bad), 0))
    good = rows[1][1]
    rows += [(100, good, "en", "s0", 1), (101, good + " extra", "en", "s0", 1), (102, None, None, None, None), (103, "", "en", "s0", 0)]
    spark.createDataFrame(rows, docs_schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept, seen = {r["doc_id"] for r in docs.collect()}, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append({r["doc_id"] for r in docs.collect()})
    assert not seen[0] & set(range(0, 80, 5)) and set(range(80)) - set(range(0, 80, 5)) <= seen[0]
    assert seen[1] == seen[0] - {100} and seen[2] == seen[1] - {101}
    assert seen[3] <= seen[2] and seen[4] == seen[3]
    final = docs.collect()
    texts = {i: t for i, t, *_ in rows}
    assert all(r["decoded"] == texts[r["doc_id"]] for r in final)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids", "decoded"] and all(r["decoded"] == r["text"] for r in final)
    # other columns stay, names that the last stage wants too; an empty table gives an empty one
    odd = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumns({"decoded": F.lit("x"), "_go": F.lit(1), "copy": F.lit(2)})
    for table in (odd, odd.where("false")):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, str(tmp_path))
            out.write.mode("overwrite").parquet(str(tmp_path / f"odd{k}"))
            table = spark.read.parquet(str(tmp_path / f"odd{k}"))
        assert table.columns == [*odd.columns, "token_ids", "decoded_"]
    assert table.count() == 0
    assert sorted((r["doc_id"], r["decoded"] or "") for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r["doc_id"], r["decoded"] or "") for r in final)
