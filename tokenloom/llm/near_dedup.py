"""MinHash near-dedup: a multi-index Hamming join of one-bit MinHash signatures.

Signature: 128 MinHash functions of the set of word pairs of the lower-cased
text, one bit of each minimum (b-bit minwise hashing, Li and Koenig, 2010). The
bit is taken after a mix of the whole minimum: a bit of the minimum itself would
hang on the lower bits of the winning word pair alone, and texts of one pair
would share 256 signatures. Sets of Jaccard similarity J differ in about ``128 * (1 - J) / 2`` bits.

Join: a signature is split into six chunks. By the pigeonhole principle two
signatures within ``RADIUS`` = 17 bits have a chunk with at most two errors.
Each side lists its chunk and all chunks one error away; two chunks share a
listed value exactly if at most two errors part them. So every pair within the
radius meets, none is missed, and no list or group is capped. A pair that meets
several times is counted where it meets first. Equal signatures are one class
with a number of rows beforehand, which keeps large groups of copies linear.

A task that finds pairs returns no pairs, but how many rows each class is linked
to, and stars that connect what it found. Groups are connected components of
those, by alternating large-star and small-star steps (Kiveris et al., 2014);
the smallest id stays.

Cases: a null text, a text without words and a row with a null id have no
signature and are in no group. A text of one word has that word as its set.
Ids may be of any type with an order. Rows that repeat an id are told apart by
their signatures: a row without near copies stays whatever other rows have its
id, and of rows with one id in one group one stays. Empty tables give empty
tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm import _shared as S

BITS = 128
RADIUS = 17
#: (which of the two longs, shift, width) of each chunk.
CHUNKS = tuple((word, shift, width) for word in (0, 1) for shift, width in ((0, 22), (22, 21), (43, 21)))

_rng = np.random.default_rng(20101)
_A = _rng.integers(0, 1 << 64, BITS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 64, BITS, dtype=np.uint64)


def shingle_hashes(w: S.Words) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word pairs, and the document of each; a lone word stands for itself."""
    h, doc = w.hash, w.doc
    if not len(h):
        return np.zeros(0, np.uint64), doc
    after = np.zeros(len(h), bool)
    after[:-1] = doc[1:] == doc[:-1]
    lone = np.diff(w.first)[doc] == 1
    following = np.roll(h, -1)
    both = S.mix(h * np.uint64(0xD6E8FEB86659FD93) + np.where(after, following, np.uint64(0)))
    keep = after | lone
    return both[keep], doc[keep]


def signatures(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a signature, and their signatures as two unsigned longs."""
    x, doc = shingle_hashes(S.Words(pc.utf8_lower(col)))
    if not len(x):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    out = np.zeros((len(start), 2), np.uint64)
    values = np.empty_like(x)
    for k in range(BITS):
        np.multiply(x, _A[k], out=values)
        values += _B[k]
        least = np.minimum.reduceat(values, start)
        out[:, k // 64] |= (S.mix(least) & np.uint64(1)) << np.uint64(k % 64)
    return doc[start], out


def signature_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, s0, s1)`` of every document that has words; ids are integers."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.slices(batches, "t"):
            rows, sig = signatures(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(sig[:, 0].view(np.int64)), pa.array(sig[:, 1].view(np.int64))], ["id", "s0", "s1"])

    return docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).mapInArrow(sign, "id bigint, s0 bigint, s1 bigint")


def _first_meeting(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the first of the keys that both signatures list."""
    chosen = np.full(len(key), -1, np.int64)
    for c in range(len(CHUNKS) - 1, -1, -1):
        word, shift, width = CHUNKS[c]
        mask = np.uint64((1 << width) - 1)
        x, y = (a[:, word] >> np.uint64(shift)) & mask, (b[:, word] >> np.uint64(shift)) & mask
        e = x ^ y
        low = e & (~e + np.uint64(1))
        errors = np.bitwise_count(e)
        value = np.where(errors < 2, x & y, np.minimum(x ^ low, y ^ low))
        chosen = np.where(errors <= 2, value.view(np.int64) | (c << 22), chosen)
    return chosen == key


def _meet(key: np.ndarray, sig: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius, and their distances, of rows sorted by key; blocks of rows of one key are compared whole."""
    at, step = np.arange(len(key)), 0
    while True:
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at + step] == key[at]]
        if not len(at):
            return
        near = np.bitwise_count(sig[at] ^ sig[at + step]).sum(axis=1)
        hit, far = at[near <= radius], near[near <= radius]
        if len(hit):
            once = _first_meeting(key[hit], sig[hit], sig[hit + step])
            yield hit[once], hit[once] + step, far[once]


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each row to the first row of its component: as connected as the pairs, and at most n - 1."""
    first = np.arange(n)
    while True:
        before = first.copy()
        least = np.minimum(first[i], first[j])
        np.minimum.at(first, i, least)
        np.minimum.at(first, j, least)
        first = first[first]
        if (first == before).all():
            on = np.flatnonzero(first != np.arange(n))
            return on, first[on]


def _connect(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_stars` of a stream of pairs; no more than about ``most`` are held."""
    i = j = np.zeros(0, np.int64)
    for a, b, _ in pairs:
        i, j = np.concatenate([i, a]), np.concatenate([j, b])
        if len(i) > most:
            i, j = _stars(i, j, n)
    return _stars(i, j, n) if len(i) else (i, j)


def _listed(signed: DataFrame, *extra: str) -> DataFrame:
    """Each signature under its six chunks and all chunks one error away, in the partition of the ``key`` and sorted by it.

    ``key`` has the chunk's number above 22 bits of its value, and 38 bits below
    for the number of rows ``n`` that have the signature.
    """
    keys = []
    for c, (word, shift, width) in enumerate(CHUNKS):
        base = F.shiftrightunsigned(F.col(f"s{word}"), shift).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(c << 22))
        keys += [base] + [base.bitwiseXOR(F.lit(1 << j)) for j in range(width)]
    rows = F.col("n").cast("bigint") if "n" in signed.columns else F.lit(1)
    tasks = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # one row becomes 134: spread the rows first
    listed = signed.repartition(tasks).select(F.explode(F.array(*keys)).alias("key"), rows.alias("n"), "s0", "s1", *extra)
    packed = listed.select(F.shiftleft("key", 38).bitwiseOR(F.col("n")).alias("key"), "s0", "s1", *extra)
    return packed.repartition(F.shiftrightunsigned("key", 38)).sortWithinPartitions("key")


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of successive rows, sorted by the chunk in ``key``; all rows of a chunk come together."""
    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        part = tuple(c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(part[0]):
            continue
        held.append(part)
        if part[0][0] >> 38 == part[0][-1] >> 38:
            continue  # the last chunk may go on in the next batch
        columns = [np.concatenate(x) for x in zip(*held)]
        chunk = columns[0] >> 38
        cut = int(np.searchsorted(chunk, chunk[-1]))
        yield [x[:cut] for x in columns]
        held = [tuple(x[cut:] for x in columns)]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def hamming_pairs(signed: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """All pairs of rows of ``(id, s0, s1)``, ids and signatures distinct, at most ``radius`` bits apart: ``(id_a, id_b, distance)``, ``id_a < id_b``."""
    _check(radius)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, s0, s1, ids in _whole_keys(batches):
            for i, j, far in _meet(key >> 38, np.column_stack([s0, s1]).view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(far.astype(np.int32))], ["id_a", "id_b", "distance"])

    return _listed(signed, "id").mapInArrow(meet, "id_a bigint, id_b bigint, distance int")


def _check(radius: int) -> None:
    if radius >= 3 * len(CHUNKS):
        raise ValueError(f"{len(CHUNKS)} chunks guarantee pairs up to {3 * len(CHUNKS) - 1} bits apart only")


def hamming_links(classes: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """Of distinct signatures ``(s0, s1, n)``: rows ``(s0, s1, t0, t1, links)``.

    Those with ``links`` say how many rows near signatures have (to be summed
    over rows); the others are pairs that connect the same signatures as all
    pairs within the radius do, at most one for each row that a task gets.
    """
    _check(radius)
    names = ["s0", "s1", "t0", "t1", "links"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, s0, s1 in _whole_keys(batches):
            links = np.zeros(len(key), np.int64)
            rows = key & ((1 << 38) - 1)

            def counted(pairs: Iterator[tuple[np.ndarray, ...]], links: np.ndarray = links, rows: np.ndarray = rows) -> Iterator[tuple[np.ndarray, ...]]:
                for i, j, far in pairs:
                    np.add.at(links, i, rows[j])
                    np.add.at(links, j, rows[i])
                    yield i, j, far

            i, j = _connect(counted(_meet(key >> 38, np.column_stack([s0, s1]).view(np.uint64), radius)), len(key))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s0[i], s1[i], s0[j], s1[j])] + [pa.nulls(len(i), pa.int64())], names)
                on = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(s0[on]), pa.array(s1[on]), *[pa.nulls(len(on), pa.int64())] * 2, pa.array(links[on])], names)

    return _listed(classes).mapInArrow(meet, "s0 bigint, s1 bigint, t0 bigint, t1 bigint, links bigint")


def components(pairs: DataFrame) -> DataFrame:
    """``(id, root)``: the smallest id of the connected component, for each id of ``pairs`` (``id_a``, ``id_b``) that isn't itself the smallest."""
    spark = pairs.sparkSession
    edges = S.written(pairs.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).where("u <> v"), "edges")
    seen = None
    while True:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        large = around.select("u", "v", least.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = F.min("v").over(Window.partitionBy("u"))
        small = large.select("u", "v", low.alias("m"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        turned = S.written(small, "edges")
        state = turned.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        S.drop_written(spark, edges)
        edges = turned
        if state == seen:
            out = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
            out._written_at = edges._written_at
            return out
        seen = state


def near_groups(docs: DataFrame, *, id_col: str = "id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(id, s0, s1, root, links)`` of every row in a group of near copies; ids are integers, ``root`` is the group's smallest, ``links`` the number of other rows within the radius."""
    spark = docs.sparkSession
    signed = S.written(signature_table(docs, id_col=id_col, text_col=text_col), "signatures")
    counted = signed.groupBy("s0", "s1").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = S.written(counted.withColumn("class", F.monotonically_increasing_id()), "classes")
    found = S.written(hamming_links(classes, radius=radius), "links")
    links = found.where("links is not null").groupBy("s0", "s1").agg(F.sum("links").alias("links"))
    stars = found.where("links is null").select("s0", "s1", "t0", "t1").distinct()
    ends = classes.select("s0", "s1", F.col("class").alias("id_a"))
    others = classes.select(F.col("s0").alias("t0"), F.col("s1").alias("t1"), F.col("class").alias("id_b"))
    roots = components(stars.join(ends, ["s0", "s1"]).join(others, ["t0", "t1"]).select("id_a", "id_b"))
    # classes that are linked or have several rows
    linked = classes.join(links, ["s0", "s1"], "left").where("links is not null or n > 1")
    linked = linked.join(roots.select(F.col("id").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    linked = S.written(linked.select("s0", "s1", "least", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("least"))
    named = linked.drop("least").join(least, "root").select("s0", "s1", F.col("least").alias("root"), "links")
    out = S.written(signed.join(named, ["s0", "s1"]).select("id", "s0", "s1", "root", "links"), "near")
    S.drop_written(spark, signed, classes, found, roots, linked)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, duplicate_of, links)``: every row of a group of near copies, with the document of its group that stays and the number of other rows within the radius. Rows without near copies aren't listed."""
    key = S.free_name(docs, "_id")
    numbered, names = S.integer_ids(docs, id_col, key)
    found = near_groups(numbered, id_col=key, text_col=text_col, radius=radius).select("id", "root", "links")
    if names is not None:
        for column in ("id", "root"):
            found = found.join(names.select(F.col(key).alias(column), F.col("id").alias("_" + column)), column).drop(column).withColumnRenamed("_" + column, column)
    return found.select(F.col("id").alias(id_col), F.col("root").alias("duplicate_of"), "links")


def drop_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` without near copies: one document of each group stays, and every row without signature."""
    key = S.free_name(docs, "_id")
    numbered, names = S.integer_ids(docs, id_col, key)
    found = near_groups(numbered, id_col=key, text_col=text_col, radius=radius)
    go = S.free_name(docs, "_go")
    gone = found.where("id <> root").select(F.col("id").alias(go)).distinct()
    stay = numbered.join(gone, F.col(key) == F.col(go), "left_anti").drop(key)
    # ids of several rows: the signature tells which of them go
    ids = numbered.select(F.col(key).alias("id")).where("id is not null")
    several = ids.join(found.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias(go))
    if several.isEmpty():
        return stay
    several = S.written(several, "several")
    met = numbered.join(several, F.col(key) == F.col(go), "left_semi")
    columns = docs.columns
    text = columns.index(text_col)
    names_ = [S.free_name(docs, f"_s{i}") for i in (0, 1)]
    schema = T.StructType([*met.schema.fields, *(T.StructField(x, T.LongType()) for x in names_)])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.slices(batches, text_col):
            rows, sig = signatures(b.column(text).fill_null(""))
            both = []
            for k in (0, 1):
                value = np.zeros(b.num_rows, np.int64)
                value[rows] = sig[:, k].view(np.int64)
                have = np.zeros(b.num_rows, bool)
                have[rows] = True
                both.append(pa.array(value, mask=~have))
            yield pa.RecordBatch.from_arrays([*b.columns, *both], [*b.schema.names, *names_])

    marks = found.select(F.col("id").alias(go), F.col("s0").alias("_m0"), F.col("s1").alias("_m1"), F.col("root").alias("_root")).distinct()
    signed = met.mapInArrow(sign, schema)
    same = (F.col(key) == F.col(go)) & (F.col(names_[0]) == F.col("_m0")) & (F.col(names_[1]) == F.col("_m1"))
    clear = signed.join(marks, same, "left_anti").select(*columns)
    roots = signed.join(marks.where(F.col(go) == F.col("_root")), same, "left_semi").dropDuplicates([key]).select(*columns)
    return numbered.join(gone.unionByName(several).distinct(), F.col(key) == F.col(go), "left_anti").select(*columns).unionByName(clear).unionByName(roots)
