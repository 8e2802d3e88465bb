"""Embedding near-dedup by dual traversal of cover trees: exact links above a cosine.

On unit vectors a cosine of at least t is a distance of at most
``tau = sqrt(2 - 2 t)``. Equal vectors are one class with a number of rows. Some
classes, taken by the hash of their number, are the top level of the tree; each
vector belongs to the nearest of them, its cell. Pairs of cells whose centres are
at most tau plus both covering radii apart are compared, and a cell with itself.
A vector goes to the pair of its cell and another only if it is within the
other's covering radius plus tau and at most ``2 tau`` farther from the other
centre than from its own; by the triangle inequality no pair within tau is lost.
Cells of more than ``cell_rows`` classes are cut into blocks, and each pair of
blocks is a task, so that a task's size is bounded whatever a cell holds.

In a task, cover trees are built (Beygelzimer, Kakade and Langford, 2006): a
node's children are a greedy net at half its radius. Two trees are walked
together: a pair of nodes is left as soon as its centres are farther apart than
tau plus both covering radii, and taken whole, without its pairs, as soon as tau
is more than the distance of the centres plus both radii. What remains is
compared exactly, with 64-bit numbers; vectors move as they came.

A task returns how many rows each class is linked to and stars that connect what
it found, so that what moves is in proportion to the classes, not to the pairs.

The number of centres, which all executors get, is about ``most_centres`` at
most. In spaces of many dimensions without near copies the bounds prune little,
and the work within tau's reach grows with the square of the classes, as for any
exact metric join.

Cases: null vectors, vectors with null, infinite or undefined elements, zero
vectors, and rows with a null id have no result. Vectors of different dimensions
aren't compared with each other. Equal vectors are linked. Ids may be of any type
with an order. Rows that repeat an id and vector are one row; rows with one id
and other vectors are rows of their own. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import _shared as S
from tokenloom.llm.exact_dedup import members
from tokenloom.llm.near_dedup import _connect, components

THRESHOLD = 0.95
CELL_ROWS = 8_192
MOST_CENTRES = 4_096
LEAF = 16
BLOCK = 512
_SLACK = 1e-9


def cosine_at(radius: np.ndarray | float) -> np.ndarray | float:
    """The cosine of unit vectors that are ``radius`` apart."""
    return 1 - np.square(radius) / 2


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


@dataclass
class Node:
    """A ball: ``radius`` covers all of ``rows``; ``centres`` and ``radii`` are its children's."""

    centre: int
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None


def net(x: np.ndarray, rows: np.ndarray, radius: float) -> list[tuple[int, np.ndarray]]:
    """Greedy net: centres more than ``radius`` apart, each with the rows that it covers first."""
    out: list[tuple[int, np.ndarray]] = []
    rest = rows
    while len(rest):
        block = rest[:BLOCK]
        near = x[block] @ x[rest].T >= cosine_at(radius)
        free = np.ones(len(rest), bool)
        for i, row in enumerate(block):
            if free[i]:
                covered = near[i] & free
                covered[i] = True
                free &= ~covered
                out.append((int(row), rest[covered]))
        rest = rest[free]
    return out


def cover_tree(x: np.ndarray, rows: np.ndarray, centre: int, level: float, reach: float = 2.0) -> Node:
    """Tree of ``rows``, all within ``level`` of ``centre``. Levels above ``reach`` that would leave most rows in nodes of their own are skipped."""
    radius = float(distance(x[[centre]], x[rows]).max())
    node = Node(centre, radius, rows)
    if len(rows) <= LEAF or radius < 1e-7:
        return node
    half = level / 2
    while half > radius:
        half /= 2
    parts = net(x, rows, half)
    while half > reach and len(parts) > len(rows) / 4:
        half /= 2
        parts = net(x, rows, half)
    node.children = sorted((cover_tree(x, part, c, half, reach) for c, part in parts), key=lambda c: c.radius)
    node.centres = np.array([c.centre for c in node.children])
    node.radii = np.array([c.radius for c in node.children])
    return node


def _runs(radii: np.ndarray, size: int) -> list[slice]:
    """Children, sorted by radius, in runs: points first, then balls, which are few, in small runs of like radii."""
    points = int(np.searchsorted(radii, _SLACK, "right"))
    cuts = [*range(0, points, size), *range(points, len(radii), 64), len(radii)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def dual(x: np.ndarray, a: Node, b: Node, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows ``i`` of ``a`` and ``j`` of ``b`` whose cosine is at least ``threshold``, each pair once where both are the same tree.

    Pairs come as two lists of equal length, or, with True, as two lists every
    row of which is near every row of the other (the same list for all pairs in
    a node).
    """
    tau = np.sqrt(max(2 - 2 * threshold, 0)) + _SLACK
    sure = tau - 1e-6
    same = a is b
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        if 2 * p.radius <= sure and p is q and len(p.rows) > 1:
            yield p.rows, p.rows, True
            continue
        if not p.children and not q.children:
            i, j = np.nonzero(x[p.rows] @ x[q.rows].T >= threshold)
            if same and p is q:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield p.rows[i], q.rows[j], False
            continue
        ps, pc, pr = (p.children, p.centres, p.radii) if p.children else ([p], np.array([p.centre]), np.array([p.radius]))
        qs, qc, qr = (q.children, q.centres, q.radii) if q.children else ([q], np.array([q.centre]), np.array([q.radius]))
        for part, other in ((u, v) for u in _runs(pr, BLOCK) for v in _runs(qr, len(qs))):
            cosine = x[pc[part]] @ x[qc[other]].T
            # first with the largest radii of the run, then, for the few that are left, with their own
            i, j = np.nonzero(cosine >= cosine_at(min(tau + pr[part][-1] + qr[other][-1], 2.0)) - _SLACK)
            radii = pr[part][i] + qr[other][j]
            fine = cosine[i, j] >= cosine_at(np.minimum(tau + radii, 2.0)) - _SLACK
            i, j, radii, near = i[fine], j[fine], radii[fine], cosine[i, j][fine]
            whole = (radii > 0) & (np.sqrt(np.maximum(2 - 2 * near, 0)) + radii <= sure)
            i, j = i + part.start, j + other.start
            if same and p is q:
                up = i <= j
                i, j, whole = i[up], j[up], whole[up]
            for m, n, w in zip(i.tolist(), j.tolist(), whole.tolist()):
                if w and ps[m] is not qs[n]:
                    yield ps[m].rows, qs[n].rows, True
                else:
                    stack.append((ps[m], qs[n]))


def _unit(col: pa.Array, dtype: type) -> np.ndarray:
    """Unit vectors of 64-bit numbers from a column of raw vectors of one dimension."""
    n = len(col)
    raw = np.frombuffer(b"".join(col.to_pylist()), dtype).astype(float).reshape(n, -1)
    raw /= np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def vectors(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, type]:
    """``(id, dimension, vector)`` with the vectors' numbers as bytes, without rows that have no direction, and the numbers' type."""
    single = table.schema[vector_col].dataType.elementType.typeName() == "float"
    dtype = np.float32 if single else np.float64

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = lists.value_lengths().to_numpy()
            b, size = b.filter(pa.array(size > 0)), size[size > 0]
            if not len(size):
                continue
            flat = b.column(1).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(dtype)
            ends = np.concatenate(([0], np.cumsum(size)))
            most = np.maximum.reduceat(np.abs(flat), ends[:-1])  # undefined if an element is
            vector = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends * flat.itemsize), pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int32)), vector], ["id", "dimension", "vector"]).filter(pa.array(np.isfinite(most) & (most > 0)))

    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(f"array<{'float' if single else 'double'}>").alias("v"))
    return rows.mapInArrow(raw, "id bigint, dimension int, vector binary").distinct(), dtype


def classes_of(rows: DataFrame) -> DataFrame:
    """A written table ``(class, dimension, vector, n, least)`` of distinct vectors, their rows and smallest ids."""
    counted = rows.groupBy("dimension", "vector").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    return S.written(counted.withColumn("class", F.monotonically_increasing_id()), "vectors")


def _tasks(classes: DataFrame, dtype: type, threshold: float, cell_rows: int, most_centres: int) -> DataFrame:
    """Rows ``(d, low, high, low_block, high_block, first, class, n, dimension, vector)``: what each task compares; ``first`` tells its two sides apart."""
    tau = float(np.sqrt(max(2 - 2 * threshold, 0))) + _SLACK
    spread = F.xxhash64("class")
    counts = classes.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.min_by("vector", F.struct(spread, "class")).alias("v"), F.min(F.struct(spread, "class"))["class"].alias("c")).collect()  # one row a dimension
    share = {r["dimension"]: min(most_centres, r["n"] / cell_rows) / r["n"] for r in counts}
    picked: dict[int, dict[int, bytes]] = {r["dimension"]: {r["c"]: r["v"]} for r in counts}
    wide = [(d, x) for d, x in share.items() if x * cell_rows > 1 or x * most_centres > 1]
    if wide:
        table = F.broadcast(classes.sparkSession.createDataFrame(wide, "dimension int, share double"))
        unit = (F.pmod(spread, F.lit(1 << 31)) / float(1 << 31)).alias("u")
        for r in classes.select("class", "dimension", "vector", unit).join(table, "dimension").where("u < share").select("class", "dimension", "vector").collect():  # about most_centres rows a dimension
            picked[r["dimension"]][r["class"]] = r["vector"]
    centres = {d: _unit(pa.array([v for _, v in sorted(x.items())], pa.binary()), dtype) for d, x in picked.items()}
    names = {d: i for i, d in enumerate(sorted(centres))}

    def cells(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        sizes = b.column("dimension").to_numpy()
        for d in np.unique(sizes).tolist():
            on = np.flatnonzero(sizes == d)
            far = distance(_unit(b.column("vector").take(pa.array(on)), dtype), centres[d])
            yield d, on, far, far.argmin(axis=1)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = {d: np.zeros(len(c)) for d, c in centres.items()}
        rows = {d: np.zeros(len(c), np.int64) for d, c in centres.items()}
        for b in batches:
            for start in range(0, b.num_rows, 2048):
                for d, _, far, own in cells(b.slice(start, 2048)):
                    np.maximum.at(most[d], own, far.min(axis=1))
                    np.add.at(rows[d], own, 1)
        yield pa.RecordBatch.from_pylist([{"d": d, "c": c, "r": float(most[d][c]), "n": int(rows[d][c])} for d in most for c in np.flatnonzero(rows[d]).tolist()], pa.schema([("d", pa.int32()), ("c", pa.int32()), ("r", pa.float64()), ("n", pa.int64())]))

    radii = {d: np.zeros(len(c)) for d, c in centres.items()}
    blocks = {d: np.ones(len(c), np.int64) for d, c in centres.items()}
    for r in classes.mapInArrow(reach, "d int, c int, r double, n bigint").groupBy("d", "c").agg(F.max("r").alias("r"), F.sum("n").alias("n")).collect():  # one row a cell
        radii[r["d"]][r["c"]], blocks[r["d"]][r["c"]] = r["r"], -(-r["n"] // cell_rows)
    apart = {d: distance(c, c) for d, c in centres.items()}

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2048):
                part = b.slice(start, 2048)
                for d, on, far, own in cells(part):
                    least = far.min(axis=1)
                    goes = (far <= radii[d] + tau) & (far - least[:, None] <= 2 * tau) & (apart[d][own] <= radii[d] + radii[d][own][:, None] + tau)
                    goes[np.arange(len(on)), own] = True
                    row, cell = np.nonzero(goes)
                    times = blocks[d][cell]
                    other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row, cell = np.repeat(row, times), np.repeat(cell, times)
                    mine = own[row]
                    block = S.mix(part.column("class").to_numpy()[on].view(np.uint64))[row] % blocks[d][mine].astype(np.uint64)
                    block = block.astype(np.int64)
                    swap = np.where(mine == cell, block > other, mine > cell)
                    first = np.where(mine == cell, block <= other, mine < cell)
                    pair = [np.where(swap, y, x).astype(np.int32) for x, y in ((mine, cell), (cell, mine), (block, other), (other, block))]
                    take = part.take(pa.array(on[row]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), names[d], np.int32)), *map(pa.array, pair), pa.array(first), *take.columns], [*_TASK, "first", "class", "n", "dimension", "vector"])

    return classes.select("class", "n", "dimension", "vector").mapInArrow(visits, "d int, low int, high int, low_block int, high_block int, first boolean, class bigint, n bigint, dimension int, vector binary")


_TASK = ["d", "low", "high", "low_block", "high_block"]


def _sides(part: pa.Table, dtype: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]:
    """Classes, rows and unit vectors of a task, those of the first side first; their number, and whether there is but one side."""
    part = part.combine_chunks()
    first, ids, n = part.column("first").to_numpy(), part.column("class").to_numpy(), part.column("n").to_numpy()
    order = np.lexsort((ids, ~first))
    one = part.column("low")[0] == part.column("high")[0] and part.column("low_block")[0] == part.column("high_block")[0]
    return ids[order], n[order], _unit(part.column("vector").combine_chunks(), dtype)[order], int(first.sum()), one


def _walk(x: np.ndarray, n: int, one: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    tau = float(np.sqrt(max(2 - 2 * threshold, 0))) + _SLACK
    if one:
        tree = cover_tree(x, np.arange(n), 0, 2.0, tau)
        yield from dual(x, tree, tree, threshold)
    elif 0 < n < len(x):
        yield from dual(x, cover_tree(x, np.arange(n), 0, 2.0, tau), cover_tree(x, np.arange(n, len(x)), n, 2.0, tau), threshold)


def near_pairs(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, most_centres: int = MOST_CENTRES) -> DataFrame:
    """``(vec_a, vec_b, similarity)``, ``vec_a < vec_b``: the pairs of different vectors whose cosine is at least ``threshold``, rounded to 6 places. Equal vectors are named by the smallest of their ids, which is an integer here."""
    rows, dtype = vectors(table, id_col=id_col, vector_col=vector_col)
    classes = classes_of(rows)
    tasks = _tasks(classes.withColumn("class", F.col("least")), dtype, threshold, cell_rows, most_centres)

    def compare(part: pa.Table) -> pa.Table:
        ids, _, x, n, one = _sides(part, dtype)
        out = []
        for i, j, whole in _walk(x, n, one, threshold):
            if whole:
                i, j = (k.ravel() for k in np.meshgrid(i, j, indexing="ij")) if not np.array_equal(i, j) else (i[k] for k in np.triu_indices(len(i), 1))
            keep = ids[i] != ids[j]
            i, j = i[keep], j[keep]
            out.append(pa.table({"vec_a": np.minimum(ids[i], ids[j]), "vec_b": np.maximum(ids[i], ids[j]), "similarity": np.round(np.einsum("ij,ij->i", x[i], x[j]), 6)}))
        return pa.concat_tables(out) if out else pa.table({"vec_a": pa.array([], pa.int64()), "vec_b": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})

    return tasks.groupBy(*_TASK).applyInArrow(compare, "vec_a bigint, vec_b bigint, similarity double")


def near_classes(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, most_centres: int = MOST_CENTRES) -> DataFrame:
    """``(vec_id, class_id, links)`` of every vector with a direction: the smallest id of those that are connected with it by cosines of at least ``threshold``, and the number of other rows that are so near to itself."""
    spark = table.sparkSession
    key = S.free_name(table, "_id")
    numbered, names = S.integer_ids(table, id_col, key)
    rows, dtype = vectors(numbered, id_col=key, vector_col=vector_col)
    rows = S.written(rows, "rows")
    classes = classes_of(rows)
    tasks = _tasks(classes, dtype, threshold, cell_rows, most_centres)

    def compare(part: pa.Table) -> pa.Table:
        ids, count, x, n, one = _sides(part, dtype)
        links = np.zeros(len(ids), np.int64)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray, None]]:
            for i, j, whole in _walk(x, n, one, threshold):
                if not whole:
                    np.add.at(links, i, count[j])
                    np.add.at(links, j, count[i])
                    yield i, j, None
                elif np.array_equal(i, j):
                    links[i] += count[i].sum() - count[i]
                    yield np.repeat(i[:1], len(i)), i, None
                else:
                    links[i] += count[j].sum()
                    links[j] += count[i].sum()
                    yield np.repeat(i[:1], len(j)), j, None
                    yield i, np.repeat(j[:1], len(i)), None

        i, j = _connect(pairs(), len(ids))
        on = np.flatnonzero(links)
        none = pa.nulls(len(i), pa.int64())
        return pa.table({"id_a": pa.chunked_array([pa.array(ids[i]), pa.array(ids[on])]), "id_b": pa.chunked_array([pa.array(ids[j]), pa.nulls(len(on), pa.int64())]), "links": pa.chunked_array([none, pa.array(links[on])])})

    found = S.written(tasks.groupBy(*_TASK).applyInArrow(compare, "id_a bigint, id_b bigint, links bigint"), "links")
    roots = components(found.where("links is null").select("id_a", "id_b").distinct())
    links = found.where("links is not null").groupBy(F.col("id_a").alias("class")).agg(F.sum("links").alias("links"))
    named = classes.join(roots.select(F.col("id").alias("class"), "root"), "class", "left").join(links, "class", "left")
    named = named.select("dimension", "vector", "n", "least", F.coalesce("root", "class").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    least = named.groupBy("root").agg(F.min("least").alias("root_id"))
    groups = S.written(named.join(least, "root").select("dimension", "vector", "n", "root_id", "links"), "groups")
    out = S.written(members(rows, groups, ["dimension", "vector"], ["vector"]).select("id", F.col("root_id").alias("root"), "links"), "near-vectors")
    S.drop_written(spark, rows, classes, found, roots, groups)
    if names is not None:
        for column in ("id", "root"):
            out = out.join(names.select(F.col(key).alias(column), F.col("id").alias("_" + column)), column).drop(column).withColumnRenamed("_" + column, column)
    return out.select(F.col("id").alias(id_col), F.col("root").alias("class_id"), "links")
