"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

A document is described by ``STATISTICS`` (shares of byte classes, word lengths,
repetition). Cosines of random projections of the standardized statistics
approximate a Gaussian kernel (Rahimi and Recht, 2007). Each partition of the
labelled rows sums its own normal equations; the driver adds those matrices,
whose size depends on ``features`` alone, and solves for ridge weights. Pool
adjacent violators on held-out labelled rows turns scores into probabilities.

Fitting uses at most ``fit_rows`` labelled documents, those with the smallest
hashes of their ids. Scoring is one narrow pass over all documents and all of
each text; only the fitted constants are sent along.

Cases: a null text counts as empty; its score is that of an empty text. A null
id is scored like any other and can't be labelled. Repeated rows are scored
alike, each for itself, and each counts where it is fitted on. Labels that are null are ignored, several labels of one
document are averaged. With no labels, or one class only, the probability is
the mean label (1 without labels) and the score 0. Tables without rows give
tables without rows. Where a column of the input has the name of an output
column, the output column gets underscores at its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm import _shared as S

STATISTICS = (
    "log_bytes", "log_words", "upper", "lower", "digit", "space", "newline", "stop", "comma", "symbol", "other_ascii", "beyond_ascii",
    "word_mean", "word_deviation", "word_longest", "short_words", "long_words", "distinct_words", "adjacent_repeats", "words_ending_in_mark", "capital_starts", "bytes_per_line",
)

_CLASS = np.full(256, 8, np.int64)
_CLASS[ord("A") : ord("Z") + 1] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[ord(" "), ord("\t")]] = 3
_CLASS[[ord("\n"), ord("\r")]] = 4
_CLASS[[ord(c) for c in ".?"]] = 5
_CLASS[[ord(c) for c in ",;:'\"-"]] = 6
_CLASS[[ord(c) for c in "!#$%&*@^~|<>=+_/\\[]{}`"]] = 7
_CLASS[128:] = 9


def document_statistics(col: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    w = S.Words(col)
    docs = len(w.offsets) - 1
    size = np.diff(w.offsets).astype(float)
    one = np.maximum(size, 1)
    counts = np.zeros((docs, 10))
    if len(w.data):
        key = np.repeat(np.arange(docs) * 10, np.diff(w.offsets)) + _CLASS[w.data]
        counts = np.bincount(key, minlength=docs * 10).reshape(docs, 10).astype(float)
    words = np.diff(w.first).astype(float)
    per = np.maximum(words, 1)
    length = (w.end - w.start).astype(float)

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, weights=x, minlength=docs)

    mean = total(length) / per
    longest = np.zeros(docs)
    np.maximum.at(longest, w.doc, length)
    distinct = np.zeros(docs)
    if len(w.doc):
        keys = np.sort((w.doc.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        distinct = np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=docs).astype(float)
    same = np.zeros(len(w.doc))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    ending = w.data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    starting = w.data[w.start] if len(w.start) else np.zeros(0, np.uint8)
    share = counts / one[:, None]
    columns = [
        np.log1p(size), np.log1p(words), *share[:, :10].T,
        mean, np.sqrt(np.maximum(total(length**2) / per - mean**2, 0)), np.log1p(longest), total(length <= 3) / per, total(length >= 16) / per,
        distinct / np.sqrt(per), total(same) / per, total(_CLASS[ending] == 7) / per, total(_CLASS[starting] == 0) / per, np.log1p(size / (1 + counts[:, 4])),
    ]
    return np.column_stack(columns)


@dataclass(frozen=True)
class QualityModel:
    """Fitted constants: ``cos(z @ directions + phases) @ weights``, then a step function."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    bias: float
    knots: np.ndarray
    values: np.ndarray

    def score(self, statistics: np.ndarray) -> np.ndarray:
        z = np.clip((statistics - self.mean) / self.scale, -8, 8)
        return np.cos(z @ self.directions + self.phases) @ self.weights + self.bias

    def probability(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.knots, self.values)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the monotone fit of label on score (pool adjacent violators; equal scores are one point)."""
    order = np.argsort(score, kind="stable")
    x, first, weight = np.unique(score[order], return_index=True, return_counts=True)
    y = np.add.reduceat(label[order].astype(float), first) / weight
    blocks: list[list[float]] = []  # value, weight, first x, last x
    for xi, yi, wi in zip(x, y, weight):
        blocks.append([yi, float(wi), xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, _, hi = blocks.pop()
            b = blocks[-1]
            b[0] = (b[0] * b[1] + v * n) / (b[1] + n)
            b[1] += n
            b[3] = hi
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    return knots, np.repeat([b[0] for b in blocks], 2)


def normal_equations(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.T @ x, x.T @ y


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fit_rows: int = 20_000,
    features: int = 256,
    bandwidth: float = 1.0,
    ridge: float = 1e-3,
    seed: int = 7,
) -> QualityModel:
    """Fit on at most ``fit_rows`` labelled documents; ``bandwidth`` is in units of the square root of the number of statistics."""
    d = len(STATISTICS)
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(d, features)) / (bandwidth * np.sqrt(d))
    phases = rng.uniform(0, 2 * np.pi, features)
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("k"))
        .agg(F.avg(F.col(label_col).cast("double")).alias("y"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(fit_rows)
    )
    matched = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "k")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.slices(batches, "t"):
            x = document_statistics(b.column(b.schema.get_field_index("t")))
            held = pa.compute.bit_wise_and(b.column(b.schema.get_field_index("h")), 3)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), b.column(b.schema.get_field_index("y")), held], ["x", "y", "h"])

    described = S.written(matched.select("t", "y", F.xxhash64("k", F.lit(seed)).alias("h")).mapInArrow(describe, "x array<double>, y double, h bigint").repartition(-(-fit_rows // 2_500)), "quality-fit")
    sums = described.select(F.count("y").alias("n"), F.avg("y").alias("y"), F.min("y").alias("low"), F.max("y").alias("high"), *[f(F.col("x")[i]).alias(f"{name}{i}") for i in range(d) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    base = 1.0 if not sums["n"] else sums["y"]
    blank = (np.zeros(d), np.ones(d), directions, phases, np.zeros(features), 0.0, np.array([0.0]), np.array([base]))
    if not sums["n"] or sums["low"] == sums["high"]:
        S.drop_written(docs.sparkSession, described)
        return QualityModel(*blank)
    mean = np.array([sums[f"m{i}"] for i in range(d)])
    scale = np.maximum(np.array([sums[f"s{i}"] for i in range(d)]), 1e-6)
    model = QualityModel(mean, scale, directions, phases, *blank[4:])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for b in batches:
            b = b.filter(pa.compute.not_equal(b.column(2), 0))
            x = np.array(b.column(0).to_pylist()).reshape(-1, d)
            z = np.cos(np.clip((x - mean) / scale, -8, 8) @ directions + phases)
            more = normal_equations(np.column_stack([z, np.ones(len(z))]), b.column(1).to_numpy())
            a, c = a + more[0], c + more[1]
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([c.tobytes()])], ["a", "c"])

    a, c = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
    for row in described.mapInArrow(partial, "a binary, c binary").toLocalIterator():
        a += np.frombuffer(row["a"]).reshape(a.shape)
        c += np.frombuffer(row["c"])
    penalty = np.eye(features + 1) * ridge * max(sums["n"], 1)
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(a + penalty, c)
    model = QualityModel(mean, scale, directions, phases, solved[:-1], float(solved[-1]), *blank[6:])

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.compute.equal(b.column(2), 0))
            yield pa.RecordBatch.from_arrays([pa.array(model.score(np.array(b.column(0).to_pylist()).reshape(-1, d))), b.column(1)], ["s", "y"])

    rest = described.mapInArrow(held_out, "s double, y double").toPandas()  # fit_rows / 4 rows of two numbers
    if len(rest) == 0:
        rest = rest.reindex([0]).fillna(base)
    knots, values = isotonic(rest["s"].to_numpy(), rest["y"].to_numpy())
    S.drop_written(docs.sparkSession, described)
    return QualityModel(*blank[:0], mean, scale, directions, phases, model.weights, model.bias, knots, values)


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """Add ``score``, ``probability`` and ``keep`` (probability at least ``threshold``) to ``columns`` (all by default)."""
    columns = docs.columns if columns is None else columns
    out = docs.select(*columns)
    names = [S.free_name(out, n) for n in ("score", "probability", "keep")]
    text = S.free_name(docs, "text_to_score")
    schema = T.StructType(list(out.schema.fields) + [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.slices(batches, text):
            s = model.score(document_statistics(b.column(b.num_columns - 1)))
            p = model.probability(s)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array(p), pa.array(p >= threshold)], [*b.schema.names[:-1], *names])

    return docs.select(*columns, F.col(text_col).alias(text)).mapInArrow(score, schema)


def keep_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose probability is at least ``threshold``, with their columns."""
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.slices(batches, text_col):
            yield b.filter(pa.array(model.probability(model.score(document_statistics(b.column(at)))) >= threshold))

    return docs.mapInArrow(kept, docs.schema)
