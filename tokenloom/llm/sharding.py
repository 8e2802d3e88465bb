"""Sharding by histogram sort: exact byte counts below probes, refined until splitters fit, then one exchange.

Shards are ranges of a key with about equal bytes. A round sends a set of
candidate boundaries ("probes") to all partitions; each counts the exact bytes up
to each probe, the counts are added, and every splitter's interval shrinks to
what lies between the two probes around its target (Kale and Krishnan, 1993;
Solomonik and Kale, 2010). Rounds end when every splitter's bytes are within
``tolerance`` of its target, or its interval has one key, so the number of
rounds depends on the key's range, not on the rows. Rows move once, to the
partition of their shard, and are sorted there.

The rounds read a table of keys and sizes alone, summed by key. A round has at
most ``MOST_PROBES`` probes, or two for each splitter where those are more: the
more shards, the less probes each and the more rounds.

Cases: keys are integers of any size, or of another type with an order; those
are numbered in their order first. Rows of one key stay together, so a key with
more bytes than a shard makes a large shard. A null key sorts first, in shard 0.
A null or empty text has no bytes. Repeated rows count each. Columns keep their
names; the shard's gets underscores where it would clash. Empty tables give
empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import _shared as S

SHARD_BYTES = 64 << 20
LEAST_SHARDS = 16
PROBES = 32
MOST_PROBES = 1 << 20
_SIGN = np.uint64(1 << 63)


def _unsigned(keys: np.ndarray) -> np.ndarray:
    """Long keys as unsigned ones, in the same order."""
    return keys.astype(np.int64).view(np.uint64) ^ _SIGN


def splitters(weights: DataFrame, shards: int, *, tolerance: float = 0.0, probes: int = PROBES) -> np.ndarray:
    """Last keys of all but the last of ``shards`` ranges of ``(key, bytes)``: a key belongs to shard i if i of them are less than it.

    Splitter i is the least c with ``bytes of keys up to c >= i * total / shards``
    if ``tolerance`` is 0, else one whose bytes differ from that by at most
    ``tolerance`` shards where the keys allow it.
    """
    ends = weights.agg(F.min("key"), F.max("key"), F.sum("bytes")).first()
    if ends[0] is None or not ends[2] or shards < 2:
        return np.zeros(0, np.int64)
    total = int(ends[2])
    target = np.array([-(-i * total // shards) for i in range(1, shards)], np.int64)
    allowed = tolerance * total / shards
    low, high = (np.full(shards - 1, x, np.uint64) for x in _unsigned(np.array([ends[0], ends[1]], np.int64)))
    probes = max(2, min(probes, MOST_PROBES // shards))
    while (low < high).any():
        lo, gap = np.unique(np.stack([low, high - low], axis=1)[low < high], axis=0).T
        part, rest, j = gap // np.uint64(probes), gap % np.uint64(probes), np.arange(probes, dtype=np.uint64)
        at = np.unique(lo[:, None] + part[:, None] * j + rest[:, None] * j // np.uint64(probes))

        def count(batches: Iterator[pa.RecordBatch], at: np.ndarray = at) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(at) + 1, np.int64)
            for b in batches:
                np.add.at(sums, np.searchsorted(at, _unsigned(b.column(0).to_numpy()), "left"), b.column(1).to_numpy())
            on = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(sums[on])], ["place", "bytes"])

        counted = weights.select("key", "bytes").mapInArrow(count, "place bigint, bytes bigint").groupBy("place").agg(F.sum("bytes").alias("bytes")).toArrow()  # at most as many rows as probes
        parts = np.zeros(len(at) + 1, np.int64)
        parts[counted.column("place").to_numpy()] = counted.column("bytes").to_numpy()
        upto = np.cumsum(parts)[:-1]
        reach = np.searchsorted(upto, target, "left")  # the first probe that reaches the target
        some = reach < len(at)
        high[some] = np.minimum(high[some], at[reach[some]])
        some = reach > 0
        low[some] = np.maximum(low[some], at[reach[some] - 1] + np.uint64(1))
        if allowed:
            for place in (np.maximum(reach - 1, 0), np.minimum(reach, len(at) - 1)):
                near = (np.abs(upto[place] - target) <= allowed) & (low < high)
                low[near] = high[near] = at[place[near]]
    return (high ^ _SIGN).view(np.int64)


def shard(
    docs: DataFrame,
    *,
    key_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
    least_shards: int = LEAST_SHARDS,
    shards: int | None = None,
    tolerance: float = 0.0,
    shard_col: str = "shard",
    columns: list[str] | None = None,
) -> DataFrame:
    """``columns`` of ``docs`` (all by default) and the shard of each row; partition i holds shard i, sorted by key."""
    columns = docs.columns if columns is None else columns
    spark = docs.sparkSession
    name = S.free_name(docs.select(*columns), shard_col)
    key = S.free_name(docs, "_key")
    numbered, names = S.integer_ids(docs, key_col, key)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
    weights = S.written(numbered.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.sum(size).alias("bytes")), "weights")
    if shards is None:
        total = weights.agg(F.sum("bytes")).first()[0] or 0
        shards = max(least_shards, -(-total // shard_bytes))
    last = splitters(weights, shards, tolerance=tolerance)
    S.drop_written(spark, weights)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(last, keys.to_numpy(np.int64), "left").astype(np.int32))

    # a batch with a null would come as floats
    in_shard = F.when(F.col(key).isNull(), F.lit(0)).otherwise(place(F.coalesce(F.col(key), F.lit(0).cast("bigint"))))
    sort = [F.col(key).asc_nulls_first()]
    placed = numbered.select(*columns, key, in_shard.alias(name))
    return placed.repartitionById(max(shards, 1), F.col(name)).sortWithinPartitions(*sort).select(*columns, name)
