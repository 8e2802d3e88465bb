"""Helpers of the operators: Arrow slices, word hashes, shared checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that separate words; the same set is written as a regex for SQL.
SPACES = b" \t\n\r\f\v"
SPACE_RE = r"[ \t\n\r\f\v]+"
BATCH_BYTES = 4 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True

#: Paths of tables that weren't deleted yet.
_paths: dict[str, SparkSession] = {}

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for tables that all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the master is this process alone, as in local
    tests, a folder of this machine is set. Elsewhere an unset folder is an error.
    """
    sc = spark.sparkContext
    have = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if have is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="tokenloom-")
        sc.setCheckpointDir(have)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(have)
    return str(have)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder; :func:`clean` deletes what is there."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_clean_at_exit)
    _paths[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives executors.

    Operators drop such tables as soon as nothing reads them any longer. Those
    that a returned DataFrame reads stay until :func:`clean` or the end of the
    driver's Python process.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(conf).delete(there, True)


def drop_written(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any longer."""
    for table in tables:
        _paths.pop(table._written_at, None)
        _delete(spark, table._written_at)


def clean(spark: SparkSession) -> None:
    """Delete all that the operators keep in the shared folder; results that weren't used yet can't be read afterwards."""
    while _paths:
        _delete(spark, _paths.popitem()[0])


def _clean_at_exit() -> None:
    for path, spark in list(_paths.items()):
        with contextlib.suppress(Exception):  # the session may have been stopped
            _delete(spark, path)


def bytes_of(df: DataFrame, *columns: str) -> tuple[int, int]:
    """Rows of a table, and about the bytes that they take in memory: ``columns`` of texts or bytes as they are, 64 for the rest of a row."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in columns), F.lit(64).cast("bigint"))
    n, total = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return n, total or 0


def integer_ids(docs: DataFrame, id_col: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a bigint column ``name`` in the order of ``id_col``, null where that is.

    Integers are taken as they are. Ids of other types are numbered in their
    order; the numbers' table ``(name, id)`` is written and comes second.
    """
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return docs.withColumn(name, F.col(id_col).cast("bigint")), None
    distinct = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    names = written(distinct.orderBy("id").select(F.monotonically_increasing_id().alias(name), "id"), "ids")
    return docs.join(names.withColumnRenamed("id", "_id_" + name), docs[id_col] == F.col("_id_" + name), "left").drop("_id_" + name), names


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (case ignored)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_batches(spark: SparkSession) -> None:
    """Limit what goes to Python at once to ``BATCH_BYTES``, where the session leaves Spark's default of 64 MB.

    This is for applications, such as the registered queries and the pipeline;
    operators leave the session's settings alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB", "64m"):
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system; idle Python workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str | Callable[[pa.RecordBatch], pa.Array], limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has about ``limit`` bytes in each (one row at least)."""
    try:
        yield from _slices(batches, column, limit)
    finally:
        give_back()


def _slices(batches: Iterator[pa.RecordBatch], column: str | Callable[[pa.RecordBatch], pa.Array], limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)) if isinstance(column, str) else column(batch))
        at, n = 0, batch.num_rows
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, min(end, n) - at)
            at = min(end, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        made = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers = (made[0], made[1])
    return _powers


class Words:
    """Words of a batch of texts: ``start``, ``end`` (bytes in the batch), ``doc``, ``hash``; ``first[d]:first[d+1]`` are document d's."""

    def __init__(self, col: pa.Array, with_hash: bool = True):
        self.data, self.offsets = text_buffers(col)
        data, n = self.data, len(self.data)
        docs = len(self.offsets) - 1
        space = np.ones(n + 1, bool)
        space[1:] = _IS_SPACE[data]
        begins = np.zeros(n + 1, bool)
        begins[self.offsets] = True
        word = ~space[1:]
        self.start = np.flatnonzero(word & (space[:-1] | begins[:-1]))
        last = np.ones(n, bool)
        last[:-1] = space[2:] | begins[1:-1] if n > 1 else last[:-1]
        self.end = np.flatnonzero(word & last) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(docs), np.diff(self.first))
        if with_hash:
            power, inverse = _power_tables(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])
