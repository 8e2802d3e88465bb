"""BPE encoding and decoding of text columns, with tree concatenation of long texts.

Texts up to ``LONG`` characters are encoded where they are, whole, in one narrow
pass. A longer text becomes leaves that are spread over the cluster and encoded
in parallel, then put together:

* Where an ASCII letter or digit is followed by a space or a line feed, the
  splitting pattern always begins a new piece; leaves that end there need no
  repair.
* A run of text without such a place is split by the pattern itself. A piece of
  more than ``RAW`` bytes, long unsplit text, is halved until the parts are
  small enough. The parts are encoded in parallel and joined pairwise up the
  tree. At each join, the last k tokens of the left and the first k of the right
  are encoded again as one, k doubling until the new tokens begin and end with
  the same tokens as the window did, or the window has reached an end. A
  sequence of tokens is the encoding of its bytes exactly if every pair of
  neighbours is the encoding of their bytes (Berglund and van der Merwe, 2023),
  so agreement on both sides makes the join exact.

The vocabulary is a rank file whose path is a parameter; every Python worker
reads it once.

Cases: a null text has null tokens, an empty text an empty list; both decode to
themselves. Ids that the vocabulary lacks and null elements decode to nothing;
bytes that aren't UTF-8 decode to U+FFFD. Rows aren't compared, so repeated and
null ids, ties and extra columns don't matter; where a column of the input has
the output's name, the output gets underscores at its end. Empty tables give
empty tables.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm import _shared as S

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters up to which a text is encoded whole; also the size of a leaf.
LONG = 65_536
#: Bytes up to which an unsplit piece is encoded whole.
RAW = 16_384

_SAFE = regex.compile(r"[A-Za-z0-9](?=[ \n])")
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TEXT, PIECES, PART = 0, 1, 2


class Vocabulary:
    """Ranks, the byte strings of ids, and encoders of pieces and texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pattern = ranks, pattern
        self.pieces = regex.compile(pattern.replace(r"[^\s", "[^" + _WHITE).replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]"))
        size = max(ranks.values(), default=-1) + 1
        self.bytes = [b""] * size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.lengths = np.append(lengths, 0)  # the last stands for unknown ids
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)

    @functools.cached_property
    def encoding(self) -> tiktoken.Encoding:
        """Built when first used: workers that only decode need none."""
        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def text(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def piece(self, piece: bytes) -> list[int]:
        return self.encoding._encode_single_piece(piece)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the left's and right's bytes together; both are encodings of theirs."""
        if not left or not right:
            return left + right
        k = 4
        while True:
            l, r = left[-k:], right[:k]
            middle = self.piece(b"".join([self.bytes[t] for t in l + r]))
            if (k >= len(left) or middle[0] == l[0]) and (k >= len(right) or middle[-1] == r[-1]):
                return left[: len(left) - len(l)] + middle + right[len(r) :]
            k *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Join neighbours until one encoding is left."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and byte offsets of lists of ids (flat ``ids``, ``offsets`` of the lists)."""
        ids = np.where((ids < 0) | (ids >= len(self.bytes)), len(self.bytes), ids)
        lengths = self.lengths[ids]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        take = np.repeat(self.starts[ids] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.blob[take], ends[offsets]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
    """Read a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
    return Vocabulary(ranks, pattern)


def halves(piece: bytes, raw: int) -> list[bytes]:
    """The leaves of halving until none has more than ``raw`` bytes."""
    if len(piece) <= raw:
        return [piece]
    middle = len(piece) // 2
    return halves(piece[:middle], raw) + halves(piece[middle:], raw)


def leaves(text: str, vocab: Vocabulary, leaf: int, raw: int) -> Iterator[tuple[int, bool, list[bytes]]]:
    """``(kind, whether it goes on the piece before, contents)`` of the leaves of a text, in order."""
    at = 0
    while at < len(text):
        found = _SAFE.search(text, at + leaf - 1) if len(text) - at > leaf else None
        cut = found.end() if found else len(text)
        if cut - at <= 2 * leaf:
            yield TEXT, False, [text[at:cut].encode("utf-8", "replace")]
        else:
            held: list[bytes] = []
            size = 0
            for match in vocab.pieces.finditer(text, at, cut):
                piece = match.group().encode("utf-8", "replace")
                if len(piece) > raw:
                    if held:
                        yield PIECES, False, held
                    held, size = [], 0
                    for i, part in enumerate(halves(piece, raw)):
                        yield PART, i > 0, [part]
                else:
                    held.append(piece)
                    size += len(piece)
                    if size > leaf:
                        yield PIECES, False, held
                        held, size = [], 0
            if held:
                yield PIECES, False, held
        at = cut


def _id_lists(rows: list[list[int] | None]) -> pa.Array:
    sizes = np.array([-1 if r is None else len(r) for r in rows])
    offsets = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0)))).astype(np.int32)
    flat = np.fromiter((t for r in rows if r for t in r), np.int32, int(offsets[-1]))
    mask = pa.array(sizes < 0) if (sizes < 0).any() else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=mask)


def encode_bpe(
    docs: DataFrame, *, text_col: str = "text", out_col: str = "token_ids", columns: list[str] | None = None, vocabulary_path: str = VOCABULARY, pattern: str = PATTERN, long: int = LONG, raw: int = RAW
) -> DataFrame:
    """``columns`` of ``docs`` (all by default) and the token ids of each text."""
    columns = docs.columns if columns is None else columns
    kept = docs.select(*columns)
    out_name = S.free_name(kept, out_col)
    at = columns.index(text_col) + 1 if text_col in columns else None  # a text that is kept travels once
    row = F.struct(F.lit(0).alias("c"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("row")
    source = docs.select(row) if at else docs.select(row, F.col(text_col).alias("text"))
    text = F.col("row")[f"c{at - 1}"] if at else F.col("text")
    row_type = source.schema["row"].dataType

    def texts_of(b: pa.RecordBatch) -> pa.Array:
        return pa.compute.struct_field(b.column("row"), [at]) if at else b.column("text")

    encoded = T.StructType([T.StructField("row", row_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path, pattern)
        for b in S.slices(batches, texts_of):
            ids = _id_lists([None if t is None else vocab.text(t) for t in texts_of(b).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["row", "ids"])

    short = source.where(text.isNull() | (F.length(text) <= long)).mapInArrow(whole, encoded)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path, pattern)
        for b in batches:
            for i, text in enumerate(texts_of(b).to_pylist()):
                found = list(leaves(text, vocab, long, raw))
                n = len(found)
                first = pa.array([True] + [False] * (n - 1))
                row = pa.compute.if_else(first, b.column(1).slice(i, 1).take(pa.array([0] * n)), pa.nulls(n, b.schema.field(1).type))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1).take(pa.array([0] * n)), row, pa.array(range(n), pa.int32()), pa.array([k for k, _, _ in found], pa.int32()), pa.array([g for _, g, _ in found]), pa.array([c for _, _, c in found], pa.list_(pa.binary()))],
                    ["doc", "row", "leaf", "kind", "goes_on", "contents"],
                )

    leaf_type = T.StructType([T.StructField("doc", T.LongType()), T.StructField("row", row_type), T.StructField("leaf", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("goes_on", T.BooleanType())])
    tall = source.where(F.length(text) > long).select(F.monotonically_increasing_id().alias("doc"), *source.columns)
    # written, so that the numbers stay as they are if a task is run again
    spread = S.written(tall.mapInArrow(split, T.StructType(leaf_type.fields + [T.StructField("contents", T.ArrayType(T.BinaryType()))])), "leaves").repartition("doc", "leaf")

    def leaf_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path, pattern)
        for b in batches:
            made = []
            for kind, contents in zip(b.column(3).to_pylist(), b.column(5).to_pylist()):
                made.append(vocab.text(contents[0].decode("utf-8")) if kind == TEXT else [t for c in contents for t in vocab.piece(c)])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], _id_lists(made)], [*b.schema.names[:5], "ids"])

    def together(table: pa.Table) -> pa.Table:
        vocab = vocabulary(vocabulary_path, pattern)
        table = table.sort_by("leaf")
        runs: list[list[list[int]]] = []
        for goes_on, ids in zip(table.column("goes_on").to_pylist(), table.column("ids").to_pylist()):
            if goes_on:
                runs[-1].append(ids)
            else:
                runs.append([ids])
        tokens = [t for run in runs for t in vocab.tree(run)]
        return pa.table([table.column("row").slice(0, 1), pa.chunked_array([_id_lists([tokens])])], ["row", "ids"])

    encoded_leaves = spread.mapInArrow(leaf_ids, T.StructType(leaf_type.fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    joined = encoded_leaves.groupBy("doc").applyInArrow(together, encoded)
    return short.unionByName(joined).select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(columns)], F.col("ids").alias(out_name))


def decode_bpe(tokens: DataFrame, *, ids_col: str = "token_ids", out_col: str = "decoded", vocabulary_path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """All columns of ``tokens`` and the text of each list of ids."""
    out_name = S.free_name(tokens, out_col)
    at = tokens.columns.index(ids_col)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                lists = b.column(at)
                flat = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
                sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
                data, ends = vocab.decode_batch(flat, np.concatenate(([0], np.cumsum(sizes))))
                null = lists.is_null().to_numpy(zero_copy_only=False)
                raw = data.tobytes()
                out = pa.array([None if no else raw[i:j].decode("utf-8", "replace") for no, i, j in zip(null, ends[:-1], ends[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, out_name])

    return tokens.mapInArrow(texts, T.StructType(tokens.schema.fields + [T.StructField(out_name, T.StringType())]))
