"""Batches of texts to flat arrays of tokens, and small tables over all cores."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tokenloom.operators.encoding import EncodingRow, pad_target, truncate_pair

if TYPE_CHECKING:
    from tokenloom.operators.models import Model
    from tokenloom.plans.tokenizer import Tokenizer

#: Bytes a core up to which a table is small; scans of larger ones fill the cores by themselves.
SMALL = 32 << 20
CACHED_WORDS = 200_000
CACHED_CHARS = 4 << 20
KINDS = {"offsets": pa.struct([("start", pa.int32()), ("end", pa.int32())]), "ids": pa.int64(), "tokens": pa.string()}


def spread(df: DataFrame, small: int = SMALL) -> DataFrame:
    """A small table in as many partitions as there are cores: a file of one row group would be read, and worked on, by one.

    Larger tables, by the size that the scan's plan states, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * small else df


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores added until no column has it (case ignored)."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name += "_"
    return name


class _Numbers(dict):
    """Numbers of keys in the order in which they are met."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class WordTable:
    """Tokens of the words met so far, in flat arrays, by the words' numbers."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.numbers, self.names = _Numbers(), _Numbers()
        self.starts, self.ids, self.begins, self.ends, self.values = array("q", [0]), array("q"), array("i"), array("i"), array("i")
        self.chars = 0

    def _add(self, words: list[str]) -> None:
        made = self.model.tokens_many(words)
        names = np.fromiter(map(self.names.__getitem__, made.names), np.int64, len(made.names))
        self.starts.frombytes((np.cumsum(made.sizes) + len(self.ids)).astype(np.int64).tobytes())
        self.ids.frombytes(made.ids.astype(np.int64).tobytes())
        for kept, new in ((self.begins, made.starts), (self.ends, made.ends), (self.values, names[made.values])):
            kept.frombytes(new.astype(np.int32).tobytes())
        self.chars += sum(map(len, words))

    def look_up(self, words: Iterable[str]) -> np.ndarray:
        """Numbers of the words, of which new ones go to the model together; those met in earlier batches are forgotten once they are too many."""
        if len(self.numbers) > CACHED_WORDS or self.chars > CACHED_CHARS:
            self.clear()
        known = len(self.numbers)
        try:
            found = np.fromiter(map(self.numbers.__getitem__, words), np.int64)
            if len(self.numbers) > known:
                self._add(list(islice(self.numbers, known, None)))
        except BaseException:
            self.clear()
            raise
        return found

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the flat arrays of all tokens of the words, and each word's number of tokens."""
        starts = np.array(self.starts)
        sizes = np.diff(starts)[numbers]
        before = np.cumsum(sizes) - sizes
        return np.repeat(starts[numbers] - before, sizes) + np.arange(int(sizes.sum())), sizes


def offsets_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def lists(offsets: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.Array:
    """A list array; ``null`` marks rows that are null (and empty)."""
    mask = pa.array(null) if null is not None and null.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=mask)


def flat_ids(tok: Tokenizer, texts: list[str | None]) -> pa.Array:
    """Ids of texts, for tokenizers whose :attr:`plain` is set."""
    null = np.array([t is None for t in texts], bool)
    pieces, counts, _ = tok.pre_tokenizer.parts(_normal(tok, texts))
    table = tok.table
    place, sizes = table.take(table.look_up(pieces))
    return lists(offsets_of(sizes)[offsets_of(counts)], pa.array(np.array(table.ids)[place]), null)


def _normal(tok: Tokenizer, texts: list[str | None]) -> list[str]:
    return ["" if t is None else tok.normalizer(t) if tok.normalizer else t for t in texts]


def flat_encodings(tok: Tokenizer, texts: list[str | None], fields: tuple[str, ...], unit: str) -> pa.Array:
    """Encodings of single texts with true places, for tokenizers whose :attr:`direct` is set, as structs of ``fields``."""
    null = np.array([t is None for t in texts], bool)
    table, placed = tok.table, tok.model.whole and not {"ids", "tokens"} & set(fields)
    if placed:  # every piece is a token, whichever word it is: none becomes a string or is kept
        _, begins, stops, words, firsts = tok.pre_tokenizer.places(_normal(tok, texts))
        before = np.repeat(firsts[:-1], words)
        ends, n = offsets_of(words), len(begins)
    else:
        pieces, words, begins = tok.pre_tokenizer.parts(_normal(tok, texts), places=True)
        place, sizes = table.take(table.look_up(pieces))
        ends, n = offsets_of(sizes)[offsets_of(words)], len(place)

    def word_ids() -> pa.Array:
        each = np.arange(len(begins)) - np.repeat(offsets_of(words)[:-1], words)
        return pa.array((each if placed else np.repeat(each, sizes)).astype(np.int32))

    made: dict[str, Callable[[], pa.Array]] = {
        "ids": lambda: pa.array(np.array(table.ids)[place]),
        "tokens": lambda: pa.array(list(table.names), pa.string()).take(pa.array(np.array(table.values)[place])),
        "word_ids": word_ids,
        "type_ids": lambda: pa.array(np.zeros(n, np.int32)),
        "special_tokens_mask": lambda: pa.array(np.zeros(n, np.int32)),
        "attention_mask": lambda: pa.array(np.ones(n, np.int32)),
        "sequence_ids": lambda: pa.array(np.zeros(n, np.int32)),
    }

    def offsets() -> pa.Array:
        if unit == "none":
            return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int32))] * 2, ["start", "end"])
        found = [x - before for x in (begins, stops)] if placed else [np.repeat(begins, sizes) + np.array(x)[place] for x in (table.begins, table.ends)]
        if unit == "byte":
            # where each code point begins, all texts one after the other
            data = np.frombuffer("".join(t or "" for t in texts).encode("utf-8", "surrogatepass"), np.uint8)
            starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            first = offsets_of(np.fromiter((len(t or "") for t in texts), np.int64, len(texts)))
            row = np.repeat(np.arange(len(texts)), np.diff(ends))
            found = [starts[first[row] + x] - starts[first[row]] for x in found]
        return pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in found], ["start", "end"])

    made["offsets"] = offsets
    return pa.StructArray.from_arrays([lists(ends, made[f]()) for f in fields], list(fields), mask=pa.array(null))


def as_structs(rows: list[EncodingRow | None], fields: tuple[str, ...]) -> pa.Array:
    """Encodings as structs of ``fields``, built from flat lists."""
    null = np.array([r is None for r in rows], bool)
    ends = offsets_of(np.fromiter((0 if r is None else len(r) for r in rows), np.int64, len(rows)))
    kept = [r for r in rows if r is not None]

    def flat(name: str) -> pa.Array:
        values = chain.from_iterable(getattr(r, name) for r in kept)
        if name == "offsets":
            pairs = np.fromiter(chain.from_iterable(values), np.int32).reshape(-1, 2)
            return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["start", "end"])
        return pa.array(list(values), KINDS.get(name, pa.int32()))

    return pa.StructArray.from_arrays([lists(ends, flat(f)) for f in fields], list(fields), mask=pa.array(null))


#: Fields that :func:`pair_windows` gives.
PAIR_FIELDS = ("ids", "type_ids", "special_tokens_mask", "attention_mask")


def pair_windows(tok: Tokenizer, text: str, pair: str | None, most: int = 1 << 12) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Sizes and values of all windows of a text, or a pair, between BERT's special tokens, up to ``most`` windows at a time.

    Windows of a pair are all combinations of those of its parts: each part's
    are made once, and combinations are gathered from them.
    """
    post, cut, pad = tok.post_processor, tok.truncation, tok.padding
    first, second = EncodingRow(tok.sequence_ids(text)), EncodingRow(tok.sequence_ids(pair)) if pair else None
    if cut:
        first, second = truncate_pair(first, second, cut.max_length - post.added(second is not None), cut.stride, cut.strategy, cut.direction)
    firsts = [[post.cls[1], *w.ids, post.sep[1]] for w in [first, *first.overflow]]
    seconds = [[]] if second is None else [[*w.ids, post.sep[1]] for w in [second, *second.overflow]]
    m, n = len(firsts), len(seconds)
    pool = np.fromiter(chain.from_iterable(firsts + seconds), np.int64)
    sizes = np.fromiter(map(len, firsts + seconds), np.int64)
    starts, special = np.cumsum(sizes) - sizes, np.zeros(len(pool), np.int32)
    special[starts[:m]] = 1
    special[(starts + sizes - 1)[: m if second is None else m + n]] = 1
    for at in range(0, m * n, most):
        k = np.arange(at, min(at + most, m * n))
        # the main ones, then each other window of the first with all of the second, then the main one with the second's
        a, b = np.where((k == 0) | (k > (m - 1) * n), 0, (k - 1) // n + 1), np.where(k == 0, 0, np.where(k > (m - 1) * n, k - (m - 1) * n, (k - 1) % n))
        parts = np.stack([a, m + b], 1).ravel()
        each = sizes[parts]
        place = np.repeat(starts[parts] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        made = {"ids": pool[place], "type_ids": np.repeat(np.tile(np.array([0, 1], np.int32), len(k)), each), "special_tokens_mask": special[place], "attention_mask": np.ones(len(place), np.int32)}
        long = each.reshape(-1, 2).sum(1)
        if at == 0 and pad is not None and pad.fixed is not None and (more := pad_target(int(long[0]), pad.fixed, pad.multiple) - int(long[0])) > 0:
            where = int(long[0]) if pad.direction == "Right" else 0
            for f, x in zip(PAIR_FIELDS, (pad.pad_id, pad.pad_type_id, 1, 0)):
                made[f] = np.concatenate([made[f][:where], np.full(more, x, made[f].dtype), made[f][where:]])
            long[0] += more
        yield long, made


class ByteTable:
    """The bytes of each id, for byte-level vocabularies: ids decode to the bytes one after the other."""

    def __init__(self, tokens: dict[int, str], char_bytes: dict[str, int]):
        size = max(tokens, default=-1) + 1
        made = [b""] * (size + 1)  # the last stands for unknown ids
        for i, t in tokens.items():
            made[i] = b"".join(bytes((char_bytes[c],)) if c in char_bytes else c.encode("utf-8", "replace") for c in t)
        self.size = size
        self.lengths = np.fromiter(map(len, made), np.int64, size + 1)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(made), np.uint8)

    def decode(self, column: pa.Array) -> list[str | None]:
        ids = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        ids = np.where((ids < 0) | (ids >= self.size), self.size, ids)
        lengths = self.lengths[ids]
        before = offsets_of(lengths)
        raw = self.blob[np.repeat(self.starts[ids] - before[:-1], lengths) + np.arange(int(before[-1]))].tobytes()
        ends = before[offsets_of(sizes)].tolist()
        return [None if not ok else raw[i:j].decode("utf-8", "replace") for ok, i, j in zip(column.is_valid().to_pylist(), ends, ends[1:])]


def text_slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterable[pa.RecordBatch]:
    """Rows of a batch in parts whose ``column``, of texts, has about ``limit`` bytes (one row at least)."""
    size = offsets_of(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(1)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
