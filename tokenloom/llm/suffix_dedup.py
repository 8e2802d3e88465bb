"""Suffix dedup over a parse: every passage of ``LENGTH`` words that occurs twice.

Symbols are words (text between white space). A rolling hash of ``GRAM`` words
sets triggers: of each ``SPAN`` successive positions the one with the least hash
(leftmost of equals). Triggers cut texts into phrases. Which trigger a passage
of ``LENGTH`` words holds first depends on the passage alone, so all its
occurrences are cut alike, and a phrase has less than ``SPAN`` words.

This follows prefix-free parsing (Boucher et al., 2019) in that repeated text is
worked on once: what can be in a repeat becomes a dictionary of distinct contexts
(the end of a phrase and the text from its trigger on, as far as a passage
reaches) and, for each text, places with the fingerprints of their contexts. A
passage begins with the rest of a phrase, c words long, up to its trigger, and
goes on as the text from there, here called a parse suffix. The dictionary's
parse suffixes are sorted by their words; common prefixes with the neighbours
in that order put them in classes, and the phrases' ends are named word by word.
Two passages are equal exactly if their rests have one name and their parse
suffixes share at least ``LENGTH - c`` words, that is, no smaller common prefix
lies between them in the sorted order. Words are told apart by their bytes.

It differs from it in two ways. Triggers are minima of windows instead of hashes
that are 0 modulo a constant: those leave phrases without bound. And the
dictionary's suffixes aren't sorted beyond their trigger, nor is the corpus as a
whole: sorting each suffix of each phrase needs all words of the dictionary as
keys of up to ``LENGTH`` words, which is many times the text.

Contexts whose first ``LENGTH - SPAN + 1`` words occur once in the corpus can't
be in a repeat and are dropped before texts move. Beginnings that occur more than
``HOT_ROWS`` times aren't sorted in one task: their passages are counted by
fingerprints of 128 bits, partly before anything moves. Fingerprints of contexts
have 128 bits too; that contexts with one fingerprint are alike is checked. No
occurrence is capped or left out.

Cases: rows with null text or null id have no passages, nor have texts of fewer
than ``LENGTH`` words. Texts may have any length. White space is compared as one
space. A passage that recurs in its own document counts. Ids may be of any type
with an order. Rows that repeat an id and text repeat each other; rows with one
id and several texts report the stretches of all of them under that id. The
input's other columns don't matter; ``id_col`` keeps its name, and the output's
others get underscores where they would clash with it. Empty tables give empty
tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import _shared as S
from tokenloom.llm.exact_dedup import BROADCAST_BYTES, members

LENGTH = 50
GRAM = 6
SPAN = 40
HOT_ROWS = 20_000
#: Contexts that are compared at once, or one beginning's.
CHUNK = 3_000
_OTHER = np.uint64(0xD1B54A32D192ED03)


def _sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums of word hashes times powers; ``_window`` takes hashes of stretches from them."""
    power, _ = S._power_tables(len(h) + 1)
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=out[1:])
    return out


def _window(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = S._power_tables(len(sums))
    return S.mix((sums[end] - sums[start]) * inverse[start])


def _sliding_least(x: np.ndarray, span: int) -> np.ndarray:
    """Places of the least of each ``span`` successive values (leftmost of equals), by doubling."""
    have, least, place = 1, x, np.arange(len(x))
    while have < span:
        step = min(have, span - have)
        later = least[step:] < least[:-step]
        least = np.where(later, least[step:], least[:-step])
        place = np.where(later, place[step:], place[:-step])
        have += step
    return place


class Parse:
    """Phrase beginnings of a batch: ``at`` (word), ``doc``, and the least and greatest length ``low``, ``high`` of the rests of phrases before it that begin a passage."""

    def __init__(self, col: pa.Array, length: int, gram: int, span: int):
        self.words = w = S.Words(col)
        self.sums = _sums(w.hash)
        n = len(w.hash)
        empty = np.zeros(0, np.int64)
        self.at, self.doc, self.low, self.high, self.key = empty, empty, empty, empty, np.zeros(0, np.uint64)
        if n < length:
            return
        place = np.arange(n - gram + 1)
        rolled = _window(self.sums, place, place + gram)
        least = _sliding_least(rolled, span)
        begin = np.arange(n - length + 1)
        begin = begin[w.doc[begin] == w.doc[begin + length - 1]]
        if not len(begin):
            return
        trigger = least[begin]
        new = np.flatnonzero(np.concatenate(([True], trigger[1:] != trigger[:-1])))
        last = np.concatenate((new[1:], [len(begin)])) - 1
        self.at = trigger[new]
        self.doc = w.doc[self.at]
        self.high = self.at - begin[new]
        self.low = self.at - begin[last]
        self.key = _window(self.sums, self.at, self.at + length - span + 1)


def _word_names(w: S.Words) -> np.ndarray:
    """A number for each distinct word, by its bytes."""
    _, first, name = np.unique(w.hash, return_index=True, return_inverse=True)
    size = w.end - w.start
    other = first[name]
    if (size == size[other]).all():
        before = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(before, size)
        if (w.data[np.repeat(w.start, size) + step] == w.data[np.repeat(w.start[other], size) + step]).all():
            return name
    known: dict[bytes, int] = {}  # two words share a hash
    return np.array([known.setdefault(w.data[s:e].tobytes(), len(known)) for s, e in zip(w.start, w.end)], np.int64)


def _repeats(table: pa.Table, length: int, span: int) -> pa.RecordBatch:
    """Distinct contexts of whole beginnings, sorted by key and suffix, to ``(a, b, mask)``: bit c of mask is set if the passage that begins c words before the trigger is repeated."""
    n = table.num_rows
    words = S.Words(pa.concat_arrays([table.column("suffix").combine_chunks(), table.column("rest").combine_chunks()]))
    names = _word_names(words)
    place = np.arange(len(names)) - words.first[words.doc]
    right, left = words.doc < n, words.doc >= n
    # beyond its end, a suffix is unlike any other
    ahead = len(names) + np.arange(n * length, dtype=np.int64).reshape(n, length)
    ahead[words.doc[right], place[right]] = names[right]
    behind = np.zeros((n, span), np.int64)
    behind[words.doc[left] - n, (words.first[words.doc + 1] - 1 - np.arange(len(names)))[left]] = names[left] + 1
    low, high, count, key = (table.column(c).to_numpy() for c in ("low", "high", "n", "key"))
    same = np.zeros(n, np.int64)
    if n > 1:
        equal = ahead[1:] == ahead[:-1]
        same[1:] = np.where(equal.all(axis=1), length, equal.argmin(axis=1)) * (key[1:] == key[:-1])
    mask, rest = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for c in range(int(high.max(initial=-1)) + 1):
        if c:
            rest = np.unique(rest * (len(names) + 2) + behind[:, c - 1], return_inverse=True)[1]
        on = np.flatnonzero((low <= c) & (c <= high))
        if not len(on):
            continue
        group = np.cumsum(same < length - c)
        _, at = np.unique(rest[on] * (n + 1) + group[on], return_inverse=True)
        mask[on[np.bincount(at, weights=count[on])[at] > 1]] |= np.uint64(1 << c)
    out = pa.array(mask != 0)
    return pa.RecordBatch.from_arrays([table.column("a").combine_chunks().filter(out), table.column("b").combine_chunks().filter(out), pa.array(mask[mask != 0].view(np.int64))], ["a", "b", "mask"])


def _passages(b: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """``(x, y, a, b, bit, n)``: a fingerprint for each passage of contexts."""
    names = b.schema.names
    rest, suffix = S.Words(b.column(names.index("rest"))), S.Words(b.column(names.index("suffix")))
    low, high, n = (b.column(names.index(c)).to_numpy() for c in ("low", "high", "n"))
    before, after = np.diff(rest.first), np.diff(suffix.first)
    # the words of each context: its rest and then its suffix
    start = np.cumsum(before + after) - before - after
    hash_ = np.zeros(int((before + after).sum()), np.uint64)
    hash_[start[rest.doc] + np.arange(len(rest.doc)) - rest.first[rest.doc]] = rest.hash
    hash_[start[suffix.doc] + before[suffix.doc] + np.arange(len(suffix.doc)) - suffix.first[suffix.doc]] = suffix.hash
    times = high - low + 1
    row = np.repeat(np.arange(len(low)), times)
    c = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    begin = start[row] + before[row] - c
    x, y = (_window(_sums(h), begin, begin + length) for h in (hash_, S.mix(hash_ ^ _OTHER)))
    columns = [b.column(names.index(k)).take(pa.array(row)) for k in ("a", "b")]
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), *columns, pa.array(np.int64(1) << c.astype(np.int64)), pa.array(n[row])], ["x", "y", "a", "b", "bit", "n"])


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, span: int = SPAN, hot_rows: int = HOT_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, start_word, n_words)``: maximal stretches in which every word is in a passage of ``length`` words that occurs at least twice."""
    if not (0 < gram and 1 < span <= min(63, length - gram + 1)):
        raise ValueError("span must be between 2 and length - gram + 1, and at most 63")
    spark = docs.sparkSession
    id_name = S.free_name(docs, "_id")
    numbered, names = S.integer_ids(docs, id_col, id_name)
    base = numbered.where(F.col(id_name).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_name).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.slices(batches, "text"):
            p = Parse(b.column(2), length, gram, span)
            pair = S.mix(p.key + p.doc.astype(np.uint64))
            _, first, count = np.unique(pair, return_index=True, return_counts=True)
            take = pa.array(p.doc[first])
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(p.key[first].view(np.int64)), pa.array(count.astype(np.int32))], ["id", "h", "key", "n"])

    found = base.mapInArrow(beginnings, "id bigint, h bigint, key bigint, n int")
    recurring = S.written(found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "beginnings")
    again = members(found.select("id", "h", "key"), recurring, ["key"], [], most=most, hot_rows=hot_rows)
    keys = again.groupBy("id", "h").agg(F.collect_set("key").alias("keys"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.slices(batches, "text"):
            p = Parse(b.column(1), length, gram, span)
            w = p.words
            lists = b.column(2)
            wanted = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            pick = np.isin(S.mix(p.key + p.doc.astype(np.uint64)), S.mix(lists.flatten().to_numpy().view(np.uint64) + wanted.astype(np.uint64)))
            at, doc, low, high, key = p.at[pick], p.doc[pick], p.low[pick], p.high[pick], p.key[pick]
            until = np.minimum(at + length - low, w.first[doc + 1])
            shape = S.mix((low.astype(np.uint64) << np.uint64(8)) + high.astype(np.uint64))
            prints = []
            for sums in (p.sums, _sums(S.mix(w.hash ^ _OTHER))):
                prints.append(S.mix(S.mix(_window(sums, at - high, at) + shape) + _window(sums, at, until)))
            same = S.mix(S.mix(prints[0] + doc.astype(np.uint64)) + prints[1])
            _, first, group = np.unique(same, return_index=True, return_inverse=True)
            order = np.argsort(group, kind="stable")
            offsets = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=len(first))))).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(offsets), pa.array((at - w.first[doc])[order].astype(np.int32)))
            rest, suffix = [], []
            data, start, end = w.data, w.start, w.end
            for a, h, u in zip(at[first].tolist(), high[first].tolist(), until[first].tolist()):
                rest.append(b" ".join(data[start[a - h] : end[a - 1]].tobytes().split()) if h else b"")
                suffix.append(b" ".join(data[start[a] : end[u - 1]].tobytes().split()) + b" ")
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[first].view(np.int64)) for x in prints), pa.array(key[first].view(np.int64)), pa.array(suffix, pa.binary()), pa.array(rest, pa.binary()), pa.array(low[first].astype(np.int32)), pa.array(high[first].astype(np.int32)), b.column(0).take(pa.array(doc[first])), places],
                ["a", "b", "key", "suffix", "rest", "low", "high", "id", "at"],
            )

    sparse = base.join(keys, ["id", "h"]).select("id", "text", "keys").mapInArrow(suffixes, "a bigint, b bigint, key bigint, suffix binary, rest binary, low int, high int, id bigint, at array<int>")
    places = S.written(sparse, "places")
    S.drop_written(spark, recurring)
    hot = S.written(places.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("key"), "hot-beginnings")  # no more than rows / hot_rows
    contexts = places.groupBy("a", "b", "key", "suffix", "rest", "low", "high").agg(F.sum(F.size("at")).alias("n"))
    any_hot = not hot.isEmpty()
    cold = contexts if not any_hot else places.join(F.broadcast(hot) if S.bytes_of(hot)[1] <= most else hot, "key", "left_anti").groupBy("a", "b", "key", "suffix", "rest", "low", "high").agg(F.sum(F.size("at")).alias("n"))
    ordered = cold.repartition("key").sortWithinPartitions("key", "suffix")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                held.append(batch.slice(start, CHUNK))
                keys = held[-1].column(2)
                if sum(b.num_rows for b in held) < CHUNK or held[0].column(2)[0] == keys[len(keys) - 1]:
                    continue
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                yield _repeats(table.slice(0, cut), length, span)
                held = table.slice(cut).to_batches()
        if held:
            yield _repeats(pa.Table.from_batches(held), length, span)
        S.give_back()

    marks = ordered.mapInArrow(compare, "a bigint, b bigint, mask bigint")
    if any_hot:
        warm = places.join(F.broadcast(hot) if S.bytes_of(hot)[1] <= most else hot, "key").groupBy("a", "b", "key", "suffix", "rest", "low", "high").agg(F.sum(F.size("at")).alias("n"))

        def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in S.slices(batches, "suffix"):
                yield _passages(b, length)

        exploded = warm.mapInArrow(passages, "x bigint, y bigint, a bigint, b bigint, bit bigint, n bigint")
        twice = S.written(exploded.groupBy("x", "y").agg(F.sum("n").alias("n")).where("n > 1"), "passages")
        marks = marks.unionByName(members(exploded.drop("n"), twice, ["x", "y"], [], most=most, hot_rows=hot_rows).groupBy("a", "b").agg(F.bit_or("bit").alias("mask")))
    rows = places.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    marked = S.written(marks.join(rows, ["a", "b"]), "marks")
    twins = marked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    if not twins.isEmpty():
        raise RuntimeError("different contexts share a fingerprint of 128 bits")
    joined = members(places.select("a", "b", "id", "at"), marked, ["a", "b"], [], most=most, hot_rows=hot_rows).select("id", "at", "mask")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of successive beginnings of passages before each trigger: ``(id, first, last)``."""
        for b in batches:
            lists = b.column(1)
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            at, mask = lists.flatten().to_numpy().astype(np.int64), b.column(2).to_numpy().view(np.uint64)[row]
            on = ((mask[:, None] >> np.arange(span, dtype=np.uint64)) & np.uint64(1)) == 1
            padded = np.zeros((len(at), span + 2), np.int8)
            padded[:, 1:-1] = on
            turn = np.diff(padded, axis=1)
            which, high = np.nonzero(turn == -1)
            low = np.nonzero(turn == 1)[1]
            ids = b.column(0).to_numpy()[row][which]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at[which] - (high - 1)), pa.array(at[which] - low)], ["id", "first", "last"])

    sorted_runs = joined.mapInArrow(runs, "id bigint, first bigint, last bigint").repartition("id").sortWithinPartitions("id", "first")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(first), pa.array(last - first + length)], ["id", "start", "n"])

        carry = [np.zeros(0, np.int64)] * 3  # the stretch that may go on
        for b in batches:
            if not b.num_rows:
                continue
            ids, first, last = (np.concatenate([x, c.to_numpy()]) for x, c in zip(carry, b.columns))
            group = np.concatenate(([0], np.cumsum(ids[1:] != ids[:-1]))).astype(np.int64)
            reach = np.maximum.accumulate((group << 40) + last) - (group << 40)
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (first[1:] - reach[:-1] > length)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(ids)) - 1
            made = ids[begin], first[begin], reach[end]
            yield out(*(x[:-1] for x in made))
            carry = [x[-1:] for x in made]
        if len(carry[0]):
            yield out(*carry)

    result = sorted_runs.mapInArrow(stretches, "id bigint, start bigint, n bigint")
    start_name, n_name = ("start_word_" if id_col.lower() == "start_word" else "start_word"), ("n_words_" if id_col.lower() == "n_words" else "n_words")
    if names is not None:
        result = result.join(names.select(F.col(id_name).alias("id"), F.col("id").alias("name")), "id").drop("id").withColumnRenamed("name", "id")
    S.drop_written(spark, hot)
    return result.select(F.col("id").alias(id_col), F.col("start").alias(start_name), F.col("n").alias(n_name))
