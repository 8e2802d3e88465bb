"""Vocabulary operators as relations: counting, lookups, unions.

A vocabulary is broadcast where its bytes, measured, are at most
``BROADCAST_BYTES``, and joined by its key beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def _bytes(vocab: DataFrame) -> Column:
    texts = [f.name for f in vocab.schema.fields if f.dataType.typeName() == "string"]
    return sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in texts), F.lit(64).cast("bigint"))


def small(vocab: DataFrame, size: int | None = None) -> DataFrame:
    """The vocabulary with a broadcast hint if its bytes, measured where not given, are few enough."""
    if size is None:
        size = vocab.agg(F.sum(_bytes(vocab))).first()[0] or 0
    return F.broadcast(vocab) if size <= BROADCAST_BYTES else vocab


def words(df: DataFrame, pieces: Column, columns: list[str]) -> DataFrame:
    """A row for each piece: ``columns``, ``word_idx`` and ``word``. Null and empty arrays have none."""
    return df.select(*columns, F.posexplode(pieces).alias("word_idx", "word"))


def frequent_vocab(rows: DataFrame, least: int = 2, first_id: int = 1) -> DataFrame:
    """``(token, id)`` of words that occur at least ``least`` times, ranked by count and then by word.

    The ranked vocabulary is kept (``unpersist`` lets it go), since a lookup
    reads it more than once, and the corpus is counted once. It is sorted by
    range, so that no task gets all of it; ids go on from one range to the next.
    """
    return ranked_vocab(counted_words(rows), least, first_id)


def counted_words(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("word").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def ranked_vocab(counted: DataFrame, least: int = 2, first_id: int = 1) -> DataFrame:
    """:func:`frequent_vocab` of words that are counted already."""
    counted = counted.where(F.col("n") >= least)
    place = F.monotonically_increasing_id()  # the range above 33 bits of the place in it
    ranked = counted.orderBy(F.desc("n"), "token").select("token", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("at")).persist()
    sizes = {r["part"]: r["n"] for r in ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    parts = sorted(sizes)
    before = dict(zip(parts, np.cumsum([0] + [sizes[x] for x in parts]).tolist()))
    start = F.lit(0).cast("bigint") if not parts else F.element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in before.items() for x in pair]), F.col("part"))
    return ranked.select("token", (start + F.col("at") + F.lit(first_id)).cast("bigint").alias("id"))


def word_level(rows: DataFrame, vocab: DataFrame, unk_id: int | None = None, vocab_bytes: int | None = None) -> DataFrame:
    """Exact lookup of ``word``; unknown words get ``unk_id``, or leave if there is none.

    Of a vocabulary too large to broadcast, the part with the least ids is:
    where ids are ranks, that has most of the text, and all words whose number
    would make one task of a join too large. Only other words are shuffled.
    """
    named = vocab.select(F.col("token").alias("word"), F.col("id").alias("_id"))
    if vocab_bytes is None:
        vocab_bytes = named.agg(F.sum(_bytes(named))).first()[0] or 0
    if vocab_bytes <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(named), "word", "left")
    else:
        (last,) = named.agg(F.percentile_approx("_id", BROADCAST_BYTES / vocab_bytes / 2, 10_000)).first()
        head = rows.join(F.broadcast(named.where(F.col("_id") <= last)), "word", "left")
        rest = head.where("_id is null").drop("_id").join(named.where(F.col("_id") > last), "word", "left")
        joined = head.where("_id is not null").unionByName(rest)
    out = joined.select(*rows.columns, F.coalesce("_id", F.lit(unk_id)).cast("bigint").alias("id"))
    return out if unk_id is not None else out.where("id is not null")


def token_to_id(rows: DataFrame, vocab: DataFrame, added: DataFrame | None = None, token_col: str = "token") -> DataFrame:
    """Ids of tokens: the added vocabulary's first, then the model's; null where unknown."""
    out = rows.join(small(vocab.select(F.col("token").alias(token_col), F.col("id").alias("_m"))), token_col, "left")
    if added is None:
        return out.withColumnRenamed("_m", "id")
    out = out.join(small(added.select(F.col("token").alias(token_col), F.col("id").alias("_a"))), token_col, "left")
    return out.select(*rows.columns, F.coalesce("_a", "_m").alias("id"))


def id_to_token(rows: DataFrame, vocab: DataFrame, id_col: str = "id") -> DataFrame:
    return rows.join(small(vocab.select(F.col("id").alias(id_col), "token")), id_col, "left").select(*rows.columns, "token")


def vocab_with_added(vocab: DataFrame, added: DataFrame) -> DataFrame:
    """Union of both; an added token replaces the model's of the same name."""
    return vocab.join(small(added.select("token")), "token", "left_anti").select("token", "id").unionByName(added.select("token", "id"))


def suffix_array(text: str) -> list[int]:
    """Suffixes in order, by doubling."""
    n = len(text)
    rank, order, k = [ord(c) for c in text], list(range(n)), 1
    while n > 1:
        key = [(rank[i], rank[i + k] if i + k < n else -1) for i in range(n)]
        order.sort(key=key.__getitem__)
        new = [0] * n
        for a, b in zip(order, order[1:]):
            new[b] = new[a] + (key[a] != key[b])
        rank = new
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


def common_prefixes(text: str, order: list[int]) -> list[int]:
    """Length of what each suffix shares with the one before it in order."""
    n = len(text)
    rank, out, h = [0] * n, [0] * n, 0
    for r, i in enumerate(order):
        rank[i] = r
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return out


def repeated_substrings(text: str, least: int = 1) -> list[tuple[int, int, int]]:
    """``(offset, length, frequency)`` of the maximal repeats' intervals, at least ``least`` long."""
    order = suffix_array(text)
    lcp = [*common_prefixes(text, order), 0] if text else [0]
    out, stack = [], [(0, 0)]
    for r in range(1, len(text) + 1):
        left = r - 1
        while stack and stack[-1][0] > lcp[r]:
            length, left = stack.pop()
            if length >= least:
                out.append((min(order[left:r]), length, r - left))
        if not stack or stack[-1][0] < lcp[r]:
            stack.append((lcp[r], left))
    return sorted(out)


def register_sql(spark: SparkSession, tokenizer: Any, prefix: str = "tok") -> None:
    """SQL functions ``tok_encode_ids``, ``tok_count``, ``tok_decode`` and table functions ``tok_tokens(text)``, ``tok_repeats(text)``."""
    get = tokenizer._sender()

    @F.pandas_udf("array<bigint>")
    def encode_ids(s: pd.Series) -> pd.Series:
        tok = get()
        return s.map(lambda t: tok.encode(t, offsets="none").ids, na_action="ignore")

    @F.pandas_udf("bigint")
    def count(s: pd.Series) -> pd.Series:
        tok = get()
        return pd.Series([None if t is None else len(tok.encode(t, offsets="none")) for t in s], dtype="Int64")

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        tok = get()
        return s.map(lambda ids: tok.decode([int(i) for i in ids]), na_action="ignore")

    @F.udtf(returnType="pos int, id bigint, token string, start int, end int")
    class Tokens:
        def eval(self, text: str) -> Iterator[tuple]:
            if text is not None:
                e = get().encode(text)
                for i in range(len(e)):
                    yield i, e.ids[i], e.tokens[i], *e.offsets[i]

    @F.udtf(returnType="offset int, length int, frequency int")
    class Repeats:
        def eval(self, text: str) -> Iterator[tuple]:
            yield from repeated_substrings(text or "")

    spark.udf.register(f"{prefix}_encode_ids", encode_ids)
    spark.udf.register(f"{prefix}_count", count)
    spark.udf.register(f"{prefix}_decode", decode)
    spark.udtf.register(f"{prefix}_tokens", Tokens)
    spark.udtf.register(f"{prefix}_repeats", Repeats)
