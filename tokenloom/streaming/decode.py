"""Incremental decoding: ids come one by one, text leaves as soon as it is certain.

Text is held back while it may still change, that is, while it ends in the
replacement character of an unfinished byte sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from tokenloom.plans.tokenizer import Tokenizer

MOST_HELD = 4096
UNSURE = "�"


class PrefixMismatch(ValueError):
    """The decoded text no longer begins with what was given out."""


class DecodeStream:
    def __init__(self, tokenizer: Tokenizer, skip_special: bool = True, ids: list[int] | None = None, prefix: str = "", prefix_index: int = 0):
        self.tokenizer, self.skip_special = tokenizer, skip_special
        self.ids, self.prefix, self.prefix_index = list(ids or []), prefix, prefix_index

    def _decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, self.skip_special)

    def step(self, id_: int) -> str | None:
        """The text that this id makes certain, or None."""
        if not self.prefix and self.ids:
            text = self._decode(self.ids)
            if not text.endswith(UNSURE):
                self.prefix, self.prefix_index = text, len(self.ids)
        self.ids.append(id_)
        if len(self.ids) > MOST_HELD:
            text = self._decode(self.ids)
            self.reset()
            return text
        text = self._decode(self.ids)
        if len(text) <= len(self.prefix) or text.endswith(UNSURE):
            return None
        if not text.startswith(self.prefix):
            raise PrefixMismatch(f"{text!r} doesn't begin with {self.prefix!r}")
        new = text[len(self.prefix) :]
        self.ids = self.ids[self.prefix_index :]
        self.prefix_index = len(self.ids)
        self.prefix = self._decode(self.ids)
        return new

    def reset(self) -> None:
        self.ids, self.prefix, self.prefix_index = [], "", 0


def _step(stream: DecodeStream, id_: Any) -> tuple[str | None, str | None]:
    """Chunk and error of one id; a null id, and a mismatch, reset the stream."""
    if pd.isna(id_):
        stream.reset()
        return None, None
    try:
        return stream.step(int(id_)), None
    except PrefixMismatch as e:
        stream.reset()
        return None, str(e)


def decode_stream(df: DataFrame, tokenizer: Tokenizer, *, stream_col: str = "stream_id", seq_col: str = "seq", id_col: str = "token_id", skip_special: bool = True) -> DataFrame:
    """``(stream_id, seq, chunk, error)`` of a streaming table of ids, in the order of ``seq`` in each micro-batch.

    A null id resets its stream. A mismatch is reported in ``error`` and resets
    the stream; the query goes on.
    """
    get = tokenizer._sender()
    kind = df.schema[stream_col].dataType.simpleString()

    def run(key: tuple[Any], parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], "", 0)
        stream = DecodeStream(get(), skip_special, list(held[0] if held[0] is not None else []), held[1], held[2])
        rows = pd.concat(list(parts)).sort_values(seq_col)
        out = [(key[0], seq, *_step(stream, id_)) for seq, id_ in zip(rows[seq_col], rows[id_col])]
        state.update((stream.ids, stream.prefix, stream.prefix_index))
        yield pd.DataFrame(out, columns=[stream_col, seq_col, "chunk", "error"])

    return df.select(stream_col, seq_col, id_col).groupBy(stream_col).applyInPandasWithState(run, f"`{stream_col}` {kind}, `{seq_col}` bigint, chunk string, error string", "ids array<bigint>, prefix string, prefix_index int", "append", "NoTimeout")


def decode_rows(df: DataFrame, tokenizer: Tokenizer, *, stream_col: str = "stream_id", seq_col: str = "seq", id_col: str = "token_id", skip_special: bool = True) -> DataFrame:
    """The same over a batch table, ``(stream_id, seq, chunk, error)``: a stream's ids in the order of ``seq``."""
    get = tokenizer._sender()
    kind = df.schema[stream_col].dataType.simpleString()

    def run(key: tuple[Any], rows: pd.DataFrame) -> pd.DataFrame:
        stream = DecodeStream(get(), skip_special)
        rows = rows.sort_values(seq_col)
        made = [_step(stream, id_) for id_ in rows[id_col]]
        return pd.DataFrame({stream_col: key[0], seq_col: rows[seq_col], "chunk": [c for c, _ in made], "error": [e for _, e in made]})

    return df.select(stream_col, seq_col, id_col).groupBy(stream_col).applyInPandas(run, f"`{stream_col}` {kind}, `{seq_col}` bigint, chunk string, error string")
