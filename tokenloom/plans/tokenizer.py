"""A tokenizer: definition, encoding and decoding of DataFrames.

Encoding is one narrow pass: rows stay in their partitions, nothing is shuffled
or collected, and Python gets whole Arrow batches of the text columns. Words
are looked up in a bounded cache of each worker, so the model runs about once
for each distinct word a worker meets. The definition is sent to a worker once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions import decoders, normalizers, pretokenizers, processors  # noqa: F401
from tokenloom.functions.aligned import CHAR_BYTES, Aligned
from tokenloom.operators import models
from tokenloom.operators.encoding import FIELDS, EncodingRow, pad_target, truncate_pair
from tokenloom.plans import batches as B
from tokenloom.plans.added import AddedToken, AddedVocabulary
from tokenloom.sources.registry import build, dump

OFFSETS = ("char", "byte", "utf16", "none")
CACHED_WORDS = 200_000
CACHED_CHARS = 4 << 20
LONGEST_CACHED = 128
MOST_BUILT = 64
#: Words that a worker keeps of tokenizers besides the one at work.
MOST_OTHERS = 50_000
#: Tokens that a worker holds as Python objects before it sends them on.
MOST_HELD = 1 << 17

ENCODING = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("type_ids", T.ArrayType(T.IntegerType())),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("word_ids", T.ArrayType(T.IntegerType())),
        T.StructField("offsets", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("special_tokens_mask", T.ArrayType(T.IntegerType())),
        T.StructField("attention_mask", T.ArrayType(T.IntegerType())),
        T.StructField("sequence_ids", T.ArrayType(T.IntegerType())),
    ]
)


@dataclass(frozen=True)
class Truncation:
    max_length: int = 512
    stride: int = 0
    strategy: str = "LongestFirst"
    direction: str = "Right"

    def __post_init__(self) -> None:
        if self.stride and self.stride >= self.max_length:
            raise ValueError("stride must be less than max_length")


@dataclass(frozen=True)
class Padding:
    fixed: int | None = None  # None pads to the longest of a batch
    pad_id: int = 0
    pad_type_id: int = 0
    pad_token: str = "[PAD]"
    direction: str = "Right"
    multiple: int | None = None


_built: dict[str, Tokenizer] = {}


class Tokenizer:
    """Immutable but for its caches: methods that change something return a new tokenizer."""

    def __init__(
        self,
        model: models.Model,
        *,
        normalizer: Any = None,
        pre_tokenizer: Any = None,
        post_processor: Any = None,
        decoder: Any = None,
        added_tokens: list[AddedToken] | tuple = (),
        truncation: Truncation | None = None,
        padding: Padding | None = None,
        encode_special_tokens: bool = False,
    ):
        self.model, self.normalizer, self.pre_tokenizer, self.post_processor, self.decoder = model, normalizer, pre_tokenizer, post_processor, decoder
        self.truncation, self.padding, self.encode_special_tokens = truncation, padding, encode_special_tokens
        self.added = AddedVocabulary(list(added_tokens), model.size(), model.vocabulary(), normalizer, encode_special_tokens)
        self.cache: dict[str, list[models.Token]] = {}
        self.cached_chars = 0
        #: Whether ids are those of the pre-tokenizer's pieces; whether pieces are parts of the text, at the same places.
        self.plain = pre_tokenizer is not None and not self.added.tokens and model.cacheable
        self.direct = self.plain and pre_tokenizer.exact and (normalizer is None or normalizer.keeps_places)
        self.table = B.WordTable(model)
        self.byte_table: B.ByteTable | None = None

    # definition

    def with_(self, **changes: Any) -> Tokenizer:
        parts = {k: getattr(self, k) for k in ("normalizer", "pre_tokenizer", "post_processor", "decoder", "truncation", "padding", "encode_special_tokens")}
        parts |= {"model": self.model, "added_tokens": self.added.tokens} | changes
        return Tokenizer(parts.pop("model"), **parts)

    def add_tokens(self, tokens: list[AddedToken | str], special: bool = False) -> Tokenizer:
        new = [AddedToken(t, special=special, normalized=not special) if isinstance(t, str) else replace(t, special=t.special or special) for t in tokens]
        return self.with_(added_tokens=[*self.added.tokens, *new])

    @classmethod
    def from_json(cls, data: dict[str, Any]) -> Tokenizer:
        if not data.get("model"):
            raise ValueError("a definition needs a model")
        model = dict(data["model"])
        model["type"] = models.detect_model(model)
        truncation, padding = data.get("truncation"), data.get("padding")
        added = [AddedToken(**{k: v for k, v in t.items() if k in AddedToken.__dataclass_fields__}) for t in data.get("added_tokens") or []]
        return cls(
            build("model", model),
            normalizer=build("normalizer", data.get("normalizer")),
            pre_tokenizer=build("pre_tokenizer", data.get("pre_tokenizer")),
            post_processor=build("post_processor", data.get("post_processor")),
            decoder=build("decoder", data.get("decoder")),
            added_tokens=added,
            truncation=read_truncation(truncation),
            padding=read_padding(padding),
        )

    def to_json(self) -> dict[str, Any]:
        t, p = self.truncation, self.padding
        return {
            "version": "1.0",
            "normalizer": dump(self.normalizer),
            "pre_tokenizer": dump(self.pre_tokenizer),
            "model": dump(self.model),
            "added_tokens": [a.to_json() for a in self.added.tokens],
            "post_processor": dump(self.post_processor),
            "decoder": dump(self.decoder),
            "truncation": None if t is None else {"type": t.strategy, "max_length": t.max_length, "stride": t.stride, "direction": t.direction},
            "padding": None if p is None else {"type": "BatchLongest" if p.fixed is None else {"Fixed": p.fixed}, "pad_id": p.pad_id, "pad_type_id": p.pad_type_id, "pad_token": p.pad_token, "direction": p.direction, "pad_to_multiple_of": p.multiple},
        }

    # vocabulary

    def token_to_id(self, token: str) -> int | None:
        found = self.added.by_content.get(token)
        return found.id if found else self.model.id_of(token)

    def id_to_token(self, id_: int) -> str | None:
        found = self.added.by_id.get(id_)
        return found.content if found else self.model.token_of(id_)

    def vocabulary(self) -> dict[str, int]:
        return self.model.vocabulary() | {t.content: t.id for t in self.added.tokens}

    def vocab_size(self, with_added: bool = True) -> int:
        """Model size plus number of added tokens; tokens that are in both count twice."""
        return self.model.size() + (len(self.added.tokens) if with_added else 0)

    def vocab_frame(self, spark: SparkSession) -> DataFrame:
        """``(token, id)`` of model and added tokens, the added ones before those of the model."""
        return spark.createDataFrame(sorted(self.vocabulary().items(), key=lambda x: (x[1], x[0])), "token string, id bigint")

    # one text

    def word(self, word: str) -> list[models.Token]:
        if not self.model.cacheable or len(word) > LONGEST_CACHED:
            return self.model.tokens(word)
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHED_WORDS or self.cached_chars >= CACHED_CHARS:
                self.cache.clear()
                self.cached_chars = 0
            found = self.cache[word] = self.model.tokens(word)
            self.cached_chars += len(word)
        return found

    def held(self) -> int:
        """Words that are kept."""
        return len(self.cache) + len(self.table.numbers)

    def forget(self) -> None:
        self.cache.clear()
        self.cached_chars = 0
        self.table.clear()
        self.byte_table = None

    def segments(self, text: Aligned) -> Iterator[tuple[Aligned, AddedToken | None]]:
        for part, token in self.added.extract(text):
            if token is not None or self.pre_tokenizer is None:
                if part.text:
                    yield part, token
            else:
                for piece in self.pre_tokenizer.split(part):
                    if piece.text:
                        yield piece, None

    def pieces(self, text: str) -> list[str]:
        """Of a tokenizer that is plain."""
        return self.pre_tokenizer(self.normalizer(text) if self.normalizer else text)

    def encode_sequence(self, text: str, places: bool = True) -> EncodingRow:
        out = EncodingRow()
        self.model.begin(text)
        if self.direct:
            normal = self.normalizer(text) if self.normalizer else text
            for word_id, (i, j) in enumerate(self.pre_tokenizer.spans(normal)):
                for t in self.word(normal[i:j]):
                    out.ids.append(t.id)
                    out.tokens.append(t.value)
                    out.word_ids.append(word_id)
                    out.offsets.append((i + t.start, i + t.end) if places else (0, 0))
            return self._even(out)
        for word_id, (piece, token) in enumerate(self.segments(Aligned.of(text, places))):
            found = [models.Token(token.id, token.content, 0, len(piece.text))] if token else self.word(piece.text)
            for t in found:
                out.ids.append(t.id)
                out.tokens.append(t.value)
                out.word_ids.append(word_id)
                out.offsets.append(piece.span(t.start, t.end) if places else (0, 0))
        return self._even(out)

    @staticmethod
    def _even(out: EncodingRow) -> EncodingRow:
        n = len(out.ids)
        out.type_ids, out.special_tokens_mask, out.attention_mask, out.sequence_ids = [0] * n, [0] * n, [1] * n, [None] * n
        return out

    def sequence_ids(self, text: str, most: int | None = None) -> list[int]:
        """Ids alone; stops at the piece that reaches ``most``."""
        out: list[int] = []
        self.model.begin(text)
        found = ((p, None) for p in self.pieces(text)) if self.plain else ((p.text, t) for p, t in self.segments(Aligned(text)))
        for piece, token in found:
            if token:
                out.append(token.id)
            else:
                out += [t.id for t in self.word(piece)]
            if most is not None and len(out) >= most:
                return out[:most]
        return out

    def encode_words(self, words: list[str]) -> EncodingRow:
        """Words that are split already: the model alone, places within each word, no word ids."""
        tokens = [t for w in words for t in self.word(w)]
        n = len(tokens)
        return EncodingRow([t.id for t in tokens], [0] * n, [t.value for t in tokens], [None] * n, [(t.start, t.end) for t in tokens], [0] * n, [1] * n, [None] * n)

    def finish(self, first: EncodingRow, second: EncodingRow | None, specials: bool, reduce: bool = True) -> EncodingRow:
        if self.truncation:
            t = self.truncation
            spare = self.post_processor.added(second is not None) if specials and reduce and self.post_processor else 0
            first, second = truncate_pair(first, second, t.max_length - spare, t.stride, t.strategy, t.direction)
        if self.post_processor is None:
            return processors.plain(first, second)
        return self.post_processor.process(first, second, specials)

    def encode(self, text: str, pair: str | None = None, *, specials: bool = True, offsets: str = "char") -> EncodingRow:
        """One text, or a pair; an empty pair is none. Padded where the length is fixed."""
        places = offsets != "none"
        first = self._unit(self.encode_sequence(text, places), text, offsets)
        second = self._unit(self.encode_sequence(pair, places), pair, offsets) if pair else None
        return self.pad_fixed(self.finish(first, second, specials))

    @staticmethod
    def _unit(e: EncodingRow, text: str, offsets: str) -> EncodingRow:
        if offsets in ("char", "none") or text.isascii():
            return e
        width = np.fromiter((len(c.encode("utf-8", "replace")) if offsets == "byte" else 1 + (ord(c) > 0xFFFF) for c in text), np.int64, len(text))
        at = np.concatenate(([0], np.cumsum(width)))
        return replace(e, offsets=[(int(at[s]), int(at[t])) for s, t in e.offsets])

    def pad_fixed(self, e: EncodingRow) -> EncodingRow:
        p = self.padding
        if p is None or p.fixed is None:
            return e
        return e.padded(pad_target(len(e), p.fixed, p.multiple), p.pad_id, p.pad_type_id, p.pad_token, p.direction)

    def encode_batch(self, texts: list[str], pairs: list[str] | None = None, **options: Any) -> list[EncodingRow]:
        out = [self.encode(t, p, **options) for t, p in zip(texts, pairs or [None] * len(texts))]
        p = self.padding
        if p is not None and out:
            target = pad_target(max(map(len, out)), p.fixed, p.multiple)
            out = [e.padded(target, p.pad_id, p.pad_type_id, p.pad_token, p.direction) for e in out]
        return out

    def decode(self, ids: list[int], skip_special: bool = True) -> str:
        """Unknown ids are left out, as are special tokens if asked; without a decoder tokens are joined by spaces."""
        if self.added.tokens:
            tokens = [t for t in map(self.id_to_token, ids) if t is not None and not (skip_special and self.added.is_special(t))]
        else:
            tokens = [t for t in map(self.model.token_of, ids) if t is not None]
        return self.decoder.decode(tokens) if self.decoder else " ".join(tokens)

    def decode_stream(self, skip_special: bool = True) -> Any:
        from tokenloom.streaming.decode import DecodeStream

        return DecodeStream(self, skip_special)

    # DataFrames

    def _sender(self) -> Any:
        """A function that gives the workers' copy of this tokenizer, built once in each for one definition.

        A worker that goes from one query to the next keeps tokenizers, but their
        words only as long as those of all the others are few.
        """
        definition, special = self.to_json(), self.encode_special_tokens
        key = hashlib.sha256(json.dumps([definition, special], sort_keys=True, default=str).encode()).hexdigest()

        def get() -> Tokenizer:
            found = _built.get(key)
            if found is None:
                if len(_built) >= MOST_BUILT:
                    _built.clear()
                found = _built[key] = Tokenizer.from_json(definition).with_(encode_special_tokens=special)
            others = [t for t in _built.values() if t is not found]
            if sum(t.held() for t in others) > MOST_OTHERS:
                for t in others:
                    t.forget()
            return found

        return get

    def encode_frame(
        self,
        df: DataFrame,
        text_col: str = "text",
        pair_col: str | None = None,
        *,
        specials: bool = True,
        offsets: str = "char",
        columns: list[str] | None = None,
        out_col: str = "encoding",
        words: bool = False,
        fields: tuple[str, ...] = FIELDS,
    ) -> DataFrame:
        """A row for each window: ``columns`` (all by default), ``window_index`` and the encoding.

        ``fields`` are those of the encoding that are wanted. ``words``: the text
        columns hold arrays of words. Null texts have one row with a null
        encoding. Padding to the longest is by
        :func:`tokenloom.operators.shape.pad_batch`. Names that a column has
        already get underscores.
        """
        if offsets not in OFFSETS:
            raise ValueError(f"offsets must be one of {OFFSETS}")
        if not set(fields) <= set(FIELDS):
            raise ValueError(f"fields must be of {FIELDS}")
        fields = tuple(f for f in FIELDS if f in fields)
        columns = df.columns if columns is None else columns
        get = self._sender()
        kept = df.select(*columns)
        window = B.free_name(columns, "window_index")
        out_name = B.free_name([*columns, window], out_col)
        text, pair = B.free_name(df.columns, "_text"), B.free_name(df.columns, "_pair")
        source = df.select(*columns, F.col(text_col).alias(text), (F.col(pair_col) if pair_col else F.lit(None).cast(df.schema[text_col].dataType)).alias(pair))
        schema = T.StructType([*kept.schema.fields, T.StructField(window, T.IntegerType()), T.StructField(out_name, T.StructType([ENCODING[f] for f in fields]))])
        names = [*columns, window, out_name]
        alone = pair_col is None and not words and offsets != "utf16" and self.truncation is None and self.post_processor is None and (self.padding is None or self.padding.fixed is None)

        def rows(tok: Tokenizer, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            row, index, made = [], [], []

            def batch() -> pa.RecordBatch:
                take = pa.array(row, pa.int64())
                out = pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns[:-2]], pa.array(index, pa.int32()), B.as_structs(made, fields)], names)
                row.clear(), index.clear(), made.clear()
                return out

            held = 0
            for i, (text, pair) in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())):
                if text is None:
                    row.append(i), index.append(0), made.append(None)
                    continue
                if words:
                    tok.model.begin(" ".join(text))
                    e = tok.finish(tok.encode_words(text), tok.encode_words(pair) if pair else None, specials, reduce=False)
                else:
                    e = tok.encode(text, pair, specials=specials, offsets=offsets)
                for k, w in enumerate([e, *e.overflow]):
                    row.append(i), index.append(k), made.append(w)
                    held += len(w)
                    if held >= MOST_HELD:
                        yield batch()
                        held = 0
            yield batch()

        gathered = pair_col is not None and not words and specials and set(fields) <= set(B.PAIR_FIELDS) and type(self.post_processor) is processors.BertProcessing

        def pairs(b: pa.RecordBatch, tok: Tokenizer) -> Iterator[pa.RecordBatch]:
            row, index, sizes, made, held = [], [], [], [], 0

            def batch() -> pa.RecordBatch:
                take, ends = pa.array(np.concatenate(row)), B.offsets_of(np.concatenate(sizes))
                null = np.concatenate([np.full(len(s), m is None) for s, m in zip(sizes, made)])
                values = [B.lists(ends, pa.array(np.concatenate([np.zeros(0, np.int64 if f == "ids" else np.int32), *[m[f] for m in made if m is not None]]))) for f in fields]
                return pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns[:-2]], pa.array(np.concatenate(index).astype(np.int32)), pa.StructArray.from_arrays(values, list(fields), mask=pa.array(null))], names)

            for i, (text, pair) in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())):
                k = 0
                for long, values in [(np.zeros(1, np.int64), None)] if text is None else B.pair_windows(tok, text, pair):
                    row.append(np.full(len(long), i)), index.append(np.arange(k, k + len(long))), sizes.append(long), made.append(values)
                    k, held = k + len(long), held + int(long.sum())
                    if held >= MOST_HELD:
                        yield batch()
                        row, index, sizes, made, held = [], [], [], [], 0
            if row:
                yield batch()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tok = get()
            for batch in batches:
                if gathered and tok.plain:
                    for start in range(0, batch.num_rows, 200):
                        yield from pairs(batch.slice(start, 200), tok)
                    continue
                if alone and tok.direct:
                    for b in B.text_slices(batch, batch.num_columns - 2):
                        made = B.flat_encodings(tok, b.column(b.num_columns - 2).to_pylist(), fields, offsets)
                        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(np.zeros(b.num_rows, np.int32)), made], names)
                    continue
                for part in [batch] if words else B.text_slices(batch, batch.num_columns - 2):
                    for start in range(0, part.num_rows, 200):
                        yield from rows(tok, part.slice(start, 200))

        return source.mapInArrow(run, schema)

    def ids_frame(self, df: DataFrame, text_col: str = "text", *, specials: bool = True, columns: list[str] | None = None, out_col: str = "ids") -> DataFrame:
        """``columns`` and the ids alone; truncation cuts exactly and stops early, nothing is padded. A name that a column has already gets underscores."""
        columns = df.columns if columns is None else columns
        get = self._sender()
        out_name, source = B.free_name(columns, out_col), B.free_name(df.columns, "_text")
        schema = T.StructType([*df.select(*columns).schema.fields, T.StructField(out_name, T.ArrayType(T.LongType()))])

        def rows(tok: Tokenizer, texts: list[str | None]) -> pa.Array:
            t, post = tok.truncation, tok.post_processor
            most = None if t is None else max(t.max_length - (post.added(False) if post and specials else 0), 0)
            early = most if t is not None and t.direction == "Right" else None
            if most is None and post is None and tok.plain:
                return B.flat_ids(tok, texts)
            made: list[list[int] | None] = []
            for text in texts:
                if text is None:
                    made.append(None)
                    continue
                ids = tok.sequence_ids(text, early) if most != 0 else []
                if most is not None and len(ids) > most:
                    ids = ids[-most:] if t.direction == "Left" else ids[:most]
                if post is not None:
                    n = len(ids)
                    ids = post.process(EncodingRow(ids, [0] * n, [""] * n, [None] * n, [(0, 0)] * n, [0] * n, [1] * n, [None] * n), None, specials).ids
                made.append(ids)
            return pa.array(made, pa.list_(pa.int64()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tok = get()
            for batch in batches:
                for b in B.text_slices(batch, batch.num_columns - 1):
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], rows(tok, b.column(b.num_columns - 1).to_pylist())], [*columns, out_name])

        return df.select(*columns, F.col(text_col).alias(source)).mapInArrow(run, schema)

    def decode_frame(self, df: DataFrame, ids_col: str = "ids", *, skip_special: bool = True, out_col: str = "decoded") -> DataFrame:
        """All columns and the decoded text of each list of ids. A name that a column has already gets underscores."""
        get = self._sender()
        at, out_name = df.columns.index(ids_col), B.free_name(df.columns, out_col)

        def texts(tok: Tokenizer, ids: pa.Array) -> list[str | None]:
            if isinstance(tok.decoder, decoders.ByteLevel) and not tok.added.tokens:
                if tok.byte_table is None:
                    tok.byte_table = B.ByteTable({i: t for t, i in tok.model.vocabulary().items()}, CHAR_BYTES)
                return tok.byte_table.decode(ids)
            return [None if x is None else tok.decode(x, skip_special) for x in ids.to_pylist()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tok = get()
            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    b = batch.slice(start, 500)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts(tok, b.column(at)), pa.string())], [*df_columns, out_name])

        df_columns = df.columns
        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_name, T.StringType())]))


def read_truncation(data: dict[str, Any] | None) -> Truncation | None:
    if not data:
        return None
    names = {n.lower(): n for n in ("LongestFirst", "OnlyFirst", "OnlySecond")}
    strategy = names.get(str(data.get("type") or data.get("strategy") or "").replace("_", "").lower(), "LongestFirst")
    return Truncation(int(data.get("max_length", 512)), int(data.get("stride", 0)), strategy, "Left" if str(data.get("direction", "")).lower() == "left" else "Right")


def read_padding(data: dict[str, Any] | None) -> Padding | None:
    if not data:
        return None
    kind = data.get("type", data.get("strategy"))
    fixed = int(kind["Fixed"]) if isinstance(kind, dict) and "Fixed" in kind else int(data.get("length") or 0) if kind == "Fixed" else None
    return Padding(fixed, int(data.get("pad_id", 0)), int(data.get("pad_type_id", 0)), data.get("pad_token", "[PAD]"), "Left" if str(data.get("direction", "")).lower() == "left" else "Right", data.get("pad_to_multiple_of"))
