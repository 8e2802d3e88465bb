"""Truncation, windows, padding, special tokens and position maps as Catalyst expressions.

They work on the arrays of a wide encoding (or on any arrays), stay in the JVM,
and move no rows; only padding to the longest of a batch needs the batch's
maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.processors import BertProcessing, Processor, RobertaProcessing, SequenceProcessing, TemplateProcessing
from tokenloom.operators.encoding import FIELDS

PAD = {"ids": 0, "type_ids": 0, "tokens": "[PAD]", "word_ids": None, "offsets": None, "special_tokens_mask": 1, "attention_mask": 0, "sequence_ids": None}


def truncate(tokens: Column, most: Column | int, direction: str = "Right") -> Column:
    """The first ``most`` elements, or the last with ``Left``."""
    most = F.greatest(F.lit(most), F.lit(0)) if isinstance(most, int) else F.greatest(most, F.lit(0))
    if direction == "Right":
        return F.slice(tokens, F.lit(1), most)
    return F.slice(tokens, F.greatest(F.size(tokens) - most, F.lit(0)) + 1, most)


def longest_first(a: Column, b: Column, most: int) -> tuple[Column, Column]:
    """Lengths that the parts of a pair keep, in closed form."""
    low, high = F.least(a, b), F.greatest(a, b)
    kept = F.when(low > most, low).otherwise(F.greatest(low, most - low))
    over = low + kept > most
    low2, high2 = F.when(over, F.lit(most // 2)).otherwise(low), F.when(over, F.lit(most // 2 + most % 2)).otherwise(kept)
    fits = a + b <= most
    del high
    return F.when(fits, a).when(a > b, high2).otherwise(low2), F.when(fits, b).when(a > b, low2).otherwise(high2)


def truncate_pair(first: Column, second: Column, most: int, strategy: str = "LongestFirst", direction: str = "Right") -> tuple[Column, Column]:
    a, b = F.size(first), F.size(second)
    over = F.greatest(a + b - most, F.lit(0))
    if strategy == "OnlyFirst":
        return truncate(first, a - over, direction), second
    if strategy == "OnlySecond":
        return first, truncate(second, b - over, direction)
    n, m = longest_first(a, b, most)
    return truncate(first, n, direction), truncate(second, m, direction)


def window_starts(n: Column, most: int, stride: int = 0, direction: str = "Right") -> Column:
    """Array of ``(start, end)`` of the windows over ``n`` tokens, the main one first."""
    if stride >= most:
        raise ValueError("stride must be less than the length of a window")
    step = most - stride
    count = F.greatest(F.ceil((n - most) / F.lit(step)), F.lit(0)).cast("int")
    index = F.sequence(F.lit(0), count)
    if direction == "Right":
        return F.transform(index, lambda k: F.struct((k * step).alias("start"), F.least(k * step + most, n).alias("end")))
    return F.transform(index, lambda k: F.struct(F.greatest(n - k * step - most, F.lit(0)).alias("start"), (n - k * step).alias("end")))


def stride_windows(df: DataFrame, tokens_col: str, most: int, stride: int = 0, direction: str = "Right", out_col: str = "window") -> DataFrame:
    """A row for each window: all columns, ``window_index`` and the window's tokens. Null arrays give no row."""
    spans = window_starts(F.size(tokens_col), most, stride, direction)
    rows = df.where(F.col(tokens_col).isNotNull()).select("*", F.posexplode(spans).alias("window_index", "_span"))
    return rows.select(*df.columns, "window_index", F.slice(F.col(tokens_col), F.col("_span.start") + 1, F.col("_span.end") - F.col("_span.start")).alias(out_col))


def rounded(length: Column, multiple: int | None) -> Column:
    return (F.ceil(length / F.lit(multiple)) * multiple).cast("int") if multiple else length


def pad(tokens: Column, length: Column | int, filler: Column | object, direction: str = "Right") -> Column:
    """The array filled up to ``length``; longer ones stay."""
    filler = filler if isinstance(filler, Column) else F.lit(filler)
    more = F.array_repeat(filler, F.greatest((F.lit(length) if isinstance(length, int) else length) - F.size(tokens), F.lit(0)))
    return F.concat(tokens, more) if direction == "Right" else F.concat(more, tokens)


def pad_batch(df: DataFrame, columns: list[str], *, batch_col: str | None = None, fixed: int | None = None, multiple: int | None = None, direction: str = "Right", fillers: dict[str, object] | None = None) -> DataFrame:
    """Pad array columns to the longest of their batch (the whole table without ``batch_col``), or to ``fixed`` if that is more.

    The maximum comes from an aggregate of one number a batch; the rows aren't
    moved when the batch is the whole table.
    """
    fillers = PAD | (fillers or {})
    size = F.max(F.size(columns[0])).alias("_longest")
    if batch_col is None:
        joined = df.crossJoin(F.broadcast(df.select(size)))
    else:
        joined = df.select("*", F.max(F.size(columns[0])).over(Window.partitionBy(batch_col)).alias("_longest"))
    target = rounded(F.greatest(F.col("_longest"), F.lit(fixed or 0)), multiple)
    out = []
    for c in df.columns:
        if c not in columns:
            out.append(F.col(c))
            continue
        kind = df.schema[c].dataType.elementType.simpleString()
        filler = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")) if c == "offsets" else F.lit(fillers.get(c, 0)).cast(kind)
        out.append(pad(F.col(c), target, filler, direction).alias(c))
    return joined.select(*out)


def _parts(processor: Processor | None, pair: bool) -> list[tuple[str, object, int]]:
    """The compiled template: ``("A" | "B", None, type)`` or ``("special", ids, type)``."""
    if isinstance(processor, BertProcessing):
        parts = [("special", [processor.cls[1]], 0), ("A", None, 0), ("special", [processor.sep[1]], 0)]
        return parts + [("B", None, 1), ("special", [processor.sep[1]], 1)] if pair else parts
    if isinstance(processor, RobertaProcessing):
        cls, sep = ("special", [processor.cls[1]], 0), ("special", [processor.sep[1]], 0)
        return [cls, ("A", None, 0), sep, sep, ("B", None, 0), sep] if pair else [cls, ("A", None, 0), sep]
    if isinstance(processor, TemplateProcessing):
        template = processor.pair if pair and processor.pair else processor.single
        return [(p["Sequence"]["id"], None, p["Sequence"].get("type_id", 0)) if "Sequence" in p else ("special", processor._special(p["SpecialToken"]["id"])[0], p["SpecialToken"].get("type_id", 0)) for p in template]
    if isinstance(processor, SequenceProcessing):
        for p in processor.processors:
            if not type(p).__name__.startswith("ByteLevel"):
                return _parts(p, pair)
    return [("A", None, 0), ("B", None, 1)] if pair else [("A", None, 0)]


def with_specials(first: Column, second: Column | None, processor: Processor | None) -> Column:
    """Struct of ``ids``, ``type_ids``, ``special_tokens_mask``, ``attention_mask`` and ``sequence_ids``: a template compiled to one expression."""
    ids, types, masks, sequences = [], [], [], []
    for kind, fixed, type_id in _parts(processor, second is not None):
        source = first if kind == "A" else second if kind == "B" else None
        if source is not None:
            n = F.size(source)
            ids.append(source)
            sequences.append(F.array_repeat(F.lit(0 if kind == "A" else 1), n))
        elif fixed is not None:
            n = F.lit(len(fixed))
            ids.append(F.array(*[F.lit(i) for i in fixed]).cast("array<bigint>"))
            sequences.append(F.array_repeat(F.lit(None).cast("int"), n))
        else:
            continue
        types.append(F.array_repeat(F.lit(type_id), n))
        masks.append(F.array_repeat(F.lit(int(source is None)), n))
    all_ids = F.concat(*ids)
    return F.struct(all_ids.alias("ids"), F.concat(*types).alias("type_ids"), F.concat(*masks).alias("special_tokens_mask"), F.array_repeat(F.lit(1), F.size(all_ids)).alias("attention_mask"), F.concat(*sequences).alias("sequence_ids"))


def trim_offsets(tokens: Column, offsets: Column, add_prefix_space: bool = True) -> Column:
    """Offsets without the white space at the ends of byte-level tokens."""

    def one(pair: Column, i: Column) -> Column:
        token, start, end = pair["t"], pair["o"]["start"], pair["o"]["end"]
        lead = F.length(token) - F.length(F.regexp_replace(token, "\\A[Ġ\\s]+", ""))
        trail = F.length(token) - F.length(F.regexp_replace(token, "[Ġ\\s]+\\z", ""))
        if add_prefix_space:
            lead = F.when((lead == 1) & ((i == 0) | (start == 0)), 0).otherwise(lead)
        begin = F.least(start + lead, end)
        return F.struct(begin.alias("start"), F.greatest(end - trail, begin).alias("end"))

    return F.transform(F.arrays_zip(tokens.alias("t"), offsets.alias("o")), one)


# position maps of a wide encoding; null where there is none


def token_to_chars(offsets: Column, token: Column) -> Column:
    return F.get(offsets, token)


def char_to_token(offsets: Column, pos: Column, sequence_ids: Column | None = None, sequence: int = 0) -> Column:
    """The first token of the sequence that holds the place."""

    def holds(o: Column, i: Column) -> Column:
        inside = (o["start"] <= pos) & (pos < o["end"])
        return inside if sequence_ids is None else inside & (F.get(sequence_ids, i) == sequence)

    hit = F.array_position(F.transform(offsets, holds), F.lit(True))
    return (F.nullif(hit, F.lit(0)) - 1).cast("int")


def token_to_word(word_ids: Column, token: Column) -> Column:
    return F.get(word_ids, token)


def char_to_word(offsets: Column, word_ids: Column, pos: Column) -> Column:
    return F.get(word_ids, char_to_token(offsets, pos))


def word_to_tokens(word_ids: Column, word: Column) -> Column:
    """Struct of the word's first token and its number of tokens; null for an absent word."""
    count = F.when(word.isNotNull(), F.size(word_ids) - F.size(F.array_remove(word_ids, word)))
    return F.when(count > 0, F.struct((F.array_position(word_ids, word) - 1).cast("int").alias("first"), count.alias("count")))


def word_to_chars(offsets: Column, word_ids: Column, word: Column) -> Column:
    found = word_to_tokens(word_ids, word)
    return F.when(found.isNotNull(), F.struct(F.get(offsets, found["first"])["start"].alias("start"), F.get(offsets, found["first"] + found["count"] - 1)["end"].alias("end")))


def merge_encodings(first: Column, second: Column, growing_offsets: bool = False, fields: tuple[str, ...] = FIELDS) -> Column:
    """Two encoding structs, of ``fields``, as one; the second's offsets may go on from the first's last end."""
    shift = F.coalesce(F.try_element_at(first["offsets"], F.lit(-1))["end"], F.lit(0)) if growing_offsets else F.lit(0)
    parts = []
    for f in fields:
        moved = F.transform(second[f], lambda o: F.struct((o["start"] + shift).alias("start"), (o["end"] + shift).alias("end"))) if f == "offsets" else second[f]
        parts.append(F.concat(first[f], moved).alias(f))
    return F.struct(*parts)


def tall(df: DataFrame, encoding_col: str = "encoding", keys: list[str] | None = None) -> DataFrame:
    """A row for each token: ``keys``, ``window_index``, ``pos`` and those of the token's fields that the encoding has."""
    keys = keys or [c for c in df.columns if c not in (encoding_col, "window_index")]
    have = df.schema[encoding_col].dataType.names
    e, t = F.col(encoding_col), F.col("t")
    zipped = F.arrays_zip(*[e[f].alias(f) for f in have]) if len(have) > 1 else F.transform(e[have[0]], lambda x: F.struct(x.alias(have[0])))
    names = {"ids": "id", "tokens": "token", "word_ids": "word_id", "type_ids": "type_id", "special_tokens_mask": "special", "attention_mask": "attention", "sequence_ids": "sequence_id"}
    out = []
    for f in ("ids", "tokens", "word_ids", "offsets", "type_ids", "special_tokens_mask", "attention_mask", "sequence_ids"):
        if f in have:
            out += [t[f]["start"].alias("start"), t[f]["end"].alias("end")] if f == "offsets" else [t[f].alias(names[f])]
    return df.select(*keys, "window_index", F.posexplode(zipped).alias("pos", "t")).select(*keys, "window_index", "pos", *out)


def wide(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The tall form back to one encoding for each window."""
    fields = F.struct("pos", F.col("id").alias("ids"), F.col("type_id").alias("type_ids"), F.col("token").alias("tokens"), F.col("word_id").alias("word_ids"), F.struct("start", "end").alias("offsets"), F.col("special").alias("special_tokens_mask"), F.col("attention").alias("attention_mask"), F.col("sequence_id").alias("sequence_ids"))
    grouped = rows.groupBy(*keys, "window_index").agg(F.sort_array(F.collect_list(fields)).alias("t"))
    return grouped.select(*keys, "window_index", F.struct(*[F.col("t")[f].alias(f) for f in FIELDS]).alias("encoding"))
