"""Whole tokenizers on strings and DataFrames: added tokens, truncation, padding, offsets, streaming, JSON, files."""

import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.functions import decoders as D
from tokenloom.functions import normalizers as N
from tokenloom.functions import pretokenizers as P
from tokenloom.functions import processors as R
from tokenloom.functions.aligned import BYTE_CHARS, CHAR_BYTES
from tokenloom.operators import lookup, models, shape
from tokenloom.operators.encoding import FIELDS
from tokenloom.plans import batches as B
from tokenloom.plans.added import AddedToken, find_all, find_leftmost_longest
from tokenloom.plans.tokenizer import Padding, Tokenizer, Truncation
from tokenloom.sources import definition, vocabularies
from tokenloom.sources.registry import build, component, dump
from tokenloom.streaming import decode as streaming
from tokenloom.streaming.decode import decode_rows


def bytelevel(**parts):
    return Tokenizer(models.BPE(vocab={c: b for b, c in enumerate(BYTE_CHARS)}), pre_tokenizer=P.ByteLevel(add_prefix_space=False), decoder=D.ByteLevel(), **parts)


def level(**parts):
    vocab = {"<unk>": 0, "hello": 1, "world": 2, "!": 3}
    return Tokenizer(models.WordLevel(vocab=vocab), normalizer=N.Lowercase(), pre_tokenizer=P.Whitespace(), **parts)


def test_pipeline_golden():
    tok = Tokenizer(models.BPE(vocab={"<unk>": 0, "hello": 1, "world": 2, "!": 3}, unk_token="<unk>"), pre_tokenizer=P.BertPreTokenizer())
    e = tok.encode("hello world!")
    assert len(e) == 11 and e.ids[-1] == 3
    assert tok.encode("").ids == []


def test_offsets():
    e = level().encode("  Hello   WÖRLD!", offsets="char")
    assert e.offsets == [(2, 7), (10, 15), (15, 16)] and e.word_ids == [0, 1, 2]
    assert level().encode("é😀 hello", offsets="byte").offsets[-1] == (7, 12)
    assert level().encode("é😀 hello", offsets="utf16").offsets[-1] == (4, 9)
    tok = Tokenizer(models.WordLevel(vocab={"<unk>": 0}), normalizer=N.NFD(), pre_tokenizer=P.Whitespace())
    assert tok.encode("é x").offsets == [(0, 1), (2, 3)]


def test_added_tokens():
    tok = level().add_tokens(["<s>"], special=True).add_tokens([AddedToken("wor", normalized=True, single_word=True), AddedToken("[M]", lstrip=True, rstrip=True)])
    assert [t.id for t in tok.added.tokens] == [4, 5, 6]
    assert tok.encode("hello WOR world").ids == [1, 5, 2]
    e = tok.encode("hello  [M] world")
    assert e.ids == [1, 6, 2] and e.offsets[1] == (5, 11) and e.special_tokens_mask == [0, 0, 0]
    assert tok.encode("<s>").ids != [4]
    assert tok.with_(encode_special_tokens=True).encode("<s>hello").ids == [4, 1]
    assert tok.vocab_size() == 7 and tok.token_to_id("[M]") == 6 and tok.id_to_token(6) == "[M]" and tok.token_to_id("nope") is None
    assert tok.decode([1, 4, 2, 99]) == "hello world" and tok.decode([1, 4], skip_special=False) == "hello <s>"
    assert level().add_tokens(["hello"]).vocab_size() == 5  # in both: counted twice
    assert find_leftmost_longest(["a", "ab", "b"], "abab") == [(1, 0, 2), (1, 2, 4)]
    assert find_all(["a", "ab", "b"], "ab") == [(0, 0, 1), (1, 0, 2), (2, 1, 2)]


def test_truncation_padding_pairs():
    bert = R.BertProcessing(cls=("[C]", 9), sep=("[S]", 8))
    tok = level(post_processor=bert, truncation=Truncation(4, 1), padding=Padding(6, pad_id=7))
    e = tok.encode("hello world hello world")
    assert e.ids == [9, 1, 2, 8, 7, 7] and [o.ids for o in e.overflow] == [[9, 2, 1, 8], [9, 1, 2, 8]]
    pair = level(post_processor=bert).encode("hello world", "hello")
    assert pair.ids == [9, 1, 2, 8, 1, 8] and pair.type_ids == [0, 0, 0, 0, 1, 1]
    assert level(post_processor=bert).encode("hello", "").ids == [9, 1, 8]
    batch = level(padding=Padding(multiple=4)).encode_batch(["hello", "hello world hello world hello"])
    assert [len(b) for b in batch] == [8, 8]
    assert level().encode("hello", "world").type_ids == [0, 1]
    with pytest.raises(ValueError):
        Truncation(4, 4)


def test_frames(spark):
    df = spark.createDataFrame([(1, "hello world hello", "x"), (2, None, "y"), (3, "", "z")], "k int, text string, other string")
    tok = level(truncation=Truncation(2))
    rows = {(r["k"], r["window_index"]): r["encoding"] for r in tok.encode_frame(df).collect()}
    assert rows[1, 0]["ids"] == [1, 2] and rows[1, 1]["ids"] == [1] and rows[2, 0] is None and rows[3, 0]["ids"] == []
    assert {r["k"]: r["ids"] for r in tok.ids_frame(df).collect()} == {1: [1, 2], 2: None, 3: []}
    left = level(truncation=Truncation(2, direction="Left")).ids_frame(df).collect()
    assert left[0]["ids"] == [2, 1]
    full = level().encode_frame(df)
    tall = shape.tall(full, keys=["k"])
    assert tall.count() == 3
    back = shape.wide(tall, ["k"]).collect()[0]["encoding"]
    assert back == full.where("k = 1").collect()[0]["encoding"]
    words = df.select("k", F.array(F.lit("hello"), F.lit("nope")).alias("w"))
    e = level().encode_frame(words, "w", words=True).collect()[0]["encoding"]
    assert e["ids"] == [1, 0] and e["word_ids"] == [None, None]
    assert {r["decoded"] for r in level().decode_frame(level().ids_frame(df)).collect()} == {"hello world hello", None, ""}
    assert level().vocab_frame(spark).count() == 4
    empty = df.where("false")
    assert tok.encode_frame(empty).count() == 0 and tok.ids_frame(empty).count() == 0
    assert "ids" in str(tok.ids_frame(df.select("text"), columns=[]).columns)


def test_shapes_follow_the_python_forms(spark):
    df = spark.range(0, 12).select(F.sequence(F.lit(1), F.col("id").cast("int")).alias("a")).select(F.when(F.size("a") > 1, F.col("a")).otherwise(F.array().cast("array<int>")).cast("array<bigint>").alias("a"))
    from tokenloom.operators.encoding import windows

    for direction in ("Right", "Left"):
        rows = shape.stride_windows(df, "a", 4, 1, direction).collect()
        for r in rows:
            s, e = windows(len(r["a"]), 4, 1, direction)[r["window_index"]] if r["a"] else (0, 0)
            assert r["window"] == r["a"][s:e]
    padded = shape.pad_batch(df.select(F.col("a").alias("ids"), (F.size("a") % 2).alias("b")), ["ids"], batch_col="b", multiple=8).collect()
    assert {len(r["ids"]) for r in padded} == {16} or {len(r["ids"]) for r in padded} <= {8, 16}


def test_json_round_trip(tmp_path, spark):
    tok = Tokenizer(
        models.BPE(vocab={"a": 0, "b": 1, "ab": 2, "<unk>": 3}, merges=["a b"], unk_token="<unk>", fuse_unk=True, dropout=None),
        normalizer=N.Sequence(normalizers=[N.NFC(), N.Replace(pattern={"Regex": "x+"}, content="b"), N.BertNormalizer()]),
        pre_tokenizer=P.Sequence(pretokenizers=[P.Metaspace(prepend_scheme="first"), P.Split(pattern="-", behavior="isolated")]),
        post_processor=R.TemplateProcessing(single="[CLS] $A", special_tokens={"[CLS]": {"ids": [7], "tokens": ["[CLS]"]}}),
        decoder=D.Sequence(decoders=[D.CTC(pad_token="q"), D.WordPiece()]),
        added_tokens=[AddedToken("<s>", special=True)],
        truncation=Truncation(9, 2, "OnlyFirst", "Left"),
        padding=Padding(12, 1, 2, "p", "Left", 4),
    )
    again = definition.from_string(definition.to_string(tok))
    assert again.to_json() == tok.to_json()
    assert again.encode("a-bxx <s>").ids == tok.encode("a-bxx <s>").ids
    definition.save(tok, tmp_path / "tokenizer.json")
    assert definition.from_file(tmp_path / "tokenizer.json").to_json() == tok.to_json()
    assert definition.from_shared_file(spark, str(tmp_path / "tokenizer.json")).to_json() == tok.to_json()
    (tmp_path / "m").mkdir()
    definition.save(tok, tmp_path / "m" / "tokenizer.json")
    assert definition.from_folder(tmp_path, "m").to_json() == tok.to_json()
    for bad, error in (("", ValueError), ("{}", ValueError), ('{"model": {"type": "Nope"}}', NotImplementedError)):
        with pytest.raises(error):
            definition.from_string(bad)
    with pytest.raises(FileNotFoundError):
        definition.from_file(tmp_path / "none.json")
    with pytest.raises(NotImplementedError):
        build("decoder", {"type": "Nope"})
    polymorphic = definition.from_string(json.dumps({"model": {"vocab": {"a": "0", "b": 1, "ab": "2"}, "merges": [["a", "b"]]}, "padding": {"type": {"Fixed": 5}}, "truncation": {"type": "only_second", "direction": "nonsense"}}))
    assert polymorphic.encode("ab").ids[:1] == [2] and polymorphic.padding.fixed == 5 and polymorphic.truncation.strategy == "OnlySecond"
    for kind, data in (("normalizer", {"type": "Bert"}), ("pre_tokenizer", {"type": "Metaspace", "add_prefix_space": False, "prepend_scheme": "never"}), ("decoder", {"type": "Replace", "pattern": {"String": "a"}, "content": "b"})):
        assert dump(build(kind, dump(build(kind, data)))) == dump(build(kind, data))
    with pytest.raises(ValueError):
        build("pre_tokenizer", {"type": "Metaspace", "add_prefix_space": False, "prepend_scheme": "always"})


def test_extension():
    @component("normalizer", "Reverse", twice=False)
    class Reverse(N.Normalizer):
        def apply(self, text):
            return type(text)(text.text[::-1], None)

    assert build("normalizer", {"type": "Reverse"})("abc") == "cba"


def test_vocabulary_files(tmp_path, spark):
    bpe = models.BPE(vocab={"a": 0, "b": 1, "ab": 2}, merges=["a b"])
    vocab, merges = vocabularies.save_bpe(bpe, str(tmp_path), "x")
    assert vocabularies.load_bpe(vocab, merges).merges == [("a", "b")]
    assert [tuple(r) for r in vocabularies.read_vocab_json(spark, vocab).collect()] == [("a", 0), ("b", 1), ("ab", 2)]
    assert [tuple(r) for r in vocabularies.read_merges(spark, merges).collect()] == [(0, "a", "b")]
    piece = models.WordPiece(vocab={"[UNK]": 0, "a": 1})
    vocabularies.save_wordpiece(piece, str(tmp_path / "v.txt"))
    assert vocabularies.load_wordpiece(str(tmp_path / "v.txt")).vocab == piece.vocab
    assert [tuple(r) for r in vocabularies.read_vocab_lines(spark, str(tmp_path / "v.txt")).collect()] == [("[UNK]", 0), ("a", 1)]
    level_ = models.WordLevel(vocab={"b": 1, "a": 0})
    vocabularies.save_wordlevel(level_, str(tmp_path / "l.json"))
    assert vocabularies.load_wordlevel(str(tmp_path / "l.json")).vocab == level_.vocab
    uni = models.Unigram(vocab=[["<unk>", 0.0], ["a", -1.5]], unk_id=0)
    vocabularies.save_unigram(uni, str(tmp_path / "u.json"))
    assert vocabularies.load_unigram(str(tmp_path / "u.json")).vocab == uni.vocab
    assert [tuple(r) for r in vocabularies.read_unigram(spark, str(tmp_path / "u.json")).collect()] == [("<unk>", 0, 0.0), ("a", 1, -1.5)]


def test_decode_stream():
    tok = Tokenizer(models.BPE(vocab={models.byte_token(b): b for b in range(256)}, byte_fallback=True), decoder=D.ByteFallback())
    stream = tok.decode_stream()
    assert [stream.step(b) for b in (0xE4, 0xB8, 0xAD)] == [None, None, "中"]
    text = "héllo wörld 中文 😀!"
    stream = bytelevel().decode_stream()
    chunks = [stream.step(i) for i in bytelevel().encode(text).ids]
    assert "".join(c for c in chunks if c) == text and None in chunks
    stream.reset()
    assert stream.ids == []


def test_streaming_equals_batch(spark, tmp_path):
    texts = ["héllo 中文", "plain", "😀 ok"]
    tok = bytelevel()
    rows = [(k, i, t) for k, text in enumerate(texts) for i, t in enumerate(tok.encode(text).ids)]
    schema = "stream_id int, seq bigint, token_id bigint"
    half = len(rows) // 2
    for n, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    query = streaming.decode_stream(source, tok).writeStream.format("memory").queryName("chunks").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    out = spark.table("chunks").collect()
    assert all(r["error"] is None for r in out)
    for k, text in enumerate(texts):
        assert "".join(r["chunk"] or "" for r in sorted((r for r in out if r["stream_id"] == k), key=lambda r: r["seq"])) == text
    batch = streaming.decode_rows(spark.createDataFrame(rows, schema), tok).where("chunk is not null").collect()
    assert sorted(map(tuple, batch)) == sorted((r["stream_id"], r["seq"], r["chunk"], None) for r in out if r["chunk"] is not None)


def test_sql_functions(spark):
    lookup.register_sql(spark, level())
    assert spark.sql("select tok_encode_ids('Hello world !') as a, tok_count('hello') as b, tok_decode(array(1L, 2L)) as c").first() == ([1, 2, 3], 1, "hello world")
    assert [tuple(r) for r in spark.sql("select * from tok_tokens('hello world')").collect()] == [(0, 1, "hello", 0, 5), (1, 2, "world", 6, 11)]
    assert spark.sql("select * from tok_repeats('abcabc')").count() == 3


def test_precompiled():
    import base64
    import struct

    # one key, "a" to "b": root at 0 leads with offset 1 to units[1 ^ 97], a leaf whose value is at its own offset
    units = [0] * 256
    units[0] = 1 << 10
    units[1 ^ 97] = (2 << 10) | (1 << 8) | 97
    units[(1 ^ 97) ^ 2] = 0x80000000 | 0
    blob = struct.pack("<I", len(units) * 4) + struct.pack(f"<{len(units)}I", *units) + b"b\0"
    part = N.Precompiled(precompiled_charsmap=base64.b64encode(blob).decode())
    assert part("xaxa") == "xbxb" and N.Precompiled(precompiled_charsmap="")("xa") == "xa"


FRENCH = ["Le café, l’été: 12 œufs…", "", None, "a  b\tc 𝒳y", "word " * 300, "ΣΑΣ İstanbul ß", "x" * 400]
CAFE = [*"abcdefghijklmnopqrstuvwxyz", "é", "œ", "ca", "caf", "café", "wo", "rd", "word", "<unk>"]


@pytest.mark.parametrize("pre", [P.Whitespace(), P.BertPreTokenizer(), P.Punctuation(), P.Split(pattern=" ", behavior="merged_with_next"), P.Metaspace(), P.ByteLevel()])
@pytest.mark.parametrize("normalizer", [None, N.Lowercase(), N.NFD()])
def test_flat_arrays_are_the_same(pre, normalizer):
    """Batches encoded to flat arrays give what the one-text encoder gives with places in spans of the original."""
    vocab = {t: i for i, t in enumerate(CAFE)}
    tok = Tokenizer(models.BPE(vocab=vocab, merges=[("c", "a"), ("ca", "f"), ("caf", "é"), ("w", "o"), ("r", "d"), ("wo", "rd")], unk_token="<unk>"), normalizer=normalizer, pre_tokenizer=pre)
    slow = Tokenizer(tok.model, normalizer=normalizer, pre_tokenizer=pre)
    slow.direct = slow.plain = False
    want = [None if t is None else slow.encode(t) for t in FRENCH]
    assert B.flat_ids(tok, FRENCH).to_pylist() == [None if e is None else e.ids for e in want]
    if tok.direct:
        for unit in ("char", "byte", "none"):
            got = B.flat_encodings(tok, FRENCH, FIELDS, unit).to_pylist()
            rows = B.as_structs([None if t is None else slow.encode(t, offsets=unit) for t in FRENCH], FIELDS).to_pylist()
            assert got == rows
    assert [e.offsets for e in want if e is not None] == [tok.encode(t).offsets for t in FRENCH if t is not None]


def test_names_that_clash(spark):
    tok = Tokenizer(models.WordLevel(vocab={"<unk>": 0, "a": 1}), pre_tokenizer=P.Whitespace())
    df = spark.createDataFrame([("a b", 1, 2, 3, 4, 5)], "text string, ids int, encoding int, window_index int, _text int, decoded int")
    assert tok.ids_frame(df).columns == [*df.columns, "ids_"] and tok.ids_frame(df).first()["ids_"] == [1, 0]
    assert tok.encode_frame(df).columns == [*df.columns, "window_index_", "encoding_"] and tok.encode_frame(df, fields=("ids",)).first()["encoding_"].ids == [1, 0]
    out = tok.decode_frame(tok.ids_frame(df), "ids_")
    assert out.columns == [*df.columns, "ids_", "decoded_"] and out.first()["decoded_"] == "a <unk>"


def test_seeded_chance_hangs_on_the_text_alone(spark):
    """Dropout gives a text the same tokens in whatever partition and beside whatever rows."""
    vocab = {t: i for i, t in enumerate(CAFE)}
    tok = Tokenizer(models.BPE(vocab=vocab, merges=[("c", "a"), ("ca", "f"), ("w", "o"), ("r", "d"), ("wo", "rd")], unk_token="<unk>", dropout=0.5, seed=4), pre_tokenizer=P.Whitespace())
    texts = [f"word caf word {i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    one, many = (dict(map(tuple, tok.ids_frame(x, columns=["k"]).collect())) for x in (df.coalesce(1), df.where("k % 3 = 0").unionByName(df.where("k % 3 <> 0")).repartition(4)))
    assert one == many and len({str(v[:3]) for v in one.values()}) > 1


@settings(max_examples=150, deadline=None)
@given(st.text("abcdé ", max_size=12), st.lists(st.tuples(st.text("abcdé", min_size=1, max_size=3), st.integers(-9, -1)), max_size=9))
def test_trie_path_is_the_lattice_path(text, pieces):
    model = models.Unigram(vocab=[["<unk>", 0.0], *([t, float(s)] for t, s in dict(pieces).items())], unk_id=0, fuse_unk=False)
    lattice = model.lattice(text)
    assert model.best(text) == [(lattice.nodes[k][0], lattice.nodes[k][1], lattice.nodes[k][3]) for k in lattice.viterbi()]


def test_compiled_charsmap():
    made = N.Precompiled(precompiled_charsmap=N.compile_charsmap({"é": "e", "ß": "ss", "A": "", "你": "you"}))
    assert made("éßAB你") == "essByou" and made("e\u0301") == "e\u0301"


def test_decoded_bytes_are_the_decoder_s():
    tok = Tokenizer(models.BPE(vocab={**{c: b for b, c in enumerate(BYTE_CHARS)}, "Ġthe": 300, "日": 301}, merges=[]), pre_tokenizer=P.ByteLevel(), decoder=D.ByteLevel())
    rows = [[300, 0xC3, 0xA9], [0xC3], None, [], [999, -1, 301, 300]]
    table = B.ByteTable({i: t for t, i in tok.model.vocabulary().items()}, CHAR_BYTES)
    assert table.decode(pa.array(rows, pa.list_(pa.int64()))) == [None if r is None else tok.decode(r) for r in rows]


def test_batch_streams_report_errors(spark):
    tok = Tokenizer(models.WordLevel(vocab={"a": 0, "b": 1}), pre_tokenizer=P.Whitespace())
    rows = spark.createDataFrame([(1, 0, 0), (1, 1, None), (1, 2, 1)], "stream_id int, seq bigint, token_id bigint")
    assert [tuple(r) for r in decode_rows(rows, tok).orderBy("seq").collect()] == [(1, 0, "a", None), (1, 1, None, None), (1, 2, "b", None)]


def test_small_tables_are_spread(spark):
    one = spark.range(100).coalesce(1)
    assert B.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and B.spread(one, 0).rdd.getNumPartitions() == 1


def test_vocabulary_is_ranked_over_ranges(spark):
    rows = spark.createDataFrame([(w,) for w in "b a b c c c d a".split()], "word string").repartition(3)
    assert sorted(map(tuple, lookup.frequent_vocab(rows).collect())) == [("a", 2), ("b", 3), ("c", 1)]
    assert lookup.frequent_vocab(rows.where("false")).count() == 0
