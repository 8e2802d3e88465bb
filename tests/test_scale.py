"""Steps whose time or memory grew too fast, against plain code."""

import pickle
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tokenloom.functions import decoders as D
from tokenloom.functions import normalizers as N
from tokenloom.functions import pretokenizers as P
from tokenloom.functions import processors as R
from tokenloom.functions.aligned import Aligned, text_parts
from tokenloom.operators import lookup, models, shape
from tokenloom.operators.encoding import FIELDS, EncodingRow, merge_all
from tokenloom.plans import batches as B
from tokenloom.plans import tokenizer as T
from tokenloom.plans.added import AddedToken
from tokenloom.plans.tokenizer import Padding, Tokenizer, Truncation


def test_scripts_count_letters_beyond_the_basic_plane_as_common(spark):
    texts = ["a\U0001d400д", "д\U00010000\U00010001你", "1. \U0001d400", "aд你\U00020001ᄀ1 .", "〇a、٠م", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    part = P.UnicodeScripts()
    assert [r.p for r in rows.select(part.column(F.col("t")).alias("p")).collect()] == [part(t) for t in texts]
    assert part(texts[0]) == ["a\U0001d400", "д"]


def test_scripts_test_each_code_point_against_sets_alone():
    assert not regex.search(r"\(\?[!=<]", P.UnicodeScripts().java)  # no lookaround: a run costs one test a code point


def test_texts_become_python_strings_a_few_at_a_time():
    texts = pa.array(["é" * 400_000, None, "", *["x" * 300_000] * 9, "y"])
    parts = list(text_parts(texts))
    assert [t for p in parts for t in p.to_pylist()] == texts.to_pylist()
    assert len(parts) >= 3 and max(sum(len(t or "") for t in p.to_pylist()) for p in parts) <= 1 << 20
    assert [len(p) for p in text_parts(pa.array([], pa.string()))] == [0]
    assert [len(p) for p in text_parts(texts, 10)][-1] == 1


@pytest.mark.parametrize("part", [N.NFC(), N.NFD(), N.NFKC(), N.NFKD(), N.StripAccents()])
def test_forms_over_batches_of_several_parts(spark, part):
    texts = [("é é ﬁ ½ Å " * 90_000)[: 400_000 * k] for k in (1, 2)] + [None, "", "plain"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    assert [r.t for r in rows.select("i", part.column(F.col("t")).alias("t")).orderBy("i").collect()] == [None if t is None else part(t) for t in texts]


def test_charsmap_without_joining_code_points_is_a_translation():
    part = N.Precompiled(precompiled_charsmap=N.compile_charsmap({"é": "e", "é": "E", "\r\n": "\n", ".": "。", "...": "-", "ß": "ss"}))
    for text in ("Café... straße", "é", "a\r\nb.", "\r \n.", "", "\U0001f468‍\U0001f469."):
        assert part(text) == part.apply(Aligned(text)).text
    assert part("é.ß") == "e。ss"
    assert pickle.loads(pickle.dumps(part))("é.") == "e。"


@pytest.mark.parametrize("part", [N.Uppercase(), N.Lowercase()])
def test_case_of_every_code_point_between_others(spark, part):
    later = {0x19B, 0x264, 0x1C89, 0x1C8A}  # cased since Unicode 16, which Python may not know
    texts = ["".join(f"{chr(c)}aÉß" for c in range(i, i + 64) if c not in later) for i in range(0x20, 0x2000, 64)] + ["", None, "ΑΣ ΟΔΟΣ", "İSTANBUL", "straße", "\U00010400ß\U00010428"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = [r.t for r in rows.select("i", part.column(F.col("t")).alias("t")).orderBy("i").collect()]
    assert [(g, t) for g, t in zip(got, texts) if g != (None if t is None else part(t))] == []


def test_odd_case_letters_are_behind_one_test_of_their_range():
    assert N._class("İΣßŉᾀᾁ") == "\\x{DF}-\\x{DF}[\\x{100}-\\x{10FFFF}&&[\\x{130}-\\x{130}\\x{149}-\\x{149}\\x{3A3}-\\x{3A3}\\x{1F80}-\\x{1F81}]]"


def _tokens(pool, seed):
    rnd = random.Random(seed)
    return [[rnd.choice(pool) for _ in range(rnd.randint(0, 8))] for _ in range(1500)] + [[], None, [""], ["", ""], ["\x1f"], ["\x1f\x1f", "a"]]


@pytest.mark.parametrize(
    "part",
    [
        D.ByteFallback(),
        D.CTC(pad_token="a", word_delimiter_token="e", cleanup=False),
        D.CTC(),
        D.CTC(pad_token="\x1f"),
        D.Fuse(),
        D.Strip(content="t", start=2, stop=1),
        D.Strip(content="t", start=0, stop=2),
        D.Strip(content="\x1f", start=1, stop=1),
        D.Replace(pattern="he", content="H"),
        D.Replace(pattern="\x1fa", content=""),
        D.Sequence(decoders=[D.Strip(content="t", start=1, stop=0), D.Replace(pattern="he", content="HE"), D.Fuse(), D.Strip(content="a", start=9, stop=9)]),
        D.Sequence(decoders=[D.Replace(pattern="t", content=""), D.CTC(pad_token="a", word_delimiter_token="h"), D.Fuse()]),
    ],
)
def test_decoded_columns_are_what_plain_code_gives(spark, part):
    bytes_ = [f"<0x{b:02X}>" for b in (0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xC0, 0xE0, 0xF4, 0x90)] + ["<0xe2>"]
    rows = _tokens(bytes_, 1) + _tokens([*bytes_, "", "€", "x", "<0x4", "1>", "<0x41><0x42>", "Ā", "\x1f"], 2)
    rows += _tokens(["a", "e", "t", "tt", "the", "h", "he", "", " '", "'s", " .", " do not", "<pad>", "|", "\n", "ß", "\U0001f600", "ttt"], 3)
    rows += _tokens(["a", "\x1fa", "t\x1f", "\x1f", "t", "", "h"], 4) + [["t"] * 20_000, ["<0x41>"] * 20_000, ["<0xFF>"] * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t array<string>")
    got = [r.t for r in df.select("i", part.column(F.col("t")).alias("t")).orderBy("i").collect()]
    assert [(r, g) for r, g in zip(rows, got) if g != (None if r is None else part.decode(r))] == []


def test_null_tokens_are_left_out_of_decoded_columns(spark):
    df = spark.createDataFrame([(["a", None, "b"],), ([None],), ([None, "a\x1fb"],)], "t array<string>")
    for part in (D.Replace(pattern="a", content="A"), D.CTC(), D.Fuse()):
        fresh = part.chain_column(F.col("t"))
        assert [r[0] == r[1] for r in df.select(part.column(F.col("t")), F.array_join(fresh, "")).collect()] == [True] * 3


def test_decoders_take_few_steps_for_each_token(spark):
    rows = spark.range(1).select(F.array(F.lit("a")).alias("t"))
    plan = rows.select(D.ByteFallback().column(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_single_code_points_need_no_matcher(spark):
    texts = ["añ€\U0001f600\n\0 ", "", None, "é", "\U0001d400" * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    part = P.FixedLength(length=1)
    rows = df.select("i", part.column(F.col("t")).alias("p"))
    assert [r.p for r in rows.orderBy("i").collect()] == [None if t is None else part(t) for t in texts]
    assert "regexp_extract_all" not in rows._jdf.queryExecution().toString()


def test_windows_of_long_pairs_leave_in_bounded_batches(spark, monkeypatch):
    tok = Tokenizer(models.WordLevel(vocab={"<unk>": 0, "a": 1, "b": 2}), pre_tokenizer=P.WhitespaceSplit(), post_processor=R.BertProcessing(), truncation=Truncation(16, 2))
    sizes = []
    made = B.as_structs
    monkeypatch.setattr(B, "as_structs", lambda rows, fields: (sizes.append(sum(len(r) for r in rows if r)), made(rows, fields))[1])
    monkeypatch.setattr("tokenloom.plans.tokenizer.MOST_HELD", 500)
    rows = [("a " * 90, "b a " * 50), (None, "a"), ("a b", None), ("", "b")]
    df = spark.createDataFrame(rows, "t string, p string")
    sent = {}
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: sent.update(run=f) or self)
    tok.encode_frame(df, "t", "p", columns=[])
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["_text", "_pair"])
    out = [r for b in sent["run"](iter([batch])) for r in b.to_pylist()]
    expected = [(k, e.ids) for t, p in rows if t is not None for w in [tok.encode(t, p)] for k, e in enumerate([w, *w.overflow])]
    assert [(r["window_index"], r["encoding"]["ids"]) for r in out if r["encoding"] is not None] == expected
    assert len(sizes) > 3 and max(sizes) < 600


@pytest.mark.parametrize("part", [R.BertProcessing(), R.RobertaProcessing(trim_offsets=False)])
def test_windows_are_merged_at_once_as_one_by_one(part):
    tok = Tokenizer(models.WordLevel(vocab={"<unk>": 0, "a": 1}), pre_tokenizer=P.WhitespaceSplit(), post_processor=part, truncation=Truncation(12, 1))
    one = tok.encode("a b c d e f g h i j k l", "a a b a a c a a d a")
    for e in [one, *one.overflow]:
        a, b = e.sequence_range(0), e.sequence_range(1)
        assert [e.sequence_ids[i] for i in range(*a)] == [0] * (a[1] - a[0]) and [e.sequence_ids[i] for i in range(*b)] == [1] * (b[1] - b[0])
        assert len({len(getattr(e, f)) for f in FIELDS}) == 1
        assert [e.special_tokens_mask[i] for i in (0, len(e) - 1)] == [1, 1]
    merged = EncodingRow()
    parts = [e.slice(i, i + 1) for e in [one, *one.overflow] for i in range(len(e))]
    for p in parts:
        merged = merged.merged(p)
    assert merge_all(parts) == merged


@pytest.mark.parametrize("strategy", ["LongestFirst", "OnlyFirst", "OnlySecond"])
@pytest.mark.parametrize("padding", [None, Padding(20), Padding(5, pad_id=9, pad_type_id=2, direction="Left", multiple=7)])
@pytest.mark.parametrize("direction", ["Right", "Left"])
def test_gathered_windows_are_those_of_single_encodings(strategy, padding, direction):
    for cut in (None, Truncation(16, 2, strategy, direction)):
        tok = Tokenizer(models.WordLevel(vocab={"<unk>": 0, "a": 1, "b": 2}), pre_tokenizer=P.WhitespaceSplit(), post_processor=R.BertProcessing(), truncation=cut, padding=padding)
        for text, pair in (("a " * 9, "b " * 60), ("a b " * 40, "b " * 13), ("a", "b"), ("", "b"), ("a c " * 30, None), ("a", ""), ("", "")):
            for most in (3, 1 << 12):
                got = []
                for sizes, made in B.pair_windows(tok, text, pair, most):
                    ends = np.cumsum(sizes)
                    got += [{f: made[f][j - n : j].tolist() for f in B.PAIR_FIELDS} for n, j in zip(sizes, ends)]
                e = tok.encode(text, pair)
                assert got == [{f: getattr(w, f) for f in B.PAIR_FIELDS} for w in [e, *e.overflow]]


def test_gathered_pairs_of_a_table(spark):
    tok = Tokenizer(models.WordLevel(vocab={"<unk>": 0, "a": 1, "b": 2}), pre_tokenizer=P.WhitespaceSplit(), post_processor=R.BertProcessing(), truncation=Truncation(16, 2))
    rows = [(0, "a " * 30, "b a " * 20), (1, None, "a"), (2, "a b", None), (3, "", "b")]
    df = spark.createDataFrame(rows, "i int, t string, p string")
    out = tok.encode_frame(df, "t", "p", columns=["i"], offsets="none", fields=("ids", "type_ids")).orderBy("i", "window_index").collect()
    expected = []
    for i, t, p in rows:
        e = None if t is None else tok.encode(t, p)
        expected += [(i, 0, None)] if e is None else [(i, k, (w.ids, w.type_ids)) for k, w in enumerate([e, *e.overflow])]
    assert [(r.i, r.window_index, None if r.encoding is None else (r.encoding.ids, r.encoding.type_ids)) for r in out] == expected


@pytest.mark.parametrize("unk", [0, None])
def test_only_rare_words_of_a_large_vocabulary_are_shuffled(spark, monkeypatch, unk):
    words = ["the"] * 500 + [f"w{i}" for i in range(200) for _ in range(3)] + [f"once{i}" for i in range(50)] + [None]
    rows = spark.createDataFrame(list(enumerate(words)), "i int, word string")
    vocab = lookup.frequent_vocab(rows.where("word is not null"))
    whole = lookup.word_level(rows, vocab, unk).collect()
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 2_000)
    joined = lookup.word_level(rows, vocab, unk)
    assert sorted(joined.collect(), key=lambda r: r.i) == sorted(whole, key=lambda r: r.i)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 1 and "Union" in plan


@pytest.mark.parametrize("part", [P.Whitespace(), P.BertPreTokenizer(), P.WhitespaceSplit()])
def test_runs_are_found_without_a_matcher(part):
    texts = ["".join(map(chr, range(i, i + 4096))) for i in range(0, 0x110000, 4096) if not 0xD000 <= i < 0xE000]
    texts += ["".join(f"{chr(c)}a {chr(c)}." for c in range(i, i + 512)) for i in range(0, 0x3400, 512)] + ["", "ab", "cd", "", " ", "x y"]
    spans = [part.spans(t) for t in texts]
    part.compiled = None
    pieces, counts, begins = part.parts(texts, places=True)
    assert counts.tolist() == list(map(len, spans))
    assert begins.tolist() == [i for s in spans for i, _ in s]
    assert pieces == [t[i:j] for t, s in zip(texts, spans) for i, j in s]
    assert part.parts(texts)[0] == pieces and part.parts([])[0] == [] and part.parts(["", ""])[1].tolist() == [0, 0]


@pytest.mark.parametrize("part", [P.Punctuation(), P.ByteLevel(), P.Metaspace(), P.Digits(), P.FixedLength(length=3)])
def test_parts_of_many_texts_are_those_of_each(part):
    texts = ["Ab, c'd 12é.", "", " x", "a"]
    pieces, counts, _ = part.parts(texts)
    assert (pieces, counts.tolist()) == ([p for t in texts for p in part(t)], [len(part(t)) for t in texts])
    if part.exact:
        assert part.parts(texts, places=True)[2].tolist() == [i for t in texts for i, _ in part.spans(t)]


def _bpe_cases():
    rnd = random.Random(5)
    letters = "abcé\U0001f600"
    for k in range(12):
        vocab = {c: i for i, c in enumerate(["<unk>", *letters[: rnd.randint(3, 5)]])}
        merges = []
        for _ in range(rnd.randint(0, 14)):
            a, b = rnd.choice(list(vocab)), rnd.choice(list(vocab))
            if len(a + b) < 9:
                vocab.setdefault(a + b, len(vocab) + 3)
                merges.append((a, b))
        rnd.shuffle(merges)  # also merges that come before those that make their parts
        for options in ({}, {"unk_token": "<unk>"}, {"ignore_merges": True}, {"ignore_merges": True, "merge_on_miss": True}, {"byte_fallback": True, "unk_token": "<unk>"}, {"fuse_unk": True, "unk_token": "<unk>"}, {"continuing_subword_prefix": "b"}, {"end_of_word_suffix": "a"}):
            more = {models.byte_token(b): 500 + b for b in range(256)} if "byte_fallback" in options and k % 2 else {}
            yield models.BPE(vocab=vocab | more, merges=merges, **options)


def test_words_merged_together_are_as_words_alone():
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcéz\U0001f600") for _ in range(rnd.randint(0, 14))) for _ in range(300)] + ["", "z", "a" * 300, "ab" * 200, "z" * 200]
    cases = [*_bpe_cases(), models.WordLevel(vocab={"a": 5, "ab": 1, "<unk>": 9}), models.WordLevel(vocab={"a": 5}), models.WordPiece(vocab={"a": 0, "##b": 1, "[UNK]": 2})]
    for model in cases:
        for some in (words, [], [""], ["zz"]):
            made = model.tokens_many(some)
            ends = np.cumsum(made.sizes)
            got = [[models.Token(int(made.ids[i]), made.names[made.values[i]], int(made.starts[i]), int(made.ends[i])) for i in range(j - n, j)] for n, j in zip(made.sizes, ends)]
            assert got == [model.tokens(w) for w in some]


def test_new_words_of_a_batch_are_merged_together(monkeypatch):
    model = models.BPE(vocab={"a": 0, "b": 1, "ab": 2}, merges=[("a", "b")])
    monkeypatch.setattr(models.BPE, "tokens", None)
    monkeypatch.setattr(models.BPE, "merged", None)
    tok = Tokenizer(model, pre_tokenizer=P.Whitespace())
    assert B.flat_ids(tok, ["ab ba", None, "", "abab"]).to_pylist() == [[2, 1, 0], None, [], [2, 2]]


def _sent(monkeypatch, df, tok, **options):
    """The function that encode_frame hands to the workers."""
    sent = {}
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: sent.update(run=f) or self)
    tok.encode_frame(df, "t", columns=[], **options)
    return sent["run"]


def _text_batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.nulls(len(texts), pa.string())], ["_text", "_pair"])


@pytest.mark.parametrize("parts", [{"pre_tokenizer": P.Whitespace()}, {"added_tokens": [AddedToken("<mark>")]}])
def test_words_of_earlier_queries_are_forgotten(spark, monkeypatch, parts):
    monkeypatch.setattr(T, "_built", {})
    monkeypatch.setattr(T, "MOST_OTHERS", 50)
    df = spark.createDataFrame([("a",)], "t string")
    texts = [f"w{i} w{i + 1000} <mark>" for i in range(100)]
    for k in range(4):
        tok = Tokenizer(models.WordLevel(vocab={"<unk>": 0, f"v{k}": 1}), **parts)
        first = [b.to_pylist() for b in _sent(monkeypatch, df, tok)(iter([_text_batch(texts)]))]
        assert [r["encoding"]["ids"] for b in first for r in b] == [tok.encode(t).ids for t in texts]
        assert [t.held() > 0 for t in T._built.values()] == [False] * k + [True]


def test_long_pieces_kept_are_bounded_in_characters(monkeypatch):
    monkeypatch.setattr(T, "CACHED_CHARS", 1000)
    tok = Tokenizer(models.WordLevel(vocab={"<unk>": 0}))
    for i in range(500):
        tok.word(f"{i:100}")
    assert sum(map(len, tok.cache)) <= 1100


def test_rows_of_long_texts_are_encoded_a_few_at_a_time(spark, monkeypatch):
    tok = Tokenizer(models.WordLevel(vocab={"<unk>": 0}), added_tokens=[AddedToken("<mark>")])
    texts = ["x" * 150_000 + "<mark>" for _ in range(30)] + [None, ""]
    run = _sent(monkeypatch, spark.createDataFrame([("a",)], "t string"), tok, offsets="none", fields=("ids",))
    out = list(run(iter([_text_batch(texts)])))
    assert len(out) >= 4 and max(b.num_rows for b in out) <= 8
    assert [r["encoding"] and r["encoding"]["ids"] for b in out for r in b.to_pylist()] == [None if t is None else tok.encode(t).ids for t in texts]


def test_tokens_of_a_table_are_kept_as_numbers():
    table = B.WordTable(models.WordLevel(vocab={"<unk>": 0, "a": 1}))
    place, _ = table.take(table.look_up(f"w{i % 1000}" if i % 10 else "a" for i in range(5000)))
    assert list(table.names) == ["<unk>", "a"] and len(table.values) == len(table.ids) <= 1001
    assert [list(table.names)[table.values[p]] for p in place[:3]] == ["a", "<unk>", "<unk>"]


def test_places_of_words_hold_no_tuples(monkeypatch):
    tok = Tokenizer(models.WordLevel(vocab={"<unk>": 0}), pre_tokenizer=P.Whitespace())
    texts = ["é ab,cd \U0001f600", None, "", " x"]
    expected = [None if t is None else (tok.encode(t).offsets, tok.encode(t).word_ids) for t in texts]
    monkeypatch.setattr(P.Whitespace, "spans", None)
    got = B.flat_encodings(tok, texts, ("word_ids", "offsets"), "char").to_pylist()
    assert [r and ([(o["start"], o["end"]) for o in r["offsets"]], r["word_ids"]) for r in got] == expected


@pytest.mark.parametrize("part", [P.Whitespace(), P.BertPreTokenizer(), P.WhitespaceSplit(), P.Punctuation(), P.Digits(), P.CharDelimiterSplit(delimiter="a")])
@pytest.mark.parametrize("unit", ["char", "byte", "none"])
def test_places_alone_need_no_words(monkeypatch, part, unit):
    tok = Tokenizer(models.WordLevel(vocab={"<unk>": 0, "ab": 1}), normalizer=N.Lowercase(), pre_tokenizer=part)
    texts = ["É ab,cd \U0001f600 1ab2", None, "", " x", "aa", "  ", "▁ÀÉ", ""]
    fields = ("type_ids", "word_ids", "offsets", "attention_mask")
    rows = [None if t is None else tok.encode(t, offsets=unit) for t in texts]
    tok.forget()
    monkeypatch.setattr(B.WordTable, "look_up", None)
    monkeypatch.setattr(type(part), "parts", None)
    got = B.flat_encodings(tok, texts, fields, unit).to_pylist()
    assert [r and [r["type_ids"], r["word_ids"], [(o["start"], o["end"]) for o in r["offsets"]], r["attention_mask"]] for r in got] == [None if e is None else [e.type_ids, e.word_ids, e.offsets, e.attention_mask] for e in rows]
    assert tok.held() == 0 and B.flat_encodings(tok, [], fields, unit).to_pylist() == [] and B.flat_encodings(tok, [None, ""], fields, unit).to_pylist()[0] is None


@pytest.mark.parametrize("vocab", [{"ab": 1}, {"<unk>": 0, "ab": 1}])
def test_places_of_words_that_the_model_drops_are_dropped(vocab):
    tok = Tokenizer(models.WordLevel(vocab=vocab), pre_tokenizer=P.Whitespace())
    assert tok.model.whole == ("<unk>" in vocab)
    texts = ["x ab, ab", "x", None]
    got = B.flat_encodings(tok, texts, ("word_ids", "offsets"), "char").to_pylist()
    rows = [None if t is None else tok.encode(t) for t in texts]
    assert [r and (r["word_ids"], [(o["start"], o["end"]) for o in r["offsets"]]) for r in got] == [None if e is None else (e.word_ids, e.offsets) for e in rows]


def test_the_token_at_a_place_is_found_without_a_struct_of_each(spark):
    offsets = [[(0, 2), (3, 5), None, (5, 5), (5, 9), (5, 7)], [], None, [(None, 4), (0, None), (0, 4)], [(0, 3), (0, 3)]]
    sequences = [[0, 0, None, 1, 1, 1], [], None, [0, 0, 0], [1, 0]]
    df = spark.createDataFrame([(i, o, q) for i, (o, q) in enumerate(zip(offsets, sequences))], "i int, o array<struct<start:int,end:int>>, q array<int>")
    for pos in (-1, 0, 2, 4, 5, 6, 9):
        made = [shape.char_to_token(F.col("o"), F.lit(pos)), shape.char_to_token(F.col("o"), F.lit(pos), F.col("q"), 1)]
        rows = df.select("i", *[m.alias(n) for m, n in zip(made, "ab")])
        assert [f.dataType.simpleString() for f in rows.schema][1:] == ["int", "int"]
        hits = [[] if o is None else [i for i, p in enumerate(o) if p and None not in p and p[0] <= pos < p[1]] for o in offsets]
        expected = [((h or [None])[0], ([i for i in h if q[i] == 1] or [None])[0]) for h, q in zip(hits, sequences)]
        assert [(r.a, r.b) for r in rows.orderBy("i").collect()] == expected
        assert "struct(" not in rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_the_tokens_of_a_word_are_counted_without_a_lambda(spark, ansi):
    words = [[0, 1, None, 1, 2, 2], [], None, [None, 0, 0], [None]]
    offsets = [None if w is None else [(3 * k, 3 * k + 2) for k in range(len(w))] for w in words]
    df = spark.createDataFrame([(i, w, o) for i, (w, o) in enumerate(zip(words, offsets))], "i int, w array<int>, o array<struct<start:int,end:int>>")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for word in (0, 1, 2, 9, None):
            rows = df.select("i", shape.word_to_tokens(F.col("w"), F.lit(word).cast("int")).alias("t"), shape.word_to_chars(F.col("o"), F.col("w"), F.lit(word).cast("int")).alias("c"))
            at = [[] if w is None or word is None else [k for k, x in enumerate(w) if x == word] for w in words]
            expected = [((a[0], len(a)), (3 * a[0], 3 * (a[0] + len(a) - 1) + 2)) if a else (None, None) for a in at]
            assert [(r.t and tuple(r.t), r.c and tuple(r.c)) for r in rows.orderBy("i").collect()] == expected
            assert "lambda" not in rows._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
