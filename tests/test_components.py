"""Goldens of normalizers, pre-tokenizers and decoders; the Column forms give the same as the string forms."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.functions import decoders as D
from tokenloom.functions import normalizers as N
from tokenloom.functions import pretokenizers as P
from tokenloom.functions.aligned import Aligned

TEXTS = ["", " ", "Hello, world!", "  HELLO  ", "你好 world", "abc123def 45", "don't we'll  x", "été Å ﬁ", "a\x00b\x07\tc​d", "İΑΣ ς", "Œuvre \U0001f600!", "a|b||c", "▁x y", "naïve café", "hello你好мир", "тест 12-34", "line\nbreak\r\n", "über alles"]

NORMALIZERS = [N.NFC(), N.NFD(), N.NFKC(), N.NFKD(), N.Lowercase(), N.Uppercase(), N.Strip(), N.Strip(strip_right=False), N.StripAccents(), N.Prepend(prepend="▁"), N.Replace(pattern={"Regex": "l+"}, content="$L"), N.Replace(pattern="o", content="0"), N.ByteLevel(), N.Nmt(), N.BertNormalizer(), N.BertNormalizer(lowercase=False, handle_chinese_chars=False), N.Sequence(normalizers=[N.Strip(), N.Lowercase()])]
PRETOKENIZERS = [P.BertPreTokenizer(), P.Whitespace(), P.WhitespaceSplit(), P.Digits(), P.Digits(individual_digits=True), P.ByteLevel(), P.ByteLevel(add_prefix_space=False, use_regex=False), P.CharDelimiterSplit(delimiter="|"), P.Punctuation(), P.Punctuation(behavior="removed"), P.Punctuation(behavior="MergedWithPrevious"), P.Punctuation(behavior="merged_with_next"), P.Split(pattern={"Regex": "[0-9]+"}, behavior="isolated"), P.Split(pattern="l", behavior="contiguous", merge_runs=True), P.FixedLength(length=2), P.UnicodeScripts(), P.Metaspace(), P.Metaspace(prepend_scheme="never"), P.Metaspace(split=False), P.Sequence(pretokenizers=[P.WhitespaceSplit(), P.Digits(individual_digits=True)])]


@pytest.mark.parametrize("part", NORMALIZERS, ids=lambda p: p.type_name)
def test_normalizer_columns_and_alignment(spark, part):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string").select("t", part.column(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r["n"] == (None if r["t"] is None else part(r["t"])), repr(r["t"])
        if r["t"]:
            aligned = part.apply(Aligned.of(r["t"]))
            assert aligned.text == r["n"] and len(aligned.spans) == len(aligned.text)


@pytest.mark.parametrize("part", PRETOKENIZERS, ids=lambda p: p.type_name)
def test_pretokenizer_columns(spark, part):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string").select("t", part.column(F.col("t")).alias("p")).collect()
    for r in rows:
        assert r["p"] == (None if r["t"] is None else part(r["t"])), repr(r["t"])


@pytest.mark.parametrize(
    ("part", "text", "pieces"),
    [
        (P.BertPreTokenizer(), "Hello, world!", ["Hello", ",", "world", "!"]),
        (P.Whitespace(), "Hello, world!", ["Hello", ",", "world", "!"]),
        (P.BertPreTokenizer(), "Hello   world", ["Hello", "world"]),
        (P.BertPreTokenizer(), "", []),
        (P.WhitespaceSplit(), "Hello, world!", ["Hello,", "world!"]),
        (P.Digits(), "abc123def", ["abc", "123", "def"]),
        (P.Digits(individual_digits=True), "abc123def", ["abc", "1", "2", "3", "def"]),
        (P.Punctuation(), "Hello, world!", ["Hello", ",", " world", "!"]),
        (P.Punctuation(behavior="removed"), "Hello, world!", ["Hello", " world"]),
        (P.CharDelimiterSplit(delimiter="|"), "a|b|c", ["a", "b", "c"]),
        (P.Metaspace(), "Hello World", ["▁Hello", "▁World"]),
        (P.Metaspace(), " Hello", ["▁Hello"]),
        (P.Metaspace(prepend_scheme="never"), "Hello World", ["Hello", "▁World"]),
        (P.Sequence(pretokenizers=[P.WhitespaceSplit(), P.Digits(individual_digits=True)]), "hello123 world", ["hello", "1", "2", "3", "world"]),
        (P.Split(pattern={"Regex": "[0-9]+"}, behavior="isolated"), "abc123def456", ["abc", "123", "def", "456"]),
        (P.FixedLength(length=4), "abcdefgh", ["abcd", "efgh"]),
        (P.FixedLength(length=2), "abcde", ["ab", "cd", "e"]),
        (P.UnicodeScripts(), "helloмир", ["hello", "мир"]),
        (P.UnicodeScripts(), "hello world", ["hello world"]),
        (P.UnicodeScripts(), "hello你好", ["hello", "你好"]),
        (P.Split(pattern="-", behavior="removed", invert=True), "a-b", ["a", "b"]),
        (P.Split(pattern="-", behavior="removed", invert=True, apply_invert=True), "a-b", ["-"]),
    ],
)
def test_pretokenizer_goldens(part, text, pieces):
    assert part(text) == pieces


def test_normalizer_goldens():
    assert N.Strip()("  hello  ") == "hello"
    assert N.Sequence(normalizers=[N.Strip(), N.Lowercase()])("  HELLO  ") == "hello"
    assert N.BertNormalizer()("你好") == " 你  好 "
    assert N.Prepend(prepend="x")("") == "x"
    with pytest.raises(ValueError):
        P.FixedLength(length=0)
    with pytest.raises(ValueError):
        P.Sequence(pretokenizers=[])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_properties(text):
    """Forms agree with Unicode, tiling pre-tokenizers lose nothing, offsets are in range and in order."""
    text = text.encode("utf-8", "ignore").decode()
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        assert Aligned.of(text).normalized(form).text == unicodedata.normalize(form, text)
    for part in (P.Digits(), P.Punctuation(), P.FixedLength(length=3), P.UnicodeScripts()):
        pieces = part.split(Aligned.of(text))
        assert "".join(p.text for p in pieces) == text
        assert [s for p in pieces for s in p.spans] == [(i, i + 1) for i in range(len(text))]
    coded = P.ByteLevel(add_prefix_space=False)(text)
    assert D.ByteLevel().decode(coded) == text
    for n in NORMALIZERS:
        out = n.apply(Aligned.of(text))
        assert len(out.spans) == len(out.text) and all(0 <= s <= e <= len(text) for s, e in out.spans)


DECODERS = [D.BPEDecoder(suffix="</w>"), D.BPEDecoder(), D.ByteLevel(), D.WordPiece(), D.WordPiece(cleanup=False), D.Metaspace(), D.Metaspace(prepend_scheme="never"), D.CTC(), D.CTC(cleanup=False), D.ByteFallback(), D.Fuse(), D.Strip(content="t", start=2, stop=1), D.Replace(pattern="o", content="0"), D.Replace(pattern={"Regex": "(l)(o)"}, content="$2$1"), D.Sequence(decoders=[D.ByteFallback(), D.Strip(), D.Fuse()]), D.Sequence(decoders=[])]
TOKENS = [[], ["he", "##llo", "world", "!"], ["hel</w>", "lo</w>"], ["▁Hey", "▁friend!"], ["<pad>", "<pad>", "h", "e", "e", "l", "l", "<pad>", "l", "o", "o", "o", "<pad>"], ["<0xE4>", "<0xB8>", "<0xAD>", "x", "<0xFF>"], ["Ġhello", "Ã©"], ["tt t", " do not", "ca n't", "|"]]


@pytest.mark.parametrize("part", DECODERS, ids=lambda p: p.type_name)
def test_decoder_columns(spark, part):
    rows = spark.createDataFrame([(t,) for t in [*TOKENS, None]], "t array<string>").select("t", part.column(F.col("t")).alias("d")).collect()
    for r in rows:
        assert r["d"] == (None if r["t"] is None else part.decode(r["t"])), r["t"]


def test_decoder_goldens():
    assert D.Metaspace().decode(["▁Hey", "▁friend!"]) == " Hey friend!"
    assert D.Metaspace(prepend_scheme="never").decode(["▁Hey", "▁friend!"]) == "Hey friend!"
    assert D.WordPiece().decode(["do", "##n", "##'", "##t"]) == "don't"
    assert D.WordPiece().decode(["hello", "."]) == "hello."
    assert D.CTC().chain(TOKENS[4]) == ["h", "e", "l", "l", "o"]
    assert D.ByteFallback().decode(["<0xE4>", "<0xB8>"]) == "��"
    assert D.BPEDecoder(suffix="</w>").decode(["he</w>", "llo</w>"]) == "he llo"
