"""Models, lattices, encodings, post-processors: goldens and brute force."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenloom.functions import processors as R
from tokenloom.operators import lookup, models
from tokenloom.operators.encoding import EncodingRow, longest_first, windows


def ids(model, word):
    return [t.id for t in model.tokens(word)]


def test_bpe_goldens():
    assert ids(models.BPE(vocab=dict(a=0, b=1, c=2, ab=3, abc=4), merges=["a b", ("ab", "c")]), "abc") == [4]
    assert ids(models.BPE(vocab=dict(a=0, b=1, c=2, d=3, ab=4, cd=5, abcd=6), merges=["a b", "c d", "ab cd"]), "abcd") == [6]
    assert ids(models.BPE(vocab={"你": 0, "好": 1, "世": 2, "界": 3, "你好": 4}, merges=["你 好"]), "你好世界") == [4, 2, 3]
    model = models.BPE(vocab=dict(hello=0, h=1, e=2, l=3, o=4), ignore_merges=True)
    assert ids(model, "hello") == [0] and {4, 3} <= set(ids(model, "world"))
    fallback = models.BPE(vocab={models.byte_token(b): b for b in range(256)}, byte_fallback=True)
    assert ids(fallback, "你好") == list("你好".encode())
    assert ids(models.BPE(vocab={"<unk>": 0, "a": 1}, unk_token="<unk>", fuse_unk=True), "xyaz") == [0, 1, 0]
    assert ids(models.BPE(vocab={"a": 1}), "xya") == [1]
    affixes = models.BPE(vocab={"a": 0, "##b": 1, "##c</w>": 2, "ab": 3, "abc</w>": 4}, merges=[("a", "##b"), ("ab", "##c</w>")], continuing_subword_prefix="##", end_of_word_suffix="</w>")
    assert ids(affixes, "abc") == [4]
    dropped = models.BPE(vocab=dict(a=0, b=1, ab=2), merges=["a b"], dropout=1.0, seed=3)
    assert ids(dropped, "abab") == [0, 1, 0, 1]


def brute_bpe(model, word):
    parts = [i for i, _, _ in model.symbols(word)]
    while True:
        found = [(model.ranks[p][0], i, model.ranks[p][1]) for i, p in enumerate(zip(parts, parts[1:])) if p in model.ranks]
        if not found:
            return parts
        _, i, made = min(found)
        parts[i : i + 2] = [made]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=24), st.integers(0, 10_000))
def test_bpe_is_least_rank_first(word, seed):
    chance = random.Random(seed)
    vocab, merges = dict(a=0, b=1, c=2), []
    for _ in range(8):
        a, b = chance.choice(list(vocab)), chance.choice(list(vocab))
        if a + b not in vocab:
            vocab[a + b] = len(vocab)
            merges.append((a, b))
    model = models.BPE(vocab=vocab, merges=merges)
    assert ids(model, word) == brute_bpe(model, word)


def test_wordpiece_and_wordlevel():
    model = models.WordPiece(vocab={"[UNK]": 0, "hel": 1, "##lo": 2})
    assert ids(model, "hello") == [1, 2]
    assert model.tokens("hellox") == [(0, "[UNK]", 0, 6)]
    assert ids(models.WordPiece(vocab={"[UNK]": 0, "a": 1, "##a": 2}, max_input_chars_per_word=3), "aaaa") == [0]
    assert ids(models.WordPiece(vocab={"a": 1}), "b") == []
    level = models.WordLevel(vocab={"<unk>": "0", "a": "5"})
    assert ids(level, "a") == [5] and ids(level, "b") == [0]
    made = models.WordPiece.from_bpe(models.BPE(vocab=dict(a=0)))
    assert made.vocab == {"a": 0, "[UNK]": 1}


def test_unigram_goldens():
    model = models.Unigram(vocab=[["<unk>", 0.0], ["a", 0.0], ["b", 0.0], ["ab", 2.0]], unk_id=0)
    assert ids(model, "ab") == [3]
    assert model.tokens("xyz") == [(0, "xyz", 0, 3)]
    assert [t.value for t in models.Unigram(vocab=[["<unk>", 0.0]], unk_id=0, fuse_unk=False).tokens("xy")] == ["x", "y"]
    spelled = models.Unigram(vocab=[["<unk>", 0.0], *[[models.byte_token(b), -5.0] for b in range(256)]], unk_id=0, byte_fallback=True)
    assert [i - 1 for i in ids(spelled, "é")] == list("é".encode())


def abc():
    lattice = models.Lattice("ABC")
    for start, n, score, i in ((0, 1, 0, 3), (1, 1, 0, 4), (2, 1, 0, 5), (0, 2, 2, 6), (1, 2, 5, 7), (0, 3, 10, 8)):
        lattice.insert(start, n, score, i)
    return lattice


def test_lattice():
    lattice = abc()
    assert lattice.pieces(lattice.viterbi()) == ["ABC"]
    assert [lattice.pieces(p) for p, _ in lattice.nbest(10)] == [["ABC"], ["A", "BC"], ["AB", "C"], ["A", "B", "C"]]
    node, z = lattice.marginals()
    total = sum(map(math.exp, (10, 5, 2, 0)))
    assert z == pytest.approx(math.log(total)) and node[5] == pytest.approx(math.exp(10) / total)
    chance = random.Random(5)
    seen = {tuple(lattice.pieces(lattice.sample(0.1, chance))) for _ in range(400)}
    assert len(seen) == 4
    assert models.Lattice("x").viterbi() == []


@settings(max_examples=100, deadline=None)
@given(st.text("abc", min_size=1, max_size=8))
def test_unigram_is_best(word):
    vocab = [["<unk>", 0.0], ["a", -1.0], ["ab", -1.5], ["bc", -1.2], ["abc", -2.9], ["c", -1.1]]
    model = models.Unigram(vocab=vocab, unk_id=0)

    def all_(rest):
        if not rest:
            return [0.0]
        out = [model.scores[i][1] + s for e, i in model.prefixes(rest, 0) for s in all_(rest[e:])]
        return out if any(e == 1 for e, _ in model.prefixes(rest, 0)) else out + [model.unk_score + s for s in all_(rest[1:])]

    scores = sorted(all_(word), reverse=True)[:4]
    assert [s for _, s in model.nbest_pieces(word, 4)] == pytest.approx(scores)


def row(ids_, type_id=0):
    n = len(ids_)
    return EncodingRow(list(ids_), [type_id] * n, [f"t{i}" for i in ids_], list(range(n)), [(i, i + 1) for i in range(n)], [0] * n, [1] * n, [None] * n)


def test_windows_and_truncation():
    e = row(range(1, 11)).truncated(3, 1)
    assert e.ids == [1, 2, 3] and [o.ids[0] for o in e.overflow] == [3, 5, 7, 9]
    assert windows(10, 4, 1, "Left") == [(6, 10), (3, 7), (0, 4)]
    assert row([1, 2]).truncated(0).overflow[0].ids == [1, 2]
    with pytest.raises(ValueError):
        windows(10, 2, 2)
    for a, b, most, want in ((5, 5, 4, (2, 2)), (2, 10, 6, (2, 4)), (4, 4, 3, (1, 2)), (1, 1, 5, (1, 1))):
        assert longest_first(a, b, most) == want


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 40), st.integers(1, 10), st.integers(0, 9), st.sampled_from(["Right", "Left"]))
def test_windows_cover(n, most, stride, direction):
    if stride >= most:
        return
    parts = windows(n, most, stride, direction)
    assert {i for s, e in parts for i in range(s, e)} == set(range(n))
    assert all(e - s <= most for s, e in parts)


def test_padding_and_maps():
    e = row([10, 20], 1).padded(5, direction="Left")
    assert (e.ids, e.attention_mask, e.type_ids) == ([0, 0, 0, 10, 20], [0, 0, 0, 1, 1], [0, 0, 0, 1, 1])
    assert e.padded(5) is e and e.word_ids[:3] == [None] * 3
    r = EncodingRow([1, 2, 3], [0] * 3, list("abc"), [0, 0, 1], [(0, 2), (2, 3), (4, 6)], [0] * 3, [1] * 3, [None] * 3)
    assert r.char_to_token(2) == 1 and r.char_to_token(3) is None and r.char_to_word(5) == 1
    assert r.word_to_tokens(0) == (0, 2) and r.word_to_chars(0) == (0, 3) and r.word_to_chars(9) is None
    assert r.token_to_chars(9) is None and r.token_to_sequence(1) == 0 and r.sequence_range(0) == (0, 3)
    merged = r.merged(r, growing_offsets=True)
    assert merged.offsets[3:] == [(6, 8), (8, 9), (10, 12)]


def test_processors():
    a, b = row([12, 14]), row([15])
    roberta = R.RobertaProcessing(cls=("<s>", 0), sep=("</s>", 2)).process(a, b)
    assert roberta.ids == [0, 12, 14, 2, 2, 15, 2] and set(roberta.type_ids) == {0}
    template = R.TemplateProcessing(single="[CLS] $0 [SEP]", pair=["[CLS]:0", "$A:0", "[SEP]:0", "$B:0", "[SEP]:1"], special_tokens={"[CLS]": {"ids": [1], "tokens": ["[CLS]"]}, "[SEP]": {"ids": [0], "tokens": ["[SEP]"]}})
    both = template.process(a, b)
    assert both.ids == [1, 12, 14, 0, 15, 0] and both.type_ids == [0, 0, 0, 0, 0, 1]
    assert template.added(False) == 2 and template.added(True) == 3
    bert = R.BertProcessing().process(a, b)
    assert bert.ids == [101, 12, 14, 102, 15, 102] and bert.special_tokens_mask == [1, 0, 0, 1, 0, 1] and bert.sequence_ids == [None, 0, 0, None, 1, None]
    assert len(R.BertProcessing().process(row(range(6)).truncated(2), row(range(4)).truncated(2)).overflow) == 2 * 2 + 1
    assert len(R.BertProcessing().process_list([a, b, b])) == 2
    trimmed = R.ByteLevelProcessing(add_prefix_space=False).process(EncodingRow([1], [0], ["Ġab"], [0], [(0, 3)], [0], [1], [None]), None)
    assert trimmed.offsets == [(1, 3)]
    chain = R.SequenceProcessing(processors=[R.ByteLevelProcessing(), R.BertProcessing()])
    assert chain.process(a, None).ids == [101, 12, 14, 102] and chain.added(False) == 2


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=14))
def test_repeats(text):
    assert lookup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    found = lookup.repeated_substrings(text, 1)
    for offset, n, frequency in found:
        piece = text[offset : offset + n]
        assert sum(text.startswith(piece, i) for i in range(len(text))) == frequency >= 2
