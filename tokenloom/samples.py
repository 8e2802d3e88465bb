"""Small literal vocabularies, the same for the queries and their SQL."""

from __future__ import annotations

LETTERS = list("abcdefghijklmnopqrstuvwxyzäöüßéèêçñíóúá0123456789.,;:!?'-_@#$%&*|()[]")
MERGE_PAIRS = [
    ("t", "h"), ("i", "n"), ("o", "n"), ("e", "r"), ("r", "e"), ("e", "n"), ("a", "n"), ("th", "e"), ("n", "d"), ("t", "i"), ("in", "g"), ("ti", "on"), ("a", "nd"), ("e", "s"), ("a", "t"), ("o", "r"), ("e", "d"), ("s", "t"),
    ("o", "u"), ("h", "a"), ("h", "e"), ("l", "y"), ("n", "t"), ("s", "h"), ("w", "h"), ("b", "l"), ("bl", "e"), ("th", "at"), ("o", "f"), ("c", "h"), ("s", "ch"), ("e", "i"), ("v", "er"), ("b", "er"), ("q", "u"), ("qu", "e"),
    ("l", "e"), ("o", "i"), ("a", "u"), ("au", "x"), ("é", "r"), ("m", "ent"), ("en", "t"), ("tion", "s"), ("w", "ith"), ("i", "th"), ("th", "is"), ("i", "s"),
]
BPE_VOCAB = {t: i for i, t in enumerate(dict.fromkeys(["<unk>", *LETTERS, *(a + b for a, b in MERGE_PAIRS)]))}
#: Merges whose parts and result the vocabulary has.
BPE_MERGES = [(a, b) for a, b in MERGE_PAIRS if a in BPE_VOCAB and b in BPE_VOCAB]
PIECES = ["the", "th", "tion", "ing", "and", "er", "on", "in", "re", "en", "st", "an", "nd", "ed", "es", "or", "at", "ou", "ha", "he", "ly", "nt", "sh", "wh", "ble", "that", "of", "sch", "ver", "que", "eau", "ment", "ción"]
WORDPIECE_VOCAB = {t: i for i, t in enumerate(dict.fromkeys(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *LETTERS[:-30], *PIECES, *("##" + t for t in LETTERS[:-30]), *("##" + t for t in PIECES)]))}
UNIGRAM_VOCAB = [["<unk>", 0.0], *[[t, -4.0 - i / 20] for i, t in enumerate(LETTERS[:-20])], *[[t, -3.0 - len(t) / 10 - i / 50] for i, t in enumerate(PIECES)], ["▁", -2.5], *[["▁" + t, -3.2 - i / 40] for i, t in enumerate(PIECES)]]


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_map(pairs: dict[str, int]) -> str:
    """A DuckDB map of strings to numbers."""
    return "map([" + ", ".join(map(sql_text, pairs)) + "], [" + ", ".join(map(str, pairs.values())) + "])"
