"""Pre-tokenizers: one string to ordered pieces, with places, and as ``array<string>`` Columns.

All columns but ``Sequence`` over several parts are one Catalyst expression; a
sequence flattens the arrays of its parts. Empty pieces are dropped. Null gives
null, an empty text an empty array.
"""

from __future__ import annotations

import functools
from itertools import chain

import numpy as np
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.aligned import BYTE_CHARS, WS, Aligned, python_regex
from tokenloom.functions.normalizers import ByteLevel as ByteLevelNormalizer
from tokenloom.sources.registry import component, parse_pattern

REMOVED, ISOLATED, MERGED_PREVIOUS, MERGED_NEXT, CONTIGUOUS = "removed", "isolated", "mergedwithprevious", "mergedwithnext", "contiguous"


def behavior_name(behavior: str) -> str:
    name = behavior.lower().replace("_", "")
    if name not in (REMOVED, ISOLATED, MERGED_PREVIOUS, MERGED_NEXT, CONTIGUOUS):
        raise ValueError(f"unknown behavior: {behavior!r}")
    return name


def ranges(matches: list[tuple[int, int]], n: int, behavior: str, runs: bool = False) -> list[tuple[int, int]]:
    """Pieces of a text of ``n`` code points whose delimiters are ``matches``.

    Contiguous isolates each delimiter, as isolated does; with ``runs`` it joins
    neighbouring delimiters.
    """
    tiles: list[tuple[int, int, bool]] = []
    at = 0
    for i, j in matches:
        if i > at:
            tiles.append((at, i, False))
        tiles.append((i, j, True))
        at = j
    if at < n:
        tiles.append((at, n, False))
    if behavior == REMOVED:
        return [(i, j) for i, j, m in tiles if not m]
    out: list[list[int]] = []
    before = None
    for i, j, m in tiles:
        if (behavior == MERGED_PREVIOUS and m and before is False) or (behavior == MERGED_NEXT and not m and before is True) or (behavior == CONTIGUOUS and runs and m and before is True):
            out[-1][1] = j
        else:
            out.append([i, j])
        before = m
    return [(i, j) for i, j in out]


def tiled(c: Column, delimiter: str, behavior: str, runs: bool = False) -> Column:
    """The same as a Column: one regular expression that tiles the text, by behavior."""
    d, other = f"(?:{delimiter})", f"(?:(?!{delimiter})[\\s\\S])++"  # possessive: a loop, no recursion
    pattern = {
        REMOVED: f"{d}|{other}",
        ISOLATED: f"{d}|{other}",
        CONTIGUOUS: f"{d}++|{other}" if runs else f"{d}|{other}",
        MERGED_PREVIOUS: f"{other}{d}?|{d}",
        MERGED_NEXT: f"{d}(?:{other})?|{other}",
    }[behavior]
    pieces = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.filter(pieces, lambda x: ~x.rlike(f"\\A{d}\\z")) if behavior == REMOVED else pieces


def _firsts(texts: list[str]) -> np.ndarray:
    """Where each text begins, and the last ends, in all of them one after the other."""
    return np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))


class PreTokenizer:
    def split(self, text: Aligned) -> list[Aligned]:
        raise NotImplementedError

    def __call__(self, text: str) -> list[str]:
        """Texts of the pieces, without places."""
        return [p.text for p in self.split(Aligned(text))]

    #: Whether pieces are parts of the text as it is, which :meth:`spans` then gives.
    exact = False

    def spans(self, text: str) -> list[tuple[int, int]]:
        raise NotImplementedError

    def places(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of one that is exact: all texts as one, where each piece begins and ends in it, each text's number of pieces, and where each text begins."""
        spans = [self.spans(t) for t in texts]
        counts = np.fromiter(map(len, spans), np.int64, len(spans))
        firsts = _firsts(texts)
        found = np.fromiter(chain.from_iterable(chain.from_iterable(spans)), np.int64, 2 * int(counts.sum())) + np.repeat(firsts[:-1], 2 * counts)
        return "".join(texts), found[::2], found[1::2], counts, firsts

    def parts(self, texts: list[str], places: bool = False) -> tuple[list[str], np.ndarray, np.ndarray | None]:
        """Pieces of all texts, each text's number of them and, if asked of one that is exact, where each begins in its text."""
        if not places:
            found = [self(t) for t in texts]
            return list(chain.from_iterable(found)), np.fromiter(map(len, found), np.int64, len(found)), None
        spans = [self.spans(t) for t in texts]
        pieces = [t[i:j] for t, s in zip(texts, spans) for i, j in s]
        return pieces, np.fromiter(map(len, spans), np.int64, len(spans)), np.fromiter((i for s in spans for i, _ in s), np.int64, len(pieces))

    def column(self, c: Column) -> Column:
        raise NotImplementedError


class _Matches(PreTokenizer):
    """Pieces are the matches of ``java``."""

    java = ""
    exact = True

    def prepare(self) -> None:
        self.compiled = regex.compile(python_regex(self.java))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(text)]

    def split(self, text: Aligned) -> list[Aligned]:
        return [text.slice(i, j) for i, j in _Matches.spans(self, text.text)]

    def __call__(self, text: str) -> list[str]:
        return self.compiled.findall(text)

    def column(self, c: Column) -> Column:
        return F.regexp_extract_all(c, F.lit(self.java), F.lit(0))


@functools.cache
def _set_of_each(sets: tuple[str, ...]) -> np.ndarray:
    """For each code point the number of the set that has it, from 1 on; 0 where none has."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(len(every), np.uint8)
    for k, s in enumerate(sets, 1):
        for m in regex.finditer(python_regex(f"[{s}]+"), every):
            out[m.start() : m.end()] = k
    return out


class _Runs(_Matches):
    """Pieces are the longest runs of code points of one of ``sets``, which have none in common; ``java`` says the same."""

    sets: tuple[str, ...] = ()

    def places(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        text, firsts = "".join(texts), _firsts(texts)
        kinds = _set_of_each(self.sets)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        begins = np.ones(len(kinds), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
        begins[firsts[firsts < len(kinds)]] = True
        starts = np.flatnonzero(begins)
        ends, wanted = np.append(starts, len(kinds))[1:], kinds[starts] != 0
        starts, ends = starts[wanted], ends[wanted]
        return text, starts, ends, np.diff(np.searchsorted(starts, firsts)), firsts

    def parts(self, texts: list[str], places: bool = False) -> tuple[list[str], np.ndarray, np.ndarray | None]:
        text, starts, ends, counts, firsts = self.places(texts)
        pieces = [text[i:j] for i, j in zip(starts.tolist(), ends.tolist())]
        return pieces, counts, starts - np.repeat(firsts[:-1], counts) if places else None


_BERT_WORD = "\\p{L}\\p{Mn}\\p{Nd}\\p{Pc}"


@component("pre_tokenizer", "BertPreTokenizer")
class BertPreTokenizer(_Runs):
    """Words, and runs of what is neither word nor white space."""

    sets = (_BERT_WORD, f"^{_BERT_WORD}{WS}")
    java = f"[{_BERT_WORD}]+|[^{_BERT_WORD}{WS}]+"


_WORD = "\\p{L}\\p{Nl}\\p{M}\\p{Nd}\\p{Pc}\\x{200C}\\x{200D}"


@component("pre_tokenizer", "Whitespace")
class Whitespace(_Runs):
    sets = (_WORD, f"^{_WORD}{WS}")
    java = f"[{_WORD}]+|[^{_WORD}{WS}]+"


@component("pre_tokenizer", "WhitespaceSplit")
class WhitespaceSplit(_Runs):
    sets = (f"^{WS}",)
    java = f"[^{WS}]+"


@component("pre_tokenizer", "Digits", individual_digits=False)
class Digits(_Matches):
    def prepare(self) -> None:
        self.java = "\\p{Nd}|[^\\p{Nd}]+" if self.individual_digits else "\\p{Nd}+|[^\\p{Nd}]+"
        super().prepare()


@component("pre_tokenizer", "ByteLevel", add_prefix_space=True, use_regex=True, trim_offsets=True)
class ByteLevel(_Matches):
    """Optional leading space, split by contractions, letters, numbers and the rest, then bytes as characters."""

    exact = False

    java = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{WS}\\p{{L}}\\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"

    def split(self, text: Aligned) -> list[Aligned]:
        if self.add_prefix_space and text.text and text.text[0] != " ":
            text = text.prepended(" ")
        pieces = super().split(text) if self.use_regex else [text] if text.text else []
        return [ByteLevelNormalizer().apply(p) for p in pieces]

    def __call__(self, text: str) -> list[str]:
        if self.add_prefix_space and text and text[0] != " ":
            text = " " + text
        pieces = self.compiled.findall(text) if self.use_regex else [text] if text else []
        return [p.translate(_ASCII_CHARS) if p.isascii() else byte_encode(p) for p in pieces]

    def column(self, c: Column) -> Column:
        if self.add_prefix_space:
            c = F.when((c != "") & ~c.startswith(" "), F.concat(F.lit(" "), c)).otherwise(c)
        pieces = super().column(c) if self.use_regex else F.when(c == "", F.array().cast("array<string>")).when(c.isNotNull(), F.array(c))
        return F.transform(pieces, ByteLevelNormalizer().column)


_ASCII_CHARS = dict(enumerate(BYTE_CHARS[:128]))


def byte_encode(text: str) -> str:
    """A text's UTF-8 bytes as printable characters."""
    return "".join(BYTE_CHARS[b] for b in text.encode("utf-8", "replace"))


class _Delimited(PreTokenizer):
    """Pieces between, or with, the matches of ``java``, by ``behavior``."""

    java = ""
    runs = False

    def prepare(self) -> None:
        self.compiled = regex.compile(python_regex(self.java)) if self.java else None

    def how(self) -> str:
        return behavior_name(self.behavior)

    exact = True

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = [m.span() for m in self.compiled.finditer(text) if m.end() > m.start()] if self.compiled else []
        return ranges(found, len(text), self.how(), self.runs)

    def __call__(self, text: str) -> list[str]:
        return [text[i:j] for i, j in self.spans(text)]

    def split(self, text: Aligned) -> list[Aligned]:
        return [text.slice(i, j) for i, j in self.spans(text.text)]

    def column(self, c: Column) -> Column:
        if not self.java:
            return F.when(c == "", F.array().cast("array<string>")).when(c.isNotNull(), F.array(c))
        return tiled(c, self.java, self.how(), self.runs)


@component("pre_tokenizer", "CharDelimiterSplit", "Delimiter", delimiter=None)
class CharDelimiterSplit(_Delimited):
    behavior = REMOVED
    needed = ("delimiter",)

    def prepare(self) -> None:
        self.delimiter = self.delimiter[:1]
        self.java = regex.escape(self.delimiter, literal_spaces=True)
        super().prepare()


@component("pre_tokenizer", "Punctuation", behavior="isolated")
class Punctuation(_Delimited):
    java = "[\\p{P}\\x{21}-\\x{2F}\\x{3A}-\\x{40}\\x{5B}-\\x{60}\\x{7B}-\\x{7E}]"


@component("pre_tokenizer", "Split", pattern=None, behavior="removed", invert=False, apply_invert=False, merge_runs=False)
class Split(_Delimited):
    """By a literal or an expression. ``invert`` is kept but has no effect unless ``apply_invert`` is set."""

    needed = ("pattern",)

    def prepare(self) -> None:
        kind, expression = parse_pattern(self.pattern)
        self.java = regex.escape(expression, literal_spaces=True) if kind == "String" else expression
        self.runs = self.merge_runs
        super().prepare()

    def spans(self, text: str) -> list[tuple[int, int]]:
        if not (self.invert and self.apply_invert):
            return super().spans(text)
        found = [m.span() for m in self.compiled.finditer(text) if m.end() > m.start()]
        return ranges(ranges(found, len(text), REMOVED), len(text), self.how(), self.runs)

    def column(self, c: Column) -> Column:
        if self.invert and self.apply_invert:
            return tiled(c, f"(?:(?!{self.java})[\\s\\S])+", self.how(), self.runs)
        return super().column(c)


@component("pre_tokenizer", "FixedLength", length=5)
class FixedLength(PreTokenizer):
    def prepare(self) -> None:
        if self.length <= 0:
            raise ValueError("length must be positive")

    def split(self, text: Aligned) -> list[Aligned]:
        return [text.slice(i, min(i + self.length, len(text.text))) for i in range(0, len(text.text), self.length)]

    def column(self, c: Column) -> Column:
        if self.length == 1:  # an empty pattern parts code points without a matcher
            return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
        return F.regexp_extract_all(c, F.lit(f"[\\s\\S]{{1,{self.length}}}"), F.lit(0))


#: Scripts by ranges; letters of the basic plane in none of them count as Latin.
_SCRIPTS = (
    "\\x{20000}-\\x{2FA1F}\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3000}-\\x{303F}\\x{3040}-\\x{30FF}\\x{31F0}-\\x{31FF}\\x{F900}-\\x{FAFF}",
    "\\x{AC00}-\\x{D7AF}\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}",
    "\\x{0400}-\\x{052F}",
    "\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}",
    "\\x{0900}-\\x{097F}\\x{0980}-\\x{0AFF}",
    "\\x{0E00}-\\x{0E7F}",
    "\\x{0590}-\\x{05FF}",
    "\\x{0370}-\\x{03FF}\\x{1F00}-\\x{1FFF}",
    "\\x{0530}-\\x{058F}",
    "\\x{10A0}-\\x{10FF}",
    "\\x{1000}-\\x{109F}",
    "\\x{1780}-\\x{17FF}",
    "\\x{0E80}-\\x{0EFF}",
    "\\x{0F00}-\\x{0FFF}",
)


@component("pre_tokenizer", "UnicodeScripts")
class UnicodeScripts(_Matches):
    """Pieces of one script; code points common to all scripts go with their neighbours."""

    def prepare(self) -> None:
        # one set test a code point: the scripts' letters exclude each other, so a piece is all up to another script's letter
        common, every = "\\p{Nd}\\p{No}\\p{Z}\\p{Cc}\\p{Cf}\\p{Co}\\p{P}\\p{Sm}\\p{Sc}\\p{Sk}\\p{So}", "".join(_SCRIPTS)
        neutral = f"\\x{{0}}-\\x{{40}}\\x{{5B}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}{common}\\x{{10000}}-\\x{{1FFFF}}\\x{{2FA20}}-\\x{{10FFFF}}[^\\p{{L}}{every}]"
        latin = f"[A-Za-z[\\p{{L}}&&[\\x{{80}}-\\x{{FFFF}}]&&[^{every}]]][\\x{{0}}-\\x{{7F}}{common}[^{every}]]*+"
        pieces = [latin, *(f"[{s}&&[^{common}]][{neutral}{s}]*+" for s in _SCRIPTS)]
        self.java = f"[{neutral}]*+(?:{'|'.join(pieces)})|[{neutral}]++"
        self.compiled = regex.compile(python_regex(self.java), regex.VERSION1)


@component("pre_tokenizer", "Metaspace", replacement="\u2581", prepend_scheme="always", split=True)
class Metaspace(PreTokenizer):
    """Spaces as a mark that begins a piece; the mark is put before the text always, at its beginning (first), or never."""

    @classmethod
    def from_json(cls, data: dict) -> Metaspace:
        scheme = str(data.get("prepend_scheme") or ("never" if data.get("add_prefix_space") is False else "always")).lower()
        if data.get("add_prefix_space") is False and scheme != "never":
            raise ValueError("add_prefix_space is false, so prepend_scheme must be never")
        return cls(replacement=data.get("replacement") or "\u2581", prepend_scheme=scheme, split=data.get("split", True))

    def prepare(self) -> None:
        self.cut = self.split_on = self.__dict__.pop("split")
        mark = regex.escape(self.replacement)
        self.compiled = regex.compile(f"{mark}(?:(?!{mark})[\\s\\S])*+|(?:(?!{mark})[\\s\\S])++" if len(self.replacement) > 1 else f"{mark}[^{mark}]*+|[^{mark}]++")

    def to_json(self) -> dict:
        return {"type": "Metaspace", "replacement": self.replacement, "prepend_scheme": self.prepend_scheme, "split": self.cut}

    def __call__(self, text: str) -> list[str]:
        text = text.replace(" ", self.replacement)
        if text and self.prepend_scheme != "never" and not text.startswith(self.replacement):
            text = self.replacement + text
        return self.compiled.findall(text) if self.cut else [text] if text else []

    def split(self, text: Aligned) -> list[Aligned]:
        mark = self.replacement
        text = text.map(lambda c: mark if c == " " else c)
        first = self.prepend_scheme == "always" or (self.prepend_scheme == "first" and text.start == 0 and (not text.spans or text.spans[0][0] == 0))
        if text.text and first and not text.text.startswith(mark):
            text = text.prepended(mark)
        if not self.cut:
            return [text] if text.text else []
        found = [m.span() for m in regex.finditer(regex.escape(mark), text.text)]
        return [text.slice(i, j) for i, j in ranges(found, len(text.text), MERGED_NEXT)]

    def column(self, c: Column) -> Column:
        mark = self.replacement
        c = F.replace(c, F.lit(" "), F.lit(mark))
        if self.prepend_scheme != "never":
            c = F.when((c != "") & ~c.startswith(mark), F.concat(F.lit(mark), c)).otherwise(c)
        if not self.cut:
            return F.when(c == "", F.array().cast("array<string>")).when(c.isNotNull(), F.array(c))
        return tiled(c, regex.escape(mark), MERGED_NEXT)


@component("pre_tokenizer", "Sequence", pretokenizers=None)
class Sequence(PreTokenizer):
    children = "pretokenizers"

    def prepare(self) -> None:
        if not self.pretokenizers:
            raise ValueError("an empty sequence")

    def split(self, text: Aligned) -> list[Aligned]:
        pieces = [text]
        for p in self.pretokenizers:
            pieces = [q for piece in pieces for q in p.split(piece)]
        return pieces

    def column(self, c: Column) -> Column:
        pieces = self.pretokenizers[0].column(c)
        for p in self.pretokenizers[1:]:
            pieces = F.flatten(F.transform(pieces, p.column))
        return pieces
