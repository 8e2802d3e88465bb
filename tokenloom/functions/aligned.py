"""Strings with their places in the original, and character classes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: White space of Unicode, as the inside of a character class (the same in Python and Java).
WS = "\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
WHITE = frozenset(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def text_parts(texts: pa.Array, limit: int = 1 << 20) -> Iterator[pa.Array]:
    """An array of texts in slices of about ``limit`` bytes (one text at least); an empty one as it is."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(texts) or at == 0:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield texts.slice(at, end - at)
        at = end


def python_regex(pattern: str) -> str:
    """A Java-style pattern for the ``regex`` module: code points in braces, Unicode ``\\s``."""
    out, i = [], 0
    inside = False
    while i < len(pattern):
        if pattern.startswith("\\x{", i):
            end = pattern.index("}", i)
            out.append("\\U" + pattern[i + 3 : end].rjust(8, "0"))
            i = end + 1
            continue
        if pattern[i] == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if pattern[i] == "[":
            inside = True
        elif pattern[i] == "]":
            inside = False
        out.append(pattern[i])
        i += 1
    del inside
    return "".join(out)


class Aligned:
    """``text`` and, for each of its code points, the half-open span of the original that it stands for.

    ``spans`` is None where places aren't wanted; every operation then skips them.
    """

    __slots__ = ("text", "spans", "start")

    def __init__(self, text: str, spans: list[tuple[int, int]] | None = None, start: int = 0):
        self.text, self.spans, self.start = text, spans, start

    @classmethod
    def of(cls, text: str, places: bool = True) -> Aligned:
        return cls(text, [(i, i + 1) for i in range(len(text))] if places else None)

    def slice(self, i: int, j: int) -> Aligned:
        return Aligned(self.text[i:j], None if self.spans is None else self.spans[i:j], self.start + i)

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Place in the original of code points i to j; an empty range is where it would be."""
        if self.spans is None or not self.spans:
            return (0, 0)
        if i >= j:
            at = self.spans[min(i, len(self.spans) - 1)][0]
            return (at, at)
        part = self.spans[i:j]
        return (min(s for s, _ in part), max(e for _, e in part))

    def map(self, f: Callable[[str], str]) -> Aligned:
        """Replace each code point by a string (empty drops it)."""
        made = [f(c) for c in self.text]
        text = "".join(made)
        if self.spans is None:
            return Aligned(text, None, self.start)
        return Aligned(text, [s for m, s in zip(made, self.spans) for _ in m], self.start)

    def replaced(self, matches: Iterable[tuple[int, int]], content: str) -> Aligned:
        """Put ``content`` in the place of each match."""
        out, spans, at = [], [], 0
        for i, j in matches:
            out += [self.text[at:i], content]
            if self.spans is not None:
                spans += self.spans[at:i] + [self.span(i, j)] * len(content)
            at = j
        out.append(self.text[at:])
        if self.spans is not None:
            spans += self.spans[at:]
        return Aligned("".join(out), None if self.spans is None else spans, self.start)

    def prepended(self, content: str) -> Aligned:
        at = self.spans[0][0] if self.spans else 0
        return Aligned(content + self.text, None if self.spans is None else [(at, at)] * len(content) + self.spans, self.start)

    def normalized(self, form: str) -> Aligned:
        """Unicode normalization; code points that are composed or decomposed together share a span."""
        if self.text.isascii():
            return self
        if self.spans is None:
            return Aligned(unicodedata.normalize(form, self.text), None, self.start)
        out, spans = [], []
        i, n = 0, len(self.text)
        while i < n:
            j = i + 1
            while j < n:
                c = self.text[j]
                if not unicodedata.combining(c):
                    group = self.text[i:j]
                    if c.isascii() or unicodedata.normalize(form, group + c) == unicodedata.normalize(form, group) + unicodedata.normalize(form, c):
                        break
                j += 1
            made = unicodedata.normalize(form, self.text[i:j])
            out.append(made)
            spans += self.spans[i:j] if len(made) == j - i else [self.span(i, j)] * len(made)
            i = j
        return Aligned("".join(out), spans, self.start)


def byte_alphabet() -> list[str]:
    """The printable character of each byte: printable Latin-1 for itself, the others from U+0100 on."""
    out, extra = [], 0
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE:
            out.append(chr(b))
        else:
            out.append(chr(0x100 + extra))
            extra += 1
    return out


BYTE_CHARS = byte_alphabet()
CHAR_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}
#: Of U+0001 to U+00FF; byte 0 can't go through translate, which would drop it.
LATIN = "".join(map(chr, range(1, 256)))
LATIN_TO = "".join(BYTE_CHARS[1:])


def lower_one(c: str) -> str:
    """Lower case that never changes the number of code points."""
    made = c.lower()
    return made if len(made) == 1 else c


def upper_one(c: str) -> str:
    made = c.upper()
    return made if len(made) == 1 else c
