"""Added tokens: ids, flags, and their extraction from texts in two phases."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

import regex

from tokenloom.functions.aligned import WHITE, Aligned
from tokenloom.functions.normalizers import Normalizer


@dataclass(frozen=True)
class AddedToken:
    content: str
    id: int | None = None
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool = False
    special: bool = False

    def to_json(self) -> dict:
        return asdict(self)


def find_leftmost_longest(patterns: list[str], text: str) -> list[tuple[int, int, int]]:
    """``(pattern, start, end)``: leftmost, of those the longest, without overlap."""
    order = sorted(range(len(patterns)), key=lambda i: -len(patterns[i]))
    index = {patterns[i]: i for i in reversed(order)}
    compiled = regex.compile("|".join(regex.escape(patterns[i]) for i in order if patterns[i]) or r"(?!)")
    return [(index[m.group()], m.start(), m.end()) for m in compiled.finditer(text)]


def find_all(patterns: list[str], text: str) -> list[tuple[int, int, int]]:
    """Every occurrence of every pattern, overlapping ones too, by end and then longest first."""
    out = []
    for i, p in enumerate(patterns):
        at = text.find(p) if p else -1
        while at >= 0:
            out.append((i, at, at + len(p)))
            at = text.find(p, at + 1)
    return sorted(out, key=lambda x: (x[2], x[1], x[0]))


class AddedVocabulary:
    """Added tokens in order of their ids; built anew when tokens are added."""

    def __init__(self, tokens: list[AddedToken], model_size: int, model_ids: dict[str, int], normalizer: Normalizer | None, encode_special: bool = False):
        known: dict[str, AddedToken] = {}
        next_id = model_size
        for t in tokens:
            if not t.content:
                continue
            if t.content in known:
                known[t.content] = replace(t, id=known[t.content].id)
                continue
            given = t.id if t.id is not None else model_ids.get(t.content)
            if given is None:
                given = next_id
            next_id = max(next_id, given + 1)
            known[t.content] = replace(t, id=given)
        self.tokens = list(known.values())
        self.by_content = known
        self.by_id = {t.id: t for t in self.tokens}
        self.normalizer = normalizer
        self.encode_special = encode_special
        on = [t for t in self.tokens if encode_special or not t.special]
        self.raw = [t for t in on if not t.normalized]
        self.after = [(t, normalizer(t.content) if normalizer else t.content) for t in on if t.normalized]
        self.raw_match = self._compile([t.content for t in self.raw])
        self.after_match = self._compile([c for _, c in self.after])

    @staticmethod
    def _compile(contents: list[str]):
        order = sorted({c for c in contents if c}, key=lambda c: -len(c))
        return regex.compile("|".join(map(regex.escape, order))) if order else None

    def is_special(self, content: str) -> bool:
        found = self.by_content.get(content)
        return found is not None and found.special

    @staticmethod
    def _cut(text: str, compiled, tokens: dict[str, AddedToken]) -> list[tuple[int, int, AddedToken | None]]:
        if compiled is None:
            return [(0, len(text), None)] if text else []
        out, at = [], 0
        for m in compiled.finditer(text):
            token, (i, j) = tokens[m.group()], m.span()
            if i < at:
                continue
            if token.single_word:
                left, right = text[i - 1 : i], text[j : j + 1]
                if any(c and (c.isalnum() or c == "_") for c in (left, right)):
                    continue
            while token.lstrip and i > at and text[i - 1] in WHITE:
                i -= 1
            while token.rstrip and j < len(text) and text[j] in WHITE:
                j += 1
            if i > at:
                out.append((at, i, None))
            out.append((i, j, token))
            at = j
        if at < len(text):
            out.append((at, len(text), None))
        return out

    def extract(self, text: Aligned) -> list[tuple[Aligned, AddedToken | None]]:
        """Segments of a text: added tokens, and normalized text between them."""
        out: list[tuple[Aligned, AddedToken | None]] = []
        raw = {t.content: t for t in self.raw}
        after = {c: t for t, c in reversed(self.after)}
        for i, j, token in self._cut(text.text, self.raw_match, raw):
            part = text.slice(i, j)
            if token is not None:
                out.append((part, token))
                continue
            if self.normalizer is not None:
                part = self.normalizer.apply(part)
                part.start = i
            for k, n, found in self._cut(part.text, self.after_match, after):
                out.append((part.slice(k, n), found))
        return out
