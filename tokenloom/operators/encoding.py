"""Encodings: parallel lists of a text's tokens, and the operations on them.

``EncodingRow`` holds plain lists; one row is one window. Windows beyond the
first are its ``overflow``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import chain

FIELDS = ("ids", "type_ids", "tokens", "word_ids", "offsets", "special_tokens_mask", "attention_mask", "sequence_ids")
MOST_DEPTH = 32


@dataclass
class EncodingRow:
    ids: list[int] = field(default_factory=list)
    type_ids: list[int] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)
    word_ids: list[int | None] = field(default_factory=list)
    offsets: list[tuple[int, int]] = field(default_factory=list)
    special_tokens_mask: list[int] = field(default_factory=list)
    attention_mask: list[int] = field(default_factory=list)
    sequence_ids: list[int | None] = field(default_factory=list)
    overflow: list[EncodingRow] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.ids)

    def slice(self, i: int, j: int) -> EncodingRow:
        return EncodingRow(*[getattr(self, f)[i:j] for f in FIELDS])

    def with_sequence(self, sequence: int) -> EncodingRow:
        return replace(self, sequence_ids=[sequence] * len(self), overflow=[o.with_sequence(sequence) for o in self.overflow])

    def with_type(self, type_id: int) -> EncodingRow:
        return replace(self, type_ids=[type_id] * len(self), overflow=[o.with_type(type_id) for o in self.overflow])

    # position mapping

    def token_to_chars(self, i: int) -> tuple[int, int] | None:
        return self.offsets[i] if 0 <= i < len(self) else None

    def char_to_token(self, pos: int, sequence: int = 0) -> int | None:
        for i, (s, e) in enumerate(self.offsets):
            if self._sequence(i) == sequence and s <= pos < e:
                return i
        return None

    def token_to_word(self, i: int) -> int | None:
        return self.word_ids[i] if 0 <= i < len(self) else None

    def char_to_word(self, pos: int, sequence: int = 0) -> int | None:
        i = self.char_to_token(pos, sequence)
        return None if i is None else self.word_ids[i]

    def word_to_tokens(self, word: int, sequence: int = 0) -> tuple[int, int] | None:
        """First token and number of tokens of a word."""
        at = [i for i, w in enumerate(self.word_ids) if w == word and self._sequence(i) == sequence]
        return (at[0], len(at)) if at else None

    def word_to_chars(self, word: int, sequence: int = 0) -> tuple[int, int] | None:
        found = self.word_to_tokens(word, sequence)
        return None if found is None else (self.offsets[found[0]][0], self.offsets[found[0] + found[1] - 1][1])

    def token_to_sequence(self, i: int) -> int | None:
        return self._sequence(i) if 0 <= i < len(self) else None

    def sequence_range(self, sequence: int) -> tuple[int, int]:
        at = [i for i in range(len(self)) if self._sequence(i) == sequence]
        return (at[0], at[-1] + 1) if at else (0, 0)

    def sequence_count(self) -> int:
        return len({s for s in self.sequence_ids if s is not None}) or 1

    def _sequence(self, i: int) -> int | None:
        if self.sequence_ids[i] is not None or any(s is not None for s in self.sequence_ids):
            return self.sequence_ids[i]
        return 0

    # shaping

    def truncated(self, most: int, stride: int = 0, direction: str = "Right") -> EncodingRow:
        """The first window, the others as its overflow; nothing left if ``most`` isn't positive."""
        n = len(self)
        if most <= 0:
            return replace(self.slice(0, 0), overflow=[self.slice(0, n)] if n else [])
        if n <= most:
            return self
        parts = [self.slice(i, j) for i, j in windows(n, most, stride, direction)]
        return replace(parts[0], overflow=parts[1:])

    def padded(self, length: int, pad_id: int = 0, pad_type_id: int = 0, pad_token: str = "[PAD]", direction: str = "Right") -> EncodingRow:
        n = length - len(self)
        if n <= 0:
            return self
        pad = EncodingRow([pad_id] * n, [pad_type_id] * n, [pad_token] * n, [None] * n, [(0, 0)] * n, [1] * n, [0] * n, [None] * n)
        first, second = (self, pad) if direction == "Right" else (pad, self)
        return replace(EncodingRow(*[getattr(first, f) + getattr(second, f) for f in FIELDS]), overflow=self.overflow)

    def merged(self, other: EncodingRow, growing_offsets: bool = False, depth: int = 0) -> EncodingRow:
        """This, then ``other``; offsets of ``other`` may go on from this one's last end. Overflows are combined with each other."""
        shift = self.offsets[-1][1] if growing_offsets and self.offsets else 0
        moved = other if not shift else replace(other, offsets=[(s + shift, e + shift) for s, e in other.offsets])
        out = EncodingRow(*[getattr(self, f) + getattr(moved, f) for f in FIELDS])
        if depth < MOST_DEPTH and (self.overflow or other.overflow):
            plain, plain_other = replace(self, overflow=[]), replace(other, overflow=[])
            for o in self.overflow:
                out.overflow.append(o.merged(plain_other, growing_offsets, depth + 1))
                out.overflow += [o.merged(p, growing_offsets, depth + 1) for p in other.overflow]
            out.overflow += [plain.merged(p, growing_offsets, depth + 1) for p in other.overflow]
        return out


def merge_all(parts: list[EncodingRow], growing_offsets: bool = False) -> EncodingRow:
    if len(parts) > 1 and not growing_offsets and not any(p.overflow for p in parts):
        return EncodingRow(*[list(chain.from_iterable([getattr(p, f) for p in parts])) for f in FIELDS])
    out = EncodingRow()
    for i, p in enumerate(parts):
        out = p if not i else out.merged(p, growing_offsets)
    return out


def windows(n: int, most: int, stride: int = 0, direction: str = "Right") -> list[tuple[int, int]]:
    """Windows of at most ``most`` tokens that overlap by ``stride``, the main one first."""
    if stride >= most:
        raise ValueError("stride must be less than the length of a window")
    step = most - stride
    out: list[tuple[int, int]] = []
    if direction == "Right":
        for start in range(0, max(n, 1), step):
            out.append((start, min(start + most, n)))
            if start + most >= n:
                break
    else:
        for stop in range(n, 0, -step):
            out.append((max(stop - most, 0), stop))
            if stop - most <= 0:
                break
    return out


def longest_first(a: int, b: int, most: int) -> tuple[int, int]:
    """Lengths that a pair keeps: the longer is cut first."""
    if a + b <= most:
        return a, b
    swapped = a > b
    if swapped:
        a, b = b, a
    b = a if a > most else max(a, most - a)
    if a + b > most:
        a = most // 2
        b = a + most % 2
    return (b, a) if swapped else (a, b)


def truncate_pair(first: EncodingRow, second: EncodingRow | None, most: int, stride: int = 0, strategy: str = "LongestFirst", direction: str = "Right") -> tuple[EncodingRow, EncodingRow | None]:
    n = len(first) + (len(second) if second is not None else 0)
    if n <= most:
        return first, second
    if strategy == "OnlyFirst":
        return first.truncated(len(first) - (n - most), stride, direction), second
    if strategy == "OnlySecond":
        return first, second.truncated(len(second) - (n - most), stride, direction) if second is not None else None
    if second is None:
        return first.truncated(most, stride, direction), None
    a, b = longest_first(len(first), len(second), most)
    return first.truncated(a, stride, direction), second.truncated(b, stride, direction)


def pad_target(longest: int, fixed: int | None, multiple: int | None) -> int:
    target = max(longest, fixed or 0)
    return -(-target // multiple) * multiple if multiple else target
