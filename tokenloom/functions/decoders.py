"""Decoders: tokens to text. ``chain`` maps tokens to tokens, ``decode`` ends in one string.

``column`` takes ``array<string>`` to a string in one Catalyst expression. Null
gives null, no tokens an empty text. Decoders that can work on a whole text of
tokens, each with ``MARK`` before it, do that where no token holds the mark:
a few passes over one string instead of several steps for each token.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.aligned import BYTE_CHARS, CHAR_BYTES, LATIN, LATIN_TO, python_regex
from tokenloom.functions.normalizers import ByteLevel as ByteLevelNormalizer
from tokenloom.sources.registry import component, parse_pattern


MARK = "\x1f"


class Decoder:
    def marked(self, text: Column) -> Column | None:
        """``chain`` on a text of tokens, none of which holds ``MARK``, with a mark before each; None where it can't."""
        return None

    def chain(self, tokens: list[str]) -> list[str]:
        raise NotImplementedError

    def decode(self, tokens: list[str]) -> str:
        return "".join(self.chain(tokens))

    def chain_column(self, tokens: Column) -> Column:
        chain = self.chain

        @F.pandas_udf("array<string>")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: chain(list(t)), na_action="ignore")

        return run(tokens)

    def column(self, tokens: Column) -> Column:
        if self.marked(F.lit("")) is None:
            return F.array_join(self.chain_column(tokens), "")

        def one_text(tokens: Column) -> Column:
            # a null token adds marks, so that lists with one aren't taken for whole
            text = F.concat(F.lit(MARK), F.array_join(tokens, MARK, MARK))
            return bound(text, lambda t: F.when(_count(t) == F.size(tokens), F.replace(self.marked(t), F.lit(MARK), F.lit(""))).otherwise(F.array_join(self.chain_column(tokens), "")))

        return bound(tokens, one_text)


def _count(text: Column) -> Column:
    """Number of marks."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(MARK), F.lit("")))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, also where ``f`` uses it for each element of a lambda."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _each(tokens: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(tokens, f)


CONTRACTIONS = ((" do not", " don't"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))


def _contract(text: str) -> str:
    for a, b in CONTRACTIONS:
        text = text.replace(a, b)
    return text


def _contract_column(c: Column) -> Column:
    for a, b in CONTRACTIONS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@component("decoder", "BPEDecoder", suffix="")
class BPEDecoder(Decoder):
    """The suffix's first occurrence in a token is a space, in the last token nothing."""

    def chain(self, tokens: list[str]) -> list[str]:
        if not self.suffix:
            return list(tokens)
        last = len(tokens) - 1
        return [t.replace(self.suffix, "" if i == last else " ", 1) for i, t in enumerate(tokens)]

    def chain_column(self, tokens: Column) -> Column:
        if not self.suffix:
            return tokens
        n = len(self.suffix)

        def all_of(tokens: Column) -> Column:
            def one(t: Column, i: Column) -> Column:
                at = F.locate(self.suffix, t)
                gap = F.when(i == F.size(tokens) - 1, F.lit("")).otherwise(F.lit(" "))
                return F.when(at == 0, t).otherwise(F.concat(F.substr(t, F.lit(1), at - 1), gap, F.substr(t, at + n)))

            return F.transform(tokens, one)

        return bound(tokens, all_of)


_TO_LATIN = {ord(c): b for c, b in CHAR_BYTES.items()} | {c: 0xFFFE for c in range(0x80, 0x100) if chr(c) not in CHAR_BYTES}


@component("decoder", "ByteLevel", add_prefix_space=True, trim_offsets=True, use_regex=True)
class ByteLevel(Decoder):
    """Characters back to bytes, decoded over the whole sequence; alone, a token is decoded as Latin-1."""

    def raw(self, token: str) -> bytes:
        return b"".join(bytes([CHAR_BYTES[c]]) if c in CHAR_BYTES else c.encode("utf-8", "replace") for c in token)

    def chain(self, tokens: list[str]) -> list[str]:
        return [self.raw(t).decode("latin-1") for t in tokens]

    def decode(self, tokens: list[str]) -> str:
        try:
            data = "".join(tokens).translate(_TO_LATIN).encode("latin-1")
        except UnicodeEncodeError:  # characters outside of the alphabet
            data = b"".join(map(self.raw, tokens))
        return data.decode("utf-8", "replace")

    def column(self, tokens: Column) -> Column:
        alphabet = "\\x{21}-\\x{7E}\\x{A1}-\\x{AC}\\x{AE}-\\x{143}"
        runs = F.regexp_extract_all(F.array_join(tokens, ""), F.lit(f"[{alphabet}]+|[^{alphabet}]+"), F.lit(0))
        text = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"\\A[{alphabet}]"), r).otherwise(ByteLevelNormalizer().column(r))), "")
        latin = F.translate(text, LATIN_TO + BYTE_CHARS[0], LATIN + "\ue000")
        return F.make_valid_utf8(F.encode(F.replace(latin, F.lit("\ue000"), F.lit("\0")), "ISO-8859-1").cast("string"))


@component("decoder", "WordPiece", prefix="##", cleanup=True)
class WordPiece(Decoder):
    _drop = regex.compile(r""" (?=[.,!?;:)\]}'"/\\\-%])""")

    def tidy(self, token: str) -> str:
        return regex.sub(" {2,}", " ", self._drop.sub("", _contract(token)))

    def chain(self, tokens: list[str]) -> list[str]:
        out = []
        for i, t in enumerate(tokens):
            if i:
                t = t[len(self.prefix) :] if self.prefix and t.startswith(self.prefix) else " " + t
            out.append(self.tidy(t) if self.cleanup else t)
        return out

    def chain_column(self, tokens: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            goes_on = t.startswith(self.prefix) if self.prefix else F.lit(False)
            t = F.when(i == 0, t).when(goes_on, F.substr(t, F.lit(len(self.prefix) + 1))).otherwise(F.concat(F.lit(" "), t))
            if self.cleanup:
                t = F.regexp_replace(F.regexp_replace(_contract_column(t), """ (?=[.,!?;:)\\]}'"/\\\\\\-%])""", ""), " {2,}", " ")
            return t

        return F.transform(tokens, one)


@component("decoder", "Metaspace", replacement="\u2581", prepend_scheme="always", split=True)
class Metaspace(Decoder):
    """Marks to spaces; the first token keeps or gets a leading space, or loses all with ``never``."""

    @classmethod
    def from_json(cls, data: dict) -> Metaspace:
        scheme = str(data.get("prepend_scheme") or ("never" if data.get("add_prefix_space") is False else "always")).lower()
        return cls(replacement=data.get("replacement") or "\u2581", prepend_scheme=scheme, split=data.get("split", True))

    def chain(self, tokens: list[str]) -> list[str]:
        out = [t.replace(self.replacement, " ") for t in tokens]
        if out:
            if self.prepend_scheme == "never":
                out[0] = out[0].lstrip(" ")
            elif not out[0].startswith(" "):
                out[0] = " " + out[0]
        return out

    def chain_column(self, tokens: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            t = F.replace(t, F.lit(self.replacement), F.lit(" "))
            if self.prepend_scheme == "never":
                return F.when(i == 0, F.ltrim(t)).otherwise(t)
            return F.when((i == 0) & ~t.startswith(" "), F.concat(F.lit(" "), t)).otherwise(t)

        return F.transform(tokens, one)


@component("decoder", "CTC", pad_token="<pad>", word_delimiter_token="|", cleanup=True)
class CTC(Decoder):
    def chain(self, tokens: list[str]) -> list[str]:
        out = []
        for i, t in enumerate(tokens):
            if i and t == tokens[i - 1]:
                continue
            t = t.replace(self.pad_token, "") if self.pad_token else t
            if self.cleanup:
                t = _contract(t)
                for mark in ".?!,":
                    t = t.replace(" " + mark, mark)
                t = t.replace(" ' ", "'")
            t = t.replace(self.word_delimiter_token, " ") if self.word_delimiter_token else t
            if t:
                out.append(t)
        return out

    def marked(self, text: Column) -> Column | None:
        if MARK in (self.pad_token or "") + (self.word_delimiter_token or ""):
            return None
        return self._clean(F.regexp_replace(text, f"{MARK}([^{MARK}]*+)(?:{MARK}\\1(?={MARK}|\\z))++", f"{MARK}$1"))

    def _clean(self, t: Column) -> Column:
        t = F.replace(t, F.lit(self.pad_token), F.lit("")) if self.pad_token else t
        if self.cleanup:
            t = _contract_column(t)
            for mark in ".?!,":
                t = F.replace(t, F.lit(" " + mark), F.lit(mark))
            t = F.replace(t, F.lit(" ' "), F.lit("'"))
        return F.replace(t, F.lit(self.word_delimiter_token), F.lit(" ")) if self.word_delimiter_token else t

    def chain_column(self, tokens: Column) -> Column:
        fresh = bound(tokens, lambda all_: F.filter(all_, lambda t, i: (i == 0) | (t != F.get(all_, i - 1))))
        return F.filter(F.transform(fresh, self._clean), lambda t: t != "")


_BYTE = regex.compile(r"<0x([0-9A-Fa-f]{2})>")


def lenient(data: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that isn't part of a character."""
    out, i, n = [], 0, len(data)
    while i < n:
        b = data[i]
        size = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        try:
            if not size:
                raise ValueError
            out.append(data[i : i + size].decode("utf-8"))
            i += size
        except ValueError:
            out.append("\ufffd")
            i += 1
    return "".join(out)


@component("decoder", "ByteFallback")
class ByteFallback(Decoder):
    def chain(self, tokens: list[str]) -> list[str]:
        out: list[str] = []
        held = bytearray()
        for t in tokens:
            m = _BYTE.fullmatch(t)
            if m:
                held.append(int(m.group(1), 16))
                continue
            if held:
                out.append(lenient(bytes(held)))
                held.clear()
            out.append(t)
        if held:
            out.append(lenient(bytes(held)))
        return out

    def column(self, tokens: Column) -> Column:
        """Bytes as Latin-1 characters, then those that aren't part of a character as U+FFFD; a mark parts bytes where an empty token does."""

        def latin(b: Column) -> Column:
            return F.decode(b, "ISO-8859-1")

        def one(t: Column) -> Column:
            return F.when(t == "", F.lit(MARK_BEYOND)).when(t.rlike("\\A<0x[0-9A-Fa-f]{2}>\\z"), latin(F.unhex(F.substr(t, F.lit(4), F.lit(2))))).otherwise(latin(F.encode(t, "UTF-8")))

        def all_bytes(t: Column, n: Column) -> Column:
            return F.unhex(F.substr(F.replace(t, F.lit(f">{MARK}<0x"), F.lit("")), F.lit(5), 2 * n))

        def either(tokens: Column) -> Column:
            def text(t: Column) -> Column:
                whole = (F.octet_length(t) == 7 * F.size(tokens)) & t.rlike(f"\\A(?:{MARK}<0x[0-9A-Fa-f]{{2}}>)++\\z")
                return F.when(whole, bound(all_bytes(t, F.size(tokens)), lambda b: F.when(F.is_valid_utf8(b.cast("string")), b.cast("string")).otherwise(_lenient_column(latin(b))))).otherwise(_lenient_column(F.array_join(F.transform(tokens, one), "")))

            return bound(F.concat(F.lit(MARK), F.array_join(tokens, MARK, MARK)), text)

        return bound(tokens, either)


#: Beyond Latin-1, so that no byte is it.
MARK_BEYOND = "\u0100"
_TAIL = "[\\x{80}-\\x{BF}]"
_CHARACTERS = f"[\\x{{0}}-\\x{{7F}}{MARK_BEYOND}]++|[\\x{{C2}}-\\x{{DF}}]{_TAIL}|\\x{{E0}}[\\x{{A0}}-\\x{{BF}}]{_TAIL}|\\x{{ED}}[\\x{{80}}-\\x{{9F}}]{_TAIL}|[\\x{{E1}}-\\x{{EC}}\\x{{EE}}\\x{{EF}}]{_TAIL}{{2}}|\\x{{F0}}[\\x{{90}}-\\x{{BF}}]{_TAIL}{{2}}|[\\x{{F1}}-\\x{{F3}}]{_TAIL}{{3}}|\\x{{F4}}[\\x{{80}}-\\x{{8F}}]{_TAIL}{{2}}"


def _lenient_column(latin: Column) -> Column:
    """:func:`lenient` of bytes that are Latin-1 characters."""
    whole = F.regexp_replace(latin, f"\\G((?:{_CHARACTERS})*+)[\\x{{80}}-\\x{{FF}}]", "$1\u00ef\u00bf\u00bd")
    return F.encode(F.replace(whole, F.lit(MARK_BEYOND), F.lit("")), "ISO-8859-1").cast("string")


@component("decoder", "Fuse")
class Fuse(Decoder):
    def marked(self, text: Column) -> Column:
        return F.concat(F.lit(MARK), F.replace(text, F.lit(MARK), F.lit("")))

    def column(self, tokens: Column) -> Column:
        return F.array_join(tokens, "")

    def chain(self, tokens: list[str]) -> list[str]:
        return ["".join(tokens)]

    def chain_column(self, tokens: Column) -> Column:
        return F.when(tokens.isNotNull(), F.array(F.array_join(tokens, "")))


@component("decoder", "Strip", content=" ", start=1, stop=1)
class Strip(Decoder):
    """Cut up to ``start`` and ``stop`` copies of a character from the ends of each token."""

    def prepare(self) -> None:
        self.char = self.content[:1]

    def chain(self, tokens: list[str]) -> list[str]:
        out = []
        for t in tokens:
            i, j = 0, len(t)
            while i < min(self.start, len(t)) and t[i] == self.char:
                i += 1
            while len(t) - j < self.stop and j > i and t[j - 1] == self.char:
                j -= 1
            out.append(t[i:j])
        return out

    def marked(self, text: Column) -> Column | None:
        if self.char == MARK:
            return None
        c = regex.escape(self.char, literal_spaces=True)
        if self.start > 0:
            text = F.regexp_replace(text, f"{MARK}(?:{c}){{1,{self.start}}}", MARK)
        return F.regexp_replace(text, f"(?:{c}){{1,{self.stop}}}(?={MARK}|\\z)", "") if self.stop > 0 else text

    def chain_column(self, tokens: Column) -> Column:
        c = regex.escape(self.char, literal_spaces=True)
        return _each(tokens, lambda t: F.regexp_replace(F.regexp_replace(t, f"\\A(?:{c}){{0,{self.start}}}", ""), f"(?:{c}){{0,{self.stop}}}\\z", "") if self.stop else F.regexp_replace(t, f"\\A(?:{c}){{0,{self.start}}}", ""))


@component("decoder", "Replace", pattern=None, content=None, replacement=None)
class Replace(Decoder):
    """A literal, or an expression whose replacement may name groups as ``$1``."""

    needed = ("pattern",)

    def prepare(self) -> None:
        self.kind_, self.expression = parse_pattern(self.pattern)
        self.new = self.content if self.content is not None else self.replacement or ""
        self.compiled = regex.compile(python_regex(self.expression)) if self.kind_ == "Regex" else None
        self.template = regex.sub(r"\$(\d+)", r"\\g<\1>", self.new.replace("\\", "\\\\"))

    def chain(self, tokens: list[str]) -> list[str]:
        if self.compiled is None:
            return [t.replace(self.expression, self.new) if self.expression else t for t in tokens]
        return [self.compiled.sub(self.template, t) for t in tokens]

    def marked(self, text: Column) -> Column | None:
        if self.compiled is not None or not self.expression or MARK in self.expression + self.new:
            return None
        return F.replace(text, F.lit(self.expression), F.lit(self.new))

    def chain_column(self, tokens: Column) -> Column:
        if self.compiled is None:
            return _each(tokens, lambda t: F.replace(t, F.lit(self.expression), F.lit(self.new)))
        return _each(tokens, lambda t: F.regexp_replace(t, self.expression, self.new.replace("\\", "\\\\")))


@component("decoder", "Sequence", decoders=None)
class Sequence(Decoder):
    children = "decoders"

    def chain(self, tokens: list[str]) -> list[str]:
        for d in self.decoders:
            tokens = d.chain(tokens)
        return tokens

    def decode(self, tokens: list[str]) -> str:
        if not self.decoders:
            return "".join(tokens)
        for d in self.decoders[:-1]:
            tokens = d.chain(tokens)
        return self.decoders[-1].decode(tokens)

    def marked(self, text: Column) -> Column | None:
        for d in self.decoders:
            text = None if text is None else d.marked(text)
        return text

    def column(self, tokens: Column) -> Column:
        if not self.decoders:
            return F.array_join(tokens, "")
        if self.marked(F.lit("")) is not None:
            return super().column(tokens)
        for d in self.decoders[:-1]:
            tokens = d.chain_column(tokens)
        return self.decoders[-1].column(tokens)

    def chain_column(self, tokens: Column) -> Column:
        for d in self.decoders:
            tokens = d.chain_column(tokens)
        return tokens
