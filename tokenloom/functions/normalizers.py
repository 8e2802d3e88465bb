"""Normalizers: string to string, with places, and as Column expressions.

Columns stay in the JVM but for the Unicode forms, upper case and compiled
charsmaps, which run in Arrow batches. Null stays null, empty stays empty
(``Prepend`` gives its content).
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.aligned import BYTE_CHARS, LATIN, LATIN_TO, WHITE, WS, Aligned, lower_one, python_regex, text_parts, upper_one
from tokenloom.sources.registry import component, escape_java, parse_pattern


#: Code points whose case mapping isn't one code point, or hangs on neighbours.
_LOWER_ODD = "\u0130\u03a3"
_UPPER_ODD = "".join(c for c in map(chr, range(0x20000)) if len(c.upper()) != 1)


def _class(chars: str) -> str:
    """Content of a Java class of ``chars``: those beyond Latin-1 as ranges behind one test, which is all that most code points cost."""
    ranges: list[list[int]] = []
    for x in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == x - 1:
            ranges[-1][1] = x
        else:
            ranges.append([x, x])
    low, high = ("".join(f"\\x{{{i:X}}}-\\x{{{j:X}}}" for i, j in ranges if (i > 0xFF) is beyond) for beyond in (False, True))
    return f"{low}[\\x{{100}}-\\x{{10FFFF}}&&[{high}]]"


def _by_code_point(c: Column, whole: Callable[[Column], Column], odd: str) -> Column:
    """A case mapping that never changes the number of code points; texts that hold ``odd`` ones are taken apart at these."""
    parts = F.regexp_extract_all(c, F.lit(f"[{_class(odd)}]|[^{_class(odd)}]++"), F.lit(0))
    apart = F.transform(parts, lambda x: F.when(F.length(whole(x)) == F.length(x), whole(x)).otherwise(x))
    return F.when(c.rlike(f"[{_class(odd)}]"), F.array_join(apart, "")).otherwise(whole(c))


def _arrow(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A function of texts in Arrow batches, of which about 1 MB at a time becomes Python strings."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        made = [pa.array([None if t is None else f(t) for t in part.to_pylist()], pa.string()) for part in text_parts(texts)]
        return pa.concat_arrays(made) if len(made) != 1 else made[0]

    return run


class Normalizer:
    #: Whether each code point of the text gives one of the result.
    keeps_places = False

    def apply(self, text: Aligned) -> Aligned:
        raise NotImplementedError

    def __call__(self, text: str) -> str:
        return self.apply(Aligned(text)).text

    def column(self, c: Column) -> Column:
        """Arrow fallback; the subclasses that can stay in the JVM do."""
        return _arrow(self.__call__)(c)


class _Form(Normalizer):
    form = "NFC"

    def __call__(self, text: str) -> str:
        return unicodedata.normalize(self.form, text)

    def apply(self, text: Aligned) -> Aligned:
        return text.normalized(self.form)

    def column(self, c: Column) -> Column:
        form = self.form
        return _arrow(lambda t: unicodedata.normalize(form, t))(c)


@component("normalizer", "NFC")
class NFC(_Form):
    form = "NFC"


@component("normalizer", "NFD")
class NFD(_Form):
    form = "NFD"


@component("normalizer", "NFKC")
class NFKC(_Form):
    form = "NFKC"


@component("normalizer", "NFKD")
class NFKD(_Form):
    form = "NFKD"


@component("normalizer", "Lowercase")
class Lowercase(Normalizer):
    """Lower case code point by code point: U+0130 and final sigma don't depend on their neighbours."""

    keeps_places = True

    def __call__(self, text: str) -> str:
        return text.lower() if text.isascii() or not any(c in text for c in _LOWER_ODD) else "".join(map(lower_one, text))

    def apply(self, text: Aligned) -> Aligned:
        return Aligned(self(text.text), text.spans, text.start)

    def column(self, c: Column) -> Column:
        return _by_code_point(c, F.lower, _LOWER_ODD)


@component("normalizer", "Uppercase")
class Uppercase(Normalizer):
    """Upper case code point by code point; those that would become several stay."""

    keeps_places = True

    def __call__(self, text: str) -> str:
        return text.upper() if text.isascii() else "".join(map(upper_one, text))

    def apply(self, text: Aligned) -> Aligned:
        return Aligned(self(text.text), text.spans, text.start)

    def column(self, c: Column) -> Column:
        return _by_code_point(c, F.upper, _UPPER_ODD)


@component("normalizer", "Strip", strip_left=True, strip_right=True)
class Strip(Normalizer):
    def apply(self, text: Aligned) -> Aligned:
        i, j = 0, len(text.text)
        while self.strip_left and i < j and text.text[i] in WHITE:
            i += 1
        while self.strip_right and j > i and text.text[j - 1] in WHITE:
            j -= 1
        return text.slice(i, j)

    def column(self, c: Column) -> Column:
        if self.strip_left:
            c = F.regexp_replace(c, f"\\A[{WS}]+", "")
        return F.regexp_replace(c, f"[{WS}]+\\z", "") if self.strip_right else c


@component("normalizer", "StripAccents")
class StripAccents(Normalizer):
    """Decompose, then drop all marks."""

    def apply(self, text: Aligned) -> Aligned:
        if text.text.isascii():
            return text
        return text.normalized("NFD").map(lambda c: "" if unicodedata.category(c)[0] == "M" else c)

    def column(self, c: Column) -> Column:
        return F.regexp_replace(NFD().column(c), "\\p{M}+", "")


@component("normalizer", "Prepend", prepend=None)
class Prepend(Normalizer):
    def apply(self, text: Aligned) -> Aligned:
        return text.prepended(self.prepend)

    def column(self, c: Column) -> Column:
        return F.concat(F.lit(self.prepend), c)


@component("normalizer", "Replace", pattern=None, content=None)
class Replace(Normalizer):
    """A literal or a regular expression by a literal content."""

    def prepare(self) -> None:
        self.kind, self.expression = parse_pattern(self.pattern)
        self.compiled = regex.compile(regex.escape(self.expression) if self.kind == "String" else python_regex(self.expression))

    def apply(self, text: Aligned) -> Aligned:
        return text.replaced((m.span() for m in self.compiled.finditer(text.text) if m.end() > m.start()), self.content)

    def column(self, c: Column) -> Column:
        if self.kind == "String":
            return F.replace(c, F.lit(self.expression), F.lit(self.content)) if self.expression else c
        return F.regexp_replace(c, self.expression, escape_java(self.content))


@component("normalizer", "ByteLevel")
class ByteLevel(Normalizer):
    """Each UTF-8 byte as a printable character."""

    def apply(self, text: Aligned) -> Aligned:
        return text.map(lambda c: "".join([BYTE_CHARS[b] for b in c.encode("utf-8", "replace")]))

    def column(self, c: Column) -> Column:
        latin = F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
        return F.translate(F.replace(latin, F.lit("\0"), F.lit("\ue000")), LATIN + "\ue000", LATIN_TO + BYTE_CHARS[0])


_NMT_DROP = frozenset(map(chr, [*range(1, 9), 0x0B, *range(0x0E, 0x20), 0x7F, 0x8F, 0x9F]))
_NMT_SPACE = frozenset(map(chr, [9, 10, 12, 13, 0x1680, *range(0x200B, 0x2010), 0x2028, 0x2029, 0x2581, 0xFEFF, 0xFFFD]))


@component("normalizer", "Nmt")
class Nmt(Normalizer):
    def apply(self, text: Aligned) -> Aligned:
        return text.map(lambda c: "" if c in _NMT_DROP else " " if c in _NMT_SPACE else c)

    def column(self, c: Column) -> Column:
        spaces = "".join(sorted(_NMT_SPACE))
        return F.translate(c, spaces + "".join(sorted(_NMT_DROP)), " " * len(spaces))


#: Code points of Chinese characters that are set apart by spaces.
CJK = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}\\x{2B740}-\\x{2B81F}\\x{2B920}-\\x{2CEAF}\\x{F900}-\\x{FAFF}\\x{2F800}-\\x{2FA1F}"
_CJK = regex.compile(f"[{python_regex(CJK)}]")


def _bert_drops(c: str) -> bool:
    return c in "\0\ufffd" or (c not in "\t\n\r" and unicodedata.category(c) in ("Cc", "Cf", "Cn", "Co"))


@component("normalizer", "BertNormalizer", "Bert", clean_text=True, handle_chinese_chars=True, strip_accents=None, lowercase=True)
class BertNormalizer(Normalizer):
    """Clean controls, set Chinese characters apart, strip accents (as ``lowercase`` unless given), lower case."""

    def prepare(self) -> None:
        self.accents = self.lowercase if self.strip_accents is None else self.strip_accents

    def apply(self, text: Aligned) -> Aligned:
        if self.clean_text:
            text = text.map(lambda c: "" if _bert_drops(c) else " " if c in WHITE else c)
        if self.handle_chinese_chars and not text.text.isascii():
            text = text.map(lambda c: f" {c} " if _CJK.match(c) else c)
        if self.accents:
            text = StripAccents().apply(text)
        return Lowercase().apply(text) if self.lowercase else text

    def column(self, c: Column) -> Column:
        if self.clean_text:
            c = F.regexp_replace(c, "[\\x{0}\\x{FFFD}\\p{Cf}\\p{Cn}\\p{Co}]|(?![\\t\\n\\r])\\p{Cc}", "")
            c = F.regexp_replace(c, f"[{WS}]", " ")
        if self.handle_chinese_chars:
            c = F.regexp_replace(c, f"([{CJK}])", " $1 ")
        if self.accents:
            c = StripAccents().column(c)
        return Lowercase().column(c) if self.lowercase else c


def compile_charsmap(replacements: dict[str, str]) -> str:
    """A compiled charsmap, as :class:`Precompiled` reads it, of keys and their replacements."""
    trie: dict = {}
    strings = bytearray()
    for key in sorted(replacements):
        node = trie
        for b in key.encode("utf-8"):
            node = node.setdefault(b, {})
        node[-1] = len(strings)
        strings += replacements[key].encode("utf-8") + b"\0"
    units, bases = {0: 0}, set()
    waiting = [(0, trie)]
    while waiting:
        at, node = waiting.pop()
        labels = [0 if b < 0 else b for b in node]
        base = 1
        while base in bases or any(base ^ x in units for x in labels):
            base += 1
        bases.add(base)
        units[at] |= ((at ^ base) << 10) | (0x100 if -1 in node else 0)
        for b, inner in node.items():
            if b < 0:
                units[base] = 0x80000000 | inner
            else:
                units[base ^ b] = b
                waiting.append((base ^ b, inner))
    flat = [units.get(i, 0x80000000) for i in range(max(units) + 256)]
    return base64.b64encode(struct.pack(f"<I{len(flat)}I", 4 * len(flat), *flat) + bytes(strings)).decode()


#: Below these, each code point is a grapheme, but for a carriage return with its line feed.
_JOINING = re.compile("\r\n|[\u0300-\U0010ffff]")


class _Replacements(dict):
    """A table for ``str.translate``, of the code points met so far."""

    def __init__(self, lookup: Callable[[str], str | None]):
        super().__init__()
        self.lookup = lookup

    def __missing__(self, x: int) -> str | int:
        made = self.lookup(chr(x))
        self[x] = new = x if made is None else made
        return new


@component("normalizer", "Precompiled", precompiled_charsmap=None)
class Precompiled(Normalizer):
    """A compiled charsmap: a double array of keys and their replacements.

    Graphemes of fewer than six bytes are looked up whole, then single code
    points; only a match of all bytes counts. The map is a length, the array's
    32-bit units, and the replacements, each ended by a zero byte.
    """

    def prepare(self) -> None:
        blob = base64.b64decode(self.precompiled_charsmap or "")
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if len(blob) >= 4:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]
        self.seen: dict[str, str | None] = {}
        self.table = _Replacements(self.lookup)

    def __call__(self, text: str) -> str:
        if not self.units:
            return text
        return self.apply(Aligned(text)).text if _JOINING.search(text) else text.translate(self.table)

    def lookup(self, key: str) -> str | None:
        """The replacement of exactly ``key``; answers are kept, up to a number."""
        if key not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[key] = self._walk(key)
        return self.seen[key]

    def _walk(self, key: str) -> str | None:
        if not self.units:
            return None
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for b in key.encode("utf-8"):
            node ^= b
            if node >= len(self.units):
                return None
            unit = self.units[node]
            if unit & 0x800000FF != b:
                return None
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        if not (unit >> 8) & 1 or node >= len(self.units):
            return None
        at = self.units[node] & 0x7FFFFFFF
        return self.strings[at : self.strings.index(b"\0", at)].decode("utf-8", "replace")

    def apply(self, text: Aligned) -> Aligned:
        if not self.units:
            return text
        out, spans, i = [], [], 0
        for m in regex.finditer(r"\X", text.text):
            part = m.group()
            whole = self.lookup(part) if len(part.encode("utf-8", "replace")) < 6 else None
            pieces = [(part, whole)] if whole is not None else [(c, self.lookup(c)) for c in part]
            for source, made in pieces:
                new = source if made is None else made
                out.append(new)
                if text.spans is not None:
                    spans += text.spans[i : i + len(source)] if made is None else [text.span(i, i + len(source))] * len(new)
                i += len(source)
        return Aligned("".join(out), None if text.spans is None else spans, text.start)


@component("normalizer", "Sequence", normalizers=None)
class Sequence(Normalizer):
    children = "normalizers"

    @property
    def keeps_places(self) -> bool:
        return all(n.keeps_places for n in self.normalizers)

    def __call__(self, text: str) -> str:
        for n in self.normalizers:
            text = n(text)
        return text

    def apply(self, text: Aligned) -> Aligned:
        for n in self.normalizers:
            text = n.apply(text)
        return text

    def column(self, c: Column) -> Column:
        for n in self.normalizers:
            c = n.column(c)
        return c
