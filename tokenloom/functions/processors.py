"""Post-processors: special tokens around encodings."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from tokenloom.functions.aligned import WHITE
from tokenloom.operators.encoding import EncodingRow, merge_all
from tokenloom.sources.registry import component


def special(ids: list[int], tokens: list[str], type_id: int) -> EncodingRow:
    n = len(ids)
    return EncodingRow(list(ids), [type_id] * n, list(tokens), [None] * n, [(0, 0)] * n, [1] * n, [1] * n, [None] * n)


class Processor:
    def added(self, pair: bool) -> int:
        """Special tokens that ``process`` adds."""
        return 0

    def process(self, first: EncodingRow, second: EncodingRow | None, specials: bool = True) -> EncodingRow:
        raise NotImplementedError

    def process_list(self, parts: list[EncodingRow], specials: bool = True) -> list[EncodingRow]:
        return [self.process(p, None, specials) for p in parts]


def plain(first: EncodingRow, second: EncodingRow | None) -> EncodingRow:
    """No processor: the pair's second part has sequence and type 1."""
    first = first.with_sequence(0)
    return first if second is None else first.merged(second.with_sequence(1).with_type(1))


def _wrapped(first: EncodingRow, second: EncodingRow | None, wrap: Any) -> EncodingRow:
    """``wrap(a, b)`` over all combinations of windows: mains first, then overflows of the first with all of the second, then the main with the second's."""
    a, b = replace(first, overflow=[]), None if second is None else replace(second, overflow=[])
    out = wrap(a, b)
    seconds = [b] if second is None else [b, *second.overflow]
    out.overflow = [wrap(o, s) for o in first.overflow for s in seconds] + [wrap(a, s) for s in seconds[1:]]
    return out


@component("post_processor", "BertProcessing", sep=("[SEP]", 102), cls=("[CLS]", 101))
class BertProcessing(Processor):
    def added(self, pair: bool) -> int:
        return 3 if pair else 2

    def process(self, first: EncodingRow, second: EncodingRow | None, specials: bool = True) -> EncodingRow:
        if not specials:
            return plain(first, second)

        cls, sep, last = special([self.cls[1]], [self.cls[0]], 0), special([self.sep[1]], [self.sep[0]], 0), special([self.sep[1]], [self.sep[0]], 1)

        def wrap(a: EncodingRow, b: EncodingRow | None) -> EncodingRow:
            return merge_all([cls, a, sep] if b is None else [cls, a, sep, b, last])

        # windows are marked once, not in each combination
        return _wrapped(first.with_sequence(0).with_type(0), None if second is None else second.with_sequence(1).with_type(1), wrap)

    def process_list(self, parts: list[EncodingRow], specials: bool = True) -> list[EncodingRow]:
        return [self.process(parts[0], p, specials) for p in parts[1:]] if len(parts) > 1 else super().process_list(parts, specials)


@component("post_processor", "RobertaProcessing", sep=("</s>", 2), cls=("<s>", 0), trim_offsets=True, add_prefix_space=True)
class RobertaProcessing(Processor):
    def added(self, pair: bool) -> int:
        return 4 if pair else 2

    def process(self, first: EncodingRow, second: EncodingRow | None, specials: bool = True) -> EncodingRow:
        if self.trim_offsets:
            first, second = trim_offsets(first, self.add_prefix_space), None if second is None else trim_offsets(second, self.add_prefix_space)
        if not specials:
            return plain(first, second).with_type(0)
        cls, sep = special([self.cls[1]], [self.cls[0]], 0), special([self.sep[1]], [self.sep[0]], 0)

        def wrap(a: EncodingRow, b: EncodingRow | None) -> EncodingRow:
            return merge_all([cls, a, sep] if b is None else [cls, a, sep, sep, b, sep])

        return _wrapped(first.with_sequence(0).with_type(0), None if second is None else second.with_sequence(1).with_type(0), wrap)


def trim_offsets(e: EncodingRow, add_prefix_space: bool) -> EncodingRow:
    """Leave leading and trailing white space of tokens out of their offsets; the first token's one space is kept if it may have been added."""
    out = []
    for i, (token, (s, t)) in enumerate(zip(e.tokens, e.offsets)):
        if e.special_tokens_mask[i] or not token:
            out.append((s, t))
            continue
        lead = next((k for k, c in enumerate(token) if c != "Ġ" and c not in WHITE), len(token))
        trail = next((k for k, c in enumerate(reversed(token)) if c != "Ġ" and c not in WHITE), len(token))
        if lead and add_prefix_space and (i == 0 or s == 0) and lead == 1:
            lead = 0
        start = min(s + lead, t)
        out.append((start, max(t - trail, start)))
    return replace(e, offsets=out, overflow=[trim_offsets(o, add_prefix_space) for o in e.overflow])


@component("post_processor", "ByteLevel", add_prefix_space=True, trim_offsets=True, use_regex=True)
class ByteLevelProcessing(Processor):
    def process(self, first: EncodingRow, second: EncodingRow | None, specials: bool = True) -> EncodingRow:
        if self.trim_offsets:
            first, second = trim_offsets(first, self.add_prefix_space), None if second is None else trim_offsets(second, self.add_prefix_space)
        return plain(first, second)


@component("post_processor", "TemplateProcessing", single=None, pair=None, special_tokens=None)
class TemplateProcessing(Processor):
    """Pieces ``{"Sequence": {"id", "type_id"}}`` and ``{"SpecialToken": {"id", "type_id"}}``; strings such as ``"[CLS] $A:0 [SEP]"`` are read too."""

    needed = ("single",)

    def prepare(self) -> None:
        self.special_tokens = dict(self.special_tokens or {})
        self.single, self.pair = parse_template(self.single), parse_template(self.pair)

    def _special(self, name: Any) -> tuple[list[int], list[str]]:
        found = self.special_tokens.get(name)
        if found is None:
            if isinstance(name, int):
                return [name], [str(name)]
            raise ValueError(f"special token without ids: {name!r}")
        return list(found["ids"]), list(found.get("tokens") or [name])

    def _count(self, template: list[dict[str, Any]]) -> int:
        return sum(len(self._special(p["SpecialToken"]["id"])[0]) for p in template if "SpecialToken" in p)

    def added(self, pair: bool) -> int:
        return self._count(self.pair if pair and self.pair else self.single)

    def process(self, first: EncodingRow, second: EncodingRow | None, specials: bool = True) -> EncodingRow:
        template = self.pair if second is not None and self.pair else self.single

        def wrap(a: EncodingRow, b: EncodingRow | None) -> EncodingRow:
            parts = []
            for p in template:
                if "SpecialToken" in p:
                    if specials:
                        parts.append(special(*self._special(p["SpecialToken"]["id"]), p["SpecialToken"].get("type_id", 0)))
                    continue
                type_id, which = p["Sequence"].get("type_id", 0), p["Sequence"]["id"]
                source = a if which == "A" else b
                if source is not None:
                    parts.append(source.with_sequence(0 if which == "A" else 1).with_type(type_id))
            return merge_all(parts)

        return _wrapped(first, second, wrap)

    def process_list(self, parts: list[EncodingRow], specials: bool = True) -> list[EncodingRow]:
        return [self.process(a, b, specials) for a, b in zip(parts, parts[1:])] if len(parts) > 1 else super().process_list(parts, specials)


def parse_template(template: Any) -> list[dict[str, Any]]:
    if template is None:
        return []
    words = template.split() if isinstance(template, str) else template
    out = []
    for w in words:
        if isinstance(w, dict):
            out.append(w)
            continue
        name, _, type_id = w.partition(":")
        if name.startswith("$"):
            which, given = name[1:] or "A", type_id
            if which.isdigit():
                which, given = "A", which
            out.append({"Sequence": {"id": which, "type_id": int(given or 0)}})
        else:
            out.append({"SpecialToken": {"id": name, "type_id": int(type_id or 0)}})
    return out


class Template:
    """Pieces of a template by hand."""

    @staticmethod
    def A(type_id: int = 0) -> dict[str, Any]:
        return {"Sequence": {"id": "A", "type_id": type_id}}

    @staticmethod
    def B(type_id: int = 1) -> dict[str, Any]:
        return {"Sequence": {"id": "B", "type_id": type_id}}

    @staticmethod
    def Special(name: str, type_id: int = 0) -> dict[str, Any]:
        return {"SpecialToken": {"id": name, "type_id": type_id}}


@component("post_processor", "Sequence", processors=None)
class SequenceProcessing(Processor):
    children = "processors"

    def added(self, pair: bool) -> int:
        return sum(p.added(pair) for p in self.processors)

    def process(self, first: EncodingRow, second: EncodingRow | None, specials: bool = True) -> EncodingRow:
        if not self.processors:
            return plain(first, second)
        out = self.processors[0].process(first, second, specials)
        for p in self.processors[1:]:
            if isinstance(p, ByteLevelProcessing):  # sequences and types are set already
                out = trim_offsets(out, p.add_prefix_space) if p.trim_offsets else out
            else:
                out = p.process(out, None, specials)
        return out
