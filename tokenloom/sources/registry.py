"""Registry of components: kind and type name to a class with its options.

A class registered with :func:`component` gets a constructor that takes its
options by name (None as a default means that the option is needed unless the
class says otherwise), and can be read from and written to JSON. Users extend
the engine by registering classes of their own.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

REGISTRY: dict[str, dict[str, type]] = {}


def component(kind: str, name: str, *aliases: str, **options: Any) -> Callable[[type], type]:
    """Register a class under a kind and a type name, with its options and their defaults."""

    def register(cls: type) -> type:
        def init(self: Any, **given: Any) -> None:
            unknown = set(given) - set(options)
            if unknown:
                raise TypeError(f"{name} has no option {sorted(unknown)}")
            for key, default in options.items():
                setattr(self, key, given.get(key, default))
            if hasattr(self, "prepare"):
                self.prepare()

        if "__init__" not in cls.__dict__:
            init.__signature__ = inspect.Signature([inspect.Parameter("self", inspect.Parameter.POSITIONAL_OR_KEYWORD), *[inspect.Parameter(k, inspect.Parameter.KEYWORD_ONLY, default=v) for k, v in options.items()]])  # type: ignore[attr-defined]
            cls.__init__ = init  # type: ignore[misc]
        cls.kind, cls.type_name, cls.options = kind, name, options  # type: ignore[attr-defined]
        for n in (name, *aliases):
            REGISTRY.setdefault(kind, {})[n] = cls
        return cls

    return register


def build(kind: str, data: dict[str, Any] | None) -> Any:
    """A component from its JSON; an unknown type raises ``NotImplementedError``."""
    if data is None:
        return None
    name = data.get("type")
    cls = REGISTRY.get(kind, {}).get(name)
    if cls is None:
        raise NotImplementedError(f"unknown {kind} type: {name!r}")
    if hasattr(cls, "from_json"):
        return cls.from_json(data)
    given = {k: v for k, v in data.items() if k in cls.options}
    children = getattr(cls, "children", None)
    if children:
        if children not in data:
            raise ValueError(f"{name} needs {children}")
        given[children] = [build(kind, d) for d in data[children]]
    for key in getattr(cls, "needed", ()):
        if data.get(key) is None:
            raise ValueError(f"{name} needs {key}")
    return cls(**given)


def dump(part: Any) -> dict[str, Any] | None:
    """JSON of a component, with all options."""
    if part is None:
        return None
    if hasattr(part, "to_json"):
        return part.to_json()
    out: dict[str, Any] = {"type": part.type_name}
    for key in part.options:
        value = getattr(part, key)
        out[key] = [dump(v) for v in value] if key == getattr(part, "children", None) else value
    return out


def parse_pattern(pattern: Any) -> tuple[str, str]:
    """``("String" | "Regex", expression)`` of a JSON pattern; a plain string is a literal."""
    if isinstance(pattern, str):
        return "String", pattern
    if isinstance(pattern, dict):
        for kind in ("String", "Regex"):
            if kind in pattern:
                return kind, pattern[kind]
    raise ValueError(f"not a pattern: {pattern!r}")


def escape_java(text: str) -> str:
    """A literal as the replacement of a Java regular expression."""
    return text.replace("\\", "\\\\").replace("$", "\\$")
