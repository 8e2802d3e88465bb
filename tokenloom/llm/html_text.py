"""Visible text of HTML pages, laid out: tree builder, visibility, rendering.

The tree builder follows the parts of the HTML standard that decide where text
goes: void and raw-text elements, start tags that close an open paragraph, list
item, definition, option, cell, row or row group, end tags without a start, and
elements left open. Rendering collapses white space within blocks, puts blocks
on lines of their own and an empty line around those with margins, keeps
preformatted text, numbers or bullets list items by their depth, and aligns the
cells of tables in columns, spans included. Labels of SVG drawings stand on
lines of their own, MathML formulas in one line (``(a+b)/2``, ``x_i^2``). All visible text is kept, navigation
and footers too; nothing is judged by content.

Of SVG, definitions, titles, descriptions and metadata aren't drawn, nor
annotations and phantoms of MathML. What SVG's use elements draw again isn't
followed. Not visible: the head, scripts, styles, templates, comments, fallback content
of media, elements with the hidden attribute, with ``display: none`` or
``visibility: hidden`` in their style or in a rule of the page for their tag,
class or id (but for elements in them that are visible again; a cell that is
hidden this way keeps its column), closed details but for the summary, and closed dialogs. Of rules in
at-rules and of style elements with a media attribute, those count that hold on
a desktop screen (``SCREEN``); rules for print or small screens hide nothing.
Where that can't be told (container queries, unknown features), text is kept.

Cases: a null page has null text, an empty page or one without visible text an
empty one. Elements deeper than ``DEEPEST`` become siblings, as in browsers;
their text is kept. A table whose aligned columns would take more than
``LOOSEST`` times the characters of its text (and 4,000) has its cells apart by
bars, or on lines of their own, with all its text. Rows are read one by one, so repeated and null keys and ties
don't matter; the output's name gets underscores where it would clash.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm import _shared as S

DEEPEST = 512
#: Characters of a table with aligned columns for each of its text (and 4,000 beside) beyond which its columns aren't aligned.
LOOSEST = 8
#: The screen that media queries are asked about: what features without a range hold, and pixels and dots of those with one.
SCREEN: dict[str, float | str] = {
    "width": 1280.0, "height": 720.0, "device-width": 1280.0, "device-height": 720.0, "aspect-ratio": 1280 / 720, "device-aspect-ratio": 1280 / 720,
    "resolution": 1.0, "-webkit-device-pixel-ratio": 1.0, "color": 8.0, "color-index": 0.0, "monochrome": 0.0, "grid": 0.0,
    "orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "scripting": "enabled", "update": "fast",
    "display-mode": "browser", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference", "forced-colors": "none",
}
_UNITS = {"": 1.0, "px": 1.0, "em": 16.0, "rem": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 9.6 / 2.54, "pt": 96 / 72, "pc": 16.0, "dppx": 1.0, "x": 1.0, "dpi": 1 / 96, "dpcm": 2.54 / 96}

_TOKEN = re.compile(r"""<(?:!--(?:.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|[!?/][^>]*+>)""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_CSS = re.compile(r"""[^{};"'\\]++|[{};]|"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?|\\.?""", re.S)
_NOTE = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_HIDING = {"display": ("none",), "visibility": ("hidden", "collapse"), "content-visibility": ("hidden",)}
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility|content-visibility)\s*:\s*([\w-]+)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes audio video canvas object datalist meta link base param source track area rp".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr menu dir listing xmp fieldset".split())
BLOCK = MARGIN | frozenset("address article aside body center details dialog dd div dt figcaption footer form header hgroup html legend li main nav optgroup option search section select summary textarea caption thead tbody tfoot tr td th".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt listing xmp search".split())
LISTS = frozenset(("ul", "ol", "menu", "dir"))
#: Start tag: (tags that it closes, tags beyond which it doesn't look).
_SECTION = frozenset(("table", "template"))
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir", "table", "td", "th"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (frozenset(("td", "th", "caption")), _SECTION | {"tr"}),
    "th": (frozenset(("td", "th", "caption")), _SECTION | {"tr"}),
    "tr": (frozenset(("tr", "caption", "colgroup")), _SECTION | {"thead", "tbody", "tfoot"}),
    "thead": (frozenset(("thead", "tbody", "tfoot", "caption", "colgroup")), _SECTION),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "caption", "colgroup")), _SECTION),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "caption", "colgroup")), _SECTION),
}
_CELLS = frozenset(("td", "th", "caption"))
#: Elements of SVG and MathML that HTML may stand in, and start tags that end SVG and MathML elsewhere.
INTEGRATION = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
FOREIGN = frozenset(("svg", "math"))
#: SVG elements that are drawn where they stand; definitions, titles, descriptions and metadata aren't.
SVG_GROUPS = frozenset("svg g a switch".split())
SVG_SHAPES = SVG_GROUPS | frozenset("text tspan textpath foreignobject".split())


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for name, a, b, c in _ATTRIBUTE.findall(self.attributes):
            found.setdefault(name.lower(), html.unescape(a or b or c))
        return found


def _close(stack: list[Element], tags: frozenset[str], until: frozenset[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in until or stack[k].tag in INTEGRATION:
            return


def _foreign(stack: list[Element]) -> int:
    """Place of the SVG or MathML root that the innermost element belongs to; 0 in HTML."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in FOREIGN:
            return k
        if stack[k].tag in INTEGRATION or stack[k].tag in BLOCK:
            return 0
    return 0


_P, _P_UNTIL = frozenset(("p",)), frozenset(("table", "td", "th", "caption", "button", "object", "template"))
_HEAD_ONLY = frozenset("head title meta link base style script noscript template html".split())


def parse_html(page: str) -> tuple[Element, list[str]]:
    """The tree of a page, and its style sheets."""
    root = Element("#root")
    stack = [root]
    styles: list[str] = []
    at, n = 0, len(page)
    drawn = False  # whether there was SVG or MathML
    while at < n:
        start = page.find("<", at)
        if start < 0:
            stack[-1].children.append(page[at:])
            break
        if start > at:
            if stack[-1].tag == "head" and not page[at:start].isspace():
                stack.pop()
            stack[-1].children.append(page[at:start])
        if drawn and page.startswith("<![CDATA[", start) and _foreign(stack):
            stop = page.find("]]>", start)
            stack[-1].children.append(html.escape(page[start + 9 : stop if stop >= 0 else n]))
            at = stop + 3 if stop >= 0 else n
            continue
        match = _TOKEN.match(page, start) or _LOOSE.match(page, start)
        if match is None:
            stack[-1].children.append("<")
            at = start + 1
            continue
        at = match.end()
        tag = match.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if match.group(1):
            if tag == "br":
                stack[-1].children.append(Element("br"))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK and tag not in ("body", "html"):
                    break  # the end tag of an inline element doesn't end blocks inside it
                if stack[k].tag in INTEGRATION and tag not in FOREIGN:
                    break
                if stack[k].tag in _CELLS and tag not in ("table", "tr", "thead", "tbody", "tfoot", "body", "html"):
                    break
            else:
                if tag == "p":
                    stack[-1].children.append(Element("p"))
            continue
        if tag in ("html", "body") and any(e.tag == tag for e in stack):
            continue
        if stack[-1].tag == "head" and tag not in _HEAD_ONLY:
            stack.pop()
        foreign = _foreign(stack) if drawn else 0
        if foreign and tag in BREAKOUT:
            del stack[foreign:]
            foreign = 0
        if tag in CLOSES_P:
            _close(stack, _P, _P_UNTIL)
        if tag in IMPLIED:
            _close(stack, *IMPLIED[tag])
        element = Element(tag, match.group(3))
        stack[-1].children.append(element)
        if tag in VOID or (foreign and element.attributes.endswith("/")):
            continue
        if tag in RAW and (not foreign or tag in ("script", "style")):
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else n
            element.children.append(page[at:stop])
            if tag == "style" and on_screen(element.get().get("media", "")):
                styles.append(page[at:stop])
            close = page.find(">", stop)
            at = n if close < 0 else close + 1
            continue
        if element.attributes.endswith("/") and tag in ("svg", "math", "path"):
            continue
        drawn = drawn or tag in FOREIGN
        if len(stack) < DEEPEST:
            stack.append(element)
    return root, styles


def _all(values: list[bool | None]) -> bool | None:
    return False if False in values else None if None in values else True


def _any(values: list[bool | None]) -> bool | None:
    return True if True in values else None if None in values else False


def _not(value: bool | None) -> bool | None:
    return None if value is None else not value


def _measure(text: str) -> float | None:
    """A length in pixels, a resolution in dots a pixel, a ratio or a number."""
    match = re.fullmatch(r"([-+]?(?:\d+\.?\d*|\.\d+))([a-z]*)(?:\s*/\s*(\d+\.?\d*))?", text)
    if match is None or match[2] not in _UNITS or float(match[3] or 1) == 0:
        return None
    return float(match[1]) * _UNITS[match[2]] / float(match[3] or 1)


def _feature(text: str) -> bool | None:
    """Whether a media feature holds on :data:`SCREEN`; None if it isn't known."""
    parts = [x.strip() for x in re.split(r"([<>]=?|=|:)", text)]
    if len(parts) == 1:
        have = SCREEN.get(text)
        return None if have is None else have not in (0, "none", "no-preference")
    if len(parts) == 3 and parts[1] == ":":
        name, test = parts[0], "="
        if name[:4] in ("min-", "max-"):
            name, test = name[4:], ">=" if name[:3] == "min" else "<="
        parts = [name, test, parts[2]]
    if len(parts) not in (3, 5) or ":" in parts:
        return None
    values = [SCREEN.get(x, _measure(x)) if x in SCREEN or _measure(x) is not None else x for x in parts[::2]]
    results = []
    for x, test, y in zip(values, parts[1::2], values[1:]):
        if test == "=":
            results.append(x == y)
        elif isinstance(x, str) or isinstance(y, str):
            return None
        else:
            results.append({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[test])
    return _all(results) if any(x in SCREEN for x in parts[::2]) else None


def _split_outside(text: str, separator: str) -> list[str]:
    """``text`` cut at matches of ``separator`` that aren't in brackets."""
    parts, depth, at = [], 0, 0
    for match in re.finditer(rf"[()]|{separator}", text):
        if match[0] == "(":
            depth += 1
        elif match[0] == ")":
            depth -= 1
        elif depth <= 0:
            parts.append(text[at : match.start()])
            at = match.end()
    return [x.strip() for x in [*parts, text[at:]]]


def _condition(text: str, deep: int = 0) -> bool | None:
    for word, joined in (("and", _all), ("or", _any)):
        parts = _split_outside(text, rf"(?<=[\s)]){word}(?=[\s(])")
        if len(parts) > 1:
            return joined([_condition(x, deep) for x in parts])
    if re.match(r"not(?=[\s(])", text):
        return _not(_condition(text[3:].strip(), deep))
    if text[:1] != "(" or text[-1:] != ")" or deep > 32:
        return None
    inner = text[1:-1].strip()
    return _condition(inner, deep + 1) if inner[:1] == "(" or re.match(r"not(?=[\s(])", inner) else _feature(inner)


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds on :data:`SCREEN`; an empty one does, one that can't be read doesn't."""
    media = _NOTE.sub(" ", media).strip().lower()
    if not media:
        return True
    for query in _split_outside(media, ","):
        match = re.match(r"(?:(not|only)\s+)?(?!(?:not|only|and|or)\b)([a-z-]+)(?:\s+and(?=[\s(])(.*))?$", query, re.S)
        if match is None:
            holds = _condition(query)
        else:
            holds = match[2] in ("all", "screen")
            if match[3]:
                holds = _all([holds, _all([_condition(match[3].strip())])])
            if match[1] == "not":
                holds = _not(holds)
        if holds:
            return True
    return False


def _applies(rule: str) -> bool:
    """Whether the rules in a block at-rule hold on a screen, for all elements and at all times."""
    name, rest = re.match(r"@([\w-]*)(.*)", rule, re.S).groups()
    name = name.lower()
    if name == "media":
        return on_screen(rest)
    return name == "layer" or (name == "supports" and not re.match(r"not\b", rest.strip(), re.I))


def hiding_rules(styles: list[str]) -> dict[tuple[str, str], bool]:
    """By simple selector (tag, .class, #id) and property, whether the rules that hold on a screen hide; of rules with one selector the last counts."""
    said: dict[tuple[str, str], tuple[bool, bool]] = {}

    def declare(selectors: list[str], text: str) -> None:
        name, _, value = text.partition(":")
        name, (value, *flag) = name.strip().lower(), [x.strip().lower() for x in value.split("!")]
        if name in _HIDING and value:
            for s in selectors:
                if flag == ["important"] or not said.get((s, name), (False, False))[1]:
                    said[s, name] = value in _HIDING[name], flag == ["important"]

    for sheet in styles:
        low = sheet.lower()
        if not ("none" in low or "hidden" in low or "collapse" in low):
            continue
        # of each open block: whether it holds, and the selectors that its declarations are of (None in lists of rules)
        open_blocks: list[tuple[bool, list[str] | None]] = [(True, None)]
        held: list[str] = []
        for token in _CSS.findall(_NOTE.sub(" ", sheet)) + ["}"]:
            if token not in ("{", "}", ";"):
                held.append(token)
                continue
            text, held = "".join(held).strip(), []
            holds, selectors = open_blocks[-1]
            if token == "{":
                if text[:1] == "@":
                    open_blocks.append((holds and _applies(text), selectors))
                elif selectors is None:
                    names = [x.strip() for x in text.split(",")]
                    open_blocks.append((holds, [x if x[:1] in ".#" else x.lower() for x in names if re.fullmatch(r"[.#]?[\w-]+", x)]))
                else:
                    open_blocks.append((False, []))  # a rule in a rule is of what lies in its elements
                continue
            if holds and selectors:
                declare(selectors, text)
            if token == "}" and len(open_blocks) > 1:
                open_blocks.pop()
    return {key: hides for key, (hides, _) in said.items()}


def hiding_selectors(styles: list[str]) -> frozenset[str]:
    """Simple selectors that are hidden by :func:`hiding_rules`."""
    return frozenset(s for (s, _), hides in hiding_rules(styles).items() if hides)


class Layout:
    """Lines of a block, and the inline text that isn't on a line yet."""

    __slots__ = ("lines", "held", "gap")

    def __init__(self):
        self.lines: list[str] = []
        self.held: list[str] = []
        self.gap = False

    def flush(self) -> None:
        if self.held:
            text = "".join(self.held)
            self.held = []
            parts = [_SPACE.sub(" ", part).strip(" ") for part in text.split("\0")]
            while parts and not parts[-1]:
                parts.pop()
            while parts and not parts[0]:
                parts.pop(0)
            if parts:
                self.add([p.replace("\xa0", " ") for p in parts], False)

    def add(self, lines: list[str], margin: bool) -> None:
        if not lines:
            return
        if (self.gap or margin) and self.lines and self.lines[-1]:
            self.lines.append("")
        self.lines.extend(lines)
        self.gap = margin


def _number(text: str | None, default: int, most: int | None = None) -> int:
    try:
        number = int(str(text).strip())
    except ValueError:
        return default
    if most is None:
        return number if number.bit_length() < 4096 else default  # Python doesn't write numbers of any length
    return max(min(number, most), -most)


class Renderer:
    """``dark`` is whether visibility is hidden where the renderer is: an element has it from the one around it, unless it says otherwise."""

    def __init__(self, rules: dict[tuple[str, str], bool]):
        self.rules, self.dark = rules, False

    def hides(self, e: Element, has: dict[str, str], name: str) -> bool | None:
        """Whether a property hides an element; None if nothing is said. The style counts before the id, that before classes, those before the tag; of classes that disagree, the one that shows."""
        found = [value.lower() in _HIDING[name] for key, value in _STYLE.findall(has.get("style", "")) if key.lower() == name]
        if found:
            return found[-1]
        if not self.rules:
            return None
        for names in (["#" + has.get("id", "")], ["." + c for c in has.get("class", "").split()], [e.tag]):
            said = [self.rules[s, name] for s in names if (s, name) in self.rules]
            if said:
                return all(said)
        return None

    def visible(self, e: Element) -> bool:
        """Whether an element is there at all; sets ``dark`` for what is in it."""
        if e.tag in HIDDEN:
            return False
        if not e.attributes and not self.rules:
            return e.tag != "dialog"
        has = e.get()
        if "hidden" in has or (e.tag == "dialog" and "open" not in has) or self.hides(e, has, "display") or self.hides(e, has, "content-visibility"):
            return False
        dark = self.hides(e, has, "visibility")
        if dark is None and e.tag in SVG_SHAPES and "visibility" in has:
            dark = has["visibility"] in _HIDING["visibility"]
        self.dark = self.dark if dark is None else dark
        return True

    def walk(self, e: Element, out: Layout, pre: bool) -> None:
        dark = self.dark
        for child in e.children:
            self.dark = dark
            if isinstance(child, str):
                if dark:
                    if pre:
                        out.held += ["\n"] * child.count("\n")
                    continue
                text = html.unescape(child) if "&" in child else child
                out.held.append(text if pre else text.replace("\0", ""))
                continue
            tag = child.tag
            if tag == "br":
                out.held.append("\n" if pre else "\0")
                continue
            if tag == "wbr" or not self.visible(child):
                continue
            if tag == "math":
                text = self.formula(child)
                if child.attributes and child.get().get("display", "").lower() == "block":
                    self.end(out, pre)
                    out.add([text] if text else [], False)
                else:
                    out.held.append(text)
                continue
            if tag == "svg":
                self.drawing(child, out, pre)
                continue
            if tag not in BLOCK:
                self.walk(child, out, pre)
                continue
            self.end(out, pre)
            out.add(self.block(child, pre), tag in MARGIN and not (e.tag == "li" and tag in LISTS))
            if tag == "hr":
                out.gap = True
        self.dark = dark

    def shown(self, e: Element) -> bool:
        """:meth:`visible` of an SVG element, which has an attribute for display too."""
        return self.visible(e) and (not e.attributes or e.get().get("display") != "none")

    def drawing(self, e: Element, out: Layout, pre: bool) -> None:
        """Labels and HTML of an SVG element, each on lines of its own; a switch shows one of its elements."""
        dark = self.dark
        if not self.shown(e):
            return
        inside = self.dark
        children = [c for c in e.children if isinstance(c, Element)]
        if e.tag == "switch":
            children = ([c for c in children if "systemlanguage" not in c.get()] or children)[:1]
        for child in children:
            self.dark = inside
            if child.tag in SVG_GROUPS:
                self.drawing(child, out, pre)
            elif child.tag == "foreignobject" and self.shown(child):
                self.end(out, pre)
                out.add(self.block(child), False)
            elif child.tag == "text" and self.shown(child):
                self.end(out, pre)
                label = Layout()
                self.label(child, label, child.get().get("y"))
                label.flush()
                out.add([x for x in label.lines if x], False)
        self.dark = dark

    def label(self, e: Element, out: Layout, y: str | None) -> str | None:
        """Text of an SVG text element; parts at another height are other lines. Gives the height where it ends."""
        dark = self.dark
        for child in e.children:
            self.dark = dark
            if isinstance(child, str):
                out.held.append("" if dark else html.unescape(child).replace("\0", ""))
            elif child.tag in ("tspan", "textpath", "a") and self.shown(child):
                has = child.get()
                if has.get("y", y) != y or _number(re.sub(r"[^\d-]|^-", "", has.get("dy", "0")), 0):
                    out.held.append("\0")
                elif "x" in has:
                    out.held.append(" ")
                y = self.label(child, out, has.get("y", y))
        self.dark = dark
        return y

    def formula(self, e: Element) -> str:
        """A MathML element on one line: fractions as a/b, scripts as a_b^c, roots as √(a), rows of tables apart by semicolons."""
        tag = e.tag
        if tag in ("mi", "mn", "mo", "ms", "mtext"):
            inner = Layout()
            self.walk(e, inner, False)
            text = _SPACE.sub(" ", "".join(inner.held).replace("\0", " "))
            text = " ".join([*inner.lines, text]) if inner.lines else text
            return text if tag == "mtext" else text.strip(" ")
        if tag == "mspace":
            return " "
        parts: list[str] = []
        dark = self.dark
        for child in e.children:
            self.dark = dark
            if isinstance(child, str):
                text = "" if dark else _SPACE.sub(" ", html.unescape(child).replace("\0", "")).strip(" ")
                parts += [text] if text else []
            elif child.tag not in ("annotation", "annotation-xml", "mphantom") and self.visible(child):
                if child.tag == "svg":
                    inner = Layout()
                    self.drawing(child, inner, False)
                    parts.append(" ".join(inner.lines))
                else:
                    parts.append(self.formula(child))
        self.dark = dark
        if dark and not any(parts):
            return ""
        if tag in ("semantics", "maction"):
            return "".join(parts[:1])
        if tag == "mtable":
            return "; ".join(parts)
        if tag in ("mtr", "mlabeledtr", "mmultiscripts"):
            return " ".join(x for x in parts if x)
        if tag == "msqrt":
            return f"√({''.join(parts)})"
        signs = {"mfrac": "/", "msub": "_", "munder": "_", "msup": "^", "mover": "^", "msubsup": "_^", "munderover": "_^", "mroot": "√"}.get(tag, "")
        if not signs or len(parts) != len(signs) + 1:
            return "".join(parts)
        if tag == "mroot":
            return f"{parts[1]}√({parts[0]})"
        parts = [x if re.fullmatch(r"[\w.,]*|.", x) else f"({x})" for x in parts]
        return parts[0] + "".join(sign + x for sign, x in zip(signs, parts[1:]))

    @staticmethod
    def end(out: Layout, pre: bool) -> None:
        if not pre:
            out.flush()
        elif out.held:
            lines = "".join(out.held).replace("\r\n", "\n").replace("\xa0", " ").expandtabs(8).split("\n")
            out.held = []
            while lines and not lines[-1].strip():
                lines.pop()
            out.add([x.rstrip() for x in lines], False)

    def block(self, e: Element, pre: bool = False) -> list[str]:
        dark = self.dark
        try:
            return self._block(e, pre)
        finally:
            self.dark = dark

    def _block(self, e: Element, pre: bool) -> list[str]:
        tag = e.tag
        if tag == "table":
            return self.table(e)
        if tag in LISTS:
            return self.items(e, tag == "ol")
        out = Layout()
        if tag in ("pre", "listing", "xmp", "textarea"):
            pre = True
            if e.children and isinstance(e.children[0], str) and e.children[0][:1] == "\n":
                e.children[0] = e.children[0][1:]
        if tag == "details" and "open" not in e.get():
            inner = Element("div")
            inner.children = [c for c in e.children if isinstance(c, Element) and c.tag == "summary"][:1]
            e = inner
        self.walk(e, out, pre)
        self.end(out, pre)
        if tag in ("blockquote", "dd"):
            return ["    " + x if x else x for x in out.lines]
        return out.lines

    def items(self, e: Element, ordered: bool) -> list[str]:
        out = Layout()
        k = _number(e.get().get("start"), 1) if ordered and e.attributes else 1
        loose, dark = Element("div"), self.dark

        def spill() -> None:
            self.dark = dark
            if loose.children:
                out.add(self.block(loose), False)
                loose.children = []

        for child in e.children:
            self.dark = dark
            if isinstance(child, Element) and child.tag == "li":
                spill()
                if not self.visible(child):
                    continue
                if ordered and child.attributes:
                    k = _number(child.get().get("value"), k)
                mark = f"{k}. " if ordered else "- "
                k += 1
                unmarked = self.dark
                lines = self.block(child)
                if unmarked:
                    mark = " " * len(mark)
                    if not lines:
                        continue
                out.add([(mark if i == 0 else " " * len(mark)) + x if x or i == 0 else x for i, x in enumerate(lines)], False)
            elif isinstance(child, Element) and child.tag in LISTS:
                spill()
                if self.visible(child):
                    out.add(["  " + x if x else x for x in self.block(child)], False)
            else:
                loose.children.append(child)
        self.dark = dark
        spill()
        return out.lines

    def table(self, e: Element) -> list[str]:
        before, rows = Layout(), []

        def collect(node: Element) -> None:
            dark = self.dark
            for child in node.children:
                self.dark = dark
                if isinstance(child, str):
                    if not child.isspace() and not dark:
                        before.held.append(html.unescape(child).replace("\0", ""))
                elif not self.visible(child):
                    continue
                elif child.tag in ("thead", "tbody", "tfoot"):
                    collect(child)
                elif child.tag == "tr":
                    rows.append([])
                    in_row = self.dark
                    for c in child.children:
                        self.dark = in_row
                        if isinstance(c, Element) and c.tag in ("td", "th") and self.visible(c):
                            rows[-1].append((c, self.dark))
                    self.dark = in_row
                    loose = Element("div")
                    loose.children = [c for c in child.children if not (isinstance(c, Element) and c.tag in ("td", "th"))]
                    self.walk(loose, before, False)
                elif child.tag in ("td", "th"):
                    rows.append([(child, self.dark)])
                elif child.tag not in ("col", "colgroup"):
                    before.flush()
                    if child.tag in FOREIGN:
                        loose = Element("div")
                        loose.children, child = [child], loose
                    before.add(self.block(child), False)
            self.dark = dark

        dark = self.dark
        collect(e)
        before.flush()
        grid: list[list[tuple[int, int, list[str]]]] = []  # column, columns, lines
        taken: dict[int, int] = {}  # column: rows that a span still covers
        for row in rows:
            line, column, added = [], 0, {}
            for cell, self.dark in row:
                while taken.get(column, 0) > 0:
                    column += 1
                has = cell.get() if cell.attributes else {}
                wide, tall = max(1, _number(has.get("colspan"), 1, 1000)), max(1, _number(has.get("rowspan"), 1, 65_534))
                line.append((column, wide, self.block(cell)))
                for c in range(column, column + wide):
                    added[c] = tall
                column += wide
            taken = {c: k - 1 for c, k in taken.items() if k > 1}
            for c, k in added.items():
                if k > 1:
                    taken[c] = k - 1
            grid.append(line)
        self.dark = dark
        widths: dict[int, int] = {}
        for line in grid:
            for c, wide, lines in line:
                if wide == 1:
                    widths[c] = max(widths.get(c, 0), max(map(len, lines), default=0))
        for line in grid:
            for c, wide, lines in line:
                if wide > 1:
                    need = max(map(len, lines), default=0) - sum(widths.get(i, 0) for i in range(c, c + wide)) - 3 * (wide - 1)
                    widths[c + wide - 1] = max(widths.get(c + wide - 1, 0), widths.get(c + wide - 1, 0) + need)
        out = before.lines
        offsets, x = {}, 0
        for c in range(max(widths, default=-1) + 1):
            offsets[c] = x
            x += widths.get(c, 0) + 3 if c in widths else 0
        size = sum(len(x) for line in grid for _, _, lines in line for x in lines)
        padded = sum(offsets.get(c, 0) + len(x) for line in grid for k in range(max((len(lines) for _, _, lines in line), default=0)) for c, x in [max((c, lines[k]) for c, _, lines in line if k < len(lines))])
        if padded > LOOSEST * size + 4000:
            for line in grid:
                if all(len(lines) <= 1 for _, _, lines in line):
                    out.append(" | ".join(lines[0] for _, _, lines in line if lines))
                else:
                    for _, _, lines in line:
                        out += lines
            return out
        for line in grid:
            for k in range(max((len(lines) for _, _, lines in line), default=0)):
                text = ""
                for c, _, lines in line:
                    if c and (k == 0 or (k < len(lines) and lines[k])):
                        text = text.ljust(max(offsets.get(c, 0) - 3, 0)) + " | " if offsets.get(c, 0) else text
                    if k < len(lines):
                        text = text.ljust(offsets.get(c, 0)) + lines[k]
                out.append(text.rstrip())
        return out


def page_text(page: str | None) -> str | None:
    """The laid-out visible text of a page."""
    if page is None:
        return None
    root, styles = parse_html(page)
    return "\n".join(Renderer(hiding_rules(styles)).block(root))


def extract_text(pages: DataFrame, *, html_col: str = "html", out_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``pages`` (all by default) and the visible text of each page."""
    columns = pages.columns if columns is None else columns
    kept = pages.select(*columns)
    out_name, source = S.free_name(kept, out_col), S.free_name(pages, "page_to_read")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))
        for b in S.slices(batches, source):
            texts = [page_text(p) for p in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], out_name])

    schema = T.StructType(kept.schema.fields + [T.StructField(out_name, T.StringType())])
    return pages.select(*columns, F.col(html_col).alias(source)).mapInArrow(read, schema)
