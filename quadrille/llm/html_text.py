"""Layout-aware text of HTML pages (operator 4).

A tree builder reads tags with the implied ends that HTML allows, keeps a stack of open elements, and hands the visible ones to a layout:
block elements stand on lines of their own, paragraphs and headings are set off by a blank line, list items get their mark and indent, table cells
are padded so that columns align. Nothing is recursive and open elements are found by name, so nesting may be of any depth, in time that follows the page's length.

Two things are bounded, so that the text of a page cannot grow with its square: indents stop growing after ``_DEEPEST`` levels (deeper items keep their marks, tables
deeper than ``_DEEPEST_TABLE`` frames their cells, side by side), and a column whose padding would outweigh its table many times is not padded.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"))
_HIDDEN = frozenset(("script", "style", "title", "head", "noscript", "template", "iframe", "noembed", "noframes", "object", "audio", "video", "canvas", "datalist", "param", "source"))
#: Not shown within these two.
_HIDDEN_IN = {"svg": frozenset(("desc", "metadata", "defs", "symbol", "clippath", "mask", "pattern", "marker")), "math": frozenset(("annotation", "annotation-xml"))}
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_PARAGRAPHS = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "dl", "table", "figure", "fieldset", "hr"))
_BLOCKS = _PARAGRAPHS | frozenset(("html", "body", "address", "article", "aside", "caption", "center", "dd", "details", "dialog", "div", "dt", "figcaption", "footer", "form", "header", "legend", "li", "main", "nav", "section", "summary", "tr", "option", "optgroup"))
#: A start tag ends these open elements, looking up no farther than the bounds.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)), "body": (("head",), ()),
}
#: The first of these after an unclosed head ends it.
_HEAD_ONLY = frozenset(("title", "meta", "link", "base", "style", "script", "noscript", "template", "head", "html"))
_DEEPEST = 24
_DEEPEST_TABLE = 256
#: Padding of a column: so many times the characters of its table, and so many more, at most.
_PADDING, _MORE_PADDING = 16, 100_000
#: The largest colspan that HTML allows.
_WIDEST_SPAN = 1000
_BLOCKLIKE = _BLOCKS | frozenset(("td", "th"))


class _Frame:
    """Lines of a list item, table cell or the page; ``gap``: line breaks due before the next text."""

    __slots__ = ("kind", "lines", "parts", "gap", "space", "rows", "count", "mark")

    def __init__(self, kind: str):
        self.kind, self.lines, self.parts, self.gap, self.space, self.rows, self.count = kind, [], [], 0, False, [], 0
        self.mark: list[str] = []  # due before the next text

    def end_line(self) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip(" "))
            self.parts = []
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def due(self) -> None:
        if self.gap and self.lines and self.gap > 1 and self.lines[-1]:
            self.lines.append("")
        self.gap = 0
        self.parts += self.mark
        self.mark = []

    def text(self, text: str) -> None:
        flat = _SPACE.sub(" ", text)
        if flat == " ":
            self.space = self.space or bool(self.parts)
            return
        if not flat:
            return
        if not self.parts:
            self.due()
            flat = flat.lstrip(" ")
        elif self.space and flat[0] != " ":
            self.parts.append(" ")
        elif self.space or flat[0] == " ":
            flat = " " + flat.lstrip(" ")
        self.space = flat[-1] == " "
        self.parts.append(flat.rstrip(" ") if self.space else flat)

    def verbatim(self, text: str) -> None:
        if not self.parts:
            self.due()
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self.parts.append(first)
        for line in rest:
            self.lines.append("".join(self.parts))
            self.parts = [line]

    def add(self, lines: list[str], gap: int) -> None:
        self.block(gap)
        if lines:
            self.due()
            self.end_line()
            self.lines += lines
        self.gap = max(self.gap, gap)

    def finish(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        at = next((i for i, x in enumerate(self.lines) if x.strip()), 0)
        return self.lines[at:]


def _aligned(rows: list[list[list[str]]]) -> list[str]:
    """Lines of a table: each column as wide as its widest line, but for columns whose padding would be out of all proportion."""
    widths: list[int] = []
    counts: list[int] = []
    used: list[int] = []
    for row in rows:
        height = max(map(len, row), default=0)
        for k, cell in enumerate(row):
            if k == len(widths):
                widths.append(0)
                counts.append(0)
                used.append(0)
            widths[k] = max(widths[k], max(map(len, cell), default=0))
            counts[k] += height
            used[k] += sum(map(len, cell))
    most = _PADDING * sum(used) + _MORE_PADDING
    widths = [w if w * n - u <= most else 0 for w, n, u in zip(widths, counts, used, strict=True)]
    out = []
    for row in rows:
        for i in range(max(map(len, row), default=0)):
            out.append("  ".join((cell[i] if i < len(cell) else "").ljust(widths[k]) for k, cell in enumerate(row)).rstrip(" "))
    return [x for x in out if x]


class Page:
    """Open elements (name, gone, frame or None, whether text was invisible before) and the frames they write to."""

    def __init__(self):
        self.open: list[tuple[str, bool, _Frame | None, bool]] = []
        self.at: dict[str, list[int]] = {}  # places of the open elements of each name
        self.blocks: list[int] = []  # places of those that end a search for an open paragraph
        self.frames = [_Frame("page")]
        self.counters: list[int | None] = []
        self.hidden = self.pre = 0
        self.invisible = False

    def last(self, *names: str) -> int:
        """Place of the innermost open element of these names; -1 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def push_element(self, name: str, gone: bool, frame: _Frame | None, invisible: bool) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        if name in _BLOCKLIKE:
            self.blocks.append(len(self.open))
        self.open.append((name, gone, frame, self.invisible))
        self.invisible = invisible

    def close_from(self, place: int) -> None:
        while len(self.open) > place:
            self.pop()

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if self.open and self.open[-1][0] == "head" and name not in _HEAD_ONLY:
            self.end("head")
        if name in _ENDS:
            ends, bounds = _ENDS[name]
            bound = self.last(*bounds)
            ended = [self.at[n][k] for n in ends if self.at.get(n) and (k := bisect_right(self.at[n], bound)) < len(self.at[n])]
            if ended:
                self.close_from(min(ended))
        elif name in _BLOCKS and name not in ("html", "body", "option", "optgroup"):
            self.end_paragraph()
        if name in ("td", "th") and self.last("tr") <= self.last("table"):
            self.start("tr", {})
        if name == "tr" and self.last("table") < 0:
            self.start("table", {})
        style = attributes.get("style", "")
        gone = name in _HIDDEN or "hidden" in attributes or (name == "input" and attributes.get("type", "").lower() == "hidden") or bool(_GONE.search(style))
        gone = gone or any(name in inside and self.last(outer) >= 0 for outer, inside in _HIDDEN_IN.items())
        shown_as = _VISIBILITY.findall(style)
        invisible = shown_as[-1].lower() != "visible" if shown_as else self.invisible
        top = self.frames[-1]
        if not self.hidden and not gone and not invisible:
            if name == "br":
                if not top.parts:
                    top.due()
                    top.parts.append("")
                top.end_line()
            elif name == "hr":
                top.block(2)
            elif name == "input" and attributes.get("type", "text").lower() in ("text", "submit", "button", "reset") and (shown := attributes.get("value", "").strip()):
                top.text(f" {shown} ")
        if name in _VOID:
            return
        frame = None
        if not self.hidden and not gone:
            deep = len(self.frames) >= _DEEPEST
            if name == "li":
                frame = self.item(deep)
            elif name == "table":
                if len(self.frames) < _DEEPEST_TABLE:
                    frame = self.push("table")
                else:
                    top.block(2)
            elif name in ("td", "th") and top.kind == "table":
                frame = self.push("cell")
                span = attributes.get("colspan", "")
                frame.count = max(1, min(_WIDEST_SPAN, int(span[:9]))) if span.isdecimal() else 1
            elif name in ("td", "th", "text"):
                top.space = top.space or bool(top.parts)
            elif name in ("ul", "ol", "menu", "dl"):
                top.block(1 if self.in_item() else 2)
            elif name == "dd":
                top.block(1)
                frame = None if deep else self.push("dd")
            elif name == "blockquote":
                if deep:
                    top.block(2)
                else:
                    frame = self.push("quote")
            elif name == "tr" and top.kind == "table":
                top.rows.append([])
            elif name in _BLOCKS:
                top.block(2 if name in _PARAGRAPHS else 1)
            if name == "ol":
                number = attributes.get("start", "1")
                self.counters.append(int(number) if number.isdecimal() and len(number) < 9 else 1)
            elif name in ("ul", "menu"):
                self.counters.append(None)
            elif name == "pre":
                self.pre += 1
        self.push_element(name, gone, frame, invisible)
        self.hidden += gone

    def in_item(self) -> bool:
        return self.frames[-1].kind == "li"

    def push(self, kind: str) -> _Frame:
        self.frames.append(_Frame(kind))
        return self.frames[-1]

    def item(self, deep: bool) -> _Frame | None:
        top, mark = self.frames[-1], "- "
        top.block(1)
        if self.counters and self.counters[-1] is not None:
            mark = f"{self.counters[-1]}. "
            self.counters[-1] += 1
        if deep:  # the mark, without a further indent
            top.mark.append(mark)
            return None
        frame = self.push("li")
        frame.rows = [mark]
        return frame

    def end_paragraph(self) -> None:
        """Close the innermost block if it is a paragraph."""
        if self.blocks and self.open[self.blocks[-1]][0] == "p":
            self.close_from(self.blocks[-1])

    def end(self, name: str) -> None:
        """An end tag closes the innermost element of its name, and all within; without one it does nothing (``</br>`` is a break)."""
        if name == "br":
            self.start("br", {})
            return
        place = self.last(name)
        if place > (self.last("table") if name not in ("table", "body", "html", "div", "section", "article", "main") else -1):
            self.close_from(place)

    def pop(self) -> None:
        name, hides, frame, self.invisible = self.open.pop()
        self.at[name].pop()
        if name in _BLOCKLIKE:
            self.blocks.pop()
        self.hidden -= hides
        if frame is not None:
            self.frames.pop()
            top, lines = self.frames[-1], frame.finish() if frame.kind != "table" else []
            if frame.kind == "li":
                mark = frame.rows[0]
                top.add([(mark if i == 0 else " " * len(mark) if x else "") + x for i, x in enumerate(lines)], 1)
            elif frame.kind == "dd":
                top.add(["    " * bool(x) + x for x in lines], 1)
            elif frame.kind == "quote":
                top.add(["  " * bool(x) + x for x in lines], 2)
            elif frame.kind == "cell":
                if not top.rows:
                    top.rows.append([])
                top.rows[-1] += [lines] + [[]] * (frame.count - 1)
            else:
                top.add(frame.finish() + _aligned(frame.rows), 2)  # text between the tags of a table stands before it
        elif self.hidden or hides:
            return
        elif name == "li" and self.frames[-1].mark:  # without a text
            self.frames[-1].mark.pop()
        elif name in ("ul", "ol", "menu"):
            self.counters.pop()
            self.frames[-1].block(1 if self.in_item() else 2)
        elif name == "pre":
            self.pre -= 1
            self.frames[-1].block(2)
        elif name in ("td", "th", "text"):
            self.frames[-1].space = self.frames[-1].space or bool(self.frames[-1].parts)
        elif name in _BLOCKS and (name != "tr" or self.frames[-1].kind != "table"):
            self.frames[-1].block(2 if name in _PARAGRAPHS else 1)

    def text(self, text: str) -> None:
        if self.hidden or self.invisible or not text or self.last("svg") > self.last("text", "foreignobject"):
            return
        if self.open and self.open[-1][0] == "head":
            if not text.strip():
                return
            self.end("head")
            return self.text(text)
        if "&" in text:
            text = unescape(text)
        if self.pre:
            self.frames[-1].verbatim(text)
        else:
            self.frames[-1].text(text)


def render(html: str | None) -> str:
    """Visible text of a page, blocks on lines of their own. Null and empty pages give an empty text; any text is valid input."""
    page, at, source = Page(), 0, html or ""
    find = _TAG.search
    while m := find(source, at):
        page.text(source[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            page.end(name)
            continue
        attributes = {a.lower(): unescape(x or y or z) for a, x, y, z in _ATTR.findall(m[3])} if m[3] and m[3] != "/" else {}
        page.start(name, attributes)
        if name in _RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
            inside = source[at : close.start() if close else len(source)]
            if name in ("textarea", "xmp"):
                page.text(inside)
            at = close.start() if close else len(source)
    page.text(source[at:])
    while page.open:
        page.pop()
    return "\n".join(page.frames[0].finish())


def visible_text(html: str) -> Column:
    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([render(p) for p in pages], dtype=object)

    return of(F.col(html).cast("string"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, text) for every row of ``pages`` (columns page_id and html). A null page gives an empty text; rows that repeat give equal rows."""
    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), visible_text("html").alias("text"))
