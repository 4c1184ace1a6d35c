"""Layout-aware text from HTML: a tree builder with implied tags and visibility rules, and a block renderer.

The builder keeps the stack of open elements: void elements have no content, a block start closes an open paragraph,
list items, table parts, options and definition terms close their own kind, an end tag closes what is open inside its
element, and a stray end tag is ignored. Invisible are head matter, scripts, styles, templates, what stands in for media
and frames, closed dialogs, notes of formulas and drawings, and elements with ``hidden`` or ``display:none``, with all
that they hold; text under ``visibility:hidden`` is invisible until an element within says ``visible``. Both properties
come from ``style`` attributes and from the page's own style sheets (rules of tags, classes and ids, without combinators
or conditions, for what follows them). Options, text areas and closed details count as visible, attribute values do not.
The renderer collapses white space outside ``pre``, sets paragraphs and headings apart by a blank line and other blocks by
a line break, marks list items with ``-`` or their number, indents nested lists, and pads table cells so that columns
align: a cell of several columns is as wide as they are, one of several rows keeps its columns in the rows below.

Each page is read once, whole, by its task. Defined cases: null or empty HTML gives an empty text; unclosed tags,
comments and quotes end with the page; null ids and repeated rows give a row each; further columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head title script style template noscript datalist iframe object audio video canvas noembed noframes rp desc metadata defs annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure article section".split())
BLOCK = SPACED | frozenset("html body div header footer main nav aside form fieldset address li dt dd hr figcaption center summary details caption tr td th thead tbody tfoot legend menu dialog option optgroup".split())
#: What a start tag closes, and the elements that stop the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"caption", "thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"caption", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"caption", "thead", "tbody", "tfoot"}, {"table"}),
}
_SCOPE = frozenset("table td th caption".split())


class _Flow:
    """The lines of one block context: the page or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False
        self.indent = 0
        self.mark: str | None = None

    def add(self, text: str, pre: bool) -> None:
        if pre:
            for k, part in enumerate(text.split("\n")):
                if k:
                    self.end(force=True)
                if part:
                    self._open()
                    self.now.append(part)
            return
        text = _SPACE.sub(" ", text)
        if not self.now or self.now[-1].endswith(" "):
            text = text.lstrip(" ")
        if text:
            self._open()
            self.now.append(text)

    def _open(self) -> None:
        if self.blank and self.lines and not self.now:
            self.lines.append("")
        self.blank = False

    def end(self, force: bool = False) -> None:
        line = "".join(self.now).rstrip(" ")
        self.now = []
        if line or force:
            pad = "  " * self.indent
            if self.mark is not None:
                pad, self.mark = "  " * (self.indent - 1) + self.mark, None
            self.lines.append((pad + line).rstrip(" "))

    def apart(self) -> None:
        self.end()
        self.blank = True

    def block(self, lines: list[str]) -> None:
        self.end()
        if lines:
            self._open()
            self.lines += ["  " * self.indent + x if x else x for x in lines]

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s) if not s.isascii() else len(s)


Cell = tuple[list[str], int, int]


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Rows of cells (lines, columns, rows) as text: every column as wide as its widest line, two spaces between columns."""
    placed, below = [], []
    for cells in rows:
        at, row, lower = 0, [], []
        for lines, wide, high in cells:
            for start, end, _ in sorted(below):
                at = end if start <= at < end else at
            row.append((at, at + wide, lines))
            if high > 1:
                lower.append((at, at + wide, high - 1))
            at += wide
        below = [(start, end, left - 1) for start, end, left in below if left > 1] + lower
        if any(any(lines) for _, _, lines in row):
            placed.append(row)
    starts = sorted({start for row in placed for start, _, _ in row})
    widths = [0] * len(starts)
    spans = [(bisect_left(starts, start), bisect_left(starts, end), max(map(_width, lines), default=0)) for row in placed for start, end, lines in row]
    for first, end, need in sorted(spans, key=lambda s: s[1] - s[0]):
        widths[end - 1] += max(0, need - sum(widths[first:end]) - 2 * (end - first - 1))
    offsets = [sum(widths[:k]) + 2 * k for k in range(len(widths))]
    out = []
    for row in placed:
        for n in range(max(len(lines) for _, _, lines in row)):
            line, used = "", 0
            for start, _, lines in row:
                if n < len(lines) and lines[n]:
                    pad = max(0, offsets[bisect_left(starts, start)] - used)
                    line, used = line + " " * pad + lines[n], used + pad + _width(lines[n])
            out.append(line.rstrip(" "))
    return out


_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_DECLARATION = re.compile(r"(?:[^;\"'(]++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|\([^)]*+(?:\)|\Z))++")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)\Z")


def declared(style: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of a declaration list: (important, value); of equal rank the last counts."""
    out: dict[str, tuple[bool, str]] = {}
    for m in _DECLARATION.finditer(style):
        name, _, value = m[0].partition(":")
        name = name.strip().lower()
        if name in ("display", "visibility"):
            value = value.strip().lower()
            important = value.endswith("!important")
            value = value.removesuffix("!important").strip()
            if value and (important or not out.get(name, (False,))[0]):
                out[name] = important, value
    return out


def sheet_rules(css: str) -> list[tuple[str | None, frozenset, dict]]:
    """Rules (tag, classes and ids with their signs, declarations) of a style sheet; rules under conditions are left out."""
    rules, at, css = [], 0, _COMMENT.sub(" ", css)
    while (brace := css.find("{", at)) >= 0:
        head, depth, end = css[at:brace].strip(), 1, brace + 1
        while depth and end < len(css):
            depth += {"{": 1, "}": -1}.get(css[end], 0)
            end += 1
        body, at = css[brace + 1 : end - 1 if not depth else end], end
        head = head.rpartition(";")[2].strip()
        said = {} if head.startswith("@") else declared(body)
        for selector in head.split(",") if said else ():
            m = _SELECTOR.match(selector.strip())
            if m and m[0]:
                rules.append((None if m[1] in (None, "*") else m[1].lower(), frozenset(re.findall(r"[.#][\w-]+", m[2])), said))
    return rules


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case and values; of repeated names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        value = m[2] or m[3] or m[4] or ""
        out.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return out


def span_of(value: str | None, most: int) -> int:
    """Columns or rows of a cell; what is no number from 1 on is 1, and ``most`` is the most that HTML knows."""
    m = re.match(r"\s*\+?(\d{1,9})", value or "")
    return min(max(1, int(m[1])), most) if m else 1


class _Builder:
    def __init__(self) -> None:
        self.flows = [_Flow()]
        #: Open elements: tag, whether it is not displayed, and whether text was visible before it.
        self.stack: list[tuple[str, bool, bool]] = []
        self.hidden = 0
        self.visible = True
        self.rules: list = []
        #: Columns and rows of the open cells.
        self.cells: list[tuple[int, int]] = []
        self.pre = 0
        self.lists: list[list] = []
        self.tables: list[list] = []

    @property
    def flow(self) -> _Flow:
        return self.flows[-1]

    def text(self, raw: str) -> None:
        if not self.hidden and self.visible and raw:
            self.flow.add(html.unescape(raw).replace("\xa0", " ") if "&" in raw else raw, self.pre > 0)

    def start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK and tag not in ("html", "body"):
            self._close_upto({"p"}, _SCOPE)
        if tag in IMPLIED:
            self._close_upto(*IMPLIED[tag])
        if tag in VOID:
            if not self.hidden:
                if tag == "br":
                    self.flow.end(force=bool(self.flow.now))
                elif tag == "hr":
                    self.flow.apart()
            return
        named = attributes(attrs) if attrs else {}
        display, visibility = self._shown(tag, named) if named or self.rules else (None, None)
        gone = tag in HIDDEN or display == "none" or (tag == "dialog" and "open" not in named and display is None) or ("hidden" in named and display is None)
        self.stack.append((tag, gone, self.visible))
        if visibility is not None:
            self.visible = visibility == "visible" or (visibility not in ("hidden", "collapse") and self.visible)
        if gone:
            self.hidden += 1
        if self.hidden:
            return
        if tag == "table":
            self.flow.apart()
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.flows.append(_Flow())
            self.cells.append((span_of(named.get("colspan"), 1000), span_of(named.get("rowspan"), 65534)))
        elif tag in SPACED and not (tag in ("ul", "ol") and self.lists):
            self.flow.apart()
        elif tag in BLOCK:
            self.flow.end()
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.flow.indent += 1
            self.flow.mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
        elif tag in ("dd", "blockquote"):
            self.flow.indent += 1
        elif tag in ("pre", "textarea"):
            self.pre += 1

    def _shown(self, tag: str, named: dict[str, str]) -> tuple[str | None, str | None]:
        """display and visibility as the page's rules and the element's own style say, by importance, then precision, then order."""
        found: dict[str, tuple] = {}
        if self.rules:
            signs = {"." + c for c in named.get("class", "").split()} | ({"#" + named["id"].strip()} if named.get("id", "").strip() else set())
            for order, (of, wanted, said) in enumerate(self.rules):
                if (of is None or of == tag) and wanted <= signs:
                    precision = (sum(w[0] == "#" for w in wanted), sum(w[0] == "." for w in wanted), of is not None)
                    for name, (important, value) in said.items():
                        found[name] = max(found.get(name, ()), (important, False, precision, order, value))
        if "style" in named:
            for name, (important, value) in declared(named["style"]).items():
                found[name] = max(found.get(name, ()), (important, True, (0, 0, False), 0, value))
        return tuple(found[n][-1] if n in found else None for n in ("display", "visibility"))

    def _close_upto(self, tags: set, stop) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[k][0]
            if tag in tags:
                outer = k
                while outer and self.stack[outer - 1][0] in tags:
                    outer -= 1
                while len(self.stack) > outer:
                    self._pop()
                return
            if tag in stop or (tag in BLOCK and "p" in tags and tag != "p"):
                return

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.start("br", "")
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k][0] in _SCOPE and tag not in ("table", "tr", "thead", "tbody", "tfoot", "body", "html"):
                return
        return

    def _pop(self) -> None:
        tag, gone, self.visible = self.stack.pop()
        if gone:
            self.hidden -= 1
            return
        if self.hidden:
            return
        if tag in ("td", "th") and self.tables and len(self.flows) > 1:
            self.tables[-1][-1].append((self.flows.pop().done(), *self.cells.pop()))
            return
        if tag == "table" and self.tables:
            self.flow.block(aligned(self.tables.pop()))
            self.flow.apart()
            return
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag in ("li", "dd", "blockquote"):
            self.flow.end()
            self.flow.indent = max(0, self.flow.indent - 1)
            self.flow.mark = None
        if tag in ("pre", "textarea"):
            self.pre = max(0, self.pre - 1)
        if tag in SPACED and not (tag in ("ul", "ol") and self.lists):
            self.flow.apart()
        elif tag in BLOCK:
            self.flow.end()

    def finish(self) -> str:
        while self.stack:
            self._pop()
        return "\n".join(self.flow.done())


def render(page: str) -> str:
    """All visible text of a page."""
    b, at = _Builder(), 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            b.text(page[at:])
            return b.finish()
        if m.start() > at:
            b.text(page[at : m.start()])
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                b.end(tag)
            else:
                b.start(tag, m[3])
                if tag in RAW:
                    close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
                    stop = close.start() if close else len(page)
                    if tag == "style":
                        b.rules += sheet_rules(page[at:stop])
                    b.text(page[at:stop])
                    at = stop
                    if not close:
                        return b.finish()


_ARROW = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64())])


def _render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column(1).to_pylist()
        texts = [render(x or "") for x in pages]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], schema=_ARROW)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, text, n_lines."""
    bounded_batches(pages.sparkSession)
    return pages.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{html_col}`")).mapInArrow(_render_batches, "page_id long, text string, n_lines long")


def _rendered(pages: pd.Series) -> pd.Series:
    return pages.map(lambda x: render(x or ""))


def visible_text(page: Column | str) -> Column:
    """render() as a column function."""
    return F.pandas_udf(_rendered, "string")(page)
