"""Layout-aware text of HTML pages: a tree builder with implied tags and visibility rules, and a renderer that keeps block
spacing, lists and aligned table cells.

All visible text is kept: nothing is judged to be boilerplate. Not visible: script, style, template, head but for the
title, comments, elements with the hidden attribute, display:none or visibility:hidden, hidden inputs, passwords, and of svg
what only names or defines (title, desc, metadata, defs, symbol) and of math its annotations. aria-hidden hides from screen
readers only, so its text is kept. Text that an svg paints only by <use> of its defs isn't followed.
A closed details element and the options of a closed select are a click away, and their text is kept as well.
Null and empty pages give empty text. Broken markup never fails: open elements end with their parent or with the page, a tag
that never ends is text. Any page takes time in proportion to its length and that of its text: tags are found by one scan,
open elements by their names' places on the stack, and nested tables are rendered from an explicit stack. Indentation stops
growing at DEEP levels.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template noscript iframe noembed noframes object canvas audio video datalist".split())
#: Not painted inside svg and math; elements in which HTML goes on; and start tags that end an open svg or math.
UNSEEN_FOREIGN = frozenset("title desc metadata defs symbol annotation annotation-xml".split())
HTML_AGAIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Inputs whose value isn't painted as text.
UNSEEN_INPUTS = frozenset("hidden password checkbox radio file image range color".split())
BLOCK = frozenset("xmp html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table ul caption tr".split())
SPACED = frozenset("xmp p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure form article section fieldset".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
#: A start tag ends these open elements, looked for up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "a": ({"a"}, {"table", "td", "th", "caption", "object"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: End tags that reach across such elements.
ACROSS = frozenset("table tr td th tbody thead tfoot caption button template".split())
#: Elements that an end tag doesn't reach across, and those whose paragraphs a block's start doesn't end.
SCOPE = frozenset("table td th caption html object template button".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r">|=[ \t\n\r\f]*([\"'])")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw and not raw.isspace() else {}


class Builder:
    """Open elements as a stack, and the places of each name on it; text as strings among a node's children."""

    def __init__(self):
        self.root = Node("html")
        self.body = Node("body")
        self.title = ""
        self.root.children.append(self.body)
        self.stack = [self.root, self.body]
        self.places: dict[str, list[int]] = {}

    def _last(self, tags) -> int:
        """The place on the stack of the innermost open element of these names, else 0."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def _push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def _close(self, place: int) -> None:
        """Ends the element at the place and all within it."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def _foreign(self) -> int:
        """The place on the stack of the svg or math whose content comes next, else 0."""
        place = self._last(("svg", "math"))
        return place if place and place > self._last(HTML_AGAIN) else 0

    def _end(self, tags, stops) -> None:
        while (place := self._last(tags)) > self._last(stops):
            self._close(place)

    def start(self, tag: str, raw: str, closed: bool) -> None:
        if tag in ("html", "head", "body"):
            return
        foreign = self._foreign()
        if foreign and tag in BREAKOUT:
            self._close(foreign)
            foreign = 0
        if foreign:
            return self._start_foreign(tag, raw, closed)
        if tag in BLOCK and tag not in ("html", "body", "tr", "caption"):
            self._end({"p"}, SCOPE)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", "", False)  # implied
        node = Node(tag, _attributes(raw))
        self.stack[-1].children.append(node)
        if tag not in VOID and not (closed and tag in ("svg", "math")):
            self._push(node)

    def _start_foreign(self, tag: str, raw: str, closed: bool) -> None:
        attrs = _attributes(raw)
        if tag in UNSEEN_FOREIGN or attrs.get("display") == "none" or attrs.get("visibility") in ("hidden", "collapse"):
            attrs["hidden"] = ""
        elif tag in ("text", "mtd") or tag == "tspan" and not attrs.keys().isdisjoint(("x", "y", "dy")) or self.stack[-1].tag == "mfrac":
            attrs["\0apart"] = ""  # painted at a place of its own
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        if not closed:
            self._push(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.start("br", "", True)
        if tag == "p" and not self.places.get("p"):
            self.start("p", "", False)
        tags = HEADINGS if tag in HEADINGS else (tag,)
        place = self._last(tags)
        if place and (tag in ACROSS or place >= self._last(SCOPE)):
            self._close(place)

    def text(self, s: str) -> None:
        if s:
            self.stack[-1].children.append(entities.unescape(s) if "&" in s else s)

    def build(self, page: str) -> Node:
        at, text, n, end = 0, 0, len(page), page.rfind(">")  # no tag ends after `end`
        unclosed = {'"': n + 1, "'": n + 1}  # from here on, no such quote follows
        while (at := page.find("<", at)) >= 0:
            c = page[at + 1 : at + 2]
            if c in ("!", "?"):
                self.text(page[text:at])
                if page.startswith("<!--", at):
                    to = page.find("-->", at + 4)
                elif page.startswith("<![CDATA[", at):
                    to = page.find("]]>", at)
                    self.text(page[at + 9 : to if to >= 0 else n])
                else:
                    to = page.find(">", at) - 2 if at < end else -1
                at = text = to + 3 if to >= 0 else n
                continue
            m = _NAME.match(page, at + 1 + (c == "/"))
            if not m or c != "/" and m.end() > end:
                at += 1
                continue
            self.text(page[text:at])
            tag = m[0].lower()
            if c == "/":
                to = page.find(">", m.end()) if m.end() <= end else -1
                at = text = to + 1 if to >= 0 else n
                self.end(tag)
                continue
            to = self._tag_end(page, m.end(), end, unclosed)
            closed = page[to - 1] == "/" and to > m.end()
            at = text = to + 1
            self.start(tag, page[m.end() : to - closed], closed)
            if tag in RAW and not (tag == "title" and self.stack[-1].tag == "title" and "hidden" in self.stack[-1].attrs) and not (closed and self._foreign()):
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                inner = page[at : close.start() if close else n]
                if tag == "title" and not self.title:
                    self.title = _SPACE.sub(" ", entities.unescape(inner)).strip()
                elif tag == "textarea":
                    self.text(inner)
                elif tag == "xmp":
                    self.stack[-1].children.append(inner)
                at = text = close.end() if close else n
                self.end(tag)
        self.text(page[text:])
        return self.root

    @staticmethod
    def _tag_end(page: str, at: int, end: int, unclosed: dict[str, int]) -> int:
        """The place of the > that ends a tag whose attributes start at `at`: not one within a quoted value. A quote that
        never closes is a character like others. at <= end, so there is a >."""
        start = at
        while m := _STOP.search(page, at):
            if not m[1]:
                return m.start()
            close = page.find(m[1], m.end()) if m.end() < unclosed[m[1]] else -1
            if close < 0:
                unclosed[m[1]] = min(unclosed[m[1]], m.end())
            elif close > end:  # nothing would end the tag
                break
            at = close + 1 if close >= 0 else m.end()
        return page.find(">", start)


def hidden(node: Node) -> bool:
    a = node.attrs
    return node.tag in UNSEEN or node.tag == "title" or bool(a) and ("hidden" in a or "style" in a and _HIDING.search(a["style"]) is not None or node.tag == "input" and a.get("type", "").lower() == "hidden")


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in s)


#: Levels of indentation.
DEEP = 50


class Renderer:
    """Lines of text; a pending gap of 1 (new line) or 2 (blank line) stands before the next text."""

    def __init__(self):
        self.lines: list[str] = []  # finished ones
        self.parts: list[str] = []  # of the line at hand
        self.gap = 0
        self.prefix: list[str] = []
        self.mark = ""

    def _break(self, gap: int) -> None:
        if self.lines or self.parts:
            self.gap = max(self.gap, gap)

    def _open(self) -> None:
        if self.gap:
            self.lines.append("".join(self.parts).rstrip())
            self.lines += [""] * (self.gap - 1)
            self.parts, self.gap = [], 0
        if not self.parts and (self.prefix or self.mark):
            lead = "".join(self.prefix[:DEEP])
            self.parts.append(lead[: len(lead) - len(self.mark)] + self.mark if self.mark else lead)
            self.mark = ""

    def _put(self, s: str) -> None:
        self._open()
        self.parts.append(s)

    def text(self, s: str, pre: bool) -> None:
        if pre:
            for i, line in enumerate(s.replace("\r\n", "\n").split("\n")):
                if i:
                    self.gap += 1
                if line:
                    self._put(line)
            return
        s = _SPACE.sub(" ", s).replace("\xad", "").replace("\u200b", "")
        if s.startswith(" ") and (self.gap or not self.parts or self.parts[-1].endswith(" ")):
            s = s[1:]
        if s:
            self._put(s)

    def walk(self, top: Node):
        """Yields the cells of tables, to be sent their texts; returns the text. Iterative, as nesting may be deep."""
        todo: list[tuple] = [("in", top, False)]
        while todo:
            what, node, pre = todo.pop()
            if what == "call":
                node()
            elif isinstance(node, str):
                self.text(node, pre)
            elif hidden(node):
                continue
            elif node.tag == "table":
                lines = yield from table_lines(node)
                self._break(2)
                for line in lines:
                    self._put(line)
                    self.gap = 1
                self._break(2)
            else:
                self._element(node, pre, todo)
        lines = [*self.lines, "".join(self.parts)]
        while len(lines) > 1 and not lines[-1].strip():
            lines.pop()
        return "\n".join(x.rstrip() for x in lines)

    def _element(self, node: Node, pre: bool, todo: list) -> None:
        tag = node.tag
        if tag == "br":
            if self.lines or self.parts:
                self.gap += 1
            return
        if tag == "hr":
            self._break(2)
            return
        if tag == "img":
            if node.attrs.get("alt"):
                self.text(node.attrs["alt"], False)
            return
        if tag == "input":
            kind = node.attrs.get("type", "text").strip().lower()
            shown = node.attrs.get("alt" if kind == "image" else "value")
            if shown and (kind == "image" or kind not in UNSEEN_INPUTS):
                self.text(shown, False)
            return
        pre = pre or tag in ("pre", "textarea", "xmp")
        gap = 2 if tag in SPACED else 1 if tag in BLOCK else 0
        if tag in ("ul", "ol") and self.prefix:
            gap = 1
        after: list = []
        if gap:
            self._break(gap)
            after.append(lambda: self._break(gap))
        if tag in ("ul", "ol", "menu", "dir"):
            number = int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
            for c in node.children:
                if isinstance(c, Node) and c.tag == "li":
                    c.attrs["\0mark"] = f"{number}. " if tag == "ol" else "- "
                    number += 1
        lead = {"blockquote": "> ", "dd": "  "}.get(tag, "")
        if tag == "li":
            mark = node.attrs.get("\0mark", "- ")
            lead = " " * len(mark)
            self.mark = mark
        if lead:
            self.prefix.append(lead)
            after.append(lambda: (self.prefix.pop(), setattr(self, "mark", "")))
        todo += [("call", f, False) for f in after] + [("in", c, pre) for c in reversed(node.children)]
        if tag in ("option", "td", "th", "button", "label"):
            todo.insert(len(todo) - len(node.children), ("call", lambda: self.text(" ", False), False))
        if "\0apart" in node.attrs:
            space = ("call", lambda: self.text(" ", False), False)
            todo.insert(len(todo) - len(node.children), space)
            todo.append(space)


#: Table cells whose text is longer than this don't widen their column.
COLUMN = 40


#: Fixed value: the most columns that a cell may span by the HTML standard.
SPAN = 1000


def table_lines(table: Node):
    """Each row's cells, padded to their column's width; a cell of several lines continues below; spans take their place.
    Yields the nodes to be rendered and is sent their texts; returns the lines."""
    rows, captions, groups = [], [], [table]
    while groups:
        g = groups.pop()
        found = []
        for c in g.children:
            if isinstance(c, Node) and not hidden(c):
                if c.tag in ("thead", "tbody", "tfoot"):
                    found.append(c)
                elif c.tag == "tr":
                    rows.append(c)
                elif c.tag not in ("col", "colgroup"):
                    captions.append(c)
            elif isinstance(c, str) and c.strip():
                captions.append(c)
        groups += found[::-1]
    lines = []
    for c in captions:
        text = (yield inner(c)) if isinstance(c, Node) else c.strip()
        lines += [x for x in text.split("\n") if x]
    grid: list[dict[int, list[str]]] = [{} for _ in rows]
    number = lambda s, most: min(most, max(1, int(s))) if re.fullmatch(r"\d{1,6}", s) else 1
    below: list[tuple[int, int, int]] = []  # columns from, to, and the last row of cells that reach down, by column
    for y, row in enumerate(rows):
        x, k, new = 0, 0, []
        for c in row.children:
            if isinstance(c, str):
                if c.strip():
                    lines.append(_SPACE.sub(" ", c).strip())
                continue
            if hidden(c):
                continue
            while k < len(below) and below[k][0] <= x:
                x = max(x, below[k][1])
                k += 1
            across, down = number(c.attrs.get("colspan", ""), SPAN), number(c.attrs.get("rowspan", ""), len(rows) - y)
            grid[y][x] = (yield inner(c)).split("\n")
            if down > 1:
                new.append((x, x + across, y + down - 1))
            x += across
        below = _joined([b for b in below if b[2] > y], new)
    widths: dict[int, int] = {}
    for row in grid:
        for x, cell in row.items():
            w = max(map(width, cell))
            widths[x] = max(widths.get(x, 0), w if w <= COLUMN else 0)
    begin, upto = {}, 0
    for x in sorted(widths):
        begin[x] = upto
        upto += widths[x] + 2
    for row in grid:
        for k in range(max((len(c) for c in row.values()), default=0)):
            parts, at, more = [], 0, 0  # more: what wider cells have pushed the rest of the line by
            for x in row:  # in order of columns
                cell = row[x][k] if k < len(row[x]) else ""
                if cell:
                    w = width(cell)
                    parts += [" " * (begin[x] + more - at), cell]
                    at = begin[x] + more + w
                    more += max(0, w - widths[x])
            if line := "".join(parts).rstrip():
                lines.append(line)
    return lines


def _joined(old: list[tuple], new: list[tuple]) -> list[tuple]:
    """Spans in order of columns; neighbours that end with the same row as one."""
    out: list[tuple] = []
    for a, b, last in sorted(old + new) if new else old:
        if out and out[-1][1] == a and out[-1][2] == last:
            out[-1] = (out[-1][0], b, last)
        else:
            out.append((a, b, last))
    return out


def inner(node: Node) -> Node:
    """A cell's content as a block of its own."""
    out = Node("div", {k: v for k, v in node.attrs.items() if k != "style"})
    out.children = node.children
    return out


def text_of(node: Node) -> str:
    """Renders a node; cells within cells stand on a stack of their own."""
    open_, sent = [Renderer().walk(node)], None
    while True:
        try:
            cell = open_[-1].send(sent)
            open_.append(Renderer().walk(cell))
            sent = None
        except StopIteration as e:
            open_.pop()
            sent = e.value
            if not open_:
                return sent


def rendered(page: str) -> tuple[str, str]:
    """(title, visible text)."""
    b = Builder()
    b.build(page)
    return b.title, text_of(b.body)


def _run(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 128):
            batch = whole.slice(at, 128)
            got = [rendered((x or b"").decode(errors="replace").replace("\0", "")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["page_id", "title", "text"])


def page_texts(pages: DataFrame) -> DataFrame:
    """pages (page_id, html, ...) -> page_id, title, text, n_chars, n_lines, one row each; no shuffle. An empty table gives an
    empty one; extra columns are ignored; rows that share a page_id are rendered each."""
    pages = frugal(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("binary").alias("html"))
    out = pages.mapInArrow(_run, "page_id long, title string, text string")
    return out.withColumns({"n_chars": F.length("text").cast("long"), "n_lines": F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")})
