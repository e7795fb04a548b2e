"""Layout-aware rendering of HTML to plain text."""

from __future__ import annotations

import html as _html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import arrow_map

#: Element classes of the HTML standard. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript noframes iframe audio video canvas datalist".split())
#: Not drawn within these.
HIDDEN_IN = {"svg": frozenset("desc metadata defs symbol clippath mask pattern marker".split()), "math": frozenset(["annotation", "annotation-xml"])}
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())  # set off by an empty line
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption legend summary optgroup option".split())
#: An opening tag closes these open elements, up to one of the scopes.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "col": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table", "colgroup"])),
} | dict.fromkeys(["tbody", "thead", "tfoot", "caption", "colgroup"], (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])))
#: What a table is made of; all else in it stands before it.
PARTS = frozenset("tr tbody thead tfoot td th caption colgroup col".split())
_SCOPE = frozenset("table td th caption html body".split())
#: Their end tags reach out of a table cell.
_THROUGH = frozenset("table tr td th tbody thead tfoot body html".split())
#: A quote opens a string only after "=", and only where it is closed; elsewhere it is a character like any other.
_VALUE = r"\"([^\"]*)\"|'([^']*)'|([^\s>]*+)"
_NAME = r"[^\s/>][^\s/>=]*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:\s*+=\s*+(?:{_VALUE.replace('(', '(?:')}))?+)*+)>", re.S)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*+=\s*+(?:{_VALUE}))?+")
_UNCLOSED = re.compile(r"<[!?]")
_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)
#: Inputs whose value is a button's text.
BUTTONS = frozenset(["submit", "reset", "button"])
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
#: Levels of lists and quotations that are indented; deeper ones stand as far in as these.
MAX_INDENT = 32
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    """hidden: nothing of it is drawn. unseen: its own strings are not, but those of parts that say they are visible."""

    __slots__ = ("children", "closed", "hidden", "mute", "order", "span", "tag", "unseen", "within")

    def __init__(self, tag: str, hidden: bool = False, order: int | None = None):
        self.tag, self.hidden, self.order, self.children = tag, hidden, order, []
        self.within, self.mute = "", False  # svg or math that holds it; whether its own strings are not drawn
        self.unseen = self.closed = False  # closed: details of which only the summary is drawn
        self.span = (1, 1)  # columns and rows of a cell


def _attributes(raw: str) -> dict[str, str]:
    """Names in lower case with their values; of repeated names the first counts."""
    attrs: dict[str, str] = {}
    if raw.strip(" /"):
        for m in _ATTRIBUTE.finditer(raw):
            attrs.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return attrs


def _undisplayed(style: str) -> bool:
    """Whether the declaration of display that counts, the last one or the last important one, is none."""
    said = _DISPLAY.findall(style)
    return bool(said) and max(enumerate(said), key=lambda x: (x[1][1] != "", x[0]))[1][0].lower() == "none"


def _hides(tag: str, attrs: dict[str, str]) -> bool:
    return (
        tag in HIDDEN
        or "hidden" in attrs
        or ("style" in attrs and _undisplayed(attrs["style"]))
        or (tag == "input" and attrs.get("type", "").lower() == "hidden")
        or (tag == "dialog" and "open" not in attrs)
    )


def _number(attrs: dict[str, str], name: str, most: int) -> int:
    x = attrs.get(name, "").strip()
    return max(1, min(int(x), most)) if re.fullmatch(r"\d{1,9}", x) else 1


class _Stack:
    """The open elements, and where each kind of them stands: what closes what is found without a walk."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Close the elements from place `at` on."""
        for node in self.nodes[at:]:
            self.places[node.tag].pop()
        del self.nodes[at:]

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost element of these kinds; -1 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def first_after(self, tags: Iterable[str], at: int) -> int | None:
        """The place of the outermost element of these kinds within the element at place `at`."""
        found = []
        for t in tags:
            p = self.places.get(t)
            if p and p[-1] > at:
                found.append(p[bisect_right(p, at)])
        return min(found, default=None)


def parse(html: str) -> Node:
    """A tree with implied end tags. Unclosed elements end with their parent; stray end tags are dropped."""
    root = Node("html")
    stack = _Stack(root)
    nodes = stack.nodes

    def put(s: str) -> None:
        if nodes[-1].tag == "colgroup" and s.strip():
            stack.cut(len(nodes) - 1)
        x = nodes[-1]
        if x.unseen or x.closed:
            if not x.mute and not x.closed and x.children and x.children[-1] != " ":
                x.children.append(" ")
        elif not x.mute:
            x.children.append(s)

    at = 0
    n = len(html)
    last = html.rfind(">") + 1
    while at < n:
        if at >= last:  # what is left holds no whole tag
            m = _UNCLOSED.search(html, at)
            put(html[at : m.start()] if m else html[at:])
            break
        m = _TOKEN.search(html, at)
        if m is None:
            put(html[at:])
            break
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:  # end tag
            here = stack.last((tag,))
            if tag == "p" and here < 0:
                nodes[-1].children.append(Node("p"))
            elif tag == "br":
                nodes[-1].children.append(Node("br"))
            elif here > 0 and (tag in _THROUGH or stack.last(("table", "td", "th")) <= here):
                stack.cut(here)  # no other end tag reaches out of its table cell
            continue
        if tag in ("html", "body"):
            head = stack.last(("head",))
            if head > 0:
                stack.cut(stack.places["head"][0])
            if tag == "html" or stack.places.get("body"):
                continue
        elif nodes[-1].tag == "head" and tag not in HIDDEN and tag not in ("meta", "link", "base"):
            stack.cut(len(nodes) - 1)  # the first other element ends the head
        if nodes[-1].tag == "colgroup" and tag not in ("col", "template"):
            stack.cut(len(nodes) - 1)
        if tag == "table":  # one that does not stand in a cell ends the table before it
            before = stack.last(("table",))
            if before > stack.last(("td", "th", "caption")):
                stack.cut(before)
        if tag in CLOSES_P:
            p = stack.last(("p",))
            if p > 0 and p > stack.last(_SCOPE):
                stack.cut(p)
        if tag in IMPLIED:
            closes, scope = IMPLIED[tag]
            place = stack.first_after(closes, max(0, stack.last(scope)))
            if place is not None:
                stack.cut(place)
        attrs = _attributes(m[3])
        order = None
        if tag == "ol":
            order = int(attrs["start"]) if re.fullmatch(r"-?\d{1,9}", attrs.get("start", "")) else 1
        elif tag == "li" and re.fullmatch(r"-?\d{1,9}", attrs.get("value", "")):
            order = int(attrs["value"])
        up = nodes[-1]
        node = Node(tag, _hides(tag, attrs), order)
        seen = _VISIBILITY.findall(attrs.get("style", ""))
        node.unseen = seen[-1].lower() != "visible" if seen else up.unseen
        node.closed = tag == "details" and "open" not in attrs
        if tag in ("td", "th"):
            node.span = _number(attrs, "colspan", 1000), _number(attrs, "rowspan", 65534)
        if tag == "img" and attrs.get("alt") and not node.unseen:
            node.children.append(attrs["alt"])
        elif tag == "input" and attrs.get("value") and attrs.get("type", "").lower() in BUTTONS and not node.unseen:
            node.children.append(attrs["value"])
        elif tag == "optgroup" and attrs.get("label") and not node.unseen:
            node.children.append(attrs["label"])
        node.within = tag if tag in HIDDEN_IN else "" if tag == "foreignobject" else up.within
        node.mute = tag == "svg" or (up.mute and tag not in ("text", "foreignobject", "math"))
        node.hidden = node.hidden or (up.within != "" and tag in HIDDEN_IN[up.within])
        if up.closed:  # of closed details only the first summary is drawn
            node.hidden = node.hidden or tag != "summary" or any(x.tag == "summary" for x in up.children[:1])
        if not (up.closed and node.hidden and up.children):
            if up.mute and not node.mute:  # a text of a drawing stands by itself
                up.children.append(Node("div"))
                up = up.children[-1]
            up.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(r"</" + re.escape(tag) + r"(?=[\s/>])[^>]*>?", re.I).search(html, at)
            if not node.unseen:
                node.children.append(html[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.push(node)
    return root


def _width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class _Page:
    """Collects lines. A pending break of 1 starts a new line, of 2 leaves an empty one."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = self.space = False
        self.depth, self.marker = 0, ""

    def text(self, s: str) -> None:
        s = _html.unescape(s) if "&" in s else s
        s = _SPACES.sub(" ", s)
        if not s:
            return
        if s[0] == " ":
            self.space = True
        body = s.strip(" ")
        if not body:
            return
        if not self.line:
            self._open()
        elif self.space:
            self.line.append(" ")
        self.line.append(body)
        self.space = s[-1] == " "

    def _open(self) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        indent = "  " * min(self.depth, MAX_INDENT)
        self.line = [indent, self.marker] if self.marker else [indent]
        self.marker = ""

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line))
        self.line, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or spaced

    def verbatim(self, lines: list[str]) -> None:
        self.end_line()
        for x in lines:
            self._open()
            self.line.append(x)
            self.lines.append("".join(self.line).rstrip())
            self.line = []

    def result(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def _text_of(node: Node) -> str:
    """The strings of a part as they stand, blocks on lines of their own, cells of a row two spaces apart."""
    out: list[str] = []
    todo: list = [(x, False) for x in reversed(node.children)]

    def border(mark: str) -> None:
        if out and out[-1][-1:] not in ("\n", ""):
            out.append(mark)

    while todo:
        x, leaving = todo.pop()
        if isinstance(x, str):
            out.append(_html.unescape(x))
        elif leaving or not x.hidden:
            if x.tag in ("td", "th"):
                if not leaving:
                    border("  ")
            elif x.tag in BLOCK:
                border("\n")
            elif x.tag == "br":
                out.append("\n")
            if not leaving:
                if x.tag in BLOCK:
                    todo.append((x, True))
                todo += [(c, False) for c in reversed(x.children)]
    return "".join(out)


def _parts(table: Node) -> tuple[list[list[Node]], list[Node], list[Node]]:
    """Rows of cells, captions, and what stands in the table outside of them, in blocks. Without recursion."""
    seen: list[tuple[Node, int]] = []  # elements outside of cells with the place of their parent
    holds: list[bool] = []  # whether parts of the table stand in them
    todo: list = [(x, -1) for x in table.children]
    while todo:
        x, above = todo.pop()
        if isinstance(x, str) or x.hidden or x.tag == "table":
            continue
        seen.append((x, above))
        holds.append(False)
        if x.tag in PARTS:
            k = len(seen) - 1
            while k >= 0 and not holds[k]:
                holds[k] = True
                k = seen[k][1]
        if x.tag not in ("td", "th", "caption"):
            todo += [(c, len(seen) - 1) for c in x.children]
    made_of = {id(x) for (x, _), h in zip(seen, holds) if h}
    rows: list[list[Node]] = []
    captions, stray = [], []
    row = adjoins = False
    todo = [(x, False) for x in reversed(table.children)]
    while todo:
        x, leaving = todo.pop()
        if leaving:
            row = adjoins = False
        elif isinstance(x, str) or id(x) not in made_of:
            if isinstance(x, str) and not adjoins and not x.strip():
                continue
            if not adjoins:
                stray.append(Node("div"))
            stray[-1].children.append(x)
            adjoins = True
        elif x.tag in ("td", "th"):
            adjoins = False
            if not row:
                rows.append([])
            row = True
            rows[-1].append(x)
        elif x.tag == "caption":
            adjoins = False
            captions.append(x)
        else:
            adjoins = False
            if x.tag == "tr":
                rows.append([])
                row = True
            if x.tag in PARTS:
                todo.append((x, True))
            todo += [(c, False) for c in reversed(x.children)]
    return rows, captions, stray


def _render(root: Node, page: _Page) -> Iterator:
    """Draws a part on a page. Yields what is to be drawn before it goes on; see _draw()."""
    lists: list[list] = []  # [is ordered, next number]
    todo: list = [(root, False)]
    while todo:
        x, leaving = todo.pop()
        if isinstance(x, str):
            page.text(x)
            continue
        tag = x.tag
        if leaving:
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                page.block(not lists)
                page.depth -= 1
            elif tag == "blockquote" or tag == "dd":
                page.block(tag in SPACED)
                page.depth -= 1
            else:
                page.block(tag in SPACED)
                if tag == "li":
                    page.marker = ""
            continue
        if x.hidden:
            continue
        if tag == "br":
            if page.line:
                page.end_line()
            else:
                page.gap = True
            continue
        if tag == "hr":
            page.block(True)
            continue
        if tag == "pre":
            page.block(True)
            page.verbatim(_text_of(x).strip("\n").split("\n"))
            page.block(True)
            continue
        if tag == "table":
            page.block(True)
            yield _table(x, page)
            page.block(True)
            continue
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dir")
            page.block(tag in SPACED and not (nested and lists))
            if nested:
                lists.append([tag == "ol", x.order or 1])
                page.depth += 1
            elif tag in ("blockquote", "dd"):
                page.depth += 1
            elif tag == "li":
                marker = "- "
                if lists and lists[-1][0]:
                    number = x.order if x.order is not None else lists[-1][1]
                    lists[-1][1] = number + 1
                    marker = f"{number}. "
                page.marker = "" if x.unseen else marker
            todo.append((x, True))
        elif tag == "q":
            todo += [("”", False)]
        todo += [(c, False) for c in reversed(x.children)]
        if tag == "q":
            todo.append(("“", False))


def _draw(part: Iterator) -> None:
    """Runs a part, and the parts that it yields within it, off one stack, however deep tables nest."""
    stack = [part]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _table(table: Node, page: _Page) -> Iterator:
    """What stands outside of cells first; cells padded to the width of the columns they span, columns set apart by two spaces. A cell of several rows stands in its first. A lone cell is drawn as a block."""
    rows, captions, stray = _parts(table)
    for x in stray:
        yield _render(x, page)
    if stray:
        page.block(True)
    for x in captions:
        page.verbatim([y for y in (" ".join(line.split()) for line in _text_of(x).split("\n")) if y])
    cells = [c for row in rows for c in row]
    if len(cells) == 1:
        yield _render(cells[0], page)
        return
    grid: list[list[tuple[int, int, list[str]]]] = []  # per row (column, last column, lines)
    below: list[tuple[int, int, int]] = []  # (column, columns, rows left) of cells that reach into the next row
    for row in rows:
        got, col = [], 0
        held = sorted(below)
        k = 0
        for c in row:
            while k < len(held) and held[k][0] <= col:
                col = max(col, held[k][0] + held[k][1])
                k += 1
            wide, high = c.span
            inner = _Page()
            yield _render(c, inner)
            got.append((col, col + wide - 1, inner.result().split("\n")))
            if high > 1:
                below.append((col, wide, high))
            col += wide
        below = [(a, n, left - 1) for a, n, left in below if left > 1]
        grid.append(got)
    # columns in which no cell begins take no place
    used = sorted({a for r in grid for a, _, _ in r})
    at = {a: i for i, a in enumerate(used)}
    width = [0] * len(used)
    spanning = []
    for r in grid:
        for a, b, lines in r:
            i, j = at[a], bisect_right(used, b) - 1
            need = max(map(_width, lines))
            if i == j:
                width[i] = max(width[i], need)
            else:
                spanning.append((i, j, need))
    for i, j, need in spanning:
        width[j] += max(0, need - sum(width[i : j + 1]) - 2 * (j - i))
    for r in grid:
        if not any(y for _, _, lines in r for y in lines):
            continue
        out = []
        for k in range(max(len(lines) for _, _, lines in r)):
            line, i = [], 0
            for a, b, lines in r:
                while i < at[a]:
                    line.append(" " * width[i])
                    i += 1
                j = bisect_right(used, b) - 1
                s = lines[k] if k < len(lines) else ""
                line.append(s + " " * (sum(width[i : j + 1]) + 2 * (j - i) - _width(s)))
                i = j + 1
            out.append("  ".join(line))
        page.verbatim(out)


def render(html: str) -> str:
    """All visible text of a page: blocks on lines of their own, paragraphs set apart, lists marked, table cells aligned."""
    page = _Page()
    _draw(_render(parse(html.replace("\x00", "�")), page))
    return page.result()


def extract_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The rendered text of every whole page.

    One row per input row: the id column, text, n_chars (code points) and n_lines. A null page gives a null text with
    zero counts, an empty one an empty text. Null ids and repeated rows stay as they are; other columns are ignored.
    Map-only.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if (h := x.as_py()) is None else render(h) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text, pa.string()), pa.array([len(t or "") for t in text], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in text], pa.int64())],
                names=[id_col, "text", "n_chars", "n_lines"],
            )

    return arrow_map(pages.select(id_col, html_col), run, f"`{id_col}` {kind}, text string, n_chars long, n_lines long")
