"""Visible text of web pages with their layout.

`events` builds the tree as a stream: it keeps the stack of open elements, closes
those that HTML leaves to be implied (p before a block, li before li, cells,
rows, options, terms) and yields open, text and close in tree order.  `render`
walks those events: invisible subtrees are passed over, white space collapses
outside pre, blocks start lines and paragraphs keep a blank line, lists get
bullets or numbers and indent, and the cells of a table stand in a grid, in which spans over rows and
columns keep their places, padded to the width of their column as a terminal shows it.  Labels of buttons,
fields of text, all options of a select (a line each), formulas
and the text that SVG draws are visible; what `visibility` hides comes back where a child makes it
visible again.  Nothing recurses, so depth costs no stack, and output grows with the page: a span
is as wide as the columns that some single cell defines.

One page is one row; pages are independent, so this is a narrow Arrow map.

Cases: NULL and empty pages give empty text; unclosed tags, comments and quotes
are read to the end as a browser would; an end tag without start is ignored, but </p> makes an empty
paragraph; rows that repeat give equal rows; pages of any length are read whole; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mendframe.llm.common import batches_of

# Fixed values of HTML: elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset(
    "head script style template noscript title iframe noembed noframes object audio video canvas datalist rp area base col embed input link meta param source track".split()
)
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre hr figure fieldset form".split())
BLOCK = PARAGRAPH | frozenset(
    "html body address article aside caption center dd details dialog dir div dt fieldset figcaption footer header hgroup legend li main menu nav section summary tr".split()
)
CELL = frozenset(("td", "th"))
ROWS = frozenset(("thead", "tbody", "tfoot"))

# SVG and MathML: what is never drawn, where HTML goes on inside, which tags end them.
UNDRAWN = frozenset("annotation annotation-xml clippath defs desc marker mask metadata pattern symbol".split())
HTML_INSIDE = frozenset("annotation-xml desc foreignobject mi mn mo ms mtext title".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split()
)
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())

# What a start tag closes, and what keeps it from looking further up.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
    "button": ({"button"}, {"table", "td", "th", "caption", "object", "template"}),
}
# Elements that an inner tag of the same kind does not close from outside.
WALL = frozenset(("table", "td", "th", "caption", "object", "template"))
P_WALL = WALL | {"button"}  # for p alone

TAG = re.compile(
    r"<(?:!--(?:>|->|.*?(?:-->|--!>|\Z))"
    r"|[!?][^>]*+(?:>|\Z)"
    r"|/([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
LABELLED = frozenset("submit reset button".split())  # inputs that show their value as a label
SPACE = re.compile(r"[ \t\n\r\f]+")
UNQUOTED_END = re.compile(r"=\s*[^\s\"'>]*/\Z")  # a slash that belongs to a value


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


Event = tuple[str, str, dict]


def events(page: str) -> Iterator[Event]:
    """("open", tag, attributes), ("text", text, {}) and ("close", tag, {}) in tree order, always balanced."""
    stack: list[str] = []
    foreign: list[bool] = []  # for each in the stack: are its children SVG or MathML
    opened: Counter[str] = Counter()  # how often each tag is in the stack: most searches need not begin
    at, n = 0, len(page)

    def close_to(k: int) -> Iterator[Event]:
        while len(stack) > k:
            tag = stack.pop()
            foreign.pop()
            opened[tag] -= 1
            yield "close", tag, {}

    def out_of_head() -> Iterator[Event]:
        while stack and stack[-1] == "head":
            yield from close_to(len(stack) - 1)

    def closing(tags: set[str], walls) -> int:
        """Where the outermost of `tags` stands above the last wall; the height of the stack if there is none."""
        found = len(stack)
        if not any(map(opened.__getitem__, tags)):
            return found
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] in tags:
                found = k
            elif stack[k] in walls:
                break
        return found

    while at < n:
        m = TAG.search(page, at)
        stop = m.start() if m else n
        if stack and stack[-1] == "head" and page[at:stop].strip(" \t\n\r\f"):
            yield from out_of_head()
        if not m:
            yield "text", unescape(page[at:]), {}
            break
        if m.start() > at:
            yield "text", unescape(page[at : m.start()]), {}
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                yield "open", "br", {}
                yield "close", "br", {}
                continue
            walls = () if tag == "table" else {"table"} if tag in CELL or tag in ROWS or tag in ("tr", "caption") else P_WALL if tag == "p" else WALL - {tag}
            met = False
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k] == tag:
                    yield from close_to(k)
                    met = True
                    break
                if stack[k] in walls:
                    break
            if tag == "p" and not met:
                yield "open", "p", {}
                yield "close", "p", {}
        elif m[2]:
            tag, rest = m[2].lower(), m[3]
            if tag not in IN_HEAD:
                yield from out_of_head()
            while tag in BREAKOUT and foreign and foreign[-1]:
                yield from close_to(len(stack) - 1)
            drawn = tag in ("svg", "math") or bool(foreign and foreign[-1])
            if tag in CLOSES:
                yield from close_to(closing(*CLOSES[tag]))
            if tag in BLOCK and opened["p"]:
                yield from close_to(closing({"p"}, P_WALL))
            if tag in ("tr", "td", "th"):  # what a table needs above a cell
                inside = closing({"table"}, ())
                if inside < len(stack) and tag in CELL and "tr" not in stack[inside:]:
                    stack.append("tr")
                    foreign.append(False)
                    opened["tr"] += 1
                    yield "open", "tr", {}
            yield "open", tag, attributes(rest) if rest and not rest.isspace() else {}
            if tag in VOID or (drawn and rest.endswith("/") and not UNQUOTED_END.search(rest)):
                yield "close", tag, {}
                continue
            stack.append(tag)
            foreign.append(drawn and tag not in HTML_INSIDE)
            opened[tag] += 1
            if tag in RAW and not drawn:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                stop = end.start() if end else n
                if stop > at:
                    raw = page[at:stop]
                    if tag == "textarea":  # as a browser does with the first line end
                        raw = re.sub(r"\A\r?\n", "", raw)
                    yield "text", unescape(raw) if tag in ("title", "textarea") else raw, {}
                at = stop
    yield from close_to(0)


@dataclass
class Flow:
    """Lines under construction: of the page, or of one cell or caption."""

    lines: list[str] = field(default_factory=list)
    line: list[str] = field(default_factory=list)
    gap: bool = False  # a blank line is due before the next text
    space: bool = False  # a space is due before the next word
    prefix: list[list[str]] = field(default_factory=list)  # of each open list item or quote: on its next line, and after it

    def _lead(self) -> str:
        lead = "".join(now for now, _ in self.prefix)
        for one in self.prefix:
            one[0] = one[1]
        return lead

    def words(self, text: str) -> None:
        parts = SPACE.split(text)
        for i, part in enumerate(parts):
            if i:
                self.space = True
            if part:
                if not self.line:
                    self._begin()
                elif self.space:
                    self.line.append(" ")
                self.line.append(part)
                self.space = False

    def _begin(self) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.line = [self._lead()]

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
        self.space = False

    def br(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines and self.lines[-1]:
            self.lines.append("")

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or spaced

    def verbatim(self, text: str) -> None:
        for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                if not self.line:
                    self._begin()
                self.end_line()
            if part:
                if not self.line:
                    self._begin()
                self.line.append(part)

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return [x.rstrip() for x in self.lines]


def display_width(text: str) -> int:
    """Columns that a text takes: wide characters two, marks on others none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(x) else 2 if unicodedata.east_asian_width(x) in "WF" else 1 for x in text)


@dataclass
class Table:
    rows: list[list[tuple[list[str], int, int]]] = field(default_factory=list)  # lines, columns and rows of each cell
    caption: list[str] = field(default_factory=list)

    def grid(self) -> list[list[tuple[int, list[str], int]]]:
        """(first column, lines, columns) of the cells of each row; cells from above that span rows keep their columns, empty."""
        out, taken = [], []  # taken: (first column, columns, rows still to come)
        for row in self.rows:
            placed = [(at, [], span) for at, span, _ in taken]
            still = [(at, span, left - 1) for at, span, left in taken if left > 1]
            at = k = 0
            for lines, span, down in row:
                while k < len(taken) and taken[k][0] < at + span:
                    at, k = max(at, taken[k][0] + taken[k][1]), k + 1
                placed.append((at, lines, span))
                if down > 1:
                    still.append((at, span, down - 1))
                at += span
            taken = sorted(still)
            out.append(sorted(placed, key=lambda x: x[0]))
        return out

    def layout(self) -> list[str]:
        """Cells side by side, each column as wide as its widest single cell; long cells take several lines."""
        rows = [r for r in self.grid() if any(lines for _, lines, _ in r)]
        widths: dict[int, int] = {}
        for row in rows:
            for at, lines, span in row:
                if span == 1:
                    widths[at] = max(widths.get(at, 0), *map(display_width, lines), 0)
        # columns that no single cell defines have no width and no border
        columns = sorted(widths)
        upto = list(accumulate((widths[x] + 3 for x in columns), initial=0))
        out = list(self.caption)
        for row in rows:
            ends = [(bisect_left(columns, at), bisect_left(columns, at + span)) for at, _, span in row]
            for k in range(max(len(lines) for _, lines, _ in row)):
                cells = []
                for (_, lines, _), (first, last) in zip(row, ends, strict=True):
                    text = lines[k] if k < len(lines) else ""
                    cells.append(text + " " * (upto[last] - upto[first] - 3 - display_width(text)))
                out.append(" | ".join(cells).rstrip())
        return out


def _span(value: str | None, most: int = 1000, zero: int = 1) -> int:
    if not value or not value.isdecimal() or len(value) > 9:
        return 1
    return min(int(value), most) or zero


def _number(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"-?\d{1,9}", value) else None


def items_of(found: list[Event]) -> dict[int, int]:
    """How many items each list has that counts down, by the place of its start among the events."""
    out: dict[int, int] = {}
    above: list[int] = []  # the lists, or -1 for other elements, that are open
    for i, (kind, tag, attrs) in enumerate(found):
        if kind == "open":
            if tag == "li" and (owner := next((x for x in reversed(above) if x >= 0), -1)) in out:
                out[owner] += 1
            if tag == "ol" and "reversed" in attrs:
                out[i] = 0
            above.append(i if tag in ("ol", "ul", "menu", "dir") else -1)
        elif kind == "close":
            above.pop()
    return out


def render(page: str | None) -> str:
    """All visible text of a page."""
    flows, tables = [Flow()], []
    lists: list[int | None] = []
    steps: list[int] = []  # by which each list counts
    spans: list[tuple[int, int]] = []
    seen = [True]  # of each element that is displayed: is its text visible
    hidden = pre = 0
    closed_details: list[int] = []
    drawing: list[bool] = []  # of each open svg, and of what draws text in it: is text drawn
    foreign = depth = 0
    found: Iterator[Event] | list[Event] = events(page or "")
    backwards: dict[int, int] = {}
    if page and "reversed" in page.lower():
        found = list(found)
        backwards = items_of(found)
    for place, (kind, value, attrs) in enumerate(found):
        if kind == "text":
            if hidden or not seen[-1] or (drawing and not drawing[-1]) or (closed_details and closed_details[-1] >= 0 and depth >= closed_details[-1]):
                continue
            if pre:
                flows[-1].verbatim(value)
            elif not (tables and value.isspace()):
                flows[-1].words(value)
            else:
                flows[-1].space = True
            continue
        flow, tag = flows[-1], value
        if kind == "open":
            depth += 1
            style = attrs.get("style", "")
            gone = tag in HIDDEN or (foreign and tag in UNDRAWN) or "hidden" in attrs or (tag == "dialog" and "open" not in attrs)
            visibility = VISIBILITY.findall(style)
            if tag == "input" and not hidden and attrs.get("type", "").lower() in LABELLED and not NO_DISPLAY.search(style) and "hidden" not in attrs:
                if visibility[-1].lower() == "visible" if visibility else seen[-1]:
                    flow.words(" " + attrs.get("value", "") + " ")
            if hidden or gone or NO_DISPLAY.search(style):
                hidden += 1
                continue
            seen.append(visibility[-1].lower() == "visible" if visibility else seen[-1])
            if tag in ("svg", "math"):
                foreign += 1
            if tag == "svg" or (drawing and tag in ("text", "foreignobject")):
                drawing.append(tag != "svg")
                flow.space = True
            elif tag == "button":
                flow.space = True
            elif tag in ("option", "optgroup", "textarea"):
                flow.block(False)
                pre += tag == "textarea"
                if tag != "textarea" and attrs.get("label") and seen[-1]:
                    flow.words(attrs["label"])
                    if tag == "option":  # stands for its text
                        hidden += 1
            elif tag == "br":
                flow.br()
            elif tag == "hr":
                flow.block(True)
            elif tag == "img" and attrs.get("alt") and seen[-1]:
                flow.words(" " + attrs["alt"] + " ")
            elif tag == "table":
                flow.block(True)
                tables.append(Table())
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif (tag in CELL or tag == "caption") and tables:
                if tag in CELL and not tables[-1].rows:
                    tables[-1].rows.append([])
                spans.append((_span(attrs.get("colspan")), _span(attrs.get("rowspan"), 65534, 65534)))
                flows.append(Flow())
            elif tag in BLOCK:
                flow.block(tag in PARAGRAPH and not (tag in ("ul", "ol") and lists))
                if tag in ("ul", "menu", "dir"):
                    lists.append(None)
                    steps.append(1)
                elif tag == "ol":
                    start = _number(attrs.get("start"))
                    lists.append(backwards.get(place, 1) if start is None else start)
                    steps.append(-1 if "reversed" in attrs else 1)
                elif tag == "li":
                    mark = "- "
                    if lists and lists[-1] is not None:
                        given = _number(attrs.get("value"))
                        lists[-1] = lists[-1] if given is None else given
                        mark = f"{lists[-1]}. "
                        lists[-1] += steps[-1]
                    flow.prefix.append([mark, " " * len(mark)])
                elif tag == "dd":
                    flow.prefix.append(["  ", "  "])
                elif tag == "blockquote":
                    flow.prefix.append(["> ", "> "])
                elif tag == "pre":
                    pre += 1
                elif tag == "details":
                    closed_details.append(-1 if "open" in attrs else depth)
                elif tag == "summary" and closed_details and closed_details[-1] >= 0:
                    closed_details.append(-1)
            continue
        depth -= 1
        if hidden:
            hidden -= 1
            continue
        seen.pop()
        if tag in ("svg", "math"):
            foreign -= 1
        if tag == "svg" or (drawing and tag in ("text", "foreignobject")):
            drawing.pop()
            flow.space = True
        elif tag == "button":
            flow.space = True
        elif tag in ("select", "textarea"):
            flow.block(False)
            pre -= tag == "textarea"
        elif tag == "table" and tables:
            lines = tables.pop().layout()
            flow = flows[-1]
            for line in lines:
                flow._begin()
                flow.line.append(line)
                flow.end_line()
            flow.block(True)
        elif (tag in CELL or tag == "caption") and tables and len(flows) > 1:
            lines, span = flows.pop().done(), spans.pop()
            if tag == "caption":
                tables[-1].caption += lines
            else:
                tables[-1].rows[-1].append((lines, *span))
        elif tag in BLOCK and not (tag == "tr" and tables):
            flow.block(tag in PARAGRAPH and not (tag in ("ul", "ol") and len(lists) > 1))
            if tag in ("ul", "ol", "menu", "dir"):
                if lists:
                    lists.pop()
                    steps.pop()
            elif tag in ("li", "dd", "blockquote"):
                flow.prefix and flow.prefix.pop()
            elif tag == "pre":
                pre -= 1
            elif tag in ("details", "summary") and closed_details and (tag == "details" or (closed_details[-1] == -1 and len(closed_details) > 1)):
                closed_details.pop()
    return "\n".join(flows[0].done()).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_lines, n_chars) for every row of `pages`."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches):
        import pyarrow as pa

        for found in batches_of(batches, 64):
            texts = [render(x) for x in found["html"]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found["page_id"], id_type),
                    pa.array(texts, pa.string()),
                    pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64()),
                    pa.array(list(map(len, texts)), pa.int64()),
                ],
                names=["page_id", "text", "n_lines", "n_chars"],
            )

    return rows.mapInArrow(run, f"page_id {kind.simpleString()}, text string, n_lines long, n_chars long")
