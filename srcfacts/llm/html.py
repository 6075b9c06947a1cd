"""Layout-aware text of web pages.

A tree builder with implied tags (p, li, dt/dd, option, table parts, head and body) and void elements reads the page;
visibility rules leave out what a browser doesn't paint; a renderer keeps what a reader sees: paragraphs and headings apart
by an empty line, other blocks by a line break, list items with marks and depth, preformatted text as it is, table cells
padded to the columns of the grid that colspan and rowspan make.

Not painted: head, scripts, styles, templates, fallback contents, comments; elements with ``hidden`` or display:none; text
under visibility:hidden unless an element inside turns visible again; closed dialogs, and all but the summary of closed
details. Style sheets aren't read. A tag that the end of the page cuts off is dropped with what it holds.

All visible text is kept, boilerplate included. Null and empty pages give an empty text; broken markup never fails;
extra columns are ignored and repeated rows keep a row each. Every step is linear in the page, at any depth of nesting: no
recursion, no walk over the open elements. Padding is bounded: past ``MOST_INDENT`` columns lists aren't indented further, and a
table whose padding would outgrow its text ``MOST_PADDING`` times has its cells side by side, but not under each other.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Generator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from srcfacts.llm.base import text_pass

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNPAINTED = frozenset("head script style template noscript title meta link base iframe object embed canvas audio video datalist noembed noframes rp desc metadata defs symbol annotation annotation-xml".split())
#: Two line breaks around these, one around the other blocks.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table article section figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body div header footer nav aside main address li dt dd form figcaption details summary legend center tr caption thead tbody tfoot option optgroup select".split())
#: Boxes in a line: their text stands apart from what is beside them.
CONTROLS = frozenset("button textarea".split())
CLOSES_P = BLOCK - frozenset("html body tr caption thead tbody tfoot option optgroup select".split())
#: A start tag ends these open elements, unless one of the second set stands between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "body": (("head",), ()),
}
IN_HEAD = frozenset("base link meta noframes noscript script style template title head".split())
P_STOPS = ("td", "th", "table", "li", "button", "html")
#: An end tag doesn't look past these, but for those of the second set.
SCOPE = ("table", "td", "th", "html")
FAR_ENDS = frozenset("table body html tr tbody thead tfoot".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)"""
REST = re.compile(rf"(?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:{_VALUE})?+)*+>")
ATTRIBUTE = re.compile(r"""(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]++)))?+""")
BLANKS = re.compile(r"[ \t\n\r\f]+")
STYLE_COMMENT = re.compile(r"/\*.*?\*/", re.S)
#: Columns that marks and indentation take at most.
MOST_INDENT = 80
#: Blanks a table may be padded with: this many for each character of its text, and some for small tables.
MOST_PADDING, FREE_PADDING = 64, 4000

_raw_ends = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def _tokens(page: str) -> Generator[tuple[str, str, str], None, None]:
    """(kind, name or text, attributes): kinds text, start, end. Each character is scanned a bounded number of times: a
    quote without its partner is looked for once, as no later one has a partner either."""
    at, n = 0, len(page)
    while at < n:
        low = page.find("<", at)
        if low < 0:
            yield "text", page[at:], ""
            return
        if low > at:
            yield "text", page[at:low], ""
        slash = page.startswith("/", low + 1)
        m = NAME.match(page, low + 1 + slash)
        if m is None:
            if page.startswith("!--", low + 1):
                end = low + 4 if page.startswith(">", low + 4) else page.find("-->", low + 4)
                at = n if end < 0 else end + (3 if page.startswith("-->", end) else 1)
            elif page.startswith("![CDATA[", low + 1):
                end = page.find("]]>", low)
                yield "cdata", page[low + 9 : n if end < 0 else end], ""
                at = n if end < 0 else end + 3
            elif slash or page.startswith(("!", "?"), low + 1):
                end = page.find(">", low)
                at = n if end < 0 else end + 1
            else:  # a bare "<" is text
                yield "text", "<", ""
                at = low + 1
            continue
        rest = REST.match(page, m.end())
        if rest is None:
            return
        name, at = m[0].lower(), rest.end()
        yield ("end" if slash else "start"), name, page[m.end() : at - 1]
        if not slash and name in RAW:
            close = _raw_ends[name].search(page, at)
            end = close.start() if close else n
            if end > at:
                yield "raw", page[at:end], ""
            yield "end", name, ""
            at = page.find(">", end) + 1 if close else n
            if not at:
                return


def attributes(rest: str) -> dict[str, str]:
    """By lower-case name; of a repeated one the first counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(rest):
        found.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
    return found


def declarations(style: str) -> dict[str, str]:
    """Property -> value, the last one, but important ones before others."""
    found: dict[str, tuple[bool, str]] = {}
    for part in STYLE_COMMENT.sub("", unescape(style)).lower().split(";"):
        name, colon, value = part.partition(":")
        value, bang, mark = value.partition("!")
        strong = bool(bang) and mark.strip() == "important"
        name = name.strip()
        if colon and (strong or not bang) and not (found.get(name, (False, ""))[0] and not strong):
            found[name] = strong, value.strip()
    return {k: v for k, (_, v) in found.items()}


def _number(text: str | None, least: int, most: int, otherwise: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text or "")
    return min(max(int(m[1]), least), most) if m else otherwise


class Node:
    __slots__ = ("name", "gone", "seen", "start", "step", "spans", "parts")

    def __init__(self, name: str):
        self.name = name
        self.gone = name in UNPAINTED
        self.seen: bool | None = None  # visibility, where the element has one of its own
        self.start: int | None = None  # number of an ordered list or item
        self.step = 1  # from one number of an ordered list to the next
        self.spans = (1, 1)  # columns and rows of a cell; 0 rows: to the end of the row group
        self.parts: list = []  # text or Node


#: Elements whose attributes matter beside hidden and style.
READ = frozenset("dialog details input ol li td th".split())


def _read(node: Node, rest: str) -> None:
    name = node.name
    low = rest.lower()
    if name not in READ and "hidden" not in low and "style" not in low:
        return
    found = attributes(rest)
    style = declarations(found["style"]) if "style" in found else {}
    if name == "dialog" and "open" not in found or name == "input" or "hidden" in found:
        node.gone = True
    if "display" in style and name not in UNPAINTED:
        node.gone = style["display"] == "none"
    if style.get("visibility") in ("hidden", "visible", "collapse"):
        node.seen = style["visibility"] == "visible"
    if name == "details":
        node.start = 1 if "open" in found else 0
    elif name == "ol":
        node.step = -1 if "reversed" in found else 1
        # a reversed list without a start ends at 1; its items are counted when it is laid out
        node.start = None if "reversed" in found and "start" not in found else _number(found.get("start"), -(10**9), 10**9, 1)
    elif name == "li" and "value" in found:
        node.start = _number(found["value"], -(10**9), 10**9, 1)
    elif name in ("td", "th"):
        node.spans = _number(found.get("colspan"), 1, 1000, 1), _number(found.get("rowspan"), 0, 65534, 1)


def tree(page: str) -> Node:
    root = Node("html")
    stack = [root]
    places: dict[str, list[int]] = {"html": [0]}  # where the open elements of a name stand in the stack

    def cut_to(size: int) -> None:
        while len(stack) > size:
            places[stack.pop().name].pop()

    def last(names: tuple[str, ...]) -> int:
        return max((p[-1] for x in names if (p := places.get(x))), default=-1)

    def close(names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        at = last(names)
        if at > 0 and at > last(stops):
            cut_to(at)

    for kind, name, rest in _tokens(page):
        if kind in ("text", "raw"):
            if stack[-1].name == "head" and not name.isspace():
                cut_to(len(stack) - 1)
            stack[-1].parts.append(name)
        elif kind == "cdata":
            if places.get("svg") or places.get("math"):
                stack[-1].parts.append(name.replace("&", "&amp;"))
        elif kind == "end":
            if name == "br":
                stack[-1].parts.append(Node("br"))
            elif name == "p" and not places.get("p"):
                stack[-1].parts.append(Node("p"))
            elif name not in VOID:
                close((name,), () if name in FAR_ENDS else tuple(x for x in SCOPE if x != name))
        else:
            if name in ("html", "body") and places.get(name):
                continue
            if stack[-1].name == "head" and name not in IN_HEAD:
                cut_to(len(stack) - 1)
            if name in CLOSES_P:
                close(("p",), P_STOPS)
            if name in IMPLIED:
                close(*IMPLIED[name])
            node = Node(name)
            if rest or name in READ:
                _read(node, rest)
            stack[-1].parts.append(node)
            own_end = rest.endswith("/") and (name in ("svg", "math") or bool(places.get("svg") or places.get("math")))
            if name not in VOID and not own_end:
                places.setdefault(name, []).append(len(stack))
                stack.append(node)
    return root


def width(text: str) -> int:
    """Columns on a screen: wide characters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Lines of text; blanks collapse, and breaks wait until text follows.

    Boxes (list items and the like) indent what they hold; their mark stands in front of their first line. In a box
    without text yet no empty line begins. A block made elsewhere is kept as (mark, indentation, Lines) and copied only once,
    by ``flat``.
    """

    def __init__(self, nested: bool, taken: int):
        self.lines: list[str | tuple[str, str, Lines]] = []
        self.count = self.width = self.text = self.size = 0  # lines, widest, characters without and with padding
        self.line: list[str] = []
        self.blank = False  # a blank is due before the next word
        self.gap = 0  # line breaks due before the next text
        self.nested = nested
        self.taken = taken  # columns of indentation around it
        self.indent, self.lead = "", ""
        self.boxes: list[tuple[int, int, str, str]] = []

    def _empty(self) -> bool:
        return len(self.lines) == (self.boxes[-1][0] if self.boxes else 0)

    def add(self, line: str, wide: int, text: int) -> None:
        """A line and how wide it is; an empty one has neither mark nor indentation."""
        self.lines.append(self.lead + line if line else "")
        self.count += 1
        self.width, self.text, self.size = max(self.width, len(self.lead) + wide), self.text + text, self.size + len(self.lead) + text
        self.lead = self.indent

    def words(self, text: str) -> None:
        text = BLANKS.sub(" ", text)
        if text == " " or not text:
            self.blank = self.blank or bool(text) and bool(self.line)
            return
        if text[0] == " ":
            self.blank = bool(self.line)
        if self.blank and self.line:
            self.line.append(" ")
        self.line.append(text.strip(" "))
        self.blank = text[-1] == " "

    def _flush_gap(self) -> None:
        if self.gap > 1 and self.lines:
            self.lines += [""] * (self.gap - 1)
            self.count += self.gap - 1
        self.gap = 0

    def end_line(self, gap: int) -> None:
        """Ends the line if it has text; ``gap`` line breaks at least come before the next text."""
        if self.line:
            self._flush_gap()
            line = "".join(self.line)
            self.add(line, width(line), len(line))
            self.line = []
        self.blank = False
        if not (self.boxes and self._empty()):
            self.gap = max(self.gap, gap)

    def forced(self) -> None:
        """A <br>."""
        if self.line:
            self.end_line(0)
        elif not self._empty():
            self._flush_gap()
            self.lines.append("")
            self.count += 1
        self.blank, self.gap = False, 0

    def block(self, made: Lines, gap: int) -> None:
        """Lines made elsewhere, the first and last of them with text."""
        if made.lines:
            self.end_line(gap)
            self._flush_gap()
            self.lines.append((self.lead, self.indent, made))
            self.count += made.count
            self.width = max(self.width, len(self.lead) + made.width)
            self.text, self.size = self.text + made.text, self.size + made.size + len(self.lead) + len(self.indent) * made.count
            self.lead = self.indent
            self.gap = gap

    def open_box(self, mark: str) -> None:
        self.end_line(1)
        self.boxes.append((len(self.lines), self.gap, self.indent, self.lead))
        self.lead = (self.lead if len(self.lead) < MOST_INDENT else self.indent) + mark
        if self.taken + len(self.indent) < MOST_INDENT:
            self.indent += " " * len(mark)

    def _strip(self, start: int) -> None:
        while len(self.lines) > start and not self.lines[-1]:
            self.lines.pop()
            self.count -= 1

    def close_box(self) -> None:
        self.end_line(0)
        start, gap, indent, lead = self.boxes.pop()
        self._strip(start)
        if len(self.lines) > start:
            self.indent = self.lead = indent
            self.gap = 1
        else:
            self.indent, self.lead, self.gap = indent, lead, gap

    def done(self) -> Lines:
        self.end_line(0)
        self._strip(0)
        return self

    def flat(self) -> list[str]:
        out: list[str] = []
        # [rest of the lines, what stands before the next one, what before the others]
        stack = [[iter(self.lines), "", ""]]
        while stack:
            top = stack[-1]
            x = next(top[0], None)
            if x is None:
                stack.pop()
                continue
            first, rest = top[1], top[2]
            top[1] = rest
            if isinstance(x, str):
                out.append(first + x if x else "")
            else:
                stack.append([iter(x[2].lines), first + x[0], rest + x[1]])
        return out


def _placed(rows: list[list[tuple[Lines, int, int]]]) -> list[list[tuple[int, int, Lines]]] | None:
    """(column, columns, cell) of each row of a row group, around the cells that reach down from above; None where those
    make a grid far larger than the cells."""
    placed, active, work, most = [], [], 0, MOST_PADDING * sum(map(len, rows)) + FREE_PADDING
    for row in rows:
        out, reach, k, column = [], [], 0, 0
        for cell, across, down in row:
            while k < len(active) and active[k][0] <= column:
                column, k = max(column, active[k][1]), k + 1
            out.append((column, across, cell))
            if down != 1:
                reach.append((column, column + across, down - 1 if down else len(rows)))
            column += across
        work += len(active) + len(row)
        if work > most:
            return None
        active = sorted([(a, b, left - 1) for a, b, left in active if left > 1] + reach)
        placed.append(out)
    return placed


def _side_by_side(groups: list[list[list[tuple[Lines, int, int]]]], taken: int) -> Lines:
    """The rows of a table, each column as wide as its widest cell."""
    made = Lines(True, taken)
    placed: list[list[tuple[int, int, Lines]]] = []
    aligned = True
    for rows in groups:
        found = _placed(rows)
        aligned = aligned and found is not None
        placed += found if found is not None else [[(i, 1, cell) for i, (cell, _, _) in enumerate(row)] for row in rows]
    columns = sorted({column for row in placed for column, _, _ in row})
    if len(columns) < 2:
        for row in placed:
            for _, _, cell in row:
                made.block(cell, 1)
        return made
    place = {c: i for i, c in enumerate(columns)}
    widths = [0] * len(columns)
    spanning = []
    for row in placed:
        for column, across, cell in row:
            i = place[column]
            last = i if across == 1 else bisect_left(columns, column + across) - 1
            if last == i:
                widths[i] = max(widths[i], cell.width)
            else:
                spanning.append((last - i, i, last, cell.width))
    for _, i, last, wide in sorted(spanning):
        # a spanned column is widened only if something stands behind it
        if last + 1 < len(columns):
            widths[last] += max(0, wide - sum(widths[i : last + 1]) - 2 * (last - i))
    offsets = [0]
    for w in widths:
        offsets.append(offsets[-1] + w + 2)
    made.text = sum(cell.text for row in placed for _, _, cell in row)
    padding = sum(max((cell.count for _, _, cell in row), default=0) * (offsets[place[row[-1][0]]] if row else 0) for row in placed)
    made.size = padding + sum(cell.size for row in placed for _, _, cell in row)
    aligned = aligned and made.size <= MOST_PADDING * made.text + FREE_PADDING
    for row in placed:
        if aligned:
            cells = [(offsets[place[column]], cell.flat()) for column, _, cell in row]
            made.width = max([made.width, *(offsets[place[column]] + cell.width for column, _, cell in row)])
            for k in range(max((len(lines) for _, lines in cells), default=0)):
                parts: list[str] = []
                at = 0  # where the part before the last one ends
                for offset, lines in cells:
                    if k < len(lines) and lines[k]:
                        at += width(parts[-1]) if parts else 0
                        parts += [" " * max(offset - at, 2 if parts else 0), lines[k]]
                        at += len(parts[-2])
                made.lines.append("".join(parts))
                made.count += 1
        else:
            line: list[Lines] = []
            for cell in [*(cell for _, _, cell in row), None]:
                if line and (cell is None or cell.count > 1):
                    made.add("  ".join(x.flat()[0] for x in line), sum(x.width for x in line) + 2 * len(line), 0)
                    line = []
                if cell is not None and cell.count > 1:
                    made.lines.append(("", "", cell))
                    made.count, made.width = made.count + cell.count, max(made.width, cell.width)
                elif cell is not None and cell.count:
                    line.append(cell)
    return made


def _table(node: Node, visible: bool, taken: int) -> Generator:
    """(what stands above the rows, rows): head groups come first, foot groups last."""
    heads, bodies, feet = [], [], []
    loose: list = []
    above: list[Lines] = []
    now: list | None = None  # the rows of the group at hand
    for x in node.parts:
        if isinstance(x, str):
            if x.strip():
                loose.append(x)
        elif x.gone:
            continue
        elif x.name in ("thead", "tbody", "tfoot"):
            rows: list = []
            seen = visible if x.seen is None else x.seen
            for y in x.parts:
                if isinstance(y, str) or y.name not in ("tr", "td", "th"):
                    loose += [y] if not isinstance(y, str) or y.strip() else []
                elif not y.gone:
                    rows.append((yield from _row(y, seen, taken, loose)))
            {"thead": heads, "tfoot": feet}.get(x.name, bodies).append(rows)
            now = None
        elif x.name in ("tr", "td", "th"):
            if now is None:
                now = []
                bodies.append(now)
            now.append((yield from _row(x, visible, taken, loose)))
        elif x.name == "caption":
            above.append((yield _flow(x, visible if x.seen is None else x.seen, True, taken)))
        elif x.name != "colgroup":
            loose.append(x)
    if loose:  # text that stands in the table but in no cell comes before it
        outside = Node("div")
        outside.parts = loose
        above.insert(0, (yield _flow(outside, visible, True, taken)))
    top = Lines(True, taken)
    for made in above:
        top.block(made, 1)
    return top, _side_by_side(heads + bodies + feet, taken)


def _row(row: Node, visible: bool, taken: int, loose: list) -> Generator:
    """(lines, columns, rows) of each cell; a cell without a row is a row."""
    cells = []
    seen = visible if row.seen is None else row.seen
    for x in [row] if row.name != "tr" else row.parts:
        if isinstance(x, str):
            if x.strip():
                loose.append(x)
        elif x.name not in ("td", "th"):
            loose.append(x)
        elif not x.gone:
            cells.append(((yield _flow(x, seen if x.seen is None else x.seen, True, taken)), *x.spans))
    return cells


def _flow(node: Node, visible: bool, nested: bool = False, taken: int = 0) -> Generator:
    """The lines of a node. Tables yield their cells to ``render``, which runs them in turn: nothing recurses."""
    out = Lines(nested, taken)
    # [parts, index of the next one, node, number of its next list item, visible, in a box]
    stack: list[list] = [[node.parts, 0, node, _first_number(node), visible, False]]
    while stack:
        top = stack[-1]
        parts, i, x, _, seen, boxed = top
        if i == len(parts):
            stack.pop()
            if boxed:
                out.close_box()
            elif x.name in CONTROLS:
                out.blank = True
            elif x.name in BLOCK and stack:
                out.end_line(2 if x.name in SPACED else 1)
            continue
        top[1] += 1
        part = parts[i]
        if isinstance(part, str):
            if seen:
                out.words(unescape(part) if "&" in part else part)
            continue
        name = part.name
        if part.gone:
            continue
        here = seen if part.seen is None else part.seen
        if name == "br":
            if seen:
                out.forced()
        elif name == "hr":
            out.end_line(2)
        elif name in VOID:
            continue
        elif name == "pre":
            text = unescape(_plain(part, here)).replace("\r\n", "\n").expandtabs(8)
            if text.strip():
                made = Lines(True, 0)
                for line in text.strip("\n").split("\n"):
                    made.add(line.rstrip(), width(line), len(line))
                out.block(made, 2)
        elif name == "table":
            above, rows = yield from _table(part, here, out.taken + len(out.indent))
            out.block(above, 2)
            out.end_line(0 if above.lines else 2)
            out.gap = 1 if above.lines else out.gap
            out.block(rows, 1 if above.lines else 2)
            out.end_line(2)
        elif name in ("li", "dd"):
            mark = "  " if name == "dd" else "- "
            if name == "li" and x.name == "ol":
                number = top[3] if part.start is None else part.start
                mark, top[3] = f"{number}. ", number + x.step  # an item counts where it shows nothing, too
            if _holds_text(part):
                out.open_box(mark)
                stack.append([part.parts, 0, part, 1, here, True])
        else:
            if name in BLOCK:
                # a list inside a list item follows its text without an empty line
                tight = name in ("ul", "ol", "dl") and (out.nested or out.boxes)
                out.end_line(2 if name in SPACED and not tight else 1)
            elif name in ("td", "th") or name in CONTROLS:
                out.blank = True
            inner = part.parts
            if name == "details" and not part.start:
                inner = next(([y] for y in inner if isinstance(y, Node) and y.name == "summary"), [])
            stack.append([inner, 0, part, _first_number(part), here, False])
    return out.done()


def _first_number(node: Node) -> int:
    if node.start is not None:
        return node.start
    return 1 if node.step > 0 else sum(isinstance(x, Node) and x.name == "li" and not x.gone for x in node.parts)


def _holds_text(node: Node) -> bool:
    """Cheap: whether anything but blanks stands right below."""
    return any(not isinstance(x, str) or not x.isspace() for x in node.parts)


def render(node: Node) -> list[str]:
    waiting, made = [_flow(node, True)], None
    while True:
        try:
            waiting.append(waiting[-1].send(made))
            made = None
        except StopIteration as end:
            waiting.pop()
            made = end.value
            if not waiting:
                return made.flat()


def _plain(node: Node, visible: bool) -> str:
    out, todo = [], [(node, visible)]
    while todo:
        x, seen = todo.pop()
        if isinstance(x, str):
            out.append(x if seen else "")
        elif x.name == "br":
            out.append("\n")
        elif not x.gone or x is node:
            here = seen if x.seen is None else x.seen
            todo += [(y, here) for y in reversed(x.parts)]
    return "".join(out)


def text_of(page: str) -> str:
    return "\n".join(render(tree(page)))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every row."""
    return text_pass(pages, lambda texts: [[text_of(t) for t in texts]], [T.StructField("text", T.StringType())], id_col, html_col)


def op6_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
