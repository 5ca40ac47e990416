"""Visible text of HTML pages, laid out.

A tree builder with implied tags keeps the stack of open elements and tells a renderer
when elements open and close. The renderer skips what visibility rules hide and keeps
block spacing, list markers, preformatted text and aligned table cells. Both work in one
pass over a page without recursion, so depth and length have no limit of their own.

Formulas give the text of their parts, without annotations; drawings that of their text
elements, each on a line of its own, without what is only defined. Not given, though
browsers show it: the options of a select, the values of inputs, and text that is drawn
by `use` of a definition. What stands in for media, objects, frames and scripts is taken to
be unseen.

Layout rules that keep the output in proportion to the page, however it is nested; no text
is lost by them. Indents add up over DEPTH levels. Tables are aligned DEPTH deep; in deeper
ones cells follow each other as blocks. A column is as wide as its widest cell, but cells
that would make its padding more than PADDING times its text, and WIDE a line, do not count.
A cell is at most GAP blanks away from the one before it. Row spans are carried down over
the first SPANNED columns.

`visibility` is inherited, and shows again where something inside sets it so; a dialog shows
if it is open; after <plaintext> the rest of the page is text.

Defined results: a null page gives null text, a page without visible text an empty one;
markup that is broken off is read as far as it goes; a quote that is never closed ends with
its tag; a page of any length is read whole, in one pass; repeated rows repeat; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names by their role in the format.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes".split())
ESCAPABLE = set("title textarea".split())
UNSEEN = set("head script style template noscript title iframe noembed noframes datalist object video audio canvas select".split())
UNSEEN_IN_SVG = set("defs symbol clippath mask marker pattern metadata desc lineargradient radialgradient filter".split())
UNSEEN_IN_MATH = set("annotation annotation-xml mphantom".split())
DRAWN, FOLD = {"text", "foreignobject"}, {"summary"}
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav ol option p pre section summary table ul h1 h2 h3 h4 h5 h6 caption xmp plaintext".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre table dl figure xmp plaintext".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre section summary table ul xmp plaintext".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = set("base link meta title style script template noscript".split())
SECTIONS = set("thead tbody tfoot".split())
SCOPE = set("html table td th caption template object marquee".split())
#: For a start tag: open elements that it ends, and those at which the search for them stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"} | SCOPE),
    "dd": ({"dd", "dt"}, {"dl"} | SCOPE),
    "dt": ({"dd", "dt"}, {"dl"} | SCOPE),
    "option": ({"option"}, {"select", "datalist"} | SCOPE),
    "td": ({"td", "th", "caption"}, {"tr", "table", "template"}),
    "th": ({"td", "th", "caption"}, {"tr", "table", "template"}),
    "tr": ({"tr", "caption"}, {"table", "template"}),
    "thead": (SECTIONS | {"caption"}, {"table", "template"}),
    "tbody": (SECTIONS | {"caption"}, {"table", "template"}),
    "tfoot": (SECTIONS | {"caption"}, {"table", "template"}),
    "caption": ({"caption"}, {"table", "template"}),
}
#: Rules of the layout, see above.
DEPTH, PADDING, WIDE, GAP, SPANNED = 16, 4, 60, 200, 1000
#: The most columns and rows that a cell may span.
SPANS = {"colspan": 1000, "rowspan": 65534}

# Attributes are read to the end of the tag, or up to a quoted value that is never closed.
TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|</>|</[^a-zA-Z>][^>]*>
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))*+)""",
    re.S | re.X,
)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|content-visibility\s*:\s*hidden)\b", re.I)
#: Unlike those, this is inherited by what is inside, which may set it otherwise.
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible|initial)\b", re.I)


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def spanned(attrs: dict[str, str], name: str) -> int:
    """A number of columns or rows, within what the format allows."""
    m = re.match(r"\s*\+?([0-9]+)", attrs.get(name, ""))
    return min(int(m[1][:12]), SPANS[name]) if m else 1


class Flow:
    """Text that is laid out line by line."""

    __slots__ = ("out", "gap", "space", "indents", "markers")

    def __init__(self):
        self.out: list[str] = []
        self.gap, self.space = 0, False
        self.indents: list[str] = []
        self.markers: list[tuple[int, str]] = []  # of list items without a line yet, by their level

    def block(self, gap: int) -> None:
        self.gap = max(self.gap, gap)

    def _open_line(self) -> None:
        if self.out:
            if self.space:
                self.out[-1] = self.out[-1].rstrip(" ")
            self.out.append("\n" * self.gap)
        lead = self.indents[:DEPTH]
        for level, marker in self.markers:
            lead[level : level + 1] = [marker]  # beyond DEPTH, after the others
        self.markers.clear()
        self.out.append("".join(lead))
        self.gap, self.space = 0, False

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if (fresh := self.gap or not self.out) or self.space:
            s = s.lstrip(" ")
        if not s:
            return
        if fresh:
            self._open_line()
        self.out.append(s)
        self.space = s[-1] == " "

    def verbatim(self, s: str) -> None:
        for k, line in enumerate(s.replace("\r\n", "\n").split("\n")):
            if k:
                self.gap += 1
            if line:
                if self.gap or not self.out:
                    self._open_line()
                self.out.append(line)
                self.space = False

    def get(self) -> str:
        return "".join(self.out).rstrip()


class Table:
    """Rows of cells: lines, columns spanned, rows spanned."""

    __slots__ = ("rows",)

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def _placed(self) -> list[list[tuple[list[str], int, int]]]:
        """Cells as (lines, first column, column after), past the columns that cells of earlier rows hold."""
        out, held = [], [0] * SPANNED  # the row up to which a column is held
        some = 0  # columns that any cell has held
        for r, row in enumerate(self.rows):
            at, cells = 0, []
            for lines, across, down in row:
                while at < some and held[at] > r:
                    at += 1
                cells.append((lines, at, at + across))
                if down > 1:
                    stop = min(at + across, SPANNED)
                    held[at:stop] = [r + down] * (stop - at)
                    some = max(some, stop)
                at += across
            out.append(cells)
        return out

    def lines(self) -> list[str]:
        placed = self._placed()
        found: dict[int, list[int]] = {}
        for cells in placed:
            for lines, at, stop in cells:
                if stop == at + 1:
                    found.setdefault(at, []).extend(map(len, lines))
        columns = sorted(found)  # those of which some cell is the only one
        ends = [0]  # widths of columns with the gaps after them, summed up
        for c in columns:
            own = found[c]
            most = max(WIDE, PADDING * sum(own) // len(own))
            ends.append(ends[-1] + max((w for w in own if w <= most), default=0) + 2)
        out = []
        for cells in placed:
            if not any(any(lines) for lines, _, _ in cells):
                continue
            for k in range(max(len(lines) for lines, _, _ in cells)):
                line, want = [], 0  # the column position at which the next cell starts
                size = 0
                for lines, at, stop in cells:
                    text = lines[k] if k < len(lines) else ""
                    if text:
                        want = min(ends[bisect_left(columns, at)], size + GAP)
                        if line:
                            want = max(want, size + 2)
                        line.append(" " * (want - size) + text)
                        size = want + len(text)
                out.append("".join(line))
        return out


class Renderer:
    def __init__(self):
        self.flows: list[Flow] = [Flow()]
        self.tables: list[Table] = []
        self.lists: list[list] = []
        self.unseen = self.pre = self.math = self.deep = 0
        self.visible = True
        self.folded: list[tuple[int, set[str]]] = []  # depth of what is hidden, and what shows in it

    def opened(self, name: str, attrs: dict[str, str]) -> dict:
        """State that closed() needs."""
        state = {"name": name}
        inside = self.folded[-1][1] if self.folded else ()
        if told := VISIBILITY.findall(attrs.get("style", "")):
            state["visible"] = self.visible
            self.visible = told[-1].lower() in ("visible", "initial")
        if name == "math":
            self.math += 1
        if name in UNSEEN or (inside is DRAWN and name in UNSEEN_IN_SVG) or (self.math and name in UNSEEN_IN_MATH) or "hidden" in attrs or (name == "dialog" and "open" not in attrs) or HIDING.search(attrs.get("style", "")):
            self.unseen += 1
            state["unseen"] = True
        elif name == "details" and "open" not in attrs:  # folded: only its summary shows
            if not self.unseen:
                self.flows[-1].block(1)
            self.unseen += 1
            self.folded.append((self.unseen, FOLD))
            state["unseen"] = state["folded"] = True
        elif name == "svg" and not (inside is DRAWN and self.unseen == self.folded[-1][0]):
            self.unseen += 1
            self.folded.append((self.unseen, DRAWN))
            state["unseen"] = state["folded"] = True
        elif name in inside and self.unseen == self.folded[-1][0]:
            self.unseen -= 1
            state["summary"] = True
            state["apart"] = name != "summary"
        if self.unseen:
            return state
        flow = self.flows[-1]
        if name == "math" and attrs.get("display", "").lower() == "block":
            state["apart"] = True
        if state.get("apart"):
            flow.block(1)
        if name == "br":
            flow.gap += 1
        elif name == "hr":
            flow.block(1)
        elif name == "table" and len(self.tables) >= DEPTH:
            self.deep += 1
            state["deep"] = True
            flow.block(2)
        elif self.deep and name in ("tr", "td", "th"):
            flow.block(1)
        elif name == "table":
            self.tables.append(Table())
            state["table"] = True
        elif name in ("td", "th") and self.tables:
            if not self.tables[-1].rows:
                self.tables[-1].rows.append([])
            state["span"] = spanned(attrs, "colspan") or 1, spanned(attrs, "rowspan")
            self.flows.append(Flow())
        elif name == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif name in BLOCKS:
            flow.block(2 if name in SPACED else 1)
            if name in ("ul", "ol", "menu", "dir"):
                if not self.lists:
                    flow.block(2)
                start = attrs.get("start", "1")
                self.lists.append([name == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
                state["list"] = True
            elif name == "li":
                mark = "- "
                if self.lists and self.lists[-1][0]:
                    mark = f"{self.lists[-1][1]}. "
                    self.lists[-1][1] += 1
                flow.markers.append((len(flow.indents), mark))
                flow.indents.append(" " * len(mark))
                state["indent"] = flow
            elif name in ("blockquote", "dd"):
                flow.indents.append("  ")
                state["indent"] = flow
            elif name in ("pre", "xmp", "plaintext"):
                self.pre += 1
                state["pre"] = True
        return state

    def closed(self, state: dict) -> None:
        name = state["name"]
        self.math -= name == "math"
        self.visible = state.get("visible", self.visible)
        if "unseen" in state:
            self.unseen -= 1
            if "folded" in state:
                self.folded.pop()
            return
        if self.unseen:
            self.unseen += "summary" in state
            return
        if "span" in state:
            cell = self.flows.pop().get().split("\n")
            across, down = state["span"]
            self.tables[-1].rows[-1].append((cell, across, down or SPANS["rowspan"]))
            return
        flow = self.flows[-1]
        if "deep" in state:
            self.deep -= 1
            flow.block(2)
        if "table" in state:
            flow.block(2)
            for line in self.tables.pop().lines():
                if line:
                    flow.verbatim(line)
                    flow.block(1)
                else:
                    flow.gap += 1
            flow.block(2)
            return
        if "pre" in state:
            self.pre -= 1
        if "indent" in state:
            own = state["indent"]
            own.indents.pop()
            if own.markers and own.markers[-1][0] == len(own.indents):
                own.markers.pop()
        if "list" in state:
            self.lists.pop()
            if not self.lists:
                flow.block(2)
        if name in BLOCKS:
            flow.block(2 if name in SPACED else 1)
        if state.get("apart"):
            flow.block(1)
        if "summary" in state:
            self.unseen += 1

    def text(self, s: str) -> None:
        if not self.unseen and self.visible:
            (self.flows[-1].verbatim if self.pre else self.flows[-1].text)(s)


class Builder:
    """Open elements; start tags end and imply others as the format asks."""

    def __init__(self):
        self.show = Renderer()
        self.open: list[tuple[str, dict]] = []
        self.at: dict[str, list[int]] = {}  # the depths of the open elements of each name
        self.body = False

    def push(self, name: str, attrs: dict[str, str]) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, self.show.opened(name, attrs)))

    def pop(self) -> None:
        name, state = self.open.pop()
        self.at[name].pop()
        self.show.closed(state)

    def end_open(self, names: set[str], stop: set[str]) -> bool:
        """Close up to the innermost of `names`, if it is above every one of `stop`."""
        k = self.innermost(names)
        if k < 0 or k < self.innermost(stop):
            return False
        while len(self.open) > k:
            self.pop()
        return True

    def innermost(self, names: set[str]) -> int:
        """The depth of the innermost open element of these names, -1 without one; it takes no walk up the stack."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def start(self, name: str, raw: str) -> None:
        attrs = attributes(raw) if raw and not raw.isspace() else {}
        if name in ("html", "head", "body"):
            if name == "body" and self.at.get("head"):
                self.end_open({"head"}, set())
            if not self.at.get(name) and not self.body:
                self.push(name, attrs)
            self.body |= name == "body"
            return
        if self.at.get("head") and name not in IN_HEAD:  # the head ends without being told
            if not self.at.get("template"):
                self.end_open({"head"}, set())
        if name in ENDS:
            self.end_open(*ENDS[name])
        if name in ENDS_P:
            self.end_open({"p"}, SCOPE | {"button"})
        if name in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.pop()
        if name in ("td", "th", "tr", "caption") or name in SECTIONS:
            if not self.at.get("table"):
                return  # parts of a table outside of one are passed over
            self.end_to_table(name)
            if name in ("td", "th") and not self.inside("tr"):
                self.start("tr", "")
            if name == "tr" and not any(self.inside(s) for s in SECTIONS):
                self.push("tbody", {})
        if name == "a" and self.at.get("a"):
            self.end_open({"a"}, SCOPE)
        self.push(name, attrs)
        if name in VOID:
            self.pop()

    def end_to_table(self, name: str) -> None:
        """Close what stands between a part of a table and the part it belongs in."""
        into = {"table"} | (SECTIONS if name not in SECTIONS | {"caption"} else set()) | ({"tr"} if name in ("td", "th") else set())
        while self.open and self.open[-1][0] not in into | {"template"}:
            self.pop()

    def inside(self, name: str) -> bool:
        """Whether the innermost part of the present table is of that name, or within it."""
        k = self.innermost({name})
        return k >= 0 and k >= self.innermost({"table"})

    def end(self, name: str) -> None:
        if name in ("html", "body") or name in VOID - {"br"}:
            return
        if name == "br":
            self.start("br", "")
        elif name == "p" and not self.at.get("p"):
            self.start("p", "")
            self.end("p")
        elif name in HEADINGS:
            self.end_open(HEADINGS, SCOPE)
        else:
            self.end_open({name}, SCOPE - {name} if name not in ("table", "tr") and name not in SECTIONS else {"table", "template"} - {name})

    def text(self, s: str) -> None:
        if self.at.get("head") and not self.show_in_head() and not s.isspace():
            self.end_open({"head"}, set())
        self.show.text(s)

    def foreign(self) -> bool:
        """Whether the innermost open element is of a drawing or formula, where tags may close themselves."""
        return self.innermost({"svg", "math"}) > self.innermost({"foreignobject"})

    def show_in_head(self) -> bool:
        return self.open[-1][0] != "head"

    def feed(self, page: str) -> str:
        at, n = 0, len(page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self.text(html.unescape(page[at:]) if "&" in page[at:] else page[at:])
                break
            if lt > at:
                s = page[at:lt]
                self.text(html.unescape(s) if "&" in s else s)
            m = TAG.match(page, lt)
            if not m:
                if page.find(">", lt) < 0 and lt + 1 < n and page[lt + 1] in "/!?":
                    break  # broken off inside a tag
                self.text("<")
                at = lt + 1
                continue
            at, name = m.end(), m["name"]
            if not name:
                continue
            end = page.find(">", at)  # right here, or after a quote that is never closed
            if end < 0:
                break
            at = end + 1
            name = name.lower()
            if m["end"]:
                self.end(name)
                continue
            self.start(name, m["attrs"])
            if name == "plaintext":  # nothing ends it
                self.show.text(page[at:])
                break
            if m["attrs"].endswith("/") and self.foreign():
                if self.open[-1][0] == name:
                    self.pop()
                continue
            if name in RAW or name in ESCAPABLE:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                s = page[at : close.start() if close else n]
                if name not in RAW:
                    self.text(html.unescape(s))
                elif name == "xmp":
                    self.text(s)
                at = close.end() if close else n
                if self.open and self.open[-1][0] == name:
                    self.pop()
        while self.open:
            self.pop()
        return self.show.flows[0].get()


def visible_text(page: str | None) -> str | None:
    return None if page is None else Builder().feed(page)


def _extracted(batches):
    for batch in batches:
        out = [visible_text(p.as_py()) for p in batch.column(2)]
        lines = [None if t is None else sum(1 for x in t.split("\n") if x) for t in out]
        digests = [None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in out]
        columns = [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_lines", "text_sha256"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_lines, text_sha256 of pages(page_id, url, html)."""
    rows = pages.selectExpr("CAST(page_id AS LONG) AS page_id", "CAST(url AS STRING) AS url", "CAST(html AS STRING) AS html")
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_lines long, text_sha256 string")
