"""Layout-aware text of web pages: a tree is built with implied tags, invisible parts are left out,
and the rest is rendered with block spacing, lists, preformatted text and aligned table cells.

The work is per page and runs in linear time; pages are spread by Spark, nothing is shuffled.

Defined results: a null page has null text, an empty one empty text; broken markup is read as
browsers do in the main (unclosed tags, quotes and comments run on); repeated rows and null ids
are rendered each for itself; other columns aren't read unless asked for.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import blocks

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas "
                   "datalist title annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
                  "summary table caption tr ul".split())
#: a blank line before and after
SPACED = frozenset("article blockquote dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
                   "section table ul".split())
#: start tags that leave the head open
HEAD = frozenset("meta title link base basefont bgsound script style noscript noframes template head html".split())
#: parts of a drawing that aren't drawn themselves
NOT_DRAWN = frozenset("defs symbol metadata desc clippath mask pattern marker".split())
#: start tags that end a drawing or formula, except inside the elements of it that hold text
LEAVES = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu "
                   "meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_TEXT = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
#: start tags that end an open <p>
ENDS_P = BLOCK - {"body", "html", "li", "dd", "dt", "tr", "caption"} | {"li", "dd", "dt"}
#: start tag -> open tags it ends, up to the border
PARTS = {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": (PARTS - {"tbody", "thead", "tfoot"}, {"table", "template"}),
        "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr", "template"}),
        "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr", "template"}),
        "thead": (PARTS, {"table", "template"}), "tbody": (PARTS, {"table", "template"}), "tfoot": (PARTS, {"table", "template"}),
        "caption": (PARTS, {"table", "template"}), "colgroup": (PARTS, {"table", "template"}),
        "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"})}
#: open tags that a <p> or an end tag can't reach through
SCOPE = frozenset({"td", "th", "table", "button", "caption"})
#: elements that hold table parts only; what else stands directly in them goes in front of the table
FRAME = frozenset("table tbody thead tfoot tr".split())
IN_FRAME = frozenset(PARTS | {"col", "style", "script", "template"})

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>"""
                   r"""|</?([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
NO_SHOW = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def attr(self, name: str) -> str | None:
        for m in ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape((m[2] or "").strip("\"'"))
        return None

    def hidden(self) -> bool:
        if self.tag in HIDDEN:
            return True
        a = self.attrs
        if not a:
            return False
        low = a.lower()
        if "hidden" in low and (self.attr("hidden") is not None or self.tag == "input" and self.attr("type") == "hidden"):
            return True
        return "style" in low and NO_SHOW.search(self.attr("style") or "") is not None


def build(html: str) -> Node:
    """Tree of a page. Text is a string among a node's kids."""
    root = Node("#root")
    stack, open_tags, at, n = [root], Counter(), 0, len(html)
    head_ahead = True
    around: list[Node] = []     # parents of the open tables; an open table is its parent's last kid

    def pop():
        tag = stack.pop().tag
        open_tags[tag] -= 1
        if tag == "table":
            around.pop()

    def add(kid: Node | str) -> None:
        """Put a kid into the innermost open element, or in front of the table if that takes parts only."""
        if around and stack[-1].tag in FRAME and not open_tags["template"] \
                and (kid.strip(" \t\n\r\f") if isinstance(kid, str) else kid.tag not in IN_FRAME):
            around[-1].kids.insert(len(around[-1].kids) - 1, kid)
        else:
            stack[-1].kids.append(kid)

    def close(tags, border) -> None:
        """End the open elements among `tags`, up to the innermost border, with all inside them."""
        if not any(open_tags[t] for t in tags):
            return
        deep = 0
        for i in range(len(stack) - 1, 0, -1):
            t = stack[i].tag
            if t in border:
                break
            if t in tags:
                deep = i
        while deep and len(stack) > deep:
            pop()

    while at < n:
        m = TOKEN.match(html, at)
        at = m.end()
        first = m[0]
        tag = m[1] or m[3]
        if tag is None:
            if not first.startswith("<") or first == "<":
                if first.strip(" \t\n\r\f"):
                    head_ahead = False
                    if stack[-1].tag in ("colgroup", "head"):
                        pop()
                add(first)
            continue
        tag = tag.lower()
        if first[1] == "/":
            if tag == "p" and not open_tags["p"]:
                add(Node("p"))
            elif tag == "table" and around:
                while stack[-1].tag != "table":
                    pop()
                pop()
            elif open_tags[tag]:
                close({tag}, {"table"} if tag in SCOPE else () if tag in ("body", "html") else SCOPE - {tag})
            elif tag == "br":
                add(Node("br"))
            continue
        attrs = m[2] if m[1] else m[4] or ""
        if tag in ENDS_P and open_tags["p"]:
            close({"p"}, SCOPE)
        if tag in ENDS:
            close(*ENDS[tag])
        elif tag == "a" and open_tags["a"]:
            close({"a"}, SCOPE)
        elif tag == "body" and open_tags["head"]:
            close({"head"}, ())
        elif stack[-1].tag == "head" and tag not in HEAD:
            pop()
        foreign = open_tags["svg"] or open_tags["math"]
        if foreign and tag in LEAVES:
            close({"svg", "math"}, HOLDS_TEXT)
        if tag == "head":
            if not head_ahead:
                continue
            head_ahead = False
        elif tag not in HEAD:
            head_ahead = False
        if stack[-1].tag == "colgroup" and tag not in ("col", "template"):
            pop()
        if around and tag in PARTS and not open_tags["template"]:
            # what was put in front of the table ends where the table goes on
            i = len(stack) - 1
            while stack[i].tag not in FRAME and stack[i].tag not in PARTS:
                i -= 1
            while stack[i].tag in FRAME and len(stack) > i + 1:
                pop()
        elif around and stack[-1].tag in FRAME and not open_tags["template"]:
            if tag == "form":    # an empty element here
                continue
            if tag == "table":
                while stack[-1].tag != "table":
                    pop()
                pop()
        node = Node(tag, attrs)
        add(node)
        if tag == "table":
            around.append(stack[-1])
        if tag in VOID or attrs.endswith("/") and (
                tag in ("svg", "math", "path", "rect", "circle", "use") or foreign and not open_tags["foreignobject"]):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I).search(html, at)
            node.kids.append(html[at:end.start()] if end else html[at:])
            at = end.end() if end else n
            continue
        stack.append(node)
        open_tags[tag] += 1
    return root


def width(s: str) -> int:
    """Columns of a string on a fixed grid."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF"
                                          else 1 for c in s)


class Page:
    """Lines of text with pending blank lines, a left margin and list markers."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space = 0, False
        self.margin: list[str] = []
        self.marker = ""

    def text(self, s: str) -> None:
        s = SPACES.sub(" ", s)
        if s == " " or not s:
            self.space = self.space or bool(s)
            return
        body = s.strip(" ")
        if self.line and (self.space or s[0] == " "):
            self.line.append(" ")
        self._begin()
        self.line.append(body)
        self.space = s[-1] == " "

    def _begin(self) -> None:
        if self.line:
            return
        if self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.line.append("".join(self.margin) + self.marker)
        if self.marker:
            self.margin[-1] = " " * len(self.marker)
            self.marker = ""

    def newline(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def block(self, blank: bool) -> None:
        self.newline()
        if blank:
            self.gap = 1

    def verbatim(self, lines: list[str]) -> None:
        for x in lines:
            self._begin()
            self.line.append(x)
            self.newline()


def _drawn(svg: Node) -> list[Node]:
    """The elements of a drawing that show text."""
    out, todo = [], list(reversed(svg.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, str) or k.hidden() or k.tag in NOT_DRAWN:
            continue
        if k.tag in ("text", "foreignobject"):
            out.append(k)
        else:
            todo.extend(reversed(k.kids))
    return out


def _rows(table: Node) -> list[list[Node]]:
    """Cells by row of a table itself, not of tables inside its cells."""
    rows, todo = [], list(reversed(table.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, str) or k.hidden():
            continue
        if k.tag == "tr":
            rows.append([c for c in k.kids if isinstance(c, Node) and c.tag in ("td", "th") and not c.hidden()])
        elif k.tag in ("thead", "tbody", "tfoot", "form", "colgroup"):
            todo.extend(reversed(k.kids))
        elif k.tag in ("td", "th"):
            rows.append([k])
    return [r for r in rows if r]


def _grid(rows: list[list[list[str]]]) -> list[str]:
    """Cells (as lines) in columns of equal width, two blanks apart."""
    n = max(map(len, rows))
    if n == 1:
        return [x for r in rows for x in r[0]]
    wide = [max((width(x) for r in rows if c < len(r) for x in r[c]), default=0) for c in range(n)]
    out = []
    for r in rows:
        for i in range(max(map(len, r))):
            cells = [(r[c][i] if i < len(r[c]) else "") for c in range(len(r))]
            out.append("  ".join(x + " " * (wide[c] - width(x)) for c, x in enumerate(cells)).rstrip(" "))
    return out


def render(root: Node) -> list[str]:
    """Lines of the visible text. Iterative, so deeply nested pages are no problem."""
    results: list[list[str]] = []
    # frames: (page, stack of pending work); a table's cells are rendered to pages of their own first
    page = Page()
    work: list[tuple] = [("node", root)]
    frames: list[tuple[Page, list]] = []
    while True:
        if not work:
            page.newline()
            results.append(page.lines)
            if not frames:
                return results.pop()
            page, work = frames.pop()
            continue
        op, *arg = work.pop()
        if op == "text":
            page.text(arg[0])
        elif op == "end":
            tag, old = arg
            if old is not None:
                del page.margin[old:]
                page.marker = ""
            page.block(tag in SPACED)
        elif op == "grid":
            rows = [[results.pop() for _ in range(k)] for k in arg[0]]
            lines = _grid([[c or [""] for c in r] for r in rows])
            page.block(True)
            page.verbatim([x for x in lines if x] if max(arg[0]) == 1 else lines)
            page.block(True)
        elif op == "cell":
            frames.append((page, work))
            page, work = Page(), [("kids", arg[0])]
        elif op == "kids":
            _push(work, arg[0])
        else:
            node = arg[0]
            tag = node.tag
            if node.hidden():
                continue
            if tag == "br":
                if page.line:
                    page.newline()
                elif page.lines:
                    page.gap = 1
                continue
            if tag == "hr":
                page.block(True)
                continue
            if tag == "img" or tag == "input":
                alt = node.attr("alt") if tag == "img" else node.attr("value")
                if alt:
                    page.text(alt)
                continue
            if tag == "pre" or tag == "textarea":
                page.block(True)
                body = _plain(node).strip("\n")
                page.verbatim([x.rstrip() for x in body.split("\n")] if body.strip() else [])
                page.block(True)
                continue
            if tag == "svg":
                for k in reversed(_drawn(node)):
                    work += [("text", " "), ("node", k), ("text", " ")]
                continue
            if tag == "table":
                rows = _rows(node)
                captions = [k for k in node.kids if isinstance(k, Node) and k.tag == "caption"]
                page.block(True)
                if rows:
                    work.append(("grid", [len(r) for r in rows]))
                    # cells leave results in reverse, so that the grid pops them in order
                    work.extend(("cell", c) for r in rows for c in r)
                for c in reversed(captions):
                    work.append(("node", c))
                continue
            if tag in BLOCK:
                page.block(tag in SPACED and not (tag in ("ul", "ol") and page.margin))
                old = None
                if tag in ("ul", "ol", "menu", "blockquote", "dd"):
                    old = len(page.margin)
                    if tag in ("blockquote", "dd"):
                        page.margin.append("    " if tag == "dd" else "> ")
                    else:
                        _number(node)
                elif tag == "li":
                    old = len(page.margin)
                    page.margin.append("")
                    page.marker = node.attrs if node.attrs.startswith("\0") else "- "
                    page.marker = page.marker.lstrip("\0")
                work.append(("end", tag, old))
            elif tag in ("td", "th") and page.line:
                page.text(" ")
            _push(work, node)


def _push(work: list[tuple], node: Node) -> None:
    work.extend(("text", unescape(k) if "&" in k else k) if isinstance(k, str) else ("node", k)
                for k in reversed(node.kids))


def _number(ol: Node) -> None:
    """Give the visible items of an ordered list their numbers."""
    if ol.tag != "ol":
        return
    start = ol.attr("start") or ""
    i = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    for k in ol.kids:
        if isinstance(k, Node) and k.tag == "li" and not k.hidden():
            k.attrs = f"\0{i}. "
            i += 1


def _plain(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(unescape(k).replace("\r\n", "\n").replace("\r", "\n"))
        elif k.tag == "br":
            out.append("\n")
        elif k is node or not k.hidden():
            todo.extend(reversed(k.kids))
    return "".join(out)


def _first(root: Node, tag: str) -> Node | None:
    todo = [root]
    while todo:
        k = todo.pop()
        if k.tag == tag:
            return k
        todo.extend(x for x in reversed(k.kids) if isinstance(x, Node))
    return None


def page_text(html: str | None) -> tuple[str | None, str | None, int]:
    """(visible text, title, number of blocks parted by blank lines) of a page."""
    if html is None:
        return None, None, 0
    root = build(html)
    title = _first(root, "title")
    text = "\n".join(render(root))
    return (text, SPACES.sub(" ", _plain(title)).strip() if title else None,
            sum(1 for b in text.split("\n\n") if b.strip()))


def _run(html: str, keep: list[str]):
    def run(batches):
        for batch in batches:
            for rb in blocks(batch, html):
                got = [page_text(h) for h in rb.column(html).to_pylist()]
                cols = [rb.column(c) for c in keep]
                cols += [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "extracted_text", "title", "n_blocks"])
    return run


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns (by default all but the page itself) with extracted_text, title and n_blocks."""
    added = {"extracted_text", "title", "n_blocks"}
    keep = [c for c in pages.columns if c != html and c.lower() not in added] if keep is None else keep
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("extracted_text", T.StringType()),
                           T.StructField("title", T.StringType()), T.StructField("n_blocks", T.LongType())])
    return pages.select(*keep, html).mapInArrow(_run(html, keep), schema)


def query(pages: DataFrame) -> DataFrame:
    return extract(pages, keep=["page_id"])
