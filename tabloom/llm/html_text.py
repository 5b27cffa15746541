"""HTML extraction by layout: a tree with implied tags, visibility rules, and a text rendering.

The page becomes a tree: unclosed paragraphs, list items, cells and the like end where HTML says
they do, and stray end tags are ignored. What a browser would not show is left out: scripts, styles,
templates, the head, comments, elements that are ``hidden`` or styled away, form fields of type
hidden. All other text is kept. Blocks are separated by line breaks (paragraphs, headings, lists and
tables by an empty line), list items are marked and indented by depth, and the cells of a table are
padded so that its columns stand below each other.

Nulls and empties: null or empty HTML gives the empty text. Broken markup never fails: a ``<`` that
opens no tag is text, an unclosed comment or script ends with the page. Nothing recurses, so depth is
no limit, and pages of any size are rendered whole. Repeated rows and ids give a row each.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from tabloom.llm.blocks import as_texts, map_blocks

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style template title noembed noframes iframe object audio video canvas datalist".split())
#: Not shown inside the key; other text of drawings and formulas is.
UNSEEN_IN = {"svg": set("desc defs metadata".split()), "math": {"annotation", "annotation-xml"}}
APART = {"text", "mtd"}  # labels of a drawing, cells of a formula
BLOCK = set("address article aside blockquote body center details dd dialog dir div dl dt fieldset figcaption figure footer form "
            "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table ul".split())
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())  # an empty line before and after
LISTS = set("ul ol menu dir".split())
#: A start tag of the key ends an open element of the values, up to the nearest of the limits.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
        "tr": {"tr", "td", "th", "caption"}, "td": {"td", "th", "caption"}, "th": {"td", "th", "caption"},
        "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, "thead": {"tr", "td", "th", "caption"},
        "tfoot": {"tr", "td", "th", "thead", "tbody", "caption"}, "body": {"head"}}
LIMITS = {"li": LISTS, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}, "body": set()}
TABLE = {"table"}
MOST_ROWS = 65_534  # that a cell spans, as in HTML
ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "legend", "summary"} | {"tr", "td", "th", "tbody"}

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/](?![a-zA-Z])[^>]*>|<![a-zA-Z\[][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
AWAY = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(next((v for v in m.groups()[1:] if v is not None), "")) for m in ATTRIBUTE.finditer(text)}


def ends_itself(text: str) -> bool:
    """Whether the closing slash of a tag is one, and not the end of an unquoted value."""
    if not text.endswith("/"):
        return False
    last = None
    for last in ATTRIBUTE.finditer(text):
        pass
    return last is None or last[4] is None or last.end() < len(text)


class Node:
    """An element; children are elements and strings."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def hidden(self) -> bool:
        a = self.attrs
        return (self.tag in UNSEEN or "hidden" in a or bool(a.get("style") and AWAY.search(a["style"]))
                or (self.tag == "input" and a.get("type", "").lower() == "hidden") or (self.tag == "dialog" and "open" not in a))


def parse(page: str) -> Node:
    """The tree of a page, with the tags that HTML implies."""
    root = Node("html", {})
    stack = [root]
    places: dict[str, list[int]] = {}  # where in the stack elements of a tag are open

    def nearest(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def cut(k: int) -> None:
        for e in reversed(stack[k:]):
            places[e.tag].pop()
        del stack[k:]

    def close(tags: set[str], limits: set[str]) -> None:
        """End all open elements of ``tags`` (and what they hold) above the nearest of ``limits``."""
        while (k := nearest(tags)) > nearest(limits):
            cut(k)

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s))

    at, last = 0, page.rfind(">") + 1  # no tag ends after the last ``>``
    while True:
        m = TOKEN.search(page, at, last) if at < last else None
        if m is None:
            text(page[at:].partition("<!--")[0])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith(("->", "--!>")):
                break  # the comment goes on to the end of the page
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br" or (tag == "p" and not places.get("p")):
                stack[-1].children.append(Node(tag, {}))
            elif tag != "html" and tag != "body":
                limits = TABLE if tag not in {"table", "div", "section", "article"} else set()
                if (k := nearest({tag})) > nearest(limits):
                    cut(k)
            continue
        attrs = attributes(m[3]) if m[3].strip(" \t\n\r\f/") else {}
        if tag in ("html", "body"):
            close({"head"}, set())
            (root if tag == "html" else stack[-1]).attrs.update(attrs)
            continue
        if tag in ENDS_P:
            close({"p"}, {"td", "th", "button", "caption", "table"} | TABLE)
        if tag in ENDS:
            close(ENDS[tag], LIMITS.get(tag, TABLE))
        foreign = [t for t in UNSEEN_IN if places.get(t)]
        if any(tag in UNSEEN_IN[t] for t in foreign):
            attrs["hidden"] = ""
        if foreign and tag in APART:
            stack[-1].children.append(" ")
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in VOID or ((foreign or tag in UNSEEN_IN) and ends_itself(m[3])):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            body = page[at:end.start()]
            node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            at = end.end()
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
    return root


def width(text: str) -> int:
    """Columns of a text: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Text under construction: collapses blanks, keeps track of line and paragraph breaks."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False  # a blank is due before the next word
        self.breaks = 0  # line breaks due before the next text
        self.prefix = ""  # what the next line begins with, for example a list mark
        self.indent = ""

    def write(self, text: str, keep: bool = False) -> None:
        if keep:
            first, *rest = text.expandtabs(8).split("\n")
            self.put(first)
            for line in rest:
                self.end(empty=True)
                self.put(line)
            return
        words = BLANKS.sub(" ", text)
        if words.startswith(" ") and self.parts:
            self.space = True
        body = words.strip(" ")
        if body:
            self.put((" " if self.space and self.parts and not self.breaks else "") + body)
            self.space = words.endswith(" ")

    def put(self, text: str) -> None:
        if not text:
            return
        if self.breaks:
            self.end()
            if self.breaks > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.breaks = 0
        if not self.parts:
            self.parts.append(self.prefix or self.indent)
            self.prefix = ""
        self.parts.append(text)

    def end(self, empty: bool = False) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip(" "))
        elif empty:
            self.lines.append("")
        self.parts, self.space = [], False

    def block(self, breaks: int) -> None:
        if self.parts or self.lines:
            self.breaks = max(self.breaks, breaks)
        self.space = False

    def done(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


class Table:
    """Rows of cells (text, columns and rows it spans); a caption is a row of its own that spans no row."""

    def __init__(self):
        self.rows: list[list[tuple[str, int, int]]] = []
        self.groups: set[int] = set()  # rows that begin a group of rows; no cell reaches into the next group

    def text(self) -> list[str]:
        """Lines with aligned columns; a cell of several lines takes several lines, one of several rows stands in the first."""
        grid = []
        until: dict[int, int] = {}  # column: first row that a cell from above does not reach
        for k, row in enumerate(self.rows):
            if k in self.groups:
                until = {}
            cells: list[list[str]] = []
            for content, span, down in row:
                while down and until.get(len(cells), 0) > k:
                    cells.append([""])
                if down > 1:
                    until.update((c, k + down) for c in range(len(cells), len(cells) + span))
                cells += [content.split("\n"), *[[""]] * (span - 1)]
            grid.append(cells)
        columns = max(map(len, grid), default=0)
        widths = [max((width(x) for r in grid if c < len(r) for x in r[c]), default=0) for c in range(columns)]
        out = []
        for cells in grid:
            for k in range(max(map(len, cells), default=0)):
                line = "".join((cell[k] if k < len(cell) else "") + " " * (widths[c] - width(cell[k] if k < len(cell) else "") + 2) for c, cell in enumerate(cells))
                out.append(line.rstrip(" "))
        return [x for x in out if x]


def render(root: Node) -> str:
    """Visible text of a tree; walks it with a list of what is still to do."""
    out = Lines()
    outer: list[Lines] = []
    tables: list[Table] = []
    lists: list[list] = []  # [tag, number of the next item, indent outside]
    kept = 0  # open elements that keep their blanks
    todo: list[tuple[Node | str, bool]] = [(root, True)]
    while todo:
        node, enter = todo.pop()
        if isinstance(node, str):
            out.write(node, kept > 0)
            continue
        tag = node.tag
        if enter:
            if node.hidden():
                continue
            if tag == "br":
                out.end(empty=not out.parts and not out.breaks)
                continue
            if tag == "hr":
                out.block(1)
                continue
            if tag == "textarea":
                out.write("".join(node.children))
                continue
            if tag in ("td", "th", "caption") and tables:
                outer.append(out)
                out = Lines()
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in ("tbody", "thead", "tfoot") and tables:
                tables[-1].groups.add(len(tables[-1].rows))
            elif tag in BLOCK:
                nested = tag in LISTS and lists
                out.block(2 if tag in SPACED and not nested and not (tag == "p" and lists and out.prefix) else 1)
            if tag == "table":
                tables.append(Table())
                outer.append(out)
                out = Lines()
            elif tag in LISTS:
                start = node.attrs.get("start", "")
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1, out.indent])
            elif tag == "li":
                mark = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
                base = lists[-1][2] if lists else out.indent
                if lists:
                    lists[-1][1] += 1
                out.prefix, out.indent = base + mark, base + " " * len(mark)
            elif tag in ("pre", "listing"):
                kept += 1
            todo.append((node, False))
            todo.extend((c, True) for c in reversed(node.children))
            continue
        if tag in ("td", "th", "caption") and tables:
            content, out = out.done(), outer.pop()
            if tag == "caption" or not tables[-1].rows:
                tables[-1].rows.append([])
            span, down = node.attrs.get("colspan", ""), node.attrs.get("rowspan", "")
            down = min(int(down) or MOST_ROWS, MOST_ROWS) if re.fullmatch(r"\d{1,9}", down) else 1  # 0: to the end of the group
            tables[-1].rows[-1].append((content, min(int(span), 1000) if re.fullmatch(r"[1-9]\d{0,8}", span) else 1, 0 if tag == "caption" else down))
        elif tag in ("tbody", "thead", "tfoot") and tables:
            tables[-1].groups.add(len(tables[-1].rows))
        elif tag == "table":
            loose, out = out.done(), outer.pop()  # text in a table outside its cells stands before it
            for line in [*([loose] if loose else []), *tables.pop().text()]:
                out.block(1)
                for one in line.split("\n"):
                    out.put(one)
                    out.block(1)
        elif tag in LISTS:
            out.indent, out.prefix = lists.pop()[2], ""
        elif tag == "li":
            out.indent, out.prefix = (lists[-1][2] if lists else ""), ""
        elif tag in ("pre", "listing"):
            kept -= 1
        if tag in BLOCK:
            out.block(2 if tag in SPACED and not (tag in LISTS and lists) else 1)
    return out.done()


def text_of(page: str) -> str:
    return render(parse(page))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, text_sha256) of every row of ``pages`` (page_id, url, html)."""

    def make():
        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            texts = [text_of(x) for x in as_texts(block.column("html"))]
            return pa.RecordBatch.from_arrays([
                block.column("page_id"), block.column("url"), pa.array(texts), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([sum(1 for x in t.split("\n") if x) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts])],
                ["page_id", "url", "text", "n_chars", "n_lines", "text_sha256"])

        return work

    return map_blocks(pages.select("page_id", "url", "html"), make,
                      "page_id bigint, url string, text string, n_chars bigint, n_lines bigint, text_sha256 string", "html")
