"""HTML extraction by layout-aware rendering.

A tree builder reads tags, adds the ones that markup may leave out (ends of p, li, dt, dd,
tr, td, option and the like; rows around bare cells), and drops what isn't shown: scripts,
styles, templates, the head, what has ``display: none``, the hidden attribute or a closed dialog or details about it.
``visibility`` is inherited and may be set back further in. Both are read from style attributes and from the page's style
sheets: selectors of a tag, a class or an id, or of a tag with one of these; others are left out, as are rules for
media but screen and all. Labels of drawings, tokens of formulas and what stands in for an object are
text; fallbacks of scripts, frames, media and canvases aren't. The tree is then laid
out: inline text flows with blanks collapsed, blocks stand apart, lists get markers and
indents, preformatted text keeps its lines, and cells of a table are set in aligned columns, by the width that
characters take on a terminal; cells over several columns or rows take their place in all of them.

Time and memory grow with the page, not with its depth or its spans. No text is cut for that, only blanks are: an
indent is at most INDENT wide; a table has at most COLUMNS columns, what follows in a row stands unaligned after them; a
cell wider than WIDEST doesn't widen its column, and no cell is moved beyond LINE by alignment; tables more than NESTED deep are
rows of plain text. The tree is walked with a stack of its own.

Defined results: null html gives null text, empty html empty text; repeated rows are rendered
one by one; broken markup is rendered as far as it can be read (a tag or comment that never ends swallows the rest); numbers
of lists and spans out of range are brought into it, as browsers do; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import short_batches

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head title script style template noscript noframes noembed iframe audio video canvas datalist param link meta area base col colgroup source track".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul optgroup option caption thead tbody tfoot tr td th xmp".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir form xmp".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre section summary table ul xmp".split())
#: The text of drawings and formulas is in these elements (of formulas, bare text too), not in those of UNDRAWN.
DRAWN = {"svg": frozenset(["text", "foreignobject"]), "math": frozenset("mi mn mo ms mtext".split())}
UNDRAWN = frozenset("annotation annotation-xml clippath defs desc marker mask metadata mphantom pattern symbol".split())
#: A start tag in the first set ends open elements of the second, not beyond those of the third.
IMPLIED = (
    (frozenset(["li"]), frozenset(["li"]), frozenset("ul ol menu dir table td th body".split())),
    (frozenset(["dt", "dd"]), frozenset(["dt", "dd"]), frozenset("dl table td th body".split())),
    (frozenset(["option", "optgroup"]), frozenset(["option"]), frozenset("select datalist optgroup body".split())),
    (frozenset(["td", "th"]), frozenset(["td", "th", "caption"]), frozenset(["tr", "table", "body"])),
    (frozenset(["tr"]), frozenset(["td", "th", "tr", "caption"]), frozenset(["thead", "tbody", "tfoot", "table", "body"])),
    (frozenset(["thead", "tbody", "tfoot"]), frozenset(["td", "th", "tr", "thead", "tbody", "tfoot", "caption"]), frozenset(["table", "body"])),
)
P_STOPS = frozenset("table td th caption button body html".split())
#: Greatest spans and numbers that browsers take.
COLUMNS, ROWS, NUMBER = 1000, 65534, 2**31 - 1
INDENT, WIDEST, LINE, NESTED = 40, 100, 300, 8

ATTRIBUTES = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+>")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NEEDED = re.compile(r"hidden|style|colspan|rowspan|start|type|value|open|reversed|display|visibility", re.I)
STYLED = re.compile(r"(?:display|visibility)\s*:", re.I)
DECLARED = re.compile(r"(?:^|[;{])\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?([.#][\w-]+)?")
SCREEN = re.compile(r"@media\s+(?:only\s+)?(?:screen|all)", re.I)
BLANKS = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class Sheet:
    """What style sheets say of display and visibility."""

    def __init__(self) -> None:
        self.rules: dict[tuple[str, str, str], tuple] = {}

    def read(self, css: str) -> None:
        skip, selectors = 0, None
        for m in re.finditer(r"([^{}]*)([{}])", re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S)):
            if skip:
                skip += 1 if m[2] == "{" else -1
            elif m[2] == "{":
                selectors = m[1].rpartition(";")[2].strip()
                if selectors.startswith("@"):
                    skip, selectors = 0 if SCREEN.fullmatch(selectors) else 1, None
            elif selectors is not None:
                self._add(selectors, m[1])
                selectors = None

    def _add(self, selectors: str, body: str) -> None:
        said = [(k.lower(), v.lower(), bool(w)) for k, v, w in DECLARED.findall(body)]
        for each in selectors.split(",") if said else ():
            if (found := SELECTOR.fullmatch(each.strip())) and found[0]:
                tag, mark = (found[1] or "").lower().removeprefix("*"), found[2] or ""
                weight = (100 * mark.startswith("#") + 10 * mark.startswith(".") + bool(tag), len(self.rules))
                for k, v, important in said:
                    old = self.rules.get((k, tag, mark))
                    if old is None or important >= old[0]:
                        self.rules[k, tag, mark] = (important, weight, v)

    def of(self, node: Node) -> tuple[str | None, str | None]:
        """The element's own display and visibility, if anything says them."""
        a = node.attrs or {}
        own = {k.lower(): (bool(w), (1000, i), v.lower()) for i, (k, v, w) in enumerate(sorted(DECLARED.findall(a["style"]), key=lambda d: bool(d[2])))} if "style" in a else {}
        if self.rules:
            marks = ["", *("." + c for c in a.get("class", "").split()), *(["#" + a["id"]] if "id" in a else [])]
            for k in ("display", "visibility"):
                said = [r for tag in ("", node.tag) for m in marks if (r := self.rules.get((k, tag, m)))]
                if said:
                    own[k] = max([*said, *([own[k]] if k in own else [])], key=lambda r: r[:2])
        return tuple(own[k][2] if k in own else None for k in ("display", "visibility"))


def _attributes(text: str, more: bool) -> dict[str, str] | None:
    if not text or not (more or NEEDED.search(text)):
        return None
    return {k.lower(): unescape(a or b or c or "") for k, a, b, c in reversed(ATTRIBUTE.findall(text))}


def build(html: str) -> tuple[Node, Sheet]:
    """The tree of a page, under a body element, and its style sheets."""
    root, sheet = Node("body"), Sheet()
    sheets = re.search(r"<style\b", html, re.I)
    styled = bool(sheets and STYLED.search(html, sheets.end()))
    stack, where = [root], defaultdict(list, {"body": [0]})  # where: the open elements of each tag, by their places in the stack

    def push(node: Node) -> None:
        where[node.tag].append(len(stack))
        stack.append(node)

    def close(to: int) -> None:
        for n in stack[to:]:
            where[n.tag].pop()
        del stack[to:]

    def end(tags: frozenset[str], stops: frozenset[str]) -> None:
        """End the outermost open element of ``tags`` within the nearest of ``stops``."""
        least = max((where[t][-1] for t in stops if where.get(t)), default=0)
        inner = [own[k] for t in tags if (own := where.get(t)) and (k := bisect_right(own, least)) < len(own)]
        if inner:
            close(min(inner))

    def add(text: str) -> None:
        if text:
            stack[-1].children.append(unescape(text) if "&" in text else text)

    at = begun = 0  # text that hasn't been added yet begins at ``begun``
    while (at := html.find("<", at)) >= 0:
        first = html[at + 1 : at + 2]
        closing = first == "/"
        name = NAME.match(html, at + 1 + closing)
        if name is None and first not in ("!", "?", "/"):
            at += 1  # a bare less-than sign is text
            continue
        add(html[begun:at])
        if name is None:
            comment = html.startswith("<!--", at)
            stop = html.find("-->" if comment else ">", at + 2)
            at = begun = len(html) if stop < 0 else stop + (3 if comment else 1)
            continue
        rest = ATTRIBUTES.match(html, name.end())
        if rest is None:  # it never ends
            begun = len(html)
            break
        tag, at = name[0].lower(), rest.end()
        begun = at
        if closing:
            if tag == "p" and not where["p"]:
                stack[-1].children.append(Node("p"))
            elif where.get(tag) and tag not in ("body", "html"):
                stops = frozenset(["td", "th", "caption"]) if tag not in ("table", "tr", "td", "th", "caption", "thead", "tbody", "tfoot") else frozenset(["table"]) - {tag}
                _end_last(tag, stops, where, close)
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P and where["p"]:
            end(frozenset(["p"]), P_STOPS)
        for starts, ends, stops in IMPLIED:
            if tag in starts:
                end(ends, stops)
        if tag in ("td", "th") and where["table"] and stack[-1].tag != "tr":
            row = Node("tr")
            stack[-1].children.append(row)
            push(row)
        text = rest[0][:-1]
        node = Node(tag, _attributes(text, styled))
        stack[-1].children.append(node)
        foreign = tag in DRAWN or ((where["svg"] or where["math"]) and not where["foreignobject"])
        if foreign and tag in UNDRAWN:
            node.attrs = {"hidden": ""}
        elif foreign and (a := node.attrs) and ("display" in a or "visibility" in a):
            a["style"] = "".join(f"{k}:{a[k]};" for k in ("display", "visibility") if k in a) + a.get("style", "")
        if tag in VOID or (text.endswith("/") and (foreign or tag == "path")):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            inner = html[at : stop.start() if stop else len(html)]
            if tag in ("textarea", "xmp"):
                node.children.append(unescape(inner) if tag == "textarea" else inner)
            elif tag == "style" and not foreign and styled:
                sheet.read(inner)
            at = begun = stop.end() if stop else len(html)
        elif tag != "head":  # what the head holds is judged by itself: its end may be missing
            push(node)
    add(html[begun:])
    return root, sheet


def _end_last(tag: str, stops: frozenset[str], where: dict[str, list[int]], close) -> None:
    """An end tag: ends the innermost open element of its name, if that is within the nearest of ``stops``."""
    if where[tag][-1] > max((where[t][-1] for t in stops if where.get(t) and t != tag), default=0):
        close(where[tag][-1])


def displayed(node: Node, display: str | None) -> bool:
    if node.tag in UNSEEN or display == "none":
        return False
    a = node.attrs or {}
    away = "hidden" in a or (node.tag == "dialog" and "open" not in a)
    return not (away and display is None) and not (node.tag == "input" and a.get("type", "").lower() == "hidden")


def drawn(node: Node, visible: bool, sheet: Sheet) -> list[tuple]:
    """What a drawing or formula shows as text, with blanks between; each with the visibility that it inherits."""
    out: list[tuple] = []
    todo: list[tuple] = [(c, visible) for c in reversed(node.children)]
    while todo:
        n, seen = todo.pop()
        if isinstance(n, str):
            if node.tag == "math" and not n.isspace():
                out += [(" ", seen), (n, seen)]
        elif n.tag in DRAWN[node.tag]:
            out += [(" ", seen), (n, seen)]
        else:
            display, own = sheet.of(n)
            if displayed(n, display):
                seen = seen if own is None else own == "visible"
                todo += [(c, seen) for c in reversed(n.children)]
    return out[1:]


class Page:
    """Lines of text under layout: a current line, the space wanted before the next one, and an indent."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indents = [""]
        self.marker: str | None = None

    def flush(self) -> None:
        text = "".join(self.line).rstrip(" ")
        self.line, self.space = [], False
        if text:
            self.put(text)

    def put(self, text: str) -> None:
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0
        lead = self.indents[-1]
        if self.marker is not None:
            lead, self.marker = lead[: max(0, len(lead) - len(self.marker))] + self.marker, None
        self.lines.append((lead + text).rstrip(" "))

    def indent(self, by: int) -> None:
        self.indents.append(" " * min(INDENT, len(self.indents[-1]) + by))

    def block(self, gap: int) -> None:
        self.flush()
        if self.lines and self.marker is None:
            self.gap = max(self.gap, gap)

    def text(self, s: str) -> None:
        s = BLANKS.sub(" ", s)
        if s == " " or not s:
            self.space = self.space or bool(s)
            return
        lead = s[0] == " " or self.space
        if lead and self.line:
            self.line.append(" ")
        self.line.append(s.strip(" "))
        self.space = s[-1] == " "

    def raw(self, s: str) -> None:
        first, *more = s.replace("\r\n", "\n").split("\n")
        self.line.append(first)
        for x in more:
            line, self.line = "".join(self.line), [x]
            if line.strip() or self.lines:
                self.put(line) if line.strip() else self.lines.append("")


class _Widths(dict):
    def __missing__(self, c: str) -> int:
        self[c] = 0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1
        return self[c]


_WIDTH = _Widths()


def width(s: str) -> int:
    """Columns that a text takes on a terminal."""
    return len(s) if s.isascii() else sum(map(_WIDTH.__getitem__, s))


def align(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table of cells (lines, columns, rows): every column as wide as its widest cell."""
    until = np.zeros(COLUMNS, np.int64)  # the row up to which each column is taken
    placed: list[list[tuple[int, int, list[str]]]] = []
    for r, row in enumerate(rows):
        free, c, own = np.flatnonzero(until <= r), 0, []
        for lines, wide, high in row:
            k = int(np.searchsorted(free, c))
            c = int(free[k]) if k < len(free) else COLUMNS
            wide = min(wide, COLUMNS - c)
            until[c : c + wide] = r + high
            own.append((c, wide, lines))
            c += wide
        placed.append(own)
    widths, spanned = np.zeros(COLUMNS + 1, np.int64), []
    for own in placed:
        for c, wide, lines in own:
            most = max(map(width, lines), default=0)
            if wide > 1:
                spanned.append((wide, c, min(most, LINE)))
            elif most <= WIDEST:
                widths[c] = max(widths[c], most)
    for wide, c, most in sorted(spanned):  # what a cell over several columns lacks goes to the last of them that holds anything
        columns = np.flatnonzero(widths[c : c + wide])
        lack = most - int(widths[c : c + wide].sum()) - 2 * max(0, len(columns) - 1)
        if lack > 0:
            widths[c + (int(columns[-1]) if len(columns) else 0)] += lack
    starts = np.minimum(LINE, np.concatenate([[0], np.cumsum(widths + 2 * (widths > 0))])).tolist()
    out = []
    for own in placed:
        k = 0
        while own := [x for x in own if k < len(x[2])]:
            text, at = [], 0
            for c, _, lines in own:
                if lines[k]:
                    pad = max(starts[c] - at, 2 if text else 0)
                    text += [" " * pad, lines[k]]
                    at += pad + width(lines[k])
            out.append("".join(text).rstrip(" "))
            k += 1
    return out


def _number(node: Node, name: str, default: int, least: int = -NUMBER, most: int = NUMBER) -> int:
    found = re.match(r"\s*([+-]?)0*(\d+)", (node.attrs or {}).get(name, ""))
    if not found:
        return default
    size = int(found[2]) if len(found[2]) < 12 else NUMBER
    return max(least, min(most, -size if found[1] == "-" else size))


def _items(node: Node) -> int:
    return sum(not isinstance(c, str) and c.tag == "li" for c in node.children)


LISTS = frozenset(["ul", "ol", "menu", "dir"])


def render(html: str) -> str:
    """All visible text of a page, laid out."""
    page, pages, pre = Page(), [], 0
    tables: list[list[list] | None] = []  # the rows of each open table; None: one that is too deep
    lists: list[list] = []  # the next number of each open list, if it has numbers, and the step
    root, sheet = build(html)
    walk: list[tuple] = [(root, True)]  # with inherited visibility; None: on leaving
    while walk:
        node, visible = walk.pop()
        if isinstance(node, str):
            if visible:
                page.raw(node) if pre else page.text(node)
            continue
        tag, cell = node.tag, node.tag in ("td", "th", "caption")
        if visible is not None:
            display, own = sheet.of(node) if sheet.rules or node.attrs else (None, None)
            if not displayed(node, display):
                continue
            visible = visible if own is None else own == "visible"
            if tag == "br":
                if page.line:
                    page.flush()
                elif page.lines:
                    page.gap = max(page.gap, 1)
                continue
            if tag == "input":
                if visible and (node.attrs or {}).get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                    page.text(f" {(node.attrs or {}).get('value', '')} ")
                continue
            if tag in DRAWN:
                walk += reversed(drawn(node, visible, sheet))
                continue
            walk.append((node, None))
            children = node.children
            if tag == "table":
                page.block(1)
                tables.append([] if len(tables) < NESTED else None)
            elif tag == "tr" and tables and tables[-1] is not None:
                tables[-1].append([])
                page.flush()
            elif cell and tables and tables[-1] is not None:
                pages.append((page, lists, pre))
                page, lists, pre = Page(), [], 0
            elif cell and tables:
                page.text(" ")
            elif tag in BLOCK:
                page.block(1 if tag in SPACED and not (tag in LISTS and lists) else 0)
                if tag in LISTS:
                    step = -1 if "reversed" in (node.attrs or {}) else 1
                    lists.append([_number(node, "start", 1 if step > 0 else _items(node)) if tag == "ol" else None, step])
                elif tag == "li":
                    mark = "- "
                    if lists and lists[-1][0] is not None:
                        at = _number(node, "value", lists[-1][0])
                        mark = f"{at}. "
                        lists[-1][0] = at + lists[-1][1]
                    page.indent(len(mark))
                    page.marker = mark if visible else None
                elif tag in ("blockquote", "dd"):
                    page.indent(4 if tag == "dd" else 2)
                elif tag in ("pre", "listing", "xmp"):
                    pre += 1
                elif tag == "details" and "open" not in (node.attrs or {}):
                    children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
            if tag == "pre" and children and isinstance(children[0], str):
                children[0] = children[0].removeprefix("\n")
            walk += [(c, visible) for c in reversed(children)]
            continue
        if tag == "table":
            page.flush()
            for line in align([r for r in tables.pop() or () if r]):
                page.put(line)
            page.block(1)
        elif tag == "tr" and tables:
            page.flush()
        elif cell and tables and tables[-1] is not None:
            page.flush()
            lines, (page, lists, pre) = page.lines, pages.pop()
            if tag == "caption":
                for line in lines:
                    page.put(line)
            else:
                if not tables[-1]:
                    tables[-1].append([])
                high = _number(node, "rowspan", 1, 0, ROWS)
                tables[-1][-1].append((lines, _number(node, "colspan", 1, 1, COLUMNS) or 1, high or ROWS))  # no rows: all that follow
        elif tag in BLOCK and not (cell and tables):
            if tag in ("pre", "listing", "xmp"):
                pre -= 1
                if "".join(page.line).strip():
                    page.put("".join(page.line))
                page.line = []
                while page.lines and not page.lines[-1]:
                    page.lines.pop()
            page.block(1 if tag in SPACED and not (tag in LISTS and len(lists) > 1) else 0)
            if tag in LISTS and lists:
                lists.pop()
            elif tag in ("li", "blockquote", "dd") and len(page.indents) > 1:
                page.indents.pop()
                page.marker = None
    page.flush()
    return "\n".join(page.lines)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id and the text, text_chars and n_lines of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if h is None else render(h) for h in b.column(1).to_pylist()]
            chars = [None if t is None else len(t) for t in texts]
            lines = [None if t is None else t.count("\n") + bool(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(chars, pa.int64()), pa.array(lines, pa.int64())], ["page_id", "text", "text_chars", "n_lines"])

    short_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, text string, text_chars long, n_lines long")
