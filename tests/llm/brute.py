"""Plain versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from html.parser import HTMLParser

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_components(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) from (doc_id, text)."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in index[x]:
                if j < i:
                    common[j] += 1
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(sets[i]), least.get(find(i)), doc == least.get(find(i))) for i, (doc, _) in enumerate(rows)]


def substring_dedup(rows: list[tuple], size: int = 50) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) from (doc_id, text)."""
    first: dict[bytes, int] = {}
    raw = [(d, 2**63 - 1 if d is None else d, (t or "").encode("utf-8", "surrogatepass")) for d, t in rows]
    for _, r, b in raw:
        for i in range(len(b) - size + 1):
            k = b[i : i + size]
            first[k] = min(r, first.get(k, r))
    out = []
    for d, r, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < r:
                gone[i : i + size] = b"\1" * size
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(docs: list[tuple], tests: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans, longest_match, longest_start)."""

    def words(t: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(_LOWER))

    windows = defaultdict(set)
    for item, t in tests:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        ids = ",".join(sorted(str(i) for i in items if i is not None))
        edges = [i for i in range(len(w) + 1) if (i in hit) != (i - 1 in hit)]
        spans = ",".join(f"{a}-{z}" for a, z in zip(edges[::2], edges[1::2], strict=True))
        longest, where = 0, None
        for _, t in tests:
            before = [0] * (len(w) + 1)
            for x in words(t):
                before = [0] + [before[i] + 1 if y == x else 0 for i, y in enumerate(w)]
                best = max(before)
                if best and (best, -(before.index(best) - best)) > (longest, -(where if where is not None else len(w))):
                    longest, where = best, before.index(best) - best
        out.append((d, len(w), len(hit), len({i for i in items if i is not None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), spans, longest, where))
    return out


def removed_units(rows: list[tuple], cut: str, sentences: bool) -> list[tuple]:
    """(doc_id, unit, sentence, start, length, by line or paragraph) of what goes, from (doc_id, text) of unlike doc_ids; null ranks first."""
    seen, gone = [], []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        at = 0
        for k, part in enumerate(re.split(f"({cut})", text or "")):
            if k % 2 == 0:
                inner = [(m.start(), m[0]) for m in re.finditer(r"[.!?]*[^.!?]+[.!?]*", part)] if sentences else []
                for start, t, sentence in [(at, part, False), *[(at + i, t, True) for i, t in inner if len(inner) > 1]]:
                    words = re.findall(r"[^\x20\x09-\x0D]+", t.translate(_LOWER))
                    if words:
                        seen.append((" ".join(words), doc, k // 2, sentence, start, len(t)))
            at += len(part)
    first, line = {}, {}
    order = sorted(seen, key=lambda x: (x[1] is not None, x[1] or 0, x[4], x[3]))
    for x in order:
        first.setdefault(x[0], x)
        if not x[3]:
            line.setdefault(x[0], x)
    out = [x for x in order if first[x[0]] is not x]
    whole = {(x[1], x[2]) for x in out if not x[3]}
    return [(*x[1:], not x[3] and line[x[0]] is not x) for x in out if not x[3] or (x[1], x[2]) not in whole]


class PlainPage(HTMLParser):
    """A second renderer for pages without tables, listings, drawings and style rules: the standard library's parser, events only."""

    BLOCKS = frozenset("article aside blockquote body div footer h1 h2 h3 header li main nav p section ul ol".split())
    APART = frozenset("h1 h2 h3 p ul ol blockquote".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.line, self.gap, self.lists, self.mark, self.quiet, self.open = [], "", 0, [], "", 0, []

    def cut(self, gap: int) -> None:
        text = " ".join(re.split("[ \t\n\f\r]+", self.line)).strip(" ")
        self.line = ""
        if text:
            lead = "  " * len(self.lists and [x for x in self.open if x == "li"])
            self.out += [""] * (self.gap if self.out else 0) + [lead[: len(lead) - len(self.mark)] + self.mark + text]
            self.gap, self.mark = 0, ""
        if self.out and not self.mark:
            self.gap = max(self.gap, gap)

    def close(self) -> str:
        super().close()
        self.cut(0)
        return "\n".join(self.out)

    def space(self, tag: str) -> int:
        return int(tag in self.APART and not (tag in ("ul", "ol") and self.lists))

    def leave(self, tag: str) -> None:
        while self.open and tag in self.open:
            last = self.open.pop()
            if last in ("ul", "ol"):
                self.lists.pop()
            if last in self.BLOCKS:
                self.open.append(last)
                self.cut(self.space(last))
                self.open.pop()
                if last == "li":
                    self.mark = ""
            if last == tag:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "html", "meta", "link"):
            return
        if tag in ("script", "style", "title"):
            self.quiet += 1
            return
        if tag == "br":
            if self.line.strip(" \t\n\f\r"):
                self.cut(0)
            elif self.out:
                self.gap = max(self.gap, 1)
            return
        if tag in self.BLOCKS and "p" in self.open:
            self.leave("p")
        if tag == "li" and "li" in self.open and self.open[::-1].index("li") < min([self.open[::-1].index(x) for x in ("ul", "ol") if x in self.open] or [999]):
            self.leave("li")
        if tag in self.BLOCKS:
            self.cut(self.space(tag))
        if tag in ("ul", "ol"):
            self.lists.append(tag)
        self.open.append(tag)
        if tag == "li":
            self.mark = "- "

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.quiet -= 1
        else:
            self.leave(tag)

    def handle_data(self, data):
        if not self.quiet:
            self.line += data


def visible_text(html: str) -> str:
    page = PlainPage()
    page.feed(html)
    return page.close()
