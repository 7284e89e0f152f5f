"""Main text of web pages by wrappers: union-free regular expressions over tags, inferred per host."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|iframe)\b[^<>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*+)(?P<attrs>(?:"[^"]*+"|'[^']*+'|[^'"<>])*+)>|<[!?][^<>]*+>""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
#: HTML's elements without content, its blocks, elements that hold no main text, and class names that say
#: so inside the main element (what alignment cannot tell: their texts differ from page to page).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - set("body html li dd dt td th tr tbody thead tfoot caption summary legend".split())
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NO_TEXT = set("head title nav header footer aside form button select option dialog menu object audio video canvas map".split())
NO_TEXT_NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login menu modal "
    "nav navbar navigation newsletter notice notices pagination popup promo promotion related reply replies share sharing sidebar signup social sponsor sponsored "
    "sponsors subscribe subscription toolbar widget".split()
)
MAIN = ("article", "main")
#: An element is the host's own if its text is the same on so many pages that have it.
LEAST_PAGES = 3


class Node:
    """An element: its key (tag and class names), children (nodes and texts), and whether its tag and names allow main text."""

    __slots__ = ("allowed", "children", "key", "named", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        names = [n for m in ATTRIBUTE.finditer(attrs) for n in (m[2] or m[3] or m[4] or "").lower().split()] if attrs else []
        self.tag = tag
        self.key = ".".join([tag, *sorted({re.sub("[0-9]+", "", n) for n in names})])
        self.allowed = tag not in NO_TEXT
        self.named = tag not in MAIN and any(part in NO_TEXT_NAMES for n in names for part in re.split("[-_]+", n))
        self.children: list[Node | str] = []


def parse(page: object) -> Node:
    """The tree of a page. Unclosed paragraphs and items end where the next one starts; stray end tags are skipped."""
    root = Node("#")
    stack = [root]
    page = page if isinstance(page, str) else ""
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in ("article", "main", "body", "td", "section") and tag in ("p", "b", "i", "span", "a", "em", "strong", "li"):
                    break
            continue
        if tag in CLOSES_P or tag in ITEMS:
            stop = ITEMS.get(tag, set())
            for depth in range(len(stack) - 1, 0, -1):
                name = stack[depth].tag
                if (tag in CLOSES_P and name == "p") or (tag in ITEMS and name in ({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag})):
                    del stack[depth:]
                    break
                if name in stop or (name in BLOCKS and name != "p"):
                    break
        node = Node(tag, m["attrs"])
        stack[-1].children.append(node)
        if tag not in VOID and not m["attrs"].endswith("/"):
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def squash(keys: list[str]) -> list[tuple[str, ...]]:
    """Repeated neighbours become one group: a a b c b c -> (a) (b c)."""
    out: list[tuple[str, ...]] = [(k,) for k in keys]
    for size in (1, 2, 3):
        i, kept = 0, []
        while i < len(out):
            group = tuple(out[i : i + size])
            j = i + size
            while len(group) == size and tuple(out[j : j + size]) == group:
                j += size
            if j > i + size or size == 1:
                kept.append(tuple(k for g in group for k in g))
                i = j
            else:
                kept.append(out[i])
                i += 1
        out = kept
    return out


class Ids(dict):
    """A number for each element of a host: a hash of its parent's and its key, the same in every task."""

    def __missing__(self, at: tuple[int, str]) -> int:
        found = self[at] = int.from_bytes(hashlib.blake2b(f"{at[0]} {at[1]}".encode(), digest_size=8).digest(), "big")
        return found


def template(root: Node) -> dict[int, list]:
    """The wrapper of one page: parent, key, pages, characters of own text, hash of that text (null for a slot), order, and if it is allowed and named, by element.

    order has the groups of children's keys, each with 1 if it is optional. Elements of one place with one key are
    one element, repeated.
    """
    ids, out = Ids(), {}
    stack = [(root, 0)]
    while stack:
        node, parent = stack.pop()
        own = ids[parent, node.key]
        kids = [c for c in node.children if isinstance(c, Node)]
        text = " ".join(" ".join(c.split()) for c in node.children if isinstance(c, str)).strip()
        mark = hashlib.blake2b(text.encode(errors="replace"), digest_size=8).hexdigest()
        record = [parent, node.key, 1, len(text), mark, [[list(g), 0] for g in squash([c.key for c in kids])], int(node.allowed), int(node.named)]
        out[own] = align(out[own], record, 0) if own in out else record
        stack.extend((c, own) for c in kids)
    return out


def align(a: list, b: list, pages: int) -> list:
    """Aligns two records of an element. Groups in both stay; a mismatch makes a group optional; texts that differ become a slot."""
    left, right = [g for g, _ in a[5]], [g for g, _ in b[5]]
    rows = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    if left != right:
        for i in range(len(left) - 1, -1, -1):
            for j in range(len(right) - 1, -1, -1):
                rows[i][j] = rows[i + 1][j + 1] + 1 if left[i] == right[j] else max(rows[i + 1][j], rows[i][j + 1])
    order, i, j = [], 0, 0
    while i < len(left) or j < len(right):
        if i < len(left) and j < len(right) and left[i] == right[j]:
            order.append([left[i], a[5][i][1] | b[5][j][1]])
            i, j = i + 1, j + 1
        elif j == len(right) or (i < len(left) and rows[i + 1][j] >= rows[i][j + 1]):
            order.append([left[i], 1])
            i += 1
        else:
            order.append([right[j], 1])
            j += 1
    seen, unique = set(), []
    for group, optional in order:
        if tuple(group) not in seen:
            seen.add(tuple(group))
            unique.append([group, optional])
    return [a[0], a[1], a[2] + pages * b[2], a[3] + b[3], a[4] if a[4] == b[4] else None, unique, a[6], a[7]]


def merge(a: dict[int, list], b: dict[int, list]) -> dict[int, list]:
    """One wrapper of two wrappers of several pages."""
    out = dict(a)
    for own, record in b.items():
        out[own] = align(out[own], record, 1) if own in out else record
    return out


class Wrapper:
    """What a host's wrapper says: where the main text is, which elements are the host's own, and which names to heed."""

    def __init__(self, records: dict[int, list]) -> None:
        self.records = records
        self.kids: dict[int, list[int]] = {}
        for own, record in records.items():
            self.kids.setdefault(record[0], []).append(own)
        order, stack = [], [0]
        while stack:
            own = stack.pop()
            order.append(own)
            stack.extend(self.kids.get(own, []))
        self.slots, self.texts = dict.fromkeys(order, 0), dict.fromkeys(order, 0)
        for own in reversed(order[1:]):
            parent, _, pages, chars, mark, _, allowed, _ = records[own]
            self.slots[own] += 0 if mark is not None and pages >= LEAST_PAGES else chars
            self.texts[own] += chars
            if allowed:
                self.slots[parent] += self.slots[own]
                self.texts[parent] += self.texts[own]
        self.mass = self.slots if self.slots[0] else self.texts
        self.inside = {own for own in order[1:] if records[own][1].split(".")[0] in MAIN}
        for own in reversed(order[1:]):
            if own in self.inside:
                self.inside.add(records[own][0])

    def heeded(self, own: int) -> bool:
        """Whether an element's names count: not if it has an article or main, or most of the page's text, inside."""
        return bool(self.records[own][7]) and own not in self.inside and 2 * self.mass[own] <= self.mass[0]

    def path(self) -> list[int]:
        """Elements that lead to the one with the main text: the largest article or main, else as deep as most text goes."""
        best, stack = 0, [0]
        while stack:
            own = stack.pop()
            for kid in self.kids.get(own, []):
                if self.records[kid][6] and not self.heeded(kid):
                    if self.records[kid][1].split(".")[0] in MAIN and (not best or self.mass[kid] > self.mass[best]):
                        best = kid
                    stack.append(kid)
        if best and self.mass[best]:
            found = [best]
            while self.records[found[0]][0]:
                found.insert(0, self.records[found[0]][0])
            return found
        found, own = [], 0
        while self.kids.get(own):
            open_ = [k for k in self.kids[own] if self.records[k][6] and not self.heeded(k)]
            kid = max(open_, key=lambda k: (self.mass[k], self.records[k][1]), default=0)
            stop = not kid or self.records[kid][1].split(".")[0] in ("p", "ul", "ol", "table", "pre", "blockquote")
            if stop or self.mass[kid] < 0.8 * self.mass[own]:
                break
            found.append(kid)
            own = kid
        return found

    def dropped(self, at: list[int]) -> list[int]:
        """Elements below the main one that hold no main text: those of the host itself, and by their names."""
        out, stack = [], list(self.kids.get(at[-1] if at else 0, []))
        while stack:
            own = stack.pop()
            parent, key, pages, _, _, _, _, _ = self.records[own]
            fixed = self.texts[own] > 0 and self.slots[own] == 0 and self.slots[0] > 0 and pages >= LEAST_PAGES and key.split(".")[0] in BLOCKS
            if fixed or self.heeded(own):
                out.append(own)
            else:
                stack.extend(self.kids.get(own, []))
        return out


def main_text(root: Node, path: list[int], dropped: set[int]) -> str:
    """The blocks of the elements at the path; of the page's own article, main or body where it has none."""
    ids = Ids()
    top = ids[0, root.key]
    found = [(root, top)]
    for own in path[1:]:
        found = [(c, own) for n, at in found for c in n.children if isinstance(c, Node) and ids[at, c.key] == own]
    if not found or len(path) < 2:
        every = [(root, top)]
        for tags in (MAIN, ("body",)):
            if found := [*tagged(root, tags, ids, dropped)]:
                break
        found = found or every
    blocks, open_ = [], []

    def close() -> None:
        if line := " ".join(html.unescape("".join(open_)).split()):
            blocks.append(line)
        open_.clear()

    stack: list = [(c, at) for n, at in reversed(found) for c in (None, *reversed(n.children), None)]
    while stack:
        c, at = stack.pop()
        if c is None:
            close()
        elif isinstance(c, str):
            open_.append(c)
        elif c.tag == "br":
            open_.append(" ")
        elif not c.allowed or (own := ids[at, c.key]) in dropped:
            if c.tag in BLOCKS:
                close()
        elif c.tag in BLOCKS:
            close()
            stack.append((None, own))
            stack.extend((x, own) for x in reversed(c.children))
        else:
            stack.extend((x, own) for x in reversed(c.children))
    close()
    return "\n".join(blocks)


def tagged(root: Node, tags: tuple[str, ...], ids: Ids, dropped: set[int]) -> Iterator[tuple[Node, int]]:
    """Outermost elements with one of the tags that can hold main text."""
    stack = [(root, ids[0, root.key])]
    while stack:
        node, own = stack.pop()
        if node.tag in tags and node.allowed:
            yield node, own
        elif node.allowed and own not in dropped:
            stack.extend((c, ids[own, c.key]) for c in reversed(node.children) if isinstance(c, Node))


def host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _fold(rows: Iterator[tuple[str, dict]]) -> dict[str, dict]:
    """One wrapper for each host. A wrapper that is there already costs a merge and no room."""
    out: dict[str, dict] = {}
    for name, wrapper in rows:
        out[name] = merge(out[name], wrapper) if name in out else wrapper
    return out


def _load(text: str) -> dict[int, list]:
    return {int(k): v for k, v in json.loads(text).items()}


def _infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pages = ((name, template(parse(page))) for batch in batches for name, page in zip(batch["_host"], batch["_html"], strict=True))
    found = _fold(pages)
    salt = TaskContext.get().partitionId() % 64
    if found:
        yield pd.DataFrame({"_host": list(found), "_salt": salt, "_wrapper": [json.dumps(w) for w in found.values()]})


def _combine(batch: pd.DataFrame) -> pd.DataFrame:
    found = _fold((h, _load(w)) for h, w in zip(batch["_host"], batch["_wrapper"], strict=True))
    paths = {h: (w := Wrapper(x), w.path()) for h, x in found.items()}
    return pd.DataFrame({
        "_host": list(found), "_wrapper": [json.dumps(w) for w in found.values()],
        "_path": [json.dumps(p) for _, p in paths.values()], "_dropped": [json.dumps(w.dropped(p)) for w, p in paths.values()],
    })


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """_host, _wrapper, _path, _dropped (JSON): one union-free expression for each host, and what it says of the main text.

    Pages of one host are aligned one after the other; a mismatch of tags makes the groups in question optional,
    repeated neighbours are one group, and texts that differ are slots. Texts that are the same on all pages that have
    them are the host's own. Each task folds its pages, then 64 parts of each host, then these are merged, so a hot
    host is no task's alone. A wrapper's size is bounded by the host's distinct elements, not its pages.
    """
    kinds = "_host string, _wrapper string, _path string, _dropped string"
    parts = pages.select(host(url).alias("_host"), F.col(page).alias("_html")).mapInPandas(_infer, "_host string, _salt int, _wrapper string")
    half = parts.groupBy("_host", "_salt").applyInPandas(_combine, kinds).select("_host", "_wrapper")
    return half.groupBy("_host").applyInPandas(_combine, kinds)


def extract(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """Adds `out`, the main text, to the rows of pages; a column of that name is replaced, all other names may be used.

    The text is what the host's wrapper has in the element that holds most of its slots: elements that are the same on
    all pages go with the template. Inside it, tags such as nav, aside, form and script hold no text, nor do elements
    whose names say so (unless most of the page, an article or main is in them). White space inside a block is one
    space. Nesting of any depth is walked without recursion. A null url is a host of its own; a null or empty page
    has no text; repeated rows are pages of their own; an empty table gives an empty result.
    """
    found = shared.save(infer_wrappers(pages, url, page).select("_host", "_path", "_dropped"), "wrappers")
    kept = [c for c in pages.columns if c != out]
    given = pages.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)), F.col(page).alias("_html"), host(url).alias("_host"))
    named = given.join(shared.small(found), "_host", "left").drop("_host")

    def texts() -> Callable[[pd.DataFrame], Iterator[tuple[pd.DataFrame, None]]]:
        loaded: dict[tuple, tuple] = {}

        def work(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, None]]:
            lines = []
            for html_, *says in zip(batch["_html"], batch["_path"], batch["_dropped"], strict=True):
                says = tuple(says)
                if says not in loaded:
                    loaded.clear() if len(loaded) > 1000 else None
                    loaded[says] = (json.loads(says[0] or "[]"), set(json.loads(says[1] or "[]")))
                lines.append(main_text(parse(html_), *loaded[says]))
            yield pd.DataFrame({"_text": pd.Series(lines, dtype=object)}), None

        return work

    return shared.beside(named, [f"_c{i}" for i in range(len(kept))], "_text string", texts).toDF(*kept, out)
