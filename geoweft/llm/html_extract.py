"""Main text of web pages by wrapper induction.

Pages of a host are aligned with one page of it (the pivot) by simple tree matching of their
block trees. Over all pages of the host it is counted which text each aligned node holds:
nodes that mostly repeat one text are template, the rest are slots of content. A page's main
containers are its main elements and its articles outside them, else its body. Beside articles,
without a main element, slots count that vary among the host's pages. What the markup itself
declares as menu, header, footer, sidebar, notice, advert, form, script, style or reader
comment is left out, and so is template, inside a main container too. Pages of a host with the
same main text count once there, and where template would take over half of a container, its
pages are copies of each other and nothing of it is taken.

Trees are matched exactly, at any size and depth: equal subtrees share a number, so each pair of
different shapes is matched once, and lists of children are aligned row by row in numpy.

Counting is combined before the shuffle. Wrappers are broadcast while they are small; beyond
BROADCAST_BYTES pages meet them by host, in parts of a host, so a host with a third of all pages
costs no more than others. Null and empty pages, and pages without content, have the empty text;
an empty table gives no rows. Pages without a host form one host. A host's only page has no
template, and there class and id words decide alone. Malformed markup (missing end tags, stray
ends) is read as a browser would, roughly. Repeated rows get the same text, null ids a row each.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.textkit import pick, small_batches
from geoweft.plans.lineage import cut

# Element classes of the markup language.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "canvas", "button", "annotation", "annotation-xml"}
#: Of these, an unclosed one takes the rest of the page, as in a browser.
SWALLOW = {"script", "style", "textarea", "title"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "object",
    "math", "semantics", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow", "ms",
    "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover",
}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
BARRIER = {"ul", "ol", "dl", "table", "html", "body", "article", "div", "section", "main"}
# What is not main text, by element, by role and by words of class and id.
DROP_TAGS = {"nav", "aside", "footer", "form", "head", "dialog", "menu", "fieldset"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
DROP_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "dropdown", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "pager", "pagination", "popup", "promo", "promoted", "promotion", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "sidenav",
    "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
#: Whole classes (or ids) that name a menu, comment or advert by themselves. Inside a main container all other words of
#: class and id are hints, which the host's template or the share of links must confirm.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "breadcrumb", "breadcrumbs", "comment", "comments", "disqus", "menu", "nav", "navbar",
    "navigation", "pager", "pagination", "promo", "promoted", "promotion", "replies", "sidebar", "sidenav", "sponsor", "sponsored",
}
#: A node is template if at least so many pages have it and so large a share repeats one text.
MIN_PAGES, SAME_SHARE = 3, 0.6
#: Inside a main container so many pages must repeat the text: a few pages of a small host may share a first line.
SURE_PAGES = 5
#: Share of link text above which a block outside an article is a menu.
LINK_SHARE = 0.6
#: Alignments, and shapes of subtrees, kept per worker; they depend on the block trees only.
KEPT_ALIGNMENTS, KEPT_SHAPES = 2000, 500_000
#: Wrappers are broadcast up to this size in bytes, else joined by host and part.
BROADCAST_BYTES, PARTS = 16 << 20, 32
#: Cells of an alignment's table that are held at a time; larger ones are solved by halves.
TABLE_CELLS = 4_000_000

# A quote opens a value only after an equals sign; elsewhere (title=it's) it is a character like others.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))?+)*+)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
_NAMED = re.compile(r"(?:class|id|role)\s*=", re.I)
_DRAWN = re.compile(r"<text(?=[\s>])[^>]*>(.*?)</text\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")


#: How a class or id names a menu, comment or advert: by a part of it (ad-slot), or as a whole (ad).
PART, WHOLE = 1, 2


def attributes(text: str) -> tuple[set[str], str, str, list[str]]:
    """Words of classes, role, id, and the classes of an element's attributes."""
    words, role, ident, classes = set(), "", "", []
    for name, a, b, c in _ATTR.findall(text):
        name = name.lower()
        if name in ("class", "id", "role"):
            v = unescape(a or b or c).lower()
            if name == "class":
                classes = v.split()
                words.update(re.findall(r"[a-z]+", v))
            elif name == "id":
                ident = v.strip()
            else:
                role = v.strip()
    return words, role, ident, classes


NO_ATTRIBUTES: tuple[frozenset, str, str, list] = (frozenset(), "", "", [])


def mark(names: list[str]) -> int:
    if not MARKS.isdisjoint(names):
        return WHOLE
    ends = {p for n in names for p in (re.split(r"[-_]+", n)[0], re.split(r"[-_]+", n)[-1])}
    return 0 if MARKS.isdisjoint(ends) else PART


class Node:
    """A block element: ``items`` are runs of text (text, linked characters) and blocks, in order."""

    __slots__ = ("tag", "words", "role", "items", "number", "marked")

    def __init__(self, tag, words=frozenset(), role="", marked=0):
        self.tag, self.words, self.role, self.items, self.number, self.marked = tag, words, role, [], -1, marked

    def blocks(self):
        return [x for x in self.items if isinstance(x, Node)]

    def dropped(self, inside_article: bool) -> bool:
        if self.tag in DROP_TAGS or self.role in DROP_ROLES or (self.tag == "header" and not inside_article):
            return True
        if inside_article:
            return self.marked == WHOLE and self.tag not in ("html", "body", "main")
        return self.marked and self.tag not in ("html", "body", "article", "main")

    def hinted(self) -> bool:
        return bool(self.words & DROP_WORDS) and self.tag not in ("html", "body", "article", "main")


def parse(html: str) -> Node:
    """Block tree of a page; inline elements dissolve into the text of their block."""
    root = Node("#root")
    stack: list[tuple[str, Node]] = [("#root", root)]  # open elements, and the block each writes to (none: not shown)
    links, at, n = 0, 0, len(html)
    buf: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if buf:
            text = " ".join("".join(buf).split())
            if text:
                next(x for _, x in reversed(stack) if x is not None).items.append((text, linked))
            buf.clear()
        linked = 0

    def text(s: str):
        nonlocal linked
        if s and stack[-1][1] is not None:
            s = unescape(s) if "&" in s else s
            buf.append(s)
            if links:
                linked += len(s.strip())

    def pop(i: int):
        nonlocal links
        flush()
        for tag, _ in stack[i:]:
            links -= tag == "a"
        del stack[i:]

    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:  # an end tag closes the nearest such element, unless a barrier of another kind lies between
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag in INLINE and all(t in INLINE for t, _ in stack[i:]):
                        links -= tag == "a"
                        del stack[i]
                    else:
                        pop(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            else:
                if tag == "p":
                    flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if not m[3].rstrip().endswith("/"):
                if tag == "svg" and end:
                    for drawn in _DRAWN.findall(html, at, end.start()):
                        text(f" {_TAG.sub('', drawn)} ")
                at = end.end() if end else n if tag in SWALLOW else at
            buf.append(" ")
            continue
        if tag == "br":
            buf.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        words, role, ident, classes = attributes(m[3]) if _NAMED.search(m[3]) else NO_ATTRIBUTES
        if tag in INLINE:
            links += tag == "a"
            shown = role not in DROP_ROLES and not (classes and mark(classes) == WHOLE)
            stack.append((tag, stack[-1][1] if shown else None))
            continue
        # a block starts: it ends an open paragraph and siblings that it implies the end of
        flush()
        again: list[tuple] = []  # inline elements that go on in the new block
        for i in range(len(stack) - 1, 0, -1):
            t = stack[i][0]
            if t == "p" or t in CLOSED_BY.get(tag, ()):
                if t == "p":
                    again = [x for x in stack[i + 1 :] if x[0] in INLINE]
                pop(i)
                if t == "p":
                    continue
            elif t in BARRIER:
                break
        if stack[-1][1] is None:  # inside an inline element that isn't shown
            stack.append((tag, None))
            links += sum(t == "a" for t, _ in again)
            stack.extend(again)
            continue
        if ident and tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):  # ids of headings are anchors
            words = words | set(re.findall(r"[a-z]+", ident))
            classes = [*classes, ident]
        node = Node(tag, frozenset(words), role, mark(classes) if classes else 0)
        stack[-1][1].items.append(node)
        stack.append((tag, node))
        links += sum(t == "a" for t, _ in again)
        stack.extend((t, node if x is not None else None) for t, x in again)
    pop(1)
    number = 0
    todo = [root]
    while todo:  # document order
        x = todo.pop()
        x.number = number
        number += 1
        todo.extend(reversed(x.blocks()))
    return root


def own_text(node: Node) -> str:
    return "\n".join(x[0] for x in node.items if not isinstance(x, Node))


class Shapes:
    """Numbers of block-tree shapes: equal subtrees (tags, class words and children) share one."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.children: list[tuple[int, ...]] = []
        self.label: list[tuple] = []
        self.size: list[int] = []

    def of(self, root: Node) -> int:
        done: dict[int, int] = {}
        order, todo = [], [root]
        while todo:
            x = todo.pop()
            order.append(x)
            todo.extend(x.blocks())
        for x in reversed(order):  # children before parents
            label, children = (x.tag, x.words), tuple(done[id(c)] for c in x.blocks())
            key = (label, children)
            if key not in self.number:
                self.number[key] = len(self.label)
                self.label.append(label)
                self.children.append(children)
                self.size.append(1 + sum(self.size[c] for c in children))
            done[id(x)] = self.number[key]
        return done[id(root)]


def align_rows(weight: np.ndarray, ix: np.ndarray, iy: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j), rising in both, of the largest total ``weight[ix[i], iy[j]]``; of pairs above 0.

    Rows of the table are array operations; a table beyond TABLE_CELLS is solved by halves.
    """
    m, n = len(ix), len(iy)
    if not m or not n:
        return []

    def last_row(ix, iy):
        row = np.zeros(len(iy) + 1, np.int64)
        for i in ix:
            best = np.maximum(row[1:], row[:-1] + weight[i, iy])
            row[1:] = np.maximum.accumulate(best)
        return row

    if m > 1 and m * n > TABLE_CELLS:
        half = m // 2
        k = int(np.argmax(last_row(ix[:half], iy) + last_row(ix[half:][::-1], iy[::-1])[::-1]))
        return align_rows(weight, ix[:half], iy[:k]) + [(i + half, j + k) for i, j in align_rows(weight, ix[half:], iy[k:])]
    table = np.zeros((m + 1, n + 1), np.int64)
    for i in range(m):
        best = np.maximum(table[i, 1:], table[i, :-1] + weight[ix[i], iy])
        table[i + 1, 1:] = np.maximum.accumulate(best)
    pairs, i, j = [], m, n
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


class Matcher:
    """Simple tree matching of shapes: the largest order-keeping top-down match."""

    def __init__(self, shapes: Shapes):
        self.shapes = shapes
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def _sides(self, a: int, b: int) -> tuple[int, int, tuple, tuple]:
        """Numbers of equal first and last children, which match best with each other, and what lies between."""
        x, y = self.shapes.children[a], self.shapes.children[b]
        most, head = min(len(x), len(y)), 0
        while head < most and x[head] == y[head]:
            head += 1
        tail = 0
        while tail < most - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        return head, tail, x[head : len(x) - tail], y[head : len(y) - tail]

    def match(self, a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        """Size of the match, and the pairs of matched children of the roots."""
        s, todo = self.shapes, [(a, b)]
        while todo:
            p, q = todo[-1]
            if (p, q) in self.known:
                todo.pop()
                continue
            if p == q or s.label[p] != s.label[q]:
                every = range(len(s.children[p]))
                self.known[p, q] = (s.size[p], list(zip(every, every, strict=True))) if p == q else (0, [])
                continue
            head, tail, x, y = self._sides(p, q)
            ux, uy = sorted(set(x)), sorted(set(y))
            missing = [(i, j) for i in ux for j in uy if (i, j) not in self.known]
            if missing:
                todo += missing
                continue
            pairs = [(i, i) for i in range(head)]
            total = 1 + sum(s.size[c] for c in s.children[p][:head])
            if x and y:
                weight = np.array([[self.known[i, j][0] for j in uy] for i in ux], np.int64)
                px, py = {c: k for k, c in enumerate(ux)}, {c: k for k, c in enumerate(uy)}
                ix, iy = np.array([px[c] for c in x]), np.array([py[c] for c in y])
                found = align_rows(weight, ix, iy)
                total += sum(int(weight[ix[i], iy[j]]) for i, j in found)
                pairs += [(i + head, j + head) for i, j in found]
            for k in range(tail, 0, -1):
                pairs.append((len(s.children[p]) - k, len(s.children[q]) - k))
                total += s.size[s.children[p][-k]]
            self.known[p, q] = (total, pairs)
        return self.known[a, b]


class Aligner:
    """Numbers of pivot nodes for a page's nodes; repeated tree shapes are matched once."""

    def __init__(self):
        self._forget()

    def _forget(self):
        self.matcher = Matcher(Shapes())
        self.pivots: OrderedDict[str, tuple] = OrderedDict()
        self.kept: OrderedDict[tuple, dict[int, int]] = OrderedDict()

    def pivot(self, html: str):
        key = xxhash.xxh3_128_hexdigest(html)
        if key not in self.pivots:
            if len(self.pivots) > 500:
                self.pivots.popitem(last=False)
            tree = parse(html)
            self.pivots[key] = (key, tree, self.matcher.shapes.of(tree))
        return self.pivots[key]

    def align(self, tree: Node, pivot_html: str) -> dict[int, int]:
        if max(len(self.matcher.known), len(self.matcher.shapes.label)) > KEPT_SHAPES:
            self._forget()
        key, other, shape = self.pivot(pivot_html)
        own = self.matcher.shapes.of(tree)
        at = (key, own)
        if at in self.kept:
            self.kept.move_to_end(at)
            return self.kept[at]
        out, shapes = {0: 0}, self.matcher.shapes
        todo = [(tree, other, own, shape)]
        while todo:
            a, b, sa, sb = todo.pop()
            x, y = a.blocks(), b.blocks()
            for i, j in self.matcher.match(sa, sb)[1]:
                out[x[i].number] = y[j].number
                todo.append((x[i], y[j], shapes.children[sa][i], shapes.children[sb][j]))
        if len(self.kept) > KEPT_ALIGNMENTS:
            self.kept.popitem(last=False)
        self.kept[at] = out
        return out


def _size(node: Node, inside: bool, without: frozenset | set = frozenset()) -> int:
    """Characters of the node that the markup doesn't leave out, without those of some nodes' own."""
    total, todo = 0, [node]
    while todo:
        y = todo.pop()
        for x in y.items:
            if isinstance(x, Node):
                if not x.dropped(inside):
                    todo.append(x)
            elif y.number not in without:
                total += len(x[0])
    return total


def containers(root: Node) -> tuple[list[Node], bool]:
    """Outermost main elements and articles with text, in page order; and whether one is a main element. Articles that the
    markup names as comment or advert only count if there is none else, and then the largest."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.tag in ("article", "main") or x.role == "main":
            found.append(x)
        elif not x.dropped(False):
            todo.extend(reversed(x.blocks()))
    sizes = [_size(x, True) for x in found]
    tops = [x for x, n in zip(found, sizes, strict=True) if n and not (x.tag == "article" and x.marked == WHOLE)]
    if not tops and any(sizes):
        tops = [found[sizes.index(max(sizes))]]
    return tops, any(x.tag == "main" or x.role == "main" for x in tops)


def extract(root: Node, template: set[int], alignment: dict[int, int], sure: frozenset | set = frozenset(), varying: frozenset | set = frozenset()) -> str:
    """Blocks of the main containers, and varying slots beside articles, without what the markup or the host's template leaves out."""
    tops, main = containers(root)
    mine = {x.number for x in tops}
    out: list[str] = []
    repeated, constants = ({k for k, v in alignment.items() if v in kind} for kind in (template, sure))
    if tops and 2 * sum(_size(x, True, constants) for x in tops) < sum(_size(x, True) for x in tops):
        constants = set()

    def confirmed(node: Node) -> bool:
        """Whether most of a hinted node is links or template."""
        total = against = 0
        todo = [node]
        while todo:
            y = todo.pop()
            todo.extend(y.blocks())
            for x in y.items:
                if not isinstance(x, Node):
                    total += len(x[0])
                    against += len(x[0]) if y.number in repeated else x[1]
        return against > LINK_SHARE * total

    alone = not template and not varying  # no wrapper to confirm a hint, outside the main containers
    todo: list[tuple] = [(root, False, False)]
    while todo:
        x, inside, taken = todo.pop()
        if not isinstance(x, Node):
            if taken and (inside or x[1] <= LINK_SHARE * len(x[0])):
                out.append(x[0])
            continue
        if x.number not in mine and (x.dropped(inside) or (x.hinted() and ((alone and not inside) or confirmed(x)))):
            continue
        inside = inside or x.number in mine
        taken = x.number not in (constants if inside else repeated) and (inside or not tops or (not main and alignment.get(x.number, -1) in varying))
        todo.extend((y, inside, taken) for y in reversed(x.items))
    return "\n\n".join(out)


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return pages.select("page_id", "url", "html", host.alias("host"))


def meet(pages: DataFrame, by_host: DataFrame, how: str = "inner") -> DataFrame:
    """Pages with their host's row: broadcast while that is small, else joined by host and part, so that a hot host is split."""
    total = by_host.agg(F.coalesce(F.sum(F.octet_length("pivot")), F.lit(0)) + 64 * F.count("*")).first()[0]
    if total <= BROADCAST_BYTES:
        return pages.join(F.broadcast(by_host), "host", how)
    parts = by_host.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return pages.withColumn("_part", F.pmod(F.xxhash64("url", "html"), F.lit(PARTS)).cast("int")).join(parts, ["host", "_part"], how).drop("_part")


def induce(pages: DataFrame) -> DataFrame:
    """(host, pivot, template, sure, varying): the pivot page of each host, and the numbers of its template nodes, of those that hold inside main containers too, and of its slots."""
    one = pages.where("html is not null").groupBy("host").agg(F.min_by("html", F.xxhash64("html")).alias("pivot"))
    pivots = cut(one)

    def observe(batches):
        al = Aligner()
        for batch in batches:
            hosts, nodes, texts, mains = [], [], [], []
            for host, html, pivot in zip(*[pick(batch, c).to_pylist() for c in ("host", "html", "pivot")], strict=True):
                tree = parse(html)
                to, todo = al.align(tree, pivot), [tree]
                main = xxhash.xxh3_64_intdigest(extract(tree, set(), {})) - (1 << 63)
                while todo:
                    x = todo.pop()
                    todo.extend(x.blocks())
                    t = own_text(x)
                    if t and x.number in to:
                        hosts.append(host)
                        nodes.append(to[x.number])
                        texts.append(xxhash.xxh3_64_intdigest(t) - (1 << 63))
                        mains.append(main)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(nodes, pa.int32()), pa.array(texts, pa.int64()), pa.array(mains, pa.int64())], ["host", "node", "text", "main"])

    distinct = small_batches(meet(pages.where("html is not null"), pivots).select("host", "html", "pivot"))
    seen = distinct.mapInArrow(observe, "host string, node int, text long, main long").distinct().groupBy("host", "node", "text").agg(F.count("*").alias("c"))
    seen = seen.groupBy("host", "node").agg(F.sum("c").alias("pages"), F.max("c").alias("same"))
    seen = seen.where(F.col("pages") >= MIN_PAGES).withColumn("fixed", F.col("same") >= SAME_SHARE * F.col("pages"))
    nodes = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("node"))))
    kinds = {"template": F.col("fixed"), "sure": F.col("fixed") & (F.col("same") >= SURE_PAGES), "varying": ~F.col("fixed")}
    found = seen.groupBy("host").agg(*[nodes(c).alias(k) for k, c in kinds.items()])  # at most the pivot's nodes
    none = F.array().cast("array<int>")
    return pivots.join(found, "host", "left").select("host", "pivot", *[F.coalesce(k, none).alias(k) for k in kinds])


RESULT = "page_id long, url string, text string, n_chars long"


def main_text(pages: DataFrame) -> DataFrame:
    """Rows RESULT for every page."""
    pages = with_host(pages)
    wrappers = cut(induce(pages))

    def run(batches):
        al = Aligner()
        for batch in batches:
            texts = []
            for html, pivot, template, sure, varying in zip(*[pick(batch, c).to_pylist() for c in ("html", "pivot", "template", "sure", "varying")], strict=True):
                if not html:
                    texts.append("")
                    continue
                tree = parse(html)
                texts.append(extract(tree, set(template or ()), al.align(tree, pivot) if pivot else {}, set(sure or ()), set(varying or ())))
            yield pa.RecordBatch.from_arrays([pick(batch, "page_id").cast(pa.int64()), pick(batch, "url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    met = meet(pages, wrappers, "left").select("page_id", "url", "html", "pivot", "template", "sure", "varying")
    return small_batches(met).mapInArrow(run, RESULT)
