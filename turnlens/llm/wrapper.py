"""HTML extraction by wrapper induction.

Pages of one host come from one template. The tree of each page is aligned with
reference trees of its host, of several shapes, by simple tree matching: equal
signs (tag and classes) on the way from the main part down, and of the children
of a matched pair as large a sequence in order as there is. Equal trees are numbered
alike, so a pair of trees is compared once however often it occurs, and equal ones at
either end of two lists are matched at once; what is left is aligned row by row in
linear space, so pages of every size are aligned. Each page votes for
the text of the nodes that are matched with a node of a reference. Nodes that no
reference has would have no vote, so pages also vote for path and text of each of
their nodes, which compares every page with every other one. A node whose text
stays the same belongs to the template; slots whose text varies hold content. The
wrapper of a host is the set of its constant nodes; extraction takes the main part
of a page without them and without what its markup declares to be a menu, header,
footer, form, advert, notice or comment.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm import kernel
from turnlens.llm.durable import checkpointed, small

#: More pages of a host than this must agree on a node before it is taken for template.
SUPPORT = 4
#: Percent of the pages with a path that must agree on a node there.
SHARE = 90
#: Reference trees of a host, each of another group of shapes.
REFERENCES = 3
#: Wrappers are broadcast up to this many constant nodes, and references of up to this many hosts, else joined by a shuffle.
FEW = 50_000
FEW_HOSTS = 2_000
#: Paths longer than this are replaced by a hash.
LONG_PATH = 512

#: What elements mean is a fixed value of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
HIDDEN = {
    "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "head", "title", "button", "select", "textarea",
    "svg", "object", "canvas", "dialog", "menu", "audio", "video", "noembed", "noframes", "xmp", "datalist", "option",
}
#: A start tag closes an open element of these names first.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
#: These end an open paragraph.
BLOCKS = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
}
#: A list item, cell or row does not reach out of these.
FENCES = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body"}
#: Words in class, id or role that declare an element not to be part of the text.
NOISE = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup popup modal overlay sidebar comment comments commentlist disqus reply replies share sharing social "
    "related recommend recommended recommendations teaser breadcrumb breadcrumbs menu nav navbar navigation footer header masthead toolbar widget "
    "pagination pager contentinfo complementary search dialog paywall login hidden".split()
)
MAIN_WORDS = {"article", "main", "content", "post", "entry", "story"}
#: Words that say where or what kind of part a compound name means: with these alone a word above keeps its meaning.
PARTS = set(
    "site page main top bottom left right upper lower list lists box bar bars block container wrapper wrap section area inner outer item items link links "
    "button buttons btn slot unit space holder panel global primary secondary tertiary mobile desktop sticky fixed floating post posts article articles "
    "entry story news body content text title form icon icons row col column group zone region module component js the this to us in up".split()
)
#: Words that make of a compound name a state or kind of layout.
STATES = set("has no not with without is open closed enabled disabled layout free hoc".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_START = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_NAMED = re.compile(r"[^\s/>]+")
#: What stands between a tag's name and its end; nothing is tried twice, so malformed tags take no longer than others.
_REST = re.compile(r"""(?>[^>"']+|"[^"]*"|'[^']*'|["'])*+(?=>)""")
_ATTRIBUTE = re.compile(r"""(?<![^\s=/"'>])([^\s=/"'>]++)\s*+=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
#: Between a path and a reference's place in the name of a slot.
_SLOT = "\x1f"
_DIGIT = re.compile(r"\d").search
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _noise_words(name: str) -> set[str]:
    """The words by which one class, id or role declares a part not to be text: it is such a word, or made of such words, places and numbers only.

    A name that tells a state or layout (has-sidebar, comments-open) or means
    something else (market-share, ad-hoc) declares nothing.
    """
    words = {w.lower() for w in _NAME.findall(name)}
    return words & NOISE if not words & STATES and words <= NOISE | PARTS else set()


class Node:
    """An element: tag, sorted class words, whether it is hidden or holds an article, its declared words, those that declare noise, and texts and elements in order."""

    __slots__ = ("tag", "names", "hidden", "holds", "words", "noise", "items")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.items, self.hidden, self.holds, self.names, self.words, self.noise = tag, [], False, False, "", frozenset(), frozenset()
        if attributes and not attributes.isspace():
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            named = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}"
            if named.strip():
                self.names = " ".join(sorted(html.unescape(found.get("class", "")).split()))
                self.words = frozenset(w.lower() for w in _NAME.findall(named))
                if self.words & NOISE:
                    self.noise = frozenset().union(*map(_noise_words, named.split()))
            style = found.get("style", "").replace(" ", "").lower()
            self.hidden = "display:none" in style or "visibility:hidden" in style or found.get("aria-hidden", "").lower() == "true"
            self.hidden |= bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)", attributes))

    @property
    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def parse(page: str) -> Node:
    """The element tree of a page; markup errors are mended as browsers mend the common ones. Inline elements only add their text."""
    root = Node("html")
    stack, at, n = [root], 0, len(page)
    opened: Counter[str] = Counter()

    def close(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]

    def end_of(mark: str, start: int) -> tuple[int, int]:
        """Where a mark begins and ends, the end of the page if it is absent."""
        i = page.find(mark, start)
        return (n, n) if i < 0 else (i, i + len(mark))

    quoted = main = False
    while at < n:
        m = _START.search(page, at)
        start = m.start() if m else n
        if start > at:
            stack[-1].items.append(page[at:start])
        if m is None:
            break
        if m[0] == "<!--":
            at = end_of("-->", start + 4)[1]
        elif m[0] == "<![CDATA[":
            i, at = end_of("]]>", start + 9)
            stack[-1].items.append(page[start + 9 : i])
        elif m[0] in ("<!", "<?"):
            at = end_of(">", start)[1]
        elif m[0].startswith("</"):
            tag = _NAMED.match(page, start + 2)[0].lower()
            at = end_of(">", start)[1]
            if tag == "p" and not opened["p"]:
                stack[-1].items.append(Node("br"))
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i].tag in BLOCKS:
                    break
        else:
            name = _NAMED.match(page, start + 1)
            tag = name[0].lower()
            rest = None if quoted else _REST.match(page, name.end())
            # after a tag whose quotes hide the end of the page, quotes mean nothing
            quoted |= rest is None
            i = rest.end() if rest else page.find(">", name.end())
            if i < 0:
                stack[-1].items.append(page[start:])
                break
            attributes, at = page[name.end() : i], i + 1
            if tag in ("html", "body") and stack[0].tag == "html":
                if tag == "body":
                    close(1)
                continue
            if tag in BLOCKS and opened["p"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in BLOCKS:
                        break
            for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in CLOSES.get(tag, ())) else ():
                if stack[i].tag in CLOSES[tag]:
                    close(i)
                    break
                if stack[i].tag in FENCES:
                    break
            node = Node(tag, attributes)
            main |= tag in ("article", "main")
            if tag in INLINE and not node.hidden and not node.noise:
                continue
            stack[-1].items.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
            elif tag not in VOID and not attributes.endswith("/") or tag in BLOCKS:
                if tag not in VOID:
                    stack.append(node)
                    opened[tag] += 1
    if main:
        _find_main(root)
    return root


def _find_main(root: Node) -> None:
    """Tell each element whether an article or main element is inside it."""
    found = [(root, None)]
    for node, _ in found:
        found += [(x, node) for x in node.children]
    for node, above in reversed(found):
        if above is not None and (node.holds or node.tag in ("article", "main")):
            above.holds = True


def _noise(node: Node, in_article: bool) -> bool:
    """Whether the markup declares an element not to be part of the text."""
    if node.hidden or node.tag in HIDDEN:
        return True
    if node.tag == "header" and not in_article:
        return True
    if not node.noise or node.tag in ("html", "body", "main"):
        return False
    if in_article and node.noise <= {"header", "banner"} and any(c.tag in ("h1", "h2") for c in node.children):
        return False
    return not node.holds


def _texts(node: Node, constant: set[tuple[str, int]], path: str, out: list[str], in_article: bool) -> None:
    """Append the text of a subtree, blocks set apart by a space."""
    stack = [iter(_walk(node, path))]
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            out.append(" ")
        elif isinstance(step, str):
            out.append(step)
        else:
            child, below = step
            out.append(" ")
            # a heading that many articles have is still part of each
            stays = not constant or in_article and child.tag in HEADINGS or (below, _hash(child)) not in constant
            if stays and not _noise(child, in_article):
                stack.append(iter(_walk(child, below)))


def _walk(node: Node, path: str) -> Iterator[str | tuple[Node, str]]:
    for x in node.items:
        yield html.unescape(x) if isinstance(x, str) else (x, _below(path, _sign(x)))


def _sign(node: Node) -> str:
    """Tag and class words; those with a digit, which often number single pages, are left out."""
    names = " ".join(w for w in node.names.split() if not _DIGIT(w)) if node.names else ""
    return f"{node.tag}.{names}" if names else node.tag


def _below(path: str, sign: str) -> str:
    """The path of a child; a deep one is hashed, so that it takes as little as any other."""
    whole = f"{path}/{sign}"
    return whole if len(whole) <= LONG_PATH else hashlib.blake2b(whole.encode(errors="replace"), digest_size=16).hexdigest()


def _hash(node: Node) -> int:
    """A hash of the text an element itself holds, 0 if it has none."""
    own = " ".join("".join(x if isinstance(x, str) else " " for x in node.items).split())
    return crc32(own.encode()) if own else 0


def _sizes(root: Node) -> dict[int, int]:
    """How many characters but white space the text of each element has, were it the article; by identity, in one pass from below."""
    order = [root]
    for node in order:
        order += node.children
    size: dict[int, int] = {}
    for node in reversed(order):
        own = sum(len("".join(html.unescape(x).split())) for x in node.items if isinstance(x, str))
        size[id(node)] = own + sum(size[id(c)] for c in node.children if not _noise(c, True))
    return size


def main_part(root: Node) -> tuple[Node, bool]:
    """The element that holds the article, and whether it is marked as such."""
    found: list[Node] = []
    mains: list[Node] = []
    named: list[Node] = []
    left = [root]
    while left:
        node = left.pop()
        for x in reversed(node.children):
            if _noise(x, False):
                continue
            if x.tag == "article":
                found.append(x)
                continue
            if x.tag == "main" or "main" in x.words and x.tag in ("div", "section"):
                mains.append(x)
            elif x.words & MAIN_WORDS and x.tag in ("div", "section", "td"):
                named.append(x)
            left.append(x)
    for group in (found, mains, named):
        if group:
            size = _sizes(root) if len(group) > 1 else {}
            return max(group, key=lambda g: size.get(id(g), 0)), True
    return root, False


def extract(page: str | None, constant: set[tuple[str, int]] | frozenset = frozenset()) -> str:
    """The main text of a page without the constant nodes of its host; a null or empty page has none."""
    if not page:
        return ""
    node, marked = main_part(parse(page))
    out: list[str] = []
    _texts(node, set(constant), node.tag, out, marked)
    return " ".join("".join(out).split())


Outline = list[tuple[int, str, int]]


def outline(page: str | None) -> Outline:
    """The main part of a page in order: for each element the place of its parent, its sign (of the first one the tag), and the hash of its own text."""
    if not page:
        return []
    node, marked = main_part(parse(page))
    found: Outline = []
    left = [(node, -1)]
    while left:
        x, above = left.pop()
        here = len(found)
        found.append((above, _sign(x) if above >= 0 else x.tag, _hash(x)))
        left += [(c, here) for c in reversed(x.children) if not _noise(c, marked)]
    return found


def paths(tree: Outline) -> list[str]:
    """The path of each element."""
    out: list[str] = []
    for above, sign, _ in tree:
        out.append(_below(out[above], sign) if above >= 0 else sign)
    return out


def slots(tree: Outline) -> dict[str, list[int]]:
    """Path to the sorted hashes of the different own texts of the elements there, if any."""
    found: dict[str, set[int]] = defaultdict(set)
    for path, (_, _, own) in zip(paths(tree), tree, strict=True):
        found[path].update([own] if own else [])
    return {k: sorted(v) for k, v in sorted(found.items())}


class Forms:
    """Numbers of trees of signs, equal trees alike, with sign, children and size of each; those of ``base`` keep theirs."""

    __slots__ = ("base", "first", "known", "rows")

    def __init__(self, base: Forms | None = None):
        self.base, self.first = base, len(base.rows) if base else 0
        self.known: dict[tuple[str, tuple[int, ...]], int] = {}
        self.rows: list[tuple[str, tuple[int, ...], int]] = []

    def __getitem__(self, form: int) -> tuple[str, tuple[int, ...], int]:
        return self.rows[form - self.first] if form >= self.first else self.base.rows[form]

    def number(self, sign: str, kids: tuple[int, ...]) -> int:
        key = sign, kids
        form = self.base.known.get(key) if self.base else None
        if form is None:
            form = self.known.get(key)
        if form is None:
            form = self.known[key] = self.first + len(self.rows)
            self.rows.append((sign, kids, 1 + sum(self[k][2] for k in kids)))
        return form


class Shape:
    """A tree with what the alignment asks of it: the children and the form of each element. ``base`` holds the forms of what it is compared with."""

    __slots__ = ("tree", "kids", "form", "forms")

    def __init__(self, tree: Outline, base: Forms | None = None):
        self.tree, self.forms = tree, Forms(base)
        self.kids: list[list[int]] = [[] for _ in tree]
        for i, (above, _, _) in enumerate(tree):
            if above >= 0:
                self.kids[above].append(i)
        self.form = [0] * len(tree)
        for i in range(len(tree) - 1, -1, -1):
            self.form[i] = self.forms.number(tree[i][1], tuple(self.form[k] for k in self.kids[i]))


def _trimmed(xs: list[int], ys: list[int]) -> tuple[int, int, int]:
    """How many equal forms two lists begin with, and where what they end with begins: some largest matching has all of these."""
    lo, n, m = 0, len(xs), len(ys)
    while lo < n and lo < m and xs[lo] == ys[lo]:
        lo += 1
    while n > lo and m > lo and xs[n - 1] == ys[m - 1]:
        n, m = n - 1, m - 1
    return lo, n, m


class Matching:
    """The sizes of the largest matchings of forms, each found once."""

    __slots__ = ("forms", "sizes")

    def __init__(self, forms: Forms):
        self.forms = forms
        self.sizes: dict[tuple[int, int], int] = {}

    def easy(self, f: int, g: int) -> int | None:
        """The size where no children have to be compared."""
        a, b = self.forms[f], self.forms[g]
        if f == g:
            return a[2]
        if a[0] != b[0]:
            return 0
        return self.sizes.get((f, g)) if a[1] and b[1] else 1

    def size(self, f: int, g: int) -> int:
        left = [(f, g)]
        while left:
            f, g = left[-1]
            if self.easy(f, g) is not None:
                left.pop()
                continue
            xs, ys = self.forms[f][1], self.forms[g][1]
            lo, n, m = _trimmed(xs, ys)
            mid_x, mid_y = xs[lo:n], ys[lo:m]
            open_ = [(x, y) for x in set(mid_x) for y in set(mid_y) if self.easy(x, y) is None]
            if open_:
                left += open_
                continue
            ends = sum(self.forms[x][2] for x in (*xs[:lo], *xs[n:]))
            self.sizes[f, g] = 1 + ends + (int(_last_row(*self._weights(mid_x, mid_y))[-1]) if mid_x and mid_y else 0)
            left.pop()
        return self.easy(f, g)

    def _weights(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes by kinds of x and y, and the kind of each."""
        kinds_x, at_x = np.unique(np.array(xs), return_inverse=True)
        kinds_y, at_y = np.unique(np.array(ys), return_inverse=True)
        table = np.array([[self.easy(x, y) for y in kinds_y.tolist()] for x in kinds_x.tolist()], np.int64)
        return table, at_x, at_y

    def in_order(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        """Places of a largest matching of two lists of forms that keeps their order."""
        lo, n, m = _trimmed(xs, ys)
        pairs = [(i, i) for i in range(lo)] + [(n + i, m + i) for i in range(len(xs) - n)]
        if lo < n and lo < m:
            for x in set(xs[lo:n]):
                for y in set(ys[lo:m]):
                    self.size(x, y)
            table, at_x, at_y = self._weights(tuple(xs[lo:n]), tuple(ys[lo:m]))
            pairs += [(lo + i, lo + j) for i, j in _halved(table, at_x, at_y)]
        return pairs


def _last_row(table: np.ndarray, at_x: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """The largest weight of a matching in order of all x with the first 0, 1, 2... of y."""
    row = np.zeros(len(at_y) + 1, np.int64)
    weights = table[:, at_y]
    for x in at_x.tolist():
        np.maximum(row[1:], row[:-1] + weights[x], out=row[1:])
        np.maximum.accumulate(row, out=row)
    return row


def _halved(table: np.ndarray, at_x: np.ndarray, at_y: np.ndarray) -> list[tuple[int, int]]:
    """A largest matching in order, found in linear space: half of x goes with the part of y that leaves most to both halves."""
    pairs, left = [], [(0, len(at_x), 0, len(at_y))]
    while left:
        a, b, c, d = left.pop()
        if a == b or c == d:
            continue
        if b - a == 1:
            row = table[at_x[a], at_y[c:d]]
            best = int(row.argmax())
            if row[best]:
                pairs.append((a, c + best))
            continue
        mid = (a + b) // 2
        before = _last_row(table, at_x[a:mid], at_y[c:d])
        after = _last_row(table, at_x[mid:b][::-1], at_y[c:d][::-1])[::-1]
        cut = c + int((before + after).argmax())
        left += [(a, mid, c, cut), (mid, b, cut, d)]
    return pairs


def tree_match(a: Shape, b: Shape) -> list[tuple[int, int]]:
    """Simple tree matching: the matched elements of two trees, where b is numbered upon the forms of a."""
    if not a.tree or not b.tree or a.tree[0][1] != b.tree[0][1]:
        return []
    sizes = Matching(b.forms)
    matched, left = [], [(0, 0)]
    while left:
        pair = left.pop()
        matched.append(pair)
        xs, ys = a.kids[pair[0]], b.kids[pair[1]]
        if xs and ys:
            found = sizes.in_order([a.form[x] for x in xs], [b.form[y] for y in ys])
            left += [(xs[i], ys[j]) for i, j in found]
    return matched


def _host(url: str) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))


def _votes(tree: Outline, references: list[tuple[Shape, list[str]]]) -> Iterator[tuple[int, str, list[int]]]:
    """(among, slot, texts): among -1 are all pages, a number from 0 those of a layout, one below -1 those matched with a reference (given with its paths)."""
    found = slots(tree)
    layout = crc32("\n".join(found).encode())
    for path, texts in found.items():
        if texts:
            yield -1, path, texts
            yield layout, path, texts
    for r, (reference, where) in enumerate(references):
        for i, j in tree_match(reference, Shape(tree, reference.forms)):
            if tree[j][2]:
                yield -2 - r, f"{where[i]}{_SLOT}{i}", [tree[j][2]]


def induce(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, text): the constant nodes of each host.

    Pages of a host with equal trees are copies and vote once. A node is constant
    if more than SUPPORT pages, and SHARE percent of the pages with its slot, have
    its text there, while of most slots most nodes vary. Slots are the elements
    that are matched with a reference's element, and the paths, among all pages of
    a host and among those of each layout (set of paths); either suffices. Votes
    are added up by the workers before they are shuffled, so a host with very many
    pages is no hot key.
    """

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [outline(x.as_py()) for x in batch.column(1)]
            group = [crc32(" ".join(f"{above} {sign}" for above, sign, _ in t).encode()) % REFERENCES for t in found]
            columns = [batch.column(0), pa.array(group, pa.int64()), pa.array([json.dumps(t) for t in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "shape", "tree"])
        kernel.release()

    found = pages.select(_host(url_col).alias("host"), F.col(html_col)).where("host <> ''").mapInArrow(trees, "host string, shape bigint, tree string")
    found = checkpointed(found.where("tree <> '[]'").distinct())
    chosen = found.groupBy("host", "shape").agg(F.min_by("tree", F.xxhash64("tree")).alias("tree"), F.count("*").alias("n"))
    chosen = chosen.groupBy("host").agg(F.sort_array(F.collect_list("tree")).alias("references"), F.sum("n").alias("n"))
    # other hosts can't have constant nodes
    chosen = small(chosen.where(F.col("n") > SUPPORT).select("host", "references"), FEW_HOSTS)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[Shape, list[str]]]] = {}
        for batch in batches:
            # text -1 stands for the slot itself
            total: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
            for host, tree, references in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if host not in known:
                    if len(known) > 64:
                        known.clear()
                    known[host] = [(Shape(x), paths(x)) for x in map(json.loads, references)]
                for among, slot, texts in _votes(json.loads(tree), known[host]):
                    for text, n in ((-1, len(texts)), *((t, 1) for t in texts)):
                        cell = total[host, among, slot, text]
                        cell[0] += 1
                        cell[1] += n
            rows = [(*k, *v) for k, v in total.items()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "layout", "path", "text", "same", "nodes"])
        kernel.release()

    votes = found.select("host", "tree").join(chosen, "host").mapInArrow(vote, "host string, layout bigint, path string, text bigint, same bigint, nodes bigint")
    group = ["host", "layout"]
    counted = votes.groupBy(*group, "path", "text").agg(F.sum("same").alias("same"), F.sum("nodes").alias("nodes"))
    counted = checkpointed(counted.where((F.col("text") < 0) | (F.col("same") > SUPPORT)))
    at = counted.where("text < 0").select(*group, "path", F.col("same").alias("pages"), "nodes")
    stays = counted.where("text >= 0").drop("nodes").join(at, [*group, "path"]).where(100 * F.col("same") >= SHARE * F.col("pages"))
    constant = stays.groupBy(*group, "path").agg(F.sum("same").alias("constant"))
    varying = 2 * F.coalesce("constant", F.lit(0)) <= F.col("nodes")
    most = at.join(constant, [*group, "path"], "left").groupBy(*group)
    most = most.agg(F.sum(F.when(varying, F.col("pages")).otherwise(0)).alias("varying"), F.sum("pages").alias("all"))
    kept = stays.join(most.where(2 * F.col("varying") > F.col("all")), group)
    return kept.select("host", F.substring_index("path", _SLOT, 1).alias("path"), "text").distinct()


def extract_pages(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All rows of ``pages`` with ``text`` and ``n_chars`` (code points) appended, replacing such columns.

    A null or empty page has an empty text. Pages whose URL has no host, or is
    null, and hosts of few pages have no wrapper: only their markup is used.
    Repeated rows are each extracted. Other columns are kept.
    """
    kernel.tune(pages.sparkSession)
    constant = checkpointed(induce(pages, key_col, url_col, html_col))
    few = constant.count() <= FEW
    wrappers = constant.groupBy(F.col("host").alias("_host")).agg(F.collect_set(F.struct("path", "text")).alias("_constant"))
    base = pages.drop("text", "n_chars")
    own, html_own = kernel.shielded(base, html_col)
    own = own.withColumn("_host", _host(f"_own{base.columns.index(url_col)}"))
    out = own.join(F.broadcast(wrappers) if few else wrappers.hint("merge"), "_host", "left").drop("_host")
    names = [c for c in out.columns if c != "_constant"]
    schema = out.select(*names).withColumn("_text", F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names
            sets = batch.column(at.index("_constant")).to_pylist()
            texts = [
                extract(x.as_py(), {(c["path"], c["text"]) for c in s or ()}) for x, s in zip(batch.column(at.index(html_own)), sets, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(at.index(c)) for c in names), pa.array(texts, pa.string())], names=[*names, "_text"])
        kernel.release()

    found = out.mapInArrow(run, schema).withColumn("_n", F.length("_text").cast("long"))
    return found.toDF(*base.columns, "text", "n_chars")


def digest(pages: DataFrame) -> DataFrame:
    """Per page: url, text and n_chars."""
    return extract_pages(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
