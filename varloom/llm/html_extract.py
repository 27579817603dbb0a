"""Main text of HTML pages by wrapper induction (operator 4).

The DOM trees of a host's pages are aligned with the tree of one of them, the seed, by simple tree
matching: a largest match of equal tags that keeps order and depth. Over all pages of the host each
seed node counts how often it is met and how often its own text is the same. Constant nodes are
template, varying nodes are slots. The subtree that holds most of the varying text is the host's
content, and every page gives the blocks of the subtree that is aligned with it, without template
nodes. Varying text that is never the article (adverts, reader comments ...) goes by tag, role or
class; but neither a class nor a form, aside, dialog or role says anything against an element that
holds most of the host's varying text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import table, values
from varloom.llm.url_filter import split_url

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table div article section main body html".split())
#: Elements and roles that are never the article.
DROP = frozenset("head script style title noscript template iframe svg nav footer aside form button select option textarea menu dialog input".split())
#: Of these, the ones that no page keeps its article in, however much text they hold.
NEVER = frozenset("head script style title noscript template iframe svg nav footer header button select option textarea menu input xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
#: A class or id names noise where one of its words is of the first list, and the others of either.
NOISE = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar sidebars sidenav nav navbar navigation menu menus breadcrumb breadcrumbs footer comment comments disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login pagination pager toolbar skip".split())
PLACES = frozenset("area bar block body bottom box button buttons container content left right top main page global site primary secondary inner outer wrap wrapper list item items link links module panel section slot thread unit user reader widget form container group row column col posts post articles article stories".split())
HEADERS = frozenset("header masthead topbar".split())
ROOTS = frozenset(("article", "main"))
#: The smoothed share of other pages with the same text from which a node is template: anywhere (two pages
#: do), and inside an article or main element (four pages do), whose copies make its text constant too.
CONSTANT, CONSTANT_INSIDE = 0.7, 0.85
#: The content root holds this share of a host's varying text.
MASS = 0.8
#: Wrappers are broadcast up to this many bytes in all, and joined by host beyond; a node takes up to so many times the bytes of its tag.
BROADCAST_BYTES, NODE_BYTES = 8 << 20, 12
#: Cells of a match of two child lists that are kept at once; longer lists are halved first.
CELLS = 4_000_000

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_NAME = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_WORD = re.compile("[^a-z0-9]+")


def _named(text: str, words: frozenset) -> bool:
    for name in text.lower().split():
        parts = [w for w in _WORD.split(name) if w and not w.isdigit()]
        if any(w in words for w in parts) and all(w in words or w in NOISE or w in PLACES for w in parts):
            return True
    return False


class Node:
    """noise: 0 for none, 1 by a class or id alone, 2 by tag, role or a hidden attribute."""

    __slots__ = ("tag", "noise", "role", "kids", "els", "up", "at", "shape")

    def __init__(self, tag: str, attrs: str, up: Node | None):
        self.tag, self.up, self.kids, self.els, self.at, self.role = tag, up, [], [], -1, ""
        self.noise = 2 if tag in DROP else 0
        named = header = False
        if attrs and not attrs.isspace():
            for m in _ATTR.finditer(attrs):
                name = m[1].lower()
                if name in ("class", "id"):
                    value = m[2] or m[3] or m[4] or ""
                    named, header = named or _named(value, NOISE), header or _named(value, HEADERS)
                elif name == "role":
                    self.role = (m[2] or m[3] or m[4] or "").strip().lower()
                    if self.role in ROLES:
                        self.noise = 2
                elif name == "hidden":
                    self.noise = 2
        if not self.noise:
            if (tag == "header" or header) and not self.inside_root():
                self.noise = 2 if tag == "header" else 1
            elif named:
                self.noise = 1
        if tag in ("html", "body", "main", "article") and self.noise == 1:
            self.noise = 0

    def inside_root(self) -> bool:
        x = self.up
        while x is not None:
            if x.tag in ROOTS:
                return True
            x = x.up
        return False

    def own(self) -> str:
        return " ".join("".join([x for x in self.kids if type(x) is str]).split())


def parse(html: str) -> Node:
    """A tree of any string: unclosed, crossed and stray tags included. Character references stay as they are."""
    root = Node("#root", "", None)
    top, at, n, find, tag_at = root, 0, len(html), html.find, _TAG.match
    #: Numbers of open elements by tag: within the innermost scope, and in all.
    scopes: list[dict[str, int]] = [{}]
    opened: dict[str, int] = {}

    def close(x: Node) -> Node:
        """Closes x and all below it."""
        nonlocal top
        while True:
            gone = top
            top = gone.up
            opened[gone.tag] -= 1
            if gone.tag in SCOPE:
                scopes.pop()
            else:
                scopes[-1][gone.tag] -= 1
            if gone is x:
                return top

    while at < n:
        lt = find("<", at)
        if lt < 0:
            top.kids.append(html[at:])
            break
        if lt > at:
            top.kids.append(html[at:lt])
        m = tag_at(html, lt)
        if m is None:
            if html.startswith("<!--", lt):
                end = find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif html.startswith(("<!", "<?"), lt):
                end = find(">", lt)
                at = n if end < 0 else end + 1
            elif _NAME.match(html, lt):
                break  # the text ends within a tag
            else:
                top.kids.append("<")
                at = lt + 1
            continue
        at = m.end()
        closing, tag, attrs = m.groups()
        tag = tag.lower()
        if closing:
            if (opened if tag in SCOPE else scopes[-1]).get(tag):
                x = top
                while x.tag != tag:
                    x = x.up
                close(x)
            continue
        shut = CLOSES.get(tag) or (("p",) if tag in BLOCK else ())
        if shut and any(scopes[-1].get(t) for t in shut):
            x = top
            while x.tag not in shut:
                x = x.up
            close(x)
        node = Node(tag, attrs, top)
        top.kids.append(node)
        top.els.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}", re.I).search(html, at)
            end = -1 if end is None else find(">", end.end())
            at = n if end < 0 else end + 1
        elif tag not in VOID and not attrs.endswith("/"):
            top = node
            opened[tag] = opened.get(tag, 0) + 1
            if tag in SCOPE:
                scopes.append({})
            else:
                scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
    return root


def number(root: Node) -> list[Node]:
    """Elements in page order; each gets its place in at."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        x.at = len(out)
        out.append(x)
        todo += reversed(x.els)
    return out


class Shapes:
    """Trees of tags without texts, each a number: what two elements match in depends on their shapes alone."""

    def __init__(self):
        self.of: dict[tuple, int] = {}
        self.kids: list[tuple[int, ...]] = []
        self.tags: list[str] = []
        self.size: list[int] = []
        self.met: dict[tuple[int, int], int] = {}

    def label(self, nodes: list[Node]) -> None:
        """Sets shape in elements that are in page order."""
        for x in reversed(nodes):
            key = (x.tag, *[k.shape for k in x.els])
            if (i := self.of.get(key)) is None:
                i = self.of[key] = len(self.kids)
                self.kids.append(key[1:])
                self.tags.append(x.tag)
                self.size.append(1 + sum([self.size[k] for k in key[1:]]))
            x.shape = i

    def match(self, x: int, y: int) -> int:
        """The size of the largest match of two shapes of one tag."""
        if x == y:
            return self.size[x]
        a, b = self.kids[x], self.kids[y]
        if not a or not b:
            return 1
        if (s := self.met.get((x, y))) is None:
            s = 1
            for i, j in self.pairs(a, b):
                s += self.match(a[i], b[j])
            self.met[x, y] = s
        return s

    def pairs(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[tuple[int, int]]:
        """The places that a largest match of two lists of shapes pairs, in order. Equal ends always match."""
        lo, i, j = 0, len(a), len(b)
        while lo < i and lo < j and a[lo] == b[lo]:
            lo += 1
        ends = []
        while i > lo and j > lo and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            ends.append((i, j))
        out = [(k, k) for k in range(lo)]
        if lo < i and lo < j:
            out += [(lo + p, lo + q) for p, q in self._middle(a[lo:i], b[lo:j])]
        return out + ends[::-1]

    def weights(self, a: tuple[int, ...], b: tuple[int, ...]) -> dict[int, np.ndarray]:
        """For each shape of a, what it matches in with each of b."""
        kinds, which = np.unique(np.array(b), return_inverse=True)
        out = {}
        for x in dict.fromkeys(a):
            row = []
            for y in kinds.tolist():
                row.append(self.match(x, y) if self.tags[x] == self.tags[y] else 0)
            out[x] = np.array(row, np.int64)[which]
        return out

    def _middle(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[tuple[int, int]]:
        if len(a) * len(b) <= 600:
            grid, tags, match = [[0] * (len(b) + 1)], self.tags, self.match
            for x in a:
                last, row = grid[-1], [0]
                for j, y in enumerate(b):
                    best = last[j + 1] if last[j + 1] >= row[j] else row[j]
                    if tags[x] == tags[y] and (s := last[j] + match(x, y)) > best:
                        best = s
                    row.append(best)
                grid.append(row)
            return _trace(grid, len(a), len(b))
        weight = self.weights(a, b)
        if len(a) * len(b) <= CELLS or len(a) == 1:
            return _trace(list(_rows(a, weight)), len(a), len(b))
        half = len(a) // 2  # the halves of a best match, from the ends inwards
        for left in _rows(a[:half], weight):
            pass
        for right in _rows(a[half:][::-1], {x: w[::-1] for x, w in weight.items()}):
            pass
        cut = int((left + right[::-1]).argmax())
        return self.pairs(a[:half], b[:cut]) + [(half + i, cut + j) for i, j in self.pairs(a[half:], b[cut:])]


def _rows(a: tuple[int, ...], weight: dict[int, np.ndarray]) -> Iterator[np.ndarray]:
    """The rows of the grid of best matches of the first elements of two lists."""
    row = np.zeros(len(next(iter(weight.values()))) + 1, np.int64)
    yield row
    for x in a:
        w = weight[x]
        new = row.copy()
        np.maximum(new[1:], np.where(w > 0, row[:-1] + w, 0), out=new[1:])
        row = np.maximum.accumulate(new)
        yield row


def _trace(grid: list, i: int, j: int) -> list[tuple[int, int]]:
    out = []
    while i and j:
        if grid[i][j] == grid[i - 1][j]:
            i -= 1
        elif grid[i][j] == grid[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(page: Node, seed: Node, shapes: Shapes | None = None) -> dict[int, Node]:
    """Simple tree matching: seed node number -> the page's node, in a largest order-preserving match.
    A seed that is given with shapes has its own already."""
    if shapes is None:
        shapes = Shapes()
        shapes.label(number(seed))
    shapes.label(number(page))
    out, todo = {}, [(page, seed)]
    while todo:
        x, y = todo.pop()
        out[y.at] = x
        if x.els and y.els:
            if x.shape == y.shape:
                todo += zip(x.els, y.els, strict=True)
            else:
                todo += [(x.els[i], y.els[j]) for i, j in shapes.pairs(shapes.kids[x.shape], shapes.kids[y.shape])]
    return out


class Wrapper:
    """What a host's pages have in common: the seed's tree, the number of its node that is the content,
    those of its template nodes, and of those that are no noise whatever their tag or class."""

    def __init__(self, seed: str):
        self.tree = parse(seed)
        self.nodes = number(self.tree)
        self.shapes = Shapes()
        self.shapes.label(self.nodes)
        self.root, self.template, self.pardoned = 0, set(), set()

    def align(self, page: Node) -> dict[int, Node]:
        if len(self.shapes.kids) > 50_000:  # shapes of other pages are of no use beyond them
            self.shapes = Shapes()
            self.shapes.label(self.nodes)
        return align(page, self.tree, self.shapes)

    def learn(self, slots: dict[int, tuple[int, int, int]]) -> Wrapper:
        """slots: node -> pages that have it, pages with the seed's text, characters of differing texts."""
        nodes = self.nodes

        def masses(noisy: set[int]) -> list[int]:
            mass = [0] * len(nodes)
            for i in range(len(nodes) - 1, -1, -1):
                if i in noisy:
                    mass[i] = 0
                    continue
                n, same, varied = slots.get(i, (0, 0, 0))
                mass[i] += varied if n > same else len(nodes[i].own()) if n <= 1 else 0
                if nodes[i].up is not None and nodes[i].up.at not in noisy:
                    mass[nodes[i].up.at] += mass[i]
            return mass

        mass = masses({x.at for x in nodes if x.tag in NEVER})
        told = any(n > same for n, same, _ in slots.values())
        kept = {x.at for x in nodes if x.noise == 2 and x.tag not in NEVER and mass[x.at] and mass[x.at] >= MASS * mass[0] and (told or _holds_root(x))}
        mass = masses({x.at for x in nodes if x.noise == 2 and x.at not in kept})
        self.pardoned = kept | {x.at for x in nodes if x.noise == 1 and mass[x.at] and mass[x.at] >= MASS * mass[0]}
        noisy = {x.at for x in nodes if x.noise and x.at not in self.pardoned}
        mass = masses(noisy)
        for x in nodes:  # in page order: below noise all is noise
            if x.up is not None and x.up.at in noisy:
                noisy.add(x.at)
        at = 0
        while True:
            kids = [k.at for k in nodes[at].els if k.tag in BLOCK and k.at not in noisy]
            best = max(kids, key=lambda k: (mass[k], -k), default=None)
            if best is None or not mass[best] or mass[best] < MASS * mass[0] or not any(k.tag in BLOCK for k in nodes[best].els):
                break
            at = best
        holds = [x.at for x in nodes if (x.tag in ROOTS or x.role == "main") and x.at not in noisy and mass[x.at] >= MASS * mass[0]]
        self.root = max(holds) if holds else at
        top = nodes[self.root]
        inside = top.tag in ROOTS or top.role == "main"
        least = CONSTANT_INSIDE if inside else CONSTANT
        # Where no text varies, all pages are copies, and none of it is told from the article.
        self.template = {i for i, (n, same, _) in slots.items() if n > 1 and (same - 0.5) / n >= least} if mass[0] else set()
        return self


def _holds_root(node: Node) -> bool:
    """Whether an article or main element is below, where no varying text tells of the article."""
    todo = list(node.els)
    while todo:
        x = todo.pop()
        if x.tag in ROOTS or x.role == "main":
            return True
        todo += x.els
    return False


def _tops(page: Node, pardoned: set[int]) -> list[Node]:
    """The page's own article and main elements, outermost ones, or the page."""
    found, todo = [], [page]
    while todo:
        x = todo.pop()
        if x is not page and x.noise and id(x) not in pardoned:
            continue
        if x.tag in ROOTS or x.role == "main":
            found.append(x)
        else:
            todo += reversed(x.els)
    return found or [page]


def blocks(root: Node, template: set[int], pardoned: set[int] = frozenset()) -> list[str]:
    """Texts of the blocks below root, in page order; noise and template nodes left out (sets of id())."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            text = _SPACE.sub(" ", unescape("".join(line))).strip()
            if text:
                out.append(text)
            line.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif type(x) is str:
            line.append(x)
        elif x is not root and x.noise and id(x) not in pardoned:
            line.append(" ")
        elif x.tag == "br":
            line.append(" ")
        else:
            kids = x.els if id(x) in template else x.kids
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(kids)
    flush()
    return out


def extract(page: Node, wrapper: Wrapper) -> str:
    """The page's blocks below the node that is aligned with the content root. Where none is, below
    its own article or main elements, and else below the whole page.

    Where template nodes would take most of the text of such a node, the page is a copy of others, and
    they stay."""
    met = wrapper.align(page)
    pardoned = {id(met[i]) for i in wrapper.pardoned if i in met}
    constant = {id(x) for i in wrapper.template if (x := met.get(i)) is not None and x.own()}
    tops = [met[wrapper.root]] if wrapper.root and wrapper.root in met else _tops(page, pardoned)
    out = []
    for t in tops:
        mine = blocks(t, constant, pardoned)
        if constant and t is not page:
            whole = blocks(t, set(), pardoned)
            if 2 * sum(map(len, mine)) < sum(map(len, whole)):
                mine = whole
        out += mine
    return "\n".join(out)


def _deep() -> None:
    """Matching recurses as deep as the pages are; Python's own frames are on the heap."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, seed, html -> for each host and seed node with a text: pages, same texts, characters of differing texts."""
    _deep()
    total: dict[tuple[str, int], list[int]] = {}
    wrappers: dict[str, tuple[Wrapper, list[str]]] = {}

    def flush() -> pa.RecordBatch:
        keys = list(total)
        cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([total[k][j] for k in keys], pa.int64()) for j in range(3))]
        total.clear()
        return pa.record_batch(cols, names=["host", "node", "n", "same", "varied"])

    for b in batches:
        for host, seed, html in zip(*(values(b.column(i)) for i in range(3)), strict=True):
            if host not in wrappers:
                if len(wrappers) > 200:
                    wrappers.clear()
                made = Wrapper(seed)
                wrappers[host] = made, [x.own() for x in made.nodes]
            wrapper, own = wrappers[host]
            for i, x in wrapper.align(parse(html)).items():
                said = x.own()
                if said or own[i]:
                    got = total.setdefault((host, i), [0, 0, 0])
                    got[0] += 1
                    if said == own[i]:
                        got[1] += 1
                    else:
                        got[2] += len(said)
        if len(total) > 200_000:
            yield flush()
    yield flush()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _deep()
    wrappers: dict[str, Wrapper] = {}
    for b in batches:
        out = []
        for host, seed, slots, html in zip(*(values(b.column(i)) for i in (2, 3, 4, 5)), strict=True):
            if not html:
                out.append("")
                continue
            if host not in wrappers:
                if len(wrappers) > 200:
                    wrappers.clear()
                wrappers[host] = Wrapper(seed).learn({s["node"]: (s["n"], s["same"], s["varied"]) for s in slots or ()})
            out.append(extract(parse(html), wrappers[host]))
        yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null and empty html give an empty text; such rows are no seeds. A null url, or one without a
    host, belongs to the host of the empty name. A host of one page is its own seed. Repeated rows
    stay, other columns are ignored, no rows give no rows. Statistics are over all pages; a seed is
    the page with the smallest hash of its html.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), split_url(F.col(url))[0].alias("host"))
    seeds = rows.where("html <> ''").groupBy("host").agg(F.min_by("html", F.xxhash64("html")).alias("seed"))
    small = lambda df: F.broadcast(df) if (df.agg(F.sum(F.octet_length("seed") * F.lit(NODE_BYTES) + F.lit(64))).first()[0] or 0) <= BROADCAST_BYTES else df
    hint = small(seeds)
    stats = rows.where("html <> ''").join(hint, "host").select("host", "seed", "html").mapInArrow(_slots, "host string, node int, n long, same long, varied long")
    sums = stats.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in ("n", "same", "varied")])
    slots = sums.groupBy("host").agg(F.collect_list(F.struct("node", "n", "same", "varied")).alias("slots"))
    wrappers = seeds.join(slots, "host", "left")
    wrappers = F.broadcast(wrappers) if hint is not seeds else wrappers  # a slot takes 32 bytes, a node's tag 3 at least
    return rows.join(wrappers, "host", "left").select("page_id", "url", "host", "seed", "slots", "html").mapInArrow(_texts, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract_pages() of all pages: a row for every row; nulls, repeats and empty tables as there."""
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


SQL: dict[str, str] = {}
QUERIES = {"op4_html_extract": op4_html_extract}
