"""Main text of web pages by wrapper induction.

Pages of one host are cut into runs of about ``RUN`` pages (a large host has many
runs, so no host meets in one task). Within a run every page's tree of block
elements is aligned with a reference page by simple tree matching. Aligned nodes
whose text is the same on nearly all pages, of which copies count once, are template
where they have that text; the others are slots. The content slot of a page is the
deepest container, or row of equal ones, that holds all of its varying text, or the
articles in or around it, all of them in page order. A page that does not align, or a
host with a single text, falls back to its own articles or densest container. Menus, page headers, footers, side bars, notices, adverts, forms,
comments of readers, scripts and styles are left out by their element or by the
words of their class, id or role.

Defined results: null html gives an empty text; broken markup is read as far as
it goes; a null URL or one without ``://`` belongs to the empty host; repeated rows and
ids are each kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs_of, written
from .url_rules import host_and_path

RUN = 200
#: Characters of html a run should hold: a host has as many runs as this asks for.
HELD = 32 << 20
#: Levels of block elements that are aligned; text and marks are read at any depth.
DEEPEST = 200
#: Large hosts up to this many are broadcast, more are joined by a shuffle.
BROADCAST_HOSTS = 500_000
#: Share of a run's pages on which a node must be the same to be template, and of a slot's
#: text beside its articles from which they are not taken for the whole.
SAME, MOST = 0.9, 0.6

#: Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg math object canvas".split())
BLOCK = set("html body div p ul ol li dl dt dd table thead tbody tfoot tr td th caption section "
            "article main nav header footer aside form fieldset h1 h2 h3 h4 h5 h6 pre blockquote "
            "figure figcaption address details summary center hgroup dialog search menu hr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"html", "body"}
SCOPE = {"ul": "li", "ol": "li", "dl": "dd"}
DROPPED = set("nav aside form button select option fieldset dialog search menu head title "
              "label input".split()) | RAW
#: Words of class, id or role that mark what is not the article.
MARKS = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo "
            "promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav "
            "aside footer masthead topbar cookie cookies consent gdpr notice notices alert popup "
            "modal overlay newsletter subscribe subscription signup login share sharing social "
            "comment comments commentlist disqus reply replies respond related recommended widget "
            "widgets pagination pager toolbar skip complementary contentinfo search".split())
#: Words that make a mark speak of a layout ("has-sidebar"), and of an article's own header.
NOT_MARKED = set("has with no without wrap wrapper container layout".split())
ARTICLE_WORDS = set("article post entry content story page".split())
CONTAINERS = set("body div section article main td center".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>"
                  r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
                  r"(?P<attrs>(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*))>", re.S)
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("tag", "label", "out", "kids", "parent")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.parent, self.kids = tag, parent, []
        names = []
        if "=" in attrs:
            for m in _ATTR.finditer(attrs):
                names += [w.lower() for w in _NAME.findall(
                    re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or ""))]
        self.label = " ".join([tag, *sorted(set(names))])
        inside = ("header" in names or tag == "header") and _within(parent, ("article", "main"))
        marked = (not MARKS.isdisjoint(names) and NOT_MARKED.isdisjoint(names)
                  or "header" in names and not inside and ARTICLE_WORDS.isdisjoint(names))
        self.out = (tag in DROPPED or tag == "footer" or tag == "header" and not inside
                    or tag not in ("html", "body", "article", "main") and marked
                    or tag == "article" and not MARKS.isdisjoint({"comment", "comments", "reply"} & set(names)))


def _within(node: Node | None, tags: tuple) -> Node | None:
    while node is not None and node.tag not in tags:
        node = node.parent
    return node


def parse(text: str) -> Node:
    """A tree of elements and strings; what is not closed ends with its parent.

    Linear in broken markup: nothing behind the last ``>`` is taken for a tag, and open
    elements are counted by name, so an end without a begin is passed over at once."""
    root = Node("html", "", None)
    at, here, raw = 0, root, None
    opened: Counter = Counter()

    def leave(up: Node) -> Node:
        """Close ``up`` and all open elements in it."""
        node = here
        while True:
            opened[node.tag] -= 1
            if node is up:
                return up.parent
            node = node.parent

    last = text.rfind(">") + 1
    for m in _TAG.finditer(text, 0, last):
        tag = (m["tag"] or "").lower()
        if raw:                      # inside raw text only its own end counts
            if not (m["end"] and tag == raw):
                continue
            raw = None
        elif m.start() > at:
            here.kids.append(text[at:m.start()])
        at = m.end()
        if m["cdata"]:
            here.kids.append(m["cdata"].replace("&", "&amp;"))
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(text)       # a comment without an end
            continue
        if m["end"]:
            if opened[tag]:
                up = here
                while up.tag != tag:
                    up = up.parent
                here = leave(up)
            continue
        if tag == "html":
            continue
        if tag in ENDS_P and opened["p"]:
            p = _within(here, ("p", *CONTAINERS))
            if p is not None and p.tag == "p":
                here = leave(p)
        if tag in CLOSED_BY and any(opened[t] for t in CLOSED_BY[tag]):
            up = here
            while up is not None and up.tag not in CLOSED_BY[tag] and up.tag not in (
                    "ul", "ol", "dl", "table", "select", *CONTAINERS - {"td"}):
                up = up.parent
            while up is not None and up.tag in CLOSED_BY[tag]:
                here = leave(up)
                up = here if tag == "tr" else None
        node = Node(tag, m["attrs"] or "", here)
        here.kids.append(node)
        if tag in RAW:
            raw = tag if not (m["attrs"] or "").endswith("/") else None
        if tag not in VOID and not (m["attrs"] or "").endswith("/") or tag in BLOCK - {"hr"}:
            here = node
            opened[tag] += 1
    if not raw and at < len(text):
        here.kids.append(text[at:].split("<!--", 1)[0] if at >= last else text[at:])
    return root


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below ``node``, without what is not the article."""
    out: list[str] = []
    line: list[str] = []

    def flush():
        text = " ".join(entities.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif not x.out or x is node:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.kids))
    flush()
    return out


class Shape:
    """A block element with its block children; equal childless neighbours are one. Shapes
    with equal ``sig`` have equal trees. Below ``DEEPEST`` levels a shape has no children."""

    __slots__ = ("label", "nodes", "kids", "size", "sig")

    def __init__(self, nodes: list[Node], level: int = 0):
        self.label, self.nodes, self.kids = nodes[0].label, nodes, []
        for k in (k for n in nodes for k in _block_kids(n)) if level < DEEPEST else ():
            leaf = level + 1 >= DEEPEST or not _block_kids(k)
            if leaf and self.kids and self.kids[-1].label == k.label and not self.kids[-1].kids:
                self.kids[-1].nodes.append(k)
            else:
                self.kids.append(Shape([k], level + 1))
        self.size = 1 + sum(k.size for k in self.kids)
        self.sig = blake2b(b"".join([k.sig for k in self.kids]) + self.label.encode(),
                           digest_size=16).digest()


def _block_kids(node: Node) -> list[Node]:
    out, todo = [], list(reversed(node.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, Node):
            if k.tag in BLOCK:
                out.append(k)
            elif k.tag not in RAW and k.tag != "head":
                todo.extend(reversed(k.kids))
    return out


def _ends(a: Shape, b: Shape) -> tuple[int, int]:
    """How many children the two begin and end with that are equal trees: they match each
    other whole, which no other pairing of them can beat."""
    n, head, tail = min(len(a.kids), len(b.kids)), 0, 0
    while head < n and a.kids[head].sig == b.kids[head].sig:
        head += 1
    while tail < n - head and a.kids[-1 - tail].sig == b.kids[-1 - tail].sig:
        tail += 1
    return head, tail


def _table(a: Shape, b: Shape, memo: dict) -> tuple[int, int, list[list[int]]]:
    """Equal children at both ends, and the matching sizes of what is between them."""
    head, tail = _ends(a, b)
    left, right = a.kids[head:len(a.kids) - tail], b.kids[head:len(b.kids) - tail]
    m = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left, 1):
        above, row = m[i - 1], m[i]
        for j, y in enumerate(right, 1):
            row[j] = max(above[j], row[j - 1], above[j - 1] + match(x, y, memo))
    return head, tail, m


def match(a: Shape, b: Shape, memo: dict) -> int:
    """Simple tree matching: the most node pairs that keep order and ancestry. Known sizes
    are kept by the trees' signatures, so equal siblings are compared once."""
    if a.label != b.label:
        return 0
    if a.sig == b.sig:
        return a.size
    key = (a.sig, b.sig)
    if key not in memo:
        head, tail, m = _table(a, b, memo)
        memo[key] = 1 + m[-1][-1] + sum(k.size for k in a.kids[:head]) + sum(
            k.size for k in a.kids[len(a.kids) - tail:])
    return memo[key]


def aligned(a: Shape, b: Shape, memo: dict) -> list[tuple[Shape, Shape]]:
    """The matched pairs of nodes of the two trees."""
    if not match(a, b, memo):
        return []
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if x.sig == y.sig:
            todo.extend(zip(x.kids, y.kids))
            continue
        head, tail, m = _table(x, y, memo)
        todo.extend(zip(x.kids[:head], y.kids))
        todo.extend(zip(x.kids[len(x.kids) - tail:], y.kids[len(y.kids) - tail:]))
        i, j = len(m) - 1, len(m[0]) - 1
        while i and j:
            left, right = x.kids[head + i - 1], y.kids[head + j - 1]
            w = match(left, right, memo)
            if w and m[i][j] == m[i - 1][j - 1] + w:
                todo.append((left, right))
                i, j = i - 1, j - 1
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return out


def tops(root: Node, tags: tuple) -> list[Node]:
    """The outermost elements of ``tags`` in page order, without what is not the article."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.out and n is not root:
            continue
        if n.tag in tags:
            out.append(n)
        else:
            todo.extend(k for k in reversed(n.kids) if isinstance(k, Node))
    return out


def articles(root: Node) -> list[Node]:
    """All articles of a page, or its main elements."""
    return tops(root, ("article",)) or tops(root, ("main",))


def own_roots(root: Node) -> list[Node]:
    """The articles of a page by itself, or its densest container."""
    if found := articles(root):
        return found
    best, weight = root, -1
    todo = [root]
    while todo:
        n = todo.pop()
        if n.out and n is not root:
            continue
        todo.extend(k for k in n.kids if isinstance(k, Node))
        if n.tag in CONTAINERS:
            here = sum(len(" ".join(blocks(k))) for k in _block_kids(n)
                       if k.tag not in CONTAINERS and not k.out)
            if here > weight:
                best, weight = n, here
    return [best]


def _texts(nodes: list[Node]) -> list[str]:
    return [b for n in nodes if not n.out for b in blocks(n)]


def _own_text(node: Node) -> bool:
    """Whether ``node`` has text outside its block children."""
    todo = list(node.kids)
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            if k.strip():
                return True
        elif k.tag not in BLOCK and not k.out:
            todo.extend(k.kids)
    return False


def _slot(shape: Shape, fresh) -> Shape:
    """From ``shape`` down while all ``fresh`` text is in one container; what stands for
    several nodes, or has text of its own, is not left."""
    while len(shape.nodes) == 1 and not _own_text(shape.nodes[0]):
        new = [k for k in shape.kids if fresh(k)]
        if len(new) != 1 or new[0].nodes[0].tag not in CONTAINERS:
            break
        shape = new[0]
    return shape


def extract(pages: list[str]) -> list[str]:
    """Main texts of one run of pages of a host."""
    roots = [parse(p) for p in pages]
    memo: dict = {}
    shapes = [Shape([r]) for r in roots]
    if len(pages) < 2:
        return [" ".join(_texts(own_roots(r))) for r in roots]
    # copies count once, or their text would be the same everywhere and so template
    distinct = list({tuple(blocks(r)): i for i, r in reversed([*enumerate(roots)])}.values())
    if len(distinct) < 2:
        return [" ".join(_texts(own_roots(r))) for r in roots]
    # the reference has the shape that most pages have
    kinds = Counter((shapes[i].size, tuple(k.label for k in shapes[i].kids)) for i in distinct)
    common = max(kinds, key=lambda k: (kinds[k], k))
    ref = next(s for s in shapes if (s.size, tuple(k.label for k in s.kids)) == common)
    counted, partners, texts = set(distinct), [], {}
    for p, s in enumerate(shapes):
        got = aligned(ref, s, memo)
        partners.append({id(y): id(x) for x, y in got})
        if p in counted:
            for x, y in got:
                texts.setdefault(id(x), Counter())[hash(tuple(_texts(y.nodes)))] += 1
    template = {i: t for i, c in texts.items() for t, n in c.most_common(1)
                if n >= SAME * len(distinct)}
    out = []
    for root, s, partner in zip(roots, shapes, partners):
        def constant(y, partner=partner):
            x = partner.get(id(y))
            return x in template and template[x] == hash(tuple(_texts(y.nodes)))

        out.append(" ".join(_page(root, s, partner, constant, len(distinct) > 2)))
    return out


def _page(root: Node, shape: Shape, partner: dict, constant, drop: bool) -> list[str]:
    """Blocks of a page's slot without the template."""
    if not any(y.nodes[0].tag not in ("html", "body") for y in _below(shape) if id(y) in partner):
        return _texts(own_roots(root))
    slot = _slot(shape, lambda y: not constant(y) and _texts(y.nodes))
    around = [_within(n, ("article", "main")) for n in slot.nodes]
    found = articles(root)
    if all(around) and found:
        return _texts(found if any(n in found for n in around) else
                      tops(root, (around[0].tag,)) or found)
    hidden = {id(n) for y in _below(slot) if y is not slot and constant(y)
              for n in y.nodes} if drop else ()
    kept = [b for n in slot.nodes if not n.out for b in _kept(n, hidden)]
    # what is marked as the article, unless most of the text is beside it
    inside = _texts(found)
    if sum(map(len, inside)) >= (1 - MOST) * sum(map(len, kept)) and inside:
        return inside
    return kept


def _below(shape: Shape) -> list[Shape]:
    out, todo = [], [shape]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(x.kids)
    return out


def _kept(node: Node, drop) -> list[str]:
    if not drop:
        return blocks(node)
    hidden = [n for n in _all_blocks(node) if id(n) in drop and not n.out]
    for n in hidden:
        n.out = True
    got = blocks(node)
    for n in hidden:
        n.out = False
    return got


def _all_blocks(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, Node):
                out.append(k)
                todo.append(k)
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", run: int = RUN) -> DataFrame:
    """(id, url, text, n_chars) for every row of ``pages``."""
    host, _ = host_and_path(F.col(url_col))
    src = pages.select(host.alias("_host"), F.col(id_col).alias("_id"), F.col(url_col).alias("_url"),
                       F.col(html_col).alias("_html"))
    # hosts of several runs, by their pages and by their html; the others have run 0 only
    counts = written(src.groupBy("_host").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / run), F.ceil(F.sum(F.length("_html")) / HELD)).cast("int").alias("_runs"))
                     .where("_runs > 1"), "large-hosts")
    few = counts.count() <= BROADCAST_HOSTS
    kinds = {c: src.schema[c].dataType.simpleString() for c in ("_id", "_url")}
    rows = (src.join(F.broadcast(counts) if few else counts, "_host", "left")
            .select("_host", F.pmod(F.xxhash64("_id", "_url"), F.coalesce("_runs", F.lit(1)))
                    .cast("int").alias("_run"),
                    "_id", "_url", "_html"))

    def induce(batches):
        for _, group in runs_of(batches, 2):
            yield result(list(group))

    def result(held):
        texts = extract([r[4] or "" for r in held])
        return pa.RecordBatch.from_arrays(
            [pa.array([r[2] for r in held], types[0]), pa.array([r[3] for r in held], types[1]),
             pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[id_col, url_col, "text", "n_chars"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(src.schema[c].dataType) for c in ("_id", "_url")]
    return (rows.repartition("_host", "_run").sortWithinPartitions("_host", "_run", "_id", "_url")
            .mapInArrow(induce, f"`{id_col}` {kinds['_id']}, `{url_col}` {kinds['_url']}, "
                                "text string, n_chars long"))
