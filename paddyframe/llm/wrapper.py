"""Main text of web pages by wrapper induction per host.

Pages are parsed into trees whose neighbouring siblings of one label are folded
into one repeated node.  All different pages of a host and layout (the
containers around the text) are aligned with the layout's first one by simple
tree matching; a text that stands at the same aligned node in nearly all of them
is template, all else is a varying slot.  Each page is then aligned with its
layout's wrapper (in a rare layout, that of the host's commonest), and its blocks are the main
text if they are no template, lie in no element made for something else
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
comments, by tag, role or class), and lie in the article where the page marks
one that holds a quarter of what is left at least.  Pages without such a mark lose blocks that are mostly links.  A form, like an
element with a menu's or a notice's name, goes only if it holds neither the article nor most of the text.

Character references are decoded, white space in a block becomes one space,
blocks are joined by an empty line; nothing is cut.

Defined cases: null or empty html has no text; a null url counts as a host of
its own; hosts without a layout of MIN_PAGES different pages have no template; a page whose
every block is template keeps them; broken markup (missing ends, cut tails) is closed where HTML would
close it; repeated rows get equal results; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import html as entities
import pickle
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C

MIN_PAGES = 4
NEARLY_ALL = 0.9        # share of a layout's pages that hold a template text
LEAST_ALIGNED = 0.2     # share of them that align with the layout's first one, at least
SAME_LAYOUT = 0.5       # share of nodes that must align for a page to count for the wrapper
LEAST_MARKED = 0.25     # share of the text that lies in articles from which on they mark the main text
ROWS_AT_ONCE = 4096     # child pairs from which a table of alignments is computed by whole rows

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 "
                     "h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("thead", "tbody", "tr", "td", "th"),
           "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("table ul ol dl select article section main div body html".split())
# what is no main text
NOT_TEXT = frozenset("nav footer aside script style noscript template head button select option input textarea iframe dialog menu "
                     "svg canvas object audio video title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu "
                  "breadcrumb breadcrumbs sidebar aside widget footer cookie cookies consent gdpr notice notices notification "
                  "alert banner popup modal overlay share sharing social newsletter subscribe subscription signup login search comment comments "
                  "discussion disqus replies respond related recommended pagination pager skip toolbar masthead topbar hidden".split())
TOP_WORDS = frozenset("header".split())     # no main text outside of the article only
ARTICLE = frozenset("article main".split())
WHOLE = ARTICLE | {"html", "body"}
# what makes a layout
FRAME = frozenset("div section header main article nav aside footer form center".split())
_NUMBER = re.compile(r"\d{3,}")      # a page's own number in a class name

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """An element (or a run of folded siblings): label, texts of its blocks, children."""

    __slots__ = ("label", "texts", "kids", "const", "shape", "size")

    def __init__(self, label: str):
        self.label, self.texts, self.kids, self.const, self.shape, self.size = label, [], [], None, None, 1


class Block:
    __slots__ = ("text", "links", "skip", "inside", "node")

    def __init__(self, text, links, skip, inside, node):
        self.text, self.links, self.skip, self.inside, self.node = text, links, skip, inside, node


def _is_skipped(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """By tag, role or attribute."""
    if tag in NOT_TEXT or (tag == "header" and not inside) or attrs.get("role", "").lower() in ROLES:
        return True
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"


def _is_named(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """A form, or by a word of its class or id; what holds the main text is never."""
    if tag in WHOLE:
        return False
    if tag == "form":
        return True
    words = {w.lower() for k in ("class", "id") for w in _SPLIT.split(attrs.get(k, "")) if w}
    return bool(words & WORDS) or (not inside and bool(words & TOP_WORDS))


def parse(html: str) -> tuple[Node, list[Block]]:
    """The folded tree and the text blocks in page order, each with its node in the tree."""
    root = Node("#")
    # open elements: [tag, tree node, skipped, inside the article, is inline, number among the named]
    stack: list[list] = [["#", root, False, False, False, None]]
    named: list[int | None] = []    # characters in the elements that a word names, None: with the page's article inside
    within: list[list[int]] = []    # the named elements around each block
    total = 0
    blocks: list[Block] = []
    buf: list[str] = []
    links = 0       # characters of the block that stand in links

    def flush():
        nonlocal links, total
        if buf:
            text = " ".join("".join(buf).split())
            buf.clear()
            if text:
                top = next(e for e in reversed(stack) if not e[4])
                blocks.append(Block(text, links, any(e[2] for e in stack), top[3], top[1]))
                top[1].texts.append(text)
                within.append([e[5] for e in stack if e[5] is not None])
                if not blocks[-1].skip:
                    total += len(text)
                    for i in within[-1]:
                        if named[i] is not None:
                            named[i] += len(text)
            links = 0

    def add(raw: str):
        nonlocal links
        if raw:
            text = entities.unescape(raw)
            buf.append(text)
            if any(e[0] == "a" for e in stack[1:]):
                links += len(text)

    def close(depth: int):
        while len(stack) > depth:
            if not stack[-1][4]:
                flush()
            stack.pop()

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        m = _TOKEN.match(html, lt)
        if not m:       # a bare sign
            add(html[at:lt + 1])
            at = lt + 1
            continue
        add(html[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if stack[depth][0] in SCOPE and tag in INLINE | {"p", "li"}:
                    break
            continue
        if tag == "br":
            buf.append(" ")
            continue
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m[3])} if m[3] else {}
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag not in INLINE:
            if tag in CLOSES_P:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == "p":
                        close(depth)
                        break
                    if stack[depth][0] in SCOPE:
                        break
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in IMPLIED.get(tag, ()):
                    close(depth)
                elif stack[depth][0] in SCOPE:
                    break
            flush()
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in CLOSES_P:
            continue
        inside = stack[-1][3] or tag in ARTICLE
        inline = tag in INLINE
        parent = stack[-1][1]
        if inline:
            node = parent
        else:
            names = [] if tag in ("html", "body") else sorted(set(_NUMBER.sub("#", attrs.get("class", "")).split()))
            label = tag + "".join(f".{w}" for w in names)
            if parent.kids and parent.kids[-1].label == label:
                node = parent.kids[-1]      # a run of like siblings is one repeated node
            else:
                node = Node(label)
                parent.kids.append(node)
        if tag in ARTICLE and not any(e[0] == "article" or e[2] for e in stack):
            for e in stack:
                if e[5] is not None:
                    named[e[5]] = None
        number = None
        if _is_named(tag, attrs, stack[-1][3]):
            number = len(named)
            named.append(0)
        stack.append([tag, node, _is_skipped(tag, attrs, stack[-1][3]), inside, inline, number])
    close(1)
    flush()
    for b, around in zip(blocks, within):
        # an element around the article or most of the text is no menu or notice, whatever its name
        b.skip = b.skip or any(named[i] is not None and 2 * named[i] <= total for i in around)
    return root, blocks


def key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def layout(tree: Node) -> int:
    """Signature of the two outermost levels at which containers differ, whatever their order and number."""
    def frames(n: Node) -> list[Node]:
        out, todo = [], n.kids[::-1]
        while todo:
            k = todo.pop()
            if k.label in ("html", "body"):
                todo += k.kids[::-1]
            elif k.label.split(".")[0] in FRAME:
                out.append(k)
        return out

    path, outer = [], frames(tree)
    while len(outer) == 1 and outer[0].label.split(".")[0] not in ARTICLE and frames(outer[0]):
        path.append(outer[0].label)
        outer = frames(outer[0])
    inner = {f"{n.label}>{k.label}" for n in outer if n.label.split(".")[0] not in ARTICLE for k in frames(n)}
    return key("\n".join([*path, "", *sorted({n.label for n in outer}), "", *sorted(inner)]))


def _nodes(n: Node) -> list[Node]:
    """All nodes in page order."""
    out, todo = [], [n]
    while todo:
        out.append(todo.pop())
        todo += out[-1].kids[::-1]
    return out


def _slim(n: Node) -> Node:
    """The tree with its texts' keys."""
    for x in _nodes(n):
        x.texts = sorted({key(t) for t in x.texts})
    return n


def _flat(n: Node) -> tuple:
    """The tree as lists in page order: labels, numbers of children, texts, template texts."""
    nodes = _nodes(n)
    return [x.label for x in nodes], [len(x.kids) for x in nodes], [x.texts for x in nodes], [x.const for x in nodes]


def _tree(flat: tuple) -> Node:
    """``_flat``'s tree."""
    root, open_ = None, []      # open_: [node, children to come]
    for label, kids, texts, const in zip(*flat):
        node = Node(label)
        node.texts, node.const = texts, const
        while open_ and not open_[-1][1]:
            open_.pop()
        if open_:
            open_[-1][0].kids.append(node)
            open_[-1][1] -= 1
        else:
            root = node
        open_.append([node, kids])
    return root


def _size(n: Node) -> int:
    return _measured(n).size


def _measured(n: Node) -> Node:
    """The tree with every node's size and shape (equal for trees of equal labels)."""
    if n.shape is None:
        for x in reversed(_nodes(n)):
            x.size = 1 + sum(k.size for k in x.kids)
            x.shape = hash((x.label, *(k.shape for k in x.kids)))
    return n


def _ends(a: Node, b: Node) -> tuple[int, int]:
    """How many first and last children have equal trees: some largest alignment pairs those."""
    x, y, n = a.kids, b.kids, min(len(a.kids), len(b.kids))
    first = 0
    while first < n and x[first].shape == y[first].shape:
        first += 1
    last = 0
    while last < n - first and x[-1 - last].shape == y[-1 - last].shape:
        last += 1
    return first, last


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the largest order-preserving alignment of two trees, and its node pairs.

    Trees may be of any depth and width: pairs of nodes wait on a stack until those of their children are told.
    """
    if a.label != b.label:
        return 0, []
    _measured(a), _measured(b)
    told: dict[tuple[int, int], tuple[int, list[tuple[Node, Node]]]] = {}    # (score, aligned children)
    todo = [(a, b, False)]
    while todo:
        x, y, ready = todo.pop()
        if x.shape == y.shape or (id(x), id(y)) in told:
            continue
        first, last = _ends(x, y)
        xs, ys = x.kids[first:len(x.kids) - last], y.kids[first:len(y.kids) - last]
        if ready:
            ends = [*zip(x.kids[:first], y.kids[:first]), *zip(x.kids[len(x.kids) - last:], y.kids[len(y.kids) - last:])]
            score, middle = _aligned(xs, ys, told)
            told[id(x), id(y)] = (1 + sum(k.size for k, _ in ends) + score, middle + ends)
            continue
        todo.append((x, y, True))
        with_kids: dict[str, list[Node]] = {}
        for k in ys:
            if k.kids:
                with_kids.setdefault(k.label, []).append(k)
        todo += [(k, j, False) for k in xs if k.kids for j in with_kids.get(k.label, ())]
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.shape == y.shape:
            pairs += zip(_nodes(x), _nodes(y))
        else:
            pairs.append((x, y))
            todo += told.get((id(x), id(y)), (1, []))[1]     # a node without children aligns alone
    return _score(a, b, told), pairs


def _score(x: Node, y: Node, told: dict) -> int:
    """Score of two nodes of one label."""
    if x.shape == y.shape:
        return x.size
    return told[id(x), id(y)][0] if x.kids and y.kids else 1


def _aligned(xs: list[Node], ys: list[Node], told: dict) -> tuple[int, list[tuple[Node, Node]]]:
    """The best order-preserving alignment of two lists of children: a row of the table at a time; of the table only
    two bits a cell are kept, whether it equals the one above and the one before."""
    m, n = len(xs), len(ys)
    at: dict[str, list[int]] = {}
    for j, y in enumerate(ys):
        at.setdefault(y.label, []).append(j)
    if not any(x.label in at for x in xs):
        return 0, []
    wide = m * n > ROWS_AT_ONCE
    best, above, before = np.zeros(n + 1, np.int64) if wide else [0] * (n + 1), [], []
    for x in xs:
        if wide:
            new = best.copy()
            if j := at.get(x.label):
                j = np.array(j)
                new[j + 1] = np.maximum(new[j + 1], best[j] + np.array([_score(x, ys[k], told) for k in j.tolist()]))
                new = np.maximum.accumulate(new)
            above.append(np.packbits(new == best))
            before.append(np.packbits(np.append(False, new[1:] == new[:-1])))
        else:
            new = best[:]
            for j in at.get(x.label, ()):
                new[j + 1] = max(new[j + 1], best[j] + _score(x, ys[j], told))
            for j in range(n):
                new[j + 1] = max(new[j + 1], new[j])
            above.append([p == q for p, q in zip(new, best)])
            before.append([False] + [p == q for p, q in zip(new[1:], new)])
        best = new
    bit = (lambda row, j: row[j >> 3] >> (7 - (j & 7)) & 1) if wide else (lambda row, j: row[j])
    pairs, i, j = [], m, n
    while i and j:
        if bit(above[i - 1], j):
            i -= 1
        elif bit(before[i - 1], j):
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((xs[i], ys[j]))
    return int(best[n]), pairs


def induce(pages: list[str]) -> Node | None:
    """Wrapper of few same-host pages: the first one's tree; ``const`` holds the keys of a node's template texts."""
    trees = [_slim(parse(p)[0]) for p in pages]
    if len(trees) < MIN_PAGES:
        return None
    ref, seen = trees[0], 1
    nodes = _nodes(ref)
    for n in nodes:
        n.const = set(n.texts)
    for t in trees[1:]:
        score, pairs = match(ref, t)
        if score < SAME_LAYOUT * max(_size(ref), _size(t)):
            continue    # another layout
        seen += 1
        own = {id(x): set(y.texts) for x, y in pairs}
        for x in nodes:
            x.const &= own.get(id(x), set())
    if seen < MIN_PAGES or not any(n.const for n in nodes):
        return None
    for n in nodes:
        n.texts = []
    return ref


def main_text(html: str | None, wrapper: Node | dict | None) -> str:
    """The page's main text by a wrapper, or by that of its layout among its host's (None: the commonest layout's)."""
    if not html:
        return ""
    tree, blocks = parse(html)
    if isinstance(wrapper, dict):
        wrapper = wrapper.get(layout(tree), wrapper[None])
    kept = [b for b in blocks if not b.skip]
    marked = [b for b in kept if b.inside]
    if marked and LEAST_MARKED * sum(len(b.text) for b in kept) <= sum(len(b.text) for b in marked):
        kept = marked       # a mark around less (a teaser's, say) does not mark the main text
    else:
        kept = [b for b in kept if b.links <= 0.6 * len(b.text)]
    if wrapper is not None:
        score, pairs = match(wrapper, tree)
        const = {id(y): x.const for x, y in pairs if x.const}
        varying = [b for b in kept if key(b.text) not in const.get(id(b.node), ())]
        kept = varying or kept
    return "\n\n".join(b.text for b in kept)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of hosts that have one: their layouts' wrappers, from all different pages."""
    def read(batches):
        for pdf in batches:
            trees = [_slim(parse(h)[0]) for h in pdf.html]
            yield pd.DataFrame({"host": pdf.host, "h": pdf.h, "layout": [layout(t) for t in trees],
                                "tree": [C.squeeze(pickle.dumps(_flat(t))) for t in trees]})

    def align(batches):
        for pdf in batches:
            rows = []
            for host, lay, n, first, tree in zip(pdf.host, pdf.layout, pdf.n, pdf["first"], pdf.tree):
                ref, own = _load(first), _tree(pickle.loads(C.unsqueeze(tree)))
                score, pairs = match(ref, own)
                if score < SAME_LAYOUT * max(_size(ref), _size(own)):
                    continue
                rows.append((host, lay, n, -1, 0))
                number = {id(x): i for i, x in enumerate(_nodes(ref))}
                rows += [(host, lay, n, number[id(x)], t) for x, y in pairs for t in y.texts]
            yield pd.DataFrame(rows, columns=["host", "layout", "n", "node", "text"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        known = {}
        for _, rows in sorted(pdf.groupby("layout"), key=lambda x: (-x[1].n.iloc[0], x[0])):
            aligned = rows.c[rows.node == -1].sum()
            rows = rows[(rows.node >= 0) & (rows.c >= max(MIN_PAGES, NEARLY_ALL * aligned))]
            if aligned < MIN_PAGES or not len(rows):
                continue
            ref = _tree(pickle.loads(C.unsqueeze(rows["first"].iloc[0])))
            nodes = _nodes(ref)
            for x in nodes:
                x.texts, x.const = [], set()
            for i, t in zip(rows.node.tolist(), rows.text.tolist()):
                nodes[i].const.add(t)
            known[rows.layout.iloc[0]] = _flat(ref)
            known.setdefault(None, _flat(ref))
        out = [(pdf.host.iloc[0], C.squeeze(pickle.dumps(known)))] if known else []
        return pd.DataFrame(out, columns=["host", "wrapper"], dtype=object)

    slim = pages.filter(F.length("html") > 0).select("host", "html", F.xxhash64("html").alias("h"))
    # equal pages count once; trees of labels and text keys travel, no pages
    trees = C.materialize(slim.mapInPandas(read, "host string, h long, layout long, tree binary")
                          .dropDuplicates(["host", "layout", "h"]), "trees")
    layouts = C.materialize(trees.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n"), F.min_by("tree", "h").alias("first"))
                            .filter(F.col("n") >= MIN_PAGES), "layouts")
    texts = trees.join(layouts, ["host", "layout"]).select("host", "layout", "n", "first", "tree").mapInPandas(
        align, "host string, layout long, n long, node long, text long")
    common = (texts.groupBy("host", "layout", "n", "node", "text").agg(F.count(F.lit(1)).alias("c"))
              .filter((F.col("c") >= MIN_PAGES) & (F.col("c") >= LEAST_ALIGNED * NEARLY_ALL * F.col("n"))))
    return (common.join(layouts.select("host", "layout", "first"), ["host", "layout"])
            .groupBy("host").applyInPandas(learn, "host string, wrapper binary"))


@lru_cache(256)
def _load(raw: bytes):
    got = pickle.loads(C.unsqueeze(raw))
    return {k: _tree(v) for k, v in got.items()} if isinstance(got, dict) else _tree(got)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    spark = pages.sparkSession
    C.small_batches(spark)
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"), host.alias("host"))
    known = C.materialize(wrappers(slim), "wrappers")

    def run(batches):
        for pdf in batches:
            text = [main_text(h, _load(w) if w else None) for h, w in zip(pdf.html, pdf.wrapper)]
            yield pd.DataFrame({"page_id": pdf.page_id, "url": pdf.url, "text": text})

    return slim.join(known, "host", "left").select("page_id", "url", "html", "wrapper").mapInPandas(
        run, "page_id long, url string, text string")
