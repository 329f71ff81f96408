"""Main text of web pages: a tree-structured graphical model over the page's elements.

The article stays; menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, markup and reader comments go. Character references are decoded,
white space (also no-break spaces) inside a block becomes one space, blocks are joined
in page order by one space. Nothing of the article is dropped or capped.

Method. A page becomes a tree of its block elements; inline elements belong to their
block. Each node is content or not. Unary potentials come from its tag, the words of its
class, id and role, its own text and links and its share of the page; pairwise
potentials between parent and child depend on the kind of child. Sum-product
messages up and down the tree give each node's marginal; text whose node is at
least 0.5 is kept. Weights are fitted by maximum likelihood: the gradient is observed
minus expected features, the expectation by the same messages.

Labelled pages are html with ``data-main="1"`` or ``"0"`` on elements, which holds for all
below them; an element without a mark has the label of most of its text. ``relaid`` derives
such pages from the table itself: texts of at most ``SAMPLE`` different pages
(the least hashes), each laid out ``LAYOUTS`` times with drawn tags, names,
nesting, inserts and unclosed tags, so that labels are known by construction and no name
or tag alone decides. A layout uses at most ``BLOCKS`` texts. Own labelled pages go
to ``fit`` the same way. Everything else reads all pages whole.

Scale. Pages are read where they lie; nothing is shuffled but the sample. A task works
through slices of about 4 MB. The driver fits on at most SAMPLE * LAYOUTS
small pages.

Null and empty pages give an empty text, as do pages without content. Repeated rows give
repeated results. Elements nested over ``DEEPEST`` deep count as children of the last
level. Broken markup is read as browsers do in the usual cases: unclosed p, li and cells
end where the next begins, stray end tags are ignored, an unclosed script runs to the end.
Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import html as references
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import chunks

SAMPLE = 200
LAYOUTS = 4
BLOCKS = 24
DEEPEST = 200
STEPS = 200
RATE = 0.1
RIDGE = 1e-4

_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names of HTML by how they are laid out.
_RAW = "script style textarea title xmp iframe noembed noframes".split()
_SILENT = frozenset("template noscript svg math select button object audio video canvas datalist head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var".split()
)
_KINDS = (
    "nav|header|footer|aside|form fieldset|article|main|section|div|body html|p|h1|h2 h3 h4 h5 h6|ul ol dl|li dd dt|"
    "table tbody thead tfoot tr|td th|blockquote pre figure figcaption details|span label"
).split("|")
_OUTSIDE = [0, 2, 3, 4]
_INSIDE = [5, 6]
_KIND = {name: k for k, names in enumerate(_KINDS) for name in names.split()}
# An element of the key ends an open one of the values, up to the nearest of the third.
_ENDS = {
    "li": ("li", "ul ol"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
# Words of class, id and role, by what they name.
_NAMES = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs topbar toolbar toc pagination pager skip tabs",
    "header": "header masthead branding logo banner top hero head",
    "footer": "footer foot copyright legal bottom colophon contentinfo",
    "side": "sidebar side aside rail widget widgets complementary secondary",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription paywall privacy disclaimer dialog message",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion dfp adsense adslot",
    "form": "form search login signup register contact input poll survey",
    "comment": "comment comments commentlist reply replies respond discussion disqus responses thread reader",
    "related": "related recommended recommendations share sharing social follow tags popular trending teaser more",
    "content": "article content post entry story main text body page copy prose",
}
_LEXICON = {w: k for k, words in enumerate(_NAMES.values()) for w in words.split()}
_MARKS = len(_NAMES)
_TEXT_STEPS = (1, 5, 15, 40)
_SHARES = (0.02, 0.2, 0.5, 0.8)
FEATURES = 1 + len(_KINDS) + 1 + _MARKS + len(_TEXT_STEPS) + 3 + len(_SHARES) + 8
# Kinds of child for the pairwise potentials: named as no content, sections, texts, the rest.
GROUPS = 4


class Tree(NamedTuple):
    """Nodes of a page in page order, and its text.

    ``pieces`` are (node, text, whether a block border lies before it).
    """

    parent: list[int]
    depth: list[int]
    kind: list[int]
    marks: list[int]
    label: list[int]
    links: list[int]
    pieces: list[tuple[int, str, bool]]


def _names(attributes: str) -> tuple[int, bool, int]:
    """(marks, hidden, label) from an element's attributes."""
    marks, hidden, label = 0, False, -1
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id", "role"):
            for word in _NAME.findall(value):
                k = _LEXICON.get(word.lower())
                if k is not None:
                    marks |= 1 << k
        elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        elif key == "data-main":
            label = int(value == "1")
    return marks, hidden, label


def parse(html: str) -> Tree:
    """The page's block elements as a tree. Nodes are numbered in page order; 0 is the page."""
    tree = Tree([-1], [0], [len(_KINDS)], [0], [-1], [0], [])
    # open elements: (name, node, block, silent, link), and where the blocks are
    stack = [("", 0, True, False, False)]
    blocks = [0]
    open_names: dict[str, int] = {"": 0}
    border = True
    # no tag begins after the last end of one
    at, size, last = 0, len(html), html.rfind(">") + 1

    def close(n: int) -> None:
        nonlocal border
        while len(stack) > n:
            name, _, block, *_ = stack.pop()
            open_names[name] -= 1
            if block:
                blocks.pop()
                border = True

    def text(piece: str) -> None:
        nonlocal border
        _, node, _, silent, link = stack[-1]
        if silent or not piece:
            return
        piece = references.unescape(piece)
        tree.pieces.append((node, piece, border))
        border = False
        if link:
            tree.links[node] += len(piece.strip())

    while at < size:
        found = _TAG.search(html, at, last)
        if found is None:
            text(html[at:])
            break
        text(html[at : found.start()])
        at = found.end()
        if found[0].startswith("<!--") and not found[0].endswith(">"):
            break
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        attributes = found[3] if found[2] else found[6]
        if found[1] or found[4]:
            if name not in _INLINE:
                border = True
            if open_names.get(name):
                k = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name)
                if name in _INLINE and blocks[-1] > k:
                    # a block that is still open began inside
                    open_names[name] -= 1
                    stack[k] = ("", *stack[k][1:])
                    open_names[""] += 1
                else:
                    close(k)
            continue
        if name in _VOID:
            border |= name in ("br", "hr")
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = size if end is None else end.end()
            border |= name not in ("script", "style")
            continue
        marks, hidden, label = _names(attributes) if attributes.strip(" /\n") else (0, False, -1)
        block = name not in _INLINE
        if block:
            border = True
            if stack[blocks[-1]][0] == "p":
                close(blocks[-1])
            if name in _ENDS and any(open_names.get(x) for x in _ENDS[name][0]):
                ended, until = _ENDS[name]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in until:
                        break
                    if stack[i][0] in ended:
                        close(i)
                        break
        _, node, _, silent, link = stack[-1]
        silent = silent or hidden or name in _SILENT
        if not silent and (block or (marks and name != "a")):
            above = node if tree.depth[node] < DEEPEST else tree.parent[node]
            tree.parent.append(above)
            tree.depth.append(tree.depth[above] + 1)
            tree.kind.append(_KIND.get(name, len(_KINDS)))
            tree.marks.append(marks)
            tree.label.append(label if label >= 0 else tree.label[above])
            tree.links.append(0)
            node = len(tree.parent) - 1
        if block:
            blocks.append(len(stack))
        stack.append((name, node, block, silent, link or name == "a"))
        open_names[name] = open_names.get(name, 0) + 1
    return tree


class Forest(NamedTuple):
    """Nodes of several pages: features, parents, kinds of child, labels, nodes by depth, first node of each page."""

    x: np.ndarray
    parent: np.ndarray
    group: np.ndarray
    label: np.ndarray
    by_depth: list[np.ndarray]
    first: np.ndarray


def forest(trees: list[Tree]) -> Forest:
    """Features of all nodes; see the module for what they look at."""
    sizes = np.array([len(t.parent) for t in trees], np.int64)
    first = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    page = np.repeat(np.arange(len(trees)), sizes)

    def column(pick) -> np.ndarray:
        return np.fromiter((v for t in trees for v in pick(t)), np.int64, n)

    parent = column(lambda t: t.parent)
    root = parent < 0
    parent = np.where(root, -1, parent + first[page])
    depth, kind, marks = column(lambda t: t.depth), column(lambda t: t.kind), column(lambda t: t.marks)
    label, links = column(lambda t: t.label), column(lambda t: t.links)
    words, chars, stops = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, t in enumerate(trees):
        for node, piece, _ in t.pieces:
            i = first[k] + node
            piece = piece.strip()
            words[i] += piece.count(" ") + 1 if piece else 0
            chars[i] += len(piece)
            if piece:
                stops[i] = piece[-1] in ".!?:;\"'”’…。)"
    by_depth = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)] if n else []
    below, linked = chars.copy(), links.copy()
    marked = np.where(label == 1, chars, 0)
    for nodes in reversed(by_depth[1:]):
        for total in (below, linked, marked):
            np.add.at(total, parent[nodes], total[nodes])
    whole = np.maximum(below[first][page], 1)
    share = below / whole
    order = np.cumsum(chars) - chars
    place = (order - order[first][page]) / whole
    most = np.zeros(n, np.int64)
    inner = np.flatnonzero(~root)
    np.maximum.at(most, parent[inner], below[inner])
    largest = np.zeros(n, bool)
    largest[inner] = (below[inner] == most[parent[inner]]) & (below[inner] > 0)
    bit = (marks[:, None] >> np.arange(_MARKS)) & 1
    named = bit[:, : _MARKS - 1].any(1)
    # what the nearest element with a telling tag or name says, and whether any above says no
    no = named | np.isin(kind, _OUTSIDE)
    yes = ~no & (np.isin(kind, _INSIDE) | (bit[:, -1] == 1))
    nearest, under = np.where(no, -1, yes.astype(np.int64)), np.zeros(n, bool)
    for nodes in by_depth[1:]:
        above = parent[nodes]
        under[nodes] = under[above] | no[above]
        nearest[nodes] = np.where(nearest[nodes] == 0, nearest[above], nearest[nodes])
    x = np.column_stack(
        [
            np.ones(n),
            kind[:, None] == np.arange(len(_KINDS) + 1),
            bit,
            words[:, None] >= np.array(_TEXT_STEPS),
            links > 0.5 * np.maximum(chars, 1),
            linked > 0.4 * np.maximum(below, 1),
            stops,
            share[:, None] >= np.array(_SHARES),
            largest,
            place < 0.05,
            place > 0.95,
            below == 0,
            nearest > 0,
            nearest < 0,
            under,
            (kind == _KIND["header"]) & (nearest > 0),
        ]
    ).astype(np.float32)
    section = kind < _KIND["p"]
    text = (kind >= _KIND["p"]) & (kind < len(_KINDS))
    group = np.select([named, section, text], [0, 1, 2], 3)
    # an element without a mark is what most of its text is
    label = np.where(label < 0, 2 * marked > below, label)
    return Forest(x, parent, group, label, by_depth, first)


class Model(NamedTuple):
    """Weights of the unary potential of content, and [kind of child, parent, child] potentials."""

    unary: np.ndarray
    pair: np.ndarray


def marginals(model: Model, woods: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Probability of content per node, and [parent, child] probabilities per node that has a parent."""
    n = len(woods.x)
    own = np.zeros((n, 2))
    own[:, 1] = woods.x @ model.unary
    up, message = own.copy(), np.zeros((n, 2))
    for nodes in reversed(woods.by_depth[1:]):
        both = model.pair[woods.group[nodes]] + up[nodes][:, None, :]
        message[nodes] = np.logaddexp(both[:, :, 0], both[:, :, 1])
        np.add.at(up, woods.parent[nodes], message[nodes])
    belief, edge = up.copy(), np.zeros((n, 2, 2))
    for nodes in woods.by_depth[1:]:
        rest = belief[woods.parent[nodes]] - message[nodes]
        both = rest[:, :, None] + model.pair[woods.group[nodes]] + up[nodes][:, None, :]
        both -= both.max((1, 2), keepdims=True)
        both -= np.log(np.exp(both).sum((1, 2), keepdims=True))
        edge[nodes] = np.exp(both)
        belief[nodes] = np.logaddexp(both[:, 0], both[:, 1])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), edge


def fit_forest(woods: Forest, steps: int = STEPS) -> Model:
    """Maximum likelihood by gradient steps (Adam), with a small ridge."""
    unary, pair = np.zeros(FEATURES), np.zeros((GROUPS, 2, 2))
    n = max(len(woods.x), 1)
    child = np.flatnonzero(woods.parent >= 0)
    seen_pair = np.zeros_like(pair)
    np.add.at(seen_pair, (woods.group[child], woods.label[woods.parent[child]], woods.label[child]), 1.0)
    seen = woods.x.T @ woods.label
    moment, square = np.zeros(FEATURES + pair.size), np.zeros(FEATURES + pair.size)
    for step in range(1, steps + 1):
        content, edge = marginals(Model(unary, pair), woods)
        expected = np.zeros_like(pair)
        np.add.at(expected, woods.group[child], edge[child])
        slope = np.concatenate([seen - woods.x.T @ content, (seen_pair - expected).ravel()]) / n
        slope -= RIDGE * np.concatenate([unary, pair.ravel()])
        moment = 0.9 * moment + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        unary = unary + move[:FEATURES]
        pair = pair + move[FEATURES:].reshape(pair.shape)
    return Model(unary, pair)


# --- labelled pages from the table's own texts ------------------------------------------------


def _texts(html: str) -> list[str]:
    """Some texts of a page's blocks."""
    blocks = [" ".join(piece.split()) for _, piece, _ in parse(html).pieces]
    return [b for b in blocks if b]


class _Layout:
    """Draws one labelled page from texts."""

    def __init__(self, texts: list[str], seed: int):
        self.rng = random.Random(seed)
        self.texts = [references.escape(t, quote=False) for t in texts] or ["text"]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def short(self) -> str:
        words = self.rng.choice(self.texts).split()
        k = self.rng.randrange(len(words))
        return " ".join(words[k : k + self.rng.randint(1, 4)])

    def sentence(self) -> str:
        words = self.rng.choice(self.texts).split()
        return " ".join(words[: self.rng.randint(3, 40)])

    def name(self, kind: str, p: float = 0.85) -> str:
        if not self.chance(p):
            return ""
        word = self.rng.choice(_NAMES[kind].split())
        word = self.rng.choice(["{}", "site-{}", "{}-1", "{}Box", "{} wide", "js_{}"]).format(word)
        return f' {self.rng.choice(["class", "class", "id"])}="{word}"'

    def links(self) -> str:
        items = [f'<a href="/{i}">{self.short()}</a>' for i in range(self.rng.randint(2, 9))]
        form = self.rng.randrange(3)
        if form == 0:
            return "<ul>" + "".join(f"<li>{x}" + self.rng.choice(["</li>", ""]) for x in items) + "</ul>"
        return (" | " if form == 1 else " ").join(items)

    def outside(self, kind: str) -> str:
        """A part that is no content. A plain tag must have a name, or the part could not be told."""
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind, "div")
        if self.chance(0.4):
            tag = self.rng.choice(["div", "div", "section"])
        plain = tag in ("div", "section")
        body = {
            "menu": self.links,
            "related": lambda: f"<h3>{self.short()}</h3>" * self.chance(0.5) + self.links(),
            "header": lambda: self.rng.choice(["<h1>{}</h1>", "<p>{}</p>", "<div>{}</div>"]).format(self.short()) + (self.links() if self.chance(0.4) else ""),
            "footer": lambda: f"&copy; {self.short()} &middot; {self.sentence()}" if self.chance(0.6) else f"<p>{self.sentence()}</p>" + self.links(),
            "side": lambda: f"<h2>{self.short()}</h2><p>{self.sentence()}</p>" + (self.links() if self.chance(0.6) else ""),
            "notice": lambda: self.rng.choice(["{}", "<p>{}</p>"]).format(self.sentence()) + "<button>OK</button>" * self.chance(0.5),
            "advert": lambda: self.rng.choice(["{}", "<p>{}</p>", "<a href='/x'>{}</a>"]).format(self.sentence()),
            "form": lambda: f"<label>{self.short()}</label><input name=q>" + f"<p>{self.sentence()}</p>" * self.chance(0.4),
            "comment": lambda: "".join(
                self.rng.choice(
                    [
                        "<article class=comment><p>{}</p></article>",
                        '<div class="comment"><b>{}</b><p>{}</p></div>',
                        "<li>{}<p>{}</p></li>",
                        "<p>{}</p>",
                    ]
                ).format(self.sentence(), self.sentence())
                for _ in range(self.rng.randint(1, 5))
            ),
        }[kind]()
        return f'<{tag}{self.name(kind, 1.0 if plain else 0.5)} data-main="0">{body}</{tag}>'

    def paragraph(self) -> str:
        text = self.rng.choice(self.texts) if self.chance(0.7) else self.sentence() if self.chance(0.6) else self.short()
        forms = ["<p>{}</p>"] * 8 + ["<p><b>{}<br>", "<p>{}", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>"]
        forms += ["<h2>{}</h2>", "<p class=lead>{}</p>", "<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>"]
        forms += ["<ul><li>{}</li><li>x</li></ul>", "<table><tr><td>{}</td><td>1</td></tr></table>", "{}<br>", "<p>{} <a href='/y'>more</a></p>"]
        return self.rng.choice(forms).format(text)

    def article(self) -> str:
        parts = [f"<h1>{self.sentence()}</h1>"] if self.chance(0.8) else []
        if parts and self.chance(0.15):
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(self.rng.randint(1, 12)):
            parts.append(self.paragraph())
            if self.chance(0.06):
                parts.append(self.outside(self.rng.choice(["advert", "side", "related", "notice", "form", "menu", "comment"])))
        tag = self.rng.choice(["article", "article", "main", "div", "div", "section", "td"])
        name = self.name("content", 0.8 if tag in ("div", "td", "section") else 0.3)
        inner = "".join(parts)
        whole = f'<{tag}{name} data-main="1">{inner}</{tag}>'
        if tag == "td":
            whole = f"<table><tr>{whole}</tr></table>"
        if self.chance(0.15):
            whole = f"<main>{whole}</main>"
        return whole

    def page(self) -> str:
        kinds = [("menu", 0.8), ("header", 0.6), ("notice", 0.35), ("form", 0.3), ("advert", 0.5), ("side", 0.3)]
        before = [self.outside(k) for k, p in kinds if self.chance(p)]
        kinds = [("comment", 0.45), ("side", 0.4), ("related", 0.4), ("advert", 0.3), ("notice", 0.2), ("form", 0.2), ("footer", 0.8)]
        after = [self.outside(k) for k, p in kinds if self.chance(p)]
        self.rng.shuffle(before)
        middle = self.article()
        for _ in range(self.rng.choice([0, 0, 1, 2])):
            if after and self.chance(0.4):
                middle += after.pop(0)
            # names of wrappers tell little
            name = self.name(self.rng.choice(list(_NAMES)), 0.15) or self.name("content", 0.3)
            middle = f"<div{name}>{middle}</div>"
        return "<html><body>" + "".join(before) + middle + "".join(after) + ("</body></html>" if self.chance(0.9) else "")


def relaid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled pages from the texts of pages."""
    for batch in batches:
        for part in chunks(batch, "html"):
            made, order = [], []
            for html in part.column("html").to_pylist():
                seed = xxhash.xxh3_64_intdigest(html.encode("utf-8", "replace"))
                texts = _texts(html)
                drawn = random.Random(seed)
                texts = drawn.sample(texts, min(len(texts), BLOCKS))
                for k in range(LAYOUTS):
                    made.append(_Layout(texts, seed + k).page())
                    order.append((seed + k) >> 1)
            yield pa.RecordBatch.from_pydict({"place": pa.array(order, pa.int64()), "html": pa.array(made, pa.string())})


def labelled_pages(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(place, html): labelled pages made from at most ``sample`` different pages of the table."""
    known = pages.where("html <> ''").select("html", F.xxhash64("html").alias("place"))
    picked = known.select("place").distinct().orderBy("place").limit(sample)
    rows = known.join(F.broadcast(picked), "place").groupBy("place").agg(F.min("html").alias("html"))
    return rows.select("html").mapInArrow(relaid, "place long, html string")


def fit(labelled: DataFrame, steps: int = STEPS) -> Model:
    """The model from a bounded number of labelled pages (place, html)."""
    rows = sorted((r.place, r.html) for r in labelled.select("place", "html").collect())
    return fit_forest(forest([parse(html) for _, html in rows]), steps)


# --- extraction ---------------------------------------------------------------------------------


def content_texts(pages: list[str], model: Model) -> list[str]:
    """The main text of each page."""
    trees = [parse(page) for page in pages]
    woods = forest(trees)
    content = marginals(model, woods)[0] >= 0.5
    out = []
    for first, tree in zip(woods.first, trees, strict=True):
        parts, border = [], True
        for node, piece, fresh in tree.pieces:
            border |= fresh
            if content[first + node]:
                parts.append(" " + piece if border else piece)
                border = False
        out.append(" ".join("".join(parts).split()))
    return out


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                texts = content_texts([h or "" for h in part.column("html").to_pylist()], model)
                yield pa.RecordBatch.from_pydict(
                    {
                        "page_id": part.column("page_id"),
                        "url": part.column("url"),
                        "text": pa.array(texts, pa.string()),
                        "n_chars": pa.array(map(len, texts), pa.int64()),
                    }
                )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, with a model from the table's own texts."""
    return extract(pages, fit(labelled_pages(pages)))
