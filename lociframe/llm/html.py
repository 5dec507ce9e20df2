"""Main text of web pages: a tree-structured graphical model over the DOM.

Every element is a binary variable (inside the main content or not). Node potentials come from tag, class words, link
density, text length, sentence ends, and hashes of the tag and the class as written; edge potentials couple a parent and
its child by the child's kind. Sum-product messages go up and then down the trees of many pages at once, level by level,
and give exact marginals; a text belongs to the page's content if the marginal of its element is over one half.

The weights are fitted by gradient steps on the likelihood of labelled pages, around a prior that knows the usual meaning
of tags and class words, so kinds that the labelled pages lack keep it. Labels come from texts, not from markup: a block of
text is content if its word shingles occur in a table of reference texts, which pages may share articles with. Short blocks
beside content are left open, and summed out by messages as well; so are elements without text of their own.

Defined edge cases: null or empty html gives an empty text; broken markup is read as far as it goes (unclosed elements
end with their parent; a bare end tag is ignored); repeated rows each give a row; extra columns are ignored; without
labelled pages the prior's weights are used.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import table
from .text import U64, chunks, shingles

#: Pages that the weights are fitted on, at most; words in a shingle that is looked for in reference texts; cells that tags
#: and classes as written are hashed into; pages whose messages are sent together.
LABELLED_PAGES, LABELLED_CHARS, WORDS, CELLS, TOGETHER = 400, 40_000_000, 5, 64, 64

# Kinds of elements by tag name, and by the words of their class and id.
KINDS = {
    "main": "article main",
    "nav": "nav menu",
    "header": "header",
    "footer": "footer",
    "aside": "aside",
    "form": "form button input select option textarea label fieldset dialog",
    "hidden": "script style noscript template head title iframe object svg canvas",
    "heading": "h1 h2 h3 h4 h5 h6",
    "text": "p blockquote pre figcaption dd dt td th",
    "list": "ul ol dl li table tbody thead tr figure",
    "frame": "html body div section center",
}
CLASS_WORDS = {
    "c_content": "article content main post entry story body text prose",
    "c_menu": "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side rail widget toolbar pagination tags",
    "c_notice": "cookie cookies consent notice banner alert popup modal newsletter subscribe signup gdpr promo",
    "c_ad": "ad ads advert advertisement sponsor sponsored",
    "c_social": "comment comments reply respond share social related recommended disqus",
}
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be left out: they end where one of these begins.
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

FEATURES = [*KINDS, "inline", *CLASS_WORDS, "links", "long", "stops", "bias", *[f"cell {i}" for i in range(CELLS)]]
AT = {x: i for i, x in enumerate(FEATURES)}
KIND_OF_TAG = {t: k for k, tags in KINDS.items() for t in tags.split()}
KIND_OF_WORD = {w: k for k, words in CLASS_WORDS.items() for w in words.split()}
#: Kinds of a child by which it is coupled to its parent; regions with a purpose of their own stand apart from it.
APART = {AT[k] for k in ("nav", "header", "footer", "aside", "form", "hidden", "c_menu", "c_notice", "c_ad", "c_social")}
EDGES = [*KINDS, "inline", "apart"]
EDGE_AT = {x: i for i, x in enumerate(EDGES)}

#: Prior means. A node's score adds to the log odds of content; an edge's to a child agreeing with its parent.
PRIOR = {"main": 5.0, "nav": -6.0, "header": -5.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "hidden": -12.0, "c_content": 2.0, "c_menu": -6.0, "c_notice": -6.0, "c_ad": -7.0, "c_social": -7.0, "links": -1.0, "long": 0.5, "bias": -0.1, "text": 0.4, "heading": 0.3}
COUPLING = {"main": 0.5, "frame": 1.5, "apart": 0.05}
STRONG = 5.0


def _cell(name: str) -> int:
    return AT["cell 0"] + zlib.crc32(name.encode("utf-8", "replace")) % CELLS


class Node:
    __slots__ = ("tag", "parent", "features", "kind", "chars", "link_chars", "stops")

    def __init__(self, tag: str, parent: int):
        self.tag, self.parent = tag, parent
        self.kind = KIND_OF_TAG.get(tag, "inline")
        self.features: list[int] = [AT[self.kind], _cell(tag)]
        self.chars = self.link_chars = self.stops = 0


class Tree(HTMLParser):
    """Elements in page order and the text runs in them: (element, block number, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def read(self, html: str) -> Tree:
        self.reset()
        self.nodes, self.open, self.runs, self.block = [Node("#", -1)], [0], [], 0
        try:
            self.feed(html)
            self.close()
        except (AssertionError, ValueError):  # markup that the parser gives up on: keep what was read
            pass
        return self

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # an unknown keyword or none: a bogus comment up to '>'
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.block += 1
        while (ends := CLOSED_BY.get(self.nodes[self.open[-1]].tag)) and tag in ends:
            self.open.pop()
        if tag in BLOCK:  # inline elements left open inside a paragraph end with it
            deep = next((i for i in range(len(self.open) - 1, 0, -1) if self.nodes[self.open[i]].tag in BLOCK), 0)
            if deep and (ends := CLOSED_BY.get(self.nodes[self.open[deep]].tag)) and tag in ends:
                del self.open[deep:]
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        node = Node(tag, self.open[-1])
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                kinds = {KIND_OF_WORD[w] for w in re.split(r"[^a-z]+", value.lower()) if w in KIND_OF_WORD}
                node.features += [AT[k] for k in kinds] + sorted({_cell(f"{name}={w}") for w in value.lower().split()})
        self.open.append(len(self.nodes))
        self.nodes.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.block += 1
        for i in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[i]].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.runs.append((self.open[-1], self.block, data))


class Forest:
    """The elements of some pages, one after the other, parents before children; features as (element, feature, value)."""

    def __init__(self, trees: list[Tree]):
        node, feature, value, parents, kinds, self.first = [], [], [], [], [], [0]
        for tree in trees:
            nodes, base = tree.nodes, self.first[-1]
            for at, _, data in tree.runs:
                nodes[at].chars += len(data) - data.count(" ")
                nodes[at].stops += data.count(".") + data.count(",")
            linked = [False] * len(nodes)
            for i, n in enumerate(nodes):
                linked[i] = n.tag == "a" or (n.parent >= 0 and linked[n.parent])
            for i in range(len(nodes) - 1, -1, -1):
                n = nodes[i]
                if linked[i]:
                    n.link_chars = n.chars
                if n.parent >= 0:
                    up = nodes[n.parent]
                    up.chars, up.link_chars, up.stops = up.chars + n.chars, up.link_chars + n.link_chars, up.stops + n.stops
            for i, n in enumerate(nodes):
                own = [*n.features, AT["bias"], AT["long"], AT["links"], AT["stops"]]
                node += [base + i] * len(own)
                feature += own
                value += [1.0] * (len(own) - 3) + [min(n.chars, 200) / 200, n.link_chars / n.chars if n.chars else 0.0, min(20 * n.stops / n.chars, 1.0) if n.chars else 0.0]
                parents.append(base + n.parent if n.parent >= 0 else -1)
                kinds.append(EDGE_AT["apart" if APART.intersection(n.features) else n.kind])
            self.first.append(base + len(nodes))
        self.node, self.feature, self.value = np.array(node, np.int64), np.array(feature, np.int64), np.array(value)
        self.parents, self.kinds = np.array(parents, np.int64), np.array(kinds, np.int64)
        self.levels = levels(self.parents)

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.node, weights=self.value * w[self.feature], minlength=len(self.parents))


def levels(parents: np.ndarray) -> list[np.ndarray]:
    """Elements by their depth below their root."""
    depth: list[int] = []
    for p in parents.tolist():
        depth.append(depth[p] + 1 if p >= 0 else 0)
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if depth else []


def marginals(score: np.ndarray, parents: np.ndarray, coupling: np.ndarray, by_level: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each node and P(node agrees with its parent), by messages up and then down the trees.

    Messages are log odds. score: log odds of each node alone; coupling: log weight of agreeing with the parent.
    """
    by_level = levels(parents) if by_level is None else by_level
    exp = lambda x: np.exp(np.clip(x, -30, 30))
    own, up, agree = score.astype(float), np.zeros(len(score)), np.exp(coupling)
    for at in by_level[:0:-1]:
        odds = exp(own[at])
        up[at] = np.log((agree[at] * odds + 1) / (odds + agree[at]))
        np.add.at(own, parents[at], up[at])
    belief, same = own.copy(), np.ones(len(score))
    for at in by_level[1:]:
        rest, odds = exp(belief[parents[at]] - up[at]), exp(own[at])
        agreeing = agree[at] * (rest * odds + 1)
        same[at] = agreeing / (agreeing + rest + odds)
        belief[at] = own[at] + np.log((agree[at] * rest + 1) / (rest + agree[at]))
    return 1 / (1 + np.exp(-np.clip(belief, -40, 40))), same


def prior() -> tuple[np.ndarray, np.ndarray]:
    return np.array([PRIOR.get(f, 0.0) for f in FEATURES]), np.array([COUPLING.get(e, STRONG) for e in EDGES])


def blocks_of(tree: Tree) -> list[tuple[list[int], np.ndarray]]:
    """Runs of text that is not hidden, short ones of a block together, and the hashes of their word shingles (none if they
    are short together, too)."""
    hidden = _hidden(tree)
    runs: list[list[int]] = []
    joins = False
    for i, (at, block, data) in enumerate(tree.runs):
        if data.strip() and not hidden[at]:
            short = len(data.split()) < WORDS
            if joins and short and tree.runs[runs[-1][-1]][1] == block:
                runs[-1].append(i)
            else:
                runs.append([i])
            joins = short
    hashes: list[np.ndarray] = []
    for c in chunks(pa.array(["".join(tree.runs[i][2] for i in range(x[0], x[-1] + 1)) for x in runs], pa.string())):
        h, offsets = shingles(c.hashes, c.words, WORDS)
        hashes += [h[s:e] if n >= WORDS else h[:0] for s, e, n in zip(offsets[:-1], offsets[1:], c.n_words)]
    return list(zip(runs, hashes))


def _hidden(tree: Tree) -> list[bool]:
    out = [False] * len(tree.nodes)
    for i, n in enumerate(tree.nodes):
        out[i] = n.tag in ("head", "script", "style", "noscript", "template") or (n.parent >= 0 and out[n.parent])
    return out


def labels_of(tree: Tree, blocks: list[tuple[list[int], np.ndarray]], known: np.ndarray) -> np.ndarray:
    """1 or 0 for elements that are content or not, -1 for open ones; known: sorted hashes of reference texts' shingles.

    What is hidden is no content. A block is content if half of its shingles are known; its runs' elements are, too. Short
    blocks are open beside content and no content elsewhere.
    """
    states = []
    for _, x in blocks:
        hit = known[np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))] == x if len(known) else np.zeros(len(x), bool)
        states.append(int(2 * hit.sum() >= len(x)) if len(x) else -1)
    following, last = [0] * len(states), 0
    for i in range(len(states) - 1, -1, -1):
        following[i] = last
        last = states[i] if states[i] >= 0 else last
    share: dict[int, list[int]] = {}
    last = 0
    for (runs, _), state, after in zip(blocks, states, following):
        if state < 0 and not (last or after):
            state = 0
        elif state >= 0:
            last = state
        if state >= 0:
            for i in runs:
                share.setdefault(tree.runs[i][0], [0, 0])[state] += len(tree.runs[i][2])
    out = np.full(len(tree.nodes), -1)
    for at, (no, yes) in share.items():
        out[at] = int(yes >= no)
    out[[i for i, x in enumerate(_hidden(tree)) if x]] = 0
    return out


def fit(trees: list[Tree], labels: list[np.ndarray], steps: int = 60, rate: float = 0.5, hold: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Node and edge weights: gradient ascent on the log likelihood of labelled pages (open elements are summed out), with
    a Gaussian prior of precision hold times the number of elements."""
    w0, e0 = prior()
    w, e = w0.copy(), e0.copy()
    if not trees:
        return w, e
    f, y = Forest(trees), np.concatenate(labels)
    given = np.select([y == 1, y == 0], [1e3, -1e3], 0.0)
    inner = np.flatnonzero(f.parents >= 0)
    for _ in range(steps):
        score = f.scores(w)
        free, free_same = marginals(score, f.parents, e[f.kinds], f.levels)
        held, held_same = marginals(np.where(y < 0, score, given), f.parents, e[f.kinds], f.levels)
        gw = np.bincount(f.feature, weights=f.value * (held - free)[f.node], minlength=len(w))
        ge = np.bincount(f.kinds[inner], weights=(held_same - free_same)[inner], minlength=len(e))
        w += rate * (gw / len(y) - hold * (w - w0))
        e += rate * (ge / len(y) - hold * (e - e0))
    return w, e


def contents(pages: list[str], weights: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """For each page, the text of the elements that are likely content, one line for each block."""
    trees = [Tree().read(h) for h in pages]
    f = Forest(trees)
    p, _ = marginals(f.scores(weights[0]), f.parents, weights[1][f.kinds], f.levels)
    return [_text(tree, p[s:e].tolist()) for tree, s, e in zip(trees, f.first[:-1], f.first[1:])]


def _text(tree: Tree, p: list[float]) -> str:
    blocks: list[str] = []
    parts: list[str] = []
    at = -1
    for node, block, data in tree.runs:
        if p[node] <= 0.5:
            continue
        if block != at and parts:
            blocks.append("".join(parts))
            parts = []
        at = block
        parts.append(data)
    blocks.append("".join(parts))
    return "\n".join(t for b in blocks if (t := " ".join(b.split())))


def main_text(df: DataFrame, weights: tuple[np.ndarray, np.ndarray], keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """keep, text and n_chars of every page."""
    slim = df.select(*keep, F.col(html).cast("string").alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[:-1]) + ", text string, n_chars long"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(lo, TOGETHER)
                texts = contents([h or "" for h in part.column(len(keep)).to_pylist()], weights)
                columns = [*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    return slim.mapInArrow(extract, schema)


def _known(texts: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """The hashes of wanted (sorted; those of LABELLED_PAGES pages) that are shingles of texts (t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        seen = np.zeros(len(wanted), bool)
        for batch in batches:
            for c in chunks(batch.column(0)):
                h, _ = shingles(c.hashes, c.words, WORDS)
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                seen[at[wanted[at] == h]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], names=["i"])

    return wanted[np.sort(np.array([r["i"] for r in texts.mapInArrow(run, "i long").distinct().collect()], np.int64))]


def train(pages: DataFrame, texts: DataFrame, html: str = "html", text: str = "text", limit: int = LABELLED_PAGES, chars: int = LABELLED_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Weights fitted on pages that share articles with texts: at most `limit` pages and `chars` characters of markup, in the
    order of the hash of the markup (a page that would go beyond `chars` is passed over, and others follow)."""
    fit_for = pages.select(F.col(html).cast("string").alias("h")).filter("h is not null")
    sizes = fit_for.select(F.xxhash64("h").alias("x"), F.length("h").alias("n")).filter(F.col("n") <= chars).distinct().orderBy("x", "n").limit(limit).collect()
    hashes, room = [], chars
    for r in sizes:
        if r["n"] <= room:
            hashes.append(r["x"])
            room -= r["n"]
    if not hashes:
        return prior()
    rows = fit_for.filter(F.xxhash64("h").isin(hashes)).dropDuplicates(["h"]).orderBy(F.xxhash64("h"), "h").limit(limit).collect()
    np.seterr(over="ignore")
    trees = [Tree().read(r["h"]) for r in rows]
    blocks = [blocks_of(t) for t in trees]
    wanted = np.unique(np.concatenate([np.zeros(0, U64), *[x for b in blocks for _, x in b]]))
    if not len(wanted):
        return prior()
    known = _known(texts.select(F.col(text).cast("string").alias("t")), wanted)
    labels = [labels_of(t, b, known) for t, b in zip(trees, blocks)]
    shared = [i for i, y in enumerate(labels) if (y == 1).any()]
    return fit([trees[i] for i in shared], [labels[i] for i in shared])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, train(pages, table(spark, sf_dir, "documents")))
