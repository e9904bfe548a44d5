"""Main text of web pages by a site style tree.

The block elements of a host's pages, inside articles and under menus too, merge
into one tree: a node is a path of tags and classes.  Per node, over the host's
pages of different text (copies of a page count once):
  presentation importance = entropy of the node's child-tag sequences, to base m;
  content importance of a text in it = 1 - log(c) / log(m), with c of m pages
  showing that text there (a text that only one page has: 1; a menu on all: 0).
Composite importance of a block = 0.6 style + 0.4 evidence.  Evidence is
0.9 content + 0.1 presentation, drawn to 0.5 by 1/m of its distance (one page: 0.5).
Style is what the markup itself says: 0.75 in an article or main element, 0.5 where
it says nothing, 0.25 beside an article, 0 in an element marked as noise (menus,
footers, asides, forms, adverts and the like).  So the tree decides on all but the
last: what all of a site's articles repeat goes, and what stands beside an article
stays if no other page has it.  Blocks under 0.5 go.

A mark isn't believed on html and body; nor on an element with more than half of
the page's text if no article text stands outside marks.  On a paragraph or heading
a marked word only makes style 0.5 in an article and 0.25 elsewhere.

Pages are parsed once, in a narrow stage; statistics are aggregates of 64-bit keys
that combine before the shuffle.

Null html or url counts as empty.  Repeated rows are pages of their own; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import cut

STYLE, CONTENT = 0.6, 0.9
LEAST = 0.5
#: What markup says, weak enough for the tree to decide against it (0, under noise, is not).
ARTICLE, IN_DOUBT, BESIDE = 0.75, 0.5, 0.25
#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea title object canvas xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre".split())
NOISE = frozenset("nav aside form menu head button select option dialog header footer label fieldset".split())
#: Words of class, id or role that mark what isn't the article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe "
    "subscription signup popup modal overlay sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social comment comments "
    "respond reply replies discussion disqus related recommended recommendations teaser teasers widget login search searchbox pagination pager copyright toolbar skip hidden complementary contentinfo".split()
)
#: Elements whose end a new element of the kind implies, and what shields an open one.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SHIELDS = frozenset("ul ol dl table select body article section main div blockquote aside nav header footer form figure".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""")
SPLIT_NAME = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "path", "parent", "mark", "article", "top", "muted", "children", "size")

    def __init__(self, tag: str, path: str, parent: Node | None, mark: str, article: bool):
        """mark: "" (none), "weak", "noise" or "hidden"."""
        self.tag, self.path, self.parent, self.mark, self.article, self.children, self.size = tag, path, parent, mark, article, [], 0
        block = parent is None or tag in BLOCK
        self.top = self if block else parent.top
        #: Inside an inline element that is marked.
        self.muted = not block and (parent.muted or mark in ("noise", "hidden"))


def opened(tag: str, attributes: str, parent: Node) -> Node:
    words: set[str] = set()
    hidden, label = False, ""
    if attributes.strip():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                words.update(SPLIT_NAME.split(value))
                label += "." + value if name == "class" else ""
            hidden |= name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")) or (name == "aria-hidden" and value == "true")
    noise = tag in NOISE and not (tag == "header" and parent.article)
    article = parent.article or tag in ("article", "main") or "main" in words and "role" in attributes.lower()
    named = tag not in ("html", "body") and (words & NOISE_WORDS or ("header" in words and not parent.article))
    mark = "hidden" if hidden else "noise" if noise or named and tag not in PROSE else "weak" if named else ""
    return Node(tag, f"{parent.path}/{tag}{label}", parent, mark, article)


def styles_of(blocks: list[tuple[str, Node]]) -> list[float]:
    """What the markup says of each block."""
    total = 0
    for text, node in blocks:
        total += len(text)
        up: Node | None = node
        while up is not None:
            up.size += len(text)
            up = up.parent
    known: dict[int, float] = {}

    def style(node: Node | None, lift: bool) -> float:
        if node is None:
            return IN_DOUBT
        if id(node) not in known:
            above = style(node.parent, lift)
            if above == 0 or node.mark == "hidden" or (node.mark == "noise" and not (lift and 2 * node.size > total)):
                known[id(node)] = 0.0
            elif node.mark == "weak" or above < IN_DOUBT:
                known[id(node)] = IN_DOUBT if node.article else BESIDE
            else:
                known[id(node)] = ARTICLE if node.article else IN_DOUBT
        return known[id(node)]

    out = [style(node, False) for _, node in blocks]
    if not any(s and node.article for s, (_, node) in zip(out, blocks, strict=True)):
        known.clear()
        out = [style(node, True) for _, node in blocks]
    if ARTICLE in out:  # beside an article, the main text is less likely
        out = [BESIDE if s and not node.article else s for s, (_, node) in zip(out, blocks, strict=True)]
    return out


def blocks_of(page: str) -> tuple[list[tuple[str, float, str]], dict[str, str]]:
    """(text, style, path) of each text block, and the child-tag sequence of each path."""
    stack = [Node("", "", None, "", False)]
    out: list[tuple[str, Node]] = []
    styles: dict[str, str] = {}
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((text, stack[-1].top))
            held.clear()

    def close(k: int) -> None:
        """Closes everything from stack place k."""
        if any(n.tag in BLOCK for n in stack[k:]):
            flush()
        for n in stack[k:]:
            if n.tag in BLOCK:
                styles.setdefault(n.path, " ".join(n.children))
        del stack[k:]

    def find(tags: tuple[str, ...], shields: frozenset[str]) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in shields:
                break
        return 0

    at, end = 0, len(page)
    unclosed: set[str] = set()  # raw elements whose end doesn't come any more
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            if not stack[-1].muted:
                held.append(page[at:])
            break
        if m.start() > at and not stack[-1].muted:
            held.append(page[at : m.start()])
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if tag in BLOCK:
                k = find((tag,), frozenset())
                if k:
                    close(k)
                else:
                    flush()
            elif k := find((tag,), BLOCK):
                close(k)
        elif tag in RAW:
            done = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if not done:
                unclosed.add(tag)
            if not attributes.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                at = done.end() if done else (end if tag in ("script", "style") else at)
        elif tag in VOID:
            if tag in BLOCK:
                flush()
            elif tag in ("br", "wbr") and held:
                held.append(" " if tag == "br" else "")
        else:
            if tag in BLOCK:
                flush()
                if k := find(("p",), SHIELDS):
                    close(k)
                if tag in CLOSES and (k := find(CLOSES[tag], SHIELDS)):
                    close(k)
            stack[-1].children.append(tag)
            stack.append(opened(tag, attributes, stack[-1]))
    flush()
    close(1)
    styles.setdefault("", " ".join(stack[0].children))
    return [(text, s, node.path) for (text, node), s in zip(out, styles_of(out), strict=True)], styles


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, and of each page: a key of its whole text; texts, styles, node and text keys of its blocks outside noise; node and text keys of all; node and style keys of its tree."""
    schema = "page_id long, url string, content long, texts array<string>, styles array<double>, nodes array<long>, hashes array<long>, feature_nodes array<long>, feature_hashes array<long>, style_nodes array<long>, style_hashes array<long>"
    names = [x.split()[0] for x in schema.split(", ")]
    key = lambda *x: xxhash.xxh3_64_intdigest("\0".join(x)) - 2**63

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, url, page in zip(batch["page_id"].tolist(), batch["url"].tolist(), batch["html"].tolist(), strict=True):
                host = re.split(r"[/?#]", (url or "").partition("://")[2], maxsplit=1)[0].lower()
                found, tree = blocks_of(page or "")
                every = [(t, s, key(host, p), key(t)) for t, s, p in found]
                own = [x for x in every if x[1]]
                features = list(dict.fromkeys((n, h) for _, _, n, h in every))
                tree_keys = [(key(host, p), key(c)) for p, c in tree.items()]
                rows.append((page_id, url, key(host, *[x[0] for x in every]), [x[0] for x in own], [x[1] for x in own], [x[2] for x in own], [x[3] for x in own], [x[0] for x in features], [x[1] for x in features], [x[0] for x in tree_keys], [x[1] for x in tree_keys]))
            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInPandas(run, schema)


def importances(tree: DataFrame) -> DataFrame:
    """(node, hash, evidence) of the texts that several pages have or that stand beside an article or in doubt; others have evidence over 0.5."""
    pages = tree.groupBy("content").agg(*[F.first(c).alias(c) for c in ("feature_nodes", "feature_hashes", "style_nodes", "style_hashes")])
    styles = pages.select(F.explode(F.arrays_zip("style_nodes", "style_hashes")).alias("x")).groupBy(F.col("x.style_nodes").alias("node"), F.col("x.style_hashes").alias("s")).agg(F.count("*").alias("n"))
    nodes = styles.groupBy("node").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn")).where("m > 1")
    texts = pages.select(F.explode(F.arrays_zip("feature_nodes", "feature_hashes")).alias("x")).groupBy(F.col("x.feature_nodes").alias("node"), F.col("x.feature_hashes").alias("hash")).agg(F.count("*").alias("c"))
    beside = tree.select(F.explode(F.arrays_zip("styles", "nodes")).alias("x")).where(F.col("x.styles") == BESIDE).select(F.col("x.nodes").alias("node")).distinct().withColumn("beside", F.lit(True))
    both = texts.join(nodes.join(beside, "node", "left"), "node").where("c > 1 OR beside")
    presentation = (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")
    content = 1 - F.log("c") / F.log("m")
    evidence = 0.5 + (CONTENT * content + (1 - CONTENT) * presentation - 0.5) * (1 - 1 / F.col("m"))
    return both.select("node", "hash", evidence.alias("evidence"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by line breaks; empty if none) and n_chars of each page."""
    tree = cut(parsed(pages).withColumn("uid", F.monotonically_increasing_id()))
    blocks = tree.select("uid", F.posexplode(F.arrays_zip("styles", "nodes", "hashes")).alias("i", "x"))
    blocks = blocks.select("uid", "i", F.col("x.styles").alias("style"), F.col("x.nodes").alias("node"), F.col("x.hashes").alias("hash"))
    low = blocks.join(importances(tree), ["node", "hash"], "left")
    low = low.where(STYLE * F.col("style") + (1 - STYLE) * F.coalesce("evidence", F.lit(0.5)) < LEAST - 1e-9)
    # Written first, so that its size is known: where few pages lose a block, no text is shuffled.
    gone = cut(low.groupBy("uid").agg(F.collect_list("i").alias("gone")))
    kept = F.filter("texts", lambda t, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    rows = tree.select("uid", "page_id", "url", "texts").join(gone, "uid", "left").select("page_id", "url", F.array_join(kept, "\n").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
