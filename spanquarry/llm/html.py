"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block-level elements and text runs (the blocks of text between their borders). Each node has
features of its tag, attribute tokens, depth, siblings and subtree (text, links, tags and stops in it, and what its
ancestors are). Boosted trees give each node the odds of belonging to the article. ``decode`` then chooses subtrees: a
node that is dropped drops all below it, and the choice is the one of largest summed log-odds under that rule, so no
run is kept inside a dropped element.

The trees are trained on at most SAMPLE pages of the corpus, chosen by hash, of at most LONGEST characters each (both
bound what reaches the driver; every page is extracted whatever its length). Labels come from pages that mark their
article: with an ``article`` or ``main`` element, with attributes or without, or by ``itemprop=articleBody``. Variants of
the same pages with the marks renamed or removed, and with comments, forms, notices and sidebars put in, teach the other
features to do without the marks.

Defined results: null or empty html gives the empty text; a script, style, textarea or title that never ends is markup;
without any page that marks an article, the elements' own meaning decides (a fixed rule); repeated rows are treated
alike; further columns stay, but for one named main_text, which is replaced.
"""

from __future__ import annotations

import dataclasses
import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lowest_share, mapped, sliced

SAMPLE, LONGEST, ROUNDS, DEPTH, RATE, BINS, SEED = 240, 100_000, 40, 3, 0.3, 32, 5
#: What HTML says of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: Left out up to their end tag; without one, or closed by a slash, the tag alone.
INERT = frozenset("noscript template iframe svg select".split())
BLOCK = frozenset("html body address article aside blockquote button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul head".split())
ENDS_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "button", "figcaption"}
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPE = frozenset("html body table td th ul ol dl article section div aside nav main form".split())
BOILER_TAGS = frozenset("nav footer header aside form button menu search dialog fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs byline comment comments cookie cookies consent copyright disclaimer disqus feedback footer form gdpr header login masthead menu meta modal nav navbar navigation newsletter notice notices outbrain pagination pager popup promo promotion reader recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe taboola tags toolbar widget".split())
ARTICLE_WORDS = frozenset("article articlebody body content entry main post story text".split())
_NAME, _ATTR = re.compile(r"/?([a-zA-Z][^\s/>]*)"), re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_TOKEN, _STOPS = re.compile(r"[A-Za-z]+"), re.compile(r"[.,;:!?]")


class Node:
    __slots__ = ("tag", "words", "parent", "kids", "text", "depth", "linked", "stops", "size", "links", "tags", "order")

    def __init__(self, tag: str, words: tuple, parent: Node | None):
        self.tag, self.words, self.parent, self.kids = tag, words, parent, []
        self.text, self.linked, self.depth = "", 0, parent.depth + 1 if parent else 0
        if parent:
            parent.kids.append(self)


def parse(page: str) -> Node:
    """The page's tree. Kids are elements (block-level) and text runs (tag ``#``); inline markup melts into the runs."""
    root = now = Node("#root", (), None)
    parts: list[str] = []
    linked, anchors, at = 0, 0, 0
    endless: set[str] = set()
    opened: Counter = Counter()  # tags on the way from the root to now, so that nobody walks up for one that is not there

    def leave(up: Node) -> None:
        nonlocal now
        while now is not up:
            opened[now.tag] -= 1
            now = now.parent

    def close_run() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                run = Node("#", (), now)
                run.text, run.linked = text, min(linked, len(text))
            parts, linked = [], 0

    while True:
        lt = page.find("<", at)
        piece = page[at:] if lt < 0 else page[at:lt]
        if piece:
            piece = entities.unescape(piece)
            parts.append(piece)
            if anchors:
                linked += len(piece)
        if lt < 0:
            break
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if not (after.isascii() and after.isalpha() or after in ("/", "!", "?")) or after == "":
            if after == "":
                break
            parts.append("<")
            at = lt + 1
            continue
        gt = _tag_end(page, lt)
        if gt < 0:
            break
        inside, at = page[lt + 1 : gt], gt + 1
        name = _NAME.match(inside)
        if not name:
            continue
        tag, ends = name[1].lower(), inside[0] == "/"
        if ends:
            if tag == "a":
                anchors = max(0, anchors - 1)
            if tag in BLOCK:
                close_run()
                if opened[tag] > 0:
                    up = now
                    while up.tag != tag:
                        up = up.parent
                    leave(up.parent)
            continue
        if tag in INERT:
            end = -1 if inside.endswith("/") or tag in endless else _end_tag(page, tag, at)
            if end >= 0:
                gt = page.find(">", end)
                at = gt + 1 if gt >= 0 else len(page)
            elif not inside.endswith("/"):
                endless.add(tag)
            continue
        if tag in RAW:
            end = _end_tag(page, tag, at)
            gt = page.find(">", end) if end >= 0 else -1
            at = gt + 1 if gt >= 0 else len(page)
            continue
        if tag == "a":
            anchors += 1
        if tag in ("br", "img", "wbr", "input"):
            parts.append(" ")
        if tag in BLOCK:
            close_run()
            anchors = 0
            if tag in ENDS_P and now.tag == "p":
                leave(now.parent)
            if tag in SIBLING and any(opened[x] > 0 for x in SIBLING[tag]):
                up = now
                while up.parent and up.tag not in SCOPE and up.tag not in SIBLING[tag]:
                    up = up.parent
                if up.tag in SIBLING[tag] and up.parent:
                    leave(up.parent)
            if tag not in VOID:
                found = _ATTR.findall(inside) if "=" in inside else ()
                words = tuple(w.lower() for a in found for w in _TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a)))
                now = Node(tag, words, now)
                opened[tag] += 1
    close_run()
    return root


_END_TAGS = {tag: re.compile(f"</{tag}(?![a-z0-9-])", re.IGNORECASE | re.ASCII) for tag in RAW | INERT}


def _end_tag(page: str, tag: str, at: int) -> int:
    """Where the tag's end tag begins, in either case of letters (in the page itself: a lower-cased copy may be longer); -1 without one."""
    found = _END_TAGS[tag].search(page, at)
    return found.start() if found else -1


def _tag_end(page: str, lt: int) -> int:
    """The > that ends the tag; a > inside a quoted attribute does not."""
    gt = page.find(">", lt)
    if gt < 0 or '"' not in (part := page[lt:gt]) and "'" not in part:
        return gt
    at, n = lt, len(page)
    quote = re.compile(r"""=\s*(["'])|>""")
    while m := quote.search(page, at):
        if not m[1]:
            return m.start()
        end = page.find(m[1], m.end())
        if end < 0:
            return gt
        at = end + 1
        if at >= n:
            break
    return -1


FEATURES = ["run", "block", "boiler_tag", "article_tag", "heading", "paragraph", "item", "generic", "boiler_words", "article_words", "in_boiler_tag", "in_boiler_words", "in_article_tag", "in_article_words", "depth", "kids", "place", "siblings", "alike", "size", "share", "link_density", "links", "tags", "text_per_tag", "stops", "before"]


def features(root: Node) -> tuple[list[Node], list[list[float]]]:
    """Nodes in page order (parents first) and their features."""
    nodes: list[Node] = []
    stack = [root]
    while stack:
        n = stack.pop()
        n.order = len(nodes)
        nodes.append(n)
        stack.extend(reversed(n.kids))
    for n in reversed(nodes):
        n.size, n.links, n.tags, n.stops = len(n.text), n.linked, int(n.tag != "#"), len(_STOPS.findall(n.text)) if n.text else 0
        for k in n.kids:
            n.size, n.links, n.tags, n.stops = n.size + k.size, n.links + k.links, n.tags + k.tags, n.stops + k.stops
    whole, seen, rows, above = max(root.size, 1), 0, [], {}
    for n in nodes:
        up = above[n.parent] if n.parent else (0, 0, 0, 0)
        boiler, article = sum(w in BOILER_WORDS for w in n.words), sum(w in ARTICLE_WORDS for w in n.words)
        above[n] = (up[0] or n.tag in BOILER_TAGS, up[1] or boiler > 0, up[2] or n.tag in ARTICLE_TAGS, up[3] or article > 0)
        kin = n.parent.kids if n.parent else [n]
        own = n.parent if n.tag == "#" and n.parent else n
        rows.append([
            n.tag == "#", own.tag in BLOCK, own.tag in BOILER_TAGS, own.tag in ARTICLE_TAGS, len(own.tag) == 2 and own.tag[0] == "h" and own.tag != "hr", own.tag == "p", own.tag in ("li", "option", "dt", "dd"), own.tag in ("div", "section", "body", "#root"),
            boiler, article, *up, n.depth, len(n.kids), n.order - n.parent.order if n.parent else 0, len(kin), 0.0,
            np.log1p(n.size), n.size / whole, n.links / max(n.size, 1), np.log1p(n.links), n.tags, n.size / max(n.tags, 1), 100 * n.stops / max(n.size, 1), seen / whole,
        ])
        seen += len(n.text)
    for n in nodes:
        if n.kids:
            tags: dict[str, int] = {}
            for k in n.kids:
                tags[k.tag] = tags.get(k.tag, 0) + 1
            for k in n.kids:
                rows[k.order][18] = tags[k.tag] / len(n.kids)
    return nodes, rows


def decode(nodes: list[Node], odds: np.ndarray) -> list[str]:
    """The kept runs' texts in page order: the best choice in which a dropped node drops its whole subtree."""
    gain = [0.0] * len(nodes)
    for n in reversed(nodes):
        weight = max(n.size, 1) ** 0.5
        if n.tag == "#":
            gain[n.order] = max(0.0, weight * odds[n.order])
        else:
            below = sum(gain[k.order] for k in n.kids)
            gain[n.order] = below if n.parent is None else max(0.0, 0.3 * weight * odds[n.order] + below) if below else 0.0
    kept, stack = [], [nodes[0]]
    while stack:
        n = stack.pop()
        if n.parent and not gain[n.order]:
            continue
        if n.text:
            kept.append(n.text)
        stack.extend(reversed(n.kids))
    return kept


@dataclasses.dataclass
class Forest:
    cuts: list[np.ndarray]  # by feature
    feature: np.ndarray  # [trees, inner nodes]
    threshold: np.ndarray
    leaf: np.ndarray  # [trees, leaves]
    start: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows."""
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.int16)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (binned[rows, f[at]] > t[at])
            out += leaf[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Forest:
    """Logistic gradient boosting on histograms, Newton leaves, trees of fixed depth."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score, inner = np.full(len(y), start), 2**DEPTH - 1
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        f, t, at = np.zeros(inner, np.int64), np.full(inner, BINS + 1), np.zeros(len(y), np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            best = 1e-3
            if len(own) >= 20:
                g, h, b = grad[own], hess[own], binned[own]
                whole = g.sum() ** 2 / (h.sum() + 1)
                for j in range(x.shape[1]):
                    gs, hs = np.cumsum(np.bincount(b[:, j], g, BINS + 1)), np.cumsum(np.bincount(b[:, j], h, BINS + 1))
                    gains = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - whole
                    k = int(np.argmax(gains))
                    if gains[k] > best:
                        best, f[node], t[node] = gains[k], j, k
            at[own] = 2 * node + 1 + (binned[own, f[node]] > t[node])
        g, h = np.bincount(at - inner, grad, inner + 1), np.bincount(at - inner, hess, inner + 1)
        leaf = RATE * g / (h + 1)
        score += leaf[at - inner]
        trees.append((f, t, leaf))
    return Forest(cuts, *(np.array(v) for v in zip(*trees, strict=True)), start)


# ---- training pages ----

_START_MARK = re.compile(r"<(?:article|main)(?:\s[^>]*)?>", re.IGNORECASE)
_ITEMPROP = re.compile(r"""itemprop\s*=\s*["']?articlebody["']?""", re.IGNORECASE)
#: The same for Spark: pages that mark their article.
MARKED = r"""(?is)<(article|main)(\s[^>]*)?>.*</\1\s*>|itemprop\s*=\s*["']?articlebody"""
#: Words of an element's attributes that make it no part of the article even inside its mark.
NEVER = frozenset("ad ads advert advertisement comment comments cookie cookies disqus newsletter promo related sidebar sponsored subscribe".split())

def _variants(page: str, rnd: random.Random) -> list[str]:
    """The page, and forms of it whose labels stay known: marks renamed to plain elements, boilerplate put in."""
    words = re.findall(r"[^\W\d_]{2,}", re.sub(r"<[^>]*>", " ", page)) or ["text"]
    say = lambda n: " ".join(rnd.choices(words, k=n)) + "."
    boiler = [
        lambda: f'<div class="cookie-notice" data-b><p>{say(12)}</p><button>{say(1)}</button></div>',
        lambda: f'<aside class="sidebar" data-b><h3>{say(3)}</h3><ul><li><a href="#">{say(5)}</a></li><li><a href="#">{say(4)}</a></li></ul><p>{say(20)}</p></aside>',
        lambda: f'<form data-b><label>{say(2)}</label><input type="text"><p>{say(6)}</p><button>{say(1)}</button></form>',
        lambda: f'<div id="comments" data-b><h2>{say(2)}</h2>' + "".join(f'<div class="comment"><p>{say(rnd.randint(5, 60))}</p></div>' for _ in range(3)) + "</div>",
        lambda: f'<section class="reader-comments" data-b><p>{say(40)}</p><p>{say(30)}</p></section>',
        lambda: f'<div class="related" data-b><p><a href="#">{say(8)}</a></p><p><a href="#">{say(8)}</a></p></div>',
        lambda: f'<header data-b><div class="logo">{say(2)}</div><p>{say(8)}</p></header>',
        lambda: f'<div class="newsletter-signup" data-b><p>{say(15)}</p></div>',
    ]

    def filled(text: str) -> str:
        before, after = (b() for b in rnd.sample(boiler, 2))
        inner = rnd.choice(boiler)() if rnd.random() < 0.5 else ""
        text = re.sub(r"(<(?:article|main|div data-a)(?:\s[^>]*)?>)", before.replace("\\", "") + r"\1", text, count=1, flags=re.IGNORECASE)
        return re.sub(r"(</(?:article|main)\s*>|<!--end-a-->)", inner + r"\1" + after, text, count=1, flags=re.IGNORECASE)

    plain = _START_MARK.sub("<div data-a>", page).replace("<!--end-a-->", "")
    plain = _ITEMPROP.sub("data-a", re.sub(r"</(?:article|main)\s*>", "<!--end-a--></div>", plain, flags=re.IGNORECASE))
    listed = re.sub(r"<nav>", '<div class="menu" data-b>', plain).replace("</nav>", "</div>").replace("<footer>", '<div class="footer" data-b>').replace("</footer>", "</div>")
    classed = plain.replace("<div data-a>", f'<div class="{rnd.choice(["post-content", "entry", "story-body", "c1"])}" data-a>')
    return [page, filled(page), filled(plain), filled(listed), filled(classed)]


def _labelled(page: str) -> tuple[list[list[float]], list[int]]:
    """Features and labels of a page that marks its article (by the element, or by data-a and data-b of a variant)."""
    marked = _ITEMPROP.sub('class="zzarticle"', page).replace(" data-a", ' class="zzarticle"').replace(" data-b", ' id="zzboiler"')
    marked = re.sub(r'class="([^"]*)" class="zzarticle"', r'class="\1 zzarticle"', marked)
    root = parse(marked)
    nodes, rows = features(root)
    inside: dict = {}
    labels = []
    for n in nodes:
        up = inside[n.parent] if n.parent else 0
        bad = "zzboiler" in n.words or n.tag in BOILER_TAGS or not NEVER.isdisjoint(n.words)
        inside[n] = -1 if bad or up < 0 else 1 if up or n.tag in ARTICLE_TAGS or "zzarticle" in n.words else 0
        labels.append(int(inside[n] > 0 or any(k in ("zzarticle",) for k in n.words)))
    for n in reversed(nodes):  # what holds the article is kept with it
        if n.parent and labels[n.order] and n.tag != "#":
            labels[n.parent.order] = 1
    return rows, labels


def train(pages: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Forest | None:
    """Trees from a bounded, hash-chosen sample of pages that mark their article; None if there are none."""
    usable = pages.select(F.col("html").cast("string").alias("html")).where((F.length("html") <= longest) & F.col("html").rlike(MARKED))
    usable = usable.select(F.xxhash64("html").alias("h"), "html")
    share = min(1.0, sample / max(usable.count(), 1))
    chosen = usable.where(lowest_share(F.col("h"), 2 * share)).dropDuplicates(["h"]).orderBy("h").limit(sample).collect()
    rnd, x, y = random.Random(SEED), [], []
    for r in chosen:
        for variant in _variants(r.html, rnd):
            rows, labels = _labelled(variant)
            x += rows
            y += labels
    return boost(np.array(x, float), np.array(y, float)) if y and 0 < sum(y) < len(y) else None


def _rule(rows: np.ndarray) -> np.ndarray:
    """Without trees: what lies in an article and not in boilerplate is kept."""
    at = {f: i for i, f in enumerate(FEATURES)}
    bad = rows[:, [at[f] for f in ("boiler_tag", "boiler_words", "in_boiler_tag", "in_boiler_words")]].any(axis=1)
    return np.where(bad, -3.0, 1.0)


def extract(page: str | None, forest: Forest | None) -> str:
    return extract_all([page], forest)[0]


def extract_all(pages: list[str | None], forest: Forest | None) -> list[str]:
    """Main texts, the nodes of many pages scored at once."""
    out, held, rows = [""] * len(pages), [], []

    def decided() -> None:
        if rows:
            table = np.array(rows, float)
            odds = forest.odds(table) if forest else _rule(table)
            first = 0
            for i, nodes in held:
                out[i] = "\n".join(decode(nodes, odds[first : first + len(nodes)]))
                first += len(nodes)
        held.clear()
        rows.clear()

    for i, page in enumerate(pages):
        if page:
            nodes, own = features(parse(page))
            held.append((i, nodes))
            rows.extend(own)
            if len(rows) > 20_000:
                decided()
    decided()
    return out


def main_text(pages: DataFrame, forest: Forest | None) -> DataFrame:
    """pages with main_text added."""
    names = [c for c in pages.columns if c != "main_text"]
    pages = pages.select(*names)
    place = names.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            texts = extract_all(part.column(place).to_pylist(), forest)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "main_text"])

    return mapped(pages, run, StructType(list(pages.schema.fields)).add("main_text", "string"))
