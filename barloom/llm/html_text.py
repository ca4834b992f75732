"""Main text of web pages: a binary tree model over the DOM, whose marginals come from sum-product messages up and down.

Each block element, and each run of text in one, is a node that is content or not. A node's features and the potentials
between parent and child have weights: prior ones, moved by what pages with a marked article show (fit).
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bound_batches, removed, staged

#: Labelled pages that a fit reads at most, those of the smallest hash of their html, each distinct page once; and its rounds.
TRAIN_PAGES, ROUNDS = 1000, 8

# Fixed values of HTML: elements without end tag, elements whose text isn't shown as page text, and block elements with the
# prior weight of being content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp", "template"}
UNREAD = {"head", "svg", "select", "button", "audio", "video", "canvas", "object", "datalist", "map", "math"}
TAGS = {
    "body": -2.0, "article": 4.0, "main": 3.0, "section": 0.2, "div": 0.0, "p": 0.7, "h1": 1.5, "h2": 0.4, "h3": 0.4, "h4": 0.3, "h5": 0.2, "h6": 0.2,
    "blockquote": 0.7, "pre": 0.7, "ul": -0.3, "ol": 0.0, "li": -0.2, "dl": 0.0, "dt": 0.0, "dd": 0.0, "table": -0.2, "caption": -0.2, "thead": 0.0, "tbody": 0.0, "tfoot": 0.0, "tr": 0.0,
    "td": 0.0, "th": 0.0, "figure": 0.0, "figcaption": -0.2, "details": 0.0, "summary": 0.0, "hgroup": 0.0, "address": -1.0, "center": 0.0, "header": -2.0, "fieldset": -2.0, "legend": -2.0,
    "label": -2.0, "hr": 0.0, "nav": -3.0, "aside": -3.0, "footer": -3.0, "form": -3.0, "menu": -3.0, "dialog": -3.0, "search": -3.0,
}
#: Elements that are never content, whatever they hold.
NEVER = {"nav", "aside", "footer", "form", "menu", "dialog", "search"}
#: An open element of the first kind ends at a start tag of the second, unless one of the third lies between.
ENDS = {
    "p": (set(TAGS), {"td", "th", "li", "dd", "blockquote", "div"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th", "tr", "tbody", "tfoot", "thead"}, {"table"}), "th": ({"td", "th", "tr", "tbody", "tfoot", "thead"}, {"table"}), "tr": ({"tr", "tbody", "tfoot", "thead"}, {"table"}),
}
ENDED_BY = {start: [name for name, (starts, _) in ENDS.items() if start in starts] for start in TAGS}

# Fixed words of class, id and role, by what they name, with the prior weight.
WORDS = {
    "content": (3.0, "article articlebody body content copy entry entrycontent main post postbody prose story storybody text"),
    "menu": (-3.0, "breadcrumb breadcrumbs menu menubar nav navbar navigation pager pagination toc topbar"),
    "header": (-2.0, "header masthead banner logo branding"),
    "footer": (-3.0, "footer footnav colophon contentinfo copyright"),
    "side": (-3.0, "aside complementary rail sidebar sidenav widget widgets"),
    "advert": (-4.0, "ad ads advert advertisement advertising adsense adslot adverts dfp promo promotion sponsor sponsored sponsors"),
    "notice": (-4.0, "alert consent cookie cookies disclaimer gdpr modal newsletter notice notification overlay paywall popup signup subscribe subscription toast"),
    "remarks": (-4.0, "comment comments commentlist disqus discussion respond replies reply"),
    "share": (-3.0, "follow share sharing sharebar social tweet"),
    "related": (-3.0, "popular readmore recirc recommended related teaser teasers trending"),
    "form": (-3.0, "form login search searchbox signin"),
    "hidden": (-4.0, "hidden"),
}
WORD_KIND = {word: kind for kind, (_, words) in WORDS.items() for word in words.split()}
#: Kinds that make an element and all in it something else than content, unless it is named as content too.
NEVER_KINDS = {"menu", "footer", "side", "advert", "notice", "remarks", "share", "related", "form", "hidden"}
#: Prior weights of a text's length (up to so many characters), of the share of its characters in links, and of its marks.
LENGTHS = {20: -0.8, 80: -0.2, 200: 0.7, math.inf: 1.5}
LINKED = {0.0: 0.3, 0.34: 0.0, 0.67: -0.8, 1.0: -2.0}
MARKS = {"sentence": 0.5, "rights": -1.0}

FEATURES = [f"tag {t}" for t in TAGS] + [f"named {k}" for k in WORDS] + [f"chars {n}" for n in LENGTHS] + [f"linked {s}" for s in LINKED] + [f"mark {m}" for m in MARKS]
PRIOR = [*TAGS.values(), *[w for w, _ in WORDS.values()], *LENGTHS.values(), *LINKED.values(), *MARKS.values()]
AT = {name: k for k, name in enumerate(FEATURES)}
#: Between parent and child: content ends, content begins, content begins inside what is never content.
EDGES, EDGE_PRIOR = ("ends", "begins", "begins inside"), [-3.0, -1.5, -6.0]
FIXED = -1000.0

#: One token: a comment, a declaration, or a tag with its attributes. What isn't closed reaches to the end of the page, so each
#: character is read once. Quotes open a value behind an equals sign only.
_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))|[^>])*+)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_VALUE = re.compile(r"""=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)""")
_BARE_HIDDEN, _STYLED_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I), re.compile(r"""display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RIGHTS = re.compile(r"©|\ball rights reserved\b|\bcookies?\b", re.I)
_SENTENCE = re.compile(r"""[.!?…。！？]["'”’»)\]]*\Z""")


@dataclass
class Tree:
    """Nodes in page order, parents first. kinds: their features; never, inside: not content itself, or in what isn't; article: in a marked one."""

    parent: list[int] = field(default_factory=list)
    kinds: list[list[int]] = field(default_factory=list)
    never: list[bool] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    article: list[bool] = field(default_factory=list)
    texts: dict[int, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...] = tuple(PRIOR)
    edges: tuple[float, ...] = tuple(EDGE_PRIOR)


def kinds_of_names(attributes: str) -> set[str]:
    """What the words of class, id, role and itemprop name."""
    found = set()
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            plain = re.sub(r"[\W_]+", "", name.lower())
            for word in (plain, *(w.lower() for w in _WORD.findall(name))):
                if word in WORD_KIND and (word != "hidden" or word == name.lower()):
                    found.add(WORD_KIND[word])
    if _BARE_HIDDEN.search(_VALUE.sub("", attributes)) or _STYLED_HIDDEN.search(attributes):
        found.add("hidden")
    return found


def parse(page: str, masked: bool = False) -> Tree:
    """The block tree of a page. masked: the mark of an article is read as a plain div, so that other features must tell."""
    tree = Tree()
    stack: list[tuple[str, int]] = []  # open blocks
    opened: dict[str, int] = defaultdict(int)
    pieces: list[str] = []
    linked = total = 0
    in_link, unread = False, []

    def node(parent: int, kinds: list[int], never: bool, fresh: bool, article: bool) -> int:
        tree.parent.append(parent)
        tree.kinds.append(kinds)
        tree.never.append(never)
        tree.inside.append(never or parent >= 0 and tree.inside[parent] and not fresh)
        tree.article.append(not never and (article or parent >= 0 and tree.article[parent]))
        return len(tree.parent) - 1

    def text_ends() -> None:
        nonlocal linked, total
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                share = linked / max(total, 1)
                kinds = [AT[f"chars {next(n for n in LENGTHS if len(text) <= n)}"], AT[f"linked {next(s for s in LINKED if share <= s)}"]]
                kinds += [AT["mark sentence"]] * bool(_SENTENCE.search(text[-8:])) + [AT["mark rights"]] * bool(len(text) < 400 and _RIGHTS.search(text))
                tree.texts[node(stack[-1][1], kinds, False, False, False)] = text
            pieces.clear()
        linked = total = 0

    def pop() -> None:
        text_ends()
        opened[stack.pop()[0]] -= 1

    def push(name: str, attributes: str) -> None:
        text_ends()
        named = kinds_of_names(attributes) if attributes else set()
        mark = name in ("article", "main")
        never = not mark and name != "body" and (name in NEVER or bool(named & NEVER_KINDS) and "content" not in named)
        if mark and named & {"remarks", "related"}:
            mark, never = False, True
        as_tag = "div" if masked and mark else name
        kinds = [AT[f"tag {as_tag}"], *[AT[f"named {k}"] for k in named if not (masked and k == "content")]]
        stack.append((name, node(stack[-1][1] if stack else -1, kinds, never, mark and not masked, mark)))
        opened[name] += 1

    push("body", "")
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        till = m.start() if m else end
        if till > at and not unread:
            piece = html.unescape(page[at:till]) if page.find("&", at, till) >= 0 else page[at:till]
            pieces.append(piece)
            size = len(piece)
            total += size
            linked += size if in_link else 0
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if unread:
                if name == unread[-1]:
                    unread.pop()
            elif name == "a":
                in_link = False
            elif name in TAGS and name != "body" and opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            at = close.end() if close else end
        elif name in UNREAD or unread:
            if name == "body":
                unread.clear()
            elif name not in VOID and not m[3].endswith("/") and (name in UNREAD):
                unread.append(name)
        elif name == "br":
            pieces.append(" ")
        elif name == "a":
            in_link = True
        elif name in TAGS and name != "body":
            for ended in ENDED_BY[name]:
                if opened[ended]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == ended:
                            while len(stack) > k:
                                pop()
                            break
                        if stack[k][0] in ENDS[ended][1]:
                            break
            if name in VOID:
                text_ends()
            else:
                push(name, m[3])
    while stack:
        pop()
    return tree


def _add(x: float, y: float) -> float:
    """log(e^x + e^y)."""
    return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))


def _rate(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def messages(tree: Tree, model: Model) -> tuple[list[float], list[float], list[float]]:
    """Log-odds of each node being content, given all; and what it holds from below alone, and its parent's without it.

    What is never content says nothing about its parent: articles hold adverts too.
    """
    ends, begins, begins_inside = model.edges
    weights, parent, n = model.weights, tree.parent, len(tree.parent)
    below = [FIXED if never else sum([weights[k] for k in kinds]) for kinds, never in zip(tree.kinds, tree.never)]
    sent = [0.0] * n
    for i in range(n - 1, 0, -1):
        b = below[i]
        sent[i] = 0.0 if tree.never[i] else _add(b, ends) - _add(b + (begins_inside if tree.inside[i] else begins), 0.0)
        below[parent[i]] += sent[i]
    odds, rest = below[:], [0.0] * n
    for i in range(1, n):
        q = rest[i] = odds[parent[i]] - sent[i]
        if not tree.never[i]:
            odds[i] = below[i] + _add(q, begins_inside if tree.inside[i] else begins) - _add(q + ends, 0.0)
    return odds, below, rest


def main_text(page: str | None, model: Model) -> str:
    """Blocks whose marginal of being content is at least one half, in page order."""
    if not page:
        return ""
    tree = parse(page)
    odds, _, _ = messages(tree, model)
    return "\n\n".join([text for i, text in tree.texts.items() if odds[i] >= 0])


def gradient(page: str, model: Model) -> list[float]:
    """Of the log-likelihood of a marked page's labels: what they show less what the model expects, for weights and edges.

    Nodes in what is never content say nothing about their features: a menu's lists are no reason against an article's.
    """
    out = [0.0] * (len(PRIOR) + len(EDGES))
    tree = parse(page, masked=hash_parity(page))
    odds, below, rest = messages(tree, model)
    for i, (kinds, label) in enumerate(zip(tree.kinds, tree.article)):
        if not tree.inside[i]:
            for k in kinds:
                out[k] += label - _rate(odds[i])
        if i and not tree.never[i]:
            up, begin = tree.article[tree.parent[i]], 2 if tree.inside[i] else 1
            both = [0.0, below[i] + model.edges[begin], rest[i] + model.edges[0], below[i] + rest[i]]
            top = max(both)
            whole = sum(math.exp(x - top) for x in both)
            out[len(PRIOR)] += (up and not label) - math.exp(both[2] - top) / whole
            out[len(PRIOR) + begin] += (label and not up) - math.exp(both[1] - top) / whole
    return out


def hash_parity(page: str) -> bool:
    """Whether a labelled page is read without its mark: about half of them."""
    return sum(page.encode()) % 2 == 1


def labelled(pages: DataFrame, most: int = TRAIN_PAGES, page: str = "html") -> DataFrame:
    """html: at most `most` distinct pages that mark one article, those of the smallest hash."""
    marks = F.regexp_count(F.lower(page), F.lit(r"<(?:article|main)(?=[\s>])"))
    marked = pages.where(marks == 1).select(F.col(page).alias("html"), F.xxhash64(page).alias("h"))
    chosen = marked.select("h").distinct().orderBy("h").limit(most)
    return marked.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.first("html").alias("html")).select("html")


def fit(pages: DataFrame, most: int = TRAIN_PAGES, page: str = "html", strength: float = 0.02) -> Model:
    """Weights by conditional likelihood of marked pages, drawn to the prior ones by `strength`; those alone where no page is marked.

    Spark sums the pages' gradients in each round; the steps grow where a gradient keeps its sign and shrink where it turns.
    The labels are the marks of pages' own articles (less what is never content), and half of the pages are read without them.
    """
    sample = staged(labelled(pages, most, page).repartition(12), "labelled-pages")
    n = sample.count()
    if not n:
        return Model()
    prior = PRIOR + EDGE_PRIOR
    now, step, last = prior[:], [0.2] * len(prior), [0.0] * len(prior)
    for _ in range(ROUNDS):
        model = Model(tuple(now[: len(PRIOR)]), tuple(now[len(PRIOR) :]))

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = [0.0] * len(prior)
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    total = [a + b for a, b in zip(total, gradient(text, model))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["k", "g"])

        found = dict(sample.mapInArrow(run, "k int, g double").groupBy("k").agg(F.sum("g")).collect())
        for k in range(len(prior)):
            g = found[k] / n - strength * (now[k] - prior[k])
            step[k] = min(step[k] * 1.2, 1.0) if g * last[k] > 0 else step[k] * 0.5 if g * last[k] < 0 else step[k]
            now[k] += step[k] * max(-1.0, min(1.0, 20 * g))
            last[k] = g
    removed(sample)
    return Model(tuple(now[: len(PRIOR)]), tuple(now[len(PRIOR) :]))


def extract(pages: DataFrame, model: Model, page: str = "html") -> DataFrame:
    """pages with text (their main text, '' if none) and n_chars, its code points; columns of these names are replaced.

    Null and empty html, and pages without content, have '' and 0. Blocks are joined by an empty line, white space inside a
    block is one space, a line break is white space, character references are decoded as in HTML 5. Repeated rows get equal
    results and an empty table gives no rows. A page is read whole, once, and its nesting may be any depth.
    """
    bound_batches(pages.sparkSession)
    kept = pages.drop("text", "n_chars")
    place = kept.columns.index(page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, model) for x in batch.column(place).to_pylist()]
            columns = [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "text", "n_chars"])

    schema = kept.withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    return kept.mapInArrow(run, schema)
