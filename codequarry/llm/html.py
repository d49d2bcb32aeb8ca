"""Main text of web pages: boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of elements. Every element has dense features: what its tag and the
tokens of its class, id and role say, the same of its ancestors, how much text and how much
link text its subtree holds, punctuation and sentence density, depth, place among siblings and
what the siblings are like. Boosted trees turn them into the log-odds of being main text.

Decoding gives every element one of three states: dropped, kept, or mixed (a frame around
both). Below a dropped element everything is dropped, below a kept one anything but a frame,
so ancestors and descendants never contradict each other. The labelling with the largest sum
of log-odds, weighted by the text of the elements, is found by one pass up and one down.

There are no labelled pages. The trees are trained on a bounded hashed sample of the pages
themselves (``SAMPLE_ROWS``): those that say where their article is (article, main, or an
article role) are taken apart, and put together again in other dresses, with the article in a
plain div, and menus, notices, forms, sidebars and comments around and inside, so that the
trees have to learn from all features and not from one tag.

Text: character references are decoded, white space inside a block is one space, blocks are
joined by one line feed; scripts, styles, comments of the markup and the head are no text.

Defined results: a null or empty page, or one without text, has an empty text. A page with
text and without any element is one block. Unclosed and stray tags are mended like browsers
do. Without any page that tells its article, the trees are trained on made-up dresses of
plain paragraphs only. Repeated rows get equal results. Other columns are carried through.
"""

from __future__ import annotations

import html as references
import pickle
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from . import trees

SAMPLE_ROWS = 300
DRESSES = 4

# Elements of HTML by what they do, and tokens of names that tell a role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript head title svg math iframe object select option textarea button canvas audio video".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small "
    "span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split())
CLOSED_BY_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
GOOD_TOKENS = frozenset("article articlebody content main post entry story text body hentry maincontent page".split())
BAD_TOKENS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promoted promotion sponsor sponsored "
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar toolbar footer foot bottom copyright "
    "sidebar side aside rail widget widgets related recommend recommended recommendations more teaser popular trending "
    "comment comments commentlist disqus reply replies respond discussion reader cookie cookies consent gdpr notice "
    "notices alert warning message popup modal overlay newsletter subscribe subscription signup login form search share "
    "sharing social follow tags tag meta pagination pager skip hidden legal disclaimer contentinfo complementary search".split())
TAG_KINDS = ("p", "div", "section", "li", "ul", "a", "h1", "h2", "table", "td", "blockquote", "pre", "span")

_NAMED = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
#: The same where quotation marks do not pair: a tag ends at the first ``>``.
_CARELESS = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)>", re.S)
_STARTS_NAME = re.compile(r"</?[a-zA-Z]")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTR = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SENTENCE = re.compile(r"[.!?…。](?:\s|$)")
_PUNCTUATION = re.compile(r"[,.;:!?]")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset
    children: list = field(default_factory=list)
    #: Text pieces and children in page order: strings, or numbers of nodes.
    body: list = field(default_factory=list)


def _tags(page: str):
    """(place, end, match or None for what is no element) of all tags, in one walk over the page: a
    tag that no ``>`` ends is text from there on, and where quotation marks hide every ``>`` they
    are not looked at any more, so nothing is read twice."""
    at, named = 0, _NAMED
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, None
        elif _STARTS_NAME.match(page, at):
            m = named.match(page, at)
            if m is None and named is _NAMED and page.find(">", at) >= 0:
                named = _CARELESS
                m = named.match(page, at)
            if m is None:
                return
            end = m.end()
            end = (yield at, end, m) or end
        elif page[at + 1:at + 2] in ("!", "?", "/"):
            end = page.find(">", at)
            if end < 0:
                return
            end += 1
            yield at, end, None
        else:
            end = at + 1  # a lone sign
        at = end


def parse(page: str) -> list[Node]:
    """Elements of a page in page order; the first is the document itself. Linear in the page:
    places of open elements are kept by tag, so no tag searches the stack."""
    nodes = [Node("#document", -1, 0, frozenset())]
    stack = [0]
    #: Places in the stack by tag, and of those that end the search for an open paragraph.
    open_at: dict[str, list[int]] = {}
    solid: list[int] = []
    at = 0

    def last(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def close(k: int) -> None:
        while len(stack) > k:
            tag = nodes[stack.pop()].tag
            open_at[tag].pop()
            if solid and solid[-1] == len(stack):
                solid.pop()

    tags = _tags(page)
    skip = None
    while True:
        try:
            start, after, m = tags.send(skip)
        except StopIteration:
            break
        skip = None
        if start > at:
            nodes[stack[-1]].body.append(page[at:start])
        at = after
        if m is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if k := last((name,)):
                close(k)
            continue
        if name in CLOSES_P and (k := last(("p",))) > (solid[-1] if solid else 0):
            close(k)
        if name in CLOSED_BY_SIBLING and (k := last(CLOSED_BY_SIBLING[name])) > last(FENCES[name] - CLOSED_BY_SIBLING[name]):
            close(k)
        parent = stack[-1]
        tokens = set()
        attrs = m["attrs"]
        if "=" in attrs:
            for key, *values in _ATTR.findall(attrs):
                if key.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                    tokens.update(t.lower() for t in _TOKEN.findall("".join(values)))
        node = len(nodes)
        nodes.append(Node(name, parent, nodes[parent].depth + 1, frozenset(tokens)))
        nodes[parent].children.append(node)
        nodes[parent].body.append(node)
        if name in VOID or attrs.endswith("/") and name in ("path", "rect"):
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            nodes[node].body.append(page[at:end.start() if end else len(page)])
            at = skip = end.end() if end else len(page)
            continue
        open_at.setdefault(name, []).append(len(stack))
        if name not in INLINE and name != "p":
            solid.append(len(stack))
        stack.append(node)
    if at < len(page):
        nodes[stack[-1]].body.append(page[at:])
    return nodes


FEATURES = 34


def features(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every element, and the visible characters that are its own."""
    n = len(nodes)
    own, chars, links, marks, sentences, paragraphs, elements = (np.zeros(n) for _ in range(7))
    hidden = [False] * n
    good, bad = np.zeros(n), np.zeros(n)
    for i, node in enumerate(nodes):
        hidden[i] = node.tag in SILENT or (node.parent >= 0 and hidden[node.parent])
        good[i] = (node.tag in GOOD_TAGS) + len(node.tokens & GOOD_TOKENS)
        bad[i] = (node.tag in BAD_TAGS) + len(node.tokens & BAD_TOKENS)
        if hidden[i]:
            continue
        said = [b for b in node.body if isinstance(b, str)]
        if said:
            joined = "".join(said)
            own[i] = len(" ".join(joined.split()))
            marks[i] = len(_PUNCTUATION.findall(joined))
            sentences[i] = len(_SENTENCE.findall(joined))
    chars += own
    inside_link = [False] * n
    for i, node in enumerate(nodes):
        inside_link[i] = node.tag == "a" or (node.parent >= 0 and inside_link[node.parent])
        if inside_link[i]:
            links[i] = own[i]
    for i in range(n - 1, 0, -1):
        parent = nodes[i].parent
        paragraphs[i] += nodes[i].tag == "p"
        elements[i] += 1
        for sums in (chars, links, marks, sentences, paragraphs, elements):
            sums[parent] += sums[i]
    place, same = np.zeros(n), np.zeros(n)
    for node in nodes:
        tags = Counter(nodes[c].tag for c in node.children)
        for k, c in enumerate(node.children):
            place[c], same[c] = k, tags[nodes[c].tag] - 1
    total = max(1.0, chars[0])
    good_above, bad_above = np.zeros(n), np.zeros(n)
    out = np.zeros((n, FEATURES))
    for i, node in enumerate(nodes):
        p = node.parent
        if p >= 0:
            good_above[i] = good_above[p] + good[p]
            bad_above[i] = bad_above[p] + bad[p]
            family = len(nodes[p].children)
            rest = max(1, family - 1)
            out[i, 20], out[i, 21] = family, place[i] / rest
            out[i, 22] = same[i] / rest
            out[i, 23] = (chars[p] - chars[i]) / max(1.0, chars[p])
            out[i, 24] = (links[p] - links[i]) / max(1.0, chars[p] - chars[i])
            out[i, 25] = chars[p] / total
            out[i, 26] = links[p] / max(1.0, chars[p])
    c = np.maximum(chars, 1.0)
    out[:, 0], out[:, 1] = np.minimum(good, 3), np.minimum(bad, 3)
    out[:, 2], out[:, 3] = np.minimum(good_above, 3), np.minimum(bad_above, 3)
    out[:, 4], out[:, 5] = np.log1p(chars), chars / total
    out[:, 6], out[:, 7] = np.log1p(own), links / c
    out[:, 8], out[:, 9] = marks / c, sentences / c
    out[:, 10], out[:, 11] = np.log1p(sentences), np.log1p(paragraphs)
    out[:, 12] = elements / c
    out[:, 13] = chars / np.maximum(1.0, elements)
    out[:, 14] = [node.depth for node in nodes]
    out[:, 15] = np.arange(n) / n
    before = np.cumsum(own) - own
    out[:, 16] = before / total
    out[:, 17] = [node.tag in ("h1", "h2", "h3", "h4") for node in nodes]
    out[:, 18] = [node.tag in INLINE for node in nodes]
    out[:, 19] = hidden
    kinds = {t: k for k, t in enumerate(TAG_KINDS)}
    out[:, 27] = [kinds.get(node.tag, -1) for node in nodes]
    out[:, 28] = [node.tag == "p" for node in nodes]
    out[:, 29] = [node.tag in ("li", "ul", "ol") for node in nodes]
    out[:, 30] = [node.tag == "a" for node in nodes]
    out[:, 31] = [node.tag == "div" for node in nodes]
    out[:, 32] = [len(node.children) for node in nodes]
    out[:, 33] = np.log1p(np.array([chars[node.parent] if node.parent >= 0 else chars[0] for node in nodes]))
    own[np.array(hidden)] = 0
    return out, own


DROPPED, KEPT, MIXED = 0, 1, 2


def followers(nodes: list[Node], own: np.ndarray) -> np.ndarray:
    """Inline elements without blocks or hidden elements in a block that has text of its own: parts of
    its sentences, which stay or go with it."""
    plain = [node.tag in INLINE and node.tag not in SILENT for node in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        plain[nodes[i].parent] &= plain[i]
    out = np.zeros(len(nodes), bool)
    for i in range(1, len(nodes)):
        p = nodes[i].parent
        out[i] = plain[i] and (out[p] or (own[p] > 0 and p > 0))
    return out


def decode(nodes: list[Node], margin: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The best state of every element such that nothing below a dropped one is kept and
    frames stand only inside frames."""
    n = len(nodes)
    follows = followers(nodes, own)
    weight = np.where(follows, 0, np.log1p(own) + 0.3)  # what follows its block has no say in it
    margin = np.clip(margin, -6, 6)
    best = np.zeros((n, 3))
    best[:, KEPT] = weight * margin
    best[:, DROPPED] = -best[:, KEPT]
    # A frame says nothing about its own elements; text directly in it counts as dropped.
    best[:, MIXED] = np.where(own > 0, best[:, DROPPED], 0) - 0.1
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        best[p, DROPPED] += best[i, DROPPED]
        best[p, KEPT] += best[i, KEPT] if follows[i] else max(best[i, DROPPED], best[i, KEPT])
        best[p, MIXED] += best[i].max()
    state = np.zeros(n, np.int8)
    state[0] = int(np.argmax(best[0]))
    for i in range(1, n):
        above = state[nodes[i].parent]
        if above == DROPPED:
            state[i] = DROPPED
        elif above == KEPT:
            state[i] = KEPT if follows[i] or best[i, KEPT] >= best[i, DROPPED] else DROPPED
        else:
            state[i] = int(np.argmax(best[i]))
    return state


def blocks(nodes: list[Node], state: np.ndarray) -> list[str]:
    """Texts of the blocks of kept elements, in page order."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        said = " ".join("".join(run).split())
        if said:
            out.append(said)
        run.clear()

    # Elements are entered and left in page order without recursion, however deep they are.
    work: list = [0]
    while work:
        step = work.pop()
        if isinstance(step, str):
            run.append(references.unescape(step))  # a reference does not go on behind a tag
        elif step < 0:
            end()
        else:
            node = nodes[step]
            if node.tag in SILENT:
                continue
            block = node.tag not in INLINE
            if block:
                end()
                work.append(-1)
            if node.tag == "br":
                run.append(" ")
            kept = state[step] == KEPT
            work.extend(b for b in reversed(node.body) if kept or not isinstance(b, str))
    end()
    return out


# --- training ---------------------------------------------------------------------------

def _is_article(node: Node) -> bool:
    return node.tag in GOOD_TAGS or {"article", "body"} <= node.tokens


def _pieces(page: str) -> tuple[list[str], list[str]] | None:
    """Paragraphs of the article and texts from outside it, of a page that tells."""
    nodes = parse(page)
    state = np.zeros(len(nodes), np.int8)
    for i, node in enumerate(nodes):
        above = state[node.parent] if node.parent >= 0 else MIXED
        bad = node.tag in BAD_TAGS or node.tokens & BAD_TOKENS
        state[i] = (DROPPED if bad else KEPT if above == KEPT or _is_article(node) else MIXED) if above != DROPPED else DROPPED
    if not (state == KEPT).any():
        return None
    inside = blocks(nodes, state)
    outside = blocks(nodes, np.where(state == DROPPED, KEPT, MIXED))
    return inside, outside


def _dress(rng: np.random.Generator, inside: list[str], outside: list[str]) -> tuple[str, list[int]]:
    """A made-up page around an article; elements with ``data-k`` hold what is main text."""
    pick = lambda *options: options[int(rng.integers(len(options)))]
    say = lambda: references.escape(outside[int(rng.integers(len(outside)))]) if outside else "Menu"
    short = lambda: " ".join(say().split()[:int(rng.integers(1, 5))])
    long = lambda: references.escape(inside[int(rng.integers(len(inside)))]) if inside else say()

    def links() -> str:
        item = pick("<li><a href=#>{}</a></li>", "<a href=#>{}</a> ", "<div><a href=#>{}</a></div>")
        some = "".join(item.format(short()) for _ in range(int(rng.integers(3, 9))))
        return f"<ul>{some}</ul>" if item.startswith("<li") else some

    def plain() -> str:
        return pick(f"<p>{say()}</p>", say(), f"<div>{say()}</div>", f"<span>{say()}</span> {say()}")

    def named(inner: str, tags, names) -> str:
        tag, name = pick(*tags), pick(*names)
        attr = pick("class", "id")
        return f"<{tag} {attr}=\"{name}\">{inner}</{tag}>" if name else f"<{tag}>{inner}</{tag}>"

    def comment() -> str:
        many = "".join(named(f"<p>{long()}</p>", ("div", "li"), ("comment", "comment-body", "reply", "")) for _ in range(int(rng.integers(1, 4))))
        return named(pick("<h3>Comments</h3>", "") + many, ("section", "div", "ol"), ("comments", "comment-list", "discussion", "reader-comments", "responses comments"))

    extras = [
        lambda: named(links(), ("nav", "div", "ul"), ("nav", "menu", "main-menu", "navigation", "breadcrumbs")),
        lambda: named(f"<h2>{short()}</h2>{links()}", ("aside", "div"), ("sidebar", "side", "widget", "related", "related-posts")),
        lambda: named(plain(), ("div", "aside", "section"), ("ad", "ads", "advert", "banner", "sponsored", "promo-box")),
        lambda: named(plain(), ("div", "section"), ("cookie-notice", "notice", "consent", "alert", "popup", "newsletter")),
        lambda: f"<form action=#><label>{short()}</label><input name=q><button>{short()}</button>{plain()}</form>",
        lambda: named(f"<h1>{short()}</h1>{plain()}", ("header", "div"), ("header", "masthead", "site-header")),
        lambda: f"<header>{plain()}{links()}</header>",
        lambda: f"<nav>{links()}</nav>", lambda: f"<footer>&copy; {plain()}</footer>", lambda: f"<aside>{plain()}{pick(links(), '')}</aside>",
        comment,
    ]
    body = []
    said_now = []
    for said in inside:
        said_now.append(said)
        if rng.random() < 0.25:  # short paragraphs are main text too
            said_now.append(" ".join(said.split()[:int(rng.integers(1, 7))]) + pick(".", "", "!"))
    for k, said in enumerate(said_now):
        tag = "h1" if k == 0 and len(said) < 200 else pick("p", "p", "p", "p", "div", "blockquote", "h2" if len(said) < 80 else "p", "ul", "pre", "section")
        said = references.escape(said)
        if tag == "ul":
            body.append(f"<ul data-k><li>{said}</li></ul>")
        else:
            body.append(f"<{tag} data-k>{pick(said, said, f'<b>{said}</b>', f'<span>{said}</span>')}</{tag}>")
        if rng.random() < 0.06:
            body.append(extras[int(rng.integers(len(extras)))]())
    inner = "".join(body)
    if rng.random() < 0.3:
        inner += comment()
    tag, name = pick(("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "entry-content"), ("div", ""), ("section", ""), ("div", "story"), ("article", "post"), ("td", ""))
    wrapped = f"<{tag} class=\"{name}\" data-k>{inner}</{tag}>" if name else f"<{tag} data-k>{inner}</{tag}>"
    if rng.random() < 0.3:
        wrapped = f"<div class=\"{pick('page', 'wrapper', 'container', 'row')}\">{wrapped}{pick('', extras[1](), comment())}</div>"
    top = "".join(extras[int(rng.integers(len(extras) - 1))]() for _ in range(int(rng.integers(1, 4))))
    low = "".join(extras[int(rng.integers(len(extras)))]() for _ in range(int(rng.integers(1, 4))))
    return f"<html><head><title>{short()}</title></head><body>{top}{wrapped}{low}</body></html>"


def _examples(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements of a dressed page that have something to say."""
    marked = parse(page.replace(" data-k>", " class=\"datakx\">").replace("\" class=\"datakx\">", " datakx\">"))
    plain = [Node(n.tag, n.parent, n.depth, n.tokens - {"datakx"}, n.children, n.body) for n in marked]
    label = np.zeros(len(marked))
    for i, node in enumerate(marked):
        if node.parent >= 0 and label[node.parent] and not (node.tag in BAD_TAGS or node.tokens & BAD_TOKENS):
            label[i] = 1
        if "datakx" in node.tokens:
            label[i] = 1
    rows, _ = features(plain)
    use = np.array([n.tag not in ("#document", "html", "body") and n.tag not in SILENT for n in plain]) & (rows[:, 4] > 0)
    return rows[use], label[use]


def learn(pages: list[str], dresses: int = DRESSES) -> trees.Forest:
    """Boosted trees from pages that tell where their article is."""
    rng = np.random.default_rng(10)
    rows, labels = [np.zeros((0, FEATURES))], [np.zeros(0)]
    taken = [p for p in map(_pieces, pages) if p]
    if not taken:
        words = "one more plain sentence, with words that go on for a while. "
        taken = [([words * k for k in (1, 4, 6, 3)], ["Home", "Contact us", "Read more", words])] * 30
    for inside, outside in taken:
        for _ in range(dresses):
            x, y = _examples(_dress(rng, inside, outside))
            rows.append(x)
            labels.append(y)
    return trees.fit(np.concatenate(rows), np.concatenate(labels), trees=40, depth=5, rate=0.25)


def extract(pages: list[str | None], forest: trees.Forest) -> list[str]:
    """Main texts of pages; the trees see all elements of all pages at once."""
    parsed = [parse(p) if p else None for p in pages]
    made = [features(nodes) if nodes else None for nodes in parsed]
    if not any(m is not None for m in made):
        return [""] * len(pages)
    margin = forest.margin(np.concatenate([m[0] for m in made if m is not None]))
    out, at = [], 0
    for nodes, m in zip(parsed, made):
        if nodes is None:
            out.append("")
            continue
        here = margin[at:at + len(nodes)]
        at += len(nodes)
        if len(nodes) == 1:
            out.append("\n".join(blocks(nodes, np.array([KEPT]))))
        else:
            out.append("\n".join(blocks(nodes, decode(nodes, here, m[1]))))
    return out


def fit(pages: DataFrame, sample_rows: int = SAMPLE_ROWS) -> trees.Forest:
    """Trees from a hashed sample of at most ``sample_rows`` of the pages that tell their article.

    Pages are asked in the order of their hash: first a share of the table that should do, then
    larger ones up to the whole of it until enough of them tell."""
    tells = arrow_udf(lambda values: pa.array([_pieces(v) is not None for v in values.to_pylist()], pa.bool_()), T.BooleanType())
    named = (
        # Whatever tells has one of these words.
        pages.where(F.col("page_id").isNotNull() & F.col("html").rlike("(?i)article|<main"))
        .select("page_id", "html", F.xxhash64("page_id").alias("o"))
    )
    telling = tells.asNondeterministic()("html")
    share = 4 * sample_rows / max(1, pages.count())
    while True:
        asked = named.where(F.col("o") < int(share * 2**64) - 2**63) if share < 1 else named
        keys = asked.where(telling).select("page_id", "o").distinct().orderBy("o", "page_id").limit(sample_rows).collect()
        if len(keys) >= sample_rows or share >= 1:
            break
        share *= 8
    keys = pages.sparkSession.createDataFrame(keys, named.select("page_id", "o").schema)
    # One page for an id, however many rows have it.
    sample = (
        named.join(F.broadcast(keys), ["page_id", "o"]).where(telling)
        .groupBy("page_id", "o").agg(F.min("html").alias("html"))
    )

    def train(batches):
        rows = sorted((o, h) for b in batches for o, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if h)
        forest = learn([h for _, h in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(
            {"depth": forest.depth, "base": forest.base, "feature": forest.feature, "bound": forest.bound, "leaf": forest.leaf})], pa.binary())], names=["forest"])

    made = sample.select("o", "html").repartition(1).mapInArrow(train, "forest binary").collect()
    return trees.Forest(**pickle.loads(made[0][0])) if made else learn([])


def with_text(pages: DataFrame, forest: trees.Forest, name: str = "text") -> DataFrame:
    """``pages`` and the main text of ``html``."""
    shared = pages.sparkSession.sparkContext.broadcast(forest)

    @arrow_udf(T.StringType())
    def main_text(values: pa.Array) -> pa.Array:
        out = []
        for a in range(0, len(values), 256):
            out += extract(values.slice(a, 256).to_pylist(), shared.value)
        return pa.array(out, pa.string())

    return pages.withColumn(name, main_text.asNondeterministic()(F.col("html")))
