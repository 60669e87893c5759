"""HTML extraction (7): gradient-boosted trees over DOM nodes, decoded along the tree.

Each element gets features of its subtree (text, link and tag density, sentences),
of its attribute tokens and those of its ancestors, of its depth, and of its
siblings and parent.  Trees give a log-odds of being main text; decoding then keeps
or drops whole subtrees so that the sum over the page is largest: below a dropped
element nothing is kept, and an element is kept if what is kept below it outweighs it.

The training labels need no annotator: at most ``TRAIN_PAGES`` pages of the input
are rewritten into random layouts (menus, banners, notices, adverts, sidebars,
forms, comment threads, footers around and inside the article; the article in
differently named containers), so it is known which nodes are article.

A null or an empty page has an empty text; broken markup is read as far as it can
be; equal pages give equal texts; an empty table gives an empty result and trains
on built-in sentences; other columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, least_keys
from .boosting import Trees, fit
from .tokens import slices

TRAIN_PAGES = 200
LAYOUTS = 5
TRAIN_CHARS = 200_000

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe xmp noembed noframes".split())
# What a reader sees stays: noscript as if scripts were off, xmp as it is written, the words of drawings.
SILENT = RAW - {"xmp"} | frozenset("head select option button datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br object audio video canvas math mrow mi mo mn ms mtext mfrac msup msub msubsup msqrt mroot mover munder munderover mspace mstyle semantics svg g text tspan textpath".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("table ul ol dl div article section body html td th aside nav main".split())

TAG_GROUPS = ("p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "a", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form input fieldset label legend", "table tbody thead tr td th", "figure figcaption img", "blockquote", "pre code", "b i em strong span u small sup sub", "html body")
TOKEN_GROUPS = (
    "article content post entry story main body text prose page",
    "nav menu navbar navigation breadcrumb breadcrumbs pager pagination toc tabs",
    "header masthead banner top toolbar logo",
    "footer bottom copyright legal colophon",
    "sidebar aside side widget rail related recommended popular trending more",
    "ad ads adv advert advertisement sponsor sponsored promo promoted promotion",
    "cookie cookies consent gdpr notice alert popup modal overlay privacy notification warning",
    "newsletter subscribe subscription signup login register search form contact",
    "comment comments reply replies respond discussion disqus thread response responses",
    "share social follow tweet tags meta byline hidden skip print tools",
)
_GROUP_OF_TAG = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_GROUP_OF_TOKEN = {t: i for i, g in enumerate(TOKEN_GROUPS) for t in g.split()}
_N_TAGS, _N_TOKENS = len(TAG_GROUPS) + 1, len(TOKEN_GROUPS)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_EVENT = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


#: Open elements that a start tag of a group ends, if no element of SCOPE stands between.
_ENDED = (("p",), *dict.fromkeys(SAME_LEVEL.values()))
_GROUP = {t: _ENDED.index(e) for t, e in SAME_LEVEL.items()} | dict.fromkeys(CLOSES_P, 0)
_NONE = (None,) * len(_ENDED)
_MAY_END = frozenset(t for ends in _ENDED for t in ends)


class Node:
    __slots__ = ("tag", "tokens", "parent", "parts", "known", "hidden", "near")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset[int] = frozenset(), hidden: bool = False, known: int | None = None):
        self.tag, self.parent, self.tokens, self.hidden, self.known = tag, parent, tokens, hidden, known
        self.parts: list[Node | str] = []  # elements and decoded text in page order
        # for each group the nearest open element that its start tags end
        self.near: tuple[Node | None, ...] = _NONE if parent is None or tag in SCOPE else parent.near
        if tag in _MAY_END:
            self.near = tuple(self if tag in ends else own for ends, own in zip(_ENDED, self.near, strict=True))


def _attributes(text: str) -> tuple[frozenset[int], bool, int | None]:
    """Token groups of class, id, role and label; whether the element is hidden; the label of a training page."""
    groups, hidden, known = set(), False, None
    if text.strip(" /\n"):
        for m in _ATTRIBUTE.finditer(text):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role", "aria-label", "itemprop"):
                groups |= {_GROUP_OF_TOKEN[t] for t in map(str.lower, _TOKEN.findall(value)) if t in _GROUP_OF_TOKEN}
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
            elif name == "known-label":
                known = int(value)
    return frozenset(groups), hidden, known


def markup(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Comments, declarations and tags in page order, in one pass: begin, end, name of a tag, whether it is an end tag, attributes.

    A tag ends at the first ``>`` outside of quotes, or if there is none at the first one.  A search for it that failed
    isn't made again: it fails wherever it opens a quote at a place where one was opened in vain.
    """
    at, last, vain = 0, page.rfind(">"), set()
    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else len(page)
            yield begin, at, None, False, ""
            continue
        if begin >= last:  # only a comment can follow
            if (at := page.find("<!--", begin)) >= 0:
                yield at, len(page), None, False, ""
            return
        closes = page.startswith("/", begin + 1)
        name = _NAME.match(page, begin + 1 + closes)
        if name is None:
            at = begin + 1
            if page[at] in "!?":
                at = page.index(">", at) + 1
                yield begin, at, None, False, ""
            continue
        if name.end() > last:
            at = begin + 1
            continue
        end, opened = name.end(), []
        while (event := _EVENT.search(page, end)) and event[0] != ">":
            if (quote := event.start()) in vain or (end := page.find(event[0], quote + 1) + 1) == 0:
                vain.add(quote)
                event = None
                break
            opened.append(quote)
        if event is None:
            vain.update(opened)
        stop = event.start() if event else page.index(">", name.end())
        at = stop + 1
        yield begin, at, name[0], closes, page[name.end() : stop]


def tree(page: str) -> Node:
    """The element tree of a page; end tags that are left out are supplied, stray ones ignored."""
    root = now = Node("html", None)
    at, open_tags = 0, Counter()

    def left(to: Node) -> Node:
        """Leaves the open elements up to one, which is left open."""
        up = now
        while up is not to:
            open_tags[up.tag] -= 1
            up = up.parent
        return to

    for begin, end, name, closes, attributes in markup(page):
        if begin < at:
            continue
        if begin > at:
            now.parts.append(html.unescape(page[at:begin]))
        at = end
        if not name:
            continue
        tag = name.lower()
        if closes:
            if open_tags[tag] > 0:
                up = now
                while up.tag != tag:
                    up = up.parent
                now = left(up.parent)
            continue
        if tag in ("html", "body") and (tag == "html" or now is root):
            if tag == "body":
                now.parts.append(body := Node("body", now))
                now = body
                open_tags[tag] += 1
            continue
        if tag in _GROUP and (ended := now.near[_GROUP[tag]]) is not None:
            now = left(ended.parent)
        node = Node(tag, now, *_attributes(attributes))
        now.parts.append(node)
        if tag in RAW:
            closing = _RAW_END[tag].search(page, at)
            if tag == "xmp":
                node.parts.append(page[at : closing.start() if closing else len(page)])
            at = closing.end() if closing else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            now = node
            open_tags[tag] += 1
    if at < len(page):
        now.parts.append(html.unescape(page[at:]))
    return root


def nodes_of(root: Node) -> list[Node]:
    """Elements that can hold text, parents first, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.parts) if isinstance(c, Node) and c.tag not in SILENT and c.tag not in VOID and not c.hidden]
    return out


N_FEATURES = _N_TAGS + 2 * _N_TOKENS + 27


def features(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, the place of each node's parent (-1: none), and the characters of its own text."""
    n = len(nodes)
    number = {id(v): i for i, v in enumerate(nodes)}
    parent = np.array([number[id(v.parent)] if v.parent is not None else -1 for v in nodes])
    own = np.zeros(n)
    count = np.zeros((n, 6))  # characters, characters in links, elements, sentence ends, paragraphs, words
    x = np.zeros((n, N_FEATURES), np.float32)
    depth = np.zeros(n)
    start = np.zeros(n)
    chars = 0
    linked = np.zeros(n, bool)
    tag, up_tag = np.zeros(n, int), np.zeros(n, int)
    tokens = np.zeros((n, _N_TOKENS))
    above = np.zeros((n, _N_TOKENS))
    container = np.zeros((n, 6))  # article or main, nav, header, footer, aside, form somewhere above
    kinds = {7: 0, 8: 0, 9: 1, 10: 2, 11: 3, 12: 4, 13: 5}
    for i, v in enumerate(nodes):
        tag[i] = _GROUP_OF_TAG.get(v.tag, _N_TAGS - 1)
        for t in v.tokens:
            tokens[i, t] = 1
        if (p := parent[i]) >= 0:
            depth[i], linked[i] = depth[p] + 1, linked[p] or v.tag == "a"
            up_tag[i] = tag[p]
            above[i] = np.maximum(above[p], tokens[p])
            container[i] = container[p]
            if tag[p] in kinds:
                container[i, kinds[tag[p]]] = 1
        text = " ".join(c for c in v.parts if isinstance(c, str))
        size = len(" ".join(text.split()))
        start[i] = chars
        chars += size
        own[i] = size
        count[i] = (size, size * linked[i], 1, text.count(". ") + text.count("! ") + text.count("? ") + text.rstrip().endswith((".", "!", "?")), v.tag == "p", text.count(" "))
    total = count.copy()
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    size = total[:, 0]
    density = total[:, 1] / np.maximum(1, size)
    # siblings: elements of one parent stand in page order
    order = np.lexsort((np.arange(n), parent))
    before, after = np.full(n, -1), np.full(n, -1)
    same = parent[order[1:]] == parent[order[:-1]]
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    siblings = np.bincount(parent + 1, minlength=n + 1)[parent + 1]
    first = np.searchsorted(parent[order], parent)
    rank = np.empty(n)
    rank[order] = np.arange(n)
    x[np.arange(n), tag] = 1
    x[:, _N_TAGS : _N_TAGS + _N_TOKENS] = tokens
    x[:, _N_TAGS + _N_TOKENS : _N_TAGS + 2 * _N_TOKENS] = above
    up = np.maximum(parent, 0)
    pick = lambda v, at: np.where(at >= 0, v[np.maximum(at, 0)], -1)
    whole = max(1.0, size[0])
    x[:, _N_TAGS + 2 * _N_TOKENS :] = np.stack(
        [np.log1p(size), density, np.log1p(total[:, 2]), size / total[:, 2], total[:, 3], total[:, 4], np.log1p(own), size / whole, start / whole, depth, siblings, rank - first, (rank - first) / np.maximum(1, siblings), np.log1p(np.maximum(0, pick(size, before))), np.log1p(np.maximum(0, pick(size, after))), pick(density, before), pick(density, after), size[up] / whole, density[up], total[up, 4], total[up, 3] / np.maximum(1, total[up, 4]), *container.T],
        axis=1,
    )
    return x, parent, own


def decode(logit: np.ndarray, parent: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the choice of largest sum in which no node is kept below a dropped one."""
    logit = np.clip(logit, -6, 6)
    gain = logit * (1 + own)
    best = gain.copy()
    for i in range(len(gain) - 1, 0, -1):
        if best[i] > 0:
            best[parent[i]] += best[i]
    keep = best > 0
    keep[0] = True
    for i in range(1, len(gain)):
        keep[i] &= keep[parent[i]]
    return keep


def blocks(nodes: list[Node], keep: np.ndarray, logit: np.ndarray) -> list[str]:
    """Texts of the kept elements, white space folded, a block at a time."""
    kept = {id(v): z > 0 for v, k, z in zip(nodes, keep, logit, strict=True) if k}
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    todo: list[Node | str | None] = [nodes[0]]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif id(item) in kept:
            parts = [c for c in item.parts if isinstance(c, Node) or kept[id(item)]]
            if item.tag not in INLINE:
                flush()
                todo.append(None)
            todo += reversed(parts)
        elif item.tag == "br":
            line.append(" ")
        elif item.tag not in INLINE:
            flush()
    flush()
    return out


def extract(pages: list[str | None], model: Trees) -> list[str]:
    """The main text of each page."""
    trees = [nodes_of(tree(p or "")) for p in pages]
    seen = [features(t) for t in trees]
    logits = model.logit(np.concatenate([s[0] for s in seen])) if seen else np.zeros(0)
    out, at = [], 0
    for nodes, (_, parent, own) in zip(trees, seen, strict=True):
        z = logits[at : at + len(nodes)]
        at += len(nodes)
        out.append("\n".join(blocks(nodes, decode(z, parent, own), z)))
    return out


# --- training pages --------------------------------------------------------------------------------------------------

SENTENCES = ("The river rose in the night.", "Nobody had expected so much rain.", "By noon the bridge was closed.", "A new report explains why.", "Read on for the details.", "It took years to build.", "The council will meet on Monday.", "Prices have gone up again.")


def sample_lines(pages: list[str | None]) -> list[list[str]]:
    """Text lines of each page, to fill layouts with; where they stood in the page doesn't matter."""
    out = []
    for page in pages:
        nodes = nodes_of(tree(page or ""))
        lines = blocks(nodes, np.ones(len(nodes), bool), np.ones(len(nodes)))
        if lines:
            out.append(lines)
    return out or [list(SENTENCES)]


def layout(lines: list[str], other: list[str], rng: random.Random) -> str:
    """A page in a random layout; the attribute known-label says of elements whether they are article."""
    pick, yes = rng.choice, lambda p: rng.random() < p
    short = [x for x in other if len(x) < 60] or ["Home", "News"]
    e = html.escape

    def words(n: int) -> str:
        return " ".join(pick(other).split()[:n]) or "More"

    def links(n: int, bare: bool = False) -> str:
        own = "".join(f'<a href="/{i}">{e(words(rng.randint(1, 5)))}</a> ' if bare else f'<li><a href="/{i}">{e(words(rng.randint(1, 6)))}</a></li>' for i in range(n))
        return own if bare else f"<ul>{own}</ul>"

    def off(tag: str, names: str, inner: str) -> str:
        name = pick(names.split())
        attr = pick((f' class="{name}"', f' id="{name}"', f' class="{name} {pick(("box", "block", "wide"))}"', f' class="{pick(("site", "page", "block"))}-{name}"'))
        return f'<{tag}{attr} known-label="0">{inner}</{tag}>'

    def talk() -> str:
        return "".join(f"<{t}>{e(pick(other))}</{t}>" for t in [pick(("p", "div", "p"))] * rng.randint(1, 4))

    def ad() -> str:
        return off(pick(("div", "div", "aside", "p", "section")), "ad ads advert advertisement sponsored promo", e(pick(other)) if yes(0.6) else f"<p>{e(pick(other))}</p>")

    body = []
    title = lines[0]
    if yes(0.8):
        body.append(f"<h1>{e(title)}</h1>")
    if yes(0.2):
        body.append(off("div", "share social meta tools", links(3, True)))
    rest = list(lines[1:] or lines)
    rng.shuffle(rest)
    for x in rest[: rng.randint(1, 30)]:
        kind = rng.random()
        if kind < 0.72:
            body.append(f"<p>{e(x)}</p>" if yes(0.75) else f"<p><b>{e(x[:40])}</b>{e(x[40:])}" if yes(0.5) else f'<p>{e(x[:60])} <a href="/x">{e(words(3))}</a> <em>{e(x[60:])}</em></p>')
        elif kind < 0.78:
            body.append(f"<h{(k := rng.randint(2, 4))}>{e(words(6))}</h{k}>")
        elif kind < 0.84:
            body.append("<ul>" + "".join(f"<li>{e(words(12))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.88:
            body.append(f"<blockquote><p>{e(x)}</p></blockquote>" if yes(0.5) else f"<blockquote>{e(x)}</blockquote>")
        elif kind < 0.91:
            body.append(f'<figure><img src="a.png"><figcaption>{e(words(10))}</figcaption></figure>')
        elif kind < 0.94:
            body.append("<table>" + "".join(f"<tr><td>{e(words(2))}</td><td>{e(words(3))}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.96:
            body.append(f"<div>{e(x)}</div>" if yes(0.6) else f"<pre>{e(x)}</pre>")
        elif kind < 0.98:
            body.append(ad())
        else:
            body.append(off("div", "related newsletter subscribe share", f"<p>{e(words(8))}</p>" + links(3)))
    opening, closing = pick((("<article{}>", "</article>"), ("<article{}>", "</article>"), ("<main{}>", "</main>"), ('<div class="content"{}>', "</div>"), ('<div class="post-body"{}>', "</div>"), ('<section class="article-text"{}>', "</section>"), ('<div id="story"{}>', "</div>"), ("<div{}>", "</div>"), ('<div class="entry"{}><div class="entry-content">', "</div></div>"), ('<main{}><article class="post">', "</article></main>")))
    article = opening.format(' known-label="1"') + "".join(body) + closing
    tops = [off("nav", "nav menu main-menu", links(rng.randint(3, 9))) if yes(0.6) else off("div", "nav navbar menu", links(rng.randint(3, 9), yes(0.5)))]
    if yes(0.5):
        tops.append(off(pick(("header", "header", "div")), "header masthead banner top", f"<h2>{e(pick(short))}</h2><p>{e(words(9))}</p>" + (links(3) if yes(0.5) else "")))
    if yes(0.4):
        tops.append(off(pick(("div", "section", "aside")), "cookie-notice consent notice alert gdpr cookies", f"<p>{e(pick(other))}</p><a href='#'>OK</a>"))
    if yes(0.6):
        tops.append(ad())
    if yes(0.2):
        tops.append(off("div", "breadcrumb breadcrumbs", links(3, True)))
    rng.shuffle(tops)
    ends = []
    if yes(0.5):
        ends.append(off(pick(("aside", "aside", "div")), "sidebar widget related rail popular", f"<h3>{e(words(3))}</h3>" + (links(rng.randint(3, 8)) if yes(0.6) else talk())))
    if yes(0.4):
        ends.append(off(pick(("section", "div", "ol")), "comments comment-list discussion responses", f"<h3>{rng.randint(1, 40)} {e(words(2))}</h3>" + "".join(f'<div class="{pick(("comment", "reply", "item"))}"><b>{e(words(2))}</b>{talk()}</div>' for _ in range(rng.randint(1, 5)))))
    if yes(0.4):
        ends.append(off("form", "search newsletter subscribe login contact", f"<label>{e(words(3))}</label><input name=q><p>{e(words(8))}</p>"))
    if yes(0.3):
        ends.append(ad())
    rng.shuffle(ends)
    ends.append(off("footer", "footer site-footer", f"&copy; {e(words(12))}" + (links(4) if yes(0.4) else f"<p>{e(pick(other))}</p>" if yes(0.4) else "")) if yes(0.7) else off("div", "footer bottom copyright", f"<p>&copy; {e(words(15))}</p>"))
    plain = yes(0.3)
    if plain:  # bare semantic elements, as in hand-written pages
        tops = [re.sub(r'<(nav|header|footer|aside|form) (?:class|id)="[^"]*"', r"<\1", t) for t in tops]
        ends = [re.sub(r'<(nav|header|footer|aside|form) (?:class|id)="[^"]*"', r"<\1", t) for t in ends]
    wrap = ('<div class="wrapper">', "</div>") if yes(0.3) else ("", "")
    side = [ends.pop(0)] if len(ends) > 1 and yes(0.3) else []
    return f"<!DOCTYPE html><html><head><title>{e(title)}</title></head><body>{''.join(tops)}{wrap[0]}{''.join(side)}{article}{''.join(ends)}{wrap[1]}</body></html>"


def known_labels(nodes: list[Node]) -> np.ndarray:
    """1: inside the article, 0: not, -1: a container of both."""
    label = {}
    for v in nodes:
        label[id(v)] = v.known if v.known is not None else label[id(v.parent)] if v.parent is not None else -1
    return np.array([label[id(v)] for v in nodes])


def train(pages: list[str | None], layouts: int = LAYOUTS, seed: int = 7) -> Trees:
    rng, lines = random.Random(seed), sample_lines(pages)
    xs, ys, ws = [], [], []
    for own in lines:
        for _ in range(layouts):
            nodes = nodes_of(tree(layout(own, pick_other(lines, rng), rng)))
            x, _, size = features(nodes)
            y = known_labels(nodes)
            xs.append(x[y >= 0])
            ys.append(y[y >= 0])
            ws.append(1 + np.log1p(size[y >= 0]))
    return fit(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


def pick_other(lines: list[list[str]], rng: random.Random) -> list[str]:
    return [x for own in rng.sample(lines, min(3, len(lines))) for x in own]


def trained_on(pages: DataFrame, column: str = "html", most: int = TRAIN_PAGES) -> Trees:
    """A model fitted to layouts filled with the text of at most ``most`` pages, those with the least hash."""
    usable = pages.select(F.col(column).cast("string").alias("h")).where(F.length("h").between(1, TRAIN_CHARS)).withColumn("k", F.xxhash64("h"))
    # the keys are chosen by their numbers alone; only the chosen pages travel, equal ones once
    keys = [r.k for r in least_keys(usable.select("k"), most)]
    if not keys:
        return train([])
    few = usable.where(F.col("k").isin(keys)).groupBy("k").agg(F.min("h").alias("h"))
    return train([r.h for r in few.orderBy("k").collect()])


def main_text(pages: DataFrame, model: Trees, keys: list[str], column: str = "html") -> DataFrame:
    """``keys, text, n_chars`` of each page."""
    schema = pages.select(*keys).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_html", 2 << 20):
                texts = extract(part.column("_html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keys, "text", "n_chars"])

    return pages.select(*keys, F.col(column).cast("string").alias("_html")).mapInArrow(lean(run), f"{ddl}, text string, n_chars long")
