"""Main text of web pages by a tree-structured graphical model.

A page's DOM is a tree of block elements with its text blocks as leaves. Each node has a hidden state:
content (all its text is main text), boilerplate (none is) or mixed. A node emits what it looks like
(its tag under its parent's, the share of links in it, words of its class and id; of text blocks the share of links, the length and the last
character); parent-child potentials tie the states together. Sum-product messages go up from the
leaves and down from the root, and leave each node's marginal. A text block belongs to the main text
if its marginal for content is over one half.

Potentials are counted, with smoothing, from labelled pages: pairs of html and main text. The model
that ships is trained on TRAINING_PAGES pages that ``labelled_pages`` makes up, in many layouts.

Plain elements that only wrap one of their own tag count once, however many they are.

Defined cases: null or empty html has the text "". A page costs its length, however deep or unclosed its tags are. Tags that are left open are closed as browsers do;
markup that ends early ends the page. Scripts, styles and other raw elements never are text. Repeated
rows are judged each on its own. Extra columns are ignored. Nothing is shuffled.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tripleweave.llm.textmap import unused, with_text_columns

TRAINING_PAGES, TRAINING_SEED = 800, 11

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template iframe object svg math textarea title select canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var button".split())
_BREAK = frozenset(("br", "wbr"))
_CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li body".split())
#: An opening tag ends an open element of these, up to the tag that holds them.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ("html",)),
}
_TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")

#: Words of classes, ids and roles that tell what a block is.
KEYWORDS = {
    "advert": "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "side": "sidebar side aside widget rail related recommended popular trending share social tags tag complementary",
    "comment": "comment comments reply replies respond discussion disqus reader readers",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login paywall dialog",
    "frame": "header head footer foot masthead topbar copyright legal contentinfo site brand logo",
    "content": "article content post entry story main body text copy prose",
}
_KEYWORD = {w: k for k, words in KEYWORDS.items() for w in words.split()}
_TAGS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 nav header footer aside form ul ol li table tr td blockquote pre figure figcaption head dl dd dt".split())

CONTENT, BOILERPLATE, MIXED = 0, 1, 2


class Node:
    __slots__ = ("tag", "marks", "children", "parent", "text", "links", "chars")

    def __init__(self, tag: str, marks: str = "", parent: Node | None = None):
        self.tag, self.marks, self.parent, self.children, self.text, self.links, self.chars = tag, marks, parent, [], "", 0, 0


def _tag_end(page: str, at: int) -> int:
    """Where the tag that begins at ``at`` ends, with quoted attributes as one; -1 if it doesn't."""
    end = page.find(">", at)
    quote = re.compile(r"""=\s*(["'])""")
    m = quote.search(page, at, end + 1)
    while m:
        close = page.find(m[1], m.end())
        if close < 0:
            return end
        if close > end:
            end = page.find(">", close)
            if end < 0:
                return -1
        m = quote.search(page, close + 1, end + 1)
    return end


class _Stack:
    """The open elements. Where each tag, and each block, is open is kept beside, so that nothing is searched and a page costs its length however deep it is."""

    def __init__(self, root: Node):
        self.nodes, self.blocks, self.open = [root], [0], defaultdict(list)

    def push(self, node: Node) -> None:
        self.open[node.tag].append(len(self.nodes))
        if node.tag not in INLINE:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open[t]), default=0)

    def cut(self, i: int) -> None:
        while len(self.nodes) > i:
            self.open[self.nodes.pop().tag].pop()
        while self.blocks[-1] >= i:
            self.blocks.pop()

    @property
    def holder(self) -> Node:
        return self.nodes[self.blocks[-1]]


def _summed(root: Node) -> None:
    """Leaves out plain elements that only wrap one of their own tag, and gives each element the characters and linked characters within it."""
    order = _order(root)
    for n in reversed(order):
        for i, c in enumerate(n.children):
            if c.tag == n.tag and len(n.children) == 1 and not n.marks and n.parent is not None:
                n.marks, n.children = c.marks, c.children
                for x in n.children:
                    x.parent = n
        n.chars, n.links = (len(n.text), n.links) if n.tag == "#text" else (sum(c.chars for c in n.children), sum(c.links for c in n.children))


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and the text blocks in page order."""
    root = Node("#root")
    stack, blocks = _Stack(root), []
    run: list[tuple[str, bool]] = []

    def flush() -> None:
        text = " ".join("".join(x for x, _ in run).split())
        if text:
            leaf = Node("#text", "", stack.holder)
            leaf.text, leaf.links = text, sum(len(x.strip()) for x, linked in run if linked)
            leaf.parent.children.append(leaf)
            blocks.append(leaf)
        run.clear()

    def close(i: int) -> None:
        if stack.blocks[-1] >= i:
            flush()
        stack.cut(i)

    def say(text: str) -> None:
        if text:
            run.append((_html.unescape(text) if "&" in text else text, bool(stack.open["a"])))

    at, n, low = 0, len(page), None
    while at < n:
        open_at = page.find("<", at)
        if open_at < 0:
            say(page[at:])
            break
        say(page[at:open_at])
        if page.startswith("<!--", open_at):
            end = page.find("-->", open_at + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG_NAME.match(page, open_at + 1)
        if not m:
            if open_at + 1 < n and page[open_at + 1] in "!?/":
                end = page.find(">", open_at)
                at = n if end < 0 else end + 1
            else:
                run.append(("<", False))
                at = open_at + 1
            continue
        end = _tag_end(page, open_at)
        if end < 0:
            break
        tag, closing, at = m[1].lower(), page[open_at + 1] == "/", end + 1
        if closing:
            i = stack.last(tag)
            if i and not (tag in INLINE and stack.blocks[-1] >= i):
                close(i)
            continue
        if tag in _BREAK or tag == "hr":
            run.append((" ", False))
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            if page[end - 1] != "/":
                low = page.lower() if low is None else low
                end = low.find(f"</{tag}", at) if len(low) == n else page.find(f"</{tag}", at)
                at = n if end < 0 else end
            run.append((" ", False))
            continue
        if tag in VOID:
            continue
        if tag in _CLOSES_P:
            i = stack.last("p")
            if i:
                close(i)
        if tag in _ENDS:
            names, scope = _ENDS[tag]
            i = stack.last(*names)
            if i > stack.last(*scope):
                close(i)
        if tag not in INLINE:
            flush()
            node = Node(tag, page[m.end() : end] if end > m.end() else "", stack.holder)
            node.parent.children.append(node)
            stack.push(node)
        else:
            stack.push(Node(tag))
    flush()
    _summed(root)
    return root, blocks


def _looks(node: Node) -> tuple[tuple[str, str], ...]:
    if node.tag == "#text":
        words = node.text.count(" ") + 1
        size = "1" if words < 4 else "2" if words < 11 else "3" if words < 41 else "4"
        share = 3 * node.links / max(len(node.text), 1)
        return (("size", size), ("links", "0" if not node.links else str(1 + min(2, int(share)))), ("last", "stop" if node.text[-1] in ".!?…。\"”»" else "other"))
    marks = ()
    if node.marks:
        found = {_KEYWORD[w] for m in _MARKS.finditer(node.marks) for w in _WORD.findall(m[1].lower()) if w in _KEYWORD}
        marks = tuple(("mark", x) for x in sorted(found))
    tag, under = (n.tag if n is not None and n.tag in _TAGS else "other" for n in (node, node.parent))
    linked = "none" if not node.chars else str(min(2, int(3 * node.links / node.chars)) + (node.links > 0))
    return (("tag", tag), ("under", f"{under} {tag}"), ("linked", linked), *(marks or (("mark", "none"),)))


def _order(root: Node) -> list[Node]:
    """Parents before their children."""
    out = [root]
    for n in out:
        out.extend(n.children)
    return out


def states(root: Node, gold: Counter) -> list[tuple[Node, int]]:
    """Each node's true state, given how often each block of the main text occurs."""
    order = _order(root)
    left, kind = Counter(gold), {}
    leaves = [n for n in order if n.tag == "#text"]
    for n in sorted(leaves, key=lambda n: -_depth(n)):
        kind[id(n)] = {CONTENT if left[n.text] > 0 else BOILERPLATE}
        left[n.text] -= 1
    for n in reversed(order):
        if n.tag != "#text":
            kind[id(n)] = set().union(*(kind[id(c)] for c in n.children)) if n.children else set()
    out = []
    for n in order:
        k = kind[id(n)]
        out.append((n, MIXED if len(k) > 1 else next(iter(k), BOILERPLATE)))
    return out


def _depth(n: Node) -> int:
    d = 0
    while n.parent is not None:
        n, d = n.parent, d + 1
    return d


class Model:
    """Potentials of the tree. ``edge[kind][parent][child]`` for element and text children; ``look[feature][state]``."""

    def __init__(self, pages: Iterable[tuple[str, str]], smooth: float = 0.02):
        edge = {k: [[smooth] * 3 for _ in range(3)] for k in ("element", "#text")}
        look: dict[tuple, list[float]] = defaultdict(lambda: [0.0] * 3)
        for page, text in pages:
            root, _ = parse(page)
            pairs = states(root, Counter(text.split("\n")))
            state = {id(n): s for n, s in pairs}
            for n, s in pairs:
                for f in _looks(n):
                    look[f][s] += 1
                if n.parent is not None:
                    edge["#text" if n.tag == "#text" else "element"][state[id(n.parent)]][s] += 1
        self.edge = {k: [[x / sum(row) for x in row] for row in rows] for k, rows in edge.items()}
        totals: dict[str, list[float]] = defaultdict(lambda: [0.0] * 3)
        values: dict[str, int] = Counter(f[0] for f in look)
        for f, n in look.items():
            totals[f[0]] = [a + b for a, b in zip(totals[f[0]], n)]
        self.look = {f: tuple((n[s] + smooth) / (totals[f[0]][s] + smooth * (values[f[0]] + 1)) for s in range(3)) for f, n in look.items()}

    def _emits(self, node: Node) -> tuple[float, float, float]:
        a = b = c = 1.0
        tag = None
        for f in _looks(node):
            x = self.look.get(f)
            if f[0] == "tag":
                tag = x
                continue
            if x is None and f[0] == "under":  # a pair of tags that no labelled page had
                x = tag
            if x:
                a, b, c = a * x[0], b * x[1], c * x[2]
        if node.tag == "#text":
            c = 0.0
        return a, b, c

    def marginals(self, root: Node) -> dict[int, tuple[float, float, float]]:
        """By ``id`` of the node: the probabilities of content, boilerplate and mixed."""
        order = _order(root)
        below: dict[int, tuple] = {}
        up: dict[int, tuple] = {}
        for n in reversed(order):
            a, b, c = self._emits(n)
            for child in n.children:
                x, y, z = up[id(child)]
                a, b, c = a * x, b * y, c * z
                s = a + b + c
                if s < 1e-100:
                    a, b, c = a / s, b / s, c / s
            s = (a + b + c) or 1.0
            below[id(n)] = a, b, c = a / s, b / s, c / s
            m0, m1, m2 = self.edge["#text" if n.tag == "#text" else "element"]
            up[id(n)] = (m0[0] * a + m0[1] * b + m0[2] * c, m1[0] * a + m1[1] * b + m1[2] * c, m2[0] * a + m2[1] * b + m2[2] * c)
        out = {id(root): below[id(root)]}
        for n in order:
            a, b, c = out[id(n)]
            for child in n.children:
                x, y, z = up[id(child)]
                u, v, w = a / x if x else 0.0, b / y if y else 0.0, c / z if z else 0.0
                m0, m1, m2 = self.edge["#text" if child.tag == "#text" else "element"]
                p, q, r = below[id(child)]
                p, q, r = p * (u * m0[0] + v * m1[0] + w * m2[0]), q * (u * m0[1] + v * m1[1] + w * m2[1]), r * (u * m0[2] + v * m1[2] + w * m2[2])
                s = (p + q + r) or 1.0
                out[id(child)] = p / s, q / s, r / s
        return out

    def extract(self, page: str) -> str:
        root, blocks = parse(page)
        if not blocks:
            return ""
        got = self.marginals(root)
        return "\n".join(b.text for b in blocks if got[id(b)][CONTENT] > 0.5)


def labelled_pages(n: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> list[tuple[str, str]]:
    """Made-up pages with their main text: articles of one to forty blocks among menus, headers, footers, sidebars, notices, adverts, forms and comments, in clean and in careless markup."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéüñß"

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(r.randint(a, b)))

    def sentence(a: int, b: int) -> str:
        return words(a, b).capitalize() + r.choice(("." if r.random() < 0.8 else "?", "!", "."))

    def prose(a: int, b: int) -> str:
        return " ".join(sentence(1, 18) for _ in range(r.randint(a, b)))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 2)}</a></li>' for _ in range(k))

    def named(tag: str, names: str) -> str:
        return f'<{tag} class="{r.choice(names.split())}">'

    def menu() -> str:
        return r.choice((f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>", f"{named('div', 'menu navbar nav')}<ul>{links(r.randint(2, 8))}</ul></div>"))

    def advert() -> str:
        return f"{named('div', 'ad advert banner sponsored promo')}{r.choice((prose(1, 2), f'<p>{prose(1, 2)}</p>', words(1, 6)))}</div>"

    def notice() -> str:
        return f"{named('div', 'cookie-notice consent alert newsletter')}<p>{prose(1, 2)}</p><button>{words(1, 2)}</button></div>"

    def side() -> str:
        open_tag = r.choice(("<aside>", '<aside class="sidebar">', '<div class="sidebar">', '<div id="sidebar">', '<div class="widget related">'))
        inside = r.choice((f"<ul>{links(4)}</ul>", f"<p>{prose(1, 3)}</p>", f"<ul>{links(3)}</ul><p>{prose(1, 3)}</p>"))
        return f"{open_tag}{r.choice(('', f'<h3>{words(1, 3)}</h3>'))}{inside}</{open_tag[1:].split(' ')[0].rstrip('>')}>"

    def form() -> str:
        return f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><p>{prose(1, 1)}</p><button>{words(1, 1)}</button></form>'

    def comments() -> str:
        outer, one = r.choice((("section", "div"), ("div", "div"), ("ol", "li"), ("ul", "li"), ("div", "article")))
        mark = r.choice(('class="comments"', 'id="comments"', 'class="comment-list"', 'class="replies"', 'id="discussion"', 'class="reader-comments"'))
        own = r.choice(("", ' class="comment"', ' class="reply"'))
        each = (r.choice((f"<p>{prose(1, 4)}</p>", f"<b>{words(1, 2)}</b> {prose(1, 3)}", prose(1, 3))) for _ in range(r.randint(1, 5)))
        head = f"<h3>{words(1, 2)}</h3>" if one != "li" and r.random() < 0.7 else ""
        return f"<{outer} {mark}>{head}{''.join(f'<{one}{own}>{x}</{one}>' for x in each)}</{outer}>"

    def header() -> str:
        inside = r.choice((f"<h1>{words(1, 3)}</h1>", f'<div class="logo">{words(1, 2)}</div>', f"<p>{prose(1, 1)}</p>", words(1, 3))) + r.choice(("", menu()))
        return r.choice((f"<header>{inside}</header>", f'<div id="header">{inside}</div>', f'<div class="site-header">{inside}</div>'))

    def footer() -> str:
        inside = r.choice((f"&copy; {words(1, 2)} &middot; {prose(1, 3)}", f"<p>{prose(1, 2)}</p>", f"<ul>{links(3)}</ul>"))
        return r.choice((f"<footer>{inside}</footer>", f"<footer>{inside}</footer>", f'<div class="footer">{inside}</div>', f'<div id="footer">{inside}</div>'))

    out = []
    for i in range(n):
        text, body = [], []
        careless, inserts = r.random() < 0.4, 0.15 * (r.random() < 0.2)
        for j in range(r.choice((1, 2, 3, 5, 8, 13, 25, 40))):
            t = prose(1, 6) if r.random() < 0.7 else sentence(1, 3)
            shape = r.random()
            if j == 0 and r.random() < 0.8:
                head = t[:60].strip()
                text.append(head)
                body.append(f"<header><h1>{head}</h1></header>" if r.random() < 0.12 else f"<h1>{head}</h1>")
            if r.random() < 0.1:
                items = [sentence(2, 8) if r.random() < 0.5 else words(1, 3) for _ in range(r.randint(2, 5))]
                text += items
                kind, inner = r.choice((("ul", "li"), ("ol", "li"), ("table", "td"), ("dl", "dd"), ("figure", "figcaption"), ("pre", "")))
                inside = "".join(f"<{inner}>{x}</{inner}>" for x in items) if inner else items[0]
                text[len(text) - len(items) :] = items if inner else items[:1]
                body.append(f"<{kind}>" + (f"<tr>{inside}</tr>" if kind == "table" else inside) + f"</{kind}>")
                continue
            if r.random() < inserts:
                body.append(r.choice((advert, side, comments, form, notice, menu))())
            if shape < 0.08:
                t = words(2, 5).capitalize()
                body.append(f"<h2>{t}</h2>")
            elif shape < 0.12:
                body.append(f"<blockquote>{t}</blockquote>")
            elif careless and shape < 0.4:
                body.append(f"<p><b>{t}<br>")
            else:
                body.append(f"<p>{t}" + ("</p>" if not careless or r.random() < 0.7 else ""))
            text.append(t)
        inner = "".join(body) + (comments() if r.random() < 0.12 else "")
        article = r.choice((f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main><article>{inner}</article></main>", f"<main>{inner}</main>", f"{named('div', 'content post entry-content article-body')}{inner}</div>", f"<div>{inner}</div>"))
        before = [x() for x in (header, menu, advert, notice, side, form) if r.random() < 0.4]
        after = [x() for x in (comments, side, advert, footer, form, menu) if r.random() < 0.45]
        middle = "".join(before) + article + "".join(after)
        if r.random() < 0.3:
            middle = f"<div id=\"wrapper\">{middle}</div>"
        end = "" if r.random() < 0.1 else "</body></html>"
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{middle}{end}", "\n".join(text)))
    return out


@lru_cache(maxsize=4)
def trained(n: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> Model:
    return Model(labelled_pages(n, seed))


def extracted(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Model | None = None) -> DataFrame:
    """The kept columns, ``text`` and ``n_chars``."""
    model = model or trained()

    def kernel(texts: list[bytes | None]) -> list:
        got = [model.extract(t.decode("utf-8", "replace")) if t else "" for t in texts]
        return [got, [len(x) for x in got]]

    return with_text_columns(pages, html, keep, [T.StructField(unused(keep, "text"), T.StringType()), T.StructField(unused(keep, "n_chars"), T.LongType())], kernel)


def confidence(marginal: tuple[float, float, float]) -> float:
    """Log odds of content, for looking at a page's marginals."""
    return math.log(max(marginal[CONTENT], 1e-300) / max(1 - marginal[CONTENT], 1e-300))
