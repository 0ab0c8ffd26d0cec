"""Main text of web pages by belief propagation over the DOM.

A page is read into a tree whose nodes are block elements and runs of text.
Each node is content or not. A node's potential is log-linear in its tag, its
class and id words and the shape of its text; each parent-child edge has a
potential for each pair of labels, by the parent's tag and the child's kind.
Sum-product messages go up and down the tree once and give every node's exact
marginal; runs of text above one half are kept in page order.

All potentials are trained together on labelled pages. ``labelled_pages`` makes them: pages
of many layouts with articles among menus, headers, sidebars, notices, adverts,
forms and reader comments, a label for each run of text. Their number is a
parameter (``TRAINING_PAGES``) and does not depend on the input.

Character references are decoded as in HTML5. White space, and a line break
element, become one space inside a block. Elements are closed as HTML5 implies
it (a paragraph by the next block, a list item by the next one, and so on);
an unfinished tag, comment or script at the end of a page is dropped. Formulas
(math) are text of their block; svg, select, template and noscript elements are
left out, but where their end tag is missing only the start tag is. Time and
memory are in proportion to the page, however deep it nests.

Defined results: a null or empty page gives an empty text; repeated rows give a
row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import by_bytes

TRAINING_PAGES = 500

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\s+|/|[^\s\"'>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]*))?|=|\"|')*?)(>|$)",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[a-z]+")

#: Element classes of HTML.
TEXT_ONLY = frozenset("script style textarea title iframe xmp noembed noframes".split())  # hold no elements
LEFT_OUT = TEXT_ONLY | frozenset("noscript template svg select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table caption colgroup tbody td tfoot th thead tr ul button label".split()
)
CLOSES_P = BLOCK - frozenset("html head body button label td th tr tbody thead tfoot caption colgroup".split())
#: What an opening tag closes when it is open, up to the elements that stop the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}


_END_OF = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in LEFT_OUT}


@dataclass
class Node:
    tag: str  # "#text" for a run of text
    parent: int
    attrs: str = ""
    text: list[str] = field(default_factory=list)
    linked: int = 0  # characters inside links
    links: int = 0


def parse(page: str) -> list[Node]:
    """Block elements and runs of text in page order; a parent comes before its children."""
    nodes = [Node("#root", -1)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open block elements
    places: dict[str, list[int]] = {}  # of each tag, where it stands in the stack
    run: Node | None = None
    anchors = 0
    at, end = 0, len(page)
    never: set[str] = set()  # tags of which no end follows, so that none is looked for again

    def say(text: str) -> None:
        nonlocal run
        if not text:
            return
        if run is None:
            if not text.strip():
                return
            run = Node("#text", stack[-1][1])
            nodes.append(run)
        run.text.append(text)
        if anchors:
            run.linked += len(text)

    def close_to(depth: int) -> None:
        nonlocal run
        while len(stack) > depth:
            places[stack.pop()[0]].pop()
        run = None

    def last(tags) -> int:
        """The innermost place of any of the tags, 0 if none is open."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        if m[4] != ">":  # an unfinished tag
            break
        tag = name.lower()
        if m[1]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in BLOCK:
                if depth := last((tag,)):
                    close_to(depth)
                run = None
            continue
        if tag in LEFT_OUT and not (tag == "svg" and m[3].rstrip().endswith("/")):
            stop = None if tag in never else _END_OF[tag].search(page, at)
            if stop:
                at = page.find(">", stop.start()) + 1 or end
            elif tag in TEXT_ONLY:  # the rest of the page is its text
                break
            else:
                never.add(tag)
            continue
        if tag == "br":
            if run is not None:
                run.text.append(" ")
            continue
        if tag == "a":
            anchors += 1
            if run is not None:
                run.links += 1
            continue
        if tag not in BLOCK:
            continue
        if tag in CLOSES_P and (depth := last(("p",))) > last(("button", "td", "th", "caption")):
            close_to(depth)
        if tag in IMPLIED:
            closes, stops = IMPLIED[tag]
            if (depth := last(closes)) > last(stops):
                close_to(depth)
        run = None
        anchors = 0 if tag in ("article", "main", "section", "p") else anchors
        if tag in VOID:
            continue
        nodes.append(Node(tag, stack[-1][1], m[3]))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, len(nodes) - 1))
    return nodes


def block_text(node: Node) -> str:
    return " ".join(_html.unescape("".join(node.text)).split())


def features(nodes: list[Node]) -> tuple[list[list[str]], list[str]]:
    """Named features of every node, and the text of every run ("" for elements)."""
    n = len(nodes)
    chars, linked, runs, links = [0] * n, [0] * n, [0] * n, [0] * n
    texts = [""] * n
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node.tag == "#text":
            texts[i] = block_text(node)
            chars[i], linked[i], runs[i], links[i] = len(texts[i]), min(node.linked, len(texts[i])), 1, node.links
        p = node.parent
        if p >= 0:
            chars[p] += chars[i]
            linked[p] += linked[i]
            runs[p] += runs[i]
            links[p] += links[i]
    out = []
    for i, node in enumerate(nodes):
        share = linked[i] / chars[i] if chars[i] else 0.0
        f = [
            "tag:" + node.tag,
            f"size:{min(8, chars[i].bit_length() // 2)}:{node.tag == '#text'}",
            f"mean:{min(9, (chars[i] // max(1, runs[i])).bit_length())}",
            f"link:{0 if share < 0.05 else 1 if share < 0.35 else 2 if share < 0.8 else 3}",
        ]
        if node.tag == "#text":
            f.append("in:" + nodes[node.parent].tag)
            t = texts[i]
            if "©" in t:
                f.append("sign")
        elif node.attrs:
            for name, a, b, c in _ATTR.findall(node.attrs):
                name = name.lower()
                if name in ("class", "id", "role"):
                    f += ["word:" + w for w in set(_NAME.findall((a or b or c).lower()))]
                elif name == "style" and "none" in (a or b or c):
                    f.append("hidden")
        out.append(f)
    return out, texts


@dataclass
class Model:
    """Log-odds weights of features and, per parent tag and kind of child, the potentials of label pairs."""

    weights: dict[str, float]
    pairs: dict[tuple[str, bool], tuple[float, float, float, float]]  # (tag, child is text) -> psi 00, 01, 10, 11 (parent, child); tag "": any

    def edge(self, nodes: list[Node]) -> list[tuple[float, float, float, float]]:
        get, text, other = self.pairs.get, self.pairs["", True], self.pairs["", False]
        return [get((nodes[x.parent].tag, True), text) if x.tag == "#text" else get((nodes[x.parent].tag, False), other) for x in nodes]

    def marginals(self, nodes: list[Node], named: list[list[str]]) -> list[float]:
        """Each node's probability of being content, by messages up and down."""
        get, n = self.weights.get, len(nodes)
        bias = self.weights.get("bias", 0.0)
        own = [bias + sum([get(f, 0.0) for f in fs]) for fs in named]  # log odds
        up = [0.0] * n
        total, pairs = own[:], self.edge(nodes)
        log, exp = math.log, math.exp
        for i in range(n - 1, 0, -1):
            p00, p01, p10, p11 = pairs[i]
            odds = exp(max(-30.0, min(30.0, total[i])))
            up[i] = log((p10 + p11 * odds) / (p00 + p01 * odds))
            total[nodes[i].parent] += up[i]
        for i in range(1, n):
            p00, p01, p10, p11 = pairs[i]
            odds = exp(max(-30.0, min(30.0, total[nodes[i].parent] - up[i])))
            total[i] += log((p01 + p11 * odds) / (p00 + p10 * odds))
        return [1 / (1 + exp(-max(-30.0, min(30.0, t)))) for t in total]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        named, texts = features(nodes)
        p = self.marginals(nodes, named)
        return "\n\n".join(t for t, x, node in zip(texts, p, nodes, strict=True) if x > 0.5 and node.tag == "#text" and t)


def train(pages: list[tuple[str, list[int]]], rounds: int = 400, ridge: float = 3e-5) -> Model:
    """Fit node and edge potentials together on pages whose runs of text are labelled in page order.

    Gradient steps on the likelihood of the labels given the page; each step
    needs every node's and edge's marginals, so messages run over all training
    trees at once, level by level.
    """
    names: dict[str, int] = {"bias": 0}
    kinds: dict[tuple[str, bool], int] = {("", False): 0, ("", True): 1}
    rows: list[list[int]] = []
    labels: list[int] = []
    parent: list[int] = []
    depth: list[int] = []
    kind: list[int] = []
    for page, marks in pages:
        nodes = parse(page)
        named, _ = features(nodes)
        y = [0] * len(nodes)
        runs = [i for i, x in enumerate(nodes) if x.tag == "#text"]
        if len(runs) != len(marks):
            raise ValueError("a page's labels do not match its runs of text")
        for i, mark in zip(runs, marks, strict=True):
            y[i] = mark
            while mark and (i := nodes[i].parent) >= 0:  # an element with content in it is content
                y[i] = 1
        base = len(rows)
        for i, (x, fs) in enumerate(zip(nodes, named, strict=True)):
            rows.append([names.setdefault(f, len(names)) for f in ("bias", *fs)])
            labels.append(y[i])
            parent.append(base + x.parent)
            depth.append(depth[base + x.parent] + 1 if i else 0)
            kind.append(kinds.setdefault((nodes[x.parent].tag, x.tag == "#text"), len(kinds)) if i else 0)
    at = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)])
    col = np.concatenate(rows)
    y, up_to, k = np.array(labels), np.array(parent), np.array(kind)
    shared = np.array([int(text) for _, text in kinds])  # every kind adds to one of the first two
    levels = [np.nonzero(np.array(depth) == d)[0] for d in range(1, max(depth) + 1)]
    w, w_speed = np.zeros(len(names)), np.full(len(names), 1e-8)
    theta, t_speed = np.zeros((len(kinds), 4)), np.full((len(kinds), 4), 1e-8)
    child = np.concatenate(levels)
    seen = np.zeros((len(kinds), 4))
    np.add.at(seen, (k[child], 2 * y[up_to[child]] + y[child]), 1)
    n = len(rows)

    def whole(t: np.ndarray) -> np.ndarray:
        out = t + t[shared]
        out[:2] = t[:2]
        return out

    for _ in range(rounds):
        psi = whole(theta)[k]
        total = np.bincount(at, w[col], n)
        up = np.zeros(n)
        for level in reversed(levels):
            t, q = total[level], psi[level]
            up[level] = np.logaddexp(q[:, 2], q[:, 3] + t) - np.logaddexp(q[:, 0], q[:, 1] + t)
            np.add.at(total, up_to[level], up[level])
        below = total.copy()
        for level in levels:
            ctx, q = total[up_to[level]] - up[level], psi[level]
            total[level] += np.logaddexp(q[:, 1], q[:, 3] + ctx) - np.logaddexp(q[:, 0], q[:, 2] + ctx)
        ctx = (total[up_to] - up)[child]
        joint = psi[child] + np.stack([np.zeros(len(child)), below[child], ctx, ctx + below[child]], 1)
        joint = np.exp(joint - joint.max(1, keepdims=True))
        joint /= joint.sum(1, keepdims=True)
        g = 1 / (1 + np.exp(-np.clip(total, -30, 30))) - y
        grad = np.bincount(col, g[at], len(w)) / n + ridge * w
        w_speed += grad * grad
        w -= 0.3 * grad / np.sqrt(w_speed)
        tg = np.zeros_like(theta)
        np.add.at(tg, k[child], joint)
        tg -= seen
        tg[:2] += np.stack([tg[shared == s].sum(0) - tg[s] for s in (0, 1)])
        tg = tg / n + ridge * theta
        t_speed += tg * tg
        theta -= 0.3 * tg / np.sqrt(t_speed)
    pairs = {name: tuple(np.exp(row).tolist()) for name, row in zip(kinds, whole(theta), strict=True)}
    return Model({f: float(w[i]) for f, i in names.items()}, pairs)


#: Words that sites use in class and id names of each part.
PART_WORDS = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs tabs mainmenu toc",
    "header": "header masthead topbar branding logo site-header banner-top hero-bar",
    "footer": "footer site-footer bottom colophon copyright legal credits",
    "side": "sidebar side aside widget related recommended popular trending more-stories rail toc tags tagcloud",
    "notice": "notice cookie consent gdpr alert banner notification popup modal disclaimer privacy overlay",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsbox banner-ad commercial",
    "form": "form newsletter subscribe signup login search contact subscription",
    "comments": "comments comment reply replies discussion responses disqus thread feedback user-comment",
    "share": "share social sharing buttons follow pagination pager author-links meta-links",
    "content": "content article post entry story main body text article-body post-content entry-content story-body",
    "neutral": "row col container wrapper inner block section box grid left right clearfix page layout",
}


def labelled_pages(number: int = TRAINING_PAGES, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages of many layouts with a label for each run of text."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprstv" for b in ("a", "e", "i", "o", "u", "an", "er", "is")]
    made: list[tuple[str, list[int]]] = []

    def words(n: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))

    def sentences(n: int) -> str:
        ends = rng.choice([".", ".", ".", ".", "", " |", "!!", " ###"])  # some texts are tables or noise
        return " ".join(words(rng.randint(4, 18)).capitalize() + rng.choice([ends, ends, "!", "?"]) for _ in range(n))

    for _ in range(number):
        labels: list[int] = []

        def run(text: str, mark: int) -> str:
            labels.append(mark)
            return text

        def names(part: str, sure: float = 0.75) -> str:
            if rng.random() > sure:
                return f' class="{rng.choice(PART_WORDS["neutral"].split())}"' if rng.random() < 0.5 else ""
            w = rng.choice(PART_WORDS[part].split())
            if rng.random() < 0.3:
                w += " " + rng.choice(PART_WORDS["neutral"].split())
            return f' {rng.choice(["class", "class", "id"])}="{w}"'

        def link_list(n: int) -> str:
            return "<ul>" + "".join(f'<li><a href="/x">{run(words(rng.randint(1, 4)), 0)}</a>' + rng.choice(["</li>", "</li>", ""]) for _ in range(n)) + "</ul>"

        def menu() -> str:
            t = rng.choice(["nav", "nav", "nav", "div", "ul"])
            if t == "ul":
                return f"<ul{names('menu', 1)}>" + "".join(f'<li><a href="/{i}">{run(words(1), 0)}</a></li>' for i in range(rng.randint(3, 8))) + "</ul>"
            if rng.random() < 0.3:
                return f"<{t}{names('menu', 1)}>" + run(" | ".join(f'<a href="/{i}">{words(1)}</a>' for i in range(rng.randint(2, 6))), 0) + f"</{t}>"
            return f"<{t}{names('menu', 0.4 if t == 'nav' else 1)}>{link_list(rng.randint(2, 8))}</{t}>"

        def head() -> str:
            t = rng.choice(["header", "header", "div"])
            inner = rng.choice([lambda: f"<h1>{run(words(2), 0)}</h1>", lambda: f'<a href="/">{run(words(2), 0)}</a>', lambda: f"<div class=\"logo\">{run(words(2), 0)}</div><p>{run(words(5), 0)}</p>"])()
            return f"<{t}{names('header', 0.5 if t == 'header' else 1)}>{inner}{menu() if rng.random() < 0.4 else ''}</{t}>"

        def foot() -> str:
            t = rng.choice(["footer", "footer", "footer", "div"])
            inner = rng.choice(
                [lambda: run(f"&copy; {words(2)} &middot; {sentences(rng.randint(1, 4))}", 0), lambda: f"<p>{run('&copy; 2024 ' + words(3), 0)}</p>" + link_list(rng.randint(2, 5)), lambda: f"<p>{run(sentences(rng.randint(1, 3)), 0)}</p>"]
            )()
            return f"<{t}{names('footer', 0.4 if t == 'footer' else 1)}>{inner}</{t}>"

        def side() -> str:
            t = rng.choice(["aside", "aside", "div", "section"])
            out = f"<{t}{names('side', 0.5 if t == 'aside' else 1)}><h3>{run(words(2), 0)}</h3>"
            out += link_list(rng.randint(2, 6)) if rng.random() < 0.6 else f"<p>{run(sentences(rng.randint(1, 3)), 0)}</p>"
            return out + f"</{t}>"

        def notice() -> str:
            inner = run(sentences(rng.randint(1, 3)), 0) if rng.random() < 0.5 else f"<p>{run(sentences(rng.randint(1, 2)), 0)}</p>"
            button = f"<button>{run(words(1), 0)}</button>" if rng.random() < 0.5 else ""
            return f"<{(t := rng.choice(['div', 'div', 'section', 'aside']))}{names('notice', 1)}>{inner}{button}</{t}>"

        def ad() -> str:
            t = rng.choice(["div", "div", "div", "aside", "section"])
            inner = run(sentences(rng.randint(1, 3)), 0) if rng.random() < 0.6 else f"<p>{run(sentences(1), 0)}</p>"
            return f"<!-- ad --><{t}{names('ad', 1)}>{inner}</{t}>"

        def form() -> str:
            label = f"<label>{run(words(2), 0)}</label>" if rng.random() < 0.6 else f"<p>{run(sentences(1), 0)}</p>"
            return f'<form{names("form", 0.6)} action="/go">{label}<input type="text"><button>{run(words(1), 0)}</button></form>'

        def comments() -> str:
            t = rng.choice(["section", "div", "div", "ol"])
            one, body = ("li", "p") if t == "ol" else (rng.choice(["div", "article"]), rng.choice(["p", "div"]))
            out = f"<{t}{names('comments', 1)}>" + (f"<h2>{run(words(2), 0)}</h2>" if t != "ol" else "")
            for _ in range(rng.randint(1, 5)):
                who = f"<b>{words(2)}</b> " if rng.random() < 0.4 else ""
                out += f'<{one}{names("comments", 0.8)}><{body}>{run(who + sentences(rng.randint(1, 5)), 0)}</{body}></{one}>'
            return out + f"</{t}>"

        def share() -> str:
            return f"<div{names('share', 1)}>" + run(" ".join(f'<a href="#">{words(1)}</a>' for _ in range(3)), 0) + "</div>"

        def piece() -> str:
            k = rng.random()
            if k < 0.72:
                t = sentences(rng.randint(1, 9)) if rng.random() < 0.85 else words(rng.randint(1, 6)) + "."
                if rng.random() < 0.2:
                    t = f"<b>{t}"
                if rng.random() < 0.15:
                    t += f' <a href="/see">{words(2)}</a> {sentences(1)}'
                if rng.random() < 0.1:
                    t += "<br>" + sentences(1)
                return f"<p>{run(t, 1)}" + rng.choice(["</p>", "</p>", "</p>", ""])
            if k < 0.82:
                return f"<h{(d := rng.randint(2, 4))}>{run(words(rng.randint(2, 6)), 1)}</h{d}>"
            if k < 0.89:
                return "<ul>" + "".join(f"<li>{run(sentences(1), 1)}" + rng.choice(["</li>", ""]) for _ in range(rng.randint(2, 5))) + "</ul>"
            if k < 0.93:
                return f"<blockquote><p>{run(sentences(2), 1)}</p></blockquote>"
            if k < 0.95:
                return f"<pre>{run(words(8), 1)}</pre>"
            if k < 0.97:
                return f"<figure><figcaption>{run(sentences(1), 1)}</figcaption></figure>"
            return "<table><tr>" + "".join(f"<td>{run(words(2), 1)}</td>" for _ in range(3)) + "</tr></table>"

        def article() -> str:
            t = rng.choice(["article", "article", "article", "main", "div", "section"])
            title = f"<h1>{run(words(rng.randint(2, 9)).capitalize(), 1)}</h1>" if rng.random() < 0.9 else ""
            if rng.random() < 0.15:
                title = f"<header>{title}</header>" if title else ""
            out = f"<{t}{names('content', 0.3 if t == 'article' else 0.95)}>{title}"
            wrap = rng.random() < 0.2
            out += f"<div{names('content', 0.8)}>" if wrap else ""
            for _ in range(rng.randint(1, 12)):
                out += piece()
                if rng.random() < 0.05:
                    out += rng.choice([ad, share, notice, side])()
            out += "</div>" if wrap else ""
            return out + f"</{t}>"

        parts = [head] * (rng.random() < 0.5) + [menu] * (rng.random() < 0.85)
        before = [notice] * (rng.random() < 0.35) + [ad] * (rng.random() < 0.5) + [form] * (rng.random() < 0.2) + [side] * (rng.random() < 0.2)
        rng.shuffle(before)
        after = [side] * (rng.random() < 0.35) + [comments] * (rng.random() < 0.4) + [form] * (rng.random() < 0.25) + [ad] * (rng.random() < 0.25) + [share] * (rng.random() < 0.2) + [notice] * (rng.random() < 0.15)
        rng.shuffle(after)
        end = [foot] * (rng.random() < 0.85) + [notice] * (rng.random() < 0.1)
        body = ""
        wrapped = rng.random() < 0.3
        for p in parts:
            body += p()
        body += f"<div{names('neutral', 1)}>" if wrapped else ""
        for p in [*before, article, *after]:
            body += p()
        body += "</div>" if wrapped else ""
        for p in end:
            body += p()
        made.append((f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{body}</body></html>", labels))
    return made


_MODEL: dict[tuple[int, int], Model] = {}


def default_model(number: int = TRAINING_PAGES, seed: int = 7) -> Model:
    if (number, seed) not in _MODEL:
        _MODEL[number, seed] = train(labelled_pages(number, seed))
    return _MODEL[number, seed]


def main_text(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html", 4 << 20):
            texts = [model.extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(run, f"page_id {src.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
