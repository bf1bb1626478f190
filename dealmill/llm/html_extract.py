"""Main-text extraction with a tree-structured graphical model over the DOM.

Variables are the block elements of a page and its runs of text (leaves); each is content or not. The joint
probability is a product of unary potentials (features of a node) and parent-child potentials. Both are trained
by the exact likelihood of labelled pages. One upward and one downward pass of sum-product messages give the exact
marginals of the tree; the text of runs whose marginal is at least one half is returned.
"""

from __future__ import annotations

import functools
import html as html_lib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template iframe canvas audio video select datalist title ~annotation ~annotation-xml ~mphantom ~defs ~desc ~metadata ~symbol".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math svg"
    " ~menclose ~merror ~mfrac ~mi ~mmultiscripts ~mn ~mo ~mover ~mpadded ~mroot ~mrow ~ms ~mspace ~msqrt ~mstyle ~msub ~msubsup ~msup ~mtable ~mtd ~mtext ~mtr ~munder ~munderover ~semantics"
    " ~circle ~ellipse ~g ~line ~path ~polygon ~polyline ~rect ~text ~textpath ~tspan ~use".split()
)
#: Formulas and drawings, in which "/>" closes an element and names with ~ are known.
FOREIGN = frozenset("math svg".split())
_OWN = frozenset(t[1:] for t in HIDDEN | INLINE if t[0] == "~")
#: A start tag of these closes an open element of the set, up to the given bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
P_STAYS_IN = frozenset("button table td th caption object".split())
CLOSES_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section"
    " summary table ul".split()
)

# Words of class, id and role attributes that tell kinds of regions apart.
CUES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toc pager pagination tabs toolbar".split(),
    "head": "header masthead banner logo topbar site-header branding".split(),
    "foot": "footer foot colophon copyright legal imprint bottom contentinfo".split(),
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular promo teaser complementary more".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored promotion banner-ad dfp adslot outbrain taboola".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall warning message dialog".split(),
    "comment": "comment comments reply replies respond disqus discussion thread reviews".split(),
    "share": "share sharing social follow like tweet tools meta byline tags tagcloud".split(),
    "main": "article content main post entry story body text article-body entry-content post-content main-content page-content maincontent".split(),
}
_CUE_OF = {w: k for k, ws in CUES.items() for w in ws}
TAGS = "article main section p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre table tr td th figure figcaption dl dt dd div nav header footer aside form fieldset button details summary body html address center".split()
KINDS = ("text", "flow", "region")
_REGION = frozenset("article main nav header footer aside form section div body html table ul ol".split())
FEATURES = [f"tag:{t}" for t in [*TAGS, "other"]] + [f"cue:{c}" for c in CUES] + [
    "bias", "leaf", "leaf:log chars", "leaf:links", "leaf:short", "leaf:ends", "leaf:mark", "leaf:share", "box:log chars", "box:links", "box:share", "box:sentences",
    "in article", "in article:header", "in article:footer", "in article:aside", "beside article", "in article:links", "in article:list", "linked sentence",
] + [f"under:{k}" for k in ("nav", "foot", "side", "ad", "notice", "comment", "share", "form")]
_AT = {f: i for i, f in enumerate(FEATURES)}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v   -     　\u0085\x1c-\x1f]+")
_CUT = re.compile(r"[^a-z0-9]+")
_MARKS = re.compile(r"[©®]|all rights reserved|cookie|subscribe|sign up|log in|advertis|sponsored", re.I)


_ENDS = ".!?…\"”'’"
_APART = frozenset(("nav", "foot", "side", "ad", "notice", "comment"))
#: Kinds of regions that what lies in them belongs to, by cue and by element. Names of what holds a whole page, or an article, tell nothing of its parts.
_UNDER = frozenset((*_APART, "share"))
_UNDER_TAG = {"nav": "nav", "footer": "foot", "aside": "side", "form": "form"}
_WHOLE = frozenset("html body main article".split())


class Node:
    __slots__ = ("tag", "cues", "parent", "text", "chars", "linked", "sentences", "truth", "apart", "inside", "holds", "share", "beside", "under")

    def __init__(self, tag: str, parent: Node | None, cues: tuple[str, ...] = (), text: str | None = None, linked: int = 0, truth: bool | None = None):
        self.tag, self.parent, self.cues, self.text, self.linked, self.truth = tag, parent, cues, text, linked, truth
        self.chars, self.sentences = (len(text), int(len(text) > 40 and text[-1] in _ENDS)) if text is not None else (0, 0)
        up_apart, up_inside = (parent.apart, parent.inside) if parent is not None else (False, False)
        self.apart = up_apart or tag in _UNDER_TAG or (tag not in _WHOLE and not _APART.isdisjoint(cues))  # in a region of another kind
        self.inside = up_inside or (tag in ("article", "main") and not self.apart)
        self.holds, self.share, self.beside, self.under = self.inside and not up_inside, 0.0, False, frozenset()


def parse(page: str) -> list[Node]:
    """The tree in document order (root first): block elements and runs of text, hidden content left out.

    Hidden is what browsers don't show (scripts, styles, the attribute hidden, display: none) and what is marked
    aria-hidden; of formulas that come twice, the one for screen readers is read. Character references are decoded,
    runs of white space are one space, runs without other characters vanish. Unclosed and stray tags are handled
    as browsers do, in outline.
    """
    root = Node("html", None)
    nodes = [root]
    stack = [("html", root, True, 0)]  # tag, node, shown, whether it hides what it holds
    hidden, links, foreign, run, linked = 0, 0, 0, [], 0
    pos, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if run:
            text = _SPACE.sub(" ", html_lib.unescape("".join(run))).strip()
            run.clear()
            if text:
                nodes.append(Node("#text", stack[-1][1], text=text, linked=min(linked, len(text)), truth=stack[-1][1].truth))
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal hidden, links, foreign
        if any(shown and t not in INLINE for t, _, shown, _ in stack[k:]):
            flush()
        for t, _, _, hides in stack[k:]:
            hidden -= hides
            links -= t == "a"
            foreign -= t in FOREIGN
            if t == "~text" and not hidden:
                run.append(" ")
        del stack[k:]

    while pos < size:
        at = page.find("<", pos)
        if at != pos:
            piece = page[pos : at if at >= 0 else size]
            if not hidden:
                run.append(piece)
                linked += len(piece) if links > 0 else 0
            pos = at if at >= 0 else size
            continue
        m = _TOKEN.match(page, pos)
        if not m or m.end() == pos:
            if not hidden:
                run.append("&lt;")
            pos += 1
            continue
        pos = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), m[1]
        if foreign and tag in _OWN:
            tag = "~" + tag
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            continue
        if tag in VOID:
            if tag == "br" and not hidden:
                run.append(" ")
            elif tag == "hr":
                if not hidden:
                    flush()
            continue
        if m[0].endswith("/>") and (foreign or tag in FOREIGN):
            continue
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in bounds:
                    break
                if stack[k][0] in ends:
                    pop_to(k)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in P_STAYS_IN:
                    break
                if stack[k][0] == "p":
                    pop_to(k)
                    break
        attrs = {a[0].lower(): a[1] or a[2] or a[3] or "" for a in _ATTR.findall(m[3])} if m[3] and m[3] != "/" else {}
        hides = int(tag in HIDDEN or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(attrs.get("style", ""))))
        hidden += hides
        stack.append((tag, stack[-1][1], not hidden, hides))
        if tag == "a":
            links += 1
        elif tag in FOREIGN:
            foreign += 1
        elif tag == "~text" and not hidden:
            run.append(" ")
        if tag not in INLINE and not hidden:
            top = stack.pop()
            flush()
            words = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".lower()
            cues = {_CUE_OF[w] for w in [*words.split(), *_CUT.split(words)] if w in _CUE_OF} if words.strip() else set()
            truth = {"1": True, "0": False}.get(attrs.get("data-truth"), top[1].truth)
            node = Node(tag, top[1], tuple(sorted(cues)), truth=truth)
            nodes.append(node)
            stack.append((tag, node, True, 0))
        if tag in RAW and not m[0].endswith("/>"):
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, pos)
            if not end and tag not in ("script", "style", "textarea"):
                continue
            body_end = end.start() if end else size
            if tag not in HIDDEN and not hidden:
                run.append(page[pos:body_end])
            pos = body_end
    flush()
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.sentences += node.sentences
            node.parent.holds |= node.holds
    for node in nodes:
        node.share = node.chars / max(1, root.chars)
        node.beside = root.holds and not node.inside and not node.holds
        node.under = node.parent.under if node.parent is not None else node.under
        if not node.holds and node.tag not in _WHOLE:
            node.under |= {c for c in node.cues if c in _UNDER and "main" not in node.cues} | ({_UNDER_TAG[node.tag]} if node.tag in _UNDER_TAG else set())
    return nodes


def _kind(node: Node) -> int:
    return 0 if node.text is not None else 2 if node.tag in _REGION else 1


def _features(node: Node) -> dict[int, float]:
    """Index to value of the features that are not zero."""
    out = {_AT["bias"]: 1.0}
    if node.text is not None:
        t = node.text
        out[_AT["leaf"]] = 1.0
        out[_AT["leaf:log chars"]] = math.log1p(len(t)) / 5
        out[_AT["leaf:links"]] = node.linked / len(t)
        if len(t) < 25:
            out[_AT["leaf:short"]] = 1.0
        if t[-1] in _ENDS:
            out[_AT["leaf:ends"]] = 1.0
        if len(t) < 400 and _MARKS.search(t):  # a mark of short texts: in long ones such words say nothing
            out[_AT["leaf:mark"]] = 1.0
        out[_AT["leaf:share"]] = node.share
        if node.sentences and 2 * node.linked > len(t):
            out[_AT["linked sentence"]] = 1.0
    else:
        out[_AT.get(f"tag:{node.tag}", _AT["tag:other"])] = 1.0
        for cue in node.cues:
            out[_AT[f"cue:{cue}"]] = 1.0
        out[_AT["box:log chars"]] = math.log1p(node.chars) / 5
        out[_AT["box:links"]] = node.linked / max(1, node.chars)
        out[_AT["box:share"]] = node.share
        out[_AT["box:sentences"]] = math.log1p(node.sentences) / 2
        if node.inside and node.tag in ("header", "footer", "aside"):
            out[_AT[f"in article:{node.tag}"]] = 1.0
        if node.inside and node.tag in ("ul", "ol", "li"):
            out[_AT["in article:list"]] = 1.0
    if node.inside:
        out[_AT["in article"]] = 1.0
        out[_AT["in article:links"]] = node.linked / max(1, node.chars)
    if node.beside:
        out[_AT["beside article"]] = 1.0
    for kind in node.under:
        out[_AT[f"under:{kind}"]] = 1.0
    return out


def _sweep(own: np.ndarray, tie: np.ndarray, levels: list[np.ndarray], parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds belief of each node, upward message of each node) of many trees at once, level by level."""
    message = lambda z, t: 2 * np.arctanh(np.clip(t * np.tanh(np.clip(z, -60, 60) / 2), -1 + 1e-12, 1 - 1e-12))
    belief, up = own.copy(), np.zeros_like(own)
    for level in reversed(levels[1:]):
        up[level] = message(belief[level], tie[level])
        np.add.at(belief, parent[level], up[level])
    for level in levels[1:]:
        belief[level] += message(belief[parent[level]] - up[level], tie[level])
    return belief, up


def fit(pages: list[str], steps: int = 250, ridge: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(unary weights, one coupling for each kind of child), by the exact likelihood of the labelled trees.

    In ``pages`` the attribute data-truth ("1" or "0") of an element labels it and what it holds. The gradient
    is observed less expected features, the latter from the marginals of nodes and of edges.
    """
    nodes, parent, depth = [], [], []
    for page in pages:
        tree = [n for n in parse(page) if n.truth is not None]
        at = {}
        for n in tree:
            at[id(n)] = len(nodes)
            up = at.get(id(n.parent), -1)
            nodes.append(n)
            parent.append(up)
            depth.append(0 if up < 0 else depth[up] + 1)
    parent, depth = np.array(parent), np.array(depth)
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
    kind = np.array([_kind(n) for n in nodes])
    x = np.zeros((len(nodes), len(FEATURES)))
    for i, n in enumerate(nodes):
        for k, v in _features(n).items():
            x[i, k] = v
    s = np.array([1.0 if n.truth else -1.0 for n in nodes])
    edge = np.flatnonzero(parent >= 0)
    member = (kind[edge][:, None] == np.arange(len(KINDS))[None, :]).astype(float)
    seen = x.T @ s, member.T @ (s[edge] * s[parent[edge]])
    beta, first, second = np.zeros(len(FEATURES) + len(KINDS)), 0.0, 0.0
    for step in range(1, steps + 1):
        unary, coupling = beta[: len(FEATURES)], beta[len(FEATURES) :]
        belief, up = _sweep(x @ unary, np.tanh(coupling[kind] / 2), levels, parent)
        around = belief[parent[edge]] - up[edge]  # what the parent knows without this child
        below = 2 * np.arctanh(np.clip(np.tanh(up[edge] / 2) / np.where(np.abs(t := np.tanh(coupling[kind[edge]] / 2)) < 1e-9, 1e-9, t), -1 + 1e-12, 1 - 1e-12))
        j = coupling[kind[edge]]
        same = np.logaddexp((around + below + j) / 2, (-around - below + j) / 2)
        differ = np.logaddexp((around - below - j) / 2, (below - around - j) / 2)
        grad = np.concatenate([seen[0] - x.T @ np.tanh(belief / 2), seen[1] - member.T @ np.tanh((same - differ) / 2)]) / 2 - ridge * beta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        beta = beta + 0.15 * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return beta[: len(FEATURES)], beta[len(FEATURES) :]


def marginals(nodes: list[Node], unary: np.ndarray, coupling: np.ndarray) -> list[float]:
    """P(content) of each node: log-odds messages, leaves to root and back. ``nodes`` has parents first."""
    at = {id(n): i for i, n in enumerate(nodes)}
    parent = [at[id(n.parent)] if n.parent is not None else -1 for n in nodes]
    own = [sum(unary[k] * v for k, v in _features(n).items()) for n in nodes]
    tie = [math.tanh(coupling[_kind(n)] / 2) for n in nodes]
    message = lambda z, t: 2 * math.atanh(min(max(t * math.tanh(max(min(z, 60), -60) / 2), -1 + 1e-12), 1 - 1e-12))
    up, belief = [0.0] * len(nodes), list(own)
    for i in range(len(nodes) - 1, 0, -1):  # upward: what the subtree says about the parent
        up[i] = message(belief[i], tie[i])
        belief[parent[i]] += up[i]
    for i in range(1, len(nodes)):  # downward: what all the rest says about the child
        belief[i] += message(belief[parent[i]] - up[i], tie[i])
    return [1 / (1 + math.exp(-max(min(z, 500), -500))) for z in belief]


def extract(page: str, model: tuple[np.ndarray, np.ndarray]) -> str:
    nodes = parse(page or "")
    return "\n".join(n.text for n, p in zip(nodes, marginals(nodes, *model), strict=True) if n.text is not None and p >= 0.5)


def labelled_pages(count: int = 400, seed: int = 23) -> list[str]:
    """Made-up pages of many layouts with truth marked by data-truth; the model is trained on them."""
    rng = random.Random(seed)
    parts = ["ka", "lo", "mi", "ter", "en", "sol", "va", "qui", "dro", "ste", "un", "be", "chi", "ña", "ö", "ra", "pel", "tion"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    said = lambda n: " ".join(words(3, 18).capitalize() + rng.choice([".", ".", ".", "?", "!", "%", ""]) for _ in range(n))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    named = True  # whether classes and ids of this page say what they mark
    plain = lambda: rng.choice(["", "", f' class="{word()}"', f' id="{word()}"'])
    cls = lambda kind: plain() if not named else (lambda w: rng.choice([f' class="{w}"', f' id="{w}"', f' class="x-{word()} {w}"', f' class="{w}-{word()}"']))(rng.choice(CUES[kind]))

    def para() -> str:
        text = said(rng.choice([1, 1, 2, 4, 8, 30])) if rng.random() < 0.9 else " ".join([word()] * rng.choice([1, 12, 150]))
        r = rng.random()
        if r < 0.15:
            text = f"<b>{text}<br>"
        elif r < 0.25:
            text = text.replace(" ", f" {link()} ", 1)
        elif r < 0.32:  # linked sentences, alone or side by side
            text = " ".join(f'<a href="/{word()}">{said(1)}</a>' for _ in range(rng.choice([1, 1, 2, 3])))
        return f"<p>{text}" + ("</p>" if rng.random() < 0.85 else "")

    def unseen() -> str:
        return rng.choice([f"<p hidden>{said(1)}</p>", f'<div style="display:none"><p>{said(2)}</p></div>', f'<p aria-hidden="true">{words(1, 4)}</p>'])

    def nested(text: str) -> str:
        """Text in divs in place of paragraphs, some of them in further ones."""
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            text = f"<div{plain() if rng.random() < 0.3 else ''}>{text}</div>"
        return text

    def reading() -> str:
        """A list of an article whose items are links, with what leads to it."""
        tag = rng.choice(["ul", "ul", "ol"])
        item = lambda: rng.choice([link(), link(), f'<a href="/{word()}">{said(1)}</a>', f"{words(1, 4)}: {link()}"])
        lead = rng.choice(["", f"<p>{words(1, 4).capitalize()}</p>", f"<h2>{words(1, 3).capitalize()}</h2>", f"<p>{said(1)}</p>"])
        return f"{lead}<{tag}>{''.join(f'<li>{item()}</li>' for _ in range(rng.randint(2, 7)))}</{tag}>"

    def simple(closed: bool) -> str:
        """Few, often short paragraphs, or divs without class."""
        title = rng.choice(["", f"<h1>{words(1, 8).capitalize()}</h1>", f"<h2>{words(1, 8).capitalize()}</h2>", f"<header><h1>{words(2, 8).capitalize()}</h1></header>"])
        parts, divs = [], rng.random() < 0.45
        for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 6])):
            text = said(rng.choice([1, 1, 2, 3, 6])) if rng.random() < 0.85 else words(3, 12)
            if rng.random() < 0.08:
                text = f'<a href="/{word()}">{said(1)}</a>'
            parts.append(nested(text) if divs else f"<p>{text}</p>")
        if rng.random() < 0.3:
            parts.insert(rng.randint(0, len(parts)), unseen())
        if closed and rng.random() < 0.2:
            parts.append(reading())
        return title + "".join(parts) + (ending() if closed else "")

    def ending() -> str:
        """What stands at the end of an article and is not of it: its footer, readers' comments."""
        out = junk("foot in") if rng.random() < 0.25 else ""
        return out + (junk("comment") if named and rng.random() < 0.3 else "")

    def body(closed: bool) -> str:
        """A story; ``closed``: an element of its own tells where it begins and ends."""
        if rng.random() < 0.4:
            return simple(closed)
        out = [f"<h1>{words(1, 12).capitalize()}</h1>"] if rng.random() < 0.8 else []
        short = rng.random() < 0.15  # many short paragraphs
        for _ in range(rng.choice([12, 50]) if short else rng.choice([1, 1, 2, 4, 8, 16, 30])):
            r = rng.random()
            if short:
                out.append(f"<p>{words(1, 3).capitalize()}.</p>")
                continue
            if r < 0.78:
                out.append(para())
            elif r < 0.84:
                out.append(f"<h{rng.randint(2, 4)}>{words(1, 6)}</h2>".replace("</h2>", f"</h{2}>"))
            elif r < 0.9:
                out.append(f"<{'ul' if rng.random() < 0.6 else 'ol'}>" + "".join(f"<li>{said(1)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif r < 0.93:
                out.append(f"<blockquote>{para()}</blockquote>")
            elif r < 0.96:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif r < 0.98:
                out.append(f"<figure><img src=x><figcaption>{said(1)}</figcaption></figure>")
            else:
                out.append(f"<pre>{said(2)}</pre>")
        if closed and rng.random() < 0.2:
            out.insert(rng.randint(0, len(out)), reading())
        for _ in range(rng.choice([0, 0, 0, 1, 2])):  # boilerplate inside the article
            if named or not closed:
                out.insert(rng.randint(0, len(out)), junk(rng.choice(["ad", "side", "share", "notice", "form"])))
        return "".join(out) + (ending() if closed else "")

    def junk(kind: str) -> str:
        t = 'data-truth="0"'
        if kind == "links":  # a box of links without any name
            tag, links = rng.choice(["div", "ul"]), [link() for _ in range(rng.randint(2, 9))]
            rows = "".join(f"<li>{x}</li>" for x in links) if tag == "ul" or rng.random() < 0.4 else rng.choice([" ", " | ", "<br>"]).join(links)
            lead = f"<h3>{words(1, 3)}</h3>" if tag == "div" and rng.random() < 0.4 else ""
            return f"<{tag}{plain()} {t}>{lead}{rows}</{tag}>"
        if kind == "nav":
            tag = rng.choice(["nav", "nav", "div", "ul"])
            c = cls("nav") if tag != "nav" or rng.random() < 0.3 else ""
            rows = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9)))
            return f"<{tag}{c} {t}>{rows if tag == 'ul' else f'<ul>{rows}</ul>'}</{tag}>"
        if kind == "head":
            return rng.choice([f"<header {t}>", f"<div{cls('head')} {t}>", f"<header{cls('head')} {t}>"]) + rng.choice([words(1, 6), link(), f"<p>{said(1)}</p>", f"<h2>{words(1, 4)}</h2>"]) + "</header></div>"
        if kind == "foot":
            tag = rng.choice(["footer", "footer", "div"])
            c = cls("foot") if tag == "div" else ""
            return f"<{tag}{c} {t}>" + rng.choice(["&copy; ", f"&copy; {rng.randint(1990, 2030)} ", "Copyright ", ""]) + rng.choice([f"{word()} {word()}. All rights reserved.", f"{word()}.example &middot; {said(rng.randint(1, 3))}", f"<p>{said(1)}</p>{link()}", f"{link()} | {link()}"]) + f"</{tag}>"
        if kind == "foot in":
            return f"<footer {t}>" + rng.choice([said(1), f"{words(2, 4).capitalize()}. {words(1, 3).capitalize()}.", f"<p>{said(1)}</p>", link(), f"{words(1, 2)} {link()} | {link()}", f"<p>{words(2, 5)}</p><ul><li>{link()}</li></ul>"]) + "</footer>"
        if kind == "form":
            return f'<form action="/x" {t}><label>{words(1, 3)}</label><input name=q><button>{word()}</button><p>{said(1)}</p><select><option>{word()}</select></form>'
        if kind == "comment":
            if rng.random() < 0.4:  # one kind of element for all, closed
                own = rng.choice(["p", "p", "div", "article"])
                if rng.random() < 0.4:
                    own, tag = "li", rng.choice(["ul", "ol"])
                else:
                    tag = rng.choice(["div", "section"])
                lead = rng.choice(["", f"<h3>{words(1, 2)}</h3>"]) if tag not in ("ul", "ol") else ""
                return f"<{tag}{cls('comment')} {t}>{lead}" + "".join(f"<{own}>{said(rng.randint(1, 3))}</{own}>" for _ in range(rng.randint(1, 4))) + f"</{tag}>"
            inner = "".join(f"<{rng.choice(['li', 'div', 'p', 'article'])}>{said(rng.randint(1, 4))}" for _ in range(rng.randint(1, 5)))
            return f"<{rng.choice(['section', 'div', 'div'])}{cls('comment')} {t}><h3>{words(1, 2)}</h3>{inner}</article></li></div></section>"
        tag = rng.choice({"ad": ["div", "div", "aside", "p", "section"], "side": ["aside", "aside", "div"], "share": ["div", "ul"], "notice": ["div", "section", "p", "dialog"]}[kind])
        c = "" if tag == "aside" and rng.random() < 0.6 else cls(kind)
        inner = rng.choice([said(rng.randint(1, 3)), f"<p>{said(rng.randint(1, 3))}</p>", f"<h3>{words(1, 3)}</h3><ul><li>{link()}</li><li>{link()}</li></ul>", f"<p>{words(2, 5)}</p>{link()}"])
        return f"<{tag}{c} {t}>{inner if tag != 'p' else said(1)}</{tag}>"

    pages = []
    for _ in range(count):
        named = rng.random() < 0.6
        wrap = rng.choice(["article", "article", "article", "main", "div", "section", "mainarticle", "plain", "body", "cell"])
        inner = body(wrap in ("article", "main", "mainarticle"))
        story = {
            "mainarticle": f'<main data-truth="1"><article data-truth="1">{inner}</article></main>',
            "div": f'<div{cls("main")} data-truth="1">{inner}</div>',
            "section": f'<section{cls("main")} data-truth="1">{inner}</section>',
            "plain": f'<div data-truth="1">{inner}</div>',
            "body": inner,
            "cell": f'<table><tr><td data-truth="0">{rng.choice(["<br>", " ", " | "]).join(link() for _ in range(rng.randint(2, 7)))}</td><td>{inner}</td></tr></table>',
        }.get(wrap, f'<{wrap} data-truth="1">{inner}</{wrap}>')
        first = ["nav", "head", "ad", "notice", "side", "links"] if named else ["nav", "head", "links", "links"]
        last = ["foot", "comment", "side", "ad", "nav", "share", "form", "notice", "links"] if named else ["foot", "foot", "form", "nav", "links", "links"]
        bare = rng.random() < 0.2  # nothing but the story
        before = [] if bare else [junk(k) for k in rng.sample(first, rng.randint(0, 4))]
        after = [] if bare else [junk(k) for k in rng.sample(last, rng.randint(0, 5))]
        end = "</body></html>" if rng.random() < 0.85 else ""
        whole = 'data-truth="1"'
        if rng.random() < 0.04:
            story, whole = "", 'data-truth="0"'
        if rng.random() < 0.1:
            before.insert(0, unseen())
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><script>var a='</p>';</script></head><body {whole}>{''.join(before)}{story}{''.join(after)}{end}")
    return pages


@functools.cache
def default_model() -> tuple[np.ndarray, np.ndarray]:
    return fit(labelled_pages())


def extract_pages(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points).

    ``pages`` has page_id, url, html; other columns are ignored. Null and empty html, and pages without main
    text, give an empty text. Null and repeated ids keep a row each; an empty table gives no rows. Each page is
    read whole; a page is handled by itself, so no key can be hot.
    """
    weights = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, weights) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    source = pages.select("page_id", "url", "html")
    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op10_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
