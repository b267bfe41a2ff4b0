"""Main text of web pages by a tree-structured graphical model.

The nodes of the model are the elements of a page's tree; each is content or not. A node's potential is a
weighted sum of its features (its tag, words in its class and id, how much text and link text it holds, of its
own and of the page's), a parent-child potential weighs each pair of labels by the child's tag group. Sum-product messages, first from
the leaves up, then from the root down, give every node's marginal. Weights are trained by gradient ascent on
the likelihood of labelled pages (training_pages()), whose content is marked in the source.

Blocks of text whose node is likelier content than not are the main text, in page order.
"""

from __future__ import annotations

import functools
import re
from html.parser import HTMLParser
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import added, text_chunks, without

#: Fixed values of the HTML standard: elements without an end tag; without text for readers; block elements;
#: start tags that end an open paragraph; end tags that may be left out, closed by a sibling.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object audio video canvas map select option datalist textarea button".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table caption tbody thead tfoot tr td th ul".split())
ENDS_P = BLOCK - frozenset("html body caption tbody thead tfoot tr td th legend summary li dd dt".split())
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "thead tbody tr td th", "tfoot": "tbody thead tr td th"}
SCOPE = frozenset("table ul ol dl html body td th article section div nav aside".split())

FOREIGN = frozenset("svg math".split())

#: Words in class, id and role names that speak for or against content.
AGAINST = "ad ads advert advertisement banner breadcrumb comment comments cookie consent copyright discussion footer form header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo related reply respond share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget alert".split()
#: Parts of such words that speak against content, too: topmenu, pagefooter.
AGAINST_PARTS = re.compile("menu|footer|sidebar|banner|advert|cookie|newsletter|popup|navbar|navigation")
#: Those beside which a word for content means the content of such a part: comment-body, ad-content.
STRONG = "ad ads advert advertisement comment comments cookie consent discussion newsletter promo reply respond sponsored".split()
FOR = "article articlebody body content entry main post story text prose".split()
GROUPS = {"nav": "nav menu", "aside": "aside dialog", "foot": "footer address", "head": "header hgroup", "form": "form fieldset legend", "article": "article main", "heading": "h1 h2 h3 h4 h5 h6", "p": "p blockquote pre figcaption dd dt", "list": "ul ol dl dir", "item": "li", "table": "table tbody thead tfoot tr td th caption", "box": "div section center details summary figure search", "root": "html body"}
GROUP_OF = {t: g for g, tags in GROUPS.items() for t in tags.split()}
GROUP_NAMES = [*GROUPS, "inline", "silent"]
FEATURES = [*(f"tag {g}" for g in GROUP_NAMES), "class against", "class both", "class for", "link share high", "link share some", "text none", "text short", "text long", "own text", "own text long", "page half", "page most", "against most", "in against", "bias"]
#: Elements whose class speaks of the whole page or of all of its content, not of a part.
WHOLE = frozenset("html body main article".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"[\s]+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "text", "links", "content")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: int):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.text = self.links = 0
        self.content = False


class Tree(HTMLParser):
    """Elements in page order, each after its parent, and runs of text by element."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", {}, -1)]
        self.open = [0]
        self.runs: list[tuple[int, str]] = []  # (element, text); a br is white space
        self.marked = self.ending = False
        self.feed(source)
        self.ending = True
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html" or (tag == "body" and any(self.nodes[i].tag == "body" for i in self.open)):
            return
        if tag == "br":
            self.runs.append((self.open[-1], "\n"))
        if tag in VOID:
            return
        if tag in ENDS_P:
            self._close({"p"}, SCOPE)
        if tag in SIBLINGS:
            self._close(set(SIBLINGS[tag].split()), SCOPE - {"td", "th"})
        node = Node(tag, dict(attrs), self.open[-1])
        node.content = self.marked
        self.nodes.append(node)
        self.open.append(len(self.nodes) - 1)

    def parse_starttag(self, i: int) -> int:
        return self._to_end(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._to_end(super().parse_endtag(i))

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self._to_end(super().parse_comment(i, report))

    def parse_html_declaration(self, i: int) -> int:
        return self._to_end(super().parse_html_declaration(i))

    def parse_pi(self, i: int) -> int:
        return self._to_end(super().parse_pi(i))

    def _to_end(self, at: int) -> int:
        """A tag, comment or declaration that the page's end cuts off goes on to the end: it is markup, not text."""
        return len(self.rawdata) if at < 0 and self.ending else at

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in FOREIGN:  # of these alone a slash ends the element
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag not in ("html", "body"):
            self._close({tag}, frozenset() if tag in BLOCK else BLOCK)

    def _close(self, tags: set[str], until: frozenset[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            own = self.nodes[self.open[depth]].tag
            if own in tags:
                del self.open[depth:]
                return
            if own in until or own == "body":
                return

    def handle_data(self, data: str) -> None:
        if data:
            self.runs.append((self.open[-1], data))
            if self.marked and not data.isspace():
                self.nodes[self.open[-1]].content = True

    def handle_comment(self, data: str) -> None:
        if data in ("content", "/content"):  # marks of labelled pages
            self.marked = data == "content"


def block_of(nodes: list[Node]) -> tuple[list[int], list[bool]]:
    """For each node, the nearest block element at or above it, and whether it is silent."""
    block, silent = [0] * len(nodes), [False] * len(nodes)
    for i, n in enumerate(nodes):
        up = max(n.parent, 0)
        block[i] = i if n.tag in BLOCK else block[up]
        silent[i] = n.tag in SILENT or (i > 0 and silent[up])
    return block, silent


def features(tree: Tree) -> np.ndarray:
    nodes = tree.nodes
    _, silent = block_of(nodes)
    link = [False] * len(nodes)
    for i, n in enumerate(nodes):
        link[i] = n.tag == "a" or (n.parent >= 0 and link[n.parent])
    own = [0] * len(nodes)
    for i, data in tree.runs:
        if not silent[i]:
            size = len(data) - data.count(" ") - data.count("\n")
            nodes[i].text += size
            nodes[i].links += size * link[i]
            own[i] += size
    for n in reversed(nodes[1:]):
        nodes[n.parent].text += n.text
        nodes[n.parent].links += n.links
    page = max(1, nodes[0].text - nodes[0].links)
    against, out = [False] * len(nodes), np.zeros((len(nodes), len(FEATURES)))
    at = {f: i for i, f in enumerate(FEATURES)}
    for i, n in enumerate(nodes):
        most = (n.text - n.links) / page
        group = "silent" if silent[i] else GROUP_OF.get(n.tag, "inline")
        whole = n.tag in WHOLE
        if group == "form" and most > 0.5:  # a form around the page
            group, whole = "box", True
        names = {w.lower() for k in ("class", "id", "role", "aria-label", "itemprop") for w in _NAME.findall(n.attrs.get(k) or "")} if n.attrs and not whole else set()
        strong = not names.isdisjoint(STRONG)
        speaks, favours = not names.isdisjoint(AGAINST) or any(map(AGAINST_PARTS.search, names)), not strong and not names.isdisjoint(FOR)
        bad = group in ("nav", "aside", "foot", "form", "head") or (speaks and not favours)
        share = n.links / n.text if n.text else 0.0
        against[i] = bad or (i > 0 and against[n.parent])
        row = out[i]
        row[at[f"tag {group}"]] = 1
        row[at["class against"]] = speaks and not favours
        row[at["class both"]] = speaks and favours
        row[at["class for"]] = favours and not speaks
        row[at["link share high"]] = share > 0.6
        row[at["link share some"]] = 0.25 < share <= 0.6
        row[at["text none"]] = n.text == 0
        row[at["text short"]] = 0 < n.text < 40
        row[at["text long"]] = n.text >= 200
        row[at["own text"]] = own[i] > 0
        row[at["own text long"]] = own[i] >= 100
        row[at["page half"]] = most > 0.4
        row[at["page most"]] = most > 0.8
        row[at["against most"]] = speaks and most > 0.6
        row[at["in against"]] = i > 0 and against[n.parent]
        row[at["bias"]] = 1
    return out


class Model:
    """Weights of node features (for the label content) and of label pairs by the child's tag group."""

    def __init__(self, node: np.ndarray, pair: np.ndarray):
        self.node, self.pair = node, pair  # pair: group, parent's label, child's label

    def marginals(self, tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """P(content) of each node, P(parent's label, child's label) of each node below the root, each node's group."""
        nodes, n = tree.nodes, len(tree.nodes)
        group = [int(r) for r in x[:, : len(GROUP_NAMES)].argmax(axis=1)]
        pair = np.exp(self.pair).tolist()
        odds = np.clip(x @ self.node, -30, 30)
        on = (1 / (1 + np.exp(-odds))).tolist()
        up = [[1 - p, p] for p in on]  # own potential times the children's messages
        sent = [[1.0, 1.0] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            u, w = up[i], pair[group[i]]
            a, b = w[0][0] * u[0] + w[0][1] * u[1], w[1][0] * u[0] + w[1][1] * u[1]
            s = a + b
            sent[i] = [a / s, b / s]
            p = up[nodes[i].parent]
            p[0] *= a / s
            p[1] *= b / s
            s = p[0] + p[1]
            p[0] /= s
            p[1] /= s
        down = [[1.0, 1.0] for _ in range(n)]
        out, pairs = np.zeros(n), np.zeros((n, 2, 2))
        for i in range(n):
            u, d = up[i], down[i]
            if i:
                w, parent = pair[group[i]], nodes[i].parent
                pu, pd, m = up[parent], down[parent], sent[i]
                rest = [pu[0] * pd[0] / max(m[0], 1e-300), pu[1] * pd[1] / max(m[1], 1e-300)]
                both = [[rest[a] * w[a][b] * u[b] for b in (0, 1)] for a in (0, 1)]
                s = sum(map(sum, both))
                pairs[i] = np.array(both) / s
                d[0], d[1] = (rest[0] * w[0][0] + rest[1] * w[1][0]), (rest[0] * w[0][1] + rest[1] * w[1][1])
                s = d[0] + d[1]
                d[0] /= s
                d[1] /= s
            out[i] = u[1] * d[1] / (u[0] * d[0] + u[1] * d[1])
        return out, pairs, group


def train(pages: list[str], *, steps: int = 60, rate: float = 1.0, decay: float = 1e-3) -> Model:
    """Weights of highest likelihood on pages whose content stands between <!--content--> and <!--/content-->."""
    model = Model(np.zeros(len(FEATURES)), np.zeros((len(GROUP_NAMES), 2, 2)))
    data = []
    for source in pages:
        tree = Tree(source)
        x = features(tree)
        data.append((tree, x, np.array([n.content for n in tree.nodes], int)))
    total = sum(len(y) for _, _, y in data)
    speed_n, speed_p = np.full_like(model.node, 1e-8), np.full_like(model.pair, 1e-8)
    for _ in range(steps):
        g_node, g_pair = -decay * total * model.node, -decay * total * model.pair
        for tree, x, y in data:
            p, pairs, group = model.marginals(tree, x)
            g_node += x.T @ (y - p)
            for i in range(1, len(y)):
                g_pair[group[i]] -= pairs[i]
                g_pair[group[i], y[tree.nodes[i].parent], y[i]] += 1
        speed_n += g_node**2
        speed_p += g_pair**2
        model.node = model.node + rate * g_node / np.sqrt(speed_n)
        model.pair = model.pair + rate * g_pair / np.sqrt(speed_p)
    return model


def extract(source: str, model: Model) -> list[str]:
    """The main text's blocks: white space in a block is one space, blocks without text are left out."""
    if not source:
        return []
    tree = Tree(source)
    block, silent = block_of(tree.nodes)
    x = features(tree)
    p, _, _ = model.marginals(tree, x)
    named = x[:, FEATURES.index("class against")] > 0
    cut = [False] * len(p)  # inside an inline element, like an advert, that its class speaks against
    for i, n in enumerate(tree.nodes):
        cut[i] = n.tag not in BLOCK and ((named[i] and p[i] <= 0.5) or cut[max(n.parent, 0)])
    blocks: list[tuple[int, list[str]]] = []
    for i, data in tree.runs:
        b = block[i]
        if silent[i] or cut[i] or p[b] <= 0.5:
            continue
        if not blocks or blocks[-1][0] != b:
            blocks.append((b, []))
        blocks[-1][1].append(data)
    texts = (_SPACE.sub(" ", "".join(parts)).strip() for _, parts in blocks)
    return [t for t in texts if t]


@functools.cache
def training_pages() -> tuple[str, ...]:
    """Labelled pages of many layouts: every mix of a frame, a wrapper for the content and kinds of boilerplate."""
    words = "the plan of work for small towns was read aloud and many in the room asked how it would be paid for in later years".split()

    def sentence(k: int, n: int) -> str:
        return " ".join(words[(k * 7 + i * 3) % len(words)] for i in range(n)).capitalize() + "."

    def links(k: int, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{words[(k + i) % len(words)]} {words[(k + 2 * i) % len(words)]}</a></li>' for i in range(n))

    tops = ["<nav><ul>{links}</ul></nav>", "<ul>{links}</ul>", '<div class="top"><ul>{links}</ul></div>', '<header class="site-header"><a href="/">Home</a><p>{short}</p></header>', '<div id="menu"><ul>{links}</ul></div>', '<div class="navbar"><a href="/a">News</a> <a href="/b">Sport</a></div>', '<div class="cookie-notice"><p>{any}</p><button>OK</button></div>', '<div class="ad">{any}</div>', '<div class="advert"><p>{any}</p></div>', '<header><h1><a href="/">{short}</a></h1><nav>{short}</nav></header>', '<div class="breadcrumb"><a href="/">Home</a> &gt; <a href="/x">Here</a></div>', '<form action="/s"><label>Search</label><input name="q"><p>{short}</p></form>']
    tails = ["<footer>&copy; 2020 &middot; {any}</footer>", "<aside><h3>{short}</h3><p>{any}</p><ul>{links}</ul></aside>", '<div class="sidebar"><h2>{short}</h2><p>{any}</p></div>', '<section id="comments"><h2>Comments</h2><div class="comment"><p>{long}</p></div><div class="comment"><p>{any}</p></div></section>', '<div class="related"><h3>More</h3><ul>{links}</ul></div>', '<div class="footer"><p>{any}</p></div>', '<form class="signup"><p>{any}</p><input type="email"></form>', '<div class="share"><a href="/f">Share</a> <a href="/t">Post</a></div>', '<div class="promo-box"><p>{any}</p></div>', '<ol class="comment-list"><li><p>{long}</p></li><li><p>{any}</p></li></ol>', '<div class="comments"><h3>{short}</h3><div class="comment"><p>{long}</p></div><div class="comment"><p>{long}</p></div><div class="comment"><p>{long}</p></div></div>']
    wraps = ["<!--content--><article>{body}</article><!--/content-->", '<!--content--><main><div class="post-content">{body}</div></main><!--/content-->', '<!--content--><div class="content">{body}</div><!--/content-->', '<div class="wrapper"><!--content--><div id="story">{body}</div><!--/content--></div>', "<!--content-->{body}<!--/content-->", "<div><div><!--content--><article><section>{body}</section></article><!--/content--></div></div>", '<form id="pageForm" action="/"><input type="hidden" name="s"><div id="main"><!--content-->{body}<!--/content--></div></form>', '<section class="widget-content"><!--content-->{body}<!--/content--></section>', '<!--content--><section class="content-widget">{body}</section><!--/content-->', '<div id="page-header-wrap"><div class="col"><!--content-->{body}<!--/content--></div></div>', '<table><tr><td><!--content-->{body}<!--/content--></td></tr></table>', '<main><!--content--><article class="entry">{body}</article><!--/content--></main>']
    inner = ["", "<!--/content--><aside><p>{mid}</p></aside><!--content-->", '<!--/content--><div class="ad-slot"><p>{short}</p></div><!--content-->', '<!--/content--><div class="newsletter-signup"><form><p>{mid}</p></form></div><!--content-->', '<!--/content--><nav><a href="#a">Part</a></nav><!--content-->', '<!--/content--><div class="comment-body"><p>{mid}</p></div><!--content-->', '<!--/content--><div class="ad-content"><p>{mid}</p></div><!--content-->']
    bodies = ["<h1>{short}</h1><p>{long}</p><p>{mid} <a href='/r'>{short}</a> {mid}</p>{in}<p>{long}</p>", "<h1>{short}</h1><p><b>{short}<br><p>{long}</p>{in}<h2>{short}</h2><ul><li>{mid}</li><li>{short}</li></ul><p>{mid}</p>", "<header><h1>{short}</h1></header><p>{long}</p>{in}<blockquote><p>{mid}</p></blockquote><table><tr><td>{short}</td><td>{short}</td></tr></table>", "<p>{short}</p>{in}<p>{long}</p><pre>{mid}</pre><ol><li>{mid}</li></ol>", "<h1>{short}</h1><div>{long}</div>{in}<div>{mid}</div>", "<h1>{short}</h1><p>{short}</p>", "<h2>{short}</h2>{long}<br><br>{mid}{in}", "<h1>{short}</h1><p>{long}</p>{in}<p>{mid}</p><p><a href='/r'>{mid}</a></p>", "<h1>{short}</h1><p>{mid}</p>{in}<ul><li><a href='/r'>{mid}</a></li><li><a href='/s'>{short}</a></li></ul><p>{mid}</p>", "<p><a href='/q'>{short}</a></p><p>{long}</p>{in}<p>{mid}</p>", "<h1>{short}</h1><p>{mid}</p>{in}<dl><dt>{short}</dt><dd>{mid}</dd></dl><p>{long} {long} {long}</p>"]
    starts = ["<body>", '<body class="menu-open">', '<body class="has-sidebar header-fixed" id="top">', "<body>"]
    pages = [f"<!--content-->{sentence(k, 12 + 9 * k)}<!--/content-->" for k in range(16)]  # no tags at all
    pages += [f"<!--content--><p>{sentence(k, 20)}<p>{sentence(k + 1, 9 * k + 5)}<!--/content-->" for k in range(3)]
    # short pages, and lists of links that belong to the text
    pages += [f"<html><body>{tops[k % 4].replace('{links}', links(k, 3)).replace('{short}', sentence(k, 2))}<!--content--><{tag}>{sentence(k, 3)}</{tag}><!--/content-->{end}</body></html>" for k, (tag, end) in enumerate(product(("div", "p"), ("", "<footer>c</footer>", "<script>x()</script>")))]
    pages += [f"<html><body>{tops[k % 4].replace('{links}', links(k, 5)).replace('{short}', sentence(k, 3))}<!--content--><{tag}><h1>{sentence(k, 3)}</h1><p>{sentence(k + 1, 18)}</p><ul>{links(k, 2 + k % 3)}</ul><p>{sentence(k + 2, 15)}</p></{tag}><!--/content--><footer>{sentence(k, 4)}</footer></body></html>" for k, tag in enumerate(("main", "article") * 4)]
    for k in range(216):
        top, tail, wrap, body = tops[k % len(tops)], tails[(k * 3 + k // 10) % len(tails)], wraps[k % len(wraps)], bodies[(k + k // 6) % len(bodies)]
        parts = (tops[(k * 7 + 3) % len(tops)] if k % 3 else "", top, wrap.replace("{body}", body.replace("{in}", inner[(k // 2) % len(inner)])), tail, tails[(k * 5 + 1) % len(tails)] if k % 2 else "")
        page = "<html><head><title>{short}</title><style>p{}</style></head>" + starts[(k // 5) % len(starts)] + "".join(parts) + "<script>var t='<p>x</p>';</script></body></html>"
        for i, (name, n) in enumerate((("{short}", 4), ("{mid}", 14), ("{long}", 60), ("{any}", 3 + k * 11 % 50))):
            while name in page:
                page = page.replace(name, sentence(k + i + len(page), n + (k + len(page)) % (1 + n // 2)), 1)
        pages.append(page.replace("{links}", links(k, 5)))
    return tuple(pages)


@functools.cache
def default_model() -> Model:
    return train(list(training_pages()))


def main_text(pages: DataFrame, model: Model | None = None, *, column: str = "html", keep_html: bool = True) -> DataFrame:
    """pages with text (blocks joined by an empty line; empty if there is none) and n_blocks.

    Null, empty and textless pages have empty texts. Character references are decoded; a tag that the end of
    the page cuts off is markup. Repeated rows each get a row. Columns of pages with the added names are
    replaced.
    """
    pages = without(pages, ["text", "n_blocks"])
    keep = [i for i, c in enumerate(pages.columns) if keep_html or c != column]
    at = pages.columns.index(column)
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        for batch in batches:
            blocks = [extract(t.decode("utf-8", "replace"), shared.value) for _, texts in text_chunks(batch.column(at)) for t in texts]
            new = [pa.array(["\n\n".join(b) for b in blocks], pa.string()), pa.array([len(b) for b in blocks], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *new], names=[*(batch.schema.names[i] for i in keep), "text", "n_blocks"])

    fields = [T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType())]
    return pages.mapInArrow(run, added(T.StructType([pages.schema.fields[i] for i in keep]), fields))
