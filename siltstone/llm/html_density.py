"""Main text of web pages by composite text density.

Every DOM node gets its composite text density: characters per tag, weighed
by a logarithm whose base and argument adjust for characters and tags inside
links. The node with the largest sum of child densities is the content; the
lowest density on its path from the body is the threshold above which other
nodes are content too. Elements that are boilerplate by name or by role are
left out before densities are summed.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Fixed values of HTML: elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: A start tag of these closes an open p.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Start tag -> open elements that it closes, and the elements beyond which it doesn't look.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "optgroup": ("option optgroup", ("select",)), "tbody": ("tr td th thead tbody tfoot", ("table",)), "tfoot": ("tr td th thead tbody", ("table",)), "thead": ("tr td th tbody", ("table",))}
CLOSES = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in CLOSES.items()}
#: Elements that are no part of the main text.
CHROME = frozenset("nav footer aside form script style noscript iframe template button select menu dialog svg math object embed canvas audio video textarea input".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
#: Whole tokens of class and id that name boilerplate.
NAMES = re.compile(r"(?<!\S)(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side-?bar|nav|navbar|navigation|menu|breadcrumbs?|footer|cookies?|consent|gdpr|notice|notification|alert|popup|modal|newsletter|subscribe|subscription|share|sharing|social|comments?|comment-?list|respond|replies|disqus|related|recommend\w*|widget|pagination|pager|toolbar|masthead|skip-?link)(?!\S)", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>", re.S)
#: The same for the rest of a page in which a quotation mark has no partner: a tag ends at the first >.
LOOSE = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
MARK = re.compile(r"<(?=[!?/a-zA-Z])")
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
#: End tags of raw elements; a lower-cased copy of the page may have other offsets.
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}


class Node:
    __slots__ = ("tag", "parent", "kids", "chrome", "hidden", "chars", "tags", "lchars", "ltags", "density", "dsum", "named", "text", "marked")

    def __init__(self, tag, parent, chrome=False, named=False):
        self.tag, self.parent, self.chrome, self.named = tag, parent, chrome, named
        self.kids: list = []


def _attributes(attrs: str) -> list[tuple[str, str]]:
    return [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in ATTR.finditer(attrs)]


def _is_chrome(tag: str, attrs: list[tuple[str, str]], inside_article: bool) -> bool:
    if tag in CHROME:
        return True
    if tag == "header":
        return not inside_article
    if tag in ("body", "html", "article", "main"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _is_named(tag: str, attrs: list[tuple[str, str]]) -> bool:
    return tag not in ("body", "html", "article", "main") and any(name in ("class", "id") and NAMES.search(value) for name, value in attrs)


def _drop_named(root: Node) -> None:
    """Makes elements that are boilerplate by name so, save those that hold an article or main, or most of the page's text (and, on a page with an article elsewhere, the node of the largest density sum)."""
    nodes = _order(root)
    for n in reversed(nodes):
        n.text, n.marked = 0, False
        for k in n.kids:
            if type(k) is not Node:
                n.text += len(k.strip())
            elif not k.chrome:
                n.text, n.marked = n.text + k.text, n.marked or k.marked
        n.marked = n.marked or n.tag in ("article", "main") and n.text > 0
    named = [n for n in nodes if n.named and not n.marked]
    dense = set()
    if root.marked and any(2 * n.text > root.text for n in named):
        best = max(densities(root), key=lambda n: (n.dsum, n.chars))
        while best is not None:
            dense.add(id(best))
            best = best.parent
    for n in named:
        n.chrome = 2 * n.text <= root.text or root.marked and id(n) not in dense


def _tokens(page: str):
    """Matches of markup in page order, told by send() where to go on. Takes time in proportion to the page."""
    at, tokens = 0, TOKEN
    while True:
        start = MARK.search(page, at)
        if not start or page.find(">", start.end()) < 0:
            return
        m = tokens.match(page, start.start())
        if not m and tokens is TOKEN and page[start.end()].isalpha():
            tokens = LOOSE
            m = tokens.match(page, start.start())
        at = start.end() if not m else (yield m)


class _Open:
    """The open elements, and where in them each kind of element stands."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks, self.walls = [root], {}, [], []

    def push(self, node: Node) -> None:
        k = len(self.nodes)
        self.nodes.append(node)
        self.at.setdefault(node.tag, []).append(k)
        if node.tag in BLOCK:
            self.blocks.append(k)
        if node.tag in WALLS:
            self.walls.append(k)

    def cut(self, k: int) -> None:
        """Closes the elements from place k on."""
        while len(self.nodes) > k:
            self.at[self.nodes.pop().tag].pop()
        for places in (self.blocks, self.walls):
            while places and places[-1] >= k:
                places.pop()

    def last(self, tags) -> int:
        """The innermost open element of these tags; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


#: Elements beyond which the end tag of an inline element closes nothing.
WALLS = ("article", "body", "td", "th", "table")


def parse(page: str) -> Node:
    """The tree of a page: nodes hold nodes and strings in page order. Tolerates unclosed and stray tags."""
    root = Node("html", None)
    open_ = _Open(root)
    at, tokens = 0, _tokens(page)
    m = next(tokens, None)
    while m:
        if m.start() > at:
            open_.nodes[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[2] is not None:
            at = _tag(page, open_, m[2].lower(), bool(m[1]), m[3], at)
        try:
            m = tokens.send(at)
        except StopIteration:
            break
    tail = page[at:]
    if tail:
        # A tag that the end of the page cuts off is no text.
        cut = re.search(r"<[a-zA-Z/!][^<>]*$", tail)
        open_.nodes[-1].kids.append(tail[: cut.start()] if cut else tail)
    _drop_named(root)
    return root


def _tag(page: str, open_: _Open, tag: str, ends: bool, attrs: str, at: int) -> int:
    """Takes a tag in; returns where the page goes on."""
    root = open_.nodes[0]
    if ends:
        k = open_.last((tag,))
        if k and tag != "br" and (tag in BLOCK or not open_.walls or open_.walls[-1] <= k):
            open_.cut(k)
        return at
    if tag in ("html", "head"):
        return at
    if tag == "body":
        if not open_.last(("body",)):
            open_.cut(1)
            node = Node("body", root)
            root.kids.append(node)
            open_.push(node)
        return at
    if tag in ENDS_P and open_.blocks and open_.nodes[open_.blocks[-1]].tag == "p":
        open_.cut(open_.blocks[-1])
    if tag in CLOSES:
        which, stop = CLOSES[tag]
        k, wall = open_.last(which), open_.last(stop)
        while k > wall:
            open_.cut(k)
            if tag not in ("tbody", "tfoot", "thead", "tr"):
                break
            k = open_.last(which)
    pairs = _attributes(attrs) if attrs else []
    node = Node(tag, open_.nodes[-1], _is_chrome(tag, pairs, bool(open_.last(("article",)))), _is_named(tag, pairs))
    open_.nodes[-1].kids.append(node)
    if tag in RAW:
        end = RAW_END[tag].search(page, at)
        node.chrome = True
        close = page.find(">", end.start()) if end else -1
        return close + 1 if close >= 0 else len(page)
    if tag not in VOID and not attrs.endswith("/"):
        open_.push(node)
    return at


def _order(root: Node) -> list[Node]:
    """Nodes that are not boilerplate, parents before children."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(k for k in reversed(n.kids) if type(k) is Node and not k.chrome)
    return out


def densities(root: Node) -> list[Node]:
    """Sets chars, tags, lchars, ltags, density and dsum of every node that is not boilerplate."""
    nodes = _order(root)
    for n in reversed(nodes):
        n.chars = n.tags = n.lchars = n.ltags = 0
        for k in n.kids:
            if type(k) is not Node:
                n.chars += len(k.strip())
            elif not k.chrome:
                n.chars, n.tags, n.lchars, n.ltags = n.chars + k.chars, n.tags + k.tags + 1, n.lchars + k.lchars, n.ltags + k.ltags + (k.tag == "a")
        if n.tag == "a":
            n.lchars, n.ltags = n.chars, n.tags
    ratio = root.lchars / max(root.chars, 1)
    for n in reversed(nodes):
        c, t, lc, lt = n.chars, max(n.tags, 1), n.lchars, max(n.ltags, 1)
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        weight = math.log(max(c / max(lc, 1) * (t / lt), 1.0)) / (math.log(base) if base > math.e else 1.0) if c else 0.0
        n.density = c / t * weight
        n.dsum = sum(k.density for k in n.kids if type(k) is Node and not k.chrome)
    return nodes


def _blocks(n: Node, out: list[list[str]], path: frozenset = frozenset(), best: Node | None = None, threshold: float = 0.0) -> None:
    """Appends the pieces of text of n by block. With a path (ids of the nodes above best), what lies beside it must reach the threshold."""
    stack: list = [(n, bool(path), False)]
    while stack:
        x, judged, closing = stack.pop()
        if type(x) is not Node:
            out[-1].append(x)
            continue
        if closing:
            out.append([])
            continue
        if x.chrome:
            continue
        if judged and id(x) not in path:
            if x is not best and x.density < threshold:
                continue
            judged = False
        if x.tag == "br":
            out[-1].append(" ")
            continue
        if x.tag in BLOCK:
            out.append([])
            stack.append((x, False, True))
        stack.extend((k, judged, False) for k in reversed(x.kids))


def main_text(page: str | None) -> str:
    """The article of a page: blocks in page order joined by \\n, white space inside a block one space, references decoded.

    That is the node of the largest density sum, widened to the article or
    main around it if there is one, with the outer blocks that reach the
    threshold of its path. None and pages without text give ''."""
    if not page or not page.strip():
        return ""
    root = parse(page)
    nodes = densities(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    out: list[list[str]] = [[]]
    best = max((n for n in nodes if n is not root or body is root), key=lambda n: (n.dsum, n.chars))
    above, threshold, n, top = [], best.density, best, best
    while n is not body and n.parent is not None:
        # An article or main around the node is content whole; the innermost article goes first.
        if top.tag != "article" and n.tag in ("article", "main"):
            top, above = n, []
        n = n.parent
        above.append(id(n))
        threshold = min(threshold, n.density)
    _blocks(n if above else top, out, frozenset(above), top, threshold)
    lines = (SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in out if b)
    return "\n".join(x for x in lines if x)


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """df without html, with the main text and its length in code points: a row for each row, also for repeated ones.

    A null or empty page and one without text give '' and 0; a page of any
    length and nesting takes time and memory in proportion to it. An empty
    table gives no rows. Columns named like the outputs (in any case) are replaced."""
    keep = [c for c in df.columns if c.lower() not in (html_col.lower(), text_col.lower(), chars_col.lower())]
    src = df.select(*keep, html_col)
    schema = StructType([f for f in src.schema.fields if f.name != html_col]).add(text_col, "string").add(chars_col, "long")

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, text_col, chars_col])

    return src.mapInArrow(run, schema)
