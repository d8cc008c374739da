"""Main text of pages by a tree-structured graphical model over DOM nodes.

Every element is a binary variable (content or not) with a unary potential from its
tag, its class and id words, and its text density; each parent and child share a
pairwise potential that depends on the child's tag. One sum-product pass from the
leaves to the root and one back give exact marginals. The weights are logistic:
unary ones from labelled nodes, pairwise ones from labelled parent-child pairs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, some

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never rendered as text.
HIDDEN = frozenset("script style noscript template title head textarea select option object svg math canvas iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("body html dd dt li tbody td tfoot th thead tr".split()) | {"dl", "ul", "ol", "table"}
#: A start tag ends an open element of these names, up to the given boundary.
ENDS_OWN = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
INLINE_OPEN = frozenset("a abbr b big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var".split())


@dataclass
class Node:
    tag: str
    words: tuple[str, ...]
    parent: int
    parts: list = field(default_factory=list)  # text, child numbers, or None for a line break
    chars: int = 0  # of own and inner text
    linked: int = 0  # of those, inside links


class _Builder(HTMLParser):
    """Nodes in page order; tolerant of unclosed and misnested elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", (), -1)]
        self.open = [0]

    def _close_to(self, k: int) -> None:
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            for k in range(len(self.open) - 1, 0, -1):
                name = self.nodes[self.open[k]].tag
                if name == "p":
                    self._close_to(k)
                    break
                if name not in INLINE_OPEN:
                    break
        if tag in ENDS_OWN:
            ends, until = ENDS_OWN[tag]
            for k in range(len(self.open) - 1, 0, -1):
                name = self.nodes[self.open[k]].tag
                if name in ends:
                    self._close_to(k)
                    break
                if name in until:
                    break
        words = tuple(w for k, v in attrs if k in ("class", "id", "role") and v for w in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", v).lower()))
        self.nodes.append(Node(tag, words, self.open[-1]))
        number = len(self.nodes) - 1
        self.nodes[self.open[-1]].parts.append(number)
        if tag not in VOID:
            self.open.append(number)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            name = self.nodes[self.open[k]].tag
            if name == tag:
                self._close_to(k)
                return
            if tag in INLINE_OPEN and name in BLOCK:  # a stray end tag does not end a block
                return

    def handle_data(self, data):
        self.nodes[self.open[-1]].parts.append(data)


def parse(html: str | None) -> list[Node]:
    """Nodes of a page; the first is a root that stands for the page."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    for i in range(len(b.nodes) - 1, -1, -1):
        n = b.nodes[i]
        n.chars += sum(len(p.strip()) for p in n.parts if isinstance(p, str)) if n.tag not in HIDDEN else -n.chars
        if n.tag == "a":
            n.linked = n.chars
        if n.parent >= 0:
            b.nodes[n.parent].chars += n.chars
            b.nodes[n.parent].linked += n.linked
    return b.nodes


def features(n: Node) -> list[str]:
    """Unary features of one node."""
    share = n.linked / n.chars if n.chars else 0.0
    return ["bias", f"tag={n.tag}", *{f"word={w}" for w in n.words}, f"size={min(12, n.chars.bit_length())}", f"links={min(4, int(5 * share))}"]


# What a page's author says about an element, by HTML's own element names
# and the usual words of class, id and role. They label pages where a model is trained.
CONTENT_TAGS = frozenset(["article", "main"])
CONTENT_WORDS = frozenset("article content entry main post story".split())
OTHER_TAGS = HIDDEN | frozenset("aside button footer form header input label menu nav search".split())
OTHER_WORDS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs byline comment comments consent cookie copyright footer header menu nav navbar navigation newsletter notice pagination popup promo promoted recommended related replies reply respond share sharing sidebar social sponsor sponsored subscribe tags toolbar widget".split())


def labels(nodes: list[Node]) -> list[int] | None:
    """Weak labels of a page that names its parts: content is what lies inside an
    article or main element and inside nothing that says otherwise; None where no
    element names the content."""
    own = [0] * len(nodes)
    found = False
    for i, n in enumerate(nodes[1:], 1):
        above = own[n.parent]
        if n.tag in OTHER_TAGS and not (n.tag == "header" and above == 1) or OTHER_WORDS & set(n.words):
            own[i] = -1
        elif above == 0 and (n.tag in CONTENT_TAGS or CONTENT_WORDS & set(n.words)):
            own[i], found = 1, True
        else:
            own[i] = above
    return [int(x == 1) for x in own] if found else None


@dataclass
class Model:
    unary: dict[str, float]
    pair: dict[str, tuple[float, float]]  # child's tag -> log-odds of content under content, under other


def fit(pages: list[str], rounds: int = 12, rate: float = 0.3) -> Model:
    """Train on the labelled ones among ``pages``; without any, on the name lists alone.

    Pseudo-likelihood: each node's label given its features and its parent's label.
    """
    rows, pair = [], Counter()
    seen: set = set()
    for html in pages:
        nodes = parse(html)
        y = labels(nodes)
        if y is None:
            continue
        for named in (True, False):  # once as it is, once without the names of its content elements
            for i, n in enumerate(nodes[1:], 1):
                if not named:
                    n.tag, n.words = "div" if n.tag in CONTENT_TAGS else n.tag, tuple(w for w in n.words if w not in CONTENT_WORDS)
                pair[n.tag, y[n.parent], y[i]] += 1
                row = (tuple(sorted(features(n))), y[n.parent], y[i])
                if row not in seen:
                    seen.add(row)
                    rows.append(row)
    prior = {f"tag={t}": -3.0 for t in OTHER_TAGS} | {f"word={w}": -9.0 for w in OTHER_WORDS} | {f"tag={t}": 3.0 for t in CONTENT_TAGS} | {f"word={w}": 4.0 for w in CONTENT_WORDS}
    pairs = {t: tuple(math.log((pair[t, a, 1] + (0.5 if a else 0.02)) / (pair[t, a, 0] + (0.02 if a else 0.5))) for a in (1, 0)) for t in {k[0] for k in pair} | {"*"}}
    pairs = {t: tuple(max(-4.0, min(4.0, x)) for x in v) for t, v in pairs.items()}
    w = dict(prior)
    for _ in range(rounds):
        for f, above, y in rows:
            tag = next(x[4:] for x in f if x.startswith("tag="))
            s = sum(w.get(x, 0.0) for x in f) + pairs.get(tag, pairs["*"])[1 - above]
            g = rate * (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, s)))))
            if abs(g) > 1e-3:
                for x in f:
                    w[x] = w.get(x, 0.0) + g - 1e-3 * (w.get(x, 0.0) - prior.get(x, 0.0))
    return Model(w, pairs)


def marginals(nodes: list[Node], m: Model) -> list[float]:
    """Probability of content of every node: exact sum-product on the tree."""
    n = len(nodes)
    on = [0.0] * n  # unary log-odds, then with what came from below
    up = [(0.0, 0.0)] * n  # log messages to the parent's (content, other)
    any_tag = m.pair.get("*", (1.0, -1.0))
    pot = []
    for i, node in enumerate(nodes):
        on[i] = max(-30.0, min(30.0, sum(m.unary.get(f, 0.0) for f in features(node)))) if i else -2.0
        c, o = m.pair.get(node.tag, any_tag)
        pot.append(((-_soft(-c), -_soft(c)), (-_soft(-o), -_soft(o))))  # log p(child | parent): ((1|1, 0|1), (1|0, 0|0))
    for i in range(n - 1, 0, -1):
        (a1, a0), (b1, b0) = pot[i]
        up[i] = (_add(a1 + on[i], a0), _add(b1 + on[i], b0))
        on[nodes[i].parent] += up[i][0] - up[i][1]
    out = [0.0] * n
    belief = list(on)  # log-odds of the marginal
    out[0] = 1 / (1 + math.exp(-max(-60.0, min(60.0, belief[0]))))
    for i in range(1, n):
        (a1, a0), (b1, b0) = pot[i]
        down = belief[nodes[i].parent] - (up[i][0] - up[i][1])  # the parent without this child
        belief[i] = on[i] + _add(a1 + down, b1) - _add(a0 + down, b0)
        out[i] = 1 / (1 + math.exp(-max(-60.0, min(60.0, belief[i]))))
    return out


def _soft(x: float) -> float:
    return max(x, 0.0) + math.log1p(math.exp(-abs(x)))


def _add(a: float, b: float) -> float:
    return a + _soft(b - a)


def main_text(html: str | None, m: Model) -> str:
    """Blocks of the content nodes in page order, joined by line feeds; white space
    inside a block is one space. Empty if no node is content."""
    nodes = parse(html)
    keep = [p > 0.5 for p in marginals(nodes, m)]
    blocks: list[list[str]] = [[]]
    stack: list[tuple[int, int]] = [(0, 0)]  # node, next part
    while stack:
        i, k = stack.pop()
        node = nodes[i]
        if node.tag in HIDDEN:
            continue
        if k == 0 and (node.tag in BLOCK or node.tag == "br"):
            blocks.append([])
        parts = node.parts
        while k < len(parts) and isinstance(parts[k], str):
            if keep[i]:
                blocks[-1].append(parts[k])
            k += 1
        if k < len(parts):
            stack += [(i, k + 1), (parts[k], 0)]
        elif node.tag in BLOCK:
            blocks.append([])
    return "\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


def sample(pages: DataFrame, most: int = 300, most_chars: int = 1 << 18, html_col: str = "html") -> list[str]:
    """About ``most`` pages of up to ``most_chars`` characters, for training."""
    known = pages.filter(F.col(html_col).isNotNull() & (F.char_length(html_col) <= most_chars)).select(html_col)
    return sorted(r[0] for r in some(known, most).collect())


def extract(pages: DataFrame, m: Model, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with ``main_text``; null and empty html give an
    empty text. Other columns are kept; one named ``main_text`` may not exist."""
    others = [c for c in pages.columns if c != html_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html_col)

    def rows(batch: pa.RecordBatch) -> dict:
        out = {c: batch.column(i) for i, c in enumerate(others)}
        return out | {"main_text": [main_text(t, m) for t in batch.column(len(others)).to_pylist()]}

    return arrow_map(pages, [*others, html_col], f"{schema}{', ' * bool(others)}main_text string", rows, by=html_col)
