"""Main-text extraction by tree scoring.

Every block that holds text of its own is a paragraph. It earns points for length and commas and
passes them to its ancestors, in full to the nearest, then half, then less. A container's total,
weighted by its tag and names and discounted by its link density, is its score; the best container,
or the whole article or main element that it lies in, is kept together with those siblings that score
well beside it. Boilerplate (menus, page headers and
footers, sidebars, notices, adverts, forms, scripts, reader comments) is cut before scoring, by
element, role and whole words of class and id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
CUT = frozenset("nav footer aside button select dialog menu object embed applet head canvas audio video".split()) | RAW
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Whole words of class and id that mark boilerplate.
CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars aside rail footer footers masthead cookie cookies consent gdpr notice notices banner banners popup "
    "modal overlay newsletter subscribe subscription signup paywall comment comments commentlist disqus respond replies share sharing social "
    "related recommended recommendations widget widgets toolbar pagination pager skip login search legal copyright disclaimer".split()
)
#: Words that say nothing of what an element is for.
PLAIN_NAMES = frozenset("area bar block bottom box button buttons container content group header icon icons inner item items left link links list outer panel right row section text top wrap wrapper".split())
#: Of the names that mark boilerplate, those that also do so on a single paragraph, item or phrase of an article.
AD_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion".split())
#: Elements of an article that are cut where a name marks them; others are parts of the text.
BOXES = frozenset("div section ul ol dl table details fieldset address center header".split())
GOOD_NAMES = frozenset("article body content entry main post story text page blog".split())
#: What an element is worth before any points come in.
WORTH = {"article": 25.0, "main": 20.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "address": -3.0}
#: A sibling stays if it scores this share of the best container's score.
SIBLING_SHARE = 0.2
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "points", "chars", "linked")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list = []
        self.points, self.chars, self.linked = 0.0, 0, 0


def _tag_end(html: str, at: int) -> int:
    """Where the tag's ``>`` stands, quoted values skipped; -1 if the page ends first."""
    end = html.find(">", at)
    if end < 0 or ('"' not in html[at:end] and "'" not in html[at:end]):
        return end
    i, n, before = at, len(html), ""
    while i < n:
        c = html[i]
        if c == ">":
            return i
        if not c.isspace():
            value, before = c in "\"'" and before == "=", c
        else:
            value = False
        if value:
            i = html.find(c, i + 1)
            if i < 0:
                return end
        i += 1
    return end


def parse(html: str) -> Node:
    """The tree of a page, broken or not: open elements are closed where HTML implies it."""
    root = Node("#root", "", None)
    top, at, n = root, 0, len(html)
    opened: dict[str, int] = {}

    def pop_to(node: Node) -> Node:
        """Close everything up to and including ``node``."""
        nonlocal top
        while top is not node:
            opened[top.tag] -= 1
            top = top.parent
        opened[top.tag] -= 1
        top = top.parent
        return top

    def close(tags: set, stop: set) -> None:
        node, last = top, None
        while node is not root and node.tag not in stop:
            if node.tag in tags:
                last = node
            node = node.parent
        if last is not None:
            pop_to(last)

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            top.children.append(html[at:])
            break
        if lt > at:
            top.children.append(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            if html.startswith(("<!-->", "<!--->"), lt):
                end = html.index(">", lt) - 2
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = html.startswith("</", lt)
        name = _NAME.match(html, lt + 1 + closing)
        if name is None:
            if lt + 1 + closing >= n or closing:  # a tag that the page's end cut off, or a bogus end tag
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                top.children.append("<")
                at = lt + 1
            continue
        end = _tag_end(html, name.end())
        if end < 0:
            break  # the page ends inside a tag
        tag, at = name[0].lower(), end + 1
        if closing:
            if opened.get(tag):
                node = top
                while node.tag != tag:
                    node = node.parent
                pop_to(node)
            elif tag == "br":
                top.children.append(Node("br", "", top))
            continue
        if tag not in INLINE and tag not in RAW and opened.get("p"):
            close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        elif tag == "a" and opened.get("a"):
            close({"a"}, {"table", "td", "div", "p", "li"})
        node = Node(tag, html[name.end() : end], top)
        top.children.append(node)
        if tag in VOID or (html[end - 1] == "/" and tag in ("svg", "math")):
            continue
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            if found is None:
                break
            end = html.find(">", found.end())
            at = n if end < 0 else end + 1
            continue
        top = node
        opened[tag] = opened.get(tag, 0) + 1
    return root


def _names(node: Node) -> tuple[set[str], set[str], bool]:
    """Words of class and id, roles, and whether the element is hidden."""
    if not node.attributes or node.attributes.isspace():
        return set(), set(), False
    words: set[str] = set()
    roles: set[str] = set()
    hidden = False
    for m in _ATTRIBUTE.finditer(node.attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            words.update(_WORD.findall(_CAMEL.sub(" ", value).lower()))
        elif key == "role":
            roles.update(value.lower().split())
        elif key == "hidden" or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
    return words, roles, hidden


def _marked(node: Node, names: frozenset) -> bool:
    """Whether a class or the id is made of nothing but ``names`` and plain words."""
    for m in _ATTRIBUTE.finditer(node.attributes):
        if m[1].lower() in ("class", "id"):
            for token in (m[2] or m[3] or m[4] or "").split():
                words = set(_WORD.findall(_CAMEL.sub(" ", token).lower()))
                if words & names and words <= names | PLAIN_NAMES:
                    return True
    return False


def _is_cut(node: Node, in_article: bool) -> bool:
    if node.tag in CUT:
        return True
    if node.tag == "header":
        return not in_article
    words, roles, hidden = _names(node)
    if roles & CUT_ROLES:
        return True
    if node.tag in ("html", "body", "main", "article") or roles & {"main", "article"}:
        return "comment" in words or "comments" in words
    if in_article:  # only what is plainly boilerplate goes; paragraphs, phrases and hidden parts stay
        return _marked(node, CUT_NAMES if node.tag in BOXES else AD_NAMES)
    if hidden:
        return True
    if words & GOOD_NAMES and not words & {"ad", "ads", "sidebar", "comment", "comments", "nav", "footer", "promo", "advert", "sponsored", "notice", "related"}:
        return False
    if "header" in words:
        return True
    return bool(words & CUT_NAMES)


def _chars(node: Node) -> tuple[int, bool]:
    """Characters of text below a node, and whether an article or main element is among its descendants."""
    n, holds, todo = 0, False, [node]
    while todo:
        x = todo.pop()
        for child in x.children:
            if isinstance(child, str):
                n += len(child.strip())
            else:
                holds = holds or child.tag in ("article", "main") or bool(_names(child)[1] & {"article", "main"})
                todo.append(child)
    return n, holds


def prune(root: Node) -> None:
    """Cut boilerplate from the tree, in place. A form that wraps the page (its article, or most of its text) is no boilerplate."""
    todo, whole = [(root, False)], None
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in ("article", "main") or bool(_names(node)[1] & {"article", "main"})
        kept = []
        for child in node.children:
            if isinstance(child, str):
                kept.append(child)
                continue
            if child.tag == "form":
                whole = _chars(root)[0] if whole is None else whole
                n, holds = _chars(child)
                if not holds and 2 * n <= whole:
                    continue
            elif _is_cut(child, inside):
                continue
            kept.append(child)
            todo.append((child, inside))
        node.children = kept


def score(root: Node) -> list[Node]:
    """Give every element its points, text length and linked text length; the elements, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in reversed(node.children) if not isinstance(c, str))
    own: dict[int, list] = {}  # of each block: chars and commas of the text in it but not in inner blocks
    for node in reversed(order):
        chars = commas = 0
        for child in node.children:
            if isinstance(child, str):
                text = child.strip()
                chars += len(text)
                commas += text.count(",")
        node.chars += chars
        if node.tag == "a":
            node.linked = node.chars
        inner = own.pop(id(node), [0, 0])
        inner[0] += chars
        inner[1] += commas
        parent = node.parent
        if parent is None:
            continue
        parent.chars += node.chars
        parent.linked += node.linked
        if node.tag in INLINE:
            up = own.setdefault(id(parent), [0, 0])
            up[0] += inner[0]
            up[1] += inner[1]
        elif inner[0]:
            worth = 1 + inner[1] + min(inner[0] / 100, 3.0)
            if node.tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
                node.points += worth
            share, up = 1.0, parent
            for level in range(5):  # beyond five levels next to nothing arrives
                if up is None:
                    break
                up.points += worth * share
                share = 0.5 if level == 0 else 1 / (3 * (level + 1))
                up = up.parent
    return order


def _total(node: Node) -> float:
    words, _, _ = _names(node)
    worth = node.points + WORTH.get(node.tag, 0.0) + 25 * bool(words & GOOD_NAMES)
    return worth * (1 - node.linked / node.chars) if node.chars else 0.0


def _whole(node: Node) -> Node:
    """The outermost article around a container, or else the outermost main element; without either the container itself."""
    article = main = None
    up: Node | None = node
    while up is not None:
        roles = _names(up)[1]
        if up.tag == "article" or "article" in roles:
            article = up
        elif up.tag == "main" or "main" in roles:
            main = up
        up = up.parent
    return article or main or node


def best(order: list[Node]) -> list[Node]:
    """The best container (with all of the article that it lies in) and its good siblings, in page order; empty if the page has no text."""
    totals = [(_total(x), -i) for i, x in enumerate(order) if x.points > 0 and x.tag not in INLINE]
    if not totals:
        return [x for x in order[:1] if x.chars]
    most, at = max(totals)
    top = _whole(order[-at])
    if top.parent is None or top.tag == "body":
        return [top]
    kept = []
    for child in top.parent.children:
        if child is top:
            kept.append(child)
        elif not isinstance(child, str) and child.tag not in INLINE and child.points > 0 and child.tag not in ("article", "main") and _total(child) >= max(10.0, SIBLING_SHARE * most):
            kept.append(child)
        elif not isinstance(child, str) and child.tag == "article" and _total(child) >= SIBLING_SHARE * most:
            kept.append(child)
        elif not isinstance(child, str) and child.tag == "p" and child.chars > 80 and child.linked < 0.25 * child.chars:
            kept.append(child)
    return kept


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks, white space folded and references decoded; empty blocks are left out."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        # a reference may be split by nothing but markup, so it is decoded for each run of text
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            line.append(unescape(x) if "&" in x else x)
        elif x is None:
            end()
        elif x.tag == "br" or x.tag == "wbr":
            if x.tag == "br":
                line.append(" ")
        elif x.tag in INLINE:
            todo.extend(reversed(x.children))
        else:
            end()
            todo.append(None)
            todo.extend(reversed(x.children))
    end()
    return out


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks joined by line feeds; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    prune(root)
    return "\n".join(blocks(best(score(root))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, ``text`` and ``n_chars`` (code points).

    A map without a shuffle. Null or empty html gives an empty text; repeated rows each give a row;
    an empty table gives none; other columns are ignored. Each page is parsed whole, in time that grows with
    its length; of containers with equal scores the first in the page is taken.
    """
    source = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("link"), F.col(html_col).alias("html"))
    kind = source.schema["page"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page", "link", "text", "n_chars"]
                )

    return source.mapInArrow(run, f"page {kind}, link string, text string, n_chars bigint").withColumnsRenamed({"page": id_col, "link": url_col})


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
