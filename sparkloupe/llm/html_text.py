"""Operator 8: main text of web pages by composite text density.

A small tokenizer and tree builder (void elements, raw-text elements, implied end tags, inline elements
left open by a closing block) gives the DOM.  Menus, page headers and footers, sidebars, notices,
adverts, forms, reader comments and other known boilerplate subtrees are cut first; but what a wrapping
element, a class, an id or a role only suggests is kept where, by the densities of the page with all such
subtrees, it holds the core or most of the unlinked text and no article stands beside it, and inside an article or
main element only whole names of a short list count, never parts of names.  For every remaining
node the composite density is its characters per tag, adjusted by how many of the characters and tags
belong to links (Sun, Song, Liao: DOM Based Content Extraction via Text Density, 2011); a node's density
sum adds its children's densities.  The subtree with the largest sum is the core; the smallest density on
the path from the body (which counts) to it is the threshold, and every node whose density reaches it, and of
which links make less than half, gives the subtree with the largest sum inside it.  A core inside an article or main
element stands for all of that element.  Blocks are written in page order.

Cases: null and empty pages, and pages without text, give an empty text; unclosed or stray tags, unclosed
comments and attributes without end are read to the end of the page; rows are independent, so repeats
and ties (the earlier node wins) are settled; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloupe.llm.common import table

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: A start tag of the key ends an open element of the value, unless a scope of _SCOPES stands between.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody", "tfoot"), "thead": ("tbody",), "tfoot": ("tr", "td", "th", "thead", "tbody"), "option": ("option",), "optgroup": ("option", "optgroup"),
}
_SCOPES = frozenset("ul ol dl table html body article section main div td th menu select nav aside".split())
_DROP = frozenset("head script style noscript template iframe object embed svg math canvas audio video nav aside footer form button select textarea input dialog menu search title noembed noframes xmp".split())
#: Of _DROP what can wrap a whole page or article.
_WRAPS = frozenset("form aside footer dialog search".split())
#: Readers' comments can be longer than the article: cut whatever they hold.
_COMMENTS = re.compile(r"(?:^|\s)(?:comments?|comment-?list|comments?-(?:area|section|thread|body|content)|disqus\w*|respond|replies)(?:$|\s)", re.I)
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside|footer|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe\w*|subscription|signup|share|sharing|social|related|recommend\w*|comments?|commentlist|comment\w*|disqus|respond|replies|login|search\w*|pagination|pager|widget\w*|toolbar|masthead|copyright|legal|skip|toc)(?:$|[\s_-])",
    re.I,
)
#: Whole class names and ids that are boilerplate inside an article or main element too; parts of names say nothing there.
_INSIDE = frozenset(
    "ad ads advert adverts advertisement adbox ad-slot ad-container sponsored sponsored-content promo cookie-notice cookie-banner sidebar share sharing share-buttons share-bar social social-share related related-posts related-articles recommended recommendations newsletter newsletter-signup subscribe popup modal navbar menu breadcrumb breadcrumbs pagination pager comment comments comment-list commentlist comments-area comments-section disqus_thread respond replies".split()
)
_HEADER_NAME = re.compile(r"(?:^|[\s_-])(?:header|topbar|top)(?:$|[\s_-])", re.I)
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("at", "chars", "density", "items", "link_chars", "link_tags", "parent", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.items = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.at: int | None = None  # place of the start tag of a doubtful boilerplate subtree


def _certain(tag: str, attributes: str) -> bool:
    """Whether a boilerplate subtree is one whatever it holds: controls, menus, hidden parts, readers' comments."""
    if tag in _DROP and tag not in _WRAPS:
        return True
    values = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
    hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I)
    return bool(hidden) or tag == "article" or any(_COMMENTS.search(values.get(k, "")) for k in ("class", "id"))


def _boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    """inside: within an article or main element, where a header holds the title."""
    if tag in _DROP:
        return True
    if tag == "header":
        return not inside
    if not attributes.strip():
        return False
    values = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I):
        return True
    if tag in ("html", "body", "article", "main"):
        return tag == "article" and bool(re.search(r"(?:^|[\s_-])comment", f"{values.get('class', '')} {values.get('id', '')}", re.I))
    name = f"{values.get('class', '')} {values.get('id', '')}"
    if inside:
        return values.get("role", "").lower() in _BAD_ROLE or not _INSIDE.isdisjoint(name.lower().split())
    return values.get("role", "").lower() in _BAD_ROLE or bool(_BAD_NAME.search(name)) or bool(_HEADER_NAME.search(name))


def parse(page: str, spared: frozenset[int] | None = frozenset()) -> Node:
    """The tree of a page without boilerplate; items of a node are nodes and decoded texts.

    spared: places of the start tags of boilerplate that stays; None keeps and marks all that is doubtful.
    """
    root = Node("html", None)
    at, here, n = 0, root, len(page)
    stack = [root]
    gone: list[str] = []  # open elements of the cut subtree
    inside = 0
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not gone:
            here.items.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] if m[2] else m[6]
        if closing:
            if gone:
                if tag in gone:
                    while gone.pop() != tag:
                        pass
                    continue
                if tag not in ("body", "html", "article", "main") or not any(x.tag == tag for x in stack):
                    continue
                gone = []  # an element around the cut one ends
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    inside -= sum(x.tag in ("article", "main") for x in stack[k:])
                    del stack[k:]
                    here = stack[-1]
                    break
                if tag in _INLINE and stack[k].tag not in _INLINE:
                    break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if gone:
            if tag not in _VOID:
                if tag == "p" or tag in _ENDS:
                    for k in range(len(gone) - 1, 0, -1):
                        if gone[k] in _ENDS.get(tag, ("p",)):
                            del gone[k:]
                            break
                        if gone[k] in _SCOPES:
                            break
                gone.append(tag)
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in _INLINE:
                    break
        if tag in _ENDS:
            ends = _ENDS[tag]
            while True:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ends:
                        del stack[k:]
                        break
                    if stack[k].tag in _SCOPES:
                        k = 0
                        break
                else:
                    k = 0
                if not k:
                    break
        here = stack[-1]
        if tag in _VOID:
            if tag in ("br", "hr"):
                here.items.append(" " if tag == "br" else Node("hr", here))
            continue
        doubtful = _boilerplate(tag, attributes, bool(inside))
        if doubtful and (_certain(tag, attributes) if spared is None else m.start() not in spared):
            if attributes.rstrip().endswith("/") and tag in ("svg", "path"):
                continue
            gone = [tag]
            continue
        node = Node(tag, here)
        node.at = m.start() if doubtful else None
        here.items.append(node)
        stack.append(node)
        here = node
        inside += tag in ("article", "main")
    return root


def _order(root: Node) -> list[Node]:
    """Nodes in page order, without recursion."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in reversed(node.items) if isinstance(x, Node))
    return out


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """C / T times the logarithm of (C / LC) (T / LT) to the base ln((C / not LC) LC + share C + e); share: of link characters in the body.

    A count of zero in a denominator is one.  On a page without link characters the base is one and the logarithm
    has no value: there the density is the plain text density C / T.
    """
    if not chars:
        return 0.0
    plain = chars / (tags or 1)
    base = math.log(chars / ((chars - link_chars) or 1) * link_chars + share * chars + math.e)
    if base <= 1:
        return plain
    return plain * math.log(chars / (link_chars or 1) * (tags or 1) / (link_tags or 1)) / math.log(base)


def measure(root: Node) -> list[Node]:
    """Fills the densities and density sums of a tree; its nodes in page order."""
    nodes = _order(root)
    for node in reversed(nodes):
        for x in node.items:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            else:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = next((x for x in nodes if x.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(nodes):
        node.density = composite_density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        node.total = sum(x.density for x in node.items if isinstance(x, Node))
    return nodes


def _best(nodes: list[Node]) -> Node | None:
    full = [x for x in nodes if x.chars]
    return max(full, key=lambda x: x.total) if full else None


def content(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    nodes = measure(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    inner = _order(body)
    core = _best(inner)
    if core is None:
        return []
    while core.total == 0 and core.parent is not None and core is not body:
        core = core.parent  # a lone block
    threshold, node, around = core.density, core, None
    while node is not None:
        threshold = min(threshold, node.density)
        if node.tag in ("article", "main"):
            around = node
        node = None if node is body else node.parent
    if around is not None:
        return [around]
    # of every node whose density reaches the threshold, the subtree with the largest sum in it
    best: dict[int, Node] = {}
    marked = {id(core)}
    for node in reversed(inner):
        top = node
        for x in node.items:
            if isinstance(x, Node) and best[id(x)].total > top.total:
                top = best[id(x)]
        best[id(node)] = top
        if node.chars and node.density >= threshold and node.link_chars * 2 < node.chars:
            marked.add(id(top))
    kept: list[Node] = []
    todo = [body]
    while todo:
        node = todo.pop()
        if id(node) in marked:
            kept.append(node)
        else:
            todo.extend(x for x in reversed(node.items) if isinstance(x, Node))
    if len(kept) == 1 and core is not body and any(isinstance(x, str) and x.strip() for x in body.items):
        return [body]  # bare text beside the core
    return kept


def _spared(page: str) -> frozenset[int]:
    """Places of the boilerplate subtrees that hold the core of the whole page, or most of its unlinked text."""
    nodes = measure(parse(page, None))
    doubtful = [x for x in nodes if x.at is not None]
    if not doubtful:
        return frozenset()
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    core = _best(_order(body))
    if core is None:
        return frozenset()

    def up(node: Node | None) -> set[int]:
        out = set()
        while node is not None:
            out.add(id(node))
            node = node.parent
        return out

    clear, above, marked = [], up(core), {id(x) for x in doubtful}
    for x in nodes:  # articles beside the doubtful subtrees
        if x.tag in ("article", "main") and x.chars > x.link_chars and not up(x) & marked:
            clear.append(id(x))
    out = set()
    for x in doubtful:
        if (id(x) in above or 2 * (x.chars - x.link_chars) > body.chars - body.link_chars) and set(clear) <= up(x):
            out.add(x.at)
    return frozenset(out)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run and (block := " ".join("".join(run).split())):
            out.append(block)
        run.clear()

    for top in content(parse(page, _spared(page))):
        end()
        todo: list[object] = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                run.append(x)
            elif x is None:
                end()
            elif x.tag in _INLINE:
                todo.extend(reversed(x.items))
            else:
                end()
                todo.append(None)
                todo.extend(reversed(x.items))
        end()
    return "\n".join(out)


def extract_text(df: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns to keep, text and n_chars of every page."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(x.as_py()) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return df.select(*keep, F.col(html_col)).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
