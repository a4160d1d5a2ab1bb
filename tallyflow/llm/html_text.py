"""Main text of web pages by composite text density.

A page is read into a tree. Every node gets its text density: characters per tag, adjusted by the share of characters and
tags that belong to links. A node's density sum adds up the densities of its children; the node of the largest sum holds the
article. The least density on the path from it up to the body is the threshold: what lies inside the node is the
article, and outside of it subtrees at or above the threshold are too. Menus, adverts and the like are taken off the
tree first, by their elements, roles and class names. Class names and forms are only signs, for they also stand on what wraps a
page: what holds an article element stays, and so does what holds nearly all text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import slices, strings, table

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: HTML's elements, by what this module does with them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption dd dt tbody td tfoot th thead tr option optgroup legend body html".split()) | {"dd", "dt"}
#: An element that an opening one of the same group ends, unless one of the barriers stands between.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROPPED = frozenset("head nav footer aside button select datalist menu dialog noscript template svg math canvas audio video object applet".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist tooltip status".split())
#: Class and id names of what isn't the article.
_NOISE = re.compile(
    r"(?!(?:.*[-_])?(?:has|with|no|without|layout)[-_])(.*[-_])?(?:ads?|adverts?|advertisement|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|sidebar|side-?nav|menu|nav|navbar|navigation|breadcrumbs?|footer|site-?header|page-?header|masthead|toolbar|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|social|share|sharing|related|recommended|comments?|comment-?list|respond|replies|reply|disqus|widget|pagination|pager|skip-?link)(?:[-_](?:box|bar|block|area|section|list|slot|unit|wrapper|container|inner|top|bottom|left|right|\d+))*",
    re.I,
)
_NEVER_NOISE = frozenset(("html", "body", "article", "main"))
_HARD, _NAMED, _VAGUE = 1, 2, 3
#: A form, or an element of a vague name, wraps the page if all other text is less than this share of its own.
_REST = 0.1


class _Node:
    __slots__ = ("parent", "tag", "kids", "off", "sign", "chars", "tags", "link_chars", "link_tags", "density", "total", "kept")

    def __init__(self, parent, tag: str, off: bool, sign: int = 0):
        self.parent, self.tag, self.off, self.sign, self.kids = parent, tag, off, sign, []
        self.chars = self.link_chars = self.link_tags = 0
        self.tags, self.density, self.total, self.kept = 1, 0.0, 0.0, False


def _noise(tag: str, attributes: str, inside_article: bool) -> int:
    """0, or what tells that an element isn't of the article: its kind, its name, or a form or a name with something before it."""
    if tag in DROPPED or tag == "header" and not inside_article:
        return _HARD
    sign = _VAGUE if tag == "form" else 0
    if not attributes or tag in _NEVER_NOISE:
        return sign
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return _HARD
        if name in ("class", "id"):
            for x in value.split():
                if found := _NOISE.fullmatch(x):
                    sign = _NAMED if not found[1] or sign == _NAMED else _VAGUE
    return sign if not sign or tag in BLOCK else _HARD


def parse(page: str) -> tuple[list[_Node], list[tuple[_Node, str]]]:
    """The tree's nodes, each after its parent, and the blocks of text with their elements, in page order."""
    top = _Node(None, "#page", False)
    nodes, stack, blocks = [top], [top], []
    places: dict[str, list[int]] = {}  # where in the stack each tag's open elements are, so that none is looked for
    held: list[str] = []
    articles = 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text and not stack[-1].off:
                blocks.append((stack[-1], text))

    def add(text: str) -> None:
        held.append(text)
        if places.get("a"):
            stack[places["a"][-1]].link_chars += len(text.strip())

    def pop() -> None:
        nonlocal articles
        tag = stack.pop().tag
        places[tag].pop()
        articles -= tag in ("article", "main")

    def close(tags: set, barriers: set) -> None:
        """Ends the innermost open element of ``tags`` and what is open inside it, unless a barrier is open inside it."""
        innermost = lambda some: max((places[t][-1] for t in some if places.get(t)), default=0)
        k = innermost(tags)
        if k and innermost(barriers) <= k:
            if any(n.tag in BLOCK for n in stack[k:]):
                flush()
            while len(stack) > k:
                pop()

    at, lower = 0, None
    while m := _MARKUP.search(page, at):
        if m.start() > at and not stack[-1].off:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            close({tag}, set())
            continue
        if tag in BLOCK:
            flush()
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        if tag in VOID:
            if not stack[-1].off:
                stack[-1].tags += 1
                held.append(" " if tag in ("br", "wbr", "hr") else "")
            continue
        attributes = m[3]
        if tag in RAW:  # its content isn't markup, and is never shown as text
            lower = page.lower() if lower is None or len(lower) != len(page) else lower
            end = lower.find(f"</{tag}", at) if len(lower) == len(page) else -1
            if end < 0:
                found = re.compile(f"</{tag}", re.I).search(page, at)
                end = found.start() if found else len(page)
            shut = page.find(">", end)
            at = len(page) if shut < 0 else shut + 1
            continue
        sign = 0 if stack[-1].off else _noise(tag, attributes, articles > 0)
        node = _Node(stack[-1], tag, stack[-1].off or sign == _HARD, sign)
        if tag not in BLOCK and node.off and not stack[-1].off and held:
            held.append(" ")
        if not node.off:
            stack[-1].kids.append(node)
            nodes.append(node)
        articles += tag in ("article", "main")
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            pop()
    if at < len(page) and not stack[-1].off:
        add(page[at:])
    flush()
    return _without_noise(nodes, blocks) if any(n.sign for n in nodes) else (nodes, blocks)


def _without_noise(nodes: list[_Node], blocks: list[tuple[_Node, str]]) -> tuple[list[_Node], list[tuple[_Node, str]]]:
    """The page without elements that have a sign of noise, but for those that wrap the page's text."""
    plain = {id(n): -n.link_chars for n in nodes}
    for node, text in blocks:
        plain[id(node)] += len(text)
    owner: dict[int, _Node | None] = {}  # the innermost element with a sign around each
    own: dict[int, int] = {}
    whole, holds = dict(plain), {id(n): n.tag in ("article", "main") for n in nodes}
    for node in nodes:
        owner[id(node)] = node if node.sign else node.parent and owner[id(node.parent)]
        own[id(owner[id(node)])] = own.get(id(owner[id(node)]), 0) + plain[id(node)]
    for node in reversed(nodes):
        if node.parent is not None:
            whole[id(node.parent)] += whole[id(node)]
            holds[id(node.parent)] |= holds[id(node)]
    rest = own.get(id(None), 0)
    for node in nodes:
        if node.parent is not None and node.parent.off:
            node.off = True
        elif node.sign:
            node.off = not holds[id(node)] and not (node.sign == _VAGUE and rest < _REST * whole[id(node)])
            rest += 0 if node.off else own[id(node)]
    for node in nodes:
        node.kids = [k for k in node.kids if not k.off]
    return [n for n in nodes if not n.off], [(n, t) for n, t in blocks if not n.off]


def _measure(nodes: list[_Node], blocks: list[tuple[_Node, str]]) -> None:
    """Characters, tags and links of each subtree; then densities, bottom up."""
    for node, text in blocks:
        node.chars += len(text)
    for node in reversed(nodes):
        if node.tag == "a":
            node.link_tags += 1
        if node.parent is not None:
            p = node.parent
            p.chars += node.chars
            p.tags += node.tags
            p.link_chars += node.link_chars
            p.link_tags += node.link_tags
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        if node.chars:
            c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt)) + 1) / math.log(max(base, 1.1) + 1)
    for node in nodes:
        node.total = sum(k.density for k in node.kids)


def main_text(page: str) -> str:
    """The article's blocks, in page order, joined by line ends."""
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    _measure(nodes, blocks)
    best = max(nodes, key=lambda n: n.total)
    if not best.total:
        best = blocks[0][0]
    path, up = [], best
    while up is not None and up.tag != "#page":
        path.append(up)
        up = up.parent
    threshold = min((n.density for n in path), default=0.0)
    best = next((n for n in path if n.tag in ("article", "main")), best)
    for node in nodes:
        node.kept = node is best or node.parent is not None and node.parent.kept
    within = {id(n) for n in path}
    for node in nodes:  # dense subtrees beside the path
        if not node.kept and node.parent is not None and (node.parent.kept or id(node.parent) in within and id(node) not in within and node.density >= threshold > 0 and node.tag in BLOCK):
            node.kept = best.tag not in ("article", "main") or node.parent.kept
    return "\n".join(text for node, text in blocks if node.kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html, in one pass without a shuffle.

    A null or empty page, and one without visible text, has the empty text. Character references are decoded, white space
    inside a block becomes one space, blocks are trimmed and joined by a line end, empty ones dropped. Repeated rows stay;
    other columns aren't read. Broken markup is read as far as it goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(p) for p in strings(b.column(2))], pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    out = rows.mapInArrow(run, f"page_id {pages.schema[key].dataType.simpleString()}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``; null or empty html has the empty text, an empty table no rows."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_extraction": op2_html_extraction}
ORACLE_SQL: dict[str, str] = {}
