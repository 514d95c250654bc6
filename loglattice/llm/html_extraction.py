"""Main text of web pages by tag-path ratios.

Every visible text block belongs to a path of tags from the root to its leaf.  Per path the text
length, its linked part, the punctuation and the number of blocks are added up; the two ratios are smoothed over
the containers that a path lies in, fused into one figure, and paths above a share of the page's
best figure are content.  What lies in the container of a heavy path is content at any depth, and a
heading is if what it opens is.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.llm import common as c
from loglattice.llm.registry import query

SHARE = 0.1  # of the best figure on the page that a path needs
DAMPING = 0.6  # what a container's figure counts for the paths inside it, per level
LINKED = 0.5  # a path with a larger share of its text in links is a list of links
MARKED = 0.25  # of the page's text: an element that carries more is not dropped for a word in its class, id or role
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")
SPACE = re.compile(r"\s+")

# fixed values: element names of the HTML standard by what they mean here
UNSEEN = frozenset("script style template noscript head title iframe object svg math canvas audio video select textarea".split())
ASIDE = frozenset("nav footer aside form button dialog menu".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub"
    " sup time tt u var wbr img input rp rt ruby picture source track".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# what stands in running text; under body it belongs to the paragraphs that stand there too
FLOW = HEADINGS | frozenset(
    "p ul ol dl li dt dd table caption thead tbody tfoot tr td th colgroup blockquote pre figure figcaption address details summary hgroup".split()
)
MAIN = frozenset("article main".split())
NEVER_MARKED = MAIN | {"html", "body"}
# fixed values: words in class, id and role that mark what is not the article
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion banner sidebar side menu nav navbar"
    " navigation breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices alert popup modal overlay newsletter"
    " subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus reply replies"
    " respond widget toolbar pagination pager complementary contentinfo search".split()
)
HEADER_MARKS = frozenset("header banner".split())
# an element of the first kind ends an open one of the second kind that nothing encloses since
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "p": {"p"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

# a quote that nothing fitting closes ends with its tag
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>?"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z))*)(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
HREF = re.compile(r"\bhref\s*=\s*[\"']?\s*([^\s\"'>]?)", re.I)
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# whole class or id names of what readers wrote; such an element goes whatever its share
READERS = {
    "comment", "comments", "comment-list", "commentlist", "comment-section", "comments-section", "comments-area",
    "comment-thread", "reader-comments", "user-comments", "disqus_thread", "replies", "responses",
}
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def marks(attributes: str) -> tuple[str, set[str]]:
    """The label that class and id add to a path, and their words."""
    values = [b or c_ or d for _, b, c_, d in ATTRIBUTE.findall(attributes)]
    return "".join(f".{'.'.join(v.split())}" for v in values), {w.lower() for v in values for w in WORD.findall(v)}


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """Path, text and number of linked characters of every visible block that nothing marks as apart, in page order.

    A link is an ``a`` with ``href``, up to its end tag or the end of the element it stands in; within
    a heading, a link into the page itself is none.  Comments go whatever their share, unless an
    article, a main or the page's first heading lies among them.

    A word in class, id or role sets an element apart only if it holds no article or main, is none
    of them (nor html or body), and carries less than ``MARKED`` of the page's text; so does a form,
    which may enclose the page.

    Inline elements neither break a block nor lengthen a path; omitted end tags are supplied for
    the elements that may omit them; an end tag without its start is passed over.
    """
    stack: list[tuple[str, str, bool]] = []  # name, label in the path, whether the text is apart
    marked: list[int] = []  # per open element its number among the marked ones, or -1
    holds_main: list[bool] = []  # per marked element
    by_readers: list[bool] = []
    found: list[tuple[tuple[str, ...], list[str], int, list[int]]] = []
    parts: list[str] = []
    at, linked, in_link, link_depth = 0, 0, False, 0

    def flush() -> None:
        nonlocal linked
        if parts and not (stack and stack[-1][2]):
            found.append((tuple(label for _, label, _ in stack), parts.copy(), linked, [m for m in marked if m >= 0]))
        parts.clear()
        linked = 0

    def close(names: set[str], scope: set[str]) -> None:
        nonlocal in_link
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:], marked[i:]
                in_link = in_link and len(stack) >= link_depth
                return
            if stack[i][0] in scope:
                return

    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * in_link
        at = m.end()
        ends, name, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        name = (name or "").lower()
        if not name:
            continue
        if name == "a":
            target = None if ends else HREF.search(attributes)
            in_link = bool(target) and not (target[1] == "#" and any(n in HEADS for n, _, _ in stack))
            link_depth = len(stack)
        if ends:
            if name in INLINE:
                continue
            if name == "br":
                parts.append(" ")
                continue
            if any(n == name for n, _, _ in stack):
                flush()
                close({name}, set())
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
            continue
        label, words = ("", set()) if not attributes else marks(attributes)
        apart = name in UNSEEN or (name in ASIDE and name != "form")
        mark = name == "form" or (bool(words & MARKS) and name not in NEVER_MARKED)
        if name in INLINE and not apart and not mark:
            continue
        flush()
        if name in VOID:
            continue
        if name not in INLINE and any(n == "p" for n, _, _ in stack):
            close({"p"}, {"table", "td", "th", "button", "object"})  # a paragraph holds no blocks
        if name in CLOSES:
            close(CLOSES[name], SCOPES.get(name, set()))
        if (name == "header" or words & HEADER_MARKS) and not any(n in MAIN for n, _, _ in stack):
            apart, mark = apart or name == "header", mark or name not in NEVER_MARKED
        if name in MAIN or name == "h1":
            for number in marked:
                if number >= 0:
                    holds_main[number] = True
        marked.append(len(holds_main) if mark else -1)
        if mark:
            holds_main.append(False)
            by_readers.append(bool(READERS & set(label.lower().split("."))))
        stack.append((name, name + label, apart or bool(stack and stack[-1][2])))
        if name in INLINE:  # an inline element that is apart ends with its own tag
            stack[-1] = (name, name + label, True)
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else at
            stack.pop()
            marked.pop()
    if at < len(page):
        parts.append(page[at:])
    flush()
    read, sizes = [], [0] * len(holds_main)
    for path, pieces, in_links, marks_ in found:
        text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        if text:
            read.append((path, text, min(in_links, len(text)), marks_))
            for number in marks_:
                sizes[number] += len(text)
    least = MARKED * sum(len(text) for _, text, _, _ in read)
    kept = [holds or (size >= least and not readers) for holds, size, readers in zip(holds_main, sizes, by_readers)]
    return [(path, text, in_links) for path, text, in_links, marks_ in read if all(kept[m] for m in marks_)]


def content_paths(found: list[tuple[tuple[str, ...], str, int]]) -> set[tuple[str, ...]]:
    """The paths whose fused, smoothed ratio reaches ``SHARE`` of the best, and those that lie in a
    chosen container, however deep: the article or main around a path that reaches it by its own
    figure, else the element that holds it.  Right under body only running text is taken along, as
    other elements there are containers of their own.  Lists of links are never taken."""
    length: dict[tuple[str, ...], int] = {}
    stops: dict[tuple[str, ...], int] = {}
    number: dict[tuple[str, ...], int] = {}
    links: dict[tuple[str, ...], int] = {}
    for path, text, linked in found:
        links[path] = links.get(path, 0) + linked
        for depth in range(len(path) + 1):  # a container has what lies in it
            node = path[:depth]
            length[node] = length.get(node, 0) + len(text)
            stops[node] = stops.get(node, 0) + len(PUNCTUATION.findall(text))
            number[node] = number.get(node, 0) + 1

    def fused(node: tuple[str, ...]) -> float:
        """Text per block, times punctuation per block, times the share of the page it carries."""
        share = length[node] / length[()]
        return share * math.sqrt(length[node] / number[node]) * math.log2(2 + stops[node] / number[node])

    def smooth(path: tuple[str, ...]) -> float:
        """The largest of a path's own figure and, fading with distance, those of its containers
        inside the body: a heading shares in the article it opens."""
        value = fused(path)
        for depth in range(len(path) - 1, 0, -1):
            if path[depth - 1].split(".")[0] in ("html", "body"):
                break
            value = max(value, fused(path[:depth]) * DAMPING ** (len(path) - depth))
        return value

    own: dict[tuple[str, ...], int] = {}
    for path, text, _ in found:
        own[path] = own.get(path, 0) + len(text)
    figures = {path: smooth(path) for path, size in own.items() if links[path] <= LINKED * size}
    best = max(figures.values(), default=0.0)
    chosen = {container(path) for path in figures if fused(path) >= SHARE * best}
    return {path for path, value in figures.items() if value >= SHARE * best or lies_in(path, chosen)}


def tag(label: str) -> str:
    return label.split(".")[0]


def container(path: tuple[str, ...]) -> tuple[str, ...]:
    """The innermost article or main that ``path`` lies in, else the innermost element that is not
    itself a piece of running text."""
    for depth in range(len(path), 0, -1):
        if tag(path[depth - 1]) in MAIN:
            return path[:depth]
    depth = len(path)
    while depth and tag(path[depth - 1]) in FLOW:
        depth -= 1
    return path[:depth]


def lies_in(path: tuple[str, ...], chosen: set[tuple[str, ...]]) -> bool:
    """Whether ``path`` lies in a chosen container; in body or above it, by running text alone."""
    for depth in range(len(path) + 1):
        if path[:depth] in chosen:
            inner = depth and tag(path[depth - 1]) not in ("html", "body")
            if inner or all(tag(label) in FLOW for label in path[depth:]):
                return True
    return False


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by an empty line; "" for a null or empty page."""
    found = blocks(page or "")
    kept = content_paths(found)
    texts, opens = [], False  # from the end: whether the block after a heading is kept
    for path, text, linked in reversed(found):
        heading = any(tag(label) in HEADINGS for label in path)
        if path in kept or (heading and opens and linked <= LINKED * len(text)):
            texts.append(text)
        if not heading or path in kept:
            opens = path in kept
    return "\n\n".join(reversed(texts))


def extracted(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (own columns of these names are dropped).

    Null and empty pages, and those without visible text, give "".  Pages of any length are read
    whole.  Repeated rows are repeated; equal figures are kept together; an empty table gives an
    empty one.  Each row is judged alone, so nothing is shuffled.
    """
    base = pages.drop("text", "n_chars")
    fields = [*base.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.schema.get_field_index("html"))]
            extra = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "text", "n_chars"])

    return base.mapInArrow(read, T.StructType(fields))


@query("op1_html_extraction")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pages = c.table(spark, folder, "pages").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", "n_chars")
