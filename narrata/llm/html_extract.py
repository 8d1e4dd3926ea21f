"""Main text of web pages by equivalence-class template deduction.

Pages of one host share a template.  Each page is read as a stream of tokens:
structural ones (the path of an element, by tag and class) and text blocks.  A token's occurrence vector says how often it occurs in each page of
the host; tokens with the same vector form an equivalence class.  Classes
that occur once a page in most pages are valid and nest into the template;
text outside its tokens fills its slots, and the slots with the prose are
extracted, on pages with an article or main element too: those elements only
tell which slots to look at first.

The vectors are never gathered: a vector is represented by the xor of a hash
of (page, count) over all pages, which Spark aggregates in parts, so a host
with a third of all pages is one row per token like any other.
"""

from __future__ import annotations

import hashlib
import heapq
import html as htmllib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.scratch import cut

# Fixed values of HTML: elements without content, elements that a new block closes, and elements whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header html hr li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "xmp")
# What is never main text, by element, by role and by a word of class or id.
BOILER_TAGS = frozenset("nav header footer aside form button dialog menu fieldset label head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form "
    "header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted recommended related "
    "replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
CONTENT_TAGS = frozenset(("article", "main"))
#: Longest other blocks of a page that tell whether two pages with a text in common are copies.
AROUND = 3

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^<>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S
)
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")


def digest(*parts: object) -> int:
    """A signed 64-bit hash that is the same in every process."""
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _start(tag: str, attrs: str, in_content: bool) -> tuple[str, bool, bool]:
    """The element's step in a path, and whether it is boilerplate or a content root."""
    boiler, content, name = tag in BOILER_TAGS and not (tag == "header" and in_content), tag in CONTENT_TAGS, tag
    if attrs:
        for m in ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "class":
                name = f"{tag}.{re.sub(r'[0-9]+', '', value)}"
            if key in ("class", "id"):
                boiler = boiler or (tag not in ("body", "html") and not BOILER_WORDS.isdisjoint(re.split(r"[\s_-]+", value)))
            elif key == "role":
                boiler, content = boiler or value in BOILER_ROLES, content or value == "main"
            elif key == "itemprop":
                content = content or value == "articlebody"
            else:
                boiler = boiler or (key == "hidden" and m[2] is None and m[3] is None and m[4] is None) or (key == "aria-hidden" and value == "true")
    return name, boiler, content


class Node:
    """An open or closed element: its place in the page as a hash of the steps to it, and what holds for all in it."""

    __slots__ = ("anchor", "article", "boiler", "chars", "content", "depth", "inside", "links", "parent", "path", "slot", "tag")

    def __init__(self, tag: str, path: int, parent: Node | None, boiler: bool, content: bool) -> None:
        self.tag, self.path, self.parent = tag, path, parent
        self.boiler, self.content = boiler, content
        self.article = tag in CONTENT_TAGS or (parent is not None and parent.article)
        self.anchor = tag == "a" or (parent is not None and parent.anchor)
        self.depth = parent.depth + 1 if parent is not None else 0
        self.chars = self.links = 0


class Block(NamedTuple):
    text: str
    node: Node
    content: bool
    linked: bool


def walk(page: str) -> tuple[list[Block], list[Node]]:
    """Text blocks of a page, and its elements, parents first.

    Unclosed elements end where their parents end or a new block begins.  What
    holds for an element is kept with it, and open elements are found by their
    tag, so time and memory grow with the page, however deep it is nested.
    """
    root = Node("", digest("path"), None, False, False)
    stack, nodes, blocks = [root], [], []
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    kinds = 0  # open blocks
    text: list[str] = []
    linked = True
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            whole = SPACE.sub(" ", htmllib.unescape("".join(text))).strip()
            if whole:
                blocks.append(Block(whole, stack[-1], stack[-1].content, linked))
            text.clear()
        linked = True

    def said(piece: str) -> None:
        nonlocal linked
        top = stack[-1]
        if piece and not top.boiler:
            if linked and not top.anchor and not piece.isspace():
                linked = False
            text.append(piece)

    def close(to: int) -> None:
        nonlocal kinds
        if any(n.tag in BLOCK for n in stack[to:]):
            flush()
        for n in stack[to:]:
            places[n.tag].pop()
            kinds -= n.tag in BLOCK
        del stack[to:]

    def last(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            said(page[at:])
            break
        said(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                said(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            if i := last((tag,)):
                close(i)
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW and not m[3].endswith("/"):
            found = RAW_END[tag].search(page, at)
            at = found.end() if found else end
            continue
        if tag in CLOSES_P and (i := last(("p",))):
            close(i)
        elif tag in ("li", "td", "th", "tr", "dd", "dt"):
            stops, same = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",)}.get(tag, ("table",)), {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            if (i := last(same)) > last(stops):
                close(i)
        if tag in BLOCK:
            flush()
        if tag == "br":
            said(" ")
        above = stack[-1]
        name, boiler, content = _start(tag, m[3], above.content)
        node = Node(tag, digest("path", above.path, name), above, boiler or above.boiler, content or above.content)
        nodes.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    flush()
    for b in blocks:
        if b.linked:
            b.node.links += len(b.text)
        else:
            b.node.chars += len(b.text)
    for n in reversed(nodes):
        n.parent.chars += n.chars
        n.parent.links += n.links
    return blocks, nodes


def _around(texts: list[str]) -> int:
    """One bit of 63, by a hash of the texts."""
    return 1 << digest("around", *texts) % 63


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token statistics, added up within the task in a table of bounded size."""
    sums: dict[tuple[str, int, str], list[int]] = {}  # pages, total, vector, chars, linked chars, bits of the pages' surroundings

    def out() -> pa.RecordBatch:
        rows = [(h, t, *v) for (h, t, _), v in sums.items()]
        kinds = [k for _, _, k in sums]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
        sums.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(kinds, pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:8])], names=["host", "token", "kind", "pages", "total", "vector", "chars", "linked", "around"]
        )

    for batch in batches:
        for host, page_id, page in zip(*(batch.column(c).to_pylist() for c in ("host", "page_id", "html")), strict=True):
            blocks, nodes = walk(page)
            paths: dict[int, list[int]] = {}  # how often, unlinked and linked characters
            for n in nodes:
                of = paths.setdefault(n.path, [0, 0, 0])
                of[0], of[1], of[2] = of[0] + 1, of[1] + n.chars, of[2] + n.links
            words: dict[str, int] = {}
            for b in blocks:
                words[b.text] = words.get(b.text, 0) + 1
            longest = heapq.nlargest(AROUND + 1, words, key=lambda t: (len(t), t))
            whole = _around(longest[:AROUND])
            tokens = [(p, "path", *of, whole) for p, of in paths.items()]
            tokens += [(digest("text", t), "text", n, 0, 0, _around([x for x in longest if x != t][:AROUND]) if t in longest[:AROUND] else whole) for t, n in words.items()]
            for token, kind, n, chars, links, around in tokens:
                s = sums.setdefault((host, token, kind), [0] * 6)
                s[0] += 1
                s[1] += n
                s[2] ^= digest(page_id, n)
                s[3] += chars
                s[4] += links
                s[5] |= around
            if len(sums) > 100_000:
                yield out()
    yield out()


def deduce(pages: DataFrame) -> DataFrame:
    """Templates from (host, page_id, html): host, frame, roots, links and said.

    Classes are tokens of a host with the same occurrence vector; those that
    occur once a page, in half of the host's pages or more, are valid.
    ``frame`` has their paths, ``roots`` those of them that hold most of the
    host's unlinked text, ``links`` those other ones with more linked than
    unlinked text.  ``said`` has the template's own words: texts of half of
    the pages or more, once in each or oftener, provided that the pages differ
    in what stands around them; a paragraph of copied pages is no template.
    One row per host.
    """
    schema = "host string, token long, kind string, pages long, total long, vector long, chars long, linked long, around long"
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "chars", "linked")]
    summed = pages.mapInArrow(_tokens, schema).groupBy("host", "token", "kind").agg(*sums, F.bit_xor("vector").alias("vector"), F.bit_or("around").alias("around"))
    # A token of one page is in no valid class.
    summed = cut(summed.filter("pages >= 2"), "page-tokens")
    size = summed.groupBy("host").agg(F.max("pages").alias("host_pages"), F.max("chars").alias("host_chars"), F.bit_count(F.bit_or("around")).alias("host_around"))
    classes = summed.groupBy("host", "vector").agg(F.min(F.col("total") == F.col("pages")).alias("once"), F.max("pages").alias("class_pages"), F.count("*").alias("members"))
    valid = F.col("once") & (F.col("members") >= 2)
    members = summed.join(size, "host").filter(F.col("pages") * 2 >= F.col("host_pages")).join(classes, ["host", "vector"])
    framed = (F.col("kind") == "path") & valid
    holds = framed & (F.col("chars") * 10 >= F.col("host_chars") * 6)
    # A text that half of four pages or more share is the template's; fewer pages say too little.
    shared = (F.col("kind") == "text") & (F.col("host_pages") >= 4) & (_distinct(F.bit_count("around")) * 2 >= _distinct(F.col("host_around"))) & (F.bit_count("around") >= 2)
    return members.groupBy("host").agg(
        F.collect_set(F.when(framed, F.col("token"))).alias("frame"),
        F.collect_set(F.when(holds, F.col("token"))).alias("roots"),
        F.collect_set(F.when(framed & ~holds & (F.col("linked") > F.col("chars")), F.col("token"))).alias("links"),
        F.collect_set(F.when(shared, F.col("token"))).alias("said"),
    )


def _distinct(bits: Column) -> Column:
    """How many different values leave so many of 63 bits set, by linear counting."""
    return -F.log(1 - F.least(bits, F.lit(62)) / F.lit(63.0))


def main_text(page: str, roots: set[int], said: set[int], frame: set[int] = frozenset(), links: set[int] = frozenset()) -> str:
    """The page's main text, its blocks joined by blank lines.

    The template's own words go, and so do slots of links; a block's slot is
    the deepest path of the frame above it.  Of the rest, what lies in an
    article or main element is the text, if the template's roots lie there, or
    half of the root's unlinked text does, or a fifth where the element is in
    the frame.  Otherwise it is what lies in the
    deepest of the roots, without blocks that are links only; a page without
    template gives its article, or else all its unlinked blocks.
    """
    blocks, nodes = walk(page)
    inside = [n for n in nodes if n.path in roots]
    deepest = max(inside, key=lambda n: n.depth).path if inside else None
    # Each element's slot is the deepest one of the frame that holds it; parents come first.
    for n in nodes:
        n.slot = n if n.path in frame else getattr(n.parent, "slot", None)
        n.inside = deepest is None or n.path == deepest or getattr(n.parent, "inside", False)

    def prose(n: Node) -> bool:
        slot = getattr(n, "slot", None)
        return slot is None or slot.path not in links or slot.tag in CONTENT_TAGS

    blocks = [b for b in blocks if digest("text", b.text) not in said and prose(b.node)]
    rooted = [b for b in blocks if not b.linked and getattr(b.node, "inside", deepest is None)]
    content = [b for b in blocks if b.content]
    if content:
        held = sum(len(b.text) for b in content if not b.linked)
        framed = any(getattr(b.node, "slot", None) is not None and b.node.slot.article for b in content)
        within = any(n.path == deepest and n.article for n in inside) and any(b.node.inside for b in content)
        if deepest is None or within or (5 if framed else 2) * held >= sum(len(b.text) for b in rooted):
            return "\n\n".join(b.text for b in content)
    return "\n\n".join(b.text for b in rooted)


#: The columns of a template, in the order in which ``main_text`` takes them.
SETS = ("roots", "said", "frame", "links")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {n: batch.column(n) for n in batch.schema.names}
        texts = [main_text(p, *(set(x or ()) for x in sets)) for p, *sets in zip(*(cols[c].to_pylist() for c in ("html", *SETS)), strict=True)]
        keep = [n for n in batch.schema.names if n not in ("html", *SETS)]
        yield pa.RecordBatch.from_arrays([*(cols[n] for n in keep), pa.array(texts, pa.string())], names=[*keep, "text"])


BROADCAST_HOSTS = 20_000


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page: the key, url, text and n_chars (its code points).

    Templates are joined back by host: broadcast if the hosts are no more than
    ``BROADCAST_HOSTS``, by a shuffle with Spark's skew handling beyond.

    Edge cases: a null or empty page has the text ''; a null url or one
    without a host belongs to the host ''; a page of 100 MB is walked in one
    pass like any other; repeated rows give repeated rows; an empty table
    gives an empty one; further columns are dropped.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host.alias("host"))
    templates = cut(deduce(rows.select("host", F.col("page_id").cast("string").alias("page_id"), "html")).select("host", *SETS), "page-templates")
    small = templates.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = rows.join(F.broadcast(templates) if small else templates, "host", "left").select("page_id", "url", "html", *SETS)
    kind = dict(rows.dtypes)["page_id"]
    return joined.mapInArrow(_extract, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
