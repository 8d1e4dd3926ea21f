"""Blocks of web pages and book chapters: headings, paragraphs, list items, quotes and captions, with their place."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values. Elements that are blocks, elements without narration, elements without content, and what a new element closes.
KINDS = {
    **dict.fromkeys("p pre dt dd td th".split(), "paragraph"), "li": "list_item", "blockquote": "blockquote", "figcaption": "caption", "caption": "caption",
    **{f"h{k}": "heading" for k in range(1, 7)},
}
SKIPPED = frozenset("script style svg math template nav video audio image".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
ENDS_P = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table div section article figure form main header footer aside nav hr".split())
HOLDS = frozenset("ul ol dl table body html".split())
NAMED = re.compile(r"&([A-Za-z][A-Za-z0-9]+);")
BLOCK = "href string, block_index int, kind string, heading_level int, path string, text string"


class _Element:
    __slots__ = ("blocks", "counts", "has_block", "name", "path", "quoted", "skipped", "texts")

    def __init__(self, name: str, path: str, texts: int, quoted: bool, skipped: bool) -> None:
        self.name, self.path, self.texts, self.quoted, self.skipped = name, path, texts, quoted, skipped
        self.counts: dict[str, int] = {}
        self.blocks: list[tuple] = []
        self.has_block = False


class _Walk(HTMLParser):
    """Collects blocks: an element that is a block and has no block right inside it, with all the text in it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [_Element("html", "/html", 0, False, False)]
        self.texts: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            if tag == "body" and self.open[-1].path == "/html":
                self.open.append(_Element("body", "/html/body", len(self.texts), False, False))
            return
        self._close_for(tag)
        above = self.open[-1]
        above.counts[tag] = above.counts.get(tag, 0) + 1
        above.has_block |= tag in KINDS
        path = f"{above.path}/{tag}[{above.counts[tag]}]"
        if tag == "br" and not above.skipped:
            self.texts.append("\n")
        elif tag == "img" and not above.skipped:
            told = dict(attrs)
            alt = unicodedata.normalize("NFC", (told.get("alt") or "").strip()).strip()
            if alt and (told.get("role") or "").casefold() != "presentation":
                above.blocks.append(("caption", None, path, alt))
        if tag not in VOID:
            self.open.append(_Element(tag, path, len(self.texts), above.quoted or above.name == "blockquote", above.skipped or tag in SKIPPED))

    def _close_for(self, tag: str) -> None:
        closed = (*CLOSED_BY.get(tag, ()), *(("p",) if tag in ENDS_P else ()))
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in closed:
                self._close(k)
                return
            if self.open[k].name in HOLDS or len(self.open) - k > 50:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].name == tag:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        if not self.open[-1].skipped:
            self.texts.append(data)

    def _close(self, to: int) -> None:
        while len(self.open) > to:
            e = self.open.pop()
            kind = KINDS.get(e.name)
            if kind and not e.has_block and not e.skipped:
                text = unicodedata.normalize("NFC", "".join(self.texts[e.texts :])).strip()
                kind = "blockquote" if e.quoted and kind == "paragraph" else kind
                e.blocks = [(kind, int(e.name[1]) if kind == "heading" else None, e.path, text)] if text else []
            self.open[-1].blocks += e.blocks

    def blocks(self, page: str) -> list[tuple]:
        self.feed(page)
        self.close()
        self._close(1)
        return self.open[0].blocks


def blocks_of(page: str | None) -> list[tuple]:
    """(kind, heading level, path, text) of a page's blocks in their order; a page that declares entities has none."""
    return [] if not page or "<!ENTITY" in page[:8000].upper() else _Walk().blocks(page)


def _job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(href, k, *b) for href, page in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, b in enumerate(blocks_of(page))]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["href", "block_index", "kind", "heading_level", "path", "text"])


def html_blocks(pages: DataFrame, href: str = "url", page: str = "html") -> DataFrame:
    """One row per block of each page: href, block_index, kind, heading_level, path, text."""
    return pages.select(F.col(href).cast("string"), page).mapInArrow(_job, BLOCK)


def expand_entities(text: Column) -> Column:
    """Named character references replaced, but for the five of XML; null if the text declares entities of its own."""

    def job(texts: pa.Array) -> pa.Array:
        keep = {"amp", "lt", "gt", "quot", "apos"}
        said = lambda m: m[0] if m[1] in keep else html.entities.html5.get(m[1] + ";", m[0])
        return pa.array([None if t is None or "<!ENTITY" in t[:8000].upper() else NAMED.sub(said, t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(job, "string")(text)


def resolve_href(base: Column, href: Column) -> Column:
    """A relative reference as a path from the root; null if it is empty or leads out of it."""
    raw = F.trim(F.url_decode(F.regexp_replace(F.regexp_replace(F.regexp_extract(href, "^[^#?]*", 0), r"\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25")))
    whole = F.when(raw.startswith("/"), F.substring(raw, 2, 1 << 30)).when(base != "", F.concat(base, F.lit("/"), raw)).otherwise(raw)
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        parts = F.when(part.isin("", "."), acc["parts"]).when(up, F.slice(acc["parts"], F.lit(1), F.greatest(F.size(acc["parts"]) - 1, F.lit(0)))).otherwise(F.concat(acc["parts"], F.array(part)))
        return F.struct(parts.alias("parts"), (acc["out"] | (up & (F.size(acc["parts"]) == 0))).alias("out"))

    walked = F.aggregate(F.split(whole, "/"), start, step)
    return F.when((raw != "") & ~walked["out"] & (F.size(walked["parts"]) > 0), F.array_join(walked["parts"], "/"))


def detect_format(path: Column, content: Column) -> Column:
    """struct<format, error> of a file by its first bytes and its suffix, which must not disagree."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    by_suffix = F.when(suffix == ".epub", "epub").when(suffix == ".pdf", "pdf").when(suffix.isin(".mobi", ".prc"), "mobi").when(suffix.isin(".azw3", ".kf8"), "azw3").when(suffix == ".azw", "azw")
    head = F.substring(content, 1, 512).cast("binary")
    start = lambda n: F.hex(F.substring(head, 1, n))
    pdf = F.regexp_replace(F.hex(head), "^(?:EFBBBF|20|09|0D|0A)*", "").startswith("25504446")
    palm = F.hex(F.substring(head, 61, 8)).isin("424F4F4B4D4F4249", "5445587452454164")
    # The first member of a book's archive is its type, stored as it is.
    zipped = start(4).isin("504B0304", "504B0506", "504B0708") & ((suffix == ".epub") | F.hex(head).contains("6D696D65747970656170706C69636174696F6E2F657075622B7A6970"))
    by_magic = F.when(pdf, "pdf").when(palm, F.when(by_suffix.isin("azw3", "azw"), by_suffix).otherwise("mobi")).when(zipped, "epub")
    error = F.when(by_magic != by_suffix, "conflict").when(F.coalesce(by_magic, by_suffix).isNull(), "unknown")
    return F.struct(F.when(error.isNull(), F.coalesce(by_magic, by_suffix)).alias("format"), error.alias("error"))
