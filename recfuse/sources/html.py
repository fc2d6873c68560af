"""HTML pages to element arrays.

One small parser runs per Arrow batch and only tokenises: each page becomes one row with its text
and its elements in document order. Selecting, cascading and reading fields is then array work in
the same row (``recfuse.operators.pages``), so no page is ever shuffled to be understood.

Element ``n`` sits at array position ``n + 1`` and its descendants follow it up to ``last``.
Texts are offsets into the page's two text forms: ``raw`` keeps white space, ``text`` joins the
stripped text nodes. Nested elements therefore share one copy of their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTS = ("n", "last", "parent", "r0", "rn", "s0", "sn")
TEXTS = ("tag", "cls", "testid", "href", "src", "time")
ELEMENT = "struct<" + ",".join([*(f"{c}:int" for c in INTS), *(f"{c}:string" for c in TEXTS)]) + ">"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))
#: Characters of pages whose elements a worker holds at a time; a longer page is held alone.
CHUNK_CHARS = 1 << 20


#: What stands between < and > in a plain page: a start tag with plain quoted attributes, an end tag, or the kind of the document.
PLAIN = re.compile(
    r"""([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z0-9_-]*="[^"&<>]*")*)[ \t\n]*|/([a-zA-Z][a-zA-Z0-9]*)|!(?:doctype|DOCTYPE)[^<>]*"""
)
ATTRIBUTE = re.compile(r'([a-zA-Z][a-zA-Z0-9_-]*)="([^"]*)"')
#: Tags that a worker remembers, and their length.
TAGS, TAG_CHARS = 1 << 14, 200
#: Elements whose content is no markup, or may not be.
OPAQUE = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp".split())


def _texts(tag: str, attributes) -> tuple:
    """TEXTS of a start tag."""
    get = dict(attributes).get
    return tag, get("class"), get("data-testid"), get("href"), get("src") or get("data-src"), get("datetime")


_known: dict[str, tuple[str, tuple] | None] = {}


def _plain_tag(inner: str) -> tuple[str, tuple] | None:
    """Name (of an end tag with its slash, empty for the kind of the document) and TEXTS of a plain tag; None of another one."""
    m = PLAIN.fullmatch(inner)
    if m is None or (m[1] and m[1].lower() in OPAQUE):
        return None
    if m[1]:
        tag = m[1].lower()
        out = tag, _texts(tag, [(k.lower(), v) for k, v in ATTRIBUTE.findall(m[2])])
    else:
        out = f"/{m[3].lower()}" if m[3] else "", ()
    if len(inner) <= TAG_CHARS:
        if len(_known) >= TAGS:
            _known.clear()
        _known[inner] = out
    return out


class _Elements(HTMLParser):
    """Appends one page's elements, as lists of INTS and TEXTS, to the rows of a chunk."""

    def __init__(self, rows: list[list]) -> None:
        super().__init__(convert_charrefs=True)
        self.rows, self.base = rows, len(rows)
        self.open: list[list] = []
        self.raw: list[str] = []
        self.text: list[str] = []
        self.raw_at = self.text_at = 0

    def read(self, html: str) -> tuple[str, str]:
        """Raw text and text of the page."""
        if not self._read_plain(html):
            self.feed(html)
            self.close()
        while self.open:
            self._close()
        return "".join(self.raw), "".join(self.text)

    def _read_plain(self, html: str) -> bool:
        """Read a page of plain tags, each of which is looked up as a whole."""
        rows, open_, raw, text, names = self.rows, self.open, self.raw, self.text, []
        n = raw_at = text_at = 0
        data, *pieces = html.split("<")
        pieces.reverse()
        while True:
            if data and not (names and names[-1] in HIDDEN):
                if "&" in data:
                    data = unescape(data)
                stripped = data.strip()
                raw.append(data)
                text.append(stripped)
                raw_at += len(data)
                text_at += len(stripped)
            if not pieces:
                break
            inner, ended, data = pieces.pop().partition(">")
            tag = _known.get(inner) or _plain_tag(inner)
            if not ended or tag is None:
                del rows[self.base :]
                self.open, self.raw, self.text, self.raw_at, self.text_at = [], [], [], 0, 0
                return False
            name, texts = tag
            if texts:
                element = [n, n, open_[-1][0] if open_ else -1, raw_at, 0, text_at, 0, *texts]
                rows.append(element)
                n += 1
                if name not in VOID:
                    open_.append(element)
                    names.append(name)
            elif name and name[1:] in names:
                name = name[1:]
                while True:
                    element = open_.pop()
                    element[1], element[4], element[6] = n - 1, raw_at - element[3], text_at - element[5]
                    if names.pop() == name:
                        break
        self.raw_at, self.text_at = raw_at, text_at
        return True

    def handle_starttag(self, tag, attrs):
        element = [len(self.rows) - self.base, 0, self.open[-1][0] if self.open else -1, self.raw_at, 0, self.text_at, 0, *_texts(tag, attrs)]
        self.rows.append(element)
        self.open.append(element)
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def handle_endtag(self, tag):
        if any(e[7] == tag for e in self.open):
            while self._close() != tag:
                pass

    def handle_data(self, data):
        if self.open and self.open[-1][7] in HIDDEN:
            return
        stripped = data.strip()
        self.raw.append(data)
        self.text.append(stripped)
        self.raw_at += len(data)
        self.text_at += len(stripped)

    def _close(self) -> str:
        element = self.open.pop()
        element[1] = len(self.rows) - 1 - self.base
        element[4] = self.raw_at - element[3]
        element[6] = self.text_at - element[5]
        return element[7]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with the pages in them, a megabyte or a page each."""
    html, start, held, size = batch.column("html"), 0, [], 0
    for i in range(batch.num_rows):
        page = html[i].as_py()
        if held and size + len(page or "") > CHUNK_CHARS:
            yield batch.slice(start, len(held)), held
            start, held, size = i, [], 0
        held.append(page)
        size += len(page or "")
    if held:
        yield batch.slice(start, len(held)), held


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, pages in (c for b in batches for c in _chunks(b)):
        rows: list[list] = []
        raw, text, offsets = [], [], [0]
        for html in pages:
            r, t = _Elements(rows).read(html or "")
            raw.append(r)
            text.append(t)
            offsets.append(len(rows))
        columns = list(zip(*rows)) or [()] * len((*INTS, *TEXTS))
        fields = [pa.array(v, pa.int32() if c in INTS else pa.string()) for c, v in zip((*INTS, *TEXTS), columns, strict=True)]
        els = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, [*INTS, *TEXTS]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(raw, pa.string()), pa.array(text, pa.string()), els],
            ["page_id", "url", "raw", "text", "els"],
        )


def parse_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (page_id, url, raw, text, els) for a table of pages."""
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    id_type = source.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(_tokenise, f"page_id {id_type}, url string, raw string, text string, els array<{ELEMENT}>")


def inside(e: Column, base: Column | None = None) -> Column:
    """Descendants of an element, in document order; ``base`` is the root of the subtree that the columns hold."""
    first = e["n"] if base is None else e["n"] - base["n"]
    return F.slice("els", first + 2, e["last"] - e["n"])


def subtree(e: Column) -> Column:
    """An element as a page of its own (raw, text, els): it and its descendants, places as they were.

    Elements are numbered in document order, so a subtree is a slice, which is not built anew; its root
    is element 0, from which ``inside``, ``text_of`` and ``raw_of`` count when they get it as ``base``.
    """
    return F.struct(raw_of(e).alias("raw"), text_of(e).alias("text"), F.slice("els", e["n"] + 1, e["last"] - e["n"] + 1).alias("els"))


def root() -> Column:
    """The root of a subtree whose columns are raw, text and els."""
    return F.get("els", F.lit(0))


def children(e: Column) -> Column:
    return F.filter(inside(e), lambda d: d["parent"] == e["n"])


def text_of(e: Column, base: Column | None = None) -> Column:
    return F.substring("text", (e["s0"] if base is None else e["s0"] - base["s0"]) + 1, e["sn"])


def raw_of(e: Column, base: Column | None = None) -> Column:
    return F.substring("raw", (e["r0"] if base is None else e["r0"] - base["r0"]) + 1, e["rn"])


def tagged(*tags: str):
    return lambda e: e["tag"].isin(*tags)


def class_has(part: str):
    """Class attribute contains the text, anywhere."""
    return lambda e: F.coalesce(F.contains(e["cls"], F.lit(part)), F.lit(False))


def class_is(name: str):
    """One of the element's classes is this name."""
    return lambda e: F.coalesce(F.array_contains(F.split(e["cls"], r"\s+"), name), F.lit(False))


def first(elements: Column) -> Column:
    return F.try_element_at(elements, F.lit(1))
