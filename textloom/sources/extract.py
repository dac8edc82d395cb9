"""HTML, EPUB and tabular files as text. Pure functions of one document; readers.py applies them to DataFrames."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree

from textloom.functions.classes import STRIP

# Elements whose start begins a paragraph, whose content is not text, and that have no content.
BLOCKS = frozenset("address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section table ul".split())
SKIPPED = frozenset(("script", "style", "head", "template"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What may stand in a head; any other element, or text, ends one that is not closed.
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_SPACES = re.compile(f"[{re.escape(STRIP)}]+")
_AMPERSAND = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


class _Text(HTMLParser):
    """Collects paragraphs: a new one at the start of each block element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.paragraphs: list[list[str]] = [[]]
        self.skipping: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skipping == ["head"] and tag not in HEAD_ONLY and tag != "head":
            self.skipping.clear()
        if self.skipping:
            if tag in SKIPPED and self.skipping[-1] not in ("script", "style"):
                self.skipping.append(tag)
            return
        if tag in SKIPPED:
            self.skipping.append(tag)
        elif tag in BLOCKS:
            self.paragraphs.append([])
        elif tag == "br":
            self.paragraphs[-1].append(" ")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an HTML element
        if tag in ("script", "style"):
            self.set_cdata_mode(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skipping:
            del self.skipping[self.skipping.index(tag) :]
        elif not self.skipping and tag == "p":
            pass
        elif not self.skipping and tag == "br":
            self.paragraphs[-1].append(" ")

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.paragraphs[-1].append(data)


def _closed(m: re.Match) -> str:
    """A reference that ends with its semicolon as it is, any other ampersand as one that stands for itself."""
    own = m[1] or ""
    return m[0] if own[:1] == "#" or own in html5 else f"&amp;{own}"


def html_to_text(data: str | bytes, bare: bool = True) -> str:
    """The visible text: white space runs as one space, paragraphs joined by a blank line.

    bare: references without their semicolon, such as &amp before a tag, are characters
    too, as in HTML; else they stay as they are.
    """
    parser = _Text()
    text = data.decode("utf-8", "replace") if isinstance(data, bytes) else data
    parser.feed(text if bare else _AMPERSAND.sub(_closed, text))
    parser.close()
    paragraphs = (_SPACES.sub(" ", "".join(p)).strip(" ") for p in parser.paragraphs)
    return "\n\n".join(p for p in paragraphs if p)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def epub_to_text(data: bytes) -> str:
    """The spine's documents in order, joined by a blank line."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise ValueError("epub: not a readable archive") from None
    names = set(book.namelist())

    def tree(name: str, what: str) -> ElementTree.Element:
        if name not in names:
            raise ValueError(f"epub: the archive does not hold {name!r}, {what}")
        try:
            return ElementTree.fromstring(book.read(name))
        except ElementTree.ParseError as e:
            raise ValueError(f"epub: {name}: {e}") from None

    container = tree("META-INF/container.xml", "so it is not an EPUB")
    package = next((e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile" and e.get("full-path")), None)
    if not package:
        raise ValueError("epub: container.xml names no rootfile")
    opf = tree(package, "which its container names")
    items = {e.get("id"): e.get("href") for e in opf.iter() if _local(e.tag) == "item" and e.get("id") and e.get("href")}
    spine = next((e for e in opf.iter() if _local(e.tag) == "spine"), ())
    order = [posixpath.normpath(posixpath.join(posixpath.dirname(package), items[e.get("idref")])) for e in spine if _local(e.tag) == "itemref" and e.get("idref") in items]
    if not order:
        raise ValueError(f"epub: {package}: the spine names no documents")
    for name in order:
        if name not in names:
            raise ValueError(f"epub: the spine names {name!r}, which the archive does not hold")
    return "\n\n".join(t for t in (html_to_text(book.read(n)) for n in order) if t)


def table_rows(text: str, separator: str = ",") -> tuple[str, list[str]]:
    """(header, rows) of a CSV text: fields decoded and joined again by the separator. Fewer than two records have no rows."""
    records = []
    try:
        for row in csv.reader(io.StringIO(text, newline=""), delimiter=separator, strict=True):
            if row:
                records.append(separator.join(row).replace("\r\n", "\n"))
    except csv.Error as e:
        raise ValueError(f"csv: {e}") from None
    return (records[0], records[1:]) if len(records) > 1 else ("", [])
