"""SRC-14: feed bodies -> channels with their entries, whatever dialect, prefixes or mistakes they have.

A body is cut into tags and text in one pass and read by namespace, not by prefix. A tag that isn't closed or closes nothing does
no harm beyond its entry, and what comes before a body breaks off is kept. The root element says which dialect it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

#: Text, a CDATA section, what is skipped, or a tag: closing, name, attributes, closed at once.
TOKEN = re.compile(
    r"""([^<]+)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)|<\?.*?(?:\?>|\Z)|<![^<>]*>|<(/?)([A-Za-z_][^\s<>/"'=]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*?)(/?)>|<""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s"'=/]+)\s*=\s*("[^"]*"|'[^']*')""")
#: Namespaces by what they mean here, and the prefixes that stand for one if a feed doesn't say.
CORE = ("", "http://www.w3.org/2005/Atom", "http://purl.org/atom/ns#", "http://purl.org/rss/1.0/", "http://my.netscape.com/rdf/simple/0.9/", "http://backend.userland.com/rss2")
DUBLIN_CORE = ("http://purl.org/dc/elements/1.1/", "http://purl.org/dc/terms/")
USUAL = {"atom": CORE[1], "dc": DUBLIN_CORE[0], "dcterms": DUBLIN_CORE[1]}
ROOTS = ("rss", "RDF", "feed", "channel")
ENTRIES = ("item", "entry")
#: What has titles, links or dates of its own.
APART = ("image", "textinput", "textInput", "source", "author", "contributor", "content", "summary", "description", "encoded", "group")
#: Element -> the field that it fills.
FIELDS = {"title": "title", "link": "link", "guid": "guid", "pubDate": "published", "published": "published", "issued": "published", "updated": "updated", "modified": "updated", "date": "updated", "lastBuildDate": "updated"}
HTML_TYPES = ("text/html", "application/xhtml+xml", "html", "xhtml")


class Element:
    __slots__ = ("attributes", "base", "name", "spaces", "text")

    def __init__(self, name: str, attributes: dict[str, str], spaces: dict[str, str], base: str):
        self.name, self.attributes, self.spaces, self.base, self.text = name, attributes, spaces, base, []


def _joined(base: str, link: str) -> str:
    """``link`` on ``base``; as written if it can't be resolved."""
    try:
        return urljoin(base, link) if base else link
    except ValueError:
        return link


def _element(tag: str, raw: str, parent: Element | None) -> Element:
    """The element of a start tag; its name is local in the namespaces that count, else ``{}`` and the tag."""
    attributes = {k: unescape(v[1:-1]) for k, v in ATTRIBUTE.findall(raw)} if "=" in raw else {}
    spaces = parent.spaces if parent else {}
    own = {k.partition(":")[2]: v for k, v in attributes.items() if k == "xmlns" or k.startswith("xmlns:")}
    spaces = {**spaces, **own} if own else spaces
    prefix, _, local = tag.rpartition(":")
    space = spaces.get(prefix, USUAL.get(prefix, prefix))
    known = space in CORE or space in DUBLIN_CORE or local == "RDF" or (space.startswith("http") and not prefix and parent is None)
    base = _joined(parent.base if parent else "", attributes.get("xml:base", "")) or (parent.base if parent else "")
    return Element(local if known else f"{{}}{tag}", attributes, spaces, base)


def _take(record: dict, element: Element) -> None:
    """What a closed element says of the entry or channel that it is in."""
    text, field = "".join(element.text).strip(), FIELDS.get(element.name)
    if field == "link":
        rel, kind, href = (element.attributes.get(n) for n in ("rel", "type", "href"))
        if href is not None:
            href = _joined(element.base, href.strip())
            record["links"].append({"rel": rel, "type": kind, "href": href})
            if (rel or "alternate") == "alternate" and (kind or "text/html") in HTML_TYPES:
                record["link"] = href
        elif text:
            record["link"] = _joined(element.base, text)
    elif field == "guid":
        if element.attributes.get("isPermaLink", "true").lower() != "false":
            record["guid"] = _joined(element.base, text)
    elif field and (text or field != "title"):
        record.setdefault(field, text)


def _record() -> dict:
    return {"links": []}


def parse(body: str | None) -> dict | None:
    """``title, link, links, entries`` of a feed, null if it is none."""
    channel, entry, entries, stack, root = _record(), None, [], [], None
    for text, cdata, closing, tag, raw, empty in TOKEN.findall(body or ""):
        if text or cdata:
            if stack:
                stack[-1].text.append(cdata or unescape(text))
            continue
        if not tag:
            continue
        if not closing:
            element = _element(tag, raw, stack[-1] if stack else None)
            if root is None:
                if element.name not in ROOTS:
                    return None
                root = element.name
            if element.name in ENTRIES:
                while stack and stack[-1].name not in ROOTS:  # an entry before this one wasn't closed
                    stack.pop()
                entry = _record()
                entries.append(entry)
            if not empty:
                stack.append(element)
                continue
        else:
            local = tag.rpartition(":")[2]
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name.rpartition(":")[2].removeprefix("{}") == local), None)
            if at is None:
                continue
            element, left_open = stack[at], stack[at + 1 :]
            del stack[at + 1 :]
            for inner in left_open:
                if not any(x.name in APART for x in stack):
                    _take(channel if entry is None else entry, inner)
            stack.pop()
        if element.name in ENTRIES:
            entry = None
        elif not any(x.name in APART for x in stack):
            _take(channel if entry is None else entry, element)
    if root is None:
        return None
    as_entry = lambda e: {"title": e.get("title"), "link": e.get("link") or e.get("guid"), "published": e.get("published"), "updated": e.get("updated")}
    return {"title": channel.get("title"), "link": channel.get("link"), "links": channel["links"], "entries": [as_entry(e) for e in entries]}


LINK = "struct<rel:string,type:string,href:string>"
FEED = f"struct<title:string,link:string,links:array<{LINK}>,entries:array<struct<title:string,link:string,published:string,updated:string>>>"
_LINK = pa.struct([(n, pa.string()) for n in ("rel", "type", "href")])
_ENTRY = pa.struct([(n, pa.string()) for n in ("title", "link", "published", "updated")])
_FEED = pa.struct([("title", pa.string()), ("link", pa.string()), ("links", pa.list_(_LINK)), ("entries", pa.list_(_ENTRY))])


def parsed(bodies: DataFrame) -> DataFrame:
    """``feed_url, feed`` of ``bodies (feed_url, body)``; ``feed`` is null where the body is no feed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feeds = pa.array([parse(x) for x in batch.column("body").to_pylist()], _FEED)
            yield pa.RecordBatch.from_arrays([batch.column("feed_url"), feeds], ["feed_url", "feed"])

    return bodies.select("feed_url", "body").mapInArrow(run, f"feed_url string, feed {FEED}")
