"""HTML: a status' texts and links, feed discovery."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .urls import normalize_url, strip


#: Tags without a meaning of their own for a status' text; an anchor's tag is the other one that occurs.
PLAIN_TAGS = "p|br|span|strong|em|b|i|u|s|del|code|pre|blockquote|ul|ol|li|h[1-6]"
#: Character references that a column expression reads; the ampersand's is the last, so nothing is read twice.
PLAIN_REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}
#: A tag, a reference or a run of other characters, each of a form that can only be read in one way.
PLAIN_TOKEN = rf"""(?i)</?(?:a|{PLAIN_TAGS})(?:\s+[a-z][a-z0-9-]*="(?:[^"<>&]|{"|".join(PLAIN_REFERENCES)}){{0,2000}}+"){{0,9}}\s*>|<br\s*/>|{"|".join(PLAIN_REFERENCES)}|[^<>&]+"""


def _decoded(text: Column) -> Column:
    for reference, char in PLAIN_REFERENCES.items():
        text = F.replace(text, F.lit(reference), F.lit(char))
    return text


def is_plain(content: Column) -> Column:
    """A fragment whose every character belongs to a ``PLAIN_TOKEN``, whose anchors are closed, not nested and have one link at most, and
    whose text doesn't spell out further references."""
    anchors = F.lower(F.array_join(F.regexp_extract_all(content, F.lit(r"(?i)<(/?a)[\s>]"), F.lit(1)), ""))
    text = F.regexp_replace(content, "<[^>]*>", " ")
    return (
        (F.regexp_replace(content, PLAIN_TOKEN, "") == "")
        & (F.replace(anchors, F.lit("a/a"), F.lit("")) == "")
        & ~content.rlike(r"(?i)<a(?=\s)[^>]*\shref=[^>]*\shref=|</[^>]*\s")
        & ~text.rlike("&amp;[A-Za-z0-9#]")
    )


def _text(content: Column) -> Column:
    """The pieces between tags, decoded, without white space around and joined by spaces."""
    return F.array_join(F.filter(F.transform(F.split(content, "<[^>]*>"), lambda x: strip(_decoded(x))), lambda x: x != ""), " ")


def plain_parts(content: Column) -> Column:
    """FN-22 of a plain fragment: a struct of text, links of anchors and text outside of anchors."""
    links = F.transform(F.regexp_extract_all(content, F.lit(r"""(?is)<a(?=\s)[^>]*?\shref="([^"]*)\""""), F.lit(1)), _decoded)
    outside = F.regexp_replace(content, r"(?is)<a[\s>].*?</a>", "<a>")
    return F.struct(_text(content).alias("text"), F.filter(links, lambda x: x != "").alias("links"), _text(outside).alias("outside"))


#: A character reference with its semicolon, and an ampersand that begins none.
FINISHED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
UNFINISHED = re.compile(f"&(?!{FINISHED.pattern[1:]})")


def unescape_finished(text: str) -> str:
    """The standard library's ``unescape``, but a reference without its semicolon, as where a text is cut, stays as it is."""
    return FINISHED.sub(lambda m: unescape(m[0]), text)


class _Events(HTMLParser):
    """What the standard library's lenient parser meets in a document: (+1, attributes) or (-1, None) for an anchor, (0, text) for text."""

    def __init__(self, document: str):
        super().__init__()
        self.met = []
        self.feed(document)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.met += [(1, attrs)] * (tag == "a")

    def handle_endtag(self, tag):
        self.met += [(-1, None)] * (tag == "a")

    def handle_data(self, data):
        self.met.append((0, data))


def parse_status(content: str | None, finished: bool = False) -> tuple[str, list[str], str]:
    """FN-22 of any fragment, however broken: (text, links of anchors, text outside of anchors).

    An anchor that isn't closed lasts to the end, a closing tag without an anchor means nothing, and references are read twice in texts.
    ``finished``: references without their semicolon are text; browsers and the standard library read some of them.
    """
    if finished and UNFINISHED.search(content or ""):
        # the parser has no such option: while it reads, another character stands for these ampersands
        mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in content and f"{ord(c)}" not in content and f"{ord(c):x}" not in content.lower())
        text, links, outside = parse_status(UNFINISHED.sub(mark, content), True)
        return text.replace(mark, "&"), [x.replace(mark, "&") for x in links], outside.replace(mark, "&")
    met = _Events(content or "").met
    depths = list(accumulate((step for step, _ in met), lambda depth, step: max(0, depth + step), initial=0))[1:]
    texts = [(what.strip(), depth) for (step, what), depth in zip(met, depths) if step == 0]
    said = lambda pieces: (unescape_finished if finished else unescape)(" ".join(filter(None, pieces)))
    hrefs = (dict(what).get("href") for step, what in met if step == 1)
    return said(text for text, _ in texts), [h for h in hrefs if h], said(text for text, depth in texts if depth == 0)


PARTS = T.StructType([T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StringType())), T.StructField("outside", T.StringType())])


def _odd_parts(finished: bool):
    @F.pandas_udf(PARTS)
    def parts_of(content: pd.Series) -> pd.DataFrame:
        parts = [(None, None, None) if c is None else parse_status(c, finished) for c in content]
        return pd.DataFrame(parts, columns=["text", "links", "outside"])

    return parts_of


def status_parts(df: DataFrame, content: str, name: str = "parts", finished: bool = False) -> DataFrame:
    """FN-22: ``df`` with a struct of text, links and outside text; a null fragment is an empty one.

    Fragments as servers write them are read by column expressions; the text of the others alone goes to a parser, in Arrow batches.
    ``finished``: see ``parse_status``.
    """
    given = df.withColumn("_content", F.coalesce(F.col(content), F.lit(""))).withColumn("_plain", is_plain(F.col("_content")))
    given = given.withColumn("_odd", _odd_parts(finished)(F.when(~F.col("_plain"), F.col("_content"))))
    return given.withColumn(name, F.when(F.col("_plain"), plain_parts(F.col("_content"))).otherwise(F.col("_odd"))).drop("_content", "_plain", "_odd")


def anchor_hrefs(html: Column | str) -> Column:
    """The href of every anchor, as written."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def title(html: Column | str) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


#: The types by which a page names its feeds.
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/feed+json")
#: Character references that occur in links.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&#x2F;": "/", "&#38;": "&", "&amp;": "&"}


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or bare; '' if it has none."""
    value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    for reference, char in REFERENCES.items():
        value = F.replace(value, F.lit(reference), F.lit(char))
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


#: What a page says but doesn't mark up: comments, scripts and styles, the last to the page's end if nothing closes it.
UNSEEN = r"(?is)<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)"


def discovered_feed(html: Column | str, base: Column | str) -> Column:
    """FN-30: the first RSS feed that a page names, else its first feed of any type, resolved on the page's URL; '' if none.

    Links inside of comments, scripts and styles don't count.
    """
    html = F.regexp_replace(html, UNSEEN, " ")
    tags = F.regexp_extract_all(html, F.lit(r"""(?is)(<link\s(?:"[^"]*"|'[^']*'|[^"'>])*>)"""), F.lit(1))
    links = F.transform(tags, lambda x: F.struct(attribute(x, "href").alias("href"), F.lower(attribute(x, "type")).alias("type"), F.split(F.lower(attribute(x, "rel")), r"\s+").alias("rel")))
    feeds = F.filter(links, lambda x: (x["href"] != "") & F.array_contains(x["rel"], "alternate") & x["type"].isin(*FEED_TYPES))
    first = F.coalesce(F.try_element_at(F.filter(feeds, lambda x: x["type"] == FEED_TYPES[0]), F.lit(1)), F.try_element_at(feeds, F.lit(1)))
    return normalize_url(F.coalesce(first["href"], F.lit("")), base)


def site_link(link: Column, links: Column) -> Column:
    """FN-29: the channel's link, else its first alternate HTML link; null if neither is http(s).

    ``links``: array of structs with rel, type and href.
    """
    web = lambda x: strip(x).rlike("^https?://")
    fits = lambda x: F.coalesce(x["rel"], F.lit("")).isin("", "alternate") & (F.coalesce(x["type"], F.lit("")).rlike("^(text/html.*)?$")) & F.coalesce(web(x["href"]), F.lit(False))
    other = F.try_element_at(F.filter(links, fits), F.lit(1))["href"]
    return strip(F.coalesce(F.when(web(link), link), other))
