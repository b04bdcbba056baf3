"""URLs: extraction, normalisation, keys and tests on them. All are plain column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Absolute URL; group 1 is the host. Looser than parse_url, which gives null for many URLs in use.
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:\[\]@]*)(?::[^/?#\[\]]*)?(?:[/?#]|$)"
#: Scheme, authority, path, query, fragment.
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
#: Hosts that shorten links.
SHORTENERS = (
    "bit.ly", "buff.ly", "cutt.ly", "dlvr.it", "fb.me", "goo.gl", "is.gd", "lnkd.in", "ow.ly", "rb.gy", "rebrand.ly",
    "sans.org", "shorturl.at", "t.co", "tinyurl.com", "tiny.cc", "trib.al", "wp.me", "youtu.be",
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    """Without white space of any kind around; null stays."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def extract_urls(text: Column | str) -> Column:
    """FN-1: every http(s) URL in a text, in order; null gives none."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"""(?U)(https?://[^\s)\]>"']+)"""), F.lit(1))


def part(url: Column | str, group: int) -> Column:
    return F.regexp_extract(_c(url), PARTS, group)


def host(url: Column | str) -> Column:
    """Lower-case host, '' for what isn't an absolute URL; an IPv6 literal loses its brackets."""
    return F.lower(F.regexp_replace(F.regexp_extract(_c(url), URL, 1), r"^\[|\]$", ""))


def is_web(url: Column | str) -> Column:
    return _c(url).rlike("(?i)^https?://") & (host(url) != "")


def remove_dots(path: Column) -> Column:
    """Resolves . and .. segments of an absolute path."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(last.isin(".", "..") & (F.size(kept) > 0), F.concat(joined, F.lit("/"))).otherwise(joined)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for a row, also inside of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _base(base: Column | str | None) -> Column:
    b = F.coalesce(_c(base), F.lit("")) if base is not None else F.lit("")
    return F.struct(part(b, 1).alias("scheme"), part(b, 2).alias("authority"), part(b, 3).alias("path"))


def _resolve(url: Column, base: Column) -> Column:
    """FN-2 on a base that is split already."""
    site = F.concat(base["scheme"], F.lit("://"), base["authority"])
    folder = F.when(base["path"] == "", "/").otherwise(F.regexp_replace(base["path"], "[^/]*$", ""))

    def of(u: Column) -> Column:
        path, rest = F.regexp_extract(u, r"^([^?#]*)(.*)$", 1), F.regexp_extract(u, r"^([^?#]*)(.*)$", 2)
        dots = lambda p: F.when(F.contains(p, F.lit("/.")), remove_dots(p)).otherwise(p)
        return (
            F.when(u == "", "")
            .when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u)
            .when(base["scheme"] == "", "")
            .when(u.startswith("//"), F.concat(base["scheme"], F.lit(":"), u))
            .when(u.startswith("/"), F.concat(site, dots(path), rest))
            .when(path == "", F.concat(site, base["path"], rest))
            .otherwise(F.concat(site, dots(F.concat(folder, path)), rest))
        )

    trimmed = strip(F.coalesce(url, F.lit("")))
    return let(let(trimmed, of), lambda r: F.when(is_web(r), r).otherwise(""))


def normalize_url(url: Column | str, base: Column | str | None = None) -> Column:
    """FN-2: a usable absolute http(s) URL, resolved on ``base``; '' where there is none."""
    return let(_base(base), lambda b: _resolve(_c(url), b))


def add_urls(urls: Column | str, base: Column | str | None = None) -> Column:
    """FN-3: normalised, without the invalid and the repeated, in order."""
    return let(_base(base), lambda b: F.array_distinct(F.filter(F.transform(_c(urls), lambda u: _resolve(u, b)), lambda u: u != "")))


def build_hash(text: Column | str) -> Column:
    """FN-4."""
    return F.sha2(_c(text), 256)


def unique_id(urls: Column | str) -> Column:
    """FN-5: independent of the order of the URLs."""
    return build_hash(F.array_join(F.array_sort(_c(urls)), ","))


def in_domain(name: Column, domains: Iterable[str]) -> Column:
    """The host is one of the domains or below one."""
    domains = list(domains)
    return name.rlike("(^|\\.)(" + "|".join(d.replace(".", "\\.") for d in domains) + ")$") if domains else F.lit(False)


def is_shortened(url: Column | str) -> Column:
    """FN-6."""
    return in_domain(host(url), SHORTENERS)


def clean_candidate_url(url: Column | str) -> Column:
    """FN-7: without trailing prose punctuation; a closing bracket that the URL opened stays. '' if unusable."""
    text = strip(F.coalesce(_c(url), F.lit("")))
    # step by step from the end: one that isn't punctuation stops it, as does a bracket with a partner
    shorter = lambda u: F.when(
        u.rlike(r"\)$"), F.when(F.regexp_count(u, F.lit(r"\(")) >= F.regexp_count(u, F.lit(r"\)")), u).otherwise(F.regexp_replace(u, r"\)$", ""))
    ).otherwise(F.regexp_replace(u, r"[.,;:!?\]}']$", ""))
    most = F.char_length(F.regexp_extract(text, r"[.,;:!?)\]}']*$", 0))
    cleaned = F.when(most == 0, text).otherwise(F.aggregate(F.sequence(F.lit(0), most), text, lambda u, _: shorter(u)))
    return F.when(part(cleaned, 1).rlike("(?i)^https?$") & (part(cleaned, 2) != ""), cleaned).otherwise("")


def normalize_feed_url(url: Column | str) -> Column:
    """FN-8: the key of a feed: lower-case scheme and host, no fragment, at least the path /.

    Default ports and escapes stay as written.
    """
    u = strip(F.coalesce(_c(url), F.lit("")))
    scheme = F.lower(part(u, 1))
    path = F.when(part(u, 3) == "", "/").otherwise(part(u, 3))
    return F.when(u == "", "/").otherwise(F.concat(F.when(scheme != "", F.concat(scheme, F.lit("://"))).otherwise(""), F.lower(part(u, 2)), path, part(u, 4)))


def absolute_feed_url(url: Column | str) -> Column:
    """FN-9: the key of a feed that is added by hand: '' unless the URL is absolute http(s). Default ports are left out."""
    key = F.regexp_replace(normalize_feed_url(url), r"^(http://[^/?#]*):80(?=[/?#]|$)|^(https://[^/?#]*):443(?=[/?#]|$)", "$1$2")
    return F.when(F.coalesce(is_web(strip(url)), F.lit(False)), key).otherwise("")


def canonical_hostname(url: Column | str) -> Column:
    """FN-10: host without www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def normalize_content_url(url: Column | str) -> Column:
    """FN-10: without www., trailing slashes and fragment; also of a relative link."""
    u = strip(url)
    path = F.regexp_replace(part(u, 3), "/+$", "")
    whole = F.concat(F.lower(part(u, 1)), F.lit("://"), F.regexp_replace(F.lower(part(u, 2)), r"^www\.", ""), F.when(path == "", "/").otherwise(path), part(u, 4))
    relative = F.regexp_replace(F.regexp_replace(u, "(?s)#.*$", ""), r"(?s)^([^?]*?)/+(\?.*)?$", "$1$2")
    return F.when(part(u, 1) == "", F.when(relative == "", "/").otherwise(relative)).otherwise(whole)


def is_tag_url(url: Column | str) -> Column:
    """FN-23: a page that lists a tag."""
    return F.lower(F.regexp_replace(part(url, 3), "/+$", "")).rlike("^/tags(/|$)")


def host_matches(url: Column | str, keywords: Iterable[str]) -> Column:
    """FN-19: a keyword is part of the host name."""
    return _any(F.contains(host(url), F.lit(k)) for k in keyword_list(keywords))


def url_matches(url: Column | str, keywords: Iterable[str]) -> Column:
    """FN-20: a keyword is part of the URL."""
    return _any(F.contains(F.lower(_c(url)), F.lit(k)) for k in keyword_list(keywords))


def text_matches(text: Column | str, keywords: Iterable[str]) -> Column:
    """FN-21: a keyword is a whole word of the text, in any script."""
    words = keyword_list(keywords)
    quoted = "|".join("\\Q" + w + "\\E" for w in words)
    return F.coalesce(F.lower(_c(text)).rlike(f"(?U)(?<!\\w)({quoted})(?!\\w)"), F.lit(False)) if words else F.lit(False)


def keyword_list(keywords: Iterable[str]) -> list[str]:
    """FN-18: trimmed, lower-case, without blanks and what isn't text."""
    return [k.strip().lower() for k in keywords if isinstance(k, str) and k.strip()]


def _any(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def primary_link(urls: Column, direct_link: Column) -> Column:
    """FN-36: the first safe link by position, else the direct link if that is safe."""
    safe = lambda u: is_web(strip(u))
    return F.coalesce(F.try_element_at(F.filter(urls, safe), F.lit(1)), F.when(safe(direct_link), direct_link))


def host_label(url: Column | str) -> Column:
    """FN-39: host without www. for display."""
    return canonical_hostname(url)


def path_label(url: Column | str) -> Column:
    """FN-39: path and query for display, '' for the root."""
    label = F.concat(part(url, 3), part(url, 4))
    return F.when(label == "/", "").otherwise(label)


def subreddit_of(source: Column | str) -> Column:
    """FN-37: the name after /r/ in a source URL, null if there is none."""
    return F.nullif(F.regexp_extract(part(source, 3), "^/r/([^/]+)", 1), F.lit(""))


def clean_subreddit_name(name: Column | str) -> Column:
    """FN-11: without r/ and slashes around."""
    bare = F.regexp_replace(strip(F.coalesce(_c(name), F.lit(""))), "^/+", "")
    return F.regexp_replace(F.regexp_replace(bare, "^[rR]/", ""), "^/+|/+$", "")


def normalize_subreddit_name(name: Column | str) -> Column:
    """FN-11: the key of a subreddit."""
    return F.lower(clean_subreddit_name(name))


def valid_subreddit_name(name: Column | str) -> Column:
    return clean_subreddit_name(name).rlike("^[A-Za-z0-9_]{2,21}$")
