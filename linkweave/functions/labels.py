"""Labels, null rules and small text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import strip


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(text: Column | str) -> Column:
    """FN-40: null is ''."""
    return F.coalesce(_c(text), F.lit(""))


def to_null(text: Column | str) -> Column:
    """FN-40: '' is null."""
    return F.nullif(_c(text), F.lit(""))


def first_of(*texts: Column | str) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*(to_null(t) for t in texts))


def normalize_text(text: Column | str) -> Column:
    """FN-10: trimmed, lower-case, white space collapsed."""
    return F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " ")


def contains_literal(column: Column | str, term: str) -> Column:
    """FN-31: the term as it is, without wildcards, in any case. The term is trimmed and cut to 200 characters."""
    return F.coalesce(F.contains(F.lower(_c(column)), F.lit(term.strip()[:200].lower())), F.lit(False))


def status(enabled: Column | str, deleted_at: Column | str) -> Column:
    """FN-33."""
    return F.when(_c(deleted_at).isNotNull(), "removed").when(_c(enabled), "active").otherwise("disabled")


def health(deleted_at: Column | str, failures: Column | str, last_status: Column | str) -> Column:
    """FN-34."""
    bad = (F.coalesce(_c(failures), F.lit(0)) > 0) | (F.coalesce(_c(last_status), F.lit(0)) >= 400)
    return F.when(_c(deleted_at).isNotNull(), "removed").when(bad, "unhealthy").otherwise("healthy")


def health_detail(failures: Column | str, last_status: Column | str, last_error: Column | str) -> Column:
    """FN-34: what is known about a failing feed."""
    return F.concat_ws(
        " • ",
        F.when(_c(last_status).isNotNull(), F.concat(F.lit("HTTP "), _c(last_status).cast("string"))),
        F.when(_c(failures) > 0, F.concat(_c(failures).cast("string"), F.lit(" consecutive failures"))),
        to_null(last_error),
    )


def displayed_link(unshortened: Column | str, original: Column | str) -> Column:
    """FN-35: only null falls back, '' doesn't."""
    return F.coalesce(_c(unshortened), _c(original))


def exported_link(unshortened: Column | str, original: Column | str) -> Column:
    """SNK-4: null and '' fall back."""
    return first_of(unshortened, original)


def source_label(source_type: Column | str) -> Column:
    """FN-37."""
    t = _c(source_type)
    return F.when(t == "rss", "RSS").when(t == "reddit", "Reddit").when(t == "bluesky", "Bluesky").when(t == "mastodon", "Mastodon").otherwise(t)


def bluesky_source(handle: Column | str, did: Column | str) -> Column:
    """FN-27."""
    who = first_of(handle, did)
    return F.when(who.isNull(), "https://bsky.app").otherwise(F.concat(F.lit("https://bsky.app/profile/"), who))


def bluesky_link(handle: Column | str, did: Column | str, uri: Column | str) -> Column:
    """FN-27: '' without an author or a key."""
    key = to_null(F.element_at(F.split(clean(uri), "/", -1), -1))
    return F.coalesce(F.concat(F.lit("https://bsky.app/profile/"), first_of(handle, did), F.lit("/post/"), key), F.lit(""))


def reddit_fullname(name: Column | str, id_: Column | str) -> Column:
    """FN-28."""
    return F.coalesce(to_null(name), F.concat(F.lit("t3_"), to_null(id_)))
