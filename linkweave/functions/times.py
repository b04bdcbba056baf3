"""Times. Every function that needs the present takes ``now`` as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import let, strip

#: Forms in which providers write dates, after ``tidy``.
FORMATS = (
    "yyyy-MM-dd['T'][ ]HH:mm[:ss][ ][XXX][XX][X]",
    "yyyyMMdd'T'HHmmss[XX][X]",
    "d MMM yyyy HH:mm[:ss][ ][XXX][XX][X]",
    "MMM d yyyy HH:mm[:ss][ ][XXX][XX][X]",
    "MMM d yyyy h:mm[:ss] a",
    "MMM d HH:mm:ss yyyy",
    "yyyy-MM-dd",
    "yyyy/M/d[ HH:mm[:ss]]",
    "d MMM yyyy",
    "MMM d yyyy",
)
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tidy(text: Column | str) -> Column:
    """A date without weekday and fraction of a second, its month in three letters, its year in four digits, zones as offsets.

    Zones named by letters other than UTC's stand for different offsets in different places; they are dropped.
    """
    steps = (
        (r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", ""),
        (r"(\d{1,2}:\d{2}:\d{2})[.,]\d+", "$1"),
        (rf"(?i)\b({MONTHS})[a-z]*\.?", "$1"),
        (r"^(\d{1,2})[ -]([A-Za-z]{3})[ -](\d{2,4})\b", "$1 $2 $3"),
        (r"^([A-Za-z]{3} \d{1,2})(?:st|nd|rd|th)?,\s*", "$1 "),
        (r"^(\d{1,2} [A-Za-z]{3}) ([0-6]\d) ", "$1 20$2 "),
        (r"^(\d{1,2} [A-Za-z]{3}) ([7-9]\d) ", "$1 19$2 "),
        (r"(?i)\s*\b(utc|gmt|ut|z)$", "+00:00"),
        (r"\s+\(?[A-Z]{3,5}\)?$", ""),
        (r"\s+", " "),
    )
    out = strip(text)
    for pattern, new in steps:
        out = F.regexp_replace(out, pattern, new)
    return out


def parse_date(text: Column | str) -> Column:
    """A provider's date to the second, without a zone in UTC; null if none of the formats fits."""
    return let(tidy(text), lambda t: F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in FORMATS)))


def provider_date(text: Column | str, now: Column) -> Column:
    """FN-12: unparseable dates are ``now``."""
    return F.coalesce(parse_date(text), now)


def epoch(seconds: Column | str) -> Column:
    """FN-13: to the second."""
    return F.timestamp_seconds(_c(seconds).cast("bigint"))


def clamp_future(moment: Column | str, now: Column, tolerance_s: int = 60) -> Column:
    """FN-14: what is later than now by more than the tolerance becomes now; null stays."""
    return F.when(_c(moment) > now + F.expr(f"INTERVAL {tolerance_s} SECONDS"), now).otherwise(_c(moment))


def contract_timestamp(text: Column | str) -> Column:
    """FN-15: ISO or plain, without a zone in UTC, cut to the second; null if invalid."""
    return F.date_trunc("second", parse_date(text))


def utc_iso(moment: Column | str) -> Column:
    """FN-16."""
    return F.date_format(_c(moment), "yyyy-MM-dd'T'HH:mm:ss'Z'")


#: Microsecond stamp and eight hex digits; the order of the ids is the order of arrival.
BATCH_ID = r"^(\d{8}T\d{12})Z-[0-9a-f]{8}$"


def batch_instant(batch_id: Column | str) -> Column:
    """FN-17: the instant in a batch id, null for other names."""
    return F.try_to_timestamp(F.regexp_extract(_c(batch_id), BATCH_ID, 1), F.lit("yyyyMMdd'T'HHmmssSSSSSS"))


def relative_age(moment: Column | str, now: Column) -> Column:
    """FN-38: 5s, 3m, 2h, 4d, 2w, 6mo, 1y."""
    s = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(_c(moment)), F.lit(0))
    steps = ((60, 1, "s"), (3600, 60, "m"), (86400, 3600, "h"), (7 * 86400, 86400, "d"), (30 * 86400, 7 * 86400, "w"), (365 * 86400, 30 * 86400, "mo"))
    out = F.concat(F.floor(s / (365 * 86400)).cast("string"), F.lit("y"))
    for below, unit, name in reversed(steps):
        out = F.when(s < below, F.concat(F.floor(s / unit).cast("string"), F.lit(name))).otherwise(out)
    return F.when(_c(moment).isNull(), None).otherwise(out)
