"""Publication dates: parsing, freshness verdicts and ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# Allowed windows, tolerated clock skew, reason codes, named zones (hours).
FRESHNESS_WINDOWS = (1, 3, 7, 14, 30)
FUTURE_TOLERANCE_DAYS = 1
DATE_REASONS = ("date_missing", "date_invalid", "date_stale", "date_future")
_ZONES = (
    ("+0000", "UT|UTC|GMT|Z"), ("-0500", "EST|CDT"), ("-0400", "EDT"), ("-0600", "CST|MDT"),
    ("-0700", "MST|PDT"), ("-0800", "PST"),
)
_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"

# Every step below is one replacement on the previous value, so the raw column is
# referenced a fixed, small number of times however far the optimizer inlines it.
# The usual spellings need none of the steps: _FULL_ISO is what the ISO steps lead to, _FULL_MAIL what most feeds send.
_FULL_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+\-]\d{2}:\d{2})\z"
_FULL_MAIL = (
    r"^[A-Za-z]{3,9}, (\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4} \d{2}:\d{2}:\d{2}) GMT\z"
)
_MAIL_STEPS = (
    (r"\s*\(.*\)\s*$|^\s+|\s+$", ""),                                 # comment, edges
    (r"(?i)^[a-z]{3,9}\s*,?\s+(?=\d)", ""),                            # weekday
    (rf"(?i)^(\d{{1,2}})[\s\-]+({_MONTHS})[a-z]*\.?[\s\-]+(\d+)\s+", "$1 $2 $3 "),
    (r"^(\d+ \D+ )(6[89]|[7-9]\d) ", "$119$2 "),                      # two-digit years
    (r"^(\d+ \D+ )(\d\d) ", "$120$2 "),
    (r"(?<=\d )(\d?\d:\d\d)(?!\d|:)", "$1:00"),                      # seconds
    *((rf"(?i)(?<=\d) ?(?:{names})$", f" {offset}") for offset, names in _ZONES),
    (r"(?<=:\d\d)(?: ?[A-Za-z]{1,5})?$", " +0000"),                    # unknown or no zone
    (r"(?<=:\d\d) *([+\-]\d{4})$", " $1"),
)
_ISO = (
    r"^\d{4}-?\d{2}-?\d{2}"
    r"(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d{1,9})?)?)?(?:Z|[+\-]\d{2}(?::?\d{2})?)?)?$"
)
_ISO_STEPS = (
    (r"^(\d{4})-?(\d{2})-?(\d{2})", "$1-$2-$3"),
    (r"(?<=^.{10})[T ]", "T"),
    (r"^(.{10})$", "$1T00:00:00"),
    (r"(T\d{2}):?(\d{2}):?(\d{2})", "$1:$2:$3"),
    (r"(T\d{2}):?(\d{2})(?![\d:])", "$1:$2:00"),
    (r"(T\d{2})(?![\d:])", "$1:00:00"),
    (r",", "."),
    (r"([+\-]\d{2}):?(\d{2})$", "$1:$2"),
    (r"(T.*[+\-]\d{2})$", "$1:00"),
    (r"(T[\d:.]+)$", "$1Z"),
)


def _apply(c: Column, steps) -> Column:
    for pattern, replacement in steps:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def published_timestamp(c) -> Column:
    """Mail-style or ISO date; no zone means UTC; anything else is NULL.

    A mail-style date names its month, so what is spelled as ISO never is one.
    """
    raw = _col(c)
    iso = F.when(raw.rlike(_FULL_ISO), raw).when(raw.rlike(_ISO), _apply(raw, _ISO_STEPS)).try_cast("timestamp")
    plain = F.when(raw.rlike(_FULL_MAIL), F.regexp_replace(raw, _FULL_MAIL, "$1 +0000")).otherwise(_apply(raw, _MAIL_STEPS))
    return F.when(raw.rlike(_ISO), iso).otherwise(F.try_to_timestamp(plain, F.lit("d MMM yyyy H:mm:ss xx")))


def published_rank(ts) -> Column:
    """Seconds since the epoch, 0 when the date is unknown."""
    return F.coalesce(F.unix_micros(_col(ts)) / F.lit(1e6), F.lit(0.0))


def date_reason(raw, ts, as_of, days: int | None) -> Column:
    """NULL for a fresh row, else one of ``DATE_REASONS``; both bounds pass."""
    if days is None:
        return F.lit(None).cast("string")
    if days not in FRESHNESS_WINDOWS:
        raise ValueError(f"freshness window must be one of {FRESHNESS_WINDOWS}")
    def reason(row):
        raw, ts = row["raw"], row["ts"]
        return (
            F.when(raw.isNull() | (raw == ""), "date_missing")
            .when(ts.isNull(), "date_invalid")
            .when(ts > as_of + F.expr(f"INTERVAL {FUTURE_TOLERANCE_DAYS} DAYS"), "date_future")
            .when(ts < as_of - F.expr(f"INTERVAL {days} DAYS"), "date_stale")
        )

    # bound once: a filter that gets the parsing of the date inlined would parse for every comparison
    both = F.array(F.struct(_col(raw).alias("raw"), _col(ts).alias("ts")))
    return F.get(F.transform(both, reason), F.lit(0))
