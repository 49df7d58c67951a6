"""Text as columns: normalising, tokens, ids, timestamps, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_-]+"
#: How timestamps are shown to a reader.
SHOWN = "yyyy/MM/dd (E) HH:mm"


def normalize_text(c: Column) -> Column:
    """Lower case, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Words of letters, digits, underscores and hyphens, in order."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def sanitize_query(c: Column) -> Column:
    """The tokens joined by spaces; ``none`` if there are none."""
    return F.coalesce(F.nullif(F.array_join(tokens(c), " "), F.lit("")), F.lit("none"))


def speaker_name(c: Column, default: str = "user") -> Column:
    """The trimmed speaker; ``default`` for a blank one."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def stable_id(kind: str, *parts: Column) -> Column:
    """A deterministic id from a natural key."""
    return F.md5(F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts]))


def packed(c: Column) -> Column:
    """An id as bytes, for shuffles: hexadecimal digits of ``stable_id``, behind whatever prefix, take half the room; different for different ids."""
    tail = F.right(c, F.lit(32))
    hidden = F.concat(F.lit("01"), tail, F.hex(F.substring(c, F.lit(1), F.length(c) - 32)))
    return F.unhex(F.when(F.rlike(tail, F.lit("^[0-9a-f]{32}$")), hidden).otherwise(F.concat(F.lit("00"), F.hex(c))))


def unpacked(c: Column) -> Column:
    """The id of ``packed``."""
    rest = lambda at: F.decode(F.substring(c, at, (1 << 31) - 1), "utf-8")
    return F.when(F.hex(F.substring(c, 1, 1)) == "01", F.concat(rest(18), F.lower(F.hex(F.substring(c, 2, 16))))).otherwise(rest(2))


def has_id_prefix(c: Column, kind: str) -> Column:
    """True if an id was generated for ``kind`` by the prefix convention."""
    return F.startswith(c, F.lit(kind + "_"))


def shown_timestamp(c: Column) -> Column:
    return F.date_format(c, SHOWN)


def utc_seconds() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def slug(c: Column) -> Column:
    """Letters, digits, dots, hyphens and underscores; anything else becomes one underscore."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def sorted_json(c: Column) -> Column:
    """A map as JSON with sorted keys and without null values."""
    kept = F.map_filter(c, lambda _, v: v.isNotNull())
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def answer_text(c: Column) -> Column:
    """A reference answer as text: trimmed; empty if there is none."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def session_time(c: Column) -> Column:
    """A session's date in one of three forms; the current time if blank, an error if none fits.

    Forms: ``h:mm am on d Month, yyyy``, the same with a short month name, and ``yyyy-MM-dd``.
    Dots are dropped and runs of blanks count as one.
    """
    plain = F.upper(F.trim(F.regexp_replace(F.regexp_replace(c, r"\.", ""), r"\s+", " ")))
    spelled = F.initcap(F.regexp_replace(F.regexp_replace(plain, " ON ", " "), ",", ""))
    spelled = F.regexp_replace(F.regexp_replace(spelled, " Am ", " AM "), " Pm ", " PM ")
    found = F.coalesce(
        F.try_to_timestamp(spelled, F.lit("h:mm a d MMMM yyyy")),
        F.try_to_timestamp(spelled, F.lit("h:mm a d MMM yyyy")),
        F.try_to_timestamp(plain, F.lit("yyyy-MM-dd")),
    )
    wrong = F.raise_error(F.concat(F.lit("unknown session time: "), c)).cast("timestamp")
    return F.when(c.isNull() | (plain == ""), F.current_timestamp()).otherwise(F.coalesce(found, wrong))
