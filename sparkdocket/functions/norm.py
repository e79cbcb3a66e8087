"""Column functions that bring mail and file fields to a comparable form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses of items that analysis may use.
ANALYZABLE = ["extracted", "partial", "normalized"]


def message_id(c: Column) -> Column:
    """Trimmed, without angle brackets at the ends, lower case; blank is null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(F.trim(c), "^<+|>+$", ""))), F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def scan_subject(c: Column) -> Column:
    """Subject for the scan hash: reply prefixes without space before the colon are dropped, again and again."""
    return F.trim(F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)^(?:(?:re|fwd|fw):\s*+)++", "")))


def thread_subject(c: Column) -> Column:
    """Subject for threading: prefixes may have space before the colon."""
    return F.lower(F.trim(F.regexp_replace(collapse(F.coalesce(c, F.lit(""))), r"(?i)^(?:(?:re|fwd|fw)\s*+:\s*+)++", "")))


def strip_html(c: Column) -> Column:
    """Text without scripts, styles, comments and tags; the common entities decoded; space collapsed."""
    body = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(name), F.lit(char))
    return collapse(body)


def body_for_hash(c: Column) -> Column:
    """LF line ends, no zero-width characters, ends trimmed; null is empty."""
    text = F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return F.trim(F.translate(text, "​‌‍﻿", ""))


def recipients(c: Column) -> Column:
    """A display list split at semicolons; what stands in angle brackets where there is any."""
    inside = lambda x: F.when(x.rlike("<[^>]*>"), F.regexp_extract(x, "<([^>]*)>", 1)).otherwise(x)
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(inside(x))), lambda x: x != "")


def participant_kind(c: Column) -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    return (
        F.when(s.rlike(r"^[^@\s]+@[^@\s]+$"), "smtp").when(F.lower(s).rlike("^/o=|/cn="), "x500")
        .when(s.rlike(r"[A-Za-z]"), "display").otherwise("other")
    )


def participant_key(c: Column) -> Column:
    return F.lower(collapse(F.coalesce(c, F.lit(""))))


def filetime(c: Column) -> Column:
    """Timestamp of 100 ns ticks since 1601, whole seconds."""
    return F.timestamp_seconds(F.floor(c / F.lit(10_000_000)) - F.lit(11_644_473_600))


def parsed_time(c: Column) -> Column:
    """Timestamp of RFC 3339 text; without an offset UTC is meant, and what does not parse is null."""
    return F.try_to_timestamp(F.trim(c))


def control_number(prefix: str, number: Column, width: int) -> Column:
    """Prefix and a zero-padded number; numbers wider than ``width`` stay whole."""
    return F.concat(F.lit(prefix), F.format_string(f"%0{width}d", number.cast("long")))


def bytes_label(c: Column) -> Column:
    """B, KB with one decimal, MB and GB with two, at 1024."""
    return (
        F.when(c < 1024, F.format_string("%d B", c.cast("long")))
        .when(c < 1024**2, F.format_string("%.1f KB", F.round(c / 1024.0, 1)))
        .when(c < 1024**3, F.format_string("%.2f MB", F.round(c / 1024.0**2, 2)))
        .otherwise(F.format_string("%.2f GB", F.round(c / 1024.0**3, 2)))
    )


def mask_email(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 1), F.lit("***@"), F.substring_index(c, "@", -1))


def mask_tail(c: Column) -> Column:
    """All digits but the last four hidden."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.concat(F.lit("***"), F.right(digits, F.lit(4)))


def safe_path(c: Column) -> Column:
    """A logical path with ``.`` and empty parts dropped; null if it is absolute, has a
    drive, a parent step, a control character or a device name."""
    clean = F.array_join(F.filter(F.split(F.translate(c, "\\", "/"), "/"), lambda p: ~p.isin("", ".")), "/")
    bad = c.rlike(r"^[/\\]|^[A-Za-z]:|[\x00-\x1f]|(^|[/\\])\.\.([/\\]|$)|(?i)(^|[/\\])(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/\\]*)?([/\\]|$)")
    return F.when(~bad & (clean != ""), clean)


def scrub_paths(c: Column) -> Column:
    """Error text without directory names."""
    return F.regexp_replace(c, r"([A-Za-z]:)?(?:[/\\][^\s/\\:]++(?=[/\\]))++[/\\]", "…/")


def conversation_id(team: Column, channel: Column, day: Column, thread: Column) -> Column:
    part = lambda c: F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("unknown"))
    return F.sha2(F.concat_ws("\n", part(team), part(channel), part(day), F.coalesce(thread.cast("string"), F.lit(""))), 256)


def domain_of(c: Column) -> Column:
    return F.when(c.contains("@"), F.lower(F.substring_index(c, "@", -1)))
