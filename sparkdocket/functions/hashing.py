"""Content digests of mail and files, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkdocket.functions import norm

#: First line of every logical digest; a change of rules changes it.
EMAIL_V1, FILE_V1 = "docket-email-1", "docket-file-1"


def _framed(*fields: Column) -> Column:
    """Each field with its length in bytes before it, so that fields cannot run together."""
    parts = []
    for f in fields:
        v = F.coalesce(f.cast("string"), F.lit(""))
        parts += [F.octet_length(v).cast("string"), F.lit(":"), v, F.lit("\n")]
    return F.concat(*parts)


def scan_hash(subject: Column, filetime: Column, sender: Column, body: Column, attachments: Column) -> Column:
    """Second-tier digest of a scanned message.

    ``attachments`` is an array of structs with name and size.  The body keeps the
    first 4096 bytes of its UTF-8 after white space other than the space is dropped.
    """
    text = F.substring(F.lower(F.regexp_replace(F.coalesce(body, F.lit("")), r"[\t\n\x0B\f\r]", "")).cast("binary"), 1, 4096)
    files = F.array_join(F.array_sort(F.transform(attachments, lambda a: F.concat(F.lower(a["name"]), F.lit(":"), a["size"].cast("string"), F.lit(";")))), "")
    raw = lambda c: F.coalesce(c.cast("string"), F.lit("")).cast("binary")
    bar = F.lit("|").cast("binary")
    return F.sha2(F.concat(raw(norm.scan_subject(subject)), bar, raw(filetime), bar, raw(F.lower(F.trim(sender))), bar, text, bar, raw(files)), 256)


def email_hash(mid: Column, subject: Column, sender: Column, to: Column, cc: Column, bcc: Column, sent: Column, received: Column, body: Column, attachments: Column) -> Column:
    """Logical digest of a message; address lists are arrays, times timestamps."""
    people = lambda a: F.array_join(F.array_sort(F.transform(a, lambda x: F.lower(F.trim(x)))), "\n")
    seconds = lambda t: F.unix_seconds(t).cast("string")
    text = norm.body_for_hash(F.when(body.rlike(r"(?i)<(html|body|p|div|br)\b"), norm.strip_html(body)).otherwise(body))
    files = F.array_join(F.array_sort(F.transform(attachments, lambda a: F.concat_ws("\t", F.lower(a["name"]), a["size"].cast("string"), a["digest"]))), "\n")
    return F.sha2(
        F.concat(F.lit(EMAIL_V1 + "\n"), _framed(norm.message_id(mid), norm.collapse(subject), F.lower(F.trim(sender)), people(to), people(cc), people(bcc), seconds(sent), seconds(received), text, files)), 256
    )


def file_hash(category: Column, title: Column, author: Column, created: Column, text: Column, children: Column) -> Column:
    """Logical digest of a file; ``children`` is an array of digests."""
    kids = F.array_join(F.array_sort(children), "\n")
    return F.sha2(F.concat(F.lit(FILE_V1 + "\n"), _framed(category, title, author, created, norm.body_for_hash(text), kids)), 256)


def mih(mid: Column) -> Column:
    """MD5 of the normalized message id."""
    return F.md5(norm.message_id(mid))
