"""Production volumes: what is produced of each item, where, and the load file's lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdocket.operators.text import dat_line

# The load file's fields in order, and header aliases.
FIELDS = [
    "BEGBATES", "ENDBATES", "CONTROL_NUMBER", "ITEM_ID", "PARENT_ITEM_ID", "FAMILY_ID", "CUSTODIAN", "FILE_NAME", "FILE_EXT", "FILE_CATEGORY", "MIME_TYPE", "FILE_SIZE", "SHA256",
    "DATE_SENT", "DATE_RECEIVED", "DATE_CREATED", "FROM", "TO", "CC", "BCC", "SUBJECT", "NATIVE_PATH", "TEXT_PATH", "HAS_REDACTED_TEXT", "WITHHELD", "PROD_STATUS",
]
PROFILES = {
    "plain": {"dates": "yyyy-MM-dd'T'HH:mm:ss'Z'", "zone": "UTC", "headers": {}},
    "us_dates": {"dates": "MM/dd/yyyy", "zone": "America/New_York", "headers": {}},
    "aliases": {"dates": "yyyy-MM-dd'T'HH:mm:ss'Z'", "zone": "UTC", "headers": {"BEGBATES": "Bates Beg", "ENDBATES": "Bates End", "CONTROL_NUMBER": "Control Number", "FAMILY_ID": "Group Identifier", "NATIVE_PATH": "Native File", "TEXT_PATH": "Extracted Text"}},
}
# Extensions of MIME types that have one.
_OFFICE = "application/vnd.openxmlformats-officedocument."
_EXTENSION = {
    "message/rfc822": "eml", "application/pdf": "pdf", "text/plain": "txt", "text/html": "html", "image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg",
    "application/vnd.ms-outlook": "msg", "application/msi.outlook": "msg", "text/calendar": "ics", "application/ics": "ics",
    f"{_OFFICE}wordprocessingml.document": "docx", f"{_OFFICE}spreadsheetml.sheet": "xlsx", f"{_OFFICE}presentationml.presentation": "pptx",
}


def volume_of(index: Column, per_volume: int) -> Column:
    """Volume name of the item with a number from 0."""
    return F.concat(F.lit("VOL"), F.format_string("%03d", (F.floor(index / per_volume) + 1).cast("long")))


def extension(path: Column, mime: Column) -> Column:
    own = F.lower(F.trim(F.regexp_extract(F.coalesce(path, F.lit("")), r"[^/\\]*\.([^./\\]*)$", 1)))
    kind = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    by_mime = reduce(lambda acc, kv: F.when(kind == kv[0], kv[1]).otherwise(acc), _EXTENSION.items(), F.lit("bin"))
    return F.when(own.rlike("^[a-z0-9]{1,16}$"), own).otherwise(by_mime)


def email_like(category: Column, mime: Column, message_id: Column, sender: Column) -> Column:
    kind = F.lower(F.coalesce(mime, F.lit("")))
    return F.lower(F.coalesce(category, F.lit(""))).isin("email", "message", "mail") | kind.startswith("message/") | kind.contains("outlook") | message_id.isNotNull() | sender.isNotNull()


def resolve(items: DataFrame, synthesize_mail: bool = True) -> DataFrame:
    """Add ``native, text_source, fault`` to items.

    ``native``: the item's own file, a mail made of its fields, or none
    (``missing_native``).  ``text_source``: with redactions only the redacted text
    serves (``redacted_text_missing`` without one), else the text, else none.
    """
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    mail = email_like(F.col("file_category"), F.col("mime_type"), F.col("message_id"), F.col("from_addr"))
    native = F.when(has("native_sha256"), "file").when(F.lit(synthesize_mail) & mail, "mail")
    redacted = F.coalesce("redaction_count", F.lit(0)) > 0
    text = F.when(redacted, F.when(has("redacted_sha256"), "redacted")).when(has("text_sha256"), "text")
    fault = F.when(native.isNull(), "missing_native").when(redacted & ~has("redacted_sha256"), "redacted_text_missing")
    return items.withColumns({"native": native, "text_source": text, "fault": fault})


def load_date(at: Column, profile: str) -> Column:
    """A timestamp as the profile writes it; null is empty."""
    p = PROFILES[profile]
    return F.coalesce(F.date_format(F.from_utc_timestamp(at, p["zone"]), p["dates"]), F.lit(""))


def _encoded(values: list[Column]) -> tuple[Column, Column]:
    """A line of the load file and of its CSV twin."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return dat_line(values), F.concat_ws(",", *[quoted(v) for v in values])


def load_lines(rows: DataFrame, columns: dict[str, Column], profile: str = "plain", order: str = "seq") -> DataFrame:
    """``seq, line, csv``: line 0 has the headers and the byte order mark, then a line per row; ``csv`` is the twin.

    ``columns`` gives the value of each of FIELDS; those without are empty.
    """
    names = [PROFILES[profile]["headers"].get(f, f) for f in FIELDS]
    line, csv = _encoded([columns.get(f, F.lit("")) for f in FIELDS])
    body = rows.select(F.col(order).cast("long").alias("seq"), line.alias("line"), csv.alias("csv"))
    line, csv = _encoded([F.lit(n) for n in names])
    head = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("seq"), F.concat(F.lit("﻿"), line).alias("line"), csv.alias("csv"))
    return head.union(body)


def expand_for_production(items: DataFrame, base: DataFrame) -> DataFrame:
    """Ids of the base, its parents, whole families and the base's own children."""
    b = items.join(base.select("item_id").distinct(), "item_id", "left_semi")
    parents = b.where("parent_item_id IS NOT NULL").select(F.col("parent_item_id").alias("item_id"))
    family = items.join(b.where("family_id IS NOT NULL").select("family_id").distinct(), "family_id", "left_semi").select("item_id")
    kids = items.join(b.select(F.col("item_id").alias("parent_item_id")), "parent_item_id", "left_semi").select("item_id")
    ids = b.select("item_id").union(parents).union(family).union(kids).distinct()
    return items.join(ids, "item_id", "left_semi").select("item_id")


def made_mail(sender: Column, subject: Column, body: Column) -> Column:
    """A message of an item's fields, for mail that has no file of its own."""
    told = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")
    return F.concat(F.lit("From: "), told(sender), F.lit("\r\nSubject: "), told(subject), F.lit("\r\n\r\n"), F.coalesce(body, F.lit(""))).cast("binary")


def volume_rows(items: DataFrame, per_volume: int = 1000, profile: str = "plain") -> DataFrame:
    """What ``write_volumes`` writes of numbered items; items that have nothing to produce are left out (see ``volume_faults``).

    ``items`` has ``resolve``'s columns, ``seq`` (from 1), ``control_number``, ``subject``, and the contents:
    ``native_bytes``, ``text``, ``redacted_text``.  With redactions, only the redacted
    text is produced, in the message made of an item's fields too.
    """
    found = resolve(items).where(F.coalesce(F.col("fault") != "redacted_text_missing", F.lit(True)) & (F.col("native").isNotNull() | F.col("text_source").isNotNull()))
    body = F.when(F.col("text_source") == "redacted", F.col("redacted_text")).when(F.col("text_source") == "text", F.col("text"))
    native = F.when(F.col("native") == "file", F.col("native_bytes")).when(F.col("native") == "mail", made_mail(F.col("from_addr"), F.col("subject"), body))
    ext = F.when(F.col("native") == "mail", "eml").otherwise(extension(F.col("path"), F.col("mime_type")))
    v = found.select("*", volume_of(F.col("seq") - 1, per_volume).alias("volume"), native.alias("_native"), body.alias("_text"), ext.alias("_ext"))
    relative = lambda folder, has, e: F.when(has.isNotNull(), F.concat(F.col("volume"), F.lit(f"/{folder}/"), F.col("control_number"), F.lit("."), e)).otherwise("")
    status = F.when(F.col("_native").isNotNull() & F.col("_text").isNotNull(), "NATIVE_AND_TEXT").when(F.col("_native").isNotNull(), "NATIVE").otherwise("TEXT_ONLY")
    own = {
        "BEGBATES": F.col("control_number"), "ENDBATES": F.col("control_number"), "CONTROL_NUMBER": F.col("control_number"), "ITEM_ID": F.col("item_id"), "FILE_NAME": F.regexp_extract("path", r"([^/\\]*)$", 1),
        "FILE_EXT": F.when(F.col("_native").isNotNull(), F.col("_ext")), "FILE_CATEGORY": F.col("file_category"), "MIME_TYPE": F.col("mime_type"), "FILE_SIZE": F.octet_length("_native"), "SHA256": F.sha2("_native", 256),
        "FROM": F.col("from_addr"), "SUBJECT": F.col("subject"), "NATIVE_PATH": relative("NATIVES", F.col("_native"), F.col("_ext")), "TEXT_PATH": relative("TEXT", F.col("_text"), F.lit("txt")),
        "HAS_REDACTED_TEXT": F.when(F.col("text_source") == "redacted", "Y").otherwise("N"), "WITHHELD": F.lit("N"), "PROD_STATUS": status,
    }
    columns = {f: own.get(f, F.col(f.lower()) if f.lower() in items.columns else F.lit("")) for f in FIELDS}
    for date in ("SENT", "RECEIVED", "CREATED"):
        if f"{date.lower()}_at" in items.columns:
            columns[f"DATE_{date}"] = load_date(F.col(f"{date.lower()}_at"), profile)
    line, csv = _encoded(list(columns.values()))
    return v.select("volume", F.col("seq").cast("long").alias("seq"), F.col("control_number").alias("control"), F.col("_ext").alias("ext"), F.col("_native").alias("native"), F.col("_text").alias("text"), line.alias("line"), csv.alias("csv"))


def volume_faults(items: DataFrame) -> DataFrame:
    """``item_id, fault`` of numbered items that are not produced, or not wholly: with ``nothing_to_produce`` for those without any content."""
    r = resolve(items)
    fault = F.when(F.coalesce(F.col("fault") != "redacted_text_missing", F.lit(True)) & F.col("native").isNull() & F.col("text_source").isNull(), "nothing_to_produce").otherwise(F.col("fault"))
    return r.select("item_id", fault.alias("fault")).where("fault IS NOT NULL")


def produce_volumes(items: DataFrame, path: str, *, per_volume: int = 1000, profile: str = "plain", readme: str = "", overwrite: bool = False) -> None:
    """Write the volumes of numbered items (see ``volume_rows``)."""
    from sparkdocket.sources.volume import write_volumes

    heads = load_lines(items.limit(0), {}, profile).where("seq = 0").first()
    write_volumes(volume_rows(items, per_volume, profile), path, line=heads.line, csv=heads.csv, readme=readme, overwrite=overwrite)
