"""Chat exports in JSON, calendars, and packages, parsed where Spark has read the bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdocket.functions import norm

_MESSAGE = "id string, body string, content string, text string, `from` string, sender string, timestamp string, sentDateTime string, team string, channel string, chatType string"


def parse_chat_json(df: DataFrame, json_col: str, key: str) -> DataFrame:
    """One row per message of a JSON array, or of an object's messages, items or value.

    Fields have aliases; team and channel of the root stand in for missing ones;
    a row with neither body nor id is skipped; markup in a body is stripped.
    """
    listed = F.from_json(F.col(json_col), f"array<struct<{_MESSAGE.replace(' string', ':string')}>>")
    shape = ", ".join(f"{n}:array<struct<{_MESSAGE.replace(' string', ':string')}>>" for n in ("messages", "items", "value"))
    root = F.from_json(F.col(json_col), f"struct<{shape},team:string,channel:string>")
    base = df.select(F.col(key), root.alias("root"), F.when(F.trim(json_col).startswith("["), listed).alias("listed"))
    rows = base.select(key, F.col("root.team").alias("t0"), F.col("root.channel").alias("c0"), F.posexplode(F.coalesce("listed", "root.messages", "root.items", "root.value")).alias("pos", "m"))
    body = F.coalesce("m.body", "m.content", "m.text")
    out = rows.select(
        key, "pos", F.col("m.id").alias("message_id"), F.coalesce("m.from", "m.sender").alias("author"), F.coalesce("m.timestamp", "m.sentDateTime").alias("sent_raw"),
        F.coalesce("m.team", "t0").alias("team"), F.coalesce("m.channel", "c0").alias("channel"), F.when(body.rlike("<[a-zA-Z/!]"), norm.strip_html(body)).otherwise(body).alias("body"),
    )
    return out.where("body IS NOT NULL OR message_id IS NOT NULL").withColumn("sent_at", norm.parsed_time(F.col("sent_raw")))


MOST_MESSAGES = 50_000


def parse_chat_html(df: DataFrame, html_col: str, key: str) -> DataFrame:
    """One row per message of an exported conversation page, or one row with its ``problem``.

    The page's root has class ``chat-conversation`` with ``data-team``,
    ``data-channel`` and ``data-type``; a message is a block of class
    ``chat-message`` with ``data-id``, ``data-from``, ``data-sent`` and
    ``data-thread``, a part of class ``body``, and lists of class ``reactions`` and
    ``attachments``, whose entries are lines after the text.  Tags go.  A page
    without root or messages, or with more than ``MOST_MESSAGES``, is a problem.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    pieces = F.split(html, r'<div class="chat-message"', -1)
    root = F.regexp_extract(F.col("pieces")[0], r'<div class="chat-conversation"([^>]*)>', 1)
    attribute = lambda c, n: F.nullif(norm.strip_html(F.regexp_extract(c, rf'data-{n}="([^"]*)"', 1)), F.lit(""))
    entries = lambda c, n: F.transform(F.regexp_extract_all(F.regexp_extract(c, rf'(?s)<ul class="{n}">(.*?)</ul>', 1), F.lit("(?s)<li>(.*?)</li>"), F.lit(1)), norm.strip_html)
    base = df.select(key, html.contains('class="chat-conversation"').alias("rooted"), pieces.alias("pieces")).withColumn("n", F.size("pieces") - 1)
    problem = F.when(~F.col("rooted"), "no conversation").when(F.col("n") == 0, "no messages").when(F.col("n") > MOST_MESSAGES, "too many messages")
    base = base.withColumns({"problem": problem, "team": attribute(root, "team"), "channel": attribute(root, "channel"), "chat_type": attribute(root, "type")})
    m = F.col("m")
    body = norm.strip_html(F.regexp_extract(m, r'(?s)<div class="body">(.*?)</div>', 1))
    rows = base.where("problem IS NULL").select(key, "team", "channel", "chat_type", F.posexplode(F.slice("pieces", F.lit(2), F.col("n"))).alias("pos", "m"))
    good = rows.select(
        key, "pos", attribute(m, "id").alias("message_id"), attribute(m, "from").alias("author"), attribute(m, "sent").alias("sent_raw"), attribute(m, "thread").alias("thread_key"), "team", "channel", "chat_type",
        F.array_join(F.concat(F.array(body), entries(m, "reactions"), entries(m, "attachments")), "\n").alias("body"), F.lit(None).cast("string").alias("problem"),
    )
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in good.schema.fields if f.name not in (key, "problem")]
    bad = base.where("problem IS NOT NULL").select(key, *empty, "problem")
    return good.unionByName(bad)


def chat_fields(message_class: Column, folder: Column, subject: Column, text: Column, team: Column, channel: Column) -> Column:
    """Struct ``is_chat, team, channel, text`` of a mailbox message.

    A message is chat by its class or its folder; team and channel are the given
    hints, else the folders after one whose name has "team chat"; text falls back to
    the subject.
    """
    steps = F.split(F.coalesce(folder, F.lit("")), "/")
    at = F.array_position(F.transform(steps, lambda s: F.lower(s).contains("team chat")), True)
    named = lambda n: F.when(at > 0, F.nullif(F.trim(F.try_element_at(steps, (at + n).cast("int"))), F.lit("")))
    is_chat = F.lower(F.coalesce(message_class, F.lit(""))).rlike("skypeteams|\\.chat") | (at > 0)
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    pick = lambda c: F.when(is_chat, c)
    return F.struct(is_chat.alias("is_chat"), pick(F.coalesce(blank(team), named(1))).alias("team"), pick(F.coalesce(blank(channel), named(2))).alias("channel"), F.coalesce(blank(text), pick(blank(subject))).alias("text"))


def day_bucket(t: Column) -> Column:
    return F.coalesce(F.date_format(t, "yyyy-MM-dd"), F.lit("unknown"))


def parse_ics(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """One row per VEVENT: uid, summary, location, start and end, all-day and unresolved flags, attendees.

    UTC times are read; a date alone is midnight UTC and all-day; a floating time or
    one with a zone name that Spark does not know stays null and is unresolved.
    """
    unfolded = F.regexp_replace(F.regexp_replace(text_col, "\r\n?", "\n"), "\n[ \t]", "")
    events = F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))
    e = df.select(key, F.posexplode(events).alias("ordinal", "e"))
    get = lambda name, group=2: F.nullif(F.regexp_extract("e", rf"(?m)^{name}((?:;[^:\n]*)?):(.*)$", group), F.lit(""))
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\,"), F.lit(",")), F.lit("\\;"), F.lit(";"))

    def when(name: str) -> Column:
        raw, zone = get(name), F.regexp_extract(F.coalesce(get(name, 1), F.lit("")), "TZID=([^;]+)", 1)
        stamp = F.try_to_timestamp(F.regexp_replace(raw, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss"))
        known = zone.rlike("^[A-Z][A-Za-z_]+/[A-Za-z_/-]+$")
        return (
            F.when(raw.rlike("^[0-9]{8}$"), F.try_to_timestamp(raw, F.lit("yyyyMMdd"))).when(raw.endswith("Z"), stamp)
            .when(known, F.try_to_timestamp(F.concat(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.lit(" "), zone)))
        )

    start = when("DTSTART")
    return e.select(
        key, "ordinal", get("UID").alias("uid"), plain(get("SUMMARY")).alias("subject"), plain(get("LOCATION")).alias("location"), start.alias("starts_at"), when("DTEND").alias("ends_at"),
        get("DTSTART").rlike("^[0-9]{8}$").alias("all_day"), (get("DTSTART").isNotNull() & start.isNull()).alias("unresolved"), get("RRULE").alias("rrule"),
        F.transform(F.regexp_extract_all("e", F.lit(r"(?mi)^ATTENDEE[^:\n]*:mailto:(.*)$"), F.lit(1)), lambda x: F.lower(F.trim(x))).alias("attendees"),
    )


def detect_packages(files: DataFrame) -> DataFrame:
    """Kind of each directory or file of a listing with a ``path`` column: mailbox, archive, export package or raw."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    top = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), name.alias("name"))
    has = lambda cond: F.bool_or(cond).cast("int")
    sums = top.groupBy("folder").agg(
        has(F.col("name").endswith(".pst")).alias("pst"), has(F.col("name").endswith(".zip")).alias("zip"),
        (has(F.col("name").contains("summary")) + has(F.col("name").contains("manifest")) + has(F.col("name").contains("results")) + has(F.col("name").endswith(".pst") | F.col("name").endswith(".zip"))).alias("signals"),
    )
    kind = F.when((F.col("signals") >= 2) & (F.col("pst") + F.col("zip") > 0), "package").when(F.col("pst") == 1, "mailbox").when(F.col("zip") == 1, "archive").otherwise("raw")
    return sums.select("folder", kind.alias("kind"))
