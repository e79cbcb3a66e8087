"""Parsers of sources over files that Spark makes of the tables: what went in must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdocket.plans import items as adapt
from sparkdocket.sources import archives, chat


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def chat_html(spark, sf_dir):
    """A page per conversation; those of a multiple of seven have no root."""
    t = adapt.table(spark, sf_dir, "conversations")
    s = lambda c: F.col(c).cast("string")
    message = F.concat(
        F.lit('<div class="chat-message" data-id="m'), s("turn"), F.lit('" data-from="'), F.col("role"), F.lit('" data-sent="2024-01-02T03:04:05Z" data-thread="t'), s("conv_id"), F.lit('"><b>x</b><div class="body"><p>'), _escaped(F.col("text")),
        F.lit("</p></div>"), F.when(F.col("turn") == 1, '<ul class="reactions"><li>like <b>A</b></li></ul><ul class="attachments"><li>f.txt</li><li>g.txt</li></ul>').otherwise(""), F.lit("</div>"),
    )
    pages = t.where("text IS NOT NULL").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("h")))), lambda x: x["h"]), "\n").alias("inner"))
    root = F.when(F.col("conv_id") % 7 != 0, F.concat(F.lit('<div class="chat-conversation" data-team="T &amp; U" data-channel="c'), s("conv_id"), F.lit('" data-type="channel">'))).otherwise("<div>")
    out = chat.parse_chat_html(pages.select("conv_id", F.concat(F.lit("<html><body>"), root, "inner", F.lit("</div></body></html>")).alias("html")), "html", "conv_id")
    return out.select("conv_id", "pos", "message_id", "author", "thread_key", "team", "channel", F.md5("body").alias("body_md5"), "problem")


def chat_json(spark, sf_dir):
    """An array of messages per conversation, or an object with a team."""
    t = adapt.table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("content"), F.col("role").alias("sender")).alias("m")))), lambda x: x["m"])
    listed = t.groupBy("conv_id").agg(rows.alias("messages"))
    text = F.when(F.col("conv_id") % 2 == 0, F.to_json("messages")).otherwise(F.to_json(F.struct(F.lit("T").alias("team"), "messages")))
    return chat.parse_chat_json(listed.select("conv_id", text.alias("j")), "j", "conv_id").select("conv_id", "pos", "message_id", "author", "team", F.md5("body").alias("body_md5"))


def calendar_events(spark, sf_dir):
    """A calendar per order with an event per line: in UTC, a date alone, or without a zone."""
    li = adapt.table(spark, sf_dir, "lineitem")
    at = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(";VALUE=DATE:"), F.date_format("l_shipdate", "yyyyMMdd"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit(":"), F.date_format("l_shipdate", "yyyyMMdd'T'HHmmss"), F.lit("Z"))).otherwise(F.concat(F.lit(":"), F.date_format("l_shipdate", "yyyyMMdd'T'HHmmss")))
    event = F.concat(F.lit("BEGIN:VEVENT\r\nUID:"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")]), F.lit("\r\nSUMMARY:Ship\\, part\r\n  "), F.col("l_partkey").cast("string"), F.lit("\r\nDTSTART"), at, F.lit("\r\nATTENDEE;CN=S:mailto:S"), F.col("l_suppkey").cast("string"), F.lit("@X.example\r\nEND:VEVENT\r\n"))
    files = li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(event)), "").alias("t"))
    out = chat.parse_ics(files.select("l_orderkey", F.concat(F.lit("BEGIN:VCALENDAR\r\n"), "t", F.lit("END:VCALENDAR")).alias("t")), "t", "l_orderkey")
    return out.select("l_orderkey", "uid", "subject", "starts_at", "all_day", "unresolved", F.concat_ws(",", "attendees").alias("attendees"))


def zip_names(spark, sf_dir):
    """First words of documents as entry names: flagged UTF-8, or Latin-1 bytes without a flag."""
    d = adapt.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    name = F.substring_index("text", " ", 3)
    raw = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.encode(name, "UTF-8")).otherwise(F.encode(F.regexp_replace(name, "[^\\x00-\\x7f\\xa0-\\xff]", ""), "ISO-8859-1")).alias("raw"), (F.col("doc_id") % 2 == 0).alias("utf8"))
    return archives.decode_zip_names(raw, "raw", "utf8").select("doc_id", "name")


def chat_fields(spark, sf_dir):
    """Turns as mailbox messages in folders of team chats and of mail."""
    t = adapt.table(spark, sf_dir, "conversations")
    k = F.col("conv_id") % 4
    folder = F.when(k == 0, "Top/Team Chat/Red/general").when(k == 1, "Top/Team Chat/Blue").when(k == 2, "Top/Inbox")
    kind = F.when(F.col("turn") == 0, "IPM.SkypeTeams.Message").otherwise("IPM.Note")
    f = chat.chat_fields(kind, folder, F.lit("subject"), F.when(F.col("turn") == 1, " ").otherwise(F.col("text")), F.when(F.col("role") == "user", "Hint"), F.lit(None).cast("string"))
    return t.select("conv_id", "turn", f.alias("f")).select("conv_id", "turn", "f.is_chat", "f.team", "f.channel", F.md5("f.text").alias("text_md5"))


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_ORDER = "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1"
QUERIES = {"chat_html": chat_html, "chat_json": chat_json, "calendar_events": calendar_events, "zip_names": zip_names, "chat_fields": chat_fields}
ORACLE = {
    "chat_html": f"""SELECT conv_id, CAST({_ORDER} AS INT) AS pos, 'm' || turn AS message_id, role AS author, 't' || conv_id AS thread_key, 'T & U' AS team, 'c' || conv_id AS channel,
        md5({_FLAT} || CASE WHEN turn = 1 THEN chr(10) || 'like A' || chr(10) || 'f.txt' || chr(10) || 'g.txt' ELSE '' END) AS body_md5, NULL AS problem FROM conversations WHERE text IS NOT NULL AND conv_id % 7 <> 0
        UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no conversation' FROM conversations WHERE text IS NOT NULL AND conv_id % 7 = 0""",
    "chat_json": f"SELECT conv_id, CAST({_ORDER} AS INT) AS pos, 'm' || turn AS message_id, role AS author, CASE WHEN conv_id % 2 <> 0 THEN 'T' END AS team, md5(text) AS body_md5 FROM conversations WHERE text IS NOT NULL",
    "calendar_events": """SELECT l_orderkey, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS uid, 'Ship, part ' || l_partkey AS subject, CASE l_linenumber % 3 WHEN 0 THEN CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) WHEN 1 THEN CAST(l_shipdate AS TIMESTAMP) END AS starts_at,
        l_linenumber % 3 = 0 AS all_day, l_linenumber % 3 = 2 AS unresolved, 's' || l_suppkey || '@x.example' AS attendees FROM lineitem""",
    "zip_names": r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n ELSE regexp_replace(n, '[^\x00-\x7f\x{a0}-\x{ff}]', '', 'g') END AS name FROM (SELECT doc_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS n FROM documents WHERE text IS NOT NULL)",
    "chat_fields": """WITH m AS (SELECT *, conv_id % 4 IN (0, 1) OR turn = 0 AS c, CASE WHEN turn = 1 THEN NULL ELSE nullif(trim(text), '') END AS t FROM conversations)
        SELECT conv_id, turn, c AS is_chat, CASE WHEN c THEN CASE WHEN role = 'user' THEN 'Hint' WHEN conv_id % 4 = 0 THEN 'Red' WHEN conv_id % 4 = 1 THEN 'Blue' END END AS team, CASE WHEN conv_id % 4 = 0 THEN 'general' END AS channel, md5(coalesce(t, CASE WHEN c THEN 'subject' END)) AS text_md5 FROM m""",
}
