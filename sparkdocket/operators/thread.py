"""Conversation threading: header graph, subject, conversation index, singletons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdocket.functions import norm
from sparkdocket.operators.graph import connected_components


def references(c):
    """Message ids of a References header in order, normalized, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("<[^<>]+>"), F.lit(0)), norm.message_id))


def unfold(c):
    """A header's value on one line: a line end before white space is none."""
    return F.regexp_replace(c, r"\r?\n[ \t]+", " ")


def header(block, name: str):
    """The first value of a header in a block of folded headers; null without one."""
    value = F.regexp_extract(F.concat(F.lit("\n"), unfold(block)), rf"(?i)\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.nullif(F.trim(value), F.lit(""))


def parse_references(c):
    """Message ids between angle brackets of a folded References header in order, normalized, each once; blank ones are dropped."""
    found = F.transform(F.regexp_extract_all(unfold(F.coalesce(c, F.lit(""))), F.lit("<([^>]*)>"), F.lit(1)), norm.message_id)
    return F.array_distinct(F.array_compact(found))


def parse_in_reply_to(c):
    """The first id between angle brackets of an In-Reply-To header, else its whole value; blank is null."""
    return F.coalesce(F.get(parse_references(c), F.lit(0)), norm.message_id(F.trim(unfold(c))))


def conversation_index(c):
    """Lower-case hexadecimal of a Thread-Index header (base64, white space ignored); null if it is none."""
    code = F.regexp_replace(c, r"\s+", "")
    good = code.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(code) % 4 == 0)
    return F.when(good, F.lower(F.hex(F.unbase64(code))))


def index_parent(hexadecimal):
    """The conversation index of the message replied to: that without its last block of five bytes; null for the first 22 bytes alone."""
    return F.when(F.length(hexadecimal) > 44, F.substring(hexadecimal, F.lit(1), F.greatest(F.lit(44), F.length(hexadecimal) - 10)))


def thread_headers(messages: DataFrame, key: str, block: str) -> DataFrame:
    """``key, mid, in_reply_to, refs, conv_index, index_parent`` from blocks of raw headers, as ``thread_items`` takes them."""
    b = F.col(block)
    index = conversation_index(header(b, "thread-index"))
    return messages.select(key, norm.message_id(header(b, "message-id")).alias("mid"), parse_in_reply_to(header(b, "in-reply-to")).alias("in_reply_to"), parse_references(header(b, "references")).alias("refs"), index.alias("conv_index"), index_parent(index).alias("index_parent"))


def thread_items(messages: DataFrame) -> DataFrame:
    """Thread of each top-level message: ``item_id, thread_id, thread_method``.

    ``messages`` has ``item_id, mid, in_reply_to, refs array<string>, subject,
    conv_index`` with normalized ids.  Ids that are referred to but absent still
    connect.  Methods in order: headers (a component with two or more messages or
    with a header edge), subject (two or more unassigned messages with one
    subject), index (first 44 hexadecimal digits), singleton.
    """
    m = messages.select("item_id", "mid", "in_reply_to", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"), "subject", "conv_index")
    row = F.concat(F.lit("row:"), F.col("item_id").cast("string"))
    own = F.coalesce(F.concat(F.lit("mid:"), "mid"), row)
    others = F.array_compact(F.concat(F.array("in_reply_to"), F.col("refs")))
    edges = m.select(own.alias("src"), F.explode(F.transform(others, lambda x: F.concat(F.lit("mid:"), x))).alias("dst"))
    parts = connected_components(edges.where("src <> dst"))
    placed = m.withColumn("vertex", own).join(parts, "vertex", "left").withColumn("part", F.coalesce("component", "vertex"))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("least"), F.max((F.size(others) > 0).cast("int")).alias("linked"))
    by_head = placed.join(sizes, "part").withColumn("headed", (F.col("n") >= 2) | (F.col("linked") == 1))
    head_id = F.sha2(F.concat(F.lit("head:"), F.coalesce("least", "part")), 256)
    base = by_head.select("item_id", "mid", "subject", "conv_index", F.when(F.col("headed"), head_id).alias("head_id"))
    subject = F.nullif(norm.thread_subject(F.col("subject")), F.lit(""))
    base = base.withColumn("subj", F.when(F.col("head_id").isNull(), subject))
    subjects = base.where("subj IS NOT NULL").groupBy("subj").agg(F.count(F.lit(1)).alias("s_n")).where("s_n > 1")
    base = base.join(subjects, "subj", "left").withColumn("ix", F.when(F.col("head_id").isNull() & F.col("s_n").isNull(), F.nullif(F.lower(F.substring("conv_index", 1, 44)), F.lit(""))))
    indexes = base.where("ix IS NOT NULL").groupBy("ix").agg(F.count(F.lit(1)).alias("i_n")).where("i_n > 1")
    out = base.join(indexes, "ix", "left")
    method = F.when(F.col("head_id").isNotNull(), "headers").when(F.col("s_n").isNotNull(), "subject").when(F.col("i_n").isNotNull(), "index").otherwise("singleton")
    tid = (
        F.when(method == "headers", F.col("head_id")).when(method == "subject", F.sha2(F.concat(F.lit("subject:"), "subj"), 256))
        .when(method == "index", F.sha2(F.concat(F.lit("index:"), "ix"), 256)).otherwise(F.sha2(F.concat(F.lit("single:"), F.coalesce("mid", F.col("item_id").cast("string"))), 256))
    )
    return out.select("item_id", tid.alias("thread_id"), method.alias("thread_method"))


def inherit(children: DataFrame, threads: DataFrame) -> DataFrame:
    """Attachments take their parent's thread."""
    return children.join(threads.withColumnRenamed("item_id", "parent_item_id"), "parent_item_id").select("item_id", "thread_id", "thread_method")
