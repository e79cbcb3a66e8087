"""Reviewers' marks: codes, notes, privilege, redactions, suggestions, as new snapshots of their tables.

Nothing is changed in place: each function returns the whole table after the change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdocket.functions import norm
from sparkdocket.plans.numbering import number_rows
from sparkdocket.plans.staging import stage


def family_units(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Ids of the targets' units: the top item, its direct children, and the family of the top item."""
    t = items.join(targets.select("item_id").distinct(), "item_id", "left_semi")
    tops = t.select(F.coalesce("parent_item_id", "item_id").alias("item_id")).distinct()
    kids = items.join(tops.withColumnRenamed("item_id", "parent_item_id"), "parent_item_id", "left_semi").select("item_id")
    families = items.join(tops, "item_id", "left_semi").where("family_id IS NOT NULL").select("family_id").distinct()
    same = items.join(families, "family_id", "left_semi").select("item_id")
    ids = tops.union(kids).union(same).union(t.select("item_id")).distinct()
    return items.join(ids, "item_id", "left_semi").select("item_id")


def apply_codes(codes: DataFrame, targets: DataFrame, add: list[str], remove: list[str], single: dict[str, list[str]] | None = None) -> DataFrame:
    """``item_id, code`` after adding and removing codes on the targets.

    In a group of ``single`` an item has one code: an added one replaces its
    siblings.  Two added codes of one group, or a code both added and removed, are
    refused.
    """
    if both := set(add) & set(remove):
        raise ValueError(f"added and removed at once: {sorted(both)}")
    gone = set(remove)
    for name, members in (single or {}).items():
        mine = set(add) & set(members)
        if len(mine) > 1:
            raise ValueError(f"{sorted(mine)} exclude each other in {name}")
        if mine:
            gone |= set(members) - mine
    ids = targets.select("item_id").distinct()
    touched = codes.where(F.col("code").isin(sorted(gone))).join(ids, "item_id", "left_semi").select("item_id", "code").distinct()
    left = codes.select("item_id", "code").join(touched, ["item_id", "code"], "left_anti")
    added = ids.select("item_id", F.explode(F.array(*[F.lit(c) for c in add]).cast("array<string>")).alias("code"))
    return left.union(added).distinct()


def sync_privilege(privilege: DataFrame, codes: DataFrame, code: str = "privileged") -> DataFrame:
    """Privilege rows after coding: items that have the code get a row if they have none, others lose theirs."""
    ids = codes.where(F.col("code") == code).select("item_id").distinct()
    kept = privilege.join(ids, "item_id", "left_semi")
    fresh = ids.join(privilege, "item_id", "left_anti").select(
        "item_id", F.lit("asserted").alias("status"), F.lit(True).alias("withhold"), F.lit(True).alias("include_on_log"), F.lit("").alias("description")
    )
    return kept.select(*fresh.columns).union(fresh)


def upsert(table: DataFrame, updates: DataFrame, key: str, deleted: DataFrame | None = None) -> DataFrame:
    """Rows of a table with updates by key: what an update leaves null stays as it was; deleted keys go."""
    new = updates.select(key, *[F.col(c).alias(f"_{c}") for c in table.columns if c != key], F.lit(True).alias("_met"))
    both = table.withColumn("_had", F.lit(True)).join(new, key, "full")
    out = both.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in table.columns if c != key]).select(*table.columns)
    return out if deleted is None else out.join(deleted.select(key).distinct(), key, "left_anti")


def counts_by_item(table: DataFrame, name: str) -> DataFrame:
    return table.groupBy("item_id").agg(F.count(F.lit(1)).alias(name))


def redaction_state(redactions: DataFrame, texts: DataFrame) -> DataFrame:
    """Redactions with ``state``: stale where the text they were drawn on has changed or is gone.

    ``redactions`` has ``item_id, source_sha``; ``texts`` has ``item_id, text_sha``.
    """
    joined = redactions.join(texts.select("item_id", "text_sha"), "item_id", "left")
    return joined.withColumn("state", F.when(F.col("source_sha") == F.col("text_sha"), "active").otherwise("stale")).drop("text_sha")


def re_anchor(text: Column, quote: Column, before: Column, after: Column, start: Column, same_text: Column) -> Column:
    """Struct ``state, start`` of a mark on a text.

    In the same text with the quotation at its place it is active.  Else it is
    sought, white space collapsed, with exactly its neighbours; it moves if there is
    one such place, and is stale otherwise.  A moved start counts in the collapsed text.
    """
    t, whole = norm.collapse(text), norm.collapse(F.concat(before, quote, after))
    first = F.instr(t, whole)
    again = F.instr(F.substring(t, first + 1, F.length(t)), whole)
    at = first - 1 + F.length(norm.collapse(F.concat(before, F.lit("|")))) - 1
    here = same_text & (F.substring(text, start + 1, F.length(quote)) == quote)
    once = (F.length(whole) > 0) & (first > 0) & (again == 0)
    state = F.when(here, "active").when(once, "moved").otherwise("stale")
    return F.struct(state.alias("state"), F.when(here, start).when(once, at).alias("start"))


def resolve_suggestions(suggestions: DataFrame, texts: DataFrame) -> DataFrame:
    """``suggestion_id, item_id, code, outcome`` of pending suggestions.

    Of those for one item and code the latest counts, the others are superseded.  It
    is accepted if its quotation still occurs exactly once in the item's text.
    """
    from sparkdocket.operators.text import quote_occurrences

    latest = suggestions.groupBy("item_id", "code").agg(F.max("suggestion_id").alias("latest"))
    joined = suggestions.join(latest, ["item_id", "code"]).join(texts.select("item_id", "text"), "item_id", "left")
    n = quote_occurrences(F.coalesce("text", F.lit("")), F.col("quote"))
    outcome = F.when(F.col("suggestion_id") < F.col("latest"), "superseded").when(n == 1, "accepted").otherwise("unverified")
    return joined.select("suggestion_id", "item_id", "code", outcome.alias("outcome"))


def accept_suggestions(suggestions: DataFrame, texts: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolved suggestions with the places of their quotations, and the codes after the accepted ones.

    ``suggestions`` has ``suggestion_id, item_id, code, quote, start, end`` (bytes, or null).  Of
    those for one item and code the latest counts.  It is accepted if its quotation is
    matched in the item's text as it stands now; the place is that where it was found.
    """
    from sparkdocket.operators.spans import verify_citation

    latest = suggestions.groupBy("item_id", "code").agg(F.max("suggestion_id").alias("latest"))
    joined = suggestions.join(latest, ["item_id", "code"]).join(texts.select("item_id", "text"), "item_id", "left")
    checked = joined.withColumn("found", verify_citation(F.col("text"), F.col("quote"), F.col("start"), F.col("end")))
    matched = F.col("found.status") == "matched"
    outcome = F.when(F.col("suggestion_id") < F.col("latest"), "superseded").when(matched, "accepted").otherwise("unverified")
    place = lambda side: F.when(outcome == "accepted", F.col(f"found.{side}")).alias(side)
    resolved = stage(checked.select("suggestion_id", "item_id", "code", outcome.alias("outcome"), place("start"), place("end")), "suggestions").df
    return resolved, codes.select("item_id", "code").union(resolved.where("outcome = 'accepted'").select("item_id", "code")).distinct()


def privilege_log(items: DataFrame, privilege: DataFrame) -> DataFrame:
    """Rows of the privilege log in order (``seq``, by date, path and id): sender, recipients, subject and date of the parent where an item's own are blank."""
    fields = ["from_addr", "recipients", "subject"]
    on_log = privilege.where(F.col("include_on_log") & F.col("status").isin("asserted", "under_review", "partial_redaction"))
    parent = items.select(F.col("item_id").alias("parent_item_id"), *[F.col(c).alias(f"p_{c}") for c in fields], F.col("sent_at").alias("p_sent_at"))
    filled = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.nullif(F.trim(F.col(f"p_{c}")), F.lit(""))).alias(c)
    rows = items.join(on_log.select("item_id", F.col("status").alias("privilege_status"), "withhold", "description"), "item_id").join(parent, "parent_item_id", "left")
    rows = rows.select("item_id", "path", "privilege_status", "withhold", "description", *[filled(c) for c in fields], F.coalesce("sent_at", "p_sent_at").alias("sent_at"))
    return number_rows(rows, [F.col("sent_at").asc_nulls_last(), F.col("path"), F.col("item_id")], "seq")


def sample_coded(coded: DataFrame, seed: str, *, n: int | None = None, percent: float | None = None) -> DataFrame:
    """A seeded sample of coded items: a fixed number, or a share rounded up, at least one; a sampling operator.

    The latest coder of each item is carried.  The choice follows digests of the ids.
    """
    w = F.max(F.struct("coded_at", "coder"))["coder"]
    items = coded.groupBy("item_id").agg(w.alias("coder"))
    size = n if n is not None else max(1, -(-int(items.count() * percent * 1000) // 100_000))
    return items.orderBy(F.md5(F.concat(F.lit(seed), F.col("item_id").cast("string"))), "item_id").limit(size)


def sample_report(sample: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Counts of a checked sample by outcome (null: not yet checked)."""
    return sample.join(outcomes.select("item_id", "outcome"), "item_id", "left").groupBy("coder", "outcome").agg(F.count(F.lit(1)).alias("n"))


def conversation_page(conversations: DataFrame, after: tuple | None, limit: int) -> DataFrame:
    """The page after a cursor (last_at, conv_id), latest first, conversations without a date last: a page, so limited."""
    out = conversations
    if after is not None:
        last, conv = after
        if last is None:
            out = out.where(F.col("last_at").isNull() & (F.col("conv_id") > F.lit(conv)))
        else:
            out = out.where(F.col("last_at").isNull() | (F.col("last_at") < F.lit(last)) | ((F.col("last_at") == F.lit(last)) & (F.col("conv_id") > F.lit(conv))))
    return out.orderBy(F.col("last_at").desc_nulls_last(), "conv_id").limit(limit)


def stream_pages(messages: DataFrame, anchors: DataFrame, count: int, forward: bool) -> DataFrame:
    """For each anchor (``conv_id, anchor``) the next or previous ``count`` messages by position, numbered from 1.

    Positions may have gaps, and an anchor need not be a message's.  Messages and
    anchors are numbered together in one global order, so that a page is a range of
    numbers and no conversation is gathered.  Positions of a conversation are distinct.
    """
    points = messages.select("conv_id", "position", "item_id", F.lit(1).alias("is_message")).unionByName(
        anchors.select("conv_id", F.col("anchor").alias("position")).distinct().withColumns({"item_id": F.lit(None).cast(messages.schema["item_id"].dataType), "is_message": F.lit(0)})
    )
    # Forwards, a message at the anchor is behind it; backwards, before it.
    first = F.col("is_message").desc() if forward else F.col("is_message").asc()
    numbered = stage(number_rows(points, [F.col("conv_id"), F.col("position"), first], "number", F.col("is_message")), "pages").df
    step = F.explode(F.sequence(F.lit(1), F.lit(count))).alias("nth")
    wanted = numbered.where("is_message = 0").select("conv_id", F.col("position").alias("anchor"), "number", step)
    wanted = wanted.withColumn("number", F.col("number") + F.col("nth") if forward else F.col("number") - F.col("nth") + 1)
    return numbered.where("is_message = 1").join(wanted, ["conv_id", "number"]).select("conv_id", "anchor", "nth", "item_id")

