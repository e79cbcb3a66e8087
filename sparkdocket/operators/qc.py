"""Quality rules over a selection, their severities, the gate, and privilege consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default severity of each rule.
SEVERITY = {
    "orphan_child": "error", "incomplete_parent": "warn", "withheld": "error", "withheld_relative": "warn", "redacted_text_missing": "error", "native_missing": "error",
    "text_missing": "warn", "needs_ocr": "warn", "zero_size": "warn", "bad_status": "warn", "empty_selection": "error", "only_withheld": "error",
}
PACKS = {
    "default": {},
    "strict_privilege": {"incomplete_parent": "error", "withheld": "error", "withheld_relative": "error"},
    "native_heavy": {"native_missing": "error", "zero_size": "error"},
}
_TEXTUAL = ["email", "document", "spreadsheet", "presentation", "pdf"]


def findings(items: DataFrame, selection: DataFrame | Column, pack: str = "default", overrides: dict | None = None) -> DataFrame:
    """``rule, item_id, severity`` for every rule that a selected item breaks.

    ``items`` has ``item_id`` (unique), ``parent_item_id, file_category, status, size_bytes,
    withheld, has_native, has_text, needs_ocr, redaction_count, redacted_ok``.  The selection
    is a table of ``item_id`` or a condition on the items.  Rules about the whole selection
    have a null item.  What children and parents say of each other comes from one join of
    the two.
    """
    level = SEVERITY | PACKS[pack] | (overrides or {})
    if isinstance(selection, DataFrame):
        items = items.join(selection.select("item_id", F.lit(True).alias("_in")).distinct(), "item_id", "left")
        selection = F.col("_in")
    withheld = F.coalesce(F.col("withheld"), F.lit(False))
    marked = items.withColumns({"_in": F.coalesce(selection, F.lit(False)), "_held": withheld})
    chosen = marked.where("_in")
    own = F.array_compact(
        F.array(
            F.when(withheld, "withheld"),
            F.when((F.coalesce("redaction_count", F.lit(0)) > 0) & ~F.coalesce("redacted_ok", F.lit(False)), "redacted_text_missing"),
            F.when(~F.coalesce("has_native", F.lit(False)) & (F.coalesce("file_category", F.lit("")) != "email"), "native_missing"),
            F.when(~F.coalesce("has_text", F.lit(False)), F.when(F.col("file_category").isin(_TEXTUAL), "text_missing!").otherwise("text_missing")),
            F.when(F.coalesce("needs_ocr", F.lit(False)), "needs_ocr"),
            F.when(F.col("size_bytes") == 0, "zero_size"),
            F.when(F.col("status").isin("error", "partial"), "bad_status"),
        )
    )
    plain = chosen.select("item_id", F.explode(own).alias("rule"))
    # A parent that is neither selected nor withheld says as much as one that is missing.
    kids = marked.where("parent_item_id IS NOT NULL").select("parent_item_id", F.col("item_id").alias("kid"), F.monotonically_increasing_id().alias("kid_row"), F.col("_in").alias("kid_in"), F.col("_held").alias("kid_held"))
    parents = marked.where("_in OR _held").select("item_id", F.col("_in").alias("up_in"), F.col("_held").alias("up_held"))
    both = kids.join(parents, F.col("parent_item_id") == F.col("item_id"), "left").na.fill(False, ["up_in", "up_held"])
    kid_in, kid_held, up_in, up_held = (F.col(c) for c in ("kid_in", "kid_held", "up_in", "up_held"))
    # An orphan is told once a row, also where ids repeat; the others once an item, whatever its relatives.
    said = lambda cond, rule, item, row=None: F.when(cond, F.struct(F.col(item).alias("item_id"), F.lit(rule).alias("rule"), (F.col(row) if row else F.lit(None).cast("long")).alias("row")))
    told = F.array_compact(
        F.array(
            said(kid_in & ~up_in, "orphan_child", "kid", "kid_row"),
            said(up_in & ~kid_in & ~kid_held, "incomplete_parent", "parent_item_id"),
            said(kid_in & ~kid_held & up_held, "withheld_relative", "kid"),
            said(up_in & ~up_held & kid_held, "withheld_relative", "parent_item_id"),
        )
    )
    related = both.select(F.explode(told).alias("t")).select("t.*").distinct().drop("row")
    whole = chosen.agg(F.count(F.lit(1)).alias("n"), F.count_if(~withheld).alias("open")).select(
        F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.when(F.col("n") == 0, "empty_selection").when(F.col("open") == 0, "only_withheld").alias("rule")
    )
    every = plain.union(related).union(whole.where("rule IS NOT NULL"))
    severity = F.lit(None).cast("string")
    for rule, s in level.items():
        severity = F.when(F.col("rule") == rule, s).otherwise(severity)
    # A missing text is an error for textual kinds unless the rule is off.
    severity = F.when(F.col("rule") == "text_missing!", "off" if level["text_missing"] == "off" else "error").otherwise(severity)
    return every.select(F.regexp_replace("rule", "!$", "").alias("rule"), "item_id", severity.alias("severity")).where("severity <> 'off'")


def gate(found: DataFrame) -> DataFrame:
    """One row: errors, warnings, and whether production may go on."""
    return found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings")).withColumn("passed", F.col("errors") == 0)


def gate_selection(runs: DataFrame, selection: DataFrame, pack: str) -> DataFrame:
    """One row ``run_id, passed, reason`` for a selection (``items, root`` of ``selection_fingerprint``).

    Of the runs (``run_id, finished_at, root, pack, errors``) the latest counts.  It must be of
    this selection and this pack and have found no errors.
    """
    last = runs.agg(F.max(F.struct("finished_at", "run_id", "root", "pack", "errors")).alias("r")).select("r.*").withColumnRenamed("root", "run_root")
    both = selection.join(last, F.lit(True), "left")  # one row each
    reason = F.when(F.col("items") == 0, "empty_selection").when(F.col("run_id").isNull(), "no_run").when(F.col("run_root") != F.col("root"), "selection_changed").when(F.col("pack") != pack, "other_pack").when(F.col("errors") > 0, "errors")
    return both.select("run_id", reason.isNull().alias("passed"), reason.alias("reason"))


def family_consistency(items: DataFrame, privileged: DataFrame) -> DataFrame:
    """Families with both privileged and other members (``family_id, members, privileged``)."""
    marked = items.join(privileged.select("item_id", F.lit(1).alias("p")).distinct(), "item_id", "left")
    return marked.where("family_id IS NOT NULL").groupBy("family_id").agg(F.count(F.lit(1)).alias("members"), F.count("p").alias("privileged")).where("privileged > 0 AND privileged < members")
