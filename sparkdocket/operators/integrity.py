"""Scan integrity: fault classes per message, preflight advice, exit policy, report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of the preflight.
LIMITS = {"skip": 0.05, "crc_skip": 0.01, "failed_file": 0.0}


def classify_message(strict: bool, *, unreadable: Column, body_cut: Column, body_absent: Column, attachments_bad: Column, orphaned: Column) -> Column:
    """Struct ``outcome, reasons, orphaned`` of a message from its faults.

    An unreadable message (``unreadable`` is its reason, else null) is skipped.  Other
    faults degrade it; a strict scan skips it for the first of them.
    """
    faults = F.array_compact(
        F.array(
            F.when(body_cut, "body_truncated").when(body_absent, "body_unavailable"),
            F.when(attachments_bad, "attach_meta_failed"),
            F.when(orphaned, "orphaned_node"),
        )
    )
    none = F.array().cast("array<string>")
    skipped = unreadable.isNotNull() | (F.lit(strict) & (F.size(faults) > 0))
    reasons = F.when(unreadable.isNotNull(), F.array(unreadable)).when(F.lit(strict), F.slice(faults, 1, 1)).otherwise(faults)
    outcome = F.when(skipped, "skip").when(F.size(faults) > 0, "degraded").otherwise("clean")
    return F.struct(outcome.alias("outcome"), F.coalesce(reasons, none).alias("reasons"), (~skipped & orphaned).alias("orphaned"))


def scan_totals(messages: DataFrame, files: DataFrame) -> DataFrame:
    """One row of totals from ``messages`` (``outcome, reasons``) and ``files`` (``status``: ok, partial, failed)."""
    m = messages.agg(
        F.count_if(F.col("outcome") != "skip").alias("recoverable"), F.count_if(F.col("outcome") == "skip").alias("skipped"), F.count_if(F.col("outcome") == "degraded").alias("degraded"),
        F.count_if((F.col("outcome") == "skip") & F.array_contains("reasons", "crc_mismatch")).alias("crc_skips"),
    )
    f = files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "partial").alias("partial_files"), F.count_if(F.col("status") == "failed").alias("failed_files"))
    return m.join(f, F.lit(True))  # one row each


def preflight(totals: DataFrame, strict: bool, limits: dict[str, float] | None = None) -> DataFrame:
    """Add ``skip_rate, crc_skip_rate, failed_file_rate, recommendation, reasons`` to totals."""
    limits = LIMITS | (limits or {})
    c = F.col
    seen, files = F.greatest(c("recoverable") + c("skipped"), F.lit(1)), F.greatest("files", F.lit(1))
    out = totals.withColumns({"skip_rate": c("skipped") / seen, "crc_skip_rate": c("crc_skips") / seen, "failed_file_rate": c("failed_files") / files})
    trouble = (c("skipped") > 0) | (c("failed_files") > 0)
    stop = F.array_compact(
        F.array(
            F.when((c("files") > 0) & (c("failed_files") >= c("files")), "all_files_failed"), F.when((c("recoverable") == 0) & trouble, "zero_recoverable"),
            F.when(F.lit(strict) & trouble, "strict_integrity_failure"),
        )
    )
    worry = F.array_compact(F.array(*[F.when(c(f"{k}_rate") > v, f"{k}_rate_exceeded") for k, v in limits.items()]))
    advice = F.when(F.size(stop) > 0, "not_export_ready").when(F.size(worry) > 0, "re_export_recommended").otherwise("ok")
    return out.withColumn("recommendation", advice).withColumn("reasons", F.when(F.size(stop) > 0, stop).otherwise(worry))


def exit_policy(checked: DataFrame, strict: bool, allow_failed_files: bool = False) -> DataFrame:
    """Add ``exit_reason`` (null for success) to a preflight row."""
    c = F.col
    unready = c("recommendation") == "not_export_ready"
    reason = F.when(F.lit(strict) & ((c("skipped") > 0) | (c("partial_files") > 0) | (c("failed_files") > 0) | unready), "strict integrity failure")
    reason = reason.when((c("failed_files") > 0) & ~(F.lit(allow_failed_files) & (c("recoverable") > 0)), "files failed to scan")
    return checked.withColumn("exit_reason", reason.when(unready & (c("recoverable") == 0), "nothing recoverable"))


def sidecar(messages: DataFrame, key: str) -> DataFrame:
    """Rows of the integrity report: skipped and degraded messages with their reasons."""
    return messages.where("outcome <> 'clean'").select(key, "outcome", F.concat_ws(";", "reasons").alias("reasons"))


def reason_counts(messages: DataFrame) -> DataFrame:
    return messages.select("outcome", F.explode("reasons").alias("reason")).groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


def dedup_report(decisions: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """One row per message: its decision beside its own details and those of the winner of its group."""
    own = [c for c in details.columns if c != key]
    winners = details.select(F.col(key).alias("group_id"), *[F.col(c).alias(f"kept_{c}") for c in own])
    return decisions.join(details, key).join(winners, "group_id", "left")
