"""The JSON filter language, compiled to DataFrame filters and semi-joins.

A spec is ``{"version": 1, "scope": ..., "include_family": bool, "conditions":
[{"field", "op", "value"}]}``; all conditions must hold.  Conditions on an item's
own columns become one Column; conditions on satellites become semi- or
anti-joins on the item id.  An unknown field, operator or property is an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdocket.functions import norm


class FilterError(ValueError):
    pass


@dataclass
class Satellites:
    """Tables keyed by item_id that conditions may ask for."""

    codes: DataFrame | None = None  # item_id, code
    participants: DataFrame | None = None  # item_id, person_id, person_key, kind, role
    entities: DataFrame | None = None  # item_id, entity_type
    clusters: DataFrame | None = None  # item_id, cluster_id, set_id, set_name
    notes: DataFrame | None = None  # item_id, note_text
    privilege: DataFrame | None = None  # item_id, status, withhold, include_on_log, description
    extra: dict = field(default_factory=dict)


def _need(table: DataFrame | None, name: str) -> DataFrame:
    if table is None:
        raise FilterError(f"this filter needs the table {name}")
    return table


def _bound(value: str) -> Column:
    try:
        parsed = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except (ValueError, AttributeError) as e:
        raise FilterError(f"not a timestamp: {value!r}") from e
    if parsed.tzinfo is None:
        raise FilterError(f"a date bound must carry an offset: {value!r}")
    return F.to_timestamp(F.lit(parsed.isoformat()))


def _contains(c: Column, v: str) -> Column:
    """Both sides in Unicode lower case; wildcards have no meaning."""
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(v.lower()))


def _range(c: Column, op: str, v, bound: Callable = F.lit, half_open: bool = False) -> Column:
    if op == "gte":
        return c >= bound(v)
    if op == "lte":
        return c <= bound(v)
    low, high = v
    return (c >= bound(low)) & ((c < bound(high)) if half_open else (c <= bound(high)))


_EQ = {"custodian", "from_addr", "file_category", "role", "dedup_role", "cull_status", "mime_type"}
_IN = {"custodian", "file_category", "dedup_role", "cull_status"}
_TEXT = {"custodian", "from_addr", "subject", "path"}
_DATES = {"sent_at": ["sent_at"], "received_at": ["received_at"], "best_effort_date": ["sent_at", "received_at"]}
_COUNTS = {"has_notes": "note_count", "has_highlights": "highlight_count", "has_redactions": "redaction_count", "has_entity": "entity_count"}


def _own_column(f: str, op: str, v) -> Column | None:
    """A condition on the item's own columns; None if the field is of a satellite."""
    if f == "in_review" and op == "eq":
        return F.col("in_review") == F.lit(v)
    if f in _EQ and op == "eq":
        return F.col(f) == F.lit(v)
    if f in _IN and op == "in":
        return F.col(f).isin(list(v))
    if f in _TEXT and op == "contains":
        return _contains(F.col(f), v)
    if f == "mime_type" and op == "prefix":
        return F.lower(f).startswith(v.lower())
    if f == "size_bytes" and op in ("gte", "lte", "between"):
        return _range(F.col(f), op, v)
    if f in _DATES and op in ("gte", "lte", "between"):
        date = F.coalesce(*[F.col(c).cast("timestamp") for c in _DATES[f]])
        return _range(date, op, v, _bound, half_open=True)
    if f == "has_text" and op == "eq":
        return F.col("text_sha256").isNotNull() == F.lit(v)
    if f in _COUNTS and op == "eq":
        return (F.coalesce(F.col(_COUNTS[f]), F.lit(0)) > 0) == F.lit(v)
    if f == "entity_flags" and op in ("any_bits", "eq"):
        return F.col(f).bitwiseAND(F.lit(v)) != 0 if op == "any_bits" else F.col(f) == F.lit(v)
    if f == "sentiment_polarity" and op in ("eq", "any_of"):
        return F.col(f).isin(list(v) if op == "any_of" else [v])
    if f == "sentiment_compound" and op in ("gte", "lte", "between"):
        return _range(F.col(f), op, v)
    if f == "has_sentiment" and op == "eq":
        return F.col("sentiment_polarity").isNotNull() == F.lit(v)
    if f == "pdf_needs_ocr" and op == "eq":
        return F.coalesce(F.col(f), F.lit(False)) == F.lit(v)
    if f == "redacted_text_stale" and op == "eq":
        current = F.coalesce("text_sha256", "html_sha256")
        stale = (F.coalesce("redaction_count", F.lit(0)) > 0) & (F.col("redacted_sha256").isNull() | (F.col("redacted_source_sha256") != current))
        return stale == F.lit(v)
    return None


def _satellite(f: str, op: str, v, s: Satellites) -> list[tuple[DataFrame, bool]] | None:
    """(ids, must be among them) for a condition on a satellite."""
    key = "item_id"
    if f == "code_missing" and op == "eq":
        return [(_need(s.codes, "codes").select(key), not v)]
    if f == "code" and op in ("any_of", "all_of", "none_of"):
        codes = _need(s.codes, "codes")
        if op == "all_of":
            return [(codes.where(F.col("code") == c).select(key), True) for c in v]
        return [(codes.where(F.col("code").isin(list(v))).select(key), op == "any_of")]
    if f == "entity_type" and op == "any_of":
        return [(_need(s.entities, "entities").where(F.col("entity_type").isin(list(v))).select(key), True)]
    if f in ("participant_key", "participant_email", "participant_domain") and op in ("eq", "contains"):
        p = _need(s.participants, "participants")
        c = F.col("person_key")
        if f == "participant_domain":
            p, c = p.where("kind = 'smtp'"), norm.domain_of(F.col("person_key"))
        return [(p.where((c == v.lower()) if op == "eq" else _contains(c, v)).select(key), True)]
    if f == "participant_role" and op == "any_of":
        return [(_need(s.participants, "participants").where(F.col("role").isin(list(v))).select(key), True)]
    if f == "person_id" and op in ("eq", "any_of"):
        return [(_need(s.participants, "participants").where(F.col("person_id").isin(list(v) if op == "any_of" else [v])).select(key), True)]
    if f == "has_participants" and op == "eq":
        return [(_need(s.participants, "participants").select(key), v)]
    if f in ("concept_cluster_id", "concept_cluster_set_id") and op in (("eq", "any_of") if f == "concept_cluster_id" else ("eq",)):
        column = "cluster_id" if f == "concept_cluster_id" else "set_id"
        return [(_need(s.clusters, "clusters").where(F.col(column).isin(list(v) if op == "any_of" else [v])).select(key), True)]
    if f == "has_concept_cluster" and op == "eq":
        return [(_need(s.clusters, "clusters").where("set_name = 'default'").select(key), v)]
    if f == "note_text" and op == "contains":
        return [(_need(s.notes, "notes").where(_contains(F.col("note_text"), v)).select(key), True)]
    if f == "privilege_withhold" and op == "eq":
        return [(_need(s.privilege, "privilege").where("withhold").select(key), v)]
    if f == "privilege_status" and op == "any_of":
        return [(_need(s.privilege, "privilege").where(F.col("status").isin(list(v))).select(key), True)]
    if f == "privilege_log_ready" and op == "eq":
        blank = F.trim(F.coalesce("description", F.lit(""))) == ""
        return [(_need(s.privilege, "privilege").where(F.col("include_on_log") & (~blank if v else blank)).select(key), True)]
    return None


def scope_of(items: DataFrame, scope: str) -> DataFrame:
    if scope == "review_corpus":
        return items.where("in_review")
    if scope == "entire_matter":
        return items.where(F.col("status").isin(norm.ANALYZABLE))
    raise FilterError(f"unknown scope {scope!r}")


def apply_filter(items: DataFrame, spec: dict | str, satellites: Satellites | None = None) -> DataFrame:
    """Rows of ``items`` that the spec selects.

    Three-valued logic holds: a comparison with a null selects nothing.  With
    ``include_family`` the relatives of hits in scope come too: the same family,
    the hit's parent, and the parent's other children.
    """
    spec = json.loads(spec) if isinstance(spec, str) else spec
    if unknown := set(spec) - {"version", "scope", "include_family", "conditions"}:
        raise FilterError(f"unknown properties {sorted(unknown)}")
    if spec.get("version") != 1:
        raise FilterError("version must be 1")
    scoped = scope_of(items, spec.get("scope", "entire_matter"))
    s = satellites or Satellites()
    own, joins = [], []
    for cond in spec.get("conditions", []):
        f, op, v = cond["field"], cond["op"], cond.get("value")
        if (c := _own_column(f, op, v)) is not None:
            own.append(c)
        elif (more := _satellite(f, op, v, s)) is not None:
            joins += more
        else:
            raise FilterError(f"no operator {op!r} for field {f!r}")
    hits = scoped.where(reduce(lambda a, b: a & b, own)) if own else scoped
    for ids, among in joins:
        hits = hits.join(ids.distinct(), "item_id", "left_semi" if among else "left_anti")
    return expand_family(scoped, hits) if spec.get("include_family") else hits


def expand_family(scoped: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits and their relatives within the scope, by a union of key sets (no OR in a join)."""
    h = hits.select("item_id", "family_id", F.coalesce("parent_item_id", "item_id").alias("root"))
    family = scoped.join(h.where("family_id IS NOT NULL").select("family_id").distinct(), "family_id", "left_semi").select("item_id")
    roots = h.select(F.col("root").alias("item_id")).distinct()
    kids = scoped.join(roots.withColumnRenamed("item_id", "parent_item_id"), "parent_item_id", "left_semi").select("item_id")
    ids = family.union(roots).union(kids).union(h.select("item_id")).distinct()
    return scoped.join(ids, "item_id", "left_semi")


THIN = ["item_id", "path", "subject", "from_addr", "custodian", "file_category", "mime_type", "status", "role", "size_bytes", "sent_at", "received_at", "dedup_role", "cull_status", "in_review", "review_order", "parent_item_id", "family_id"]


def thin(items: DataFrame) -> DataFrame:
    """The list columns that there are."""
    return items.select(*[c for c in THIN if c in items.columns])


def page(items: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page in review order (nulls last), then import time, path and id."""
    keys = [F.col(c).asc_nulls_last() if c == "review_order" else F.col(c).asc_nulls_first() for c in ("review_order", "imported_at", "path", "item_id") if c in items.columns]
    return items.orderBy(*keys).offset(offset).limit(limit)


def _p(field: str, op: str, value, scope: str = "review_corpus") -> dict:
    return {"version": 1, "scope": scope, "conditions": [{"field": field, "op": op, "value": value}]}


PRESETS = {
    "uncoded": _p("code_missing", "eq", True), "privilege": _p("code", "any_of", ["privileged"]), "responsive": _p("code", "any_of", ["responsive"]),
    "has_notes": _p("has_notes", "eq", True), "has_highlights": _p("has_highlights", "eq", True), "withheld": _p("privilege_withhold", "eq", True),
    "log_incomplete": _p("privilege_log_ready", "eq", False), "has_redactions": _p("has_redactions", "eq", True), "pii": _p("entity_flags", "any_bits", 14),
    "has_email": _p("entity_flags", "any_bits", 1), "has_card": _p("entity_flags", "any_bits", 8), "needs_ocr": _p("pdf_needs_ocr", "eq", True),
    "calendar": _p("file_category", "eq", "calendar"), "chat": _p("file_category", "eq", "chat"), "stale_redactions": _p("redacted_text_stale", "eq", True),
    "negative": _p("sentiment_polarity", "eq", "negative"), "positive": _p("sentiment_polarity", "eq", "positive"), "unscored": _p("has_sentiment", "eq", False),
}
