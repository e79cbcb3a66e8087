"""Places in texts: entities with their bytes, citations and anchors in the text as it stands.

White space is compared collapsed and case not at all (citations) by patterns made
of the sought words, so that a hit is a place of the original text and needs no map
from a collapsed one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdocket.functions import norm

#: Kinds of entities; the parts of a kind come in this order.  No look-around, so that they mean the same in every engine.
SPAN_PATTERNS = {
    "email": [r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,24}\b"],
    "phone": [r"(?:\+?1[\s.-]?)?(?:\([0-9]{3}\)|[0-9]{3})[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}\b"],
    "ssn": [r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"\b[0-9]{9}\b"],
    "card": [r"\b(?:[0-9][ -]?){12,18}[0-9]\b"],
    "currency": [r"(?:\$|USD)\s?[0-9]{1,3}(?:,[0-9]{3}){0,12}(?:\.[0-9]{2})?"],
}
_COMPILED = {k: [re.compile(p) for p in ps] for k, ps in SPAN_PATTERNS.items()}


def _valid(kind: str, value: str) -> bool:
    d = re.sub("[^0-9]", "", value)
    if kind == "card":
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        return d[0] in "23456" and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    if kind == "ssn":
        return not d.startswith(("000", "666", "9")) and d[3:5] != "00" and d[5:] != "0000"
    return True


def places_of(text: str, kind: str) -> list[tuple[int, int, str]]:
    """Valid matches of a kind: bytes of UTF-8 and the value.  One inside a match of an earlier pattern does not count."""
    found: list[tuple[int, int, str]] = []
    for pattern in _COMPILED[kind]:
        before, at, byte = sorted((s, e) for s, e, _ in found), 0, 0
        for m in pattern.finditer(text):
            # Bytes are counted from one match to the next.
            byte += len(text[at : m.start()].encode())
            at = m.start()
            end = byte + len(m[0].encode())
            k = bisect_right(before, (byte, float("inf"))) - 1
            if (k < 0 or before[k][1] < end) and _valid(kind, m[0]):
                found.append((byte, end, m[0]))
    return found


def entity_spans(items: DataFrame, key: str, fields: dict[str, Column], kinds: list[str] | None = None) -> DataFrame:
    """``key, field, entity_type, start, end, value, normal, masked, match_hash`` of each valid match.

    Offsets are bytes of the field's UTF-8.  The nine digits of a social security
    number written as one run count only outside those found with hyphens; a phone
    number has ten digits after an optional 1; ``match_hash`` is of the normal form.
    """
    wanted, names = kinds or list(SPAN_PATTERNS), list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, name in enumerate(names):
                for row, text in enumerate(b.column(n + 1).to_pylist()):
                    if text:
                        rows += [(row, name, kind, *hit) for kind in wanted for hit in places_of(text, kind)]
            at, *rest = zip(*rows, strict=True) if rows else [[]] * 6
            kinds_of = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, k) for c, k in zip(rest, kinds_of, strict=True)]], names=[key, "field", "entity_type", "start", "end", "value"])

    kind_of_key = items.schema[key].dataType.simpleString()
    each = items.select(key, *[c.alias(f"field_{n}") for n, c in enumerate(fields.values())]).mapInArrow(run, f"`{key}` {kind_of_key}, field string, entity_type string, start int, end int, value string")
    digits = F.regexp_replace("value", "[^0-9]", "")
    kind = F.col("entity_type")
    normal = F.when(kind == "email", F.lower("value")).when(kind == "phone", F.right(digits, F.lit(10))).when(kind == "currency", F.regexp_replace("value", "[^0-9.]", "")).otherwise(digits)
    masked = F.when(kind == "email", norm.mask_email(F.col("value"))).when(kind == "currency", F.lit("$***")).otherwise(norm.mask_tail(F.col("value")))
    return each.withColumn("normal", normal).select(key, "field", "entity_type", "start", "end", "value", "normal", masked.alias("masked"), F.sha2(F.col("normal"), 256).alias("match_hash"))


def _literal(c: Column) -> Column:
    """A pattern for a text as it is, but any white space for white space."""
    plain = F.transform(F.split(c, r"\s+", -1), lambda w: F.when(w == "", "").otherwise(F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))))
    return F.array_join(plain, "\\s+")


def _only_place(text: Column, before: Column, sought: Column, after: Column, flags: str) -> Column:
    """Struct ``n, start, end`` (characters): how often the sought text stands between its neighbours, and where if once.

    Hits may overlap.  Where ``before`` begins with white space, a run of it counts once.
    """
    head = F.when(before.rlike(r"^\s"), "(?<!\\s)").otherwise("")
    pattern = F.concat(F.lit(flags), head, F.lit("("), _literal(before), F.lit(")("), _literal(sought), F.lit(")"), _literal(after))
    n = F.regexp_count(text, F.concat(F.lit("(?="), pattern, F.lit(")")))
    start = F.regexp_instr(text, pattern) - 1 + F.length(F.call_function("regexp_extract", text, pattern, F.lit(1)))
    end = start + F.length(F.call_function("regexp_extract", text, pattern, F.lit(2)))
    return F.struct(n.alias("n"), F.when(n == 1, start).alias("start"), F.when(n == 1, end).alias("end"))


def _bytes_before(text: Column, characters: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), characters))


def verify_citation(text: Column, quote: Column, start: Column, end: Column) -> Column:
    """Struct ``status, start, end`` of a quotation said to stand at some bytes of a text.

    It is ``matched`` if it occurs exactly once, white space and case aside (with
    overlaps): at the given bytes if they hold it, else at those where it was found.
    A quotation with an ellipsis inside must occur with it.  Else it is
    ``quote_not_found``; then bytes in range that hold something else are given back.
    """
    text, quote = F.coalesce(text, F.lit("")), F.trim(F.regexp_replace(F.coalesce(quote, F.lit("")), r"^\s+|\s+$", ""))
    place = _only_place(text, F.lit(""), quote, F.lit(""), "(?iu)")
    raw = text.cast("binary")
    byte = lambda at: F.conv(F.hex(F.substring(raw, at + 1, F.lit(1))), 16, 10).cast("int")
    whole = lambda at: (at == F.octet_length(text)) | ~byte(at).between(0x80, 0xBF)
    in_range = F.coalesce((start >= 0) & (end > start) & (end <= F.octet_length(text)) & whole(start) & whole(end), F.lit(False))
    held = F.substring(raw, start + 1, end - start).cast("string")
    same = F.lower(norm.collapse(held)) == F.lower(norm.collapse(quote))
    spliced = quote.rlike(r"\S\s*(?:\.\.\.|…)\s*\S")
    found = (quote != "") & (place["n"] == 1)
    given = in_range & ~spliced
    first, last = _bytes_before(text, place["start"]), _bytes_before(text, place["end"])
    stays = (found & given & same) | (~found & given & ~same & (quote != ""))
    return F.struct(
        F.when(found, "matched").otherwise("quote_not_found").alias("status"),
        F.when(stays, start).when(found, first).cast("int").alias("start"), F.when(stays, end).when(found, last).cast("int").alias("end"),
    )


def re_anchor(text: Column, quote: Column, before: Column, after: Column, start: Column, same_text: Column) -> Column:
    """Struct ``state, start, end`` (characters of the text as it stands) of a mark on a text.

    In the same text with the quotation at its place it is active.  Else it is
    sought, white space collapsed, with exactly its neighbours; it moves if there is
    one such place, and is stale otherwise.
    """
    text = F.coalesce(text, F.lit(""))
    place = _only_place(text, F.coalesce(before, F.lit("")), F.regexp_replace(quote, r"^\s+|\s+$", ""), F.coalesce(after, F.lit("")), "")
    here = F.coalesce(same_text & (F.substring(text, start + 1, F.length(quote)) == quote), F.lit(False))
    once = F.coalesce((F.length(norm.collapse(quote)) > 0) & (place["n"] == 1), F.lit(False))
    state = F.when(here, "active").when(once, "moved").otherwise("stale")
    return F.struct(state.alias("state"), F.when(here, start).when(once, place["start"]).cast("int").alias("start"), F.when(here, start + F.length(quote)).when(once, place["end"]).cast("int").alias("end"))
