"""Places in texts."""

import pytest
from pyspark.sql import functions as F

from sparkdocket.operators import spans
from sparkdocket.operators.spans import SPAN_PATTERNS, entity_spans, re_anchor, verify_citation

TEXT = "Ünü: jo@mail.example, +1 (555) 123-4567 or 5551234567; 123-45-6789, 123456780, 000-12-3456, 987654321; 4111 1111 1111 1111, 4111111111111112; $ 1,234.50 USD 7"


def test_entities_by_bytes(spark):
    df = spark.createDataFrame([(1, TEXT, "x 123-45-6789"), (2, None, ""), (3, "", None)], "id int, body string, subject string")
    rows = entity_spans(df, "id", {"body": F.col("body"), "subject": F.col("subject")}).collect()
    raw = TEXT.encode()
    assert all(raw[r.start : r.end].decode() == r.value for r in rows if r.field == "body")
    got = sorted((r.field, r.entity_type, r.normal, r.masked) for r in rows)
    assert got == sorted([
        ("body", "email", "jo@mail.example", "j***@mail.example"), ("body", "phone", "5551234567", "***4567"), ("body", "phone", "5551234567", "***4567"),
        ("body", "ssn", "123456789", "***6789"), ("body", "ssn", "123456780", "***6780"), ("body", "card", "4111111111111111", "***1111"),
        ("body", "currency", "1234.50", "$***"), ("body", "currency", "7", "$***"), ("subject", "ssn", "123456789", "***6789"),
        *[(r.field, r.entity_type, r.normal, r.masked) for r in rows if r.entity_type == "phone" and r.normal != "5551234567"],
    ])
    phones = [r for r in rows if r.entity_type == "phone" and r.normal == "5551234567"]
    assert len({r.match_hash for r in phones}) == 1
    assert {r.id for r in rows} == {1}


@pytest.mark.parametrize("unit", ["a.", "a-b.", "1,234,", "12 ", "1-", "$1,", "555.", "x@y.", "é "])
def test_long_runs_end(spark, unit):
    """A hundred thousand repeats of what the loops of the patterns match."""
    df = spark.createDataFrame([(1, "q@" + unit * 100_000), (2, "$1" + unit * 100_000 + "@b.co")], "id int, t string")
    entity_spans(df, "id", {"t": F.col("t")}).count()
    from sparkdocket.functions import norm
    from sparkdocket.operators.text import entity_hits

    entity_hits(df, "id", "t").count()
    paths, subjects = F.concat(F.lit("/"), F.repeat(F.lit("ab/"), 100_000)), F.repeat(F.lit("re: "), 100_000)
    assert df.select(F.length(norm.scrub_paths(paths)), norm.scan_subject(subjects), norm.thread_subject(F.concat(subjects, F.lit("X")))).first()[:] == (2, "", "x")


def cited(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, text string, quote string, s int, e int")
    out = df.select("k", verify_citation(F.col("text"), F.col("quote"), F.col("s"), F.col("e")).alias("c")).orderBy("k").collect()
    return [(r.c.status == "matched", r.c.start, r.c.end) for r in out]


def test_citations(spark):
    t = "Ärger:  One two\n three.  One TWO four"
    b = t.encode()
    at = lambda part: (b.index(part.encode()), b.index(part.encode()) + len(part.encode()))
    got = cited(spark, [
        (t, "two  THREE", None, None), (t, "one two", None, None), (t, "one two four", *at("One TWO four")), (t, "one two four", 3, 5), (t, "missing", 0, 2), (t, "missing", 0, 900),
        (t, " ", 0, 3), (None, "x", None, None), ("a... b", "a... b", None, None), ("a x b", "a ... b", 0, 5), ("ababa", "aba", None, None), ("x.y", "x.y", None, None), ("xzy", "x.y", None, None),
        ("q \\E w", "q \\E W", None, None), (t, "ärger", 1, 3), ("one one", "one", 0, 3),
    ])
    two = (True, b.index(b"two"), b.index(b"three") + 5)
    assert got == [
        two, (False, None, None), (True, *at("One TWO four")), (True, *at("One TWO four")), (False, 0, 2), (False, None, None),
        (False, None, None), (False, None, None), (True, 0, 6), (False, None, None), (False, None, None), (True, 0, 3), (False, None, None),
        (True, 0, 6), (True, 0, 6), (False, None, None),
    ]


def anchored(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, q string, b string, a string, s int, same boolean")
    out = df.select("k", re_anchor(F.col("t"), F.col("q"), F.col("b"), F.col("a"), F.col("s"), F.col("same")).alias("x")).orderBy("k").collect()
    return [(r.x.state, r.x.start, r.x.end) for r in out]


def test_anchors(spark):
    got = anchored(spark, [
        ("one two three", "two", "one ", " three", 4, True), ("new one   two\n three", "two", "one ", " three", 4, False), ("one two three", "two", "one ", " three", 3, True),
        ("one two x two", "two", "", "", 0, False), ("one two x two", "two", "x ", "", 0, False), ("one  two", "two", " ", "", 0, False), ("gone", "two", "", "", 0, True), (None, "two", "", "", 0, True), ("aababa", "aba", "", "", 9, False),
    ])
    assert got == [("active", 4, 7), ("moved", 10, 13), ("moved", 4, 7), ("stale", None, None), ("moved", 10, 13), ("moved", 5, 8), ("stale", None, None), ("stale", None, None), ("stale", None, None)]


def test_patterns_hold_no_unbounded_group():
    """Java matches a repeated group by recursion: only bounded or possessive ones may stand over texts."""
    import re

    for patterns in SPAN_PATTERNS.values():
        for p in patterns:
            assert not re.search(r"\)[*+](?!\+)", p)
    assert spans.SPAN_PATTERNS
