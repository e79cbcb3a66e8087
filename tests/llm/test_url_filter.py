from math import log

import duckdb
import pytest

from sparkdocket.llm.url_filter import ORACLE, MarkovModel, fit_url_models, judge_urls, op10_url_filter


def test_rules_and_nulls(spark):
    rows = [
        (1, "http://A.Example.ORG/en/2"), (2, "http://example.org/es/9?q"), (3, "https://x.example.org/en/17#t"), (4, "http://b.com/fr/1"), (5, "http://b.com/de/1"), (6, "http://b.com/en/1"),
        (7, None), (8, "no scheme"), (9, "http://org"), (10, "x://notorg/fr/"), (11, ""), (11, ""), (12, "http://é.com/fr/\u2603"), (13, "http://a.org" + "/x" * 5000),
    ]
    out = judge_urls(spark.createDataFrame([(*r, "h") for r in rows], "page_id int, url string, host string")).collect()
    by = {r.page_id: r for r in out}
    assert len(out) == len(rows)
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("a.example.org", "/en/2", "org/", "allow")
    assert (by[2].rule, by[2].verdict) == ("example.org/es/", "block")
    assert (by[3].rule, by[3].path) == ("example.org/en/1", "/en/17")
    assert (by[4].rule, by[5].rule, by[6].rule) == ("com/fr/", "com/de/", None)
    assert (by[7].host, by[7].path, by[7].rule, by[7].lm_score) == ("", "", None, 0.0)
    assert (by[8].host, by[8].path) == ("", "") and (by[9].host, by[9].path, by[9].rule) == ("org", "", None) and by[10].rule is None
    assert all(r.verdict in ("allow", "block") for r in out) and by[13].rule == "org/"


def test_model_is_a_distribution_and_tells_apart(spark):
    good, bad = [f"http://a/good/{k}" for k in range(60)], [f"http://a/spam/{k}" for k in range(60)]
    df = spark.createDataFrame([(u, "allow") for u in good] + [(u, "block") for u in bad], "url string, kind string")
    model = fit_url_models(df)
    assert model.ratio("http://a/good/77") > model.threshold > model.ratio("http://a/spam/77")
    # Counts against a direct count.
    assert model.allow.followers["good/"] == {str(d): (1 if d == 0 else 11 if d < 6 else 1) for d in range(10)}
    m = MarkovModel(1, 256, {"": {"a": 3, "b": 1}, "a": {"b": 2}}, {"": 4, "a": 2})
    p0 = (1 + 2 / 256) / 6
    assert abs(m.log_prob("a", "b") - log((2 + 1 * p0) / 3)) < 1e-12
    assert abs(sum(2.718281828459045 ** m.log_prob("a", chr(c)) for c in range(256)) - 1) < 1e-9


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_all_contexts_count_in_joins_as_in_memory(spark):
    """Contexts seen once count; scores by joins and the threshold are those of the model in memory."""
    rows = [(k, f"http://{'a.org' if k % 2 else 'b.com/de'}/{k * 7919 % 1000:03d}/x") for k in range(200)] + [(k, f"http://é{k}.net/{k * 31}") for k in range(200, 230)] + [(300, None), (301, ""), (302, "http://a.org/7/x")]
    df = spark.createDataFrame(rows, "page_id int, url string")
    out = judge_urls(df).collect()
    labelled = [(r.url, r.verdict) for r in out if r.rule is not None]
    model = fit_url_models(spark.createDataFrame(labelled, "url string, kind string"))
    assert len(out) == len(rows) and all(abs(r.lm_score - model.ratio(r.url)) < 1e-9 for r in out)
    assert all(r.verdict == ("allow" if model.ratio(r.url) >= model.threshold else "block") for r in out if r.rule is None)
    assert model.allow.totals["919/x"] == 1
    assert len(fit_url_models(spark.createDataFrame([(u, k) for u, k in labelled], "url string, kind string"), max_order=3).allow.totals) < len(model.allow.totals)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, sf):
    """Rules, models, threshold and verdicts of the whole table against SQL."""
    data = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    want = {r[0]: r[1:] for r in con.sql(ORACLE["op10_url_filter"]).fetchall()}
    got = op10_url_filter(spark, data).collect()
    assert len(got) == len(want)
    assert all((r.host, r.path, r.rule, r.verdict) == want[r.page_id][:4] and abs(r.lm_score - want[r.page_id][4]) < 2e-6 for r in got)
