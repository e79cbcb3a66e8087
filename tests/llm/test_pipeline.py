import corpus_pipeline
from sparkdocket.llm import pipeline
from sparkdocket.llm import pii
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_jaccard_join import brute as components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = pipeline.language(spark, docs, SF)
    assert one.columns == docs.columns and one.count() >= 0.97 * docs.count()
    two = pipeline.near_duplicates(spark, one, SF)
    want = {d for d, n, c in components([(r.doc_id, r.text) for r in one.collect()], 5, 80) if c == d or n == 0}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    three = pipeline.benchmark_leaks(spark, two, SF)
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect() if windows(r.text, items)[1] == 0}
    four = pipeline.private_data(spark, three, SF)
    plain = {r.doc_id: r.text for r in pii.replace_pii(three, key=pii.DEMO_KEY).collect()}
    assert four.schema == docs.schema and {r.doc_id: r.text for r in four.collect()} == plain
    five = pipeline.piece_samples(spark, four, SF).collect()
    assert all(r.decodes for r in five) and {r.doc_id for r in five} == set(plain)


def test_run_and_names(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark_leaks", "private_data", "piece_samples"]
    assert corpus_pipeline.run(spark, SF).count() > 300


def test_odd_documents_in_every_stage(spark):
    """Nulls in any column, empty texts, very long ones, repeated rows and ids, clashing names, an empty table."""
    long = "there was a house near the river and we went there " * 4000
    plain = [f"We went to the market near the river at {k} in the morning and it was cold there" for k in range(40)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(plain)]
    rows += [(100, None, "en", None, None), (101, "", None, "s", 0), (102, "?? 12 !!", "en", "s", 8), (None, plain[3] + " again", None, None, None), (103, long, "en", "s", len(long)), (0, plain[0], "en", "s", len(plain[0])), (0, long[:3000], "en", "s", 3000), (104, "write to jo@mail.example.com now please and then come to the house", "en", "s", 5)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, id long, score string, _mark int, n_words int, pieces string, Item_Ids string"
    docs = spark.createDataFrame([(*r, 7, "own", 1, 2, "p", "q") for r in rows], kind).repartition(3)
    for name, work in pipeline.STAGES[:4]:
        out = work(spark, docs, SF)
        assert out.schema.names == docs.columns, name
        got = out.collect()
        assert all((r.id, r.score, r._mark, r.n_words, r.pieces, r["Item_Ids"]) == (7, "own", 1, 2, "p", "q") for r in got), name
        assert work(spark, docs.limit(0), SF).count() == 0, name
        texts = [r.text for r in got]
        if name == "language":
            assert None not in texts and "" not in texts and sum(t in plain for t in texts) >= 40 and long in texts
        elif name == "near_duplicates":
            assert len(got) < len(rows) and None in texts and "" in texts and sum(t == plain[0] for t in texts) <= 1
        elif name == "benchmark_leaks":
            assert len(got) == len(rows)
        else:
            assert len(got) == len(rows) and not any("jo@mail.example.com" in (t or "") for t in texts)
            assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    out = pipeline.piece_samples(spark, docs, SF)
    assert out.columns == ["doc_id", "lang", "source", "sample", "pieces", "n_pieces", "log_prob", "log_inclusion", "decodes"]
    assert all(r.decodes for r in out.collect() if r.sample is not None) and out.where("sample IS NULL").count() == 1
    assert pipeline.piece_samples(spark, docs.limit(0), SF).count() == 0
