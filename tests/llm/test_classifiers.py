import zlib

import numpy as np
import pytest

from sparkdocket.llm.langid import fit_language, identify_language, op6_language
from sparkdocket.llm.nbsvm import train_ratio_model
from sparkdocket.llm.quality import fit_quality, op1_quality, score_quality
from sparkdocket.llm.subword import train_subword
from sparkdocket.llm.textfeat import FeatureSpace, WordSums, linear_values, sparse_rows
from sparkdocket.llm.toxicity import fit_toxicity, op2_toxicity, score_toxicity
from sparkdocket.llm.training import collect_features

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "label", "folds", "left", "least", "sf"), [(op1_quality, "quality", 5, 0, 0.95, "sf0.01"), (op2_toxicity, "toxic", 4, 2, 0.97, "sf0.1")])
def test_held_out_accuracy(spark, query, label, folds, left, least, sf):
    data = f"/root/testdata/{sf}"  # sf0.01 has too few toxic labels to learn from
    out = query(spark, data).toPandas()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert (out["predicted"] == (out["score"] >= 0.3).astype(int)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % folds == left) for i, h in zip(out["doc_id"], out["held_out"], strict=True))
    both = out.merge(spark.read.parquet(f"{data}/labels.parquet").toPandas(), on="doc_id")
    both = both[both["held_out"]]
    assert (both["predicted"] == both[label]).mean() >= least


def test_languages(spark):
    out = op6_language(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = out[out["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() >= 0.98
    assert held["accepted"].mean() >= 0.97


def test_odd_texts(spark):
    rows = [(k, f"good words number {k} here", 1) for k in range(30)] + [(100 + k, f"$$$ junk*** idiot {k}", 0) for k in range(30)]
    docs = spark.createDataFrame([(i, t, "x", -1) for i, t, _ in rows] + [(200, None, "x", 0), (201, "", "x", 0), (202, "12 34 !!", "x", 0), (203, "long " * 60_000, "x", 0), (None, "good words", "x", 0), (200, "good", "x", 0)], "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(i, q, 1 - q) for i, _, q in rows] + [(999, 1, 0), (None, 1, 1), (201, None, None)], "doc_id long, quality int, toxic int")
    for fit, score in ((fit_quality, score_quality), (fit_toxicity, score_toxicity)):
        model = fit(docs, labels)
        out = score(docs, model).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
        assert score(docs.limit(0), model).count() == 0
        untaught = score(docs, fit(docs, labels.limit(0))).collect()  # no labels at all
        assert all(0 <= r.score <= 1 for r in untaught)
        one = score(docs, fit(docs, labels.where("quality = 1"))).collect()  # one label only
        assert len(one) == len(out)


def test_language_of_odd_texts(spark):
    rows = [(k, f"the and of is {k}", "en") for k in range(40)] + [(100 + k, f"der und die ist {k}", "de") for k in range(40)]
    docs = spark.createDataFrame([*rows, (300, None, "en"), (301, "", None), (302, "12 345 !?", "de"), (303, "und die der", None), (303, "und die der", None)], "doc_id long, text string, lang string")
    out = identify_language(docs, fit_language(docs)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == docs.count()
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and not by[i].accepted for i in (300, 301, 302))
    assert by[303].lang_pred == "de" and by[0].lang_pred == "en"
    assert {r.lang_pred for r in identify_language(docs, fit_language(docs.limit(0))).collect()} == {"und"}


def test_word_sums_are_the_sums_of_features():
    space = FeatureSpace(buckets=512, repeats=True, bigrams=True)
    w = np.random.default_rng(0).normal(size=(512, 2))
    texts = ["aa aa bb the", "", None, "x", "the  the\nthe é" * 50]
    sums, counts = WordSums(space, linear_values(space, w), 3, np.append(w[0], 1.0), w, most=2).sums(texts)
    for s, (idx, cnt) in zip(sums, sparse_rows(space, texts), strict=True):
        assert np.allclose(s[:2], (w[idx] * cnt[:, None]).sum(0)) and s[2] == cnt.sum()
    assert counts.tolist() == [4, 0, 0, 1, len(texts[4].split())]


def test_training_is_reproducible_and_learns():
    space = FeatureSpace(buckets=1 << 12)
    texts = [f"apple pear {k}" for k in range(60)] + [f"stone rock {k}" for k in range(60)]
    y = [0] * 60 + [1] * 60
    rows = sparse_rows(space, texts)
    a, b = train_subword(rows, y, space), train_subword(rows, y, space)
    assert (a.logits == b.logits).all() and (a.of_rows(rows).argmax(1) == y).all()
    r = train_ratio_model(sparse_rows(space, texts, True), y, space)
    p = r.probabilities(r.scorer().sums(texts, True)[0])
    assert ((p >= 0.5) == np.array(y)).all()


def slow_features(space, text, distinct=False):
    """The features of a text one by one, as a list of numbers."""
    words = (text.lower() if space.lower else text or "").split() if text else []
    out = []
    for w in dict.fromkeys(words) if distinct else words:
        marked = "\x02" + w + "\x03"
        for n in range(space.low, space.high + 1):
            for i in range(len(marked) - n + 1):
                h = 0
                for c in marked[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                out.append(slow_bucket(space, (h + n) % 2**64))
        if space.whole_word:
            out.append(slow_bucket(space, slow_number(w)))
    for a, b in zip(words, words[1:], strict=False):
        if space.repeats and a == b:
            out.append(0)
        if space.bigrams:
            out.append(slow_bucket(space, (slow_number(a) * 0x9E3779B97F4A7C15 + (slow_number(b) ^ 0xBF58476D1CE4E5B9)) % 2**64))
    return out


def slow_bucket(space, h):
    h = ((h ^ h >> 31) * 0xBF58476D1CE4E5B9) % 2**64
    return (h ^ h >> 29) % space.buckets


def slow_number(w):
    total = 0
    for i, c in enumerate("\x02" + w + "\x03"):
        x = (ord(c) + 0xBF58476D1CE4E5B9) * ((i * 0x9E3779B97F4A7C15 + 1) | 1) % 2**64
        total += x ^ x >> 29
    return total * 0x9E3779B97F4A7C15 % 2**64


def softmax(z):
    e = np.exp(z - z.max())
    return e / e.sum()


def test_scores_against_a_slow_scorer(spark):
    """Scores of whole queries from the trained weights, a feature at a time."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 9 = 0").collect()}
    quality, toxic, language = fit_quality(docs, labels), fit_toxicity(docs, labels), fit_language(docs)
    got = {r.doc_id: r for r in score_quality(docs, quality).collect()}
    bad = {r.doc_id: r for r in score_toxicity(docs, toxic).collect()}
    named = {r.doc_id: r for r in identify_language(docs, language).collect()}
    for i, t in texts.items():
        for model, want in ((quality, lambda p, i=i: got[i].score == pytest.approx(p[quality.classes.index(1)], abs=1e-9)), (language.model, lambda p, i=i: named[i].score in (0.0, pytest.approx(p.max(), abs=1e-9)))):
            f = slow_features(model.space, t)
            z = sum((model.logits[k] for k in f), np.zeros(len(model.classes))) / max(len(f), 1)
            p = softmax((z + model.bias) / model.temperature)
            assert want(p)
        z = sum(toxic.weights[k] for k in slow_features(toxic.space, t, True)) + toxic.bias
        assert bad[i].score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_rejection_is_calibrated_by_length(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_language(docs)
    assert len(model.reject_below) == 6 and model.reject_below[0] <= model.reject_below[-1]
    assert (model.thresholds(np.array([0, 1, 3, 40])) == np.array(model.reject_below)[[0, 0, 1, 5]]).all()
    from pyspark.sql import functions as F

    for n in (8, 16, 1000):  # stretches of texts it has not been calibrated on
        part = docs.where("lang IS NOT NULL").withColumn("text", F.concat_ws(" ", F.slice(F.split("text", r"\s+"), 3, n)))
        out = identify_language(part, model).toPandas()
        assert out["accepted"].mean() >= 0.97
        assert (out["lang_pred"] == out["lang"])[out["accepted"]].mean() >= 0.97


def test_collected_rows_stay_narrow(spark):
    """A row is widened when it is read; the driver holds four bytes a number."""
    docs = spark.createDataFrame([(k, f"some words of text number {k} and more", k % 2) for k in range(60)], "id long, text string, label int")
    rows, labels, held, _ = collect_features(docs, FeatureSpace(buckets=1 << 16, low=2, high=4, lower=True), 100, key="id", label="label")
    assert len(rows) == len(labels) == len(held) == 60
    assert all((i.dtype, c.dtype) == (np.int64, np.float64) for i, c in rows)
    assert all((i.dtype, c.dtype) == (np.uint32, np.float32) for i, c in rows.narrow)
