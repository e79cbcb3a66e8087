"""Toxicity: character n-grams scaled by naive Bayes ratios, linear classifier."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdocket.llm.nbsvm import RatioModel, train_ratio_model
from sparkdocket.llm.quality import labelled_sample
from sparkdocket.llm.textfeat import FeatureSpace
from sparkdocket.llm.training import collect_features, fold, score_texts

SPACE = FeatureSpace(buckets=1 << 18, low=3, high=5, lower=True, whole_word=False)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "toxic", per_class: int = 1200) -> RatioModel:
    """Fit on at most ``per_class`` labelled documents of each label."""
    sample = labelled_sample(docs, labels, per_class, id_col=id_col, label_col=label_col)
    rows, y, _, _ = collect_features(sample, SPACE, per_class, key=id_col, label=label_col, distinct=True)
    return train_ratio_model(rows, y, SPACE)


def score_toxicity(docs: DataFrame, model: RatioModel, *, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Add ``score double`` (probability of label 1) and ``predicted int``.

    Null and empty texts get the probability that the bias alone gives.  Rows are
    independent of each other, so that repeated rows score alike; very long texts
    are scored whole, an empty table stays empty, and clashing input columns are
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def results(p, counts, texts):
        return [pa.array(p, pa.float64()), pa.array((p >= threshold).astype("int32"), pa.int32())]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return score_texts(docs, shared, fields, results, keep=keep, distinct=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 4) != 2)
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return score_toxicity(docs, fit_toxicity(docs, labels), keep=["doc_id"]).select("doc_id", held, "score", "predicted")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
