"""Quality classifier: supervised subword embeddings with a softmax."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdocket.llm.subword import SubwordModel, train_subword
from sparkdocket.llm.textfeat import FeatureSpace
from sparkdocket.llm.training import collect_features, fold, sample_by_hash, score_texts

SPACE = FeatureSpace(buckets=1 << 16, low=3, high=5, repeats=True, bigrams=True)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, *, id_col: str, label_col: str) -> DataFrame:
    """Texts of a bounded sample of the labels; the sample, not the texts, is broadcast."""
    picked = sample_by_hash(labels.select(id_col, label_col).distinct(), per_class, key=id_col, label=label_col)
    return docs.select(id_col, "text").join(F.broadcast(picked), id_col)


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", per_class: int = 800) -> SubwordModel:
    """Fit on at most ``per_class`` labelled documents of each label."""
    sample = labelled_sample(docs, labels, per_class, id_col=id_col, label_col=label_col)
    rows, y, held, _ = collect_features(sample, SPACE, per_class, key=id_col, label=label_col)
    return train_subword(rows, y, SPACE, held=held)


def score_quality(docs: DataFrame, model: SubwordModel, *, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Add ``score double`` (probability of label 1) and ``predicted int``.

    Null and empty texts get the probability that the bias alone gives; a model
    that never saw label 1 scores 0.  Rows are independent of each other, so that
    repeated rows score alike; very long texts are scored whole, an empty table
    stays empty, and clashing input columns are replaced.
    """
    column = model.classes.index(1) if 1 in model.classes else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def results(p, counts, texts):
        score = p[:, column] if column is not None else 0.0 * p[:, 0]
        return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype("int32"), pa.int32())]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return score_texts(docs, shared, fields, results, keep=keep)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 5) != 0)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return score_quality(docs, fit_quality(docs, labels), keep=["doc_id"]).select("doc_id", held, "score", "predicted")


QUERIES = {"op1_quality": op1_quality}
ORACLE: dict[str, str] = {}
