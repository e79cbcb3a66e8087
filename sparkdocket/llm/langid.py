"""Language identification: averaged hashed subword embeddings, linear softmax,
and rejection calibrated by length on texts held back from training.

A short text has fewer features and a less certain score, so one threshold for
all would either reject short clean texts or let long foreign ones through.  Each
range of lengths has its own, from whole texts and short stretches of texts held
back."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdocket.llm.subword import SubwordModel, train_subword
from sparkdocket.llm.textfeat import FeatureSpace
from sparkdocket.llm.training import collect_features, fold, sample_by_hash, score_texts

SPACE = FeatureSpace(buckets=1 << 16, low=2, high=4, lower=True)


#: Ranges of lengths begin at these numbers of words.
LENGTHS = (1, 2, 4, 8, 16, 32)


@dataclass
class LanguageModel:
    model: SubwordModel
    #: The threshold of each range of LENGTHS.
    reject_below: list[float]

    def thresholds(self, words: np.ndarray) -> np.ndarray:
        place = np.searchsorted(LENGTHS, np.maximum(words, 1), side="right") - 1
        return np.array(self.reject_below)[place]


def fit_language(
    docs: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", per_class: int = 500, precision: float = 0.995, most_rejected: float = 0.0005
) -> LanguageModel:
    """Fit on at most ``per_class`` documents of each language.

    A fifth of the sample is held back.  In each range of lengths the threshold is
    the smallest score at which what is accepted of it reaches ``precision``, but
    never so high that more than ``most_rejected`` of its rightly named texts would
    be rejected.
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(id_col, F.col(lang_col).alias("label"), "text")
    sample = sample_by_hash(known, per_class, key=id_col, label="label")
    rows, y, held, short = collect_features(sample, SPACE, per_class, key=id_col, label="label", snippets=LENGTHS)
    model = train_subword(rows, y, SPACE, epochs=6, held=held)
    whole = [k for k in range(len(rows)) if held[k]]
    cuts = []
    for n in LENGTHS:
        check, named = short[n]
        if n == LENGTHS[-1]:
            check, named = [*check, *[rows[k] for k in whole]], [*named, *[y[k] for k in whole]]
        cuts.append(_threshold(model, check, named, precision, most_rejected))
    return LanguageModel(model, cuts)


def _threshold(model: SubwordModel, rows: list, labels: list, precision: float, most_rejected: float) -> float:
    if not rows or len(model.classes) < 2:
        return 0.0
    p = model.of_rows(rows)
    score = p.max(axis=1)
    right = p.argmax(axis=1) == np.array([model.classes.index(v) if v in model.classes else -1 for v in labels])
    order = np.argsort(-score)
    accepted = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    fine = np.nonzero(accepted >= precision)[0]
    strict = score[order][fine[-1]] if len(fine) else 1.0
    if not right.any():
        return 0.0
    # The sample is small for so small a share: the tail is also estimated from mean and spread of the log-odds.
    odds = np.log(np.clip(score[right], 1e-9, 1 - 1e-9)) - np.log1p(-np.clip(score[right], 1e-9, 1 - 1e-9))
    tail = 1 / (1 + np.exp(-(odds.mean() - NormalDist().inv_cdf(1 - most_rejected) * odds.std())))
    return float(min(strict, np.quantile(score[right], most_rejected), tail))


def identify_language(docs: DataFrame, language: LanguageModel, *, keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred string, score double, accepted boolean``.

    A text that is null or has no letter is ``und`` with score 0 and is not
    accepted; nor is one whose score is below the threshold of its length, which
    still gets its likeliest language.  Rows are independent of each other, so that
    repeated rows are judged alike; very long texts are judged whole, an empty table
    stays empty, and clashing input columns are replaced.
    """
    thresholds = LanguageModel(None, language.reject_below).thresholds
    names = np.array([str(c) if c is not None else "und" for c in language.model.classes], dtype=object)
    shared = docs.sparkSession.sparkContext.broadcast(language.model)

    def results(p, counts, texts):
        # Whole texts are searched for a letter; the search stops at the first.
        lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)
        best = names[p.argmax(axis=1)]
        score = np.where(lettered & (best != "und"), p.max(axis=1), 0.0)
        pred = np.where(lettered, best, "und")
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array((score >= thresholds(counts)) & (pred != "und"))]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    return score_texts(docs, shared, fields, results, keep=keep)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    model = fit_language(docs.where(fold(F.col("doc_id"), 4) != 2))
    return identify_language(docs.drop("lang"), model, keep=["doc_id"]).select("doc_id", held, "lang_pred", "score", "accepted")


QUERIES = {"op6_language": op6_language}
ORACLE: dict[str, str] = {}
