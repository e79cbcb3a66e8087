"""The stages of the corpus pipeline: each takes ``(spark, docs, sf_dir)``.

All of them keep every column of documents, whatever further columns there are,
accept repeated ids and repeated rows (which are judged alike, but for the second
stage, which keeps one), null and empty texts as said at each, very long texts
(whole), and empty tables (which stay empty).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocket.llm import decontaminate, jaccard_join, langid, pieces, pii
from sparkdocket.llm.training import fold
from sparkdocket.plans.shipping import shipped
from sparkdocket.plans.staging import stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that the model rejects go, and those without a letter or a text.

    It learns as the registered query does, from the language column of the
    documents whose id's crc32 modulo 4 is not 2.
    """
    model = langid.fit_language(docs.where(fold(F.col("doc_id"), 4) != 2))
    own = docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else f"own_{n}") for n, c in enumerate(docs.columns)])
    judged = langid.identify_language(own, model).where("accepted")
    return judged.select(*[F.col(c if c == "text" else f"own_{n}").alias(c) for n, c in enumerate(docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles at 0.8: the smallest id of each component stays.

    Texts without words (null, empty) have no near copies and stay.
    """
    return jaccard_join.keep_one_per_component(docs, k=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents in which a ten-word benchmark window occurs go; null texts stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: entities are replaced by surrogates; the character count follows the text, where there is one.

    The key is the session's ``spark.sparkdocket.pii.key``; a deployment sets its own.
    """
    replaced = pii.replace_pii(docs, key=spark.conf.get("spark.sparkdocket.pii.key", pii.DEMO_KEY), count_col=None)
    if "n_chars" not in docs.columns:
        return replaced
    kind = docs.schema["n_chars"].dataType
    changed = docs.columns
    return replaced.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)).select(*changed)


def piece_samples(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: two sampled segmentations of each document, which decode to its text.

    A null text has one row of nulls, an empty one a row without pieces.
    """
    columns = ["sample", "pieces", "n_pieces", "log_prob", "log_inclusion", "decodes"]
    return pieces.encode_samples(docs, keep=["doc_id", "lang", "source"], columns=columns)


STAGES = [
    ("language", shipped(language)),
    ("near_duplicates", shipped(near_duplicates)),
    ("benchmark_leaks", shipped(benchmark_leaks)),
    ("private_data", shipped(private_data)),
    ("piece_samples", shipped(piece_samples)),
]

#: The trained model of the first stage and the samples of the last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            written = stage(docs, f"pipeline-{name}")
            if before is not None:
                before.drop()
            docs, before = written.df, written
    return docs
