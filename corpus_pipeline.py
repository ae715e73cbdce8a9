"""A training corpus from ``documents``: toxic texts go, one of each group of near copies stays, benchmark passages and
personal data are cut out, and the rest is encoded.

Each stage is written as Parquet to the shared folder and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdlake.llm import decontaminate, neardup, pii, sentencepieces, toxicity
from mdlake.llm.tables import table
from mdlake.session import stored


BATCH_ROWS = 1000  # rows of an Arrow batch: long texts in batches of the usual 10,000 rows fill an executor outside its heap


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is above 0 with a probability below the model's limit, all their columns kept."""
    _bounded(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.where(F.col(scored.columns[-1]) < model.limit).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    _bounded(spark)
    return neardup.distinct_documents(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark passages; n_chars follows the text."""
    _bounded(spark)
    clean = decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away replaced; n_chars follows the text."""
    _bounded(spark)
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text, their number, and whether they decode to the text."""
    _bounded(spark)
    ids = sentencepieces.encode(docs, ["doc_id", "lang", "source"], verify=True)
    return ids.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_ids"), "round_trip")


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("benchmark passages", without_benchmark),
    ("personal data", without_personal_data),
    ("sentencepiece", encoded),
]

ORACLE_SQL = None  # a fitted model, components of a similarity graph and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
