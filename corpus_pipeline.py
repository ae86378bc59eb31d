"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

1. toxicity: documents that the classifier predicts toxic go.
2. line dedup: repeated lines go from the texts; documents that lose all their words this way go.
3. near duplicates: one document of each group stays.
4. decontamination: documents with a benchmark window go.
5. mixing: what each source gives to the mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import decontaminate, lines, mixing, near, toxicity
from runledger.llm.arrow import prepare
from runledger.session import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic. The classifier learns from the labelled ones that are left of `documents`."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with later similar lines taken out, n_chars brought up to date. Nothing is left of a copy, so it goes."""
    prepare(spark)
    out = lines.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (mixing.word_count(F.col("text")) == 0)
    n_chars = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return out.where(~emptied).withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by five-word shingles, that of the smallest id."""
    prepare(spark)
    return near.drop_near_duplicates(docs, width=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each (`taken`, repeats counted) and its source's target."""
    prepare(spark)
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
ORACLE_SQL = None  # the first stage is a trained model; tests/llm compares run() with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = _table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
