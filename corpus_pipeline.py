"""The corpus pipeline: five stages over `documents`, each one operator of probity.llm.

quality classifier -> n-gram Jaccard join -> benchmark decontamination -> PII surrogates -> mixing to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between stages
`run` writes Parquet to the shared checkpoint folder and reads it again, so that a stage's work is not lost with an executor.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm import decontamination, jaccard, mixing, pii, quality
from probity.llm.common import shared_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rule ensemble, learned from `labels`, scores below one half."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(model.of(F.col("text")) >= 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles of similarity 0.8 or more."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of `benchmark`."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars, where it is there, follows the new text."""
    out = pii.replace(docs)
    out = out.drop(out.columns[-1])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.select(docs.columns)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix asks, numbered by epoch."""
    return mixing.repeat(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii_surrogates),
    ("mixing sources to target weights", mixing_to_weights),
]

#: The classifier, the whole-text checks and the keyed surrogates have no SQL form; tests compare run() with the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. A stage's rows are removed when the next one's are written; those that the last stage reads stay."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{n}")
            docs = spark.read.parquet(f"{folder}/{n}")
        if 0 < n < len(STAGES) - 1:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n - 1}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
