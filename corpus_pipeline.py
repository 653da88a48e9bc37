"""Clean-up of a corpus: toxicity, near duplicates, repeated passages, leaks, round trip.

Each stage takes (spark, docs, sf_dir) and gives what it keeps; ``run`` stores
each stage's result before the next one reads it.  All stages but the last
return the columns of documents; the last adds the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanewise.llm import leaks, neardups, repeats, sentencepieces, toxicity
from lanewise.plans.frozen import written
from lanewise.session import with_folder

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20  # rows sent to a Python worker at once; the default is 64 MB


def ready(spark: SparkSession) -> SparkSession:
    """The session with a folder, and with small Arrow batches unless smaller ones are set.

    Memory outside the heap stays with a JVM that has used it, so it grows with
    the largest batch of any stage.
    """
    if not 0 < int(spark.conf.get(BATCH).rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")
    return with_folder(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted as toxic; learned from the labels."""
    ready(spark)
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    ready(spark)
    return neardups.keep_one(docs, words=5, numerator=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller doc_id has as well."""
    ready(spark)
    return repeats.cut(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ready(spark)
    return leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids; the text is what the ids decode to."""
    return sentencepieces.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", one_of_near_duplicates),
    ("repeated passages", cut_repeats),
    ("benchmark leaks", drop_leaks),
    ("sentence pieces", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
