"""A training-data pipeline: toxicity, exact dedup, near dedup, decontamination, mixing. Each stage works on all that the one
before it kept, and its result is written to the shared folder and read again as the next one's documents.

Defined results: a filtering stage returns rows of its input unchanged, with all their columns, whatever these are called;
rows that repeat another one entirely go in the exact dedup; an empty table passes through every stage. The last stage returns
one row for each document that is left, with its id, source, size and number of copies, without its text (see ``mixing.mix``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.llm import decontamination, exact_dedup, mixing, ngram_join, toxicity
from relgraph.llm.session import delete, document_key, ensure_checkpoint_dir, read


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text are not named by ``bad`` (``key``, see :func:`_keyed`). Rows travel as one struct,
    so that no column of theirs can clash with the key."""
    rows = docs.select(F.struct("*").alias("row"), document_key().alias("key"))
    return rows.join(bad.select("key"), "key", "left_anti").select("row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """The narrow input of an operator: a key of id and text, 128 bits, in place of the id, so that rows with one id, or without, are
    judged each by its own text."""
    return docs.select(document_key().alias("doc_id"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go; it learns from the labelled documents outside the held-out fifth."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return _without(docs, toxicity.score_documents(_keyed(docs), model).filter("predicted = 1").select(F.col("doc_id").alias("key")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by n-gram similarity, one stays: the one with the smallest key."""
    classes = ngram_join.link_classes(_keyed(docs))
    # the smallest key of a group is its class id, and that document stays
    return _without(docs, classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("key")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document so that the sources come to their target tokens."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Model scores and near-duplicate groups are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table goes when the next one is written; the last one stays, as the result reads it."""
    docs, base, before = read(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(to := f"{base}/{k}-{name}")
            docs = spark.read.parquet(to)
            if before is not None:
                delete(spark, before)
            before = to
    return docs
