"""Token counts from an exact length histogram.

Each document is encoded whole by a public byte-level BPE vocabulary and only its length is kept; lengths are aggregated
map-side into (length, documents). Sums over the histogram's suffixes then answer, for every context limit at once, the
totals: how many documents are longer, their tokens, and the tokens left when every document is cut at the limit.

Encoding is exact: the vocabulary's pattern splits a text into pieces, each piece is merged on its own, and a text's length is
the number of tokens of all its pieces. A worker builds the encoder once.

Defined results: null and empty texts have 0 tokens; very long texts are encoded whole; repeated rows count each; an empty
table gives an empty histogram; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import cut, read

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How such vocabularies split a text into pieces (a fixed value of the public format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths in one block of the two-level suffix sums.
BLOCK = 1024


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _lengths(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.value).encode_ordinary
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())], names=["doc_id", "tokens"])

    return run


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tokens`` for each row of ``docs``. The vocabulary file is read on the driver and broadcast: its size (below
    1 MB) does not depend on the data."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_lengths(shared), f"doc_id {kind}, tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """``tokens`` of each row to the histogram ``length, docs``."""
    return lengths.groupBy(F.col("tokens").alias("length")).agg(F.count(F.lit(1)).alias("docs"))


def limits(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """For every length that occurs, taken as a context limit: ``docs`` of just that length, ``docs_at_most``,
    ``docs_longer``, ``tokens_longer`` (of those, uncut), ``tokens_cut`` (of all documents, cut at the limit), ``tokens_all``
    and ``quantile`` (the share of documents that fit).

    The suffix sums have two levels: within blocks of ``block`` consecutive lengths, and over the blocks' totals."""
    hist = cut(hist.withColumn("tokens", F.col("length") * F.col("docs")).withColumn("block", F.floor(F.col("length") / block)))
    blocks = hist.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("bd", "bt")), F.sum("bd").over(Window.partitionBy()).alias("all_docs"), F.sum("bt").over(Window.partitionBy()).alias("tokens_all"))
    own = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    sums = hist.withColumn("d", F.coalesce(F.sum("docs").over(own), F.lit(0))).withColumn("t", F.coalesce(F.sum("tokens").over(own), F.lit(0))).join(blocks, "block")
    longer = F.col("d") + F.col("bd_above")
    return sums.select(
        "length", "docs", (F.col("all_docs") - longer).alias("docs_at_most"), longer.alias("docs_longer"), (F.col("t") + F.col("bt_above")).alias("tokens_longer"),
        (F.col("tokens_all") - F.col("t") - F.col("bt_above") + longer * F.col("length")).alias("tokens_cut"), "tokens_all", ((F.col("all_docs") - longer) / F.col("all_docs")).alias("quantile"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits(histogram(token_lengths(read(spark, sf_dir, "documents"))))
