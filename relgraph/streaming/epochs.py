"""One epoch after another: edges that arrive as files, each micro-batch evaluated when it is complete."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def run_epochs(spark: SparkSession, source: DataFrame, deliver: Callable[[DataFrame, int], None], progress: Callable[[int], None] | None = None) -> None:
    """Feed all that ``source`` (a streaming frame) has now to ``deliver``, one call a completed micro-batch; ``progress`` is
    told of each epoch when it has been delivered."""
    at = f"{shared_dir(spark)}/epochs-{uuid.uuid4().hex}"

    def run(df: DataFrame, epoch: int) -> None:
        deliver(df, epoch)
        if progress is not None:
            progress(epoch)

    query = source.writeStream.foreachBatch(run).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()


def materialize(spark: SparkSession, source: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``transform`` of each micro-batch, appended to a table in the shared folder. A batch that is run again after a failure
    overwrites its own part."""
    to = f"{shared_dir(spark)}/epoch-results-{uuid.uuid4().hex}"
    run_epochs(spark, source, lambda df, epoch: transform(df).write.mode("overwrite").parquet(f"{to}/epoch={epoch}"))
    return spark.read.parquet(to).drop("epoch")
