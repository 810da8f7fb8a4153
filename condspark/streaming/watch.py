"""Pruning of files as they arrive; an addition that batch users don't need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocks


def watch(spark: SparkSession, path: str, targets: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Prune each new Parquet file of (path, code) rows for every target (target, macros).

    A file's state ends with the file, so no watermark is needed; a batch is pruned as a whole.
    """
    files = spark.readStream.schema("path string, code string").parquet(path)

    def each(batch: DataFrame, number: int) -> None:
        n = batch.count()
        if n:
            pairs = batch.join(targets, how="cross")  # each file for each stated target
            sink(blocks.prune(pairs), number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
