"""Files of a folder in bounded batches, as Structured Streaming does them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def each_batch(spark: SparkSession, path: str, schema: StructType, fn: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 100, format: str = "parquet") -> None:
    """Calls ``fn`` with every batch of new files, then stops; the checkpoint remembers what
    was done, so a second call sees new files only."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(path)
    stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
