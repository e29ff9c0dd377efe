"""The session settings that the library's semantics rely on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CONF = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.sources.partitionColumnTypeInference.enabled": "false", "spark.sql.adaptive.enabled": "true"}


def session(name: str = "sparkloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (CONF | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Rows and bytes of files that a task sorts or groups at once, about.
TASK_ROWS, TASK_BYTES = 1_000_000, 16 << 20


def tasks_for(rows: int, size: int = 0) -> int:
    return max(1, -(-rows // TASK_ROWS), -(-size // TASK_BYTES))


@contextmanager
def scaled(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Shuffles into as many parts, and scans in splits as small, as so many rows of so many
    bytes need; never fewer or larger than the session has them."""
    parts, split = "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"
    before = {k: spark.conf.get(k) for k in (parts, split)}
    try:
        spark.conf.set(parts, str(max(int(before[parts]), tasks_for(rows, size))))
        if before[split].removesuffix("b").removesuffix("B").isdigit():
            spark.conf.set(split, str(min(int(before[split].rstrip("bB")), TASK_BYTES)))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
