"""How many partitions a table needs, from the size that the optimizer estimates for it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: Bytes of a partition that a task may hold in Python, with what it makes of them.
TASK_BYTES = 64 << 20
#: The optimizer's estimate for what it knows nothing of is about 2^63; no table is as large as this.
UNKNOWN = 1 << 55
#: No plan gets more partitions than this.
MOST = 400_000


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """The session's number of shuffle partitions, or more if they would hold more than ``task_bytes`` each."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = estimated_bytes(df)
    if size >= UNKNOWN:  # rows from the driver or an RDD: as many as it has now
        return max(least, df._jdf.queryExecution().toRdd().getNumPartitions())
    return max(least, min(MOST, math.ceil(size / task_bytes)))
