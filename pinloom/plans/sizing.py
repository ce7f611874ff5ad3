"""Sizes of plans, as the optimizer estimates them, and the choices that rest on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Broadcasts are made only of inputs whose estimated size stays below this.
BROADCAST_LIMIT = 32 << 20


#: Sizes from here on are those that Spark gives to what it can't estimate.
UNKNOWN = 1 << 55


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``. Of joins it is a product, so it serves as an upper bound only."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def input_bytes(df: DataFrame) -> int:
    """The bytes of the tables that ``df`` reads, each as often as it is read; inputs of unknown size count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(s for s in sizes if s < UNKNOWN)


def partitions_for(df: DataFrame, target_bytes: int = 32 << 20, per_byte: float = 1.0) -> int:
    """Partitions that hold about ``target_bytes`` of the input each, at least ``spark.sql.shuffle.partitions``."""
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, min(200_000, int(input_bytes(df) * per_byte / target_bytes) + 1))


def small_enough(df: DataFrame, limit: int = BROADCAST_LIMIT) -> bool:
    """Whether ``df`` may be broadcast."""
    return estimated_bytes(df) <= limit


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; only a session on one machine gets one made.

    The folder is set for checkpoints too.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return str(context._jsc.sc().getCheckpointDir().get())
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="pinloom-")
    context.setCheckpointDir(folder)
    return str(context._jsc.sc().getCheckpointDir().get())


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by checkpoint(), in the folder the session names for it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
