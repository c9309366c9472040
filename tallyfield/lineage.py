"""Cutting lineage in loops, and numbering rows without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read from there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a session in one process, as in tests, gets a local folder, and a cluster
    an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints/tallyfield"
    return found.rstrip("/")


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with the rows' places 0, 1, ... in an order (long)."""
    return placed(df.orderBy(*order), name)


def placed(df: DataFrame, name: str) -> DataFrame:
    """df with its rows' places 0, 1, ... as they stand (long). The rows are written once, so that their partitions stay as they
    are; a place is the row's number in its partition plus the rows of the partitions before, one number each."""
    rows = cut(df).withColumn("_at", F.monotonically_increasing_id())  # partition number and place in it
    part = F.shiftrightunsigned("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
