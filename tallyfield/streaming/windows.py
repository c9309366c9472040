"""Streaming forms of the batch operators: sessions, tumbling sums, running moments, de-duplication. An extension; the
batch operators are the definition, and each function here takes a streaming or a static table alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of event files (Parquet) with their batch schema: one file, or a folder of them."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        path, _, name = path.rpartition("/")
        rows = rows.option("pathGlobFilter", name)
    return rows.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(rows: DataFrame, key: str, at: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions per key that end after a gap; rows later than the watermark are left out."""
    own = rows.withWatermark(at, late) if rows.isStreaming else rows
    out = own.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(rows: DataFrame, key: list[str], at: str, width: str, value: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    own = rows.withWatermark(at, late) if rows.isStreaming else rows
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = own.groupBy(*key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(*key, F.col("w.start").alias("start"), "n", "total")


def first_of(rows: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """First row of each key within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(key) if rows.isStreaming else rows.dropDuplicates(key)


def moments(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Running n, mean and deviation per key; the state is the sums that these need."""
    return rows.groupBy(F.col(key).alias("name")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("dev"))


def run_to_end(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Drives a stream through all there is and returns what it put out: batches are written under a folder that driver and
    executors share, each over the last one if the mode is complete, and read from there."""
    spark, out = stream.sparkSession, f"{folder}/out"
    spark.createDataFrame([], stream.schema).write.parquet(out)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
