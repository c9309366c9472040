"""What the operators share: reading tables, the shared scratch folder, row keys, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word: space and the controls from tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
#: The same set as a Java regular expression.
BLANK_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. If it is unset, a session in one process, as in
    tests, gets a local one; on a cluster, where no local folder is shared, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints/tallyfield"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """df written to the shared folder and read again: later jobs neither compute it again nor lose it with an executor.

    Unless wide, it is written by two tasks a core at most, which take shuffle partitions one after the other: loops
    over small tables would otherwise write a file for each of very many partitions in each round.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df if wide else df.coalesce(2 * spark.sparkContext.defaultParallelism)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes the folders of frames made by stage() that no later job reads, so that loops don't pile up tables."""
    for df in frames:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few dozen bytes that a broadcast side may have; larger sides are shuffled.
BROADCAST_ROWS = 500_000


def narrow(side: DataFrame, cells: Column | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored join side, marked for broadcast if it has at most `most` rows (and array cells, if given); the join
    finds another way for a larger one."""
    total = F.sum(cells) if cells is not None else F.count(F.lit(1))
    rows, size = side.agg(F.count(F.lit(1)), total).first()
    return F.broadcast(side) if rows <= most and (size or 0) <= 4 * most else side


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words (runs of characters outside BLANKS); empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RE), lambda w: w != "")


def row_key(*columns: str) -> list[Column]:
    """128 bits of a row's content, as two longs. Rows equal in these columns share a key."""
    cols = [F.col(c) for c in columns]
    nulls = [c.isNull() for c in cols]
    return [F.xxhash64(F.lit(11), *nulls, *cols).alias("_k1"), F.xxhash64(F.lit(23), *cols, *nulls).alias("_k2")]


def fresh(df: DataFrame, *wanted: str) -> dict[str, str]:
    """Names for helper columns that clash with none of df's."""
    there = {c.lower() for c in df.columns}
    out = {}
    for name in wanted:
        own = name
        while own.lower() in there:
            own = f"_{own}"
        there.add(own.lower())
        out[name] = own
    return out
