"""Scans as folders of tables: stored once, read with detectors and samples pruned where they are read; and how scans are
sorted into patterns and dealt to workers.

A scan has samples (scan, det, sample, value), boresight (scan, sample, t, az, el), detectors (scan, det, ...) and cuts
(scan, det, lo, hi). A store holds many scans, in a fixed number of folders per part, to which scans are dealt by their hash.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARTS = ("samples", "boresight", "detectors", "cuts")
#: Folders of a part, however many scans there are.
SHELVES = 64


def shelf(scan: Column) -> Column:
    return F.pmod(F.xxhash64(scan), F.lit(SHELVES)).cast("int")


def write_scans(parts: dict[str, DataFrame], path: str) -> None:
    """Each part in a folder of its own, with SHELVES folders in it; each is written after one shuffle on these. In a folder rows
    lie by scan, so that few of its row groups are read for one."""
    for name in PARTS:
        if name in parts:
            rows = parts[name].withColumn("scan_shelf", shelf(F.col("scan"))).repartition("scan_shelf").sortWithinPartitions("scan_shelf", "scan")
            rows.write.mode("overwrite").partitionBy("scan_shelf").parquet(f"{path}/{name}")


@dataclass(frozen=True)
class Scans:
    """What of a store is wanted. Nothing is read before a part is asked for; then selections are filters of its scan."""

    spark: SparkSession
    path: str
    ids: tuple | None = None
    dets: tuple | None = None
    without: tuple = ()
    start: int = 0
    stop: int | None = None
    step: int = 1

    def select(self, ids: list | None = None, dets: list | None = None, without: list | None = None) -> Scans:
        """Fewer scans or detectors: lists meet those asked for before; detectors in `without` go. Ids that the store doesn't have
        are passed over."""
        met = lambda old, new: old if new is None else tuple(x for x in new if old is None or x in old)
        return replace(self, ids=met(self.ids, ids), dets=met(self.dets, dets), without=(*self.without, *(without or ())))

    def slice(self, start: int = 0, stop: int | None = None, step: int = 1) -> Scans:
        """Samples start, start + step, ... before stop, counted in what the scan shows so far."""
        if start < 0 or step < 1 or (stop is not None and stop < start):
            raise ValueError("slices of scans go forward from a place inside")
        end = None if stop is None else self.start + self.step * stop
        end = self.stop if end is None else end if self.stop is None else min(end, self.stop)
        return replace(self, start=self.start + self.step * start, stop=end, step=self.step * step)

    def part(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}")
        if self.ids is not None:
            kind = dict(df.dtypes)["scan"]
            shelves = [shelf(F.lit(x).cast(kind)) for x in self.ids]
            df = df.where(F.col("scan").isin(list(self.ids)) & F.col("scan_shelf").isin(shelves))
        df = df.drop("scan_shelf")
        if "det" in df.columns:
            df = df if self.dets is None else df.where(F.col("det").isin(list(self.dets)))
            df = df.where(~F.col("det").isin(list(self.without))) if self.without else df
        if "sample" in df.columns:
            df = df.where(F.col("sample") >= self.start)
            df = df if self.stop is None else df.where(F.col("sample") < self.stop)
            if self.step > 1:
                df = df.where((F.col("sample") - self.start) % self.step == 0)
            return df.withColumn("sample", F.floor((F.col("sample") - self.start) / self.step).cast("int"))
        if name == "cuts":  # ends round outward, so that a partly cut sample is cut
            top = F.col("hi") if self.stop is None else F.least("hi", F.lit(self.stop))
            low, high = F.greatest(F.col("lo") - self.start, F.lit(0)), top - self.start
            df = df.withColumns({"lo": F.floor(low / self.step).cast("int"), "hi": F.ceil(high / self.step).cast("int")}).where("lo < hi")
        return df


def patterns(boxes: DataFrame, id: str, axes: list[str], tol: float) -> tuple[DataFrame, DataFrame]:
    """(id with pattern number, pattern numbers with bounding boxes): scans are alike if on each axis a chain of values no more
    than tol apart links them. Values meet in bins of width tol, so what is put in order are occupied bins, not scans."""
    labels = boxes.select(id, *axes)
    for k, c in enumerate(axes):
        bins = labels.groupBy(F.floor(F.col(c) / tol).cast("long").alias("_bin")).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
        order = W.orderBy("_bin")  # as many rows as the axis is long in units of tol
        new = F.when(F.col("_lo") - F.lag("_hi").over(order) <= tol, 0).otherwise(1)
        runs = bins.withColumn("_new", new).withColumn(f"_c{k}", F.sum("_new").over(order)).select("_bin", f"_c{k}")
        labels = labels.withColumn("_bin", F.floor(F.col(c) / tol).cast("long")).join(runs, "_bin").drop("_bin")
    own = [f"_c{k}" for k in range(len(axes))]
    found = labels.groupBy(*own).agg(*[f(c).alias(f"{n}_{c}") for c in axes for n, f in (("min", F.min), ("max", F.max))])
    found = found.withColumn("pattern", F.dense_rank().over(W.orderBy(*own)) - 1)  # as many rows as there are patterns
    return labels.join(found.select(*own, "pattern"), own).select(id, "pattern"), found.drop(*own)


def balanced(scans: DataFrame, id: str, cost: str, workers: int, width: int) -> DataFrame:
    """Consecutive scans to workers of near equal cost: a scan goes where the middle of its cost lies in the running sum. Runs of
    `width` ids are summed first, so only their sums are put in one order."""
    rows = scans.select(F.col(id), F.col(cost).cast("double").alias("_cost"), F.floor(F.col(id) / width).alias("_run"))
    runs = rows.groupBy("_run").agg(F.sum("_cost").alias("_sum"))
    runs = runs.select("_run", (F.sum("_sum").over(W.orderBy("_run")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(W.partitionBy()).alias("_all"))
    middle = F.col("_before") + F.sum("_cost").over(W.partitionBy("_run").orderBy(id)) - F.col("_cost") / 2
    worker = F.least(F.lit(workers - 1), F.floor(middle * workers / F.col("_all")).cast("int"))
    return rows.join(runs, "_run").select(id, worker.alias("worker"))
