"""Filters of ordered samples (scan, det, sample, value), and the linear pieces of a map maker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Filter = Callable[[DataFrame], DataFrame]


def chain(*filters: Filter) -> Filter:
    def run(df: DataFrame) -> DataFrame:
        for f in filters:
            df = f(df)
        return df

    return run


def scale(df: DataFrame, value: str, k: float) -> DataFrame:
    return df.withColumn(value, F.col(value) * k)


def common(df: DataFrame, block: list[str], at: str, value: str, least: int = 1, keep: bool = False, robust: bool = False) -> DataFrame:
    """Subtracts (or keeps) the mean or median over a block's detectors at each place; smaller blocks stay."""
    w = [*block, at]
    mean = df.groupBy(*w).agg((F.median if robust else F.avg)(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    out = df.join(mean, w)
    use = F.col("_n") >= least
    return out.withColumn(value, F.when(use, F.col("_m") if keep else F.col(value) - F.col("_m")).otherwise(F.col(value))).select(*df.columns)


def by_phase(df: DataFrame, block: list[str], direction: Column, az: Column, daz: float, value: str) -> DataFrame:
    """Subtracts the mean per block, direction and azimuth bin."""
    rows = df.withColumn("_d", direction).withColumn("_b", F.floor(az / daz))
    mean = rows.groupBy(*block, "_d", "_b").agg(F.avg(value).alias("_m"))
    return rows.join(mean, [*block, "_d", "_b"]).withColumn(value, F.col(value) - F.col("_m")).select(*df.columns)


def deslope(df: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Subtracts the line through the first and last sample."""
    ends = df.groupBy(*key).agg(F.min_by(value, at).alias("_a"), F.max_by(value, at).alias("_b"), F.min(at).alias("_t0"), F.max(at).alias("_t1"))
    line = F.col("_a") + F.coalesce(F.try_divide((F.col("_b") - F.col("_a")) * (F.col(at) - F.col("_t0")), F.col("_t1") - F.col("_t0")), F.lit(0.0))
    return df.join(ends, key).withColumn(value, F.col(value) - line).select(*df.columns)


def detrend(df: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Subtracts the least-squares line per key."""
    fit = df.groupBy(*key).agg(F.coalesce(F.regr_slope(value, at), F.lit(0.0)).alias("_s"), F.avg(value).alias("_m"), F.avg(at).alias("_t"))
    return df.join(fit, key).withColumn(value, F.col(value) - F.col("_m") - F.col("_s") * (F.col(at) - F.col("_t"))).select(*df.columns)


def regress(df: DataFrame, key: list[str], value: str, template: str, subtract: bool = True) -> DataFrame:
    """Amplitude sum(d c) / sum(c c) of a template per key; subtracted, or returned beside the samples as `amp`."""
    amp = df.groupBy(*key).agg(F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(template)), F.sum(F.col(template) * F.col(template))), F.lit(0.0)).alias("amp"))
    out = df.join(amp, key)
    return out.withColumn(value, F.col(value) - F.col("amp") * F.col(template)).drop("amp") if subtract else out


def gain_fit(df: DataFrame, det: str, at: str, value: str) -> DataFrame:
    """Gain of each detector against the median over detectors."""
    mode = df.groupBy(at).agg(F.median(value).alias("_c"))
    return df.join(mode, at).groupBy(det).agg(F.try_divide(F.sum(F.col(value) * F.col("_c")), F.sum(F.col("_c") * F.col("_c"))).alias("gain"))


def replace_gain(df: DataFrame, old: DataFrame, new: DataFrame, det: str, value: str) -> DataFrame:
    """Values times new / old gain per detector."""
    ratio = old.select(det, F.col("gain").alias("_o")).join(new.select(det, F.col("gain").alias("_n")), det)
    return df.join(ratio, det).withColumn(value, F.col(value) * F.try_divide("_n", "_o")).select(*df.columns)


def spoil(df: DataFrame, det: str, value: str, sigma: float, seed: int) -> DataFrame:
    """Gain errors that depend on the detector and the seed alone: a triangular draw of width sigma from two hashes."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col(det)), F.lit(1 << 20)) / float(1 << 20)
    return df.withColumn(value, F.col(value) * (1 + F.lit(sigma) * (u(1) + u(2) - 1) * 6**0.5))


def add_map(df: DataFrame, grid: DataFrame, cell: list[str], value: str, k: float = 1.0) -> DataFrame:
    """Adds k times the grid's value at each sample's cell."""
    got = grid.select(*cell, F.col("map_value").alias("_g"))
    return df.join(got, cell, "left").withColumn(value, F.col(value) + k * F.coalesce("_g", F.lit(0.0))).select(*df.columns)


def taper(df: DataFrame, key: list[str], at: str, value: str, width: int, inverse: bool = False) -> DataFrame:
    from .sequences import taper as weights

    w = weights(key, at, width)
    return df.withColumn(value, F.col(value) / w if inverse else F.col(value) * w)


def iterate_common(df: DataFrame, block: list[str], det: str, at: str, value: str, rounds: int = 3) -> DataFrame:
    """Weighted mean over detectors at each place, weights from the residuals' variance, repeated; column `common`."""
    rows = df.withColumn("_w", F.lit(1.0))
    for k in range(rounds):
        mean = rows.groupBy(*block, at).agg(F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias("common"))
        rows = rows.drop("common").join(mean, [*block, at])
        if k + 1 < rounds:
            var = rows.groupBy(*block, det).agg(F.var_pop(F.col(value) - F.col("common")).alias("_v"))
            rows = rows.drop("_w").join(var, [*block, det]).withColumn("_w", F.coalesce(F.try_divide(F.lit(1.0), F.col("_v")), F.lit(0.0))).drop("_v")
    return rows.drop("_w")


def row_means_penalty(grid: DataFrame, value: str, epsilon: float) -> DataFrame:
    """Prior against horizontal stripes: epsilon times the mean of each row, at every cell."""
    mean = F.avg(value).over(W.partitionBy("y"))
    return grid.withColumn("prior", epsilon * mean)


def norm_penalty(grid: DataFrame, value: str, epsilon: float) -> DataFrame:
    return grid.withColumn("prior", epsilon * F.col(value))


def chisq(df: DataFrame, key: list[str], value: str, model: str, ivar: str) -> DataFrame:
    """Weighted sum of squared residuals per key."""
    return df.groupBy(*key).agg(F.sum((F.col(value) - F.col(model)) ** 2 * F.col(ivar)).alias("chisq"))


def chisq_update(old: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Earlier sums, with those of changed keys replaced."""
    return old.join(fresh.select(*key), key, "left_anti").unionByName(fresh)
