"""Filling gaps (ranges) of ordered samples: (key..., at, value). Strategies are looked up by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import cut as cut_lineage
from . import intervals, lowrank
from .sequences import running_median


def marked(samples: DataFrame, ranges: DataFrame, key: list[str], at: str) -> DataFrame:
    """samples with `cut`, and the gap's bounds where cut."""
    held = intervals.contained(samples, intervals.merge(ranges, key), key, at, "left")
    return held.withColumn("cut", F.col("range_lo").isNotNull())


def constant(samples: DataFrame, ranges: DataFrame, key: list[str], at: str, value: str, fill: float = 0.0) -> DataFrame:
    rows = marked(samples, ranges, key, at)
    return rows.withColumn(value, F.when(F.col("cut"), F.lit(fill)).otherwise(F.col(value))).select(*samples.columns)


def nothing(samples: DataFrame, ranges: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    return samples


def linear(samples: DataFrame, ranges: DataFrame, key: list[str], at: str, value: str, context: int = 10) -> DataFrame:
    """A line between the means of up to `context` uncut samples on either side, which don't reach across the next gap;
    with one side only its mean, with neither 0. The line runs through the two contexts' centres of mass."""
    rows = marked(samples, ranges, key, at)
    # The gap behind and the gap ahead of each sample; a cut sample's own gap is both.
    back, ahead = (W.partitionBy(*key).orderBy(at).rowsBetween(a, b) for a, b in ((W.unboundedPreceding, 0), (0, W.unboundedFollowing)))
    rows = rows.withColumns({"_blo": F.last("range_lo", True).over(back), "_bhi": F.last("range_hi", True).over(back), "_ahead": F.first("range_lo", True).over(ahead)})
    before = ~F.col("cut") & (F.col(at) >= F.col("_ahead") - context)
    after = ~F.col("cut") & (F.col(at) < F.col("_bhi") + context)
    means = {}
    for k, near, gap in ((0, before, "_ahead"), (1, after, "_blo")):
        w = W.partitionBy(*key, gap)
        means |= {f"_v{k}": F.avg(F.when(near, F.col(value))).over(w), f"_t{k}": F.avg(F.when(near, F.col(at))).over(w)}
    rows = rows.withColumns(means)
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(at) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    fill = F.coalesce(line, F.col("_v0"), F.col("_v1"), F.lit(0.0))
    return rows.withColumn(value, F.when(F.col("cut"), fill).otherwise(F.col(value))).select(*samples.columns)


def common(samples: DataFrame, ranges: DataFrame, key: list[str], at: str, value: str, inner: Callable[..., DataFrame] = linear) -> DataFrame:
    """Fills what is left after the mean of the uncut keys at each place is taken off, and adds it back."""
    rows = marked(samples, ranges, key, at)
    mean = rows.where("NOT cut").groupBy(at).agg(F.avg(value).alias("_mean"))
    off = samples.join(mean, at, "left").withColumn("_mean", F.coalesce("_mean", F.lit(0.0))).withColumn(value, F.col(value) - F.col("_mean"))
    return inner(off, ranges, key, at, value).withColumn(value, F.col(value) + F.col("_mean")).select(*samples.columns)


def pair(samples: DataFrame, ranges: DataFrame, key: str, at: str, value: str, partner: Column, inner: Callable[..., DataFrame] = linear) -> DataFrame:
    """Pairs of keys: where both are cut, their difference is filled; where one is, it is the other's value plus the filled difference."""
    rows = marked(samples.withColumn("_p", partner), ranges, [key], at).select(key, "_p", at, value, "cut")
    other = rows.select(F.col(key).alias("_p"), at, F.col(value).alias("_ov"), F.col("cut").alias("_oc"))
    met = rows.join(other, ["_p", at], "left")
    diff = met.select(key, at, (F.col(value) - F.col("_ov")).alias("_d")).where("_d IS NOT NULL")
    filled = inner(diff, ranges.select(key, "lo", "hi").unionByName(ranges.join(rows.select(key, "_p").distinct(), key).select(F.col("_p").alias(key), "lo", "hi")), [key], at, "_d")
    out = met.join(filled, [key, at], "left")
    return out.withColumn(value, F.when(F.col("cut") & ~F.coalesce("_oc", F.lit(True)), F.col("_ov") + F.col("_d")).otherwise(F.col(value))).select(key, at, value)


def spikes(samples: DataFrame, key: list[str], at: str, value: str, sigma: float = 10.0, half: int = 7, padding: int = 7, noise: float | None = None) -> DataFrame:
    """Ranges of samples that stray from a running median by more than sigma times the noise (the key's median absolute
    deviation if none is given), padded."""
    w = W.partitionBy(*key).orderBy(at)
    rows = samples.withColumn("_d", F.abs(F.col(value) - running_median(F.col(value), w.rowsBetween(-half, half))))
    level = F.lit(noise) if noise is not None else F.col("_mad")
    if noise is None:
        rows = rows.join(rows.groupBy(*key).agg((1.4826 * F.median("_d")).alias("_mad")), key)
    lengths = samples.groupBy(*key).agg((F.max(at) + 1).cast("int").alias("n"))
    return intervals.widen(intervals.from_mask(rows, key, at, F.col("_d") > sigma * level), lengths, key, padding, padding)


def deglitch(samples: DataFrame, key: list[str], at: str, value: str, sigma: float = 10.0, half: int = 7, padding: int = 7) -> DataFrame:
    return linear(samples, spikes(samples, key, at, value, sigma, half, padding), key, at, value)


def eigenmodes(samples: DataFrame, ranges: DataFrame, group: str, key: str, at: str, value: str, threshold: float = 4.0, rounds: int = 4) -> DataFrame:
    """Fills gaps from the strong joint modes of a group's keys, iterated from a linear start: those whose variance is over
    `threshold` times the median mode's. Each round factorises all groups' samples in blocks; samples that a key lacks count as its mean."""
    start = linear(samples, ranges, [group, key], at, value)
    rows = cut_lineage(marked(start, ranges, [group, key], at).select(group, key, at, value, "cut"))
    for _ in range(rounds):
        model = lowrank.strong_model(rows, [group], key, at, value, threshold)
        rows = cut_lineage(model.select(group, key, at, F.when(F.col("cut"), F.col("_model")).otherwise(F.col(value)).alias(value), "cut"))
    return rows.drop("cut")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"linear": linear, "common": common, "constant": constant, "none": nothing}


def fill(name: str, *args: object, **more: object) -> DataFrame:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[name](*args, **more)
