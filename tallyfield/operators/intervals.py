"""Half-open integer ranges per key: tables of (key..., lo, hi). Touching ranges count as one.

Windows run within a key, so work is bounded by one key's ranges; joins with samples are on (key, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET = 1024


def merge(ranges: DataFrame, key: list[str]) -> DataFrame:
    """Union within each key: overlapping and touching ranges become one, empty ones go."""
    before = W.partitionBy(*key).orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*key).orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, 0)
    new = F.when(F.col("lo") <= F.max("hi").over(before), 0).otherwise(1)
    rows = ranges.where("lo < hi").withColumn("_new", new)
    rows = rows.withColumn("_island", F.sum("_new").over(upto))
    return rows.groupBy(*key, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def union(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return merge(a.select(*key, "lo", "hi").unionByName(b.select(*key, "lo", "hi")), key)


def union_broadcast(many: DataFrame, one: DataFrame, key: list[str], keys: DataFrame) -> DataFrame:
    """Union of each key's ranges with one keyless set of ranges."""
    everywhere = keys.select(*key).join(one.select(F.collect_list(F.struct("lo", "hi")).alias("_r")))
    return union(many, everywhere.select(*key, F.inline("_r")), key)


def invert(ranges: DataFrame, lengths: DataFrame, key: list[str]) -> DataFrame:
    """What [0, n) of each key holds besides the ranges. lengths: key..., n; keys without ranges are whole."""
    ends = merge(ranges, key).join(lengths, key).select(*key, F.greatest("lo", F.lit(0)).alias("lo"), F.least("hi", "n").alias("hi")).where("lo < hi")
    marks = ends.unionByName(lengths.select(*key, F.col("n").alias("lo"), F.col("n").alias("hi")))
    w = W.partitionBy(*key).orderBy("lo", "hi")
    return marks.select(*key, F.lag("hi", 1, 0).over(w).alias("_from"), F.col("lo").alias("hi")).where("_from < hi").withColumnRenamed("_from", "lo").select(*key, "lo", "hi")


def intersect(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Common part: positions that both cover, by counting at the ends."""
    ends = [merge(x, key).select(*key, F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("d")))).alias("e")) for x in (a, b)]
    rows = ends[0].unionByName(ends[1]).groupBy(*key, F.col("e.at").alias("lo")).agg(F.sum("e.d").alias("d"))
    w = W.partitionBy(*key).orderBy("lo")
    rows = rows.withColumn("_n", F.sum("d").over(w)).withColumn("hi", F.lead("lo").over(w))
    return rows.where("_n = 2").select(*key, "lo", "hi")


def widen(ranges: DataFrame, lengths: DataFrame, key: list[str], pre: int, post: int) -> DataFrame:
    grown = ranges.where("lo < hi").join(lengths, key)
    return merge(grown.select(*key, F.greatest(F.col("lo") - pre, F.lit(0)).alias("lo"), F.least(F.col("hi") + post, F.col("n")).alias("hi")), key)


def slice_(ranges: DataFrame, key: list[str], start: int, stop: int, step: int = 1) -> DataFrame:
    """Ranges over [start, stop) with step, re-based; ends round outward. A negative step reverses."""
    if step < 0:
        first, last = stop + 1, start + 1
        n = last - first
        turned = ranges.select(*key, (F.lit(last) - F.col("hi")).alias("lo"), (F.lit(last) - F.col("lo")).alias("hi"))
        return slice_(turned, key, 0, n, -step)
    low, high = F.greatest("lo", F.lit(start)) - start, F.least("hi", F.lit(stop)) - start
    cut = ranges.select(*key, low.alias("lo"), high.alias("hi")).where("lo < hi")
    return merge(cut.select(*key, F.floor(F.col("lo") / step).cast("int").alias("lo"), F.ceil(F.col("hi") / step).cast("int").alias("hi")), key)


def from_mask(samples: DataFrame, key: list[str], at: str, mask: Column) -> DataFrame:
    """Runs of true: consecutive positions whose position minus rank agree."""
    rows = samples.where(mask).select(*key, F.col(at).alias("_at"))
    rank = F.row_number().over(W.partitionBy(*key).orderBy("_at"))
    rows = rows.withColumn("_run", F.col("_at") - rank)
    return rows.groupBy(*key, "_run").agg(F.min("_at").alias("lo"), (F.max("_at") + 1).alias("hi")).drop("_run")


def count_runs(samples: DataFrame, key: list[str], at: str, mask: Column) -> DataFrame:
    """Number of runs of true per key, without making them."""
    before = F.lag(mask, 1, False).over(W.partitionBy(*key).orderBy(at))
    return samples.withColumn("_up", (mask & ~before).cast("int")).groupBy(*key).agg(F.sum("_up").cast("long").alias("n_runs"))


def to_mask(ranges: DataFrame, lengths: DataFrame, key: list[str]) -> DataFrame:
    """key..., at, cut for every position."""
    every = lengths.where("n > 0").select(*key, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    inside = merge(ranges, key).select(*key, F.explode(F.sequence("lo", F.col("hi") - 1)).alias("at"))
    return every.join(inside.withColumn("cut", F.lit(True)), [*key, "at"], "left").fillna({"cut": False})


def total(ranges: DataFrame, key: list[str], keys: DataFrame | None = None) -> DataFrame:
    """Covered length per key; keys without ranges count 0 if keys are given."""
    out = ranges.groupBy(*key).agg(F.sum(F.col("hi") - F.col("lo")).cast("long").alias("covered"))
    return out if keys is None else keys.select(*key).join(out, key, "left").fillna({"covered": 0})


def bucketed(ranges: DataFrame, size: int = BUCKET) -> DataFrame:
    return ranges.where("lo < hi").withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))


def contained(samples: DataFrame, ranges: DataFrame, key: list[str], at: str, how: str = "inner") -> DataFrame:
    """Samples with the range that holds them. An equi-join on (key, bucket): a range goes to the buckets it touches."""
    own = samples.withColumn("_b", F.floor(F.col(at) / BUCKET))
    inside = bucketed(ranges).withColumnRenamed("lo", "range_lo").withColumnRenamed("hi", "range_hi")
    if how == "inner":
        return own.join(inside, [*key, "_b"]).where((F.col(at) >= F.col("range_lo")) & (F.col(at) < F.col("range_hi"))).drop("_b")
    on = [own[k].eqNullSafe(inside[k]) for k in (*key, "_b")]
    cond = (own[at] >= inside["range_lo"]) & (own[at] < inside["range_hi"])
    for c in on:
        cond = cond & c
    return own.join(inside, cond, how).select(*[own[c] for c in samples.columns], inside["range_lo"], inside["range_hi"])


def sum_in_ranges(samples: DataFrame, ranges: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    return contained(samples, ranges, key, at).groupBy(*key, F.col("range_lo").alias("lo"), F.col("range_hi").alias("hi")).agg(F.sum(value).alias("total"))


def insert(samples: DataFrame, values: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Samples with the given values written over; values: key..., at, new."""
    return samples.join(values.select(*key, at, "new"), [*key, at], "left").withColumn(value, F.coalesce("new", value)).drop("new")


def full(lengths: DataFrame, key: list[str]) -> DataFrame:
    return lengths.where("n > 0").select(*key, F.lit(0).alias("lo"), F.col("n").alias("hi"))


def empty(lengths: DataFrame, key: list[str]) -> DataFrame:
    return full(lengths, key).where(F.lit(False))


def from_key_mask(lengths: DataFrame, key: list[str], mask: Column) -> DataFrame:
    """Whole keys."""
    return full(lengths.where(mask), key)


def repeat(ranges: DataFrame, key: str, n_keys: int, times: int) -> DataFrame:
    """The set of keys tiled `times` times; copy k of key d is d + k * n_keys."""
    return ranges.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(key, F.col(key) + F.col("_k") * n_keys).drop("_k")


def stack(sets: list[tuple[DataFrame, int]], key: str) -> DataFrame:
    """Sets one after the other; each comes with the number of keys before it."""
    parts = [r.withColumn(key, F.col(key) + base) for r, base in sets]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_list(ranges: DataFrame, key: list[str], keys: DataFrame) -> DataFrame:
    """Sorted array of (lo, hi) per key, empty where there is none."""
    lists = ranges.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))
    return keys.select(*key).join(lists, key, "left").withColumn("ranges", F.coalesce("ranges", F.array().cast("array<struct<lo:int,hi:int>>")))


def same(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys on which two sets differ; none if they are equal."""
    x, y = a.select(*key, "lo", "hi"), b.select(*key, "lo", "hi")
    return x.exceptAll(y).unionByName(y.exceptAll(x)).select(*key).distinct()


def remap(ranges: DataFrame, mapping: DataFrame, key: list[str], lengths: DataFrame) -> DataFrame:
    """Ranges through an index map (old, new): ends by the nearest mapped index, then widened by one."""
    low = mapping.select(F.col("old").alias("lo"), F.col("new").alias("_lo"))
    high = mapping.select((F.col("old") + 1).alias("hi"), (F.col("new") + 1).alias("_hi"))
    met = ranges.join(low, "lo").join(high, "hi").select(*key, F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    return widen(met, lengths, key, 1, 1)
