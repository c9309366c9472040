"""Flags as change points: (key..., at, flags), a bit set that holds from `at` to the next point. Bits are numbered by name order."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import intervals


def before_end(rows: DataFrame, key: list[str], n: int | DataFrame) -> DataFrame:
    """Rows with `at` before the end of their key, which is added as `_n`. n: one length for all keys, or a table of key..., n."""
    if isinstance(n, DataFrame):
        return rows.join(n.select(*key, F.col("n").alias("_n")), key).where(F.col("at") < F.col("_n"))
    return rows.withColumn("_n", F.lit(n)).where(F.col("at") < n)


def with_end(points: DataFrame, key: list[str], n: int | DataFrame) -> DataFrame:
    if isinstance(n, DataFrame):
        rows = before_end(points, key, n)
        return rows.withColumn("until", F.coalesce(F.lead("at").over(W.partitionBy(*key).orderBy("at")), "_n")).drop("_n")
    return points.withColumn("until", F.lead("at", 1, n).over(W.partitionBy(*key).orderBy("at")))


def mask_of(names: list[str], wanted: list[str]) -> int:
    return sum(1 << names.index(w) for w in wanted)


def derived(column: str, include: int, exclude: int) -> Column:
    """A derived flag: some bit of include, and none of exclude."""
    return (F.col(column).bitwiseAND(include) != 0) & (F.col(column).bitwiseAND(exclude) == 0)


def select(points: DataFrame, names: list[str], expression: str, derived_masks: dict[str, tuple[int, int]] = {}) -> DataFrame:  # noqa: B006
    """Flag expression such as `a,~b`: every named condition has to hold; becomes one flag bit. `!` negates like `~`."""
    conds = []
    for part in (p.strip() for p in expression.split(",") if p.strip()):
        bare = re.sub(r"^[~!]", "", part)
        if bare in derived_masks:
            cond = derived("flags", *derived_masks[bare])
        elif bare in names:
            cond = F.col("flags").bitwiseAND(1 << names.index(bare)) != 0
        else:
            raise ValueError(f"unknown flag {bare}")
        conds.append(~cond if part[0] in "~!" else cond)
    return points.withColumn("flags", reduce(lambda a, b: a & b, conds, F.lit(True)).cast("bigint"))


def to_ranges(points: DataFrame, key: list[str], n: int | DataFrame) -> DataFrame:
    """Ranges where any flag is set."""
    rows = with_end(points, key, n).where("flags <> 0").select(*key, F.col("at").alias("lo"), F.col("until").alias("hi"))
    return intervals.merge(rows, key)


def from_ranges(ranges: DataFrame, lengths: DataFrame, key: list[str], n: int | DataFrame, offset: int = 0) -> DataFrame:
    """One flag, on inside the ranges; every key starts with a point at 0."""
    ends = intervals.merge(ranges, key).select(*key, F.explode(F.array(F.struct((F.col("lo") + offset).alias("at"), F.lit(1).alias("flags")), F.struct((F.col("hi") + offset).alias("at"), F.lit(0).alias("flags")))).alias("e"))
    rows = before_end(ends.select(*key, "e.at", "e.flags"), key, n).drop("_n")
    start = lengths.select(*key, F.lit(0).alias("at"), F.lit(0).alias("flags"))
    return rows.unionByName(start).groupBy(*key, "at").agg(F.max("flags").cast("bigint").alias("flags"))


def count_ranges(points: DataFrame, names: list[str], per: list[str] = []) -> DataFrame:  # noqa: B006
    """Change points with each flag on."""
    each = F.array(*[F.struct(F.lit(x).alias("flag"), F.col("flags").bitwiseAND(1 << k).cast("boolean").cast("int").alias("on")) for k, x in enumerate(names)])
    return points.select(*per, F.explode(each).alias("e")).groupBy(*per, "e.flag").agg(F.sum("e.on").cast("long").alias("n"))


def count_samples(points: DataFrame, key: list[str], names: list[str], n: int | DataFrame, per: list[str] = []) -> DataFrame:  # noqa: B006
    """Samples with each flag on; the last point holds to n, or to its key's length."""
    rows = with_end(points, key, n).withColumn("_len", F.col("until") - F.col("at"))
    each = F.array(*[F.struct(F.lit(x).alias("flag"), F.when(F.col("flags").bitwiseAND(1 << k) != 0, F.col("_len")).otherwise(0).alias("on")) for k, x in enumerate(names)])
    return rows.select(*per, F.explode(each).alias("e")).groupBy(*per, "e.flag").agg(F.sum("e.on").cast("long").alias("n"))


def merge(sets: list[tuple[DataFrame, list[str]]], key: list[str]) -> tuple[DataFrame, list[str]]:
    """Several flag sets as one: points are united, each set's flags held forward, bits renumbered under the union of names."""
    names = sorted({x for _, own in sets for x in own})
    parts = []
    for k, (points, own) in enumerate(sets):
        moved = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col("flags").bitwiseAND(1 << i) != 0, F.lit(1 << names.index(x))).otherwise(0) for i, x in enumerate(own)], F.lit(0))
        parts.append(points.select(*key, "at", F.lit(k).alias("_set"), moved.cast("bigint").alias("_f")))
    rows = reduce(DataFrame.unionByName, parts)
    wide = rows.groupBy(*key, "at").agg(*[F.max(F.when(F.col("_set") == k, F.col("_f"))).alias(f"_f{k}") for k in range(len(sets))])
    w = W.partitionBy(*key).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    held = [F.coalesce(F.last(f"_f{k}", True).over(w), F.lit(0)) for k in range(len(sets))]
    return wide.select(*key, "at", reduce(lambda a, b: a.bitwiseOR(b), held).cast("bigint").alias("flags")), names


def restrict(points: DataFrame, key: list[str], start: int, stop: int) -> DataFrame:
    """Points of [start, stop), re-based; the state in force at start is kept."""
    before = points.where(F.col("at") <= start).groupBy(*key).agg(F.max_by("flags", "at").alias("flags")).select(*key, F.lit(0).alias("at"), "flags")
    inside = points.where((F.col("at") > start) & (F.col("at") < stop)).select(*key, (F.col("at") - start).alias("at"), "flags")
    return before.unionByName(inside)
