"""Joins, merges and sets of labelled tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import numbered


def outer_merge(parts: list[DataFrame], id: str, fill: bool = True) -> DataFrame:
    """Full outer merge by id: booleans are OR-ed, other columns take the last part that has the row; with fill, gaps
    become false, -1 (integers) or stay null. One shuffle, whatever the number of parts."""
    kinds = {f.name: f.dataType for p in parts for f in p.schema}
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)])
    agg = []
    for name, kind in kinds.items():
        if name == id:
            continue
        if isinstance(kind, T.BooleanType):
            own = F.bool_or(name)
        else:
            own = F.max_by(name, F.when(F.col(name).isNotNull(), F.col("_part")))
        if fill:
            own = F.coalesce(own, F.lit(False)) if isinstance(kind, T.BooleanType) else F.coalesce(own, F.lit(-1).cast(kind)) if isinstance(kind, T.IntegralType) else own
        agg.append(own.alias(name))
    return rows.groupBy(id).agg(*agg)


def tag_members(members: DataFrame, id: str, tag: str, tags: list[str]) -> DataFrame:
    """(id, tag) rows to one boolean column per tag; the tags are given, so no extra pass finds them."""
    return members.groupBy(id).agg(*[F.coalesce(F.bool_or(F.col(tag) == t), F.lit(False)).alias(t) for t in tags])


def intersection(fields: list[DataFrame], det: str, sample: str) -> DataFrame:
    """Long fields (det, sample, value) on their common detectors and common sample range [max start, min end)."""
    bounds = reduce(DataFrame.unionByName, [f.agg(F.min(sample).alias("a"), (F.max(sample) + 1).alias("b")) for f in fields]).agg(F.max("a").alias("_a"), F.min("b").alias("_b"))
    dets = reduce(lambda a, b: a.join(b, det, "left_semi"), [f.select(det).distinct() for f in fields])
    named = [f.withColumn("field", F.lit(k)) for k, f in enumerate(fields)]
    rows = reduce(DataFrame.unionByName, named).join(dets, det, "left_semi").join(F.broadcast(bounds))
    return rows.where((F.col(sample) >= F.col("_a")) & (F.col(sample) < F.col("_b"))).drop("_a", "_b")


def stack_detectors(parts: list[DataFrame], det: str) -> DataFrame:
    """Union of parts with disjoint detectors; an overlap is an error in the rows' place, not silently kept."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)])
    n = (F.max("_part").over(W.partitionBy(det)) - F.min("_part").over(W.partitionBy(det)))
    clash = F.when(n != 0, F.raise_error(F.concat(F.lit("detector in two parts: "), F.col(det).cast("string")))).otherwise(F.lit(True))
    return rows.withColumn("_ok", clash).where("_ok").drop("_part", "_ok")


def restrict(field: DataFrame, det: str, wanted: DataFrame) -> DataFrame:
    """Exactly the wanted detectors, with their place `_pos` in the list; a missing one is an error."""
    out = wanted.join(field.withColumn("_there", F.lit(True)), det, "left")
    found = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("missing detector "), F.col(det).cast("string")))).otherwise(F.lit(True))
    return out.where(found).drop("_there")


def restrict_samples(field: DataFrame, sample: str, start: int, stop: int, available: tuple[int, int]) -> DataFrame:
    if start < available[0] or stop > available[1] or start > stop:
        raise ValueError("the range has to lie inside the available one")
    return field.where((F.col(sample) >= start) & (F.col(sample) < stop))


def shift(field: DataFrame, det: str, sample: str, by_det: int = 0, by_sample: int = 0) -> DataFrame:
    return field.withColumns({det: F.col(det) + by_det, sample: F.col(sample) + by_sample})


def last_source(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of the last part that has the key."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)])
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in parts[0].columns if c != key]), "_part").alias("_r")).select(key, "_r.*")


def zipped(parts: dict[str, tuple[DataFrame, list[str], str]]) -> DataFrame:
    """Heterogeneous tables as one flat vector (part, idx, value); idx is the rank by the part's order."""
    out = [numbered(df.select(*dict.fromkeys([*order, value])), order, "idx").select(F.lit(name).alias("part"), "idx", F.col(value).cast("double").alias("value")) for name, (df, order, value) in parts.items()]
    return reduce(DataFrame.unionByName, out)


def compact(links: DataFrame, ranges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (src, det, range_id) of the kept (src, det); ranges that no link uses go, and the rest are numbered anew."""
    kept = links.join(keep, ["src", "det"], "left_semi")
    used = numbered(kept.select("range_id").distinct(), ["range_id"], "new_id")
    return kept.join(used, "range_id").drop("range_id").withColumnRenamed("new_id", "range_id"), ranges.join(used, "range_id").drop("range_id").withColumnRenamed("new_id", "range_id")
