"""Queries on interval algebra and flags."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flags as fl
from ..operators import intervals as iv
from .base import lengths, merge_sql, ranges_sql, samples

Q: dict = {}
O: dict[str, str] = {}
KEY = ["det"]


def errs(spark: SparkSession, d: str) -> DataFrame:
    return iv.from_mask(samples(spark, d), KEY, "sample", F.col("event_type") == "error")


def high(spark: SparkSession, d: str) -> DataFrame:
    return iv.from_mask(samples(spark, d), KEY, "sample", F.col("value") > 60)


def put(name: str, f: Callable[[SparkSession, str], DataFrame], select: str, *more: str) -> None:
    Q[name], O[name] = f, re.sub(r"\bat\b", '"at"', ranges_sql(select, *more))  # AT is a keyword in one of the two dialects


INVERT = """inv AS (SELECT det, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi FROM (SELECT det, lag(hi, 1, 0) OVER (PARTITION BY det ORDER BY lo, hi) AS lo, lo AS hi FROM
 (SELECT det, lo, hi FROM errs UNION ALL SELECT det, n, n FROM lengths)) WHERE lo < hi)"""

put("mask_to_ranges", errs, "SELECT det, lo, hi FROM errs")
put("range_union", lambda s, d: iv.union(errs(s, d), high(s, d), KEY), "SELECT det, lo, hi FROM m", merge_sql("m", "SELECT det, lo, hi FROM errs UNION ALL SELECT det, lo, hi FROM high"))
put("range_invert", lambda s, d: iv.invert(errs(s, d), lengths(s, d), KEY), "SELECT det, lo, hi FROM inv", INVERT)
put("range_double_invert", lambda s, d: iv.invert(iv.invert(errs(s, d), lengths(s, d), KEY), lengths(s, d), KEY), "SELECT det, lo, hi FROM errs")
put(
    "range_intersect", lambda s, d: iv.intersect(errs(s, d), high(s, d), KEY),
    "SELECT e.det, greatest(e.lo, h.lo) AS lo, least(e.hi, h.hi) AS hi FROM errs e JOIN high h ON e.det = h.det AND e.lo < h.hi AND h.lo < e.hi",
)
put(
    "range_widen", lambda s, d: iv.widen(errs(s, d), lengths(s, d), KEY, 2, 1), "SELECT det, lo, hi FROM m",
    merge_sql("m", "SELECT det, greatest(lo - 2, 0) AS lo, least(hi + 1, n) AS hi FROM errs JOIN lengths USING (det)"),
)
put(
    "range_slice", lambda s, d: iv.slice_(errs(s, d), KEY, 5, 40, 3), "SELECT det, lo, hi FROM m",
    merge_sql("m", "SELECT det, CAST(floor((greatest(lo, 5) - 5) / 3.0) AS INT) AS lo, CAST(ceil((least(hi, 40) - 5) / 3.0) AS INT) AS hi FROM errs WHERE greatest(lo, 5) < least(hi, 40)"),
)
put(
    "range_reverse_slice", lambda s, d: iv.slice_(errs(s, d), KEY, 39, 4, -2), "SELECT det, lo, hi FROM m",
    merge_sql("m", "SELECT det, CAST(floor(greatest(40 - hi, 0) / 2.0) AS INT) AS lo, CAST(ceil(least(40 - lo, 35) / 2.0) AS INT) AS hi FROM errs WHERE greatest(40 - hi, 0) < least(40 - lo, 35)"),
)
put("range_sum", lambda s, d: iv.total(errs(s, d), KEY, lengths(s, d)), "SELECT det, CAST(coalesce(sum(hi - lo), 0) AS BIGINT) AS covered FROM lengths LEFT JOIN errs USING (det) GROUP BY 1")
put("range_count", lambda s, d: iv.count_runs(samples(s, d), KEY, "sample", F.col("event_type") == "error"), "SELECT det, CAST(count(lo) AS BIGINT) AS n_runs FROM lengths LEFT JOIN errs USING (det) GROUP BY 1")
put("range_to_mask", lambda s, d: iv.to_mask(errs(s, d), lengths(s, d), KEY), "SELECT det, sample AS at, event_type = 'error' AS cut FROM samples")
put("range_full", lambda s, d: iv.full(lengths(s, d), KEY), "SELECT det, CAST(0 AS INT) AS lo, n AS hi FROM lengths")
put("range_det_mask", lambda s, d: iv.from_key_mask(lengths(s, d), KEY, F.col("n") > 66), "SELECT det, CAST(0 AS INT) AS lo, n AS hi FROM lengths WHERE n > 66")
put("range_repeat", lambda s, d: iv.repeat(errs(s, d), "det", 1000, 3), "SELECT det + k * 1000 AS det, lo, hi FROM errs, (VALUES (0), (1), (2)) v(k)")
put("range_stack", lambda s, d: iv.stack([(errs(s, d), 0), (high(s, d), 1000)], "det"), "SELECT det, lo, hi FROM errs UNION ALL SELECT det + 1000, lo, hi FROM high")
put(
    "range_to_list", lambda s, d: iv.to_list(errs(s, d), KEY, lengths(s, d)).select("det", F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["lo"], r["hi"])), ",").alias("ranges")),
    "SELECT det, coalesce(string_agg(lo || '-' || hi, ',' ORDER BY lo) FILTER (WHERE lo IS NOT NULL), '') AS ranges FROM lengths LEFT JOIN errs USING (det) GROUP BY 1",
)
put("range_differs", lambda s, d: iv.same(errs(s, d), errs(s, d).where("det % 10 <> 3"), KEY), "SELECT DISTINCT det FROM errs WHERE det % 10 = 3")
put(
    "range_broadcast_union", lambda s, d: iv.union_broadcast(errs(s, d), s.createDataFrame([(3, 6), (20, 21)], "lo int, hi int"), KEY, lengths(s, d)), "SELECT det, lo, hi FROM m",
    merge_sql("m", "SELECT det, lo, hi FROM errs UNION ALL SELECT det, lo, hi FROM lengths, (VALUES (3, 6), (20, 21)) v(lo, hi)"),
)
put(
    "range_remap", lambda s, d: iv.remap(errs(s, d), s.range(0, 200).select(F.col("id").cast("int").alias("old"), F.floor(F.col("id") / 2).cast("int").alias("new")), KEY, lengths(s, d)), "SELECT det, lo, hi FROM m",
    merge_sql("m", "SELECT det, greatest(lo // 2 - 1, 0) AS lo, least((hi - 1) // 2 + 2, n) AS hi FROM errs JOIN lengths USING (det)"),
)
put("extract_samples", lambda s, d: iv.contained(samples(s, d).select("det", "sample", "value"), errs(s, d), KEY, "sample").select("det", "sample", "value", "range_lo"), "SELECT s.det, sample, value, lo AS range_lo FROM samples s JOIN errs e ON s.det = e.det AND sample >= lo AND sample < hi")
put("sum_samples", lambda s, d: iv.sum_in_ranges(samples(s, d), errs(s, d), KEY, "sample", "value").withColumn("total", F.round("total", 4)), "SELECT s.det, lo, hi, round(sum(value), 4) AS total FROM samples s JOIN errs e ON s.det = e.det AND sample >= lo AND sample < hi GROUP BY 1, 2, 3")


def insert_samples(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).select("det", "sample", "value")
    new = iv.contained(s, errs(spark, d), KEY, "sample").select("det", "sample", (-F.col("value")).alias("new"))
    return iv.insert(s, new, KEY, "sample", "value")


put("insert_samples", insert_samples, "SELECT det, sample, CASE WHEN event_type = 'error' THEN -value ELSE value END AS value FROM samples")


# ---- flags: bit 0 error, bit 1 high value, change points where the pair changes

NAMES = ["error", "high"]
POINTS = """points AS (SELECT det, CAST(sample AS INT) AS at, f AS flags FROM (SELECT det, sample, f, lag(f) OVER (PARTITION BY det ORDER BY sample) AS p FROM
 (SELECT det, sample, CAST((event_type = 'error')::INT + 2 * (value > 60)::INT AS BIGINT) AS f FROM samples)) WHERE p IS NULL OR p <> f)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    bits = (F.col("event_type") == "error").cast("bigint") + 2 * (F.col("value") > 60).cast("bigint")
    s = samples(spark, d).select("det", "sample", bits.alias("flags"))
    s = s.withColumn("p", F.lag("flags").over(W.partitionBy("det").orderBy("sample")))
    return s.where(F.col("p").isNull() | (F.col("p") != F.col("flags"))).select("det", F.col("sample").alias("at"), "flags")


put("flag_points", points, "SELECT det, at, flags FROM points", POINTS)
put("flag_count_ranges", lambda s, d: fl.count_ranges(points(s, d), NAMES), "SELECT 'error' AS flag, count(*) AS n FROM points WHERE flags % 2 = 1 UNION ALL SELECT 'high', count(*) FROM points WHERE flags >= 2", POINTS)
put("flag_select", lambda s, d: fl.select(points(s, d), NAMES, "high,~error"), "SELECT det, at, CAST(flags = 2 AS BIGINT) AS flags FROM points", POINTS)
put("flag_derived", lambda s, d: fl.select(points(s, d), NAMES, "!clean", {"clean": (2, 1)}), "SELECT det, at, CAST(NOT flags = 2 AS BIGINT) AS flags FROM points", POINTS)
# flags hold to each detector's own end

HELD = "held AS (SELECT det, at, flags, coalesce(lead(at) OVER (PARTITION BY det ORDER BY at), n) AS until FROM points JOIN lengths USING (det))"
put(
    "flag_count_samples", lambda s, d: fl.count_samples(points(s, d), KEY, NAMES, lengths(s, d), KEY),
    "SELECT det, 'error' AS flag, CAST(sum(CASE WHEN flags % 2 = 1 THEN until - at ELSE 0 END) AS BIGINT) AS n FROM held GROUP BY 1 UNION ALL SELECT det, 'high', CAST(sum(CASE WHEN flags >= 2 THEN until - at ELSE 0 END) AS BIGINT) FROM held GROUP BY 1",
    POINTS, HELD,
)
put("flag_to_ranges", lambda s, d: fl.to_ranges(points(s, d), KEY, lengths(s, d)), "SELECT det, lo, hi FROM m", POINTS, HELD, merge_sql("m", "SELECT det, at AS lo, until AS hi FROM held WHERE flags <> 0"))
put(
    "flag_from_ranges", lambda s, d: fl.from_ranges(errs(s, d), lengths(s, d), KEY, lengths(s, d)),
    "SELECT det, at, max(f) AS flags FROM (SELECT det, lo AS at, CAST(1 AS BIGINT) AS f FROM errs UNION ALL SELECT det, hi, 0 FROM errs UNION ALL SELECT det, 0, 0 FROM lengths) JOIN lengths USING (det) WHERE at < n GROUP BY 1, 2",
)
put(
    "flag_restrict", lambda s, d: fl.restrict(points(s, d), KEY, 10, 30),
    "SELECT det, CAST(0 AS INT) AS at, arg_max(flags, at) AS flags FROM points WHERE at <= 10 GROUP BY 1 UNION ALL SELECT det, at - 10, flags FROM points WHERE at > 10 AND at < 30", POINTS,
)


def flag_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two flag sets with other names: aligned points, held forward, bits under the union of names."""
    one = fl.select(points(spark, d), NAMES, "error")
    two = fl.select(points(spark, d).where("at % 2 = 0"), NAMES, "high")
    merged, names = fl.merge([(one, ["zz_error"]), (two, ["aa_high"])], KEY)
    assert names == ["aa_high", "zz_error"]
    return merged


put(
    "flag_merge", flag_merge,
    """SELECT det, at, CAST(2 * coalesce(last_value(a IGNORE NULLS) OVER w, 0) + coalesce(last_value(b IGNORE NULLS) OVER w, 0) AS BIGINT) AS flags FROM
 (SELECT det, at, flags % 2 AS a, CASE WHEN at % 2 = 0 THEN flags // 2 END AS b FROM points) WINDOW w AS (PARTITION BY det ORDER BY at ROWS UNBOUNDED PRECEDING)""", POINTS,
)

QUERIES, ORACLE = Q, O
