"""Queries on ordered samples: sequences, gap filling, filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters as fi
from ..operators import gapfill as gf
from ..operators import intervals as iv
from ..operators import sequences as sq
from .base import ERRORS_SQL, lengths, LENGTHS, merge_sql, nudged, rounded, runs_sql, SAMPLES, samples, table

Q: dict = {}
O: dict[str, str] = {}
KEY = ["det"]


def put(name: str, f: Callable[[SparkSession, str], DataFrame], select: str, *more: str) -> None:
    Q[name] = f
    O[name] = "WITH " + ",\n".join([SAMPLES, *more]) + "\n" + select


put("scan_dir", lambda s, d: samples(s, d).select("det", "sample", sq.direction("value", KEY, "sample").alias("dir")), "SELECT det, sample, CAST(CASE WHEN value < lag(value) OVER (PARTITION BY det ORDER BY sample) THEN 2 ELSE 1 END AS INT) AS dir FROM samples")
put(
    "scan_dir_ahead", lambda s, d: samples(s, d).select("det", "sample", sq.direction_ahead("value", KEY, "sample", 3).alias("up")),
    "SELECT det, sample, coalesce(last_value(u IGNORE NULLS) OVER (PARTITION BY det ORDER BY sample ROWS UNBOUNDED PRECEDING), false) AS up FROM (SELECT det, sample, lead(value, 3) OVER (PARTITION BY det ORDER BY sample) > value AS u FROM samples)",
)
UPS = """mid AS (SELECT *, (min(value) OVER (PARTITION BY det) + max(value) OVER (PARTITION BY det)) / 2 AS m, lag(value) OVER (PARTITION BY det ORDER BY sample) AS b FROM samples),
 ups AS (SELECT det, sample, sample - lag(sample) OVER (PARTITION BY det ORDER BY sample) AS g FROM mid WHERE b < m AND value >= m)"""
put("up_crossings", lambda s, d: sq.up_crossings(samples(s, d), KEY, "sample", "value").select("det", "sample"), "SELECT det, sample FROM ups", UPS)
put("scan_period", lambda s, d: sq.period(samples(s, d), KEY, "sample", "value", 2), "SELECT det, CAST(median(g) AS DOUBLE) AS period, count(*) AS n_gaps FROM ups WHERE g >= 2 GROUP BY 1", UPS)
SESS = """ses AS (SELECT det, session, min(t) AS start, max(t) AS "end", count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY det ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM
 (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY det ORDER BY t) <= 43200 AND abs(value - lag(value) OVER (PARTITION BY det ORDER BY t)) <= 80 THEN 0 ELSE 1 END AS f FROM samples)) GROUP BY 1, 2)"""


def sess(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("u", F.col("t"))
    return sq.sessions(s, KEY, "t", "u", 43200.0, [("value", 80.0)])


put("scan_sessions", lambda s, d: rounded(sess(s, d), "start", "end", digits=3), 'SELECT det, CAST(session AS BIGINT) AS session, round(start, 3) AS start, round("end", 3) AS "end", n FROM ses', SESS)
put(
    "session_gaps", lambda s, d: rounded(sq.period_gaps(sess(s, d), KEY, 100000.0), "gap_start", "gap_end", digits=3),
    'SELECT det, round(p, 3) AS gap_start, round(start, 3) AS gap_end FROM (SELECT det, start, max("end") OVER (PARTITION BY det ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ses) WHERE start - p > 100000', SESS,
)
put(
    "start_groups", lambda s, d: sq.groups_by_start(samples(s, d), ["event_type"], "t", 3000.0).groupBy("event_type", F.col("grp").cast("long").alias("grp")).agg(F.count(F.lit(1)).alias("n")),
    """SELECT event_type, CAST(grp AS BIGINT) AS grp, n FROM (SELECT event_type, grp, count(*) AS n, max(count(*)) OVER (PARTITION BY event_type) AS most FROM
 (SELECT event_type, sum(f) OVER (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY event_type ORDER BY t) <= 3000 THEN 0 ELSE 1 END AS f FROM samples)) GROUP BY 1, 2) WHERE n = most""",
)
put(
    "phase", lambda s, d: rounded(sq.phase(samples(s, d), KEY, "sample", "value").select("det", "sample", "phase"), "phase"),
    """SELECT det, sample, round(median(CASE WHEN value < b THEN 2 - p ELSE p END) OVER (PARTITION BY det ORDER BY sample ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS phase FROM
 (SELECT det, sample, value, (value - min(value) OVER (PARTITION BY det)) / (max(value) OVER (PARTITION BY det) - min(value) OVER (PARTITION BY det)) AS p, lag(value) OVER (PARTITION BY det ORDER BY sample) AS b FROM samples)""",
)
put(
    "unwrap", lambda s, d: rounded(sq.unwrap(samples(s, d), KEY, "sample", "value", 100.0).select("det", "sample", "unwrapped"), "unwrapped"),
    "SELECT det, sample, round(value - 100 * sum(k) OVER (PARTITION BY det ORDER BY sample ROWS UNBOUNDED PRECEDING), 6) AS unwrapped FROM (SELECT *, coalesce(round((value - lag(value) OVER (PARTITION BY det ORDER BY sample)) / 100), 0) AS k FROM samples)",
)
put("sample_rate", lambda s, d: rounded(sq.sample_rate(samples(s, d), KEY, "sample", "t"), "srate", digits=9), "SELECT det, round(1 / median(g), 9) AS srate FROM (SELECT det, t - lag(t) OVER (PARTITION BY det ORDER BY sample) AS g FROM samples) GROUP BY 1")
put(
    "taper", lambda s, d: rounded(fi.taper(samples(s, d).select("det", "sample", "value"), KEY, "sample", "value", 6), "value"),
    "SELECT det, sample, round(value * CASE WHEN e < 6 THEN 0.5 - 0.5 * cos(pi() * (e + 1) / 7) ELSE 1 END, 6) AS value FROM (SELECT *, least(sample, count(*) OVER (PARTITION BY det) - 1 - sample) AS e FROM samples)",
)


def fill_right(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    return sq.hold(s.where("event_type = 'signup'").select("det", "sample", "value"), s.select("det", "sample"), KEY, "sample", "value", 0.0)


put("fill_right", fill_right, "SELECT det, sample, coalesce(last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY det ORDER BY sample ROWS UNBOUNDED PRECEDING), 0) AS value FROM samples")


def asof_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Last order at or before each ship date; months bound what a task holds, and each is opened with the last order before it."""
    right = table(spark, d, "orders").groupBy("o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    left = table(spark, d, "lineitem").groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("n"))
    return sq.asof(left, right, "l_shipdate", "o_orderdate", ["o_orderkey"], bucket="date_trunc('MONTH', _t)").select(F.col("l_shipdate").cast("date").alias("day"), "n", "o_orderkey")


put("asof_lookup", asof_lookup, """SELECT CAST(l_shipdate AS DATE) AS day, n, o_orderkey FROM (SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1) l ASOF LEFT JOIN
 (SELECT o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) o ON l_shipdate >= o_orderdate""")


def leap_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A small step table; times before its first row get the first."""
    steps = spark.createDataFrame([(500000.0, 10), (1000000.0, 11), (2000000.0, 12)], "t double, leap int")
    s = samples(spark, d).select("det", "sample", "t")
    return sq.asof(s, steps.join(s.select("det").distinct()), "t", "t", ["leap"], KEY, clamp=True).select("det", "sample", "leap")


put("leap_lookup", leap_lookup, "SELECT det, sample, CAST(CASE WHEN t >= 2000000 THEN 12 WHEN t >= 1000000 THEN 11 ELSE 10 END AS INT) AS leap FROM samples")


def interpolated(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    t = s.where("sample % 5 = 0").select("det", "t", "value")
    return rounded(sq.interpolate(s.select("det", "t"), t, KEY, "t", "value"), "t", "value", digits=3)


put(
    "interpolate", interpolated,
    """SELECT det, round(t, 3) AS t, round(CASE WHEN t1 IS NULL THEN NULL WHEN t1 = t0 THEN v0 ELSE v0 + (t - t0) / (t1 - t0) * (v1 - v0) END, 3) AS value FROM (SELECT det, t,
 last_value(CASE WHEN sample % 5 = 0 THEN t END IGNORE NULLS) OVER b AS t0, last_value(CASE WHEN sample % 5 = 0 THEN value END IGNORE NULLS) OVER b AS v0,
 first_value(CASE WHEN sample % 5 = 0 THEN t END IGNORE NULLS) OVER f AS t1, first_value(CASE WHEN sample % 5 = 0 THEN value END IGNORE NULLS) OVER f AS v1
 FROM samples WINDOW b AS (PARTITION BY det ORDER BY sample ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY det ORDER BY sample ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
)
put("downsample", lambda s, d: rounded(sq.downsample(samples(s, d), KEY, "sample", "value", 7), "value"), "SELECT det, CAST(sample // 7 AS INT) AS sample, round(avg(value), 6) AS value FROM samples GROUP BY 1, 2")
put("subsamples", lambda s, d: rounded(sq.subsamples(samples(s, d), KEY, "t", 3600.0).select("det", "sample", "sub", "frac"), "frac", digits=4), "SELECT det, sample, CAST(floor(p) AS BIGINT) AS sub, round(p - floor(p), 4) AS frac FROM (SELECT det, sample, (t - min(t) OVER (PARTITION BY det)) / 3600 AS p FROM samples)")
put(
    "density_marks", lambda s, d: sq.density_marks(samples(s, d).withColumn("w", F.floor("value") / 64), KEY, "sample", "w").where("mark").select("det", "sample"),
    "SELECT det, sample FROM (SELECT det, sample, c, coalesce(lag(c) OVER (PARTITION BY det ORDER BY sample), 0) AS b FROM (SELECT det, sample, floor(sum(floor(value) / 64) OVER (PARTITION BY det ORDER BY sample ROWS UNBOUNDED PRECEDING)) AS c FROM samples)) WHERE c > b",
)
put(
    "white_noise_level", lambda s, d: rounded(sq.white_noise(samples(s, d), KEY, "sample", "value", 10), "variance", digits=4),
    "SELECT det, round(median(v), 4) AS variance FROM (SELECT det, k, avg(x * x / 2) AS v FROM (SELECT det, sample // 10 AS k, value - lag(value) OVER (PARTITION BY det, sample // 10 ORDER BY sample) AS x FROM samples) GROUP BY 1, 2) GROUP BY 1",
)

# ---- gap filling over runs of errors

ONLY = f"{LENGTHS},\n{ERRORS_SQL}"


def errs(spark: SparkSession, d: str) -> DataFrame:
    return iv.from_mask(samples(spark, d), KEY, "sample", F.col("event_type") == "error")


def vals(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("det", "sample", "value")


put("gapfill_const", lambda s, d: gf.fill("constant", vals(s, d), errs(s, d), KEY, "sample", "value", 7.5), "SELECT det, sample, CASE WHEN event_type = 'error' THEN 7.5 ELSE value END AS value FROM samples")
LINEAR = """gaps AS (SELECT det, lo, hi, lag(hi) OVER w AS b, lead(lo) OVER w AS a FROM errs WINDOW w AS (PARTITION BY det ORDER BY lo)),
 ctx AS (SELECT g.det, g.lo, g.hi, avg(CASE WHEN s.sample < g.lo THEN s.v END) AS v0, avg(CASE WHEN s.sample < g.lo THEN s.sample END) AS t0, avg(CASE WHEN s.sample >= g.hi THEN s.v END) AS v1, avg(CASE WHEN s.sample >= g.hi THEN s.sample END) AS t1
 FROM gaps g LEFT JOIN base s ON s.det = g.det AND ((s.sample BETWEEN greatest(g.lo - 4, coalesce(g.b, 0)) AND g.lo - 1) OR (s.sample BETWEEN g.hi AND least(g.hi + 3, coalesce(g.a, 100000) - 1))) GROUP BY 1, 2, 3),
 filled AS (SELECT s.det, s.sample, CASE WHEN c.lo IS NULL THEN s.v ELSE coalesce(v0 + (v1 - v0) * (s.sample - t0) / (t1 - t0), v0, v1, 0) END AS v FROM base s LEFT JOIN ctx c ON s.det = c.det AND s.sample >= c.lo AND s.sample < c.hi)"""
put("gapfill_linear", lambda s, d: rounded(gf.fill("linear", vals(s, d), errs(s, d), KEY, "sample", "value", 4), "value"), "SELECT det, sample, round(v, 6) AS value FROM filled", ONLY, "base AS (SELECT det, sample, value AS v FROM samples)", LINEAR)
put(
    "gapfill_common", lambda s, d: rounded(gf.common(vals(s, d), errs(s, d), KEY, "sample", "value", lambda *a: gf.linear(*a, 4)), "value"),
    "SELECT f.det, f.sample, round(f.v + b.m, 6) AS value FROM filled f JOIN base b USING (det, sample)", ONLY,
    "cm AS (SELECT sample, avg(value) AS m FROM samples WHERE event_type <> 'error' GROUP BY 1)", "base AS (SELECT det, sample, value - coalesce(m, 0) AS v, coalesce(m, 0) AS m FROM samples LEFT JOIN cm USING (sample))", LINEAR,
)
put("gapfill_none", lambda s, d: gf.fill("none", vals(s, d), errs(s, d), KEY, "sample", "value"), "SELECT det, sample, value FROM samples")
put(
    "find_spikes", lambda s, d: gf.spikes(vals(s, d), KEY, "sample", "value", 5.0, 7, 2, 30.0), "SELECT det, lo, hi FROM m",
    """spk AS (SELECT *, abs(value - median(value) OVER (PARTITION BY det ORDER BY sample ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)) > 150 AS hot FROM samples)""",
    """hotruns AS (SELECT det, CAST(min(sample) AS INT) AS lo, CAST(max(sample) + 1 AS INT) AS hi FROM (SELECT det, sample, sample - row_number() OVER (PARTITION BY det ORDER BY sample) AS g FROM spk WHERE hot) GROUP BY det, g)""",
    LENGTHS,
    """m AS (SELECT det, CAST(min(lo) AS INT) AS lo, CAST(max(hi) AS INT) AS hi FROM (SELECT *, sum(f) OVER (PARTITION BY det ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY det ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM
 (SELECT det, greatest(lo - 2, 0) AS lo, least(hi + 2, n) AS hi FROM hotruns JOIN lengths USING (det)))) GROUP BY det, i)""",
)
TEN = LINEAR.replace("g.lo - 4", "g.lo - 10").replace("g.hi + 3", "g.hi + 9")
put(
    "deglitch", lambda s, d: rounded(gf.deglitch(vals(s, d), KEY, "sample", "value", 6.0, 7, 2), "value"), "SELECT det, sample, round(v, 6) AS value FROM filled",
    "dev AS (SELECT *, abs(value - median(value) OVER (PARTITION BY det ORDER BY sample ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)) AS x FROM samples)",
    "spk AS (SELECT dev.*, x > 6 * 1.4826 * m AS hot FROM dev JOIN (SELECT det, median(x) AS m FROM dev GROUP BY 1) USING (det))",
    runs_sql("hotruns", "hot", "spk"), LENGTHS, merge_sql("errs", "SELECT det, greatest(lo - 2, 0) AS lo, least(hi + 2, n) AS hi FROM hotruns JOIN lengths USING (det)"), "base AS (SELECT det, sample, value AS v FROM samples)", TEN,
)
Q["gapfill_modes"] = lambda s, d: gf.eigenmodes(vals(s, d).withColumn("obs", (F.col("det") % 10)), errs(s, d).withColumn("obs", F.col("det") % 10), "obs", "det", "sample", "value")
put(
    "gapfill_pair", lambda s, d: rounded(gf.pair(vals(s, d), errs(s, d), "det", "sample", "value", F.col("det").bitwiseXOR(1)), "value"),
    "SELECT a.det, a.sample, round(CASE WHEN a.event_type = 'error' AND b.event_type <> 'error' THEN b.value + f.v ELSE a.value END, 6) AS value FROM samples a LEFT JOIN samples b ON b.det = xor(a.det, 1) AND b.sample = a.sample LEFT JOIN filled f ON f.det = a.det AND f.sample = a.sample",
    runs_sql("own", "event_type = 'error'"), merge_sql("errs", "SELECT det, lo, hi FROM own UNION SELECT xor(det, 1), lo, hi FROM own"), "base AS (SELECT a.det, a.sample, a.value - b.value AS v FROM samples a JOIN samples b ON b.det = xor(a.det, 1) AND b.sample = a.sample)", TEN,
)

# ---- filters; a block is ten detectors

def blocked(spark: SparkSession, d: str) -> DataFrame:
    return vals(spark, d).withColumn("block", F.floor(F.col("det") / 10).cast("long"))


put("common_mode", lambda s, d: rounded(fi.common(blocked(s, d), ["block"], "sample", "value", 5), "value"), "SELECT det, sample, block, round(CASE WHEN n >= 5 THEN value - m ELSE value END, 6) AS value FROM (SELECT *, det // 10 AS block, avg(value) OVER w AS m, count(*) OVER w AS n FROM samples WINDOW w AS (PARTITION BY det // 10, sample))")
put("common_median", lambda s, d: rounded(fi.common(vals(s, d), [], "sample", "value", keep=True, robust=True), "value"), "SELECT det, sample, round(median(value) OVER (PARTITION BY sample), 6) AS value FROM samples")
put(
    "phase_bins", lambda s, d: rounded(fi.by_phase(vals(s, d).withColumn("t", F.col("sample") % 12), [], F.when(F.col("sample") % 12 < 6, 1).otherwise(2), F.col("t"), 3.0, "value").select("det", "sample", "value"), "value"),
    "SELECT det, sample, round(value - avg(value) OVER (PARTITION BY sample % 12 < 6, (sample % 12) // 3), 6) AS value FROM samples",
)
put(
    "deslope", lambda s, d: rounded(fi.deslope(vals(s, d), KEY, "sample", "value"), "value"),
    "SELECT det, sample, round(value - a - (b - a) * sample / n, 6) AS value FROM (SELECT *, first_value(value) OVER w AS a, last_value(value) OVER w AS b, count(*) OVER w - 1 AS n FROM samples WINDOW w AS (PARTITION BY det ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))",
)
put("detrend", lambda s, d: rounded(fi.detrend(vals(s, d), KEY, "sample", "value"), "value", digits=4), "SELECT s.det, sample, round(value - m - k * (sample - c), 4) AS value FROM samples s JOIN (SELECT det, regr_slope(value, sample) AS k, avg(value) AS m, avg(sample) AS c FROM samples GROUP BY 1) f USING (det)")
put("regress_template", lambda s, d: rounded(fi.regress(vals(s, d).withColumn("c", (F.col("sample") % 7).cast("double")), KEY, "value", "c").select("det", "sample", "value"), "value"), "SELECT det, sample, round(value - (sample % 7) * sum(value * (sample % 7)) OVER (PARTITION BY det) / sum((sample % 7) * (sample % 7)) OVER (PARTITION BY det), 6) AS value FROM samples")
put("gain_fit", lambda s, d: rounded(fi.gain_fit(vals(s, d), "det", "sample", "value"), "gain"), "SELECT det, round(sum(value * c) / sum(c * c), 6) AS gain FROM (SELECT *, median(value) OVER (PARTITION BY sample) AS c FROM samples) GROUP BY 1")
put(
    "replace_gain", lambda s, d: rounded(fi.replace_gain(vals(s, d), lengths(s, d).select("det", F.col("n").cast("double").alias("gain")), lengths(s, d).select("det", (F.col("n") * 3.0).alias("gain")), "det", "value"), "value"),
    "SELECT det, sample, round(value * 3, 6) AS value FROM samples",
)
put("scale_chain", lambda s, d: fi.chain(lambda x: fi.scale(x, "value", 2.0), lambda x: fi.scale(x, "value", 0.25))(vals(s, d)), "SELECT det, sample, value * 2 * 0.25 AS value FROM samples")
put(
    "add_map", lambda s, d: rounded(fi.add_map(vals(s, d).withColumn("x", F.col("sample") % 9), s.range(0, 6).select(F.col("id").cast("int").alias("x"), (F.col("id") * 1.5).alias("map_value")), ["x"], "value", -2.0).select("det", "sample", "value"), "value"),
    "SELECT det, sample, round(value - CASE WHEN sample % 9 < 6 THEN 3 * (sample % 9) ELSE 0 END, 6) AS value FROM samples",
)
put(
    "weighted_common", lambda s, d: rounded(fi.iterate_common(blocked(s, d), ["block"], "det", "sample", "value", 2).groupBy("block", "sample").agg(F.max("common").alias("common")), "common"),
    """SELECT block, sample, round(sum(w * value) / sum(w), 6) AS common FROM a JOIN v USING (block, det) GROUP BY 1, 2""",
    "a AS (SELECT *, det // 10 AS block, avg(value) OVER (PARTITION BY det // 10, sample) AS c FROM samples)", "v AS (SELECT block, det, 1 / var_pop(value - c) AS w FROM a GROUP BY 1, 2)",
)
put("chisq", lambda s, d: rounded(fi.chisq(vals(s, d).withColumns({"m": F.lit(50.0), "iv": F.lit(0.01)}), KEY, "value", "m", "iv"), "chisq", digits=4), "SELECT det, round(sum((value - 50) * (value - 50) * 0.01), 4) AS chisq FROM samples GROUP BY 1")


def chisq_update(spark: SparkSession, d: str) -> DataFrame:
    """Only changed ranges are computed anew."""
    s = vals(spark, d).withColumn("iv", F.lit(1.0))
    old = fi.chisq(s.withColumn("m", F.lit(40.0)), KEY, "value", "m", "iv")
    new = fi.chisq(s.where("det % 4 = 1").withColumn("m", F.lit(60.0)), KEY, "value", "m", "iv")
    return rounded(fi.chisq_update(old, new, KEY), "chisq", digits=4)


put("chisq_update", chisq_update, "SELECT det, round(sum(pow(value - CASE WHEN det % 4 = 1 THEN 60 ELSE 40 END, 2)), 4) AS chisq FROM samples GROUP BY 1")

QUERIES, ORACLE = Q, {k: nudged(v) for k, v in O.items()}
