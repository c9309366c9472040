"""Queries on scalars, angles, times and small dense algebra."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as fn
from ..operators import lowrank
from ..operators import numerics as nu
from .base import nudged, rounded, samples, SAMPLES, table

Q: dict = {}
O: dict[str, str] = {}
C = F.col


def put(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    Q[name], O[name] = f, sql


def sky(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(C("c_custkey").alias("id"), F.radians(C("c_custkey") * 7.3 % 360).alias("lon"), F.radians(C("c_custkey") * 3.1 % 170 - 85).alias("lat"))


SKY = "sky AS (SELECT c_custkey AS id, radians(CAST(c_custkey * 7.3 AS DOUBLE) % 360) AS lon, radians(CAST(c_custkey * 3.1 AS DOUBLE) % 170 - 85) AS lat FROM customer)"


def turned(vx: str, vy: str, vz: str, m: list[list[float]]) -> str:
    """SQL for angles of a rotated vector."""
    x, y, z = (f"({m[i][0]!r} * {vx} + {m[i][1]!r} * {vy} + {m[i][2]!r} * {vz})" for i in range(3))
    return f"round(atan2({y}, {x}), 6) AS lon, round(atan2({z}, sqrt({x} * {x} + {y} * {y})), 6) AS lat"


VEC = f"{SKY}, v AS (SELECT id, cos(lon) * cos(lat) AS x, sin(lon) * cos(lat) AS y, sin(lat) AS z FROM sky)"


def angles(made: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: rounded(sky(s, d).select("id", made(C("lon"), C("lat")).alias("a")).select("id", "a.lon", "a.lat"), "lon", "lat")


def recentre_back(spark: SparkSession, d: str) -> DataFrame:
    """There and back in two projections, so that each angle is worked out once."""
    there = sky(spark, d).select("id", fn.recentred(C("lon"), C("lat"), 0.4, 0.2).alias("a")).select("id", "a.lon", "a.lat")
    back = rounded(there.select("id", fn.decentred(C("lon"), C("lat"), 0.4, 0.2).alias("a")).select("id", "a.lon", "a.lat"), "lon", "lat")
    half = round(math.pi, 6)
    return back.withColumn("lon", F.when(C("lon") == -half, half).otherwise(C("lon")))  # one angle, whatever the last bit says


put("unit_vectors", lambda s, d: rounded(sky(s, d).select("id", fn.unit(C("lon"), C("lat")).alias("u")).select("id", *[C("u")[k].alias(n) for k, n in enumerate("xyz")]), "x", "y", "z"), f"WITH {VEC} SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM v")
put("to_galactic", angles(fn.to_galactic), f"WITH {VEC} SELECT id, {turned('x', 'y', 'z', fn.GALACTIC)} FROM v")
put("euler_rotation", angles(lambda a, b: fn.rotate_angles(a, b, 0.3, -0.7, 1.1)), f"WITH {VEC} SELECT id, {turned('x', 'y', 'z', fn.euler_matrix(0.3, -0.7, 1.1))} FROM v")
put("recentre_back", recentre_back, f"WITH {VEC} SELECT id, {turned('x', 'y', 'z', [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]])} FROM v")
put("to_ecliptic", angles(fn.to_ecliptic), f"WITH {VEC} SELECT id, {turned('x', 'y', 'z', [[1.0, 0.0, 0.0], [0.0, math.cos(fn.OBLIQUITY), math.sin(fn.OBLIQUITY)], [0.0, -math.sin(fn.OBLIQUITY), math.cos(fn.OBLIQUITY)]])} FROM v")
put(
    "separation", lambda s, d: rounded(sky(s, d).select("id", fn.separation(C("lon"), C("lat"), F.lit(1.0), F.lit(0.5)).alias("sep")), "sep"),
    f"WITH {VEC} SELECT id, round(2 * asin(least(1, sqrt(pow(x - {math.cos(1) * math.cos(0.5)!r}, 2) + pow(y - {math.sin(1) * math.cos(0.5)!r}, 2) + pow(z - {math.sin(0.5)!r}, 2)) / 2)), 6) AS sep FROM v",
)
put(
    "sun_to_earth", lambda s, d: rounded(sky(s, d).select("id", fn.from_sun_to_earth(fn.unit(C("lon"), C("lat")), F.lit(3.0), F.array(F.lit(0.6), F.lit(-0.8), F.lit(0.1))).alias("u")).select("id", *[C("u")[k].alias(n) for k, n in enumerate("xyz")]), "x", "y", "z"),
    f"WITH {VEC}, w AS (SELECT id, 3 * x + 0.6 AS x, 3 * y - 0.8 AS y, 3 * z + 0.1 AS z FROM v) SELECT id, round(x / sqrt(x*x + y*y + z*z), 6) AS x, round(y / sqrt(x*x + y*y + z*z), 6) AS y, round(z / sqrt(x*x + y*y + z*z), 6) AS z FROM w",
)
put(
    "times", lambda s, d: rounded(samples(s, d).select("det", "sample", fn.ctime_to_mjd(C("t") + 1704067200.0).alias("mjd"), fn.mjd_to_djd(fn.ctime_to_mjd(C("t"))).alias("djd"), (fn.tai_to_tt(C("t")) - C("t")).alias("tt")), "mjd", "djd", "tt"),
    f"WITH {SAMPLES} SELECT det, sample, round((t + 1704067200) / 86400 + 40587, 6) AS mjd, round(t / 86400 + 40587 - 15019.5, 6) AS djd, 32.184 AS tt FROM samples",
)
put(
    "pulse_phase", lambda s, d: rounded(samples(s, d).select("det", "sample", F.pmod(fn.turns(C("t"), F.lit(1250.0), F.lit(1e-5)), F.lit(1.0)).alias("phase"), fn.turn_time(fn.turns(C("t"), F.lit(1250.0), F.lit(1e-5)), F.lit(1250.0), F.lit(1e-5)).alias("back")), "phase", "back", digits=4),
    f"WITH {SAMPLES}, p AS (SELECT *, ln(1 + 1e-5 / 1250 * t) / 1e-5 AS k FROM samples) SELECT det, sample, round(k - floor(k), 4) AS phase, round(t, 4) AS back FROM p",
)
put(
    "next_arrival", lambda s, d: rounded(samples(s, d).select("det", "sample", fn.next_arrival(C("t"), F.lit(100.0), F.lit(0.01), F.lit(0.0)).alias("at_s")), "at_s", digits=3),
    f"WITH {SAMPLES}, p AS (SELECT det, sample, t + (ceil(0.01 * (t - 100)) - 0.01 * (t - 100)) / 0.01 AS a FROM samples) SELECT det, sample, round(a - 86400 * floor(a / 86400), 3) AS at_s FROM p",
)
PART = "part"
put("butterworth", lambda s, d: rounded(table(s, d, "part").select("p_partkey", fn.butterworth(C("p_size").cast("double"), 20.0, 3.5).alias("w")), "w"), "SELECT p_partkey, round(1 / (1 + pow(p_size / 20.0, 3.5)), 6) AS w FROM part")
put("safe_divide", lambda s, d: rounded(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", fn.safe_divide(C("l_quantity"), C("l_tax"), -1.0).alias("q")), "q"), "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax = 0 THEN -1 ELSE l_quantity / l_tax END, 6) AS q FROM lineitem")
put(
    "extreme_values", lambda s, d: rounded(table(s, d, "part").select("p_partkey", fn.max_of_normals_cdf((C("p_size") - 20) / 10.0, F.lit(5)).alias("cdf"), fn.min_of_normals_sf((C("p_size") - 20) / 10.0, F.lit(5)).alias("sf")), "cdf", "sf"),
    """WITH p AS (SELECT p_partkey, (p_size - 20) / 10.0 AS z, 1 / (1 + 0.2316419 * abs((p_size - 20) / 10.0)) AS t FROM part), c AS (SELECT p_partkey, z, exp(-z * z / 2) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) / sqrt(2 * pi()) AS u FROM p)
 SELECT p_partkey, round(pow(CASE WHEN z >= 0 THEN 1 - u ELSE u END, 5), 6) AS cdf, round(pow(CASE WHEN z >= 0 THEN u ELSE 1 - u END, 5), 6) AS sf FROM c""",
)
put("sz_spectrum", lambda s, d: rounded(table(s, d, "part").select("p_partkey", fn.sz_spectrum(C("p_size") * 10.0 + 30).alias("g")), "g"), "WITH p AS (SELECT p_partkey, (p_size * 10.0 + 30) * (0.0479924307 / 2.725) AS x FROM part) SELECT p_partkey, round(x * (exp(x) + 1) / (exp(x) - 1) - 4, 6) AS g FROM p")
put(
    "cluster_radius", lambda s, d: rounded(table(s, d, "part").select("p_partkey", fn.radius_of(C("p_retailprice") * 1e11, C("p_size") / 25.0).alias("r"), fn.profile_parameter(C("p_retailprice") * 1e11, C("p_size") / 25.0, 18.1, 0.154, -0.758).alias("a")), "r", "a", digits=5),
    f"WITH p AS (SELECT p_partkey, p_retailprice * 1e11 AS m, p_size / 25.0 AS z FROM part) SELECT p_partkey, round(cbrt(3 * m / (4 * pi() * 200 * (3 * pow(67.4 * sqrt(0.315 * pow(1 + z, 3) + 0.685), 2) / (8 * pi() * 4.30091e-9)))), 5) AS r, round(18.1 * pow(m / 1e14, 0.154) * pow(1 + z, -0.758), 5) AS a FROM p",
)
put(
    "box_overlap", lambda s, d: table(s, d, "part").select("p_partkey", fn.overlap(C("p_size"), C("p_size") + 10, F.lit(18), F.lit(25)).alias("o"), fn.boxes_meet((C("p_size"), C("p_size") + 5), (F.lit(0), F.lit(3)), 50).alias("meets")).select("p_partkey", "o.lo", "o.hi", "meets"),
    "SELECT p_partkey, CASE WHEN greatest(p_size, 18) < least(p_size + 10, 25) THEN greatest(p_size, 18) END AS lo, CASE WHEN greatest(p_size, 18) < least(p_size + 10, 25) THEN least(p_size + 10, 25) END AS hi, (p_size < 3 AND 0 < p_size + 5) OR (p_size - 50 < 3 AND 0 < p_size - 45) OR (p_size + 50 < 3 AND 0 < p_size + 55) AS meets FROM part",
)
put("diagonal_weights", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(fn.diagonal(C("p_size").cast("double"), 2), ",").alias("m"), F.size(fn.padded(F.array(F.lit(1.0)), 4)).cast("long").alias("n")), "SELECT p_partkey, printf('%d.0,0.0,0.0,%.1f', p_size, p_size / 2.0) AS m, CAST(4 AS BIGINT) AS n FROM part")
put("area_strings", lambda s, d: table(s, d, "nation").select("n_nationkey", fn.area(F.concat(F.lit("-5:"), C("n_nationkey"), F.lit(",1.5:"), C("n_regionkey"), F.lit(",2"))).alias("a")).select("n_nationkey", "a.dec1", "a.dec2", "a.ra1", "a.ra2", "a.down"), "SELECT n_nationkey, -5.0::DOUBLE AS dec1, n_nationkey::DOUBLE AS dec2, 1.5::DOUBLE AS ra1, n_regionkey::DOUBLE AS ra2, CAST(2 AS INT) AS down FROM nation")


# ---- arrays: 3 x 3 systems per part, from its numbers


def systems(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    a, b = C("p_size") / 10.0 + 2, C("p_partkey") % 7 / 7.0
    return p.select("p_partkey", F.array(a, b, F.lit(0.0), b, a + 1, b, F.lit(0.0), b, a + 2).alias("a"), F.array(F.lit(1.0), b, a).alias("b"))


SYS = "sys AS (SELECT p_partkey, p_size / 10.0 + 2 AS a, (p_partkey % 7) / 7.0 AS b FROM part)"
put(
    "matvec", lambda s, d: rounded(systems(s, d).select("p_partkey", nu.per_row(nu.matvec)("a", "b").alias("x")).select("p_partkey", *[C("x")[k].alias(f"x{k}") for k in range(3)]), "x0", "x1", "x2"),
    f"WITH {SYS} SELECT p_partkey, round(a + b * b, 6) AS x0, round(b + (a + 1) * b + b * a, 6) AS x1, round(b * b + (a + 2) * a, 6) AS x2 FROM sys",
)
DET = "(a * ((a + 1) * (a + 2) - b * b) - b * b * (a + 2))"
SOLVED = f"WITH {SYS} SELECT p_partkey, round((((a + 1) * (a + 2) - b * b) - b * (a + 2) * b + b * b * a) / {DET}, 5) AS x0, round((-b * (a + 2) + a * (a + 2) * b - a * b * a) / {DET}, 5) AS x1, round((b * b - a * b * b + (a * (a + 1) - b * b) * a) / {DET}, 5) AS x2 FROM sys"
put("solve_small", lambda s, d: rounded(systems(s, d).select("p_partkey", nu.per_row(nu.solve)("a", "b").alias("x")).select("p_partkey", *[C("x")[k].alias(f"x{k}") for k in range(3)]), "x0", "x1", "x2", digits=5), SOLVED)
put("cg_solve", lambda s, d: rounded(systems(s, d).select("p_partkey", nu.per_row(nu.cg_solve)("a", "b").alias("x")).select("p_partkey", *[C("x")[k].alias(f"x{k}") for k in range(3)]), "x0", "x1", "x2", digits=5), SOLVED)
put(
    "eigpow_square", lambda s, d: rounded(systems(s, d).select("p_partkey", nu.per_row(lambda a: nu.power(a, 2.0))("a").alias("m")).select("p_partkey", C("m")[0].alias("m00"), C("m")[1].alias("m01"), C("m")[8].alias("m22")), "m00", "m01", "m22"),
    f"WITH {SYS} SELECT p_partkey, round(a * a + b * b, 6) AS m00, round(a * b + b * (a + 1), 6) AS m01, round(b * b + (a + 2) * (a + 2), 6) AS m22 FROM sys",
)
#: The matrix is (a + 1) I + M with M of eigenvalues -s, 0 and s, so its powers are quadratics in M.
EIG = f"{SYS}, e AS (SELECT *, sqrt(1 + 2 * b * b) AS s FROM sys), r AS (SELECT *, pow(a + 1, -0.5) AS f, (pow(a + 1 + s, -0.5) - pow(a + 1 - s, -0.5)) / (2 * s) AS g, (pow(a + 1 + s, -0.5) + pow(a + 1 - s, -0.5) - 2 * pow(a + 1, -0.5)) / (2 * s * s) AS h FROM e)"
put(
    "eigpow_inverse_root", lambda s, d: rounded(systems(s, d).select("p_partkey", nu.per_row(lambda a: nu.power(a, -0.5))("a").alias("m")).select("p_partkey", *[C("m")[k].alias(f"m{k}") for k in (0, 1, 2, 4, 8)]), *[f"m{k}" for k in (0, 1, 2, 4, 8)]),
    f"WITH {EIG} SELECT p_partkey, round(f - g + h * (1 + b * b), 6) AS m0, round(g * b - h * b, 6) AS m1, round(h * b * b, 6) AS m2, round(f + 2 * h * b * b, 6) AS m4, round(f + g + h * (1 + b * b), 6) AS m8 FROM r",
)
put("condition_numbers", lambda s, d: rounded(systems(s, d).select("p_partkey", nu.per_row(nu.condition, T.DoubleType())("a").alias("k")), "k"), f"WITH {EIG} SELECT p_partkey, round((a + 1 + s) / (a + 1 - s), 6) AS k FROM e")
put(
    "low_rank_inverse", lambda s, d: rounded(systems(s, d).select("p_partkey", nu.per_row(nu.invert_low_rank)(F.array(*[F.lit(x) for x in (1.0, 2.0, 3.0)]), "b", F.array(F.lit(0.5))).alias("m")).select("p_partkey", *[C("m")[k].alias(f"m{k}") for k in (0, 1, 8)]), "m0", "m1", "m8"),
    f"WITH {SYS}, k AS (SELECT *, 2 + 1 + b * b / 2 + a * a / 3 AS k FROM sys) SELECT p_partkey, round(1 - 1 / k, 6) AS m0, round(-b / 2 / k, 6) AS m1, round(1 / 3.0 - a * a / 9 / k, 6) AS m8 FROM k",
)
put(
    "covariance", lambda s, d: rounded(nu.covariance(samples(s, d).select("det", "sample", "value"), "det", "sample", "value", 1), "cov", digits=4),
    f"WITH {SAMPLES} SELECT a.det AS i, b.det AS j, round(sum(a.value * b.value) / count(*), 4) AS cov FROM samples a JOIN samples b ON b.sample = a.sample + 1 GROUP BY 1, 2",
)
put(
    "poly_filter_line", lambda s, d: rounded(nu.remove_poly(samples(s, d).select("det", "sample", "value"), ["det"], "sample", "value", 2), "value", digits=4),
    f"WITH {SAMPLES} SELECT s.det, sample, round(value - m - k * (sample - c), 4) AS value FROM samples s JOIN (SELECT det, regr_slope(value, sample) AS k, avg(value) AS m, avg(sample) AS c FROM samples GROUP BY 1) f USING (det)",
)


def series(spark: SparkSession, d: str) -> DataFrame:
    """One array of all values per detector."""
    s = samples(spark, d).groupBy("det").agg(F.sort_array(F.collect_list(F.struct("sample", "value"))).alias("v"))
    return s.select("det", F.transform("v", lambda x: x["value"]).alias("v"))


Q["poly_filter"] = lambda s, d: nu.remove_poly(samples(s, d).withColumns({"az": F.sin("sample"), "cut": C("event_type") == "error"}).select("det", "sample", "value", "az", "cut"), ["det"], "sample", "value", 4, "az", -3, "cut").select("det", "sample", F.round("value", 4).alias("value"))
Q["dark_deprojection"] = lambda s, d: lowrank.deproject(samples(s, d).withColumns({"scan": C("det") % 5, "dark": C("det") % 3 == 0}), ["scan"], "sample", "value", "det", "dark", 3)
Q["highpass"] = lambda s, d: series(s, d).select("det", nu.per_row(lambda v: nu.highpass(v, 0.05))("v").alias("v"))
Q["bandpass"] = lambda s, d: series(s, d).select("det", nu.per_row(lambda v: nu.bandpass(v, 0.05, 0.2))("v").alias("v"))
Q["hwp_notch"] = lambda s, d: series(s, d).select("det", nu.per_row(lambda v: nu.notch(v, 0.1, 3))("v").alias("v"))
Q["broaden_beam"] = lambda s, d: series(s, d).select("det", nu.per_row(lambda v: nu.broaden(v, 2.0))("v").alias("v"))
Q["power_spectra"] = lambda s, d: series(s, d).select("det", nu.per_row(nu.spectrum)("v").alias("p"))



def unrolled(name: str, column: str = "v", as_: str = "value") -> Callable[[SparkSession, str], DataFrame]:
    """A row per element of a query's arrays."""
    return lambda s, d: rounded(Q[name](s, d).select("det", F.posexplode(column).alias("k", as_)), as_, digits=4)


def dft_sql(weight: str) -> str:
    """Sums of cosines and sines of each detector's samples, weighted per frequency, and summed back."""
    return f"""WITH {SAMPLES}, n AS (SELECT det, count(*) AS n FROM samples GROUP BY 1), fr AS (SELECT det, n, CAST(unnest(range(n // 2 + 1)) AS BIGINT) AS j FROM n),
 x AS MATERIALIZED (SELECT det, n, j, sum(value * cos(2 * pi() * (j * sample % n) / n)) AS re, -sum(value * sin(2 * pi() * (j * sample % n) / n)) AS im FROM fr JOIN samples USING (det) GROUP BY 1, 2, 3),
 y AS MATERIALIZED (SELECT *, j / n::DOUBLE AS f FROM x), z AS MATERIALIZED (SELECT *, CASE WHEN j = 0 OR 2 * j = n THEN 1 ELSE 2 END * ({weight}) / n AS w FROM y)
 SELECT det, sample AS k, round(sum(w * (re * cos(2 * pi() * (j * sample % n) / n) - im * sin(2 * pi() * (j * sample % n) / n))), 4) AS value FROM z JOIN samples USING (det) GROUP BY 1, 2"""


def butter_sql(knee: float, alpha: float) -> str:
    return f"CASE WHEN f = 0 THEN 0 ELSE 1 / (1 + pow(f / {knee}, {alpha})) END"


put("highpass_rows", unrolled("highpass"), dft_sql(butter_sql(0.05, -3.0)))
put("bandpass_rows", unrolled("bandpass"), dft_sql(f"{butter_sql(0.05, -5.0)} - {butter_sql(0.2, -5.0)}"))
put("hwp_notch_rows", unrolled("hwp_notch"), dft_sql("CASE WHEN least(abs(f - 0.1), abs(f - 0.2), abs(f - 0.1 * 3)) > 0.05 THEN 1 ELSE 0 END"))
put("broaden_beam_rows", unrolled("broaden_beam"), dft_sql("exp(-2 * pow(pi() * f * 2, 2))"))
put(
    "power_spectra_rows", unrolled("power_spectra", "p", "power"),
    f"""WITH {SAMPLES}, n AS (SELECT det, count(*) AS n, avg(value) AS m FROM samples GROUP BY 1), fr AS (SELECT det, n, m, CAST(unnest(range(n // 2 + 1)) AS BIGINT) AS j FROM n)
 SELECT det, CAST(j AS INT) AS k, round((pow(sum((value - m) * cos(2 * pi() * (j * sample % n) / n)), 2) + pow(sum((value - m) * sin(2 * pi() * (j * sample % n) / n)), 2)) / n, 4) AS power FROM fr JOIN samples USING (det) GROUP BY det, n, j""",
)

QUERIES, ORACLE = Q, {k: nudged(v) for k, v in O.items()}
