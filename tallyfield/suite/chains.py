"""Queries on chains of coordinate systems, unsymmetric systems and resampling by angle."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import GALACTIC, OBLIQUITY
from ..operators import frames as fr
from ..operators import sequences as sq
from ..operators import solvers
from .base import nudged, rounded, samples, SAMPLES, table
from .numbers import SKY, sky, SYS

Q: dict = {}
O: dict[str, str] = {}
C = F.col
EPOCH = 60400.0


def put(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    Q[name] = f
    if sql:
        O[name] = sql


# ---- chains of systems


def pointings(spark: SparkSession, d: str) -> DataFrame:
    """A direction in the horizon's system and a time for every event."""
    return samples(spark, d).select("event_id", F.radians(C("det") * 7 % 360 + 0.25).alias("lon"), F.radians(20.5 + C("sample") % 60).alias("lat"), (60310 + C("t") / 86400).alias("mjd"))


def orientation(spark: SparkSession, d: str) -> DataFrame:
    """An offset of universal time for every nation, a fortnight each."""
    return table(spark, d, "nation").select((60300.0 + 14 * C("n_nationkey")).alias("mjd"), (0.35 - C("n_nationkey") / 50.0).alias("dut"))


SITE = fr.Site()
_P = fr.transposed(fr.precession(EPOCH))
_TO_SKY = f"""h AS (SELECT event_id, radians(det * 7 % 360 + 0.25) AS az, radians(20.5 + sample % 60) AS el, 60310 + t / 86400 AS mjd FROM samples),
 o AS (SELECT 60300.0::DOUBLE + 14 * n_nationkey AS mjd, 0.35::DOUBLE - n_nationkey / 50.0::DOUBLE AS dut FROM nation),
 u AS (SELECT h.*, h.mjd + dut / 86400 - 51544.5 AS d FROM h ASOF JOIN o ON h.mjd >= o.mjd),
 s AS (SELECT *, radians(280.46061837 + 0.98564736629 * floor(d) + 360.98564736629 * (d - floor(d)) + 0.000387933 * pow(d / 36525, 2) - pow(d / 36525, 3) / 38710000 + ({SITE.lon})) AS lst FROM u),
 e AS (SELECT *, asin(sin(radians({SITE.lat})) * sin(el) + cos(radians({SITE.lat})) * cos(el) * cos(az)) AS de, lst - atan2(-cos(el) * sin(az), cos(radians({SITE.lat})) * sin(el) - sin(radians({SITE.lat})) * cos(el) * cos(az)) AS ra FROM s),
 v AS (SELECT event_id, {", ".join(f"{r[0]!r} * cos(de) * cos(ra) + {r[1]!r} * cos(de) * sin(ra) + {r[2]!r} * sin(de) AS {c}" for r, c in zip(_P, "xyz", strict=True))} FROM e)"""
put(
    "horizon_to_sky", lambda s, d: rounded(fr.transformed(pointings(s, d), "hor", "cel", "lon", "lat", "mjd", orientation(s, d), epoch=EPOCH).select("event_id", "lon", "lat"), "lon", "lat"),
    f"WITH {SAMPLES}, {_TO_SKY} SELECT event_id, round(atan2(y, x), 6) AS lon, round(asin(z), 6) AS lat FROM v",
)


def around(spark: SparkSession, d: str) -> DataFrame:
    """From the boresight's system through telescope, horizon, sky and galaxy, and back again."""
    site = fr.Site(base_tilt=0.3, slope_az0=20.0, slope_el=-0.02)
    rows = samples(spark, d).select("event_id", F.radians(C("sample") * 5 % 360 - 179.75).alias("lon"), F.radians(89.0 - C("det") % 30 / 10.0).alias("lat"), (60310 + C("t") / 86400).alias("mjd"), F.radians(C("det") * 11 % 360).alias("b_lon"), F.radians(40.0 + C("sample") % 20).alias("b_lat"))
    way = {"time": "mjd", "orientation": orientation(spark, d), "site": site, "epoch": EPOCH, "bore": ("b_lon", "b_lat")}
    there = fr.transformed(rows, "bore", "gal", "lon", "lat", **way)
    return rounded(fr.transformed(there, "gal", "bore", "lon", "lat", **way).select("event_id", "lon", "lat"), "lon", "lat", digits=5)


put("chain_round_trip", around, f"WITH {SAMPLES} SELECT event_id, round(radians(sample * 5 % 360 - 179.75), 5) AS lon, round(radians(89.0 - det % 30 / 10.0), 5) AS lat FROM samples")
_POLE = math.atan2(GALACTIC[2][1], GALACTIC[2][0]), math.asin(GALACTIC[2][2])
put(
    "turn_angles", lambda s, d: rounded(fr.transformed(sky(s, d), "cel", "gal", "lon", "lat", turn="turn", size="size").select("id", "turn", "size"), "turn", "size", digits=6),
    f"""WITH {SKY} SELECT id, round(atan2(cos({_POLE[1]!r}) * sin({_POLE[0]!r} - lon), cos(lat) * sin({_POLE[1]!r}) - sin(lat) * cos({_POLE[1]!r}) * cos({_POLE[0]!r} - lon)), 6) AS turn,
 round(cos(lat) / cos(asin({GALACTIC[2][0]!r} * cos(lat) * cos(lon) + {GALACTIC[2][1]!r} * cos(lat) * sin(lon) + {GALACTIC[2][2]!r} * sin(lat))), 6) AS size FROM sky""",
)
put(
    "ecliptic_centred", lambda s, d: rounded(fr.transformed(sky(s, d), "cel", "ecl:120_35", "lon", "lat").select("id", "lat"), "lat"),
    f"""WITH {SKY}, e AS (SELECT id, cos(lat) * cos(lon) AS x, {math.cos(OBLIQUITY)!r} * cos(lat) * sin(lon) + {math.sin(OBLIQUITY)!r} * sin(lat) AS y, {-math.sin(OBLIQUITY)!r} * cos(lat) * sin(lon) + {math.cos(OBLIQUITY)!r} * sin(lat) AS z FROM sky)
 SELECT id, round(asin(greatest(-1, least(1, x * cos(radians(35)) * cos(radians(120)) + y * cos(radians(35)) * sin(radians(120)) + z * sin(radians(35))))), 6) AS lat FROM e""",
)


# ---- systems that are not symmetric: one for each part


def unsymmetric(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (C("p_size") / 10.0 + 2).alias("a"), (C("p_partkey") % 7 / 7.0).alias("b"))
    cells = [(0, 0, C("a")), (0, 1, C("b")), (1, 0, -C("b")), (1, 1, C("a") + 1), (1, 2, C("b")), (2, 0, F.lit(0.3)), (2, 1, C("b")), (2, 2, C("a") + 2)]
    entries = p.select("p_partkey", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), x.alias("a")) for i, j, x in cells])))
    right = p.select("p_partkey", F.posexplode(F.array(F.lit(1.0), C("b"), C("a"))).alias("i", "b"))
    out = solvers.bicgstab(entries, right, ["p_partkey"], steps=12)
    return rounded(out.groupBy("p_partkey").agg(*[F.max(F.when(C("i") == k, C("value"))).alias(f"x{k}") for k in range(3)]), "x0", "x1", "x2", digits=5)


_DET = "(a * ((a + 1) * (a + 2) - b * b) + b * b * (a + 2) + b * b * 0.3)"
put(
    "unsymmetric_systems", unsymmetric,
    f"""WITH {SYS} SELECT p_partkey, round((((a + 1) * (a + 2) - b * b) - b * (b * (a + 2) - b * a)) / {_DET}, 5) AS x0,
 round((a * (b * (a + 2) - b * a) + b * (a + 2) + 0.3 * b) / {_DET}, 5) AS x1, round((a * ((a + 1) * a - b * b) + b * (b * a + 0.3 * b) - b * b - 0.3 * (a + 1)) / {_DET}, 5) AS x2 FROM sys""",
)


# ---- series over even steps of a turning angle


def turning(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = samples(spark, d).select("det", "sample", F.pmod(0.9 * C("sample") + 0.2 * F.sin("sample"), F.lit(2 * math.pi)).alias("angle"))
    return sq.angle_uniform(rows, ["det"], "sample", "angle")


_TURNS = f"""WITH {SAMPLES}, a AS (SELECT det, sample AS s, 0.9 * sample + 0.2 * sin(sample) AS a FROM samples), st AS (SELECT *, a - lag(a) OVER (PARTITION BY det ORDER BY s) AS step, lead(a) OVER (PARTITION BY det ORDER BY s) AS next FROM a),
 sm AS (SELECT DISTINCT pow(2, i) * pow(3, j) * pow(5, k) * pow(7, l) AS n FROM range(12) a(i), range(8) b(j), range(6) c(k), range(5) d(l)),
 q AS (SELECT det, count(*) AS n_in, floor(max(a) / (2 * pi())) AS rev, round(2 * pi() / quantile_cont(step, 0.1)) AS per FROM st GROUP BY 1 HAVING max(a) >= 2 * pi()),
 sh AS (SELECT det, n_in, CAST((SELECT max(n) FROM sm WHERE n <= rev) AS BIGINT) AS nrev, CAST((SELECT min(n) FROM sm WHERE n >= per) AS BIGINT) AS nper FROM q),
 o AS (SELECT det, CAST(unnest(range(nrev * nper)) AS BIGINT) AS out, nper FROM sh), w AS (SELECT det, out, out * 2 * pi() / nper AS oa FROM o),
 f AS MATERIALIZED (SELECT w.det, out, s + coalesce((oa - a) / (next - a), 0) AS place FROM w ASOF JOIN st ON w.det = st.det AND w.oa >= st.a)"""
put("angle_shape", lambda s, d: rounded(turning(s, d)[0].select("det", "n_in", "nrev", "nper", "n_out", "rate"), "rate"), f"{_TURNS} SELECT det, n_in, nrev, nper, nrev * nper AS n_out, round((nrev * nper - 1) / (SELECT max(place) FROM f WHERE f.det = sh.det), 6) AS rate FROM sh")
put("angle_forward", lambda s, d: rounded(turning(s, d)[1], "place", digits=5), f"{_TURNS} SELECT det, out, round(place, 5) AS place FROM f")
put(
    "angle_inverse", lambda s, d: rounded(turning(s, d)[2], "place", digits=5),
    f"""{_TURNS}, g AS (SELECT *, lead(place) OVER (PARTITION BY det ORDER BY out) AS next FROM f)
 SELECT k.det, k.s AS sample, round(CASE WHEN k.s <= (SELECT max(place) FROM f WHERE f.det = k.det) THEN out + coalesce((k.s - place) / (next - place), 0) END, 5) AS place FROM (SELECT * FROM a SEMI JOIN sh USING (det)) k ASOF JOIN g ON k.det = g.det AND k.s >= g.place""",
)

QUERIES, ORACLE = Q, {k: nudged(v) for k, v in O.items()}
