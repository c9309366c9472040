"""Queries on transforms of whole grids; their twins are direct sums of cosines and sines."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fourier as fo
from .base import nudged, rounded
from .grids import GRID, LI, SHAPE, grid, li

Q: dict = {}
O: dict[str, str] = {}
C = F.col


def put(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    Q[name] = f
    if sql:
        O[name] = sql


def split(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Every second item's grid."""
    return li(spark, d).where(C("l_linenumber") % 2 == k).groupBy("y", "x").agg(F.sum("q").alias("v"))


SPLIT = "split{k} AS (SELECT y, x, sum(q) AS v FROM li WHERE l_linenumber % 2 = {k} GROUP BY 1, 2)"
FREQUENCIES = """fr AS (SELECT CAST(ky AS INT) AS ky, CAST(kx AS INT) AS kx, 2 * pi() * sqrt(pow((CASE WHEN ky > 12 THEN ky - 25 ELSE ky END) / 25.0, 2) + pow((CASE WHEN kx > 20 THEN kx - 40 ELSE kx END) / 40.0, 2)) AS l
 FROM range(25) a(ky), range(40) b(kx))"""


def forward(name: str, source: str) -> str:
    angle = "2 * pi() * ((ky * y % 25) / 25.0 + (kx * x % 40) / 40.0)"
    return f"{name} AS MATERIALIZED (SELECT ky, kx, l, sum(v * cos({angle})) AS re, -sum(v * sin({angle})) AS im FROM fr, {source} GROUP BY 1, 2, 3)"


def back(source: str, column: str = "v", digits: int | None = 4) -> str:
    angle = "2 * pi() * ((ky * y % 25) / 25.0 + (kx * x % 40) / 40.0)"
    total = f"sum(re * cos({angle}) - im * sin({angle})) / 1000"
    return f"SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, {total if digits is None else f'round({total}, {digits})'} AS {column} FROM ({source}), range(25) c(y), range(40) d(x) GROUP BY 1, 2"


WITH = f"WITH {LI}, {GRID}, {FREQUENCIES}"
BOTH = f"{WITH}, {SPLIT.format(k=0)}, {SPLIT.format(k=1)}, {forward('m0', 'split0')}, {forward('m1', 'split1')}"


def bump(l0: float, power: float, level: float) -> fo.Response:
    """A falling signal spectrum."""
    return lambda ly, lx: level / (1 + (fo.radius(ly, lx) / l0) ** power)


HIGH, BEAM = fo.butterworth(0.6, -3.0), fo.gaussian(0.9)
SEEN = [fo.Seen(fo.gaussian(0.8), lambda ly, lx: 1 / (1 + 0.1 / (fo.radius(ly, lx) + 0.2) ** 2), 0.02), fo.Seen(fo.gaussian(1.2), fo.flat(), 0.05)]
SIGNAL = bump(0.7, 3.0, 400.0)
#: The same as SQL, in frequencies l.
HIGH_SQL, BEAM_SQL = "CASE WHEN l = 0 THEN 0 ELSE 1 / (1 + pow(l / 0.6, -3.0)) END", "exp(-0.5 * pow(0.9 * l, 2))"
B0, B1, N0, N1 = "exp(-0.5 * pow(0.8 * m0.l, 2))", "exp(-0.5 * pow(1.2 * m0.l, 2))", "(0.02 / (1 + 0.1 / pow(m0.l + 0.2, 2)))", "0.05"
SIGNAL_SQL = "(400.0 / (1 + pow(m0.l / 0.7, 3.0)))"

put(
    "grid_transform", lambda s, d: rounded(fo.transform(grid(s, d), "v", SHAPE), "re", "im", digits=4),
    f"{WITH}, {forward('m', 'grid')} SELECT ky, kx, round(re, 4) AS re, round(im, 4) AS im FROM m WHERE kx <= 20",
)
put(
    "fourier_filtered", lambda s, d: rounded(fo.filtered(grid(s, d), "v", SHAPE, lambda ly, lx: HIGH(ly, lx) * BEAM(ly, lx)), "v", digits=4),
    f"{WITH}, {forward('m', 'grid')} " + back(f"SELECT ky, kx, re * w AS re, im * w AS im FROM (SELECT *, {HIGH_SQL} * {BEAM_SQL} AS w FROM m)"),
)
put(
    "source_response_map", lambda s, d: rounded(fo.source_response(grid(s, d), "v", SHAPE, 1.5, 0.25, power=2, keep=HIGH), "v", digits=4),
    f"{WITH}, {forward('m', 'grid')} " + back(f"SELECT ky, kx, re * w AS re, im * w AS im FROM (SELECT *, pi() * 2.25 * pow(0.25, 2) * exp(-0.25 * pow(1.5 * l, 2)) * {HIGH_SQL} AS w FROM m)"),
)


def halves(spark: SparkSession, d: str) -> list[DataFrame]:
    return [split(spark, d, 0), split(spark, d, 1)]


put(
    "wiener_map", lambda s, d: rounded(fo.combined(halves(s, d), SEEN, "v", SHAPE, signal=SIGNAL), "v", digits=4),
    f"{BOTH} " + back(f"SELECT ky, kx, (b0 * n0 * r0 + b1 * n1 * r1) / t AS re, (b0 * n0 * i0 + b1 * n1 * i1) / t AS im FROM (SELECT *, b0 * b0 * n0 + b1 * b1 * n1 + 1 / s AS t FROM (SELECT m0.ky, m0.kx, m0.re AS r0, m1.re AS r1, m0.im AS i0, m1.im AS i1, {B0} AS b0, {B1} AS b1, {N0} AS n0, {N1} AS n1, {SIGNAL_SQL} AS s FROM m0 JOIN m1 USING (ky, kx)))"),
)
put(
    "coadded_in_frequencies", lambda s, d: rounded(fo.combined(halves(s, d), SEEN, "v", SHAPE, target=SEEN[0].beam), "v", digits=4),
    f"{BOTH} " + back(f"SELECT ky, kx, (n0 * r0 + b * n1 * r1) / t AS re, (n0 * i0 + b * n1 * i1) / t AS im FROM (SELECT *, n0 + b * b * n1 AS t FROM (SELECT m0.ky, m0.kx, m0.re AS r0, m1.re AS r1, m0.im AS i0, m1.im AS i1, {B1} / {B0} AS b, {N0} AS n0, {N1} AS n1 FROM m0 JOIN m1 USING (ky, kx)))"),
)


#: With p = B Q an object's transform in each map: N^-1 v - N^-1 B S B' N^-1 v / (1 + S B' N^-1 B).
_TOLD = f"""k AS MATERIALIZED (SELECT ky, kx, re0, re1, im0, im1, n0, n1, b0, b1, p0, p1, s / (1 + s * (b0 * b0 * n0 + b1 * b1 * n1)) AS h FROM (SELECT m0.ky, m0.kx, m0.re AS re0, m1.re AS re1, m0.im AS im0, m1.im AS im1,
 {N0} AS n0, {N1} AS n1, {B0} AS b0, {B1} AS b1, {B0} * exp(-0.5 * pow(0.5 * m0.l, 2)) AS p0, 0.6 * {B1} * exp(-0.5 * pow(0.5 * m0.l, 2)) AS p1, {SIGNAL_SQL} AS s FROM m0 JOIN m1 USING (ky, kx))),
 g AS (SELECT sum(p0 * n0 * (p0 - b0 * h * u) + p1 * n1 * (p1 - b1 * h * u)) / 1000 AS inverse FROM (SELECT *, b0 * n0 * p0 + b1 * n1 * p1 AS u FROM k)),
 f AS (SELECT ky, kx, p0 * n0 * (re0 - b0 * h * ur) + p1 * n1 * (re1 - b1 * h * ur) AS re, p0 * n0 * (im0 - b0 * h * ui) + p1 * n1 * (im1 - b1 * h * ui) AS im FROM (SELECT *, b0 * n0 * re0 + b1 * n1 * re1 AS ur, b0 * n0 * im0 + b1 * n1 * im1 AS ui FROM k))"""


def profiles() -> list[fo.Response]:
    small = fo.gaussian(0.5)
    return [lambda ly, lx: SEEN[0].beam(ly, lx) * small(ly, lx), lambda ly, lx: 0.6 * SEEN[1].beam(ly, lx) * small(ly, lx)]


put(
    "matched_filter", lambda s, d: rounded(fo.matched(halves(s, d), SEEN, profiles(), "v", SHAPE, SIGNAL), "v", "inverse", "snr", digits=5),
    f"{BOTH}, {_TOLD} SELECT y, x, round(n / inverse, 5) AS v, round(inverse, 5) AS inverse, round(n / sqrt(inverse), 5) AS snr FROM ({back('SELECT * FROM f', 'n', None)}), g",
)


# ---- spectra of split differences


def splits(spark: SparkSession, d: str, n: int = 3) -> DataFrame:
    """Mean and number of hits of every n-th item's grid."""
    return li(spark, d).groupBy((C("l_linenumber") % n).cast("int").alias("map"), "y", "x").agg(F.avg("q").alias("v"), F.count(F.lit(1)).cast("double").alias("w"))


SPLITS = "sp AS (SELECT l_linenumber % 3 AS map, y, x, avg(q) AS v, count(*)::DOUBLE AS w FROM li GROUP BY 1, 2, 3)"
TILE = (5, 8)
_WINDOW = " * ".join(f"(CASE WHEN least({c}, {n - 1} - {c}) < 2 THEN 0.5 - 0.5 * cos(pi() * (least({c}, {n - 1} - {c}) + 1) / 3) ELSE 1 END)" for c, n in (("y % 5", 5), ("x % 8", 8)))
_SCALE = 1 / float(np.prod(TILE) * (fo.taper(5, 2)[:, None] * fo.taper(8, 2)).__pow__(2).mean())
_TILE_SUMS = f"""wd AS MATERIALIZED (SELECT map, y, x, v FROM {{source}}),
 tf AS (SELECT CAST(ky AS INT) AS ky, CAST(kx AS INT) AS kx, CAST(floor(2 * pi() * sqrt(pow((CASE WHEN ky > 2 THEN ky - 5 ELSE ky END) / 5.0, 2) + pow((CASE WHEN kx > 4 THEN kx - 8 ELSE kx END) / 8.0, 2)) / 0.75) AS INT) AS bin FROM range(5) a(ky), range(8) b(kx)),
 full_ AS (SELECT map, y // 5 AS ty, x // 8 AS tx FROM wd GROUP BY 1, 2, 3 HAVING count(*) >= 40 * {{least}}),
 t AS MATERIALIZED (SELECT map, ty, tx, ky, kx, bin, sum(v * {_WINDOW} * cos(2 * pi() * (ky * (y % 5) / 5.0 + kx * (x % 8) / 8.0))) AS re, sum(v * {_WINDOW} * sin(2 * pi() * (ky * (y % 5) / 5.0 + kx * (x % 8) / 8.0))) AS im
  FROM (SELECT *, y // 5 AS ty, x // 8 AS tx FROM wd) JOIN full_ USING (map, ty, tx), tf GROUP BY 1, 2, 3, 4, 5, 6),
 sp2 AS (SELECT a.map AS a, b.map AS b, a.bin, count(*) AS n, avg(a.re * b.re + a.im * b.im) * {_SCALE!r} AS power FROM t a JOIN t b USING (ty, tx, ky, kx) WHERE a.map <= b.map GROUP BY 1, 2, 3)"""
put(
    "tile_cross_spectra", lambda s, d: rounded(fo.tile_spectra(splits(s, d).withColumnRenamed("v", "value"), TILE, 0.75, edge=2, least=0.05), "power", digits=5),
    f"WITH {LI}, {SPLITS}, {_TILE_SUMS.format(source='sp', least=0.05)} SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, bin, n, round(power, 5) AS power FROM sp2",
)
put(
    "noise_spectrum", lambda s, d: rounded(fo.noise_spectrum(splits(s, d), "v", "w", TILE, 0.75, edge=2, least=0.05), "power", digits=6),
    f"""WITH {LI}, {SPLITS}, df AS (SELECT map, y, x, (v - m / t) / sqrt(1 / w - 1 / t) AS v FROM (SELECT *, sum(w) OVER c AS t, sum(v * w) OVER c AS m FROM sp WINDOW c AS (PARTITION BY y, x)) WHERE 1 / w - 1 / t > 1e-12 / w),
 {_TILE_SUMS.format(source='df', least=0.05)}, fl AS (SELECT map, avg(k / 40.0) AS f FROM (SELECT map, count(*) AS k FROM wd GROUP BY map, y // 5, x // 8 HAVING count(*) >= 2) GROUP BY 1)
 SELECT bin, CAST(sum(n) AS BIGINT) AS n, round(avg(power / f), 6) AS power FROM sp2 JOIN fl ON fl.map = a WHERE a = b GROUP BY 1""",
)


# ---- uneven depth: conjugate gradients (checked against dense solutions in tests)


def wiener_uneven(spark: SparkSession, d: str) -> DataFrame:
    """The Wiener filter of two maps with inverse variances by hits; noise spectra are those measured from their differences."""
    deep = [li(spark, d).where(C("l_linenumber") % 2 == k).groupBy("y", "x").agg(F.avg("q").alias("v"), (F.count(F.lit(1)) / 200.0).alias("w")) for k in (0, 1)]
    return rounded(fo.solved(deep, SEEN, "v", "w", SHAPE, signal=SIGNAL, steps=12, enough=1e-10), "v", digits=4)


def detrended_map(spark: SparkSession, d: str) -> DataFrame:
    """The grid less the smooth surface that fits its border."""
    edge = F.least(C("y"), 24 - C("y"), C("x"), 39 - C("x"))
    rows = grid(spark, d).withColumn("w", F.greatest(F.lit(0.0), 1 - edge / 6.0) + 1e-3)
    return rounded(fo.detrended(rows, "v", "w", SHAPE, lambda ly, lx: 1 / (1 + ((fo.radius(ly, lx) + 0.05) / 0.4) ** -3.5), steps=25, enough=1e-10), "v", digits=4)


put("wiener_uneven", wiener_uneven)
put("detrended_map", detrended_map)

QUERIES, ORACLE = Q, {k: nudged(v) for k, v in O.items()}
