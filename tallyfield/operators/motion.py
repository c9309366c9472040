"""Moving objects and selections by position: ephemeris interpolation, displaced places, cuts around sources, orbit limits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..lineage import cut
from . import catalogs, intervals


def spline(table: DataFrame, queries: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Natural cubic splines through each key's (at, values); times outside the table are an error. One task holds one object."""
    a = table.select(key, at, *values)
    b = queries.select(F.col(key).alias(key), F.col(at).alias(at))
    shape = f"{key} {dict(queries.dtypes)[key]}, {at} double, " + ", ".join(f"{v} double" for v in values)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(at)
        x, t = left[at].to_numpy(float), right[at].to_numpy(float)
        if len(t) and (len(x) < 2 or t.min() < x[0] or t.max() > x[-1]):
            raise ValueError("a time lies outside the table")
        out = {key: right[key], at: t}
        for v in values:
            out[v] = natural_spline(x, left[v].to_numpy(float), t) if len(t) else []
        return pd.DataFrame(out)

    return a.groupBy(key).cogroup(b.groupBy(key)).applyInPandas(run, shape)


def natural_spline(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    n, h = len(x), np.diff(x)
    m = np.zeros(n)
    if n > 2:  # the system has three diagonals: one sweep down, one up
        diagonal, right = (2 * (h[:-1] + h[1:])).tolist(), (6 * np.diff(np.diff(y) / h)).tolist()
        for i in range(1, n - 2):
            w = h[i] / diagonal[i - 1]
            diagonal[i] -= w * h[i]
            right[i] -= w * right[i - 1]
        for i in range(n - 3, -1, -1):
            m[i + 1] = (right[i] - h[i + 1] * m[i + 2]) / diagonal[i]
    k = np.clip(np.searchsorted(x, t, "right") - 1, 0, n - 2)
    u, w = t - x[k], x[k + 1] - t
    return (m[k] * w**3 + m[k + 1] * u**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * w + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * u


def displaced(lon: Column, lat: Column, distance: Column, earth: tuple[float, float, float], moved: tuple[Column, Column] | None = None) -> Column:
    """Where an object at a Sun distance is seen from the Earth's place, after an own motion (d lon, d lat)."""
    if moved:
        lon, lat = lon + moved[0] / F.cos(lat), lat + moved[1]
    v = F.zip_with(F.transform(fn.unit(lon, lat), lambda x: x * distance), F.array(*map(F.lit, earth)), lambda a, b: a - b)
    return fn.angles(v)


def near_track(cells: DataFrame, track: DataFrame, radius: float, period: float | None = None) -> DataFrame:
    """Cells (id, x, y) within a radius of any place of any track (id, x, y): a moving mask."""
    return catalogs.pairs(cells, track, "id", "x", "y", radius, period).select("id").distinct()


def _places(rows: DataFrame, x: str, y: str, *sums: Column) -> DataFrame:
    """The places of rows, each once: id (x and y together), x, y and sums over its rows."""
    there = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(*(sums or [F.count(F.lit(1)).alias("n")]))
    return there.withColumn("id", F.struct("x", "y"))


def _hit(samples: DataFrame, places: DataFrame, key: list[str], at: str, x: str, y: str) -> DataFrame:
    """Ranges of the samples at given places (id)."""
    own = samples.select(*key, at, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    met = own.join(places.select(F.col("id.x").alias("_x"), F.col("id.y").alias("_y")), ["_x", "_y"], "left_semi")
    return intervals.from_mask(met.select(*key, at).distinct(), key, at, F.lit(True))


def cut_near(samples: DataFrame, sources: DataFrame, key: list[str], at: str, x: str, y: str, radius: float) -> DataFrame:
    """Ranges of samples within a radius of any source. Here and in cut_bright, sources meet the samples' places, each once."""
    near = catalogs.pairs(_places(samples, x, y), _places(sources, "x", "y"), "id", "x", "y", radius).select("id").distinct()
    return _hit(samples, near, key, at, x, y)


def cut_bright(samples: DataFrame, sources: DataFrame, key: list[str], at: str, x: str, y: str, sigma: float, include: float, size: float, offsets: list[tuple[float, float]] = [(0.0, 0.0)]) -> DataFrame:  # noqa: B006
    """Ranges where bright sources (amplitude >= include) add up to more than size, for any of the pointing offsets."""
    reach = sigma * math.sqrt(2 * math.log(max(10.0, 1e4)))
    every = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(offsets)])
    rows = _places(samples, x, y).withColumn("_o", F.explode(every))
    rows = rows.select(F.struct("id", "_o.k").alias("id"), (F.col("x") + F.col("_o.dx")).alias("x"), (F.col("y") + F.col("_o.dy")).alias("y"))
    bright = cut(_places(sources.where(F.col("amp") >= include), "x", "y", F.sum("amp").alias("amp")))
    near = catalogs.pairs(rows, bright, "id", "x", "y", reach).join(bright.select(F.col("id").alias("other"), "amp"), "other")
    model = near.groupBy("id").agg(F.sum(F.col("amp") * catalogs.beam_at(F.col("dist"), sigma)).alias("m")).where(F.col("m") > size)
    return _hit(samples, model.select("id.id").distinct(), key, at, x, y)


def plausible(rows: DataFrame, r: str, vx: str, vy: str, lat: str, rmin: float, rmax: float, vmax: float, incmax: float) -> DataFrame:
    """Candidates whose distance, speed (falling as r^-1.5 from vmax at rmin) and latitude could be those of an outer planet."""
    speed = F.sqrt(F.col(vx) ** 2 + F.col(vy) ** 2)
    return rows.where(F.col(r).between(rmin, rmax) & (speed <= vmax * F.pow(F.lit(rmin) / F.col(r), F.lit(1.5))) & (F.abs(lat) <= incmax))


def limit_distance(curve: DataFrame, key: list[str], r: str, flux: str, limit: float) -> DataFrame:
    """First distance at which a falling flux curve crosses the limit, interpolated; null if it never does."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*key).orderBy(r)
    rows = curve.withColumn("_r", F.lead(r).over(w)).withColumn("_f", F.lead(flux).over(w)).where((F.col(flux) >= limit) & (F.col("_f") < limit))
    at = F.col(r) + (F.col("_r") - F.col(r)) * (F.col(flux) - limit) / (F.col(flux) - F.col("_f"))
    return curve.select(*key).distinct().join(rows.groupBy(*key).agg(F.min_by(at, r).alias("limit_r")), key, "left")
