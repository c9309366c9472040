"""Hits of moving telescopes on a map from what scans swept, without their samples.

A scan sweeps azimuths at one elevation again and again while the sky drifts by. Its arc at the start, at a few azimuths, is taken to
the sky and to map rows; for each row between, the arc's column is read off, and the drift until the scan's end gives the
width of what was hit: an interval of cells of one weight. Intervals are added to the map as differences (binning.add_rows), so
that cost goes with rows, not with cells or samples. Scans are dealt into tasks by their number, as each makes many rows, and an arc is read off where
its few points lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.maps import Grid
from .binning import add_rows
from .frames import Site, transformed

#: Scans of a task.
SCANS = 4096
#: Scans whose rows are given out at a time.
BATCH = 256


def _unwrapped(x: np.ndarray, turn: float) -> np.ndarray:
    """As sequences.unwrap."""
    steps = np.diff(x, prepend=x[:1]) / turn
    return x - np.cumsum(np.sign(steps) * np.floor(np.abs(steps) + 0.5)) * turn


def _read_off(y: np.ndarray, x: np.ndarray, wide: float, seconds: float) -> tuple[np.ndarray, ...] | None:
    """y, x1, x2, w of the rows along an arc (y, x) whose scan drifts by `wide` columns in all."""
    if not np.isfinite(y).all():
        return None
    if y[-1] < y[0]:
        y, x = y[::-1], x[::-1]
    slope, rows, order = np.gradient(y), np.arange(np.rint(y[0]), np.rint(y[-1]) + 1), np.argsort(y, kind="stable")
    at_x, at_slope = (np.where(rows <= y[0], v[0], np.where(rows >= y[-1], v[-1], np.interp(rows, y[order], v[order]))) for v in (x, slope))
    wide = wide if np.isfinite(wide) else 0.0
    w = np.zeros(len(rows))
    if wide != 0 and at_slope.min() > 0 and np.isfinite(seconds):
        w = 1 / at_slope / ((1 / at_slope).sum() * abs(wide)) * seconds
    return rows.astype(int), np.rint(np.minimum(at_x, at_x + wide)).astype(int), np.rint(np.maximum(at_x, at_x + wide)).astype(int), w


def row_ranges(scans: DataFrame, id: str, grid: Grid, daz: float = 1.0, nt: int = 4, target: str = "cel", site: Site | None = None, orientation: DataFrame | None = None, epoch: float = 55500.0) -> DataFrame:
    """id, y, x1, x2, w: row intervals that each scan hits, with w seconds a cell (times ndet).

    scans: id, mjd1, mjd2 (days), az1, az2, el (degrees), ndet. Arcs are read at about every daz degrees and interpolated linearly to rows;
    a row's weight goes with how slowly the arc passes it, and a scan's weights add up to its seconds times ndet. Scans that
    sweep under two steps have no rows, those whose arc turns back in latitude, or that don't drift, have rows of weight 0.
    """
    steps = F.round(F.abs(F.col("az2") - F.col("az1")) / daz).cast("int")
    own = scans.select(id, *[F.col(c).cast("double").alias(c) for c in ("mjd1", "mjd2", "az1", "az2", "el", "ndet")]).withColumn("n", steps).where(F.col(id).isNotNull() & (F.col("n") > 1))
    own = own.repartition(max(1, -(-own.count() // SCANS)), id)
    point = lambda drift, k, mjd, az: F.struct(F.lit(drift).alias("drift"), k.alias("k"), mjd.alias("mjd"), F.radians(az).alias("az"))
    arc = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: point(0, k, F.col("mjd1"), F.col("az1") + (F.col("az2") - F.col("az1")) * k / (F.col("n") - 1)))
    drift = F.transform(F.sequence(F.lit(0), F.lit(nt - 1)), lambda k: point(1, k, F.col("mjd1") + (F.col("mjd2") - F.col("mjd1")) * k / (nt - 1), F.col("az1")))
    points = own.select(id, ((F.col("mjd2") - F.col("mjd1")) * 86400 * F.col("ndet")).alias("seconds"), F.radians("el").alias("el"), F.explode(F.concat(arc, drift)).alias("p")).select(id, "seconds", "el", "p.*")
    sky = transformed(points, "hor", target, "az", "el", "mjd", orientation, site or Site(), epoch)
    flat = sky.select(id, "seconds", F.struct("drift", "k", grid.row(F.degrees("el")).cast("double").alias("y"), grid.column(F.degrees("az")).cast("double").alias("x")).alias("p"))
    lists = flat.groupBy(id).agg(F.first("seconds").alias("seconds"), F.array_sort(F.collect_list("p")).alias("p"))
    lists = lists.select(id, "seconds", F.aggregate("p", F.lit(0), lambda n, p: n + 1 - p["drift"]).alias("n"), F.col("p.y").alias("y"), F.col("p.x").alias("x"))
    turn, names = float(grid.turn), [id, "y", "x1", "x2", "w"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), BATCH):
                ids, found = [], []
                for i, seconds, n, y, x in frame.iloc[k : k + BATCH].itertuples(index=False):
                    y, x = np.asarray(y, float), np.asarray(x, float)
                    drift = np.rint(_unwrapped(x[n:], turn))
                    read = _read_off(y[:n], _unwrapped(x[:n], turn), drift[-1] - drift[0], np.nan if seconds is None else seconds)
                    if read is not None:
                        ids.append(np.repeat(np.asarray([i]), len(read[0])))
                        found.append(read)
                if found:
                    yield pd.DataFrame(dict(zip(names, [np.concatenate(ids), *(np.concatenate(c) for c in zip(*found, strict=True))], strict=True)))

    return lists.mapInPandas(run, f"{id} {dict(scans.dtypes)[id]}, y int, x1 long, x2 long, w double")


def weight_map(scans: DataFrame, id: str, grid: Grid, per_area: bool = False, **more: object) -> DataFrame:
    """y, x, total: seconds of all scans in each cell of the map (per square arc minute with per_area). x wraps if the map is a whole
    turn wide, else cells beyond its edges are left out."""
    ny, nx = grid.shape
    hit = add_rows(row_ranges(scans, id, grid, **more).where((F.col("y") >= 0) & (F.col("y") < ny) & (F.col("w") > 0)), grid.turn)
    hit = hit.where((F.col("x") < nx) & (F.col("total") > 1e-12))
    if not per_area:
        return hit
    lat = F.radians(F.lit(grid.lat0) + F.col("y") * grid.dlat)
    return hit.withColumn("total", F.col("total") / (F.cos(lat) * abs(grid.dlat * grid.dlon) * 3600))
