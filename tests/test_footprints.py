"""Row intervals of scans against the same arcs on arrays; weights; maps."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyfield.operators import footprints as fp
from tallyfield.operators import frames as fr
from tallyfield.sources.maps import Grid

GRID = Grid((180, 720), -90.0, 180.0, 1.0, -0.5)
SITE = fr.Site()


def sky(mjd, az, el):
    """Right ascension and declination in degrees, by spherical trigonometry."""
    d = mjd - 51544.5
    t = d / 36525
    lst = np.radians(280.46061837 + 360.98564736629 * d + 0.000387933 * t**2 - t**3 / 38710000 + SITE.lon)
    az, el, lat = np.radians(az), np.radians(el), np.radians(SITE.lat)
    dec = np.arcsin(np.sin(lat) * np.sin(el) + np.cos(lat) * np.cos(el) * np.cos(az))
    return np.degrees(lst - np.arctan2(-np.cos(el) * np.sin(az), np.cos(lat) * np.sin(el) - np.sin(lat) * np.cos(el) * np.cos(az))) % 360, np.degrees(dec)


def arc(mjd1, mjd2, az1, az2, el, ndet, daz=1.0, nt=4):
    n = round(abs(az2 - az1) / daz)
    ra, dec = sky(mjd1, np.linspace(az1, az2, n), el)
    y, x = dec + 90, np.unwrap((ra - 180) / -0.5, period=720)
    if y[-1] < y[0]:
        y, x = y[::-1], x[::-1]
    rows = np.arange(np.rint(y[0]), np.rint(y[-1]) + 1)
    slope = np.interp(rows, y, np.gradient(y))
    drift = np.rint(np.unwrap((sky(np.linspace(mjd1, mjd2, nt), az1, el)[0] - 180) / -0.5, period=720))
    x1 = np.interp(rows, y, x)
    x2 = x1 + drift[-1] - drift[0]
    w = 1 / slope / (1 / slope).sum() / abs(drift[-1] - drift[0]) * (mjd2 - mjd1) * 86400 * ndet
    return rows, np.rint(np.minimum(x1, x2)), np.rint(np.maximum(x1, x2)), w


def test_rows_of_arcs(spark):
    rows = [(k, 60310.03 + k / 3, 60310.03 + k / 3 + 0.02, az, az + 35.0, 40.0 + k, 100) for k, az in enumerate((100.0, 120.0, 60.0, 230.0))]
    df = spark.createDataFrame(rows, "id int, mjd1 double, mjd2 double, az1 double, az2 double, el double, ndet int")
    got = fp.row_ranges(df, "id", GRID, epoch=51544.5).collect()
    for r in rows:
        own = sorted((g for g in got if g.id == r[0]), key=lambda g: g.y)
        y, x1, x2, w = arc(*r[1:])
        assert [g.y for g in own] == y.tolist() and np.allclose([g.w for g in own], w)
        turns = {(int(a) - g.x1) % 720 for a, g in zip(x1, own, strict=True)}
        assert turns <= {0, 1, 719} and np.allclose([g.x2 - g.x1 for g in own], x2 - x1, atol=1)
        assert sum(g.w * (g.x2 - g.x1) for g in own) == pytest.approx(0.02 * 86400 * 100, rel=0.1)


def test_scans_without_weight(spark):
    """Short sweeps have no rows; arcs that turn back in latitude, and scans that don't drift, have no weight."""
    df = spark.createDataFrame([(0, 60310.0, 60310.1, 100.0, 101.0, 40.0, 1), (1, 60310.0, 60310.1, 150.0, 215.0, 40.0, 1), (2, 60310.0, 60310.0, 100.0, 140.0, 40.0, 1)], "id int, mjd1 double, mjd2 double, az1 double, az2 double, el double, ndet int")
    got = fp.row_ranges(df, "id", GRID).collect()
    assert {r.id for r in got} == {1, 2} and {r.w for r in got} == {0.0}


def test_map_is_the_sum_of_intervals(spark):
    df = spark.createDataFrame([(k, 60310.0 + k / 7, 60310.02 + k / 7, 95.0 + k, 130.0 + k, 45.0, 1 + k) for k in range(6)], "id int, mjd1 double, mjd2 double, az1 double, az2 double, el double, ndet int")
    want = np.zeros(GRID.shape)
    for r in fp.row_ranges(df, "id", GRID).collect():
        want[r.y, np.arange(r.x1, r.x2) % 720] += r.w
    got = np.zeros(GRID.shape)
    for r in fp.weight_map(df, "id", GRID).collect():
        got[r.y, r.x] = r.total
    assert np.allclose(got, want) and want.sum() > 0
    dense = fp.weight_map(df, "id", GRID, per_area=True).agg(F.max("total")).first()[0]
    lat = np.cos(np.radians(-90.0 + np.arange(180)))[:, None]
    assert dense == pytest.approx((want / np.maximum(lat, 1e-9) / (0.5 * 3600)).max())


def test_scans_of_a_task_are_bounded(spark, monkeypatch):
    """the rows of a scan are made where its arc lies, neither joined nor sorted, and more scans are more tasks."""
    monkeypatch.setattr(fp, "SCANS", 8)
    df = spark.range(40).selectExpr("CAST(id AS STRING) id", "60310.0D + id / 7 mjd1", "60310.02D + id / 7 mjd2", "95.0D + id % 9 az1", "130.0D + id % 9 az2", "45.0D el", "1 ndet")
    df = df.unionByName(spark.sql("SELECT CAST(NULL AS STRING) id, 60310.0D mjd1, 60310.02D mjd2, 95.0D az1, 130.0D az2, 45.0D el, 1 ndet UNION ALL SELECT 'late', 60310.0D, NULL, 95.0D, 130.0D, 45.0D, 1 UNION ALL SELECT 'none', NULL, 60310.0D, 95.0D, 130.0D, 45.0D, 1"))
    got = fp.row_ranges(df, "id", GRID)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and got.rdd.getNumPartitions() == 6
    rows = got.collect()
    late = [r for r in rows if r.id == "late"]
    assert {r.id for r in rows} == {*map(str, range(40)), "late"} and late and all(r.w == 0 and r.x1 == r.x2 for r in late)
