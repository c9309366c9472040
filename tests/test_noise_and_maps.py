"""Noise models against dense matrices; sets of maps, regions, catalogues and shares: edges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyfield.operators import noise, splitting
from tallyfield.operators import noisemodels as nm
from tallyfield.sources import maps
from tallyfield.sources.text import FormatError


@pytest.fixture(scope="module")
def series():
    draw = np.random.default_rng(9)
    return draw.normal(size=(6, 2)) @ np.cumsum(draw.normal(size=(2, 64)), axis=1) + draw.normal(size=(6, 64)) + 3


def table(spark, d, group=0, first=0):
    return spark.createDataFrame([(group, int(i), int(t) + first, float(d[i, t])) for i, t in np.ndindex(*d.shape)], "scan int, det int, at int, v double")


def dense(df, shape, first=0):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.det, r["at"] - first] = r.v
    return out


def test_there_and_back(spark, series):
    """Odd and even lengths, groups of their own lengths, places that don't start at 0, missing samples."""
    for n in (63, 64):
        df = table(spark, series[:, :n], 1, 17).unionByName(table(spark, series[:2, :9], 2))
        back = nm.series(nm.frequencies(df, "scan", "det", "at", "v"), "scan", "det", "at", "v")
        assert np.allclose(dense(back.where("scan = 1"), (6, n), 17), series[:, :n]) and np.allclose(dense(back.where("scan = 2"), (2, 9)), series[:2, :9])
    some = nm.series(nm.frequencies(df.where("at <> 20"), "scan", "det", "at", "v"), "scan", "det", "at", "v").where("scan = 1")
    assert dense(some, (6, 64), 17)[0, 3] == pytest.approx(0) and nm.null(df) is df


def test_common_rise_is_the_dense_inverse(spark, series):
    n, sigma = series.shape[1], 1.0 + np.arange(6) % 3
    f = np.maximum(np.arange(n // 2 + 1), 0.5) * 50.0 / n
    ft = np.fft.rfft(series)
    for k, fk in enumerate(f):
        cov = np.diag(1 + (fk / 3.0) ** -3.0 * np.ones(6)) + (fk / 0.5) ** -4.0
        ft[:, k] = np.linalg.solve(np.diag(sigma) @ cov @ np.diag(sigma), ft[:, k])
    got = nm.common(table(spark, series).withColumn("s", 1.0 + F.col("det") % 3), "scan", "det", "at", "v", "s", rate=50.0)
    assert np.allclose(dense(got, series.shape), np.fft.irfft(ft, n)) and got.columns == ["scan", "det", "at", "v", "s"]


@pytest.mark.parametrize("window", [0, 5])
def test_measured_noise_is_that_of_the_dense_model(spark, series, window):
    n = series.shape[1]
    edge = np.minimum(np.arange(n), np.arange(n)[::-1])
    w = np.where(edge < window, 0.5 - 0.5 * np.cos(np.pi * (edge + 1) / (window + 1)), 1.0)
    want = noise.Measured(series * w, 4).apply(series * w) * w
    got = nm.weighted(table(spark, series), "scan", "det", "at", "v", 4, window=window)
    assert np.allclose(dense(got, series.shape), want, rtol=1e-6, atol=1e-9)


def test_several_modes_and_bins_without_any(spark, series):
    draw = np.random.default_rng(10)
    d, v, e = draw.uniform(1, 2, (3, 6)), draw.normal(size=(2, 3, 6)), np.array([[2.0, 0.5, 3.0], [1.0, 4.0, 0.0], [0, 0, 0]])
    which = [0, 1, 1]
    rows = nm.binned(nm.frequencies(table(spark, series), "scan", "det", "at", "v"), spark.createDataFrame([(0, [0.0, 0.1, 0.3])], "scan int, edges array<double>"), "scan")
    diag = spark.createDataFrame([(0, b, i, float(d[b, i])) for b, i in np.ndindex(3, 6)], "scan int, bin int, det int, d double")
    modes = spark.createDataFrame([(0, s, m, i, float(v[s, m, i])) for s, m, i in np.ndindex(2, 3, 6)], "scan int, set int, mode int, det int, v double")
    strengths = spark.createDataFrame([(0, b, m, float(e[b, m])) for b, m in np.ndindex(3, 3)], "scan int, bin int, mode int, e double")
    sets = spark.createDataFrame([(0, b, s) for b, s in enumerate(which)], "scan int, bin int, set int")
    ft = np.fft.rfft(series)
    for k in range(ft.shape[1]):
        b = int(np.searchsorted([0.0, 0.1, 0.3], k / 64, "right")) - 1
        ft[:, k] = np.linalg.solve(np.diag(d[b]) + (v[which[b]].T * e[b]) @ v[which[b]], ft[:, k])
    got = {(r.det, r.k): complex(r.re, r.im) for r in nm.low_rank(rows, diag, modes, strengths, "scan", "det", sets).collect()}
    assert len(got) == ft.size and all(abs(got[i, k] - ft[i, k]) < 1e-9 for i, k in got)
    plain = {(r.det, r.k): r.re for r in nm.low_rank(rows, diag, modes, strengths.where("e < 0"), "scan", "det", sets).collect()}
    assert plain[2, 0] == pytest.approx(series[2].sum() / d[0, 2])


def test_boxes_of_maps(spark, tmp_path):
    path = str(tmp_path)
    cells = spark.createDataFrame([("a", s, y, x, float(y * 100 + x), w) for s in (0, 1) for y in range(300) for x in range(8) for w in (1.0 if y != 299 else 1e-9,)] + [("b", 0, 5, 5, 1.0, 1.0), ("c", 0, 5, 5, float("nan"), 1.0), ("c", 1, 5, 5, 1.0, float("inf"))], "dataset string, split int, y int, x int, value double, ivar double")
    maps.write_maps(cells, spark.createDataFrame([(n, 2.0, 100.0, 1.0) for n in "abcd"], maps.MANIFEST), path)
    got = maps.read_box(spark, path, (250, 6, 300, 10), turn=8, fast=True)
    assert got.shape == (50, 4) and {r.dataset: r.n_good for r in got.datasets.collect()} == {"a": 2}
    rows = {(r.split, r.y, r.x): (r.value, r.ivar) for r in got.cells.collect()}
    assert len(rows) == 2 * 49 * 4 and rows[1, 0, 2] == (2 * 25000.0, 0.25) and rows[0, 48, 1] == (2 * 29807.0, 0.25)  # x = 6, 7, 0, 1
    assert "PartitionFilters: [isnotnull(ty" in maps.read_box(spark, path, (260, 0, 270, 4), prune=False).cells._jdf.queryExecution().executedPlan().toString()
    odd = maps.read_box(spark, path, (4, 4, 11, 7), prune=False)
    assert odd.shape == (7, 3) and {r.dataset: r.n_good for r in odd.datasets.collect()} == {"a": 2, "b": 1, "c": 1, "d": 0}
    assert [(r.value, r.ivar) for r in odd.cells.where("dataset = 'c'").collect()] == [(0.0, 0.25)]
    assert maps.read_box(spark, path, (1000, 0, 1010, 4)).cells.count() == 0
    assert maps.read_box(spark, path, (0, 0, 4, 4), least=3).datasets.count() == 0
    with pytest.raises(ValueError, match="unit"):
        maps.read_frequencies(spark, path, (0, 0, 4, 4), unit="K")


def test_pixel_window_and_units(spark, tmp_path):
    """A wave across the box loses what square cells took of it; temperatures become fluxes by the derivative of the black body."""
    path, n = str(tmp_path), 16
    rows = [("a", 0, y, x, float(np.cos(2 * np.pi * 3 * x / n)), 1.0) for y in range(n) for x in range(n)]
    maps.write_maps(spark.createDataFrame(rows, "dataset string, split int, y int, x int, value double, ivar double"), spark.createDataFrame([("a", 1.0, 150.0, 1.0)], maps.MANIFEST), path)
    got = {(r.y, r.x): r.value for r in maps.read_frequencies(spark, path, (0, 0, n, n), unit="uK").cells.collect()}
    assert got[0, 0] == pytest.approx(1 / np.sinc(3 / n)) and len(got) == n * n
    brightness = lambda t: 2 * maps.H * 150e9**3 / maps.LIGHT**2 / np.expm1(maps.H * 150e9 / (maps.K * t))
    per = (brightness(maps.T_CMB + 1e-3) - brightness(maps.T_CMB - 1e-3)) / 2e-3 * 1e26 * 1e3 / 1e6
    assert spark.range(1).select(maps.flux_per_temperature(F.lit(150.0)).alias("f")).first().f == pytest.approx(per, rel=1e-6)


def test_regions(spark, tmp_path):
    grid = maps.Grid((25, 40), -10.0, 20.0, 1.0, -0.5)
    rows = lambda spec: [tuple(r) for r in maps.regions(spark, spec, grid).orderBy("region").collect()]
    assert rows("full") == [(0, 0, 0, 25, 40)] and rows("tile") == [(0, 0, 0, 480, 480)] and grid.turn == 720
    assert rows("tile:10:30") == [(0, 0, 0, 10, 30), (1, 0, 30, 10, 60), (2, 10, 0, 20, 30), (3, 10, 30, 20, 60), (4, 20, 0, 30, 30), (5, 20, 30, 30, 60)]
    assert rows("box:-5:15:0:10:1:2:3:4") == [(0, 5, 10, 10, 20), (1, 11, 32, 13, 36)]
    with pytest.raises(FormatError):
        maps.regions(spark, "box:1:2:3", grid)
    (tmp_path / "b.txt").write_text("10 15 -5 0\n")
    assert rows(str(tmp_path / "b.txt")) == [(0, 5, 10, 10, 20)]
    thin = spark.createDataFrame([(0, 0, 0, 4, 40), (1, 0, 0, 3, 3), (2, 5, 5, 5, 9)], "region long, y1 int, x1 int, y2 int, x2 int")
    parts = maps.split_regions(thin, 8).collect()
    assert sum((r.y2 - r.y1) * (r.x2 - r.x1) for r in parts if r.region == 0) == 160 and len([r for r in parts if r.region == 0]) == 3
    assert [(r.y1, r.x1, r.y2, r.x2) for r in parts if r.region == 1] == [(0, 0, 3, 3)] and not [r for r in parts if r.region == 2]


def test_catalogues(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, 2.0, [3.0])], "ra double, dec double, flux array<double>")
    maps.write_catalogue(rows, str(tmp_path / "s"), "sources")
    got = maps.read_catalogue(spark, str(tmp_path / "s"), "sources").first()
    assert (got.ra, got.flux, got.status) == (1.0, [3.0], None)
    with pytest.raises(FormatError, match="no columns"):
        maps.write_catalogue(rows.withColumn("odd", F.lit(1)), str(tmp_path / "t"), "sources")
    with pytest.raises(FormatError, match="unknown"):
        maps.read_catalogue(spark, str(tmp_path / "s"), "nothing")


@pytest.mark.parametrize(("n", "boxes"), [(1, 50), (7, 400), (8, 3)])
def test_shares(spark, n, boxes):
    draw = np.random.default_rng(11)
    rows = [(k, float(draw.integers(1, 9)), *(y := draw.uniform(0, 10), y + 1), *(x := draw.uniform(-20, 20) % 360, x + 1)) for k in range(boxes)]
    df = spark.createDataFrame([tuple(map(float, r[1:])) + (r[0],) for r in rows], "c double, y1 double, y2 double, x1 double, x2 double, id int")
    got = splitting.shares(df, "id", "c", ("y1", "y2"), ("x1", "x2"), n, 360.0).collect()
    assert sorted(r.id for r in got) == list(range(boxes)) and {r.share for r in got} <= set(range(n))
    loads = [sum(r.c for r in got if r.share == k) for k in range(n)]
    assert max(abs(v - sum(loads) / n) for v in loads) <= 8 * (1 + np.log2(n))
    assert max(r.x1 for r in got) - min(r.x1 for r in got) < 41  # the boxes lie together again
    if boxes > 100:
        area = sum((max(r.y2 for r in got if r.share == k) - min(r.y1 for r in got if r.share == k)) * (max(r.x2 for r in got if r.share == k) - min(r.x1 for r in got if r.share == k)) for k in range(n))
        assert area < 2 * 11 * 41


def test_shares_of_odd_rows(spark):
    """Boxes at one place, null corners and costs."""
    df = spark.createDataFrame([(k, 1.0, 5.0, 5.0) for k in range(64)] + [(99, None, None, 1.0)], "id int, c double, y double, x double")
    got = splitting.shares(df, "id", "c", ("y", "y"), ("x", "x"), 4).collect()
    sizes = [sum(r.share == k for r in got) for k in range(4)]
    assert sum(sizes) == 65 and max(sizes) < 30
    assert splitting.shares(df.limit(0), "id", "c", ("y", "y"), ("x", "x"), 4).collect() == []
