"""Stores of scans, fits by sums, sets by cells, blocked products and streams against plain computations."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyfield.operators import catalogs, intervals, mapset, numerics, scans
from tallyfield.operators import gapfill as gf
from tallyfield.sources import text
from tallyfield.streaming import windows


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    return spark.createDataFrame([(d, t, rng.gauss(0, 1) + 0.1 * t, math.sin(t / 3), rng.random() < 0.2) for d in range(6) for t in range(2 + 9 * d)], "det int, t int, v double, az double, cut boolean")


@pytest.mark.parametrize("n_t, n_az", [(4, -3), (2, 2), (3, 0)])
def test_poly_filter_is_least_squares(spark, series, n_t, n_az):
    got = numerics.remove_poly(series, ["det"], "t", "v", n_t, "az", n_az, "cut").orderBy("det", "t").collect()
    for d in range(6):
        rows = sorted((r for r in series.collect() if r.det == d), key=lambda r: r.t)
        t, v, az, ok = (np.array([r[k] for r in rows], float) for k in ("t", "v", "az", "cut"))
        basis = np.hstack([numerics.legendre(t, abs(n_t)), numerics.legendre(az, abs(n_az) + 1)[:, 1:]])
        keep = ok == 0
        amps = np.linalg.lstsq(basis[keep], v[keep], rcond=None)[0] * np.array([n_t > 0] * abs(n_t) + [n_az > 0] * abs(n_az)) if keep.any() else np.zeros(basis.shape[1])
        assert np.allclose([r.v for r in got if r.det == d], v - basis @ amps, atol=1e-6)


def test_linear_gaps_at_edges_and_side_by_side(spark):
    v = [float(x * x) for x in range(30)]
    samples = spark.createDataFrame([(k, t, v[t]) for k in (0, 1, 2) for t in range(30) if (k, t) != (1, 7)], "det int, at int, value double")
    gaps = [(0, 0, 3), (0, 5, 6), (0, 8, 12), (0, 27, 30), (1, 6, 9), (1, 8, 10), (2, 0, 30), (2, 40, 50)]
    got = {(r.det, r["at"]): r.value for r in gf.linear(samples, spark.createDataFrame(gaps, "det int, lo int, hi int"), ["det"], "at", "value", 2).collect()}

    def mean(places):
        return (sum(v[t] for t in places) / len(places), sum(places) / len(places))

    def line(t, left, right):
        (a, ta), (b, tb) = mean(left), mean(right)
        return a + (b - a) * (t - ta) / (tb - ta)

    assert [got[0, t] for t in range(3)] == [mean([3, 4])[0]] * 3
    assert got[0, 5] == pytest.approx(line(5, [3, 4], [6, 7]))
    assert got[0, 9] == pytest.approx(line(9, [6, 7], [12, 13]))
    assert [got[0, t] for t in (27, 28, 29)] == [mean([25, 26])[0]] * 3
    assert got[1, 6] == pytest.approx(line(6, [4, 5], [10, 11])) and got[1, 9] == pytest.approx(line(9, [4, 5], [10, 11]))
    assert all(got[2, t] == 0 for t in range(30)) and got[0, 20] == v[20]


@pytest.mark.parametrize("period", [None, 40.0, 7.0])
def test_sets_by_cells(spark, period):
    rng = random.Random(2)
    rows = [(k, rng.choice([rng.uniform(0, 40), 12.0]), rng.choice([rng.uniform(-10, 10), 3.0])) for k in range(300)] + [(900, None, 1.0), (901, float("nan"), 1.0)]
    got = {r.id: r.grp for r in catalogs.independent_by_cells(spark.createDataFrame(rows, "id int, x double, y double"), "id", "x", "y", 3.0, period).collect()}
    assert set(got) == {r[0] for r in rows} and got[900] == got[901] == 0

    def near(a, b):
        dx = a[1] - b[1]
        return math.hypot(dx - (round(dx / period) * period if period else 0), a[2] - b[2]) <= 3.0

    for k, a in enumerate(rows[:300]):
        others = {got[b[0]] for b in rows[:300] if b is not a and near(a, b)}
        assert got[a[0]] not in others and set(range(got[a[0]])) <= others  # apart, and no lesser set was free


def test_covariance_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(numerics, "TILE", 2)
    monkeypatch.setattr(numerics, "SPAN", 5)
    rng = random.Random(3)
    d = {(i, t): rng.random() for i in range(7) for t in range(23) if rng.random() < 0.8}
    df = spark.createDataFrame([(i, t, x) for (i, t), x in d.items()] + [(3, 99, None)], "det int, at int, value double")
    got = {(r.i, r.j): r.cov for r in numerics.covariance(df, "det", "at", "value", 2).collect()}
    for i in range(7):
        for j in range(7):
            both = [d[i, t] * d[j, t + 2] for t in range(23) if (i, t) in d and (j, t + 2) in d]
            assert got[i, j] == pytest.approx(sum(both) / len(both))


def test_scans_are_pruned_where_they_are_read(spark, tmp_path):
    rows = spark.range(600).select((F.col("id") % 3).cast("int").alias("scan"), (F.col("id") % 5).cast("int").alias("det"), F.floor(F.col("id") / 15).cast("int").alias("sample"), F.col("id").cast("double").alias("value"))
    scans.write_scans({"samples": rows, "cuts": spark.createDataFrame([(0, 1, 3, 9), (0, 2, 0, 2), (1, 1, 30, 40)], "scan int, det int, lo int, hi int")}, str(tmp_path))
    s = scans.Scans(spark, str(tmp_path)).select(ids=[0, 7], dets=[1, 2, 9]).select(dets=[1, 2], without=[2]).slice(4, 30, 3).slice(0, 4, 2)
    df = s.part("samples")
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "scan" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(sample,4)" in plan
    assert sorted((r.scan, r.det, r.sample) for r in df.collect()) == [(0, 1, k) for k in range(2)]  # samples 4 and 10
    assert sorted(tuple(r) for r in s.part("cuts").select("det", "lo", "hi").collect()) == [(1, 0, 1)]
    with pytest.raises(ValueError):
        s.slice(3, 1)


def test_masks_and_streams(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0), (5, 5), (5, 6)], "y int, x int")
    want = {(y + i, x + j) for y, x in ((0, 0), (5, 5), (5, 6)) for i in range(-4, 5) for j in range(-4, 5) if i * i + j * j <= 16}
    assert {(r.y, r.x) for r in mapset.within(cells, 4).collect()} == want
    spark.range(10).select(F.lit("a").alias("event_type"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("double").alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    stream = windows.moments(windows.events(spark, f"{tmp_path}/events.parquet"), "event_type", "value")
    assert [tuple(r) for r in windows.run_to_end(stream, "complete", f"{tmp_path}/run").collect()] == [("a", 10, 4.5, pytest.approx(8.25**0.5))]


def test_settings_in_a_block_are_taken_back():
    s = text.Settings()
    s.default("order", 3)
    with pytest.raises(RuntimeError), s.scoped("order", 1):
        assert s.get("order") == 1
        raise RuntimeError
    assert s.get("order") == 3 and s.parse(["--other", "1", "--order=2"]) == ["--other", "1"] and s.get("order") == 2
    with pytest.raises(text.FormatError):
        s.parse(["--order"])


def test_merge_of_touching_ranges_in_any_order(spark):
    rows = [(0, 3, 5), (0, 3, 5), (0, 0, 3), (0, 9, 9), (0, 7, 8), (1, 2, 4), (0, 3, 4)]
    got = intervals.merge(spark.createDataFrame(rows, "det int, lo int, hi int"), ["det"])
    assert sorted(tuple(r) for r in got.select("det", "lo", "hi").collect()) == [(0, 0, 5), (0, 7, 8), (1, 2, 4)]
