"""Labelled regions, significance, random fields, signals of several cells, stored preconditioners, sources that were planted."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyfield.operators import finder, simulate
from tallyfield.operators import fourier as fo
from tallyfield.operators import mapmaker as mm


def cells(spark, grid, ivar=None):
    rows = [(int(y), int(x), float(grid[y, x]), float(1.0 if ivar is None else ivar[y, x])) for y, x in np.ndindex(*grid.shape)]
    return spark.createDataFrame(rows, "y int, x int, v double, w double")


def test_planted_sources_are_found_and_measured(spark):
    """Sources of known place and amplitude on white noise: all strong ones are found, in place, within four deviations, none besides."""
    draw = np.random.default_rng(14)
    gy, gx = np.mgrid[:96, :128]
    planted = [(10, 12, 40.0), (31, 64, 25.0), (33, 90, 60.0), (64, 31, 30.0), (80, 100, 80.0), (50, 5, 35.0)]
    d = sum(a * np.exp(-((gy - y) ** 2 + (gx - x) ** 2) / (2 * 1.5**2)) for y, x, a in planted) + draw.normal(size=gy.shape)
    got = {(r.y, r.x): r for r in finder.find(cells(spark, d), "v", "w", 1.5, 32, 8, 6.0).collect()}
    assert set(got) == {(y, x) for y, x, _ in planted}
    assert all(abs(got[y, x].amp - a) < 4 * got[y, x].damp for y, x, a in planted)


def test_regions_of_points_and_of_wide_objects(spark):
    grid = np.zeros((12, 30))
    gy, gx = np.mgrid[:12, :30]
    grid += 10 * np.exp(-((gy - 5.3) ** 2 + (gx - 6.0) ** 2) / 4)
    grid -= 8 * np.exp(-((gy - 6.0) ** 2 + (gx - 15.5) ** 2) / 4)
    grid[4, 22] = grid[8, 26] = 5.0  # one label of two peaks: its middle is empty
    df = cells(spark, grid).withColumn("k", F.when(F.col("x") < 11, 1).when(F.col("x") < 20, 2).when(F.col("v") > 1, 3))
    got = {r.id: r for r in finder.measured_regions(df, "k", "v").collect()}
    assert (got[1].y, got[1].x) == pytest.approx((5.3, 6.0), abs=0.1) and got[1].amp > 9
    assert got[2].amp < -7 and got[2].x == pytest.approx(15.5, abs=0.2)
    assert (got[3].y, got[3].x, got[3].amp) == (8.0, 26.0, 5.0) or (got[3].y, got[3].x, got[3].amp) == (4.0, 22.0, 5.0)


def test_significance(spark):
    """Values that are 1.3 times a normal number plus 0.4 are recognised by their tail; few values give no correction."""
    draw = np.random.default_rng(15)
    top = np.sort(draw.normal(size=40_000))[::-1][:8000] * 1.3 + 0.4
    df = spark.createDataFrame([(float(v),) for v in top] + [(None,)], "v double").repartition(7)
    mu, sigma = finder.significance_correction(df, "v", 40_000)
    assert mu == pytest.approx(0.4, abs=0.15) and sigma == pytest.approx(1.3, abs=0.08)
    assert finder.significance_correction(df.limit(500), "v", 40_000) == (0.0, 1.0)


def test_random_fields_have_their_spectrum(spark):
    power = lambda ly, lx: 3 / (1 + (np.hypot(ly, lx) / 0.8) ** 2)
    made = simulate.field(spark, (64, 64), power, seed=5)
    for r in fo.tile_spectra(made.select(F.lit(0).alias("map"), "y", "x", "value"), (64, 64), 0.5).where("bin > 0").collect():
        assert r.power == pytest.approx(float(power((r.bin + 0.5) * 0.5, 0.0)), rel=6 / np.sqrt(r.n))
    again = {(r.y, r.x): r.value for r in simulate.field(spark, (64, 64), power, seed=5).collect()}
    assert all(again[r.y, r.x] == r.value for r in made.limit(50).collect())
    depth = cells(spark, np.zeros((64, 64)), np.where(np.indices((64, 64))[0] < 32, 4.0, 0.0)).drop("v")
    noise = simulate.noise_field(depth, "w", (64, 64), 0.01)
    r = noise.agg(F.count(F.lit(1)).alias("n"), F.stddev("value").alias("s")).first()
    assert r.n == 2048 and r.s == pytest.approx(0.5, rel=0.1)


def test_signals_of_several_cells(spark, tmp_path):
    """The solution with side beams is the dense one; forward and backward are transposes; diagonals are stored."""
    draw = np.random.default_rng(16)
    rows, p, d = [], np.zeros((80, 6)), draw.normal(size=80)
    for k in range(80):
        a, b = int(draw.integers(0, 6)), int(draw.integers(0, 6))
        p[k, a] += 1.0
        p[k, b] += 0.3
        rows.append((k, a, b, float(d[k]), 1.0 + k % 3))
    df = spark.createDataFrame(rows, "k int, a int, b int, value double, w double")
    beams = F.array(F.struct(F.col("a").alias("c"), F.lit(1.0).alias("f")), F.struct(F.col("b").alias("c"), F.lit(0.3).alias("f")))
    eq = mm.Equations(df, [mm.Spread("sky", ["k"], beams, ["c"])])
    w = np.array([r[4] for r in rows])
    a = p.T @ (p * w[:, None])
    got = {int(r.idx.split(":")[1]): r.value for r in eq.solve(steps=7, enough=1e-18).collect()}
    assert [got[k] for k in range(6)] == pytest.approx(np.linalg.solve(a, p.T @ (w * d)).tolist(), abs=1e-6)
    near = {int(r.idx.split(":")[1]): r.value for r in eq.around(spark.createDataFrame([("sky:2",)], "idx string")).collect()}
    assert [near[k] for k in range(6)] == pytest.approx(a[2].tolist())
    eq.write_diagonals(str(tmp_path))
    stored = {int(r.idx.split(":")[1]): r.d for r in spark.read.parquet(f"{tmp_path}/sky").collect()}
    assert [stored[k] for k in range(6)] == pytest.approx(np.diag(a).tolist())
    plain = mm.Equations(df, [mm.Binned("sky", ["a"])], priors=[mm.no_prior]).solve(steps=8, enough=1e-18, precondition=mm.unconditioned)
    means = {int(r.idx.split(":")[1]): r.value for r in plain.collect()}
    own = [r for r in rows if r[1] == 4]
    assert means[4] == pytest.approx(sum(r[3] * r[4] for r in own) / sum(r[4] for r in own))
