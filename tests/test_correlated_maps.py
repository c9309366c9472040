"""Maps of correlated noise: the right solution, in fewer steps through the samples; sources that come back in a map of their own."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyfield.operators import mapmaker as mm
from tallyfield.operators import noisemodels as nm
from tallyfield.operators import sources_apart as sa

MODEL = {"rate": 20.0, "knee": 2.0, "slope": -2.0, "common_knee": 1.5, "common_slope": -2.0}


def dense_covariance(n, sigma):
    """Detectors by samples, of the model above."""
    f = np.maximum(np.arange(n // 2 + 1), 0.5) * MODEL["rate"] / n
    out = np.zeros((len(sigma) * n, len(sigma) * n))
    full = np.concatenate([f, f[1 : (n + 1) // 2][::-1]])
    wave = np.fft.fft(np.eye(n)) / np.sqrt(n)
    for a, sa_ in enumerate(sigma):
        for b, sb in enumerate(sigma):
            spectrum = sa_ * sb * ((a == b) * (1 + (full / MODEL["knee"]) ** MODEL["slope"]) + (full / MODEL["common_knee"]) ** MODEL["common_slope"])
            out[a * n : (a + 1) * n, b * n : (b + 1) * n] = (wave.conj().T * spectrum @ wave).real
    return out


@pytest.fixture(scope="module")
def system(spark):
    """Two scans of two detectors over six pixels; noise correlated within a scan."""
    draw = np.random.default_rng(12)
    n, sigma, rows, a, b = 24, [1.0, 2.0], [], np.zeros((6, 6)), np.zeros(6)
    for scan in (0, 1):
        pixel = (np.arange(n)[None] // 2 + 3 * np.arange(2)[:, None] + scan) % 6
        value = draw.normal(size=(2, n))
        p = np.eye(6)[pixel.ravel()]
        inverse = np.linalg.inv(dense_covariance(n, sigma))
        a, b = a + p.T @ inverse @ p, b + p.T @ inverse @ value.ravel()
        rows += [(scan, d, t, int(pixel[d, t]), float(value[d, t]), 1.0, sigma[d]) for d in range(2) for t in range(n)]
    df = spark.createDataFrame(rows, "scan int, det int, at int, pixel int, value double, w double, s double")
    return df, np.linalg.solve(a, b), b


def over(covariance):
    return lambda rows: nm.common(rows, "scan", "det", "at", "r", "s", covariance=covariance, **MODEL)


def test_covariance_and_inverse_undo_each_other(spark, system):
    rows = system[0].withColumn("r", F.col("value"))
    back = over(False)(over(True)(rows))
    assert all(r.r == pytest.approx(r.value, abs=1e-8) for r in back.collect())


def test_the_samples_precondition_better_than_the_diagonal(spark, system):
    df, want, _ = system
    steps = {}
    for through in (False, True):
        eq = mm.Equations(df, [mm.Binned("sky", ["pixel"])], noise=over(False))
        eq.solve(steps=4, enough=1e-12, precondition=eq.through_samples(over(True)) if through else None)
        steps[through] = eq.trace
        if through:
            x = {int(r.idx.split(":")[1]): r.value for r in eq.solve(steps=8, enough=1e-20, precondition=eq.through_samples(over(True))).collect()}
            assert [x[k] for k in range(6)] == pytest.approx(want.tolist(), abs=1e-5)
    assert len(steps[True]) >= 1 and min(steps[True]) < min(steps[False])


def test_singular_systems_are_an_error(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, -1.0), (0, 2.0, 1.0, 1.0)], "pixel int, value double, w double, f double")
    eq = mm.Equations(df.withColumn("w", F.lit(0.0)).withColumn("value", F.lit(1.0)), [mm.Binned("sky", ["pixel"])])
    assert [r.value for r in eq.solve().collect()] == [0.0]  # nothing is known, nothing is asked for


def test_sources_come_back_in_their_own_map(spark):
    """A steep source on a drifting level: the rest's map doesn't see it, the sources' map does."""
    n, rows = 200, []
    for det in range(4):
        for t in range(n):
            y, x = det, t % 20
            rows.append((det, t, y, x, 0.02 * t + det + (50.0 if (y, x) == (2, 7) else 0.0)))
    df = spark.createDataFrame(rows, "det int, at int, y int, x int, v double")
    ranges = sa.near_sources(df, spark.createDataFrame([(2.0, 7.0)], "y double, x double"), "y", "x", 1.2, ["det"], "at")
    assert {r.det for r in ranges.collect()} == {1, 2, 3}
    parts = sa.parted(df, ranges, ["det"], "at", "v")
    got = {(r.y, r.x): r for r in sa.two_maps(parts, ["y", "x"], "v", F.lit(1.0)).collect()}
    assert got[2, 7].sources == pytest.approx(50.0, abs=0.05) and got[2, 7].rest == pytest.approx(2 + 0.02 * (7 + 90), abs=0.1)
    assert got[0, 7].sources == 0 and abs(got[2, 8].sources) < 0.1 and len(got) == 80
    assert all(r.sky == pytest.approx(r.rest + r.sources) for r in got.values())


def test_noise_predicted_from_around(spark):
    """A slow mode of all detectors goes, a short signal inside the ranges stays."""
    draw = np.random.default_rng(13)
    t = np.arange(256)
    mode = 30 * np.sin(2 * np.pi * 2 * t / 256)
    d = draw.uniform(0.5, 1.5, (6, 1)) * mode + draw.normal(size=(6, 256)) * 0.1
    d[3, 100:104] += 5
    df = spark.createDataFrame([(0, int(i), int(k), float(d[i, k])) for i, k in np.ndindex(*d.shape)], "scan int, det int, at int, v double")
    ranges = spark.createDataFrame([(0, 3, 96, 108)], "scan int, det int, lo int, hi int")
    got = np.zeros(d.shape)
    for r in sa.noise_predicted(df, ranges, "scan", "det", "at", "v", 20.0, 8.0, rate=256.0, threshold=1000.0).collect():
        got[r.det, r["at"]] = r.v
    assert np.abs(got[3, 100:104] - 5).max() < 1 and np.abs(np.delete(got, 3, axis=0)).mean() < 0.5
