"""Fits by aggregation and joint modes by tree against the same done on whole arrays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyfield.operators import fits, gapfill, lowrank, numerics


def test_fits_of_hot_missing_and_hopeless_groups(spark, monkeypatch):
    draw = np.random.default_rng(1)
    rows, true = [], {"hot": (3.0, 0.7), "few": (-2.0, 0.2), "noisy": (5.0, 1.1)}
    for g, (a, b) in true.items():
        for _ in range(3000 if g == "hot" else 40):
            x = float(draw.uniform(0, 4))
            rows.append((g, x, float(a * np.exp(-b * x) + (draw.normal(0, 0.05) if g == "noisy" else 0.0)), 1.0))
    rows += [("nothing", None, None, None), ("flat", 1.0, 0.0, 1.0), ("flat", 2.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, w double")
    model = lambda p: (p["a"] * F.exp(-p["b"] * F.col("x")), [F.exp(-p["b"] * F.col("x")), -p["a"] * F.col("x") * F.exp(-p["b"] * F.col("x"))])
    start = spark.createDataFrame([(g, 1.0, 1.0) for g in (*true, "nothing", "flat", "absent")], "g string, a double, b double")
    for few in (fits.FEW_GROUPS, 0):  # parameters broadcast, or shuffled
        monkeypatch.setattr(fits, "FEW_GROUPS", few)
        got = {r.g: r for r in fits.gauss_newton(df, ["g"], "y", "w", model, start, ["a", "b"]).collect()}
        assert set(got) == {*true, "flat"} and all(r.converged for r in got.values())
        assert (got["hot"].a, got["hot"].b, got["few"].a, got["few"].b) == pytest.approx((3.0, 0.7, -2.0, 0.2), rel=1e-6)
        assert got["flat"].a == pytest.approx(0, abs=1e-6)
        x, y = (np.array([r[k] for r in rows if r[0] == "noisy"]) for k in (1, 2))
        j = np.array([np.exp(-got["noisy"].b * x), -got["noisy"].a * x * np.exp(-got["noisy"].b * x)])
        assert np.allclose(j @ (y - got["noisy"].a * np.exp(-got["noisy"].b * x)), 0, atol=1e-4)  # a stationary point


def test_bounds_hold(spark):
    df = spark.createDataFrame([(1, float(x), 2.0 * x, 1.0) for x in range(1, 9)], "g int, x double, y double, w double")
    start = spark.createDataFrame([(1, 0.5)], "g int, a double")
    got = fits.gauss_newton(df, ["g"], "y", "w", lambda p: (p["a"] * F.col("x"), [F.col("x")]), start, ["a"], {"a": (0.0, 1.5)}).first()
    assert got.a == pytest.approx(1.5)


def matrix(spark, d, group=0):
    return spark.createDataFrame([(group, int(i), int(t), float(d[i, t])) for i, t in np.ndindex(*d.shape)], "g int, det int, at int, v double")


@pytest.mark.parametrize("span", [5, 64, 4096])
def test_vectors_are_those_of_the_whole_matrix(spark, span):
    d = np.random.default_rng(2).normal(size=(6, 333)) * np.array([9, 7, 5, 3, 2, 1])[:, None]
    found = lowrank.vectors(matrix(spark, d), ["g"], "det", "at", "v", span).collect()
    u, s, _ = np.linalg.svd(d, full_matrices=False)
    assert {r["mode"]: r.s for r in found} == pytest.approx(dict(enumerate(s)))
    for r in found:
        assert abs(r.v) == pytest.approx(abs(u[r.det, r["mode"]]), abs=1e-9)


def test_groups_with_other_detectors_per_block(spark):
    """Detectors that are there in some blocks only, and groups of other sizes."""
    draw = np.random.default_rng(3)
    rows = [(g, det, at, float(draw.normal())) for g in (1, 2) for det in range(3 + g) for at in range(50 * g) if (at // 10 + det) % 3]
    df = spark.createDataFrame(rows, "g int, det int, at int, v double")
    found = lowrank.vectors(df, ["g"], "det", "at", "v", 10)
    for g in (1, 2):
        m = np.zeros((3 + g, 50 * g))
        for _, det, at, v in (r for r in rows if r[0] == g):
            m[det, at] = v
        got = {r["mode"]: r.s for r in found.where(F.col("g") == g).collect()}
        assert got == pytest.approx(dict(enumerate(np.linalg.svd(m, compute_uv=False))))
    assert lowrank.vectors(df.limit(0), ["g"], "det", "at", "v").collect() == []


def test_deprojection_is_the_dense_one(spark):
    draw = np.random.default_rng(4)
    modes = draw.normal(size=(2, 200))
    d = draw.normal(size=(9, 2)) @ modes * 5 + draw.normal(size=(9, 200)) + draw.normal(size=(9, 1)) * 3
    dark = np.arange(9) % 3 == 0
    df = matrix(spark, d).withColumn("dark", F.col("det") % 3 == 0)
    got = np.zeros_like(d)
    for r in lowrank.deproject(df, ["g"], "at", "v", "det", "dark", 2, span=32).collect():
        got[r.det, r["at"]] = r.v
    want = d - d.mean(axis=1, keepdims=True)
    basis = np.linalg.svd(want[dark], full_matrices=False)[2][:2]
    want[~dark] -= want[~dark] @ basis.T @ basis
    assert np.allclose(got, want)
    none = lowrank.deproject(df.where("NOT dark"), ["g"], "at", "v", "det", "dark", 2)
    assert none.count() == 6 * 200 and abs(none.groupBy("det").agg(F.avg("v").alias("m")).agg(F.max("m")).first()[0]) < 1e-9


def test_gaps_are_filled_from_modes(spark):
    """Equals the rounds on one dense matrix, and brings a planted mode back."""
    draw = np.random.default_rng(5)
    d = draw.normal(size=(8, 1)) * np.sin(np.arange(300) / 9) * 20 + draw.normal(size=(8, 300)) * 0.1
    gaps = [(2, 100, 130), (5, 200, 210), (5, 0, 3)]
    ranges = spark.createDataFrame([(0, *g) for g in gaps], "g int, det int, lo int, hi int")
    df = matrix(spark, d)
    start, cut = np.zeros_like(d), np.zeros(d.shape, bool)
    for r in gapfill.linear(df, ranges, ["g", "det"], "at", "v").collect():
        start[r.det, r["at"]] = r.v
    for det, lo, hi in gaps:
        cut[det, lo:hi] = True
    want = start
    for _ in range(4):
        mean = want.mean(axis=1, keepdims=True)
        values, v = np.linalg.eigh((want - mean) @ (want - mean).T)
        strong = v[:, values > 4 * np.median(values)]
        want = np.where(cut, strong @ (strong.T @ (want - mean)) + mean, want)
    got = np.zeros_like(d)
    for r in gapfill.eigenmodes(df, ranges, "g", "det", "at", "v").collect():
        got[r.det, r["at"]] = r.v
    assert np.allclose(got, want, atol=1e-8) and np.abs(got - d)[cut].max() < 0.15 * np.abs(d).max()
    flat = gapfill.eigenmodes(matrix(spark, np.ones((3, 20))), ranges.limit(0), "g", "det", "at", "v").collect()
    assert {r.v for r in flat} == {1.0}


@pytest.mark.parametrize("lag", [0, 3, -2])
def test_covariance_in_tiles_and_spans(spark, monkeypatch, lag):
    monkeypatch.setattr(numerics, "TILE", 2)
    monkeypatch.setattr(numerics, "SPAN", 7)
    draw = np.random.default_rng(6)
    d = np.where(draw.random((7, 40)) < 0.3, np.nan, draw.normal(size=(7, 40)))
    df = matrix(spark, np.nan_to_num(d)).where(" OR ".join(f"(det = {i} AND at IN ({', '.join(str(t) for t in range(40) if not np.isnan(d[i, t]))}))" for i in range(7)))
    got = {(r.i, r.j): r.cov for r in numerics.covariance(df, "det", "at", "v", lag).collect()}
    want = {}
    for i, j in np.ndindex(7, 7):
        both = [d[i, t] * d[j, t + lag] for t in range(40) if 0 <= t + lag < 40 and not np.isnan(d[i, t] * d[j, t + lag])]
        if both:
            want[i, j] = np.mean(both)
    assert got == pytest.approx(want)
