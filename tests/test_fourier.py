"""Transforms in blocks against whole ones; solutions against dense systems; spectra against plain sums."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyfield.operators import fourier as fo

SHAPE = (6, 9)
PIXEL = (0.5, 2.0)


def frame(spark, grid, *more):
    rows = [(int(y), int(x), float(grid[y, x]), *(float(m[y, x]) for m in more)) for y, x in np.ndindex(*grid.shape)]
    return spark.createDataFrame(rows, "y int, x int, v double" + "".join(f", w{k} double" for k in range(len(more))))


def dense(df, value="v"):
    out = np.full(SHAPE, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[value]
    return out


@pytest.fixture(scope="module")
def grid():
    return np.random.default_rng(3).normal(size=SHAPE)


def frequencies():
    return 2 * np.pi * np.fft.fftfreq(SHAPE[0], PIXEL[0])[:, None], 2 * np.pi * np.fft.fftfreq(SHAPE[1], PIXEL[1])[None]


response = lambda ly, lx: 1 / (1 + np.abs(ly)) + 0.3 * lx**2


@pytest.mark.parametrize("cells", [1, 12, 1 << 20])
def test_filter_in_blocks(spark, grid, monkeypatch, cells):
    monkeypatch.setattr(fo, "CELLS", cells)
    want = np.fft.ifft2(np.fft.fft2(grid) * response(*frequencies())).real
    assert np.allclose(dense(fo.filtered(frame(spark, grid), "v", SHAPE, response, PIXEL)), want)
    f = np.fft.fft2(grid)
    for r in fo.transform(frame(spark, grid), "v", SHAPE).collect():
        assert abs(f[r.ky, r.kx] - complex(r.re, r.im)) < 1e-9


def test_missing_repeated_and_outer_cells(spark, grid):
    own = grid.copy()
    own[2, 3] = 0
    rows = frame(spark, own).where("v <> 0").unionByName(spark.createDataFrame([(0, 0, 5.0), (9, 0, 1.0), (0, -1, 1.0), (2, 3, None)], "y int, x int, v double"))
    own[0, 0] += 5
    got = dense(fo.filtered(rows, "v", SHAPE, fo.flat()))
    assert np.allclose(got, own)
    assert fo.filtered(rows.limit(0), "v", SHAPE, fo.flat()).collect() == []


def test_several_maps_at_once(spark, grid):
    other = grid[::-1] * 2
    out = fo.through(fo.stacked([frame(spark, grid), frame(spark, other)], "v"), SHAPE, 2, lambda f, ly, lx: np.stack([f[0] - f[1], f[0] * 2, f[1]]))
    for k, want in enumerate((grid - other, grid * 2, other)):
        assert np.allclose(dense(out.where(F.col("map") == k), "value"), want)


def test_point_source(spark):
    """A single cell becomes a beam of the asked peak, to the power asked for."""
    one = np.zeros((40, 40))
    one[20, 20] = 3.0
    for power in (1, 2):
        got = {(r.y, r.x): r.v for r in fo.source_response(frame(spark, one), "v", (40, 40), 2.0, 0.5, power=power).collect()}
        for y, x in ((20, 20), (22, 20), (21, 23)):
            assert got[y, x] == pytest.approx(3 * (0.5 * np.exp(-((y - 20) ** 2 + (x - 20) ** 2) / 8)) ** power, abs=1e-4)


def circulant(of):
    """The matrix of a filter over cells."""
    n = SHAPE[0] * SHAPE[1]
    return np.array([np.fft.ifft2(np.fft.fft2(e.reshape(SHAPE)) * of).real.ravel() for e in np.eye(n)]).T


SEEN = [fo.Seen(fo.gaussian(0.4), lambda ly, lx: 1 / (1 + 0.3 / (fo.radius(ly, lx) + 0.5))), fo.Seen(fo.gaussian(0.7), fo.flat(2.0))]
SIGNAL = lambda ly, lx: 5 / (1 + fo.radius(ly, lx) ** 2)


def test_wiener_filter_of_uneven_maps(spark, grid):
    draw = np.random.default_rng(4)
    maps, depth = [grid, grid + draw.normal(size=SHAPE)], [draw.uniform(0.5, 2, SHAPE), draw.uniform(0.0, 3, SHAPE)]
    depth[1][2:4, 5] = 0  # cells that one map hasn't seen
    a, b = circulant(1 / SIGNAL(*frequencies())), np.zeros(grid.size)
    for m, w, s in zip(maps, depth, SEEN, strict=True):
        beam, noise, h = circulant(s.beam(*frequencies())), circulant(s.inverse_noise(*frequencies())), np.diag(np.sqrt(w.ravel()))
        a += beam @ h @ noise @ h @ beam
        b += beam @ h @ noise @ h @ m.ravel()
    trace: list[float] = []
    got = fo.solved([frame(spark, m, w).withColumnRenamed("w0", "w") for m, w in zip(maps, depth, strict=True)], SEEN, "v", "w", SHAPE, signal=SIGNAL, steps=30, enough=1e-14, trace=trace, pixel=PIXEL)
    assert np.allclose(dense(got).ravel(), np.linalg.solve(a, b), atol=1e-5) and trace[-1] < 1e-10


def test_even_depth_is_one_pass(spark, grid):
    """With the same depth everywhere the iteration's first guess is the solution, with and without a signal."""
    maps = [frame(spark, grid, np.full(SHAPE, 0.5)).withColumnRenamed("w0", "w"), frame(spark, grid[::-1], np.full(SHAPE, 2.0)).withColumnRenamed("w0", "w")]
    seen = [fo.Seen(s.beam, s.inverse_noise, w) for s, w in zip(SEEN, (0.5, 2.0), strict=True)]
    for kind in ({"signal": SIGNAL}, {"target": fo.gaussian(0.3)}):
        trace: list[float] = []
        slow = fo.solved(maps, SEEN, "v", "w", SHAPE, steps=4, enough=1e-10, trace=trace, pixel=PIXEL, **kind)
        assert np.allclose(dense(slow), dense(fo.combined(maps, seen, "v", SHAPE, pixel=PIXEL, **kind)), atol=1e-5) and len(trace) <= 2


def test_detrended(spark, grid):
    weight = np.zeros(SHAPE)
    weight[[0, -1]] = weight[:, [0, -1]] = 1.0
    weight += 1e-2
    smooth = lambda ly, lx: 0.1 + fo.radius(ly, lx) ** 2
    trend = np.linalg.solve(np.diag(weight.ravel()) + circulant(smooth(*frequencies())), (weight * grid).ravel())
    got = fo.detrended(frame(spark, grid, weight), "v", "w0", SHAPE, smooth, steps=40, enough=1e-16, pixel=PIXEL)
    assert np.allclose(dense(got), grid - trend.reshape(SHAPE), atol=1e-6)


def test_matched_filter_finds_the_amplitude(spark):
    """An object with the given profiles is found with its amplitude, and the deviation is that of the generalised least squares."""
    profiles = [fo.gaussian(0.6), fo.gaussian(0.9)]
    seen = [fo.Seen(s.beam, s.inverse_noise, w) for s, w in zip(SEEN, (0.5, 2.0), strict=True)]
    own = np.zeros(SHAPE)
    own[3, 4] = 7.0
    maps = [frame(spark, np.fft.ifft2(np.fft.fft2(own) * p(*frequencies())).real) for p in profiles]
    got = fo.matched(maps, seen, profiles, "v", SHAPE, SIGNAL, PIXEL)
    assert dense(got)[3, 4] == pytest.approx(7.0)
    n = SHAPE[0] * SHAPE[1]
    beams, q = [circulant(s.beam(*frequencies())) for s in seen], np.concatenate([circulant(p(*frequencies()))[:, 0] for p in profiles])
    noise = np.zeros((2 * n, 2 * n))
    for k, s in enumerate(seen):
        noise[k * n : (k + 1) * n, k * n : (k + 1) * n] = circulant(1 / (s.weight * s.inverse_noise(*frequencies())))
    b = np.concatenate(beams)
    total = noise + b @ circulant(SIGNAL(*frequencies())) @ b.T
    assert got.first().inverse == pytest.approx(q @ np.linalg.solve(total, q))


def test_tiles(spark):
    draw = np.random.default_rng(6)
    a, b = draw.normal(size=(2, 12, 20))
    rows = fo.stacked([frame(spark, a), frame(spark, b).where("NOT (y < 4 AND x < 5 AND x > 0)")], "v")
    got = {(r.a, r.b, r.bin): (r.n, r.power) for r in fo.tile_spectra(rows, (4, 5), 1.0, edge=1).collect()}
    window = fo.taper(4, 1)[:, None] * fo.taper(5, 1)
    ring = np.hypot(2 * np.pi * np.fft.fftfreq(4)[:, None], 2 * np.pi * np.fft.fftfreq(5)).astype(int)
    want: dict = {}
    for ty, tx in np.ndindex(3, 4):
        part = [np.fft.fft2(m[ty * 4 : ty * 4 + 4, tx * 5 : tx * 5 + 5] * window) for m in (a, b)]
        for i, j in ((0, 0), (0, 1), (1, 1)):
            if (ty, tx) == (0, 0) and j == 1:
                continue  # too few cells of the second map
            for k in np.unique(ring):
                want.setdefault((i, j, k), []).append((part[i] * part[j].conj()).real[ring == k])
    want = {k: (np.concatenate(v).size, np.concatenate(v).mean() / (window**2).sum()) for k, v in want.items()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    some = {r.bin: r.n for r in fo.tile_spectra(rows, (4, 5), 1.0, share=0.5, seed=3).where("a = 0 AND b = 0").collect()}
    assert 0 < sum(some.values()) < 240 and sum(some.values()) % 20 == 0


def test_whitened_noise_has_level_one(spark):
    """White noise with the given inverse variances, over a common sky: the spectrum of whitened differences is 1."""
    draw = np.random.default_rng(7)
    sky, rows = 10 * draw.normal(size=(40, 40)), []
    for k in range(4):
        w = draw.uniform(0.5, 4, (40, 40))
        m = sky + draw.normal(size=w.shape) / np.sqrt(w)
        rows += [(k, int(y), int(x), float(m[y, x]), float(w[y, x])) for y, x in np.ndindex(40, 40) if (x + y * 3 + k) % 9]
    splits = spark.createDataFrame(rows, "map int, y int, x int, v double, w double")
    for r in fo.noise_spectrum(splits, "v", "w", (8, 8), 0.8, edge=2).collect():
        assert r.power == pytest.approx(1.0, abs=5 / np.sqrt(r.n / 2) + 0.05)
    level = fo.table_response([(0, 1.0), (1, 3.0)], 2.0)
    assert level(np.array([0.0, 2.0, 9.0]), 0.0).tolist() == [1.0, 2.0, 3.0]
