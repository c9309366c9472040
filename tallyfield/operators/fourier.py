"""Transforms of whole grids, and what is built on them: filters, combined and Wiener-filtered maps, matched filters, detrending,
noise spectra of split differences.

A grid (map, y, x, value) is transformed in two passes with a transposing shuffle between them: a task transforms single
rows along x, the frequencies along x are dealt out in blocks, and a task transforms one block of columns along y. There, with all
maps of one block of frequencies at hand, any function of the transforms is applied; the way back is the same in reverse. A
task holds `CELLS` cells a map at most (one column, if that is longer), never the grid. Cells that are missing or null are 0,
cells outside the shape are left out, cells given twice add up; a grid without cells gives no rows.

Frequencies are angular, 2 pi / wavelength, in units of the pixel's size. Functions of them get (ly, lx) that broadcast to a block
and must be even, f(-ly, -lx) = f(ly, lx), so that real grids stay real.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

Shape = tuple[int, int]
Response = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Cells of a map that a task holds.
CELLS = 1 << 20


def radius(ly: np.ndarray, lx: np.ndarray) -> np.ndarray:
    return np.hypot(ly, lx)


def butterworth(knee: float, alpha: float) -> Response:
    """1 / (1 + (l / knee)^alpha); 0 at l = 0 for a negative alpha."""

    def f(ly: np.ndarray, lx: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return 1 / (1 + (radius(ly, lx) / knee) ** alpha)

    return f


def gaussian(sigma: float) -> Response:
    """Transform of a beam of that width, 1 at l = 0."""
    return lambda ly, lx: np.exp(-0.5 * (sigma * radius(ly, lx)) ** 2)


def flat(level: float = 1.0) -> Response:
    return lambda ly, lx: np.full(np.broadcast(ly, lx).shape, level)


def _columns(rows: DataFrame, shape: Shape) -> tuple[DataFrame, int]:
    """Rows transformed along x: block, map, y and the block's complex numbers; and the blocks' width."""
    ny, nx = shape
    width = max(1, CELLS // ny)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for m, y, xs, values in frame.itertuples(index=False):
                line = np.zeros(nx)
                np.add.at(line, xs, values)
                f = np.fft.rfft(line)
                out += [(b, m, y, f[b * width : (b + 1) * width].tobytes()) for b in range(-(-len(f) // width))]
            yield pd.DataFrame(out, columns=["block", "map", "y", "part"])

    held = rows.where(F.col("value").isNotNull() & F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1))
    lines = held.groupBy("map", "y").agg(F.collect_list("x").alias("xs"), F.collect_list(F.col("value").cast("double")).alias("vs"))
    return lines.select("map", "y", "xs", "vs").mapInPandas(run, "block int, map int, y int, part binary"), width


def _block(frame: pd.DataFrame, shape: Shape, maps: int, width: int, pixel: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(maps x ny x columns, ly, lx) of one block, transformed along y as well."""
    ny, nx = shape
    first = int(frame["block"].iloc[0]) * width
    cells = np.zeros((maps, ny, min(width, nx // 2 + 1 - first)), complex)
    for m, y, part in zip(frame["map"], frame["y"], frame["part"], strict=True):
        cells[m, y] += np.frombuffer(part, complex)
    ly = 2 * np.pi * np.fft.fftfreq(ny, pixel[0])[:, None]
    lx = 2 * np.pi * np.fft.rfftfreq(nx, pixel[1])[None, first : first + cells.shape[2]]
    return np.fft.fft(cells, axis=1), ly, lx


def through(rows: DataFrame, shape: Shape, maps: int, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], pixel: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """rows (map 0 ... maps - 1, y, x, value) -> the same columns, whole grids. f turns the transforms of all maps at a block of
    frequencies (maps x ly x lx), ly and lx into those of the results (results x ly x lx)."""
    ny, nx = shape
    columns, width = _columns(rows, shape)

    def middle(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.fft.ifft(f(*_block(frame, shape, maps, width, pixel)), axis=1)
        block = int(frame["block"].iloc[0])
        return pd.DataFrame([(m, y, block, out[m, y].tobytes()) for m in range(len(out)) for y in range(ny)], columns=["map", "y", "block", "part"])

    def back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for m, y, parts in frame.itertuples(index=False):
                line = np.concatenate([np.frombuffer(p["part"], complex) for p in sorted(parts, key=lambda p: p["block"])])
                yield pd.DataFrame({"map": np.full(nx, m, np.int32), "y": np.full(nx, y, np.int32), "x": np.arange(nx, dtype=np.int32), "value": np.fft.irfft(line, nx)})

    made = columns.groupBy("block").applyInPandas(middle, "map int, y int, block int, part binary")
    lines = made.groupBy("map", "y").agg(F.collect_list(F.struct("block", "part")).alias("parts"))
    return lines.select("map", "y", "parts").mapInPandas(back, "map int, y int, x int, value double")


def one(grid: DataFrame, value: str) -> DataFrame:
    return grid.select(F.lit(0).alias("map"), "y", "x", F.col(value).alias("value"))


def stacked(grids: list[DataFrame], value: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [one(g, value).withColumn("map", F.lit(m)) for m, g in enumerate(grids)])


def transform(grid: DataFrame, value: str, shape: Shape) -> DataFrame:
    """ky, kx, re, im of the sum of value * exp(-2 pi i (ky y / ny + kx x / nx)), for kx up to half of nx."""
    columns, width = _columns(one(grid, value), shape)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f, _, _ = _block(frame, shape, 1, width, (1.0, 1.0))
        ky, kx = np.indices(f[0].shape)
        return pd.DataFrame({"ky": ky.ravel(), "kx": kx.ravel() + int(frame["block"].iloc[0]) * width, "re": f[0].real.ravel(), "im": f[0].imag.ravel()})

    return columns.groupBy("block").applyInPandas(run, "ky int, kx int, re double, im double")


def filtered(grid: DataFrame, value: str, shape: Shape, response: Response, pixel: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """y, x, value of the grid with each frequency times response."""
    out = through(one(grid, value), shape, 1, lambda f, ly, lx: f * response(ly, lx), pixel)
    return out.select("y", "x", F.col("value").alias(value))


def source_response(grid: DataFrame, value: str, shape: Shape, sigma: float, flux: float, pixel: tuple[float, float] = (1.0, 1.0), power: int = 1, keep: Response | None = None) -> DataFrame:
    """Point sources of given flux as they are seen: cells hold fluxes, each becomes a gaussian beam of peak 1 times `flux`, to a
    power, less what a filter takes away. Beam and factor are raised to the power, the filter is not."""
    area = 2 * np.pi * sigma**2 / power / (pixel[0] * pixel[1]) * flux**power
    beam = gaussian(sigma / power**0.5)
    return filtered(grid, value, shape, lambda ly, lx: area * beam(ly, lx) * (keep(ly, lx) if keep else 1.0), pixel)


@dataclass(frozen=True)
class Seen:
    """What is known of a map besides its cells: its beam, the inverse of its whitened noise's spectrum, and its typical
    inverse variance."""

    beam: Response
    inverse_noise: Response
    weight: float = 1.0


def _both(seen: list[Seen], ly: np.ndarray, lx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per map and frequency: beam, inverse noise variance."""
    return np.array([s.beam(ly, lx) for s in seen]), np.array([s.weight * s.inverse_noise(ly, lx) for s in seen])


def combined(maps: list[DataFrame], seen: list[Seen], value: str, shape: Shape, target: Response | None = None, signal: Response | None = None, pixel: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """One map from several of evenly deep noise, frequency by frequency: y, x, value.

    sum(B N^-1 m) / (sum(B^2 N^-1) + 1 / S): without a signal spectrum S the most likely map as seen by the target beam (B is
    then beam / target), with one the Wiener filter (no target).
    """

    def f(m: np.ndarray, ly: np.ndarray, lx: np.ndarray) -> np.ndarray:
        beam, inverse = _both(seen, ly, lx)
        beam = beam / target(ly, lx) if target else beam
        total = (beam**2 * inverse).sum(axis=0) + (1 / signal(ly, lx) if signal else 0.0)
        return ((beam * inverse * m).sum(axis=0) / np.where(total > 0, total, np.inf))[None]

    return through(stacked(maps, value), shape, len(maps), f, pixel).select("y", "x", F.col("value").alias(value))


def matched(maps: list[DataFrame], seen: list[Seen], profiles: list[Response], value: str, shape: Shape, signal: Response, pixel: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Matched filter for objects with a profile in each map over noise and a common signal of spectrum S: y, x, value (the
    amplitude of an object at each cell), inverse (its inverse variance, the same everywhere), snr.

    The covariance of the maps at a frequency is diag(N) + S B B', inverted as a rank-one change; no matrix is built.
    """

    def f(m: np.ndarray, ly: np.ndarray, lx: np.ndarray) -> np.ndarray:
        beam, inverse = _both(seen, ly, lx)
        shape_of = np.array([p(ly, lx) for p in profiles])
        share = signal(ly, lx) / (1 + signal(ly, lx) * (beam**2 * inverse).sum(axis=0))

        def weighted(v: np.ndarray) -> np.ndarray:
            return inverse * (v - beam * (share * (beam * inverse * v).sum(axis=0)))

        return np.stack([(shape_of * weighted(m)).sum(axis=0), (shape_of * weighted(shape_of)).sum(axis=0).astype(complex)])

    out = through(stacked(maps, value), shape, len(maps), f, pixel)
    # The second result, transformed back, has at its origin the sum over frequencies that is the inverse variance.
    level = out.where("map = 1 AND y = 0 AND x = 0").select(F.col("value").alias("inverse"))
    found = out.where("map = 0").select("y", "x", F.col("value").alias("_n")).join(F.broadcast(level))
    return found.select("y", "x", (F.col("_n") / F.col("inverse")).alias(value), "inverse", (F.col("_n") / F.sqrt("inverse")).alias("snr"))


# ---- uneven depth: the same systems by conjugate gradients


def _dots(rows: DataFrame, *pairs: tuple[str, str]) -> list[float]:
    found = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{k}") for k, (a, b) in enumerate(pairs)]).first()
    return [x or 0.0 for x in found]


def conjugate(rows: DataFrame, apply: Callable[[DataFrame], DataFrame], precondition: Callable[[DataFrame], DataFrame], steps: int, enough: float, trace: list[float] | None = None) -> DataFrame:
    """Solves A v = b on a grid: rows (y, x, b) -> y, x, value. apply and precondition turn (y, x, value) into such rows. The state
    of a step is one checkpointed table of the cells' x, r and p; the driver sees two sums a step."""
    state = cut(rows.select("y", "x", F.lit(0.0).alias("v"), F.col("b").alias("r")))

    def with_(table: DataFrame, made: DataFrame, name: str) -> DataFrame:
        return table.join(made.select("y", "x", F.col("value").alias(name)), ["y", "x"])

    state = cut(with_(state, precondition(state.select("y", "x", F.col("r").alias("value"))), "p"))
    rz, first = _dots(state, ("r", "p"))[0], None
    for _ in range(steps):
        first = first or rz
        if first <= 0 or rz / first < enough:
            break
        state = cut(with_(state, apply(state.select("y", "x", F.col("p").alias("value"))), "ap"))
        size = _dots(state, ("p", "ap"))[0]
        if size <= 0:
            raise ValueError("the system is singular or not positive")
        alpha = rz / size
        moved = cut(state.select("y", "x", (F.col("v") + alpha * F.col("p")).alias("v"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p"))
        moved = cut(with_(moved, precondition(moved.select("y", "x", F.col("r").alias("value"))), "z"))
        new = _dots(moved, ("r", "z"))[0]
        state, rz = moved.select("y", "x", "v", "r", (F.col("z") + new / rz * F.col("p")).alias("p")), new
        if trace is not None:
            trace.append(rz / first)
    return state.select("y", "x", F.col("v").alias("value"))


def solved(maps: list[DataFrame], seen: list[Seen], value: str, weight: str, shape: Shape, target: Response | None = None, signal: Response | None = None, steps: int = 50, enough: float = 1e-8, trace: list[float] | None = None, pixel: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """combined() for maps whose cells have inverse variances `weight` of their own: y, x, value.

    (sum(B H C H B) + 1 / S) q = sum(B H C H m), with H the root of the weight in each cell and C the inverse noise
    spectrum; the even-depth solution preconditions. Each step goes three times through the transforms, all maps at once.
    """
    n = len(maps)
    beams = [(lambda ly, lx, s=s: s.beam(ly, lx) / target(ly, lx)) if target else s.beam for s in seen]
    roots = cut(stacked([m.select("y", "x", F.sqrt(F.greatest(F.col(weight), F.lit(0.0))).alias("h")) for m in maps], "h").withColumnRenamed("value", "h"))
    means = {r.map: r.w for r in roots.groupBy("map").agg((F.sum(F.col("h") * F.col("h")) / (shape[0] * shape[1])).alias("w")).collect()}  # one number a map
    deep = [Seen(b, s.inverse_noise, means.get(k, 0.0)) for k, (b, s) in enumerate(zip(beams, seen, strict=True))]

    def each(f: np.ndarray, which: Callable[[int, np.ndarray, np.ndarray], np.ndarray], ly: np.ndarray, lx: np.ndarray) -> np.ndarray:
        return np.stack([f[k] * which(k, ly, lx) for k in range(len(f))])

    def times_root(rows: DataFrame) -> DataFrame:
        return rows.join(roots, ["map", "y", "x"]).select("map", "y", "x", (F.col("value") * F.col("h")).alias("value"))

    def down(rows: DataFrame) -> DataFrame:
        """sum over maps of B H C (rows already times H)."""
        rows = through(rows, shape, n, lambda f, ly, lx: each(f, lambda k, a, b: seen[k].inverse_noise(a, b), ly, lx), pixel)
        return through(times_root(rows), shape, n, lambda f, ly, lx: each(f, lambda k, a, b: beams[k](a, b), ly, lx).sum(axis=0)[None], pixel)

    def apply(x: DataFrame) -> DataFrame:
        seen_by = through(one(x, "value"), shape, 1, lambda f, ly, lx: np.stack([f[0] * b(ly, lx) for b in beams]), pixel)
        out = down(times_root(seen_by)).select("y", "x", "value")
        if not signal:
            return out
        prior = filtered(x, "value", shape, lambda ly, lx: 1 / signal(ly, lx), pixel)
        return out.unionByName(prior).groupBy("y", "x").agg(F.sum("value").alias("value"))

    def precondition(r: DataFrame) -> DataFrame:
        def inverse(ly: np.ndarray, lx: np.ndarray) -> np.ndarray:
            beam, noise = _both(deep, ly, lx)
            total = (beam**2 * noise).sum(axis=0) + (1 / signal(ly, lx) if signal else 0.0)
            return 1 / (total + 1e-8 * total.max())

        return filtered(r, "value", shape, inverse, pixel)

    b = down(times_root(stacked(maps, value))).select("y", "x", F.col("value").alias("b"))
    return conjugate(b, apply, precondition, steps, enough, trace).withColumnRenamed("value", value)


def detrended(grid: DataFrame, value: str, weight: str, shape: Shape, smooth: Response, steps: int = 50, enough: float = 1e-8, trace: list[float] | None = None, pixel: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """The grid less the smoothest surface that meets it where the weight (0 to 1, large at the edge) says: y, x, value.

    (W + F^-1 smooth F) t = W v, where smooth gives the price of each frequency; smooth + the mean weight preconditions.
    """
    own = cut(grid.select("y", "x", F.col(weight).alias("_w"), F.col(value).alias("_v")))
    level = own.agg(F.sum("_w")).first()[0] / (shape[0] * shape[1])

    def apply(x: DataFrame) -> DataFrame:
        held = x.join(own, ["y", "x"]).select("y", "x", (F.col("value") * F.col("_w")).alias("value"))
        return held.unionByName(filtered(x, "value", shape, smooth, pixel)).groupBy("y", "x").agg(F.sum("value").alias("value"))

    whole = grid.sparkSession.range(shape[0] * shape[1]).select(F.floor(F.col("id") / shape[1]).cast("int").alias("y"), (F.col("id") % shape[1]).cast("int").alias("x"))
    b = whole.join(own, ["y", "x"], "left").select("y", "x", F.coalesce(F.col("_w") * F.col("_v"), F.lit(0.0)).alias("b"))
    trend = conjugate(b, apply, lambda r: filtered(r, "value", shape, lambda ly, lx: 1 / (smooth(ly, lx) + level), pixel), steps, enough, trace)
    return own.join(trend, ["y", "x"]).select("y", "x", (F.col("_v") - F.col("value")).alias(value))


# ---- spectra


def taper(n: int, edge: int) -> np.ndarray:
    """1, falling as a cosine to both ends over `edge` cells."""
    e = np.minimum(np.arange(n), np.arange(n)[::-1])
    return np.where(e < edge, 0.5 - 0.5 * np.cos(np.pi * (e + 1) / (edge + 1)), 1.0)


def tile_spectra(rows: DataFrame, tile: Shape, width: float, edge: int = 0, least: float = 0.5, share: float = 1.0, seed: int = 0, pixel: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Mean power and cross power of maps in tiles: a, b (a <= b), bin, n, power. rows: map, y, x, value.

    Tiles are chosen by a seeded hash (all for share 1); in a tile, maps with less than `least` of their cells are left out.
    A tile is tapered, transformed in one task, and summed in rings of `width`; sums of all tiles are added before they are
    divided, so tiles may come from anywhere. Power is |F|^2 / (cells * mean square of the taper).
    """
    at = [F.floor(F.col(c) / n).alias(f"t{c}") for c, n in zip(("y", "x"), tile, strict=True)]
    held = rows.where(F.col("value").isNotNull()).select("map", "y", "x", F.col("value").cast("double").alias("value"), *at)
    held = held.where(F.pmod(F.xxhash64(F.lit(seed), "ty", "tx"), F.lit(1 << 20)) < int(share * (1 << 20)))
    window = taper(tile[0], edge)[:, None] * taper(tile[1], edge)
    l = np.hypot(2 * np.pi * np.fft.fftfreq(tile[0], pixel[0])[:, None], 2 * np.pi * np.fft.fftfreq(tile[1], pixel[1]))  # noqa: E741
    ring = (l / width).astype(int).ravel()
    scale = 1 / (window.size * (window**2).mean())

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names, m = np.unique(frame["map"].to_numpy(), return_inverse=True)
        cells, hits = np.zeros((len(names), *tile)), np.zeros((len(names), *tile))
        where = m, frame["y"].to_numpy() % tile[0], frame["x"].to_numpy() % tile[1]
        np.add.at(cells, where, frame["value"].to_numpy())
        np.add.at(hits, where, 1.0)
        good = (hits > 0).mean(axis=(1, 2)) >= least
        names, f = names[good], np.fft.fft2(cells[good] * window)
        out = []
        for i in range(len(names)):
            for j in range(i, len(names)):
                s = np.bincount(ring, ((f[i] * f[j].conj()).real * scale).ravel())
                out += [(int(names[i]), int(names[j]), k, int(n), float(s[k])) for k, n in enumerate(np.bincount(ring)) if n]
        return pd.DataFrame(out, columns=["a", "b", "bin", "n", "s"])

    sums = held.groupBy("ty", "tx").applyInPandas(run, "a int, b int, bin int, n long, s double")
    return sums.groupBy("a", "b", "bin").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("power"))


def whitened_differences(splits: DataFrame, value: str, weight: str) -> DataFrame:
    """Each split (map, y, x, value, weight) less the weighted mean of all in its cell, in units of that difference's
    deviation: its variance is 1 / own weight - 1 / sum of weights. Cells that one split alone has seen have none."""
    from pyspark.sql import Window as W

    cell = W.partitionBy("y", "x")
    rows = splits.where(F.col(weight) > 0).withColumns({"_t": F.sum(weight).over(cell), "_m": F.sum(F.col(value) * F.col(weight)).over(cell)})
    spread = 1 / F.col(weight) - 1 / F.col("_t")
    return rows.where(spread > 1e-12 / F.col(weight)).select("map", "y", "x", ((F.col(value) - F.col("_m") / F.col("_t")) / F.sqrt(spread)).alias("value"))


def noise_spectrum(splits: DataFrame, value: str, weight: str, tile: Shape, width: float, edge: int = 0, least: float = 0.1, pixel: tuple[float, float] = (1.0, 1.0), share: float = 1.0, seed: int = 0) -> DataFrame:
    """Spectrum of the whitened noise of maps of one sky: bin, n, power, where power is the mean of the splits' own, each divided by
    the share of cells that the tiles looked at hold (what is not hit has no noise to count)."""
    rows = cut(whitened_differences(splits, value, weight))
    spectra = tile_spectra(rows, tile, width, edge, least, share, seed, pixel).where("a = b")
    own = rows.groupBy("map", F.floor(F.col("y") / tile[0]).alias("ty"), F.floor(F.col("x") / tile[1]).alias("tx")).agg((F.count_distinct("y", "x") / (tile[0] * tile[1])).alias("_f"))
    own = own.where((F.col("_f") >= least) & (F.pmod(F.xxhash64(F.lit(seed), "ty", "tx"), F.lit(1 << 20)) < int(share * (1 << 20)))).groupBy("map").agg(F.avg("_f").alias("_f"))
    each = spectra.join(own, F.col("a") == F.col("map")).select("bin", "n", (F.col("power") / F.col("_f")).alias("power"))
    return each.groupBy("bin").agg(F.sum("n").alias("n"), F.avg("power").alias("power"))


def table_response(rows: list[tuple[int, float]], width: float) -> Response:
    """A measured spectrum (bin, power), linear between the middles of its bins and flat beyond, as a response."""
    at = np.array([(k + 0.5) * width for k, _ in sorted(rows)])
    power = np.array([p for _, p in sorted(rows)])
    return lambda ly, lx: np.interp(radius(ly, lx), at, power)


