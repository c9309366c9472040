"""Object search on grids, tile by tile: matched filter, threshold, peaks, joint amplitudes; borders merged relationally.

A cell goes to its own tile and to those whose margin it lies in, so a task holds one padded tile, whatever the grid's size.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import numbered

OUT = "ty int, tx int, y int, x int, amp double, damp double"


def padded_tiles(cells: DataFrame, tile: int, margin: int) -> DataFrame:
    """Cells with the tiles they are needed in: the box of cell +- margin overlaps at most (1 + ceil(margin / tile))^2 * 4."""
    at = lambda c, d: F.floor((F.col(c) + d) / tile).cast("int")
    ys, xs = F.sequence(at("y", -margin), at("y", margin)), F.sequence(at("x", -margin), at("x", margin))
    return cells.select("*", F.explode(ys).alias("ty")).select("*", F.explode(xs).alias("tx"))


def beam(shape: tuple[int, int], sigma: float) -> np.ndarray:
    y, x = (np.minimum(np.arange(n), n - np.arange(n)) for n in shape)
    return np.exp(-(y[:, None] ** 2 + x[None] ** 2) / (2 * sigma**2))


def matched(d: np.ndarray, ivar: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """(amplitude, its deviation) of a source at each cell, for white noise of inverse variance ivar."""
    fb = np.fft.rfft2(beam(d.shape, sigma))
    fb2 = np.fft.rfft2(beam(d.shape, sigma) ** 2)
    rhs = np.fft.irfft2(np.fft.rfft2(d * ivar) * fb, d.shape)
    div = np.maximum(np.fft.irfft2(np.fft.rfft2(ivar) * fb2, d.shape), 1e-12)
    return rhs / div, 1 / np.sqrt(div)


def peaks(sn: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Cells over the threshold that no neighbour exceeds, best first."""
    up = np.pad(sn, 1, constant_values=-np.inf)
    h, w = sn.shape
    top = np.max([up[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
    ys, xs = np.nonzero((sn >= least) & (sn >= top))
    return sorted(zip(ys.tolist(), xs.tolist(), strict=True), key=lambda p: (-sn[p], p))


def fit_amplitudes(d: np.ndarray, ivar: np.ndarray, places: list[tuple[int, int]], sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Joint least-squares amplitudes of Gaussian sources at given places."""
    if not places:
        return np.zeros(0), np.zeros(0)
    y, x = np.mgrid[: d.shape[0], : d.shape[1]]
    basis = np.array([np.exp(-((y - a) ** 2 + (x - b) ** 2) / (2 * sigma**2)).ravel() for a, b in places])
    m = (basis * ivar.ravel()) @ basis.T
    inverse = np.linalg.pinv(m)
    return inverse @ (basis @ (ivar * d).ravel()), np.sqrt(np.maximum(np.diag(inverse), 0))


def find(cells: DataFrame, value: str, ivar: str, sigma: float, tile: int = 32, margin: int = 8, least: float = 5.0, passes: int = 2) -> DataFrame:
    """Catalogue of sources: each pass searches what the sources so far leave over. Rows are kept by the tile whose own box holds the peak,
    so no border row occurs twice."""

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(frame["ty"].iat[0]), int(frame["tx"].iat[0])
        y0, x0, n = ty * tile - margin, tx * tile - margin, tile + 2 * margin
        d, w = np.zeros((n, n)), np.zeros((n, n))
        at = (frame["y"].to_numpy() - y0, frame["x"].to_numpy() - x0)
        d[at], w[at] = frame[value], frame[ivar]
        gy, gx = np.mgrid[:n, :n]
        places: list[tuple[int, int]] = []
        amps = damps = np.zeros(0)
        for _ in range(passes):
            model = sum((a * np.exp(-((gy - p) ** 2 + (gx - q) ** 2) / (2 * sigma**2)) for a, (p, q) in zip(amps, places, strict=True)), np.zeros((n, n)))
            amp, damp = matched(d - model, w, sigma)
            new = [p for p in peaks(amp / damp, least) if p not in places]
            if not new:
                break
            places += new
            amps, damps = fit_amplitudes(d, w, places, sigma)
        rows = [(ty, tx, p + y0, q + x0, a, e) for (p, q), a, e in zip(places, amps, damps, strict=True) if margin <= p < margin + tile and margin <= q < margin + tile and a >= least * e]
        return pd.DataFrame(rows, columns=["ty", "tx", "y", "x", "amp", "damp"])

    return padded_tiles(cells.select("y", "x", value, ivar), tile, margin).groupBy("ty", "tx").applyInPandas(search, OUT)


def forced(cells: DataFrame, cat: DataFrame, value: str, ivar: str, reach: int, sigma: float) -> DataFrame:
    """Amplitude at known places, each on its own: a join of stamps and two sums."""
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    stamps = cat.select("id", "y", "x", F.explode(offsets).alias("_i")).select("*", F.explode(offsets).alias("_j"))
    b = F.exp(-(F.col("_i") ** 2 + F.col("_j") ** 2) / (2 * sigma * sigma))
    stamps = stamps.select("id", (F.col("y") + F.col("_i")).alias("y"), (F.col("x") + F.col("_j")).alias("x"), b.alias("_b"))
    met = stamps.join(cells.select("y", "x", value, ivar), ["y", "x"])
    rhs, div = F.sum(F.col("_b") * F.col(value) * F.col(ivar)), F.sum(F.col("_b") ** 2 * F.col(ivar))
    return met.groupBy("id").agg(F.try_divide(rhs, div).alias("amp"), F.try_divide(F.lit(1.0), F.sqrt(div)).alias("damp"))


def measured_regions(cells: DataFrame, label: str, value: str, extended: float = 1.1) -> DataFrame:
    """One row a label: id, y, x, amp. The place is the label's centre of mass and the amplitude the map there (linear between
    cells); where the label's extreme value is over `extended` times that, it is no point, and its greatest cell is given."""
    v = F.col(value)
    ends = [F.max(F.struct(v.alias("v"), -F.col("y"), -F.col("x"), F.col("y").alias("y"), F.col("x").alias("x"))).alias("top"), F.min(F.struct(v.alias("v"), F.col("y").alias("y"), F.col("x").alias("x"))).alias("low")]
    per = cells.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("id")).agg((F.sum(F.col("y") * v) / F.sum(v)).alias("cy"), (F.sum(F.col("x") * v) / F.sum(v)).alias("cx"), *ends)
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("_c")
    fy, fx = F.col("cy") - F.floor("cy"), F.col("cx") - F.floor("cx")
    share = F.when(F.col("_c.i") == 1, fy).otherwise(1 - fy) * F.when(F.col("_c.j") == 1, fx).otherwise(1 - fx)
    read = per.select("id", "cy", "cx", corner).select("id", (F.floor("cy") + F.col("_c.i")).cast("int").alias("y"), (F.floor("cx") + F.col("_c.j")).cast("int").alias("x"), share.alias("_s"))
    amp = read.join(cells.select("y", "x", v.alias("_v")), ["y", "x"]).groupBy("id").agg(F.sum(F.col("_s") * F.col("_v")).alias("_a"))
    both = per.join(amp, "id", "left").withColumn("_a", F.coalesce("_a", F.lit(0.0)))
    extreme = F.when(F.col("_a") < 0, F.col("low.v")).otherwise(F.col("top.v"))
    wide = F.abs(extreme) > F.abs(F.col("_a")) * extended
    return both.select("id", *[F.when(wide, F.col(f"top.{c}").cast("double")).otherwise(F.col(f"c{c}")).alias(c) for c in ("y", "x")], F.when(wide, F.col("top.v")).otherwise(F.col("_a")).alias("amp"))


def prior_of(amp: Column, damp: Column, variability: float = 1.0, least: float = 1e-10) -> Column:
    """(amp, ivar): a known amplitude as a prior for a new fit, the weaker the more the source may vary; unknown ones hardly hold."""
    good = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c).otherwise(0.0)
    a, d = good(amp), good(damp)
    return F.struct(a.alias("amp"), F.when(d > 0, 1 / (d * d + variability * variability * a * a)).otherwise(least).alias("ivar"))


def significance_correction(peaks: DataFrame, value: str, independent: float, most: float = 0.1, skip: int = 50, least: int = 100) -> tuple[float, float]:
    """(mu, sigma) such that the tail of (peak - mu) / sigma is that of `independent` normal numbers.

    Peaks are ranked by one distributed sort; of rank k the value is expected where k of them lie above. A line through the ranks
    from `skip` up to the share `most` of all gives both numbers by sums; (0, 1) if there are under `least` such ranks.
    """
    ranked = numbered(peaks.where(F.col(value).isNotNull()).select(value), [F.col(value).desc()], "_k")
    last = min(round(ranked.count() * most), int(independent))
    if last - skip < least:
        return 0.0, 1.0

    @F.pandas_udf("double")
    def expected(rank: pd.Series) -> pd.Series:
        return pd.Series([-NormalDist().inv_cdf(k / independent) for k in rank])

    rows = ranked.where((F.col("_k") >= skip) & (F.col("_k") < last)).select(F.col(value).alias("v"), expected((F.col("_k") + 1).cast("double")).alias("t"))
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"), F.sum("v").alias("v"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("t") * F.col("v")).alias("tv")).first()
    sigma = (r.n * r.tv - r.t * r.v) / (r.n * r.tt - r.t * r.t)
    return (r.v - sigma * r.t) / r.n, sigma
