"""Curve fits of many groups at once: damped Gauss-Newton steps whose sums are aggregates.

A step joins each row with its group's parameters, evaluates the model and its derivatives as Columns, and adds up J'WJ, J'Wr and
chi square per group: partial sums before one shuffle, so that a group may hold any share of the rows. What comes back is one
row a group; its small system is solved in batches of groups, with a damping of its own that shrinks after a step that helps and
grows after one that doesn't. Groups that have converged take no part in later steps. The driver sees one count a step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: From the parameters' columns: the model's value, and its derivative by each parameter.
Model = Callable[[dict[str, Column]], tuple[Column, list[Column]]]
#: Groups whose parameters are broadcast to the rows; more are shuffled.
FEW_GROUPS = 200_000


def _step(names: list[str], low: np.ndarray, high: np.ndarray, enough: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The state of groups after the sums at their trial points are known: a point that lowers chi square is taken; then a trial
    from the best point so far."""
    n = len(names)
    upper = np.triu_indices(n)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            k = len(f)
            best, trial = (np.array(f[c].tolist(), float).reshape(k, n) for c in ("best", "trial"))
            old, grad, size = (f[c].to_numpy(float) for c in ("chisq", "damping", "new_chisq"))
            old_j, new_j = (np.array(f[c].tolist(), float).reshape(k, -1) for c in ("sums", "new_sums"))
            size = np.where(np.isfinite(new_j).all(axis=1), size, np.inf)
            better = size <= old
            gained = np.where(better & np.isfinite(old), old - np.where(better, size, 0.0), np.inf)
            moved = np.abs(trial - best).max(axis=1) / (1e-9 + np.abs(best).max(axis=1))
            best, sums, chisq = np.where(better[:, None], trial, best), np.where(better[:, None], new_j, old_j), np.where(better, size, old)
            damping = np.clip(np.where(better, grad / 5, grad * 6), 1e-14, 1e14)
            normal = np.zeros((k, n, n))
            normal[:, upper[0], upper[1]] = normal[:, upper[1], upper[0]] = sums[:, : len(upper[0])]
            diagonal = np.einsum("kii->ki", normal)
            normal = normal + np.einsum("ki,ij->kij", damping[:, None] * diagonal + 1e-300 + 1e-14 * diagonal.max(axis=1, keepdims=True, initial=0), np.eye(n))
            usable = np.isfinite(normal).all(axis=(1, 2)) & np.isfinite(sums).all(axis=1)
            move = np.zeros((k, n))
            if usable.any():
                move[usable] = np.linalg.solve(normal[usable], sums[usable, len(upper[0]) :, None])[..., 0]
            # A step that changes nothing more, or one that can't be made any smaller, ends a group's fit.
            done = (better & (gained <= enough * chisq) & (moved < 1e-6)) | (chisq <= 1e-28) | (~better & (damping > 1e12)) | ~usable
            f = f[[c for c in f.columns if not c.startswith("new_")]].copy()
            f["best"], f["trial"], f["sums"] = best.tolist(), np.clip(best + move, low, high).tolist(), sums.tolist()
            f["chisq"], f["damping"], f["done"] = chisq, damping, done
            yield f

    return run


def gauss_newton(rows: DataFrame, group: list[str], value: str, weight: str, model: Model, start: DataFrame, names: list[str], bounds: dict[str, tuple[float, float]] | None = None, steps: int = 60, enough: float = 1e-10) -> DataFrame:
    """Parameters `names` of each group, from those of start (group, names), that make sum(weight * (value - model)^2) least;
    with chisq and converged. Groups without rows, or without a start, are not in the result; null values and weights are left
    out; of a group that doesn't converge within `steps` the best point so far is given."""
    n = len(names)
    limits = [(bounds or {}).get(c, (-np.inf, np.inf)) for c in names]
    # Rows that differ by nothing but their weight are one row for every step.
    same = [c for c in rows.columns if c != weight]
    rows = cut(rows.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).groupBy(*same).agg(F.sum(weight).alias(weight)))
    keep = [*group, "best", "trial", "sums", "chisq", "damping", "done"]
    state = start.select(*group, F.array(*[F.col(c).cast("double") for c in names]).alias("best"))
    size = n * (n + 1) // 2 + n
    state = state.select(*group, "best", F.col("best").alias("trial"), F.array_repeat(F.lit(0.0), size).alias("sums"), F.lit(float("inf")).alias("chisq"), F.lit(1e-2).alias("damping"), F.lit(False).alias("done"))
    state = cut(state.join(rows.select(*group).distinct(), group, "left_semi"))
    few = state.count() <= FEW_GROUPS
    schema = state.schema
    finished: list[DataFrame] = []
    run = _step(names, np.array([a for a, _ in limits]), np.array([b for _, b in limits]), enough)
    for _ in range(steps):
        at = state.select(*group, *[F.col("trial")[k].alias(f"_p{k}") for k in range(n)])
        joined = rows.join(F.broadcast(at) if few else at, group)
        m, slopes = model({c: F.col(f"_p{k}") for k, c in enumerate(names)})
        own = joined.withColumns({"_r": F.col(value) - m, "_w": F.col(weight), **{f"_j{k}": s for k, s in enumerate(slopes)}})
        products = [F.col(f"_j{a}") * F.col(f"_j{b}") for a in range(n) for b in range(a, n)] + [F.col(f"_j{a}") * F.col("_r") for a in range(n)]
        sums = own.groupBy(*group).agg(F.array(*[F.sum(F.col("_w") * p) for p in products]).alias("new_sums"), F.sum(F.col("_w") * F.col("_r") * F.col("_r")).alias("new_chisq"))
        state = cut(state.join(sums, group).select(*keep, "new_sums", "new_chisq").mapInPandas(run, schema))
        finished.append(state.where("done"))
        state = state.where("NOT done")
        if state.isEmpty():
            break
    out = state
    for f in finished:
        out = out.unionByName(f)
    return out.select(*group, *[F.col("best")[k].alias(c) for k, c in enumerate(names)], "chisq", F.col("done").alias("converged"))


def double_butterworth(l: Column) -> Model:  # noqa: E741
    """level * (1 + (l / knee1)^slope1) / (1 + (l / knee2)^slope2), in the logarithms of level and knees."""

    def model(p: dict[str, Column]) -> tuple[Column, list[Column]]:
        x1, x2 = F.log(l) - p["knee1"], F.log(l) - p["knee2"]
        t1, t2 = F.exp(p["slope1"] * x1), F.exp(p["slope2"] * x2)
        s1, s2 = 1 - 1 / (1 + t1), 1 - 1 / (1 + t2)
        m = F.exp(p["level"]) * (1 + t1) / (1 + t2)
        return m, [m, -m * s1 * p["slope1"], m * s1 * x1, m * s2 * p["slope2"], -m * s2 * x2]

    return model


def fit_double_butterworth(spectra: DataFrame, group: list[str], l: str, power: str, knee1: float = 4000.0, slope1: float = -5.0, knee2: float = 2000.0, slope2: float = -10.0, least: float = 1.0, steps: int = 200) -> DataFrame:  # noqa: E741
    """A rise to low frequencies (knee1, slope1) times a loss below another (knee2, slope2) fitted to each group's spectrum: level,
    knee1, slope1, knee2, slope2, chisq, converged. Weights are 1 / (power + its median)^2, so that large values don't rule; the
    start's level has a closed form. Frequencies under `least` are left out."""
    rows = spectra.where((F.col(l) >= least) & F.col(power).isNotNull()).select(*group, F.col(l).cast("double").alias("_l"), F.col(power).cast("double").alias("_y"))
    middle = rows.groupBy(*group).agg(F.median("_y").alias("_m"))
    rows = rows.join(middle, group).select(*group, "_l", "_y", (1 / ((F.col("_y") + F.col("_m")) * (F.col("_y") + F.col("_m")))).alias("_w"))
    shape, _ = double_butterworth(F.col("_l"))({"level": F.lit(0.0), "knee1": F.lit(float(np.log(knee1))), "slope1": F.lit(slope1), "knee2": F.lit(float(np.log(knee2))), "slope2": F.lit(slope2)})
    start = rows.withColumn("_t", shape).groupBy(*group).agg((F.sum(F.col("_w") * F.col("_y") * F.col("_t")) / F.sum(F.col("_w") * F.col("_t") * F.col("_t"))).alias("_a"))
    start = start.select(*group, F.log("_a").alias("level"), F.lit(float(np.log(knee1))).alias("knee1"), F.lit(slope1).alias("slope1"), F.lit(float(np.log(knee2))).alias("knee2"), F.lit(slope2).alias("slope2"))
    names = ["level", "knee1", "slope1", "knee2", "slope2"]
    far = {"slope1": (-50.0, -1e-3), "slope2": (-50.0, -1e-3), "knee1": (-20.0, 30.0), "knee2": (-20.0, 30.0)}
    fit = gauss_newton(rows, group, "_y", "_w", double_butterworth(F.col("_l")), start, names, far, steps)
    return fit.withColumns({c: F.exp(c) for c in ("level", "knee1", "knee2")})
