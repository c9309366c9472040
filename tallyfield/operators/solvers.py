"""Linear systems that are not symmetric, as tables, many at once.

Matrices are entries (group, i, j, a), right sides (group, i, b). All groups take the same steps, each with scalars of its own; a
step is two products with the matrices (a join by column number, sums by row number) and sums per group. Groups that are
solved, or can't go on, stand still. Each third of a step is checkpointed; the driver sees one count a step.

Groups of at most `SMALL` entries and unknowns meet in one row each and take all their steps where they lie, a batch of groups at a
time: many small systems need one shuffle in all. Only larger groups go the way of tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: Groups whose scalars are broadcast; those of more are shuffled.
FEW_GROUPS = 20_000
#: Entries, and unknowns, of a group that is solved in one row.
SMALL = 256


def _together(g: np.ndarray, i: np.ndarray, j: np.ndarray, a: np.ndarray, own: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int, enough: float) -> tuple[np.ndarray, np.ndarray]:
    """x and the error of each group, all groups of a batch at once: own is an unknown's group, i and j are the entries' places among
    the unknowns. The steps are those of `_tables`."""
    n, m = int(own.max()) + 1, len(own)
    summed = lambda v: np.bincount(own, v, n)
    times = lambda v: np.bincount(i, a * v[j], m)
    over = lambda p, q: np.divide(p, q, out=np.zeros_like(p), where=q != 0)
    on = (i == j) & (a != 0)
    d = np.where(np.bincount(i[on], minlength=m) > 0, np.bincount(i[on], a[on], m), 1.0)
    r = b - times(x)
    rh, p, v = r.copy(), np.zeros(m), np.zeros(m)
    rho, alpha, omega = np.ones(n), np.ones(n), np.ones(n)
    size, left = summed(b * b), summed(r * r)
    with np.errstate(all="ignore"):
        for _ in range(steps):
            live = ~((left <= enough * size) | (rho == 0) | (omega == 0))
            if not live.any():
                break
            new = summed(rh * r)
            beta = over(new, rho) * over(alpha, omega)
            p = r + beta[own] * (p - omega[own] * v)
            y = over(p, d)
            v = times(y)
            step = over(new, summed(rh * v))
            s = r - step[own] * v
            z = over(s, d)
            t = times(z)
            turn = over(summed(t * s), summed(t * t))
            moves = live[own]
            x = np.where(moves, x + step[own] * y + turn[own] * z, x)
            r = np.where(moves, s - turn[own] * t, r)
            rho, alpha, omega = np.where(live, new, rho), np.where(live, step, alpha), np.where(live, turn, omega)
            left = np.where(live, summed(r * r), left)
    return x, over(left, size)


def _packed(rows: DataFrame, group: list[str], steps: int, enough: float) -> DataFrame:
    """rows: group, _i, _j, _a (lists of its entries), i, _b, _x (lists of its unknowns, right sides and starts)."""
    kinds = dict(rows.dtypes)
    flat = lambda lists, kind: np.concatenate([np.asarray(x, kind) for x in lists])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            own, g = (np.repeat(np.arange(len(f)), [len(x) for x in f[c]]) for c in ("i", "_i"))
            u, b, x = flat(f["i"], np.int64), flat(f["_b"], float), flat(f["_x"], float)
            i, j, a = flat(f["_i"], np.int64), flat(f["_j"], np.int64), flat(f["_a"], float)
            numbers = np.unique(np.concatenate([u, i, j]))
            key = lambda g, w: g * len(numbers) + np.searchsorted(numbers, w)
            keys = key(own, u)
            order = np.argsort(keys)
            at = lambda w: order[np.minimum(np.searchsorted(keys, key(g, w), sorter=order), len(keys) - 1)]
            pi, pj = at(i), at(j)
            held = (keys[pi] == key(g, i)) & (keys[pj] == key(g, j))
            value, error = _together(g[held], pi[held], pj[held], a[held], own, b, x, steps, enough)
            yield pd.DataFrame({**{c: f[c].to_numpy()[own] for c in group}, "i": u, "value": value, "error": error[own]})

    keys = ", ".join(f"{c} {kinds[c]}" for c in group)
    return rows.mapInPandas(run, f"{keys}, i long, value double, error double")


def bicgstab(entries: DataFrame, right: DataFrame, group: list[str], steps: int = 200, enough: float = 1e-20, start: DataFrame | None = None) -> DataFrame:
    """group, i, value, error (|b - A x|^2 / |b|^2) with the diagonal as preconditioner (1 where it is 0 or absent). Ends for a
    group once its error is under `enough`; start: group, i, value. Rows of the right side that no entry reaches stay as they are."""
    kind = dict(right.dtypes)["i"]
    held = entries.select(*group, "i", "j", F.col("a").cast("double").alias("a")).where("i IS NOT NULL AND j IS NOT NULL AND a IS NOT NULL")
    unknowns = right.select(*group, "i", F.col("b").cast("double").alias("b"))
    if start is not None:
        unknowns = unknowns.join(start.select(*group, "i", F.col("value").cast("double").alias("_x")), [*group, "i"], "left")
    else:
        unknowns = unknowns.withColumn("_x", F.lit(0.0))
    # Lists are made of small groups alone, so groups are counted before; a group with a null right side is left to the tables.
    many = held.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SMALL).select(*group)
    wide = unknowns.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.count("b").alias("_m")).where((F.col("_n") > SMALL) | (F.col("_m") < F.col("_n"))).select(*group)
    large = cut(many.unionByName(wide).distinct())
    some = not large.isEmpty()
    if some:
        held, unknowns = held.join(large, group, "left_anti"), unknowns.join(large, group, "left_anti")
    lists = held.groupBy(*group).agg(*[F.collect_list(c).alias(f"_{c}") for c in ("i", "j", "a")])
    sides = unknowns.groupBy(*group).agg(F.collect_list("i").alias("i"), F.collect_list("b").alias("_b"), F.collect_list(F.coalesce("_x", F.lit(0.0))).alias("_x"))
    met = sides.join(lists, group, "left").withColumns({f"_{c}": F.coalesce(f"_{c}", F.array().cast(f"array<{'double' if c == 'a' else dict(held.dtypes)[c]}>")) for c in ("i", "j", "a")})
    out = _packed(met, group, steps, enough).withColumn("i", F.col("i").cast(kind))
    if not some:
        return out
    own = [df if df is None else df.join(large, group, "left_semi") for df in (entries, right, start)]
    return out.unionByName(_tables(own[0], own[1], group, steps, enough, own[2]))


def _tables(entries: DataFrame, right: DataFrame, group: list[str], steps: int = 200, enough: float = 1e-20, start: DataFrame | None = None) -> DataFrame:
    """The same, each step as joins and sums of tables."""
    few = right.select(*group).distinct().count() <= FEW_GROUPS
    key = [*group, "i"]
    entries = cut(entries.select(*group, "i", "j", F.col("a").cast("double").alias("a")))
    diagonal = entries.where("i = j AND a <> 0").groupBy(*key).agg(F.sum("a").alias("_d"))

    def times(df: DataFrame, column: str, name: str) -> DataFrame:
        """df plus the product of the matrices and a column."""
        sent = entries.join(df.select(*group, F.col("i").alias("j"), F.col(column).alias("_v")), [*group, "j"])
        made = sent.groupBy(*key).agg(F.sum(F.col("a") * F.col("_v")).alias(name))
        return df.join(made, key, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))

    def summed(df: DataFrame, **products: Column) -> DataFrame:
        """df plus sums over each group."""
        sums = df.groupBy(*group).agg(*[F.sum(c).alias(n) for n, c in products.items()])
        return df.join(F.broadcast(sums) if few else sums, group)

    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    rows = right.select(*group, "i", F.col("b").cast("double").alias("b")).join(diagonal, key, "left").withColumn("_d", F.coalesce("_d", F.lit(1.0)))
    if start is not None:
        rows = rows.join(start.select(*key, F.col("value").cast("double").alias("x")), key, "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
        rows = times(rows, "x", "_ax").withColumn("r", c("b") - c("_ax"))
    else:
        rows = rows.withColumns({"x": F.lit(0.0), "r": c("b")})
    zero = {n: F.lit(0.0) for n in ("p", "v")} | {n: F.lit(1.0) for n in ("rho", "alpha", "omega")}
    state = summed(rows, size=c("b") * c("b"), left=c("r") * c("r")).withColumns(zero | {"rh": c("r")})
    keep = [*key, "b", "_d", "x", "r", "rh", "p", "v", "rho", "alpha", "omega", "size", "left"]
    state = cut(state.select(*keep))
    finished: list[DataFrame] = []
    for _ in range(steps):
        stand = (c("left") <= enough * c("size")) | c("stuck")
        state = state.withColumn("stuck", (c("rho") == 0) | (c("omega") == 0))
        finished.append(state.where(stand))
        state = state.where(~stand).drop("stuck")
        if state.isEmpty():
            break
        state = summed(state, new=c("rh") * c("r"))
        beta = over(c("new"), c("rho")) * over(c("alpha"), c("omega"))
        state = state.withColumn("p", c("r") + beta * (c("p") - c("omega") * c("v"))).withColumns({"rho": c("new"), "y": c("p") / c("_d")})
        state = cut(times(state.drop("new", "v"), "y", "v"))
        state = summed(state, rv=c("rh") * c("v")).withColumn("alpha", over(c("rho"), c("rv")))
        state = state.withColumn("s", c("r") - c("alpha") * c("v")).withColumn("z", c("s") / c("_d"))
        state = cut(times(state.drop("rv"), "z", "t"))
        state = summed(state, ts=c("t") * c("s"), tt=c("t") * c("t")).withColumn("omega", over(c("ts"), c("tt")))
        state = state.withColumns({"x": c("x") + c("alpha") * c("y") + c("omega") * c("z"), "r": c("s") - c("omega") * c("t")})
        state = cut(summed(state.drop("left"), left=c("r") * c("r")).select(*keep))
    out = reduce(DataFrame.unionByName, [f.drop("stuck") for f in finished], state)
    return out.select(*key, c("x").alias("value"), over(c("left"), c("size")).alias("error"))
