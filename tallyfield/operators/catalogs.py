"""Catalogues of points: radius joins, de-duplication, merging, pruning, ranking.

Points are found near each other by cells: each point goes to its own cell, its partner's side to the 3 x 3 cells around, so
the join is an equi-join on the cell and the exact distance is a filter. A period wraps the first axis.

Rows at one place have the same neighbours, so what is near what is found between places; rows only meet their own place's
result. Work on pairs grows with places near each other, not with the rows there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import cut


def wrapped(d: Column, period: float | None) -> Column:
    return d if period is None else d - F.round(d / period) * period


def pairs(a: DataFrame, b: DataFrame, id: str, x: str, y: str, radius: float, period: float | None = None, once: bool = False) -> DataFrame:
    """(id, other, dist) of rows of a and b at most radius apart. once: a and b are one table; each pair of different ids is given
    once, the lesser id first, from half the cells around."""
    n = None if period is None else max(1, int(period // radius))
    once, half = once and (n is None or n > 2), [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    size = radius if n is None else period / n
    cell = lambda c: F.floor(c / size).cast("long")
    turn = lambda c: c if n is None else F.pmod(c, F.lit(n))
    left = a.select(F.col(id), F.col(x).alias("_x1"), F.col(y).alias("_y1"), turn(cell(F.col(x))).alias("_cx"), F.floor(F.col(y) / radius).cast("long").alias("_cy"))
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if not once or (i, j) in half])
    right = b.select(F.col(id).alias("other"), F.col(x).alias("_x2"), F.col(y).alias("_y2"), F.explode(shifts).alias("_s"))
    same = ((F.col("_s.i") == 0) & (F.col("_s.j") == 0)).alias("_same")
    right = right.select("other", "_x2", "_y2", turn(cell(F.col("_x2")) + F.col("_s.i")).alias("_cx"), (F.floor(F.col("_y2") / radius) + F.col("_s.j")).cast("long").alias("_cy"), same)
    right = right.dropDuplicates(["other", "_cx", "_cy"]) if n is not None and n < 3 else right
    dx, dy = wrapped(F.col("_x1") - F.col("_x2"), period), F.col("_y1") - F.col("_y2")
    met = left.join(right, ["_cx", "_cy"])
    met = met.where(~F.col("_same") | (F.col(id) < F.col("other"))) if once else met
    met = met.withColumn("dist", F.sqrt(dx * dx + dy * dy)).where(F.col("dist") <= radius).select(id, "other", "dist")
    return met.where(F.col(id) != F.col("other")).select(F.least(id, "other").alias(id), F.greatest(id, "other").alias("other"), "dist") if once else met


def places(cat: DataFrame, id: str, x: str, y: str, *sums: Column) -> DataFrame:
    """One row a place: x, y, `_place` (the least id there) and sums over its rows. Rows without a finite place are near nothing."""
    finite = [(F.abs(c) < float("inf")) & ~F.isnan(c) for c in (x, y)]
    return cut(cat.where(finite[0] & finite[1]).groupBy(x, y).agg(F.min(id).alias("_place"), *sums))


def pairs_by_place(cat: DataFrame, id: str, x: str, y: str, radius: float, period: float | None = None, shown: Column | None = None) -> DataFrame:
    """The same as pairs of one table given once. shown: what is given as the distance, a function of `dist` that is worked out
    once for two places."""
    at = places(cat, id, x, y)
    met = pairs(at, at, "_place", x, y, radius, period, once=True).unionByName(at.select("_place", F.col("_place").alias("other"), F.lit(0.0).alias("dist")))
    met = cut(met.select(F.col("_place").alias("_p"), F.col("other").alias("_q"), F.col("dist") if shown is None else shown.alias("dist")))
    rows = cut(cat.join(at, [x, y]).select(id, "_place"))
    one = met.join(rows.select(F.col("_place").alias("_p"), F.col(id).alias("_a")), "_p")
    two = one.join(rows.select(F.col("_place").alias("_q"), F.col(id).alias("_b")), "_q").where("_p <> _q OR _a < _b")
    return two.select(F.least("_a", "_b").alias(id), F.greatest("_a", "_b").alias("other"), "dist")


def first_wins(cat: DataFrame, id: str, x: str, y: str, radius: float, score: str, period: float | None = None) -> DataFrame:
    """Greedy de-duplication in order of score (ties: least id): a row stays unless a row that stays and ranks higher is near.
    Adds `owner`, the best-ranked staying neighbour of a row that goes (itself if it stays). Ids have to be unique.

    At a place only the best row can stay: what is near it, itself too, is near the others there. So places are decided, and
    the others there go to the best row or to its owner.

    Greedy order is found in parallel: each round, places that no undecided better neighbour has stay, and what is
    near them goes; the result is that of the one-by-one scan. Each round decides the best open place at least.
    """
    if not cat.where(F.col(id).isNotNull()).groupBy(id).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        raise RuntimeError("rows can't be decided; ids have to be unique")
    rank = F.struct((-F.col(score)).alias("s"), F.col(id).alias("i"))
    at = places(cat, id, x, y, F.min(rank).alias("_r"))
    ranked = at.select("_place", "_r")
    near = pairs(at, at, "_place", x, y, radius, period).where("_place <> other")
    near = cut(near.join(ranked, "_place").join(ranked.select(F.col("_place").alias("other"), F.col("_r").alias("_ro")), "other").where("_ro < _r").select("_place", "other", "_ro"))
    state = cut(ranked.select("_place", F.lit(None).cast("boolean").alias("_keep")))
    left = None
    while True:
        better = near.join(state.select(F.col("_place").alias("other"), F.col("_keep").alias("_k")), "other").groupBy("_place").agg(F.bool_or(F.coalesce("_k", F.lit(False))).alias("_beaten"), F.bool_or(F.col("_k").isNull()).alias("_open"))
        new = state.join(better, "_place", "left").withColumn("_keep", F.coalesce("_keep", F.when(F.col("_beaten"), F.lit(False)).when(~F.coalesce("_open", F.lit(False)), F.lit(True))))
        state = cut(new.select("_place", "_keep"))
        before, left = left, state.where("_keep IS NULL").count()
        if not left:
            break
        if left == before:
            raise RuntimeError(f"{left} places can't be decided")
    owner = near.join(state.where("_keep").select(F.col("_place").alias("other")), "other").groupBy("_place").agg(F.min("_ro").alias("_o"))
    decided = at.join(state, "_place").join(owner, "_place", "left").select(x, y, "_keep", F.col("_r.i").alias("_best"), F.when(F.col("_keep"), F.col("_r.i")).otherwise(F.col("_o.i")).alias("_owner"))
    out = cat.join(decided, [x, y], "left")
    keep = F.coalesce(F.col("_keep") & (F.col(id) == F.col("_best")), F.lit(True))  # a row without a place stays
    return out.select(*cat.columns, keep.alias("keep"), F.coalesce("_owner", id).alias("owner"))


def merged(owned: DataFrame, id: str, x: str, y: str, amp: str, weight: Column, brightest_share: float = 0.0) -> DataFrame:
    """One row per owner: weighted mean place and amplitude of members of at least a share of the brightest; strongest member's id."""
    top = F.max(F.abs(amp)).over(W.partitionBy("owner"))
    rows = owned.withColumn("_top", top).where(F.abs(amp) >= brightest_share * F.col("_top")).withColumn("_w", weight)
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("_w")), F.sum("_w")).alias(c)
    return rows.groupBy("owner").agg(mean(x), mean(y), mean(amp), F.max_by(id, F.struct(F.abs(amp), -F.col(id))).alias("strongest"), F.count(F.lit(1)).alias("members"))


def near_bright(cat: DataFrame, id: str, x: str, y: str, amp: str, bright: float, radius: float, score: str, period: float | None = None) -> DataFrame:
    """Around each bright row only the best-scored row stays; a row that any bright one rejects goes. So a row stays if no bright
    place is near, or if it is the best around each of them."""
    at = places(cat, id, x, y, F.max(F.struct(F.col(score).alias("s"), (-F.col(id)).alias("i"))).alias("_s"), F.max(F.coalesce(F.col(amp) >= bright, F.lit(False))).alias("_bright"))
    met = cut(pairs(at.where("_bright"), at, "_place", x, y, radius, period))
    best = met.join(at.select(F.col("_place").alias("other"), "_s"), "other").groupBy("_place").agg((-F.max("_s")["i"]).alias("_best"))
    around = met.join(best, "_place").groupBy(F.col("other").alias("_place")).agg(F.min("_best").alias("_low"), F.max("_best").alias("_high"))
    out = cat.join(at.select(x, y, "_place").join(around, "_place"), [x, y], "left")
    return out.where((F.col("_low").isNull()) | ((F.col("_low") == F.col(id)) & (F.col("_high") == F.col(id)))).select(*cat.columns)


def beam_at(dist: Column, sigma: float) -> Column:
    return F.exp(-dist * dist / (2 * sigma * sigma))


def flux_at(cat: DataFrame, id: str, x: str, y: str, amp: str, sigma: float, reach: float, period: float | None = None) -> DataFrame:
    """Sum over near rows (itself too) of amplitude times beam."""
    at = places(cat, id, x, y, F.sum(amp).alias("_a"))
    met = pairs(at, at, "_place", x, y, reach, period).join(at.select(F.col("_place").alias("other"), "_a"), "other")
    flux = met.groupBy("_place").agg(F.sum(F.col("_a") * beam_at(F.col("dist"), sigma)).alias("flux"))
    return cat.select(id, x, y).join(at.select(x, y, "_place").join(flux, "_place"), [x, y]).select(id, "flux")


def contained(cat: DataFrame, id: str, x: str, y: str, amp: str, sigma: float, reach: float, period: float | None = None) -> DataFrame:
    """Rows that no brighter near row explains: its amplitude times beam stays under their own. At each place around it is the
    brightest row that counts, so a place has one level under which its rows go."""
    at = places(cat, id, x, y, F.max(amp).alias("_b"))
    met = pairs(at, at, "_place", x, y, reach, period).join(at.select(F.col("_place").alias("other"), "_b"), "other")
    level = met.groupBy("_place").agg(F.max(F.least(F.col("_b"), F.col("_b") * beam_at(F.col("dist"), sigma))).alias("_level"))
    out = cat.join(at.select(x, y, "_place").join(level, "_place"), [x, y], "left")
    return out.where(~F.coalesce(F.col("_level") > F.col(amp), F.lit(False))).select(*cat.columns)


def chained(cat: DataFrame, id: str, x: str, y: str, amp: str, strong: float, share: float, core: float, jump: float, reach: float) -> DataFrame:
    """(strong, id): weak rows near a strong one, those in its core, and those that a chain of jumps links to the core, within reach.

    Which rows are weak depends on the strong row's amplitude, but a chain can always go by the weakest row of a place. So
    each place around a strong one has a level, the least over chains of the strongest among their places' weakest rows; a
    strong row is linked with those rows there that are weak, if the level is. A task finds the levels around one strong place.
    """
    at = places(cat, id, x, y, F.min(amp).alias("_low"), F.max(amp).alias("_top"))
    around = pairs(at.where(F.col("_top") >= strong), at, "_place", x, y, reach).join(at.select(F.col("_place").alias("other"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col("_low").cast("double")), "other")
    around = around.join(at.select("_place", "_top"), "_place").where(F.col("_low") < share * F.col("_top")).select("_place", "other", "dist", "_low", "_x", "_y")

    def levels(frame: pd.DataFrame) -> pd.DataFrame:
        low, px, py = (frame[c].to_numpy() for c in ("_low", "_x", "_y"))
        level = np.where(frame["dist"].to_numpy() <= core, low, np.inf)
        open_ = level.copy()
        while (best := open_[k := int(open_.argmin())]) < np.inf:
            dx, dy = px - px[k], py - py[k]
            near = np.sqrt(dx * dx + dy * dy) <= jump
            by_k = np.maximum(best, low)
            better = near & (by_k < level)
            level[better] = open_[better] = by_k[better]
            open_[k] = np.inf
        return frame.assign(_level=level)[["_place", "other", "_level"]][level < np.inf]

    kind = dict(cat.dtypes)[id]
    found = cut(around.groupBy("_place").applyInPandas(levels, f"_place {kind}, other {kind}, _level double"))
    rows = cut(cat.join(at.select(x, y, "_place"), [x, y]).select(F.col(id).alias("_i"), "_place", F.col(amp).alias("_a")))
    bright = rows.where(F.col("_a") >= strong).select("_place", F.col("_i").alias("strong"), (share * F.col("_a")).alias("_limit"))
    linked = found.join(bright, "_place").where("_level < _limit").select("strong", "_limit", F.col("other").alias("_place"))
    return linked.join(rows, "_place").where("_a < _limit AND strong <> _i").select("strong", F.col("_i").alias(id))


def tile_border_merge(cats: list[tuple[DataFrame, tuple[float, float, float, float]]], id: str, x: str, y: str, score: str, margin: float, radius: float) -> DataFrame:
    """Catalogues of neighbouring boxes (x0, x1, y0, y1): inner rows stay as they are, rows of the border band are de-duplicated;
    by score, best first. Catalogues may use the same ids: rows are told apart by id and catalogue."""
    inner, border = [], []
    for k, (df, (x0, x1, y0, y1)) in enumerate(cats):
        inside = (F.col(x) >= x0 + margin) & (F.col(x) < x1 - margin) & (F.col(y) >= y0 + margin) & (F.col(y) < y1 - margin)
        inner.append(df.where(inside))
        border.append(df.where(~inside).withColumn("_key", F.struct(F.col(id).alias("id"), F.lit(k).alias("cat"))))
    kept = first_wins(reduce(DataFrame.unionByName, border), "_key", x, y, radius, score).where("keep").drop("_key", "keep", "owner")
    return reduce(DataFrame.unionByName, [*inner, kept]).orderBy(F.col(score).desc(), id)


def independent(cat: DataFrame, id: str, x: str, y: str, radius: float, period: float | None = None) -> DataFrame:
    """Splits rows into sets without near pairs: set 0 is the greedy choice by id, set 1 that of the rest, and so on.

    So a row's set is the least one that no near row of a lesser id is in. Sets depend on each other along chains of ids
    that cross the whole plane, so one task takes the rows in order; it holds id, place and set of each row.
    """
    rows = cat.select(F.col(id), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_rows = [f for f in frames if len(f)]
        if not all_rows:
            return
        frame = pd.concat(all_rows).sort_values(id, kind="stable")
        yield pd.DataFrame({id: frame[id], "grp": least_free(frame["_x"].to_numpy(), frame["_y"].to_numpy(), radius, period)})

    return rows.coalesce(1).mapInPandas(run, f"`{id}` {dict(cat.dtypes)[id]}, grp int")


def least_free(x: np.ndarray, y: np.ndarray, radius: float, period: float | None, decided: tuple | None = None) -> np.ndarray:
    """Set of each point in order: the least that no earlier point at most radius away is in. decided: x, y and lists of sets of
    places that come before all.

    Each place holds, a bit a set, what is taken around it. A point reads its place's first free bit, which only moves up, and
    sets that bit at the places around; so a point costs as much as there are places around it, whatever their rows.
    """
    n = None if period is None else max(1, int(period // radius))
    size = radius if n is None else period / n
    out = np.zeros(len(x), np.int32)
    finite = np.flatnonzero(np.isfinite(x) & np.isfinite(y))  # the others are near nothing
    if not len(finite):
        return out
    spots, place = np.unique(np.stack([x[finite], y[finite]], axis=1) + 0.0, axis=0, return_inverse=True)
    place = place.ravel()
    turn = lambda c: c if n is None else c % n
    cell_of = lambda px, py: (turn(math.floor(px / size)), math.floor(py / radius))
    members: dict[tuple[int, int], list[int]] = {}
    home = []
    for k, (px, py) in enumerate(spots.tolist()):
        cell = cell_of(px, py)
        own = members.setdefault(cell, [])
        home.append((cell, len(own)))
        own.append(k)
    held = {cell: spots[own] for cell, own in members.items()}
    taken = {cell: np.zeros((len(own), 8), np.uint8) for cell, own in members.items()}

    def around(px: float, py: float) -> list[tuple[tuple[int, int], np.ndarray]]:
        """Cells, and numbers in them, of the places near one."""
        cx, cy = cell_of(px, py)
        met = []
        for i in {turn(cx + s) for s in (-1, 0, 1)}:
            for j in (cy - 1, cy, cy + 1):
                if (there := held.get((i, j))) is not None:
                    dx, dy = px - there[:, 0], py - there[:, 1]
                    if period is not None:
                        dx = dx - np.round(dx / period) * period
                    near = np.flatnonzero(np.sqrt(dx * dx + dy * dy) <= radius)
                    if len(near):
                        met.append(((i, j), near))
        return met

    def wide(cell: tuple[int, int], width: int) -> np.ndarray:
        bits = taken[cell]
        if bits.shape[1] < width:
            bits = taken[cell] = np.pad(bits, ((0, 0), (0, max(width, 2 * bits.shape[1]) - bits.shape[1])))
        return bits

    for px, py, sets in zip(*decided, strict=True) if decided else ():
        flags = np.zeros(int(np.max(sets)) + 1, np.uint8)
        flags[np.asarray(sets)] = 1
        packed = np.packbits(flags, bitorder="little")
        for cell, near in around(px, py):
            wide(cell, len(packed))[near, : len(packed)] |= packed
    to_come = np.bincount(place)
    first, known = [0] * len(spots), {}
    for k, p in zip(finite.tolist(), place.tolist(), strict=True):
        cell, own = home[p]
        bits, b = taken[cell][own], first[p]
        while b < len(bits) and bits[b] == 255:
            b += 1
        first[p] = b
        byte = int(bits[b]) if b < len(bits) else 0
        bit = (~byte & (byte + 1)).bit_length() - 1
        out[k] = 8 * b + bit
        to_come[p] -= 1
        met = known.get(p) or around(*spots[p].tolist())
        if to_come[p]:
            known[p] = met
        else:
            known.pop(p, None)
        for near_cell, near in met:
            wide(near_cell, b + 1)[near, b] |= np.uint8(1 << bit)
    return out


def independent_by_cells(cat: DataFrame, id: str, x: str, y: str, radius: float, period: float | None = None) -> DataFrame:
    """The same in another order that needs no single task: cells of the radius' width are taken in four turns, like the fields
    of a board, in which no two cells are within the radius of each other; inside a cell the order is that of ids. A row's set
    is the least one that no near row before it is in. A task holds one cell and what is decided around it.

    A wrapped axis needs an even number of cells, so they are up to twice as wide there. Rows without a place are in set 0.
    """
    n = None if period is None else max(2, 2 * int(period // radius // 2))
    if period is not None and period / n < radius:
        return independent(cat, id, x, y, radius, period)  # the whole period is within two radii
    size = radius if n is None else period / n
    turn = lambda c: c if n is None else F.pmod(c, F.lit(n))
    cx, cy = turn(F.floor(F.col(x).cast("double") / size)), F.floor(F.col(y).cast("double") / radius)
    finite = F.coalesce((F.abs(F.col(x)) < float("inf")) & (F.abs(F.col(y)) < float("inf")), F.lit(False)) & ~F.isnan(x) & ~F.isnan(y)
    rows = cat.select(F.col(id), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), cx.cast("long").alias("_cx"), cy.cast("long").alias("_cy"), finite.alias("_ok"))
    lost = rows.where("NOT _ok").select(id, F.lit(0).alias("grp"))
    rows = cut(rows.where("_ok").drop("_ok").withColumn("_turn", (F.pmod("_cx", F.lit(2)) * 2 + F.pmod("_cy", F.lit(2))).cast("int")))
    near = F.array(*[F.struct(turn(F.col("_cx") + i).cast("long").alias("cx"), (F.col("_cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    kind = dict(cat.dtypes)[id]

    def run(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        new = new.sort_values(id, kind="stable")
        grp = least_free(new["_x"].to_numpy(), new["_y"].to_numpy(), radius, period, (old["_x"].tolist(), old["_y"].tolist(), old["grp"].tolist()))
        return new.assign(grp=grp)[[id, "_x", "_y", "_cx", "_cy", "grp"]]

    done: list[DataFrame] = []
    for k in range(4):
        own = rows.where(F.col("_turn") == k).drop("_turn")
        around = reduce(DataFrame.unionByName, done) if done else own.limit(0).withColumn("grp", F.lit(0))
        around = around.groupBy("_cx", "_cy", "_x", "_y").agg(F.collect_list("grp").alias("grp"))  # a row a place
        around = around.withColumn("_n", F.explode(F.array_distinct(near))).select("_x", "_y", F.col("_n.cx").alias("_cx"), F.col("_n.cy").alias("_cy"), "grp")
        done.append(cut(own.groupBy("_cx", "_cy").cogroup(around.groupBy("_cx", "_cy")).applyInPandas(run, f"`{id}` {kind}, _x double, _y double, _cx long, _cy long, grp int")))
    return reduce(DataFrame.unionByName, done).select(id, "grp").unionByName(lost)


def round_robin(scores: DataFrame, row: str, col: str, score: str, turns: int) -> DataFrame:
    """Each turn, every row in order takes its best free column. Rows choose one after the other, so this is one task over a
    score matrix that has to be small; it is checked to be."""
    if scores.count() > 1_000_000:
        raise ValueError("assignment in turns is for small matrices")
    table = sorted((r[0], r[1], r[2]) for r in scores.select(row, col, score).collect())
    by_row: dict = {}
    for r, c, s in table:
        by_row.setdefault(r, []).append((-s, c))
    taken: set = set()
    out = []
    for turn in range(turns):
        for r in sorted(by_row):
            free = [x for x in sorted(by_row[r]) if x[1] not in taken]
            if free:
                taken.add(free[0][1])
                out.append((r, free[0][1], turn))
    kinds = dict(scores.dtypes)
    return scores.sparkSession.createDataFrame(out, f"{row} {kinds[row]}, {col} {kinds[col]}, turn int")
