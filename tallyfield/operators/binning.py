"""Sums of samples on grids (scatter), lookups from grids (gather), and statistics of grids.

A grid is a table (y, x, ...). Scatters are partial sums before one shuffle on the cell; a bilinear or bicubic sample is
exploded into its weighted cells first. Gathers are equi-joins on the cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import cut


def nearest(y: Column, x: Column) -> Column:
    """One cell of weight 1."""
    return F.array(F.struct(F.floor(y + 0.5).cast("int").alias("y"), F.floor(x + 0.5).cast("int").alias("x"), F.lit(1.0).alias("w")))


def bilinear(y: Column, x: Column) -> Column:
    """Four cells; weights (1 - f) and f per axis."""
    fy, fx = y - F.floor(y), x - F.floor(x)
    cells = []
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            cells.append(F.struct((F.floor(y) + dy).cast("int").alias("y"), (F.floor(x) + dx).cast("int").alias("x"), (wy * wx).alias("w")))
    return F.array(*cells)


def cubic_weights(f: Column) -> list[Column]:
    """Weights of the cells -1, 0, 1, 2 of the interpolating cubic through four values (a = -1/2)."""
    return [((-0.5 * f + 1) * f - 0.5) * f, (1.5 * f - 2.5) * f * f + 1, ((-1.5 * f + 2) * f + 0.5) * f, (0.5 * f - 0.5) * f * f]


def bicubic(y: Column, x: Column) -> Column:
    fy, fx = y - F.floor(y), x - F.floor(x)
    return F.array(
        *[
            F.struct((F.floor(y) + dy - 1).cast("int").alias("y"), (F.floor(x) + dx - 1).cast("int").alias("x"), (wy * wx).alias("w"))
            for dy, wy in enumerate(cubic_weights(fy))
            for dx, wx in enumerate(cubic_weights(fx))
        ]
    )


def scatter(samples: DataFrame, cells: Column, value: str, comps: dict[str, Column], shape: tuple[int, int], split: list[str] = [], at: list[str] = []) -> DataFrame:  # noqa: B006
    """Per cell: the sum of weight * value * component for each component; cells outside the grid are skipped. at: the columns that
    the cells are worked out from, if places repeat; samples of one place are then summed before they are spread over its cells."""
    if at:
        samples = samples.groupBy(*split, *at).agg(*[F.sum(F.col(value) * c).alias(f"_at_{k}") for k, c in comps.items()]).withColumn(value, F.lit(1.0))
        comps = {k: F.col(f"_at_{k}") for k in comps}
    rows = samples.withColumn("_c", F.explode(cells))
    rows = rows.where((F.col("_c.y") >= 0) & (F.col("_c.y") < shape[0]) & (F.col("_c.x") >= 0) & (F.col("_c.x") < shape[1]))
    rows = rows.withColumns({f"_v_{k}": F.col("_c.w") * F.col(value) * c for k, c in comps.items()})
    return rows.groupBy(*split, F.col("_c.y").alias("y"), F.col("_c.x").alias("x")).agg(*[F.sum(f"_v_{k}").alias(k) for k in comps])


#: Places of the cells of nearest(), bilinear() and bicubic() from their first one.
ONE, FOUR, SIXTEEN = [(0, 0)], [(0, 0), (0, 1), (1, 0), (1, 1)], [(dy, dx) for dy in range(4) for dx in range(4)]


def gather(samples: DataFrame, cells: Column, grid: DataFrame, comps: dict[str, Column], key: list[str], places: list[tuple[int, int]] = FOUR) -> DataFrame:
    """Per sample: the sum over its cells of weight * (grid components . sample components); the transpose of scatter.

    Each grid cell is sent to the samples' first cells that it serves, so that one row there holds all that a sample needs:
    samples are joined once, on their first cell, and neither multiplied nor summed up again.
    """
    spread = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x")) for k, (dy, dx) in enumerate(places)]))
    held = grid.select(spread.alias("_s"), *comps).groupBy(F.col("_s.y").alias("y"), F.col("_s.x").alias("x"))
    held = held.agg(*[F.sum(F.when(F.col("_s.k") == k, F.col(c))).alias(f"_g{k}_{c}") for k in range(len(places)) for c in comps])
    rows = samples.withColumns({"_c": cells, **{f"_k_{k}": c for k, c in comps.items()}})
    rows = rows.select(*key, F.col("_c")[0]["y"].alias("y"), F.col("_c")[0]["x"].alias("x"), F.transform("_c", lambda c: c["w"]).alias("_w"), *[f"_k_{k}" for k in comps])
    at = lambda k: reduce(lambda a, b: a + b, [F.coalesce(F.col(f"_g{k}_{c}"), F.lit(0.0)) * F.col(f"_k_{c}") for c in comps])
    model = reduce(lambda a, b: a + b, [F.col("_w")[k] * at(k) for k in range(len(places))])
    return rows.join(held, ["y", "x"], "left").select(*key, model.alias("model"))


def clamped(samples: DataFrame, y: Column, x: Column, value: str, shape: tuple[int, int]) -> DataFrame:
    """Sums per nearest cell, samples outside put on the edge."""
    at = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c + 0.5).cast("int")))
    return samples.groupBy(at(y, shape[0]).alias("y"), at(x, shape[1]).alias("x")).agg(F.sum(value).alias("total"))


def by_azimuth(samples: DataFrame, key: list[str], az: Column, az0: float, daz: float, value: str, n: int | None = None) -> DataFrame:
    """Sums per key and azimuth bin; with n, bins outside 0..n-1 are skipped."""
    rows = samples.withColumn("bin", F.floor((az - az0) / daz).cast("int"))
    rows = rows if n is None else rows.where((F.col("bin") >= 0) & (F.col("bin") < n))
    return rows.groupBy(*key, "bin").agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("hits"))


def flat_histogram(samples: DataFrame, key: list[str], pixel: Column, div: int, n: int) -> DataFrame:
    """Counts of a flat pixel's coordinate along one axis."""
    return samples.groupBy(*key, F.pmod(F.floor(pixel / div), F.lit(n)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("hits"))


def add_rows(rows: DataFrame, n_phi: int) -> DataFrame:
    """(y, x1, x2, w): adds w to the cells x1..x2-1 of row y, wrapping at n_phi; by differences and a running sum, so that
    long intervals cost two rows."""
    whole = F.floor((F.col("x2") - F.col("x1")) / n_phi)
    a = F.pmod(F.col("x1"), F.lit(n_phi))
    b = a + F.pmod(F.col("x2") - F.col("x1"), F.lit(n_phi))
    marks = F.array(
        F.struct(F.lit(0).alias("x"), (F.col("w") * whole).alias("d")),
        F.struct(a.cast("int").alias("x"), F.col("w").alias("d")),
        F.struct(F.least(b, F.lit(n_phi)).cast("int").alias("x"), (-F.col("w")).alias("d")),
        F.struct(F.lit(0).alias("x"), F.when(b > n_phi, F.col("w")).otherwise(0.0).alias("d")),
        F.struct(F.greatest(b - n_phi, F.lit(0)).cast("int").alias("x"), F.when(b > n_phi, -F.col("w")).otherwise(0.0).alias("d")),
    )
    ends = rows.where("x2 > x1").select("y", F.explode(marks).alias("m")).groupBy("y", F.col("m.x").alias("x")).agg(F.sum("m.d").alias("d"))
    run = ends.withColumn("total", F.sum("d").over(W.partitionBy("y").orderBy("x"))).withColumn("next", F.lead("x", 1, n_phi).over(W.partitionBy("y").orderBy("x")))
    return run.where("x < next").select("y", F.explode(F.sequence("x", F.col("next") - 1)).alias("x"), "total")


def weight_matrix(samples: DataFrame, cell: list[str], weight: str, comps: list[Column]) -> DataFrame:
    """The upper triangle of the sum of w * c_i * c_j per cell, and hits."""
    pairs = {f"m{i}{j}": F.col(weight) * comps[i] * comps[j] for i in range(len(comps)) for j in range(i, len(comps))}
    rows = samples.withColumns({f"_{k}": c for k, c in pairs.items()})
    return rows.groupBy(*cell).agg(*[F.sum(f"_{k}").alias(k) for k in pairs], F.count(F.lit(1)).alias("hits"))


def solve3(m: DataFrame, limit: float = 1e-9) -> DataFrame:
    """Solves the symmetric 3 x 3 system (m00..m22) s = (r0, r1, r2) per cell by cofactors; a nearly singular cell keeps the
    scalar solution r0 / m00, an empty one 0."""
    a, b, c, d, e, f = (F.col(k) for k in ("m00", "m01", "m02", "m11", "m12", "m22"))
    r = [F.col(f"r{k}") for k in range(3)]
    co = [[d * f - e * e, c * e - b * f, b * e - c * d], [c * e - b * f, a * f - c * c, b * c - a * e], [b * e - c * d, b * c - a * e, a * d - b * b]]
    det = a * co[0][0] + b * co[0][1] + c * co[0][2]
    good = F.abs(det) > limit * a * d * f
    out = {}
    for k in range(3):
        full = (co[k][0] * r[0] + co[k][1] * r[1] + co[k][2] * r[2]) / F.nullif(det, F.lit(0.0))
        scalar = F.coalesce(F.try_divide(r[0], a), F.lit(0.0)) if k == 0 else F.lit(0.0)
        out[f"s{k}"] = F.when(good, full).otherwise(scalar)
    return m.withColumns(out)


def block_stats(grid: DataFrame, value: str, by: int, bx: int, least: int = 1, default: tuple[float, float] | None = None) -> DataFrame:
    """Count, mean and standard deviation per block; blocks with fewer than `least` cells get the good blocks' medians."""
    rows = grid.groupBy(F.floor(F.col("y") / by).cast("int").alias("by"), F.floor(F.col("x") / bx).cast("int").alias("bx"))
    stats = rows.agg(F.count(value).alias("n"), F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sigma"))
    good = stats.where(F.col("n") >= least).agg(F.median("_mu").alias("_dm"), F.median("_sigma").alias("_ds"))
    fill = default or (0.0, 1.0)
    use = F.col("n") >= least
    stats = stats.join(F.broadcast(good))
    return stats.select("by", "bx", "n", F.when(use, F.col("_mu")).otherwise(F.coalesce("_dm", F.lit(fill[0]))).alias("mu"), F.when(use, F.col("_sigma")).otherwise(F.coalesce("_ds", F.lit(fill[1]))).alias("sigma"))


def radial(grid: DataFrame, value: str, y0: float, x0: float, dr: float) -> DataFrame:
    """Mean per ring around a point."""
    r = F.sqrt((F.col("y") - y0) ** 2 + (F.col("x") - x0) ** 2)
    return grid.groupBy(F.floor(r / dr).cast("int").alias("ring")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def smooth_radial(grid: DataFrame, value: str, y0: float, x0: float, dr: float) -> DataFrame:
    """Each cell with its ring's mean: a sum per ring joined back (rings are few, so the join broadcasts)."""
    r = F.floor(F.sqrt((F.col("y") - y0) ** 2 + (F.col("x") - x0) ** 2) / dr).cast("int")
    return grid.withColumn("ring", r).join(radial(grid, value, y0, x0, dr).select("ring", F.col("mean").alias("smooth")), "ring")


def downgrade(grid: DataFrame, value: str, factor: int) -> DataFrame:
    """Block means on a coarser grid."""
    return grid.groupBy(F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.avg(value).alias(value))


def pyramid(grid: DataFrame, value: str, levels: int) -> DataFrame:
    """All levels of a pyramid, each the 2 x 2 means of the one below: sums and counts per level, so each level is made of
    the level under it and only the first touches the grid."""
    now = grid.select(F.lit(0).alias("level"), "y", "x", F.col(value).alias(value))
    out = now
    for k in range(1, levels + 1):
        now = downgrade(now, value, 2).select(F.lit(k).alias("level"), "y", "x", value)
        out = out.unionByName(now)
    return out


def retile(cells: DataFrame, tile_y: int, tile_x: int, off_y: int = 0, off_x: int = 0, wrap: int | None = None) -> DataFrame:
    """Adds tile numbers (ty, tx) and places inside (iy, ix) for another tiling; x wraps if a period is given."""
    y, x = F.col("y") - off_y, F.col("x") - off_x
    x = x if wrap is None else F.pmod(x, F.lit(wrap))
    return cells.withColumns({"ty": F.floor(y / tile_y).cast("int"), "tx": F.floor(x / tile_x).cast("int"), "iy": F.pmod(y, F.lit(tile_y)).cast("int"), "ix": F.pmod(x, F.lit(tile_x)).cast("int")})


def read_box(cells: DataFrame, y: tuple[int, int], x: tuple[int, int], wrap: int) -> DataFrame:
    """Cells of a box that may cross the wrap: at most two ranges of x, so the filter reaches the scan."""
    a, n = x[0] % wrap, x[1] - x[0]
    inside = F.col("x").between(a, min(a + n, wrap) - 1)
    if a + n > wrap:
        inside = inside | F.col("x").between(0, a + n - wrap - 1)
    return cells.where(F.col("y").between(y[0], y[1] - 1) & inside).withColumns({"oy": F.col("y") - y[0], "ox": F.pmod(F.col("x") - a, F.lit(wrap))})


def tiles(spark, shape: tuple[int, int], tile: tuple[int, int]) -> DataFrame:
    """Boxes of a tiling, clipped at the edges."""
    ny, nx = -(-shape[0] // tile[0]), -(-shape[1] // tile[1])
    rows = spark.range(ny * nx).select(F.floor(F.col("id") / nx).cast("int").alias("ty"), (F.col("id") % nx).cast("int").alias("tx"))
    return rows.select("ty", "tx", (F.col("ty") * tile[0]).alias("y0"), F.least((F.col("ty") + 1) * tile[0], F.lit(shape[0])).alias("y1"), (F.col("tx") * tile[1]).alias("x0"), F.least((F.col("tx") + 1) * tile[1], F.lit(shape[1])).alias("x1"))


def merge_weighted(maps: list[DataFrame], value: str, weight: str) -> DataFrame:
    """Overlapping maps: sum(w v) / sum(w) per cell; null and NaN count as 0 with weight 0."""
    rows = reduce(DataFrame.unionByName, [m.select("y", "x", value, weight) for m in maps])
    ok = F.col(value).isNotNull() & ~F.isnan(value)
    w = F.when(ok, F.col(weight)).otherwise(0.0)
    rows = rows.withColumn("_w", w).withColumn("_wv", F.when(ok, F.col(value) * w).otherwise(0.0))
    return rows.groupBy("y", "x").agg(F.coalesce(F.try_divide(F.sum("_wv"), F.sum("_w")), F.lit(0.0)).alias(value), F.sum("_w").alias(weight))


def best(candidates: DataFrame, cell: list[str], score: str, params: list[str]) -> DataFrame:
    """Greatest score per cell with its parameters, and how many scores were not 0."""
    top = F.max_by(F.struct(score, *params), F.struct(F.col(score), *params))
    out = candidates.groupBy(*cell).agg(top.alias("_t"), F.count_if(F.col(score) != 0).alias("hits"))
    return out.select(*cell, F.col("_t")[score].alias(score), *[F.col("_t")[p].alias(p) for p in params], "hits")


def contours(grid: DataFrame, value: str, levels: list[float]) -> DataFrame:
    """Cells whose right or lower neighbour lies on the other side of a level."""
    right = F.lead(value).over(W.partitionBy("y").orderBy("x"))
    down = F.lead(value).over(W.partitionBy("x").orderBy("y"))
    rows = grid.withColumns({"_r": right, "_d": down}).withColumn("level", F.explode(F.array(*map(F.lit, levels))))  # neighbours first
    above = lambda c: c >= F.col("level")
    crossed = (above(F.col(value)) != above(F.col("_r"))) | (above(F.col(value)) != above(F.col("_d")))
    return rows.where(crossed).select("y", "x", "level")


def components(cells: DataFrame, rounds: int = 64) -> DataFrame:
    """Labels 4-connected cells by their least neighbour, round by round with pointer jumps, until nothing changes."""
    rows = cells.select("y", "x").distinct().withColumn("label", F.struct("y", "x"))
    near = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])
    for _ in range(rounds):
        sent = rows.select(F.explode(near).alias("n"), "label").groupBy(F.col("n.y").alias("y"), F.col("n.x").alias("x")).agg(F.min("label").alias("_new"))
        hop = rows.select(F.struct("y", "x").alias("_new"), F.col("label").alias("_far"))
        new = cut(rows.join(sent, ["y", "x"]).join(hop, "_new", "left").select("y", "x", F.least("label", "_new", F.coalesce("_far", "_new")).alias("label"), F.col("label").alias("_old")))
        changed = new.where("label <> _old").limit(1).count()
        rows = new.drop("_old")
        if not changed:
            return rows
    raise RuntimeError("components did not settle")
