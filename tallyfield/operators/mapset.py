"""Sets of maps: normalising, weighting, masking, cutting out, and models seen through beams.

Maps are tables (y, x, ...). Blocks are groups of cells; what comes back from blocks to cells is joined, never collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import binning, catalogs
from .intervals import merge


def _blocked(grid: DataFrame, size: int, shape: tuple[int, int]) -> DataFrame:
    """Cells of whole blocks, with the block's place."""
    ny, nx = shape[0] // size, shape[1] // size
    at = lambda c: F.floor(F.col(c) / size).cast("int")
    return grid.withColumns({"by": at("y"), "bx": at("x")}).where((F.col("by") < ny) & (F.col("bx") < nx))


def normalization(grid: DataFrame, rhs: str, weight: str, size: int, shape: tuple[int, int], hit: float = 0.5) -> DataFrame:
    """One number `a` that makes rhs^2 = a * weight: the median over blocks with enough hit cells of sum(w r^2) / sum(w^2); if no
    block has enough, that of all cells together."""
    top = grid.agg(F.max(weight).alias("_top"))
    rows = _blocked(grid, size, shape).join(F.broadcast(top))
    k, r2 = F.col(weight), F.col(rhs) * F.col(rhs)
    per = rows.groupBy("by", "bx").agg(F.sum(k * r2).alias("kr"), F.sum(k * k).alias("kk"), (F.count_if(k > F.col("_top") * 1e-4) / float(size * size)).alias("share"))
    good = F.when(F.col("share") >= hit, F.try_divide("kr", "kk"))
    return per.agg(F.coalesce(F.median(good), F.try_divide(F.sum("kr"), F.sum("kk"))).alias("a"))


def smooth_normalization(grid: DataFrame, rhs: str, weight: str, size: int, shape: tuple[int, int], tol: float = 2.0) -> DataFrame:
    """Mean of rhs^2 / weight per block, thin and outlying blocks replaced by the median of the others, and read off between
    blocks at each cell: y, x, norm."""
    top = grid.agg(F.max(weight).alias("_top"))
    rows = _blocked(grid, size, shape).join(F.broadcast(top))
    hit = F.col(weight) > F.col("_top") * 1e-4
    per = rows.groupBy("by", "bx").agg(F.count_if(hit).alias("n"), F.avg(F.when(hit, F.col(rhs) * F.col(rhs) / F.col(weight))).alias("q"))
    thick = F.col("n") > size * size / 3
    ref = per.where(thick).agg(F.median("q").alias("_ref"))
    near = thick & (F.abs(F.ln(F.col("q") / F.col("_ref"))) < tol)
    per = per.join(F.broadcast(ref)).withColumn("_ok", F.coalesce(near, F.lit(False)))
    typical = per.agg(F.coalesce(F.median(F.when(F.col("_ok"), F.col("q"))), F.first("_ref"), F.lit(1.0)).alias("_typical"))
    per = per.join(F.broadcast(typical)).select("by", "bx", F.when(F.col("_ok"), F.col("q")).otherwise(F.col("_typical")).alias("norm"))
    return between(grid.select("y", "x"), per, "norm", F.col("y") / size, F.col("x") / size, (shape[0] // size, shape[1] // size))


def between(cells: DataFrame, blocks: DataFrame, value: str, y: Column, x: Column, shape: tuple[int, int]) -> DataFrame:
    """cells with the blocks' value (by, bx, value) read linearly at (y, x); places outside read the edge."""
    clip = lambda c, n: F.greatest(F.lit(0.0), F.least(c, F.lit(float(n - 1))))
    rows = cells.withColumns({"_fy": clip(y, shape[0]), "_fx": clip(x, shape[1])})
    grid = blocks.select(F.col("by").alias("y"), F.col("bx").alias("x"), value)
    got = binning.gather(rows.withColumnsRenamed({"y": "_y", "x": "_x"}), binning.bilinear(F.col("_fy"), F.col("_fx")), grid, {value: F.lit(1.0)}, ["_y", "_x"])
    return got.select(F.col("_y").alias("y"), F.col("_x").alias("x"), F.col("model").alias(value))


def foreground_variance(grid: DataFrame, value: str, small: int, large: int, shape: tuple[int, int], scale: float = 0.5) -> DataFrame:
    """Variance in small blocks, its median over large x large of them, and read off between these in logarithms: y, x, var."""
    v1 = grid.groupBy(F.floor(F.col("y") / small).cast("int").alias("y"), F.floor(F.col("x") / small).cast("int").alias("x")).agg(F.var_pop(value).alias("v"))
    v2 = v1.groupBy(F.floor(F.col("y") / large).cast("int").alias("by"), F.floor(F.col("x") / large).cast("int").alias("bx")).agg(F.median("v").alias("v"))
    typical = v2.agg(F.median(F.when(F.col("v") != 0, F.col("v"))).alias("_typical"))
    v2 = v2.join(F.broadcast(typical)).select("by", "bx", F.ln(F.when(F.col("v") == 0, F.col("_typical")).otherwise(F.col("v"))).alias("var"))
    size = small * large
    n = tuple(-(-s // size) for s in shape)
    at = lambda c: (F.col(c) + 0.5) / size - 0.5
    return between(grid.select("y", "x"), v2, "var", at("y"), at("x"), n).withColumn("var", F.exp("var") * scale)


def weight_by_foreground(grid: DataFrame, ivar: str, var: str, tol: float = 1.0, power: float = 2.0) -> DataFrame:
    """ivar lowered where the foreground's variance exceeds the noise's."""
    ref = grid.agg(F.when(F.avg(ivar) > 0, F.avg(ivar)).otherwise(1.0).alias("_ref"))
    own = 1 / F.greatest(F.col(ivar), F.col("_ref") * 1e-10)
    more = own * F.greatest(F.lit(1.0), tol * F.pow(F.col(var) / (own * tol), F.lit(power)))
    return grid.join(F.broadcast(ref)).withColumn(ivar, 1 / more).drop("_ref")


def robust_reference(grid: DataFrame, weight: str, share: float = 0.9) -> DataFrame:
    """One row `ref`: the median of positive weights above a share of the median of positive weights."""
    first = grid.where(F.col(weight) > 0).agg(F.median(weight).alias("_m"))
    return grid.join(F.broadcast(first)).where((F.col(weight) > 0) & (F.col(weight) > share * F.col("_m"))).agg(F.median(weight).alias("ref"))


def sanitized(grid: DataFrame, value: str, weight: str, most: float, tol: float = 20.0, low: float = 0.2, steep: float = 5.0) -> DataFrame:
    """Values clamped to +-most, weights to tol times the reference, and thin places distrusted: times min(w / (low ref), 1)^steep."""
    rows = grid.join(F.broadcast(robust_reference(grid, weight)))
    w = F.least(F.col(weight), F.col("ref") * tol)
    trust = F.pow(F.least(w / (F.col("ref") * low), F.lit(1.0)), F.lit(steep))
    return rows.withColumns({value: F.greatest(F.lit(-most), F.least(F.lit(most), F.col(value))), weight: w * trust}).drop("ref")


def enough(maps: list[DataFrame], weight: str) -> DataFrame:
    """Cells that any of the maps gives weight to."""
    return reduce(DataFrame.unionByName, [m.select("y", "x", weight) for m in maps]).groupBy("y", "x").agg(F.sum(weight).alias("_w")).where("_w > 0").select("y", "x")


def within(cells: DataFrame, n: int) -> DataFrame:
    """All places at most n cells from one of the cells. Each cell of a run along x is widened as a run, so a solid mask costs its
    runs times 2 n + 1 rows and not its cells times n^2."""
    run = F.col("x") - F.row_number().over(W.partitionBy("y").orderBy("x"))
    runs = cells.select("y", "x").distinct().withColumn("_r", run).groupBy("y", "_r").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    dy = F.explode(F.sequence(F.lit(-n), F.lit(n)))
    grown = runs.withColumn("_dy", dy).withColumn("_w", F.floor(F.sqrt(F.lit(float(n * n)) - F.col("_dy") * F.col("_dy"))).cast("int"))
    grown = grown.select((F.col("y") + F.col("_dy")).alias("y"), (F.col("lo") - F.col("_w")).alias("lo"), (F.col("hi") + F.col("_w") + 1).alias("hi"))
    return merge(grown, ["y"]).select("y", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("x"))


def grown(mask: DataFrame, shape: tuple[int, int], n: int) -> DataFrame:
    """Cells of the mask that are more than n cells from any cell of the shape that is not in it (the shape's edge counts for
    nothing)."""
    spark = mask.sparkSession
    every = spark.range(shape[0] * shape[1]).select(F.floor(F.col("id") / shape[1]).cast("int").alias("y"), (F.col("id") % shape[1]).cast("int").alias("x"))
    return mask.join(within(every.join(mask, ["y", "x"], "left_anti"), n), ["y", "x"], "left_anti")


def placed(thumb: DataFrame, size: tuple[int, int], at: tuple[int, int], shape: tuple[int, int]) -> DataFrame:
    """A cut-out put back with its middle at a place of a whole map that wraps on both axes."""
    move = lambda c, k: F.pmod(F.col(c) - size[k] // 2 + at[k], F.lit(shape[k])).cast("int")
    return thumb.withColumns({"y": move("y", 0), "x": move("x", 1)})


def unpadded(grid: DataFrame, pad: int, shape: tuple[int, int]) -> DataFrame:
    inside = F.col("y").between(pad, shape[0] - pad - 1) & F.col("x").between(pad, shape[1] - pad - 1)
    return grid.where(inside).withColumns({"y": F.col("y") - pad, "x": F.col("x") - pad})


def composed(steps: list[tuple[str, dict]], ly: Column, lx: Column) -> Column:
    """A filter in harmonic space: `radial` and `axial` factors 1 / (1 + (l / knee)^alpha), and `invert`, in order."""
    out = F.lit(1.0)
    for name, p in steps:
        if name == "invert":
            out = 1 - out
            continue
        if name not in ("radial", "axial"):
            raise ValueError(f"unknown filter {name}")
        l = F.sqrt(ly * ly + lx * lx) if name == "radial" else F.abs(lx if p.get("axis", "x") == "x" else ly)  # noqa: E741
        one = 1 / (1 + F.pow(l / p.get("knee", 1000.0), F.lit(p.get("alpha", -3.0))))
        one = F.when(l == 0, 0.0 if p.get("alpha", -3.0) < 0 else 1.0).otherwise(one)
        out = out * (one if p.get("most") is None else F.when(l <= p["most"], one).otherwise(1.0))
    return out


def mean_model(samples: DataFrame, cell: list[str], model: str) -> DataFrame:
    """Mean of a model over the samples of each cell; cells without samples are absent, models of null count as 0."""
    return samples.groupBy(*cell).agg(F.avg(F.coalesce(F.col(model), F.lit(0.0))).alias("model"))


def pickup_of(samples: DataFrame, grid: DataFrame, cell: list[str], bin: list[str], weight: float = 1.0) -> DataFrame:
    """Prior against what looks like pickup: the map read at the samples, averaged per pickup bin and divided by its hits again,
    and summed back into cells; times weight."""
    seen = samples.join(grid.select(*cell, F.col("value").alias("_v")), cell)
    per = seen.groupBy(*bin).agg((F.sum("_v") / (F.count(F.lit(1)) * F.count(F.lit(1)))).alias("_p"))
    return seen.join(per, bin).groupBy(*cell).agg((weight * F.sum("_p")).alias("prior"))


def less_pickup(samples: DataFrame, grid: DataFrame, cell: list[str], bin: list[str], value: str) -> DataFrame:
    """A map less what of it looks like pickup: read at the samples, averaged per pickup bin, and that read back as the mean of each
    cell's samples. Cells without samples stay."""
    seen = samples.select(*cell, *bin).join(grid.select(*cell, F.col(value).alias("_v")), cell)
    per = seen.groupBy(*bin).agg(F.avg("_v").alias("_p"))
    back = seen.join(per, bin).groupBy(*cell).agg(F.avg("_p").alias("_p"))
    return grid.join(back, cell, "left").withColumn(value, F.col(value) - F.coalesce("_p", F.lit(0.0))).select(*grid.columns)


def edge_prior(distance: Column, white: Column, edge: float, at_edge: float = 10.0, in_core: float = 0.01) -> Column:
    """Strength of a prior that falls, in logarithms, from the rim of a masked place to its core."""
    u = F.least(distance / edge, F.lit(1.0))
    return F.exp(F.log(F.lit(at_edge)) * (1 - u) + F.log(F.lit(in_core)) * u) * white


def range_noise(samples: DataFrame, key: list[str], value: str, at: str, order: int = 2) -> DataFrame:
    """Variance per key after each range's mean (order 1) or line (order 2) is taken off: key without `range_id`, var, n."""
    per = samples.groupBy(*key, "range_id")
    fit = per.agg(F.avg(value).alias("_m"), F.avg(at).alias("_t"), F.coalesce(F.regr_slope(value, at), F.lit(0.0)).alias("_s"))
    slope = F.col("_s") if order > 1 else F.lit(0.0)
    rest = F.col(value) - F.col("_m") - slope * (F.col(at) - F.col("_t"))
    return samples.join(fit, [*key, "range_id"]).groupBy(*key).agg(F.avg(rest * rest).alias("var"), F.count(F.lit(1)).alias("n"))


def range_weighted(samples: DataFrame, key: list[str], value: str, at: str, ivar: str, order: int = 2) -> DataFrame:
    """The same rest of each sample, times its inverse variance."""
    w = W.partitionBy(*key, "range_id")
    slope = F.coalesce(F.regr_slope(value, at).over(w), F.lit(0.0)) if order > 1 else F.lit(0.0)
    return samples.withColumn(value, (F.col(value) - F.avg(value).over(w) - slope * (F.col(at) - F.avg(at).over(w))) * F.col(ivar))


def stamps(samples: DataFrame, sources: DataFrame, y: str, x: str, value: str, half: int) -> DataFrame:
    """Stamps around sources (id, y, x): mean value and hits by source and place in the stamp. Samples are summed by cell first, so
    that sources meet cells, not samples."""
    near = [F.floor(F.col(c) + 0.5).cast("int").alias(f"_{n}") for c, n in ((y, "y"), (x, "x"))]
    sums = samples.groupBy(*near).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    cells = F.explode(F.array(*[F.struct((F.col("_y") + i).alias("cy"), (F.col("_x") + j).alias("cx"), F.lit(-i).alias("dy"), F.lit(-j).alias("dx")) for i in range(-half, half + 1) for j in range(-half, half + 1)]))
    rows = sums.select("_s", "_m", "_n", cells.alias("_c")).select("_s", "_m", "_n", "_c.*")
    own = sources.select("id", F.floor(F.col("y") + 0.5).cast("int").alias("cy"), F.floor(F.col("x") + 0.5).cast("int").alias("cx"))
    return rows.join(own, ["cy", "cx"]).groupBy("id", "dy", "dx").agg(F.try_divide(F.sum("_s"), F.sum("_m")).alias("value"), F.sum("_n").alias("hits"))


def many_beams(samples: DataFrame, key: list[str], y: Column, x: Column, beams: list[tuple[float, float, float]], grid: DataFrame, value: str) -> DataFrame:
    """Sum over beams (dy, dx, response) of the map's nearest value where each beam looks, times its response."""
    every = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(c).alias("c")) for dy, dx, c in beams])
    rows = samples.withColumn("_b", F.explode(every))
    rows = rows.withColumns({"y": F.floor(y + F.col("_b.dy") + 0.5).cast("int"), "x": F.floor(x + F.col("_b.dx") + 0.5).cast("int")})
    got = rows.select(*key, "y", "x", F.col("_b.c").alias("_c")).join(grid.select("y", "x", F.col(value).alias("_g")), ["y", "x"], "left")
    return got.groupBy(*key).agg(F.sum(F.coalesce("_g", F.lit(0.0)) * F.col("_c")).alias("model"))


def source_response(samples: DataFrame, sources: DataFrame, key: str, x: str, y: str, sigma: float, reach: float = 4.0) -> DataFrame:
    """Summed beam response of all sources at each sample, for amplitudes that belong to samples: key, response. Places meet, each
    once, with the sources there counted."""
    rows = samples.select(key, F.col(x).alias("_x"), F.col(y).alias("_y"))
    own = catalogs.places(rows, key, "_x", "_y")
    at = catalogs.places(sources, "id", "x", "y", F.count(F.lit(1)).alias("_n"))
    near = catalogs.pairs(own.select(F.col("_place").alias("id"), F.col("_x").alias("x"), F.col("_y").alias("y")), at.select(F.col("_place").alias("id"), "x", "y"), "id", "x", "y", reach * sigma)
    near = near.join(at.select(F.col("_place").alias("other"), "_n"), "other")
    sums = own.join(near.groupBy(F.col("id").alias("_place")).agg(F.sum(F.col("_n") * catalogs.beam_at(F.col("dist"), sigma)).alias("_r")), "_place")
    return rows.join(sums.select("_x", "_y", "_r"), ["_x", "_y"]).groupBy(key).agg(F.sum("_r").alias("response"))


def smoothed(grid: DataFrame, value: str, sigma: float, reach: float = 4.0) -> DataFrame:
    """Gaussian mean of the cells around each cell, by their weights: along x, then along y. Cells that are missing have none."""
    n = int(reach * sigma)
    rows = grid.select("y", "x", F.col(value).alias("_v"), F.lit(1.0).alias("_w"))
    for c in ("x", "y"):
        other = "y" if c == "x" else "x"
        sent = rows.select("y", "x", "_v", "_w", F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("_d"))
        g = F.exp(-F.col("_d") * F.col("_d") / (2 * sigma * sigma))
        rows = sent.groupBy((F.col(c) + F.col("_d")).alias(c), other).agg(F.sum(F.col("_v") * g).alias("_v"), F.sum(F.col("_w") * g).alias("_w"))
    return rows.join(grid.select("y", "x"), ["y", "x"]).select("y", "x", (F.col("_v") / F.col("_w")).alias(value))


def reprojected(grid: DataFrame, value: str, shape: tuple[int, int], y: Column, x: Column) -> DataFrame:
    """A map of another shape whose cell (oy, ox) reads the grid linearly at (y, x), functions of oy and ox; outside is 0."""
    spark = grid.sparkSession
    out = spark.range(shape[0] * shape[1]).select(F.floor(F.col("id") / shape[1]).cast("int").alias("oy"), (F.col("id") % shape[1]).cast("int").alias("ox"))
    got = binning.gather(out.withColumns({"_fy": y, "_fx": x}), binning.bilinear(F.col("_fy"), F.col("_fx")), grid.select("y", "x", value), {value: F.lit(1.0)}, ["oy", "ox"])
    return got.select(F.col("oy").alias("y"), F.col("ox").alias("x"), F.col("model").alias(value))


def coadded(maps: list[tuple[DataFrame, float]], value: str, weight: str) -> DataFrame:
    """Maps of one sky seen with different responses: sum(g w v) / sum(g^2 w) per cell and that weight; (map, response g)."""
    rows = reduce(DataFrame.unionByName, [m.select("y", "x", F.col(value).alias("_v"), F.col(weight).alias("_w"), F.lit(g).alias("_g")) for m, g in maps])
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sums = rows.groupBy("y", "x").agg(F.sum(F.col("_g") * F.col("_w") * F.col("_v")).alias("_s"), F.sum(F.col("_g") * F.col("_g") * F.col("_w")).alias(weight))
    return sums.select("y", "x", F.coalesce(F.try_divide("_s", weight), F.lit(0.0)).alias(value), weight)


def shrunk(grid: DataFrame, value: str, weight: str, signal: Column) -> DataFrame:
    """The expectation of a signal of known variance given a map with inverse variance, cell by cell, and its deviation."""
    share = signal * F.col(weight) / (1 + signal * F.col(weight))
    return grid.withColumns({value: share * F.col(value), "dev": F.sqrt(signal / (1 + signal * F.col(weight)))})
