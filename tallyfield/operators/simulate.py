"""Synthetic observations: sources, noise, scans, layouts. Random numbers are hashes of (seed, row), so they don't depend on partitions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogs, fourier

_STEPS = 1 << 52


def uniform(seed: int, *key: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(_STEPS)) + 0.5) / float(_STEPS)


def normal(seed: int, *key: Column) -> Column:
    """Standard normal from two uniforms."""
    return F.sqrt(-2 * F.ln(uniform(seed, *key))) * F.cos(2 * math.pi * uniform(seed + 7919, *key))


def sources(spark: SparkSession, box: tuple[float, float, float, float], n: int, amp: float, seed: int = 0) -> DataFrame:
    rows = spark.range(n)
    x = box[0] + (box[1] - box[0]) * uniform(seed, F.col("id"))
    y = box[2] + (box[3] - box[2]) * uniform(seed + 1, F.col("id"))
    return rows.select("id", x.alias("x"), y.alias("y"), (-amp * F.ln(uniform(seed + 2, F.col("id")))).alias("amp"))


def back_and_forth(spark: SparkSession, n: int, low: float, high: float, per_sample: float, t0: float = 0.0, rate: float = 100.0) -> DataFrame:
    """A triangle wave between two azimuths."""
    width = high - low
    p = F.pmod(F.col("id") * per_sample, F.lit(2 * width))
    return spark.range(n).select(F.col("id").cast("int").alias("sample"), (t0 + F.col("id") / rate).alias("t"), (low + F.when(p <= width, p).otherwise(2 * width - p)).alias("az"))


def raster(spark: SparkSession, box: tuple[float, float, float, float], res: float, by_column: bool = False) -> DataFrame:
    """All grid points, line by line."""
    nx, ny = math.ceil((box[1] - box[0]) / res), math.ceil((box[3] - box[2]) / res)
    k = F.col("id")
    i, j = (k % ny, F.floor(k / ny)) if by_column else (F.floor(k / nx), k % nx)
    return spark.range(nx * ny).select(k.alias("sample"), (box[0] + (j + 0.5) * res).alias("x"), (box[2] + (i + 0.5) * res).alias("y"))


def layout(spark: SparkSession, n: int, per: int, radius: float, seed: int | None = None, step: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """`n` places with `per` detectors each: scattered in a disk (with a seed) or along a line; components T, Q, U by angle."""
    d = F.col("id")
    place = F.floor(d / per)
    if seed is None:
        u = (place / max(n - 1, 1) - 0.5) * 2 * radius
        x, y = u * step[0], u * step[1]
    else:
        r, a = radius * F.sqrt(uniform(seed, place)), 2 * math.pi * uniform(seed + 1, place)
        x, y = r * F.cos(a), r * F.sin(a)
    angle = math.pi * (d % per) / per
    return spark.range(n * per).select(d.alias("det"), x.alias("off_x"), y.alias("off_y"), F.lit(1.0).alias("c0"), F.cos(2 * angle).alias("c1"), F.sin(2 * angle).alias("c2"))


def noise(samples: DataFrame, key: list[str], sigma: float, seed: int) -> DataFrame:
    return samples.withColumn("value", sigma * normal(seed, *[F.col(k) for k in key]))


def pink_weight(f: Column, sigma: float, knee: float = 0.2, alpha: float = 1.0) -> Column:
    """Power spectrum sigma^2 (1 + (knee / f)^alpha); the constant mode has none."""
    return F.when(f <= 0, 0.0).otherwise(sigma * sigma * (1 + F.pow(knee / f, F.lit(alpha))))


def add_sources(samples: DataFrame, cat: DataFrame, key: str, x: str, y: str, sigma: float, reach: float = 4.0) -> DataFrame:
    """Adds Gaussian sources within `reach` widths: a radius join and a sum."""
    near = catalogs.pairs(samples.select(F.col(key).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")), cat.select("id", "x", "y"), "id", "x", "y", reach * sigma)
    model = near.join(cat.select(F.col("id").alias("other"), "amp"), "other").groupBy(F.col("id").alias(key)).agg(F.sum(F.col("amp") * catalogs.beam_at(F.col("dist"), sigma)).alias("_m"))
    return samples.join(model, key, "left").withColumn("value", F.col("value") + F.coalesce("_m", F.lit(0.0))).drop("_m")


def render(cat: DataFrame, shape: tuple[int, int], sigma: float, reach: float = 4.0) -> DataFrame:
    """Sources as a grid: each puts out its stamp of cells, and cells are summed."""
    n = math.ceil(reach * sigma)
    offsets = F.sequence(F.lit(-n), F.lit(n))
    rows = cat.select("x", "y", "amp", F.explode(offsets).alias("_dy")).select("*", F.explode(offsets).alias("_dx"))
    rows = rows.withColumns({"iy": (F.floor(F.col("y") + 0.5) + F.col("_dy")).cast("int"), "ix": (F.floor(F.col("x") + 0.5) + F.col("_dx")).cast("int")})
    rows = rows.where((F.col("iy") >= 0) & (F.col("iy") < shape[0]) & (F.col("ix") >= 0) & (F.col("ix") < shape[1]))
    d = F.sqrt((F.col("iy") - F.col("y")) ** 2 + (F.col("ix") - F.col("x")) ** 2)
    return rows.groupBy(F.col("iy").alias("y"), F.col("ix").alias("x")).agg(F.sum(F.col("amp") * catalogs.beam_at(d, sigma)).alias("value"))


def images(cat: DataFrame, n: int, distance: float, least: float) -> DataFrame:
    """Bright sources surrounded by a ring of sources without amplitude."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ring = cat.where(F.col("amp") >= least).withColumn("_k", k)
    a = 2 * math.pi * F.col("_k") / n
    ring = ring.select("id", (F.col("x") + distance * F.cos(a)).alias("x"), (F.col("y") + distance * F.sin(a)).alias("y"), F.lit(0.0).alias("amp"), (F.col("_k") + 1).alias("image"))
    return cat.select("id", "x", "y", "amp", F.lit(0).alias("image")).unionByName(ring)


def field(spark: SparkSession, shape: tuple[int, int], spectrum: Callable, seed: int = 0, pixel: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """y, x, value: a normal random field whose power per frequency, as fourier.tile_spectra counts it, is spectrum(ly, lx)."""
    k = F.col("id")
    cells = spark.range(shape[0] * shape[1]).select(F.floor(k / shape[1]).cast("int").alias("y"), (k % shape[1]).cast("int").alias("x"), normal(seed, k).alias("value"))
    return fourier.filtered(cells, "value", shape, lambda ly, lx: spectrum(ly, lx) ** 0.5, pixel)


def noise_field(cells: DataFrame, weight: str, shape: tuple[int, int], knee: float, slope: float = -2.0, seed: int = 0, pixel: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """y, x, value: noise that rises below a knee, without a mean, at the depth that each cell's inverse variance gives."""

    def power(ly: object, lx: object) -> object:
        l = fourier.radius(ly, lx)  # noqa: E741
        return (l > 0) * (1 + ((l + (l == 0)) / knee) ** slope)

    made = field(cells.sparkSession, shape, power, seed, pixel)
    return made.join(cells.where(F.col(weight) > 0).select("y", "x", F.col(weight).alias("_w")), ["y", "x"]).select("y", "x", (F.col("value") / F.sqrt("_w")).alias("value"))
