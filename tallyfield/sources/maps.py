"""Sets of maps as one Parquet store, boxes read over all of them, regions of a map, catalogues with nested fluxes.

A set holds maps of several datasets, each in splits of independent noise. Its cells lie in folders by dataset, split and band of
rows (`ty`), so a box reads only its bands. What is known of a dataset besides its cells is a row of the set's manifest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.fourier import Shape, filtered, taper
from ..operators.sequences import smooth_length
from .text import FormatError, read_boxes

#: Rows of a band.
BAND = 256
MANIFEST = "dataset string, gain double, freq double, beam double"
#: Planck's and Boltzmann's constants, the speed of light, and the temperature that maps are differences to (fixed values).
H, K, LIGHT, T_CMB = 6.62607015e-34, 1.380649e-23, 299792458.0, 2.72548


@dataclass(frozen=True)
class Grid:
    """A map of equal steps in longitude and latitude: cell (y, x) lies at lat0 + y * dlat, lon0 + x * dlon, in degrees."""

    shape: Shape
    lat0: float
    lon0: float
    dlat: float
    dlon: float

    @property
    def turn(self) -> int:
        """Cells of a whole turn."""
        return round(360 / abs(self.dlon))

    def row(self, lat: Column | float) -> Column | float:
        return (lat - self.lat0) / self.dlat

    def column(self, lon: Column | float) -> Column | float:
        return (lon - self.lon0) / self.dlon

    def box(self, lat1: float, lon1: float, lat2: float, lon2: float) -> tuple[int, int, int, int]:
        """(y1, x1, y2, x2) of a box in degrees, sorted."""
        ys, xs = sorted(round(self.row(v)) for v in (lat1, lat2)), sorted(round(self.column(v)) for v in (lon1, lon2))
        return ys[0], xs[0], ys[1], xs[1]


def write_maps(cells: DataFrame, manifest: DataFrame, path: str) -> None:
    """cells: dataset, split, y, x, value, ivar; manifest: a row a dataset (MANIFEST). Each band is written by one task."""
    rows = cells.withColumn("ty", F.floor(F.col("y") / BAND).cast("int"))
    rows.repartition("dataset", "split", "ty").write.mode("overwrite").partitionBy("dataset", "split", "ty").parquet(f"{path}/cells")
    manifest.select(*[c.split()[0] for c in MANIFEST.split(", ")]).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


@dataclass(frozen=True)
class Box:
    """What was read: cells (dataset, split, y, x, value, ivar; y and x count from the box's corner, cells of no weight are not
    there), the datasets with the manifest's columns and `n_good` splits, and the box's shape."""

    cells: DataFrame
    datasets: DataFrame
    shape: Shape
    corner: tuple[int, int]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_box(spark: SparkSession, path: str, box: tuple[int, int, int, int], turn: int | None = None, pad: int = 0, mask: DataFrame | None = None, unhit: float = 1e-7, prune: bool = True, least: int = 2, fast: bool = True) -> Box:
    """A box (y1, x1, y2, x2) of all maps of a set, in the units that the datasets' gains give.

    The box is padded, and grown at its end to lengths that transform fast; x wraps at `turn` cells. Values and weights that are not
    finite count as 0, weights under `unhit` too; mask: y, x, keep (0 to 1; cells that it lacks are kept) of the whole map. With
    prune, splits without weight and datasets with fewer than `least` splits that have some are left out; else datasets stay
    listed. A box outside all maps gives no cells.
    """
    y1, x1, y2, x2 = box[0] - pad, box[1] - pad, box[2] + pad, box[3] + pad
    ny, nx = (smooth_length(n, True) if fast else n for n in (y2 - y1, x2 - x1))
    if turn is not None and nx > turn:
        nx = turn
    manifest = read_manifest(spark, path)
    stored = spark.read.parquet(f"{path}/cells")
    across = F.col("x") - x1 if turn is None else F.pmod(F.col("x") - x1, F.lit(turn))
    rows = stored.where(F.col("ty").between(y1 // BAND, (y1 + ny - 1) // BAND) & F.col("y").between(y1, y1 + ny - 1) & (across >= 0) & (across < nx))
    rows = rows.join(F.broadcast(manifest), "dataset")  # a row a dataset
    finite = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c).otherwise(0.0)
    value, ivar = finite(F.col("value") * F.col("gain")), finite(F.col("ivar") / (F.col("gain") * F.col("gain")))
    ivar = F.when(ivar < unhit, 0.0).otherwise(ivar)
    if mask is not None:
        rows = rows.join(mask.select("y", "x", F.col("keep").cast("double").alias("_keep")), ["y", "x"], "left")
        value, ivar = (c * F.coalesce("_keep", F.lit(1.0)) for c in (value, ivar))
    rows = rows.select("dataset", F.col("split").cast("int").alias("split"), (F.col("y") - y1).cast("int").alias("y"), across.cast("int").alias("x"), value.alias("value"), ivar.alias("ivar")).where("ivar > 0")
    good = rows.select("dataset", "split").distinct().groupBy("dataset").agg(F.count(F.lit(1)).cast("int").alias("n_good"))
    datasets = manifest.join(good, "dataset", "left").withColumn("n_good", F.coalesce("n_good", F.lit(0)))
    if prune:
        datasets = datasets.where(F.col("n_good") >= least)
        rows = rows.join(F.broadcast(datasets.select("dataset")), "dataset", "left_semi")
    return Box(rows, datasets, (ny, nx), (y1, x1))


def flux_per_temperature(freq: Column) -> Column:
    """Change of surface brightness with temperature of a black body at T_CMB, in mJy a steradian per micro-kelvin; freq in GHz."""
    x = freq * (1e9 * H / (K * T_CMB))
    per_kelvin = 2 * K**3 * T_CMB**2 / (H**2 * LIGHT**2) * F.pow(x, 4) * F.exp(x) / F.pow(F.exp(x) - 1, 2)
    return per_kelvin * 1e26 * 1e3 / 1e6


def read_frequencies(spark: SparkSession, path: str, box: tuple[int, int, int, int], split: int = 0, unit: str = "flux", edge: int = 0, turn: int | None = None, mask: DataFrame | None = None, window: bool = True) -> Box:
    """One split of all datasets of a box, ready for a joint analysis: in flux or temperature (`uK`), tapered to the box's edge (values
    once, weights twice), and with the response of square cells taken out. Cells that aren't hit are 0."""
    if unit not in ("flux", "uK"):
        raise ValueError(f"unknown unit {unit}")
    got = read_box(spark, path, box, turn, mask=mask, prune=False)
    ny, nx = got.shape
    scale = flux_per_temperature(F.col("freq")) if unit == "flux" else F.lit(1.0)
    fall = lambda c, n: F.element_at(F.array(*[F.lit(float(v)) for v in taper(n, edge)[: (n + 1) // 2]]), (F.least(F.col(c), F.lit(n - 1) - F.col(c)) + 1).cast("int")) if edge else F.lit(1.0)
    rows = got.cells.where(F.col("split") == split).join(F.broadcast(got.datasets.select("dataset", scale.alias("_s"))), "dataset").withColumn("_a", fall("y", ny) * fall("x", nx))
    rows = rows.select("dataset", "split", "y", "x", (F.col("value") * F.col("_s") * F.col("_a")).alias("value"), (F.col("ivar") * F.col("_a") * F.col("_a") / (F.col("_s") * F.col("_s"))).alias("ivar"))
    if window:
        import numpy as np

        def undone(ly: object, lx: object) -> object:
            return 1 / (np.sinc(ly / (2 * np.pi)) * np.sinc(lx / (2 * np.pi)))

        parts = []
        for name in [r.dataset for r in got.datasets.select("dataset").orderBy("dataset").collect()]:  # a row a dataset
            own = rows.where(F.col("dataset") == name)
            sharp = filtered(own, "value", got.shape, undone)
            parts.append(sharp.join(own.select("dataset", "split", "y", "x", "ivar"), ["y", "x"], "left").select(F.lit(name).alias("dataset"), F.lit(split).alias("split"), "y", "x", "value", F.coalesce("ivar", F.lit(0.0)).alias("ivar")))
        for p in parts[1:]:
            parts[0] = parts[0].unionByName(p)
        rows = parts[0] if parts else rows
    return Box(rows, got.datasets, got.shape, got.corner)


# ---- regions


def regions(spark: SparkSession, spec: str, grid: Grid) -> DataFrame:
    """region, y1, x1, y2, x2 from `full`, `tile[:ny[:nx]]` (480 cells if no size is given), `box:lat1:lon1:lat2:lon2[:...]` in degrees, or
    the path of a file of boxes. The last tiles of a row or column reach beyond the map."""
    name, *args = spec.split(":")
    ny, nx = grid.shape
    if name == "full":
        return spark.createDataFrame([(0, 0, 0, ny, nx)], "region long, y1 int, x1 int, y2 int, x2 int")
    if name == "tile":
        ty = int(args[0]) if args else 480
        tx = int(args[1]) if len(args) > 1 else ty
        rows, across = -(-ny // ty), -(-nx // tx)
        y, x = F.floor(F.col("id") / across) * ty, F.col("id") % across * tx
        return spark.range(rows * across).select(F.col("id").alias("region"), *[c.cast("int").alias(n) for n, c in (("y1", y), ("x1", x), ("y2", y + ty), ("x2", x + tx))])
    if name == "box":
        if not args or len(args) % 4:
            raise FormatError(f"{spec}: four numbers a box")
        boxes = [grid.box(*map(float, args[k : k + 4])) for k in range(0, len(args), 4)]
        return spark.createDataFrame([(k, *b) for k, b in enumerate(boxes)], "region long, y1 int, x1 int, y2 int, x2 int")
    found = read_boxes(spark, spec)
    ya, yb, xa, xb = (F.round(f(F.col(c))).cast("int") for f, c in ((grid.row, "dec0"), (grid.row, "dec1"), (grid.column, "ra0"), (grid.column, "ra1")))
    return found.select((F.row_number().over(W.orderBy("dec0", "ra0", "dec1", "ra1")) - 1).cast("long").alias("region"), F.least(ya, yb).alias("y1"), F.least(xa, xb).alias("x1"), F.greatest(ya, yb).alias("y2"), F.greatest(xa, xb).alias("x2"))


def split_regions(found: DataFrame, size: int) -> DataFrame:
    """Regions cut evenly into h // size + 1 by w // size + 1 parts: region, part, y1, x1, y2, x2. For a region with one side under the
    size, the other is cut at a longer step, so that the step's area stays."""
    h, w = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    area = size * size
    sy = F.when((h >= size) & (w < size), F.floor(F.lit(area) / w)).otherwise(F.lit(size))
    sx = F.when(h < size, F.floor(F.lit(area) / h)).otherwise(F.lit(size))
    rows = found.where((h > 0) & (w > 0)).withColumns({"_ny": F.floor(h / sy) + 1, "_nx": F.floor(w / sx) + 1})
    rows = rows.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ny") * F.col("_nx") - 1)))
    i, j = F.floor(F.col("_p") / F.col("_nx")), F.col("_p") % F.col("_nx")
    at = lambda a, n, k, count: (F.col(a) + F.floor(n * k / F.col(count))).cast("int")
    return rows.select("region", F.col("_p").alias("part"), at("y1", h, i, "_ny").alias("y1"), at("x1", w, j, "_nx").alias("x1"), at("y1", h, i + 1, "_ny").alias("y2"), at("x1", w, j + 1, "_nx").alias("x2"))


# ---- catalogues


#: Columns of catalogues, by kind: found sources; sources in several frequencies; candidates; small bodies by day.
CATALOGUES = {
    "sources": "ra double, dec double, snr array<double>, amp array<double>, damp array<double>, flux array<double>, dflux array<double>, npix double, status int",
    "results": "ra double, dec double, snr double, flux_tot double, dflux_tot double, flux array<double>, dflux array<double>, case int, contam array<double>",
    "candidates": "sn double, type string, pos array<double>, pix array<double>, npix int, amps array<double>, damps array<double>",
    "bodies": "name string, mjd double, ra double, dec double, r double",
    "links": "src int, det int, range_id int",
}


def write_catalogue(rows: DataFrame, path: str, kind: str) -> None:
    """Rows of a kind with exactly its columns and types (missing ones null, others an error)."""
    if kind not in CATALOGUES:
        raise FormatError(f"unknown catalogue {kind}; there are {sorted(CATALOGUES)}")
    wanted = [c.split(" ", 1) for c in CATALOGUES[kind].split(", ")]
    if extra := set(rows.columns) - {n for n, _ in wanted}:
        raise FormatError(f"{kind} has no columns {sorted(extra)}")
    rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted]).write.mode("overwrite").parquet(path)


def read_catalogue(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """One or several catalogues of a kind as one."""
    if kind not in CATALOGUES:
        raise FormatError(f"unknown catalogue {kind}; there are {sorted(CATALOGUES)}")
    return spark.read.schema(CATALOGUES[kind]).parquet(*([path] if isinstance(path, str) else path))


# ---- maps by scanning pattern


def write_phase_maps(patterns: DataFrame, cells: DataFrame, path: str) -> None:
    """patterns: pattern, el, az1, az2; cells: pattern, det, bin, value. Maps lie in a folder by pattern."""
    patterns.select("pattern", "el", "az1", "az2").coalesce(1).write.mode("overwrite").parquet(f"{path}/patterns")
    cells.select("pattern", "det", "bin", "value").repartition("pattern").write.mode("overwrite").partitionBy("pattern").parquet(f"{path}/cells")


def read_phase_maps(spark: SparkSession, path: str, el: tuple[float, float] | None = None, det: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(patterns, cells), of patterns within a range of elevations and of some detectors if given; azimuths are brought to within half
    a turn of 0, both ends together."""
    patterns = spark.read.parquet(f"{path}/patterns")
    turns = F.round((F.col("az1") + F.col("az2")) / 2 / 360) * 360
    patterns = patterns.select("pattern", "el", (F.col("az1") - turns).alias("az1"), (F.col("az2") - turns).alias("az2"))
    cells = spark.read.parquet(f"{path}/cells")
    if el is not None:
        patterns = patterns.where(F.col("el").between(*el))
        cells = cells.join(F.broadcast(patterns.select("pattern")), "pattern", "left_semi")  # a row a pattern
    return patterns, cells if det is None else cells.where(F.col("det").isin(det))
