"""Bright sources solved apart from the rest, and correlated noise predicted from around them.

Samples near sources are cut, filled by what the samples around them say, and mapped as the sky without sources; what filling took
away belongs to the sources alone, has no correlated noise left, and is mapped with white weights over the cut samples
only. The sum of both maps is the sky, and steep sources can't leak into the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from . import gapfill, intervals
from . import noisemodels as nm


def near_sources(samples: DataFrame, sources: DataFrame, y: str, x: str, radius: float, key: list[str], at: str) -> DataFrame:
    """Ranges (key, lo, hi) of the samples within radius of any source (y, x); joined by cells of the radius' size."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    wide = sources.select(F.col("y").alias("_sy"), F.col("x").alias("_sx"), cell("y").alias("_cy"), cell("x").alias("_cx"), around.alias("_d"))
    wide = wide.select("_sy", "_sx", (F.col("_cy") + F.col("_d.i")).alias("_cy"), (F.col("_cx") + F.col("_d.j")).alias("_cx"))
    dy, dx = F.col(y) - F.col("_sy"), F.col(x) - F.col("_sx")
    met = samples.select(*key, at, y, x, cell(y).alias("_cy"), cell(x).alias("_cx")).join(wide, ["_cy", "_cx"]).where(dy * dy + dx * dx <= radius * radius)
    hit = met.select(*key, at).distinct()
    return intervals.from_mask(samples.select(*key, at).join(hit.withColumn("_hit", F.lit(True)), [*key, at], "left"), key, at, F.coalesce("_hit", F.lit(False)))


def parted(samples: DataFrame, ranges: DataFrame, key: list[str], at: str, value: str, inpaint: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """samples with `masked`, value without sources (filled where masked) and `source`, what filling took away (0 elsewhere).
    inpaint(samples, ranges) fills; linear filling if none is given."""
    rows = cut(samples)
    filled = (inpaint or (lambda s, r: gapfill.linear(s, r, key, at, value)))(rows, ranges).select(*key, at, F.col(value).alias("_filled"))
    marked = gapfill.marked(rows, ranges, key, at).select(*rows.columns, F.col("cut").alias("masked"))
    both = marked.join(filled, [*key, at])
    source = F.when(F.col("masked"), F.col(value) - F.col("_filled")).otherwise(0.0)
    return both.withColumns({"source": source, value: F.when(F.col("masked"), F.col("_filled")).otherwise(F.col(value))}).drop("_filled")


def two_maps(parts: DataFrame, cell: list[str], value: str, weight: Column, solve: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """cell, rest, sources, sky: the map without sources (solve turns samples into cell, value; weighted means if none is given), the
    sources' own map over masked samples (0 where there are none), and their sum."""
    rows = cut(parts.withColumn("_w", weight))
    rest = solve(rows) if solve else rows.groupBy(*cell).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("value"))
    own = rows.where("masked").groupBy(*cell).agg((F.sum(F.col("_w") * F.col("source")) / F.sum("_w")).alias("sources"))
    out = rest.select(*cell, F.col("value").alias("rest")).join(own, cell, "left").withColumn("sources", F.coalesce("sources", F.lit(0.0)))
    return out.withColumn("sky", F.col("rest") + F.col("sources"))


def noise_predicted(samples: DataFrame, ranges: DataFrame, group: str, det: str, at: str, value: str, knee: float, power: float, rate: float = 1.0, threshold: float = 4.0) -> DataFrame:
    """samples less what the joint modes of the samples outside ranges say of all of them, smoothed: frequencies are weighted by
    1 / (1 + (f / knee)^power). For signals that lie almost wholly in the ranges."""
    model = gapfill.eigenmodes(samples.select(group, det, at, value), ranges, group, det, at, value, threshold)
    rows = nm.frequencies(model, group, det, at, value)
    low = 1 / (1 + F.pow(F.col("k") * rate / F.col("n") / knee, F.lit(power)))
    smooth = nm.series(rows.withColumns({c: F.col(c) * low for c in ("re", "im")}), group, det, at, "_model")
    return samples.join(smooth, [group, det, at]).withColumn(value, F.col(value) - F.col("_model")).select(*samples.columns)
