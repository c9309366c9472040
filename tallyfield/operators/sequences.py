"""Functions of ordered samples: direction, periods, sessions, phases, resampling, as-of lookups.

All windows are partitioned by key. An as-of lookup of a table beside samples is a union and a running last value, so it
needs one shuffle and no range join.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import cut


def ordered(key: list[str], at: str) -> W:
    return W.partitionBy(*key).orderBy(at)


def direction(value: str, key: list[str], at: str) -> Column:
    """1 where the value doesn't fall from the sample before, else 2; the first is 1."""
    return F.when(F.col(value) < F.lag(value).over(ordered(key, at)), 2).otherwise(1)


def direction_ahead(value: str, key: list[str], at: str, step: int = 3) -> Column:
    """Does the value rise over the next `step` samples? The last samples repeat the last answer."""
    w = ordered(key, at)
    ahead = F.when(F.lead(value, step).over(w).isNotNull(), F.lead(value, step).over(w) > F.col(value))
    return F.coalesce(F.last(ahead, True).over(w), F.lit(False))


def up_crossings(samples: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Samples that rise through the middle of the key's range of values."""
    whole = W.partitionBy(*key)
    middle = (F.min(value).over(whole) + F.max(value).over(whole)) / 2
    rows = samples.withColumn("_m", middle)
    before = F.lag(value).over(ordered(key, at))
    return rows.withColumn("_b", before).where((F.col("_b") < F.col("_m")) & (F.col(value) >= F.col("_m"))).drop("_m", "_b")


def period(samples: DataFrame, key: list[str], at: str, value: str, shortest: int = 1) -> DataFrame:
    """Median distance of up-crossings; distances under `shortest` don't count."""
    ups = up_crossings(samples, key, at, value)
    gap = F.col(at) - F.lag(at).over(ordered(key, at))
    return ups.withColumn("_g", gap).where(F.col("_g") >= shortest).groupBy(*key).agg(F.median("_g").alias("period"), F.count(F.lit(1)).alias("n_gaps"))


def sessions(rows: DataFrame, key: list[str], start: str, end: str, gap: float, same: list[tuple[str, float]] = []) -> DataFrame:  # noqa: B006
    """Groups in order of start; a new one begins after a gap or where a column of `same` differs by more than its tolerance."""
    w = W.partitionBy(*key).orderBy(start, end)
    new = (F.col(start) - F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))) > gap
    for column, tolerance in same:
        new = new | (F.abs(F.col(column) - F.lag(column).over(w)) > tolerance)
    rows = rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*key, "session").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n"))


def period_gaps(periods: DataFrame, key: list[str], gap: float) -> DataFrame:
    """Times between periods (start, end) that nothing covers for longer than gap."""
    w = W.partitionBy(*key).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    rows = periods.withColumn("_last", F.max("end").over(w))
    return rows.where(F.col("start") - F.col("_last") > gap).select(*key, F.col("_last").alias("gap_start"), F.col("start").alias("gap_end"))


def groups_by_start(rows: DataFrame, key: list[str], start: str, tolerance: float, same_size: bool = True) -> DataFrame:
    """Rows whose starts agree within tolerance get a group; with same_size, only groups of the commonest largest size stay."""
    w = W.partitionBy(*key).orderBy(start)
    rows = rows.withColumn("_new", F.coalesce((F.col(start) - F.lag(start).over(w) > tolerance).cast("int"), F.lit(1)))
    rows = rows.withColumn("grp", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    if not same_size:
        return rows
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*key, "grp")))
    return rows.withColumn("_most", F.max("_n").over(W.partitionBy(*key))).where("_n = _most").drop("_n", "_most")


def running_median(value: Column, window: W) -> Column:
    """Median over a row frame, which has to be short: its values are sorted at each row."""
    v = F.sort_array(F.collect_list(value).over(window))
    n = F.size(v)
    return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2


def phase(samples: DataFrame, key: list[str], at: str, value: str, smooth: int = 3) -> DataFrame:
    """Value scaled to 0..1, falling halves as 2 - p, then a median over 2 * smooth + 1 samples (shorter at the ends)."""
    whole = W.partitionBy(*key)
    low, high = F.min(value).over(whole), F.max(value).over(whole)
    rows = samples.withColumn("_p", F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0)))
    rows = rows.withColumn("_p", F.when(direction(value, key, at) == 2, 2 - F.col("_p")).otherwise(F.col("_p")))
    return rows.withColumn("phase", running_median(F.col("_p"), ordered(key, at).rowsBetween(-smooth, smooth))).drop("_p")


def unwrap(samples: DataFrame, key: list[str], at: str, value: str, period_: float) -> DataFrame:
    """Adds whole periods so that no step is longer than half of one."""
    step = F.coalesce(F.round((F.col(value) - F.lag(value).over(ordered(key, at))) / period_), F.lit(0.0))
    rows = samples.withColumn("_s", step)
    turns = F.sum("_s").over(ordered(key, at).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("unwrapped", F.col(value) - turns * period_).drop("_s")


def sample_rate(samples: DataFrame, key: list[str], at: str, seconds: str) -> DataFrame:
    """1 / median step."""
    step = F.col(seconds) - F.lag(seconds).over(ordered(key, at))
    return samples.withColumn("_d", step).groupBy(*key).agg(F.try_divide(F.lit(1.0), F.median("_d")).alias("srate"))


def taper(key: list[str], at: str, width: int) -> Column:
    """Cosine weights over `width` samples at both ends of a key."""
    k, n = F.row_number().over(ordered(key, at)) - 1, F.count(F.lit(1)).over(W.partitionBy(*key))
    edge = F.least(k, n - 1 - k)
    return F.when(edge < width, 0.5 - 0.5 * F.cos(F.pi() * (edge + 1) / (width + 1))).otherwise(1.0)


def feather(n: int, k: Column, width: int) -> Column:
    """Linear weights over `width` positions at both ends of 0..n-1."""
    return F.least(F.lit(1.0), (k + 1) / (width + 1), (F.lit(n) - k) / (width + 1))


def tent(k: Column, n: int) -> Column:
    """Weights that fall from the middle to the ends."""
    return 1 - F.abs(2 * (k + 0.5) / n - 1)


def hold(points: DataFrame, every: DataFrame, key: list[str], at: str, value: str, start: object = 0) -> DataFrame:
    """The last value at or before each position of `every`; `start` before the first."""
    a = points.select(*key, F.col(at), F.lit(0).alias("_side"), F.col(value))
    b = every.select(*key, F.col(at), F.lit(1).alias("_side"), F.lit(None).cast(dict(points.dtypes)[value]).alias(value))
    w = W.partitionBy(*key).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.coalesce(F.last(value, True).over(w), F.lit(start))).where("_side = 1").drop("_side")


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, take: list[str], key: list[str] = [], clamp: bool = False, bucket: str | None = None) -> DataFrame:  # noqa: B006
    """left with the columns `take` of the last right row at or before its time; clamp: the first row serves earlier times.

    Without a key the union would meet in one task. Then `bucket` (an expression of `_t`, such as the month) splits time:
    each bucket is opened with the last row of the buckets before it, of which there is one per bucket.
    """
    cols = left.columns
    payload = F.struct(*[F.col(c) for c in take]).alias("_r")
    a = right.select(*key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), payload)
    b = left.select(*[F.col(k) for k in key], F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*cols).alias("_l"))
    part = list(key)
    if bucket:
        a, b = a.withColumn("_b", F.expr(bucket)), b.withColumn("_b", F.expr(bucket))
        tops = a.groupBy(*key, "_b").agg(F.max_by("_r", "_t").alias("_r"), F.max("_t").alias("_t"))
        slots = b.select(*key, "_b").distinct().unionByName(tops.select(*key, "_b")).distinct()
        w = W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1) if key else W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        carried = slots.join(tops, [*key, "_b"], "left").withColumn("_r", F.last("_r", True).over(w)).where("_r IS NOT NULL")
        opened = carried.select(*key, F.lit(None).cast(dict(a.dtypes)["_t"]).alias("_t"), F.lit(-1).alias("_side"), "_r", "_b")  # null times sort first
        a = a.unionByName(opened)
        part.append("_b")
    both = a.unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(*part).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_m", F.last("_r", True).over(w))
    if clamp:
        least = right.agg(F.min_by(F.struct(*take), right_time).alias("_first"))
        both = both.join(F.broadcast(least)).withColumn("_m", F.coalesce("_m", "_first"))
    return both.where("_side = 1").select("_l.*", *[F.col("_m")[c].alias(c) for c in take])


def interpolate(queries: DataFrame, table: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Linear interpolation of y(x) at the queries' x, from the table rows before and after; null outside."""
    a = table.select(*key, F.col(x), F.lit(0).alias("_side"), F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("_p"))
    b = queries.select(*key, F.col(x), F.lit(1).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    back = W.partitionBy(*key).orderBy(x, "_side").rowsBetween(W.unboundedPreceding, 0)
    fore = W.partitionBy(*key).orderBy(F.col(x), F.col("_side").desc()).rowsBetween(0, W.unboundedFollowing)
    both = both.withColumn("_0", F.last("_p", True).over(back)).withColumn("_1", F.first("_p", True).over(fore)).where("_side = 1")
    share = F.coalesce(F.try_divide(F.col(x) - F.col("_0.x"), F.col("_1.x") - F.col("_0.x")), F.lit(0.0))
    return both.select(*key, x, (F.col("_0.y") + share * (F.col("_1.y") - F.col("_0.y"))).alias(y))


def downsample(samples: DataFrame, key: list[str], at: str, value: str, step: int) -> DataFrame:
    """Means of `step` consecutive samples."""
    return samples.groupBy(*key, F.floor(F.col(at) / step).cast("int").alias(at)).agg(F.avg(value).alias(value))


def subsamples(samples: DataFrame, key: list[str], t: str, dt: float) -> DataFrame:
    """Place of each time on a coarse grid from the key's first time: index and fraction."""
    first = F.min(t).over(W.partitionBy(*key))
    place = (F.col(t) - first) / dt
    return samples.withColumn("sub", F.floor(place).cast("long")).withColumn("frac", place - F.floor(place))


def density_marks(samples: DataFrame, key: list[str], at: str, density: str) -> DataFrame:
    """Marks samples where the running sum of a density passes a whole number."""
    run = F.floor(F.sum(density).over(ordered(key, at).rowsBetween(W.unboundedPreceding, 0)))
    rows = samples.withColumn("_c", run)
    return rows.withColumn("mark", F.col("_c") > F.coalesce(F.lag("_c").over(ordered(key, at)), F.lit(0))).drop("_c")


def white_noise(samples: DataFrame, key: list[str], at: str, value: str, chunk: int) -> DataFrame:
    """Median over chunks of mean(step^2) / 2; steps don't cross chunks."""
    rows = samples.withColumn("_k", F.floor(F.col(at) / chunk))
    step = F.col(value) - F.lag(value).over(W.partitionBy(*key, "_k").orderBy(at))
    per = rows.withColumn("_d", step * step / 2).groupBy(*key, "_k").agg(F.avg("_d").alias("_v"))
    return per.groupBy(*key).agg(F.median("_v").alias("variance"))


def smooth_length(n: int, above: bool) -> int:
    """The nearest number from n on (or down) whose prime factors are 2, 3, 5 and 7: a length that transforms fast."""
    while n > 1:
        rest = n
        for p in (2, 3, 5, 7):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1 if above else -1
    return max(n, 1)


def angle_uniform(samples: DataFrame, key: list[str], at: str, angle: str, quantile: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resampling of series to even steps of a turning angle (radians), and back.

    Returns (shape, forward, inverse): shape holds per key nper (samples a turn), nrev (whole turns), n_in, n_out and rate (samples
    out per sample in); forward the place among the input samples of each output sample (out, place); inverse the place among the
    output samples of each input sample (at, place; null beyond the last whole turn). Both are linear between
    samples, by ordered merges of two sets of knots per key. A turn has at least as many samples as at the `quantile` slowest
    speed, and turns and samples a turn are lengths that transform fast. Angles may run either way; keys without a whole turn
    are left out; places are counted from 0 whatever `at` starts with.
    """
    turn = 2 * math.pi
    rows = unwrap(samples.where(F.col(angle).isNotNull()).select(*key, at, angle), key, at, angle, turn)
    rows = rows.withColumns({"_k": (F.row_number().over(ordered(key, at)) - 1).cast("double"), "_a": F.abs(F.col("unwrapped") - F.first("unwrapped").over(ordered(key, at)))})
    rows = rows.withColumn("_step", F.col("_a") - F.lag("_a").over(ordered(key, at)))
    shape = rows.groupBy(*key).agg(F.max("_a").alias("_all"), F.percentile("_step", quantile).alias("_speed"), F.count(F.lit(1)).alias("n_in"))
    shape = shape.where((F.col("_all") >= turn) & (F.col("_speed") > 0))
    lengths = shape.select(*key, "n_in", F.floor(F.col("_all") / turn).cast("long").alias("_rev"), F.round(turn / F.col("_speed")).cast("long").alias("_per"))

    @F.pandas_udf("nrev long, nper long")
    def fast(rev: pd.Series, per: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"nrev": [smooth_length(n, False) for n in rev], "nper": [smooth_length(n, True) for n in per]})

    shape = lengths.withColumn("_f", fast("_rev", "_per")).select(*key, "n_in", F.col("_f.nrev").alias("nrev"), F.col("_f.nper").alias("nper"))
    shape = cut(shape.withColumn("n_out", F.col("nrev") * F.col("nper")))
    wanted = shape.select(*key, "nper", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_out") - 1)).alias("out"))
    wanted = wanted.select(*key, "out", (F.col("out") * turn / F.col("nper")).alias("_a"))
    knots = rows.select(*key, "_a", F.col("_k").alias("place"))
    forward = interpolate(wanted.select(*key, "_a"), knots, key, "_a", "place").join(wanted, [*key, "_a"]).select(*key, "out", "place")
    forward = cut(forward)
    ends = forward.groupBy(*key).agg(F.max("place").alias("_last"), F.count(F.lit(1)).alias("_n"))
    rate = ends.select(*key, ((F.col("_n") - 1) / F.col("_last")).alias("rate"))
    back = interpolate(rows.join(shape.select(*key), key).select(*key, F.col("_k").alias("place")), forward.select(*key, "place", F.col("out").cast("double").alias("out")), key, "place", "out")
    inverse = back.join(rows.select(*key, at, F.col("_k").alias("place")), [*key, "place"]).select(*key, at, F.col("out").alias("place"))
    return shape.join(rate, key), forward, inverse
