"""Noise models of scans applied in frequencies, detector rows spread over tasks.

Series (group, det, at, value) become rows (group, det, k, re, im), one for each detector and frequency: a task transforms one
detector's series at a time. All series of a group are as long as the group, missing samples are 0. In these rows a noise model is
relational: what a detector has of its own is a column, what detectors share at a frequency is a sum over the rows of that
frequency. So no task holds a group's detectors by samples. Frequencies are in units of the sample rate unless one is given.

A model's inverse is applied as is; covariances are per frequency bin, diag(d) + V diag(e) V', where bins may share the vectors V.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from . import lowrank


def frequencies(df: DataFrame, group: str, det: str, at: str, value: str) -> DataFrame:
    """group, det, n (samples of the group), low (its first place), k, re, im."""
    kinds = dict(df.dtypes)
    held = df.where(F.col(value).isNotNull()).select(group, det, F.col(at).cast("long").alias("_at"), F.col(value).cast("double").alias("_v"))
    sizes = held.groupBy(group).agg(F.min("_at").alias("low"), (F.max("_at") - F.min("_at") + 1).alias("n"))
    lines = held.groupBy(group, det).agg(F.collect_list("_at").alias("_ats"), F.collect_list("_v").alias("_vs")).join(sizes, group)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g, d, ats, values, low, n in frame.itertuples(index=False):
                line = np.zeros(n)
                np.add.at(line, np.asarray(ats) - low, values)
                f = np.fft.rfft(line)
                yield pd.DataFrame({group: g, det: d, "n": n, "low": low, "k": np.arange(len(f)), "re": f.real, "im": f.imag})

    return lines.select(group, det, "_ats", "_vs", "low", "n").mapInPandas(run, f"{group} {kinds[group]}, {det} {kinds[det]}, n long, low long, k long, re double, im double")


def series(rows: DataFrame, group: str, det: str, at: str, value: str) -> DataFrame:
    """The way back: group, det, at, value at all places of the group."""
    kinds = dict(rows.dtypes)
    lines = rows.groupBy(group, det).agg(F.first("n").alias("n"), F.first("low").alias("low"), F.collect_list("k").alias("ks"), F.collect_list("re").alias("re"), F.collect_list("im").alias("im"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g, d, n, low, ks, re, im in frame.itertuples(index=False):
                f = np.zeros(n // 2 + 1, complex)
                f[np.asarray(ks)] = np.asarray(re) + 1j * np.asarray(im)
                yield pd.DataFrame({group: g, det: d, at: np.arange(low, low + n), value: np.fft.irfft(f, n)})

    return lines.select(group, det, "n", "low", "ks", "re", "im").mapInPandas(run, f"{group} {kinds[group]}, {det} {kinds[det]}, {at} long, {value} double")


def _over(df: DataFrame, group: str, det: str, at: str, value: str, apply: Callable[[DataFrame], DataFrame], window: int = 0) -> DataFrame:
    """df with value replaced by what apply makes of its frequencies; tapered before and after by a window."""
    kept = df.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    fall = F.lit(1.0)
    if window:
        ends = kept.groupBy(group).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
        kept = kept.join(ends, group)
        edge = F.least(F.col(at) - F.col("_a"), F.col("_b") - F.col(at))
        fall = F.when(edge < window, 0.5 - 0.5 * F.cos(np.pi * (edge + 1) / (window + 1))).otherwise(1.0)
    kept = kept.withColumn("_w", fall)
    made = series(apply(frequencies(kept.withColumn(value, F.col(value) * F.col("_w")), group, det, at, value)), group, det, at, "_new")
    return kept.join(made, [group, det, at]).select(*[F.col(c) if c != value else (F.col("_new") * F.col("_w")).alias(value) for c in df.columns])


def null(df: DataFrame) -> DataFrame:
    """No noise model: everything stays."""
    return df


def common(df: DataFrame, group: str, det: str, at: str, value: str, sigma: str, rate: float = 1.0, knee: float = 3.0, slope: float = -3.0, common_knee: float = 0.5, common_slope: float = -4.0, covariance: bool = False) -> DataFrame:
    """The inverse (or, with covariance, the matrix itself) of N_ab = sigma_a sigma_b ((1 + (f / knee)^slope) delta_ab + (f / common_knee)^common_slope): white noise per
    detector (column sigma), its own rise, and a rise that all detectors of a group share. f = 0 counts as half the first frequency.

    By the rank-one inverse, a frequency needs one sum over its detectors.
    """

    def apply(rows: DataFrame) -> DataFrame:
        white = df.groupBy(group, det).agg(F.max(sigma).cast("double").alias("_s"))
        f = F.greatest(F.col("k").cast("double"), F.lit(0.5)) * rate / F.col("n")
        own = 1 / (1 + F.pow(f / knee, F.lit(slope)))
        if covariance:
            rows = rows.join(white, [group, det]).withColumns({"_own": own, "_c": F.pow(f / common_knee, F.lit(common_slope))})
            rows = cut(rows.withColumns({c: F.col(c) * F.col("_s") for c in ("re", "im")}))
            both = rows.join(rows.groupBy(group, "k").agg(F.sum("re").alias("_re"), F.sum("im").alias("_im")), [group, "k"])
            return both.withColumns({c: (F.col(c) / F.col("_own") + F.col("_c") * F.col(f"_{c}")) * F.col("_s") for c in ("re", "im")}).select(*rows.columns)
        rows = rows.join(white, [group, det]).withColumns({"_own": own, "_c": F.pow(f / common_knee, F.lit(-common_slope))})
        rows = cut(rows.withColumns({c: F.col(c) / F.col("_s") * F.col("_own") for c in ("re", "im")}))
        # The weights of the shared mode are 1 in units of sigma, and its covariance's inverse is 1 / c.
        sums = rows.groupBy(group, "k").agg(F.sum("re").alias("_re"), F.sum("im").alias("_im"), F.sum("_own").alias("_n"))
        both = rows.join(sums, [group, "k"])
        return both.withColumns({c: (F.col(c) - F.col("_own") * F.col(f"_{c}") / (F.col("_c") + F.col("_n"))) / F.col("_s") for c in ("re", "im")}).select(*rows.columns)

    return _over(df, group, det, at, value, apply)


def binned(rows: DataFrame, edges: DataFrame, group: str, rate: float = 1.0) -> DataFrame:
    """Frequency rows with the number `bin` of their bin; edges: group and the ascending lower ends of bins, `edges`; a row below the first
    has bin 0 too."""
    f = F.col("k") * rate / F.col("n")
    return rows.join(edges, group).withColumn("bin", F.greatest(F.size(F.filter("edges", lambda e: e <= f)) - 1, F.lit(0))).drop("edges")


def low_rank(rows: DataFrame, diag: DataFrame, modes: DataFrame, strengths: DataFrame, group: str, det: str, sets: DataFrame | None = None) -> DataFrame:
    """Frequency rows (with bin) times the inverse of diag(d) + V diag(e) V' of their bin.

    diag: group, bin, det, d; strengths: group, bin, mode, e; modes: group, set, mode, det, v, where sets (group, bin, set) says
    which set of vectors a bin uses (without it, set is the bin's number), so that bins may share theirs. Bins without modes are
    diagonal; detectors without d are left out.
    """
    used = modes.withColumnRenamed("set", "bin") if sets is None else modes.join(sets, [group, "set"]).drop("set")
    found = used.join(strengths.where("e > 0"), [group, "bin", "mode"])
    most = found.agg(F.max("mode")).first()[0]  # one number
    rows = rows.join(diag, [group, "bin", det])
    if most is None:
        return rows.withColumns({c: F.col(c) / F.col("d") for c in ("re", "im")}).drop("d")
    m = most + 1
    vectors = found.groupBy(group, "bin", det).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("mode") == j, F.col("v"))), F.lit(0.0)) for j in range(m)]).alias("_v"))
    inverse_e = found.select(group, "bin", "mode", "e").distinct().groupBy(group, "bin").agg(F.array(*[F.sum(F.when(F.col("mode") == j, 1 / F.col("e"))) for j in range(m)]).alias("_ie"))
    # (1 / E + V' D^-1 V)^-1 of each bin from sums over its detectors; modes a bin doesn't have drop out.
    upper = [(i, j) for i in range(m) for j in range(i, m)]
    sums = vectors.join(diag, [group, "bin", det]).groupBy(group, "bin").agg(F.array(*[F.sum(F.col("_v")[i] * F.col("_v")[j] / F.col("d")) for i, j in upper]).alias("_s")).join(inverse_e, [group, "bin"])

    @F.pandas_udf("array<double>")
    def cores(s: pd.Series, ie: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(s, ie, strict=True):
            there = [k for k, v in enumerate(y) if v is not None and v == v]
            a = np.zeros((m, m))
            for (i, j), v in zip(upper, x, strict=True):
                a[i, j] = a[j, i] = v
            core = np.zeros((m, m))
            own = np.ix_(there, there)
            core[own] = np.linalg.inv(a[own] + np.diag([y[k] for k in there]))
            out.append(core.ravel())
        return pd.Series(out)

    core = cut(sums.select(group, "bin", cores("_s", "_ie").alias("_core")))
    kept = rows.columns
    rows = cut(rows.join(vectors, [group, "bin", det], "left"))
    at_k = rows.where("_v IS NOT NULL").groupBy(group, "bin", "k").agg(*[F.sum(F.col(c) * F.col("_v")[j] / F.col("d")).alias(f"_{c}{j}") for c in ("re", "im") for j in range(m)])
    at_k = at_k.join(core, [group, "bin"])
    solved = [sum((F.col("_core")[i * m + j] * F.col(f"_{c}{j}") for j in range(m)), F.lit(0.0)).alias(f"_{c}") for c in ("re", "im") for i in range(m)]
    at_k = at_k.select(group, "bin", "k", F.array(*solved[:m]).alias("_cre"), F.array(*solved[m:]).alias("_cim"))
    both = rows.join(at_k, [group, "bin", "k"], "left")
    less = lambda c: sum((F.coalesce(F.col("_v")[j] * F.col(f"_c{c}")[j], F.lit(0.0)) for j in range(m)), F.lit(0.0))
    return both.withColumns({c: (F.col(c) - less(c)) / F.col("d") for c in ("re", "im")}).select(*[c for c in kept if c != "d"])


def scaled(rows: DataFrame, scales: DataFrame, edges: DataFrame, group: str, det: str, inner: Callable[[DataFrame], DataFrame], rate: float = 1.0) -> DataFrame:
    """Frequency rows times the inverse of S N S: S is a deviation per detector and fine bin (scales: group, det, bin, scale; edges of these bins),
    N a coarser model that inner inverts."""

    def over(rows: DataFrame) -> DataFrame:
        named = binned(rows.drop("bin"), edges, group, rate).join(scales, [group, det, "bin"])
        return named.withColumns({c: F.col(c) / F.col("scale") for c in ("re", "im")}).drop("scale", "bin")

    return over(inner(over(rows)))


def geometric_edges(n: Column, bins: int) -> Column:
    """Lower ends, in units of one frequency step, of bins that grow geometrically up to half of n. The constant mode, of which a
    measured spectrum knows nothing, shares the first bin with the lowest frequencies."""
    top = F.floor(n / 2) + 1
    steps = F.transform(F.sequence(F.lit(1), F.lit(bins - 2)), lambda j: F.rint(F.pow(top.cast("double"), j / (bins - 1))))
    return F.array_distinct(F.concat(F.array(F.lit(0.0)), steps))


def measured(rows: DataFrame, group: str, det: str, modes: int = 5, share: float = 0.01) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(diag, modes, strengths) of the covariance of frequency rows in each bin: up to `modes` joint modes that hold more than
    `share` of its trace, by a tree of QR factors, and what is left of each detector's power on the diagonal."""
    rows = cut(rows)
    one = rows.select(group, "bin", det, "n", "k", F.explode(F.array(F.struct(F.lit(0).alias("p"), F.col("re").alias("x")), F.struct(F.lit(1).alias("p"), F.col("im").alias("x")))).alias("_x"))
    one = one.select(group, "bin", det, "n", (F.col("k") * 2 + F.col("_x.p")).alias("_at"), F.col("_x.x").alias("_x"))
    each = rows.groupBy(group, "bin").agg((F.count_distinct("k") * F.first("n")).alias("_size"))
    power = one.groupBy(group, "bin", det).agg(F.sum(F.col("_x") * F.col("_x")).alias("_p")).join(each, [group, "bin"]).withColumn("_p", F.col("_p") / F.col("_size"))
    whole = power.groupBy(group, "bin").agg(F.sum("_p").alias("_t"), F.count(F.lit(1)).alias("_k"))
    whole = whole.withColumn("_floor", 1e-6 * F.col("_t") / F.col("_k") + 1e-12).withColumn("_t", F.col("_t") + F.col("_k") * F.col("_floor"))
    found = lowrank.vectors(one, [group, "bin"], det, "_at", "_x", keep=lambda s: np.arange(len(s)) < modes)
    found = found.join(each, [group, "bin"]).join(whole, [group, "bin"]).withColumn("e", F.col("s") * F.col("s") / F.col("_size") + F.col("_floor"))
    strong = cut(found.where(F.col("e") > share * F.col("_t")).select(group, "bin", "mode", det, "v", "e"))
    held = strong.groupBy(group, "bin", det).agg(F.sum(F.col("v") * F.col("v") * F.col("e")).alias("_h"), F.max("e").alias("_e"))
    own = power.join(whole, [group, "bin"]).join(held, [group, "bin", det], "left").withColumn("_p", F.col("_p") + F.col("_floor"))
    d = F.greatest(F.col("_p") - F.coalesce("_h", F.lit(0.0)), 1e-12 * F.coalesce("_e", F.lit(0.0)), 1e-6 * F.col("_p"))
    return own.select(group, "bin", det, d.alias("d")), strong.select(group, F.col("bin").alias("set"), "mode", det, "v"), strong.select(group, "bin", "mode", "e").distinct()


def weighted(df: DataFrame, group: str, det: str, at: str, value: str, bins: int = 6, modes: int = 5, window: int = 0) -> DataFrame:
    """Inverse noise times data, with the noise measured from the data, their means aside."""

    def apply(rows: DataFrame) -> DataFrame:
        edges = rows.select(group, "n").distinct().select(group, F.transform(geometric_edges(F.col("n"), bins), lambda e: e / F.col("n")).alias("edges"))
        rows = cut(binned(rows, edges, group))
        # The mean of a series is its value at k = 0, which is no noise.
        diag, vectors, strengths = measured(rows.withColumns({c: F.when(F.col("k") == 0, 0.0).otherwise(F.col(c)) for c in ("re", "im")}), group, det, modes)
        return low_rank(rows, diag, vectors, strengths, group, det)

    return _over(df, group, det, at, value, apply, window)
