"""Strong joint modes of many detectors over long series, without a task that holds a group.

A group's matrix is samples by detectors: tall and thin. It is cut into blocks of `SPAN` samples, each reduced to the triangular
factor of its QR decomposition (detectors by detectors), and factors are merged in a tree, FAN at a time. The last one has the
singular values and detector-side vectors of the whole matrix, as accurate as those of the matrix itself. Groups of many
detectors and fewer samples are cut into blocks of detectors instead; their factors are samples by samples, and a wanted mode's
weights are sums over samples. A task holds a block, or FAN factors, of one group; memory depends on the lesser of its detectors
and samples. What follows is plain aggregates: the modes' series are weighted sums over detectors, the amplitudes sums over samples.

Samples that a detector lacks count as 0, so it is deviations from its mean that are passed in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

SPAN = 4096
#: Factors that are merged at a time.
FAN = 8
#: Detectors of a group that are taken as columns however few its samples are.
COLUMNS = 512

#: From all singular values of a group, largest first, which modes are wanted.
Keep = Callable[[np.ndarray], np.ndarray]


def _triangle(m: np.ndarray) -> np.ndarray:
    return np.linalg.qr(m, mode="r") if m.size else np.zeros((0, m.shape[1]))


def factors(df: DataFrame, group: list[str], column: str, row: str, value: str, node: Column) -> DataFrame:
    """One row a group: its columns (`cols`, sorted) and the triangular factor (`r`, rows x columns doubles, line by line) of its
    matrix of rows by columns. node: the number of a row's block."""
    kinds = dict(df.dtypes)
    keys = ", ".join(f"{c} {kinds[c]}" for c in group)
    schema = f"{keys}, node long, cols array<{kinds[column]}>, r binary"

    def first(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        cols, c = np.unique(frame[column].to_numpy(), return_inverse=True)
        places, t = np.unique(frame[row].to_numpy(), return_inverse=True)
        m = np.zeros((len(places), len(cols)))
        np.add.at(m, (t, c), frame[value].to_numpy(float))
        return pd.DataFrame([(*key, cols.tolist(), _triangle(m).tobytes())], columns=[*group, "node", "cols", "r"])

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        cols = np.unique(np.concatenate([np.asarray(x) for x in frame["cols"]]))
        parts = []
        for own, r in zip(frame["cols"], frame["r"], strict=True):
            part = np.frombuffer(r).reshape(-1, len(own))
            wide = np.zeros((len(part), len(cols)))
            wide[:, np.searchsorted(cols, np.asarray(own))] = part
            parts.append(wide)
        return pd.DataFrame([(*key, cols.tolist(), _triangle(np.vstack(parts)).tobytes())], columns=[*group, "node", "cols", "r"])

    rows = df.select(*group, column, row, value, node.cast("long").alias("node"))
    low, high = rows.agg(F.min("node"), F.max("node")).first()
    out = rows.groupBy(*group, "node").applyInPandas(first, schema)
    while low is not None and low < high:
        out = out.groupBy(*group, F.floor(F.col("node") / FAN).cast("long").alias("node")).applyInPandas(merge, schema)
        low, high = low // FAN, high // FAN
    return out.drop("node")


@dataclass(frozen=True)
class Factored:
    """Groups' matrices and their factors: `tall` by detectors, `wide`, of groups with more detectors than samples, by samples."""

    held: DataFrame
    tall: DataFrame
    wide: DataFrame | None
    group: list[str]
    det: str
    at: str
    value: str

    def strengths(self) -> DataFrame:
        """group, mode, s: all singular values, as many as the lesser of a group's detectors and samples."""
        return self._of(self.tall, None, None).unionByName(self._of(self.wide, None, None)) if self.wide else self._of(self.tall, None, None)

    def vectors(self, keep: Keep | None = None) -> DataFrame:
        """Detector-side singular vectors, strongest first: group, det, mode, v, s (the singular value); every mode has its sign such
        that its largest weight is positive. In groups with more detectors than samples, modes without strength have no vectors."""
        tall = self._of(self.tall, self.det, keep)
        if self.wide is None:
            return tall
        strong = lambda s: (s > 1e-13 * s.max(initial=0)) & (True if keep is None else keep(s))
        sides = self._of(self.wide, self.at, strong).withColumnsRenamed({"v": "_u", "s": "_s"})
        met = self.held.join(sides, [*self.group, self.at]).groupBy(*self.group, self.det, "mode").agg((F.sum(F.col(self.value) * F.col("_u")) / F.first("_s")).alias("v"), F.first("_s").alias("s"))
        met = cut(met)
        signs = met.groupBy(*self.group, "mode").agg(F.signum(F.max_by("v", F.abs("v"))).alias("_sign"))
        return tall.unionByName(met.join(signs, [*self.group, "mode"]).select(*self.group, self.det, "mode", (F.col("v") * F.col("_sign")).alias("v"), "s"))

    def _of(self, factors: DataFrame, name: str | None, keep: Keep | None) -> DataFrame:
        """Singular values of factors, padded with zeros; with a name for their columns, vectors of those that keep wants."""
        group, kinds = self.group, dict(self.held.dtypes)

        def run(frames: object) -> object:
            for frame in frames:
                for *key, cols, r, n in frame[[*group, "cols", "r", "_n"]].itertuples(index=False):
                    _, s, v = np.linalg.svd(np.frombuffer(r).reshape(-1, len(cols)), full_matrices=False)
                    every = np.concatenate([s, np.zeros(max(n - len(s), 0))])
                    own = dict(zip(group, key, strict=True))
                    if name is None:
                        yield pd.DataFrame({"mode": np.arange(len(every)), "s": every}).assign(**own)[[*group, "mode", "s"]]
                        continue
                    wanted = np.flatnonzero(np.ones(len(s), bool) if keep is None else keep(every)[: len(s)])
                    v = v[wanted] * np.sign(v[wanted, np.abs(v[wanted]).argmax(axis=1)])[:, None]
                    mode, d = np.indices(v.shape)
                    mode = wanted[mode.ravel()]
                    yield pd.DataFrame({name: np.asarray(cols)[d.ravel()], "mode": mode, "v": v.ravel(), "s": s[mode]}).assign(**own)[[*group, name, "mode", "v", "s"]]

        schema = ", ".join(f"{c} {kinds[c]}" for c in [*group, *([name] if name else [])]) + ", mode int" + (", v double" if name else "") + ", s double"
        return factors.mapInPandas(run, schema)


def factored(df: DataFrame, group: list[str], det: str, at: str, value: str, span: int = SPAN) -> Factored:
    """Factors of the shorter side: by detectors in blocks of `span` samples, or, where a group has over `COLUMNS` detectors and more
    than it has samples, by samples in blocks of as many detectors as make up about as much."""
    held = cut(df.where(F.col(value).isNotNull()).select(*group, det, at, F.col(value).cast("double").alias(value)))
    sides = [held.select(*group, c).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias(n)) for c, n in ((det, "_dets"), (at, "_ats"))]
    shapes = cut(sides[0].join(sides[1], group).select(*group, F.least("_dets", "_ats").alias("_n"), ((F.col("_dets") > F.greatest("_ats", F.lit(COLUMNS)))).alias("_wide"), "_dets", "_ats"))
    dets, ats = shapes.where("_wide").agg(F.max("_dets"), F.max("_ats")).first()
    sizes = shapes.select(*group, "_n")
    tall, wide = held, None
    if dets is not None:
        tall = held.join(shapes.where("NOT _wide").select(*group), group, "left_semi")
        blocks = max(1, -(-dets // max(64, SPAN * COLUMNS // max(ats, COLUMNS))))
        rows = held.join(shapes.where("_wide").select(*group), group, "left_semi")
        wide = cut(factors(rows, group, at, det, value, F.pmod(F.xxhash64(det), F.lit(blocks))).join(sizes, group))
    by_det = factors(tall, group, det, at, value, F.floor(F.col(at) / span))
    return Factored(held, cut(by_det.join(sizes, group)), wide, group, det, at, value)


def vectors(df: DataFrame, group: list[str], det: str, at: str, value: str, span: int = SPAN, keep: Keep | None = None) -> DataFrame:
    """Detector-side singular vectors of each group, as in Factored.vectors."""
    return factored(df, group, det, at, value, span).vectors(keep)


def _weights(found: DataFrame, group: list[str], det: str, n: int, weight: Column) -> DataFrame:
    """One row a detector with its weights in modes 0 ... n - 1 (0 where a group has fewer)."""
    own = [F.coalesce(F.sum(F.when(F.col("mode") == k, weight)), F.lit(0.0)).alias(f"_w{k}") for k in range(n)]
    return found.groupBy(*group, det).agg(*own)


def centred(df: DataFrame, group: list[str], det: str, value: str) -> DataFrame:
    """df plus `_mean`, the mean of its detector, with value as the deviation from it."""
    means = df.groupBy(*group, det).agg(F.avg(value).alias("_mean"))
    return df.join(means, [*group, det]).withColumn(value, F.col(value) - F.col("_mean"))


def series(df: DataFrame, weights: DataFrame, group: list[str], det: str, at: str, value: str, n: int) -> DataFrame:
    """Sums over detectors of value times their weights: group, at, _b0 ... _b(n - 1). Weights are detectors by modes, joined to the
    samples by detector."""
    sums = [F.sum(F.col(value) * F.col(f"_w{k}")).alias(f"_b{k}") for k in range(n)]
    return df.join(weights, [*group, det]).groupBy(*group, at).agg(*sums)


def deproject(df: DataFrame, group: list[str], at: str, value: str, det: str, dark: str, modes: int, span: int = SPAN) -> DataFrame:
    """Takes the `modes` strongest joint modes of the dark detectors' deviations out of the other detectors' (group, det, at, dark,
    value): all are returned as deviations from their means, null values stay null. A group without dark detectors loses its means only."""
    rows = centred(df.select(*group, det, at, dark, F.col(value).cast("double").alias(value)), group, det, value).drop("_mean")
    found = vectors(rows.where(F.col(dark)), group, det, at, value, span, lambda s: (np.arange(len(s)) < modes) & (s > 1e-12))
    basis = series(rows.where(F.col(dark)), _weights(found, group, det, modes, F.col("v") / F.col("s")), group, det, at, value, modes)
    live = rows.where(~F.col(dark)).join(basis, [*group, at], "left")
    dot = [F.coalesce(F.sum(F.col(value) * F.col(f"_b{k}")), F.lit(0.0)).alias(f"_a{k}") for k in range(modes)]
    amps = live.groupBy(*group, det).agg(*dot)
    model = sum((F.col(f"_a{k}") * F.coalesce(f"_b{k}", F.lit(0.0)) for k in range(modes)), F.lit(0.0))
    out = live.join(amps, [*group, det]).withColumn(value, F.col(value) - model)
    keep = [*group, det, at, dark, value]
    return out.select(*keep).unionByName(rows.where(F.col(dark)).select(*keep))


def strong_model(df: DataFrame, group: list[str], det: str, at: str, value: str, threshold: float, span: int = SPAN) -> DataFrame:
    """What the strong joint modes say of each sample: df plus `_model`, the detector's mean and its share of the modes whose
    variance is over `threshold` times the median of the group's modes."""
    rows = centred(df, group, det, value)
    strong = vectors(rows, group, det, at, value, span, lambda s: s * s > threshold * np.median(s * s))
    n = strong.agg(F.max("mode")).first()[0]  # one number
    if n is None:
        return rows.withColumns({"_model": F.col("_mean"), value: F.col(value) + F.col("_mean")}).drop("_mean")
    weights = _weights(strong, group, det, n + 1, F.col("v"))
    basis = series(rows, weights, group, det, at, value, n + 1)
    model = sum((F.coalesce(F.col(f"_w{k}") * F.col(f"_b{k}"), F.lit(0.0)) for k in range(n + 1)), F.col("_mean"))
    out = rows.join(weights, [*group, det], "left").join(basis, [*group, at], "left").withColumns({"_model": model, value: F.col(value) + F.col("_mean")})
    return out.select(*df.columns, "_model")
