"""Small dense linear algebra, spectra and fits: one row or one group at a time, as array columns in Arrow batches.

Nothing here holds more than one group (a scan, a cell, a matrix) in a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut

DOUBLES = T.ArrayType(T.DoubleType())


def per_row(f: Callable[..., object], kind: T.DataType = DOUBLES) -> Callable:
    """A function of arrays and numbers as a Column function over Arrow batches; a null argument gives null."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns, strict=True)])

    annotations = {}
    run.__annotations__ = annotations

    def batches(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in it:
            yield run(columns) if isinstance(columns, pd.Series) else run(*columns)  # one column comes bare

    batches.__annotations__ = {"it": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(batches, kind)


def square(a: object) -> np.ndarray:
    a = np.asarray(a, float)
    n = int(round(len(a) ** 0.5))
    return a.reshape(n, n)


def power(a: object, exponent: float, limit: float = 1e-6, floor: float = 1e-28) -> list[float]:
    """Symmetric matrix power. Nothing is left if the largest eigenvalue is at most floor; a matrix with a negative eigenvalue, or
    one that a negative power would blow up beyond 1 / limit, keeps only its [0, 0] element, the largest to the power."""
    a = square(a)
    if not np.isfinite(a).all():
        return [0.0] * a.size
    values, vectors = np.linalg.eigh(a)
    out = np.zeros_like(a)
    if values[-1] > floor:
        if values[0] < 0 or (exponent < 0 and values[0] < limit * values[-1]):
            out[0, 0] = values[-1] ** exponent
        else:
            out = (vectors * values**exponent) @ vectors.T
    return out.ravel().tolist()


def flip(a: object) -> list[float]:
    """The matrix with its eigenvalues made positive."""
    values, vectors = np.linalg.eigh(square(a))
    return ((vectors * np.abs(values)) @ vectors.T).ravel().tolist()


def condition(a: object) -> float:
    values = np.abs(np.linalg.eigvalsh(square(a)))
    return float(values.max() / values.min()) if values.min() > 0 else float("inf")


def solve(a: object, b: object) -> list[float]:
    """Least-norm solution; rows and columns of zeros drop out."""
    a, b = square(a), np.asarray(b, float)
    used = np.abs(a).sum(axis=1) > 0
    out = np.zeros(len(b))
    if used.any():
        out[used] = np.linalg.lstsq(a[np.ix_(used, used)], b[used], rcond=None)[0]
    return out.tolist()


def matvec(a: object, b: object) -> list[float]:
    return (square(a) @ np.asarray(b, float)).tolist()


def expand_low_rank(d: object, v: object, e: object) -> list[float]:
    """diag(d) + V diag(e) V' from its parts; v is row by row."""
    d, e = np.asarray(d, float), np.asarray(e, float)
    v = np.asarray(v, float).reshape(len(d), len(e))
    return (np.diag(d) + (v * e) @ v.T).ravel().tolist()


def invert_low_rank(d: object, v: object, e: object) -> list[float]:
    """Inverse of diag(d) + V diag(e) V' through the small system in the modes."""
    d, e = np.asarray(d, float), np.asarray(e, float)
    w = np.asarray(v, float).reshape(len(d), len(e)) / d[:, None]
    core = np.linalg.inv(np.diag(1 / e) + w.T @ (w * d[:, None]))
    return (np.diag(1 / d) - w @ core @ w.T).ravel().tolist()


def low_rank(a: object, most: int = 15, share: float = 0.01) -> dict:
    """diag + modes approximating a covariance: modes that hold more than `share` of the trace, the rest on the diagonal."""
    a = square(a)
    values, vectors = np.linalg.eigh(a)
    keep = np.argsort(-values)[:most]
    keep = keep[values[keep] > share * max(np.trace(a), 0)]
    v, e = vectors[:, keep], values[keep]
    d = np.maximum(np.diag(a) - ((v * e) * v).sum(axis=1), 1e-12 * max(values.max(), 0))
    return {"d": d.tolist(), "v": v.ravel().tolist(), "e": e.tolist()}


def conjugate_gradients(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, precondition: Callable[[np.ndarray], np.ndarray] = lambda x: x, steps: int = 200, enough: float = 1e-12) -> tuple[np.ndarray, list[float]]:
    """Solves A x = b for a positive A given as a function; returns x and the relative error after each step."""
    x, r = np.zeros_like(b, float), b.astype(float)
    z = precondition(r)
    p, rz = z.copy(), float(r @ z)
    first, errors = rz, []
    for _ in range(steps):
        if first == 0 or rz / first < enough:
            break
        ap = apply(p)
        alpha = rz / float(p @ ap)
        x, r = x + alpha * p, r - alpha * ap
        z = precondition(r)
        new = float(r @ z)
        p, rz = z + new / rz * p, new
        errors.append(rz / first)
    return x, errors


def cg_solve(a: object, b: object) -> list[float]:
    a = square(a)
    d = np.where(np.diag(a) == 0, 1.0, np.diag(a))
    return conjugate_gradients(lambda x: a @ x, np.asarray(b, float), lambda r: r / d)[0].tolist()


# ---- spectra


def butterworth(f: np.ndarray, knee: float, alpha: float) -> np.ndarray:
    """1 / (1 + (f / knee)^alpha); 1 for a knee of 0."""
    f = np.asarray(f, float)
    if knee <= 0:
        return np.ones_like(f)
    with np.errstate(divide="ignore", over="ignore"):
        return 1 / (1 + (f / knee) ** alpha)


def spectral(d: object, weight: Callable[[np.ndarray], np.ndarray], rate: float = 1.0) -> list[float]:
    d = np.asarray(d, float)
    f = np.fft.rfftfreq(len(d), 1 / rate)
    return np.fft.irfft(np.fft.rfft(d) * weight(f), len(d)).tolist()


def highpass(d: object, knee: float, alpha: float = -3.0, rate: float = 1.0) -> list[float]:
    return spectral(d, lambda f: butterworth(f, knee, alpha), rate)


def bandpass(d: object, low: float, high: float, alpha: float = -5.0, rate: float = 1.0) -> list[float]:
    return spectral(d, lambda f: butterworth(f, low, alpha) - butterworth(f, high, alpha), rate)


def notch(d: object, spin: float, harmonics: int, width: float = 0.05, rate: float = 1.0) -> list[float]:
    """Takes out the harmonics of a rotation."""
    centres = spin * np.arange(1, harmonics + 1)
    return spectral(d, lambda f: (np.abs(f[:, None] - centres).min(axis=1) > width).astype(float), rate)


def broaden(d: object, sigma: float) -> list[float]:
    """Gaussian smoothing by `sigma` samples."""
    return spectral(d, lambda f: np.exp(-2 * (np.pi * f * sigma) ** 2))


def spectrum(d: object) -> list[float]:
    d = np.asarray(d, float)
    return (np.abs(np.fft.rfft(d - d.mean())) ** 2 / len(d)).tolist()


def knee(power: object, l: object, alpha: float = -4.0) -> float:
    """Knee of power = w (1 + (l / knee)^alpha) by least squares in logarithms from the spectrum's peak on: the white level has a
    closed form, the knee is searched on a grid of logarithms that narrows."""
    p, l = np.asarray(power, float), np.asarray(l, float)  # noqa: E741
    first = int(np.argmax(p))
    p, l = np.log(p[first:]), np.maximum(l[first:], 1.0)  # noqa: E741
    low, high = math.log(l[0] / 10), math.log(l[-1] * 10)
    for _ in range(12):
        at = np.linspace(low, high, 33)
        r = p - np.log1p((l / np.exp(at)[:, None]) ** alpha)
        k = int(np.argmin(((r - r.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)))
        low, high = at[max(0, k - 1)], at[min(32, k + 1)]
    return float(math.exp((low + high) / 2))


# ---- fits over a group


def group_map(df: DataFrame, group: list[str], at: str, value: str, f: Callable[[np.ndarray, np.ndarray, pd.DataFrame], np.ndarray], more: list[str] = []) -> DataFrame:  # noqa: B006
    """Replaces value by f(at, value, frame) in each group, ordered by at."""
    cols = [*group, at, value, *more]
    shape = T.StructType([f_ if f_.name != value else T.StructField(value, T.DoubleType()) for f_ in df.select(*cols).schema])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(at, kind="stable").reset_index(drop=True)
        frame[value] = f(frame[at].to_numpy(float), frame[value].to_numpy(float), frame)
        return frame

    return df.select(*cols).groupBy(*group).applyInPandas(run, shape)


def legendre(x: np.ndarray, n: int) -> np.ndarray:
    """n columns of Legendre polynomials of x scaled to -1..1."""
    span = x.max() - x.min() if len(x) else 0
    u = np.zeros_like(x) if span == 0 else 2 * (x - x.min()) / span - 1
    return np.polynomial.legendre.legvander(u, n - 1)


def projected(basis: np.ndarray, d: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """The part of d in the span of the basis, by weighted least squares."""
    w = np.ones(len(d)) if weight is None else np.sqrt(weight)
    return basis @ np.linalg.lstsq(basis * w[:, None], d * w, rcond=None)[0]


def legendre_columns(c: Column, low: Column, high: Column, n: int) -> list[Column]:
    """The same polynomials as Columns, by their recurrence."""
    u = F.when(high > low, 2 * (c - low) / (high - low) - 1).otherwise(0.0)
    out = [F.lit(1.0), u]
    for k in range(1, n - 1):
        out.append(((2 * k + 1) * u * out[k] - k * out[k - 1]) / (k + 1))
    return out[:n]


def least_norm(n: int, columns: list[Column]) -> Column:
    """Least-norm solutions of symmetric n x n systems, many at once; columns: the upper triangle row by row, then the right side."""

    def run(*parts: pd.Series) -> pd.Series:
        values = np.column_stack([p.to_numpy(float) for p in parts])
        a = np.empty((len(values), n, n))
        i, j = np.triu_indices(n)
        a[:, i, j] = a[:, j, i] = values[:, : len(i)]
        return pd.Series(list((np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ values[:, len(i) :, None])[:, :, 0]))

    def batches(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in it:
            yield run(*parts)

    batches.__annotations__ = {"it": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(batches, DOUBLES)(*columns)


def remove_poly(df: DataFrame, group: list[str], at: str, value: str, n_t: int, az: str | None = None, n_az: int = 0, cut: str | None = None) -> DataFrame:
    """Joint fit of polynomials in time and azimuth, cut samples left out; subtracted. A negative count is fitted but kept.

    The normal equations are sums per group (partial before the shuffle); only they, one row a group, reach Python.
    """
    cols = [*group, at, value, *[c for c in (az, cut) if c]]
    whole = W.partitionBy(*group)
    rows = df.select(*cols).withColumn(value, F.col(value).cast("double"))
    take: list[bool] = []
    basis: list[Column] = []
    for c, n, skip in ((at, n_t, 0), (az, n_az, 1)):
        if c and n:
            rows = rows.withColumns({f"_low{skip}": F.min(c).over(whole), f"_high{skip}": F.max(c).over(whole)})
            made = legendre_columns(F.col(c), F.col(f"_low{skip}"), F.col(f"_high{skip}"), abs(n) + skip)[skip:]
            basis += made
            take += [n > 0] * len(made)
    names = [f"_b{k}" for k in range(len(basis))]
    rows = rows.withColumns(dict(zip(names, basis, strict=True)))
    used = rows if cut is None else rows.where(~F.coalesce(F.col(cut), F.lit(False)))
    sums = [F.col(a) * F.col(b) for k, a in enumerate(names) for b in names[k:]] + [F.col(a) * F.col(value) for a in names]
    sums = used.groupBy(*group).agg(*[F.sum(x).alias(f"_s{k}") for k, x in enumerate(sums)])
    amps = sums.select(*group, least_norm(len(names), [F.col(c) for c in sums.columns[len(group) :]]).alias("_amps"))
    model = reduce(lambda a, b: a + b, [F.get("_amps", F.lit(k)) * F.col(name) for k, name in enumerate(names) if take[k]], F.lit(0.0))
    return rows.join(amps, group, "left").withColumn(value, F.col(value) - F.coalesce(model, F.lit(0.0))).select(*cols)


#: Keys (about), and places, of one packed row of covariance(), and the pairs that are made at once.
TILE, SPAN, BLOCK = 256, 16384, 1 << 18
PACKED = ("dets", "first", "places", "m", "there")


def pack(table: pa.Table) -> pa.Table:
    """Cells (det, place, sum and count) of one tile and span as one row: dets, first place, number of places, and two packed
    matrices of keys and places, sums and counts."""
    coded = table["det"].combine_chunks().dictionary_encode("encode")
    row, dets = coded.indices.to_numpy(), coded.dictionary
    at, v, c = (table[name].to_numpy() for name in ("at", "v", "c"))
    first, places = int(at.min()), int(at.max() - at.min()) + 1
    cells, there = np.zeros((len(dets), places)), np.zeros((len(dets), places), np.float32)
    cells[row, at - first], there[row, at - first] = v, c
    dets = pa.ListArray.from_arrays(pa.array([0, len(dets)], pa.int32()), dets)
    m, there = (pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True)], pa.binary()) for x in (cells, there))
    return pa.table([table["tile"][:1], table["k"][:1], dets, pa.array([first], pa.int64()), pa.array([places], pa.int32()), m, there], names=["tile", "k", *PACKED])


def unpack(row: list[pa.Scalar]) -> tuple[pa.Array, int, np.ndarray, np.ndarray]:
    """(dets, first place, sums, counts) of a row's PACKED columns."""
    dets, first, places, m, there = row
    shape = (len(dets.values), places.as_py())
    m, there = (np.frombuffer(pa.decompress(x.as_buffer(), shape[0] * shape[1] * np.dtype(kind).itemsize, "zstd"), kind).reshape(shape) for x, kind in ((m, np.float64), (there, np.float32)))
    return dets.values, first.as_py(), m, there


def pairs(left: tuple, right: tuple, lag: int) -> Iterator[dict]:
    """Columns i, j, s, n of the pairs of two tiles that share places, a block of left keys at a time."""
    (a, p, x, nx), (b, q, y, ny) = left, right
    low, high = max(p, q - lag), min(p + x.shape[1], q - lag + y.shape[1])
    if low >= high:
        return
    x, nx, y, ny = x[:, low - p : high - p], nx[:, low - p : high - p], y[:, low + lag - q : high + lag - q].T, ny[:, low + lag - q : high + lag - q].T
    odd = np.flatnonzero(~(np.isfinite(x).all(axis=0) & np.isfinite(y).all(axis=1)))  # these would spoil pairs that lack them
    even_x, even_y = x, y
    if len(odd):
        even_x, even_y = x.copy(), y.copy()
        even_x[:, odd] = even_y[odd] = 0.0
    step = max(1, BLOCK // len(b))
    for at in range(0, len(a), step):
        own = slice(at, at + step)
        s, count = even_x[own] @ even_y, nx[own] @ ny
        with np.errstate(invalid="ignore"):
            for t in odd:
                s += np.where(np.outer(nx[own, t], ny[t]) > 0, np.outer(x[own, t], y[t]), 0.0)
        k, o = np.nonzero(count)
        yield {"i": a.take(pa.array(k + at)), "j": b.take(pa.array(o)), "s": s[k, o], "n": count[k, o].astype(float)}


def covariance(df: DataFrame, det: str, at: str, value: str, lag: int = 0) -> DataFrame:
    """Sum of d_i(t) d_j(t + lag) over the places that both have, divided by their number, for all pairs: the matrix of
    n_det^2 cells that is asked for. Null values are missing.

    As a blocked product: keys are dealt into tiles and places into spans, and each tile's span is packed into one row, a
    matrix and which of its cells there are, written once. Where one span holds all places, a task reads two parts of these rows where
    they lie and multiplies them: none is sent to the tiles that it meets, so that disks hold what grows as the samples do, and a pair
    is there once. Longer series are multiplied span by span and pairs' sums are added.
    """
    held = df.where(F.col(value).isNotNull() & F.col(at).isNotNull()).select(F.col(det).alias("det"), F.col(at).cast("long").alias("at"), F.col(value).cast("double").alias("v"))
    kind = dict(df.dtypes)[det]
    n = max(1, -(-held.agg(F.approx_count_distinct("det")).first()[0] // TILE))
    dealt = held.select("*", F.pmod(F.xxhash64("det"), F.lit(n)).cast("int").alias("tile"), F.floor(F.col("at") / SPAN).alias("k"))
    cells = dealt.repartition("tile", "k").groupBy("tile", "k", "det", "at").agg(F.sum("v").alias("v"), F.count("v").alias("c"))
    packed = cut(cells.groupBy("tile", "k").applyInArrow(pack, f"tile int, k long, dets array<{kind}>, first long, places int, m binary, there binary"))
    low, high, size = packed.agg(F.min("k"), F.max("k"), F.sum(F.length("m") + F.length("there"))).first()
    if low != high:
        return by_spans(packed, kind, lag, n)

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                for cols in pairs(unpack(row[: len(PACKED)]), unpack(row[len(PACKED) :]), lag):
                    yield pa.RecordBatch.from_pydict(cols)

    parts = packed.select(*PACKED).repartition(max(min(n, 4), min(n // 4, 64), (size or 0) >> 25))
    sums = parts.hint("shuffle_replicate_nl").crossJoin(parts.toDF(*[f"{c}_j" for c in PACKED])).mapInArrow(times, f"i {kind}, j {kind}, s double, n double")
    return sums.select("i", "j", (F.col("s") / F.col("n")).alias("cov"))


def by_spans(packed: DataFrame, kind: str, lag: int, n: int) -> DataFrame:
    """covariance() of packed rows of many spans in n tiles: a left row is sent to all tiles, a right one to all tiles of the one or
    two spans that it reaches into."""
    spans = [F.floor((F.col("first") - lag + x) / SPAN) for x in (0, F.col("places") - 1)]
    right = packed.withColumn("k", F.explode(F.sequence(*spans)))
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = packed.select("k", F.col("tile").alias("i"), other.alias("j"), F.lit(0).alias("side"), *PACKED).unionByName(right.select("k", other.alias("i"), F.col("tile").alias("j"), F.lit(1).alias("side"), *PACKED))

    def times(table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        for side, *row in zip(table["side"].to_pylist(), *[table[c] for c in PACKED], strict=True):
            sides[side].append(unpack(row))
        key = table.schema.field("dets").type.value_type
        out = pa.schema([("i", key), ("j", key), ("s", pa.float64()), ("n", pa.float64())])
        return pa.Table.from_batches([pa.RecordBatch.from_pydict(cols, out) for left in sides[0] for r in sides[1] for cols in pairs(left, r, lag)], out)

    sums = sent.groupBy("i", "j", "k").applyInArrow(times, f"i {kind}, j {kind}, s double, n double")
    return sums.groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("cov"))
