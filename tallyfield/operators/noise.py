"""Noise models of scans (group, det, at, value): measured per frequency bin, applied, windowed; gap filling that follows them; and
parameters that stand for the samples of a cut. The dense forms here hold one group in a task; `constrained` holds a block of one."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lineage
from . import noisemodels as nm
from .numerics import conjugate_gradients, legendre, low_rank


def _wide(frame: pd.DataFrame, det: str, at: str, value: str) -> pd.DataFrame:
    return frame.pivot(index=det, columns=at, values=value).astype(float).fillna(0.0)


def _long(frame: pd.DataFrame, wide: pd.DataFrame, d: np.ndarray, det: str, at: str, value: str, keep: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(d, index=wide.index, columns=wide.columns).stack().rename(value).reset_index()
    return frame[keep].merge(out, on=[det, at])[[*keep, value]]


def bin_edges(n: int, bins: int) -> np.ndarray:
    """Edges of frequency ranges that grow geometrically; the constant mode shares the first with the lowest frequencies."""
    top = n // 2 + 1
    return np.unique(np.concatenate([[0], np.geomspace(1, top, bins)[1:].round().astype(int)]))


class Measured:
    """Covariance of detectors per frequency bin, as diagonal plus modes; `apply` multiplies by its inverse."""

    def __init__(self, d: np.ndarray, bins: int = 6, modes: int = 5) -> None:
        f, n = np.fft.rfft(d - d.mean(axis=1, keepdims=True)), d.shape[1]
        self.edges, self.inverses = bin_edges(n, bins), []
        for a, b in zip(self.edges, self.edges[1:], strict=False):
            part = f[:, a:b]
            cov = (part @ part.conj().T).real / max(b - a, 1) / n
            cov += np.eye(len(cov)) * (1e-6 * np.trace(cov) / len(cov) + 1e-12)
            own = low_rank(cov.ravel(), modes)
            v = np.array(own["v"]).reshape(len(cov), -1)
            full = np.diag(np.maximum(own["d"], 1e-6 * np.diag(cov))) + (v * own["e"]) @ v.T
            self.inverses.append(np.linalg.inv(full))

    def apply(self, d: np.ndarray) -> np.ndarray:
        f = np.fft.rfft(d)
        for (a, b), inv in zip(zip(self.edges, self.edges[1:], strict=False), self.inverses, strict=True):
            f[:, a:b] = inv @ f[:, a:b]
        return np.fft.irfft(f, d.shape[1])

    def white(self, d: np.ndarray) -> np.ndarray:
        """The same with the last bin's diagonal alone."""
        return np.diag(self.inverses[-1])[:, None] * d


def over_groups(df: DataFrame, group: str, det: str, at: str, value: str, f: Callable[[np.ndarray, pd.DataFrame, pd.DataFrame], np.ndarray], more: list[str] = []) -> DataFrame:  # noqa: B006
    """Replaces value by f(matrix, wide, frame) for each group's detectors x samples matrix."""
    keep = [group, det, at, *more]
    shape = T.StructType([*df.select(*keep).schema.fields, T.StructField(value, T.DoubleType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        wide = _wide(frame, det, at, value)
        return _long(frame, wide, f(wide.to_numpy(), wide, frame), det, at, value, keep)

    return df.select(*keep, value).groupBy(group).applyInPandas(run, shape)


def weighted(df: DataFrame, group: str, det: str, at: str, value: str, bins: int = 6, window: int = 0) -> DataFrame:
    """Inverse noise times data, the noise measured from the data; with a window, tapered before and after."""

    def f(d: np.ndarray, wide: pd.DataFrame, frame: pd.DataFrame) -> np.ndarray:
        n = d.shape[1]
        edge = np.minimum(np.arange(n), np.arange(n)[::-1])
        w = np.where(edge < window, 0.5 - 0.5 * np.cos(np.pi * (edge + 1) / (window + 1)), 1.0)
        return Measured(d, bins).apply(d * w) * w

    return over_groups(df, group, det, at, value, f)


def constrained(df: DataFrame, group: str, det: str, at: str, value: str, cut: str, bins: int = 4, steps: int = 50, rounds: int = 3) -> DataFrame:
    """Cut samples filled with the noise model's expectation given the others: solves for the cut part of N^-1 d = 0 by
    conjugate gradients; uncut samples stay, places that a detector lacks count as cut.

    Groups of at most `ENTRIES` entries and `DENSE` detectors are matrices in a task each. The detectors of larger ones are dealt into
    blocks of about `ENTRIES` entries, a block being one row. Their model is that of Measured, by the
    tree of factors of noisemodels.measured and never as a matrix of detectors by detectors: its inverse is a weight per detector and bin, less
    what goes through the sums over detectors of the few modes' series. So a step needs, of the other blocks, these sums and two
    scalars: two sums per group, all groups at a time.
    """

    def dense(d: np.ndarray, wide: pd.DataFrame, frame: pd.DataFrame) -> np.ndarray:
        mask = ~frame.pivot(index=det, columns=at, values=cut).reindex(index=wide.index, columns=wide.columns).eq(False).to_numpy()
        if not mask.any():
            return d
        k = np.arange(d.shape[1])
        full = np.array([np.interp(k, k[~m], x[~m]) if (~m).any() else np.zeros(len(k)) for x, m in zip(d, mask, strict=True)])
        for _ in range(rounds):  # the noise is measured anew from what the last round filled in
            mean = full.mean(axis=1, keepdims=True)
            model = Measured(full, bins)

            def apply(x: np.ndarray, model: Measured = model) -> np.ndarray:
                part = np.zeros_like(d)
                part[mask] = x
                return model.apply(part)[mask]

            known = np.where(mask, 0.0, d - mean)
            x, _ = conjugate_gradients(apply, -model.apply(known)[mask], steps=steps, enough=1e-8)
            full = np.where(mask, mean, d)
            full[mask] += x
        return full

    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    number = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = df.select(group, det, at, cut, number.alias(value), name.alias("_g"))
    dets = rows.select("_g", det).distinct().groupBy("_g").agg(F.count(F.lit(1)).alias("_dets"))
    ats = rows.select("_g", at).distinct().groupBy("_g").agg(F.sort_array(F.collect_list(at)).alias("_ats"))
    small = (F.col("_dets") <= DENSE) & (F.col("_dets") * F.size("_ats") <= ENTRIES)
    shapes = lineage.cut(dets.join(ats, "_g").select("_g", "_ats", small.alias("_small"), F.greatest(F.ceil(F.col("_dets") * F.size("_ats") / ENTRIES), F.lit(1)).alias("_blocks")))
    columns = [group, det, at, cut, value]
    rows = lineage.cut(rows.join(shapes.select("_g", "_blocks", "_small"), "_g").withColumn("_block", F.pmod(F.xxhash64(det), "_blocks")).drop("_blocks"))
    few = over_groups(rows.where("_small"), group, det, at, value, dense, [cut])
    shapes = shapes.where("NOT _small")
    if shapes.isEmpty():
        return few
    rows = rows.where("NOT _small")
    plan = shapes.select("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"), "_ats")

    def places(frame: pd.DataFrame, plan: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return pd.factorize(frame[det], sort=True, use_na_sentinel=False)[0], np.searchsorted(np.asarray(plan["_ats"].iloc[0]), frame[at].to_numpy())

    def gather(key: tuple, frame: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["_g", "_block", "m", "d", "mask", "full"])
        (i, t), n = places(frame, plan), len(plan["_ats"].iloc[0])
        if len(np.unique(i * n + t)) < len(frame):
            raise ValueError("a detector has two samples at one place")
        d, mask = np.zeros((i.max() + 1, n)), np.ones((i.max() + 1, n), bool)
        d[i, t], mask[i, t] = frame[value], ~frame[cut].eq(False).to_numpy(bool)
        k = np.arange(n)
        full = np.array([np.interp(k, k[~m], x[~m]) if (~m).any() else np.zeros(n) for x, m in zip(d, mask, strict=True)])
        return pd.DataFrame([(*key, len(d), d.tobytes(), mask.tobytes(), full.tobytes())], columns=["_g", "_block", "m", "d", "mask", "full"])

    def fill(key: tuple, own: pd.DataFrame, solved: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return own
        d, mask, full = _block(own.iloc[0])
        full = np.where(mask, full.mean(axis=1, keepdims=True), d)
        full[mask] += np.frombuffer(solved["x"].iloc[0])
        return own.assign(full=[full.tobytes()])

    def spread(key: tuple, frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(**{value: _block(own.iloc[0])[2][places(frame, own)]})[columns]

    both = lambda a, b, f, schema: a.groupBy(*KEYS).cogroup(b.groupBy(*KEYS)).applyInPandas(f, schema)
    shape = "_g string, _block long, m long, d binary, mask binary, full binary"
    blocks = lineage.cut(both(rows, plan, gather, shape))
    for _ in range(rounds):  # the noise is measured anew from what the last round filled in
        blocks = lineage.cut(both(blocks, _solved(blocks, bins, steps), fill, shape))
    return few.unionByName(both(rows, blocks.join(plan, KEYS), spread, rows.select(*columns).schema))


#: Entries (detectors by places) of a block.
ENTRIES = 1 << 17
#: Detectors of a group whose covariances are held as matrices.
DENSE = 1024
#: Modes that Measured takes at most.
MODES = 5
KEYS = ["_g", "_block"]
STATE = "_g string, _block long, n long, mask binary, w binary, u binary, core binary, x binary, r binary, p binary, rr double, first double, done boolean, sums array<double>"


def _block(own: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, mask and filled data of a block, detectors by places."""
    return tuple(np.frombuffer(own[c], kind).reshape(own["m"], -1) for c, kind in (("d", float), ("mask", bool), ("full", float)))


class _Part:
    """A block's share of a model: w (weight per detector and bin), u (modes times weights per bin, detector, mode), core (per bin, modes by
    modes: how sums come back)."""

    def __init__(self, n: int, edges: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, core: np.ndarray | None) -> None:
        self.n, self.bins, self.mask, self.w, self.u, self.core = n, list(zip(edges, edges[1:], strict=False)), mask, w, u, core

    @classmethod
    def of(cls, own: pd.Series, bins: int) -> _Part:
        n, edges = int(own["n"]), bin_edges(int(own["n"]), bins)
        b = len(edges) - 1
        mask, w = np.frombuffer(own["mask"], bool).reshape(-1, n), np.frombuffer(own["w"]).reshape(-1, b)
        return cls(n, edges, mask, w, np.frombuffer(own["u"]).reshape(b, -1, MODES), np.frombuffer(own["core"]).reshape(b, MODES, MODES))

    def spectrum(self, x: np.ndarray) -> np.ndarray:
        part = np.zeros(self.mask.shape)
        part[self.mask] = x
        return np.fft.rfft(part)

    def sums(self, f: np.ndarray) -> np.ndarray:
        """The modes' series by frequency, summed over the block's detectors."""
        return np.concatenate([self.u[k].T @ f[:, a:b] for k, (a, b) in enumerate(self.bins)], axis=1)

    def back(self, s: np.ndarray) -> np.ndarray:
        return np.concatenate([self.core[k] @ s[:, a:b] for k, (a, b) in enumerate(self.bins)], axis=1)

    def square(self, s: np.ndarray) -> float:
        """What the modes take off x N^-1 x, s being the whole group's sums of x."""
        twice = np.full(s.shape[1], 2.0)
        twice[0] = 1.0
        if self.n % 2 == 0:
            twice[-1] = 1.0
        return float((twice * (s.conj() * self.back(s)).real.sum(axis=0)).sum() / self.n)

    def own(self, f: np.ndarray) -> np.ndarray:
        """Weighted by detector and bin, at the cut samples."""
        return np.fft.irfft(np.concatenate([self.w[:, k, None] * f[:, a:b] for k, (a, b) in enumerate(self.bins)], axis=1), self.n)[self.mask]

    def apply(self, f: np.ndarray, s: np.ndarray) -> np.ndarray:
        """N^-1 times what has spectrum f and sums s in the whole group, at the cut samples."""
        c = self.back(s)
        shared = np.concatenate([self.u[k] @ c[:, a:b] for k, (a, b) in enumerate(self.bins)], axis=1)
        return self.own(f) - np.fft.irfft(shared, self.n)[self.mask]


def _flat(s: np.ndarray, *more: float) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(s).view(float).ravel(), more])


def _sums(flat: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(flat[: MODES * (n // 2 + 1) * 2]).view(complex).reshape(MODES, -1)


def _solved(blocks: DataFrame, bins: int, steps: int, enough: float = 1e-8) -> DataFrame:
    """_g, _block, x: what the cut samples of blocks deviate from their detectors' means (those of `full`)."""

    def spectra(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        full = _block(own.iloc[0])[2]
        f = np.fft.rfft(full - full.mean(axis=1, keepdims=True))
        f[:, 0] = 0
        i, k = (x.ravel() for x in np.indices(f.shape))
        bin = np.searchsorted(bin_edges(full.shape[1], bins), k, side="right") - 1
        return pd.DataFrame({"_g": key[0], "_d": (key[1] << 32) + i, "n": full.shape[1], "bin": bin, "k": k, "re": f.real.ravel(), "im": f.imag.ravel()})

    rows = blocks.groupBy(*KEYS).applyInPandas(spectra, "_g string, _d long, n long, bin int, k long, re double, im double")
    diag, vectors, strengths = nm.measured(rows, "_g", "_d", MODES)
    modes = vectors.withColumnRenamed("set", "bin").join(strengths, ["_g", "bin", "mode"])
    model = diag.select("_g", "_d", "bin", F.lit(-1).alias("mode"), F.col("d").alias("v"), F.lit(0.0).alias("e")).unionByName(modes.select("_g", "_d", "bin", "mode", "v", "e"))
    model = model.select("_g", F.shiftright("_d", 32).alias("_block"), F.col("_d").bitwiseAND(F.lit((1 << 32) - 1)).alias("i"), "bin", "mode", "v", "e")

    def begin(key: tuple, own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        d, mask, full = _block(own.iloc[0])
        n, edges = d.shape[1], bin_edges(d.shape[1], bins)
        w, v, ie = np.zeros((len(d), len(edges) - 1)), np.zeros((len(edges) - 1, len(d), MODES)), np.ones((len(edges) - 1, MODES))
        first = model[model["mode"] < 0]
        w[first["i"], first["bin"]] = 1 / first["v"]
        more = model[model["mode"] >= 0]
        v[more["bin"], more["i"], more["mode"]] = more["v"]
        ie[more["bin"], more["mode"]] = 1 / more["e"]
        u = v * w.T[:, :, None]
        core = np.einsum("bim,bij->bmj", v, u)
        known = np.where(mask, 0.0, d - full.mean(axis=1, keepdims=True))
        s = _Part(n, edges, mask, w, u, None).sums(np.fft.rfft(known))
        return state(key, n, mask, w, u, ie, b"", b"", known, 0.0, None, False, _flat(s, *core.ravel()))

    def state(*values: object) -> pd.DataFrame:
        key, *rest = values
        return pd.DataFrame([(*key, *[x.tobytes() if isinstance(x, np.ndarray) and k < len(rest) - 1 else x for k, x in enumerate(rest)])], columns=[c.split()[0] for c in STATE.split(", ")])

    def right(key: tuple, own: pd.DataFrame, whole: pd.DataFrame) -> pd.DataFrame:
        """The right side, from the sums over all blocks: -N^-1 times the known samples."""
        one, total = own.iloc[0], np.asarray(whole["sums"].iloc[0])
        n, mask = int(one["n"]), np.frombuffer(one["mask"], bool).reshape(-1, int(one["n"]))
        b = len(bin_edges(n, bins)) - 1
        ie = np.frombuffer(one["core"]).reshape(b, MODES)
        core = np.linalg.inv(total[-b * MODES * MODES :].reshape(b, MODES, MODES) + ie[:, :, None] * np.eye(MODES))
        part = _Part.of(one.to_dict() | {"core": core.tobytes()}, bins)
        r = -part.apply(np.fft.rfft(np.frombuffer(one["p"]).reshape(mask.shape)), _sums(total, n))
        return state(key, n, mask, part.w, part.u, core, np.zeros(len(r)), r, np.zeros(len(r)), 0.0, None, False, np.array([r @ r]))

    def turn(key: tuple, own: pd.DataFrame, whole: pd.DataFrame) -> pd.DataFrame:
        """First half of a step of numerics.conjugate_gradients: from r r to the new p, of which the sums are needed."""
        one, rr = own.iloc[0], whole["sums"].iloc[0][-1]
        first = rr if pd.isna(one["first"]) else one["first"]
        if one["done"] or first == 0 or rr / first < enough:
            return own.assign(done=True)
        part, x, r, p = _Part.of(one, bins), *(np.frombuffer(one[c]) for c in ("x", "r", "p"))
        p = r + (rr / one["rr"] if one["rr"] else 0.0) * p
        f = part.spectrum(p)
        return state(key, part.n, part.mask, part.w, part.u, part.core, x, r, p, rr, first, False, _flat(part.sums(f), p @ part.own(f)))

    def move(key: tuple, own: pd.DataFrame, whole: pd.DataFrame) -> pd.DataFrame:
        """Second half: a step along p."""
        one = own.iloc[0]
        if one["done"]:
            return own
        part, x, r, p = _Part.of(one, bins), *(np.frombuffer(one[c]) for c in ("x", "r", "p"))
        total = np.asarray(whole["sums"].iloc[0])
        s = _sums(total, part.n)
        alpha = one["rr"] / (total[-1] - part.square(s))
        x, r = x + alpha * p, r - alpha * part.apply(part.spectrum(p), s)
        return state(key, part.n, part.mask, part.w, part.u, part.core, x, r, p, one["rr"], one["first"], False, np.array([r @ r]))

    spark, folder, turns = blocks.sparkSession, f"{lineage.shared_dir(blocks.sparkSession)}/gaps-{uuid.uuid4().hex}", itertools.count()

    def stored(state: DataFrame) -> DataFrame:
        """Of the tables of states there are two, written by turns; files, as checkpoints would keep sizes that are estimated from step to step."""
        state.write.mode("overwrite").parquet(path := f"{folder}/{next(turns) % 2}")
        return spark.read.schema(STATE).parquet(path)

    def together(state: DataFrame, f: Callable) -> DataFrame:
        each = state.select("_g", F.posexplode("sums").alias("_i", "_v")).groupBy("_g", "_i").agg(F.sum("_v").alias("_v"))
        whole = each.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("sums"))
        return stored(state.groupBy(*KEYS).cogroup(keys.join(whole, "_g").groupBy(*KEYS)).applyInPandas(f, STATE))

    keys = blocks.select(*KEYS)
    found = together(stored(blocks.groupBy(*KEYS).cogroup(model.groupBy(*KEYS)).applyInPandas(begin, STATE)), right)
    for _ in range(steps):
        found = together(found, turn)
        if found.where("NOT done").isEmpty():
            break
        found = together(found, move)
    return found.select(*KEYS, "x")


def cut_basis(n: int, kind: str) -> np.ndarray:
    """Columns that stand for the n samples of a cut: `full` (one each), `none`, `bin:k` (means of k samples), `poly:m`
    (m Legendre polynomials), `exp` (bins that grow from both ends)."""
    name, _, arg = kind.partition(":")
    k = np.arange(n)
    if name == "none":
        return np.zeros((n, 0))
    if name == "full":
        return np.eye(n)
    if name == "bin":
        groups = k // int(arg)
    elif name == "exp":
        groups = np.unique(np.where(k < n / 2, np.log2(k + 1).astype(int), 1000 - np.log2(n - k).astype(int)), return_inverse=True)[1]
    elif name == "poly":
        return legendre(k.astype(float), min(int(arg), n))
    else:
        raise ValueError(f"unknown cut type {kind}")
    return (groups[:, None] == np.arange(groups.max() + 1)).astype(float)


#: Entries of bases that are kept, and given out, at a time.
BASES = 200_000


def cut_parameters(ranges: DataFrame, key: list[str], kind: str) -> DataFrame:
    """The bases of many cuts as rows: key, lo (the range's start), i (place in it), j (parameter), v; zeros are left out. Ranges are
    taken where they lie, those of one length at a time, as they have the same basis."""
    kinds = dict(ranges.dtypes)

    def run(frames: object) -> object:
        known: dict = {}
        for frame in frames:
            for n, same in frame.groupby(frame["hi"] - frame["lo"]):
                if n not in known:
                    known.clear() if sum(len(x[0]) for x in known.values()) > BASES else None
                    b = cut_basis(int(n), kind)
                    known[n] = (*(found := np.nonzero(np.abs(b) > 1e-12)), b[found].astype(float))
                i, j, v = known[n]
                step = max(1, BASES // max(1, len(i)))
                for k in range(0, len(same), step):
                    part = same.iloc[k : k + step]
                    own = {c: np.repeat(part[c].to_numpy(), len(i)) for c in (*key, "lo")}
                    yield pd.DataFrame({**own, "i": np.tile(i, len(part)), "j": np.tile(j, len(part)), "v": np.tile(v, len(part))})

    schema = ", ".join(f"{c} {kinds[c]}" for c in key) + ", lo int, i int, j int, v double"
    return ranges.select(*key, "lo", "hi").where("lo < hi").mapInPandas(run, schema)
