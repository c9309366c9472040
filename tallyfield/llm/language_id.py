"""Language identification by string kernels.

The kernel of two texts is the cosine of their presence vectors over a blended spectrum: all character n-grams of
1 to `ORDERS` characters, hashed to `BINS` places, each present or not however often it occurs. `LANDMARKS` texts give
the Nyström map phi(x) = K_mm^(-1/2) k_m(x); one-versus-rest kernel ridge regression in that space has a closed form.
A batch of texts is scored as (presence matrix) @ (landmark matrix) @ (weights): the last two are multiplied
once, so that a batch takes one product.

Fitted on about `PER_LANG` rows per language (the bound is this parameter), chosen by a hash of doc_id among rows whose
crc32(doc_id) mod 4 is not 2, with non-null lang and some letter. lang, source and doc_id are never inputs of a prediction.

Defined cases: a null text or one without letters is `und` with score 0; whole texts are read, of any length (batches are
cut by their characters); equal texts get equal predictions, so repeated rows do; other columns are not looked at;
ties go to the first language in alphabetical order; if nothing can be learned (no labelled rows), all rows are `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .samples import by_size, is_held_out, sample_per_class

ORDERS = 4
BINS = 1 << 14
LANDMARKS = 128
PER_LANG = 300
RIDGE = 1e-2
#: Odd multipliers that spread n-grams over the bins (fixed values).
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def presence(texts: list[str], orders: int = ORDERS, bins: int = BINS) -> np.ndarray:
    """Rows of unit length: which n-grams a text has. N-grams don't reach across texts."""
    low = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) for t in low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(low)), sizes)
    out = np.zeros((len(low), bins), np.float32)
    flat = out.ravel()
    shift = np.uint64(64 - bins.bit_length() + 1)
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, orders + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = (h[:m] * _MIX[1]) ^ (codes[n - 1 :] + np.uint64(n))
        h = h * _MIX[0]
        inside = row[:m] == row[n - 1 :]
        place = ((h ^ (h >> np.uint64(29))) * _MIX[1]) >> shift
        flat[(row[:m] * bins + place.astype(np.int64))[inside]] = 1.0
    size = np.sqrt(out.sum(axis=1, keepdims=True))
    return out / np.where(size == 0, 1, size)


def fit(rows: list, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """(languages, BINS x languages matrix) from rows of (text, lang)."""
    langs = sorted({r.lang for r in rows})
    x = np.vstack([presence([r.text]) for r in rows])
    y = np.array([[1.0 if r.lang == v else -1.0 for v in langs] for r in rows])
    each = max(1, landmarks // len(langs))
    chosen = [i for v in langs for i in [k for k, r in enumerate(rows) if r.lang == v][:each]]
    marks = x[chosen]
    kmm = (marks @ marks.T).astype(float)
    values, vectors = np.linalg.eigh(kmm)
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    phi = (x @ marks.T) @ root
    weights = np.linalg.solve(phi.T @ phi + ridge * len(rows) * np.eye(len(chosen)), phi.T @ y)
    return langs, (marks.T @ (root @ weights)).astype(np.float32)


def train(docs: DataFrame, per_lang: int = PER_LANG, seed: int = 17) -> tuple[list[str], np.ndarray] | None:
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~is_held_out()).select("doc_id", "text", "lang")
    rows = sample_per_class(usable, "lang", per_lang, seed)
    return fit(rows) if rows else None


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray] | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, lang_pred, score. Partitions are scored where they lie; no shuffle."""
    langs, weights = model or ([], None)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in by_size(frame.assign(text=frame["text"].fillna(""))):
                lang, best = np.array(["und"] * len(part), object), np.zeros(len(part))
                texts = part["text"].tolist()
                for at in range(0, len(texts) if langs else 0, 256):
                    own = texts[at : at + 256]
                    z = presence(own) @ weights
                    top = z.argmax(axis=1)
                    e = np.exp(4.0 * (z - z.max(axis=1, keepdims=True)).astype(float))
                    p = e.max(axis=1) / e.sum(axis=1)
                    for i, t in enumerate(own):
                        if any(map(str.isalpha, t)):
                            lang[at + i], best[at + i] = langs[top[i]], p[i]
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": lang, "score": best})

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", is_held_out().alias("held_out"), "text")
    return rows.mapInPandas(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op4_string_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))


QUERIES = {"op4_string_kernel_langid": op4_string_kernel_langid}
ORACLE: dict[str, str] = {}
