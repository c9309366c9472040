"""Quality classification as ordinal regression with cumulative links.

Ratings are graded: 0 for toxic text, 1 for poor text that is not toxic, 2 for good text. One weight vector over hashed
words (shared by all grades) gives a text's position z; ordered thresholds a < b give P(grade >= 1) = s(z - a) and
P(grade >= 2) = s(z - b). Weights and thresholds maximise the likelihood of the grades, P(0) = 1 - s(z - a), P(1) =
s(z - a) - s(z - b), P(2) = s(z - b). The expected grade is the sum of the two tails. A text is selected if its tail
probability P(grade >= 2) reaches the level that all but a share `LOSE` of the good texts reach in a quarter of the sample that
isn't fitted on.

Features are the presence of each word (case-folded, without outer marks), of word shapes and of repeats, hashed to
`BINS` places; an L1 term leaves weight on few of them, whatever a text's length. Fitted on about `PER_GRADE` labelled rows
per grade (the bound is this parameter), chosen by a hash of doc_id, each weighted by how many labelled rows of its grade
it stands for, so that probabilities are those of all labelled rows; everything is scored.

Defined cases: a null or empty text has no feature but the constant; labels that are null or have no document take no
part; a document rated twice counts twice; equal texts get equal scores; very long texts are read whole, a word counts
once; other columns are not looked at; without labels all probabilities are 0 and nothing is selected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BINS = 1 << 16
PER_GRADE = 1500
LOSE = 0.015
SPARSE = 5e-4
GRADES = 3
#: Least distance between neighbouring thresholds.
GAP = 0.05
#: Shares of words that carry marks, are in capitals, or are the commonest word; in tenths.
SHAPE = ("marked", "upper", "top")
SHAPES = [f"\x00{name}:{k}" for name in SHAPE for k in range(10)]
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}«»|#*$%&<>=-"


def bin_of(word: str, bins: int = BINS) -> int:
    """A stable hash of a word (FNV-1a, 32 bits) folded into the bins."""
    h = 0x811C9DC5
    for b in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return (h ^ (h >> 16)) % bins


class Features:
    """Sparse features of a text; words' bins are remembered up to a bounded number of words."""

    def __init__(self, bins: int = BINS, most: int = 200_000) -> None:
        self.bins, self.most, self.known = bins, most, {}

    def place(self, word: str) -> int:
        at = self.known.get(word)
        if at is None:
            if len(self.known) >= self.most:
                self.known.clear()
            at = self.known[word] = bin_of(word, self.bins)
        return at

    def __call__(self, text: str) -> np.ndarray:
        words = Counter(_WORD.findall(text))
        n = sum(words.values())
        found: set[int] = set()
        place = self.place
        marked = upper = most = 0
        for w, k in words.items():
            low = w.strip(_EDGE).lower()
            if low:
                found.add(place(low))
            if w[-1] in "#*$%&|<>!" or w[0] in "#*$%&|<>":
                marked += k
            if len(w) > 1 and w.isupper():
                upper += k
            most = max(most, k)
        for name, share in zip(SHAPE, (marked, upper, most if n >= 20 else 0), strict=True):
            found.add(place(f"\x00{name}:{min(9, int(10 * share / max(n, 1)))}"))
        return np.fromiter(found, np.int64, len(found))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def slopes(z: float, cuts: np.ndarray, grade: int) -> tuple[float, np.ndarray]:
    """Derivatives of the negative log-likelihood of one grade by z and by each threshold."""
    p = np.concatenate([[1.0], sigmoid(z - cuts), [0.0]])
    steep = p * (1 - p)
    here = max(p[grade] - p[grade + 1], 1e-9)
    by_cut = np.zeros(len(cuts))
    if grade > 0:
        by_cut[grade - 1] = steep[grade] / here
    if grade < len(cuts):
        by_cut[grade] = -steep[grade + 1] / here
    return float(p[grade] + p[grade + 1] - 1), by_cut


def fit(
    texts: list[str], grades: np.ndarray, stands_for: np.ndarray | None = None, epochs: int = 40, rate: float = 0.3, sparse: float = SPARSE, seed: int = 3
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and the GRADES - 1 ordered thresholds: adaptive dual averaging with an L1 term on the negative log-likelihood
    of the grades. A word keeps weight only if its mean gradient over all steps exceeds `sparse`, so that the many rare
    words of long texts add nothing; word shapes are exempt. stands_for: per grade, rows that a row of it stands for."""
    features = Features()
    feats = [features(t) for t in texts]
    g1, g2 = np.zeros(BINS), np.full(BINS, 1e-3)
    cuts, c2 = np.linspace(-1, 1, GRADES - 1), np.full(GRADES - 1, 1e-3)
    stands_for = np.ones(GRADES) if stands_for is None else stands_for
    cost = stands_for / stands_for[grades].mean()
    bar = np.full(BINS, sparse)
    bar[[features.place(name) for name in SHAPES]] = 0
    weight = lambda at, t: -rate * np.sign(g1[at]) * np.maximum(np.abs(g1[at]) - bar[at] * t, 0) / np.sqrt(g2[at])
    rng, t = np.random.default_rng(seed), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            at = feats[i]
            by_z, by_cut = slopes(weight(at, t).sum(), cuts, grades[i])
            by_z, by_cut = by_z * cost[grades[i]], by_cut * cost[grades[i]]
            g1[at] += by_z
            g2[at] += by_z**2
            c2 += by_cut**2
            cuts = np.maximum.accumulate(cuts - rate * by_cut / np.sqrt(c2) - np.arange(GRADES - 1) * GAP) + np.arange(GRADES - 1) * GAP
            t += 1
    return weight(np.arange(BINS), t).astype(np.float32), cuts


def train(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE, seed: int = 29) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Weights, thresholds and the least tail probability that selects."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    marks = marks.select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).otherwise(2).alias("grade"))
    # The sample is drawn from the labels alone; texts join to the bounded sample only.
    counts = {r.grade: r.n for r in marks.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = 1 << 30
    at = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(steps))
    keep = F.lit(False)
    for grade, n in counts.items():
        keep = keep | ((F.col("grade") == grade) & (at < int(steps * min(1.0, per_grade / n))))
    sample = marks.where(keep)
    # About per_grade rows a grade, whatever the input, so the sample is broadcast and no text is shuffled.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").orderBy(at, "doc_id").collect()
    if not rows:
        return None
    texts, grades = [r.text or "" for r in rows], np.array([r.grade for r in rows])
    held = np.arange(len(rows)) % 4 == 3
    drawn = np.maximum(np.bincount(grades, minlength=GRADES), 1)
    stands_for = np.array([counts.get(g, 0) for g in range(GRADES)]) / drawn
    weights, cuts = fit([t for t, h in zip(texts, held, strict=True) if not h], grades[~held], stands_for)
    features = Features()
    good = [sigmoid(weights[features(t)].sum() - cuts[-1]) for t, h, g in zip(texts, held, grades, strict=True) if h and g == GRADES - 1]
    return weights, cuts, float(np.quantile(good, LOSE)) if good else 0.5


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None) -> DataFrame:
    """doc_id, expected_grade, p_not_toxic (grade >= 1), p_good (grade >= 2), selected; row by row, no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for frame in frames:
            z = np.array([model[0][features(t or "")].sum() if model else 0.0 for t in frame["text"]], float).reshape(-1, 1)
            p = sigmoid(z - model[1]) if model else np.zeros((len(frame), GRADES - 1))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "expected_grade": p.sum(axis=1), "p_not_toxic": p[:, 0], "p_good": p[:, 1], "selected": p[:, 1] >= (model[2] if model else 1.0)})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, expected_grade double, p_not_toxic double, p_good double, selected boolean")


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_ordinal_quality": op7_ordinal_quality}
ORACLE: dict[str, str] = {}
