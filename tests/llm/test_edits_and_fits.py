"""Slot maps that are edited where they are stored; the ordinal fit against a plain maximiser."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F
from tallyfield.llm import grading, sharding


def shards_of(docs, slot_map):
    """Bytes by shard under a map, hashing every row anew."""
    runs = sharding.keyed(docs, len(slot_map.shard_of)).groupBy("vslot").agg(F.sum(F.col("size") * F.col("copies")).alias("b")).collect()
    out = [0] * slot_map.shards
    for r in runs:
        out[slot_map.shard_of[r.vslot]] += r.b
    return out


def test_stored_maps_are_edited(spark, tiny, tmp_path):
    docs, path = spark.read.parquet(f"{tiny}/documents.parquet"), str(tmp_path / "map")
    _, first, _ = sharding.shard_rows(docs, path=path)
    assert sharding.SlotMap.latest(spark, path).version == 1
    assert sharding.edit(docs, path, tolerance=0.5).version == 1  # near equal already: nothing is stored
    grown = sharding.edit(docs, path, grow=True)
    kept = sharding.SlotMap.latest(spark, path)
    assert kept.version == grown.version == 2 and kept.shard_of == grown.shard_of and kept.shards == 25
    assert all(b in (a, 24) for a, b in zip(first.shard_of, kept.shard_of, strict=True))
    # The corpus changes: half of the rows go, others come twice as long. The map follows, most slots stay.
    other = docs.where("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.repeat("text", 3)).otherwise(F.col("text")))
    before, largest = shards_of(other, kept), sharding.keyed(other).agg(F.max(F.col("size") * F.col("copies"))).first()[0]
    edited = sharding.edit(other, path)
    after = shards_of(other, edited)
    assert edited.version == 3 and sum(after) == sum(before) and max(after) < max(before)
    assert max(after) <= max(1.01 * sum(after) / 25, min(after) + 2 * largest)
    changed = sum(a != b for a, b in zip(kept.shard_of, edited.shard_of, strict=True))
    assert 0 < changed == len(set(edited.moved)) < len(kept.shard_of) / 4
    assert sharding.SlotMap.load(spark, path, 1).shard_of == first.shard_of


def test_rebalancing_moves_what_fits():
    one = sharding.SlotMap(2, (0, 0, 0, 1))
    two = one.rebalance({0: 5, 1: 3, 2: 2, 3: 1})
    assert two.version == 2 and sorted(sum((5, 3, 2, 1)[k] for k, s in enumerate(two.shard_of) if s == x) for x in (0, 1)) == [4, 7]
    assert one.rebalance({0: 100}) is one  # a slot is never cut
    assert sharding.SlotMap(3, (0, 1, 2)).rebalance({}).version == 1


def test_the_fit_reaches_the_likelihood_of_a_plain_maximiser():
    """On a small vocabulary, without the penalty, the mean negative log-likelihood is near that of full gradient steps on it."""
    rng = random.Random(4)
    vocabulary = [f"word{k}" for k in range(12)]
    pull = np.linspace(-2, 2, 12)
    texts, grades = [], []
    for _ in range(400):
        own = rng.sample(range(12), 4)
        z = sum(pull[k] for k in own) + rng.gauss(0, 1.5)
        texts.append(" ".join(vocabulary[k] for k in own))
        grades.append(0 if z < -1 else 1 if z < 1.5 else 2)
    grades = np.array(grades)
    features = grading.Features()
    feats = [features(t) for t in texts]

    def mean_loss(weights: np.ndarray, cuts: np.ndarray) -> float:
        out = 0.0
        for at, g in zip(feats, grades, strict=True):
            p = np.concatenate([[1.0], grading.sigmoid(weights[at].sum() - cuts), [0.0]])
            out -= np.log(max(p[g] - p[g + 1], 1e-12))
        return out / len(feats)

    places = sorted({int(k) for f in feats for k in f})
    x = np.zeros((len(feats), len(places)))
    for i, f in enumerate(feats):
        x[i, [places.index(int(k)) for k in f]] = 1
    w, cuts = np.zeros(len(places)), np.array([-1.0, 1.0])
    for _ in range(1200):
        by = [grading.slopes(z, cuts, g) for z, g in zip(x @ w, grades, strict=True)]
        w -= 0.6 * x.T @ np.array([a for a, _ in by]) / len(by)
        cuts = np.sort(cuts - 0.3 * np.mean([b for _, b in by], axis=0))
    dense = np.zeros(grading.BINS)
    dense[places] = w
    best = mean_loss(dense, cuts)
    got = mean_loss(*grading.fit(texts, grades, sparse=0.0, epochs=60))
    assert best - 1e-3 <= got <= best + 0.03 and best < 0.95 * mean_loss(np.zeros(grading.BINS), np.array([-1.0, 1.0]))
