"""Signatures and links of near duplicates: what they cost, and that the cheaper ways give the same."""

from __future__ import annotations

import collections
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_at_size import on_disk

from tallyfield.llm import near_dedup as nd


def test_short_texts_take_few_steps(monkeypatch):
    calls = []
    own = nd.mixed
    monkeypatch.setattr(nd, "mixed", lambda z: calls.append(1) or own(z))
    n = 100  # a text of one shingle makes all its points in one process; one point a step took over 1,700 steps
    sig = nd.bag_minhash(np.arange(n), own(np.arange(1, n + 1).astype(np.uint64)), np.ones(n, np.int64), n)
    assert np.isfinite(sig).all() and len(calls) < 200


def test_signatures_depend_on_the_text_alone():
    rng = np.random.default_rng(3)
    h = nd.mixed(rng.integers(1, 1 << 60, 500).astype(np.uint64))
    row, count = np.sort(rng.integers(0, 7, 500)), rng.choice([1, 1, 2, 3, 9, 40], 500)
    together = nd.bag_minhash(row, h, count, 7)
    for k in range(7):
        at = row == k
        assert (nd.bag_minhash(np.zeros(at.sum(), int), h[at], count[at], 1)[0] == together[k]).all()


def test_words_are_hashed_from_bytes():
    texts = ["", "a", " a", "b a\x0b", "\r\n", "été 日本語 \x1c \xa0", "x" * 8 + " " + "x" * 16 + " " + "x" * 17, "12345678 1234567", "a"]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    for kind in (pa.string(), pa.large_string()):
        for skip in (0, 2):
            h, sizes = nd.hashed_words(pa.array(texts, kind).slice(skip))
            flat = [w for ws in words[skip:] for w in ws]
            assert sizes.tolist() == [len(ws) for ws in words[skip:]]
            assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


def test_sets_keep_the_weighted_similarity():
    lists = [[1, 2, 3, 4, 5, 6] * 3, [1, 2, 3, 4, 5, 6] * 2 + [7], [8], [8, 8, 8]]
    bags = nd._bags(pa.array(lists, pa.list_(pa.int64())))
    count = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in lists]
    for p, a in enumerate(count):
        for q, b in enumerate(count):
            both = sum((a & b).values())
            assert nd.overlap(bags[p], bags[q]) == both / (sum(a.values()) + sum(b.values()) - both)


def test_only_signatures_of_open_buckets_are_sent(spark):
    """Two texts of 3,000 meet in blocks: the files that tasks write for others hold no signature of the rest."""
    sig = spark.range(3000).select(F.col("id").alias("v"), F.transform(F.sequence(F.lit(0), F.lit(nd.M - 1)), lambda k: F.pmod(F.xxhash64(F.when(F.col("id") > 1, F.col("id")).otherwise(0), k), F.lit(32767)).cast("short")).alias("sig"))
    sig = nd.stage(sig, "test-signs")
    held = sig.select("v", F.sequence(F.lit(1).cast("long"), F.lit(40).cast("long")).alias("words"))
    rows = spark.createDataFrame([(7, 0, 0, 0), (7, 0, 1, 1)], "bucket long, band int, v long, c long")
    top = spark.createDataFrame([(7, 0, 1, 1)], "bucket long, most long, n_in long, n_out long")
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        before = on_disk(spark)
        assert [set(r) for r in nd.block_links(rows, top, sig, held).collect()] == [{0, 1}]
        assert sum(b for name, b in on_disk(spark).items() if name not in before) < 200_000 < 3000 * nd.M * 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
