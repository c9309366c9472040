"""Cutoffs hold only in the strata that prove them, and keep their promise there."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tallyfield.llm import quality_rules as qr

SHAPE = "doc_id long, lang string, good boolean, base_failed boolean, " + ", ".join(f"{r} double" for r in qr.RULES)


def frame(spark, rows):
    return spark.createDataFrame([(k, lang, good, False, *numbers) for k, (lang, good, numbers) in enumerate(rows)], SHAPE)


def test_no_cutoff_from_other_strata(spark):
    """`en` proves a cutoff of upper_share; `rare` (few labels) and `new` (none) have good rows above it."""
    plain = [0.0] * len(qr.RULES)
    shout = [0.9 if r == "upper_share" else 0.0 for r in qr.RULES]
    made = [("en", True, plain, 600), ("en", False, shout, 200), ("rare", True, shout, 2), ("new", True, shout, 10)]
    df = frame(spark, [(lang, good, numbers) for lang, good, numbers, n in made for _ in range(n)])
    found = qr.cutoffs(df.where("lang <> 'new'"))
    assert set(found.least) == {"en"}
    kept = df.withColumn("kept", qr.verdict(found)).groupBy("lang", "good").agg(F.min("kept").alias("all"), F.max("kept").alias("any")).collect()
    assert {(r.lang, r.good): (r["all"], r["any"]) for r in kept} == {("en", True): (True, True), ("en", False): (False, False), ("rare", True): (True, True), ("new", True): (True, True)}


@pytest.mark.parametrize("seed", range(4))
def test_promise_on_rows_never_seen(spark, seed):
    """Labels that overlap: each stratum loses at most RISK of fresh good rows (the bound holds with probability 1 - DELTA)."""
    rng = random.Random(seed)

    def rows(n):
        out = []
        for k in range(n):
            good = rng.random() > 0.25
            out.append((None if k % 3 == 0 else "x", good, [min(1.0, rng.random() ** 3 * (0.5 if good else 1.2)) for _ in qr.RULES]))
        return out

    found = qr.cutoffs(frame(spark, rows(4000)))
    lost = frame(spark, rows(8000)).withColumn("kept", qr.verdict(found)).where("good").groupBy("lang").agg(F.avg((~F.col("kept")).cast("int")).alias("lost")).collect()
    assert all(r.lost <= qr.RISK for r in lost)


def test_cutoffs_act_and_tests_are_exact(spark):
    """Two strata lose their bad rows at any size that proves it; a stratum's number of good rows decides, not its share."""
    flat, bad = [0.01] * len(qr.RULES), [0.01] * (len(qr.RULES) - 1) + [0.8]
    df = frame(spark, [(lang, good, flat if good else bad) for lang, n in (("a", 400), ("b", 60)) for k in range(n) for good in (k % 5 > 0,)])
    found = qr.cutoffs(df)
    n = {r.lang: r.n for r in df.where(F.col("good") & (F.pmod(F.xxhash64(F.lit(41), "doc_id"), F.lit(256)) >= qr.FIT)).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert set(found.least) == {s for s, k in n.items() if (1 - qr.RISK) ** k <= qr.DELTA / 2} == {"a"}
    assert df.where((F.col("lang") == "a") & qr.verdict(found)).where("NOT good").count() == 0
    assert qr.cutoffs(df.limit(0)).least == {}
    assert qr.binomial_tail(3, 10, 0.4) == pytest.approx(0.3822806016)
    assert qr.holds(0, 59, 0.05, 0.05) and not qr.holds(0, 58, 0.05, 0.05)


def test_it_decides_on_the_given_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = qr.op5_risk_controlled_rules(spark, d).join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id", "left").collect()
    assert sum(not r.base_failed and not r.kept for r in rows) > 20
    for lang in {r.lang for r in rows}:
        good = [r for r in rows if r.lang == lang and r.quality and not r.base_failed]
        assert sum(not r.kept for r in good) <= qr.RISK * len(good)
