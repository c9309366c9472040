"""Queries and operators cover all rows of their tables, not a subset."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest
from tallyfield import catalog
from tallyfield.operators import catalogs
from tallyfield.operators import flags as fl
from tallyfield.suite import grids
from tallyfield.suite.base import samples


@pytest.fixture(scope="module")
def values(spark, tiny):
    """Detector -> all of its values in order."""
    out = collections.defaultdict(list)
    for r in samples(spark, tiny).orderBy("det", "sample").collect():
        out[r.det].append(r.value)
    return out


@pytest.mark.parametrize("name", ["highpass", "bandpass", "hwp_notch", "broaden_beam"])
def test_filters_keep_every_sample(spark, tiny, values, name):
    assert max(map(len, values.values())) > 48
    assert {r.det: len(r.v) for r in catalog.QUERIES[name](spark, tiny).collect()} == {d: len(v) for d, v in values.items()}


def test_spectra_see_every_sample(spark, tiny, values):
    for r in catalog.QUERIES["power_spectra"](spark, tiny).collect():
        v = np.array(values[r.det])
        assert np.allclose(r.p, np.abs(np.fft.rfft(v - v.mean())) ** 2 / len(v))


def test_covariance_of_all_detectors(spark, tiny, values):
    got = {(r.i, r.j): r.cov for r in catalog.QUERIES["covariance"](spark, tiny).collect()}
    want = {(i, j): [x * y for x, y in zip(a, b[1:])] for i, a in values.items() for j, b in values.items()}
    assert set(got) == {k for k, v in want.items() if v}
    assert all(abs(got[k] - sum(want[k]) / len(want[k])) < 1e-3 for k in got)


def near(a, b, radius: float, period: float) -> bool:
    dx = a[0] - b[0]
    return math.hypot(dx - round(dx / period) * period, a[1] - b[1]) <= radius


def test_independent_groups_cover_the_catalogue(spark, tiny):
    """The sets are those of one greedy pass after the other at radius 20."""
    rest = {r.id: (r.px, r.py) for r in grids.cat(spark, tiny).collect()}
    want: dict = {}
    while rest:
        kept: dict = {}
        for i in sorted(rest):
            if not any(near(rest[i], q, 20.0, 400.0) for q in kept.values()):
                kept[i] = rest[i]
        want |= dict.fromkeys(kept, max(want.values(), default=-1) + 1)
        rest = {i: p for i, p in rest.items() if i not in kept}
    assert {r.id: r.grp for r in catalog.QUERIES["independent_groups"](spark, tiny).collect()} == want


def test_independent_keeps_many_rows_at_one_place(spark):
    same = spark.range(250).selectExpr("id", "1.0D x", "1.0D y")
    assert sorted((r.id, r.grp) for r in catalogs.independent(same, "id", "x", "y", 2.0).collect()) == [(k, k) for k in range(250)]


def test_first_wins_decides_every_row_or_raises(spark):
    chain = spark.range(60).selectExpr("id", "id * 1.0D x", "0.0D y", "-id * 1.0D s")
    assert sorted(r.id for r in catalogs.first_wins(chain, "id", "x", "y", 1.0, "s").where("keep").collect()) == list(range(0, 60, 2))
    twice = spark.createDataFrame([(1, 0.0, 0.0, 3.0), (1, 0.0, 0.0, 1.0), (2, 0.5, 0.0, 2.0)], "id long, x double, y double, s double")
    with pytest.raises(RuntimeError, match="unique"):
        catalogs.first_wins(twice, "id", "x", "y", 1.0, "s").collect()


def test_tag_queries_see_every_row(spark, tiny):
    events = spark.read.parquet(f"{tiny}/events.parquet").select("user_id", "event_type").collect()
    tags = collections.defaultdict(set)
    for r in events:
        tags[r.user_id].add(r.event_type)
    got = {r.id: {t for t in ("click", "error", "purchase") if r[t]} for r in catalog.QUERIES["tag_pivot"](spark, tiny).collect()}
    assert got == {u: t & {"click", "error", "purchase"} for u, t in tags.items()}
    customers = {r[0] for r in spark.read.parquet(f"{tiny}/customer.parquet").select("c_custkey").collect()}
    assert customers <= {r.id for r in catalog.QUERIES["tag_merge_outer"](spark, tiny).where("amount IS NOT NULL").collect()}
    sent_back = {tuple(r) for r in spark.read.parquet(f"{tiny}/lineitem.parquet").where("l_returnflag = 'R'").select("l_suppkey", "l_linenumber").collect()}
    assert {(r.src, r.det) for r in catalog.QUERIES["links_compact"](spark, tiny).collect()} == sent_back


def test_flags_hold_to_each_detectors_end(spark):
    points = spark.createDataFrame([(0, 0, 0), (0, 60, 1), (1, 0, 1), (2, 0, 0), (2, 3, 1), (2, 9, 0)], "det int, at int, flags long")
    n = spark.createDataFrame([(0, 99), (1, 45), (2, 5)], "det int, n int")
    assert {r.det: r.n for r in fl.count_samples(points, ["det"], ["f"], n, ["det"]).collect()} == {0: 39, 1: 45, 2: 2}
    ranges = fl.to_ranges(points, ["det"], n)
    assert sorted((r.det, r.lo, r.hi) for r in ranges.collect()) == [(0, 60, 99), (1, 0, 45), (2, 3, 5)]
    assert sorted((r.det, r.at, r.flags) for r in fl.from_ranges(ranges, n, ["det"], n).collect()) == [(0, 0, 0), (0, 60, 1), (1, 0, 1), (2, 0, 0), (2, 3, 1)]


def test_flag_queries_cover_every_sample(spark, tiny):
    flagged = samples(spark, tiny).selectExpr("det", "sample", "event_type = 'error' error", "value > 60 high").collect()
    count = {(r.det, r.flag): r.n for r in catalog.QUERIES["flag_count_samples"](spark, tiny).collect()}
    assert count == {(d, f): sum(r[f] for r in flagged if r.det == d) for d in {r.det for r in flagged} for f in ("error", "high")}
    covered = {(r.det, k) for r in catalog.QUERIES["flag_to_ranges"](spark, tiny).collect() for k in range(r.lo, r.hi)}
    assert covered == {(r.det, r.sample) for r in flagged if r.error or r.high}
