"""Many rows at a few places: work on pairs is that of the places, and results are those of the rows one by one."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from tallyfield.operators import catalogs

draw = random.Random(5)
SPOTS = [(float(3 * k), float(k % 2)) for k in range(6)]
ROWS = [(k, *SPOTS[k % 6], float(draw.randint(1, 40))) for k in range(240)]


@pytest.fixture
def met(spark, monkeypatch):
    """Rows of all pairs that are made while a test runs."""
    seen, pairs = [], catalogs.pairs

    def counted(*args, **more):
        out = pairs(*args, **more)
        seen.append(out.count())
        return out

    monkeypatch.setattr(catalogs, "pairs", counted)
    return seen


def near(a, b, radius):
    return math.hypot(a[1] - b[1], a[2] - b[2]) <= radius


def table(spark):
    return spark.createDataFrame(ROWS, "id long, x double, y double, a double")


def greedy():
    kept, owner = [], {}
    for r in sorted(ROWS, key=lambda r: (-r[3], r[0])):
        first = next((q for q in kept if near(r, q, 4.0)), None)
        owner[r[0]] = (first or r)[0]
        kept += [] if first else [r]
    return owner


def chains():
    out = set()
    for s in (r for r in ROWS if r[3] >= 36):
        weak = [r for r in ROWS if r[3] < 0.3 * s[3] and near(r, s, 10.0)]
        found = {r[0] for r in weak if near(r, s, 1.0)}
        while more := {r[0] for r in weak for q in weak if q[0] in found and near(r, q, 3.5)} - found:
            found |= more
        out |= {(s[0], k) for k in found}
    return out


def bright():
    lost = set()
    for s in (r for r in ROWS if r[3] >= 36):
        lost |= {r[0] for r in sorted((r for r in ROWS if near(r, s, 4.0)), key=lambda r: (-r[3], r[0]))[1:]}
    return {r[0] for r in ROWS} - lost


beam = lambda a, b, s: math.exp(-((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) / (2 * s * s))
CASES = {
    "first_wins": (lambda t: {r.id: r.owner for r in catalogs.first_wins(t, "id", "x", "y", 4.0, "a").collect()}, greedy),
    "chained": (lambda t: {(r.strong, r.id) for r in catalogs.chained(t, "id", "x", "y", "a", 36.0, 0.3, 1.0, 3.5, 10.0).collect()}, chains),
    "near_bright": (lambda t: {r.id for r in catalogs.near_bright(t, "id", "x", "y", "a", 36.0, 4.0, "a").collect()}, bright),
    "contained": (lambda t: {r.id for r in catalogs.contained(t, "id", "x", "y", "a", 3.0, 4.0).collect()}, lambda: {a[0] for a in ROWS if not any(b[3] > a[3] and b[3] * beam(a, b, 3.0) > a[3] for b in ROWS if near(a, b, 4.0))}),
    "flux_at": (lambda t: {r.id: round(r.flux, 6) for r in catalogs.flux_at(t, "id", "x", "y", "a", 3.0, 4.0).collect()}, lambda: {a[0]: round(sum(b[3] * beam(a, b, 3.0) for b in ROWS if near(a, b, 4.0)), 6) for a in ROWS}),
    "pairs_by_place": (lambda t: {(r.id, r.other) for r in catalogs.pairs_by_place(t, "id", "x", "y", 4.0).collect()}, lambda: {(a[0], b[0]) for a in ROWS for b in ROWS if a[0] < b[0] and near(a, b, 4.0)}),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_pairs_are_those_of_places(spark, met, name):
    query, want = CASES[name]
    assert query(table(spark)) == want()
    assert met and max(met) <= len(SPOTS) ** 2


def test_catalogues_of_tiles_may_use_the_same_ids(spark):
    rows = [(1, 9.0, 5.0, 3.0), (2, 9.2, 5.0, 2.0), (3, 5.0, 5.0, 1.0)]
    one, two = (spark.createDataFrame(r, "id long, x double, y double, a double") for r in (rows, [(2, 9.1, 5.0, 4.0), (1, 12.0, 5.0, 1.0)]))
    got = catalogs.tile_border_merge([(one, (0.0, 10.0, 0.0, 10.0)), (two, (8.0, 18.0, 0.0, 10.0))], "id", "x", "y", "a", 3.0, 0.5).collect()
    assert [tuple(r) for r in got] == [(2, 9.1, 5.0, 4.0), (1, 12.0, 5.0, 1.0), (3, 5.0, 5.0, 1.0)]


def test_sets_of_many_rows_at_one_place_take_linear_time():
    start = time.process_time()
    assert (catalogs.least_free(np.ones(40_000), np.ones(40_000), 2.0, None) == np.arange(40_000)).all()
    assert time.process_time() - start < 8
