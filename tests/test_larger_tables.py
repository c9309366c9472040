"""What grew too fast with the tables: the whole job in fewer steps, with the same results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyfield.operators import binning, catalogs, fits, lowrank, mapmaker, mapset, motion, noise, scans, solvers


def test_small_systems_take_their_steps_in_rows(spark, monkeypatch):
    """Groups of up to SMALL entries need no table a step; larger ones, beside them, do, and both ways give the same."""
    rng = np.random.default_rng(5)
    entries, right, start = [], [], []
    for g, n in enumerate((2, 3, 4, 9)):
        m = rng.normal(size=(n, n)) + 4 * np.eye(n)
        entries += [(g, 7 * i, 7 * j, float(m[i, j])) for i, j in np.ndindex(n, n)] + [(g, 0, 1000, 5.0)]
        right += [(g, 7 * i, float(v)) for i, v in enumerate(rng.normal(size=n))] + [(g, 5, 0.0)]
        start += [(g, 0, 0.25)]
    e, r = spark.createDataFrame(entries, "g int, i int, j int, a double"), spark.createDataFrame(right, "g int, i int, b double")
    s = spark.createDataFrame(start, "g int, i int, value double")
    found = lambda df: {(q.g, q.i): (q.value, q.error) for q in df.collect()}
    monkeypatch.setattr(solvers, "SMALL", 0)
    tables = found(solvers.bicgstab(e, r, ["g"], steps=3, start=s))
    monkeypatch.setattr(solvers, "SMALL", 30)
    mixed = found(solvers.bicgstab(e, r, ["g"], steps=3, start=s))
    monkeypatch.setattr(solvers, "_tables", None)
    few = found(solvers.bicgstab(e.where("g < 3"), r.where("g < 3"), ["g"], steps=3, start=s))
    assert set(tables) == set(mixed) == {(g, i) for g, i, _ in right} and set(few) == {k for k in tables if k[0] < 3}
    for k, v in tables.items():
        assert mixed[k] == pytest.approx(v, rel=1e-6, abs=1e-9) and (k not in few or few[k] == pytest.approx(v, rel=1e-6, abs=1e-9))


@pytest.mark.parametrize("blocks", [1, 3])
def test_many_detectors_of_few_samples(spark, monkeypatch, blocks):
    """Such groups are cut by detectors; values, vectors and signs are those of the matrix, its zeros counted."""
    monkeypatch.setattr(lowrank, "COLUMNS", 4)
    monkeypatch.setattr(lowrank, "SPAN", 4096 if blocks == 1 else 4)
    d = np.random.default_rng(6).normal(size=(150, 9)) * np.arange(9, 0, -1)
    d[:, 8] = d[:, 7]
    df = spark.createDataFrame([(g, i, t, float(d[i, t])) for g, n in ((0, 150), (1, 3)) for i in range(n) for t in range(9)], "g int, det int, at int, v double")
    seen = []
    whole = lowrank.factors
    monkeypatch.setattr(lowrank, "factors", lambda *a: seen.append(a[2]) or whole(*a))
    found = lowrank.factored(df, ["g"], "det", "at", "v")
    assert sorted(seen) == ["at", "det"]
    u, s, _ = np.linalg.svd(d, full_matrices=False)
    strengths = {(r.g, r["mode"]): r.s for r in found.strengths().collect()}
    assert len(strengths) == 9 + 3 and [strengths[0, k] for k in range(9)] == pytest.approx(list(s), abs=1e-9)
    got = np.zeros((150, 2))
    for r in found.vectors(lambda s: np.arange(len(s)) < 2).where("g = 0").collect():
        got[r.det, r["mode"]] = r.v
    want = u[:, :2] * np.sign(u[np.abs(u[:, :2]).argmax(axis=0), np.arange(2)])
    assert np.allclose(got, want)


def test_zero_modes_count(spark):
    """the last block holds one detector and two samples, so its factor has one row."""
    df = spark.createDataFrame([(0, i, t, float((i * 7 + t * t) % 5)) for i in range(5) for t in range(4 if i else 6)], "g int, det int, at int, v double").where("at < 2 OR at > 3")
    assert lowrank.factored(df, ["g"], "det", "at", "v", 4).strengths().count() == 4


def test_sources_meet_cells(spark):
    """samples are summed before sources join them."""
    li = spark.createDataFrame([(0.2, 0.4, 1.0), (0.3, 0.1, 3.0), (1.0, 1.0, None)], "y double, x double, v double")
    got = mapset.stamps(li, spark.createDataFrame([(7, 0.0, 0.0)], "id int, y double, x double"), "y", "x", "v", 1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]
    assert {(r.dy, r.dx): (r.value, r.hits) for r in got.collect()} == {(0, 0): (2.0, 2), (1, 1): (None, 1)}


def test_places_meet_once(spark, monkeypatch):
    """as many pairs as places, not as rows."""
    samples = spark.createDataFrame([(k, 0.0, 0.0) for k in range(40)] + [(99, 50.0, 0.0)], "id int, x double, y double")
    bodies = spark.createDataFrame([(k, 0.5, 0.0, 2.0) for k in range(30)], "id int, x double, y double, amp double")
    sizes, pairs = [], catalogs.pairs
    monkeypatch.setattr(catalogs, "pairs", lambda a, b, *more: sizes.append((a.count(), b.count())) or pairs(a, b, *more))
    got = {r.id: r.response for r in mapset.source_response(samples, bodies, "id", "x", "y", 1.0).collect()}
    assert got == pytest.approx({k: 30 * np.exp(-0.125) for k in range(40)})
    rows = samples.selectExpr("0 det", "id at", "x", "y")
    hit = motion.cut_bright(rows, bodies, ["det"], "at", "x", "y", 1.0, 1.0, 50.0, [(0.0, 0.0), (0.5, 0.0)]).collect()
    near = motion.cut_near(rows, bodies, ["det"], "at", "x", "y", 1.0).collect()
    assert [(r.lo, r.hi) for r in hit] == [(r.lo, r.hi) for r in near] == [(0, 40)]
    assert sizes == [(2, 1), (4, 1), (2, 1)]


def test_equal_rows_are_fitted_once(spark, monkeypatch):
    """rows that differ in their weight alone are added up before the steps."""
    rows = spark.range(300).selectExpr("0 g", "CAST(id % 3 AS DOUBLE) t", "2.0D * (id % 3) + 1 v", "1.0D w")
    sizes, cut = [], fits.cut
    monkeypatch.setattr(fits, "cut", lambda df: sizes.append(df.count()) or cut(df))
    model = lambda p: (p["a"] + p["b"] * F.col("t"), [F.lit(1.0), F.col("t")])
    got = fits.gauss_newton(rows, ["g"], "v", "w", model, spark.createDataFrame([(0, 0.0, 0.0)], "g int, a double, b double"), ["a", "b"]).first()
    assert sizes[0] == 3 and (got.a, got.b) == pytest.approx((1.0, 2.0), abs=1e-6)


def test_folders_of_a_store_do_not_grow(spark, tmp_path):
    """more scans than folders; ids are read from their own."""
    rows = spark.range(3000).selectExpr("CAST(id div 10 AS INT) scan", "id % 10 det", "0 lo", "5 hi")
    scans.write_scans({"cuts": rows}, str(tmp_path))
    folders = [p for p in (tmp_path / "cuts").iterdir() if p.is_dir()]
    assert len(folders) <= scans.SHELVES < 300
    store = scans.Scans(spark, str(tmp_path))
    own = store.select(ids=[17, 250, 9999]).part("cuts")
    assert store.part("cuts").count() == 3000 and own.columns == ["scan", "det", "lo", "hi"] and own.groupBy("scan").count().orderBy("scan").collect() == [(17, 10), (250, 10)]
    assert len(own.inputFiles()) >= 1 and "shelf" in own._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("PushedFilters")[0]


def test_equations_of_fewer_samples(spark):
    """samples that no signal tells apart are one; the solution is that of all."""
    rows = spark.range(400).selectExpr("CAST(id % 4 AS INT) c", "CAST(id % 2 + 1 AS DOUBLE) f", "CAST(id % 7 AS DOUBLE) value", "CAST(id % 3 AS DOUBLE) w")
    eq = mapmaker.Equations(rows, [mapmaker.Binned("sky", ["c"]), mapmaker.template("t", "f")], epsilon=0.5)
    assert eq.condensed().samples.count() == 4
    for a, b in ((eq.rhs(), eq.condensed().rhs()), (eq.diagonal(), eq.condensed().diagonal())):
        assert dict(map(tuple, a.collect())) == pytest.approx(dict(map(tuple, b.collect())))


def test_bases_of_one_length_are_made_once(spark, monkeypatch):
    """equal lengths share a basis, and batches are given out in parts."""
    ranges = spark.createDataFrame([(k, 3, 3 + 2 + k % 2) for k in range(50)], "det int, lo int, hi int").coalesce(1)
    monkeypatch.setattr(noise, "BASES", 7)
    got = {(r.det, r.i, r.j): r.v for r in noise.cut_parameters(ranges, ["det"], "bin:2").collect()}
    assert got == {(k, i, i // 2): 1.0 for k in range(50) for i in range(2 + k % 2)}


def test_places_are_summed_before_they_spread(spark):
    """the same sums with repeated places, from one row a place."""
    rows = spark.range(600).selectExpr("CAST(id % 5 AS DOUBLE) * 0.7 + 2 fy", "CAST(id % 3 AS DOUBLE) * 0.3 + 3 fx", "CAST(id % 11 AS DOUBLE) q", "CAST(id % 2 AS DOUBLE) c")
    comps = {"t": F.lit(1.0), "u": F.col("c")}
    cells = binning.bicubic(F.col("fy"), F.col("fx"))
    plain, summed = (binning.scatter(rows, cells, "q", comps, (10, 10), at=at) for at in ([], ["fy", "fx"]))
    a, b = ({(r.y, r.x): (r.t, r.u) for r in df.collect()} for df in (plain, summed))
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    plan = summed._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate") :]


def test_large_groups_are_filled_in_blocks(spark, monkeypatch):
    """no matrix of a group's detectors; lacking samples, null cuts and a group without a name as in the dense form."""
    rng = np.random.default_rng(3)
    rows = []
    for g, m, n in ((0, 12, 40), (None, 3, 16)):
        d = rng.normal(size=(m, 2)) @ np.cumsum(rng.normal(size=(2, n)), axis=1) + rng.normal(size=(m, n))
        rows += [(g, f"d{i}", 10 + 2 * t, float(d[i, t]), (None, True, False, False, False)[rng.integers(5)]) for i, t in np.ndindex(m, n) if (i, t // 10) != (3, 3)]
    df = spark.createDataFrame(rows, "scan int, det string, at int, value double, cut boolean")
    found = lambda: {(r.scan, r.det, r["at"]): r.value for r in noise.constrained(df, "scan", "det", "at", "value", "cut", steps=4, rounds=1).collect()}
    want = found()
    monkeypatch.setattr(noise, "DENSE", 3)
    monkeypatch.setattr(noise, "ENTRIES", 160)
    sizes, solved = [], noise._solved
    monkeypatch.setattr(noise, "_solved", lambda blocks, *a: sizes.extend(r.m for r in blocks.select("m").collect()) or solved(blocks, *a))
    got = found()
    assert sum(sizes) == 12 and max(sizes) < 12
    assert set(got) == set(want) and len(want) == len(rows) and all(got[k] == pytest.approx(v, rel=1e-6, abs=1e-6) for k, v in want.items())
