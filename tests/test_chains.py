"""Ways through systems, solvers of unsymmetric systems, resampling by angle: edges, nulls, sizes."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyfield.operators import frames as fr
from tallyfield.operators import sequences as sq
from tallyfield.operators import solvers


def directions(spark, rows):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "id int, lon double, lat double")


def test_ways_are_the_shortest_and_matrices_are_multiplied(spark):
    frames = fr.Frames(lst=F.lit(1.0), bore=(F.lit(0.1), F.lit(0.2)))
    assert frames.path("bore", "ecl") == ["bore", "tele", "hor", "cel", "ecl"] and frames.path("gal", "gal") == ["gal"]
    assert [k for k, _ in frames.steps("gal", "ecl")] == ["matrix"]
    assert [k for k, _ in frames.steps("tele", "gal")] == ["matrix", "z", "matrix"]
    frames.edge("gal", "ecl", [("matrix", np.eye(3).tolist())], [("matrix", np.eye(3).tolist())])
    assert frames.path("gal", "ecl") == ["gal", "ecl"]
    for a, b in (("gal", "hor"), ("bore", "tele"), ("cel", "nowhere")):
        with pytest.raises(ValueError, match="no way"):
            fr.Frames().path(a, b)


def test_known_places(spark):
    """The galactic centre and pole; a pole that is turned to a direction; nulls stay null."""
    df = directions(spark, [(math.radians(266.40499), math.radians(-28.93617)), (math.radians(192.85948), math.radians(27.12825))])
    df = df.unionByName(spark.createDataFrame([(9, None, 0.3)], "id int, lon double, lat double"))
    got = {r.id: (r.lon, r.lat) for r in fr.transformed(df, "cel", "gal", "lon", "lat").collect()}
    assert got[0] == pytest.approx((0, 0), abs=1e-6) and got[1][1] == pytest.approx(math.pi / 2, abs=1e-6) and got[9] == (None, None)
    there = fr.transformed(directions(spark, [(1.0, 0.5)]), "cel", f"cel:{math.degrees(1.0)}_{math.degrees(0.5)}", "lon", "lat").first()
    assert there.lat == pytest.approx(math.pi / 2)


def test_horizon(spark):
    """The zenith's declination is the site's latitude and its hour angle 0; a day of sidereal time brings it back; slopes and tilts
    are undone; times before the table are an error, or take its first row."""
    rows = directions(spark, [(0.3, math.pi / 2)]).withColumn("mjd", F.lit(60000.0))
    now = fr.transformed(rows, "hor", "cel", "lon", "lat", "mjd", epoch=51544.5).first()
    assert now.lat == pytest.approx(math.radians(fr.Site().lat))
    later = fr.transformed(rows.withColumn("mjd", F.col("mjd") + 0.9972695663), "hor", "cel", "lon", "lat", "mjd", epoch=51544.5).first()
    assert later.lon == pytest.approx(now.lon, abs=1e-6)
    table = spark.createDataFrame([(59000.0, 0.2), (60001.0, 0.9)], "mjd double, dut double")
    moved = fr.transformed(rows, "hor", "cel", "lon", "lat", "mjd", table, epoch=51544.5).first()
    assert moved.lon - now.lon == pytest.approx(0.2 / 86164.1 * 2 * math.pi, abs=1e-9)
    early = rows.withColumn("mjd", F.lit(50000.0))
    with pytest.raises(Exception, match="no orientation"):
        fr.transformed(early, "hor", "cel", "lon", "lat", "mjd", table).collect()
    assert len(fr.transformed(early, "hor", "cel", "lon", "lat", "mjd", table, nearest=True).collect()) == 1
    site = fr.Site(base_tilt=0.5, base_az=40.0, slope_az0=30.0, slope_az=0.2, slope_el=0.1)
    start = directions(spark, [(0.5, 0.9), (-2.0, 0.2), (2.9, 1.2)])
    back = fr.transformed(fr.transformed(start, "tele", "hor", "lon", "lat", site=site), "hor", "tele", "lon", "lat", site=site)
    for a, b in zip(start.orderBy("id").collect(), back.orderBy("id").collect(), strict=True):
        assert (a.lon, a.lat) == pytest.approx((b.lon, b.lat))


def test_precession_is_small_and_a_rotation():
    p = np.array(fr.precession(51544.5 + 36525))
    assert np.allclose(p @ p.T, np.eye(3)) and np.allclose(np.array(fr.precession(51544.5)), np.eye(3))
    ra, dec = math.atan2(p[1, 2], p[0, 2]), math.asin(p[2, 2])
    assert math.pi / 2 - dec == pytest.approx(math.radians((2004.3109 - 0.42665 - 0.041833) / 3600)) and abs(ra) > 0


def test_the_boresight_is_the_zenith_of_its_system(spark):
    rows = directions(spark, [(1.2, 0.7), (-2.5, 0.1)]).withColumns({"b": F.col("lon"), "c": F.col("lat")})
    got = fr.transformed(rows, "tele", "bore", "lon", "lat", bore=("b", "c")).collect()
    assert all(r.lat == pytest.approx(math.pi / 2, abs=1e-7) for r in got)


def test_turns_between_senses(spark):
    """A turn that keeps directions is 0 if the sense of longitudes is kept; opposite senses count from the other side."""
    df = directions(spark, [(0.4, 0.3)])
    assert fr.transformed(df, "cel", "cel", "lon", "lat", turn="turn").first().turn == pytest.approx(0, abs=1e-8)
    two = fr.transformed(df.withColumn("mjd", F.lit(60000.0)), "hor", "cel", "lon", "lat", "mjd", turn="turn", size="size").first()
    assert -math.pi - 1e-9 <= two.turn + math.pi and two.size > 0


def test_unsymmetric_systems_of_all_sizes(spark, monkeypatch):
    draw = np.random.default_rng(8)
    mats, rights, entries, right = {}, {}, [], []
    for g, n in enumerate((1, 4, 12, 5)):
        m, b = draw.normal(size=(n, n)) + 4 * np.eye(n), draw.normal(size=n)
        if g == 3:
            b = np.zeros(n)
        mats[g], rights[g] = m, b
        entries += [(g, i, j, float(m[i, j])) for i, j in np.ndindex(n, n)]
        right += [(g, i, float(b[i])) for i in range(n)]
    e, r = spark.createDataFrame(entries, "g int, i int, j int, a double"), spark.createDataFrame(right, "g int, i int, b double")
    got = solvers.bicgstab(e, r, ["g"], steps=30).collect()
    for g, m in mats.items():
        x = np.array([q.value for q in sorted((q for q in got if q.g == g), key=lambda q: q.i)])
        assert np.allclose(m @ x, rights[g], atol=1e-7)
    monkeypatch.setattr(solvers, "FEW_GROUPS", 0)
    exact = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(np.linalg.solve(mats[1], rights[1]))], "g int, i int, value double")
    again = solvers.bicgstab(e.where("g = 1"), r.where("g = 1"), ["g"], steps=1, start=exact).collect()
    assert all(q.error < 1e-20 for q in again)
    stuck = solvers.bicgstab(spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 0, -1.0)], e.schema), spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0)], r.schema), ["g"], steps=5).collect()
    assert len(stuck) == 2 and all(math.isfinite(q.value) for q in stuck)


@pytest.mark.parametrize("n", range(1, 60))
def test_smooth_lengths(n):
    smooth = {2**a * 3**b * 5**c * 7**d for a in range(8) for b in range(5) for c in range(4) for d in range(3)}
    assert sq.smooth_length(n, True) == min(k for k in smooth if k >= n) and sq.smooth_length(n, False) == max(k for k in smooth if k <= n)


def test_there_and_back_in_angles(spark):
    """A signal of the angle, resampled both ways, comes back; falling angles do as well as rising ones; still ones are left out."""
    s = np.arange(400)
    angle = 0.31 * s + 0.1 * np.sin(s / 5)
    rows = [(k, int(i), float(sign * a % (2 * np.pi))) for k, sign in ((0, 1), (1, -1)) for i, a in zip(s, angle, strict=True)] + [(2, i, 1.0) for i in range(50)]
    shape, forward, inverse = sq.angle_uniform(spark.createDataFrame(rows, "k int, i int, a double"), ["k"], "i", "a")
    got = {r.k: r for r in shape.collect()}
    assert set(got) == {0, 1} and got[0][1:4] == got[1][1:4]
    n = got[0].nper * got[0].nrev
    place = np.array([r.place for r in forward.where("k = 1").orderBy("out").collect()])
    assert len(place) == n and np.allclose(np.interp(place, s, angle), np.arange(n) * 2 * np.pi / got[0].nper)
    back = {r.i: r.place for r in inverse.where("k = 0").collect()}
    assert len(back) == 400 and got[0].rate == pytest.approx((n - 1) / place[-1])
    for i, p in back.items():
        assert (p is None) == (i > place[-1]) and (p is None or np.interp(p, np.arange(n), place) == pytest.approx(i))
