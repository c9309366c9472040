"""Queries on grids, tiles and catalogues of points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning as bn
from ..operators import catalogs as ca
from .base import NUDGE, nudged, rounded as rounded_to, table

Q: dict = {}
O: dict[str, str] = {}
SHAPE = (25, 40)
C = F.col


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return rounded_to(df, *names, digits=digits)


LI = """li AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS c1, l_tax AS c2, CAST(l_suppkey % 25 AS INT) AS y, CAST(l_partkey % 40 AS INT) AS x,
 (l_suppkey % 25) + l_discount * 5 AS fy, (l_partkey % 40) + l_tax * 5 AS fx FROM lineitem)"""


def li(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", C("l_quantity").alias("q"), C("l_discount").alias("c1"), C("l_tax").alias("c2"), (C("l_suppkey") % 25).cast("int").alias("y"), (C("l_partkey") % 40).cast("int").alias("x"),
        (C("l_suppkey") % 25 + C("l_discount") * 5).alias("fy"), (C("l_partkey") % 40 + C("l_tax") * 5).alias("fx"),
    )


def put(name: str, f: Callable[[SparkSession, str], DataFrame], select: str, *more: str) -> None:
    Q[name] = f
    O[name] = "WITH " + ",\n".join([LI, *more]) + "\n" + select


def tqu() -> dict:
    return {"t": F.lit(1.0), "qq": C("c1"), "u": C("c2")}


NEAR = "SELECT CAST(floor(fy + 0.5) AS INT) AS y, CAST(floor(fx + 0.5) AS INT) AS x, 1.0 AS w, q, c1, c2, l_orderkey, l_linenumber FROM li"
LIN = """SELECT CAST(floor(fy) AS INT) + dy AS y, CAST(floor(fx) AS INT) + dx AS x, (CASE WHEN dy = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE WHEN dx = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) AS w, q, c1, c2, l_orderkey, l_linenumber
 FROM li, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx)"""
SUMS = "SELECT y, x, round(sum(w * q), 6) AS t, round(sum(w * q * c1), 6) AS qq, round(sum(w * q * c2), 6) AS u FROM cells WHERE y >= 0 AND y < 25 AND x >= 0 AND x < 40 GROUP BY 1, 2"

put("bin_nearest", lambda s, d: rounded(bn.scatter(li(s, d), bn.nearest(C("fy"), C("fx")), "q", tqu(), SHAPE), "t", "qq", "u", digits=6), SUMS, f"cells AS ({NEAR})")
put("bin_bilinear", lambda s, d: rounded(bn.scatter(li(s, d), bn.bilinear(C("fy"), C("fx")), "q", tqu(), SHAPE, at=["fy", "fx"]), "t", "qq", "u", digits=6), SUMS, f"cells AS ({LIN})")
W3 = "CASE {d} WHEN -1 THEN ((-0.5 * {f} + 1) * {f} - 0.5) * {f} WHEN 0 THEN (1.5 * {f} - 2.5) * {f} * {f} + 1 WHEN 1 THEN ((-1.5 * {f} + 2) * {f} + 0.5) * {f} ELSE (0.5 * {f} - 0.5) * {f} * {f} END"
CUB = f"""SELECT CAST(floor(fy) AS INT) + dy AS y, CAST(floor(fx) AS INT) + dx AS x, ({W3.format(d='dy', f='(fy - floor(fy))')}) * ({W3.format(d='dx', f='(fx - floor(fx))')}) AS w, q, c1, c2
 FROM li, (VALUES (-1), (0), (1), (2)) a(dy), (VALUES (-1), (0), (1), (2)) b(dx)"""
put("bin_bicubic", lambda s, d: rounded(bn.scatter(li(s, d), bn.bicubic(C("fy"), C("fx")), "q", tqu(), SHAPE, at=["fy", "fx"]), "t", "qq", "u", digits=6), SUMS, f"cells AS ({CUB})")
put(
    "bin_split", lambda s, d: rounded(bn.scatter(li(s, d).withColumn("split", C("l_linenumber") % 2), bn.nearest(C("fy"), C("fx")), "q", {"t": F.lit(1.0)}, SHAPE, ["split"]), "t"),
    "SELECT CAST(l_linenumber % 2 AS INT) AS split, y, x, round(sum(q), 4) AS t FROM cells WHERE y >= 0 AND y < 25 AND x >= 0 AND x < 40 GROUP BY 1, 2, 3", f"cells AS ({NEAR})",
)
put("bin_clamped", lambda s, d: rounded(bn.clamped(li(s, d), C("fy") * 2 - 5, C("fx") - 3, "q", SHAPE), "total"), "SELECT greatest(0, least(24, CAST(floor(fy * 2 - 5 + 0.5) AS INT))) AS y, greatest(0, least(39, CAST(floor(fx - 3 + 0.5) AS INT))) AS x, round(sum(q), 4) AS total FROM li GROUP BY 1, 2")


def gather(spark: SparkSession, d: str) -> DataFrame:
    cells = bn.bilinear(C("fy"), C("fx"))
    grid = bn.scatter(li(spark, d), cells, "q", tqu(), SHAPE)
    return rounded(bn.gather(li(spark, d), cells, grid, tqu(), ["l_orderkey", "l_linenumber", "q"]).groupBy("l_linenumber").agg(F.sum("model").alias("model")), "model", digits=2)


put(
    "gather_bilinear", gather, "SELECT l_linenumber, round(sum(w * (coalesce(m.t, 0) + coalesce(m.qq, 0) * c1 + coalesce(m.u, 0) * c2)), 2) AS model FROM cells LEFT JOIN m USING (y, x) GROUP BY 1",
    f"cells AS ({LIN})", "m AS (SELECT y, x, sum(w * q) AS t, sum(w * q * c1) AS qq, sum(w * q * c2) AS u FROM cells WHERE y >= 0 AND y < 25 AND x >= 0 AND x < 40 GROUP BY 1, 2)",
)
put("hits_map", lambda s, d: li(s, d).where("q < 45").groupBy("y", "x").agg(F.count(F.lit(1)).alias("hits")), "SELECT y, x, count(*) AS hits FROM li WHERE q < 45 GROUP BY 1, 2")
DIV = "div AS (SELECT y, x, sum(q) AS m00, sum(q * c1) AS m01, sum(q * c2) AS m02, sum(q * c1 * c1) AS m11, sum(q * c1 * c2) AS m12, sum(q * c2 * c2) AS m22, count(*) AS hits FROM li GROUP BY 1, 2)"
MM = ["m00", "m01", "m02", "m11", "m12", "m22"]


def div(spark: SparkSession, d: str) -> DataFrame:
    return bn.weight_matrix(li(spark, d), ["y", "x"], "q", [F.lit(1.0), C("c1"), C("c2")])


put("div_map", lambda s, d: rounded(div(s, d), *MM), f"SELECT y, x, {', '.join(f'round({m}, 4) AS {m}' for m in MM)}, hits FROM div", DIV)


def map_solve(spark: SparkSession, d: str) -> DataFrame:
    """Weighted 3 x 3 solution per cell, with the scalar fallback for cells that can't be solved."""
    rhs = li(spark, d).groupBy("y", "x").agg(F.sum("q").alias("r0"), F.sum(C("q") * C("c1") * 2).alias("r1"), F.sum(C("q") * C("c2") * 3).alias("r2"))
    return rounded(bn.solve3(div(spark, d).join(rhs, ["y", "x"]), 1e-6).select("y", "x", "s0", "s1", "s2"), "s0", "s1", "s2", digits=3)


COF = {"a": "m00", "b": "m01", "c": "m02", "d": "m11", "e": "m12", "f": "m22"}
put(
    "map_solve", map_solve,
    """SELECT y, x, round(CASE WHEN ok THEN ((d*f-e*e)*r0 + (c*e-b*f)*r1 + (b*e-c*d)*r2) / det ELSE r0 / a END, 3) AS s0, round(CASE WHEN ok THEN ((c*e-b*f)*r0 + (a*f-c*c)*r1 + (b*c-a*e)*r2) / det ELSE 0 END, 3) AS s1,
 round(CASE WHEN ok THEN ((b*e-c*d)*r0 + (b*c-a*e)*r1 + (a*d-b*b)*r2) / det ELSE 0 END, 3) AS s2 FROM (SELECT *, abs(det) > 1e-6 * a * d * f AS ok FROM (SELECT *, a*(d*f-e*e) + b*(c*e-b*f) + c*(b*e-c*d) AS det FROM
 (SELECT y, x, m00 AS a, m01 AS b, m02 AS c, m11 AS d, m12 AS e, m22 AS f, m00 AS r0, 2 * m01 AS r1, 3 * m02 AS r2 FROM div)))""", DIV,
)
GRID = "grid AS (SELECT y, x, sum(q) AS v FROM li GROUP BY 1, 2)"


def grid(spark: SparkSession, d: str) -> DataFrame:
    return li(spark, d).groupBy("y", "x").agg(F.sum("q").alias("v"))


put("az_bins", lambda s, d: rounded(bn.by_azimuth(li(s, d), ["l_linenumber"], C("fx"), 3.0, 2.5, "q", 12), "total"), "SELECT l_linenumber, CAST(floor((fx - 3) / 2.5) AS INT) AS bin, round(sum(q), 4) AS total, count(*) AS hits FROM li WHERE floor((fx - 3) / 2.5) BETWEEN 0 AND 11 GROUP BY 1, 2")
put("flat_histogram", lambda s, d: bn.flat_histogram(li(s, d), ["l_linenumber"], C("y") * 40 + C("x"), 40, 10), "SELECT l_linenumber, CAST(y % 10 AS INT) AS bin, count(*) AS hits FROM li GROUP BY 1, 2")
put(
    "add_rows", lambda s, d: rounded(bn.add_rows(li(s, d).select("y", (C("x") - 5).alias("x1"), (C("x") - 5 + C("q")).cast("int").alias("x2"), (C("c1") + 1).alias("w")), 40).where("abs(total) > 1e-9"), "total"),
    "SELECT y, CAST(((k % 40) + 40) % 40 AS INT) AS x, round(sum(w), 4) AS total FROM (SELECT y, c1 + 1 AS w, unnest(range(x - 5, CAST(x - 5 + q AS INT))) AS k FROM li) GROUP BY 1, 2",
)
put(
    "block_mu_sigma", lambda s, d: rounded(bn.block_stats(grid(s, d).where("x % 7 < 4 OR y < 10"), "v", 5, 8, 30).withColumn("n", C("n").cast("long")), "mu", "sigma"),
    """SELECT "by", bx, n, round(CASE WHEN n >= 30 THEN mu ELSE (SELECT median(mu) FROM b WHERE n >= 30) END, 4) AS mu, round(CASE WHEN n >= 30 THEN sg ELSE (SELECT median(sg) FROM b WHERE n >= 30) END, 4) AS sigma FROM b""",
    GRID, """b AS (SELECT CAST(y // 5 AS INT) AS "by", CAST(x // 8 AS INT) AS bx, count(*) AS n, avg(v) AS mu, stddev_pop(v) AS sg FROM grid WHERE x % 7 < 4 OR y < 10 GROUP BY 1, 2)""",
)
put("radial_profile", lambda s, d: rounded(bn.radial(grid(s, d), "v", 12.0, 20.0, 3.0), "mean"), "SELECT CAST(floor(sqrt((y - 12) * (y - 12) + (x - 20) * (x - 20)) / 3) AS INT) AS ring, round(avg(v), 4) AS mean, count(*) AS n FROM grid GROUP BY 1", GRID)
put("smooth_radial", lambda s, d: rounded(bn.smooth_radial(grid(s, d), "v", 12.0, 20.0, 3.0).select("y", "x", "smooth"), "smooth"), "SELECT y, x, round(avg(v) OVER (PARTITION BY floor(sqrt((y - 12) * (y - 12) + (x - 20) * (x - 20)) / 3)), 4) AS smooth FROM grid", GRID)
put("tile_downsample", lambda s, d: rounded(bn.downgrade(grid(s, d), "v", 4), "v"), "SELECT CAST(y // 4 AS INT) AS y, CAST(x // 4 AS INT) AS x, round(avg(v), 4) AS v FROM grid GROUP BY 1, 2", GRID)
put(
    "tile_pyramid", lambda s, d: rounded(bn.pyramid(grid(s, d), "v", 2), "v"),
    "SELECT CAST(0 AS INT) AS level, y, x, round(v, 4) AS v FROM grid UNION ALL SELECT 1, y, x, round(v, 4) FROM p1 UNION ALL SELECT 2, CAST(y // 2 AS INT), CAST(x // 2 AS INT), round(avg(v), 4) FROM p1 GROUP BY 1, 2, 3", GRID,
    "p1 AS (SELECT CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, avg(v) AS v FROM grid GROUP BY 1, 2)",
)
put(
    "tile_retile", lambda s, d: bn.retile(grid(s, d), 7, 9, 3, -4, 40).groupBy("ty", "tx").agg(F.count(F.lit(1)).alias("n"), F.max("iy").alias("iy"), F.max("ix").alias("ix")),
    "SELECT CAST(floor((y - 3) / 7.0) AS INT) AS ty, CAST(((x + 4) % 40) // 9 AS INT) AS tx, count(*) AS n, max(CAST((y - 3 + 7) % 7 AS INT)) AS iy, max(CAST(((x + 4) % 40) % 9 AS INT)) AS ix FROM grid GROUP BY 1, 2", GRID,
)
put("read_box", lambda s, d: rounded(bn.read_box(grid(s, d), (5, 12), (36, 46), 40).select("y", "x", "v", C("oy").cast("long").alias("oy"), C("ox").cast("long").alias("ox")), "v"), "SELECT y, x, round(v, 4) AS v, CAST(y - 5 AS BIGINT) AS oy, CAST((x - 36 + 40) % 40 AS BIGINT) AS ox FROM grid WHERE y BETWEEN 5 AND 11 AND (x >= 36 OR x < 6)", GRID)
put(
    "build_tiles", lambda s, d: rounded(bn.tiles(s, SHAPE, (7, 9)).join(grid(s, d).select(F.floor(C("y") / 7).cast("int").alias("ty"), F.floor(C("x") / 9).cast("int").alias("tx"), "v").groupBy("ty", "tx").agg(F.sum("v").alias("total")), ["ty", "tx"]), "total"),
    "SELECT CAST(y // 7 AS INT) AS ty, CAST(x // 9 AS INT) AS tx, CAST(y // 7 * 7 AS INT) AS y0, CAST(least(y // 7 * 7 + 7, 25) AS INT) AS y1, CAST(x // 9 * 9 AS INT) AS x0, CAST(least(x // 9 * 9 + 9, 40) AS INT) AS x1, round(sum(v), 4) AS total FROM grid GROUP BY 1, 2, 3, 4, 5, 6", GRID,
)
put(
    "merge_maps", lambda s, d: rounded(bn.merge_weighted([grid(s, d).where("x < 25").withColumn("w", F.lit(1.0) * C("x")), grid(s, d).where("x > 15").withColumns({"w": F.lit(2.0), "v": C("v") * 3})], "v", "w"), "v", "w"),
    "SELECT y, x, round(coalesce(sum(v * w) / nullif(sum(w), 0), 0), 4) AS v, round(sum(w), 4) AS w FROM (SELECT y, x, v, x * 1.0 AS w FROM grid WHERE x < 25 UNION ALL SELECT y, x, v * 3, 2.0 FROM grid WHERE x > 15) GROUP BY 1, 2", GRID,
)
put("argmax_merge", lambda s, d: bn.best(li(s, d), ["y", "x"], "q", ["l_orderkey", "l_linenumber"]), "SELECT y, x, max(q) AS q, arg_max(l_orderkey, (q, l_orderkey, l_linenumber)) AS l_orderkey, arg_max(l_linenumber, (q, l_orderkey, l_linenumber)) AS l_linenumber, count(*) FILTER (WHERE q <> 0) AS hits FROM li GROUP BY 1, 2")
put(
    "contours", lambda s, d: bn.contours(grid(s, d), "v", [100.0, 150.0, 1500.0, 1600.0]),
    "SELECT y, x, CAST(l AS DOUBLE) AS level FROM (SELECT y, x, v, lead(v) OVER (PARTITION BY y ORDER BY x) AS r, lead(v) OVER (PARTITION BY x ORDER BY y) AS u FROM grid), (VALUES (100), (150), (1500), (1600)) t(l) WHERE ((v >= l) <> (r >= l)) OR ((v >= l) <> (u >= l))", GRID,
)


def components(spark: SparkSession, d: str) -> DataFrame:
    """Connected cells over the median, with each group's least cell, size and weighted centre."""
    g = grid(spark, d)
    over = g.join(F.broadcast(g.agg(F.percentile("v", 0.9).alias("m")))).where("v > m").drop("m")
    lab = bn.components(over).join(over, ["y", "x"])
    return rounded(lab.groupBy("label").agg(F.count(F.lit(1)).alias("n"), (F.sum(C("v") * C("v") * C("y")) / F.sum(C("v") * C("v"))).alias("cy"), F.max("v").alias("peak")).select(C("label.y").alias("y"), C("label.x").alias("x"), "n", "cy", "peak"), "cy", "peak")


put(
    "components", components,
    "SELECT CAST(l // 1000 AS INT) AS y, CAST(l % 1000 AS INT) AS x, count(*) AS n, round(sum(v * v * (p // 1000)) / sum(v * v), 4) AS cy, round(max(v), 4) AS peak FROM (SELECT p, v, (SELECT min(r.b) FROM reach r WHERE r.a = p) AS l FROM big) GROUP BY l", GRID,
    "big AS MATERIALIZED (SELECT y * 1000 + x AS p, v FROM grid WHERE v > (SELECT quantile_cont(v, 0.9) FROM grid))",
    "reach AS (WITH RECURSIVE r AS (SELECT p AS a, p AS b FROM big UNION SELECT r.a, g.p FROM r JOIN big g ON abs(g.p - r.b) IN (1, 1000)) SELECT * FROM r)",
)

# ---- points: suppliers and customers on a plane of 400 x 50 units, wrapped in the first axis

CAT = "cat AS (SELECT c_custkey AS id, CAST((c_custkey * 37) % 4000 AS DOUBLE) / 10 AS px, CAST((c_custkey * 91) % 500 AS DOUBLE) / 10 AS py, c_acctbal + 1000 AS amp FROM customer)"


def cat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(C("c_custkey").alias("id"), ((C("c_custkey") * 37) % 4000 / 10.0).alias("px"), ((C("c_custkey") * 91) % 500 / 10.0).alias("py"), (C("c_acctbal") + 1000).alias("amp"))


def pput(name: str, f: Callable[[SparkSession, str], DataFrame], select: str, *more: str) -> None:
    Q[name] = f
    O[name] = "WITH " + ",\n".join([CAT, *more]) + "\n" + select


def near_sql(r: float) -> str:
    return f"""near AS (SELECT * FROM (SELECT a.id, b.id AS other, a.amp, b.amp AS amp2, sqrt(pow(abs(a.px - b.px) - 400 * round(abs(a.px - b.px) / 400), 2) + pow(a.py - b.py, 2)) AS dist FROM cat a, cat b WHERE abs(a.py - b.py) <= {r}) WHERE dist <= {r})"""


P = {"period": 400.0}
pput("radius_pairs", lambda s, d: ca.pairs_by_place(cat(s, d), "id", "px", "py", 4.05, shown=F.round(C("dist") + NUDGE, 6), **P), "SELECT id, other, round(dist, 6) AS dist FROM near WHERE id < other", near_sql(4.05))
pput(
    "prune_near_bright", lambda s, d: ca.near_bright(cat(s, d), "id", "px", "py", "amp", 10000.0, 6.05, "amp", **P).select("id"),
    "SELECT id FROM cat WHERE id NOT IN (SELECT other FROM (SELECT other, row_number() OVER (PARTITION BY id ORDER BY amp2 DESC, other) AS k FROM near WHERE amp >= 10000) WHERE k > 1)", near_sql(6.05),
)
pput("flux_at_sources", lambda s, d: rounded(ca.flux_at(cat(s, d), "id", "px", "py", "amp", 2.0, 5.05, **P), "flux", digits=3), "SELECT id, round(sum(amp2 * exp(-dist * dist / 8)), 3) AS flux FROM near GROUP BY 1", near_sql(5.05))
pput("prune_contained", lambda s, d: ca.contained(cat(s, d), "id", "px", "py", "amp", 3.0, 5.05, **P).select("id"), "SELECT id FROM cat WHERE id NOT IN (SELECT id FROM near WHERE amp2 > amp AND amp2 * exp(-dist * dist / 18) > amp)", near_sql(5.05))
pput("top_sources", lambda s, d: cat(s, d).orderBy(F.desc("amp"), "id").limit(25).select("id", "amp"), "SELECT id, amp FROM cat ORDER BY amp DESC, id LIMIT 25")


def rput(name: str, f: Callable[[SparkSession, str], DataFrame], select: str, *more: str) -> None:
    """Twins that go through the rows one by one."""
    Q[name] = f
    O[name] = "WITH RECURSIVE " + ",\n".join([CAT, *more]) + "\n" + select


def scan_sql(source: str, near: str) -> tuple[str, ...]:
    """The scan in order of amplitude: a row stays unless a kept one is near; owned(id, other, keep). near: (id, other)."""
    return (
        f"ord AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY amp DESC, id) AS k FROM {source})",
        near,
        "nb AS MATERIALIZED (SELECT a.k, list(b.k ORDER BY b.k) FILTER (b.k < a.k) AS ks FROM ord a LEFT JOIN near n ON n.id = a.id LEFT JOIN ord b ON b.id = n.other GROUP BY a.k)",
        "walk(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT w.k + 1, CASE WHEN list_has_any(w.kept, coalesce(nb.ks, [])) THEN w.kept ELSE list_append(w.kept, nb.k) END FROM walk w JOIN nb ON nb.k = w.k + 1)",
        "kept AS MATERIALIZED (SELECT unnest(kept) AS k FROM (SELECT kept FROM walk ORDER BY k DESC LIMIT 1))",
        "best AS (SELECT u.k, min(u.j) AS j FROM (SELECT k, unnest(ks) AS j FROM nb) u JOIN kept ON kept.k = u.j GROUP BY u.k)",
        "owned AS MATERIALIZED (SELECT o.id, kept.k IS NOT NULL AS keep, CASE WHEN kept.k IS NOT NULL THEN o.id ELSE p.id END AS owner FROM ord o LEFT JOIN kept ON kept.k = o.k LEFT JOIN best ON best.k = o.k LEFT JOIN ord p ON p.k = best.j)",
    )


rput("dedupe_radius", lambda s, d: ca.first_wins(cat(s, d), "id", "px", "py", 6.05, "amp", 400.0).select("id", "keep", "owner"), "SELECT id, keep, owner FROM owned", *scan_sql("cat", near_sql(6.05)))
rput(
    "merge_nearby", lambda s, d: rounded(ca.merged(ca.first_wins(cat(s, d), "id", "px", "py", 6.05, "amp", 400.0), "id", "px", "py", "amp", F.abs("amp"), 0.25), "px", "py", "amp"),
    """SELECT owner, round(sum(px * abs(amp)) / nullif(sum(abs(amp)), 0), 4) AS px, round(sum(py * abs(amp)) / nullif(sum(abs(amp)), 0), 4) AS py, round(sum(amp * abs(amp)) / nullif(sum(abs(amp)), 0), 4) AS amp, arg_max(id, (abs(amp), -id)) AS strongest, count(*) AS members
 FROM (SELECT *, max(abs(amp)) OVER (PARTITION BY owner) AS top FROM cat JOIN owned USING (id)) WHERE abs(amp) >= 0.25 * top GROUP BY owner""",
    *scan_sql("cat", near_sql(6.05)),
)
rput(
    "source_artifacts", lambda s, d: ca.chained(cat(s, d), "id", "px", "py", "amp", 10500.0, 0.5, 5.05, 6.05, 30.0), "SELECT strong, id FROM chain",
    "pr AS MATERIALIZED (SELECT a.id, b.id AS other, a.amp, b.amp AS amp2, sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) AS dist FROM cat a, cat b WHERE a.id <> b.id AND abs(a.py - b.py) <= 30)",
    "weak AS MATERIALIZED (SELECT id AS strong, other AS id, dist FROM pr WHERE amp >= 10500 AND amp2 < 0.5 * amp AND dist <= 30)",
    "steps AS MATERIALIZED (SELECT id, other FROM pr WHERE dist <= 6.05)",
    "chain(strong, id) AS (SELECT strong, id FROM weak WHERE dist <= 5.05 UNION SELECT c.strong, w.id FROM chain c JOIN steps s ON s.id = c.id JOIN weak w ON w.strong = c.strong AND w.id = s.other)",
)
BORDER = "border AS MATERIALIZED (SELECT id, px, py, amp FROM cat WHERE px < 210 AND NOT (px >= 20 AND px < 190 AND py >= 20 AND py < 30) UNION ALL SELECT id + 100000, px, py, amp FROM cat WHERE px >= 190 AND NOT (px >= 210 AND px < 380 AND py >= 20 AND py < 30))"
rput(
    "merge_tiled", lambda s, d: ca.tile_border_merge([(cat(s, d).where("px < 210"), (0.0, 210.0, 0.0, 50.0)), (cat(s, d).where("px >= 190").withColumn("id", C("id") + 100000), (190.0, 400.0, 0.0, 50.0))], "id", "px", "py", "amp", 20.0, 1.0),
    "SELECT id, px, py, amp FROM cat WHERE px >= 20 AND px < 190 AND py >= 20 AND py < 30 UNION ALL SELECT id + 100000, px, py, amp FROM cat WHERE px >= 210 AND px < 380 AND py >= 20 AND py < 30 UNION ALL SELECT b.id, px, py, amp FROM border b JOIN owned o ON o.id = b.id AND o.keep",
    BORDER, *scan_sql("border", "near AS (SELECT a.id, b.id AS other FROM border a, border b WHERE abs(a.py - b.py) <= 1 AND sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) <= 1 AND a.id <> b.id)"),
)


def sets_sql(order: str) -> tuple[str, ...]:
    """Least free sets, row by row."""
    return (
        f"ord AS MATERIALIZED (SELECT id, px, py, row_number() OVER (ORDER BY {order}) AS k FROM cat)",
        near_sql(20.0),
        "nb AS MATERIALIZED (SELECT a.k, list(b.k) FILTER (b.k < a.k) AS ks FROM ord a LEFT JOIN near n ON n.id = a.id LEFT JOIN ord b ON b.id = n.other GROUP BY a.k)",
        "walk(k, sets) AS (SELECT 0::BIGINT, []::INT[] UNION ALL SELECT w.k + 1, list_append(w.sets, list_min(list_filter(range(0, len(coalesce(nb.ks, [])) + 1), lambda x: NOT list_contains(list_transform(coalesce(nb.ks, []), lambda j: w.sets[j]), x)))::INT) FROM walk w JOIN nb ON nb.k = w.k + 1)",
        "done AS (SELECT unnest(sets) AS grp, generate_subscripts(sets, 1) AS k FROM (SELECT sets FROM walk ORDER BY k DESC LIMIT 1))",
    )


rput("independent_groups", lambda s, d: ca.independent(cat(s, d), "id", "px", "py", 20.0, 400.0), "SELECT id, grp FROM ord JOIN done USING (k)", *sets_sql("id"))
rput("independent_cells", lambda s, d: ca.independent_by_cells(cat(s, d), "id", "px", "py", 20.0, 400.0), "SELECT id, grp FROM ord JOIN done USING (k)", *sets_sql("floor(px / 20) % 2 * 2 + floor(py / 20) % 2, id"))
Q["assign_round_robin"] = lambda s, d: ca.round_robin(table(s, d, "lineitem").groupBy("l_linenumber", "l_suppkey").agg(F.sum("l_quantity").alias("q")), "l_linenumber", "l_suppkey", "q", 2)
O["assign_round_robin"] = """WITH RECURSIVE q AS (SELECT l_linenumber, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
 c AS MATERIALIZED (SELECT l_linenumber, list(l_suppkey ORDER BY q DESC, l_suppkey) AS cs, row_number() OVER (ORDER BY l_linenumber) - 1 AS r, count(*) OVER () AS n FROM q GROUP BY 1),
 walk(k, taken, l_linenumber, l_suppkey, turn) AS (SELECT -1::BIGINT, []::BIGINT[], NULL::INT, NULL::BIGINT, NULL::INT UNION ALL SELECT k + 1, list_append(taken, p), l_linenumber, p, turn
  FROM (SELECT w.k, w.taken, c.l_linenumber, list_filter(c.cs, lambda x: NOT list_contains(w.taken, x))[1] AS p, CAST((w.k + 1) // c.n AS INT) AS turn FROM walk w JOIN c ON c.r = (w.k + 1) % c.n WHERE w.k + 1 < 2 * c.n))
 SELECT l_linenumber, l_suppkey, turn FROM walk WHERE k >= 0 AND l_suppkey IS NOT NULL"""

QUERIES, ORACLE = Q, {k: nudged(v) for k, v in O.items()}
