"""Queries on noise models in frequencies, sets of maps, regions, splitting of boxes, catalogues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import finder as fd
from ..operators import footprints as fp
from ..operators import mapmaker as mm
from ..operators import mapset as ms
from ..operators import noisemodels as nm
from ..operators import sources_apart as sa
from ..operators import splitting as sp
from ..sources import maps
from .base import nudged, rounded, samples, SAMPLES, table
from .grids import LI, li
from .more import scratch

Q: dict = {}
O: dict[str, str] = {}
C = F.col


def put(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    Q[name] = f
    if sql:
        O[name] = sql


# ---- noise models; a scan is every tenth detector


def scans(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).withColumns({"scan": C("det") % 10, "sigma": 1.0 + C("det") % 3}).select("scan", "det", "sample", "value", "sigma")


_FREQUENCIES = f"""WITH {SAMPLES}, g AS (SELECT det % 10 AS scan, det, sample, value FROM samples), n AS (SELECT scan, max(sample) + 1 AS n FROM g GROUP BY 1),
 fr AS (SELECT scan, det, n, CAST(unnest(range(n // 2 + 1)) AS BIGINT) AS k FROM (SELECT DISTINCT scan, det FROM g) JOIN n USING (scan)),
 x AS MATERIALIZED (SELECT scan, det, n, k, k / n::DOUBLE AS f, sum(value * cos(2 * pi() * (k * sample % n) / n)) AS re, -sum(value * sin(2 * pi() * (k * sample % n) / n)) AS im FROM fr JOIN g USING (scan, det) GROUP BY ALL)"""
put(
    "noise_common", lambda s, d: rounded(nm.common(scans(s, d), "scan", "det", "sample", "value", "sigma", knee=0.1, slope=-2.0, common_knee=0.05, common_slope=-3.0).drop("sigma"), "value", digits=5),
    f"""{_FREQUENCIES}, a AS (SELECT *, 1.0 + det % 3 AS s, greatest(k, 0.5) / n AS fq FROM x), b AS (SELECT *, 1 / (1 + pow(fq / 0.1, -2.0)) AS own, pow(fq / 0.05, 3.0) AS c FROM a),
 u AS (SELECT *, re / s * own AS r1, im / s * own AS i1 FROM b), v AS MATERIALIZED (SELECT scan, det, n, k, CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END / n::DOUBLE AS w, (r1 - own * sum(r1) OVER q / (c + sum(own) OVER q)) / s AS re, (i1 - own * sum(i1) OVER q / (c + sum(own) OVER q)) / s AS im FROM u WINDOW q AS (PARTITION BY scan, k))
 SELECT g.scan, g.det, g.sample, round(sum(w * (re * cos(2 * pi() * (k * sample % n) / n) - im * sin(2 * pi() * (k * sample % n) / n))), 5) AS value FROM v JOIN g USING (scan, det) GROUP BY 1, 2, 3""",
)


def shared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """edges, diag, modes, strengths and sets: three bins, of which two share their vectors."""
    dets = scans(spark, d).select("scan", "det").distinct()
    groups = dets.select("scan").distinct()
    bins = F.explode(F.array(*map(F.lit, range(3)))).alias("bin")
    edges = groups.select("scan", F.array(F.lit(0.0), F.lit(0.1), F.lit(0.25)).alias("edges"))
    diag = dets.select("scan", "det", bins).withColumn("d", 1.0 + C("det") % 4 + C("bin"))
    modes = dets.select("scan", "det", F.explode(F.array(F.lit(0), F.lit(1))).alias("set")).select("scan", "set", F.lit(0).alias("mode"), "det", F.when(C("set") == 0, F.cos("det")).otherwise(1 + C("det") % 2 / 10.0).alias("v"))
    strengths = groups.select("scan", bins).select("scan", "bin", F.lit(0).alias("mode"), (2.0 + C("bin")).alias("e"))
    sets = groups.select("scan", bins).withColumn("set", (C("bin") > 0).cast("int"))
    return edges, diag, modes, strengths, sets


def by_shared_vectors(spark: SparkSession, d: str) -> DataFrame:
    edges, diag, modes, strengths, sets = shared(spark, d)
    rows = nm.binned(nm.frequencies(scans(spark, d), "scan", "det", "sample", "value"), edges, "scan")
    return rounded(nm.low_rank(rows, diag, modes, strengths, "scan", "det", sets).select("scan", "det", "k", "re", "im"), "re", "im", digits=4)


_SHARED = """{name} AS MATERIALIZED (SELECT scan, det, n, k, f, re / d - v / d * sum(v * re / d) OVER w / (1 / e + sum(v * v / d) OVER w) AS re, im / d - v / d * sum(v * im / d) OVER w / (1 / e + sum(v * v / d) OVER w) AS im FROM
 (SELECT *, 1.0 + det % 4 + bin AS d, 2.0 + bin AS e, CASE WHEN bin = 0 THEN cos(det) ELSE 1 + det % 2 / 10.0::DOUBLE END AS v FROM (SELECT *, CASE WHEN f >= 0.25 THEN 2 WHEN f >= 0.1 THEN 1 ELSE 0 END AS bin FROM {source})) WINDOW w AS (PARTITION BY scan, k))"""
put("noise_shared_vectors", by_shared_vectors, f"{_FREQUENCIES}, {_SHARED.format(name='y', source='x')} SELECT scan, det, k, round(re, 4) AS re, round(im, 4) AS im FROM y")


def by_scale(spark: SparkSession, d: str) -> DataFrame:
    """The same behind deviations of finer bins."""
    edges, diag, modes, strengths, sets = shared(spark, d)
    dets = scans(spark, d).select("scan", "det").distinct()
    fine = dets.select("scan").distinct().select("scan", F.array(*map(F.lit, (0.0, 0.05, 0.2, 0.35))).alias("edges"))
    scale = dets.select("scan", "det", F.explode(F.array(*map(F.lit, range(4)))).alias("bin")).withColumn("scale", 1 + C("det") % 3 * 0.5 + C("bin") * 0.25)
    rows = nm.frequencies(scans(spark, d), "scan", "det", "sample", "value")
    out = nm.scaled(rows, scale, fine, "scan", "det", lambda r: nm.low_rank(nm.binned(r, edges, "scan"), diag, modes, strengths, "scan", "det", sets))
    return rounded(out.select("scan", "det", "k", "re", "im"), "re", "im", digits=4)


_SCALE = "(1 + det % 3 * 0.5::DOUBLE + CASE WHEN f >= 0.35 THEN 3 WHEN f >= 0.2 THEN 2 WHEN f >= 0.05 THEN 1 ELSE 0 END * 0.25::DOUBLE)"
put("noise_scaled", by_scale, f"{_FREQUENCIES}, xs AS (SELECT scan, det, n, k, f, re / {_SCALE} AS re, im / {_SCALE} AS im FROM x), {_SHARED.format(name='y', source='xs')} SELECT scan, det, k, round(re / {_SCALE}, 4) AS re, round(im / {_SCALE}, 4) AS im FROM y")


# ---- a set of maps: a dataset is a return flag, a split every third line number


def stored_maps(spark: SparkSession, d: str) -> str:
    rows = table(spark, d, "lineitem").select(C("l_returnflag").alias("dataset"), (C("l_linenumber") % 3).cast("int").alias("split"), (C("l_suppkey") % 25).cast("int").alias("y"), (C("l_partkey") % 40).cast("int").alias("x"), "l_quantity", "l_tax")
    cells = rows.groupBy("dataset", "split", "y", "x").agg(F.avg("l_quantity").alias("value"), F.sum("l_tax").alias("ivar"))
    cells = cells.where("NOT (dataset = 'N' AND split > 0)")
    manifest = spark.createDataFrame([("A", 2.0, 90.0, 1.5), ("N", 1.0, 150.0, 1.0), ("R", 0.5, 220.0, 0.8), ("none", 1.0, 30.0, 4.0)], maps.MANIFEST)
    path = scratch(spark, "map-set")
    maps.write_maps(cells, manifest, path)
    return path


_CELLS = f"""WITH {LI}, c AS (SELECT l_returnflag AS dataset, CAST(l_linenumber % 3 AS INT) AS split, l_suppkey % 25 AS y, l_partkey % 40 AS x, avg(l_quantity) AS value, sum(l_tax) AS ivar FROM lineitem GROUP BY 1, 2, 3, 4),
 k AS (SELECT * FROM c WHERE NOT (dataset = 'N' AND split > 0)), m AS (SELECT * FROM (VALUES ('A', 2.0::DOUBLE, 90.0), ('N', 1.0, 150.0), ('R', 0.5, 220.0)) t(dataset, gain, freq))"""


def map_box(spark: SparkSession, d: str) -> DataFrame:
    """A box across the edge that wraps, with a mask; the dataset of one split is left out."""
    mask = spark.range(25).select(C("id").cast("int").alias("y"), F.lit(2).alias("x"), F.when(C("id") % 2 == 0, 0.0).otherwise(0.5).alias("keep"))
    got = maps.read_box(spark, stored_maps(spark, d), (4, -5, 14, 9), turn=40, pad=1, mask=mask, unhit=0.02)
    return rounded(got.cells.join(got.datasets.select("dataset", "n_good"), "dataset"), "value", "ivar", digits=5)


put(
    "map_box", map_box,
    f"""{_CELLS}, p AS (SELECT dataset, split, CAST(y - 3 AS INT) AS y, CAST((x + 6 + 40) % 40 AS INT) AS x, value * gain * keep AS value, CASE WHEN ivar / (gain * gain) < 0.02 THEN 0 ELSE ivar / (gain * gain) END * keep AS ivar FROM
 (SELECT *, CASE WHEN x = 2 THEN CASE WHEN y % 2 = 0 THEN 0.0 ELSE 0.5 END ELSE 1.0 END AS keep FROM k JOIN m USING (dataset)) WHERE y BETWEEN 3 AND 14 AND (x + 46) % 40 < 16),
 g AS (SELECT dataset, CAST(count(DISTINCT split) AS INT) AS n_good FROM p WHERE ivar > 0 GROUP BY 1 HAVING count(DISTINCT split) >= 2)
 SELECT dataset, split, y, x, round(value, 5) AS value, round(ivar, 5) AS ivar, n_good FROM p JOIN g USING (dataset) WHERE ivar > 0""",
)
put(
    "map_frequencies", lambda s, d: rounded(maps.read_frequencies(s, stored_maps(s, d), (0, 0, 24, 40), edge=4, window=False).cells, "value", "ivar", digits=4),
    f"""{_CELLS}, u AS (SELECT dataset, freq * 1e9 * {maps.H!r} / ({maps.K!r} * {maps.T_CMB!r}) AS z, gain FROM m), f AS (SELECT dataset, gain, {2 * maps.K**3 * maps.T_CMB**2 / (maps.H**2 * maps.LIGHT**2) * 1e23!r} * pow(z, 4) * exp(z) / pow(exp(z) - 1, 2) AS s FROM u),
 e AS (SELECT *, least(y, 23 - y) AS ey, least(x, 39 - x) AS ex FROM k JOIN f USING (dataset) WHERE split = 0 AND y < 24 AND ivar / (gain * gain) >= 1e-7),
 t AS (SELECT *, (CASE WHEN ey < 4 THEN 0.5 - 0.5 * cos(pi() * (ey + 1) / 5) ELSE 1 END) * (CASE WHEN ex < 4 THEN 0.5 - 0.5 * cos(pi() * (ex + 1) / 5) ELSE 1 END) AS a FROM e)
 SELECT dataset, split, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(value * gain * s * a, 4) AS value, round(ivar / (gain * gain) * a * a / (s * s), 4) AS ivar FROM t""",
)


def region_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the grid by parts of tiles."""
    own = maps.split_regions(maps.regions(spark, "tile:10:16", maps.Grid((25, 40), -10.0, 0.0, 1.0, 1.0)), 7)
    cells = li(spark, d).groupBy("y", "x").agg(F.sum("q").alias("v"))
    tile = cells.withColumn("region", (F.floor(C("y") / 10) * 3 + F.floor(C("x") / 16)).cast("long")).join(F.broadcast(own), "region")
    return rounded(tile.where("y >= y1 AND y < y2 AND x >= x1 AND x < x2").groupBy("region", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")), "total", digits=4)


put(
    "region_cells", region_cells,
    f"""WITH {LI}, c AS (SELECT y, x, sum(q) AS v FROM li GROUP BY 1, 2), t AS (SELECT y // 10 * 3 + x // 16 AS region, y % 10 AS iy, x % 16 AS ix, v FROM c)
 SELECT CAST(region AS BIGINT) AS region, CAST(CASE WHEN iy < 5 THEN 0 ELSE 3 END + CASE WHEN ix < 5 THEN 0 WHEN ix < 10 THEN 1 ELSE 2 END AS BIGINT) AS part, count(*) AS n, round(sum(v), 4) AS total FROM t GROUP BY 1, 2""",
)


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as a catalogue of results, written and read."""
    s = table(spark, d, "supplier").select(F.radians(C("s_suppkey") * 3.6).alias("ra"), F.lit(0.1).alias("dec"), (C("s_acctbal") / 100).alias("snr"), F.array("s_acctbal", C("s_acctbal") * 2).alias("flux"), C("s_nationkey").alias("case"))
    path = scratch(spark, "catalogue")
    maps.write_catalogue(s.where("case < 10"), f"{path}/a", "results")
    maps.write_catalogue(s.where("case >= 10"), f"{path}/b", "results")
    got = maps.read_catalogue(spark, [f"{path}/a", f"{path}/b"], "results")
    return rounded(got.select("ra", "snr", C("flux")[1].alias("flux1"), C("case").alias("kind"), C("dflux").isNull().alias("bare")), "ra", "snr", "flux1", digits=5)


put("nested_catalogue", catalogue, "SELECT round(radians(s_suppkey * 3.6), 5) AS ra, round(s_acctbal / 100, 5) AS snr, round(s_acctbal * 2, 5) AS flux1, s_nationkey AS kind, true AS bare FROM supplier")


# ---- shares of boxes in the plane


def box_shares(spark: SparkSession, d: str) -> DataFrame:
    """Customers' boxes on a circle, in 12 shares: each share's boxes, and whether its cost is near a twelfth and its box small."""
    c = table(spark, d, "customer").select(C("c_custkey").alias("id"), (1 + C("c_custkey") % 7).alias("cost"), (C("c_custkey") % 61 * 1.0).alias("y1"), (C("c_custkey") % 61 + 2.0).alias("y2"), (C("c_custkey") * 7.3 % 90 + 315).alias("x1"), (C("c_custkey") * 7.3 % 90 + 316).alias("x2"))
    out = sp.shares(c.withColumns({k: F.when(C(k) >= 360, C(k) - 360).otherwise(C(k)) for k in ("x1", "x2")}), "id", "cost", ("y1", "y2"), ("x1", "x2"), 12, 360.0)
    whole = c.agg(F.sum("cost").alias("all"))
    per = out.groupBy("share").agg(F.sum("cost").alias("load"), ((F.max("y2") - F.min("y1")) * (F.max("x2") - F.min("x1"))).alias("area"))
    return per.join(F.broadcast(whole)).select("share", (F.abs(C("load") - C("all") / 12) <= 0.02 * C("all") / 12 + 14).alias("even"), (C("area") < 63 * 91 / 4).alias("compact"))


put("box_shares", box_shares, "SELECT CAST(range AS INT) AS share, true AS even, true AS compact FROM range(12)")
put(
    "box_share_totals", lambda s, d: sp.shares(table(s, d, "customer").select("c_custkey", "c_nationkey", (C("c_custkey") % 90).alias("a"), (C("c_acctbal") / 100).alias("b")), "c_custkey", "c_nationkey", ("a", "a"), ("b", "b"), 5).agg(F.sum("c_nationkey").alias("cost"), F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("ids"), F.count_distinct("share").alias("shares")),
    "SELECT CAST(sum(c_nationkey) AS BIGINT) AS cost, count(*) AS n, count(DISTINCT c_custkey) AS ids, CAST(5 AS BIGINT) AS shares FROM customer",
)



# ---- footprints: a scan for every supplier


def sweeps(spark: SparkSession, d: str) -> DataFrame:
    k = C("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), (60310.0 + k / 37.0).alias("mjd1"), (60310.01 + k / 37.0 + k % 5 / 500.0).alias("mjd2"), (95.0 + k % 30).alias("az1"), (130.0 + k % 30).alias("az2"), (35.0 + k % 17).alias("el"), (1 + k % 9).alias("ndet"))


SKY = maps.Grid((360, 1440), -90.0, 180.0, 0.5, -0.25)


put(
    "footprint_rows", lambda s, d: rounded(fp.row_ranges(sweeps(s, d), "id", SKY).groupBy("id").agg(F.sum(C("w") * (C("x2") - C("x1"))).alias("seconds"), F.count_distinct("y").alias("rows"), F.count(F.lit(1)).alias("n")).select("id", "seconds", (C("rows") == C("n")).alias("once")), "seconds", digits=3),
    "SELECT s_suppkey AS id, round((0.01 + s_suppkey % 5 / 500.0) * 86400 * (1 + s_suppkey % 9), 3) AS seconds, true AS once FROM supplier",
)
put(
    "footprint_map", lambda s, d: fp.weight_map(sweeps(s, d), "id", SKY).agg(F.round(F.sum("total") + 1e-9, 2).alias("seconds"), (F.count(F.lit(1)) > 1000).alias("wide")),
    "SELECT round(sum((0.01 + s_suppkey % 5 / 500.0) * 86400 * (1 + s_suppkey % 9)), 2) AS seconds, true AS wide FROM supplier",
)


# ---- sources apart: every detector keeps its level, but for samples near planted sources


def apart(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d).select("det", "sample", (C("det") % 25).cast("int").alias("y"), (C("sample") % 40).cast("int").alias("x"), "event_id")
    sources = spark.range(4).select((C("id") * 7.0).alias("y"), (C("id") * 9.0 + 4).alias("x"))
    level, hit = 3.0 + C("det") % 11, (C("y") % 7 == 0) & (C("y") < 28) & (C("x") == C("y") / 7 * 9 + 4)
    rows = rows.withColumn("value", level + F.when(hit, 20.0).otherwise(0.0))
    ranges = sa.near_sources(rows, sources, "y", "x", 1.5, ["det"], "sample")
    parts = sa.parted(rows, ranges, ["det"], "sample", "value")
    return rounded(sa.two_maps(parts, ["y", "x"], "value", F.lit(1.0) + C("det") % 2), "rest", "sources", "sky", digits=5)


put(
    "sources_apart", apart,
    f"""WITH {SAMPLES}, r AS (SELECT det, CAST(det % 25 AS INT) AS y, CAST(sample % 40 AS INT) AS x, 3.0 + det % 11 AS level, 1.0 + det % 2 AS w FROM samples),
 h AS (SELECT *, CASE WHEN y % 7 = 0 AND x = y // 7 * 9 + 4 THEN 20.0 ELSE 0.0 END AS s, EXISTS (SELECT 1 FROM range(4) q(i) WHERE pow(y - 7 * i, 2) + pow(x - 9 * i - 4, 2) <= 2.25) AS m FROM r)
 SELECT y, x, round(sum(w * level) / sum(w), 5) AS rest, round(coalesce(sum(w * s) FILTER (m) / sum(w) FILTER (m), 0), 5) AS sources, round(sum(w * level) / sum(w) + coalesce(sum(w * s) FILTER (m) / sum(w) FILTER (m), 0), 5) AS sky FROM h GROUP BY 1, 2""",
)

# ---- signals that see several parameters, labelled regions, pickup, priors


def beams_rhs(spark: SparkSession, d: str) -> DataFrame:
    """Right side of a system whose samples see a main and two side beams, and how the system looks around one cell."""
    rows = li(spark, d).groupBy("l_orderkey", "l_linenumber").agg(F.max("y").alias("y"), F.max("x").alias("x"), F.sum("q").alias("value"), F.lit(2.0).alias("w"))
    beam = lambda dy, dx, f: F.struct((C("y") + dy).alias("y"), ((C("x") + dx) % 40).alias("x"), F.lit(f).alias("f"))
    eq = mm.Equations(rows, [mm.Spread("sky", ["l_orderkey", "l_linenumber"], F.array(beam(0, 0, 1.0), beam(1, 3, -0.25), beam(0, 7, 0.1)), ["y", "x"])])
    around = eq.around(spark.createDataFrame([("sky:5:9",)], "idx string"))
    both = eq.rhs().select("idx", C("value").alias("rhs")).join(around.select("idx", C("value").alias("near")), "idx", "full")
    at = F.split("idx", ":")
    return rounded(both.select(at[1].cast("int").alias("y"), at[2].cast("int").alias("x"), "rhs", F.coalesce("near", F.lit(0.0)).alias("near")), "rhs", "near", digits=5)


put(
    "beams_rhs", beams_rhs,
    f"""WITH {LI}, s AS (SELECT l_orderkey, l_linenumber, max(y) AS y, max(x) AS x, sum(q) AS v FROM li GROUP BY 1, 2), b AS (SELECT l_orderkey, l_linenumber, v, CAST(y + dy AS INT) AS y, CAST((x + dx) % 40 AS INT) AS x, f FROM s, (VALUES (0, 0, 1.0::DOUBLE), (1, 3, -0.25), (0, 7, 0.1)) t(dy, dx, f)),
 n AS (SELECT o.y, o.x, sum(2 * b.f * o.f) AS near FROM b JOIN b o USING (l_orderkey, l_linenumber) WHERE b.y = 5 AND b.x = 9 GROUP BY 1, 2)
 SELECT y, x, round(sum(2 * v * f), 5) AS rhs, round(coalesce(any_value(near), 0), 5) AS near FROM b LEFT JOIN n USING (y, x) GROUP BY 1, 2""",
)
put(
    "region_sources", lambda s, d: rounded(fd.measured_regions(li(s, d).groupBy("y", "x").agg(F.sum("q").alias("v")).withColumn("k", F.when(C("x") % 8 < 3, F.floor(C("y") / 5) * 5 + F.floor(C("x") / 8))), "k", "v"), "y", "x", "amp", digits=5),
    f"""WITH {LI}, c AS (SELECT y, x, sum(q) AS v FROM li GROUP BY 1, 2), k AS (SELECT *, CAST(y // 5 * 5 + x // 8 AS BIGINT) AS id FROM c WHERE x % 8 < 3),
 g AS (SELECT id, sum(y * v) / sum(v) AS cy, sum(x * v) / sum(v) AS cx, max(v) AS top FROM k GROUP BY 1),
 a AS (SELECT id, coalesce(sum(v * (CASE WHEN i = 1 THEN cy - floor(cy) ELSE 1 - cy + floor(cy) END) * (CASE WHEN j = 1 THEN cx - floor(cx) ELSE 1 - cx + floor(cx) END)), 0) AS amp FROM g, (VALUES (0), (1)) p(i), (VALUES (0), (1)) q(j), c WHERE c.y = floor(cy) + i AND c.x = floor(cx) + j GROUP BY 1),
 t AS (SELECT k.id, min(y * 100 + x) AS p FROM k JOIN g ON g.id = k.id AND k.v = g.top GROUP BY 1)
 SELECT id, round(CASE WHEN top > 1.1 * abs(coalesce(amp, 0)) THEN p // 100 ELSE cy END, 5) AS y, round(CASE WHEN top > 1.1 * abs(coalesce(amp, 0)) THEN p % 100 ELSE cx END, 5) AS x, round(CASE WHEN top > 1.1 * abs(coalesce(amp, 0)) THEN top ELSE amp END, 5) AS amp FROM g LEFT JOIN a USING (id) JOIN t USING (id)""",
)
put(
    "map_less_pickup", lambda s, d: rounded(ms.less_pickup(li(s, d), li(s, d).groupBy("y", "x").agg(F.avg("q").alias("v")), ["y", "x"], ["l_linenumber", "x"], "v"), "v", digits=5),
    f"WITH {LI}, c AS (SELECT y, x, avg(q) AS v FROM li GROUP BY 1, 2), p AS (SELECT l_linenumber, x, avg(v) AS p FROM li JOIN c USING (y, x) GROUP BY 1, 2) SELECT y, x, round(any_value(v) - avg(p), 5) AS v FROM li JOIN c USING (y, x) JOIN p USING (l_linenumber, x) GROUP BY 1, 2",
)
put(
    "flux_priors", lambda s, d: rounded(table(s, d, "supplier").select("s_suppkey", fd.prior_of(F.when(C("s_suppkey") % 5 == 0, F.lit(float("nan"))).otherwise(C("s_acctbal") / 1000), F.when(C("s_suppkey") % 7 > 0, C("s_nationkey") / 10.0), 0.5).alias("p")).select("s_suppkey", "p.amp", "p.ivar"), "amp", "ivar", digits=5),
    "SELECT s_suppkey, round(a, 5) AS amp, round(CASE WHEN d > 0 THEN 1 / (d * d + 0.25 * a * a) ELSE 1e-10 END, 5) AS ivar FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_acctbal / 1000 END AS a, CASE WHEN s_suppkey % 7 > 0 THEN s_nationkey / 10.0::DOUBLE ELSE 0 END AS d FROM supplier)",
)


def phase_maps(spark: SparkSession, d: str) -> DataFrame:
    """Samples by scanning pattern and azimuth bin, stored as maps and read for some patterns."""
    rows = samples(spark, d).select((C("det") % 4).cast("int").alias("pattern"), "det", (C("sample") % 12).cast("int").alias("bin"), "value")
    cells = rows.groupBy("pattern", "det", "bin").agg(F.avg("value").alias("value"))
    patterns = spark.range(4).select(C("id").cast("int").alias("pattern"), (30 + 10.0 * C("id")).alias("el"), (170 + 100.0 * C("id")).alias("az1"), (190 + 100.0 * C("id")).alias("az2"))
    path = scratch(spark, "phase-maps")
    maps.write_phase_maps(patterns, cells, path)
    found, read = maps.read_phase_maps(spark, path, el=(40.0, 50.0))
    return rounded(read.join(found, "pattern").select("pattern", "det", "bin", "value", "az1"), "value", "az1", digits=5)


put(
    "phase_maps", phase_maps,
    f"WITH {SAMPLES} SELECT CAST(det % 4 AS INT) AS pattern, det, CAST(sample % 12 AS INT) AS bin, round(avg(value), 5) AS value, CASE WHEN det % 4 = 1 THEN -90.0 ELSE 10.0 END::DOUBLE AS az1 FROM samples WHERE det % 4 IN (1, 2) GROUP BY ALL",
)

QUERIES, ORACLE = Q, {k: nudged(v) for k, v in O.items()}
