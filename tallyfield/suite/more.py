"""Queries on streams, simulations, map making, statistics and signs of life of sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..lineage import cut, shared_dir
from ..operators import binning as bn
from ..operators import catalogs as ca
from ..operators import filters as fi
from ..operators import finder as fd
from ..operators import mapmaker as mm
from ..operators import noise as no
from ..operators import noisemodels as nm
from ..operators import simulate as si
from ..operators import tables as tb
from ..sources import text
from ..streaming import windows as st
from .base import NUDGE, nudged, rounded as rounded_to, samples, SAMPLES, table
from .grids import GRID, LI, grid, li

Q: dict = {}
O: dict[str, str] = {}
C = F.col


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return rounded_to(df, *names, digits=digits)



def put(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    Q[name], O[name] = f, sql


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- streams, driven to their end


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = st.tumbling(st.events(spark, f"{d}/events.parquet"), ["event_type"], "ts", "1 day", "value")
    got = st.run_to_end(out, "complete", scratch(spark, "stream"))
    return got.select("event_type", F.unix_timestamp("start").alias("start_s"), "n", F.round(C("total") + NUDGE, 4).alias("total"))


put("stream_tumbling", stream_tumbling, "SELECT event_type, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = st.sessions(st.events(spark, f"{d}/events.parquet"), "user_id", "ts", "6 hours")
    got = st.run_to_end(out, "complete", scratch(spark, "stream"))
    return got.select("user_id", F.unix_micros("start").alias("start_us"), "n")


put("stream_sessions", stream_sessions, """SELECT user_id, min(t) AS start_us, count(*) AS n FROM (SELECT user_id, t, sum(f) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM
 (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, s""")


def stream_moments(spark: SparkSession, d: str) -> DataFrame:
    out = st.moments(st.events(spark, f"{d}/events.parquet"), "event_type", "value")
    return rounded(st.run_to_end(out, "complete", scratch(spark, "stream")), "mean", "dev")


put("stream_moments", stream_moments, "SELECT event_type AS name, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS dev FROM events GROUP BY 1")


# ---- map making


def ground_and_sky(spark: SparkSession, d: str) -> DataFrame:
    """Two signals solved together: a value a cell, and one for odd and one for even line numbers."""
    rows = cut(li(spark, d).select("y", "x", (C("l_linenumber") % 2).cast("int").alias("odd"), (C("q") + 5 * (C("l_linenumber") % 2)).alias("value"), (1 + C("c1")).alias("w")))
    x = mm.Equations(rows, [mm.Binned("sky", ["y", "x"]), mm.Binned("ground", ["odd"])], epsilon=0.5).solve(steps=12, enough=1e-18)
    at = F.split("idx", ":")
    return rounded(x.select(at[0].alias("signal"), at[1].cast("int").alias("a"), F.coalesce(F.get(at, F.lit(2)).cast("int"), F.lit(-1)).alias("b"), "value"), "value", digits=5)


#: The sky's part eliminated from the normal equations leaves two equations for the ground.
_SCHUR = f"""WITH {LI}, r AS (SELECT y, x, l_linenumber % 2 AS o, q + 5 * (l_linenumber % 2) AS v, 1 + c1 AS w FROM li),
 c AS MATERIALIZED (SELECT y, x, sum(w) + 0.5 AS a, sum(w * v) AS r, coalesce(sum(w) FILTER (o = 0), 0) AS b0, coalesce(sum(w) FILTER (o = 1), 0) AS b1 FROM r GROUP BY 1, 2),
 g AS (SELECT sum(w) FILTER (o = 0) + 0.5 AS d0, sum(w) FILTER (o = 1) + 0.5 AS d1, sum(w * v) FILTER (o = 0) AS r0, sum(w * v) FILTER (o = 1) AS r1 FROM r),
 s AS (SELECT any_value(d0) - sum(b0 * b0 / a) AS s00, -sum(b0 * b1 / a) AS s01, any_value(d1) - sum(b1 * b1 / a) AS s11, any_value(r0) - sum(b0 * r / a) AS t0, any_value(r1) - sum(b1 * r / a) AS t1 FROM c, g),
 z AS (SELECT (t0 * s11 - t1 * s01) / (s00 * s11 - s01 * s01) AS z0, (s00 * t1 - s01 * t0) / (s00 * s11 - s01 * s01) AS z1 FROM s)
 SELECT 'sky' AS signal, y AS a, x AS b, round((r - b0 * z0 - b1 * z1) / a, 5) AS value FROM c, z UNION ALL SELECT 'ground', 0, -1, round(z0, 5) FROM z UNION ALL SELECT 'ground', 1, -1, round(z1, 5) FROM z"""
put("map_make", ground_and_sky, _SCHUR)


def map_make_single(spark: SparkSession, d: str) -> DataFrame:
    """With one binned signal the solution is the weighted mean per cell."""
    rows = li(spark, d).select("y", "x", C("q").alias("value"), (1 + C("c1")).alias("w"))
    x = mm.Equations(rows, [mm.Binned("sky", ["y", "x"])]).solve(steps=3)
    return x.select(F.split("idx", ":")[1].cast("int").alias("y"), F.split("idx", ":")[2].cast("int").alias("x"), F.round(C("value") + NUDGE, 4).alias("value"))


put("map_make_single", map_make_single, f"WITH {LI} SELECT y, x, round(sum(q * (1 + c1)) / sum(1 + c1), 4) AS value FROM li GROUP BY 1, 2")


def transposes(spark: SparkSession, d: str) -> DataFrame:
    """<P x, y> = <x, P' y> for the bilinear projection."""
    cells = bn.bilinear(C("fy"), C("fx"))
    comps = {"t": F.lit(1.0)}
    g = grid(spark, d).select("y", "x", C("v").alias("t"))
    model = bn.gather(li(spark, d), cells, g, comps, ["l_orderkey", "l_linenumber", "q"])
    left = model.agg(F.sum(C("model") * C("q")).alias("a"))
    back = bn.scatter(li(spark, d), cells, "q", comps, (100, 100)).join(g.select("y", "x", C("t").alias("g")), ["y", "x"])
    right = back.agg(F.sum(C("t") * C("g")).alias("b"))
    return left.join(right).select((F.abs(C("a") - C("b")) < 1e-9 * F.abs(C("a"))).alias("agree"))


put("transpose_check", transposes, "SELECT true AS agree")
put("gain_fit_model", lambda s, d: rounded(fi.regress(samples(s, d).withColumn("m", F.lit(10.0) + C("sample") % 3), ["det"], "value", "m", subtract=False).groupBy("det").agg(F.max("amp").alias("amp")), "amp", digits=6), f"WITH {SAMPLES} SELECT det, round(sum(value * (10 + sample % 3)) / sum((10 + sample % 3) * (10 + sample % 3)), 6) AS amp FROM samples GROUP BY 1")
put("prior_row_means", lambda s, d: rounded(fi.row_means_penalty(grid(s, d), "v", 0.5).select("y", "x", "prior"), "prior"), f"WITH {LI}, {GRID} SELECT y, x, round(0.5 * avg(v) OVER (PARTITION BY y), 4) AS prior FROM grid")
put("solve_hits", lambda s, d: rounded(grid(s, d).join(li(s, d).groupBy("y", "x").agg(F.count(F.lit(1)).cast("double").alias("k")), ["y", "x"]).select("y", "x", F.when(C("k") > 3, C("v") / F.sqrt("k")).otherwise(0.0).alias("s")), "s", digits=6), f"WITH {LI} SELECT y, x, round(CASE WHEN count(*) > 3 THEN sum(q) / sqrt(count(*)) ELSE 0 END, 6) AS s FROM li GROUP BY 1, 2")
put("binned_matrix", lambda s, d: rounded(li(s, d).groupBy(C("y").alias("i"), (C("x") % 5).cast("int").alias("j")).agg(F.sum("q").alias("m")), "m"), f"WITH {LI} SELECT y AS i, CAST(x % 5 AS INT) AS j, round(sum(q), 4) AS m FROM li GROUP BY 1, 2")
put(
    "safe_mean", lambda s, d: grid(s, d).groupBy(F.floor((C("y") * 40 + C("x")) / 50).alias("b")).agg(F.avg("v").alias("m")).agg(F.round(F.median("m") + NUDGE, 4).alias("safe_mean")),
    f"WITH {LI}, {GRID} SELECT round(median(m), 4) AS safe_mean FROM (SELECT avg(v) AS m FROM grid GROUP BY (y * 40 + x) // 50)",
)


def robust_reference(spark: SparkSession, d: str) -> DataFrame:
    """Median of positive values, then of those above a share of it."""
    g = grid(spark, d).where("v > 0")
    first = g.agg(F.median("v").alias("m"))
    return g.join(F.broadcast(first)).where("v > 0.9 * m").agg(F.round(F.median("v") + NUDGE, 4).alias("reference"))


put("robust_reference", robust_reference, f"WITH {LI}, {GRID} SELECT round(median(v), 4) AS reference FROM grid WHERE v > 0.9 * (SELECT median(v) FROM grid WHERE v > 0)")
put("fix_bad", lambda s, d: rounded(li(s, d).select("l_orderkey", "l_linenumber", fn.fix_bad(F.when(C("c2") == 0, F.lit(float("nan"))).otherwise(1 / F.nullif(C("c2"), F.lit(0.0))), -1.0).alias("v")), "v"), f"WITH {LI} SELECT l_orderkey, l_linenumber, round(CASE WHEN c2 = 0 THEN -1 ELSE 1 / c2 END, 4) AS v FROM li")
put("zipped_vector", lambda s, d: tb.zipped({"size": (table(s, d, "part"), ["p_partkey"], "p_size"), "balance": (table(s, d, "supplier"), ["s_suppkey"], "s_acctbal")}).withColumn("idx", C("idx").cast("int")), "SELECT 'size' AS part, CAST(p_partkey AS INT) AS idx, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT 'balance', CAST(s_suppkey AS INT), s_acctbal FROM supplier")


# ---- sources and sinks


def tile_folders(spark: SparkSession, d: str) -> DataFrame:
    """Grid written as one folder per tile and read back by a range of tiles."""
    path = scratch(spark, "tiles")
    text.write_tiles(bn.retile(grid(spark, d), 8, 10), path)
    return rounded(text.read_tiles(spark, path, ty=(1, 3), tx=(0, 2)).select("y", "x", "v"), "v")


put("tile_folders", tile_folders, f"WITH {LI}, {GRID} SELECT y, x, round(v, 4) AS v FROM grid WHERE y >= 8 AND y < 24 AND x < 20")


def catalog_lines(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue to text lines and back."""
    path = scratch(spark, "catalog")
    text.catalog_lines(table(spark, d, "supplier"), [("s_suppkey", "%6d"), ("s_acctbal", "%12.2f"), ("s_nationkey", "%3d")]).write.text(path)
    return text.read_catalog(spark, path, [("id", "cast(p[0] AS bigint)"), ("amp", "array(p[1], p[2])")]).select("id", C("amp")[0].alias("balance"), C("amp")[1].cast("int").alias("nation"))


put("catalog_lines", catalog_lines, "SELECT s_suppkey AS id, s_acctbal AS balance, s_nationkey AS nation FROM supplier")


def id_lists(spark: SparkSession, d: str) -> DataFrame:
    """A tag file that names two id lists, read as boolean tags."""
    path = scratch(spark, "tags")
    lists = {"a": table(spark, d, "nation").where("n_regionkey < 3"), "b": table(spark, d, "nation").where("n_nationkey % 2 = 0")}
    for name, df in lists.items():
        df.select(F.concat_ws(" ", C("n_nationkey").cast("string"), "n_name")).write.text(f"{path}/{name}")
    spark.createDataFrame([("root = .\n{root}/a deep night\nb night even # two tags",)], "value string").coalesce(1).write.text(f"{path}/top")
    rows = text.read_tags(spark, f"{path}/top")
    return rows.select(C("id").cast("int").alias("id"), "deep", "even", "night")


put("id_lists", id_lists, "SELECT n_nationkey AS id, n_regionkey < 3 AS deep, n_nationkey % 2 = 0 AS even, true AS night FROM nation WHERE n_regionkey < 3 OR n_nationkey % 2 = 0")


# ---- simulations


def scan_wave(spark: SparkSession, d: str) -> DataFrame:
    """The azimuth at every event, if a detector's samples are taken while the telescope goes back and forth."""
    s = samples(spark, d).select("event_id", "sample", "value")
    n = s.agg(F.max("sample")).first()[0] + 1  # one number
    wave = si.back_and_forth(spark, n, -10.0, 10.0, 0.7)
    return rounded(s.join(wave, "sample").select("event_id", "t", "az", "value"), "t", "az")


put("scan_wave", scan_wave, f"WITH {SAMPLES} SELECT event_id, round(sample / 100.0, 4) AS t, round(-10 + CASE WHEN p <= 20 THEN p ELSE 40 - p END, 4) AS az, value FROM (SELECT *, (sample * CAST(0.7 AS DOUBLE)) % 40 AS p FROM samples)")
put(
    "scan_raster", lambda s, d: rounded(si.raster(s, (0.0, 40.0, 0.0, 25.0), 1.0).withColumns({"yy": F.floor("y").cast("int"), "xx": F.floor("x").cast("int")}).join(grid(s, d).select(C("y").alias("yy"), C("x").alias("xx"), "v"), ["yy", "xx"]).select("sample", "x", "y", "v"), "x", "y", "v"),
    f"WITH {LI}, {GRID} SELECT CAST(y * 40 + x AS BIGINT) AS sample, x + 0.5::DOUBLE AS x, y + 0.5::DOUBLE AS y, round(v, 4) AS v FROM grid",
)


def detector_row(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as detectors on a line, three to a place, with what each has seen."""
    own = table(spark, d, "supplier").select(C("s_suppkey").alias("det"), "s_acctbal")
    n = own.agg(F.max("det")).first()[0] // 3 + 1  # one number
    return rounded(si.layout(spark, n, 3, 2.0).join(own, "det").withColumn("seen", C("s_acctbal") * C("c1")).drop("s_acctbal"), "off_x", "off_y", "c1", "c2", "seen")


put(
    "detector_row", detector_row,
    """WITH n AS (SELECT max(s_suppkey) // 3 + 1 AS n FROM supplier) SELECT s_suppkey AS det, round((s_suppkey // 3 / (n - 1)::DOUBLE - 0.5) * 4, 4) AS off_x, round((s_suppkey // 3 / (n - 1)::DOUBLE - 0.5) * 4, 4) AS off_y, 1.0::DOUBLE AS c0,
 round(cos(2 * pi() * (s_suppkey % 3) / 3), 4) AS c1, round(sin(2 * pi() * (s_suppkey % 3) / 3), 4) AS c2, round(s_acctbal * cos(2 * pi() * (s_suppkey % 3) / 3), 4) AS seen FROM supplier, n""",
)


def noise_moments(spark: SparkSession, d: str) -> DataFrame:
    """Seeded noise for every item has the moments asked for, whatever the partitions; equal items get equal noise."""
    rows = si.noise(table(spark, d, "lineitem").select((C("l_linenumber") % 4).alias("det"), "l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber", "l_partkey"], 2.0, 5)
    return rows.groupBy("det").agg((F.abs(F.avg("value")) < 0.3).alias("centred"), (F.abs(F.stddev_pop("value") - 2) < 0.2).alias("scaled"), F.count(F.lit(1)).alias("n"))


put("noise_moments", noise_moments, "SELECT CAST(l_linenumber % 4 AS INT) AS det, true AS centred, true AS scaled, count(*) AS n FROM lineitem GROUP BY 1")


def rendered(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "supplier").select(C("s_suppkey").alias("id"), (C("s_suppkey") * 7 % 40 + 0.25).alias("x"), (C("s_suppkey") * 3 % 25 + 0.5).alias("y"), (C("s_acctbal") / 1000).alias("amp"))
    return rounded(si.render(c, (25, 40), 1.0, 2.0), "value")


put(
    "render_sources", rendered,
    """WITH c AS (SELECT (s_suppkey * 7 % 40) + 0.25 AS x, (s_suppkey * 3 % 25) + 0.5 AS y, s_acctbal / 1000 AS amp FROM supplier), k AS (SELECT CAST(floor(y + 0.5) AS INT) + dy AS iy, CAST(floor(x + 0.5) AS INT) + dx AS ix, x, y, amp FROM c, (SELECT CAST(range AS INT) AS dy FROM range(-2, 3)), (SELECT CAST(range AS INT) AS dx FROM range(-2, 3)))
 SELECT iy AS y, ix AS x, round(sum(amp * exp(-(pow(iy - y, 2) + pow(ix - x, 2)) / 2)), 4) AS value FROM k WHERE iy >= 0 AND iy < 25 AND ix >= 0 AND ix < 40 GROUP BY 1, 2""",
)


def split_sources(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "supplier").select(C("s_suppkey").alias("id"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), C("s_acctbal").alias("amp"))
    return rounded(si.images(c, 4, 0.5, 5000.0), "x", "y")


put(
    "split_sources", split_sources,
    "SELECT s_suppkey AS id, 1.0::DOUBLE AS x, 2.0::DOUBLE AS y, s_acctbal AS amp, CAST(0 AS INT) AS image FROM supplier UNION ALL SELECT s_suppkey, round(1 + 0.5 * cos(pi() * k / 2), 4), round(2 + 0.5 * sin(pi() * k / 2), 4), 0, CAST(k + 1 AS INT) FROM supplier, (SELECT range AS k FROM range(4)) WHERE s_acctbal >= 5000",
)
put(
    "inject_sources", lambda s, d: rounded(si.add_sources(grid(s, d).select((C("y") * 40 + C("x")).alias("sample"), C("y").cast("double").alias("y"), C("x").cast("double").alias("x"), C("v").alias("value")), table(s, d, "supplier").select(C("s_suppkey").cast("int").alias("id"), (C("s_suppkey") * 7 % 40 + 0.25).alias("x"), (C("s_suppkey") * 3 % 25 + 0.5).alias("y"), (C("s_acctbal") / 1000).alias("amp")), "sample", "x", "y", 1.2).select("sample", "value"), "value"),
    f"""WITH {LI}, {GRID}, c AS (SELECT (s_suppkey * 7 % 40) + 0.25::DOUBLE AS sx, (s_suppkey * 3 % 25) + 0.5::DOUBLE AS sy, s_acctbal / 1000 AS amp FROM supplier)
 SELECT y * 40 + x AS sample, round(any_value(v) + coalesce(sum(amp * exp(-(pow(x - sx, 2) + pow(y - sy, 2)) / 2.88)), 0), 4) AS value FROM grid LEFT JOIN c ON sqrt(pow(x - sx, 2) + pow(y - sy, 2)) <= 4.8 GROUP BY y, x""",
)

# ---- chained ownership and catalogue components


def slice_comp(spark: SparkSession, d: str) -> DataFrame:
    """One component out of array columns."""
    e = table(spark, d, "embeddings")
    return rounded(e.select("vec_id", F.element_at("embedding", 3).cast("double").alias("c"), F.size("embedding").cast("long").alias("n")), "c", digits=6)


put("slice_component", slice_comp, "SELECT vec_id, round(CAST(embedding[3] AS DOUBLE), 6) AS c, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")


def tile_search(spark: SparkSession, d: str) -> DataFrame:
    """Tiles with margins, a threshold search in each, and the borders merged: only peaks inside a tile's own box are kept."""
    g = grid(spark, d)
    tiles = bn.tiles(spark, (25, 40), (10, 10))
    # A cell goes to each tile whose box with margin holds it: at most four, by exploding neighbours of its own tile.
    near = F.array(*[F.struct((F.floor(C("y") / 10) + i).cast("int").alias("ty"), (F.floor(C("x") / 10) + j).cast("int").alias("tx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    padded = g.withColumn("t", F.explode(near)).select("y", "x", "v", "t.ty", "t.tx").join(F.broadcast(tiles), ["ty", "tx"])
    padded = padded.where("y >= y0 - 1 AND y < y1 + 1 AND x >= x0 - 1 AND x < x1 + 1")
    best = padded.groupBy("ty", "tx").agg(F.max_by(F.struct("v", "y", "x", "y0", "y1", "x0", "x1"), F.struct(C("v"), -C("y"), -C("x"))).alias("b")).select("ty", "tx", "b.*")
    return rounded(best.where("y >= y0 AND y < y1 AND x >= x0 AND x < x1").select("ty", "tx", "y", "x", "v"), "v")


put(
    "tile_search", tile_search,
    f"""WITH {LI}, {GRID}, t AS (SELECT CAST(i AS INT) AS ty, CAST(j AS INT) AS tx, i * 10 AS y0, least(i * 10 + 10, 25) AS y1, j * 10 AS x0, least(j * 10 + 10, 40) AS x1 FROM range(3) a(i), range(4) b(j)),
 p AS (SELECT *, row_number() OVER (PARTITION BY ty, tx ORDER BY v DESC, y, x) AS k FROM grid JOIN t ON y >= y0 - 1 AND y < y1 + 1 AND x >= x0 - 1 AND x < x1 + 1) SELECT ty, tx, y, x, round(v, 4) AS v FROM p WHERE k = 1 AND y >= y0 AND y < y1 AND x >= x0 AND x < x1""",
)
put(
    "moving_mask", lambda s, d: ca.pairs(grid(s, d).select((C("y") * 40 + C("x")).alias("id"), C("x").cast("double").alias("x"), C("y").cast("double").alias("y")), table(s, d, "nation").select(C("n_nationkey").alias("id"), (C("n_nationkey") * 1.55).alias("x"), (12 + 7 * F.sin("n_nationkey")).alias("y")), "id", "x", "y", 1.3).select("id").distinct(),
    f"WITH {LI}, {GRID} SELECT DISTINCT y * 40 + x AS id FROM grid JOIN (SELECT n_nationkey * 1.55::DOUBLE AS tx, 12 + 7 * sin(n_nationkey) AS ty FROM nation) ON sqrt(pow(x - tx, 2) + pow(y - ty, 2)) <= 1.3",
)

# ---- noise models and object search


def scans(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).withColumns({"scan": C("det") % 10, "cut": C("event_type") == "error"}).select("scan", "det", "sample", "value", "cut")


Q["noise_weighted"] = lambda s, d: nm.weighted(scans(s, d).drop("cut"), "scan", "det", "sample", "value", 5, window=6)
Q["gapfill_constrained"] = lambda s, d: no.constrained(scans(s, d), "scan", "det", "sample", "value", "cut", rounds=1)
Q["find_sources"] = lambda s, d: fd.find(grid(s, d).select("y", "x", "v", F.lit(1e-3).alias("w")), "v", "w", 1.2, 16, 5, 4.0)
put(
    "forced_amplitudes", lambda s, d: rounded(fd.forced(grid(s, d).withColumn("w", 1 + C("x") / 10), table(s, d, "supplier").select(C("s_suppkey").alias("id"), (C("s_suppkey") * 7 % 25).cast("int").alias("y"), (C("s_suppkey") * 11 % 40).cast("int").alias("x")), "v", "w", 2, 1.5), "amp", "damp"),
    f"""WITH {LI}, {GRID}, st AS (SELECT s_suppkey AS id, s_suppkey * 7 % 25 + i AS y, s_suppkey * 11 % 40 + j AS x, exp(-(i * i + j * j) / 4.5) AS b FROM supplier, (SELECT range AS i FROM range(-2, 3)), (SELECT range AS j FROM range(-2, 3)))
 SELECT id, round(sum(b * v * (1 + x / 10.0)) / sum(b * b * (1 + x / 10.0)), 4) AS amp, round(1 / sqrt(sum(b * b * (1 + x / 10.0))), 4) AS damp FROM st JOIN grid USING (y, x) GROUP BY 1""",
)

QUERIES, ORACLE = Q, {k: nudged(v) for k, v in O.items()}
