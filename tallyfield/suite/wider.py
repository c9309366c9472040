"""Queries on stores of scans, settings and small files, sets of maps, moving objects, and what else the library holds."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as fn
from ..lineage import cut
from ..operators import binning as bn
from ..operators import filters as fi
from ..operators import intervals as iv
from ..operators import mapmaker as mm
from ..operators import mapset as ms
from ..operators import motion as mo
from ..operators import noise as no
from ..operators import numerics as nu
from ..operators import scans as sc
from ..operators import sequences as sq
from ..operators import simulate as si
from ..operators import tables as tb
from ..plans.tagquery import TagTable
from ..sources import text
from .base import ERRORS_SQL, lengths, LENGTHS, nudged, rounded, samples, SAMPLES, table
from .grids import CAT, cat, GRID, grid, LI, li
from .more import scratch
from .numbers import sky, SYS, systems, VEC

Q: dict = {}
O: dict[str, str] = {}
C = F.col
SHAPE = (25, 40)


def put(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    Q[name] = f
    if sql:
        O[name] = sql


# ---- stores of scans; a scan is ten detectors


def stored(spark: SparkSession, d: str) -> sc.Scans:
    rows = samples(spark, d).withColumn("scan", F.floor(C("det") / 10).cast("int"))
    errs = iv.from_mask(rows, ["scan", "det"], "sample", C("event_type") == "error")
    path = scratch(spark, "scans")
    parts = {"samples": rows.select("scan", "det", "sample", "value"), "boresight": rows.where("det % 10 = 0").select("scan", "sample", "t"), "detectors": rows.select("scan", "det").distinct(), "cuts": errs.select("scan", "det", "lo", "hi")}
    sc.write_scans(parts, path)
    return sc.Scans(spark, path)


put(
    "scan_store", lambda s, d: stored(s, d).select(ids=[0, 1, 2, 999], without=[3, 14]).slice(4, 40, 3).slice(1).part("samples").select("scan", "det", "sample", "value"),
    f"WITH {SAMPLES} SELECT CAST(det // 10 AS INT) AS scan, det, CAST((sample - 7) // 3 AS INT) AS sample, value FROM samples WHERE det // 10 IN (0, 1, 2, 999) AND det NOT IN (3, 14) AND sample >= 7 AND sample < 40 AND (sample - 7) % 3 = 0",
)
put(
    "scan_store_cuts", lambda s, d: stored(s, d).slice(5, 50, 4).part("cuts").select("scan", "det", "lo", "hi"),
    f"WITH {SAMPLES}, {ERRORS_SQL} SELECT CAST(det // 10 AS INT) AS scan, det, CAST(floor(greatest(lo - 5, 0) / 4.0) AS INT) AS lo, CAST(ceil((least(hi, 50) - 5) / 4.0) AS INT) AS hi FROM errs WHERE floor(greatest(lo - 5, 0) / 4.0) < ceil((least(hi, 50) - 5) / 4.0)",
)


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(C("s_suppkey").alias("id"), (C("s_nationkey") % 5 * 30 + C("s_suppkey") % 4 * 0.1).alias("az"), (C("s_nationkey") % 3 * 10 + C("s_suppkey") % 7 * 0.05).alias("el"))


BOXES = "boxes AS (SELECT s_suppkey AS id, s_nationkey % 5 * 30 + s_suppkey % 4 * 0.1::DOUBLE AS az, s_nationkey % 3 * 10 + s_suppkey % 7 * 0.05::DOUBLE AS el FROM supplier)"
put(
    "scan_patterns", lambda s, d: rounded(sc.patterns(boxes(s, d), "id", ["az", "el"], 0.5)[1].select(C("pattern").cast("long").alias("pattern"), "min_az", "max_az", "min_el", "max_el"), "min_az", "max_az", "min_el", "max_el"),
    f"WITH {BOXES} SELECT row_number() OVER (ORDER BY a, b) - 1 AS pattern, round(min(az), 6) AS min_az, round(max(az), 6) AS max_az, round(min(el), 6) AS min_el, round(max(el), 6) AS max_el FROM (SELECT *, floor(az / 10) AS a, floor(el / 5) AS b FROM boxes) GROUP BY a, b",
)
put(
    "scan_pattern_of", lambda s, d: sc.patterns(boxes(s, d), "id", ["az", "el"], 0.5)[0].select("id", C("pattern").cast("long").alias("pattern")),
    f"WITH {BOXES} SELECT id, dense_rank() OVER (ORDER BY floor(az / 10), floor(el / 5)) - 1 AS pattern FROM boxes",
)
put(
    "scan_shares", lambda s, d: sc.balanced(table(s, d, "orders").select("o_orderkey", F.floor(C("o_totalprice")).alias("cost")), "o_orderkey", "cost", 7, 1000),
    "SELECT o_orderkey, CAST(least(6, floor((sum(c) OVER (ORDER BY o_orderkey) - c / 2) * 7 / sum(c) OVER ())) AS INT) AS worker FROM (SELECT o_orderkey, floor(o_totalprice) AS c FROM orders)",
)


def flags_store(spark: SparkSession, d: str) -> DataFrame:
    """Flag points written with their names and read back, told by name."""
    path = scratch(spark, "flags")
    text.write_flags(samples(spark, d).select("det", "sample", F.when(C("event_type") == "error", 1).otherwise(0).alias("flags")), path, ["error", "late"], {"bad": (["error", "late"], [])})
    points, flags, derived = text.read_flags(spark, path)
    return points.where(C("flags").bitwiseAND(1 << flags.index(derived["bad"][0][0])) > 0).groupBy("det").agg(F.count(F.lit(1)).alias("n"))


put("flags_store", flags_store, "SELECT user_id AS det, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")


def noise_store(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "noise")
    rows = samples(spark, d).groupBy("det").agg(F.var_pop("value").alias("v"))
    models = rows.select("det", F.when(C("det") % 2 == 0, "white").otherwise("binned").alias("kind"), F.array(F.struct(F.lit(0.0).alias("f0"), F.lit(1.0).alias("f1"), F.array("v").alias("d"))).alias("bins"))
    text.write_noise(models, path)
    return rounded(text.read_noise(spark, path, "white").select("det", C("bins")[0]["d"][0].alias("var")), "var", digits=4)


put("noise_store", noise_store, "SELECT user_id AS det, round(var_pop(value), 4) AS var FROM events WHERE user_id % 2 = 0 GROUP BY 1")

# ---- small files and settings


def table_files(spark: SparkSession, d: str) -> DataFrame:
    """A table in three formats, read by their endings."""
    path, out = scratch(spark, "tables"), None
    for kind in ("parquet", "json", "csv"):
        df = table(spark, d, "supplier").select("s_suppkey", "s_name")
        df.write.format(kind).option("header", True).save(f"{path}/t.{kind}")
        got = text.read_table(spark, f"{path}/t.{kind}").select(C("s_suppkey").cast("long").alias("id"), "s_name", F.lit(kind).alias("kind"))
        out = got if out is None else out.unionByName(got)
    return out


put("table_files", table_files, "SELECT s_suppkey AS id, s_name, kind FROM supplier, (VALUES ('parquet'), ('json'), ('csv')) t(kind)")


def region_boxes(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "boxes")
    s = table(spark, d, "supplier").select("s_suppkey")
    line = F.when(C("s_suppkey") % 2 == 0, F.format_string("fk5;box(%d.5, -%d, 4, 2) # color", C("s_suppkey"), C("s_suppkey"))).otherwise(F.format_string("%d, %d  -1 1", C("s_suppkey"), C("s_suppkey") + 3))
    s.select(line.alias("value")).unionByName(spark.createDataFrame([("# comment",), ("",), ("global color=green",)], "value string")).write.text(path)
    return text.read_boxes(spark, path)


put("region_boxes", region_boxes, "SELECT CASE WHEN k % 2 = 0 THEN k - 1.5 ELSE k END::DOUBLE AS ra0, CASE WHEN k % 2 = 0 THEN k + 2.5 ELSE k + 3 END::DOUBLE AS ra1, CASE WHEN k % 2 = 0 THEN -k - 1 ELSE -1 END::DOUBLE AS dec0, CASE WHEN k % 2 = 0 THEN 1 - k ELSE 1 END::DOUBLE AS dec1 FROM (SELECT s_suppkey AS k FROM supplier)")


def fixed_lines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "fixed")
    table(spark, d, "supplier").select(F.format_string("%8d %-20s%12.2f", "s_suppkey", "s_name", "s_acctbal").alias("value")).unionByName(spark.createDataFrame([("    head of the table",)], "value string")).write.text(path)
    return text.read_fixed(spark, path, [("id", 1, 8, "bigint"), ("name", 10, 20, "string"), ("balance", 30, 12, "double")])


put("fixed_lines", fixed_lines, "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")


def float_records(spark: SparkSession, d: str) -> DataFrame:
    """A binary file with a header of three numbers, as some catalogues come, written by Spark from suppliers and read."""
    path = scratch(spark, "floats")
    own = table(spark, d, "supplier").select("s_suppkey", C("s_acctbal").cast("float").alias("a"), (C("s_nationkey") / 8).cast("float").alias("b"))
    lines = own.agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "a", "b"))).alias("v"))  # one record file, as the format is

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return pd.Series([np.array([len(x), 0, 0], "<u4").tobytes() + np.array([(r["a"], r["b"]) for r in x], "<f4").tobytes() for x in v])

    content = lines.select(packed("v").alias("content")).first().content
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/catalog.bin")
    out = at.getFileSystem(conf).create(at)
    out.write(bytearray(content))
    out.close()
    rows = text.read_floats(spark, f"{path}/catalog.bin", 2, 12)
    return rounded(rows.select("row", C("values")[0].cast("double").alias("a"), C("values")[1].cast("double").alias("b")), "a", "b", digits=3)


put("float_records", float_records, "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row, round(CAST(CAST(s_acctbal AS FLOAT) AS DOUBLE), 3) AS a, round(s_nationkey / 8::DOUBLE, 3) AS b FROM supplier")


def beams(spark: SparkSession, d: str) -> DataFrame:
    """Profiles as text: a line a nation of `l b`, and a line a supplier of b alone, in order."""
    two, one = scratch(spark, "beam"), scratch(spark, "beam")
    table(spark, d, "nation").select(F.concat_ws(" ", C("n_nationkey") * 10, 1 / (C("n_nationkey") + 1.0)).alias("value")).coalesce(1).write.text(two)
    table(spark, d, "supplier").orderBy("s_suppkey").select(F.format_string("%.6f", C("s_acctbal")).alias("value")).coalesce(1).write.text(one)
    parts = [text.read_beam(spark, p).withColumn("name", F.lit(n)) for n, p in (("two", two), ("one", one))]
    return rounded(parts[0].unionByName(parts[1]), "b")


put("beam_lines", beams, "SELECT 'two' AS name, n_nationkey * 10::DOUBLE AS l, round(1 / (n_nationkey + 1)::DOUBLE, 6) AS b FROM nation UNION ALL SELECT 'one', (row_number() OVER (ORDER BY s_suppkey) - 1)::DOUBLE, round(s_acctbal, 6) FROM supplier")


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest with a line a nation, and a gain and a frequency that are numbers."""
    path = scratch(spark, "manifest")
    n = table(spark, d, "nation").select(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" : map"), C("n_nationkey"), F.lit(":"), C("n_regionkey"), F.lit(".parquet ")).alias("value"))
    more = table(spark, d, "region").agg(F.count(F.lit(1)).alias("k"), F.sum("r_regionkey").alias("s")).select(F.explode(F.array(F.concat(F.lit("gain: "), C("k") / 4), F.lit(""), F.concat(F.lit("freq : "), C("s") * 10))).alias("value"))
    n.unionByName(more).coalesce(1).write.text(path)
    found = text.parse_manifest(text.lines_of(spark, path))
    return spark.createDataFrame([(k, str(v), isinstance(v, float)) for k, v in found.items()], "name string, value string, number boolean")


put(
    "manifest_lines", manifest,
    """SELECT lower(n_name) AS name, 'map' || n_nationkey || ':' || n_regionkey || '.parquet' AS value, false AS number FROM nation UNION ALL SELECT 'gain', CAST(count(*) / 4 AS DOUBLE)::VARCHAR, true FROM region
 UNION ALL SELECT 'freq', CAST(sum(r_regionkey) * 10 AS DOUBLE)::VARCHAR, true FROM region""",
)


def settings(spark: SparkSession, d: str) -> DataFrame:
    """A setting a nation: defaults, a file of every second, a command line of every third, a lower value, a block, arguments."""
    s = text.Settings()
    names = [(r.n_name, r.n_nationkey) for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    name = lambda n: n.lower().replace(" ", "_")
    for n, k in names:
        s.default(name(n), k)
    s.load([f"{name(n)} = {k + 100} # from a file" for n, k in names if k % 2 == 0])
    rest = s.parse(["in.txt", *[w for n, k in names if k % 3 == 0 for w in (f"--{name(n)}", str(k + 200))]])
    for n, k in names:
        s.set(name(n), k + 300, 0)
    rows = []
    for n, k in names:
        with s.scoped(name(n), -1):
            inside = s.get(name(n))
        rows.append((k, s.get(name(n)), s.get(name(n), override=7), inside, len(rest)))
    return spark.createDataFrame(rows, "k int, value int, asked int, inside int, rest int")


put("settings_priorities", settings, "SELECT n_nationkey AS k, n_nationkey + CASE WHEN n_nationkey % 3 = 0 THEN 200 WHEN n_nationkey % 2 = 0 THEN 100 ELSE 300 END AS value, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey + 200 ELSE 7 END AS asked, CAST(-1 AS INT) AS inside, CAST(1 AS INT) AS rest FROM nation")
put(
    "typed_settings", lambda s, d: table(s, d, "part").select("p_partkey", fn.typed(C("p_name"), "float").alias("f"), fn.typed(F.concat(F.lit(" "), C("p_size")), "int").alias("i"), fn.typed(F.when(C("p_size") % 2 == 0, "Yes").otherwise("off"), "bool").alias("b"), fn.is_number(F.concat(C("p_size"), F.when(C("p_size") % 3 == 0, "x").otherwise(".5"))).alias("num")),
    "SELECT p_partkey, TRY_CAST(p_name AS DOUBLE) AS f, p_size::BIGINT AS i, p_size % 2 = 0 AS b, p_size % 3 <> 0 AS num FROM part",
)
put(
    "split_settings", lambda s, d: table(s, d, "part").select("p_partkey", fn.head_of(F.concat(C("p_brand"), F.lit(" : a:b "))).alias("head"), fn.tail_of(F.concat(C("p_brand"), F.lit(" : a:b "))).alias("tail"), fn.tail_of(C("p_brand")).alias("none")),
    "SELECT p_partkey, p_brand AS head, 'a:b' AS tail, '' AS none FROM part",
)
put(
    "formatted_lists", lambda s, d: table(s, d, "nation").select("n_nationkey", fn.formatted_all(F.create_map(F.lit("tod"), F.array(F.lit("/data/{r}/{k}.x"), F.lit("/{no}/{k}"))), F.create_map(F.lit("r"), C("n_regionkey").cast("string"), F.lit("k"), C("n_nationkey").cast("string")))["tod"].alias("v")).select("n_nationkey", C("v")[0].alias("a"), C("v")[1].alias("b")),
    "SELECT n_nationkey, printf('/data/%d/%d.x', n_regionkey, n_nationkey) AS a, printf('/{no}/%d', n_nationkey) AS b FROM nation",
)
put(
    "evaluated_rules", lambda s, d: text.evaluated(table(s, d, "nation").select("n_nationkey", "n_regionkey"), [("area", "concat('area', n_regionkey)"), ("day", "n_nationkey * 3"), ("root", "concat('/data/{area}/', day)")], {"tod": "{root}/tod", "cut": "{root}/{day}.cut"}).select("n_nationkey", C("paths")["tod"].alias("tod"), C("paths")["cut"].alias("cut")),
    "SELECT n_nationkey, printf('/data/area%d/%d/tod', n_regionkey, n_nationkey * 3) AS tod, printf('/data/area%d/%d/%d.cut', n_regionkey, n_nationkey * 3, n_nationkey * 3) AS cut FROM nation",
)
put(
    "overridden_paths", lambda s, d: table(s, d, "nation").select("n_nationkey", text.override(F.create_map(F.lit("tod"), F.array(F.lit("x")), F.lit("cut"), F.array(C("n_name"))), "tod:/new/{id},noise:n").alias("p")).select("n_nationkey", C("p")["tod"][0].alias("tod"), C("p")["cut"][0].alias("cut"), C("p")["noise"][0].alias("noise")),
    "SELECT n_nationkey, '/new/{id}' AS tod, n_name AS cut, 'n' AS noise FROM nation",
)


def select_ids(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a table by a list of ids, in the list's order."""
    nations = TagTable(table(spark, d, "nation"), "n_nationkey").with_defaults(deep=False)
    ids = spark.range(5).select((24 - C("id") * 5).cast("int").alias("n_nationkey"), C("id").alias("_pos"))
    got = nations.select(ids)
    return got.df.select("n_nationkey", "n_name", "deep", C("_pos").alias("pos"), F.lit(",".join(nations.tags())).alias("tags"))


put("tag_select_ids", select_ids, "SELECT n_nationkey, n_name, false AS deep, CAST((24 - n_nationkey) // 5 AS BIGINT) AS pos, 'deep,n_name,n_nationkey,n_regionkey' AS tags FROM nation WHERE (24 - n_nationkey) % 5 = 0")
put(
    "tag_functor", lambda s, d: TagTable(table(s, d, "supplier"), "s_suppkey", functors={"rich": lambda df: lambda c: c > F.lit(df.agg(F.avg("s_acctbal")).first()[0])}, functions={"twice": lambda c: c * 2}).query("rich(s_acctbal),twice(s_nationkey)<30").select("s_suppkey"),
    "SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier) AND s_nationkey < 15",
)

# ---- samples

put(
    "shift_samples", lambda s, d: tb.shift(tb.restrict_samples(samples(s, d).select("det", "sample", "value"), "sample", 3, 20, (0, 30)), "det", "sample", 100, -3),
    f"WITH {SAMPLES} SELECT det + 100 AS det, sample - 3 AS sample, value FROM samples WHERE sample >= 3 AND sample < 20",
)
put("range_empty", lambda s, d: iv.invert(iv.empty(lengths(s, d), ["det"]), lengths(s, d), ["det"]), f"WITH {LENGTHS} SELECT det, CAST(0 AS INT) AS lo, n AS hi FROM lengths WHERE n > 0")
put(
    "edge_weights", lambda s, d: rounded(grid(s, d).select("y", "x", (sq.feather(40, C("x"), 5) * C("v")).alias("feather"), (sq.tent(C("y"), 25) * C("v")).alias("tent")), "feather", "tent", digits=4),
    f"WITH {LI}, {GRID} SELECT y, x, round(v * least(1, (x + 1) / 6.0, (40 - x) / 6.0), 4) AS feather, round(v * (1 - abs(2 * (y + 0.5) / 25 - 1)), 4) AS tent FROM grid",
)


def spoiled(spark: SparkSession, d: str) -> DataFrame:
    """Gain errors: one factor a detector, none beyond the width."""
    rows = samples(spark, d).where("value <> 0").select("det", "sample", "value", C("value").alias("old"))
    ratio = fi.spoil(rows, "det", "value", 0.1, 3).groupBy("det").agg(F.min(C("value") / C("old")).alias("a"), F.max(C("value") / C("old")).alias("b"))
    return ratio.select("det", (F.abs(C("a") - C("b")) < 1e-9).alias("steady"), (F.abs(C("a") - 1) < 0.25).alias("bounded"))


put("spoil_gains", spoiled, f"WITH {SAMPLES} SELECT DISTINCT det, true AS steady, true AS bounded FROM samples WHERE value <> 0")
put(
    "template_amplitude", lambda s, d: rounded(mm.Equations(samples(s, d).select("value", (C("sample") % 5 + 1).cast("double").alias("w"), (C("sample") % 7).cast("double").alias("c")), [mm.template("drift", "c")]).solve(steps=2).select("idx", "value"), "value", digits=6),
    f"WITH {SAMPLES} SELECT 'drift' AS idx, round(sum((sample % 5 + 1) * (sample % 7) * value) / sum((sample % 5 + 1) * (sample % 7) * (sample % 7)), 6) AS value FROM samples",
)
put(
    "hit_counts", lambda s, d: mm.Binned("sky", ["y", "x"]).hits(li(s, d)).select(F.split("idx", ":")[1].cast("int").alias("y"), F.split("idx", ":")[2].cast("int").alias("x"), "d"),
    f"WITH {LI} SELECT y, x, count(*)::DOUBLE AS d FROM li GROUP BY 1, 2",
)


def map_with_prior(spark: SparkSession, d: str) -> DataFrame:
    """A weighted mean that a prior pulls to 0: sum(w d) / (sum(w) + 50)."""
    rows = li(spark, d).select("l_linenumber", C("q").alias("value"), (1 + C("c1")).alias("w"))
    x = mm.Equations(rows, [mm.Binned("ground", ["l_linenumber"])], priors=[lambda v: v.withColumn("value", C("value") * 50)]).solve(steps=7, enough=1e-20)
    return rounded(x.select(F.split("idx", ":")[1].cast("int").alias("l_linenumber"), "value"), "value", digits=4)


put("map_make_prior", map_with_prior, f"WITH {LI} SELECT l_linenumber, round(sum(q * (1 + c1)) / (sum(1 + c1) + 50), 4) AS value FROM li GROUP BY 1")
put("prior_norm", lambda s, d: rounded(fi.norm_penalty(grid(s, d), "v", 0.25).select("y", "x", "prior"), "prior", digits=4), f"WITH {LI}, {GRID} SELECT y, x, round(v / 4, 4) AS prior FROM grid")
put(
    "prior_pickup", lambda s, d: rounded(ms.pickup_of(li(s, d).select("y", "x", "l_linenumber"), grid(s, d).select("y", "x", C("v").alias("value")), ["y", "x"], ["l_linenumber"], 2.0), "prior", digits=4),
    f"WITH {LI}, {GRID}, p AS (SELECT l_linenumber, sum(v) / (count(*) * count(*)) AS p FROM li JOIN grid USING (y, x) GROUP BY 1) SELECT y, x, round(2 * sum(p), 4) AS prior FROM li JOIN p USING (l_linenumber) GROUP BY 1, 2",
)
put(
    "prior_edges", lambda s, d: rounded(table(s, d, "part").select("p_partkey", ms.edge_prior(C("p_size") / 10.0, C("p_retailprice"), 2.5).alias("e")), "e", digits=5),
    "SELECT p_partkey, round(exp(ln(10) * (1 - least(p_size / 25.0, 1)) + ln(0.01) * least(p_size / 25.0, 1)) * p_retailprice, 5) AS e FROM part",
)


def basis(spark: SparkSession, d: str) -> DataFrame:
    """Parameters that stand for the samples of each run of errors: det, lo, place in the run, parameter, share."""
    errs = cut(iv.from_mask(samples(spark, d), ["det"], "sample", C("event_type") == "error"))
    out = None
    for kind in ("bin:2", "full", "none", "poly:2"):
        own = no.cut_parameters(errs, ["det"], kind).withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return rounded(out, "v")


put(
    "cut_bases", basis,
    f"""WITH {SAMPLES}, {ERRORS_SQL}, k AS (SELECT det, lo, hi - lo AS n, unnest(range(hi - lo))::INT AS i FROM errs) SELECT 'bin:2' AS kind, det, lo, i, (i // 2)::INT AS j, 1.0::DOUBLE AS v FROM k UNION ALL SELECT 'full', det, lo, i, i, 1 FROM k UNION ALL SELECT 'poly:2', det, lo, i, 0, 1 FROM k
 UNION ALL SELECT 'poly:2', det, lo, i, 1, round(2 * i / (n - 1)::DOUBLE - 1, 6) FROM k WHERE n > 1 AND 2 * i <> n - 1""",
)
put(
    "low_rank_expanded", lambda s, d: rounded(systems(s, d).select("p_partkey", nu.per_row(nu.expand_low_rank)(F.array(*map(F.lit, (1.0, 2.0, 3.0))), "b", F.array(F.lit(0.5))).alias("m")).select("p_partkey", C("m")[0].alias("m0"), C("m")[1].alias("m1"), C("m")[8].alias("m8")), "m0", "m1", "m8"),
    f"WITH {SYS} SELECT p_partkey, round(1.5, 6)::DOUBLE AS m0, round(b / 2, 6) AS m1, round(3 + a * a / 2, 6) AS m8 FROM sys",
)

# ---- moving objects and cuts


def ephemeris(spark: SparkSession, d: str) -> DataFrame:
    """Values at the table's own times, and between them where the course is a straight line: an object a detector."""
    base = samples(spark, d).select(C("det").alias("id"), (C("sample") * 2.0).alias("t"), F.max("sample").over(W.partitionBy("det")).alias("last"))
    known = base.select("id", "t", F.when(C("id") % 2 == 0, C("t") * (C("id") % 7 + 1) + 3).otherwise(F.sin("t") * C("id")).alias("ra"), (C("id") * 1.0 + C("t") / 8).alias("dec"))
    asked = base.where("t < 2 * last").select("id", (C("t") + F.when(C("id") % 2 == 0, 0.75).otherwise(0.0)).alias("t"))
    return rounded(mo.spline(known, asked, "id", "t", ["ra", "dec"]), "ra", "dec", digits=5)


put(
    "ephemeris_spline", ephemeris,
    f"""WITH {SAMPLES}, b AS (SELECT det AS id, sample * 2.0::DOUBLE + CASE WHEN det % 2 = 0 THEN 0.75 ELSE 0 END AS t, sample, max(sample) OVER (PARTITION BY det) AS last FROM samples)
 SELECT id, t, round(CASE WHEN id % 2 = 0 THEN t * (id % 7 + 1) + 3 ELSE sin(t) * id END, 5) AS ra, round(id + t / 8, 5) AS dec FROM b WHERE sample < last""",
)
put(
    "displaced_objects", lambda s, d: rounded(sky(s, d).select("id", mo.displaced(C("lon"), C("lat"), F.lit(5.0), (0.3, -0.9, 0.2)).alias("a")).select("id", "a.lon", "a.lat"), "lon", "lat"),
    f"WITH {VEC}, w AS (SELECT id, 5 * x - 0.3 AS x, 5 * y + 0.9 AS y, 5 * z - 0.2 AS z FROM v) SELECT id, round(atan2(y, x), 6) AS lon, round(atan2(z, sqrt(x * x + y * y)), 6) AS lat FROM w",
)


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """A place on the plane for each sample: detectors run along x."""
    return samples(spark, d).select("det", "sample", (C("det") * 7 % 400 + C("sample") * 0.5).alias("px"), (C("det") * 3 % 50).cast("double").alias("py"))


TRACKS = f"{SAMPLES}, tr AS (SELECT det, sample, det * 7 % 400 + sample * 0.5::DOUBLE AS px, (det * 3 % 50)::DOUBLE AS py FROM samples)"
RUNS = "SELECT det, CAST(min(sample) AS INT) AS lo, CAST(max(sample) + 1 AS INT) AS hi FROM (SELECT det, sample, sample - row_number() OVER (PARTITION BY det ORDER BY sample) AS g FROM hit) GROUP BY det, g"


def bodies(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(C("s_suppkey").alias("id"), (C("s_suppkey") * 37 % 400 + 0.2).alias("x"), (C("s_suppkey") * 13 % 50 + 0.3).alias("y"), (C("s_acctbal") / 100).alias("amp"))


BODIES = "bodies AS (SELECT s_suppkey AS id, s_suppkey * 37 % 400 + 0.2::DOUBLE AS x, s_suppkey * 13 % 50 + 0.3::DOUBLE AS y, s_acctbal / 100 AS amp FROM supplier)"
put(
    "cut_near_bodies", lambda s, d: mo.cut_near(tracks(s, d), bodies(s, d), ["det"], "sample", "px", "py", 3.05).select("det", C("lo").cast("int").alias("lo"), C("hi").cast("int").alias("hi")),
    f"WITH {TRACKS}, {BODIES}, hit AS (SELECT DISTINCT det, sample FROM tr JOIN bodies ON sqrt(pow(px - x, 2) + pow(py - y, 2)) <= 3.05) {RUNS}",
)
REACH = 2.0 * math.sqrt(2 * math.log(1e4))
put(
    "cut_bright_bodies", lambda s, d: mo.cut_bright(tracks(s, d), bodies(s, d), ["det"], "sample", "px", "py", 2.0, 20.0, 12.0, [(0.0, 0.0), (1.5, -0.5)]).select("det", C("lo").cast("int").alias("lo"), C("hi").cast("int").alias("hi")),
    f"WITH {TRACKS}, {BODIES}, m AS (SELECT det, sample, k, sum(amp * exp(-r2 / 8)) AS m FROM (SELECT det, sample, k, amp, pow(px + dx - x, 2) + pow(py + dy - y, 2) AS r2 FROM tr, (VALUES (0, 0.0, 0.0), (1, 1.5, -0.5)) o(k, dx, dy), bodies WHERE amp >= 20) WHERE r2 <= {REACH * REACH!r} GROUP BY 1, 2, 3), hit AS (SELECT DISTINCT det, sample FROM m WHERE m > 12) {RUNS}",
)
put(
    "plausible_orbits", lambda s, d: mo.plausible(table(s, d, "part").select("p_partkey", (C("p_size") * 20.0).alias("r"), (C("p_retailprice") / 1000).alias("vx"), F.lit(0.1).alias("vy"), (C("p_partkey") % 90 / 60.0).alias("lat")), "r", "vx", "vy", "lat", 200.0, 900.0, 3.0, 0.8).select("p_partkey"),
    "SELECT p_partkey FROM part WHERE p_size * 20 BETWEEN 200 AND 900 AND sqrt(pow(p_retailprice / 1000, 2) + 0.01) <= 3 * pow(200 / (p_size * 20.0), 1.5) AND p_partkey % 90 / 60.0 <= 0.8",
)
put(
    "limit_distances", lambda s, d: rounded(mo.limit_distance(table(s, d, "lineitem").select(C("l_linenumber").alias("k"), C("l_quantity").cast("double").alias("r")).distinct().withColumn("f", 100.0 - C("r") * C("k")), ["k"], "r", "f", 50.0), "limit_r"),
    """WITH c AS (SELECT DISTINCT l_linenumber AS k, l_quantity::DOUBLE AS r FROM lineitem), n AS (SELECT k, r, lead(r) OVER (PARTITION BY k ORDER BY r) AS next FROM c)
 SELECT c.k, (SELECT round(50 / any_value(n.k)::DOUBLE, 6) FROM n WHERE n.k = c.k AND n.r * n.k <= 50 AND n.next * n.k > 50) AS limit_r FROM (SELECT DISTINCT k FROM c) c""",
)


def rand_sources(spark: SparkSession, d: str) -> DataFrame:
    """As many random sources as there are items, tied to them by number: in the box, with the mean amplitude."""
    n = table(spark, d, "lineitem").count()
    r = si.sources(spark, (10.0, 30.0, -5.0, 5.0), n, 2.0, 9)
    return r.agg(F.count(F.lit(1)).alias("n"), F.bool_and(C("x").between(10, 30) & C("y").between(-5, 5) & (C("amp") > 0)).alias("inside"), (F.abs(F.avg("amp") - 2) < 0.2).alias("mean_amp"), (F.abs(F.avg("x") - 20) < 0.5).alias("centred"))


put("random_sources", rand_sources, "SELECT count(*) AS n, true AS inside, true AS mean_amp, true AS centred FROM lineitem")
put(
    "track_mask", lambda s, d: mo.near_track(cat(s, d).select("id", C("px").alias("x"), C("py").alias("y")), samples(s, d).groupBy("det").agg(F.max("sample").alias("k")).select(C("det").cast("long").alias("id"), (C("det") * 3.5 % 400).alias("x"), (25 + 20 * F.sin(C("det") / 9)).alias("y")), 0.8, 400.0),
    f"WITH {CAT}, t AS (SELECT DISTINCT user_id * 3.5::DOUBLE % 400 AS x, 25 + 20 * sin(user_id / 9) AS y FROM events) SELECT DISTINCT id FROM cat JOIN t ON sqrt(pow(least(abs(px - x), 400 - abs(px - x)), 2) + pow(py - y, 2)) <= 0.8",
)

# ---- sets of maps

put("tile_bounds", lambda s, d: tile_bounds(s, d), f"WITH {LI}, {GRID} SELECT min(y // 8)::INT AS min_ty, max(y // 8)::INT AS max_ty, min(x // 10)::INT AS min_tx, max(x // 10)::INT AS max_tx FROM grid")


def tile_bounds(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "tiles")
    text.write_tiles(bn.retile(grid(spark, d), 8, 10), path)
    return text.tile_range(spark, path)


def rhs(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).withColumns({"r": C("v") / 10 - 20, "k": F.when((C("y") + C("x")) % 11 == 0, 0.0).otherwise(C("v") / 3)})


RHS = f"{LI}, {GRID}, g AS (SELECT y, x, v / 10 - 20 AS r, CASE WHEN (y + x) % 11 = 0 THEN 0 ELSE v / 3 END AS k, v FROM grid)"
put(
    "map_normalization", lambda s, d: rounded(ms.normalization(rhs(s, d), "r", "k", 5, SHAPE), "a"),
    f"WITH {RHS}, b AS (SELECT sum(k * r * r) / sum(k * k) AS a, count(*) FILTER (k > (SELECT max(k) FROM g) * 1e-4) / 25.0 AS h FROM g GROUP BY y // 5, x // 5) SELECT round(median(a), 6) AS a FROM b WHERE h >= 0.5",
)
BETWEEN = """SELECT c.y, c.x, round(sum({f}n * (CASE WHEN dy = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE WHEN dx = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END)), 5) AS s
 FROM c, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx), q WHERE q."by" = floor(fy) + dy AND q.bx = floor(fx) + dx GROUP BY 1, 2"""
put(
    "smooth_norm", lambda s, d: rounded(ms.smooth_normalization(rhs(s, d), "r", "k", 5, SHAPE, 1.0).withColumnRenamed("norm", "s"), "s", digits=5),
    f"""WITH {RHS}, b AS (SELECT y // 5 AS "by", x // 5 AS bx, count(*) FILTER (hit) AS m, avg(CASE WHEN hit THEN r * r / k END) AS u FROM (SELECT *, k > (SELECT max(k) FROM g) * 1e-4 AS hit FROM g) GROUP BY 1, 2),
 o AS (SELECT *, m > 25 / 3.0 AND abs(ln(u / (SELECT median(u) FROM b WHERE m > 25 / 3.0))) < 1 AS ok FROM b), q AS (SELECT "by", bx, CASE WHEN coalesce(ok, false) THEN u ELSE (SELECT median(u) FROM o WHERE ok) END AS n FROM o),
 c AS (SELECT y, x, greatest(0, least(4, y / 5.0)) AS fy, greatest(0, least(7, x / 5.0)) AS fx FROM grid) """ + BETWEEN.format(f=""),
)
put(
    "foreground_var", lambda s, d: ms.foreground_variance(grid(s, d), "v", 3, 2, SHAPE).select("y", "x", F.round(F.ln(C("var") / 0.5) + 1e-9, 5).alias("s")),
    f"""WITH {LI}, {GRID}, a AS (SELECT y // 3 AS y, x // 3 AS x, var_pop(v) AS v FROM grid GROUP BY 1, 2), b AS (SELECT y // 2 AS "by", x // 2 AS bx, median(v) AS v FROM a GROUP BY 1, 2),
 q AS (SELECT "by", bx, ln(CASE WHEN v = 0 THEN (SELECT median(v) FROM b WHERE v <> 0) ELSE v END) AS n FROM b), c AS (SELECT y, x, greatest(0, least(4, (y + 0.5) / 6 - 0.5)) AS fy, greatest(0, least(6, (x + 0.5) / 6 - 0.5)) AS fx FROM grid) """ + BETWEEN.format(f=""),
)
put(
    "foreground_weights", lambda s, d: rounded(ms.weight_by_foreground(grid(s, d).select("y", "x", (C("v") / 1000).alias("iv"), (C("x") / 4.0).alias("var")), "iv", "var").select("y", "x", "iv"), "iv"),
    f"WITH {LI}, {GRID}, g AS (SELECT y, x, 1000 / v AS own, x / 4.0 AS f FROM grid) SELECT y, x, round(1 / (own * greatest(1, pow(f / own, 2))), 6) AS iv FROM g",
)
put(
    "sanitized_maps", lambda s, d: rounded(ms.sanitized(grid(s, d).select("y", "x", "v", F.when(C("x") == 3, C("v") * 1000).when(C("x") == 5, C("v") / 20).otherwise(C("v")).alias("w")), "v", "w", 160.0), "v", "w", digits=3),
    f"WITH {LI}, {GRID}, g AS (SELECT y, x, v, CASE x WHEN 3 THEN v * 1000 WHEN 5 THEN v / 20 ELSE v END AS w FROM grid), r AS (SELECT median(w) AS ref FROM g WHERE w > 0.9 * (SELECT median(w) FROM g WHERE w > 0)) SELECT y, x, round(greatest(-160, least(160, v)), 3) AS v, round(least(w, ref * 20) * pow(least(least(w, ref * 20) / (ref * 0.2), 1), 5), 3) AS w FROM g, r",
)
put("sufficient_cells", lambda s, d: ms.enough([li(s, d).where("l_linenumber = 7").select("y", "x", C("q").alias("w")), li(s, d).where("q > 49").select("y", "x", C("c1").alias("w"))], "w"), f"WITH {LI} SELECT y, x FROM (SELECT y, x, q AS w FROM li WHERE l_linenumber = 7 UNION ALL SELECT y, x, c1 FROM li WHERE q > 49) GROUP BY 1, 2 HAVING sum(w) > 0")
HOT = f"{LI}, {GRID}, hot AS (SELECT y, x FROM grid WHERE v > (SELECT quantile_cont(v, 0.97) FROM grid))"


def hot(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    return g.join(F.broadcast(g.agg(F.percentile("v", 0.97).alias("m")))).where("v > m").select("y", "x")


put("mask_within", lambda s, d: ms.within(hot(s, d), 3), f"WITH {HOT} SELECT DISTINCT CAST(y + i AS INT) AS y, CAST(x + j AS INT) AS x FROM hot, (SELECT range AS i FROM range(-3, 4)), (SELECT range AS j FROM range(-3, 4)) WHERE i * i + j * j <= 9")


def cold(spark: SparkSession, d: str) -> DataFrame:
    return ms.grown(grid(spark, d).select("y", "x").join(hot(spark, d), ["y", "x"], "left_anti"), SHAPE, 2)


put("mask_grown", cold, f"WITH {HOT} SELECT y, x FROM grid WHERE NOT EXISTS (SELECT 1 FROM hot h WHERE pow(h.y - grid.y, 2) + pow(h.x - grid.x, 2) <= 4) AND NOT EXISTS (SELECT 1 FROM (SELECT i AS y, j AS x FROM range(25) a(i), range(40) b(j) EXCEPT SELECT y, x FROM grid) o WHERE pow(o.y - grid.y, 2) + pow(o.x - grid.x, 2) <= 4)")
put("thumb_placed", lambda s, d: rounded(ms.placed(grid(s, d).where("y < 9 AND x < 11"), (9, 11), (2, 38), SHAPE), "v", digits=4), f"WITH {LI}, {GRID} SELECT CAST((y - 4 + 2 + 25) % 25 AS INT) AS y, CAST((x - 5 + 38) % 40 AS INT) AS x, round(v, 4) AS v FROM grid WHERE y < 9 AND x < 11")
put("unpadded_map", lambda s, d: rounded(ms.unpadded(grid(s, d), 4, SHAPE), "v", digits=4), f"WITH {LI}, {GRID} SELECT y - 4 AS y, x - 4 AS x, round(v, 4) AS v FROM grid WHERE y BETWEEN 4 AND 20 AND x BETWEEN 4 AND 35")
put(
    "composed_filter", lambda s, d: rounded(table(s, d, "part").select("p_partkey", ms.composed([("radial", {"knee": 20.0}), ("invert", {}), ("axial", {"axis": "y", "knee": 5.0, "alpha": -2.0, "most": 6.0})], C("p_partkey") % 9 * 1.0, C("p_size") * 1.0).alias("f")), "f"),
    "WITH p AS (SELECT p_partkey, p_partkey % 9 AS a, p_size AS b FROM part) SELECT p_partkey, round((1 - 1 / (1 + pow(sqrt(a * a + b * b) / 20.0, -3))) * CASE WHEN a = 0 THEN 0 WHEN a <= 6 THEN 1 / (1 + pow(a / 5.0, -2)) ELSE 1 END, 6) AS f FROM p",
)
put("mean_source_model", lambda s, d: rounded(ms.mean_model(li(s, d).withColumn("m", F.when(C("q") > 10, -C("q"))), ["y", "x"], "m"), "model", digits=5), f"WITH {LI} SELECT y, x, round(avg(CASE WHEN q > 10 THEN -q ELSE 0 END), 5) AS model FROM li GROUP BY 1, 2")
put(
    "source_stamps", lambda s, d: rounded(ms.stamps(li(s, d), table(s, d, "supplier").select(C("s_suppkey").alias("id"), (C("s_suppkey") * 7 % 25).cast("double").alias("y"), (C("s_suppkey") * 11 % 40).cast("double").alias("x")), "fy", "fx", "q", 1), "value", digits=5),
    f"WITH {LI}, s AS (SELECT s_suppkey AS id, s_suppkey * 7 % 25 AS sy, s_suppkey * 11 % 40 AS sx FROM supplier), n AS (SELECT floor(fy + 0.5) AS ny, floor(fx + 0.5) AS nx, q FROM li) SELECT id, CAST(ny - sy AS INT) AS dy, CAST(nx - sx AS INT) AS dx, round(avg(q), 5) AS value, count(*) AS hits FROM n JOIN s ON ny BETWEEN sy - 1 AND sy + 1 AND nx BETWEEN sx - 1 AND sx + 1 GROUP BY 1, 2, 3",
)
put(
    "many_beams", lambda s, d: rounded(ms.many_beams(li(s, d), ["l_orderkey", "l_linenumber"], C("fy"), C("fx"), [(0.0, 0.0, 1.0), (2.0, -3.0, -0.25), (40.0, 0.0, 5.0)], grid(s, d), "v"), "model", digits=4),
    f"WITH {LI}, {GRID}, b AS (SELECT l_orderkey, l_linenumber, floor(fy + dy + 0.5) AS y, floor(fx + dx + 0.5) AS x, c FROM li, (VALUES (0.0, 0.0, 1.0), (2.0, -3.0, -0.25), (40.0, 0.0, 5.0)) t(dy, dx, c)) SELECT l_orderkey, l_linenumber, round(sum(coalesce(v, 0) * c), 4) AS model FROM b LEFT JOIN grid USING (y, x) GROUP BY 1, 2",
)
put(
    "source_response", lambda s, d: rounded(ms.source_response(cat(s, d), bodies(s, d), "id", "px", "py", 1.5, 3.0), "response"),
    f"WITH {CAT}, {BODIES} SELECT c.id, round(sum(exp(-(pow(px - x, 2) + pow(py - y, 2)) / 4.5)), 6) AS response FROM cat c JOIN bodies b ON sqrt(pow(px - x, 2) + pow(py - y, 2)) <= 4.5 GROUP BY 1",
)

put(
    "smoothed_map", lambda s, d: rounded(ms.smoothed(grid(s, d), "v", 1.2, 3.0), "v", digits=5),
    f"WITH {LI}, {GRID} SELECT a.y, a.x, round(sum(b.v * exp(-(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) / 2.88)) / sum(exp(-(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) / 2.88)), 5) AS v FROM grid a JOIN grid b ON abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3 GROUP BY 1, 2",
)
put(
    "reprojected_map", lambda s, d: rounded(ms.reprojected(grid(s, d), "v", (12, 30), C("oy") * 2.25 - 1.5, C("ox") * 1.5 - 2.25), "v", digits=4),
    f"""WITH {LI}, {GRID}, o AS (SELECT i AS oy, j AS ox, i * 2.25::DOUBLE - 1.5 AS fy, j * 1.5::DOUBLE - 2.25 AS fx FROM range(12) a(i), range(30) b(j))
 SELECT CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, round(sum(coalesce(v, 0) * (CASE WHEN dy = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE WHEN dx = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END)), 4) AS v
 FROM o CROSS JOIN (VALUES (0), (1)) a(dy) CROSS JOIN (VALUES (0), (1)) b(dx) LEFT JOIN grid ON grid.y = floor(fy) + dy AND grid.x = floor(fx) + dx GROUP BY 1, 2""",
)
put(
    "coadded_maps", lambda s, d: rounded(ms.coadded([(grid(s, d).select("y", "x", "v", (C("x") * 1.0).alias("w")), 1.0), (grid(s, d).where("y > 5").select("y", "x", (C("v") / 2 + 1).alias("v"), F.lit(3.0).alias("w")), 0.5)], "v", "w"), "v", "w", digits=4),
    f"WITH {LI}, {GRID} SELECT y, x, round(coalesce(sum(g * w * v) / nullif(sum(g * g * w), 0), 0), 4) AS v, round(sum(g * g * w), 4) AS w FROM (SELECT y, x, v, x * 1.0::DOUBLE AS w, 1.0::DOUBLE AS g FROM grid UNION ALL SELECT y, x, v / 2 + 1, 3, 0.5 FROM grid WHERE y > 5) GROUP BY 1, 2",
)
put(
    "shrunk_map", lambda s, d: rounded(ms.shrunk(grid(s, d).withColumn("w", C("x") / 10.0), "v", "w", F.lit(2.5)).select("y", "x", "v", "dev"), "v", "dev", digits=5),
    f"WITH {LI}, {GRID} SELECT y, x, round(v * 0.25 * x / (1 + 0.25 * x), 5) AS v, round(sqrt(2.5 / (1 + 0.25 * x)), 5) AS dev FROM grid",
)


def knees(spark: SparkSession, d: str) -> DataFrame:
    """Spectra made with known knees, a supplier each over the frequencies of its items, found again."""
    rows = table(spark, d, "lineitem").select(C("l_suppkey").alias("k"), (50.0 * (1 + C("l_partkey") % 100)).alias("l")).distinct()
    rows = rows.withColumn("p", 3.0 * (1 + F.pow(C("l") / (300.0 + 40 * (C("k") % 30)), F.lit(-4.0))))
    lists = rows.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("l", "p"))).alias("s"))
    return rounded(lists.select("k", nu.per_row(nu.knee, T.DoubleType())(F.transform("s", lambda x: x["p"]), F.transform("s", lambda x: x["l"])).alias("knee")), "knee", digits=2)


put("spectral_knees", knees, "SELECT DISTINCT l_suppkey AS k, 300.0::DOUBLE + 40 * (l_suppkey % 30) AS knee FROM lineitem")

QUERIES, ORACLE = Q, {k: nudged(v) for k, v in O.items()}
