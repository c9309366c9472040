"""Queries on observation tables: the query language, merges, semi and anti joins, strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import tables as tb
from ..plans.tagquery import TagTable
from .base import LENGTHS, SAMPLES, samples, table

Q: dict = {}
O: dict[str, str] = {}


def orders(spark: SparkSession, d: str, **more: object) -> TagTable:
    return TagTable(table(spark, d, "orders").drop("o_orderdate"), "o_orderkey", **more)


def tag_query(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).query("o_orderstatus=='F',(o_totalprice>100000)&(o_totalprice<200000)").select("o_orderkey", "o_totalprice")


Q["tag_query"] = tag_query
O["tag_query"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_totalprice < 200000"


def tag_query_sorted_slice(spark: SparkSession, d: str) -> DataFrame:
    """Filter, sort and slice in one query string; a slice from the start is a top-k, never a full sort."""
    return orders(spark, d).query("o_orderstatus=='F',o_totalprice>100000:o_totalprice[:20]").select("o_orderkey", "o_totalprice", F.col("_pos").cast("long").alias("pos"))


Q["tag_query_sorted_slice"] = tag_query_sorted_slice
O["tag_query_sorted_slice"] = """SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS pos FROM orders
 WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice, o_orderkey LIMIT 20"""


def tag_query_negative_slice(spark: SparkSession, d: str) -> DataFrame:
    return TagTable(table(spark, d, "customer"), "c_custkey").query("c_mktsegment=='BUILDING':c_acctbal[-5:]").select("c_custkey", "c_acctbal")


Q["tag_query_negative_slice"] = tag_query_negative_slice
O["tag_query_negative_slice"] = "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 5"


def tag_query_step_slice(spark: SparkSession, d: str) -> DataFrame:
    return TagTable(table(spark, d, "part"), "p_partkey").query("p_size<20:p_retailprice[::-7]").select("p_partkey", F.col("_pos").cast("long").alias("pos"))


Q["tag_query_step_slice"] = tag_query_step_slice
O["tag_query_step_slice"] = """WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS k, count(*) OVER () AS n FROM part WHERE p_size < 20)
 SELECT p_partkey, CAST((n - 1 - k) // 7 AS BIGINT) AS pos FROM r WHERE (n - 1 - k) % 7 = 0"""


def tag_query_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Conjuncts with an aggregate see the survivors of the ones before."""
    return orders(spark, d).query("o_orderstatus=='O',o_totalprice>mean(o_totalprice),o_totalprice<median(o_totalprice)").select("o_orderkey", "o_totalprice")


Q["tag_query_aggregate"] = tag_query_aggregate
O["tag_query_aggregate"] = """WITH a AS (SELECT * FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT * FROM a WHERE o_totalprice > (SELECT avg(o_totalprice) FROM a))
 SELECT o_orderkey, o_totalprice FROM b WHERE o_totalprice < (SELECT median(o_totalprice) FROM b)"""


def tag_query_functions(spark: SparkSession, d: str) -> DataFrame:
    t = TagTable(table(spark, d, "part"), "p_partkey", default="p_retailprice>950", functions={"cube": lambda c: c * c * c})
    return t.query("sqrt(p_size)>4,isin(p_type,['ECONOMY','SMALL']),(floor(p_retailprice)%2==0)|(cube(p_size)>60000)").select("p_partkey", "p_size", "p_type")


Q["tag_query_functions"] = tag_query_functions
O["tag_query_functions"] = """SELECT p_partkey, p_size, p_type FROM part WHERE sqrt(p_size) > 4 AND p_type IN ('ECONOMY', 'SMALL')
 AND (CAST(floor(p_retailprice) AS BIGINT) % 2 = 0 OR CAST(p_size AS BIGINT) * p_size * p_size > 60000) AND p_retailprice > 950"""


def tag_query_id_tag(spark: SparkSession, d: str) -> DataFrame:
    t = TagTable(table(spark, d, "nation").withColumn("id", F.col("n_name")), "id")
    names = [r.n_name for r in table(spark, d, "nation").orderBy("n_nationkey").limit(2).collect()]
    return t.query("|".join(f"(id=='{n}')" for n in names) + "|(n_regionkey==3)").select("n_nationkey", "n_name")


Q["tag_query_id_tag"] = tag_query_id_tag
O["tag_query_id_tag"] = "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 2) OR n_regionkey = 3"


def file_semi(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "labels").where("quality = 1").select("doc_id")
    t = TagTable(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id", lists={"good": ids})
    return t.query("@good,n_chars>500").select("doc_id", "lang")


Q["file_semi"] = file_semi
O["file_semi"] = "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND n_chars > 500"


def file_anti(spark: SparkSession, d: str) -> DataFrame:
    t = TagTable(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", lists={"known": table(spark, d, "labels").select("doc_id")})
    return t.query("~@known").select("doc_id", "lang")


Q["file_anti"] = file_anti
O["file_anti"] = "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"


def list_override(spark: SparkSession, d: str) -> DataFrame:
    """@@ gives the list's ids as they are, known or not."""
    ids = table(spark, d, "benchmark").select((F.col("item_id") * 1000).alias("o_orderkey"))
    return orders(spark, d, lists={"f": ids}).query("o_totalprice>0,@@f").select("o_orderkey")


Q["list_override"] = list_override
O["list_override"] = "SELECT item_id * 1000 AS o_orderkey FROM benchmark"


def tag_merge_outer(spark: SparkSession, d: str) -> DataFrame:
    """All customers with all orders; a customer without orders is a row of one side only."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("rich"), F.col("c_nationkey").alias("code"), F.col("c_acctbal").alias("amount"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.max("o_totalprice") > 400000).alias("rich"), F.count(F.lit(1)).cast("int").alias("n_orders"))
    return tb.outer_merge([a, b], "id")


Q["tag_merge_outer"] = tag_merge_outer
O["tag_merge_outer"] = """WITH a AS (SELECT c_custkey AS id, c_acctbal > 0 AS rich, c_nationkey AS code, c_acctbal AS amount FROM customer),
 b AS (SELECT o_custkey AS id, max(o_totalprice) > 400000 AS rich, CAST(count(*) AS INT) AS n_orders FROM orders GROUP BY 1)
 SELECT coalesce(a.id, b.id) AS id, coalesce(a.rich, false) OR coalesce(b.rich, false) AS rich, coalesce(code, -1) AS code, amount, coalesce(n_orders, -1) AS n_orders FROM a FULL JOIN b ON a.id = b.id"""


def tag_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("tag"))
    return tb.tag_members(rows, "id", "tag", ["click", "error", "purchase"])


Q["tag_pivot"] = tag_pivot
O["tag_pivot"] = """SELECT user_id AS id, bool_or(event_type = 'click') AS click, bool_or(event_type = 'error') AS error, bool_or(event_type = 'purchase') AS purchase
 FROM events GROUP BY 1"""


def field_intersection(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).select("det", "sample", "value")
    return tb.intersection([s.where("det < 100 AND sample >= 5"), s.where("det >= 50 AND sample < 45").withColumn("value", F.col("value") * 2)], "det", "sample").groupBy("field", "det").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


Q["field_intersection"] = field_intersection
O["field_intersection"] = f"""WITH {SAMPLES} SELECT CAST(f AS INT) AS field, det, count(*) AS n, round(sum(value * (f + 1)), 4) AS total FROM samples, (VALUES (0), (1)) v(f)
 WHERE det >= 50 AND det < 100 AND sample >= 5 AND sample < 45 GROUP BY 1, 2"""


def detector_union(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).select("det", "sample", "value")
    return tb.stack_detectors([s, tb.shift(s, "det", "sample", by_det=1_000_000)], "det").groupBy("det").agg(F.count(F.lit(1)).alias("n"))


Q["detector_union"] = detector_union
O["detector_union"] = f"WITH {LENGTHS} SELECT det, CAST(n AS BIGINT) AS n FROM lengths UNION ALL SELECT det + 1000000, CAST(n AS BIGINT) FROM lengths"


def restrict_dets(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(9, 0), (3, 1), (7, 2)], "det long, _pos int")
    out = tb.restrict(samples(spark, d).select("det", "sample", "value"), "det", wanted)
    return tb.restrict_samples(out, "sample", 2, 30, (0, 49)).groupBy("det", F.col("_pos").alias("pos")).agg(F.round(F.sum("value"), 4).alias("total"))


Q["restrict_dets"] = restrict_dets
O["restrict_dets"] = f"WITH {SAMPLES} SELECT det, CAST(CASE det WHEN 9 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS INT) AS pos, round(sum(value), 4) AS total FROM samples WHERE det IN (9, 3, 7) AND sample >= 2 AND sample < 30 GROUP BY 1, 2"


def last_source_wins(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return tb.last_source([p.where("p_size < 30"), p.where("p_size > 20").withColumn("p_retailprice", F.col("p_retailprice") + 1)], "p_partkey")


Q["last_source_wins"] = last_source_wins
O["last_source_wins"] = "SELECT p_partkey, p_size, CASE WHEN p_size > 20 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part"


def sub_ids(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat_ws(":", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.lit("f090,f150"))).alias("id"))
    return n.select("k", fn.base_id(F.col("id")).alias("base"), fn.sub_id(F.col("id")).alias("sub"), fn.with_sub(fn.base_id(F.col("id")), fn.sub_id(F.col("id"))).alias("again"), fn.union_subs(fn.sub_id(F.col("id")), F.lit("f220,f090")).alias("merged"))


Q["sub_ids"] = sub_ids
O["sub_ids"] = """SELECT n_nationkey AS k, n_name AS base, CASE WHEN n_nationkey % 2 = 0 THEN 'f090,f150' ELSE '' END AS sub,
 n_name || CASE WHEN n_nationkey % 2 = 0 THEN ':f090,f150' ELSE '' END AS again, CASE WHEN n_nationkey % 2 = 0 THEN 'f090,f150,f220' ELSE 'f090,f220' END AS merged FROM nation"""


def parse_props(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    return ev.select("event_id", fn.typed(k, "int").alias("k"), fn.is_number(k).alias("num"), fn.typed(F.when(F.col("event_id") % 2 == 0, F.lit("yes")).otherwise(F.lit("off")), "bool").alias("flag"))


Q["parse_props"] = parse_props
O["parse_props"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, true AS num, event_id % 2 = 0 AS flag FROM events"


def url_rules(spark: SparkSession, d: str) -> DataFrame:
    """Path rules over ids: blocks, variables and templates as columns."""
    from ..sources.text import Rules

    rules = Rules.parse(["root = /data", "scheme: {root}/{kind}/{id}.parquet", "@kind: https", "beam: {root}/beam_{host}.txt {root}/common.txt", "@else", "beam: {root}/plain.txt # unsafe", "@end"])
    p = table(spark, d, "pages").select("page_id", "url")
    out = rules.apply(p, "page_id", {"kind": F.split("url", ":")[0], "host": F.regexp_extract("url", r"//([^/]+)", 1)})
    return out.select("page_id", F.col("paths")["scheme"][0].alias("scheme"), F.array_join(F.col("paths")["beam"], " ").alias("beam"))


Q["url_rules"] = url_rules
O["url_rules"] = r"""SELECT page_id, '/data/' || split_part(url, ':', 1) || '/' || page_id || '.parquet' AS scheme,
 CASE WHEN split_part(url, ':', 1) = 'https' THEN '/data/beam_' || regexp_extract(url, '//([^/]+)', 1) || '.txt /data/common.txt' ELSE '/data/plain.txt' END AS beam FROM pages"""


def dataset_select(spark: SparkSession, d: str) -> DataFrame:
    """Boolean tag expression over tag sets."""
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("tags"))
    has = lambda t: F.array_contains("tags", t)
    return p.where((has("red") | has("blue")) & ~has("ring")).select("p_partkey", F.element_at("tags", 1).alias("first_tag"))


Q["dataset_select"] = dataset_select
O["dataset_select"] = """WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS tags FROM part)
 SELECT p_partkey, tags[1] AS first_tag FROM p WHERE (list_contains(tags, 'red') OR list_contains(tags, 'blue')) AND NOT list_contains(tags, 'ring')"""


def value_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mergeable moments per name: n, mean, deviation, last; by total."""
    ev = table(spark, d, "events")
    return ev.groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("dev"), F.max_by("value", "event_id").alias("last")).orderBy(F.desc(F.col("n") * F.col("mean")))


Q["value_stats"] = value_stats
O["value_stats"] = "SELECT event_type AS name, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS dev, arg_max(value, event_id) AS last FROM events GROUP BY 1"


def det_gain_lines(spark: SparkSession, d: str) -> DataFrame:
    """One line per scan with `det:gain` items in order."""
    s = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.round(F.sum("l_quantity")).cast("long").alias("g"))
    items = F.sort_array(F.collect_list(F.struct("l_linenumber", "g")))
    return s.groupBy(F.col("l_suppkey").alias("scan")).agg(F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["l_linenumber"], x["g"])), " ").alias("line"))


Q["det_gain_lines"] = det_gain_lines
O["det_gain_lines"] = """WITH g AS (SELECT l_suppkey, l_linenumber, CAST(round(sum(l_quantity)) AS BIGINT) AS g FROM lineitem GROUP BY 1, 2)
 SELECT l_suppkey AS scan, string_agg(l_linenumber || ':' || g, ' ' ORDER BY l_linenumber) AS line FROM g GROUP BY 1"""


def links_compact(spark: SparkSession, d: str) -> DataFrame:
    """Ragged source x detector links: kept pairs (those with an item sent back), unused ranges dropped, the rest numbered anew."""
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_linenumber").cast("long").alias("det"), F.col("l_partkey").alias("range_id"), "l_returnflag")
    ranges = table(spark, d, "part").select(F.col("p_partkey").alias("range_id"), F.lit(0).alias("lo"), F.col("p_size").alias("hi"))
    links, used = tb.compact(items.drop("l_returnflag"), ranges, items.where("l_returnflag = 'R'").select("src", "det").distinct())
    return links.join(used, "range_id").groupBy("src", "det").agg(F.count(F.lit(1)).alias("n"), F.sum("range_id").alias("ids"), F.sum(F.col("hi") - F.col("lo")).alias("covered"))


Q["links_compact"] = links_compact
O["links_compact"] = """WITH k AS (SELECT l_suppkey AS src, CAST(l_linenumber AS BIGINT) AS det, l_partkey AS p FROM lineitem WHERE (l_suppkey, l_linenumber) IN (SELECT (l_suppkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'R')),
 u AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i FROM (SELECT DISTINCT p FROM k))
 SELECT src, det, count(*) AS n, CAST(sum(i) AS BIGINT) AS ids, CAST(sum(p_size) AS BIGINT) AS covered FROM k JOIN u USING (p) JOIN part ON p_partkey = p GROUP BY 1, 2"""

QUERIES, ORACLE = Q, O
