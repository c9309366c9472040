"""What only larger tables showed: ties, scans that small tables lack, and angles at the cut."""

from __future__ import annotations

import collections
import itertools
import math

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F
from tallyfield import catalog
from tallyfield.operators import numerics
from tallyfield.suite.base import merge_sql


def test_equal_ranges_are_no_ties_in_sql():
    """Two windows in a row may put ties in different orders, which only many threads show: what they read has to have none."""
    sql = merge_sql("m", "SELECT * FROM r UNION ALL SELECT * FROM r")
    read = sql[sql.index("FROM (SELECT DISTINCT") + 5 : sql.index(" WHERE lo < hi)")]
    con = duckdb.connect()
    con.execute("CREATE TABLE r AS SELECT i AS det, 3 AS lo, 5 AS hi FROM range(5) t(i)")
    assert con.execute(f"SELECT count(*), count(DISTINCT det) FROM {read}").fetchone() == (5, 5)
    assert sorted(con.execute(f"WITH {sql} SELECT * FROM m").fetchall()) == [(k, 3, 5) for k in range(5)]


def test_scan_999_is_asked_for(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet").withColumn("user_id", F.expr("CASE WHEN user_id % 2 = 0 THEN 9990 + user_id % 10 ELSE user_id END"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert oracle.difference(spark, con, catalog.QUERIES["scan_store"], catalog.ORACLE["scan_store"], str(tmp_path)) == ""
    assert 999 in {r.scan for r in catalog.QUERIES["scan_store"](spark, str(tmp_path)).select("scan").collect()}


def test_half_turns_come_back_as_one_angle(spark, tmp_path):
    """73 k = 1800 modulo 3600: a longitude of 180 degrees, on either side of the cut by its last bit."""
    keys = spark.range(1800, 900_000, 3600).select(F.col("id").alias("c_custkey"))
    keys.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert oracle.difference(spark, con, catalog.QUERIES["recentre_back"], catalog.ORACLE["recentre_back"], str(tmp_path)) == ""


def test_covariance_of_one_span_is_not_summed_again(spark):
    """At a lag too: its n^2 rows leave the tasks as they are, without a shuffle."""
    df = spark.range(60).selectExpr("id % 3 det", "id div 3 at", "id * 1.0D v")
    plan = numerics.covariance(df, "det", "at", "v", 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Project") and "Aggregate" not in plan.split("FlatMapGroups")[0]


def on_disk(spark) -> dict[str, int]:
    """Name -> bytes of the files that tasks have written for others."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName(): files.apply(k).length() for k in range(files.size())}


def test_covariance_puts_samples_on_disk_not_pairs(spark, monkeypatch):
    """Eight times the keys give 64 times the pairs, and eight times the files' bytes."""
    monkeypatch.setattr(numerics, "TILE", 4)
    used = []
    for n in (64, 512):
        df = spark.range(n * 60).select((F.col("id") % n).alias("det"), F.floor(F.col("id") / n).alias("at"), F.rand(n).alias("v"))
        before = on_disk(spark)
        assert numerics.covariance(df, "det", "at", "v", 1).count() == n * n
        used.append(sum(b for name, b in on_disk(spark).items() if name not in before))
    assert used[1] < 16 * used[0]


@pytest.mark.parametrize("span, shift, lag", [(16384, 0, 1), (16384, -3, 1), (16384, 10**9, 0), (4, 0, 1), (4, -9, -6), (4, 2, 9)])
def test_covariance_of_odd_values(spark, monkeypatch, span, shift, lag):
    """Not-a-number and infinity reach only the pairs that have them; a null key is a key, a null place none; rows of one place add up."""
    monkeypatch.setattr(numerics, "TILE", 2)
    monkeypatch.setattr(numerics, "SPAN", span)
    rows = [(k, t, float((k or 0) + t * t % 7)) for k in (1, 2, 3, 4, 5, None) for t in range(12) if (t + (k or 0)) % 5]
    rows += [(6, 3, math.nan), (6, 4, 2.0), (7, 5, math.inf), (7, 9, 1.0), (1, 2, 8.0), (2, None, 5.0), (3, 7, None)]
    got = {(r.i, r.j): r.cov for r in numerics.covariance(spark.createDataFrame([(k, None if t is None else t + shift, v) for k, t, v in rows], "det int, at long, v double"), "det", "at", "v", lag).collect()}
    want = collections.defaultdict(list)
    rows = [r for r in rows if None not in r[1:]]
    for (i, t, a), (j, u, b) in itertools.product(rows, rows):
        if u == t + lag:
            want[i, j].append(a * b)
    assert got == pytest.approx({k: sum(v) / len(v) for k, v in want.items()}, nan_ok=True)
