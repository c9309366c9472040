"""Stand-ins for the domain's tables, in Spark and as SQL, so that queries and their twins start alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """det (user), sample (place in the user's events), value, event_type, t (seconds since 2024)."""
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    at = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200.0
    return ev.select(F.col("user_id").alias("det"), at.alias("sample"), "value", "event_type", sec.alias("t"), "event_id")


SAMPLES = """samples AS (SELECT user_id AS det, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS sample,
 value, event_type, epoch_us(ts) / 1e6 - 1704067200.0 AS t, event_id FROM events)"""


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("det")).agg(F.count(F.lit(1)).cast("int").alias("n"))


LENGTHS = "lengths AS (SELECT user_id AS det, CAST(count(*) AS INT) AS n FROM events GROUP BY 1)"


def runs_sql(name: str, mask: str, source: str = "samples") -> str:
    """Runs of a mask as SQL: name(det, lo, hi)."""
    return f"""{name} AS (SELECT det, CAST(min(sample) AS INT) AS lo, CAST(max(sample) + 1 AS INT) AS hi FROM
 (SELECT det, sample, sample - row_number() OVER (PARTITION BY det ORDER BY sample) AS g FROM {source} WHERE {mask}) GROUP BY det, g)"""


def merge_sql(name: str, source: str) -> str:
    """Union of touching ranges as SQL. Equal ranges are taken once: the order of ties may differ between the two windows."""
    return f"""{name} AS (SELECT det, CAST(min(lo) AS INT) AS lo, CAST(max(hi) AS INT) AS hi FROM (SELECT *, sum(isnew) OVER (PARTITION BY det ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM
 (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY det ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS isnew FROM (SELECT DISTINCT det, lo, hi FROM ({source})) WHERE lo < hi)) GROUP BY det, island)"""


def ranges_sql(select: str, *more: str) -> str:
    return "WITH " + ",\n".join([SAMPLES, LENGTHS, ERRORS_SQL, CLICKS_SQL, *more]) + "\n" + select


ERRORS_SQL = runs_sql("errs", "event_type = 'error'")
CLICKS_SQL = runs_sql("high", "value > 60")


#: Added before rounding on both sides: decimal data give exact ties, which engines that sum in another order break differently.
NUDGE = 1e-9


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + NUDGE, digits) for n in names})


def nudged(sql: str) -> str:
    """The same for each two-argument round() of a query."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, k, comma = 1, start + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if sql[k] == "," and depth == 1:
                comma = k
            k += 1
        inner = nudged(sql[start + 6 : comma if comma > 0 else k - 1])
        out.append(sql[at:start] + (f"round({inner} + {NUDGE}{sql[comma:k]}" if comma > 0 else f"round({inner})"))
        at = k
    return "".join(out) + sql[at:]
