"""Queries on fits of many groups and on joint modes; twins hold what was planted, or sums that have to agree."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fits, lowrank
from .base import nudged, rounded, samples, SAMPLES, table

Q: dict = {}
O: dict[str, str] = {}
C = F.col


def put(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    Q[name], O[name] = f, sql


# ---- spectra with a rise and a loss planted for each supplier


def planted(key: Column) -> dict[str, Column]:
    """Level, knees and slopes as functions of a whole number."""
    return {"level": 1 + key % 11 / 4.0, "knee1": 2500.0 + 60 * (key % 25), "slope1": -2.5 - key % 7 / 4.0, "knee2": 500.0 + 25 * (key % 20), "slope2": -6.0 - key % 5 / 2.0}


def butterworth_fits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(C("l_suppkey").alias("k"), (150.0 + 97 * (C("l_partkey") % 90)).alias("l"))
    p = planted(C("k"))
    power = p["level"] * (1 + F.pow(C("l") / p["knee1"], p["slope1"])) / (1 + F.pow(C("l") / p["knee2"], p["slope2"]))
    fit = fits.fit_double_butterworth(rows.withColumn("power", power), ["k"], "l", "power")
    return rounded(fit.select("k", "level", "knee1", "slope1", "knee2", "slope2", "converged"), "level", "knee1", "slope1", "knee2", "slope2", digits=2)


put(
    "butterworth_fits", butterworth_fits,
    """SELECT k, round(1 + k % 11 / 4.0::DOUBLE, 2) AS level, 2500.0::DOUBLE + 60 * (k % 25) AS knee1, round(-2.5::DOUBLE - k % 7 / 4.0::DOUBLE, 2) AS slope1, 500.0::DOUBLE + 25 * (k % 20) AS knee2, round(-6.0::DOUBLE - k % 5 / 2.0::DOUBLE, 2) AS slope2, true AS converged
 FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem)""",
)


def decays(spark: SparkSession, d: str) -> DataFrame:
    """An exponential in the number of each kind of event over time, by Gauss-Newton: value = a exp(-b t)."""
    rows = samples(spark, d).select("event_type", (C("sample") / 20.0).alias("t"), F.lit(1.0).alias("w"))
    kind = F.length("event_type")
    rows = rows.withColumn("v", (2.0 + kind) * F.exp(-(0.1 + kind / 20.0) * C("t")))
    model = lambda p: (p["a"] * F.exp(-p["b"] * C("t")), [F.exp(-p["b"] * C("t")), -p["a"] * C("t") * F.exp(-p["b"] * C("t"))])
    start = rows.select("event_type").distinct().select("event_type", F.lit(1.0).alias("a"), F.lit(1.0).alias("b"))
    return rounded(fits.gauss_newton(rows, ["event_type"], "v", "w", model, start, ["a", "b"]).select("event_type", "a", "b"), "a", "b", digits=4)


put("exponential_fits", decays, f"WITH {SAMPLES} SELECT DISTINCT event_type, round(2.0::DOUBLE + length(event_type), 4) AS a, round(0.1::DOUBLE + length(event_type) / 20.0::DOUBLE, 4) AS b FROM samples")


# ---- joint modes


def joint_mode(spark: SparkSession, d: str) -> DataFrame:
    """One mode planted in tens of parts: its strength and its weights."""
    p = table(spark, d, "part").select((C("p_partkey") % 3).alias("grp"), F.floor(C("p_partkey") / 3 % 10).cast("int").alias("det"), F.floor(C("p_partkey") / 30).alias("at"))
    rows = p.withColumn("v", (1.0 + C("det")) * (C("at") % 7 + 1 + C("grp"))).where(C("at") < F.lit(table(spark, d, "part").agg(F.floor(F.max("p_partkey") / 30)).first()[0]))
    found = lowrank.vectors(rows, ["grp"], "det", "at", "v", 16, lambda s: np.arange(len(s)) == 0)
    return rounded(found.select("grp", "det", "v", "s"), "v", "s", digits=5)


put(
    "joint_mode", joint_mode,
    """WITH p AS (SELECT CAST(p_partkey % 3 AS BIGINT) AS grp, CAST(floor(p_partkey / 3.0) % 10 AS INT) AS det, CAST(p_partkey // 30 AS BIGINT) AS t FROM part),
 r AS (SELECT *, (1.0 + det) * (t % 7 + 1 + grp) AS v FROM p WHERE t < (SELECT max(p_partkey) // 30 FROM part)), s AS (SELECT grp, sqrt(sum(v * v)) AS s FROM r GROUP BY 1), e AS (SELECT grp, sqrt(sum(pow(1 + det, 2))) AS e FROM (SELECT DISTINCT grp, det FROM r) GROUP BY 1)
 SELECT DISTINCT grp, det, round((1 + det) / e, 5) AS v, round(s, 5) AS s FROM r JOIN s USING (grp) JOIN e USING (grp)""",
)


def mode_variances(spark: SparkSession, d: str) -> DataFrame:
    """The modes of a group of detectors share its whole variance out."""
    rows = lowrank.centred(samples(spark, d).withColumn("scan", C("det") % 5).select("scan", "det", "sample", "value"), ["scan"], "det", "value")
    modes = lowrank.factored(rows, ["scan"], "det", "sample", "value", 32).strengths()
    return rounded(modes.groupBy("scan").agg(F.count(F.lit(1)).alias("modes"), F.sum(C("s") * C("s")).alias("total")), "total", digits=3)


put(
    "mode_variances", mode_variances,
    f"WITH {SAMPLES}, c AS (SELECT det % 5 AS scan, det, sample, value - avg(value) OVER (PARTITION BY det) AS v FROM samples) SELECT scan, least(count(DISTINCT det), count(DISTINCT sample)) AS modes, round(sum(v * v), 3) AS total FROM c GROUP BY 1",
)

QUERIES, ORACLE = Q, {k: nudged(v) for k, v in O.items()}
