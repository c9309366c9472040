"""Exact top-k search by columnar branch and bound.

Rows lie in vertical layout: a chunk is held dimension block by dimension block, blocks of most mass first. Inner
products with a block of queries grow one dimension block at a time. By Cauchy and Schwarz what is still missing is at most the
product of the remaining lengths of query and row, so a pair whose sum so far plus that bound stays under the query's
k-th best score is out; as soon as few pairs survive they are compacted into arrays and only those go on.

The k-th best score starts from a bounded sample of the rows (`SAMPLE_ROWS`: a score reached there is a floor for the whole
table) and rises as a task's chunks pass. Queries come in blocks of about `QUERY_BLOCK`; for each, the rows are read once where
they lie, nothing but a task's best k rows a query is shuffled, and the driver and each task hold one block. Blocks are
jobs of their own, whose results are stored in the shared folder.

Defined cases: rows whose vec_id is null, or whose vector is null or holds null or non-finite components, take no part;
rows that have the query's vec_id are its own; each other row counts, so repeated rows may take several ranks; equal
query rows are one query, different rows of one vec_id are queries of their own; ties go to smaller vec_ids, and any of
rows that tie in that too has any of their ranks, which shows in no column; extra columns are ignored; fewer candidates than k
give fewer ranks; an empty table an empty result. Vectors of different lengths are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage, table
from .vectors import BEST, Best, ids_of, in_blocks, inner_sql, matrix, number_type, sampled, usable, usable_sql, whole

K = 5
QUERY_BLOCK = 4096
#: Dimensions that are added at a time.
STEP = 8
#: Rows of a chunk.
CHUNK = 1024
#: Share of pairs alive from which on they are compacted.
SPARSE = 0.3
_LOWEST = -(1 << 62)


def rest(rows: np.ndarray, step: int = STEP) -> np.ndarray:
    """Whole numbers not under the lengths of rows from each dimension block on; the last row is 0."""
    squares = (rows.astype(float) ** 2)[:, ::-1].cumsum(axis=1)[:, ::-1]
    out = [np.ceil(np.sqrt(squares[:, at]) * (1 + 1e-12)) for at in range(0, rows.shape[1], step)]
    return np.array([*out, np.zeros(len(rows))])


def survivors(queries: np.ndarray, rows: np.ndarray, floor: np.ndarray, step: int = STEP, sparse: float = SPARSE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(query, row, score) of all pairs that reach the query's floor, and the pairs worked on with each dimension block."""
    kind = number_type(queries, float(np.abs(rows).max(initial=0)))
    q, columns, low = queries.astype(kind), np.ascontiguousarray(rows.T, kind), floor[:, None]
    q_rest, r_rest, blocks = rest(queries, step), rest(rows, step), range(0, rows.shape[1], step)
    sums, work, k = np.zeros((len(q), len(rows)), kind), [], 0
    alive = np.ones(sums.shape, bool)
    for k, at in enumerate(blocks, 1):  # all pairs, while most may still win
        sums += q[:, at : at + step] @ columns[at : at + step]
        work.append(sums.size)
        alive = sums + q_rest[k][:, None] * r_rest[k] >= low
        if alive.mean() <= sparse:
            break
    i, j = np.nonzero(alive)
    score, q, low = sums[i, j], [q[:, at : at + step] for at in blocks], floor
    for b in range(k, len(blocks)):  # the pairs that are left, closed up after each block
        own = np.ascontiguousarray(columns[blocks[b] : blocks[b] + step].T)
        score = score + np.einsum("ij,ij->i", q[b][i], own[j])
        work.append(len(i))
        kept = score + q_rest[b + 1][i] * r_rest[b + 1][j] >= low[i]
        i, j, score = i[kept], j[kept], score[kept]
    return i, j, score.astype(np.int64), work


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows (vec_id, embedding) of largest integer inner product for each of queries (vec_id, embedding): query_id, rank,
    vec_id, score."""
    rows, queries = (x.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding") for x in (rows, queries))
    spark, sample, parts = rows.sparkSession, sampled(rows), []
    ids, marks = np.array([r.vec_id for r in sample], np.int64), whole([r.embedding for r in sample])
    dims = marks.shape[1]
    order = np.argsort(-(marks**2).sum(axis=0), kind="stable")
    for own in in_blocks(queries, block):
        names, asked = np.array([r.vec_id for r in own], np.int64), whole([r.embedding for r in own], dims)[:, order]
        scores = np.where(names[:, None] == ids, _LOWEST, asked @ marks[:, order].T)
        floor = np.sort(scores, axis=1)[:, -k] if len(ids) >= k else np.full(len(own), _LOWEST)
        stated = spark.sparkContext.broadcast((names, asked, floor))  # about `block` rows

        def search(batches: Iterator[pa.RecordBatch], stated=stated) -> Iterator[pa.RecordBatch]:
            names, asked, floor = stated.value
            best = Best(len(names), k, floor.copy())
            for batch in batches:
                there, values = ids_of(batch), matrix(batch.column("embedding"), dims)[:, order]
                for at in range(0, len(there), CHUNK):
                    i, j, score, _ = survivors(asked, values[at : at + CHUNK], best.floor)
                    j = there[at : at + CHUNK][j]
                    best.add(*(x[j != names[i]] for x in (i, score, j)))
            yield best.batch()

        place = F.row_number().over(W.partitionBy("at").orderBy(F.desc("score"), "vec_id"))
        found = rows.mapInArrow(search, BEST).withColumn("rank", place).where(F.col("rank") <= k)
        numbers = spark.createDataFrame(list(enumerate(names.tolist())), "at long, query_id long")
        parts.append(stage(found.join(F.broadcast(numbers), "at").select("query_id", "rank", "vec_id", "score"), "top-k"))
        stated.unpersist()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, parts) if parts else empty


def op13_columnar_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


QUERIES = {"op13_columnar_top_k": op13_columnar_top_k}
#: Every query with every row.
ORACLE = {
    "op13_columnar_top_k": f"""WITH r AS MATERIALIZED ({usable_sql("vec_id")} AND vec_id IS NOT NULL),
 q AS (SELECT row_number() OVER () AS qn, * FROM (SELECT DISTINCT * FROM r WHERE vec_id % 50 = 0)),
 s AS (SELECT q.qn, q.vec_id AS query_id, r.vec_id, {inner_sql("q.v", "r.v")} AS score FROM q JOIN r ON r.vec_id <> q.vec_id)
 SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY qn ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {K}"""
}
