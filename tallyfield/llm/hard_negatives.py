"""Hard negatives by a vector-approximation file.

Each dimension is cut into `CELLS` cells (edges from a bounded sample, outer edges from all rows). The approximation file holds,
row by row, the byte of each component's cell beside the components; it is written once to the shared folder. For a block of
anchors, tables give for each dimension and cell the least and the largest product with the anchor's component. A row's
score lies between the sums of what its cells look up there; it is computed exactly only if, by these bounds, the row
may be among an anchor's positives, or may enter one of its windows and beat what the window holds so far.

An anchor's positives are its first `POSITIVES` other rows of the same label; scores of positives set the windows,
30 * positive <= 100 * negative <= 90 * positive; of the rows of other labels in a window the first `NEGATIVES` are kept. Both passes
read the file once for each block of about `ANCHOR_BLOCK` anchors; tasks emit their best few rows per anchor or window
only, whatever a label's share of the rows. Driver and tasks hold one block.

Defined cases: rows with a null vec_id or label, or whose vector is null or holds null or non-finite components, take no
part; rows that have the anchor's vec_id are no positives of it; each other row counts, so a repeated row may be several
positives (with windows of their own) or negatives; equal anchor rows are one anchor; ties go to smaller vec_ids; a
positive of negative score has an empty window, and windows without rows give none; extra columns are ignored; an empty
table gives an empty result. Vectors of different lengths are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, stage, table
from .vectors import BEST, Best, ids_of, in_blocks, inner_sql, matrix, number_type, sampled, usable, usable_sql, whole

POSITIVES = 5
NEGATIVES = 10
#: A window in hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Cells of a dimension; they fit in a byte.
CELLS = 64
ANCHOR_BLOCK = 512
CHUNK = 512
_LOWEST = -(1 << 62)


def edges_of(sample: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """dims x (cells + 1): cell c of a dimension holds integers from edge c up to, without it, edge c + 1. Inner edges are
    quantiles of the sample; no value of the table lies outside."""
    inner = np.sort(np.quantile(sample, np.linspace(0, 1, cells + 1)[1:-1], axis=0).astype(np.int64).T, axis=1)
    return np.concatenate([low[:, None], np.clip(inner, low[:, None], high[:, None]), high[:, None] + 1], axis=1)


def cells_of(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e[1:-1], rows[:, j], "right") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


class Bounds:
    """Tables of least and largest products of a block of anchors with the cells of each dimension."""

    def __init__(self, anchors: np.ndarray, edges: np.ndarray) -> None:
        first, last = edges[:, :-1, None], edges[:, 1:, None] - 1
        low, high = anchors.T[:, None, :] * first, anchors.T[:, None, :] * last
        small = edges.shape[0] * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) < 2**31
        kind = np.int32 if small else np.int64
        self.low, self.high = np.minimum(low, high).astype(kind), np.maximum(low, high).astype(kind)

    def of(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows x anchors: sums of what the cells of each row look up."""
        columns = cells.T.astype(np.intp)
        low, high = self.low[0][columns[0]], self.high[0][columns[0]]
        for j in range(1, len(columns)):
            low += self.low[j][columns[j]]
            high += self.high[j][columns[j]]
        return low, high


def approximation_file(rows: DataFrame, cells: int = CELLS) -> tuple[DataFrame, np.ndarray]:
    """rows (vec_id, label, embedding) as vec_id, label, cells (a byte a dimension) and exact (int64 components), and the edges."""
    sample = whole([r.embedding for r in sampled(rows)])
    dims = sample.shape[1]

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dims, -_LOWEST), np.full(dims, _LOWEST)
        for batch in batches:
            values = matrix(batch.column("embedding"), dims)
            low, high = np.minimum(low, values.min(axis=0, initial=-_LOWEST)), np.maximum(high, values.max(axis=0, initial=_LOWEST))
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(low), pa.array(high)], ["dim", "low", "high"])

    ends = rows.select("embedding").mapInArrow(extremes, "dim int, low long, high long").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    edges = edges_of(sample, np.array([r.low for r in ends], np.int64), np.array([r.high for r in ends], np.int64), cells)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.column("embedding"), dims)
            packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (cells_of(values, edges), values.astype(exact_kind))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *packed], ["vec_id", "label", "cells", "exact"])

    exact_kind = kind_of(edges)
    return stage(rows.select("vec_id", "label", "embedding").mapInArrow(approximate, "vec_id long, label int, cells binary, exact binary"), "approximations", wide=True), edges


def kind_of(edges: np.ndarray) -> type:
    """The smallest type that holds all components."""
    return np.int16 if np.abs(edges).max(initial=0) < 2**15 else np.int32 if np.abs(edges).max() < 2**31 else np.int64


def chunks(batches: Iterator[pa.RecordBatch], dims: int, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, cells, exact) of at most CHUNK rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            cells, exact = (np.frombuffer(b"".join(part.column(c).to_pylist()), t).reshape(-1, dims) for c, t in (("cells", np.uint8), ("exact", kind)))
            yield ids_of(part), part.column("label").to_numpy(zero_copy_only=False).astype(np.int64), cells, exact


def scored(anchors: np.ndarray, exact: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact scores of pairs (anchor, row)."""
    kind = number_type(anchors, float(np.abs(exact).max(initial=0)))
    return np.einsum("ij,ij->i", anchors[a].astype(kind), exact[r].astype(kind)).astype(np.int64)


def positive_pass(names: np.ndarray, labels: np.ndarray, anchors: np.ndarray, edges: np.ndarray, k: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, best = Bounds(anchors, edges), Best(len(names), k, np.full(len(names), _LOWEST))
        for ids, own, cells, exact in chunks(batches, len(edges), kind_of(edges)):
            _, high = bounds.of(cells)
            r, a = np.nonzero((own[:, None] == labels) & (ids[:, None] != names) & (high >= best.floor))
            best.add(a, scored(anchors, exact, a, r), ids[r])
        yield best.batch()

    return search


def negative_pass(labels: np.ndarray, anchors: np.ndarray, edges: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Callable:
    """low, high: anchors x windows, the scores that the windows reach from and to (empty: low over high)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = low.shape[1]
        bounds, best = Bounds(anchors, edges), Best(low.size, k, low.ravel())
        for ids, own, cells, exact in chunks(batches, len(edges), kind_of(edges)):
            least, most = bounds.of(cells)
            floor = best.floor.reshape(low.shape)
            open_ = low <= high
            wide = np.where(open_, floor, -_LOWEST).min(axis=1), np.where(open_, high, _LOWEST).max(axis=1)
            r, a = np.nonzero((own[:, None] != labels) & (most >= wide[0]) & (least <= wide[1]))
            enters = ((most[r, a][:, None] >= floor[a]) & (least[r, a][:, None] <= high[a]) & open_[a]).any(axis=1)
            r, a = r[enters], a[enters]
            score = scored(anchors, exact, a, r)
            for w in range(windows):
                inside = (score >= low[a, w]) & (score <= high[a, w])
                best.add(a[inside] * windows + w, score[inside], ids[r[inside]])
        yield best.batch()

    return search


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = ANCHOR_BLOCK) -> DataFrame:
    """Rows (vec_id, label, embedding), of which those where `anchor` holds are anchors: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score."""
    spark, parts = rows.sparkSession, []
    rows = rows.where(usable() & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if rows.isEmpty():
        return empty
    stored, edges = approximation_file(rows)

    def best_of(search: Callable, k: int) -> DataFrame:
        place = F.row_number().over(W.partitionBy("at").orderBy(F.desc("score"), "vec_id"))
        return stored.mapInArrow(search, BEST).withColumn("rank", place).where(F.col("rank") <= k)

    for own in in_blocks(rows.where(anchor), block):
        names, labels = (np.array(x, np.int64) for x in zip(*((r.vec_id, r.label) for r in own), strict=True))
        anchors = whole([r.embedding for r in own], len(edges))
        low, high = np.full((len(own), positives), 1), np.zeros((len(own), positives), np.int64)
        pairs = []
        for r in best_of(positive_pass(names, labels, anchors, edges, positives), positives).collect():  # `positives` rows an anchor of the block
            w = r.rank - 1
            low[r["at"], w], high[r["at"], w] = -(-LOW * r.score // 100), HIGH * r.score // 100
            pairs.append((r["at"] * positives + w, int(names[r["at"]]), r.vec_id, r.score))
        found = best_of(negative_pass(labels, anchors, edges, low, high, negatives), negatives)
        named = spark.createDataFrame(pairs, "at long, anchor_id long, positive_id long, positive_score long")
        out = found.join(F.broadcast(named), "at")
        parts.append(stage(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    discard(stored)
    return reduce(DataFrame.unionByName, parts) if parts else empty


def relabelled() -> Column:
    """The label, moved on by one (of ten) where vec_id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def op12_approximation_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", relabelled().alias("label"), "embedding")
    return mine(rows, F.col("vec_id") % 100 == 0)


QUERIES = {"op12_approximation_negatives": op12_approximation_negatives}
#: Every anchor with every row.
ORACLE = {
    "op12_approximation_negatives": f"""WITH r AS MATERIALIZED ({usable_sql("vec_id", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label")} AND vec_id IS NOT NULL AND label IS NOT NULL),
 a AS (SELECT row_number() OVER () AS an, * FROM (SELECT DISTINCT * FROM r WHERE vec_id % 100 = 0)),
 s AS MATERIALIZED (SELECT a.an, a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS alike, {inner_sql("a.v", "r.v")} AS score FROM a JOIN r ON r.vec_id <> a.vec_id OR r.label <> a.label),
 p AS (SELECT an, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER w AS place FROM s WHERE alike WINDOW w AS (PARTITION BY an ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {POSITIVES}),
 n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score FROM p JOIN s USING (an) WHERE NOT alike AND 100 * s.score BETWEEN {LOW} * positive_score AND {HIGH} * positive_score)
 SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
 WINDOW w AS (PARTITION BY an, place ORDER BY negative_score DESC, negative_id) QUALIFY row_number() OVER w <= {NEGATIVES}"""
}
