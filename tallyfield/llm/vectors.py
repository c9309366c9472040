"""What the vector operators share: whole-number components, blocks of queries, running best lists.

A component x is the integer floor(256 * x), x as double. Rows whose vector is null or holds null or non-finite
components are left out. All vectors kept have to be of one length, and the sum of `length` squares of the largest
component has to fit in a long; either is an error otherwise, as no right result could be given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stage

SCALE = 256
#: Rows that set cells, the order of dimensions and first thresholds; they change the work, not the results.
SAMPLE_ROWS = 2048


def usable(vector: str = "embedding") -> Column:
    """The vector is not null and all its components are finite numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def whole(vectors: list | np.ndarray, dims: int | None = None) -> np.ndarray:
    """Rows of integers (int64) from rows of finite numbers."""
    out = np.floor(SCALE * np.asarray(vectors, float)) if len(vectors) else np.zeros((0, dims or 0))
    if out.ndim != 2 or dims not in (None, out.shape[1]):
        raise ValueError("vectors of different lengths")
    if out.size and out.shape[1] * np.abs(out).max() ** 2 >= 2.0**60:
        raise OverflowError("components too large: products would not fit in a long")
    return out.astype(np.int64)


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """whole() of an Arrow column of usable vectors."""
    if len(column) and not np.all(np.diff(column.offsets.to_numpy()) == dims):
        raise ValueError("vectors of different lengths")
    return whole(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dims), dims)


def number_type(rows: np.ndarray, other: float) -> type:
    """float64, in which products run fastest, if products with components up to `other` are exact there, else int64."""
    most = max(float(np.abs(rows).max(initial=0)), other)
    return np.float64 if rows.shape[1] * most * most < 2.0**52 else np.int64


def sampled(rows: DataFrame, n: int = SAMPLE_ROWS) -> list:
    """At most n rows (vec_id, embedding), chosen by a hash of the id."""
    return rows.select("vec_id", "embedding").orderBy(F.xxhash64(F.lit(29), "vec_id"), "vec_id", "embedding").limit(n).collect()


def in_blocks(queries: DataFrame, size: int) -> Iterator[list]:
    """Distinct rows of queries in blocks of about `size` (chosen by a hash), one after the other on the driver: it holds one
    block at a time, whatever the number of queries."""
    stored = stage(queries.distinct(), "query-rows")
    blocks = max(1, -(-stored.count() // size))
    at = F.pmod(F.xxhash64(F.lit(31), *queries.columns), F.lit(blocks))
    for b in range(blocks):
        if rows := stored.where(at == b).orderBy(*queries.columns).collect():
            yield rows
    discard(stored)


class Best:
    """The k best (score, then smaller id) of each of n lists, fed by arrays."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor.astype(np.int64)  # nothing below its floor can enter a list
        self.at = self.score = self.id = np.zeros(0, np.int64)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        enters = score >= self.floor[at]
        if not enters.any():
            return
        at, score, ids = (np.concatenate(x) for x in ((self.at, at[enters]), (self.score, score[enters]), (self.id, ids[enters])))
        order = np.lexsort((ids, -score, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < self.k
        self.at, self.score, self.id = at[kept], score[order][kept], ids[order][kept]
        full = place[kept] == self.k - 1
        self.floor[self.at[full]] = np.maximum(self.floor[self.at[full]], self.score[full])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.at, pa.int64()), pa.array(self.id, pa.int64()), pa.array(self.score, pa.int64())], ["at", "vec_id", "score"])


#: What Best.batch holds.
BEST = "at long, vec_id long, score long"


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)


def usable_sql(*columns: str) -> str:
    """Usable rows and their integers `v` for DuckDB."""
    return f"""SELECT {", ".join(columns)}, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def inner_sql(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i])) AS BIGINT)"
