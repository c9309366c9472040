"""Compression of vectors to codes, one per part, with the nearest codebook entries found by VA-file filtering.

Vectors are cut into `PARTS` equal consecutive parts, each with a codebook of `ENTRIES` entries. Each coordinate of the entries of
a codebook is bit-quantised into 2^BITS cells of equally many entries. For a batch of parts, tables give for each
coordinate and cell the least and the largest squared distance from the part's coordinate to the cell; an entry's distance lies
between the sums of what its cells look up. Entries whose lower sum is over the least upper sum are out; of those left
the integer distances are computed, and the first of the nearest is the code.

Codebooks start as the parts of the first rows by vec_id; each round is one pass over the rows where they lie: tasks
add up components and counts per part and entry, and only these sums (parts * entries rows a task) are shuffled; the
driver sees sums of parts * entries rows. No vector is shuffled or collected but the first ENTRIES.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; a null vec_id stays and
comes last; rows equal in vec_id are ordered by vector, and repeated rows each count (and may each be a first entry);
fewer rows than ENTRIES make smaller codebooks; null labels are one label; extra columns are ignored; an empty table
gives an empty result. Vectors of different lengths, or not divisible into PARTS, are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, narrow, stage, table
from .vectors import matrix, usable, usable_sql, whole

PARTS = 16
ENTRIES = 64
ROUNDS = 2
BITS = 4
CHUNK = 2048
#: Copies of a label's sum, if there are too many labels to broadcast them: rows of one label are dealt to as many tasks.
SALTS = 64


class Cells:
    """The approximation of a codebook (entries x width): the cell of each coordinate, and the cells' ends."""

    def __init__(self, book: np.ndarray, bits: int = BITS) -> None:
        n, width = book.shape
        self.book, self.cell = book, np.empty((width, n), np.intp)
        self.low, self.high = np.zeros((width, 1 << bits), np.int64), np.zeros((width, 1 << bits), np.int64)
        for j in range(width):
            order = np.argsort(book[:, j], kind="stable")
            self.cell[j, order] = np.arange(n) * (1 << bits) // n
            for c in np.unique(self.cell[j]):
                own = book[self.cell[j] == c, j]
                self.low[j, c], self.high[j, c] = own.min(), own.max()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(first of the nearest entries, squared distance) of each row of x, and how many distances were computed."""
        least, most = np.zeros((2, len(self.book), len(x)), np.int64)
        for j in range(x.shape[1]):
            below, above = self.low[j][:, None] - x[:, j], x[:, j] - self.high[j][:, None]  # cells x rows
            gap, reach = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
            least += (gap * gap)[self.cell[j]]
            most += (reach * reach)[self.cell[j]]
        row, entry = np.nonzero((least <= most.min(axis=0)).T)
        apart = x[row] - self.book[entry]
        distance = np.einsum("ij,ij->i", apart, apart)
        shortest = np.minimum.reduceat(distance, np.searchsorted(row, np.arange(len(x)))) if len(x) else distance
        is_best = np.flatnonzero(distance == shortest[row])
        _, first = np.unique(row[is_best], return_index=True)
        return entry[is_best[first]], shortest, len(row)


def codes_of(values: np.ndarray, files: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """rows x parts: entry numbers and squared distances."""
    code, error = np.zeros((2, len(values), len(files)), np.int64)
    for at in range(0, len(values), CHUNK):
        for p, (part, file) in enumerate(zip(np.split(values[at : at + CHUNK], len(files), axis=1), files, strict=True)):
            code[at : at + CHUNK, p], error[at : at + CHUNK, p], _ = file.nearest(part)
    return code, error


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """parts x entries x width from the first rows in order of vec_id; None if there are none."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    if not first:
        return None
    values = whole([r.embedding for r in first])
    if values.shape[1] % parts:
        raise ValueError(f"vectors of {values.shape[1]} components can't be cut into {parts} equal parts")
    return np.stack(np.split(values, parts, axis=1))


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the floored mean of the parts nearest to it; unused entries stay."""
    parts, entries, width = books.shape
    dims = parts * width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, total, count = [Cells(b) for b in books], np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            values = matrix(batch.column("embedding"), dims)
            code, _ = codes_of(values, files)
            for p, part in enumerate(np.split(values, parts, axis=1)):
                np.add.at(total[p], code[:, p], part)
                count[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(total[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), cells], ["part", "entry", "n", "total"])

    found = rows.select("embedding").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    whole_sums = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[j]).alias(f"s{j}") for j in range(width)))
    out = books.copy()
    for r in whole_sums.collect():  # parts * entries rows at most
        out[r.part, r.entry] = [r[f"s{j}"] // r.n for j in range(width)]
    return out


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks of rows (vec_id, embedding): parts x entries x width, or None for an empty table."""
    rows = rows.where(usable()).select("vec_id", "embedding")
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = refined(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error of each usable row; no shuffle."""
    dims = books.shape[0] * books.shape[2]
    digits = np.array([f"{k:02x}" for k in range(books.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [Cells(b) for b in books]
        for batch in batches:
            code, error = codes_of(matrix(batch.column("embedding"), dims), files)
            text = pa.array(["".join(r) for r in digits[code].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text, pa.array(error.sum(axis=1))], ["vec_id", "label", "code", "error"])

    usable_rows = rows.where(usable()).select("vec_id", "label", "embedding")
    kinds = dict(usable_rows.dtypes)
    return usable_rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The vector of entries (integers) that a code stands for."""
    return np.concatenate([b[int(code[2 * p : 2 * p + 2], 16)] for p, b in enumerate(books)])


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded plus label_error, the sum of error over equal labels (nulls are one). coded has to be stored, as it is read twice."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    few = stage(sums.withColumnRenamed("label", "_label"), "label-errors")
    side = narrow(few, most=BROADCAST_ROWS)
    if side is not few:
        return coded.join(side, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int")
    return coded.join(salted, F.col("label").eqNullSafe(F.col("_label")) & (salt == F.col("_salt"))).drop("_label", "_salt")


def op11_cell_bound_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    books = fit(rows)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = stage(encode(rows, books), "codes", wide=True)
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


QUERIES = {"op11_cell_bound_codes": op11_cell_bound_codes}


def _assigned(name: str, books: str) -> str:
    apart = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    return f"{name} AS MATERIALIZED (SELECT x.r, x.p, x.v, c.e, CAST({apart} AS BIGINT) AS d FROM x JOIN {books} c USING (p) QUALIFY row_number() OVER (PARTITION BY x.r, x.p ORDER BY d, c.e) = 1)"


def _means(name: str, assigned: str, books: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT p, e, coalesce(m.v, c.v) AS v FROM {books} c LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS v FROM (
  SELECT p, e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM {assigned}) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))"""


#: All entries for all parts.
ORACLE = {
    "op11_cell_bound_codes": f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, * FROM ({usable_sql("vec_id", "label", "embedding")})),
 x AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM (SELECT r, v, unnest(range({PARTS})) AS p FROM k)),
 c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= {ENTRIES}),
 {_assigned("a1", "c0")}, {_means("c1", "a1", "c0")}, {_assigned("a2", "c1")}, {_means("c2", "a2", "c1")}, {_assigned("a3", "c2")},
 h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2),
 o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY r)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN k USING (r), h"""
}
