"""Bounded, deterministic samples of labelled rows, and batches of bounded size, for the fitted operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that a batch handed to numpy holds at most (one longer text is a batch of its own).
BATCH_CHARS = 1_000_000
#: Hash range that sampling fractions are counted in.
_STEPS = 1 << 30


def sample_per_class(rows: DataFrame, label: str, per_class: int, seed: int) -> list:
    """Collects about per_class rows (doc_id, text, label) of each class, chosen by a hash of doc_id.

    Classes are counted over all rows first; a class of n rows keeps a hash range of per_class / n of all hashes, so
    the choice doesn't depend on partitions and the driver gets per_class * classes rows, whatever the input.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    at = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(_STEPS))
    keep = F.lit(False)
    for value, n in sorted(counts.items()):
        keep = keep | ((F.col(label) == F.lit(value)) & (at < F.lit(int(_STEPS * min(1.0, per_class / n)))))
    return rows.where(keep).select("doc_id", "text", label).orderBy(at, "doc_id").collect()


def is_held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, mod 4, is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def by_size(frame: pd.DataFrame, column: str = "text", most: int = BATCH_CHARS) -> Iterator[pd.DataFrame]:
    """Consecutive parts of a frame whose texts have at most `most` characters together, or that are one row."""
    start = total = 0
    for k, n in enumerate(frame[column].str.len()):
        if k > start and total + n > most:
            yield frame.iloc[start:k]
            start, total = k, 0
        total += n
    if start < len(frame):
        yield frame.iloc[start:]
