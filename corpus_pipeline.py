"""Corpus cleaning in five stages; each works on all that its predecessor kept.

quality_rules drops documents that the base rules or a risk-controlled cutoff reject; line_dedup cuts repeated and nearly
repeated lines (documents of which nothing is left go); near_dedup keeps one document of each class; decontaminate
drops documents with a copy of a test item; encode adds token numbers, their count and whether decoding gives the text
back. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfield.llm import decontaminate, line_dedup, near_dedup, pieces, quality_rules
from tallyfield.llm.common import stage, table


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.tokenize(docs)


STAGES = [
    ("quality_rules", quality_rules.filter_rows),
    ("line_dedup", line_dedup.clean),
    ("near_dedup", near_dedup.keep_one),
    ("decontaminate", decontaminate.keep_clean),
    ("encode", encode),
]

#: The learnt cutoffs, signatures and shortest paths of the stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name, wide=True)
    return docs
