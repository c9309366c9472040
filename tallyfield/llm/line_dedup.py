"""Line deduplication by a deletion-neighbourhood join.

A line goes if an earlier line (by doc_id, then place) holds the same words within the edit bound. The bound follows
the length: one edit (a word put in, taken out or replaced) for each full `MIN_WORDS` words, at most one; so two lines
are compared if both have as many, and shorter ones, where one word is too large a share ("Page 1", "Page 2"), have to
be equal. Earlier means the first place where a line's text stands, so copies of a line go too and the earliest stays.

1. Lines become 128-bit hashes; sums per hash give each distinct line's first place and count (map-side combined).
2. With one edit, the first or the last half of the words is untouched. Each line of enough words puts out four half
   keys; only lines that share one with another line go on. This loses nothing.
3. Those lines put out all variants with one word deleted, as rolling hashes in linear time, plus themselves. Lines
   within one edit have an equal variant at an equal place (replaced) or a variant equal to the other line (put in or
   taken out). Per key only the earliest holder is kept as partner, so that a template with a million fillings gives
   a million rows, not their pairs.
4. The edit distance of each line and partner is verified on the words.

Defined cases: null text has no lines; lines without words always stay; of lines at the same number of documents with
the same doc_id none is earlier than the other; null doc_ids come last (doc_ids have to be whole numbers, else that is
an error); lines of any length are compared whole; other columns stay as they are; an empty table gives an empty one.
A document that loses lines and has no word left goes altogether.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, fresh, narrow, row_key, stage, table, text_of, words_of

MIN_WORDS = 8
#: Odd base of the rolling hashes and its inverse modulo 2^64, twice (bases are fixed values).
_BASES = tuple((np.uint64(b), np.uint64(pow(b, -1, 1 << 64))) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_MOST_WORDS = 500_000


def has_word(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS)) != ""


def lines_of(docs: DataFrame) -> DataFrame:
    """A row per line with a word: the document's key and id, place, the line and its 128-bit hash."""
    rows = docs.select(*row_key("doc_id", "text"), "doc_id", F.posexplode(F.split(text_of(), "\n")).alias("line_no", "line"))
    rows = rows.where(has_word(F.col("line")))
    return rows.withColumns({"h1": F.xxhash64(F.lit(3), "line"), "h2": F.xxhash64("line", F.lit(5))})


def place() -> Column:
    """Where a line stands, as one number in the order (doc_id, line), null ids last. Numbers aggregate by hashing, structs
    only by sorting."""
    return F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no")


HALVES = ("k0", "k1", "k2", "k3")


def half_keys(words: Column) -> dict[str, Column]:
    """Keys of which two lines within one edit share one: tagged with the shorter line's length; null for short lines."""
    n = F.size(words)

    def of(short: Column) -> list[Column]:
        p = F.floor(short / 2).cast("int")
        return [
            F.xxhash64(F.lit("first"), short, F.slice(words, F.lit(1), p)),
            F.xxhash64(F.lit("last"), short, F.slice(words, n - (short - p) + 1, short - p)),
        ]

    return {name: F.when(n >= MIN_WORDS, key) for name, key in zip(HALVES, (*of(n), *of(n - 1)), strict=True)}


def variants(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all lines with one word deleted, and of the lines: (row, place or -1, hash, other hash).

    With c the running sum of word * base^j, deleting word i leaves c_i + (c_n - c_(i+1)) / base.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(words)) - start[row]
    out = []
    for k, (base, inverse) in enumerate(_BASES):
        w = words.astype(np.uint64)
        if k:
            w = (w ^ (w >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(sizes.max(initial=0)), base, np.uint64))])
        c = np.concatenate([[np.uint64(0)], np.cumsum(w * powers[at], dtype=np.uint64)])
        before, whole = c[:-1] - c[start[row]], c[start[1:]] - c[start[:-1]]
        rest = c[start[row + 1]] - c[1:]
        size = sizes.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        out.append(np.concatenate([before + rest * inverse + size[row] - np.uint64(0x94D049BB133111EB), whole + size]).view(np.int64))
    return np.concatenate([row, np.arange(len(sizes))]), np.concatenate([at, np.full(len(sizes), -1)]).astype(np.int32), out[0], out[1]


def neighbourhood(lines: DataFrame) -> DataFrame:
    """lines (h1, h2, at, words' hashes) -> key1, key2, spot, h1, h2, at: a row for each line and word, and one (spot -1)
    for the line itself."""
    held = ("h1", "h2", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            sizes_all = np.asarray(batch.column(3).value_lengths().to_numpy(zero_copy_only=False), np.int64)
            ends = np.cumsum(sizes_all)
            while start < len(batch):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + _MOST_WORDS, "right")))
                part = batch.slice(start, stop - start)
                words = part.column(3).flatten().to_numpy(zero_copy_only=False)
                row, spot, a, b = variants(words, sizes_all[start:stop])
                own = [part.column(k).take(pa.array(row)) for k in range(len(held))]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(spot), *own], ["key1", "key2", "spot", *held])
                start = stop

    shape = lines.select(F.lit(0).cast("bigint").alias("key1"), F.lit(0).cast("bigint").alias("key2"), F.lit(0).alias("spot"), *held).schema
    return lines.select(*held, "words").mapInArrow(run, shape)


@F.pandas_udf(T.BooleanType())
def within_one(a: pd.Series, b: pd.Series) -> pd.Series:
    """Is the edit distance of two word lists at most one?"""

    def test(x: np.ndarray, y: np.ndarray) -> bool:
        if abs(len(x) - len(y)) > 1:
            return False
        x, y = list(x), list(y)
        k = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        return x[k + (len(x) >= len(y)) :] == y[k + (len(y) >= len(x)) :]

    return pd.Series([test(x, y) for x, y in zip(a, b, strict=True)])


def near_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """Hashes (h1, h2) of the distinct lines that have an earlier line within one edit."""
    halves = firsts.select("h1", "h2", "at", F.explode(F.array(*HALVES)).alias("half")).where("half IS NOT NULL")
    shared = stage(halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half"), "line-halves")
    suspects = stage(halves.join(narrow(shared), "half").select("h1", "h2", "at").distinct(), "line-suspects")
    met = lines_of(docs).withColumn("own", place()).join(narrow(suspects), ["h1", "h2"]).where("own = at")
    held = met.select("h1", "h2", "at", words_of(F.col("line")).alias("words"))
    held = stage(held.dropDuplicates(["h1", "h2"]), "line-words", wide=True)
    keys = stage(neighbourhood(held.withColumn("words", F.transform("words", lambda w: F.xxhash64(w)))), "line-variants", wide=True)

    # Replaced words: equal variants at an equal place. The earliest holder is everyone's partner.
    same = keys.where("spot >= 0").groupBy("key1", "key2", "spot").agg(F.min("at").alias("partner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    replaced = keys.join(same, ["key1", "key2", "spot"]).where("at > partner").select("h1", "h2", "partner")
    # Words put in or taken out: a variant equals a whole line, whichever of the two is earlier.
    gap = keys.groupBy("key1", "key2").agg(F.min(F.when(F.col("spot") < 0, F.col("at"))).alias("whole"), F.min(F.when(F.col("spot") >= 0, F.col("at"))).alias("cut"))
    gap = gap.where("whole IS NOT NULL AND cut IS NOT NULL")
    moved = keys.join(gap, ["key1", "key2"]).withColumn("partner", F.when(F.col("spot") < 0, F.col("cut")).otherwise(F.col("whole"))).where("partner < at")
    pairs = replaced.unionByName(moved.select("h1", "h2", "partner")).distinct()
    texts = held.select(F.col("at").alias("partner"), F.col("words").alias("other"))
    return pairs.join(held, ["h1", "h2"]).join(texts, "partner").where(within_one("words", "other")).select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame) -> DataFrame:
    """Per document key (_k1, _k2): gone, the numbers of the lines that go, and how many of them are near but not equal.

    The text is read three times (sums per line, words of suspects, marks) and never shuffled where the other side of
    a join is small; if it isn't, that join shuffles.
    """
    rows = lines_of(docs).withColumn("at", place()).withColumn("words", words_of(F.col("line"))).withColumns(half_keys(F.col("words")))
    firsts = rows.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"), *[F.min(k).alias(k) for k in HALVES])
    firsts = stage(firsts, "line-firsts", wide=True)
    near = near_lines(docs, firsts).withColumn("near", F.lit(True))
    bad = firsts.drop(*HALVES).join(near, ["h1", "h2"], "left").where("n > 1 OR near")
    bad = stage(bad.select("h1", "h2", "at", F.coalesce("near", F.lit(False)).alias("near")), "line-bad")
    hit = lines_of(docs).drop("line").withColumn("own", place()).join(narrow(bad), ["h1", "h2"]).where(F.col("near") | (F.col("own") > F.col("at")))
    return hit.groupBy("_k1", "_k2").agg(F.collect_set("line_no").alias("gone"), F.count_distinct(F.when(F.col("near"), F.col("line_no"))).alias("n_near"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the text cut, and n_lines, n_gone and n_near added (under these names, or with underscores if taken)."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id has to be a whole number: it says which line is earlier")
    names = fresh(docs, "n_lines", "n_gone", "n_near", "_keep", "_all", "_k1", "_k2")
    gone = dropped_lines(docs).select(F.col("_k1").alias(names["_k1"]), F.col("_k2").alias(names["_k2"]), "gone", F.col("n_near").alias(names["n_near"]))
    gone = stage(gone.withColumnRenamed("gone", names["_keep"]), "line-gone")
    key = [c.alias(names[k]) for k, c in zip(("_k1", "_k2"), row_key("doc_id", "text"), strict=True)]
    rows = docs.select("*", *key).join(narrow(gone, F.size(names["_keep"])), [names["_k1"], names["_k2"]], "left")
    rows = rows.withColumn(names["n_gone"], F.when(F.col(names["_keep"]).isNull(), 0).otherwise(F.size(names["_keep"])).cast("bigint"))
    rows = rows.withColumn(names["n_near"], F.coalesce(names["n_near"], F.lit(0)).cast("bigint")).withColumn(names["_all"], F.split(text_of(), "\n"))
    rows = rows.withColumn(names["n_lines"], F.size(F.filter(names["_all"], has_word)).cast("bigint"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(names["_all"]) - 1), F.col(names["_keep"]))
    lines = F.col(names["_all"])
    rows = rows.withColumn("text", F.when(F.col(names["n_gone"]) > 0, F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")).otherwise(F.col("text")))
    return rows.select(*docs.columns, *[names[c] for c in ("n_lines", "n_gone", "n_near")])


def op10_deletion_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "text", "n_lines", "n_gone", "n_near")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with cut texts, without those that lost lines and have no word left; n_chars follows the text."""
    rows = dedup(docs)
    gone = rows.columns[-2]
    rows = rows.where((F.col(gone) == 0) | has_word(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


QUERIES = {"op10_deletion_line_dedup": op10_deletion_line_dedup}

#: Two lines within one edit share the first or the last half of the shorter one (in words), so an equi-join on halves finds
#: all pairs; a pair is within one edit if common first and last words cover all but one word of the longer line.
_HALVES = " UNION ALL ".join(
    f"SELECT line, pl, ws, n, {k} AS kind, {m} AS m, hash({part}) AS h FROM d WHERE n >= {MIN_WORDS}"
    for m in ("n", "n - 1")
    for k, part in ((0, f"ws[1:({m}) // 2]"), (1, f"ws[n - (({m}) - ({m}) // 2) + 1:n]"))
)
_COMMON = "coalesce(list_position(list_transform(generate_series(1, least(x.n, y.n)), lambda i: x.ws[{x}] = y.ws[{y}]), false) - 1, least(x.n, y.n))"
ORACLE = {
    "op10_deletion_line_dedup": r"""WITH a AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM documents),
 l AS MATERIALIZED (SELECT doc_id, line, k, doc_id::HUGEINT * 2147483648 + k AS pl, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 0 AS has FROM a),
 d AS MATERIALIZED (SELECT line, pl, ws, len(ws) AS n FROM (SELECT line, min(pl) AS pl, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l WHERE has GROUP BY line)),
 h AS MATERIALIZED ("""
    + _HALVES
    + """),
 p AS (SELECT DISTINCT x.line, x.pl, y.pl AS other FROM h x JOIN h y ON x.kind = y.kind AND x.m = y.m AND x.h = y.h AND y.pl < x.pl AND abs(x.n - y.n) <= 1),
 near AS (SELECT DISTINCT x.line FROM p JOIN d x ON x.pl = p.pl JOIN d y ON y.pl = p.other WHERE """
    + _COMMON.format(x="i", y="i")
    + " + "
    + _COMMON.format(x="x.n - i + 1", y="y.n - i + 1")
    + """ >= greatest(x.n, y.n) - 1),
 m AS (SELECT l.*, near.line IS NOT NULL AS near, has AND (near.line IS NOT NULL OR l.pl > d.pl) AS gone FROM l LEFT JOIN d ON d.line = l.line LEFT JOIN near ON near.line = l.line),
 g AS (SELECT doc_id, count(*) FILTER (has) AS n_lines, count(*) FILTER (gone) AS n_gone, count(*) FILTER (gone AND near) AS n_near,
  coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
 SELECT t.doc_id, CASE WHEN n_gone > 0 THEN kept ELSE t.text END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_gone, 0) AS n_gone, coalesce(n_near, 0) AS n_near
 FROM documents t LEFT JOIN g ON g.doc_id = t.doc_id"""
}
