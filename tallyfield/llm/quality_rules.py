"""Quality rules whose cutoffs come from labelled holdouts with an error guarantee.

Each rule compares one number of a text with a cutoff. The labelled rows are split by a hash of doc_id. One part (`FIT` in
256 of them) gives each rule's number a level from 0 to `LEVELS`: how pure the rejected rows would be at that cutoff, with
`PRICE` bad rows wanted per good one; a text's level is the greatest of its rules'. So the cutoffs of all rules move
together along one path, from the laxest level to the strictest, and the error budget is spent once and not once per rule.

The other part certifies, stratum by stratum (language): from the laxest level on, a level is accepted while an exact
binomial test rejects "it falsely rejects more than `risk` of the good rows of this stratum" at level `delta / strata`
(Bonferroni over strata; fixed-sequence testing along the path needs no further correction, as the first failure ends it). So
with probability 1 - delta, no stratum loses more than `risk` of its good rows. Of the accepted levels the one with the
best trade on the part that was fitted is used: the share of bad rows that it rejects, less `PRICE` times the share of
good ones. A stratum whose own labels prove no level, or that has none, gets none: a test over all strata says nothing about a
single one, so only the base rules hold there. At the default risk and five strata 90 good rows are enough.

All on the main path is DataFrame functions; the driver sees the histograms only (rules * bins and strata * levels rows).

Defined cases: null text is an empty one, has no words and fails the base rules; labels without a document, null
labels and null doc_ids take no part; repeated labels count as often as they occur; an empty label table
accepts no level, so only the base rules hold; null lang is a stratum of its own; of equally good levels the laxer one is
used; very long texts are measured whole; other columns are not looked at, and clash with none of the added ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_RE, BLANKS, BROADCAST_ROWS, discard, fresh, stage, table, text_of

WINDOW = 5
RISK = 0.05
DELTA = 0.05
PRICE = 10.0
BINS = 200
LEVELS = 50
FIT = 96
#: Rule -> number that it looks at; a row is rejected if the number is above the cutoff.
RULES = ("symbol_share", "mark_share", "upper_share", "reuse_share", "dup_line_share", "repeat_share", "long_words")


def twin_places(windows: Column) -> Column:
    """(hash, place) of all windows by hash, if any window occurs twice; else nothing, so that most texts sort nothing."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def repeat_words(pairs: Column) -> Column:
    """Words inside windows that occur twice or more: keep the places whose hash has a neighbour, and add up how far
    each reaches. pairs has to be a stored column, as each element looks at its neighbours."""
    twins = F.filter(pairs, lambda p, i: F.get(pairs, i - 1)["h"].eqNullSafe(p["h"]) | F.get(pairs, i + 1)["h"].eqNullSafe(p["h"]))
    walk = F.aggregate(
        F.sort_array(F.transform(twins, lambda p: p["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
    )
    return walk["n"].cast("long")


def with_features(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs plus the counts and the rules' numbers, named with prefix."""
    t, w, g, pairs, ln = fresh(docs, "_qt", "_qw", "_qg", "_qp", "_ql").values()
    p = prefix
    out = docs.withColumn(t, text_of())
    out = out.withColumn(w, F.filter(F.split(F.col(t), BLANK_RE), lambda x: x != ""))
    out = out.withColumn(
        g,
        F.when(
            F.size(w) >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(F.col(w), i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    out = out.withColumn(pairs, twin_places(F.col(g)))
    out = out.withColumn(ln, F.filter(F.split(F.col(t), "\n"), lambda x: F.translate(x, BLANKS, "") != ""))
    bare = F.length(F.translate(F.col(t), BLANKS, ""))
    symbols = F.length(t) - F.length(F.translate(F.col(t), "#*$%&|<>", ""))
    out = out.withColumns(
        {
            f"{p}n_words": F.size(w).cast("long"),
            f"{p}word_chars": bare.cast("long"),
            f"{p}n_symbols": symbols.cast("long"),
            f"{p}n_dup_lines": (F.size(ln) - F.size(F.array_distinct(F.col(ln)))).cast("long"),
            f"{p}n_repeat_words": repeat_words(F.col(pairs)),
            f"{p}n_lines": F.size(ln).cast("long"),
            f"{p}n_upper": (F.length(t) - F.length(F.regexp_replace(F.col(t), r"\p{Lu}", ""))).cast("long"),
            f"{p}n_marks": (F.length(t) - F.length(F.translate(F.col(t), "!?|", ""))).cast("long"),
            f"{p}n_distinct": F.size(F.array_distinct(F.col(w))).cast("long"),
        }
    ).drop(t, w, g, pairs, ln)
    n, c = F.greatest(F.col(f"{p}n_words"), F.lit(1)), F.greatest(F.col(f"{p}word_chars"), F.lit(1))
    return out.withColumns(
        {
            f"{p}symbol_share": F.col(f"{p}n_symbols") / c,
            f"{p}mark_share": F.col(f"{p}n_marks") / n,
            f"{p}upper_share": F.col(f"{p}n_upper") / c,
            f"{p}reuse_share": F.lit(1.0) - F.col(f"{p}n_distinct") / n,
            f"{p}dup_line_share": F.col(f"{p}n_dup_lines") / F.greatest(F.col(f"{p}n_lines"), F.lit(1)),
            f"{p}repeat_share": F.col(f"{p}n_repeat_words") / n,
            f"{p}long_words": F.least(F.lit(1.0), F.col(f"{p}word_chars") / n / F.lit(50.0)),
            f"{p}base_failed": (F.col(f"{p}n_words") < 10) | (F.lit(100) * F.col(f"{p}n_repeat_words") > F.lit(20) * F.col(f"{p}n_words")),
        }
    )


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def holds(k: int, n: int, risk: float, level: float) -> bool:
    """Does k false rejections in n show that the rate is at most risk?"""
    if n == 0 or k > risk * n:
        return False
    return binomial_tail(k, n, risk) <= level


@dataclass(frozen=True)
class Cutoffs:
    """levels: per rule, the level of each of BINS + 1 bins of its number; least: per stratum, the least level that is rejected."""

    levels: dict[str, tuple[int, ...]]
    least: dict[str | None, int]


def bin_of(rule: str, prefix: str = "") -> Column:
    return F.least(F.lit(BINS), F.ceil(F.col(prefix + rule) * BINS)).cast("int")


def levels_of(rows: list) -> dict[str, tuple[int, ...]]:
    """Levels of each rule's bins from rows (rule, bin, good, bad): the purity of what a cutoff there rejects, which no
    stricter cutoff exceeds and no laxer one falls short of."""
    out = {}
    for rule in RULES:
        good, bad = [0] * (BINS + 1), [0] * (BINS + 1)
        for r in rows:
            if r.rule == rule:
                good[r.bin] += r.good
                bad[r.bin] += r.bad
        pure, k, caught = [0.0] * (BINS + 1), 0, 0
        for b in range(BINS, 0, -1):
            k, caught = k + good[b], caught + bad[b]
            pure[b] = caught / (caught + PRICE * (k + 0.5))
        for b in range(1, BINS + 1):
            pure[b] = max(pure[b], pure[b - 1])
        out[rule] = tuple(int(LEVELS * x) for x in pure)
    return out


def level(levels: dict[str, tuple[int, ...]], prefix: str = "") -> Column:
    """A row's level: the greatest of its rules'. The levels of a rule rise with its bins, so each is a few comparisons."""
    out = F.lit(0)
    for rule, own in levels.items():
        steps = [(b, own[b]) for b in range(1, BINS + 1) if own[b] > own[b - 1]]
        at = F.lit(0)
        for b, value in steps:
            at = F.when(bin_of(rule, prefix) >= b, F.lit(value)).otherwise(at)
        out = F.greatest(out, at) if steps else out
    return out


def least_levels(rows: list, fitted: list, risk: float, delta: float) -> dict[str | None, int]:
    """Per stratum the accepted level with the best trade. rows, fitted: (lang, level, good, bad) of the certifying and of the
    fitted part; the trade is that of all strata together, so that it is the same path everywhere."""
    strata = sorted({r.lang for r in rows}, key=lambda x: (x is not None, x or ""))
    n_good, n_bad = max(1, sum(r.good for r in fitted)), max(1, sum(r.bad for r in fitted))
    trade = {v: sum(r.bad / n_bad - PRICE * r.good / n_good for r in fitted if r.level >= v) for v in range(1, LEVELS + 1)}
    out: dict[str | None, int] = {}
    for s in strata:
        own = [r for r in rows if r.lang == s]
        n, best = sum(r.good for r in own), 0.0
        for v in range(LEVELS, 0, -1):
            if not holds(sum(r.good for r in own if r.level >= v), n, risk, delta / len(strata)):
                break
            if trade[v] > best:
                best, out[s] = trade[v], v
    return out


def cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> Cutoffs:
    """labelled: doc_id, lang, base_failed, the rules' numbers and a boolean `good`; all of its rows count.

    Rows that already fail the base rules take no part: the guarantee is about what the cutoffs reject besides.
    """
    rows = labelled.where(~F.col("base_failed")).withColumn("_fit", F.pmod(F.xxhash64(F.lit(41), "doc_id"), F.lit(256)) < FIT)
    good, bad = F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    bins = F.array(*[F.struct(F.lit(r).alias("rule"), bin_of(r).alias("bin")) for r in RULES])
    found = rows.where("_fit").select("good", F.explode(bins).alias("b")).groupBy(F.col("b.rule").alias("rule"), F.col("b.bin").alias("bin")).agg(good, bad)
    levels = levels_of(found.collect())
    marks = rows.groupBy("_fit", "lang", level(levels).alias("level")).agg(good, bad).collect()
    return Cutoffs(levels, least_levels([r for r in marks if not r["_fit"]], [r for r in marks if r["_fit"]], risk, delta))


def verdict(found: Cutoffs, prefix: str = "") -> Column:
    """True if neither the base rules nor the stratum's level rejects the row; a stratum without one has the base rules only."""
    least = F.when(F.lit(False), F.lit(0))
    for s, v in found.least.items():
        least = least.when(F.col("lang").eqNullSafe(F.lit(s)), F.lit(v))
    return ~F.col(f"{prefix}base_failed") & ~F.coalesce(level(found.levels, prefix) >= least, F.lit(False))


def learn(features: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> Cutoffs:
    """features: doc_id, lang, base_failed and the rules' numbers. Only these small columns are shuffled."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", (F.col("quality") > 0).alias("good"))
    rows = stage(features.select("doc_id", "lang", "base_failed", *RULES).join(marks, "doc_id"), "quality-labelled")
    out = cutoffs(rows, risk, delta)
    discard(rows)
    return out


def op5_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = stage(with_features(docs).drop("text"), "quality-features", wide=True)
    found = learn(rows, table(spark, sf_dir, "labels"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict(found).alias("kept")
    )


def filter_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns.

    Texts are measured twice, for the cutoffs (only labelled ones, if a list of these is small enough to broadcast) and
    for the verdict, so that they are neither stored nor shuffled in between.
    """
    p = "_q_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p = f"_{p}"
    labels = table(spark, sf_dir, "labels")
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id").distinct()
    measured = docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= BROADCAST_ROWS else docs
    numbers = with_features(measured.select("doc_id", "text", "lang")).select("doc_id", "lang", "base_failed", *RULES)
    found = learn(stage(numbers, "quality-features", wide=True), labels)
    # A filter moves below what it looks at, which would measure the texts once for each number in it; it can't pass
    # a column whose value depends on the row's place. Only time depends on that: the rows are the same either way.
    rows = with_features(docs, p).withColumn(f"{p}place", F.monotonically_increasing_id())
    return rows.where(verdict(found, p) & (F.col(f"{p}place") >= 0)).select(*docs.columns)


QUERIES = {"op5_risk_controlled_rules": op5_risk_controlled_rules}
ORACLE: dict[str, str] = {}
