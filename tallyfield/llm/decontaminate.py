"""Benchmark decontamination: BM25 over test items with block-max bounds, then overlap of question and answer.

The test items form an inverted index: per term its items, and per block of `BLOCK` items the term's greatest impact
there. Every document is cut into overlapping passages (twice the longest item, stepping by the longest item, so an
item's copy lies whole in one passage), and each passage is a query for all items whose BM25 score is at least
`SHARE` of the score of the item with itself. The threshold is fixed, so the three tests of block-max WAND need no cursors
and run for a batch of passages at once: a passage whose terms' greatest impacts anywhere don't add up to the
threshold has no pivot and is skipped; of the others, blocks whose own greatest impacts don't are skipped; the rest is scored
exactly. So no item above the threshold is missed. A hit counts if at least `OVERLAP` of both the item's question (all but its
last sentence) and its answer (its last sentence) stand in the passage. The overlap of either is the share of its word n-grams
found anywhere in the passage, or the share of its words that stand in their places when the item is laid over the passage where
most of its words agree (ties: the earliest place), whichever is greater: the first survives insertions, the second
changed words, which in a short answer would break most n-grams.

The index holds at most `ITEMS` items. A larger benchmark is split by hash into as many parts as needed, each with an
index of its own, and all documents are queried against each part; so what goes to the executors is bounded.

Defined cases: null and empty texts match nothing; items without words match nothing; items under `SHORT` words are one
piece that has to occur whole; rows of the benchmark equal in id and text are one item, equal texts of different ids are all
reported; a document with several copies reports its best passage (of equal scores the one with the greater overlaps);
repeated documents report each; very long texts are searched whole, `CELLS` bounds at a time; ids may be of any type; other
columns are not looked at, and kept by keep_clean; an empty benchmark keeps all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import table

ITEMS = 20_000
BLOCK = 8
SHARE = 0.5
OVERLAP = 0.5
GRAM = 4
SHORT = 8
K1, B = 1.2, 0.75
CHUNK_WORDS = 150_000
#: Upper bounds (passages times blocks) that are held at once.
CELLS = 4_000_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


class Index:
    """Impacts are BM25 contributions divided by the item's score with itself, so one threshold serves all items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        kept = [(i, t, w) for i, t in items if (w := tokens(t or ""))]
        self.ids = [i for i, _, _ in kept]
        self.words = [w for _, _, w in kept]
        self.pieces = [self._pieces(t, w) for _, t, w in kept]
        self.length = max(map(len, self.words), default=1)
        n, mean = len(kept), sum(map(len, self.words)) / max(1, len(kept))
        df = Counter(t for w in self.words for t in set(w))
        self.vocabulary = {t: k for k, t in enumerate(sorted(df))}
        idf = {t: math.log1p((n - k + 0.5) / (k + 0.5)) for t, k in df.items()}
        self.impacts: list[dict[int, float]] = []
        postings: dict[int, dict[int, float]] = defaultdict(dict)
        for i, w in enumerate(self.words):
            own = {t: idf[t] * k * (K1 + 1) / (k + K1 * (1 - B + B * len(w) / mean)) for t, k in Counter(w).items()}
            whole = sum(own.values())
            self.impacts.append({self.vocabulary[t]: x / whole for t, x in own.items()})
            for t, x in self.impacts[-1].items():
                b = i // BLOCK
                postings[t][b] = max(postings[t].get(b, 0.0), x)
        self.answer = [self._answer(t, w) for _, t, w in kept]
        self.blocks = -(-n // BLOCK)
        size = len(self.vocabulary)
        self.most = np.array([max(postings[t].values()) for t in range(size)])  # a term's greatest impact on any item
        many = np.array([len(postings[t]) > max(2, self.blocks // 20) for t in range(size)], bool)
        self.column = np.where(many, np.cumsum(many) - 1, -1)  # frequent terms have a row of block maxima each
        self.maxima = np.zeros((int(many.sum()), self.blocks), np.float32)
        for t in np.flatnonzero(many).tolist():
            self.maxima[self.column[t], list(postings[t])] = list(postings[t].values())
        rare = [sorted(postings[t].items()) if not many[t] else [] for t in range(size)]
        self.start = np.concatenate([[0], np.cumsum([len(p) for p in rare])]).astype(np.int64)
        self.block_of = np.array([b for p in rare for b, _ in p], np.int64)
        self.bound = np.array([x for p in rare for _, x in p])

    @staticmethod
    def _answer(text: str, words: list[str]) -> int:
        """Number of words of the answer."""
        parts = [w for s in _SENTENCE.split(text.strip()) if (w := tokens(s))]
        return len(parts[-1]) if len(parts) > 1 else len(words) // 3

    @classmethod
    def _pieces(cls, text: str, words: list[str]) -> list[tuple[int, set]]:
        """(n, n-grams) of the question and of the answer."""
        if len(words) < SHORT:
            return [(len(words), grams(words, len(words)))]
        cut = len(words) - cls._answer(text, words)
        return [(n := min(GRAM, len(p)), grams(p, n)) for p in (words[:cut], words[cut:])]

    def aligned(self, item: int, passage: list[str], places: dict[str, list[int]]) -> tuple[float, float]:
        """Shares of the question's and of the answer's words that stand in place where the item agrees best with the passage."""
        words, cut = self.words[item], len(self.words[item]) - self.answer[item]
        agree = Counter(i - j for j, w in enumerate(words) for i in places.get(w, ()))
        if not agree:
            return 0.0, 0.0
        most = max(agree.values())
        at = min(o for o, n in agree.items() if n == most)
        same = [0 <= at + j < len(passage) and passage[at + j] == w for j, w in enumerate(words)]
        return sum(same[:cut]) / max(1, cut), sum(same[cut:]) / max(1, len(words) - cut)

    def candidates(self, ids: np.ndarray, passage: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """Keys passage * blocks + block whose upper bound reaches SHARE, of n passages, in order; ids: terms, and where they
        stand. In the first test a term counts as often as it stands there, which only makes the bound looser."""
        pivots = np.flatnonzero(np.bincount(passage, self.most[ids], n) >= SHARE - 1e-4)
        step = max(1, CELLS // max(1, self.blocks))
        for at in range(0, len(pivots), step):
            own = pivots[at : at + step]
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            there = place[passage] >= 0
            found = self.bounds(ids[there], place[passage[there]], len(own))
            yield own[found // self.blocks] * self.blocks + found % self.blocks

    def bounds(self, ids: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
        """The same for passages that all have a pivot. Frequent terms: presence times block maxima, one product. Rare terms:
        their few blocks are added to that."""
        column = self.column[ids]
        there = np.zeros((n, len(self.maxima)), np.float32)
        there[passage[column >= 0], column[column >= 0]] = 1
        bound = (there @ self.maxima).ravel() if len(self.maxima) else np.zeros(n * self.blocks, np.float32)
        size = len(self.column)
        pair = np.unique((passage * size + ids)[column < 0])
        at, term = pair // size, pair % size
        k = self.start[term + 1] - self.start[term]
        first = np.repeat(self.start[term] - np.cumsum(k) + k, k) + np.arange(k.sum())
        bound += np.bincount(np.repeat(at, k) * self.blocks + self.block_of[first], self.bound[first], len(bound)).astype(np.float32)
        return np.flatnonzero(bound >= SHARE - 1e-4)

    def search(self, texts: list[str]) -> list[dict[int, tuple[float, float, float]]]:
        """Per text: item number -> (score, share of the question, share of the answer) of its best passage."""
        out: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        if not self.ids:
            return out
        found = [tokens(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((k for w in found for k in map(self.vocabulary.get, w, repeat(-1))), np.int64, int(sizes.sum()))
        row = np.repeat(np.arange(len(found)), sizes)
        start = np.concatenate([[0], np.cumsum(sizes)])
        steps = sizes // self.length + 1  # passage k of a text holds steps k and k + 1
        base = np.concatenate([[0], np.cumsum(steps)])
        at = np.flatnonzero(ids >= 0)
        step = (at - start[row[at]]) // self.length
        here = base[row[at]] + step
        back = step > 0
        keys = self.candidates(np.concatenate([ids[at], ids[at][back]]), np.concatenate([here, here[back] - 1]), int(base[-1]))
        last, own, held = -1, [], set()
        for key in chain.from_iterable(k.tolist() for k in keys):
            passage, block = divmod(key, self.blocks)
            if passage != last:
                r = int(np.searchsorted(base, passage, "right")) - 1
                low = (passage - int(base[r])) * self.length
                own = found[r][low : low + 2 * self.length]
                places: dict[str, list[int]] = defaultdict(list)
                for k, w in enumerate(own):
                    if w in self.vocabulary:
                        places[w].append(k)
                held = {self.vocabulary[w] for w in places}
                last, known = passage, {}
            for item in range(block * BLOCK, min(len(self.ids), (block + 1) * BLOCK)):
                score = sum(x for t, x in self.impacts[item].items() if t in held)
                if score < SHARE:
                    continue
                shares = []
                for n, wanted in self.pieces[item]:
                    if n not in known:
                        known[n] = grams(own, n)
                    shares.append(len(wanted & known[n]) / max(1, len(wanted)))
                need = 1.0 if len(self.words[item]) < SHORT else OVERLAP
                if len(shares) == 2:
                    shares = list(map(max, shares, self.aligned(item, own, places)))
                if min(shares) >= need:
                    out[r][item] = max(out[r].get(item, (0.0, 0.0, 0.0)), (score, shares[0], shares[-1]))
        return out


def indexes(benchmark: DataFrame, most: int = ITEMS) -> Iterator[Index]:
    """Indexes over parts of at most about `most` items, one after the other; the driver holds one part at a time."""
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    parts = -(-rows.count() // most)
    for k in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        yield Index([(r.item_id, r.text) for r in own])


def _searched(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of bounded text, with what the index finds in each row."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        at = 0
        while at < len(texts):
            end, total = at, 0
            while end < len(texts) and (end == at or total + len(texts[end]) <= 6 * CHUNK_WORDS):
                total += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), index.search(texts[at:end])
            at = end


def hits(docs: DataFrame, benchmark: DataFrame, most: int = ITEMS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of all copies of test items; no shuffle."""
    kinds = [f.dataType for f in (docs.schema["doc_id"], benchmark.schema["item_id"])]
    shape = T.StructType([T.StructField("doc_id", kinds[0]), T.StructField("item_id", kinds[1])])
    for name in ("score", "question_overlap", "answer_overlap"):
        shape = shape.add(name, T.DoubleType())

    def over(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, found in _searched(batches, index):
                ids = part.column(0)
                rows = [(k, index.ids[i], *x) for k, f in enumerate(found) for i, x in sorted(f.items())]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], to_arrow_type(kinds[1])), *[pa.array(c, pa.float64()) for c in cols[2:]]], shape.names
                )

        return docs.select("doc_id", "text").mapInArrow(run, shape)

    out = docs.sparkSession.createDataFrame([], shape)
    for index in indexes(benchmark, most):
        out = out.unionByName(over(index))
    return out


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a copy of a test item; rows are dropped where they are read."""
    for index in indexes(table(spark, sf_dir, "benchmark")):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for part, found in _searched(batches, index):
                yield part.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_block_max_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap")})


QUERIES = {"op9_block_max_decontamination": op9_block_max_decontamination}

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
#: Every passage against every item with a common term, without bounds.
ORACLE = {
    "op9_block_max_decontamination": rf"""WITH i AS MATERIALIZED (SELECT DISTINCT item_id, text, {_TOKENS.format("text")} AS ws FROM benchmark WHERE len({_TOKENS.format("text")}) > 0),
 st AS (SELECT count(*) AS n, avg(len(ws)) AS mean, max(len(ws)) AS longest FROM i),
 tf AS (SELECT item_id, t, count(*) AS k, any_value(m) AS m FROM (SELECT item_id, unnest(ws) AS t, len(ws) AS m FROM i) GROUP BY item_id, t),
 df AS (SELECT t, count(*) AS d FROM tf GROUP BY t),
 im AS (SELECT item_id, t, ln(1 + (n - d + 0.5) / (d + 0.5)) * k * {K1 + 1} / (k + {K1} * ({1 - B} + {B} * m / mean)) AS x FROM tf JOIN df USING (t), st),
 im2 AS MATERIALIZED (SELECT item_id, t, x / sum(x) OVER (PARTITION BY item_id) AS x FROM im),
 w AS MATERIALIZED (SELECT doc_id, {_TOKENS.format("text")} AS ws FROM documents WHERE text IS NOT NULL),
 p AS MATERIALIZED (SELECT doc_id, s, ws[s * longest + 1 : (s + 2) * longest] AS ws FROM (SELECT doc_id, ws, longest, unnest(generate_series(0, len(ws) // longest)) AS s FROM w, st)),
 c AS MATERIALIZED (SELECT doc_id, s, item_id, sum(x) AS score FROM (SELECT DISTINCT doc_id, s, unnest(ws) AS t FROM p) JOIN im2 USING (t) GROUP BY ALL HAVING sum(x) >= {SHARE}),
 sp AS (SELECT item_id, ws, list_filter(list_transform(string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '([.!?
])\s+', '' || chr(1), 'g'), chr(1)), lambda y: {_TOKENS.format("y")}), lambda y: len(y) > 0) AS ps FROM i),
 qa AS (SELECT item_id, ws, CASE WHEN len(ps) > 1 THEN len(ps[-1]) ELSE len(ws) // 3 END AS la FROM sp),
 pc AS (SELECT item_id, len(ws) AS m, 0 AS part, CASE WHEN len(ws) < {SHORT} THEN ws ELSE ws[1 : len(ws) - la] END AS ws FROM qa
  UNION ALL SELECT item_id, len(ws), 1, CASE WHEN len(ws) < {SHORT} THEN ws ELSE ws[len(ws) - la + 1 : len(ws)] END FROM qa),
 pn AS (SELECT item_id, part, m, ws, CASE WHEN m < {SHORT} THEN m ELSE least({GRAM}, len(ws)) END AS n FROM pc),
 ig AS MATERIALIZED (SELECT DISTINCT item_id, part, m, n, g FROM (SELECT item_id, part, m, n, hash(ws[j : j + n - 1]) AS g FROM (SELECT *, unnest(generate_series(1, len(ws) - n + 1)) AS j FROM pn))),
 need AS (SELECT item_id, part, any_value(m) AS m, any_value(n) AS n, count(*) AS k FROM ig GROUP BY item_id, part),
 hg AS (SELECT DISTINCT doc_id, s, n, hash(ws[j : j + n - 1]) AS g FROM (SELECT doc_id, s, n, ws, unnest(generate_series(1, len(ws) - n + 1)) AS j FROM (SELECT DISTINCT doc_id, s, n, ws FROM c JOIN need USING (item_id) JOIN p USING (doc_id, s)))),
 iw AS (SELECT item_id, j, ws[j] AS w, j > len(ws) - la AS late, len(ws) - la AS lq, la FROM (SELECT *, unnest(generate_series(1, len(ws))) AS j FROM qa WHERE len(ws) >= {SHORT})),
 pw AS (SELECT doc_id, s, i, ws[i] AS w FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM (SELECT DISTINCT doc_id, s, ws FROM c JOIN p USING (doc_id, s)))),
 dg AS (SELECT c.doc_id, c.s, c.item_id, i - j AS o, count(*) AS k, count(*) FILTER (NOT late) / any_value(lq) AS q, count(*) FILTER (late) / any_value(la) AS a FROM c JOIN iw USING (item_id) JOIN pw ON pw.doc_id = c.doc_id AND pw.s = c.s AND pw.w = iw.w GROUP BY 1, 2, 3, 4),
 al AS (SELECT * FROM dg QUALIFY row_number() OVER (PARTITION BY doc_id, s, item_id ORDER BY k DESC, o) = 1),
 sh AS (SELECT g.doc_id, g.s, g.item_id, g.part, g.score, g.m, greatest(g.share, coalesce(CASE WHEN g.part = 0 THEN al.q ELSE al.a END, 0)) AS share FROM (SELECT c.doc_id, c.s, c.item_id, need.part, any_value(c.score) AS score, any_value(need.m) AS m, count(hg.g) / any_value(need.k) AS share
  FROM c JOIN need USING (item_id) JOIN ig ON ig.item_id = c.item_id AND ig.part = need.part LEFT JOIN hg ON hg.doc_id = c.doc_id AND hg.s = c.s AND hg.n = ig.n AND hg.g = ig.g GROUP BY 1, 2, 3, 4) g LEFT JOIN al USING (doc_id, s, item_id)),
 ok AS (SELECT q.doc_id, q.item_id, round(q.score, 6) AS score, round(q.share, 6) AS question_overlap, round(a.share, 6) AS answer_overlap FROM sh q JOIN sh a USING (doc_id, s, item_id)
  WHERE q.part = 0 AND a.part = 1 AND least(q.share, a.share) >= CASE WHEN q.m < {SHORT} THEN 1.0 ELSE {OVERLAP} END)
 SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, question_overlap DESC, answer_overlap DESC) = 1"""
}
