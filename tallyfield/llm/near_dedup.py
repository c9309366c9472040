"""Near-duplicate documents by BagMinHash signatures of word shingles.

A text is the bag of its shingles of `SHINGLE` words (a shorter text is one shingle). For each shingle and dyadic range
of multiplicities, a Poisson process seeded by the shingle runs over the signature's components; a point counts for a
text if the multiplicity it falls on is at most the text's. Points are made in ascending order and only as far as
they can still lower a component, so a signature costs about M log M points whatever the text's length and weights. A
component's smallest point is equal in two texts with probability their weighted Jaccard similarity.

Equal word sequences are merged first. Signatures are cut into `BANDS` bands of `ROWS` components (at similarity 0.8 a pair
misses all bands with probability 6e-5); texts that share a band share a bucket. Links are verified exactly, as
sum(min) / sum(max) of multiplicities >= `LEAST`, and classes are the connected components of verified links.

A bucket never puts out all its pairs. First its members are tested against one leader; then, `STAR_ROUNDS` times, those
outside the bucket's largest class against a member of it that differs from bucket to bucket; what is then still apart
is compared in blocks of about `BLOCK` members by signature (an estimate under `ESTIMATE` is over five standard errors below
`LEAST`); pairs that pass are verified where they are found and only links are put out. Buckets whose members are all in one class are done.

Defined cases: words are runs of characters outside the blanks, case counts; texts without words (null, empty)
are a class each; the class id is the least doc_id of the class (null last); classes that no id tells apart, as their
heads share one or have none, differ in `head_key`; rows equal in doc_id and text are one document; very long texts
are signed whole, in time linear in their words; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, narrow, row_key, stage, table, text_of

SHINGLE = 5
BANDS = 32
ROWS = 6
M = BANDS * ROWS
LEAST = 0.8
ESTIMATE = 0.65
STAR_ROUNDS = 2
BLOCK = 256
BLOCK_CELLS = 1 << 20
CHUNK_BYTES = 800_000
CELLS = 32_768
PAIR_WORDS = 150_000
#: What is in every text with a word: a character outside the blanks.
WORD_RE = r"[^\x20\x09-\x0D]"
_G = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ONE = np.float64(1).view(np.uint64)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _A
    z = (z ^ (z >> np.uint64(27))) * _B
    return z ^ (z >> np.uint64(31))


def shingles(words: np.ndarray, sizes: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all shingles, from concatenated word hashes; a row of fewer than k words has one of all of them."""
    words = words.astype(np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    at = np.arange(len(words)) - (ends - sizes)[row]
    left = sizes[row] - at
    h = np.full(len(words), k, np.uint64)
    for j in range(k):
        own = np.zeros(len(words), np.uint64)
        own[: len(words) - j] = words[j:]
        h = mixed(h * _G + np.where(left > j, own + np.uint64(j + 1), np.uint64(0)))
    first = (left >= k) | ((at == 0) & (sizes[row] < k))
    return row[first], h[first]


def _runs(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start): an order in which equal shingles of a row are neighbours, and where each run of them starts."""
    key = h + mixed(row.astype(np.uint64) * _G)
    order = np.argsort(key)
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return order, np.flatnonzero(new)


def bags(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, multiplicity) of the distinct shingles of each row, in no order."""
    order, start = _runs(row, h)
    first = order[start]
    return row[first], h[first], np.diff(np.append(start, len(h)))


def numbered(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """h, where repeats in a row are hashed with their number: a row's bag as a set, so that the Jaccard similarity of two
    sets is the weighted one of the bags."""
    order, start = _runs(row, h)
    nth = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    repeats = np.flatnonzero(nth)
    out, at = h.copy(), order[repeats]
    out[at] = mixed(h[at] + nth[repeats].astype(np.uint64) * _G)
    return out


def bag_minhash(row: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """n x m matrix of smallest points. Every row needs a shingle.

    A row's processes run up to a limit, which rises until all its components have a point, then to the largest of these.
    """
    sig = np.full((n, m), np.inf)
    mean = 1 / np.maximum(np.bincount(row, weights=count, minlength=n), 1)
    limit, more = (np.log(m) + 0.5) * mean, 1.5 * mean
    ranges, low, own = [], 0, np.arange(len(h))
    while len(own):  # (0, 1], (1, 2], (2, 4], ... as far as the multiplicity reaches
        ranges.append((own, np.full(len(own), low)))
        low += max(1, low)
        own = own[count[own] > low]
    own, low = (np.concatenate(k) for k in zip(*ranges, strict=True)) if ranges else (own, own)
    row, count, width = row[own], count[own], np.maximum(low, 1)
    state, x = mixed(h[own] + low.astype(np.uint64) * _A), np.zeros(len(own))
    live = np.arange(len(own))
    while True:
        while len(live):
            left = (limit[row[live]] - x[live]) * (m * width[live])
            power = np.round(np.log2(np.clip(left, 1, 4096))).astype(np.int64)
            for k in np.flatnonzero(np.bincount(power)).tolist():
                at = live[power == k]
                for i in range(0, len(at), max(1, CELLS >> k)):
                    _points(sig, row, count, low, width, state, x, at[i : i + max(1, CELLS >> k)], 1 << k)
            live = live[x[live] < limit[row[live]]]
        top = sig.max(axis=1)
        short = top > limit
        if not short.any():
            return sig
        limit[short] = np.minimum(top[short], limit[short] + more[short])
        more[short] *= 2
        live = np.flatnonzero(short[row])
        live = live[x[live] < limit[row[live]]]


def _points(sig: np.ndarray, row: np.ndarray, count: np.ndarray, low: np.ndarray, width: np.ndarray, state: np.ndarray, x: np.ndarray, at: np.ndarray, k: int) -> None:
    """Runs each process of `at` by k more points and lowers sig where they do. A process is the same in any steps."""
    m = sig.shape[1]
    z = state[at][:, None] + np.arange(1, k + 1, dtype=np.uint64) * _G
    state[at] = z[:, -1]
    r = mixed(z)
    wait = np.log(2.0 - ((r >> np.uint64(24) << np.uint64(12)) | _ONE).view(float))  # 40 bits: 2 - [1, 2)
    wait /= -float(m) * width[at][:, None]
    wait[:, 0] += x[at]
    points = np.add.accumulate(wait, axis=1)
    x[at] = points[:, -1]
    part = ((r & np.uint64(0xFFFFFF)) * np.uint64(m)) >> np.uint64(24)
    wide = width[at]
    if (wide > 1).any():
        reach = (((mixed(z ^ _B) >> np.uint64(32)) * wide.astype(np.uint64)[:, None]) >> np.uint64(32)).astype(np.int64)
        points[reach + (low[at] + 1)[:, None] > count[at][:, None]] = np.inf
    np.minimum.at(sig.reshape(-1), (part.view(np.int64) + (row[at] * m)[:, None]).ravel(), points.ravel())


def hashed_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, one text after the other; words of each text). texts: without nulls."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    first, size = int(ends[0]), int(ends[-1] - ends[0])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = ends - first
    raw = np.zeros(size + 8, np.uint8)
    raw[:size] = np.frombuffer(data, np.uint8, size, first)
    inside = np.zeros(size + 1, bool)
    inside[:size] = (raw[:size] != 32) & (raw[:size] - np.uint8(9) > 4)
    before = np.append(False, inside[:size])
    before[ends] = False
    start = np.flatnonzero(inside & ~before)
    after = inside.copy()
    after[ends] = False
    stop = np.flatnonzero(inside[:size] & ~after[1:]) + 1
    sizes = np.diff(np.searchsorted(start, ends))
    if not len(start):
        return np.zeros(0, np.uint64), sizes
    blocks = (stop - start + 7) >> 3  # of eight bytes
    head = np.cumsum(blocks) - blocks
    nth = np.arange(int(blocks.sum())) - np.repeat(head, blocks)
    at = np.repeat(start, blocks) + 8 * nth
    bytes_left = np.minimum(np.repeat(stop, blocks) - at, 8)
    value = np.ndarray(size + 1, "<u8", raw.data, strides=(1,))[at] & _MASKS[bytes_left]
    spread = np.add.reduceat(mixed(value + (nth + 1).astype(np.uint64) * _G), head)
    return mixed(spread + (stop - start).astype(np.uint64) * _A), sizes


def sequence_hashes(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's words in their order. Every text needs a word."""
    head = np.cumsum(sizes) - sizes
    place = (np.arange(len(words)) - np.repeat(head, sizes) + 1).astype(np.uint64) * _G
    once = mixed(words + place)
    return tuple(mixed(np.add.reduceat(z, head) + sizes.astype(np.uint64)).view(np.int64) for z in (once, mixed(once ^ _B)))


def _worded(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about CHUNK_BYTES of text, without the texts that have no word: (slice, hashed words, sizes)."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK_BYTES, "right")))
        part = batch.slice(start, stop - start)
        words, sizes = hashed_words(part.column(column))
        if len(words):
            yield part if sizes.all() else part.filter(pa.array(sizes > 0)), words, sizes[sizes > 0]
        start = stop


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, _k1 and _k2 (row key), w1 and w2 (hash of the word sequence), sig (M numbers of 16 bits) of each document with a word;
    no shuffle."""
    rows = docs.select("doc_id", *row_key("doc_id", "text"), text_of().alias("text"))
    held = ["doc_id", "_k1", "_k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, sizes in _worded(batch, len(held)):
                sig = bag_minhash(*bags(*shingles(words, sizes)), len(sizes))
                fold = mixed(sig.view(np.uint64)) >> np.uint64(48)
                fold = _lists(fold.astype(np.uint16).view(np.int16).ravel(), np.full(len(sizes), M))
                own = [part.column(k) for k in range(len(held))] + [pa.array(w) for w in sequence_hashes(words, sizes)]
                yield pa.RecordBatch.from_arrays([*own, fold], [*held, "w1", "w2", "sig"])

    shape = rows.select(*held).schema.add("w1", T.LongType()).add("w2", T.LongType())
    return rows.mapInArrow(run, shape.add("sig", T.ArrayType(T.ShortType())))


def worded(texts: DataFrame) -> DataFrame:
    """v and words: the hashes of its text's words. texts: v and text, which has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, sizes in _worded(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(words.view(np.int64), sizes)], ["v", "words"])

    rows = texts.select("v", "text")
    return rows.mapInArrow(run, rows.select("v").schema.add("words", T.ArrayType(T.LongType())))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags that `numbered` made sets."""
    z = np.sort(np.concatenate([a, b]))
    both = np.count_nonzero(z[1:] == z[:-1])
    return both / (len(z) - both)


def _bags(words: pa.ListArray) -> list[np.ndarray]:
    """The bags of lists of word hashes, as `numbered` has them."""
    sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row, h = shingles(words.flatten().to_numpy(zero_copy_only=False), sizes)
    return np.split(numbered(row, h), np.cumsum(np.bincount(row, minlength=len(sizes)))[:-1])


def verified(pairs: DataFrame, held: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (x, y) whose similarity is at least `least`. held: v and its words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            na, nb = (np.maximum(c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) - SHINGLE + 1, 1) for c in (a, b))
            good = np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-6  # no pair of other sizes can reach it
            rows = np.flatnonzero(good)
            for at in np.split(rows, np.flatnonzero(np.diff(np.cumsum((na + nb)[rows]) // PAIR_WORDS)) + 1) if len(rows) else []:
                good[at] = [overlap(p, q) >= least - 1e-12 for p, q in zip(_bags(a.take(pa.array(at))), _bags(b.take(pa.array(at))), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    words = lambda v, w: held.select(F.col("v").alias(v), F.col("words").alias(w))
    rows = pairs.join(words("x", "wx"), "x").join(words("y", "wy"), "y").select("x", "y", "wx", "wy")
    return rows.mapInArrow(run, rows.select("x", "y").schema)


def components(links: DataFrame) -> DataFrame:
    """v, c: the least vertex of each linked vertex's component; alternating large and small stars."""
    passing: list[DataFrame] = []

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        both = both if large else both.where("y < x")
        least = stage(both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m")), "star-least")
        passing.append(least)
        met = both.join(least, "x")
        out = met.where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")) if large else met.select(F.col("y").alias("x"), F.col("m").alias("y"))
        if not large:
            out = out.unionByName(least.select("x", F.col("m").alias("y")))
        return out.where("x <> y").distinct()

    edges, seen = stage(links.select("x", "y").distinct(), "links"), None
    while True:
        large = stage(star(edges, True), "star-large")
        discard(edges)
        edges = stage(star(large, False), "star-small")
        discard(large, *passing)
        passing.clear()
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = edges.select("y").distinct().select(F.col("y").alias("v"), F.col("y").alias("c"))
    return edges.select(F.col("x").alias("v"), F.col("y").alias("c")).unionByName(roots)


def only(held: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of held whose v is in (stored) rows: where few are, others aren't shuffled."""
    return held.join(narrow(rows.select("v").distinct()), "v", "left_semi")


def block_links(rows: DataFrame, top: DataFrame, signs: DataFrame, held: DataFrame) -> DataFrame:
    """Verified links (x, y) that join what is still apart in unfinished buckets.

    rows: bucket, v, c; top: unfinished buckets with their largest class `most` and how many members are in it or not.
    Members are dealt into blocks by hash, those of the largest class apart from the others; blocks of others meet each
    other (i <= j) and those of the largest class (wide). Only block numbers are multiplied; a task holds two blocks.
    A task looks at a pair if its classes differ, its signatures agree in a share of ESTIMATE or more, and this is the first
    band that the two share (else that band's bucket looks at it), best estimates first; it verifies the pair if
    no link found so far in the task has joined the classes. So a task puts out fewer links than it has members.
    Signatures alone meet first, and only those of members of such buckets are sent; words are only sent for members that have such a pair.
    """
    n_out, n_in = F.ceil(F.col("n_out") / BLOCK).cast("int"), F.ceil(F.col("n_in") / BLOCK).cast("int")
    dealt = rows.join(top, "bucket").withColumn("inside", F.col("c") == F.col("most"))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("v"), F.when(F.col("inside"), n_in).otherwise(n_out)).cast("int"))
    dealt = stage(dealt, "block-members")
    b = F.col("b")

    def task(i: Column, j: Column, wide: bool, side: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), F.lit(wide).alias("wide"), side.alias("side"))

    out = F.sequence(F.lit(0), n_out - 1)
    meets_out = F.transform(out, lambda k: task(F.least(b, k), F.greatest(b, k), False, (b > k).cast("int")))
    meets_in = F.transform(F.sequence(F.lit(0), n_in - 1), lambda k: task(b, k, True, F.lit(0)))
    tasks = F.when(F.col("inside"), F.transform(out, lambda k: task(k, b, True, F.lit(1)))).otherwise(F.concat(meets_out, meets_in))
    sent = dealt.select("bucket", "band", "v", F.xxhash64("c").alias("c"), F.explode(tasks).alias("t")).join(only(signs, dealt), "v")
    sent = sent.select("bucket", "t.*", "band", "v", "c", "sig")

    def near_pairs(group: pa.Table) -> list[tuple[float, int, int]]:
        sig = group["sig"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, M)
        c, side, band = (group[k].to_numpy() for k in ("c", "side", "band"))
        alone = group["i"][0].as_py() == group["j"][0].as_py() and not group["wide"][0].as_py()
        left = np.arange(len(sig)) if alone else np.flatnonzero(side == 0)
        right = left if alone else np.flatnonzero(side == 1)
        near = []
        for some in np.array_split(left, -(-(len(left) * len(right) * M) // BLOCK_CELLS)) if len(left) and len(right) else []:
            apart = c[some][:, None] != c[right]
            if alone:
                apart &= right > some[:, None]
            same = sig[some][:, None, :] == sig[right]
            count = np.add.reduce(same.view(np.uint64), axis=2)  # eight components at once, a byte each
            share = ((count * np.uint64(0x0101010101010101)) >> np.uint64(56)) / M
            p, q = np.nonzero(apart & (share >= ESTIMATE))
            first = same[p, q].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band[some[p]]
            near += zip((-share[p, q][first]).tolist(), some[p[first]].tolist(), right[q[first]].tolist(), strict=True)
        return near

    def paired(group: pa.Table) -> pa.Table:
        near = near_pairs(group)
        return group.take(pa.array(sorted({k for pair in near for k in pair[1:]}), pa.int64()))

    def run(group: pa.Table) -> pa.Table:
        near, c = near_pairs(group), group["c"].to_numpy()
        root = {x: x for x in c.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        bag = _bags(group["words"].combine_chunks())
        xs, ys = [], []
        for _, k, j in sorted(near):
            a, b = find(c[k]), find(c[j])
            if a != b and overlap(bag[k], bag[j]) >= LEAST - 1e-12:
                root[a] = b
                xs.append(k)
                ys.append(j)
        v = group["v"].combine_chunks()
        return pa.table({"x": v.take(pa.array(xs, pa.int64())), "y": v.take(pa.array(ys, pa.int64()))})

    kind = rows.schema["v"].dataType
    task_key = ["bucket", "i", "j", "wide"]
    met = stage(sent.groupBy(*task_key).applyInArrow(paired, sent.schema), "block-pairs", wide=True)
    links = met.join(only(held, met), "v").groupBy(*task_key).applyInArrow(run, T.StructType([T.StructField("x", kind), T.StructField("y", kind)]))
    links = stage(links, "block-links")
    discard(dealt, met)
    return links


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, w1, w2 of documents with a word), and (w1, w2, v, c) of distinct word sequences: itself and its class.

    A word sequence is named by its first row: v holds its doc_id (and whether that is null) and its row key.
    """
    rows = stage(signed(docs), "signatures", wide=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_k1").alias("a"), F.col("_k2").alias("b"))).alias("v")
    texts = stage(rows.groupBy("w1", "w2").agg(first, F.first("sig").alias("sig")), "texts")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.slice("sig", k * ROWS + 1, F.lit(ROWS))))
    crowded = texts.select(F.explode(band).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    crowded = stage(crowded, "buckets")
    members = stage(texts.select("v", F.posexplode(band).alias("band", "bucket")).join(crowded, "bucket"), "bucket-members")
    discard(crowded)

    wanted = stage(members.select("v").distinct(), "bucket-texts")
    own = docs.select(*row_key("doc_id", "text"), "text").join(narrow(wanted), (F.col("_k1") == F.col("v.a")) & (F.col("_k2") == F.col("v.b")))
    held = stage(worded(own), "held-words", wide=True)
    if held.count() > wanted.count():  # rows equal in doc_id and text
        twice, held = held, stage(held.dropDuplicates(["v"]), "held-words-once")
        discard(twice)
    discard(wanted)

    leaders = members.groupBy("bucket").agg(F.min("v").alias("x"))
    links = stage(verified(members.join(leaders, "bucket").where("v <> x").select("x", F.col("v").alias("y")).distinct(), held), "links-0")
    found = stage(components(links), "classes-0")
    for k in range(STAR_ROUNDS + 1):
        at = members.join(found, "v", "left").withColumn("c", F.coalesce("c", "v"))
        counts = at.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
        top = counts.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("n"))
        top = stage(top.select("bucket", F.col("m.c").alias("most"), F.col("m.n").alias("n_in"), (F.col("n") - F.col("m.n")).alias("n_out")).where("n_out > 0"), f"top-{k}")
        if top.isEmpty():
            break
        if k < STAR_ROUNDS:
            met = at.join(top.select("bucket", "most"), "bucket")
            by = F.min(F.when(F.col("c") == F.col("most"), F.struct(F.xxhash64("v", "bucket", F.lit(k)).alias("h"), F.col("v").alias("v"))))
            star = stage(met.groupBy("bucket").agg(by.alias("l")).select("bucket", F.col("l.v").alias("x")), f"stars-{k}")
            pairs = met.where("c <> most").join(star, "bucket").select("x", F.col("v").alias("y"))
            more = stage(verified(pairs.distinct(), held), f"links-{k + 1}")
            discard(star)
        else:
            more = block_links(at, top, texts.select("v", "sig"), held)
        discard(top)
        if more.isEmpty():
            continue
        links = links.unionByName(more)
        discard(found)
        found = stage(components(links), f"classes-{k + 1}")
    out = stage(texts.select("w1", "w2", "v").join(found, "v", "left").select("w1", "w2", "v", F.coalesce("c", "v").alias("c")), "text-classes")
    discard(members, held, found, texts)
    return rows.select("doc_id", "w1", "w2"), out


def without_words(docs: DataFrame) -> DataFrame:
    return docs.where(~text_of().rlike(WORD_RE))


def op8_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id (least doc_id of its class) of every document. head_key is null where class_id names one class;
    where it is null or names several, head_key tells them apart (documents without words are alone and have none)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, found = classes(docs)
    heads = found.where("v = c").select(F.col("v.d").alias("d"), F.col("v.a").alias("head_key"))
    shared = heads.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND d IS NOT NULL").select("d")
    named = found.join(narrow(stage(shared, "shared-ids")), F.col("c.d") == F.col("d"), "left")
    key = F.when(F.col("d").isNotNull() | F.col("c.d").isNull(), F.col("c.a")).alias("head_key")
    out = rows.join(named.select("w1", "w2", F.col("c.d").alias("class_id"), key), ["w1", "w2"]).select("doc_id", "class_id", "head_key")
    return out.unionByName(without_words(docs).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(None).cast("bigint").alias("head_key")))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one whose id and text name the class. Documents without words all stay."""
    a, b, c, d = fresh(docs, "_a", "_b", "_c", "_d").values()
    _, found = classes(docs)
    heads = stage(found.where("v = c").select(F.col("v.a").alias(a), F.col("v.b").alias(b)), "class-heads")
    k1, k2 = row_key("doc_id", "text")
    met = docs.select("*", k1.alias(c), k2.alias(d)).join(narrow(heads), (F.col(a) == F.col(c)) & (F.col(b) == F.col(d)))
    return met.dropDuplicates([c, d]).select(*docs.columns).unionByName(without_words(docs))


QUERIES = {"op8_bag_minhash": op8_bag_minhash}

#: All pairs of distinct texts with a common shingle, their exact similarity, and the components of the links.
ORACLE = {
    "op8_bag_minhash": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 t AS MATERIALIZED (SELECT ws, min(doc_id) AS v FROM w WHERE len(ws) > 0 GROUP BY ws),
 s AS (SELECT v, hash(ws[i:i+4]) AS g FROM (SELECT v, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM t)),
 b AS MATERIALIZED (SELECT v, g, count(*) AS k FROM s GROUP BY v, g),
 n AS (SELECT v, sum(k) AS n FROM b GROUP BY v),
 p AS (SELECT x.v AS a, y.v AS b, sum(least(x.k, y.k)) AS k FROM b x JOIN b y ON x.g = y.g AND x.v < y.v GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n i ON i.v = a JOIN n j ON j.v = b WHERE k >= (0.8 - 1e-12) * (i.n + j.n - k)),
 e AS MATERIALIZED (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
 r(v, c) AS (SELECT v, v FROM t UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.v WHERE r.c < e.y),
 m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
 SELECT w.doc_id, coalesce(m.c, w.doc_id) AS class_id, CAST(NULL AS BIGINT) AS head_key FROM w LEFT JOIN t ON t.ws = w.ws LEFT JOIN m ON m.v = t.v"""
}
