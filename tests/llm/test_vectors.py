"""Codes, hard negatives and top-k search against plain searches; odd rows; bounds; several blocks."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as arrays
from tallyfield.llm import exact_search, hard_negatives, vector_codes, vectors
from tallyfield.llm.registry import oracle_sql, queries

NAMES = ["op11_cell_bound_codes", "op12_approximation_negatives", "op13_columnar_top_k"]
SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int, code string, at long, cells string"


def odd_rows(n: int = 240, dims: int = 32) -> list[tuple]:
    """Few distinct values, so many ties; repeated rows; every kind of row that takes no part."""
    draw = np.random.default_rng(5)
    rows = [(i, [float(v) for v in draw.integers(-3, 4, dims) / 8], int(draw.integers(0, 3)) if i % 11 else None) for i in range(n)]
    rows += [(7, rows[7][1], rows[7][2]), (100, rows[100][1], rows[100][2]), (100, rows[3][1], 1), (50, rows[9][1], 2), (50, rows[50][1], rows[50][2])]
    rows += [(None, rows[1][1], 0), (300, None, 1), (350, [None] * dims, 1), (400, [math.nan] + [0.5] * (dims - 1), 1), (450, [math.inf] * dims, 0), (500, [0.0] * dims, 2), (None, None, None)]
    return [(*r, "x", 1, "y", 2, "z") for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def rows(folder):
    import duckdb

    return duckdb.connect().execute(f"SELECT vec_id, embedding, label FROM '{folder}/embeddings.parquet/*.parquet'").fetchall()


def kept(rows):
    out = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [math.floor(256 * x) for x in v], y) for i, v, y in out]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("where", ["odd", "supplied"])
def test_twins(spark, tiny, folder, name, where):
    import duckdb

    con = oracle.connection(tiny)
    if where == "odd":
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    assert oracle.difference(spark, con, queries()[name], oracle_sql()[name], tiny if where == "supplied" else folder) == ""


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, folder, tmp_path, name):
    full = spark.read.parquet(f"{folder}/embeddings.parquet")
    full.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    full.where("embedding IS NULL").write.parquet(f"{tmp_path}/nulls/embeddings.parquet")
    for d in ("none", "nulls"):
        got = queries()[name](spark, f"{tmp_path}/{d}")
        assert got.collect() == [] and got.columns == queries()[name](spark, folder).columns


@pytest.mark.parametrize("block", [3, 4096])
def test_top_k_by_hand(spark, folder, rows, block):
    own = [r for r in kept(rows) if r[0] is not None]
    asked = {(i, tuple(v)) for i, v, _ in own if i % 50 == 0}
    want = []
    for i, v in asked:
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w, _ in own if j != i)[:7]
        want += [(i, k, j, -s) for k, (s, j) in enumerate(found, 1)]
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = exact_search.top_k(table, table.where("vec_id % 50 = 0"), k=7, block=block)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


@pytest.mark.parametrize("block", [2, 512])
def test_negatives_by_hand(spark, folder, rows, block):
    own = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in kept(rows) if i is not None and y is not None]
    want = []
    for i, v, y in {(i, tuple(v), y) for i, v, y in own if i % 100 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z == y) for j, w, z in own if j != i or z != y)
        for p, j in [(-s, j) for s, j, alike in scores if alike][:5]:
            inside = [(-s, k) for s, k, alike in scores if not alike and 30 * p <= -100 * s <= 90 * p][:10]
            want += [(i, j, r, k, p, s) for r, (s, k) in enumerate(inside, 1)]
    table = spark.read.parquet(f"{folder}/embeddings.parquet").withColumn("label", hard_negatives.relabelled())
    got = hard_negatives.mine(table, table["vec_id"] % 100 == 0, block=block)
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_codes_by_hand(spark, folder, rows):
    own = sorted(kept(rows), key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(own[0][1]) // 16
    books = [[v[p * width : (p + 1) * width] for _, v, _ in own[:64]] for p in range(16)]

    def assign():
        out = []
        for _, v, _ in own:
            cut = [v[p * width : (p + 1) * width] for p in range(16)]
            out.append([min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p])) for p, x in enumerate(cut)])
        return out

    for _ in range(2):
        found = assign()
        for p in range(16):
            for k in range(64):
                mine = [own[r][1][p * width : (p + 1) * width] for r in range(len(own)) if found[r][p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    of = {y: sum(e for e, r in zip(error, own, strict=True) if r[2] == y) for y in {r[2] for r in own}}
    want = [(r[0], "".join(f"{k:02x}" for _, k in f), e, of[r[2]], digest) for r, f, e in zip(own, found, error, strict=True)]
    got = queries()["op11_cell_bound_codes"](spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_many_labels_and_few(spark, folder, monkeypatch):
    want = sorted(map(tuple, queries()["op11_cell_bound_codes"](spark, folder).collect()), key=str)
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, queries()["op11_cell_bound_codes"](spark, folder).collect()), key=str) == want


def test_decode(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    books = vector_codes.fit(table)
    for r in vector_codes.encode(table, books).limit(20).join(table.where(vectors.usable()).select("vec_id", "embedding"), "vec_id").dropDuplicates(["vec_id"]).collect():
        apart = vector_codes.decode(r.code, books) - vectors.whole([r.embedding])[0]
        assert r.error == int((apart**2).sum()) or r.vec_id in (50, 100)


GRID = arrays.arrays(np.int64, st.tuples(st.integers(1, 40), st.just(20)), elements=st.integers(-60, 60))


@settings(max_examples=60, deadline=None)
@given(GRID, GRID, st.integers(-30_000, 30_000), st.sampled_from([0.0, 0.5, 1.0]))
def test_no_pair_is_lost(queries_, rows_, floor, sparse):
    i, j, score, work = exact_search.survivors(queries_, rows_, np.full(len(queries_), floor), step=6, sparse=sparse)
    all_pairs = queries_ @ rows_.T
    assert {(a, b, s) for a, b, s in zip(i, j, score, strict=True)} == {(a, b, all_pairs[a, b]) for a, b in zip(*np.nonzero(all_pairs >= floor), strict=True)}
    assert work == sorted(work, reverse=True)


@settings(max_examples=60, deadline=None)
@given(GRID, GRID, st.sampled_from([2, 5, 64]))
def test_bounds_hold(anchors, rows_, cells):
    edges = hard_negatives.edges_of(rows_[:7], rows_.min(axis=0), rows_.max(axis=0), cells)
    code = hard_negatives.cells_of(rows_, edges)
    low, high = hard_negatives.Bounds(anchors, edges).of(code)
    exact = rows_ @ anchors.T
    assert (low <= exact).all() and (exact <= high).all() and code.max() < cells


@settings(max_examples=60, deadline=None)
@given(GRID, GRID, st.integers(0, 6))
def test_nearest_entry(book, x, bits):
    entry, distance, work = vector_codes.Cells(book, bits).nearest(x)
    apart = ((x[:, None] - book) ** 2).sum(axis=2)
    assert (entry == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all() and len(x) <= work <= apart.size


def test_filters_save_work(tiny):
    """On the supplied vectors: few distances are computed, few pairs reach the last dimensions."""
    import duckdb

    own = vectors.whole([v for (v,) in duckdb.connect().execute(f"SELECT embedding FROM '{tiny}/embeddings.parquet' ORDER BY vec_id").fetchall()])
    _, _, computed = vector_codes.Cells(own[:64, :4]).nearest(own[:, :4])
    assert computed < 0.1 * 64 * len(own)
    scores = own[::50] @ own.T
    *_, work = exact_search.survivors(own[::50], own, np.sort(scores, axis=1)[:, -6])
    assert work[-1] < 0.1 * work[0]


def test_large_components():
    with pytest.raises(OverflowError):
        vectors.whole([[1e30, 0.0]])
    big = np.full((2, 4), 1 << 28)
    i, _, score, _ = exact_search.survivors(big, big, np.zeros(2, np.int64), step=2)
    assert len(i) == 4 and set(score.tolist()) == {4 << 56}


def test_lengths(spark):
    with pytest.raises(ValueError):
        vectors.whole([[1.0, 2.0], [3.0, 4.0]], 3)
    with pytest.raises(ValueError):
        vector_codes.first_books(spark.createDataFrame([(1, [0.5] * 9)], "vec_id long, embedding array<double>"))
