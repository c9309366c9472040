"""Operators against brute force, on small fixtures."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyfield.llm import decontaminate, grading, html_text, language_id, line_dedup, near_dedup, pieces, pii, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# ---- 1


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, str, int]]:
    out = []
    patterns = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    for k, (kind, p) in enumerate(patterns):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 14 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def test_pii_base_is_the_plain_search(spark, tiny, texts):
    rng = random.Random(1)
    parts = ["a@b.c", "_d@e.f-g.h", "x@y", "@", "1.2.3.4", ".5.6.7.8", "999.1.1.1", "007.0.0.00255", "4111 1111-1111 1111", "4111111111111112", "+49 (030) 123-4567", "+1", " ", " ", "é", "😀", ".", "-", "12", "++4 4 4 4 4 4 4 4 4 4", "a.b+c%d@e-f.gh.ij"]
    made = {10_000 + k: "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for k in range(400)} | texts
    df = spark.createDataFrame([(k, v) for k, v in made.items()] + [(-1, None)], "doc_id long, text string")
    for r in pii.with_spans(df).select("doc_id", pii.shown("pii_base").alias("b"), pii.shown("pii_spans").alias("s")).collect():
        want = [f"{kind}:{a}:{e}" for a, _, kind, e in base_spans(made.get(r.doc_id) or "")]
        assert r.b == ",".join(want), made.get(r.doc_id)
        assert set(want) <= set(r.s.split(",")) | {""}
    got = {r.doc_id: r for r in pii.op1_boosted_pii(spark, tiny).collect()}
    for k, t in texts.items():
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{kind}:{a}:{e}" for a, _, kind, e in base_spans(t)).encode()).hexdigest()


def test_pii_adds_loose_spans(spark):
    df = spark.createDataFrame([("write to bob.x at foo dot com now",), ("the host 10[.]0[.]0[.]1 fell",), ("page 12-34-56-78 of 90.91.92",), ("meet at noon.",)], "text string")
    assert [r.redacted for r in pii.redact(df).collect()] == ["write to <EMAIL> now", "the host <IP> fell", "page 12-34-56-78 of 90.91.92", "meet at noon."]


def test_pii_many_matches_in_one_text(spark):
    text = "a@b.cc " * 700
    got = pii.with_spans(spark.createDataFrame([(text,)], "text string")).select(pii.shown("pii_base")).first()[0].split(",")
    assert len(got) == 700 and got[-1] == f"email:{699 * 7}:{699 * 7 + 6}"


# ---- 2


def test_min_cut_is_least():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(1, 9)
        gain = [rng.gauss(0, 1.5) for _ in range(n)]
        edges = [(a, b, rng.random() * 1.5) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda s, gain=gain, edges=edges: sum(max(g, 0) if not k else max(-g, 0) for g, k in zip(gain, s, strict=True)) + sum(c for a, b, c in edges if s[a] != s[b])
        assert cost(html_text.source_side(gain, edges)) == pytest.approx(min(map(cost, itertools.product((False, True), repeat=n))))


def test_html_articles(spark, tiny):
    w = html_text.fitted()
    for page, good in html_text.sample_pages(60, seed=99):
        assert html_text.main_text(page, w) == " ".join(b.text for b in html_text.blocks(page) if b.text in good)
    page = '<nav><a href=x>Home</a></nav><div class="ad">x</div><article><h1>A &amp; B</h1><p>a < b is\n <b>bo</b>ld&nbsp;x<script>var t="</p>";</script><aside>no</aside><p>Second.<div id="comments"><p>bad comment here.</p></div></article><footer>f'
    assert html_text.main_text(page, w) == "A & B a < b is bold x Second."
    assert html_text.main_text(None, w) == html_text.main_text("", w) == html_text.main_text("<div", w) == ""
    long = "<article>" + "<p>Some words stand here.</p>" * 20_000 + "</article>"
    assert len(html_text.main_text(long, w)) == 23 * 20_000 - 1
    got = html_text.op2_min_cut_html(spark, tiny).collect()
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == spark.read.parquet(f"{tiny}/pages.parquet").count()


# ---- 3


def test_pieces_equal_the_library(texts):
    spm = pytest.importorskip("sentencepiece")
    lib, own = spm.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Transducer(pieces.load())
    rng = random.Random(2)
    alphabet = ["a", "b", "th", "e", "   ", " ", "\n", "\t", "é", "😀", "ß", "1", "23", ".", ",", "▁", "中", "하", "\x00", "ing", "tion", "aaaa", " " * 20, "<0x0A>", "<s>", "\r\n", "é"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for t in [*texts.values(), *made, "ab" * 30_000, " " * 5000]:
        ids = own.encode(t)
        assert ids.tolist() == lib.encode(t)
        assert own.decode(ids) == lib.decode(ids.tolist())
        assert "▁" in t or own.decode(ids) == t


# ---- 4


def test_language_accuracy(spark, docs):
    model = language_id.train(docs, per_lang=60)
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_kernel_map_is_the_plain_kernel():
    """Inner products of presence rows are cosines of n-gram sets (up to hash collisions), and the folded matrix scores as the
    map through the landmarks does."""
    rng = random.Random(9)
    made = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 40))) for _ in range(40)]
    sets = [{t[i : i + n] for n in range(1, language_id.ORDERS + 1) for i in range(len(t) - n + 1)} for t in made]
    x = language_id.presence(made, bins=1 << 20)
    for i, j in itertools.combinations(range(40), 2):
        assert x[i] @ x[j] == pytest.approx(len(sets[i] & sets[j]) / (len(sets[i]) * len(sets[j])) ** 0.5, abs=2e-3)
    row = collections.namedtuple("row", "text lang")
    rows = [row(t, "uv"[k % 2]) for k, t in enumerate(made)]
    langs, weights = language_id.fit(rows, landmarks=10)
    p = language_id.presence(made).astype(float)
    marks = np.vstack([p[[k for k in range(40) if k % 2 == v][:5]] for v in (0, 1)])
    values, vectors = np.linalg.eigh(marks @ marks.T)
    phi = (p @ marks.T) @ (vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T)
    y = np.array([[1.0 if r.lang == v else -1.0 for v in langs] for r in rows])
    ridge = np.linalg.solve(phi.T @ phi + language_id.RIDGE * 40 * np.eye(10), phi.T @ y)
    assert np.allclose(p @ weights, phi @ ridge, atol=1e-3)


# ---- 5


def test_quality_counts_are_the_plain_ones(spark, tiny, texts):
    rng = random.Random(4)
    made = {10_000 + k: "".join(rng.choice(["a", "b", "c d", "\n", " ", "#x", "\t\x0b", "e f"]) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 60))) for k in range(200)} | texts
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    for r in quality_rules.with_features(df).collect():
        t = made[r.doc_id]
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered))


# ---- 6


def test_shards(spark, docs, tiny):
    rows, slot_map, weight = sharding.shard_rows(docs)
    got = rows.collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert len(got) == docs.count() and set(by) <= set(range(24))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sums = [sum(r["size"] for r in own) for own in by.values()]
    assert max(sums) - min(sums) <= max(r["size"] for r in got)
    assert {r.doc_id: r["size"] for r in got} == {r.doc_id: len((r.text or "").encode()) + 8 for r in docs.collect()}
    grown = slot_map.grow(weight)
    assert grown.version == 2 and all(b in (a, 24) for a, b in zip(slot_map.shard_of, grown.shard_of, strict=True))
    assert sum(weight.get(s, 0) for s in grown.moved) <= sum(weight.values()) / 25


def test_many_copies_of_one_row_spread(spark):
    df = spark.createDataFrame([(None, "the same text")], "doc_id long, text string").selectExpr("doc_id", "text", "explode(sequence(1, 100000)) AS k").drop("k")
    got = sharding.shard_rows(df)[0].groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert len(got) == 24 and sum(r.n for r in got) == 100_000 and all(r.n == r.d == r.m + 1 for r in got)
    assert max(r.n for r in got) - min(r.n for r in got) <= 2 * sharding.RUN


def test_slot_map_versions(spark, tmp_path):
    one = sharding.SlotMap.deal({0: 5, 1: 3, 2: 2}, 4, 2)
    two = one.grow({0: 5, 1: 3, 2: 2})
    for m in (one, two):
        m.save(spark, str(tmp_path))
    assert sharding.SlotMap.load(spark, str(tmp_path), 1).shard_of == one.shard_of and sharding.SlotMap.load(spark, str(tmp_path), 2).shard_of == two.shard_of


# ---- 7


def test_slopes_are_those_of_the_likelihood():
    rng = np.random.default_rng(3)
    loss = lambda z, cuts, g: -np.log(np.concatenate([[1.0], 1 / (1 + np.exp(cuts - z)), [0.0]])[[g, g + 1]] @ [1, -1])
    for _ in range(50):
        z, cuts, g, e = rng.normal(), np.sort(rng.normal(size=2)) + [0, 0.2], int(rng.integers(3)), 1e-6
        by_z, by_cut = grading.slopes(z, cuts, g)
        assert by_z == pytest.approx((loss(z + e, cuts, g) - loss(z - e, cuts, g)) / (2 * e), abs=1e-4)
        for k in range(2):
            step = np.eye(2)[k] * e
            assert by_cut[k] == pytest.approx((loss(z, cuts + step, g) - loss(z, cuts - step, g)) / (2 * e), abs=1e-4)


def test_grades_of_rows_not_fitted(spark):
    """A quarter of the labels is kept from the fit: grades separate there, most good texts are selected and few others, and
    probabilities are near the shares."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = F.pmod(F.xxhash64(F.lit(77), "doc_id"), F.lit(4)) == 0
    got = grading.score(docs, grading.train(docs, labels.where(~out))).join(labels.where(out), "doc_id").collect()
    grade = lambda r: 0 if r.toxic else 2 if r.quality else 1
    by = [[r for r in got if grade(r) == g] for g in range(3)]
    means = [np.mean([r.expected_grade for r in own]) for own in by]
    assert means[0] < means[1] - 0.2 < means[2] - 0.6
    assert np.mean([r.selected for r in by[2]]) > 0.95 and np.mean([r.selected for r in by[0] + by[1]]) < 0.2
    assert abs(np.mean([r.p_good for r in got]) - len(by[2]) / len(got)) < 0.05
    assert all(r.p_good <= r.p_not_toxic for r in got)


# ---- 8


def similarity(a: collections.Counter, b: collections.Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def bag(text: str) -> collections.Counter:
    w = WORD.findall(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    sign = lambda b: near_dedup.bag_minhash(np.zeros(len(b), int), near_dedup.mixed(np.array(list(b), np.uint64)), np.array(list(b.values())), 1, 4096)[0]
    for most in (1, 3, 40):
        a, b = ({k: int(rng.integers(1, most + 1)) for k in range(x, x + 200)} for x in (0, 50))
        b |= {k: a[k] for k in range(60, 190)}
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
        assert (sign(a) == sign(b)).mean() == pytest.approx(true, abs=0.04)


def test_near_classes_lose_no_link(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(90)]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for k in range(200):  # copies at growing distance, so that links, near misses and chains all occur
        w = list(base)
        for _ in range(k % 7):
            w[rng.randrange(len(w))] = rng.choice(words)
        made.append(" ".join(w))
    passage = base[:60]
    made += [" ".join(passage + [rng.choice(words) for _ in range(rng.choice([2, 8, 20]))]) for _ in range(60)]
    made += ["a b", "a  b", "a c", "x " * 50, "x " * 48, "", " \n", made[70], made[70]]
    spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_dedup.op8_bag_minhash(spark, str(tmp_path)).collect()}
    bags = {k: bag(t) for k, t in enumerate(made) if t.strip()}
    root = {k: k for k in range(len(made))}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(bags, 2):
        if similarity(bags[a], bags[b]) >= 0.8:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {k: find(k) for k in range(len(made))}


def test_ids_that_repeat_merge_no_classes(spark, tmp_path):
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[4]), (7, texts[4] + " more"), (5, texts[2]), (None, texts[0]), (8, texts[5])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter((r.doc_id, r.class_id, r.head_key is None) for r in near_dedup.op8_bag_minhash(spark, str(tmp_path)).collect())
    assert got == {(None, None, False): 3, (5, 5, False): 3, (6, 6, True): 1, (7, 6, True): 1, (8, 8, True): 1}
    assert len({r.head_key for r in near_dedup.op8_bag_minhash(spark, str(tmp_path)).where("doc_id = 5 OR doc_id IS NULL").collect()}) == 4
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id or 0, r.text) for r in near_dedup.keep_one(spark, docs, "").collect()) == sorted((d or 0, t) for d, t in {*rows} - {(7, texts[4] + " more")})


# ---- 9


def test_decontamination_is_exact():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(80)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, f"{text(rng.randint(6, 25))}. {text(rng.randint(2, 8))}.") for k in range(40)] + [(100, "what is x"), (101, ""), (102, None)]
    index = decontaminate.Index(items)
    texts = [f"{text(rng.randint(0, 80))} {rng.choice(items[:41])[1]} {text(rng.randint(0, 80))}" for _ in range(60)] + [text(300) for _ in range(20)] + [""]
    got = index.search(texts)
    for t, own in zip(texts, got, strict=True):
        w, want = decontaminate.tokens(t), {}
        for p in range(len(w) // index.length + 1):
            part = w[p * index.length : (p + 2) * index.length]
            held = {index.vocabulary[x] for x in part if x in index.vocabulary}
            for k in range(len(index.ids)):
                score = sum(x for term, x in index.impacts[k].items() if term in held)
                shares = [len(g & decontaminate.grams(part, n)) / max(1, len(g)) for n, g in index.pieces[k]]
                if score >= decontaminate.SHARE and min(shares) >= (1.0 if len(index.words[k]) < decontaminate.SHORT else decontaminate.OVERLAP):
                    want[k] = max(want.get(k, (0, 0, 0)), (score, shares[0], shares[-1]))
        assert own == want
        assert all(k in {index.ids[i] for i in own} for k, x in items if x and x in t and len(decontaminate.tokens(x)) >= decontaminate.SHORT)


@pytest.mark.parametrize(("question", "answer"), [(9, 5), (11, 5), (20, 8), (40, 3), (30, 29), (52, 7)])
def test_altered_copies_are_found(question, answer):
    """Copies with words changed at different places: over nine tenths at one and two changes, whatever the answer's length."""
    rng = random.Random(17)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(question)) + ". " + " ".join(rng.choice(words) for _ in range(answer)) + ".") for k in range(200)]
    index = decontaminate.Index(items)

    def found(changes: int) -> float:
        hits = 0
        for k, t in items:
            w = t.split()
            for at in rng.sample(range(len(w)), changes):
                w[at] = "zz" + "." * w[at].endswith(".")
            hits += k in index.search([" ".join(rng.choice(words) for _ in range(30)) + " " + " ".join(w)])[0]
        return hits / len(items)

    assert found(0) == 1.0 and found(1) >= 0.9 and found(2) >= 0.9
    assert not any(index.search([" ".join(rng.choice(words) for _ in range(200)) for _ in range(50)]))


def test_the_answer_has_to_be_there():
    """A question without its answer, or with another one, is no copy; an inserted word doesn't save a copy from being found."""
    rng = random.Random(18)
    text = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(n))
    questions, answers = [text(20) for _ in range(40)], [text(4) for _ in range(40)]
    index = decontaminate.Index([(k, f"{q}. {a}.") for k, (q, a) in enumerate(zip(questions, answers, strict=True))])
    assert not any(index.search([f"{text(20)} {q}. {a}. {text(20)}" for q, a in zip(questions, answers[1:], strict=False)]))
    assert not any(index.search([f"{text(20)} {q}. {text(20)}" for q in questions]))
    for k, (q, a) in enumerate(zip(questions, answers, strict=True)):
        w = f"{q}. {a}".split()
        w.insert(10, "new")
        assert k in index.search([f"{text(9)} {' '.join(w)} {text(9)}"])[0]


def test_long_texts_in_chunks(monkeypatch):
    rng = random.Random(11)
    items = [(k, " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(30))) for k in range(50)]
    text = " ".join(t for _, t in items for _ in range(3))
    whole = decontaminate.Index(items).search([text])
    monkeypatch.setattr(decontaminate, "CELLS", 1)
    assert decontaminate.Index(items).search([text]) == whole and len(whole[0]) == 50


def test_benchmark_in_parts(spark, tiny, docs):
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
    whole = {(r.doc_id, r.item_id) for r in decontaminate.hits(docs, bench).collect()}
    parts = {(r.doc_id, r.item_id) for r in decontaminate.hits(docs, bench, most=15).collect()}
    there = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in d.text}
    assert there <= whole and there <= parts


# ---- 10


def within_one(x: list[str], y: list[str]) -> bool:
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
    x, y = sorted((x, y), key=len)
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def test_line_dedup_is_the_plain_search(spark, texts):
    rng = random.Random(3)
    few = ["a", "b", "c", "dd", "e"]
    rows = [(i if i != 7 else None, "\n".join(" ".join(rng.choice(few) for _ in range(rng.choice([0, 1, 3, 7, 8, 8, 9, 9, 10]))) for _ in range(rng.randint(0, 25)))) for i in range(80)]
    for i in range(150, 200):
        w = [f"w{k}" for k in range(12)]
        for _ in range(rng.randint(0, 2)):
            j, o = rng.randrange(len(w)), rng.random()
            w[j : j + (o < 0.7)] = [] if 0.4 <= o < 0.7 else [f"x{rng.randrange(99)}"]
        rows.append((i, " ".join(w) + "\nAnother line"))
    rows += [(900, None), (901, ""), (902, "\n\n")] + [(1000 + k, t) for k, t in texts.items()]
    place = lambda d, k: (d is None, d or 0, k)
    lines = [(place(d, k), s, WORD.findall(s)) for d, t in rows for k, s in enumerate((t or "").split("\n")) if WORD.search(s)]
    first = {}
    for at, s, _ in lines:
        first[s] = min(first.get(s, at), at)
    long = collections.defaultdict(list)
    for s, at in first.items():
        if len(w := WORD.findall(s)) >= line_dedup.MIN_WORDS:
            long[len(w)].append((at, s, w))
    near = {s for n in list(long) for at, s, w in long[n] if any(a < at and within_one(w, v) for m in (n - 1, n, n + 1) for a, _, v in long.get(m, []))}
    gone = {at for at, s, _ in lines if s in near or at > first[s]}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in line_dedup.dedup(df).collect():
        t = dict(rows)[r.doc_id]
        lost = [k for k in range(len((t or "").split("\n"))) if place(r.doc_id, k) in gone]
        assert r.n_gone == len(lost)
        assert r.text == ("\n".join(s for k, s in enumerate(t.split("\n")) if k not in lost) if lost else t)
