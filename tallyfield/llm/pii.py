"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds choose.

Generators (regular expressions on the JVM) propose overlapping spans of four kinds: the base patterns, and looser
ones (spelled-out mail addresses, dotted or slashed numbers, numbers after a telling word). Each candidate gets
numbers about its format (length, digits, groups, check digit) and its context (telling words before it, word
characters beside it). Gradient-boosted trees, fitted on seeded synthetic examples that `examples()` spells out,
turn these into a probability; per kind, the lowest threshold whose precision on held-out examples is at
least `PRECISION` is used. Base spans always stay; loose ones that overlap a chosen span go.

Trees become nested CASE expressions over arrays inside a row: no shuffle, no Python, one pass over the texts.

Defined cases: null text is empty; positions count code points; equal rows give equal results; texts are searched whole,
and matches are numbered in chunks, so that very many in one text cost little more than linear time; of added spans that
overlap the one that starts first stays, then the earlier kind; extra columns are ignored by the query and kept by
`redact`, and columns added get underscores before their names where these are taken; empty tables give empty results.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, text_of

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
CONTEXT = 32

#: Base patterns. Possessive where the next character can't belong to the repeated class, so matches are the plain
#: ones; the guard before a run only skips starts inside a run, which fail as its first start did.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = r"(?: ?[\[({] ?at ?[\])}] ?| at )", r"(?: ?[\[({] ?dot ?[\])}] ?| dot )"
LOOSE = {
    "email": rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+{_AT}[a-z0-9-]{{1,63}}+(?:(?:{_DOT}|\.)[a-z0-9-]{{1,63}}+){{1,4}}",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?: ?\[\.\] ?| ?\(\.\) ?|-)[0-9]{1,3}+(?:(?: ?\[\.\] ?| ?\(\.\) ?|-)[0-9]{1,3}+){2}(?![0-9-])",
    "card": r"(?<![0-9])[0-9]{4}+(?:[./_]|  )[0-9]{4,6}+(?:[./_]|  )[0-9]{4,5}+(?:(?:[./_]|  )[0-9]{1,4}+)?+(?![0-9])",
    "phone": r"(?<![0-9+.(-])(?:00[1-9][0-9]{0,2}+[ .-])?+\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?+(?![0-9.-])",
}
#: Words that announce each kind.
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|address|reach)",
    "ip": r"(?i)(?:\bip\b|host|server|addr|login from)",
    "card": r"(?i)(?:card|visa|master|amex|credit|payment|pan\b)",
    "phone": r"(?i)(?:phone|tel\b|tel[.:]|call|mobile|fax|cell)",
}
FEATURES = ("length", "digits", "groups", "separators", "check", "part_max", "lead", "cue", "glued", "spelled")


#: Matches are numbered in chunks of this many, so that a text with very many costs little more than linear time.
CHUNK = 256
_SPAN = "array<struct<at:int,of:string,left:string,next:string>>"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def pieces(text: Column, pattern: str) -> Column:
    """All matches with the gaps around them. regexp_extract_all gives the matches, split at them gives the gaps."""
    gaps = F.transform(
        F.split(text, pattern, -1),
        lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(CONTEXT)).alias("left"), F.left(g, F.lit(1)).alias("first")),
    )
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("g"))


def placed(found: Column) -> Column:
    """Each match of a stored column made by pieces(), with the length and the end of the gap before it."""
    return F.transform(
        found["m"],
        lambda m, i: F.struct(
            m.alias("of"),
            F.get(found["g"], i)["n"].alias("gap"),
            F.get(found["g"], i)["left"].alias("left"),
            F.get(found["g"], i + 1)["first"].alias("next"),
        ),
    )


def summed(rows: Column) -> Column:
    """Positions by running sums, in a stored column made by placed()."""

    def step(a: Column, x: Column) -> Column:
        at = a["pos"] + x["gap"]
        new = F.struct(at.alias("at"), x["of"].alias("of"), x["left"].alias("left"), x["next"].alias("next"))
        return F.struct((at + F.length(x["of"])).alias("pos"), F.concat(a["out"], F.array(new)).alias("out"))

    def join(a: Column, c: Column) -> Column:
        moved = F.transform(c["out"], lambda s: F.struct((s["at"] + a["pos"]).alias("at"), s["of"].alias("of"), s["left"].alias("left"), s["next"].alias("next")))
        return F.struct((a["pos"] + c["pos"]).alias("pos"), F.concat(a["out"], moved).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out"))
    chunks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0)), F.lit(CHUNK)), lambda c: F.aggregate(F.slice(rows, c + 1, F.lit(CHUNK)), start, step)
    )
    return F.aggregate(chunks, start, join)["out"]


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Does the string of digits pass the check-digit rule?"""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda a, i: a
        + F.when((F.length(d) - i) % 2 == 0, F.substr(d, i, F.lit(1)).cast("int")).otherwise(
            F.lit(2) * F.substr(d, i, F.lit(1)).cast("int") - F.when(F.substr(d, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def is_base(kind: str, of: Column) -> Column:
    """Does a match of the base pattern pass the kind's test?"""
    d = digits_of(of)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return of.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    return F.length(d).between(10, 15)


def features(kind: str, of: Column, left: Column, after: Column, base: bool) -> Column:
    """Numbers about a candidate's form and context, in the order of FEATURES."""
    d = digits_of(of)
    parts = F.split(of, "[^0-9]+")
    return F.struct(
        F.lit(KINDS.index(kind)).cast("double").alias("kind"),
        F.length(of).cast("double").alias("length"),
        F.length(d).cast("double").alias("digits"),
        F.size(F.filter(parts, lambda x: x != "")).cast("double").alias("groups"),
        F.length(F.regexp_replace(of, "[0-9A-Za-z]", "")).cast("double").alias("separators"),
        F.when(F.length(d).between(13, 19), luhn(d).cast("double")).otherwise(0.0).alias("check"),
        F.coalesce(F.array_max(F.transform(F.filter(parts, lambda x: F.length(x).between(1, 9)), lambda x: x.cast("double"))), F.lit(0.0)).alias("part_max"),
        F.when(of.startswith("+") | of.startswith("00"), 1.0).otherwise(0.0).alias("lead"),
        F.when(left.rlike(CUES[kind]), 1.0).otherwise(0.0).alias("cue"),
        F.when(left.rlike(r"[\p{L}\p{N}]\z") | F.coalesce(after, F.lit("")).rlike(r"^[\p{L}\p{N}]"), 1.0).otherwise(0.0).alias("glued"),
        F.when(F.lower(of).rlike(r"\bdot\b"), 1.0).otherwise(0.0).alias("spelled"),
        F.lit(float(base)).alias("base"),
    )


COLUMNS = ("kind", *FEATURES, "base")


def candidate(kind: str, base: bool) -> Callable[[Column], Column]:
    return lambda s: F.struct(
        s["at"].alias("at"),
        (s["at"] + F.length(s["of"])).alias("end"),
        F.lit(KINDS.index(kind)).alias("kind"),
        (is_base(kind, s["of"]) if base else F.lit(False)).alias("ok"),
        features(kind, s["of"], s["left"], s["next"], base).alias("f"),
    )


def with_candidates(df: DataFrame, text: str, out: str) -> DataFrame:
    """df plus `out`: all candidates of the text column as structs (at, end, kind, ok, f)."""
    names = fresh(df, *[f"_p{x}{k}" for x in "abc" for k in range(8)])
    made = []
    for k, (kind, base) in enumerate((kind, base) for kind in KINDS for base in (True, False)):
        a, b, c = names[f"_pa{k}"], names[f"_pb{k}"], names[f"_pc{k}"]
        may = {"email": F.contains(F.col(text), F.lit("@")), "phone": F.contains(F.col(text), F.lit("+"))}.get(kind) if base else None
        if may is None:
            may = F.lower(text).rlike(r"\bat\b") if kind == "email" else F.col(text).rlike("[0-9]")
        pattern = (BASE if base else LOOSE)[kind]
        df = df.withColumn(a, pieces(F.when(may, F.col(text)).otherwise(F.lit("")), pattern))
        df = df.withColumn(b, placed(F.col(a))).withColumn(c, summed(F.col(b)))
        made.append(F.transform(c, candidate(kind, base)))
    return df.withColumn(out, F.concat(*made)).drop(*names.values())


# ---- training: synthetic examples, boosted trees, thresholds


def examples(n: int = 1500, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with the spans that are personal data. Every kind comes in plain, loosely written and sham forms."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "re", "ou", "ti", "st", "la", "de"]) for _ in range(rng.randint(1, 4)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(good: bool) -> str:
        body = rng.choice("3456") + num(rng.choice([13, 14, 14, 14]))
        total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(body)))
        return body + str((-total + (0 if good else rng.randint(1, 9))) % 10)

    def grouped(d: str, sep: str) -> str:
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def octets(top: int) -> list[str]:
        return [str(rng.randint(1, top)) for _ in range(4)]

    def one(kind: int) -> tuple[str, str, bool]:
        """(what stands before, the candidate, is it personal data)"""
        form = rng.random()
        if kind == 0:
            name, host, tld = word() + rng.choice(["", ".", "_"]) + word(), word(), rng.choice(["com", "org", "net", "de", "fr"])
            if form < 0.4:
                at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", ".")])
                return rng.choice([word(), "email:", "write to"]) + " ", f"{name}{at}{host}{dot}{tld}", True
            if form < 0.7:
                return word() + " ", f"{word()} at {word()}.{word()}", False
            return word() + " ", f"{name}@{host}.{tld}", True
        if kind == 1:
            if form < 0.35:
                return rng.choice([word(), "host", "ip", "server"]) + " ", rng.choice(["[.]", "(.)", " [.] "]).join(octets(255)), True
            if form < 0.7:
                return word() + " ", rng.choice([".".join(octets(999)[:3] + [str(rng.randint(256, 999))]), "-".join(octets(99))]), False
            return word() + " ", ".".join(octets(255)), True
        if kind == 2:
            if form < 0.3:
                return rng.choice(["card", "visa", "credit card", "payment"]) + " ", grouped(card(True), rng.choice([".", "/", "_", "  "])), True
            if form < 0.5:
                return word() + " ", grouped(card(False), rng.choice([".", "/", " ", "-", ""])), False
            if form < 0.65:
                return word() + " ", num(rng.choice([6, 8, 10, 12])) + rng.choice([" ", "-"]) + num(rng.choice([2, 4])), False
            return word() + " ", grouped(card(True), rng.choice([" ", "-", ""])), True
        if form < 0.3:
            sep = rng.choice(["-", " ", "."])
            return rng.choice(["phone", "call", "tel.", "mobile", "fax"]) + rng.choice([" ", ": "]), rng.choice([f"({num(3)}) {num(3)}-{num(4)}", sep.join([num(3), num(3), num(4)]), sep.join(["00" + rng.choice("123") + num(1), num(3), num(3), num(4)])]), True
        if form < 0.7:
            return word() + " ", rng.choice(["-".join([num(3), num(3), num(4)]), " ".join([num(4), num(4), num(4)]), "+" + num(4) + " " + num(3), ".".join([num(2), num(3), num(3)])]), False
        return word() + " ", f"+{rng.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", True

    out = []
    for _ in range(n):
        text, truth = " ".join(word() for _ in range(rng.randint(2, 8))) + " ", []
        for _ in range(rng.randint(1, 3)):
            before, what, good = one(kind := rng.randrange(len(KINDS)))
            text += before
            if good:
                truth.append((len(text), len(text) + len(what), kind))
            text += what + " " + " ".join(word() for _ in range(rng.randint(5, 9))) + rng.choice([". ", " "])
        out.append((text, truth))
    return out


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple | float:
    """A regression tree on gradients: (feature, cut, below, above) or a leaf's value."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 20:
        return leaf
    best, where = 1e-3, None
    score = g.sum() ** 2 / (h.sum() + 1.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, gs, hs = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.nonzero(v[1:] > v[:-1])[0]
        if len(cut):
            gain = gs[cut] ** 2 / (hs[cut] + 1.0) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1.0) - score
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, where = float(gain[k]), (j, float(v[cut[k]] + v[cut[k] + 1]) / 2)
    if where is None:
        return leaf
    low = x[:, where[0]] <= where[1]
    return (*where, grow(x[low], g[low], h[low], depth - 1), grow(x[~low], g[~low], h[~low], depth - 1))


def predict(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = predict(tree[2], x[low]), predict(tree[3], x[~low])
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3) -> list:
    """Logistic gradient boosting; the trees' values are scaled by rate."""
    z, trees = np.zeros(len(y)), []
    scaled = lambda t: t * rate if isinstance(t, float) else (t[0], t[1], scaled(t[2]), scaled(t[3]))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        trees.append(scaled(grow(x, p - y, p * (1 - p), depth)))
        z += predict(trees[-1], x)
    return trees


def tree_sql(tree: tuple | float, row: str) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    return f"CASE WHEN {row}.{COLUMNS[tree[0]]} <= {tree[1]!r}D THEN {tree_sql(tree[2], row)} ELSE {tree_sql(tree[3], row)} END"


@lru_cache(maxsize=4)
def fitted(spark: SparkSession, n: int = 1500, seed: int = 5) -> tuple[list, tuple[float, ...]]:
    """(trees, least log-odds per kind). Candidates of the examples come from the same plan as those of real texts."""
    made = examples(n, seed)
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "i int, text string")
    found = with_candidates(frame, "text", "c").select("i", F.explode("c").alias("c"))
    rows = found.select("i", F.col("c.at").alias("at"), F.col("c.end").alias("end"), F.col("c.ok").alias("ok"), F.col("c.f").alias("f")).orderBy("i", "at", "end").collect()
    x = np.array([[float(v) for v in r.f] for r in rows])
    right = lambda r, a, b, k: r.f.kind == k and a <= r["at"] + 1 and r["end"] - 1 <= b and r["end"] - r["at"] >= 0.8 * (b - a)
    y = np.array([float(any(right(r, *span) for span in made[r.i][1])) for r in rows])
    held = np.array([r.i % 2 == 1 for r in rows])
    base_ok = np.array([r.ok for r in rows])
    trees = boost(x[~held], y[~held])
    z = sum(predict(t, x[held]) for t in trees)
    least = []
    for k in range(len(KINDS)):
        own = (x[held][:, 0] == k) & ~base_ok[held]  # base spans stay whatever their score
        zs, ys = z[own], y[held][own]
        order = np.argsort(-zs, kind="stable")
        precision = np.cumsum(ys[order]) / np.arange(1, len(order) + 1)
        last_of_tie = np.append(np.diff(zs[order]) != 0, True)
        good = np.nonzero((precision >= PRECISION) & last_of_tie)[0]
        least.append(float(zs[order][good[-1]]) if len(good) else math.inf)
    return trees, tuple(least)


def with_spans(df: DataFrame, text: str = "text", base: str = "pii_base", spans: str = "pii_spans") -> DataFrame:
    """df plus base and all spans, under names that have to be free: arrays of (at, kind, end), sorted."""
    trees, least = fitted(df.sparkSession)
    t, c, z = fresh(df, "_pt", "_pcand", "_pz").values()
    df = with_candidates(df.withColumn(t, text_of(text)), t, c)
    score = " + ".join(f"({tree_sql(x, 'c.f')})" for x in trees)
    bar = "CASE c.kind " + " ".join(f"WHEN {k} THEN {('1e300' if math.isinf(v) else repr(v - 1e-9))}D" for k, v in enumerate(least)) + " END"
    df = df.withColumn(base, F.expr(f"array_sort(transform(filter({c}, c -> c.ok), c -> struct(c.at, c.kind, c.end)))"))
    df = df.withColumn(z, F.expr(f"array_sort(transform(filter({c}, c -> NOT c.ok AND {score} >= {bar}), c -> struct(c.at, c.kind, c.end)))"))
    free = f"filter({z}, s -> NOT exists({base}, b -> b.at < s.end AND s.at < b.end))"
    walk = (
        f"aggregate({free}, struct(0 AS last, cast(array() AS array<struct<at:int,kind:int,end:int>>) AS out),"
        " (a, s) -> CASE WHEN s.at >= a.last THEN struct(s.end AS last, concat(a.out, array(s)) AS out) ELSE a END).out"
    )
    return df.withColumn(spans, F.expr(f"array_sort(concat({base}, {walk}))")).drop(t, c, z)


def shown(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', {names}[s.kind], s.at, s.end)), ',')")


def redact(df: DataFrame, text: str = "text", out: str = "redacted") -> DataFrame:
    """df plus base and all spans and the text with each span replaced by its kind in angle brackets; spans inside another go
    with it."""
    base, spans, out = fresh(df, "pii_base", "pii_spans", out).values()
    df = with_spans(df, text, base, spans)
    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    walk = (
        f"aggregate({spans}, struct(0 AS last, cast(array() AS array<string>) AS out), (a, s) -> CASE WHEN s.at >= a.last THEN"
        f" struct(s.end AS last, concat(a.out, array(substring({text}, a.last + 1, s.at - a.last), {names}[s.kind])) AS out) ELSE a END)"
    )
    return df.withColumn(out, F.expr(f"transform(array({walk}), w -> concat(array_join(w.out, ''), substring({text}, w.last + 1)))[0]"))


def op1_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.expr(f"cast(size(filter(pii_base, s -> s.kind = {k})) AS bigint)")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(shown("pii_base"), 256).alias("base_sha256"),
        shown("pii_spans").alias("spans"),
        F.expr("cast(size(pii_spans) - size(pii_base) AS bigint)").alias("n_added"),
    )


QUERIES = {"op1_boosted_pii": op1_boosted_pii}
ORACLE: dict[str, str] = {}
