"""Lexical search, source mixing and whitening against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from plain import words
from pyspark.sql import functions as F

import gridcut.llm.mixing as mixing
import gridcut.llm.search as search
import gridcut.llm.whitening as whitening
from gridcut.llm.mixing import expanded, mix_sources, quality_weights, source_targets
from gridcut.llm.search import lexical_search
from gridcut.llm.whitening import above, leading_pairs, whiten

# --- search -----------------------------------------------------------------------------------


def ranked(docs, items, top):
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for name, text in set(items):
        asked = Counter(words(text))
        found = []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * len(bags) // total
            score = 0
            for w, k in asked.items():
                if w in b:
                    weight = math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[w] + 1)))
                    score += k * weight * (1_000_000_000 * b[w] // (1000 * b[w] + 12 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(found)[:top], 1):
            out.append((name, rank, d, -score))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def corpus():
    rnd = random.Random(4)
    terms = [f"w{k}" for k in range(40)] + ["é", "Ünder", "7"]
    docs = [(k, " ".join(rnd.choices(terms, k=rnd.randint(1, 30)))) for k in range(300)]
    docs += [(1000 - k, "w1 W2, w2! other") for k in range(60)]  # one bag, ids falling
    docs += [(2000 + k, "w2 w1 another w2") for k in range(40)]  # the same bag of item words and length
    docs += [(3000, None), (3001, ""), (3002, ".,;"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (5, "w1"), (5, "w1")]
    docs.append((4000, "w3 " * 30_000 + "w9"))
    rnd.shuffle(docs)
    items = [(k, " ".join(rnd.choices(terms[:30] + ["nowhere"], k=rnd.randint(1, 12)))) for k in range(25)]
    items += [(100, "w1 w2 w2"), (100, "w1 w2 w2"), (101, ""), (102, None), (None, "W1 w9 É")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_plain_ranking(spark, monkeypatch, small):
    if small:  # parts of items, thinning, and joins without broadcast must change nothing
        for name, value in {"PART_BYTES": 200, "SCORES_AT_ONCE": 50, "HELD": 60, "BROADCAST_BAGS": 0}.items():
            monkeypatch.setattr(search, name, value)
    docs, items = corpus()
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, bag string, item_id int")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, score string")
    got = lexical_search(d.repartition(5), i, top=20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(ranked(docs, items, 20), key=key)


def test_search_sums_beyond_doubles_and_empty_tables(spark, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(ranked(docs, items, 3), key=key)
    monkeypatch.setattr(search, "EXACT", 0.0)
    assert sorted(map(tuple, lexical_search(d, i, top=3).collect()), key=key) == expected
    assert lexical_search(d.limit(0), i).count() == 0
    assert lexical_search(d, i.limit(0)).count() == 0


# --- mixing -----------------------------------------------------------------------------------


def targets(sizes, shares=(5, 2, 1), most=3):
    """Reshare round by round, as the rule says it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    share = {s: shares[k % len(shares)] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in stopped]
        rest = total - sum(stopped.values())
        got = {s: rest * share[s] / sum(share[x] for x in left) for s in left}
        over = {s: most * sizes[s] for s in left if got[s] > most * sizes[s]}
        if not over:
            return {**stopped, **got}
        stopped |= over


def mix_docs():
    rnd = random.Random(9)
    docs = []
    for source, many in {"a": 300, "b": 40, "é": 25, "Z": 10, "": 8, None: 12, "tiny": 1}.items():
        docs += [(source, " ".join(["w"] * rnd.randint(0, 40))) for _ in range(many)]
    docs = [(k, t, s, rnd.choice([None, 0.5, 1.0, 2.0, -1.0, float("nan")]), k) for k, (s, t) in enumerate(docs)]
    docs += [(None, "one two", "a", 1.0, 0)] * 3 + [(7, "one two", "b", 1.0, 0)] * 2 + [(9000, None, "c", None, 0)]
    return docs + [(9001, "x\x0by z \t\r\n" * 20_000, "a", None, 0)]


SCHEMA = "doc_id long, text string, source string, weight double, taken long"


@pytest.mark.parametrize("rows_per_range,bytes_", [(20_000, 1 << 20), (7, 0)])
def test_mix_reaches_targets_in_key_order(spark, monkeypatch, rows_per_range, bytes_):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", rows_per_range)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", bytes_)
    docs = mix_docs()
    df = spark.createDataFrame(docs, SCHEMA)
    got = mix_sources(df.repartition(5), weight="weight", keep=["taken", "text"])
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "epochs", "taken", "text"]
    rows = got.collect()
    size = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0d]+", t or "") if w])
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((d or -1, size(t)) for d, t, *_ in docs)
    sums = Counter()
    for _, t, s, *_ in docs:
        sums[s] += size(t)
    wanted = targets(sums)
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(wanted[r.source]) and r.source_size == sums[r.source]
        assert 0 <= r.taken <= 3 * r.size and r.epochs * r.size <= r.taken <= (r.epochs + 1) * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == math.floor(wanted[s] + 1e-9) for s in sums)
    # within a source those with the smaller keys are taken, and one at most in part
    keyed = df.withColumn("size", mixing.word_count(F.col("text")))
    w = F.when((F.col("weight") > 0) & ~F.isnan("weight"), F.col("weight")).otherwise(1.0)
    keyed = keyed.withColumn("key", -F.log(mixing.uniform("mix", *map(F.col, ("doc_id", "source", "size")))) / w)
    order = {(r.doc_id, r.source, r["size"]): r.key for r in keyed.where("doc_id <> 7").collect()}
    for s in sums:
        more = [(order[r.doc_id, s, r.size], r.taken - r.epochs * r.size, r.size) for r in rows if r.source == s and r.doc_id not in (None, 7) and r.size]
        full = [k for k, m, n in more if m == n]
        none = [k for k, m, n in more if m == 0]
        assert sum(0 < m < n for _, m, n in more) <= 1 and (not full or not none or max(full) < min(none))
    again = mix_sources(df.repartition(3), weight="weight").drop("x")
    assert sorted(map(str, again.collect())) == sorted(map(str, got.drop("text").collect()))
    passes = expanded(got).groupBy("doc_id", "source", "size", "taken").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    assert passes.where("doc_id is not null and doc_id <> 7 and w <> taken").count() == 0


def test_targets_of_uneven_sources_and_null_names(spark):
    sizes = {f"s{k:02d}": 3**k for k in range(14)} | {None: 5, "big": 4_000_000, "none": 0}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, other int")
    got = {r.source: r.target for r in source_targets(df).collect()}
    wanted = targets(sizes)
    assert got.keys() == wanted.keys() and all(got[s] == pytest.approx(wanted[s]) for s in got)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_better_documents_come_first_and_empty_tables(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 6 < 2, 1).when(F.col("id") % 6 < 4, 0).alias("quality"))
    weighed = quality_weights(docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))), labels.union(labels))
    assert weighed.count() == 4003 and {r[0] for r in weighed.select("_weight").distinct().collect()} == {0.5, 1.0, 2.0}
    mixed = mix_sources(weighed, weight="_weight", keep=["_weight"]).where("source = '1'")
    share = {r[0]: r[1] for r in mixed.groupBy("_weight").agg(F.avg(F.col("taken") / F.col("size"))).collect()}
    assert share[2.0] > share[1.0] + 0.1 > share[0.5] + 0.2
    assert mix_sources(docs.limit(0)).count() == 0
    assert mix_sources(docs.withColumn("text", F.lit(None).cast("string"))).where("taken <> 0 or target <> 0").count() == 0


# --- whitening --------------------------------------------------------------------------------


def matrices():
    rnd = np.random.default_rng(8)
    for n in (1, 2, 3, 17, 60):
        a = rnd.standard_normal((n, n))
        yield a + a.T
        yield a @ a.T
    q = np.linalg.qr(rnd.standard_normal((12, 12)))[0]
    yield q @ np.diag([5, 5, 5, 4, 4, 3, 2, 1, 0, 0, 0, -1.0]) @ q.T  # equal ones
    yield q @ np.diag([1 + 1e-9, 1, 1 - 1e-9, *[1e-3] * 9]) @ q.T  # close ones
    yield q @ np.diag([1e12, 1, 1e-6, *[0.0] * 9]) @ q.T
    yield np.diag([3.0, 2.0, 1.0])
    yield np.array([[0.0, 1.0], [1.0, 0.0]])
    yield np.zeros((4, 4))


@pytest.mark.parametrize("a", list(matrices()), ids=lambda a: str(len(a)))
def test_spectrum_slicing_equals_full_decomposition(a):
    true = np.linalg.eigvalsh(a)[::-1]
    size = np.abs(a).max()
    for shift in (*(true[:-1] + true[1:]) / 2, true[0] + 1, true[-1] - 1):
        if np.abs(true - shift).min() > 1e-10 * (size + 1):
            assert above(a, shift) == (true > shift).sum()
    values, vectors = leading_pairs(a, 8)
    k = min(8, len(a))
    assert np.allclose(values, true[:k], rtol=1e-12, atol=1e-11 * (size + 1e-300))
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-6)
    assert np.abs(a @ vectors - vectors * values).max(initial=0) <= 1e-9 * (size + 1e-300) * len(a)


@pytest.mark.parametrize("huge", [False, True])
def test_whitening_equals_full_decomposition(spark, huge):
    rnd = np.random.default_rng(5)
    data = rnd.standard_normal((400, 12)) @ np.diag(np.linspace(3, 0.2, 12)) * (1e5 if huge else 1) + 0.3
    rows = [(k, v, "x", 0) for k, v in enumerate(data.tolist())]
    rows += [(0, data[0].tolist(), "x", 0), (None, data[1].tolist(), "x", 0)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [None] + [1.0] * 11, [nan] + [1.0] * 11, [inf] + [1.0] * 11, [1.0] * 5, [1e300] * 12]
    rows += [(5000 + k, v, "x", 0) for k, v in enumerate(odd)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, w string, component int")
    got = whiten(df.repartition(5)).collect()
    used = [(i, v) for i, v, *_ in rows if v and len(v) == 12 and all(x is not None and abs(x) < 1e200 for x in v)]
    assert len(got) == 8 * len(used) == 8 * 402
    x = np.floor(1024 * np.array([v for _, v in used])).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:8]
    w = y @ vectors[:, order] / np.sqrt(values[order])
    wide = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    whole = {}
    for r in got:
        whole.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r)
    signs = {}
    for (name, _), deviation, row in zip(used, wide, w, strict=True):
        for k in range(8):
            r = whole[name, deviation][k + 1][0]
            sign = signs.setdefault(k, 1 if r.whitened * row[k] > 0 else -1)
            assert r.n == n and r.whitened == pytest.approx(sign * row[k], abs=1e-7)
            assert r.explained == pytest.approx(values[order][k] / values.sum()) and r.identity_error < 1e-9
    if huge:
        assert max(wide) > 1 << 63


def test_whitening_of_flat_short_and_no_vectors(spark, monkeypatch):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, schema)).count() == 0  # no spread at all
    line = whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(20)], schema))
    assert {r.component for r in line.collect()} == {1} and line.first().explained == pytest.approx(1)
    monkeypatch.setattr(whitening, "MOST_DIMENSIONS", 1)
    with pytest.raises(ValueError):
        whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema))
