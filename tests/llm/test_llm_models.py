"""Quality and toxicity: held-out accuracy on invented text, segments against brute force, edge cases."""

import math
import random
import time
import zlib

import numpy as np
import pytest

from gridcut.llm import logistic
from gridcut.llm.labelled import labelled_sample
from gridcut.llm.quality import CompressionModel, fit_quality, score_quality
from gridcut.llm.toxicity import ToxicModel, fit_toxicity, score_toxicity

LABELS = "doc_id long, quality int, toxic int, source string"


def corpus(n=400):
    rnd = random.Random(12)
    syllables = "ka lo mi ter sun ve ra ni sto pel".split()
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        good, toxic = i % 3 != 0, i % 4 == 0
        words = [word() for _ in range(rnd.randint(20, 200))]
        if toxic:
            at = rnd.randrange(len(words))
            words[at:at] = rnd.choices(["nasty", "vile", "rotten", "foul"], k=rnd.randint(2, 6))
        text = " ".join(words) if good else " | ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, "s"))
        labels.append((i, int(good), int(toxic), "s"))
    odd = [(n, None, "s"), (n + 1, "", "s"), (n + 2, "word " * 60000, "s"), (None, docs[1][1], "s"), (7, docs[7][1], "s")]
    return docs + odd, labels + [(3, 0, None, "s"), (5, 1, 1, "s"), (5, 0, 0, "s"), (None, 1, 1, "s"), (n, 1, 0, "s")]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, LABELS), labels


def held_out(i, folds, rest):
    return zlib.crc32(str(i).encode()) % folds == rest


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_documents_are_told_apart(tables, kind):
    docs, labels, known = tables
    if kind == "quality":
        got = score_quality(docs, fit_quality(docs, labels))
        folds, rest = 4, 2
        truth = {i: q for i, q, _, _ in known[:400]}
    else:
        got = score_toxicity(docs, fit_toxicity(docs, labels))
        folds, rest = 5, 0
        truth = {i: t for i, _, t, _ in known[:400]}
    rows = got.collect()
    assert len(rows) == 405 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    own = {r.doc_id: r for r in rows}
    tested = [i for i in truth if held_out(i, folds, rest) and i != 5]
    assert np.mean([own[i].predicted == truth[i] for i in tested]) > 0.95
    twice = [(r.score, r.predicted) for r in rows if r.doc_id == 7]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_without_labels_every_text_scores_one_half(spark, tables):
    docs, labels, _ = tables
    few = docs.limit(5)
    for none in (labels.limit(0), labels.select("doc_id", *[f"cast(null as int) {c}" for c in ()], labels.quality * 0 + 5, labels.toxic * 0 + 5)):
        none = none.toDF(*["doc_id", "quality", "toxic", "source"][: len(none.columns)])
        assert {r.score for r in score_quality(few, fit_quality(docs, none)).collect()} == {0.5}
        assert {r.score for r in score_toxicity(few, fit_toxicity(docs, none)).collect()} == {0.5}
    assert score_quality(docs.limit(0), CompressionModel(b"good text", b"bad text", (0.0,) * 5)).count() == 0
    assert score_toxicity(docs.limit(0), ToxicModel({}, weights=(0.0,) * 4)).count() == 0


def test_the_sample_is_bounded_and_leaves_the_fold_out(tables):
    docs, labels, _ = tables
    got = labelled_sample(docs, labels, "quality", 4, 2, per_class=30).collect()
    counts = {k: sum(r.label == k for r in got) for k in (0, 1)}
    assert 10 < counts[0] < 60 and 10 < counts[1] < 60
    assert not any(held_out(r._1 if hasattr(r, "_1") else r["_id"], 4, 2) for r in got)
    assert not {r["_id"] for r in got} & {3, 5, None}


def best_segments(values):
    """All maximal-scoring segments by definition: the best one, then what lies left and right of it."""

    def inside(a, b):
        best, at = 0.0, None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += values[j]
                if total > best + 1e-9 or (at and abs(total - best) <= 1e-9 and (j + 1 - i) < at[1] - at[0]):
                    best, at = total, (i, j + 1)
        return [] if at is None else [*inside(a, at[0]), (*at, best), *inside(at[1], b)]

    return inside(0, len(values))


def test_segments_equal_brute_force():
    rnd = random.Random(3)
    model = ToxicModel({b"a": 1.37, b"b": 0.71, b"c": -0.93})
    for _ in range(150):
        words = rnd.choices([b"a", b"b", b"c", b"x"], weights=[1, 1, 2, 5], k=rnd.randint(0, 25))
        values = [model.scores.get(w, -0.25) for w in words]
        want = best_segments(values)
        got = model.segments(words)
        assert [x[:2] for x in got] == [x[:2] for x in want], words
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


@pytest.mark.parametrize("kinds", ["axxx", "abcx", "a", "acccccccca"])
def test_segments_of_very_long_texts_take_linear_time(kinds):
    rnd = random.Random(6)
    model = ToxicModel({b"a": 1.37, b"b": 0.71, b"c": -0.93})
    words = [k.encode() for k in rnd.choices(kinds, k=400_000)]
    begun = time.process_time()
    got = model.segments(words)
    assert time.process_time() - begun < 2 and all(s > 0 for _, _, s in got)
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_logistic_finds_the_weights():
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((20000, 2))
    y = (rnd.uniform(size=20000) < 1 / (1 + np.exp(-(0.5 + x @ [2.0, -1.0])))).astype(float)
    assert np.allclose(logistic.fit(x, y), [0.5, 2.0, -1.0], atol=0.1)
    one = logistic.chance(np.zeros((1, 2)), logistic.fit(np.zeros((9, 2)), np.ones(9)))[0]
    assert 0.9 < one < 1 and math.isclose(logistic.chance(np.zeros((1, 2)), logistic.fit(np.zeros((0, 2)), np.zeros(0)))[0], 0.5)
