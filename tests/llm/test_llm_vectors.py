"""Vector near-dedup, components and runs against brute force."""

import math
import random

import numpy as np
from plain import cosine, groups

from gridcut.llm.components import components
from gridcut.llm.embed_dedup import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def vectors():
    rnd = np.random.default_rng(3)
    out = []
    for k in range(40):
        centre = rnd.standard_normal(32)
        for _ in range(1 + k % 5):
            out.append(((centre + 0.1 * rnd.standard_normal(32)) * rnd.uniform(0.1, 9)).astype(np.float32).tolist())
    return out


def expected(rows):
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    link = [[False] * len(rows) for _ in rows]
    for i, (_, v, a, _) in enumerate(rows):
        for j, (_, w, b, _) in enumerate(rows[:i]):
            if a is not None and a == b and fine(v) and fine(w) and len(v) == len(w) and cosine(v, w) >= 0.98:
                link[i][j] = link[j][i] = True
    return [sum(x) for x in link], groups(len(rows), lambda i, j: link[i][j])


def test_vectors_equal_brute_force(spark):
    rows = [(k, v, k % 2, "c") for k, v in enumerate(vectors())]
    rows += [(1000 + k, rows[0][1], rows[0][2], "c") for k in range(30)]
    odd = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31]
    rows += [(2000 + k, v, 0, "c") for k, v in enumerate(odd * 2)]
    rows += [(3000, rows[0][1], None, "c"), (3001, rows[0][1], None, "c"), (3002, rows[0][1][:16], 0, "c")]
    random.Random(1).shuffle(rows)
    counts, reach = expected(rows)
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows) and any(c > 20 for c in counts)
    least = {}
    for k, r in enumerate(reach):
        least[r] = min(least.get(r, 1 << 60), rows[k][0])
    for k, row in enumerate(rows):
        r = got[row[0]]
        assert (r.n_links, r.component_id, r.kept) == (counts[k], least[reach[k]], row[0] == least[reach[k]]), row[0]


def test_large_runs_are_split_and_count_once(spark, monkeypatch):
    import gridcut.llm.embed_dedup as module

    rows = [(k, v, 0, "c") for k, v in enumerate(vectors())]
    rows += [(500 + k, (np.array(rows[0][1]) * (1 + k / 7)).tolist(), 0, "c") for k in range(60)]
    counts, _ = expected(rows)
    original = module.shared_keys
    monkeypatch.setattr(module, "shared_keys", lambda *a: original(*a, largest=8))
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[r[0]] for r in rows] == counts


def test_recall_at_the_threshold(spark):
    rnd = np.random.default_rng(8)
    rows = []
    for k in range(300):
        a, b = rnd.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        c = 0.9801
        rows += [(2 * k, a.tolist(), 1, "c"), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b).tolist(), 1, "c")]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).where("n_links > 0").count()
    assert got >= 0.97 * len(rows)


def test_ties_nothing_and_null_ids(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, [1.0, 0.0], 1, "c"), (5, [1.0, 0.0], 1, "c"), (None, [1.0, 0.0], 1, "c"), (None, [0.0, 1.0], 1, "c")]
    got = sorted(map(str, near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert sum("n_links=2, component_id=5" in x for x in got) == 3
    assert sum("n_links=0, component_id=None, kept=True" in x for x in got) == 1


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(6)
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(7000, 7000), (5, 5)]
    links += [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)]
    rnd.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = {r.node: r.root for r in components(df).collect()}
    nodes = sorted({x for p in links for x in p})
    at = {x: k for k, x in enumerate(nodes)}
    pairs = {(at[min(p)], at[max(p)]) for p in links}
    want = groups(len(nodes), lambda i, j: (i, j) in pairs)
    assert [got.get(x, x) for x in nodes] == [nodes[r] for r in want]
