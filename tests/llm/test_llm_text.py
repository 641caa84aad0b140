"""Line dedup, benchmark decontamination and SimHash against plain Python."""

import random

import pytest
from plain import fingerprint, groups, hits, kept_lines

from gridcut.llm.decontaminate import ItemAutomaton, match_items, remove_spans, with_verdict
from gridcut.llm.line_dedup import drop_frequent_lines
from gridcut.llm.simhash import PIVOTS, keep_one, linking_pairs, near_duplicates, pivots


def rows_of(df, *cols):
    return sorted(df.select(*cols).collect(), key=lambda r: [(v is None, v) for v in r])


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["Ähre", "É", "x-y", "日本"]
    out = [None, "", " \t\n", "One", "one", "ONE\n\n one \n", "same line\nother"]
    for i in range(60):
        lines = [" ".join(rnd.choices(vocab, k=rnd.randint(1, 9))) for _ in range(rnd.randint(1, 6))]
        if i % 3:
            lines.insert(rnd.randrange(len(lines) + 1), rnd.choice(["  Share this PAGE\t", "share this page", "É top", "é top"]))
        out.append("\n".join(lines))
    out.append("\n".join(["share THIS page", "unique " * 4000] * 60))
    return out + out[-3:]


def test_line_dedup_equals_plain_python(spark, texts):
    docs = spark.createDataFrame(
        [(None if i == 3 else i, t, "x", -1) for i, t in enumerate(texts)], "doc_id long, text string, N_Lines string, extra int"
    )
    got = drop_frequent_lines(docs, min_docs=10)
    assert got.columns == ["doc_id", "text", "extra", "n_lines", "n_dropped"]
    want = sorted(
        [(None if i == 3 else i, *w, -1) for i, w in enumerate(kept_lines(texts))], key=lambda r: [(v is None, v) for v in r]
    )
    assert [tuple(r) for r in rows_of(got, "doc_id", "text", "n_lines", "n_dropped", "extra")] == want
    assert any(w[2] for w in kept_lines(texts))


def test_line_dedup_of_nothing_and_of_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert drop_frequent_lines(spark.createDataFrame([], schema)).count() == 0
    got = drop_frequent_lines(spark.createDataFrame([(1, "a\nb")] * 12 + [(2, "b\nc\n")], schema))
    assert sorted(map(tuple, got.collect())) == [(1, "", 2, 2)] * 12 + [(2, "c\n", 3, 1)]


def test_line_dedup_keeps_columns_named_like_its_own(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    odd = docs.selectExpr("*", "1 as _lines", "2 as _mark1", "3 as _MARK2", "4 as _gone", "5 as _at", "6 as _key", "7 as _line", "8 as `a.b`")
    got = drop_frequent_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    plain = drop_frequent_lines(docs)
    assert rows_of(got, "doc_id", "text", "n_lines") == rows_of(plain, "doc_id", "text", "n_lines")
    assert {tuple(r)[2:10] for r in got.collect()} == {(1, 2, 3, 4, 5, 6, 7, 8)}


def test_line_dedup_by_shuffle_gives_the_same(spark, texts, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = rows_of(drop_frequent_lines(docs), "doc_id", "text")
    monkeypatch.setattr("gridcut.llm.line_dedup.BROADCAST_KEYS", 0)
    assert rows_of(drop_frequent_lines(docs), "doc_id", "text") == first


@pytest.fixture(scope="module")
def benchmark():
    rnd = random.Random(9)
    item = lambda n: " ".join(rnd.choices("ab cd ef gh ij kl mn op".split(), k=n))
    items = [(1, item(30)), (2, item(13)), (10, item(5)), (3, None), (4, "  ?! "), (5, item(40)), (5, item(15)), (None, item(14))]
    return [*items, (6, items[0][1]), (7, "solo")]


def test_decontamination_equals_plain_python(spark, benchmark):
    rnd = random.Random(3)
    long = " ".join(rnd.choices("ab cd ef gh ij kl mn op zz".split(), k=30000))
    bodies = [None, "", "..", "solo", "so-lo SOLO!", long]
    for _, body in benchmark:
        w = (body or "").split()
        for n in (4, 5, 12, 13, 14, 40):
            at = rnd.randrange(max(1, len(w) - n + 1))
            bodies.append(" ".join(["zz"] * rnd.randint(0, 400) + [x.upper() for x in w[at : at + n]] + ["yy"] * rnd.randint(0, 3)))
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(bodies)], "doc_id long, text string, n_words string")
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    got = {r.doc_id: r for r in with_verdict(match_items(docs, items)).collect()}
    assert len(got) == len(bodies)
    for i, t in enumerate(bodies):
        n, hit, found = hits(t, benchmark)
        r = got[i]
        assert (r.n_words, r.n_hit, r.item_ids) == (n, len(hit), sorted(str(x) for x in found if x is not None)), i
        assert {p for a, b in r.hit_ranges for p in range(a, b)} == hit
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)


def test_decontamination_in_several_automata(spark, benchmark, monkeypatch):
    docs = spark.createDataFrame([(k, f"zz {b} yy {b}") for k, (_, b) in enumerate(benchmark)], "doc_id long, text string")
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    cols = ("doc_id", "n_words", "hit_ranges", "item_ids")
    one = rows_of(match_items(docs, items), *cols)
    monkeypatch.setattr("gridcut.llm.decontaminate.AUTOMATON_BYTES", 200)
    assert rows_of(match_items(docs, items), *cols) == one
    odd = docs.selectExpr("*", "1 as _uid", "2 as uid", "'s' as _spans", "'i' as _items", "'h' as Hit_Ranges", "3 as `a.b`")
    got = match_items(odd, items)
    assert got.columns == ["doc_id", "text", "_uid", "uid", "_spans", "_items", "a.b", "n_words", "hit_ranges", "item_ids"]
    assert rows_of(got, *cols) == one
    none = items.where("item_id = 99")
    assert {r.n_hit for r in with_verdict(match_items(docs, none)).collect()} == {0}
    assert match_items(docs.limit(0), items).count() == 0


def test_parts_find_passages_that_span_their_items(spark, monkeypatch):
    """Windows of items in different parts overlap in a document; one text bears many ids."""
    rnd = random.Random(11)
    words = [f"q{rnd.randrange(50)}" for _ in range(400)]
    items = [(i, " ".join(words[i : i + 20])) for i in range(0, 380, 9)] + [(1000 + i, " ".join(words[:20])) for i in range(30)]
    docs = [(1, " ".join(words)), (2, " ".join(words[100:250])), (3, "q1 q2"), (4, None), (4, None)]
    monkeypatch.setattr("gridcut.llm.decontaminate.AUTOMATON_BYTES", 2500)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = match_items(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, found = hits(dict(docs)[r.doc_id], items)
        assert (r.n_words, r.item_ids) == (n, sorted(map(str, found)))
        assert [p for a, b in r.hit_ranges for p in range(a, b)] == sorted(hit)


def test_automaton_owns_windows_across_items():
    rnd = random.Random(1)
    for _ in range(30):
        items = [(k, [bytes([97 + rnd.randrange(3)]) for _ in range(rnd.randint(1, 12))]) for k in range(8)]
        built = ItemAutomaton(items, 4)
        text = [bytes([97 + rnd.randrange(4)]) for _ in range(60)]
        ranges, found = built.scan(text)
        n, hit, names = hits(" ".join(x.decode() for x in text), [(k, " ".join(x.decode() for x in w)) for k, w in items], 4)
        assert {built.names[i] for i in found} == names
        assert {p for a, b in ranges for p in range(a, b)} == hit


def test_spans_go_and_the_rest_stays(spark):
    words = " ".join(f"i{k}" for k in range(20))
    docs = spark.createDataFrame([(1, "Start, here. " + words + "! End " + "pad " * 600), (2, words), (3, "none"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, words)], "item_id long, text string")
    got = {r.doc_id: r.clean_text for r in remove_spans(match_items(docs, items)).collect()}
    assert got == {1: "Start, here. ! End " + "pad " * 600, 2: "", 3: "none", 4: None}
    pad = "Ä-pad\u2028x 日本😀\n " * 300
    odd = [(1, words + "\n" + pad + "(" + words.upper() + ")" + pad + words), (2, pad + words + " \n\n"), (3, "\n" + words + "." + pad + "\n")]
    docs = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 as _spans", "2 as _units")
    got = {r.doc_id: r for r in remove_spans(match_items(docs, items), max_share=0.5).collect()}
    assert [got[k].clean_text for k in (1, 2, 3)] == ["\n" + pad + "()" + pad, pad + " \n\n", "\n." + pad + "\n"]
    assert (got[1]["_spans"], got[1]["_units"]) == (1, 2)


def test_simhash_equals_plain_python(spark):
    rnd = random.Random(2)
    base = [" ".join(rnd.choices([f"v{i}" for i in range(300)], k=60)) for _ in range(12)]
    texts = [None, "", "  \n", "one", "One two three", "É"]
    for b in base:
        w = b.split()
        texts += [b, b.upper(), b + " x", " ".join(w[:30] + ["new"] + w[30:]), " ".join(w[1:])]
    texts += [base[0]] * 5
    ids = [7 * k % 997 for k in range(len(texts))]
    rows = [(i, t, "c") for i, t in zip(ids, texts, strict=True)] + [(None, base[1], "c"), (None, "nobody else", "c")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string"), bits=4).collect()
    assert len(got) == len(rows)
    prints = [fingerprint(t) for t in texts]
    reach = groups(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = {}
    for k, r in enumerate(reach):
        least[r] = min(least.get(r, 1 << 60), ids[k])
    found = {r.doc_id: r for r in got if r.doc_id is not None}
    for k, i in enumerate(ids):
        assert found[i].fingerprint & (1 << 64) - 1 == prints[k]
        assert found[i].component_id == least[reach[k]], texts[k]
    nameless = {r.text: r.component_id for r in got if r.doc_id is None}
    assert nameless["nobody else"] is None and nameless[base[1]] is not None
    left = keep_one(spark.createDataFrame(rows, "doc_id long, text string, component_id string"))
    assert left.columns == ["doc_id", "text", "component_id"]
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(set(least.values()))


def test_simhash_splits_large_runs(spark, monkeypatch):
    rnd = random.Random(4)
    centre = rnd.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(150)}
    prints |= {rnd.getrandbits(64) for _ in range(100)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    whole = {tuple(r) for r in linking_pairs(df).collect()}
    import gridcut.llm.simhash as module

    original = module.shared_keys
    monkeypatch.setattr(module, "shared_keys", lambda *a: original(*a, largest=16))
    pieces = {tuple(r) for r in linking_pairs(df).collect()}
    link = lambda i, j: ((signed[i] ^ signed[j]) & (1 << 64) - 1).bit_count() <= 4
    want = groups(len(signed), link)
    for links in (whole, pieces):
        at = {p: k for k, p in enumerate(signed)}
        pairs = {(at[a], at[b]) for a, b in links}
        assert groups(len(signed), lambda i, j, p=pairs: (i, j) in p or (j, i) in p) == want
    assert len(pivots()) == PIVOTS


def test_simhash_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
