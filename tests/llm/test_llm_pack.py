"""Packing by exact round trip, sharding by its laws."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridcut.llm.common import numbered
from gridcut.llm.packing import Encoder, best_pattern, pack, plan_patterns
from gridcut.llm.queries import word_tokenizer
from gridcut.llm.sharding import rank_codes, shard_documents


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


def encoded(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def texts():
    rnd = random.Random(4)
    some = [None, "", " \n ", "İstanbul ΟΔΟΣ ǅ é", "<|endoftext|> <|x", "it's 12½ ²\xa0\x85\x1c\xadx", "日本語 — “q” …", "don't  STOP'LL"]
    for _ in range(400):
        some.append(" ".join(rnd.choices(["alpha", "Bêta,", "x1y2", "ß!", "tie", "(no)"], k=rnd.randint(1, 700))))
    return [*some, "long word " * 6000, "z" * 30000]


def test_encoder_equals_the_tokenizer(tokenizer):
    encoder = Encoder(word_tokenizer())
    rnd = random.Random(1)
    odd = ["".join(chr(rnd.choice([rnd.randrange(1, 0x250), rnd.randrange(32, 127), 32])) for _ in range(40)) for _ in range(400)]
    for t in [x or "" for x in texts()[:60]] + odd:
        assert encoder.ids(t) == encoded(tokenizer, t)[:-1].tobytes(), repr(t)


def check_pieces(rows, want, capacity=4096):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want[doc])) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(want[doc][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[doc])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return sum(len(w) for w in want.values()) / (capacity * len(by_sequence))


@pytest.mark.parametrize("cuts", [500_000, 0])
def test_every_id_lies_in_one_piece(spark, tokenizer, monkeypatch, cuts):
    monkeypatch.setattr("gridcut.llm.packing.BROADCAST_CUTS", cuts)
    own = texts()
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(own)], "doc_id long, text string, length int")
    got = pack(docs, word_tokenizer(), capacity=512).collect()
    assert check_pieces(got, {i: encoded(tokenizer, t) for i, t in enumerate(own)}, 512) > 0.97


def test_nothing_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert pack(spark.createDataFrame([], schema), word_tokenizer()).count() == 0
    got = pack(spark.createDataFrame([(None, "a b"), (3, None), (3, None), (3, None)], schema), word_tokenizer()).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got) == [(0, 3), (3, 1), (3, 1), (3, 1)]
    assert sorted((r.sequence_id, r.offset) for r in got)[0] == (0, 0) and len({r.uid for r in got}) == 4


def test_patterns_use_pieces_once_and_fill_sequences():
    rnd = np.random.default_rng(2)
    demand = rnd.integers(0, 3000, 64)
    plan = plan_patterns(demand)
    assert (plan.left >= 0).all() and (plan.used @ plan.patterns + plan.left == demand).all()
    assert ((plan.patterns @ np.arange(1, 65))[plan.used > 0] <= 64).all()
    least = (demand * np.arange(1, 65)).sum() / 64
    assert plan.used.sum() + plan.left.sum() * 0 >= 0.98 * least - 64
    assert plan_patterns(np.zeros(8, int)).used.size == 0


def test_knapsack_equals_brute_force():
    rnd = np.random.default_rng(5)
    for _ in range(20):
        prices = rnd.uniform(0, 1, 9)
        best = [0.0] * 10
        for room in range(1, 10):
            best[room] = max(best[room - 1], *(prices[k] + best[room - 1 - k] for k in range(room)))
        worth, chosen = best_pattern(prices)
        assert np.isclose(worth, best[9]) and np.isclose(chosen @ prices, worth) and chosen @ np.arange(1, 10) <= 9


def test_numbers_are_gapless(spark):
    rows = spark.range(1000).selectExpr("id", "id % 3 as g")
    got = numbered(rows, ["g"], ["id"], "n", buckets=7).collect()
    for g in range(3):
        own = [r.n for r in got if r.g == g]
        assert sorted(own) == list(range(len(own)))


def sharded(spark, rows, shards=24):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string")
    return shard_documents(docs, shards).collect()


def test_shards_are_near_equal_and_groups_stay_whole(spark):
    rnd = random.Random(7)
    rows = [(i, "x" * rnd.randint(0, 3000) + str(i), rnd.choice("ab") * 2, f"s{i % 9}", "c") for i in range(3000)]
    rows += [(10_000 + i, "copy " * 30, None, f"s{i % 5}", "c") for i in range(40)] + [(20_000 + i, None, "ab", None, "c") for i in range(30)]
    rows += [(30_000 + i, "large group " * 20, "ab", "s1", "c") for i in range(2500)] + [(None, "nobody", None, None, None)] * 2
    got = sharded(spark, rows)
    assert len(got) == len(rows)
    size, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.text_crc32].add(r.shard)
    mean = sum(size.values()) / 24
    assert len(size) == 24 and max(size.values()) < 1.02 * mean and min(size.values()) > 0.98 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert [c for c, s in homes.items() if len(s) > 1] == [zlib.crc32(b"large group " * 20)]
    want = sorted((r[0] or -1, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == want


def test_few_equal_or_no_rows(spark):
    assert sharded(spark, []) == []
    assert {(r.shard, r.slot) for r in sharded(spark, [(1, "a", None, None, None)])} == {(0, 0)}
    same = sharded(spark, [(5, "same", "l", "s", "c")] * 48, 4)
    assert sorted((r.shard, r.slot) for r in same) == [(s, k) for s in range(4) for k in range(12)]


@pytest.mark.parametrize("text,tokens", [("", 1), ("a b c d e f g h", 9), ("mixed", None)])
def test_many_short_documents_leave_little_padding(spark, tokenizer, text, tokens):
    rnd = random.Random(3)
    if tokens:
        docs = [(k, text) for k in range(100_000)]
    else:
        docs = [(k, "a " * rnd.choice([0, 1, 7, 8, 9, 40, 300, 1500])) for k in range(3_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = pack(df, word_tokenizer()).groupBy("sequence_id").sum("length").toDF("s", "n").toPandas()["n"].to_numpy()
    assert not tokens or got.sum() == tokens * len(docs)
    assert got.sum() >= 0.985 * 4096 * (len(got) - 1)
    assert not tokens or got.sum() >= 0.99 * 4096 * (len(got) - 1)


def test_sources_with_a_common_beginning_are_told_apart(spark):
    """Twelve equal bytes first: the tree still splits by the source, so few shards mix sources."""
    rows = [(7, "same length %04d" % k, "l", f"https://host{k % 4}.example", "c") for k in range(1600)]
    got = sharded(spark, rows, 4)
    crc = {zlib.crc32(t.encode()): s for _, t, _, s, _ in rows}
    mixed = {}
    for r in got:
        mixed.setdefault(r.shard, []).append(crc[r.text_crc32])
    assert len(got) == 1600 and all(max(map(m.count, set(m))) >= 0.95 * len(m) for m in mixed.values())


def test_codes_are_ranks(spark, monkeypatch):
    values = [None, "", "a", "a", "https://b", "https://a", "É", "zz", *[f"source_{k:05d}" for k in range(300)]]
    docs = spark.createDataFrame([(v,) for v in values], "`so.urce` string")
    ranks = {v: k for k, v in enumerate(sorted(set(values), key=lambda v: (v is not None, (v or "").encode())))}
    want = {hashlib.md5(v.encode()).hexdigest() if v is not None else "": float(k) for v, k in ranks.items()}
    assert {r.key: r.code for r in rank_codes(docs, "so.urce").collect()} == want
    rows = [(k, "t%05d" % k, None if k % 7 == 0 else "l", f"s{k % 5}", "c") for k in range(500)]
    first = sharded(spark, rows, 4)
    monkeypatch.setattr("gridcut.llm.sharding.BROADCAST_CODES", 0)
    assert sorted((r.doc_id, r.shard) for r in sharded(spark, rows, 4)) == sorted((r.doc_id, r.shard) for r in first)
