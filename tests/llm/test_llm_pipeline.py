"""The pipeline, stage by stage on what the stage before kept, against plain Python."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from plain import WORD, fingerprint, groups, hits, kept_lines, low, words

from gridcut.llm.common import stored
from gridcut.llm.queries import CHECKS, QUERIES, word_tokenizer
from gridcut.llm.quality import fit_quality, score_quality

SF = "/root/testdata/sf0.001"
DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "s", 0)], docs.schema)
    out = [docs.unionByName(odd)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name.replace(" ", "_")))
    return out


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(CHECKS) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line dedup", "near dedup", "decontaminate", "packing"]


def test_quality_keeps_what_the_classifier_accepts(spark, steps):
    model = fit_quality(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in score_quality(steps[0], model).collect() if r.score >= 0.7}
    assert steps[1].columns == DOCS and {r.doc_id for r in steps[1].collect()} == want
    assert 0 < len(want) < steps[0].count()


def test_frequent_lines_go(steps):
    before, after = steps[1].orderBy("doc_id").collect(), steps[2].orderBy("doc_id").collect()
    want = [w[0] for w in kept_lines([r.text for r in before])]
    assert [(r.doc_id, r.text, r.n_chars) for r in after] == [(r.doc_id, t, len(t)) for r, t in zip(before, want, strict=True)]


def test_one_of_each_group_stays(steps):
    before = steps[2].orderBy("doc_id").collect()
    prints = [fingerprint(r.text) for r in before]
    reach = groups(len(before), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    assert sorted(r.doc_id for r in steps[3].collect()) == [before[k].doc_id for k in sorted(set(reach))]


def without_spans(text, hit):
    """The text without runs of 13 hit words or more, found word by word."""
    at = [m.span() for m in WORD.finditer(low(text))]
    out, last, k = [], 0, 0
    while k < len(at):
        end = k
        while end in hit:
            end += 1
        if end - k >= 13:
            out.append(text[last : at[k][0]])
            last = at[end - 1][1]
        k = max(end, k + 1)
    return "".join([*out, (text or "")[last:]])


def test_contaminated_documents_go(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for r in steps[3].collect():
        n, hit, _ = hits(r.text, items)
        if not (hit and 20 * len(hit) >= n):
            text = without_spans(r.text, hit)
            want.add((r.doc_id, text, r.lang, r.source, len(text)))
    assert {tuple(r) for r in steps[4].collect()} == want


def test_long_spans_go_from_documents_that_stay(spark, steps):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(words(r.text)) >= 20)
    span = " ".join(words(item)[:20])
    filler = " ".join(f"zq{k}" for k in range(500))
    rows = [(1, f"Start. {filler}, {span}! End", "en", "s", -1), (2, f"{filler} {span} {span} {span}", "en", "s", -1),
            (3, filler, "en", "s", -1), (4, None, None, None, None)]
    got = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, steps[0].schema), SF)
    clean = f"Start. {filler}, ! End"
    assert {tuple(r) for r in got.collect()} == {(1, clean, "en", "s", len(clean)), rows[2], rows[3]}


def test_every_token_is_packed_once(steps):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    pieces = {}
    for r in steps[5].collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for doc in steps[4].collect():
        ids = np.array([*tokenizer.encode(doc.text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces.pop(doc.doc_id), key=lambda r: r.start):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert not pieces


def test_stages_take_no_documents(spark, steps):
    none = steps[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
