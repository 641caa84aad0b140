"""Near-duplicate documents by SimHash: pivot distance tables discard pairs, survivors are verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcut.llm.common import append_columns, arrow_rows, stored, texts_of
from gridcut.llm.components import Forest, components
from gridcut.llm.runs import by_run, pairs_in_runs, run_numbers, shared_keys

SEED, PIVOTS = 42, 24


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits; a bit is 1 if more than half the shingles' hashes have it. Without words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(width + 1) - 1
    start = stop - width
    k = min(shingle, len(words)) - 1
    ends = zip(start[: len(words) - k].tolist(), stop[k:].tolist(), strict=True)
    hashed = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in ends], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 1 << 16):
        part = hashed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashed), bitorder="little").tobytes(), "little")


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, fixed by a rule: the hashes of the numbers from 0."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(count)], np.uint64)


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, and `fingerprint` (a signed long of the same bits)."""
    added = T.StructType([T.StructField("fingerprint", T.LongType())])

    def compute(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            values = np.fromiter(map(fingerprint, texts_of(batch, text)), np.uint64, batch.num_rows)
            yield batch, [pa.array(values.view(np.int64))]

    return append_columns(docs, added, compute)


def _distance_tables(distinct: DataFrame) -> DataFrame:
    """Each fingerprint with its Hamming distances to the pivots, a byte each."""
    refs = pivots()

    def compute(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            apart = np.bitwise_count(values[:, None] ^ refs).astype(np.uint8)
            yield batch, [pa.array([row.tobytes() for row in apart], pa.binary())]

    added = T.StructType([T.StructField("apart", T.BinaryType())])
    return append_columns(distinct.select("fingerprint"), added, compute)


def _block_keys(bits: int, blocks: int) -> list:
    """Of `blocks` pieces of a fingerprint, fingerprints within `bits` share at least blocks - bits:
    a key for every choice of so many pieces."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    fp = F.col("fingerprint")
    pieces = [
        F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)
    ]
    return [
        F.xxhash64(F.lit(n), *[pieces[i] for i in chosen])
        for n, chosen in enumerate(combinations(range(blocks), blocks - bits))
    ]


def linking_pairs(distinct: DataFrame, bits: int = 4, blocks: int = 6) -> DataFrame:
    """Links (a, b) that connect what fingerprints within `bits` of one another connect.

    Candidates share blocks - bits of `blocks` pieces (more blocks: more keys, fewer candidates; six
    suit some ten million fingerprints). Of each pair the distances to the pivots are compared: a
    difference above `bits` at any pivot rules it out. The rest is verified bit by bit. Links between
    fingerprints that a task has connected already are not passed on.
    """
    tables = stored(_distance_tables(distinct), "pivot_tables")
    keyed = tables.select(F.explode(F.array(*_block_keys(bits, blocks))).alias("key"), "fingerprint", "apart")
    runs = shared_keys(keyed, "key", "fingerprint")

    def work(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        fp = whole.column("fingerprint").to_numpy()
        code = fp.view(np.uint64)
        apart = np.frombuffer(b"".join(whole.column("apart").to_pylist()), np.uint8).reshape(-1, PIVOTS).astype(np.int8)
        forest, a, b = Forest(), [], []
        for i, j in pairs_in_runs(run_numbers(whole, ["key", "_run"])):
            for first in range(0, PIVOTS, 4):
                near = np.abs(apart[i, first : first + 4] - apart[j, first : first + 4]).max(axis=1) <= bits
                i, j = i[near], j[near]
            sure = np.bitwise_count(code[i] ^ code[j]) <= bits
            for x, y in zip(fp[i[sure]].tolist(), fp[j[sure]].tolist(), strict=True):
                if forest.join(x, y):
                    a.append(x)
                    b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return by_run(runs, ["key", "_run"], ["fingerprint"], work, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = 4, blocks: int = 6
) -> DataFrame:
    """All columns of `docs`, and `fingerprint` (long) and `component_id`.

    Documents link when their fingerprints differ in `bits` bits or fewer; component_id is the
    smallest id that links reach. Equal fingerprints meet once: pairs are sought among distinct ones.

    Null, empty and white texts have fingerprint 0 and link like any other. Null ids take part in
    linking but are never the smallest; a component of null ids alone has a null id. Repeated rows
    are in one component. No rows give no rows. Columns with an added name are replaced.
    """
    with arrow_rows(docs.sparkSession, 500):
        marked = stored(with_fingerprints(docs.drop("component_id"), text), "fingerprints")
    distinct = stored(marked.groupBy("fingerprint").agg(F.min(f"`{id_col}`").alias("_least")), "distinct_fingerprints")
    roots = components(linking_pairs(distinct, bits, blocks)).withColumnRenamed("node", "fingerprint")
    rooted = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select(*marked.columns, "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = 4) -> DataFrame:
    """One document of each component: that with the smallest id. Of repeated rows one stays, and of a
    component of null ids one row."""
    found = near_duplicates(docs, id_col, text, bits)
    first = found.where(F.col(f"`{id_col}`").eqNullSafe(F.col("component_id")))
    return first.dropDuplicates([id_col, "component_id", "fingerprint"]).select(*docs.columns)
