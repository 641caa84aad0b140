"""Comparing rows that share a key, with keys of any size split over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is dealt out in pieces of half its size, one task row set for two pieces.
LARGEST_RUN = 4096


def shared_keys(rows: DataFrame, key: str, member: str, largest: int = LARGEST_RUN) -> DataFrame:
    """Rows whose key others share, with `_run`: a number such that any two rows of a key meet in a run.

    Keys of up to `largest` rows are one run. A larger key is cut by the hash of `member` into pieces
    of about half that, and each row goes to the runs of its piece with every piece, so a run stays
    bounded. `_own` is the row's piece; two rows of one piece meet in several runs, in one of which
    `_alone` is true. Rows alone with their key are gone after the count. `rows` is read twice.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    pieces = F.when(F.col("_n") <= largest, 1).otherwise(F.ceil(F.col("_n") / (largest // 2))).cast("int")
    own = F.pmod(F.xxhash64(member), F.col("_pieces")).cast("int")
    others = F.sequence(F.lit(0), F.col("_pieces") - 1)
    return (
        rows.join(sizes, key)
        .withColumn("_pieces", pieces)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(others))
        .withColumn("_run", F.least("_own", "_other") * F.col("_pieces") + F.greatest("_own", "_other"))
        .withColumn("_alone", F.col("_own") == F.col("_other"))
        .drop("_n", "_other", "_pieces")
    )


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of sorted input that never cut a run of equal keys in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = _last_start(batch, keys)
        if held and last == 0 and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys):
            held.append(batch)
            continue
        yield_now = [*held, batch.slice(0, last)]
        if sum(b.num_rows for b in yield_now):
            yield pa.Table.from_batches(yield_now)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _last_start(batch: pa.RecordBatch, keys: list[str]) -> int:
    start = 0
    for k in keys:
        col = batch.column(k).to_numpy(zero_copy_only=False)
        changed = np.flatnonzero(col != col[-1])
        start = max(start, int(changed[-1]) + 1 if len(changed) else 0)
    return start


def pairs_in_runs(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs in runs of equal keys, one distance j - i at a time."""
    first, step = np.arange(len(key) - 1), 1
    while True:
        first = first[first + step < len(key)]
        first = first[key[first + step] == key[first]]
        if not len(first):
            return
        yield first, first + step
        step += 1


def run_numbers(whole: pa.Table, keys: list[str]) -> np.ndarray:
    """A number for each row that changes where a run ends."""
    changed = np.zeros(whole.num_rows, bool)
    for k in keys:
        col = whole.column(k).to_numpy()
        changed[1:] |= col[1:] != col[:-1]
    return np.cumsum(changed)


def by_run(rows: DataFrame, keys: list[str], order: list[str], work: Callable, schema: str) -> DataFrame:
    """`work` gets tables of whole runs and gives record batches; runs are dealt out by hash and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_runs(batches, keys):
            yield from work(whole)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
