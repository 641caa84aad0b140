"""Ranked lexical search with bag deduplication: documents with one bag of item words are scored once."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcut.llm.common import arrow_rows, stored, texts_of, word_bytes

#: Items are searched in parts of about so many bytes of text; a part's vocabulary is broadcast.
PART_BYTES = 4 << 20
#: Scores that a task holds at once (classes times items), and classes it keeps before it thins them.
SCORES_AT_ONCE, HELD = 2_000_000, 400_000
#: Up to so many bytes of winning bags are broadcast to the documents; beyond it the join shuffles.
BROADCAST_BAGS = 16 << 20
EXACT = float(1 << 53)


@dataclass(frozen=True)
class Items:
    """A part of the items: words numbered from 0, and for each word the items that hold it, how often."""

    numbers: dict[bytes, int]
    begins: np.ndarray
    item: np.ndarray
    repeats: np.ndarray
    count: int

    @staticmethod
    def of(texts: list[str | None]) -> Items:
        bags = [Counter(word_bytes(t)) for t in texts]
        words = sorted({w for bag in bags for w in bag})
        numbers = {w: k for k, w in enumerate(words)}
        held = sorted((numbers[w], i, n) for i, bag in enumerate(bags) for w, n in bag.items())
        word = np.array([h[0] for h in held], np.int64)
        begins = np.searchsorted(word, np.arange(len(words) + 1))
        return Items(
            numbers, begins, np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64), len(texts)
        )


def item_bags(docs: DataFrame, items: Items, id_col: str, text: str) -> DataFrame:
    """(doc_id, n, bag): words of each document with any, and its item words as pairs of a word's
    number and its occurrences, by number, in little-endian unsigned 32-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(items.numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            kept, lengths, bags = [], [], []
            for row, value in enumerate(texts_of(batch, "text")):
                words = word_bytes(value)
                if not words:
                    continue
                found = Counter(map(number, words))
                found.pop(None, None)
                kept.append(row)
                lengths.append(len(words))
                bags.append(np.array(sorted(found.items()), "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()), pa.array(bags, pa.binary())],
                names=["doc_id", "n", "bag"],
            )

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n long, bag binary")


def _pairs(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word number and occurrences of all pairs of a column of bags."""
    ends = np.frombuffer(bags.buffers()[1], np.int32)[bags.offset : bags.offset + len(bags) + 1]
    data = bags.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    both = flat.copy().view("<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(bags)), np.diff(ends) // 8), both[:, 0], both[:, 1]


def _documents_with(bags: DataFrame, words: int) -> np.ndarray:
    """For each item word the number of documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(words, np.int64)
        for batch in batches:
            total += np.bincount(_pairs(batch.column(0))[1], minlength=words)
        word = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(total[word])], names=["word", "df"])

    counted = bags.select("bag").mapInArrow(run, "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
    out = np.zeros(words, np.int64)
    for r in counted.collect():  # at most the words of a part of the items
        out[r.word] = r.df
    return out


def _best_classes(classes: DataFrame, items: Items, weights: np.ndarray, top: int) -> DataFrame:
    """(item, score, class): classes that may be among an item's best `top` within a task.

    Score ties go by the smallest id of a class. All of a batch's classes meet all items that share a
    word with them: contributions go from words to items and are added up for (class, item).
    """
    shared = classes.sparkSession.sparkContext.broadcast((items.begins, items.item, items.repeats, weights))
    count = items.count
    most = int(items.repeats.sum()) * int(weights.max(initial=0)) * 1_000_000
    schema = "item long, score long, first long, class long"

    def thinned(held: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(held, axis=1)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        begins = np.searchsorted(rows[0], rows[0])
        return rows[:, np.arange(rows.shape[1]) - begins < top]

    def scores(rows, word, tf, m, n_rows):
        begins, item, repeats, weight = shared.value
        worth = weight[word] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[rows]))
        many = begins[word + 1] - begins[word]
        at = np.repeat(begins[word] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        cell = np.repeat(rows, many) * count + item[at]
        value = np.repeat(worth, many) * repeats[at]
        if most < EXACT:  # then sums of doubles are exact
            return np.bincount(cell, value, n_rows * count).astype(np.int64)
        out = np.zeros(n_rows * count, np.int64)
        np.add.at(out, cell, value)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORES_AT_ONCE // max(count, 1))
        held, size = [np.zeros((4, 0), np.int64)], 0
        least = np.ones(count, np.int64)
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                first, name, m = (batch.column(k).to_numpy() for k in range(3))
                got = scores(*_pairs(batch.column(3)), m, batch.num_rows)
                cell = np.flatnonzero(got.reshape(-1, count) >= least)
                row, item = np.divmod(cell, count)
                held.append(np.stack([item, got[cell], first[row], name[row]]))
                size += len(cell)
                if size > HELD:
                    held, size = [thinned(held)], 0
                    last = np.flatnonzero(np.diff(held[0][0], append=-1))
                    full = np.bincount(held[0][0], minlength=count)[held[0][0][last]] >= top
                    least[held[0][0][last[full]]] = held[0][1][last[full]]
        rows = thinned(held)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["item", "score", "first", "class"])

    picked = classes.select(F.coalesce("first", F.lit(_LAST)).alias("first"), "class", "m", "bag").mapInArrow(run, schema)
    order = [F.desc("score"), F.asc("first"), F.asc("class")]
    return picked.withColumn("_k", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("_k") <= top)


_LAST = (1 << 63) - 1


def _search_part(docs: DataFrame, texts: list[str | None], top: int, id_col: str, text: str) -> DataFrame:
    """(item, rank, doc_id, score) for the items of one part, numbered as in `texts`."""
    spark = docs.sparkSession
    items = Items.of(texts)
    with arrow_rows(spark, 1000):
        bags = stored(item_bags(docs, items, id_col, text), "bags")
    held = bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    docs_n, words_n = int(held[0]), int(held[1])
    df = _documents_with(bags, len(items.numbers))
    weights = np.array([math.floor(1000 * math.log((2 * docs_n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    length_class = F.lit(75) + F.expr(f"(25 * n * {docs_n}L) div {max(words_n, 1)}L")
    known = bags.where(F.length("bag") > 0).withColumn("m", length_class.cast("long"))
    known = known.withColumn("hash", F.xxhash64("m", "bag"))
    # The hash deals rows to tasks; rows of a class have equal bytes, compared by the grouping itself.
    classes = known.groupBy("hash", "m", "bag").agg(F.min("doc_id").alias("first"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "bag_classes")
    best = stored(_best_classes(classes, items, weights, top), "best_classes")
    names = best.select("class").distinct()
    winners = stored(classes.join(F.broadcast(names) if items.count * top <= 1_000_000 else names, "class", "left_semi"), "won_bags")
    size = winners.agg(F.sum(F.length("bag") + 64)).first()[0] or 0
    winners = winners.select("hash", "m", "bag", "class")
    members = known.join(F.broadcast(winners) if size <= BROADCAST_BAGS else winners, ["hash", "m", "bag"])
    inside = Window.partitionBy("class").orderBy(F.asc_nulls_last("doc_id"))
    members = members.select("class", "doc_id", F.row_number().over(inside).alias("_m")).where(F.col("_m") <= top)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.join(members, "class").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    top: int = 20,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents with the highest scores above 0 for each item.

    Documents are cut down to words that items hold. Documents with the same occurrences of these and
    the same length class m have the same score for every item, so they are one class: a hash deals
    them, and their bytes are compared. A class is scored once, in blocks of all items of a part. The
    best `top` documents of an item lie in its best `top` classes when ties go by a class's smallest
    id, so only those classes fetch members, the `top` smallest ids of each. A hot class is reduced
    before the shuffle; no task sees all documents of an item or a class.

    Items are read in parts of about PART_BYTES of text, each searched by itself (its words, their
    counts and what they weigh depend on the documents only), so what is broadcast is bounded.

    Null or empty text has no words: such a document is in no count and no result, such an item has
    no rows. Rows of `items` with equal id and text are one item, with another text one of their own.
    Null item ids are kept; null document ids rank after others of equal score. Repeated documents
    rank one by one. Empty tables give no rows. Other columns are not carried.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")).distinct()
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    parts = -(-size // PART_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(parts, 1)))
    asked = stored(asked.withColumn("part", part), "search_items")
    out = spark.createDataFrame([], f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id long, score long")
    for k in range(parts):
        own = asked.where(F.col("part") == k).orderBy("item_id", "text").collect()
        if not own:
            continue
        found = _search_part(docs, [r.text for r in own], top, id_col, text)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], f"item long, item_id {items.schema[item_id].dataType.simpleString()}")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
