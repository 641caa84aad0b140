"""Benchmark passages in training text, found with a generalised suffix automaton of the test items."""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcut.llm.common import append_columns, fresh_name, stored, texts_of, word_bytes

#: Test items go into automata of about so many bytes of ids and text. Measured on 5 MB of items of
#: 80 words, building takes 16 bytes of memory for each of them and the stored form 4.
AUTOMATON_BYTES = 8 << 20
#: A built automaton is stored in pieces of so many bytes, far below the limit of a Parquet cell.
PIECE_BYTES = 16 << 20
#: What no word holds, as in a character class of a pattern.
NO_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"

_NO_WORDS: dict[int, int] = {}


class ItemAutomaton:
    """Generalised suffix automaton over the words of test items.

    `scan` follows a text word by word and knows the longest suffix read so far that occurs in any
    item; `owner` and `others` tell which items hold a window that ends there. Most states go on with
    one word only: that one stands in two arrays, others in a dictionary of the state.
    """

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.char, self.next = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        ends, owners = array("i"), array("i")
        shorts: list[tuple[int, int, int]] = []
        self.names: list[object] = []
        for name, words in items:
            if not words:
                continue
            self.names.append(name)
            at, item = 0, len(self.names) - 1
            for w in words:
                at = self._extend(at, self.vocab.setdefault(w, len(self.vocab)))
                ends.append(at)
                owners.append(item)
            if len(words) < window:
                shorts.append((at, len(words), item))
        self.shortest = min([window, *(n for _, n, _ in shorts)])
        self._own(ends, owners)
        #: For a state, the short items that end wherever the state's longest string ends.
        self.short_at: dict[int, list[tuple[int, int]]] = {}
        for at, n, item in shorts:
            self.short_at.setdefault(self._holding(at, n), []).append((n, item))

    def _step(self, state: int, c: int) -> int:
        return self.next[state] if self.char[state] == c else self.more.get(state, _NO_WORDS).get(c, -1)

    def _lead(self, state: int, c: int, to: int) -> None:
        if self.char[state] in (-1, c):
            self.char[state], self.next[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _state(self, char: int, to: int, link: int, length: int) -> int:
        for column, value in ((self.char, char), (self.next, to), (self.link, link), (self.length, length)):
            column.append(value)
        return len(self.link) - 1

    def _extend(self, last: int, c: int) -> int:
        link, length = self.link, self.length
        known = self._step(last, c)
        if known >= 0:
            return known if length[known] == length[last] + 1 else self._clone(last, known, c)
        cur = self._state(-1, -1, 0, length[last] + 1)
        p, q = last, -1
        while p >= 0 and (q := self._step(p, c)) < 0:
            self._lead(p, c, cur)
            p = link[p]
        if p >= 0:
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        made = self._state(self.char[q], self.next[q], self.link[q], self.length[p] + 1)
        if q in self.more:
            self.more[made] = dict(self.more[q])
        self.link[q] = made
        while p >= 0 and self._step(p, c) == q:
            self._lead(p, c, made)
            p = self.link[p]
        return made

    def _holding(self, state: int, n: int) -> int:
        """The state up the links that stands for the suffix of n words."""
        while self.length[self.link[state]] >= n and state:
            state = self.link[state]
        return state

    def _own(self, ends: array, owners: array) -> None:
        """Items of every state that stands for a window: those whose prefix states lie below it. The
        first item stands in an array, others in a set of the state."""
        self.owner = array("i", [-1]) * len(self.link)
        self.others: dict[int, set[int]] = {}
        for state, item in zip(ends, owners, strict=True):
            if self.length[state] >= self.window:
                at = self._holding(state, self.window)
                if self.owner[at] < 0:
                    self.owner[at] = item
                elif self.owner[at] != item:
                    self.others.setdefault(at, set()).add(item)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word ranges [from, to), ascending and apart, and the items with windows in the text."""
        ranges: list[tuple[int, int]] = []
        found: set[int] = set()
        code = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        known = np.zeros(len(words) + 2, np.int8)
        known[1:-1] = code >= 0
        edges = np.flatnonzero(np.diff(known)).reshape(-1, 2)
        for start, stop in edges[edges[:, 1] - edges[:, 0] >= self.shortest].tolist():
            self._run(code[start:stop].tolist(), start, ranges, found)
        return ranges, found

    def _run(self, code: list[int], start: int, ranges: list, found: set[int]) -> None:
        char, first_to, more = self.char, self.next, self.more
        link, length, window = self.link, self.length, self.window
        state = size = 0
        for i, c in enumerate(code, start):
            to = first_to[state] if char[state] == c else more.get(state, _NO_WORDS).get(c, -1)
            while to < 0 and state:
                state = link[state]
                size = length[state]
                to = first_to[state] if char[state] == c else more.get(state, _NO_WORDS).get(c, -1)
            if to >= 0:
                state = to
                size += 1
            hit = 0
            if size >= window:
                hit = window
                at = self._holding(state, window)
                if self.owner[at] >= 0:
                    found.add(self.owner[at])
                    found.update(self.others.get(at, ()))
            if self.short_at:
                at = state
                while at:
                    for n, item in self.short_at.get(at, ()):
                        if n <= size:
                            hit = max(hit, n)
                            found.add(item)
                    at = link[at]
            if hit:
                first = i + 1 - hit
                while ranges and ranges[-1][1] >= first:
                    first = min(first, ranges.pop()[0])
                ranges.append((first, i + 1))


def _together(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def match_items(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
) -> DataFrame:
    """All columns of `docs`, and `n_words`, `hit_ranges` (word ranges from, to) and `item_ids`.

    A word is hit if it lies in an occurrence of a window of an item: `window` consecutive words, or
    the whole item if it has fewer (none if it has no word). Distinct items fall by hash into parts of
    about AUTOMATON_BYTES; tasks build a part's automaton each and store it. One part's automaton at a
    time is broadcast and all documents are scanned with it; what it finds is stored before the next
    part comes, so neither the driver nor a task ever holds more than one part (an item longer than
    that makes its part larger). With one part documents are not shuffled; with several, the finds of
    all parts are brought together by a row number and joined to the documents once.

    Null or empty texts have no words and no hits; null items none either. Repeated items count under
    their own ids, equal ids once. An item with a null id hits words but is in no id list. Columns of
    `docs` named like the new ones, in any case, are replaced. No documents give no rows; without
    items nothing is hit.
    """
    spark = docs.sparkSession
    automata, parts = _automata(benchmark, item_id, item_text, window)

    def shared(k: int):
        pieces = automata.where(F.col("part") == k).orderBy("at").collect()
        return spark.sparkContext.broadcast(b"".join(r.piece for r in pieces) or pickle.dumps(ItemAutomaton([], window)))

    if parts == 1:
        return _scanned(docs, shared(0), text)
    uid = fresh_name(docs, "uid")
    rows = stored(docs.withColumn(uid, F.monotonically_increasing_id()), "scanned_rows")
    narrow = rows.select(F.col(uid).alias("uid"), F.col(f"`{text}`").alias("text"))
    found = []
    for k in range(parts):
        automaton = shared(k)
        own = _scanned(narrow, automaton, "text").drop("text")
        found.append(stored(own if k == 0 else own.where(F.size("hit_ranges") > 0), "part_hits"))
        automaton.unpersist()
    whole = (
        reduce(DataFrame.unionByName, found)
        .groupBy("uid")
        .agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("hit_ranges")).alias("parts_ranges"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        )
    )
    whole = _merged(whole).withColumnRenamed("uid", uid)
    others = [c for c in docs.columns if c.lower() not in ("n_words", "hit_ranges", "item_ids")]
    return rows.select(uid, *[f"`{c}`" for c in others]).join(whole, uid).select(
        *[f"`{c}`" for c in others], "n_words", "hit_ranges", "item_ids"
    )


def _automata(benchmark: DataFrame, item_id: str, item_text: str, window: int) -> tuple[DataFrame, int]:
    """(part, at, piece): the automaton of each part of the items, pickled; and how many parts."""
    items = stored(
        benchmark.select(
            F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("words")
        )
        .where(F.col("words").isNotNull())
        .distinct(),
        "items",
    )
    size = F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0))
    total = items.agg(F.sum(size)).first()[0] or 0
    parts = 1 + total // AUTOMATON_BYTES

    def build(group: pa.Table) -> pa.Table:
        texts, ids = group.column("words"), group.column("ids")
        pairs = ((ids[i].as_py(), word_bytes(texts[i].as_py())) for i in range(group.num_rows))
        blob = pickle.dumps(ItemAutomaton(pairs, window), protocol=pickle.HIGHEST_PROTOCOL)
        pieces = [blob[i : i + PIECE_BYTES] for i in range(0, len(blob), PIECE_BYTES)]
        part = [group.column("part")[0].as_py()] * len(pieces)
        names = ["part", "at", "piece"]
        return pa.table([pa.array(part, pa.int64()), pa.array(range(len(pieces)), pa.int64()), pa.array(pieces, pa.binary())], names)

    part = F.pmod(F.xxhash64("item", "words"), F.lit(parts)).cast("long")
    by_text = items.groupBy(part.alias("part"), "words").agg(F.collect_set("item").alias("ids"))
    built = by_text.groupBy("part").applyInArrow(build, "part long, at long, piece binary")
    return stored(built, "automata"), parts


def _scanned(docs: DataFrame, shared, text: str) -> DataFrame:
    """All columns of `docs` and what one automaton finds in their texts."""
    kinds = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]
    added = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("hit_ranges", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("item_ids", T.ArrayType(T.StringType())),
        ]
    )

    def compute(batches: Iterator[pa.RecordBatch]):
        automaton = pickle.loads(shared.value)
        for batch in batches:
            n, spans, items = [], [], []
            for value in texts_of(batch, text):
                words = word_bytes(value)
                ranges, found = automaton.scan(words)
                n.append(len(words))
                spans.append([list(x) for x in ranges])
                items.append(sorted({x for i in found for x in automaton.names[i]}))
            yield batch, [pa.array(v, t) for v, t in zip((n, spans, items), kinds, strict=True)]

    return append_columns(docs, added, compute)


def _merged(found: DataFrame) -> DataFrame:
    """`hit_ranges` from the ranges of all parts of a document, which may overlap."""
    kind = T.ArrayType(T.ArrayType(T.LongType()))

    def compute(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ranges = [[list(r) for r in _together(x)] for x in texts_of(batch, "parts_ranges")]
            yield batch, [pa.array(ranges, pa.list_(pa.list_(pa.int64())))]

    return append_columns(found, T.StructType([T.StructField("hit_ranges", kind)]), compute).drop("parts_ranges")


def _hit_words() -> Column:
    return F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda n, r: n + F.get(r, F.lit(1)) - F.get(r, F.lit(0)))


def with_verdict(matched: DataFrame, share: int = 20) -> DataFrame:
    """`n_hit` and `contaminated`: any word is hit, and at least one in `share` words."""
    return matched.withColumn("n_hit", _hit_words()).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    )


def remove_spans(matched: DataFrame, text: str = "text", min_words: int = 13, max_share: float = 0.05) -> DataFrame:
    """`clean_text`, the text without hit spans of `min_words` or more; nothing is left of a document of
    which a larger part than `max_share` is hit. Word ranges refer to the words of the text; what stands
    between words around a removed span stays.

    DataFrame functions only, linear in the text: a text with such spans is split into its words, each
    with what stands before it, and the words between spans are joined again. Null text stays null."""
    value = F.col(f"`{text}`")
    spans, units = fresh_name(matched, "_spans"), fresh_name(matched, "_units")
    long = F.filter("hit_ranges", lambda r: F.get(r, F.lit(1)) - F.get(r, F.lit(0)) >= min_words)
    split = F.when(F.size(spans) > 0, F.regexp_extract_all(value, F.lit(f"[{NO_WORD}]*[^{NO_WORD}]+"), F.lit(0)))

    def end(at: Column) -> Column:
        return F.coalesce(F.get(F.get(F.col(spans), at), F.lit(1)), F.lit(0)).cast("int")

    def words(first: Column, to: Column) -> Column:
        return F.array_join(F.slice(units, first + 1, to - first), "")

    def before(span: Column, at: Column) -> Column:
        start = F.get(span, F.lit(0)).cast("int")
        return F.concat(words(end(at - 1), start), F.regexp_extract(F.get(F.col(units), start), f"^[{NO_WORD}]*", 0))

    rest = words(end(F.size(spans) - 1), F.size(units))
    tail = F.substring(value, F.length(F.array_join(units, "")) + 1, F.length(value))
    clean = F.concat(F.array_join(F.transform(spans, before), ""), rest, tail)
    clean = F.when(_hit_words() > F.col("n_words") * max_share, "").when(F.size(spans) > 0, clean).otherwise(value)
    return matched.withColumn(spans, long).withColumn(units, split).withColumn("clean_text", clean).drop(spans, units)
