"""Packing documents into training sequences by cutting-stock column generation."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcut.llm.common import arrow_rows, numbered, stored

#: Tokens of a length class; a pattern is a choice of classes whose sizes fill a sequence.
CLASS = 8
#: A pattern must fill so much of its sequence with tokens; pieces of the others are laid end to end and cut.
LEAST_FILL = 0.99
#: A plan is good enough if it needs no more than this part above the sequences that the pieces fill.
ENOUGH = 0.0005
#: Pre-tokens and white-space chunks whose ids a worker keeps, and as many that it met before those and may forget.
PIECES_KEPT, CHUNKS_KEPT = 200_000, 300_000


class Recent(dict):
    """Values made once for a key; when `room` are kept, the older half is what was not asked for since."""

    def __init__(self, make: Callable[[str], bytes], room: int):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.make, self.room = make, room

    def __missing__(self, key: str) -> bytes:
        made = self.older.pop(key, None)
        if made is None:
            made = self.make(key)
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        self[key] = made
        return made


class Encoder:
    """Ids of a word-level BPE tokenizer file, each distinct chunk between white space encoded once.

    Texts of Latin-1 characters without control characters or special tokens take the short way:
    such a text lowers and splits alike here and in the tokenizer, and no pre-token spans white
    space, so a new chunk's pre-tokens go straight to the tokenizer's model. Other texts go through
    the tokenizer as a whole.
    """

    _plain = re.compile(r"[\n\r\t\x20-\x7e\xa1-\xac\xae-\xff]*")
    _piece = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, pieces: int = PIECES_KEPT, chunks: int = CHUNKS_KEPT):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        self.pieces = Recent(self._piece_ids, pieces)
        self.chunks = Recent(self._chunk_ids, chunks)

    def _piece_ids(self, piece: str) -> bytes:
        marks = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.whole.model.tokenize(marks)]).tobytes()

    def _chunk_ids(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self.pieces[chunk]
        return b"".join(map(self.pieces.__getitem__, self._piece.findall(chunk)))

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if "<|" in text or not self._plain.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Plan:
    """Patterns with class counts (by unit size), how often each is used, and what they leave over."""

    patterns: np.ndarray
    used: np.ndarray
    left: np.ndarray


def best_pattern(prices: np.ndarray) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the dearest choice of sizes 1..n (prices[i] for size i + 1) within n.

    Only sizes with a price are tried.
    """
    n = len(prices)
    priced = np.flatnonzero(prices > 0)
    sizes, worth = priced + 1, prices[priced]
    best, last = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    reach = np.searchsorted(sizes, np.arange(n + 1), side="right").tolist()
    for room in range(1, n + 1):
        best[room] = best[room - 1]
        if reach[room]:
            within = worth[: reach[room]] + best[room - sizes[: reach[room]]]
            k = int(within.argmax())
            if within[k] > best[room]:
                best[room], last[room] = within[k], sizes[k]
    chosen, room = np.zeros(n, np.int64), n
    while room > 0:
        if last[room]:
            chosen[last[room] - 1] += 1
            room -= last[room]
        else:
            room -= 1
    return float(best[n]), chosen


def plan_patterns(demand: np.ndarray, rounds: int = 4000) -> Plan:
    """Fewest sequences for `demand[i]` pieces of size i + 1 in sequences of len(demand) units.

    The linear program's basis starts with one pattern for each size that is asked for. Its dual
    values price the sizes, the knapsack finds the pattern that is worth most, and it replaces a
    basis pattern as in the simplex method, until none is worth more than a sequence (any basis on
    the way is a valid plan, so stopping after `rounds` only costs room). Counts are rounded down.
    """
    n = len(demand)
    sizes = np.flatnonzero(demand > 0)
    if not len(sizes):
        return Plan(np.zeros((0, n), np.int64), np.zeros(0, np.int64), demand.astype(np.int64))
    basis = np.zeros((len(sizes), len(sizes)))
    np.fill_diagonal(basis, n // (sizes + 1))
    inverse = np.diag(1.0 / np.diag(basis))
    count = inverse @ demand[sizes]
    filled = demand[sizes] @ (sizes + 1) / n
    for turn in range(rounds):
        if count.sum() <= (1 + ENOUGH) * filled:
            break
        if turn % 200 == 199:
            inverse = np.linalg.inv(basis)
            count = np.maximum(inverse @ demand[sizes], 0)
        prices = np.zeros(n)
        prices[sizes] = np.maximum(inverse.sum(axis=0), 0)
        worth, chosen = best_pattern(prices)
        if worth <= 1 + 1e-7:
            break
        column = chosen[sizes].astype(float)
        moves = inverse @ column
        ratio = np.full(len(sizes), np.inf)
        np.divide(count, moves, out=ratio, where=moves > 1e-9)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        count -= ratio[out] * moves
        count[out] = ratio[out]
        count = np.maximum(count, 0)
        basis[:, out] = column
        row = inverse[out] / moves[out]
        inverse -= np.outer(moves, row)
        inverse[out] = row
    patterns = np.zeros((len(sizes), n), np.int64)
    patterns[:, sizes] = np.rint(basis.T).astype(np.int64)
    used = np.floor(count + 1e-6).astype(np.int64)
    left = demand.astype(np.int64) - used @ patterns
    while (left < 0).any():  # rounding in the basis gave a place too many
        short = int(np.flatnonzero(left < 0)[0])
        holder = int(np.flatnonzero((patterns[:, short] > 0) & (used > 0))[0])
        used[holder] -= 1
        left = left + patterns[holder]
    return Plan(patterns, used, left)


_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text: str, kept: tuple[int, int]
) -> DataFrame:
    """Documents as ids with `end_id` after them, cut at multiples of `capacity` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, kept)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for doc, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoder.ids(value or "") + end
                    for start in range(0, len(ids) // 4, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece))
                cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
                kinds = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_PIECES.names
                )

    narrow = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`"))
    return narrow.mapInArrow(run, _PIECES)


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(path: str, kept: tuple[int, int]) -> Encoder:
    """One encoder for a Python worker, so that what it knows serves the next task too."""
    if (path, kept) not in _ENCODERS:
        _ENCODERS[path, kept] = Encoder(path, *kept)
    return _ENCODERS[path, kept]


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text: str = "text",
    kept: tuple[int, int] = (PIECES_KEPT, CHUNKS_KEPT),
) -> DataFrame:
    """Pieces (uid, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    Full pieces fill a sequence each. What is left of a document has a length class of CLASS tokens;
    the histogram of classes with their tokens (its size is fixed by `capacity`) is all that the
    driver gets. Column generation plans patterns for it, and the n-th document of a class takes the
    n-th place that the patterns offer the class. Pieces beyond the patterns, and those of patterns
    that the classes' mean tokens fill below LEAST_FILL, are laid end to end in order and cut where a
    sequence ends; so are very short pieces, most of whose class is room.

    Null or empty text is a document of `end_id` alone. Null ids and repeated rows are documents of
    their own. No rows give no rows. Other columns are not carried. `kept` bounds what a Python worker
    remembers (pre-tokens, chunks), at some 250 bytes each and for two ages.
    """
    units = capacity // CLASS
    whole = F.col("length") == capacity
    pieces = tokenized_pieces(docs, tokenizer, end_id, capacity, id_col, text, kept)
    pieces = pieces.withColumn("uid", F.monotonically_increasing_id()).withColumn(
        "size", F.when(whole, 0).otherwise(F.ceil(F.col("length") / CLASS)).cast("int")
    )
    with arrow_rows(docs.sparkSession, 500):
        pieces = stored(pieces, "pieces")
    by_size = pieces.groupBy("size").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"))
    counts, tokens = np.zeros(units + 1, np.int64), np.zeros(units + 1)
    for r in by_size.collect():
        counts[r["size"]], tokens[r["size"]] = r["n"], r["tokens"]
    n_full, mean = int(counts[0]), tokens / np.maximum(counts, 1)
    plan = plan_patterns(counts[1:])
    good = (plan.patterns @ mean[1:] >= LEAST_FILL * capacity) & (plan.used > 0)
    patterns, used = plan.patterns[good], plan.used[good]
    ranked = stored(numbered(pieces.drop("ids"), ["size"], ["uid"], "rank"), "ranked_pieces")
    out = ["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = ranked.where("size = 0").select(*out[:-2], F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = _place(ranked.where("size > 0"), patterns, used, n_full)
    inside = Window.partitionBy("sequence_id").orderBy("size", "rank").rowsBetween(Window.unboundedPreceding, -1)
    fitted = placed.where("sequence_id is not null").withColumn(
        "offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")
    )
    rest = stored(placed.where("sequence_id is null").drop("sequence_id"), "rest_pieces")
    laid = _laid_end_to_end(rest, pieces, n_full + int(used.sum()), capacity)
    return full.unionByName(fitted.select(*out)).unionByName(laid.select(*out))


def _place(ranked: DataFrame, patterns: np.ndarray, used: np.ndarray, first: int) -> DataFrame:
    """`sequence_id` of the place that a class's patterns offer its rank-th piece; null beyond them."""
    bases = first + np.concatenate([[0], np.cumsum(used)[:-1]]) if len(used) else np.zeros(0, np.int64)
    offers = {}
    for k in range(patterns.shape[1]):
        own = np.flatnonzero(patterns[:, k])
        each = patterns[own, k]
        offers[k + 1] = np.cumsum(each * used[own]), each, bases[own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            found = np.full(len(size), -1, np.int64)
            for k in np.unique(size).tolist():
                ends, each, base = offers[k]
                at = np.flatnonzero(size == k)
                which = np.searchsorted(ends, rank[at], side="right")
                at, which = at[which < len(ends)], which[which < len(ends)]
                begun = ends[which] - each[which] * used_of(ends, each)[which]
                found[at] = base[which] + (rank[at] - begun) // each[which]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.int64(), mask=found < 0)], names=[*batch.schema.names, "sequence_id"]
            )

    def used_of(ends: np.ndarray, each: np.ndarray) -> np.ndarray:
        return np.diff(ends, prepend=0) // each

    schema = T.StructType([*ranked.schema.fields, T.StructField("sequence_id", T.LongType())])
    return ranked.mapInArrow(run, schema)


#: Up to so many cut pieces are broadcast to the stored ids; beyond it the join shuffles.
BROADCAST_CUTS = 500_000


def _laid_end_to_end(rest: DataFrame, pieces: DataFrame, first: int, capacity: int) -> DataFrame:
    """Pieces in order of size and rank, one after another from sequence `first` on, cut at its end.

    Positions add up three running sums: over sizes, over stretches of ranks within a size, and
    within a stretch, so no task holds a size. Only pieces that are cut fetch their ids again.
    """
    dealt = rest.withColumn("stretch", F.floor(F.col("rank") / 4096))
    stretches = dealt.groupBy("size", "stretch").agg(F.sum("length").alias("n"))
    sizes = stretches.groupBy("size").agg(F.sum("n").alias("n"))
    before = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("to_size"))
    before = Window.partitionBy("size").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = stretches.select("size", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("to_stretch"))
    inside = Window.partitionBy("size", "stretch").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("to_size") + F.col("to_stretch") + F.coalesce(F.sum("length").over(inside), F.lit(0))
    lying = dealt.join(starts, ["size", "stretch"]).join(F.broadcast(sizes), "size").withColumn("at", at)
    cut = lying.withColumn(
        "part", F.explode(F.sequence(F.floor(F.col("at") / capacity), F.floor((F.col("at") + F.col("length") - 1) / capacity)))
    )
    low = F.greatest(F.col("at"), F.col("part") * capacity)
    high = F.least(F.col("at") + F.col("length"), (F.col("part") + 1) * capacity)
    cut = stored(
        cut.select(
            "uid", "doc_id", "ids_crc32", "doc_tokens",
            (low - F.col("at")).alias("skipped"),
            (F.col("start") + low - F.col("at")).alias("start"),
            (high - low).alias("length"),
            (high - low < F.col("length")).alias("in_parts"),
            (F.col("part") + first).alias("sequence_id"),
            (low - F.col("part") * capacity).alias("offset"),
        ),
        "rest_cut",
    )
    parts = cut.where("in_parts").drop("ids_crc32")
    if parts.count() <= BROADCAST_CUTS:
        parts = F.broadcast(parts)
    again = pieces.select("uid", "ids").join(parts, "uid")
    bytes_of = F.expr("substring(ids, cast(4 * skipped + 1 as int), cast(4 * length as int))")
    return cut.where("not in_parts").unionByName(again.withColumn("ids_crc32", F.crc32(bytes_of)).drop("ids"))
