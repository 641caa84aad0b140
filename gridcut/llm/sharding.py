"""Shards of near equal bytes: a k-d tree over metadata, split at distributed weighted medians."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcut.llm.common import numbered, stored

#: Groups of more than this part of a shard's target are placed one by one (at most shards / PART of them).
PART = 0.01
#: Bins of a histogram, and the part of a shard's target that a cut may be off.
BINS, SLACK = 1024, 0.002
#: Hashes are taken modulo this when they order groups that agree in every dimension.
TIES = 1 << 40
#: Up to so many distinct values of a dimension (40 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_CODES = 200_000


@dataclass
class Node:
    """Shards first..last-1. Once split: values below `cut` along `dim` go to the left, and of those
    that equal it the ones with a hash below `tie`."""

    first: int
    last: int
    dim: str | None = None
    cut: float = 0.0
    tie: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else [*self.left.leaves(), *self.right.leaves()]

    def locate(self) -> Column:
        """The first shard of the leaf that a row falls into."""
        if self.left is None:
            return F.lit(self.first)
        at = F.col(self.dim)
        left = (at < F.lit(self.cut)) | ((at == F.lit(self.cut)) & (F.col("tie") < F.lit(self.tie)))
        return F.when(left, self.left.locate()).otherwise(self.right.locate())


def _key(c: Column) -> Column:
    """Tells the values of a text column apart in 32 bytes; null has a key of its own."""
    return F.coalesce(F.md5(c), F.lit(""))


def rank_codes(docs: DataFrame, column: str) -> DataFrame:
    """(key, code): each distinct value's rank among them, from 0, null first.

    Distinct values are reduced before they are shuffled, and sorted in ranges; the ranges' counts
    (one row for each partition) give the rank that a range begins with.
    """
    values = docs.select(F.col(f"`{column}`").cast("string").alias("value")).distinct()
    ranges = values.repartitionByRange("value").sortWithinPartitions("value")
    placed = stored(ranges.select(_key(F.col("value")).alias("key"), F.monotonically_increasing_id().alias("at")), "ranked_values")
    placed = placed.select("key", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("range").agg(F.count("*").alias("n"))
    starts = starts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "range").select("key", (F.col("start") + F.col("row")).cast("double").alias("code"))


def _place_large(large: list, target: float, shards: int) -> tuple[list[tuple], list[float]]:
    """(group, first row, last row, shard) of large groups, largest first into the emptiest shard; a
    group larger than a shard's target goes in parts that fill one. And the bytes of each shard."""
    parts = []
    for g in large:
        if g["bytes"] <= target:
            parts.append((g["bytes"], g["g1"], g["g2"], 0, g["n"]))
            continue
        each = g["bytes"] / g["n"]
        pieces = int(-(-g["bytes"] // target))
        edges = [min(g["n"], round(i * target / each)) for i in range(pieces)] + [g["n"]]
        parts += [((b - a) * each, g["g1"], g["g2"], a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]
    free = [(0.0, s) for s in range(shards)]
    held, placed = [0.0] * shards, []
    for size, g1, g2, a, b in sorted(parts, key=lambda p: (-p[0], p[1:])):
        load, s = heapq.heappop(free)
        placed.append((g1, g2, a, b, s))
        held[s] = load + size
        heapq.heappush(free, (held[s], s))
    return placed, held


def _room(held: list[float], small: float) -> list[float]:
    """How much of the small groups' bytes each shard takes so that the shards level out."""
    order = sorted(held)
    level, used = 0.0, 0.0
    for k, h in enumerate(order, 1):
        level = (small + used + h) / k
        used += h
        if k == len(order) or level <= order[k]:
            break
    return [max(0.0, level - h) for h in held]


def _cuts(cells: DataFrame, nodes: dict[int, Node], dims: list[str], share: dict[int, float], spans, slack: float) -> None:
    """Splits every node along its widest dimension, at the value below which lies its share of bytes.

    Each round sums bytes in bins of the open interval, for all nodes in one job, and goes on in the
    bin in which the share is reached, until what the bin holds is within `slack`. Groups of one
    value are cut by their hash in the same way.
    """
    extent = cells.groupBy("node").agg(
        F.sum("bytes").alias("bytes"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]
    )
    todo: dict[int, _Search] = {}
    for k, node in nodes.items():
        node.dim = dims[0]
        node.left, node.right = Node(node.first, _middle(node)), Node(_middle(node), node.last)
    for r in extent.collect():
        wide = {d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / (spans[d] or 1.0) for d in dims}
        nodes[r["node"]].dim = d = max(dims, key=wide.__getitem__)
        todo[r["node"]] = _Search(r[f"lo_{d}"], r[f"hi_{d}"], share[r["node"]] * r["bytes"])
    while todo:
        asked = [(k, dims.index(nodes[k].dim), o.low, o.high, o.value) for k, o in todo.items()]
        asked = cells.sparkSession.createDataFrame(asked, "node int, dim int, low double, high double, value double")
        at = F.get(F.array(*dims), F.col("dim"))
        v = F.when(F.col("value").isNull(), at).when(at == F.col("value"), F.col("tie"))
        binned = cells.join(F.broadcast(asked), "node").withColumn("v", v).where("v between low and high")
        step = F.greatest((F.col("high") - F.col("low")) / BINS, F.lit(1e-300))
        totals = binned.groupBy("node", F.floor((F.col("v") - F.col("low")) / step).alias("bin")).agg(
            F.min("v").alias("low"), F.max("v").alias("high"), F.sum("bytes").alias("bytes")
        )
        bins: dict[int, list] = {}
        for r in totals.collect():
            bins.setdefault(r["node"], []).append((r["low"], r["high"], r["bytes"]))
        for k, o in list(todo.items()):
            if o.narrow(sorted(bins.get(k, [])), slack):
                nodes[k].cut, nodes[k].tie = (o.cut, 0.0) if o.value is None else (o.value, o.cut)
                del todo[k]


@dataclass
class _Search:
    """The open interval of one node's cut, and the bytes in it that belong to the left."""

    low: float
    high: float
    need: float
    value: float | None = None
    cut: float = 0.0

    def narrow(self, bins: list[tuple[float, float, int]], slack: float) -> bool:
        """Goes on in the bin that the cut falls into; true once the cut is found."""
        for low, high, held in bins:
            if held <= self.need:
                self.need -= held
                continue
            if held > slack and low < high:
                self.low, self.high = low, high
                return False
            if held > slack and self.value is None:
                self.value, self.low, self.high = low, 0.0, float(TIES)
                return False
            self.cut = math.nextafter(high, math.inf) if self.need > held / 2 else low
            return True
        self.cut = math.nextafter(self.high, math.inf)
        return True


def _middle(node: Node) -> int:
    return (node.first + node.last) // 2


def shard_documents(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text: str = "text", dims: tuple[str, ...] = ("lang", "source")
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) with near equal bytes in each shard.

    Size is the text's bytes and 8. Rows of equal texts form a group that stays in one shard, unless
    it is larger than a shard's share; such a group is cut into parts that fill a shard. Groups above
    PART of a share (their number is bounded by shards / PART) are placed largest first. All others
    are split by a k-d tree over log size, smallest id and the given text columns, ordered by the
    ranks of their distinct values: each level sums histograms of all open nodes, and only those sums
    reach the driver. Slots number a shard's rows
    from 0 by hashed buckets.

    Null texts have no bytes and are equal to the empty text. Null ids and repeated rows are rows
    like others. Dimensions that `docs` lacks are left out. No rows give no rows.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lower = {c.lower(): c for c in docs.columns}
    given = [lower[d.lower()] for d in dims if d.lower() in lower]
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("g1"),
        F.xxhash64(F.lit(1), body).alias("g2"),
        *[_key(F.col(f"`{d}`").cast("string")).alias(f"key{k}") for k, d in enumerate(given)],
    )
    for k, d in enumerate(given):
        codes = stored(rank_codes(docs, d), "codes")
        codes = F.broadcast(codes) if codes.count() <= BROADCAST_CODES else codes
        rows = rows.join(codes.select(F.col("key").alias(f"key{k}"), F.col("code").alias(f"dim{k}")), f"key{k}", "left")
    rows = rows.drop(*[f"key{k}" for k in range(len(given))]).withColumn("uid", F.monotonically_increasing_id())
    rows = stored(rows, "sized_rows")
    names = ["log_size", "least_id", *[f"dim{k}" for k in range(len(given))]]
    groups = rows.groupBy("g1", "g2").agg(
        F.sum("size").alias("bytes"),
        F.count("*").alias("n"),
        F.log2(F.max("size").cast("double")).alias("log_size"),
        F.coalesce(F.min("doc_id"), F.lit(-1)).cast("double").alias("least_id"),
        *[F.min(f"dim{k}").alias(f"dim{k}") for k in range(len(given))],
    )
    groups = stored(groups.withColumn("tie", F.pmod(F.xxhash64("g1", "g2"), F.lit(TIES)).cast("double")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    target = total / shards
    large = groups.where(F.col("bytes") > PART * target).select("g1", "g2", "bytes", "n").collect() if total else []
    placed, held = _place_large(large, target, shards)
    small = groups.where(F.col("bytes") <= PART * target)
    room = _room(held, total - sum(held))
    tree = _grow(small, room, names, target)
    routed = small.select("g1", "g2", tree.locate().alias("shard"))
    return _numbered_rows(rows, routed, placed, target)


def _grow(small: DataFrame, room: list[float], dims: list[str], target: float) -> Node:
    """The tree, one level of it at a time; shards without room get no leaf of their own."""
    root = Node(0, len(room))
    spread = small.agg(*[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    spans = {d: float(spread[d] or 0) for d in dims}
    while level := {n.first: n for n in root.leaves() if n.last - n.first > 1}:
        share = {
            k: (sum(room[n.first : _middle(n)]) / all_) if (all_ := sum(room[n.first : n.last])) > 0 else 0.5
            for k, n in level.items()
        }
        cells = small.withColumn("node", root.locate()).where(F.col("node").isin(list(level)))
        _cuts(cells, level, dims, share, spans, SLACK * target)
    return root


def _numbered_rows(rows: DataFrame, routed: DataFrame, placed: list[tuple], target: float) -> DataFrame:
    spark = rows.sparkSession
    kind = "g1 long, g2 long, first long, last long, shard int"
    several = {p[:2] for p in placed if p[2] > 0}
    single = spark.createDataFrame([p for p in placed if p[:2] not in several], kind).select("g1", "g2", "shard")
    parts = F.broadcast(spark.createDataFrame([p for p in placed if p[:2] in several], kind))
    large = spark.createDataFrame(sorted({p[:2] for p in placed}), "g1 long, g2 long")
    narrow = rows.select("doc_id", "size", "text_crc32", "g1", "g2", "uid")
    # rows of large groups (at most shards / PART of them) never shuffle by their group
    easy = narrow.join(F.broadcast(large), ["g1", "g2"], "left_anti").join(routed, ["g1", "g2"])
    easy = easy.unionByName(narrow.join(F.broadcast(single), ["g1", "g2"]))
    out = easy.select("doc_id", "size", "text_crc32", "uid", "shard")
    if several:
        cut = narrow.join(F.broadcast(parts.select("g1", "g2").distinct()), ["g1", "g2"], "left_semi")
        ranked = numbered(cut, ["g1", "g2"], ["uid"], "rank").join(parts, ["g1", "g2"])
        ranked = ranked.where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
        out = out.unionByName(ranked.select(*out.columns))
    out = stored(out, "sharded_rows")
    return numbered(out, ["shard"], ["uid"], "slot").drop("uid")
