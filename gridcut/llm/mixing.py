"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcut.llm.common import stored

#: A source's documents are dealt by key into ranges of about so many; only one range of a source is sorted.
ROWS_PER_RANGE = 2_000
#: Up to so many bytes of source names and figures are broadcast; beyond it the join is salted.
BROADCAST_BYTES, SALTS = 16 << 20, 64
#: Parts of the table of sources, each of which is ordered in a task of its own.
SOURCE_PARTS = 32


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) drawn from the md5 of the seed and the parts, the same in every run."""
    told = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    head = F.conv(F.substring(F.md5(told.cast("binary")), 1, 13), 16, 10).cast("double")
    return (head + 0.5) / float(1 << 52)


def quality_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """All columns of `docs` and `_weight`: 2 for label 1, 0.5 for label 0, by the mean of a document's
    labels between them, 1 without a label. Documents without an id are spread over the join."""
    told = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id"))
    told = told.agg((0.5 + 1.5 * F.avg(label)).alias("_label")).withColumn("_label_salt", F.lit(0))
    spread = F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(SALTS)) + 1)
    salted = docs.withColumn("_spread", F.coalesce(spread, F.lit(0)).cast("int"))
    on = (F.col(f"`{id_col}`") == F.col("_label_id")) & (F.col("_spread") == F.col("_label_salt"))
    joined = salted.join(told, on, "left").withColumn("_weight", F.coalesce("_label", F.lit(1.0)))
    return joined.drop("_label_id", "_label", "_label_salt", "_spread")


def source_targets(sizes: DataFrame, shares: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """`sizes` (source, source_size, ..) with `source_no` from 0 and `target`.

    Sources by code point, null last, weigh `shares` in turn and share the sum of all sizes; a target
    stops at `most` times its source's size and what is above is shared again by weight. That is one
    level for all that do not stop, found by raising it until it stops none anew: each round is a sum
    over the sources. Sources are ordered in ranges of names, and the ranges' counts give the numbers.
    """
    ranged = sizes.repartitionByRange(SOURCE_PARTS, F.col("source").asc_nulls_last())
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()), "mix_sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    turn = F.col("source_no") % len(shares)
    weight = F.element_at(F.array(*[F.lit(int(s)) for s in shares]), (turn + 1).cast("int"))
    weighed = (
        ranged.join(F.broadcast(starts), "_part")
        .withColumn("source_no", (F.col("_start") + F.row_number().over(inside) - 1).cast("long"))
        .withColumn("_share", weight.cast("long"))
        .withColumn("_cap", F.col("source_size") * most)
        .drop("_part", "_start")
    )
    weighed = stored(weighed, "mix_weighed")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        stops = F.col("_cap") < F.col("_share") * F.lit(level)
        n, taken, shared = weighed.agg(
            F.count_if(stops),
            F.coalesce(F.sum(F.when(stops, F.col("_cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~stops, F.col("_share"))), F.lit(0)),
        ).first()
        if n == stopped or not shared:
            break
        level, stopped = float(total - taken) / float(shared), n
    target = F.least(F.col("_cap").cast("double"), F.col("_share") * F.lit(level))
    return weighed.withColumn("target", target).drop("_share", "_cap")


def _with_source(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """The figures of each row's source beside it; a null source is a source."""
    figures = sources.withColumnRenamed("source", "_of")
    if small:
        return rows.join(F.broadcast(figures), F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt2")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("_key", "size"), F.lit(SALTS)).cast("int"))
    on = F.col("source").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_salt2"))
    return dealt.join(figures.select("*", salts), on, "left").drop("_of", "_salt", "_salt2")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: str | None = None,
    size: str | None = None,
    shares: Sequence[int] = (5, 2, 1),
    most: int = 3,
    seed: str = "mix",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, source, size, source_size, target, epochs, taken, *keep): how many words of each document to take.

    A source's target makes `epochs` whole passes over it; the words that are left choose documents
    by Efraimidis and Spirakis: with a uniform u of its own, a document's key is -ln(u) / weight, and
    documents come in order of their keys until the words are used up, the last of them in part. So
    a source's taken words are its target rounded down. Keys come from an md5 of id, source and size:
    reruns and lost executors change nothing. Equal keys go by id, then size.

    The smallest keys are found without sorting a source: documents fall into ranges of their keys,
    ranges are summed before the shuffle, and only the one range in which the words end is sorted.
    Rows are written once, narrow (with the columns of `keep`), and read for sums and for the result.

    `size` names a column of sizes known already (null: 0), then `text` is not read. `weight` names a
    column of positive weights; without it, or where it is null, not positive or not
    finite, a document weighs 1. Null text has size 0 and null source is a source, the last one. Size
    0 takes nothing. Null ids come last among equal keys. Repeated rows are documents of their own
    (alike but for the one in which the words end). Input columns named as the added ones are not
    carried. No rows give no rows.
    """
    keep = [c for c in keep if c not in (id_col, source)]
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    w = F.when((w > 0) & (w < float("inf")), w).otherwise(1.0)
    idc, src = F.col(f"`{id_col}`"), F.col(f"`{source}`")
    carried = F.struct(idc.alias("id"), *[F.col(f"`{c}`").alias(c) for c in keep]).alias("_row")
    words = F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)) if size else word_count(F.col(f"`{text}`"))
    narrow = docs.select(carried, src.alias("source"), words.alias("size"), w.alias("_weight"))
    drawn = uniform(seed, F.col("_row.id"), F.col("source"), F.col("size"))
    rows = stored(narrow.withColumn("_key", -F.log(drawn) / F.col("_weight")), "mix_rows")

    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.greatest(F.lit(1), F.ceil(F.count("*") / ROWS_PER_RANGE)).cast("long").alias("_ranges"),
        F.avg("_weight").alias("_pace"),
    )
    words = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    sources = source_targets(sizes, shares, most).withColumn("epochs", F.least(epochs, F.lit(most)))
    sources = sources.withColumn("_left", words - F.col("epochs") * F.col("source_size"))
    sources = stored(sources, "mix_targets")
    held = sources.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 96)).first()[0] or 0
    small = held <= BROADCAST_BYTES

    share = 1 - F.exp(-F.col("_key") * F.col("_pace"))
    in_range = F.least(F.floor(share * F.col("_ranges")), F.col("_ranges") - 1).cast("long")
    ranged = _with_source(rows, sources, small).withColumn("_range", in_range)
    sums = ranged.where("_left > 0").groupBy("source_no", "_range", "_left").agg(F.sum("size").alias("_n"))
    upto = Window.partitionBy("source_no").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("_upto", F.sum("_n").over(upto)).where("_upto >= _left and _upto - _n < _left")
    ends = ends.select("source_no", F.col("_range").alias("_last"), (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_rest"))
    cut = stored(sources.join(ends, "source_no", "left"), "mix_cuts")

    dealt = _with_source(rows, cut, small).withColumn("_range", in_range)
    at_end = F.coalesce(F.col("_range") == F.col("_last"), F.lit(False))
    chosen = F.when(F.col("_range") < F.col("_last"), F.col("size")).otherwise(F.lit(0).cast("long"))
    order = ["_key", F.col("_row.id").asc_nulls_last(), "size"]
    running = Window.partitionBy("source_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_rest") - F.coalesce(F.sum("size").over(running), F.lit(0))
    partly = F.greatest(F.least(room, F.col("size")), F.lit(0)).cast("long")
    mixed = dealt.where(~at_end).withColumn("_more", chosen).unionByName(dealt.where(at_end).withColumn("_more", partly))
    return mixed.select(
        F.col("_row.id").alias(id_col),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        "epochs",
        (F.col("epochs") * F.col("size") + F.col("_more")).cast("long").alias("taken"),
        *[F.col(f"_row.`{c}`").alias(c) for c in keep if c.lower() not in _ADDED],
    )


_ADDED = {"size", "source_size", "target", "epochs", "taken"}


def expanded(mixed: DataFrame) -> DataFrame:
    """A row for each time a document is taken: `pass_no` from 0, and `words`, its first words to use."""
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = mixed.where("taken > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0), times - 1)))
    return rows.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("pass_no") * F.col("size")))
