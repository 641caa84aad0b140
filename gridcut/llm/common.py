"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcut.session import stored

#: White space of the text rules: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Each byte of UTF-8 as the word rule sees it: letters lowered, digits and non-ASCII kept, the rest a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def word_bytes(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text after A-Z are lowered; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for the jobs that run inside, where a row holds a whole text; the session
    has its own setting again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[str | None]:
    """The texts of a column one by one, so that a task holds one as a Python object at a time."""
    return (x.as_py() for x in batch.column(batch.schema.names.index(column)))


def append_columns(
    df: DataFrame,
    added: T.StructType,
    compute: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]],
) -> DataFrame:
    """Columns computed from whole Arrow batches, beside all input columns.

    An input column whose name an added column bears (in any case) is replaced by it.
    """
    taken = {n.lower() for n in added.names}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]) if any(
        c.lower() in taken for c in df.columns
    ) else df
    schema = T.StructType([*kept.schema.fields, *added.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, new in compute(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)
        # the worker lives on for other tasks: what this one's batches held goes back
        pa.default_memory_pool().release_unused()

    return kept.mapInArrow(run, schema)


def fresh_name(df: DataFrame, name: str) -> str:
    """The name, or one with underscores before it that no column of `df` bears in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold_of(id_col: Column, parts: int) -> Column:
    """crc32 of an id written as text, modulo the number of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str, buckets: int = 256) -> DataFrame:
    """Gapless numbers from 0 within each group, without bringing a group into one task.

    Rows fall into hash buckets of `order`; a bucket's first number is the count of the buckets
    before it (one row per group and bucket), and rows are numbered inside their bucket. `rows` is
    read twice, so it should be a stored table; `order` should tell rows apart.
    """
    from pyspark.sql import Window

    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*group, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_row", F.row_number().over(inside) - 1)
    return (
        ranked.join(starts, [*group, "_bucket"])
        .withColumn(name, (F.col("_start") + F.col("_row")).cast("long"))
        .drop("_bucket", "_start", "_row")
    )


__all__ = ["LOWER", "UPPER", "WHITE", "append_columns", "arrow_rows", "fold_of", "fresh_name", "numbered", "stored", "texts_of", "word_bytes"]
