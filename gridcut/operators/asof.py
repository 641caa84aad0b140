"""Backward as-of join: the latest table row at or before each probe, per key."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_TASK = 500_000


def tasks_for(rows: int) -> int:
    """Partitions that keep a task's share the same at any size of the input."""
    return 1 + rows // ROWS_PER_TASK


def asof_backward(
    probes: DataFrame,
    table: DataFrame,
    by: Sequence[str],
    on: str,
    columns: Sequence[str],
    *,
    bucket: str = "month",
    partitions: int | None = None,
) -> DataFrame:
    """Left as-of join, inclusive, taking the whole matched row (its NULLs stay NULL).

    Both sides are stacked and windowed once per (key, calendar bucket); the last row of earlier
    buckets is carried over from a table with one row per (key, bucket). No cartesian product, and
    one key's rows are spread over its buckets. `(by, on)` must be unique in `table`.

    `partitions` says into how many parts the stacked rows are dealt; a caller that knows its rows sets
    it (`tasks_for`), so that a task's memory does not follow the input. Without it the session decides.
    """
    parts = [partitions] if partitions else []
    extra = [c for c in probes.columns if c not in {*by, on}]
    stacked = (
        table.select(
            *by,
            on,
            F.lit(0).alias("__side"),
            F.struct(*columns).alias("__row"),
            F.lit(None).cast(_struct_type(probes, extra, "`__is`:boolean")).alias("__probe"),
        )
        .unionByName(
            probes.select(
                *by,
                on,
                F.lit(1).alias("__side"),
                F.lit(None).cast(_struct_type(table, columns)).alias("__row"),
                F.struct(*[F.col(c) for c in extra], F.lit(True).alias("__is")).alias("__probe"),
            )
        )
        .withColumn("__bucket", F.date_trunc(bucket, F.col(on)))
        .repartition(*parts, *by, "__bucket")
    )
    inside = (
        Window.partitionBy(*by, "__bucket")
        .orderBy(on, "__side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = stacked.withColumn("__hit", F.last("__row", ignorenulls=True).over(inside))
    per_bucket = stacked.groupBy(*by, "__bucket").agg(
        F.max_by("__row", F.when(F.col("__side") == 0, F.col(on))).alias("__last"),
        F.count("__probe").alias("__probes"),
    )
    across = (
        Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        per_bucket.repartition(*parts, *by)
        .withColumn("__carry", F.last("__last", ignorenulls=True).over(across))
        .where("__probes > 0")
        .select(*by, "__bucket", "__carry")
        .repartition(*parts, *by, "__bucket")
    )
    matched = local.where("__probe is not null").join(carried, [*by, "__bucket"], "left")
    hit = F.when(F.col("__hit").isNotNull(), F.col("__hit")).otherwise(F.col("__carry"))
    return matched.select(
        *by,
        on,
        *[F.col("__probe").getField(c).alias(c) for c in extra],
        *[hit.getField(c).alias(c) for c in columns],
    )


def _struct_type(df: DataFrame, columns: Sequence[str], *more: str) -> str:
    fields = [f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in columns]
    return "struct<" + ",".join([*fields, *more]) + ">"
