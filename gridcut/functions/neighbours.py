"""Previous / next row per entity without putting a whole entity into one task.

A plain `lag` over (entity order by time) sorts all rows of an entity in one task. Here rows are
windowed per (entity, civil day) and only one edge row per day is compared across days, so a very
long or very dense entity is still spread over the cluster. The result equals the plain window.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    *,
    previous: dict[str, Column | str] | None = None,
    following: dict[str, Column | str] | None = None,
) -> DataFrame:
    """Add columns taken from the previous / next row of the same key in `ts` order.

    `previous={"prev_ts": "din_instante"}` adds the timestamp of the preceding row.
    Rows of one key must have distinct `ts` values (aggregate duplicates first).
    """
    previous, following = previous or {}, following or {}
    day = "__day"
    rows = df.withColumn(day, F.to_date(ts))
    inner = Window.partitionBy(*keys, day).orderBy(ts)
    wanted = {}
    if previous:
        wanted["__p"] = (previous, F.lag, -1)
    if following:
        wanted["__f"] = (following, F.lead, 1)
    for name, (cols, shift, _) in wanted.items():
        payload = F.struct(*[_as_col(c).alias(k) for k, c in cols.items()])
        rows = rows.withColumn(name + "v", payload)
        rows = rows.withColumn(name, shift(name + "v").over(inner))
    # One edge row per (key, day): the only rows that cross a day border.
    edges = rows.groupBy(*keys, day).agg(
        *([F.max_by("__pv", ts).alias("__pe")] if previous else []),
        *([F.min_by("__fv", ts).alias("__fe")] if following else []),
    )
    outer = Window.partitionBy(*keys).orderBy(day)
    carried = edges.select(
        *keys,
        day,
        *([F.lag("__pe").over(outer).alias("__pc")] if previous else []),
        *([F.lead("__fe").over(outer).alias("__fc")] if following else []),
    )
    joined = rows.join(carried, [*keys, day], "left")
    out = [F.col(c) for c in df.columns]
    if previous:
        take = F.when(F.col("__p").isNotNull(), F.col("__p")).otherwise(F.col("__pc"))
        out += [take.getField(k).alias(k) for k in previous]
    if following:
        take = F.when(F.col("__f").isNotNull(), F.col("__f")).otherwise(F.col("__fc"))
        out += [take.getField(k).alias(k) for k in following]
    return joined.select(*out)


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
