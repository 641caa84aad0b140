"""Exact ordered totals, medians and top-n over groups too large for one task.

`sum() over (partition by source order by score)` would sort a whole source in one task, and there
are only two sources. These helpers split every group into ordered value ranges, total the ranges
(a table of a few thousand rows), and window only inside a range.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLUTION = 65_536


BEFORE_ALL = -(2**60)


def _ranges(value: Column) -> tuple[Column, Column]:
    """Two whole numbers that never decrease with the value: a value range and a part of it.

    Ranges are about 1.5e-5 wide at zero and grow with the magnitude. The part splits by relative
    size (1/4096 of a doubling), so scores crowded next to zero are spread as well.
    """
    coarse = F.floor(F.signum(value) * F.log1p(F.abs(value)) * RESOLUTION)
    relative = F.floor(F.log2(F.abs(value)) * 4096)
    fine = F.when(value > 0, relative).when(value < 0, -relative).otherwise(F.lit(BEFORE_ALL))
    return coarse, fine


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    totals: dict[str, str],
    *,
    descending: bool = True,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Running sum of columns in `order` within `keys`, plus `<name>_all`, the group's sum.

    `totals` maps new column -> summed column. `(keys, order, ties)` must be unique; `ties` break
    equal `order` values ascending. The table of range totals is bounded by the resolution (some
    ten thousand ranges for scores in [0, 1]) whatever the number of rows. Both uses of `df` read
    the same columns, so its last shuffle is run once.
    """
    coarse, fine = _ranges(F.col(order))
    rows = df.withColumns({"__c": coarse, "__d": fine})
    group = [*keys, "__c", "__d"]
    per_range = rows.groupBy(*group).agg(
        *[F.sum(c).alias(f"__s_{n}") for n, c in totals.items()]
    )

    def arrow(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    across_all = Window.partitionBy(*keys)
    across = across_all.orderBy(arrow("__c"), arrow("__d")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    offsets = per_range.select(
        *group,
        *[(F.sum(f"__s_{n}").over(across) - F.col(f"__s_{n}")).alias(f"__o_{n}") for n in totals],
        *[F.sum(f"__s_{n}").over(across_all).alias(f"{n}_all") for n in totals],
    )
    inside = (
        Window.partitionBy(*group)
        .orderBy(arrow(order), *[F.col(t).asc() for t in ties])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.join(offsets, group)
        .select(
            *df.columns,
            *[(F.col(f"__o_{n}") + F.sum(c).over(inside)).alias(n) for n, c in totals.items()],
            *[f"{n}_all" for n in totals],
        )
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per key; equal values are counted before the shuffle."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    ranked = running_totals(counts, keys, value, {"__cum": "__n"}, descending=False)
    lower = F.floor((F.col("__cum_all") - 1) / 2)
    upper = F.floor(F.col("__cum_all") / 2)
    before = F.col("__cum") - F.col("__n")

    def at(rank: Column) -> Column:
        return F.max(F.when((before <= rank) & (rank < F.col("__cum")), F.col(value)))

    return ranked.groupBy(*keys).agg(((at(lower) + at(upper)) / 2).alias(name))


def take_first(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[tuple[str, bool]],
    budget: DataFrame,
    budget_column: str,
) -> DataFrame:
    """First `budget` rows of each key in lexicographic `order`, found without a global sort.

    `order` lists (column, descending); NULL ranks first when descending, last otherwise. Column by
    column the value where the budget runs out is located from counts, so only distinct values of
    one column are ever ordered together. `(keys, order)` must be unique per row.
    """
    cut = budget.select(*keys, F.col(budget_column).alias("__left")).where("__left > 0")
    marks: list[str] = []
    for column, descending in order:
        done = [c for c, _ in order[: len(marks)]]
        renamed = cut.select(
            *[F.col(k).alias(f"__key_{k}") for k in keys], *marks, "__left"
        )
        on = [F.col(k) == F.col(f"__key_{k}") for k in keys]
        on += [F.col(c).eqNullSafe(F.col(m)) for c, m in zip(done, marks, strict=True)]
        condition = on[0]
        for extra in on[1:]:
            condition = condition & extra
        candidates = df.join(renamed, condition)
        counts = candidates.groupBy(*keys, *marks, "__left", column).agg(
            F.count(F.lit(1)).alias("__n")
        )
        direction = F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last()
        w = (
            Window.partitionBy(*keys)
            .orderBy(direction)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        last = Window.partitionBy(*keys)
        upto = counts.withColumn("__upto", F.sum("__n").over(w)).withColumn(
            "__total", F.sum("__n").over(last)
        )
        mark = f"__m{len(marks)}"
        reach = F.least(F.col("__left"), F.col("__total"))
        cut = (
            upto.where((F.col("__upto") >= reach) & (F.col("__upto") - F.col("__n") < reach))
            .select(
                *keys,
                *marks,
                F.col(column).alias(mark),
                (reach - (F.col("__upto") - F.col("__n"))).alias("__left"),
            )
        )
        marks.append(mark)
    limit = cut.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *marks)
    join_on = F.lit(True)
    for k in keys:
        join_on = join_on & (F.col(k) == F.col(f"__key_{k}"))
    keep = F.lit(True)
    for (column, descending), mark in reversed(list(zip(order, marks, strict=True))):
        keep = _precedes(column, mark, descending) | (
            F.col(column).eqNullSafe(F.col(mark)) & keep
        )
    return df.join(limit, join_on).where(keep).select(*df.columns)


def _precedes(column: str, mark: str, descending: bool) -> Column:
    value, edge = F.col(column), F.col(mark)
    if descending:
        return F.coalesce(value > edge, value.isNull() & edge.isNotNull())
    return F.coalesce(value < edge, value.isNotNull() & edge.isNull())
