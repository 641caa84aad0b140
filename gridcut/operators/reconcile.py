"""Reconciliation of the snapshot with a later official publication."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcut.functions.scalars import (
    any_of,
    changed,
    count_if,
    is_finite,
    is_true,
    label_or_null,
    month_label,
    ratio,
)
from gridcut.schemas import LABELS, MEASURES, OBS_KEY

FORMULA_TOLERANCE_MW = 0.001
ENERGY_TOLERANCE_MWH = 0.0005
PUBLISHED = "val_geracaonaorealizadaapurada"


def formula_validation(official: DataFrame) -> DataFrame:
    """Published shortfall against `max(reference - generation, 0)`, zero without a limit."""
    limit, reference, generation = (F.col(c) for c in MEASURES)
    published = F.col(PUBLISHED)
    computable = is_true(is_finite(reference) & is_finite(generation)) & F.coalesce(
        is_finite(limit), F.lit(True)
    )
    formula = F.when(limit.isNull(), F.lit(0.0)).otherwise(
        F.greatest(reference - generation, F.lit(0.0))
    )
    gap = F.abs(published - formula)
    both = published.isNotNull() & computable
    return official.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(published).alias("published_nonnull"),
        count_if(both).alias("comparable"),
        count_if(both & (gap > FORMULA_TOLERANCE_MW)).alias("different_over_001_mw"),
        F.max(F.when(both, gap)).alias("max_difference_mw"),
        count_if(limit.isNotNull() & published.isNull()).alias("limited_missing_published"),
    )


def revision_check(local: DataFrame, official: DataFrame, modified: DataFrame | None = None):
    """Row-by-row comparison of two publications on the full key, by source and month.

    `modified` may add (fonte, period, last_modified). A label published as '' equals NULL.
    """
    payload = [*MEASURES, *LABELS, "energia_mwh"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*OBS_KEY, F.struct(*payload).alias(name))

    rows = side(local, "l").join(side(official, "o"), OBS_KEY, "full")
    in_l, in_o = F.col("l").isNotNull(), F.col("o").isNotNull()
    both = in_l & in_o
    numeric = any_of([changed(f"l.{c}", f"o.{c}") for c in MEASURES])
    label = any_of([changed(label_or_null(f"l.{c}"), label_or_null(f"o.{c}")) for c in LABELS])
    energy_l, energy_o = F.col("l.energia_mwh"), F.col("o.energia_mwh")
    energy = (energy_l.isNull() != energy_o.isNull()) | is_true(
        F.abs(energy_l - energy_o) > ENERGY_TOLERANCE_MWH
    )
    out = rows.groupBy("fonte", month_label("din_instante").alias("period")).agg(
        count_if(in_l).alias("local_rows"),
        count_if(in_o).alias("official_rows"),
        count_if(in_l & ~in_o).alias("only_local"),
        count_if(in_o & ~in_l).alias("only_official"),
        count_if(both).alias("matched"),
        count_if(both & (numeric | label)).alias("changed_inputs"),
        count_if(both & numeric).alias("changed_numeric"),
        count_if(both & label).alias("changed_labels"),
        count_if(both & energy).alias("changed_energy"),
        F.sum(energy_l - energy_o).alias("matched_delta_mwh"),
    )
    if modified is not None:
        out = out.join(modified.select("fonte", "period", "last_modified"), ["fonte", "period"], "left")
    suspicious = ["only_local", "only_official", "changed_inputs", "changed_energy"]
    return out.withColumn("revised", any_of([F.col(c) > 0 for c in suspicious]))


def revisions_by_year(revisions: DataFrame) -> DataFrame:
    sums = (
        "matched only_local only_official changed_numeric changed_labels changed_energy "
        "matched_delta_mwh"
    ).split()
    return revisions.groupBy("fonte", F.substring("period", 1, 4).alias("ano")).agg(
        F.count(F.lit(1)).alias("meses"),
        count_if(F.col("revised")).alias("meses_revisados"),
        *[F.sum(c).alias(c) for c in sums],
    )


def published_energy() -> Column:
    """Published values are usually NULL outside limitation; only there NULL means zero."""
    return F.when(F.col("val_geracaolimitada").isNull(), F.lit(0.0)).otherwise(
        F.col(PUBLISHED) * 0.5
    )


def delta_columns(a: Column, b: Column, unknown_a: Column, unknown_b: Column) -> dict[str, Column]:
    """Totals with unknown volumes on either side are not equivalent, so they get no delta."""
    clear = (F.coalesce(unknown_a, F.lit(0)) == 0) & (F.coalesce(unknown_b, F.lit(0)) == 0)
    delta = F.when(clear, a - b)
    return {
        "delta_mwh": delta,
        "delta_percent": ratio(delta, b) * 100,
        "totals_comparable": delta.isNotNull(),
    }


TOTAL_DIMENSIONS = {
    "fonte": ["fonte", "year"],
    "year": ["fonte", "year"],
    "causa": ["fonte", "year", "causa"],
    "id_estado": ["fonte", "year", "id_estado"],
    "id_subsistema": ["fonte", "year", "id_subsistema"],
}


def _totals(df: DataFrame, energy: Column, brute: Column | None) -> DataFrame:
    """Totals of one publication for all five comparisons, from one pass over its rows."""
    finest = (
        df.withColumn("year", F.year("din_instante"))
        .withColumn("__mwh", energy)
        .groupBy("fonte", "year", "causa", "id_estado", "id_subsistema")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            count_if(F.col("__mwh").isNull()).alias("unknown"),
            F.sum("__mwh").alias("mwh"),
            *([F.sum(brute).alias("brute_mwh")] if brute is not None else []),
        )
    )
    sums = ["rows", "unknown", "mwh"] + (["brute_mwh"] if brute is not None else [])
    levels = F.array(
        *[
            F.struct(
                F.lit(name).alias("dimension"),
                (F.col(dims[2]) if len(dims) > 2 else F.lit(None)).cast("string").alias("value"),
            )
            for name, dims in TOTAL_DIMENSIONS.items()
        ]
    )
    return (
        finest.select("fonte", "year", *sums, F.inline(levels))
        .groupBy("dimension", "fonte", "year", "value")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )


def totals_comparison(local: DataFrame, official: DataFrame) -> DataFrame:
    """Local and official totals side by side; both sides' unmatched groups are kept."""
    keys = ["dimension", "fonte", "year", "value"]
    a = _totals(local, F.col("energia_mwh"), F.col("energia_bruta_mwh")).alias("a")
    b = _totals(official, published_energy(), None).alias("b")
    on = None
    for k in keys:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    joined = a.join(b, on, "full")
    return joined.select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys],
        F.col("a.rows").alias("local_rows"),
        F.col("a.unknown").alias("local_unknown"),
        F.col("a.mwh").alias("local_mwh"),
        F.col("a.brute_mwh").alias("local_brute_mwh"),
        F.col("b.rows").alias("official_rows"),
        F.col("b.unknown").alias("official_unknown"),
        F.col("b.mwh").alias("official_mwh"),
        *[
            expr.alias(name)
            for name, expr in delta_columns(
                F.col("a.mwh"), F.col("b.mwh"), F.col("a.unknown"), F.col("b.unknown")
            ).items()
        ],
    )


def side_by_side(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Summary tables with the same key joined into one wide table."""
    out = tables[0]
    for table in tables[1:]:
        out = out.join(table, list(keys))
    return out
