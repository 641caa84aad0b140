"""Release calendar: business days, holidays, and the last released day at any moment."""

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcut.functions.scalars import at_midnight, plus_minutes

# --- fixed values: public holidays and optional days off, 2023-2026 (date kind) --------------
CALENDAR_ENTRIES = """
2023-01-01 nacional
2023-01-20 municipal_rio
2023-02-20 facultativo_federal
2023-02-21 facultativo_federal
2023-02-22 facultativo_federal_parcial
2023-04-07 nacional
2023-04-21 nacional
2023-04-23 estadual_rio
2023-05-01 nacional
2023-06-08 facultativo_federal
2023-09-07 nacional
2023-10-12 nacional
2023-10-28 facultativo_federal
2023-11-02 nacional
2023-11-15 nacional
2023-11-20 estadual_rio
2023-12-24 facultativo_federal_parcial
2023-12-25 nacional
2023-12-31 facultativo_federal_parcial
2024-01-01 nacional
2024-01-20 municipal_rio
2024-02-12 facultativo_federal
2024-02-13 facultativo_federal
2024-02-14 facultativo_federal_parcial
2024-03-29 nacional
2024-04-21 nacional
2024-04-23 estadual_rio
2024-05-01 nacional
2024-05-30 facultativo_federal
2024-05-31 facultativo_federal
2024-09-07 nacional
2024-10-12 nacional
2024-10-28 facultativo_federal
2024-11-02 nacional
2024-11-15 nacional
2024-11-20 nacional
2024-12-24 facultativo_federal_parcial
2024-12-25 nacional
2024-12-31 facultativo_federal_parcial
2025-01-01 nacional
2025-01-20 municipal_rio
2025-03-03 facultativo_federal
2025-03-04 facultativo_federal
2025-03-05 facultativo_federal_parcial
2025-04-18 nacional
2025-04-21 nacional
2025-04-23 estadual_rio
2025-05-01 nacional
2025-05-02 facultativo_federal
2025-06-19 facultativo_federal
2025-06-20 facultativo_federal
2025-09-07 nacional
2025-10-12 nacional
2025-10-27 facultativo_federal
2025-11-02 nacional
2025-11-15 nacional
2025-11-20 nacional
2025-12-24 facultativo_federal_parcial
2025-12-25 nacional
2025-12-31 facultativo_federal_parcial
2026-01-01 nacional
2026-01-20 municipal_rio
2026-02-16 facultativo_federal
2026-02-17 facultativo_federal
2026-02-18 facultativo_federal_parcial
2026-04-03 nacional
2026-04-20 facultativo_federal
2026-04-21 nacional
2026-04-23 estadual_rio
2026-05-01 nacional
2026-06-04 facultativo_federal
2026-06-05 facultativo_federal
2026-09-07 nacional
2026-10-12 nacional
2026-10-28 facultativo_federal
2026-11-02 nacional
2026-11-15 nacional
2026-11-20 nacional
2026-12-24 facultativo_federal_parcial
2026-12-25 nacional
2026-12-31 facultativo_federal_parcial
"""
RELEASE_MINUTE = 19 * 60 + 30
EMISSION_MINUTE = 20 * 60
NATIONAL = "nacional"
# --- end of fixed values ---------------------------------------------------------------------


def calendar_entries(spark: SparkSession) -> DataFrame:
    lines = [line.split() for line in CALENDAR_ENTRIES.split("\n") if line.strip()]
    values = ", ".join(f"(DATE '{day}', '{kind}')" for day, kind in lines)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(dia, tipo)")


def day_spine(entries: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """One row per civil day of the covered years, with everything the release rule needs.

    A day's data is released at 19:30 of the next business day, so what is released at 19:30 of
    day D ends the day before the latest business day up to D (`liberado_ate`). `ultimo_dia` is
    the same for the emission at 20:00 of the day before D. Every listed day, of any kind, is a
    non-business day; only national holidays count as low-load holidays. The table has one row per
    calendar day, so it stays small whatever the data volume.
    """
    lo = F.lit(first) if first else F.make_date(F.year(F.min("dia")), F.lit(1), F.lit(1))
    hi = F.lit(last) if last else F.make_date(F.year(F.max("dia")), F.lit(12), F.lit(31))
    every = entries.agg(F.sequence(lo, hi).alias("dias")).select(
        F.explode("dias").alias("dia"), F.lit(False).alias("listado"), F.lit(False).alias("nac")
    )
    marked = entries.select(
        "dia", F.lit(True).alias("listado"), (F.col("tipo") == NATIONAL).alias("nac")
    )
    days = (
        every.unionByName(marked)
        .groupBy("dia")
        .agg(
            F.bool_or("listado").alias("listado"),
            F.bool_or("nac").alias("feriado_nacional"),
            F.bool_or(~F.col("listado")).alias("coberto"),
        )
        .where("coberto")
        .withColumn("dia_semana", F.weekday("dia"))
        .withColumn("dia_util", (F.col("dia_semana") < 5) & ~F.col("listado"))
    )
    whole = Window.partitionBy(F.lit(1)).orderBy("dia")
    business = F.when(F.col("dia_util"), F.col("dia"))
    return days.select(
        "dia",
        "dia_semana",
        "dia_util",
        "feriado_nacional",
        F.min(business).over(whole.rowsBetween(1, Window.unboundedFollowing)).alias("proximo_util"),
        F.date_sub(
            F.max(business).over(whole.rowsBetween(Window.unboundedPreceding, 0)), 1
        ).alias("liberado_ate"),
        F.date_sub(
            F.max(business).over(whole.rowsBetween(Window.unboundedPreceding, -1)), 1
        ).alias("ultimo_dia"),
    )


def covered(value: Column, what: str) -> Column:
    """The value, or a failed job when the calendar does not cover the date."""
    message = F.lit(f"{what} is outside the calendar coverage")
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(message).cast("date"))


def release_cutoffs(moments: DataFrame, spine: DataFrame, moment: str = "momento") -> DataFrame:
    """Adds `corte`: exclusive end of the data released up to each moment."""
    clock = F.hour(moment) * 60 + F.minute(moment)
    asked = F.when(clock >= RELEASE_MINUTE, F.to_date(moment)).otherwise(
        F.date_sub(F.to_date(moment), 1)
    )
    lookup = spine.select(F.col("dia").alias("__d"), "liberado_ate")
    joined = moments.withColumn("__asked", asked).join(
        F.broadcast(lookup), F.col("__asked") == F.col("__d"), "left"
    )
    cutoff = at_midnight(F.date_add(covered(F.col("liberado_ate"), "moment"), 1))
    return joined.select(*moments.columns, cutoff.alias("corte"))


def emission_cutoffs(targets: DataFrame, spine: DataFrame) -> DataFrame:
    """Adds `corte` for target days `dia`: what is released at 20:00 of the day before."""
    asked = plus_minutes(at_midnight(F.date_sub("dia", 1)), EMISSION_MINUTE)
    return release_cutoffs(targets.withColumn("__m", asked), spine, "__m").drop("__m")


def release_map(targets: DataFrame, spine: DataFrame) -> DataFrame:
    """Target day -> last released day, age of the information and calendar features."""
    lookup = spine.select("dia", "ultimo_dia", "dia_semana", "feriado_nacional")
    joined = targets.select("dia").distinct().join(F.broadcast(lookup), "dia", "left")
    last = covered(F.col("ultimo_dia"), "target day")
    return joined.select(
        "dia",
        last.alias("ultimo_dia"),
        F.datediff("dia", last).alias("idade"),
        "dia_semana",
        F.col("feriado_nacional").cast("int").alias("feriado"),
    )


def forecast_map(
    spark: SparkSession, t0: datetime, cutoff: datetime, spine: DataFrame, horizons: int = 48
) -> DataFrame:
    """The one or two target days of a forecast that starts at `t0`, all with the same last day."""
    last = F.date_sub(F.lit(cutoff.date()), 1)
    steps = spark.range(1, horizons + 1).select(
        F.to_date(
            F.lit(str(t0)).cast("timestamp_ntz")
            + F.make_dt_interval(mins=((F.col("id") - 1) * 30).cast("int"))
        ).alias("dia")
    )
    return (
        steps.distinct()
        .join(F.broadcast(spine.select("dia", "dia_semana", "feriado_nacional")), "dia")
        .select(
            "dia",
            last.alias("ultimo_dia"),
            F.datediff("dia", last).alias("idade"),
            "dia_semana",
            F.col("feriado_nacional").cast("int").alias("feriado"),
        )
    )


def effective_cutoffs(targets: DataFrame, history: DataFrame, spine: DataFrame) -> DataFrame:
    """Emission cutoff, moved back to the last day that is published completely."""
    latest = F.max("din_instante")
    full = F.when(
        F.hour(latest) * 60 + F.minute(latest) >= 23 * 60 + 30, F.date_add(F.to_date(latest), 1)
    ).otherwise(F.to_date(latest))
    published = history.agg(at_midnight(full)).scalar()
    return emission_cutoffs(targets, spine).withColumn("corte", F.least("corte", published))


def pending_days(archive: DataFrame, now: datetime) -> DataFrame:
    """All target days after the newest notice; tomorrow counts from 20:00 on. Without any notice it
    is the last such day."""
    late = now.hour * 60 + now.minute >= EMISSION_MINUTE
    final = F.date_add(F.lit(now.date()), 1 if late else 0)
    newest = F.date_add(F.to_date(F.max("t0")), 1)
    start = F.coalesce(newest, final)
    return (
        archive.agg(start.alias("a"), final.alias("b"))
        .where("a <= b")
        .select(F.explode(F.sequence("a", "b")).alias("dia"))
    )
