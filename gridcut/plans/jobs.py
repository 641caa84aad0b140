"""Whole jobs: audit reports, training, backtest, held-out evaluation, impact, daily emission.

Each job reads tables, calls operators and writes tables. Settings are plain arguments.
"""

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcut.operators import audit, descriptive, evaluate, features, impact, model
from gridcut.operators.calendar import calendar_entries, day_spine, pending_days, release_map
from gridcut.schemas import ENTITY_DAY, FIRST_HISTORY_DAY
from gridcut.session import stored
from gridcut.sources import readers, sinks


def audit_tables(df: DataFrame, sources: Sequence[str], detail: bool = False) -> dict:
    """All audit reports of one table, by name."""
    tables = {
        "keys": audit.key_report(df, sources, detail),
        "temporal": audit.temporal_report(df),
        "nulls": audit.null_report(df, detail=detail),
        "nulls_by_month": audit.null_report_by_month(df, detail),
        "numeric": audit.numeric_report(df),
        "quantiles": audit.numeric_quantiles(df),
        "domains": audit.domain_report(df, audit.domains_of(sources, detail)),
        "coverage": audit.coverage_report(df, detail),
        "granularity": audit.granularity_report(df),
        "identity_drift": audit.identity_drift(df),
        "calendar_mismatches": audit.calendar_mismatches(df),
        "status": audit.audit_status(audit.audit_flags(df, sources, detail)),
    }
    if not detail:
        tables["label_consistency"] = audit.label_consistency(df)
    return tables


def descriptive_tables(targets: DataFrame) -> dict:
    """The descriptive report: aggregates, episodes, persistence, panel, quality, exceptions.

    Repeated keys fail it before anything is described.
    """
    descriptive.check_keys(targets)
    dated = descriptive.with_calendar(targets)
    eps = stored(descriptive.episodes(targets), "episodios")
    entity = descriptive.aggregate_by(dated, ["fonte", "id_ons"])
    panel = ["fonte", "year", "causa"]
    return {
        "aggregates": descriptive.aggregate_sets(targets),
        "concentration": descriptive.concentration(entity),
        "entity_metadata": descriptive.entity_metadata(targets),
        "comparable": descriptive.aggregate_by(descriptive.season(dated), panel),
        "fixed_panel": descriptive.fixed_panel(
            descriptive.season(dated), descriptive.seasonal_cohort(targets), panel
        ),
        "episodes": descriptive.episode_summary(eps),
        "episode_durations": descriptive.episode_durations(eps),
        "persistence": descriptive.persistence_30m(targets),
        "daily_persistence": descriptive.persistence_24h(targets),
        "target_quality": descriptive.target_quality(targets),
        "exceptions": descriptive.exceptions(targets),
    }


def write_tables(tables: dict, folder: str) -> None:
    """One JSON folder per report."""
    for name, table in tables.items():
        sinks.write_json(table, f"{folder}/{name}")


def default_spine(spark: SparkSession) -> DataFrame:
    return day_spine(calendar_entries(spark))


def train(
    spark: SparkSession,
    base: DataFrame,
    first_forecast_day: date,
    thresholds: dict[str, float],
    path: str,
    *,
    parameters: dict | None = None,
) -> model.DailyModel:
    """Fit on everything released before the first forecast day, freeze with thresholds, save."""
    spine = default_spine(spark)
    last = model.last_released(spark, first_forecast_day, spine)
    first = date.fromisoformat(FIRST_HISTORY_DAY)
    mapping = release_map(model.days_between(spark, first, last), spine)
    fitted = model.fit(
        base, mapping, last, parameters=parameters, limiares_alerta=thresholds
    )
    fitted.thresholds = dict(thresholds)
    fitted.save(spark, path)
    return fitted


def month_starts(first: date, last: date) -> list[date]:
    out = []
    while first <= last:
        out.append(first)
        first = (first.replace(day=28) + timedelta(days=4)).replace(day=1)
    return out


def backtest(base: DataFrame, first: date, last: date, path: str, **options) -> None:
    """Expanding-origin backtest: one training per month, one partition per month written."""
    spine = default_spine(base.sparkSession)
    for month in month_starts(first, last):
        rows = model.backtest_month(base, month, spine, **options)
        sinks.write_sorted(rows, f"{path}/backtest_{month:%Y-%m}", *ENTITY_DAY, "slot")


def backtest_report(predictions: DataFrame, split: date) -> dict:
    """Thresholds from the months before `split`, metrics with them, final thresholds, decision."""
    early = evaluate.rounded_thresholds(predictions.where(F.col("mes") < F.lit(split)))
    chosen = {r["fonte"]: r["limiar"] for r in early.collect()}  # one row per source
    table = stored(evaluate.metrics(predictions, chosen), "metricas")
    return {
        "metrics": table,
        "decision": evaluate.adoption(table),
        "thresholds_early": early,
        "thresholds_final": evaluate.rounded_thresholds(predictions),
    }


def predict_held_out(
    fitted: model.DailyModel, base: DataFrame, first: date, last: date, path: str
) -> DataFrame:
    """Scores of a held-out period without labels, written before anything is evaluated."""
    spark = base.sparkSession
    mapping = release_map(model.days_between(spark, first, last), default_spine(spark))
    scored = model.score(fitted, features.build_features(base, mapping))
    out = scored.withColumn("modelo_id", F.lit(fitted.model_id))
    sinks.write_sorted(out, path, *ENTITY_DAY, "slot")
    return spark.read.parquet(path)


def evaluate_held_out(
    predictions: DataFrame, base: DataFrame, thresholds: dict[str, float], month: date
) -> DataFrame:
    labelled = features.attach_labels(predictions, base).where(F.col("y_corte").isNotNull())
    return evaluate.held_out_metrics(labelled, thresholds, F.lit(month))


def impact_tables(
    targets: DataFrame, predictions: DataFrame, thresholds: dict[str, float], last_day: date
) -> dict:
    """Energy coverage of the alerts, and savings of moving a partial stop."""
    truth = impact.observed(targets).where(F.col("dia") <= F.lit(last_day))
    scored = stored(impact.with_predictions(truth, predictions), "avaliadas")
    present = impact.for_fractions(scored.where(F.col("p_corte").isNotNull()))
    choices = stored(impact.choose_blocks(impact.block_table(present), thresholds), "escolhas")
    return {
        "coverage": evaluate.energy_coverage(scored, thresholds),
        "savings": impact.saving_summary(choices),
    }


def emit_pending(
    spark: SparkSession,
    fitted: model.DailyModel,
    files: Sequence[tuple[str, str]],
    archive: str,
    now: datetime,
) -> list[date]:
    """Read the publications, emit every pending notice in one batch, and upsert the archive."""
    spine = default_spine(spark)
    if sinks.has_notices(spark, archive):
        known = sinks.read_notices(spark, archive)
    else:
        known = spark.range(0).select(F.lit(None).cast("timestamp_ntz").alias("t0"))
    days = [r["dia"] for r in pending_days(known, now).collect()]  # one row for each civil day
    if not days:
        return []
    history = stored(readers.read_republished(spark, files), "publicado")
    targets = spark.createDataFrame([(d,) for d in days], "dia date")
    notices = stored(model.emit_days(fitted, history, targets, spine, now), "emitidos")
    sinks.upsert_notices(notices, archive)
    done = notices.select(F.to_date("t0").alias("dia")).distinct().orderBy("dia")
    return [r["dia"] for r in done.collect()]
