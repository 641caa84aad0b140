"""Baseline forecast: the same half hour of the most recent available day, 28 days back at most."""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcut.functions.scalars import half_hour_slot, mapped, plus_minutes
from gridcut.operators.contract import validate_forecast
from gridcut.schemas import (
    ATTRIBUTES,
    CAUSE_PROBABILITIES,
    ENTITY,
    ENTITY_SLOT,
    FORECAST_SCHEMA,
    HISTORY_DAYS,
    HORIZONS,
    PREDICTABLE_CAUSES,
    RESERVED_FROM,
    SLOTS_PER_DAY,
)

MODEL_ID = "baseline_mesmo_horario_recente_v1"
SCENARIO = "noturno_fim_de_semana"
THRESHOLD = 0.5
NO_OBSERVATION = "sem_observacao_valida_no_horario_28d"
NO_CAUSE = "sem_ordem_reconhecida_no_horario_28d"


def moment(t: datetime) -> Column:
    return F.lit(str(t)).cast("timestamp_ntz")


def released(history: DataFrame, cutoff: datetime) -> DataFrame:
    """Rows whose whole half hour lies before the cutoff."""
    return history.where(F.col("din_instante") <= moment(cutoff - timedelta(minutes=30)))


def known_entities(history: DataFrame, cutoff: datetime) -> DataFrame:
    """Entities seen before the cutoff with the attributes of their last row (NULLs included)."""
    return (
        released(history, cutoff)
        .groupBy(*ENTITY)
        .agg(
            F.max_by(F.struct(*ATTRIBUTES), "din_instante").alias("__a"),
            F.max("din_instante").alias("visto_em"),
        )
        .select(*ENTITY, *[F.col("__a").getField(c).alias(c) for c in ATTRIBUTES], "visto_em")
    )


def check_forecast_time(t0: datetime, cutoff: datetime, allow_reserved: bool) -> None:
    if t0.minute % 30 or t0.second or t0.microsecond:
        raise ValueError("t0 must lie on the 30-minute grid")
    if cutoff > t0:
        raise ValueError("a data cutoff after t0 would leak the future")
    last = t0 + timedelta(minutes=30 * HORIZONS)
    if last > datetime.fromisoformat(RESERVED_FROM) and not allow_reserved:
        raise ValueError(f"data from {RESERVED_FROM} on is reserved for the final validation")


CODES = {cause: code for code, cause in enumerate(PREDICTABLE_CAUSES, start=1)}


def recent_rows(history: DataFrame, cutoff: datetime) -> DataFrame:
    """The 28 days before the cutoff; the range reaches the scan, older files are not read."""
    first = moment(cutoff - timedelta(days=HISTORY_DAYS))
    return released(history, cutoff).where(F.col("din_instante") >= first)


def latest_per_slot(recent: DataFrame) -> DataFrame:
    """Latest order, volume and cause per entity and slot, each from its own most recent row.

    Causes travel as numbers: all buffers have fixed length, so this is a hash aggregate that
    keeps one candidate per slot on the map side.
    """
    ts = F.col("din_instante")
    usable = F.when(F.col("volume_mwmed").isNotNull(), ts)
    code = mapped("causa", CODES)
    return (
        recent.withColumn("slot", half_hour_slot("din_instante"))
        .groupBy(*ENTITY_SLOT)
        .agg(
            F.max_by("restricao_registrada", ts).alias("restricao"),
            F.max_by("corte_positivo", usable).alias("corte_positivo"),
            F.max_by("volume_mwmed", usable).alias("volume_mwmed"),
            F.max(usable).alias("din_instante"),
            F.max_by(code, F.when(code.isNotNull(), ts)).alias("causa"),
        )
    )


def same_slot_baseline(
    history: DataFrame,
    t0: datetime,
    cutoff: datetime,
    *,
    generated_at: datetime | None = None,
    allow_reserved: bool = False,
    validate: bool = True,
) -> DataFrame:
    """48 half hours per known entity in the forecast contract.

    The recent rows shrink to at most 48 per entity; these are folded into one map per entity and
    unfolded over the 48 horizons, so the grid itself needs no join.
    """
    check_forecast_time(t0, cutoff, allow_reserved)
    recent = recent_rows(history, cutoff)
    measures = ["restricao", "corte_positivo", "volume_mwmed", "din_instante", "causa"]
    entry = F.struct("slot", F.struct(*measures))
    folded = (
        latest_per_slot(recent)
        .groupBy(*ENTITY)
        .agg(F.map_from_entries(F.collect_list(entry)).alias("__slots"))
    )
    coverage = recent.groupBy(*ENTITY).agg(
        (F.count_distinct("din_instante") / (HISTORY_DAYS * SLOTS_PER_DAY)).alias(
            "cobertura_historico"
        )
    )
    per_entity = (
        released(history, cutoff)
        .select(*ENTITY)
        .distinct()
        .join(folded, ENTITY, "left")
        .join(coverage, ENTITY, "left")
    )
    start = moment(t0)
    grid = (
        per_entity.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(HORIZONS))))
        .withColumn("tau", plus_minutes(start, (F.col("h") - 1) * 30))
        .withColumn("s", F.try_element_at("__slots", half_hour_slot("tau")))
    )
    p = F.col("s.corte_positivo").cast("double")
    volume = F.col("s.volume_mwmed")
    cause = mapped("s.causa", {code: cause for cause, code in CODES.items()})
    columns = {
        "fonte": F.col("fonte"),
        "id_ons": F.col("id_ons"),
        "t0": start,
        "horizonte": F.col("h"),
        "tau": F.col("tau"),
        "p_restricao": F.col("s.restricao").cast("double"),
        "p_corte": p,
        "limiar_alerta": F.lit(THRESHOLD),
        "alerta": p >= THRESHOLD,
        "volume_condicional_mwmed": F.when(volume > 0, volume),
        "volume_esperado_mwmed": volume,
        "energia_esperada_mwh": volume * 0.5,
        "causa_prevista": cause,
        **{
            name: (cause == code).cast("double")
            for name, code in zip(CAUSE_PROBABILITIES, PREDICTABLE_CAUSES, strict=True)
        },
        "motivo_sem_previsao": F.when(p.isNull(), F.lit(NO_OBSERVATION)),
        "motivo_sem_causa": F.when(cause.isNull(), F.lit(NO_CAUSE)),
        "tipo_saida": F.lit("baseline"),
        "modelo_id": F.lit(MODEL_ID),
        "corte_dados": moment(cutoff),
        "cenario_disponibilidade": F.lit(SCENARIO),
        "instante_observacao": F.col("s.din_instante"),
        "cobertura_historico": F.coalesce("cobertura_historico", F.lit(0.0)),
        "gerado_em": moment(generated_at or datetime.now()),
    }
    forecast = grid.select(
        *[
            columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in FORECAST_SCHEMA
        ]
    )
    return validate_forecast(forecast) if validate else forecast
