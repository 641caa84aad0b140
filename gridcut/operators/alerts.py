"""Daily notice: forecasts per half hour become alert windows, free hours and plant summaries.

A notice has 48 rows per plant and `t0`, so every window here is bounded by 48 rows. All steps
partition by (plant, t0), which lets runs, summaries and their join share one shuffle.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcut.functions.scalars import count_if, is_true, mapped, mapped_strict, plus_minutes
from gridcut.schemas import ATTRIBUTES, ENTITY, HORIZONS, MIXED_LABEL

NOTICE = ["fonte", "id_ons", "t0"]

# --- fixed values: texts shown to plant operators --------------------------------------------
IN_ALERT = "em alerta"
NO_ALERT = "sem alerta"
NO_FORECAST = "sem previsão"
STATUS_ORDER = {IN_ALERT: 0, NO_ALERT: 1, NO_FORECAST: 2}
CAUSE_TEXT = {
    "ENE": "sobra de energia no sistema",
    "CNF": "limite de segurança da rede",
    "REL": "indisponibilidade na rede externa",
    "MISTA": "motivos variados",
}
ORIGIN_TEXT = {"SIS": "origem sistêmica", "LOC": "origem local"}
NO_CAUSE_TEXT = "sem ordens recentes com motivo conhecido"
ADVICE = "Prepare a equipe para receber e cumprir a ordem nesta janela."
LONG_ADVICE = " Janela longa: boa candidata para uma manutenção curta já prevista."
HALF_HOUR_STATES = {
    "alert": "em alerta",
    "free": "livre",
    "idle": "sem geração prevista",
    "blind": "sem previsão",
}
# --- end of fixed values ---------------------------------------------------------------------


def predicted() -> Column:
    return F.col("p_corte").isNotNull()


def alerting() -> Column:
    return predicted() & is_true("alerta")


def free() -> Column:
    calm = predicted() & ~F.coalesce("alerta", F.lit(True))
    return calm & is_true(F.col("potencial_referencia_mwmed") > 0)


def mark_runs(forecast: DataFrame, mark: Column) -> DataFrame:
    """Rows where `mark` holds, numbered by run of adjacent rows in horizon order."""
    w = Window.partitionBy(*NOTICE).orderBy("horizonte")
    flagged = forecast.withColumn("__m", is_true(mark))
    turned = flagged.withColumn(
        "__turn", (F.col("__m") != F.lag("__m", 1, False).over(w)).cast("int")
    )
    return (
        turned.withColumn("bloco", F.sum("__turn").over(w)).where("__m").drop("__m", "__turn")
    )


def mode_or_mixed(c: str) -> Column:
    """Most frequent label of a run, MISTA when the first two tie, NULL without labels.

    A run has at most 48 rows, so its labels fit a small array.
    """
    labels = F.collect_list(c)
    counted = F.transform(
        F.array_distinct(labels),
        lambda x: F.struct(
            F.size(F.filter(labels, lambda y: y == x)).alias("n"), x.alias("label")
        ),
    )
    top = F.array_max(F.transform(counted, lambda e: e.getField("n")))
    best = F.filter(counted, lambda e: e.getField("n") == top)
    return (
        F.when(F.size(best) == 0, F.lit(None))
        .when(F.size(best) > 1, F.lit(MIXED_LABEL))
        .otherwise(F.get(best, F.lit(0)).getField("label"))
    )


def alert_windows(forecast: DataFrame) -> DataFrame:
    """Consecutive half hours in alert, with hours, chance and the typical cause and origin."""
    return (
        mark_runs(forecast, alerting())
        .groupBy(*NOTICE, "bloco")
        .agg(
            F.min("tau").alias("inicio"),
            plus_minutes(F.max("tau"), 30).alias("fim"),
            (F.count(F.lit(1)) / 2).alias("horas"),
            F.avg("p_corte").alias("chance_media"),
            F.max("p_corte").alias("chance_max"),
            mode_or_mixed("causa_prevista").alias("causa"),
            mode_or_mixed("origem_prevista").alias("origem"),
        )
        .drop("bloco")
    )


def free_windows(forecast: DataFrame) -> DataFrame:
    """Consecutive predicted half hours without alert in which the plant usually generates."""
    return (
        mark_runs(forecast, free())
        .groupBy(*NOTICE, "bloco")
        .agg(
            F.min("tau").alias("inicio"),
            plus_minutes(F.max("tau"), 30).alias("fim"),
            (F.count(F.lit(1)) / 2).alias("horas"),
        )
        .drop("bloco")
    )


def plant_summary(forecast: DataFrame) -> DataFrame:
    """One row per plant and notice, unordered; `ranked` puts the most alerted plants first.

    Half hours are folded into runs (alert or not), runs into plants: one shuffle by plant and
    notice, and no join between summary and windows.
    """
    extras = [c for c in ATTRIBUTES if c in forecast.columns]
    w = Window.partitionBy(*NOTICE).orderBy("horizonte")
    rows = forecast.withColumn("__m", alerting()).withColumn(
        "__turn", (F.col("__m") != F.lag("__m", 1, False).over(w)).cast("int")
    )
    first = F.when(F.col("__m"), F.col("tau"))
    runs = (
        rows.withColumn("bloco", F.sum("__turn").over(w))
        .groupBy(*NOTICE, "bloco", "__m")
        .agg(
            F.count(F.lit(1)).alias("n"),
            count_if(free()).alias("livres"),
            F.bool_or(predicted()).alias("tem"),
            F.min(first).alias("inicio"),
            plus_minutes(F.max(first), 30).alias("fim"),
            F.max(F.when(F.col("__m"), F.col("p_corte"))).alias("chance_max"),
            mode_or_mixed("causa_prevista").alias("causa"),
            mode_or_mixed("origem_prevista").alias("origem"),
            *[
                F.min_by(
                    F.struct(c, "horizonte"), F.when(F.col(c).isNotNull(), F.col("horizonte"))
                ).alias(c)
                for c in extras
            ],
        )
    )
    has = F.bool_or("tem")
    alerted = F.when(F.col("__m"), F.col("n"))
    window = F.struct("inicio", "fim", "causa", "origem")
    longest = F.when(F.col("__m"), F.struct(-F.col("n"), F.col("inicio")))
    hours = F.coalesce(F.sum(alerted), F.lit(0)) / 2
    summary = runs.groupBy(*NOTICE).agg(
        F.when(has, hours).alias("horas_alerta"),
        F.when(has, F.sum("livres") / 2).alias("horas_livres"),
        F.min("inicio").alias("primeiro_alerta"),
        F.max("chance_max").alias("chance_max"),
        F.when(~has, F.lit(NO_FORECAST))
        .when(hours > 0, F.lit(IN_ALERT))
        .otherwise(F.lit(NO_ALERT))
        .alias("status"),
        F.min_by(window, longest).alias("w"),
        F.count(alerted).alias("janelas"),
        *[F.min_by(f"{c}.{c}", f"{c}.horizonte").alias(c) for c in extras],
    )
    return summary.select(
        *NOTICE,
        "horas_alerta",
        "horas_livres",
        "primeiro_alerta",
        "chance_max",
        "status",
        F.col("w.inicio").alias("janela_inicio"),
        F.col("w.fim").alias("janela_fim"),
        F.col("w.causa").alias("motivo"),
        F.col("w.origem").alias("origem"),
        "janelas",
        *extras,
    )


def ranked(summary: DataFrame) -> DataFrame:
    return (
        summary.withColumn("__o", mapped_strict("status", STATUS_ORDER))
        .orderBy(
            "__o",
            F.col("horas_alerta").desc_nulls_last(),
            F.col("primeiro_alerta").asc_nulls_last(),
            *ENTITY,
        )
        .drop("__o")
    )


def portfolio_cards(summary: DataFrame) -> DataFrame:
    """Headline numbers per notice. Hours are multiples of 0.5 up to 24: medians hold 49 values."""
    in_alert = F.col("status") == IN_ALERT
    with_forecast = F.col("status") != NO_FORECAST
    causes = [*CAUSE_TEXT]
    counts = [count_if(in_alert & (F.col("motivo") == c)).alias(f"__{c}") for c in causes]
    wide = summary.groupBy("t0").agg(
        count_if(in_alert).alias("usinas_em_alerta"),
        count_if(with_forecast).alias("usinas_previstas"),
        F.median(F.when(in_alert, F.col("horas_alerta"))).alias("mediana_horas_alerta"),
        F.median(F.when(with_forecast, F.col("horas_livres"))).alias("mediana_horas_livres"),
        *counts,
    )
    top = F.greatest(*[F.col(f"__{c}") for c in causes])
    label = F.lit(None).cast("string")
    for c in sorted(causes, reverse=True):
        label = F.when(F.col(f"__{c}") == top, F.lit(c)).otherwise(label)
    named = F.lit(0)
    for c in causes:
        named = named + F.col(f"__{c}")
    return wide.select(
        "t0",
        "usinas_em_alerta",
        "usinas_previstas",
        "mediana_horas_alerta",
        "mediana_horas_livres",
        F.when(top > 0, label).alias("motivo"),
        F.when(top > 0, top / named).alias("parcela_motivo"),
    )


def notice_facts(notices: DataFrame) -> DataFrame:
    """Header facts per notice: last emission, last cutoff, model of the first row."""
    return notices.groupBy("t0").agg(
        F.max("emitido_em").alias("emitido_em"),
        F.max("corte_dados").alias("corte_dados"),
        F.min_by("modelo_id", F.struct("fonte", "id_ons", "horizonte")).alias("modelo_id"),
    )


# --- data behind the screens -----------------------------------------------------------------


def notice_days(archive: DataFrame) -> DataFrame:
    return archive.select(F.to_date("t0").alias("dia")).distinct()


def notice_of(archive: DataFrame, t0: Column) -> DataFrame:
    return archive.where(F.col("t0") == t0)


def filter_notice(
    notice: DataFrame, sources: Sequence[str] = (), states: Sequence[str] = ()
) -> DataFrame:
    if sources:
        notice = notice.where(F.col("fonte").isin(*sources))
    if states:
        notice = notice.where(F.col("id_estado").isin(*states))
    return notice


def top_per_source(summary: DataFrame, places: int) -> DataFrame:
    """Places of the heat map divided between the sources that have alerts, per notice.

    The cut per source is the feature. Ranks come from one aggregate of bounded size per group:
    each (t0, source) keeps at most `places` plants while it is aggregated.
    """
    alerted = summary.where(F.col("status") == IN_ALERT)
    sources = alerted.groupBy("t0").agg(F.count_distinct("fonte").alias("__s"))
    w = Window.partitionBy("t0", "fonte").orderBy(
        F.desc("horas_alerta"), F.asc_nulls_last("primeiro_alerta"), *ENTITY
    )
    return (
        alerted.join(sources, "t0")
        .withColumn("posicao", F.row_number().over(w))
        .where((F.col("posicao") <= places) & (F.col("posicao") <= F.floor(places / F.col("__s"))))
        .drop("__s")
    )


def heat_value() -> Column:
    """Colour value: upper half for alerts, lower half for free hours, NULL for no generation."""
    p = F.col("p_corte")
    alert = is_true("alerta")
    running = is_true(F.col("potencial_referencia_mwmed") > 0)
    return F.when(p.isNull() | (~alert & ~running), F.lit(None).cast("double")).otherwise(
        F.when(alert, 0.5 + 0.5 * p).otherwise(0.49 * p)
    )


def heatmap(notices: DataFrame) -> DataFrame:
    """Plants x 48 half hours."""
    return (
        notices.select(*NOTICE, F.col("horizonte").cast("int").alias("h"), heat_value().alias("v"))
        .groupBy(*NOTICE)
        .pivot("h", list(range(1, HORIZONS + 1)))
        .agg(F.max("v"))
    )


def half_hour_state(notices: DataFrame) -> DataFrame:
    state = (
        F.when(~predicted(), F.lit(HALF_HOUR_STATES["blind"]))
        .when(is_true("alerta"), F.lit(HALF_HOUR_STATES["alert"]))
        .when(is_true(F.col("potencial_referencia_mwmed") > 0), F.lit(HALF_HOUR_STATES["free"]))
        .otherwise(F.lit(HALF_HOUR_STATES["idle"]))
    )
    return notices.select(
        *NOTICE, "horizonte", F.coalesce("p_corte", F.lit(0.0)).alias("chance"), state.alias("estado")
    )


# --- texts -----------------------------------------------------------------------------------


def _clock(t: Column, reference: Column) -> Column:
    minute = F.minute(t)
    plain = F.concat(
        F.hour(t).cast("string"),
        F.lit("h"),
        F.when(minute > 0, F.lpad(minute.cast("string"), 2, "0")).otherwise(F.lit("")),
    )
    ends_day = (F.to_date(t) > F.to_date(reference)) & (F.hour(t) == 0) & (minute == 0)
    return F.when(ends_day, F.lit("24h")).otherwise(plain)


def window_text(start: str, end: str) -> Column:
    """'10h30 às 24h'."""
    a, b = F.col(start), F.col(end)
    return F.concat(_clock(a, a), F.lit(" às "), _clock(b, a))


def cause_text(cause: str, origin: str) -> Column:
    c, o = F.col(cause), F.col(origin)
    base = F.coalesce(mapped(c, CAUSE_TEXT), c)
    suffix = F.coalesce(
        F.concat(F.lit(" · "), mapped(o, ORIGIN_TEXT)),
        F.lit(""),
    )
    return F.when(c.isNull(), F.lit(NO_CAUSE_TEXT)).otherwise(F.concat(base, suffix))


def advice_text(hours: str) -> Column:
    return F.when(F.col(hours) >= 2, F.lit(ADVICE + LONG_ADVICE)).otherwise(F.lit(ADVICE))


def plant_label() -> Column:
    named = F.nullif(F.col("nom_usina"), F.lit(""))
    return F.coalesce(named, F.concat_ws("/", "fonte", "id_ons"))


def portfolio_table(summary: DataFrame) -> DataFrame:
    return summary.select(
        *NOTICE,
        plant_label().alias("usina"),
        "id_estado",
        "horas_alerta",
        F.coalesce(window_text("janela_inicio", "janela_fim"), F.lit("—")).alias("janela"),
        cause_text("motivo", "origem").alias("motivo_texto"),
        "chance_max",
        "horas_livres",
    )

