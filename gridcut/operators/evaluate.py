"""Forecast quality: thresholds, average precision, Brier, macro-F1 and the adoption rule.

Scores are reduced to one row per distinct (group, score) before anything is ordered, and ordered
totals are split into score ranges (`running_totals`), so a source with billions of rows is never
sorted by one task. Equal scores are always handled as one block.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcut.functions.ranking import running_totals, take_first
from gridcut.functions.scalars import (
    clip01,
    count_if,
    is_true,
    mapped,
    mean_if,
    ratio,
    sum_if,
    top_label,
    week_start,
)
from gridcut.schemas import (
    ENTITY_DAY,
    PLANT_CAUSE_SHARES,
    PREDICTABLE_CAUSES,
    STATE_CAUSE_SHARES,
)

DEFAULT_THRESHOLD = 0.5
MIN_WINS = 6
NO_PREDICTION = "SEM"
BASELINES = {
    "historico": "hist_28d",
    "mesmo_slot_ultimo_dia": "ultimo_slot",
    "ultimo_valor": "ultimo_valor_corte",
}
SCORERS = {"modelo": "p_corte", **BASELINES}


def threshold_of(thresholds: dict[str, float], default: float = DEFAULT_THRESHOLD) -> Column:
    return mapped("fonte", thresholds, default)


def score_blocks(
    predictions: DataFrame, keys: Sequence[str], label: str, score: str
) -> DataFrame:
    """One row per distinct score: rows and hits."""
    return predictions.groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col(label).cast("double")).alias("__h")
    )


def _ranked_blocks(blocks: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    return running_totals(blocks, keys, score, {"__hits": "__h", "__alerts": "__n"})


def best_threshold(
    predictions: DataFrame,
    keys: Sequence[str] = ("fonte",),
    label: str = "y_corte",
    score: str = "p_corte",
) -> DataFrame:
    """Score that maximises the F1 of `score >= threshold`; the highest one on a tie."""
    ranked = _ranked_blocks(score_blocks(predictions, keys, label, score), keys, score)
    positives = F.greatest(F.col("__hits_all"), F.lit(1.0))
    f1 = 2 * F.col("__hits") / (F.col("__alerts") + positives)
    best = F.max_by(score, F.struct(f1, F.col(score)))
    return ranked.groupBy(*keys).agg(best.alias("limiar"), F.max(f1).alias("f1"))


def rounded_thresholds(predictions: DataFrame) -> DataFrame:
    """Published thresholds: four decimals, ties to even."""
    return best_threshold(predictions).select("fonte", F.bround("limiar", 4).alias("limiar"))


def ranking_scores(
    predictions: DataFrame,
    keys: Sequence[str],
    scorers: dict[str, str] | None = None,
    label: str = "y_corte",
) -> DataFrame:
    """Average precision and Brier score per group and scorer; NULL with a single class."""
    scorers = scorers or SCORERS
    long = predictions.select(
        *keys,
        label,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("__scorer"),
                        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("__score"),
                    )
                    for name, c in scorers.items()
                ]
            )
        ),
    )
    group = [*keys, "__scorer"]
    ranked = _ranked_blocks(score_blocks(long, group, label, "__score"), group, "__score")
    precision = F.col("__hits") / F.col("__alerts")
    p = clip01("__score")
    squared = F.col("__h") * (p - 1) * (p - 1) + (F.col("__n") - F.col("__h")) * p * p
    both = (F.max("__hits_all") > 0) & (F.max("__hits_all") < F.max("__alerts_all"))
    return ranked.groupBy(*group).agg(
        F.when(both, F.sum(F.col("__h") / F.col("__hits_all") * precision)).alias("ap"),
        F.when(both, F.sum(squared) / F.max("__alerts_all")).alias("brier"),
    )


def _wide(scores: DataFrame, keys: Sequence[str], scorers: Sequence[str]) -> DataFrame:
    out = []
    for metric in ("ap", "brier"):
        for name in scorers:
            chosen = F.max(F.when(F.col("__scorer") == name, F.col(metric)))
            out.append(chosen.alias(f"{metric}_{name}"))
    return scores.groupBy(*keys).agg(*out)


def macro_f1(truth: str, guess: Column) -> Column:
    """Mean F1 over the fixed labels; a missing guess is wrong, an absent label scores zero."""
    y = F.col(truth)
    known = y.isNotNull()
    g = F.coalesce(guess, F.lit(NO_PREDICTION))
    parts = []
    for label in PREDICTABLE_CAUSES:
        tp = count_if(known & (y == label) & (g == label))
        wrong = count_if(known & ((y == label) != (g == label)))
        parts.append(F.coalesce(ratio(2.0 * tp, 2 * tp + wrong), F.lit(0.0)))
    mean = sum(parts[1:], parts[0]) / len(parts)
    return F.when(count_if(known) > 0, mean)


def occurrence_counts(alert: Column, label: str = "y_corte") -> list[Column]:
    y = F.col(label) == 1
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(label).alias("prevalencia"),
        (count_if(alert & y) / F.greatest(count_if(y), F.lit(1))).alias("recall_alerta"),
        (count_if(alert & y) / F.greatest(count_if(alert), F.lit(1))).alias("precisao_alerta"),
    ]


def cause_counts() -> list[Column]:
    return [
        F.count("y_causa").alias("n_causa"),
        macro_f1("y_causa", top_label(PLANT_CAUSE_SHARES)).alias("f1_usina_28d"),
        macro_f1("y_causa", top_label(STATE_CAUSE_SHARES)).alias("f1_estado_7d"),
    ]


def occurrence_metrics(
    predictions: DataFrame, thresholds: dict[str, float], keys: Sequence[str] = ("fonte", "mes")
) -> DataFrame:
    keys = list(keys)
    alert = is_true(F.col("p_corte") >= threshold_of(thresholds))
    counts = predictions.groupBy(*keys).agg(*occurrence_counts(alert))
    scores = _wide(ranking_scores(predictions, keys), keys, list(SCORERS))
    return counts.join(scores, keys)


def cause_metrics(predictions: DataFrame, keys: Sequence[str] = ("fonte", "mes")) -> DataFrame:
    return predictions.groupBy(*keys).agg(*cause_counts())


def metrics(
    predictions: DataFrame, thresholds: dict[str, float], keys: Sequence[str] = ("fonte", "mes")
) -> DataFrame:
    """All metrics per source and period, model and baselines on the same rows."""
    keys = list(keys)
    alert = is_true(F.col("p_corte") >= threshold_of(thresholds))
    counts = predictions.groupBy(*keys).agg(*occurrence_counts(alert), *cause_counts())
    scores = _wide(ranking_scores(predictions, keys), keys, list(SCORERS))
    return counts.join(scores, keys)


def held_out_metrics(
    predictions: DataFrame, thresholds: dict[str, float], month: Column
) -> DataFrame:
    """Weekly and monthly metrics of a held-out month in one table."""
    weekly = metrics(predictions.withColumn("mes", week_start("dia")), thresholds)
    monthly = metrics(predictions.withColumn("mes", month), thresholds)
    return weekly.withColumn("recorte", F.lit("semana")).unionByName(
        monthly.withColumn("recorte", F.lit("mes"))
    )


def adoption(table: DataFrame, baselines: Sequence[str] = tuple(BASELINES)) -> DataFrame:
    """The model replaces the baselines of a source if it wins on average and in enough months."""
    columns = [F.col(f"ap_{b}") for b in baselines]
    best = F.greatest(*columns) if len(columns) > 1 else columns[0]
    means = table.groupBy("fonte").agg(
        F.avg("ap_modelo").alias("modelo_media"),
        *[F.avg(f"ap_{b}").alias(f"m_{b}") for b in baselines],
        count_if(F.col("ap_modelo") > best).alias("meses_vencidos"),
        F.count(F.lit(1)).alias("meses"),
    )
    tops = [F.col(f"m_{b}") for b in baselines]
    top = F.greatest(*tops) if len(tops) > 1 else tops[0]
    name = F.lit(None).cast("string")
    for b in reversed(list(baselines)):
        name = F.when(F.col(f"m_{b}") == top, F.lit(b)).otherwise(name)
    wins = is_true(F.col("modelo_media") > top) & (F.col("meses_vencidos") >= MIN_WINS)
    return means.select(
        "fonte",
        F.lit("corte").alias("celula"),
        F.lit("ap").alias("metrica"),
        "modelo_media",
        name.alias("melhor_baseline"),
        top.alias("baseline_media"),
        "meses_vencidos",
        "meses",
        wins.alias("adota_modelo"),
    )


def energy_coverage(scored: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """How much of the energy actually cut fell into half hours in alert, per source.

    `scored` has observed `corte`, `energia_mwh` and the forecast `p_corte` (NULL = no forecast).
    The control gives the history the same number of alert half hours and is cut exactly there.
    The rows are read several times: pass a stored table.
    """
    rows = scored.withColumn("alerta", is_true(F.col("p_corte") >= threshold_of(thresholds)))
    cut, alert = F.col("corte"), F.col("alerta")
    has = F.col("p_corte").isNotNull()
    totals = rows.groupBy("fonte").agg(
        mean_if(alert.cast("double"), is_true(cut)).alias("recall_meia_hora"),
        mean_if(cut.cast("double"), alert).alias("precisao_meia_hora"),
        sum_if("energia_mwh", is_true(cut)).alias("energia_cortada_mwh"),
        sum_if("energia_mwh", is_true(cut) & alert).alias("energia_avisada_mwh"),
        mean_if(alert.cast("double"), has).alias("taxa_alerta"),
        count_if(cut & ~has).alias("meias_horas_cortadas_sem_previsao"),
        count_if(alert & has).alias("__budget"),
    )
    days = (
        rows.groupBy(*ENTITY_DAY)
        .agg(F.bool_or("corte").alias("corte"), F.bool_or("alerta").alias("alerta"))
        .where("corte")
        .groupBy("fonte")
        .agg(
            F.count(F.lit(1)).alias("usina_dias_com_corte"),
            F.avg(F.col("alerta").cast("double")).alias("fracao_usina_dias_avisados"),
        )
    )
    forecasts = rows.where(has).withColumn(
        "__when", F.unix_date("dia").cast("bigint") * 48 + F.col("slot")
    )
    order = [("hist_28d", True), ("id_ons", False), ("__when", False)]
    control = (
        take_first(forecasts, ["fonte"], order, totals.select("fonte", "__budget"), "__budget")
        .where("corte")
        .groupBy("fonte")
        .agg(F.sum("energia_mwh").alias("__control"))
    )
    ap = ranking_scores(
        forecasts.withColumn("y", F.col("corte").cast("double")),
        ["fonte"],
        {"modelo": "p_corte"},
        "y",
    ).select("fonte", "ap")
    joined = (
        totals.join(days, "fonte", "left").join(control, "fonte", "left").join(ap, "fonte", "left")
    )
    return joined.select(
        "fonte",
        "ap",
        "recall_meia_hora",
        "precisao_meia_hora",
        "energia_cortada_mwh",
        "energia_avisada_mwh",
        ratio("energia_avisada_mwh", "energia_cortada_mwh").alias("fracao_energia_avisada"),
        "taxa_alerta",
        ratio(F.coalesce("__control", F.lit(0.0)), "energia_cortada_mwh").alias(
            "fracao_energia_historico_mesmo_n"
        ),
        "meias_horas_cortadas_sem_previsao",
        F.coalesce("usina_dias_com_corte", F.lit(0)).alias("usina_dias_com_corte"),
        "fracao_usina_dias_avisados",
    )

