"""Forecast contract: schema, key and value rules, all counted in one aggregation."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcut.functions.scalars import any_of, is_blank, is_true, outside
from gridcut.schemas import (
    CAUSE_PROBABILITIES,
    FORECAST_SCHEMA,
    HORIZONS,
    ORIGINS,
    OUTPUT_KINDS,
    PREDICTABLE_CAUSES,
    SOURCES,
)

FORECAST_KEY = ["fonte", "id_ons", "t0", "horizonte"]
TOLERANCE = 1e-6
PROBABILITIES = ("p_restricao", "p_corte", "limiar_alerta", *CAUSE_PROBABILITIES)
VOLUMES = (
    "volume_condicional_mwmed",
    "volume_esperado_mwmed",
    "energia_esperada_mwh",
    "volume_p10_mwmed",
    "volume_p90_mwmed",
)


class ContractError(ValueError):
    """A forecast breaks the contract; the message names the rule and the number of rows."""


def schema_problems(df: DataFrame) -> list[str]:
    """Missing or wrongly typed required columns; additional columns are allowed."""
    actual = {f.name: f.dataType for f in df.schema}
    out = []
    for field in FORECAST_SCHEMA:
        if field.name not in actual:
            out.append(f"missing column {field.name}")
        elif actual[field.name] != field.dataType:
            have = actual[field.name].simpleString()
            out.append(f"{field.name} is {have}, not {field.dataType.simpleString()}")
    return out


class Rule(NamedTuple):
    """A rule's name, the test it applies, the columns it looks at, and what the test compares with."""

    name: str
    test: str
    columns: tuple[str, ...]
    limits: tuple = ()


# --- fixed values: the rules of the contract, in checking order --------------------------------
RULES = (
    Rule("null_key", "missing", tuple(FORECAST_KEY)),
    Rule("source_domain", "foreign", ("fonte",), SOURCES),
    Rule("kind_domain", "foreign", ("tipo_saida",), OUTPUT_KINDS),
    Rule("kind_null", "missing", ("tipo_saida",)),
    Rule("model_blank", "blank", ("modelo_id",)),
    Rule("horizon_range", "outside", ("horizonte",), (1, HORIZONS)),
    Rule("tau_mismatch", "sql", (), ("tau <> t0 + make_dt_interval(0, 0, 30 * (int(horizonte) - 1))",)),
    Rule("cutoff_null", "missing", ("corte_dados",)),
    Rule("tau_null", "missing", ("tau",)),
    Rule("cutoff_after_t0", "sql", (), ("corte_dados > t0",)),
    Rule("scenario_blank", "blank", ("cenario_disponibilidade",)),
    Rule("observation_not_released", "sql", (), ("instante_observacao + interval 30 minutes > corte_dados",)),
    Rule("coverage_range", "outside", ("cobertura_historico",), (0.0, 1.0)),
    Rule("generated_null", "missing", ("gerado_em",)),
    *(Rule(f"{p}_range", "outside", (p,), (0.0, 1.0)) for p in PROBABILITIES),
    *(Rule(f"{v}_range", "outside", (v,), (0.0, None)) for v in VOLUMES),
    Rule("energy_mismatch", "sql", (), (f"abs(energia_esperada_mwh - volume_esperado_mwmed / 2) > {TOLERANCE}D",)),
    Rule("energy_volume_nulls", "one_missing", ("energia_esperada_mwh", "volume_esperado_mwmed")),
    Rule("p10_over_p90", "sql", (), ("volume_p10_mwmed > volume_p90_mwmed",)),
    Rule("no_forecast_reason", "unexplained", ("p_corte", "motivo_sem_previsao")),
    Rule("alert_mismatch", "sql", (), ("alerta <> (p_corte >= limiar_alerta)",)),
    Rule("alert_null", "only_first", ("p_corte", "alerta")),
    Rule("alert_without_forecast", "only_first", ("alerta", "p_corte")),
    Rule("threshold_null", "only_first", ("p_corte", "limiar_alerta")),
    Rule("cause_domain", "foreign", ("causa_prevista",), PREDICTABLE_CAUSES),
    Rule("no_cause_reason", "unexplained", ("causa_prevista", "motivo_sem_causa")),
    Rule("cause_shares_partial", "one_missing", CAUSE_PROBABILITIES),
    Rule("cause_shares_sum", "sum_off", CAUSE_PROBABILITIES, (1.0,)),
    Rule("cause_not_largest", "beaten", ("causa_prevista", *CAUSE_PROBABILITIES), PREDICTABLE_CAUSES),
    Rule("origin_domain", "foreign", ("origem_prevista",), ORIGINS),
)
# --- end of fixed values -----------------------------------------------------------------------


def _outside(c: str, low: float | None, high: float | None) -> Column:
    """Not within the bounds; NaN and the infinities are never within, NULL always is."""
    inside = F.abs(F.col(c)) < float("inf")
    if low is not None:
        inside &= F.col(c) >= low
    if high is not None:
        inside &= F.col(c) <= high
    return ~inside


def violation(rule: Rule) -> Column:
    """The condition under which a row breaks the rule; NULL means it does not."""
    cols = [F.col(c) for c in rule.columns]
    match rule.test:
        case "missing":
            return any_of([c.isNull() for c in cols])
        case "foreign":
            return outside(rule.columns[0], rule.limits)
        case "blank":
            return is_blank(rule.columns[0])
        case "outside":
            return _outside(rule.columns[0], *rule.limits)
        case "sql":
            return F.expr(rule.limits[0])
        case "only_first":
            return cols[0].isNotNull() & cols[1].isNull()
        case "unexplained":
            return cols[0].isNull() & is_blank(rule.columns[1])
        case "one_missing":
            known = F.array_size(F.array_compact(F.array(*cols)))
            return known.between(1, len(cols) - 1)
        case "sum_off":
            return F.abs(sum(cols[1:], cols[0]) - rule.limits[0]) > TOLERANCE
        case "beaten":
            shares = cols[1:]
            own = F.get(F.array(*shares), F.array_position(F.lit(list(rule.limits)), cols[0]).cast("int") - 1)
            full = F.array_size(F.array_compact(F.array(*shares))) == len(shares)
            return full & (own < F.greatest(*shares) - TOLERANCE)
    raise ValueError(rule.test)


def value_rules() -> dict[str, Column]:
    """Violation of each rule in checking order; a NULL outcome is not a violation."""
    return {rule.name: violation(rule) for rule in RULES}


def contract_violations(df: DataFrame) -> DataFrame:
    """(ordem, regra, linhas) for every rule, `duplicate_key` right after `null_key`.

    Rows are grouped by key once; each group carries the number of broken rows per rule, so all
    rules and the duplicate test share one shuffle.
    """
    rules = value_rules()
    per_key = df.groupBy(*FORECAST_KEY).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(is_true(rule)).alias(name) for name, rule in rules.items()],
    )
    repeated = F.sum(F.when(F.col("__n") > 1, F.col("__n"))).alias("duplicate_key")
    sums = {name: F.sum(name).alias(name) for name in rules}
    totals = per_key.agg(repeated, *sums.values())
    names = list(rules)
    names.insert(1, "duplicate_key")
    entries = [
        F.struct(
            F.lit(i).alias("ordem"),
            F.lit(name).alias("regra"),
            F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias("linhas"),
        )
        for i, name in enumerate(names)
    ]
    return totals.select(F.inline(F.array(*entries)))


def validate_forecast(df: DataFrame) -> DataFrame:
    """The forecast itself, or a ContractError with the first broken rule."""
    problems = schema_problems(df)
    if problems:
        raise ContractError("; ".join(problems))
    first = contract_violations(df).where("linhas > 0").orderBy("ordem").limit(1).first()
    if first is not None:
        raise ContractError(f"{first['regra']} ({first['linhas']} rows)")
    return df
