from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridcut.operators import baseline as B
from gridcut.operators import contract as K
from helpers import HALF, history, obs

T0 = datetime(2025, 3, 11, 10)
CUTOFF = datetime(2025, 3, 10)


def forecast(spark, rows, **options):
    return B.same_slot_baseline(history(spark, rows), T0, CUTOFF, **options)


def at(spark_rows, hour):
    return next(r for r in spark_rows if r["tau"].hour == hour and r["tau"].minute == 0)


def test_most_recent_day_of_the_slot_wins(spark):
    rows = [
        obs(datetime(2025, 3, 7, 14), cut=10.0, cause="REL"),
        obs(datetime(2025, 3, 9, 14), cut=25.0),
        obs(datetime(2025, 3, 10, 14), cut=30.0, cause="CNF"),
    ]
    got = forecast(spark, rows).collect()
    assert len(got) == 48
    r = at(got, 14)
    assert (r["volume_esperado_mwmed"], r["energia_esperada_mwh"]) == (25.0, 12.5)
    assert (r["causa_prevista"], r["p_causa_ene"], r["p_corte"], r["alerta"]) == ("ENE", 1.0, 1.0, True)
    assert r["instante_observacao"] == datetime(2025, 3, 9, 14)
    assert r["cobertura_historico"] == pytest.approx(2 / 1344)
    empty = at(got, 15)
    assert empty["p_corte"] is None and empty["alerta"] is None
    assert empty["motivo_sem_previsao"] == B.NO_OBSERVATION
    assert r["horizonte"] == 9 and r["tau"] == T0 + 8 * HALF


def test_order_volume_and_cause_come_from_their_own_rows(spark):
    broken = list(obs(datetime(2025, 3, 9, 14), cut=5.0, cause="XXX"))
    broken[8] = None
    rows = [obs(datetime(2025, 3, 8, 14), cut=12.0, cause="CNF"), tuple(broken)]
    r = at(forecast(spark, rows).collect(), 14)
    assert r["p_restricao"] == 1.0 and r["volume_esperado_mwmed"] == 12.0
    assert r["causa_prevista"] == "CNF"
    assert r["instante_observacao"] == datetime(2025, 3, 8, 14)


def test_entity_without_recent_rows_is_kept_without_forecast(spark):
    rows = [obs(datetime(2025, 1, 2, 14), cut=9.0)]
    got = forecast(spark, rows).collect()
    assert len(got) == 48 and all(r["p_corte"] is None for r in got)
    assert {r["cobertura_historico"] for r in got} == {0.0}
    assert forecast(spark, [obs(datetime(2025, 3, 10, 0), cut=9.0)]).count() == 0


def test_known_entities_keep_the_last_row_as_it_is(spark):
    late = list(obs(datetime(2025, 3, 9, 15), state="RN"))
    late[2] = None
    table = history(spark, [obs(datetime(2025, 3, 9, 14)), tuple(late)])
    r = B.known_entities(table, CUTOFF).first()
    assert (r["nom_usina"], r["id_estado"], r["visto_em"]) == (None, "RN", datetime(2025, 3, 9, 15))


def test_refused_times(spark):
    table = history(spark, [obs(datetime(2025, 3, 9, 14))])
    with pytest.raises(ValueError, match="grid"):
        B.same_slot_baseline(table, T0 + timedelta(minutes=5), CUTOFF)
    with pytest.raises(ValueError, match="leak"):
        B.same_slot_baseline(table, T0, T0 + HALF)
    with pytest.raises(ValueError, match="reserved"):
        B.same_slot_baseline(table, datetime(2026, 8, 31, 0, 30), CUTOFF)
    later = B.same_slot_baseline(table, datetime(2026, 8, 31, 0, 30), CUTOFF, allow_reserved=True)
    assert later.count() == 48


@pytest.fixture(scope="module")
def valid(spark):
    rows = [obs(datetime(2025, 3, 9) + k * HALF, cut=10.0 if k % 3 else 0.0) for k in range(48)]
    out = forecast(spark, rows, generated_at=T0).cache()
    out.count()
    return out


DAMAGE = {
    "null_key": ("id_ons", lambda c: F.lit(None).cast("string")),
    "duplicate_key": ("horizonte", lambda c: F.lit(7).cast("smallint")),
    "source_domain": ("fonte", lambda c: F.lit("hidro")),
    "kind_domain": ("tipo_saida", lambda c: F.lit("outro")),
    "kind_null": ("tipo_saida", lambda c: F.lit(None).cast("string")),
    "model_blank": ("modelo_id", lambda c: F.lit(" \t")),
    "horizon_range": ("horizonte", lambda c: F.lit(49).cast("smallint")),
    "tau_mismatch": ("tau", lambda c: c + F.make_dt_interval(mins=F.lit(30))),
    "cutoff_null": ("corte_dados", lambda c: F.lit(None).cast("timestamp_ntz")),
    "tau_null": ("tau", lambda c: F.lit(None).cast("timestamp_ntz")),
    "cutoff_after_t0": ("corte_dados", lambda c: F.col("t0") + F.make_dt_interval(mins=F.lit(1))),
    "scenario_blank": ("cenario_disponibilidade", lambda c: F.lit("")),
    "observation_not_released": ("instante_observacao", lambda c: F.col("corte_dados")),
    "coverage_range": ("cobertura_historico", lambda c: F.lit(1.01)),
    "generated_null": ("gerado_em", lambda c: F.lit(None).cast("timestamp_ntz")),
    "p_restricao_range": ("p_restricao", lambda c: F.lit("NaN").cast("double")),
    "p_causa_cnf_range": ("p_causa_cnf", lambda c: F.lit(-0.1)),
    "volume_p10_mwmed_range": ("volume_p10_mwmed", lambda c: F.lit("Infinity").cast("double")),
    "energy_mismatch": ("energia_esperada_mwh", lambda c: c + 0.01),
    "energy_volume_nulls": ("energia_esperada_mwh", lambda c: F.lit(None).cast("double")),
    "no_forecast_reason": ("p_corte", lambda c: F.lit(None).cast("double")),
    "alert_mismatch": ("alerta", lambda c: ~c),
    "alert_null": ("alerta", lambda c: F.lit(None).cast("boolean")),
    "threshold_null": ("limiar_alerta", lambda c: F.lit(None).cast("double")),
    "cause_domain": ("causa_prevista", lambda c: F.lit("PAR")),
    "cause_shares_partial": ("p_causa_rel", lambda c: F.lit(None).cast("double")),
    "cause_shares_sum": ("p_causa_ene", lambda c: F.lit(0.5)),
    "cause_not_largest": ("causa_prevista", lambda c: F.lit("REL")),
    "origin_domain": ("origem_prevista", lambda c: F.lit("X")),
}


def test_a_valid_forecast_passes(valid):
    assert K.contract_violations(valid).where("linhas > 0").count() == 0
    assert K.validate_forecast(valid.withColumn("extra", F.lit(1))).count() == 48


def test_each_rule_finds_its_damage(valid):
    """One damaged copy of a valid row per rule, each under its own entity."""
    row = valid.where("horizonte = 6 and causa_prevista = 'ENE'").limit(1)
    cases = None
    for name, (column, damage) in DAMAGE.items():
        broken = row.withColumn("id_ons", F.lit(name)).withColumn(column, damage(F.col(column)))
        if name == "duplicate_key":
            broken = broken.unionByName(broken)
        cases = broken if cases is None else cases.unionByName(broken)
    hits = {r["regra"]: r["linhas"] for r in K.contract_violations(cases).collect()}
    assert [name for name in DAMAGE if not hits[name]] == []
    assert hits["duplicate_key"] == 2 and hits["null_key"] == 1


def test_first_broken_rule_and_schema_errors_are_reported(valid):
    with pytest.raises(K.ContractError, match="model_blank \\(48 rows\\)"):
        K.validate_forecast(valid.withColumn("modelo_id", F.lit("")).withColumn("origem_prevista", F.lit("X")))
    with pytest.raises(K.ContractError, match="missing column tau"):
        K.validate_forecast(valid.drop("tau"))
    with pytest.raises(K.ContractError, match="horizonte is bigint"):
        K.validate_forecast(valid.withColumn("horizonte", F.col("horizonte").cast("bigint")))


