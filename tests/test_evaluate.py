import random
from datetime import date

import pytest

from gridcut.operators import evaluate as E
from gridcut.operators import impact as I

LIMITS = {"eolica": 0.5}


def scores(spark, pairs, fonte="eolica"):
    return spark.createDataFrame(
        [(fonte, float(y), p) for y, p in pairs], "fonte string, y_corte double, p_corte double"
    )


def test_threshold_takes_whole_tie_groups(spark):
    easy = scores(spark, [(1, 0.9), (1, 0.8), (1, 0.6), (0, 0.4), (0, 0.1)])
    assert E.best_threshold(easy).first()["limiar"] == 0.6
    tied = scores(spark, [(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.4), (0, 0.4)])
    assert E.best_threshold(tied).first()["limiar"] == 0.9
    assert E.rounded_thresholds(scores(spark, [(1, 0.123456), (0, 0.1)])).first()["limiar"] == 0.1235


def test_average_precision_and_brier_against_definition(spark):
    rng = random.Random(8)
    pairs = [(int(rng.random() < 0.3), rng.choice([0.0, 0.2, 0.2, 0.5, round(rng.random(), 3)]))
             for _ in range(300)]
    got = E.ranking_scores(scores(spark, pairs), ["fonte"], {"m": "p_corte"}).first()
    positives = sum(y for y, _ in pairs)
    ap = 0.0
    for s in sorted({p for _, p in pairs}, reverse=True):
        picked = [y for y, p in pairs if p >= s]
        ap += sum(y for y, p in pairs if p == s) / positives * sum(picked) / len(picked)
    assert got["ap"] == pytest.approx(ap)
    assert got["brier"] == pytest.approx(sum((p - y) ** 2 for y, p in pairs) / len(pairs))
    single = E.ranking_scores(scores(spark, [(1, 0.4), (1, 0.2)]), ["fonte"], {"m": "p_corte"}).first()
    assert single["ap"] is None and single["brier"] is None


def test_macro_f1_counts_missing_guess_as_wrong(spark):
    schema = (
        "fonte string, mes string, y_causa string, causa_rel_28d double, causa_cnf_28d double, "
        "causa_ene_28d double, estado_rel_7d double, estado_cnf_7d double, estado_ene_7d double"
    )
    rows = [
        ("eolica", "m", "REL", 0.5, 0.5, 0.0, 0.0, 0.0, 1.0),
        ("eolica", "m", "ENE", 0.1, 0.2, 0.7, 0.0, 0.0, 1.0),
        ("eolica", "m", "ENE", None, None, None, 0.0, 0.0, 1.0),
        ("eolica", "m", None, 0.9, 0.1, 0.0, 0.0, 0.0, 1.0),
    ]
    r = E.cause_metrics(spark.createDataFrame(rows, schema)).first()
    assert r["n_causa"] == 3
    assert r["f1_usina_28d"] == pytest.approx((1 + 0 + 2 / 3) / 3)
    assert r["f1_estado_7d"] == pytest.approx((0 + 0 + 0.8) / 3)


def test_adoption_needs_mean_and_six_months(spark):
    def decide(wins):
        rows = [("eolica", 0.8 if i < wins else 0.69, 0.7, 0.5, 0.4) for i in range(8)]
        schema = (
            "fonte string, ap_modelo double, ap_historico double, "
            "ap_mesmo_slot_ultimo_dia double, ap_ultimo_valor double"
        )
        return E.adoption(spark.createDataFrame(rows, schema)).first()

    six, five = decide(6), decide(5)
    assert six["adota_modelo"] and six["meses_vencidos"] == 6 and six["meses"] == 8
    assert six["melhor_baseline"] == "historico"
    assert not five["adota_modelo"] and five["modelo_media"] > five["baseline_media"]


def test_energy_coverage(spark):
    rows = [
        ("eolica", "U", date(2026, 9, 1), 0, True, 30.0, 0.9, 0.1),
        ("eolica", "U", date(2026, 9, 1), 1, True, 10.0, 0.1, 0.9),
        ("eolica", "U", date(2026, 9, 1), 2, False, 0.0, 0.8, 0.2),
        ("eolica", "U", date(2026, 9, 1), 3, True, 60.0, None, 0.5),
    ]
    schema = (
        "fonte string, id_ons string, dia date, slot int, corte boolean, energia_mwh double, "
        "p_corte double, hist_28d double"
    )
    r = E.energy_coverage(spark.createDataFrame(rows, schema), LIMITS).first()
    assert r["fracao_energia_avisada"] == pytest.approx(0.3)
    assert r["recall_meia_hora"] == pytest.approx(1 / 3)
    assert r["precisao_meia_hora"] == pytest.approx(1 / 2)
    assert r["taxa_alerta"] == pytest.approx(2 / 3)
    assert r["fracao_energia_historico_mesmo_n"] == pytest.approx(0.1)
    assert r["meias_horas_cortadas_sem_previsao"] == 1
    assert (r["usina_dias_com_corte"], r["fracao_usina_dias_avisados"]) == (1, 1.0)


DAY = (
    "fonte string, id_ons string, dia date, slot int, limitada boolean, geracao double, "
    "referencia double, p_corte double, hist_28d double, ref_hist_28d double"
)


def day(spark, p, limited=(), skip=()):
    rows = [
        ("eolica", "U", date(2026, 9, 1), s, s in limited, 50.0 if s in limited else 100.0, 100.0,
         p(s), 0.0, 100.0)
        for s in range(48) if s not in skip
    ]
    return I.for_fractions(spark.createDataFrame(rows, DAY), [0.1])


def test_stop_loss(spark):
    df = spark.createDataFrame(
        [(100.0, 102.0, False), (60.0, 120.0, True), (115.0, 120.0, True)],
        "geracao double, referencia double, limitada boolean",
    )
    got = [r[0] for r in df.select(I.stop_loss_mwh(0.1)).collect()]
    assert got == pytest.approx([5.0, 0.0, 3.5])
    for bad in (0.0, -0.1, 1.5):
        with pytest.raises(ValueError):
            I.stop_loss_mwh(bad)
        with pytest.raises(ValueError):
            I.for_fractions(df, [bad])


def test_blocks_are_complete_runs_inside_the_window(spark):
    blocks = I.block_table(day(spark, lambda s: 0.1))
    assert sorted(r["inicio"] for r in blocks.collect()) == list(range(12, 33))
    gap = I.block_table(day(spark, lambda s: 0.1, skip={20}))
    assert sorted(r["inicio"] for r in gap.collect()) == [*range(12, 17), *range(21, 33)]
    assert I.choose_blocks(gap, LIMITS).count() == 0


def test_choices_and_savings(spark):
    cut = {22, 23, 24, 25}
    alert = I.choose_blocks(I.block_table(day(spark, lambda s: 0.9 if s in cut else 0.05, cut)), LIMITS)
    r = alert.first()
    assert (r["inicio_modelo"], r["modelo"], r["oraculo"]) == (22, 0.0, 0.0)
    assert r["fixo_08h"] == pytest.approx(20.0)
    assert r["dia_com_alerta"] and r["modelo_so_alerta"] == 0.0 and r["inicio_historico"] == 12
    calm = I.choose_blocks(I.block_table(day(spark, lambda s: 0.1)), LIMITS).first()
    assert not calm["dia_com_alerta"] and calm["modelo_so_alerta"] == calm["menor_potencial"]
    rows = I.saving_summary(alert).where("estrategia = 'modelo' and referencia = 'fixo_08h'").collect()
    assert {x["recorte"] for x in rows} == {"todos", "dias_com_alerta"}
    assert all(x["economia_mediana_mwh"] == pytest.approx(20.0) for x in rows)
    assert all(x["fracao_do_teto"] == pytest.approx(1.0) and x["fracao_melhor"] == 1.0 for x in rows)
