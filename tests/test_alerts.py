from datetime import datetime

import pytest

from gridcut.operators import alerts as A
from helpers import HALF

T0 = datetime(2026, 9, 10)
SCHEMA = (
    "fonte string, id_ons string, t0 timestamp_ntz, horizonte int, tau timestamp_ntz, "
    "p_corte double, limiar_alerta double, alerta boolean, causa_prevista string, "
    "origem_prevista string, potencial_referencia_mwmed double, nom_usina string, id_estado string"
)


def plant(name, *, alerts=(), blind=(), idle=(), causes=None, origin="SIS", fonte="eolica", t0=T0):
    rows = []
    for h in range(1, 49):
        p = None if h in blind else (0.9 if h in alerts else 0.1)
        rows.append(
            (fonte, name, t0, h, t0 + (h - 1) * HALF, p, 0.5, None if p is None else h in alerts,
             (causes or {}).get(h, "ENE"), origin, 0.0 if h in idle else 50.0, None, "BA")
        )
    return rows


def notice(spark, *plants):
    return spark.createDataFrame([r for p in plants for r in p], SCHEMA)


def test_runs_of_alerts_become_windows(spark):
    got = A.alert_windows(notice(spark, plant("A", alerts={23, 24, 25, 26, 30}))).orderBy("inicio").collect()
    assert [(r["inicio"], r["fim"], r["horas"]) for r in got] == [
        (T0 + 22 * HALF, T0 + 26 * HALF, 2.0),
        (T0 + 29 * HALF, T0 + 30 * HALF, 0.5),
    ]
    assert got[0]["chance_max"] == pytest.approx(0.9) and got[0]["causa"] == "ENE"


def test_missing_forecast_breaks_a_run_and_is_never_free(spark):
    table = notice(spark, plant("A", alerts={10, 11, 13}, blind={12}))
    assert A.alert_windows(table).count() == 2
    assert sum(r["horas"] for r in A.free_windows(table).collect()) == (48 - 4) / 2


def test_free_hours_need_generation(spark):
    table = notice(spark, plant("S", fonte="fotovoltaica", alerts={25, 26}, idle=set(range(1, 13))))
    free = A.free_windows(table).orderBy("inicio").collect()
    assert free[0]["inicio"] == T0 + 12 * HALF
    assert sum(r["horas"] for r in free) == (48 - 12 - 2) / 2


def test_typical_cause_and_ties(spark):
    table = notice(
        spark,
        plant("MODE", alerts={1, 2, 3}, causes={1: "CNF"}),
        plant("TIE", alerts={1, 2}, causes={1: "CNF"}),
        plant("NONE", alerts={1, 2}, causes={1: None, 2: None}, origin=None),
        plant("PART", alerts={1, 2, 3}, causes={1: None, 2: None, 3: "REL"}),
    )
    got = {r["id_ons"]: (r["causa"], r["origem"]) for r in A.alert_windows(table).collect()}
    assert got == {"MODE": ("ENE", "SIS"), "TIE": ("MISTA", "SIS"), "NONE": (None, None),
                   "PART": ("REL", "SIS")}


def test_summary_order_and_main_window(spark):
    table = notice(
        spark,
        plant("FEW", alerts={20}),
        plant("MANY", alerts={*range(3, 6), *range(20, 30), *range(34, 44)}),
        plant("CALM"),
        plant("BLIND", blind=set(range(1, 49))),
        plant("MANY", alerts={48}, t0=T0.replace(day=11)),
    )
    first_day = table.where("t0 = timestamp_ntz'2026-09-10'")
    rows = A.ranked(A.plant_summary(first_day)).collect()
    assert [r["id_ons"] for r in rows] == ["MANY", "FEW", "CALM", "BLIND"]
    assert [r["status"] for r in rows] == [A.IN_ALERT, A.IN_ALERT, A.NO_ALERT, A.NO_FORECAST]
    many, blind = rows[0], rows[3]
    assert (many["horas_alerta"], many["janelas"], many["motivo"]) == (11.5, 3, "ENE")
    assert (many["janela_inicio"], many["janela_fim"]) == (T0 + 19 * HALF, T0 + 29 * HALF)
    assert many["primeiro_alerta"] == T0 + 2 * HALF and many["id_estado"] == "BA"
    assert blind["horas_alerta"] is None and blind["horas_livres"] is None
    assert A.plant_summary(table).count() == 5
    cards = A.portfolio_cards(A.plant_summary(first_day)).first()
    assert (cards["usinas_em_alerta"], cards["usinas_previstas"]) == (2, 3)
    assert (cards["mediana_horas_alerta"], cards["motivo"], cards["parcela_motivo"]) == (6.0, "ENE", 1.0)


def test_top_per_source_shares_the_places(spark):
    plants = [plant(f"W{i}", alerts=set(range(1, 3 + i))) for i in range(4)]
    plants += [plant("S0", fonte="fotovoltaica", alerts={4})]
    got = A.top_per_source(A.plant_summary(notice(spark, *plants)), 5).orderBy("fonte", "posicao")
    assert [r["id_ons"] for r in got.collect()] == ["W3", "W2", "S0"]


def test_heat_map_and_states(spark):
    table = notice(spark, plant("A", alerts={2}, blind={3}, idle={4}))
    row = A.heatmap(table).first()
    assert row["1"] == pytest.approx(0.049) and row["2"] == pytest.approx(0.95)
    assert row["3"] is None and row["4"] is None
    states = {r["horizonte"]: r["estado"] for r in A.half_hour_state(table).collect()}
    assert [states[h] for h in (1, 2, 3, 4)] == [
        "livre", "em alerta", "sem previsão", "sem geração prevista"
    ]


def test_texts(spark):
    rows = [
        (T0 + 22 * HALF, T0 + 30 * HALF, "ENE", "SIS", 1.0),
        (T0 + 21 * HALF, T0 + 48 * HALF, "CNF", "LOC", 2.0),
        (T0, T0 + HALF, None, None, 0.5),
        (T0, T0 + HALF, "MISTA", "X", 0.5),
    ]
    df = spark.createDataFrame(
        rows, "a timestamp_ntz, b timestamp_ntz, c string, o string, h double"
    )
    got = df.select(
        A.window_text("a", "b").alias("w"), A.cause_text("c", "o").alias("t"), A.advice_text("h").alias("s")
    ).collect()
    assert [r["w"] for r in got] == ["11h às 15h", "10h30 às 24h", "0h às 0h30", "0h às 0h30"]
    assert got[0]["t"] == "sobra de energia no sistema · origem sistêmica"
    assert got[2]["t"] == A.NO_CAUSE_TEXT and got[3]["t"] == "motivos variados"
    assert "manutenção" in got[1]["s"] and "manutenção" not in got[0]["s"]
