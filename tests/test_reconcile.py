from datetime import datetime

from gridcut.operators import reconcile as R
from gridcut.operators.targets import derive_targets
from helpers import HALF

T = datetime(2024, 2, 1)
OFFICIAL = (
    "val_geracaolimitada double, val_geracaoreferencia double, val_geracao double, "
    "val_geracaonaorealizadaapurada double"
)
ROW = (
    "fonte string, id_ons string, din_instante timestamp_ntz, val_geracao double, "
    "val_geracaolimitada double, val_geracaoreferencia double, cod_razaorestricao string, "
    "cod_origemrestricao string"
)


def test_formula_counts(spark):
    rows = [(0.0, 12.0, 4.0, 8.0), (None, 12.0, 4.0, None), (3.0, 12.0, 4.0, 9.0),
            (3.0, None, 4.0, 1.0), (3.0, 12.0, 4.0, None)]
    r = R.formula_validation(spark.createDataFrame(rows, OFFICIAL)).first()
    assert (r["rows"], r["published_nonnull"], r["comparable"]) == (5, 3, 2)
    assert (r["different_over_001_mw"], r["limited_missing_published"]) == (1, 1)
    assert r["max_difference_mw"] == 1.0


def test_revisions_separate_missing_rows_from_changed_values(spark):
    def table(rows):
        return derive_targets(spark.createDataFrame(rows, ROW))

    same = ("eolica", "A", T, 3.0, 1.0, 9.0, "ENE", "SIS")
    local = table(
        [
            same,
            ("eolica", "B", T, 3.0, 1.0, 9.0, "ENE", "SIS"),
            ("eolica", "C", T, 3.0, None, 9.0, None, None),
            ("eolica", "E", T, 3.0, None, 9.0, None, None),
        ]
    )
    official = table(
        [
            same,
            ("eolica", "B", T, 5.0, 1.0, 9.0, " ene", "SIS"),
            ("eolica", "D", T, 3.0, 1.0, 9.0, "CNF", "LOC"),
            ("eolica", "E", T, 3.0, None, 9.0, "", "\t"),
        ]
    )
    modified = spark.createDataFrame(
        [("eolica", "2024-02", "m1")], "fonte string, period string, last_modified string"
    )
    r = R.revision_check(local, official, modified).first()
    assert (r["local_rows"], r["official_rows"], r["matched"]) == (4, 4, 3)
    assert (r["only_local"], r["only_official"]) == (1, 1)
    assert (r["changed_inputs"], r["changed_numeric"], r["changed_labels"]) == (1, 1, 0)
    assert (r["changed_energy"], r["matched_delta_mwh"]) == (1, 1.0)
    assert r["revised"] and r["last_modified"] == "m1"
    clean = R.revision_check(local, local).first()
    assert not clean["revised"]


def test_totals_with_unknown_volume_get_no_delta(spark):
    columns = ROW + ", id_estado string, id_subsistema string, val_geracaonaorealizadaapurada double"

    def table(published):
        rows = [("eolica", "A", T + i * HALF, 3.0, 1.0, 9.0, "ENE", "SIS", "BA", "NE", p)
                for i, p in enumerate(published)]
        return derive_targets(spark.createDataFrame(rows, columns))

    local = table([6.0, 6.0])
    complete = R.totals_comparison(local, table([6.0, 4.0])).where("dimension = 'causa'").first()
    assert (complete["delta_mwh"], complete["delta_percent"]) == (1.0, 20.0)
    partial = R.totals_comparison(local, table([6.0, None])).collect()
    assert {r["dimension"] for r in partial} == set(R.TOTAL_DIMENSIONS)
    assert all(r["delta_mwh"] is None and not r["totals_comparable"] for r in partial)
