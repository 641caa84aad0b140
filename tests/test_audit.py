from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gridcut.operators import audit as A
from gridcut.schemas import MAIN_SCHEMA, detail_schema
from helpers import HALF

T = datetime(2025, 5, 1)


def main_rows(spark, rows):
    """Rows of the 24-column table; unspecified columns get consistent defaults."""
    base = {
        "id_subsistema": "NE", "id_estado": "BA", "nom_usina": "Usina", "id_ons": "A", "ceg": "X",
        "nom_subsistema": "NORDESTE", "nom_estado": "BAHIA", "din_instante": T,
        "val_geracao": 2.0, "val_disponibilidade": 9.0, "val_geracaoreferencia": 5.0,
        "fonte": "eolica", "arquivo_origem": "f",
    }
    out = []
    for row in rows:
        r = base | row
        ts = r["din_instante"]
        if ts is not None:
            calendar = {
                "ano": ts.year, "mes": ts.month, "data": ts.date(), "hora": ts.hour,
                "minuto": ts.minute, "ano_mes": f"{ts:%Y-%m}",
            }
            r = calendar | r
        out.append(tuple(r.get(f.name) for f in MAIN_SCHEMA))
    return spark.createDataFrame(out, MAIN_SCHEMA)


def test_time_axis_anomalies(spark):
    steps = [0, 0, 30, 90, 97, 127, 157]
    table = main_rows(spark, [{"din_instante": T + timedelta(minutes=m)} for m in steps])
    r = A.temporal_report(table).first()
    assert (r["duplicate_excess"], r["duplicate_groups"]) == (1, 1)
    assert (r["gaps"], r["missing_slots_between_observations"]) == (1, 1)
    assert (r["off_grid"], r["irregular_steps"], r["max_step_seconds"]) == (3, 1, 3600.0)


def test_keys_shared_and_missing(spark):
    table = main_rows(
        spark,
        [
            {},
            {"fonte": "fotovoltaica", "din_instante": T + HALF, "val_geracaolimitada": 1.0},
            {"id_ons": None},
            {"fonte": None, "id_ons": "B"},
            {"fonte": "hidro", "id_ons": "C"},
            {"din_instante": None, "id_ons": "D"},
        ],
    )
    r = A.key_report(table, ("eolica", "fotovoltaica")).first()
    assert (r["null_id"], r["null_time"], r["null_source"], r["invalid_source"]) == (1, 1, 1, 2)
    assert (r["entities"], r["ids_shared_across_sources"], r["limited_rows"]) == (6, 1, 1)
    assert (r["start"], r["end"]) == (T, T + HALF)


def test_switch_to_null_is_identity_drift(spark):
    rows = [{}, {"ceg": None, "din_instante": T + HALF}, {"id_ons": "B"}]
    got = A.identity_drift(main_rows(spark, rows)).collect()
    assert [(r["id_ons"], r["names"], r["cegs"]) for r in got] == [("A", 1, 2)]


def test_values_domains_and_calendar(spark):
    rows = [
        {"val_geracao": -1.0, "id_subsistema": "X"},
        {"val_geracao": float("nan"), "din_instante": T + HALF, "hora": 5},
        {"val_geracao": None, "din_instante": T + 2 * HALF, "ano_mes": None},
    ]
    table = main_rows(spark, rows)
    number = {r["coluna"]: r for r in A.numeric_report(table).collect()}["val_geracao"]
    assert (number["negative"], number["nonfinite"], number["min"], number["max"]) == (1, 1, -1, -1)
    domain = A.domain_report(table, A.domains_of(("eolica",))).where("coluna = 'id_subsistema'")
    assert {r["value"]: r["invalid_rows"] for r in domain.collect()} == {"X": 1, "NE": 0}
    off = A.calendar_mismatches(table).first()
    assert (off["hora"], off["ano_mes"], off["ano"]) == (1, 1, 0)
    nulls = {r["coluna"]: r["nulls"] for r in A.null_report(table).collect()}
    assert nulls["val_geracao"] == 1 and nulls["val_geracaolimitada"] == 3
    assert A.audit_status(A.audit_flags(table, ("eolica",))).first()["status"] == "issues"
    clean = main_rows(spark, [{}, {"din_instante": T + HALF}])
    assert A.audit_status(A.audit_flags(clean, ("eolica",))).first()["status"] == "ok"


def test_quantiles_stay_within_rank_error(spark):
    table = spark.range(20_001).select(F.col("id").cast("double").alias("v"))
    r = A.numeric_quantiles(table.unionByName(table.limit(1).select(F.lit(float("inf")).alias("v")))).first()
    for i, q in enumerate(A.QUANTILES):
        assert abs(r[f"q{i}"] - q * 20_000) <= 4


def test_multiset_difference_respects_multiplicity(spark):
    a = main_rows(spark, [{}, {}, {"val_geracao": float("nan")}])
    b = main_rows(spark, [{}, {"val_geracao": float("nan")}, {"id_ons": "Z"}])
    got = {r["direction"]: r["rows"] for r in A.multiset_difference(a, b, a.columns).collect()}
    assert got == {"main_minus_integrated": 1, "integrated_minus_main": 1}
    assert A.multiset_difference(a, a, a.columns).count() == 0


def test_repeated_detail_rows_stay_visible(spark):
    main = main_rows(spark, [{}, {"din_instante": T + HALF}, {"ceg": "-", "id_ons": "G"}])
    detail = spark.createDataFrame(
        [
            ("eolica", "A", "g1", T, 2.0),
            ("eolica", "A", "g1", T, 2.0),
            ("eolica", "A", None, T + HALF, 3.0),
            ("eolica", "G", "g2", T, 9.0),
        ],
        "fonte string, id_ons string, nom_conjuntousina string, din_instante timestamp_ntz, "
        "val_geracaoverificada double",
    )
    r = A.detail_values(main, detail).first()
    assert (r["join_rows"], r["matched_intervals"], r["duplicated_join_rows"]) == (3, 2, 1)
    assert (r["generation_different"], r["max_abs_difference_mw"]) == (1, 1.0)
    m = A.detail_membership(detail).first()
    assert (m["individuals"], m["group_names"], m["rows_without_group"]) == (2, 2, 1)
    o = A.detail_overlap(main, detail).first()
    assert (o["main_individual_ids"], o["matched_ids"]) == (1, 1)


def test_schema_drift_lists_each_problem(spark):
    seen = main_rows(spark, [{}]).drop("ceg").withColumn("ano", F.lit("x")).withColumn("novo", F.lit(1))
    got = A.schema_drift(spark, {"f": seen.schema}, MAIN_SCHEMA).collect()
    assert {(r["coluna"], r["problema"]) for r in got} == {
        ("ceg", "ausente"), ("ano", "tipo"), ("novo", "inesperada")
    }
    wind, solar = detail_schema("eolica"), detail_schema("fotovoltaica")
    assert wind["flg_dadoventoinvalido"].dataType.simpleString() == "double"
    assert solar["flg_dadoirradianciainvalido"].dataType.simpleString() == "boolean"


def test_file_status(spark, folder):
    good = main_rows(spark, [{}, {"din_instante": T + HALF}]).toArrow()
    at = good.schema.get_field_index("din_instante")
    nanos = good.set_column(at, "din_instante", good["din_instante"].cast(pa.timestamp("ns")))
    pq.write_table(nanos, f"{folder}/good.parquet")
    pq.write_table(nanos.drop(["ceg"]), f"{folder}/narrow.parquet")
    with open(f"{folder}/broken.parquet", "wb") as f:
        f.write(b"this is no table")
    names = ("good", "narrow", "broken", "absent")
    got = [A.file_status(spark, f"{folder}/{n}.parquet", "eolica") for n in names]
    assert got == ["ok", "invalid_schema", "unreadable", "missing"]


def test_audit_report_is_written(spark, folder):
    from gridcut.plans.jobs import audit_tables, write_tables

    write_tables(audit_tables(main_rows(spark, [{}]), ("eolica",)), folder)
    assert spark.read.json(f"{folder}/status").first()["status"] == "ok"
    assert spark.read.json(f"{folder}/nulls").count() == 24


def test_exact_quantiles_equal_sorted_ranks(spark, monkeypatch):
    import math
    import random

    rnd = random.Random(5)
    inf, nan = float("inf"), float("nan")
    wide = [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300) for _ in range(400)]
    columns = {
        "wide": wide,
        "ties": [float(rnd.choice([0, 0, 0, 1, 2])) for _ in range(400)],
        "close": [1 + k * 2**-52 for k in range(400)],
        "odd": [rnd.choice([inf, -inf, nan, None, -0.0, 0.5, 7.0]) for _ in range(400)],
        "none": [rnd.choice([nan, None]) for _ in range(400)],
    }
    table = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns))
    shares = (0.0, 0.001, 0.25, 0.5, 0.999, 1.0)
    for parts in (4096, 3):
        monkeypatch.setattr(A, "INTERVAL_PARTS", parts)
        got = {r["coluna"]: list(r)[1:] for r in A.exact_quantiles(table.repartition(3), quantiles=shares).collect()}
        for name, values in columns.items():
            own = sorted(v for v in values if v is not None and math.isfinite(v))
            want = [own[max(1, len(own) - math.floor(len(own) - q * len(own))) - 1] if own else None for q in shares]
            assert got[name] == want, (name, parts)


def test_equal_months_are_not_compared_row_by_row(spark, monkeypatch):
    from datetime import datetime

    def row(month, gen, source="eolica"):
        return (source, "A", datetime(2025, month, 1) if month else None, gen, None)

    schema = "fonte string, id_ons string, din_instante timestamp_ntz, v double, w double"
    same = [row(1, 1.0), row(1, 1.0), row(2, None), row(None, 3.0)]
    a = spark.createDataFrame([*same, row(3, 1.0), row(3, 1.0), row(4, 5.0), row(5, 2.0, None)], schema)
    b = spark.createDataFrame([*same[::-1], row(3, 1.0), row(5, 2.0, None), row(6, 1.0, "x")], schema)
    swapped = b.select("fonte", "id_ons", "din_instante", F.col("w").alias("v"), F.col("v").alias("w"))
    seen = []
    kept = A.stored
    monkeypatch.setattr(A, "stored", lambda df, name: seen.append(kept(df, name)) or seen[-1])
    got = {(r["direction"], r["fonte"], r["period"]): r["rows"] for r in A.multiset_difference(a, b, a.columns).collect()}
    assert got == {
        ("main_minus_integrated", "eolica", "2025-03"): 1,
        ("main_minus_integrated", "eolica", "2025-04"): 1,
        ("integrated_minus_main", "x", "2025-06"): 1,
    }
    assert {tuple(r) for r in seen[0].collect()} == {("eolica", "2025-03"), ("eolica", "2025-04"), ("x", "2025-06")}
    assert A.multiset_difference(b, swapped, a.columns).agg(F.sum("rows")).first()[0] == 12
    assert A.multiset_difference(a, a.repartition(3), a.columns).count() == 0


def test_folder_drift_reads_footers_of_all_files(spark, folder):
    good = spark.createDataFrame([(1, "a")], "k long, s string").coalesce(1)
    good.write.parquet(f"{folder}/x/ok")
    good.withColumn("k", F.col("k").cast("int")).write.parquet(f"{folder}/x/y/retyped")
    good.limit(0).drop("s").coalesce(1).withColumn("extra", F.lit(1.5)).write.parquet(f"{folder}/odd name %41")
    got = sorted((r["coluna"], r["problema"], r["tipo"], r["esperado"], r["linhas"]) for r in A.folder_drift(spark, folder, good.schema).collect())
    assert got == [
        ("extra", "inesperada", "double", None, 0), ("k", "tipo", "int", "bigint", 1), ("s", "ausente", None, "string", 0)
    ]
