import hashlib
import os
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridcut.operators.descriptive import with_calendar
from gridcut.operators.model import attributes_with_fallback, entity_attributes
from gridcut.sources import readers as R
from gridcut.sources import sinks as W
from helpers import HALF, obs, raw

T = datetime(2026, 8, 24, 12)


def write_main(spark, folder, name, rows, unit="ns"):
    table = raw(spark, rows).toArrow()
    at = table.schema.get_field_index("din_instante")
    os.makedirs(f"{folder}/raw", exist_ok=True)
    cast = table.set_column(at, "din_instante", table["din_instante"].cast(pa.timestamp(unit)))
    pq.write_table(cast.append_column("sobra", pa.array([1] * len(rows))), f"{folder}/raw/{name}")


@pytest.fixture
def data(spark, folder):
    rows = [obs(T + k * HALF, cut=10.0) for k in range(4)]
    write_main(spark, folder, "constrained_off_eolica_tm.parquet", rows)
    solar = [obs(T, fonte="fotovoltaica", id_ons="S1")]
    write_main(spark, folder, "constrained_off_fotovoltaica_tm.parquet", solar, "us")
    return folder


def test_history_is_half_open_and_reads_only_what_it_needs(spark, data):
    got = R.load_history(spark, data, T, T + 2 * HALF)
    assert sorted((r["fonte"], r["din_instante"]) for r in got.collect()) == [
        ("eolica", T), ("eolica", T + HALF), ("fotovoltaica", T)
    ]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "sobra" not in plan
    assert plan.count("GreaterThanOrEqual(din_instante") == 2
    one = R.load_history(spark, data, T, T + HALF, sources=("eolica",))
    assert one.count() == 1 and one.first()["volume_mwmed"] == 10.0


def test_reserved_period_is_refused(spark, data):
    with pytest.raises(ValueError, match="reserved"):
        R.load_history(spark, data, T, datetime(2026, 9, 2))
    assert R.load_history(spark, data, T, datetime(2026, 9, 2), allow_reserved=True).count() == 5


def test_base_from_files(spark, data):
    base = R.load_base(spark, data, datetime(2026, 9, 1))
    assert base.count() == 5 and base.where("corte = 1").count() == 4


def test_nanoseconds_keep_microseconds(spark, folder):
    moment = 1_756_000_000_123_456_789
    pq.write_table(pa.table({"din_instante": pa.array([moment], pa.timestamp("ns"))}), f"{folder}/t.parquet")
    got = R.naive_time(R.read_parquet(spark, f"{folder}/t.parquet")).first()["din_instante"]
    assert got.microsecond == 123_456 and got.year == 2025


def test_later_publication_wins(spark, folder):
    for i, cut in enumerate((10.0, 20.0)):
        rows = [obs(T, cut=cut)] + ([obs(T + HALF)] if i == 0 else [])
        published = raw(spark, rows).drop("fonte").withColumn("nova", F.lit(i))
        published = published.withColumn("val_geracao", F.col("val_geracao").cast("string"))
        published.coalesce(1).write.parquet(f"{folder}/m{i}")
    got = R.read_republished(spark, [("eolica", f"{folder}/m0"), ("eolica", f"{folder}/m1")])
    assert {r["din_instante"]: r["volume_mwmed"] for r in got.collect()} == {T: 20.0, T + HALF: 0.0}
    both = R.read_publication(spark, "eolica", [f"{folder}/m0", f"{folder}/m1"])
    assert both.count() == 3 and set(both.columns) >= {"nova", "fonte"}


def test_unreadable_numbers_become_null(spark):
    bad = raw(spark, [obs(T)]).withColumn("val_geracao", F.lit("n/d"))
    assert R.normalise_publication(bad, "eolica").first()["val_geracao"] is None


def test_attributes_fall_back_to_the_snapshot(spark):
    late = list(obs(T + HALF))
    late[2] = None
    recent = raw(spark, [obs(T), tuple(late)])
    snapshot = raw(spark, [obs(T, state="CE"), obs(T, id_ons="OLD", state="PI")])
    got = {r["id_ons"]: (r["nom_usina"], r["id_estado"])
           for r in attributes_with_fallback(recent, snapshot).collect()}
    assert got == {"A1": ("Usina A1", "BA"), "OLD": ("Usina OLD", "PI")}


def test_snapshot_columns(spark, data):
    got = entity_attributes(R.snapshot_columns(spark, data))
    assert {r["id_ons"] for r in got.collect()} == {"A1", "S1"}


def test_manifest(spark, data):
    got = {r["arquivo"]: r for r in R.file_manifest(spark, f"{data}/raw").collect()}
    for name, r in got.items():
        with open(f"{data}/raw/{name}", "rb") as f:
            content = f.read()
        assert (r["bytes"], r["sha256"]) == (len(content), hashlib.sha256(content).hexdigest())
    assert len(got) == 2


NOTICE = "fonte string, id_ons string, t0 timestamp_ntz, p_corte double"


def test_upsert_replaces_one_notice_and_repeats_safely(spark, folder):
    path = f"{folder}/avisos"
    first = spark.createDataFrame([("eolica", "A", T, 0.1), ("eolica", "A", T + HALF, 0.2)], NOTICE)
    again = spark.createDataFrame([("eolica", "A", T + HALF, 0.3)], NOTICE).withColumn("novo", F.lit(1))
    W.upsert_notices(first, path)
    for _ in range(2):
        W.upsert_notices(again, path)
        got = {r["t0"]: (r["p_corte"], r["novo"]) for r in W.read_notices(spark, path).collect()}
        assert got == {T: (0.1, None), T + HALF: (0.3, 1)}
    with pytest.raises(ValueError, match="empty"):
        W.upsert_notices(first.where("false"), path)


def test_sorted_and_text_sinks(spark, folder):
    table = with_calendar(raw(spark, [obs(T + k * HALF, id_ons=f"E{k % 3}") for k in range(30)]))
    W.write_sorted(table, f"{folder}/s", "fonte", "id_ons", "din_instante")
    W.write_sorted(table, f"{folder}/p", "id_ons", partition_by=("fonte",))
    assert spark.read.parquet(f"{folder}/s").count() == spark.read.parquet(f"{folder}/p").count() == 30
    small = table.groupBy("id_ons").count()
    W.write_csv(small, f"{folder}/c")
    W.write_json(small, f"{folder}/j")
    assert spark.read.csv(f"{folder}/c", header=True).count() == spark.read.json(f"{folder}/j").count() == 3
