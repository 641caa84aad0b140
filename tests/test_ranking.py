import random
import re
import statistics
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridcut.functions.neighbours import with_neighbours
from gridcut.functions.ranking import exact_median, running_totals, take_first
from gridcut.operators import asof
from gridcut.operators.asof import asof_backward
from gridcut.plans.catalog import QUERIES


def test_running_totals_equal_a_plain_window(spark):
    rng = random.Random(5)
    values = {(g, round(rng.choice([rng.gauss(0, 1e-6), rng.gauss(0, 5), rng.uniform(0, 1e5)]), 9))
              for g in "ab" for _ in range(400)}
    rows = [(g, v, rng.randint(1, 9)) for g, v in values]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    for descending in (True, False):
        got = running_totals(df, ["g"], "v", {"cum": "n"}, descending=descending)
        arrow = F.desc("v") if descending else F.asc("v")
        want = df.select(
            "*",
            F.sum("n").over(Window.partitionBy("g").orderBy(arrow)).alias("cum"),
            F.sum("n").over(Window.partitionBy("g")).alias("cum_all"),
        )
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_totals_break_ties_by_key(spark):
    df = spark.createDataFrame([("x", 1.0, k, 1) for k in "dbca"], "g string, v double, k string, n int")
    got = running_totals(df, ["g"], "v", {"r": "n"}, ties=["k"])
    assert {r["k"]: r["r"] for r in got.collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}


def test_exact_median(spark):
    rng = random.Random(3)
    groups = {g: [rng.choice([0.0, rng.gauss(0, 3)]) for _ in range(n)]
              for g, n in (("odd", 101), ("even", 60), ("one", 1))}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("odd", None)]
    got = exact_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "m")
    for r in got.collect():
        assert abs(r["m"] - statistics.median(groups[r["g"]])) < 1e-12


def test_take_first_with_nulls_ties_and_any_budget(spark):
    rng = random.Random(9)
    rows = [("s", rng.choice([None, 0.5, 0.5, 0.25, 1.0]), f"e{rng.randint(0, 5)}", i)
            for i in range(120)]
    df = spark.createDataFrame(rows, "f string, h double, id string, w long")
    ranked = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[2], r[3]))
    for budget in (0, 1, 7, 60, 119, 120, 500):
        b = spark.createDataFrame([("s", budget)], "f string, b long")
        got = take_first(df, ["f"], [("h", True), ("id", False), ("w", False)], b, "b")
        assert sorted(r["w"] for r in got.collect()) == sorted(r[3] for r in ranked[:budget])


def test_neighbours_equal_lag_and_lead(spark):
    rng = random.Random(1)
    t0 = datetime(2024, 1, 1, 20)
    rows = [(k, t0 + timedelta(minutes=30 * m), float(m))
            for k in "pq" for m in rng.sample(range(400), 150)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    got = with_neighbours(df, ["k"], "ts", previous={"p": "ts", "pv": "v"}, following={"n": "ts"})
    w = Window.partitionBy("k").orderBy("ts")
    want = df.select(
        "*", F.lag("ts").over(w).alias("p"), F.lag("v").over(w).alias("pv"), F.lead("ts").over(w)
    )
    assert sorted(map(str, got.collect())) == sorted(
        map(str, want.toDF("k", "ts", "v", "p", "pv", "n").collect())
    )


def test_asof_takes_the_whole_matched_row(spark):
    rng = random.Random(2)
    day = datetime(2024, 1, 1)
    table = [(k, day + timedelta(days=d), rng.choice([None, float(d)]), d)
             for k in "ab" for d in rng.sample(range(200), 40)]
    probes = [(k, day + timedelta(days=d), i) for i, (k, d) in
              enumerate((k, d) for k in "abc" for d in rng.sample(range(-5, 220), 60))]
    left = spark.createDataFrame(probes, "k string, t timestamp_ntz, i int")
    right = spark.createDataFrame(table, "k string, t timestamp_ntz, v double, d int")
    got = {r["i"]: (r["v"], r["d"]) for r in asof_backward(left, right, ["k"], "t", ["v", "d"]).collect()}
    assert len(got) == len(probes)
    for k, t, i in probes:
        older = [r for r in table if r[0] == k and r[1] <= t]
        want = max(older, key=lambda r: r[1])[2:] if older else (None, None)
        assert got[i] == want


def test_parts_of_the_asof_query_follow_its_rows(spark, monkeypatch):
    """More rows give more tasks, not larger ones, in every shuffle; the session has four parts."""
    build = QUERIES["asof_supplier_price"]
    want = sorted(map(str, build(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(asof, "ROWS_PER_TASK", 500)
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    got = build(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    parts = [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", plan)]
    assert len(parts) >= 5 and min(parts) >= rows // 500
    assert sorted(map(str, got.collect())) == want
