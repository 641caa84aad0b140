"""Small observation tables for the operator tests."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gridcut.operators.targets import derive_targets

RAW = (
    "fonte string, id_ons string, nom_usina string, id_estado string, id_subsistema string, "
    "din_instante timestamp_ntz, val_geracaolimitada double, val_geracaoreferencia double, "
    "val_geracao double, cod_razaorestricao string, cod_origemrestricao string"
)
HALF = timedelta(minutes=30)


def obs(when, *, cut=0.0, id_ons="A1", fonte="eolica", state="BA", cause="ENE", origin="SIS"):
    limited = cut > 0
    return (
        fonte,
        id_ons,
        f"Usina {id_ons}",
        state,
        "NE",
        when,
        5.0 if limited else None,
        30.0,
        30.0 - cut,
        cause if limited else None,
        origin if limited else None,
    )


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def history(spark, rows):
    return derive_targets(raw(spark, rows))


def noon_rows(first, days, cut=0.0, **options):
    out = []
    for i in range(days):
        day = first + timedelta(days=i)
        amount = cut(day) if callable(cut) else cut
        out.append(obs(datetime.combine(day, datetime.min.time()) + 24 * HALF, cut=amount, **options))
    return out


def dense_history(spark, first, days, plants=("P1", "P2", "P3")):
    """Half-hourly rows of several plants; cuts on odd days from 08:00 to 16:00, causes rotate."""
    rows = spark.createDataFrame([(p, i) for i, p in enumerate(plants)], "id_ons string, i int")
    day = F.explode(F.sequence(F.lit(first), F.date_add(F.lit(first), days - 1))).alias("d")
    grid = rows.select("id_ons", "i", day).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("s")
    )
    number = F.unix_date("d")
    cut = (number % 2 == 1) & F.col("s").between(16, 31)
    cause = F.element_at(F.array(F.lit("REL"), F.lit("CNF"), F.lit("ENE")), number % 3 + 1)
    table = grid.select(
        F.when(F.col("i") % 2 == 0, "eolica").otherwise("fotovoltaica").alias("fonte"),
        "id_ons",
        F.concat(F.lit("Usina "), "id_ons").alias("nom_usina"),
        F.lit("BA").alias("id_estado"),
        F.lit("NE").alias("id_subsistema"),
        (F.col("d").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("s") * 30)).alias(
            "din_instante"
        ),
        F.when(cut, 5.0).alias("val_geracaolimitada"),
        F.lit(30.0).alias("val_geracaoreferencia"),
        F.when(cut, 20.0).otherwise(30.0).alias("val_geracao"),
        F.when(cut, cause).alias("cod_razaorestricao"),
        F.when(cut, "SIS").alias("cod_origemrestricao"),
    )
    return derive_targets(table)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()] if columns else df.collect()
