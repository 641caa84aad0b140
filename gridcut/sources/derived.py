"""Curtailment tables derived from the `events` table, so that every query grows with it.

An entity is a block of twenty user ids of one parity; its half-hour rows are aggregates of events.
The smallest event id of a row decides which irregularity it carries (missing, negative or
non-finite inputs, zero limits, padded or unknown labels), so all rules meet real cases.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcut.functions.scalars import mapped, plus_minutes
from gridcut.schemas import MAIN_SCHEMA, RAW_COLUMNS

USERS_PER_ENTITY = 20
MONEY = "decimal(18,2)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _half_hour(ts: str) -> Column:
    t = F.col(ts)
    seconds = F.extract(F.lit("SECOND"), t)
    return t - F.make_dt_interval(mins=F.minute(t) % 30, secs=seconds)


def _source() -> Column:
    return F.when(F.col("user_id") % 2 == 0, "eolica").otherwise("fotovoltaica")


def _block() -> Column:
    return F.floor(F.col("user_id") / USERS_PER_ENTITY)


def _stopped() -> Column:
    return F.col("event_type").isin("error", "signup")


def readings(ev: DataFrame) -> DataFrame:
    """One row per event: repeated half hours and some rows off the half-hour grid."""
    slot = _half_hour("ts")
    shifted = F.when(F.col("event_id") % 101 == 0, plus_minutes(slot, 7)).otherwise(slot)
    return ev.select(
        _source().alias("fonte"),
        F.concat(F.lit("U"), _block().cast("string")).alias("id_ons"),
        shifted.alias("din_instante"),
        F.col("value").alias("val_geracao"),
    )


def main_table(ev: DataFrame) -> DataFrame:
    """The 24-column main table, one row per (source, entity, half hour)."""
    amount = F.col("value").cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    grouped = ev.groupBy(
        _source().alias("fonte"), _block().alias("k"), _half_hour("ts").alias("din_instante")
    ).agg(
        F.sum(amount).cast("double").alias("ref"),
        F.sum(F.when(_stopped(), zero).otherwise(amount)).cast("double").alias("gen"),
        F.sum(F.when(_stopped(), amount)).cast("double").alias("lim"),
        F.min("event_id").alias("e"),
    )
    k, e, ts = F.col("k"), F.col("e"), F.col("din_instante")
    limited = F.col("lim").isNotNull()
    nan, inf = F.lit("NaN").cast("double"), F.lit("Infinity").cast("double")
    out = grouped.select(
        mapped(F.pmod(k, F.lit(4)), {0: "NE", 1: "NE", 2: "N", 3: "SE"}).alias("id_subsistema"),
        mapped(F.pmod(k, F.lit(4)), {0: "BA", 1: "RN", 2: "CE", 3: "PI"}).alias("id_estado"),
        F.concat(
            F.lit("Usina U"), k.cast("string"), F.when(e % 400 == 0, " nova").otherwise("")
        ).alias("nom_usina"),
        F.concat(F.lit("U"), k.cast("string")).alias("id_ons"),
        F.when(k % 3 == 0, "-").when(k % 3 == 2, F.concat(F.lit("CEG."), k.cast("string"))).alias(
            "ceg"
        ),
        mapped(
            F.pmod(k, F.lit(4)), {0: "NORDESTE", 1: "NORDESTE", 2: "NORTE", 3: "SUDESTE"}
        ).alias("nom_subsistema"),
        mapped(
            F.pmod(k, F.lit(4)), {0: "BAHIA", 1: "RIO GRANDE DO NORTE", 2: "CEARA", 3: "PIAUI"}
        ).alias("nom_estado"),
        ts,
        F.when(e % 107 == 0, F.lit(None).cast("double"))
        .when(e % 89 == 0, F.lit(-1.0))
        .when(e % 29 == 0, F.col("ref"))
        .otherwise(F.col("gen"))
        .alias("val_geracao"),
        F.when(limited & (e % 83 == 0), nan)
        .when(limited & (e % 31 == 0), F.lit(0.0))
        .otherwise(F.col("lim"))
        .alias("val_geracaolimitada"),
        (F.col("ref") + 10.0).alias("val_disponibilidade"),
        F.when(e % 97 == 0, F.lit(None).cast("double"))
        .when(e % 193 == 0, inf)
        .otherwise(F.col("ref"))
        .alias("val_geracaoreferencia"),
        F.when(e % 5 == 2, F.col("ref"))
        .when(e % 50 == 0, F.col("ref"))
        .alias("val_geracaoreferenciafinal"),
        F.when(limited | (e % 7 == 0), mapped(e % 5, {0: "ENE", 1: " cnf ", 2: "REL", 3: "XXX"}))
        .alias("cod_razaorestricao"),
        F.when(limited | (e % 7 == 0), mapped(e % 3, {0: "SIS", 1: "loc"})).alias(
            "cod_origemrestricao"
        ),
        F.when(limited, "ordem registrada").alias("dsc_restricao"),
        F.col("fonte"),
        F.year(ts).alias("ano"),
        F.month(ts).alias("mes"),
        F.to_date(ts).alias("data"),
        (F.hour(ts) + F.when(e % 211 == 0, 1).otherwise(0)).alias("hora"),
        F.minute(ts).alias("minuto"),
        F.date_format(ts, "yyyy-MM").alias("ano_mes"),
        F.lit("events.parquet").alias("arquivo_origem"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType) for f in MAIN_SCHEMA])


def observations(ev: DataFrame) -> DataFrame:
    """The eleven business columns every descriptive and forecasting operator starts from."""
    return main_table(ev).select(*RAW_COLUMNS)


def republished(main: DataFrame) -> DataFrame:
    """A later publication of the same rows: some missing, some revised, blanks for no label."""
    ts = F.col("din_instante")
    kept = main.where(~((F.minute(ts) == 30) & (F.hour(ts) % 6 == 0)))
    return (
        kept.withColumn(
            "val_geracao",
            F.when(F.hour(ts) % 7 == 0, F.col("val_geracao") + 1.0).otherwise(
                F.col("val_geracao")
            ),
        )
        .withColumn("cod_razaorestricao", F.coalesce("cod_razaorestricao", F.lit("")))
        .withColumn(
            "cod_origemrestricao",
            F.when(F.hour(ts) == 5, "SIS").otherwise(
                F.coalesce("cod_origemrestricao", F.lit(" "))
            ),
        )
    )


def official_table(main: DataFrame) -> DataFrame:
    """Republished rows with the published shortfall, which is off by 0.5 MW at 11 h."""
    limited = F.col("val_geracaolimitada").isNotNull()
    gap = F.greatest(F.col("val_geracaoreferencia") - F.col("val_geracao"), F.lit(0.0))
    noise = F.when(F.hour("din_instante") == 11, 0.5).otherwise(0.0)
    published = F.when(limited & (F.hour("din_instante") != 13), gap + noise)
    return republished(main).withColumn("val_geracaonaorealizadaapurada", published)


def detail_table(ev: DataFrame) -> DataFrame:
    """Per-plant readings: up to two physical plants report under the same entity and half hour."""
    plant = F.floor(F.col("user_id") / 2) % 2
    grouped = ev.groupBy(
        _source().alias("fonte"),
        _block().alias("k"),
        plant.alias("p"),
        _half_hour("ts").alias("din_instante"),
    ).agg(
        F.sum(F.when(~_stopped(), F.col("value").cast(MONEY))).cast("double").alias("gen"),
        F.min("event_id").alias("e"),
    )
    group_name = F.concat(F.lit("Conjunto "), (F.col("k") % 5).cast("string"))
    return grouped.select(
        "fonte",
        F.concat(F.lit("U"), F.col("k").cast("string")).alias("id_ons"),
        F.when(F.col("e") % 13 != 0, group_name).alias("nom_conjuntousina"),
        "din_instante",
        F.col("gen").alias("val_geracaoverificada"),
    )
