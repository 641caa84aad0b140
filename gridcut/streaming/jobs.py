"""Incremental forms of the batch operators: republished files, cut episodes, notice upserts."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gridcut.operators.descriptive import episodes
from gridcut.schemas import ENTITY, OBS_KEY
from gridcut.sources import commits
from gridcut.sources.sinks import upsert_notices

MONTH_PARTITION = "ano_mes_chave"


def file_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 200
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def ingest_republished(
    stream: DataFrame, table: str, checkpoint: str, order: str = "publicado_em"
) -> StreamingQuery:
    """Merge newly published rows into a table partitioned by month; the latest `order` wins.

    Only the months present in a micro-batch are read back and rewritten; rows without an instant
    have a month of their own. Rows of equal `order` are told apart by the hash of their values.
    Merging a batch twice gives the same table, so a retried batch is harmless.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in OBS_KEY]

        def latest(rows: DataFrame) -> DataFrame:
            own = [c for c in rows.columns if c not in {*OBS_KEY, MONTH_PARTITION}]
            newest = F.max_by(F.struct(*own), F.struct(order, F.xxhash64(*rest)))
            return rows.groupBy(*OBS_KEY, MONTH_PARTITION).agg(newest.alias("__row")).select(
                *OBS_KEY, "__row.*", MONTH_PARTITION
            )

        _rewrite_months(batch.withColumn(MONTH_PARTITION, _month("din_instante")), table, latest)

    return _each_batch(stream, merge, checkpoint)


def maintain_cuts(targets: DataFrame, table: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Keep the half hours of each entity and day, whatever order files come in.

    A row of the table is an entity's day with the state of its half hours (at most 48 on the grid).
    A micro-batch unites its rows with those of the months it touches; nothing is ever late, and a
    batch that comes again changes nothing. `stored_episodes` reads the episodes, also those still
    open at the end.

    `order` names a column that grows with each publication: of several states of a half hour the one
    with the largest order counts (of equal ones the positive one), so a correction takes a cut back,
    also if it arrives before what it corrects. Without it only positive half hours are kept, and a
    half hour that was positive once stays so.
    """
    positive = F.coalesce("corte_positivo", F.lit(False))
    place = F.coalesce(F.col(order).cast("long"), F.lit(-1).cast("long")) if order else F.lit(0).cast("long")
    keys = [*ENTITY, "dia", MONTH_PARTITION]

    def listed(rows: DataFrame) -> DataFrame:
        """Rows of single half hours as one row a day; of each half hour the latest state. One shuffle."""
        dealt = rows.repartition(*keys)
        latest = dealt.groupBy(*keys, "instante").agg(F.max(F.struct("ordem", "positivo")).alias("s"))
        state = F.struct("instante", "s.ordem", "s.positivo")
        return latest.groupBy(*keys).agg(F.array_sort(F.collect_list(state)).alias("instantes"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.where("din_instante is not null").select(
            *ENTITY,
            F.to_date("din_instante").alias("dia"),
            F.col("din_instante").alias("instante"),
            place.alias("ordem"),
            positive.alias("positivo"),
        )
        fresh = (fresh if order else fresh.where("positivo")).withColumn(MONTH_PARTITION, _month("dia"))

        def unite(rows: DataFrame) -> DataFrame:
            """Lists of the same day, the stored one and the new one, as one: states of a half hour lie
            side by side in the sorted list, the latest of them last."""
            states = rows.groupBy(*keys).agg(
                F.array_sort(F.flatten(F.collect_list("instantes"))).alias("instantes")
            )
            following = lambda i: F.get("instantes", i + 1)["instante"]
            latest = F.filter("instantes", lambda s, i: ~s["instante"].eqNullSafe(following(i)))
            return states.withColumn("instantes", latest)

        _rewrite_months(listed(fresh), table, unite)

    return _each_batch(targets, merge, checkpoint)


def stored_episodes(spark: SparkSession, table: str) -> DataFrame:
    """Cut episodes of all half hours that `maintain_cuts` has stored: the batch operator on them."""
    slots = commits.read(spark, table).select(*ENTITY, F.inline("instantes")).where("positivo")
    return episodes(
        slots.select(*ENTITY, F.col("instante").alias("din_instante"), F.lit(True).alias("corte_positivo"))
    )


def _month(instant: str) -> Column:
    return F.coalesce(F.date_format(instant, "yyyyMM"), F.lit("sem_data"))


def _rewrite_months(
    fresh: DataFrame, table: str, combine: Callable[[DataFrame], DataFrame]
) -> None:
    """Combine new rows with the stored rows of their months; the months then appear together.

    Only those months are opened, and they are written once, to a folder of their own (`commits`): a
    batch that stops half way leaves the table as it was. The version before stays for its readers.
    """
    spark = fresh.sparkSession
    fresh = fresh.persist()
    at = commits.version(spark, table)
    rows = fresh
    if at:
        months = [r[0] for r in fresh.select(MONTH_PARTITION).distinct().collect()]  # calendar-sized
        rows = commits.read(spark, table, months, at).unionByName(fresh, allowMissingColumns=True)
    commits.replace(combine(rows), table, MONTH_PARTITION, ENTITY, at)
    commits.clean(spark, table)
    fresh.unpersist()


def _each_batch(stream: DataFrame, work: Callable, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_stream(notices: DataFrame, archive: str, checkpoint: str) -> StreamingQuery:
    """Idempotent notice archive per micro-batch: a `t0` that comes again replaces itself."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert_notices(batch, archive)

    return _each_batch(notices, write, checkpoint)

