"""Sinks: sorted Parquet, CSV metric tables, JSON reports, and the notice archive upsert."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcut.sources import commits

NOTICE_PARTITION = "t0_chave"


def write_sorted(df: DataFrame, path: str, *order: str, partition_by: tuple[str, ...] = ()) -> None:
    """Range-partitioned and sorted files: ordered as a whole, no single writer task.

    Ranges run over partition columns and order together, so one large source is written by many
    tasks and each folder still gets few files.
    """
    keys = (*partition_by, *order)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = placed.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert_notices(notices: DataFrame, path: str) -> None:
    """Replace the notices of the same `t0` and keep all others; repeating it changes nothing.

    One partition per `t0`: only those of the new notices are written, and they appear together
    (`commits`), so an emission that stops half way leaves the archive as it was.
    """
    if notices.isEmpty():
        raise ValueError("empty notice: nothing to write")
    keyed = notices.withColumn(NOTICE_PARTITION, F.date_format("t0", "yyyyMMddHHmm"))
    commits.upsert(keyed, path, NOTICE_PARTITION, ["fonte", "id_ons"])


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """The whole archive; columns that older notices lack are NULL."""
    return commits.read(spark, path).drop(NOTICE_PARTITION)


def has_notices(spark: SparkSession, path: str) -> bool:
    return commits.version(spark, path) > 0


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
