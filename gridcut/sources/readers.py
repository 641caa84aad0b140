"""Scans: declared schemas, only the needed columns, filters the Parquet reader can use."""

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcut.operators.features import base_table
from gridcut.operators.targets import derive_targets
from gridcut.schemas import (
    ATTRIBUTES,
    DATASETS,
    FIRST_HISTORY_DAY,
    LABELS,
    MEASURES,
    OBS_KEY,
    RAW_COLUMNS,
    RESERVED_FROM,
    SOURCES,
)

EPOCH = datetime(1970, 1, 1)


def read_parquet(spark: SparkSession, *paths: str, merge: bool = False) -> DataFrame:
    """Parquet scan that also accepts nanosecond timestamps (they arrive as long integers)."""
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    return spark.read.option("mergeSchema", merge).parquet(*paths)


def nanos_to_ntz(c: str) -> Column:
    seconds = F.expr(f"cast(`{c}` div 1000 as decimal(20,0))") / F.lit(1_000_000).cast("decimal(7,0)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def naive_time(df: DataFrame, c: str = "din_instante") -> DataFrame:
    """Timestamps as naive microseconds, whatever the file stored."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.LongType):
        return df.withColumn(c, nanos_to_ntz(c))
    if isinstance(kind, T.TimestampNTZType):
        return df
    return df.withColumn(c, F.col(c).cast("timestamp_ntz"))


def between(df: DataFrame, start: datetime, end: datetime, c: str = "din_instante") -> DataFrame:
    """`[start, end)` compared in the stored type, so that row groups can be skipped."""
    if isinstance(df.schema[c].dataType, T.LongType):

        def nanos(t: datetime) -> int:
            gap = t - EPOCH
            return (gap.days * 86_400 + gap.seconds) * 1_000_000_000 + gap.microseconds * 1000

        return df.where((F.col(c) >= nanos(start)) & (F.col(c) < nanos(end)))
    lo, hi = (F.lit(str(t)).cast(df.schema[c].dataType) for t in (start, end))
    return df.where((F.col(c) >= lo) & (F.col(c) < hi))


def check_reserved(end: datetime, allow_reserved: bool) -> None:
    if end > datetime.fromisoformat(RESERVED_FROM) and not allow_reserved:
        raise ValueError(f"data from {RESERVED_FROM} on is reserved for the final validation")


def load_history(
    spark: SparkSession,
    data_dir: str,
    start: datetime,
    end: datetime,
    *,
    sources: Sequence[str] = SOURCES,
    allow_reserved: bool = False,
) -> DataFrame:
    """Main files of the sources for `[start, end)`, business columns only, with targets."""
    check_reserved(end, allow_reserved)
    parts = []
    for source in sources:
        raw = read_parquet(spark, f"{data_dir}/raw/{DATASETS[source][0]}").select(*RAW_COLUMNS)
        parts.append(naive_time(between(raw, start, end)))
    return derive_targets(stack(parts))


def load_base(spark: SparkSession, data_dir: str, end: datetime, **options) -> DataFrame:
    start = datetime.fromisoformat(FIRST_HISTORY_DAY)
    return base_table(load_history(spark, data_dir, start, end, **options))


def stack(parts: Iterable[DataFrame]) -> DataFrame:
    """UNION ALL by name; a column absent from one part is NULL there."""
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to stack")
    return out


def read_publication(spark: SparkSession, source: str, paths: Sequence[str]) -> DataFrame:
    """Several published files whose columns differ, tagged with their source."""
    return naive_time(read_parquet(spark, *paths, merge=True)).withColumn("fonte", F.lit(source))


def normalise_publication(df: DataFrame, source: str) -> DataFrame:
    """Published columns in the types of the snapshot; text that is no number becomes NULL."""
    timed = naive_time(df.withColumn("fonte", F.lit(source)))
    return timed.select(
        *[
            F.col(c).try_cast("double").alias(c)
            if c in MEASURES
            else (F.col(c).cast("string").alias(c) if c in LABELS else F.col(c))
            for c in RAW_COLUMNS
        ]
    )


def keep_last(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key: the one with the largest `order` (publication sequence).

    An aggregate rather than a row_number window: it keeps one candidate per key on the map side,
    so a key published many times is not gathered into one task.
    """
    rest = [c for c in df.columns if c not in {*key, order}]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
    return picked.select(*key, *[F.col("__row").getField(c).alias(c) for c in rest]).select(
        *[c for c in df.columns if c != order]
    )


def read_republished(spark: SparkSession, files: Sequence[tuple[str, str]]) -> DataFrame:
    """Monthly files in publication order as (source, path); a later file wins per key."""
    parts = [
        normalise_publication(read_parquet(spark, path), source).withColumn("__seq", F.lit(i))
        for i, (source, path) in enumerate(files)
    ]
    return derive_targets(keep_last(stack(parts), OBS_KEY, "__seq"))


def snapshot_columns(spark: SparkSession, data_dir: str) -> DataFrame:
    """Key and attribute columns of the full main files, nothing else is read."""
    parts = []
    for source in SOURCES:
        raw = read_parquet(spark, f"{data_dir}/raw/{DATASETS[source][0]}")
        parts.append(
            naive_time(raw.select("id_ons", "din_instante", *ATTRIBUTES)).withColumn(
                "fonte", F.lit(source)
            )
        )
    return stack(parts)


def file_manifest(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Bytes and SHA-256 of every file under a folder, hashed where the file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("arquivo"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Calendar entries (date, kind) of a calendar JSON document."""
    doc = spark.read.schema(
        "entries array<struct<date:date, reason:string, kind:string>>"
    ).json(path, multiLine=True)
    return doc.select(F.explode("entries").alias("e")).select(
        F.col("e.date").alias("dia"), F.col("e.kind").alias("tipo")
    )

