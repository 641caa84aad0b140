"""The corpus pipeline: documents pass the stages in turn, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcut.llm.common import arrow_rows, stored
from gridcut.llm.decontaminate import match_items, remove_spans, with_verdict
from gridcut.llm.line_dedup import drop_frequent_lines
from gridcut.llm.packing import pack
from gridcut.llm.quality import fit_quality, score_quality
from gridcut.llm.queries import table, word_tokenizer
from gridcut.llm.simhash import keep_one

#: SQL can't express the stages: the first is a learned classifier. Tests compare with plain Python.
ORACLE_SQL = None

#: Pre-tokens and chunks that a worker of the packing stage remembers: earlier stages' workers live on
#: beside it, so it has less memory than packing alone.
KEPT = (40_000, 60_000)
#: Whole documents that travel between Spark and a worker at once.
BATCH_ROWS = 500


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, unchanged. It learns from this stage's own documents."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their frequent lines; n_chars follows the text."""
    kept = drop_frequent_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without the long hit spans that they hold nevertheless;
    where a span goes n_chars follows the text. All other documents stay unchanged."""
    found = with_verdict(match_items(docs, table(spark, sf_dir, "benchmark")))
    clean = remove_spans(found.where("not contaminated"))
    same = F.col("clean_text").eqNullSafe(F.col("text"))
    n_chars = F.when(same, F.col("n_chars")).otherwise(F.length("clean_text").cast("long"))
    return clean.withColumns({"n_chars": n_chars, "text": F.col("clean_text")}).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs, word_tokenizer(), kept=KEPT).drop("uid")


STAGES = [
    ("quality", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with arrow_rows(spark, BATCH_ROWS):
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
