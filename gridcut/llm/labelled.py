"""The bounded sample of labelled documents that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcut.llm.common import fold_of

#: Labelled documents of each class that a model is fitted on, at most about. The documented bound.
SAMPLE_DOCS = 8_000


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    target: str,
    folds: int,
    held_out: int,
    per_class: int = SAMPLE_DOCS,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(id, text, label) of labelled documents outside the held-out fold.

    Each class gives the documents whose hashed id falls below the share that leaves about
    `per_class` of them, so the same documents are drawn wherever they lie. Ids labelled both ways,
    null labels and null ids are left out; repeated label rows count once. Only the drawn ids are
    broadcast (their number is bounded by `per_class`); texts are never shuffled.
    """
    drawn = F.col(f"`{id_col}`")
    fit = (
        labels.select(drawn.alias("_id"), F.col(f"`{target}`").cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("_id").isNotNull())
        .where(fold_of(F.col("_id"), folds) != held_out)
        .groupBy("_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_most"))
        .where(F.col("label") == F.col("_most"))
        .drop("_most")
    )
    sizes = {r.label: r["count"] for r in fit.groupBy("label").count().collect()}
    share = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for label, n in sizes.items():
        keep = keep | ((F.col("label") == label) & (share < min(1.0, per_class / n)))
    return docs.select(drawn.alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")).join(
        F.broadcast(fit.where(keep)), "_id"
    )
