"""Frequent lines: lines found in many documents are dropped from all of them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcut.llm.common import LOWER, UPPER, WHITE, fresh_name, stored

#: Up to so many frequent keys (32 bytes each) are broadcast; beyond it the same join shuffles.
BROADCAST_KEYS = 500_000


def line_key(line: Column) -> Column:
    """The line stripped of white space at both ends, A-Z lowered and no other letter."""
    bare = F.trim(line, F.lit(WHITE))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashed(line: Column, min_chars: int) -> Column:
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.md5(key))


def frequent_keys(docs: DataFrame, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """md5 of each key that `min_docs` rows or more hold; a row counts once for each key."""
    keys = F.array_distinct(F.transform(_lines(text), lambda x: _hashed(x, min_chars)))
    return (
        docs.select(F.explode(keys).alias("_key"))
        .where(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(F.count("*").alias("_docs"))
        .where(F.col("_docs") >= min_docs)
        .select("_key")
    )


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)


def drop_frequent_lines(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """All columns of `docs` with the text rewritten, and `n_lines`, `n_dropped`.

    Keys are counted over all rows, one count for a row however often it repeats the line. Positions
    of lines with a frequent key go back to their document in one narrow shuffle; the document keeps
    the other positions in order, so the work is linear in its lines.

    Null or empty text is one empty line and becomes empty text. A line of fewer than `min_chars`
    code points is never dropped; a document of which all lines go has empty text. Repeated rows are
    documents of their own and come out alike. Null ids are allowed. No rows give no rows. Columns
    named `n_lines` or `n_dropped` are replaced, others kept whatever their names.
    """
    frequent = stored(frequent_keys(docs, text, min_docs, min_chars), "frequent_lines")
    if frequent.count() <= BROADCAST_KEYS:
        frequent = F.broadcast(frequent)
    idc, body = F.col(f"`{id_col}`"), F.col(f"`{text}`")
    mark1, mark2, lines, gone = (fresh_name(docs, n) for n in ("_mark1", "_mark2", "_lines", "_gone"))
    marks = [F.xxhash64(idc, body).alias(mark1), F.xxhash64(body, idc, F.lit(1)).alias(mark2)]
    hits = (
        docs.select(*marks, F.posexplode(_lines(text)).alias("_at", "_line"))
        .select(mark1, mark2, "_at", _hashed(F.col("_line"), min_chars).alias("_key"))
        .join(frequent, "_key", "left_semi")
        .groupBy(mark1, mark2)
        .agg(F.collect_set("_at").alias(gone))
    )
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    split = docs.select(*[f"`{c}`" for c in others], *marks, _lines(text).alias(lines))
    split = split.drop(text) if text in others else split
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    dropped = F.coalesce(F.col(gone), F.array().cast("array<int>"))
    kept = F.transform(F.array_except(every, dropped), lambda i: F.get(F.col(lines), i))
    joined = split.join(hits, [mark1, mark2], "left").withColumn(text, F.array_join(kept, "\n"))
    return joined.select(
        *[f"`{c}`" for c in others],
        F.size(lines).cast("long").alias("n_lines"),
        F.size(dropped).cast("long").alias("n_dropped"),
    )
