"""Quality by compression: how much better a text compresses with a dictionary of good text than of bad."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcut.llm import logistic
from gridcut.llm.common import append_columns, stored, texts_of
from gridcut.llm.labelled import labelled_sample

#: A text is compressed in blocks of so many bytes, so that the dictionaries matter all through it.
BLOCK = 4096
#: Bytes of a dictionary, the level it is used at, and the blocks of each class it is built from.
DICT_BYTES, LEVEL, DICT_BLOCKS = 16_384, 3, 4_000


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...] | None = None

    def measure(self, texts: Iterable[str | None], count: int) -> np.ndarray:
        """For each text: normalised size difference, its part that length backs, ratio, log length."""
        tools = [self._tool(self.good), self._tool(self.bad)]
        out = np.zeros((count, 4))
        for row, text in zip(out, texts, strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            sizes = [0, 0]
            for at in range(0, len(data), BLOCK):
                block = data[at : at + BLOCK]
                for k in (0, 1):
                    sizes[k] += len(tools[k].compress(block))
            both, n = sum(sizes), len(data)
            if n:
                gain = 10 * (sizes[1] - sizes[0]) / both
                row[:] = gain, gain * np.log1p(n) / 8, both / (2 * n), np.log1p(n) / 8
        return out

    @staticmethod
    def _tool(trained: bytes) -> zstd.ZstdCompressor:
        known = zstd.ZstdCompressionDict(trained)
        return zstd.ZstdCompressor(
            level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def score(self, texts: Iterable[str | None], count: int) -> np.ndarray:
        return logistic.chance(self.measure(texts, count), np.array(self.weights))


def _dictionary(blocks: list[bytes]) -> bytes:
    """Trained by the library; from too few samples for that, the blocks themselves."""
    try:
        return zstd.train_dictionary(DICT_BYTES, blocks, level=LEVEL).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(blocks)[:DICT_BYTES] or b"text without samples"


def fit_quality(
    docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 4, held_out: int = 2
) -> CompressionModel:
    """A model from the bounded labelled sample: half of it gives the dictionaries, half the weights.

    Without usable labels every text scores the same: one half.
    """
    sample = stored(labelled_sample(docs, labels, target, folds, held_out), "quality_sample")
    build = F.pmod(F.xxhash64("_id", F.lit("dictionary")), F.lit(2)) == 0
    cut = sample.where(build).select(
        "label", "_id", F.posexplode(F.expr(f"regexp_extract_all(_text, '(?s).{{1,{BLOCK // 2}}}', 0)")).alias("at", "block")
    )
    cut = stored(cut, "quality_blocks")
    dictionaries = {}
    for label, n in {0: 0, 1: 0, **{r.label: r["count"] for r in cut.groupBy("label").count().collect()}}.items():
        share = F.pmod(F.xxhash64("_id", "at"), F.lit(1 << 30)) / float(1 << 30)
        drawn = cut.where((F.col("label") == label) & (share < DICT_BLOCKS / max(n, 1))).orderBy("_id", "at")
        dictionaries[label] = _dictionary([r.block.encode("utf-8", "surrogatepass") for r in drawn.collect()])
    bare = CompressionModel(dictionaries[1], dictionaries[0])
    got = _measured(sample.where(~build), bare).select("label", "measures").toPandas()
    features = np.array(got["measures"].tolist()).reshape(len(got), 4)
    weights = logistic.fit(features, got["label"].to_numpy(float))
    return CompressionModel(bare.good, bare.bad, tuple(weights.tolist()))


def _measured(sample: DataFrame, model: CompressionModel) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            values = model.measure(texts_of(batch, "_text"), batch.num_rows)
            yield batch, [pa.array(values.tolist(), pa.list_(pa.float64()))]

    return append_columns(sample, T.StructType([T.StructField("measures", T.ArrayType(T.DoubleType()))]), compute)


def score_quality(docs: DataFrame, model: CompressionModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of `docs`, and `score` (chance of label 1) and `predicted` (1 from `threshold` on).

    Whole texts are compressed, block after block. Null and empty texts have no size difference and
    get the chance that the weights give to nothing. Repeated rows score alike; no rows give no rows.
    Input columns named `score` or `predicted` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = T.StructType([T.StructField("score", T.DoubleType())])

    def compute(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            scores = shared.value.score(texts_of(batch, text), batch.num_rows)
            yield batch, [pa.array(scores, pa.float64())]

    scored = append_columns(docs.drop("predicted"), added, compute)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
