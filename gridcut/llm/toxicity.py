"""Toxic passages: maximum-scoring segments of token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcut.llm import logistic
from gridcut.llm.common import append_columns, stored, texts_of, word_bytes
from gridcut.llm.labelled import labelled_sample

#: Weight of the Dirichlet prior (in documents), its least part for a word, z-score from which a word
#: counts, score of the rest.
PRIOR, LEAST, LEAST_Z, NEUTRAL = 20.0, 0.5, 2.9, -0.25
#: A model has at most so many words, the most significant ones. The documented bound.
MODEL_WORDS = 200_000


@dataclass(frozen=True)
class ToxicModel:
    """Scores of telling words; decay and scale of segment scores in clean text; calibration."""

    scores: dict[bytes, float]
    decay: float = 1.0
    scale: float = 1.0
    weights: tuple[float, ...] | None = field(default=None)

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """All maximal-scoring segments (from, to, score), by Ruzzo and Tompa's scan.

        Between telling words the sum falls evenly, so only telling words are visited. Each candidate
        on the stack keeps the place of the nearest one below it whose left sum is smaller, so none
        is walked twice and the scan is linear.
        """
        value = np.fromiter(map(self.scores.get, words, repeat(NEUTRAL)), np.float64, len(words))
        at = np.flatnonzero(value > 0)
        if not len(at):
            return []
        total = np.cumsum(value)
        stack: list[tuple[int, int, float, float, int]] = []
        for i, high, own in zip(at.tolist(), total[at].tolist(), value[at].tolist(), strict=True):
            start, low = i, high - own
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:
                k = stack[k][4]
            while k >= 0 and stack[k][3] < high:
                start, low, below = stack[k][0], stack[k][2], stack[k][4]
                del stack[k:]
                k = below
            stack.append((start, i + 1, low, high, k))
        return [(a, b, high - low) for a, b, low, high, _ in stack]

    def measure(
        self, texts: Iterable[str | None], count: int
    ) -> tuple[np.ndarray, list[list[tuple[int, int, float]]], list[int]]:
        """For each text: -log of the chance of its best segment and of all of them in clean text of
        that length, share of words in segments; the segments; and the number of words."""
        out, passages, lengths = np.zeros((count, 3)), [], []
        for row, text in zip(out, texts, strict=True):
            words = word_bytes(text)
            found = self.segments(words)
            passages.append(found)
            lengths.append(len(words))
            if found:
                surplus = self.decay * np.array([s for _, _, s in found]) - np.log(self.scale * len(words))
                rare = np.where(surplus > 0, surplus, 0.0)
                held = sum(b - a for a, b, _ in found) / len(words)
                row[:] = np.log1p(max(surplus.max(), 0.0)), np.log1p(rare.sum()), held
        return out, passages, lengths

    def score(self, texts: Iterable[str | None], count: int) -> tuple[np.ndarray, list]:
        measures, passages, _ = self.measure(texts, count)
        return logistic.chance(measures, np.array(self.weights)), passages


def word_counts(sample: DataFrame) -> DataFrame:
    """(word, clean, toxic): documents of each class that hold the word. Counted before the shuffle."""
    schema = "word binary, clean long, toxic long"

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            counts: dict[bytes, list[int]] = {}
            for text, label in zip(texts_of(batch, "_text"), texts_of(batch, "label"), strict=True):
                for w in set(word_bytes(text)):
                    counts.setdefault(w, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.binary()),
                    pa.array([c[0] for c in counts.values()], pa.int64()),
                    pa.array([c[1] for c in counts.values()], pa.int64()),
                ],
                names=["word", "clean", "toxic"],
            )

    dealt = sample.select("_text", "label").mapInArrow(run, schema)
    return dealt.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, target: str = "toxic", folds: int = 5, held_out: int = 0
) -> ToxicModel:
    """A model from the bounded labelled sample.

    A word's score is the log-odds of finding it in a toxic rather than a clean document, each
    smoothed with a Dirichlet prior in proportion to the word's documents in the sample; words below
    LEAST_Z standard errors stay neutral. Decay and scale come from the best segments of the clean
    documents: their mean excess, and how many there are in so many words. The weights come from all
    of the sample. Without usable labels every text scores one half.
    """
    sample = stored(labelled_sample(docs, labels, target, folds, held_out), "toxic_sample")
    sizes = {0: 0, 1: 0, **{r.label: r["count"] for r in sample.groupBy("label").count().collect()}}
    prior = LEAST + PRIOR * (F.col("clean") + F.col("toxic")) / (sizes[0] + sizes[1] or 1)
    hit = [F.col("clean") + prior, F.col("toxic") + prior]
    miss = [F.lit(float(sizes[k])) + PRIOR + LEAST - hit[k] for k in (0, 1)]
    odds = F.log(hit[1] / miss[1]) - F.log(hit[0] / miss[0])
    told = (
        word_counts(sample)
        .where(F.col("clean") + F.col("toxic") >= 3)
        .select("word", odds.alias("odds"), (odds / F.sqrt(1 / hit[0] + 1 / hit[1])).alias("z"))
        .where(F.abs("z") >= LEAST_Z)
        .orderBy(F.desc(F.abs("z")), "word")
        .limit(MODEL_WORDS)
    )
    bare = ToxicModel({bytes(r.word): float(r.odds) for r in told.collect()})
    clean = _measured(sample.where("label = 0"), bare).agg(
        F.sum(F.coalesce(F.array_max(F.transform("passages", lambda p: p["score"])), F.lit(0.0))).alias("best"),
        F.count_if(F.size("passages") > 0).alias("held"),
        F.sum("n_words").alias("words"),
    )
    c = clean.first()
    decay = ((c.held or 0) + 1) / ((c.best or 0.0) + 1)
    scale = ((c.held or 0) + 1) / ((c.words or 0) + 1)
    model = ToxicModel(bare.scores, decay, scale)
    got = _measured(sample, model).select("label", "measures").toPandas()
    weights = logistic.fit(np.array(got["measures"].tolist()).reshape(len(got), 3), got["label"].to_numpy(float))
    return ToxicModel(bare.scores, decay, scale, tuple(weights.tolist()))


_PASSAGES = T.ArrayType(
    T.StructType(
        [
            T.StructField("from_word", T.LongType()),
            T.StructField("to_word", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)


def _measured(sample: DataFrame, model: ToxicModel) -> DataFrame:
    added = T.StructType(
        [
            T.StructField("measures", T.ArrayType(T.DoubleType())),
            T.StructField("passages", _PASSAGES),
            T.StructField("n_words", T.LongType()),
        ]
    )

    def compute(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            values, passages, lengths = model.measure(texts_of(batch, "_text"), batch.num_rows)
            yield batch, [
                pa.array(values.tolist(), pa.list_(pa.float64())),
                _arrow(passages),
                pa.array(lengths, pa.int64()),
            ]

    return append_columns(sample, added, compute)


def _arrow(passages: list[list[tuple[int, int, float]]]) -> pa.Array:
    kind = pa.struct([("from_word", pa.int64()), ("to_word", pa.int64()), ("score", pa.float64())])
    named = [[{"from_word": a, "to_word": b, "score": s} for a, b, s in found] for found in passages]
    return pa.array(named, pa.list_(kind))


def score_toxicity(
    docs: DataFrame, model: ToxicModel, text: str = "text", threshold: float = 0.5, passages: bool = True
) -> DataFrame:
    """All columns of `docs`, and `passages` (word ranges with scores, if asked for), `score` and `predicted`.

    A text's score is the calibrated chance of label 1, from how unlikely its best segment and all
    its segments are in clean text of its length. Null and empty texts have no segments and get the
    chance of a text without any. Repeated rows score alike; no rows give no rows. Input columns
    named as the three added ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = T.StructType([T.StructField("passages", _PASSAGES)] * passages + [T.StructField("score", T.DoubleType())])

    def compute(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            values, found = shared.value.score(texts_of(batch, text), batch.num_rows)
            yield batch, [_arrow(found)] * passages + [pa.array(values, pa.float64())]

    scored = append_columns(docs.drop("predicted"), added, compute)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
