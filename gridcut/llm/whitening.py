"""Whitening vectors: leading components by spectrum slicing of the covariance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcut.llm.common import stored

#: Entries become whole numbers floor(SCALE * c) + SHIFT; beyond LARGEST in size an entry counts as not finite.
SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 29)
#: Longest vectors that are whitened: the covariance (the square of it) goes through the driver.
MOST_DIMENSIONS = 4096
#: Partial sums of tasks are added in so many groups for each row of the covariance, then these.
GROUPS = 32


# --- spectrum slicing -------------------------------------------------------------------------


def above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above `shift`: positive pivots of the LDL^T factors of matrix - shift.

    Pivots are single diagonal entries or blocks of two rows, chosen as Bunch and Kaufman do, so no
    step divides by something small; a block of two has one positive and one negative eigenvalue. A
    pivot that is exactly zero counts as not above.
    """
    a = matrix - shift * np.eye(len(matrix))
    ratio, count, k, n = (1 + 17**0.5) / 8, 0, 0, len(a)
    while k < n:
        column = np.abs(a[k + 1 :, k])
        far = int(np.argmax(column)) + k + 1 if len(column) else k
        largest = column[far - k - 1] if len(column) else 0.0
        own, pair = abs(a[k, k]), False
        if max(own, largest) == 0:
            k += 1
            continue
        if own < ratio * largest:
            across = np.abs(a[far, k:])
            across[far - k] = 0
            beside = across.max()
            if own * beside < ratio * largest**2:
                if abs(a[far, far]) >= ratio * beside:
                    _swap(a, k, far)
                else:
                    _swap(a, k + 1, far)
                    pair = True
        if pair:
            block, rest = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(block, rest.T)
            count, k = count + 1, k + 2
        else:
            rest = a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(rest, rest / a[k, k])
            count, k = count + int(a[k, k] > 0), k + 1
    return count


def _swap(a: np.ndarray, i: int, j: int) -> None:
    a[[i, j]] = a[[j, i]]
    a[:, [i, j]] = a[:, [j, i]]


@dataclass(frozen=True)
class Slice:
    """An interval (low, high] with the eigenvalues of the given numbers: more than `high` counts `first`."""

    low: float
    high: float
    first: int
    last: int


def slices(matrix: np.ndarray, wanted: int, least: float) -> list[Slice]:
    """Intervals, highest first, that hold the leading `wanted` eigenvalues: one each, or several that
    lie within `least` of each other. Inertia counts at the middle halve an interval."""
    bound = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-12) + least
    open_, done = [Slice(-bound, bound, 0, len(matrix))], []
    while open_:
        s = open_.pop()
        if s.first >= min(wanted, len(matrix)) or s.first == s.last:
            continue
        if s.high - s.low <= least or (s.last - s.first == 1 and s.high - s.low <= 0.01 * max(abs(s.low), least)):
            done.append(s)
            continue
        middle = (s.low + s.high) / 2
        count = min(max(above(matrix, middle), s.first), s.last)
        open_.append(Slice(s.low, middle, count, s.last))
        open_.append(Slice(middle, s.high, s.first, count))
    return done


def leading_pairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    Each is isolated by inertia counts. Two steps of inverse iteration at the interval's middle start
    Rayleigh quotient iteration, which converges cubically; a quotient that leaves its interval
    halves it by a count and starts anew. Counts just below and above the value found certify its
    number. Eigenvalues that no count separates get an orthonormal basis of their common space.
    """
    matrix = (matrix + matrix.T) / 2
    n = len(matrix)
    wanted = min(wanted, n)
    size = float(np.abs(matrix).sum(axis=1).max()) if n else 0.0
    if not size:
        return np.zeros(wanted), np.eye(n)[:, :wanted]
    least = 64 * n * np.finfo(float).eps * size
    drawn = np.random.default_rng(11)
    values: list[float] = []
    vectors = np.zeros((n, 0))
    for s in slices(matrix, wanted, least):
        if s.last - s.first > 1:
            basis = drawn.standard_normal((n, s.last - s.first))
            for _ in range(4):
                basis = np.linalg.qr(_solve(matrix, (s.low + s.high) / 2 + least, basis))[0]
                basis = np.linalg.qr(basis - vectors @ (vectors.T @ basis))[0]
            found = np.einsum("ij,ij->j", basis, matrix @ basis)
            order = np.argsort(-found)
            values += found[order].tolist()
            vectors = np.column_stack([vectors, basis[:, order]])
            continue
        value, vector = _one(matrix, s, least, drawn.standard_normal(n))
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    order = np.argsort(-np.array(values), kind="stable")[:wanted]
    return np.array(values)[order], vectors[:, order]


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    shifted = matrix - shift * np.eye(len(matrix))
    try:
        return np.linalg.solve(shifted, right)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue: beside it
        step = np.finfo(float).eps * np.abs(matrix).sum(axis=1).max()
        return np.linalg.solve(shifted + step * np.eye(len(matrix)), right)


def _one(matrix: np.ndarray, s: Slice, least: float, start: np.ndarray) -> tuple[float, np.ndarray]:
    low, high = s.low, s.high
    while True:
        vector, middle = start / np.linalg.norm(start), (low + high) / 2
        for _ in range(2):
            vector = _solve(matrix, middle, vector)
            vector /= np.linalg.norm(vector)
        value, before = float(vector @ matrix @ vector), np.inf
        for _ in range(12):
            wrong = float(np.linalg.norm(matrix @ vector - value * vector))
            if wrong >= before / 2 and wrong <= least:
                break
            before = wrong
            vector = _solve(matrix, value, vector)
            vector /= np.linalg.norm(vector)
            value = float(vector @ matrix @ vector)
        inside = low - least <= value <= high + least
        if inside and above(matrix, value - least) > s.first and above(matrix, value + least) <= s.first:
            return value, vector
        if high - low <= least:
            return value, vector
        if above(matrix, middle) > s.first:
            low = middle
        else:
            high = middle


# --- tables -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """n, sums of the whole-number vectors, eigenvalues and unit eigenvectors (columns), trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in doubles: the whole part of the mean is taken off exactly first."""
        whole, rest = np.array([s // self.n for s in self.sums]), np.array([s % self.n for s in self.sums])
        return (x - whole) - rest / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of (n*x - S)^2 for each row, exact."""
        whole, rest = np.array([s // self.n for s in self.sums]), np.array([s % self.n for s in self.sums])
        apart = x - whole
        most = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if most * most * max(x.shape[1], 1) < 1 << 63:
            return ((self.n * apart - rest) ** 2).sum(axis=1).tolist()
        apart, rest = apart.astype(object), rest.astype(object)
        return [int(v) for v in ((self.n * apart - rest) ** 2).sum(axis=1)]


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return F.coalesce(fine & (F.size(v) > 0), F.lit(False))


def _numbers(column: pa.ListArray) -> np.ndarray:
    """A column of usable vectors of one length as rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.floor(flat * SCALE).astype(np.int64) + SHIFT


def _sums(rows: DataFrame) -> DataFrame:
    """(at, s): sums of the whole-number vectors by dimension, added up in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                total = _numbers(batch.column(0)).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "s"])

    partial = rows.select("v").mapInArrow(run, "at long, s long")
    return partial.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def _added(parts: DataFrame) -> DataFrame:
    """Arrays of equal length added up by `row`, in two steps so that no group holds all tasks' arrays."""

    def total(keys: tuple, table: pa.Table) -> pa.Table:
        stack = table.column("part").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        made = [pa.array([k.as_py()], pa.int64()) for k in keys] + [pa.array([stack.sum(axis=0).tolist()], pa.list_(pa.float64()))]
        return pa.Table.from_arrays(made, names=[*names, "part"])

    for names in (["row", "pile"], ["row"]):
        shape = ", ".join(f"{k} long" for k in names) + ", part array<double>"
        parts = parts.groupBy(*names).applyInArrow(total, shape)
    return parts


def _products(rows: DataFrame, width: int, centre) -> np.ndarray:
    """Sums over all rows of the products of entries, after `centre` made a batch rows of doubles.

    Each task adds up its own rows; tasks' sums are added by rows of the square.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        square = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                y = centre(batch.column(0))
                square += y.T @ y
        pile = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(width)),
                pa.array(np.full(width, pile, np.int64)),
                pa.ListArray.from_arrays(np.arange(0, width * width + 1, width, dtype=np.int32), pa.array(square.ravel())),
            ],
            names=["row", "pile", "part"],
        )

    parts = rows.mapInArrow(run, "row long, pile long, part array<double>")
    out = np.zeros((width, width))
    for r in _added(parts).collect():  # the square of the vectors' length, bounded by MOST_DIMENSIONS
        out[r.row] = r.part
    return (out + out.T) / 2


def _usable_rows(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where(_usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (most[0].d if most else 0))


def fit_whitening(rows: DataFrame, components: int) -> Whitening | None:
    """The model of usable rows (id, v) of one length; None without rows."""
    sums = {r["at"]: int(r["s"]) for r in _sums(rows).collect()}
    if not sums:
        return None
    width = len(sums)
    if width > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} entries")
    n = rows.count()
    bare = Whitening(n, tuple(sums[k] for k in range(width)), np.zeros(0), np.zeros((width, 0)), 0.0)
    covariance = _products(rows.select("v"), width, lambda c: bare.centred(_numbers(c))) / n
    trace = float(np.trace(covariance))
    values, found = leading_pairs(covariance, components)
    real = values > width * np.finfo(float).eps * max(trace, 0.0)
    return Whitening(n, bare.sums, values[real], found[:, real], trace)


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 8
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable vector and component.

    Vectors become whole numbers x; means and the covariance (centred before multiplying) are sums
    over all of them, added up in tasks. The driver gets the covariance alone and finds its leading
    eigenvectors by spectrum slicing (`leading_pairs`). `deviation` is a decimal(38,0), exact.
    `identity_error` is measured on the result: the whitened table is written once, and the sums of
    its products are compared with the identity.

    Dropped are null and empty vectors, vectors with a null or non-finite entry (entries of 2^29 or
    more in size count as such), and vectors of another length than the most frequent one (of two,
    the longer). Components whose eigenvalue is zero to rounding have no whitened values and no rows;
    there are fewer than `components` for short vectors too. Null ids and repeated rows have rows of
    their own. No usable vectors give no rows. Other columns are not carried.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = stored(_usable_rows(vectors, id_col, vector), "whole_vectors")
    model = fit_whitening(rows, components)
    if model is None or not len(model.values):
        empty = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, {empty}")
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _numbers(batch.column(1))
            w = m.centred(x) @ m.vectors / np.sqrt(m.values)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([str(v) for v in m.deviation(x)]),
                    pa.ListArray.from_arrays(np.arange(0, w.size + 1, k, dtype=np.int32), pa.array(w.ravel())),
                ],
                names=["id", "deviation", "w"],
            )

    made = rows.mapInArrow(run, f"id {kind}, deviation string, w array<double>")
    made = stored(made.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")), "whitened")
    square = _products(made.select("w"), k, lambda c: c.flatten().to_numpy().reshape(len(c), -1)) / model.n
    error = float(np.abs(square - np.eye(k)).max())
    explained = F.element_at(F.array(*[F.lit(float(e / model.trace)) for e in model.values]), F.col("component"))
    return (
        made.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
        .withColumn("component", (F.col("at") + 1).cast("int"))
        .select(
            F.col("id").alias(id_col),
            "component",
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            explained.alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
