"""Near-duplicate vectors by p-stable hashing of normalised vectors, and exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcut.llm.common import append_columns, stored
from gridcut.llm.components import Forest, components
from gridcut.llm.runs import by_run, pairs_in_runs, run_numbers, shared_keys

#: Tables, projections a table, and the width of a projection's steps. Two unit vectors at cosine 0.98
#: share a step with chance 0.84, so a table of 8 with 0.25 and one of 24 tables with 0.999.
TABLES, PROJECTIONS, WIDTH, SEED = 24, 8, 1.0, 7


def _projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng([SEED, dim])
    shape = (dim, TABLES * PROJECTIONS)
    return drawn.standard_normal(shape), drawn.uniform(0, WIDTH, TABLES * PROJECTIONS)


def table_keys(vectors: np.ndarray) -> np.ndarray:
    """A 64-bit key in each table for each vector: its quantised projections, mixed."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    axes, shifts = _projections(vectors.shape[1])
    steps = np.floor((unit @ axes + shifts) / WIDTH).astype(np.int64).view(np.uint64)
    steps = steps.reshape(len(unit), TABLES, PROJECTIONS)
    key = np.zeros((len(unit), TABLES), np.uint64)
    for k in range(PROJECTIONS):
        key = (key ^ steps[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _usable(vector: str) -> Column:
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _with_keys(distinct: DataFrame) -> DataFrame:
    added = T.StructType([T.StructField("keys", T.ArrayType(T.LongType()))])

    def compute(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lists = batch.column(batch.schema.names.index("vector"))
            sizes = np.diff(lists.offsets.to_numpy())
            flat, begin = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            keys = np.zeros((batch.num_rows, TABLES), np.uint64)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                rows = flat[begin[own][:, None] + np.arange(dim)]
                keys[own] = table_keys(rows)
            values = pa.array(keys.view(np.int64).ravel())
            yield batch, [pa.ListArray.from_arrays(np.arange(0, keys.size + 1, TABLES, dtype=np.int32), values)]

    return append_columns(distinct, added, compute)


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    least_cosine: float = 0.98,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Rows of one label (not null) and one length link when the cosine of their vectors, in double
    precision, is `least_cosine` or more. Equal vectors of a label meet once: pairs are sought among
    distinct ones, and the others count with their number. Vectors that share a key in any table are
    candidates; a pair that several tables bring together counts in the first of them, which both
    vectors' keys tell, so links are counted without listing them.

    Null or empty vectors, zero vectors, vectors with a null or non-finite component and rows without
    a label link with nothing; they are their own component and kept. Null ids link, but are never
    the smallest id. Repeated rows are links of each other, each with a row of its own. No rows give
    no rows.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), v.alias("v"))
    usable = F.col("label").isNotNull() & _usable("v")
    rows = rows.withColumn("code", F.when(usable, F.xxhash64("label", "v"))).withColumn(
        "code2", F.when(usable, F.xxhash64("v", "label", F.lit(1)))
    )
    distinct = (
        rows.where("code is not null")
        .groupBy("code", "code2")
        .agg(F.first("label").alias("label"), F.first("v").alias("vector"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
        .withColumn("rep", F.monotonically_increasing_id())
        .withColumn("dim", F.size("vector"))
    )
    distinct = stored(_with_keys(distinct), "distinct_vectors")
    keyed = distinct.select(
        "rep", F.posexplode("keys").alias("table", "part"), "label", "dim"
    ).select("rep", "table", F.xxhash64("label", "dim", "table", "part").alias("key"))
    runs = shared_keys(keyed, "key", "rep").join(distinct.select("rep", "label", "vector", "keys", "n"), "rep")
    found = stored(_compare(runs, least_cosine), "vector_links")
    links = found.where("linked is not null").select(F.col("rep").alias("a"), F.col("linked").alias("b"))
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("others"))
    roots = components(links).withColumnRenamed("node", "rep")
    named = (
        distinct.select("rep", "code", "code2", "n", "least")
        .join(counts, "rep", "left")
        .join(roots, "rep", "left")
        .withColumn("root", F.coalesce("root", "rep"))
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select(
        "code", "code2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component_id"
    )
    out = rows.drop("v", "label").join(named, ["code", "code2"], "left")
    own = F.when(F.col("code").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("vec_id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.col("vec_id").eqNullSafe(own).alias("kept"),
    )


def _compare(runs: DataFrame, least_cosine: float) -> DataFrame:
    """For each row of a run: how many vectors it links to first here, and links that connect the run."""

    def work(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        whole = whole.combine_chunks()
        rep, n = whole.column("rep").to_numpy(), whole.column("n").to_numpy()
        table, label = whole.column("table").to_numpy(), whole.column("label").to_numpy(zero_copy_only=False)
        piece, alone = whole.column("_own").to_numpy(), whole.column("_alone").to_numpy(zero_copy_only=False)
        keys = np.stack(whole.column("keys").to_numpy(zero_copy_only=False))
        vectors = whole.column("vector").to_numpy(zero_copy_only=False)
        size = np.array([len(v) for v in vectors])
        counts, forest, a, b = np.zeros(len(rep), np.int64), Forest(), [], []
        run = run_numbers(whole, ["key", "_run"])
        for dim in np.unique(size).tolist():
            own = np.flatnonzero(size == dim)
            x = np.stack(vectors[own])
            norm = np.linalg.norm(x, axis=1)
            for i, j in pairs_in_runs(run[own]):
                for at in range(0, len(i), 65536):
                    p, q = i[at : at + 65536], j[at : at + 65536]
                    near = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= least_cosine
                    p, q = p[near], q[near]
                    gp, gq = own[p], own[q]
                    here = (label[gp] == label[gq]) & ((keys[gp] == keys[gq]).argmax(axis=1) == table[gp])
                    here &= (piece[gp] != piece[gq]) | alone[gp]
                    gp, gq = gp[here], gq[here]
                    np.add.at(counts, gp, n[gq])
                    np.add.at(counts, gq, n[gp])
                    for s, t in zip(rep[gp].tolist(), rep[gq].tolist(), strict=True):
                        if forest.join(s, t):
                            a.append(s)
                            b.append(t)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([rep[some], np.array(a, np.int64)])),
                pa.array(np.concatenate([counts[some], np.zeros(len(a), np.int64)])),
                pa.array([None] * len(some) + b, pa.int64()),
            ],
            names=["rep", "n_links", "linked"],
        )

    return by_run(runs, ["key", "_run"], ["rep"], work, "rep long, n_links long, linked long")
