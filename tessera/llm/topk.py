"""Exact top-k search by inner product: columnar branch-and-bound.

Vectors are packed into blocks in vertical layout (dimension by dimension). A block of queries meets a block of candidates
once; scores are accumulated over a few dimensions at a time, and after each step a candidate whose best possible score
(its partial score plus the product of the remaining masses, by Cauchy-Schwarz) lies below the k-th best certain one is
dropped and the survivors are compacted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import materialize

BLOCK = "block long, n long, dims int, ids binary, columns binary"
FOUND = "query_id long, vec_id long, score long"


def quantize(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v, the components floor(scale * x); rows whose vector is null or holds a null or non-finite component go."""
    real = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).filter(real).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """``vectors`` (vec_id, v) in blocks of at most ``size``, dimension-major; shorter vectors are filled up with zeros."""

    def run(batches):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 32
        ids, rows = [], []

        def put():
            dims = max(map(len, rows))
            columns = np.zeros((dims, len(rows)), dtype=np.int64)
            for i, v in enumerate(rows):
                columns[: len(v), i] = v
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((k, len(rows), dims, np.array(ids, dtype=np.int64).tobytes(), columns.tobytes()), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "n", "dims", "ids", "columns"])

        for batch in batches:
            for vec, v in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), strict=True):
                ids.append(vec)
                rows.append(v)
                if len(rows) == size:
                    yield put()
                    k, ids, rows = k + 1, [], []
        if rows:
            yield put()

    return vectors.mapInArrow(run, BLOCK)


def search_block(q_ids, q, c_ids, c, k: int, step: int = 16):
    """The k best candidates (columns of ``c``) of every query (columns of ``q``) but itself: (query, candidate, score) arrays.

    Sums stay below 2**53 in double precision where the masses allow it; otherwise they are made in 64-bit integers.
    """
    dims = max(len(q), len(c))
    q, c = (np.vstack([m, np.zeros((dims - len(m), m.shape[1]), dtype=m.dtype)]) for m in (q, c))
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dims < 2**52
    kind = np.float64 if exact else np.int64
    order = np.argsort(-(c.astype(np.float64) ** 2).sum(axis=1), kind="stable")  # the heaviest dimensions first
    q, c = np.ascontiguousarray(q[order].T.astype(kind)), np.ascontiguousarray(c[order].astype(kind))
    cuts = [*range(0, dims, step), dims]
    mass = lambda m, axis: [np.sqrt((m[a:] if axis == 0 else m[:, a:]).astype(np.float64).__pow__(2).sum(axis=axis)) * (1 + 1e-9) for a in cuts]
    c_mass, q_mass = mass(c, 0), mass(q, 1)
    first = q[:, : cuts[1]] @ c[: cuts[1]]
    best_id, best_score, owner = [], [], []
    for i in range(len(q_ids)):
        alive = np.flatnonzero(c_ids != q_ids[i])
        partial = first[i, alive]
        for j in range(1, len(cuts)):
            if j > 1:
                partial = partial + q[i, cuts[j - 1] : cuts[j]] @ c[cuts[j - 1] : cuts[j], alive]
            if len(alive) > k and j < len(cuts) - 1:
                slack = q_mass[j][i] * c_mass[j][alive] + 1e-6
                sure = np.partition(partial - slack, len(alive) - k)[len(alive) - k]
                keep = partial + slack >= sure
                alive, partial = alive[keep], partial[keep]
        if len(alive) > k:  # ties at the end go to the smaller id
            sure = np.partition(partial, len(alive) - k)[len(alive) - k]
            keep = partial >= sure
            alive, partial = alive[keep], partial[keep]
        top = np.lexsort((c_ids[alive], -partial))[:k]
        best_id.append(c_ids[alive[top]])
        best_score.append(partial[top].astype(np.int64))
        owner.append(np.full(len(top), q_ids[i]))
    return [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (owner, best_id, best_score)]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, candidate_block: int = 16_384, query_block: int = 512, group: int = 16) -> DataFrame:
    """The ``k`` highest inner products of every row of ``queries`` with the other rows of ``vectors`` (both vec_id, v).

    Returns query_id, rank from 1, vec_id and score; equal scores go to the smaller vec_id; fewer rows where there are
    fewer candidates, none for an empty table. A row is never its own candidate (by vec_id; a repeated vec_id is a candidate
    as often as it is there). Every block of candidates meets every group of query blocks in a task of its own, which holds
    one of the former and ``group`` of the latter, whatever the tables hold.
    """
    found = materialize(blocks(vectors, candidate_block), "candidates")
    asked = materialize(blocks(queries, query_block), "queries")
    order = Window.orderBy("block")  # a row for each block of thousands of vectors
    number = lambda df: df.withColumn("k", F.row_number().over(order) - 1)
    n_candidates, n_groups = found.count(), -(-asked.count() // group)
    if not n_candidates or not n_groups:
        return asked.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    places = lambda df: number(df.select("block"))
    left = found.join(places(found), "block").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).withColumnRenamed("k", "c")
    right = asked.join(places(asked), "block").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1)))).withColumn("g", F.floor(F.col("k") / group).cast("int")).drop("k")

    def meet(one: pa.Table, many: pa.Table) -> pa.Table:
        open_ = lambda t, i: [np.frombuffer(t.column("ids")[i].as_py(), dtype=np.int64), np.frombuffer(t.column("columns")[i].as_py(), dtype=np.int64).reshape(t.column("dims")[i].as_py(), -1)]
        out = [search_block(*open_(many, j), *open_(one, i), k) for i in range(one.num_rows) for j in range(many.num_rows)]
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (zip(*out, strict=True) if out else [[], [], []])], names=["query_id", "vec_id", "score"])

    best = left.groupBy("c", "g").cogroup(right.groupBy("c", "g")).applyInArrow(meet, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
