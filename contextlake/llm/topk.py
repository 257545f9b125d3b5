"""Exact top-k inner products by columnar branch-and-bound.

Vectors are scaled to integers and kept in blocks of vertical layout: a row per
dimension, a column per vector.  For each query a block's scores are built up a
few dimensions at a time; what the remaining dimensions can add is at most the
product of the remaining norms.  Candidates whose upper bound is below the k-th
best lower bound go, and the survivors' columns are compacted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextlake.llm import scratch

BLOCK_ROWS = 4096
QUERY_ROWS = 512
STEP = 8
EXACT = float(1 << 53)


def _packed(ids: list[int], vectors: list[np.ndarray]) -> tuple[int, bytes, bytes]:
    m = np.ascontiguousarray(np.stack(vectors, axis=1))
    return m.shape[0], np.asarray(ids, np.int64).tobytes(), m.astype(np.float64).tobytes()


def _blocked(batches: Iterable[pa.RecordBatch], scale: float, rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of one dimension: (d, ids, columns)."""
    held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

    def emit(d: int) -> pa.RecordBatch:
        size, ids, data = _packed(*held.pop(d))
        return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([ids], pa.binary()), pa.array([data], pa.binary())], ["d", "ids", "data"])

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if i is None or not v.is_valid or v.values is None or v.values.null_count:
                continue
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            if not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                x = np.floor(scale * x)
            if not np.isfinite(x).all():
                continue
            ids, vectors = held.setdefault(len(x), ([], []))
            ids.append(i)
            vectors.append(x)
            if len(ids) == rows:
                yield emit(len(x))
    for d in list(held):
        yield emit(d)


def best_of_block(q: np.ndarray, q_id: int, block: np.ndarray, ids: np.ndarray, rest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best columns other than the query's own; ``rest``
    has the norms of what follows each step of dimensions, per column."""
    own = ids != q_id
    alive = np.flatnonzero(own)
    columns = block if len(alive) == len(ids) else block[:, alive]
    score = np.zeros(len(alive))
    d = len(q)
    for step, lo in enumerate(range(0, d, STEP)):
        score = score + q[lo : lo + STEP] @ columns[lo : lo + STEP]
        if len(alive) > k and lo + STEP < d:
            slack = np.sqrt((q[lo + STEP :] ** 2).sum()) * rest[step + 1, alive] * (1 + 1e-9) + 1e-6
            floor = np.partition(score - slack, len(alive) - k)[len(alive) - k]
            keep = score + slack >= floor
            if keep.sum() < 0.75 * len(alive):
                alive, score, columns = alive[keep], score[keep], columns[:, keep]
    order = np.lexsort((ids[alive], -score))[:k]
    return ids[alive[order]], score[order]


def _exact_scores(q: np.ndarray, block: np.ndarray) -> np.ndarray:
    whole = [int(x) for x in q]
    return np.array([sum(a * int(b) for a, b in zip(whole, column, strict=True)) for column in block.T], dtype=object)


def _searched(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, q_ids, q_data, c_ids, c_data in zip(*(batch.column(c).to_pylist() for c in ("d", "q_ids", "q_data", "ids", "data")), strict=True):
            ids, block = np.frombuffer(c_ids, np.int64), np.frombuffer(c_data, np.float64).reshape(d, len(c_ids) // 8)
            names, queries = np.frombuffer(q_ids, np.int64), np.frombuffer(q_data, np.float64).reshape(d, len(q_ids) // 8).T
            big = not d or np.abs(block).max(initial=0) * np.abs(queries).max(initial=0) * d >= EXACT
            rest = np.zeros((-(-d // STEP) + 1, len(ids)))
            for step in range(len(rest) - 2, -1, -1):
                rest[step] = rest[step + 1] + (block[step * STEP : (step + 1) * STEP] ** 2).sum(axis=0)
            rest = np.sqrt(rest)
            found: list[tuple[int, int, int]] = []
            for name, q in zip(names.tolist(), queries, strict=True):
                if big:  # beyond exact doubles: whole numbers, no bounds
                    score = _exact_scores(q, block)
                    best = sorted((-s, i) for s, i in zip(score, ids.tolist(), strict=True) if i != name)[:k]
                    found += [(name, i, max(min(-s, 2**63 - 1), -(2**63))) for s, i in best]
                else:
                    best, score = best_of_block(q, name, block, ids, rest, k)
                    found += zip([name] * len(best), best.tolist(), map(int, score.tolist()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ([], [], []))], ["query_id", "vec_id", "score"])


def top_k(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows by the
    integer inner product of floor(scale * component); ties to the smaller id.

    Rows without an id, with a null vector, or with null or non-finite
    components take no part, and vectors of different lengths are not compared.
    Rows that carry a query's id are its own.  All queries meet all rows in
    blocks of ``QUERY_ROWS`` by ``BLOCK_ROWS``; nothing is broadcast.
    """
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    schema = "d int, ids binary, data binary"
    cells = scratch.table(source.select("id", "v").mapInArrow(partial(_blocked, scale=scale, rows=BLOCK_ROWS), schema), "vectors")
    asked = scratch.table(source.filter("q and id is not null and v is not null").select("id", "v"), "queries")
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    queries = asked.repartition(parts).mapInArrow(partial(_blocked, scale=scale, rows=QUERY_ROWS), schema)
    queries = scratch.table(queries.select("d", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), (F.monotonically_increasing_id()).alias("block")), "queries")
    numbers = scratch.table(queries.select("d", "block"), "numbers")
    tasks = max(1, min(parts * cells.count(), 4096))
    pairs = cells.withColumn("cell", F.monotonically_increasing_id()).join(numbers, "d").repartition(tasks, "block", "cell").join(queries, ["d", "block"]).drop("block", "cell")
    found = pairs.mapInArrow(partial(_searched, k=k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
