"""Exact vector search: the most similar rows for a set of query vectors.

The queries are the small side. They are sent to all tasks in blocks of about BLOCK vectors, of which the driver holds
one at a time; a task scores SLICE rows against a block with one matrix product and keeps the k best of each query,
so a task's memory is bounded, and what is shuffled is k rows for each query and task, not queries times rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.vectors import similarity, usable
from leafmill.tables import written

BLOCK = 4096
SLICE = 1024


def top_k(rows: DataFrame, query: list[float], k: int, normalised: bool = False) -> DataFrame:
    """The k rows (id, v) most similar to one query vector: id, score. All in the JVM; ends in TakeOrderedAndProject."""
    if k <= 0:
        raise ValueError("k must be positive")
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.filter(usable("v", len(query))).select("id", similarity(q, "v", normalised).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _best(block, k: int, normalised: bool, id_type: pa.DataType):  # noqa: ANN001, ANN202
    """The k best of each query among a task's rows; of equal ones (to twelve decimals) those of smaller ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = block.value
        least = np.full(len(q), -np.inf)
        best: list[list[tuple[float, object]]] = [[] for _ in range(len(q))]  # score with its sign turned, id
        for b in batches:
            for start in range(0, b.num_rows, SLICE):
                part = b.slice(start, SLICE)
                ids = np.array(part.column("id").to_pylist(), object)
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], _matrix(part.column("v"))[order]
                scores = np.round((x if normalised else _unit(x)) @ q.T, 12).T
                for n in np.flatnonzero((scores.max(axis=1) > least) | ((scores.max(axis=1) == least) & np.isfinite(least))).tolist():
                    at = np.flatnonzero(scores[n] >= least[n])
                    at = at[np.argsort(-scores[n][at], kind="stable")[:k]]
                    best[n] = sorted([*best[n], *zip((-scores[n][at]).tolist(), ids[at], strict=True)])[:k]
                    if len(best[n]) == k:
                        least[n] = -best[n][-1][0]
        rows = [(n, i, -s) for n, of in enumerate(best) for s, i in of]
        yield pa.RecordBatch.from_arrays([names.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.float64())], ["query_id", "id", "score"])

    return run


def top_k_batch(rows: DataFrame, queries: DataFrame, k: int, normalised: bool = False) -> DataFrame:
    """The k rows most similar to each query: query_id, id, score, rank. rows: id, v; queries: query_id, v.

    Cosine, or the inner product of vectors said to be normalised, to twelve decimals. Ties go to the smaller id. Rows and queries whose
    vector is null, empty, of another length than the queries' or holds null or NaN are left out. A zero vector scores 0. Ids must be unique."""
    if k <= 0:
        raise ValueError("k must be positive")
    queries = written(queries.filter(usable("v")).select("query_id", "v"), "queries")
    blocks, first = -(-queries.count() // BLOCK), queries.first()
    id_type = dict(rows.dtypes)["id"]
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {id_type}, score double"
    if first is None:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    usable_rows = rows.filter(usable("v", len(first.v))).select("id", "v")
    arrow = usable_rows.select("id").limit(0).toArrow().schema.field("id").type
    sc = rows.sparkSession.sparkContext
    parts = []
    for n in range(blocks):
        t = queries.filter((F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n) & (F.size("v") == len(first.v))).toArrow().combine_chunks()
        if t.num_rows:
            q = _matrix(t.column("v").combine_chunks())
            block = sc.broadcast((t.column("query_id").combine_chunks(), q if normalised else _unit(q)))
            parts.append(usable_rows.mapInArrow(_best(block, k, normalised, arrow), schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
