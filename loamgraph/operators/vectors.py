"""Exact nearest neighbours by cosine, in blocks of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.vectors import FLOOR, cosine, norm

#: Vectors in a block; with 1,024 numbers each, 8 MB.
BLOCK = 1024


def checked(points: DataFrame, vector: str, dims: int) -> DataFrame:
    """Fail where a vector has not ``dims`` numbers."""
    return points.withColumn(vector, F.when(F.size(vector) == dims, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit(f"expected {dims} numbers, found "), F.size(vector).cast("string")))))


def top_k(points: DataFrame, query: list[float], k: int, *, key: str | Sequence[str] = "vec_id", vector: str = "embedding", dims: int | None = None) -> DataFrame:
    """(key, score) of the k points nearest to one vector; ties by the key, of one column or several. Null vectors are left out.

    With ``dims``, a query or a point of another width is an error; else the shorter width counts."""
    if dims is not None:
        if len(query) != dims:
            raise ValueError(f"expected {dims} numbers, found {len(query)}")
        points = checked(points.where(F.col(vector).isNotNull()), vector, dims)
    asked = F.array(*(F.lit(float(x)) for x in query))
    keys = [key] if isinstance(key, str) else list(key)
    scored = points.where(F.col(vector).isNotNull()).select(*keys, cosine(F.col(vector), asked, norm(F.col(vector)), F.lit(float(np.linalg.norm(query)))).alias("score"))
    return scored.orderBy(F.desc("score"), *keys).limit(k)


def _unit(flat: pa.Array, n: int) -> np.ndarray:
    rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), FLOOR)


def _against(queries: DataFrame, points: DataFrame, key: str, vector: str, keep: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(query, point, score) of the pairs that ``keep`` takes from the cosines of a block of queries and one of points.

    Queries are put together by hash to blocks of about BLOCK, points where they lie; each block of points meets each
    of queries by its number, as one matrix product. Spark sends the query blocks to the points where they are small
    and shuffles both where not; nothing comes to the driver but the number of queries."""
    kind = points.schema[key].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()
    ours, theirs = (rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")) for rows in (queries, points))
    blocks = max(1, -(-ours.count() // BLOCK))
    numbered = ours.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    asked = numbered.groupBy("block").agg(F.collect_list(F.struct("key", "vector")).alias("q")).select("block", F.col("q.key").alias("queries"), F.flatten("q.vector").alias("sought"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (part.column(0), part.column(1).flatten())]
                yield pa.RecordBatch.from_arrays(lists, names=["points", "given"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_keys, q_flat, p_keys, p_flat in zip(*(batch.column(c) for c in range(4)), strict=True):
                q_keys, p_keys = q_keys.as_py(), p_keys.as_py()
                near = _unit(q_flat.values, len(q_keys)) @ _unit(p_flat.values, len(p_keys)).T
                q, p = keep(near)
                yield pa.RecordBatch.from_arrays([pa.array([q_keys[i] for i in q], arrow), pa.array([p_keys[j] for j in p], arrow), pa.array(near[q, p])], names=["query", "point", "score"])

    packed = theirs.mapInArrow(pack, f"points array<{kind}>, given array<double>").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return packed.join(asked, "block").select("queries", "sought", "points", "given").mapInArrow(run, f"query {kind}, point {kind}, score double")


def nearest(queries: DataFrame, points: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, point, score, rank): the k nearest points of every query vector, itself left out; ties by the point.

    All vectors have the same width. Each pair of blocks passes on at most k + 1 a query and ties, of which the shuffle
    keeps k.
    """

    def keep(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = min(k + 1, near.shape[1])
        least = np.partition(near, near.shape[1] - n, axis=1)[:, near.shape[1] - n, None]
        return np.nonzero(near >= least)

    every = _against(queries, points, key, vector, keep)
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "point")
    return every.where("query <> point").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def near_pairs(queries: DataFrame, points: DataFrame, threshold: float, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b, score) with a < b of the pairs of a query and a point whose cosine reaches ``threshold``."""
    every = _against(queries, points, key, vector, lambda near: np.nonzero(near >= threshold))
    pairs = every.where("query <> point").select(F.least("query", "point").alias("a"), F.greatest("query", "point").alias("b"), "score")
    return pairs.groupBy("a", "b").agg(F.max("score").alias("score"))
