"""Exact cosine top-k over unit vectors, plain or eight-bit."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions import vectors as V
from mnemolake.operators.materialize import settle
from mnemolake.sources.projection import spread

#: Queries that are broadcast at once; rows of either matrix that are multiplied at once.
QUERY_BLOCK, CHUNK = 16_384, 2048
#: Scores are compared rounded to 1e-9.
MARGIN = 2e-9


def _literal(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def top_k(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, allow: DataFrame | None = None) -> DataFrame:
    """id, score: the best ``k`` rows by dot product, ties to smaller ids.

    ``allow`` (ids) restricts the rows. Filters run before any product; each task keeps k rows.
    """
    rows = vectors if where is None else vectors.where(where)
    if allow is not None:
        rows = rows.join(allow.select("id"), "id", "left_semi")
    scored = rows.select("id", V.clamp_unit(V.dot("vector", _literal(query))).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def top_k_many(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank for a table of queries (query_id, query), a block of about ``QUERY_BLOCK`` at a time.

    A block meets all vectors: every task multiplies matrices and keeps what may be among the best of each query, so a block's
    memory and shuffle are bounded by queries times tasks. Products only choose; scores are summed as elsewhere. Vectors and
    queries that are null, of another length or not finite meet the others one by one.
    """
    first = queries.where(F.size("query") > 0).select(F.size("query")).first()
    if first is None:
        return _ranked(_one_by_one(vectors, queries), k)
    size = first[0]
    plain = lambda v: F.coalesce((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    vectors, queries = vectors.select("id", "vector"), queries.select("query_id", "query")
    odd_vectors, odd_queries = settle(vectors.where(~plain("vector"))), settle(queries.where(~plain("query")))
    held = settle(queries.where(plain("query")))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    rows = spread(vectors).where(plain("vector")).select(F.col("id").cast("long"), F.col("vector").cast("array<double>").alias("vector")).coalesce(4 * cores)
    blocks = -(-held.count() // QUERY_BLOCK) or 1
    found = [_best_of_block(rows, held.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), k, size) for b in range(blocks)]
    for some, others in ((odd_vectors, queries), (vectors.where(plain("vector")), odd_queries)):
        if not (odd_vectors if some is odd_vectors else odd_queries).isEmpty():
            found.append(settle(_ranked(_one_by_one(some, others), k)).drop("rank"))
    return _ranked(reduce(DataFrame.union, found), k)


def _one_by_one(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    return vectors.crossJoin(queries).select("query_id", "id", V.clamp_unit(V.dot("vector", "query")).alias("score"))


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _best_of_block(rows: DataFrame, queries: DataFrame, k: int, size: int) -> DataFrame:
    """query_id, id, score: the best ``k`` of every query of the block."""
    block = queries.select(F.col("query_id").cast("long"), F.col("query").cast("array<double>")).toArrow().combine_chunks()
    told = rows.sparkSession.sparkContext.broadcast((block.column(0).to_numpy(), _matrix(block.column(1), size)))
    out = settle(_ranked(rows.mapInArrow(_nearest(told, k, size), "query_id long, id long, score double"), k).drop("rank"))
    told.destroy()
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.zeros((0, size)), *[p.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) for p in parts]])


def _nearest(told: Broadcast, k: int, size: int):
    """Of a task's vectors, those that can be among the best of a query once scores are rounded and ties go to smaller ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = told.value
        least = np.full(len(queries), -np.inf)  # k-th score so far
        best = np.zeros(0, [("q", "i8"), ("id", "i8"), ("score", "f8")])
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1), size)
            for at in range(0, len(ids), CHUNK):
                best = met(queries, least, best, ids[at : at + CHUNK], vectors[at : at + CHUNK])
        yield pa.record_batch([pa.array(query_ids[best["q"]]), pa.array(best["id"]), pa.array(best["score"])], names=["query_id", "id", "score"])

    def met(queries: np.ndarray, least: np.ndarray, best: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        new = [best]
        lengths, longest = np.linalg.norm(queries, axis=1), np.linalg.norm(vectors, axis=1).max()
        for low in range(0, len(queries), CHUNK):
            product = np.clip(queries[low : low + CHUNK] @ vectors.T, -1.0, 1.0)
            slack = MARGIN + size * 1e-15 * lengths[low : low + CHUNK] * longest  # another order of summing
            floor = least[low : low + CHUNK].copy()
            none = np.flatnonzero(floor == -np.inf)
            if len(none) and len(ids) > k:  # of equal ones, of which there may be many, ids decide below
                floor[none] = np.partition(product[none], len(ids) - k, axis=1)[:, len(ids) - k] - slack[none]
            i, j = np.nonzero(product >= (floor - slack)[:, None])
            for part in range(0, len(i), 1 << 20):
                a, b = i[part : part + (1 << 20)], j[part : part + (1 << 20)]
                score = np.zeros(len(a))
                for c in range(size):
                    score += queries[low + a, c] * vectors[b, c]
                some = np.zeros(len(a), best.dtype)
                some["q"], some["id"], some["score"] = low + a, ids[b], np.clip(score, -1.0, 1.0)
                new.append(keep(some, None))
        return keep(np.concatenate(new), least) if len(new) > 1 else best

    def keep(rows: np.ndarray, least: np.ndarray | None) -> np.ndarray:
        rows = rows[np.lexsort((rows["id"], -rows["score"], rows["q"]))]
        nth = np.arange(len(rows)) - np.searchsorted(rows["q"], rows["q"])
        kth = np.flatnonzero(nth == k - 1)
        floor = np.full(int(rows["q"].max(initial=0)) + 1, -np.inf)
        floor[rows["q"][kth]] = rows["score"][kth]
        if least is not None:
            least[rows["q"][kth]] = rows["score"][kth]
        start = np.r_[True, (rows["q"][1:] != rows["q"][:-1]) | (rows["score"][1:] != rows["score"][:-1])][: len(rows)]
        equal = np.arange(len(rows)) - np.maximum.accumulate(np.where(start, np.arange(len(rows)), 0))
        return rows[(rows["score"] >= floor[rows["q"]] - MARGIN) & (equal < k)]

    return run


def quantize(vectors: DataFrame) -> DataFrame:
    """Replaces ``vector`` by ``scale`` and eight-bit ``codes``."""
    scaled = vectors.withColumn("scale", V.sq8_scale("vector"))
    return scaled.withColumn("codes", V.sq8_codes("vector", "scale")).drop("vector")


def top_k_quantized(quantized: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """As ``top_k``, over codes, with integer products."""
    rows = quantized if where is None else quantized.where(where)
    rows = rows.withColumn("query", _literal(query)).withColumn("query_scale", V.sq8_scale("query"))
    product = V.dot_codes(V.sq8_codes("query", "query_scale"), F.col("codes"))
    score = V.clamp_unit(F.col("query_scale").cast("double") * F.col("scale").cast("double") * product)
    return rows.select("id", score.alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def gaps(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids that should have a vector and have none."""
    return records.select("id").join(vectors.select("id"), "id", "left_anti")


def orphans(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids of vectors whose record is gone."""
    return vectors.select("id").join(records.select("id"), "id", "left_anti")


def is_ready(records: DataFrame, vectors: DataFrame) -> bool:
    return gaps(records, vectors).isEmpty()
