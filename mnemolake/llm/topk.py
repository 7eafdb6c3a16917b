"""Exact top-k inner-product search over a pivot-distance index.

Vectors become integers floor(256 x). One more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, puts all on one
sphere, where a larger inner product with a query is a smaller angle. Every vector is keyed by its nearest pivot and its
angle to it, and the table is range-partitioned by that key, so a partition is a run of sorted annuli. A query's own
partition gives a first k-th best score. Angles obey the triangle inequality: an annulus holds no vector nearer to the
query than its angle to the pivot differs from the annulus's. A query visits only annuli whose bound can beat its score,
ring by ring from the most promising, raises the score by what it finds, and leaves out rings that cannot beat it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import cut

#: Pivots are fitted on this many rows with the smallest hashes of their ids; every row is indexed.
SAMPLE, PIVOTS = 2048, 64
#: Rows of a partition of the index; a larger index has more partitions.
GROUP_ROWS = 4096
QUERY_BLOCK = 512
#: Sorted rows of one pivot in a partition that share their bounds.
RING_ROWS = 256


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out, norms = [], [], []
        for vec_id, vector in zip(batch.column(0), batch.column(1)):
            vector = vector.values
            if vector is None or vector.null_count or not vec_id.is_valid:
                continue
            x = vector.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                x = np.floor(256 * x)
            if not np.isfinite(x).all():
                continue
            # Whole numbers of a double, four bytes where they fit, eight where not.
            small = np.abs(x).max(initial=0) < 2**31
            ids.append(vec_id.as_py()), out.append((b"\0" + x.astype(np.int32).tobytes()) if small else b"\1" + x.tobytes())
            norms.append(float(np.minimum((x**2).sum(), 1e300)) if small or np.abs(x).max() < 1e140 else 1e300)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "v", "norm2"])


def _components(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if raw[0] == 0 else np.float64, offset=1)


def _matrix(vectors, dim: int) -> np.ndarray:
    """Rows of equal length; shorter vectors end in zeros."""
    raw = [x if isinstance(x, bytes) else x.as_py() for x in vectors]
    if all(len(x) == 4 * dim + 1 and x[0] == 0 for x in raw):
        return np.frombuffer(b"".join([x[1:] for x in raw]), np.int32).reshape(len(raw), dim).astype(np.float64)
    out = np.zeros((len(raw), dim))
    for i, x in enumerate(raw):
        values = _components(x)
        out[i, : len(values)] = values
    return out


def _angles(x: np.ndarray, norm2: np.ndarray, most2: float, pivots: np.ndarray, lifted: bool) -> np.ndarray:
    """Angles to the pivots (unit vectors on the sphere) of rows, or of queries, which have no height of their own."""
    if lifted:
        full = np.column_stack([x, np.sqrt(np.maximum(most2 - norm2, 0))]) / np.sqrt(max(most2, 1e-300))
    else:
        full = np.column_stack([x / np.sqrt(np.maximum(norm2, 1e-300))[:, None], np.zeros(len(x))])
    return np.arccos(np.clip(full @ pivots.T, -1, 1))


def fit_pivots(vectors: np.ndarray, norm2: np.ndarray, most2: float, n: int = PIVOTS, rounds: int = 5) -> np.ndarray:
    """Directions of a sample on the sphere: farthest first, then a few means."""
    full = np.column_stack([vectors, np.sqrt(np.maximum(most2 - norm2, 0))]) / np.sqrt(max(most2, 1e-300))
    chosen = [0]
    near = full @ full[0]
    while len(chosen) < min(n, len(full)) and near.min() < 1 - 1e-12:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, full @ full[chosen[-1]])
    centres = full[chosen]
    for _ in range(rounds):
        at = (full @ centres.T).argmax(1)
        for k in range(len(centres)):
            if (at == k).any() and (size := np.linalg.norm(mean := full[at == k].mean(0))) > 0:
                centres[k] = mean / size
    return centres


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles where sums stay below 2^52, in unbounded integers elsewhere.

    No sum of the products' sizes exceeds the product of the norms. Scores beyond a long are held at its ends.
    """
    q, r = (np.sqrt((m**2).sum(1)) for m in (queries, rows))
    if q.max(initial=0) * r.max(initial=0) < 2**52:
        return queries @ rows.T
    large_q, large_r = q >= 2**26, r >= 2**26
    out = np.zeros((len(q), len(r)), np.int64)
    out[np.ix_(~large_q, ~large_r)] = (queries[~large_q] @ rows[~large_r].T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in row] for row in m.tolist()], object).reshape(m.shape)
    low, high = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
    everything = np.ones(len(r), bool)
    for some, against in ((large_q, everything), (~large_q, large_r)):
        if some.any() and against.any():
            exact = whole(queries[some]) @ whole(rows[against]).T
            out[np.ix_(some, against)] = np.clip(exact, low, high).astype(np.int64)
    return out


def _top(scores: np.ndarray, query_rows: np.ndarray, row_marks: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, score) of each query's k best other rows, ties to smaller ids; a row is told by its mark."""
    low = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
    scores = np.where(query_rows[:, None] == row_marks, low, scores)
    n = scores.shape[1]
    kth = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), low)
    q, r = np.nonzero((scores >= kth[:, None]) & (scores > low))
    s = scores[q, r]
    order = np.lexsort((row_ids[r], -s, q))
    q, r, s = q[order], r[order], s[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    return q[nth < k], r[nth < k], s[nth < k]


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, most2, dim = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            angles = _angles(_matrix(batch.column("v"), dim), batch.column("norm2").to_numpy(), most2, pivots, True)
            pivot = angles.argmin(1)
            yield pa.record_batch([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(angles[np.arange(len(angles)), pivot])], names=["vec_id", "v", "norm2", "mark", "pivot", "dist"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Rows in order, so many at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _seed(shared, every: int, k: int, group_rows: int):
    """Adds the group and ring, and for queries the k-th best score within a block of at most ``group_rows`` of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, dim = shared.value
        g, nth = TaskContext.get().partitionId(), 0
        for rows in _blocks(batches, group_rows):
            ids, marks, pivots, x = rows["vec_id"].to_numpy(), rows["mark"].to_numpy(), rows["pivot"].to_numpy(), _matrix(rows["v"].combine_chunks(), dim)
            tau = [None] * len(ids)
            asks = np.flatnonzero(ids % every == 0)
            for at in range(0, len(asks), QUERY_BLOCK):
                block = asks[at : at + QUERY_BLOCK]
                q, _, s = _top(_scores(x[block], x), marks[block], marks, ids, k)
                for j in np.flatnonzero(np.bincount(q, minlength=len(block)) >= k):
                    tau[block[j]] = int(s[np.searchsorted(q, j, side="right") - 1])
            ring = (nth + np.arange(len(ids))) // RING_ROWS
            nth += len(ids)
            yield from (
                rows.append_column("tau", pa.array(tau, pa.int64())).append_column("g", pa.array(np.full(len(ids), g, np.int32))).append_column("ring", pa.array(ring.astype(np.int32)))
                .to_batches()
            )

    return run


def _bounds(angles: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray, norm: float, most: float) -> np.ndarray:
    """The largest score that each ring may hold for a query: by the triangle inequality of angles."""
    gap = np.maximum(np.maximum(low - angles[pivot], angles[pivot] - high), 0)
    return norm * most * (np.cos(gap) + 1e-9) + 1


def _visit(shared, annuli):
    """A row for every group that may hold a better vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, most2, dim = shared.value
        group, pivot, low, high = annuli.value
        for batch in batches:
            if not batch.num_rows:
                continue
            norm2 = batch.column("norm2").to_numpy()
            angles = _angles(_matrix(batch.column("v"), dim), norm2, most2, pivots, False)
            tau = batch.column("tau").to_numpy(zero_copy_only=False).astype(np.float64)  # null: nan
            for i in range(len(angles)):
                best = _bounds(angles[i], pivot, low, high, np.sqrt(norm2[i]), np.sqrt(most2))
                visited = np.unique(group[~(best < tau[i])])
                rows = pa.array(np.full(len(visited), i))
                yield pa.record_batch([pa.array(visited.astype(np.int32)), *(batch.column(c).take(rows) for c in ("vec_id", "v", "norm2", "mark", "tau"))], names=["g", "vec_id", "v", "norm2", "mark", "tau"])

    return run


def _search(shared, k: int):
    """Rows come sorted by group, queries behind the group's vectors, which come by pivot and angle.

    A group's vectors wait in rings; queries take rings by falling bound, raise their k-th best score as they go, and
    leave out what can no longer beat it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, most2, dim = shared.value
        now, rings = None, []
        for batch in batches:
            g, side = batch.column("g").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(g)]):
                if a == b:
                    continue
                if g[a] != now:
                    now, rings = g[a], []
                part = batch.slice(a, b - a)
                ids, marks, x = part.column("vec_id").to_numpy(), part.column("mark").to_numpy(), _matrix(part.column("v"), dim)
                if side[a] == 0:
                    pivot, ring, dist = (part.column(c).to_numpy() for c in ("pivot", "ring", "dist"))
                    edges = [0, *(np.flatnonzero((pivot[1:] != pivot[:-1]) | (ring[1:] != ring[:-1])) + 1).tolist(), len(pivot)]
                    for low, high in zip(edges, edges[1:]):
                        rings.append((ids[low:high], marks[low:high], x[low:high], int(pivot[low]), dist[low:high].min(), dist[low:high].max()))
                    continue
                norm2, tau = part.column("norm2").to_numpy(), part.column("tau").to_numpy(zero_copy_only=False).astype(np.float64)
                angles = _angles(x, norm2, most2, pivots, False)
                of, low, high = np.array([r[3] for r in rings]), np.array([r[4] for r in rings]) - 1e-9, np.array([r[5] for r in rings]) + 1e-9
                for at in range(0, len(x), QUERY_BLOCK):
                    mine = slice(at, at + QUERY_BLOCK)
                    yield from _expand(x[mine], marks[mine], ids[mine], tau[mine], angles[mine], np.sqrt(norm2[mine]), np.sqrt(most2), rings, of, low, high, k)

    return run


def _expand(x, marks, ids, tau, angles, norm, most, rings, of, low, high, k: int) -> Iterator[pa.RecordBatch]:
    best = np.stack([_bounds(a, of, low, high, n, most) for a, n in zip(angles, norm)]) if len(x) else np.zeros((0, len(rings)))
    floor = np.where(np.isnan(tau), -np.inf, tau)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    scores = np.full((len(x), k), -np.inf)
    visited = 0
    for r in np.argsort(-best.max(axis=0, initial=-np.inf), kind="stable"):
        asks = np.flatnonzero(best[:, r] >= floor)
        if not len(asks):
            continue
        row_ids, row_marks, rows = rings[r][:3]
        visited += len(asks) * len(row_ids)
        q, i, s = _top(_scores(x[asks], rows), marks[asks], row_marks, row_ids, k)
        good = s >= floor[asks[q]]
        q, i, s = asks[q[good]], i[good], s[good]
        if not len(q):
            continue
        found.append((q, row_ids[i], s.astype(np.int64)))
        width = np.bincount(q, minlength=len(x))
        fresh = np.full((len(x), width.max()), -np.inf)
        fresh[q, np.arange(len(q)) - np.searchsorted(q, q)] = s
        scores = -np.sort(-np.concatenate([scores, fresh], axis=1), axis=1)[:, :k]
        floor = np.maximum(floor, scores[:, k - 1])
    if found:
        q, i, s = (np.concatenate([f[c] for f in found]) for c in range(3))
        good = s >= floor[q]
        order = np.lexsort((i[good], -s[good], q[good]))
        q, i, s = q[good][order], i[good][order], s[good][order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        q, i, s = q[nth < k], i[nth < k], s[nth < k]
        yield pa.record_batch([pa.array(marks[q]), pa.array(ids[q]), pa.array(i), pa.array(s), pa.array(np.zeros(len(q), np.int64))], names=["mark", "query_id", "vec_id", "score", "visited"])
    if visited:
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([visited])], names=["mark", "query_id", "vec_id", "score", "visited"])


def _found(vectors: DataFrame, k: int, every: int, id_col: str, vector_col: str) -> DataFrame | None:
    """(mark, query_id, vec_id, score, visited): each group's best rows by query, and rows that count scored pairs."""
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    quantised = source.mapInArrow(_quantise, "vec_id long, v binary, norm2 double")
    quantised = cut(quantised.withColumn("mark", F.monotonically_increasing_id()), "topk-rows")
    # A vector's bytes after the first: four or eight for each component.
    width = F.max(F.when(F.substring("v", 1, 1) == F.lit(b"\0"), (F.length("v") - 1) / 4).otherwise((F.length("v") - 1) / 8))
    n, most2, dim = quantised.agg(F.count(F.lit(1)), F.max("norm2"), width).first()
    if not n:
        return None
    dim = max(int(dim), 1)
    sample = quantised.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    pivots = fit_pivots(_matrix([bytes(r["v"]) for r in sample], dim), np.array([r["norm2"] for r in sample]), most2)
    shared = spark.sparkContext.broadcast((pivots, most2, dim))
    assigned = quantised.mapInArrow(_assign(shared), "vec_id long, v binary, norm2 double, mark long, pivot int, dist double")
    groups = max(8, -(-n // GROUP_ROWS))
    ranged = assigned.repartitionByRange(groups, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    index = cut(ranged.mapInArrow(_seed(shared, every, k, GROUP_ROWS), "vec_id long, v binary, norm2 double, mark long, pivot int, dist double, tau long, g int, ring int"), "topk-index")
    # At most a row per group and one more per pivot: some 30 bytes for 4096 vectors.
    spans = index.groupBy("g", "pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high")).collect()
    annuli = spark.sparkContext.broadcast((
        np.array([r["g"] for r in spans]), np.array([r["pivot"] for r in spans]),
        np.array([r["low"] for r in spans]) - 1e-9, np.array([r["high"] for r in spans]) + 1e-9,
    ))
    asks = index.where(F.col("vec_id") % every == 0).select("vec_id", "v", "norm2", "mark", "tau")
    visits = asks.mapInArrow(_visit(shared, annuli), "g int, vec_id long, v binary, norm2 double, mark long, tau long")
    none = {"pivot": F.lit(None).cast("int"), "dist": F.lit(None).cast("double"), "ring": F.lit(None).cast("int")}
    both = index.withColumn("side", F.lit(0)).unionByName(visits.withColumns(none).withColumn("side", F.lit(1)))
    both = both.repartition("g").sortWithinPartitions("g", "side", "pivot", "dist")
    return both.mapInArrow(_search(shared, k), "mark long, query_id long, vec_id long, score long, visited long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest integer inner products, ties to smaller vec_id.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's own: rows that repeat an
    id ask each and are candidates of each other. Rows with a null id, a null vector, or null or non-finite components (also
    if only 256 times as large) take no part; a shorter vector counts as ending in zeros. Scores are exact; beyond a long
    they are held at its ends. Fewer than k candidates: all of them. An empty table gives an empty result.
    """
    found = _found(vectors, k, every, id_col, vector_col)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("mark").orderBy(F.desc("score"), "vec_id"))
    return found.where("mark IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def visited_share(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Scored pairs as a share of all pairs of queries and rows: what the index leaves of the work."""
    found = _found(vectors, k, every, id_col, vector_col)
    if found is None:
        return 0.0
    ids = vectors.select(F.col(id_col).cast("long").alias("i")).where("i IS NOT NULL")
    n, asks = ids.agg(F.count(F.lit(1)), F.count_if(F.col("i") % every == 0)).first()
    return (found.agg(F.sum("visited")).first()[0] or 0) / max(n * asks, 1)


#: DuckDB's version: all pairs.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
