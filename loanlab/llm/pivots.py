"""Exact top-k search by inner product with pivot-table elimination.

Vectors are turned into integers, floor(scale * x). For integer vectors
q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, so a lower bound on the distance
|q - x| is an upper bound on the score. The pivot table holds, for every row,
its distances to ``PIVOTS`` pivots; max_p |d(q, p) - d(x, p)| is the bound
(triangle inequality). For each query a task evaluates its rows in the order
of their bounds, in slices, and stops as soon as the k-th best exact score is
above every bound that is left (ties go on: a smaller id may win). Scores are
exact 64-bit integers; bounds are widened by a relative margin for rounding.

Scale: the rows stay in place, in the written pivot table; queries come in
blocks of about ``QUERY_BLOCK`` (a block's size does not depend on the data),
each sent to the tasks that scan the rows. A task returns k rows a query, and
a window by query merges them. The pivots are ``PIVOTS`` rows chosen by hash.

Defined results: rows whose id or vector is null, whose vector is empty, holds a null or a
non-finite component, or has another length than the most frequent one (ties:
the shorter) take no part; a query has as many rows as there are candidates, up to k; rows that
repeat an id are candidates each, except for the query's own id; query rows that share an
id but not the vector have k rows each, query rows equal in both are one; extra
columns are ignored; empty tables give an empty result. Where components are so large
that a score or squared distance could leave 64 bits, an ArithmeticError says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded_batches, stored

PIVOTS = 24
QUERY_BLOCK = 2048
SLICE = 256
SCALE = 1024


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)))
    # what lies beyond is held there, and refused by top_k()
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(F.least(F.greatest(
        x * float(scale), F.lit(-2.0 ** 40)), F.lit(2.0 ** 40))).cast("long")).alias("v"))


def _with_pivots(pivots):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            x = np.array(batch.column("v").to_pylist(), np.int64).reshape(batch.num_rows, -1)
            if not len(x):
                continue
            d = np.sqrt(((x[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2).astype(np.float64))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "v": batch.column("v"),
                "square": pa.array((x * x).sum(axis=1), pa.int64()),
                "distances": pa.array(list(d), pa.list_(pa.float64()))})
    return run


def pivot_table(rows: DataFrame, n_pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, v, square, distances), written to the shared folder."""
    import numpy as np
    bounded_batches(rows.sparkSession)
    order = F.xxhash64("vec_id", F.lit("pivot"))
    chosen = [r.v for r in rows.orderBy(order, "v").limit(n_pivots).collect()]
    pivots = np.array(chosen, np.int64)
    return stored(rows.mapInArrow(_with_pivots(pivots), "vec_id long, v array<long>, square long, distances array<double>"),
                  "pivots")


def best_of_block(q_id, q, q_square, q_dist, ids, x, squares, dist, k: int, before=None):
    """Top k of the rows, and of ``before`` (ids, scores), for one query: (ids, scores, rows evaluated)."""
    import numpy as np
    low = np.abs(dist - q_dist[None, :]).max(axis=1) * (1 - 1e-9) - 1e-6
    bound = (q_square + squares - np.square(np.maximum(low, 0))) / 2 + 1e-3
    bound[ids == q_id] = -np.inf
    order = np.argsort(-bound, kind="stable")
    order = order[:np.searchsorted(-bound[order], np.inf)]  # without the query's own rows
    best_id, best = before or (np.empty(0, np.int64), np.empty(0, np.int64))
    seen = 0
    while seen < len(order):
        if len(best) >= k and best[k - 1] > bound[order[seen]]:
            break
        part = order[seen:seen + SLICE]
        seen += len(part)
        best_id, best = np.concatenate([best_id, ids[part]]), np.concatenate([best, x[part] @ q])
        top = np.lexsort((best_id, -best))[:k]
        best_id, best = best_id[top], best[top]
    return best_id, best, seen


def _searcher(queries_b, k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        q_ids, q, q_squares, q_dists = queries_b.value
        kept: list = [None] * len(q_ids)  # per query the best of this task so far

        def block(ids, x, squares, dist):
            for i in range(len(q_ids)):
                kept[i] = best_of_block(q_ids[i], q[i], q_squares[i], q_dists[i], ids, x, squares, dist, k, kept[i])[:2]
        parts: list = []

        def flush():
            if parts:
                block(*[np.concatenate([p[j] for p in parts]) for j in range(4)])
                parts.clear()
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            parts.append((batch.column("vec_id").to_numpy(),
                          batch.column("v").values.to_numpy().reshape(n, -1),
                          batch.column("square").to_numpy(),
                          batch.column("distances").values.to_numpy().reshape(n, -1)))
            if sum(len(p[0]) for p in parts) >= 8192:
                flush()
        flush()
        for i, (a, s) in ((i, best) for i, best in enumerate(kept) if best):
            yield pa.RecordBatch.from_pydict({"query": pa.array(np.full(len(a), i), pa.int64()), "query_id": pa.array(np.full(len(a), q_ids[i]), pa.int64()),
                                              "vec_id": pa.array(a, pa.int64()), "score": pa.array(s, pa.int64())})
    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows for every row that
    ``is_query`` (a condition on vec_id) selects; the query's id is no candidate."""
    import numpy as np
    spark = vectors.sparkSession
    schema = "query long, query_id long, vec_id long, score long"
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.where(F.size("v") == lengths[0].n)
    largest = rows.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
    if 4 * lengths[0].n * largest * largest >= 1 << 63:  # the squared distance of two rows, at most
        raise ArithmeticError(f"components of up to {largest} after scaling leave the exact 64-bit range of scores")
    table = pivot_table(rows)
    queries = table.where(is_query).dropDuplicates(["vec_id", "v"])
    n_blocks = max(1, -(-queries.count() // query_block))
    found = None
    for b in range(n_blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).collect()
        if not own:
            continue
        value = (np.array([r.vec_id for r in own], np.int64), np.array([r.v for r in own], np.int64),
                 np.array([r.square for r in own], np.int64), np.array([r.distances for r in own], np.float64))
        part = table.mapInArrow(_searcher(spark.sparkContext.broadcast(value), k), schema).withColumn("block", F.lit(b))
        part = stored(part, "top-k") if n_blocks > 1 else part
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    w = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v),
        lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
