"""Embedding whitening by a bidiagonal qd solver.

Vectors are turned into integers (floor(scale * x) + shift), so that the mean
is exact. Every task reduces its centred rows block by block with QR to one
triangular factor; the factors are merged ``FAN`` at a time, in rounds, until
one is left, which has the covariance of all rows: V = R'R / n. Only this
d x d factor reaches the driver. ``bidiagonal.right_singular`` takes it apart:
Householder bidiagonalisation, dqds for the singular values, twisted
factorisations for the directions. The covariance of the whitened rows is then
measured over all rows, centred before multiplying, in the same rounds.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries take no part, nor do vectors of another length than the most frequent
one (ties: the shorter), for which no covariance exists; a null id stays null;
repeated rows are rows each; extra columns are ignored; components whose
eigenvalue is zero to rounding (constant or dependent dimensions, fewer rows
than components) cannot be whitened and are left out; an empty table, or one
of equal rows only, gives an empty result. Sums are exact; where a row's
``deviation`` could pass 64 bits, an ArithmeticError says so.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import stored

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
FAN = 16
BLOCK_ROWS = 2048
LARGEST = 1 << 40
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


@dataclass
class Whitening:
    n: int
    sums: list            # of x by dimension, exact
    directions: object    # d x k, unit columns
    values: object        # eigenvalues of the k components
    explained: object     # their shares of the trace
    identity_error: float = field(default=0.0)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE,
           shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): integer vectors of the rows that take part, written to the shared folder."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)))
    # what lies beyond LARGEST is held there, and refused by measured()
    whole = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * float(scale), F.lit(-2.0 * LARGEST)),
                                                       F.lit(2.0 * LARGEST))).cast("long") + F.lit(shift))
    return stored(rows.select("vec_id", whole.alias("x")), "whiten-rows")


def _matrix(batch, column: str = "x"):
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def measured(rows: DataFrame) -> tuple[int, list]:
    """(n, sums by dimension), exact."""
    each = (rows.select(F.posexplode("x").alias("pos", "c")).groupBy("pos")
            .agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s"),
                 F.min("c").alias("low"), F.max("c").alias("high")).orderBy("pos").collect())
    n = each[0].n
    sums = [int(r.s) for r in each]
    spread = [max(abs(n * r.low - s), abs(n * r.high - s)) for r, s in zip(each, sums, strict=True)]
    if any(max(abs(r.low), abs(r.high)) > LARGEST or n * max(abs(r.low), abs(r.high)) >= 1 << 62 for r in each) or \
            sum(v * v for v in spread) >= 1 << 63:
        raise ArithmeticError("entries this large over this many rows leave the exact 64-bit range of deviation")
    return n, sums


def _merged(parts: DataFrame, merge) -> bytes | None:
    """One value of (part, value): ``merge`` of ``FAN`` values at a time, in rounds."""
    def together(key, table):
        import pyarrow as pa
        rows = sorted(zip(table.column("part").to_pylist(), table.column("value").to_pylist(), strict=True))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()),
                         "value": pa.array([merge([v for _, v in rows])], pa.binary())})
    parts = stored(parts, "whiten-parts")
    while parts.count() > 1:
        # neighbours by part number meet: FAN of them at most
        parts = stored(parts.groupBy(F.floor(F.col("part") / FAN).cast("long").alias("to"))
                       .applyInArrow(together, "part long, value binary"), "whiten-parts")
    row = parts.first()
    return bytes(row.value) if row else None


def _factors(n: int, sums: list):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        total, r, held, size = np.array(sums, np.int64), None, [], 0

        def reduce():
            nonlocal r, held, size
            block = np.vstack([*([] if r is None else [r]), *held])
            r, held, size = np.linalg.qr(block, mode="r"), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((n * _matrix(batch) - total) / n)
                size += batch.num_rows
                if size >= BLOCK_ROWS:
                    reduce()
        if held:
            reduce()
        if r is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              "value": pa.array([r.tobytes()], pa.binary())})
    return run


def triangular_factor(rows: DataFrame, n: int, sums: list):
    """R (at most d x d, numpy) with R'R = the centred rows' scatter matrix."""
    import numpy as np
    d = len(sums)

    def merge(values):
        return np.linalg.qr(np.vstack([np.frombuffer(v).reshape(-1, d) for v in values]), mode="r").tobytes()
    return np.frombuffer(_merged(rows.select("x").mapInArrow(_factors(n, sums), "part long, value binary"), merge)
                         ).reshape(-1, d)


def _project(batch, n: int, total, turn):
    return ((n * _matrix(batch) - total) / n) @ turn


def _moments(n: int, sums: list, turn):
    """Per task: rows, mean and centred scatter of the whitened rows."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        total, state = np.array(sums, np.int64), None
        for batch in batches:
            if batch.num_rows:
                z = _project(batch, n, total, turn)
                mean = z.mean(axis=0)
                one = (float(len(z)), mean, (z - mean).T @ (z - mean))
                state = one if state is None else _joint(state, one)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              "value": pa.array([_packed(state)], pa.binary())})
    return run


def _joint(a, b):
    import numpy as np
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def _packed(state) -> bytes:
    import numpy as np
    return np.concatenate([[state[0]], state[1], state[2].ravel()]).tobytes()


def identity_error(rows: DataFrame, n: int, sums: list, turn) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    from functools import reduce

    import numpy as np
    k = turn.shape[1]

    def unpacked(v):
        flat = np.frombuffer(v)
        return flat[0], flat[1:1 + k], flat[1 + k:].reshape(k, k)

    def merge(values):
        return _packed(reduce(_joint, map(unpacked, values)))
    state = unpacked(_merged(rows.select("x").mapInArrow(_moments(n, sums, turn), "part long, value binary"), merge))
    return float(np.abs(state[2] / state[0] - np.eye(k)).max())


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of integer rows (``usable``, of one length); None without a component."""
    import numpy as np

    from .bidiagonal import right_singular
    n, sums = measured(rows)
    r = triangular_factor(rows, n, sums)
    square = np.zeros((len(sums), len(sums)))
    square[:len(r)] = r
    squares, directions = right_singular(square, components)
    k = directions.shape[1]
    if not k:
        return None
    model = Whitening(n, sums, directions, squares[:k] / n, squares[:k] / squares.sum())
    model.identity_error = identity_error(rows, n, sums, directions / np.sqrt(model.values))
    return model


def _transformer(model: Whitening):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        total, k = np.array(model.sums, np.int64), len(model.values)
        turn = model.directions / np.sqrt(model.values)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            away = model.n * _matrix(batch) - total
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                "n": pa.array(np.full(rows * k, model.n, np.int64)),
                "deviation": pa.array(np.repeat((away * away).sum(axis=1), k)),
                "whitened": pa.array(((away / model.n) @ turn).ravel()),
                "explained": pa.array(np.tile(np.asarray(model.explained, np.float64), rows)),
                "identity_error": pa.array(np.full(rows * k, model.identity_error))})
    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for
    every usable vector and each of its first ``components`` principal components."""
    spark: SparkSession = vectors.sparkSession
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], SCHEMA)
    rows = rows.where(F.size("x") == lengths[0].d)
    model = fit(rows, components)
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    return rows.mapInArrow(_transformer(model), SCHEMA)
