"""Reproducible splitting by hashed row identity.

The position of a row in the "shuffled" order is ``md5('<id>:<seed>')``,
which does not depend on partitioning, task order or retries (unlike
``rand()``/``randomSplit``), so splits and folds survive executor loss and
re-execution unchanged.

Exact ranks without a single-task window: rows are grouped by the first hex
digits of their hash (up to 16^5 buckets, in hash order), bucket sizes are
counted (a small table), exclusive offsets are taken over that small table,
and the rank inside a bucket comes from a window partitioned by bucket. A
label holding a third of all rows is therefore still spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ._util import join_small


def hash_key(id_col: str = "id", seed: int = 0):
    """The row's position key: md5 hex of '<id>:<seed>'."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def hex_bound(p: float, digits: int = 8) -> str:
    """Hex prefix bound: ``substr(md5, 1, digits) < bound`` holds for a share p."""
    top = 16 ** digits
    v = min(top, max(0, math.ceil(p * top)))
    return "g" * digits if v >= top else format(v, f"0{digits}x")


def hash_fraction_filter(id_col: str, seed: int, p: float):
    """Predicate true for a deterministic share ``p`` of ids."""
    return F.substring(hash_key(id_col, seed), 1, 8) < F.lit(hex_bound(p))


def bernoulli_sample(df: DataFrame, p: float, seed: int = 0, id_col: str = "id") -> DataFrame:
    """FLT-7: independent row sample with probability p, reproducible across
    partitionings (hash of the id, not a random stream)."""
    return df.filter(hash_fraction_filter(id_col, seed, p))


def prefix_for(n: int, rows_per_bucket: int = 1_000_000) -> int:
    """Hex digits of the hash prefix so that a bucket holds about
    ``rows_per_bucket`` rows (16^digits buckets, 1..5 digits)."""
    buckets = max(1, math.ceil(n / rows_per_bucket))
    return max(1, min(5, math.ceil(math.log(buckets, 16)) if buckets > 1 else 1))


def hash_rank(df: DataFrame, id_col: str = "id", seed: int = 0, partition: list | None = None,
              prefix: int | None = None, out: str = "rank", n: int | None = None) -> DataFrame:
    """WIN-3: exact 1-based rank of each row in (partition..., hash, id) order.

    Equivalent to ``row_number() over (partition by ... order by md5, id)``
    but computed with hash-prefix buckets and offsets (see module doc). The
    prefix length grows with the row count (about a million rows per window
    task); pass ``n`` when it is known to save a count. Every row gets a rank:
    a NULL partition value is a partition, rows without id come first in it.
    """
    part = list(partition or [])
    if prefix is None:
        prefix = prefix_for(n if n is not None else df.count())
    h = hash_key(id_col, seed)
    t = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, prefix))
    sizes = t.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wo = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0))).drop("_n")
    # 16^prefix rows per partition value: broadcast only after a size check
    joined = join_small(t, offs, part + ["_b"], "inner", max_rows=2_000_000)
    w = Window.partitionBy(*part, "_b").orderBy("_h", id_col)
    return joined.withColumn(out, F.col("_off") + F.row_number().over(w)).drop("_h", "_b", "_off")


def train_test_split(df: DataFrame, test_size: float = 0.3, seed: int = 123,
                     id_col: str = "id", exact: bool = True, out: str = "is_test") -> DataFrame:
    """VAL-1: flag the test rows.

    exact=True: test = the first ceil(test_size * n) rows in hash order
    (exact size, like the reference's split). exact=False: a row is test when
    its hash falls below the share (fully parallel, size within sampling
    error).
    """
    if not exact:
        return df.withColumn(out, hash_fraction_filter(id_col, seed, test_size))
    first = first_by_hash(df, lambda n: math.ceil(n * float(test_size)), id_col, seed)
    if first is not None:
        return df.withColumn(out, first)
    # the border lies between rows of one id (or without one): only a rank tells them apart
    n = df.count()
    ranked = hash_rank(df, id_col, seed, out="_r", n=n)
    return ranked.withColumn(out, F.col("_r") <= F.lit(math.ceil(n * float(test_size)))).drop("_r")


PREFIX = 4  # hex digits a level: 65,536 counts
AT_ONCE = 10_000  # rows whose keys are looked at directly


def first_by_hash(df: DataFrame, wanted, id_col: str = "id", seed: int = 0):
    """A condition that holds for exactly the first ``wanted(n)`` of the n rows in (hash, id) order
    (rows without an id first), or None if rows of one id lie on both sides of the border.

    Selection without sorting or moving rows: rows are counted by the first digits of their
    hash, the prefix in which the border lies is counted by the next digits, and so on until
    at most ``AT_ONCE`` rows are left, whose keys are looked at; the border is then a literal.
    """
    h = hash_key(id_col, seed)
    keys = df.select(h.alias("h"), F.col(id_col).alias("i"))
    counts = dict(keys.groupBy(F.substring("h", 1, PREFIX).alias("p")).count().collect())
    want, before, prefix = wanted(sum(counts.values())), counts.pop(None, 0), ""
    if want <= 0:
        return F.lit(False)
    if want < before:
        return None
    while True:
        for prefix in sorted(counts):
            if before + counts[prefix] >= want:
                break
            before += counts[prefix]
        else:
            return F.lit(True) if counts or want >= before else None
        if counts[prefix] <= AT_ONCE or len(prefix) >= 32:
            break
        inside = keys.where(F.col("h").startswith(prefix))
        counts = dict(inside.groupBy(F.substring("h", 1, len(prefix) + PREFIX)).count().collect())
    inside = keys.where(F.col("h").startswith(prefix))
    if len(prefix) >= 32 and counts[prefix] > AT_ONCE:  # rows of one hash: count them by id
        rows = [(r.h, r.i, r["count"]) for r in inside.groupBy("h", "i").count().orderBy("h", "i").collect()]
    else:
        rows = [(r.h, r.i, 1) for r in inside.collect()]
    if want == before:
        return h.isNull() | (h < F.lit(prefix))
    total: dict = {}
    for k, i, n in rows:
        total[(k, i)] = total.get((k, i), 0) + n
    for k, i in sorted(total):
        before += total[(k, i)]
        if before >= want:
            if before > want:
                return None
            return h.isNull() | (h < F.lit(k)) | ((h == F.lit(k)) & (F.col(id_col) <= F.lit(i)))


def k_fold(df: DataFrame, k: int = 10, seed: int = 0, id_col: str = "id",
           out: str = "fold") -> DataFrame:
    """VAL-2: fold = (rank in hash order - 1) mod k; fold sizes differ by at
    most one."""
    return (hash_rank(df, id_col, seed, out="_r")
            .withColumn(out, ((F.col("_r") - 1) % k).cast("int")).drop("_r"))


def stratified_k_fold(df: DataFrame, label: str, k: int = 3, seed: int = 234,
                      id_col: str = "id", out: str = "fold") -> DataFrame:
    """VAL-3: folds that keep each class's share: (rank within class - 1) mod k."""
    return (hash_rank(df, id_col, seed, partition=[label], out="_r")
            .withColumn(out, ((F.col("_r") - 1) % k).cast("int")).drop("_r"))


def slice_first(df: DataFrame, n: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    """FLT-8: the first n rows in hash order (a deterministic subset for an
    expensive learner). A top-n: Spark plans TakeOrderedAndProject, keeping
    n rows per task."""
    return df.orderBy(hash_key(id_col, seed), F.col(id_col)).limit(n)


def hash_share(id_col: str = "id", seed: int = 0):
    """The row's hash position as a number in [0, 1) (first 32 bits)."""
    return (F.conv(F.substring(hash_key(id_col, seed), 1, 8), 16, 10).cast("double")
            / F.lit(16.0 ** 8))
