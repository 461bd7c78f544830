"""Forests grown jointly: all trees of all fits in the same passes (MOD-1, MOD-2, VAL-4 to VAL-8).

Features are binned once into a table of small byte vectors; a row's
multiplicity in the bootstrap sample of tree t is a Poisson(1) number drawn from
a hash of its id and t, so it needs no storage and is the same on every run. A
plan of fits (``Fit``: which rows, how many trees) numbers its trees through,
and one growth makes them all:

* a node of more than ``LOCAL_ROWS`` rows (or ``LOCAL_BYTES`` of bins) is split in a distributed pass: tasks
  sum class weights by (tree, node, feature, bin) for all such nodes at once,
  and Spark picks each node's best split from the cumulative sums;
* the rows of a smaller node go to one task, which grows what is below it. Such
  a group has at most ``LOCAL_ROWS`` rows, whatever the table holds.

Which features a node may use is a hash of its tree and place, so both ways
make the same trees, and a forest that is cut at fewer trees or less depth is
the forest that would have been grown so (``score(trees=..., max_depth=...)``):
one growth answers a grid over both. A node of fewer than ``min_split`` rows
is a leaf. Models are tables of nodes in the shared folder. Only one of at most
``NODES_SENT`` nodes passes through the driver to be scored with; the rows for a
larger one are led down its topmost nodes to the task that has the nodes below
(``_shares``), so that neither the driver nor a task holds a whole model.
"""

from __future__ import annotations

import math
import sys
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import scratch_path

# task functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOCAL_ROWS = 400_000
LOCAL_BYTES = 32 << 20
NODES_SENT = 50_000
BIN_SAMPLE = 20_000
TASK_ROWS = 1 << 15
FILE_ROWS = 400_000
CHUNK_BITS = 14
CELLS_A_PASS = 2_000_000
BLOCK_NODES = 64
ROUND_BYTES = 6 << 30
ROUND_ROW = 400
# below: the two parts' sums of (squared class weights / weight); root: the topmost node of the part
# that one task has grown, -1 for the nodes above those
NODE = "tree int, node long, depth int, feature int, bin int, rows long, counts array<double>, below double, root long"


@dataclass
class Fit:
    """One forest: ``trees`` trees over the rows that ``rows`` (a condition) selects."""
    name: str
    trees: int
    rows: Column | None = None


@dataclass
class Forest:
    """Fitted trees: ``nodes`` (``NODE``), the bins' upper bounds by feature, the fits by name
    -> (first tree, trees)."""
    nodes: DataFrame
    bounds: list
    classes: int
    seed: int
    fits: dict = field(default_factory=dict)


# ------------------------------------------------------------------- numbers
def _mixed(x):
    """splitmix64 of unsigned 64-bit numbers."""
    import numpy as np
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def poisson_cdf() -> list:
    """Cumulative Poisson(1) probabilities up to where doubles reach 1."""
    out, acc, term, k = [], 0.0, math.exp(-1.0), 0
    while acc + term > acc:
        acc += term
        out.append(acc)
        k += 1
        term /= k
    return out


def multiplicity(keys, tree: int, seed: int):
    """How often the rows of ``keys`` (64-bit hashes of ids) are in the sample of ``tree``."""
    import numpy as np
    salt = _mixed(np.array([(seed << 32) + tree], np.uint64))
    u = _mixed(keys.view(np.uint64) ^ salt) >> np.uint64(11)
    times, most = np.zeros(len(u), np.uint8), int(u.max(initial=0))
    for share in poisson_cdf():  # u / 2**53 against the shares, in whole numbers
        least = math.ceil(share * (1 << 53))
        if least > most:
            break
        times += u >= np.uint64(least)
    return times


def _orders(tree: int, nodes, seed: int, p: int, first: int = 1 << 30):
    """The nodes' own orders of all features, a row each; the ``first`` of them."""
    import numpy as np
    base = _mixed(_mixed(np.array([(seed << 32) + tree], np.uint64)) ^ nodes.astype(np.uint64))
    place = np.arange(p, dtype=np.uint64)
    low = np.uint64((1 << p.bit_length()) - 1)
    mixed = (_mixed(base[:, None] + place) & ~low) | place
    if first < p:
        mixed = np.partition(mixed, first, axis=1)[:, :first]
    return (np.sort(mixed, axis=1) & low).astype(np.int64)


def _order(tree: int, node: int, seed: int, p: int):
    """The node's own order of all features."""
    import numpy as np
    return _orders(tree, np.array([node], np.uint64), seed, p)[0]


# ---------------------------------------------------------------- the table
def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"forest-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _spread(rows: DataFrame, n: int = 0) -> DataFrame:
    """The rows (``n`` of them, if known) dealt evenly: the tables here are small in bytes next to the work
    on them, so that partitions or files of the usual size would be too few."""
    return rows.repartition(max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // FILE_ROWS)))


def feature_bounds(df: DataFrame, features: str = "features", max_bins: int = 64, seed: int = 0, id_col: str = "id",
                   sample: int = BIN_SAMPLE, middle: bool = False) -> list:
    """Upper bounds of the bins of every feature, from about ``sample`` rows chosen by hash: all
    values but the largest where there are at most ``max_bins``, else quantiles. With ``middle``
    a bound lies half way to the next value."""
    share = min(1.0, sample / max(1, df.count()))
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    values = df.where(u < share).select(F.posexplode(vector_to_array(features)).alias("f", "v"))
    cuts = F.percentile_approx("v", [i / max_bins for i in range(1, max_bins)] + [1.0], 10_000)
    values = values.groupBy("f").agg(F.collect_set("v").alias("s"), cuts.alias("q"))
    bounds = F.when(F.size("s") <= max_bins, F.array_sort("s")).otherwise(F.array_sort(F.array_distinct("q")))
    rows = values.select("f", bounds.alias("b")).orderBy("f").collect()  # a row a feature, max_bins numbers each
    if middle:
        return [[(a + b) / 2 for a, b in zip(r.b, r.b[1:], strict=False)] for r in rows]
    return [list(r.b[:-1]) for r in rows]


def binned(df: DataFrame, bounds: list, label: str = "label", features: str = "features", weight: str | None = None,
           id_col: str = "id", keep=()) -> DataFrame:
    """(id, key, y, w, bins, *keep): ``bins`` a byte a feature."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        cuts = [np.array(b) for b in bounds]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(n, -1)
            out = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)
            cols = {c: batch.column(c) for c in batch.schema.names if c != "x"}
            yield pa.RecordBatch.from_pydict({**cols, "bins": pa.array([r.tobytes() for r in out], pa.binary())})
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(id_col), F.xxhash64(id_col).alias("key"), F.col(label).cast("int").alias("y"), w.alias("w"),
                     *keep, vector_to_array(features).alias("x"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("x").schema)
    return rows.mapInArrow(run, schema + ", bins binary")


BLOCK_BYTES = 1 << 18
BATCH_BLOCKS = 32


def blocks(rows: DataFrame, p: int, keep=()) -> DataFrame:
    """The row table with some ``BLOCK_BYTES`` of rows of one task in a record: n, their y, w, columns of
    ``keep`` (8 bytes a value) and ``bins``, feature by feature. A pass then moves and compares whole
    columns of bytes instead of rows."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        size = max(64, BLOCK_BYTES // (p + 16))
        for batch in _buffered(batches):
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, p).T
            cols = {c: batch.column(c).to_numpy() for c in ("y", "w", *keep)}
            for at in range(0, batch.num_rows, size):
                own = slice(at, min(at + size, batch.num_rows))
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([own.stop - at], pa.int64()), **{c: pa.array([v[own].tobytes()], pa.binary()) for c, v in cols.items()},
                    "bins": pa.array([bins[:, own].tobytes()], pa.binary())})
    return rows.select("y", "w", *keep, "bins").mapInArrow(run, "n long, " + "".join(f"{c} binary, " for c in ("y", "w", *keep)) + "bins binary")


def chunks_of(batches, p: int, keep=()):
    """Some ``BATCH_BLOCKS`` blocks at a time: (records, n, {column: values}, bins p x n)."""
    import numpy as np
    kinds = {"y": np.int32, "w": np.float64, **dict.fromkeys(keep, np.float64)}
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_BLOCKS):
            part = batch.slice(at, BATCH_BLOCKS)
            n = part.column("n").to_pylist()
            cols = {c: np.frombuffer(b"".join(part.column(c).to_pylist()), kind) for c, kind in kinds.items()}
            bins = np.concatenate([np.frombuffer(b, np.uint8).reshape(p, k) for b, k in zip(part.column("bins").to_pylist(), n, strict=True)],
                                  axis=1)
            yield part, n, cols, bins


class small_batches:
    """Few records a batch for Python while blocks are read."""

    def __init__(self, spark):
        self.conf, self.name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __enter__(self):
        self.before = self.conf.get(self.name)
        self.conf.set(self.name, str(2 * BATCH_BLOCKS))

    def __exit__(self, *_):
        self.conf.set(self.name, self.before)


class Histogram:
    """Sums of weights by (node, feature, bin). A feature of two bins is added up over its second bin
    alone, the first being the rest of the node: indicators are mostly 0."""

    def __init__(self, bounds: list, n_bins: int):
        import numpy as np
        two = np.array([len(b) == 1 for b in bounds], bool)
        self.two, self.more = np.flatnonzero(two), np.flatnonzero(~two)
        self.p, self.n_bins = len(bounds), n_bins

    def add(self, slot, nodes: int, bins, values: list):
        """nodes x len(values) x p x n_bins: ``slot`` is a row's node from 0; rows of slot ``nodes`` do not count."""
        import numpy as np
        out = np.zeros((nodes, len(values), self.p, self.n_bins))
        base = slot * self.n_bins
        for f in self.more:
            at = base + bins[f]
            for i, v in enumerate(values):
                out[:, i, f] = np.bincount(at, v, (nodes + 1) * self.n_bins)[:nodes * self.n_bins].reshape(nodes, self.n_bins)
        if len(self.two):
            m = len(self.two)
            kind, row = np.nonzero(bins[self.two].view(bool))
            at = slot[row] * m + kind
            for i, v in enumerate(values):
                second = np.bincount(at, v[row], (nodes + 1) * m)[:nodes * m].reshape(nodes, m)
                whole = np.bincount(slot, v, nodes + 1)[:nodes, None]
                first = whole - second
                first[np.abs(first) <= 1e-13 * np.abs(whole)] = 0.0  # what rounding leaves of an empty bin
                out[:, i, self.two, 0], out[:, i, self.two, 1] = first, second
        return out


def matrix(x):
    """Rows of an Arrow array of number lists as an n x p matrix; what is missing is NaN."""
    import numpy as np
    sizes = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, p = x.flatten().to_numpy(zero_copy_only=False), int(sizes.max(initial=0))
    if (sizes == p).all():
        return flat.reshape(len(x), p)
    out = np.full((len(x), p), np.nan)
    out[np.arange(p) < sizes[:, None]] = flat
    return out


def _rows_of(batch):
    """(bins n x p, key, y, w, fits n x k) of a batch of the row table."""
    import numpy as np
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, -1)
    fits = batch.column("fits").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return bins, batch.column("key").to_numpy(), batch.column("y").to_numpy(), batch.column("w").to_numpy(), fits


def _buffered(batches, rows: int = TASK_ROWS):
    """The batches put together to some ``rows`` rows, empty ones left out."""
    import pyarrow as pa
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pieces(data, starts):
    """Binary values: the rows of ``data`` from each of ``starts`` to the next."""
    import numpy as np
    import pyarrow as pa
    data = np.ascontiguousarray(data)
    width = data.dtype.itemsize * int(np.prod(data.shape[1:], dtype=np.int64))
    offsets = (np.append(starts, len(data)) * width).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


class Pack:
    """Rows of bins in fewer bytes: a bit for a feature of at most two bins, a byte for any other."""

    def __init__(self, bounds: list):
        import numpy as np
        self.sizes = np.array([len(b) + 1 for b in bounds], np.int64)
        self.p, self.narrow, self.wide = len(bounds), np.flatnonzero(self.sizes <= 2), np.flatnonzero(self.sizes > 2)
        self.width = len(self.wide) + -(-len(self.narrow) // 8)

    def packed(self, bins):
        """n x p bins as n x width bytes."""
        import numpy as np
        return np.concatenate([bins[:, self.wide], np.packbits(bins[:, self.narrow], axis=1)], axis=1)

    def columns(self, packed):
        """The bins again, p x n: feature by feature."""
        import numpy as np
        out = np.empty((self.p, len(packed)), np.uint8)
        out[self.wide] = packed[:, :len(self.wide)].T
        out[self.narrow] = np.unpackbits(packed[:, len(self.wide):], axis=1, count=len(self.narrow)).T
        return out


RECORD = {"key": "int64", "y": "int32", "w": "float64", "fits": "bool", "bins": "uint8"}


def _records(rows: DataFrame, pack: Pack) -> DataFrame:
    """The row table (of ``binned``, with ``fits``) with some ``TASK_ROWS`` rows of one task in a record."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in _buffered(batches):
            bins, key, y, w, fits = _rows_of(batch)
            cols = {"key": key, "y": y, "w": w, "fits": np.ascontiguousarray(fits.T), "bins": pack.packed(bins)}
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(key)], pa.int64()), **{
                c: pa.array([np.ascontiguousarray(v, RECORD[c]).tobytes()], pa.binary()) for c, v in cols.items()}})
    return rows.select("key", "y", "w", "fits", "bins").mapInArrow(run, "n long, " + ", ".join(f"{c} binary" for c in RECORD))


def _read(batches):
    """Record by record: (n, key, y, w, fits (fit by fit), packed bins)."""
    import numpy as np
    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column("n")[i].as_py()
            key, y, w, fits, bins = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in RECORD.items())
            yield n, key, y, w, fits.reshape(-1, n), bins.reshape(n, -1)


class _few_records:
    """Few records a batch for Python, and files dealt to all cores, while records are read."""
    CONF = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

    def __init__(self, spark):
        self.conf = spark.conf
        self.new = {**self.CONF, "spark.sql.files.minPartitionNum": str(4 * spark.sparkContext.defaultParallelism)}

    def __enter__(self):
        self.before = {name: self.conf.get(name, None) for name in self.new}
        for name, value in self.new.items():
            self.conf.set(name, value)

    def __exit__(self, *_):
        for name, value in self.before.items():
            if value is None:
                self.conf.unset(name)
            else:
                self.conf.set(name, value)


def _led(tree, flat, n: int, rows, start: int = 0):
    """Places of the ends that ``rows`` come to from one place; ``tree``: feature, cut, child by place; ``flat``: bins, p x n in one."""
    import numpy as np
    feature, cut, child = tree
    at, go, here = np.empty(len(rows), np.int64), np.arange(len(rows)), np.full(len(rows), start)
    first, end = feature * n, feature < 0
    while len(go):
        over = end[here]
        if over.any():
            at[go[over]] = here[over]
            on = ~over
            go, here, rows = go[on], here[on], rows[on]
        here = child[2 * here + (flat[first[here] + rows] > cut[here])]
    return at


def _paths(splits: list, ends: dict) -> dict:
    """For ``_Walk``, the inner nodes (tree, node, feature, cut) of the trees of ``ends`` ({tree: nodes}), and those ends."""
    import numpy as np
    by: dict = {tree: [(node, -1, -1) for node in own] for tree, own in ends.items()}
    for tree, node, feature, cut in splits:
        if tree in by:
            by[tree].append((node, feature, cut))
    of = {}
    for tree, own in by.items():
        nodes, feature, cut = np.array(sorted(own), np.int64).reshape(-1, 3).T
        below = 2 * nodes[:, None] + np.array([1, 2])
        place = np.minimum(np.searchsorted(nodes, below), len(nodes) - 1)
        child = np.where(nodes[place] == below, place, len(nodes))
        of[tree] = (nodes, np.append(feature, -1), np.append(cut, -1), np.append(child.ravel(), [0, 0]))
    return of


class _Walk:
    """Leads rows down trees. Of a tree are held (``of``) the nodes, rising, and by place in them the feature (-1
    for an end), the cut and the places of both children; the place after the last stands for all else."""

    def __init__(self, of: dict):
        self.of = of

    def ends(self, tree: int):
        """(places, nodes) of the ends."""
        import numpy as np
        nodes, feature, _, _ = self.of[tree]
        at = np.flatnonzero(feature[:-1] < 0)
        return at, nodes[at]

    def down(self, tree: int, flat, n: int, rows):
        """The place that each of ``rows`` comes to; ``flat``: bins, p x n in one."""
        nodes, *tree_ = self.of[tree]
        return _led(tree_, flat, n, rows, 0 if len(nodes) and not nodes[0] else len(nodes))


def _samples(record, trees: list, seed: int):
    """(tree, rows, their multiplicities) for the trees of a plan that see rows of the record."""
    import numpy as np
    _, key, _, _, fits, _ = record
    for tree, fit in trees:
        times = multiplicity(key, tree, seed)
        own = np.flatnonzero((times > 0) & fits[fit])
        if len(own):
            yield tree, own, times[own]


# ------------------------------------------------------------ the best splits
def _places(feats, sizes):
    """First cell of each (node, feature) and the number of all: a node's features one after the other, a cell a bin."""
    import numpy as np
    return np.append(0, sizes[feats].ravel().cumsum())


def _sums(flat, n: int, rows, size, feats, first, columns: list, k: int, y):
    """Sums by cell of the rows (sorted by node, ``size`` of each): by class of the first of ``columns``, and of the others."""
    import numpy as np
    m, cells = feats.shape[1], int(first[-1])
    place = np.empty((m, len(rows)), np.int64)
    for j in range(m):
        np.add(flat[np.repeat(feats[:, j] * n, size) + rows], np.repeat(first[j:-1:m], size), out=place[j])
    out = np.empty((k + len(columns) - 1, cells))
    out[:k] = np.bincount((place + y[rows] * cells).ravel(), np.tile(columns[0], m), k * cells).reshape(k, cells)
    for i, column in enumerate(columns[1:]):
        out[k + i] = np.bincount(place.ravel(), None if column is None else np.tile(column, m), cells)
    return out


HALF = float(1 << 26)


def best_binary(flat, n: int, rows, size, feats, sizes, mixed, counts):
    """(slot, bin, gain) as ``best_splits`` gives them for two classes of whole weights: both classes' sums in one number, the
    second's ``HALF`` times over. ``mixed``: the rows' weights so; ``counts``: the nodes' weights by class, all below ``HALF``."""
    import numpy as np
    nodes = len(feats)
    slot, cut, best = np.full(nodes, -1), np.zeros(nodes, np.int64), np.full(nodes, -np.inf)
    whole = counts[:, 0] + counts[:, 1] * HALF
    base = whole.cumsum() - whole
    for j in range(feats.shape[1]):
        first = np.append(0, sizes[feats[:, j]].cumsum())
        place = flat[np.repeat(feats[:, j] * n, size) + rows] + np.repeat(first[:-1], size)
        sums = np.bincount(place, mixed, int(first[-1]))
        filled = np.flatnonzero(sums)
        begin = np.searchsorted(filled, first)
        lens = np.diff(begin)
        begin = begin[:-1]
        left = sums[filled].cumsum() - np.repeat(base, lens)
        l1 = np.floor(left * (1 / HALF))
        l0 = left - l1 * HALF
        r0, r1 = np.repeat(counts[:, 0], lens) - l0, np.repeat(counts[:, 1], lens) - l1
        n_right = r0 + r1
        n_right[begin + lens - 1] = 1.0  # of the last cell nothing is on the right
        gain = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / n_right
        gain[begin + lens - 1] = -np.inf
        top = np.maximum.reduceat(gain, begin)
        better = np.flatnonzero(top > best)
        if len(better):
            hit = np.flatnonzero(gain == np.repeat(top, lens))
            at = hit[np.searchsorted(hit, begin[better])]
            slot[better], cut[better], best[better] = j, filled[at] - first[better], top[better]
    return slot, cut, best


def whole_numbers(x) -> bool:
    """Whether sums and differences of the values are exact."""
    import numpy as np
    return bool((x == np.floor(x)).all()) and float(np.abs(x).sum()) < 2.0 ** 52


def best_splits(sums, k: int, first, m: int, n_bins: int, whole: bool):
    """(slot, bin, gain, sums on the left) of the best Gini split of every node, slot -1 for none; ties to
    the first slot and bin. ``sums``: a row of cells for each class and whatever else is to be summed;
    ``first``: see ``_places``; ``whole``: the sums are whole numbers. Every node must have a class weight."""
    import numpy as np
    filled = np.flatnonzero(sums.any(axis=0))  # an empty cell splits as the one before it
    part = np.repeat(np.arange(len(first) - 1), np.diff(first))[filled]
    own = sums[:, filled]
    new = np.flatnonzero(np.diff(part, prepend=-1))
    of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(part))))
    if whole:
        left = own.cumsum(axis=1)
        left -= (left[:, new] - own[:, new])[:, of]
    else:  # sums that start anew for each part: nothing of the others' rounding is in them
        wide, at = np.zeros((len(own), len(new), n_bins)), filled - first[part]
        wide[:, of, at] = own
        left = wide.cumsum(axis=2)[:, of, at]
    lk = left[:k]
    right = left[:k, np.append(new[1:], len(part)) - 1][:, of] - lk
    n_left, n_right = lk.sum(axis=0), right.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (lk ** 2).sum(axis=0) / n_left + (right ** 2).sum(axis=0) / n_right
    gain[~((n_left > 0) & (n_right > 0))] = -np.inf
    node = part // m
    begin = np.flatnonzero(np.diff(node, prepend=-1))
    best = np.maximum.reduceat(gain, begin)
    hit = np.flatnonzero(gain == np.repeat(best, np.diff(np.append(begin, len(node)))))
    at = hit[np.searchsorted(hit, begin)]
    return np.where(best == -np.inf, -1, part[at] % m), filled[at] - first[part[at]], best, left[:, at]


def _level(state_b, seed: int, k: int, pack: Pack, weighted: bool):
    """(tree, block, sums): class weights and rows by cell of the open nodes' own features, ``BLOCK_NODES`` nodes a record.
    Without weights a row adds its multiplicity and ``HALF`` in one number (a task has fewer rows than that)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        trees, paths, opened = state_b.value
        walk, out, slots = _Walk(paths), {}, {}
        for record in _read(batches):
            n, _, y, w, _, packed = record
            flat, y = pack.columns(packed).ravel(), y.astype(np.int64)
            for tree, rows, times in _samples(record, trees, seed):
                feats, first = opened[tree]
                if tree not in slots:
                    ends, _ = walk.ends(tree)
                    slots[tree] = np.full(len(walk.of[tree][1]), len(ends))
                    slots[tree][ends] = np.arange(len(ends))
                slot = slots[tree][walk.down(tree, flat, n, rows)]
                size = np.bincount(slot, minlength=len(feats) + 1)[:-1]
                order = np.argsort(slot.astype(np.uint16) if len(feats) < 1 << 16 else slot, kind="stable")[:size.sum()]
                rows = rows[order]
                times = times[order]
                sums = _sums(flat, n, rows, size, feats, first, [times * w[rows], None] if weighted else [times + HALF], k, y)
                if tree in out:
                    out[tree] += sums
                else:
                    out[tree] = sums
        for tree, sums in out.items():
            if not weighted:
                own = np.floor(sums * (1 / HALF))
                sums = np.concatenate([sums - own * HALF, own.sum(axis=0)[None]])
            feats, first = opened[tree]
            edges = first[::feats.shape[1] * BLOCK_NODES]
            edges = edges if edges[-1] == first[-1] else np.append(edges, first[-1])
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array(np.full(len(edges) - 1, tree, np.int32)), "block": pa.array(np.arange(len(edges) - 1, dtype=np.int32)),
                "sums": pa.array([np.ascontiguousarray(sums[:, a:b]).tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())})
    return run


def _best(state_b, k: int, n_bins: int):
    """(tree, node, slot, bin, below, l_rows, left): the best split of every node of a block that has one."""
    def run(key, table):
        import numpy as np
        import pyarrow as pa
        _, paths, opened = state_b.value
        tree, block = key[0].as_py(), key[1].as_py()
        feats, first = opened[tree]
        own = slice(block * BLOCK_NODES, min((block + 1) * BLOCK_NODES, len(feats)))
        m = feats.shape[1]
        first = first[own.start * m:own.stop * m + 1] - first[own.start * m]
        total = np.zeros((k + 1, int(first[-1])))
        for sums in table.column("sums"):
            total += np.frombuffer(sums.as_buffer(), np.float64).reshape(total.shape)
        slot, cut, gain, left = best_splits(total, k, first, m, n_bins, whole_numbers(total))
        at = np.flatnonzero(slot >= 0)
        nodes = _Walk(paths).ends(tree)[1][own]
        return pa.table({"tree": pa.array(np.full(len(at), tree, np.int32)), "node": pa.array(nodes[at]), "slot": pa.array(slot[at].astype(np.int32)),
                         "bin": pa.array(cut[at].astype(np.int32)), "below": pa.array(gain[at]), "l_rows": pa.array(left[k, at].astype(np.int64)),
                         "left": _lists(left[:k, at].T)})
    return run


def _lists(rows):
    """An Arrow array of the rows of a matrix."""
    import numpy as np
    import pyarrow as pa
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(rows).ravel()))


def _kinds(k: int, weighted: bool):
    """Types in which a row's class and weight are moved."""
    return "uint8" if k <= 256 else "int32", "float64" if weighted else "uint8"


def _gathered(state_b, seed: int, pack: Pack, kinds: tuple):
    """(tree, node, n, bins, y, w): the rows of small nodes, packed a record a node."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        trees, paths = state_b.value
        walk = _Walk(paths)
        for record in _read(batches):
            n, _, y, w, _, packed = record
            flat = pack.columns(packed).ravel()
            for tree, rows, times in _samples(record, trees, seed):
                at = walk.down(tree, flat, n, rows)
                places, nodes = walk.ends(tree)
                size = np.bincount(at, minlength=len(walk.of[tree][1]))
                kept = size[places]
                order = np.argsort(at.astype(np.uint16) if len(size) <= 1 << 16 else at, kind="stable")
                starts = (size.cumsum() - size)[places]
                own = np.concatenate([order[a:a + c] for a, c in zip(starts.tolist(), kept.tolist(), strict=True)]) if size.sum() != kept.sum() else order
                nodes, kept = nodes[kept > 0], kept[kept > 0]
                if len(own):
                    starts, rows = kept.cumsum() - kept, rows[own]
                    weight = times[own] if kinds[1] == "uint8" else times[own] * w[rows]
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array(np.full(len(nodes), tree, np.int32)), "node": pa.array(nodes), "n": pa.array(kept),
                        "bins": _pieces(packed[rows], starts), "y": _pieces(y[rows].astype(kinds[0]), starts),
                        "w": _pieces(weight.astype(kinds[1]), starts)})
    return run


CELLS = 1 << 17
OWN_ROWS = 1 << 12
LEVEL_ROWS = 1 << 15


class _Grower:
    """The trees below some nodes, from their rows: ``bins`` (p x n), ``y``, ``w``."""

    def __init__(self, tree: int, bins, y, w, k: int, mtry: int, pack: Pack, seed: int, max_depth: int, min_split: int):
        self.tree, self.bins, self.y, self.w, self.k, self.mtry = tree, bins, y, w, k, mtry
        self.sizes, self.p, self.n_bins = pack.sizes, pack.p, int(pack.sizes.max(initial=1))
        self.seed, self.max_depth, self.min_split, self.whole = seed, max_depth, min_split, whole_numbers(w)
        self.binary = k == 2 and self.whole and float(w.sum()) < HALF
        self.out: list = []  # (nodes, depths, features, cuts, rows, counts, below)

    def splits(self, nodes, depth, size, counts, rows, flat, n: int, y, w):
        """(features, cuts, below) of the nodes (feature -1 for a leaf); rows are sorted by node."""
        import numpy as np
        feature, cut, below = np.full(len(nodes), -1, np.int64), np.full(len(nodes), -1, np.int64), np.zeros(len(nodes))
        todo = np.flatnonzero((size >= self.min_split) & ((counts != 0).sum(axis=1) > 1) & (depth < self.max_depth))
        ends = size.cumsum()
        for turn in range(0, self.p, self.mtry):  # on to other features while none separates the rows
            if not len(todo):
                break
            feats = _orders(self.tree, nodes[todo], self.seed, self.p, turn + self.mtry)[:, turn:]
            cells = self.sizes[feats].sum(axis=1).cumsum()
            edges = np.append(0, np.searchsorted(cells, np.arange(CELLS, cells[-1] + CELLS, CELLS), side="right"))
            edges[-1] = len(todo)
            left_over = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                some, of = todo[lo:hi], feats[lo:hi]
                if len(some) == some[-1] - some[0] + 1:
                    own = rows[ends[some[0]] - size[some[0]]:ends[some[-1]]]
                else:
                    wanted = np.zeros(some[-1] - some[0] + 1, bool)
                    wanted[some - some[0]] = True
                    own = rows[ends[some[0]] - size[some[0]]:ends[some[-1]]][np.repeat(wanted, size[some[0]:some[-1] + 1])]
                if self.binary:
                    slot, edge, gain = best_binary(flat, n, own, size[some], of, self.sizes, w[own] * np.where(y[own], HALF, 1.0), counts[some])
                else:
                    first = _places(of, self.sizes)
                    sums = _sums(flat, n, own, size[some], of, first, [w[own]], self.k, y)
                    slot, edge, gain, _ = best_splits(sums, self.k, first, of.shape[1], self.n_bins, self.whole)
                found = slot >= 0
                feature[some[found]] = of[found, slot[found]]
                cut[some[found]], below[some[found]] = edge[found], gain[found]
                left_over.append(some[~found])
            todo = np.concatenate(left_over)
        return feature, cut, below

    def grow(self, root: int):
        """All below ``root``: nodes of many rows one by one, the others in blocks whose columns stay in the cache."""
        import numpy as np
        n, flat = self.bins.shape[1], self.bins.reshape(-1)
        open_, small, held = [(root, np.arange(n))], [], 0
        while open_:
            node, rows = open_.pop()
            if len(rows) <= OWN_ROWS:
                small.append((node, rows))
                held += len(rows)
                if held > LEVEL_ROWS:
                    self.block(small)
                    small, held = [], 0
                continue
            nodes, depth, size = np.array([node]), np.array([(node + 1).bit_length() - 1]), np.array([len(rows)])
            counts = np.bincount(self.y[rows], self.w[rows], self.k)[None]
            feature, cut, below = self.splits(nodes, depth, size, counts, rows, flat, n, self.y, self.w)
            self.out.append((nodes, depth, feature, cut, size, counts, below))
            if feature[0] >= 0:
                side = self.bins[feature[0]][rows] > cut[0]
                open_ += [(2 * node + 2, rows[side]), (2 * node + 1, rows[~side])]
        if small:
            self.block(small)

    def block(self, small: list):
        """Level by level, all below some nodes."""
        import numpy as np
        k, nodes, size = self.k, np.array([node for node, _ in small], np.int64), np.array([len(rows) for _, rows in small])
        depth = np.array([(node + 1).bit_length() - 1 for node, _ in small])
        own = np.concatenate([rows for _, rows in small])
        n, flat, y, w = len(own), np.take(self.bins, own, axis=1).reshape(-1), self.y[own], self.w[own]
        rows = np.arange(n)
        while len(nodes):
            at = np.repeat(np.arange(len(nodes)) * k, size)
            counts = np.bincount(at + y[rows], w[rows], len(nodes) * k).reshape(-1, k)
            feature, cut, below = self.splits(nodes, depth, size, counts, rows, flat, n, y, w)
            self.out.append((nodes, depth, feature, cut, size, counts, below))
            split = feature >= 0
            rows, size = rows[np.repeat(split, size)], size[split]
            if not len(rows):
                break
            side = flat[np.repeat(feature[split] * n, size) + rows] > np.repeat(cut[split], size)
            begin = size.cumsum() - size
            right = np.add.reduceat(side, begin, dtype=np.int64)
            left, moved = size - right, np.empty_like(rows)
            moved[np.arange(left.sum()) + np.repeat(right.cumsum() - right, left)] = rows[~side]
            moved[np.arange(right.sum()) + np.repeat(left.cumsum(), right)] = rows[side]
            rows, size = moved, np.stack([left, right], axis=1).ravel()
            nodes, depth = (2 * nodes[split][:, None] + np.array([1, 2])).ravel(), np.repeat(depth[split] + 1, 2)


def _grown(k: int, mtry: int, pack: Pack, kinds: tuple, seed: int, max_depth: int, min_split: int):
    def grow(key, table):
        import numpy as np
        import pyarrow as pa
        tree, root = key[0].as_py(), key[1].as_py()
        n = sum(table.column("n").to_pylist())

        def joined(name, kind):
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        grower = _Grower(tree, pack.columns(joined("bins", np.uint8).reshape(n, -1)), joined("y", kinds[0]).astype(np.int64),
                         joined("w", kinds[1]).astype(np.float64), k, mtry, pack, seed, max_depth, min_split)
        grower.grow(root)
        node, depths, feature, cut, size, counts, below = (np.concatenate(c) for c in zip(*grower.out, strict=True))
        return pa.table({"tree": pa.array(np.full(len(node), tree, np.int32)), "node": node, "depth": depths.astype(np.int32),
                         "feature": feature.astype(np.int32), "bin": cut.astype(np.int32), "rows": size, "counts": _lists(counts),
                         "below": below, "root": pa.array(np.full(len(node), root, np.int64))})
    return grow


def _totals(trees: list, seed: int, k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        out: dict = {}
        for record in _read(batches):
            _, _, y, w, _, _ = record
            for tree, rows, times in _samples(record, trees, seed):
                sums = out.setdefault(tree, np.zeros(k + 1))
                sums[:k] += np.bincount(y[rows], times * w[rows], k)
                sums[k] += len(rows)
        yield pa.RecordBatch.from_pydict({"tree": pa.array(list(out), pa.int32()),
                                          "rows": pa.array([int(v[k]) for v in out.values()], pa.int64()),
                                          **{f"c{c}": pa.array([v[c] for v in out.values()], pa.float64()) for c in range(k)}})
    return run


# ----------------------------------------------------------------- the growth
def grow(df: DataFrame, fits: list, classes: int = 2, max_depth: int = 30, min_split: int = 2, max_bins: int = 64,
         seed: int = 345, label: str = "label", features: str = "features", weight: str | None = None,
         id_col: str = "id", local_rows: int = LOCAL_ROWS) -> Forest:
    """All trees of all ``fits`` over ``df`` (ids must be distinct; rows without an id or label are refused)."""
    spark = df.sparkSession
    if df.where(F.col(id_col).isNull() | F.col(label).isNull()).limit(1).count():
        raise ValueError("a row without an id or a label cannot be fitted")
    bounds = feature_bounds(df, features, max_bins, seed, id_col)
    pack = Pack(bounds)
    belongs = F.array(*[F.lit(True) if f.rows is None else F.coalesce(f.rows, F.lit(False)) for f in fits])
    rows = binned(df.withColumn("fits", belongs), bounds, label, features, weight, id_col, keep=("fits",))
    trees, named = [], {}
    for i, f in enumerate(fits):
        named[f.name] = (len(trees), f.trees)
        trees += [(len(trees) + t, i) for t in range(f.trees)]
    with _few_records(spark):
        n = df.count()
        parts = _grow(_stored(_records(_spread(rows, n), pack), "rows"), n, trees, pack, classes, max_depth, min_split, seed,
                      _kinds(classes, weight is not None), local_rows)
    nodes = spark.read.schema(parts[0].schema).parquet(*[path for part in parts for path in part.inputFiles()])
    return Forest(nodes, bounds, classes, seed, named)


def _grow(rows: DataFrame, total: int, trees: list, pack: Pack, classes: int, max_depth: int, min_split: int, seed: int, kinds: tuple,
          local_rows: int) -> list:
    """The written node tables of the trees over the records of ``rows`` (``total`` rows)."""
    import numpy as np
    spark = rows.sparkSession
    sc = spark.sparkContext
    p, n_bins = pack.p, int(pack.sizes.max(initial=1))
    mtry, sums = max(1, math.isqrt(p)), [f"c{c}" for c in range(classes)]
    local_rows = min(local_rows, LOCAL_BYTES // max(1, p))
    inner, leaves, splits = [], [], []  # splits: (tree, node, feature, bin)
    small: dict = {}
    large: dict = {}

    def place(tree, node, n, counts):
        """A node that is known by its sums: a leaf, or to be grown in one task, or in the next pass."""
        depth = (node + 1).bit_length() - 1
        if n < min_split or depth >= max_depth or sum(c > 0 for c in counts) < 2:
            leaves.append((tree, node, depth, -1, -1, n, counts, 0.0, node))
        elif n <= local_rows:
            small.setdefault(tree, {})[node] = n
        else:
            large[(tree, node)] = (n, counts, 0)
    for r in rows.mapInArrow(_totals(trees, seed, classes), "tree int, rows long, " + ", ".join(f"{c} double" for c in sums)
                             ).groupBy("tree").agg(*[F.sum(c).alias(c) for c in ["rows", *sums]]).collect():
        place(r.tree, 0, r.rows, [r[c] for c in sums])
    while large:
        now, opened, cells = {}, {}, 0
        for (tree, node), (n, counts, turn) in large.items():
            feats = _order(tree, node, seed, p)[turn * mtry:(turn + 1) * mtry]
            size = int(pack.sizes[feats].sum())
            if now and (cells + size > CELLS_A_PASS or len(feats) != m):
                continue
            m, cells = len(feats), cells + size
            now[(tree, node)] = (n, counts, turn)
            opened.setdefault(tree, {})[node] = feats
        paths = _paths(splits, opened)
        feats = {tree: np.array([own[node] for node in sorted(own)]) for tree, own in opened.items()}
        state = sc.broadcast(([t for t in trees if t[0] in opened], paths, {t: (f, _places(f, pack.sizes)) for t, f in feats.items()}))
        stats = rows.mapInArrow(_level(state, seed, classes, pack, kinds[1] == "float64"), "tree int, block int, sums binary")
        found = {(r.tree, r.node): r for r in stats.groupBy("tree", "block").applyInArrow(
            _best(state, classes, n_bins), "tree int, node long, slot int, bin int, below double, l_rows long, left array<double>").collect()}
        state.destroy()
        for (tree, node), (n, counts, turn) in now.items():
            del large[(tree, node)]
            r, depth = found.get((tree, node)), (node + 1).bit_length() - 1
            if r is None:
                if (turn + 1) * mtry < p:
                    large[(tree, node)] = (n, counts, turn + 1)
                else:
                    leaves.append((tree, node, depth, -1, -1, n, counts, 0.0, node))
                continue
            feature = int(opened[tree][node][r.slot])
            splits.append((tree, node, feature, r.bin))
            inner.append((tree, node, depth, feature, r.bin, n, counts, r.below, -1))
            place(tree, 2 * node + 1, r.l_rows, list(r.left))
            place(tree, 2 * node + 2, n - r.l_rows, [a - b for a, b in zip(counts, r.left, strict=True)])
    parts = [_stored(spark.createDataFrame(inner + leaves, NODE).coalesce(1), "nodes")]
    sizes = {t: sum(own.values()) * (pack.width + 2) for t, own in small.items()}
    rounds = _rounds([[t] for t in sorted(small)], sizes, ROUND_ROW * total)
    for i, now in enumerate(rounds):  # their rows are on disk between the tasks that read and those that grow
        state = sc.broadcast(([t for t in trees if t[0] in now], _paths(splits, {t: small[t] for t in now})))
        packed = rows.mapInArrow(_gathered(state, seed, pack, kinds), "tree int, node long, n long, bins binary, y binary, w binary")
        width = max(1, min(4 * sum(len(small[t]) for t in now), 32 * sc.defaultParallelism))  # few groups meet in a task
        parts.append(_stored(packed.repartition(width, "tree", "node").groupBy("tree", "node").applyInArrow(
            _grown(classes, mtry, pack, kinds, seed, max_depth, min_split), NODE), "nodes"))
        state.destroy()
        del packed
        if i + 1 < len(rounds):
            _freed(spark)
    return parts


def _freed(spark):
    """What finished jobs have left on the executors' disks goes when the driver's references to it do."""
    import gc
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# -------------------------------------------------------------------- scoring
def _packed_tree(node, depth, feature, cut, rows, counts, max_depth: int, min_split: int):
    """(feature, bin, children, shares) by place; what lies below ``max_depth`` or below a node of fewer
    than ``min_split`` rows is cut off."""
    import numpy as np
    own = np.flatnonzero(depth <= max_depth)
    own = own[np.argsort(node[own], kind="stable")]
    node, feature, counts = node[own], feature[own], counts[own]
    inner = (feature >= 0) & (depth[own] < max_depth) & (rows[own] >= min_split)
    child = np.searchsorted(node, 2 * node[:, None] + np.array([1, 2])).ravel()
    return np.where(inner, feature, -1).astype(np.int64), cut[own], child, counts / counts.sum(axis=1, keepdims=True)


def _packed_trees(nodes: list, max_depth: int, min_split: int = 0) -> dict:
    """{tree: packed tree}."""
    import numpy as np
    by: dict = {}
    for r in nodes:
        by.setdefault(r.tree, []).append(r)
    return {tree: _packed_tree(np.array([r.node for r in own], np.int64), *(
        np.array([r[c] for r in own]) for c in ("depth", "feature", "bin", "rows", "counts")), max_depth, min_split)
        for tree, own in by.items()}


def _flat(bins):
    import numpy as np
    return np.ascontiguousarray(bins.T).ravel()


def _voter(block_b, k: int, seed: int, oob: bool):
    """(.., votes, used): summed class shares of the block's trees over the rows that count."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        packed, of_fit = block_b.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bins, key, _, _, fits = _rows_of(batch)
            flat = _flat(bins)
            votes = np.array(batch.column("votes").flatten()).reshape(n, k).copy()
            used = batch.column("used").to_numpy().copy()
            for tree, one in sorted(packed.items()):
                own = fits[:, of_fit[tree]]
                if oob:
                    own = own & (multiplicity(key, tree, seed) == 0)
                own = np.flatnonzero(own)
                votes[own] += one[3][_led(one[:3], flat, n, own)]
                used[own] += 1
            cols = {c: batch.column(c) for c in batch.schema.names if c not in ("votes", "used")}
            yield pa.RecordBatch.from_pydict({**cols, "votes": pa.array(list(votes), pa.list_(pa.float64())),
                                              "used": pa.array(used, pa.int64())})
    return run


def _numbered(rows: DataFrame, pack: Pack) -> DataFrame:
    """The rows, written, bins packed, with a number of their own; ``chunk`` has up to 2 ** CHUNK_BITS rows of one task."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            number = np.arange(at, at + batch.num_rows, dtype=np.int64)
            at += batch.num_rows
            cols = {c: batch.column(c) for c in batch.schema.names}
            cols["bins"] = _pieces(pack.packed(_rows_of(batch)[0]), np.arange(batch.num_rows))
            yield pa.RecordBatch.from_pydict({**cols, "number": pa.array(number), "chunk": pa.array(number >> CHUNK_BITS)})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return _stored(_spread(rows).mapInArrow(run, schema + ", number long, chunk long"), "scored")


def _rounds(groups: list, sizes: dict, least: int) -> list:
    """The groups of trees put together while what is moved for them (``sizes``: bytes by tree) comes to ``ROUND_BYTES``
    at most, or to ``least`` if that is more."""
    out, held = [], 0
    for own in groups:
        size = sum(sizes[t] for t in own)
        if out and held + size <= max(ROUND_BYTES, least):
            out[-1] += own
            held += size
        else:
            out.append(list(own))
            held = size
    return out


def _asked(rows: DataFrame, flags: dict) -> dict:
    """{tree: rows of which a place in ``fits`` is set}."""
    kinds = list(dict.fromkeys(map(tuple, flags.values())))
    row = rows.agg(*[F.count_if(reduce(Column.__or__, [F.get("fits", F.lit(i)) for i in of])) for of in kinds]).first()
    return {tree: row[kinds.index(tuple(of))] for tree, of in flags.items()}


def _routed(state_b, pack: Pack, seed: int, oob: bool):
    """(tree, root, salt, numbers, bins): the rows led down to the tasks that have the nodes below."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        paths, flags, salts = state_b.value
        walk = _Walk(paths)
        for batch in _buffered(batches):
            packed, key, _, _, fits = _rows_of(batch)
            n, flat = len(key), pack.columns(packed).ravel()
            number = batch.column("number").to_numpy()
            spread = _mixed((number >> CHUNK_BITS).view(np.uint64))
            asked: dict = {}
            for tree, of in flags.items():
                if tuple(of) not in asked:
                    asked[tuple(of)] = fits[:, of].any(axis=1)
                own = asked[tuple(of)]
                if oob:
                    own = own & (multiplicity(key, tree, seed) == 0)
                own = np.flatnonzero(own)
                if not len(own):
                    continue
                group = walk.down(tree, flat, n, own) * salts[tree]
                if salts[tree] > 1:
                    group += (spread[own] % np.uint64(salts[tree])).astype(np.int64)
                order = np.argsort(group.astype(np.uint16) if len(walk.of[tree][1]) * salts[tree] <= 1 << 16 else group, kind="stable")
                own, group = own[order], group[order]
                starts = np.append(0, np.flatnonzero(np.diff(group)) + 1)
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array(np.full(len(starts), tree, np.int32)), "root": pa.array(walk.of[tree][0][group[starts] // salts[tree]]),
                    "salt": pa.array(group[starts] % salts[tree]), "numbers": _pieces(number[own], starts), "bins": _pieces(packed[own], starts)})
    return run


SCORE_ROWS = 1 << 14


def _fallen(above_b, pack: Pack, cuts: list, k: int):
    """(chunk, tree, numbers, shares): class shares by cut of the leaves that the rows of a group reach."""
    def run(key, rows, nodes):
        import numpy as np
        import pyarrow as pa
        none = {"chunk": pa.array([], pa.int64()), "tree": pa.array([], pa.int32()), "numbers": pa.array([], pa.binary()),
                "shares": pa.array([], pa.binary())}
        if not rows.num_rows or not nodes.num_rows:
            return pa.table(none)
        tree, root = key[0].as_py(), key[1].as_py()
        number = np.frombuffer(b"".join(rows.column("numbers").to_pylist()), np.int64)
        packed = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(len(number), -1)
        own = [nodes.column(c).to_numpy() for c in ("node", "depth", "feature", "bin", "rows")]
        own.append(nodes.column("counts").combine_chunks().flatten().to_numpy().reshape(nodes.num_rows, k))
        shares, trees = np.empty((len(number), len(cuts), k)), {}
        for i, (max_depth, min_split) in enumerate(cuts):
            up, end = root, None
            while up:  # the topmost node above at which the cut ends the tree
                up = (up - 1) // 2
                n, counts = above_b.value[(tree, up)]
                if (up + 1).bit_length() - 1 >= max_depth or n < min_split:
                    end = np.array(counts)
            if end is not None:
                shares[:, i] = end / end.sum()
            else:
                trees[i] = _packed_tree(*own, max_depth, min_split)
        for lo in range(0, len(number) if trees else 0, SCORE_ROWS):  # columns that stay in the cache
            part = packed[lo:lo + SCORE_ROWS]
            flat, n = pack.columns(part).ravel(), len(part)
            for i, one in trees.items():
                shares[lo:lo + n, i] = one[3][_led(one[:3], flat, n, np.arange(n))]
        chunk = number >> CHUNK_BITS  # long runs are of one chunk
        runs = np.append(0, np.flatnonzero(np.diff(chunk)) + 1)
        chunks, of = np.unique(chunk[runs], return_inverse=True)
        of = np.repeat(of.astype(np.uint16 if len(chunks) <= 1 << 16 else np.int64), np.diff(np.append(runs, len(chunk))))
        order, size = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(chunks))
        starts = size.cumsum() - size
        place = (number[order] & ((1 << CHUNK_BITS) - 1)).astype(np.int32)
        return pa.table({"chunk": pa.array(chunks), "tree": pa.array(np.full(len(starts), tree, np.int32)),
                         "numbers": _pieces(place, starts), "shares": _pieces(shares[order], starts)})
    return run


def _shares(model: Forest, rows: DataFrame, pack: Pack, flags: dict, cuts: list, oob: bool = False) -> DataFrame:
    """(chunk, tree, numbers, shares) for numbered rows and the trees of ``flags``: {tree: places in
    ``fits`` of which one must be set}. A group is what one task has grown of a tree; where
    more rows are scored than were fitted it is dealt to several."""
    sc = rows.sparkSession.sparkContext
    own = model.nodes.where(F.col("tree").isin(list(flags)))
    sizes = {r.tree: r["n"] for r in own.groupBy("tree").agg(F.max("rows").alias("n")).collect()}
    total = rows.count()
    salts = {t: max(1, -(-total // max(sizes.get(t, 0), LOCAL_ROWS))) for t in flags}
    above = own.where("root < 0").select("tree", "node", "feature", "bin", "rows", "counts").collect()  # nodes of > LOCAL_ROWS rows
    ends: dict = {}
    for r in own.where("root >= 0 and node = root").select("tree", "node").collect():
        ends.setdefault(r.tree, []).append(r.node)
    walks = sc.broadcast((_paths([(r.tree, r.node, r.feature, r.bin) for r in above], ends), flags, salts))
    sums = sc.broadcast({(r.tree, r.node): (r.rows, list(r.counts)) for r in above})
    led = rows.select("key", "y", "w", "fits", "bins", "number").mapInArrow(
        _routed(walks, pack, model.seed, oob), "tree int, root long, salt long, numbers binary, bins binary")
    often = F.element_at(F.create_map(*[F.lit(v) for t, n in salts.items() for v in (t, n - 1)]), F.col("tree"))
    below = own.where("root >= 0").select("tree", "node", "depth", "feature", "bin", "rows", "counts", "root").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), often.cast("long"))))
    by = ("tree", "root", "salt")
    return led.groupBy(*by).cogroup(below.groupBy(*by)).applyInArrow(
        _fallen(sums, pack, cuts, model.classes), "chunk long, tree int, numbers binary, shares binary")


def _votes(table, shares, cuts: int, k: int):
    """For the rows of a chunk: [(tree, rows, shares by cut)], trees rising."""
    import numpy as np
    place = np.full(1 << CHUNK_BITS, -1, np.int64)
    place[table.column("number").to_numpy() & ((1 << CHUNK_BITS) - 1)] = np.arange(table.num_rows)
    trees = shares.column("tree").to_numpy()
    order = np.argsort(trees, kind="stable")
    numbers, parts = shares.column("numbers").to_pylist(), shares.column("shares").to_pylist()
    for own in np.split(order, np.flatnonzero(np.diff(trees[order])) + 1):
        if len(own):
            at = place[np.frombuffer(b"".join(numbers[i] for i in own), np.int32)]
            yield int(trees[own[0]]), at, np.frombuffer(b"".join(parts[i] for i in own), np.float64).reshape(len(at), cuts, k)


def _counted(k: int):
    """The rows of a chunk with the votes of more trees."""
    def run(rows, shares):
        import numpy as np
        import pyarrow as pa
        n = rows.num_rows
        before = rows.column("votes").combine_chunks()
        votes = np.zeros((n, k)) if before.null_count else before.flatten().to_numpy().reshape(n, k).copy()
        used = rows.column("used").to_numpy().copy()
        if n:
            for _, at, share in _votes(rows, shares, 1, k):
                votes[at] += share[:, 0]
                used[at] += 1
        return rows.drop_columns(["votes", "used"]).append_column("votes", _lists(votes)).append_column("used", pa.array(used))
    return run


def _sizes(model: Forest, trees) -> dict:
    return {r.tree: r["count"] for r in model.nodes.where(F.col("tree").isin(list(trees))).groupBy("tree").count().collect()}


def score(model: Forest, df: DataFrame, use: dict | None = None, oob: bool = False, trees: int | None = None,
          max_depth: int = 62, min_split: int = 0, label: str = "label", features: str = "features", id_col: str = "id", keep=()) -> DataFrame:
    """id, label, prediction, score (mean share of class 1), probability, used for the rows of ``df``.

    ``use``: {fit name: condition of the rows it votes on}, by default the first fit votes on all.
    ``oob``: trees whose sample holds a row do not vote on it; a row without a vote has NULLs.
    ``trees``, ``max_depth``, ``min_split``: only the first trees of each fit, cut as if grown so."""
    spark = df.sparkSession
    use = use or {next(iter(model.fits)): F.lit(True)}
    belongs = F.array(*[F.coalesce(c, F.lit(False)) for c in use.values()])
    label_ = label if label in df.columns else None
    rows = binned(df.withColumns({"fits": belongs, **({} if label_ else {label: F.lit(None).cast("int")})}), model.bounds,
                  label, features, None, id_col, keep=("fits", *keep)).withColumn("y", F.coalesce("y", F.lit(-1)))
    of_fit = {}
    for i, name in enumerate(use):
        first, n = model.fits[name]
        of_fit.update({t: i for t in range(first, first + min(n, trees or n))})
    if sum(_sizes(model, of_fit).values()) <= NODES_SENT:
        packed = _packed_trees(model.nodes.where(F.col("tree").isin(list(of_fit))).collect(), max_depth, min_split)
        rows = rows.withColumns({"votes": F.array(*[F.lit(0.0)] * model.classes), "used": F.lit(0).cast("long")})
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        rows = rows.mapInArrow(_voter(spark.sparkContext.broadcast((packed, of_fit)), model.classes, model.seed, oob), schema)
    else:
        rows, pack = _numbered(rows, Pack(model.bounds)), Pack(model.bounds)
        out = rows.select(*[c for c in rows.columns if c in (id_col, "y", *keep)], "number", "chunk")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", votes array<double>, used long"
        out = out.withColumns({"votes": F.lit(None).cast("array<double>"), "used": F.lit(0).cast("long")})
        flags, moved = {t: [i] for t, i in of_fit.items()}, pack.width + 10 + 8 * model.classes
        rounds = _rounds([[t] for t in sorted(of_fit)], {t: n * moved for t, n in _asked(rows, flags).items()}, ROUND_ROW * rows.count())
        for i, own in enumerate(rounds):
            shares = _shares(model, rows, pack, {t: flags[t] for t in own}, [(max_depth, min_split)], oob)
            out = out.groupBy("chunk").cogroup(shares.groupBy("chunk")).applyInArrow(_counted(model.classes), schema)
            if i + 1 < len(rounds):
                out = _stored(out, "votes")
                _freed(spark)
        rows = out.drop("number", "chunk")
    share = F.when(F.col("used") > 0, F.transform("votes", lambda v: v / F.col("used")))
    rows = rows.withColumn("probability", share)
    best = (F.array_position("probability", F.array_max("probability")) - 1).cast("int")
    return rows.select(id_col, F.when(F.col("y") >= 0, F.col("y")).alias(label), *keep, best.alias("prediction"),
                       F.get("probability", F.lit(1)).alias("score"), "probability", "used")


def cut(model: Forest, first: int, trees: int, max_depth: int, min_split: int) -> DataFrame:
    """Nodes of ``trees`` trees from ``first`` on, as if grown with this depth and least split."""
    own = model.nodes.where((F.col("tree") >= first) & (F.col("tree") < first + trees) & (F.col("depth") <= max_depth))
    ends = (F.col("depth") >= max_depth) | (F.col("rows") < min_split)
    # rows only fall on the way down, so below a node that is too small all are; its own parent is not
    above = own.where((F.col("feature") >= 0) & ~ends).select("tree", F.explode(F.array(
        F.col("node") * 2 + 1, F.col("node") * 2 + 2)).alias("node"))
    kept = own.join(above, ["tree", "node"], "left_semi").unionByName(own.where("node = 0"))
    leaf = F.when(~ends, F.col("feature")).otherwise(F.lit(-1)).alias("feature")
    root = F.when(ends & (F.col("root") < 0), F.col("node")).otherwise(F.col("root")).alias("root")
    return kept.select("tree", "node", "depth", leaf, F.when(~ends, F.col("bin")).otherwise(F.lit(-1)).alias("bin"), "rows",
                       "counts", "below", root)


@dataclass
class Part:
    """Rows (a condition) to be scored by a fit cut to ``trees``, ``max_depth`` and ``min_split``."""
    name: str
    fit: str
    rows: Column
    trees: int | None = None
    max_depth: int = 62
    min_split: int = 0


def _judge(state_b, k: int):
    """(part, n, right) sums of a task."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        parts, packed = state_b.value
        sums = np.zeros((len(parts), 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, _, y, _, of = _rows_of(batch)
            flat = _flat(bins)
            for i, (cut, own_trees) in enumerate(parts):
                own = np.flatnonzero(of[:, i])
                if len(own):
                    votes = np.zeros((len(own), k))
                    for t in own_trees:
                        one = packed[cut][t]
                        votes += one[3][_led(one[:3], flat, batch.num_rows, own)]
                    sums[i] += len(own), int((votes.argmax(axis=1) == y[own]).sum())
        at = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_pydict({"part": pa.array(at.astype(np.int32)), "n": pa.array(sums[at, 0]),
                                          "right": pa.array(sums[at, 1])})
    return run


def _judged(parts: list, trees: set, cuts: list, k: int):
    """(part, n, right) of a chunk for the parts with the given trees; ``parts``: (cut, trees)."""
    def run(rows, shares):
        import numpy as np
        import pyarrow as pa
        n = rows.num_rows
        right = np.zeros((len(parts), 2), np.int64)
        if n:
            of = rows.column("fits").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            y = rows.column("y").to_numpy()
            votes: dict = {}
            # one sum by fit, cut and number of trees; parts of different rows share it
            asked = {part for part in parts if part[1][0] in trees}
            for tree, at, share in _votes(rows, shares, len(cuts), k):
                for cut, own_trees in asked:
                    if tree in own_trees:
                        sums = votes.setdefault((cut, own_trees), np.zeros((n, k)))
                        sums[at] += share[:, cuts.index(cut)]
            for i, part in enumerate(parts):
                own = np.flatnonzero(of[:, i])
                if len(own) and part in votes:
                    right[i] = len(own), int((votes[part][own].argmax(axis=1) == y[own]).sum())
        at = np.flatnonzero(right[:, 0])
        return pa.table({"part": pa.array(at.astype(np.int32)), "n": pa.array(right[at, 0]), "right": pa.array(right[at, 1])})
    return run


def part_accuracy(model: Forest, df: DataFrame, parts: list, label: str = "label", features: str = "features",
                  id_col: str = "id") -> DataFrame:
    """(name, n, accuracy) of every ``Part``, all in one pass over ``df`` (a part without rows has none)."""
    spark = df.sparkSession
    trees = {p.name: range(model.fits[p.fit][0], model.fits[p.fit][0] + min(p.trees or 1 << 30, model.fits[p.fit][1])) for p in parts}
    cuts = sorted({(p.max_depth, p.min_split) for p in parts})
    wanted = sorted(set().union(*trees.values()))
    of = F.array(*[F.coalesce(p.rows, F.lit(False)) for p in parts])
    rows = binned(df.withColumn("fits", of), model.bounds, label, features, None, id_col, keep=("fits",))
    if len(cuts) * sum(_sizes(model, wanted).values()) <= NODES_SENT:
        nodes = model.nodes.where(F.col("tree").isin(wanted)).collect()
        state = ([((p.max_depth, p.min_split), list(trees[p.name])) for p in parts], {c: _packed_trees(nodes, *c) for c in cuts})
        sums = rows.mapInArrow(_judge(spark.sparkContext.broadcast(state), model.classes), "part int, n long, right long")
    else:
        pack = Pack(model.bounds)
        rows = _numbered(rows, pack)
        y, by = rows.select("chunk", "number", "y", "fits"), {}
        for t in wanted:
            by.setdefault(next(p.fit for p in parts if t in trees[p.name]), []).append(t)
        done, moved = [], pack.width + 10 + 8 * model.classes * len(cuts)
        flags = {t: [i for i, p in enumerate(parts) if t in trees[p.name]] for t in wanted}
        rounds = _rounds(list(by.values()), {t: n * moved for t, n in _asked(rows, flags).items()}, ROUND_ROW * rows.count())
        for own in rounds:
            shares = _shares(model, rows, pack, {t: flags[t] for t in own}, cuts)
            done.append(y.groupBy("chunk").cogroup(shares.groupBy("chunk")).applyInArrow(
                _judged([((p.max_depth, p.min_split), trees[p.name]) for p in parts], set(own), cuts, model.classes),
                "part int, n long, right long").groupBy("part").agg(F.sum("n").alias("n"), F.sum("right").alias("right")))
            if len(rounds) > 1:
                done[-1] = _stored(done[-1], "judged")
                _freed(spark)
        sums = reduce(DataFrame.unionByName, done)
    names = F.array(*[F.lit(p.name) for p in parts])
    return sums.groupBy("part").agg(F.sum("n").alias("n"), F.sum("right").alias("right")).select(
        F.get(names, F.col("part")).alias("name"), "n", (F.col("right") / F.col("n")).alias("accuracy"))


def accuracy(scored: DataFrame | None, label: str = "label") -> Column:
    return F.avg((F.col(label) == F.col("prediction")).cast("double"))


def importance(model: Forest, names: list, fit: str | None = None) -> DataFrame:
    """(feature, importance): mean decrease of Gini impurity, weighted by the nodes' weights, a
    tree's decreases summing to 1 and averaged over the fit's trees, as shares of all."""
    first, n = model.fits[fit or next(iter(model.fits))]
    own = model.nodes.where((F.col("tree") >= first) & (F.col("tree") < first + n))
    weight = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c)
    purity = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c * c) / weight
    gain = own.where("feature >= 0").groupBy("tree", "feature").agg(F.sum(F.col("below") - purity).alias("gain"))
    share = gain.join(gain.groupBy("tree").agg(F.sum("gain").alias("all")), "tree").where("all > 0")
    share = share.groupBy("feature").agg(F.sum(F.col("gain") / F.col("all")).alias("s"))
    spark = model.nodes.sparkSession
    all_ = spark.createDataFrame(list(enumerate(names)), "feature int, name string")
    share = _stored(share, "importance")
    total = share.agg(F.sum("s")).first()[0] or 1.0
    return all_.join(share, "feature", "left").select(
        F.col("name").alias("feature"), F.coalesce(F.col("s") / F.lit(total), F.lit(0.0)).alias("importance"))
