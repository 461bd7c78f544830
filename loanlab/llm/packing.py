"""Token-ID output: best-fit-decreasing packing into rows of fixed length.

Documents are tokenised (ids of a public rank file, whole texts by the public
library: splitting, looking up and merging word by word costs more), split losslessly into pieces of at most ``length`` ids, and the
pieces of a block are packed: longest first, each into the row with the least
room that still holds it. The search for that room is a segment tree over
capacities: a leaf counts the rows with that much room, a descent finds the
smallest capacity that is large enough. Blocks are bounded (``BLOCK_PIECES``
pieces of one input split), so memory does not grow with the data.

A row of the result is one row of the id matrix: ``ids`` (``length`` ids as
little-endian uint16, padded with ``pad``), ``cu_seqlens`` (cumulative segment
lengths, from 0), ``position_resets`` (places where positions start at 0
again, the padding's start included), and per segment the doc_id and the
place of its first id in the document. ``unpack`` restores every document.

Defined results: null or empty text has no ids and no segment; null doc_ids
stay null; repeated rows are packed each; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .bpe import load_ranks
from .common import bounded_batches, whole_text

LENGTH = 2048
PAD = 50256  # free in the rank file
BLOCK_PIECES = 8192


class RoomTree:
    """Counts of open rows by remaining capacity, 0 .. size."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves < size + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.rows: list = [[] for _ in range(size + 1)]

    def _add(self, room: int, n: int):
        k = room + self.leaves
        while k:
            self.count[k] += n
            k //= 2

    def put(self, room: int, row: int):
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int):
        """(room, row) with the least room >= need, or None; the row is removed."""
        k = need + self.leaves
        if not self.count[k]:
            # up to the first right sibling with an open row, then down to its left
            while k > 1 and not (k % 2 == 0 and self.count[k + 1]):
                k //= 2
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list, length: int) -> list:
    """Rows as lists of item numbers; every size is 1 .. length."""
    tree, rows = RoomTree(length), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[item])
        if found is None:
            rows.append([item])
            room, row = length, len(rows) - 1
        else:
            room, row = found
            rows[row].append(item)
        tree.put(room - sizes[item], row)
    return rows


def _packer(ranks_path_b, pattern: str, length: int, pad: int):
    def run(batches):
        from array import array

        import numpy as np
        import pyarrow as pa
        import tiktoken
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_path_b.value, special_tokens={})
        pieces: list = []  # (doc_id, first, ids as bytes)

        def packed():
            out = {k: [] for k in ("ids", "cu_seqlens", "position_resets", "doc_ids", "starts")}
            for row in best_fit_decreasing([len(p[2]) // 2 for p in pieces], length):
                ids = b"".join(pieces[i][2] for i in row)
                cu = [0]
                for i in row:
                    cu.append(cu[-1] + len(pieces[i][2]) // 2)
                out["ids"].append(ids + np.full(length - cu[-1], pad, np.uint16).tobytes())
                out["cu_seqlens"].append(cu)
                out["position_resets"].append(cu if cu[-1] < length else cu[:-1])
                out["doc_ids"].append([pieces[i][0] for i in row])
                out["starts"].append([pieces[i][1] for i in row])
            pieces.clear()
            return pa.RecordBatch.from_pydict({
                "n_tokens": pa.array([c[-1] for c in out["cu_seqlens"]], pa.int64()),
                "doc_ids": pa.array(out["doc_ids"], pa.list_(pa.int64())),
                "starts": pa.array(out["starts"], pa.list_(pa.int64())),
                "cu_seqlens": pa.array(out["cu_seqlens"], pa.list_(pa.int32())),
                "position_resets": pa.array(out["position_resets"], pa.list_(pa.int32())),
                "ids": pa.array(out["ids"], pa.binary())})
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = array("H", enc.encode_ordinary(text)).tobytes()
                for k in range(0, len(ids), 2 * length):
                    pieces.append((doc_id, k // 2, ids[k:k + 2 * length]))
                if len(pieces) >= BLOCK_PIECES:
                    yield packed()
        if pieces:
            yield packed()
    return run


def pack(docs: DataFrame, ranks_path: str, pattern: str, length: int = LENGTH, pad: int = PAD) -> DataFrame:
    """The packed rows of ``docs`` (see the module's text). No shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks = load_ranks(ranks_path)
    if max(ranks.values()) >= 1 << 16 or pad >= 1 << 16:
        raise ValueError("ids must fit in 16 bits")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(
        _packer(spark.sparkContext.broadcast(ranks), pattern, length, pad),
        "n_tokens long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, "
        "position_resets array<int>, ids binary")


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, start, ids as bytes): the segments of every packed row."""
    seg = F.transform("doc_ids", lambda d, i: F.struct(
        d.alias("doc_id"), F.get("starts", i).alias("start"),
        F.substring("ids", F.get("cu_seqlens", i) * 2 + 1,
                    (F.get("cu_seqlens", i + 1) - F.get("cu_seqlens", i)) * 2).alias("ids")))
    return packed.select(F.inline(seg))


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet: ``ids`` is a fixed-length binary row of the id matrix."""
    packed.write.mode("errorifexists").parquet(path)
