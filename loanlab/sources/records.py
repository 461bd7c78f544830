"""CSV records read in parallel, also where quoted cells hold line feeds.

A file is read as lines, in the splits that Spark makes of any text file. A
split does not know whether it begins inside a quoted cell, so a first pass
finds, for both cases, how it ends (``_ends``): a row per split. The splits'
ends, chained in order, tell how each begins. In the second pass every task
puts its lines together to records; the pieces of a record that spans splits
meet by the split in which it began. A quote opens a cell only at the cell's
start, as in the reader of Spark itself.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

# task functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CELL = re.compile(r'(?:"(?:[^"]|"")*"(?!")[^,]*|(?!")[^,]*)(,|$)')
_CLOSE = re.compile(r'(?:[^"]|"")*"(?!")[^,]*(,|$)')


def _inside_after(line: str, inside: bool) -> bool:
    """Is the end of ``line`` inside a quoted cell, if its start is (or not)?"""
    if '"' not in line:
        return inside
    at, cell = 0, _CLOSE if inside else _CELL
    while True:
        m = cell.match(line, at)
        if m is None:
            return True
        if not m[1]:
            return False
        at, cell = m.end(), _CELL


def _ends(batches):
    """(file, start, outside, outside_ended, inside, inside_ended): for either state at a split's
    start the state at its end, and whether a record ends in it."""
    import pyarrow as pa
    states: dict = {}
    for batch in batches:
        for line, file, start in zip(*[batch.column(c).to_pylist() for c in ("value", "file", "start")], strict=True):
            a, a_ended, b, b_ended = states.get((file, start), (False, False, True, False))
            a, b = _inside_after(line, a), _inside_after(line, b)
            states[(file, start)] = (a, a_ended or not a, b, b_ended or not b)
    values = list(zip(*states.values(), strict=True)) if states else [[]] * 4
    yield pa.RecordBatch.from_pydict({
        "file": pa.array([k[0] for k in states], pa.string()), "start": pa.array([k[1] for k in states], pa.int64()),
        **{c: pa.array(v, pa.bool_()) for c, v in zip(("outside", "outside_ended", "inside", "inside_ended"), values,
                                                      strict=True)}})


def _assembled(begins_b):
    """(file, begun, start, whole, record); ``begun``: the split in which the record began, -1 for a file's header."""
    def run(batches):
        import pyarrow as pa
        begins = begins_b.value  # {(file, start): split in which the open record began, or None}
        now, inside, begun, lines, out = None, False, None, [], []

        def close(whole):
            nonlocal lines
            if lines and (not whole or lines != [""] and lines != ["\r"]):
                out.append((now[0], begun, now[1], whole and begun == now[1] and not spanned, "\n".join(lines)))
            lines = []
        spanned = False
        for batch in batches:
            for line, file, start in zip(*[batch.column(c).to_pylist() for c in ("value", "file", "start")], strict=True):
                if (file, start) != now:
                    if now is not None:
                        close(False)
                    now = (file, start)
                    begun = begins.get(now)
                    inside = spanned = begun is not None
                    if not spanned:
                        begun = -1 if start == 0 else start
                lines.append(line)
                inside = _inside_after(line, inside)
                if not inside:
                    close(True)
                    begun, spanned = start, False
            if out:
                yield _batch(pa, out)
                out.clear()
        if now is not None:
            close(False)
        yield _batch(pa, out)
    return run


def _batch(pa, rows):
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_pydict({c: pa.array(v, k) for c, v, k in zip(
        ("file", "begun", "start", "whole", "record"), cols, kinds, strict=True)})


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the text of every record of the CSV files at ``path``, without headers and blank lines."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    ends = lines.mapInArrow(_ends, "file string, start long, outside boolean, outside_ended boolean, inside boolean, "
                                   "inside_ended boolean")
    begins, last, open_at = {}, None, None  # a row a split
    for r in ends.orderBy("file", "start").toLocalIterator():
        if r.file != last:
            last, open_at = r.file, None
        begins[(r.file, r.start)] = open_at
        is_open, ended = (r.outside, r.outside_ended) if open_at is None else (r.inside, r.inside_ended)
        if not is_open:
            open_at = None
        elif ended or open_at is None:  # the record that is open at the end began here
            open_at = -1 if r.start == 0 and not ended else r.start
    begins = {k: v for k, v in begins.items() if v is not None}
    found = lines.mapInArrow(_assembled(spark.sparkContext.broadcast(begins)),
                             "file string, begun long, start long, whole boolean, record string")
    whole = found.where("whole and begun >= 0").select("record")
    if not begins:
        return whole
    pieces = found.where("not whole and begun >= 0").groupBy("file", "begun").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda p: p["record"]), "\n")
        .alias("record"))
    return whole.unionByName(pieces.select("record"))
