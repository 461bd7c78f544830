"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

# Task functions travel by value: executors need no copy of this subpackage.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

# a "word" in every contract: a run of anything but blank, tab, LF, VT, FF, CR
WORD = r"[^\x20\x09-\x0D]+"

# Rows per Arrow batch. Documents may hold 100 kB and more, so that the default
# of 10,000 rows could need gigabytes in one Python worker.
ARROW_ROWS = 256


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches that go to Python workers small (long documents)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to, and read back from, the shared checkpoint folder.

    Cuts the lineage in a way that survives lost executors, and keeps a result
    that several later steps read from being computed again for each.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(col: str = "text") -> Column:
    """The text as a string column; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _low(b: int) -> int:
    if 0x41 <= b <= 0x5A:
        return b + 32
    return b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20


# for bytes.translate: A-Z to a-z, ASCII that is neither letter nor digit to a blank
WORD_BYTES = bytes(map(_low, range(256)))


def byte_pieces(raw: bytes, size: int):
    """``raw`` by ``WORD_BYTES``, in pieces of about ``size`` bytes that begin at a blank."""
    low = raw.translate(WORD_BYTES)
    at = 0
    while len(low) - at > size:
        end = low.find(b" ", at + size)
        if end < 0:
            break
        yield low[at:end]
        at = end
    yield low[at:]


def row_key(columns: list) -> Column:
    """128 bits of a row's values (binary), nulls included: rows that differ in which
    of two columns is null have different keys."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    return F.unhex(F.substring(F.sha2(row, 256), 1, 32))
