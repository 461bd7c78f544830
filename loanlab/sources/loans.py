"""SRC-1 / SRC-2: reading the raw loan table and cleaning sentinel text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..catalog import SENTINEL_TEXT, loan_schema
from .records import csv_records


def load_loans(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "csv") -> DataFrame:
    """Full scan of the loan table.

    CSV columns are found by the names of the header, in any order; a name that
    the schema does not have, or a missing one, is an error. Types are those of
    the schema (never inferred: two columns are of mixed type), records may
    span lines (free-text ``desc``), leading blanks stay (``' 36 months'`` is
    a category value), NaN becomes NULL. Cells that do not parse are NULL and
    their record is in ``MALFORMED`` (``count_malformed``). Parquet is read
    as is. A file is read by as many tasks as it has splits (``records``).
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    return _read_csv(spark, path, schema or loan_schema()).drop(MALFORMED)


MALFORMED = "_malformed_record"


OPTIONS = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE",
           "columnNameOfCorruptRecord": MALFORMED}


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    # names only: without inference no data is parsed
    header = spark.read.options(header=True, multiLine=True, **OPTIONS).csv(path).columns
    known = {f.name: f for f in schema.fields}
    if set(header) != set(known) or len(header) != len(known):
        raise ValueError(f"loan file: unknown columns {sorted(set(header) - set(known))}, "
                         f"missing columns {sorted(set(known) - set(header))}")
    by_file = T.StructType([known[c] for c in header] + [T.StructField(MALFORMED, T.StringType())])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in by_file)
    text = F.regexp_replace("record", r"\r$", "")
    df = csv_records(spark, path).select(F.from_csv(text, ddl, OPTIONS).alias("r"))
    return df.select(*[F.nanvl(F.col(f"r.{f.name}"), F.lit(None).cast(f.dataType)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"r.{f.name}").alias(f.name)
                       for f in schema.fields], F.col(f"r.{MALFORMED}").alias(MALFORMED))


def count_malformed(spark: SparkSession, path: str, schema: T.StructType | None = None) -> int:
    """Records of a CSV loan file with a cell that does not parse."""
    schema = schema or loan_schema()
    # every column is asked for: a cell that no query needs is not parsed
    return _read_csv(spark, path, schema).agg(
        F.count_if(F.col(MALFORMED).isNotNull()), F.max(F.xxhash64(*schema.names))).first()[0]


def null_sentinel(df: DataFrame, sentinel: str = SENTINEL_TEXT) -> DataFrame:
    """SRC-2: a whole-cell ``sentinel`` text in any string column becomes NULL.

    Other cells are left untouched; numeric columns cannot hold the text.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(F.nullif(F.col(f.name), F.lit(sentinel)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
