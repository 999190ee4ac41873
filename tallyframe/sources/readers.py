"""Reading delimited and Parquet tables, and looking things up in a data dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.sources.schemas import TABLES

MISSING_TEXT = "NA"


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv_schema(
    spark: SparkSession, path: str, declared: T.StructType | None, infer: bool = False
) -> T.StructType:
    """Schema in file order: declared types where there are any, text for all other columns.

    With ``infer`` those others get the type that fits every value, found by a pass over the whole
    input; numbers other than whole ones within 64 bits become doubles.
    """
    options = {"header": True, "nullValue": MISSING_TEXT, "emptyValue": "", "inferSchema": infer}
    known = {f.name: f.dataType for f in declared} if declared else {}
    kinds = (T.LongType, T.IntegerType, T.StringType, T.BooleanType)
    return T.StructType(
        [
            T.StructField(f.name, known.get(f.name) or _stored(f.dataType, kinds), True)
            for f in spark.read.csv(path, **options).schema
        ]
    )


def _stored(kind: T.DataType, kinds: tuple) -> T.DataType:
    if isinstance(kind, T.IntegerType):
        return T.LongType()
    if isinstance(kind, kinds):
        return kind
    return T.DoubleType() if isinstance(kind, T.NumericType) else T.StringType()


def read_csv(
    spark: SparkSession,
    path: str,
    table: str | None = None,
    schema: T.StructType | None = None,
    infer: bool = False,
    misfits: str | None = None,
) -> DataFrame:
    """Delimited file or folder with a header; plain or compressed.

    ``table`` names one of the declared tables. The file may have further columns, read as text, or
    by ``infer`` with types that fit all their values. Empty cells and ``NA`` are missing values. A line
    that does not fit the types or the header fails the job, unless ``misfits`` names a column: it then
    keeps such a line's text, to be counted with :func:`count_misfits`, and is NULL in all others. Files of
    a folder must have one header. A gzip file is read by one task; many files, or bzip2, are spread.
    """
    declared = schema if schema is not None else TABLES.get(table) if table else None
    full = csv_schema(spark, path, declared, infer)
    options = {"header": True, "nullValue": MISSING_TEXT, "emptyValue": "", "enforceSchema": False}
    if misfits is None:
        return spark.read.schema(full).csv(path, mode="FAILFAST", **options)
    kept = T.StructType([*full.fields, T.StructField(misfits, T.StringType(), True)])
    options["columnNameOfCorruptRecord"] = misfits
    return spark.read.schema(kept).csv(path, mode="PERMISSIVE", **{**options, "enforceSchema": True})


def count_misfits(df: DataFrame, misfits: str) -> int:
    """Lines that did not fit. All columns are parsed for it, so that none is overlooked."""
    return df.agg(*[F.count(c).alias(c) for c in df.columns]).first()[misfits]


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Data dictionary: quoted fields may hold delimiters and line breaks."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def dictionary_lookup(
    dictionary: DataFrame,
    table_pattern: str | None = None,
    row: str | None = None,
    table_column: str = "Table",
    row_column: str = "Row",
    result: str | None = "Description",
) -> DataFrame:
    """Entries whose table name matches a pattern and/or whose column name equals ``row``."""
    out = dictionary
    if table_pattern is not None:
        out = out.filter(F.col(table_column).rlike(table_pattern))
    if row is not None:
        out = out.filter(F.col(row_column) == row)
    return out.select(result) if result else out
