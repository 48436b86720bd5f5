"""Reading transactions and picking their columns by position or role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payflux.config import COLUMNS, ColumnMap, PreprocessConfig
from payflux.functions.numbering import numbered_as_read

#: All text: inferred types would make one account two where one side has nulls.
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def read_csv(spark: SparkSession, path: str | None, limit_rows: int | None = None, number_rows: bool = True, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Transactions of a CSV with a header, whatever the header's names; with edge_id if they are to be numbered.

    path: a file or a folder. Rows are numbered as they stand in the file, files in the order of their names. columns: those that
    are wanted, as rows are written once to be numbered.
    """
    if not path:
        raise ValueError("no path given")
    df = spark.read.schema(SCHEMA).option("header", True).option("enforceSchema", True).csv(path).select(*columns)
    if number_rows:
        df = numbered_as_read(df, "edge_id")
    return df if limit_rows is None else first_rows(df, limit_rows)


def write_csv(df: DataFrame, path: str, order: list[Column] | None = None, compression: str = "none") -> None:
    """Writes transactions as CSV with a header, in this order through all files. compression: as Spark names it; read_csv finds it by the files' names."""
    times = {c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss") for c, k in df.dtypes if k.startswith(("timestamp", "date"))}
    rows = df.withColumns(times) if times else df
    (rows.orderBy(*order) if order else rows).select(*(F.col(c).cast("string") for c in COLUMNS)).write.option("header", True).option("compression", compression).csv(path)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows by edge_id (any n without one)."""
    return df.where(F.col("edge_id") < n) if "edge_id" in df.columns else df.limit(n)


def column_by_index(df: DataFrame, i: int) -> DataFrame:
    if not 0 <= i < len(df.columns):
        raise IndexError(f"column {i} of {len(df.columns)}")
    return df.select(df.columns[i])


def columns_by_indices(df: DataFrame, indices: list[int]) -> DataFrame:
    for i in indices:
        column_by_index(df, i)
    return df.select(*(df.columns[i] for i in indices))


def account_columns(df: DataFrame, m: ColumnMap = ColumnMap()) -> DataFrame:
    return df.select(m.source, m.destination)


def time_columns(df: DataFrame, m: ColumnMap = ColumnMap()) -> DataFrame:
    return df.select(m.event_time, m.storage_time)


def numeric_columns(df: DataFrame, m: ColumnMap = ColumnMap()) -> DataFrame:
    return df.select(*m.numeric)


def categorical_columns(df: DataFrame, m: ColumnMap = ColumnMap()) -> DataFrame:
    return df.select(*m.categorical)


def load_info(df: DataFrame, path: str, config: PreprocessConfig) -> dict:
    return {
        "path": path, "rows": df.count(), "columns": len(COLUMNS), "column_names": list(COLUMNS),
        "full": config.limit_rows is None, "limit_rows": config.limit_rows,
    }
