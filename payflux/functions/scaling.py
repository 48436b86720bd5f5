"""Standard scaling by population deviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment_columns(columns: list[str]) -> list[Column]:
    return [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean_c and std_c of each column."""
    return df.agg(*moment_columns(columns))


def scaled(c: Column, mean: Column, std: Column) -> Column:
    """A column without variance is only centred."""
    return (c - mean) / F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std)


def standardised(df: DataFrame, columns: list[str], suffix: str = "") -> DataFrame:
    """df with each column scaled, in one pass for the moments; their single row is broadcast."""
    stats = moments(df, columns)
    joined = df.crossJoin(F.broadcast(stats))
    new = {f"{c}{suffix}": scaled(F.col(c), F.col(f"mean_{c}"), F.col(f"std_{c}")) for c in columns}
    return joined.withColumns(new).drop(*stats.columns)
