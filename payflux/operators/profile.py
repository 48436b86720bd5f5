"""Profiles of tables and checks of their quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _long(df: DataFrame, aggregates: dict[str, dict[str, Column]], names: list[str], key: str = "name") -> DataFrame:
    """One pass over df for all aggregates, then a row for each entry: its key, and the values called names."""
    flat = [c.alias(f"{k}.{n}") for k, a in aggregates.items() for n, c in a.items()]
    entries = F.array(*(F.struct(F.lit(k).alias(key), *(F.col(f"`{k}.{n}`").alias(n) for n in names)) for k in aggregates))
    return df.agg(*flat).select(F.inline(entries))


def missing_values(df: DataFrame) -> DataFrame:
    """name, missing and percent (two digits) of the columns that have nulls."""
    aggregates = {c: {"missing": F.count_if(F.col(c).isNull()), "percent": F.round(100 * F.count_if(F.col(c).isNull()) / F.greatest(F.count("*"), F.lit(1)), 2)} for c in df.columns}
    return _long(df, aggregates, ["missing", "percent"]).where("missing > 0")


def dtypes(df: DataFrame) -> dict[str, str]:
    return {f"col_{i}_{name}": kind for i, (name, kind) in enumerate(df.dtypes)}


def overview(df: DataFrame, approximate: bool = False) -> DataFrame:
    """name, rows, missing and distinct values but null of each column; on large data their number may be estimated."""
    if approximate:
        aggregates = {c: {"rows": F.count("*"), "missing": F.count_if(F.col(c).isNull()), "different": F.approx_count_distinct(F.col(c))} for c in df.columns}
        return _long(df, aggregates, ["rows", "missing", "different"])
    names, missing = ["rows", "missing", "different"], F.col("missing")
    found = _counted_values(df).groupBy("place").agg(F.sum("times").alias("rows"), F.sum(F.when(missing, F.col("times"))).alias("missing"), F.count_if(~missing).alias("different"))
    of = lambda i, n: F.coalesce(F.max(F.when(F.col("place") == i, F.col(n))), F.lit(0))
    return _long(found, {c: {n: of(i, n) for n in names} for i, c in enumerate(df.columns)}, names)


def _counted_values(df: DataFrame) -> DataFrame:
    """place (of a column in df), missing (whether it is the null) and times: each value of each column once, and how often it occurs.

    Values are rows, with a column for each type that df has. For distinct counts beside each other Spark would group by all columns of df
    together, and a task would hold each value in a row as wide as df.
    """
    fields = df.schema.fields
    kinds = list(dict.fromkeys(f.dataType for f in fields))
    own = [f"value_{k}" for k in range(len(kinds))]
    typed = lambda f: [(F.col(f.name) if f.dataType == kind else F.lit(None).cast(kind)).alias(n) for kind, n in zip(kinds, own, strict=True)]
    values = df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("place"), *typed(f)) for i, f in enumerate(fields)))))
    missing = reduce(lambda a, b: a & b, (F.col(n).isNull() for n in own))
    return values.groupBy("place", *own).agg(F.count("*").alias("times")).select("place", missing.alias("missing"), "times")


def tensor_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, n_nan, n_inf, n_zero, least, greatest and mean (of what is no NaN; infinite where a value is), and whether there is neither NaN nor infinity."""
    aggregates = {}
    for c in columns:
        x = F.col(c).cast("double")
        real = F.when(~F.isnan(x), x)
        nan, inf = F.count_if(F.isnan(x)), F.count_if(F.abs(x) == float("inf"))
        aggregates[c] = {"n_nan": nan, "n_inf": inf, "n_zero": F.count_if(x == 0), "least": F.min(real), "greatest": F.max(real), "mean": F.avg(real), "passed": (nan == 0) & (inf == 0)}
    return _long(df, aggregates, ["n_nan", "n_inf", "n_zero", "least", "greatest", "mean", "passed"])


def gates(checks: dict[str, bool]) -> dict[str, bool]:
    """The checks, and whether all passed."""
    return {**checks, "all_passed": all(checks.values())}
