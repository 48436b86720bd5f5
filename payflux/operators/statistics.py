"""Statistics of graphs, features, categories and amounts, as tidy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from payflux.functions.numbering import materialised
from payflux.functions.quantiles import with_quantiles
from payflux.functions.scalars import number


def basic(node_table: DataFrame, edges: DataFrame, node_width: int, edge_width: int) -> DataFrame:
    """One row: nodes, edges, edges_with_loops, node_width, edge_width, density, edges_per_node."""
    n = node_table.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"))
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return n.crossJoin(F.broadcast(e)).select(
        "nodes",
        "edges",
        (F.col("nodes") + F.col("edges")).alias("edges_with_loops"),
        F.lit(node_width).alias("node_width"),
        F.lit(edge_width).alias("edge_width"),
        F.coalesce(F.try_divide(F.col("edges").cast("double"), pairs), F.lit(0.0)).alias("density"),
        F.coalesce(F.try_divide(F.col("edges").cast("double"), F.col("nodes")), F.lit(0.0)).alias("edges_per_node"),
    )


def degrees(node_features: DataFrame) -> DataFrame:
    """kind (in, out, total), mean, std (of all), least, greatest, median, q25, q75, zeros."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("x")) for k, c in (("out", "src_tx_count"), ("in", "dst_tx_count"), ("total", "total_degree"))))
    long = materialised(node_features.select(F.inline(kinds)))
    own = long.groupBy("kind").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("greatest"), F.count_if(F.col("x") == 0).alias("zeros"))
    places = {"median": 0.5, "q25": 0.25, "q75": 0.75}
    return with_quantiles(own, long, "x", places, ("kind",)).select("kind", "mean", "std", "least", "greatest", *places, "zeros")


def features(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, mean, std (of all), least, greatest, zeros, zero_percent, nans, infs of each column; one pass, no rows without columns."""
    if not columns:
        return df.sparkSession.createDataFrame([], "name string, mean double, std double, least double, greatest double, zeros bigint, zero_percent double, nans bigint, infs bigint")
    flat, entries = [F.count("*").alias("n")], []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        flat += [
            F.avg(x).alias(f"mean_{i}"), F.stddev_pop(x).alias(f"std_{i}"), F.min(x).alias(f"least_{i}"), F.max(x).alias(f"greatest_{i}"),
            F.count_if(x == 0).alias(f"zeros_{i}"), F.count_if(F.isnan(x)).alias(f"nans_{i}"), F.count_if(F.abs(x) == float("inf")).alias(f"infs_{i}"),
        ]
        own = {n: F.col(f"{n}_{i}") for n in ("mean", "std", "least", "greatest", "zeros")} | {"zero_percent": 100.0 * F.col(f"zeros_{i}") / F.greatest(F.col("n"), F.lit(1))}
        entries.append(F.struct(F.lit(c).alias("name"), *(v.alias(k) for k, v in own.items()), F.col(f"nans_{i}").alias("nans"), F.col(f"infs_{i}").alias("infs")))
    return df.agg(*flat).select(F.inline(F.array(*entries)))


def categories(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """name, value, count, percent (of all rows) and total_unique of each column's most frequent values, null left out; ties by value."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))))
    counts = long.groupBy("name", "value").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.col("count").desc(), "value"))
    # a row for each value; the rank is cut early in each task
    best = counts.where(F.col("value").isNotNull()).withColumn("place", rank).where(F.col("place") <= top)
    totals = counts.groupBy("name").agg(F.sum("count").alias("rows"), F.count("value").alias("total_unique"))
    return best.join(totals, "name").select("name", "value", "count", (100.0 * F.col("count") / F.col("rows")).alias("percent"), "total_unique")


def amounts(df: DataFrame, columns: list[str], is_table: bool = False) -> DataFrame:
    """name, count, mean, std (of a sample), least, greatest, median, q25, q75, q95, q99, zeros and negatives of each amount that is a number.

    is_table: df is cheap to read again, so amounts needn't be written once more.
    """
    kinds = dict(df.dtypes)
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), number(F.col(c), kinds[c]).alias("x")) for c in columns)))).where(F.col("x").isNotNull())
    long = long if is_table else materialised(long)
    own = long.groupBy("name").agg(
        F.count("*").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("greatest"),
        F.count_if(F.col("x") == 0).alias("zeros"), F.count_if(F.col("x") < 0).alias("negatives"),
    )
    places = {"median": 0.5, "q25": 0.25, "q75": 0.75, "q95": 0.95, "q99": 0.99}
    return with_quantiles(own, long, "x", places, ("name",)).select("name", "count", "mean", "std", "least", "greatest", *places, "zeros", "negatives")


def report(tables: dict[str, DataFrame], most: int = 200) -> str:
    """Tables as text, of each its first rows, and a line that says so where there are more."""
    lines = []
    for name, df in tables.items():
        lines.append(f"== {name}")
        rows = df.limit(most + 1).collect()
        lines += ["  " + ", ".join(f"{k}={v}" for k, v in row.asDict().items()) for row in rows[:most]]
        if len(rows) > most:
            lines.append(f"  and more than these {most} rows")
    return "\n".join(lines)
