"""The tables behind the usual charts: histograms, degree against score, ranks, places on two principal axes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from payflux.functions.numbering import materialised
from payflux.functions.quantiles import quantiles, with_quantiles
from payflux.operators.anomalies import top
from payflux.operators.message_passing import lists, matrix


def histogram(df: DataFrame, column: str = "score", bins: int = 50) -> DataFrame:
    """bin (from 0), low, high and count of each of so many bins of equal width; the greatest value is in the last one."""
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    at = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col(column) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = df.crossJoin(F.broadcast(ends)).where(F.col(column).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    grid = ends.where(F.col("low").isNotNull()).select("low", ((F.col("high") - F.col("low")) / bins).alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edges = grid.select("bin", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("high"))
    return edges.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("count", F.lit(0)).alias("count"))


def box(df: DataFrame) -> DataFrame:
    """One row: least, q25, median, q75, p95, p99 and greatest score."""
    scores = materialised(df.select("score"))
    ends = scores.agg(F.min("score").alias("least"), F.max("score").alias("greatest"))
    places = {"q25": 0.25, "median": 0.5, "q75": 0.75, "p95": 0.95, "p99": 0.99}
    return with_quantiles(ends, scores, "score", places).select("least", *places, "greatest")


def degree_against_score(edges: DataFrame, node_scores: DataFrame) -> DataFrame:
    """node_id, out_degree (0 without edges) and score."""
    degrees = edges.groupBy(F.col("src_id").alias("node_id")).agg(F.count("*").alias("out_degree"))
    return node_scores.join(degrees, "node_id", "left").select("node_id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), "score")


def ranked(scores: DataFrame, k: int = 20, key: str = "edge_id") -> DataFrame:
    """The k greatest scores with their rank from 1; the window is over these alone."""
    return top(scores, k, key).withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(key).desc()))).select("rank", key, "score")


def percentiles(scores: DataFrame, at: tuple[float, ...] = (50, 75, 90, 95, 99)) -> DataFrame:
    """p and score."""
    row = quantiles(materialised(scores.select("score")), "score", tuple(p / 100 for p in at))
    return row.select(F.inline(F.arrays_zip(F.array(*(F.lit(float(p)) for p in at)).alias("p"), F.col("q").alias("score"))))


def two_axes(embeddings: DataFrame, key: str = "node_id", column: str = "h") -> DataFrame:
    """key, x and y of every node: its place on the two leading principal axes of all nodes. Vectors with a null are left out.

    Each task sums its vectors and their products; the driver gets sums whose size is that of one product, whatever the
    nodes, and places are worked out where the vectors are. An axis points to where its greatest component is positive.
    """
    rows = embeddings.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column(0))
                m = np.concatenate([np.ones((len(m), 1)), m], axis=1)  # counts and sums beside the products
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            n = total.shape[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), lists(total)], names=["i", "v"])

    parts = rows.select("v").mapInArrow(summed, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "x"))
    sums = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    width = 1 + max((r["i"] for r in sums), default=0)
    gram = np.zeros((width, width))
    for r in sums:
        gram[r["i"], r["j"]] = r["x"]
    n, mean = max(gram[0, 0], 1.0), gram[0, 1:] / max(gram[0, 0], 1.0)
    _, axes = np.linalg.eigh(gram[1:, 1:] - n * np.outer(mean, mean)) if width > 1 else (None, np.zeros((0, 0)))
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]) if axes.size else np.zeros((width - 1, 0))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xy = np.zeros((batch.num_rows, 2))
            if batch.num_rows:
                xy[:, : axes.shape[1]] = (matrix(batch.column(1)) - mean) @ axes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["key", "x", "y"])

    return rows.mapInArrow(placed, "key bigint, x double, y double").withColumnRenamed("key", key)
