"""Scoring transactions as they arrive (an addition: the batch jobs don't need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payflux.config import ColumnMap, PreprocessConfig
from payflux.functions.scalars import account, timestamp
from payflux.operators.anomalies import STRATEGIES
from payflux.sources.transactions import SCHEMA


def arriving(spark: SparkSession, path: str, config: PreprocessConfig = PreprocessConfig()) -> DataFrame:
    """Transactions of the CSV files that arrive in a folder, with event_time."""
    rows = spark.readStream.schema(SCHEMA).option("header", True).csv(path)
    return rows.withColumn("event_time", timestamp(F.col(config.columns.event_time), config.event_formats))


def scored(stream: DataFrame, accounts: DataFrame, strategy: str = "max", default: float = 0.0, m: ColumnMap = ColumnMap()) -> DataFrame:
    """stream with score, from the stored scores of both accounts (account, score); unknown accounts score `default`. Stateless."""
    s = accounts.select(F.col("account").alias("s_account"), F.col("score").alias("s"))
    d = accounts.select(F.col("account").alias("d_account"), F.col("score").alias("d"))
    out = stream.join(s, account(F.col(m.source)) == F.col("s_account"), "left").join(d, account(F.col(m.destination)) == F.col("d_account"), "left")
    value = lambda c: F.coalesce(F.col(c), F.lit(float(default)))
    return out.withColumn("score", STRATEGIES[strategy](value("s"), value("d"))).drop("s_account", "d_account", "s", "d")


def activity(stream: DataFrame, window: str = "1 hour", late: str = "1 day", m: ColumnMap = ColumnMap()) -> DataFrame:
    """window, account and transactions sent in it; state is dropped once it is later than the watermark."""
    timed = stream.withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", window), F.col(m.source).alias("account")).agg(F.count("*").alias("sent"))
