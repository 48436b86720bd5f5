"""Losses between vectors, and the reconstruction error of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payflux.functions.vectors import cosine

SCE_ALPHA, SCE_MODULE_ALPHA = 3.0, 2.0


def sce(x: Column, y: Column, alpha: float = SCE_ALPHA) -> Column:
    return F.avg(F.pow(1 - cosine(x, y), F.lit(float(alpha))))


def sig(x: Column, y: Column) -> Column:
    """Mean of the logistic function of minus the cosine."""
    return F.avg(1 / (1 + F.exp(cosine(x, y))))


def mse(x: Column, y: Column) -> Column:
    """Mean over all components of all vectors."""
    total = F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
    return F.sum(total) / F.sum(F.size(x))


def cosine_loss(x: Column, y: Column) -> Column:
    return F.avg(1 - cosine(x, y))


LOSSES = {"sce": sce, "sig": sig, "mse": mse, "cosine": cosine_loss}


def loss(df: DataFrame, x: str, y: str, name: str = "sce", **options: float) -> DataFrame:
    if name not in LOSSES:
        raise ValueError(f"unknown loss: {name}")
    return df.agg(LOSSES[name](F.col(x), F.col(y), **options).alias("loss"))


def reconstruction_error(df: DataFrame, x: str, y: str, key: str = "node_id") -> DataFrame:
    """key and score: 1 - cosine of what is and what was reconstructed; 1 where either is zero."""
    return df.select(key, (1 - cosine(F.col(x), F.col(y))).alias("score"))
