"""Masking of nodes for training and scoring, drawn by hashes so that it can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payflux.functions.numbering import numbered
from payflux.functions.scalars import hash_unit


def in_drawn_order(df: DataFrame, salt: str, seed: int, name: str, key: str = "node_id") -> DataFrame:
    return numbered(df.withColumn("__u", hash_unit(salt, seed, F.col(key))), [F.col("__u"), F.col(key)], name).drop("__u")


def masked(features: DataFrame, token: list[float] | None = None, mask_rate: float = 0.5, replace_rate: float = 0.1, seed: int = 42) -> DataFrame:
    """features (node_id, features) with kind (keep, token, noise, same) and masked: the vector that the encoder sees.

    The first int(mask_rate * N) nodes of a drawn order are masked: of these int((1 - replace_rate) * M)
    become the token (zeros without one), the last int(replace_rate * M) the vector of another
    node, what is left stays as it is. The givers are the first of a second drawn order.
    """
    n = features.count()
    m = int(mask_rate * n)
    noise = int(replace_rate * m)
    tokens = int((1 - replace_rate) * m) if replace_rate > 0 else m
    order = in_drawn_order(features, "mask", seed, "place")
    kind = F.when(F.col("place") >= m, "keep").when(F.col("place") < tokens, "token").when(F.col("place") >= m - noise, "noise").otherwise("same")
    order = order.withColumn("kind", kind)
    as_token: Column = F.array(*(F.lit(float(x)) for x in token)) if token else F.transform("features", lambda x: F.lit(0.0))
    if noise:
        givers = in_drawn_order(features, "noise", seed, "giver").where(F.col("giver") < noise).select((F.col("giver") + (m - noise)).alias("place"), F.col("features").alias("given"))
        order = order.join(givers, "place", "left")
    else:
        order = order.withColumn("given", F.lit(None).cast(dict(features.dtypes)["features"]))
    new = F.when(F.col("kind") == "token", as_token).when(F.col("kind") == "noise", F.col("given")).otherwise(F.col("features"))
    return order.select("node_id", "features", "kind", new.alias("masked"))
