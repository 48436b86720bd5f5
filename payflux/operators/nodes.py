"""Features of nodes: means over the edges that leave and enter, degrees, and their ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payflux.functions.scalars import finite

SCALARS = ("src_tx_count", "dst_tx_count", "total_degree", "in_out_ratio")


def node_feature_names(n: int) -> list[str]:
    return [*(f"src_avg_feat_{i}" for i in range(n)), *(f"dst_avg_feat_{i}" for i in range(n)), *SCALARS]


def node_features(edges: DataFrame, features: list[str], node: tuple[str, str] = ("src_id", "dst_id"), key: str = "node_id", entering: DataFrame | None = None) -> DataFrame:
    """key and the features of each node that has an edge. edges: two ends and numbers.

    Two groupings with map-side sums and one full outer join on their key. Means over no edges
    are 0. The ratio is in / (out + 1e-8). NaN and infinity become 0.

    entering: the same edges, dealt out for the nodes where they enter as edges are for those that they leave; numbers are never missing then.
    """
    mean = F.avg if entering is None else lambda f: F.sum(f) / F.count("*")  # one count for all
    out = edges.groupBy(F.col(node[0]).alias(key)).agg(F.count("*").alias("src_tx_count"), *(mean(f).alias(f"src_avg_feat_{i}") for i, f in enumerate(features)))
    into = (edges if entering is None else entering).groupBy(F.col(node[1]).alias(key)).agg(F.count("*").alias("dst_tx_count"), *(mean(f).alias(f"dst_avg_feat_{i}") for i, f in enumerate(features)))
    both = out.join(into, key, "full_outer")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    n_out, n_in = count("src_tx_count"), count("dst_tx_count")
    means = [finite(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in node_feature_names(len(features))[: -len(SCALARS)]]
    return both.select(
        key, *means, n_out.alias("src_tx_count"), n_in.alias("dst_tx_count"), (n_out + n_in).alias("total_degree"), finite(n_in / (n_out + F.lit(1e-8))).alias("in_out_ratio")
    )


def sanitised(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})
