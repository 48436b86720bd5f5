"""Joins of edges with what is known of their nodes, in which no task gets a hub whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payflux.functions.names import unused

#: A node with more than one in so many edges is a hub; there are fewer hubs than that.
HUBS = 4096


def with_node_values(edges: DataFrame, end: str, nodes: DataFrame, columns: list[str], degree: str, key: str = "node_id", hubs: int = HUBS) -> DataFrame:
    """edges (ends and keys are whole numbers) with columns of the node at one end; null where nodes don't have it.

    degree: a column of nodes, how many edges have the node at this end. What is known of hubs is broadcast, a row each. The other nodes are
    joined by a shuffle in which edges of hubs, which need nothing more, are dealt out by a hash. nodes is read twice, so it should be a table.
    """
    every, own, place = unused([*edges.columns, *nodes.columns], "every", "own", "place")
    named = unused([*edges.columns, *nodes.columns], *(f"hub_{c}" for c in columns))
    total = nodes.agg(F.sum(degree).alias(every))
    hot = nodes.crossJoin(F.broadcast(total)).where(F.col(degree) * hubs > F.col(every)).select(F.col(key).alias(own), *(F.col(c).alias(n) for c, n in zip(columns, named, strict=True)))
    first = edges.join(F.broadcast(hot), edges[end] == F.col(own), "left")
    # (false, a hash) is nobody's place
    first = first.withColumn(place, F.struct(F.col(own).isNull().alias("known"), F.when(F.col(own).isNull(), F.col(end).cast("long")).otherwise(F.xxhash64(*edges.columns)).alias("at")))
    rest = nodes.select(F.struct(F.lit(True).alias("known"), F.col(key).cast("long").alias("at")).alias(place), *columns)
    joined = first.join(rest, place, "left")
    return joined.select(*(F.col(c) for c in edges.columns), *(F.coalesce(n, c).alias(c) for c, n in zip(columns, named, strict=True)))
