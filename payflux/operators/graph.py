"""The account graph: ids, edges, loops, degrees and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payflux.config import PreprocessConfig
from payflux.functions.hubs import with_node_values
from payflux.functions.numbering import materialised, numbered
from payflux.functions.scalars import account, hash_unit, inverse_sqrt


def endpoints(df: DataFrame, config: PreprocessConfig = PreprocessConfig()) -> DataFrame:
    """df's edges by account: src and dst, with edge_id if there is one. Missing accounts are one account, or dropped."""
    m = config.columns
    ids = ["edge_id"] if "edge_id" in df.columns else []
    out = df.select(*ids, account(F.col(m.source), config.missing_account).alias("src"), account(F.col(m.destination), config.missing_account).alias("dst"))
    return out if config.missing_account is not None else out.where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def accounts(ends: DataFrame) -> DataFrame:
    """account, is_src and is_dst: each account once, from one pass over the edges."""
    sides = ends.select(F.inline(F.array(F.struct(F.col("src").alias("account"), F.lit(True).alias("is_src")), F.struct(F.col("dst").alias("account"), F.lit(False).alias("is_src")))))
    return sides.groupBy("account").agg(F.bool_or("is_src").alias("is_src"), F.bool_or(~F.col("is_src")).alias("is_dst"))


def nodes(ends: DataFrame) -> DataFrame:
    """node_id (from 0, in code-point order of the accounts) and account."""
    return numbered(accounts(ends).select("account"), [F.col("account")], "node_id").select("node_id", "account")


def membership(ends: DataFrame) -> DataFrame:
    """One row: accounts, source_only, destination_only, bidirectional."""
    return accounts(ends).agg(
        F.count("*").alias("accounts"),
        F.count_if(F.col("is_src") & ~F.col("is_dst")).alias("source_only"),
        F.count_if(F.col("is_dst") & ~F.col("is_src")).alias("destination_only"),
        F.count_if(F.col("is_src") & F.col("is_dst")).alias("bidirectional"),
    )


def edge_index(ends: DataFrame, node_table: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """edge_id (if ends have it), src_id and dst_id. Spark broadcasts the nodes if they are small, else both joins shuffle and split hot accounts.

    targets: the nodes that edges end at, where they are a table of their own; few of them are broadcast, however many sources there are.
    """
    s = node_table.select(F.col("account").alias("src"), F.col("node_id").alias("src_id"))
    d = (targets or node_table).select(F.col("account").alias("dst"), F.col("node_id").alias("dst_id"))
    return ends.join(d, "dst").join(s, "src").select(*(c for c in ends.columns if c == "edge_id"), "src_id", "dst_id")


def looped(edges: DataFrame, node_table: DataFrame) -> DataFrame:
    """edges and a loop for each node; loops that were edges stay. Added ones have no edge_id."""
    loops = node_table.select(F.lit(None).cast("long").alias("edge_id"), F.col("node_id").alias("src_id"), F.col("node_id").alias("dst_id"), F.lit(True).alias("is_loop"))
    return edges.select("edge_id", "src_id", "dst_id", F.lit(False).alias("is_loop")).unionByName(loops)


def source_degrees(edges: DataFrame) -> DataFrame:
    """node_id and degree: edges that begin at each node."""
    return edges.groupBy(F.col("src_id").alias("node_id")).agg(F.count("*").alias("degree"))


def weighted(edges: DataFrame, degrees: DataFrame | None = None) -> DataFrame:
    """edges with weight: the product of the inverse roots of both ends' degrees as sources.

    A hub's degree is broadcast, and its edges stay dealt out as they are: a vertex cut. How many edges end at a node decides that at the other end.
    """
    sources = degrees or source_degrees(edges)
    ends = edges.groupBy(F.col("dst_id").alias("node_id")).agg(F.count("*").alias("ending"))
    own = materialised(sources.join(ends, "node_id", "full_outer").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("ending", F.lit(0)).alias("ending")))
    own = own.withColumn("inverse", inverse_sqrt(F.col("degree")))
    out = with_node_values(edges, "src_id", own.withColumnRenamed("inverse", "src_inverse"), ["src_inverse"], "degree")
    out = with_node_values(out, "dst_id", own.withColumnRenamed("inverse", "dst_inverse"), ["dst_inverse"], "ending")
    return out.select(*edges.columns, (F.coalesce("src_inverse", F.lit(0.0)) * F.coalesce("dst_inverse", F.lit(0.0))).alias("weight"))


def weighted_nodes(ends: DataFrame) -> DataFrame:
    """node_id, account, entering (edges that end there) and inverse: of the root of its degree as a source, its loop counted."""
    sides = ends.select(F.inline(F.array(F.struct(F.col("src").alias("account"), F.lit(1).alias("leaving")), F.struct(F.col("dst").alias("account"), F.lit(0).alias("leaving")))))
    found = numbered(sides.groupBy("account").agg(F.sum("leaving").alias("leaving"), F.sum(1 - F.col("leaving")).alias("entering")), [F.col("account")], "node_id")
    return found.select("node_id", "account", "entering", inverse_sqrt(F.col("leaving") + 1).alias("inverse"))


def weighted_index(ends: DataFrame, node_table: DataFrame) -> DataFrame:
    """weighted(looped(edge_index(...))) by one join for each end: ids and inverse roots come together. node_table: of weighted_nodes.

    The nodes that edges end at are a table of their own: few of them are broadcast, however many sources there are.
    """
    of = lambda df, side: df.select(F.col("account").alias(side), F.col("node_id").alias(f"{side}_id"), F.col("inverse").alias(f"{side}_inverse"))
    targets = materialised(of(node_table.where("entering > 0"), "dst"))
    edges = ends.join(targets, "dst").join(of(node_table, "src"), "src")
    edges = edges.select("edge_id", "src_id", "dst_id", F.lit(False).alias("is_loop"), (F.col("src_inverse") * F.col("dst_inverse")).alias("weight"))
    loop = (F.lit(None).cast("long").alias("edge_id"), F.col("node_id").alias("src_id"), F.col("node_id").alias("dst_id"), F.lit(True).alias("is_loop"), (F.col("inverse") * F.col("inverse")).alias("weight"))
    return edges.unionByName(node_table.select(*loop))


def graph_meta(node_table: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, edges_with_loops, self_edges."""
    n = node_table.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count_if(~F.col("is_loop")).alias("edges"), F.count("*").alias("edges_with_loops"), F.count_if(~F.col("is_loop") & (F.col("src_id") == F.col("dst_id"))).alias("self_edges"))
    return n.crossJoin(F.broadcast(e))


def node_of(node_table: DataFrame, name: str) -> int | None:
    row = node_table.where(F.col("account") == name).first()
    return row["node_id"] if row else None


def account_of(node_table: DataFrame, node_id: int) -> str | None:
    row = node_table.where(F.col("node_id") == node_id).first()
    return row["account"] if row else None


def drop_edges(edges: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """edges without a share of them, drawn by a hash of edge_id: the same ones in each run. A rate of 0 or less drops none."""
    return edges if rate <= 0 else edges.where(hash_unit("drop", seed, F.col("edge_id")) > rate)


def mask_edges(edges: DataFrame, p: float, seed: int = 42) -> DataFrame:
    """edge_id of the edges that stay, each with probability 1 - p."""
    return edges.where(hash_unit("mask", seed, F.col("edge_id")) < 1 - p).select("edge_id")
