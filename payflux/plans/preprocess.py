"""From transactions to a stored graph with features, statistics and a report."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payflux.config import ColumnMap, PreprocessConfig
from payflux.functions.numbering import materialised, temporary_tables
from payflux.functions.scalars import account
from payflux.operators import edges as E
from payflux.operators import graph as G
from payflux.operators import nodes as N
from payflux.operators import profile, statistics
from payflux.sources.store import TransactionGraph, artifacts, save_graph, save_json, save_tables
from payflux.sources.transactions import read_csv

TABLES = ("nodes", "edges", "node_features", "edge_features", "statistics")


def build_graph(df: DataFrame, config: PreprocessConfig = PreprocessConfig(), is_table: bool = False) -> tuple[TransactionGraph, list[str]]:
    """The graph of numbered transactions with vectors for nodes and edges; and the names of an edge's features. is_table: df is cheap to read again.

    Features of nodes are means over many of an edge's columns, and in a large table few edges of a node are in one task before they are brought
    together. So what travels is what features are made of, not sums of them: an edge's columns go to the node that it leaves, and again to the one
    that it enters, and become features there.
    """
    m = config.columns
    ends = {n: account(F.col(c), config.missing_account) for n, c in (("src", m.source), ("dst", m.destination))}
    needed = (*m.categorical, *m.numeric, m.event_time, m.storage_time)
    kinds = dict(df.dtypes)
    base = E.parsed(df.withColumns(ends).select("edge_id", *ends, *needed), config)
    if not is_table or any(kinds[c] == "string" for c in (*m.numeric, m.event_time, m.storage_time)):  # else numbers and times are read as they are
        base = materialised(base)
    rows = E.feature_rows(base, config, ("edge_id",))
    maker = E.FeatureMaker(rows, config)
    names = maker.names
    whole = base.where(F.col("src").isNotNull() & F.col("dst").isNotNull())  # without a name for missing accounts, edges of one are no edges
    index = whole.select("edge_id", "src", "dst")
    nodes = G.weighted_nodes(index)
    edges = G.weighted_index(index, nodes)
    leaving, entering = (maker.made_at(whole, end) for end in ends)
    nodes = nodes.select("node_id", "account")
    own = N.node_features(leaving, names, ("src", "dst"), "account", entering).join(nodes, "account")
    features = E.feature_array(maker.made(rows, ("edge_id",)), names)
    return TransactionGraph(nodes, edges, E.feature_array(own, N.node_feature_names(len(names)), "node_id"), features), names


def run(spark: SparkSession, df: DataFrame, config: PreprocessConfig = PreprocessConfig()) -> dict:
    """Builds and stores everything under config.output_dir; returns the report, which is stored as well."""
    with temporary_tables(spark):
        return _run(spark, df, config)


def _run(spark: SparkSession, df: DataFrame, config: PreprocessConfig) -> dict:
    began = time.time()
    out, m = config.output_dir, config.columns
    df = materialised(df)  # read for features and for each of the tables
    parsed = E.parsed(df, config)
    graph, names = build_graph(df, config, is_table=True)
    save_graph(graph, out)
    wide = N.node_feature_names(len(names))
    stored = spark.read.parquet(f"{out}/node_features").select("node_id", *(F.col("features")[i].alias(n) for i, n in enumerate(wide)))
    edge_wide = spark.read.parquet(f"{out}/edge_features").select(*(F.col("features")[i].alias(n) for i, n in enumerate(names)))
    index = spark.read.parquet(f"{out}/edges").where(~F.col("is_loop"))
    tables = {
        "basic": statistics.basic(spark.read.parquet(f"{out}/nodes"), index, len(wide), len(names)),
        "degree": statistics.degrees(stored),
        "node_features": statistics.features(stored, wide),
        "edge_features": statistics.features(edge_wide, names),
        "categorical_distribution": statistics.categories(df, list(m.distributions)),
        "amount_distribution": statistics.amounts(df, list(m.amounts), is_table=True),
        "missing": profile.missing_values(df),
        "fills": E.fill_report(parsed, list(m.numeric)),
        "parse_failures": E.parse_failures(parsed, [m.event_time, m.storage_time]),
        "delay": E.delay_statistics(E.with_delay(parsed, config)),
    }
    save_tables(tables, f"{out}/statistics")
    small = {k: [r.asDict() for r in spark.read.parquet(f"{out}/statistics/{k}").collect()] for k in ("basic", "degree", "fills", "parse_failures", "delay")}
    report = {"success": True, "seconds": time.time() - began, "edge_feature_names": names, "node_feature_names": wide, "delay_computed": small["delay"][0]["valid"] > 0, "statistics": small}
    save_json(spark, report, f"{out}/report")
    return report


def check(spark: SparkSession, config: PreprocessConfig, report: dict) -> dict[str, bool]:
    """Seven gates over what run() has stored, and whether all passed."""
    n = len(report["node_feature_names"])
    stored = spark.read.parquet(f"{config.output_dir}/node_features").select(*(F.col("features")[i].alias(f"f{i}") for i in range(n)))
    quality = profile.tensor_quality(stored, stored.columns).agg(F.sum("n_nan").alias("nan"), F.sum("n_inf").alias("inf")).first()
    return profile.gates(
        {
            "success": report["success"],
            "delay_computed": report["delay_computed"],
            "edge_names": bool(report["edge_feature_names"]),
            "node_names": bool(report["node_feature_names"]),
            "files": all(v is not None for v in artifacts(spark, config.output_dir, TABLES).values()),
            "no_nan": quality["nan"] == 0,
            "no_inf": quality["inf"] == 0,
        }
    )


def main(args: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output", default=PreprocessConfig.output_dir)
    p.add_argument("--limit-rows", type=int, default=0, help="0: all")
    p.add_argument("--source", default=ColumnMap.source)
    p.add_argument("--destination", default=ColumnMap.destination)
    a = p.parse_args(args)
    config = PreprocessConfig(ColumnMap(source=a.source, destination=a.destination), a.output, limit_rows=a.limit_rows or None)
    spark = SparkSession.builder.appName("preprocess").getOrCreate()
    return run(spark, read_csv(spark, a.input, config.limit_rows), config)


if __name__ == "__main__":
    print({k: v for k, v in main().items() if k != "statistics"})
