"""From a stored graph to ranked anomalies: training, scoring, thresholds and reports."""

from __future__ import annotations

import argparse
import io
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payflux.config import MainConfig
from payflux.functions.numbering import materialised, temporary_tables
from payflux.operators import anomalies as A
from payflux.operators import charts as V
from payflux.operators.blocks import BlockGraph
from payflux.plans import training
from payflux.sources.store import load_graph, load_json, next_run, save_bytes, save_json, save_tables


def detect(
    model: training.Model, features: DataFrame, edges: DataFrame, config: MainConfig = MainConfig(), level: str = "edge", graph: BlockGraph | None = None
) -> tuple[DataFrame, DataFrame, str]:
    """Scores of nodes, scores of edges, and a report on the level asked for. graph: that of features and edges, if it is partitioned already."""
    if config.anomaly.node_scores == "sampled":
        node_scores = training.sampled_scores(model, features, edges, config.anomaly.num_samples, config.seed)
    elif config.anomaly.node_scores == "error":
        node_scores = training.node_errors(model, features, edges, graph)
    else:
        raise ValueError(f"unknown node scores: {config.anomaly.node_scores}")
    # written, as the report and the caller read them: else edges would meet the scores of their ends each time
    edge_scores = materialised(A.edge_scores(edges, node_scores, config.anomaly.edge_score_strategy))
    chosen = edge_scores if level == "edge" else node_scores
    return node_scores, edge_scores, A.report(chosen, config.anomaly.threshold_percentile)


def run(spark: SparkSession, config: MainConfig = MainConfig()) -> dict:
    """Trains on the graph under config.preprocessed_dir and writes scores, tables and a summary to a new directory."""
    with temporary_tables(spark):
        return _run(spark, config)


def _run(spark: SparkSession, config: MainConfig) -> dict:
    graph = load_graph(spark, config.preprocessed_dir)
    edges = graph.edges.where(~F.col("is_loop"))
    model = training.build(config.model, len(graph.node_features.first()["features"]), config.seed)
    blocks = training.graph_for(model, graph.node_features, edges)
    history = training.fit(model, graph.node_features, edges, config.train, config.seed, config.checkpoints, blocks)
    out = next_run(spark, config.output_dir)
    node_scores, edge_scores, text = detect(model, graph.node_features, edges, config, graph=blocks)
    p = config.anomaly.threshold_percentile
    save_tables({"node_scores": node_scores, "edge_scores": edge_scores, "embeddings": training.embeddings(model, graph.node_features, edges, blocks)}, out)
    scores, own = spark.read.parquet(f"{out}/edge_scores"), spark.read.parquet(f"{out}/node_scores")
    tables = {
        "training_loss": spark.createDataFrame(history, "epoch int, loss double"),
        "top": A.top(scores), "top_k": A.top_k_analysis(scores, config.anomaly.top_k_values), "score_histogram": V.histogram(scores), "score_box": V.box(scores),
        "node_histogram": V.histogram(own), "degree_against_score": V.degree_against_score(edges, own), "percentiles": V.percentiles(scores),
        "two_axes": V.two_axes(spark.read.parquet(f"{out}/embeddings")),
    }
    save_tables(tables, f"{out}/tables")
    weights = io.BytesIO()
    training.save(model, weights, history)
    save_bytes(spark, weights.getvalue(), f"{out}/model.npz")
    summary = A.summary(own, scores, p, stored=True).first().asDict() | {
        "config": asdict(config), "parameters": training.parameters(model), "epochs": len(history), "report": text,
        "top": [r.asDict() for r in A.top(scores, 100).collect()], "preprocessing": load_json(spark, f"{config.preprocessed_dir}/report") is not None,
    }
    save_json(spark, summary, f"{out}/summary")
    return summary | {"output": out}


def main(args: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(description=__doc__)
    d = MainConfig()
    p.add_argument("--input", default=d.preprocessed_dir)
    p.add_argument("--output", default=d.output_dir)
    p.add_argument("--epochs", type=int, default=d.train.epochs)
    p.add_argument("--encoder", default=d.model.encoder_type)
    p.add_argument("--decoder", default=d.model.decoder_type)
    p.add_argument("--hidden", type=int, default=d.model.hidden_channels)
    p.add_argument("--out", type=int, default=d.model.out_channels)
    p.add_argument("--percentile", type=float, default=d.anomaly.threshold_percentile)
    p.add_argument("--checkpoints", default=d.checkpoints, help="a folder that training goes on from")
    p.add_argument("--seed", type=int, default=d.seed)
    a = p.parse_args(args)
    config = MainConfig(
        replace(d.model, encoder_type=a.encoder, decoder_type=a.decoder, hidden_channels=a.hidden, out_channels=a.out),
        replace(d.train, epochs=a.epochs), replace(d.anomaly, threshold_percentile=a.percentile), a.input, a.output, a.checkpoints, a.seed,
    )
    return run(SparkSession.builder.appName("detect").getOrCreate(), config)


if __name__ == "__main__":
    print(main()["report"])
