"""From scores of nodes to ranked, classified and summarised anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payflux.functions.numbering import materialised
from payflux.functions.quantiles import with_quantiles

STRATEGIES = {"max": lambda a, b: F.greatest(a, b), "mean": lambda a, b: (a + b) / 2, "sum": lambda a, b: a + b}


def edge_scores(edges: DataFrame, node_scores: DataFrame, strategy: str = "max") -> DataFrame:
    """edge_id, src_id, dst_id and score of each edge that is no added loop, from the scores of its ends."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    if "is_loop" in edges.columns:
        edges = edges.where(~F.col("is_loop"))
    s = node_scores.select(F.col("node_id").alias("src_id"), F.col("score").alias("s"))
    d = node_scores.select(F.col("node_id").alias("dst_id"), F.col("score").alias("d"))
    return edges.join(s, "src_id").join(d, "dst_id").select("edge_id", "src_id", "dst_id", STRATEGIES[strategy](F.col("s"), F.col("d")).alias("score"))


def top(scores: DataFrame, k: int = 100, key: str = "edge_id") -> DataFrame:
    """The k greatest scores, ties by the greater key; none for k = 0, all if k is more than there are."""
    return scores.orderBy(F.col("score").desc(), F.col(key).desc()).limit(k)


def threshold(scores: DataFrame, p: float = 95.0) -> DataFrame:
    """One row: the percentile p, interpolated. Scores are computed once, into a table."""
    return _threshold(materialised(scores.select("score")), p)


def _threshold(scores: DataFrame, p: float) -> DataFrame:
    return with_quantiles(scores.sparkSession.range(1).select(), scores, "score", {"threshold": p / 100})


def classified(scores: DataFrame, p: float = 95.0, at: float | None = None) -> DataFrame:
    """scores with anomaly: 1 where a score is strictly above the threshold."""
    if at is None:
        scores = materialised(scores)
    limit = _threshold(scores, p) if at is None else scores.sparkSession.range(1).select(F.lit(float(at)).alias("threshold"))
    return scores.crossJoin(F.broadcast(limit)).withColumn("anomaly", (F.col("score") > F.col("threshold")).cast("int")).drop("threshold")


def statistics(scores: DataFrame) -> DataFrame:
    """One row: count, mean, std (of all), least, greatest, median, p90, p95, p99."""
    scores = materialised(scores.select("score"))
    whole = scores.agg(F.count("*").alias("count"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("least"), F.max("score").alias("greatest"))
    return with_quantiles(whole, scores, "score", {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def top_k_analysis(scores: DataFrame, k_values: tuple[int, ...] = (10, 20, 50, 100, 200, 500), key: str = "edge_id") -> DataFrame:
    """k, ids, mean and least of the k greatest scores, for each k. One top-k of the greatest k, ranked on its rows alone."""
    ranked = top(scores, max(k_values), key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.col(key)).alias("i")))).alias("all"))
    entries = ranked.select(F.explode(F.array(*(F.lit(k) for k in k_values))).alias("k"), "all").withColumn("all", F.slice("all", 1, F.col("k")))
    values = F.transform("all", lambda x: -x["s"])
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size("all")
    return entries.select("k", F.concat_ws(",", F.transform("all", lambda x: (-x["i"]).cast("string"))).alias("ids"), mean.alias("mean"), F.array_min(values).alias("least"))


def summary(node_scores: DataFrame, scores: DataFrame, p: float = 95.0, stored: bool = False, sizes: bool = False) -> DataFrame:
    """One row: threshold, anomalies, share, and mean and deviation of both levels.

    stored: scores are a table, which is read as it is and not written again. sizes: nodes and edges too, how many scores each level has.
    """
    scores = scores.select("score") if stored else materialised(scores.select("score"))
    limit = _threshold(scores, p)
    size = lambda name: [F.count("*").alias(name)] if sizes else []
    edges = scores.crossJoin(F.broadcast(limit)).agg(
        F.first("threshold").alias("threshold"), F.count_if(F.col("score") > F.col("threshold")).alias("anomalies"),
        (F.count_if(F.col("score") > F.col("threshold")) / F.count("*")).alias("share"), F.avg("score").alias("edge_mean"), F.stddev_pop("score").alias("edge_std"), *size("edges"),
    )
    return edges.crossJoin(F.broadcast(node_scores.agg(F.avg("score").alias("node_mean"), F.stddev_pop("score").alias("node_std"), *size("nodes"))))


def report(scores: DataFrame, p: float = 95.0) -> str:
    scores = scores.select("score")
    s, c = statistics(scores).first().asDict(), classified(scores, p).agg(F.sum("anomaly").alias("n"), F.count("*").alias("all"), F.min(F.when(F.col("anomaly") == 1, F.col("score"))).alias("from")).first()
    lines = [f"{k}: {v}" for k, v in s.items()]
    return "\n".join([*lines, f"above percentile {p:g}: {c['n']} of {c['all']}, scores from {c['from']}"])
