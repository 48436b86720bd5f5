"""A third and more of all edges at one account: no task gets them whole."""

import pytest
from pyspark.sql import functions as F

from payflux.functions.hubs import with_node_values
from payflux.operators import graph as G

PARTS = 16


@pytest.fixture
def shuffled(spark):
    """Joins shuffle, and partitions are as they were dealt out."""
    conf = {"spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def edges(spark, n=40_000):
    """Three quarters of all edges end, and one third begin, at node 0."""
    dst = F.when(F.col("id") % 4 < 3, 0).otherwise(F.col("id") % 997).cast("long")
    src = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1009).cast("long")
    return spark.range(n).select(F.col("id").alias("edge_id"), src.alias("src_id"), dst.alias("dst_id"), F.lit(False).alias("is_loop"))


def greatest_part(df):
    rows = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(rows) / sum(rows)


def test_a_plain_join_brings_a_hub_together(shuffled):
    e = edges(shuffled)
    nodes = e.groupBy(F.col("dst_id").alias("node_id")).agg(F.count("*").alias("degree"))
    assert greatest_part(e.join(nodes, e["dst_id"] == nodes["node_id"])) > 0.7
    cut = with_node_values(e, "dst_id", nodes, ["degree"], "degree")
    assert greatest_part(cut) < 2 / PARTS
    expected = {r["node_id"]: r["degree"] for r in nodes.collect()}
    assert all(r["degree"] == expected[r["dst_id"]] for r in cut.collect())


def test_weighted_cuts_hubs(shuffled):
    out = G.weighted(edges(shuffled))
    assert greatest_part(out) < 2 / PARTS
    rows = out.collect()
    degrees = {}
    for r in rows:
        degrees[r["src_id"]] = degrees.get(r["src_id"], 0) + 1
    inverse = lambda k: degrees[k] ** -0.5 if k in degrees else 0.0
    assert len(rows) == 40_000 and all(r["weight"] == pytest.approx(inverse(r["src_id"]) * inverse(r["dst_id"])) for r in rows[::97])


def test_unknown_nodes_are_null(spark):
    e = spark.createDataFrame([(0, 5), (1, 6), (2, 5)], "edge_id bigint, dst_id bigint")
    nodes = spark.createDataFrame([(5, 2, "x")], "node_id bigint, degree bigint, name string")
    for hubs in (1, 4096):
        got = {r["edge_id"]: r["name"] for r in with_node_values(e, "dst_id", nodes, ["name"], "degree", hubs=hubs).collect()}
        assert got == {0: "x", 1: None, 2: "x"}
