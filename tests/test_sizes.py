"""What grows with the tables: how often links and nodes are shuffled, and how often states are sent."""

import numpy as np
import pyarrow as pa
import pytest

from payflux.models.masked import Draw
from payflux.operators import blocks as B
from payflux.operators import edges as E
from payflux.operators import graph as G
from payflux.operators import nodes as N
from payflux.plans import model_queries as MQ
from payflux.plans import detect, preprocess, training
from payflux.sources import driver as D


def test_links_are_shuffled_once_for_a_pass(spark, capsys):
    features = spark.range(40).selectExpr("id as node_id", "array(id * 0.1, 1.0, 2.0, id * 1.0, 3.0, 0.5) as features")
    edges = spark.range(300).selectExpr("id % 33 as src_id", "(id * 7) % 11 as dst_id")
    model = MQ.seeded(MQ.PLAIN)
    graph, draw = B.partitioned(features, edges, 16, 80, block_bytes=2000, most_links=20), Draw(40, ((42, 0),), True)
    stages = B.stages(model, draw, "gradients")
    session = B.session_for(graph)
    B.passed(session, graph, session.sparkContext.broadcast((model, draw)), stages).explain()
    plan = capsys.readouterr().out
    # messages of all stages but the first; nodes and links
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= len(stages) - 1 + 3
    assert plan.count("FileScan parquet") <= 3


def test_few_targets_have_few_bands():
    n, links, sources, targets = 5_760_000, 216_000_000, 5_400_000, 360_000
    rows, columns, most = B.grid_of(n, links, sources, targets, 16, B.BLOCK_BYTES, B.MOST_LINKS)
    assert rows * columns * most >= links and rows * B.BLOCK_BYTES >= n * 16 * 8 and columns * B.BLOCK_BYTES >= targets * 16 * 8
    assert sources * columns + targets * rows < 60_000_000  # a square of 22 bands: 100 million and more
    rows, columns, _ = B.grid_of(n, links, n, n, 16, B.BLOCK_BYTES, B.MOST_LINKS)
    assert rows == columns
    assert B.grid_of(1, 1, 0, 0, 16, B.BLOCK_BYTES, B.MOST_LINKS)[:2] == (1, 1)


def test_lines_are_not_sorted_for_a_model(spark):
    _, edges = MQ.model_graph(spark, "/root/testdata/sf0.001", MQ.CONFIG)
    assert edges.columns == ["src_id", "dst_id"]
    assert MQ.model_graph(spark, "/root/testdata/sf0.001", MQ.CONFIG, number_rows=True)[1].columns == ["edge_id", "src_id", "dst_id"]


def test_a_model_trains_on_them(spark):
    _, edges = MQ.model_graph(spark, "/root/testdata/sf0.001", MQ.CONFIG)
    assert edges.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert training.graph_for(MQ.seeded(MQ.GCN), *MQ.model_graph(spark, "/root/testdata/sf0.001", MQ.CONFIG)).blocks == 1


def test_no_join_carries_the_features_of_edges(spark, capsys):
    df = D.transactions(spark, "/root/testdata/sf0.001", number_rows=True, nulls=True)
    graph, names = preprocess.build_graph(df)
    graph.node_features.explain()
    plan = capsys.readouterr().out
    joins = [line for line in plan[plan.rindex("== Physical Plan ==") :].splitlines() if "Join" in line]
    # what leaves with what enters, and the ids of nodes; none by the number of an edge
    assert joins and not any("edge_id" in line for line in joins), joins
    assert graph.node_features.count() == graph.nodes.count()


def test_edges_meet_the_scores_of_their_ends_once(spark, capsys):
    features = spark.range(40).selectExpr("id as node_id", "array(id * 0.1, 1.0, 2.0, id * 1.0, 3.0, 0.5) as features")
    edges = spark.range(300).selectExpr("id as edge_id", "id % 33 as src_id", "(id * 7) % 11 as dst_id")
    _, scores, report = detect.detect(MQ.seeded(MQ.GCN), features, edges)
    scores.explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and scores.count() == 300 and "of 300" in report


def test_targets_as_a_table_of_their_own_give_the_same_edges(spark):
    ends = spark.createDataFrame([("a", "x", 0), ("b", "x", 1), ("a", "y", 2)], "src string, dst string, edge_id bigint")
    nodes = spark.createDataFrame([("a", 0), ("b", 1), ("x", 2), ("y", 3)], "account string, node_id bigint")
    found = [sorted(map(tuple, G.edge_index(ends, nodes, t).collect())) for t in (None, nodes.where("account >= 'x'"))]
    assert found[0] == found[1] == [(0, 0, 2), (1, 1, 2), (2, 0, 3)]


@pytest.mark.parametrize("config", [MQ.GAT, MQ.PLAIN], ids=["gat", "gcn"])
def test_loops_stay_where_they_are(spark, config):
    """Of 40 nodes 7 have links from others: only they are answered, and only their answers are handed on."""
    features = spark.range(40).selectExpr("id as node_id", "array(id * 0.1, 1.0, 2.0, id * 1.0, 3.0, 0.5) as features")
    edges = spark.range(300).selectExpr("id % 33 as src_id", "33 + id % 7 as dst_id")
    model, draw = MQ.seeded(config), Draw(40, ((42, 0),), True)
    graph = B.partitioned(features, edges, 16, 80, block_bytes=2000, most_links=20)
    table, seen = graph.table.toArrow(), set()
    for name, at in B.stages(model, draw, "gradients"):
        keys = table.column("key").to_numpy()
        table = pa.concat_tables([B.Group(int(k), table.filter(pa.array(keys == k)), graph.blocks, model, draw).stage(name, at) for k in np.unique(keys)])
        rows = B.Rows(table)
        for kind in rows.kinds:
            if kind in ("as_target", "target", "part", "degree_part") or kind.startswith("answer"):
                seen.add(kind)
                assert set(rows.ids(kind)) <= set(range(33, 40)), kind
    assert {"target", "part", "answer0"} <= seen


def test_bands_are_those_for_which_least_is_sent():
    n, links, sources, targets = 5_760_000, 216_000_000, 5_400_000, 360_000
    rows, columns, _ = B.grid_of(n, links, sources, targets, 16, B.BLOCK_BYTES, B.MOST_LINKS, 12)
    assert sources * columns + targets * rows < 15_000_000  # cells of a million links: 46 million
    assert B.grid_of(16_000, 600_000, 15_000, 1_000, 16, B.BLOCK_BYTES, B.MOST_LINKS, 3)[0] >= 3  # as many cells as it is worth having


def test_cells_work_on_pieces(spark, monkeypatch):
    features = spark.range(40).selectExpr("id as node_id", "array(id * 0.1, 1.0, 2.0, id * 1.0, 3.0, 0.5) as features")
    edges = spark.range(300).selectExpr("id % 33 as src_id", "(id * 7) % 11 as dst_id")
    model, draw, found = MQ.seeded(MQ.GAT), Draw(40, ((42, 0),), True), []
    for most in (1 << 20, 6):  # values of a row; a cell's links are one piece, or pieces of three
        monkeypatch.setattr(B, "ROW_VALUES", most)
        graph = B.partitioned(features, edges, 16, 80)
        table, pieces = graph.table.toArrow(), graph.table.where("kind = 'links'").count()
        for name, at in B.stages(model, draw, "gradients"):
            keys = table.column("key").to_numpy()
            table = pa.concat_tables([B.Group(int(k), table.filter(pa.array(keys == k)), graph.blocks, model, draw).stage(name, at) for k in np.unique(keys)])
        sums = {}
        for row in table.to_pylist():
            sums[row["kind"]] = np.concatenate([sums.get(row["kind"], np.zeros(0)), np.frombuffer(row["x"])])
        found.append((pieces, sums))
    (one, expected), (many, sums) = found
    assert one < many and sums.keys() == expected.keys()
    for kind, x in sums.items():
        np.testing.assert_allclose(x, expected[kind], atol=1e-9, err_msg=kind)


def test_rows_and_not_sums_go_to_nodes(spark, capsys):
    """Features of nodes are those by sums of the features of edges, and the rows of a node meet before they become features."""
    df = D.transactions(spark, "/root/testdata/sf0.001", number_rows=True, nulls=True)
    graph, names = preprocess.build_graph(df)
    graph.node_features.explain()
    plan = capsys.readouterr().out
    assert plan.count("REBALANCE_PARTITIONS_BY_COL") >= 2
    features, same = E.edge_features(df.withColumnsRenamed({"debit_account_masked": "src", "bene_account_masked": "dst"}), keep=("src", "dst"))
    assert names == same
    wide = N.node_feature_names(len(names))
    expected = {r["account"]: [r[c] for c in wide] for r in N.node_features(features, names, ("src", "dst"), "account").collect()}
    got = {r["account"]: r["features"] for r in graph.node_features.join(graph.nodes, "node_id").collect()}
    assert got.keys() == expected.keys()
    for name, values in expected.items():
        np.testing.assert_allclose(got[name], values, atol=1e-9, err_msg=name)


def test_weights_come_with_the_ids(spark):
    ends = spark.createDataFrame([(0, "a", "x"), (1, "b", "x"), (2, "a", "y"), (3, "a", "a"), (4, "y", "b"), (5, "a", "x")], "edge_id bigint, src string, dst string")
    nodes = G.weighted_nodes(ends)
    key = lambda r: (r["edge_id"] is None, r["edge_id"] or 0, r["src_id"])
    found = sorted(G.weighted_index(ends, nodes).collect(), key=key)
    plain = G.nodes(ends)
    assert sorted(map(tuple, nodes.select("node_id", "account").collect())) == sorted(map(tuple, plain.collect()))
    assert found == sorted(G.weighted(G.looped(G.edge_index(ends, plain), plain)).collect(), key=key)


@pytest.mark.parametrize("most", [1 << 62, 10])
def test_categories_are_packed(spark, most):
    df = spark.range(60).selectExpr("id as edge_id", "if(id % 7 = 0, null, concat('m', id % 5)) as mop", "concat('c', id % 9) as payment_channel")
    tables, _ = E.category_tables(df, ["mop", "payment_channel"])
    packed, words, numbers = E.packed_categories(df, tables, most=most)
    assert packed.columns == ["edge_id", *words] and len(words) == (1 if most > 10 else 2)
    found = E.joined_categories(packed, tables, numbers=numbers).orderBy("edge_id").drop(*words).collect()
    assert found == E.joined_categories(df, tables).orderBy("edge_id").drop("mop", "payment_channel").collect() and len(found) == 60
