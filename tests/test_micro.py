"""A fixture of seven transactions with expected values worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from payflux.config import COLUMNS, PreprocessConfig
from payflux.functions import quantiles as Q
from payflux.functions.quantiles import quantiles
from payflux.operators import anomalies as A
from payflux.operators import charts as V
from payflux.operators import edges as E
from payflux.operators import graph as G
from payflux.operators import nodes as N
from payflux.operators import statistics as S

ROWS = [
    (0, "A", "B", "WEB", "100", "2024-01-01 10:00:00", "2024-01-01 10:00:30"),
    (1, "A", "B", "WEB", "100", "2024-01-01 10:00:00", "2024-01-01 10:00:30"),
    (2, "B", "A", "APP", "50", "2024-01-02 23:15:00", "2024-01-02 23:14:50"),
    (3, "C", "C", "APP", None, "2024-01-07 00:00:00", "2024-01-07 00:01:00"),
    (4, "A", "D", None, "abc", "2024-01-08 09:00:00", "bad"),
    (5, "D", "B", "WEB", "200", "2024-01-31 12:00:00", "31/01/2024 12:00"),
    (6, "E", "F", "APP", "0", "2024-01-03 08:00:00", "2024-01-03 08:00:01.500"),
]


@pytest.fixture(scope="module")
def tx(spark):
    df = spark.createDataFrame(ROWS, "edge_id bigint, src string, dst string, channel string, amount string, txn string, tds string")
    named = {"payment_channel": "channel", "instructed_amount": "amount", "txn_dt": "txn", "tds_dt": "tds", "debit_account_masked": "src", "bene_account_masked": "dst"}
    return df.select("edge_id", *(F.col(named[c]).alias(c) if c in named else F.lit("x").alias(c) for c in COLUMNS)).cache()


def near(values, expected):
    assert [pytest.approx(e, abs=1e-6) for e in expected] == list(values)


def ordered(df, column, key="edge_id"):
    return [r[0] for r in df.orderBy(key).select(column).collect()]


def test_amounts_fill_and_scale(tx):
    parsed = E.parsed(tx)
    fill = E.fill_report(parsed, ["instructed_amount"]).first()
    assert fill["filled"] == 2
    near([fill["percent"]], [28.571429])
    near(ordered(E.numeric_features(parsed, ["instructed_amount"]), "instructed_amount"), [0.515711, 0.515711, -0.206284, -0.928279, -0.928279, 1.9597, -0.928279])


@pytest.mark.parametrize("text,value", [("1d", None), ("inf", None), ("NaN", None), (" 2.5 ", 2.5), ("1e3", 1000.0), ("", None), ("abc", None)])
def test_number(spark, text, value):
    from payflux.functions.scalars import number

    assert spark.createDataFrame([(text,)], "a string").select(number(F.col("a"))).first()[0] == value


def test_constant_column_is_centred(spark):
    assert ordered(E.numeric_features(spark.createDataFrame([(0, 5.0), (1, 5.0)], "edge_id bigint, a double"), ["a"]), "a") == [0.0, 0.0]


def test_codes(tx):
    assert {r["value"]: r["code"] for r in E.category_codes(tx, "payment_channel").collect()} == {"WEB": 0, "APP": 1, "UNKNOWN": 2}
    info = E.encoding_info(E.category_codes(tx, "payment_channel")).first()
    assert (info["categories"], info["has_unknown"], info["samples"]) == (3, True, "WEB,APP,UNKNOWN")


def test_times_and_delay(tx):
    parsed = E.with_delay(E.parsed(tx))
    df, _ = E.with_time_parts(parsed, ["txn_dt", "tds_dt"])
    assert ordered(df, "txn_dt_dow") == [0, 0, 1, 6, 0, 2, 2]
    row = df.where("edge_id = 4").first()
    assert (row["tds_dt_hour"], row["tds_dt_dow"], row["tds_dt_dom"]) == (0, 0, 1)
    s = E.delay_statistics(parsed).first()
    assert (s["valid"], s["invalid"], s["negative"], s["median"], s["least"], s["greatest"]) == (6, 1, 1, 15.75, -10, 60)
    near([s["mean"], s["std"]], [18.583333, 26.192397])
    near(ordered(E.with_scaled_delay(parsed), "delay_scaled"), [0.533487, 0.533487, -1.271665, 1.88735, -0.109598, -0.820377, -0.752684])


def test_delay_without_valid_times(tx):
    df = E.with_scaled_delay(E.with_delay(E.parsed(tx.withColumn("tds_dt", F.lit("bad")))))
    assert set(ordered(df, "delay_scaled")) == {0.0}


def test_feature_width(tx):
    df, names = E.edge_features(tx)
    assert len(names) == 66 and df.columns == ["edge_id", *names] and df.count() == 7
    _, codes = E.edge_features(tx, PreprocessConfig(encode_categories="code"))
    assert len(codes) == 3 + 7 + 6 + 1


@pytest.fixture(scope="module")
def graph(tx):
    ends = G.endpoints(tx)
    nodes = G.nodes(ends).cache()
    return ends, nodes, G.edge_index(ends, nodes).cache()


def test_ids_and_membership(graph):
    ends, nodes, _ = graph
    assert {r["account"]: r["node_id"] for r in nodes.collect()} == dict(zip("ABCDEF", range(6), strict=True))
    assert tuple(G.membership(ends).first()) == (6, 1, 1, 4)
    assert G.node_of(nodes, "C") == 2 and G.account_of(nodes, 5) == "F" and G.node_of(nodes, "Z") is None


def test_weights(graph):
    _, nodes, edges = graph
    looped = G.looped(edges, nodes)
    out = G.weighted(looped)
    near(ordered(out.where("not is_loop"), "weight"), [0.353553, 0.353553, 0.353553, 0.5, 0.353553, 0.5, 0.707107])
    near(ordered(out.where("is_loop"), "weight", "src_id"), [0.25, 0.5, 0.5, 0.5, 0.5, 1])
    assert tuple(G.graph_meta(nodes, looped).first()) == (6, 7, 13, 1)


def test_nodes(tx, graph):
    _, nodes, edges = graph
    amounts = E.numeric_features(E.parsed(tx), ["instructed_amount"]).select("edge_id", "instructed_amount")
    out = N.node_features(edges.join(amounts, "edge_id"), ["instructed_amount"])
    assert ordered(out, "src_tx_count", "node_id") == [3, 1, 1, 1, 1, 0]
    assert ordered(out, "dst_tx_count", "node_id") == [1, 3, 1, 1, 0, 1]
    ratio = ordered(out, "in_out_ratio", "node_id")
    near(ratio[:5], [0.333333, 3, 1, 1, 0])
    assert ratio[5] == pytest.approx(1e8)
    near(ordered(out, "src_avg_feat_0", "node_id"), [0.034381, -0.206284, -0.928279, 1.9597, -0.928279, 0])
    near(ordered(out, "dst_avg_feat_0", "node_id"), [-0.206284, 0.997041, -0.928279, -0.928279, 0, -0.928279])
    total = S.degrees(out).where("kind = 'total'").first()
    near([total["mean"], total["std"], total["median"], total["q25"], total["q75"]], [2.333333, 1.247219, 2, 1.25, 3.5])
    assert S.degrees(out).where("kind = 'in'").first()["zeros"] == 1
    b = S.basic(nodes, edges, 6, 1).first()
    near([b["density"], b["edges_per_node"]], [0.233333, 1.166667])
    assert b["edges_with_loops"] == 13


def test_distributions(tx):
    c = {r["value"]: r for r in S.categories(tx, ["payment_channel"]).collect()}
    assert set(c) == {"WEB", "APP"} and all(r["count"] == 3 and r["total_unique"] == 2 for r in c.values())
    near([c["WEB"]["percent"]], [42.857143])
    a = S.amounts(tx, ["instructed_amount"]).first()
    near([a[k] for k in ("mean", "std", "median", "q25", "q75", "q95", "q99")], [90, 74.161985, 100, 50, 100, 180, 196])
    assert (a["zeros"], a["negatives"]) == (1, 0)


def test_anomalies(spark, graph):
    edges = graph[2]
    scores = spark.createDataFrame(list(enumerate([0.1, 0.4, 0.2, 0.9, 0.3, 0.5])), "node_id bigint, score double")
    near(ordered(A.edge_scores(edges, scores, "max"), "score"), [0.4, 0.4, 0.4, 0.2, 0.9, 0.9, 0.5])
    near(ordered(A.edge_scores(edges, scores, "mean"), "score"), [0.25, 0.25, 0.25, 0.2, 0.5, 0.65, 0.4])
    top = A.edge_scores(edges, scores)
    near([A.threshold(top).first()[0]], [0.9])
    assert A.classified(top).agg(F.sum("anomaly")).first()[0] == 0  # strictly above, and the top two tie
    assert [r["edge_id"] for r in A.top(top, 2).collect()] == [5, 4]
    assert A.top(top, 0).count() == 0 and A.top(top, 99).count() == 7
    assert A.threshold(top, 0.0).first()[0] == pytest.approx(0.2)
    with pytest.raises(ValueError):
        A.edge_scores(edges, scores, "least")
    assert "above percentile 95: 0 of 7" in A.report(top)


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 2.0], [0.0] * 50 + [1.0, 5.0, None, 7.5], [float(i * 7919 % 1000) for i in range(999)]], ids=len)
def test_quantiles(spark, values):
    at, known = (0.0, 0.25, 0.5, 0.99, 1.0), [v for v in values if v is not None]
    got = quantiles(spark.createDataFrame([(v,) for v in values], "v double").repartition(3), "v", at).collect()
    assert len(got) == 1
    assert list(got[0]["q"]) == (pytest.approx(list(np.quantile(known, at))) if known else [None] * len(at))


def test_quantiles_of_groups(spark):
    rows = [(k, float(i * i % 37)) for k, n in (("a", 300), ("b", 1), ("c", 40)) for i in range(n)] + [("d", None)]
    got = {r["k"]: list(r["q"]) for r in quantiles(spark.createDataFrame(rows, "k string, v double"), "v", (0.5, 0.95), ("k",)).collect()}
    assert got == {k: pytest.approx(list(np.quantile([v for g, v in rows if g == k], (0.5, 0.95)))) for k in "abc"}


@pytest.mark.parametrize(("parts", "few"), [(4096, 1 << 16), (2, 1), (5, 7)])
def test_quantiles_are_narrowed(spark, monkeypatch, parts, few):
    """The same values however finely ranges are cut; infinities stand at the ends, NaN behind them."""
    monkeypatch.setattr(Q, "PARTS", parts)
    monkeypatch.setattr(Q, "FEW", few)
    rng = np.random.default_rng(2)
    values = [*rng.standard_normal(60), *[1e308, -1e308, 5e-324, 0.0, -0.0, 0.0], *[3.25] * 20, float("inf"), float("-inf"), float("-inf")]
    at = tuple(float(k) / (len(values) - 1) for k in range(len(values)))
    df = spark.createDataFrame([(float(v), "a") for v in values] + [(float("nan"), "b"), (1.0, "b"), (None, "c")], "v double, k string").repartition(3)
    got = {r["k"]: list(r["q"]) for r in quantiles(df, "v", at, ("k",)).collect()}
    assert got.keys() == {"a", "b"} and got["b"][0] == 1.0 and np.isnan(got["b"][-1])
    np.testing.assert_allclose(got["a"], np.sort(np.array(values)), rtol=1e-6)  # shares of ranks are rounded


def test_quantiles_refuse_many_groups(spark):
    with pytest.raises(ValueError, match="groups"):
        quantiles(spark.range(300).selectExpr("id", "id as v"), "v", (0.5,), ("id",))


def test_two_axes(spark):
    """All nodes, on the axes that a decomposition of the whole matrix gives."""
    rng = np.random.default_rng(4)
    m = rng.standard_normal((300, 5)) * [5, 3, 1, 0.5, 0.1] + [9, 0, -2, 1, 1]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [None] * 5)], "node_id bigint, h array<double>").repartition(3)
    got = {r["node_id"]: (r["x"], r["y"]) for r in V.two_axes(df).collect()}
    centred = m - m.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:2] * np.sign(axes[:2][np.arange(2), np.abs(axes[:2]).argmax(axis=1)])[:, None]
    np.testing.assert_allclose([got[i] for i in range(300)], centred @ axes.T, atol=1e-8)
    assert len(got) == 300 and V.two_axes(df.limit(0)).count() == 0
    one = V.two_axes(spark.createDataFrame([(1, [2.0])], "node_id bigint, h array<double>")).first()
    assert (one["x"], one["y"]) == (0.0, 0.0)
