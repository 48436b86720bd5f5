"""Passes over blocks against dense arithmetic and finite differences; training, its checkpoints, and scores."""

import time

import dense
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from payflux.config import ModelConfig, ParameterGroup, TrainConfig
from payflux.functions import draws
from payflux.models import masked as M
from payflux.models import tape
from payflux.operators import blocks as B
from payflux.operators.masking import masked
from payflux.operators.message_passing import Layer, coefficients, projected
from payflux.plans import training as T
from payflux.sources import store

N = 11
EDGES = [(0, 1), (0, 1), (1, 2), (2, 0), (3, 3), (3, 1), (4, 2), *((i, 5) for i in range(N)), *((5, i) for i in range(0, N, 2)), (9, 10), (9, 10), (9, 10)]


def graph(spark, n=N, width=3):
    x = np.random.default_rng(1).standard_normal((n, width))
    features = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id bigint, features array<double>")
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(EDGES)], "edge_id bigint, src_id bigint, dst_id bigint")
    return features, edges


@pytest.fixture(scope="module")
def parts(spark):
    """The graph in one block; in several blocks and cells, a hub's links in more than one; and so finely that each link is a cell."""
    features, edges = graph(spark)
    return B.partitioned(features, edges, 1, 1), B.partitioned(features, edges, 3, 5, block_bytes=100, most_links=3), B.partitioned(features, edges, 50, 5, block_bytes=100)


def arrays(spark):
    x = np.random.default_rng(1).standard_normal((N, 3))
    e = np.array([(a, b) for a, b in EDGES if a != b] + [(i, i) for i in range(N)])
    return x, e[:, 0], e[:, 1]


def run_here(table: pa.Table, blocks: int, model, draw, ending):
    """The stages of a pass, with groupings in memory."""
    for name, at in B.stages(model, draw, ending):
        keys = table.column("key").to_numpy()
        table = pa.concat_tables([B.Group(int(k), table.filter(pa.array(keys == k)), blocks, model, draw).stage(name, at) for k in np.unique(keys)])
    return table


def gradients_here(table, blocks, model, draw):
    sums = {}
    for r in run_here(table, blocks, model, draw, "gradients").to_pylist():
        if r["kind"] == "loss" or r["kind"].startswith("gradient:"):
            sums[r["kind"]] = sums.get(r["kind"], 0) + np.frombuffer(r["x"])
    return float(sums["loss"][0]), [{n: sums[f"gradient:{k}.{n}"].reshape(v.shape) for n, v in p.items()} for k, p in enumerate(model.params)]


def stirred(model):
    """Biases that aren't 0: else a node without neighbours, hidden from the decoder, gets a zero vector."""
    rng = np.random.default_rng(9)
    for p in model.params:
        for name in ("b", "beta"):
            if name in p:
                p[name] = rng.standard_normal(p[name].shape)
    return model


PLAIN = {"dropout": 0.0, "attn_drop": 0.0, "hidden_channels": 4, "out_channels": 3, "num_heads": 2, "replace_rate": 0.4}
CONFIGS = [
    ModelConfig(encoder_type=e, decoder_type=d, loss_fn=loss, **PLAIN) for e, d, loss in (("gat", "gat", "sce"), ("gcn", "gcn", "mse"), ("gat", "mlp", "sce"), ("gcn", "linear", "sce"))
]


def test_graph_is_cut(spark, parts):
    one, many, fine = parts
    assert fine.blocks > many.blocks and all(len(r["ids"]) // 8 < 5 for r in fine.table.where("kind = 'links'").collect())
    assert one.blocks == 1 and many.blocks > 2
    cells = [r for r in many.table.where("kind = 'links'").collect()]
    assert len(cells) > 9 and all(len(r["ids"]) // 8 <= 12 for r in cells)  # a square of links is dealt out by a hash
    assert sum(1 for r in cells if 5.0 in np.frombuffer(r["x"]).reshape(-1, 2)[:, 0]) > 2  # the hub's links are in several
    for bad in ([(1, [1.0])], [(0, [1.0]), (2, [1.0])], []):
        with pytest.raises(ValueError, match="must be 0"):
            B.partitioned(spark.createDataFrame(bad, "node_id bigint, features array<double>"), graph(spark)[1], 1, 1)


@pytest.mark.parametrize("config", CONFIGS, ids=lambda c: f"{c.encoder_type}-{c.decoder_type}")
@pytest.mark.parametrize("which", [0, 1, 2])
def test_gradients_agree_with_dense(spark, parts, config, which):
    x, src, dst = arrays(spark)
    model, draw = stirred(T.build(config, 3)), M.Draw(N, ((7, 0),), training=True)
    value, grads = gradients_here(parts[which].table.toArrow(), parts[which].blocks, model, draw)
    counts, place = M.Counts.of(N, config), draws.place(np.arange(N), N, 7, 0, 1)
    order, seen = np.argsort(place), x.copy()
    seen[order[: counts.tokens]] = model.params[-1]["token"]
    givers = np.argsort(draws.place(np.arange(N), N, 7, 0, 5))[: counts.noise]
    seen[order[counts.masked - counts.noise : counts.masked]] = x[givers]
    assert (counts.masked, counts.tokens, counts.noise) == (5, 3, 2)
    expected, dense_grads = dense.loss_and_gradients(model, x, src, dst, seen, order[: counts.masked], order[: counts.tokens])
    assert value == pytest.approx(expected)
    for got, want in zip(grads, dense_grads, strict=True):
        assert got.keys() == want.keys()
        for name in want:
            np.testing.assert_allclose(got[name], want[name], atol=1e-9)


OPTIONS = {
    "dropout": {"dropout": 0.2, "attn_drop": 0.2},
    "edges dropped": {"drop_edge_rate": 0.4},
    "residual": {"residual": True},
    "concatenated": {"concat_hidden": True},
    "layernorm": {"norm": "layernorm"},
    "batchnorm": {"norm": "batchnorm"},
    "gelu": {"activation": "gelu"},
    "elu, slope": {"activation": "elu", "negative_slope": 0.05},
    "tanh, three layers": {"activation": "tanh", "num_layers": 3},
    "all": {"dropout": 0.2, "attn_drop": 0.2, "drop_edge_rate": 0.3, "residual": True, "concat_hidden": True, "norm": "batchnorm", "activation": "sigmoid"},
}


@pytest.mark.parametrize("kinds", [("gat", "gat"), ("gcn", "gcn"), ("gat", "mlp")], ids="-".join)
@pytest.mark.parametrize("option", OPTIONS)
def test_gradients_agree_with_differences(parts, option, kinds):
    """The loss and its gradients are the same in one block and in many; the latter agree with finite differences."""
    config = ModelConfig(*kinds, **(PLAIN | OPTIONS[option]))
    model, draw = stirred(T.build(config, 3)), M.Draw(N, ((3, 1),), training=True)
    tables = [(p.table.toArrow(), p.blocks) for p in parts[:2]]
    (one, _), (value, grads) = (gradients_here(*t, model, draw) for t in tables)
    assert value == pytest.approx(one, rel=1e-9)
    rng = np.random.default_rng(5)
    for k, p in enumerate(model.params):
        for name in p:
            at = tuple(int(rng.integers(0, s)) for s in p[name].shape)
            old, found, eps = p[name][at], [], 1e-6
            for x in (old + eps, old - eps):
                p[name][at] = x
                found.append(gradients_here(*tables[0], model, draw)[0])
            p[name][at] = old
            assert grads[k][name][at] == pytest.approx((found[0] - found[1]) / (2 * eps), abs=2e-5), (k, name)


def test_spark_runs_the_same_stages(spark, parts):
    """One job for loss and gradients, whatever the graph's blocks."""
    model = stirred(T.build(ModelConfig(norm="batchnorm", **(PLAIN | {"dropout": 0.2})), 3))
    draw = M.Draw(N, ((3, 1),), training=True)
    expected, grads = gradients_here(parts[0].table.toArrow(), parts[0].blocks, model, draw)
    for part in parts[:2]:
        spark.sparkContext.setJobGroup("pass", "one pass")
        value, got, moments = B.gradients(B.session_for(part), part, model, draw)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert value == pytest.approx(expected) and set(moments) == {0, 1}
        for a, b in zip(got, grads, strict=True):
            for name in b:
                np.testing.assert_allclose(a[name], b[name], atol=1e-9)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("pass")) == 2


@pytest.mark.parametrize("config", CONFIGS, ids=lambda c: f"{c.encoder_type}-{c.decoder_type}")
def test_scores_agree_with_dense(spark, parts, config):
    x, src, dst = arrays(spark)
    model = stirred(T.build(config, 3))
    out, _ = dense.forward(model, x, src, dst)
    for part in parts:
        got = {r["node_id"]: r["score"] for r in T.node_errors(model, None, None, part).collect()}
        np.testing.assert_allclose([got[i] for i in range(N)], M.errors(out, x), atol=1e-9)
    width = len(T.embeddings(model, None, None, part).first()["h"])
    assert width == config.out_channels


def test_sampled_scores(spark, parts):
    """The mean over samples drawn one by one; exchanges don't grow with the samples."""
    model = stirred(T.build(CONFIGS[0], 3))
    here = lambda key: run_here(parts[1].table.toArrow(), parts[1].blocks, model, M.Draw(N, (key,)), "errors")
    total = np.zeros(N)
    for k in range(3):
        for r in (r for r in here((42, k)).to_pylist() if r["kind"] == "out"):
            total[np.frombuffer(r["ids"], np.int64)] += np.frombuffer(r["x"]) / 3
    got = {r["node_id"]: r["score"] for r in T.sampled_scores(model, None, None, 3, graph=parts[1]).collect()}
    np.testing.assert_allclose([got[i] for i in range(N)], total, atol=1e-9)
    lengths = {len(B.stages(model, M.Draw(N, tuple((0, k) for k in range(s))), "errors")) for s in (1, 10)}
    assert len(lengths) == 1


def test_kept_moments_score(spark, parts):
    model = stirred(T.build(ModelConfig(norm="batchnorm", **PLAIN), 3))
    T.fit(model, None, None, TrainConfig(epochs=2), graph=parts[0])
    assert all(np.any(m["mean"] != 0) and np.any(m["var"] != 1) for m in model.moments.values())
    before = T.node_errors(model, None, None, parts[0]).orderBy("node_id").collect()
    model.moments[0]["mean"] += 1.0
    assert before != T.node_errors(model, None, None, parts[0]).orderBy("node_id").collect()


def test_training_falls_and_reruns_agree(spark, parts):
    found = []
    for part in parts:
        model = T.build(CONFIGS[1], 3)
        found.append(T.fit(model, None, None, TrainConfig(epochs=8, learning_rate=0.05), graph=part))
    assert min(v for _, v in found[0]) < found[0][0][1]
    np.testing.assert_allclose(found[0], found[1], rtol=1e-6)


def test_training_agrees_with_dense(spark, parts):
    """Losses of six epochs, and the weights after them, against the same steps on whole matrices."""
    x, src, dst = arrays(spark)
    config, model, other = TrainConfig(epochs=6, learning_rate=0.02, patience=9), stirred(T.build(CONFIGS[0], 3)), stirred(T.build(CONFIGS[0], 3))
    history = T.fit(model, None, None, config, graph=parts[1])
    optimizer, progress, counts = T.Optimizer(config.optimizer, config.weight_decay), T.Progress(), M.Counts.of(N, CONFIGS[0])
    for epoch in range(config.epochs):
        order, seen = np.argsort(draws.place(np.arange(N), N, 42, epoch, 1)), x.copy()
        seen[order[: counts.tokens]] = other.params[-1]["token"]
        seen[order[counts.masked - counts.noise : counts.masked]] = x[np.argsort(draws.place(np.arange(N), N, 42, epoch, 5))[: counts.noise]]
        found = dense.loss_and_gradients(other, x, src, dst, seen, order[: counts.masked], order[: counts.tokens])
        T._advanced(other, optimizer, progress, (*found, {}), N, config)
    np.testing.assert_allclose(history, progress.history, rtol=1e-7)
    for got, want in zip(model.params, progress.best_params, strict=True):
        for name in want:
            np.testing.assert_allclose(got[name], want[name], atol=1e-7)


def test_an_epoch_is_quick(spark, parts):
    model = T.build(CONFIGS[1], 3)
    T.fit(model, None, None, TrainConfig(epochs=1), graph=parts[0])
    began = time.time()
    T.fit(model, None, None, TrainConfig(epochs=3), graph=parts[0])
    assert time.time() - began < 15


def test_resumed_training_is_the_same(spark, parts, tmp_path):
    config = TrainConfig(epochs=5, learning_rate=0.02, groups=(ParameterGroup(r"0\..*", 0.5, 0.0),))
    whole = T.build(CONFIGS[0], 3)
    history = T.fit(whole, None, None, config, graph=parts[0])
    folder, real = str(tmp_path / "kept"), B.gradients
    broken = T.build(CONFIGS[0], 3)
    calls = []

    def failing(*a):
        calls.append(1)
        if len(calls) > 3:
            raise RuntimeError("lost")
        return real(*a)

    B.gradients = failing
    try:
        with pytest.raises(RuntimeError, match="lost"):
            T.fit(broken, None, None, config, checkpoints=folder, graph=parts[0])
    finally:
        B.gradients = real
    kept = store.newest(spark, folder)
    assert [k[-8:-4] for k in kept] == ["0003", "0002"]
    store.save_bytes(spark, b"cut off", f"{folder}/epoch-00000009.npz")
    again = T.build(CONFIGS[0], 3, seed=1)  # other weights, which the checkpoint replaces
    assert T.fit(again, None, None, config, checkpoints=folder, graph=parts[0]) == history
    for a, b in zip(again.params, whole.params, strict=True):
        for name in b:
            np.testing.assert_array_equal(a[name], b[name])


def test_saved_model(tmp_path):
    model = stirred(T.build(ModelConfig(norm="batchnorm", residual=True, **PLAIN), 3))
    T.save(model, str(tmp_path / "m.npz"), [(0, 1.5)])
    again, told = T.load(model.config, 3, str(tmp_path / "m.npz"))
    assert told == [(0, 1.5)] and all((again.params[k][n] == v).all() for k, p in enumerate(model.params) for n, v in p.items())


def test_zero_rows_have_no_gradient():
    y = np.array([[1.0, 2.0], [3.0, -1.0]])
    value, g = M.loss_of("sce", np.array([[0.0, 0.0], [1.0, 1.0]]), y)
    assert np.isfinite(value) and not g[0].any() and g[1].any()


def test_branches_add_up():
    x = tape.Value(np.array([[2.0]]))
    both = tape.total(tape.times(x, np.array([[3.0]])), tape.product(x, x))
    tape.accumulated([(both, np.array([[1.0]])), (x, np.array([[10.0]]))])
    assert x.gradient[0, 0] == 3 + 4 + 10


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_places_are_an_order(n):
    x = np.arange(n)
    p = draws.place(x, n, 1, 2)
    assert sorted(p) == list(x) and (draws.place(p, n, 1, 2, inverse=True) == x).all()
    assert n < 64 or (p != draws.place(x, n, 1, 3)).any()


def test_copies_are_drawn_one_by_one():
    src, dst, n = np.arange(4), np.arange(4) + 1, np.array([1.0, 0.0, 50_000.0, 7.0])
    kept = M.kept_copies(src, dst, n, 2, 0.3, 1)
    assert (kept <= n[:, None]).all() and abs(kept[2] / 50_000 - 0.7).max() < 0.01 and (kept == M.kept_copies(src, dst, n, 2, 0.3, 1)).all()
    old, M.COPIES = M.COPIES, 1000
    assert (M.kept_copies(src, dst, n, 2, 0.3, 1) == kept).all()
    M.COPIES = old


def test_attention_sums_to_one(spark):
    features, edges = graph(spark)
    p = T.build(CONFIGS[0], 3).params[0]
    layer = Layer("gat", p["w"], p["b"], p["a_src"], p["a_dst"])
    alpha = coefficients(projected(features.select("node_id", F.col("features").alias("h")), layer.w), edges, layer)
    sums = alpha.groupBy("dst_id").agg(*(F.sum(F.col("alpha")[k]) for k in range(2))).collect()
    assert len(sums) == N and all(v == pytest.approx(1) for r in sums for v in r[1:])


def test_refusals():
    for bad in ({"encoder_type": "x"}, {"decoder_type": "x"}, {"norm": "x"}, {"activation": "x"}):
        with pytest.raises(ValueError):
            T.build(ModelConfig(**bad), 3)
    with pytest.raises(ValueError):
        T.Optimizer("x", 0)


@pytest.mark.parametrize("kind", T.Optimizer.KINDS)
def test_optimizers_descend(kind):
    p, o = [{"w": np.array([3.0])}], T.Optimizer(kind, 0.0)
    for _ in range(200):
        o.step(p, [{"w": 2 * p[0]["w"]}], 0.05 if kind != "adadelta" else 1.0)
    assert abs(p[0]["w"][0]) < 2.9


def test_masking_counts(spark):
    rows = [(i, [float(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "node_id bigint, features array<double>")
    out = masked(df, [-1.0]).collect()
    kinds = [r["kind"] for r in out]
    assert (kinds.count("keep"), kinds.count("token"), kinds.count("noise"), kinds.count("same")) == (20, 18, 2, 0)
    assert all(r["masked"] == [-1.0] for r in out if r["kind"] == "token")
    few = masked(df.limit(6)).collect()  # too few for noise: none, and no error
    assert not [r for r in few if r["kind"] == "noise"]
