"""Operators on vectors and conversations."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from payflux.llm import chat, components, embedding_dedup, neighbours

KIND = "vec_id bigint, embedding array<float>, label int, n_links string"


def vectors(n=400, d=24, copies=60):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((n, d))
    for i in range(copies):  # near copies of a few, closer and less close
        x[n - 1 - i] = x[i % 3] + rng.standard_normal(d) * (0.02 + 0.003 * i)
    rows = [(i, [float(np.float32(v)) for v in r], i % 3 if i < n - copies else (n - 1 - i) % 3 % 3, "mine") for i, r in enumerate(x)]
    nan = float("nan")
    odd = [None, [], [0.0] * d, [nan] * d, [None] * d, [float("inf")] * d, [1.0, 2.0], [1.0, 2.0]]
    return rows + [(1000 + i, v, 0, "mine") for i, v in enumerate(odd)] + [(2000, rows[0][1], None, "mine"), (2001, rows[0][1], rows[0][2], "mine")]


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, np.float64), np.array(b, np.float64)
    return a @ b / np.sqrt((a @ a) * (b @ b))


@pytest.mark.parametrize("block,mean", [(1024, 0.0), (8, 0.0), (1024, 16.0)])
def test_embedding_links(spark, monkeypatch, block, mean):
    """Also of vectors with a large common mean, whose codes differ in many more bits at the threshold."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors()
    if mean:
        shift = np.random.default_rng(3).standard_normal(24) * mean / np.sqrt(24)
        rows = [(i, [float(np.float32(x + s)) for x, s in zip(v, shift, strict=True)] if v and len(v) == 24 and good(v) else v, *rest) for i, v, *rest in rows]
    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}
    use = [r for r in rows if r[2] is not None and good(r[1])]
    for i, a in enumerate(use):
        for b in use[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.98:
                links[a[0]] += 1
                links[b[0]] += 1
                x, y = root[a[0]], root[b[0]]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    out = embedding_dedup.linked(spark.createDataFrame(rows, KIND)).collect()
    assert len(out) == len(rows)
    found = sum(r["n_links"] for r in out)
    assert sum(links.values()) * 0.98 <= found <= sum(links.values()) and found > 100
    if found == sum(links.values()):
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out} == {k: (links[k], root[k], root[k] == k) for k in links}


def test_exact_parameters(spark):
    """Without substrings, everything that is linked is found."""
    rows = [r for r in vectors(120, 8, 20)]
    use = [r for r in rows if r[2] is not None and good(r[1])]
    want = {r[0]: sum(a[0] != r[0] and a[2] == r[2] and len(a[1]) == len(r[1]) and cosine(a[1], r[1]) >= 0.5 for a in use) if r in use else 0 for r in rows}
    out = embedding_dedup.linked(spark.createDataFrame(rows, KIND), threshold=0.5, substrings=0, radius=64).collect()
    assert {r["vec_id"]: r["n_links"] for r in out} == want


def test_hub_is_dealt_out(spark):
    """No key of the join holds the edges of a hub whole."""
    both = spark.createDataFrame([(0, k) for k in range(1, 4001)] + [(k, 0) for k in range(1, 4001)], "u bigint, v bigint")
    salted, least = components.dealt(both, 8000)
    sizes = [r["count"] for r in salted.groupBy("u", "salt").count().collect()]
    assert sum(sizes) == 8000 and max(sizes) < 2 * 8000 / 4 and least.count() == 4000 + 2


def test_no_embeddings(spark):
    none = spark.createDataFrame([], KIND)
    assert embedding_dedup.linked(none).count() == 0
    assert neighbours.nearest(none, F.col("vec_id") % 50 == 0).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 480)] + [(500, k) for k in range(501, 900)] + [(7, 7)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    ends = {x for a, b in edges if a != b for x in (a, b)}
    out = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {r["id"]: r["component"] for r in out} == {x: find(x) for x in ends} and len(out) == len(ends)


@pytest.mark.parametrize("components", [neighbours.TILE_COMPONENTS, 100])
def test_nearest(spark, monkeypatch, components):
    """In one tile of many steps, and in many tiles."""
    monkeypatch.setattr(neighbours, "TILE_COMPONENTS", components)
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    rows = vectors()
    use = [r for r in rows if good(r[1])]
    expected = {}
    for q in use:
        if q[0] % 50 == 0:
            near = sorted(((-cosine(q[1], c[1]), c[0]) for c in use if c[0] != q[0] and len(c[1]) == len(q[1])))[:5]
            expected |= {(q[0], k + 1): (i, -s) for k, (s, i) in enumerate(near)}
    out = neighbours.nearest(spark.createDataFrame(rows, KIND), F.col("vec_id") % 50 == 0).collect()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in out}
    assert got.keys() == expected.keys() and len(out) == len(got)
    assert all(got[k][1] == pytest.approx(expected[k][1], abs=1e-12) for k in got)
    assert sum(got[k][0] == expected[k][0] for k in got) >= len(got) - 2  # ties of equal vectors may round apart in the brute force


def test_copies_of_a_tile_in_steps(monkeypatch):
    """The k best by heaps over many steps are those of all products at once, ties by id."""
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 7)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(0)
    c = np.repeat(rng.standard_normal((20, 5)), 3, axis=0)
    ids, ask = rng.permutation(60), np.arange(8)
    out = list(neighbours.tile_best(ids[ask], c[ask], ids, c, 4))
    for i in ask:
        near = sorted((-float(neighbours.cosines(c[i : i + 1], c[j : j + 1])[0]), int(ids[j])) for j in range(60) if j != i)[:4]
        assert [(-s, v) for q, v, s in out if q == ids[i]] == near


def test_scores_of_equal_vectors_tie(spark):
    rows = [(i, [0.1, 0.2, 0.3], 0, "") for i in (50, 3, 2, 9, 8, 7, 6)]
    out = neighbours.nearest(spark.createDataFrame(rows, KIND), F.col("vec_id") == 50).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == [2, 3, 6, 7, 8]


TEXT = st.text(alphabet="<\\|ab>é\n" + "im_startend", max_size=30)


@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_chat_round_trip(turns):
    data, at, _ = chat.assembled(pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string()))
    assert chat.parsed(data.tobytes().decode()) == turns
    assert len(at) == len(turns) + 1 and at[-1] == len(data)


def test_chat(spark, monkeypatch):
    rows = [(1, 2, "assistant", "c é"), (1, 1, "user", "a"), (1, None, "system", None), (1, 2, "assistant", "b"), (None, 1, None, "x"), (2, 1, "assistant", chat.TRICKY)]
    rows += [(3, i, "assistant" if i % 2 else "user", "long " * (i % 50)) for i in range(3000)] + [(2, 1, "assistant", chat.TRICKY)]
    monkeypatch.setattr(chat, "PART_BYTES", 5000)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = {r["conv_id"]: r for r in chat.digests(chat.format_chat(df.withColumn("part", F.lit(1)))).collect()}
    null_first = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:])
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=null_first)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        got = out.pop(conv)
        assert (got["n_turns"], got["turns_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got["formatted_chars"] >= len(turns)
    assert not out
    assert chat.digests(chat.format_chat(df.limit(0))).count() == 0
