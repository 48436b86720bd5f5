"""Operators on documents, against brute force on small tables with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from payflux.llm import common, fm_index, jaccard, mixing, packing, quality, secrets, sharding, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(t):
    return WORD.findall(t or "")


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{rng.integers(vocabulary)}é" for _ in range(n))


def table():
    a, b = prose(1, 120), prose(2, 200)
    shared = prose(3, 60)
    rows = [a, a, a.replace("w1", "x1", 1), b, f"{prose(4, 30)} {shared} {prose(5, 30)}", f"{prose(6, 10)}\n{shared}", shared, None, "", "   \n", "one two", "one two", prose(7, 9000), prose(8, 14), "secret: abcdefgh"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(rows)]
    return [*rows, rows[3], (None, a, "en", "s0", len(a))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@given(st.lists(st.text(alphabet=" ab\té\n\x0b\xa0", max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    data, bounds = common.text_buffers(pa.array(texts, pa.string()))
    starts, ends, first = common.spans_of_words(data, bounds)
    got = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert [got[first[i] : first[i + 1]] for i in range(len(texts))] == [words(t) for t in texts]
    h = common.hashed_words(data, starts, ends)
    assert len(set(got)) == len(set(h.tolist()))


# --- secrets -----------------------------------------------------------------------------------

BASE = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]
SECRETS = [
    'pässwörter Token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
    "secret=token: abcdefghi and password:abc password:abcdef",
    "AKIA" + "A" * 16 + " AKIASHORT é AKIAAKIA" + "7" * 14,
    "user = bob77 at https://db.example.com/x\nApi_Key=abc.def-123",
    "user = bob77 far away\n\n" + "token=abcdefgh",
    "user = bob77 " + "x " * 200 + "token=abcdefgh",
    "Q" * 20 + "aB3/" * 8 + " postgres://h/db",
    "aB3/" * 8 + " alone",
    None, "", "deadbeef" * 2000, "é" * 5000 + "token=abcdefgh",
]


def base_spans(t):
    return sorted((m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(BASE) for m in p.finditer(t or "") if ok(m))


def test_secret_spans(spark):
    rows = [(i, t) for i, t in enumerate(SECRETS)] + [(3, SECRETS[3])]
    out = secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), keep=["doc_id"]).select("doc_id", secrets.listed(F.col("base")).alias("b"), secrets.listed(F.col("findings")).alias("f")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["b"] == ",".join(f"{k}:{s}:{e}" for s, _, k, e in base_spans(SECRETS[r["doc_id"]]))
        assert set(r["b"].split(",")) - {""} <= set(r["f"].split(","))
    found = {r["doc_id"]: {x.split(":")[0] for x in r["f"].split(",")} for r in out}
    assert found[3] == {"id", "endpoint", "assign"}  # parts of one credential
    assert found[4] == {"assign"} and found[5] == {"assign"}  # another scope; too far
    assert found[6] == {"key", "endpoint"} and found[7] == {""}


def test_masking_of_many_findings(spark):
    text = "".join(f"é{i} token=abcdef{i}\n\n" for i in range(1500))
    got = secrets.redacted(spark.createDataFrame([(text,)], "text string")).first()[0]
    assert got == "".join(f"é{i} [SECRET]\n\n" for i in range(1500))


def test_secret_masking(spark, docs):
    df = spark.createDataFrame([(1, "a token=abcdefgh b deadbeef"), (2, "clean"), (3, None), (4, "password=" + "a1" * 20)], "base bigint, text string")
    got = {r["base"]: r["text"] for r in secrets.redacted(df).collect()}
    assert got == {1: "a [SECRET] b deadbeef", 2: "clean", 3: None, 4: "[SECRET]"}
    assert secrets.redacted(docs).count() == docs.count()


# --- passages ------------------------------------------------------------------------------------


def brute_passages(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, (2**70,)), (-1 if i is None else i,))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (-1 if i is None else i,):
                gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_passages(docs, empty):
    df = docs.withColumn("n_words", F.lit("mine"))
    out = substring_dedup.without_repeats(df)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_words", "text", "_n_words", "n_removed"]
    got = sorted(((r["doc_id"], r["_n_words"], r["n_removed"], r["text"]) for r in out.collect()), key=str)
    assert got == brute_passages([(r[0], r[1]) for r in table()])
    assert substring_dedup.without_repeats(empty).count() == 0


def test_passage_of_many_documents(spark, monkeypatch):
    """The edges of a shared passage differ in each document and must not meet in one shard."""
    passage = " ".join(f"p{k}" for k in range(16))
    rows = [(i, " ".join(f"a{i}x{k}" for k in range(14)) + f" {passage} " + " ".join(f"b{i}x{k}" for k in range(14))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    keyed = substring_dedup._keyed(docs, "doc_id", "text", [])
    shards, hot = substring_dedup.hot_anchors(keyed, 100)
    assert shards == 16 and len(hot)
    everywhere = keyed.select("id", "rid", "text", F.transform(F.sequence(F.lit(0), F.lit(39)), lambda x: x.cast("int")).alias("pos"))
    sent = lambda hot: [r[0] for r in everywhere.mapInArrow(substring_dedup._segments(16, hot), substring_dedup.SEGMENTS).where("octet_length(texts) > 0").groupBy("shard").agg(F.sum(F.size("pos")).alias("n")).select("n").collect()]
    before, after = sent(hot[:0]), sent(hot)
    assert max(after) / sum(after) < 0.12 < max(before) / sum(before)
    monkeypatch.setattr(substring_dedup.hot_anchors, "__defaults__", (100,))
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.without_repeats(docs).collect()), key=str)
    assert got == brute_passages(rows)


def test_full_filter_of_hot_anchors(spark, docs, monkeypatch):
    """Anchors that are cut needlessly change no result."""
    want = brute_passages([(r[0], r[1]) for r in table()])
    monkeypatch.setattr(substring_dedup, "hot_anchors", lambda rows: (16, np.full(1 << 12, 255, np.uint8)))
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.without_repeats(docs).collect()), key=str)
    assert got == want


def test_filter_of_hot_anchors(spark, monkeypatch):
    """It holds the frequent anchors and few others, and has bounded bytes."""
    rows = [(i, " ".join(f"p{k}" for k in range(16)) + f" {prose(i, 200)}") for i in range(300)]
    keyed = substring_dedup._keyed(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", [])
    shards, bits = substring_dedup.hot_anchors(keyed, 200)
    found = [substring_dedup.anchors(common.hashed_words(data, *spans[:2]), spans[2])[1] for data, bounds in [common.text_buffers(pa.array([t for _, t in rows]))] for spans in [common.spans_of_words(data, bounds)]]
    values, counts = np.unique(np.concatenate(found), return_counts=True)
    inside = substring_dedup.in_filter(values, bits)
    assert inside[counts > 200].all() and (counts > 200).any() and inside[counts <= 200].mean() < 0.02
    assert not substring_dedup.in_filter(values, bits[:0]).any()
    monkeypatch.setattr(substring_dedup, "MOST_FILTER", 4096)
    assert len(substring_dedup.hot_anchors(keyed, 200)[1]) == 4096


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=8))
@settings(max_examples=40, deadline=None)
def test_repeats_of_a_shard(texts):
    """Segments that overlap and repeat much, against brute force."""
    rows = [(i, " ".join(t)) for i, t in enumerate(texts) if len(t) >= 13]
    if not rows:
        return
    data, bounds = common.text_buffers(pa.array([t for _, t in rows]))
    starts, ends, first = common.spans_of_words(data, bounds)
    which, a, b = substring_dedup.repeats(common.hashed_words(data, starts, ends), np.diff(first), np.arange(len(rows)), np.array([i for i, _ in rows]))
    gone = Counter()
    for k, x, y in zip(which, a, b, strict=True):
        gone[rows[k][0]] = gone[rows[k][0]] | sum(1 << int(j) for j in range(x, y))
    for i, _, n, _ in brute_passages(rows):
        assert bin(gone[i]).count("1") == n


def test_fm_index_counts():
    rng = np.random.default_rng(0)
    text = np.append(rng.integers(1, 4, 300), 0)
    owner = rng.integers(0, 90, 301)
    index = fm_index.FMIndex(text, 4, owner, 5)
    matched, row = index.matching(text, np.array([0, 100, 200]), np.array([20, 30, 7]))  # parts of it, one pass for all
    for begin, end in ((0, 20), (100, 130), (200, 207)):
        for i in range(begin, end):
            seen = Counter(tuple(text[j : j + n]) for n in range(1, end - i + 1) for j in range(300 - n + 1))
            assert matched[i] == max((n for n in range(1, end - i + 1) if seen[tuple(text[i : i + n])] > 1), default=0)
            if matched[i] >= 5:
                least = min(owner[j] for j in range(296) if tuple(text[j : j + 5]) == tuple(text[i : i + 5]))
                assert index.least_owner(row[i : i + 1], 5)[0] == least


# --- near copies -----------------------------------------------------------------------------------


def grams(t):
    w = words(t)
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_jaccard(spark, docs, empty):
    rows = [(r[0], r[1]) for r in table()]
    long = prose(9, 300)
    parts = long.split()
    for k in range(40):  # a chain of near copies, and of copies
        rows.append((100 + k, " ".join([*parts[: k * 3], *(f"z{k}" for _ in range(k % 4)), *parts[k * 3 :]])))
    out = jaccard.joined(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    sets = [grams(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {g: None if None in ids else min(ids) for g, ids in groups.items()}
    expected = sorted(((rows[i][0], links[i], least[root(i)]) for i in range(len(rows))), key=str)
    assert sorted(((r["id"], r["n_links"], r["component_id"]) for r in out), key=str) == expected
    assert sum(r["kept"] for r in out) == len(groups)
    kept = jaccard.deduplicated(docs).collect()
    assert len(kept) == len({g for g in (r[0] for r in kept)}) and [r for r in kept if r["doc_id"] in (7, 8, 9)]
    assert jaccard.joined(empty).count() == 0 and jaccard.deduplicated(empty).count() == 0


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = [(i, prose(1, 100) + f" tail{i}") for i in range(50)]
    out = jaccard.joined(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["n_links"], r["component_id"]) for r in out} == {(49, 0)}


def test_copies_of_a_large_group(spark):
    """A set goes to a few blocks, not to one for each 512 texts; long texts make more blocks. 100,000 texts: 16 copies each, not 196."""
    rows = spark.createDataFrame([(1, 100), (512, 100), (513, 100), (5_000, 100), (100_000, 300), (1_000_000, 300), (40, 1 << 20)], "n bigint, each bigint")
    blocks = rows.withColumn("grams", F.col("n") * F.col("each")).select("n", jaccard.blocks_in("n", "grams").alias("blocks"))
    assert {r["n"]: r["blocks"] for r in blocks.collect()} == {1: 1, 512: 1, 513: 2, 5_000: 10, 100_000: 16, 1_000_000: 144, 40: 20}


def test_steps_of_a_tile(monkeypatch):
    """All pairs of a tile are in its steps, each once, and no step is large."""
    monkeypatch.setattr(jaccard, "STEP", 5)
    block = np.random.default_rng(0).integers(0, 2, 43)
    for low, high in ((0, 0), (0, 1)):
        at = np.flatnonzero((block == low) | (block == high))
        met = []
        for a, b in jaccard.steps_of(block, low, high):
            assert len(a) <= 5 and len(b) <= 5
            met += [frozenset((i, j)) for i in a for j in b if i < j] if low == high and a[0] == b[0] else [frozenset((i, j)) for i in a for j in b]
        assert len(met) == len(set(met))
        assert set(met) == {frozenset((i, j)) for i in at for j in at if i < j and (low == high or block[i] != block[j])}
    assert list(jaccard.steps_of(np.zeros(3, int), 0, 1)) == []


@pytest.mark.parametrize("block,few,most", [(8, 16, 1 << 21), (8, 2, 1 << 21), (8, 1, 700), (512, 16, 300)])
def test_blocks_and_steps_of_a_large_group(spark, monkeypatch, block, few, most):
    """Blocks cut by texts or n-grams, tiles of many steps: the same links."""
    for name, value in {"BLOCK": block, "FEW_BLOCKS": few, "MOST_GRAMS": most, "STEP": 3}.items():
        monkeypatch.setattr(jaccard, name, value)
    base = prose(1, 100)
    rows = [(i, base + f" tail{i}") for i in range(50)] + [(50, base + " tail7"), (51, " ".join(base.split()[:92]))]
    out = jaccard.joined(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    sets = [grams(t) for _, t in rows]
    want = {i: sum(j != i and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    assert {r["id"]: r["n_links"] for r in out} == want and {r["component_id"] for r in out} == {0}


def test_texts_to_compare_beyond_a_broadcast(spark, docs, monkeypatch):
    """A filter that is full, or not, lets all of them through: results are those of the broadcast."""
    key = lambda df: sorted((tuple(r) for r in jaccard.joined(df).collect()), key=str)
    want = key(docs)
    passed = []
    real = jaccard.likely
    monkeypatch.setattr(jaccard, "likely", lambda *a: passed.append((real(*a), a)) or passed[-1][0])
    monkeypatch.setattr(jaccard, "MOST_BROADCAST", 0)
    assert key(docs) == want
    some, (texts, chosen) = passed[0]
    assert chosen.count() <= some.count() < texts.count()
    monkeypatch.setattr(jaccard, "blocks_for", lambda *_: 3)
    assert key(docs) == want


def test_bytes_of_a_broadcast(spark):
    rows = [(1, "d", [(1, -1, 1)], None), (None, "e", [(1, 0, 1), (2, 1, 1)], [5, 6, 7])]
    chosen = spark.createDataFrame(rows, "its_id bigint, its_digest string, homes array<struct<a:bigint,band:int,blocks:bigint>>, bands array<bigint>")
    assert jaccard.broadcast_bytes(chosen) == 2 * jaccard.ROW_BYTES + 1 + 3 * jaccard.HOME_BYTES + 3 * jaccard.BAND_BYTES
    assert jaccard.broadcast_bytes(chosen.limit(0)) == 0


def test_chained_group_is_compared_by_bucket(spark, monkeypatch):
    """A group that chance bands chain together is large, its buckets are small; results are the same."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    base = prose(1, 2600, 9000).split()
    rows = [(i, " ".join(base[8 * i : 8 * i + 120])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [grams(t) for _, t in rows]
    want = {rows[i][0]: sum(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(len(rows))) for i in range(len(rows))}
    homes = []
    real = jaccard.homes_of
    monkeypatch.setattr(jaccard, "homes_of", lambda *a: homes.append(real(*a)) or homes[-1])
    monkeypatch.setattr(jaccard, "MOST_BROADCAST", 0)
    out = jaccard.joined(df).collect()
    assert {r["id"]: r["n_links"] for r in out} == want and min(want.values()) > 0
    assert homes[0].where("bands is not null").count() > 0


def test_bands():
    bands, rows = jaccard.bands_for(0.8, 0.9999)
    assert bands * rows <= jaccard.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.9999


# --- quality -----------------------------------------------------------------------------------------


def slow_badness(text, w):
    """The network's definition for one text, in doubles, window by window."""
    w = {k: np.asarray(v, np.float64) for k, v in w.items()}
    cells = -(-(len(text) + quality.WINDOW - 1) // quality.CELL)
    data = bytes(quality.WINDOW - 1) + text + bytes(cells * quality.CELL - len(text))
    seen = [sum(w["embedding"][data[p + j]] @ w["filters"][j] for j in range(quality.WINDOW)) for p in range(cells * quality.CELL)]
    of_cells = [np.max(seen[k * quality.CELL : (k + 1) * quality.CELL], axis=0) for k in range(cells)]
    starts = [*range(0, cells - quality.CHUNK, quality.STEP), max(0, cells - quality.CHUNK)]
    out = []
    for k in starts:
        x = np.maximum(np.max(of_cells[k : k + quality.CHUNK], axis=0) + w["bias"], 0)
        out.append(np.maximum(x @ w["hidden"] + w["hidden_bias"], 0) @ w["out"] + w["out_bias"][0])
    return w["mix"][0] * np.mean(out) + w["mix"][1] * np.max(out)


def quality_case():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 110, n, dtype=np.uint8)) for n in (700, 30, 0, 59, 60, 256, 251, 252, 400)]
    w = quality.start_weights(rng)
    w["hidden_bias"] += 0.1
    return texts, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), w, rng


def test_quality_scores_against_brute_force():
    """Each text alone, whatever lies beside it."""
    texts, bounds, w, _ = quality_case()
    got = quality.scores(np.frombuffer(b"".join(texts), np.uint8), bounds, w)
    assert got == pytest.approx([1 / (1 + np.exp(slow_badness(t, w))) for t in texts], abs=1e-5)


def test_quality_gradient():
    """Of all weights, against differences of the slow definition."""
    texts, bounds, w, rng = quality_case()
    texts, bounds = texts[:4], bounds[:5]
    y = np.array([1.0, 0, 1, 0])
    data, cells = quality.padded(np.frombuffer(b"".join(texts), np.uint8), bounds)
    g = quality.gradient(data, cells, y, w)

    def value(changed):
        p = np.array([1 / (1 + np.exp(slow_badness(t, changed))) for t in texts])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    assert g.keys() == w.keys()
    for k in w:
        way = rng.standard_normal(w[k].shape) * (np.asarray(g[k]) != 0)
        up, down = (value({**w, k: np.asarray(w[k], np.float64) + e * way}) for e in (1e-5, -1e-5))
        assert (np.asarray(g[k]) * way).sum() == pytest.approx((up - down) / 2e-5, rel=1e-2, abs=1e-4), k


def test_quality_learns_from_long_texts(spark, monkeypatch):
    """What a text shows is learned from those of 20 KB too, here the only ones; a bound on all bytes ends the sample."""
    rows = [(i, ("good words here " if i % 2 else "zzzz qqqq ") * 2000, i % 2) for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")
    monkeypatch.setattr(quality, "BATCH", 4)
    monkeypatch.setattr(quality, "STEPS", 60)
    w = quality.learned(docs, labels)
    assert "constant" not in w
    assert {r["doc_id"] % 2 == (r["score"] >= 0.5) for r in quality.score(docs, w).collect()} == {True}
    assert "constant" in quality.learned(docs, labels, sample_bytes=1)  # one text, so one class


def test_quality_sees_the_end_of_long_texts_and_ignores_neighbours():
    w = quality.start_weights(np.random.default_rng(2))
    a, b = b"abc " * 5000, b"xyz"
    both = quality.scores(np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a) + len(b)]), w)
    alone = quality.scores(np.frombuffer(b, np.uint8), np.array([0, len(b)]), w)
    assert both[1] == pytest.approx(alone[0], abs=1e-6)
    changed = quality.scores(np.frombuffer(a[:-40] + bytes(range(200, 240)), np.uint8), np.array([0, len(a)]), w)
    assert changed[0] != both[0]


def test_quality_holds_out(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    out = quality.op8_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.95
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in out["doc_id"])
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    none = quality.learned(docs, labels)
    scored = quality.score(docs.withColumn("score", F.lit("mine")), none)
    assert scored.columns[-2:] == ["score", "_score"] and {r["_score"] for r in scored.collect()} == {0.5}
    assert quality.score(empty, none).count() == 0


# --- sharding ------------------------------------------------------------------------------------------


def shards_of(df, **options):
    return sharding.shard(df, "doc_id", F.octet_length("text") + 1, **options).toPandas()


def test_sharding(spark, docs, empty):
    sizes = [(i, "x" * (i % 97)) for i in range(3000)]
    out = shards_of(spark.createDataFrame(sizes, "doc_id bigint, text string"))
    totals = out.groupby("shard")["size"].sum()
    assert len(totals) == 8 and totals.max() - totals.min() <= 2 * 98
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert out.sort_values("doc_id")["shard"].is_monotonic_increasing
    hot = shards_of(spark.createDataFrame([(7, "same")] * 500, "doc_id bigint, text string"))
    assert hot.groupby("shard").size().max() - hot.groupby("shard").size().min() <= 2
    assert len(shards_of(docs.withColumn("shard", F.lit(1)))) == len(table()) and len(shards_of(empty)) == 0
    none = sharding.shard(docs, "doc_id", F.lit(0)).toPandas()
    assert len(none) == len(table()) and none.groupby("shard")["slot"].nunique().sum() == len(table())


def test_sharding_query_against_brute_force(spark):
    """All columns: a shard is the eighth of all bytes in which the middle of the document lies, in the order of ids."""
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    total, before, slots, expected = sum(len(t) + 1 for _, t in docs), 0, [0] * 8, []
    for doc_id, text in docs:
        shard = min(7, int((2 * before + len(text) + 1) / (2.0 * total) * 8))
        expected.append((doc_id, len(text) + 1, zlib.crc32(text), "bytes", shard, slots[shard], None))
        slots[shard] += 1
        before += len(text) + 1
    out = sharding.op6_sharding(spark, sf)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted(map(tuple, out.collect())) == expected


def test_hot_key_beside_others(spark, monkeypatch):
    """A key with a third of the rows is cut though greater keys follow before the next splitter."""
    cells = []

    def seen(rows, groups, cell, *more):
        cells.extend(r["count"] for r in rows.groupBy(cell).count().collect())
        return common.with_sums_before(rows, groups, cell, *more)

    monkeypatch.setattr(sharding, "with_sums_before", seen)
    keys = [*range(0, 1000), *[1000] * 1000, *range(1001, 2001)]
    out = shards_of(spark.createDataFrame([(k, "same") for k in keys], "doc_id bigint, text string"))
    assert sum(cells) == len(out) == 3000 and max(cells) < 400
    assert out.sort_values("doc_id")["shard"].is_monotonic_increasing and out.groupby("shard").size().max() - out.groupby("shard").size().min() <= 2


def test_shard_files(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(table()) and {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


# --- mixing ----------------------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while free:
        unit = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if unit * w[s] > 2 * sizes[s]}
        if not over:
            out |= {s: unit * w[s] for s in free}
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return out


def test_mixing(spark, docs, empty):
    rng = np.random.default_rng(4)
    rows = [(i, [None, "a", "b", "ä", "c"][int(rng.choice(5, p=[0.1, 0.6, 0.1, 0.1, 0.1]))], "w " * int(rng.integers(0, 40))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    out = mixing.plan(df, keep=["doc_id", "source"]).toPandas()
    sizes = out.groupby("source", dropna=False)["size"].sum()
    expected = brute_targets({None if s != s else s: int(v) for s, v in sizes.items()})
    for s, g in out.groupby("source", dropna=False):
        target = expected[None if s != s else s]
        assert g["target"].iloc[0] == pytest.approx(target) and abs(g["taken"].sum() - target) <= 1
        assert g["source_size"].iloc[0] == g["size"].sum()
    assert (out["taken"] <= 2 * out["size"]).all()
    again = mixing.plan(df, keep=["doc_id", "source"]).toPandas()
    assert dict(zip(again["doc_id"], again["taken"], strict=True)) == dict(zip(out["doc_id"], out["taken"], strict=True))
    for part in (docs, docs.withColumn("taken", F.lit("mine"))):
        mixed = mixing.mixed(part)
        assert set(mixed.columns) >= set(part.columns) and mixed.where("size(split(trim(text), ' ')) = 0 or text is null").count() == 0
    assert mixing.plan(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_shard_quotas(spark):
    quotas = {"a": 1000, "b": 37, "c": 0, None: 400, "d": 1}
    df = spark.createDataFrame(list(quotas.items()), "source string, quota bigint")
    out = {r["source"]: np.diff([0, *r["ends"]]) for r in mixing.shard_quotas(df).collect()}
    assert {s: int(x.sum()) for s, x in out.items()} == quotas and all((x >= 0).all() for x in out.values())
    total = sum(out.values())
    assert total.max() - total.min() <= 1


def test_hypergeometric(spark):
    """Means and variances of many draws."""
    df = spark.range(4000).select(mixing.drawn(F.lit(60).cast("long"), F.lit(20).cast("long"), F.lit(25).cast("long"), common.unit(F.lit(1), F.col("id"))).alias("x")).toPandas()["x"]
    assert df.between(0, 20).all()
    assert df.mean() == pytest.approx(25 * 20 / 60, abs=0.12)
    assert df.var() == pytest.approx(25 * (1 / 3) * (2 / 3) * 35 / 59, rel=0.1)


# --- packing ------------------------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 60), min_size=1, max_size=30), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_best_bounds(lengths, most):
    values, counts = np.unique(lengths, return_counts=True)
    bounds = packing.best_bounds(values, counts, most)
    cost = lambda bs: sum(min(b for b in bs if b >= n) for n in lengths)
    assert bounds[-1] == max(lengths) and len(bounds) <= most
    every = min(cost([*c, max(lengths)]) for k in range(most) for c in itertools.combinations([int(v) for v in values[:-1]], min(k, len(values) - 1)))
    assert cost(bounds) == every


def test_bounds_of_many_lengths():
    """More lengths than were once taken one by one; how many choices are weighed at a time changes nothing."""
    rng = np.random.default_rng(0)
    lengths, counts = np.arange(300_000) * 3 + 1, rng.integers(1, 50, 300_000)
    assert packing.EXACT is None
    bounds = packing.best_bounds(lengths, counts, 4)
    assert bounds[-1] == lengths[-1] and set(bounds) <= set(lengths.tolist())
    few = np.unique(rng.integers(0, 9000, 800))
    assert packing.best_bounds(few, counts[: len(few)], 8, choices_at_once=5) == packing.best_bounds(few, counts[: len(few)], 8)


def test_packing(spark, docs, empty):
    lengths = [int(x) for x in np.random.default_rng(0).integers(0, 300, 500)] + [5000, 100_000]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id bigint, n bigint")
    out = packing.pack(df, F.col("n"), budget=1000, keep=["doc_id"]).toPandas()
    assert sorted(out["doc_id"]) == list(range(len(lengths))) and (out["bucket_len"] >= out["n_tokens"]).all()
    assert out["over_budget"].sum() == 2
    for (bound, _), g in out.groupby(["bucket_len", "batch"]):
        assert sorted(g["slot"]) == list(range(len(g))) and (len(g) == 1 or len(g) * bound <= 1000)
    for bound, g in out.groupby("bucket_len"):
        full = g.groupby("batch").size()
        assert (full.sort_index().iloc[:-1] == g["batch_docs"].iloc[0]).all()
    assert packing.pack(docs.withColumn("batch", F.lit("mine"))).columns[-4:] == ["_batch", "slot", "batch_docs", "over_budget"]
    assert packing.pack(docs).count() == len(table()) and packing.pack(empty).count() == 0


def test_bounds_are_lengths_of_documents(spark):
    """Also where there are too many lengths to take one by one."""
    lengths = [int(x) for x in np.random.default_rng(0).integers(0, 200_000, 3000)]
    df = spark.createDataFrame([(n,) for n in lengths], "n bigint")
    exact, counts = packing.histogram(df, "n")
    assert exact.tolist() == sorted(set(lengths)) and counts.sum() == 3000
    coarse, counts = packing.histogram(df, "n", exact=10)
    assert set(coarse) <= set(lengths) and coarse.max() == max(lengths) and counts.sum() == 3000 and len(coarse) < len(exact)


def test_draws_do_not_depend_on_file_splits(spark):
    """Equal rows, a third of all, are numbered; which of them is which doesn't matter."""
    rows = [(i if i % 3 else 7, "s" if i % 3 else "t", prose(i, 1 + i % 50) if i % 3 else "a b c") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    for f in (
        lambda d: mixing.plan(d, keep=["doc_id"]).select("doc_id", "size", "taken"),
        lambda d: mixing.mixed(d).select("doc_id", "shard", "place"),
        lambda d: packing.pack(d, budget=200, keep=["doc_id"]),
    ):
        a, b, c = (sorted(map(tuple, f(d).collect()), key=str) for d in (df.repartition(3), df.repartition(7), df.coalesce(1)))
        assert a == b == c and len(a) > 500


def test_inner_names_may_be_taken(spark):
    """Columns of the input that are called as those that operators use inside."""
    taken = ["id", "src", "size", "block", "order", "before", "takes", "draws", "draw", "words", "number", "pass", "n", "at", "one", "cell", "rank", "most", "bound", "uid", "key", "c0", "c1", "times", "its_id", "nth", "digest", "its_digest", "__text", "base", "weak", "blank", "more", "findings", "score", "starts", "ends", "pos", "rid", "target", "source_size", "k", "s", "h", "part", "range", "sub", "tie", "every", "text_crc32", "grown_shard"]
    df = spark.createDataFrame([(i, f"w{i % 3} token=abcdef{i % 3}", "en", *["mine"] * len(taken)) for i in range(9)], "doc_id bigint, text string, source string, " + ", ".join(f"`{t}` string" for t in taken))
    for f in (
        mixing.mixed, mixing.plan, packing.pack, jaccard.deduplicated, secrets.scan, secrets.redacted, substring_dedup.without_repeats,
        lambda d: quality.score(d, {"constant": np.float64(0.5)}), lambda d: sharding.shard(d, "doc_id", F.octet_length("text")),
    ):
        out = f(df)
        assert set(df.columns) <= set(out.columns) and out.count() > 0
        assert {r[0] for r in out.select(*taken[:1]).distinct().collect()} == {"mine"}


def test_digest_is_sha256():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
