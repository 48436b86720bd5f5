"""Exact dedup, importance resampling and collocations against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from payflux.llm import collocations as C
from payflux.llm import common, embedding_dedup, fm_index, mixing, packing
from payflux.llm import exact_dedup as D
from payflux.llm import resampling as R

DOCS = "doc_id bigint, text string, lang string, source string"
CLASH = ("sha", "uid", "block", "bitmap", "the_block", "doubt", "id", "best", "its_sha", "group_size", "row", "c0", "place", "order", "rank", "score", "weight", "f", "phrase", "length", "n", "w")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, None) for i, t, lang in rows], DOCS)


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASH})


# --- exact dedup ---------------------------------------------------------------------------


def rows_with_copies(seed=0, n=400):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot", f"pair {i % 60}", f"single {i}", "", None, "x" * 5000]), "en") for i in range(n)]
    return rows + [(7, "hot", "en"), (7, "hot", "en"), (None, "hot", "en"), (None, "no id", None)]


@pytest.mark.parametrize("most_bytes", [D.MOST_BYTES, 1])
def test_marked(spark, most_bytes):
    """The same result with a filter that is far too small."""
    rows = rows_with_copies()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    got = D.marked(clashing(docs(spark, rows)), most_bytes=most_bytes).collect()
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).digest() == bytes(r["sha"]))
        ids = groups[text]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[text] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_deduplicated_keeps_columns(spark):
    rows = rows_with_copies(1)
    df = clashing(docs(spark, rows))
    out = D.deduplicated(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(r["text"] or "" for r in got) == sorted({t or "" for _, t, _ in rows})
    assert next(r["doc_id"] for r in got if r["text"] == "hot") == max(i for i, t, _ in rows if t == "hot" and i is not None)
    normal = D.deduplicated(docs(spark, [(1, "A b", None), (2, "a  B", None)]), normalised=lambda t: F.regexp_replace(F.lower(t), r"\s+", " "))
    assert [r["doc_id"] for r in normal.collect()] == [2]


def test_single_rows_are_not_shuffled(spark):
    """Of 4,000 different texts and one that stands 2,000 times, hardly any of the former is in doubt; of the latter all."""
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, F.concat(F.lit("text "), "id")).otherwise("hot").alias("text"))
    prints = df.select("doc_id", D.digest(F.col("text")).alias("sha"))
    blocks = D.blocks_for(6000)
    rows = D.with_doubt(prints, "sha", D.repeated_bits(prints, "sha", blocks), blocks, "doubt")
    doubt = {r["single"]: r["n"] for r in rows.where("doubt").groupBy((F.col("doc_id") < 4000).alias("single")).agg(F.count("*").alias("n")).collect()}
    assert doubt[False] == 2000 and doubt.get(True, 0) < 200


def test_exact_dedup_of_nothing(spark):
    assert D.marked(docs(spark, [])).count() == 0 and D.deduplicated(docs(spark, [])).count() == 0


# --- importance resampling -----------------------------------------------------------------


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled(rows, target, percent=R.PERCENT):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x, _ in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10_000) / ((s[b] + 1.0) * (t_all + 10_000))))
    out = []
    for i, text, _ in rows:
        words, found = features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] if r[0] is not None else math.inf))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_resampled(spark, percent):
    rng = random.Random(3)
    vocabulary = ["The", "a", "zebra", "ÉTÉ", "x1", "don't", "9", "word" * 100, "日本", "in-side"]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 19, 20, 25, 60])))
    rows = [(i, text(), "en") for i in range(200)] + [(-5, None, None), (None, "a " * 30, None), (300, "", None), (301, "z " * 3000, None), ((1 << 62), "a b " * 12, None)]
    target = ["a zebra in-side", None, "The a The"]
    df = clashing(docs(spark, rows))
    got = R.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
    key = lambda r: str(r[0])
    assert sorted((tuple(r) for r in got), key=key) == sorted(resampled(rows, target, percent), key=key)


def test_equal_rows_are_drawn_as_often_as_they_fit(spark):
    rows = [(i % 2, "a b c d " * 5, None) for i in range(100)]
    got = R.resampled(docs(spark, rows), docs(spark, []), percent=30).where("rank is not null").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 31)) and len({r["doc_id"] for r in got}) == 1


@pytest.mark.parametrize("k", [1, 2, 499, 500, 999, 1000])
def test_kth_key(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice([-(1 << 63), -1, 0, 5, (1 << 63) - 1, rng.randrange(-(1 << 40), 1 << 40)]), rng.randrange(-3, 3), u) for u in range(1000)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, u bigint")
    bound = R.kth_key(df, ["a", "b", "u"], k)
    assert sorted(tuple(r) for r in df.where(R.up_to(["a", "b", "u"], bound)).collect()) == sorted(rows)[:k]


def test_resampling_of_nothing(spark):
    assert R.resampled(docs(spark, []), docs(spark, [(1, "a b", None)])).count() == 0


# --- collocations --------------------------------------------------------------------------


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        if not any(L == lang and len(q) > len(p) and c >= least and 100 * c >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (L, q), c in f.items()):
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, found in out.items() for k, x in enumerate(sorted(found)[:top]))


def prose(seed, n=120):
    rng = random.Random(seed)
    words = ["of", "The", "new", "york", "city", "été", "a", "\x0bodd", "日本", "x" * 300]
    say = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(rng.choice([0, 1, 5, 40])))
    rows = [(i, say() + rng.choice(["", "new york city of a", "of the of the of the"]), rng.choice(["en", "fr", None, ""])) for i in range(n)]
    return rows + [(None, None, "en"), (1, "", "de"), (2, "new york " * 2000, "en"), (2, "new york " * 2000, "en")]


@pytest.mark.parametrize(("bits", "shard_bytes", "top"), [(C.FILTER_BITS, C.SHARD_BYTES, 2000), (1 << 15, 500, 3)])
def test_collocations(spark, bits, shard_bytes, top):
    """The same result with a filter that is too small to hold anything back, and from many shards."""
    rows = prose(bits)
    got = C.collocations(clashing(docs(spark, rows)), least=8, top=top, bits=bits, shard_bytes=shard_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 8, top)


def test_suffixes():
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 4, 300)
    order, shared = C.ranked_suffixes(ids, 4)
    cut = [tuple(ids[i : i + 4]) for i in order]
    assert cut == sorted(cut)
    for k in range(1, 300):
        assert shared[k] == next((j for j in range(4) if j >= min(len(cut[k]), len(cut[k - 1])) or cut[k][j] != cut[k - 1][j]), 4)


def test_collocations_of_nothing(spark):
    assert C.collocations(docs(spark, [])).count() == 0
    assert C.collocations(docs(spark, [(1, None, None), (2, "a b", "en")])).count() == 0


# --- keys, limits and ways out ---------------------------------------------------------------


def test_row_keys_tell_rows_apart(spark):
    rows = [(None, "-"), ("-", None), (None, None), ("-", "-"), ("a|b", "c"), ("a", "b|c"), ("1:a", ""), ("", "1:a"), ("", None), (None, ""), ("é", "x"), ("e", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(common.row_key([F.col("a"), F.col("b")]).alias("k")).distinct().count() == len(rows)


def test_draws_do_not_depend_on_order(spark):
    """Two hundred ids, each with a null and with a dash: packed and mixed alike in either order of rows."""
    rows = [(i, t, "en", "s") for i in range(200) for t in (None, "-")]
    found = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id bigint, text string, lang string, source string").repartition(5 if order is rows else 2)
        mix = mixing.plan(df, keep=["doc_id"]).select("doc_id", "size", "taken").collect()
        packs = packing.pack(df, keep=["doc_id", "text"]).collect()
        found.append((sorted(map(tuple, mix)), sorted(map(str, packs))))
    assert found[0] == found[1]


def test_index_refuses_what_it_is_not_sorted_for():
    text = np.append(np.ones(300, np.int64), 0)
    index = fm_index.FMIndex(text, 2, np.arange(301), 5)
    matched, _ = index.matching(text, np.array([0]), np.array([31]))
    assert matched[0] == 31
    with pytest.raises(ValueError, match="suffixes"):
        index.matching(text, np.array([0]), np.array([300]))
    with pytest.raises(ValueError, match="suffixes"):
        fm_index.FMIndex(text, 2, np.arange(301), 300)


def test_geometry_falls_back_to_the_exact_way(monkeypatch):
    x = np.random.default_rng(0).standard_normal((50, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = embedding_dedup.learned(x)
    assert embedding_dedup.geometry([x], [model], 0.98)[0] in embedding_dedup.SUBSTRINGS
    monkeypatch.setattr(embedding_dedup, "RECALL", 1.1)
    assert embedding_dedup.geometry([x], [model], 0.98) == (0, embedding_dedup.BITS)


def test_exact_is_a_parameter(spark):
    """Few entries in the histogram cost padding, and bounds are still lengths of documents."""
    df = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") * 7 + 1024).alias("n"))
    padding = [packing.pack(df, F.col("n"), exact=e).agg(F.sum(F.col("bucket_len") - F.col("n_tokens")).alias("p")).first()["p"] for e in (packing.EXACT, 10)]
    assert padding[0] <= padding[1] < 1.02 * padding[0]
