"""The corpus pipeline, stage by stage, against plain Python over its own input."""

import re

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        f(spark, docs, SF).write.parquet(path)
        out.append((docs.toPandas(), (docs := spark.read.parquet(path)).toPandas()))
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert list(after.columns) == list(before.columns)


def test_quality_keeps_clean_documents(spark, stages):
    before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    known = before[before["doc_id"].isin(labels.index)]
    kept = known["doc_id"].isin(after["doc_id"])
    assert (kept == (labels.loc[known["doc_id"]].to_numpy() == 1)).mean() > 0.95


def test_one_of_each(stages):
    before, after = stages[1]
    grams = {}
    for i, t in zip(before["doc_id"], before["text"], strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, root = sorted(grams), {i: i for i in grams}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if grams[i] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert set(after["doc_id"]) == {i for i in ids if root[i] == i}


def test_secrets_are_masked(stages):
    before, after = stages[2]
    assert sorted(before["doc_id"]) == sorted(after["doc_id"])
    pattern = re.compile(r"""token = "[0-9a-f]{24,}""")
    assert not after["text"].str.contains(pattern).any()
    same = before.set_index("doc_id")["text"]
    for i, t in zip(after["doc_id"], after["text"], strict=True):
        assert t == same[i] or "[SECRET]" in t


def test_mix_and_packing(stages):
    before, after = stages[3]
    assert set(after["doc_id"]) <= set(before["doc_id"]) and after.groupby("doc_id").size().max() <= 2
    packed = stages[4][1]
    assert sorted(packed["doc_id"]) == sorted(after["doc_id"])
    assert not packed.duplicated(["bucket_len", "batch", "slot"]).any()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "bucket_len" in out.columns
