"""The jobs from a CSV file to ranked anomalies, and the stream."""

import csv
import io
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from payflux.config import COLUMNS, AnomalyConfig, MainConfig, ModelConfig, PreprocessConfig, TrainConfig
from payflux.functions.numbering import numbered
from payflux.operators import profile
from payflux.plans import detect, preprocess, training
from payflux.sources import store
from payflux.sources import transactions as T
from payflux.streaming import scoring


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("in") / "tx.csv"
    with p.open("w", newline="") as f:
        w = csv.writer(f)
        w.writerow([f"h{i}" for i in range(16)])
        for i in range(60):
            row = {c: f"{c}{i % 3}" for c in COLUMNS} | {"uetr": str(i), "instructed_amount": str(i), "payment_amount": str(i * 2), "credit_amount": "" if i % 7 == 0 else "1.5"}
            row |= {"txn_dt": f"2024-01-{1 + i % 28:02d} 10:00:00", "tds_dt": f"2024-01-{1 + i % 28:02d} 10:00:{i % 60:02d}", "debit_account_masked": f"a{i % 9}", "bene_account_masked": f"a{i % 7}"}
            w.writerow([row[c] for c in COLUMNS])
    return str(p)


def test_read(spark, path):
    df = T.read_csv(spark, path)
    assert sorted(r[0] for r in df.select("edge_id").collect()) == list(range(60))
    assert T.read_csv(spark, path, 5).count() == 5
    with pytest.raises(ValueError):
        T.read_csv(spark, None)
    with pytest.raises(IndexError):
        T.column_by_index(df, 99)
    missing = {r["name"]: r["missing"] for r in profile.missing_values(df).collect()}
    assert missing == {"credit_amount": 9}
    assert df.columns == [*COLUMNS, "edge_id"]  # the number is added last, so that positions are those of the file
    assert profile.dtypes(df)["col_0_uetr"] == "string"


def test_rows_are_numbered_as_they_stand_in_files(spark, tmp_path):
    """Many splits of several files, packed into tasks in another order; quoted and empty values."""
    folder, rows = tmp_path / "many", []
    folder.mkdir()
    for k, n in enumerate((700, 3, 0, 2500)):
        with (folder / f"part-{k}.csv").open("w", newline="") as f:
            w = csv.writer(f)
            w.writerow([f"h{i}" for i in range(16)])
            for _ in range(n):
                rows.append(f"r{(len(rows) * 7919) % 100_003}")
                w.writerow([rows[-1], 'a "quoted", value', *[""] * 14])
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        df = T.read_csv(spark, str(folder))
        assert [r["uetr"] for r in df.orderBy("edge_id").collect()] == rows
        assert sorted(r["edge_id"] for r in df.collect()) == list(range(len(rows)))
        assert [r["uetr"] for r in T.read_csv(spark, str(folder), 702).orderBy("edge_id").collect()] == rows[:702]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_temporary_tables_go(spark):
    from payflux.functions import numbering

    def files(path):
        return store.artifacts(spark, path.rsplit("/", 1)[0], (path.rsplit("/", 1)[1],)).popitem()[1]

    with pytest.raises(RuntimeError, match="failed"), numbering.temporary_tables(spark):
        paths = [numbering.materialised(spark.range(5)).inputFiles()[0].rsplit("/", 1)[0] for _ in range(2)]
        with numbering.temporary_tables(spark):
            inner = numbering.materialised(spark.range(5)).inputFiles()[0].rsplit("/", 1)[0]
            assert files(inner)
        assert files(inner) is None and all(files(p) for p in paths)
        raise RuntimeError("failed")
    assert [files(p) for p in paths] == [None, None]


def test_numbered_is_gapless_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert sorted((r["x"], r["n"]) for r in numbered(df, [F.col("x")], "n").collect()) == [(i, i) for i in range(1000)]


def test_whole_job(spark, path, tmp_path):
    config = PreprocessConfig(output_dir=str(tmp_path / "graph"))
    report = preprocess.run(spark, T.read_csv(spark, path), config)
    assert len(report["edge_feature_names"]) == 66 and len(report["node_feature_names"]) == 136
    assert preprocess.check(spark, config, report)["all_passed"]
    main = MainConfig(ModelConfig("gcn", "linear", hidden_channels=8, out_channels=4), TrainConfig(epochs=5), preprocessed_dir=config.output_dir, output_dir=str(tmp_path / "out"))
    result = detect.run(spark, main)
    assert result["epochs"] == 5 and result["preprocessing"] and len(result["top"]) == 60
    assert spark.read.parquet(f"{result['output']}/node_scores").count() == 9
    assert spark.read.parquet(f"{result['output']}/embeddings").count() == 9
    saved = io.BytesIO(store.load_bytes(spark, f"{result['output']}/model.npz"))
    model, history = training.load(main.model, len(store.load_graph(spark, config.output_dir).node_features.first()["features"]), saved)
    assert len(history) == 5 and training.parameters(model) == result["parameters"]
    graph = store.load_graph(spark, config.output_dir)
    sampled = replace(main, anomaly=AnomalyConfig(node_scores="sampled", num_samples=2))
    assert detect.detect(model, graph.node_features, graph.edges.where(~F.col("is_loop")), sampled)[0].count() == 9
    with pytest.raises(FileNotFoundError):
        store.load_graph(spark, str(tmp_path / "nothing"))


def test_stream(spark, path, tmp_path):
    import shutil

    folder = tmp_path / "arriving"
    folder.mkdir()
    shutil.copy(path, folder)
    accounts = spark.createDataFrame([("a0", 0.9), ("a1", 0.1)], "account string, score double")
    stream = scoring.scored(scoring.arriving(spark, str(folder)), accounts)
    q = stream.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(60)
    rows = spark.table("scored").collect()
    assert len(rows) == 60 and {r["score"] for r in rows} == {0.0, 0.1, 0.9}
    q = scoring.activity(scoring.arriving(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("sent").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("sent").agg(F.sum("sent")).first()[0] == 60
