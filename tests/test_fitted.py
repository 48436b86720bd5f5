"""Fits that are stored, merged and applied to other transactions, a stream among them."""

import pytest
from pyspark.sql import functions as F

from payflux.config import COLUMNS, PreprocessConfig
from payflux.operators import edges as E
from payflux.plans import fitted
from payflux.sources import store
from payflux.sources.transactions import SCHEMA


def rows(spark, n, start=0):
    df = spark.range(start, start + n).withColumnRenamed("id", "edge_id")
    k = F.col("edge_id")
    made = {
        "uetr": k.cast("string"), "payment_channel": F.concat(F.lit("c"), (F.floor(k / 10) % 7).cast("string")), "debit_bic_code": F.when(k % 5 > 0, F.concat(F.lit("b"), (k % 3).cast("string"))),
        "instructed_amount": F.when(k % 4 > 0, (k * k % 101).cast("string")), "payment_amount": F.lit("5"), "credit_amount": F.when(k % 9 > 0, (k * 1.5).cast("string")).otherwise("bad"),
        "txn_dt": F.date_format(F.timestamp_seconds(k * 7211 + 1_700_000_000), "yyyy-MM-dd HH:mm:ss"),
        "tds_dt": F.when(k % 6 > 0, F.date_format(F.timestamp_seconds(k * 7211 + 1_700_000_000 + k % 17), "yyyy-MM-dd HH:mm:ss")),
    }
    return df.select("edge_id", *(made.get(c, F.lit("x")).cast("string").alias(c) for c in COLUMNS))


def values(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("config", [PreprocessConfig(), PreprocessConfig(encode_categories="code")], ids=["vectors", "codes"])
def test_merged_fits_are_the_fit_of_all(spark, config):
    parts = [rows(spark, 40), rows(spark, 1, 40), rows(spark, 79, 41)]
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    whole = fitted.fit(everything, config)
    state = fitted.merged(fitted.merged(fitted.fit(parts[0], config), fitted.fit(parts[1], config)), fitted.fit(parts[2], config))
    assert values(whole.categories) == values(state.categories) and values(whole.delays) == values(state.delays)
    for a, b in zip(values(whole.numbers), values(state.numbers), strict=True):
        assert a[0] == b[0] and a[1] == b[1] and a[2:] == pytest.approx(b[2:], rel=1e-9, abs=1e-9)
    got, names = fitted.transformed(everything, state, config)
    expected, same = E.edge_features(everything, config)
    assert names == same
    for a, b in zip(sorted(map(tuple, got.collect())), sorted(map(tuple, expected.collect())), strict=True):
        assert a == pytest.approx(b, abs=1e-9)


def test_codes_never_change(spark):
    a = fitted.fit(rows(spark, 25))
    b = fitted.merged(a, fitted.fit(rows(spark, 60, 25)))
    before, after = ({(r["name"], r["value"]): r["code"] for r in s.categories.collect()} for s in (a, b))
    assert before.items() <= after.items() and len(after) > len(before)
    for c in {n for n, _ in after}:
        codes = sorted(v for (n, _), v in after.items() if n == c)
        assert codes == list(range(len(codes)))


def test_unseen_categories_are_unknown(spark):
    config = PreprocessConfig(encode_categories="code")
    state = fitted.fit(rows(spark, 20), config)  # channels c0 and c1; bank codes are missing at times
    new = rows(spark, 3, 60).withColumn("debit_bic_code", F.lit("never seen"))
    got = fitted.transformed(new, state, config)[0].collect()
    unknown = state.categories.where("name = 'debit_bic_code' and value = 'UNKNOWN'").first()["code"]
    assert all(r["payment_channel_code"] == -1 and r["debit_bic_code_code"] == unknown for r in got)
    vector = fitted.transformed(new, state)[0].first()
    missing = fitted.transformed(new.withColumn("debit_bic_code", F.lit(None).cast("string")), state)[0].first()
    assert [vector[f"debit_bic_code_emb_{i}"] for i in range(8)] == [missing[f"debit_bic_code_emb_{i}"] for i in range(8)]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "fit")
    with pytest.raises(FileNotFoundError):
        fitted.load(spark, path)
    a = fitted.fit(rows(spark, 20))
    b = fitted.merged(a, fitted.fit(rows(spark, 20, 20)))
    assert (fitted.save(a, path), fitted.save(b, path)) == (1, 2)
    store.save_tables({"numbers": a.numbers}, f"{path}/version=000003")  # cut off: not whole
    assert fitted.versions(spark, path) == [1, 2]
    assert values(fitted.load(spark, path).delays) == values(b.delays) and values(fitted.load(spark, path, 1).numbers) == values(a.numbers)
    with pytest.raises(FileNotFoundError):
        fitted.load(spark, path, 3)


def test_nothing_fitted(spark):
    none = fitted.fit(rows(spark, 0))
    assert values(fitted.merged(none, fitted.fit(rows(spark, 9))).numbers) == values(fitted.fit(rows(spark, 9)).numbers)
    got = fitted.transformed(rows(spark, 2), none)[0].collect()
    assert len(got) == 2 and all(v is not None for r in got for v in r)


def test_stream(spark, tmp_path):
    """What arrives gets the features that a batch of it gets."""
    state, new = fitted.fit(rows(spark, 50)), rows(spark, 30, 50)
    folder = str(tmp_path / "in")
    new.select(*COLUMNS).write.option("header", True).csv(folder)
    stream = spark.readStream.schema(SCHEMA).option("header", True).csv(folder)
    q = fitted.transformed(stream, state)[0].writeStream.format("memory").queryName("features").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert values(spark.table("features")) == values(fitted.transformed(new.drop("edge_id"), state)[0])
