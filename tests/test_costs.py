"""What a query works out, holds or reads no more often than it must, and odd rows for which that must make no difference."""

import math

import pytest
from pyspark.sql import functions as F

from payflux.functions.vectors import layer_norm
from payflux.operators import anomalies as A
from payflux.operators import profile as P
from payflux.plans import stored_queries


def plan_of(df, capsys) -> str:
    df.explain(True)
    return capsys.readouterr().out


def test_moments_of_a_vector_are_summed_once(spark, capsys):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "i int, v array<float>").select("i", F.posexplode(layer_norm(F.col("v"))))
    plan = plan_of(df, capsys)
    optimised = plan[plan.index("== Optimized Logical Plan ==") : plan.index("== Physical Plan ==")]
    assert optimised.count("aggregate(") == 2  # one for the mean, one for the variance


def test_layer_norm_of_odd_vectors(spark):
    nan, root = math.nan, math.sqrt(2 / 3 + 1e-5)
    vectors = [None, [], [1.0, None], [nan, 1.0], [math.inf, 1.0], [5.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "i int, v array<float>")
    found = [r["x"] for r in df.select("i", layer_norm(F.col("v")).alias("x")).orderBy("i").collect()]
    assert found[:3] == [None, [], [None, None]]
    assert all(math.isnan(x) for v in found[3:5] for x in v)
    assert found[5] == [0.0]
    assert found[6] == found[7] == [pytest.approx(x) for x in (-1 / root, 0.0, 1 / root)]


#: Nulls, texts that are equal or empty, zeros of both signs, NaN, and a row that comes twice.
ODD = [(None, None, None, None), ("", 0.0, 1, "x"), ("null", -0.0, 1, "x"), ("a", math.nan, None, "x"), ("a", math.nan, 2, "x"), ("a", 1.5, 2, None), ("a", 1.5, 2, None)]
ODD_TYPES = "s string, d double, n int, u string"


def counted_beside_each_other(df):
    ones = [df.agg(F.lit(c), F.count("*"), F.count_if(F.col(c).isNull()), F.count_distinct(F.col(c))).first() for c in df.columns]
    return [tuple(r) for r in ones]


@pytest.mark.parametrize("rows", [ODD, ODD[:1], []])
def test_overview_of_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, ODD_TYPES).withColumn("t", F.when(F.col("n") == 2, F.lit("2024-01-01").cast("timestamp")))
    found = P.overview(df)
    assert found.dtypes == [("name", "string"), ("rows", "bigint"), ("missing", "bigint"), ("different", "bigint")]
    assert [tuple(r) for r in found.collect()] == counted_beside_each_other(df)


def test_overview_holds_no_rows_as_wide_as_the_table(spark, capsys):
    df = spark.createDataFrame(ODD, ODD_TYPES)
    df = df.select(*(F.col(c).alias(f"{c}_{i}") for c in df.columns for i in range(4)))
    plan = plan_of(P.overview(df), capsys)
    physical = plan[plan.index("== Physical Plan ==") :]
    keys = [line.split("keys=[", 1)[1].split("]", 1)[0] for line in physical.splitlines() if "HashAggregate(keys=[" in line]
    assert "Expand" not in physical and max(len(k.split(", ")) for k in keys) == 4  # the place, and a value of each of three types


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.0, 4.0, None], [math.nan, 1.0, 3.0], [None]])
def test_summary_of_stored_scores(spark, tmp_path, values):
    spark.createDataFrame([(v,) for v in values], "score double").write.parquet(f"{tmp_path}/scores")
    scores, own = spark.read.parquet(f"{tmp_path}/scores"), spark.createDataFrame([(0.5,), (None,)], "score double")
    written, read = A.summary(own, scores), A.summary(own, scores, stored=True, sizes=True)
    assert read.drop("nodes", "edges").first().asDict() == pytest.approx(written.first().asDict(), nan_ok=True)
    assert read.select("nodes", "edges").first() == (2, len(values))


def test_stored_results_are_not_written_again_or_counted_apart(spark, monkeypatch):
    written, counted = [], []
    frame, count, kept = type(spark.range(1)), type(spark.range(1)).count, A.materialised
    monkeypatch.setattr(A, "materialised", lambda df: written.append(df.columns) or kept(df))
    monkeypatch.setattr(frame, "count", lambda df: counted.append(df.columns) or count(df))
    d = "/root/testdata/sf0.001"
    row = stored_queries.QUERIES["s12_stored_results"](spark, d).first()
    assert (written, counted) == ([], [])
    assert row["edges"] == count(spark.read.parquet(f"{d}/lineitem.parquet")) and row["nodes"] > 0
