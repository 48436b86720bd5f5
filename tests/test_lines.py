"""Numbers of lines without a sort of all of them, their way through CSV, and features whose code can be compiled."""

import re

import pytest
from pyspark.sql import functions as F

from payflux.functions import numbering
from payflux.plans import queries as Q
from payflux.sources import driver as D
from payflux.sources import transactions as T

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most", [100, 3])  # every group is small enough, or one is not
def test_places_by_group_are_those_of_a_sort(spark, most):
    df = spark.range(200).selectExpr("cast(pow(id, 2) % 37 as bigint) as g", "id % 7 as a", "id as b")
    own = numbering.numbered_by_group(df, "g", [F.col("a"), F.col("b").desc()], "place", most)
    expected = sorted(((r["g"], r["a"], -r["b"]) for r in df.collect()))
    assert [(r["g"], r["a"], -r["b"], r["place"]) for r in own.orderBy("place").collect()] == [(*e, i) for i, e in enumerate(expected)]
    assert numbering.numbered_by_group(df.limit(0), "g", [F.col("a")], "place").count() == 0


def test_lines_are_not_sorted_to_be_numbered(spark, capsys):
    D.transactions(spark, SF, number_rows=True).explain()
    plan = capsys.readouterr().out
    assert "windowspecdefinition(l_orderkey" in plan  # they are ranked within their order, where the join by it has brought them
    assert "rangepartitioning" not in plan


def test_lines_without_an_order_leave_no_gap(spark, tmp_path):
    for name in ("lineitem", "customer", "supplier", "nation", "orders"):
        df = D.table(spark, SF, name)
        (df.where("o_orderkey % 3 <> 0") if name == "orders" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    ids = [r["edge_id"] for r in D.transactions(spark, str(tmp_path), number_rows=True).orderBy("edge_id").collect()]
    assert ids == list(range(len(ids))) and 0 < len(ids) < D.table(spark, SF, "lineitem").count()


def test_csv_is_sorted_once_and_only_what_is_wanted_is_written_again(spark):
    path = Q.csv_of(spark, SF)
    assert all(n.endswith(".csv.gz") for n in spark.read.text(path).inputFiles())
    read = T.read_csv(spark, path, columns=("uetr",))
    assert read.columns == ["uetr", "edge_id"]
    numbered = D.transactions(spark, SF, number_rows=True).orderBy("edge_id").collect()
    assert [(r["edge_id"], r["uetr"]) for r in read.orderBy("edge_id").collect()] == [(r["edge_id"], r["uetr"]) for r in numbered]


@pytest.mark.parametrize("name", ["f17_edge_features", "c4_features_of_new_transactions", "c4_features_of_merged_fits"])
def test_the_code_of_features_can_be_compiled(spark, capsys, name):
    df = Q.QUERIES[name](spark, SF)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000  # longer methods are interpreted for ever
