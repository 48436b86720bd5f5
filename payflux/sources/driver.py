"""The transaction model over order tables: customers pay suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payflux.config import COLUMNS
from payflux.functions.numbering import numbered_by_group

LINE = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str, number_rows: bool = False, nulls: bool = False, in_order: bool = False) -> DataFrame:
    """The 16 columns; edge_id if rows are to be numbered (in the order of all columns of a line).

    nulls: some amounts, channels and storage times are missing, as their part numbers say. in_order: rows are sorted in that order.
    """
    lines, orders, customers, suppliers, nations = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    nation = lambda side: nations.select(F.col("n_nationkey").alias(f"{side}_key"), F.col("n_name").alias(f"{side}_nation"))
    # orders get their payers first: where Spark shuffles for it, it does so with orders, not with their lines
    payers = customers.select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = orders.join(payers, F.col("o_custkey") == F.col("c_custkey")).join(nation("payer"), F.col("c_nationkey") == F.col("payer_key"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # each join is with a table as it is, whose size Spark knows: for a join of joins it would take the product, and shuffle lines by l_suppkey
    rows = rows.join(suppliers.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(nation("payee"), F.col("s_nationkey") == F.col("payee_key"))
    order = [F.col(c).asc_nulls_first() for c in LINE]
    if in_order:  # what columns are made of is sorted, not the columns
        rows = rows.orderBy(*order)
    if number_rows:
        used = (*LINE, "o_orderpriority", "o_orderstatus", "o_orderdate", "o_custkey", "c_mktsegment", "payer_nation", "payee_nation")
        rows = numbered_by_group(rows.select(*used), "l_orderkey", order[1:], "edge_id")
    missing = lambda c, k: F.when(F.col("l_partkey") % k != 0, c) if nulls else c
    payment = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    columns = {
        "uetr": F.concat_ws("-", "l_orderkey", "l_linenumber"),
        "payment_channel": missing(F.col("o_orderpriority"), 11),
        "debit_bic_code": F.col("payer_nation"),
        "bene_bic_code": F.col("payee_nation"),
        "evt_tran_stat_cde": F.col("o_orderstatus"),
        "instructed_currency": F.col("c_mktsegment"),
        "instructed_amount": missing(F.col("l_extendedprice"), 7),
        "payment_currency": F.col("l_returnflag"),
        "payment_amount": payment,
        "credit_currency": F.col("l_linestatus"),
        "credit_amount": payment * (1 + F.col("l_tax")),
        "txn_dt": F.col("o_orderdate").cast("timestamp"),
        "tds_dt": missing(F.col("l_shipdate").cast("timestamp"), 13),
        "mop": F.concat("l_returnflag", "l_linestatus"),
        "debit_account_masked": F.concat(F.lit("C"), F.col("o_custkey").cast("string")),
        "bene_account_masked": F.concat(F.lit("S"), F.col("l_suppkey").cast("string")),
    }
    return rows.select(*(["edge_id"] if number_rows else []), *(columns[c].alias(c) for c in COLUMNS))


def sql(number_rows: bool = False, nulls: bool = False) -> str:
    """The same as SQL."""
    missing = lambda c, k: f"case when l_partkey % {k} <> 0 then {c} end" if nulls else c
    number = f"row_number() over (order by {', '.join(LINE)}) - 1 as edge_id, " if number_rows else ""
    return f"""select {number}l_orderkey || '-' || l_linenumber as uetr, {missing('o_orderpriority', 11)} as payment_channel, pn.n_name as debit_bic_code,
      sn.n_name as bene_bic_code, o_orderstatus as evt_tran_stat_cde, c_mktsegment as instructed_currency, {missing('l_extendedprice', 7)} as instructed_amount,
      l_returnflag as payment_currency, l_extendedprice * (1 - l_discount) as payment_amount, l_linestatus as credit_currency,
      l_extendedprice * (1 - l_discount) * (1 + l_tax) as credit_amount, o_orderdate as txn_dt, {missing('l_shipdate', 13)} as tds_dt,
      l_returnflag || l_linestatus as mop, 'C' || o_custkey as debit_account_masked, 'S' || l_suppkey as bene_account_masked
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation pn on c_nationkey = pn.n_nationkey
      join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey"""
