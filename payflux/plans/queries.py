"""Named queries over the driver's tables, each with SQL that gives the same rows where SQL can.

Names begin with the id of the operator in the inventory. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payflux.config import COLUMNS, ColumnMap, PreprocessConfig
from payflux.functions.numbering import materialised, scratch
from payflux.functions.vectors import ACTIVATIONS, layer_norm
from payflux.operators import anomalies as A
from payflux.operators import charts as V
from payflux.operators import edges as E
from payflux.operators import graph as G
from payflux.operators import losses as L
from payflux.operators import message_passing as MP
from payflux.operators import nodes as N
from payflux.operators import profile as P
from payflux.operators import statistics as S
from payflux.operators.masking import masked
from payflux.plans import fitted as Fitted
from payflux.sources import driver as D
from payflux.sources import transactions as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

M = ColumnMap()
CONFIG = PreprocessConfig()
#: The graph of nations has few nodes, loops and parallel edges.
NATIONS = PreprocessConfig(columns=ColumnMap(source="debit_bic_code", destination="bene_bic_code"))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounding(c: Column, digits: int = 6) -> Column:
    """c to so many digits, halves away from zero, in doubles all the way: round() goes through a decimal for each value."""
    scaled = c * float(10**digits)
    return F.when(F.abs(scaled) < 1e15, F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / float(10**digits) + 0.0).otherwise(c)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles of df, rounded; whole numbers as bigint."""
    kinds = dict(df.dtypes)
    new = {c: rounding(F.col(c), digits) for c, k in kinds.items() if k == "double"} | {c: F.col(c).cast("bigint") for c, k in kinds.items() if k in ("int", "smallint")}
    return df.withColumns(new) if new else df


TX, TXN, TX0 = f"tx as ({D.sql(True)})", f"tx as ({D.sql(True, True)})", f"tx as ({D.sql()})"
ROUND = "round({0}, 6) as {1}"


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) as {name}"


def scaled_sql(x: str, over: str = "over ()") -> str:
    return f"({x} - avg({x}) {over}) / (case when coalesce(stddev_pop({x}) {over}, 0) = 0 then 1 else stddev_pop({x}) {over} end)"


# --- sources ---------------------------------------------------------------------------------


@query("s1_transactions", f"with {TX} select edge_id, uetr, debit_account_masked, bene_account_masked, mop, {r('credit_amount', 'credit_amount')} from tx")
def s1(spark, d):
    return rounded(D.transactions(spark, d, number_rows=True).select("edge_id", "uetr", "debit_account_masked", "bene_account_masked", "mop", "credit_amount"))


@query("s2_first_rows", f"with {TX} select edge_id, uetr, {r('payment_amount', 'payment_amount')} from tx where edge_id < 500")
def s2(spark, d):
    return rounded(T.first_rows(D.transactions(spark, d, number_rows=True), 500).select("edge_id", "uetr", "payment_amount"))


def csv_of(spark: SparkSession, d: str) -> str:
    """All transactions as CSV files in a scratch folder, in the order of their lines: sorted once, and numbered only as they are read."""
    path = scratch(spark, "csv")
    T.write_csv(D.transactions(spark, d, nulls=True, in_order=True), path, compression="gzip")
    return path


_WANTED = ("uetr", "mop", "payment_channel", "credit_amount", "tds_dt")
_AS_READ = "edge_id, uetr, mop, payment_channel, credit_amount, epoch_us(tds_dt) as storage_us"


def as_read(df: DataFrame) -> DataFrame:
    e = E.parsed(df)
    return rounded(e.select("edge_id", "uetr", "mop", "payment_channel", "credit_amount", F.unix_micros("tds_dt").alias("storage_us")))


@query("s1_transactions_of_csv", f"with {TXN} select * replace (round(credit_amount, 6) as credit_amount) from (select {_AS_READ} from tx)")
def s1_csv(spark, d):
    """Written as CSV and read again: numbers are those of the rows in the files."""
    return as_read(T.read_csv(spark, csv_of(spark, d), columns=_WANTED))


@query("s2_first_rows_of_csv", f"with {TXN} select * replace (round(credit_amount, 6) as credit_amount) from (select {_AS_READ} from tx) where edge_id < 500")
def s2_csv(spark, d):
    """The first rows of a CSV of several files."""
    return as_read(T.read_csv(spark, csv_of(spark, d), 500, columns=_WANTED))


@query("f5_category_codes_of_csv", f"with {TXN} " + " union all ".join(f"select '{c}' as name, * from (select value, row_number() over (order by first_edge) - 1 as code from (select coalesce({c}, 'UNKNOWN') as value, min(edge_id) as first_edge from tx group by 1))" for c in M.categorical))
def f5_csv(spark, d):
    """Codes in the order in which categories first appear in the files."""
    df = T.read_csv(spark, csv_of(spark, d), columns=M.categorical)
    return _union([E.category_codes(df, c).select(F.lit(c).alias("name"), "value", "code") for c in M.categorical])


@query("s3_column_by_index", f"with {TX0} select debit_bic_code from tx")
def s3(spark, d):
    return T.column_by_index(D.transactions(spark, d), 2)


@query("s4_columns_by_indices", f"with {TX0} select mop, payment_channel, evt_tran_stat_cde from tx")
def s4(spark, d):
    return T.columns_by_indices(D.transactions(spark, d), [13, 1, 4])


@query("s5_columns_by_role", f"with {TX0} select {', '.join((M.source, M.destination))}, {', '.join(M.categorical)}, {', '.join(r(c, c) for c in M.numeric)}, epoch_us({M.event_time}) as event_us from tx")
def s5(spark, d):
    df = D.transactions(spark, d)
    columns = [*T.account_columns(df).columns, *T.categorical_columns(df).columns, *T.numeric_columns(df).columns]
    return rounded(df.select(*columns, F.unix_micros(T.time_columns(df).columns[0]).alias("event_us")))


# --- profiles --------------------------------------------------------------------------------


@query("p1_missing_values", f"with {TXN} select * from ({' union all '.join(f'''select '{c}' as name, count(*) filter ({c} is null) as missing, round(100.0 * count(*) filter ({c} is null) / count(*), 2) as percent from tx''' for c in COLUMNS)}) where missing > 0")
def p1(spark, d):
    return P.missing_values(D.transactions(spark, d, nulls=True))


@query("p3_overview", f"with {TXN} {' union all '.join(f'''select '{c}' as name, count(*) as rows, count(*) filter ({c} is null) as missing, count(distinct {c}) as different from tx''' for c in COLUMNS)}")
def p3(spark, d):
    return P.overview(D.transactions(spark, d, nulls=True))


_ODD = "case when l_partkey % 5 = 0 then 'NaN'::double when l_partkey % 7 = 0 then 'Infinity'::double when l_partkey % 11 = 0 then 0.0 else l_tax end"


@query("p5_tensor_quality", f"""with q as (select {_ODD} as x, l_discount as y from lineitem)
  {' union all '.join(f"select '{c}' as name, count(*) filter (isnan({c})) as n_nan, count(*) filter (isinf({c})) as n_inf, count(*) filter ({c} = 0) as n_zero, min({c}) filter (not isnan({c})) as least, max({c}) filter (not isnan({c})) as greatest, round(avg({c}) filter (not isnan({c})), 8) as mean, count(*) filter (isnan({c}) or isinf({c})) = 0 as passed from q" for c in 'xy')}""")
def p5(spark, d):
    k = F.col("l_partkey")
    x = F.when(k % 5 == 0, float("nan")).when(k % 7 == 0, float("inf")).when(k % 11 == 0, 0.0).otherwise(F.col("l_tax"))
    return rounded(P.tensor_quality(D.table(spark, d, "lineitem").select(x.alias("x"), F.col("l_discount").alias("y")), ["x", "y"]), 8)  # to 6 digits the mean of y is a tie


# --- edge features ---------------------------------------------------------------------------


def _fills(columns: tuple[str, ...], name: str) -> str:
    return f"with {TXN} " + " union all ".join(f"select '{c}' as name, count(*) filter ({c} is null) as {name}, round(100.0 * count(*) filter ({c} is null) / count(*), 6) as percent from tx" for c in columns)


@query("f2_numeric_fills", _fills(M.numeric, "filled"))
def f2(spark, d):
    return rounded(E.fill_report(E.parsed(D.transactions(spark, d, nulls=True)), list(M.numeric)))


@query("f3_scaled_amounts", f"with {TXN}, f as (select edge_id, {', '.join(f'coalesce({c}, 0) as {c}' for c in M.numeric)} from tx) select edge_id, {', '.join(r(scaled_sql(c), c) for c in M.numeric)} from f")
def f3(spark, d):
    df = E.parsed(D.transactions(spark, d, number_rows=True, nulls=True))
    return rounded(E.numeric_features(df, list(M.numeric)).select("edge_id", *M.numeric))


def codes_sql(c: str) -> str:
    return f"select value, row_number() over (order by first_edge) - 1 as code from (select coalesce({c}, 'UNKNOWN') as value, min(edge_id) as first_edge from tx group by 1)"


@query("f5_category_codes", f"with {TXN} " + " union all ".join(f"select '{c}' as name, * from ({codes_sql(c)})" for c in M.categorical))
def f5(spark, d):
    df = materialised(D.transactions(spark, d, number_rows=True, nulls=True).select("edge_id", *M.categorical))
    out = [E.category_codes(df, c).select(F.lit(c).alias("name"), "value", "code") for c in M.categorical]
    return out[0] if len(out) == 1 else _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unit_sql(*parts: str) -> str:
    joined = " || '|' || ".join(parts)
    return f"(('0x' || substr(md5({joined}), 1, 8))::bigint / 4294967296.0)"


def vectors_sql(c: str, dim: int = 8) -> str:
    entries = ", ".join(f"sqrt(6.0 / (n + {dim})) * (2 * {unit_sql(f'''{chr(39)}{c}{chr(39)}''', 'value', f'''{chr(39)}{i}{chr(39)}''')} - 1) as {c}_emb_{i}" for i in range(dim))
    return f"select value, {entries} from (select value, count(*) over () as n from ({codes_sql(c)}))"


@query("f6_category_vectors", f"with {TXN} select value, {', '.join(r(f'mop_emb_{i}', f'mop_emb_{i}') for i in range(8))} from ({vectors_sql('mop')})")
def f6(spark, d):
    df = D.transactions(spark, d, number_rows=True, nulls=True)
    return rounded(E.category_vectors(E.category_codes(df, "mop"), "mop").drop("code"))


@query("f7_encoding_info", f"with {TXN}, c as ({codes_sql('payment_channel')}) select count(*) as categories, bool_or(value = 'UNKNOWN') as has_unknown, string_agg(value, ',' order by code) filter (code < 10) as samples from c")
def f7(spark, d):
    return E.encoding_info(E.category_codes(D.transactions(spark, d, number_rows=True, nulls=True), "payment_channel"))


@query("f10_parse_failures", _fills((M.event_time, M.storage_time), "failed"))
def f10(spark, d):
    return rounded(E.parse_failures(E.parsed(D.transactions(spark, d, nulls=True)), [M.event_time, M.storage_time]))


_PARTS = {"hour": "coalesce(hour({0}), 0)::double", "dow": "coalesce(isodow({0}) - 1, 0)::double", "dom": "coalesce(day({0}), 1)::double"}


@query("f11_time_parts", f"select event_id, {', '.join(f'{v.format("ts")} as ts_{k}' for k, v in _PARTS.items())} from events")
def f11(spark, d):
    df, names = E.with_time_parts(D.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["ts"])
    return df.select("event_id", *names)


_TIME = [f"{c}_{k}" for c in (M.event_time, M.storage_time) for k in _PARTS]
_TIME_SQL = ", ".join(f"{v.format(c)} as {c}_{k}" for c in (M.event_time, M.storage_time) for k, v in _PARTS.items())


@query("f12_scaled_time_parts", f"with {TXN}, f as (select edge_id, {_TIME_SQL} from tx) select edge_id, {', '.join(r(scaled_sql(c), c) for c in _TIME)} from f")
def f12(spark, d):
    df, names = E.with_time_parts(E.parsed(D.transactions(spark, d, number_rows=True, nulls=True)), [M.event_time, M.storage_time])
    return rounded(E.standardised(df.select("edge_id", *names), names))


_DELAY = "(epoch_us(tds_dt) - epoch_us(txn_dt)) / 1e6"


@query("f13_delay_statistics", f"""with {TXN}, f as (select {_DELAY} as delay from tx) select count(delay) as valid, count(*) - count(delay) as invalid, {r('avg(delay)', 'mean')}, {r('quantile_cont(delay, 0.5)', 'median')},
  min(delay) as least, max(delay) as greatest, {r('stddev_samp(delay)', 'std')}, count(*) filter (delay < 0) as negative from f""")
def f13(spark, d):
    return rounded(E.delay_statistics(E.with_delay(E.parsed(D.transactions(spark, d, nulls=True)))))


_FILLED = f"f as (select edge_id, coalesce({_DELAY}, (select quantile_cont({_DELAY}, 0.5) from tx), 0) as delay from tx)"


@query("f15_scaled_delay", f"with {TXN}, {_FILLED} select edge_id, {r(scaled_sql('delay'), 'delay_scaled')} from f")
def f15(spark, d):
    return rounded(E.with_scaled_delay(E.with_delay(E.parsed(D.transactions(spark, d, number_rows=True, nulls=True)))).select("edge_id", "delay_scaled"))


def features_sql() -> str:
    names = [f"{c}_emb_{i}" for c in M.categorical for i in range(8)]
    tables = ", ".join(f"v_{c} as ({vectors_sql(c)})" for c in M.categorical)
    joins = " ".join(f"join v_{c} on v_{c}.value = coalesce(tx.{c}, 'UNKNOWN')" for c in M.categorical)
    filled = ", ".join(f"coalesce(tx.{c}, 0) as n_{c}" for c in M.numeric)
    base = f"base as (select tx.edge_id, {filled}, {', '.join(names)}, {_TIME_SQL}, coalesce({_DELAY}, mid, 0) as delay from tx cross join (select quantile_cont({_DELAY}, 0.5) as mid from tx) {joins})"
    out = [r(scaled_sql(f"n_{c}"), c) for c in M.numeric] + [r(n, n) for n in names] + [r(scaled_sql(c), c) for c in _TIME] + [r(scaled_sql("delay"), "delay_scaled")]
    return f"with {TXN}, {tables}, {base} select edge_id, {', '.join(out)} from base"


@query("f17_edge_features", features_sql())
def f17(spark, d):
    return E.edge_features(D.transactions(spark, d, number_rows=True, nulls=True), finish=rounding)[0]


# --- features by a stored fit ------------------------------------------------------------------

#: Orders before it fit, those from it on are new.
CUT = "1998-01-01"


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = D.transactions(spark, d, number_rows=True, nulls=True)
    df = materialised(df.select("edge_id", *M.categorical, *M.numeric, M.event_time, M.storage_time))  # what features are made of
    return df.where(F.col("txn_dt") < CUT), df.where(F.col("txn_dt") >= CUT)


def stored(spark: SparkSession, state: Fitted.Fitted) -> Fitted.Fitted:
    """The state, written and read again."""
    path = scratch(spark, "fit")
    Fitted.save(state, path)
    return Fitted.load(spark, path)


def new_features_sql() -> str:
    """Orders from CUT on, by moments, median and category counts of those before it."""
    known = f"known as (select * from tx where txn_dt < '{CUT}'), later as (select * from tx where txn_dt >= '{CUT}')"
    times = {f"{c}_{k}": v.format(c) for c in (M.event_time, M.storage_time) for k, v in _PARTS.items()}
    plain = {c: f"coalesce({c}, 0)" for c in M.numeric} | times
    delay = f"coalesce({_DELAY}, mid, 0)"
    stats = ", ".join([*(f"avg({v}) as mean_{c}, stddev_pop({v}) as std_{c}" for c, v in plain.items()), f"avg({delay}) as mean_delay, stddev_pop({delay}) as std_delay, any_value(mid) as mid"])
    sizes = ", ".join(f"(select count(distinct coalesce({c}, 'UNKNOWN')) from known) as size_{c}" for c in M.categorical)
    fit_sql = f"mids as (select quantile_cont({_DELAY}, 0.5) as mid from known), stats as (select {stats} from known cross join mids), sizes as (select {sizes})"
    scale = lambda x, c: f"({x} - mean_{c}) / (case when coalesce(std_{c}, 0) = 0 then 1 else std_{c} end)"
    seen = {c: f"case when coalesce({c}, 'UNKNOWN') in (select distinct coalesce({c}, 'UNKNOWN') from known) then coalesce({c}, 'UNKNOWN') else 'UNKNOWN' end" for c in M.categorical}
    values = f"named as (select *, {', '.join(f'{v} as v_{c}' for c, v in seen.items())} from later)"
    parts = lambda c, i: unit_sql(repr(c), f"v_{c}", repr(str(i)))
    vectors = [r(f"sqrt(6.0 / (size_{c} + 8)) * (2 * {parts(c, i)} - 1)", f"{c}_emb_{i}") for c in M.categorical for i in range(8)]
    out = [r(scale(v, c), c) for c, v in plain.items() if c in M.numeric] + vectors + [r(scale(v, c), c) for c, v in times.items()] + [r(scale(delay, "delay"), "delay_scaled")]
    return f"with {TXN}, {known}, {fit_sql}, {values} select edge_id, {', '.join(out)} from named cross join stats cross join sizes"


@query("c4_features_of_new_transactions", new_features_sql())
def c4(spark, d):
    """Fitted on the orders of earlier years, stored, and applied to the later ones."""
    earlier, later = halves(spark, d)
    return Fitted.transformed(later, stored(spark, Fitted.fit(earlier)), finish=rounding)[0]


@query("c4_features_of_merged_fits", features_sql())
def c4_merged(spark, d):
    """Both halves fitted on their own and merged: the features are those of one fit of all."""
    earlier, later = halves(spark, d)
    state = stored(spark, Fitted.merged(Fitted.fit(earlier), Fitted.fit(later)))
    return Fitted.transformed(earlier.unionByName(later), state, finish=rounding)[0]


@query("c6_codes_that_grow", f"with {TXN}, s as (select *, txn_dt >= '{CUT}' as late from tx) " + " union all ".join(f"select '{c}' as name, value, row_number() over (order by late, first_edge) - 1 as code from (select coalesce({c}, 'UNKNOWN') as value, min(late) as late, min(edge_id) filter (not late) as early_edge, coalesce(min(edge_id) filter (not late), min(edge_id)) as first_edge from s group by 1)" for c in M.categorical))
def c6(spark, d):
    """Codes of the earlier orders, with those of values that came later behind them."""
    earlier, later = halves(spark, d)
    return Fitted.merged(Fitted.fit(earlier), Fitted.fit(later)).categories


# --- graph -----------------------------------------------------------------------------------


def ends_sql(config: PreprocessConfig, number: bool = False) -> str:
    m = config.columns
    return f"{TX if number else TX0}, ends as (select {'edge_id, ' if number else ''}{m.source} as src, {m.destination} as dst from tx), sides as (select src as account, 1 as s, 0 as d from ends union all select dst, 0, 1 from ends), accounts as (select account, max(s) = 1 as is_src, max(d) = 1 as is_dst from sides group by account), nodes as (select row_number() over (order by account) - 1 as node_id, account from accounts)"


def index_sql(config: PreprocessConfig) -> str:
    return ends_sql(config, True) + ", edges as (select edge_id, s.node_id as src_id, d.node_id as dst_id from ends join nodes s on s.account = src join nodes d on d.account = dst)"


LOOPED = ", looped as (select edge_id, src_id, dst_id, false as is_loop from edges union all select null, node_id, node_id, true from nodes), degrees as (select src_id as node_id, count(*) as degree from looped group by 1)"


def graph(spark: SparkSession, d: str, config: PreprocessConfig) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (edge_id, src_id, dst_id)."""
    ends = materialised(G.endpoints(D.transactions(spark, d, number_rows=True), config))
    nodes = G.nodes(ends)
    return nodes, G.edge_index(ends, nodes)


@query("g2_accounts", f"with {ends_sql(CONFIG)} select * from accounts")
def g2(spark, d):
    return G.accounts(G.endpoints(D.transactions(spark, d)))


@query("g3_node_ids", f"with {ends_sql(CONFIG)} select * from nodes")
def g3(spark, d):
    return G.nodes(G.endpoints(D.transactions(spark, d)))


_MEMBER = "select count(*) as accounts, count(*) filter (is_src and not is_dst) as source_only, count(*) filter (is_dst and not is_src) as destination_only, count(*) filter (is_src and is_dst) as bidirectional from accounts"


@query("g4_membership", f"with {ends_sql(CONFIG)} {_MEMBER}")
def g4(spark, d):
    return G.membership(G.endpoints(D.transactions(spark, d)))


@query("g4_membership_of_nations", f"with {ends_sql(NATIONS)} {_MEMBER}")
def g4n(spark, d):
    return G.membership(G.endpoints(D.transactions(spark, d), NATIONS))


@query("g5_edge_index", f"with {index_sql(CONFIG)} select * from edges")
def g5(spark, d):
    return graph(spark, d, CONFIG)[1]


def named_loops(edges: DataFrame) -> DataFrame:
    """Added loops with an edge_id of -1."""
    return edges.withColumn("edge_id", F.coalesce("edge_id", F.lit(-1).cast("long")))


@query("g6_looped_edges", f"with {index_sql(NATIONS)}{LOOPED} select * replace (coalesce(edge_id, -1) as edge_id) from looped")
def g6(spark, d):
    nodes, edges = graph(spark, d, NATIONS)
    return named_loops(G.looped(edges, nodes))


@query("g7_source_degrees", f"with {index_sql(NATIONS)}{LOOPED} select * from degrees")
def g7(spark, d):
    nodes, edges = graph(spark, d, NATIONS)
    return G.source_degrees(G.looped(edges, nodes))


def weights_sql(config: PreprocessConfig) -> str:
    return f"with {index_sql(config)}{LOOPED} select coalesce(edge_id, -1) as edge_id, src_id, dst_id, is_loop, round(1 / sqrt(s.degree) * (1 / sqrt(d.degree)), 6) as weight from looped join degrees s on s.node_id = src_id join degrees d on d.node_id = dst_id"


@query("g9_edge_weights", weights_sql(CONFIG))
def g9(spark, d):
    nodes, edges = graph(spark, d, CONFIG)
    return rounded(named_loops(G.weighted(G.looped(edges, nodes))))


@query("g9_edge_weights_of_nations", weights_sql(NATIONS))
def g9n(spark, d):
    nodes, edges = graph(spark, d, NATIONS)
    return rounded(named_loops(G.weighted(G.looped(edges, nodes))))


@query("g10_graph_meta", f"with {index_sql(NATIONS)}{LOOPED} select (select count(*) from nodes) as nodes, count(*) filter (not is_loop) as edges, count(*) as edges_with_loops, count(*) filter (not is_loop and src_id = dst_id) as self_edges from looped")
def g10(spark, d):
    nodes, edges = graph(spark, d, NATIONS)
    return G.graph_meta(nodes, G.looped(edges, nodes))


@query("g11_lookup", f"with {ends_sql(CONFIG)} select node_id, account from nodes where account = 'S7' or node_id = 7")
def g11(spark, d):
    nodes = G.nodes(G.endpoints(D.transactions(spark, d)))
    return nodes.where((F.col("account") == "S7") | (F.col("node_id") == 7))


@query("g12_drop_edges", f"with {index_sql(CONFIG)} select * from edges where {unit_sql(repr('drop'), repr('42'), 'edge_id')} > 0.2")
def g12(spark, d):
    return G.drop_edges(graph(spark, d, CONFIG)[1], 0.2)


@query("g13_mask_edges", f"with {index_sql(CONFIG)} select edge_id from edges where {unit_sql(repr('mask'), repr('42'), 'edge_id')} < 1 - 0.3")
def g13(spark, d):
    return G.mask_edges(graph(spark, d, CONFIG)[1], 0.3)


# --- node features -----------------------------------------------------------------------------

#: Three numbers of each edge, between named accounts.
FEATURES = ("amount", "fee", "delay")


def account_rows(spark: SparkSession, d: str, config: PreprocessConfig, number_rows: bool = False) -> DataFrame:
    """src, dst and the three numbers as they are; edge_id if rows are to be numbered."""
    df = E.with_delay(D.transactions(spark, d, number_rows=number_rows))
    ids = ["edge_id"] if number_rows else []
    return df.select(*ids, F.col(config.columns.source).alias("src"), F.col(config.columns.destination).alias("dst"), F.col("instructed_amount").alias("amount"), (F.col("credit_amount") - F.col("payment_amount")).alias("fee"), "delay")


def account_edges(spark: SparkSession, d: str, config: PreprocessConfig) -> DataFrame:
    return E.standardised(account_rows(spark, d, config), list(FEATURES))


def nodes_sql(config: PreprocessConfig) -> str:
    m = config.columns
    means = lambda side: ", ".join(f"avg({f}) as {side}_avg_feat_{i}" for i, f in enumerate(FEATURES))
    out = ", ".join(f"coalesce({side}_avg_feat_{i}, 0) as {side}_avg_feat_{i}" for side in ("src", "dst") for i in range(len(FEATURES)))
    return f"""{TX0}, raw as (select {m.source} as src, {m.destination} as dst, instructed_amount as amount, credit_amount - payment_amount as fee, {_DELAY} as delay from tx),
      e as (select src, dst, {', '.join(f'{scaled_sql(f)} as {f}' for f in FEATURES)} from raw),
      o as (select src as account, count(*) as n_out, {means('src')} from e group by src), i as (select dst as account, count(*) as n_in, {means('dst')} from e group by dst),
      n as (select coalesce(o.account, i.account) as account, {out}, coalesce(n_out, 0)::double as src_tx_count, coalesce(n_in, 0)::double as dst_tx_count,
        (coalesce(n_out, 0) + coalesce(n_in, 0))::double as total_degree, coalesce(n_in, 0) / (coalesce(n_out, 0) + 1e-8::double) as in_out_ratio from o full outer join i on o.account = i.account)"""


_NODE = N.node_feature_names(len(FEATURES))
_NODE_OUT = ", ".join(r(c, c, 4 if c == "in_out_ratio" else 6) for c in _NODE)


def node_table(spark: SparkSession, d: str, config: PreprocessConfig = CONFIG) -> DataFrame:
    return N.node_features(account_edges(spark, d, config), list(FEATURES), ("src", "dst"), "account")


@query("n9_node_features", f"with {nodes_sql(CONFIG)} select account, {_NODE_OUT} from n")
def n9(spark, d):
    return rounded(node_table(spark, d).withColumn("in_out_ratio", rounding(F.col("in_out_ratio"), 4)))


@query("n9_node_features_of_nations", f"with {nodes_sql(NATIONS)} select account, {_NODE_OUT} from n")
def n9n(spark, d):
    return rounded(node_table(spark, d, NATIONS).withColumn("in_out_ratio", rounding(F.col("in_out_ratio"), 4)))


@query("n7_sanitised", f"with q as (select l_partkey, {_ODD} as x from lineitem) select l_partkey, case when isnan(x) or isinf(x) then 0 else x end as x from q")
def n7(spark, d):
    k = F.col("l_partkey")
    x = F.when(k % 5 == 0, float("nan")).when(k % 7 == 0, float("inf")).when(k % 11 == 0, 0.0).otherwise(F.col("l_tax"))
    return N.sanitised(D.table(spark, d, "lineitem").select("l_partkey", x.alias("x")), ["x"])


# --- statistics --------------------------------------------------------------------------------


@query("t1_basic", f"with {ends_sql(NATIONS)}, c as (select (select count(*) from nodes) as n, count(*) as e from ends) select n as nodes, e as edges, n + e as edges_with_loops, 10::bigint as node_width, 3::bigint as edge_width, round(e / (n * (n - 1)), 6) as density, round(e / n, 6) as edges_per_node from c")
def t1(spark, d):
    ends = G.endpoints(D.transactions(spark, d), NATIONS)
    return rounded(S.basic(G.accounts(ends), ends, len(_NODE), len(FEATURES)))


@query("t2_degrees", f"""with {nodes_sql(CONFIG)}, k as (select 'out' as kind, src_tx_count as x from n union all select 'in', dst_tx_count from n union all select 'total', total_degree from n)
  select kind, {r('avg(x)', 'mean')}, {r('stddev_pop(x)', 'std')}, min(x) as least, max(x) as greatest, {r('quantile_cont(x, 0.5)', 'median')}, {r('quantile_cont(x, 0.25)', 'q25')}, {r('quantile_cont(x, 0.75)', 'q75')}, count(*) filter (x = 0) as zeros from k group by kind""")
def t2(spark, d):
    return rounded(S.degrees(node_table(spark, d)))


def features_stats_sql(table: str, columns: tuple[str, ...] | list[str]) -> str:
    return " union all ".join(f"select '{c}' as name, round(avg({c}), 4) as mean, round(stddev_pop({c}), 4) as std, round(min({c}), 4) as least, round(max({c}), 4) as greatest, count(*) filter ({c} = 0) as zeros, round(100.0 * count(*) filter ({c} = 0) / count(*), 4) as zero_percent, 0::bigint as nans, 0::bigint as infs from {table}" for c in columns)


@query("t3_node_feature_statistics", f"with {nodes_sql(NATIONS)} {features_stats_sql('n', _NODE)}")
def t3(spark, d):
    return rounded(S.features(node_table(spark, d, NATIONS), _NODE), 4)


@query("t4_edge_feature_statistics", f"with {nodes_sql(CONFIG)} {features_stats_sql('raw', FEATURES)}")
def t4(spark, d):
    df = E.with_delay(D.transactions(spark, d)).select(F.col("instructed_amount").alias("amount"), (F.col("credit_amount") - F.col("payment_amount")).alias("fee"), "delay")
    return rounded(S.features(df, list(FEATURES)), 4)


@query("t5_categories", f"with {TXN} " + " union all ".join(f"select '{c}' as name, * from (select {c} as value, count(*) as count, round(100.0 * count(*) / (select count(*) from tx), 6) as percent, (select count(distinct {c}) from tx) as total_unique from tx where {c} is not null group by {c} order by count desc, value limit 10)" for c in M.distributions))
def t5(spark, d):
    return rounded(S.categories(D.transactions(spark, d, nulls=True), list(M.distributions)))


@query("t6_amounts", f"with {TXN} " + " union all ".join(f"select '{c}' as name, count({c}) as count, {r(f'avg({c})', 'mean', 4)}, {r(f'stddev_samp({c})', 'std', 4)}, {r(f'min({c})', 'least', 4)}, {r(f'max({c})', 'greatest', 4)}, {', '.join(r(f'quantile_cont({c}, {q})', n, 4) for n, q in (('median', 0.5), ('q25', 0.25), ('q75', 0.75), ('q95', 0.95), ('q99', 0.99)))}, count(*) filter ({c} = 0) as zeros, count(*) filter ({c} < 0) as negatives from tx" for c in M.amounts))
def t6(spark, d):
    return rounded(S.amounts(D.transactions(spark, d, nulls=True), list(M.amounts)), 4)


# --- model ---------------------------------------------------------------------------------------

_COS = "list_dot_product(x, y) / (greatest(sqrt(list_dot_product(x, x)), 1e-12) * greatest(sqrt(list_dot_product(y, y)), 1e-12))"
#: Each vector and the next one.
_PAIRS = "pairs as (select a.vec_id, list_transform(a.embedding, lambda v: v::double) as x, list_transform(b.embedding, lambda v: v::double) as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    v = D.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query("m11_reconstruction_error", f"with {_PAIRS} select vec_id, {r(f'1 - {_COS}', 'score')} from pairs")
def m11(spark, d):
    return rounded(L.reconstruction_error(pairs(spark, d), "x", "y", "vec_id"))


@query("m13_sce_loss", f"with {_PAIRS} select {r(f'avg(pow(1 - {_COS}, 3))', 'loss')} from pairs")
def m13(spark, d):
    return rounded(L.loss(pairs(spark, d), "x", "y", "sce"))


@query("m14_sig_loss", f"with {_PAIRS} select {r(f'avg(1 / (1 + exp({_COS})))', 'loss')} from pairs")
def m14(spark, d):
    return rounded(L.loss(pairs(spark, d), "x", "y", "sig"))


@query("m15_mse_loss", f"with {_PAIRS} select {r('sum(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) / sum(len(x))', 'loss')} from pairs")
def m15(spark, d):
    return rounded(L.loss(pairs(spark, d), "x", "y", "mse"))


@query("m16_cosine_loss", f"with {_PAIRS} select {r(f'avg(1 - {_COS})', 'loss')} from pairs")
def m16(spark, d):
    return rounded(L.loss(pairs(spark, d), "x", "y", "cosine"))


@query("m17_sce_module", f"with {_PAIRS} select {r(f'avg(pow(1 - {_COS}, 2))', 'loss')} from pairs")
def m17(spark, d):
    return rounded(L.loss(pairs(spark, d), "x", "y", "sce", alpha=L.SCE_MODULE_ALPHA))


#: The normal distribution function as activations have it, by a series.
_T = "1 / (1 + 0.3275911 * (abs(v) / sqrt(2)))"
_ERF = f"(1 - {_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))) * exp(-(abs(v) / sqrt(2)) * (abs(v) / sqrt(2))))"
_ACT = {
    "relu": "greatest(v, 0)", "leaky_relu": "case when v >= 0 then v else 0.2 * v end", "prelu": "case when v >= 0 then v else 0.25 * v end", "elu": "case when v >= 0 then v else exp(v) - 1 end",
    "sigmoid": "1 / (1 + exp(-v))", "tanh": "(exp(2 * v) - 1) / (exp(2 * v) + 1)", "none": "v", "gelu": f"v * case when v >= 0 then 0.5 * (1 + {_ERF}) else 0.5 * (1 - {_ERF}) end",
}


@query("m6_activations", f"select vec_id, i, {', '.join(r(a, k) for k, a in _ACT.items())} from (select vec_id, unnest(embedding)::double * 10 as v, unnest(range(len(embedding))) as i from embeddings)")
def m6(spark, d):
    long = D.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double") * 10)
    return rounded(long.select("vec_id", "i", *(ACTIVATIONS[k](F.col("v")).alias(k) for k in _ACT)))


@query("m7_layer_norm", "with v as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings) select vec_id, i, round((x - avg(x) over (partition by vec_id)) / sqrt(var_pop(x) over (partition by vec_id) + 1e-5), 6) as x from v")
def m7(spark, d):
    df = D.table(spark, d, "embeddings").select("vec_id", F.posexplode(layer_norm(F.col("embedding"))).alias("i", "x"))
    return rounded(df)


@query("m7_batch_norm", "with v as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings) select vec_id as node_id, i, round((x - avg(x) over (partition by i)) / sqrt(var_pop(x) over (partition by i) + 1e-5), 6) as x from v")
def m7b(spark, d):
    states = D.table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.transform("embedding", lambda x: x.cast("double")).alias("h"))
    return rounded(MP.batch_norm(states).select("node_id", F.posexplode("h").alias("i", "x")))


#: A small fixed layer on two features of each nation.
_W, _A_SRC, _A_DST = np.array([[0.5, -0.25], [0.75, 1.0]]), np.array([[0.3, -0.2]]), np.array([[0.1, 0.4]])


def nation_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each nation's mean amounts as a state, and its distinct edges to others."""
    nodes, edges = graph(spark, d, NATIONS)
    means = node_table(spark, d, NATIONS).join(nodes, "account")
    states = materialised(means.select("node_id", F.array("src_avg_feat_0", "dst_avg_feat_0").alias("h")))
    return states, materialised(edges)


_STATES = f"with {nodes_sql(NATIONS)}, ids as (select account, row_number() over (order by account) - 1 as node_id from n), z as (select node_id, 0.5 * src_avg_feat_0 + 0.75 * dst_avg_feat_0 as z0, -0.25 * src_avg_feat_0 + 1.0 * dst_avg_feat_0 as z1 from n join ids using (account)), links as (select s.node_id as src_id, d.node_id as dst_id from raw join ids s on s.account = src join ids d on d.account = dst where src <> dst union all select node_id, node_id from ids)"


@query("m2_graph_convolution", f"{_STATES}, deg as (select dst_id as node_id, 1 / sqrt(count(*)) as d from links group by 1) select dst_id as node_id, {', '.join(r(f'sum(s.d * t.d * z{k})', f'h{k}') for k in (0, 1))} from links join deg s on s.node_id = src_id join deg t on t.node_id = dst_id join z on z.node_id = src_id group by 1")
def m2(spark, d):
    states, edges = nation_states(spark, d)
    out = MP.convolved(states, edges, MP.Layer("gcn", _W, np.zeros(2)))
    return rounded(out.select("node_id", F.col("h")[0].alias("h0"), F.col("h")[1].alias("h1")))


@query("m1_graph_attention", f"""{_STATES}, raw_e as (select src_id, dst_id, 0.3 * s.z0 - 0.2 * s.z1 + 0.1 * t.z0 + 0.4 * t.z1 as e from links join z s on s.node_id = src_id join z t on t.node_id = dst_id),
  att as (select src_id, dst_id, exp(case when e >= 0 then e else 0.2 * e end) as e from raw_e), total as (select dst_id, sum(e) as total from att group by dst_id)
  select att.dst_id as node_id, {', '.join(r(f'sum(e / total * z{k})', f'h{k}') for k in (0, 1))} from att join total on total.dst_id = att.dst_id join z on z.node_id = att.src_id group by 1""")
def m1(spark, d):
    states, edges = nation_states(spark, d)
    out = MP.attended(states, edges, MP.Layer("gat", _W, np.zeros(2), _A_SRC, _A_DST))
    return rounded(out.select("node_id", F.col("h")[0].alias("h0"), F.col("h")[1].alias("h1")))


#: A decoder of whole vectors, of 64 components, to five.
_DECODER, _DECODER_BIAS = np.random.default_rng(3).uniform(-1, 1, (64, 5)), np.array([0.1, -0.2, 0.0, 0.5, -1.0])
_DECODED = ", ".join(r(f"list_dot_product(list_transform(embedding, lambda v: v::double), [{', '.join(repr(float(w)) for w in _DECODER[:, j])}]) + ({float(_DECODER_BIAS[j])!r})", f"h{j}") for j in range(5))


@query("m3_linear_decoder", f"select vec_id as node_id, {_DECODED} from embeddings")
def m3(spark, d):
    states = D.table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.transform("embedding", lambda x: x.cast("double")).alias("h"))
    out = MP.projected(states, _DECODER, _DECODER_BIAS)
    return rounded(out.select("node_id", *(F.col("h")[j].alias(f"h{j}") for j in range(5))))


def _order_sql(salt: str) -> str:
    return f"row_number() over (order by {unit_sql(repr(salt), repr('42'), 'vec_id')}, vec_id) - 1"


@query("m8_masking", f"""with v as (select vec_id, list_transform(embedding, lambda y: y::double) as x, {_order_sql('mask')} as place, {_order_sql('noise')} as giver, count(*) over () as n from embeddings),
  s as (select *, floor(0.5 * n) as m, floor(0.1 * floor(0.5 * n)) as noise from v),
  k as (select *, case when place >= m then 'keep' when place < floor(0.9 * m) then 'token' when place >= m - noise then 'noise' else 'same' end as kind from s),
  m as (select a.vec_id as node_id, a.kind, case a.kind when 'token' then list_transform(a.x, lambda y: 0::double) when 'noise' then b.x else a.x end as x from k a left join k b on a.kind = 'noise' and b.giver = a.place - (a.m - a.noise))
  select node_id, kind, unnest(range(len(x))) as i, unnest(x) as x from m""")
def m8(spark, d):
    features = D.table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return masked(features).select("node_id", "kind", F.posexplode("masked").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


# --- anomalies: on a score that SQL can compute: 1 - cosine of what an account sends and receives, by nation too ---

_PROXY = f"""{nodes_sql(CONFIG)}, ids as (select account, row_number() over (order by account) - 1 as node_id from n),
  node_scores as (select node_id, round(abs(src_avg_feat_0 + dst_avg_feat_0) + abs(src_avg_feat_2 + dst_avg_feat_2) + 1 / (1 + total_degree), 6) as score from n join ids using (account)),
  numbered as (select edge_id, s.node_id as src_id, d.node_id as dst_id from ({D.sql(True)}) t join ids s on s.account = debit_account_masked join ids d on d.account = bene_account_masked)"""


def scores_sql(strategy: str = "max") -> str:
    value = {"max": "greatest(s.score, d.score)", "mean": "(s.score + d.score) / 2", "sum": "s.score + d.score"}[strategy]
    return f"{_PROXY}, scores as (select edge_id, src_id, dst_id, {value} as score from numbered join node_scores s on s.node_id = src_id join node_scores d on d.node_id = dst_id)"


def proxy(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scores of nodes, and the edges."""
    nodes, edges = graph(spark, d, CONFIG)
    c = F.col
    score = F.abs(c("src_avg_feat_0") + c("dst_avg_feat_0")) + F.abs(c("src_avg_feat_2") + c("dst_avg_feat_2")) + 1 / (1 + c("total_degree"))
    return materialised(node_table(spark, d).join(nodes, "account").select("node_id", rounding(score).alias("score"))), edges


def edge_scores(spark: SparkSession, d: str, strategy: str = "max") -> DataFrame:
    node_scores, edges = proxy(spark, d)
    return materialised(A.edge_scores(edges, node_scores, strategy))


def _strategy(strategy: str) -> Query:
    return lambda spark, d: rounded(A.edge_scores(*reversed(proxy(spark, d)), strategy), 7)


for _n, _s in (("a3_edge_scores_max", "max"), ("a4_edge_scores_mean", "mean"), ("a5_edge_scores_sum", "sum")):
    query(_n, f"with {scores_sql(_s)} select edge_id, src_id, dst_id, round(score, 7) as score from scores")(_strategy(_s))


@query("a8_top_anomalies", f"with {scores_sql()} select * from scores order by score desc, edge_id desc limit 100")
def a8(spark, d):
    return A.top(edge_scores(spark, d))


@query("a9_threshold", f"with {scores_sql()} select round(quantile_cont(score, 0.95), 6) as threshold from scores")
def a9(spark, d):
    return rounded(A.threshold(edge_scores(spark, d)))


@query("a10_classified", f"with {scores_sql()} select *, (score > (select quantile_cont(score, 0.95) from scores))::int as anomaly from scores")
def a10(spark, d):
    return A.classified(edge_scores(spark, d))


_STATS = f"count(*) as count, {r('avg(score)', 'mean')}, {r('stddev_pop(score)', 'std')}, min(score) as least, max(score) as greatest, {', '.join(r(f'quantile_cont(score, {q})', n) for n, q in (('median', 0.5), ('p90', 0.9), ('p95', 0.95), ('p99', 0.99)))}"


@query("a11_score_statistics", f"with {scores_sql()} select {_STATS} from scores")
def a11(spark, d):
    return rounded(A.statistics(edge_scores(spark, d)))


@query("a11_node_score_statistics", f"with {_PROXY} select {_STATS} from node_scores")
def a11n(spark, d):
    return rounded(A.statistics(proxy(spark, d)[0]))


@query("a12_top_k_analysis", f"with {scores_sql()}, k as (select *, row_number() over (order by score desc, edge_id desc) as place from scores) " + " union all ".join(f"select {k}::bigint as k, string_agg(edge_id::varchar, ',' order by place) as ids, round(avg(score), 6) as mean, min(score) as least from k where place <= {k}" for k in (10, 20, 50, 100, 200, 500)))
def a12(spark, d):
    return rounded(A.top_k_analysis(edge_scores(spark, d)))


@query("a15_summary", f"with {scores_sql()}, t as (select quantile_cont(score, 0.95) as threshold from scores) select round(any_value(threshold), 6) as threshold, count(*) filter (score > threshold) as anomalies, round(count(*) filter (score > threshold) / count(*), 6) as share, {r('avg(score)', 'edge_mean')}, {r('stddev_pop(score)', 'edge_std')}, round((select avg(score) from node_scores), 6) as node_mean, round((select stddev_pop(score) from node_scores), 6) as node_std from scores cross join t")
def a15(spark, d):
    node_scores, edges = proxy(spark, d)
    return rounded(A.summary(node_scores, A.edge_scores(edges, node_scores)))


# --- tables behind charts ----------------------------------------------------------------------------


@query("v2_score_histogram", f"with {scores_sql()}, spread as (select min(score) as low, max(score) as high from scores), filled as (select least(floor((score - low) / (high - low) * 50), 49)::int as bin, count(*) as count from scores cross join spread group by 1) select range as bin, round(low + range * ((high - low) / 50), 6) as low, round(low + (range + 1) * ((high - low) / 50), 6) as high, coalesce(count, 0) as count from range(50) cross join spread left join filled on filled.bin = range")
def v2(spark, d):
    return rounded(V.histogram(edge_scores(spark, d)))


@query("v2_score_box", f"with {scores_sql()} select min(score) as least, {', '.join(r(f'quantile_cont(score, {q})', n) for n, q in (('q25', 0.25), ('median', 0.5), ('q75', 0.75), ('p95', 0.95), ('p99', 0.99)))}, max(score) as greatest from scores")
def v2b(spark, d):
    return rounded(V.box(edge_scores(spark, d)))


@query("v3_degree_against_score", f"with {_PROXY} select node_id, (select count(*) from numbered where src_id = node_id) as out_degree, score from node_scores")
def v3(spark, d):
    return V.degree_against_score(*reversed(proxy(spark, d)))


@query("v4_ranked_anomalies", f"with {scores_sql()} select row_number() over (order by score desc, edge_id desc) as rank, edge_id, score from scores order by rank limit 20")
def v4(spark, d):
    return rounded(V.ranked(edge_scores(spark, d)))


@query("v5_two_axes")
def v5(spark, d):
    return V.two_axes(D.table(spark, d, "embeddings"), key="vec_id", column="embedding")


@query("v6_percentiles", f"with {scores_sql()} " + " union all ".join(f"select {p}::double as p, round(quantile_cont(score, {p / 100}), 6) as score from scores" for p in (50, 75, 90, 95, 99)))
def v6(spark, d):
    return rounded(V.percentiles(edge_scores(spark, d)))


@query("v7_degree_histogram", f"with {nodes_sql(CONFIG)}, spread as (select min(total_degree) as low, max(total_degree) as high from n), filled as (select least(floor((total_degree - low) / (high - low) * 50), 49)::int as bin, count(*) as count from n cross join spread group by 1) select range as bin, round(low + range * ((high - low) / 50), 6) as low, round(low + (range + 1) * ((high - low) / 50), 6) as high, coalesce(count, 0) as count from range(50) cross join spread left join filled on filled.bin = range")
def v7(spark, d):
    return rounded(V.histogram(node_table(spark, d), "total_degree"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """For each account: mean scaled amounts sent and received, degrees and their ratio."""
    return node_table(spark, d)
