"""Named queries that write what a job writes, read it again and compare; and whole jobs with a model of fixed weights."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payflux.config import COLUMNS, MainConfig, PreprocessConfig
from payflux.functions.numbering import scratch
from payflux.functions.scalars import timestamp
from payflux.operators import anomalies as A
from payflux.operators import graph as G
from payflux.operators import profile as P
from payflux.operators import statistics as S
from payflux.plans import detect, preprocess, training
from payflux.plans import model_queries as MQ
from payflux.plans import queries as Q
from payflux.plans.queries import CONFIG, FEATURES, NATIONS, QUERIES, SQL, M, query, r, rounded, rounding
from payflux.sources import driver as D
from payflux.sources import store
from payflux.sources import transactions as T

__all__ = ["QUERIES", "SQL"]

# --- graphs ------------------------------------------------------------------------------------


def stored_graph(spark: SparkSession, d: str) -> store.TransactionGraph:
    """The account graph with features of its nodes, written and read again."""
    nodes, edges = Q.graph(spark, d, CONFIG)
    own = Q.node_table(spark, d).join(nodes, "account").select("node_id", F.array(*Q._NODE).alias("features"))
    path = scratch(spark, "graph")
    store.save_graph(store.TransactionGraph(nodes, G.weighted(G.looped(edges, nodes)), own), path)
    return store.load_graph(spark, path)


@query("s6_stored_edges", Q.weights_sql(CONFIG))
def s6(spark, d):
    return rounded(Q.named_loops(stored_graph(spark, d).edges))


@query("s7_stored_nodes", f"with {Q.ends_sql(CONFIG)} select * from nodes")
def s7(spark, d):
    return stored_graph(spark, d).nodes


@query("s8_stored_node_features", f"with {Q.nodes_sql(CONFIG)}, ids as (select account, row_number() over (order by account) - 1 as node_id from n) select node_id, {Q._NODE_OUT} from n join ids using (account)")
def s8(spark, d):
    own = stored_graph(spark, d).node_features.select("node_id", *(F.col("features")[i].alias(c) for i, c in enumerate(Q._NODE)))
    return rounded(own.withColumn("in_out_ratio", rounding(F.col("in_out_ratio"), 4)))


# --- tables and reports ------------------------------------------------------------------------


def tidy_sql(section: str, sql: str, name: str, measures: tuple[str, ...]) -> str:
    return " union all ".join(f"select '{section}' as section, {name} as name, '{m}' as measure, {m}::double as value from ({sql})" for m in measures)


def tidy(section: str, df: DataFrame, name: str | None, measures: tuple[str, ...]) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))
    return df.select(F.lit(section).alias("section"), (F.col(name) if name else F.lit("all")).alias("name"), F.inline(entries))


_BASIC = ("nodes", "edges", "edges_with_loops", "node_width", "edge_width", "density", "edges_per_node")
_DEGREES = ("mean", "std", "least", "greatest", "median", "q25", "q75", "zeros")
_AMOUNTS = ("count", "mean", "std", "least", "greatest", "median", "q25", "q75", "q95", "q99", "zeros", "negatives")


@query("t7_stored_statistics", " union all ".join([tidy_sql("basic", SQL["t1_basic"], "'all'", _BASIC), tidy_sql("degrees", SQL["t2_degrees"], "kind", _DEGREES), tidy_sql("amounts", SQL["t6_amounts"], "name", _AMOUNTS)]))
def t7(spark, d):
    """Three tables of statistics, written and read again."""
    ends = G.endpoints(D.transactions(spark, d), NATIONS)
    tables = {
        "basic": rounded(S.basic(G.accounts(ends), ends, len(Q._NODE), len(FEATURES))),
        "degrees": rounded(S.degrees(Q.node_table(spark, d))),
        "amounts": rounded(S.amounts(D.transactions(spark, d, nulls=True), list(M.amounts)), 4),
    }
    path = scratch(spark, "statistics")
    store.save_tables(tables, path)
    read = {k: spark.read.parquet(f"{path}/{k}") for k in tables}
    return Q._union([tidy("basic", read["basic"], None, _BASIC), tidy("degrees", read["degrees"], "kind", _DEGREES), tidy("amounts", read["amounts"], "name", _AMOUNTS)])


@query("p4_stored_load_info", f"with {Q.TXN} select count(*) as rows, {len(COLUMNS)}::bigint as columns, true as is_full, '{','.join(COLUMNS)}' as names from tx")
def p4(spark, d):
    """What is told of the input, as JSON and back."""
    path = scratch(spark, "info")
    store.save_json(spark, T.load_info(D.transactions(spark, d, nulls=True), d, PreprocessConfig()), path)
    info = store.load_json(spark, path)
    return spark.createDataFrame([(info["rows"], info["columns"], info["full"], ",".join(info["column_names"]))], "rows bigint, columns bigint, is_full boolean, names string")


@query("p2_types", f"with {Q.TXN}, one as (select * from tx limit 1) " + " union all ".join(f"select 'col_{i}_{c}' as name, case typeof({c}) when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' else 'timestamp' end as type from one" for i, c in enumerate(COLUMNS)))
def p2(spark, d):
    return spark.createDataFrame(list(P.dtypes(D.transactions(spark, d, nulls=True)).items()), "name string, type string")


@query("p9_checks", f"with {Q.ends_sql(CONFIG)} " + " union all ".join(f"select '{g}' as name, true as passed" for g in ("success", "delay_computed", "edge_names", "node_names", "files", "no_nan", "no_inf", "all_passed")) + " union all select 'nodes ' || count(*), true from nodes")
def p9(spark, d):
    """The whole preprocessing of all transactions, its report, and the gates over what it stored."""
    config = PreprocessConfig(output_dir=scratch(spark, "preprocessed"))
    preprocess.run(spark, D.transactions(spark, d, number_rows=True, nulls=True), config)
    report = store.load_json(spark, f"{config.output_dir}/report")
    rows = [*preprocess.check(spark, config, report).items(), (f"nodes {report['statistics']['basic'][0]['nodes']}", True)]
    return spark.createDataFrame(rows, "name string, passed boolean")


# --- times as text -----------------------------------------------------------------------------



@query("f8_times_of_text", """select o_orderkey, case o_orderkey % 5 when 0 then epoch_us(o_orderdate) when 1 then null when 2 then epoch_us(date_trunc('day', o_orderdate)) when 3 then null else null end as event_us,
  case o_orderkey % 5 when 0 then epoch_us(o_orderdate) when 1 then epoch_us(date_trunc('minute', o_orderdate)) when 2 then epoch_us(date_trunc('day', o_orderdate)) else null end as storage_us from orders""")
def f8(spark, d):
    """Dates of orders as text: ISO, day first, day only, nonsense, missing. The first times are ISO only, the others get a second chance."""
    k, t = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("timestamp")
    formats = ((0, "yyyy-MM-dd HH:mm:ss"), (1, "dd/MM/yyyy HH:mm"), (2, "yyyy-MM-dd"))
    text = F.coalesce(*(F.when(k == i, F.date_format(t, f)) for i, f in formats), F.when(k == 3, "31/02/2024 25:00"))
    rows = D.table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", *(F.unix_micros(timestamp(F.col("text"), f)).alias(n) for n, f in (("event_us", CONFIG.event_formats), ("storage_us", CONFIG.storage_formats))))


# --- the model ---------------------------------------------------------------------------------


@query("s13_embeddings_of_stored_model", MQ.embedding_sql(MQ.GCN, CONFIG, 8))
def s13(spark, d):
    """Weights written and read again give the same embeddings."""
    out, path = io.BytesIO(), f"{scratch(spark, 'model')}/model.npz"
    training.save(MQ.seeded(MQ.GCN), out)
    store.save_bytes(spark, out.getvalue(), path, whole=True)
    model, _ = training.load(MQ.GCN, MQ.WIDTH, io.BytesIO(store.load_bytes(spark, path)))
    return MQ.components(training.embeddings(model, *MQ.model_graph(spark, d, CONFIG)), "h", 8)


@query("m18_first_steps", f"""with g as ({MQ.loss_sql(MQ.PLAIN, CONFIG)}), long as (unpivot g on {', '.join(MQ.names(MQ.WIDTH, 'g'))} into name component value g)
  select kind, component, round(case kind when 'sgd' then -0.01 * g when 'radam' then -0.01 * g when 'adadelta' then -0.01 * sqrt(1e-6) / sqrt(0.1 * g * g + 1e-6) * g else -0.01 * g / (abs(g) + 1e-8) end, 6) as moved
  from long cross join (values ('adam'), ('adamw'), ('radam'), ('adadelta'), ('sgd')) k(kind)""")
def m18(spark, d):
    """Where the first step of each optimizer moves the decoder's bias, from the gradient over the graph of accounts."""
    gradient = [float(x) for x in Q.QUERIES["m20_loss_and_gradient"](spark, d).first()[1:]]
    rows = []
    for kind in training.Optimizer.KINDS:
        p = [{"b": np.zeros(len(gradient))}]
        training.Optimizer(kind, 0.0).step(p, [{"b": np.array(gradient)}], 0.01)
        rows += [(kind, f"g{i}", float(v)) for i, v in enumerate(p[0]["b"])]
    return rounded(spark.createDataFrame(rows, "kind string, component string, moved double"))


def detected_sql(level: str = "edge") -> str:
    """CTEs up to node_scores (rounded) and scores, of the account graph's model."""
    ctes, at = MQ.passed_sql(MQ.seeded(MQ.GCN), "x")
    return f"""{MQ.graph_sql(CONFIG)}, {ctes}, node_scores as (select node_id, {r(MQ.error_sql(), 'score')} from x join {at} o using (node_id)),
      numbered as (select edge_id, s.node_id as src_id, d.node_id as dst_id from ({D.sql(True)}) t join ids s on s.account = debit_account_masked join ids d on d.account = bene_account_masked),
      scores as (select edge_id, src_id, dst_id, greatest(s.score, d.score) as score from numbered join node_scores s on s.node_id = src_id join node_scores d on d.node_id = dst_id)"""


def detected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scores of accounts and transactions by the model's reconstruction errors."""
    features, edges = MQ.model_graph(spark, d, CONFIG, number_rows=True)
    return rounded(training.node_errors(MQ.seeded(MQ.GCN), features, edges)), edges  # of a table already


@query("a14_detected", f"with {MQ.graph_sql(CONFIG)}, {MQ.passed_sql(MQ.seeded(MQ.GCN), 'x')[0]}, own_scores as (select node_id, {MQ.error_sql()} as score from x join {MQ.passed_sql(MQ.seeded(MQ.GCN), 'x')[1]} o using (node_id)) select edge_id, s.node_id as src_id, t.node_id as dst_id, round(greatest(s.score, t.score), 6) as score from ({D.sql(True)}) tx join ids a on a.account = debit_account_masked join ids b on b.account = bene_account_masked join own_scores s on s.node_id = a.node_id join own_scores t on t.node_id = b.node_id")
def a14(spark, d):
    """One call from a model to scores of all transactions."""
    features, edges = MQ.model_graph(spark, d, CONFIG, number_rows=True)
    return rounded(detect.detect(MQ.seeded(MQ.GCN), features, edges, MainConfig())[1])


@query("a8_top_anomalies_of_model", f"with {detected_sql()} select * from scores order by score desc, edge_id desc limit 100")
def a8_model(spark, d):
    scores, edges = detected(spark, d)
    return A.top(A.edge_scores(edges, scores))


@query("s12_stored_results", f"with {detected_sql()}, t as (select quantile_cont(score, 0.95) as threshold from scores) select round(any_value(threshold), 6) as threshold, count(*) filter (score > threshold) as anomalies, {r('avg(score)', 'edge_mean')}, (select count(*) from node_scores) as nodes, count(*) as edges from scores cross join t")
def s12(spark, d):
    """Scores as tables and their summary as JSON, written and read again."""
    scores, edges = detected(spark, d)
    path = scratch(spark, "results")
    store.save_tables({"node_scores": scores, "edge_scores": A.edge_scores(edges, scores)}, path)
    own, of_edges = (spark.read.parquet(f"{path}/{t}") for t in ("node_scores", "edge_scores"))
    found = A.summary(own, of_edges, stored=True, sizes=True).first().asDict()
    sizes = found.pop("nodes"), found.pop("edges")
    store.save_json(spark, found, f"{path}/summary")
    told = store.load_json(spark, f"{path}/summary")
    row = (told["threshold"], told["anomalies"], told["edge_mean"], *sizes)
    return rounded(spark.createDataFrame([row], "threshold double, anomalies bigint, edge_mean double, nodes bigint, edges bigint"))
