"""Edge features whose fit is a thing of its own: stored by version, merged with that of further transactions, applied to others.

The state is what can be added up: of each number its count, mean and sum of squares about it; how often each delay
occurs (for the exact median); and dictionaries of categories, which only grow, so that codes never change. fit(A) merged with
fit(B) is fit(A + B), whichever rows of one file A and B are, if B's come later.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from payflux.config import PreprocessConfig
from payflux.functions.numbering import materialised, numbered
from payflux.functions.quantiles import quantiles
from payflux.functions.scalars import category, hash_unit
from payflux.functions.scaling import scaled
from payflux.operators import edges as E
from payflux.sources import store

NUMBERS, CATEGORIES, DELAYS = "name string, n bigint, mean double, squares double", "name string, value string, code bigint", "delay double, n bigint"


@dataclass
class Fitted:
    """numbers: name, n, mean, squares (about the mean). categories: name, value, code (from 0, in the order of first appearance). delays: delay, n."""

    numbers: DataFrame
    categories: DataFrame
    delays: DataFrame


def _prepared(df: DataFrame, config: PreprocessConfig) -> tuple[DataFrame, list[str]]:
    """Transactions with numbers and parts of times, and the names of what is scaled as it is."""
    m = config.columns
    rows, parts = E.with_time_parts(E.with_delay(E.parsed(df, config), config), [m.event_time, m.storage_time])
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in m.numeric}), [*m.numeric, *parts]


def fit(df: DataFrame, config: PreprocessConfig = PreprocessConfig()) -> Fitted:
    """The state of these transactions, which have an edge_id."""
    m = config.columns
    rows, names = _prepared(df, config)
    rows = materialised(rows.select("edge_id", *m.categorical, *names, "delay"))
    moments = [f for i, c in enumerate([*names, "delay"]) for f in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"mean{i}"), F.var_pop(c).alias(f"var{i}"))]
    every = F.struct(F.lit("*").alias("name"), F.col("rows").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    own = lambda i, c: F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("n"), F.coalesce(F.col(f"mean{i}"), F.lit(0.0)).alias("mean"), F.coalesce(F.col(f"var{i}") * F.col(f"n{i}"), F.lit(0.0)).alias("squares"))
    numbers = rows.agg(F.count("*").alias("rows"), *moments).select(F.inline(F.array(every, *(own(i, c) for i, c in enumerate([*names, "delay"])))))
    long = rows.select("edge_id", F.inline(F.array(*(F.struct(F.lit(c).alias("name"), category(F.col(c), config.unknown).alias("value")) for c in m.categorical))))
    firsts = long.groupBy("name", "value").agg(F.min("edge_id").alias("first"))
    delays = rows.where("delay is not null").groupBy("delay").agg(F.count("*").alias("n"))
    return Fitted(materialised(numbers), materialised(_coded(firsts, None)), materialised(delays))


def _coded(firsts: DataFrame, known: DataFrame | None) -> DataFrame:
    """name, value, code: codes of known values as they are, others after them by `first`. Numbers run over all names, so no task gets a column whole."""
    new = firsts if known is None else firsts.join(known, ["name", "value"], "left_anti")
    placed = numbered(new.select("name", "value", "first"), [F.col("name"), F.col("first"), F.col("value")], "place")
    starts = placed.groupBy("name").agg(F.min("place").alias("start"))
    if known is None:
        starts = starts.withColumn("size", F.lit(0).cast("long"))
    else:
        sizes = known.groupBy("name").agg(F.count("*").alias("size"))
        starts = starts.join(sizes, "name", "left").select("name", "start", F.coalesce("size", F.lit(0)).alias("size"))
    coded = placed.join(starts, "name").select("name", "value", (F.col("place") - F.col("start") + F.col("size")).alias("code"))
    return coded if known is None else known.unionByName(coded)


def merged(a: Fitted, b: Fitted) -> Fitted:
    """The state of what both saw. b's new categories get the codes after a's, in b's order."""
    n, more = F.col("n") + F.col("n_b"), F.col("mean_b") - F.col("mean")
    both = a.numbers.join(b.numbers.select("name", F.col("n").alias("n_b"), F.col("mean").alias("mean_b"), F.col("squares").alias("squares_b")), "name")
    share = F.col("n_b") / F.greatest(n, F.lit(1))
    squares = F.col("squares") + F.col("squares_b") + more * more * F.col("n") * share
    numbers = both.select("name", n.alias("n"), (F.col("mean") + more * share).alias("mean"), squares.alias("squares"))
    categories = _coded(b.categories.select("name", "value", F.col("code").alias("first")), a.categories)
    delays = a.delays.unionByName(b.delays).groupBy("delay").agg(F.sum("n").alias("n"))
    return Fitted(materialised(numbers), materialised(categories), materialised(delays))


def save(state: Fitted, path: str) -> int:
    """Writes the state as the next version under path; a version counts once all of it is there."""
    spark = state.numbers.sparkSession
    version = max(versions(spark, path), default=0) + 1
    at = f"{path}/version={version:06d}"
    store.save_tables({"numbers": state.numbers, "categories": state.categories, "delays": state.delays}, at)
    store.save_bytes(spark, b"whole", f"{at}/whole", whole=True)
    return version


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name.split("=")[1]) for name in store.folders(spark, path) if name.startswith("version=") and store.artifacts(spark, f"{path}/{name}", ("whole",))["whole"])


def load(spark: SparkSession, path: str, version: int | None = None) -> Fitted:
    """The newest whole version, or the one asked for."""
    found = versions(spark, path)
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"{path} has no version {version or ''}".rstrip())
    at = f"{path}/version={version or found[-1]:06d}"
    return Fitted(*(spark.read.schema(s).parquet(f"{at}/{t}") for t, s in (("numbers", NUMBERS), ("categories", CATEGORIES), ("delays", DELAYS))))


def transformed(df: DataFrame, state: Fitted, config: PreprocessConfig = PreprocessConfig(), finish: Callable[[Column], Column] = lambda c: c) -> tuple[DataFrame, list[str]]:
    """df's columns that it is known by (edge_id, if there is one, else uetr) and all features, in the order of edges.edge_features; their names.

    df may be a stream: of the state, one row for each number is known to the driver, and categories are joined as a table. A category
    that the state has not seen becomes the unknown one; codes of it are -1 where that has not been seen either. Columns without variance are
    only centred; a state of no rows leaves numbers as they are. finish: what is made of each feature; of components of vectors once a category.
    """
    m, spark = config.columns, state.numbers.sparkSession
    rows, names = _prepared(df, config)
    known = {r["name"]: r for r in state.numbers.collect()}
    mid = quantiles(state.delays, "delay", (0.5,), times="n").first()["q"][0] or 0.0
    every, delay = known["*"]["n"], known["delay"]
    share = delay["n"] / max(1, every)
    mean = share * delay["mean"] + (1 - share) * mid
    away = delay["mean"] - mid
    std = math.sqrt(delay["squares"] / max(1, every) + share * (1 - share) * away * away)
    at = {c: scaled(F.col(c), F.lit(known[c]["mean"]), F.lit(math.sqrt(known[c]["squares"] / max(1, known[c]["n"])))) for c in names}
    ids = ["edge_id"] if "edge_id" in df.columns else ["uetr"]
    scaled_delay = scaled(F.coalesce("delay", F.lit(mid)), F.lit(mean), F.lit(std))
    out = rows.select(*ids, *m.categorical, *(finish(v).alias(c) for c, v in at.items()), finish(scaled_delay).alias("delay_scaled"))
    apart = (lambda x: x) if df.isStreaming else E.apart  # numbers, joins and parts of vectors are not one method
    out = apart(out)
    made: list[str] = []
    new: list[Column] = []
    sizes = {r["name"]: r["n"] for r in state.categories.groupBy("name").agg(F.count("*").alias("n")).collect()}
    for c in m.categorical:
        own = state.categories.where(F.col("name") == c)
        if config.encode_categories == "embedding":
            parts = [f"{c}_emb_{i}" for i in range(config.embedding_dim)]
            bound = math.sqrt(6 / (sizes.get(c, 0) + config.embedding_dim))
            vector = lambda value: [finish(F.lit(bound) * (2 * hash_unit(c, value, i) - 1)) for i in range(config.embedding_dim)]  # noqa: B023, E731
            unseen = spark.range(1).select(*vector(F.lit(config.unknown))).first()
            entry = vector(F.col("value"))
        else:
            parts, entry = [f"{c}_code"], [F.col("code")]
            seen = own.where(F.col("value") == config.unknown).first()
            unseen = [seen["code"] if seen else -1]
        # one column, taken apart after all joins
        table = own.select(F.col("value").alias("its_value"), F.struct(*(v.alias(n) for n, v in zip(parts, entry, strict=True))).alias(f"{c}__vector"))
        joined = out.join(table, category(out[c], config.unknown) == table["its_value"], "left").drop("its_value")
        out = joined.withColumn(f"{c}__vector", F.coalesce(F.col(f"{c}__vector"), F.struct(*(F.lit(u).alias(n) for n, u in zip(parts, unseen, strict=True)))))
        new += [F.col(f"{c}__vector")[n].alias(n) for n in parts]
        made += parts
    out = apart(out).select(*ids, *names, "delay_scaled", *new)
    features = [*m.numeric, *made, *(c for c in names if c not in m.numeric), "delay_scaled"]
    return out.select(*ids, *features), features
