"""Features of edges: scaled amounts, categories, calendar parts and the delay until storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payflux.config import PreprocessConfig
from payflux.functions.numbering import materialised, numbered
from payflux.functions.quantiles import with_quantiles
from payflux.functions.scalars import category, hash_unit, number, seconds_between, time_parts, timestamp
from payflux.functions.scaling import moment_columns, scaled, standardised


def parsed(df: DataFrame, config: PreprocessConfig = PreprocessConfig()) -> DataFrame:
    """df with numbers and times for what was text; what can't be read is null. Times are parsed once, for parts and delay alike.

    Columns that df has not been given are left out.
    """
    m = config.columns
    kinds = dict(df.dtypes)
    new = {c: number(F.col(c), kinds[c]) for c in m.numeric if c in kinds}
    for c, formats in ((m.event_time, config.event_formats), (m.storage_time, config.storage_formats)):
        if c not in kinds:
            continue
        new[c] = timestamp(F.col(c), formats) if kinds[c] == "string" else F.col(c).cast("timestamp")
    return df.withColumns(new)


def fill_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, filled and percent: values of each column that are missing and become 0."""
    entries = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"f_{i}").alias("filled"), (100.0 * F.col(f"f_{i}") / F.greatest(F.col("n"), F.lit(1))).alias("percent")) for i, c in enumerate(columns)))
    return df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"f_{i}") for i, c in enumerate(columns))).select(F.inline(entries))


def numeric_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each column filled with 0 and scaled."""
    return standardised(df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns}), columns)


def category_codes(df: DataFrame, column: str, unknown: str = "UNKNOWN", edge_id: str = "edge_id") -> DataFrame:
    """value and code of a column's categories, from 0 in the order in which they first appear."""
    firsts = df.groupBy(category(F.col(column), unknown).alias("value")).agg(F.min(edge_id).alias("first_edge"))
    return numbered(firsts, [F.col("first_edge")], "code").select("value", "code")


def category_vectors(codes: DataFrame, column: str, dim: int = 8) -> DataFrame:
    """codes and dim components of each of its values, drawn evenly from +-sqrt(6 / (categories + dim)) by a hash of column, value and place."""
    bound = F.sqrt(6.0 / (F.col("n") + dim))
    sized = codes.crossJoin(F.broadcast(codes.agg(F.count("*").alias("n"))))
    return sized.select(*codes.columns, *((bound * (2 * hash_unit(column, F.col("value"), i) - 1)).alias(f"{column}_emb_{i}") for i in range(dim)))


def encoding_info(codes: DataFrame, unknown: str = "UNKNOWN", samples: int = 10) -> DataFrame:
    """categories, has_unknown, and the first few categories by code."""
    return codes.agg(
        F.count("*").alias("categories"),
        F.coalesce(F.bool_or(F.col("value") == unknown), F.lit(False)).alias("has_unknown"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("code") < samples, F.struct("code", "value")))), lambda x: x["value"])).alias("samples"),
    )


def apart(df: DataFrame) -> DataFrame:
    """df, whose code Spark doesn't make one with that of what follows: a method of more than 8,000 bytes would never be compiled by the JVM."""
    return df.coalesce((1 << 31) - 1)  # as many partitions as before, and no shuffle


#: By column a table of its categories, and what a row that met it makes of it.
Tables = dict[str, tuple[DataFrame, list[Column]]]


def with_category_features(
    df: DataFrame, columns: list[str], config: PreprocessConfig = PreprocessConfig(), base: DataFrame | None = None, finish: Callable[[Column], Column] = lambda c: c
) -> tuple[DataFrame, list[str]]:
    """df with vectors (or codes) of its categories, and the names of the new columns. base: a simpler table with the same edge_id and categories.

    finish: what is made of each component, once a category. Vectors are joined as one column each, and taken apart after all joins.
    """
    # not what earlier joins have made of it: the plan would double each time
    tables, names = category_tables((base or df).select("edge_id", *columns), columns, config, finish)
    return joined_categories(df, tables, config), names


def category_tables(
    base: DataFrame, columns: list[str], config: PreprocessConfig = PreprocessConfig(), finish: Callable[[Column], Column] = lambda c: c
) -> tuple[Tables, list[str]]:
    """Of each column a table (value, its number, and a vector or a code), and what a row that met it makes of it; and the names of all new columns."""
    tables, names = {}, []
    embedded = bool(columns) and config.encode_categories == "embedding"
    if embedded:  # the values of all columns in one pass
        long = base.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), category(F.col(c), config.unknown).alias("value")) for c in columns))))
        values = materialised(numbered(long.distinct(), [F.col("name"), F.col("value")], "number"))
    for c in columns:
        if embedded:
            parts = [f"{c}_emb_{i}" for i in range(config.embedding_dim)]
            table = category_vectors(values.where(F.col("name") == c).select("value", "number"), c, config.embedding_dim)
            table = table.select("value", "number", F.struct(*(finish(F.col(n)).alias(n) for n in parts)).alias(f"{c}__vector"))
            tables[c] = table, [F.col(f"{c}__vector")[n].alias(n) for n in parts]
            names += parts
        else:
            tables[c] = category_codes(base, c, config.unknown).select("value", F.col("code").alias("number"), F.col("code").alias(f"{c}_code")), [F.col(f"{c}_code")]
            names.append(f"{c}_code")
    return tables, names


def joined_categories(df: DataFrame, tables: Tables, config: PreprocessConfig = PreprocessConfig(), numbers: dict[str, Column] | None = None) -> DataFrame:
    """df with what category_tables say of its categories. numbers: those of the categories, where df has these in their stead."""
    own = df.columns
    for c, (table, _) in tables.items():
        key = category(df[c], config.unknown) if numbers is None else numbers[c]
        table = table.withColumnRenamed("value" if numbers is None else "number", f"{c}__key").drop("number", "value")
        # Spark broadcasts the categories where their size is known to be small, and shuffles where it is not
        df = df.join(table, key == F.col(f"{c}__key")).drop(f"{c}__key")
    return apart(df).select(*own, *(n for _, new in tables.values() for n in new))


#: Different numbers that one column of packed categories may have.
MOST_PACKED = 1 << 62


def packed_categories(df: DataFrame, tables: Tables, config: PreprocessConfig = PreprocessConfig(), most: int = MOST_PACKED) -> tuple[DataFrame, list[str], dict[str, Column]]:
    """df with its categories' numbers in as few columns as hold them, for its way through a shuffle; these columns, and each category's number by them."""
    if not tables:
        return df, [], {}
    ends = None
    for c, (table, _) in tables.items():
        own = table.agg(F.lit(c).alias("name"), F.min("number").alias("low"), F.max("number").alias("high"))
        ends = own if ends is None else ends.unionAll(own)
    ranges = {r["name"]: (r["low"] or 0, (r["high"] or 0) - (r["low"] or 0) + 1) for r in ends.collect()}
    words: list[list[tuple[str, int]]] = [[]]
    times = 1
    for c, (_, size) in ranges.items():
        if words[-1] and times * size > most:
            words.append([])
            times = 1
        words[-1].append((c, times))
        times *= size
    rest = [c for c in df.columns if c not in tables]
    for c, (table, _) in tables.items():
        df = df.join(table.select(F.col("value").alias(f"{c}__key"), F.col("number").alias(f"{c}__number")), category(df[c], config.unknown) == F.col(f"{c}__key")).drop(f"{c}__key")
    names, numbers = [f"categories__{i}" for i in range(len(words))], {}
    packed = []
    for name, word in zip(names, words, strict=True):
        total = F.lit(0).cast("long")
        for c, times in word:
            low, size = ranges[c]
            total = total + (F.col(f"{c}__number") - low) * times
            numbers[c] = F.expr(f"`{name}` div {times}L") % size + low
        packed.append(total.alias(name))
    return apart(df).select(*rest, *packed), names, numbers


TIME_PARTS = ("hour", "dow", "dom")


def with_time_parts(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """df with hour, day of the week and day of the month of each time."""
    new = {f"{c}_{k}": v for c in columns for k, v in time_parts(F.col(c)).items()}
    return df.withColumns(new), list(new)


def parse_failures(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, failed and percent: times that are missing."""
    return fill_report(df, columns).select("name", F.col("filled").alias("failed"), "percent")


def with_delay(df: DataFrame, config: PreprocessConfig = PreprocessConfig()) -> DataFrame:
    """df with delay: seconds from event to storage, null where either is missing."""
    m = config.columns
    return df.withColumn("delay", seconds_between(F.col(m.event_time), F.col(m.storage_time)))


def delay_statistics(df: DataFrame) -> DataFrame:
    """One row: valid, invalid, mean, median, least, greatest, std (of a sample; null of one value), negative."""
    own = materialised(df.select("delay"))
    whole = own.agg(
        F.count("delay").alias("valid"),
        F.count_if(F.col("delay").isNull()).alias("invalid"),
        F.avg("delay").alias("mean"),
        F.min("delay").alias("least"),
        F.max("delay").alias("greatest"),
        F.stddev_samp("delay").alias("std"),
        F.count_if(F.col("delay") < 0).alias("negative"),
    )
    return with_quantiles(whole, own, "delay", {"median": 0.5}).select("valid", "invalid", "mean", "median", "least", "greatest", "std", "negative")


def _delay_moments() -> list[Column]:
    return [
        F.count("delay").alias("delay_n"), F.count("*").alias("delay_all"),
        F.coalesce(F.avg("delay"), F.lit(0.0)).alias("delay_m"), F.coalesce(F.var_pop("delay"), F.lit(0.0)).alias("delay_v"),
    ]


def _with_median(stats: DataFrame, rows: DataFrame) -> DataFrame:
    return with_quantiles(stats, rows, "delay", {"delay_mid": 0.5}).fillna(0.0, ["delay_mid"])


def _scaled_delay() -> Column:
    """The delay, or the median, scaled by the moments that the column has once it is filled; these follow from those before it."""
    share, away = F.col("delay_n") / F.greatest(F.col("delay_all"), F.lit(1)), F.col("delay_m") - F.col("delay_mid")
    mean = share * F.col("delay_m") + (1 - share) * F.col("delay_mid")
    std = F.sqrt(share * F.col("delay_v") + share * (1 - share) * away * away)
    return scaled(F.coalesce("delay", "delay_mid"), mean, std)


def with_scaled_delay(df: DataFrame) -> DataFrame:
    """df with delay_scaled: missing delays are the median (0 if there is none), then scaled. One pass gives all moments."""
    own = materialised(df.select("delay"))
    joined = df.crossJoin(F.broadcast(_with_median(own.agg(*_delay_moments()), own)))
    return joined.select(*df.columns, _scaled_delay().alias("delay_scaled"))


def edge_features(
    df: DataFrame, config: PreprocessConfig = PreprocessConfig(), keep: tuple[str, ...] = (), finish: Callable[[Column], Column] = lambda c: c
) -> tuple[DataFrame, list[str]]:
    """edge_id, columns of df to keep, and all features of each edge in a fixed order: amounts, categories, calendar parts, delay; and their names.

    A block that can't be computed is constant, never missing. Without any there is one column of zeros, dummy. finish: what is
    made of each feature; of components of vectors once a category.
    """
    rows = materialised(feature_rows(df, config, ("edge_id", *keep)))  # read for moments, the median, the categories and the features
    maker = FeatureMaker(rows, config, finish)
    return maker.made(rows, ("edge_id", *keep)), maker.names


def feature_rows(df: DataFrame, config: PreprocessConfig = PreprocessConfig(), keep: tuple[str, ...] = (), categories: tuple[str, ...] | None = None) -> DataFrame:
    """Columns to keep, and what features are made of: categories (or the columns that stand for them), amounts, calendar parts and the delay."""
    m = config.columns
    rows = with_delay(parsed(df, config), config)
    rows, parts = with_time_parts(rows, [m.event_time, m.storage_time])
    chosen = m.categorical if categories is None else categories
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in m.numeric}).select(*keep, *chosen, *m.numeric, *parts, "delay")


class FeatureMaker:
    """Turns rows of feature_rows, in whatever order and partitions, into features, by the moments and categories of all rows."""

    def __init__(self, rows: DataFrame, config: PreprocessConfig = PreprocessConfig(), finish: Callable[[Column], Column] = lambda c: c):
        m = config.columns
        parts = [f"{c}_{k}" for c in (m.event_time, m.storage_time) for k in TIME_PARTS]
        numeric = [*m.numeric, *parts]
        self.config = config
        # one row with all moments
        self.stats = _with_median(rows.agg(*_delay_moments(), *moment_columns(numeric)), rows)
        new = {c: scaled(F.col(c), F.col(f"mean_{c}"), F.col(f"std_{c}")) for c in numeric} | {"delay_scaled": _scaled_delay()}
        self.flat = [finish(v).alias(c) for c, v in new.items()]
        self.tables, categories = category_tables(rows, list(m.categorical), config, finish)
        self.names = [*m.numeric, *categories, *parts, "delay_scaled"]

    def made(self, rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """Columns to keep, and features."""
        joined = rows.crossJoin(F.broadcast(self.stats)).select(*keep, *self.config.columns.categorical, *self.flat)
        return joined_categories(joined, self.tables, self.config).select(*keep, *self.names)

    def made_at(self, df: DataFrame, end: str) -> DataFrame:
        """end and features of df's rows, which are brought to the node at that end first: as columns that features are made of, categories as numbers.

        Spark splits what is large, so the rows of a hub are in several tasks.
        """
        m = self.config.columns
        packed, words, numbers = packed_categories(df.select(end, *m.categorical, *m.numeric, m.event_time, m.storage_time), self.tables, self.config)
        rows = feature_rows(packed.hint("rebalance", end), self.config, (end,), tuple(words))
        joined = rows.crossJoin(F.broadcast(self.stats)).select(end, *words, *self.flat)
        return joined_categories(joined, self.tables, self.config, numbers).select(end, *self.names)


def feature_array(df: DataFrame, names: list[str], key: str = "edge_id") -> DataFrame:
    """key and features: the vector that the model takes."""
    return df.select(key, (F.array(*names) if names else F.array(F.lit(0.0))).alias("features"))
