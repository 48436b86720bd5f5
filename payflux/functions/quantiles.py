"""Exact quantiles by selection: ranges of values are narrowed until few values are left in them."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts of a range in one pass; the driver sees their counts.
PARTS = 4096
#: A range of so many rows is ranked as it is.
FEW = 1 << 16
MOST_GROUPS = 256


@dataclass
class Range:
    """Values of a group from low to high; there are `before` less ones and `count` of these. ranks: the wanted ones."""

    group: int
    low: float
    high: float
    before: int
    count: int
    ranks: list[int]


def _member(ranges: list[Range], more=lambda r, x: ()) -> Column:
    """Of a row (group, x): the number of its range, and what more says; null in none of them."""
    x = F.col("x")
    return F.coalesce(*(F.when((F.col("group") == r.group) & (x >= r.low) & (x <= r.high), F.struct(F.lit(i).alias("i"), *more(r, x))) for i, r in enumerate(ranges)))


def _part(r: Range, x: Column) -> Column:
    """Which part of its range x is in: it never falls as x rises."""
    if math.isinf(r.high - r.low):
        share = (x / 2 - r.low / 2) / (r.high / 2 - r.low / 2)
    else:
        share = (x - r.low) / (r.high - r.low)
    return F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("int")


def _narrowed(rows: DataFrame, ranges: list[Range]) -> list[Range]:
    at = _member(ranges, lambda r, x: (_part(r, x).alias("part"),))
    counts = rows.select("x", "times", at.alias("at")).where("at is not null").groupBy("at.i", "at.part").agg(F.sum("times").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    parts: dict[int, list] = {}
    for c in counts.collect():
        parts.setdefault(c["i"], []).append((c["part"], c["n"], c["low"], c["high"]))
    out = []
    for i, r in enumerate(ranges):
        before = r.before
        for _, n, low, high in sorted(parts.get(i, [])):
            if wanted := [k for k in r.ranks if before <= k < before + n]:
                out.append(Range(r.group, low, high, before, n, wanted))
            before += n
    return out


def _ranked(rows: DataFrame, ranges: list[Range]) -> dict[tuple[int, int], float]:
    if not ranges:
        return {}
    counts = rows.select("x", "times", _member(ranges).alias("at")).where("at is not null").groupBy("at.i", "x").agg(F.sum("times").alias("n"))
    # FEW rows of a range at most
    placed = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("upto") - F.col("n")
    hit = reduce(lambda a, b: a | b, ((F.col("i") == i) & (start <= k - r.before) & (F.col("upto") > k - r.before) for i, r in enumerate(ranges) for k in r.ranks))
    out = {}
    for c in placed.where(hit).collect():
        r = ranges[c["i"]]
        out |= {(r.group, k): c["x"] for k in r.ranks if c["upto"] - c["n"] <= k - r.before < c["upto"]}
    return out


def quantiles(df: DataFrame, column: str, at: tuple[float, ...], by: tuple[str, ...] = (), times: str | None = None) -> DataFrame:
    """by and q: the quantiles of column's values at these shares, interpolated between the two nearest; null of no values.

    times: a column of how often a row counts (1 or more).

    df is read at once, and should be cheap to read again: once for counts and ends, once each time that ranges are
    narrowed to one of 4,096 parts (by the counts of all parts, of all groups and ranks together), and once to rank what is left,
    65,536 rows of a range at most. So no task gets many values, whatever the rows; copies of one value are one.
    Infinities come first and last, after them NaN. Without groups there is always one row, with groups one for each that has values; there may be 256 groups.
    """
    spark, infinity = df.sparkSession, float("inf")
    often = F.col(times).cast("long") if times else F.lit(1).cast("long")
    rows = df.select(*by, F.col(column).cast("double").alias("x"), often.alias("times")).where(F.col("x").isNotNull())
    finite = F.when(~F.isnan("x") & (F.abs(F.col("x")) < infinity), F.col("x"))
    counted = lambda where: F.coalesce(F.sum(F.when(where, F.col("times"))), F.lit(0))
    stats = rows.groupBy(*by).agg(
        counted(F.lit(True)).alias("n"), counted(finite.isNotNull()).alias("m"), F.min(finite).alias("low"), F.max(finite).alias("high"),
        counted(F.col("x") == -infinity).alias("least"), counted(F.col("x") == infinity).alias("most"),
    )
    found = stats.limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    number = F.coalesce(*(F.when(reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(g[c]) for c in by)), F.lit(i)) for i, g in enumerate(found))) if by and found else F.lit(0)
    rows = rows.select(number.alias("group"), (F.col("x") + 0.0).alias("x"), "times")  # -0.0 is 0.0

    values: dict[tuple[int, int], float] = {}
    open_ = []
    for i, g in enumerate(found):
        ranks = sorted({f(p * (g["n"] - 1)) for p in at for f in (math.floor, math.ceil)} if g["n"] else ())
        inner = [k for k in ranks if g["least"] <= k < g["least"] + g["m"]]
        values |= {(i, k): -infinity if k < g["least"] else infinity if k < g["least"] + g["m"] + g["most"] else float("nan") for k in ranks if k not in inner}
        if inner:
            open_.append(Range(i, g["low"], g["high"], g["least"], g["m"], inner))
    few = []
    while open_:
        few += [r for r in open_ if r.low < r.high and r.count <= FEW]
        values |= {(r.group, k): r.low for r in open_ if r.low == r.high for k in r.ranks}
        open_ = [r for r in open_ if r.low < r.high and r.count > FEW]
        open_ = _narrowed(rows, open_) if open_ else []
    values |= _ranked(rows, few)

    def between(i: int, n: int, p: float) -> float | None:
        if not n:
            return None
        low, high, share = values[i, math.floor(p * (n - 1))], values[i, math.ceil(p * (n - 1))], p * (n - 1) - math.floor(p * (n - 1))
        return low if low == high else (1 - share) * low + share * high

    kinds = dict(df.dtypes)
    one = [F.struct(*(F.lit(g[c]).cast(kinds[c]).alias(c) for c in by), F.array(*(F.lit(between(i, g["n"], p)).cast("double") for p in at)).alias("q")) for i, g in enumerate(found)]
    if not one:
        ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "q array<double>"])
        return spark.createDataFrame([], ddl)
    return spark.range(1).select(F.inline(F.array(*one)))


def with_quantiles(df: DataFrame, source: DataFrame, column: str, at: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """df (one row, or one for each group) with named quantiles of a column of source, which should be cheap to read again."""
    q = quantiles(source, column, tuple(at.values()), by)
    out = df.join(F.broadcast(q), list(by), "left") if by else df.crossJoin(F.broadcast(q))
    return out.select(*df.columns, *(F.col("q")[i].alias(name) for i, name in enumerate(at)))
