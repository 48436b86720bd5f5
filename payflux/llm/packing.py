"""Packing into optimal length buckets.

Each document is padded to the bound of its bucket. Dynamic programming over the histogram of
the lengths of all documents chooses the bounds with the least padding; inside a bucket,
batches are filled up to a budget of tokens, padding included.

Only the histogram reaches the driver, an entry for each length that occurs. Documents of L different
lengths hold L * (L - 1) / 2 tokens at least, so L is under the root of twice the tokens, and 1: at most
100,000 entries for 5e9 tokens, 6 million (16 bytes each) for 1.6e13, some 100 TB. So nothing is rounded
at any size, and the padding is the least there is with so many buckets. Who sets `exact` has lengths of the
same ten leading binary digits as one entry, which stands for its longest document, beyond so many lengths.

Rows stand in a bucket in the order of a hash of the rows themselves, so batches depend neither on
how files are split nor on the cluster; equal rows are numbered, and it doesn't matter which is which.

Nulls and empty texts have length 0 and are packed like others. A document longer than the
budget is a batch of its own, whole, and marked. Equal rows are packed one by one. An empty
table gives no rows. Other columns are returned as they are; names that clash with an added
column belong to the input, and the added one gets underscores in front.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payflux.functions.names import unused
from payflux.functions.numbering import materialised
from payflux.llm.common import partitions, place, place_sql, ranges, row_key, row_key_sql, told_apart, with_sums_before, word_count

MAX_BUCKETS = 8
TOKEN_BUDGET = 65_536
#: Different lengths that the driver takes one by one: all; and leading binary digits that tell lengths apart beyond.
EXACT, DIGITS = None, 10
#: Choices of a bucket's first length that are weighed at a time.
CHOICES = 1 << 20


def leading(length: Column) -> Column:
    """length with all but its DIGITS leading binary digits set to 0."""
    bits = F.when(length > 0, F.length(F.bin(length))).otherwise(0)
    step = F.pow(F.lit(2.0), F.greatest(bits - DIGITS, F.lit(0)))
    return (F.floor(length / step) * step).cast("long")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, most: int, choices_at_once: int = CHOICES) -> list[int]:
    """At most so many bounds, the last of them the greatest length, with the least sum of (bound of a document).

    lengths: ascending. best[j] is the least cost of the first j+1 lengths with k buckets; the last
    bucket holds the lengths from i on, and costs its bound for each of its documents. The first
    best i doesn't fall as j grows, so each layer is solved from the middle outward: n log n steps.
    """
    n = len(lengths)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    lengths = lengths.astype(np.int64)
    best, choices = lengths * total[1:], []
    for _ in range(1, min(most, n)):
        earlier = np.concatenate([[0], best])
        new, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low, high, least, greatest = (np.array([x], np.int64) for x in (0, n - 1, 0, n - 1))
        while len(low):  # all open ranges of j at once, each with the range of its i
            j = (low + high) // 2
            last = np.minimum(greatest, j)
            sizes = last - least + 1
            part = np.cumsum(sizes) // choices_at_once
            for a in np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])):
                b = np.searchsorted(part, part[a], "right")
                some, n_some = j[a:b], sizes[a:b]
                i, of = ranges(least[a:b], n_some), np.repeat(np.arange(b - a), n_some)
                cost = earlier[i] + lengths[some][of] * (total[some + 1][of] - total[i])
                new[some] = np.minimum.reduceat(cost, np.cumsum(n_some) - n_some)
                first = np.flatnonzero(cost == new[some][of])
                _, one = np.unique(of[first], return_index=True)
                at[some] = i[first[one]]
            low, high, least, greatest = (
                np.concatenate(x) for x in ((low, j + 1), (j - 1, high), (least, at[j]), (at[j], greatest))
            )
            open_ = low <= high
            low, high, least, greatest = (x[open_] for x in (low, high, least, greatest))
        choices.append(at)
        best = new
    bounds, j = [], n - 1
    for at in reversed(choices):
        bounds.append(int(lengths[j]))
        j = int(at[j]) - 1
        if j < 0:
            break
    else:
        bounds.append(int(lengths[j]))
    return bounds[::-1]


def histogram(rows: DataFrame, length: str, exact: int | None = EXACT) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, ascending, and how many rows have them; of more than `exact` different ones, if that is set, the longest of each entry."""
    counts = rows.groupBy(F.col(length).alias("length")).agg(F.count("*").alias("n"))
    if exact is not None:
        counts = materialised(counts)
        if counts.count() > exact:
            counts = counts.groupBy(leading(F.col("length"))).agg(F.max("length").alias("length"), F.sum("n").alias("n"))
    found = counts.select("length", "n").toArrow()
    lengths, n = (found.column(c).to_numpy() for c in ("length", "n"))
    order = np.argsort(lengths)
    return lengths[order], n[order]


def pack(df: DataFrame, length: Column | None = None, max_buckets: int = MAX_BUCKETS, budget: int = TOKEN_BUDGET, keep: list[str] | None = None, exact: int | None = EXACT) -> DataFrame:
    """df (or its columns keep) with n_tokens, bucket_len, batch (counted inside the bucket), slot (place in the batch), batch_docs (most documents of a batch of this bucket) and over_budget.

    length: tokens of a row; by default the words of `text`. exact: different lengths that the driver takes one by one; by default all.
    """
    keep = df.columns if keep is None else keep
    # columns of the input have names of our own on the way
    inner = [f"c{i}" for i in range(len(keep))]
    n = F.coalesce(length if length is not None else word_count(F.col("text")), F.lit(0)).cast("long")
    rows = df.select(*(F.col(c).alias(i) for c, i in zip(keep, inner, strict=True)), n.alias("n"), row_key(df[c] for c in df.columns).alias("id"))
    rows = materialised(told_apart(rows, "id"))
    bounds = best_bounds(*histogram(rows, "n", exact), max_buckets) or [0]
    chosen = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        chosen = F.when(F.col("n") <= b, F.lit(b)).otherwise(chosen)
    rows = rows.withColumns({"bound": chosen.cast("long"), "at": place("pack", F.col("id")), "one": F.lit(1).cast("long")})
    # cells are ranges of the hash, so that their number doesn't change the order
    rows = rows.withColumn("cell", F.shiftright(F.shiftright("at", 28) * (4 * partitions(df.sparkSession)), 32))
    ranked = with_sums_before(rows, ["bound"], "cell", [F.col("at"), F.col("id")], {"one": "rank"})
    most = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bound"), F.lit(1)))).cast("long")
    ranked = ranked.withColumn("most", most).select(
        *inner, "n", "bound", F.floor(F.col("rank") / F.col("most")).cast("long").alias("batch"), F.pmod("rank", "most").alias("slot"), "most", (F.col("n") > budget).alias("over")
    )
    return ranked.toDF(*keep, *unused(keep, "n_tokens", "bucket_len", "batch", "slot", "batch_docs", "over_budget"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])


def _bounds_sql() -> str:
    """The dynamic programme, layer by layer: of equal costs the least i counts."""
    layers = ["layer_1 as (select j, x * upto as cost, 0::bigint as i from lengths)"]
    for k in range(2, MAX_BUCKETS + 1):
        layers.append(f"""layer_{k} as (select j, picked.cost, picked.i from (
          select a.j, min({{'cost': coalesce(b.cost, 0) + a.x * (a.upto - coalesce(c.upto, 0)), 'i': s.j}}) as picked
          from lengths a join lengths s on s.j <= a.j left join layer_{k - 1} b on b.j = s.j - 1 left join lengths c on c.j = s.j - 1 group by a.j))""")
    # back from the last length: each layer's bound, and the length before its bucket
    steps, last = [], "(select max(j) from lengths)"
    for k in range(MAX_BUCKETS, 0, -1):
        steps.append(f"step_{k} as (select l.j, x as bound, l.i - 1 as next from layer_{k} l join lengths using (j) where l.j = {last})")
        last = f"(select next from step_{k})"
    return ", ".join([*layers, *steps]) + ", bounds as (" + " union ".join(f"select bound from step_{k}" for k in range(1, MAX_BUCKETS + 1)) + ")"


OP5_SQL = f"""
with docs as (
  select doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n,
    {row_key_sql('doc_id', 'text')} as k from documents),
lengths as (select row_number() over (order by n) - 1 as j, n as x, (sum(count(*)) over (order by n))::bigint as upto from docs group by n),
{_bounds_sql()},
ranked as (
  select *, {place_sql("'pack'", "id")} as place from (
    select doc_id, n, k || '|' || (row_number() over (partition by k) - 1) as id, (select min(bound) from bounds where bound >= n) as bound from docs)),
numbered as (select *, row_number() over (partition by bound order by place, id) - 1 as rank, greatest(1, {TOKEN_BUDGET} // greatest(bound, 1))::bigint as most from ranked)
select doc_id, n as n_tokens, bound as bucket_len, rank // most as batch, rank % most as slot, most as batch_docs, n > {TOKEN_BUDGET} as over_budget from numbered
"""
