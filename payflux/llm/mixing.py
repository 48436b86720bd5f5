"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets. The sources share `share` times the words of all documents by weight; none gets more
than `most` times its own words, and what it can't take goes to the others by weight.

Blocks. A source's documents are dealt by hash into `blocks` blocks, so there are as many rows
for each source whatever its size, and no block holds a large part of a large source. In each
pass over the source (a second pass repeats documents, none more than `most` times) its blocks
stand in an order drawn for that pass. The mix takes blocks in this order up to the target,
and of the block at the target documents in a drawn order; of the last one it takes only as many
words as are left. So a source's taken words are its target to a word.

Shards. A node of the tree holds, for each source, how many blocks go to its output shards. It
gives a part of them to its left half: one draw without replacement from all of its blocks, so
by a multivariate hypergeometric distribution, source after source. The leaves are the quotas of
the shards; they sum to the quotas of the sources exactly. Shards get the blocks of a source one
after the other in the drawn order, hence disjoint; inside a shard rows are shuffled by hash.

The driver sees only counts of one row for each source in one array, so there may be thousands
of sources, not billions. Everything drawn comes from hashes of the rows themselves: reruns
agree, however the table is split into files and whatever the cluster.

Null sources are one source, the last. Null and empty texts have no words and are never taken.
Equal rows are numbered, and it doesn't matter which of them is which. An empty table
gives no rows. Columns of the input keep their names; clashing new ones get underscores in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from payflux.functions.names import unused
from payflux.functions.numbering import materialised
from payflux.llm.common import let, place, place_sql, row_key, row_key_sql, told_apart, unit, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCKS = 1024
SHARDS = 8


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with weight and target, in one pass over the sources by size for their weight.

    A source is at its limit if even so much a unit of weight as all that remain could have exceeds it.
    """
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    listed = F.array(*(F.lit(float(w)) for w in weights))
    s = sources.withColumn("weight", F.element_at(listed, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    s = s.withColumns({"limit": F.col("source_size") * float(most), "all_words": F.sum("source_size").over(everything)})
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("all_words") * float(share) - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))
    s = s.withColumns({"a_unit": left / F.sum("weight").over(rest), "place": F.row_number().over(by_ratio)})
    free = F.col("limit") >= F.col("a_unit") * F.col("weight")
    s = s.withColumn("a_unit", F.min_by(F.when(free, F.col("a_unit")), F.when(free, F.col("place"))).over(everything))
    return s.select("source", "source_size", "weight", F.coalesce(F.least(F.col("limit"), F.col("a_unit") * F.col("weight")), F.col("limit")).alias("target"))


def drawn(of: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` balls taken from `of` balls are among the `marked` ones: the quantile u of the hypergeometric distribution.

    Within ten deviations of the mean; each probability follows from the one before.
    """
    given = F.struct(*(c.cast("double").alias(n) for n, c in (("n", of), ("m", marked), ("d", draws), ("u", u))))
    return let(given, lambda g: let(_moments(g), lambda s: let(_bounds(s), _quantile)))


def _moments(g: Column) -> Column:
    n, m, d = g["n"], g["m"], g["d"]
    mean = F.when(n > 0, d * m / n).otherwise(0.0)
    rest = F.when(n > 1, (1 - m / n) * (n - d) / (n - 1)).otherwise(0.0)
    return F.struct(n.alias("n"), m.alias("m"), d.alias("d"), g["u"].alias("u"), mean.alias("mean"), rest.alias("rest"))


def _bounds(s: Column) -> Column:
    wide = 10 * F.sqrt(s["mean"] * s["rest"]) + 2
    low = F.greatest(F.lit(0.0), s["d"] - (s["n"] - s["m"]), F.floor(s["mean"] - wide).cast("double")).cast("long")
    high = F.least(s["m"], s["d"], F.ceil(s["mean"] + wide).cast("double")).cast("long")
    return F.struct(s["n"].alias("n"), s["m"].alias("m"), s["d"].alias("d"), s["u"].alias("u"), low.alias("low"), F.greatest(low, high).alias("high"))


def _quantile(s: Column) -> Column:
    def step(a: Column, x: Column, at: Column) -> Column:
        """p is that of x, then of x + 1."""
        ahead = a["p"] * (s["m"] - x) * (s["d"] - x) / ((x + 1.0) * (s["n"] - s["m"] - s["d"] + x + 1.0))
        return F.struct(ahead.alias("p"), (a["sum"] + a["p"]).alias("sum"), at.alias("x"))

    xs, start = F.sequence(s["low"], s["high"]), F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), s["low"].alias("x"))
    total = F.aggregate(xs, start, lambda a, x: step(a, x, x), lambda a: a["sum"])
    return let(s["u"] * total, lambda to: F.aggregate(xs, start, lambda a, x: step(a, x, F.when(a["sum"] <= to, x).otherwise(a["x"])), lambda a: a["x"]))


def shard_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """quotas (source, quota: blocks) -> source, ends: how many of its blocks the shards up to each one have, shard after shard."""
    row = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", F.col("quota").cast("long").alias("quota")))).alias("all"))
    row = row.select(F.col("all"), F.transform("all", lambda x: x["quota"]).alias("n_0"))

    def split(node: Column, low: int, high: int) -> Column:
        """Of each source's blocks at this node, how many go to its left half."""
        middle = (low + high) // 2
        total = F.aggregate(node, F.lit(0).cast("long"), lambda a, x: a + x)
        here = F.floor(total * (middle - low) / (high - low)).cast("long")
        out = F.aggregate(
            F.transform(node, lambda x, i: F.struct(x.alias("n"), i.alias("i"))),
            F.struct(total.alias("of"), here.alias("draws"), F.array().cast("array<long>").alias("out")),
            lambda a, x: _drawn_one(a, x, low, high, seed),
        )
        return out["out"]

    nodes, level, columns = [(0, shards, "n_0")], 0, {}
    while nodes:
        new, following = {}, []
        for low, high, name in nodes:
            if high - low == 1:
                columns[low] = name
                continue
            middle = (low + high) // 2
            left, right = f"n_{low}_{middle}_{level}", f"n_{middle}_{high}_{level}"
            new |= {left: split(F.col(name), low, high)}
            following += [(low, middle, left), (middle, high, right)]
        row = row.withColumns(new)
        row = row.withColumns(
            {
                f"n_{(low + high) // 2}_{high}_{level}": F.zip_with(name, f"n_{low}_{(low + high) // 2}_{level}", lambda a, b: a - b)
                for low, high, name in nodes
                if high - low > 1
            }
        )
        nodes, level = following, level + 1
    leaves = F.array(*(F.col(columns[k]) for k in range(shards)))
    each = row.select(F.posexplode("all").alias("i", "one"), leaves.alias("leaves"))
    counts = F.transform("leaves", lambda leaf: F.get(leaf, F.col("i")))
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice(counts, 1, k), F.lit(0).cast("long"), lambda a, x: a + x))
    return each.select(F.col("one.source").alias("source"), ends.alias("ends"))


def _drawn_one(a: Column, x: Column, low: int, high: int, seed: int) -> Column:
    got = drawn(a["of"], x["n"], a["draws"], unit(F.lit(seed), F.lit(low), F.lit(high), x["i"]))
    return let(got, lambda g: F.struct((a["of"] - x["n"]).alias("of"), (a["draws"] - g).alias("draws"), F.array_append(a["out"], g).alias("out")))


def plan(
    df: DataFrame,
    source: str = "source",
    size: Column | None = None,
    keep: list[str] | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    blocks: int = BLOCKS,
    shards: int = SHARDS,
    seed: int = 1,
) -> DataFrame:
    """df (or its columns keep) with size, source_size, target, taken (words) and draws: (pass, words, shard, place) of each time the mix takes it."""
    keep = df.columns if keep is None else keep
    new = ["size", "source_size", "target", "taken", "draws"]
    got = _planned(df, source, size, keep, weights, share, most, blocks, shards, seed)
    return got.select(*(f"c{i}" for i in range(len(keep))), *new).toDF(*keep, *unused(keep, *new))


def _planned(df: DataFrame, source: str, size: Column | None, keep: list[str], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """As plan; the columns kept are c0, c1, ..., and id is a row's key and number."""
    inner = [f"c{i}" for i in range(len(keep))]
    words = size if size is not None else word_count(F.col("text"))
    rows = df.select(*(F.col(c).alias(i) for c, i in zip(keep, inner, strict=True)), F.col(source).alias("src"), words.cast("long").alias("size"), row_key(df[c] for c in df.columns).alias("id"))
    rows = materialised(told_apart(rows, "id"))
    goals = materialised(targets(rows.groupBy(F.col("src").alias("source")).agg(F.sum("size").alias("source_size")), weights, share, most))

    # a row for each document, with its block
    s = goals.select(F.col("source").alias("the_source"), "source_size", "target")
    rows = rows.withColumn("block", F.pmod(place("block", seed, F.col("id")), F.lit(blocks)))
    # a row for each block and pass: what the mix takes of it, and its number among the source's blocks that are taken
    dealt = rows.groupBy("src", "block").agg(F.sum("size").alias("words"))
    dealt = dealt.join(s, dealt["src"].eqNullSafe(s["the_source"])).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    in_turn = Window.partitionBy("src").orderBy("pass", place("turn", seed, F.col("pass").cast("string"), F.col("block").cast("string")), "block")
    earlier = F.coalesce(F.sum("words").over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.least(F.col("words"), F.greatest(F.lit(0), F.round("target").cast("long") - earlier))
    dealt = materialised(dealt.select("src", "block", "pass", take.alias("take"), (F.row_number().over(in_turn) - 1).alias("number")).where("take > 0"))
    quotas = shard_quotas(dealt.groupBy(F.col("src").alias("source")).agg(F.count("*").alias("quota")), shards, seed)
    placed = dealt.join(quotas, dealt["src"].eqNullSafe(quotas["source"])).select(dealt["*"], F.size(F.filter("ends", lambda e: e <= F.col("number"))).alias("shard"))
    placed = placed.groupBy(F.col("src").alias("its_source"), F.col("block").alias("its_block")).agg(F.array_sort(F.collect_list(F.struct("pass", "take", "shard"))).alias("takes"))
    rows = rows.withColumn("order", place("order", seed, F.col("id")))
    # sums before in the block alone
    inside = Window.partitionBy("src", "block").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    got = rows.join(placed, rows["src"].eqNullSafe(placed["its_source"]) & (rows["block"] == placed["its_block"]), "left").join(s, F.col("src").eqNullSafe(F.col("the_source")))
    words = lambda t: F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), t["take"] - F.col("before")))
    each = F.transform(
        F.coalesce("takes", F.array().cast("array<struct<pass:int,take:bigint,shard:int>>")),
        lambda t: F.struct(t["pass"].alias("pass"), words(t).alias("words"), t["shard"].alias("shard"), F.xxhash64(F.lit(seed), t["pass"], F.col("id")).alias("place")),
    )
    got = got.withColumn("draws", F.filter(each, lambda t: t["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, t: a + t["words"])
    return got.select("id", *inner, "size", "source_size", "target", taken.alias("taken"), "draws")


def mixed(df: DataFrame, source: str = "source", text: str = "text", **options) -> DataFrame:
    """df's rows as the mix has them: each as often as the mix draws it, whole, with the output shard and the place in it.

    A document of which the mix takes only the words that its target still lacked is whole here too: at most one for each source.
    Rows meet their draws by a hash of all their columns, and repeated rows by their number.
    """
    inner = [f"c{i}" for i in range(len(df.columns))]
    planned = _planned(df, source, word_count(F.col(text)), [], **options)
    planned = materialised(planned.select(F.col("id").alias("its_id"), "draws"))
    rows = df.select(*(F.col(c).alias(i) for c, i in zip(df.columns, inner, strict=True)), row_key(df[c] for c in df.columns).alias("id"))
    if planned.where(~F.col("its_id").endswith("|0")).isEmpty():
        rows = rows.withColumn("id", F.concat("id", F.lit("|0")))
    else:
        rows = told_apart(rows, "id")
    planned = planned.where(F.size("draws") > 0)
    out = rows.join(planned, rows["id"] == planned["its_id"]).select(*inner, F.explode("draws").alias("draw"))
    return out.select(*inner, F.col("draw.shard").alias("shard"), F.col("draw.place").alias("place")).toDF(*df.columns, *unused(df.columns, "shard", "place"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the words that the mix takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = f"""
with keyed as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
    {row_key_sql('doc_id', 'source', 'text')} as k from documents),
docs as (select *, k || '|' || (row_number() over (partition by k) - 1) as id from keyed),
sources as (
  select *, 2.0 * source_size as most, sum(source_size) over () as everything, [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from (select source, sum(size)::bigint as source_size from docs group by source)),
units as (
  select *, row_number() over (order by most / weight, source nulls last) as i,
    ({SHARE} * everything - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as a_unit
  from sources),
goals as (select source, source_size, coalesce(least(most, (select arg_min(a_unit, i) from units where most >= a_unit * weight) * weight), most) as target from units),
placed as (select *, {place_sql("'block'", "'1'", "id")} % {BLOCKS} as block, {place_sql("'order'", "'1'", "id")} as place from docs),
dealt as (
  select b.source, block, pass, words, source_size, target, coalesce(sum(words) over (
    partition by b.source order by pass, {place_sql("'turn'", "'1'", "pass::varchar", "block::varchar")}, block rows between unbounded preceding and 1 preceding), 0) as earlier
  from (select source, block, sum(size) as words from placed group by 1, 2) b join goals g on g.source is not distinct from b.source cross join unnest(range({MOST})) p(pass)),
sums as (select *, coalesce(sum(size) over (partition by source, block order by place, id rows between unbounded preceding and 1 preceding), 0) as before from placed)
select doc_id, size, source_size, target, sum(least(size, greatest(0, least(words, greatest(0, round(target) - earlier)) - before)))::bigint as taken
from sums s join dealt d on d.source is not distinct from s.source and d.block = s.block group by doc_id, id, size, source_size, target
"""
