"""Range sharding by sampled splitters, with sizes of the shards as near equal as whole rows allow.

1. A sample of keys is drawn, each row with a chance in proportion to its size; quantiles of the
   sample are the splitters of fine ranges. A key that repeats among them is a range of its own.
2. The bytes of each range are counted exactly. Ranges that hold more than twice the mean are
   subdivided in the order of (key, tie): by the place of the key between the least and the
   greatest key of the range, or, in a range of one key, by the tie, a hash.
3. Sums over the (sub)ranges give each range the bytes before it; inside a range a running sum
   gives each row its own. A shard is the interval of the byte range in which a row's middle
   byte lies, so a shard differs from the mean by less than one row's size.

So the result depends on the sample only in how evenly the work is dealt out, not in the shards.
Null keys stand first. Equal rows are told apart by a row number that is fixed by a checkpoint.
Null texts have no bytes. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from payflux.llm.common import materialised, partitions, unit, unused, with_sums_before

SHARDS = 8
#: Keys drawn for each fine range, on average.
SAMPLE_PER_RANGE = 64
#: A range of more than so many times the mean is subdivided.
OVERFULL = 2
GREATEST = (1 << 63) - 1


def shard(df: DataFrame, key: str, size: Column, shards: int = SHARDS, keep: list[str] | None = None, fine: int | None = None) -> DataFrame:
    """df (or its columns keep) with size, shard and slot (from 0 in each shard, without gaps).

    key: a column of integers; rows are dealt out in its order. size: a row's bytes.
    """
    spark = df.sparkSession
    fine = fine or max(4 * shards, 2 * partitions(spark))
    keep = df.columns if keep is None else keep
    sz, out, slot, uid, tie, rng, sub, one, before, rank, every = unused(
        [*keep, key, "the_range", "parts", "low", "high", "the_shard", "first_rank"], "size", "shard", "slot", "uid", "tie", "range", "sub", "one", "before", "rank", "every"
    )
    first = list(dict.fromkeys([*keep, key]))
    rows = materialised(
        df.withColumn(sz, F.coalesce(size, F.lit(0)).cast("long")).select(*first, sz).withColumn(uid, F.monotonically_increasing_id())
    ).withColumns({tie: F.xxhash64(key, uid), one: F.lit(1).cast("long")})
    total, n = rows.agg(F.coalesce(F.sum(sz), F.lit(0)), F.count("*")).first()
    chance = F.col(sz) * (SAMPLE_PER_RANGE * fine / max(total, 1))
    at = [k / fine for k in range(1, fine)]
    splitters = rows.where(unit(F.lit("sample"), F.col(uid)) < chance).agg(F.percentile_approx(key, at, 10_000)).first()[0] or []
    counted = Counter(int(x) for x in splitters)
    # behind a key that repeats (a hot one) a splitter follows, so that no other key shares its range
    splitters = sorted({*counted, *(x + 1 for x, k in counted.items() if k > 1 and x < GREATEST)})
    found = F.size(F.filter(F.lit(splitters) if splitters else F.array().cast("array<long>"), lambda x: x <= F.col(key)))
    rows = rows.withColumn(rng, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(found))
    # one row for each range
    sizes = rows.groupBy(rng).agg(F.sum(sz).alias("bytes"), F.min(key).alias("low"), F.max(key).alias("high"))
    parts = F.when(F.col("bytes") > OVERFULL * total / fine, F.ceil(F.col("bytes") * fine / max(total, 1))).otherwise(1).cast("long")
    sizes = sizes.select(F.col(rng).alias("the_range"), parts.alias("parts"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
    low, high, cut = sizes["low"], sizes["high"], sizes["parts"]
    place = F.when(high > low, (rows[key] - low) / (high - low + 1)).otherwise((rows[tie].cast("double") + 2.0**63) / 2.0**64)
    rows = rows.join(sizes, rows[rng] == sizes["the_range"]).select(rows["*"], F.least(F.floor(place * cut), cut - 1).cast("long").alias(sub))
    rows = rows.withColumn(rng, F.struct(rng, sub)).withColumn(every, F.lit(0))
    order = [F.col(key).asc_nulls_first(), F.col(tie), F.col(uid)]
    rows = with_sums_before(rows, [every], rng, order, {sz: before, one: rank})
    middle = (F.col(before) * 2 + F.col(sz)).cast("double") / (2.0 * max(total, 1))
    number = F.least(F.floor(middle * shards), F.lit(shards - 1)).cast("int") if total else F.pmod(F.col(rank), F.lit(shards)).cast("int")
    rows = rows.withColumn(out, number)
    # the rank of the first row of each shard: one row for each shard
    firsts = rows.groupBy(F.col(out).alias("the_shard")).agg(F.min(rank).alias("first_rank"))
    if not total:  # rows without a byte are dealt out in turn
        return rows.select(*keep, sz, out, F.floor(F.col(rank) / shards).cast("long").alias(slot))
    return rows.join(F.broadcast(firsts), rows[out] == firsts["the_shard"]).select(*(rows[c] for c in [*keep, sz, out]), (rows[rank] - firsts["first_rank"]).alias(slot))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS) -> None:
    """Writes df to path/shard=k, each in the order of slot. Large shards go to several files."""
    out = shard(df, key, F.octet_length("text") + 1, shards)
    n = max(shards, partitions(df.sparkSession))
    out.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def _after_zeros(x: int, n: int) -> int:
    """What n bytes of 0 make of the inner state x of a crc32."""
    for _ in range(8 * n):
        x = (x >> 1) ^ 0xEDB88320 if x & 1 else x >> 1
    return x


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), (F.octet_length("text") + 1).cast("long").alias("bytes"))
    out = shard(docs, "doc_id", F.col("bytes"), keep=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Bytes that SQL takes at a time: the states of all pieces are found side by side, then put together one after the other.
_PIECE = 64
_MOVED = " ".join(f", case when state >> {i} & 1 = 1 then {_after_zeros(1 << i, _PIECE)} else 0 end)" for i in range(32))
OP6_SQL = f"""
with recursive docs as (select doc_id, row_number() over (order by doc_id) as row, hex(encode(coalesce(text, ''))) as bytes, strlen(coalesce(text, '')) as n from documents),
table_ as (select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as v from range(256) t(i)),
pieces as (select row, piece, case when piece = 0 then substr(bytes, 1, 2 * (n % {_PIECE})) else substr(bytes, 2 * (n % {_PIECE} + {_PIECE} * (piece - 1)) + 1, {2 * _PIECE}) end as bytes
  from (select *, unnest(range(n // {_PIECE} + 1)) as piece from docs)),
steps as (select row, piece, bytes, 0 as pos, case when piece = 0 then 4294967295 else 0 end::bigint as state from pieces
  union all select row, piece, bytes, pos + 1, xor(state >> 8, v) from steps join table_ on i = xor(state & 255, ('0x' || substr(bytes, 2 * pos + 1, 2))::bigint) where 2 * pos < length(bytes)),
states as (select row, piece, state as own from steps where 2 * pos = length(bytes)),
folded as (select row, piece, own as state from states where piece = 0
  union all select f.row, f.piece + 1, xor(s.own, {'xor(' * 32}0{_MOVED}) from folded f join states s on s.row = f.row and s.piece = f.piece + 1),
hashed as (select row, xor(arg_max(state, piece), 4294967295) as text_crc32 from folded group by row),
sums as (select *, n + 1 as size, sum(n + 1) over (order by row rows between unbounded preceding and current row) - n - 1 as before, sum(n + 1) over () as total from docs),
placed as (select *, least(floor((2 * before + size)::double / (2.0::double * total) * {SHARDS}), {SHARDS - 1})::int as shard from sums)
select doc_id, size::bigint as size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by row) - 1 as slot, null::int as grown_shard from placed join hashed using (row)
"""
