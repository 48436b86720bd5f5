"""Exact deduplication by two passes with a Bloom filter.

1. Every text is hashed once; a slim table of hashes is written. Each hash stands for two bits of one block of
   2**15 bits. Bits are counted with map-side sums, and those that more than one row asks for make up the filter: a
   bitmap for each block. A repeated hash finds all of its bits there; of others only what shares each bit with some row.
2. Each row looks its bits up in the filter, which is broadcast. Rows that miss one are single and pass straight
   through; the rest are shuffled by their hash, counted and joined with their group. Groups of more than 1/4096 of the rows
   (there are fewer than 4096) are broadcast instead, so no task gets a hot group.

The filter has 16 bits a row, but never more than `most_bytes`: it is broadcast. Beyond that size more single rows
are taken for possibly repeated, which costs shuffles and changes no result: groups are formed by sha256 alone.

Null texts count as empty ones. Of equal texts the row with the largest key stays; a null key is less than any.
Rows that repeat whole are one group like others, of which one row stays. An empty table gives no rows. Columns of any name may follow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payflux.llm.common import materialised

#: Bits of a block; fixed by bitmap_construct_agg.
BLOCK_BITS = 1 << 15
BITS_PER_ROW = 16
#: Bytes that the broadcast filter may have.
MOST_BYTES = 256 << 20
#: A group of more than one in so many rows is hot.
HOT = 4096


def digest(text: Column, normalised: Callable[[Column], Column] | None = None) -> Column:
    """sha256 of the text (of its normal form, if there is one), as 32 bytes. Null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2((normalised(text) if normalised else text).cast("binary"), 256))


def blocks_for(rows: int, most_bytes: int = MOST_BYTES) -> int:
    return max(1, min(-(-rows * BITS_PER_ROW // BLOCK_BITS), most_bytes * 8 // BLOCK_BITS))


def _block(sha: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(sha), 30), F.lit(blocks)).cast("int")


def _bits(sha: Column) -> Column:
    h = F.xxhash64(sha)
    return F.array_distinct(F.array(h.bitwiseAND(BLOCK_BITS - 1), F.shiftrightunsigned(h, 15).bitwiseAND(BLOCK_BITS - 1)))


def repeated_bits(prints: DataFrame, sha: str, blocks: int) -> DataFrame:
    """the_block and its bitmap: the bits that more than one row asks for. At most `blocks` rows of 4 kB."""
    asked = prints.select(_block(F.col(sha), blocks).alias("the_block"), F.explode(_bits(F.col(sha))).alias("bit"))
    twice = asked.groupBy("the_block", "bit").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy("the_block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def with_doubt(rows: DataFrame, sha: str, bitmaps: DataFrame, blocks: int, name: str) -> DataFrame:
    """rows with a flag: whether the filter holds all bits of the hash. Rows without the flag are single."""
    found = rows.join(F.broadcast(bitmaps), _block(rows[sha], blocks) == bitmaps["the_block"], "left")
    byte = lambda b: F.conv(F.hex(F.substring(F.col("bitmap"), (F.shiftright(b, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.forall(_bits(rows[sha]), lambda b: F.get(F.array(*(F.shiftright(byte(b), k).bitwiseAND(1) for k in range(8))), b.bitwiseAND(7).cast("int")) == 1)
    return found.select(*(rows[c] for c in rows.columns), F.coalesce(held, F.lit(False)).alias(name))


def marked(df: DataFrame, key: str = "doc_id", text: str = "text", normalised: Callable[[Column], Column] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A row for each of df's: key, keep_id (key of the row that stays), group_size, kept, sha256 (bytes)."""
    prints = materialised(df.select(F.col(key).alias("id"), digest(F.col(text), normalised).alias("sha")).withColumn("uid", F.monotonically_increasing_id()))
    n = prints.count()
    blocks = blocks_for(n, most_bytes)
    bitmaps = materialised(repeated_bits(prints, "sha", blocks))
    rows = with_doubt(prints, "sha", bitmaps, blocks, "doubt")
    alone = rows.where("not doubt").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    doubtful = rows.where("doubt").drop("doubt")
    groups = doubtful.groupBy(F.col("sha").alias("its_sha")).agg(F.count("*").alias("group_size"), F.max(F.struct("id", "uid")).alias("best"))
    groups = materialised(groups.where("group_size > 1"))
    hot = groups.where(F.col("group_size") * HOT > n)
    of_hot = doubtful.join(F.broadcast(hot), doubtful["sha"] == hot["its_sha"])
    others = doubtful.join(F.broadcast(hot.select("its_sha")), doubtful["sha"] == F.col("its_sha"), "left_anti")
    rest = groups.where(F.col("group_size") * HOT <= n)
    of_rest = others.join(rest, others["sha"] == rest["its_sha"], "left")

    def told(x: DataFrame) -> DataFrame:
        grouped = F.col("group_size").isNotNull()
        keep = F.when(grouped, F.col("best.id")).otherwise(F.col("id"))
        kept = F.when(grouped, F.col("best.uid") == F.col("uid")).otherwise(F.lit(True))
        return x.select("id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "sha")

    return alone.unionByName(told(of_hot)).unionByName(told(of_rest)).select(F.col("id").alias(key), *(c for c in alone.columns if c != "id"))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", normalised: Callable[[Column], Column] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of df that stay, with all their columns. Single rows aren't shuffled; of a group one row leaves each task."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # names may be equal but for their case
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = plain.withColumn("sha", digest(F.col(at[text]), normalised))
    prints = materialised(rows.select("sha"))
    blocks = blocks_for(prints.count(), most_bytes)
    rows = with_doubt(rows, "sha", materialised(repeated_bits(prints, "sha", blocks)), blocks, "doubt")
    every = list(at.values())
    order = F.struct(F.col(at[key]), F.xxhash64(*every))
    best = rows.where("doubt").groupBy("sha").agg(F.max_by(F.struct(*every), order).alias("row")).select("row.*")
    return rows.where("not doubt").select(*every).unionByName(best).toDF(*df.columns)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: which of their equal texts stays."""
    out = marked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP13_SQL = """select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  row_number() over (partition by t order by doc_id desc) = 1 as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents) window same as (partition by t)"""
