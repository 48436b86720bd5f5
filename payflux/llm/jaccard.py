"""Similarity join of documents by the Jaccard coefficient of their sets of word n-grams.

1. One pass over the texts gives MinHash values of the n-grams, in bands. Rows to a band are as
   many as MOST_HASHES allows, bands as many as it takes to find a pair at the threshold with
   the target recall: 31 bands of 6 for 0.8 and 0.9999.
2. Equal texts are one from here on, with a count.
3. Texts that agree in a band meet. Each is linked with the first of its bucket only, so rows
   grow with the texts, not with pairs; connected components of these links are the groups that
   may hold similar pairs.
4. The n-gram sets of grouped texts, read once more, are compared in full inside the groups, or
   inside the buckets of a group where that compares fewer sets (a chance band now and then can chain
   templated pages to one large group whose buckets are small). What has more than BLOCK texts is
   split into blocks, each pair of blocks a tile of its own, so a set is sent once for each block.
   FEW_BLOCKS are enough for the tasks of a cluster; there are more only where a block would pass
   MOST_TEXTS or MOST_GRAMS, so tasks have bounded memory and few copies travel. A tile is worked
   in steps of some STEP by STEP texts. In a step, columns of the incidence matrix that are equal
   are one with a weight, and one matrix product counts what all pairs share.
5. A tile returns, for each text, how many it is similar to and the first of its part of the
   graph, never pairs; components are joined from these. So a link is returned only if the full
   sets say so, and lost only if no band agrees along the whole group.

A text of fewer words than n has one n-gram, all its words. Null texts and those without words
have none and are similar to nothing, not even each other. Texts with the same words in the same
order are copies, whatever stands between the words. Rows that share an id are kept apart. Null
ids come first. An empty table gives no rows. Other columns are returned as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from payflux.functions.numbering import materialised
from payflux.llm.common import WORD, blocks_of, hashed_words, mix64, ranges, spans_of_words
from payflux.llm.components import components
from payflux.llm.exact_dedup import _bits, _block, blocks_for, with_doubt

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
MOST_HASHES = 256
#: Texts of a block, at least, in a group of more than FEW_BLOCKS of them; texts and n-grams of any block, at most.
BLOCK, FEW_BLOCKS, MOST_TEXTS, MOST_GRAMS = 512, 16, 8192, 1 << 21
#: Texts of one side of a step inside a tile, at most.
STEP = 640
#: Columns of an incidence matrix at a time.
COLUMNS = 2048
#: Bytes that a broadcast table may have. Beyond, what says where texts are compared is joined by a shuffle of those texts
#: that a filter of at most as many bytes lets through.
MOST_BROADCAST = 64 << 20
#: Bytes of a broadcast row with its key, of each of its homes and of each of its bands.
ROW_BYTES, HOME_BYTES, BAND_BYTES = 256, 40, 8
TILE = ("a", "band", "low", "high")


def bands_for(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows of each: the most rows for which so many hashes reach the recall at the threshold."""
    best = (1, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p)) if p > 0 else most + 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, how many each text has, hashes of the words, and how many."""
    starts, ends, first = spans_of_words(data, bounds)
    words = hashed_words(data, starts, ends)
    counts = np.diff(first)
    short = np.minimum(counts, n)
    grams = np.where(counts > 0, counts - short + 1, 0)
    at = ranges(first[:-1], grams)
    width = np.repeat(short, grams)
    h = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        h = np.where(k < width, mix64(h + padded[at + k] + np.uint64(k + 1)), h)
    return h, grams, words, counts


def _signed(bands: int, rows: int, n: int):
    rng = np.random.default_rng(7)
    flips = rng.integers(0, 1 << 32, bands * rows, np.uint32)
    factors = rng.integers(0, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.zeros(batch.num_rows, np.int32)
            keys = np.zeros((batch.num_rows, 2), np.int64)
            out = np.zeros((batch.num_rows, bands), np.uint64)
            for i, j, data, bounds in blocks_of(batch.column("text"), 1 << 18):
                h, grams, words, counts = shingles(data, bounds, n)
                count[i:j] = grams
                if not len(h):
                    continue
                some = np.flatnonzero(grams)
                firsts = (np.cumsum(grams) - grams)[some]
                place = ranges(np.zeros(len(counts), np.int64), counts).astype(np.uint64)
                for k in range(2):  # two sums over (word, place): the words in their order
                    terms = mix64(words ^ mix64(place * np.uint64(2) + np.uint64(k)))
                    keys[some + i, k] = np.add.reduceat(terms, (np.cumsum(counts) - counts)[some]).view(np.int64)
                small = h.astype(np.uint32)
                for band in range(bands):
                    total = np.full(len(some), band, np.uint64)
                    for r in range(band * rows, band * rows + rows):
                        least = np.minimum.reduceat((small ^ flips[r]) * factors[r], firsts)
                        total = mix64(total + least)
                    out[some + i, band] = total
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, bands, dtype=np.int32)), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("digest"), pa.array(count), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists],
                names=["id", "digest", "grams", "k0", "k1", "bands"],
            )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in blocks_of(batch.column("text"), 1 << 20):
                h, grams, _, _ = shingles(data, bounds, n)
                text = np.repeat(np.arange(len(grams)), grams)
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                h, text = h[new], text[new]
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(grams)))]).astype(np.int32)
                rest = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*(rest.column(c) for c in ("uid", "weight", "homes", "bands")), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))],
                    names=["uid", "weight", "homes", "bands", "grams"],
                )

    return run


def similar(grams: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold. grams: the sets one after the other."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    _, column, shared = np.unique(grams, return_inverse=True, return_counts=True)
    many = shared[column] > 1
    owner, column = owner[many], column[many]
    common = np.zeros((n, n), np.float32)
    if len(owner):
        # columns with the same owners are one, with a weight
        marks = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        first = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
        ends = np.concatenate([first[1:], [len(column)]])
        _, at, weight = np.unique(np.add.reduceat(marks[owner], first), return_index=True, return_counts=True)
        for i in range(0, len(at), COLUMNS):
            part = at[i : i + COLUMNS]
            lengths = (ends - first)[part]
            incidence = np.zeros((n, len(part)), np.float32)
            incidence[owner[ranges(first[part], lengths)], np.repeat(np.arange(len(part)), lengths)] = 1
            common += (incidence * weight[i : i + COLUMNS].astype(np.float32)) @ incidence.T
    union = sizes[:, None] + sizes[None, :] - common
    out = common >= threshold * union - 1e-6
    np.fill_diagonal(out, False)
    return out


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the first row that it is connected with by links of a with b."""
    first, before = np.arange(n), None
    while len(a) and (before is None or (first != before).any()):
        before = first.copy()
        np.minimum.at(first, a, before[b])
        np.minimum.at(first, b, before[a])
        first = np.minimum(first, first[first])
    return first


def steps_of(block: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tile in pairs of some of its rows: each pair of rows that belongs to the tile is in one of them."""
    sides = [np.array_split(at, -(-len(at) // STEP)) if len(at := np.flatnonzero(block == k)) else [] for k in (low, high)]
    for i, a in enumerate(sides[0]):
        for b in sides[1][i if low == high else 0 :]:
            yield a, b


def in_earlier_band(bands: np.ndarray, band: int) -> np.ndarray:
    """Which pairs of rows share a band before this one."""
    out = np.zeros((len(bands), len(bands)), bool)
    for k in range(band):
        out |= bands[:, k, None] == bands[None, :, k]
    return out


def _verified(threshold: float):
    def one(tile: pa.Table) -> pa.RecordBatch:
        tile = tile.combine_chunks()
        uid, weight, block = (tile.column(c).to_numpy() for c in ("uid", "weight", "block"))
        low, high, band = (tile.column(c)[0].as_py() for c in ("low", "high", "band"))
        sets = tile.column("grams").chunk(0)
        grams, begins = sets.flatten().to_numpy(), sets.offsets.to_numpy() - sets.offsets[0].as_py()
        sizes = np.diff(begins)
        bands = tile.column("bands").chunk(0).flatten().to_numpy().reshape(len(uid), -1) if band > 0 else None
        total, joins = np.zeros(len(uid), np.int64), []
        for a, b in steps_of(block, low, high):
            at = a if low == high and a[0] == b[0] else np.concatenate([a, b])
            near = similar(grams[ranges(begins[:-1][at], sizes[at])], sizes[at], threshold)
            if len(at) > len(a):  # pairs of one side belong to other steps or tiles
                near[: len(a), : len(a)] = near[len(a) :, len(a) :] = False
            if bands is not None:
                near &= ~in_earlier_band(bands[at], band)
            total[at] += near @ weight[at]
            joins.append((at, at[least_reached(len(at), *np.nonzero(near))]))
        first = least_reached(len(uid), *(np.concatenate(x) for x in zip(*joins, strict=True))) if joins else np.arange(len(uid))
        at = np.flatnonzero(total > 0)
        return pa.RecordBatch.from_arrays([pa.array(uid[at]), pa.array(total[at]), pa.array(uid[first[at]])], names=["uid", "weight", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            new = np.zeros(rest.num_rows, bool)
            new[0] = True
            for c in TILE:
                new[1:] |= np.diff(rest.column(c).to_numpy()) != 0
            once = new.copy()
            once[1:] |= np.diff(rest.column("uid").to_numpy()) != 0
            if not once.all():  # repeated rows of the input
                rest, new = rest.filter(pa.array(once)), new[once]
            edges = np.flatnonzero(new)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield one(rest.slice(a, b - a))
            rest = rest.slice(edges[-1])
        if rest is not None and rest.num_rows:
            yield one(rest)

    return run


def digest(text: str) -> Column:
    """Tells texts that share an id apart."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest")


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    bands, rows = bands_for(threshold, recall)
    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("id"), digest(text), F.col(text).alias("text")).mapInArrow(
        _signed(bands, rows, n), f"id {kind}, digest string, grams int, k0 bigint, k1 bigint, bands array<bigint>"
    )


def blocks_in(n: str, grams: str) -> Column:
    """Blocks of a group or bucket of so many texts with so many n-grams."""
    some = F.least(F.ceil(F.col(n) / BLOCK), F.lit(FEW_BLOCKS))
    return F.greatest(some, F.ceil(F.col(n) / MOST_TEXTS), F.ceil(F.col(grams) / MOST_GRAMS)).cast("long")


def homes_of(own: DataFrame) -> DataFrame:
    """own (uid, grams: how many, bands: their hashes) -> uid, homes: where the text is compared, and bands if these are buckets.

    A home is a whole group, of which all pairs of blocks are compared, or a bucket of it, where pairs
    that share an earlier band are left out. Of each group that way is taken which compares fewer sets:
    a group is cheaper where all are alike, its buckets where chains of a few common bands made it large.
    """
    work = F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK)).alias("work")
    members = own.select("uid", "grams", F.posexplode("bands").alias("band", "hash"))
    heads = members.groupBy("band", "hash").agg(F.min("uid").alias("head"), F.count("*").alias("n"), F.sum("grams").alias("grams")).where("n > 1")
    heads = materialised(heads.withColumn("its_blocks", blocks_in("n", "grams")).drop("grams"))
    met = materialised(members.drop("grams").join(heads, ["band", "hash"]).select("uid", "band", "hash", "head", "its_blocks"))
    groups = components(met.where("uid <> head").select(F.col("uid").alias("u"), F.col("head").alias("v")))
    sizes = groups.join(own.select("uid", "grams"), F.col("id") == F.col("uid")).groupBy("component").agg(F.count("*").alias("n"), F.sum("grams").alias("grams"))
    sizes = sizes.withColumn("blocks", blocks_in("n", "grams"))
    # small groups are one tile; buckets are looked at for the others
    large = materialised(sizes.where("blocks > 1"))
    few = large.count()
    if not few:
        home = F.struct(F.col("component").alias("a"), F.lit(-1).alias("band"), F.lit(1).cast("long").alias("blocks"))
        return groups.select(F.col("id").alias("uid"), F.array(home).alias("homes"), F.lit(None).cast("array<bigint>").alias("bands"))
    by_bucket = heads.join(groups, heads["head"] == groups["id"]).join(large.select("component"), "component", "left_semi")
    by_bucket = by_bucket.groupBy("component").agg(work)
    # one row for each group of more than one block
    large = large.join(by_bucket, "component").select("component", "blocks", (F.col("work") < F.col("n") * F.ceil(F.col("n") / BLOCK)).alias("split"))
    large = materialised(large)
    placed = groups.join(F.broadcast(large) if few * ROW_BYTES <= MOST_BROADCAST else large, "component", "left")
    placed = placed.select("id", "component", F.coalesce("blocks", F.lit(1).cast("long")).alias("blocks"), F.coalesce("split", F.lit(False)).alias("split"))
    home = lambda a, b, blocks: F.struct(F.col(a).alias("a"), b.cast("int").alias("band"), F.col(blocks).alias("blocks"))
    whole = placed.where(~F.col("split")).select(F.col("id").alias("uid"), F.array(home("component", F.lit(-1), "blocks")).alias("homes"), F.lit(None).cast("array<bigint>").alias("bands"))
    if large.where("split").isEmpty():
        return whole
    parts = met.join(placed.where("split").select(F.col("id").alias("uid")), "uid", "left_semi")
    parts = parts.groupBy("uid").agg(F.collect_list(home("hash", F.col("band"), "its_blocks")).alias("homes"))
    return whole.unionByName(parts.join(own, "uid").select("uid", "homes", "bands"))


def broadcast_bytes(chosen: DataFrame) -> int:
    """What a broadcast of the table takes: rows with their ids, homes and bands."""
    size = F.lit(ROW_BYTES) + F.coalesce(F.octet_length(F.col("its_id").cast("string")), F.lit(0)) + HOME_BYTES * F.size("homes") + BAND_BYTES * F.coalesce(F.size("bands"), F.lit(0))
    return chosen.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]


def likely(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Those of texts that a Bloom filter takes for chosen: all that are, and few others while the filter is not full. No text is shuffled for that."""
    blocks = blocks_for(chosen.count(), max(MOST_BROADCAST, 1 << 20))
    its_key = F.xxhash64("its_id", "its_digest")
    bitmaps = materialised(chosen.select(_block(its_key, blocks).alias("the_block"), F.explode(_bits(its_key)).alias("bit")).groupBy("the_block").agg(F.bitmap_construct_agg("bit").alias("bitmap")))
    return with_doubt(texts.withColumn("key", F.xxhash64("doc", "digest")), "key", bitmaps, blocks, "chosen").where("chosen").drop("key", "chosen")


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each document: id, digest (of its text), n_links (documents similar to it), component_id (the least id that links reach) and kept (true for one row of each component)."""
    rows = materialised(signatures(docs, doc_id, text, n, threshold, recall).withColumn("uid", F.monotonically_increasing_id()))
    apart = rows.where("grams = 0").select("id", "digest", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where("grams > 0")
    # a row for each text; its uid is that of the first row with the least id
    classes = rows.groupBy("k0", "k1").agg(F.count("*").alias("weight"), F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "uid", "digest")).alias("first"))
    classes = materialised(classes.select("k0", "k1", "weight", "first.uid", "first.id", "first.digest"))
    own = rows.join(classes.select("uid"), "uid", "left_semi").select("uid", "grams", "bands")
    homes = homes_of(own)
    chosen = classes.join(homes, "uid").select("uid", "weight", "homes", "bands", F.col("id").alias("its_id"), F.col("digest").alias("its_digest"))
    chosen = materialised(chosen)
    # read these texts once more; repeated rows come several times here, once in a tile
    texts = docs.select(F.col(doc_id).alias("doc"), digest(text), F.col(text).alias("text"))
    if broadcast_bytes(chosen) <= MOST_BROADCAST:
        chosen = F.broadcast(chosen)
    else:
        texts = likely(texts, chosen)
    texts = texts.join(chosen, (F.col("its_digest") == F.col("digest")) & F.col("its_id").eqNullSafe(F.col("doc")))
    kinds = "uid bigint, weight bigint, homes array<struct<a:bigint,band:int,blocks:bigint>>, bands array<bigint>, grams array<bigint>"
    sets = texts.select("uid", "weight", "homes", "bands", "text").mapInArrow(_sets(n), kinds)
    sets = sets.select("uid", "weight", "bands", "grams", F.inline("homes"))
    sets = sets.withColumn("block", F.pmod(F.xxhash64("uid"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = sets.select("a", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "uid", "weight", "block", "bands", "grams")
    found = tiles.repartition(*TILE).sortWithinPartitions(*TILE, "uid").mapInArrow(_verified(threshold), "uid bigint, weight bigint, first bigint")
    found = materialised(found)
    counts = found.groupBy("uid").agg(F.sum("weight").alias("others"))
    parts = components(found.select(F.col("uid").alias("u"), F.col("first").alias("v"))).withColumnRenamed("id", "uid")
    classes = classes.join(counts, "uid", "left").join(parts, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = classes.groupBy("component").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "uid")).alias("least"))
    classes = classes.join(least, "component").select(
        F.col("k0").alias("c0"),
        F.col("k1").alias("c1"),
        (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.col("least.id").alias("component_id"),
        F.col("least.uid").alias("kept_uid"),
    )
    out = rows.join(classes, (rows["k0"] == classes["c0"]) & (rows["k1"] == classes["c1"]))
    return out.select("id", "digest", "n_links", "component_id", (F.col("uid") == F.col("kept_uid")).alias("kept")).unionByName(apart)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their number of links and their component, at a Jaccard coefficient of 0.8 of 5-word n-grams."""
    rows = joined(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), "n_links", "component_id", "kept")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the least id. Texts without words stay, all of them."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(c).alias(i) for c, i in zip(docs.columns, inner, strict=True)), F.col(doc_id).alias("id"), digest(text), F.coalesce(F.col(text).rlike(WORD), F.lit(False)).alias("has_words"))
    stay = joined(docs, doc_id, text).where("kept").select(F.col("id").alias("its_id"), F.col("digest").alias("its_digest")).distinct()
    some = rows.where("has_words").join(stay, F.col("its_id").eqNullSafe(F.col("id")) & (F.col("its_digest") == F.col("digest")))
    # repeated rows: one of them, picked before they are sent
    nth = F.row_number().over(Window.partitionBy("id", "digest").orderBy("id"))
    some = some.withColumn("nth", nth).where("nth = 1")
    return some.select(*inner).unionByName(rows.where("not has_words").select(*inner)).toDF(*docs.columns)


OP9_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
grams as (
  select distinct doc_id, g from (select doc_id, unnest(list_transform(range(greatest(len(w) - {WORDS - 1}, 1)), lambda i: w[i + 1 : i + {WORDS}])) as g from w where len(w) > 0)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where c >= {THRESHOLD} * (x.n + y.n - c) - 1e-6),
reached as (select a as id, a as other from links union select r.id, l.b from reached r join links l on l.a = r.other),
least as (select id, min(other) as component_id from reached group by id),
counts as (select a as id, count(*) as n_links from links group by a)
select doc_id, coalesce(n_links, 0) as n_links, coalesce(component_id, doc_id) as component_id, coalesce(component_id, doc_id) = doc_id as kept
from documents left join least on least.id = doc_id left join counts on counts.id = doc_id
"""
