"""Phrases of two to four words that occur together more often than their parts would.

Texts are cut into pieces at punctuation and line ends, pieces into words; all counts are by language. A task
gathers texts into shards of bounded size. A shard's words become numbers (of language and word, by dictionary, so without
collisions); prefix doubling ranks the suffixes by their first one, two and four words; the longest common prefixes
of neighbours in that order bound intervals, and an interval's length is the count of its phrase. Counts of shards
are merged by (language, phrase) with map-side sums.

A phrase with `least` occurrences has only parts with as many, so counting goes by levels: words, then pairs of
frequent words, then runs of frequent pairs. What is frequent travels as a Bloom filter of fixed size; what it lets through
in excess is counted and dropped by the exact counts. So a filter that is too small for a corpus costs shuffles and
changes no result, and no count or phrase of the corpus is collected.

Null texts are empty, a null language is `und`. Empty tables give no rows. Repeated rows count as often as they stand there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from payflux.llm.common import blocks_of, hashed_words, materialised, mix64, small_batches, spans_of_words

LONGEST, LEAST, TOP, SCALE, SHARE = 4, 30, 2000, 2_000_000, 80
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 1 << 20
#: Texts that a task has in memory at a time, beside a shard.
BATCH_ROWS = 1000
#: Bits of a filter, 16 MB: fixed, whatever the corpus.
FILTER_BITS = 1 << 27
_BLOCK = 1 << 15
_CUTS, _BETWEEN = np.zeros(256, bool), np.zeros(256, bool)
_CUTS[[*b".,;:!?", *range(10, 14)]] = True
_BETWEEN[[32, 9, *np.flatnonzero(_CUTS)]] = True


# --- suffix arrays ---------------------------------------------------------------------------


def ranked_suffixes(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of their first `depth` (a power of two) symbols, and how many of these each shares with the one before."""
    n = len(ids)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1]
    order, k = np.argsort(ranks[0], kind="stable"), 1
    while k < depth:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - k)] = ranks[-1][k:]
        keys = ranks[-1] * (n + 1) + behind
        order = np.argsort(keys, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], keys[order][1:] != keys[order][:-1]]))[:n]
        ranks.append(new)
        k *= 2
    shared, here, there = np.zeros(n, np.int64), order[1:], order[:-1]
    for rank in reversed(ranks):  # by halves: 4, then 2, then 1 more symbols
        padded = np.concatenate([rank, np.arange(-1, -depth - 1, -1)])
        a, b = here + shared[1:], there + shared[1:]
        equal = (shared[1:] + k <= depth) & (padded[np.minimum(a, n + depth - 1)] == padded[np.minimum(b, n + depth - 1)]) & (a < n) & (b < n)
        shared[1:] += np.where(equal, k, 0)
        k //= 2
    return order, shared


def intervals(order: np.ndarray, shared: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each different phrase of this length first stands in the order, and how often it occurs. room: symbols left in a suffix's piece."""
    fits = room[order] >= length
    new = np.flatnonzero(fits & ((shared < length) | ~np.concatenate([[False], fits[:-1]])))
    # suffixes that share a phrase have room for it all, so an interval ends where the next phrase or one without room begins
    ends = np.flatnonzero(~fits | (shared < length))
    stop = np.concatenate([ends, [len(order)]])[np.searchsorted(ends, new, "right")]
    return order[new], stop - new


# --- shards ----------------------------------------------------------------------------------


class Shard:
    """The words of some texts: where they stand, their hashes and languages, and which of them begin a piece."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, languages: pa.Array):
        self.data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.starts, self.ends, first = spans_of_words(self.data, bounds, _BETWEEN)
        n = len(self.starts)
        cuts = np.concatenate([[0], np.cumsum(_CUTS[self.data])])
        self.begins = np.ones(n, bool)
        if n:
            self.begins[1:] = cuts[self.starts[1:]] > cuts[self.ends[:-1]]
        self.begins[first[:-1][first[:-1] < n]] = True
        named = languages.dictionary_encode()
        self.names = named.dictionary
        self.language = np.repeat(np.asarray(named.indices), np.diff(first)).astype(np.int64)
        seeds = np.array([hash_of_name(x) for x in self.names.to_pylist()], np.uint64)
        self.hashes = mix64(hashed_words(self.data, self.starts, self.ends) ^ seeds[self.language]) if n else np.zeros(0, np.uint64)

    def words(self, at: np.ndarray) -> pa.Array:
        lengths = self.ends[at] - self.starts[at]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        places = np.arange(offsets[-1]) + np.repeat(self.starts[at] - offsets[:-1], lengths)
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.data[places]))])

    def phrases(self, at: np.ndarray, length: int) -> pa.Array:
        parts = [self.words(at + k) for k in range(length)]
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if length > 1 else parts[0]


def hash_of_name(name: str) -> int:
    raw = np.frombuffer(name.encode(), np.uint8)
    return int(hashed_words(raw, np.array([0]), np.array([len(raw)]))[0]) if len(raw) else 1


def hashes_of_pairs(hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def held(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _places(h, 8 * len(bloom))
    return ((bloom[a >> 3] >> (a & 7) & 1) & (bloom[b >> 3] >> (b & 7) & 1)).astype(bool)


def counted(df: DataFrame, language: str, text: str, lengths: tuple[int, ...], words: np.ndarray | None = None, pairs: np.ndarray | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, length, phrase and f (occurrences) of all phrases of these lengths whose words, and pairs of words, the filters hold."""
    shared = [df.sparkSession.sparkContext.broadcast(x) if x is not None else None for x in (words, pairs)]

    def of(shard: Shard) -> Iterator[pa.RecordBatch]:
        n = len(shard.starts)
        if not n:
            return
        good = held(shared[0].value, shard.hashes) if shared[0] else np.ones(n, bool)
        linked = ~shard.begins[1:] & good[:-1] & good[1:]  # whether a phrase may go on to the next word
        if shared[1]:
            linked &= held(shared[1].value, hashes_of_pairs(shard.hashes))
        alone = ~np.concatenate([linked, [False]]) & ~np.concatenate([[False], linked])
        kept = np.flatnonzero(good if 1 in lengths else ~alone)
        if not len(kept):
            return
        goes_on = np.concatenate([linked, [False]])[kept]
        # room: words from here to the end of what is linked
        last = np.flatnonzero(~goes_on)
        room = last[np.searchsorted(last, np.arange(len(kept)))] - np.arange(len(kept)) + 1
        code = shard.words(kept).dictionary_encode()
        ids = np.asarray(code.indices).astype(np.int64) + shard.language[kept] * len(code.dictionary)
        order, common = ranked_suffixes(ids, 1 << (max(lengths) - 1).bit_length())
        for length in lengths:
            at, f = intervals(order, np.minimum(common, room[order]), room, length)
            for k in range(0, len(at), 1 << 16):
                where = kept[at[k : k + (1 << 16)]]
                names = shard.names.take(pa.array(shard.language[where]))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(where), length, np.int32)), shard.phrases(where, length).cast(pa.string()), pa.array(f[k : k + (1 << 16)])], names=["lang", "length", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        for batch in batches:
            for i, j, data, bounds in blocks_of(batch.column(1), shard_bytes):
                if waiting and sum(len(x[0]) for x in waiting) + len(data) > shard_bytes:
                    yield from of(_together(waiting))
                    waiting = []
                # copies, for a view would hold the whole batch in memory
                waiting.append((data.copy(), bounds, batch.column(0).take(pa.array(np.arange(i, j)))))
        if waiting:
            yield from of(_together(waiting))

    rows = df.select(F.coalesce(F.col(language).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(run, "lang string, length int, phrase string, f bigint")
    return found.groupBy("lang", "length", "phrase").agg(F.sum("f").alias("f"))


def _together(parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> Shard:
    before = np.cumsum([0, *(len(d) for d, _, _ in parts)])
    bounds = np.concatenate([*(b[:-1] + k for (_, b, _), k in zip(parts, before, strict=False)), before[-1:]])
    return Shard(np.concatenate([d for d, _, _ in parts]), bounds, pa.concat_arrays([x for _, _, x in parts]))


def filter_of(phrases: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of (lang, phrase), phrases of one or of two words. What comes to the driver has this size at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            if batch.num_rows:
                for _, _, data, bounds in blocks_of(batch.column(1)):
                    starts, ends, first = spans_of_words(data, bounds, _BETWEEN)
                    words = hashed_words(data, starts, ends)
                    named = batch.column(0).dictionary_encode()
                    seeds = np.array([hash_of_name(x) for x in named.dictionary.to_pylist()], np.uint64)[np.asarray(named.indices)]
                    h = mix64(words ^ np.repeat(seeds, np.diff(first)))
                    if len(h) == 2 * len(seeds):
                        h = hashes_of_pairs(h)[::2]
                    for at in _places(h, bits):
                        np.bitwise_or.at(found, at >> 3, (1 << (at & 7)).astype(np.uint8))
        rows = found.reshape(-1, _BLOCK >> 3)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([rows[k].tobytes() for k in used], pa.binary())], names=["block", "bits"])

    out = np.zeros((bits // _BLOCK, _BLOCK >> 3), np.uint8)
    blocks = phrases.select("lang", "phrase").mapInArrow(run, "block int, bits binary").groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
    for r in blocks.toLocalIterator():
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


# --- scores ----------------------------------------------------------------------------------


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def collocations(
    df: DataFrame, language: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, share: int = SHARE, bits: int = FILTER_BITS, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases. least: occurrences that a phrase must have."""
    frequent = F.col("f") >= least
    with small_batches(df.sparkSession, BATCH_ROWS):
        one = materialised(counted(df, language, text, (1,), shard_bytes=shard_bytes))
        words = one.where(frequent)
        known = filter_of(words, bits)
        two = materialised(counted(df, language, text, (2,), known, shard_bytes=shard_bytes).where(frequent))
        more = materialised(counted(df, language, text, tuple(range(3, LONGEST + 1)), known, filter_of(two, bits), shard_bytes).where(frequent))
    sizes = one.groupBy("lang").agg(F.sum("f").alias("n"))
    longer = two.unionByName(more)
    phrases = longer.unionByName(words)

    part = F.split("phrase", " ", -1)
    pieces = longer.withColumn("w", part).select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    pieces = pieces.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = pieces.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    cuts = cuts.withColumns({"x": F.lit(SCALE).cast("decimal(7,0)") * _exact("a"), "y": (_exact("l") + _exact("r")).cast("decimal(20,0)")})
    cuts = cuts.select("lang", "phrase", "a", F.struct(F.expr("x div y").cast("long").alias("score"), "k", "l", "r").alias("cut"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))

    # what lies inside a longer phrase: a phrase of k words has two of k - 1, three of k - 2 ...
    inside = longer.where("length > 2").withColumn("w", part)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("length") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("length") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    covered = inside.select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest_f"))
    hundred = F.lit(100).cast("decimal(3,0)")
    kept = scored.join(covered, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longest_f").isNull() | (hundred * _exact("longest_f") < F.lit(share).cast("decimal(3,0)") * _exact("a")))
    out = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # each task hands on its first rows of a language only
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = out.withColumn("rank", place).where(F.col("rank") <= top)
    return out.join(F.broadcast(sizes), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language over all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
sizes as (select lang, sum(len(w))::bigint as n from words group by lang),
grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as phrase from words cross join range(1, 5) t(k)),
f as (select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 30),
long as (select *, string_split(phrase, ' ') as w from f where k > 1),
cuts as (select lang, phrase, f as a, w, unnest(range(1, k)) as cut from long),
parts as (select lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') as head, array_to_string(w[cut + 1 :], ' ') as rest from cuts),
scores as (select p.lang, p.phrase, a, cut, h.f as l, t.f as r, (2000000::hugeint * a // (h.f + t.f))::bigint as score from parts p join f h on h.lang = p.lang and h.phrase = head join f t on t.lang = p.lang and t.phrase = rest),
least as (select * from scores qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
spans as (select lang, f, k, w, unnest(range(2, k)) as size from long),
inner_ as (select lang, f, unnest(list_transform(range(1, k - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) as phrase from spans),
covered as (select lang, phrase, max(f) as longest from inner_ group by all),
kept as (select least.* from least left join covered using (lang, phrase) where longest is null or 100::hugeint * longest < 80::hugeint * a)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score from kept join sizes using (lang) qualify rank <= 2000"""
