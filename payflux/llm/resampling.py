"""Importance resampling towards a target: documents are drawn by how much more likely their features are in the target.

Features are runs of one to three words, hashed to buckets. Counts of buckets over all documents and over the
target give each bucket a gain; a document's weight is the sum of its features' gains, and Gumbel noise drawn
from its id turns the k highest scores into a draw without replacement.

1. Arrow batches are tokenised and hashed as arrays; each task returns one row a bucket. The gains (a number for
   each bucket, whatever the corpus) go back into a second pass, which scores the documents.
2. The k-th key of (score, doc_id) is found by radix selection: counts of the next 16 bits of the key, over the
   rows that share the bits found so far, name the next digit. The driver sees at most 65,536 counts at a time.
3. Only rows up to that key are range-sorted and ranked.

Null texts have no words. A null id is drawn as the empty text and stands last among ties; rows equal in score and id are
told apart by a row number that a written table fixes. Without target or documents nothing is drawn amiss: counts are 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payflux.functions.numbering import numbered
from payflux.llm.common import blocks_of, materialised, ranges, spans_of_words

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 3, 42, 20, 5
DIGIT = 16
#: What comes after a longer word is hashed feature by feature.
_LONG = 256
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


_CRC = _crc_table()


def _continued(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Inverted crc32 of what each of crc stands for, followed by so many bytes of data."""
    crc = crc.copy()
    far = np.flatnonzero(lengths > _LONG)
    for i in far:
        crc[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes(), int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    left, k = np.flatnonzero((lengths > 0) & (lengths <= _LONG)), 0
    while len(left):
        now = crc[left]
        crc[left] = _CRC[(now ^ data[starts[left] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
        k += 1
        left = left[lengths[left] > k]
    return crc


def hashed_features(data: np.ndarray, bounds: np.ndarray, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text; for each length of runs, the bucket of each run and the text that it is of.

    data: bytes of texts that lie one after the other; bounds: where they begin, and the end.
    """
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, first = spans_of_words(data, bounds, _BETWEEN)
    words, lengths = np.diff(first), ends - starts
    owner = np.repeat(np.arange(len(words)), words)
    # the words with one space between them, so that a run is one stretch of bytes
    places = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int((lengths + 1).sum()), 32, np.uint8)
    joined[ranges(places, lengths)] = data[ranges(starts, lengths)]
    out, crc = [], np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for n in range(1, longest + 1):
        if len(crc) == 0:
            break
        at = np.arange(len(crc)) + n - 1  # the word that is added
        crc = _continued(crc, joined, places[at] - (n > 1), lengths[at] + (n > 1))
        inside = owner[: len(crc)] == owner[at]
        out.append((((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)[inside], owner[: len(crc)][inside]))
        crc = crc[:-1]
    return words, out


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of all features by bucket; from each task one row for each bucket at most, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, bounds in blocks_of(batch.column(0)):
                for found, _ in hashed_features(data, bounds, buckets=buckets)[1]:
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col(text).cast("string")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target; counts are smoothed by one."""
    s_all, t_all = float(source.sum()) + len(source), float(target.sum()) + len(target)
    ratios = ((t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def weighed(df: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_features and weight (the sum of the features' gains) of each row."""
    gain = np.asarray(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, j, data, bounds in blocks_of(batch.column(1)):
                words, runs = hashed_features(data, bounds, buckets=len(gain))
                n_words[i:j] = words
                for found, owner in runs:
                    ends = np.searchsorted(owner, np.arange(j - i + 1))
                    sums = np.concatenate([[0], np.cumsum(gain[found])])
                    n_features[i:j] += np.diff(ends)
                    weight[i:j] += sums[ends[1:]] - sums[ends[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], names=["key", "n_words", "n_features", "weight"])

    kind = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("key"), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, n_words bigint, n_features bigint, weight bigint")
    return out.withColumnRenamed("key", key)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, drawn from sha256 of seed:key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def kth_key(rows: DataFrame, keys: list[str], k: int) -> list[int]:
    """The k-th least (from 1) of the rows' keys, columns of integers without nulls; fewer columns where fewer are enough.

    Rows up to it are those whose leading columns are not greater.
    """
    found: list[int] = []
    for name in keys:
        # with the sign bit turned, the order is that of unsigned numbers
        low, high = (x + (1 << 63) for x in rows.agg(F.min(name), F.max(name)).first())
        turned = F.col(name).bitwiseXOR(F.lit(-(1 << 63)))
        left = (low ^ high).bit_length()
        base = low >> left << left
        while left > 0:
            width = min(DIGIT, left)
            digit = F.shiftrightunsigned(turned, left - width).bitwiseAND((1 << width) - 1)
            counts = sorted((r["digit"], r["n"]) for r in rows.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect())
            for d, n in counts:
                if k <= n:
                    break
                k -= n
            left -= width
            base |= d << left
            if k == n:  # all that share these digits are wanted
                return [*found, (base | ((1 << left) - 1)) - (1 << 63)]
            rows = rows.where(digit == d)
        found.append(base - (1 << 63))
    return found


def up_to(keys: list[str], bound: list[int]) -> Column:
    """Whether a row's leading keys are not greater than the bound."""
    out = F.lit(True)
    for name, value in reversed(list(zip(keys, bound, strict=False))):
        out = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
    return out


def resampled(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS
) -> DataFrame:
    """A row for each of df's: key, n_features, weight, score, rank (from 1 among the drawn, else null).

    key: a column of integers. Of the rows with enough words, so many percent are drawn.
    """
    gain = gains(bucket_counts(df, text, buckets), bucket_counts(target, text, buckets))
    rows = weighed(df, gain, key, text).withColumnRenamed(key, "id")
    rows = rows.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumn("uid", F.monotonically_increasing_id())
    # ascending: the highest score has the least place
    rows = materialised(rows.withColumns({"place": F.bitwise_not("score"), "order": F.coalesce(F.col("id").cast("long"), F.lit((1 << 63) - 1))}))
    able = rows.where(F.col("n_words") >= least_words)
    k = able.count() * percent // 100
    out = ["id", "n_features", "weight", "score"]
    if not k:
        return rows.select(*out, F.lit(None).cast("long").alias("rank")).withColumnRenamed("id", key)
    keys = ["place", "order", "uid"]
    drawn = (F.col("n_words") >= least_words) & up_to(keys, kth_key(able, keys, k))
    ranked = numbered(rows.where(drawn), [F.col(c) for c in keys], "rank").withColumn("rank", F.col("rank") + 1)
    others = rows.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*out, "rank").unionByName(others.select(*out, "rank")).withColumnRenamed("id", key)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 % of all documents, drawn towards the benchmark's texts."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampled(docs, target)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"string_split(trim(regexp_replace({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' ')"

OP11_SQL = f"""with recursive texts as (select false as is_target, doc_id, {_WORDS} as w from documents union all select true, item_id, {_WORDS} from benchmark),
words as (select is_target, doc_id, case when w[1] = '' then [] else w end as w, row_number() over () as row from texts),
runs as (select row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as feature from words),
features as (select feature, row_number() over () as f, hex(encode(feature)) as bytes from (select distinct feature from runs)),
crc_table as (select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as v from range(256) t(i)),
steps as (select f, bytes, 0 as pos, 4294967295::bigint as crc from features
  union all select f, bytes, pos + 1, xor(crc >> 8, v) from steps join crc_table on i = xor(crc & 255, ('0x' || substr(bytes, 2 * pos + 1, 2))::bigint) where 2 * pos < length(bytes)),
hashed as (select feature, xor(crc, 4294967295) % 10000 as bucket from steps join features using (f) where 2 * pos = length(steps.bytes)),
counts as (select bucket, count(*) filter (not is_target) as s, count(*) filter (is_target) as t from runs join words using (row) join hashed using (feature) group by bucket),
totals as (select sum(s)::double as s_all, sum(t)::double as t_all from counts),
gain as (select bucket, floor(1000 * ln((t + 1.0::double) * (s_all + 10000) / ((s + 1.0::double) * (t_all + 10000))))::bigint as gain from counts cross join totals),
weights as (select row, count(*) as n_features, sum(gain)::bigint as weight from runs join hashed using (feature) join gain using (bucket) group by row),
noisy as (select doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint as h from words left join weights using (row) where not is_target),
scored as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score, n_words >= 20 as able from noisy),
ranked as (select *, row_number() over (partition by able order by score desc, doc_id) as place, 5 * count(*) filter (able) over () // 100 as k from scored)
select doc_id, n_features, weight, score, case when able and place <= k then place end as rank from ranked"""
