"""What several operators share: materialising, tokenising, and sums over ranges of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from payflux.functions.names import unused
from payflux.functions.numbering import materialised

#: A word is a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Words of the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*of: Column) -> Column:
    """A double in [0, 1), drawn from a hash of the arguments: the same in every run."""
    return (F.shiftrightunsigned(F.xxhash64(*of), 11)).cast("double") / F.lit(float(1 << 53))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once: in a plan, a column that is used twice is written twice."""
    return F.transform(F.array(value), f)[0]


def place(*of: Column | str | int) -> Column:
    """A whole number under 2**60, drawn from md5 of the arguments, so that SQL of other engines can draw it too."""
    parts = [p if isinstance(p, Column) else F.lit(str(p)) for p in of]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def place_sql(*of: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(of)})), 1, 15))::bigint"


def row_key(columns: Iterable[Column]) -> Column:
    """md5 of the columns as text, each after its length: rows of equal columns, and only they, have equal keys. Null is a dash without a length."""
    parts = (F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns)
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def row_key_sql(*columns: str) -> str:
    parts = (f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in columns)
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def told_apart(rows: DataFrame, key: str) -> DataFrame:
    """rows, checkpointed, with key|n in place of the key: n numbers the rows of equal key from 0.

    So what is drawn from it depends neither on how files are split nor on the cluster. Where a key repeats,
    its rows are numbered in the part of the table that they come in, after a count of the parts before:
    a key of any size is spread over tasks as its rows were. Without repeats nothing is joined.
    """
    uid, part, before, n, its_key, its_part = unused(rows.columns, "uid", "part", "before", "n", "its_key", "its_part")
    out = [c for c in rows.columns if c != key]
    rows = materialised(rows.withColumn(uid, F.monotonically_increasing_id())).withColumn(part, F.shiftright(uid, 33))
    counts = rows.groupBy(key, part).agg(F.count("*").alias(n))
    repeated = materialised(counts.groupBy(key).agg(F.sum(n).alias(n)).where(F.col(n) > 1).select(F.col(key).alias(its_key)))
    if repeated.isEmpty():
        return rows.select(*out, F.concat(key, F.lit("|0")).alias(key))
    again = counts.join(repeated, counts[key] == repeated[its_key], "left_semi")
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    again = again.select(F.col(key).alias(its_key), F.col(part).alias(its_part), F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    rows = rows.join(again, (rows[key] == again[its_key]) & (rows[part] == again[its_part]), "left")
    inside = F.row_number().over(Window.partitionBy(key, part).orderBy(uid)) - 1
    number = F.when(F.col(before).isNull(), F.lit(0)).otherwise(F.col(before) + inside)
    return rows.select(*out, F.concat_ws("|", F.col(key), number.cast("string")).alias(key))


def with_sums_before(
    df: DataFrame, groups: list[str], cell: str, order: list[Column], values: dict[str, str], cell_order: list[Column] | None = None
) -> DataFrame:
    """Adds, for each (value, name) of values, the sum of value over the rows before this one in its group.

    A group's rows stand in the order of their cells (by cell_order, or by cell), within a cell
    by order. Only the rows of one cell meet in a task, and one row for each cell in that of a
    group; so a group of any size is dealt out, if it has enough cells.
    """
    same = [*groups, cell]
    names = unused(df.columns, *(f"of_{n}" for n in values.values()))
    cells = df.groupBy(*same).agg(*(F.sum(v).alias(n) for v, n in zip(values, names, strict=True)))
    before = Window.partitionBy(*groups).orderBy(*(cell_order or [F.col(cell)])).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*same, *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names))
    inside = Window.partitionBy(*same).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    keys = [df[c].eqNullSafe(cells[c]) for c in same]
    joined = df.join(cells, keys[0] if len(keys) == 1 else _all(keys)).select(df["*"], *(cells[n] for n in names))
    return joined.select(
        *(F.col(c) for c in df.columns),
        *((F.col(n) + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(out) for (v, out), n in zip(values.items(), names, strict=True)),
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


# --- words in numpy -----------------------------------------------------------------------

#: Texts are tokenised together up to this many bytes; a longer text goes alone.
BLOCK_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more entry: the end). Nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(buffers[2]) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_of_words(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in data, and the first word of each text (one more entry: the number of words).

    data: bytes of texts that lie one after the other; bounds: where they begin, and the end. space: which of the 256
    bytes lie between words.
    """
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(space[data], out=inside[1:-1])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    inner = np.unique(bounds[1:-1])
    inner = inner[(inner > 0) & (inner < len(data))]
    if len(inner):  # a word doesn't go on into the next text
        cut = inner[inside[inner] & inside[inner + 1]]
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, bounds)


def hashed_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    lengths = ends - starts
    h = mix64(lengths.astype(np.uint64) + _C1)
    h = mix64(h ^ ((eight[starts] & _MASK[np.minimum(lengths, 8)]) * _C1))
    long = np.flatnonzero(lengths > 8)
    k = 8
    while len(long):
        h[long] = mix64(h[long] ^ ((eight[starts[long] + k] & _MASK[np.minimum(lengths[long] - k, 8)]) * _C1))
        k += 8
        long = long[lengths[long] > k]
    return h


def blocks_of(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The texts in blocks: first and last text (exclusive), bytes, bounds."""
    data, offsets = text_buffers(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most for what runs within, where rows are long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def schema_of(**kinds: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in kinds.items()))
