"""Gapless numbers in a global order without a window over all rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from payflux.functions.names import unused


#: Folders of tables that end with the innermost `temporary_tables`.
_SCOPES: list[list[str]] = []
#: Rows of a group that one task may rank.
MOST_OF_GROUP = 1 << 18


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path in the folder that spark.checkpoint.dir names.

    Only a session on one machine (tests) may leave the folder unset and then gets a temporary one; on a cluster
    executors would each write to their own disk.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    path = f"{context._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end and after a failure too, the intermediate tables that were written within. What is lazy must have been run by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for name in _SCOPES.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialised(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a table in the folder that spark.checkpoint.dir names (see scratch).

    Unlike after checkpoint(), Spark then knows the size of what was written: there it keeps the product of the
    sizes of all that was joined, a number whose digits double with each join of results of joins.
    """
    path = scratch(df.sparkSession)
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # names may be equal but for their case
    plain.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a result of materialised() that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles():
        path = context._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, False)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the place of each row, from 0, in this order.

    Rows are range-partitioned and sorted, and fixed by a checkpoint; then the rows of each
    partition are counted, and sums over the partitions (one row for each) give each its start.
    """
    mark, part, before = unused(df.columns, "mark", "part", "before")
    rows = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rows = materialised(rows.withColumn(mark, F.monotonically_increasing_id()))
    rows = rows.withColumn(part, F.shiftright(mark, 33))
    starts = rows.groupBy(F.col(part).alias("its_part")).agg(F.count("*").alias("n"))
    starts = starts.select("its_part", F.coalesce(F.sum("n").over(Window.orderBy("its_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    rows = rows.join(F.broadcast(starts), rows[part] == starts["its_part"])
    inside = F.col(mark).bitwiseAND((1 << 33) - 1)
    return rows.select(*df.columns, (F.col(before) + inside).cast("long").alias(name))


def numbered_by_group(df: DataFrame, group: str, order: list[Column], name: str, most: int = MOST_OF_GROUP) -> DataFrame:
    """df with the place of each row, from 0, in the order of group (no nulls), and of these within a group.

    Only groups and their sizes are range-partitioned and sorted; rows meet the start of their group by its key, as in a join
    by it that made them, and are ranked within it. Where a group has more than `most` rows, all rows are sorted instead.
    df is read twice.
    """
    mark, part, size, before, start, key = unused(df.columns, "mark", "part", "size", "before", "start", "key")
    sizes = df.groupBy(F.col(group).alias(key)).agg(F.count("*").alias(size))
    sizes = sizes.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
    sizes = materialised(sizes.withColumn(mark, F.monotonically_increasing_id())).withColumn(part, F.shiftright(mark, 33))
    if (sizes.agg(F.max(size)).first()[0] or 0) > most:
        return numbered(df, [F.col(group), *order], name)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy(F.col(part).alias("its_part")).agg(F.sum(size).alias("n"))
    parts = parts.select("its_part", F.coalesce(F.sum("n").over(earlier(Window.orderBy("its_part"))), F.lit(0)).alias(before))
    inside = F.coalesce(F.sum(size).over(earlier(Window.partitionBy(part).orderBy(mark))), F.lit(0))
    starts = sizes.select(key, part, inside.alias(start)).join(F.broadcast(parts), F.col(part) == F.col("its_part")).select(key, (F.col(start) + F.col(before)).alias(start))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.join(starts, F.col(group) == F.col(key)).select(*df.columns, (F.col(start) + rank - 1).cast("long").alias(name))


def numbered_as_read(df: DataFrame, name: str) -> DataFrame:
    """df, read from text files, with the place of each row, from 0, in the order of the files' paths and of the rows in them.

    Files are read in splits, each of them whole and in order by one task. So a row's place in its split is known from the
    split's first row, and sums over the splits (a row for each) give each its start: rows are not sorted, and not shuffled
    either while the table of splits is small enough for Spark to broadcast it.
    """
    mark, path, start, first, before, n = unused(df.columns, "mark", "path", "start", "first", "before", "n")
    rows = materialised(df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.file_block_start").alias(start), F.monotonically_increasing_id().alias(mark)))
    splits = rows.groupBy(path, start).agg(F.min(mark).alias(first), F.count("*").alias(n))
    splits = splits.withColumn(before, F.coalesce(F.sum(n).over(Window.orderBy(path, start).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    splits = materialised(splits.select(F.col(path).alias("its_path"), F.col(start).alias("its_start"), first, before))
    joined = rows.join(splits, (rows[path] == splits["its_path"]) & (rows[start] == splits["its_start"]))
    return joined.select(*(rows[c] for c in df.columns), (F.col(before) + F.col(mark) - F.col(first)).cast("long").alias(name))
