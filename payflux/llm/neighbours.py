"""Nearest neighbours by a block matrix join with int8 tiles and error bounds.

Queries and candidates are dealt by hash into blocks; each pair of blocks is a tile, computed by
one task at a time: every query meets every candidate, in blocks. A block holds as many vectors as
TILE_COMPONENTS allows, so that few copies are shuffled: a candidate is sent once for each block of
queries. A tile is worked in steps of QUERY_BLOCK by CANDIDATE_BLOCK. Unit vectors are rounded to
int8 with a scale of their own. The product of the int8 matrices is exact (in floats
of 24 bits, whose whole numbers reach past 127 * 127 * 1040; longer vectors take doubles), and
    |cosine - product| <= |q| e_c + e_q |c| + e_q e_c,
|q| and |c| being the lengths of the rounded vectors, e_q and e_c those of what rounding left.
A pair survives unless its upper bound is below the k-th greatest lower bound of its query in
the step, or below the k-th best that earlier steps of the tile found. Survivors are computed again
in double precision from the original vectors, and a heap for each query keeps its k best of the
tile; those of its tiles are merged in Spark. So the result is exact.

A task holds one tile: two blocks of bounded size, however many rows there are. Vectors that are
null, empty, zero or hold null or non-finite components take no part, neither do candidates of
another length than the query. Ties go to the smaller id. Rows with a null id take no part.
Rows with the same id are several candidates, never of their own id; as queries they are one, to
which the nearest of what each of them finds belong. An empty table gives no rows. Other columns
are not used.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from payflux.llm.common import partitions
from payflux.llm.vectors import cosines, matrix, unit_rows, usable

#: Vectors of a step inside a tile.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
#: Components of all vectors of one block of a tile (32 MB as doubles): 65,536 vectors of 64.
TILE_COMPONENTS = 1 << 22
K = 5
TILE = "query_id bigint, vec_id bigint, score double"


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 and a scale; lengths of the rounded ones, and of what is left."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt((back * back).sum(axis=1)), np.sqrt(((x - back) ** 2).sum(axis=1))


def tile_best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The k best candidates of each query in the tile."""
    best: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    kth = np.full(len(q_ids), -np.inf)  # score of the k-th best so far
    steps = [slice(i, i + QUERY_BLOCK) for i in range(0, len(q), QUERY_BLOCK)]
    asked = [rounded(unit_rows(q[s])) for s in steps]
    for start in range(0, len(c), CANDIDATE_BLOCK):
        ids, part = c_ids[start : start + CANDIDATE_BLOCK], c[start : start + CANDIDATE_BLOCK]
        given = rounded(unit_rows(part))
        for s, own in zip(steps, asked, strict=True):
            rows, columns = survivors(own, given, q_ids[s, None] == ids, kth[s], k)
            scores = cosines(q[s][rows], part[columns])
            found, first = np.unique(rows, return_index=True)
            for i, a, b in zip(found + s.start, first, np.append(first, len(rows))[1:], strict=True):
                best[i] = heapq.nsmallest(k, [*best[i], *zip(-scores[a:b], ids[columns[a:b]], strict=True)])
                if len(best[i]) == k:
                    kth[i] = -best[i][-1][0]
    for query, its in zip(q_ids, best, strict=True):
        for score, vec in its:
            yield int(query), int(vec), float(-score)


def survivors(q: tuple[np.ndarray, ...], c: tuple[np.ndarray, ...], own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose upper bound reaches the k-th lower bound of the query, and its floor; in the order of queries."""
    (qi, qs, qn, qe), (ci, cs, cn, ce) = q, c
    whole = np.float32 if qi.shape[1] <= 1040 else np.float64
    product = (qi.astype(whole) @ ci.astype(whole).T).astype(np.float64)
    product *= qs[:, None]
    product *= cs
    bound = qn[:, None] * ce
    bound += qe[:, None] * (cn + ce)
    bound += 1e-12
    product[own] = -np.inf  # its own row is no candidate: both bounds at the bottom
    lower = product - bound
    if lower.shape[1] > k:
        floor = np.maximum(floor, np.partition(lower, -k, axis=1)[:, -k])
    product += bound
    return np.nonzero((product >= floor[:, None]) & ~own)


def _tile(k: int):
    def run(_: tuple, table: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, float]] = []
        is_query = table.column("is_query").to_numpy()
        q, c = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        if q.num_rows and c.num_rows:
            parts = [(x.column("id").to_numpy(), matrix(x.column("v").combine_chunks())) for x in (q, c)]
            rows = list(tile_best(*parts[0], *parts[1], k))
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def nearest(df: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows of each row of df for which is_query holds, itself left out."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("width", F.size("v"))
    n, asking, widest = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max("width"), F.lit(1))).first()
    most = max(1, TILE_COMPONENTS // widest)
    # few rows are dealt out over the cluster all the same: only queries are copied for that
    across, down = max(1, -(-n // most), min(-(-n // CANDIDATE_BLOCK), partitions(df.sparkSession))), max(1, -(-asking // most))
    block = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(of))
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)).cast("array<bigint>"))
    queries = rows.where("asks").select("width", block("query", down).alias("down"), every(across).alias("across"), F.lit(True).alias("is_query"), "id", "v")
    others = rows.select("width", every(down).alias("down"), block("candidate", across).alias("across"), F.lit(False).alias("is_query"), "id", "v")
    tiles = queries.unionByName(others).groupBy("width", "down", "across").applyInArrow(_tile(k), TILE)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every 50th vector, among all rows."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP7_SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= {K}
"""
