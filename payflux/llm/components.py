"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payflux.functions.numbering import materialised
from payflux.llm.common import partitions

#: Rounds grow as the logarithm of the longest path; so many are never needed.
MOST_ROUNDS = 64
#: A node with fewer edges is never dealt out over tasks.
HUB = 64


def dealt(both: DataFrame, edges: int) -> tuple[DataFrame, DataFrame]:
    """both (u, v; so many rows at most) with salt, and u, salt and m: the least v of each u. Joined on u and salt, no task gets a hub whole.

    A hub has more than a mean share of all edges, so there are fewer hubs than partitions, and they can be broadcast.
    Their edges are dealt out by the other end, and their least neighbour is sent to each part.
    """
    parts = partitions(both.sparkSession)
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))  # one shuffle, for both uses
    share = max(HUB, -(-edges // parts))
    pieces = F.least(F.ceil(F.col("n") / share), F.lit(parts)).cast("int")
    hubs = least.where(F.col("n") > share).select(F.col("u").alias("hub"), pieces.alias("pieces"))
    salted = both.join(F.broadcast(hubs), both["u"] == hubs["hub"], "left")
    salted = salted.select("u", "v", F.coalesce(F.pmod(F.xxhash64("v"), F.col("pieces")), F.lit(0)).cast("int").alias("salt"))
    each = F.when(F.col("n") > share, F.sequence(F.lit(0), pieces - 1)).otherwise(F.array(F.lit(0)))
    return salted, least.select(F.col("u").alias("its_u"), F.explode(each).alias("its_salt"), "m")


def _stars(both: DataFrame, edges: int) -> DataFrame:
    """both (u, v) with the least of u and its neighbours v."""
    salted, least = dealt(both, edges)
    joined = salted.join(least, (salted["u"] == least["its_u"]) & (salted["salt"] == least["its_salt"]))
    return joined.select("u", "v", F.least("m", "u").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v: whole numbers) -> id, component: for each end of an edge the least number that it is connected with.

    Large stars and small stars in turn until nothing changes: each node ends up linked to the
    least of its component alone. Each round is written to a table; the driver sees counts and a
    checksum. Loops and repeated edges do no harm. No edges give no rows.
    """
    now = materialised(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    look = lambda: tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    state = look()
    for _ in range(MOST_ROUNDS if state[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # one row for each edge; what repeats goes at the end of the round
        large = _stars(both, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _stars(large, state[0])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = materialised(small.where("u <> v").distinct())
        before, state = state, look()
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
