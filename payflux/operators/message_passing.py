"""Graph convolution and attention as joins and groupings; dense layers in Arrow batches.

States are (node_id, h: array of doubles). Messages travel along edges from src_id to dst_id.
Loops among the edges are replaced by one for each node. The projected states of a layer are
written to a table, which all its steps read: a plan begins at the layer before, so that plans grow
in proportion to the layers. A shuffle carries projected vectors only; sums over the vectors of a node's neighbours are partial before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payflux.functions.hubs import with_node_values
from payflux.functions.numbering import materialised
from payflux.functions.vectors import activation, layer_norm
from payflux.operators.graph import inverse_sqrt


@dataclass
class Layer:
    """kind: gat, gcn or linear. w: [in, heads * out]; bias: [heads * out], or [out] if heads are averaged.

    a_src, a_dst: [heads, out], of attention only. concat: whether heads are joined or averaged.
    """

    kind: str
    w: np.ndarray
    bias: np.ndarray
    a_src: np.ndarray | None = None
    a_dst: np.ndarray | None = None
    concat: bool = True
    activation: str | None = None
    slope: float = 0.25
    norm: str | None = None

    @property
    def heads(self) -> int:
        return 1 if self.a_src is None else len(self.a_src)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def projected(states: DataFrame, w: np.ndarray, bias: np.ndarray | None = None, column: str = "h") -> DataFrame:
    """node_id and h @ w (+ bias): one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = matrix(batch.column(1)) @ w if batch.num_rows else np.zeros((0, w.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(out if bias is None else out + bias)], names=["node_id", "h"])

    return states.select("node_id", F.col(column).alias("h")).mapInArrow(run, "node_id bigint, h array<double>")


def with_loops(edges: DataFrame, states: DataFrame) -> DataFrame:
    """src_id and dst_id of all edges but loops, and one loop for each node."""
    own = states.select(F.col("node_id").alias("src_id"), F.col("node_id").alias("dst_id"))
    return edges.where("src_id <> dst_id").select("src_id", "dst_id").unionByName(own)


def summed(messages: DataFrame, width: int) -> DataFrame:
    """node_id and the sum of m, component by component, with map-side sums."""
    sums = messages.groupBy("node_id").agg(*(F.sum(F.col("m")[k]).alias(f"s{k}") for k in range(width)))
    return sums.select("node_id", F.array(*(f"s{k}" for k in range(width))).alias("h"))


def _degrees(links: DataFrame) -> DataFrame:
    """node_id, leaving and ending: how many links a node has at either end."""
    out, into = (links.groupBy(F.col(c).alias("node_id")).agg(F.count("*").alias(n)) for c, n in (("src_id", "leaving"), ("dst_id", "ending")))
    return out.join(into, "node_id")  # each node has its loop


def convolved(states: DataFrame, edges: DataFrame, layer: Layer) -> DataFrame:
    """Sum of neighbours' projections, weighted by the inverse roots of both in-degrees (loops counted). Hubs' links are not brought together."""
    width = layer.w.shape[1]
    z = projected(states, layer.w)
    links = with_loops(edges, states)
    known = _degrees(links).withColumn("d", inverse_sqrt(F.col("ending")))
    source = materialised(z.join(known, "node_id").select("node_id", F.transform("h", lambda x: x * F.col("d")).alias("m"), "leaving", "d"))
    total = summed(with_node_values(links, "src_id", source, ["m"], "leaving").select(F.col("dst_id").alias("node_id"), "m"), width)
    return finished(total.join(source, "node_id").select("node_id", F.transform("h", lambda x: x * F.col("d")).alias("h")), layer)


def _dots(h: Column, a: np.ndarray, head: int) -> Column:
    out = a.shape[1]
    return sum((h[head * out + k] * float(a[head, k]) for k in range(out)), F.lit(0.0))


def coefficients(z: DataFrame, edges: DataFrame, layer: Layer, slope: float = 0.2) -> DataFrame:
    """src_id, dst_id and alpha (one for each head): attention, a softmax over the edges into a node. z: projected states, a table.

    The greatest logit is subtracted first. Logits, maxima and normalisers of hubs are broadcast; sums and maxima are partial before
    they are shuffled, so a hub's edges need not meet in one task.
    """
    links = with_loops(edges, z)
    logits = z.select("node_id", *(F.array(*(_dots(F.col("h"), a, k) for k in range(layer.heads))).alias(n) for n, a in (("l_src", layer.a_src), ("l_dst", layer.a_dst))))
    known = materialised(logits.join(_degrees(links), "node_id"))
    leaky = activation("leaky_relu")
    e = with_node_values(with_node_values(links, "src_id", known, ["l_src"], "leaving"), "dst_id", known, ["l_dst"], "ending")
    e = materialised(e.select("src_id", "dst_id", F.zip_with("l_src", "l_dst", lambda a, b: leaky(a + b, slope)).alias("e")))
    top = materialised(e.groupBy("dst_id").agg(F.count("*").alias("ending"), F.array(*(F.max(F.col("e")[k]) for k in range(layer.heads))).alias("top")))
    e = with_node_values(e, "dst_id", top, ["top"], "ending", "dst_id").select("src_id", "dst_id", F.zip_with("e", "top", lambda a, b: F.exp(a - b)).alias("e"))
    total = materialised(e.groupBy("dst_id").agg(F.count("*").alias("ending"), F.array(*(F.sum(F.col("e")[k]) for k in range(layer.heads))).alias("total")))
    return with_node_values(e, "dst_id", total, ["total"], "ending", "dst_id").select("src_id", "dst_id", F.zip_with("e", "total", lambda a, b: a / b).alias("alpha"))


def attended(states: DataFrame, edges: DataFrame, layer: Layer, slope: float = 0.2) -> DataFrame:
    """Sum of neighbours' projections, weighted by attention; heads joined or averaged."""
    width, heads = layer.w.shape[1], layer.heads
    out = width // heads
    z = materialised(projected(states, layer.w))
    leaving = with_loops(edges, z).groupBy(F.col("src_id").alias("node_id")).agg(F.count("*").alias("leaving"))
    source = materialised(z.join(leaving, "node_id").select("node_id", F.col("h").alias("z"), "leaving"))
    weighed = with_node_values(coefficients(z, edges, layer, slope), "src_id", source, ["z"], "leaving")
    m = F.transform("z", lambda x, i: x * F.get(F.col("alpha"), F.floor(i / out).cast("int")))
    total = summed(weighed.select(F.col("dst_id").alias("node_id"), m.alias("m")), width)
    if not layer.concat and heads > 1:
        total = total.select("node_id", F.array(*(sum((F.col("h")[k * out + j] for k in range(heads)), F.lit(0.0)) / heads for j in range(out))).alias("h"))
    return finished(total, layer)


def batch_norm(states: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Each component with mean 0 and population variance 1 over all nodes."""
    width = len(states.select("h").first()[0])
    stats = states.agg(F.array(*(F.avg(F.col("h")[k]) for k in range(width))).alias("mean"), F.array(*(F.var_pop(F.col("h")[k]) for k in range(width))).alias("var"))
    scaled = F.transform("h", lambda x, i: (x - F.get("mean", i)) / F.sqrt(F.get("var", i) + eps))
    return states.crossJoin(F.broadcast(stats)).select("node_id", scaled.alias("h"))


def finished(states: DataFrame, layer: Layer) -> DataFrame:
    """Bias, norm and activation."""
    bias = F.array(*(F.lit(float(b)) for b in layer.bias))
    states = states.select("node_id", F.zip_with("h", bias, lambda a, b: a + b).alias("h"))
    if layer.norm == "layernorm":
        states = states.select("node_id", layer_norm(F.col("h")).alias("h"))
    elif layer.norm == "batchnorm":
        states = batch_norm(states)
    act = activation(layer.activation)
    slope = (layer.slope,) if layer.activation in ("prelu", "leaky_relu") else ()
    return states.select("node_id", F.transform("h", lambda x: act(x, *slope)).alias("h"))


def applied(states: DataFrame, edges: DataFrame, layer: Layer) -> DataFrame:
    if layer.kind == "gat":
        return attended(states, edges, layer)
    if layer.kind == "gcn":
        return convolved(states, edges, layer)
    if layer.kind == "linear":
        return finished(projected(states, layer.w), layer)
    raise ValueError(f"unknown layer: {layer.kind}")
