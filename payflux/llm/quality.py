"""Quality classifier: a byte-level convolutional network in numpy.

Filters over WINDOW bytes slide over every position of the text; a chunk is CHUNK cells of CELL
bytes, and chunks overlap by half, so the whole text is covered, whatever its length. Rectified
outputs are max-pooled over each chunk; a small layer turns them into the chunk's badness, and
the mean and the maximum over all chunks into one probability that the label is 1.

Byte embeddings, filters and layers are learned in one task, by Adam, from a bounded sample of
whole texts of any length: the labelled rows whose hashes are least, at most `sample` of them, and
in their order no more once they hold `sample_bytes` bytes together. Only rows outside the held-out third (crc32 of the id as text, modulo 3, is 1) are used, and of them
text and label alone. Scoring reads whole texts of all documents in Arrow batches, without a
shuffle; the weights (under 100 KB) travel with the function.

Null and empty texts get the score of an empty text. A null id is not held out. Labels that are
null or neither 0 nor 1, and labelled rows whose text is null, are not learned from; without two classes the score is the share of 1
(0.5 without labels). Several labels of an id are several examples. Equal rows get equal scores.
An empty table gives no rows. Other columns are returned as they are.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payflux.llm.common import blocks_of, ranges, unused

WINDOW, CELL, CHUNK, STEP = 6, 64, 4, 2
EMBEDDED, FILTERS, HIDDEN = 8, 32, 16
#: Labelled rows that are learned from at most, and bytes of all their texts together.
SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
STEPS, BATCH, RATE = 500, 48, 0.01

Weights = dict[str, np.ndarray]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def padded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each with WINDOW - 1 zeros before it and zeros to full cells behind it, and cells of each text.

    A window that starts in a text's cells so ends before the next text's first byte.
    """
    lengths = np.diff(bounds)
    cells = -(-(lengths + WINDOW - 1) // CELL)
    out = np.zeros(int(cells.sum()) * CELL + WINDOW, np.uint8)
    at = (np.cumsum(cells) - cells) * CELL
    out[ranges(at + WINDOW - 1, lengths)] = data
    return out, cells


def pooled_cells(data: np.ndarray, w: Weights, places: np.ndarray | None = None) -> np.ndarray:
    """Greatest output of each filter in each cell, and into places, if given, where in the cell it is; a few cells at a time."""
    tables = [np.ascontiguousarray(w["embedding"] @ w["filters"][j], np.float32) for j in range(WINDOW)]
    n = len(data) - WINDOW
    out = np.empty((n // CELL, FILTERS), np.float32)
    step = CELL * 64  # what is added up stays in the processor's cache
    total, more = np.empty((step, FILTERS), np.float32), np.empty((step, FILTERS), np.float32)
    for i in range(0, n, step):
        m = min(step, n - i)
        np.take(tables[0], data[i : i + m], axis=0, out=total[:m], mode="clip")  # bytes are never outside
        for j in range(1, WINDOW):
            total[:m] += np.take(tables[j], data[i + j : i + j + m], axis=0, out=more[:m], mode="clip")
        cells, at = total[:m].reshape(-1, CELL, FILTERS), slice(i // CELL, (i + m) // CELL)
        if places is None:
            out[at] = cells.max(axis=1)
        else:
            best = cells.argmax(axis=1)
            places[at], out[at] = best, np.take_along_axis(cells, best[:, None, :], 1)[:, 0, :]
    return out


def chunks_of(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last cell (exclusive) of each chunk, and the first chunk of each text."""
    first_cell = np.cumsum(cells) - cells
    count = 1 + -(-np.maximum(cells - CHUNK, 0) // STEP)
    text = np.repeat(np.arange(len(cells)), count)
    start = np.minimum(ranges(np.zeros(len(cells), np.int64), count) * STEP, np.maximum(cells[text] - CHUNK, 0)) + first_cell[text]
    return start, np.minimum(start + CHUNK, (first_cell + cells)[text]), np.cumsum(count) - count


def _over_chunks(cells: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = cells[start]
    for k in range(1, CHUNK):
        out = np.maximum(out, cells[np.minimum(start + k, end - 1)])
    return out


def badness(pooled: np.ndarray, first: np.ndarray, w: Weights) -> tuple[np.ndarray, ...]:
    """Of each text, from its chunks; with what the gradient needs."""
    x = np.maximum(pooled + w["bias"], 0)
    h = np.maximum(x @ w["hidden"] + w["hidden_bias"], 0)
    z = h @ w["out"] + w["out_bias"]
    counts = np.diff(np.append(first, len(z)))
    mean, top = np.add.reduceat(z, first) / counts, np.maximum.reduceat(z, first)
    return w["mix"][0] * mean + w["mix"][1] * top, x, h, z, mean, top, counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def scores(data: np.ndarray, bounds: np.ndarray, w: Weights) -> np.ndarray:
    """The probability of label 1 of each text."""
    if "constant" in w:
        return np.full(len(bounds) - 1, w["constant"])
    text, cells = padded(data, bounds)
    start, end, first = chunks_of(cells)
    pooled = _over_chunks(pooled_cells(text, w), start, end)
    return sigmoid(-badness(pooled, first, w)[0].astype(np.float64))


def start_weights(rng: np.random.Generator) -> Weights:
    normal = lambda *shape, by: (rng.standard_normal(shape) / np.sqrt(by)).astype(np.float32)
    return {
        "embedding": normal(256, EMBEDDED, by=1),
        "filters": normal(WINDOW, EMBEDDED, FILTERS, by=WINDOW * EMBEDDED),
        "bias": np.full(FILTERS, -1.0, np.float32),
        "hidden": normal(FILTERS, HIDDEN, by=FILTERS / 2),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": normal(HIDDEN, by=HIDDEN),
        "out_bias": np.zeros(1, np.float32),
        "mix": np.array([0.5, 0.5], np.float32),
    }


def gradient(data: np.ndarray, cells: np.ndarray, y: np.ndarray, w: Weights) -> Weights:
    """Of the mean log loss. Only the position that a filter's maximum comes from gets its gradient."""
    best = np.empty(((len(data) - WINDOW) // CELL, FILTERS), np.uint8)
    by_cell = pooled_cells(data, w, best)
    start, end, first = chunks_of(cells)
    pooled, at = by_cell[start], np.repeat(start[:, None], FILTERS, axis=1)
    for k in range(1, CHUNK):
        cell = np.minimum(start + k, end - 1)
        higher = by_cell[cell] > pooled
        pooled = np.where(higher, by_cell[cell], pooled)
        at = np.where(higher, cell[:, None], at)
    bad, x, h, z, mean, top, counts = badness(pooled, first, w)
    d = ((1 - y) * -sigmoid(-bad) + y * sigmoid(bad)).astype(np.float32) / len(y)
    text = np.repeat(np.arange(len(y)), counts)
    is_top = z == top[text]
    is_top = is_top / np.add.reduceat(is_top.astype(np.float32), first)[text]
    dz = (d * w["mix"][0] / counts)[text] + (d * w["mix"][1])[text] * is_top
    dh = np.outer(dz, w["out"]) * (h > 0)
    dx = (dh @ w["hidden"].T) * (x > 0)
    position = at * CELL + best[at, np.arange(FILTERS)]
    g_tables = [np.zeros((256, FILTERS), np.float32) for _ in range(WINDOW)]
    flat = np.arange(FILTERS)[None, :]
    for j in range(WINDOW):
        g_tables[j] = np.bincount((data[position + j].astype(np.int64) * FILTERS + flat).ravel(), dx.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return {
        "embedding": sum(g @ w["filters"][j].T for j, g in enumerate(g_tables)),
        "filters": np.stack([w["embedding"].T @ g for g in g_tables]),
        "bias": dx.sum(axis=0),
        "hidden": x.T @ dh,
        "hidden_bias": dh.sum(axis=0),
        "out": h.T @ dz,
        "out_bias": np.array([dz.sum()]),
        "mix": np.array([(d * mean).sum(), (d * top).sum()]),
    }


def fitted(texts: list[bytes], labels: np.ndarray, seed: int = 0) -> Weights:
    """Weights by Adam, with a rate that falls to nothing; texts are drawn anew for each step."""
    if len(labels) == 0 or labels.min() == labels.max():
        return {"constant": np.float64(labels.mean() if len(labels) else 0.5)}
    rng = np.random.default_rng(seed)
    w = start_weights(rng)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for step in range(STEPS):
        pick = rng.integers(0, len(texts), BATCH)
        lengths = np.array([len(texts[i]) for i in pick])
        data, cells = padded(np.frombuffer(b"".join(texts[i] for i in pick), np.uint8), np.concatenate([[0], np.cumsum(lengths)]))
        g = gradient(data, cells, labels[pick], w)
        rate = RATE * (1 + np.cos(np.pi * step / STEPS)) / 2
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k] / (1 - 0.999 ** (step + 1))) + 1e-8)).astype(np.float32)
    return w


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Weights:
    """Weights learned from docs (doc_id, text) and labels (doc_id, quality).

    The sample is drawn among the labels; so it is small, and texts are not shuffled to find theirs.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("its_id"), "quality")
    known = known.orderBy(F.xxhash64("its_id"), "its_id", "quality").limit(sample)
    rows = docs.join(F.broadcast(known), docs["doc_id"] == known["its_id"]).where(F.col("text").isNotNull()).select("its_id", "text", "quality")
    rows = rows.orderBy(F.xxhash64("its_id"), "its_id", F.xxhash64("text"), "quality").limit(sample).select("text", "quality").coalesce(1)
    packed = rows.mapInArrow(_fit(sample_bytes), "weights binary").first()
    return dict(np.load(io.BytesIO(packed[0]))) if packed else fitted([], np.zeros(0))


def _fit(sample_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, left = [], [], sample_bytes
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("quality"), strict=True):
                if left > 0:
                    texts.append(text.as_py().encode())
                    labels.append(label.as_py())
                    left -= len(texts[-1])
        out = io.BytesIO()
        np.savez(out, **fitted(texts, np.array(labels, np.float64)))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["weights"])

    return run


def _scored(w: Weights, at: int, shown: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, bounds in blocks_of(batch.column(at), 1 << 18):
                out[i:j] = scores(data, bounds, w)
            yield pa.RecordBatch.from_arrays([*batch.columns[:shown], pa.array(out)], names=[*batch.schema.names[:shown], "score"])

    return run


def score(docs: DataFrame, weights: Weights, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """docs (or its columns keep) with score."""
    keep = docs.columns if keep is None else keep
    (out,) = unused(keep, "score")
    rows = docs.select(*keep, *([] if text in keep else [text]))
    plain = [f"c{k}" for k in range(len(rows.columns))]
    ddl = ", ".join([*(f"{p} {k}" for p, (_, k) in zip(plain, rows.dtypes[: len(keep)], strict=False)), "score double"])
    return rows.toDF(*plain).mapInArrow(_scored(weights, rows.columns.index(text), len(keep)), ddl).toDF(*keep, out)


def good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs whose score reaches the threshold, by a network that learned from them and the labels."""
    scored = score(docs, learned(docs.select("doc_id", "text"), labels))
    return scored.where(F.col(scored.columns[-1]) >= threshold).select(*docs.columns)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a score, by a network that learned from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = score(docs, weights, keep=["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
