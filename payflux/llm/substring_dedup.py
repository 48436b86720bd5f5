"""Removal of passages that an earlier document has, by a compressed FM-index for each shard.

A window is LENGTH consecutive words. The least of the hashes of its 5-grams, the leftmost if
several, is its anchor: windows of equal words have equal anchors. Neighbouring windows mostly
share one; such a run of windows with its words is a segment.

1. Anchors of all documents are dealt out by hash. Those that only one document has are dropped,
   with all their windows. Of each batch of documents an anchor is sent for one or two; where
   several documents of the batch have it, that is known already.
2. The segments of the other anchors are dealt out to shards by the anchor, so equal windows meet
   in a shard. Of each batch, the text of equal segments is sent once, with the places of all; of
   many copies most go in chunks to other shards, each led by the one of the least document.
3. Each shard builds an FM-index over its different segments and streams their words through it: one
   pass of backward search gives the matching statistics, how far the words from each place on occur
   elsewhere. Where that is a window or more, the window belongs to the least document that has it.
4. Intervals of removed words go back to their documents.

So the inside of a passage that a third of all documents have is a few rows for each batch. The
segments at its edges hold each document's own words too and all differ. Therefore anchors are
counted first: segments of those with more than a sixteenth of a shard's mean share (hot ones) are
cut into their windows, and these are dealt out by the hash of their words. Equal windows still
meet, and others of the same anchor do not. Shards are as many as shuffle partitions times four,
or as the words ask for (SHARD_WORDS), if that is more. Texts are compared by 64-bit hashes of each of the 13 words.

Windows are judged on the input. Null texts and those of fewer words lose nothing. A null id
counts as less than any other; rows with the same id don't remove each other's words. Equal rows
give equal results. An empty table gives no rows. Other columns are returned as they are; added
ones get underscores in front if their names are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payflux.llm.common import blocks_of, hashed_words, mix64, partitions, ranges, spans_of_words, unused
from payflux.llm.exact_dedup import BLOCK_BITS
from payflux.llm.fm_index import FMIndex

LENGTH, GRAM = 13, 5
NULL_ID = -(1 << 63)
#: Words of the input for each shard, at most, on average.
SHARD_WORDS = 2 << 20
#: Hot anchors have so many segments at least; those with fewer than COUNTED in a block of texts are not counted there.
HOT, COUNTED = 1024, 4
#: Bytes that the filter of hot anchors may have, whatever the corpus, and its bits for each anchor that can be hot.
MOST_FILTER, BITS_PER_HOT = 16 << 20, 64
#: So many copies of a segment in a batch go to its shard; more of them in chunks of COPIES to other shards, each with the text.
TOGETHER, COPIES = 64, 1024
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
FOUND = "known boolean, bucket int, anchor array<int>, doc array<int>, pos array<int>, ids array<bigint>, rids array<bigint>"
SEGMENTS = "shard int, texts binary, lengths array<int>, owner array<int>, pos array<int>, ids array<bigint>, rids array<bigint>"
PLACES = "id bigint, rid bigint, pos array<int>"
REMOVED = "id bigint, rid bigint, starts array<int>, ends array<int>"


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment: the document, the anchor's hash and place, its first and last window. first: where each document's words begin, and the end."""
    n, width = len(words), LENGTH - GRAM + 1
    windows = np.maximum(np.diff(first) - LENGTH + 1, 0)
    at = ranges(first[:-1], windows)
    if not len(at):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams = mix64(grams + words[k : n - GRAM + 1 + k])
    least, reach = grams, 1
    while 2 * reach <= width:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    least = np.minimum(least[: len(grams) - width + 1], least[width - reach : len(grams) - reach + 1])[at]
    place = np.zeros(len(at), np.int64)
    for k in range(width - 1, -1, -1):
        place = np.where(grams[at + k] == least, at + k, place)
    doc = np.repeat(np.arange(len(windows)), windows)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    return doc[new], least[new], place[new], at[new], at[last]


def _lists(values: np.ndarray, edges: np.ndarray, kind: type) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(np.ascontiguousarray(values, kind)))


def _find(buckets: int):
    """Anchors of a batch: those that two of its documents have, as known; all, dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids = batch.column("id").to_numpy(), batch.column("rid").to_numpy()
            parts = []
            for i, _, data, bounds in blocks_of(batch.column("text")):
                starts, ends, first = spans_of_words(data, bounds)
                doc, anchor, place, _, _ = anchors(hashed_words(data, starts, ends), first)
                parts.append((doc + i, anchor, (place - first[doc]).astype(np.int32)))
            if not parts or not sum(len(x[0]) for x in parts):
                continue
            doc, anchor, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((ids[doc], anchor))
            doc, anchor, pos = doc[order], anchor[order], pos[order]
            new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            count = np.diff(np.append(new, len(anchor)))
            shared = ids[doc[new]] < ids[doc[new + count - 1]]
            # sent on: all places of an anchor in one document; of a shared one those in the least and the greatest
            sent = np.repeat(~shared, count)
            sent[new] = sent[new + count - 1] = True
            yield _dealt(False, (anchor[sent] >> np.uint64(32)) % np.uint64(buckets), anchor[sent], doc[sent], pos[sent], ids, rids)
            known = np.flatnonzero(np.repeat(shared, count))
            if len(known):
                # by document, so that they are spread over the buckets
                yield _dealt(True, mix64(rids[doc[known]].view(np.uint64)) % np.uint64(buckets), anchor[known], doc[known], pos[known], ids, rids)

    return run


def _dealt(known: bool, bucket: np.ndarray, anchor: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket, anchor, doc, pos = bucket[order], anchor[order], doc[order], pos[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    columns = [pa.array(np.full(len(edges) - 1, known)), pa.array(bucket[edges[:-1]].astype(np.int32))]
    named, local, named_edges = [], np.empty(len(doc), np.int32), [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own, local[a:b] = np.unique(doc[a:b], return_inverse=True)
        named.append(own)
        named_edges.append(named_edges[-1] + len(own))
    own, named_edges = np.concatenate(named), np.array(named_edges)
    columns += [_lists(anchor.astype(np.uint32).view(np.int32), edges, np.int32), _lists(local, edges, np.int32), _lists(pos, edges, np.int32)]
    columns += [_lists(ids[own], named_edges, np.int64), _lists(rids[own], named_edges, np.int64)]
    return pa.RecordBatch.from_arrays(columns, names=["known", "bucket", "anchor", "doc", "pos", "ids", "rids"])


def _joined(rows: pa.Table, *names: str) -> list[np.ndarray]:
    """Lists of the rows, one after the other; docs are numbered through (the last two: ids, rids)."""
    rows = rows.combine_chunks()
    out = [rows.column(n).chunk(0).flatten().to_numpy() for n in (*names, "ids", "rids")]
    own = np.diff(rows.column("ids").chunk(0).offsets.to_numpy())
    each = np.diff(rows.column(names[0]).chunk(0).offsets.to_numpy())
    out[0] = out[0] + np.repeat(np.cumsum(own) - own, each)
    return out


def _by_document(names: list[str], ids: np.ndarray, rids: np.ndarray, doc: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """A row for each (id, rid) with lists of its values. doc: indices into ids and rids."""
    order = np.lexsort((rids[doc], ids[doc]))
    i, r = ids[doc[order]], rids[doc[order]]
    edges = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (r[1:] != r[:-1]), [True]])) if len(doc) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(i[edges[:-1]]), pa.array(r[edges[:-1]]), *(_lists(v[order], edges, np.int32) for v in values)], names=names)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by key: those of one value together."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        edges = np.flatnonzero(np.diff(rest.column(key).to_numpy())) + 1
        for a, b in zip([0, *edges[:-1]], edges, strict=False):
            yield rest.slice(a, b - a)
        if len(edges):
            rest = rest.slice(edges[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the anchors that several documents have."""
    names = ["id", "rid", "pos"]
    for rows in _grouped(batches, "bucket"):
        known = rows.column("known").to_numpy()
        if known.any():
            doc, pos, ids, rids = _joined(rows.filter(pa.array(known)), "doc", "pos")
            yield _by_document(names, ids, rids, doc, pos)
        if not known.all():
            doc, pos, anchor, ids, rids = _joined(rows.filter(pa.array(~known)), "doc", "pos", "anchor")
            order = np.argsort(anchor, kind="stable")
            doc, pos, anchor = doc[order], pos[order], anchor[order]
            new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            shared = np.minimum.reduceat(ids[doc], new) < np.maximum.reduceat(ids[doc], new)
            shared = np.repeat(shared, np.diff(np.append(new, len(anchor))))
            yield _by_document(names, ids, rids, doc[shared], pos[shared])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of each frequent anchor; of a null one, all segments and words."""
    for batch in batches:
        for _, _, data, bounds in blocks_of(batch.column("text")):
            starts, ends, first = spans_of_words(data, bounds)
            found, n = np.unique(anchors(hashed_words(data, starts, ends), first)[1], return_counts=True)
            total, often = int(n.sum()), n >= COUNTED
            columns = [pa.array([None, *found[often].view(np.int64).tolist()], pa.int64()), pa.array([total, *n[often].tolist()], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(starts)] + [0] * int(often.sum()), pa.int64())], names=["anchor", "n", "words"])


def hot_anchors(rows: DataFrame, least: int = HOT) -> tuple[int, np.ndarray]:
    """How many shards to deal to, and a filter (see `in_filter`) of the anchors with more than a sixteenth of the mean segments of one (and least).

    Spark puts the bits together, in blocks of 2**15. The filter grows with the shards up to MOST_FILTER bytes; beyond, more
    anchors are cut that needn't be, which changes no result: all tasks cut the same ones.
    """
    counts = rows.select("text").mapInArrow(_count, "anchor bigint, n bigint, words bigint").groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    counts = counts.persist()
    try:
        total = counts.where("anchor is null").first()
        shards = max(4 * partitions(rows.sparkSession), -(-(total["words"] if total else 0) // SHARD_WORDS))
        most = max(least, total["n"] // (16 * shards)) if total else least
        # at most 16 anchors for each shard
        size = min(8 * MOST_FILTER, max(BLOCK_BITS, 1 << (16 * shards * BITS_PER_HOT - 1).bit_length()))
        place = F.col("anchor").bitwiseAND(size - 1)
        hot = counts.where(F.col("anchor").isNotNull() & (F.col("n") > most)).select(F.floor(place / BLOCK_BITS).alias("block"), place.bitwiseAND(BLOCK_BITS - 1).alias("bit"))
        blocks = hot.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap")).toArrow()
    finally:
        counts.unpersist()
    found = np.zeros((size // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for block, bitmap in zip(blocks.column("block").to_pylist(), blocks.column("bitmap").to_pylist(), strict=True):
        found[block] = np.frombuffer(bitmap, np.uint8)
    return shards, found.ravel() if blocks.num_rows else np.zeros(0, np.uint8)


def in_filter(anchor: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which anchors have their bit, that of their low digits, in the filter; an empty one has none."""
    if not len(bits):
        return np.zeros(len(anchor), bool)
    place = anchor & np.uint64(8 * len(bits) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _segments(shards: int, hot: np.ndarray):
    """Segments of the shared anchors of a batch, dealt out to shards; of equal ones that of the least document.

    Those of anchors in the filter of hot ones are cut into windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids = batch.column("id").to_numpy(), batch.column("rid").to_numpy()
            for i, j, data, bounds in blocks_of(batch.column("text"), 8 << 20):
                starts, ends, first = spans_of_words(data, bounds)
                words = hashed_words(data, starts, ends)
                doc, anchor, place, low, high = anchors(words, first)
                lists = batch.column("pos").slice(i, j - i)
                wanted = lists.flatten().to_numpy().astype(np.int64)
                of = np.repeat(np.arange(j - i), np.diff(lists.offsets.to_numpy()))
                mine = np.isin(place, first[of] + wanted)
                doc, anchor, low, high = doc[mine], anchor[mine], low[mine], high[mine] + LENGTH
                if not len(doc):
                    continue
                split = in_filter(anchor, hot)
                n = np.where(split, high - low - LENGTH + 1, 1)
                low, high = ranges(low, n), np.where(np.repeat(split, n), ranges(low, n) + LENGTH, np.repeat(high, n))
                doc, anchor, split = (np.repeat(x, n) for x in (doc, anchor, split))
                size = high - low
                at = ranges(low, size)
                edge = np.cumsum(size) - size
                terms = mix64(words[at] ^ mix64((np.arange(len(at)) - np.repeat(edge, size)).astype(np.uint64) + np.uint64(1)))
                content = mix64(np.add.reduceat(terms, edge) + size.astype(np.uint64))
                own = ids[doc + i]
                order = np.lexsort((own, content))
                anchor = np.where(split, content, anchor)
                doc, anchor, low, high, size, content, own = (x[order] for x in (doc, anchor, low, high, size, content, own))
                new = np.concatenate([[True], content[1:] != content[:-1]])
                head = np.flatnonzero(new)[np.cumsum(new) - 1]
                nth = np.arange(len(head)) - head
                apart = (own != own[head]) & (nth >= TOGETHER)
                k, key = np.flatnonzero(~apart), anchor[~apart]
                fresh = new[k]
                if apart.any():  # many copies: in chunks, each led by the first of them all, to shards of their own
                    c, chunk = np.flatnonzero(apart), nth[apart] // COPIES
                    leads = np.flatnonzero(np.concatenate([[True], (head[c][1:] != head[c][:-1]) | (chunk[1:] != chunk[:-1])]))
                    lead = np.zeros(len(c) + len(leads), bool)
                    lead[leads + np.arange(len(leads))] = True
                    own_key = mix64(content[c] + chunk.astype(np.uint64) * _SPREAD)
                    k = np.concatenate([k, np.insert(c, leads, head[c[leads]])])
                    key, fresh = np.concatenate([key, np.insert(own_key, leads, own_key[leads])]), np.concatenate([fresh, lead])
                shard = (key % np.uint64(shards)).astype(np.int32)
                s = np.argsort(shard, kind="stable")
                k = k[s]
                yield _sent(shard[s], data, starts, ends, doc[k], low[k], high[k], fresh[s], (low - first[doc])[k], ids[i:j], rids[i:j])

    return run


def _sent(shard, data, starts, ends, doc, low, high, new, pos, ids, rids) -> pa.RecordBatch:
    """With the texts of the segments that are new; a length of 0 means the segment before."""
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    texts, locals_, named, named_edges = [], [], [], [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own, local = np.unique(doc[a:b], return_inverse=True)
        locals_.append(local)
        named.append(own)
        named_edges.append(named_edges[-1] + len(own))
        k = np.flatnonzero(new[a:b]) + a
        begin, n = starts[low[k]], ends[high[k] - 1] - starts[low[k]] + 1
        text = data[np.minimum(ranges(begin, n), len(data) - 1)]
        text[np.cumsum(n) - 1] = 10
        texts.append(pa.compress(text.tobytes(), "zstd", asbytes=True) + len(text).to_bytes(8, "little"))
    own, named_edges = np.concatenate(named), np.array(named_edges)
    lengths = (high - low) * new
    columns = [pa.array(shard[edges[:-1]]), pa.array(texts, pa.binary()), *(_lists(x, edges, np.int32) for x in (lengths, np.concatenate(locals_), pos))]
    columns += [_lists(ids[own], named_edges, np.int64), _lists(rids[own], named_edges, np.int64)]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "texts", "lengths", "owner", "pos", "ids", "rids"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is removed from each document for the segments of a shard."""
    names = ["id", "rid", "starts", "ends"]
    for rows in _grouped(batches, "shard"):
        doc, pos, lengths, ids, rids = _joined(rows, "owner", "pos", "lengths")
        texts = [np.frombuffer(pa.decompress(x[:-8], int.from_bytes(x[-8:], "little"), "zstd"), np.uint8) for x in rows.column("texts").to_pylist()]
        data = np.concatenate(texts)
        starts, ends, _ = spans_of_words(data, np.array([0, len(data)]))
        which, start, end = repeats(hashed_words(data, starts, ends), lengths[lengths > 0], np.cumsum(lengths > 0) - 1, ids[doc])
        yield _by_document(names, ids, rids, doc[which], pos[which] + start, pos[which] + end)


def repeats(words: np.ndarray, lengths: np.ndarray, segment: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of words to remove: of which occurrence, from, to.

    words: of the segments of these lengths, one after the other. segment, ids: of each occurrence the segment and the document.
    """
    edge = np.cumsum(lengths) - lengths
    # equal segments are one, with the least document
    place = (np.arange(len(words)) - np.repeat(edge, lengths)).astype(np.uint64)
    content = np.add.reduceat(mix64(words ^ mix64(place + np.uint64(1))), edge) + lengths.astype(np.uint64)
    _, one, same = np.unique(content, return_index=True, return_inverse=True)
    segment = same[segment]
    lengths, edge = lengths[one], edge[one]
    owner = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(owner, segment, ids)
    # ranks of the words from 1, and a 0 after each segment
    alphabet, symbols = np.unique(words[ranges(edge, lengths)], return_inverse=True)
    start = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    text[ranges(start, lengths)] = symbols + 1
    index = FMIndex(text, len(alphabet) + 1, np.repeat(owner, lengths + 1), LENGTH)
    matched, row = index.matching(text, start, lengths)
    windows = lengths - LENGTH + 1
    begin = ranges(start, windows)
    least = np.repeat(owner, windows)
    found = np.flatnonzero(matched[begin] >= LENGTH)
    least[found] = index.least_owner(row[begin[found]], LENGTH)
    # occurrences by windows
    n = windows[segment]
    first = np.cumsum(windows) - windows
    which = np.repeat(np.arange(len(segment)), n)
    gone = least[ranges(first[segment], n)] < ids[which]
    inside = ranges(np.zeros(len(segment), np.int64), n)
    which, inside = which[gone], inside[gone]
    if not len(which):
        return which, inside, inside
    new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (inside[1:] != inside[:-1] + 1)]))
    last = np.append(new[1:], len(which)) - 1
    return which[new], inside[new], inside[last] + LENGTH


def _cut(at: int):
    """Texts without the removed words; how many there were, and how many went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in blocks_of(batch.column(at)):
                starts, ends, first = spans_of_words(data, bounds)
                counts = np.diff(first)
                change = np.zeros(len(starts) + 1, np.int64)
                for name, by in (("starts", 1), ("ends", -1)):
                    outer = batch.column(name).slice(i, j - i).fill_null([])
                    inner = outer.flatten()
                    per = np.add.reduceat(np.append(np.diff(inner.offsets.to_numpy()), 0), np.minimum(outer.offsets.to_numpy()[:-1] - outer.offsets.to_numpy()[0], len(inner))) if len(inner) else np.zeros(j - i, np.int64)
                    per = np.where(np.diff(outer.offsets.to_numpy()) > 0, per, 0)
                    np.add.at(change, np.repeat(first[:-1], per) + inner.flatten().to_numpy(), by)
                stays = np.cumsum(change)[:-1] <= 0
                doc = np.repeat(np.arange(j - i), counts)[stays]
                begin, n = starts[stays], (ends - starts)[stays]
                kept = np.bincount(doc, minlength=j - i)
                # a space after each word but a text's last
                gap = np.ones(len(n), np.int64)
                gap[np.cumsum(kept)[kept > 0] - 1] = 0
                to = np.cumsum(n + gap) - n - gap
                out = np.full(int((n + gap).sum()), 32, np.uint8)
                out[ranges(to, n)] = data[ranges(begin, n)]
                sizes = np.bincount(doc, n + gap, j - i).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                strings = pa.StringArray.from_buffers(j - i, pa.py_buffer(offsets), pa.py_buffer(out))
                rest = batch.slice(i, j - i)
                columns = [strings if k == at else c for k, c in enumerate(rest.columns[:-2])]
                names = batch.schema.names[:-2]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(counts - kept)], names=[*names, "n_words", "n_removed"])

    return run


def _keyed(docs: DataFrame, doc_id: str, text: str, keep: list[str]) -> DataFrame:
    """id and rid (a hash of id and text), which tell documents apart; text; columns kept, as c0, c1, ..."""
    t = F.coalesce(F.col(text), F.lit(""))
    number = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id")
    return docs.select(number, F.xxhash64(F.col(doc_id), t).alias("rid"), t.alias("text"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(keep)))


def removed(rows: DataFrame) -> DataFrame:
    """id, rid -> starts, ends: intervals of words that go, as lists of lists. rows: id, rid, text.

    Other columns of rows are taken along to where texts meet their anchors, so that Spark sees
    the same shuffle there as where texts meet their intervals, and does it once.
    """
    n, hot = hot_anchors(rows)
    found = rows.select("id", "rid", "text").mapInArrow(_find(n), FOUND).repartition("bucket").sortWithinPartitions("bucket")
    places = found.mapInArrow(_share, PLACES).groupBy("id", "rid").agg(F.flatten(F.collect_list("pos")).alias("pos"))
    segments = rows.join(places, ["id", "rid"]).mapInArrow(_segments(n, hot), SEGMENTS).repartition("shard").sortWithinPartitions("shard")
    return segments.mapInArrow(_search, REMOVED).groupBy("id", "rid").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with the kept words, joined by a space, as text, and n_words and n_removed."""
    keep = docs.columns if keep is None else keep
    total, less = unused(keep, "n_words", "n_removed")
    rest = [c for c in keep if c != text]
    rows = _keyed(docs, doc_id, text, rest)
    both = rows.join(removed(rows), ["id", "rid"], "left").select("text", *(f"c{k}" for k in range(len(rest))), "starts", "ends")
    kinds = [k for _, k in both.dtypes[: len(rest) + 1]]
    ddl = ", ".join([*(f"c{k} {kind}" for k, kind in enumerate(kinds)), "n_words bigint", "n_removed bigint"])
    return both.mapInArrow(_cut(0), ddl).toDF(text, *rest, total, less).select(*(c for c in [*rest, text] if c in keep or c == text), total, less)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that documents before them have."""
    rows = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = f"""
with words as (
  select doc_id, unnest(w) as word, unnest(range(len(w))) as i from (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents)),
windows as (
  select doc_id, i, list(word) over (partition by doc_id order by i rows between current row and {LENGTH - 1} following) as w from words),
firsts as (select w, min(doc_id) as first_id from windows where len(w) = {LENGTH} group by w),
starts as (select doc_id, i from windows join firsts using (w) where first_id < doc_id),
marked as (
  select words.doc_id, words.i, word,
    max(starts.i) over (partition by words.doc_id order by words.i rows between {LENGTH - 1} preceding and current row) is not null as gone
  from words left join starts on starts.doc_id = words.doc_id and starts.i = words.i)
select documents.doc_id, count(word) as n_words, count(word) filter (gone) as n_removed,
  sha256(coalesce(string_agg(word, ' ' order by i) filter (not gone), '')) as kept_sha256
from documents left join marked on marked.doc_id = documents.doc_id group by documents.doc_id
"""
