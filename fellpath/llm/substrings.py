"""Exact substring de-duplication over windows of words.

A window is ``window`` consecutive words (``[^\\x20\\x09-\\x0D]+``, unchanged) of one document. Every word that is covered
by a window whose word sequence also starts earlier (smaller document id, or same document and earlier start) is removed.

Plan, at any size:

1. Rabin-Karp hashes of every window are rolled from word hashes. A window can only repeat if the smallest hash of its
   ``GRAM``-word pieces (its *anchor*) is chosen at two places, so the anchors (one for some eight words) are
   counted first: ``groupBy(anchor).count()`` with map-side sums, so that a hot passage is one row for each task.
2. Anchors that occur once are dropped by a join that adaptive execution may split; the rest go to their documents.
3. Only windows on repeated anchors are counted with a 96-bit hash: ``min`` of their places, again with map-side sums.
4. Documents get the places where a window is seen first; every other window on a repeated anchor is a repetition, and
   runs of them merge into maximal removal intervals.

The text is dealt out by document once and that exchange is used twice.

Defined results: null text counts as empty; documents of fewer than ``window`` words lose nothing; a null id counts as the
smallest id; rows that repeat an id count as the same document (a window at the same start is the same window).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, id_key, small_batches, steps, written

#: Words of a window, and of the pieces among which its anchor is chosen.
WINDOW, GRAM = 20, 6
#: Bits of a place that hold the start; ids that do not fit beside it go as a pair.
START_BITS = 24


def anchors(words: Words, h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the place of each one's anchor, and the hashes of the pieces."""
    at = words.valid(window)
    pieces = words.grams(h, gram)
    if not len(at):
        return at, at, pieces
    place = np.arange(len(pieces))
    have, want = 1, window - gram + 1
    while have < want:  # leftmost smallest piece of a growing range, by doubling
        step = min(have, want - have)
        other = place[step:]
        mine = place[: len(other)]
        place = np.where(pieces[mine] <= pieces[other], mine, other)
        have += step
    return at, place[at], pieces


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in steps(batches):
            words = Words(buf, offsets)
            _, place, pieces = anchors(words, words.hashes(), window, gram)
            if len(place):
                place = np.unique(place)
                doc, value = words.doc[place], pieces[place]
                order = np.lexsort((value, doc))  # one row for each anchor of a document, however often its lines repeat
                doc, value = doc[order], value[order]
                head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))))
                times = np.diff(np.concatenate((head, [len(doc)])))
                key = batch.column(0).to_numpy(zero_copy_only=False)[doc[head]]
                yield pa.RecordBatch.from_arrays([pa.array(value[head].view(np.int64)), pa.array(key), pa.array(times.astype(np.int32))], names=["anchor", "key", "n"])

    return run


def _candidates(batch: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """Words, their hashes, and the starts (in the buffer) of the windows whose anchor repeats."""
    words = Words(buf, offsets)
    h = words.hashes()
    at, place, pieces = anchors(words, h, window, gram)
    lists = batch.column(batch.schema.get_field_index("repeated"))
    flat = lists.flatten().to_numpy(zero_copy_only=False) if lists.null_count < len(lists) else np.zeros(0, np.int64)
    size = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(at) or not len(flat):
        return words, h, at[:0]
    # a pair (document of this step, anchor) as one number, exact enough by a second mix of 64 bits
    pair = lambda d, a: (a.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    wanted = pair(np.repeat(np.arange(len(size)), size), np.ascontiguousarray(flat).astype(np.int64))
    return words, h, at[np.isin(pair(words.doc[at], pieces[place].view(np.int64)), wanted)]


def _window_rows(window: int, gram: int, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in steps(batches):
            words, h, at = _candidates(batch, buf, offsets, window, gram)
            if not len(at):
                continue
            a = words.grams(h, window, 2)[at].view(np.int64)
            b = (words.grams(h, window, 3)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            key = batch.column(0).to_numpy(zero_copy_only=False)[words.doc[at]].astype(np.int64)
            start = (at - words.first[words.doc[at]]).astype(np.int64)
            place = [pa.array((key << START_BITS) | start)] if packed else [pa.array(key), pa.array(start)]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *place], names=["a", "b", "place"] if packed else ["a", "b", "key", "start"])

    return run


def _removed(window: int, gram: int, render):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in steps(batches):
            words, _, at = _candidates(batch, buf, offsets, window, gram)
            lists = batch.column(batch.schema.get_field_index("firsts"))
            keep = np.zeros(len(at), dtype=bool)
            size = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            if len(at) and size.sum():
                flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
                keep = np.isin(at, words.first[np.repeat(np.arange(len(size)), size)] + flat)
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            gone = at[~keep]
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + window, -1)
            yield render(batch, words, np.cumsum(cover[:-1]) > 0)

    return run


def intervals(words: Words, removed: np.ndarray) -> list[list[dict]]:
    """For each text, the maximal runs of removed words as {start, end} (end exclusive), counted in words."""
    out: list[list[dict]] = []
    for d in range(len(words.first) - 1):
        flags = np.concatenate(([0], removed[words.first[d] : words.first[d + 1]].astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(flags))
        out.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
    return out


def _render_intervals(batch: pa.RecordBatch, words: Words, removed: np.ndarray) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kept = kept_texts(words, removed)
    return pa.RecordBatch.from_arrays(
        [batch.column(1), pa.array(np.diff(words.first)), pa.array(intervals(words, removed), type=kind), pa.array([k.decode() for k in kept], type=pa.string())],
        names=["doc_id", "n_words", "removed", "kept_text"],
    )


def kept_texts(words: Words, removed: np.ndarray) -> list[bytes]:
    """For each text, the bytes of its kept words joined by one space."""
    keep = np.flatnonzero(~removed)
    own = words.doc[keep]
    cut = np.searchsorted(own, np.arange(len(words.first)))
    size = words.end[keep] - words.start[keep] + 1
    total = np.concatenate(([0], np.cumsum(size)))
    if not len(keep):
        return [b""] * (len(words.first) - 1)
    source = np.arange(total[-1]) + np.repeat(words.start[keep] - total[:-1], size)
    source[total[1:] - 1] = 0
    flat = words.buf[source]
    flat[total[1:] - 1] = 0x20
    data = flat.tobytes()
    return [data[total[cut[d]] : max(total[cut[d]], total[cut[d + 1]] - 1)] for d in range(len(words.first) - 1)]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, render=_render_intervals, schema: str = "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept_text string") -> DataFrame:
    """One row for each row of docs (doc_id, text): its number of words, removal intervals and kept text."""
    spark = docs.sparkSession
    small_batches(spark)
    gram = min(GRAM, window)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(id_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bound = docs.agg(F.min(F.col("doc_id").cast("long")).alias("low"), F.max(F.col("doc_id").cast("long")).alias("high"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("none"), F.max(F.octet_length("text")).alias("size")).first()
    packed = not bound["none"] and (bound["low"] or 0) >= 0 and (bound["high"] or 0) < 2 ** (62 - START_BITS) and (bound["size"] or 0) < 2**START_BITS

    rows = texts.select("key", "text").mapInArrow(_anchor_rows(window, gram), "anchor long, key long, n int")
    twice = rows.groupBy("anchor").agg(F.sum("n").alias("all")).where("all > 1").select("anchor")
    repeated = written(rows.select("anchor", "key").join(twice, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("repeated")), "anchors")
    dealt = texts.repartition(parts, "key")
    both = dealt.join(repeated, "key", "left")
    if packed:
        seen = both.select("key", "text", "repeated").where("repeated is not null").mapInArrow(_window_rows(window, gram, True), "a long, b int, place long")
        first = seen.groupBy("a", "b").agg(F.min("place").alias("place")).select(F.shiftright("place", START_BITS).alias("key"), F.col("place").bitwiseAND(F.lit(2**START_BITS - 1)).alias("start"))
    else:
        seen = both.select("key", "text", "repeated").where("repeated is not null").mapInArrow(_window_rows(window, gram, False), "a long, b int, key long, start long")
        first = seen.groupBy("a", "b").agg(F.min(F.struct("key", "start")).alias("place")).select("place.key", "place.start")
    firsts = first.groupBy("key").agg(F.collect_list("start").alias("firsts"))
    return both.join(firsts, "key", "left").select("key", "doc_id", "text", "repeated", "firsts").mapInArrow(_removed(window, gram, render), schema)
