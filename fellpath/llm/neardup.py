"""Near duplicates by BagMinHash signatures, banding and exact verification.

A document is the bag (multiset) of its ``SHINGLE``-word shingles; words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a
document of one to four words has one shingle. Two documents are linked if the weighted Jaccard similarity of their bags
(sum of smaller counts over sum of larger counts) is at least ``THRESHOLD``; a class is a connected component of links.

Signatures: every shingle runs independent Poisson processes, one for each dyadic band of its weight
((0,1], (1,2], (2,4], ...). A point has a time, a register and a place in its band, found by halving the band down to one
unit of weight; points above the shingle's weight do not count. A register keeps the earliest point, so that two bags
agree in a register with probability equal to their weighted Jaccard similarity. Times are cut off where all registers of
a document are almost surely filled; documents with an empty register run again with four times that time.

Plan, at any size:

1. Equal bags are one unit (an aggregation over a 128-bit digest of the sorted bag); copies never meet each other again.
2. ``BANDS`` bands of ``ROWS`` registers: pairs of similarity 0.8 share no band with probability 5e-6. Every unit of a band
   bucket is verified against the bucket's smallest unit only (a join that adaptive execution may split).
3. Units of buckets that still hold several classes are joined exactly, on prefixes: a bag of n shingles (the k-th copy of a
   shingle is one of its own), rarest first, must share one of its first n - ceil(t n) + 1 with any bag that is similar enough, and
   where they first meet, enough of both must be left. Every unit is verified against the most central unit of each of its
   prefix shingles (the one with the fewest rare shingles before it), and classes are joined again; then only pairs that are still
   in different classes, that could reach the threshold by size and place, meet at all. No link is lost, no list of all
   pairs of a bucket is made, and a frequent shingle is a join key that adaptive execution may split.
4. Classes by contraction: each class joins its smallest neighbour, until no link crosses classes.

Defined results: one row for each row of docs. Documents without words are alone in their class; the class id is the smallest
document id in it (a null id is the smallest). Rows that share an id, or have none, are judged each by its own text: what they
share is only the id, so that they may have several classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, id_key, mix, small_batches, steps, strings, written

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 40, 6
#: A character of a word.
WORD = r"[^\x20\x09-\x0D]"
_NONE = -(2**63)
_C1, _C2, _C3 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def bags(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of all texts, ordered by text and hash."""
    h = words.hashes(lower=True)
    at = words.valid(n)
    doc, value = words.doc[at], words.grams(h, n)[at]
    size = np.diff(words.first)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        extra = np.array([int(words.grams(h[words.first[d] : words.first[d + 1]], int(size[d]), 7)[0]) for d in short], dtype=np.uint64)
        doc, value = np.concatenate((doc, short)), np.concatenate((value, extra))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if not len(doc):
        return doc, value, np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))))
    return doc[head], value[head], np.diff(np.concatenate((head, [len(doc)])))


def bag_min_hash(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """The signatures, docs x size, of bags with whole-number weights; a bag without shingles has zeros."""
    out = np.zeros((docs, size), dtype=np.uint64)
    total = np.bincount(doc, weights=weight, minlength=docs)
    todo, reach = np.flatnonzero(total > 0), 1.0
    level = [np.zeros(len(doc), dtype=np.int64)]  # each shingle once for each dyadic band of its weight
    who = [np.arange(len(doc))]
    j = 1
    while len(more := np.flatnonzero(weight > 2 ** (j - 1))):
        who.append(more)
        level.append(np.full(len(more), j))
        j += 1
    who, level = np.concatenate(who), np.concatenate(level)
    while len(todo):
        best = np.full(docs * size, np.inf)
        point = np.zeros(docs * size, dtype=np.uint64)
        limit = np.zeros(docs)
        limit[todo] = reach * size / total[todo] * (np.log(size) + 7)
        live = limit[doc[who]] > 0
        d, lv, w = doc[who][live], level[live], weight[who][live]
        key = mix(value[who][live] + lv.astype(np.uint64) * _C1)
        width = np.where(lv > 0, 2.0 ** (lv - 1), 1.0)
        cut, time, r = limit[d], np.zeros(len(d)), 0
        while len(d):
            x = mix(key + np.uint64(r * int(_C2) % 2**64))
            time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / width
            on = time <= cut
            if not on.all():
                d, lv, w, key, width, cut, time, x = d[on], lv[on], w[on], key[on], width[on], cut[on], time[on], x[on]
            y = mix(x ^ _C3)
            # the place in the band, found bit by bit: halving the band lv - 1 times leaves one unit of weight
            low = np.where(lv > 0, (np.int64(1) << np.maximum(lv - 1, 0)) + ((y >> np.uint64(32)).astype(np.int64) & ((np.int64(1) << np.maximum(lv - 1, 0)) - 1)), 0)
            use = low < w
            slot = d[use] * size + (y[use] & np.uint64(0xFFFFFFFF)).astype(np.int64) % size
            t, p = time[use], y[use] | np.uint64(1)
            np.minimum.at(best, slot, t)
            won = best[slot] == t
            point[slot[won]] = p[won]
            r += 1
        best, point = best.reshape(docs, size), point.reshape(docs, size)
        full = np.isfinite(best[todo]).all(axis=1)
        out[todo[full]] = point[todo[full]]
        todo, reach = todo[~full], reach * 4
    return out


def _signature_rows(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in steps(batches):
            words = Words(buf, offsets)
            doc, value, weight = bags(words)
            n = len(offsets) - 1
            sig = bag_min_hash(doc, value, weight, n, bands * rows)
            mixed = np.zeros((n, bands), dtype=np.uint64)
            for i in range(rows):
                mixed = mix(mixed * _C1 + sig[:, i::rows] + np.arange(bands, dtype=np.uint64) * _C3)
            cut = np.searchsorted(doc, np.arange(n + 1))
            data = np.stack((value, weight.astype(np.uint64)), axis=1)
            digests = [hashlib.blake2b(data[cut[i] : cut[i + 1]].tobytes(), digest_size=16).digest() for i in range(n)]
            pair = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(n, 2)
            total = np.bincount(doc, weights=weight, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(total), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(mixed.reshape(-1).view(np.int64)))],
                names=["doc_id", "key", "mark", "d1", "d2", "size", "bands"],
            )

    return run


def overlaps(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Exact weighted Jaccard similarity of the texts of each row."""
    n = len(left[1]) - 1
    found = []
    for buf, offsets in (left, right):
        doc, value, weight = bags(Words(buf, offsets))
        found.append((mix(value + mix(doc.astype(np.uint64) + _C1)), weight, doc))
    total = sum(np.bincount(doc, weights=w, minlength=n) for _, w, doc in found)
    _, i, j = np.intersect1d(found[0][0], found[1][0], assume_unique=True, return_indices=True)
    both = np.bincount(found[0][2][i], weights=np.minimum(found[0][1][i], found[1][1][j]), minlength=n)
    return np.divide(both, total - both, out=np.zeros(n), where=total > both)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in steps(batches, "text_a"):
            similar = overlaps((buf, offsets), strings(batch.column(batch.schema.get_field_index("text_b"))))
            ok = np.flatnonzero(similar >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok)), pa.array(similar[ok])], names=["a", "b", "similarity"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, name: str) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar enough, with the similarity; written."""
    pairs = written(pairs.select("a", "b").distinct(), f"{name}-pairs")
    with_b = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    rows = with_b.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return written(rows.mapInArrow(_verify(threshold), "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity")), f"{name}-links")


def components(links: DataFrame) -> DataFrame:
    """(key, class) for every key that has a link (a, b): class is the smallest key that it is connected with."""
    links = links.select("a", "b").where("a <> b")
    of = written(links.select(F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("class", F.col("key")), "classes")
    edges = links
    while True:
        # links between classes, once each; the larger class hangs on its smallest neighbour
        ordered = written(edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).where("a < b").distinct(), "edges")
        if ordered.isEmpty():
            return of
        hang = written(ordered.groupBy("b").agg(F.min("a").alias("to")), "hang")
        while True:  # pointers lead to smaller classes only: follow them to the end
            up = hang.select(F.col("b").alias("to"), F.col("to").alias("up"))
            jumped = written(hang.join(up, "to", "left").select("b", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("moved")), "hang")
            moved = not jumped.where("moved").isEmpty()
            hang = jumped.select("b", "to")
            if not moved:
                break
        ends = lambda c: hang.select(F.col("b").alias(c), F.col("to").alias(f"{c}_to"))
        edges = ordered.join(ends("a"), "a", "left").join(ends("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
        of = written(of.join(hang.withColumnRenamed("b", "class"), "class", "left").select("key", F.coalesce("to", "class").alias("class")), "classes")


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, class, n, tokens): the bag of each text as a set, in which the k-th copy of a shingle is a token of its own."""
    for batch, buf, offsets in steps(batches):
        doc, value, weight = bags(Words(buf, offsets))
        nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
        token = mix(np.repeat(value, weight) + nth.astype(np.uint64) * _C2).view(np.int64)
        size = np.bincount(doc, weights=weight, minlength=len(offsets) - 1).astype(np.int64)
        cut = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.ListArray.from_arrays(pa.array(cut), pa.array(token))], names=["unit", "class", "n", "tokens"])


def prefixes(involved: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(unit, class, n, place, token) of the prefix tokens of the units (unit, class), rarest first; written. Tokens of a single unit are left out."""
    rows = involved.join(texts.withColumnRenamed("key", "unit"), "unit").dropDuplicates(["unit"]).select("unit", "class", "text")
    bag = written(rows.mapInArrow(_token_rows, "unit long, class long, n long, tokens array<long>"), "tokens")
    each = bag.select("unit", "n", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = each.join(shared, "token").groupBy("unit", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))  # of one text
    first = F.col("n") - F.size("tokens")  # tokens of this unit alone come first
    last = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9)  # place of the last prefix token
    own = own.withColumn("first", first).withColumn("tokens", F.slice("tokens", F.lit(1), F.greatest(last - first + 1, F.lit(0)).cast("int")))
    out = own.select("unit", "n", "first", F.posexplode("tokens").alias("i", "t")).select("unit", "n", (F.col("first") + F.col("i")).alias("place"), F.col("t.token").alias("token"))
    return written(out.join(bag.select("unit", "class"), "unit").select("unit", "class", "n", "place", "token"), "prefixes")


def _reachable(a: str, b: str, threshold: float):
    """Whether two bags that first meet at a token can be similar enough, by what is left of both from there on."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.place"), F.col(f"{b}.n") - F.col(f"{b}.place"))
    return left * (1 + threshold) >= threshold * (F.col(f"{a}.n") + F.col(f"{b}.n")) - 1e-6


def crossing(buckets: DataFrame, links: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """links (a, b, similarity) with all that cross their classes among the units of buckets which hold several."""
    of = components(links)
    rows = buckets.join(of.withColumnRenamed("key", "unit"), "unit", "left").withColumn("class", F.coalesce("class", "unit"))
    mixed = rows.groupBy("band", "value").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("band", "value")
    involved = written(rows.join(mixed, ["band", "value"]).select("unit", "class").distinct(), "involved")
    if involved.isEmpty():
        return links
    place = prefixes(involved, texts, threshold)

    def centres(rows: DataFrame) -> DataFrame:
        """The unit with the fewest rarer tokens, of each token whose units are in several classes."""
        found = rows.groupBy("token").agg(F.min(F.struct("place", "unit", "class", "n")).alias("c"), F.min("class").alias("low"), F.max("class").alias("high"))
        return found.where("low <> high").select("token", "c.*")

    near = place.alias("x").join(centres(place).alias("c"), "token").where((F.col("x.class") != F.col("c.class")) & _reachable("x", "c", threshold))
    pairs = near.select(F.least("x.unit", "c.unit").alias("a"), F.greatest("x.unit", "c.unit").alias("b"))
    links = written(links.unionByName(verified(pairs, texts, threshold, "centres")), "links")
    of = components(links).withColumnRenamed("key", "unit").withColumnRenamed("class", "now")
    place = written(place.join(of, "unit", "left").select("unit", F.coalesce("now", "class").alias("class"), "n", "place", "token"), "prefixes")
    # of two classes that meet at a token one is not its centre's: those units are on the left
    held = place.join(centres(place).select("token", F.col("class").alias("main")), "token")
    left, right = written(held.where("class <> main"), "apart").alias("x"), held.alias("y")
    once = (F.col("y.class") == F.col("y.main")) | (F.col("x.unit") < F.col("y.unit"))
    met = left.join(right, (F.col("x.token") == F.col("y.token")) & (F.col("x.class") != F.col("y.class")) & once & _reachable("x", "y", threshold))
    pairs = met.select(F.least("x.unit", "y.unit").alias("a"), F.greatest("x.unit", "y.unit").alias("b"))
    return written(links.unionByName(verified(pairs, texts, threshold, "crossing")), "links")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id and class_id, the smallest id of its class."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_key().alias("key"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))
    sigs = written(texts.mapInArrow(_signature_rows(bands, rows), "doc_id long, key long, mark long, d1 long, d2 long, size long, bands array<long>"), "signatures")
    units = sigs.where("size > 0").groupBy("d1", "d2").agg(F.min(F.struct("key", "mark")).alias("one"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
    # numbers are given once, as the table is written
    units = written(units.select(F.monotonically_increasing_id().alias("unit"), "d1", "d2", "one.key", "one.mark", "size", "bands"), "units")
    spread = units.select("unit", "size", F.posexplode("bands").alias("band", "value"))
    hubs = spread.groupBy("band", "value").agg(F.min(F.struct("unit", "size")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(spread.join(hubs.select("band", "value", F.col("hub.unit").alias("hub"), F.col("hub.size").alias("hub_size")), ["band", "value"]), "buckets")
    alike = F.least("size", "hub_size") >= F.lit(threshold) * F.greatest("size", "hub_size") - 1e-9
    stars = buckets.where("unit <> hub").where(alike).select(F.col("hub").alias("a"), F.col("unit").alias("b"))
    # the texts of all units that share a bucket with another, taken from the corpus once; rows equal in id and text are the same text
    some = units.join(buckets.select("unit").distinct(), "unit", "left_semi").select(F.col("unit").alias("u"), "key", "mark")
    near = written(texts.join(some, ["key", "mark"]).select(F.col("u").alias("key"), "text"), "texts")
    links = crossing(buckets.select("band", "value", "unit"), verified(stars, near, threshold, "stars"), near, threshold)
    of = units.join(components(links).withColumnRenamed("key", "unit"), "unit", "left").select("d1", "d2", "key", F.coalesce("class", "unit").alias("class"))
    named = of.groupBy("class").agg(F.min("key").alias("smallest"))
    known = of.join(named, "class").select("d1", "d2", "smallest")
    out = sigs.where("size > 0").select("doc_id", "d1", "d2").join(known, ["d1", "d2"]).select("doc_id", F.when(F.col("smallest") != _NONE, F.col("smallest")).alias("class_id"))
    return out.unionByName(sigs.where("size = 0").select("doc_id", F.col("doc_id").alias("class_id")))
