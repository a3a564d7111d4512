"""Byte-level BPE encoding through a minimal acyclic transducer, and decoding.

The frequent words of the corpus (pre-tokens, counted over all documents) are compiled into a minimal acyclic automaton:
words with common suffixes share states, and each transition adds a number, so that the sum along a word is its rank in
the lexicon, under which its ids lie in one flat array (a transducer from words to ids). The file is written to the folder
that driver and executors share, handed to every executor by Spark, and memory-mapped there. Words that the automaton does
not accept are merged exactly by the tokenizer's merge ranks.

Pre-tokens are those of the byte-level pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, cut
here by character classes in whole batches. Special tokens of the file (``<|endoftext|>``) are found in texts first, as
the tokenizers library does.

Size: the lexicon holds at most ``LEXICON`` words (the counts are complete; the least count that a word needs follows from a
histogram of counts), so that the driver's work and the file are bounded; all other work is one pass over the documents.

Defined results: null text counts as empty and has no ids; ids outside the vocabulary decode to nothing, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .shared import STEP_BYTES, delete_at_exit, mix, shared_dir, small_batches, strings, written

#: Words of the lexicon, at most.
LEXICON = 65_536
#: Distinct words that a worker remembers or counts before it starts anew.
MEMO = 300_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER, _DIGIT, _OTHER, _BLANK = 0, 1, 2, 3


# --- the tokenizer's file ---------------------------------------------------------------------------------------------


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


@dataclass(frozen=True)
class Tokenizer:
    """ranks: rank and id of each merge by the pair of ids; start: id of each byte; pieces: bytes of each id; special: ids by text.

    codes and made are the merges again for short words: rank by the pair as one number, and id by rank. first (ranks of pairs of
    bytes), keys and places (pairs as numbers in order, and their ranks) serve many words at once.
    """

    ranks: dict[tuple[int, int], tuple[int, int]]
    start: list[int]
    pieces: list[bytes]
    special: dict[str, int]
    codes: dict[int, int]
    made: list[int]
    first: np.ndarray
    keys: np.ndarray
    places: np.ndarray

    @staticmethod
    def read(path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, letters = told["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
        special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        pieces = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for word, i in vocab.items():
            pieces[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
        for word, i in special.items():
            pieces[i] = word.encode()
        ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        start, codes = [vocab[c] for c in letters], {a << 32 | b: rank for (a, b), (rank, _) in ranks.items()}
        first = np.array([[codes.get(a << 32 | b, len(pairs)) for b in start] for a in start], dtype=np.int64).reshape(-1)
        keys = np.array(sorted(codes), dtype=np.int64)
        return Tokenizer(ranks, start, pieces, special, codes, [vocab[a + b] for a, b in pairs], first, keys, np.array([codes[k] for k in keys.tolist()], dtype=np.int64))

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: the first pair of least rank is merged, until no pair has a rank."""
        start, rank, made = self.start, self.codes.get, self.made
        ids = [start[b] for b in word]
        if len(word) > 200:
            return self._merge_long(ids)
        none = len(made)
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            ids[i] = made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], none)
        return tuple(ids)

    def merge_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """merge of many words at once: in each round the first pair of least rank of every word that still has one."""
        out: list[tuple[int, ...]] = [()] * len(words)
        size = np.array([len(w) for w in words], dtype=np.int64)
        for i in np.flatnonzero((size > 200) | (size == 1)).tolist():
            out[i] = self.merge(words[i])
        who = np.flatnonzero((size > 1) & (size <= 200))
        if not len(who):
            return out
        none, made, start = len(self.made), np.array([*self.made, -1], dtype=np.int64), np.array(self.start, dtype=np.int64)
        buf = np.frombuffer(b"".join([words[i] for i in who.tolist()]), dtype=np.uint8).astype(np.int64)
        size = size[who]
        ids, rank = start[buf], np.full(len(buf), none, dtype=np.int64)
        rank[:-1] = self.first[buf[:-1] * 256 + buf[1:]]
        rank[np.cumsum(size) - 1] = none  # the last of a word has no pair
        while len(who):
            begin = np.concatenate(([0], np.cumsum(size)))
            least = np.minimum.reduceat(rank, begin[:-1])
            done = least == none
            if done.any():
                flat = ids.tolist()
                for k in np.flatnonzero(done).tolist():
                    out[who[k]] = tuple(flat[begin[k] : begin[k + 1]])
                stay = np.repeat(~done, size)
                ids, rank, who, size, least = ids[stay], rank[stay], who[~done], size[~done], least[~done]
                if not len(who):
                    break
                begin = np.concatenate(([0], np.cumsum(size)))
            owner = np.repeat(np.arange(len(who)), size)
            hit = np.flatnonzero(rank == least[owner])
            hit = hit[np.concatenate(([True], owner[hit[1:]] != owner[hit[:-1]]))]  # one for each word
            ids[hit] = made[least]
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            ids, rank = ids[keep], rank[keep]
            at = hit - np.arange(len(hit))
            size = size - 1
            begin = np.concatenate(([0], np.cumsum(size)))
            last = at == begin[1:] - 1
            rank[at[last]] = none
            self._rerank(ids, rank, at[~last])
            self._rerank(ids, rank, at[at > begin[:-1]] - 1)
        return out

    def _rerank(self, ids: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
        """Ranks of the pairs that begin at some places."""
        if len(at) and len(self.keys):
            key = (ids[at] << 32) | ids[at + 1]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank[at] = np.where(self.keys[i] == key, self.places[i], len(self.made))

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap of pairs, in n log n steps, for words of any length."""
        from heapq import heapify, heappop, heappush

        ids = list(ids)
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r[0], i, r[1], p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.ranks.get(p))]
        heapify(heap)
        while heap:
            _, i, made, pair = heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j < 0 or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((ids[a], ids[b]))):
                    heappush(heap, (r[0], a, r[1], (ids[a], ids[b])))
        return tuple(i for i in ids if i >= 0)


# --- pre-tokens -------------------------------------------------------------------------------------------------------

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of each code point by the pattern's own character sets.

    The regex module may know a newer Unicode than the tokenizers library; letters and digits that the library does not take
    as such (it cuts before them) fall back to the other characters.
    """
    if not _classes:
        table = np.full(0x110000, _OTHER, dtype=np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, what in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_BLANK, r"\s+")):
            for m in regex.finditer(what, every):
                table[ord(m[0][0])] = kind
                codes = np.frombuffer(m[0].encode("utf-32-le"), dtype=np.uint32)
                table[codes] = kind
        split = ByteLevel(add_prefix_space=False, use_regex=True)
        for kind, before in ((_LETTER, "a"), (_DIGIT, "1")):
            codes = np.flatnonzero(table == kind)
            told = split.pre_tokenize_str("".join(before + chr(c) for c in codes))
            starts = np.array([a for _, (a, _) in told])
            table[codes[starts[starts % 2 == 1] // 2]] = _OTHER
        _classes.append(table)
    return _classes[0]


def cut(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts laid one after another; edges: where a text starts."""
    n = len(codes)
    kind = classes()[codes]
    first = np.zeros(n + 1, dtype=bool)
    first[edges] = True
    first[n] = True
    begin = first[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    blank = kind == _BLANK
    # the last blank of a run that something follows stands apart; a plain space then belongs to what follows
    last = blank & ~np.concatenate((blank[1:], [False])) & ~first[1:]
    begin |= last
    after = np.flatnonzero(last & (codes == 0x20)) + 1
    begin[after] = False
    # contractions: an apostrophe that starts a pre-token and stands alone
    apostrophe = np.flatnonzero((codes == 0x27) & begin)
    for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
        size = len(tail)
        at = apostrophe[apostrophe + size < n]
        for k, c in enumerate(tail, 1):
            at = at[(codes[at + k] == ord(c)) & ~first[at + k]]
        begin[at + 1] = False
        end = at + 1 + size
        end = end[end < n]
        begin[end] = True
    return np.flatnonzero(begin)


class Pretokens:
    """The distinct pre-tokens of some segments: texts, and for each pre-token its number; first: where each segment begins."""

    def __init__(self, segments: list[str]):
        joined = "".join(segments)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        size = np.array([len(s) for s in segments], dtype=np.int64)
        offsets = np.concatenate(([0], np.cumsum(size)))
        start = cut(codes, offsets[:-1][size > 0]) if len(codes) else np.zeros(0, np.int64)
        self.first = np.searchsorted(start, offsets)
        end = np.append(start[1:], len(codes))[: len(start)]
        left, at, active = end - start, start.copy(), np.arange(len(start))
        h = left.astype(np.uint64)
        part = h.copy()
        for _ in range(64):
            if not len(active):
                break
            part = part * np.uint64(0x9E3779B97F4A7C15) + mix_code(codes[at])
            left, at = left - 1, at + 1
            done = left == 0
            if done.any():
                h[active[done]] = part[done]
                active, at, left, part = active[~done], at[~done], left[~done], part[~done]
        for i in active:
            h[i] = int.from_bytes(hashlib.blake2b(joined[start[i] : end[i]].encode(), digest_size=8).digest(), "little")
        _, head, self.number = np.unique(mix(h), return_index=True, return_inverse=True)
        self.texts = [joined[a:b] for a, b in zip(start[head].tolist(), end[head].tolist(), strict=True)]


def mix_code(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)


# --- the transducer ---------------------------------------------------------------------------------------------------


def compile_lexicon(words: list[bytes], ids: Callable[[bytes], tuple[int, ...]]) -> bytes:
    """A minimal acyclic transducer of the words, as one block that can be memory-mapped.

    Words are added in order; a state is fixed once no later word can change it, and equal states are shared. Layout (int64
    little-endian): counts of edges, words and ids; edge keys (state * 256 + byte, ascending), targets, added ranks; a
    Boolean for each state that ends a word (as int64); offsets of each word's ids; the ids.
    """
    words = sorted(set(words))
    edges: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    known: dict[tuple, int] = {}
    path: list[int] = [0]  # states along the last word

    def settle(depth: int, last: bytes) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            shape = (final[state], tuple(sorted(edges[state].items())))
            edges[path[-1]][last[len(path) - 1]] = known.setdefault(shape, state)

    last = b""
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        settle(same, last)
        for b in word[same:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][b] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = word
    settle(0, last)
    # number the states that are left, and count the words below each
    order, stack, below = [], [(0, False)], {}
    while stack:
        state, done = stack.pop()
        if done:
            below[state] = final[state] + sum(below[t] for t in edges[state].values())
            order.append(state)
        elif state not in below:
            below[state] = 0
            stack.append((state, True))
            stack.extend((t, False) for t in edges[state].values() if t not in below)
    name = {s: i for i, s in enumerate(reversed(list(dict.fromkeys(order))))}
    keys, targets, adds = [], [], []
    for state, i in sorted(name.items(), key=lambda x: x[1]):
        rank = int(final[state])
        for b, t in sorted(edges[state].items()):
            keys.append(i * 256 + b)
            targets.append(name[t])
            adds.append(rank)
            rank += below[t]
    ends = np.zeros(len(name), dtype=np.int64)
    for s, i in name.items():
        ends[i] = final[s]
    lists = [ids(w) for w in words]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    flat = np.array([i for x in lists for i in x], dtype=np.int64)
    head = np.array([len(keys), len(name), len(words), len(flat)], dtype=np.int64)
    return b"".join(np.ascontiguousarray(x, dtype="<i8").tobytes() for x in (head, keys, targets, adds, ends, offsets, flat))


class Lexicon:
    """A compiled lexicon over a buffer (a memory map)."""

    def __init__(self, data: np.ndarray):
        edges, states, words, ids = (int(x) for x in data[:4])
        at = np.cumsum([4, edges, edges, edges, states, words + 1, ids])
        self.keys, self.targets, self.adds, self.ends, self.offsets, self.ids = (data[a:b] for a, b in zip(at[:-1], at[1:], strict=True))

    @staticmethod
    def map(path: str) -> Lexicon:
        return Lexicon(np.memmap(path, dtype="<i8", mode="r"))

    def rank(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word; -1 where the automaton does not accept it. All words walk at once, byte by byte."""
        out = np.full(len(words), -1, dtype=np.int64)
        size = np.array([len(w) for w in words], dtype=np.int64)
        if not len(self.keys) or not len(words):
            return out
        buf = np.frombuffer(b"".join(words), dtype=np.uint8)
        at = np.concatenate(([0], np.cumsum(size)))[:-1]
        who = np.flatnonzero(size > 0)
        state, rank, place = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), at[who]
        left = size[who]
        while len(who):
            key = state * 256 + buf[place]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[i] == key
            who, i, rank, place, left = who[ok], i[ok], rank[ok], place[ok] + 1, left[ok] - 1
            state, rank = np.asarray(self.targets[i]), rank + self.adds[i]
            done = left == 0
            accepted = done & (self.ends[state] == 1)
            out[who[accepted]] = rank[accepted]
            who, state, rank, place, left = who[~done], state[~done], rank[~done], place[~done], left[~done]
        return out

    def of(self, rank: int) -> tuple[int, ...]:
        return tuple(self.ids[self.offsets[rank] : self.offsets[rank + 1]].tolist())


# --- encoding and decoding --------------------------------------------------------------------------------------------


class Coder:
    """Encodes and decodes batches of texts; keeps the ids of the words that it has seen, up to MEMO of them."""

    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon | None):
        self.tokenizer, self.lexicon = tokenizer, lexicon
        self.memo: dict[str, tuple[int, ...]] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(tokenizer.special, key=len, reverse=True)))) if tokenizer.special else None
        size = np.array([len(p) for p in tokenizer.pieces], dtype=np.int64)
        self.piece_at = np.concatenate(([0], np.cumsum(size)))
        self.piece_bytes = np.frombuffer(b"".join(tokenizer.pieces), dtype=np.uint8)

    def _ids_of(self, texts: list[str]) -> list[tuple[int, ...]]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = [t for t in texts if t not in self.memo]
        if new:
            data = [t.encode() for t in new]
            rank = self.lexicon.rank(data).tolist() if self.lexicon else [-1] * len(data)
            merged = iter(self.tokenizer.merge_all([b for b, r in zip(data, rank, strict=True) if r < 0]))
            for t, r in zip(new, rank, strict=True):
                self.memo[t] = self.lexicon.of(r) if r >= 0 else next(merged)
        memo = self.memo
        return [memo[t] for t in texts]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where those of each text begin (one more at the end)."""
        segments, owner, mark = [], [], []
        for i, t in enumerate(texts):
            at = 0
            if self.special is not None:
                for m in self.special.finditer(t):
                    segments.append(t[at : m.start()])
                    owner.append(i)
                    mark.append(self.tokenizer.special[m[0]])
                    at = m.end()
            segments.append(t[at:])
            owner.append(i)
            mark.append(-1)
        pre = Pretokens(segments)
        lists = self._ids_of(pre.texts)
        size = np.array([len(x) for x in lists], dtype=np.int64)
        pool = np.array([i for x in lists for i in x], dtype=np.int32)
        at = np.concatenate(([0], np.cumsum(size)))
        n = size[pre.number] if len(pre.number) else np.zeros(0, np.int64)
        stop = np.concatenate(([0], np.cumsum(n)))
        ids = pool[np.arange(stop[-1]) + np.repeat(at[pre.number] - stop[:-1], n)] if len(n) else np.zeros(0, np.int32)
        bounds = stop[pre.first]
        marks = np.array(mark, dtype=np.int64)
        if (marks >= 0).any():
            ids = np.insert(ids, bounds[1:][marks >= 0], marks[marks >= 0]).astype(np.int32)
            bounds = bounds + np.concatenate(([0], np.cumsum(marks >= 0)))
        ends = np.zeros(len(texts), dtype=np.int64)
        ends[np.array(owner, dtype=np.int64)] = bounds[1:]
        return ids, np.concatenate(([0], ends))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of the decoded text of each range of ids; invalid bytes become U+FFFD."""
        known = (ids >= 0) & (ids < len(self.piece_at) - 1)
        if not known.all():
            bounds = np.concatenate(([0], np.cumsum(known)))[bounds]
            ids = ids[known]
        n = self.piece_at[ids + 1] - self.piece_at[ids]
        stop = np.concatenate(([0], np.cumsum(n)))
        data = self.piece_bytes[np.arange(stop[-1]) + np.repeat(self.piece_at[ids] - stop[:-1], n)].tobytes() if len(ids) else b""
        cuts = stop[bounds].tolist()
        return [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(cuts, cuts[1:], strict=False)]


def _batches(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = strings(column)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP_BYTES, "right")) - 1)
            yield batch.slice(i, j - i), [t or "" for t in column.slice(i, j - i).to_pylist()]
            i = j


def _count_rows(special: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile("|".join(map(regex.escape, special))) if special else None
        held: dict[str, int] = {}
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), type=pa.string()), pa.array(list(held.values()), type=pa.int64())], names=["word", "n"])
        for _, texts in _batches(batches, "text"):
            pre = Pretokens([s for t in texts for s in (find.split(t) if find else [t])])
            for w, n in zip(pre.texts, np.bincount(pre.number, minlength=len(pre.texts)).tolist(), strict=True):
                held[w] = held.get(w, 0) + n
            if len(held) > MEMO:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return run


def frequent_words(docs: DataFrame, special: list[str], most: int = LEXICON) -> list[str]:
    """The words of the highest counts over all documents: all words of the least count that at most ``most`` words reach, and two at least."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_rows(special), "word string, n long")
    counts = written(rows.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "words")
    level = F.floor(F.log2("n") * 16).cast("int")
    bars = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r["level"])
    total, least = 0, None
    for r in bars:
        total += r["c"]
        if total > most:
            break
        least = r["level"]
    return [] if least is None else [r["word"] for r in counts.where(level >= least).select("word").collect()]


def publish(spark: SparkSession, data: bytes, name: str) -> str:
    """Write a file to the shared folder and let Spark hand it to every executor; returns its name for SparkFiles."""
    name = f"{name}-{uuid.uuid4().hex}.bin"
    path = f"{shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target)
    out.write(data)
    out.close()
    delete_at_exit(spark, path)
    spark.sparkContext.addFile(fs.makeQualified(target).toString())
    return name


_coders: dict[tuple, Coder] = {}


def coder(tokenizer: str, lexicon: str | None) -> Coder:
    """One coder for each worker process, from published files."""
    key = (tokenizer, lexicon)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(Tokenizer.read(SparkFiles.get(tokenizer)), Lexicon.map(SparkFiles.get(lexicon)) if lexicon else None)
    return _coders[key]


def published(spark: SparkSession, tokenizer_path: str) -> str:
    """The tokenizer's file, which only the driver needs to see, handed to every executor."""
    with open(tokenizer_path, "rb") as f:
        return publish(spark, f.read(), "tokenizer")


def build_lexicon(docs: DataFrame, tokenizer_path: str, most: int = LEXICON) -> str | None:
    """Count, compile and publish the lexicon of docs; None if no word is frequent."""
    tokenizer = Tokenizer.read(tokenizer_path)
    words = frequent_words(docs, list(tokenizer.special), most)
    if not words:
        return None
    return publish(docs.sparkSession, compile_lexicon([w.encode() for w in words], tokenizer.merge), "lexicon")


def _encode_rows(tokenizer: str, lexicon: str | None, render):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer, lexicon)
        for batch, texts in _batches(batches, "text"):
            yield render(own, batch, *own.encode(texts))

    return run


def _render_ids(own: Coder, batch: pa.RecordBatch, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "ids"])


def encode(docs: DataFrame, tokenizer_path: str, lexicon: str | None = None, render=_render_ids, schema: str | None = None) -> DataFrame:
    """docs (any columns, text among them) with ids; a column of that name is replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("ids").withColumn("text", F.col("text").cast("string"))
    schema = schema or ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "ids array<int>"])
    return docs.mapInArrow(_encode_rows(published(docs.sparkSession, tokenizer_path), lexicon, render), schema)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """encoded (any columns, ids among them) with decoded; a column of that name is replaced. Null ids decode to ''."""
    tokenizer = published(encoded.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer, None)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            size = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
            texts = own.decode(flat, np.concatenate(([0], np.cumsum(size))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.decode() for t in texts], type=pa.string())], names=[*batch.schema.names, "decoded"])

    encoded = encoded.drop("decoded")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields), "decoded string"])
    return encoded.mapInArrow(run, schema)
