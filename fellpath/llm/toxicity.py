"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are 64-bit hashes of words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased) and of their first
4, 5 and 6 bytes; the value of a feature is log(1 + count). The model is P(grade > k) = sigmoid(w.x - theta_k): one weight
for each feature, shared by all thresholds, and ordered thresholds. The expected severity is the sum of P(grade > k).

Grades come from the labels: 0 where toxic = 0; toxic documents get 1 to ``GRADES``-1 by equal parts of their severity in the eyes
of a model that has not seen them: the sample is dealt into ``FOLDS`` parts, and each part is ranked by a two-grade model
fitted on the others.

Fitting uses at most ``PER_CLASS`` labelled documents of either label (those with the smallest hash of their id); of near
copies among them (equal smallest shingle hash) one counts. Features are counted over this sample in Spark, and the at most
``MAX_FEATURES`` features with the largest likelihood ratio are kept, so that the model has a fixed bound. Scoring is one
pass over all documents without a shuffle.

Defined results: null text counts as empty; without labels of both kinds the model has no features and all severities
are 0; an id with several labels counts as toxic if one is; rows that repeat an id are scored each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import _BASE, _BYTE, _LOWER, Words, mix, small_batches, steps, written

#: Labelled documents of either label that are used for fitting, at most.
PER_CLASS = 3000
MAX_FEATURES = 4096
#: Likelihood ratio that a feature must reach.
LEAST_RATIO = 14.0
GRADES = 4
FOLDS = 4
PREFIXES = (4, 5, 6)
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[0x80:] = True
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights, and the ordered thresholds."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, np.inf))


def features(words: Words) -> list[np.ndarray]:
    """For each kind of feature, a hash for each word; 0 where a word is too short."""
    low = _LOWER[words.buf]
    size = words.end - words.start
    out = [words.hashes(lower=True) | np.uint64(1)]
    h = np.zeros(len(words), dtype=np.uint64)
    last = max(0, len(low) - 1)
    for k in range(max(PREFIXES)):
        if len(words):
            h = h * _BASE + _BYTE[low[np.minimum(words.start + k, last)]]
        if k + 1 in PREFIXES:
            out.append(np.where(size >= k + 1, mix(h + np.uint64(k + 1)) | np.uint64(1), np.uint64(0)))
    return out


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, offsets in steps(batches):
        words = Words(buf, offsets, _INSIDE)
        kinds = features(words)
        grams, at = words.grams(kinds[0], 5), words.valid(5)
        own = words.doc[at]
        ids, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = []
        for d in range(len(offsets) - 1):
            a, b = words.first[d], words.first[d + 1]
            values = [k[a:b][k[a:b] > 0] for k in kinds]
            found, count = np.unique(np.concatenate(values), return_counts=True)
            g = grams[at[own == d]]
            copy = [int(mix(g ^ np.uint64(s)).min().view(np.int64)) for s in (11, 22, 33, 44)] if len(g) else [int(kinds[0][a:b].sum(dtype=np.uint64).view(np.int64)) if b > a else 0]
            rows.append({"doc_id": ids[d], "toxic": toxic[d], "n_words": int(b - a), "copy": copy, "f": found.view(np.int64).tolist(), "c": count.tolist()})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("n_words", pa.int64()), ("copy", pa.list_(pa.int64())), ("f", pa.list_(pa.int64())), ("c", pa.list_(pa.int64()))]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_features: int = MAX_FEATURES) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    small_batches(spark)
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    pick = [one.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for t in (0, 1)]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))  # 2 * per_class rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("doc_id", "toxic", "text")
    sample = written(rows.mapInArrow(_sample_rows, "doc_id long, toxic int, n_words long, copy array<long>, f array<long>, c array<long>"), "toxicity-sample")
    heads = sample.select("doc_id", "toxic", "n_words", "copy").orderBy("doc_id").collect()
    seen, keep = set(), {}
    for r in heads:  # of near copies one counts
        marks = {(k, v, r["toxic"]) for k, v in enumerate(r["copy"])}
        if not marks & seen and r["doc_id"] not in keep:
            keep[r["doc_id"]] = (r["toxic"], r["n_words"])
        seen |= marks
    n = np.array([sum(t == k for t, _ in keep.values()) for k in (0, 1)])
    if not n.all():
        return Model()
    used = F.broadcast(spark.createDataFrame([(k,) for k in keep], "doc_id long"))
    long = sample.dropDuplicates(["doc_id"]).join(used, "doc_id").select("doc_id", "toxic", F.explode(F.arrays_zip("f", "c")).alias("x")).select("doc_id", "toxic", F.col("x.f").alias("f"), F.col("x.c").alias("c"))
    held = long.groupBy("f").agg(F.sum("toxic").cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("all"))
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    total = float(n.sum())
    expect = F.col("all") * (float(n[1]) / total)
    clean = F.col("all") - F.col("t")
    ratio = 2 * (part(F.col("t"), expect) + part(clean, F.col("all") - expect) + part(n[1] - F.col("t"), n[1] - expect) + part(n[0] - clean, n[0] - (F.col("all") - expect)))
    best = held.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "f").limit(max_features)
    best = best.select("f").collect()
    if not best:
        return Model()
    names = np.array([r["f"] for r in best], dtype=np.int64).view(np.uint64)
    names = np.sort(names)
    place = {int(v): i for i, v in enumerate(names.view(np.int64))}
    table = F.broadcast(spark.createDataFrame([(k,) for k in place], "f long"))
    hits = long.join(table, "f").select("doc_id", "f", "c").collect()  # few for each sampled document
    docs_at = {d: i for i, d in enumerate(sorted(keep))}
    row = np.array([docs_at[r["doc_id"]] for r in hits], dtype=np.int64)
    col = np.array([place[r["f"]] for r in hits], dtype=np.int64)
    count = np.array([r["c"] for r in hits], dtype=float)
    order = np.lexsort((col, row))  # the same sums whatever order rows came in
    row, col, count = row[order], col[order], count[order]
    toxic = np.array([keep[d][0] for d in sorted(keep)])
    grade = held_out_grades(row, col, np.log1p(count), toxic, len(names))
    weights, thresholds = ordinal(row, col, np.log1p(count), grade, len(names))
    return Model(names, weights, thresholds)


def held_out_grades(row: np.ndarray, col: np.ndarray, value: np.ndarray, toxic: np.ndarray, width: int) -> np.ndarray:
    """0 for clean documents, 1 to GRADES-1 by equal parts of the toxic documents of each fold, ranked by a model of the other folds."""
    grade, fold = np.zeros(len(toxic), dtype=np.int64), np.arange(len(toxic)) % FOLDS
    for f in range(FOLDS):
        seen = (fold != f)[row]
        weights, _ = ordinal(row[seen], col[seen], value[seen], np.where(fold != f, toxic, 0), width, kinds=2, used=fold != f)
        severity = np.bincount(row, weights=weights[col] * value, minlength=len(toxic))
        own = np.flatnonzero((fold == f) & (toxic == 1))
        ranks = np.argsort(np.argsort(severity[own], kind="stable"), kind="stable")
        grade[own] = 1 + ranks * (GRADES - 1) // max(1, len(ranks))
    return grade


def ordinal(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, rounds: int = 400, penalty: float = 0.02, rate: float = 0.1, kinds: int = 0, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model, by gradient steps with Adam's step sizes."""
    n, kinds = len(grade), kinds or int(max(GRADES, grade.max(initial=0) + 1))
    used = np.ones(n, dtype=bool) if used is None else used
    theta = np.linspace(0.0, 2.0, kinds - 1)
    x = np.concatenate((np.zeros(width), [theta[0]], np.log(np.diff(theta))))
    m, v = np.zeros_like(x), np.zeros_like(x)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, rounds + 1):
        w, theta = x[:width], x[width] + np.concatenate(([0.0], np.cumsum(np.exp(x[width + 1 :]))))
        score = np.bincount(row, weights=w[col] * value, minlength=n)
        p = sigmoid(score[:, None] - theta[None, :])
        # the likelihood of grade k is p[k-1] - p[k]
        full = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), axis=1)
        like = np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-12)
        slope = np.concatenate((np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))), axis=1)
        up, down = slope[np.arange(n), grade] / like, slope[np.arange(n), grade + 1] / like
        up, down = up * used, down * used
        by_score = down - up
        by_theta = np.zeros((n, kinds + 1))
        by_theta[np.arange(n), grade] += up
        by_theta[np.arange(n), grade + 1] -= down
        g_theta = by_theta[:, 1:-1].sum(axis=0) / n
        g_w = np.bincount(col, weights=by_score[row] * value, minlength=width) / n + penalty * w / np.sqrt(n)
        gaps = np.exp(x[width + 1 :])
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate((g_w, [tail[0]], tail[1:] * gaps))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:width], x[width] + np.concatenate(([0.0], np.cumsum(np.exp(x[width + 1 :]))))


def latent(words: Words, texts: int, model: Model) -> np.ndarray:
    """w.x of each text."""
    if not len(model.features) or not len(words):
        return np.zeros(texts)
    row, col = [], []
    for kind in features(words):
        at = np.searchsorted(model.features, kind)
        hit = np.flatnonzero(model.features[np.minimum(at, len(model.features) - 1)] == kind)
        row.append(words.doc[hit])
        col.append(at[hit])
    pair, count = np.unique(np.concatenate(row) * np.int64(len(model.features)) + np.concatenate(col), return_counts=True)
    return np.bincount(pair // len(model.features), weights=model.weights[pair % len(model.features)] * np.log1p(count), minlength=texts)


def _score_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in steps(batches):
            words = Words(buf, offsets, _INSIDE)
            z = latent(words, len(offsets) - 1, model)[:, None] - model.thresholds[None, :]
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            p[np.isneginf(z)] = 0.0
            rest = [batch.column(i) for i in range(batch.num_columns)]
            grade = (p >= 0.5).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*rest, pa.array(p.sum(axis=1)), pa.array(grade), pa.array(p[:, 0]), pa.array(grade > 0)], names=[*batch.schema.names, "expected_severity", "grade", "p_toxic", "is_toxic"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (any columns, text among them) with expected_severity, grade, p_toxic and is_toxic; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("expected_severity", "grade", "p_toxic", "is_toxic").withColumn("text", F.col("text").cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_score_rows(model), f"{fields}, expected_severity double, grade int, p_toxic double, is_toxic boolean")
