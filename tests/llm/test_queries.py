"""The registered queries on small tables, against the tokenizers library, plain Python and brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fellpath.llm import neardup, queries, shared, toxicity

from .test_llm import BASE, BLANK, bag, fits, similarity, texts

TABLES = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string"}


def tables(spark, folder, **rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def documents(rows):
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


def test_op1_equals_the_library(spark, tmp_path):
    tokenizers, vocabularies = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    rows = [(i, t) for i, t in enumerate([*texts(4), "😀 été <|endoftext|> 中文", "a" * 3000])] + [(None, "the end"), (3, "again")]
    got = sorted(tuple(r)[:4] for r in queries.op1_bpe(spark, tables(spark, tmp_path, documents=documents(rows))).collect() if r.doc_id is not None)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want += [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] * (i is not None)
    assert got == sorted(want)


def test_op9_base_columns_equal_brute_force(spark, tmp_path):
    rng = random.Random(3)
    bits = ["a.b@x.org", "1.2.3.4", "300.1.1.1", "4539578763621486", "+1 (017) 555-7713", "word", "é 中"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(BLANK)]
    for r in queries.op9_pii(spark, tables(spark, tmp_path, documents=documents(rows))).collect():
        t = dict(rows)[r.doc_id] or ""
        want = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(BASE[k], t) if fits(k, m.group())] for k in BASE}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(x for k in BASE for x in want[k]).encode()).hexdigest()
        assert set(x for k in BASE for x in want[k]) <= set(filter(None, r.spans.split(","))) and r.n_spans == len(list(filter(None, r.spans.split(","))))


def test_op2_scores_equal_plain_python(spark, tmp_path):
    """The fitted model applied word by word in plain Python gives the query's rows."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("an the ing ou er es da lo mi".split()) for _ in range(3))
    rows = [(i, " ".join([word() for _ in range(40)] + ["grubword", "vilestem"][: 2 * (i % 4 == 0)])) for i in range(300)] + [(900 + i, t) for i, t in enumerate(BLANK)] + [(None, "x grubword")]
    folder = tables(spark, tmp_path, documents=documents(rows), labels=[(i, 1, int(i % 4 == 0)) for i in range(200)])
    docs = shared.load(spark, folder, "documents", "doc_id", "text")
    model = toxicity.fit(docs, shared.load(spark, folder, "labels", "doc_id", "toxic"))
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        buf = np.frombuffer((t or "").encode(), dtype=np.uint8)
        words = shared.Words(buf, np.array([0, len(buf)]), toxicity._INSIDE)
        count: dict[int, int] = {}
        for kind in toxicity.features(words):
            for f in kind.tolist():
                count[f] = count.get(f, 0) + 1
        z = sum(weights[f] * np.log1p(n) for f, n in count.items() if f in weights)
        p = 1 / (1 + np.exp(-(z - model.thresholds)))
        assert got[i].expected_severity == pytest.approx(p.sum(), abs=1e-9) and got[i].grade == (p >= 0.5).sum() and got[i].is_toxic == (p[0] >= 0.5)
    assert all(got[i].is_toxic == (i % 4 == 0) for i in range(300))


def test_op10_recall_at_the_threshold(spark):
    """Pairs from 0.8 on, ids divisible by 20 against all rows: all of them share a class."""
    rng = random.Random(77)
    word = lambda: "".join(rng.choice("an the ing ou er es da lo mi".split()) for _ in range(4))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(40, 120))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    of = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    bags = [bag(t) for t in rows]
    pairs = [(i, j) for i in range(0, len(rows), 20) for j in range(len(rows)) if i != j and similarity(bags[i], bags[j]) >= 0.8]
    assert len(pairs) > 40 and all(of[i] == of[j] for i, j in pairs)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES])
def test_queries_on_empty_and_odd_tables(spark, tmp_path, name):
    pytest.importorskip("public_tokenizers")
    assert queries.QUERIES[name](spark, tables(spark, tmp_path / "none")).count() == 0
    odd = [*[(i % 3 or None, t) for i, t in enumerate(BLANK)], (1, "tie tie tie"), (1, "tie tie tie"), (None, "x " * 5000)]
    pages = [(None, None, None), (1, "http://a.org/es/", "<p>x"), (1, "http://a.org/es/", "<p>x"), (2, "", "")]
    folder = tables(spark, tmp_path / "odd", documents=documents(odd), labels=[(1, None, 1), (None, 1, 0), (2, 1, 0)], benchmark=[(None, None), (1, ""), (2, "tie tie tie"), (2, "tie tie tie")], pages=pages)
    out = queries.QUERIES[name](spark, folder)
    n = len(out.collect())
    assert n == {"op3_decontamination": 1, "op4_license_scan": 0}.get(name, len(pages) if name in ("op5_url_rules", "op6_html_text") else len(odd)), (name, n)
    assert out.where(F.lit(True)).columns
