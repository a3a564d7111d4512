"""The pipeline's stages against brute force on a small corpus with planted cases."""

from __future__ import annotations

import random

import pytest


def test_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("an the ing ou er es da lo mi".split()) for _ in range(3))
    clean = [" ".join(word() for _ in range(rng.randint(40, 90))) for _ in range(60)]
    toxic = [" ".join(sorted([word() for _ in range(50)] + ["grubword", "vilestem", "grubwords"], key=lambda _: rng.random())) for _ in range(40)]
    item = " ".join(word() for _ in range(30))
    texts = clean + toxic
    copy = clean[5].split()
    copy[20] = "other"
    near, leak, private = len(texts), len(texts) + 1, len(texts) + 2
    texts += [" ".join(copy), clean[6] + " x " + item + " y", "write to jo@mail.example.com " + clean[7][::-1]]
    texts += [None, ""]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(0, 100, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    want = set(range(len(texts))) - set(range(60, 100))
    left = [want, want - {near}, want - {near, leak}, want - {near, leak}, want - {near, leak}]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids == left[k], name
        if k < 4:
            assert docs.columns == pipeline.COLUMNS
        if name == "personal_data":
            got = {r.doc_id: r for r in docs.collect()}
            assert got[private].text.startswith("write to <EMAIL> ") and got[private].n_chars == len(got[private].text)
            assert all(got[i].text == texts[i] for i in left[k] - {private})
    assert docs.where("doc_id = 0").first().n_tokens > 40
    assert docs.where("n_tokens = 0").count() == 2


def test_rows_that_share_an_id_are_judged_one_by_one(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("an the ing ou er es da lo mi".split()) for _ in range(3))
    a, b, c, d, e, item = (" ".join(word() for _ in range(60)) for _ in range(6))
    near = " ".join(["other", *a.split()[1:]])
    rows = [(None, b), (None, item + " x"), (None, c), (None, c), (3, a), (3, a), (5, near), (5, d), (7, item), (7, e), (8, None), (8, None), (None, ""), (None, "")]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shown = lambda df: sorted([(r.doc_id or 0, r.text or "") for r in df.collect()])
    left = pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    assert left.columns == pipeline.COLUMNS
    assert shown(left) == sorted([(0, b), (0, item + " x"), (0, c), (3, a), (5, d), (7, e), (8, ""), (8, ""), (0, ""), (0, "")])
    clean = pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert shown(clean) == sorted([(r[0] or 0, r[1] or "") for r in rows if not (r[1] or "").startswith(item)])


def test_every_stage_on_odd_and_empty_tables(spark, tmp_path):
    """Null ids, texts and other columns, empty and very long texts, ties, repeated rows; and tables without rows."""
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("an the ing ou er es da lo mi".split()) for _ in range(4))
    a, b, item, long = (" ".join(word() for _ in range(n)) for n in (70, 70, 30, 20_000))
    rows = [(None, a, None, None, None), (None, b, "en", "s", 1), (1, a, "en", "s", 5), (1, a, "en", "s", 5), (2, None, None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0), (4, long, "en", "s", 9), (5, item + " " + b[:40], "en", "s", 2), (6, "tie tie", "en", "s", 7), (7, "tie tie", "en", "s", 7), (8, " \n\t", "en", "s", 3), (9, "mail x@y.org " + word(), "en", "s", 3)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("odd", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame([(None, 1, 1), (4, None, None), (1, 1, 0)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(0, item), (0, None), (None, "")] if some else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs, left = spark.createDataFrame(some, kinds), {}
        for k, (stage, run) in enumerate(pipeline.STAGES):
            docs = run(spark, docs, str(folder))
            docs.write.parquet(f"{folder}/stage{k}")
            docs = spark.read.parquet(f"{folder}/stage{k}")
            left[stage] = docs.collect()
        if not some:
            assert not any(left.values())
            continue
        shown = lambda stage: sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in left[stage])  # noqa: B023, E731
        key = lambda r: (-1 if r[0] is None else r[0], r[1] or "")
        assert shown("toxicity") == sorted(map(key, rows))
        near = [r for r in rows if (r[0], r[1]) not in ((1, a), (7, "tie tie"))]  # a stays once, with the smallest id; rows without words all stay
        assert shown("near_duplicates") == sorted(map(key, near))
        assert shown("decontamination") == sorted(map(key, [r for r in near if r[0] != 5]))
        assert [r.text for r in left["personal_data"] if r.doc_id == 9][0].startswith("mail <EMAIL> ") and len(left["personal_data"]) == len(near) - 1
        assert len(left["bpe"]) == len(near) - 1 and all((r.n_tokens == 0) == (not r.ids) for r in left["bpe"])
