"""The registered queries of this subpackage and the SQL that computes the same rows, where SQL can."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contamination, html, licenses, neardup, pii, quality, substrings, toxicity, urls
from .shared import Words, load

# --- 1: BPE -----------------------------------------------------------------------------------------------------------


def _digest_ids(own: bpe.Coder, batch: pa.RecordBatch, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    decoded = own.decode(ids, bounds)
    shown = [str(i) for i in range(len(own.tokenizer.pieces))]
    flat, cuts = ids.tolist(), bounds.tolist()
    digests = [hashlib.sha256(",".join([shown[i] for i in flat[a:b]]).encode()).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays(
        [batch.column(batch.schema.get_field_index("doc_id")), pa.array(np.diff(bounds)), pa.array(digests, type=pa.string()), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], type=pa.string())],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def op1_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Number of ids, digest of the ids and digest of the decoded text of every document."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.encode(docs, tokenizer, bpe.build_lexicon(docs, tokenizer), _digest_ids, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


# --- 2: toxicity ------------------------------------------------------------------------------------------------------


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and verdict of every document; the model is fitted on labelled documents first."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", "expected_severity", "grade", "p_toxic", "is_toxic")


# --- 3: benchmark decontamination -------------------------------------------------------------------------------------


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the shared part of its shingles."""
    return contamination.contaminated(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "benchmark", "item_id", "text"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), bg AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM b WHERE len(w) > 0)
), q AS (SELECT item_id, count(*) AS q FROM bg GROUP BY item_id),
dg AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bg) WHERE len(w) >= k)
)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(q) AS n_shingles, count(*) / any_value(q) AS containment
FROM dg JOIN bg USING (k, g) JOIN q USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(q) - 1e-9
"""

# --- 4: license scans -------------------------------------------------------------------------------------------------


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice of every document, with the bytes saved and the differences in wording."""
    return licenses.scan(load(spark, sf_dir, "documents", "doc_id", "text"))


# --- 5: url rules -----------------------------------------------------------------------------------------------------

#: Fixed values of the query: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning rule and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(load(spark, sf_dir, "pages", "page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM s JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT s.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN fit USING (page_id)
"""

# --- 6: main text of pages --------------------------------------------------------------------------------------------


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = html.main_text(load(spark, sf_dir, "pages", "page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# --- 7: quality rules -------------------------------------------------------------------------------------------------


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality.quality(load(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in sorted({w for ws in quality.STOP_WORDS.values() for w in ws}))
OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM tri) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS stops,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets,
         len(list_filter(ls, lambda x: ends_with(rtrim(x), '...') OR ends_with(rtrim(x), '…'))) AS dots
  FROM l LEFT JOIN rep USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 15.0 AND n_symbols / n_words <= 0.1 AND stops / n_words >= 0.02
       AND n_dup_lines / n_lines <= 0.3 AND bullets / n_lines <= 0.9 AND dots / n_lines <= 0.3 AS kept
FROM f
"""

# --- 8: substring de-duplication --------------------------------------------------------------------------------------


def _digest_kept(batch: pa.RecordBatch, words: Words, removed: np.ndarray) -> pa.RecordBatch:
    kept = substrings.kept_texts(words, removed)
    total = np.concatenate(([0], np.cumsum(removed.astype(np.int64))))
    return pa.RecordBatch.from_arrays(
        [batch.column(1), pa.array(np.diff(words.first)), pa.array(np.diff(total[words.first])), pa.array([hashlib.sha256(k).hexdigest() for k in kept], type=pa.string())],
        names=["doc_id", "n_words", "n_removed", "kept_sha256"],
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document and the digest of what stays."""
    return substrings.dedup_substrings(load(spark, sf_dir, "documents", "doc_id", "text"), 20, _digest_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)
), twice AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, s + o AS p FROM twice, (SELECT unnest(range(0, 20)) AS o)
), word AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

# --- 9: personal data -------------------------------------------------------------------------------------------------


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, digest of the base spans, all spans and their number of every document."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    found = pii.spans(docs, pii.fit(docs))
    return found.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS], F.sha2(pii.listing("base"), 256).alias("base_sha256"), pii.listing("span").alias("spans"), sum((F.size(f"span_{k}") for k in pii.KINDS[1:]), F.size(f"span_{pii.KINDS[0]}")).cast("long").alias("n_spans"))


# --- 10: near duplicates ----------------------------------------------------------------------------------------------


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return neardup.near_duplicates(load(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_url_rules": op5_url_rules,
    "op6_html_text": op6_html_text,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_pii": op9_pii,
    "op10_minhash_neardup": op10_minhash_neardup,
}
ORACLES = {"op3_decontamination": OP3_SQL, "op5_url_rules": OP5_SQL, "op7_quality_rules": OP7_SQL, "op8_substring_dedup": OP8_SQL}
