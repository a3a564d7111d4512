"""From raw documents to training text: five stages, each an operator of ``fellpath.llm`` over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs has the columns of ``documents``. All but the last
return these columns; decisions take effect:

1. toxicity: documents that the ordinal model grades above 0 go;
2. near_duplicates: the smallest document of each class of near duplicates stays;
3. decontamination: documents that hold a benchmark item go;
4. personal_data: spans of personal data are replaced by their kind (n_chars follows the text);
5. bpe: texts become ids (doc_id, lang, source, ids, n_tokens).

Clean documents pass all stages unchanged. Ids may repeat or be null: stages 2 and 3 judge every text of an id by itself. Of a class
of near duplicates the text with the smallest id stays (null is the smallest), and one of the rows that have the same id and text;
rows without words are in no class, and all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellpath.llm import bpe, contamination, neardup, pii, toxicity
from fellpath.llm.shared import id_key, load, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model grades above 0 go; the model is fitted on the labelled documents among docs. A null text counts as clean."""
    model = toxicity.fit(docs, load(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs.select(*COLUMNS), model).where("not is_toxic").select(*COLUMNS)


def row_key():
    """A key for each id and text; only rows that are equal in both share it."""
    return F.xxhash64(id_key(), F.col("text").isNull(), F.col("text"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest id (null is the smallest) stays; rows without words all stay."""
    rows = docs.select(*COLUMNS)
    if rows.groupBy(id_key().alias("_key")).count().where("count > 1").isEmpty():
        classes = neardup.near_duplicates(docs.select("doc_id", "text"))
        gone = classes.where("not doc_id <=> class_id").select(id_key().alias("_key"))
        return rows.join(gone, id_key() == F.col("_key"), "left_anti")
    rows = rows.withColumn("_key", row_key())
    classes = neardup.near_duplicates(rows.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), F.col("class_id").alias("_class")).distinct()
    ids = rows.select("_key", id_key().alias("_id"), F.coalesce(F.col("text").rlike(neardup.WORD), F.lit(False)).alias("_words"))
    ids = written(ids.groupBy("_key").agg(F.min("_id").alias("_id"), F.max("_words").alias("_words"), F.count(F.lit(1)).alias("_n")).join(classes, "_key"), "near-rows")
    first = ids.groupBy("_class").agg(F.min(F.struct("_id", "_key")).alias("_first"))
    gone = ids.join(first, "_class").where("_key <> _first._key").select("_key")
    left = rows.join(gone, "_key", "left_anti")
    equal = ids.where("_n > 1 and _words").select("_key")
    one = left.join(equal, "_key", "left_semi").groupBy("_key").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("_row"))
    return left.join(equal, "_key", "left_anti").select(*COLUMNS).unionByName(one.select(*[f"_row.{c}" for c in COLUMNS]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go; items and texts without words match nothing."""
    hits = contamination.contaminated(docs.select(row_key().alias("doc_id"), "text"), load(spark, sf_dir, "benchmark", "item_id", "text"))
    gone = written(hits.select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return docs.select(*COLUMNS).join(gone, row_key() == F.col("_key"), "left_anti")


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become <KIND>, and n_chars of such rows the length of the new text; other rows stay as they are."""
    found = pii.spans(docs.select(*COLUMNS), pii.fit(docs))
    any_span = F.lit(False)
    for k in pii.KINDS:
        any_span = any_span | (F.size(f"span_{k}") > 0)
    out = found.withColumn("_hit", any_span).withColumn("text", F.when(F.col("_hit"), pii.masked(F.col("text"))).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("_hit"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens) of every row; a null text has no ids."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer, bpe.build_lexicon(docs, tokenizer))
    return ids.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("bpe", bpe_stage),
]

#: A fitted model, a similarity closure and merges by rank: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; between stages the rows are written as Parquet in the shared folder."""
    docs = load(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
