"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification, in DataFrame operations only.

Words are runs of letters and digits, lower-cased; shingles are ``SHINGLE`` words (an item of fewer words has one shingle, of
all its words). A document holds an item if at least ``THRESHOLD`` of the item's distinct shingles occur in it.

Items are parted by size: part p has items of 2^p to 2^(p+1)-1 shingles. Each part has its own hash order, and an item's
sketch is its s smallest shingles in it, s = floor((1 - t)(2^(p+1) - 1)) + 1. At containment t at most (1 - t) of an item's
shingles are missing, so that at least one of s sketch shingles is in the document: the search loses nothing, however long
the document is (a MinHash of the document itself would be swamped by its other shingles). Documents with too few words for
a part skip it. Candidates are then verified: all shingles of the candidate documents against all shingles of the items,
word for word.

The search is one scan without a shuffle of texts: shingles are hashed in generated code and probed against a
broadcast table of sketches; benchmarks of more than ``BROADCAST_ROWS`` sketch shingles are joined by a shuffle instead.

Defined results: null or empty texts and items match nothing; an item that repeats an id is judged for each of its texts and
the best containment is kept; rows that repeat a document id likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

SHINGLE, THRESHOLD = 5, 0.8
#: Rows of a table of item shingles that may be broadcast (some hundred bytes each).
BROADCAST_ROWS = 200_000


def plain_words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _at(words: str, k: int) -> list[Column]:
    return [F.get(words, F.col("i") + j) if j else F.get(words, F.col("i")) for j in range(k)]


def item_shingles(items: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item, item_id, k, q, gram, h): the distinct shingles of every item text; item numbers the texts, q counts an item's shingles."""
    texts = items.select(F.col("item_id"), plain_words(F.col("text")).alias("words")).where(F.size("words") > 0).withColumn("item", F.xxhash64("item_id", "words"))
    texts = texts.withColumn("k", F.least(F.size("words"), F.lit(shingle)))
    rows = texts.select("item", "item_id", "k", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("k"))).alias("i"))
    rows = rows.select("item", "item_id", "k", F.array_join(F.expr("slice(words, i + 1, k)"), " ").alias("gram")).distinct()
    sizes = rows.groupBy("item").agg(F.count(F.lit(1)).alias("q"))
    return rows.join(sizes, "item").withColumn("h", F.xxhash64("gram"))


def _grams(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(key..., n, k, gram) of every k words of a document, for all lengths k in one pass; docs has words."""
    least = min(lengths)
    rows = docs.where(F.size("words") >= least).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("words") - least))).withColumn("n", F.size("words"))
    gram = lambda k: F.struct(F.lit(k).alias("k"), F.concat_ws(" ", *_at("words", k)).alias("gram"))
    if len(lengths) == 1:
        return rows.withColumn("g", gram(least)).select("*", "g.k", "g.gram").drop("words", "i", "g")
    rows = rows.withColumn("g", F.explode(F.array(*[F.when(F.col("i") + k <= F.col("n"), gram(k)) for k in lengths]))).where("g is not null")
    return rows.select("*", "g.k", "g.gram").drop("words", "i", "g")


def _bounded(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of every document and item that it holds."""
    whole = written(item_shingles(items, shingle), "item-shingles")
    shape = whole.groupBy("k").agg(F.count(F.lit(1)).alias("rows")).collect()  # five rows at most
    total = sum(r["rows"] for r in shape)
    part = F.floor(F.log2("q")).cast("int")
    size = F.floor((1 - F.lit(threshold) + 1e-9) * (F.pow(F.lit(2.0), F.col("part") + 1) - 1)) + 1
    ranks = whole.withColumn("part", part).groupBy("item", "item_id", "part").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("gram", "part").alias("order"), "h"))).alias("all"))  # one item's shingles
    sketch = ranks.select("item", "part", F.explode(F.slice("all", F.lit(1), size.cast("int"))).alias("x"))
    sketch = written(sketch.select("item", "part", F.col("x.h").alias("h")).distinct(), "item-sketches")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = texts.withColumn("key", F.xxhash64("text"))
    words = texts.select("doc_id", "key", plain_words(F.col("text")).alias("words"))
    probe = _bounded(sketch, total)
    lengths = sorted(r["k"] for r in shape)
    if not lengths:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("false").withColumns({"item_id": F.lit(None).cast(items.schema["item_id"].dataType), "n_shared": F.lit(0).cast("long"), "n_shingles": F.lit(0).cast("long"), "containment": F.lit(0.0)})
    grams = _grams(words, lengths).withColumn("h", F.xxhash64("gram"))
    found = grams.join(probe, "h").where(F.col("n") - F.col("k") + 1 >= F.floor(F.lit(threshold) * F.pow(F.lit(2.0), "part"))).select("doc_id", "key", "item")
    candidates = written(found.distinct(), "contamination-candidates")
    pick = candidates.select("doc_id", "key").distinct()
    near = texts.alias("t").join(pick.alias("p"), F.expr("t.doc_id <=> p.doc_id and t.key = p.key"), "left_semi")
    near = written(near.select("doc_id", "key", plain_words(F.col("text")).alias("words")).distinct(), "contamination-texts")
    full = _bounded(whole.select("h", F.col("gram").alias("of"), "item", "item_id", "q"), total)
    shared = _grams(near, lengths).withColumn("h", F.xxhash64("gram")).join(full, "h").where("gram = of").select("doc_id", "key", "item", "item_id", "q", "gram")
    counts = shared.distinct().groupBy("doc_id", "key", "item", "item_id", "q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.lit(threshold) * F.col("q") - 1e-9)
    c = candidates.select(F.col("doc_id").alias("c_doc"), F.col("key").alias("c_key"), F.col("item").alias("c_item"))
    sure = counts.join(c, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("key") == F.col("c_key")) & (F.col("item") == F.col("c_item")), "left_semi")
    best = sure.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n") / F.col("q")).alias("containment"), "n", "q")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n").alias("n_shared"), F.col("b.q").alias("n_shingles"), F.col("b.containment").alias("containment"))
