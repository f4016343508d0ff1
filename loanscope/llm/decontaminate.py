"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment search.

Items are partitioned by their number of distinct shingles. An item with ``n`` shingles is indexed by its ``k`` smallest
shingle hashes (its bottom-k MinHash sketch), where ``k`` belongs to its size partition: ``k`` is one more than the number of
shingles that an item of that partition can miss at the wanted containment. A document that contains the item therefore
has at least one shingle of the sketch (pigeonhole), so the candidate search loses nothing, whatever the document's length.
Candidates are then verified by exact containment of the shingles' words.

Words are runs of anything but white space with A-Z lower-cased; shingles have five words. A text of fewer words has one
shingle, its whole sequence; a text without words has none.

Only DataFrame functions are used. The index is joined without a hint: Catalyst broadcasts it where its files are small,
and shuffles hashes otherwise.

Defined results: null and empty texts contain nothing and are contained in nothing; repeated documents are reported each;
repeated items (same id) are one item with the shingles of all; rows with a null id are in no pair and are never dropped; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanscope.llm.url_filters import fold
from loanscope.session import staged

SHINGLE_WORDS = 5
CONTAINMENT = 0.8


def words(text: Column) -> Column:
    """Words of a text as an array; null reads as empty."""
    spaced = F.translate(fold(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def shingle_hashes(tokens: str, n: int = SHINGLE_WORDS) -> Column:
    """64-bit hash of every shingle of an array column, repeats included."""
    each = ", ".join(f"{tokens}[i + {j}]" for j in range(n))
    return F.expr(
        f"CASE WHEN size({tokens}) >= {n} THEN transform(sequence(0, size({tokens}) - {n}), i -> xxhash64({each})) "
        f"WHEN size({tokens}) > 0 THEN array(xxhash64({tokens})) ELSE CAST(array() AS array<bigint>) END")


def item_sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """item_id, size_class, hash: the bottom-k sketch of each item; size classes double."""
    hashed = items.select("item_id", words(F.col("text")).alias("w")).select(
        "item_id", F.array_sort(F.array_distinct(shingle_hashes("w"))).alias("h")).filter(F.size("h") > 0)
    partition = F.floor(F.log2(F.size("h").cast("double"))).cast("int")
    largest = F.pow(F.lit(2.0), partition + 1) - 1  # shingles of the largest item of the partition
    k = F.floor(largest * (1 - containment) + F.lit(1e-9)).cast("int") + 1
    return hashed.select("item_id", partition.alias("size_class"), F.explode(F.slice("h", F.lit(1), k)).alias("hash"))


def candidates(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id) that share a shingle of the item's sketch."""
    probes = docs.select("doc_id", words(F.col("text")).alias("w")).select(
        "doc_id", F.explode(shingle_hashes("w")).alias("hash"))
    return probes.join(sketches.select("item_id", "hash"), "hash").select("doc_id", "item_id").distinct()


def verify(docs: DataFrame, items: DataFrame, pairs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Exact containment of the candidate pairs that reach ``containment``."""
    item_shingles = staged(items.select("item_id", F.explode(shingles_of("text")).alias("shingle")).distinct()
                           .filter(F.col("item_id").isNotNull()), "item-shingles")
    sizes = item_shingles.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles"))
    wanted = pairs.join(item_shingles, "item_id")
    suspects = pairs.select("doc_id").distinct()
    found = docs.join(suspects, "doc_id", "left_semi").select("doc_id", F.explode(shingles_of("text")).alias("shingle"))
    hits = (found.join(wanted, ["doc_id", "shingle"]).groupBy("doc_id", "item_id")
            .agg(F.countDistinct("shingle").alias("n_found")))
    return (hits.join(sizes, "item_id")
            .filter(F.col("n_found") >= F.col("n_shingles") * F.lit(containment) - F.lit(1e-9))
            .select("doc_id", "item_id", "n_shingles", "n_found",
                    (F.col("n_found") / F.col("n_shingles")).alias("containment")))


def shingles_of(text: str) -> Column:
    """Distinct shingles of a text column, written so that the words are made once."""
    tokens = words(F.col(text))
    return F.flatten(F.transform(F.array(tokens), lambda w: _shingles_lambda(w)))


def _shingles_lambda(w: Column, n: int = SHINGLE_WORDS) -> Column:
    several = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))),
                          lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return F.when(F.size(w) > 0, F.array_distinct(several)).otherwise(F.array().cast("array<string>"))


def contamination(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment of every pair at or above ``containment``."""
    sketches = staged(item_sketches(items, containment), "item-sketches")
    pairs = staged(candidates(docs, sketches), "contamination-candidates")
    return verify(docs, items, pairs, containment)


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that contain no item, all their columns."""
    hits = staged(contamination(docs, items, containment).select("doc_id").distinct(), "contaminated")
    return docs.join(hits, "doc_id", "left_anti").select(docs.columns)
