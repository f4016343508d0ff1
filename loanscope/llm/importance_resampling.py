"""Importance resampling towards a target distribution over hashed word runs.

A text's features are its runs of 1 to ``order`` consecutive words, repeats counted; each falls into one of ``buckets`` by the CRC-32 of its
bytes. The gain of a bucket is the scaled log ratio of its smoothed share in the target texts and in all documents; a document's weight
is the floored mean gain of its features. Gumbel noise seeded by the document id turns the weights into a sample without
replacement: the highest scores are drawn.

Texts are cut into lines at newlines, which no word contains. Lines are grouped over the whole corpus (tasks count their own lines
first, so a line that a third of all documents share is one row of a task), the features of each distinct line are counted once, and
multiplied by how often the line occurs. Runs that cross a line break are added separately: only the last words of a line and
the first ones of the lines after it take part, whatever the lengths of the lines. A document's gains are the sum over its lines, joined by a
128-bit hash of the line (a hot line is a skewed side that adaptive execution splits), and over its crossing runs.

What reaches the driver: one number for each bucket, and one for each shuffle partition of the ranking. Ranks are placed by range
partitions with offsets, never in one task; equal rows are ranked as one with a count.

Defined results: null and empty texts have no feature and weight 0; a null id draws its noise from the empty text and stands before all
other ids at equal scores; repeated rows have equal scores and follow one another in rank; without target texts or
documents the smoothed shares decide alone; further columns of the inputs are not read; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanscope.llm.common import shuffle_parts
from loanscope.session import staged

# What separates words, after A-Z are lower-cased (fixed values).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORDER = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), lambda w: w != "")


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def line_features(of: Column, order: int, buckets: int) -> Column:
    """Buckets of all runs of 1 to ``order`` words within an array of words."""
    def runs(k: int) -> Column:
        if k == 1:
            return F.transform(of, lambda w: bucket(w, buckets))
        last = F.size(of) - k
        return F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1),
                                             lambda i: bucket(F.array_join(F.slice(of, i, k), " "), buckets))).otherwise(F.array().cast("array<int>"))

    return F.concat(*(runs(k) for k in range(1, order + 1))) if order > 1 else runs(1)


def crossing_features(text: Column, order: int, buckets: int) -> Column:
    """Buckets of the runs that begin in one line and end in a later one.

    Each line break is looked at once: of the words before it the last ``order`` - 1, of those after it the first ones. A run belongs to
    the first break that it crosses, so its words before that break are all of one line.
    """
    ends = F.lit(order - 1)
    lines = F.filter(F.transform(F.split(text, "\n"), words), lambda w: F.size(w) > 0)
    # for every line but the first: the words that may follow its beginning, from it and the lines after it
    breaks = F.sequence(F.lit(1), F.size(lines) - 1)

    def at_break(i: Column) -> Column:
        line = F.element_at(lines, i)
        head = F.slice(line, F.greatest(F.size(line) - ends, F.lit(0)) + 1, ends)
        tail = F.slice(F.flatten(F.slice(F.transform(lines, lambda w: F.slice(w, 1, ends)), i + 1, ends)), 1, ends)
        both, n = F.concat(head, tail), F.size(head)
        return F.flatten(F.array(*(
            F.flatten(F.array(*(
                F.when((n >= before) & (F.size(tail) >= k - before),
                       F.array(bucket(F.array_join(F.slice(both, n - before + 1, k), " "), buckets))).otherwise(F.array().cast("array<int>"))
                for before in range(1, k)))) for k in range(2, order + 1))))

    return F.when(F.size(lines) > 1, F.flatten(F.transform(breaks, at_break))).otherwise(F.array().cast("array<int>"))


def distinct_lines(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """h1, h2, times, n_words, features (buckets) of every distinct line; times is how often it occurs."""
    lines = texts.filter(F.length("text") > 0).select(F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") > 0)
    counted = lines.groupBy("line").agg(F.count(F.lit(1)).alias("times")).withColumn("words", words(F.col("line")))
    return counted.select(*line_hash(F.col("line")), "times", F.size("words").cast("long").alias("n_words"),
                          line_features(F.col("words"), order, buckets).alias("features"))


def line_hash(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(SEED), line).alias("h2")


def crossing(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    return texts.filter(F.col("text").contains("\n")).withColumn("crossing", crossing_features(F.col("text"), order, buckets))


def histogram(texts: DataFrame, lines: DataFrame, order: int, buckets: int) -> DataFrame:
    """bucket, n over all texts: features of distinct lines times their occurrences, and crossing runs."""
    counts = lines.select(F.explode("features").alias("bucket"), "times")
    if order > 1:
        counts = counts.unionByName(crossing(texts, order, buckets).select(F.explode("crossing").alias("bucket"), F.lit(1).cast("long").alias("times")))
    return counts.groupBy("bucket").agg(F.sum("times").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain for every bucket, from two histograms."""
    n = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    all_buckets = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(n, "bucket", "left").fillna(0, ["s", "t"])
    totals = all_buckets.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return all_buckets.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def floored_mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, ((total - F.pmod(total, n)) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def noise(key: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs``."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    aims = target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = staged(distinct_lines(texts, order, buckets), "resampling-lines")
    found = gains(histogram(texts, lines, order, buckets), histogram(aims, distinct_lines(aims, order, buckets), order, buckets), buckets)
    # one constant: an array of so many literals would be slow to plan
    gain = F.split(F.lit(",".join(str(r.gain) for r in found.orderBy("bucket").collect())), ",").cast("array<bigint>")

    def summed(features: Column) -> Column:
        return F.aggregate(features, F.lit(0).cast("long"), lambda total, b: total + F.get(gain, b))

    scored = lines.select("h1", "h2", "n_words", F.size("features").cast("long").alias("n_features"), summed(F.col("features")).alias("gain"))
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    parts = rows.select("row", "doc_id", F.explode(F.split("text", "\n")).alias("line")).select("row", "doc_id", *line_hash(F.col("line")))
    counted = parts.join(scored, ["h1", "h2"], "left").select("row", "doc_id", "n_words", "n_features", "gain")
    if order > 1:
        across = crossing(rows, order, buckets)
        counted = counted.unionByName(across.select("row", "doc_id", F.lit(0).cast("long").alias("n_words"),
                                                    F.size("crossing").cast("long").alias("n_features"), summed(F.col("crossing")).alias("gain")))
    totals = counted.groupBy("row", "doc_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_features", "gain")))
    return totals.select("doc_id", "n_words", "n_features", floored_mean(F.col("gain"), F.col("n_features")).alias("weight"))


def resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
             percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null for rows that are not drawn."""
    weighed = weights(docs, target, order, buckets)
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("may", F.col("n_words") >= least_words)
    columns = ("doc_id", "n_features", "weight", "score")
    grouped = staged(scored.groupBy(*columns, "may").agg(F.count(F.lit(1)).alias("copies")), "resampling-scores")
    drawn = (grouped.filter("may").agg(F.sum("copies")).first()[0] or 0) * percent // 100
    ranked = first_ranks(grouped.filter("may"), [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features").asc()])
    others = grouped.filter("NOT may").withColumn("first", F.lit(None).cast("long"))
    each = ranked.unionByName(others).select(*columns, "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    rank = F.col("first") + F.col("copy")
    return each.select(*columns, F.when(rank <= drawn, rank).alias("rank"))


def first_ranks(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``first``, the rank of the first copy of each in the given order: ranges of rows, and offsets of the ranges."""
    spark = rows.sparkSession
    dealt = staged(rows.repartitionByRange(shuffle_parts(spark), *order).withColumn("range", F.spark_partition_id()), "resampling-ranges")
    sizes = {r[0]: r[1] for r in dealt.groupBy("range").agg(F.sum("copies")).collect()}
    offsets, total = [], 0
    for i in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(i, 0)
    before = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = F.sum("copies").over(before) - F.col("copies")
    return dealt.withColumn("first", within + F.get(F.lit(offsets or [0]), F.col("range")) + 1).drop("range")
