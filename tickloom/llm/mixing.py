"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed 60-bit hash. For each source the words are summed by hash bucket; the bucket in which
the running sum crosses the source's budget is split again by the next bits, and last by all bits, so that one hash value is left.
The documents whose hash lies below that value are taken, without any sort of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import join_hot, named, shared_checkpoint, table, without

#: Hex digits of the hash, and digits that count after each refinement: 4096 buckets, 4096 within the boundary bucket, and what is left in that.
HASH_DIGITS, STEPS = 15, (3, 6, 15)
#: A document is taken at most this often.
MAX_REPEATS = 3
#: Tables of one row a source are broadcast up to this many rows (some MB); beyond, those of the large sources are, and the others are joined by a shuffle.
BROADCAST_SOURCES = 50_000
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of matches of [^\\x20\\x09-\\x0D]+ (null: 0): every run becomes one letter, spaces go."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Add rank, the place of each row of sources(source, ...) in code-point order, null last, from 0.

    Rows are dealt by ranges and numbered within each; only the number of rows of each range, one row a partition, is summed
    in one place.
    """
    order = F.col("source").asc_nulls_last()
    dealt = shared_checkpoint(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.withColumn("place", place).join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.col("place")).drop("part", "place", "offset")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Budget of each source of sizes(source, source_size): columns source, source_size, target.

    Sources in code-point order (null last) take the weights in turn and share the total size in proportion to them; a target
    stops at max_repeats times the size, and the excess is shared by the others until none is above. A target so is
    min(max_repeats * size, level * weight), where a source that is full at one level stays full at the next. Sources with equal
    ratios of size to weight fill together. Empty sources get 0. Other columns of sizes pass.
    """
    others = [c for c in sizes.columns if c not in ("source", "source_size")]
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    full = F.col("source_size") * float(max_repeats)
    shares = shared_checkpoint(ranked(sizes).select("source", "source_size", *others, weight.alias("weight"), full.alias("full")))
    level, before = 0.0, None
    while True:
        open_ = F.col("full") > level * F.col("weight")
        sums = shares.agg(F.sum("source_size").alias("all"), F.sum(F.when(~open_, F.col("full"))).alias("filled"), F.sum(F.when(open_, F.col("weight"))).alias("weight"), F.count(F.when(~open_, 1)).alias("n")).first()
        if sums["weight"] is None or sums["n"] == before:
            break
        level, before = ((sums["all"] or 0) - (sums["filled"] or 0.0)) / sums["weight"], sums["n"]
    return shares.select("source", "source_size", *others, F.least(F.col("full"), F.lit(level) * F.col("weight")).alias("target"))


def thresholds(slim: DataFrame, budgets: DataFrame, few: bool = False) -> DataFrame:
    """Hash value of each source below which documents get one repeat more: columns key, base, cut.

    slim(key, size, digits) has a hash of HASH_DIGITS hex digits; budgets is of targets(), with key and docs (rows of slim). base is the number of
    whole repeats; cut is null where nothing remains to be taken beyond them. At the last digit the boundary value is
    taken if that brings the sum nearer to the budget. few: there are so few sources that their rows may be broadcast. Histograms
    are combined before the shuffle; each step reads only the documents of the boundary buckets of the step before.
    """
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    goal = budgets.select("key", "docs", whole.alias("base"), (F.col("target") - whole * F.col("source_size")).alias("rest"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below"))
    total = 0 if few else slim.count()
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    for digits in STEPS:
        bounds = goal.select("key", "prefix", "docs")
        inside = slim.join(F.broadcast(bounds), "key") if few else join_hot(slim, bounds, ["key"], "docs", total)
        histogram = inside.where(F.col("digits").startswith(F.col("prefix"))).groupBy("key", F.substring("digits", 1, digits).alias("bucket")).agg(F.sum("size").alias("words"))
        sums = histogram.withColumn("under", F.coalesce(F.sum("words").over(before), F.lit(0)))
        last = goal.drop("words", "prefix")
        sums = sums.join(F.broadcast(last) if few else last, "key")
        # the boundary: the last bucket that begins within the budget
        found = sums.where(F.col("below") + F.col("under") <= F.col("rest")).groupBy("key", "docs", "base", "rest").agg(
            F.max_by(F.struct(F.col("bucket").alias("prefix"), (F.col("below") + F.col("under")).alias("below"), "words"), "bucket").alias("b")
        )
        goal = shared_checkpoint(found.select("key", "docs", "base", "rest", "b.prefix", "b.below", "b.words"))
    near = F.abs(F.col("below") + F.col("words") - F.col("rest")) < F.abs(F.col("rest") - F.col("below"))
    return goal.select("key", "base", F.when(near, F.concat("prefix", F.lit("~"))).otherwise(F.col("prefix")).alias("cut"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Choose how often each document is taken, so that sources meet their target weights.

    Returns the columns of docs and, after them, mix_size, mix_source_size, mix_target and mix_repeats. The hash is of the
    document's id and text, so reruns agree; rows equal in both are taken together. Null and empty texts have size 0 and
    0 words taken; they get the repeats of their hash all the same. Long texts count whole. A null source is a source of its own,
    a null id hashes as an empty one. An empty table gives an empty table. Columns of docs with those four names are replaced;
    no other name clashes.
    """
    made = ["mix_size", "mix_source_size", "mix_target", "mix_repeats"]
    kept = without(docs, *made)
    digits = F.substring(F.md5(F.concat_ws("|", named(doc_id).cast("string"), F.md5(F.coalesce(named(text), F.lit(""))))), 1, HASH_DIGITS)
    key = F.coalesce(F.concat(F.lit("="), named(source).cast("string")), F.lit(""))  # null is a source too
    rows = docs.select(F.struct(*map(named, kept)).alias("row"), named(source).alias("source"), key.alias("key"), word_count(named(text)).alias("size"), digits.alias("digits"))
    slim = shared_checkpoint(rows.drop("row"))
    sizes = slim.groupBy("source", "key").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    budgets = shared_checkpoint(targets(sizes, weights, max_repeats))
    few = budgets.count() <= BROADCAST_SOURCES
    cuts = thresholds(slim.drop("source"), budgets, few)
    plan = budgets.drop("source").join(F.broadcast(cuts) if few else cuts, "key", "left")
    joined = rows.join(F.broadcast(plan), "key") if few else join_hot(rows, plan, ["key"], "docs", slim.count(), by=["digits"])
    once = F.when(F.col("digits") < F.col("cut"), 1).otherwise(0)
    return joined.select(
        *(F.col("row").getField(c).alias(c) for c in kept),
        F.col("size").alias("mix_size"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        F.least(F.lit(max_repeats), F.coalesce("base", F.lit(0)) + once).cast("long").alias("mix_repeats"),
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document of the whole table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_repeats")).alias("taken"), F.col("mix_repeats").alias("repeats")
    )


OP4_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         substr(md5(concat_ws('|', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT min_by(lev, ratio) FROM l WHERE lev <= ratio) * weight, cap)) AS target FROM l),
g AS (SELECT *, coalesce(CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT END, 0) AS base FROM t),
b AS (SELECT d.source, d.h, sum(d.size) AS words FROM d GROUP BY d.source, d.h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) - words AS below FROM b),
k AS (SELECT c.source, max_by(h, h) AS cut, max_by(words, h) AS words, max_by(below, h) AS below, any_value(target - base * source_size) AS rest
      FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source WHERE below <= target - base * source_size GROUP BY c.source)
SELECT d.doc_id, d.size, g.source_size, g.target,
       d.size * least(3, g.base + CASE WHEN d.h < k.cut OR d.h = k.cut AND abs(k.below + k.words - k.rest) < abs(k.rest - k.below) THEN 1 ELSE 0 END)::BIGINT AS taken,
       least(3, g.base + CASE WHEN d.h < k.cut OR d.h = k.cut AND abs(k.below + k.words - k.rest) < abs(k.rest - k.below) THEN 1 ELSE 0 END)::BIGINT AS repeats
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
