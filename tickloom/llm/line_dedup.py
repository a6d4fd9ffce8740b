"""Line dedup by distinct-site spread, in DataFrame functions only.

A line that stands on many sites is boilerplate. A HyperLogLog sketch of the sites of each line hash, merged by
aggregation, gives the spread; lines near the threshold get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import join_hot, named, shared_checkpoint, table, without

#: Sites from which on a line is boilerplate, and characters that it needs to count as a line at all.
MIN_SITES, MIN_CHARS = 6, 20
#: Logarithm of the sketch's registers; estimates within this factor of the threshold are counted exactly (over 8 standard errors).
LG_K, BAND = 10, 1.3
#: The two halves of a line's 128-bit key.
KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    """What makes two lines the same: lower case, white space (spaces, tabs, carriage returns) at the ends left out."""
    return F.lower(F.btrim(line, F.lit(" \t\r")))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line of docs(text, ...) long enough: the other columns, pos (from 0) and the key's halves."""
    every = docs.select(*without(docs, "text"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.length("line") >= min_chars)
    keyed = every.withColumn("line", line_key(F.col("line"))).where(F.length("line") >= min_chars)
    # the second hash must not go through the first, or lines that share one would share both
    return keyed.withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(1), "line")).drop("line")


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Keys of lines(k1, k2, site) whose sketch does not rule out min_sites sites: k1, k2, sites (estimate), rows."""
    spread = lines.groupBy(*KEY).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.count("*").alias("rows"))
    return spread.where(F.col("sites") >= min_sites / BAND)


def without_lines(lines: Column, gone: Column) -> Column:
    """lines without those at the positions gone (from 0, distinct): the stretches between two neighbouring positions, in one walk."""
    ends = F.concat(F.array(F.lit(-1)), F.array_sort(gone), F.array(F.size(lines)))

    def stretches(s: Column) -> Column:
        between = lambda k: F.slice(s["lines"], F.get(s["ends"], k - 1) + 2, F.get(s["ends"], k) - F.get(s["ends"], k - 1) - 1)
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(s["ends"]) - 1), between))

    # the arrays are bound by an outer lambda, since an expression inside one is evaluated for each element
    return F.transform(F.array(F.struct(lines.alias("lines"), ends.alias("ends"))), stretches)[0]


def drop_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """Remove lines that stand on at least min_sites sites, but for their first document.

    Returns the columns of docs with the text rewritten, and n_lines and n_removed after them. The document with the smallest
    id (then MD5 of the text) keeps such a line, so each passage stays in the corpus once. Rows equal in id and text are one
    document and are treated alike; one id with two texts is two documents; a null id comes after all others. A null site is a
    site of its own. Lines shorter than min_chars characters are never removed. A null text stays null with 0 lines; an empty
    text has one empty line. Texts of any length are split whole. An empty table stays empty. Columns of docs named n_lines or
    n_removed are replaced; no other name clashes.
    """
    whole = F.struct(*(named(c) for c in without(docs, "n_lines", "n_removed")))
    # what tells documents apart, in the order in which they come first
    document = F.struct(named(doc_id).isNull().alias("no_id"), named(doc_id).alias("id"), F.md5(F.coalesce(named(text), F.lit(""))).alias("hash"))
    texts = docs.select(document.alias("doc"), F.coalesce(named(site).cast("string"), F.lit("\1")).alias("site"), named(text).alias("text"))
    spread = shared_checkpoint(spread_lines(_lines(texts.select("site", "text"), min_chars), min_sites))
    near = F.col("sites") <= min_sites * BAND
    total = spread.agg(F.sum("rows")).first()[0] or 0
    hits = join_hot(_lines(texts, min_chars), spread.select(*KEY, "rows", near.alias("near")), KEY, "rows", total)
    hits = shared_checkpoint(hits)
    # one row a site where sites are to be counted, else one a key; both are combined before the shuffle
    by_site = hits.groupBy(*KEY, "near", F.when(F.col("near"), F.col("site")).alias("of")).agg(F.min("doc").alias("keep"), F.count("*").alias("n"))
    known = by_site.groupBy(*KEY).agg(F.min("keep").alias("keep"), F.sum("n").alias("n"), F.when(~F.first("near") | (F.count("*") >= min_sites), True).alias("wide"))
    known = shared_checkpoint(known.where("wide").drop("wide"))
    gone = join_hot(hits.select("doc", "pos", *KEY), known, KEY, "n", total).where(~F.col("doc").eqNullSafe(F.col("keep")))
    gone = shared_checkpoint(gone.groupBy("doc").agg(F.collect_set("pos").alias("gone")))
    joined = docs.select(whole.alias("row"), document.alias("doc")).alias("d").join(
        gone.alias("g").hint("merge"), (F.col("d.doc.id").eqNullSafe(F.col("g.doc.id"))) & (F.col("d.doc.hash") == F.col("g.doc.hash")), "left"
    )
    old = F.col("row").getField(text)
    lines = F.split(old, "\n")
    kept = F.array_join(without_lines(lines, F.col("gone")), "\n")
    return joined.select(
        *[(F.when(F.col("gone").isNull(), old).otherwise(kept) if c.lower() == text.lower() else F.col("row").getField(c)).alias(c) for c in without(docs, "n_lines", "n_removed")],
        F.when(old.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole document with its cross-site boilerplate lines removed."""
    return drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


OP10_SQL = f"""
WITH l AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS h, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents),
k AS (SELECT doc_id, source, h, pos, lower(trim(line, ' ' || chr(9) || chr(13))) AS key FROM l
      WHERE length(line) >= {MIN_CHARS} AND length(lower(trim(line, ' ' || chr(9) || chr(13)))) >= {MIN_CHARS}),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS LAST, h) AS turn FROM k),
b AS (SELECT key, any_value(doc_id) FILTER (turn = 1) AS keep, any_value(h) FILTER (turn = 1) AS keep_h
      FROM o GROUP BY key HAVING count(DISTINCT coalesce(source, chr(1))) >= {MIN_SITES}),
g AS (SELECT doc_id, h, list(DISTINCT pos) AS gone FROM k JOIN b USING (key) WHERE doc_id IS DISTINCT FROM keep OR h <> keep_h GROUP BY doc_id, h)
SELECT d.doc_id, d.source,
       CASE WHEN g.gone IS NULL THEN d.text ELSE
         array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.gone, i)), chr(10)) END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
       coalesce(len(g.gone), 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND md5(coalesce(d.text, '')) = g.h
"""
