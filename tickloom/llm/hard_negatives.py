"""Hard negatives by norm-bucketed search.

Vectors are sorted by label and falling norm and cut into buckets. An anchor's score with any vector of a bucket is at most the
anchor's norm times the bucket's largest one (Cauchy-Schwarz), so a bucket that cannot reach the lower limit of the anchor's window, or
the last of the best scores found so far, is never visited. Buckets are visited from their largest norms on, in two waves, and within
a visit in blocks of falling norm under the same bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import named, shared_checkpoint, table

#: Vectors and numbers of a tile at most, anchors of a tile at most, vectors of a block, buckets at most (larger ones are cut into tiles).
TILE_ROWS, TILE_NUMBERS, TILE_ANCHORS, BLOCK_ROWS, BUCKETS = 8_192, 1 << 20, 2_048, 512, 1_024
#: The largest score, and the limits of windows without one.
MOST = (1 << 63) - 1
LOW, HIGH = -MOST, MOST
#: Sums of products up to this are exact in double precision.
EXACT = 2.0**53
#: What bounds are raised by, for the rounding of norms.
ROUNDING = 1 + 1e-9


def usable(vector: str, label: str, vec_id: str) -> Column:
    """Whether a row takes part: an id, a label, and a vector without null or non-finite components."""
    x = named(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.coalesce(named(vec_id).isNotNull() & named(label).isNotNull() & x.isNotNull() & ~bad, F.lit(False))


def scaled(vector: str, factor: int = 256) -> Column:
    """Components as whole numbers: floor(factor * x), x in double precision; beyond the range of a long they stop at its ends."""
    return F.transform(named(vector), lambda v: F.floor(F.lit(float(factor)) * v.cast("double")).cast("long"))


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact: doubles where every sum is, else Python's integers."""
    size = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0.0))
    if size(a) * size(b) * max(1, a.shape[1]) < EXACT:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return np.clip(a.astype(object) @ b.astype(object).T, -MOST, MOST)


class Best:
    """The best scores of each anchor's windows so far, best first, the ids that have them, and which places are taken."""

    def __init__(self, windows: int, places: int) -> None:
        self.taken = np.zeros((windows, places), dtype=bool)
        self.score, self.id = np.zeros((windows, places), dtype=np.int64), np.zeros((windows, places), dtype=np.int64)

    def offer(self, at: np.ndarray, taken: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge candidates (rows of places) into windows at: higher scores first, ties by smaller id."""
        taken, score, ids = (np.concatenate((old[at], new), axis=1) for old, new in ((self.taken, taken), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, ~taken), axis=1)[:, : self.taken.shape[1]]
        for old, new in ((self.taken, taken), (self.score, score), (self.id, ids)):
            old[at] = np.take_along_axis(new, order, axis=1)

    def last(self) -> np.ndarray:
        """The score that a newcomer must reach: that of the last place, LOW where it is free."""
        return np.where(self.taken[:, -1], self.score[:, -1], LOW)


def search_tile(anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], same: bool, places: int) -> Best:
    """Best rows of a tile for each anchor's window: of its own label and another id if same, else of other labels.

    anchors has id, label, norm, v, low, high and least (what a score must reach), rows has id, label, norm and v. Labels are
    numbers that both share.
    """
    best = Best(len(anchors["id"]), places)
    down = np.argsort(-rows["norm"], kind="stable")
    for first in range(0, len(down), BLOCK_ROWS):
        block = down[first : first + BLOCK_ROWS]
        bound = anchors["norm"] * rows["norm"][block[0]] * ROUNDING + 1
        open_ = np.flatnonzero(bound >= np.maximum(np.maximum(anchors["low"], anchors["least"]), best.last()).astype(np.float64))
        if not len(open_):
            continue
        block = block[np.argsort(rows["id"][block], kind="stable")]  # the first of equal scores then has the smallest id
        # windows of one anchor share its products
        vectors, which = np.unique(anchors["row"][open_], return_inverse=True)
        product = whole_products(anchors["vectors"][vectors], rows["v"][block])
        for part in range(0, len(open_), 1024):
            some = open_[part : part + 1024]
            score = product[which[part : part + 1024]]
            able = anchors["label"][some][:, None] == rows["label"][block][None]
            able = able & (anchors["id"][some][:, None] != rows["id"][block][None]) if same else ~able
            able &= (score >= np.maximum(anchors["low"], anchors["least"])[some][:, None]) & (score <= anchors["high"][some][:, None])
            left = np.where(able, score, -np.inf)
            taken, scores, ids = (np.zeros((len(some), places), dtype=t) for t in (bool, np.int64, np.int64))
            line = np.arange(len(some))
            for k in range(places):
                at = left.argmax(axis=1)
                taken[:, k] = able[line, at]
                if not taken[:, k].any():
                    break
                scores[:, k] = np.where(taken[:, k], score[line, at], 0).astype(np.int64)
                ids[:, k] = rows["id"][block[at]]
                left[line, at], able[line, at] = -np.inf, False
            best.offer(some, taken, scores, ids)
    return best


FOUND = "anchor long, slot long, score long, found_id long"


def visit(anchors: DataFrame, placed: DataFrame, pairs: list[tuple[int, int, int, int]], same: bool, places: int) -> DataFrame:
    """Best rows of each visited tile for each window: columns of FOUND. The caller takes the best over all tiles.

    pairs has (block of anchors, its tiles, bucket, its tiles); an anchor goes to a bucket only if its bound reaches what the window needs.
    A block's and a bucket's tiles meet as one task's work, so a task holds two tiles.
    """
    spark = anchors.sparkSession
    met = F.broadcast(spark.createDataFrame(pairs, "block int, block_tiles int, bucket int, bucket_tiles int"))  # at most BUCKETS ** 2 rows
    spread = lambda tiles: F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))
    top = placed.groupBy("bucket").agg(F.max("norm").alias("top"))
    bound = F.col("norm") * F.col("top") * ROUNDING + 1
    asked = anchors.join(met, "block").join(F.broadcast(top), "bucket").where(bound >= F.greatest("low", "least").cast("double"))
    asked = asked.withColumn("at", F.pmod(F.xxhash64("anchor"), "block_tiles").cast("int")).withColumn("bt", spread("bucket_tiles"))
    shown = placed.join(met, "bucket").withColumn("bt", F.pmod("turn", "bucket_tiles").cast("int")).withColumn("at", spread("block_tiles"))
    key = ["block", "at", "bucket", "bt"]
    nothing = F.lit(None).cast("long")
    both = asked.select(*key, F.lit(True).alias("asks"), "anchor", "slot", "id", "label", "norm", "v", "low", "high", "least").unionByName(
        shown.select(*key, F.lit(False).alias("asks"), nothing.alias("anchor"), nothing.alias("slot"), "id", "label", "norm", "v", *(nothing.alias(c) for c in ("low", "high", "least")))
    )
    schema = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])

    def compare(part: pa.Table) -> pa.Table:
        asks, shows = part.filter(part["asks"]), part.filter(pc.invert(part["asks"]))
        if not len(asks) or not len(shows):
            return schema.empty_table()
        labels = part["label"].combine_chunks().dictionary_encode()
        numbers = (labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels).indices.to_numpy()
        flag = part["asks"].to_numpy(zero_copy_only=False)
        vectors = lambda t: np.asarray(t["v"].combine_chunks().flatten()).reshape(len(t), -1)
        anchors = {c: asks[c].to_numpy() for c in ("id", "norm", "low", "high", "least")} | {"label": numbers[flag]}
        _, first, row = np.unique(asks["anchor"].to_numpy(), return_index=True, return_inverse=True)
        anchors |= {"row": row, "vectors": vectors(asks.take(pa.array(first)))}
        rows = {c: shows[c].to_numpy() for c in ("id", "norm")} | {"label": numbers[~flag], "v": vectors(shows)}
        best = search_tile(anchors, rows, same, places)
        window, place = np.nonzero(best.taken)
        return pa.table([asks["anchor"].to_numpy()[window], asks["slot"].to_numpy()[window], best.score[window, place], best.id[window, place]], schema=schema)

    return both.groupBy(*key).applyInArrow(compare, FOUND)


def ranked(found: DataFrame, places: int) -> DataFrame:
    """The best places rows of each window, with rank from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= places)


def tiles_of(n: int, dim: int, most: int = 0) -> int:
    """Tiles that n vectors are cut into."""
    return max(1, math.ceil(n / max(1, min(most or TILE_ROWS, TILE_NUMBERS // max(1, dim)))))


def search(anchors: DataFrame, placed: DataFrame, buckets: list[dict], blocks: list[dict], same: bool, places: int) -> DataFrame:
    """The best places rows of each anchor's window over all buckets: columns of FOUND and rank.

    The first wave visits the buckets in which a label begins, which hold its largest norms; the second one visits the others, with the
    last of the best scores so far as what is to be reached.
    """
    waves: list[list[tuple[int, int, int, int]]] = [[], []]
    begins = [k == 0 or (b["dim"], b["label_low"]) != (b["dim"], b["label_high"]) or (buckets[k - 1]["dim"], buckets[k - 1]["label_high"]) != (b["dim"], b["label_low"]) for k, b in enumerate(buckets)]
    for block in blocks:
        for first, bucket in zip(begins, buckets, strict=True):
            meets = bucket["label_low"] <= block["label_high"] and block["label_low"] <= bucket["label_high"]
            alone = bucket["label_low"] == bucket["label_high"] == block["label_low"] == block["label_high"]
            if bucket["dim"] == block["dim"] and (meets if same else not alone):
                waves[not first].append((block["block"], block["tiles"], bucket["bucket"], bucket["tiles"]))
    best = ranked(visit(anchors, placed, waves[0], same, places), places)
    if waves[1]:
        best = shared_checkpoint(best)
        reach = best.where(F.col("rank") == places).select("anchor", "slot", F.col("score").alias("reach"))
        asked = anchors.join(reach, ["anchor", "slot"], "left").withColumn("least", F.greatest("least", F.coalesce("reach", F.lit(LOW)))).drop("reach")
        best = ranked(best.drop("rank").unionByName(visit(asked, placed, waves[1], same, places)), places)
    return best


def mine(df: DataFrame, anchors: Column, vector: str = "v", vec_id: str = "vec_id", label: str = "label", n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of the rows of df that the condition anchors chooses: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vector holds whole numbers (long), vec_id is a long, label of any type. Scores are inner products, higher ones come first, ties by
    smaller id. An anchor's positives are its first n_positives rows of the same label and another id; its negatives for each are the first n_negatives
    rows of another label with low * positive <= 100 * negative <= high * positive, so none where the positive score is negative.

    Rows with a null id, label, vector or component take no part. Only vectors of one dimension are compared. Repeated rows are
    rows of their own as positives and negatives, which they may all fill, but equal anchors are one; an id with several vectors or labels is
    several anchors. A score beyond the range of a long stops at its end. An empty table gives an empty table. Whatever the labels'
    sizes, a task holds one tile of anchors and one of rows, and hands on at most n_positives or n_negatives rows a window.
    """
    spark = df.sparkSession
    rows = df.where(usable(vector, label, vec_id)).select(named(vec_id).cast("long").alias("id"), named(label).cast("string").alias("label"), named(vector).cast("array<long>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = rows.select("*", F.size("v").alias("dim"), norm.alias("norm"), F.monotonically_increasing_id().alias("turn"))
    dims = rows.groupBy("dim").count().collect()
    n_buckets = min(BUCKETS, sum(tiles_of(r["count"], r["dim"]) for r in dims))
    # the running number parts rows alike in all else, so that copies never make a bucket large
    order = ["dim", "label", F.desc("norm"), "id", "turn"]
    placed = rows.repartitionByRange(max(1, n_buckets), *order).withColumn("part", F.spark_partition_id())
    placed = shared_checkpoint(placed)
    facts = placed.groupBy("dim", "part").agg(F.count("*").alias("n"), F.min("label").alias("label_low"), F.max("label").alias("label_high"), F.count_if("asks").alias("asking")).orderBy("dim", "part")
    # at most BUCKETS rows and one more a dimension; what a range of several dimensions holds of each is a bucket
    buckets = [r.asDict() | {"bucket": k, "block": None, "tiles": tiles_of(r.n, r.dim)} for k, r in enumerate(facts.collect())]
    blocks: list[dict] = []
    for b in buckets:  # neighbouring buckets' anchors form a block of a tile or less; a bucket with more is a block of several tiles
        if not b["asking"]:
            continue
        last = blocks[-1] if blocks else None
        if last and last["dim"] == b["dim"] and last["n"] + b["asking"] <= TILE_ANCHORS:
            last["n"], last["label_high"] = last["n"] + b["asking"], b["label_high"]
        else:
            last = {"block": len(blocks), "dim": b["dim"], "n": b["asking"], "label_low": b["label_low"], "label_high": b["label_high"]}
            blocks.append(last)
        b["block"] = last["block"]
    for k in blocks:
        k["tiles"] = tiles_of(k["n"], k["dim"], TILE_ANCHORS)
    made = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not blocks:
        return spark.createDataFrame([], made)
    numbered = spark.createDataFrame([(b["dim"], b["part"], b["bucket"], b["block"]) for b in buckets], "dim int, part int, bucket int, block int")
    placed = placed.join(F.broadcast(numbered), ["dim", "part"])
    asking = placed.where("asks").groupBy("id", "label", "v").agg(F.first("norm").alias("norm"), F.min("block").alias("block"))
    asking = shared_checkpoint(asking.withColumn("anchor", F.monotonically_increasing_id()))
    placed = placed.select("bucket", "id", "label", "norm", "v", "turn")
    open_ = [F.lit(x).cast("long").alias(c) for c, x in (("slot", 0), ("low", LOW), ("high", HIGH), ("least", LOW))]
    positives = shared_checkpoint(search(asking.select("*", *open_), placed, buckets, blocks, True, n_positives).select("anchor", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").cast("long").alias("slot")))
    part = lambda percent, more: F.expr(f"cast((cast(positive_score as decimal(38,0)) * {percent} + {more}) div 100 as long)")
    # positives of equal score share a window
    windows = positives.where("positive_score >= 0").groupBy("anchor", "positive_score").agg(F.min("slot").alias("slot"))
    windows = windows.select("anchor", "slot", part(low, 99).alias("low"), part(high, 0).alias("high"), F.lit(LOW).alias("least")).where("low <= high")
    negatives = search(asking.join(windows, "anchor"), placed, buckets, blocks, False, n_negatives)
    slots = Window.partitionBy("anchor", "positive_score")
    told = positives.withColumn("slot", F.min("slot").over(slots)).join(negatives.select("anchor", "slot", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "slot"])
    return told.join(asking.select("anchor", F.col("id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose id is divisible by 50; every seventh id counts under the next label."""
    rows = table(spark, sf_dir, "embeddings").where(usable("embedding", "label", "vec_id"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", moved.alias("label"), scaled("embedding").alias("v")), F.col("vec_id") % 50 == 0)
