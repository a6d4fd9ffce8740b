"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to unit length and rotated to their principal axes, so that the leading coordinates hold most of each
dot product. Tiles are ranges of the leading axes: a pair of tiles, and a vector against a tile, is given up where the tile's
ranges and its suffix norms keep every cosine below the threshold. The tiles left are compared by leading blocks of coordinates
first: the rest of a product is at most the product of the two suffix norms, so a pair is given up as soon as its cosine
cannot reach the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tickloom.llm.common import join_hot, named, shared_checkpoint, table, without
from tickloom.llm.graph import components

THRESHOLD = 0.9
#: Vectors and numbers of a tile at most, sides of the blocks in which a tile is worked, coordinates of a step.
TILE_ROWS, TILE_NUMBERS, BLOCK_ROWS, BLOCK_COLUMNS, STEP_DIMS = 16_384, 1 << 20, 512, 512, 8
#: Leading axes whose ranges bound a leaf, leaves at most, and vectors on which their cuts are fitted at most. The cuts change no result.
LEAD, LEAVES, SAMPLE = 8, 1_024, 16_384
#: Products this near to the threshold are computed again from the vectors as they came.
NEAR = 1e-9


def _arrays(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length of a list column, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def valid(vector: str):
    """Whether a vector can be linked at all: no null or non-finite component, and not zero."""
    x = named(vector)
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; scaling by the largest component first keeps very large and very small ones in range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(u: np.ndarray, v: np.ndarray) -> float:
    """Cosine of two vectors from sums without rounding errors; powers of two keep the products in range."""
    u, v = (x * 2.0 ** -math.frexp(np.abs(x).max())[1] for x in (u, v))
    return math.fsum(u * v) / math.sqrt(math.fsum(u * u) * math.fsum(v * v))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by dimension, from the sums of outer products of all unit vectors: columns by falling variance.

    vectors has columns dim and v. Each task sums one matrix a dimension; the driver gets dim**2 sums of each.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.asarray(batch.column(0))
            for d in np.unique(dims).tolist():
                u = unit(_arrays(batch.column(1).filter(pa.array(dims == d))))
                total[d] = total.get(d, 0) + u.T @ u
        for d, g in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, dtype=np.int32)), pa.array(np.arange(d * d, dtype=np.int64)), pa.array(g.ravel())], names=["dim", "cell", "x"])

    rows = vectors.select("dim", "v").mapInArrow(grams, "dim int, cell long, x double").groupBy("dim", "cell").agg(F.sum("x").alias("x")).toArrow().to_pandas()
    axes = {}
    for d, part in rows.groupby("dim"):
        g = np.zeros(d * d)
        g[part["cell"].to_numpy()] = part["x"].to_numpy()
        g = g.reshape(d, d)
        axes[int(d)] = np.linalg.eigh((g + g.T) / 2)[1][:, ::-1].copy()
    return axes


def block_links(a: np.ndarray, b: np.ndarray, rest_a: np.ndarray, rest_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b (rotated unit vectors) whose cosine is at least threshold, or so near below that it must be recomputed.

    Steps of STEP_DIMS coordinates are added for all pairs while many are open, and for the open pairs alone once they are
    few; a pair closes when its sum and the suffix norms (rest_a, rest_b: a column a step) cannot reach the threshold.
    """
    dims, floor = a.shape[1], threshold - NEAR
    total = np.zeros((len(a), len(b)))
    for step, k in enumerate(range(0, dims, STEP_DIMS)):
        total += a[:, k : k + STEP_DIMS] @ b[:, k : k + STEP_DIMS].T
        open_ = total >= floor - np.outer(rest_a[:, step], rest_b[:, step])
        if np.count_nonzero(open_) * 16 <= open_.size:
            break
    rows, columns = np.nonzero(open_)
    total = total[rows, columns]
    for later in range(step + 1, rest_a.shape[1]):
        if not len(rows):
            break
        k = later * STEP_DIMS
        total = total + np.einsum("ij,ij->i", a[rows, k : k + STEP_DIMS], b[columns, k : k + STEP_DIMS])
        held = total >= floor - rest_a[rows, later] * rest_b[columns, later]
        rows, columns, total = rows[held], columns[held], total[held]
    return rows, columns


def tile_links(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of two tiles of rotated unit vectors whose cosine is at least threshold, block by block.

    The rotation is orthogonal, so that cosines are the same as before it up to rounding; those near the threshold
    are summed again from the vectors as they came (raw_a, raw_b), exactly rounded.
    """
    ends = [min(a.shape[1], k + STEP_DIMS) for k in range(0, a.shape[1], STEP_DIMS)]
    rest = lambda x: np.stack([np.sqrt((x[:, end:] ** 2).sum(axis=1)) for end in ends], axis=1)
    rest_a, rest_b = rest(a), rest(b)
    for p in range(0, len(a), BLOCK_ROWS):
        for q in range(0, len(b), BLOCK_COLUMNS):
            x, y = a[p : p + BLOCK_ROWS], b[q : q + BLOCK_COLUMNS]
            i, j = block_links(x, y, rest_a[p : p + BLOCK_ROWS], rest_b[q : q + BLOCK_COLUMNS], threshold)
            if not len(i):
                continue
            total = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) for k in range(0, len(i), 65536)])
            for k in np.flatnonzero(np.abs(total - threshold) < NEAR):
                total[k] = cosine(raw_a[i[k] + p], raw_b[j[k] + q])
            linked = total >= threshold
            yield i[linked] + p, j[linked] + q


def _forest(rows: np.ndarray, columns: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n nodes with a link, its component's smallest node within these links (both ends numbered 0..n-1)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[rows], root[columns])
        new = root.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, columns, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    nodes = np.flatnonzero(root != np.arange(n))
    return nodes, root[nodes]


def tile_rows(dim: int) -> int:
    """Vectors of a tile at most."""
    return max(1, min(TILE_ROWS, TILE_NUMBERS // max(1, dim)))


def leading(x: np.ndarray) -> np.ndarray:
    """LEAD coordinates of rotated unit vectors (0 beyond their dimension) and the norm of the rest."""
    first = np.pad(x[:, :LEAD], ((0, 0), (0, max(0, LEAD - x.shape[1]))))
    return np.column_stack((first, np.sqrt((x[:, LEAD:] ** 2).sum(axis=1))))


def cut_leaves(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and cut of each inner node of a tree of 2**depth leaves (children of k are 2k + 1 and 2k + 2).

    A node is cut at the median of the sample's rows in it, on the axis along which they vary most.
    """
    axis, cut = np.zeros(2**depth - 1, dtype=np.int64), np.zeros(2**depth - 1)
    node = np.zeros(len(sample), dtype=np.int64)
    for k in range(2**depth - 1):
        some = sample[node == k]
        if len(some):
            axis[k] = some.var(axis=0).argmax()
            cut[k] = np.median(some[:, axis[k]])
        inside = np.flatnonzero(node == k)
        node[inside] = 2 * k + 1 + (sample[inside, axis[k]] > cut[k])
    return axis, cut


def leaf_of(lead: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Leaf of each row, from 0."""
    axis, cut = tree
    node = np.zeros(len(lead), dtype=np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (lead[np.arange(len(lead)), axis[node]] > cut[node])
    return node - len(axis)


def _gap(x: Column, low: Column, high: Column, k: int) -> Column:
    """Square of the distance of coordinate k to a range."""
    d = F.greatest(low[k] - x[k], x[k] - high[k], F.lit(0.0))
    return d * d


def near_duplicates(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", threshold: float = THRESHOLD) -> DataFrame:
    """Columns of df and n_links, component_id, kept, for cosine of at least threshold between any two vectors.

    Equal vectors are compared once, as a class of known size. Classes are dealt to leaves, ranges of the leading axes cut so
    that a leaf holds about one tile, and within large leaves to tiles by hash. Unit vectors linked at threshold t differ by
    at most sqrt(2 - 2t); so leaves farther apart in their leading axes and suffix norms are never paired, and a vector is
    sent only to leaves within that distance. A pair of tiles is one task's work, and hands on sums of links by class and a
    forest of links, never its pairs.

    n_links counts the other rows linked directly; component_id is the smallest vec_id reachable, kept is
    vec_id = component_id. Null vectors, zero vectors and vectors with null or non-finite components have no link and are
    their own component, as have vectors of a dimension of their own. A row with null vec_id counts as a link but is kept
    only if its component has no id (component_id null, kept true). Rows that repeat an id are rows of their own, and all are
    kept or none. vec_id may have any type that Spark can order. An empty table stays empty. Columns of df with the names of
    the results are replaced; no other name clashes.
    """
    spark = df.sparkSession
    kept = without(df, "n_links", "component_id", "kept")
    kind = "float" if isinstance(df.select(named(vector)).schema[0].dataType.elementType, FloatType) else "double"
    rows = df.select(F.struct(*map(named, kept)).alias("row"), named(vec_id).alias("id"), F.when(valid(vector), F.transform(named(vector), lambda v: v.cast(kind) + F.lit(0).cast(kind))).alias("v"))
    # the second hash must not go through the first, or vectors that share one would share both
    keys = [F.xxhash64("v").alias("key"), F.xxhash64(F.lit(1), "v").alias("key2")]
    classes = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("copies"), F.min("id").alias("low"))
    classes = shared_checkpoint(classes.select("v", F.size("v").alias("dim"), "copies", "low", *keys))
    axes = spark.sparkContext.broadcast(principal_axes(classes))  # dimension**2 numbers for each dimension

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(0))
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                lead = leading(unit(_arrays(part.column(1))) @ axes.value[d])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lead) + 1, dtype=np.int32) * (LEAD + 1)), pa.array(lead.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "lead"])

    turned = classes.select("dim", "v", "copies", "key", "key2").mapInArrow(rotate, f"dim int, v array<{kind}>, copies long, key long, key2 long, lead array<double>")
    turned = shared_checkpoint(turned)
    counts = {r["dim"]: r["count"] for r in turned.groupBy("dim").count().toLocalIterator()}
    sample = turned.select("dim", "lead", "key").orderBy("key", "dim").limit(SAMPLE).toArrow().to_pandas()
    trees = {}
    for d, n in counts.items():
        depth = math.ceil(math.log2(max(1, min(LEAVES, math.ceil(n / tile_rows(d))))))
        some = sample.loc[sample["dim"] == d, "lead"].to_list()
        trees[d] = cut_leaves(np.array(some).reshape(-1, LEAD + 1), depth)
    known = spark.sparkContext.broadcast(trees)  # at most LEAVES cuts for each dimension

    @F.pandas_udf("int")
    def leaf(dims: pd.Series, lead: pd.Series) -> pd.Series:
        out = np.zeros(len(dims), dtype=np.int32)
        at = dims.to_numpy()
        for d in np.unique(at).tolist():
            out[at == d] = leaf_of(np.stack(lead[at == d].to_list()), known.value[d])
        return pd.Series(out)

    placed = shared_checkpoint(turned.withColumn("leaf", leaf("dim", "lead")))
    ends = [f(F.col("lead")[k]).alias(f"{name}{k}") for k in range(LEAD + 1) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = placed.groupBy("dim", "leaf").agg(F.count("*").alias("n"), *ends).toPandas()
    boxes["tiles"] = [-(-n // tile_rows(d)) for d, n in zip(boxes["dim"], boxes["n"], strict=True)]
    reach = 2 - 2 * threshold + 1e-9
    near = []
    for d, part in boxes.groupby("dim"):
        low, high = (part[[f"{name}{k}" for k in range(LEAD + 1)]].to_numpy() for name in ("lo", "hi"))
        ids = part["leaf"].to_numpy()
        for k, one in enumerate(ids):
            gap = np.maximum(np.maximum(low - high[k], low[k] - high), 0.0)
            near += [(int(d), int(one), int(o)) for o in ids[(gap**2).sum(axis=1) <= reach]]
    near = spark.createDataFrame(near, "dim int, leaf int, other int")  # at most LEAVES**2 rows for each dimension
    names = ["dim", "leaf", "tiles", *(f"{name}{k}" for name in ("lo", "hi") for k in range(LEAD + 1))]
    leaves = spark.createDataFrame(boxes[names], ", ".join(f"{c} {'int' if k < 3 else 'double'}" for k, c in enumerate(names)))
    leaves = leaves.select("dim", "leaf", "tiles", *(F.array(*(f"{name}{k}" for k in range(LEAD + 1))).alias(name) for name in ("lo", "hi")))
    other = leaves.select("dim", F.col("leaf").alias("other"), F.col("tiles").alias("other_tiles"), "lo", "hi")

    sent = placed.join(F.broadcast(leaves.select("dim", "leaf", "tiles")), ["dim", "leaf"]).withColumn("t", F.pmod("key", "tiles").cast("int"))
    sent = sent.join(F.broadcast(near), ["dim", "leaf"]).join(F.broadcast(other), ["dim", "other"])
    sent = sent.where(sum(_gap(F.col("lead"), F.col("lo"), F.col("hi"), k) for k in range(LEAD + 1)) <= reach)
    sent = sent.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)))
    second = F.when(F.col("leaf") == F.col("other"), F.col("t") > F.col("u")).otherwise(F.col("leaf") > F.col("other"))
    mine, theirs = [F.col("leaf"), F.col("t")], [F.col("other"), F.col("u")]
    ends = [F.when(second, y).otherwise(x).alias(n) for x, y, n in zip([*mine, *theirs], [*theirs, *mine], ["a", "at", "b", "bt"], strict=True)]
    pairs = sent.select("dim", *ends, second.cast("int").alias("side"), "key", "key2", "copies", "v")

    def compare(part: pa.Table) -> pa.Table:
        head = part.slice(0, 1).to_pylist()[0]
        alone = (head["a"], head["at"]) == (head["b"], head["bt"])
        first, later = part.filter(pc.equal(part["side"], 0)), part.filter(pc.equal(part["side"], 1))
        everyone = first if alone else pa.concat_tables([first, later])
        if not len(first) or not (alone or len(later)):
            return schema.empty_table()
        raw = _arrays(everyone["v"])
        turned, m, n = unit(raw) @ axes.value[head["dim"]], len(first), len(everyone)
        copies, links, trees = everyone["copies"].to_numpy().astype(np.float64), np.zeros(n), []
        start = 0 if alone else m
        for i, j in tile_links(turned[:m], turned[start:], raw[:m], raw[start:], threshold):
            if alone:
                i, j = i[i < j], j[i < j]
            j = j + start
            links += np.bincount(i, copies[j], minlength=n) + np.bincount(j, copies[i], minlength=n)
            trees.append(_forest(i, j, n))  # at most one edge a row of the block
        node, root = _forest(*(np.concatenate(x) for x in zip(*trees, strict=True)), n) if trees else (np.empty(0, int), np.empty(0, int))
        to = np.arange(n)
        to[node] = root
        some = np.flatnonzero(links > 0)
        key, key2 = everyone["key"].to_numpy(), everyone["key2"].to_numpy()
        return pa.table([key[some], key2[some], links[some].astype(np.int64), key[to[some]], key2[to[some]]], schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in ("key", "key2", "links", "to", "to2")])
    found = shared_checkpoint(pairs.groupBy("dim", "a", "at", "b", "bt").applyInArrow(compare, "key long, key2 long, links long, to long, to2 long"))
    node = lambda a, b: F.concat(F.hex(F.col(a)), F.lit("-"), F.hex(F.col(b)))
    comps = components(found.select(node("key", "key2").alias("a"), node("to", "to2").alias("b")))
    linked = classes.select("key", "key2", "low", node("key", "key2").alias("node")).join(comps, "node")
    lows = linked.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("rows"))
    linked = join_hot(linked.select("key", "key2", "component"), lows, ["component"], "rows", comps.count()).select("key", "key2", F.struct("component_id").alias("linked"))
    counted = found.groupBy("key", "key2").agg(F.sum("links").alias("links"))
    answer = classes.select("key", "key2", "copies", "low").join(linked, ["key", "key2"], "left").join(counted, ["key", "key2"], "left")
    component = F.when(F.col("linked").isNotNull(), F.col("linked.component_id")).otherwise(F.col("low"))
    answer = answer.select("key", "key2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), component.alias("component_id"))
    total = classes.agg(F.sum("copies")).first()[0] or 0
    inside = join_hot(rows.where("v is not null").select("row", "id", *keys), answer, ["key", "key2"], "copies", total, by=["id"]).select("row", "id", "n_links", "component_id")
    outside = rows.where("v is null").select("row", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return inside.unionByName(outside).select(*(F.col("row").getField(c).alias(c) for c in kept), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")
