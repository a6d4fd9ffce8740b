"""N-gram Jaccard self-join by chosen paths.

Documents with the same set of word shingles form a class, represented once. Classes are split recursively on sampled
shared tokens: at each node a few coordinates of a minwise sketch are drawn (1 / threshold of them on average), and classes
that share the token sampled there go on together. Small buckets are compared by brute force, large ones are split again;
what is still large at the last depth is compared in tiles. Independent runs repeat this until the target recall. Every link
is verified on the whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import U64, chunks, join_hot, map_rows, mix64, named, shared_checkpoint, table, word_hashes
from tickloom.llm.graph import components

#: Words of a shingle and the least similarity of a link.
WORDS, THRESHOLD = 5, 0.8
#: Coordinates of a sketch, classes that a bucket may hold to be compared at once, depth of the recursion, share of links at the threshold to be found.
COORDINATES, BUCKET, DEPTH, RECALL = 64, 64, 4, 0.999
#: Runs over one sketch at most.
MOST_RUNS = 256
#: Classes and shingles of a tile's side (on average, as tiles are dealt by hash), and columns of shingles that a tile multiplies at once.
TILE_ROWS, TILE_SHINGLES, TILE_COLUMNS = 512, 1 << 20, 4096

_PLACE = mix64(np.arange(1, 17, dtype=U64))
_DRAW = mix64(np.arange(101, 101 + COORDINATES, dtype=U64)) | U64(1)
_SIDE = mix64(np.arange(1001, 1003, dtype=U64))


def shingle_hashes(texts: list[str | None], words: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first, shingle hashes, sizes) for runs of texts: each text's distinct shingles in ascending order.

    Words are runs of characters other than ASCII white space, in lower case. A text of fewer words is one shingle of all of
    them; a text without words has none.
    """
    for first, raw, offsets in chunks(texts):
        hashes, starts, _ = word_hashes(raw)
        n = len(offsets) - 1
        doc = np.searchsorted(offsets, starts, side="right") - 1
        count = np.bincount(doc, minlength=n)
        m = max(0, len(hashes) - words + 1)
        value = np.zeros(m, dtype=U64)
        for k in range(words):
            value += hashes[k : k + m] * (_PLACE[k] | U64(1))
        inside = doc[:m] == doc[words - 1 : words - 1 + m]
        value, owner = mix64(value[inside]), doc[:m][inside]
        ends = np.cumsum(count)
        short = np.flatnonzero((count > 0) & (count < words))
        if len(short):
            extra = np.array([(hashes[ends[d] - count[d] : ends[d]] * (_PLACE[: count[d]] | U64(1))).sum(dtype=U64) + U64(count[d]) for d in short], dtype=U64)
            value, owner = np.concatenate((value, mix64(extra))), np.concatenate((owner, short))
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        fresh = np.ones(len(value), dtype=bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        yield first, value[fresh], np.bincount(owner[fresh], minlength=n)


def sketches(texts: list[str | None], words: int = WORDS) -> tuple[list[bytes], list[int], list[bytes]]:
    """For each text a 128-bit name of its shingle set, the set's size, and its minwise sketch (COORDINATES 32-bit values)."""
    names, sizes, minima = [], [], []
    for _, value, size in shingle_hashes(texts, words):
        full = np.flatnonzero(size)
        starts = (np.cumsum(size) - size)[full]
        name = np.zeros((len(size), 2), dtype=U64)
        low = np.zeros((len(size), COORDINATES), dtype=np.uint32)
        if len(full):
            for k in range(2):
                name[full, k] = np.add.reduceat(mix64(value ^ _SIDE[k]), starts)
            for k in range(COORDINATES):
                low[full, k] = np.minimum.reduceat(value * _DRAW[k], starts) >> U64(32)
        names += [row.tobytes() for row in name]
        sizes += size.tolist()
        minima += [row.tobytes() for row in low]
    return names, sizes, minima


def survival(threshold: float, depth: int, agreement: float | None = None) -> float:
    """Chance that a pair whose sketches agree in a share of the coordinates (the threshold's at default) is still together after
    depth splits of a run."""
    second, chance, agreement = min(1.0, 1 / threshold - 1), 1.0, threshold if agreement is None else agreement
    for _ in range(depth):
        once = agreement * chance
        chance = (1 - second) * once + second * (1 - (1 - once) ** 2)
    return chance


def _agreements(threshold: float) -> list[float]:
    """Chance of each number of coordinates in which the sketches of a pair at the threshold agree."""
    return [math.comb(COORDINATES, a) * threshold**a * (1 - threshold) ** (COORDINATES - a) for a in range(COORDINATES + 1)]


def least_agreement(recall: float, threshold: float) -> int:
    """Coordinates in which the sketches of a candidate must agree: a pair at the threshold agrees in fewer with a chance of at most a
    hundredth of what the recall leaves to be missed."""
    chances = _agreements(threshold)
    return max(a for a in range(COORDINATES + 1) if sum(chances[:a]) <= (1 - recall) / 100)


def recall_of(runs: int, threshold: float, depth: int, least: int = 0) -> float:
    """Chance that runs over the same sketch find a pair at the threshold: the mean over the coordinates in which its sketches agree.

    Where they agree in fewer than least, the pair is no candidate and counts as missed.
    """
    missed = [1.0 if a < least else (1 - survival(threshold, depth, a / COORDINATES)) ** runs for a in range(COORDINATES + 1)]
    return 1 - sum(p * m for p, m in zip(_agreements(threshold), missed, strict=True))


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs that find a pair at the threshold with a chance of recall, pairs that are no candidates counted as missed."""
    least = least_agreement(recall, threshold)
    if recall >= recall_of(MOST_RUNS, threshold, depth, least):
        raise ValueError(f"{MOST_RUNS} runs over {COORDINATES} coordinates do not reach a recall of {recall}")
    return next(r for r in range(1, MOST_RUNS + 1) if recall_of(r, threshold, depth, least) >= recall)


def _children(paths: np.ndarray, low: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and paths of the children of nodes, none twice: one drawn coordinate each, and another one with the chance that
    makes 1 / threshold on average (a second draw of the same coordinate moves on to the next)."""
    rows = np.arange(len(paths))
    one = (mix64(paths ^ _PLACE[8]) % U64(COORDINATES)).astype(np.int64)
    two = (mix64(paths ^ _PLACE[9]) % U64(COORDINATES)).astype(np.int64)
    two = np.where(two == one, (two + 1) % COORDINATES, two)
    more = (mix64(paths ^ _PLACE[10]) >> U64(40)).astype(np.float64) / (1 << 24) < 1 / threshold - 1
    rows, drawn = np.concatenate((rows, rows[more])), np.concatenate((one, two[more]))
    return rows, mix64(mix64(paths[rows] + drawn.astype(U64) * _PLACE[11]) ^ low[rows, drawn].astype(U64))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), COORDINATES)


def _split(frontier: DataFrame, runs: int, threshold: float) -> DataFrame:
    """Children of the nodes (set_id, n, low, path): set_id, n, path. A null path stands for the roots of all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix64(np.arange(runs, dtype=U64) ^ _PLACE[12])
        for batch in batches:
            ids, sizes, low = batch.column(0), batch.column(1), _matrix(batch.column(2))
            if batch.column(3).null_count:
                nodes = [(np.full(len(ids), r, dtype=U64), np.arange(len(ids))) for r in roots]
            else:
                nodes = [(np.asarray(batch.column(3)).view(U64), np.arange(len(ids)))]
            for paths, at in nodes:
                rows, new = _children(paths, low[at], threshold)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), sizes.take(pa.array(rows)), pa.array(new.view(np.int64))], names=["set_id", "n", "path"])

    return frontier.select("set_id", "n", "low", "path").mapInArrow(run, "set_id binary, n int, path long")


def _close(leaves: DataFrame, threshold: float, least: int) -> DataFrame:
    """Pairs a < b of the small leaves' members (array g of structs set_id, n, low, big) that the sketches don't rule out.

    A pair is ruled out when its sketches agree in fewer coordinates than least, when the sizes alone keep it below the
    threshold, or when it shares a large leaf, where its tile counts it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            members, offsets = lists.flatten(), np.asarray(lists.offsets)
            offsets = offsets - offsets[0]
            ids, sizes = members.field("set_id").to_pylist(), np.asarray(members.field("n"), dtype=np.float64)
            low, big = _matrix(members.field("low")), members.field("big").to_pylist()
            left, right = [], []
            for start, end in zip(offsets[:-1], offsets[1:], strict=True):
                m, s = low[start:end], sizes[start:end]
                agree = sum((m[:, None, k] == m[None, :, k]).astype(np.int16) for k in range(COORDINATES)) if end - start > 12 else (m[:, None, :] == m[None, :, :]).sum(axis=2)
                i, j = np.nonzero(np.triu((agree >= least) & (np.minimum(s[:, None], s[None, :]) >= threshold * np.maximum(s[:, None], s[None, :])), 1))
                for x, y in zip((i + start).tolist(), (j + start).tolist(), strict=True):
                    if big[x] and big[y] and not set(big[x]).isdisjoint(big[y]):
                        continue
                    left.append(min(ids[x], ids[y]))
                    right.append(max(ids[x], ids[y]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    return leaves.mapInArrow(run, "a binary, b binary").distinct()


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of each set of a with each of b, as products of blocks of an incidence matrix."""
    everything = [*a, *b]
    flat = np.concatenate(everything) if everything else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(everything)), [len(x) for x in everything])
    _, column, uses = np.unique(flat, return_inverse=True, return_counts=True)
    shared = uses[column] > 1
    row, (names, column) = row[shared], np.unique(column[shared], return_inverse=True)
    total = np.zeros((len(a), len(b)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, len(names), TILE_COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + TILE_COLUMNS))
        block = np.zeros((len(everything), min(TILE_COLUMNS, len(names) - first)), dtype=np.float32)
        block[row[lo:hi], column[lo:hi] - first] = 1.0
        total += block[: len(a)] @ block[len(a) :].T
    return np.rint(total).astype(np.int64)


def _tile(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one pair of tiles of a large leaf: for each class the documents linked, and the class that heads its links here.

    A pair is counted in the first large leaf that both its classes are in.
    """
    first, later = part[part["side"] == 0], part[part["side"] == 1]
    alone = bool(part["i"].iloc[0] == part["j"].iloc[0])
    later = first if alone else later
    if not len(first) or not len(later):
        return pd.DataFrame({"set_id": [], "links": [], "to": []})
    path = int(part["path"].iloc[0])
    common = _common(first["shingles"].to_list(), later["shingles"].to_list())
    n, m = first["n"].to_numpy(), later["n"].to_numpy()
    linked = common >= threshold * (n[:, None] + m[None, :] - common) - 1e-9
    before = [[p for p in big if p < path] for big in first["big"]]
    after = [[p for p in big if p < path] for big in later["big"]]
    for p in {p for big in before for p in big} & {p for big in after for p in big}:
        mine, theirs = np.array([p in b for b in before]), np.array([p in b for b in after])
        linked &= ~(mine[:, None] & theirs[None, :])
    if alone:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    everyone = first if alone else pd.concat([first, later])
    j = j if alone else j + len(first)
    copies = everyone["copies"].to_numpy(dtype=np.float64)
    links = np.bincount(i, copies[j], minlength=len(everyone)) + np.bincount(j, copies[i], minlength=len(everyone))
    root = np.arange(len(everyone))
    while len(i):
        new = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero(links > 0)
    ids = everyone["set_id"].to_numpy()
    return pd.DataFrame({"set_id": ids[some], "links": links[some].astype(np.int64), "to": ids[root[some]]})


def similar_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of word shingles: one row for each row of df.

    Columns: doc_id, text_hash (xxhash64 of the text), n_shingles, n_links, class_id, kept. n_links counts the other rows linked
    directly, equal texts included; class_id is the smallest doc_id of those reachable by links, and kept marks the row with
    that doc_id (of several, those with the smallest text hash; repeated rows of it are all marked).

    Null counts as empty. Texts without words have no shingles: they link with each other and with nothing else. A null doc_id
    comes after all others, and class_id is null only where a group has no other. An empty table gives an empty table. Long texts
    are compared whole. Other columns of df, whatever their names, are not read.
    Classes at the threshold are compared with a chance of at least recall, taken over the sketches and the runs, those above it more
    often; no link below it is returned.
    """
    rows = map_rows(df.select(named(doc_id).alias("doc_id"), F.xxhash64(named(text)).alias("text_hash"), named(text).alias("text")), ["doc_id", "text_hash"], ["text"], "set_id binary, n int, low binary", lambda t: (None, *sketches(t, words)), rows=512)
    rows = shared_checkpoint(rows)
    head = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = rows.groupBy("set_id").agg(F.count("*").alias("copies"), F.min(head).alias("head"), F.first("n").alias("n"), F.first("low").alias("low"))
    classes = shared_checkpoint(classes)

    # the recursion: small holds the leaves to compare at once, large those left at the last depth
    runs = runs_for(recall, threshold, depth)
    frontier, small, large = classes.where("n > 0").select("set_id", "n", "low", F.lit(None).cast("long").alias("path")), None, None
    for level in range(1, depth + 1):
        nodes = shared_checkpoint(_split(frontier, runs, threshold))
        sizes = nodes.groupBy("path").agg(F.count("*").alias("size"), F.sum("n").alias("shingles_in")).where("size > 1")
        nodes = shared_checkpoint(join_hot(nodes, sizes, ["path"], "size", nodes.count()))
        leaves = nodes.where(F.col("size") <= bucket)
        small = leaves if small is None else small.unionByName(leaves)
        large = nodes.where(F.col("size") > bucket)
        frontier = large.select("set_id", "path").join(classes.select("set_id", "n", "low"), "set_id")
    big = large.groupBy("set_id").agg(F.sort_array(F.collect_list("path")).alias("big"))

    # candidates of the small leaves
    described = classes.select("set_id", "n", "low", "copies").join(big, "set_id", "left")
    gathered = small.select("path", "set_id").join(described, "set_id").groupBy("path").agg(F.collect_list(F.struct("set_id", "n", "low", F.coalesce("big", F.array().cast("array<long>")).alias("big"))).alias("g"))
    pairs = shared_checkpoint(_close(gathered.select("g"), threshold, least_agreement(recall, threshold)))

    # whole shingle sets of the classes that take part
    needed = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).unionByName(large.select("set_id")).distinct()
    wanted = needed.join(classes, "set_id").select("set_id", "n", "copies", F.col("head.doc_id").alias("rep_id"), F.col("head.text_hash").alias("rep_hash"))
    reps = df.select(named(doc_id).alias("id"), named(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    # by both, since one text may stand in many rows
    found = reps.join(wanted.hint("merge"), (F.col("hash") == F.col("rep_hash")) & F.col("id").eqNullSafe(F.col("rep_id")))

    def whole(texts: list[str | None]) -> tuple:
        lists = []
        for _, value, size in shingle_hashes(texts, words):
            lists += np.split(value.view(np.int64), np.cumsum(size)[:-1])
        return None, lists

    sets = map_rows(found, ["set_id", "n", "copies"], ["text"], "shingles array<long>", whole, rows=128)
    sets = shared_checkpoint(sets.groupBy("set_id").agg(F.first("n").alias("n"), F.first("copies").alias("copies"), F.first("shingles").alias("shingles")))

    # exact similarity of the candidates
    side = lambda c: sets.select(F.col("set_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("copies").alias(f"copies_{c}"), F.col("shingles").alias(f"s_{c}"))
    measured = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    verified = shared_checkpoint(measured.where(F.col("common") >= union * threshold - 1e-9).select("a", "b", "copies_a", "copies_b"))
    both = F.explode(F.array(F.struct(F.col("a").alias("set_id"), F.col("copies_b").alias("links"), F.col("b").alias("to")), F.struct(F.col("b").alias("set_id"), F.col("copies_a").alias("links"), F.col("a").alias("to"))))
    links = verified.select(both.alias("x")).select("x.set_id", "x.links", "x.to")

    # tiles of the large leaves
    tiles = F.ceil(F.greatest(F.col("size") / TILE_ROWS, F.col("shingles_in") / TILE_SHINGLES)).cast("int")
    placed = large.select("path", "set_id", tiles.alias("tiles")).withColumn("t", F.pmod(F.xxhash64("set_id"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("path", "set_id", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), (F.col("t") > F.col("u")).cast("int").alias("side"))
    placed = placed.join(sets.join(big, "set_id").hint("merge"), "set_id")
    tiled = placed.groupBy("path", "i", "j").applyInPandas(lambda part: _tile(part, threshold), "set_id binary, links long, to binary")
    links = shared_checkpoint(links.unionByName(tiled))

    joined = components(links.select(F.hex("set_id").alias("a"), F.hex("to").alias("b")))
    grouped = classes.select("set_id", "copies", "head", F.hex("set_id").alias("node")).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = grouped.groupBy("component").agg(F.min("head").alias("chief"), F.count("*").alias("rows"))
    counts = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    answer = join_hot(grouped, heads, ["component"], "rows", classes.count(), by=["set_id"]).join(counts, "set_id", "left").select("set_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "chief")
    chosen = F.col("doc_id").eqNullSafe(F.col("chief.doc_id")) & (F.col("text_hash") == F.col("chief.text_hash"))
    total = classes.agg(F.sum("copies")).first()[0] or 0
    return join_hot(rows.select("doc_id", "text_hash", "set_id", "n"), answer, ["set_id"], "copies", total).select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), "n_links", F.col("chief.doc_id").alias("class_id"), chosen.alias("kept"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and number of links of each whole document."""
    return similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")
