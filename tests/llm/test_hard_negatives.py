"""Hard negatives against brute force in plain Python: the query, small tiles and two waves, ties, large numbers, edge cases."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.llm import hard_negatives

FIXTURE = "/root/testdata/sf0.001"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute_force(rows, every, n_positives=5, n_negatives=3, low=50, high=95):
    """rows of (id, label, whole-number vector)."""
    rows = [r for r in rows if None not in r and None not in r[2]]
    out = collections.Counter()
    clip = lambda x: max(-hard_negatives.MOST, min(hard_negatives.MOST, x))
    for key, label, v in {(k, str(x), tuple(v)) for k, x, v in rows if k % every == 0}:
        scores = sorted((-clip(sum(a * b for a, b in zip(v, w, strict=True))), k, str(x)) for k, x, w in rows if len(w) == len(v))
        for minus, positive, _ in [s for s in scores if s[2] == label and s[1] != key][:n_positives]:
            found = [s for s in scores if s[2] != label and low * -minus <= 100 * -s[0] <= high * -minus][:n_negatives]
            for rank, (other, negative, _) in enumerate(found, 1):
                out[key, positive, rank, negative, -minus, -other] += 1
    return out


def result(df):
    assert df.columns == NAMES
    return collections.Counter(map(tuple, df.collect()))


def test_query_by_brute_force(spark):
    rows = []
    for r in spark.read.parquet(f"{FIXTURE}/embeddings.parquet").collect():
        if r.embedding is not None and r.label is not None and all(x is not None and math.isfinite(x) for x in r.embedding):
            rows.append((r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [math.floor(256 * x) for x in r.embedding]))
    want = brute_force(rows, 50)
    assert want and result(hard_negatives.op13_hard_negatives(spark, FIXTURE)) == want


@pytest.mark.parametrize("tile,anchors,block,buckets", [(16, 3, 4, 1024), (64, 8, 16, 3), (8192, 2048, 512, 1024)])
def test_tiles_waves_ties_and_copies(spark, monkeypatch, tile, anchors, block, buckets):
    for name, value in (("TILE_ROWS", tile), ("TILE_ANCHORS", anchors), ("BLOCK_ROWS", block), ("BUCKETS", buckets)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(5)
    rows = [(k, rng.choice("aab"), [rng.randrange(-3, 9) * (1 + k % 4) for _ in range(3)]) for k in range(400)]
    rows += [(1000 + k, "c", [4, 4, 4]) for k in range(150)]  # one common vector
    rows += [(7, "a", [9, 9, 9])] * 4 + [(500, "b", [5, 5, 5])] * 2 + [(500, "a", [5, 5, 5]), (600, "b", [1, 2]), (601, "a", [2, 1]), (602, "b", [2, 2])]
    rows += [(None, "a", [9, 9, 9]), (8, None, [9, 9, 9]), (9, "a", None), (11, "a", [None, 9, 9]), (650, "z", [0, 0, 0]), (700, "b", [0, 0, 0])]
    df = spark.createDataFrame(rows, "vec_id long, label string, v array<long>").selectExpr("*", "1 as bucket", "2 as turn", "3 as anchor", "4 as id", "5 as norm").repartition(5)
    want = brute_force(rows, 25)
    assert want and result(hard_negatives.mine(df, F.expr("vec_id % 25 = 0"))) == want
    assert result(hard_negatives.mine(df, F.expr("vec_id % 25 = 0"), n_positives=2, n_negatives=7, low=0, high=100)) == brute_force(rows, 25, 2, 7, 0, 100)


def test_large_numbers_are_exact(spark):
    rng = random.Random(6)
    for size in (2**30, 2**40, 2**62):
        rows = [(k, k % 3, [rng.randrange(-size, size), rng.randrange(-size, size)]) for k in range(60)]
        df = spark.createDataFrame(rows, "vec_id long, label int, v array<long>")
        assert result(hard_negatives.mine(df, F.expr("vec_id % 4 = 0"))) == brute_force(rows, 4)


def test_components_and_empty_tables(spark):
    rows = [(0, 1, [0.5, -0.001]), (1, 1, [float("nan"), 1.0]), (2, 1, [float("inf"), 1.0]), (3, 1, None), (4, None, [1.0, 1.0]), (5, 1, [1e300, 0.0]), (6, 1, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<double>")
    kept = df.where(hard_negatives.usable("v", "label", "vec_id")).select("vec_id", hard_negatives.scaled("v").alias("v")).collect()
    assert {r.vec_id: r.v for r in kept} == {0: [128, -1], 5: [2**63 - 1, 0], 6: []}
    whole = df.selectExpr("vec_id", "label", "transform(v, x -> 1L) v")
    assert result(hard_negatives.mine(whole, F.lit(True))) == collections.Counter()
    assert result(hard_negatives.mine(whole.limit(0), F.lit(True))) == collections.Counter()
