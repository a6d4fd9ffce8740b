"""Operators that compare rows with each other, against brute force."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import embedding_dedup, graph, line_dedup, mixing, ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- components -------------------------------------------------------------------------------------------------------


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    parent = list(range(2000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got.keys() == linked and all(got[x] == find(x) for x in linked)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- n-gram join ------------------------------------------------------------------------------------------------------


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (k, _) in enumerate(rows):
        low.setdefault(find(i), []).append(k)
    key = lambda k: (k is None, k or 0)
    return collections.Counter((k, links[i], min(low[find(i)], key=key)) for i, (k, _) in enumerate(rows))


def near_copies(n, words=120, groups=6, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(800)]
    rows = []
    for g in range(groups):
        base = list(rng.choice(vocabulary, words))
        for _ in range(n):
            text = list(base)
            for at in rng.integers(0, words, rng.integers(0, 5)):
                text[at] = str(rng.choice(vocabulary))
            rows.append(" ".join(text))
    return list(enumerate(rows))


def test_groups_equal_brute_force(spark):
    rows = near_copies(14) + [(1000 + k, " ".join(f"u{k}_{i}" for i in range(40))) for k in range(40)]
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collections.Counter((r.doc_id, r.n_links, r.class_id) for r in got.collect()) == brute_groups(rows)
    assert got.where("kept").count() == got.select("class_id").distinct().count()


def test_large_leaves_are_tiled(spark):
    rows = near_copies(90, groups=1, seed=1)
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), bucket=4, recall=0.9999999)
    assert collections.Counter((r.doc_id, r.n_links, r.class_id) for r in got.collect()) == brute_groups(rows)


def test_tiles_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 16)
    rows = near_copies(60, groups=1, seed=2)
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), bucket=4, recall=0.9999999)
    assert collections.Counter((r.doc_id, r.n_links, r.class_id) for r in got.collect()) == brute_groups(rows)


def test_groups_of_edge_rows(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = ngram_join.similar_groups(edge_docs).collect()
    assert collections.Counter((r.doc_id, r.n_links, r.class_id) for r in got) == brute_groups(rows)
    assert ngram_join.similar_groups(no_docs).count() == 0


def test_recall_of_runs():
    for depth in (1, 4):
        q = ngram_join.survival(0.8, depth)
        assert 0 < q < 1 and 1 - (1 - q) ** ngram_join.runs_for(0.999, 0.8, depth) >= 0.999


def test_recall_over_a_shared_sketch():
    runs, rng = ngram_join.runs_for(ngram_join.RECALL, 0.8, ngram_join.DEPTH), np.random.default_rng(4)
    agreement = rng.binomial(ngram_join.COORDINATES, 0.8, 200_000) / ngram_join.COORDINATES
    missed = np.mean([(1 - ngram_join.survival(0.8, ngram_join.DEPTH, a)) ** runs for a in agreement])
    assert missed <= 1 - ngram_join.RECALL


# --- embeddings -------------------------------------------------------------------------------------------------------


def brute_links(rows, threshold):
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if not (fine[i] and fine[j]) or len(rows[i][1]) != len(rows[j][1]):
                continue
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (k, _) in enumerate(rows):
        low.setdefault(find(i), []).append(k)
    least = {f: min((k for k in ks if k is not None), default=None) for f, ks in low.items()}
    return collections.Counter((k, links[i], least[find(i)], k == least[find(i)]) for i, (k, _) in enumerate(rows))


def vectors(n=260, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    rows = [(k, [float(x) for x in (centres[k % 8] + rng.normal(0, 0.25, dim)).astype(np.float32)]) for k in range(n)]
    odd = [(900, None), (901, [0.0] * dim), (902, [float("nan")] + [1.0] * (dim - 1)), (903, [None] + [1.0] * (dim - 1)), (904, [float("inf")] + [1.0] * (dim - 1)), (905, []), (906, rows[0][1]), (906, rows[0][1]), (907, [x * 3 for x in rows[1][1]]), (908, [1.0, 2.0]), (909, [1.0, 2.0]), (910, [5.0]), (None, rows[2][1]), (911, [3e38] * dim), (912, [1e-38] * dim)]
    return rows + odd


@pytest.mark.parametrize("tile", [4096, 32])
def test_links_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", tile)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n_links", F.lit("clash"))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = embedding_dedup.near_duplicates(df).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_links(rows, 0.9)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r)[2:] for r in embedding_dedup.near_duplicates(df).collect()] == [(0, 1, True)]


def test_products_at_the_threshold(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, threshold=0.8).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


# --- mixing -----------------------------------------------------------------------------------------------------------


def fill(sizes, weights=(5.0, 2.0, 1.0), most=3):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        total, over, free_now = sum(weight[s] for s in free), 0.0, set(free)
        for s in free_now:
            target[s] += left * weight[s] / total
        for s in free_now:
            if target[s] >= most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                free.discard(s)
        left = over
    return target


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(0)
    sources = ["a", "b", "c", "d", "é", None]
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 60))), "en", sources[int(s)], 0) for k, s in enumerate(rng.choice(6, 3000, p=[0.02, 0.5, 0.2, 0.1, 0.1, 0.08]))]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    size = collections.Counter()
    taken = collections.Counter()
    for r in got:
        assert r.mix_size == len((r.text or "").split()) and 0 <= r.mix_repeats <= 3
        size[r.source] += r.mix_size
        taken[r.source] += r.mix_size * r.mix_repeats
    want = fill(size)
    for r in got:
        assert r.mix_source_size == size[r.source] and abs(r.mix_target - want[r.source]) < 1e-6
    for s in sources:
        assert abs(taken[s] - want[s]) <= 60
    again = {(r.doc_id, r.mix_repeats) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.mix_repeats) for r in got}


def test_mix_of_edge_rows(spark, edge_docs, no_docs):
    got = mixing.mix(edge_docs).collect()
    assert len(got) == edge_docs.count() and all(r.mix_repeats <= 3 for r in got)
    assert mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, 0)], DOCS)
    assert [(r.mix_size, r.mix_target) for r in mixing.mix(blank).collect()] == [(0, 0.0), (0, 0.0)]
    same = spark.createDataFrame([(1, "a b c", "en", "a", 0)] * 5 + [(2, "d", "en", "b", 0)], DOCS)
    assert len({r.mix_repeats for r in mixing.mix(same).where("doc_id = 1").collect()}) == 1


# --- line dedup -------------------------------------------------------------------------------------------------------


def brute_lines(rows, min_sites=6, min_chars=20):
    sites, first = collections.defaultdict(set), {}
    for k, text, _, source, *_ in rows:
        for line in (text or "").split("\n") if text is not None else []:
            key = line.strip(" ").lower()
            if len(line) >= min_chars and len(key) >= min_chars:
                sites[key].add("\0" if source is None else source)
                first[key] = min(first.get(key, math.inf), k)
    out = []
    for k, text, _, source, *_ in rows:
        kept = [x for x in (text or "").split("\n") if not (len(x) >= min_chars and len(x.strip(" ").lower()) >= min_chars and len(sites[x.strip(" ").lower()]) >= min_sites and first[x.strip(" ").lower()] != k)]
        out.append((k, None if text is None else "\n".join(kept)))
    return collections.Counter(out)


def test_lines_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = [f"boilerplate line number {k:03d} of the pool" for k in range(30)] + ["short", "", "  Boilerplate Line number 001 of the pool "]
    rows = [(k, "\n".join(str(x) for x in rng.choice(pool, rng.integers(0, 6))) + f"\nown line of document {k} here", "en", [None, *"abcdefgh"][int(rng.integers(0, 9))] if k % 3 else "a", 0) for k in range(150)]
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0), rows[0]]
    df = spark.createDataFrame(rows, DOCS)
    got = line_dedup.drop_boilerplate(df).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == brute_lines(rows)
    assert sum(r.n_removed for r in got) > 50
    none = next(r for r in got if r.doc_id == 500)
    assert (none.n_lines, none.n_removed) == (0, 0)


def test_lines_of_edge_rows(edge_docs, no_docs):
    got = line_dedup.drop_boilerplate(edge_docs, min_sites=2).collect()
    assert len(got) == edge_docs.count()
    assert line_dedup.drop_boilerplate(no_docs).count() == 0


def test_lines_of_one_huge_text_go_in_linear_time(spark):
    import time

    n = 400_000
    body = "\n".join(f"line number {k} that stands on two sites" for k in range(n))
    docs = spark.createDataFrame([(1, "a", body), (2, "b", "first of all\n" + body + "\nlast of all")], "doc_id long, source string, text string")
    start = time.perf_counter()
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, min_sites=2).collect()}
    assert got[1].text == body and got[2].text == "first of all\nlast of all" and got[2].n_removed == n
    assert time.perf_counter() - start < 60


def test_stretches_between_removed_lines(spark):
    import itertools

    rows = [("abcde"[:n], list(gone)) for n in range(1, 6) for k in range(n + 1) for gone in itertools.combinations(range(n), k)]
    df = spark.createDataFrame(rows, "s string, gone array<int>").select("s", "gone", F.filter(F.split("s", ""), lambda c: c != "").alias("lines"))
    for r in df.select("s", "gone", line_dedup.without_lines(F.col("lines"), F.shuffle("gone")).alias("kept")).collect():
        assert r.kept == [c for k, c in enumerate(r.s) if k not in r.gone]
