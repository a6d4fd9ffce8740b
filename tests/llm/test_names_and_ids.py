"""Columns with the names that operators use, in any case, and ids that are null or repeated."""

import collections

import pytest
from pyspark.sql import functions as F

from tickloom.llm import embedding_dedup, license_scan, line_dedup, mixing, ngram_join, quality, sentencepiece_io, tiff, tokencount, toxicity
from tickloom.llm.common import without

NAMES = ["row", "gone", "id", "y", "doc", "digits", "size", "cut", "of", "key", "pos", "k1", "k2", "near", "line", "site", "value", "path", "set_id", "n", "keep", "a.b", "hash", "SCORE", "N_TOKENS", "Mix_Size", "N_LINES", "LICENSES", "Kept", "EXPECTED_GRADE", "MEDIA", "PAGE", "mix_cut", "mix_digits"]
MODEL = sentencepiece_io.model_path()


def bytes_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def trained(module, df):
    labels = df.sparkSession.createDataFrame([(k, k % 2, k % 2) for k in range(6)], "doc_id long, quality int, toxic int")
    return module.train(df, labels.selectExpr("*", "1 as id", "2 as y"))


OPERATORS = {
    "license_scan": (license_scan.scan, ["sentence_ids", "n_sentences", "licenses"]),
    "quality": (lambda df: quality.grade(df, trained(quality, df)), ["n_words", "expected_grade", "tail_prob"]),
    "mixing": (mixing.mix, ["mix_size", "mix_source_size", "mix_target", "mix_repeats"]),
    "sentencepiece": (lambda df: sentencepiece_io.encode(df, MODEL), ["n_tokens", "ids", "begins", "ends"]),
    "tokencount": (lambda df: tokencount.count_tokens(df, bytes_path()), ["n_tokens"]),
    "tiff": (lambda df: tiff.text_media(df), ["n_bytes", "media"]),
    "toxicity": (lambda df: toxicity.score(df, trained(toxicity, df)), ["score"]),
    "line_dedup": (lambda df: line_dedup.drop_boilerplate(df, min_sites=2), ["n_lines", "n_removed"]),
}


@pytest.fixture(scope="module")
def crowded(spark):
    line = "a boilerplate line that stands on two sites"
    docs = [(k, f"{line}\nown words of document {k} and some more of them", "en", "ab"[k % 2], 5) for k in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(f"<{n}>").alias(n) for n in NAMES))


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name_pass(crowded, name):
    operator, made = OPERATORS[name]
    out = operator(crowded)
    assert sorted(c.lower() for c in out.columns if c.lower() in made) == sorted(made)  # each of them once
    rows = out.collect()
    assert len(rows) == 6
    for c in without(crowded, *made, "text", "doc_id", "lang", "source", "n_chars"):
        assert {r[c] for r in rows} == {f"<{c}>"}
    if name == "line_dedup":
        assert sum(r.n_removed for r in rows) == 5


def test_groups_and_vectors_with_any_columns(crowded):
    got = ngram_join.similar_groups(crowded).collect()
    assert len(got) == 6 and all(r.n_links == 0 for r in got)
    vectors = crowded.withColumnsRenamed({"id": "low", "size": "copies"}).withColumn("embedding", F.array(F.lit(1.0), F.col("doc_id").cast("double"))).withColumnRenamed("doc_id", "vec_id")
    got = embedding_dedup.near_duplicates(vectors).collect()
    assert len(got) == 6 and got[0].row == "<row>" and got[0]["a.b"] == "<a.b>"


@pytest.mark.parametrize("kind", ["int", "string", "long", "decimal(20,0)"])
def test_vectors_with_ids_of_any_type(spark, kind):
    rows = [(3, [1.0, 0.0, 0.1]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.01]), (7, None), (9, [1.0, 0.0, 0.1]), (9, [1.0, 0.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vec_id", F.col("vec_id").cast(kind))
    got = collections.Counter((None if r.vec_id is None else int(r.vec_id), r.n_links, None if r.component_id is None else int(r.component_id), r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == collections.Counter({(3, 3, 1, False): 1, (1, 3, 1, True): 1, (2, 1, 2, True): 1, (None, 1, 2, False): 1, (7, 0, 7, True): 1, (9, 3, 1, False): 2})


def test_lines_of_null_and_repeated_ids_as_in_sql(spark, tmp_path):
    import duckdb

    line, other = "a boilerplate line that stands on many sites", "Another line of boilerplate, on many sites too \t\r"
    rows = [(k, f"{line}\nown line of document number {k}\n{other}", f"s{k}") for k in range(2, 9)]
    rows += [(1, f"{line}\nfirst text of the repeated id", "s1"), (1, f"zzz of the second text of the id\n{line}", "s1"), (None, f"{line}\nno id on this one either", "s0"), (None, f"{line.upper()}\nno id, another text", "s0"), (None, None, None), (4, rows[2][1], "s4"), (50, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(tuple(r) for r in line_dedup.op10_line_dedup(spark, str(tmp_path)).select("doc_id", "source", "text", "n_lines", "n_removed").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = collections.Counter(con.execute(f"select doc_id, source, text, n_lines, n_removed from ({line_dedup.OP10_SQL})").fetchall())
    assert got == want and sum(n * r[4] for r, n in got.items()) > 10
    # one of the two texts of id 1 keeps the line, and only one
    assert sorted(r[4] for r in got if r[0] == 1) == [0, 1]


def test_many_sources_are_joined_by_a_shuffle(spark, monkeypatch):
    docs = spark.range(600).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "concat('s', id % 40) as source")
    few = {r.doc_id: r.mix_repeats for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert {r.doc_id: r.mix_repeats for r in mixing.mix(docs).collect()} == few


def test_targets_of_equal_ratios(spark):
    sizes = spark.createDataFrame([("a", 50), ("b", 20), ("c", 10), ("d", 500), ("e", 200), ("f", 100), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # every source has the same size by weight but the second three, ten times as much
    assert got["a"] == 150 and got["b"] == 60 and got["c"] == 30 and got[None] == 0
    assert sum(got.values()) == pytest.approx(880) and got["d"] == pytest.approx(400) and got["e"] == pytest.approx(160)


def test_hot_groups_stay_whole(spark, monkeypatch):
    """All keys hot, and none: the same results."""
    from tickloom.llm import common

    base = " ".join(f"w{k}" for k in range(40))
    rows = [(k, base) for k in range(30)] + [(100 + k, base + f" x{k}") for k in range(30)] + [(200 + k, f"other text {k} of its own") for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    for least in (0, 10**9):
        monkeypatch.setattr(common, "HOT_ROWS", least)
        seen.append(collections.Counter(tuple(r) for r in ngram_join.similar_groups(df, bucket=8).select("doc_id", "n_links", "class_id", "kept").collect()))
    assert seen[0] == seen[1] and (0, 59, 0, True) in seen[0]


def test_recall_near_the_threshold(spark):
    """Pairs whose similarity is a little over 0.8 are found."""
    import numpy as np

    rng, rows = np.random.default_rng(0), []
    for k in range(1000):
        words = [f"p{k}w{i}" for i in range(104)]  # 100 shingles
        other = list(words)
        for at in rng.choice([10, 30, 50, 70, 90], 2, replace=False):  # five shingles each: 90 of 110 are common
            other[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.similar_groups(df).where("n_links = 1").count() / 2
    assert found >= 995
