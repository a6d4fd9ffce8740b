"""Quality and toxicity: recovery of planted rules, held-out accuracy, edge rows."""

import os
import zlib

import numpy as np
import pytest

from tickloom.llm import quality, toxicity
from tickloom.llm.labelled import labelled_sample

DATA = "/root/testdata/sf0.1"


def model_of_prose():
    words = "idiot clown moron stupid worthless pathetic the that with from this and very plain prose about nothing much house garden"
    return toxicity.smooth(toxicity.gram_counts([words] * 50))


@pytest.mark.parametrize(
    ("token", "word"),
    [("1d10t", "idiot"), ("!diot", "idiot"), ("idiooot", "idiot"), ("i.d.i.o.t", "idiot"), ("cl0wn", "clown"), ("m0r0n", "moron"), ("5tup1d", "stupid"), ("st*pid", "stupid"), ("path3tic###", "pathetic"), ("house,", "house"), ("Garden".lower(), "garden")],
)
def test_restored_words(token, word):
    assert toxicity.Restorer(model_of_prose()).word(token) == [word]


def test_restored_texts():
    restorer = toxicity.Restorer(model_of_prose())
    assert toxicity.restore("The I D I O T and\tm o r o n s", restorer).startswith("the idiot and")
    assert toxicity.restore(None, restorer) == "" and toxicity.restore("", restorer) == ""
    assert toxicity.restore("a " * 50, restorer) == "a"
    assert toxicity.restore("plain prose about 2024", restorer) == "plain prose about 2024"


def test_character_model_sums_to_one(spark, edge_docs):
    table = toxicity.character_model(edge_docs).reshape(-1, toxicity.CODES)
    np.testing.assert_allclose(np.exp(table).sum(axis=1), 1, rtol=1e-4)
    texts = [r.text for r in edge_docs.collect()]
    np.testing.assert_allclose(table.ravel(), toxicity.smooth(toxicity.gram_counts(texts)), rtol=1e-6)


def small_corpus(spark, n=400):
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("bcdfgklmprst")) + rng.choice(list("aeou")) for _ in range(3)) for _ in range(900)]
    docs, labels = [], []
    for k in range(n):
        words = list(rng.choice(plain, 30))
        bad = k % 4 == 0
        if bad:
            words[int(rng.integers(0, 30))] = ["idiot", "moron"][k % 8 // 4]
        docs.append((k, " ".join(words)))
        labels.append((k, 0 if bad else 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_is_learnt(spark):
    docs, labels = small_corpus(spark)
    model = toxicity.train(docs, labels)
    probe = spark.createDataFrame([(1, "what an 1d10t here"), (2, "some m o r o n there"), (3, "bocade mufalo"), (4, ""), (5, None), (6, "what an 1d10t here")], "doc_id long, text string").selectExpr("*", "'clash' as score")
    got = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert got[1] > 0.7 and got[2] > 0.7 and got[3] < 0.3 and got[4] == got[5] < 0.3 and got[1] == got[6]


def test_classifiers_of_edge_rows(spark, edge_docs, no_docs):
    none = spark.createDataFrame([(None, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(edge_docs, none)
    got = toxicity.score(edge_docs, model).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(no_docs, toxicity.train(no_docs, none.limit(0))).count() == 0
    graded = quality.grade(edge_docs, quality.train(edge_docs, none)).collect()
    assert len(graded) == edge_docs.count() and all(0 <= r.tail_prob <= 1 for r in graded)
    assert quality.grade(no_docs, quality.train(no_docs, none)).count() == 0


def test_sample_is_bounded_and_leaves_the_held_out_fold(spark):
    docs, labels = small_corpus(spark)
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 != 1]
    assert labelled_sample(docs, labels, "toxic", 10_000).count() == len(ids)
    assert labelled_sample(docs, labels, "toxic", 25).count() == 25
    twice = labels.unionByName(labels.selectExpr("doc_id", "quality", "1 as toxic"))
    assert labelled_sample(docs, twice, "toxic", 10_000).where("y = 1").count() == labelled_sample(docs, labels, "toxic", 10_000).where("y = 1").count()


def test_ordinal_model_recovers_ordered_grades():
    rng = np.random.default_rng(1)
    good, bad = [f"good{k}" for k in range(20)], [f"bad{k}" for k in range(20)]
    texts, grades = [], []
    for _ in range(900):
        g = int(rng.integers(0, 4))
        texts.append(" ".join(rng.choice(good, 6 * g + 2)) + " " + " ".join(rng.choice(bad, 6 * (3 - g) + 2)))
        grades.append(g)
    rows, buckets, values = [], [], []
    for first, n, r, b, words in quality.features(texts):
        for k in range(n):
            ids, c = np.unique(b[r == k], return_counts=True)
            rows.append(np.full(len(ids), first + k))
            buckets.append(ids)
            values.append(c / words[k])
    model = quality.fit(np.concatenate(rows), np.concatenate(buckets), np.concatenate(values), np.array(grades))
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    scores, _ = model.score(texts)
    expected = model.tails(scores).sum(axis=1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.95 and (np.rint(expected) == grades).mean() > 0.9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").join(docs, "doc_id")
    scored = toxicity.score(held, toxicity.train(docs, labels)).toPandas()
    flagged = scored.score >= toxicity.THRESHOLD
    assert scored.toxic[flagged].mean() > 0.9 and flagged[scored.toxic == 1].mean() > 0.7
    graded = quality.grade(held, quality.train(docs, labels)).toPandas()
    assert ((graded.tail_prob >= quality.KEEP_TAIL) == (graded.quality == 1)).mean() > 0.97
