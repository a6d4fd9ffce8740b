"""Grades against a replay of features, score and tail in plain Python."""

import math
import re
import string

import numpy as np

from tickloom.llm import quality
from tickloom.llm.common import word_hashes


def one_hash(word):
    return int(word_hashes(np.frombuffer(word, dtype=np.uint8))[0][0])


def shape(word):
    kinds = "".join("A" if c in string.ascii_uppercase else "0" if c in string.digits else "a" if c in string.ascii_lowercase or ord(c) > 127 else c for c in word)
    return re.sub(r"(.)\1+", r"\1", kinds)


def plain_score(text, weights):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    total = 0.0
    for k, word in enumerate(words):
        total += weights[one_hash(word.encode()) >> (64 - quality.WORD_BITS)]
        total += weights[(one_hash(shape(word).encode()) >> (64 - quality.SHAPE_BITS)) + (1 << quality.WORD_BITS)]
        if k and words[k - 1] == word:
            total += weights[quality.BUCKETS - 1]
    return total / max(1, len(words)), len(words)


def test_grades_equal_a_plain_replay(spark):
    texts = ["Plain words here", "again again AGAIN 12 x9!", None, "", "  \n", "é über 日本 Ünïcode", "a  b\tc\nd", "tie tie tie", "tie tie tie"]
    rng = np.random.default_rng(2)
    weights = rng.normal(size=quality.BUCKETS)
    model = quality.OrdinalModel(weights, np.array([-0.4, 0.3, 1.1]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tail in (1, 3):
        for r in quality.grade(df, model, tail=tail).collect():
            score, n = plain_score(texts[r.doc_id], weights)
            tails = [1 / (1 + math.exp(t - score)) for t in (-0.4, 0.3, 1.1)]
            assert r.n_words == n
            assert math.isclose(r.expected_grade, sum(tails), rel_tol=1e-9) and math.isclose(r.tail_prob, tails[tail - 1], rel_tol=1e-9)
