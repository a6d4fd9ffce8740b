"""Quality grades by ordinal cumulative-link regression over hashed text.

One weight vector over hashed words, word shapes and repeats gives a text one score; ordered thresholds cut the score
into grades: P(grade <= k) = sigmoid(threshold_k - score). All grades share the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import SPACE, U64, chunks, map_rows, table, without, word_hashes
from tickloom.llm.labelled import fold, labelled_sample

#: Hash buckets of words and of shapes; one more bucket is for a word that repeats the one before.
WORD_BITS, SHAPE_BITS = 14, 10
BUCKETS = (1 << WORD_BITS) + (1 << SHAPE_BITS) + 1
#: Labelled rows that the model is fitted on at most.
SAMPLE_ROWS = 6_000
KEEP_TAIL = 0.5

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[SPACE] = 32


def features(texts: list[str | None]):
    """Yield (first, documents, row of each feature, bucket of each feature, words by document) for runs of texts.

    A word counts as itself, as its shape (letters, capitals, digits and marks, runs as one) and as a repeat where it
    equals the word before it in its text.
    """
    for first, raw, offsets in chunks(texts, lower=False):
        words, starts, _ = word_hashes(raw)
        kinds = _CLASS[raw]
        shapes, _, _ = word_hashes(kinds[np.concatenate(([True], kinds[1:] != kinds[:-1]))])
        docs = np.searchsorted(offsets, starts, side="right") - 1
        again = np.flatnonzero((words[1:] == words[:-1]) & (docs[1:] == docs[:-1])) + 1 if len(words) else np.empty(0, dtype=int)
        rows = np.concatenate((docs, docs, docs[again]))
        buckets = np.concatenate((words >> U64(64 - WORD_BITS), (shapes >> U64(64 - SHAPE_BITS)) + U64(1 << WORD_BITS), np.full(len(again), BUCKETS - 1, dtype=U64))).astype(np.int64)
        yield first, len(offsets) - 1, rows, buckets, np.bincount(docs, minlength=len(offsets) - 1)


@dataclass
class OrdinalModel:
    """Weights by bucket, and ascending thresholds between the grades (grades are 0 to len(thresholds))."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text, the mean weight of its words' features (0 without words), and its words."""
        scores, counts = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        for first, n, rows, buckets, words in features(texts):
            scores[first : first + n] = np.bincount(rows, self.weights[buckets], minlength=n) / np.maximum(words, 1)
            counts[first : first + n] = words
        return scores, counts

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def fit(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, grades: np.ndarray, steps: int = 300, rate: float = 0.5, penalty: float = 1e-4) -> OrdinalModel:
    """Maximise the penalised likelihood by Adam over all rows. rows, buckets and values are the features' coordinates.

    The thresholds are the first one and positive steps after it, so that they stay in order. grades are 0, 1, 2, ...
    """
    n, top = len(grades), max(1, int(grades.max(initial=1)))
    weights = np.zeros(BUCKETS)
    free = np.zeros(top)  # the first threshold, then logarithms of the steps
    share = np.array([np.clip((grades <= k).mean(), 0.01, 0.99) for k in range(top)]) if n else np.linspace(0.3, 0.7, top)
    start = np.log(share / (1 - share))
    free[0], free[1:] = start[0], np.log(np.maximum(np.diff(start), 0.1))
    state = [np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(top), np.zeros(top)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for step in range(1, steps + 1 if n else 1):
        cuts = free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))
        scores = np.bincount(rows, values * weights[buckets], minlength=n)
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        upper, lower = sigmoid(edges[grades + 1] - scores), sigmoid(edges[grades] - scores)
        upper[grades == top], lower[grades == 0] = 1.0, 0.0
        chance = np.maximum(upper - lower, 1e-9)
        at_upper, at_lower = upper * (1 - upper) / chance / n, lower * (1 - lower) / chance / n
        g_weights = np.bincount(buckets, values * (at_upper - at_lower)[rows], minlength=BUCKETS) + penalty * weights / n
        g_cuts = -np.bincount(grades, at_upper, minlength=top + 1)[:top] + np.bincount(np.maximum(grades - 1, 0), at_lower, minlength=top)[:top]
        g_free = np.array([g_cuts.sum(), *(np.exp(free[k]) * g_cuts[k:].sum() for k in range(1, top))])
        for k, (x, g) in enumerate(((weights, g_weights), (free, g_free))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (0.2 if k else 1.0) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    cuts = free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))
    return OrdinalModel(weights, cuts)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on at most limit labelled rows outside fold 1. Grades are the label's values from 0 on; negative ones count as 0.

    The rows' features are computed by tasks; what the driver gets is at most limit sparse vectors. Without any labelled row
    all weights are 0.
    """
    makes = "buckets array<int>, shares array<float>"

    def kernel(texts: list[str | None], grades: list[int]) -> tuple:
        made = []
        for _, n, rows, buckets, words in features(texts):
            for k in range(n):
                ids, counts = np.unique(buckets[rows == k], return_counts=True)
                made.append((ids.astype(np.int32), (counts / max(1, words[k])).astype(np.float32)))
        return None, [m[0] for m in made], [m[1] for m in made]

    sample = map_rows(labelled_sample(docs, labels, label, limit), ["y"], ["text", "y"], makes, kernel).toArrow()
    grades = np.maximum(sample.column("y").to_numpy(), 0).astype(np.int64)
    lists = sample.column("buckets").combine_chunks() if sample.num_rows else None
    if lists is None:
        return fit(np.empty(0, int), np.empty(0, int), np.empty(0), grades)
    sizes = np.diff(np.asarray(lists.offsets))
    return fit(np.repeat(np.arange(len(grades)), sizes), np.asarray(lists.flatten()).astype(np.int64), np.asarray(sample.column("shares").combine_chunks().flatten()).astype(np.float64), grades)


def grade(docs: DataFrame, model: OrdinalModel, text: str = "text", tail: int = 1) -> DataFrame:
    """Add n_words, expected_grade and tail_prob (the chance of a grade of tail or more) to each row.

    Null and empty texts have the score 0, that of a text without features. Texts of any length are read whole; equal texts, repeated
    rows among them, get equal results, so that ties at a cut fall on one side. An empty table stays empty. Columns of docs with
    those names are replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights, whatever the corpus
    names = ["n_words", "expected_grade", "tail_prob"]

    def kernel(texts: list[str | None]) -> tuple:
        scores, words = known.value.score(texts)
        tails = known.value.tails(scores)
        return None, words, tails.sum(axis=1), tails[:, min(tail, tails.shape[1]) - 1]

    return map_rows(docs, without(docs, *names), [text], "n_words long, expected_grade double, tail_prob double", kernel)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of each whole document, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    graded = grade(docs.withColumn("held_out", fold() == 1), model)
    return graded.select("doc_id", "held_out", "n_words", "expected_grade", "tail_prob", (F.col("tail_prob") >= KEEP_TAIL).alias("kept"))
