"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a logistic model over hashed character n-grams tells which side of the bit a text
is on; the language whose codeword costs least under the models' margins, each bit weighted by how well it does for that
language, is the answer. A second language that costs nearly as little flags the text as ambiguous.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import map_rows, named, table, without

#: Distinct texts that the models are fitted on, about, shared equally by the languages; languages at most (the most frequent ones).
SAMPLE_TEXTS, MAX_LANGUAGES = 2_000, 200
#: Lengths of the n-grams, and logarithm of their hash buckets.
ORDERS, BUCKET_BITS = (1, 2, 3, 4), 14
BUCKETS = 1 << BUCKET_BITS
#: Languages up to which the code has all bits that can tell them apart; beyond it has CODE_BITS * log2(languages), the best of CODE_DRAWS draws.
EXHAUSTIVE, CODE_BITS, CODE_DRAWS = 6, 10, 200
#: Steps and ridge of the fit, and the least share of an n-gram in its scaling.
STEPS, RIDGE, RARE = 150, 1e-3, 1e-4
#: A text is ambiguous if the second language's chance is at least this share of the first one's.
AMBIGUOUS = 0.5
#: What is predicted where there is no letter.
UNDETERMINED = "und"
#: Code points worked at once.
PIECE = 1 << 18

_CLASSES: list[np.ndarray] = []


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(named(doc_id).cast("string").cast("binary")) % 4, F.lit(0))


def is_letter() -> np.ndarray:
    """For each code point whether it is a letter, made once a worker."""
    if not _CLASSES:
        _CLASSES.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), dtype=bool, count=0x110000))
    return _CLASSES[0]


def grams(text: str) -> list[np.ndarray]:
    """Hash buckets of the letter n-grams of a whole text in lower case, a list of arrays; empty if there is no letter.

    What is no letter counts as one blank between words, which n-grams of two and more may hold.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = is_letter()[points]
    if not letter.any():
        return []
    keep = letter | np.concatenate(([False], letter[:-1]))
    points = np.concatenate(([np.uint32(32)], np.where(letter, points, np.uint32(32))[keep]))
    out = []
    for first in range(0, len(points), PIECE):  # pieces overlap, so that no n-gram is lost or counted twice
        part = points[max(0, first - ORDERS[-1] + 1) : first + PIECE]
        skip = first - max(0, first - ORDERS[-1] + 1)
        value = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, ORDERS[-1] + 1):
            value = (value[:-1] if n > 1 else value) * np.uint32(0x9E3779B1) + part[n - 1 :] + np.uint32(n)
            if n in ORDERS:
                mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                bucket = (mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
                ends = np.arange(n - 1, len(part)) >= skip
                out.append(bucket[ends & (part[n - 1 :] != 32)] if n == 1 else bucket[ends])
    return out


def frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a text and each one's share of them."""
    found = grams(text)
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS) if found else np.zeros(BUCKETS)
    some = np.flatnonzero(counts)
    return some, counts[some] / max(1, counts.sum())


def code_words(n: int) -> np.ndarray:
    """Codewords of n languages, rows of +1 and -1.

    Up to EXHAUSTIVE languages all splits of them into two sides, each once; beyond, the random code whose nearest two words
    are farthest apart. No column is constant. One language has no bits.
    """
    if n <= 1:
        return np.zeros((n, 0))
    if n <= EXHAUSTIVE:
        splits = np.arange(2 ** (n - 1) - 1)
        return np.stack([np.ones(len(splits)), *(np.where(splits >> k & 1, 1.0, -1.0) for k in range(n - 1))])
    bits, best, apart = math.ceil(CODE_BITS * math.log2(n)), None, -1.0
    rng = np.random.default_rng(n)
    for _ in range(CODE_DRAWS):
        code = np.where(rng.random((n, bits)) < 0.5, 1.0, -1.0)
        distance = (bits - code @ code.T) / 2
        nearest = distance[~np.eye(n, dtype=bool)].min()
        if nearest > apart and (np.abs(code.sum(axis=0)) < n).all():
            best, apart = code, nearest
    return best


def fit(x: np.ndarray, side: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Logistic weights of each bit (columns of side, +1 and -1) on rows x, by accelerated gradient steps; share weighs the rows.

    Weights are sums of the rows, so the steps are made on one number a row and bit and on the products of the rows.
    """
    if not len(x):
        return np.zeros((x.shape[1], side.shape[1]), dtype=x.dtype)
    products, share = (x @ x.T).astype(np.float64), (share / share.sum())[:, None]
    # the largest eigenvalue of the weighted rows bounds the curvature
    v = np.ones(len(x))
    for _ in range(20):
        v = share[:, 0] * (products @ (v / np.linalg.norm(v)))
    step = 1 / (float(np.linalg.norm(v)) / 4 * 1.05 + RIDGE)
    w = ahead = np.zeros(side.shape)
    t = 1.0
    for _ in range(STEPS):
        pull = side * share / (1 + np.exp(np.clip(side * (products @ ahead), -30, 30)))
        new = ahead + step * (pull - RIDGE * ahead)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    return x.T @ w.astype(x.dtype)


@dataclass
class LanguageModel:
    """Languages in code-point order, their codewords, a weight for each bucket and bit, biases, and the bits' weights by language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def margins(self, text: str) -> np.ndarray | None:
        """The models' margins for a whole text, or None if it has no letter."""
        found = grams(text)
        n = sum(map(len, found))
        if not n:
            return None
        if n < BUCKETS // 8:
            total = self.weights[np.concatenate(found)].sum(axis=0)
        else:
            total = sum(np.bincount(g, minlength=BUCKETS) for g in found) @ self.weights
        return total / n + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, chance and ambiguity of a text. The loss of a codeword is the weighted mean of its bits' logistic losses."""
        margins = self.margins(text) if text else None
        if margins is None or not self.languages:
            return UNDETERMINED, 0.0, False
        bits = self.code.shape[1]
        if not bits:
            return self.languages[0], 1.0, False
        loss = (self.trust * np.logaddexp(0, -self.code * margins)).sum(axis=1)
        differing = (bits - self.code @ self.code.T)[~np.eye(len(loss), dtype=bool)].min() / 2
        # losses count as if each bit in which two words differ at least were seen once
        chance = np.exp((loss.min() - loss) * bits / differing)
        chance /= chance.sum()
        order = np.argsort(-chance, kind="stable")
        return self.languages[order[0]], float(chance[order[0]]), bool(chance[order[1]] >= AMBIGUOUS * chance[order[0]])


def training_sample(docs: DataFrame, text: str, lang: str, doc_id: str, limit: int) -> DataFrame:
    """About limit distinct texts of known language outside the held-out fold, as many of each language: columns text, lang.

    A text is in the sample if its hash is below its language's limit, so copies of a text come together and count once; of several
    languages of a text the most frequent counts. Nothing is sorted.
    """
    usable = docs.select(named(text).alias("text"), named(lang).cast("string").alias("lang"), fold(doc_id).alias("fold")).where("fold != 2 and lang is not null and text is not null")
    hashed = usable.select("text", "lang", F.xxhash64("text").alias("key"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    each = limit / max(1, len(sizes))
    # the share of the hash's 31 low bits that are taken
    bounds = docs.sparkSession.createDataFrame([(r.lang, int(min(1.0, each / r.n) * 2**31)) for r in sizes], "lang string, bound long")
    taken = hashed.join(F.broadcast(bounds), "lang").where(F.col("key").bitwiseAND(F.lit(2**31 - 1)) < F.col("bound"))
    votes = taken.groupBy("key", "lang").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    best = F.max_by(F.struct("text", "lang"), F.struct("n", F.hash("lang"))).alias("best")
    return votes.groupBy("key").agg(best).select("key", "best.text", "best.lang")


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", limit: int = SAMPLE_TEXTS) -> LanguageModel:
    """Fit the bits' models on about limit distinct whole texts outside fold 2 (see training_sample).

    Rows with a null text or language, and texts without a letter, teach nothing; a null id is in fold 0. Without any there are no
    languages. A fifth of the sample is left out of the fit and measures how far each bit can be trusted for each language. The driver
    gets the sample's n-gram shares: at most BUCKETS numbers of 6 bytes a text.
    """

    def kernel(texts: list[str]) -> tuple:
        found = [frequencies(t) for t in texts]
        return None, [f[0] for f in found], [f[1] for f in found], [xxhash.xxh3_64_intdigest(t.encode()) % 5 == 0 for t in texts]

    made = "buckets array<short>, shares array<float>, apart boolean"
    rows = map_rows(training_sample(docs, text, lang, doc_id, limit), ["key", "lang"], ["text"], made, kernel, rows=64).drop("text").toArrow().sort_by("key")
    known = [(b, s, x, a) for b, s, x, a in zip(rows["buckets"], rows["shares"], rows["lang"].to_pylist(), rows["apart"].to_pylist(), strict=True) if len(b)]
    languages = sorted({x for _, _, x, _ in known})
    code = code_words(len(languages))
    x = np.zeros((len(known), BUCKETS + 1), dtype=np.float32)
    for k, (buckets, shares, _, _) in enumerate(known):
        x[k, buckets.values.to_numpy()] = shares.values.to_numpy()
    truth = np.array([languages.index(lang) for _, _, lang, _ in known], dtype=np.int64)
    apart = np.array([a for *_, a in known], dtype=bool)
    # shares are scaled by the square root of their mean, as in a chi-square distance
    scale = 1 / np.sqrt(x[:, :BUCKETS].mean(axis=0) + RARE) if len(x) else np.ones(BUCKETS)
    x[:, :BUCKETS] *= scale
    x[:, BUCKETS] = 1.0
    weigh = 1 / np.maximum(1, np.bincount(truth, minlength=len(languages)))[truth] if len(x) else np.zeros(0)
    learn = ~apart if len(set(truth[~apart].tolist())) == len(languages) else np.ones(len(x), dtype=bool)
    w = fit(x[learn], code[truth[learn]], weigh[learn])
    trust = np.ones(code.shape)
    for k in range(len(languages)):
        mine = apart & (truth == k)
        if code.shape[1]:
            right = ((x[mine] @ w) * code[k] > 0).sum(axis=0)
            trust[k] = (right + 1) / (mine.sum() + 2)
            trust[k] /= trust[k].sum()
    return LanguageModel(languages, code, w[:BUCKETS].astype(np.float64) * scale[:, None], w[BUCKETS].astype(np.float64), trust)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add lang_pred, score (the chance of that language, 0 to 1) and ambiguous to each row.

    Null, empty and letterless texts are `und` with score 0 and not ambiguous, as is everything under a model without languages. Of
    languages that cost the same the first in code-point order is taken. Texts are read whole, in pieces of PIECE characters. Rows are
    independent, so repeated rows give repeated results, and an empty table stays empty. Columns of docs with those names are
    replaced. The model has a fixed size (at most MAX_LANGUAGES languages), so it is broadcast.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    made = ("lang_pred", "score", "ambiguous")

    def kernel(texts: list[str | None]) -> tuple:
        return None, *map(list, zip(*(known.value.predict(t) for t in texts), strict=True))

    return map_rows(docs, without(docs, *made), [text], "lang_pred string, score double, ambiguous boolean", kernel)


def op11_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each whole document, learned from the folds other than 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
