"""Toxicity of text behind leetspeak, spacing and repetition.

A noisy channel: each suspicious stretch is a lattice of the letters that its characters may stand for, and the best path
under a character model of the corpus restores it (Viterbi over contexts of three letters). A logistic model over the words
of the restored text gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import chunks, map_rows, named, release_memory, table, without
from tickloom.llm.labelled import fold, labelled_sample

#: Codes of the character model: a to z, any other letter, the end of a word.
OTHER, END, CODES, ORDER = 26, 27, 28, 4
GRAMS = CODES**ORDER
#: Strength of the shorter context's distribution in the smoothing of the longer one.
PRIOR = 4.0
#: Letters that a character may stand for. Common substitutions.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
#: Marks that may stand for any letter, and marks of LEET that seldom stand for nothing. Fixed values.
WILD, LIKE_LETTERS = "*#?%&", "@$€£"
#: Channel costs in nats.
COST_LEET, COST_ANY, COST_DROP, COST_SPLIT, COST_GAP, COST_GAP_SPLIT, COST_REPEAT_DROP, COST_REPEAT_KEEP = 1.5, 4.5, 2.0, 2.5, 0.2, 3.0, 0.4, 2.0
#: Cost of dropping a mark of LIKE_LETTERS, and of dropping any mark of a token's tail, where punctuation and ornaments stand.
COST_LETTERLIKE_DROP, COST_TAIL_DROP = 6.0, 0.5
#: Cost of dropping one of a doubled letter.
COST_DOUBLE_DROP = 3.0
#: The channel hides at most this many letters of a stretch behind WILD marks, and repeats a mark or a digit at most this often: what is beyond is dropped.
MASKED, REPEATED = 8, 8
#: Characters of a stretch that are decoded together; a longer one is read in pieces of this length.
STRETCH = 256
#: Steps of the search with more states times arcs than this are worked as arrays; the result is the same.
DENSE = 4096
#: Mean log-probability of a character from which on a reading of digits and marks alone counts as a word, and its letters at least if there are
#: digits only: a shorter number stays a number.
LIKELY, LIKELY_LETTERS = -2.3, 4
#: Labelled rows that the model is fitted on at most, hash buckets of words, features at most, and the least evidence for one.
SAMPLE_ROWS, BUCKET_BITS, MAX_FEATURES, MIN_EVIDENCE, MIN_ROWS = 6_000, 22, 512, 25.0, 6.0
#: Lengths of the beginnings of words that count as features too.
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.7
#: Distinct words that a worker remembers, and characters of the longest one.
CACHED, LONGEST = 300_000, 64

_SPACED = re.compile(r"(?<!\S)\S(?:\s++\S(?!\S)){2,}+")
_RUN = re.compile(r"([^a-z\s])\1{%d,}" % REPEATED)
_TRIPLE = re.compile(r"(.)\1\1", re.DOTALL)
_DOUBLED = re.compile(r"(?=[a-z]+\Z)[a-z]*?([a-z])\1")
_LEET_ALONE = re.compile("[" + re.escape("".join(LEET)) + "]{2,}")
_MARKED = frozenset(LEET)
_CHANNEL = _MARKED | frozenset(WILD)
_LETTER = re.compile(r"[a-z]")

_CODE = np.full(256, END, dtype=np.int32)
_CODE[ord("a") : ord("z") + 1] = np.arange(26)
_CODE[0xC3:0xF5] = OTHER
_CODE[0x80:0xC0] = -1


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of the character model's 4-grams over the words of texts; contexts do not cross a word's beginning."""
    total = np.zeros(GRAMS, dtype=np.int64)
    for _, raw, _ in chunks(texts, size_of=1 << 20):
        code = _CODE[raw]
        code = code[code >= 0]
        pad = np.concatenate((np.full(3, END, dtype=np.int32), code))
        c1 = pad[2:-1]
        c2 = np.where(c1 == END, np.int32(END), pad[1:-2])
        gram = np.where(c2 == END, np.int32(END), pad[:-3])
        for c in (c2, c1, code):
            gram = gram * np.int32(CODES) + c
        total += np.bincount(gram[(c1 != END) | (code != END)], minlength=GRAMS)
    return total


def character_model(df: DataFrame, text: str = "text") -> np.ndarray:
    """Log-probabilities of each character after three others, from all texts of df: GRAMS values (float32).

    Each task sums its texts in one array and hands on its non-zero counts; they meet by gram. The table does not grow with
    the corpus. Contexts never seen fall back on shorter ones, and in the end on equal chances.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAMS, dtype=np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                total += gram_counts(batch.column(0).slice(first, 1024).to_pylist())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["gram", "n"])
        release_memory()

    parts = df.select(named(text).alias("text")).where("text is not null").mapInArrow(count, "gram int, n long")
    rows = parts.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(GRAMS)
    counts[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return smooth(counts)


def smooth(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities by mixing each context length with the next shorter one."""
    full = counts.reshape((CODES,) * ORDER).astype(np.float64)
    chance = np.full(CODES, 1 / CODES)
    for drop in range(ORDER - 1, -1, -1):
        level = full.sum(axis=tuple(range(drop)))
        chance = (level + PRIOR * chance) / (level.sum(axis=-1, keepdims=True) + PRIOR)
    return np.log(chance).astype(np.float32).ravel()


def _inside(token: str, kept: frozenset[str]) -> str:
    """A token without the marks at its edges that are not kept."""
    lo, hi = 0, len(token)
    while lo < hi and not (token[lo].isalnum() or token[lo] in kept):
        lo += 1
    while hi > lo and not (token[hi - 1].isalnum() or token[hi - 1] in kept):
        hi -= 1
    return token[lo:hi]


def core_of(token: str) -> str:
    """A token without the marks at its edges that the channel does not use there: WILD marks hide letters inside a word, or
    around a single one (f***); at the edges of more they are ornament."""
    core = _inside(token, _MARKED)
    return core if len(core) > 1 else _inside(token, _CHANNEL)


def _arcs(segment: str) -> list[list[tuple[int, float]]]:
    """For each character of a segment the codes it may emit (-1: none) and their costs. Gaps do not hide a repetition."""
    arcs, solid, at, masked = [], [c for c in segment if not c.isspace()], -1, 0
    tail = len(segment) if segment[-1:].isalnum() else next((k + 1 for k in range(len(segment) - 1, -1, -1) if segment[k].isalnum()), 0)
    for place, ch in enumerate(segment):
        at += not ch.isspace()
        same = at > 0 and not ch.isspace() and solid[at - 1] == ch
        ends = [(-1, COST_TAIL_DROP)] if place >= tail > 0 else []
        if "a" <= ch <= "z":
            code = ord(ch) - 97
            triple = same and (at > 1 and solid[at - 2] == ch or at + 1 < len(solid) and solid[at + 1] == ch)
            arcs.append([(code, 0.0 if not same else COST_REPEAT_KEEP if triple else 0.0), *([(-1, COST_REPEAT_DROP if triple else COST_DOUBLE_DROP)] if same else [])])
        elif ch.isspace():
            arcs.append([(-1, COST_GAP), (END, COST_GAP_SPLIT)])
        elif ch in LEET:
            repeat = [(-1, COST_REPEAT_DROP)] if same else []
            drop, split = (COST_LETTERLIKE_DROP, COST_LETTERLIKE_DROP) if ch in LIKE_LETTERS else (COST_DROP + 1.0, COST_SPLIT + 1.0)
            arcs.append([*((ord(c) - 97, COST_LEET) for c in LEET[ch]), *(repeat or ends or [(-1, drop)]), (END, split)])
        elif ch.isalpha():
            arcs.append([(OTHER, 0.0), *([(-1, COST_REPEAT_DROP)] if same else [])])
        elif ch in WILD:
            masked += 1
            arcs.append([*((c, COST_ANY) for c in range(26)), *(ends or [(-1, COST_DROP)]), (END, COST_SPLIT)] if masked <= MASKED else [(-1, COST_DROP)])
        else:
            arcs.append(ends and [*ends, (END, COST_SPLIT / 2)] or [(-1, COST_DROP / 2), (END, COST_SPLIT / 2)])
    return arcs


_START = (END * CODES + END) * CODES + END


def _dense_step(states: dict[int, tuple[float, tuple | None]], arcs: list[tuple[int, float]], model: np.ndarray) -> dict[int, tuple[float, tuple | None]]:
    """One step of the search from many states at once: the best way to each state after arcs."""
    rest = CODES * CODES
    held = np.full(CODES * rest, -np.inf)
    held[list(states)] = [v[0] for v in states.values()]
    costs = np.full(CODES, np.inf)
    drop = end = np.inf
    for code, cost in arcs:
        if code == -1:
            drop = min(drop, cost)
        elif code == END:
            end = min(end, cost)
        else:
            costs[code] = min(costs[code], cost)
    emitted = held.reshape(CODES, rest, 1) + model.reshape(CODES, rest, CODES) - costs
    origin = emitted.argmax(axis=0)
    best = np.take_along_axis(emitted, origin[None], axis=0)[0].ravel()
    origin = (origin * rest + np.arange(rest)[:, None]).ravel()
    kept = held - drop
    last_end = np.arange(len(held)) % CODES == END
    kept[last_end] = np.maximum(kept[last_end], held[last_end] - end)
    after = {}
    for s in np.flatnonzero((best > -np.inf) | (kept > -np.inf)).tolist():
        if kept[s] >= best[s]:
            after[s] = (float(kept[s]), states[s][1])
        else:
            after[s] = (float(best[s]), (s % CODES, states[int(origin[s])][1]))
    ended = np.where(last_end, -np.inf, held + model.reshape(len(held), CODES)[:, END] - end)
    s = int(ended.argmax())
    if ended[s] > after.get(_START, (-np.inf,))[0]:
        after[_START] = (float(ended[s]), (END, states[s][1]))
    return after


def viterbi(segment: str, model: list[float] | np.ndarray, whole: np.ndarray | None = None) -> str:
    """Best reading of a segment: words of a to z (and ~ for other letters), one space between words.

    All states are kept, so the reading is the best one of the lattice. model may be a list, which is quicker for few states; whole
    is the same as an array.
    """
    modulus = CODES ** (ORDER - 1)
    states: dict[int, tuple[float, tuple | None]] = {_START: (0.0, None)}
    for arcs in [*_arcs(segment), [(END, 0.0)]]:
        if len(arcs) == 1 and arcs[0][0] == -1:
            continue  # the same cost for all
        if len(states) * len(arcs) > DENSE:
            states = _dense_step(states, arcs, np.asarray(model, dtype=np.float64) if whole is None else whole)
            continue
        after: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, back) in states.items():
            for code, cost in arcs:
                if code == -1 or code == END and state % CODES == END:
                    new, value, trail = state, score - cost, back
                else:
                    gram = state * CODES + code
                    value, trail = score - cost + model[gram], (code, back)
                    new = _START if code == END else gram % modulus
                held = after.get(new)
                if held is None or value > held[0]:
                    after[new] = (value, trail)
        states = after
    trail, out = max(states.values(), key=lambda v: v[0])[1], []
    while trail:
        out.append(trail[0])
        trail = trail[1]
    return "".join(" " if c == END else "~" if c == OTHER else chr(97 + c) for c in reversed(out)).strip()


@dataclass
class Restorer:
    """Restores words under a character model, and remembers what words became."""

    model: np.ndarray
    quick: list[float] = field(default_factory=list, repr=False)
    last: tuple[str, list[str]] = ("", [])

    def word(self, token: str) -> list[str]:
        """Words that a token without white space (lower case) stands for. Every token with a character of the channel, and with a letter
        or a likely reading, is decoded."""
        core = core_of(token)
        if core.isalpha() and not _TRIPLE.search(core) and not _DOUBLED.match(core):
            return [core]
        if core.isascii() and core.isalpha() and len(core) <= STRETCH and not _TRIPLE.search(core):
            return self.doubled(core)
        if _LETTER.search(core):
            return self.segment(core)
        if _LEET_ALONE.fullmatch(core) and self.likely(words := self.segment(core), LIKELY_LETTERS if core.isdigit() else 1):
            return words
        return [core] if any(map(str.isalnum, core)) else []

    def chance(self, word: str) -> float:
        """Log-probability of a word of a to z and of its end."""
        total, state = 0.0, _START
        for code in [*(ord(c) - 97 for c in word), END]:
            total += self.quick[state * CODES + code]
            state = (state * CODES + code) % CODES ** (ORDER - 1)
        return total

    def doubled(self, word: str) -> list[str]:
        """The best reading of letters of which some are doubled: the lattice has no other choice than to drop one of a pair, so few pairs
        are enumerated."""
        if not self.quick:
            self.quick = self.model.tolist()
        pairs = [k for k in range(1, len(word)) if word[k] == word[k - 1]]
        if len(pairs) > 3:
            return self.segment(word)
        readings = {word: 0.0}
        for k in reversed(pairs):  # from the end, so that places before stay
            readings |= {w[:k] + w[k + 1 :]: cost + COST_DOUBLE_DROP for w, cost in readings.items()}
        return [max(readings, key=lambda w: self.chance(w) - readings[w])]

    def segment(self, text: str) -> list[str]:
        """Words that a suspicious stretch stands for, decoded."""
        if not self.quick:
            self.quick = self.model.tolist()
        text = _RUN.sub(lambda m: m.group()[:REPEATED], text)
        return [w for k in range(0, len(text), STRETCH) for w in self.piece(text[k : k + STRETCH])]

    def piece(self, text: str) -> list[str]:
        """Words of a stretch of at most STRETCH characters; the last full piece is remembered, since long stretches repeat themselves."""
        if text != self.last[0]:
            self.last = (text, viterbi(text, self.quick, self.model).split())
        return self.last[1]

    def likely(self, words: list[str], letters: int) -> bool:
        """Whether the words have so many letters, and the character model takes them for words of the corpus."""
        plain = ["".join(c for c in w if c != "~") for w in words]
        total, n = sum(map(self.chance, plain)), sum(map(len, words))
        return n >= letters and total >= LIKELY * (n + len(words))

    def spaced(self, text: str) -> list[str]:
        """Words behind runs of single characters."""
        out = []
        for run in _SPACED.finditer(text):
            if _LETTER.search(run.group()):
                out += self.segment(re.sub(r"\s+", " ", run.group()))
        return out


def restore(text: str | None, restorer: Restorer) -> str:
    """Whole text with each suspicious word or run of single characters restored, in lower case."""
    low = (text or "").lower()
    low = _SPACED.sub(lambda m: " ".join(restorer.segment(re.sub(r"\s+", " ", m.group()))) if _LETTER.search(m.group()) else m.group(), low)
    return " ".join(w for token in low.split() for w in restorer.word(token))


def bucket(feature: str) -> int:
    """Hash bucket of a feature."""
    return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) >> (64 - BUCKET_BITS)


def word_buckets(word: str) -> list[int]:
    """Buckets of a word and of its beginnings that more letters follow, which gather a stem's forms."""
    if not word.isascii():
        return [bucket(word), *(bucket(f"{word[:k]}+") for k in STEMS if len(word) > k)]
    raw, digest, shift = word.encode(), xxhash.xxh3_64_intdigest, 64 - BUCKET_BITS  # a byte a character
    return [digest(raw) >> shift, *[digest(raw[:k] + b"+") >> shift for k in STEMS if len(raw) > k]]


@dataclass
class ToxicityModel:
    """The character model, a bias, and the weight of each chosen word bucket (at most MAX_FEATURES)."""

    characters: np.ndarray
    bias: float
    weights: dict[int, float]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts, remembering for each distinct word which features it holds."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.restorer = model, Restorer(model.characters)
        self.seen: set[str] = set()
        self.hot: dict[str, frozenset[int]] = {}

    def found(self, text: str | None) -> set[int]:
        """Feature buckets of a whole text."""
        low = (text or "").lower()
        words = set(low.split())
        weights = self.model.weights
        for token in words - self.seen:
            if hits := [b for w in self.restorer.word(token) for b in word_buckets(w) if b in weights]:
                self.hot[token] = frozenset(hits)
        found: set[int] = set().union(*(self.hot[t] for t in words & self.hot.keys()))
        self.seen.update(w for w in words if len(w) <= LONGEST)
        for token in [w for w in words & self.hot.keys() if len(w) > LONGEST]:
            del self.hot[token]
        found.update(b for w in self.restorer.spaced(low) for b in word_buckets(w) if b in weights)
        if len(self.seen) > CACHED:
            self.seen, self.hot = set(), {}
        return found

    def score(self, text: str | None) -> float:
        value = self.model.bias + sum(self.model.weights[b] for b in self.found(text))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, value))))


def _row_weights(rows: list[np.ndarray]) -> np.ndarray:
    """One over the number of sampled rows alike (three quarters of 32 minima of hashed words equal), so that copies count once together."""
    if not rows:
        return np.empty(0)
    odd = (np.arange(32, dtype=np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B)) | np.uint32(1)
    minima = np.stack([(np.asarray(r, dtype=np.uint32)[:, None] * odd).min(axis=0) if len(r) else np.zeros(32, np.uint32) for r in rows])
    alike = np.empty(len(rows))
    for first in range(0, len(rows), 256):
        same = sum((minima[first : first + 256, k, None] == minima[None, :, k]).astype(np.int8) for k in range(32))
        alike[first : first + 256] = (same >= 24).sum(axis=1)
    return 1 / alike


def fit(rows: list[np.ndarray], toxic: np.ndarray, penalty: float = 0.25, steps: int = 40) -> tuple[float, dict[int, float]]:
    """Choose word buckets by their likelihood-ratio evidence and fit a logistic model on their presence by Newton steps."""
    share = _row_weights(rows)
    if not len(rows) or not 0 < (share * toxic).sum() < share.sum():
        return (math.log((toxic.sum() + 0.5) / (len(rows) - toxic.sum() + 0.5)) if len(rows) else 0.0), {}
    flat, sizes = np.concatenate(rows).astype(np.int32), np.array([len(r) for r in rows])
    ids, column = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(rows)), sizes)
    positives, n = (share * toxic).sum(), share.sum()
    a = np.bincount(column, (share * toxic)[row], minlength=len(ids))
    both = np.bincount(column, share[row], minlength=len(ids))
    cells = [(a, positives * both / n), (both - a, (n - positives) * both / n), (positives - a, positives * (n - both) / n), (n - positives - both + a, (n - positives) * (n - both) / n)]
    evidence = 2 * sum(np.where(o > 1e-9, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0.0) for o, e in cells)
    able = np.flatnonzero((evidence >= MIN_EVIDENCE) & (both >= MIN_ROWS))
    chosen = able[np.argsort(-evidence[able], kind="stable")][:MAX_FEATURES]
    place = np.full(len(ids), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen) + 1))
    x[:, -1] = 1.0
    held = place[column] >= 0
    x[row[held], place[column][held]] = 1.0
    w = np.zeros(len(chosen) + 1)
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (share * (p - toxic)) + ridge * w
        step = np.linalg.solve((x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[-1]), {int(ids[c]): float(v) for c, v in zip(chosen, w, strict=False)}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE_ROWS) -> ToxicityModel:
    """Count the character model over all texts, and fit the scores on at most limit labelled rows outside fold 1."""
    characters = character_model(docs)
    known = docs.sparkSession.sparkContext.broadcast(characters)

    def kernel(texts: list[str | None], _: list[int]) -> tuple:
        restorer, out = Restorer(known.value), []
        for text in texts:
            low = (text or "").lower()
            words = {w for token in set(low.split()) for w in restorer.word(token)} | set(restorer.spaced(low))
            out.append(np.unique(np.array([b for w in words for b in word_buckets(w)], dtype=np.int32)))
        return None, out

    sample = map_rows(labelled_sample(docs, labels, label, limit), ["y"], ["text", "y"], "buckets array<int>", kernel).toArrow()
    lists = sample.column("buckets").combine_chunks()
    rows = np.split(np.asarray(lists.flatten()), np.asarray(lists.offsets)[1:-1]) if sample.num_rows else []
    bias, weights = fit(rows, (sample.column("y").to_numpy() > 0).astype(np.float64))
    return ToxicityModel(characters, bias, weights)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add the chance that each whole text is toxic. Null and empty texts get the model's bias alone.

    Equal texts get equal scores, so repeated rows and ties do; texts of any length are read whole; an empty table stays empty. A
    column of docs named out is replaced. The model has a fixed size, so it is broadcast.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    held: list[Scorer] = []

    def kernel(texts: list[str | None]) -> tuple:
        if not held:
            held.append(known.value.scorer())
        return None, [held[0].score(t) for t in texts]

    return map_rows(docs, without(docs, out), [text], f"`{out}` double", kernel)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
