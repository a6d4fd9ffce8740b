"""The search through character lattices against enumeration of all paths, and scores against a plain replay."""

import itertools
import math

import numpy as np
import pytest

from tickloom.llm import toxicity
from tickloom.llm.toxicity import CODES, END


def some_model(seed=3):
    counts = np.random.default_rng(seed).integers(0, 9, toxicity.GRAMS)
    return toxicity.smooth(counts.astype(float)).astype(np.float64)


def value_of(path, model):
    """Best emission score of a path of arcs, or None where an END follows an END (then it emits nothing)."""
    context, total, out = [END, END, END], 0.0, []
    for code, cost in path:
        total -= cost
        if code == -1 or code == END and context[-1] == END:
            continue
        a, b, c = context
        total += model[((a * CODES + b) * CODES + c) * CODES + code]
        context = [END] * 3 if code == END else [b, c, code]
        out.append(code)
    return total, out


def reading(codes):
    return "".join(" " if c == END else "~" if c == toxicity.OTHER else chr(97 + c) for c in codes).strip()


@pytest.mark.parametrize("segment", ["1d10t", "a b  c", "!!d", "héllo", "ooo0", "st*d", "i.d.t", "aab", "11!!", "f*k", "x#y"])
def test_best_path_of_all(segment):
    model = some_model()
    arcs = [*toxicity._arcs(segment), [(END, 0.0)]]
    best = max((value_of(p, model) for p in itertools.product(*arcs)), key=lambda x: x[0])
    got = toxicity.viterbi(segment, model)
    scores = {reading(out): v for v, out in sorted((value_of(p, model) for p in itertools.product(*arcs)), key=lambda x: x[0])}
    assert math.isclose(scores[got], best[0], abs_tol=1e-9)


@pytest.mark.parametrize("segment", ["f**k***g", "a#1*&0%b", "****", "1|!*(0*"])
def test_dense_steps_find_the_same(segment, monkeypatch):
    model = some_model(5)
    dense = toxicity.viterbi(segment, model)
    monkeypatch.setattr(toxicity, "DENSE", 10**9)
    assert toxicity.viterbi(segment, model) == dense
    monkeypatch.setattr(toxicity, "DENSE", 0)
    assert toxicity.viterbi(segment, model) == dense


def test_doubled_letters_and_marks_alone():
    words = "idiot clown moron stupid worthless pathetic the that with from this and very plain prose about nothing much house garden hello"
    restorer = toxicity.Restorer(toxicity.smooth(toxicity.gram_counts([words] * 50)))
    for token, want in [("idioot", "idiot"), ("stuupid", "stupid"), ("hello", "hello"), ("1d107", "idiot"), ("2024", "2024"), ("1990", "1990"), ("größße", "größße")]:
        assert restorer.word(token) == [want]


def test_long_mixed_token_is_read_whole():
    restorer = toxicity.Restorer(some_model())
    token = "".join("ab1c.0d-e5f"[k % 11] for k in range(20_000)) + "z"
    out = "".join(restorer.word(token))
    assert len(out) > 5_000 and out.endswith("z")


def test_scores_equal_a_plain_replay(spark):
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("bcdfgklmprst")) + rng.choice(list("aeou")) for _ in range(3)) for _ in range(300)]
    docs = [(k, " ".join([*rng.choice(plain, 20), *(["1d10t"] if k % 3 == 0 else [])])) for k in range(240)]
    labels = [(k, int(k % 3 == 0)) for k in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    restorer = toxicity.Restorer(model.characters)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    for k, text in docs:
        words = {w for t in text.lower().split() for w in restorer.word(t)}
        buckets = {b for w in words for b in [toxicity.bucket(w), *(toxicity.bucket(f"{w[:n]}+") for n in toxicity.STEMS if len(w) > n)]}
        z = model.bias + sum(v for b, v in model.weights.items() if b in buckets)
        assert math.isclose(got[k], 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert model.weights and min(got[k] for k in range(0, 240, 3)) > 0.7


def restorer_of(words):
    return toxicity.Restorer(toxicity.smooth(toxicity.gram_counts([words] * 50)))


PROSE = "idiot clown moron stupid worthless asshole ass hole the that with from this and very plain prose about nothing house garden hello"


def test_marks_at_the_edges_are_letters_or_ornament():
    restorer = restorer_of(PROSE)
    wanted = [("@$$h0l3", "asshole"), ("@$$", "ass"), ("!d!0t", "idiot"), ("idiot$$$", "idiot"), ("hello!", "hello"), ("(with", "with"), ("the###", "the"), ("**st*p*d**", "stupid"), ("...the", "the"), ("455", "455"), ("$100", "$100")]
    for token, want in wanted:
        assert restorer.word(token) == [want], token
    assert restorer.word("...") == restorer.word("###") == []
    assert restorer.spaced("i\nd   i       o t\n\nand") == ["idiot"]


def test_long_tokens_end_soon():
    import time

    restorer, start = restorer_of(PROSE), time.perf_counter()
    assert "".join(restorer.word("foo" + "-" * 100_000 + "bar")).startswith("fo")
    for token in ("a" + "*" * 100_000, "|---" * 30_000 + "|", "*#" * 50_000 + "a", "x" * 300_000, "a" + "*b" * 50_000, "=*" * 20_000 + "foo"):
        restorer.word(token)
    restorer.spaced("x y " * 20_000)
    assert time.perf_counter() - start < 60
    scorer = toxicity.Scorer(toxicity.ToxicityModel(restorer.model, 0.0, {toxicity.bucket("idiot"): 2.0}))
    assert scorer.score("1d10t " + "y" * 1000) > 0.8 and max(map(len, scorer.seen)) <= toxicity.LONGEST
    assert scorer.found("-" * 200 + "1d10t") == scorer.found("1d10t") and all(len(t) <= toxicity.LONGEST for t in scorer.hot)


@pytest.mark.parametrize("token", ["st*p*d", "f***", "a**b*", "1*0#t"])
def test_skipped_steps_change_nothing(token, monkeypatch):
    """A mark that can only be dropped costs all readings the same."""
    model = some_model(7)
    monkeypatch.setattr(toxicity, "MASKED", 1)
    arcs = [*toxicity._arcs(token), [(END, 0.0)]]
    assert any(len(a) == 1 and a[0][0] == -1 for a in arcs[:-1])
    best = max((value_of(p, model) for p in itertools.product(*arcs)), key=lambda x: x[0])
    assert toxicity.viterbi(token, model) == reading(best[1])


def test_doubled_letters_by_enumeration_equal_the_search():
    rng = np.random.default_rng(9)
    for seed in range(3):
        restorer = toxicity.Restorer(some_model(seed))
        restorer.segment("a")
        for _ in range(150):
            word = "".join(rng.choice(list("abcl"), rng.integers(2, 9)))
            if any(word[k] == word[k - 1] == word[k - 2] for k in range(2, len(word))):
                continue
            assert restorer.doubled(word) == toxicity.viterbi(word, restorer.quick, restorer.model).split(), word
