"""Language identification: held-out accuracy, the codes, n-grams by brute force, edge cases."""

import collections

import numpy as np
import pytest

from tickloom.llm import lang_id

FIXTURE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FIXTURE}/documents.parquet")


def test_held_out_accuracy(spark, docs):
    import zlib

    got = {r.doc_id: r for r in lang_id.op11_lang_id(spark, FIXTURE).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert got.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    held = [k for k, r in got.items() if r.held_out]
    assert sum(got[k].lang_pred == truth[k] for k in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_learns_nothing_from_the_held_out_fold(spark, docs):
    rows = docs.select("doc_id", "text", "lang")
    changed = rows.withColumn("held", lang_id.fold() == 2).selectExpr("doc_id", "if(held, upper(text), text) text", "if(held, 'xx', lang) lang")
    one, two = lang_id.train(rows), lang_id.train(changed)
    assert one.languages == two.languages and np.array_equal(one.weights, two.weights) and np.array_equal(one.trust, two.trust)


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20, 60])
def test_code_words_are_apart_and_columns_split(n):
    code = lang_id.code_words(n)
    distance = [(a != b).sum() for k, a in enumerate(code) for b in code[:k]]
    assert len(code) == n and set(np.unique(code)) == {-1.0, 1.0} and (np.abs(code.sum(axis=0)) < n).all()
    if n <= lang_id.EXHAUSTIVE:
        assert set(distance) == {2 ** (n - 2)} and len(np.unique(code, axis=1).T) == code.shape[1]
    else:
        assert min(distance) >= code.shape[1] * 0.2


def test_a_wrong_bit_is_corrected():
    code = lang_id.code_words(5)
    for k in range(5):
        for bit in range(code.shape[1]):
            margins = code[k] * 4.0
            margins[bit] *= -1
            model = lang_id.LanguageModel(list("abcde"), code, np.zeros((lang_id.BUCKETS, code.shape[1])), margins, np.full(code.shape, 1 / code.shape[1]))
            assert model.predict("x")[0] == "abcde"[k]
    torn = lang_id.LanguageModel(list("ab"), lang_id.code_words(2), np.zeros((lang_id.BUCKETS, 1)), np.array([0.01]), np.ones((2, 1)))
    name, chance, ambiguous = torn.predict("x")
    assert name == "a" and 0.5 < chance < 0.51 and ambiguous


def test_grams_by_brute_force(monkeypatch):
    def plain(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        joined = " " + " ".join(words) + ("" if text[-1:].isalpha() else " ")
        out = []
        for n in lang_id.ORDERS:
            for k in range(len(joined) - n + 1):
                if n == 1 and joined[k] == " ":
                    continue
                value = 0
                for j, c in enumerate(joined[k : k + n]):
                    value = ((value * 0x9E3779B1 if j else 0) + ord(c) + j + 1) % 2**32
                out.append(((value ^ value >> 15) * 0x85EBCA6B % 2**32) >> (32 - lang_id.BUCKET_BITS))
        return collections.Counter(out)

    for piece in (7, 1 << 18):
        monkeypatch.setattr(lang_id, "PIECE", piece)
        for text in ("Hello, wörld", "a", "x1y2  z.", "日本語 text — and more of it!", "é" * 40):
            assert collections.Counter(np.concatenate(lang_id.grams(text)).tolist()) == plain(text), text
    assert lang_id.grams("12 ... ") == [] and lang_id.grams("") == []


def test_edge_cases(spark, edge_docs, no_docs):
    model = lang_id.train(edge_docs)
    out = lang_id.identify(edge_docs, model)
    assert out.columns == [c for c in edge_docs.columns if c != "score"] + ["lang_pred", "score", "ambiguous"]
    rows = out.collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        lettered = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und" and r.score == 0) if not lettered else (r.lang_pred in model.languages and 0 <= r.score <= 1)
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 1}) == 1
    empty = lang_id.train(no_docs)
    assert empty.languages == [] and lang_id.identify(no_docs, empty).count() == 0
    assert {r.lang_pred for r in lang_id.identify(edge_docs, empty).collect()} == {"und"}
    one = lang_id.train(edge_docs.where("lang = 'en'"))
    assert one.languages == ["en"] and one.predict("anything") == ("en", 1.0, False)


def test_a_model_of_many_languages(spark):
    rows = [(17 * k + j, " ".join(f"{chr(97 + k)}{chr(97 + (k + j + i) % 24)}{chr(97 + k)}" for i in range(30 + j)), f"l{k:02}") for k in range(12) for j in range(17)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(df)
    assert len(model.languages) == 12
    got = lang_id.identify(df, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
