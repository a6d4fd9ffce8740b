"""Token alignment against brute force over byte offsets, links in parts, counts with and without the broadcast table, edge cases."""

import bisect
import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import alignment

FIXTURE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_tokens(texts, paths):
    """Ids and byte strings of both sides by the libraries alone."""
    import json

    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
    t.encode_special_tokens = True
    own = [k for k in range(256) if 33 <= k < 127 or 161 <= k < 173 or k >= 174]
    letters = {chr(k): k for k in own} | {chr(256 + n): k for n, k in enumerate(k for k in range(256) if k not in own)}
    words = {k: w for w, k in json.load(open(paths[0]))["model"]["vocab"].items()}
    out = []
    for text in texts:
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = sp.encode(text or "")
        bytes_a = [bytes(letters[c] for c in words[k]) for k in a]
        bytes_b = [bytes([int(sp.id_to_piece(k)[1:-1], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode() for k in b]
        whole = (" " + text).encode() if text else b""
        out.append((a, b, bytes_a, bytes_b) if whole and b"".join(bytes_a) == b"".join(bytes_b) == whole else ([], [], [], []))
    return out


def brute_force(texts, paths):
    """Each text's figures, from sets of end offsets and all pairs in plain Python."""
    grouped = []
    for a, b, bytes_a, bytes_b in plain_tokens(texts, paths):
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        both = sorted(set(ends(bytes_a)) & set(ends(bytes_b)))
        groups = [([], []) for _ in both]
        for side, ids, at in ((0, a, ends(bytes_a)), (1, b, ends(bytes_b))):
            for k, end in zip(ids, at, strict=True):
                groups[bisect.bisect_left(both, end)][side].append(k)
        grouped.append((a, b, groups))
    links = [[(x, y) for g in groups for x in g[0] for y in g[1]] for _, _, groups in grouped]
    counts = collections.Counter(p for some in links for p in set(some))
    most = collections.Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (a, b, groups), some in zip(grouped, links, strict=True):
        printed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(printed.encode()).hexdigest() if printed else ""
        out.append((len(a), len(b), len(groups), len(some), sum(counts[p] == most[p[0]] for p in some), sum(counts[p] for p in some), digest))
    return out


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_by_brute_force(spark, paths):
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in docs], brute_force([r.text for r in docs], paths), strict=True))
    got = alignment.op12_token_alignment(spark, FIXTURE)
    assert set(got.columns) == {"doc_id", *FIGURES}
    assert {r.doc_id: tuple(r[c] for c in FIGURES) for r in got.collect()} == want


def test_edge_cases_parts_and_rare_pairs(spark, paths, edge_docs, no_docs, monkeypatch):
    odd = [(20, "the the the theatre " * 50, 1), (21, "▁ is in the text", 1), (22, "<s> </s> <0x41> <|endoftext|>", 1), (23, " " * 1000 + "x\n\n\n\ty", 1), (24, "  　 wide  spaces", 1), (25, "ЪѣѢ ᚠᛇᚻ 𝔘𝔫𝔦", 1)]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string, x int").drop("x")).selectExpr("*", "1 as n_links", "'r' as row", "'p' as part", "2 as old", "'t' as times")
    rows = docs.collect()
    want = collections.Counter(zip([r.doc_id for r in rows], brute_force([r.text for r in rows], paths), strict=True))
    for size, part, frequent in ((1 << 20, 1 << 16, 1 << 19), (300, 7, 40), (300, 50, 0)):
        for name, value in (("LINKS", size), ("PART", part)):
            monkeypatch.setattr(alignment, name, value)
        out = alignment.link_counts(docs, *paths, frequent=frequent)
        assert out.columns == ["doc_id", "row", "part", "old", "times", *FIGURES]
        assert collections.Counter((r.doc_id, tuple(r[c] for c in FIGURES)) for r in out.collect()) == want
        assert {(r.row, r.part, r.old, r.times) for r in out.collect()} == {("r", "p", 2, "t")}
    assert alignment.link_counts(no_docs, *paths).count() == 0
    aligned = alignment.align(edge_docs, *paths).collect()
    known = {r.text: (a, b) for r, (a, b, _, _) in zip(rows, plain_tokens([r.text for r in rows], paths), strict=True)}
    for r in aligned:
        assert (r.a_ids, r.b_ids) == known[r.text] and sum(r.a_sizes) == len(r.a_ids) and sum(r.b_sizes) == len(r.b_ids) and len(r.a_sizes) == len(r.b_sizes)


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), max_size=12), st.integers(0, 10**6)), min_size=1, max_size=4))
def test_components_are_the_minimal_groups(tilings):
    for sizes, seed in tilings:
        total, rng = sum(sizes), np.random.default_rng(seed)
        ends_a = np.cumsum(sizes).astype(np.int64)
        inner = np.flatnonzero(rng.random(max(0, total - 1)) < 0.4) + 1
        ends_b = np.append(inner, total).astype(np.int64) if total else np.empty(0, dtype=np.int64)
        group_a, group_b = alignment.components(ends_a, ends_b)
        both = np.intersect1d(ends_a, ends_b)
        assert group_a.tolist() == np.searchsorted(both, ends_a).tolist() and group_b.tolist() == np.searchsorted(both, ends_b).tolist()


class Fake:
    """Two made-up tokenizers whose cuts never meet inside a text."""

    size_a = size_b = np.array([1, 2, 3, 5])

    def all_tokens(self, texts):
        out = []
        for t in texts:
            n = len(t)
            out.append(([0] + [1] * (n // 2), [1] * (n // 2) + [0]) if n else ([], []))
        return out


def test_one_group_of_a_whole_text(monkeypatch):
    monkeypatch.setattr(alignment, "LINKS", 1000)
    b = alignment.Batch(Fake(), ["x" * 200_000, "", "x" * 10])
    assert b.n_groups.tolist() == [1, 0, 1] and b.n_links.tolist() == [100_001**2, 0, 36]
    got = collections.defaultdict(int)
    for k, pairs, times in b.pairs():
        for p, n in zip(pairs.tolist(), times.tolist(), strict=True):
            assert (k, p) not in got
            got[k, p] = n
    one = alignment.PAIR
    assert got == {(0, 1): 100_000, (0, 0): 1, (0, one): 100_000, (0, one + 1): 100_000**2, (2, 1): 5, (2, 0): 1, (2, one): 5, (2, one + 1): 25}
