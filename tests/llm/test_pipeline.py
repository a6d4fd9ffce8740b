"""The corpus pipeline: columns, decisions, the whole run against its stages, and these against plain Python."""

import collections
import hashlib
import random
import re

import pytest

import corpus_pipeline
from tickloom.llm import line_dedup, mixing, toxicity

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    lines = [f"a sentence about subject {k} that is long enough to count as a line" for k in range(40)]
    docs, labels, rng = [], [], random.Random(1)
    words = ["".join(rng.choice("bcdfgklmprst") + rng.choice("aeou") for _ in range(3)) for _ in range(900)]
    for k in range(240):
        body = "\n".join([lines[k % 7], *(" ".join(rng.choices(words, k=9)) for _ in range(4))])
        if k % 10 == 3:
            body += "\nyou idiot"
        docs.append((k, body, "en", f"s{k % 9}", len(body)))
        labels.append((k, 1, int(k % 10 == 3)))
    docs += [(1000 + k, docs[0][1], "en", "s1", 5) for k in range(3)] + [docs[5], (2000, None, None, None, None), (None, "no id here at all but some words", "en", "s2", 3), (2001, "", "en", "s3", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as score").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder).cache()
        yield name, before, docs


def test_each_stage(spark, corpus):
    seen = {}
    for name, before, after in stages(spark, corpus):
        seen[name] = (before.collect(), after.collect())
        if name != "sentencepiece":
            assert after.columns == COLUMNS
    before, after = seen["toxicity"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {k for k in range(240) if k % 10 == 3}
    before, after = seen["line_dedup"]
    shared = collections.Counter(line for r in after for line in (r.text or "").split("\n") if line.startswith("a sentence"))
    assert shared and max(shared.values()) <= 2 and len(after) >= len({r.doc_id for r in before}) - 3
    before, after = seen["ngram_jaccard_join"]
    texts = [r.text for r in after if r.text]
    assert len(texts) == len(set(texts)) and {t for t in texts} == {r.text for r in before if r.text}
    before, after = seen["mixing"]
    taken = collections.Counter(r.doc_id for r in after)
    assert taken and max(taken.values()) <= mixing.MAX_REPEATS and set(taken) <= {r.doc_id for r in before}
    before, after = seen["sentencepiece"]
    assert len(after) == len(before) and all(r.n_tokens == len(r.ids) >= 2 for r in after)


def test_run_equals_its_stages(spark, corpus):
    *_, (_, _, last) = stages(spark, corpus)
    key = lambda df: collections.Counter((r.doc_id, r.source, tuple(r.ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, corpus)) == key(last)


def plain_lines(rows):
    """Line dedup in plain Python: (row, text) for what stays."""
    key = lambda line: line.strip(" \t\r").lower()
    long = lambda line: len(line) >= line_dedup.MIN_CHARS and len(key(line)) >= line_dedup.MIN_CHARS
    place = lambda r: (r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).hexdigest())
    sites, first = collections.defaultdict(set), {}
    for r in rows:
        for line in (r.text or "").split("\n"):
            if long(line):
                sites[key(line)].add(r.source)
                first[key(line)] = min(first.get(key(line), place(r)), place(r))
    out = []
    for r in rows:
        lines = (r.text or "").split("\n")
        left = [x for x in lines if not (long(x) and len(sites[key(x)]) >= line_dedup.MIN_SITES and first[key(x)] != place(r))]
        text = r.text if left == lines else "\n".join(left)
        if left == lines or text.strip(" \t\r\n"):
            out.append((r.doc_id, text, r.source))
    return out


def plain_groups(rows):
    """Ids kept of groups of near duplicates: the smallest of each, null last."""

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])

    sets, root = [shingles(r.text) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    chief = {}
    for k, r in enumerate(rows):
        chief[root[k]] = min(chief.get(root[k], (True, 0)), (r.doc_id is None, r.doc_id or 0))
    return sorted(chief.values())


def test_stages_against_plain_python(spark, corpus, tmp_path):
    import sentencepiece

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    near = docs.where("doc_id in (11, 25, 42)").selectExpr("doc_id + 3000 as doc_id", "concat(text, ' changed') as text", "lang", "'s2' as source", "n_chars", "score")
    docs.unionByName(near).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {name: (before.collect(), after.collect()) for name, before, after in stages(spark, str(tmp_path))}
    assert not {3011, 3025, 3042} & {r.doc_id for r in seen["ngram_jaccard_join"][1]}
    before, after = seen["line_dedup"]
    assert collections.Counter((r.doc_id, r.text, r.source) for r in after) == collections.Counter(plain_lines(before))
    before, after = seen["ngram_jaccard_join"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == plain_groups(before)
    before, after = seen["mixing"]
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    size, taken = collections.Counter(), collections.Counter()
    for rows, total in ((before, size), (after, taken)):
        for r in rows:
            total[r.source] += words(r)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    level, full = 0.0, set()
    while True:  # share what is left by weight, until no target is above three times its size
        free = [s for s in names if s not in full]
        level = (sum(size.values()) - sum(3 * size[s] for s in full)) / sum(weight[s] for s in free) if free else 0.0
        more = {s for s in free if level * weight[s] >= 3 * size[s]}
        if not more:
            break
        full |= more
    for s in names:
        target = 3 * size[s] if s in full else level * weight[s]
        assert abs(taken[s] - target) <= max((words(r) for r in before if r.source == s), default=0)
    before, after = seen["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.sentencepiece_io.model_path())
    want = collections.Counter((r.doc_id, tuple(library.encode(r.text or "", add_bos=True, add_eos=True))) for r in before)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in after) == want


def test_empty_corpus(spark, corpus, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert 0 < toxicity.THRESHOLD < 1
