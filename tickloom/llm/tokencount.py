"""Token counts by a two-tier lookup on the map side.

A pre-token always gives the same number of tokens, whatever stands around it. The frequent ones of the corpus are
counted by task in bounded summaries, their token lengths are broadcast as a compact hash table, and all others are
encoded once by the worker that meets them and kept in its cache. No pre-token is shuffled but those of the summaries.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import map_rows, named, table, without

#: Characters of whose classes every Unicode version and both pattern engines think alike. What stands between two cuts (see CUT) and holds
#: others is one entry of the lookup, like a pre-token.
PLAIN_SPANS = ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA0, 0x233), (0x391, 0x3A1), (0x3A3, 0x3CE), (0x410, 0x44F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20AC))


def _class(*majors: str) -> str:
    """Plain characters whose Unicode category begins with one of majors, for a character class."""
    return "".join(re.escape(chr(k)) for first, last in PLAIN_SPANS for k in range(first, last + 1) if unicodedata.category(chr(k))[0] in majors)


ODD = re.compile(f"[^{''.join(f'{chr(a)}-{chr(b)}' for a, b in PLAIN_SPANS)}]")
#: A place before a space and after a character that no Unicode version takes for white space: no pre-token spans it.
CUT = re.compile("(?<=[!-~\u00a1-\u167f\u1681-\u180d\u180f-\u1fff\u3001-\ud7ff\U00010000-\U0010ffff])(?= )")
#: The byte-level pre-tokenizer's pattern (fixed value of the tokenizer's format), with its letter and number classes spelled out for plain characters.
_L, _N = _class("L"), _class("N")
PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
#: Entries of the broadcast table; entries that a task adds to the summary; distinct pre-tokens a task counts before it drops the rarest.
FREQUENT, SUMMARY, COUNTED = 32_768, 4_096, 100_000
#: Entries of a worker's cache, and characters of the longest pre-token kept in it.
CACHED, LONGEST = 400_000, 64
BATCH_TEXTS = 256


class Counting:
    """A tokenizer with the parts of it that counting needs."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.special = [t.content for t in added]
        #: Whether added tokens leave the text around them as it is, so that it may be cut
        self.cuts = not any(t.lstrip or t.rstrip or t.single_word or " " in t.content for t in added)
        self.cache: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        """Counts by the library alone."""
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def plain(self, text: str) -> bool:
        """Whether text can be cut by the pattern: plain characters and no added token."""
        return ODD.search(text) is None and not any(s in text for s in self.special)

    def pieces(self, text: str) -> list[str]:
        """Stretches of text whose token counts add up to its count: pre-tokens, and what holds characters that are not plain."""
        if self.plain(text):
            return PATTERN.findall(text)
        if not self.cuts:
            return [text]
        return [w for part in CUT.split(text) for w in (PATTERN.findall(part) if self.plain(part) else [part])]


@lru_cache(maxsize=4)
def counting(path: str) -> Counting:
    """The tokenizer at path, once a worker."""
    return Counting(path)


class Frequent:
    """Sorted 64-bit hashes of frequent pre-tokens and their token counts, two plain arrays of at most FREQUENT entries."""

    def __init__(self, words: list[str], counts: list[int]) -> None:
        keys = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in words], dtype=np.uint64)
        keys, at, same = np.unique(keys, return_index=True, return_counts=True)
        sure = same == 1  # words whose hashes meet are left to the caches
        self.keys, self.counts = keys[sure], np.array(counts, dtype=np.uint16)[at][sure]

    def get(self, words: list[str]) -> np.ndarray:
        """Counts of words, 0 where the table has none."""
        if not len(self.keys) or not words:
            return np.zeros(len(words), dtype=np.int64)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), dtype=np.uint64, count=len(words))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.counts[at], 0).astype(np.int64)


def frequent_pretokens(df: DataFrame, path: str, text: str = "text", limit: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of all texts by the tasks' summaries, at most limit.

    Each task counts all its texts, drops the rarest half when it holds more than COUNTED distinct ones, and hands on
    its SUMMARY most frequent, whose sums are merged. Errors cost a cache miss later and never change a count.
    """

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, seen = counting(path), Counter()
        for batch in batches:
            for x in batch["text"]:
                if x:
                    seen.update(w for w in c.pieces(x) if len(w) <= LONGEST)
                    if len(seen) > COUNTED:
                        seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = seen.most_common(SUMMARY)
        yield pd.DataFrame({"word": [w for w, _ in top], "n": [n for _, n in top]}).astype({"word": "object", "n": "int64"})

    parts = df.select(named(text).alias("text")).where("text is not null").mapInPandas(summary, "word string, n long")
    rows = parts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(limit).select("word").collect()
    return [r.word for r in rows]


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens", limit: int = FREQUENT) -> DataFrame:
    """Add the number of tokens of each whole text, as the library counts them without special tokens added.

    Null counts as empty: 0 tokens. Added tokens inside a text count as the library takes them by default. Long texts are counted
    whole; rows are independent, so repeated rows give repeated counts. A column of df named out is replaced. An empty table stays
    empty. path is a file that every executor has.
    """
    words = frequent_pretokens(df, path, text, limit)
    known = df.sparkSession.sparkContext.broadcast(Frequent(words, counting(path).whole(words)))

    def count(texts: list[str | None]) -> tuple:
        c, frequent = counting(path), known.value
        cache = c.cache
        cut = [c.pieces(x) if x else [] for x in texts]
        fresh = [w for w in {w for words in cut for w in words} if w not in cache]
        for lo in range(0, len(fresh), 8192):
            new = fresh[lo : lo + 8192]
            sizes = frequent.get(new)
            missing = np.flatnonzero(sizes == 0)
            sizes[missing] = c.whole([new[k] for k in missing])
            cache.update(zip(new, sizes.tolist(), strict=True))
        counts = [sum(map(cache.__getitem__, words)) for words in cut]
        for w in fresh:
            if len(w) > LONGEST:
                del cache[w]
        if len(cache) > CACHED:
            cache.clear()
        return None, counts

    return map_rows(df, without(df, out), [text], f"`{out}` long", count, rows=BATCH_TEXTS)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of each whole document and whether they exceed 512."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
