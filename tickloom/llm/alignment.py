"""Alignment of two tokenizers' tokens, and counts of linked pairs of ids over all documents.

Tokens of both tokenizers that share bytes are joined by union-find; each connected component is a minimal group, the shortest stretch
that both cut out whole. All pairs of a group's two sides are links. Links are counted by document in partial sums; the counts of
frequent pairs come back to the documents in a broadcast table of fixed size, those of the others by a join.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.llm.common import SPACE, map_rows, named, release_memory, shared_checkpoint, shared_folder, table, without
from tickloom.llm.tokencount import ODD

#: Pre-tokenizer pattern of byte-level tokenizers (fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with runs of this many bytes of one kind, white space or not, are left to the library itself.
LONG_RUN = 400
#: A pair of ids is one number: the first id times this, plus the second.
PAIR = 1 << 32
#: Bytes of text aligned at once; links of one document expanded at once; pairs of the broadcast table at most.
BATCH_BYTES, LINKS, FREQUENT = 1 << 18, 1 << 20, 1 << 19
#: Pairs of one row of the table of linked pairs at most, and rows of it looked up at once.
PART, ROWS = 1 << 16, 512
#: Output columns of align() and their types.
COLUMNS = {
    "a_ids": "array<int>",
    "b_ids": "array<int>",
    "a_sizes": "array<int>",
    "b_sizes": "array<int>",
    "n_a": "long",
    "n_b": "long",
    "n_groups": "long",
    "n_links": "long",
    "groups_sha256": "string",
}


def longest_run(text: str) -> int:
    """Bytes of the longest run of ASCII white space, or of anything else."""
    space = SPACE[np.frombuffer(text.encode(), dtype=np.uint8)]
    return int(np.diff(np.concatenate(([-1], np.flatnonzero(space[1:] != space[:-1]), [len(space) - 1]))).max())


class ByteLevel:
    """A byte-level tokenizer (a .json file): ids of texts, special strings taken as plain text, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        # printable characters stand for their own byte, the others for the code points from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(self.tokenizer.get_vocab().values(), default=-1) + 1)
        for word, k in vocabulary.items():
            self.bytes[k] = bytes(byte_of[c] for c in word)
        self.quick = self._ranked(path, {self.bytes[k]: k for w, k in vocabulary.items()})

    def _ranked(self, path: str, ranks: dict[bytes, int]):
        """The same tokenizer by ranks of byte strings, if its merges stand in the order of their ids; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = {t["content"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"]["".join(m)] for m in merges]
        plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec["normalizer"]
        if not plain or made != sorted(made) or not all(bytes([k]) in ranks for k in range(256)) or any(spec["model"].get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={b: k for b, k in ranks.items() if k not in {spec["model"]["vocab"].get(a) for a in added}}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. Characters on whose class pattern engines may differ, and long runs, go to the library itself."""
        slow = [k for k, t in enumerate(texts) if self.quick is None or longest_run(t) >= LONG_RUN or ODD.search(t)]
        exact = dict(zip(slow, (e.ids for e in self.tokenizer.encode_batch_fast([texts[k] for k in slow], add_special_tokens=False)), strict=True)) if slow else {}
        return [exact[k] if k in exact else self.quick.encode_ordinary(t) for k, t in enumerate(texts)]


class Pieces:
    """A sentencepiece model (a .model file): ids of texts, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        n = self.processor.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.processor.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(self.processor.id_to_piece(list(range(n))))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, out_type=int, num_threads=1)


class Aligner:
    """Two tokenizers and their tables of token lengths and printed ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (self.a, self.b))
        # ids as they are printed: twice as many of the first as it has, the later ones at a group's end, then those of the second
        self.printed = [f"{k}{mark}" for t, marks in ((self.a, ",|"), (self.b, ",;")) for mark in marks for k in range(len(t.bytes))]

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides of one text; none where the joined bytes are not a blank and the text."""
        return self.all_tokens([text])[0]

    def all_tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        spaced = [" " + t for t in texts]
        out = []
        for text, a, b in zip(spaced, self.a.encode(spaced), self.b.encode(texts), strict=True):
            raw = text.encode()
            whole = len(raw) > 1 and b"".join(map(self.a.bytes.__getitem__, a)) == raw and b"".join(map(self.b.bytes.__getitem__, b)) == raw
            out.append((a, b) if whole else ([], []))
        return out


@lru_cache(maxsize=4)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The tokenizers at two paths, once a worker."""
    return Aligner(path_a, path_b)


def union_find(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node of its component under edges (u, v).

    In each round the larger root of every open edge is hooked to the smaller one, and all paths are then halved until flat.
    """
    root = np.arange(n, dtype=np.int64)
    while True:
        a, b = root[u], root[v]
        open_ = np.flatnonzero(a != b)
        if not len(open_):
            return root
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group, from 0, of each token of two tilings of the same bytes, given where their tokens end.

    Tokens are nodes and an overlap is an edge: between two neighbouring ends of either side lies exactly one token of each.
    """
    ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
    ends = ends[np.append(ends[1:] != ends[:-1], True)[: len(ends)]]
    n = len(ends_a)
    root = union_find(np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends) + n, n + len(ends_b))
    # a component's smallest node is its first token of side a, so groups are numbered in the order of the text
    number = np.cumsum(root[:n] == np.arange(n)) - 1
    return number[root[:n]], number[root[n:]]


class Batch:
    """Aligned texts, all in one: ids and groups of both sides, sizes of the groups, and where each text's parts begin."""

    def __init__(self, al: Aligner, texts: list[str | None]) -> None:
        tokens = [(a, b) for a, b in al.all_tokens([t or "" for t in texts])]
        self.al, self.texts = al, len(texts)
        counts = np.array([(len(a), len(b)) for a, b in tokens], dtype=np.int64).reshape(-1, 2)
        self.n_a, self.n_b = counts[:, 0], counts[:, 1]
        self.a, self.b = (np.fromiter(chain.from_iterable(t[k] for t in tokens), dtype=np.int64, count=int(counts[:, k].sum())) for k in (0, 1))
        self.group_a, self.group_b = components(np.cumsum(al.size_a[self.a]), np.cumsum(al.size_b[self.b]))
        n = int(self.group_a[-1]) + 1 if len(self.group_a) else 0
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        self.at_a, self.at_b = (np.concatenate(([0], np.cumsum(x))) for x in (self.n_a, self.n_b))
        # groups never span texts, since both sides end where a text ends
        self.at_group = np.concatenate((self.group_a, [n]))[self.at_a]
        self.n_groups = np.diff(self.at_group)
        sums = np.concatenate(([0], np.cumsum(self.size_a * self.size_b)))
        self.n_links = np.diff(sums[self.at_group])

    def digests(self) -> list[str]:
        """SHA-256 of each text's printed groups; '' for a text without tokens."""
        before_a, before_b = np.cumsum(self.size_a), np.concatenate(([0], np.cumsum(self.size_b)))[:-1]
        last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
        codes = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        vocabulary = len(self.al.size_a)
        codes[np.arange(len(self.a)) + before_b[self.group_a]] = self.a + vocabulary * last(self.group_a)
        codes[np.arange(len(self.b)) + before_a[self.group_b]] = self.b + 2 * vocabulary + len(self.al.size_b) * last(self.group_b)
        at, printed = self.at_a + self.at_b, self.al.printed.__getitem__
        joined = ("".join(map(printed, codes[at[k] : at[k + 1]].tolist()))[:-1] for k in range(self.texts))
        return [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in joined]

    def pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, pairs of ids, how often each is linked in it), each pair of a text once, in parts of bounded size."""
        ordinary = np.flatnonzero(self.n_links <= LINKS)
        run: list[int] = []
        for k in [*ordinary.tolist(), -1]:
            if run and (k < 0 or self.n_links[run].sum() + self.n_links[k] > LINKS):
                yield from self._expand(run)
                run = []
            run.append(k)
        for k in np.flatnonzero(self.n_links > LINKS).tolist():
            yield from self._expand_wide(k)

    def _expand(self, run: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Pairs of some texts with few links: all links, sorted by text and pair."""
        mine = np.concatenate([np.arange(self.at_a[k], self.at_a[k + 1]) for k in run])
        group = self.group_a[mine]
        each = self.size_b[group]
        first_b = np.concatenate(([0], np.cumsum(self.size_b)))[:-1]
        a = np.repeat(mine, each)
        step = np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each)
        pair = self.a[a] * PAIR + self.b[np.repeat(first_b[group], each) + step]
        text = np.repeat(np.repeat(np.array(run), self.n_a[run]), each)
        order = np.lexsort((pair, text))
        pair, text = pair[order], text[order]
        new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (text[1:] != text[:-1]))[: len(pair)])
        times = np.diff(np.append(new, len(pair)))
        pair, text = pair[new], text[new]
        bounds = np.searchsorted(text, np.append(run, run[-1] + 1))
        for k, lo, hi in zip(run, bounds[:-1], bounds[1:], strict=True):
            if hi > lo:
                yield k, pair[lo:hi], times[lo:hi]

    def _expand_wide(self, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Pairs of one text with very many links, for ranges of the first ids: groups become distinct ids and how often each stands there."""
        a, b = slice(self.at_a[k], self.at_a[k + 1]), slice(self.at_b[k], self.at_b[k + 1])
        (group_a, id_a), times_a = np.unique(np.stack((self.group_a[a], self.a[a])), axis=1, return_counts=True)
        (group_b, id_b), times_b = np.unique(np.stack((self.group_b[b], self.b[b])), axis=1, return_counts=True)
        order = np.argsort(id_a, kind="stable")
        group_a, id_a, times_a = group_a[order], id_a[order], times_a[order]
        low, high = np.searchsorted(group_b, group_a), np.searchsorted(group_b, group_a, "right")
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, start = 0, 0
        while start < len(id_a):
            # entries with as many links as fit, one at least; an entry has no more than the second tokenizer has ids
            stop = start + max(1, int(np.searchsorted(np.cumsum((high - low)[start : start + LINKS]), LINKS, "right")))
            each = (high - low)[start:stop]
            at = np.repeat(low[start:stop], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            held.append(merged([(np.repeat(id_a[start:stop], each) * PAIR + id_b[at], np.repeat(times_a[start:stop], each) * times_b[at])]))
            size, start = size + len(held[-1][0]), stop
            closed = start == len(id_a) or id_a[start] != id_a[start - 1]
            if closed or size > LINKS:
                held = [merged(held)]
                size = len(held[0][0])
            if closed:
                yield k, *held[0]
                held, size = [], 0


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts and the sums of their values."""
    keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = np.zeros(len(keys), dtype=np.int64)
    np.add.at(sums, place, np.concatenate([p[1] for p in parts]))
    return keys, sums


def portions(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of about BATCH_BYTES characters; a text is never cut."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_BYTES or k + 1 == len(texts):
            yield slice(first, k + 1)
            first, size = k + 1, 0


def align(df: DataFrame, path_a: str, path_b: str, text: str = "text", columns: tuple[str, ...] = ("a_ids", "b_ids", "a_sizes", "b_sizes")) -> DataFrame:
    """Align a blank and the text, by the byte-level tokenizer at path_a, with the text by the sentencepiece model at path_b (which adds the blank).

    Returns the columns of df and the wanted ones of COLUMNS: the ids of both sides, and for each minimal group how many ids of either
    side it takes, in order. Null and empty texts, and texts whose tokens of either side do not give the blank and the text again, have
    no tokens. Rows are independent: repeated rows give repeated results, texts are taken whole, an empty table stays empty.
    Columns of df with a wanted name are replaced. Every executor has the files.
    """
    wanted = list(columns)

    def kernel(texts: list[str | None]) -> tuple:
        out = {c: [] for c in wanted}
        for part in portions(texts):
            b = Batch(aligner(path_a, path_b), texts[part])
            lists = {"a_ids": (b.a, b.at_a), "b_ids": (b.b, b.at_b), "a_sizes": (b.size_a, b.at_group), "b_sizes": (b.size_b, b.at_group)}
            for c in wanted:
                if c in lists:
                    values, at = lists[c]
                    out[c] += [values[x:y].astype(np.int32) for x, y in zip(at[:-1], at[1:], strict=True)]
                else:
                    out[c] += b.digests() if c == "groups_sha256" else getattr(b, c).tolist()
        return None, *out.values()

    return map_rows(df, without(df, *wanted), [text], ", ".join(f"{c} {COLUMNS[c]}" for c in wanted), kernel)


def linked_pairs(df: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """Rows of df without the text, with n_a, n_b, n_groups, n_links, groups_sha256, and their distinct linked pairs: a table in the shared folder.

    Column row numbers the rows of df, column old holds their other columns. A row whose links are many comes in several parts
    (part 0, 1, ...), with different pairs; all but the pairs is the same in them.
    """
    kept = without(df, text)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.struct(*map(named, kept)).alias("old") if kept else F.lit(0).alias("old"), named(text).alias("text"))
    made = "part int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    schema = StructType([*rows.drop("text").schema.fields, *df.sparkSession.createDataFrame([], made).schema.fields])
    names = [f.name for f in schema]

    def lists(values: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0, dtype=np.int64), type=pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                some = whole.slice(first, 256)
                texts = some.column(2).to_pylist()
                for piece in portions(texts):
                    yield from portion(Batch(al, texts[piece]), some.slice(piece.start, piece.stop - piece.start))
        release_memory()

    def portion(b: Batch, old: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        digests, parts, seen, held = np.array(b.digests(), dtype=object), [], np.zeros(b.texts, dtype=np.int32), 0
        for k, pairs, times in chain(b.pairs(), ((k, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)) for k in np.flatnonzero(b.n_links == 0).tolist())):
            for first in range(0, max(1, len(pairs)), PART):
                parts.append((k, int(seen[k]), pairs[first : first + PART], times[first : first + PART]))
                seen[k] += 1
            held += len(pairs)
            if held > LINKS:
                yield rows_of(b, old, digests, parts)
                parts, held = [], 0
        if parts:
            yield rows_of(b, old, digests, parts)

    def rows_of(b: Batch, old: pa.RecordBatch, digests: np.ndarray, parts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        at = np.array([p[0] for p in parts], dtype=np.int64)
        numbers = [pa.array(x[at], type=pa.int64()) for x in (b.n_a, b.n_b, b.n_groups, b.n_links)]
        columns = [*(old.column(k).take(pa.array(at)) for k in (0, 1)), pa.array([p[1] for p in parts], type=pa.int32()), *numbers]
        return pa.RecordBatch.from_arrays([*columns, pa.array(digests[at], type=pa.string()), lists([p[2] for p in parts]), lists([p[3] for p in parts])], names=names)

    folder = f"{shared_folder(df.sparkSession)}/aligned-{uuid.uuid4().hex}"
    rows.mapInArrow(run, schema).write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def pair_counts(linked: DataFrame) -> DataFrame:
    """Documents that link each pair of ids, over all rows of linked_pairs(): pair, n, and best (no pair of its first id has more).

    Sums are combined before the shuffle. The highest counts by first id are at most as many as the first tokenizer has ids, and are broadcast.
    """
    counts = shared_checkpoint(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    first = F.shiftright("pair", 32)
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(highest), first == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


class Known:
    """Counts of frequent pairs: sorted pairs, their counts and whether each is its first id's best."""

    def __init__(self, rows: pa.Table) -> None:
        pair = rows["pair"].to_numpy()
        order = np.argsort(pair)
        self.pair, self.n, self.best = pair[order], rows["n"].to_numpy()[order], rows["best"].to_numpy(zero_copy_only=False)[order]

    def sums(self, pairs: np.ndarray, times: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of counts and of best links for the rows whose pairs begin at at, and which pairs are unknown."""
        place = np.minimum(np.searchsorted(self.pair, pairs), max(0, len(self.pair) - 1))
        known = self.pair[place] == pairs if len(self.pair) else np.zeros(len(pairs), dtype=bool)
        place = place if len(self.pair) else np.zeros(0, dtype=np.int64)
        total, best = np.zeros(len(pairs) + 1, dtype=np.int64), np.zeros(len(pairs) + 1, dtype=np.int64)
        if len(self.pair):
            np.cumsum(np.where(known, times * self.n[place], 0), out=total[1:])
            np.cumsum(np.where(known & self.best[place], times, 0), out=best[1:])
        return np.diff(total[at]), np.diff(best[at]), ~known


def link_counts(df: DataFrame, path_a: str, path_b: str, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Align each whole text (see align()) and hold its links against the counts of their pairs over all rows.

    Returns the columns of df but the text, and n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many rows as any of its first
    id's), count_sum (rows of its pair, summed over links) and groups_sha256. Rows without tokens have zeros and ''. Repeated rows are
    documents of their own and count twice. Texts are taken whole. Counts of at most frequent pairs, the most frequent, are
    broadcast; all others, none of which is in more rows than those, are joined. An empty table stays empty. Columns of df with the
    names of the results are replaced; no other name clashes.
    """
    spark = df.sparkSession
    made = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    linked = linked_pairs(df.select(*map(named, without(df, *made))), path_a, path_b, text)
    counts = shared_checkpoint(pair_counts(linked))
    # the least power of two from which on there are few enough pairs
    sizes = counts.groupBy(F.floor(F.log2(F.col("n") + 0.5)).alias("power")).agg(F.count("*").alias("pairs")).orderBy(F.desc("power")).collect()
    least, held = 1 << 62, 0
    for r in sizes:
        if held + r.pairs > frequent:
            break
        least, held = 1 << r.power, held + r.pairs
    known = spark.sparkContext.broadcast(Known(counts.where(F.col("n") >= least).toArrow()))
    out = "row long, part int, total long, best long, missed array<long>, missed_times array<long>"
    fields = [x.split()[0] for x in out.split(", ")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            row, part, pairs, times = batch.columns
            at = np.asarray(pairs.offsets, dtype=np.int64)
            at, flat, often = at - at[0], np.asarray(pairs.flatten()), np.asarray(times.flatten())
            total, best, missing = known.value.sums(flat, often, at)
            ends = pa.array(np.concatenate(([0], np.cumsum(missing)))[at].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[missing], type=pa.int64())) for x in (flat, often)]
            yield pa.RecordBatch.from_arrays([row, part, pa.array(total), pa.array(best), *lists], names=fields)

    found = shared_checkpoint(linked.select("row", "part", "pairs", "times").mapInArrow(look_up, out))
    rare = found.select("row", F.explode(F.arrays_zip("missed", "missed_times")).alias("m")).select("row", F.col("m.missed").alias("pair"), F.col("m.missed_times").alias("times"))
    rare = rare.join(counts.where(F.col("n") < least), "pair").select("row", (F.col("times") * F.col("n")).alias("total"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("best"))
    later = found.where("part > 0").select("row", "total", "best").unionByName(rare).groupBy("row").agg(F.sum("total").alias("more_total"), F.sum("best").alias("more_best"))
    sums = found.where("part = 0").select("row", "total", "best").join(later, "row", "left")
    sums = sums.select("row", (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("total") + F.coalesce("more_total", F.lit(0))).alias("count_sum"))
    rows = linked.where("part = 0").drop("part", "pairs", "times").join(sums, "row")
    return rows.select(*(F.col("old").getField(c).alias(c) for c in without(df, text, *made)), *made)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers for each whole document, with the links' counts over all documents."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return link_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
