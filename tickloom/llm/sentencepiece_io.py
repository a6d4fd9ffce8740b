"""SentencePiece encoding that keeps source offsets, and decoding.

The library turns text into ids; this module follows its normalisation to project each piece to the bytes of the
original text. Normalisation takes the longest prefix that the model's compiled character map knows, else one character,
and records for every byte of the result the source byte it comes from.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import map_rows, table, without

#: Output columns of encode() and their types.
COLUMNS = {
    "n_tokens": "long",
    "ids": "array<int>",
    "begins": "array<int>",
    "ends": "array<int>",
    "decoded": "string",
    "ids_sha256": "string",
    "spans_sha256": "string",
    "decoded_sha256": "string",
}
META = "▁".encode()
#: Texts encoded in one call of the library.
TEXTS_A_CALL = 64


class CharMap:
    """The compiled character map of a model: a double-array trie over UTF-8 and the strings that it leads to.

    symbols are pieces that the user defined: the longest one at a place is taken before the map is asked, and stays as it is.
    """

    def __init__(self, blob: bytes, symbols: list[bytes] | None = None) -> None:
        self.symbols = sorted(symbols or [], key=len, reverse=True)
        self.units: list[int] = []
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist()
            self.strings = blob[4 + size :]
        self.starts = np.ones(256, dtype=bool) if self.units else np.zeros(256, dtype=bool)
        if self.units:
            for byte in range(256):
                self.starts[byte] = self._step(0, byte) is not None
            self.starts[[x[0] for x in self.symbols]] = True

    def _base(self, unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        """Child of node by byte. Bits 0-7 and 31 of a unit are its label, so a leaf never matches."""
        child = node ^ self._base(self.units[node]) ^ byte
        if child >= len(self.units) or (self.units[child] & 0x800000FF) != byte:
            return None
        return child

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Longest prefix of raw[at:] in the map: its length and replacement."""
        for symbol in self.symbols:
            if raw.startswith(symbol, at):
                return len(symbol), symbol
        node, found = 0, None
        for k in range(at, len(raw)):
            child = self._step(node, raw[k])
            if child is None:
                break
            node = child
            if self.units[node] & (1 << 8):
                leaf = self.units[node ^ self._base(self.units[node])] & 0x7FFFFFFF
                found = (k + 1 - at, leaf)
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]

    def apply(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """Replaced bytes, and for each the source byte; one more entry marks the end."""
        data = np.frombuffer(raw, dtype=np.uint8)
        heads = np.flatnonzero(self.starts[data] & ((data & 0xC0) != 0x80))
        parts, places, at = [], [], 0
        for k in heads.tolist():
            if k < at or (hit := self.longest(raw, k)) is None:
                continue
            parts += [raw[at:k], hit[1]]
            places += [np.arange(at, k), np.full(len(hit[1]), k)]
            at = k + hit[0]
        parts.append(raw[at:])
        places.append(np.arange(at, len(raw) + 1))
        return b"".join(parts), np.concatenate(places)


class Codec:
    """A model with its normalisation rules and the byte lengths of its pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        kind = pb.ModelProto.SentencePiece
        self.map = CharMap(spec.precompiled_charsmap, [p.piece.encode() for p in model.pieces if p.type == kind.USER_DEFINED and p.piece])
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.lengths = np.array([1 if p.type == kind.BYTE else 0 if p.type == kind.CONTROL else len(p.piece.encode()) for p in model.pieces], dtype=np.int64)
        self.unknown = self.processor.unk_id()

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and the source byte of each, with one more entry for the end of the source."""
        raw = text.encode()
        out, at = self.map.apply(raw) if self.map.units else (raw, None)
        data = np.frombuffer(out, dtype=np.uint8)
        at = np.arange(len(raw) + 1) if at is None else at
        if self.squeeze:
            blank = data == 32
            keep = ~(blank & np.concatenate(([True], blank[:-1])))
            if len(data) and (last := np.flatnonzero(~blank)).size:
                keep[last[-1] + 1 :] = False
            data, at = data[keep], np.append(at[:-1][keep], at[-1] if not len(data) or not keep.any() else at[np.flatnonzero(keep)[-1] + 1])
        if not len(data):
            return b"", np.array([len(raw)])
        if self.prefix:
            data = np.append(data, np.uint8(32)) if self.suffix else np.insert(data, 0, 32)
            at = np.insert(at, len(at) - 1, at[-1]) if self.suffix else np.insert(at, 0, self._leading(raw) if self.squeeze else 0)
        if self.escape:
            wide = np.where(data == 32, len(META), 1)
            out = data.tobytes().replace(b" ", META)
            return out, np.append(np.repeat(at[:-1], wide), at[-1])
        return data.tobytes(), at

    def _leading(self, raw: bytes) -> int:
        """Bytes at the beginning of raw that become spaces and go."""
        at = 0
        while at < len(raw):
            hit = self.map.longest(raw, at) if self.map.units else None
            size, new = hit or (1, raw[at : at + 1])
            if new != b" ":
                break
            at += size
        return at

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray] | tuple[None, None]:
        """Source byte spans of the pieces of text. Control pieces are empty spans at their place.

        Where the pieces do not cover the normalised text as this module makes it, there are no spans.

        A piece ends where the next one begins, so the spans cover the source without gaps; a byte that belongs to the
        inside of a replaced prefix falls to the piece in which the prefix begins.
        """
        normal, at = self.normalise(text)
        lengths = self.lengths[ids]
        strange = ids == self.unknown
        if strange.any():  # one call for texts with unknown pieces: their lengths are those of their surfaces
            proto = self.processor.encode(text, out_type="proto")
            surfaces = iter([len(p.piece.encode()) for p in proto.pieces])
            lengths = np.array([0 if n == 0 and not u else next(surfaces) for n, u in zip(lengths.tolist(), strange.tolist(), strict=True)])
        ends = np.cumsum(lengths)
        if len(ends) and ends[-1] != len(normal):
            return None, None
        return at[ends - lengths], at[ends]

    def encode(self, texts: list[str], bos: bool, eos: bool) -> list[list[int]]:
        return self.processor.encode(texts, out_type=int, add_bos=bos, add_eos=eos, num_threads=1)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """The model at path, once a worker."""
    return Codec(path)


def _rows(c: Codec, texts: list[str], wanted: list[str], bos: bool, eos: bool) -> Iterator[tuple]:
    """Wanted columns of each text."""
    spans = bool({"begins", "ends", "spans_sha256"} & set(wanted))
    decode = bool({"decoded", "decoded_sha256"} & set(wanted))
    coded = c.encode(texts, bos, eos)
    back = c.processor.decode(coded, num_threads=1) if decode else [""] * len(texts)
    for text, ids, decoded in zip(texts, coded, back, strict=True):
        ids = np.array(ids, dtype=np.int32)
        begin, end = c.spans(text, ids) if spans else (None, None)
        made = {"n_tokens": len(ids), "ids": ids, "begins": begin, "ends": end, "decoded": decoded}
        if "ids_sha256" in wanted:
            made["ids_sha256"] = hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()
        if "spans_sha256" in wanted:
            made["spans_sha256"] = None if begin is None else hashlib.sha256(np.stack([begin, end]).astype("<u4").tobytes()).hexdigest()
        if "decoded_sha256" in wanted:
            made["decoded_sha256"] = hashlib.sha256(decoded.encode()).hexdigest()
        yield tuple(made[k] for k in wanted)


def encode(df: DataFrame, model: str, text: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids", "begins", "ends"), bos: bool = True, eos: bool = True) -> DataFrame:
    """Encode each whole text of df; returns its columns and the wanted ones of COLUMNS.

    ids are those of the library; begins and ends are byte offsets in the original UTF-8 text (null, as spans_sha256, for a text
    whose normalised form this module makes otherwise than the library). decoded is the library's
    decode(ids). Null counts as empty, which gives only the begin and end ids. Rows are independent, so repeated rows
    give repeated results, and an empty table an empty one. Columns of df with a wanted name are replaced.
    model is a path that every executor has.
    """
    kept, wanted = without(df, *columns), list(columns)

    def kernel(texts: list[str | None]) -> tuple:
        return None, *zip(*_rows(codec(model), [x or "" for x in texts], wanted, bos, eos), strict=True)

    return map_rows(df, kept, [text], ", ".join(f"{c} {COLUMNS[c]}" for c in wanted), kernel, rows=TEXTS_A_CALL)


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Decode id arrays by the library; null stays null, empty gives the empty string. A column named out is replaced."""
    kept = without(df, out)

    def kernel(lists: list[list[int] | None]) -> tuple:
        return None, [None if x is None else codec(model).processor.decode(x) if x else "" for x in lists]

    return map_rows(df, kept, [ids], f"`{out}` string", kernel, rows=TEXTS_A_CALL)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """A file of the installed tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids, byte spans and decoded text of each whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, model_path(), columns=("n_tokens", "ids_sha256", "spans_sha256", "decoded_sha256"))
    return coded.drop("text")
