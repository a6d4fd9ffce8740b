"""TIFF columns: write samples losslessly, walk image directories, decode strips and tiles, one row a page."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import map_rows, table, without

# Fixed values of the TIFF format: tags, field types (bytes each) and compression codes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, FILL, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
NONE, LZW, DEFLATE, PACKBITS, DEFLATE_OLD = 1, 5, 8, 32773, 32946
PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"
#: Bytes that one stored byte can give at most, by compression code: bounds what a header may claim.
EXPANSION = {NONE: 1, LZW: 4096, DEFLATE: 1040, PACKBITS: 64, DEFLATE_OLD: 1040}
#: Samples of a row and rows of a strip that the query writes.
ROW_SAMPLES, STRIP_ROWS = 576, 64


def packbits_decode(data: bytes, limit: int | None = None) -> bytes:
    """Undo PackBits: a count and literal bytes, or a count and a byte to repeat. Decoding stops at limit bytes or some more."""
    out, k = bytearray(), 0
    while k < len(data) and (limit is None or len(out) < limit):
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        else:
            if n > 128:
                out += data[k + 1 : k + 2] * (257 - n)
            k += 1 + (n > 128)
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of two or more bytes become pairs, all else literals."""
    out, k = bytearray(), 0
    while k < len(data):
        run = 1
        while run < 128 and k + run < len(data) and data[k + run] == data[k]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[k]))
            k += run
            continue
        end = k + 1
        while end < len(data) and end - k < 128 and not (end + 1 < len(data) and data[end] == data[end + 1]):
            end += 1
        out += bytes((end - k - 1,)) + data[k:end]
        k = end
    return bytes(out)


def lzw_decode(data: bytes, limit: int | None = None) -> bytes:
    """Undo LZW with codes of 9 to 12 bits, high bits first; 256 clears, 257 ends, widths grow one code early.

    Decoding stops at limit bytes or some more.
    """
    out, words, last = bytearray(), [], b""
    width, held, bits = 9, 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257 or limit is not None and len(out) >= limit:
            break
        if code == 256:
            words, last, width = [bytes((k,)) for k in range(256)] + [b"", b""], b"", 9
            continue
        if not words:
            raise ValueError("LZW data begins without a clear code")
        if code < len(words):
            word = words[code]
        elif code == len(words) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += word
        if last:
            words.append(last + word[:1])
        last = word
        width = max(9, min(12, (len(words) + 1).bit_length()))
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """LZW as lzw_decode reads it."""
    codes: dict[bytes, int] = {}
    out, held, bits, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    def clear() -> int:
        codes.clear()
        codes.update({bytes((k,)): k for k in range(256)})
        return 258

    put(256)
    new, word = clear(), b""
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer] = new
        new += 1
        width = max(9, min(12, new.bit_length()))
        word = data[k : k + 1]
        if new == 4094:
            put(codes[word])
            word = b""
            put(256)
            new, width = clear(), 9
    if word:
        put(codes[word])
        new += 1
        width = max(9, min(12, new.bit_length()))
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def inflate(data: bytes, limit: int | None = None) -> bytes:
    """Undo deflate, up to limit bytes."""
    return zlib.decompressobj().decompress(data, limit or 0)


def stored(data: bytes, limit: int | None = None) -> bytes:
    """Bytes stored as they are, up to limit."""
    return bytes(data[:limit])


DECODERS = {NONE: stored, LZW: lzw_decode, PACKBITS: packbits_decode, DEFLATE: inflate, DEFLATE_OLD: inflate}
ENCODERS = {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode, DEFLATE: lambda b: zlib.compress(b, 1), DEFLATE_OLD: lambda b: zlib.compress(b, 1)}


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of each image directory of a TIFF or BigTIFF file, in file order; a loop of directories is an error."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise ValueError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    (magic,) = struct.unpack_from(order + "H", data, 2)
    if magic not in (42, 43):
        raise ValueError("no TIFF header")
    # widths of the number of entries and of counts and offsets
    entries, long, inline, size = ("H", "I", 4, 12) if magic == 42 else ("Q", "Q", 8, 20)
    (at,) = struct.unpack_from(order + long, data, 4 if magic == 42 else 8)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + entries, data, at)
        first = at + struct.calcsize(order + entries)
        if first + n * size > len(data):
            raise ValueError("an image directory reaches beyond the file")
        tags = {}
        for k in range(n):
            entry = first + size * k
            tag, kind, count = struct.unpack_from(order + "HH" + long, data, entry)
            if kind not in TYPES:
                continue
            if count > len(data):
                raise ValueError(f"tag {tag} has more values than the file has bytes")
            form = f"{order}{count}{TYPES[kind]}"
            here = entry + size - inline
            place = here if struct.calcsize(form) <= inline else struct.unpack_from(order + long, data, here)[0]
            tags[tag] = struct.unpack_from(form, data, place)
        yield order, tags
        (at,) = struct.unpack_from(order + long, data, first + size * n)


def _samples(raw: bytes, shape: tuple[int, int, int], bits: int, order: str, reverse: bool) -> np.ndarray:
    """Samples of a decoded block, one array element each."""
    rows, width, samples = shape
    data = np.frombuffer(raw, dtype=np.uint8)
    if bits == 1:
        data = data.reshape(rows, -1)
        return np.unpackbits(data, axis=1, bitorder="little" if reverse else "big")[:, : width * samples].reshape(shape)
    return data.view(order + "u2").astype(np.uint16).reshape(shape) if bits == 16 else data.reshape(shape)


def _page(data: bytes, tags: dict[int, tuple], order: str) -> dict:
    """Decode one directory of 1-, 8- or 16-bit samples, samples together or in planes.

    Nothing is allocated on the word of the header: each block is held against what its stored bytes can give, and the page is put
    together from the decoded blocks.
    """
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, planar = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), one(PLANAR, 1)
    code, predictor, depths = one(COMPRESSION, NONE), one(PREDICTOR, 1), set(tags.get(BITS, (1,)))
    if len(depths) != 1 or not depths <= {1, 8, 16} or planar not in (1, 2):
        raise ValueError("only samples of 1, 8 or 16 bits, all alike, are supported")
    bits = depths.pop()
    if code not in DECODERS or predictor not in (1, 2) or predictor == 2 and bits == 1:
        raise ValueError(f"compression {code} with predictor {predictor} is not supported")
    tiled = TILE_OFFSETS in tags
    block_w, block_h = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(ROWS, height), height))
    numbers = (width, height, samples, block_w, block_h)
    if not all(isinstance(x, int) and x > 0 for x in numbers):
        raise ValueError("a width, height or number of samples is not positive")
    places, sizes = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[OFFSETS], tags[COUNTS])
    across, down = -(-width // block_w), -(-height // block_h)
    planes, together = (samples, 1) if planar == 2 else (1, samples)
    if len(places) != len(sizes) or len(places) != across * down * planes:
        raise ValueError(f"{len(places)} blocks in place of {across * down * planes}")
    # blocks may share stored bytes, but a page holds no more than its distinct bytes can
    stored, end = 0, 0
    for place, size in sorted(zip(places, sizes, strict=True)):
        stored += max(0, min(place + size, len(data)) - max(place, end))
        end = max(end, min(place + size, len(data)))
    if width * height * samples * bits > 8 * stored * EXPANSION[code]:
        raise ValueError(f"{stored} stored bytes cannot hold {width} x {height} x {samples} samples")
    blocks = []
    for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
        top = k // across % down * block_h
        rows = block_h if tiled else min(block_h, height - top)
        need = rows * -(-block_w * together * bits // 8)
        chunk = data[place : place + size]
        if need > len(chunk) * EXPANSION[code]:
            raise ValueError(f"block {k} of {len(chunk)} bytes cannot hold {need}")
        raw = DECODERS[code](chunk, need)[:need]
        if len(raw) < need:
            raise ValueError(f"block {k} gives {len(raw)} bytes in place of {need}")
        blocks.append((k // (across * down), top, k % across * block_w, rows, raw))
    pixels = np.zeros((height, width, samples), dtype=np.uint16 if bits == 16 else np.uint8)
    for plane, top, left, rows, raw in blocks:
        block = _samples(raw, (rows, block_w, together), bits, order, one(FILL, 1) == 2)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        deep = slice(plane, plane + 1) if planar == 2 else slice(None)
        pixels[top : top + rows, left : left + block_w, deep] = block[: height - top, : width - left]
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": code, "predictor": predictor, "pixels": pixels}


#: What a malformed file can raise while it is read.
MALFORMED = (ValueError, KeyError, IndexError, TypeError, OverflowError, MemoryError, struct.error, zlib.error)


def read_pages(data: bytes | None) -> Iterator[dict]:
    """Each page of a TIFF file. A page or file that cannot be read gives a row with its error and null pixels.

    Samples of 1 and 8 bits are a byte each, samples of 16 bits two bytes, low byte first.
    """
    if data is None:
        return
    blank = dict.fromkeys(x.split()[0] for x in PAGE_SCHEMA.split(", "))
    page = 0
    try:
        for order, tags in _directories(data):
            try:
                yield blank | {"page": page} | _page(data, tags, order)
            except MALFORMED as e:
                yield blank | {"page": page, "error": str(e) or type(e).__name__}
            page += 1
    except MALFORMED as e:
        yield blank | {"page": page, "error": str(e) or type(e).__name__}


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF file of 8-bit pages shaped (height, width) or (height, width, samples), in strips or in tiles (height, width)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in pages:
        image = np.atleast_3d(np.asarray(image, dtype=np.uint8))
        height, width, samples = image.shape
        block_h, block_w = tile or (strip_rows, width)
        places, sizes = [], []
        for top in range(0, height, block_h):
            for left in range(0, width, block_w):
                block = image[top : top + block_h, left : left + block_w]
                if tile:
                    block = np.pad(block, ((0, block_h - block.shape[0]), (0, block_w - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
                coded = ENCODERS[compression](np.ascontiguousarray(block).tobytes())
                places.append(len(out))
                sizes.append(len(coded))
                out += coded
        tags = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [block_w]), (TILE_LENGTH, 4, [block_h]), (TILE_OFFSETS, 4, places), (TILE_COUNTS, 4, sizes)] if tile else [(OFFSETS, 4, places), (ROWS, 4, [strip_rows]), (COUNTS, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(tags):
            packed = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(packed) > 4:
                packed, place = struct.pack(order + "I", len(out)), packed
                out += place
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def _feature(pixels: np.ndarray) -> str:
    """Shape, mean, deviation and a 64-bit difference hash of the page's brightness on a 8 by 9 grid."""
    grey = pixels.reshape(pixels.shape[0], -1).astype(np.float64)
    rows = np.array_split(np.arange(grey.shape[0]), 8) if grey.shape[0] >= 8 else [np.array([k * grey.shape[0] // 8]) for k in range(8)]
    columns = np.array_split(np.arange(grey.shape[1]), 9) if grey.shape[1] >= 9 else [np.array([k * grey.shape[1] // 9]) for k in range(9)]
    lines = np.stack([grey[r].mean(axis=0) for r in rows])
    grid = np.stack([lines[:, c].mean(axis=1) for c in columns], axis=1)
    bits = (grid[:, 1:] > grid[:, :-1]).ravel().astype(int)
    return f"{pixels.shape[0]}x{pixels.shape[1]}x{pixels.shape[2]} {grey.mean():.6f} {grey.std():.6f} {int(''.join(map(str, bits)), 2):016x}"


def decode_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row a page of each file in column media: the other columns of df, and those of PAGE_SCHEMA.

    Pixels are row by row, samples together. Null media gives no row; empty media, and a file or page that cannot be read, give a
    row with the error and null pixels. Columns of df with a name in PAGE_SCHEMA are replaced. Repeated rows give repeated pages, an
    empty table gives an empty one.
    """
    made = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
    kept = without(df, media, *made)

    def kernel(files: list[bytes | None]) -> tuple:
        found = [(k, page) for k, data in enumerate(files) for page in read_pages(data)]
        columns = [[p[name].tobytes() if name == "pixels" and p[name] is not None else p[name] for _, p in found] for name in made]
        return [k for k, _ in found], *columns

    return map_rows(df, kept, [media], PAGE_SCHEMA, kernel, rows=64)


def payload_of(text: str | None, unit: int = ROW_SAMPLES) -> bytes:
    """UTF-8 bytes of text, filled up with bytes 255 to a positive multiple of unit."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % unit if raw else unit)


def text_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Store each text as a one-page TIFF, deflated with horizontal prediction: columns of df without text, n_bytes and out.

    Null counts as empty, which gives one row of bytes 255; a text of any length is one page. Equal texts give equal files, an
    empty table an empty one.
    """
    kept = without(df, text, out, "n_bytes")

    def kernel(texts: list[str | None]) -> tuple:
        files = [write_tiff([np.frombuffer(payload_of(x), dtype=np.uint8).reshape(-1, ROW_SAMPLES)], predictor=2) for x in texts]
        return None, [len((x or "").encode()) for x in texts], files

    return map_rows(df, kept, [text], f"n_bytes long, `{out}` binary", kernel)


def op8_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store each whole document as TIFF, read the pages back and compute digests and features."""
    files = text_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pages = decode_pages(files.selectExpr("doc_id", "n_bytes", "media", "media as stored"))
    makes = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def digest(pixels: list[bytes], stored: list[bytes], heights: list[int], widths: list[int], samples: list[int]) -> tuple:
        shapes = zip(pixels, heights, widths, samples, strict=True)
        return (
            None,
            [len(b) for b in pixels],
            [hashlib.sha256(b).hexdigest() for b in pixels],
            [zlib.crc32(b[-32:]) for b in pixels],
            [len(b) for b in stored],
            [hashlib.sha256(b).hexdigest() for b in stored],
            [_feature(np.frombuffer(b, dtype=np.uint8).reshape(h, w, s)) for b, h, w, s in shapes],
        )

    return map_rows(pages, ["doc_id", "n_bytes"], ["pixels", "stored", "height", "width", "samples"], makes, digest)
