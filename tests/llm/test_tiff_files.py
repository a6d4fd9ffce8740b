"""TIFF files that other writers make, and files that nobody should: sample depths, planes, BigTIFF, false and broken headers."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import tiff


def plain_file(tags, blocks=b"", order="<", big=False):
    """A file of one directory of single values (tag: value, or a list of values), with blocks of bytes from offset 16 on."""
    body = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16 + len(blocks)) if big else struct.pack(order + "HI", 42, 16 + len(blocks)).ljust(14, b"\0"))
    out, entries, extra = bytearray(body + blocks), b"", b""
    long, inline, size, count = ("Q", 8, 20, "Q") if big else ("I", 4, 12, "H")
    start = len(out) + struct.calcsize(order + count) + len(tags) * size + inline
    for tag, values in sorted(tags.items()):
        values = values if isinstance(values, list) else [values]
        packed = struct.pack(f"{order}{len(values)}I", *values)
        if len(packed) > inline:
            packed, extra = struct.pack(order + long, start + len(extra)), extra + packed
        entries += struct.pack(order + "HH" + long, tag, 4, len(values)) + packed.ljust(inline, b"\0")
    return bytes(out) + struct.pack(order + count, len(tags)) + entries + struct.pack(order + long, 0) + extra


def tags_of(width, height, bits=8, samples=1, **more):
    named = {"compression": 259, "offsets": 273, "rows": 278, "counts": 279, "planar": 284, "predictor": 317, "fill": 266, "tile_w": 322, "tile_h": 323, "tile_offsets": 324, "tile_counts": 325}
    return {256: width, 257: height, 258: [bits] * samples, 277: samples, **{named[k]: v for k, v in more.items()}}


def only(data):
    (page,) = tiff.read_pages(data)
    return page


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_sixteen_bits(order, big):
    pixels = np.random.default_rng(0).integers(0, 65536, (5, 7, 1)).astype(np.uint16)
    raw = zlib.compress(pixels.astype(order + "u2").tobytes())
    page = only(plain_file(tags_of(7, 5, 16, compression=8, offsets=16, counts=len(raw), rows=5), raw, order, big))
    assert page["error"] is None and page["bits"] == 16 and (page["pixels"] == pixels).all()
    differences = np.diff(pixels, axis=1, prepend=np.zeros((5, 1, 1), np.uint16)).astype(order + "u2").tobytes()
    page = only(plain_file(tags_of(7, 5, 16, offsets=16, counts=len(differences), rows=5, predictor=2), differences, order, big))
    assert (page["pixels"] == pixels).all()


@pytest.mark.parametrize("fill", [1, 2])
def test_one_bit(fill):
    pixels = np.random.default_rng(1).integers(0, 2, (6, 13, 1)).astype(np.uint8)
    raw = np.packbits(pixels[:, :, 0], axis=1, bitorder="big" if fill == 1 else "little").tobytes()
    page = only(plain_file(tags_of(13, 6, 1, offsets=16, counts=len(raw), rows=6, fill=fill), raw))
    assert (page["pixels"] == pixels).all()


def test_planes():
    pixels = np.random.default_rng(2).integers(0, 256, (4, 3, 3)).astype(np.uint8)
    raw = b"".join(pixels[a : a + 2, :, k].tobytes() for k in range(3) for a in (0, 2))
    page = only(plain_file(tags_of(3, 4, 8, 3, offsets=[16 + 6 * k for k in range(6)], counts=[6] * 6, rows=2, planar=2), raw))
    assert (page["pixels"] == pixels).all()


@pytest.mark.parametrize(
    "tags",
    [
        tags_of(200_000, 200_000, offsets=16, counts=4, rows=200_000),
        tags_of(30_000, 30_000, compression=8, offsets=16, counts=4, rows=30_000),
        tags_of(8, 8, tile_w=0, tile_h=8, tile_offsets=16, tile_counts=4),
        tags_of(8, 8, tile_w=8, tile_h=0, tile_offsets=16, tile_counts=4),
        tags_of(0, 8, offsets=16, counts=4, rows=8),
        tags_of(8, 8, samples=0, offsets=16, counts=4, rows=8),
        tags_of(2, 2, offsets=[16, 16], counts=[4], rows=1),
        tags_of(2, 2, offsets=16, counts=3, rows=2),
        tags_of(2, 2, offsets=4_000_000_000, counts=4, rows=2),
        tags_of(2, 2, compression=5, offsets=16, counts=4, rows=2),
        tags_of(2, 2, bits=12, offsets=16, counts=4, rows=2),
        {256: 2, 257: 2},
    ],
)
def test_false_headers_give_an_error_row(tags):
    page = only(plain_file(tags, b"\1\2\3\4"))
    assert page["error"] and page["pixels"] is None


@settings(max_examples=150, deadline=None, database=None)
@given(st.data())
def test_broken_files_never_raise(data):
    image = np.arange(60, dtype=np.uint8).reshape(5, 12)
    good = bytearray(tiff.write_tiff([image, image], data.draw(st.sampled_from(sorted(tiff.DECODERS))), data.draw(st.sampled_from([1, 2])), 2, data.draw(st.sampled_from([None, (16, 16)]))))
    for _ in range(data.draw(st.integers(1, 6))):
        good[data.draw(st.integers(2, len(good) - 1))] = data.draw(st.integers(0, 255))
    cut = bytes(good[: data.draw(st.integers(0, len(good)))])
    for page in tiff.read_pages(cut):
        assert page["error"] is not None or page["pixels"].size == page["width"] * page["height"] * page["samples"]


def test_query_columns(spark, tmp_path):
    texts = {1: "one text", 2: None, 3: "", 4: "one text", 5: "é" * 1000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in tiff.op8_tiff_pages(spark, str(tmp_path)).collect()}
    import hashlib

    for k, text in texts.items():
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        file = tiff.write_tiff([np.frombuffer(payload, np.uint8).reshape(-1, 576)], predictor=2)
        row = got[k]
        assert (row.n_bytes, row.payload_bytes, row.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert (row.media_bytes, row.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        assert row.feature.startswith(f"{len(payload) // 576}x576x1 {np.frombuffer(payload, np.uint8).mean():.6f} ")
    assert got[1][1:] == got[4][1:] and len(got) == 5


def test_blocks_that_share_their_bytes_are_no_bomb():
    rows, width = 64, 1_000_000
    chunk = zlib.compress(bytes(rows * width), 9)
    strips, at = 40, 8
    ifd = at + len(chunk)
    lists = ifd + 2 + 12 * 8 + 4
    entry = lambda tag, kind, n, value: struct.pack("<HHII", tag, kind, n, value)
    tags = [entry(256, 4, 1, width), entry(257, 4, 1, rows * strips), entry(258, 3, 1, 8), entry(259, 3, 1, 8), entry(273, 4, strips, lists), entry(277, 3, 1, 1), entry(278, 4, 1, rows), entry(279, 4, strips, lists + 4 * strips)]
    data = b"II*\0" + struct.pack("<I", ifd) + chunk + struct.pack("<H", len(tags)) + b"".join(tags) + b"\0" * 4 + struct.pack(f"<{strips}I", *[at] * strips) + struct.pack(f"<{strips}I", *[len(chunk)] * strips)
    assert len(data) < 70_000
    (page,) = tiff.read_pages(data)
    assert "cannot hold" in page["error"] and page["pixels"] is None
