"""Licences, SentencePiece, token counts, TIFF: row by row against plain versions."""

import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tickloom.llm import license_scan, sentencepiece_io, tiff, tokencount

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


# --- licences ---------------------------------------------------------------------------------------------------------


def licences(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r.licenses for r in license_scan.scan(df).orderBy("k").collect()]


def test_licence_rules(spark):
    bsd = [s for s, k in license_scan.SENTENCES.items() if k in ("BsdPre", "BsdSource", "BsdBinary")]
    endorse = next(s for s, k in license_scan.SENTENCES.items() if k == "BsdEndorse")
    got = licences(
        spark,
        "Foo.\nLicensed under the Apache License, Version 2.0.\nbar",
        "Released under the MIT License. Licensed under CC BY-NC 4.0.",
        ".\n".join(bsd),
        ".\n".join([*bsd, endorse]),
        "All rights reserved.",
        "a licence of another kind",
        None,
        "",
    )
    assert got == ["Apache-2.0", "CC-BY-NC-4.0,MIT", "BSD-2-Clause", "BSD-3-Clause", "Unmatched", "", "", ""]


GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2").replace("program.  If not", "program; if not")
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE.
"""
BSD3 = BSD2.replace("THIS SOFTWARE", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE")
LGPL = GPL3.replace("This program", "This library").replace("this program", "this library").replace("General Public", "Lesser General Public").replace("version 3", "version 2.1")
LGPL3 = GPL3.replace("General Public", "Lesser General Public")
AGPL = GPL3.replace("General Public", "Affero General Public")
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.
"""
EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy this software.
"""
OFFICIAL = {
    "LGPL-2.1-or-later": (LGPL, "<Lgpl21Plus><GplWarranty><LgplReceive>"),
    "LGPL-3.0-or-later": (LGPL3, "<Lgpl3Plus><GplWarranty><LgplReceive>"),
    "AGPL-3.0-or-later": (AGPL, "<Agpl3Plus><GplWarranty><AgplReceive>"),
    "ISC": (ISC, "<IscGrant><IscAsIs>"),
    "Zlib": (ZLIB, "<ZlibAsIs><ZlibGrant>"),
    "MPL-2.0": (MPL, "<MplNotice>"),
    "EPL-2.0": (EPL, "<EplNotice>"),
    "Unlicense": (UNLICENSE, "<UnlicenseNotice>"),
    "GPL-3.0-or-later": (GPL3, "<Gpl3Plus><GplWarranty><GplReceive>"),
    "GPL-2.0-or-later": (GPL2, "<Gpl2Plus><GplWarranty><GplReceive>"),
    "MIT": (MIT, "<MitGrant><MitNotice><MitAsIs>"),
    "Apache-2.0": (APACHE, "<ApacheRef><ApacheComply><ApacheCopy><ApacheAsIs><ApacheSee>"),
    "BSD-2-Clause": (BSD2, "<BsdPre><BsdSource><BsdBinary><BsdAsIs>"),
    "BSD-3-Clause": (BSD3, "<BsdPre><BsdSource><BsdBinary><BsdEndorse><BsdAsIs>"),
}
REFERENCES = {
    "Released under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0-only",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under the Mozilla Public License, Version 2.0.": "MPL-2.0",
    "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
    "All rights reserved.": "Unmatched",
    "Licensed under the GNU Lesser General Public License version 3.": "LGPL-3.0-only",
    "This library is distributed under the terms of the GNU Lesser General Public License, version 2.1.": "LGPL-2.1-only",
    "Released under the GNU Affero General Public License, version 3": "AGPL-3.0-only",
    "This code is released under the BSD 2-Clause License.": "BSD-2-Clause",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "Licensed under CC0 1.0.": "CC0-1.0",
    "available under the ISC license": "ISC",
    "This file is licensed under the zlib license.": "Zlib",
    "Released under the Unlicense.": "Unlicense",
    "Licensed under the Eclipse Public License 2.0.": "EPL-2.0",
    **{f"// SPDX-License-Identifier: {name}": name for name in license_scan.SPDX},
}


def scanned(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [(r.licenses, r.sentence_ids) for r in license_scan.scan(df).orderBy("k").collect()]


def test_every_rule_on_its_official_text(spark):
    assert scanned(spark, *(text for text, _ in OFFICIAL.values())) == [(name, ids) for name, (_, ids) in OFFICIAL.items()]
    assert licences(spark, *REFERENCES) == list(REFERENCES.values())
    assert {name for name, _ in license_scan.RULES} == {*OFFICIAL, *REFERENCES.values()}


def test_gpl_notices_that_name_the_program(spark):
    named = [text.replace("This program is", "Foo is") for text in (GPL3, GPL2)]
    assert scanned(spark, *named) == [(name, OFFICIAL[name][1]) for name in ("GPL-3.0-or-later", "GPL-2.0-or-later")]
    assert licences(spark, "Is this under the MIT license? Not known: ask", "not released under the MIT License.") == ["", ""]


def wrapped(text, mark="", width=60, end=""):
    import textwrap

    lines = [line for p in text.strip().split("\n") for line in textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False) or [""]]
    return "\n".join((mark + line + end).rstrip(" ") for line in lines)


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "; ", "! ", "-- ", "REM ", "dnl ", "\t%% ", "> "])
def test_wrapped_and_commented_texts(spark, mark):
    texts = [wrapped(text, mark, width) for text, _ in OFFICIAL.values() for width in (35, 72)]
    assert scanned(spark, *texts) == [(name, ids) for name, (_, ids) in OFFICIAL.items() for _ in range(2)]


def test_wrapped_in_other_ways(spark):
    want = [(name, ids) for name, (_, ids) in OFFICIAL.items()]
    official = [text for text, _ in OFFICIAL.values()]
    assert scanned(spark, *("/*\n" + wrapped(text, " * ", end="  *") + "\n */" for text in official)) == want
    assert scanned(spark, *(wrapped(text).replace("\n", "\r\n") for text in official)) == want
    assert licences(spark, BSD2.replace("1. ", "(1) ").replace("2. ", "b) ")) == ["BSD-2-Clause"]
    lines = "Foo\nReleased under the MIT License\nAll rights reserved\nLicensed under CC BY 4.0\nbar"  # one notice a line, without marks
    assert scanned(spark, lines) == [("CC-BY-4.0,MIT,Unmatched", "<MitRef><AllRights><CcByRef>")]
    blanks = ["All rights  reserved.", "All rights\treserved.", "All\nrights\nreserved.", "# All rights\n# reserved"]
    assert scanned(spark, *blanks) == [("Unmatched", "<AllRights>")] * 4
    assert licences(spark, "Released under the\n\nMIT License.", "Released under the. MIT License.") == ["", ""]


def test_each_known_sentence_has_a_cue():
    import re

    cue = re.compile(license_scan.CUES)
    assert all(cue.search(s) for s in license_scan.SENTENCES)
    assert len(license_scan.SENTENCES) < 200
    for lead in itertools.product(*license_scan.LEADS):
        for name in license_scan.NAMES:
            assert cue.search("".join(lead) + name), name
            assert cue.search(("".join(lead) + name).replace(" ", "\n# "))
    assert all(cue.search(s) for s in [*license_scan.PARTS, *license_scan.TAGS])


def test_references_as_people_write_them(spark):
    texts = ["Released under CC0 1.0.", "Distributed under CC BY 4.0.", "This project is licensed under the MIT License - see the LICENSE file for details.", "This work is licensed under the Creative Commons Attribution 4.0 International License.", "Available under\nthe terms of the GPLv3."]
    assert licences(spark, *texts) == ["CC0-1.0", "CC-BY-4.0", "MIT", "CC-BY-4.0", "GPL-3.0-only"]


def test_licences_of_edge_rows(edge_docs, no_docs):
    assert license_scan.scan(edge_docs).count() == edge_docs.count()
    assert {r.licenses for r in license_scan.scan(edge_docs).collect()} == {""}
    assert license_scan.scan(no_docs).count() == 0


# --- SentencePiece ----------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(edge_docs, no_docs):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    wanted = ("n_tokens", "ids", "begins", "ends", "decoded", "ids_sha256", "decoded_sha256")
    rows = sentencepiece_io.encode(edge_docs, PIECES, columns=wanted).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        text = r.text or ""
        ids = p.encode(text, add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == p.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        raw = text.encode()
        assert b"".join(raw[b:e] for b, e in zip(r.begins, r.ends, strict=True)) == raw
        assert all(e == b for b, e in zip(r.begins[1:], r.ends[:-1], strict=True))
    assert sentencepiece_io.encode(no_docs, PIECES).count() == 0


def test_symbols_and_compiled_map_in_one_model(spark, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    spec = pb.NormalizerSpec()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec())
    model.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    for symbol in ("①½", "ＡＢ", "<sep>"):
        model.pieces.add(piece=symbol, score=0.0, type=pb.ModelProto.SentencePiece.USER_DEFINED)
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["ＡＢＣ ①½ ①", "a<sep>b ﬁ ½", "①½①½", "ｶﾞ ㍍ plain", " ", "ＡＢ", "日本 ①½ end"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for r in sentencepiece_io.encode(df, path, bos=False, eos=False).collect():
        proto = p.encode(texts[r.k], out_type="proto")
        assert r.ids == [x.id for x in proto.pieces]
        raw = texts[r.k].encode()
        assert b"".join(raw[b:e] for b, e in zip(r.begins, r.ends, strict=True)) == raw
        assert [b for b, i in zip(r.begins, r.ids, strict=True) if not p.is_byte(i)][1:] == [x.begin for x in proto.pieces if not p.is_byte(x.id)][1:]
    assert p.encode("①½", out_type=str)[-1] == "①½"


def test_decode_column(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1, 450, 2])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in sentencepiece_io.decode(df, PIECES).collect()}
    assert got[1] is None and got[2] == "" and got[3]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_compiled_map_equals_the_library(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = pb.NormalizerSpec()
    spec.ParseFromString(library.serialized_normalizer_spec())
    codec = sentencepiece_io.Codec.__new__(sentencepiece_io.Codec)
    codec.map, codec.suffix = sentencepiece_io.CharMap(spec.precompiled_charsmap), False
    codec.prefix, codec.squeeze, codec.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    @settings(max_examples=300, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(st.text(st.one_of(st.sampled_from(" \t　ＡＢ①½ﬁガ゛ｶﾞ㍍Ǆéé­"), st.characters(codec="utf-8", exclude_characters="\0")), max_size=24))
    def check(text):
        want, offsets = library.normalize(text, with_offsets=True)
        got, at = codec.normalise(text)
        assert got.decode() == want
        starts = np.cumsum([0, *(len(c.encode()) for c in text)]).tolist()
        heads = np.cumsum([0, *(len(c.encode()) for c in want)])[:-1]
        assert [starts.index(x) for x in at[heads].tolist()] == list(offsets)[: len(want)]

    check()


# --- token counts -----------------------------------------------------------------------------------------------------


def test_counts_equal_the_library(edge_docs, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    rows = tokencount.count_tokens(edge_docs, BYTES).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        assert r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids)
    assert tokencount.count_tokens(no_docs, BYTES).count() == 0
    few = tokencount.count_tokens(edge_docs, BYTES, limit=2).collect()
    assert sorted(r.n_tokens for r in few) == sorted(r.n_tokens for r in rows)


@settings(max_examples=400, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.text(st.one_of(st.sampled_from(" \n\t'stdmrevl<|endoftext|>1²½é­ß\xa0"), st.characters(codec="utf-8")), max_size=30))
def test_any_text_counts_as_the_library(text):
    c = tokencount.counting(BYTES)
    cut = c.pieces(text)
    assert sum(c.whole(cut)) == c.whole([text])[0] == len(c.tokenizer.encode(text, add_special_tokens=False).ids)


def test_frequent_table_looks_up_exactly():
    table = tokencount.Frequent(["a", "b", " the"], [1, 2, 3])
    assert table.get(["b", "c", " the", "a"]).tolist() == [2, 0, 3, 1]
    assert tokencount.Frequent([], []).get(["a"]).tolist() == [0]


# --- TIFF -------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.binary(max_size=5000), st.sampled_from(sorted(tiff.ENCODERS)))
def test_codings_round_trip(data, code):
    assert tiff.DECODERS[code](tiff.ENCODERS[code](data)) == data


@pytest.mark.parametrize("code", sorted(tiff.ENCODERS))
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_pages_round_trip(code, predictor, tile):
    rng = np.random.default_rng(0)
    images = [rng.integers(0, 256, (33, 50, 3)).astype(np.uint8), np.repeat(rng.integers(0, 3, (70, 5, 1)), 9, axis=1).astype(np.uint8), np.zeros((1, 1, 1), np.uint8)]
    for order in "<>":
        pages = list(tiff.read_pages(tiff.write_tiff(images, code, predictor, 8, tile, order)))
        assert [p["page"] for p in pages] == [0, 1, 2]
        for p, image in zip(pages, images, strict=True):
            assert p["error"] is None and (p["pixels"] == image).all() and p["compression"] == code


def test_lzw_known_data():
    # the example of the TIFF 6.0 specification, section 13: codes 256 7 258 8 8 258 6 6 257
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(data) == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_broken_files_give_errors(spark):
    good = tiff.write_tiff([np.zeros((4, 4), np.uint8)])
    rows = [(1, good), (2, None), (3, b""), (4, b"II*\0"), (5, good[:-20]), (6, good[:8] + b"\xff" * (len(good) - 8)), (7, good)]
    got = tiff.decode_pages(spark.createDataFrame(rows, "k int, media binary")).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append(r)
    assert by[1][0].error is None and bytes(by[1][0].pixels) == bytes(16) and 2 not in by
    assert all(by[k][0].error for k in (3, 4, 5, 6)) and by[7][0].width == 4


def test_texts_as_media(edge_docs, no_docs):
    files = tiff.text_media(edge_docs)
    rows = tiff.decode_pages(files).collect()
    assert len(rows) == edge_docs.count() and {r.page for r in rows} == {0}
    want = sorted(tiff.payload_of(r.text) for r in edge_docs.collect())
    assert sorted(bytes(r.pixels) for r in rows) == want and all(len(w) % 576 == 0 and w for w in want)
    assert tiff.decode_pages(tiff.text_media(no_docs)).count() == 0


def test_tiff_query(spark, edge_docs, tmp_path):
    edge_docs.write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r.doc_id: r.text or "" for r in edge_docs.collect()}
    for r in tiff.op8_tiff_pages(spark, str(tmp_path)).collect():
        payload = tiff.payload_of(texts[r.doc_id])
        assert r.n_bytes == len(texts[r.doc_id].encode()) and r.payload_bytes == len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])


def test_counts_of_other_scripts_go_through_the_lookup(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    c = tokencount.counting(path)
    texts = ["plain words and 😀 a face", "안녕 하세요 세계", "日本語の文 と words", "a <|endoftext|> b", "tab　wide ᠎ odd \x85 nel \x1c fs", "مرحبا بالعالم 123", "end 😀", " 😀  two  blanks \n\n 日 \t x"]
    for x in texts:
        assert "".join(c.pieces(x)) == x and sum(c.whole(c.pieces(x))) == c.whole([x])[0]
    assert c.pieces(texts[0]) == ["plain", " words", " and", " 😀", " a", " face"] and len(c.pieces(texts[1])) == 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, path).collect()}
    assert [got[k] for k in range(len(texts))] == c.whole(texts)


def test_query_of_token_counts(spark, tmp_path):
    import public_tokenizers

    whole = tokencount.counting(public_tokenizers.path("byte_bpe_50k.json")).whole
    texts = {1: "é" * 700, 2: None, 3: "", 4: " ".join(f"w{k}" for k in range(400)), 5: "one 😀"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.op6_token_counts(spark, str(tmp_path)).collect()}
    assert got == {k: (len((x or "").encode()), n := whole([x or ""])[0], n > 512) for k, x in texts.items()}
