"""License scans by sentence-rule recognition, in SQL functions only.

A text is normalised to lower-case words with marks where sentences end; what stands between two marks and is a known licence
sentence becomes its identifier. The sequence of identifiers of a document is then matched against ordered rules: a rule that matches
consumes its identifiers, so that later, more general rules see only what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import named, table

#: Known licence sentences (after normalisation) and their identifiers. The wording of public licences.
SENTENCES = {
    # references
    "licensed under the apache license version 2 0": "ApacheRef",
    "licensed under the apache license version 2 0 the license": "ApacheRef",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "licensed under cc by 4 0": "CcByRef",
    "licensed under cc by sa 4 0": "CcBySaRef",
    "licensed under cc by nc 4 0": "CcByNcRef",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "licensed under the mozilla public license version 2 0": "MplRef",
    "licensed under the bsd 3 clause license": "Bsd3Ref",
    # Apache 2.0 header
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    # MIT text
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitAsIs",
    # BSD text
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdPre",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdAsIs",
    # ISC text
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "IscAsIs",
    # zlib text
    "this software is provided as is without any express or implied warranty": "ZlibAsIs",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    # other notices
    "this source code form is subject to the terms of the mozilla public license v": "MplNotice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "EplNotice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution and is available at https www eclipse org legal epl v20 html": "EplNotice",
    "this is free and unencumbered software released into the public domain": "UnlicenseNotice",
    "all rights reserved": "AllRights",
}
#: GNU licences: prefix of the identifiers, name, words of the name, versions that have notices.
GNU = [("Gpl", "GPL", "general", ("2", "3")), ("Lgpl", "LGPL", "lesser general", ("2.1", "3")), ("Agpl", "AGPL", "affero general", ("3",))]
#: Parts of known sentences after a colon or semicolon, which stand alone where a notice names the program ("Foo is free software: ...").
PARTS = {"without even the implied warranty of merchantability or fitness for a particular purpose": "GplWarranty"}
_GNU_RULES, _GNU_REFERENCES = [], []
for _id, _name, _words, _versions in GNU:
    for _version in _versions:
        _key, _number = _id + _version.replace(".", ""), _version.replace(".", " ")
        _part = f"you can redistribute it and or modify it under the terms of the gnu {_words} public license as published by the free software foundation either version {_number} of the license or at your option any later version"
        PARTS[_part] = f"{_key}Plus"
        for _thing in ("program", "library"):
            SENTENCES[f"this {_thing} is free software {_part}"] = f"{_key}Plus"
            SENTENCES[f"this {_thing} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"] = "GplWarranty"
            SENTENCES[f"you should have received a copy of the gnu {_words} public license along with this {_thing}"] = f"{_id}Receive"
        _GNU_RULES.append((f"{_name}-{_version if '.' in _version else _version + '.0'}-or-later", f"(<{_key}Plus>)(<GplWarranty>)?(<{_id}Receive>)?"))
        _GNU_REFERENCES.append((f"{_name}-{_version if '.' in _version else _version + '.0'}-only", f"<{_key}Ref>"))
#: What references to a licence begin with, word by word of four choices, and the names that follow. Names of public licences.
LEADS = (
    ("", *(f"this {thing} is " for thing in ("project", "software", "work", "program", "library", "file", "code"))),
    ("licensed ", "released ", "distributed ", "available "),
    ("under ",),
    ("", "the ", "the terms of the "),
)
NAMES = {
    "mit license": "MitRef",
    "isc license": "IscRef",
    "zlib license": "ZlibRef",
    "unlicense": "UnlicenseRef",
    "bsd 2 clause license": "Bsd2Ref",
    "bsd 3 clause license": "Bsd3Ref",
    "apache license version 2 0": "ApacheRef",
    "apache license 2 0": "ApacheRef",
    "mozilla public license version 2 0": "MplRef",
    "mozilla public license 2 0": "MplRef",
    "eclipse public license version 2 0": "EplRef",
    "eclipse public license 2 0": "EplRef",
    "boost software license version 1 0": "BoostRef",
    "gnu general public license version 2": "Gpl2Ref",
    "gnu general public license version 3": "Gpl3Ref",
    "gnu lesser general public license version 2 1": "Lgpl21Ref",
    "gnu lesser general public license version 3": "Lgpl3Ref",
    "gnu affero general public license version 3": "Agpl3Ref",
    "gplv2": "Gpl2Ref",
    "gpl v2": "Gpl2Ref",
    "gplv3": "Gpl3Ref",
    "gpl v3": "Gpl3Ref",
    "lgplv3": "Lgpl3Ref",
    "agplv3": "Agpl3Ref",
    "creative commons attribution 4 0 international license": "CcByRef",
    "creative commons attribution sharealike 4 0 international license": "CcBySaRef",
    "creative commons attribution noncommercial 4 0 international license": "CcByNcRef",
    "cc by 4 0": "CcByRef",
    "cc by sa 4 0": "CcBySaRef",
    "cc by nc 4 0": "CcByNcRef",
    "cc0 1 0": "Cc0Ref",
}
#: What may follow a reference in its sentence.
TAILS = ("see the license file", "see the license file for details", "see license for details", "see the license file for more details")
#: Identifiers of licences in one-line tags (fixed values of the SPDX list).
SPDX = ["MIT", "ISC", "Zlib", "Unlicense", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "EPL-2.0", "BSL-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0"]
_letters = lambda name: "".join(c for c in name if c.isalnum())
TAGS = {"spdx license identifier " + name.lower().replace("-", " ").replace(".", " "): f"Spdx{_letters(name)}" for name in SPDX}
#: Ordered rules over the identifier sequence, each identifier in angle brackets: the licence and the pattern. A warranty or notice sentence may be missing.
RULES = [
    ("BSD-3-Clause", "(<BsdPre>)(<BsdSource>)(<BsdBinary>)(<BsdEndorse>)(<BsdAsIs>)?"),
    ("BSD-2-Clause", "(<BsdPre>)(<BsdSource>)(<BsdBinary>)(<BsdAsIs>)?"),
    ("MIT", "(<MitRef>)?(<MitGrant>)(<MitNotice>)?(<MitAsIs>)?"),
    ("ISC", "(<IscRef>)?(<IscGrant>)(<IscAsIs>)?"),
    ("Zlib", "(<ZlibRef>)?(<ZlibAsIs>)?(<ZlibGrant>)"),
    ("Apache-2.0", "(<ApacheRef>)(<ApacheComply>)?(<ApacheCopy>)?(<ApacheAsIs>)?(<ApacheSee>)?"),
    *_GNU_RULES,
    *_GNU_REFERENCES,
    ("MIT", "<MitRef>"),
    ("ISC", "<IscRef>"),
    ("Zlib", "<ZlibRef>"),
    ("Unlicense", "<UnlicenseRef>|<UnlicenseNotice>"),
    ("CC-BY-NC-4.0", "<CcByNcRef>"),
    ("CC-BY-SA-4.0", "<CcBySaRef>"),
    ("CC-BY-4.0", "<CcByRef>"),
    ("CC0-1.0", "<Cc0Ref>"),
    ("MPL-2.0", "<MplRef>|<MplNotice>"),
    ("EPL-2.0", "<EplRef>|<EplNotice>"),
    ("BSL-1.0", "<BoostRef>"),
    ("BSD-2-Clause", "<Bsd2Ref>"),
    ("BSD-3-Clause", "<Bsd3Ref>"),
    *((name, f"<Spdx{_letters(name)}>") for name in SPDX),
    ("Unmatched", "(<[A-Za-z0-9]+>)+"),
]
#: Each known sentence and reference holds one of these words, so texts without any need no cutting.
CUES = "(?i)licen[cs]e|cc0|cc(?:[^a-z0-9]+(?:rem|dnl))?[^a-z0-9]+by|gpl|creative|permi(t|ssion)|copyright|redistribut|warrant|rights(?:[^a-z0-9]+(?:rem|dnl))?[^a-z0-9]+reserved|compliance|unencumbered"
#: A sentence ends at a line feed or at a full stop, colon, semicolon or such before white space or the end.
SENTENCE_END = r"\n+|[.;:!?]+(\s+|$)"
#: What the lower-case text turns into, step by step: words and marks with single blanks between them. The marks are capitals, which
#: lower-case text does not have: H ends a sentence; M (colons, semicolons) and N (a line feed) end one too, but may stand inside a
#: known one, since texts are wrapped.
MARKS = [
    (r"\r\n?", "\n"),
    (r"(^|\n)[^a-z0-9\n]*+(?:(?:rem|dnl)[ \t]++)?", "$1"),  # comment marks and indents at line starts
    (r"\n[0-9a-z]\)\s", "\n\n"),  # numbers of a list
    (r"\n\n++", " . "),  # a blank line
    (r"(?<![.;:!?])[;:]++(?:\s++|\z)", " M "),
    (r"(?<![.;:!?])[.;:!?]++(?:\s++|\z)", " H "),
    (r"\n", " N "),
    (r"[^a-z0-9HMN]+", " "),
]
_INSIDE, _ENDS = "MN", "HMN"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of text, in order; of two that start together the longer one."""
    marked = F.lower(text)
    for pattern, mark in MARKS:
        marked = F.regexp_replace(marked, pattern, mark)
    keys, by_first = {**SENTENCES, **PARTS, **TAGS}, {}
    for key in sorted(keys, key=len, reverse=True):
        by_first.setdefault(key.split(" ", 1)[0], []).append(key.split(" ", 1)[1])
    whole = "|".join(f"{first} (?:{'|'.join(rest)})" for first, rest in by_first.items())
    lead = "".join(f"(?:{'|'.join(sorted(choice, key=len, reverse=True))})" for choice in LEADS)
    names = f"(?:{'|'.join(sorted(NAMES, key=len, reverse=True))})(?: (?:{'|'.join(sorted(TAILS, key=len, reverse=True))}))?"
    # of a whole sentence and a reference that start together, the longer one
    either = f"(?:{whole})(?= [{_ENDS}])|{lead}{names}(?= [{_ENDS}])".replace(" ", f" (?:[{_INSIDE}] )?").replace(f"(?= (?:[{_INSIDE}] )?[", "(?= [")
    found = F.regexp_extract_all(F.concat(F.lit("H "), F.trim(marked), F.lit(" H")), F.lit(f"(?<=[{_ENDS}] )(?:{either})"), F.lit(0))
    known = F.create_map(*(F.lit(x) for pair in {**keys, **NAMES}.items() for x in pair))
    plain = lambda s: F.regexp_replace(s, f" [{_INSIDE}](?= )", "")
    tail = f" (?:{'|'.join(TAILS)})$"
    return F.transform(found, lambda s: F.coalesce(known[plain(s)], known[F.regexp_replace(F.regexp_replace(plain(s), f"^{lead}", ""), tail, "")]))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add sentence_ids (the known sentences in order, each in angle brackets), n_sentences and licenses.

    licenses holds the matched rules' licences, sorted and without repeats, joined by commas; identifiers that no rule takes
    give "Unmatched". Null and empty texts, and texts without a known sentence, give 0, "" and "". Rows are independent:
    nothing is shuffled, repeated rows give repeated results, texts of any length are read whole, and an empty table stays empty.
    Columns of df with those names are replaced.
    """
    source = named(text)
    ids = F.when(source.rlike(CUES), F.array_join(F.transform(sentence_ids(source), lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "")).otherwise(F.lit(""))
    out = df.withColumn("sentence_ids", ids)
    out = out.withColumn("n_sentences", F.length(F.regexp_replace("sentence_ids", "[^<]", "")).cast("long"))
    left, found = F.col("sentence_ids"), []
    for name, pattern in RULES:
        found.append(F.when(left.rlike(pattern), F.lit(name)))
        left = F.regexp_replace(left, pattern, "|")
    matched = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))), ",")
    return out.withColumn("licenses", F.when(F.col("sentence_ids") == "", F.lit("")).otherwise(matched))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of each whole document."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def _oracle() -> str:
    """SQL for texts whose notices stand on one line each; it neither joins wrapped lines nor drops comment marks."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    leads = [""]
    for choice in LEADS:
        leads = [x + y for x in leads for y in choice]
    known = {**{lead + name + tail: key for lead in leads for name, key in NAMES.items() for tail in ("", *(" " + t for t in TAILS))}, **SENTENCES, **TAGS}
    keys, values = ", ".join(map(quote, known)), ", ".join(map(quote, known.values()))
    steps, at = [], "i0"
    for k, (name, pattern) in enumerate(RULES):
        steps.append(f"r{k + 1} AS (SELECT * REPLACE (CASE WHEN regexp_matches(seq, {quote(pattern)}) THEN list_append(found, {quote(name)}) ELSE found END AS found, regexp_replace(seq, {quote(pattern)}, '|', 'g') AS seq) FROM {at})")
        at = f"r{k + 1}"
    return f"""
WITH s AS (SELECT doc_id, source, list_transform(regexp_split_to_array(coalesce(text, ''), {quote(SENTENCE_END)}), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) AS parts FROM documents),
i AS (SELECT doc_id, source, list_filter(list_transform(parts, lambda x: map([{keys}], [{values}])[x]), lambda x: x IS NOT NULL) AS ids FROM s),
i0 AS (SELECT doc_id, source, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS sentence_ids, len(ids)::BIGINT AS n_sentences, sentence_ids AS seq, []::VARCHAR[] AS found FROM i),
{", ".join(steps)}
SELECT doc_id, source, sentence_ids, n_sentences, coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') AS licenses FROM {at}
"""


OP1_SQL = _oracle()
