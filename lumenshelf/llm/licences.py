"""Licence scans by sentence rules (operator 7).

Known licence sentences, normalised, have identifiers; a licence rule is an ordered
sequence of identifiers. A document's sentences are mapped to identifiers (0 for an
unknown sentence), and rules are matched against the sequence: a rule's sentences in
their order, with at most ``GAP`` unknown sentences between two of them. Longer rules
are tried first and what one has matched no other can use.

Sentences end at end signs and blank lines. Licences are wrapped and put into
comments, so a single newline and the comment signs after it are a space; as titles
and one-line notices have no end sign, any run of whole lines of a sentence may be a
known one, and so may any MID_WORDS words or more of it, also after other words. Besides
sentences of licence texts, ``NAMED`` makes the notices that name a licence, and the SPDX
lines of its identifiers. Of an SPDX expression (``MIT OR ...``) nothing is known.

Edge cases: null and empty texts match nothing; very long texts are read whole; a
licence found twice gives one row per occurrence; repeated rows give repeated
results; null ids are kept; ids are whole numbers, others are an error; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune

GAP = 2
#: Sentences of public licences and notices, as their publishers word them.
SENTENCES = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-licensed-the": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-may-not": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-licensed": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl3-free-semi": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "apache-title": "Apache License Version 2.0, January 2004",
    "mpl-title": "Mozilla Public License Version 2.0",
    "epl1-made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl1-title": "Eclipse Public License - v 1.0",
    "epl2-made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl2-title": "Eclipse Public License - v 2.0",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
}
SENTENCES |= {
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-distributed": "Distributed under the Boost Software License, Version 1.0.",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "artistic2-title": "The Artistic License 2.0",
    "apache-body": "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "mpl-body": "\"Covered Software\" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof.",
    "gpl3-body": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl2-body": "Activities other than copying, distribution and modification are not covered by this License; they are outside its scope.",
    "agpl3-body": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "lgpl3-body": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
}
#: licence -> its rules
RULES = {
    "MIT": [("mit-grant", "mit-notice", "mit-warranty"), ("mit-released",), ("mit-licensed",)],
    "Apache-2.0": [("apache-title",), ("apache-licensed-the", "apache-may-not", "apache-copy", "apache-unless", "apache-see"), ("apache-licensed-the", "apache-may-not"), ("apache-licensed",)],
    "GPL-3.0": [("gpl-free", "gpl-hope", "gpl-details"), ("gpl-free",), ("gpl3-free-semi",), ("gpl3-title",), ("gpl3-licensed",)],
    "GPL-2.0": [("gpl2-title",)],
    "GPL-2.0-or-later": [("gpl2-free",)],
    "GPL-2.0-only": [("gpl2-only",)],
    "LGPL-2.1": [("lgpl21-free",), ("lgpl21-title",)],
    "LGPL-3.0": [("lgpl3-free",), ("lgpl3-title",)],
    "AGPL-3.0": [("agpl3-free",), ("agpl3-title",)],
    "EPL-1.0": [("epl1-made",), ("epl1-title",)],
    "EPL-2.0": [("epl2-made",), ("epl2-title",)],
    "CC0-1.0": [("cc0-dedicated",)],
    "Unlicense": [("unlicense-free",)],
    "BSD-3-Clause": [("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")],
    "BSD-2-Clause": [("bsd-redistribution", "bsd-source", "bsd-binary")],
    "ISC": [("isc-grant",)],
    "MPL-2.0": [("mpl-subject",), ("mpl-title",)],
    "CC-BY-4.0": [("cc-by",)],
    "CC-BY-SA-4.0": [("cc-by-sa",)],
    "CC-BY-NC-4.0": [("cc-by-nc",)],
    "BSL-1.0": [("bsl-title", "bsl-grant"), ("bsl-grant",), ("bsl-title",), ("bsl-distributed",)],
    "Zlib": [("zlib-as-is", "zlib-grant"), ("zlib-grant",)],
    "0BSD": [("0bsd-grant",)],
    "Artistic-2.0": [("artistic2-title",)],
}
#: A sentence of a licence's body tells it where title and notice are missing.
for _licence, _body in (("Apache-2.0", "apache-body"), ("MPL-2.0", "mpl-body"), ("GPL-3.0", "gpl3-body"), ("GPL-2.0", "gpl2-body"), ("AGPL-3.0", "agpl3-body"), ("LGPL-3.0", "lgpl3-body")):
    RULES[_licence].append((_body,))
#: Names under which licences are named in notices, and SPDX identifiers.
NAMED = {
    "MIT": (["MIT License"], ["MIT"]),
    "Apache-2.0": (["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"], ["Apache-2.0"]),
    "GPL-3.0": (["GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL version 3"], ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"]),
    "GPL-2.0": (["GNU General Public License version 2", "GNU General Public License v2.0", "GNU GPL version 2"], ["GPL-2.0"]),
    "GPL-2.0-only": ([], ["GPL-2.0-only"]),
    "GPL-2.0-or-later": ([], ["GPL-2.0-or-later"]),
    "LGPL-2.1": (["GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1"], ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"]),
    "LGPL-3.0": (["GNU Lesser General Public License version 3", "GNU Lesser General Public License v3.0"], ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"]),
    "AGPL-3.0": (["GNU Affero General Public License version 3", "GNU Affero General Public License v3.0"], ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"]),
    "EPL-1.0": (["Eclipse Public License 1.0"], ["EPL-1.0"]),
    "EPL-2.0": (["Eclipse Public License 2.0"], ["EPL-2.0"]),
    "BSD-2-Clause": (["BSD 2-Clause License", "Simplified BSD License"], ["BSD-2-Clause"]),
    "BSD-3-Clause": (["BSD 3-Clause License", "New BSD License", "Modified BSD License"], ["BSD-3-Clause"]),
    "ISC": (["ISC License"], ["ISC"]),
    "MPL-2.0": (["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"], ["MPL-2.0"]),
    "CC0-1.0": (["CC0 1.0 Universal"], ["CC0-1.0"]),
    "Unlicense": ([], ["Unlicense"]),
    "CC-BY-4.0": (["Creative Commons Attribution 4.0 International License"], ["CC-BY-4.0"]),
    "CC-BY-SA-4.0": (["Creative Commons Attribution-ShareAlike 4.0 International License"], ["CC-BY-SA-4.0"]),
    "CC-BY-NC-4.0": (["Creative Commons Attribution-NonCommercial 4.0 International License"], ["CC-BY-NC-4.0"]),
    "BSL-1.0": (["Boost Software License - Version 1.0"], ["BSL-1.0"]),
    "Zlib": (["zlib License"], ["Zlib"]),
    "0BSD": (["Zero-Clause BSD License"], ["0BSD"]),
    "Artistic-2.0": (["Artistic License 2.0"], ["Artistic-2.0"]),
}
_NOTICES = ("{}", "The {}", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "Available under the {}.", "This project is licensed under the {}.", "This work is licensed under the {}.")
for _licence, (_names, _tags) in NAMED.items():
    for _text in [n.format(x) for x in _names for n in _NOTICES] + [f"SPDX-License-Identifier: {t}" for t in _tags]:
        SENTENCES[_text] = _text
        RULES[_licence].append((_text,))
#: Known sentences of so many words may begin and end in the middle of a line.
MID_WORDS = 6
#: Every rule's sentences hold one of these, so other texts need no splitting.
ANCHORS = ("licen", "permission", "warrant", "redistribut", "public domain", "gpl", "cc0", "covered software")
_LINE = re.compile(r"\r\n?|\n")
#: Comment signs at the start of a line, also the words of m4 and batch files.
_LEAD = re.compile(r"^[\W_]*(?:(?:dnl|rem)\s+)?", re.IGNORECASE)
_END = re.compile(r"(?<=[.!?;:])\s+")
_WORD = re.compile(r"[^\W_]")
_SIGNS = re.compile(r"[^a-z0-9]+")


def normalise(sentence: str) -> str:
    return _SIGNS.sub(" ", sentence.lower().replace("+", " or later ")).strip()


def split(text: str) -> list[list[str]]:
    """The sentences of a text, each as its lines without leading comment signs."""
    out: list[list[str]] = [[]]
    for line in _LINE.split(text):
        pieces = [p for p in _END.split(_LEAD.sub("", line)) if _WORD.search(p)]
        if not pieces:
            out.append([])
        for p in pieces:
            out[-1].append(p)
            if p.rstrip()[-1] in ".!?;:":
                out.append([])
    return [s for s in out if s]


#: A known text may itself be several sentences; numbers from 1.
NUMBER: dict[str, int] = {}
_OF: dict[str, tuple[int, ...]] = {}
for _name, _text in SENTENCES.items():
    _OF[_name] = tuple(NUMBER.setdefault(normalise(" ".join(s)), len(NUMBER) + 1) for s in split(_text))
#: All beginnings of the known sentences, by whole words.
_PREFIXES = {" ".join(w[: i + 1]) for w in (known.split(" ") for known in NUMBER) for i in range(len(w))}
#: (licence, identifiers), longest first
ORDERED = sorted(((lic, tuple(i for name in rule for i in _OF[name])) for lic, rules in RULES.items() for rule in rules), key=lambda r: (-len(r[1]), r[0]))
_STARTS: dict[int, list] = {}
for _rule in ORDERED:
    _STARTS.setdefault(_rule[1][0], []).append(_rule)


def _known(words: list[str], start: int, firsts: set[int], lasts: set[int]) -> tuple[int, int]:
    """(identifier, word after it) of the longest known sentence that begins with word ``start``; (0, start + 1) if none does.

    Short ones must begin and end with lines (``firsts``, ``lasts``).
    """
    best, now = (0, start + 1), ""
    for end in range(start, len(words)):
        now = f"{now} {words[end]}".strip()
        if now not in _PREFIXES:
            break
        k = NUMBER.get(now)
        if k and (end + 1 - start >= MID_WORDS or (start in firsts and end + 1 in lasts)):
            best = (k, end + 1)
    return best


def identifiers(text: str) -> list[tuple[int, int]]:
    """(position, identifier) of the known sentences of a text, in order; unknown words of one sentence side by side have one position."""
    out, at = [], 0
    for sentence in split(text):
        words, firsts, lasts = [], set(), set()
        for line in sentence:
            if plain := normalise(line):
                firsts.add(len(words))
                words += plain.split(" ")
                lasts.add(len(words))
        i, unknown = 0, False
        while i < len(words):
            k, i = _known(words, i, firsts, lasts)
            if k or not unknown:
                at += 1
            if k:
                out.append((at - 1, k))
            unknown = not k
    return out


def match(found: list[tuple[int, int]], gap: int = GAP) -> list[tuple[str, int, int, int]]:
    """(licence, sentences of the rule, first position, last position) of each match, in order of position."""
    used, out = set(), []
    for licence, rule in ORDERED:
        for start, (_, k) in enumerate(found):
            if k != rule[0] or start in used:
                continue
            at, taken = start, [start]
            for want in rule[1:]:
                nxt = at + 1
                if nxt >= len(found) or nxt in used or found[nxt][1] != want or found[nxt][0] - found[at][0] > gap + 1:
                    break
                at = nxt
                taken.append(at)
            if len(taken) == len(rule):
                used.update(taken)
                out.append((licence, len(rule), found[start][0], found[at][0]))
    return sorted(out, key=lambda m: (m[2], m[0]))


def _scan(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = (text or "").lower()
                if any(a in low for a in ANCHORS):
                    rows += [(doc, *m) for m in match(identifiers(text), gap)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "licence", "sentences", "first_sentence", "last_sentence"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = GAP) -> DataFrame:
    """One row per licence occurrence: doc_id, licence, sentences, first_sentence, last_sentence (positions from 0)."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(gap), "doc_id long, licence string, sentences long, first_sentence long, last_sentence long")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
