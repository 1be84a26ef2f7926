"""Licence scan by sentence rules, in DataFrame functions only; no shuffle.

A text is split into sentences, each is normalised and looked up among the
known licence sentences.  A sentence may run over any lines of a paragraph,
with or without comment marks before them, but begins and ends at the end of a
line, of a sentence or of the paragraph.  The identifiers found, in the text's
order, are then matched against licence rules: a rule holds where its
identifiers follow each other with no other known sentence between.  The rules
are ordered and the first that holds names the document's licence.

Sentences are those of the published licences, the headers that they ask for and
usual one-line notices; families that differ by a name or a version (GNU, Creative
Commons, SPDX tags) are made by rule.  An identifier stands for one statement, in
whatever variants it is published.

The SQL knows sentences on one line only; those over several lines are held by
tests.

Defined results: a null or empty text has no sentences and no licence; repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AND = "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
_APACHE = "Licensed under the Apache License, Version 2.0"
_OBTAIN = "You may obtain a copy of the License at"
_UNLESS = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS'
_URLS = [f"{scheme}://{www}apache.org/licenses/LICENSE-2.0{kind}" for scheme in ("http", "https") for www in ("www.", "") for kind in ("", ".txt", ".html")]
_DAMAGES = "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Known sentences by identifier, each in its published variants.
SENTENCES: dict[int, tuple[str, ...]] = {
    # one-line notices
    1: ("All rights reserved.",),
    2: ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."),
    3: (_APACHE, f'{_APACHE} (the "License")', f'{_APACHE} (the "Apache License")'),
    4: ("This work is licensed under the GNU General Public License, version 3.",),
    # MIT
    10: (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    11: (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    ),
    12: tuple(f'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, {_AND}{rest}' for rest in (" AND NONINFRINGEMENT.", " AND NON-INFRINGEMENT.", ", TITLE AND NON-INFRINGEMENT.")),
    13: (
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    # ISC and 0BSD
    20: tuple(f"Permission to use, copy, modify, {op} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." for op in ("and/or", "and")),
    21: tuple(f"Permission to use, copy, modify, {op} distribute this software for any purpose with or without fee is hereby granted." for op in ("and/or", "and")),
    22: ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',),
    23: (
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    # BSD
    30: ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    31: ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    32: ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    33: tuple(f"Neither the name of the {who} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." for who in ("copyright holder", "University", "organization")),
    34: tuple(
        f'THIS SOFTWARE IS PROVIDED BY {who} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
        for who in ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS", "THE AUTHOR AND CONTRIBUTORS")
    ),
    35: tuple(f"IN NO EVENT SHALL {who} {_DAMAGES}" for who in ("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "THE COPYRIGHT OWNER OR CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS", "THE AUTHOR OR CONTRIBUTORS")),
    # Apache
    41: tuple(f"You may not use this {what} except in compliance with the License." for what in ("file", "software", "work")),
    42: (_OBTAIN, *(f"{_OBTAIN} {url}" for url in _URLS)),
    43: tuple(f"{_UNLESS}, {rest}, either express or implied." for rest in ("WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "WITHOUT WARRANTY OF ANY KIND")),
    44: ("See the License for the specific language governing permissions and limitations under the License.",),
    45: (
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    # the GNU licences' own texts
    50: ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",),
    51: ("The GNU General Public License is a free, copyleft license for software and other kinds of works.",),
    52: ("The licenses for most software are designed to take away your freedom to share and change it.",),
    53: ("This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",),
    54: ("The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",),
    55: tuple(f"This {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE." for it in ("program", "library", "software", "file")),
    # Mozilla
    60: ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    61: tuple(f"If a copy of the MPL was not distributed with this file, You can obtain one at {scheme}://mozilla.org/MPL/2.0/." for scheme in ("http", "https")),
    62: ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",),
    # Eclipse
    65: (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    ),
    66: tuple(f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {v}2.0 which is available at {url}" for v in ("", "v. ", "v") for url in ("https://www.eclipse.org/legal/epl-2.0/", "http://www.eclipse.org/legal/epl-2.0", "https://www.eclipse.org/legal/epl-2.0")),
    # public domain
    70: ("This is free and unencumbered software released into the public domain.",),
    71: ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    72: ("This work is dedicated to the public domain under the CC0 license.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    73: (
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    ),
    # Boost and zlib
    75: ("Distributed under the Boost Software License, Version 1.0.",),
    76: (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    ),
    77: ("This software is provided 'as-is', without any express or implied warranty.",),
    78: ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
}
#: What one sentence says in the place of several: the Apache header's first sentence, and what wraps around its address.
JOINED: list[tuple[str, tuple[int, ...]]] = [
    *((f"{head}; you may not use this {what} except in compliance with the License.", (3, 41)) for head in SENTENCES[3] for what in ("file", "software", "work")),
    *((f"{_OBTAIN} {url} {rest}", (42, 43)) for url in _URLS for rest in SENTENCES[43]),
]
#: GNU notices, by licence and version; from 100.
GNU: list[tuple[str, str, tuple[str, ...]]] = [("gpl", "GNU General Public License", ("2", "3")), ("lgpl", "GNU Lesser General Public License", ("2.1", "3")), ("lgpl", "GNU Library General Public License", ("2",)), ("agpl", "GNU Affero General Public License", ("3",))]
#: Creative Commons: short names and titles; from 200.
CREATIVE_COMMONS: list[tuple[str, str]] = [
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
]
#: SPDX tags; from 300.
SPDX: list[str] = "MIT ISC 0BSD Zlib BSL-1.0 BSD-2-Clause BSD-3-Clause Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0".split()
#: Rules in the order in which they are tried: whole texts and headers before single notices.
RULES: list[tuple[str, tuple[int, ...]]] = [
    ("mit-text", (10, 11, 12, 13)),
    ("mit-text", (10, 11, 12)),
    ("isc-text", (20, 22, 23)),
    ("0bsd-text", (21, 22, 23)),
    ("bsd-3-clause-text", (30, 31, 32, 33, 34, 35)),
    ("bsd-2-clause-text", (30, 31, 32, 34, 35)),
    ("bsd-text", (30, 31)),
    ("apache-2.0-text", (3, 41, 42, 43, 44)),
    ("apache-2.0-text", (3, 41, 42, 43)),
    ("apache-2.0-header", (3, 41)),
    ("apache-2.0-terms", (45,)),
    ("agpl-3.0-terms", (50, 54)),
    ("gpl-3.0-terms", (50, 51)),
    ("gpl-2.0-terms", (50, 52)),
    ("lgpl-3.0-terms", (50, 53)),
    ("mpl-2.0-header", (60, 61)),
    ("unlicense-text", (70, 71)),
    ("zlib-text", (77, 78)),
    ("boost-text", (76,)),
]
_SINGLE: list[tuple[str, int]] = [("mit", 2), ("mit", 10), ("isc", 20), ("0bsd", 21), ("apache-2.0", 3), ("apache-2.0", 41), ("bsd", 30), ("bsd", 31), ("mpl-2.0", 60), ("mpl-1.1", 62), ("epl-1.0", 65), ("epl-2.0", 66), ("unlicense", 70), ("boost", 75), ("zlib", 78), ("lgpl-3.0", 53), ("gpl-3.0", 4)]


def _families() -> None:
    """Adds the sentences and rules that follow from GNU, CREATIVE_COMMONS and SPDX."""
    foundation = "as published by the Free Software Foundation"
    key = 100
    for short, title, versions in GNU:
        programs = [f"This {x} is free software: you can redistribute it and/or modify it under the terms of the {title}" for x in ("program", "library", "software", "file", "code")]
        for version in versions:
            for later, rest in (("", ("", " only")), ("-or-later", (", or (at your option) any later version",))):
                ends = [f"{foundation}, {either}version {version} of the License{r}" for either in ("either ", "") for r in rest]
                ends += [f"version {version}{r}, {foundation}" for r in ("", " only")] if not later else []
                SENTENCES[key] = tuple(f"{head} {end}." for head, end in product(programs, ends))
                _SINGLE.append((f"{short}-{version}{'' if '.' in version else '.0'}{later}", key))
                key += 1
        SENTENCES[key] = tuple(f"{head} {foundation}." for head in programs)
        _SINGLE.append((short, key))
        key += 1
        SENTENCES[key] = (f"See the {title} for more details.",)
        key += 1
    key = 200
    for short, title in CREATIVE_COMMONS:
        for version, place in (("4.0", "International"), ("3.0", "Unported")):
            notices = [f"Licensed under CC {short} {version}."]
            notices += [f"This work is licensed under {a} Creative Commons {title} {version}{p} License." for a in ("a", "the") for p in (f" {place}", "")]
            SENTENCES[key] = tuple(notices)
            _SINGLE.append((f"cc-{short.lower()}-{version}", key))
            key += 1
    for k, tag in enumerate(SPDX):
        SENTENCES[300 + k] = (f"SPDX-License-Identifier: {tag}",)
        _SINGLE.append((tag.lower(), 300 + k))
    RULES.extend((name, (k,)) for name, k in _SINGLE)
    RULES.extend([("cc0", (72,)), ("cc0", (73,)), ("proprietary", (1,))])


_families()
#: Each known sentence holds one of these, so a text without any needs no splitting.
ANCHORS = ("licen", "rights", "permission", "warrant", "redistribut", "software", "copyright", "public domain", "liable", "mpl was")


def normal(sentence: str) -> str:
    """Lower-case words with a blank between, and | where a sentence's own points would end it."""
    parts = re.split(r"[.!?][\x20\x09-\x0D]+", sentence.strip())
    return "|".join(" ".join(re.findall("[0-9a-z]+", part.lower())) for part in parts)


def known_sentences(sentences: dict[int, tuple[str, ...]] = SENTENCES, joined: list[tuple[str, tuple[int, ...]]] = JOINED) -> dict[str, tuple[int, ...]]:
    """Identifiers by normal sentence."""
    return {normal(s): ids for s, ids in joined} | {normal(s): (i,) for i, variants in sentences.items() for s in variants}


def _pattern(known: list[str]) -> str:
    """A regular expression for any of the sentences over any lines, the longest first: a tree by words, so that few are tried."""
    tree: dict = {}
    for s in known:
        node = tree
        for part, mark in re.findall(r"([0-9a-z ]+)(\|?)", s):
            words = part.split(" ")
            for step in (words[0], *(f"[ ~]{w}" for w in words[1:]), *([r"\|"] if mark else [])):
                node = node.setdefault(step, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [step + written(below) for step, below in sorted(node.items()) if step]
        if not ways:
            return ""
        return ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})" + ("?" if "" in node else "")

    return written(tree)


def _bounded(text: Column) -> Column:
    """Normal words parted by blanks, by ~ where a line ends, and by | where a sentence or paragraph does."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    broken = F.regexp_replace(lower, r"[.!?][\x20\x09-\x0D]+", "\n\n")
    plain = F.regexp_replace(broken, r"(?m)^[\x20\x09]*(?:rem|dnl)(?=[\x20\x09]|$)", "")  # comment marks of letters
    words = F.trim(F.regexp_replace(plain, "[^0-9a-z\n]+", " "))
    ends = F.regexp_replace(words, r" ?\n(?: ?\n)+ ?", "|")
    return F.concat(F.lit("|"), F.regexp_replace(ends, r" ?\n ?", "~"), F.lit("|"))


def scan(docs: DataFrame, sentences: dict[int, tuple[str, ...]] = SENTENCES, rules: list[tuple[str, tuple[int, ...]]] = RULES, anchors: tuple[str, ...] = ANCHORS, joined: list[tuple[str, tuple[int, ...]]] | None = None) -> DataFrame:
    """doc_id, n_known, sentence_ids, licences (all that hold, by rule order), licence (the first).

    ``joined`` is ``JOINED`` unless other sentences than ``SENTENCES`` are given.
    """
    by_text = known_sentences(sentences, joined if joined is not None else JOINED if sentences is SENTENCES else [])
    loose = [s for s in by_text if not any(a in s for a in anchors)]
    if loose:
        raise ValueError(f"known sentences without an anchor: {loose}")
    known = F.create_map(*(x for s, ids in by_text.items() for x in (F.lit(s), F.array(*map(F.lit, ids)))))
    met = F.regexp_extract_all(_bounded(F.col("text")), F.lit(f"(?<=[|~]){_pattern(list(by_text))}(?=[|~])"), F.lit(0))
    ids = F.flatten(F.transform(met, lambda s: F.try_element_at(known, F.translate(s, "~", " "))))
    # an anchor may run over a line's end
    has = F.col("text").rlike("(?i)" + "|".join(a.replace(" ", "[^0-9a-z]+") for a in anchors))
    found = docs.select("doc_id", F.when(has, ids).otherwise(F.array().cast("array<int>")).alias("ids"))
    joined_ids = F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|"))
    held = [F.when(F.contains("joined", F.lit("|" + "|".join(map(str, seq)) + "|")), F.lit(name)) for name, seq in rules]
    return found.select("doc_id", F.size("ids").cast("long").alias("n_known"), joined_ids.alias("joined")).select(
        "doc_id",
        "n_known",
        F.when(F.col("n_known") > 0, F.expr("substring(joined, 2, length(joined) - 2)")).otherwise("").alias("sentence_ids"),
        F.array_join(F.array_distinct(F.array_compact(F.array(*held))), ",").alias("licences"),
        F.coalesce(*held).alias("licence"),
    )


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLE = f"""
WITH known(sentence, ids) AS (VALUES {", ".join(f"({_literal(s)}, {list(ids)})" for s, ids in known_sentences().items() if "|" not in s)}),
m AS (SELECT map(list(sentence), list(ids)) AS m FROM known),
parts AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10)) AS p FROM documents),
ids AS (SELECT doc_id, flatten(list_filter(list_transform(p, lambda s: m[trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z]+', ' ', 'g'))]), lambda i: i IS NOT NULL)) AS ids FROM parts, m),
joined AS (SELECT doc_id, ids, '|' || array_to_string(ids, '|') || '|' AS j FROM ids),
held AS (SELECT doc_id, ids, list_filter([{", ".join(f"CASE WHEN contains(j, '|{'|'.join(map(str, seq))}|') THEN '{name}' END" for name, seq in RULES)}], lambda x: x IS NOT NULL) AS h FROM joined)
SELECT doc_id, len(ids)::BIGINT AS n_known, array_to_string(ids, '|') AS sentence_ids,
  array_to_string(list_filter(h, lambda x, i: list_position(h, x) = i), ',') AS licences, h[1] AS licence
FROM held
"""
