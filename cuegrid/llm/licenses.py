"""Licence scans with a positional rare-token index (operator 3).

The templates below, licence texts and usual notices, are indexed by word: word -> (template, position).
Document frequencies of the licence vocabulary are counted over the whole corpus first (that table is
bounded by the vocabulary). A file's licence words are looked up from the highest inverse document
frequency on; their postings, taken relative to the places in the file, meet in alignments
(template, place of its first word in the file) that carry the weight of the words agreeing on
them. An alignment counts once the template's mandatory key phrases stand where it puts them.

Lookups end when no word is left that is the rarest of some template's key phrases (its anchor). A file that
holds the key phrases holds the anchor at its place, so no match is missed and nothing is capped; in
a file without anchors nothing is looked up.

Defined results: null text counts as empty (0 words, no labels, score 0, null positions); ids may
be null or repeated, each row gives a row; words are found in the A-Z-folded text and consist of
a-z, 0-9 and non-ASCII characters; very long texts are taken whole; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.text import as_bytes

#: Phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label -> (text of the licence or of its notice, mandatory key phrases).
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. THE "
        'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ["permission is hereby granted free of charge", "deal in the software without restriction"],
    ),
    "mit-notice": (
        "Released under the MIT License",
        ["released under the mit license"],
    ),
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
        "in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
        ["licensed under the apache license version 2 0"],
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE.",
        ["under the terms of the gnu general public license as published by the free software foundation"],
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        ["gnu general public license version 3"],
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        ["gnu general public license version 2"],
    ),
    "lgpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ["gnu lesser general public license"],
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ["gnu affero general public license"],
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. THIS "
        'SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS "
        "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
        "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        ["redistribution and use in source and binary forms", "provided that the following conditions are met"],
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ["mozilla public license v 2 0"],
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        'in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
        "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
        "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
        ["permission to use copy modify and or distribute this software", "with or without fee is hereby granted"],
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
        "modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In "
        "jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
        "and all copyright interest in the software to the public domain.",
        ["free and unencumbered software released into the public domain"],
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the "
        "authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: The origin of this "
        "software must not be misrepresented; you must not claim that you wrote the original software.",
        ["this software is provided as is without any express or implied warranty", "the origin of this software must not be misrepresented"],
    ),
    "cc0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring "
        "rights to this work. CC0 1.0 Universal",
        ["cc0 1 0 universal"],
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0",
        ["licensed under cc by 4 0"],
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0",
        ["licensed under cc by sa 4 0"],
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0",
        ["licensed under cc by nc 4 0"],
    ),
}
#: Words by which a key phrase may stand away from where the alignment puts it, and one more for each so
#: many words between it and the anchor.
SLACK, DRIFT = 3, 10

_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def license_words(text: bytes | None) -> list[bytes]:
    """Every byte that is no letter, digit or part of a non-ASCII character becomes a blank."""
    return text.translate(_FOLD).split() if text else []


def _words(text: str) -> list[bytes]:
    return license_words(text.encode())


@dataclass(frozen=True)
class Index:
    """Templates by label; postings, weights, mandatory phrases with their template positions, and the
    labels that each word is the anchor of, with the anchor's template position."""

    words: dict[str, list[bytes]]
    postings: dict[bytes, list[tuple[str, int]]]
    phrases: dict[str, list[tuple[list[bytes], int]]]
    anchors: dict[bytes, list[tuple[str, int]]]
    idf: dict[bytes, float]

    @property
    def vocabulary(self) -> frozenset[bytes]:
        return frozenset(self.postings)


def build_index(frequency: dict[bytes, int], documents: int, templates=TEMPLATES) -> Index:
    words = {label: _words(text) for label, (text, _) in templates.items()}
    postings, anchors = defaultdict(list), defaultdict(list)
    for label, own in words.items():
        for i, w in enumerate(own):
            postings[w].append((label, i))
    idf = {w: max(1e-3, math.log((documents + 1) / (frequency.get(w, 0) + 0.5))) for w in postings}
    phrases = {label: [(p := _words(phrase), _find(words[label], p)[0]) for phrase in keys] for label, (_, keys) in templates.items()}
    for label, own in phrases.items():
        places = [(-idf[w], at + i, w) for phrase, at in own for i, w in enumerate(phrase)]
        _, at, word = min(places)
        anchors[word].append((label, at))
    return Index(words, dict(postings), phrases, dict(anchors), idf)


def _find(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Starts of the phrase in the words."""
    first, n, found, i = phrase[0], len(phrase), [], -1
    try:
        while True:
            i = words.index(first, i + 1)
            if words[i : i + n] == phrase:
                found.append(i)
    except ValueError:
        return found


_BASE = [(_words(phrase), label) for phrase, label in BASE_PHRASES.items()]


def base_hits(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every base phrase."""
    return sorted((i, label) for phrase, label in _BASE for i in _find(words, phrase))


def _near(sorted_places: list[int], at: int, slack: int) -> bool:
    k = bisect_left(sorted_places, at - slack)
    return k < len(sorted_places) and sorted_places[k] <= at + slack


def alignments(words: list[bytes], index: Index) -> tuple[dict[tuple[str, int], float], dict[bytes, list[int]]]:
    """(label, place of the template's first word) -> weight of the looked-up words that agree on it,
    for those that the label's anchor agrees on; and the places of the licence words in the file."""
    present = index.vocabulary.intersection(words)
    rare = sorted(present, key=lambda w: (-index.idf[w], w))
    while rare and rare[-1] not in index.anchors:
        rare.pop()
    if not rare:
        return {}, {}
    places = defaultdict(list)
    for i, w in enumerate(words):
        if w in present:
            places[w].append(i)
    votes = Counter({(label, i - at): 0.0 for w in rare for label, at in index.anchors.get(w, ()) for i in places[w]})
    for w in rare:
        for label, at in index.postings[w]:
            for i in places[w]:
                if (label, i - at) in votes:
                    votes[label, i - at] += index.idf[w]
    return votes, places


def template_hits(words: list[bytes], index: Index) -> dict[str, float]:
    """Verified templates and the share of their IDF mass that stands where it should."""
    votes, places = alignments(words, index)
    anchor = {label: at for own in index.anchors.values() for label, at in own}
    starts: dict[tuple, list[int]] = {}
    found = {}
    for (label, offset), _ in sorted(votes.items(), key=lambda v: (v[0][0], -v[1], v[0][1])):
        if label in found:
            continue
        slack = lambda at: SLACK + abs(at - anchor[label]) // DRIFT  # noqa: B023, E731
        for phrase, at in index.phrases[label]:
            key = tuple(phrase)
            if key not in starts:
                starts[key] = _find(words, phrase)
            if not _near(starts[key], offset + at, slack(at)):
                break
        else:
            own = index.words[label]
            held = sum(index.idf[w] for i, w in enumerate(own) if w in places and _near(places[w], offset + i, slack(i)))
            found[label] = held / sum(index.idf[w] for w in own)
    return found


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word occurs, over the whole corpus, and their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = Counter(), 0
        for batch in batches:
            for t in as_bytes(batch.column(0)):
                rows += 1
                seen.update(vocabulary.intersection(license_words(t)))
        yield pa.RecordBatch.from_arrays([pa.array([*seen, b""], pa.binary()), pa.array([*seen.values(), rows], pa.int64())], names=["word", "n"])

    counted = docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    seen = {bytes(r["word"]): r["n"] for r in counted}
    return seen, seen.pop(b"", 0)


def scan_text(text: bytes | None, index: Index) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = license_words(text)
    base = base_hits(words)
    own = template_hits(words, index)
    base_labels = {label for _, label in base}
    score = 1.0 if base else min(1.0, max(own.values(), default=0.0))
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(base_labels)), ",".join(sorted(base_labels | set(own))), score)


_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id and the fields of ``scan_text`` for every row of ``docs`` (doc_id, text)."""
    vocabulary = build_index({}, 0, templates).vocabulary
    index = docs.sparkSession.sparkContext.broadcast(build_index(*document_frequencies(docs, vocabulary), templates))

    @F.arrow_udf("struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double>")
    def scan(texts: pa.Array) -> pa.Array:
        rows = [scan_text(t, index.value) for t in as_bytes(texts)]
        columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

    return docs.select("doc_id", scan("text").alias("found")).select("doc_id", "found.*")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
