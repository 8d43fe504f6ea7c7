"""Operator 5: licence scan, an exact set-similarity join of licence templates with the text blocks of documents.

A block is a run of 2L words of a document, one for every L words, where L is the template's length in words; so
every passage as long as the template stands whole in some block. A block meets a template when it holds at least
`threshold` of the template's distinct words. Words are ordered by how often they occur in the whole corpus, rarest
first; then a block that meets the threshold holds one of the first |T| - need + 1 words of the template (prefix
filter), holds at least `need` template words (length filter), and of a first shared word at place i at most |T| - i
words can be shared (positional filter). What passes is counted exactly.

Only the templates (a fixed list) and the counts of their words are sent to the tasks; documents are not shuffled.
Defined results: a null or empty text has no words, no places and score 0. Repeated rows get one result each; an empty
table none. Of equally good blocks of a text the score tells one; `blocks` returns every block that meets a template. A long
text is scanned whole; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import table
from engram.llm.textvec import ALNUM, Block, slices

THRESHOLD = 0.8
#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Passages and whole texts of public licences, and their labels.
TEMPLATES = {
    "mit-whole": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-whole": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-whole": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "mit-notice": "Released under the MIT License",
    "apache-2-short": "Licensed under the Apache License Version 2.0",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0",
    "reserved": "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without prior written permission",
}


def words_of(text: str) -> list[str]:
    """The words of a short text, as the scan sees them."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _hashes(words: list[str]) -> np.ndarray:
    return Block(pa.array([" ".join(words)]), ALNUM).h


class Templates:
    """Templates with their words ordered by corpus frequency, ready for the tasks. count: hash of a word -> occurrences."""

    def __init__(self, templates: dict[str, str], threshold: float, count: dict[int, int]):
        self.labels, self.lengths, self.ids, self.need = list(templates), [], [], []
        hashed = [_hashes(words_of(t)) for t in templates.values()]
        self.vocabulary = np.unique(np.concatenate(hashed))
        seen = np.array([count.get(int(h), 0) for h in self.vocabulary.view(np.int64)], dtype=np.int64)
        rank = np.empty(len(seen), dtype=np.int64)
        rank[np.lexsort((self.vocabulary, seen))] = np.arange(len(seen))
        self.rank = rank  # place of each vocabulary word in the global order, rarest first
        for h in hashed:
            self.lengths.append(len(h))
            self.ids.append(np.unique(rank[np.searchsorted(self.vocabulary, h)]))
            self.need.append(int(np.ceil(threshold * len(self.ids[-1]) - 1e-9)))

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """The rank of each word, -1 for words of no template."""
        i = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[i] == h, self.rank[i], -1)

    def blocks(self, ranks: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, str, int, int, float]]:
        """(text number, label, first word, end, containment) of each block that meets a template."""
        known = np.flatnonzero(ranks >= 0)
        for label, length, ids, need in zip(self.labels, self.lengths, self.ids, self.need, strict=True):
            place = np.minimum(np.searchsorted(ids, ranks[known]), len(ids) - 1)
            mine = ids[place] == ranks[known]
            at, place = known[mine], place[mine]
            hits = at[place <= len(ids) - need]  # prefix filter
            if not len(hits):
                continue
            doc = np.searchsorted(first, hits, side="right") - 1
            block = (hits - first[doc]) // length
            starts = np.unique(np.concatenate([first[doc] + block * length, first[doc] + np.maximum(block - 1, 0) * length]))
            doc = np.searchsorted(first, starts, side="right") - 1
            ends = np.minimum(starts + 2 * length, first[doc + 1])
            a, z = np.searchsorted(at, starts), np.searchsorted(at, ends)
            # length filter: too few words of the template; positional filter: after the first shared one too few can follow
            rarest = np.minimum.reduceat(np.append(place, len(ids)), np.stack([a, z], 1).ravel())[::2]
            for i in np.flatnonzero((z - a >= need) & (len(ids) - rarest >= need)):
                shared = len(np.unique(place[a[i] : z[i]]))
                if shared >= need:
                    yield int(doc[i]), label, int(starts[i] - first[doc[i]]), int(ends[i] - first[doc[i]]), shared / len(ids)

    def find(self, ranks: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, str, float]]:
        """(text number, label, containment) of each text and template with a block that meets the threshold; the best block counts."""
        best: dict[tuple[int, str], float] = {}
        for doc, label, _, _, share in self.blocks(ranks, first):
            best[doc, label] = max(best.get((doc, label), 0.0), share)
        yield from ((doc, label, share) for (doc, label), share in best.items())


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """Occurrences over all texts of the words in a fixed vocabulary."""

    def count(batches):
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for b in slices(batches):
            h = Block(b.column("text"), ALNUM).h
            i = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            total += np.bincount(i[vocabulary[i] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.view(np.int64)), pa.array(total)], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def scan(docs: DataFrame, *, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found (label and containment of each template met)."""
    docs = docs.select("doc_id", "text")
    vocabulary = Templates(templates, threshold, {}).vocabulary
    known = Templates(templates, threshold, word_counts(docs, vocabulary))
    base = [(label, _hashes(words_of(p))) for p, label in phrases.items()]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found array<struct<label: string, containment: double>>"
    kind = pa.list_(pa.struct([("label", pa.string()), ("containment", pa.float64())]))

    def run(batches):
        for b in slices(batches):
            block = Block(b.column("text"), ALNUM)
            h, doc, first = block.h, block.doc, block.first
            places = np.zeros(block.n, dtype=np.int64)
            low, high = np.full(block.n, np.iinfo(np.int64).max), np.full(block.n, -1)
            names: list[set[str]] = [set() for _ in range(block.n)]
            more: list[dict[str, float]] = [{} for _ in range(block.n)]
            for label, want in base:
                k = len(want)
                if len(h) < k:
                    continue
                at = np.flatnonzero(h[: len(h) - k + 1] == want[0])
                for i in range(1, k):
                    at = at[h[at + i] == want[i]]
                at = at[doc[at] == doc[at + k - 1]]
                d, w = doc[at], at - first[doc[at]]
                np.add.at(places, d, 1)
                np.minimum.at(low, d, w)
                np.maximum.at(high, d, w)
                for i in set(d.tolist()):
                    names[i].add(label)
            for i, label, share in known.find(known.ranks(h), first):
                more[i][label] = share
            none = high < 0
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()), pa.array(block.counts()), pa.array(places), pa.array(low, mask=none), pa.array(high, mask=none),
                    pa.array([",".join(sorted(x)) for x in names]), pa.array([",".join(sorted(x | set(m))) for x, m in zip(names, more, strict=True)]),
                    pa.array([1.0 if x else max(m.values(), default=0.0) for x, m in zip(names, more, strict=True)]),
                    pa.array([[{"label": k, "containment": v} for k, v in sorted(m.items())] for m in more], type=kind),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"],
            )

    return docs.mapInArrow(run, schema)


def blocks(docs: DataFrame, *, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, label, start, end (words from 0), containment of every block that meets a template."""
    docs = docs.select("doc_id", "text")
    known = Templates(templates, threshold, word_counts(docs, Templates(templates, threshold, {}).vocabulary))
    kinds = [("doc_id", pa.int64()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]

    def run(batches):
        for b in slices(batches):
            block, ids = Block(b.column("text"), ALNUM), b.column("doc_id").to_pylist()
            rows = [(ids[d], *r) for d, *r in known.blocks(known.ranks(block.h), block.first)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    return docs.mapInArrow(run, "doc_id long, label string, start long, end long, containment double")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")


def _sql() -> str:
    """The same rows in SQL: every template word in a document counts in the block that begins at its multiple of L and in the one before."""
    lists = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    phrases = " UNION ALL ".join(f"SELECT doc_id, p - 1 AS place, '{label}' AS label FROM spot WHERE w[p : p + {len(words_of(x)) - 1}] = {lists(words_of(x))}" for x, label in PHRASES.items())
    rows = []
    for label, t in TEMPLATES.items():
        own = words_of(t)
        need = int(np.ceil(THRESHOLD * len(set(own)) - 1e-9))
        rows += [f"('{label}', {len(own)}, {len(set(own))}, {need}, '{w}')" for w in sorted(set(own))]
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents), spot AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
places AS ({phrases}),
base AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS z, list_distinct(list(label)) AS labels FROM places GROUP BY doc_id),
t(label, l, size, need, word) AS (VALUES {", ".join(rows)}),
hits AS (SELECT doc_id, label, l, size, need, word, (p - 1) // l AS b FROM spot JOIN t ON w[p] = word),
blocks AS (SELECT doc_id, label, size, b, count(DISTINCT word) AS n FROM (SELECT * FROM hits UNION ALL SELECT doc_id, label, l, size, need, word, b - 1 FROM hits WHERE b > 0) GROUP BY doc_id, label, size, need, b HAVING count(DISTINCT word) >= need),
met AS (SELECT doc_id, list(label) AS labels, max(share) AS best FROM (SELECT doc_id, label, max(n / size) AS share FROM blocks GROUP BY 1, 2) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, a AS first_word, z AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(met.labels, [])))), ','), '') AS labels, CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN met ON met.doc_id = d.doc_id
"""


OP5_SQL = _sql()
