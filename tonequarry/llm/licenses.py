"""License scanning by an exact set-similarity join of templates and blocks of text.

A block of a template is a run of consecutive words as long as the template, and a quarter longer at most; every place of
every text starts one. A block matches if it holds at least ``CONTAINED`` of the template's distinct words. All such
blocks are found:

- words are ordered by their frequency in the whole corpus, the rarest first, ties by word; a matching block holds one of
  the few rarest words of the template (its prefix), so texts without one are passed over;
- length: about such a word, enough words of the template must stand within a block's length;
- position: with the word at place i of the template's order as the rarest one found, at most the template's words from
  i on can be shared;
- what is left is counted exactly: each word of the template covers the starts of the blocks that hold it.

Texts aren't moved: templates and their order go to the tasks (``MOST_BYTES`` of templates at most). Long texts are taken
apart in steps; a number for each word is all that is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import narrow_batches, tidy


class Template(NamedTuple):
    label: str
    text: str


#: The phrases of the base rule, and their labels.
PHRASES = (Template("cc-by", "cc by"), Template("gpl", "general public license"), Template("reserved", "all rights reserved"))

#: Names of licenses (of four distinct words at most: they must stand whole) and the notices they ask for.
TEMPLATES = (
    Template("apache", "apache license version 2"),
    Template("bsd", "the bsd license"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("gnu", "gnu public license version"),
    Template("mit", "the mit license"),
    Template("mozilla", "mozilla public license"),
    Template(
        "apache-notice",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    Template(
        "bsd-notice",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    Template("cc-notice", "This work is licensed under a Creative Commons Attribution International License. To view a copy of this license, visit http://creativecommons.org/licenses"),
    Template(
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.",
    ),
    Template(
        "mit-notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
    ),
    Template("mozilla-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)

#: Share of a template's distinct words that a block holds; a block is as many times longer than its template as this allows.
CONTAINED = Fraction(4, 5)
#: Bytes of all templates that are sent to the tasks, at most.
MOST_BYTES = 16 << 20
#: Bytes that are taken apart at once.
STEP = 1 << 20

#: A-Z lower-cased; what is no letter or digit of ASCII is blank; other letters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in steps of about ``STEP`` bytes."""
    at = 0
    while at < len(data):
        end = at + STEP
        part = data[at:end].translate(FOLD)
        if end < len(data):  # a step ends at a blank, however far away
            while end < len(data) and FOLD[data[end]] != 32:
                far = end + 4096
                more = data[end:far].translate(FOLD)
                cut = more.find(b" ")
                part += more if cut < 0 else more[:cut]
                end += len(more) if cut < 0 else cut
        yield part.split()
        at = end


def words(text: str) -> list[bytes]:
    return [w for part in words_of(text.encode()) for w in part]


class Numbers:
    """Numbers of the words of templates and phrases; every other word is -1."""

    def __init__(self, templates: tuple[Template, ...]):
        self.all = sorted({w for t in templates for w in words(t.text)})
        self.of = {w: i for i, w in enumerate(self.all)}

    def __call__(self, data: bytes) -> np.ndarray:
        parts = [np.fromiter(map(self.of.get, p, repeat(-1)), "i4", len(p)) for p in words_of(data)]
        return np.concatenate(parts) if parts else np.zeros(0, "i4")


class Order:
    """The templates as sets in the corpus' order of rarity, with an index from prefix words to templates."""

    def __init__(self, templates: tuple[Template, ...], numbers: Numbers, counts: np.ndarray):
        self.templates = templates
        self.sets, self.need, self.most = [], [], []
        for t in templates:
            own = [numbers.of[w] for w in words(t.text)]
            if not own:
                raise ValueError(f"template {t.label} has no word")
            self.sets.append(np.array(sorted(set(own), key=lambda w: (counts[w], w))))
            self.need.append(-(-len(self.sets[-1]) * CONTAINED.numerator // CONTAINED.denominator))
            self.most.append(-(-len(own) * CONTAINED.denominator // CONTAINED.numerator))
        self.prefix: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            for w in s[: len(s) - self.need[i] + 1].tolist():
                self.prefix.setdefault(w, []).append(i)
        self.leads = np.zeros(len(numbers.all) + 1, bool)
        self.leads[list(self.prefix)] = True

    def blocks(self, ids: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(template, start, end, shared)``: maximal runs of matching blocks, from the first template word to the last."""
        seen = np.unique(ids[self.leads[ids]]).tolist()  # -1 looks at the spare place
        for i in sorted({t for w in seen for t in self.prefix[w]}):
            yield from self._of(i, ids)

    def _of(self, i: int, ids: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        own, need, most = self.sets[i], self.need[i], self.most[i]
        rank = np.full(len(self.leads), -1)
        rank[own] = np.arange(len(own))
        at = np.flatnonzero(rank[ids] >= 0)
        place = rank[ids[at]]
        anchor = np.flatnonzero(place <= len(own) - need)
        p = at[anchor]
        near = np.searchsorted(at, p + most) - np.searchsorted(at, p - most + 1)
        # Places to the left and to the right can't both be in one block whole, so this bound is a loose one.
        p = p[np.minimum(near, len(own) - place[anchor]) >= need]
        if not len(p):
            return
        # Regions of starts whose blocks hold an anchor; within each the starts that each word covers are counted.
        lo, hi = np.maximum(p - most + 1, 0), p + 1
        new = np.append(True, lo[1:] > hi[:-1])
        begins, ends = lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(p) - 1)]
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            here = slice(*np.searchsorted(at, [a, b - 1 + most]))
            pos, word = at[here], place[here]
            if len(pos) < need:
                continue
            order = np.lexsort((pos, word))
            pos, word = pos[order], word[order]
            since = np.where(np.append(False, word[1:] == word[:-1]), np.append(0, pos[:-1]) + 1, a)
            first = np.minimum(np.maximum(np.maximum(pos - most + 1, since), a), b)
            steps = np.bincount(first - a, minlength=b - a + 1) - np.bincount(np.minimum(pos + 1, b) - a, minlength=b - a + 1)
            # A word whose earlier place covers all starts of a later one adds nothing: its steps are at one place.
            shared = np.cumsum(steps)[: b - a]
            found = np.flatnonzero(shared >= need)
            if not len(found):
                continue
            cut = np.flatnonzero(np.diff(found) > 1)
            for x, y in zip(np.append(found[0], found[cut + 1]).tolist(), np.append(found[cut], found[-1]).tolist(), strict=True):
                in_run = np.sort(pos[(pos >= a + x) & (pos < a + y + most)])
                yield i, int(in_run[0]), int(in_run[-1]) + 1, int(shared[x : y + 1].max())


def places(phrase: list[int], ids: np.ndarray) -> np.ndarray:
    """Where the words of a phrase stand consecutively."""
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, "i8")
    ok = ids[:n] == phrase[0]
    for k, w in enumerate(phrase[1:], 1):
        ok &= ids[k : n + k] == w
    return np.flatnonzero(ok)


def corpus_counts(texts: DataFrame, numbers: Numbers) -> np.ndarray:
    """How often each word of the templates occurs in all texts: a table as large as the templates, summed in tasks first."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(numbers.all), "i8")
        for batch in batches:
            for x in batch.column(1):
                ids = numbers(x.as_py() or b"")
                total += np.bincount(ids[ids >= 0], minlength=len(total))
        word = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.int32()), pa.array(total[word])], ["word", "n"])

    out = np.zeros(len(numbers.all), "i8")
    for word, n in texts.mapInArrow(tidy(tally), "word int, n long").groupBy("word").agg(F.sum("n")).collect():
        out[word] = n
    return out


BLOCKS = "array<struct<template:int,start:int,end:int,shared:int>>"


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[Template, ...] = PHRASES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_words, places, blocks)`` of each row: the starts of each phrase, and all matching blocks of templates.

    ``places`` is ``array<struct<phrase, start>>`` by start; ``blocks`` is ``BLOCKS``, by template and start, where
    ``end`` is exclusive and ``shared`` the most distinct words that one block of the run shares with its template.
    Null and empty texts have no words; null ids and rows that repeat stand as they are; words of equal frequency are
    ordered by themselves; an empty table gives no rows.
    """
    every = (*templates, *phrases)
    if sum(len(t.text) for t in every) > MOST_BYTES:
        raise ValueError(f"templates of more than {MOST_BYTES} letters")
    numbers = Numbers(every)
    texts = narrow_batches(docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("binary").alias("text")))
    order = Order(templates, numbers, corpus_counts(texts, numbers))
    wanted = [[numbers.of[w] for w in words(p.text)] for p in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, blocks = [], [], []
            for x in batch.column(1):
                ids = numbers(x.as_py() or b"")
                n.append(len(ids))
                found.append([{"phrase": k, "start": s} for s, k in sorted((int(s), k) for k, w in enumerate(wanted) for s in places(w, ids))])
                blocks.append([dict(zip(("template", "start", "end", "shared"), b, strict=True)) for b in order.blocks(ids)])
            place = pa.list_(pa.struct([("phrase", pa.int32()), ("start", pa.int32())]))
            block = pa.list_(pa.struct([(c, pa.int32()) for c in ("template", "start", "end", "shared")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, place), pa.array(blocks, block)], ["doc_id", "n_words", "places", "blocks"])

    return texts.mapInArrow(tidy(run), f"doc_id long, n_words long, places array<struct<phrase:int,start:int>>, blocks {BLOCKS}")


def report(scanned: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[Template, ...] = PHRASES) -> DataFrame:
    """Labels and a score for each row of ``scan``.

    ``score``: 1 where a phrase stands, else the largest share of a template's words in one block; 0 without a match.
    """
    names = lambda some: F.array(*(F.lit(t.label) for t in some))
    sizes = F.array(*(F.lit(float(len(set(words(t.text))))) for t in templates))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base = F.transform("places", lambda p: names(phrases)[p["phrase"]])
    more = F.transform("blocks", lambda b: names(templates)[b["template"]])
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    best = F.array_max(F.transform("blocks", lambda b: b["shared"] / sizes[b["template"]]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def sql(templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[Template, ...] = PHRASES) -> str:
    """The same rows in DuckDB's SQL, by looking at every block that starts with a template's word."""
    quoted = lambda w: "'" + w.decode() + "'"
    vocabulary = ", ".join(f"({i}, {quoted(w)})" for i, t in enumerate(templates) for w in sorted(set(words(t.text))))
    shape = ", ".join(f"({i}, '{t.label}', {n}, {-(-n * CONTAINED.numerator // CONTAINED.denominator)}, {-(-len(words(t.text)) * CONTAINED.denominator // CONTAINED.numerator)})" for i, t in enumerate(templates) for n in [len(set(words(t.text)))])
    phrase = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS start, '{t.label}' AS label FROM w WHERE " + " AND ".join(f"list_extract(ws, i + {k}) = {quoted(x)}" for k, x in enumerate(words(t.text)))
        for t in phrases
    )
    return f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        v(t, word) AS (VALUES {vocabulary}),
        shape(t, label, size, need, most) AS (VALUES {shape}),
        firsts AS (SELECT DISTINCT x AS word FROM (VALUES {", ".join(f"({quoted(words(p.text)[0])})" for p in phrases)}) AS f(x)),
        flat AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
        w AS (SELECT flat.doc_id, i, d.ws FROM flat JOIN firsts USING (word) JOIN d USING (doc_id)),
        base AS ({phrase}),
        hit AS (SELECT doc_id, t, i, flat.word FROM flat JOIN v USING (word)),
        enough AS (SELECT doc_id, t FROM hit JOIN shape USING (t) GROUP BY doc_id, t, need HAVING count(DISTINCT word) >= need),
        few AS (SELECT hit.* FROM hit JOIN enough USING (doc_id, t)),
        block AS (SELECT a.doc_id, a.t, a.i, count(DISTINCT b.word) AS shared FROM few a JOIN shape USING (t) JOIN few b ON b.doc_id = a.doc_id AND b.t = a.t AND b.i >= a.i AND b.i < a.i + most GROUP BY a.doc_id, a.t, a.i),
        found AS (SELECT doc_id, label, shared / size::DOUBLE AS share FROM block JOIN shape USING (t) WHERE shared >= need),
        labels_of AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM found) GROUP BY doc_id),
        bases AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
        best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
        FROM d LEFT JOIN bases USING (doc_id) LEFT JOIN labels_of USING (doc_id) LEFT JOIN best USING (doc_id)"""
