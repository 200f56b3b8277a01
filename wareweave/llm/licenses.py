"""Licence scan by a trained paragraph classifier with template confirmation.

A paragraph is a run of lines between lines without words, so a notice that is wrapped
over lines is read as a whole. Inside it, stretches are looked at that run along a template,
in its order, and in what is left of the paragraph spans in which licence vocabulary
(the anchors) stands closer than ``GAP`` words: spans of each line and, where they reach
over a line's end, of the joined lines; such a span above ``WINDOW`` words is read in
overlapping windows. A span becomes the set of its hashed word unigrams, bigrams and
trigrams that hold an anchor, so a notice counts alike however much other text is around
it, and text without any anchor has no feature: skipping it changes no answer. Anchors
are the templates' words that few paragraphs of the corpus hold.

A softmax regression over these sparse features tells licence families apart; class 0 is
"unknown". It is fitted on variations of each family's templates (words dropped, put in,
cut off) and, as unknown, on a bounded sample of the corpus' paragraphs, those with
licence wording that no template matches among them, on fixed sentences that use licence
words in other senses, and on licence words in random order. The probability from which a
family is named is calibrated on whole templates and unknown texts that their fold's
model has not seen: the least threshold at which at most ``FALSE_RATE`` of the unknown are
named. A named span is confirmed only if it holds ``MIN_OVERLAP`` of some template's word
bigrams of the same family, or the family's template holds that share of the span's; what
the classifier names and no template confirms is reported as unconfirmed. Of overlapping
spans the confirmed, then the better matching one is reported. A stretch ends where its
template does, so notices that follow each other in a line or block are notices of their
own, as are the parts of a long licence text that are templates of their own.

Paragraphs are found, scored and compared where the document is read, so nothing is
shuffled and a document's output is one row per licence notice.

Defined cases: null, empty and blank texts have no paragraphs and no rows; repeated
rows give their rows again; a paragraph or line of any length is read whole, in time that grows with its words;
of equally good overlapping spans the first, of equally likely families the first by name
is reported; without a background sample the model knows the families, the fixed
sentences and random licence words; an empty table gives an empty result; columns other
than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareweave.llm.batches import slices, strings
from wareweave.llm.common import table, whole_text

#: Notices of common licences, by family.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
}
#: Sentences that use licence words in other senses.
OTHER_SENSES = (
    "You need a driving license and a general public transport card.",
    "Her driving licence was not valid in the state of Apache County.",
    "The fishing license costs twenty dollars and is sold at the lake.",
    "The library is open to the public and free of charge on Sundays.",
    "He gave permission to copy the file and to keep a copy of it.",
    "The software was distributed to all schools without any conditions.",
    "Students at MIT released a new version of the program last week.",
    "The work was published in 2004 and redistributed by the museum.",
    "A warranty of two years applies to every device that we sell.",
    "Under the law, both parties agreed to the terms in writing.",
    "The Mozilla browser opened the source of the page in a new window.",
    "The conditions of the contract were met and the notice was included.",
    "The artist waived her fee and dedicated the song to her mother.",
    "A creative common room was built for the international students.",
    "The foundation is a free and public body that supports young authors.",
    "The general published a book about his work in the public service.",
    "All rights of the tenant are described in section two of the notice.",
    "Please read the terms of use before you modify your subscription.",
    "A copyright dispute over the film was settled out of court.",
    "The pub lost its license to sell beer after midnight.",
    "They were furnished with copies of the form, subject to the approval of the board.",
    "The binary star was found in a source of the northern sky.",
    "The version of the story that he told was later shown to be false.",
    "The public domain of the city is cleaned by a private company.",
)
#: Paragraphs with such words count as unknown only where no template matches them.
WORDING = r"(?i)licen[sc]e|copyright|warrant|redistribut|public domain|creative commons|spdx"
BACKGROUND, BACKGROUND_DOCUMENTS, WORDED = 1500, 300, 500
VARIATIONS, SCRAMBLED, FOLDS, EPOCHS, RATE, DECAY = 30, 600, 4, 200, 0.5, 1e-4
FALSE_RATE = 0.001
MIN_OVERLAP = 0.6
#: A template's word is an anchor unless more than this share of background paragraphs hold it.
COMMON = 0.02
GAP, WINDOW = 8, 64
#: Spans of a text whose names are kept for when they are said again.
SEEN = 50_000
WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words(paragraph: str) -> list[str]:
    return WORDS.findall(paragraph.lower())


def features(found: list[str], anchors: set[str]) -> list[int]:
    """Hashes of the distinct word n-grams of order one to three that hold an anchor."""
    hit = [w in anchors for w in found]
    grams = {w for w, h in zip(found, hit, strict=True) if h}
    for n in (2, 3):
        grams |= {" ".join(found[i : i + n]) for i in range(len(found) - n + 1) if any(hit[i : i + n])}
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) for g in grams]


def bigrams(found: list[str]) -> set[tuple[str, str]]:
    return set(zip(found, found[1:], strict=False))


def overlap(found: list[str], family: str) -> tuple[float, int, int]:
    """Best containment of bigrams between a span and a template, either way, and the
    part of the span that holds the shared bigrams."""
    mine, best = bigrams(found), (0.0, 0, len(found))
    for template in TEMPLATES[family]:
        theirs = bigrams(words(template))
        shared = mine & theirs
        if not shared:
            continue
        # a short template lies inside a span, a long one may be cut by it
        share = max(len(shared) / len(theirs), len(shared) / len(mine) if len(mine) >= 8 else 0.0)
        if share > best[0]:
            at = [i for i, pair in enumerate(zip(found, found[1:], strict=False)) if pair in shared]
            pairs = [(found[i], found[i + 1]) for i in at]
            a, b = 0, len(at) - 1
            while pairs[a] in pairs[a + 1 : b + 1]:  # said again further on
                a += 1
            while pairs[b] in pairs[a:b]:
                b -= 1
            best = (share, at[a], at[b] + 2)
    return best


@dataclass
class Classifier:
    families: list[str]
    anchors: set[str]
    place: dict[int, int]
    weight: np.ndarray  # features x classes
    bias: np.ndarray
    threshold: float = 0.5

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        """Softmax over [unknown, *families]; features that were never seen only count in the length."""
        logits = np.tile(self.bias, (len(rows), 1))
        for i, row in enumerate(rows):
            at = [p for h in row if (p := self.place.get(h)) is not None]
            if at:
                logits[i] += self.weight[at].sum(0) / np.sqrt(len(row))
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _examples(background: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Token lists, their classes (0: unknown) and their folds; a fold holds whole templates."""
    rng = np.random.default_rng(5)
    plain = [words(p) for p in background]
    filler = [w for p in plain[:200] for w in p] or ["text"]
    rows, label, fold = [], [], []

    def add(tokens: list[str], k: int, f: int) -> None:
        rows.append(tokens)
        label.append(k)
        fold.append(f % FOLDS)

    def varied(full: list[str], k: int, f: int, times: int) -> None:
        for v in range(times):
            kept = [w for w in full if rng.random() > 0.08] if v and len(full) > 6 else list(full)
            extra = [str(filler[i]) for i in rng.integers(0, len(filler), int(rng.integers(0, 8)) if v else 0)]
            cut = int(rng.integers(0, len(extra) + 1))
            add(extra[:cut] + kept + extra[cut:], k, f)

    f = 0
    for k, notices in enumerate(TEMPLATES.values(), 1):
        for notice in notices:
            varied(words(notice), k, f, VARIATIONS)
            f += 1
    for i, sentence in enumerate(OTHER_SENSES):
        varied(words(sentence), 0, i, 5)
    vocabulary = sorted({w for ts in TEMPLATES.values() for t in ts for w in words(t)})
    for i in range(SCRAMBLED):
        picked = [vocabulary[j] for j in rng.integers(0, len(vocabulary), int(rng.integers(1, 13)))]
        mixed = picked + [str(filler[j]) for j in rng.integers(0, len(filler), int(rng.integers(0, 13)))]
        add([mixed[j] for j in rng.permutation(len(mixed))], 0, i)
    for i, tokens in enumerate(plain):
        add(tokens, 0, i)
    add([], 0, 0)
    return rows, np.array(label), np.array(fold)


def _anchors(background: list[str]) -> set[str]:
    """The templates' words that at most a share COMMON of the background holds."""
    held = Counter(w for p in background for w in set(words(p)))
    candidates = {w for ts in TEMPLATES.values() for t in ts for w in words(t) if len(w) > 2 or any(map(str.isdigit, w))}
    return {w for w in candidates if held[w] <= COMMON * max(len(background), 50)}


def _regression(rows: list[list[int]], y: np.ndarray, anchors: set[str]) -> Classifier:
    """Softmax regression by batch gradient steps; both sides of a class weigh alike."""
    families = list(TEMPLATES)
    known = sorted({h for r, k in zip(rows, y, strict=True) if k for h in r})
    place = {h: i for i, h in enumerate(known)}
    w = np.zeros((len(known), len(families) + 1), np.float32)
    b = np.zeros(len(families) + 1, np.float32)
    x = np.zeros((len(rows), len(known)), np.float32)
    for i, row in enumerate(rows):
        for h in row:
            if h in place:
                x[i, place[h]] = 1 / np.sqrt(len(row))
    share = np.bincount(y, minlength=len(families) + 1)
    weight = ((1 / np.maximum(share, 1))[y] / (len(families) + 1)).astype(np.float32)
    target = np.eye(len(families) + 1, dtype=np.float32)[y]
    for _ in range(EPOCHS):
        e = x @ w + b
        e = np.exp(e - e.max(1, keepdims=True))
        d = (e / e.sum(1, keepdims=True) - target) * weight[:, None]
        w -= np.float32(RATE * 100) * (x.T @ d + np.float32(DECAY) * w)
        b -= np.float32(RATE) * d.sum(0)
    return Classifier(families, anchors, place, w, b)


def fit(background: list[str]) -> Classifier:
    """The classifier, its threshold calibrated on folds that their model has not seen."""
    anchors = _anchors(background)
    tokens, y, fold = _examples(background)
    rows = [features(t, anchors) for t in tokens]
    score = np.zeros(len(rows))
    for f in range(FOLDS):
        out = fold == f
        model = _regression([r for r, o in zip(rows, out, strict=True) if not o], y[~out], anchors)
        score[out] = model.probabilities([r for r, o in zip(rows, out, strict=True) if o])[:, 1:].max(1)
    unknown = np.array([k == 0 and len(r) > 0 for k, r in zip(y, rows, strict=True)])
    model = _regression(rows, y, anchors)
    nothing = float(model.probabilities([[]])[0, 1:].max())
    grid = np.arange(0.2, 1.0, 0.05)
    fine = [t for t in grid if (score[unknown] >= t).mean() <= FALSE_RATE and t > nothing]
    model.threshold = float(fine[0] if fine else grid[-1])
    return model


def background_paragraphs(docs: DataFrame, documents: int = BACKGROUND_DOCUMENTS, rows: int = BACKGROUND) -> list[str]:
    """A bounded, reproducible sample of distinct lines that hold no licence notice.

    It comes from whole texts of the documents whose ids hash lowest; lines above
    10,000 characters are not sampled. Lines with licence wording have a share of their
    own and come from all documents; those that a template matches are left out.
    """
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id")).limit(documents)
    split = lambda df: df.select(F.explode(F.split(whole_text(), "\n")).alias("line"))
    worded = F.col("line").rlike(WORDING)
    short = (F.char_length("line") <= 10_000) & (F.trim("line") != "")
    plain = split(docs.join(F.broadcast(ids), "doc_id")).filter(~worded & short)
    lines = [r["line"] for r in plain.distinct().orderBy(F.xxhash64("line")).limit(rows).collect()]
    near = split(docs.filter(whole_text().rlike(WORDING))).filter(worded & short)
    other = [r["line"] for r in near.distinct().orderBy(F.xxhash64("line")).limit(WORDED).collect()]
    return lines + [p for p in other if max(overlap(words(p), f)[0] for f in TEMPLATES) < MIN_OVERLAP / 2]


def _clusters(tokens: list[str], anchors: set[str], base: int) -> list[tuple[int, int]]:
    """Spans, from base on, in which anchors follow each other within GAP words."""
    out: list[tuple[int, int]] = []
    start = last = None
    for i in [*(i for i, w in enumerate(tokens) if w in anchors), None]:
        if last is not None and (i is None or i - last > GAP):
            a, b = max(start - GAP, 0), min(last + GAP + 1, len(tokens))
            stops = range(a, max(b - WINDOW // 2, a + 1), WINDOW // 2) if b - a > WINDOW else [a]
            out += [(base + s, base + min(s + WINDOW, b)) for s in stops]
            start = None
        if i is not None:
            start = i if start is None else start
            last = i
    return out


def paragraphs(lines: list[str], anchors: set[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """For each paragraph with an anchor: its tokens and their line numbers."""
    tokens: list[str] = []
    counts: list[tuple[int, int]] = []
    for k, line in enumerate([*lines, ""]):
        found = words(line)
        if found:
            tokens += found
            counts.append((k, len(found)))
            continue
        if not anchors.isdisjoint(tokens):
            yield tokens, np.repeat([c[0] for c in counts], [c[1] for c in counts])
        tokens, counts = [], []


def _index() -> tuple[list[tuple[str, int]], dict[tuple[str, str], list[tuple[int, list[int]]]]]:
    """Family and bigrams of each template, and where each bigram stands in which."""
    known, at = [], {}
    for family, texts in TEMPLATES.items():
        for text in texts:
            tokens = words(text)
            for offset, pair in enumerate(zip(tokens, tokens[1:], strict=False)):
                at.setdefault(pair, {}).setdefault(len(known), []).append(offset)
            known.append((family, max(len(bigrams(tokens)), 1)))
    return known, {pair: list(where.items()) for pair, where in at.items()}


KNOWN, INDEX = _index()


def aligned(tokens: list[str]) -> list[tuple[int, int, str, float, float]]:
    """(from, to, family, share, weight) of the stretches that run along a template.

    A stretch is bigrams of one template in the template's order, no more than GAP words
    apart or out of step; a bigram that goes back begins a new one, so said again is
    found again. share is that of the template's bigrams, or of its own if it has eight words
    or more, as a long template may be cut. The weight, by which stretches that overlap are
    chosen, is the shared bigrams times their share of the stretch's own: a stretch that leans
    over two notices weighs less than either.
    """
    going: dict[int, list[list[int]]] = {}  # by template: [last place, last offset, first place, bigrams]
    done: list[tuple[int, list[int]]] = []
    for i, pair in enumerate(zip(tokens, tokens[1:], strict=False)):
        for t, offsets in INDEX.get(pair, ()):
            chains = going.get(t, [])
            live = [c for c in chains if i - c[0] <= GAP + 1]
            done += [(t, c) for c in chains if i - c[0] > GAP + 1]
            steps = [(abs(i - c[0] - (o - c[1])), -c[0], k, o) for k, c in enumerate(live) for o in offsets if o > c[1]]
            if steps and min(steps)[0] <= GAP:
                _, _, k, o = min(steps)
                live[k] = [i, o, live[k][2], live[k][3] + 1]
            else:
                live += [[i, o, i, 1] for o in offsets]
            going[t] = live
    done += [(t, c) for t, chains in going.items() for c in chains]
    out = []
    for t, (last, _, first, held) in done:
        family, size = KNOWN[t]
        length = last + 2 - first
        share = max(held / size, held / (length - 1) if length >= 8 else 0.0)
        if share >= MIN_OVERLAP:
            out.append((first, last + 2, family, min(share, 1.0), share * held * held / (length - 1)))
    return out


class _Namer:
    """The likeliest family and its probability of a span; what repeats is looked up."""

    def __init__(self, model: Classifier) -> None:
        self.model, self.seen = model, {}

    def __call__(self, spans: list[list[str]]) -> list[tuple[str, float]]:
        keys = ["\0".join(s) for s in spans]
        new = {k: s for k, s in zip(keys, spans, strict=True) if k not in self.seen}
        if len(self.seen) + len(new) > SEEN:
            self.seen = {}
            new = dict(zip(keys, spans, strict=True))
        for start in range(0, len(new), 1024):
            part = dict(list(new.items())[start : start + 1024])
            rows = self.model.probabilities([features(s, self.model.anchors) for s in part.values()])[:, 1:]
            self.seen |= {k: (self.model.families[int(r.argmax())], float(r.max())) for k, r in zip(part, rows, strict=True)}
        return [self.seen[k] for k in keys]


def _rest(tokens: list[str], number: np.ndarray, covered: bytearray, anchors: set[str]) -> list[tuple[int, int]]:
    """Spans with anchors in what no notice covers: of each line and, where they reach over a line's end, joined."""
    starts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(tokens)]
    out, at = [], 0
    while (at := covered.find(0, at)) >= 0:
        end = covered.find(1, at)
        end = len(tokens) if end < 0 else end
        edges = [at, *starts[bisect.bisect_right(starts, at) : bisect.bisect_left(starts, end)], end]
        for a, b in zip(edges, edges[1:], strict=False):
            out += _clusters(tokens[a:b], anchors, a)
        if len(edges) > 2:
            out += [(a, b) for a, b in _clusters(tokens[at:end], anchors, at) if number[a] != number[b - 1]]
        at = end
    return out


class _Lines:
    """A text's lines, and the text of a stretch of words in them."""

    def __init__(self, text: str) -> None:
        self.lines, self.at = text.split("\n"), {}

    def ends(self, k: int, count: int) -> list[tuple[int, int]]:
        """Where the words of a line begin and end; the whole line for each if lower case has other words."""
        if k not in self.at:
            found = [m.span() for m in WORDS.finditer(self.lines[k])]
            self.at[k] = found if len(found) == count else [(0, len(self.lines[k]))] * count
        return self.at[k]

    def content(self, number: np.ndarray, a: int, b: int) -> str:
        """From the first letter of word a to the last of word b - 1."""
        out, (first, last) = [], (int(number[a]), int(number[b - 1]))
        for k in range(first, last + 1):
            i, j = np.searchsorted(number, [k, k + 1])
            ends = self.ends(k, int(j - i))
            start, end = ends[a - i][0] if k == first else 0, ends[b - 1 - i][1] if k == last else len(self.lines[k])
            out.append(self.lines[k][start:end])
        return "\n".join(out)


def notices(text: str, model: Classifier) -> list[tuple[int, int, str, float, float, bool, str]]:
    """(first line, last line, family, probability, overlap, confirmed, content) of each notice.

    First the stretches along a template whose words alone the classifier names as the
    template's family, the most shared words first; then, in what they leave, the spans that it names.
    """
    read, out = _Lines(text), []
    name = _Namer(model)
    for tokens, number in paragraphs(read.lines, model.anchors):
        covered, whose = bytearray(len(tokens)), bytearray(len(tokens))

        def take(hits: list[tuple]) -> None:
            for unsure, _, share, probability, a, b, family in sorted(hits):
                code = 1 + model.families.index(family)
                # what is named beside a confirmed notice of that family belongs to it
                part = unsure and code in whose[max(a - GAP, 0) : b + GAP]  # noqa: B023
                if covered.find(1, a, b) < 0 and not part:  # noqa: B023
                    covered[a:b] = b"\1" * (b - a)  # noqa: B023
                    if not unsure:
                        whose[a:b] = bytes([code]) * (b - a)  # noqa: B023
                    first, last = int(number[a]), int(number[b - 1])  # noqa: B023
                    out.append((a, (first, last, family, -probability, -share, not unsure, read.content(number, a, b))))  # noqa: B023

        runs = aligned(tokens)
        named = name([tokens[a:b] for a, b, *_ in runs])
        sure = [(run, p) for run, (best, p) in zip(runs, named, strict=True) if best == run[2] and p >= model.threshold]
        take([(False, -weight, -share, -p, a, b, family) for (a, b, family, share, weight), p in sure])
        rest = _rest(tokens, number, covered, model.anchors)
        hits = []
        for (a, b), (family, p) in zip(rest, name([tokens[a:b] for a, b in rest]), strict=True):
            if p >= model.threshold:
                share, first, last = overlap(tokens[a:b], family)
                sure = share >= MIN_OVERLAP
                if sure:
                    a, b = a + first, a + last
                hits.append((not sure, -share * (b - a), -share, -p, a, b, family))
        take(hits)
    return [n for _, n in sorted(out, key=lambda x: (x[1][0], x[0]))]


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """One row per licence notice: doc_id, paragraph (its first line), last_line, family,
    probability, overlap, confirmed, content (its own text, from its first word to its last)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of the templates only
    rows = docs.select("doc_id", whole_text().alias("text"))
    types = {"paragraph": pa.int32(), "last_line": pa.int32(), "family": pa.string(), "probability": pa.float64(), "overlap": pa.float64(), "confirmed": pa.bool_(), "content": pa.string()}
    spark_types = (T.IntegerType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType(), T.StringType())
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, t) for n, t in zip(types, spark_types, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [(i, *n) for i, text in enumerate(strings(part.column("text"))) for n in notices(text, shared.value)]
                columns = list(zip(*found, strict=True)) if found else [()] * 8
                ids = part.column("doc_id").take(pa.array(columns[0], pa.int64()))
                made = (pa.array(c, t) for c, t in zip(columns[1:], types.values(), strict=True))
                yield pa.RecordBatch.from_arrays([ids, *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def license_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(background_paragraphs(docs)))
    return found.select(
        "doc_id", "paragraph", "last_line", "family", "probability", "overlap", "confirmed", F.sha2("content", 256).alias("paragraph_sha256")
    )
