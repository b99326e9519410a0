"""License scan (operator 8): winnowed template fingerprints, then banded alignment.

Templates are cut into words; the hashes of their k-word runs are winnowed (the
least of every ``window`` consecutive ones) into an inverted index from
fingerprint to (template, place). What is looked up follows from the coverage
that is promised: a notice may lack ``e`` of the n words of its template and hold
``gap`` words more, so its matched words lie in at most e + gap + 1 runs. If the
longest of them must have k + window - 1 words, the winnowed runs find it; if k,
all runs of the template do; a shorter template is looked up by single words, its
identifying ones or else e + 1 of its rarest, one of which must be there.
Hits of a template on nearby diagonals become one candidate, which is aligned with
the template within a band of e + gap, for the most matched words and then the fewest
edits; matched words over template words is the coverage, the outermost matched words give the span. Words that tell
a licence from its relatives (``IDENTIFY``) must be among them.

Words are runs of letters and digits (any character beyond ASCII counts as a
letter), A-Z lower-cased: marks between words don't matter. A row is scanned by
itself: no shuffle. The templates are a parameter, not data.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import in_batches, lean, slices
from tessera.llm.words import LOWER, ngrams, words_of

MARKS = bytes(c for c in range(128) if not chr(c).isalnum())

#: Notices to look for.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
           "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
           "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
           "subject to the following conditions",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                         "except in compliance with the License. You may obtain a copy of the License at",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
}
#: Words without which a notice is of another licence, or of none.
IDENTIFY = {
    "all-rights-reserved": ("reserved",),
    "mit-notice": ("mit",),
    "apache-2.0-notice": ("apache",),
    "gpl-3.0-notice": ("gnu",),
    "cc-by-nc-4.0-notice": ("nc", "cc"),
}
#: Words that a notice may hold beyond its template's, at least (a tenth of long ones).
GAP = 3


def winnow(h: np.ndarray, window: int) -> list[int]:
    """Places of the least (rightmost of equals) of every ``window`` consecutive hashes."""
    places = []
    for i in range(max(1, len(h) - window + 1)):
        part = h[i:i + window]
        if len(part):
            j = i + len(part) - 1 - int(np.argmin(part[::-1]))
            if not places or places[-1] != j:
                places.append(j)
    return places


def align(template: list[int], words: list[int], shift: int, band: int) -> tuple[int, int, int]:
    """Best alignment of the whole template within ``words`` (free ends there), on
    the diagonals within ``band`` of ``shift``: the most matched words, and among
    those the fewest edits. Returns (matched words, first and last matched place in
    ``words``); (0, -1, -1) without a match."""
    width = 2 * band + 1
    # row i, cell b: template[:i] against words up to j = i + shift - band + b, as (-matched, edits, first, last)
    row = [(0, 0, -1, -1)] * width
    for i, t in enumerate(template, 1):
        new: list[tuple[int, int, int, int]] = []
        for b in range(width):
            j = i + shift - band + b
            neg, d, first, last = row[b]
            inside = 0 < j <= len(words)
            if inside and words[j - 1] == t:
                best = (neg - 1, d, j - 1 if first < 0 else first, j - 1)
            else:
                best = (neg, d + 1, first, last)
            if b + 1 < width:                                  # a template word left out
                neg, d, first, last = row[b + 1]
                best = min(best, (neg, d + 1, first, last))
            if b and inside:                                   # a word of the text left out, for nothing before the first match
                neg, d, first, last = new[b - 1]
                best = min(best, (neg, d + (first >= 0), first, last))
            new.append(best)
        row = new
    neg, _, first, last = min(row)
    return -neg, first, last


def words_in(text: str) -> list[str]:
    """The words of a text, as they are told apart here."""
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text).split()


def _hashed(text: str) -> list[int]:
    return words_of([text.encode().translate(LOWER)], MARKS)[0].tolist()


class Index:
    """Inverted index over the fingerprints of the templates."""

    def __init__(self, templates: Mapping[str, str], k: int, window: int, least: float = 0.8,
                 identify: Mapping[str, tuple[str, ...]] = IDENTIFY):
        self.k, self.least = k, least
        self.names = list(templates)
        self.words = [_hashed(t) for t in templates.values()]
        self.needs = [[_hashed(w)[0] for w in identify.get(name, ())] for name in self.names]
        self.bands = []
        runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        single: dict[int, list[tuple[int, int]]] = defaultdict(list)
        common = Counter(w for t in self.words for w in set(t))
        for i, (h, text) in enumerate(zip(self.words, templates.values(), strict=True)):
            if not h or not set(self.needs[i]) <= set(h):
                raise ValueError(f"a template needs words, its identifying ones among them: {text!r}")
            lacking, gap = len(h) - math.ceil(least * len(h) - 1e-9), max(GAP, len(h) // 10)
            self.bands.append(lacking + gap)
            longest = -(-(len(h) - lacking) // (lacking + gap + 1))      # of the runs of matched words
            if longest >= k:
                g = ngrams(np.array(h, np.uint64), k)
                for j in winnow(g, window if longest >= k + window - 1 else 1):
                    runs[int(g[j])].append((i, j))
                continue
            spelled = words_in(text)
            rare = sorted(range(len(h)), key=lambda j: (common[h[j]], h.count(h[j]), -len(spelled[j]), j))
            chosen = self.needs[i][:1] or [h[j] for j in rare[:lacking + 1]]
            for j, w in enumerate(h):
                if w in chosen:
                    single[w].append((i, j))
        self.tables = [(size, dict(at), np.array(sorted(at), np.uint64)) for size, at in ((k, runs), (1, single)) if at]

    def scan(self, texts: list[str], least: float | None = None) -> Iterator[tuple[int, str, float, int, int, int]]:
        """(text number, template, coverage, start, end, matched words), code points, end exclusive."""
        least = self.least if least is None else max(least, self.least)
        raw = [t.encode("utf-8", "replace").translate(LOWER) for t in texts]
        h, doc, starts, ends = words_of(raw, MARKS)
        groups: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for size, at, prints in self.tables:
            g = ngrams(h, size) if size > 1 else h
            if not len(g):
                continue
            near = np.minimum(np.searchsorted(prints, g), len(prints) - 1)
            for p in np.flatnonzero((prints[near] == g) & (doc[: len(g)] == doc[size - 1:])).tolist():
                for i, j in at[int(g[p])]:
                    groups[(int(doc[p]), i)].append((p - j, p))
        offsets = np.cumsum([0] + [len(t) + 1 for t in raw])
        for (d, i), hits in sorted(groups.items()):
            template, n, band = self.words[i], len(self.words[i]), self.bands[i]
            lo, hi = np.searchsorted(doc, [d, d + 1])
            tried, done = None, int(lo)                  # the last diagonal that led nowhere, the end of the last notice
            for diagonal, p in sorted(set(hits), key=lambda x: x[1]):
                if p < done or diagonal == tried:
                    continue
                a, b = max(done, diagonal - band), min(int(hi), diagonal + n + band)
                matched, first, last = align(template, h[a:b].tolist(), diagonal - a, band)
                if matched < least * n - 1e-9 or not set(self.needs[i]) <= set(h[a + first:a + last + 1].tolist()):
                    tried = diagonal
                    continue
                done = a + last + 1
                s, e = int(starts[a + first] - offsets[d]), int(ends[a + last] - offsets[d])
                start = len(raw[d][:s].decode("utf-8", "replace"))
                yield d, self.names[i], matched / n, start, start + len(raw[d][s:e].decode("utf-8", "replace")), matched


def find_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  templates: Mapping[str, str] = TEMPLATES, coverage: float = 0.8, k: int = 3, window: int = 2,
                  identify: Mapping[str, tuple[str, ...]] = IDENTIFY) -> DataFrame:
    """One row per notice found: doc_id, license, coverage, span_start, span_end,
    matched_words. A text may hold several notices, and one more than once; where
    a short template is part of a longer one, both are reported. NULL and empty
    texts have none; repeated rows are reported each."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, k, window, coverage, identify)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for a, b in slices(texts):
                rows += [(a + d, *rest) for d, *rest in index.scan(texts[a:b])]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.float64()), *(pa.array(c, pa.int64()) for c in cols[3:])],
                names=["doc_id", "license", "coverage", "span_start", "span_end", "matched_words"])

    return (in_batches(docs).selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
                .mapInArrow(lean(run), f"doc_id {kind}, license string, coverage double, span_start long, span_end long, matched_words long"))
