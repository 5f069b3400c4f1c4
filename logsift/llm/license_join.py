"""License scan by an exact set-similarity join of text blocks with license templates.

A block of a template is a window of consecutive words, half as long again as the template.  A
block matches if it holds at least ``threshold`` of the template's distinct words.  All windows
are searched, by exact filters only:

* prefix: words are ordered by their count over all documents, rare ones first.  A block with
  o = ceil(threshold * m) of a template's m words holds one of its first m - o + 1, so only
  windows around those words are looked at;
* position: if the first word in that order that a block shares is the i-th, at most m - i more can be shared,
  also at most as many as the block has template words from there on;
* length: a text of fewer than o words has no such block.

Windows that pass count their shared words exactly.  Of matching windows that overlap the best one gives a
place, trimmed to its template words; the search goes on before and behind it, so a notice that a text repeats a
thousand times has a thousand places, and every matching window overlaps one.

Beside the join, phrases are found as consecutive words.  Words are what a pattern on the
lower-cased (A-Z) text gives; see ``WORD``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: On UTF-8 bytes: runs of digits, a-z (A-Z before lower-casing) and bytes of other characters.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
THRESHOLD = 0.9
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Wordings of public licences and notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
            "to deal in the Software without restriction"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
            "as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
MAX_TEMPLATE_WORDS = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass
class Template:
    label: str
    #: distinct words, rarest in the corpus first
    words: list[bytes]
    length: int
    need: int

    @property
    def prefix(self) -> list[bytes]:
        return self.words[:len(self.words) - self.need + 1]

    @property
    def window(self) -> int:
        return math.ceil(1.5 * self.length)


def ordered_templates(templates, counts: dict[bytes, int], threshold: float) -> list[Template]:
    out = []
    for label, text in templates:
        words = words_of(text)
        distinct = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
        if distinct:
            out.append(Template(label, distinct, len(words), math.ceil(threshold * len(distinct) - 1e-9)))
    return out


def template_word_counts(docs: DataFrame, templates) -> dict[bytes, int]:
    """How often each template word occurs over all documents (one row per template word)."""
    wanted = sorted({w for _, t in templates for w in words_of(t)})
    if len(wanted) > MAX_TEMPLATE_WORDS:
        raise ValueError("template words must fit in every task; scan in several calls")
    place = {w: i for i, w in enumerate(wanted)}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(len(wanted), np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                for t in batch.column("text").to_pylist():
                    for w in filter(place.__contains__, words_of(t)):
                        total[place[w]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "n"])

    got = docs.select("text").mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return {wanted[r["i"]]: r["n"] for r in got}


class Scanner:
    """Places of phrases and template matches in one text."""

    def __init__(self, templates: list[Template], phrases):
        self.templates = templates
        self.by_prefix: dict[bytes, list[int]] = {}
        for k, t in enumerate(templates):
            for w in t.prefix:
                self.by_prefix.setdefault(w, []).append(k)
        self.ranks = [{w: i for i, w in enumerate(t.words)} for t in templates]
        self.phrases = [(words_of(p), label) for p, label in phrases]
        self.heads: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for p, label in self.phrases:
            self.heads.setdefault(p[0], []).append((p, label))
        self.seen = self.by_prefix.keys() | self.heads.keys()

    def scan(self, words: list[bytes]) -> list[tuple[str, str, int, int, float]]:
        """(kind, label, first word, end, score), base places first."""
        hits = [i for i, w in enumerate(words) if w in self.seen]
        if not hits:
            return []
        out, by_template = [], {}
        for i in hits:
            for p, label in self.heads.get(words[i], ()):
                if words[i:i + len(p)] == p:
                    out.append(("base", label, i, i + len(p), 1.0))
            for k in self.by_prefix.get(words[i], ()):
                by_template.setdefault(k, []).append(i)
        for k, at in sorted(by_template.items()):
            out += self._matches(words, k, at)
        return out

    def _matches(self, words: list[bytes], k: int, at: list[int]) -> Iterator:
        t, rank, n = self.templates[k], self.ranks[k], len(words)
        if n < t.need:
            return
        size, pos = min(t.window, n), 0
        while pos < len(at):  # a stretch: windows around prefix words that touch
            lo, hi = max(0, at[pos] - size + 1), min(n, at[pos] + size)
            pos += 1
            while pos < len(at) and at[pos] - size + 1 <= hi:
                hi = min(n, at[pos] + size)
                pos += 1
            yield from self._stretch(words, t, rank, lo, hi, size)

    def _stretch(self, words, t: Template, rank, lo: int, hi: int, size: int) -> Iterator:
        """Disjoint places in words[lo:hi]: of matching windows that overlap the best one gives a place, and what
        lies before and behind that place is searched for further ones."""
        ranks = [rank.get(w, -1) for w in words[lo:hi]]
        size = min(size, len(ranks))
        inside: dict[int, int] = {}
        best, done = None, 0  # best: (shared, first word, end); words before ``done`` are settled
        for end, r in enumerate(ranks, 1):
            if r >= 0:
                inside[r] = inside.get(r, 0) + 1
            start = end - size
            if start > 0 and (old := ranks[start - 1]) >= 0:
                inside[old] -= 1
                if not inside[old]:
                    del inside[old]
            if start < 0 or len(inside) < t.need:  # also the bound by the block's own words
                continue
            if min(inside) > len(t.words) - t.need:  # position filter: too few words left in the order
                continue
            if best is not None and start >= best[2]:
                yield from self._settle(words, t, rank, lo, done, best, size)
                best, done = None, best[2]
            if best is None or len(inside) > best[0]:
                best = (len(inside), *self._span(t, ranks, max(start, done), end, len(inside)))
        if best is not None:
            yield from self._settle(words, t, rank, lo, done, best, size)
            if t.need <= len(ranks) - best[2] < size:  # no whole window fits behind the last place
                yield from self._stretch(words, t, rank, lo + best[2], hi, size)

    def _settle(self, words, t: Template, rank, lo: int, done: int, best, size: int) -> Iterator:
        """The place of the best window, after those before it that it doesn't overlap."""
        if best[1] - done >= t.need:
            yield from self._stretch(words, t, rank, lo + done, lo + best[1], size)
        yield "template", t.label, lo + best[1], lo + best[2], best[0] / len(t.words)

    @staticmethod
    def _span(t: Template, ranks, start: int, end: int, shared: int) -> tuple[int, int]:
        """The shortest block in a window that ends first and holds all its template words, with the template words
        right before and behind it that the template's length leaves room for."""
        def reach(places):  # where all shared words have been met
            seen: set[int] = set()
            for i in places:
                if ranks[i] >= 0:
                    seen.add(ranks[i])
                    if len(seen) == shared:
                        return i

        stop = reach(range(start, end)) + 1
        first = reach(range(stop - 1, start - 1, -1))
        while first > start and ranks[first - 1] >= 0 and stop - first < t.length:
            first -= 1
        while stop < end and ranks[stop] >= 0 and stop - first < t.length:
            stop += 1
        return first, stop


PLACES = "array<struct<kind:string,label:string,start:bigint,end:bigint,score:double>>"


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, places (kind base or template, label, word range, score).

    Needs columns doc_id and text; others are ignored.  Null text is empty and has no places.  Overlapping
    places are all reported.  Repeated rows give repeated results; an empty table gives an empty result.  The
    templates travel to the tasks, so their number of words is bounded by ``MAX_TEMPLATE_WORDS``."""
    ordered = ordered_templates(templates, template_word_counts(docs, templates), threshold)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scanner = Scanner(ordered, phrases)
        shape = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        names = ("kind", "label", "start", "end", "score")
        for whole in batches:
            for batch in slices(whole, "text"):
                n, places = [], []
                for t in batch.column("text").to_pylist():
                    words = words_of(t)
                    n.append(len(words))
                    places.append([dict(zip(names, p, strict=True)) for p in scanner.scan(words)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, shape)], ["doc_id", "n_words", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, places {PLACES}")
