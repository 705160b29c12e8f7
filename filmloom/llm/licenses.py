"""License scans by patience alignment.

A template is aligned to a stretch of text on the words that occur once in
both: the longest increasing subsequence of their places stays, and the gaps
between are aligned again the same way. Coverage is the share of the
template's words that are matched.
"""

from __future__ import annotations

import string
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Short notices and opening passages of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

_PLAIN = bytes(ord(" ") if chr(i) in string.punctuation and chr(i) not in ".-" else i for i in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case without punctuation; dots and hyphens count inside a word only."""
    return [w for x in (text or "").encode().lower().translate(_PLAIN).split() if (w := x.strip(b".-"))]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by their first, whose second increase too."""
    tops, top_at, before = [], [], []
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        before.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = b, k
    out, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _once(words: list[bytes], first: int, end: int) -> dict[bytes, int]:
    """The place of each word in words[first:end], in order; -1 of those that occur again."""
    at: dict[bytes, int] = {}
    for k in range(first, end):
        w = words[k]
        at[w] = -1 if w in at else k
    return at


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        at_a, at_b = _once(a, a0, a1), _once(b, b0, b1)
        anchors = increasing([(k, at_b[w]) for w, k in at_a.items() if k >= 0 and at_b.get(w, -1) >= 0])
        if anchors:
            out += anchors
            ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(out)


@dataclass(frozen=True)
class Template:
    name: str
    words: list[bytes]
    seeds: dict[bytes, int] = field(default_factory=dict)
    counts: Counter = field(default_factory=Counter)


@dataclass(frozen=True)
class Notice:
    cover: float
    size: int
    name: str
    first: int
    end: int


class Spans:
    """Places [first, end), merged where they overlap, so that looking one up is a search."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.firsts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.firsts.append(a)
                self.ends.append(b)

    def holds(self, k: int) -> bool:
        i = bisect_right(self.firsts, k) - 1
        return i >= 0 and k < self.ends[i]


class Apart:
    """Spans that don't overlap, in order; one is added only if it is apart from all others."""

    def __init__(self):
        self.firsts: list[int] = []
        self.ends: list[int] = []

    def add(self, first: int, end: int) -> bool:
        i = bisect_right(self.firsts, first)
        if (i and self.ends[i - 1] > first) or (i < len(self.firsts) and self.firsts[i] < end):
            return False
        self.firsts.insert(i, first)
        self.ends.insert(i, end)
        return True


#: In templates of fewer words, inserted text longer than the template ends a notice, for their words meet by chance.
SHORT = 20


def templates(texts: dict[str, str]) -> list[Template]:
    """Templates with the places of all words that they hold once."""
    out = []
    for name, text in texts.items():
        words = tokens(text)
        counts = Counter(words)
        out.append(Template(name, words, {w: k for k, w in enumerate(words) if counts[w] == 1}, counts))
    return out


def vocabulary_of(known: list[Template]) -> set[bytes]:
    return {w for t in known for w in t.words}


def _chained(words: list[bytes], t: Template, chain: list[tuple[int, int]]) -> Notice:
    """The notice on a chain of (place in words, place in template), the gaps between aligned."""
    slack = len(t.words) // 4 + 2
    (i, j), (k, m) = chain[0], chain[-1]
    ends = [(max(-1, i - j - slack), -1), *chain, (min(len(words), k + len(t.words) - m + slack), len(t.words))]
    found = list(chain)
    for (i, j), (k, m) in zip(ends, ends[1:]):
        if m > j + 1 and k > i + 1:
            found += [(i + 1 + x, j + 1 + y) for x, y in align(words[i + 1 : k], t.words[j + 1 : m])]
    places = [x for x, _ in found]
    return Notice(len(found) / len(t.words), len(t.words), t.name, min(places), max(places) + 1)


def _bounded(words: list[bytes], t: Template, places: list[int], starts: set[int], length: int):
    """(bound, i, j) of the stretches places[i:j] that begin at ``starts``: the template's words that they hold, so what they can match at most.

    One window moves over the text, so a word is counted in and out once,
    however many stretches there are.
    """
    held, need, bound, a, b, out = dict.fromkeys(t.counts, 0), t.counts, 0, 0, 0, {}
    for s in sorted(starts):
        i, j = bisect_left(places, s), bisect_left(places, s + length)
        if (i, j) in out:
            continue
        while b < j:
            w = words[places[b]]
            bound += held[w] < need[w]
            held[w] += 1
            b += 1
        while a < i:
            w = words[places[a]]
            held[w] -= 1
            bound -= held[w] < need[w]
            a += 1
        out[i, j] = bound
    return [(n, i, j) for (i, j), n in out.items()]


def _within(spans: Apart, first: int, end: int) -> bool:
    i = bisect_left(spans.firsts, first)
    return i < len(spans.firsts) and spans.ends[i] <= end


def _chains(words: list[bytes], t: Template, hits: list[tuple[int, int]], own: list[Notice], least: float) -> list[Notice]:
    """Notices on the longest chains of the template's single words, whatever lies between, as long as chains reach the bound."""
    found: list[Notice] = []
    while hits:
        taken = Spans([(n.first, n.end) for n in [*own, *found] if n.cover >= least])
        hits = [(k, j) for k, j in hits if not taken.holds(k)]
        parts: list[list[tuple[int, int]]] = [[]]
        for k, j in hits:
            if parts[-1] and len(t.words) < SHORT and k - parts[-1][-1][0] > len(t.words):
                parts.append([])
            parts[-1].append((k, j))
        chained = [_chained(words, t, increasing(x)) for x in parts if len(x) > 1]
        found += chained
        if not any(n.cover >= least for n in chained):
            break
    return found


def scan(words: list[bytes], known: list[Template], least: float, vocabulary: set[bytes] | None = None) -> tuple[Notice | None, list[Notice]]:
    """The notice that covers best (the longer template wins a tie) and all that reach ``least``.

    A stretch as long as the template and half as much again is tried around
    every place of every word that the template holds once, so one notice of
    several is aligned alone. Stretches of all templates are tried in the order
    of how many of the template's words they hold, which bounds what they can
    cover, down to what the best one covers. Then the longest chains of such
    words are tried, whatever text lies between. Notices of one template do not overlap.
    """
    vocabulary = vocabulary_of(known) if vocabulary is None else vocabulary
    among = [k for k, w in enumerate(words) if w in vocabulary]
    at: dict[bytes, list[int]] = {}
    for k in among:
        at.setdefault(words[k], []).append(k)
    tried, places, owned = [], [], [[] for _ in known]
    for index, t in enumerate(known):
        slack = len(t.words) // 4 + 2
        starts = {k - j - slack for w, j in t.seeds.items() if w in at for k in at[w]}
        places.append([k for k in among if words[k] in t.counts] if starts else [])
        for bound, i, j in _bounded(words, t, places[-1], starts, len(t.words) + 2 * slack):
            tried.append((-bound / len(t.words), -len(t.words), index, i, j))
    tried.sort()
    best, solid = None, [Apart() for _ in known]
    for ratio, size, index, i, j in tried:
        if -ratio < least and best is not None and (-ratio, -size) <= (best.cover, best.size):
            break
        # other words than the template's never match
        t, where = known[index], places[index]
        # a whole notice without a gap is as good and as short as any of its stretch, which has no room for another
        if j > i and _within(solid[index], where[i], where[j - 1] + 1):
            continue
        found = align([words[k] for k in where[i:j]], t.words)
        if found:
            notice = Notice(len(found) / len(t.words), len(t.words), t.name, where[i + found[0][0]], where[i + found[-1][0]] + 1)
            owned[index].append(notice)
            if len(found) == len(t.words) == notice.end - notice.first:
                solid[index].add(notice.first, notice.end)
            if best is None or (notice.cover, notice.size) > (best.cover, best.size):
                best = notice
    reached: list[Notice] = []
    for t, own in zip(known, owned):
        if sum([min(n, len(at[w])) for w, n in t.counts.items() if w in at]) < least * len(t.words):
            continue
        more = _chains(words, t, sorted([(k, j) for w, j in t.seeds.items() if w in at for k in at[w]]), own, least)
        for notice in more:
            if best is None or (notice.cover, notice.size) > (best.cover, best.size):
                best = notice
        apart = Apart()
        good = sorted((n for n in [*own, *more] if n.cover >= least), key=lambda n: (-n.cover, n.end - n.first, n.first))
        reached += [n for n in good if apart.add(n.first, n.end)]
    return best, sorted(reached, key=lambda n: (n.first, n.end, n.name))


def license_scan(docs: DataFrame, texts: dict[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, n_words, license, coverage, first_word, end_word, notices of every row.

    ``notices`` are all that reach ``least`` (license, coverage, first_word,
    end_word), in the order of the text; the other columns have the best.
    license is null and the words -1 where no template reaches ``least``; the
    best coverage is given all the same. Of notices with equal coverage the
    longer template's is best, then the one that is found first. Null and blank texts have coverage 0;
    repeated rows are scanned each; whole texts are scanned, whatever their length.
    """
    known = templates(texts)
    vocabulary = vocabulary_of(known)
    item = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = tokens(text)
                best, reached = scan(words, known, least, vocabulary)
                cover = best.cover if best else 0.0
                name, first, end = (best.name, best.first, best.end) if cover >= least else (None, -1, -1)
                notices = [{"license": n.name, "coverage": round(n.cover, 6), "first_word": n.first, "end_word": n.end} for n in reached]
                rows.append((len(words), name, cover, first, end, notices))
            n, name, cover, first, end, notices = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(name, pa.string()),
                    pa.array([round(c, 6) for c in cover], pa.float64()),
                    pa.array(first, pa.int64()),
                    pa.array(end, pa.int64()),
                    pa.array(notices, item),
                ],
                ["doc_id", "n_words", "license", "coverage", "first_word", "end_word", "notices"],
            )

    common.small_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, license string, coverage double, first_word long, end_word long, notices array<struct<license:string,coverage:double,first_word:bigint,end_word:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def query(spark, sf_dir) -> DataFrame:
    return license_scan(common.table(spark, sf_dir, "documents"))
