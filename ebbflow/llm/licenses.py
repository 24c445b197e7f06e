"""License scan: MinHash bands over overlapping windows, then exact containment.

A text has a license if a stretch of it holds CONTAINED or more of the distinct
five-word shingles of one of its templates.  A stretch reaches over at most
REACH times as many shingles as the template has, so copies with words inserted,
left out or replaced are found, and fragments scattered over a text are not.
(Where all shingles are needed, nothing can stand between them, and a stretch
is as long as the template.)

Windows overlap so that every such stretch lies in one whole.  A window and a
template are compared if one of BANDS bands of ROWS MinHash values is the same
on both; a window around a copy has a similarity of ``least_similarity`` or more
and is met with the probability ``collision_probability``, over 0.999 for each
template.  A value can only be the same if the template's own shingle of that
value stands in the window, so signatures are made of windows with a template's
shingle.  What the bands retrieve is verified exactly.
"""

from __future__ import annotations

import math
from bisect import bisect
from collections import Counter, defaultdict, deque
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import LETTERS, U, mix, portions, shingle_hashes, word_hashes

SHINGLE, CONTAINED, REACH = 5, 0.8, 2.0
BANDS, ROWS = 64, 2
#: One hash function each: a bijection of shingle hashes.
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
#: License notices (fixed values).
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation, either version 3 of the License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",)}

def _shingles(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return shingle_hashes(word_hashes(raw, np.array([0, len(raw)]), LETTERS)[0], SHINGLE)


def needed(n: int) -> int:
    """Shingles of a template of n that a copy holds."""
    return math.ceil(CONTAINED * n - 1e-9)


def reach(n: int) -> int:
    """Shingles that a copy stretches over at most."""
    return n if needed(n) == n else math.ceil(REACH * n)


def grid(n: int) -> tuple[int, int]:
    """(shingles of a window, step between windows): any stretch lies in one window."""
    step = max(1, n // 4)
    return reach(n) + step - 1, step


def least_similarity(n: int) -> float:
    """Jaccard similarity of the template and a window around a copy."""
    return needed(n) / (grid(n)[0] + n - needed(n))


def collision_probability(n: int) -> float:
    return 1 - (1 - least_similarity(n) ** ROWS) ** BANDS


def _signature(shingles: np.ndarray) -> np.ndarray:
    return mix(shingles[None, :] ^ _SEEDS[:, None]).min(axis=1)


class Scanner:
    """Templates, their signatures, and the table of their shingles."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]] = TEMPLATES):
        self.names, self.sizes, self.signatures, users = [], [], [], defaultdict(list)
        for name, texts in templates.items():
            for text in texts:
                s = np.unique(_shingles(text))
                if not len(s):
                    raise ValueError(f"a template of {name} has fewer than {SHINGLE} words")
                for x in s:
                    users[x].append(len(self.names))
                self.names.append(name)
                self.sizes.append(len(s))
                self.signatures.append(_signature(s))
        self.table = np.array(sorted(users), U)
        self.users = [users[x] for x in self.table]     # the templates of each shingle
        self.top = np.zeros(1 << 16, bool)              # of the shingles' top bits
        self.top[(self.table >> U(48)).astype(np.int64)] = True

    def held(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the shingles that a template has, and their numbers in the table."""
        at = np.flatnonzero(self.top[(shingles >> U(48)).astype(np.int64)])
        number = np.searchsorted(self.table, shingles[at])
        there = number < len(self.table)
        there[there] = self.table[number[there]] == shingles[at[there]]
        return at[there], number[there]

    def retrieved(self, t: int, shingles: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs (first shingle, end) of overlapping windows that agree with the
        template in a band.  ``shingles`` are a text's, ``places`` those in it
        of the template's own: other windows cannot agree."""
        size, step = grid(self.sizes[t])
        first = np.maximum(0, -(-(places - size + 1) // step))
        steps = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, places // step)]))
        for some in np.split(steps, range(512, len(steps), 512)):
            starts = some * step
            ends = np.minimum(starts + size, len(shingles))
            at = np.minimum(starts[:, None] + np.arange(size), ends[:, None] - 1)
            values = np.stack([mix(shingles[at] ^ seed).min(axis=1) for seed in _SEEDS], axis=1)
            same = (values == self.signatures[t]).reshape(len(some), BANDS, ROWS)
            hit = np.flatnonzero(same.all(axis=2).any(axis=1))
            if len(hit):
                apart = np.flatnonzero(starts[hit][1:] > ends[hit][:-1]) + 1
                for run in np.split(hit, apart):
                    yield int(starts[run[0]]), int(ends[run[-1]])

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[str, int, int, float]]]]:
        """(row, [(license, begin, end, containment)]) of rows with a match;
        begin and end are code points of the words' bounds."""
        for row, _, data, offsets in portions(texts):
            words, start, doc = word_hashes(data, offsets, LETTERS)
            shingles = shingle_hashes(words, SHINGLE)
            at, number = self.held(shingles)
            inside = doc[at] == doc[at + SHINGLE - 1]       # none spans two texts
            held = defaultdict(lambda: defaultdict(list))
            for i, x in zip(at[inside].tolist(), number[inside].tolist()):
                for t in self.users[x]:
                    held[int(doc[i])][t].append((i, x))
            for d in sorted(held):
                base, text_end, found = int(offsets[d]), int(offsets[d + 1]), defaultdict(list)
                low, high = np.searchsorted(doc, [d, d + 1])    # the text's words
                own = shingles[low:max(low, high - SHINGLE + 1)]
                for t, places in held[d].items():
                    where = np.array([i for i, _ in places])
                    for begin, end in self.retrieved(t, own, where - low):
                        a, b = np.searchsorted(where, [begin + low, end + low])
                        found[self.names[t]] += _apart(_copies(places[a:b], self.sizes[t]), 1)
                out = []
                for name, copies in found.items():
                    for i, last, share in _apart(copies):
                        k = last + SHINGLE - 1              # last word of the copy
                        end = int(start[k + 1]) if k + 1 < len(start) and doc[k + 1] == d else text_end
                        while end > start[k] and not LETTERS[data[end - 1]]:
                            end -= 1
                        begin = len(bytes(data[base:int(start[i])]).decode("utf-8", "replace"))
                        out.append((name, begin, begin + len(bytes(data[int(start[i]):end]).decode("utf-8", "replace")), float(share)))
                if out:
                    yield row + d, sorted(out, key=lambda x: (x[1], x[2], x[0]))


def _copies(places: list[tuple[int, int]], size: int) -> list[tuple[int, int, float]]:
    """(first shingle, last shingle, containment) of the stretches that hold
    enough of a template of ``size`` shingles, from the places of its shingles
    in order: for each last shingle the shortest stretch that holds as many."""
    out, run, count = [], deque(), Counter()
    for i, x in places:
        run.append((i, x))
        count[x] += 1
        while i - run[0][0] >= reach(size) or count[run[0][1]] > 1:
            first = run.popleft()[1]
            count[first] -= 1
            if not count[first]:
                del count[first]
        if len(count) >= needed(size):
            out.append((run[0][0], i, len(count) / size))
    return out


def _apart(copies: list[tuple[int, int, float]], sign: int = -1) -> list[tuple[int, int, float]]:
    """Of copies of one license that overlap the fullest, of equals the longest
    (with sign 1 the shortest) and then the first."""
    out: list[tuple[int, int, float]] = []              # by place, none overlaps another
    for c in sorted(copies, key=lambda c: (-c[2], sign * (c[1] - c[0]), c[0])):
        k = bisect(out, c)
        if (k == 0 or out[k - 1][1] < c[0]) and (k == len(out) or c[1] < out[k][0]):
            out.insert(k, c)
    return out


def matches(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """``doc_id``, ``hits`` (array of license, begin, end, containment) of every
    row.  Null and empty texts have none; repeated rows repeat; an empty table
    gives an empty result; texts of any length are read whole, in portions of
    whole texts.  Only the columns doc_id and text are read, whatever others
    are called."""
    kind = docs.schema["doc_id"].dataType
    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            found = dict(scanner.scan(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(
                [[dict(zip(("license", "begin", "end", "containment"), h)) for h in found.get(i, [])] for i in range(batch.num_rows)],
                pa.list_(pa.struct([("license", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])))],
                ["doc_id", "hits"])
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind.simpleString()}, hits array<struct<license:string,begin:bigint,end:bigint,containment:double>>")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``licenses`` (names, sorted, comma-joined; empty without
    any), ``n_places``, ``spans`` (license:begin:end, comma-joined) per row."""
    found = matches(docs)
    return found.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ",").alias("licenses"),
                        F.size("hits").cast("long").alias("n_places"),
                        F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["license"], h["begin"].cast("string"), h["end"].cast("string"))), ",").alias("spans"))
