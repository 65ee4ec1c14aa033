"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

1. Texts and templates become word shingles. For a template of m shingles a text is read in windows of 2m shingles that start
   every m shingles, so any stretch of m lies in one window. The least value of each of BANDS hash functions over a window
   comes from the least values of its two halves.
2. A window that holds 4/5 of the template has Jaccard similarity 0.8 m / 2.2 m = 0.36 or more with it; with BANDS bands of
   one value each, the chance that no band collides is 0.64**BANDS = 0.00002 or less.
3. A collision is verified on the window's shingles: containment is the share of the template's shingles it holds.

The templates are a parameter (they go to every task, so their number is what a list of licences is); each task reads its
whole texts, nothing is shuffled.

Defined results: null and empty texts match nothing; a text with fewer words than a shingle, or a template with fewer, is
one shingle of its whole sequence; of several windows with equal containment the first is given; repeated rows are
reported once each; rows without an id have a null id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factorseg.llm import words

BANDS = 24
SEEDS = words.mixed(np.arange(101, 101 + BANDS, dtype=np.uint64) * words.BASE) | np.uint64(1)

# fixed values: opening sentences of public licence notices
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                      "that the following conditions are met:",
}


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = 5, containment: tuple[int, int] = (4, 5),
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, n_shared, n_template, first_word, last_word, start, end): each template a text contains, at its best
    window; words count from 0, ``start`` and ``end`` are code points of the text."""
    num, den = containment
    known: dict[int, list] = {}
    for name in sorted(templates):
        values, _ = words.shingles(pa.array([templates[name]]), k)
        own = np.unique(values)
        if len(own):
            known.setdefault(len(values), []).append((name, own, [np.uint64((own * s).min()) for s in SEEDS]))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches):
        for batch in batches:
            for part in words.pieces(batch, "text", 2_000_000):
                data, bounds = words.text_bytes(part.column("text"))
                starts, ends, first = words.word_spans(data, bounds)
                values, offsets = words.shingle_hashes(words.span_hashes(data, starts, ends), first, k)
                found = []
                for m, group in known.items():
                    found += _matches(values, offsets, m, group, num, den)
                cols = [[] for _ in range(8)]
                for row, name, shared, total, low, high in sorted(found):
                    a, b = int(starts[first[row] + low]), int(ends[min(first[row] + high + k, first[row + 1]) - 1])
                    points = lambda end: int((data[bounds[row]:end] & 0xC0 != 0x80).sum())
                    for c, v in zip(cols, (row, name, shared, total, low, min(high + k, first[row + 1] - first[row]) - 1, points(a), points(b))):
                        c.append(v)
                ints = [pa.array(c, pa.int64()) for c in cols[2:]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), *ints],
                                                 ["doc_id", "license", "n_shared", "n_template", "first_word", "last_word", "start", "end"])

    return rows.mapInArrow(scan, "doc_id long, license string, n_shared long, n_template long, first_word long, last_word long, "
                                 "start long, end long")


def _matches(values: np.ndarray, offsets: np.ndarray, m: int, group: list, num: int, den: int) -> list[tuple]:
    """(row, name, shared, template size, first and last shared shingle) of the best window of each text and template."""
    count = np.diff(offsets)
    pieces = -(-count // m)                       # stretches of m shingles of each text
    base = np.concatenate([[0], np.cumsum(pieces)])
    if not base[-1]:
        return []
    row = np.repeat(np.arange(len(count)), pieces)
    number = np.arange(base[-1]) - base[:-1][row]
    begin = offsets[:-1][row] + number * m
    hit = [np.zeros(len(row), bool) for _ in group]
    joined = np.append(row[1:] == row[:-1], False)  # a window is a stretch and the next one of its text
    for band in range(BANDS):
        least = np.minimum.reduceat(values * SEEDS[band], begin)
        window = np.where(joined, np.minimum(least, np.append(least[1:], 0)), least)
        for h, (_, _, mins) in zip(hit, group):
            h |= window == mins[band]
    out = []
    for h, (name, own, _) in zip(hit, group):
        best: dict[int, tuple] = {}
        for w in np.flatnonzero(h):
            r, low = int(row[w]), int(begin[w])
            there = values[low:min(low + 2 * m, int(offsets[r + 1]))]
            at = np.flatnonzero(np.isin(there, own))
            shared = len(np.unique(there[at]))
            if den * shared >= num * len(own) and (r not in best or shared > best[r][2]):
                first = low - int(offsets[r])
                best[r] = (r, name, shared, len(own), first + int(at[0]), first + int(at[-1]))
        out += best.values()
    return out
