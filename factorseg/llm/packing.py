"""Packing tokenised documents into sequences of at most ``window`` tokens by non-negative least squares.

1. Texts are encoded and cut into pieces of at most ``window`` tokens; the pieces, without their ids, are written.
2. Their lengths, rounded up to ``window / BINS``, form a histogram of BINS counts, the only thing the driver sees.
3. All combinations of at most DEPTH lengths that fill a window are columns of a matrix; non-negative least squares
   finds how often to use each. Repeats are rounded down, and the counts that remain are packed greedily, still on
   the histogram: the longest length first, then the longest that fits, as many times as the counts allow.
4. Pieces of one length are numbered (in buckets of bounded size, so no length is one task) and piece number i of a
   length goes to the i-th place that the plan has for it.

Memory on the driver and in tasks depends on BINS only. Padding comes from rounding lengths up (at most
``window / BINS - 1`` tokens a piece) and from the last combinations.

Defined results: null and empty texts are one piece with the end id only; rows without an id and rows that repeat an id are
packed like all others; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from factorseg.llm import tokens, words
from factorseg.operators.lineage import cut_lineage

BINS, DEPTH = 128, 3
BUCKET_ROWS = 20_000


def token_pieces(docs: DataFrame, window: int = 2048, end_id: int = 1, vocabulary: tuple[str, str] | None = None,
                 keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each text's ids and the end id, cut every ``window`` ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    path_of = (lambda: (*tokens.public_vocabulary(), tokens.public_added_tokens())) if vocabulary is None else lambda: vocabulary

    def cut(batches):
        encoder = tokens.Encoder(*path_of())
        for batch in batches:
            for part in words.pieces(batch, "text", 2_000_000):
                ids, offsets = encoder.encode(part.column("text"))
                row, start, length, total, crc, held = [], [], [], [], [], []
                for i in range(part.num_rows):
                    own = np.append(ids[offsets[i]:offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(own), window):
                        piece = own[at:at + window]
                        row.append(i)
                        start.append(at)
                        length.append(len(piece))
                        total.append(len(own))
                        crc.append(zlib.crc32(piece.tobytes()))
                        if keep_ids:
                            held.append(pa.array(piece.astype(np.int32)))
                columns = [part.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(held) if held else pa.array([], pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(cut, schema)


def packed(docs: DataFrame, window: int = 2048, **options) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; offsets in a sequence are gapless from 0."""
    pieces = cut_lineage(token_pieces(docs, window, **options))
    unit = max(1, window // BINS)
    pieces = pieces.withColumn("bin", F.ceil(F.col("length") / unit).cast("int"))
    counts = np.zeros(-(-window // unit) + 1, np.int64)
    for row in pieces.groupBy("bin").count().collect():  # one row per length class
        counts[row["bin"]] = row["count"]
    plan = packing_plan(counts)
    return _placed(pieces, plan, int(counts.sum()))


def _placed(pieces: DataFrame, plan: list[tuple[tuple[int, ...], int]], total: int) -> DataFrame:
    key = F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens")
    pieces = pieces.withColumn("bucket", F.pmod(key, F.lit(total // BUCKET_ROWS + 1)))
    sizes = pieces.groupBy("bin", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("bin", "bucket", (F.sum("n").over(W.partitionBy("bin").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("bin", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    numbered = pieces.withColumn("inside", inside).join(before, ["bin", "bucket"]).withColumn(
        "number", F.col("before") + F.col("inside") - 1).drop("inside", "before", "bucket")

    places: dict[int, list[tuple[int, int, int]]] = {}  # by bin: (first number, first sequence, slot)
    given: dict[int, int] = {}
    sequence = 0
    for parts, repeats in plan:
        for slot, part in enumerate(parts):
            places.setdefault(part, []).append((given.get(part, 0), sequence, slot))
            given[part] = given.get(part, 0) + repeats
        sequence += repeats
    table = {part: np.array(rows, np.int64).T for part, rows in places.items()}

    def place(batches):
        for batch in batches:
            part = batch.column("bin").to_numpy()
            number = batch.column("number").to_numpy()
            sequence, slot = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for b in np.unique(part):
                mine = part == b
                first, base, order = table[int(b)]
                at = np.searchsorted(first, number[mine], "right") - 1
                sequence[mine] = base[at] + number[mine] - first[at]
                slot[mine] = order[at]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["bin", "number"]).columns, pa.array(sequence), pa.array(slot)],
                                             [c for c in batch.schema.names if c not in ("bin", "number")] + ["sequence_id", "slot"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name not in ("bin", "number"))
    out = numbered.mapInArrow(place, schema + ", sequence_id long, slot long")
    held = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(held), F.lit(0)).cast("long")).drop("slot")


def combinations(size: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of 2 to ``depth`` lengths, longest first, that sum to ``size``."""
    out = []

    def grow(parts: tuple[int, ...], rest: int, most: int):
        if len(parts) > 1 and rest == 0:
            out.append(parts)
        if len(parts) < depth and rest:
            for part in range(min(rest, most), 0, -1):
                if part * (depth - len(parts)) >= rest:
                    grow((*parts, part), rest - part, part)

    grow((), size, size - 1)
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method on the normal equations; ``rounds`` bounds the work."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    gradient = a.T @ b
    limit = 1e-9 * max(1.0, np.abs(gradient).max(initial=0))
    for _ in range(rounds):
        open_ = np.where(active, -np.inf, gradient)
        best = int(np.argmax(open_))
        if open_[best] <= limit:
            break
        active[best] = True
        while True:
            on = np.flatnonzero(active)
            try_ = np.zeros_like(x)
            try_[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (try_[on] > 0).all():
                x = try_
                break
            bad = on[try_[on] <= 0]
            step = (x[bad] / np.maximum(x[bad] - try_[bad], 1e-300)).min()
            x = np.maximum(x + step * (try_ - x), 0)
            active &= x > 1e-9
            x[~active] = 0
            if not active.any():
                break
        gradient = a.T @ (b - a @ x)
    return x


def packing_plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up a histogram of lengths 1..len(counts) - 1, each combination within the last length."""
    size = len(counts) - 1
    left = counts.astype(np.int64).copy()
    plan = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    shapes = [c for c in combinations(size) if all(left[p] for p in c)]
    if shapes:
        a = np.zeros((size, len(shapes)))
        for j, parts in enumerate(shapes):
            np.add.at(a[:, j], np.array(parts) - 1, 1)
        x = nonnegative_least_squares(a, left[1:].astype(float), 3 * size)
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 1:
                break
            parts, times = np.unique(shapes[j], return_counts=True)
            repeats = int(min(np.floor(x[j]), (left[parts] // times).min()))
            if repeats:
                left[parts] -= repeats * times
                plan.append((shapes[j], repeats))
    while left.any():  # each turn uses up the count of at least one length
        parts, rest = [], size
        taken = np.zeros_like(left)
        while True:
            fits = np.flatnonzero(left[:rest + 1] > taken[:rest + 1])
            if not len(fits):
                break
            part = int(fits[-1])
            parts.append(part)
            taken[part] += 1
            rest -= part
        used = taken > 0
        repeats = int((left[used] // taken[used]).min())
        left -= repeats * taken
        plan.append((tuple(parts), repeats))
    return plan
