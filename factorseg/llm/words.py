"""Vectorised words, shingles and bounded sketches over Arrow batches of whole texts.

A word is a run of bytes outside space and TAB..CR after lower-casing A-Z. A text is hashed in stretches of
bounded size that end at word ends, so memory follows the batch and not the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from factorseg.operators.lineage import lean

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
STRETCH = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xFF51AFD7ED558CCD)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * MIX
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _lower_values() -> np.ndarray:
    code = np.arange(256)
    code[65:91] += 32
    return mixed((code.astype(np.uint64) + np.uint64(1)) * BASE)


LETTER = _lower_values()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(BASE)
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)])),
                np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)])))


POWERS: list = []


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its texts; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text) of all words; no word crosses a text's bound."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(data) else inside
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(data) else inside
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letter: np.ndarray = LETTER) -> np.ndarray:
    """64-bit hashes of byte spans that do not overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, low + STRETCH, "right")))
            high = int(ends[to - 1])
            if not POWERS or len(POWERS[0]) <= high - low:
                POWERS[:] = _powers(max(high - low, STRETCH))
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(letter[data[low:high]] * POWERS[0][:high - low], out=total[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            out[at:to] = (total[e] - total[s]) * POWERS[1][s] + (e - s).astype(np.uint64)
            at = to
        return mixed(out)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, in order, and the offsets of the texts.

    A text with fewer words has its whole sequence as its only shingle; one without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - offsets[:-1], count) + np.arange(offsets[-1])
    size = np.repeat(np.minimum(n, k), count)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            factor = np.uint64(int(BASE) * (2 * j + 3) & (1 << 64) - 1 | 1)
            here = size > j
            part = mixed(words[np.where(here, at + j, 0)] * factor) if len(words) else h
            h += np.where(here, part, np.uint64(0))
        return mixed(h + size.astype(np.uint64)), offsets


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = text_bytes(texts)
    starts, ends, first = word_spans(data, bounds)
    return shingle_hashes(span_hashes(data, starts, ends), first, k)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Rows planned inside go to Python in Arrow batches of about this size, whatever the length of their texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release() -> None:
    """Give memory that a task has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    length = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
                       .to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = int(length[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(length, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


CHUNKS = 32
SKETCH_BITS = 21  # of sketches that only order shingles from rare to frequent


def rarest(own: np.ndarray, counts: np.ndarray, bits: int, num: int, den: int) -> np.ndarray:
    """The start of a set in the order (count in the sketch, hash): sets of similarity num/den share one of these."""
    own = np.sort(own)
    n = len(own)
    if not n:
        return own
    order = np.argsort(counts[(own >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")
    return own[order[:n + (-num * n // den) + 1]]


def merged_cells(parts: DataFrame, bits: int, either: bool = False) -> bytes:
    """Sum (or bitwise or) of partial arrays, given as rows (chunk int, cells binary of uint32).

    The result has 4 * 2**bits bytes whatever the input. Partial arrays are summed in two levels,
    each task streaming over its rows, and only the CHUNKS sums reach the driver.
    """
    width = (1 << bits) // CHUNKS

    def combine(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, cells in zip(batch.column("chunk").to_pylist(), batch.column("cells")):
                part = np.frombuffer(cells.as_buffer(), np.uint32)
                have = sums.get(chunk)
                sums[chunk] = part.copy() if have is None else (have | part if either else
                    np.minimum(have.astype(np.uint64) + part, 0xFFFFFFFF).astype(np.uint32))
        for chunk, cells in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([cells.tobytes()], pa.binary())],
                                             ["chunk", "cells"])

    schema = "chunk int, cells binary"
    out = np.zeros(1 << bits, np.uint32)
    with lean(parts.sparkSession):
        salted = parts.withColumn("salt", F.spark_partition_id() % 16).repartition("chunk", "salt").drop("salt")
        total = salted.mapInArrow(combine, schema).repartition("chunk").mapInArrow(combine, schema)
        for row in total.collect():  # CHUNKS rows
            out[row.chunk * width:(row.chunk + 1) * width] = np.frombuffer(row.cells, np.uint32)
    return out.tobytes()


def cell_rows(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    width = len(cells) // CHUNKS
    for chunk in range(CHUNKS):
        part = cells[chunk * width:(chunk + 1) * width]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                                             ["chunk", "cells"])


def id_bitmap(ids: DataFrame, column: str, bits: int = 18) -> bytes:
    """A bitmap of 32 * 2**bits bits over hashed ids, to skip most rows that no later join can use."""

    def fill(batches):
        cells = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            place = bitmap_place(batch.column(0).to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(cells, place[0], place[1])
        yield from cell_rows(cells)

    return merged_cells(ids.select(column).filter(F.col(column).isNotNull())
                        .mapInArrow(fill, "chunk int, cells binary"), bits, either=True)


def bitmap_place(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(ids.astype(np.int64).view(np.uint64) + BASE)
    return (h >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1) << (h & np.uint64(31)).astype(np.uint32)


def in_bitmap(ids: pa.Array, cells: np.ndarray) -> np.ndarray:
    known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
    word, bit = bitmap_place(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), len(cells).bit_length() - 1)
    return known & ((cells[word] & bit) != 0)


def set_rows(ids: pa.Array, values: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """(id, items): the distinct values of each text."""
    own = [np.unique(values[offsets[i]:offsets[i + 1]]) for i in range(len(ids))]
    ends = np.concatenate([[0], np.cumsum([len(c) for c in own])]).astype(np.int32)
    flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, flat.view(np.int64))], ["id", "items"])
