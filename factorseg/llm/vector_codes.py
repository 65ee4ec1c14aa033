"""Vector code compression: product codes from integer k-means, nearest entries found in the Walsh-Hadamard domain.

Each component x becomes the integer floor(4096 * x). Vectors are cut into ``parts`` equal consecutive parts; every part position
has a codebook of ``entries`` integer vectors. Parts and entries are zero-padded to a power of two and transformed by the integer
Walsh-Hadamard matrix, which multiplies every squared distance by the padded length. Differences are squared and summed in
sequency order (low sequencies of a smooth vector hold most of it): after each block of coefficients an entry whose sum exceeds the
whole distance of the best entry so far is dropped. Sums only grow, so this is exact, and everything is integer.

On Spark: the integer vectors are written once; every round is one pass in which tasks send one sum per codebook entry, not rows.
Only sums (parts * entries * length numbers) and codebooks reach the driver; their size follows the parameters.

Defined results: a vector that is null, empty, or holds null or non-finite components has no code and is left out, and so is one
with a component whose scaled squared difference a long cannot hold (``_largest``; beyond +-8192 for parts of 8 components); zero
vectors are coded; rows that repeat an id or are equal are coded alike and all count. The first codebooks are the parts
of the ``entries`` (256 at most) smallest ids (null last), ties in order of the vectors; with fewer rows there are fewer entries. Vectors whose
length differs from the longest, or is no multiple of ``parts``, are taken as if filled up with zeros. An empty table has no
rows; null labels count as one label; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factorseg.llm.salting import join_summary
from factorseg.operators.lineage import Scratch, cut_lineage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
CELLS = 1 << 20   # differences held at a time


def hadamard(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows by sequency (number of sign changes)."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")]


def transformed(values: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of zero-padded rows by additions in log2 steps, columns by sequency."""
    n, width = values.shape
    size = 1 << max(width - 1, 0).bit_length()
    out = np.zeros((n, size), np.int64)
    out[:, :width] = values
    step = 1
    while step < size:
        pairs = out.reshape(n, -1, 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    # row s by sequency is the bit-reversed Gray code of s in natural order
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    natural = np.zeros(size, np.int64)
    for b in range(bits):
        natural |= ((gray >> b) & 1) << (bits - 1 - b)
    return out[:, natural]


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row, ties to the lower index."""
    x, c = transformed(parts), transformed(book)
    n, size = x.shape
    block = max(1, size // 4)
    row, entry = np.repeat(np.arange(n), len(c)), np.tile(np.arange(len(c)), n)
    total = np.zeros(len(row), np.int64)
    for at in range(0, size, block):
        total += ((x[row, at:at + block] - c[entry, at:at + block]) ** 2).sum(axis=1)
        if at + block < size:
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            # pairs are grouped by row; the whole distance of the best so far bounds the row's nearest
            least = np.minimum.reduceat(total, first)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
            best = np.flatnonzero(total == least[group])
            best = best[np.r_[True, group[best][1:] != group[best][:-1]]]
            bound = total[best] + ((x[row[best], at + block:] - c[entry[best], at + block:]) ** 2).sum(axis=1)
            keep = total <= bound[group]
            row, entry, total = row[keep], entry[keep], total[keep]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(total, first)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
    best = np.flatnonzero(total == least[group])
    best = best[np.r_[True, group[best][1:] != group[best][:-1]]]
    return entry[best], total[best] // size


def _largest(width: int) -> int:
    """Components up to this size keep every scaled squared distance of a part, and a vector's sum, within a long."""
    size = 1 << max(width - 1, 0).bit_length()
    return 1 << ((60 - 2 * (size.bit_length() - 1)) // 2 - 2)


class Codebooks:
    """Integer codebooks by part position, as plain arrays (entries x part length)."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of every vector's parts."""
        entries, width = self.books[0].shape
        index, distance = np.zeros((2, len(vectors), len(self.books)), np.int64)
        rows = max(1, CELLS // (entries * width))
        for at in range(0, len(vectors), rows):
            for p, book in enumerate(self.books):
                found = nearest(vectors[at:at + rows, p * width:(p + 1) * width], book)
                index[at:at + rows, p], distance[at:at + rows, p] = found
        return index, distance

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for b in self.books for v in b.ravel()).encode()).hexdigest()


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """(id, label, v array<int>) of the rows that can be coded, and the length of a part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = df.filter(F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite, F.lit(False))).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.cast("array<double>").alias("x"))
    longest = good.agg(F.max(F.size("x"))).first()[0] or 0
    width = -(-longest // parts)
    if not width:
        return good.select("id", "label", F.array().cast("array<int>").alias("v")), 0
    top = _largest(width)
    scaled = F.transform("x", lambda x: F.floor(x * SCALE))
    small = F.forall("x", lambda x: (x * SCALE >= -top) & (x * SCALE < top))
    filled = F.concat(F.col("v"), F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("v")))
    return good.filter(small).select("id", "label", scaled.cast("array<int>").alias("v")).select(
        "id", "label", filled.alias("v")), width


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


def fit(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all rows of ``vectors`` (id, v); None without rows."""
    first = vectors.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    if not first:
        return None
    start = np.array([r.v for r in first], np.int64)
    books = Codebooks([start[:, p * width:(p + 1) * width] for p in range(parts)])
    for _ in range(rounds):
        now = books

        def sums(batches, now=now):
            total = np.zeros((parts, len(start), width), np.int64)
            count = np.zeros((parts, len(start)), np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), parts * width)
                index, _ = now.assign(x)
                for p in range(parts):
                    np.add.at(total[p], index[:, p], x[:, p * width:(p + 1) * width])
                    count[p] += np.bincount(index[:, p], minlength=len(start))
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]),
                 pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * width, total[p, e].ravel())],
                ["part", "entry", "n", "total"])

        partial = vectors.select("v").mapInArrow(sums, "part int, entry int, n long, total array<long>")
        summed = (partial.select("part", "entry", "n", F.posexplode("total").alias("pos", "x")).groupBy("part", "entry", "pos")
                  .agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")))
        books = Codebooks([b.copy() for b in now.books])
        for r in summed.collect():  # parts * entries * width rows
            books.books[r.part][r.entry, r.pos] = int(r.x) // r.n  # floors go down
    return books


def coded(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id",
          vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): hex digits of the parts' entries, the squared distance to them, its
    sum over the rows of the same label, and the digest of the codebooks."""
    scratch = Scratch(df.sparkSession)
    vectors, width = integer_vectors(df, id_col, vector_col, label_col, parts)
    vectors = scratch.cut(vectors)
    books = fit(vectors, width, parts, entries, rounds) if width else None

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            index, distance = books.assign(_matrix(batch.column("v"), parts * width))
            code = [bytes(r.tolist()).hex() for r in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()),
                                              pa.array(distance.sum(axis=1), pa.int64())], ["id", "label", "code", "error"])

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    assigned = scratch.cut(vectors.mapInArrow(assign, schema) if books else vectors.select(
        "id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).filter("false"))
    sums = scratch.cut(assigned.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")))
    out = join_summary(assigned, sums, ["label"], "n", F.col("id"))
    out = cut_lineage(out.select(F.col("id").alias(id_col), "code", "error", "label_error",
                                 F.lit(books.sha256() if books else "").alias("codebooks_sha256")))
    scratch.drop()
    return out
