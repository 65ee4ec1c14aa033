"""N-gram Jaccard join of whole texts by grouped prefixes.

Texts are sets of word shingles. Sorted from rare to frequent, two sets that reach the similarity share one of
their first ``n - ceil(t * n) + 1`` shingles. The join therefore

1. counts all shingles in a sketch of fixed size (4 * 2**SKETCH_BITS bytes), which only decides the order;
2. collapses equal sets to their smallest id, and sets of equal prefix and size to one group;
3. (``linking``) links every set with its group's leader and with the group its prefix meets most often, and takes components;
4. pairs groups over shared prefix shingles, by size and by position, but only where members of different
   components meet, expands the group pairs to members of different components and verifies them.

Step 3 is linear and settles large groups of near copies; step 4 completes the join, since a pair inside one component
cannot change a component. Inside a shingle's list, members of its most frequent component are never paired with
each other. Shingles are held as 64-bit hashes; similarity is computed on the full sets.

Defined results: null and empty texts have no shingles, no links and form their own component; rows without an id come
back with a null component; rows that repeat an id each get the component of their own text (where the id is the
smallest of both texts' sets, these are one node); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factorseg.llm import words
from factorseg.llm.linking import linked
from factorseg.operators.lineage import Scratch, cut_lineage


def jaccard_components(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_hash, component_id), one row per input row.

    ``similarity`` is a fraction (numerator, denominator): sets link when denominator * |A & B| >= numerator * |A | B|.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with words.small_batches(docs.sparkSession):
        return _components(rows, k, similarity)


def _components(rows: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    table = cut_lineage(_prefixes(rows, k, similarity))
    sets = (table.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
            .agg(F.min(F.struct("doc_id", "prefix")).alias("first"), F.count("*").alias("copies"))
            .select(F.col("first.doc_id").alias("rep"), F.col("n_shingles").alias("n"), "copies", F.col("first.prefix").alias("tokens"),
                    F.xxhash64("first.prefix", "n_shingles").alias("same")))
    leaders = sets.groupBy("same").agg(F.min("rep").alias("leader"))
    scratch = Scratch(rows.sparkSession)
    reps = scratch.cut(sets.join(leaders, "same").select("rep", "leader", "n", "copies", "tokens"))
    groups = reps.filter("rep = leader").select("leader", "n", "copies", "tokens")

    def full_sets(bitmap):
        def sets_of(batches):
            cells = np.frombuffer(bitmap.value, np.uint32)
            for batch in batches:
                wanted = batch.filter(pa.array(words.in_bitmap(batch.column("doc_id"), cells)))
                for part in words.pieces(wanted, "text"):
                    yield words.set_rows(part.column("doc_id"), *words.shingles(part.column("text"), k))
            words.release()
        return rows.mapInArrow(sets_of, "id long, items array<long>")

    settled = linked(groups, reps.select("rep", "leader"), full_sets, similarity)
    scratch.drop()

    # equal sets follow their smallest id; pooled ids follow their least component
    copies = (table.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
              .agg(F.min("doc_id").alias("rep")))
    copies = copies.join(settled, copies.rep == settled.node, "left").select(
        "set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = table.drop("prefix").join(copies, ["set_a", "set_b", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.col("set_a").alias("set_hash"),
                      F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """Documents without those whose component holds a document of smaller id; rows without an id stay.

    Of rows that repeat an id, all stay or all go.
    """
    out = jaccard_components(docs, k, similarity)
    gone = out.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def _prefixes(rows: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, prefix): the set's size, its 128-bit hash and its rarest shingles."""
    spark = rows.sparkSession
    num, den = similarity

    def count(batches):
        cells = np.zeros(1 << words.SKETCH_BITS, np.uint32)
        for batch in batches:
            for part in words.pieces(batch, "text"):
                values, _ = words.shingles(part.column("text"), k)
                cells += np.bincount((values >> np.uint64(64 - words.SKETCH_BITS)).astype(np.int64),
                                     minlength=1 << words.SKETCH_BITS).astype(np.uint32)
        yield from words.cell_rows(cells)
        words.release()

    sketch = spark.sparkContext.broadcast(words.merged_cells(
        rows.select("text").mapInArrow(count, "chunk int, cells binary"), words.SKETCH_BITS))

    def prefix(batches):
        counts = np.frombuffer(sketch.value, np.uint32)
        for batch in batches:
            for part in words.pieces(batch, "text"):
                values, offsets = words.shingles(part.column("text"), k)
                size, low, high, chosen = [], [], [], []
                for i in range(part.num_rows):
                    own = np.unique(values[offsets[i]:offsets[i + 1]])
                    n = len(own)
                    size.append(n)
                    low.append(words.mixed(own).sum(dtype=np.uint64))
                    high.append(words.mixed(own + words.BASE).sum(dtype=np.uint64))
                    chosen.append(words.rarest(own, counts, words.SKETCH_BITS, num, den))
                ends = np.concatenate([[0], np.cumsum([len(c) for c in chosen])]).astype(np.int32)
                flat = np.concatenate(chosen).view(np.int64) if chosen else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(np.array(low, np.uint64).view(np.int64)),
                     pa.array(np.array(high, np.uint64).view(np.int64)), pa.ListArray.from_arrays(ends, flat)],
                    ["doc_id", "n_shingles", "set_a", "set_b", "prefix"])
        words.release()

    return rows.mapInArrow(prefix, "doc_id long, n_shingles long, set_a long, set_b long, prefix array<long>")
