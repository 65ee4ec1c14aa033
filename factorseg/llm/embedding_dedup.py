"""Near-duplicate embeddings by iterative quantisation, multi-index Hamming tables and exact cosines.

1. Equal vectors with equal labels collapse to one with a count.
2. On a bounded sample (SAMPLE_ROWS unit vectors) iterative quantisation learns rotations that make sign codes balanced and
   close to the vectors; every vector gets its codes.
3. The codes are cut into tables of ``width`` bits; vectors of a label that agree on a table's bits meet in a cell. The
   width grows with the number of rows so that cells stay small, and the number of tables with it, so that a pair at the
   threshold (whose bits differ with probability arccos(t) / pi) is missed in all of them with probability MISSED.
4. A cell of more than CELL_ROWS rows is cut into blocks that meet two by two. A task takes the cosines of its rows on
   the original vectors in double precision, counts each vector's partners, a pair only in the first table where
   its bits agree, and passes on counts and a spanning forest of the links, never the pairs.
5. Components of the forests give each vector its smallest linked id.

Work grows with the square of a group of different near vectors, because every vector's number of partners is part of the
result; it is dealt over tasks of bounded size.

Defined results: rows with a null label, and vectors that are null, zero, hold null or non-finite components, or differ in
length from the most frequent one have no links and are their own component; rows that repeat an id are separate
vectors under one id; rows without an id link like others but never name a component and have null for their own; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factorseg.llm import vectors
from factorseg.llm.graph import components
from factorseg.operators.lineage import cut_lineage

SAMPLE_ROWS = 20_000
CELL_ROWS = 2048
MISSED = 0.005
ROUNDS = 30


def learned_rotation(sample: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of iterative quantisation: principal axes, then a rotation fitted to its own sign codes."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    size = sample.shape[1]
    _, axes = np.linalg.eigh(centred.T @ centred + 1e-12 * np.eye(size))
    projected = centred @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    for _ in range(ROUNDS):
        codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(codes.T @ projected)
        rotation = (u @ vt).T
    return mean, axes @ rotation


def table_shape(rows: int, threshold: float) -> tuple[int, int]:
    """(bits a table, tables) for a number of rows."""
    width = min(24, max(8, math.ceil(math.log2(max(rows, 1) / 64))))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** width
    return width, max(1, math.ceil(math.log(MISSED) / math.log(1 - same)))


def near_duplicates(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row."""
    table = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    good, size = vectors.of_usual_size(table.filter("label is not null"), "v")
    if not size:
        return table.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                            F.col("vec_id").isNotNull().alias("kept"))
    key = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    usual = F.coalesce(vectors.usable("v") & (F.size("v") == size) & F.col("label").isNotNull(), F.lit(False))
    keyed = table.select("vec_id", "label", "v", *key, usual.alias("usual"))
    once = (keyed.filter("usual").groupBy("label", "h1", "h2")
            .agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v")))
    # a number for each distinct vector: its hash, so that rows without or with repeated ids stay apart
    once = cut_lineage(once.select("label", "h1", "h2", "rep", "weight", F.xxhash64("h1", "h2", "label").alias("node"), "v"))
    sample = once.select("v", "h1").orderBy("h1").limit(SAMPLE_ROWS).toArrow()
    x = vectors.matrix(sample.column("v"), size)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    width, tables = table_shape(once.count(), threshold)
    each = max(1, size // width)
    width = min(width, size)
    learned = [learned_rotation(x, seed) for seed in range(-(-tables // each))]
    cells = _cells(once, learned, size, width, tables, each)
    found = cut_lineage(_linked(cells, size, tables, threshold))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    forest = found.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    named = once.select("label", "h1", "h2", "node", "rep", "weight")
    group = components(forest)
    named = (named.join(counts, "node", "left").join(group.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
             .select("label", "h1", "h2", "rep", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "node").alias("group")))
    named = cut_lineage(named)
    least = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "group").select("label", "h1", "h2", "n_links", "component_id")
    out = keyed.select("vec_id", "label", "h1", "h2", F.when(F.col("usual"), F.lit(True)).alias("usual")).join(
        named.withColumn("usual", F.lit(True)), ["label", "h1", "h2", "usual"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _cells(once: DataFrame, learned: list, size: int, width: int, tables: int, each: int) -> DataFrame:
    """(label, table, bits, node, weight, v, codes): each vector once in every table; codes holds the bits of all tables."""
    kind = once.schema["v"].dataType.simpleString()
    label = once.schema["label"].dataType.simpleString()

    def code(batches):
        power = (1 << np.arange(width)).astype(np.int64)
        for batch in batches:
            x = vectors.matrix(batch.column("v"), size)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            codes = np.zeros((len(x), tables), np.int64)
            for r, (mean, projection) in enumerate(learned):
                bits = (x - mean) @ projection >= 0
                for t in range(r * each, min(tables, (r + 1) * each)):
                    at = (t - r * each) * width
                    codes[:, t] = bits[:, at:at + width] @ power
            flat = codes.astype("<i4")
            held = pa.array([row.tobytes() for row in flat], pa.binary())
            for t in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), pa.array(np.full(len(x), t, np.int32)), pa.array(codes[:, t]), batch.column("node"),
                     batch.column("weight"), batch.column("v"), held], ["label", "table", "bits", "node", "weight", "v", "codes"])

    return once.select("label", "node", "weight", "v").mapInArrow(
        code, f"label {label}, table int, bits long, node long, weight long, v {kind}, codes binary")


def _linked(cells: DataFrame, size: int, tables: int, threshold: float) -> DataFrame:
    """(node, links, head): partners found in one cell's block and a node it hangs together with there."""
    sizes = cells.groupBy("label", "table", "bits").agg(F.count("*").alias("n")).filter("n > 1").withColumn(
        "blocks", F.ceil(F.col("n") / CELL_ROWS).cast("int"))
    placed = cells.join(sizes, ["label", "table", "bits"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = placed.withColumn("other", other).select(
        "label", "table", "bits", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "node", "weight", "v", "codes")

    def link(group: pa.Table) -> pa.Table:
        n = group.num_rows
        x = vectors.matrix(group.column("v"), size)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), "<i4").reshape(n, tables)
        node, weight = group.column("node").to_numpy(), group.column("weight").to_numpy()
        block = group.column("block").to_numpy()
        table, i, j = (group.column(c)[0].as_py() for c in ("table", "i", "j"))
        links, head = np.zeros(n, np.int64), np.arange(n)
        for at in range(0, n, 256):
            part = slice(at, min(n, at + 256))
            cosine = x[part] @ x.T
            near = cosine >= threshold - 1e-9
            if i != j:
                near &= block[part, None] != block[None, :]
            near[np.arange(near.shape[0]), np.arange(part.start, part.stop)] = False
            a, b = np.nonzero(near)
            a = a + at
            same = np.ones(len(a), bool)
            edge = np.abs(cosine[a - at, b] - threshold) < 1e-7
            if edge.any():  # decided by sums in a fixed order
                same[edge] = vectors.dots(x[a[edge]], x[b[edge]]) >= threshold
            for t in range(table):
                same &= codes[a, t] != codes[b, t]
            a, b = a[same], b[same]
            np.add.at(links, a, weight[b])
            forward = a < b
            for p, q in zip(a[forward], b[forward]):
                while head[p] != p:
                    head[p] = head[head[p]]
                    p = head[p]
                while head[q] != q:
                    head[q] = head[head[q]]
                    q = head[q]
                if p != q:
                    head[max(p, q)] = min(p, q)
        for p in range(n):
            head[p] = head[head[p]]
        on = links > 0
        return pa.table({"node": pa.array(node[on]), "links": pa.array(links[on]), "head": pa.array(node[head[on]])})

    return met.groupBy("label", "table", "bits", "i", "j").applyInArrow(link, "node long, links long, head long")
