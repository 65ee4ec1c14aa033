"""Encodings: row index, ordinal codes, one-hot, z-scores, flags and a linear 2-D projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from factorseg.functions.columns import number, number_filled
from factorseg.operators.dictionary import table_lookup
from factorseg.operators.joins import SMALL_ROWS
from factorseg.operators.lineage import cut_lineage

PARTITION_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def with_row_index(df: DataFrame, order: Sequence[Column | str], out: str = "customer_index",
                   cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """0..n-1 in the given total order, without a single-task sort.

    Rows are range-partitioned and sorted; a row's index is its place in its partition plus
    the sizes of the partitions before it. The checkpoint (``cut`` writes it) pins the partitioning both use.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    marked = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", PARTITION_BITS).cast("int")
    sizes = {r["p"]: r["n"] for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(at)
        at += sizes.get(p, 0)
    if not starts:
        return marked.withColumn(out, F.lit(0).cast("bigint")).drop("_mid")
    first = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), part + 1)
    inside = F.col("_mid").bitwiseAND(F.lit((1 << PARTITION_BITS) - 1))
    return marked.withColumn(out, first + inside).drop("_mid")


def with_file_row_index(df: DataFrame, out: str = "customer_index") -> DataFrame:
    """0..n-1 in the order of the lines in the files, files by path; ``df`` is a table as a file reader gives it.

    No column is sorted: a reader's task keeps the order of lines in each block of a file, and a block knows its file and where it
    starts. The index is the place in the block plus the rows of the blocks before it. There is one row of sizes for each block,
    as many as the splits that the reader plans. A column named like ``out`` is replaced; an empty table gives no rows; a table that
    does not come from files is an error of the reader's metadata column.
    """
    kept = [c for c in df.columns if c != out]
    marked = cut_lineage(df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid")))
    blocks = marked.groupBy("file", "block").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("n").alias("n"))
    # one row a file passes this window
    ahead = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    starts = blocks.withColumn("inside", F.coalesce(F.sum("n").over(in_file), F.lit(0))).join(ahead, "file").select(
        "file", "block", "first", (F.col("ahead") + F.col("inside")).alias("start"))
    return marked.join(starts, ["file", "block"]).select(
        *[F.col("row").getField(c).alias(c) for c in kept], (F.col("mid") - F.col("first") + F.col("start")).alias(out))


def sorted_levels(df: DataFrame, column: str, limit: int | None = None) -> list | None:
    """The sorted distinct values, or None when there are more than ``limit``."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct()
    rows = rows.collect() if limit is None else rows.limit(limit + 1).collect()
    return None if limit is not None and len(rows) > limit else sorted(r[0] for r in rows)


def ordinal_codes(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Rank of each value among the sorted distinct values, 0..K-1; null gives -1."""
    out = out or f"{column}_code"
    levels = sorted_levels(df, column, SMALL_ROWS)
    if levels is not None:
        dtype = df.schema[column].dataType.simpleString()
        table = F.broadcast(df.sparkSession.createDataFrame(
            [(v, i) for i, v in enumerate(levels)], f"_level {dtype}, _code int"))
    else:
        distinct = df.select(F.col(column).alias("_level")).filter(F.col("_level").isNotNull()).distinct()
        table = with_row_index(distinct, ["_level"], "_code")
    return (df.join(table, F.col(column) == F.col("_level"), "left")
            .withColumn(out, F.coalesce(F.col("_code").cast("int"), F.lit(-1))).drop("_level", "_code"))


def one_hot_drop_first(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0/1 columns ``<column>_<level>`` for every sorted level but the first; null gives zeros.

    The result has one column per level, which is what this form of output is.
    """
    new = []
    for c in columns:
        levels = sorted_levels(df, c)
        new += [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in levels[1:]]
    return df.select(*[c for c in df.columns if c not in columns], *new)


def one_hot_sparse(df: DataFrame, columns: Sequence[str], out: str = "indices") -> tuple[DataFrame, int]:
    """(``df`` with ``out``, width): the one-hot matrix row by row, as the ascending numbers of its ones, for any number of levels.

    The matrix columns are those of ``one_hot_drop_first``: the sorted levels of each column but the first, column by column.
    Levels stay in tables; the driver sees one count a column. Null and the first level have no one; no rows give width 0.
    """
    codes, width = [], 0
    for i, c in enumerate(columns):
        distinct = df.select(F.col(c).alias("level")).filter("level IS NOT NULL").distinct()
        levels = with_row_index(distinct, ["level"], "code")
        code = f"_one_{i}"
        df = table_lookup(df, c, levels.filter("code > 0"), "level", "code", code)
        codes.append(F.col(code) + (width - 1))
        width += max(levels.count() - 1, 0)
    return (df.withColumn(out, F.array_compact(F.array(*codes)))
            .drop(*[f"_one_{i}" for i in range(len(columns))])), width


def sparse_cross_products(df: DataFrame, indices: str = "indices") -> DataFrame:
    """(i, j, n) with i <= j: the non-zero cells of the matrix' cross products, pairs formed inside each row and combined in tasks."""
    ones = df.select(F.explode(indices).alias("i"), F.col(indices).alias("all"))
    pairs = ones.select("i", F.explode(F.filter("all", lambda j: j >= F.col("i"))).alias("j"))
    return pairs.groupBy("i", "j").agg(F.count("*").alias("n"))


def zscore(df: DataFrame, columns: Sequence[str], ddof: int = 0, null_as_zero: bool = True) -> DataFrame:
    """Standardise in place with the population (ddof=0) or sample (ddof=1) deviation.

    A constant column gives 0.
    """
    value = {c: number_filled(df, c) if null_as_zero else number(df, c) for c in columns}
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = df.agg(*[F.avg(v).alias(f"m_{i}") for i, v in enumerate(value.values())],
                 *[sd(v).alias(f"s_{i}") for i, v in enumerate(value.values())]).first()
    z = {}
    for i, (c, v) in enumerate(value.items()):
        m, s = row[f"m_{i}"], row[f"s_{i}"]
        z[c] = (v - m) / (s if s else 1.0) if m is not None else v
    return df.withColumns(z)


def is_flag(name: str) -> bool:
    return name.startswith("is_") or name.endswith("_flag") or name.startswith("sx_")


def flag_fill(df: DataFrame) -> DataFrame:
    """Columns named like flags: null becomes 0, values become integers."""
    return df.withColumns({c: number_filled(df, c).cast("int") for c in df.columns if is_flag(c)})


def pca_projection(df: DataFrame, id_col: str, columns: Sequence[str], k: int = 2) -> DataFrame:
    """(id, pc1..pck): centred linear projection; each axis' largest loading is positive."""
    means = df.agg(*[F.avg(number_filled(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    mean = np.array([means[f"m{i}"] for i in range(len(columns))])
    flat = df.select(id_col, *[number_filled(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    assembled = VectorAssembler(inputCols=[f"x{i}" for i in range(len(columns))], outputCol="v").transform(flat)
    model = PCA(k=k, inputCol="v", outputCol="p").fit(assembled)
    axes = model.pc.toArray()
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    shift = mean @ axes
    p = vector_to_array("p")
    return model.transform(assembled).select(
        id_col, *[((p[j] - float(shift[j])) * float(sign[j])).alias(f"pc{j + 1}") for j in range(k)])
