"""Column quality: coverage, variance and dominance filters, and the column profiler."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from factorseg.functions.columns import number_filled
from factorseg.functions.shape import level_rows


def _given(df: DataFrame, name: str) -> Column:
    """Null where the cell is null or NaN, so that ``count`` counts real cells."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def _wide_to_long(one_row: DataFrame, columns: Sequence[str], cells: dict[str, str], keep=()) -> DataFrame:
    """One aggregate row with ``<prefix>_<i>`` columns to one row per column."""
    structs = [F.struct(F.lit(c).alias("column"),
                        *[F.col(f"{prefix}_{i}").alias(out) for prefix, out in cells.items()])
               for i, c in enumerate(columns)]
    return one_row.select(*keep, F.inline(F.array(*structs)))


def coverage_report(df: DataFrame, threshold: float, strict: bool = False,
                    columns: Sequence[str] | None = None) -> DataFrame:
    """(column, non_null, n_rows, kept): one aggregate over all columns."""
    columns = list(columns or df.columns)
    one = df.agg(F.count("*").alias("n_rows"),
                 *[F.count(_given(df, c)).alias(f"k_{i}") for i, c in enumerate(columns)])
    rows = _wide_to_long(one, columns, {"k": "non_null"}, keep=["n_rows"])
    need = F.lit(float(threshold)) * F.col("n_rows")
    kept = F.col("non_null") > need if strict else F.col("non_null") >= need
    return rows.select("column", "non_null", "n_rows", kept.alias("kept"))


def coverage_filter(df: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    kept = {r["column"] for r in coverage_report(df, threshold, strict).filter("kept").collect()}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in kept])


def level_counts(df: DataFrame, cats: Sequence[str], fill: bool = True) -> DataFrame:
    """(variable, level, n)."""
    return level_rows(df, [], cats, fill).groupBy("variable", "level").agg(F.count("*").alias("n"))


def dominance_report(df: DataFrame, cats: Sequence[str], nums: Sequence[str],
                     dominance: float = 0.995, min_sd: float = 1e-8) -> DataFrame:
    """(column, kind, metric, n_levels, kept).

    The metric is a categorical's top share, a numeric's population standard deviation.
    """
    parts = []
    if cats:
        per_var = level_counts(df, cats).groupBy(F.col("variable").alias("column")).agg(
            (F.max("n") / F.sum("n")).alias("metric"), F.count("*").alias("n_levels"))
        parts.append(per_var.select(
            "column", F.lit("categorical").alias("kind"), "metric", "n_levels",
            ((F.col("n_levels") >= 2) & (F.col("metric") <= dominance)).alias("kept")))
    if nums:
        one = df.agg(*[F.stddev_pop(number_filled(df, c)).alias(f"s_{i}") for i, c in enumerate(nums)])
        rows = _wide_to_long(one, nums, {"s": "metric"})
        parts.append(rows.select(
            "column", F.lit("numeric").alias("kind"), "metric",
            F.lit(None).cast("bigint").alias("n_levels"), (F.col("metric") > min_sd).alias("kept")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dominance_filter(df: DataFrame, cats: Sequence[str], nums: Sequence[str],
                     dominance: float = 0.995) -> tuple[list[str], list[str]]:
    """The categoricals and numerics worth analysing, in input order."""
    kept = {r["column"] for r in dominance_report(df, cats, nums, dominance).filter("kept").collect()}
    return [c for c in cats if c in kept], [c for c in nums if c in kept]


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share); nulls are not counted."""
    counts = (df.filter(F.col(column).isNotNull())
              .groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.select("value", "n", (F.col("n") / total).alias("share"))


def table_shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def column_profile(df: DataFrame, top: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, data_type, rank, value, n): the most frequent values, null included.

    Counting combines before the shuffle and the rank filter is applied per map task before
    the window's shuffle, so near-unique columns send only ``top`` rows per task to ranking.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"`{c}`").cast("string").alias("value"))
                      for i, c in enumerate(columns)])
    counts = df.select(F.inline(cells)).groupBy("pos", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("pos").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    ranked = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("pos") + 1)
    dtype = F.element_at(F.array(*[F.lit(types[c]) for c in columns]), F.col("pos") + 1)
    return ranked.select(name.alias("column"), dtype.alias("data_type"), "rank", "value", "n")
