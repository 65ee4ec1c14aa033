"""Long/wide helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from factorseg.functions.columns import category_filled


def level_rows(df: DataFrame, keys: Sequence[str], cats: Sequence[str], fill: bool = True) -> DataFrame:
    """(keys.., variable, level) for every categorical column."""
    level = category_filled if fill else (lambda c: F.col(c).cast("string"))
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), level(c).alias("level")) for c in cats])
    return df.select(*keys, F.inline(cells))


def value_rows(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """(keys.., variable, value) for every named numeric expression."""
    cells = F.array(*[F.struct(F.lit(n).alias("variable"), c.cast("double").alias("value"))
                      for n, c in values.items()])
    return df.select(*keys, F.inline(cells))
