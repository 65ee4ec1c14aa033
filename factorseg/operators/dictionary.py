"""Lookups in dictionaries that are tables, for code lists too large for literals.

Keys that come in more than 1 / HOT_KEYS of the rows are at most HOT_KEYS - 1, whatever the data; their entries are broadcast. All
other rows join the dictionary by key, where no key is hot, so neither the dictionary nor its hottest key has to fit a task.

Defined results: null keys and keys that are missing give null; a key with several values gives the least; no rows give no
rows; other columns come along (a column named like ``out`` is replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factorseg.functions.columns import strip

HOT_KEYS = 256


def table_lookup(df: DataFrame, column: str, table: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """All columns of ``df`` and ``out``, the dictionary's value for ``column``."""
    kept = [c for c in df.columns if c != out]
    rows = df.select(F.struct(*kept).alias("row"), F.col(column).alias("k"))
    entries = table.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(value).alias("v"))
    counts = rows.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    frequent = counts.filter(F.col("n") * HOT_KEYS > total).select(F.col("k").alias("hot"))
    hot = F.broadcast(frequent.join(entries, F.col("hot") == F.col("key"), "left").select("hot", F.col("v").alias("hot_v")))
    marked = rows.join(hot, F.col("k") == F.col("hot"), "left")
    done = F.col("hot").isNotNull() | F.col("k").isNull()
    cold = marked.filter(~done).select("row", "k").join(entries, F.col("k") == F.col("key"), "left")
    return (marked.filter(done).select("row", F.col("hot_v").alias("v")).unionByName(cold.select("row", "v"))
            .select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("v").alias(out)))


def token_buckets_from(df: DataFrame, column: str, table: DataFrame, key: str, value: str, out: str, sep: str = ",") -> DataFrame:
    """All columns of ``df`` and ``out``: the sorted set of the buckets of the tokens in ``column``, as ``columns.token_buckets``
    gives it for a literal map. Every distinct cell is split and looked up once; null, blank and unknown give an empty array."""
    cells = df.select(F.col(column).alias("cell")).filter("cell IS NOT NULL").distinct()
    tokens = cells.select("cell", F.explode(F.array_distinct(F.transform(F.split("cell", sep), strip))).alias("token"))
    found = table_lookup(tokens, "token", table, key, value, "bucket").filter("bucket IS NOT NULL")
    sets = found.groupBy("cell").agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))
    kept = [c for c in df.columns if c != out]
    looked_up = table_lookup(df, column, sets, "cell", "buckets", out)
    return looked_up.select(*kept, F.coalesce(F.col(out), F.array().cast("array<string>")).alias(out))
