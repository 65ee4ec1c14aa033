"""The most frequent values of every column of a wide table, exactly, without shuffling every distinct value.

One pass: each task keeps a Misra-Gries summary a column (batches are cut before they are merged), at most ``counters`` values with lower bounds of their counts and one
error, the most that any count in the task may be too low by. Bounds and errors add up over tasks. Then, column by column:

- no error: the bounds are the counts, and nothing is read again;
- the bound of the last place asked for exceeds twice the error: every value that may be among the first is a candidate. A second
  pass counts the candidates alone, by a broadcast of at most ``CANDIDATES`` values a column;
- else (near-unique or flat columns): all values are counted, which no summary can spare.

All three ways give the same rows; they differ in what is shuffled. Candidates and decisions are bounded by the number of columns,
not by rows.

Defined results: null is a value like others and ranks before equally frequent ones; ties rank by the value's text; an empty table
gives no rows; a repeated column name is an error; columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from factorseg.operators.lineage import drop_written, written
from factorseg.operators.shipping import ship_by_value

ship_by_value(__name__)

COUNTERS = 512
CANDIDATES = 2048    # values a column counted again by broadcast, at most; a column with more is counted whole
SUMMARY = "pos int, value string, n long, error long"


def _summaries(counters: int, width: int):
    """Batches of text columns to one summary a column."""
    def cut(counts) -> int:
        """What has to be taken off all counts so that at most ``counters`` are left."""
        import numpy as np

        return int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1]) if len(counts) > counters else 0

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, errors = [{} for _ in range(width)], [0] * width
        for batch in batches:
            for i in range(width):
                # a batch is cut before it is merged, so values that come once in it never become Python objects
                found = batch.column(i).value_counts()
                counts = found.field(1).to_numpy()
                off = cut(counts)
                left = np.flatnonzero(counts > off)
                for v, n in zip(found.field(0).take(pa.array(left)).to_pylist(), (counts[left] - off).tolist()):
                    held[i][v] = held[i].get(v, 0) + n
                errors[i] += off
                if len(held[i]) > counters:
                    off = cut(np.fromiter(held[i].values(), np.int64, len(held[i])))
                    held[i] = {v: n - off for v, n in held[i].items() if n > off}
                    errors[i] += off
        for i in range(width):
            # the error stands on a row of its own, with no count
            yield pa.RecordBatch.from_arrays([
                pa.array([i] * (len(held[i]) + 1), pa.int32()), pa.array([*held[i], None], pa.string()),
                pa.array([*held[i].values(), None], pa.int64()),
                pa.array([None] * len(held[i]) + [errors[i]], pa.int64())], names=["pos", "value", "n", "error"])

    return run


def _ranked(counts: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("pos").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("pos", "rank", "value", "n")


def _cells(df: DataFrame, columns: Sequence[str], positions: Sequence[int]) -> DataFrame:
    cells = [F.struct(F.lit(i).alias("pos"), F.col(f"`{columns[i]}`").cast("string").alias("value")) for i in positions]
    return df.select(F.inline(F.array(*cells))) if len(cells) > 1 else df.select(cells[0].alias("cell")).select("cell.*")


def frequent_values(df: DataFrame, top: int = 10, columns: Sequence[str] | None = None, counters: int = COUNTERS) -> DataFrame:
    """(column, data_type, rank, value, n): the ``top`` most frequent values of each column, null included."""
    if counters < top:
        raise ValueError(f"{counters} counters cannot hold the first {top} values")
    columns = list(columns or df.columns)
    if len(set(columns)) < len(columns):
        raise ValueError(f"repeated column names in {columns}")
    spark, types = df.sparkSession, dict(df.dtypes)
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    summary, path = written(texts.mapInArrow(_summaries(counters, len(columns)), SUMMARY))
    bounds = summary.filter("n IS NOT NULL").groupBy("pos", "value").agg(F.sum("n").alias("n"))
    error = summary.filter("n IS NULL").groupBy("pos").agg(F.sum("error").alias("error"))
    # at most ``top`` rows, one error and CANDIDATES + 1 values a column come to the driver
    errors = {r["pos"]: r["error"] for r in error.collect()}
    firsts: dict[int, list] = {}
    for r in _ranked(bounds, top).collect():
        firsts.setdefault(r["pos"], []).append(r)
    done = [r for p, places in firsts.items() if errors[p] == 0 for r in places]
    least = [(p, min(r["n"] for r in places) - errors[p]) for p, places in firsts.items() if errors[p] > 0 and len(places) == top]
    least = [(p, n) for p, n in least if n > errors[p]]
    values: dict[int, list] = {}
    if least:
        fits = bounds.join(F.broadcast(spark.createDataFrame(least, "pos int, least long")), "pos").filter("n >= least")
        for r in _ranked(fits, CANDIDATES + 1).collect():
            values.setdefault(r["pos"], []).append((r["pos"], r["value"]))
    again = [p for p, of in values.items() if len(of) <= CANDIDATES]
    counted = {p for p, e in errors.items() if e == 0} | set(again)
    whole = [i for i in range(len(columns)) if i not in counted]
    drop_written(spark, path)

    parts = [spark.createDataFrame(done, "pos int, rank int, value string, n long")]
    if again:
        wanted = F.broadcast(spark.createDataFrame([v for p in again for v in values[p]], "p int, v string"))
        seen = _cells(df, columns, again).join(wanted, (F.col("pos") == F.col("p")) & F.col("value").eqNullSafe(F.col("v")))
        parts.append(_ranked(seen.groupBy("pos", "value").agg(F.count("*").alias("n")), top))
    for i in whole:
        # each reads its own column, and rows stay as wide as that
        parts.append(_ranked(_cells(df, columns, [i]).groupBy("pos", "value").agg(F.count("*").alias("n")), top))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    at = F.col("pos") + 1
    return out.select(F.element_at(F.array(*[F.lit(c) for c in columns]), at).alias("column"),
                      F.element_at(F.array(*[F.lit(types[c]) for c in columns]), at).alias("data_type"), "rank", "value", "n")
