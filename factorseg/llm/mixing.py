"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source with integer weight q of P = sum of q has its j-th block (j from 0) released at slot floor(j * P / q) and due at slot
ceil((j + 1) * P / q). Earliest deadline first over the released blocks gives every slot of a period of P slots to a
source; at every slot each source is less than one block from its exact share. The pattern of one period depends on the
weights alone and repeats.

Rows of a source are put in an order of hashed ids, an epoch of them follows the other, and this stream is cut into blocks of
``block_rows``: a block may hold the end of one epoch and the start of the next, so every slot of the mixture is full and the
shares hold in rows, for sources shorter than a block too. The mixture ends when every row has been used once; sources that
their weight asks for more often start over (``epoch`` 1, 2, ...), so no row is dropped. Rows are numbered in buckets of
bounded size, so a source may hold any share of the rows.

Defined results: a null source is a source of its own; rows without an id sort as an empty id; rows that repeat an id are
separate rows in any order among themselves; no rows give no rows; other columns come along, whatever their names (columns
mix_epoch and mix_position are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK_ROWS = 16
PERIOD = 1000
EXPONENT = 0.9
BUCKET_ROWS = 20_000


def _pattern() -> Column:
    """The source of each slot of one period, as its place in column q (integer weights); p is their sum."""
    state = F.struct(F.transform("q", lambda _: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("slots"))

    def choose(done: Column, t: Column) -> Column:
        # (deadline, source) of each source whose next block is released; the least comes next
        ready = F.transform(done, lambda d, i: F.when(
            F.floor(d * F.col("p") / F.element_at("q", i + 1)) <= t,
            F.struct(F.ceil((d + 1) * F.col("p") / F.element_at("q", i + 1)).alias("due"), i.cast("int").alias("i"))))
        return F.array_min(ready)["i"]

    def slot(s: Column, t: Column) -> Column:
        picked = F.transform(F.array(choose(s["done"], t)), lambda i: F.struct(
            F.transform(s["done"], lambda d, k: d + F.when(k == i, 1).otherwise(0)).alias("done"),
            F.concat(s["slots"], F.array(i)).alias("slots")))
        return picked[0]

    return F.aggregate(F.sequence(F.lit(0), (F.col("p") - 1).cast("int")), state, slot, lambda s: s["slots"])


def schedule(counts: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD,
             exponent: float = EXPONENT) -> DataFrame:
    """(source, n, q, p, blocks, slots, used): weights, slots in a period and blocks used, one row per source.

    ``weights`` gives relative target weights by source; a source without one (or all, by default) gets its number of rows
    to the power ``exponent``. Weights are rounded to 1 / ``period``, at least one slot each. The number of sources is
    bounded by what a mixture of targets is made of; they form one row here.
    """
    asked = F.lit(None).cast("double")
    for name, value in (weights or {}).items():
        asked = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(asked)
    weighted = counts.select("source", "n", F.coalesce(asked, F.pow(F.col("n").cast("double"), F.lit(exponent))).alias("w"))
    row = weighted.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "n", "w"))).alias("all"))
    row = row.withColumn("total", F.aggregate("all", F.lit(0.0), lambda a, x: a + x["w"]))
    row = row.withColumn("q", F.transform("all", lambda x: F.greatest(F.lit(1), F.round(x["w"] * period / F.col("total")).cast("int"))))
    row = row.withColumn("p", F.aggregate("q", F.lit(0), lambda a, x: a + x)).filter("p > 0")
    row = row.withColumn("pattern", _pattern())
    each = row.select("p", "q", "pattern", F.posexplode("all").alias("i", "x")).select(
        "x.source", "x.n", F.element_at("q", F.col("i") + 1).alias("q"), "p", F.ceil(F.col("x.n") / block_rows).alias("blocks"),
        F.filter(F.transform("pattern", lambda s, t: F.when(s == F.col("i"), t)), lambda t: t.isNotNull()).alias("slots"))
    # the slot after the one that uses a source's last new block
    last = F.floor((F.col("blocks") - 1) / F.col("q"))
    end = last * F.col("p") + F.element_at("slots", (F.col("blocks") - 1 - last * F.col("q")).cast("int") + 1) + 1
    each = each.withColumn("stop", each.agg(F.max(end)).scalar())
    full = F.floor(F.col("stop") / F.col("p"))
    rest = F.size(F.filter("slots", lambda t: t < F.col("stop") - F.floor(F.col("stop") / F.col("p")) * F.col("p")))
    return each.withColumn("used", (full * F.col("q") + rest).cast("long")).drop("stop")


def mixed(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD,
          exponent: float = EXPONENT, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns of ``docs`` and (mix_epoch, mix_position); a row comes once for each epoch it is used in.

    Sorted by ``mix_position``, any prefix has each source within one block of its share.
    """
    own = [F.col(c) for c in docs.columns if c not in ("mix_epoch", "mix_position")]
    rows = docs.select(F.struct(*own).alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"))
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    plan = schedule(counts, weights, block_rows, period, exponent)
    buckets = counts.agg(F.floor(F.coalesce(F.sum("n"), F.lit(0)) / BUCKET_ROWS) + 1).scalar()
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = rows.withColumn("key", key).withColumn("bucket", F.floor(head * buckets / F.lit(1 << 32)))
    sizes = placed.groupBy("source", "bucket").agg(F.count("*").alias("size"))
    before = sizes.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                          (F.sum("size").over(W.partitionBy("source").orderBy("bucket")) - F.col("size")).alias("before"))
    inside = F.row_number().over(W.partitionBy("source", "bucket").orderBy("key", "id"))
    numbered = placed.withColumn("inside", inside).join(
        before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select(
        "row", "source", (F.col("before") + F.col("inside") - 1).alias("number"))
    plan = plan.withColumnRenamed("source", "s")
    # a row's places in the stream of its source, one an epoch
    uses = numbered.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("at", F.explode(F.expr(
        f"CASE WHEN number < used * {block_rows} THEN sequence(number, used * {block_rows} - 1, n) ELSE array() END")))
    block = F.floor(F.col("at") / block_rows)
    turn = F.floor(block / F.col("q"))
    slot = turn * F.col("p") + F.element_at("slots", (block - turn * F.col("q")).cast("int") + 1)
    return uses.select("row.*", F.floor(F.col("at") / F.col("n")).alias("mix_epoch"),
                       (slot * block_rows + F.col("at") - block * block_rows).alias("mix_position"))
