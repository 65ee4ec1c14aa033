"""Components of sets that reach a Jaccard similarity, given lists of sets that may.

A list (a token and the groups that hold it) can be large, so no list is paired with itself. First every set meets the
leader of its group and the list leader it shares most tokens with; that is linear and settles groups of near copies.
Then pairs are made only between members of different components, and never inside a list's most frequent component.
A pair inside one component cannot change a component, so the result equals that of all pairs of all lists.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factorseg.llm import words
from factorseg.llm.graph import components
from factorseg.operators.lineage import Scratch


def linked(groups: DataFrame, members: DataFrame, full_sets: Callable, similarity: tuple[int, int],
           sized: bool = True) -> DataFrame:
    """(node, component) of the sets ``rep`` that link.

    ``groups`` (leader, n, copies, tokens): the lists each group is in, in the order common to all groups; sets that link
    share a token. If ``sized``, n is the exact set size and ``tokens`` the start of the set in that order, so sizes and
    positions bound the similarity; else the pairs left for the second step are bounded by such tokens. ``members`` (rep, leader): the sets of each group. ``full_sets(bitmap)`` gives
    (id, items) for at least the ids in a broadcast bitmap.
    """
    scratch = Scratch(groups.sparkSession)
    postings = groups.select("leader", "n", "copies", F.posexplode("tokens").alias("pos", "token"))
    # a list is led by the group with the fewest tokens before this one: near copies of a text differ by rare tokens,
    # so that is the text itself or the copy nearest to it
    lead = F.struct("pos", (-F.col("copies")).alias("c"), "leader", "n")
    shared = postings.groupBy("token").agg(F.count("*").alias("size"), F.min(lead).alias("lead")).filter("size > 1")
    postings = scratch.cut(postings.join(shared, "token").select(
        "token", "leader", "n", "pos", *[F.col(f"lead.{c}").alias(f"{c}_b") for c in ("leader", "n", "pos")]))
    near = postings.filter("leader <> leader_b")
    if sized:
        near = near.filter(_possible(similarity))
    nearest = (near.groupBy("leader", "leader_b").agg(F.count("*").alias("shared"))
               .groupBy("leader").agg(F.max(F.struct("shared", "leader_b")).alias("best"))
               .select(F.col("leader").alias("a"), F.col("best.leader_b").alias("b")))
    first = nearest.unionAll(members.filter("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    links = scratch.cut(verified(scratch.cut(first), full_sets, similarity))
    settled = components(links)
    labelled = scratch.cut(members.join(settled, members.rep == settled.node, "left").select(
        "rep", "leader", F.coalesce("component", "rep").alias("comp")))
    postings = postings.select("token", "leader", "n", "pos")
    if not sized:
        postings, full_sets = _prefixed(postings, labelled, full_sets, similarity, scratch)
    second = scratch.cut(open_pairs(postings, labelled, similarity, scratch))
    if second.take(1):
        settled = components(links.unionAll(verified(second, full_sets, similarity)))
    scratch.drop()
    return settled


def _open_lists(postings: DataFrame, labelled: DataFrame) -> DataFrame:
    """Rows of the lists that hold groups of different components, with each group's and the most frequent component."""
    # a group counts as one component only if all its members are in it
    whole = labelled.groupBy("leader").agg(F.min("comp").alias("comp"), F.max("comp").alias("most")).select(
        "leader", F.when(F.col("comp") == F.col("most"), F.col("comp")).otherwise(F.xxhash64("leader", "most")).alias("comp"))
    return apart(postings.join(whole, "leader").select("token", "leader", "n", "pos", "comp"), "token", "comp")


def _prefixed(postings: DataFrame, labelled: DataFrame, full_sets: Callable,
              similarity: tuple[int, int], scratch: Scratch) -> tuple[DataFrame, Callable]:
    """Sized postings of the sets in open lists, over the start of each set from rare to frequent, and those sets.

    Lists found by sketches say little about similarity; sets that reach it share one of these tokens, at bounded places.
    """
    num, den = similarity
    spark = postings.sparkSession
    # written before they are used twice: plans over plans take more of the driver's memory than their rows do
    ids = scratch.cut(_open_lists(postings, labelled).select(F.col("leader").alias("id")).distinct())
    sets = full_sets(spark.sparkContext.broadcast(words.id_bitmap(ids, "id"))).join(ids, "id", "left_semi")
    sets = scratch.cut(sets.dropDuplicates(["id", "items"]))
    bits = words.SKETCH_BITS

    def count(batches):
        cells = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            values = batch.column("items").flatten().to_numpy().view(np.uint64)
            cells += np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        yield from words.cell_rows(cells)

    sketch = spark.sparkContext.broadcast(words.merged_cells(
        sets.select("items").mapInArrow(count, "chunk int, cells binary"), bits))

    def start(batches):
        counts = np.frombuffer(sketch.value, np.uint32)
        for batch in batches:
            own = [items.values.to_numpy().view(np.uint64) for items in batch.column("items")]
            chosen = [words.rarest(o, counts, bits, num, den) for o in own]
            ends = np.concatenate([[0], np.cumsum([len(c) for c in chosen])]).astype(np.int32)
            flat = np.concatenate(chosen) if chosen else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(o) for o in own], pa.int64()), pa.ListArray.from_arrays(ends, flat.view(np.int64))],
                ["leader", "n", "tokens"])

    tokens = sets.mapInArrow(start, "leader long, n long, tokens array<long>").select("leader", "n", F.posexplode("tokens").alias("pos", "token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1").select("token")
    return scratch.cut(tokens.join(shared, "token").select("token", "leader", "n", "pos")), lambda bitmap: sets


def _possible(similarity: tuple[int, int]) -> Column:
    """Whether sizes n and n_b and the positions of the first shared token leave room for the similarity.

    What is shared lies at or after both positions.
    """
    num, den = similarity
    room = F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b"))
    return ((F.col("n") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n") * num)
            & (room * (num + den) >= (F.col("n") + F.col("n_b")) * num))


def verified(pairs: DataFrame, full_sets: Callable, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; the sets are made again from the texts that are needed."""
    num, den = similarity
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    full = full_sets(pairs.sparkSession.sparkContext.broadcast(words.id_bitmap(ids, "id")))
    full = full.repartition("id").dropDuplicates(["id", "items"])  # rows may repeat; the joins need the same shuffle
    left = pairs.join(full.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(full.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return both.filter(common.cast("long") * den >= union.cast("long") * num).select("a", "b")


def apart(side: DataFrame, key: str, comp: str) -> DataFrame:
    """Rows of lists that hold several components, with their list's most frequent one as ``usual``."""
    usual = (side.groupBy(key, comp).agg(F.count("*").alias("n_comp"))
             .groupBy(key).agg(F.count("*").alias("comps"), F.max(F.struct("n_comp", comp)).alias("top"))
             .filter("comps > 1").select(key, F.col(f"top.{comp}").alias("usual")))
    return side.join(usual, key)


def open_pairs(postings: DataFrame, labelled: DataFrame, similarity: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Pairs of sets, of groups that share a token or of one group, that lie in different components.

    Groups that meet must have room for the similarity after the token where they do.
    """
    lists = scratch.cut(_open_lists(postings, labelled))
    outside = lists.filter("comp <> usual")
    right = lists.select("token", *[F.col(c).alias(f"{c}_b") for c in lists.columns if c != "token"])
    apart_ = F.expr("comp <> comp_b and leader <> leader_b and (comp_b = usual_b or leader < leader_b)")
    met = outside.join(right, (outside.token == right.token) & apart_ & _possible(similarity))
    pairs = met.select(F.least("leader", "leader_b").alias("g"), F.greatest("leader", "leader_b").alias("h")).distinct()
    a = labelled.select(F.col("leader").alias("g"), F.col("rep").alias("a"), F.col("comp").alias("ca"))
    b = labelled.select(F.col("leader").alias("h"), F.col("rep").alias("b"), F.col("comp").alias("cb"))
    across = pairs.join(a, "g").join(b, "h").filter("ca <> cb").select("a", "b")
    mixed = scratch.cut(apart(labelled.select("leader", "rep", "comp"), "leader", "comp"))
    within = (mixed.filter("comp <> usual").select("leader", F.col("rep").alias("a"), F.col("comp").alias("ca"))
              .join(mixed.select("leader", F.col("rep").alias("b"), F.col("comp").alias("cb")), "leader")
              .filter("ca <> cb").select("a", "b"))
    return across.unionAll(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
