"""Prefix trie of conversations by a splitter skeleton.

A conversation is a path of turns; every distinct prefix is a node. A turn is named by 16 bytes of the MD5 of its role and text, so a
path is a binary key, and keys in byte order are in depth-first order of the trie. No text leaves the task that reads it.

1. Equal paths collapse to one row with their number, least id and the digest of their ids (streamed in order of id).
2. Splitters, a sample of the paths in order, cut the order into shards. If paths of two shards share a prefix, so does the splitter
   between them: every node that is no prefix of a splitter lies in one shard. The trie of the splitters' prefixes, the
   skeleton, is broadcast; its size is bounded (SAMPLE_BYTES) by cutting long splitters, which stay right as bounds.
3. Each shard is sorted and read once with a stack of the current path: nodes outside the skeleton are finished there; of skeleton
   nodes it sends partial counts, minima and sums.
4. Partial aggregates of a skeleton node are reduced and added up along the skeleton; finished nodes whose parent is a skeleton
   node take its id from there.

Memory: a task holds the stack and up to WAITING finished children of its nodes, until their parent is finished; a conversation's
path is one row (20 bytes a turn). The digest of ids that end at one node is a hash of their list in order, so one task hashes it; it
streams over sorted ids of 8 bytes.

Defined results: null roles and texts are empty; turns are in order of their number (null first), then role, then the MD5 of the
text, so ties and repeated rows have a fixed order and all count; rows without a conversation id belong to no conversation and
are left out; no conversations give no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factorseg.operators.joins import materialize_small
from factorseg.operators.lineage import Scratch, cut_lineage

STEP = 16                      # bytes of a turn in a path
SHARD_STEPS = 20_000           # turns of distinct paths in a shard, on average; more where there are more than MAX_SHARDS
MAX_SHARDS = 20_000
SAMPLE_BYTES = 32 << 20        # of the sample of paths; the splitters, and so the skeleton, are an eighth of it
WAITING = 100_000              # finished children that a node holds; more are given their parent's id by a join
NO_ENDS = hashlib.sha256(b"").hexdigest()
SKELETON_CHILD, LATE_CHILD, LATE_PARENT = -1, -2, -3   # rows that are no partial aggregates, in place of code points
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, steps): each conversation's turns in order as (name binary, chars int)."""
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    digest = F.md5(text.cast("binary"))
    # the role's length keeps (role, digest) apart for all roles
    name = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, digest).cast("binary")))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), name.alias("name"),
        F.length(text).alias("chars"))
    step = F.struct("turn", "role", "digest", "name", "chars")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("all")).select(
        "conv_id", F.transform("all", lambda s: F.struct(s["name"].alias("name"), s["chars"].alias("chars"))).alias("steps"))


def rebuilt(own: DataFrame, bases: DataFrame, base: Column, head: Column) -> DataFrame:
    """(conv_id, steps): the first ``head`` steps of the conversation ``base`` of ``bases`` (all, if fewer; none, if absent), then
    the own steps after the first ``head``."""
    wanted = own.select("conv_id", base.alias("base"), head.alias("head"), "steps")
    bases = bases.select(F.col("conv_id").alias("base_id"), F.col("steps").alias("base_steps"))
    both = wanted.join(bases, F.col("base") == F.col("base_id"), "left")
    first = F.coalesce(F.slice("base_steps", F.lit(1), F.col("head")), F.slice("steps", 1, 0))
    return both.select("conv_id", F.concat(first, F.expr("slice(steps, head + 1, size(steps))")).alias("steps"))


def shared_heads(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Conversations that start with up to five turns of the first one of their hundred, as ``rebuilt`` gives them."""
    own = scratch.cut(paths(turns))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    first = own.filter("conv_id % 100 = 0").select("conv_id", F.slice("steps", 1, 5).alias("steps"))
    return rebuilt(own, first, F.col("conv_id") - F.col("conv_id") % 100, head)


def _collapsed(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(path, chars, n, conv_id, ends): distinct paths with their number, least id and the digest of all ids in order."""
    path = F.array_join(F.transform("steps", lambda s: F.hex(s["name"])), "")
    chars = F.transform("steps", lambda s: s["chars"])
    keyed = scratch.cut(members.select("conv_id", path.alias("hex"), chars.alias("chars")).select(
        "conv_id", F.unhex("hex").alias("path"), "chars", F.unhex(F.md5(F.col("hex").cast("binary"))).alias("key")))

    def digests(batches):
        key, sha, n, low = None, None, 0, None
        for batch in batches:
            done = []
            keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
            for k, c in zip(keys, ids):
                if k != key:
                    if key is not None:
                        done.append((key, n, low, sha.hexdigest()))
                    key, sha, n, low = k, hashlib.sha256(str(c).encode()), 1, c
                else:
                    sha.update(b",%d" % c)
                    n += 1
            if done:
                yield _batch(done)
        if key is not None:
            yield _batch([(key, n, low, sha.hexdigest())])

    def _batch(done):
        key, n, low, ends = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(low, pa.int64()),
                                           pa.array(ends, pa.string())], ["key", "n", "low", "ends"])

    ends = keyed.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(
        digests, "key binary, n long, low long, ends string")
    return scratch.cut(ends.join(keyed.select("conv_id", "path", "chars"), F.col("low") == F.col("conv_id")).select(
        "path", "chars", "n", "conv_id", "ends"))


def _splitters(distinct: DataFrame, shard_steps: int) -> list[bytes]:
    """Bounds between shards, ascending: every eighth of a sample of the paths that is dense in turns, cut to bounded size."""
    total = distinct.agg(F.coalesce(F.sum(F.size("chars") + 1), F.lit(0))).first()[0]
    shards = min(MAX_SHARDS, -(-total // shard_steps))
    if shards < 2:
        return []
    # a path is taken as often as its share of the turns asks for, by its hash: reruns take the same ones
    share = F.least(F.lit(1.0), (F.size("chars") + 1) * (8.0 * shards / total))
    chance = F.pmod(F.xxhash64("path"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    longest = STEP * max(1, SAMPLE_BYTES // (STEP * 8 * shards))
    sample = sorted(r[0] for r in distinct.filter(chance < share).select(
        F.substring("path", 1, longest).cast("binary")).collect())  # about 8 * shards of bounded size
    return sorted({bytes(p) for p in sample[4::8] if len(p)})


class _Node:
    __slots__ = ("key", "n", "low", "children", "leaves", "saved", "chars", "ends", "waiting", "late")

    def __init__(self, key: bytes, chars: int):
        self.key, self.chars, self.n, self.low, self.children = key, chars, 0, None, 0
        self.leaves, self.saved, self.ends, self.waiting, self.late = 0, 0, None, [], False


def trie(members: DataFrame, shard_steps: int = SHARD_STEPS, waiting: int = WAITING) -> DataFrame:
    """One row per node of the trie over ``members`` (conv_id, steps of (name, chars)): conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = members.sparkSession
    scratch = Scratch(spark)
    distinct = _collapsed(members, scratch)
    bounds = _splitters(distinct, shard_steps)
    skeleton = {b""} | {b[:at] for b in bounds for at in range(STEP, len(b) + 1, STEP)}
    sent = spark.sparkContext.broadcast((bounds, skeleton))

    def place(batches):
        bounds = sent.value[0]
        for batch in batches:
            shard = [bisect_right(bounds, p) for p in batch.column("path").to_pylist()]
            yield batch.append_column("shard", pa.array(shard, pa.int32()))

    def finish(batches):
        skeleton = sent.value[1]
        stack: list[_Node] = []
        out: list[tuple] = []

        def close():
            node = stack.pop()
            depth = len(node.key) // STEP
            if stack:
                parent = stack[-1]
                parent.n += node.n
                parent.low = node.low if parent.low is None else min(parent.low, node.low)
            for row in node.waiting:
                out.append((None, *row[:2], node.low, *row[2:], 0))
            if node.late:
                out.append((node.key, node.low, depth, None, 0, 0, 0, 0, None, LATE_PARENT))
            if node.key in skeleton:
                out.append((node.key, node.low, depth, None, node.n, node.children, node.leaves, node.saved, node.ends, node.chars))
                return
            leaves = node.leaves or 1
            saved = node.saved + (node.n - 1) * node.chars
            row = (node.low, depth, node.n, node.children, leaves, saved, node.ends or NO_ENDS)
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved
            if parent.key in skeleton:
                out.append((parent.key, *row[:2], None, *row[2:], SKELETON_CHILD))
                return
            parent.waiting.append(row)
            if len(parent.waiting) > waiting:
                parent.late = True
                out.extend((parent.key, *r[:2], None, *r[2:], LATE_CHILD) for r in parent.waiting)
                parent.waiting.clear()

        def flush():
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.binary()), *[pa.array(c, pa.int64()) for c in columns[1:8]],
                 pa.array(columns[8], pa.string()), pa.array(columns[9], pa.int64())],
                ["skeleton", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "chars"])

        shard = None
        for batch in batches:
            for of, path, chars, n, low, ends in zip(*[batch.column(c).to_pylist() for c in ("shard", "path", "chars", "n", "conv_id", "ends")]):
                if of != shard:
                    while stack:
                        close()
                    shard = of
                    stack.append(_Node(b"", 0))
                while not path.startswith(stack[-1].key):
                    close()
                for d in range(len(stack), len(path) // STEP + 1):
                    stack.append(_Node(path[:d * STEP], chars[d - 1]))
                top = stack[-1]
                top.n += n
                top.low = low if top.low is None else min(top.low, low)
                top.ends = ends
            if out:
                yield flush()
        while stack:
            close()
        if out:
            yield flush()

    placed = distinct.mapInArrow(place, "path binary, chars array<int>, n long, conv_id long, ends string, shard int")
    sharded = placed.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "path")
    schema = "skeleton binary, " + NODE + ", chars long"
    found = scratch.cut(sharded.mapInArrow(finish, schema))
    reduced = found.filter("skeleton is not null and chars >= 0").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("ends_sha256").alias("ends"),
        F.max("chars").alias("chars"))
    nodes = {bytes(r.skeleton): r.asDict() for r in reduced.collect()}  # the skeleton, of bounded size
    for key in sorted(nodes, key=len, reverse=True):
        node = nodes[key]
        node["leaves"] = node["leaves"] or 1
        node["saved"] += (node["n"] - 1) * node["chars"]
        if key:
            parent = nodes[key[:-STEP]]
            parent["children"] += 1
            parent["leaves"] += node["leaves"]
            parent["saved"] += node["saved"]
    done = [(key, node["conv_id"], len(key) // STEP, nodes[key[:-STEP]]["conv_id"] if key else None, node["n"], node["children"],
             node["leaves"], node["saved"], node["ends"] or NO_ENDS) for key, node in nodes.items()]
    top = spark.createDataFrame(done, "skeleton binary, " + NODE)
    columns = [c.split()[0] for c in NODE.split(", ")]

    def under(kind: int, owners: DataFrame) -> DataFrame:
        """Finished nodes of a kind with their parents' ids, from (skeleton, conv_id) of the parents."""
        owners = owners.select(F.col("skeleton").alias("owner"), F.col("conv_id").alias("owner_id"))
        rows = found.filter(F.col("chars") == kind).join(owners, F.col("skeleton") == F.col("owner"))
        return rows.select(*[F.col("owner_id").alias(c) if c == "parent_conv_id" else F.col(c) for c in columns])

    inner = found.filter("skeleton is null").select(*columns)
    late = materialize_small(found.filter(F.col("chars") == LATE_PARENT).select("skeleton", "conv_id"))
    parts = [under(SKELETON_CHILD, F.broadcast(top)), under(LATE_CHILD, late), top.select(*columns)]
    for part in parts:
        inner = inner.unionByName(part)
    out = cut_lineage(inner)
    scratch.drop()
    return out
