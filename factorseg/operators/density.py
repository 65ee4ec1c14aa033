"""Density clusters of 2-D points at a given radius, noise as -1.

A point is core when at least ``min_samples`` points (itself included) lie within ``eps``;
clusters are the connected components of core points, everything else is noise, and clusters
below ``min_cluster_size`` become noise too.

Points are put on a grid whose cells have diagonal eps, so points sharing a cell are always
neighbours. A cell with ``min_samples`` points therefore needs no distances at all, however many
points it holds, and connectivity is decided between cells. Distances are computed only for
points of sparse cells (fewer than ``min_samples`` each) and between small boxes of two cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from factorseg.operators.encode import with_row_index
from factorseg.operators.lineage import cut_lineage

PAIR_LIMIT = 1024    # two boxes are compared point by point up to this many pairs
SPLIT = 4            # otherwise each box is cut into SPLIT x SPLIT
MAX_LEVEL = 10
NEAR = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0)]
AHEAD = [o for o in NEAR if o > (0, 0)]


def _offsets(pairs) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j"))
                               for i, j in pairs]))


def _grid(v: str, width: float) -> Column:
    return F.floor(F.col(v) / width)


def density_clusters(df: DataFrame, x: str, y: str, eps: float, min_samples: int,
                     min_cluster_size: int = 60, id_col: str = "customer_id") -> DataFrame:
    """(id, cluster) with clusters numbered by descending size."""
    side = eps / math.sqrt(2.0) * (1 - 1e-9)
    points = df.select(id_col, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points = points.withColumns({"cx": _grid("x", side), "cy": _grid("y", side)})
    # copies of a point become one site with a weight
    sites = (points.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
             .groupBy("cx", "cy", "x", "y").agg(F.count("*").alias("w")).persist())
    core = cut_lineage(_core_sites(sites, eps, min_samples))
    cells = core.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    labels = _components(cells.select("cx", "cy"), _cell_edges(core, cells, eps, side))
    member = core.join(labels, ["cx", "cy"])
    sizes = member.groupBy("component").agg(F.sum("w").alias("size")).filter(F.col("size") >= min_cluster_size)
    numbers = with_row_index(sizes, [F.desc("size"), F.asc("component")], "cluster").select("component", "cluster")
    named = member.join(numbers, "component").select("cx", "cy", "x", "y", "cluster")
    out = (points.join(named, ["cx", "cy", "x", "y"], "left")
           .select(id_col, F.coalesce(F.col("cluster").cast("int"), F.lit(-1)).alias("cluster")))
    sites.unpersist()
    return out


def _core_sites(sites: DataFrame, eps: float, min_samples: int) -> DataFrame:
    weight = sites.groupBy("cx", "cy").agg(F.sum("w").alias("cw"))
    known = sites.join(weight, ["cx", "cy"])
    dense = known.filter(F.col("cw") >= min_samples)
    sparse = known.filter(F.col("cw") < min_samples)
    around = sparse.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "cx", "cy", "cw", F.col("w").alias("sw"),
                           _offsets(NEAR).alias("o"))
    around = around.select("sx", "sy", "sw", F.col("cx").alias("scx"), F.col("cy").alias("scy"), "cw",
                           (F.col("cx") + F.col("o.i")).alias("nx"), (F.col("cy") + F.col("o.j")).alias("ny"))
    close = around.join(sites, (F.col("nx") == F.col("cx")) & (F.col("ny") == F.col("cy"))).filter(
        _within(F.col("sx"), F.col("sy"), F.col("x"), F.col("y"), eps))
    enough = (close.groupBy("scx", "scy", "sx", "sy", "sw", "cw").agg(F.sum("w").alias("seen"))
              .filter(F.col("cw") + F.col("seen") >= min_samples))
    return dense.select("cx", "cy", "x", "y", "w").unionByName(enough.select(
        F.col("scx").alias("cx"), F.col("scy").alias("cy"), F.col("sx").alias("x"), F.col("sy").alias("y"),
        F.col("sw").alias("w")))


def _within(ax, ay, bx, by, eps: float) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by) <= eps * eps


def _boxes(core: DataFrame, side: float, level: int) -> DataFrame:
    """Occupied boxes of a level with the box they came from and their number of sites."""
    width, parent = side / SPLIT ** level, side / SPLIT ** max(level - 1, 0)
    return core.groupBy("cx", "cy", _grid("x", parent).alias("px"), _grid("y", parent).alias("py"),
                        _grid("x", width).alias("bx"), _grid("y", width).alias("by")).agg(F.count("*").alias("n"))


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


PAIR = ["a_cx", "a_cy", "b_cx", "b_cy"]
BOX = ["a_bx", "a_by", "b_bx", "b_by"]


def _cell_edges(core: DataFrame, cells: DataFrame, eps: float, side: float) -> DataFrame:
    """Pairs of core cells that hold two points within eps of each other.

    Box pairs are settled by their least and greatest possible distance; only undecided pairs
    of well-filled boxes are cut further, and small ones are compared point by point.
    """
    first = cells.select("cx", "cy", "n", _offsets(AHEAD).alias("o")).select(
        F.col("cx").alias("a_cx"), F.col("cy").alias("a_cy"), F.col("n").alias("a_n"),
        (F.col("cx") + F.col("o.i")).alias("b_cx"), (F.col("cy") + F.col("o.j")).alias("b_cy"))
    second = cells.select(F.col("cx").alias("b_cx"), F.col("cy").alias("b_cy"), F.col("n").alias("b_n"))
    level = 0
    box = {"a_bx": F.col("a_cx"), "a_by": F.col("a_cy"), "b_bx": F.col("b_cx"), "b_by": F.col("b_cy")}
    undecided = cut_lineage(first.join(second, ["b_cx", "b_cy"]).withColumns(box)
                            .select(*PAIR, *BOX, "a_n", "b_n"))
    found = []
    while True:
        small = F.col("a_n") * F.col("b_n") <= PAIR_LIMIT
        last = level == MAX_LEVEL
        found.append(_point_edges(core, undecided if last else undecided.filter(small), eps, side, level))
        if last or not undecided.filter(~small).take(1):
            break
        level += 1
        boxes = _boxes(core, side, level)
        a = _renamed(boxes, "a").withColumnRenamed("a_px", "a_qx").withColumnRenamed("a_py", "a_qy")
        b = _renamed(boxes, "b").withColumnRenamed("b_px", "b_qx").withColumnRenamed("b_py", "b_qy")
        big = undecided.filter(~small).select(*PAIR, *[F.col(c).alias(c.replace("_b", "_q")) for c in BOX])
        child = (big.join(a, ["a_cx", "a_cy", "a_qx", "a_qy"]).join(b, ["b_cx", "b_cy", "b_qx", "b_qy"]))
        width = side / SPLIT ** level
        gap = lambda u, v: F.greatest(F.abs(F.col(u) - F.col(v)) - 1, F.lit(0)) * width
        span = lambda u, v: (F.abs(F.col(u) - F.col(v)) + 1) * width
        near = gap("a_bx", "b_bx") ** 2 + gap("a_by", "b_by") ** 2
        far = span("a_bx", "b_bx") ** 2 + span("a_by", "b_by") ** 2
        tight = 1e-9 * eps * eps  # leave borderline boxes to the points themselves
        child = cut_lineage(child.filter(near <= eps * eps + tight).select(
            *PAIR, *BOX, "a_n", "b_n", (far <= eps * eps - tight).alias("sure")))
        sure = child.filter("sure").select(*PAIR).distinct()
        found.append(sure)
        undecided = cut_lineage(child.filter("not sure").drop("sure").join(sure, PAIR, "left_anti"))
    edges = found[0]
    for f in found[1:]:
        edges = edges.unionByName(f)
    return edges.distinct()


def _point_edges(core: DataFrame, pairs: DataFrame, eps: float, side: float, level: int) -> DataFrame:
    width = side / SPLIT ** level
    placed = core.select("cx", "cy", "x", "y", _grid("x", width).alias("bx"), _grid("y", width).alias("by"))
    if level == 0:
        placed = placed.withColumns({"bx": F.col("cx"), "by": F.col("cy")})
    a, b = _renamed(placed, "a"), _renamed(placed, "b")
    return (pairs.join(a, ["a_cx", "a_cy", "a_bx", "a_by"]).join(b, ["b_cx", "b_cy", "b_bx", "b_by"])
            .filter(_within(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"), eps))
            .select(*PAIR).distinct())


def _components(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(cx, cy, component) by hooking and pointer jumping.

    Each round a cell takes the smallest label around it, passes it on to the cell its old
    label names, and then follows its label once; labels settle in about log(cells) rounds.
    A cell has at most 24 neighbours, so no key of the neighbour join is hot, and the hooks are
    minima, which combine before their shuffle.
    """
    node = lambda a, b: F.struct(F.col(a).alias("cx"), F.col(b).alias("cy"))
    ways = F.explode(F.array(
        F.struct(node("a_cx", "a_cy").alias("src"), node("b_cx", "b_cy").alias("dst")),
        F.struct(node("b_cx", "b_cy").alias("src"), node("a_cx", "a_cy").alias("dst"))))
    links = cut_lineage(edges.select(ways.alias("e")).select("e.src", "e.dst"))
    labels = cut_lineage(cells.select(node("cx", "cy").alias("node"), node("cx", "cy").alias("component")))
    while True:
        near = (links.join(labels, F.col("dst") == F.col("node"))
                .groupBy(F.col("src").alias("node")).agg(F.min("component").alias("best")))
        step = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("best", "component")).alias("low"))
        hooks = step.groupBy(F.col("old").alias("node")).agg(F.min("low").alias("hook"))
        low = cut_lineage(step.join(hooks, "node", "left").select(
            "node", "old", F.least("low", F.coalesce("hook", "low")).alias("low")))
        follow = low.select(F.col("node").alias("low"), F.col("low").alias("jump"))
        moved = cut_lineage(low.join(follow, "low").select("node", "old", F.col("jump").alias("component")))
        labels = moved.select("node", "component")
        if not moved.filter(F.col("old") != F.col("component")).take(1):
            return labels.select("node.cx", "node.cy", "component")
