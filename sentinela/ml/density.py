"""DBSCAN on cells of side ε/√d (M5).

Two points of one cell are never further apart than ε, so a cell with at least
``min_samples`` points is all core and one node of the cluster graph, however
many points it holds. Only points of the other, sparse cells are compared one
by one, and a cell has a bounded number of neighbours and a sparse cell fewer
than ``min_samples`` points; what is listed grows with the rows and not with
their density. Two crowded cells are joined by an exact closest-pair test on
boxes that are halved until their pair is settled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.ml.neighbors import blocking_dims, sq_dist
from sentinela.plans.hints import settled, written

#: Points of a cell that one task compares with the points of a sparse cell.
BLOCK = 4096
#: Halvings after which a box is one point (a double has no more bits).
HALVINGS = 50


def _gap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Least distance of two boxes; for single points their distance, summed in the same order."""
    one = F.zip_with(F.zip_with(lo_b, hi_a, lambda x, y: x - y), F.zip_with(lo_a, hi_b, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.sqrt(F.aggregate(one, F.lit(0.0), lambda acc, v: acc + v * v))


def _reach(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Largest distance of points of two boxes."""
    one = F.zip_with(F.zip_with(hi_b, lo_a, lambda x, y: x - y), F.zip_with(hi_a, lo_b, lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    return F.sqrt(F.aggregate(one, F.lit(0.0), lambda acc, v: acc + v * v))


def _box(d: int) -> list[Column]:
    return [F.array(*[F.min(F.col("x")[i]) for i in range(d)]).alias("lo"), F.array(*[F.max(F.col("x")[i]) for i in range(d)]).alias("hi"),
            F.min_by("x", "rid").alias("one")]


def _places(side: float) -> Column:
    return F.transform("x", lambda v: F.floor(v / F.lit(side)).cast("long"))


def cell_tables(reps: DataFrame, eps: float, min_samples: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, cells, near): points (rid, x, w, cid, block) with their cell, cells (cid, n, dense, blocks, box), and pairs
    of cells whose boxes are at most ``eps`` apart.

    A cell goes by the smallest id in it. Cells meet by an equi join on coarse
    cells of side ≥ ε over up to three dimensions, and their next neighbours.
    """
    d = len(reps.select("x").first()["x"])
    steps = math.ceil(math.sqrt(d))
    side = eps / math.sqrt(d) * (1 - 1e-9)
    placed = reps.withColumn("cell", _places(side))
    cells = settled(placed.groupBy("cell").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("m"), F.min("rid").alias("cid"), *_box(d))
                    .withColumns({"dense": F.col("n") >= min_samples, "blocks": F.ceil(F.col("m") / BLOCK)}))
    points = settled(placed.join(cells.select("cell", "cid", "blocks", "dense"), "cell")
                     .select("rid", "x", "w", "cid", "dense", F.pmod(F.xxhash64("rid"), F.col("blocks")).alias("block")))
    dims = blocking_dims(reps, d)
    coarse = [F.floor(F.col("cell")[i] / steps).cast("long") for i in dims]
    here = cells.select(*[c.alias(f"k{j}") for j, c in enumerate(coarse)], F.col("cid").alias("b"), F.col("dense").alias("b_dense"),
                        F.col("blocks").alias("b_blocks"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.col("one").alias("b_one"))
    there = cells.select(*[c.alias(f"k{j}") for j, c in enumerate(coarse)], F.col("cid").alias("a"), F.col("dense").alias("a_dense"),
                         F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col("one").alias("a_one"))
    for j in range(len(dims)):
        there = there.withColumn(f"k{j}", F.explode(F.array(*[F.col(f"k{j}") + o for o in (-1, 0, 1)])))
    near = there.join(here, [f"k{j}" for j in range(len(dims))]).where(
        (F.col("a") != F.col("b")) & (_gap(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi")) <= F.lit(eps)))
    return points, cells, settled(near.drop(*[f"k{j}" for j in range(len(dims))]))


def sparse_hits(points: DataFrame, cells: DataFrame, near: DataFrame, eps: float) -> DataFrame:
    """(p, t, t_dense, n): for each point ``p`` of a sparse cell how many rows lie within ``eps`` in each crowded cell t,
    and at each other point t of a sparse cell."""
    own = cells.where("not dense").select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(False).alias("b_dense"), F.col("blocks").alias("b_blocks"))
    targets = near.where("not a_dense").select("a", "b", "b_dense", "b_blocks").unionByName(own)
    left = (points.where("not dense").select(F.col("rid").alias("p"), F.col("x").alias("px"), F.col("cid").alias("a")).join(targets, "a")
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b_blocks") - 1))))
    right = points.select(F.col("rid").alias("q"), F.col("x").alias("qx"), F.col("w").alias("qw"), F.col("cid").alias("b"), "block")
    pairs = left.join(right, ["b", "block"]).where((F.col("p") != F.col("q")) & (sq_dist(F.col("px"), F.col("qx")) <= F.lit(eps)))
    return (pairs.groupBy("p", F.when(F.col("b_dense"), F.col("b")).otherwise(F.col("q")).alias("t"), F.col("b_dense").alias("t_dense"))
            .agg(F.sum("qw").alias("n")))


def _settle(pairs: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """Cell pairs (a, b) of which some box pair is surely within ``eps``, and the box pairs of the others."""
    boxes = [F.col(c) for c in ("a_lo", "a_hi", "b_lo", "b_hi")]
    sure = (sq_dist(F.col("a_one"), F.col("b_one")) <= F.lit(eps)) | (_reach(*boxes) <= F.lit(eps))
    marked = written(pairs.withColumn("sure", sure))
    linked = marked.where("sure").select("a", "b").distinct()
    return linked, marked.drop("sure").join(linked, ["a", "b"], "left_anti")


def closest_pairs(points: DataFrame, pairs: DataFrame, eps: float, d: int) -> DataFrame:
    """(a, b): the cell pairs that hold two points at most ``eps`` apart.

    ``pairs`` (a, b and both boxes) are unsettled. In each step the boxes are
    halved in every dimension; a pair of boxes too far apart goes, and a pair
    of cells is done when a pair of their boxes, or of one point of each, is near enough.
    """
    side = eps / math.sqrt(d) * (1 - 1e-9)
    open_, found = pairs.select("a", "b", F.col("a").alias("a_part"), F.col("b").alias("b_part")), None
    parents: Column = F.col("cid")
    inside = points.where("dense")
    for step in range(1, HALVINGS + 2):
        cids = open_.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        part = F.xxhash64("cid", _places(side / 2 ** step)) if step <= HALVINGS else F.col("rid")
        boxes = written(inside.join(cids, "cid", "left_semi").withColumns({"parent": parents, "part": part})
                        .groupBy("cid", "parent", "part").agg(*_box(d)))
        a = boxes.select(F.col("cid").alias("a"), F.col("parent").alias("a_part"), F.col("part").alias("a_next"),
                         F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col("one").alias("a_one"))
        b = boxes.select(F.col("cid").alias("b"), F.col("parent").alias("b_part"), F.col("part").alias("b_next"),
                         F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.col("one").alias("b_one"))
        near = (open_.join(a, ["a", "a_part"]).join(b, ["b", "b_part"])
                .where(_gap(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi")) <= F.lit(eps)))
        linked, rest = _settle(near, eps)
        found = linked if found is None else found.unionByName(linked)
        open_ = written(rest.select("a", "b", F.col("a_next").alias("a_part"), F.col("b_next").alias("b_part")))
        if open_.isEmpty():
            break
        parents = part
    return found


def density_labels(reps: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(rid, c) of the points (rid, x, w) in a cluster; c is the smallest id of the cluster's core points.

    A border point takes the smallest such cluster within ``eps``.
    """
    from sentinela.ml.cluster import _components
    d = len(reps.select("x").first()["x"])
    points, cells, near = cell_tables(reps, eps, min_samples)
    hits = settled(sparse_hits(points, cells, near, eps))
    alone = points.where("not dense").select(F.col("rid").alias("p"), "w")
    core = settled(alone.join(hits.groupBy("p").agg(F.sum("n").alias("n")), "p", "left").select(
        "p", (F.col("w") + F.coalesce("n", F.lit(0)) >= min_samples).alias("core")))
    cores = core.where("core").select("p")
    nodes = cells.where("dense").select(F.col("cid").alias("v")).unionByName(cores.select(F.col("p").alias("v")))
    joined = hits.join(nodes.withColumnRenamed("v", "t"), "t", "left_semi").select("p", "t")  # t a crowded cell or a core point
    linked, unsettled = _settle(near.where("a_dense and b_dense and a < b"), eps)
    edges = joined.join(cores, "p", "left_semi").select(F.col("p").alias("a"), F.col("t").alias("b")).unionByName(linked)
    comp = written(_components(edges, nodes))
    # Only crowded cells that nothing else has joined need the closest pair.
    ends = comp.select(F.col("v").alias("a"), F.col("c").alias("ca")), comp.select(F.col("v").alias("b"), F.col("c").alias("cb"))
    unsettled = written(unsettled.join(ends[0], "a").join(ends[1], "b").where("ca != cb"))
    if not unsettled.isEmpty():
        more = closest_pairs(points, unsettled, eps, d).join(ends[0], "a").join(ends[1], "b")
        roots = _components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b")), comp.select(F.col("c").alias("v")).distinct())
        comp = written(comp.join(roots.withColumnRenamed("c", "root").withColumnRenamed("v", "c"), "c").select("v", F.col("root").alias("c")))
    crowded = points.where("dense").select("rid", F.col("cid").alias("v")).join(comp, "v").select("rid", "c")
    single = cores.join(comp.withColumnRenamed("v", "p"), "p").select(F.col("p").alias("rid"), "c")
    border = (joined.join(core.where("not core").select("p"), "p", "left_semi").join(comp.withColumnRenamed("v", "t"), "t")
              .groupBy("p").agg(F.min("c").alias("c")).withColumnRenamed("p", "rid"))
    return crowded.unionByName(single).unionByName(border)
