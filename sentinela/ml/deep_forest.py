"""Random forests of any depth (M10 and M16 of the case model) and on equal rows that are counted.

Spark's forest grows every tree in the driver. Trees of depth 30 have nearly
as many leaves as rows, so there the trees, not the passes over the rows, are
the work. The bins of up to ``GROUP_ROWS`` rows fit in a task, which is given
all of them and grows some trees from the root (``ml.whole_trees``). Of more
rows, only the upper nodes are grown from histograms that Spark adds up; what
lies below a node of ``DEALT_ROWS`` rows is a group of rows that Spark deals
to a task, which grows the subtree. The trees of a model stay a table; of the
trees that are only scored (folds, settings) the votes for the held-out rows
remain. Both ways give the same trees.

As in Spark: at most 32 bins a feature, draws with replacement (Poisson),
the root of the number of features tried at a node, Gini impurity, a least
number of draws in a leaf. Draws and tried features follow from hashes of the
row, the tree and the path of the node, so a tree does not depend on where its
subtrees begin.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsReadable, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from sentinela.ml import whole_trees
from sentinela.ml.whole_trees import child_keys, mix, tried
from sentinela.plans.hints import settled
from sentinela.session import ensure_checkpoint_dir, ship_package

#: Spark's greatest depth, for a depth of None, and its bins of a feature.
DEEPEST, BINS = 30, 32
#: Rows, and bytes of rows and votes, that a task holds to grow whole trees.
GROUP_ROWS, GROUP_BYTES = 16_000_000, 500_000_000
#: Of more, a node with more rows than this is cut by histograms; nodes with fewer are finished in tasks, bundled up to as many rows.
DEALT_ROWS = 200_000
#: Held-out vectors whose votes are added up at once.
VOTES = 8192
#: Nodes cut in one pass, rows a task, and pairs of row and tree handled at once.
NODES_AT_ONCE, TASK_ROWS, PAIRS = 20_000, 50_000, 1_000_000
#: Shares of classes are added as whole numbers, so that no sum depends on the order.
UNIT = 1 << 32
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 19)]))
DRAWN = np.ceil(POISSON * (1 << 53)).astype(np.uint64)


def draws(row: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """How often each tree (by its key) draws each row: trees x rows."""
    u = (mix(mix(row)[None, :] ^ tree[:, None]) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.searchsorted(POISSON, u, "right").astype(np.uint8)


def merit(left: np.ndarray, total: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How much a cut lessens the Gini impurity, times the rows (-1: not allowed); classes are the last axis."""
    right = total - left
    a, b, n = left.sum(axis=-1), right.sum(axis=-1), total.sum(axis=-1)
    gain = (left ** 2).sum(axis=-1) / np.maximum(a, 1) + (right ** 2).sum(axis=-1) / np.maximum(b, 1) - (total ** 2).sum(axis=-1) / np.maximum(n, 1)
    return np.where((a >= least) & (b >= least) & (gain > 1e-9), gain, -1.0)


@dataclass
class Tops:
    """The upper nodes of all trees: a tree's root has its number; the right child follows the left."""

    feature: np.ndarray   # -1: nothing cut here (yet)
    cut: np.ndarray       # last bin to the left
    left: np.ndarray
    up: np.ndarray        # -1: a root
    depth: np.ndarray
    key: np.ndarray
    tree: np.ndarray
    counts: np.ndarray    # draws of each class (roots: only once cut)

    @classmethod
    def of(cls, keys: np.ndarray, classes: int) -> Tops:
        n = len(keys)
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64), keys,
                   np.arange(n), np.zeros((n, classes)))

    def route(self, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
        if (self.feature < 0).all():
            return node
        at = np.arange(len(node))
        while len(at):
            f = self.feature[node[at]]
            at, f = at[f >= 0], f[f >= 0]
            node[at] = self.left[node[at]] + (bins[at, f] > self.cut[node[at]])
        return node

    def grow(self, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, total: np.ndarray) -> None:
        self.counts[node] = total
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature) + 2 * np.arange(len(node))
        pair = lambda a, b: np.stack([a, b], axis=1).reshape(2 * len(node), *a.shape[1:])
        both = lambda a: pair(a, a)
        new = {"feature": np.full(2 * len(node), -1), "cut": np.zeros(2 * len(node), np.int64), "left": np.zeros(2 * len(node), np.int64),
               "up": both(node), "depth": both(self.depth[node] + 1), "key": pair(child_keys(self.key[node], 0), child_keys(self.key[node], 1)),
               "tree": both(self.tree[node]), "counts": pair(left, total - left)}
        for name, value in new.items():
            setattr(self, name, np.concatenate([getattr(self, name), value]))


@dataclass
class Job:
    """Forests grown together: forest m learns from the parts of ``include`` and votes on those of ``held`` (forests x parts)."""

    include: np.ndarray
    held: np.ndarray
    least: np.ndarray         # least draws in a leaf, by forest
    seeds: Sequence[int]
    trees: int
    classes: int
    features: int
    depth: int = DEEPEST
    prefixes: Sequence[int] = ()   # numbers of trees that are scored apart
    weights: np.ndarray | None = None   # of the classes

    def __post_init__(self):
        each = mix(np.array([s for s in self.seeds for _ in range(self.trees)], np.uint64)) + np.tile(np.arange(self.trees, dtype=np.uint64), len(self.seeds))
        self.keys = mix(each)
        self.some = self.features if self.trees == 1 else int(np.ceil(np.sqrt(self.features)))

    def forest(self, tree: np.ndarray) -> np.ndarray:
        return tree // self.trees

    def segment(self, tree: np.ndarray) -> np.ndarray:
        """Number of the first prefix that holds a tree."""
        return np.searchsorted(np.sort(np.array(self.prefixes or [self.trees])), tree % self.trees, "right")

    def pairs(self, batch: pd.DataFrame, held: bool):
        """(bins, y, row of the pair, tree, draws) of the rows of a batch and the trees that draw (or are to classify) them."""
        bins = np.frombuffer(b"".join(batch.b), np.uint8).reshape(-1, self.features)
        row, y, part = batch.row.to_numpy(), batch.y.to_numpy(), batch.part.to_numpy()
        step = max(1, PAIRS // len(batch))
        for first in range(0, len(self.keys), step):
            trees = np.arange(first, min(first + step, len(self.keys)))
            own = self.forest(trees)
            w = draws(row, self.keys[trees]) * (self.include[own][:, part] > 0).astype(np.uint8)
            t, r = np.nonzero((w > 0) | (self.held[own][:, part] > 0) if held else w > 0)
            yield bins[r], y[r], row[r], trees[t], w[t, r]


# ------------------------------------------------------------------ rows
def edges_of(df: DataFrame) -> list[np.ndarray]:
    """Cuts of each slot of ``x``: between the values if there are at most 32, else at 31 quantiles (of the rows counted by ``n``, if there)."""
    width = len(df.select("x").first()["x"])
    values = df.select(F.posexplode("x").alias("i", "v")).distinct()
    size = {r["i"]: r["k"] for r in values.groupBy("i").agg(F.count(F.lit(1)).alias("k")).collect()}
    few = [i for i in range(width) if size[i] <= BINS]
    found: dict = {i: [] for i in few}
    for r in values.where(F.col("i").isin(few)).collect():
        found[r["i"]].append(r["v"])
    share = [i / BINS for i in range(1, BINS)]
    many = [i for i in range(width) if i not in found]
    at = lambda c: F.percentile(c, share, F.col("n")) if "n" in df.columns else F.percentile_approx(c, share, 10_000)
    cuts = df.agg(*[at(F.col("x")[i]).alias(f"c{i}") for i in many]).first() if many else {}
    return [np.unique(np.array(cuts[f"c{i}"], float)) if i in many else (np.array(sorted(found[i])[:-1]) + np.array(sorted(found[i])[1:])) / 2 for i in range(width)]


def bins_of(x: pd.Series, edges: list[np.ndarray]) -> list[bytes]:
    values = np.vstack(x.to_numpy())
    return [v.tobytes() for v in np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, values.T)], axis=1).astype(np.uint8)]


def binned(df: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """(row, part, y, b): the rows of ``df`` (row, part, y, x) with their bins as bytes, spread over the tasks; ``n`` stays."""
    own = [("row", "long"), ("part", "int"), ("y", "int"), *[("n", "long")] * ("n" in df.columns), ("b", "binary")]
    names = [name for name, _ in own]

    def run(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(b=bins_of(batch.x, edges))[names]

    return df.select(*names[:-1], "x").mapInPandas(run, ", ".join(f"{name} {kind}" for name, kind in own))


def prepared(df: DataFrame, part) -> tuple[DataFrame, list[np.ndarray]]:
    """The binned rows of ``df`` (features, label_idx) in even parts, and the cuts."""
    ship_package(df.sparkSession)
    x = df.where("label_idx is not null").select(part.cast("int").alias("part"), F.col("label_idx").cast("int").alias("y"), vector_to_array("features").alias("x"))
    x = settled(x)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-x.count() // TASK_ROWS))
    edges = edges_of(x)
    return settled(binned(x.withColumn("row", F.monotonically_increasing_id()), edges).repartition(tasks)), edges


def counted(df: DataFrame, part) -> tuple[DataFrame, list[np.ndarray]]:
    """(row, part, y, b, n): distinct bins of ``df`` (features, label_idx, and ``n`` rows that are alike), and the cuts."""
    ship_package(df.sparkSession)
    x = settled(df.where("label_idx is not null").select(part.cast("int").alias("part"), F.col("label_idx").cast("int").alias("y"),
                                                         vector_to_array("features").alias("x"), F.col("n").cast("long").alias("n")))
    if x.isEmpty():
        return x, []
    edges = edges_of(x)
    rows = binned(x.withColumn("row", F.lit(0).cast("long")), edges).groupBy("part", "y", "b").agg(F.sum("n").alias("n"))
    return settled(rows.withColumn("row", F.xxhash64("part", "y", "b"))), edges


# ------------------------------------------------------------------ upper nodes
def upper_nodes(rows: DataFrame, job: Job, sizes: np.ndarray, limit: float) -> Tops:
    """Cuts every node with more than ``limit`` rows: a pass sums histograms of up to ``NODES_AT_ONCE`` nodes."""
    spark = rows.sparkSession
    tops = Tops.of(job.keys, job.classes)
    closed = np.zeros(0, np.int64)
    shape = (job.some, BINS, job.classes)
    while True:
        total = tops.counts.sum(axis=1)
        total[:len(job.keys)] = sizes[job.forest(np.arange(len(job.keys)))]
        pure = (tops.counts > 0).sum(axis=1) == 1
        todo = (tops.feature < 0) & (total > limit) & (tops.depth < job.depth) & ~pure
        todo[closed] = False
        ids = np.flatnonzero(todo)[:NODES_AT_ONCE]
        if not len(ids):
            return tops
        place = np.full(len(tops.feature), -1)
        place[ids] = np.arange(len(ids))
        shared = spark.sparkContext.broadcast((tops, place, tried(tops.key[ids], job.features, job.some), ids))

        def run(batches):
            tops, place, chosen, ids = shared.value
            sums = np.zeros((len(ids), *shape))
            for batch in batches:
                if len(batch):
                    for bins, y, _, tree, w in job.pairs(batch, held=False):
                        at = place[tops.route(bins, tree.copy())]
                        bins, y, w, at = bins[at >= 0], y[at >= 0], w[at >= 0], at[at >= 0]
                        for slot in range(job.some):
                            own = bins[np.arange(len(at)), chosen[at, slot]].astype(np.int64)
                            flat = np.bincount((at * BINS + own) * job.classes + y, w, len(ids) * BINS * job.classes)
                            sums[:, slot] += flat.reshape(len(ids), BINS, job.classes)
            some = np.flatnonzero(sums.any(axis=(1, 2, 3)))
            yield pd.DataFrame({"node": ids[some], "sums": [sums[i].tobytes() for i in some]})

        def best(pdf):
            tops, place, chosen, _ = shared.value
            node = int(pdf.node.iloc[0])
            sums = np.sum([np.frombuffer(s).reshape(shape) for s in pdf.sums], axis=0)
            left, total = sums.cumsum(axis=1), sums[0].sum(axis=0)
            gain = merit(left, total, job.least[job.forest(tops.tree[node])]).ravel()
            at = int(gain.argmax())
            slot, cut = divmod(at, BINS)
            return pd.DataFrame({"node": [node], "feature": [int(chosen[place[node], slot]) if gain[at] > 0 else -1], "cut": [cut],
                                 "own": [left[slot, cut].tolist()], "total": [total.tolist()]})

        found = (rows.mapInPandas(run, "node long, sums binary").groupBy("node")
                 .applyInPandas(best, "node long, feature int, cut int, own array<double>, total array<double>").orderBy("node").toPandas())
        cut = found[found.feature >= 0]
        closed = np.concatenate([closed, np.setdiff1d(ids, cut.node.to_numpy())])
        if len(cut):
            tops.grow(cut.node.to_numpy(), cut.feature.to_numpy(), cut["cut"].to_numpy(), np.vstack(cut.own), np.vstack(cut.total))


def bundles(tops: Tops, job: Job, sizes: np.ndarray, limit: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bundle of each uncut node (-1: cut) and the nodes of each: neighbours of a forest and segment, up to ``limit`` rows together."""
    ends = np.flatnonzero(tops.feature < 0)
    ends = ends[np.lexsort((ends, tops.tree[ends]))]
    group = job.forest(tops.tree[ends]) * (len(job.prefixes) + 1) + job.segment(tops.tree[ends])
    of, members, filled, last = np.full(len(tops.feature), -1), [], 0, -1
    for node, g in zip(ends, group):
        n = tops.counts[node].sum() if tops.depth[node] else sizes[job.forest(tops.tree[node])]
        if g != last or filled + n > limit:
            members.append([])
            filled = 0
        members[-1].append(node)
        of[node], filled, last = len(members) - 1, filled + n, g
    return of, [np.sort(np.array(m)) for m in members]


# ------------------------------------------------------------------ subtrees
def subtrees(root: np.ndarray, bins: np.ndarray, y: np.ndarray, w: np.ndarray, keys: np.ndarray, depth: np.ndarray, least: np.ndarray,
             classes: int, some: int, deepest: int):
    """Grows the subtrees of several roots level by level; yields (draws of each class, feature or -1, cut) of the nodes of
    a level. The children of the i-th node that is cut are 2i and 2i + 1 of the next level."""
    node, features = root.astype(np.int64), bins.shape[1]
    flat, y, w = np.ascontiguousarray(bins).ravel(), y.astype(np.int64), w.astype(float)
    at = np.arange(len(node)) * features
    while len(keys):
        k = len(keys)
        counts = np.bincount(node * classes + y, w, k * classes).reshape(k, classes)
        open_ = (depth < deepest) & ((counts > 0).sum(axis=1) > 1) & (counts.sum(axis=1) >= 2 * least)
        stay = open_[node]
        node, at, y, w = node[stay], at[stay], y[stay], w[stay]
        feature, cut, gain = np.full(k, -1), np.zeros(k, np.int64), np.zeros(k)
        chosen = tried(keys, features, some)
        for slot in range(some if len(node) else 0):
            own = flat[at + chosen[node, slot]].astype(np.int64)
            order = np.sort(((node * BINS + own) << 32) | np.arange(len(node)))
            place, order = order >> 32, order & 0xFFFFFFFF
            cum = np.stack([np.cumsum(w[order] * (y[order] == c)) for c in range(classes)], axis=1)
            ends = np.flatnonzero(np.append(place[1:] != place[:-1], True))
            place, cum = place[ends], cum[ends]
            of = place // BINS
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            before = np.zeros((k, classes))
            before[of[first[1:]]] = cum[first[1:] - 1]
            score = merit(cum - before[of], counts[of], least[of])
            top = np.zeros(k)
            top[of[first]] = np.maximum.reduceat(score, first)
            hit = np.flatnonzero((score == top[of]) & (score > gain[of]))[::-1]
            feature[of[hit]], cut[of[hit]] = chosen[of[hit], slot], place[hit] % BINS
            gain = np.maximum(gain, top)
        yield counts, feature, cut
        split = feature >= 0
        stay = split[node]
        node, at, y, w = node[stay], at[stay], y[stay], w[stay]
        rank = np.cumsum(split) - 1
        node, over = 2 * rank[node], flat[at + feature[node]] > cut[node]
        node = node + over
        pair = lambda a, b: np.stack([a, b], axis=1).ravel()
        keys = pair(child_keys(keys[split], 0), child_keys(keys[split], 1))
        depth, least = np.repeat(depth[split] + 1, 2), np.repeat(least[split], 2)


def shares(counts: np.ndarray) -> np.ndarray:
    return np.rint(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) * UNIT).astype(np.int64)


def added(row: np.ndarray, y: np.ndarray, votes: np.ndarray, **own) -> pd.DataFrame:
    """The votes of each row, added over the trees of a bundle."""
    rows, first, at = np.unique(row, return_index=True, return_inverse=True)
    order = np.argsort(at, kind="stable")
    sums = np.add.reduceat(votes[order], np.searchsorted(at[order], np.arange(len(rows)))) if len(rows) else votes
    return pd.DataFrame({"row": rows, "y": y[first], **own, **{f"s{i}": sums[:, i] for i in range(votes.shape[1])}})


def kinds(width: int) -> tuple[list, list]:
    """Records of a drawn row and of one to classify."""
    return ([("node", "<i8"), ("y", "<u2"), ("w", "u1"), ("bins", "u1", width)],
            [("node", "<i8"), ("y", "<u2"), ("row", "<i8"), ("bins", "u1", width)])


def dealt(rows: DataFrame, job: Job, shared, held: bool, learn: bool = True) -> DataFrame:
    """(bundle, train, held): the rows that the trees of each bundle draw and those that they classify, as bytes."""
    width = job.features

    def run(batches):
        tops, of, _ = shared.value
        for batch in batches:
            if not len(batch):
                continue
            for bins, y, row, tree, w in job.pairs(batch, held):
                node = tops.route(bins, tree.copy())
                bundle = of[node]
                train, other = (np.zeros(len(node), kind) for kind in kinds(width))
                train["node"], train["y"], train["w"], train["bins"] = node, y, w, bins
                other["node"], other["y"], other["row"], other["bins"] = node, y, row, bins
                order = np.argsort(bundle, kind="stable")
                out = []
                for mine in np.split(order, np.flatnonzero(np.diff(bundle[order])) + 1):
                    if len(mine):
                        drawn = w[mine] > 0
                        out.append((int(bundle[mine[0]]), train[mine[drawn]].tobytes() if learn else b"", other[mine[~drawn]].tobytes()))
                yield pd.DataFrame(out, columns=["bundle", "train", "held"])

    return rows.mapInPandas(run, "bundle long, train binary, held binary")


def unpacked(parts, kind: list, members: np.ndarray):
    data = np.frombuffer(b"".join(parts), kind)
    return data, np.searchsorted(members, data["node"])


def rows_seen(rows: DataFrame, job: Job) -> np.ndarray:
    """Rows that each forest learns from."""
    size = {r["part"]: r["n"] for r in rows.groupBy("part").agg((F.sum("n") if "n" in rows.columns else F.count(F.lit(1))).alias("n")).collect()}
    return job.include @ np.array([size.get(p, 0) for p in range(job.include.shape[1])], float)


def grown(rows: DataFrame, job: Job) -> tuple[Tops, np.ndarray, list[np.ndarray]]:
    """Upper nodes, bundle of each, and the nodes of each bundle."""
    sizes, limit = rows_seen(rows, job), min(GROUP_ROWS, DEALT_ROWS)
    tops = upper_nodes(rows, job, sizes, limit)
    return tops, *bundles(tops, job, sizes, limit)


def by_bundle(df: DataFrame, members: list) -> DataFrame:
    """Bundles take about the same time, so they are dealt to several partitions a core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, min(len(members), 2000)), "bundle")


# ------------------------------------------------------------------ whole trees
TABLE_OF_ROWS = "at long, cells binary, y binary, size binary, row binary, part binary, n binary"


def side_by_side(rows: DataFrame, job: Job) -> DataFrame:
    """The rows in the order of their bins and classes, equal ones side by side, some thousands to a record: ``cells`` and
    ``y`` of each vector and class, how many rows have it, ``row`` and ``part`` (and ``n``, if rows are counted) of these."""
    counted = "n" in rows.columns

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(batches):
            if len(batch):
                bins = np.frombuffer(b"".join(batch.b), np.uint8).reshape(-1, job.features)
                y = batch.y.to_numpy().astype("<u2")
                start = np.flatnonzero(np.append(True, (bins[1:] != bins[:-1]).any(axis=1) | (y[1:] != y[:-1])))
                yield pd.DataFrame({"at": [first + i], "cells": [bins[start].tobytes()], "y": [y[start].tobytes()],
                                    "size": [np.diff(np.append(start, len(y))).astype("<u4").tobytes()], "row": [batch.row.to_numpy().astype("<i8").tobytes()],
                                    "part": [batch.part.to_numpy().astype("<u2").tobytes()], "n": [batch.n.to_numpy().astype("<i8").tobytes() if counted else b""]})

    return settled(rows.select("row", "part", "y", "b", *["n"] * counted).sort("b", "y", "row").mapInPandas(run, TABLE_OF_ROWS))


def fits(table: DataFrame, job: Job, numbers: int) -> bool:
    """Whether a task can hold the rows and ``numbers`` votes of each vector that a forest holds out."""
    size = table.agg(F.sum(F.length("row")).alias("rows"), F.sum(F.length("y")).alias("cells")).first()
    rows, cells = (size["rows"] or 0) // 8, (size["cells"] or 0) // 2
    share = max([h.sum() / max(1, h.size) for h in job.held], default=0)
    return rows <= GROUP_ROWS and 10 * rows + (40 + job.features) * cells + 8 * numbers * cells * share <= GROUP_BYTES


@dataclass
class Piece:
    """Trees ``first`` to ``last`` (exclusive) of forests that differ only in the least draws of a leaf."""

    forests: list[int]
    first: int
    last: int


def pieces(job: Job, able: np.ndarray, cores: int) -> list[Piece]:
    """The trees of all forests (``able``: worth growing) in pieces of a segment, largest first, so that all cores end together."""
    alike: dict = {}
    for m in np.flatnonzero(able):
        alike.setdefault((job.seeds[m], job.include[m].tobytes(), job.held[m].tobytes()), []).append(int(m))
    ends = sorted({*job.prefixes, job.trees})
    segments = [(f, a, b) for f in alike.values() for a, b in zip([0, *ends], ends)]
    best = None
    for waves in range(1, 7):
        each = max(1, -(-sum(b - a for _, a, b in segments) // (cores * waves)))
        out = []
        for f, a, b in segments:
            cuts = np.linspace(a, b, -(-(b - a) // each) + 1).astype(int)
            out += [Piece(f, int(x), int(y)) for x, y in zip(cuts, cuts[1:])]
        out.sort(key=lambda p: p.first - p.last)
        busy = np.zeros(cores)
        for p in out:
            busy[busy.argmin()] += p.last - p.first + 2   # reading the table takes as long as a tree or two
        if best is None or busy.max() < 0.95 * best[0]:
            best = busy.max(), out
    return best[1] if segments else []


class Rows:
    """The table in a task: rows a forest learns from, and the vectors that it holds out."""

    def __init__(self, records: list, job: Job, forest: int):
        records.sort(key=lambda r: r["at"].as_py())
        whole = lambda name, kind: np.concatenate([np.frombuffer(r[name].as_buffer(), kind) for r in records])
        self.job = job
        cells, y, size, part = whole("cells", np.uint8).reshape(-1, job.features), whole("y", "<u2"), whole("size", "<u4"), whole("part", "<u2")
        cell = np.repeat(np.arange(len(size), dtype=np.uint32), size)
        learn = job.include[forest][part] > 0
        row = whole("row", "<i8")
        records_n = whole("n", "<i8")
        del records[:]
        self.n = records_n[learn] if len(records_n) else None
        own = cell[learn]
        self.start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        self.cell = own[self.start]
        self.rows, self.y = whole_trees.rows_of(cells[self.cell]), y[self.cell]
        self.row = row[learn].astype(np.uint64) if self.n is not None else mix(row[learn])
        del row, own
        out = job.held[forest][part] > 0
        vector = np.cumsum(np.append(False, (cells[1:] != cells[:-1]).any(axis=1))) if len(cells) else np.zeros(0, np.int64)
        mine = vector[cell[out]]
        counts = np.bincount(mine * job.classes + y[cell[out]], records_n[out] if len(records_n) else None, (vector.max(initial=-1) + 1) * job.classes)
        counts = counts.reshape(-1, job.classes)
        self.met = counts.sum(axis=1) > 0
        first = np.flatnonzero(np.append(True, vector[1:] != vector[:-1])) if len(cells) else np.zeros(0, np.int64)
        self.held, self.counts = whole_trees.rows_of(cells[first[self.met]]), counts[self.met].astype(np.int64)

    def draws(self, key: np.uint64) -> np.ndarray:
        """Draws of each vector and class by a tree."""
        if self.n is not None:
            w = np.random.Generator(np.random.Philox(int(key))).poisson(self.n)
        else:
            w = np.zeros(len(self.row), np.uint8)
            for at in range(0, len(w), PAIRS):
                u = mix(self.row[at:at + PAIRS] ^ key) >> np.uint64(11)
                own = (u >= DRAWN[0]).astype(np.uint8)
                more = np.flatnonzero(u >= DRAWN[1])
                own[more] = np.searchsorted(DRAWN, u[more], "right")
                w[at:at + PAIRS] = own
        return np.add.reduceat(w, self.start, dtype=np.int64) if len(w) else np.zeros(0, np.int64)

    def grow(self, tree: int, least: Sequence[int], seen, held) -> int:
        """Grows the tree with the draws of number ``tree``."""
        job, key = self.job, self.job.keys[tree]
        w = self.draws(key)
        on = np.flatnonzero(w)
        rules = whole_trees.Rules(np.asarray(least), job.classes, job.features, job.some, job.depth, job.weights)
        return whole_trees.grow(self.rows[on], self.y[on], w[on], held, key, rules, seen)


@contextlib.contextmanager
def few_at_once(spark: SparkSession, records: int):
    """Hands Python so many records at once: those of tables and trees are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(records))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_tasks(table: DataFrame, plan: list[Piece], work, schema: str) -> DataFrame:
    """``work(records of the table, piece)`` for each piece, in a task that is given the whole table."""
    given = table.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(len(plan) - 1)))).repartitionById(len(plan), "task")

    def run(batches):
        whole_trees.keep_freed_memory()
        records: dict = {}
        for batch in batches:
            for r in batch.to_struct_array():
                records.setdefault(r["task"].as_py(), []).append(r)
        while records:
            task = min(records)
            for out in work(records.pop(task), plan[task]):
                yield pa.RecordBatch.from_pylist(out, pa_schema)

    pa_schema = to_arrow_schema(_parse_datatype_string(schema))
    return given.mapInArrow(run, schema)


class Ballot:
    """Votes of the trees for each vector: class shares by depth and forest, added up."""

    def __init__(self, vectors: int, depths: list[int], forests: int, job: Job):
        self.depths, self.forests, self.job = np.array(depths), forests, job
        self.sums = np.zeros((vectors, len(depths) * forests * job.classes), np.int64)

    def seen(self, b, cuts, left, keep, leaf) -> None:
        if not len(b.place):
            return
        share = shares(b.counts if self.job.weights is None else b.counts * self.job.weights)
        at = np.searchsorted(self.depths, b.depth)              # the first depth that is not above the node
        here = np.isin(b.depth, self.depths) & (keep > 0)
        full, width, classes = 1 << self.forests, self.forests * self.job.classes, self.job.classes
        for which, mask, last in ((leaf > 0, leaf, True), (here, keep, False)):
            if not which.any():
                continue
            kind = np.where(which & (at < len(self.depths)), at * full + mask, -1)
            mine = kind[b.place]
            for k in np.unique(kind[kind >= 0]):
                rows = np.flatnonzero(mine == k)
                number, votes = b.number[rows], share[b.place[rows]]
                first, m = divmod(int(k), full)
                end = len(self.depths) if last else first + 1
                if m == full - 1:
                    self.sums[number, first * width:end * width] += np.tile(votes, (end - first) * self.forests)
                    continue
                for d in range(first, end):
                    for v in range(self.forests):
                        if m >> v & 1:
                            self.sums[number, d * width + v * classes:d * width + (v + 1) * classes] += votes


def whole_scores(table: DataFrame, job: Job, sizes: np.ndarray, depths: Sequence[int]) -> dict:
    """``fold_scores`` by trees that are grown whole."""
    deep, prefixes, c = sorted(set(depths)), sorted(job.prefixes or [job.trees]), job.classes
    plan = pieces(job, (sizes > 0) & (job.held.sum(axis=1) > 0), table.sparkSession.sparkContext.defaultParallelism)
    plan = [p for p in plan if p.first < prefixes[-1]]
    if not plan:
        return {}

    def by_least(p: Piece) -> list[int]:
        return sorted(p.forests, key=lambda m: (job.least[m], m))

    def work(records, p: Piece):
        rows = Rows(records, job, p.forests[0])
        if not len(rows.held):
            return
        ballot = Ballot(len(rows.held), deep, len(p.forests), job)
        for t in range(p.first, p.last):
            rows.grow(p.forests[0] * job.trees + t, [job.least[m] for m in by_least(p)], ballot.seen, rows.held)
        for at in range(0, len(rows.held), VOTES):
            yield [{"forest": p.forests[0], "block": at // VOTES, "segment": int(job.segment(np.array(p.first))), "votes": ballot.sums[at:at + VOTES].tobytes(),
                    "counts": rows.counts[at:at + VOTES].astype("<i8").tobytes() if p.first == 0 else b""}]

    forests = {p.forests[0]: by_least(p) for p in plan}

    def met(pdf):
        own = forests[int(pdf.forest.iloc[0])]
        counts = np.frombuffer(b"".join(pdf.counts), "<i8").reshape(-1, c)
        every, sums, out = np.arange(len(counts)), np.zeros((len(counts), len(deep), len(own), c), np.int64), []
        for p, n in enumerate(prefixes):
            for v in pdf.votes[pdf.segment == p]:
                sums += np.frombuffer(v, np.int64).reshape(sums.shape)
            best = sums.argmax(axis=3)
            out += [(m, d, n, int(counts[every, best[:, i, j]].sum()), int(counts.sum())) for i, d in enumerate(deep) for j, m in enumerate(own)]
        return pd.DataFrame(out, columns=["forest", "depth", "trees", "met", "n"])

    found = (in_tasks(table, plan, work, "forest int, block int, segment int, votes binary, counts binary").groupBy("forest", "block")
             .applyInPandas(met, "forest int, depth int, trees int, met long, n long").groupBy("forest", "depth", "trees").agg(F.sum("met").alias("met"), F.sum("n").alias("n")))
    with few_at_once(table.sparkSession, 64):
        return {(r["forest"], r["depth"], r["trees"]): (r["met"], r["n"]) for r in found.collect()}


def whole_table(table: DataFrame, job: Job) -> DataFrame:
    """The trees of the one forest of a job, a row each (``TABLE``)."""
    def work(records, p: Piece):
        rows = Rows(records, job, 0)
        for t in range(p.first, p.last):
            told: list = []
            n = rows.grow(t, job.least, lambda b, cuts, left, keep, leaf: told.append((b.own, np.where(keep > 0, cuts.feature, -1), left, cuts.cut, b.counts)), rows.held)
            out = {"feature": np.zeros(n, "<i2"), "left": np.zeros(n, "<i4"), "cut": np.zeros(n, "u1"), "counts": np.zeros((n, job.classes), "<i4")}
            for own, *values in told:
                for column, value in zip(out.values(), values):
                    column[own] = value
            yield [{"bundle": t} | {name: column.tobytes() for name, column in out.items()}]

    return in_tasks(table, pieces(job, np.ones(1, bool), table.sparkSession.sparkContext.defaultParallelism), work, TABLE)


# ------------------------------------------------------------------ votes
def votes(rows: DataFrame, job: Job, depths: Sequence[int]) -> DataFrame:
    """(forest, row, y, segment, s0, s1, ...): the class shares of the held-out rows at each depth (depth by depth, times ``UNIT``),
    added over the trees of a segment in parts. Nothing of the trees is kept."""
    state = grown(rows, job)
    shared = rows.sparkSession.sparkContext.broadcast(state)
    width, deep = job.features, list(depths)

    def run(pdf):
        tops, _, members = shared.value
        own = members[int(pdf.bundle.iloc[0])]
        train, root = unpacked(pdf.train, kinds(width)[0], own)
        other, node = unpacked(pdf.held, kinds(width)[1], own)
        first = int(tops.tree[own[0]])
        start, out = tops.depth[own], np.zeros((len(other), len(deep), job.classes), np.int64)
        for i, d in enumerate(deep):  # depths above the roots
            up = own.copy()
            while (tops.depth[up] > d).any():
                up = np.where(tops.depth[up] > d, tops.up[up], up)
            out[:, i] = np.where((start > d)[node][:, None], shares(tops.counts[up])[node], 0)
        bins, at, begun, level = other["bins"], np.arange(len(other)), start[node], 0
        least = np.full(len(own), job.least[job.forest(first)])
        for counts, feature, cut in subtrees(root, train["bins"], train["y"], train["w"], tops.key[own], start, least, job.classes, job.some, job.depth):
            if not len(at):
                break
            share, leaf = shares(counts)[node], feature[node] < 0
            for i, d in enumerate(deep):
                now = (begun[at] + level == d) | (leaf & (begun[at] + level < d))
                out[at[now], i] = share[now]
            at, node = at[~leaf], node[~leaf]
            rank = np.cumsum(feature >= 0) - 1
            node = 2 * rank[node] + (bins[at, feature[node]] > cut[node])
            level += 1
        return added(other["row"], other["y"], out.reshape(len(other), len(sums)), forest=int(job.forest(first)), segment=int(job.segment(first)))[names]

    sums = [f"s{i}" for i in range(len(deep) * job.classes)]
    names = ["forest", "row", "y", "segment", *sums]
    schema = "forest int, row long, y int, segment int, " + ", ".join(f"{s} long" for s in sums)
    return by_bundle(dealt(rows, job, shared, held=True), state[2]).groupBy("bundle").applyInPandas(run, schema)


def fold_scores(rows: DataFrame, job: Job, depths: Sequence[int]) -> dict:
    """(forest, depth, trees) -> (held-out rows whose class is met, all held-out rows); ties go to the first class. Forests
    without rows to learn from or to vote on are left out."""
    table, own = side_by_side(rows, job), max(Counter(job.seeds).values(), default=1)
    if fits(table, job, len(depths) * own * job.classes):
        sizes = rows_seen(rows, job)
        upper_nodes(rows, job, sizes, np.inf)   # none
        return whole_scores(table, job, sizes, depths)
    if "n" in rows.columns:
        raise ValueError("more distinct rows than a task holds")
    v, prefixes = votes(rows, job, depths), sorted(job.prefixes or [job.trees])
    c = job.classes
    sums = [F.sum(F.when(F.col("segment") <= p, F.col(f"s{i}")).otherwise(0)).alias(f"p{p}_{i}") for p in range(len(prefixes)) for i in range(len(depths) * c)]
    per_row = v.groupBy("forest", "row", "y").agg(*sums)

    def met(p: int, d: int):
        a = F.array(*[F.col(f"p{p}_{d * c + k}") for k in range(c)])
        return F.count_if(F.array_position(a, F.array_max(a)) - 1 == F.col("y"))

    cells = [(p, d) for p in range(len(prefixes)) for d in range(len(depths))]
    found = per_row.groupBy("forest").agg(F.count(F.lit(1)).alias("n"), *[met(p, d).alias(f"m{p}_{d}") for p, d in cells]).collect()
    sizes = rows_seen(rows, job)
    return {(r["forest"], depths[d], prefixes[p]): (r[f"m{p}_{d}"], r["n"]) for r in found if sizes[r["forest"]] for p, d in cells}


def folds_job(folds: int, trees: int, classes: int, features: int, least: Sequence[int], seed: int, depth: int = DEEPEST,
              prefixes: Sequence[int] = ()) -> Job:
    """Forest ``i * folds + f``: least leaf ``least[i]``, of all parts but f, scored on part f."""
    held = np.tile(np.eye(folds), (len(least), 1))
    return Job(1 - held, held, np.repeat(least, folds), [seed + f for _ in least for f in range(folds)], trees, classes, features, depth, prefixes)


# ------------------------------------------------------------------ pipeline stage
class DeepForest(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """The forest as a pipeline stage over ``features`` and ``label_idx``."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "greatest depth", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least draws in a leaf", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)

    @keyword_only
    def __init__(self, numTrees: int = 100, maxDepth: int = DEEPEST, minInstancesPerNode: int = 1, seed: int = 42):
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=DEEPEST, minInstancesPerNode=1, seed=42)
        self._set(**self._input_kwargs)

    def value(self, name: str) -> int:
        return self.getOrDefault(getattr(self, name))

    def _fit(self, dataset: DataFrame) -> DeepForestModel:
        rows, edges = prepared(dataset, F.lit(0))
        classes = rows.agg(F.max("y")).first()[0]
        if classes is None:
            raise ValueError("no rows to train on")
        job = Job(np.ones((1, 1)), np.zeros((1, 1)), np.array([self.value("minInstancesPerNode")]), [self.value("seed")], self.value("numTrees"),
                  classes + 1, len(edges), self.value("maxDepth"))
        path = f"{ensure_checkpoint_dir(rows.sparkSession)}/trees-{uuid.uuid4().hex}"
        together = side_by_side(rows, job)
        if fits(together, job, 0):
            tops = upper_nodes(rows, job, rows_seen(rows, job), np.inf)   # the roots
            with few_at_once(rows.sparkSession, 64):  # a file a tree: a reader holds all rows of a small file at once
                whole_table(together, job).write.option("maxRecordsPerFile", 1).parquet(path)
            return DeepForestModel(path, (tops, np.arange(job.trees), [np.array([t]) for t in range(job.trees)]), edges, job.classes, job.trees)
        state = grown(rows, job)
        shared = rows.sparkSession.sparkContext.broadcast(state)

        def run(pdf):
            tops, _, members = shared.value
            bundle = int(pdf.bundle.iloc[0])
            own = members[bundle]
            train, root = unpacked(pdf.train, kinds(job.features)[0], own)
            levels = list(subtrees(root, train["bins"], train["y"], train["w"], tops.key[own], tops.depth[own],
                                   np.full(len(own), job.least[0]), job.classes, job.some, job.depth))
            feature = np.concatenate([f for _, f, _ in levels])
            first = np.cumsum([0] + [len(f) for _, f, _ in levels])
            left = np.concatenate([first[i + 1] + 2 * (np.cumsum(f >= 0) - 1) for i, (_, f, _) in enumerate(levels)])
            return pd.DataFrame({"bundle": [bundle], "feature": [feature.astype("<i2").tobytes()], "left": [left.astype("<i4").tobytes()],
                                 "cut": [np.concatenate([c for _, _, c in levels]).astype("u1").tobytes()],
                                 "counts": [np.concatenate([n for n, _, _ in levels]).astype("<i4").tobytes()]})

        table = by_bundle(dealt(rows, job, shared, held=False), state[2]).groupBy("bundle").applyInPandas(run, TABLE)
        table.write.parquet(path)
        return DeepForestModel(path, state, edges, job.classes, job.trees)


TABLE = "bundle long, feature binary, left binary, cut binary, counts binary"


class DeepForestModel(Model, MLReadable, MLWritable):
    """A fitted forest: upper nodes in the object, subtrees in a table; adds rawPrediction, probability and prediction."""

    def __init__(self, path: str, state: tuple, edges: list[np.ndarray], classes: int, trees: int):
        super().__init__()
        self.path, self.state, self.edges, self.classes, self.getNumTrees = path, state, edges, classes, trees

    def table(self) -> DataFrame:
        return SparkSession.getActiveSession().read.schema(TABLE).parquet(self.path)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        tops, _, members = self.state
        return self._by_vector(dataset) if len(tops.feature) == len(members) == self.getNumTrees else self._by_row(dataset)

    def _answered(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns of a classifier from the sums of class shares in ``__raw``."""
        total = F.aggregate("__raw", F.lit(0.0), lambda a, b: a + b)
        return df.withColumns({"rawPrediction": array_to_vector("__raw"), "probability": array_to_vector(F.transform("__raw", lambda v: v / total)),
                               "prediction": (F.array_position("__raw", F.array_max("__raw")) - 1).cast("double")}).drop("__raw")

    def _by_vector(self, dataset: DataFrame) -> DataFrame:
        """Every task that reads whole trees is given the distinct vectors, and adds up their votes."""
        spark, classes, width, edges = dataset.sparkSession, self.classes, len(self.edges), self.edges
        bins = F.pandas_udf(lambda x: pd.Series(bins_of(x, edges)) if len(x) else pd.Series([], dtype=object), "binary")
        d = settled(dataset.withColumn("__b", bins(vector_to_array("features"))))

        def side(batches):
            first = TaskContext.get().partitionId() << 32
            for i, batch in enumerate(batches):
                if len(batch):
                    yield pd.DataFrame({"at": [first + i], "n": [len(batch)], "cells": [b"".join(batch["__b"])]})

        given = settled(d.select("__b").where("__b is not null").distinct().mapInPandas(side, "at long, n long, cells binary"))
        if (given.agg(F.sum("n")).first()[0] or 0) * (width + 8 * classes) > GROUP_BYTES // 2:
            return self._by_row(dataset)
        cells = spark.sparkContext.broadcast(b"".join(r["cells"] for r in given.select("at", "cells").orderBy("at").collect()))

        def run(batches):
            whole_trees.keep_freed_memory()
            bins = np.frombuffer(cells.value, np.uint8).reshape(-1, width)
            sums = np.zeros((len(bins), classes), np.int64)
            for batch in batches:
                for r in batch.itertuples():
                    feature, left, cut = np.frombuffer(r.feature, "<i2"), np.frombuffer(r.left, "<i4"), np.frombuffer(r.cut, "u1")
                    share = shares(np.frombuffer(r.counts, "<i4").reshape(-1, classes))
                    for first in range(0, len(bins), PAIRS):
                        some = bins[first:first + PAIRS]
                        node, at = np.zeros(len(some), np.int64), np.arange(len(some))
                        while len(at):
                            at = at[feature[node[at]] >= 0]
                            own = node[at]
                            node[at] = left[own] + (some[at, feature[own]] > cut[own])
                        sums[first:first + PAIRS] += share[node]
            for first in range(0, len(bins), VOTES):
                yield pd.DataFrame({"block": [first], "votes": [sums[first:first + VOTES].tobytes()]})

        def added_up(pdf):
            first = int(pdf.block.iloc[0])
            sums = np.sum([np.frombuffer(v, np.int64).reshape(-1, classes) for v in pdf.votes], axis=0)
            own = [cells.value[i * width:(i + 1) * width] for i in range(first, first + len(sums))]
            return pd.DataFrame({"__b": own, "__raw": list(sums / float(UNIT))})

        voted = self.table().mapInPandas(run, "block long, votes binary").groupBy("block").applyInPandas(added_up, "__b binary, __raw array<double>")
        with few_at_once(spark, 1):
            voted = settled(voted)
        return self._answered(d.join(voted, "__b", "left").drop("__b"))

    def _by_row(self, dataset: DataFrame) -> DataFrame:
        """The rows are dealt to the trees' bundles."""
        spark, classes, width = dataset.sparkSession, self.classes, len(self.edges)
        d = settled(dataset.withColumn("__row", F.monotonically_increasing_id()))
        rows = d.select(F.col("__row").alias("row"), F.lit(0).alias("part"), F.lit(0).alias("y"), vector_to_array("features").alias("x"))
        job = Job(np.zeros((1, 1)), np.ones((1, 1)), np.ones(1), [0], self.getNumTrees, classes, width)
        shared = spark.sparkContext.broadcast(self.state)

        def run(key, left, right):
            own = shared.value[2][int(key[0])]
            if not len(left) or not len(right):
                return pd.DataFrame({"row": [], **{f"s{i}": [] for i in range(classes)}})
            other, node = unpacked(left.held, kinds(width)[1], own)
            tree = right.iloc[0]
            feature, child, cut = np.frombuffer(tree.feature, "<i2"), np.frombuffer(tree.left, "<i4"), np.frombuffer(tree.cut, "u1")
            share, bins, at = shares(np.frombuffer(tree.counts, "<i4").reshape(-1, classes)), other["bins"], np.arange(len(other))
            while len(at):
                at = at[feature[node[at]] >= 0]
                node[at] = child[node[at]] + (bins[at, feature[node[at]]] > cut[node[at]])
            return added(other["row"], other["y"], share[node]).drop(columns="y")

        sums = [f"s{i}" for i in range(classes)]
        given = by_bundle(dealt(binned(rows, self.edges), job, shared, held=True, learn=False), self.state[2])
        each = (given.groupBy("bundle").cogroup(self.table().groupBy("bundle"))
                .applyInPandas(run, "row long, " + ", ".join(f"{s} long" for s in sums)))
        raw = F.transform(F.array(*sums), lambda s: s / F.lit(float(UNIT)))
        per_row = each.groupBy(F.col("row").alias("__row")).agg(*[F.sum(s).alias(s) for s in sums]).select("__row", raw.alias("__raw"))
        return self._answered(d.join(per_row, "__row", "left").drop("__row"))

    @property
    def featureImportances(self) -> DenseVector:
        """Spark's measure: the lessening of impurity of a feature's cuts, as a share in each tree, mean of the trees."""
        tops, _, members = self.state
        width, classes, trees = len(self.edges), self.classes, self.getNumTrees
        shared = self.table().sparkSession.sparkContext.broadcast((tops.tree, members))

        def gains(tree, feature, left, counts):
            out, some = np.zeros((trees, width)), feature >= 0
            np.add.at(out, (tree[some], feature[some]), merit(counts[left[some]], counts[some], np.ones(1)).clip(0))
            return out

        def run(batches):
            of, members = shared.value
            for batch in batches:
                for r in batch.itertuples():
                    feature, left = np.frombuffer(r.feature, "<i2"), np.frombuffer(r.left, "<i4")
                    tree = np.zeros(len(feature), np.int64)
                    level = np.arange(len(members[r.bundle]))
                    tree[level] = of[members[r.bundle]]
                    while len(level):
                        level = level[feature[level] >= 0]
                        tree[left[level]] = tree[left[level] + 1] = tree[level]
                        level = np.concatenate([left[level], left[level] + 1])
                    g = gains(tree, feature, left, np.frombuffer(r.counts, "<i4").reshape(-1, classes).astype(float))
                    t, f = np.nonzero(g)
                    yield pd.DataFrame({"tree": t, "feature": f, "gain": g[t, f]})

        total = gains(tops.tree, tops.feature, tops.left, tops.counts)
        for r in self.table().mapInPandas(run, "tree long, feature long, gain double").groupBy("tree", "feature").agg(F.sum("gain").alias("g")).collect():
            total[r["tree"], r["feature"]] += r["g"]
        mean = (total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)).mean(axis=0)
        return DenseVector(mean / max(mean.sum(), 1e-12))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: DeepForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        tops, of, members = m.state
        body = {"tops": {k: v.tolist() for k, v in vars(tops).items()}, "of": of.tolist(), "members": [x.tolist() for x in members],
                "edges": [e.tolist() for e in m.edges], "classes": m.classes, "trees": m.getNumTrees}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession)
        m.table().write.option("maxRecordsPerFile", max(1, len(members) // m.getNumTrees)).parquet(f"{path}/data")
        self.sparkSession.createDataFrame([(json.dumps(body),)], "body string").write.parquet(f"{path}/upper")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> DeepForestModel:
        body = json.loads(self.sparkSession.read.parquet(f"{path}/upper").first()[0])
        t = body["tops"]
        tops = Tops(**{k: np.array(v, np.uint64 if k == "key" else float if k == "counts" else np.int64) for k, v in t.items()})
        tops.counts = tops.counts.reshape(-1, body["classes"])
        model = self.cls(f"{path}/data", (tops, np.array(body["of"]), [np.array(x) for x in body["members"]]), [np.array(e) for e in body["edges"]],
                         body["classes"], body["trees"])
        model._resetUid(DefaultParamsReader.loadMetadata(path, self.sparkSession)["uid"])
        return model
