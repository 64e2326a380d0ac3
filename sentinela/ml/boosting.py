"""Multiclass gradient-boosted trees (M11, M19) and their cross-validation in the same passes.

The softmax loss has one tree a class and round; all trees of a round share the
binned rows and are grown level by level from histograms of first and second
derivatives. Equal rows count once: the input is first aggregated to distinct
feature vectors with the rows of each part (fold, side of the split) and class.
A model is a set of parts, so the model and the five of a cross-validation are
further trees of the same passes over one table.

Histograms are sums over the table. A table of up to ``CELLS`` distinct vectors
(the risk features have at most zones x weekdays x hours x months) is summed
where the trees are grown; of a larger one each task sums its rows and Spark
adds up. Both ways run the same code and give the same trees.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.plans.hints import settled
from sentinela.session import ship_package

ROUNDS, DEPTH, RATE = 100, 6, 0.1
#: Bins of a feature, ridge on a leaf, least second derivative in a leaf (the usual defaults of boosting libraries).
BINS, RIDGE, LEAST = 64, 1.0, 1.0
#: Distinct feature vectors that are summed in one place, and rounds after which a larger table's margins are written.
CELLS, KEPT_ROUNDS = 500_000, 10


@dataclass
class Plan:
    """What is grown: ``include`` (models x parts) says which rows each model learns from."""

    include: np.ndarray
    classes: int
    edges: list[np.ndarray]
    start: np.ndarray                                        # models x classes: margins before the first round
    depth: int = DEPTH
    rate: float = RATE
    #: Rounds of trees; each (feature, cut, leaf value, gain) with a tree for model m and class k at m * classes + k.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    @property
    def count(self) -> int:
        return len(self.include) * self.classes

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)]).astype(np.int64)


def walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, steps: int) -> np.ndarray:
    """Node (root 0, children 2i + 1 and 2i + 2) of every row in every tree after ``steps`` steps: trees x rows."""
    rows, trees = np.arange(bins.shape[1]), np.arange(len(feature))[:, None]
    node = np.zeros((len(feature), bins.shape[1]), np.int64)
    for _ in range(steps):
        f = feature[trees, node]
        node = 2 * node + 1 + ((f >= 0) & (bins[np.maximum(f, 0), rows] > cut[trees, node]))
    return node


def add_margins(plan: Plan, bins: np.ndarray, margins: np.ndarray, first: int, last: int) -> np.ndarray:
    """Margins (trees x rows) with those of the rounds ``first`` to ``last`` (exclusive) added."""
    for feature, cut, value, _ in plan.trees[first:last]:
        leaf = walk(bins, feature, cut, plan.depth) - ((1 << plan.depth) - 1)
        margins = margins + np.take_along_axis(value, leaf, axis=1)
    return margins


def derivatives(plan: Plan, counts: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the softmax loss, summed over the equal rows of a vector: trees x vectors."""
    m, k = len(plan.include), plan.classes
    z = margins.reshape(m, k, -1)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    seen = np.einsum("mp,rpk->mkr", plan.include, counts)     # rows of each class that a model sees
    total = seen.sum(axis=1, keepdims=True)
    return (seen - total * p).reshape(m * k, -1), (2 * total * p * (1 - p)).reshape(m * k, -1)


def histograms(plan: Plan, bins: np.ndarray, g: np.ndarray, h: np.ndarray, feature: np.ndarray, cut: np.ndarray,
               level: int) -> np.ndarray:
    """Sums of g and h: 2 x features x trees x nodes of the level x BINS."""
    nodes = 1 << level
    slot = (np.arange(plan.count)[:, None] * nodes + walk(bins, feature, cut, level) - (nodes - 1)) * BINS
    out = np.zeros((2, len(bins), plan.count, nodes, BINS))
    for f, own in enumerate(bins):
        at = (slot + own).ravel()
        for i, w in enumerate((g, h)):
            out[i, f] = np.bincount(at, w.ravel(), plan.count * nodes * BINS).reshape(plan.count, nodes, BINS)
    return out


def best_cuts(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none gains), last bin to the left and gain of the best cut: trees x nodes. Ties go to the first."""
    g, h = sums.cumsum(axis=-1)
    gs, hs = g[..., -1:], h[..., -1:]
    gain = g ** 2 / (h + RIDGE) + (gs - g) ** 2 / (hs - h + RIDGE) - gs ** 2 / (hs + RIDGE)
    gain[(h < LEAST) | (hs - h < LEAST)] = 0
    features, trees, nodes, _ = gain.shape
    flat = np.round(np.moveaxis(gain, 0, 2).reshape(trees, nodes, features * BINS), 9)
    at = flat.argmax(axis=-1)
    best = np.take_along_axis(flat, at[..., None], axis=-1)[..., 0]
    some = best > 1e-6
    return np.where(some, at // BINS, -1), np.where(some, at % BINS, 0), np.where(some, best, 0.0)


class Here:
    """The whole table of distinct vectors in one place."""

    def __init__(self, plan: Plan, cells: DataFrame, parts: int):
        self.plan = plan
        x, self.counts = grouped(cells.select("x", "part", "y", "n").toPandas(), parts, plan.classes)
        self.bins = plan.bins(x)
        self.margins = np.repeat(plan.start.reshape(-1, 1), len(x), axis=1)

    def begin(self) -> None:
        self.g, self.h = derivatives(self.plan, self.counts, self.margins)

    def sums(self, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        return histograms(self.plan, self.bins, self.g, self.h, feature, cut, level)

    def end(self) -> None:
        self.margins = add_margins(self.plan, self.bins, self.margins, len(self.plan.trees) - 1, len(self.plan.trees))


class Spread:
    """The table in Spark's partitions, all rows of a vector in one; a task sums its rows, Spark adds up the tasks."""

    def __init__(self, plan: Plan, cells: DataFrame, parts: int):
        self.plan, self.parts, self.written = plan, parts, 0
        rows = cells.groupBy("x").agg(F.collect_list(F.struct("part", "y", "n")).alias("own"))
        start = F.array(*[F.lit(float(v)) for v in plan.start.ravel()])
        self.rows = settled(rows.withColumn("margins", start))

    def begin(self) -> None:
        pass

    def _table(self, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.zeros((len(batch), self.parts, self.plan.classes))
        for i, own in enumerate(batch.own):
            for r in own:
                counts[i, r["part"], r["y"]] += r["n"]
        return self.plan.bins(np.vstack(batch.x.to_numpy())), counts, np.vstack(batch.margins.to_numpy()).T

    def sums(self, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        plan, table, written = self.plan, self._table, self.written
        shape = (2, len(plan.edges), plan.count, 1 << level, BINS)

        def run(batches):
            total = np.zeros(shape)
            for batch in batches:
                if len(batch):
                    bins, counts, margins = table(batch)
                    margins = add_margins(plan, bins, margins, written, len(plan.trees))
                    total += histograms(plan, bins, *derivatives(plan, counts, margins), feature, cut, level)
            flat = total.reshape(2, -1)
            at = np.flatnonzero((flat != 0).any(axis=0))
            yield pd.DataFrame({"slot": at, "g": flat[0, at], "h": flat[1, at]})

        found = (self.rows.mapInPandas(run, "slot long, g double, h double").groupBy("slot")
                 .agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas())
        out = np.zeros((2, int(np.prod(shape[1:]))))
        out[:, found.slot.to_numpy(int)] = found[["g", "h"]].to_numpy().T
        return out.reshape(shape)

    def end(self) -> None:
        if len(self.plan.trees) - self.written < KEPT_ROUNDS:
            return
        plan, table, written = self.plan, self._table, self.written

        def run(batches):
            for batch in batches:
                if len(batch):
                    bins, _, margins = table(batch)
                    batch["margins"] = list(add_margins(plan, bins, margins, written, len(plan.trees)).T)
                    yield batch

        self.rows = settled(self.rows.mapInPandas(run, self.rows.schema))
        self.written = len(plan.trees)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rows"}  # tasks hold no table


def grouped(cells: pd.DataFrame, parts: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vectors, in order, and their rows by part and class."""
    x, own = np.unique(np.vstack(cells.x.to_numpy()), axis=0, return_inverse=True)
    counts = np.zeros((len(x), parts, classes))
    np.add.at(counts, (own.ravel(), cells.part.to_numpy(), cells.y.to_numpy()), cells.n.to_numpy())
    return x, counts


def boost(cells: DataFrame, include: np.ndarray, classes: int, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE,
          most: int = CELLS) -> Plan:
    """The models of ``include`` (models x parts, 0 or 1), grown together from ``cells``.

    ``cells`` (x array<double>, part int, y int, n long): rows of each part and
    class with the feature vector x. A model starts from the logarithm of its class shares.
    """
    ship_package(cells.sparkSession)
    width = len(cells.select("x").first()["x"])
    share = list(np.linspace(0, 1, BINS + 1)[1:-1])
    distinct = settled(cells.select("x").distinct())
    cuts = distinct.agg(*[F.percentile_approx(F.col("x")[i], share, 10_000).alias(f"c{i}") for i in range(width)]).first()
    totals = np.zeros((include.shape[1], classes))
    for r in cells.groupBy("part", "y").agg(F.sum("n").alias("n")).collect():
        totals[r["part"], r["y"]] = r["n"]
    seen = include @ totals
    start = np.log((seen + 1) / (seen + 1).sum(axis=1, keepdims=True))
    plan = Plan(include, classes, [np.unique(np.array(c, float)) for c in cuts], start, depth, rate)
    way = (Here if distinct.count() <= most else Spread)(plan, cells, include.shape[1])
    inner = (1 << depth) - 1
    for _ in range(rounds):
        feature, cut, gain = np.full((plan.count, inner), -1), np.zeros((plan.count, inner), np.int64), np.zeros((plan.count, inner))
        way.begin()
        for level in range(depth):
            sums = way.sums(feature, cut, level)
            own = slice((1 << level) - 1, (2 << level) - 1)
            feature[:, own], cut[:, own], gain[:, own] = best_cuts(sums)
        # The last level's sums, parted by its cuts, are those of the leaves.
        value = leaves(sums, feature[:, own], cut[:, own]) * rate
        plan.trees.append((feature, cut, value, gain))
        way.end()
    return plan


def leaves(sums: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Values of the leaves below the last level: trees x leaves; a node without a cut has all its rows to the left."""
    trees, nodes = feature.shape
    own = sums[:, np.maximum(feature, 0), np.arange(trees)[:, None], np.arange(nodes)[None, :]]  # 2 x trees x nodes x BINS
    whole = own.sum(axis=-1)
    left = np.where(feature >= 0, np.take_along_axis(own.cumsum(axis=-1), np.broadcast_to(cut[None, ..., None], (2, *cut.shape, 1)), axis=-1)[..., 0], whole)
    g, h = np.stack([left, whole - left], axis=-1).reshape(2, trees, 2 * nodes)
    return g / (np.maximum(h, 0) + RIDGE)


def probabilities(plan: Plan, x: np.ndarray) -> np.ndarray:
    """models x rows x classes."""
    margins = add_margins(plan, plan.bins(x), np.repeat(plan.start.reshape(-1, 1), len(x), axis=1), 0, len(plan.trees))
    z = margins.reshape(len(plan.include), plan.classes, -1).transpose(0, 2, 1)
    p = np.exp(z - z.max(axis=2, keepdims=True))
    return p / p.sum(axis=2, keepdims=True)


def fold_accuracies(cells: DataFrame, plan: Plan, held: np.ndarray) -> list[float]:
    """Share of the rows of its held-out parts (``held``: models x parts) whose class a model meets; models without any are left out."""
    shared = cells.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        for batch in batches:
            if len(batch):
                p = probabilities(shared.value, np.vstack(batch.x.to_numpy()))
                right = p.argmax(axis=2) == batch.y.to_numpy()[None, :]
                own = held[:, batch.part.to_numpy()] * batch.n.to_numpy()[None, :]
                yield pd.DataFrame({"model": np.arange(len(held)), "met": (right * own).sum(axis=1).astype(int), "rows": own.sum(axis=1).astype(int)})

    found = cells.select("x", "part", "y", "n").mapInPandas(run, "model long, met long, rows long").groupBy("model").agg(
        F.sum("met").alias("met"), F.sum("rows").alias("rows")).orderBy("model").collect()
    return [r["met"] / r["rows"] for r in found if r["rows"]]


class BoostedTrees(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """The booster as a pipeline stage over ``features`` and ``label_idx``."""

    rounds = Param(Params._dummy(), "rounds", "trees of each class", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of a tree", TypeConverters.toInt)

    @keyword_only
    def __init__(self, rounds: int = ROUNDS, depth: int = DEPTH):
        super().__init__()
        self._setDefault(rounds=ROUNDS, depth=DEPTH)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        cells = settled(cell_counts(dataset, F.lit(0)))
        classes = int(cells.agg(F.max("y")).first()[0] or 0) + 1
        return BoostedTreesModel.of(boost(cells, np.ones((1, 1)), classes, self.getOrDefault(self.rounds), self.getOrDefault(self.depth)))


def cell_counts(dataset: DataFrame, part: Column) -> DataFrame:
    """(x, part, y, n): the distinct vectors of ``features`` with their rows of each part and ``label_idx``."""
    return (dataset.where("label_idx is not null").select(vector_to_array("features").alias("x"), part.cast("int").alias("part"),
                                                          F.col("label_idx").cast("int").alias("y"))
            .groupBy("x", "part", "y").agg(F.count(F.lit(1)).alias("n")))


class BoostedTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted booster as a pipeline stage: adds rawPrediction, probability and prediction; saved as one JSON parameter."""

    trees = Param(Params._dummy(), "trees", "the trees of each class", TypeConverters.toString)

    @keyword_only
    def __init__(self, trees: str = "{}"):
        super().__init__()
        self._setDefault(trees="{}")
        self._set(trees=trees)

    @classmethod
    def of(cls, plan: Plan, model: int = 0) -> BoostedTreesModel:
        own = slice(model * plan.classes, (model + 1) * plan.classes)
        body = {"classes": plan.classes, "depth": plan.depth, "edges": [e.tolist() for e in plan.edges], "start": plan.start[model].tolist(),
                "trees": [[part[own].tolist() for part in t] for t in plan.trees]}
        return cls(trees=json.dumps(body))

    def plan(self) -> Plan:
        body = json.loads(self.getOrDefault(self.trees))
        plan = Plan(np.ones((1, 1)), body["classes"], [np.array(e) for e in body["edges"]], np.array([body["start"]]), body["depth"])
        plan.trees = [tuple(map(np.array, t)) for t in body["trees"]]
        return plan

    @property
    def importances(self) -> np.ndarray:
        """Each feature's share of the gain of all cuts."""
        plan = self.plan()
        out = np.zeros(len(plan.edges))
        for feature, _, _, gain in plan.trees:
            np.add.at(out, feature[feature >= 0], gain[feature >= 0])
        return out / max(out.sum(), 1e-12)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        shared = dataset.sparkSession.sparkContext.broadcast(self.plan())

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(list(probabilities(shared.value, np.vstack(x.to_numpy()))[0])) if len(x) else pd.Series([], dtype=object)

        p = F.col("__p")
        first = F.array_position(p, F.array_max(p)) - 1
        return (dataset.withColumn("__p", score(vector_to_array("features")))
                .withColumns({"rawPrediction": array_to_vector(F.transform(p, lambda v: F.log(v))), "probability": array_to_vector(p),
                              "prediction": first.cast("double")}).drop("__p"))
