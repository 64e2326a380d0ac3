"""Grid search of a random forest (M16) from nine forests instead of 108, all grown in the same passes.

The grid has numbers of trees, depths and least node sizes. Trees of a forest
are independent of each other, so its first n trees are a forest of n trees;
and a tree grows from the root, so a tree cut at depth d is the tree that a
limit of d gives. One forest of the most trees and the greatest depth for each
node size and fold thus has the scores of every number of trees and depth.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentinela.ml.deep_forest import DEEPEST, fold_scores, folds_job, prepared
from sentinela.session import ensure_checkpoint_dir, ship_package

TREES, DEPTHS, SPLITS = (50, 100, 200), (3, 5, 10, None), (2, 5, 10)


def leaf_rows(split: int) -> int:
    """Spark bounds the leaves, not the nodes that are split: the least that a node of ``split`` rows can be halved into."""
    return max(1, split // 2)


class Forest:
    """A fitted forest as arrays, which scores every prefix of its trees at every depth in one walk."""

    def __init__(self, nodes: pd.DataFrame):
        """``nodes``: tree, id (root 0), stats (rows per class), left, right (-1 in a leaf), feature, threshold."""
        nodes = nodes.sort_values(["tree", "id"], kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(nodes.tree))])
        self.roots = start[:-1]
        base = start[nodes.tree.to_numpy()]
        stats = np.stack(nodes.stats.to_numpy())
        self.share = stats / stats.sum(axis=1, keepdims=True)
        left, right = nodes.left.to_numpy(), nodes.right.to_numpy()
        own = np.arange(len(nodes))
        self.left, self.right = np.where(left < 0, own, base + left), np.where(left < 0, own, base + right)
        self.feature = np.maximum(nodes.feature.to_numpy(), 0)
        self.threshold = nodes.threshold.to_numpy()

    def votes(self, x: np.ndarray, trees: Sequence[int], depths: Sequence[int]) -> np.ndarray:
        """Class of each row for each depth and number of trees: depths x trees x rows. Ties go to the first class."""
        deep = sorted(depths)
        total = np.zeros((len(deep), len(x), self.share.shape[1]))
        out = np.zeros((len(depths), len(trees), len(x)), np.int64)
        for t, root in enumerate(self.roots, 1):
            node, step, rows = np.full(len(x), root), 0, np.arange(len(x))
            for k, depth in enumerate(deep):
                while step < depth:
                    down = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
                    step += 1
                    if (down == node).all():  # leaves only
                        step = max(deep)
                    node = down
                total[k] += self.share[node]
            if t in trees:
                best = total.argmax(axis=2)
                for i, depth in enumerate(depths):
                    out[i, list(trees).index(t)] = best[deep.index(depth)]
        return out


def forest_nodes(spark: SparkSession, model: RandomForestClassificationModel) -> pd.DataFrame:
    """The nodes of a fitted forest, from its saved form in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    tree, node = data.columns[0], data.columns[1]
    threshold = F.try_element_at(F.col(f"{node}.split.leftCategoriesOrThreshold"), F.lit(1))
    return data.select(F.col(tree).alias("tree"), F.col(f"{node}.id").alias("id"), F.col(f"{node}.impurityStats").alias("stats"),
                       F.col(f"{node}.leftChild").alias("left"), F.col(f"{node}.rightChild").alias("right"),
                       F.col(f"{node}.split.featureIndex").alias("feature"),
                       F.coalesce(threshold, F.lit(0.0)).alias("threshold")).toPandas()


def hits(model: RandomForestClassificationModel, rows: DataFrame, trees: Sequence[int], depths: Sequence[int]) -> dict:
    """(depth, trees) -> (rows of ``rows`` (features, label_idx) whose class is met, all rows)."""
    spark = rows.sparkSession
    ship_package(spark)
    forest = spark.sparkContext.broadcast(Forest(forest_nodes(spark, model)))

    def run(batches):
        for batch in batches:
            if len(batch):
                votes = forest.value.votes(np.vstack(batch.x.to_numpy()), trees, depths)
                right = (votes == batch.label_idx.to_numpy()[None, None, :]).sum(axis=2)
                yield pd.DataFrame([(d, n, int(right[i, j]), len(batch)) for i, d in enumerate(depths) for j, n in enumerate(trees)],
                                   columns=["depth", "trees", "right", "rows"])

    counted = (rows.select(vector_to_array("features").alias("x"), "label_idx")
               .mapInPandas(run, "depth long, trees long, right long, rows long")
               .groupBy("depth", "trees").agg(F.sum("right").alias("right"), F.sum("rows").alias("rows")))
    return {(r["depth"], r["trees"]): (r["right"], r["rows"]) for r in counted.collect()}


def grid_scores(df: DataFrame, folds: int = 3, seed: int = 42, trees: Sequence[int] = TREES,
                depths: Sequence[int | None] = DEPTHS, splits: Sequence[int] = SPLITS) -> DataFrame:
    """One row per setting: n_estimators, max_depth (null: unlimited), min_samples_split, media, desvio, escolhido.

    ``df`` (features vector, label_idx, fold 0 to folds - 1). ``media`` and
    ``desvio`` are mean and deviation over the folds of the accuracy on the rows
    of the fold; the best mean is chosen, ties go to the fewer trees, the lesser
    depth and the smaller split. A fold without rows does not count; without any
    rows there is no result.
    """
    deepest = [DEEPEST if d is None else d for d in depths]
    found = []
    if folds and not df.isEmpty():
        rows, edges = prepared(df, F.col("fold"))
        classes = rows.agg(F.max("y")).first()[0] + 1
        job = folds_job(folds, max(trees), classes, len(edges), [leaf_rows(s) for s in splits], seed, max(deepest), tuple(sorted(set(trees))))
        met = fold_scores(rows, job, deepest)
        for i, split in enumerate(splits):
            for forest in sorted({m for m, _, _ in met if m // folds == i}):
                found.append((split, {(d, n): met[forest, d, n] for d in deepest for n in trees}))
    rows = []
    for n in trees:
        for depth, deep in zip(depths, deepest):
            for split in splits:
                scores = [h[deep, n][0] / h[deep, n][1] for s, h in found if s == split and h]
                if scores:
                    rows.append((n, depth, split, float(np.mean(scores)), float(np.std(scores))))
    out = df.sparkSession.createDataFrame(rows, "n_estimators int, max_depth int, min_samples_split int, media double, desvio double")
    order = Window.orderBy(F.col("media").desc(), "n_estimators", F.col("max_depth").asc_nulls_last(), "min_samples_split")
    return out.withColumn("escolhido", F.row_number().over(order) == 1)
