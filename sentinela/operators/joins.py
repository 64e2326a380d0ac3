"""Joins in the application's sense (J2, J3, J5, J6): write-back of labels,
semi join on top-N, weight look-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.operators.profile import top_n
from sentinela.plans.hints import bounded_broadcast


def write_back(df: DataFrame, labels: DataFrame, label: str, default, key: str = K.ID) -> DataFrame:
    """Attach ``labels`` (key, label) to every row; rows not scored get ``default``.

    Both sides are large in general, so this is a plain equi join on the key
    (sort-merge or shuffled hash, chosen by Catalyst/AQE).  When the labels
    were computed from ``df`` itself prefer adding the column in place.
    """
    j = df.join(labels.select(key, F.col(label).alias("__lab")), key, "left")
    return j.withColumn(label, F.coalesce(F.col("__lab"), F.lit(default))).drop("__lab")


def attach_predictions(df: DataFrame, predictions: DataFrame, key: str = K.ID) -> DataFrame:
    """The columns of ``predictions`` (key, class, confidence …) on every row of
    ``df``; rows that were not scored get NULL."""
    return df.join(predictions, key, "left")


def semi_top_n(df: DataFrame, col: str, k: int, col2: str | None = None, k2: int | None = None) -> DataFrame:
    """Keep rows whose value is among the ``k`` most frequent (optionally
    also ``col2`` among its ``k2`` most frequent).  The top lists have k rows."""
    out = df.join(F.broadcast(top_n(df, col, k).select(col)), col, "left_semi")
    if col2 is not None:
        out = out.join(F.broadcast(top_n(df, col2, k2 or k).select(col2)), col2, "left_semi")
    return out


def weight_lookup(df: DataFrame, weights: DataFrame, key: str, out: str = "peso",
                  default: int = K.DEFAULT_WEIGHT) -> DataFrame:
    """Category → weight with default, for a weight table given as data
    (columns key, w).  Broadcast after a size check."""
    w = bounded_broadcast(weights.withColumnRenamed("key", "__k").withColumnRenamed("w", "__w"))
    j = df.join(w, F.col(key) == F.col("__k"), "left")
    return j.withColumn(out, F.coalesce(F.col("__w"), F.lit(default))).drop("__k", "__w")
