"""Anomaly detection (M8 isolation forest, M9 local outlier factor).

Isolation forest, Spark-first:
  1. every row may join every tree: a hash of (key, tree) admits it with a
     chance a little above ``max_samples / n`` (all rows of a smaller table);
  2. ``groupBy(tree).applyInPandas`` builds one small tree per group, from the
     ``max_samples`` rows with the smallest hashes;
  3. the forest (trees × at most 2·max_samples nodes, bounded) is broadcast and
     every row is scored in place by a pandas UDF with vectorised traversal;
  4. the label threshold is the exact (1 − contamination) quantile of the scores.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinela import constants as K
from sentinela.ml.features import standardize
from sentinela.plans.hints import settled
from sentinela.session import ship_package

EULER = 0.5772156649015329


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful search in a binary search tree."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _c_vec(n: np.ndarray) -> np.ndarray:
    out = np.zeros_like(n, dtype=float)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    nb = n[big].astype(float)
    out[big] = 2.0 * (np.log(nb - 1.0) + EULER) - 2.0 * (nb - 1.0) / nb
    return out


def _build_tree(x: np.ndarray, rng: np.random.Generator, limit: int):
    """Isolation tree as flat arrays (feature, threshold, left, right, size, depth)."""
    feat, thr, left, right, size, depth = [], [], [], [], [], []

    def node(idx, d):
        i = len(feat)
        feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1)  # noqa: E702
        size.append(len(idx)); depth.append(d)  # noqa: E702
        if d >= limit or len(idx) <= 1:
            return i
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            return i
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        mask = sub[:, f] < t
        feat[i], thr[i] = f, t
        left[i] = node(idx[mask], d + 1)
        right[i] = node(idx[~mask], d + 1)
        return i
    node(np.arange(len(x)), 0)
    return feat, thr, left, right, size, depth


TREE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("n_sample", T.IntegerType()),
    T.StructField("feat", T.ArrayType(T.IntegerType())), T.StructField("thr", T.ArrayType(T.DoubleType())),
    T.StructField("left", T.ArrayType(T.IntegerType())), T.StructField("right", T.ArrayType(T.IntegerType())),
    T.StructField("size", T.ArrayType(T.IntegerType())), T.StructField("depth", T.ArrayType(T.IntegerType())),
])


def _path_lengths(x: np.ndarray, tree) -> np.ndarray:
    feat, thr, left, right, size, depth = (np.asarray(a) for a in tree)
    node = np.zeros(len(x), dtype=np.int64)
    while True:
        f = feat[node]
        inner = f >= 0
        if not inner.any():
            break
        idx = np.flatnonzero(inner)
        go_left = x[idx, f[idx]] < thr[node[idx]]
        node[idx] = np.where(go_left, left[node[idx]], right[node[idx]])
    return depth[node] + _c_vec(size[node])


def order_statistic(df: DataFrame, col: str, rank: int) -> float:
    """The ``rank``-th smallest value (from 0), exactly: counts in 1,024 ranges, then again
    inside the one that holds the rank, until it holds a single value.  Each turn
    is one pre-aggregated pass; no rows are gathered."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    while low < high:
        at = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(high - low) * 1024.0), F.lit(1023))
        parts = (df.where((F.col(col) >= F.lit(low)) & (F.col(col) <= F.lit(high))).groupBy(at.alias("b"))
                 .agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect())
        for r in sorted(parts, key=lambda r: r["b"]):
            if rank < r["n"]:
                low, high = r["lo"], r["hi"]
                break
            rank -= r["n"]
    return float(low)


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """Quantile of the non-NULL values, interpolated between neighbouring ranks."""
    known = df.where(F.col(col).isNotNull()).select(col)
    n = known.count()
    if not n:
        return None
    at = (n - 1) * q
    low = order_statistic(known, col, int(at))
    return low if at == int(at) else low + (order_statistic(known, col, int(at) + 1) - low) * (at - int(at))


def isolation_forest(df: DataFrame, features: Sequence[str], contamination: float = 0.05,
                     n_trees: int = 100, max_samples: int = 256, seed: int = 42, key: str = K.ID,
                     out: str = "anomalia", score_col: str = "score_anomalia",
                     standardize_features: bool = True) -> DataFrame:
    """M8: isolation-forest labels −1 (anomaly) / 1 (normal) and the score.

    Rows with a NULL feature get label 1 and a NULL score (the original
    scores only complete rows and writes back 1 for the rest).
    """
    if not 0.0 < contamination < 0.5:
        raise ValueError("contamination must be in (0, 0.5)")
    spark = df.sparkSession
    ship_package(spark)
    base = standardize(df, features, prefix="__z_") if standardize_features else \
        df.withColumns({f"__z_{c}": F.col(c).cast("double") for c in features})
    zcols = [f"__z_{c}" for c in features]
    complete = F.lit(True)
    for c in zcols:
        complete = complete & F.col(c).isNotNull()
    x = base.where(complete).select(key, F.array(*zcols).alias("__x"))
    n = x.count()
    if n == 0:
        return df.withColumns({out: F.lit(1), score_col: F.lit(None).cast("double")})
    psi = min(max_samples, n)
    chance = min(1.0, (psi + 5.0 * math.sqrt(psi)) / n)

    def draw(tree):
        return F.xxhash64(F.col(key), tree, F.lit(seed + 1)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: draw(t) < F.lit(chance))
    member = x.select(F.explode(trees).alias("tree"), key, "__x") \
        .withColumn("__draw", draw(F.col("tree")))
    limit = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["__draw", key]).iloc[:psi]
        xs = np.vstack(pdf["__x"].to_numpy()).astype(float)
        rng = np.random.default_rng([seed, t])
        tr = _build_tree(xs, rng, limit)
        return pd.DataFrame([{"tree": t, "n_sample": len(xs), "feat": tr[0], "thr": tr[1], "left": tr[2],
                              "right": tr[3], "size": tr[4], "depth": tr[5]}])
    forest_rows = member.groupBy("tree").applyInPandas(build, TREE_SCHEMA).collect()
    forest = [(r["feat"], r["thr"], r["left"], r["right"], r["size"], r["depth"]) for r in forest_rows]
    norm = c_factor(sum(r["n_sample"] for r in forest_rows) / len(forest_rows))
    bc = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=float)
        xs = np.vstack(rows.to_numpy()).astype(float)
        h = np.mean([_path_lengths(xs, t) for t in bc.value], axis=0)
        return pd.Series(np.power(2.0, -h / norm) if norm else np.full(len(rows), 0.5))
    # every row is scored once; rows with a NULL feature go through the UDF as zeros and lose their score again
    filled = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in zcols])
    res = settled(base.withColumn(score_col, score(filled)).withColumn(score_col, F.when(complete, F.col(score_col))))
    thr = exact_quantile(res.where(F.col(score_col).isNotNull()).select(score_col), score_col, 1.0 - contamination)
    flag = F.when(F.col(score_col) > F.lit(thr), F.lit(-1)).otherwise(F.lit(1))
    return res.select(*df.columns, score_col, flag.alias(out))


# ------------------------------------------------------------------ M9
def _lof(df: DataFrame, features, n_neighbors: int, key: str, vector, standardize_features: bool,
         score_col: str) -> DataFrame | None:
    """(key, score) for the complete rows, or None with fewer than two points."""
    from sentinela.ml.neighbors import collapse, feature_points, knn
    pts = feature_points(df, features, key, vector, standardize_features)
    reps, mapping = collapse(pts, key)
    n = reps.agg(F.sum("w")).first()[0] or 0
    if n < 2:
        return None
    k = min(n_neighbors, int(n) - 1)
    nb = knn(reps, k)
    kd = nb.groupBy("p").agg(F.max("dist").alias("kd"))
    reach = nb.join(kd.withColumnRenamed("p", "q").withColumnRenamed("kd", "kdq"), "q") \
        .withColumn("reach", F.greatest(F.col("kdq"), F.col("dist")))
    lrd = reach.groupBy("p").agg((F.lit(1.0) / (F.sum(F.col("wq") * F.col("reach")) / F.sum("wq")
                                                + F.lit(1e-10))).alias("lrd"))
    ratio = nb.join(lrd.withColumnRenamed("p", "q").withColumnRenamed("lrd", "lrdq"), "q") \
        .groupBy("p").agg((F.sum(F.col("wq") * F.col("lrdq")) / F.sum("wq")).alias("m"))
    score = ratio.join(lrd, "p").select(F.col("p").alias("rid"), (F.col("m") / F.col("lrd")).alias(score_col))
    return mapping.join(score, "rid").select(key, score_col)


def local_outlier_factor(df: DataFrame, features: Sequence[str] | None = None, n_neighbors: int = 20,
                         contamination: float = 0.05, key: str = K.ID, vector: str | None = None,
                         standardize_features: bool = True, out: str = "anomalia",
                         score_col: str = "lof") -> DataFrame:
    """M9: local outlier factor with exact k nearest neighbours (see
    ``ml.neighbors``); label −1 for scores above the exact (1 − contamination)
    quantile.  lrd = 1 / (mean reach distance + 1e-10), as scikit-learn.
    The score table is settled: the threshold and the labels read it instead
    of recomputing the neighbour aggregations."""
    per_row = _lof(df, features, n_neighbors, key, vector, standardize_features, score_col)
    if per_row is None:
        return df.withColumns({out: F.lit(1), score_col: F.lit(None).cast("double")})
    per_row = settled(per_row)
    thr = exact_quantile(per_row, score_col, 1.0 - contamination)
    lab = per_row.withColumn(out, F.when(F.col(score_col) > F.lit(thr), F.lit(-1)).otherwise(F.lit(1)))
    res = df.join(lab, key, "left")
    return res.withColumn(out, F.coalesce(F.col(out), F.lit(1)))


def lof_scores(df: DataFrame, features: Sequence[str] | None = None, n_neighbors: int = 20, key: str = K.ID,
               vector: str | None = None, standardize_features: bool = True) -> DataFrame:
    """(key, lof) only — the deterministic part of M9; no rows with fewer than two points."""
    scores = _lof(df, features, n_neighbors, key, vector, standardize_features, "lof")
    return scores if scores is not None else df.where(F.lit(False)).select(key, F.lit(0.0).alias("lof"))


def detect_anomalies(df: DataFrame, method: str = "isolation_forest", **options) -> DataFrame:
    """One entry by method name (D10): the labelled table of M8 or M9."""
    if method == "isolation_forest":
        return isolation_forest(df, **options)
    if method == "local_outlier_factor":
        return local_outlier_factor(df, **options)
    raise ValueError(f"unknown anomaly method {method!r}; expected isolation_forest or local_outlier_factor")
