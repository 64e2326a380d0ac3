"""Clustering operators."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.functions.scalar import round_half_up
from sentinela.ml.features import label_encode, one_hot_stages, standardize
from sentinela.plans.hints import ensure_parallelism, ranked, settled, written


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows per cluster, noise (−1) excluded, by cluster id."""
    return df.where(F.col(cluster) != -1).groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).orderBy(cluster)


def noise_and_count(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Noise rows and number of clusters without noise (one row)."""
    return df.agg(F.count(F.when(F.col(cluster) == -1, 1)).alias("ruido"),
                  F.count_distinct(F.when(F.col(cluster) != -1, F.col(cluster))).alias("clusters"))


def cluster_means(df: DataFrame, cluster: str = "cluster", hour: str = "hora",
                  type_col: str = K.TYPE, zone: str = K.ZONE, digits: int = 2) -> DataFrame:
    """Mean hour and mean alphabetical code of type and zone per cluster."""
    e = label_encode(label_encode(df, type_col, "tipo_idx"), zone, "bairro_idx")
    return (e.groupBy(cluster)
            .agg(round_half_up(F.avg(hour), digits).alias("hora_media"),
                 round_half_up(F.avg("tipo_idx"), digits).alias("tipo_medio"),
                 round_half_up(F.avg("bairro_idx"), digits).alias("bairro_medio"))
            .orderBy(cluster))


# ------------------------------------------------------------------ M4 / M7 / M13
KMEANS_CATEGORICAL = [K.ZONE, K.TYPE, "dia_semana"]
_WORKERS = 4  # concurrent k-means starts (independent Spark jobs)
KMEANS_NUMERIC = ["hora", K.LAT, K.LON]


def feature_pipeline(df: DataFrame, cat_cols: Sequence[str], num_cols: Sequence[str], out: str = "features") -> list:
    """Dummies + numbers → vector → z-scores.

    ``StandardScaler`` divides by the sample deviation; that differs from the
    population deviation by the same factor sqrt((n−1)/n) for every feature,
    so distances, cluster assignments and silhouettes are unchanged.  The
    means are not subtracted either: that moves all points alike, and the
    dummies stay sparse.
    """
    return one_hot_stages(df, cat_cols, num_cols, "__raw") + [
        StandardScaler(inputCol="__raw", outputCol=out, withMean=False, withStd=True)]


def kmeans(df: DataFrame, k: int = 5, seed: int = 42, n_init: int = 10,
           cat_cols: Sequence[str] = KMEANS_CATEGORICAL, num_cols: Sequence[str] = KMEANS_NUMERIC,
           max_iter: int = 300, out: str = "cluster"):
    """M4: k-means on standardised dummies and numbers; the best of ``n_init``
    seeded runs (lowest within-cluster cost) is kept.

    Returns (labelled frame, fitted feature PipelineModel, KMeansModel); the
    models are None if no row has all features.  Rows
    with a NULL feature take no part in the fit; they stay in the table with
    label −1 and no feature vector.  Only the feature vectors are cached, for
    the runs; every row is labelled by the fitted model in place.
    """
    whole = F.lit(True)
    for c in [*cat_cols, *num_cols]:
        whole = whole & F.col(c).isNotNull()
    complete = df.where(whole)
    rest = df.where(~whole).withColumns({out: F.lit(-1), "features": F.lit(None).cast(VectorUDT())})
    if complete.isEmpty():
        return rest.select(*df.columns, "features", out), None, None
    feats = Pipeline(stages=feature_pipeline(complete, cat_cols, num_cols)).fit(complete)
    vectors = feats.transform(complete)
    x = ensure_parallelism(vectors.select("features")).persist(StorageLevel.MEMORY_AND_DISK)
    from concurrent.futures import ThreadPoolExecutor

    def fit(i):
        m = KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="features", predictionCol=out).fit(x)
        return m.summary.trainingCost, i, m
    try:
        # the starts are independent Spark jobs: submit them concurrently
        with ThreadPoolExecutor(max_workers=min(n_init, _WORKERS)) as pool:
            fits = list(pool.map(fit, range(n_init)))
    finally:
        x.unpersist()
    best = min(fits, key=lambda t: (t[0], t[1]))[2]
    labelled = best.transform(vectors).select(*df.columns, "features", F.col(out).cast("int").alias(out))
    return labelled.unionByName(rest), feats, best


def silhouette(df: DataFrame, features: str = "features", label: str = "cluster",
               exclude_noise: bool = True) -> float:
    """M7: mean silhouette with squared Euclidean distance (Spark's
    ``ClusteringEvaluator``, O(n·k)); 0 when it cannot be computed (fewer than
    two clusters).  The exact Euclidean silhouette is quadratic in the rows
    and is not computed on full data."""
    d = df.where((F.col(label) != -1) & F.col(features).isNotNull()) if exclude_noise else df
    if d.select(label).distinct().limit(2).count() < 2:
        return 0.0
    ev = ClusteringEvaluator(featuresCol=features, predictionCol=label, distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(d.withColumn(label, F.col(label).cast("double"))))


def cluster_profile(df: DataFrame, cluster: str = "cluster", k: int = 5, ts: str = K.TS) -> DataFrame:
    """Per cluster, the top-``k`` types and zones with count, percent of
    the cluster and rank — long form (cluster, dimensao, valor, n, pct, rank).

    Counts per (cluster, value) are aggregated first; the ranking window is
    partitioned by (cluster, dimension) over that small table.
    """
    pairs = F.explode(F.array(F.struct(F.lit(K.TYPE).alias("dimensao"), F.col(K.TYPE).alias("valor")),
                              F.struct(F.lit(K.ZONE).alias("dimensao"), F.col(K.ZONE).alias("valor"))))
    long = df.where(F.col(cluster) != -1).select(cluster, pairs.alias("p")).select(cluster, "p.*")
    cnt = long.groupBy(cluster, "dimensao", "valor").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(cluster, "dimensao")
    cnt = cnt.withColumn("__t", F.sum("n").over(w)).where(F.col("valor").isNotNull())
    cnt = cnt.withColumn("rank", F.row_number().over(w.orderBy(F.col("n").desc(), F.col("valor").asc())))
    from sentinela.functions.scalar import pct
    return cnt.where(F.col("rank") <= k).select(cluster, "dimensao", "valor", "n", pct("n", "__t", 1).alias("pct"),
                                                 F.col("rank").cast("int").alias("rank"))


# ------------------------------------------------------------------ M5 DBSCAN
def _components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connected components by hooking and contraction.

    ``edges`` (a, b) undirected, ``nodes`` (v).  Each round every node of the
    current graph hooks to its smallest neighbour (or itself), labels are
    composed through the hook map, and the edge list is rewritten on the
    hooked ids with self-loops and duplicates removed.  Every non-isolated
    node merges with another one, so the graph at least halves per round, and
    the rounds end when no edge is left.  Each round's state is written to the
    shared folder.  Returns (v, c) with c = smallest node id of v's
    component.
    """
    lab = nodes.select("v", F.col("v").alias("c"))
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    e = written(e.distinct())
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.min("b").alias("m"))
                       .select(F.col("a").alias("x"), F.least(F.col("a"), F.col("m")).alias("px")))
        lab = written(lab.join(hook.withColumnRenamed("x", "c"), "c", "left")
                      .select("v", F.coalesce(F.col("px"), F.col("c")).alias("c")))
        h1 = hook.select(F.col("x").alias("a"), F.col("px").alias("pa"))
        h2 = hook.select(F.col("x").alias("b"), F.col("px").alias("pb"))
        e = written(e.join(h1, "a", "left").join(h2, "b", "left")
                    .select(F.coalesce("pa", "a").alias("a0"), F.coalesce("pb", "b").alias("b0"))
                    .select(F.least("a0", "b0").alias("a"), F.greatest("a0", "b0").alias("b"))
                    .where(F.col("a") != F.col("b")).distinct())
    return lab


def dbscan(df: DataFrame, features: Sequence[str] | None = None, eps: float = 0.3, min_samples: int = 10,
           key: str = K.ID, vector: str | None = None, standardize_features: bool = True,
           out: str = "cluster") -> DataFrame:
    """M5: density clusters 0.. and noise −1 (scikit-learn semantics: a point is
    core if at least ``min_samples`` points, itself included, lie within
    ``eps``).  Border points take the smallest neighbouring cluster; cluster
    numbers follow the smallest id of their core points.  Rows with a NULL
    feature get −1.  Crowded places cost cells, not pairs (``ml.density``)."""
    from sentinela.ml.density import density_labels
    from sentinela.ml.neighbors import collapse, feature_points
    pts = feature_points(df, features, key, vector, standardize_features)
    reps, mapping = collapse(pts, key)
    reps = settled(reps)
    if reps.isEmpty():
        return df.withColumn(out, F.lit(-1))
    labels = settled(density_labels(reps, eps, min_samples))
    # dense numbering in order of the smallest core id
    ids = ranked(labels.select("c").distinct(), ["c"], out).withColumn(out, F.col(out).cast("int"))
    lab = labels.join(ids, "c").select("rid", out)
    per_row = settled(mapping.join(lab, "rid", "left").select(key, F.coalesce(F.col(out), F.lit(-1)).alias(out)))
    res = df.join(per_row, key, "left")
    return res.withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


# ------------------------------------------------------------------ M6 hierarchical (re-aimed)
class _Noise:
    """The numbers of ``java.util.Random``, with which Spark's bisecting k-means parts two new centres."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> (48 - n)

    def __call__(self) -> float:
        return ((self._bits(26) << 27) + self._bits(27)) / float(1 << 53)


def _branch(cols: Sequence[str], centers: dict[int, list[float]], leaf, node: int = 1) -> Column:
    """``leaf(node)`` of the node that a row of ``cols`` comes down to: at each fork the nearer centre, ties to the left."""
    sides = [n for n in (2 * node, 2 * node + 1) if n in centers]
    if not sides:
        return F.lit(leaf(node))
    down = [_branch(cols, centers, leaf, n) for n in sides]
    if len(down) == 1:
        return down[0]
    left, right = [sum(((F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip(cols, centers[n])), F.lit(0.0)) for n in sides]
    return F.when(left <= right, down[0]).otherwise(down[1])


def bisect(x: DataFrame, cols: Sequence[str], k: int, seed: int, max_iter: int) -> dict[int, list[float]]:
    """Centres of the clusters' tree (root 1, children 2n and 2n + 1) by the method, starts and rounds of Spark's
    ``BisectingKMeans``: on each level the largest clusters are halved by two-means.

    Spark's own runs all ``max_iter`` rounds of a level over vectors. Here a
    round is one pre-aggregated pass over plain columns, and a level is done
    when a round moves no centre, as the next ones would not either.
    """
    noise, centers, scale = _Noise(seed), {}, 1e-12

    def summary() -> dict[int, tuple[int, list[float], float]]:
        sums = x.groupBy(_branch(cols, centers, lambda n: n).alias("node")).agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)],
            *[F.sum(F.col(c) * F.col(c)).alias(f"q{i}") for i, c in enumerate(cols)]).collect()
        out = {}
        for r in sums:
            mean = [r[f"s{i}"] / r["n"] for i in range(len(cols))]
            out[r["node"]] = r["n"], mean, max(sum(r[f"q{i}"] for i in range(len(cols))) - r["n"] * sum(v * v for v in mean), 0.0)
        return out

    active = summary()
    if not active:
        return {}
    centers[1], needed = active[1][1], k - 1
    while needed > 0:
        halved = [n for n in sorted(active) if active[n][2] > 2.0 ** -52 * active[n][0]]
        if len(halved) > needed:
            halved = sorted(halved, key=lambda n: -active[n][0])[:needed]
        if not halved:
            break
        for n in halved:
            middle = active[n][1]
            level = 1e-4 * sum(v * v for v in middle) ** 0.5
            push = [level * noise() for _ in middle]
            centers[2 * n], centers[2 * n + 1] = [v - p for v, p in zip(middle, push)], [v + p for v, p in zip(middle, push)]
        new = [c for n in halved for c in (2 * n, 2 * n + 1)]
        for _ in range(max_iter):
            found = summary()
            moved = any(c not in found or any(abs(a - b) > scale * max(1.0, abs(b)) for a, b in zip(found[c][1], centers[c]))
                        for c in new)
            for c in new:
                centers.pop(c, None)
            new = [c for c in new if c in found]
            centers.update({c: found[c][1] for c in new})
            if not moved:
                break
        active = {c: found[c] for c in new}
        needed -= len(halved)
    return centers


def hierarchical(df: DataFrame, features: Sequence[str], k: int = 5, seed: int = 42, out: str = "cluster") -> DataFrame:
    """M6 (re-aimed for scale): a divisive hierarchy instead of Ward's agglomeration.

    Exact Ward needs the distances of all pairs of rows.  Bisecting k-means
    splits the cluster with the most rows in two until there are ``k``, which
    costs a few passes per level at any size (``bisect``).  Rows are labelled
    in place; rows with a NULL feature get −1.  The feature vector is
    kept (``features``) for the silhouette.
    """
    z = standardize(df, features, prefix="__z_")
    zc = [f"__z_{c}" for c in features]
    # off the origin: two new centres are parted in proportion to their norm, which is 0 in the middle of z-scores
    z = z.withColumns({c: F.col(c) + F.lit(10.0) for c in zc})
    whole = F.lit(True)
    for c in zc:
        whole = whole & F.col(c).isNotNull()
    vectors = z.where(whole)
    x = ensure_parallelism(vectors.select(*zc)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centers = bisect(x, zc, k, seed, max_iter=30)
    finally:
        x.unpersist()
    rest = z.where(~whole).select(*df.columns, F.lit(None).cast(VectorUDT()).alias("features"), F.lit(-1).alias(out))
    if not centers:
        return rest
    number = itertools.count()  # clusters by their place in the tree, from the left
    label = _branch(zc, centers, lambda n: next(number)).cast("int")
    labelled = vectors.select(*df.columns, array_to_vector(F.array(*zc)).alias("features"), label.alias(out))
    return labelled.unionByName(rest)


def cluster(df: DataFrame, method: str = "kmeans", **options) -> DataFrame:
    """One entry by method name (D10): the labelled table of M4, M5 or M6."""
    if method == "kmeans":
        return kmeans(df, **options)[0]
    if method == "dbscan":
        return dbscan(df, **options)
    if method == "hierarchical":
        return hierarchical(df, **options)
    raise ValueError(f"unknown clustering method {method!r}; expected kmeans, dbscan or hierarchical")


def with_vector(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """The z-scored vector that a silhouette of any labelled table needs; NULL where a feature is."""
    z = standardize(df, features, prefix="__z_")
    vector = array_to_vector(F.array(*[F.col(f"__z_{c}") for c in features]))
    whole = F.lit(True)
    for c in features:
        whole = whole & F.col(c).isNotNull()
    return z.where(whole).withColumn(out, vector).select(*df.columns, out).unionByName(
        df.where(~whole), allowMissingColumns=True)
