"""Steps that have to stay affordable on larger tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentinela.ml import cluster as C


def _estimate(df) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_planning_of_the_components_does_not_grow_with_the_rounds(spark):
    """Estimates of joined checkpoints multiplied from round to round; a chain needs several rounds."""
    nodes = spark.range(64).select(F.col("id").alias("v"))
    edges = spark.range(63).select(((F.col("id") * 37) % 64).alias("a"), ((F.col("id") * 37 + 37) % 64).alias("b"))
    comp = C._components(edges, nodes)
    assert comp.select("c").distinct().count() == 1
    assert _estimate(comp) < 2 ** 40


def test_planning_of_the_closest_pairs_does_not_grow_with_the_halvings(spark):
    """Two crowded cells a hair further apart than eps are halved many times before that is sure."""
    from sentinela.ml.neighbors import collapse
    eps, gap = 0.3, 0.3 + 1e-9
    df = spark.createDataFrame([(i, float(x), 0.0) for i, x in enumerate([0.0, -0.15] * 10 + [gap, gap + 0.15] * 10)],
                               "occurrence_id long, a double, b double")
    rows = C.dbscan(df, ["a", "b"], eps=eps, min_samples=5, standardize_features=False).orderBy("occurrence_id").collect()
    assert [r["cluster"] for r in rows] == [0] * 20 + [1] * 20
    assert collapse(df.select("occurrence_id", F.array("a", "b").alias("x")))[0].count() == 4


def test_class_weights_keep_the_tasks_of_the_rows(spark):
    """A join by class left one task a class for all passes of a forest."""
    from sentinela.ml.classify import class_weights
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(4000).withColumn("label", F.when(F.col("id") % 4 == 0, "a").otherwise("b")).repartition(6).checkpoint()
        weighted = class_weights(rows, "label")
        assert weighted.rdd.getNumPartitions() == 6
        assert sum(1 for n in weighted.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n) == 6
        assert {(r["label"], r["peso"]) for r in weighted.select("label", "peso").distinct().collect()} == {("a", 2.0), ("b", 2 / 3)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bisecting_gives_sparks_clusters_and_stops_when_no_centre_moves(spark):
    from pyspark.ml.clustering import BisectingKMeans
    rows = [(i, float(x + (i * 7 % 11) / 50), float(y + (i * 5 % 13) / 50)) for i, (x, y) in
            enumerate([(0, 0), (4, 4), (0, 7), (9, 1), (-5, 2)] * 40)]
    df = spark.createDataFrame(rows, "occurrence_id long, a double, b double")
    got = C.hierarchical(df, ["a", "b"], k=5).select("features", "cluster").cache()
    model = BisectingKMeans(k=5, seed=42, maxIter=30, featuresCol="features", predictionCol="spark").fit(got)
    assert model.transform(got).where("cluster != spark").count() == 0

    class Counted:
        passes = 0

        def groupBy(self, *cols):
            self.passes += 1
            return df.groupBy(*cols)

    counted = Counted()
    assert len(C.bisect(counted, ["a", "b"], 5, 42, 30)) == 9
    assert counted.passes < 45  # Spark's makes 30 passes on each of three levels


def test_codes_of_few_values_keep_the_tasks_of_the_rows(spark):
    from sentinela.ml.features import label_encode
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(4000).withColumn("t", F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 < 3, "b")).repartition(6).checkpoint()
        coded = label_encode(rows, "t")
        assert coded.rdd.getNumPartitions() == 6
        assert {(r["t"], r["t_idx"]) for r in coded.select("t", "t_idx").distinct().collect()} == {("a", 0.0), ("b", 1.0), (None, None)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_neighbours_over_many_boxes_are_those_of_all_pairs(spark, monkeypatch):
    import numpy as np
    from sentinela.ml import neighbors as N
    monkeypatch.setattr(N, "BOX_POINTS", 16)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 4)), 1)
    x[:40, :3] = 0.0  # a line of points, some of them copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "occurrence_id long, x array<double>").repartition(3)
    reps, _ = N.collapse(df)
    got = {}
    for r in N.knn(reps, 7).collect():
        got.setdefault(r["p"], []).append((round(r["dist"], 12), r["q"], r["wq"]))
    points = [(r["rid"], np.array(r["x"]), r["w"]) for r in reps.collect()]
    assert len(got) == len(points)
    for p, a, _w in points:
        left, want = 7, []
        order = sorted((float(np.sqrt(sum((s - t) * (s - t) for s, t in zip(a, b)))), q, w - (p == q)) for q, b, w in points)
        for dist, q, w in order:
            if w and left:
                want.append((round(dist, 12), q, min(w, left)))
                left -= min(w, left)
        assert sorted(got[p]) == sorted(want)


def test_training_rows_are_spread_also_when_most_partitions_are_empty(spark, monkeypatch):
    """Enough partitions, but all rows in a few of them: single tasks read the whole table in every pass of a forest."""
    import pytest
    from sentinela import constants as K
    from sentinela.ml import classify as M
    seen = []

    def stop(_type, train, *a, **k):
        seen.extend(n for n in train.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n)
        raise InterruptedError

    monkeypatch.setattr(M, "TRAIN_ROWS", 200)
    monkeypatch.setattr(M, "build_pipeline", stop)
    rows = spark.range(3000).select(F.col("id").alias(K.ID), F.concat(F.lit("z"), F.col("id") % 3).alias(K.ZONE),
                                    F.timestamp_seconds(F.col("id") * 5000).alias(K.TS))
    rows = rows.repartition(40, F.lit(1)).withColumn("nivel_risco", F.lit(K.RISK_LOW))  # one partition has all rows
    with pytest.raises(InterruptedError):
        M.train_risk_model(rows, "random_forest", cv_folds=None)
    assert sum(seen) == 2400 and max(seen) <= 220 and len(seen) >= 12
