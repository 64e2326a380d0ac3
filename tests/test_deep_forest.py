"""The forest whose subtrees are grown in tasks (m10_case_model, m16_grid_search)."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.ml import classify as M, deep_forest as D


def noisy(spark, n=900):
    """Three classes by two of four features, a fifth of them at random."""
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(0, 1, (n, 4)), 2)
    y = np.where(rng.random(n) < 0.2, rng.integers(0, 3, n), (x[:, 0] > 0.5) + (x[:, 1] > 0.6) * (x[:, 0] > 0.5))
    df = spark.createDataFrame([(i, *map(float, v), float(c), i % 3) for i, (v, c) in enumerate(zip(x, y))],
                               "id long, a double, b double, c double, d double, label_idx double, fold int")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df).repartition(3).checkpoint()


def answers(model, df):
    rows = model.transform(df).select("id", "prediction", vector_to_array("probability").alias("p")).collect()
    return {r["id"]: (r["prediction"], tuple(r["p"])) for r in rows}


def test_trees_do_not_depend_on_where_subtrees_begin(spark, monkeypatch):
    df = noisy(spark)
    rows, edges = D.prepared(df, F.col("fold"))
    job = D.folds_job(3, 9, 3, 4, [1, 4], 7, prefixes=(3, 9))
    whole, model = D.fold_scores(rows, job, [30, 2, 5]), D.DeepForest(numTrees=7).fit(df)
    kept = answers(model, df)
    monkeypatch.setattr(D, "GROUP_ROWS", 60)
    monkeypatch.setattr(D, "NODES_AT_ONCE", 150)
    assert D.fold_scores(rows, job, [30, 2, 5]) == whole and len(whole) == 6 * 3 * 2
    parted = D.DeepForest(numTrees=7).fit(df)
    assert len(parted.state[2]) > 40 and len(parted.state[0].feature) > 7
    assert answers(parted, df) == kept
    assert np.allclose(parted.featureImportances.toArray(), model.featureImportances.toArray())


def test_forest_is_as_good_as_sparks(spark):
    df = noisy(spark, 1500)
    train, test = df.where("id % 5 > 0"), df.where("id % 5 = 0")
    for depth, least in ((4, 1), (30, 1), (30, 5)):
        ours = D.DeepForest(numTrees=60, maxDepth=depth, minInstancesPerNode=least).fit(train)
        spark_s = RandomForestClassifier(numTrees=60, maxDepth=depth, minInstancesPerNode=least, seed=1, labelCol="label_idx").fit(train)
        share = [m.transform(test).where("prediction = label_idx").count() / 300 for m in (ours, spark_s)]
        assert abs(share[0] - share[1]) < 0.06 and share[0] > 0.65
        assert np.abs(ours.featureImportances.toArray() - spark_s.featureImportances.toArray()).max() < 0.1
    sums = ours.transform(test).select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert sums.where("abs(s - 1) > 1e-6").count() == 0 and sums.count() == 300


def test_a_tree_is_grown_from_its_draws(spark):
    """One tree with all features: its leaves hold only draws of one class, as the values of equal rows agree."""
    df = spark.createDataFrame([(i, float(i % 16), float(i // 16 % 4), float((i % 16) // 5)) for i in range(640)],
                               "id long, a double, b double, label_idx double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = D.DeepForest(numTrees=1).fit(df)
    assert model.transform(df).where("prediction != label_idx").count() == 0
    t = model.table().first()
    counts, feature = np.frombuffer(t["counts"], "<i4").reshape(-1, 4), np.frombuffer(t["feature"], "<i2")
    assert ((counts > 0).sum(axis=1)[feature < 0] == 1).all() and (feature == 1).sum() == 0
    row = np.arange(640, dtype=np.uint64)
    many = D.draws(row, D.mix(np.arange(200, dtype=np.uint64))).astype(float)
    assert abs(many.mean() - 1) < 0.02 and abs(many.var() - 1) < 0.03


def test_the_driver_holds_no_subtrees_and_a_saved_model_answers_the_same(spark, tmp_path):
    df = noisy(spark)
    model = PipelineModel([D.DeepForest(numTrees=20).fit(df)])
    forest = model.stages[0]
    nodes = sum(len(r["feature"]) // 2 for r in forest.table().collect())
    assert len(forest.state[0].feature) == 20 and nodes > 20 * 100
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert answers(again, df) == answers(model, df) and again.stages[0].getNumTrees == 20


def test_case_model_with_many_zones(spark):
    """The zone code is a number; Spark's forest took it for a category and refused more than 32 zones."""
    rows = [(i, f"z{i % 40:02d}", float(i % 7), float(i % 11), i % 24, "Grave" if i % 40 < 20 else "Leve") for i in range(800)]
    df = spark.createDataFrame(rows, f"{K.ID} long, {K.ZONE} string, {K.LAT} double, {K.LON} double, hora int, {K.TYPE} string")
    r = M.train_case_model(df, K.TYPE, cv_folds=2)
    assert r.cv_mean > 0.9 and r.predictions.where("label = prediction").count() > 0.9 * r.predictions.count()
    assert r.predictions.count() == 160


def test_grid_grows_all_forests_together(spark, monkeypatch):
    """Nine forests were 9 fits in the driver; a setting scores as if grown for itself."""
    from sentinela.ml import grid as G
    df, calls = noisy(spark), []
    grow = D.upper_nodes
    monkeypatch.setattr(D, "upper_nodes", lambda *a: calls.append(a[1].trees) or grow(*a))
    rows = {(r["n_estimators"], r["max_depth"], r["min_samples_split"]): r["media"]
            for r in G.grid_scores(df, trees=(3, 8), depths=(2, 4, None), splits=(2, 5, 10)).collect()}
    assert calls == [8] and len(rows) == 18  # one run of passes
    assert G.grid_scores(df.where("fold = 1"), trees=(2,), depths=(2,), splits=(2,)).count() == 0  # nothing to learn from
    binned, edges = D.prepared(df, F.col("fold"))
    for n, depth, split in ((3, 2, 2), (8, 4, 10), (3, None, 5)):
        one = D.folds_job(3, n, 3, len(edges), [G.leaf_rows(split)], 42, depth or D.DEEPEST)
        met = D.fold_scores(binned, one, [one.depth]).values()
        assert abs(np.mean([a / b for a, b in met]) - rows[n, depth, split]) < 1e-12


def test_trees_that_differ_in_the_least_leaf_are_grown_as_one(spark):
    """The nine forests of the grid were 1,800 trees, each dealt its rows; they are 600 that part near the leaves."""
    from sentinela.ml import whole_trees as W
    job = D.folds_job(3, 200, 3, 5, [1, 2, 5], 42, prefixes=(50, 100, 200))
    plan = D.pieces(job, np.ones(9, bool), 6)
    assert all(len(p.forests) == 3 and len(set(job.segment(np.arange(p.first, p.last)))) == 1 for p in plan)
    assert sorted((p.forests[0], t) for p in plan for t in range(p.first, p.last)) == [(f, t) for f in range(3) for t in range(200)]

    rng = np.random.default_rng(4)
    bins, y, w = rng.integers(0, 20, (3000, 5)).astype(np.uint8), rng.integers(0, 3, 3000), rng.integers(1, 4, 3000)
    held, key, told = rng.integers(0, 20, (50, 5)).astype(np.uint8), D.mix(np.array([9], np.uint64))[0], {0: [], 1: [], 2: []}
    reached = {v: np.zeros(50, int) for v in told}

    def seen(b, cuts, left, keep, leaf):
        for v, nodes in told.items():
            for mask, cut in ((keep, True), (leaf, False)):
                nodes += [(*b.counts[i], cuts.feature[i] if cut else -1, cuts.cut[i] if cut else 0) for i in np.flatnonzero(mask >> v & 1)]
            np.add.at(reached[v], b.number[leaf[b.place] >> v & 1 > 0], 1)

    for block, dense in ((W.BLOCK, W.DENSE), (100, 5)):
        W.BLOCK, W.DENSE, before = block, dense, (W.BLOCK, W.DENSE)
        for v in told:
            told[v], reached[v] = [], np.zeros(50, int)
        W.grow(W.rows_of(bins), y, w, W.rows_of(held), key, W.Rules(np.array([1, 2, 5]), 3, 5, 3, 30), seen)
        W.BLOCK, W.DENSE = before
        for v, least in enumerate((1, 2, 5)):
            one = D.subtrees(np.zeros(3000, int), bins, y, w, np.array([key]), np.zeros(1, int), np.array([least]), 3, 3, 30)
            nodes = [(*n, f, c if f >= 0 else 0) for level in one for n, f, c in zip(*level)]
            assert sorted(told[v]) == sorted(nodes) and len(nodes) > 500
            assert (reached[v] == 1).all()


def test_rows_with_more_features_than_a_number_holds_and_many_draws():
    from sentinela.ml import whole_trees as W
    rng = np.random.default_rng(5)
    bins, y = rng.integers(0, 2, (400, 14)).astype(np.uint8), rng.integers(0, 2, 400)
    key, found = D.mix(np.array([3], np.uint64))[0], {}
    for times in (1, 1 << 27):
        nodes = found[times] = []
        W.grow(W.rows_of(bins), y, np.full(400, times), W.rows_of(bins[:0]), key, W.Rules(np.array([1]), 2, 14, 4, 30),
               lambda b, cuts, left, keep, leaf: nodes.extend(zip(b.counts.sum(axis=1) // times, cuts.feature, cuts.cut)))
    assert sorted(found[1]) == sorted(found[1 << 27]) and len(found[1]) > 100
    small, large = bins[:, :12], W.Flat(np.ascontiguousarray(bins[:, :12]))
    trees = []
    for rows in (W.rows_of(small), large):
        trees.append([])
        W.grow(rows, y, np.ones(400), rows[np.arange(0)], key, W.Rules(np.array([2]), 2, 12, 3, 30),
               lambda b, cuts, left, keep, leaf: trees[-1].extend(zip(b.counts.sum(axis=1), cuts.feature, cuts.cut)))
    assert trees[0] == trees[1] and isinstance(W.rows_of(bins), W.Flat)


def test_folds_of_the_risk_forest_count_equal_rows(spark, monkeypatch):
    """Five fits of Spark's forest over all rows; the rows have few distinct vectors, and these are what is grown from."""
    rows = [(i, f"z{i % 6}", i % 24, float(i % 7 > 4), "Alto" if i % 6 == 0 and i % 24 < 12 else "Baixo") for i in range(1200)]
    df = spark.createDataFrame(rows, f"{K.ID} long, {K.ZONE} string, hora int, fim double, risco string")
    pipe = M.build_pipeline("random_forest", df, [K.ZONE], ["hora", "fim"], "risco", weight="peso")
    told = []
    monkeypatch.setattr(M, "counted", lambda d, part: told.append(d.agg(F.count(F.lit(1)), F.sum("n")).first()) or D.counted(d, part))
    mean, std = M.forest_folds(pipe, df, [K.ZONE, "hora", "fim"], "risco", 3)
    assert mean > 0.97 and std < 0.03
    assert told[0][1] == 1200 and told[0][0] < 700
    _, spark_s, _ = M.cross_validate(pipe, M.class_weights(df, "risco"), 3)
    assert abs(mean - spark_s) < 0.03
    assert M.forest_folds(pipe, df.where("hora < 0"), [K.ZONE, "hora", "fim"], "risco", 3) == (None, None)
    monkeypatch.setattr(M, "COUNTED_BINS", 0)
    monkeypatch.setattr(M, "cross_validate", lambda *a: (None, 0.5, 0.1))
    assert M.forest_folds(pipe, df, [K.ZONE, "hora", "fim"], "risco", 3) == (0.5, 0.1)


def test_counted_rows_are_drawn_and_weighted_as_rows(spark):
    """Forests of counted rows do as well as those of the rows themselves; weights of classes count."""
    df = noisy(spark, 1200).select("fold", "label_idx", "features")
    pairs = [(i % 3, float(i % 10 == 0), float(i % 2)) for i in range(900)]   # one in five of the even rows
    flat = VectorAssembler(inputCols=["a"], outputCol="features").transform(spark.createDataFrame(pairs, "fold int, label_idx double, a double"))
    for data, classes in ((df, 3), (flat, 2)):
        once, edges = D.counted(data.groupBy("fold", "label_idx", "features").agg(F.count(F.lit(1)).alias("n")), F.col("fold"))
        rows, same = D.prepared(data, F.col("fold"))
        assert all(np.allclose(a, b, atol=0.05) for a, b in zip(edges, same)) and once.agg(F.sum("n")).first()[0] == rows.count()
        job = D.folds_job(3, 40, classes, len(edges), [1], 7, 6)
        a, b = (sum(m for m, _ in D.fold_scores(r, job, [6]).values()) / rows.count() for r in (once, rows))
        assert abs(a - b) < 0.04
        assert D.fold_scores(once, job, [6]) == D.fold_scores(once.repartition(5), job, [6])
    job.weights = np.array([0.1, 5.0])
    assert sum(m for m, _ in D.fold_scores(once, job, [6]).values()) == 450 + 90  # the rare class now outweighs the other


def test_a_fitted_forest_is_whole_trees_and_classifies_each_vector_once(spark, monkeypatch):
    """Every row was dealt to every tree, in training and in scoring."""
    df = noisy(spark)
    model = D.DeepForest(numTrees=6).fit(df)
    assert [len(m) for m in model.state[2]] == [1] * 6 and model.table().count() == 6
    monkeypatch.setattr(D, "dealt", lambda *a, **k: 1 / 0)
    kept = answers(model, df.union(df.withColumn("id", F.col("id") + 10_000)))
    assert len(kept) == 1800 and all(kept[i] == kept[i + 10_000] for i in range(900))
    assert model.transform(df.where("id < 0")).count() == 0
    monkeypatch.undo()
    rows = {r["id"]: (r["prediction"], tuple(r["p"])) for r in
            model._by_row(df).select("id", "prediction", vector_to_array("probability").alias("p")).collect()}
    assert rows == {i: kept[i] for i in range(900)}
