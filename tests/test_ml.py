"""Model operators against numpy references and planted structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from sentinela import constants as K
from sentinela.ml import anomaly as A, classify as M, cluster as C, evaluate as EV
from sentinela.ml.features import label_encode, standardize
from sentinela.ml.split import fold_column, split


def frame(spark, X, ids=None):
    ids = list(range(len(X))) if ids is None else ids
    rows = [(int(i), float(a), float(b)) for i, (a, b) in zip(ids, X)]
    return spark.createDataFrame(rows, "occurrence_id long, a double, b double")


def np_dbscan(X, eps, min_samples):
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    nb = D <= eps
    core = nb.sum(1) >= min_samples
    comp = -np.ones(len(X), dtype=int)
    for i in range(len(X)):
        if core[i] and comp[i] < 0:
            comp[i] = i
            st = [i]
            while st:
                u = st.pop()
                for v in np.flatnonzero(nb[u] & core):
                    if comp[v] < 0:
                        comp[v] = i
                        st.append(v)
    lab = np.where(core, comp, -1)
    for i in range(len(X)):
        if not core[i]:
            c = comp[np.flatnonzero(nb[i] & core)]
            if len(c):
                lab[i] = c.min()
    u = {v: j for j, v in enumerate(sorted(set(lab[lab >= 0])))}
    return np.array([u[v] if v >= 0 else -1 for v in lab])


def two_moons(n=150, noise=0.06, seed=0):
    rng = np.random.default_rng(seed)
    t = rng.uniform(0, np.pi, n)
    a = np.c_[np.cos(t), np.sin(t)]
    b = np.c_[1 - np.cos(t), 0.5 - np.sin(t)]
    X = np.vstack([a, b]) + rng.normal(0, noise, (2 * n, 2))
    return X


@pytest.mark.parametrize("eps,ms", [(0.2, 5), (0.3, 10)])
def test_dbscan_matches_numpy(spark, eps, ms):
    X = two_moons()
    X = np.vstack([X, [[5, 5], [-3, 4]]])          # planted noise
    X = np.vstack([X, X[:7]])                       # exact copies
    df = frame(spark, X)
    got = C.dbscan(df, ["a", "b"], eps=eps, min_samples=ms, standardize_features=False)
    g = dict((r["occurrence_id"], r["cluster"]) for r in got.collect())
    want = np_dbscan(X, eps, ms)
    assert [g[i] for i in range(len(X))] == list(want)


def labels_of(spark, X, eps, ms):
    rows = [(i, *map(float, x)) for i, x in enumerate(X)]
    names = [f"f{j}" for j in range(X.shape[1])]
    df = spark.createDataFrame(rows, "occurrence_id long, " + ", ".join(f"{n} double" for n in names)).repartition(6)
    got = C.dbscan(df, names, eps=eps, min_samples=ms, standardize_features=False).select("occurrence_id", "cluster").collect()
    return np.array([c for _, c in sorted(tuple(r) for r in got)])


def crowded_shapes():
    rng = np.random.default_rng(11)
    t = rng.uniform(0, np.pi, 300)
    moons = np.vstack([np.c_[np.cos(t), np.sin(t)], np.c_[1 - np.cos(t), 0.4 - np.sin(t)]]) + rng.normal(0, 0.06, (600, 2))
    square = rng.uniform(0, 0.05, (900, 2)) + [4, 4]                                   # a few cells hold everything
    far = [rng.uniform(0, 0.05, (200, 2)) + [8 + dx, 0] for dx in (0, 0.2499, 0.5101)]  # gaps just below and above eps
    copies = np.repeat(rng.uniform(0, 3, (20, 2)) + [0, 6], 15, axis=0)
    return np.vstack([moons, square, *far, copies, rng.uniform(-3, 12, (60, 2))])


@pytest.mark.parametrize("eps,ms", [(0.2, 5), (0.21, 40), (0.05, 12)])
def test_dbscan_crowded_cells_match_numpy(spark, eps, ms):
    X = crowded_shapes()
    assert (labels_of(spark, X, eps, ms) == np_dbscan(X, eps, ms)).all()


def test_dbscan_joins_crowded_cells_by_their_closest_points(spark):
    """Two blocks that only one pair of points brings within eps, and the same without that pair; three dimensions."""
    rng = np.random.default_rng(12)
    a, b = rng.uniform(0, 0.05, (150, 3)), rng.uniform(0, 0.05, (150, 3)) + [0.3, 0, 0]
    bridge = np.array([[0.06, 0.02, 0.02], [0.2599, 0.02, 0.02]])
    for X in (np.vstack([a, b]), np.vstack([a, b, bridge]), np.vstack([a, b, bridge + [[0, 0, 0], [0.0002, 0, 0]]])):
        want = np_dbscan(X, 0.2, 10)
        assert (labels_of(spark, X, 0.2, 10) == want).all()
        assert want.max() == (0 if len(X) > 300 and X[-1, 0] < 0.26 else 1)


def test_dbscan_lists_grow_with_the_rows_not_the_density(spark):
    from pyspark.sql import functions as F
    from sentinela.ml.density import cell_tables, sparse_hits
    rng = np.random.default_rng(13)
    listed = []
    for n in (1000, 2000, 4000, 8000):
        X = rng.uniform(0, 1, (n, 2))
        reps = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(X)], "rid long, x array<double>").withColumn("w", F.lit(1))
        points, cells, near = cell_tables(reps, 0.1, 10)
        listed.append(near.count() + sparse_hits(points, cells, near, 0.1).count())
    assert all(b <= 2.2 * a for a, b in zip(listed, listed[1:])), listed
    assert listed[-1] < 4 * 8000


def test_dbscan_order_invariant(spark):
    X = two_moons(80, seed=3)
    df = frame(spark, X)
    a = {r[0]: r[1] for r in C.dbscan(df, ["a", "b"], 0.25, 5, standardize_features=False).select("occurrence_id", "cluster").collect()}
    b = {r[0]: r[1] for r in C.dbscan(df.repartition(7).orderBy(F.rand(1)), ["a", "b"], 0.25, 5,
                                      standardize_features=False).select("occurrence_id", "cluster").collect()}
    assert a == b


def np_lof(X, k, ids):
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    keys = [tuple(r) for r in X]
    rep = {}
    for i, kk in zip(ids, keys):
        rep[kk] = min(rep.get(kk, i), i)
    reps = np.array([rep[kk] for kk in keys])
    n = len(X)
    nbr = np.zeros((n, k), dtype=int)
    kd = np.zeros(n)
    for i in range(n):
        o = np.lexsort((ids, reps, D[i]))
        o = o[o != i][:k]
        nbr[i] = o
        kd[i] = D[i, o].max()
    reach = np.maximum(kd[nbr], D[np.arange(n)[:, None], nbr])
    lrd = 1.0 / (reach.mean(1) + 1e-10)
    return lrd[nbr].mean(1) / lrd


def test_lof_matches_numpy_with_duplicates(spark):
    rng = np.random.default_rng(1)
    X = np.vstack([rng.normal(0, 1, (200, 2)), [[6, 6], [7, -5]]])
    X = np.vstack([X, X[:15]])
    ids = np.arange(len(X))
    df = frame(spark, X)
    got = {r["occurrence_id"]: r["lof"] for r in A.lof_scores(df, ["a", "b"], 10, standardize_features=False).collect()}
    want = np_lof(X, 10, ids)
    assert max(abs(got[i] - want[i]) for i in ids) < 1e-9


def test_lof_flags_planted_outliers(spark):
    rng = np.random.default_rng(2)
    X = np.vstack([rng.normal(0, 1, (1000, 2)), rng.uniform(8, 12, (10, 2))])
    df = frame(spark, X)
    r = A.local_outlier_factor(df, ["a", "b"], 20, 0.01)
    flagged = {x["occurrence_id"] for x in r.where("anomalia = -1").collect()}
    assert set(range(1000, 1010)) <= flagged


def test_isolation_forest_planted_and_share(spark):
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(0, 1, (1000, 2)), rng.uniform(8, 12, (10, 2))])
    df = frame(spark, X)
    r = A.isolation_forest(df, ["a", "b"], contamination=0.05, n_trees=50, seed=7)
    out = r.select("occurrence_id", "anomalia", "score_anomalia").collect()
    flagged = {x[0] for x in out if x[1] == -1}
    assert set(range(1000, 1010)) <= flagged
    assert abs(len(flagged) / len(out) - 0.05) < 0.01
    top = sorted(out, key=lambda x: -x[2])[:10]
    assert {x[0] for x in top} == set(range(1000, 1010))
    # reproducible under re-partitioning
    r2 = A.isolation_forest(df.repartition(5), ["a", "b"], contamination=0.05, n_trees=50, seed=7)
    s1 = {x[0]: round(x[2], 12) for x in out}
    s2 = {x[0]: round(x[1], 12) for x in r2.select("occurrence_id", "score_anomalia").collect()}
    assert s1 == s2


def test_isolation_forest_rejects_bad_contamination(spark):
    with pytest.raises(ValueError):
        A.isolation_forest(frame(spark, np.zeros((3, 2))), ["a", "b"], contamination=0.7)


def blobs(seed=0):
    rng = np.random.default_rng(seed)
    cs = np.array([[0, 0], [10, 0], [0, 10], [10, 10], [5, 20]])
    return np.vstack([c + rng.normal(0, 0.5, (40, 2)) for c in cs]), np.repeat(np.arange(5), 40)


def purity(labels, truth):
    ok = 0
    for c in set(labels):
        m = truth[labels == c]
        ok += np.bincount(m).max()
    return ok / len(truth)


def test_kmeans_finds_blobs(spark):
    X, y = blobs()
    df = frame(spark, X).withColumn("z", F.lit("x"))
    lab, _f, _m = C.kmeans(df, k=5, n_init=3, cat_cols=[], num_cols=["a", "b"])
    got = np.array([r["cluster"] for r in lab.orderBy("occurrence_id").collect()])
    assert purity(got, y) == 1.0
    assert C.silhouette(lab) > 0.8


def test_hierarchical_finds_blobs(spark):
    X, y = blobs(1)
    df = frame(spark, X)
    got = np.array([r["cluster"] for r in C.hierarchical(df, ["a", "b"], k=5).orderBy("occurrence_id").collect()])
    assert purity(got, y) >= 0.95   # a divisive split may cut the rim of a blob


def test_clusterings_keep_incomplete_rows(spark):
    """Rows with a NULL feature stay in the table with label −1, for every method; so does an empty table."""
    rows = [(i, float(i % 3 * 10 + i % 2), None if i % 7 == 0 else float(i % 5), None if i % 11 == 0 else "z") for i in range(80)]
    df = spark.createDataFrame(rows, "occurrence_id long, a double, b double, c string")
    kept = {"kmeans": C.kmeans(df, k=3, n_init=2, cat_cols=["c"], num_cols=["a", "b"])[0],
            "hierarchical": C.hierarchical(df, ["a", "b"], k=3), "dbscan": C.dbscan(df, ["a", "b"], eps=0.5, min_samples=3)}
    for name, lab in kept.items():
        got = {r["occurrence_id"]: r["cluster"] for r in lab.collect()}
        assert len(got) == 80
        gone = [i for i, a, b, c in rows if b is None or (name == "kmeans" and c is None)]
        assert all(got[i] == -1 for i in gone)
        assert name == "dbscan" or all(got[i] >= 0 for i in got if i not in gone)
    empty = df.where("false")
    assert C.hierarchical(empty, ["a", "b"], k=3).count() == 0
    assert C.dbscan(empty, ["a", "b"]).count() == 0
    assert A.isolation_forest(empty, ["a", "b"]).count() == 0
    assert A.local_outlier_factor(empty, ["a", "b"]).count() == 0


def test_exact_quantile(spark):
    rng = np.random.default_rng(17)
    for v in (rng.normal(size=3000), np.repeat([1.0, 2.0, 5.0], [700, 1, 50]), np.full(30, 3.5), np.array([2.0])):
        df = spark.createDataFrame([(float(x),) for x in v], "s double").repartition(5)
        for q in (0.0, 0.05, 0.95, 0.5, 1.0):
            assert A.exact_quantile(df, "s", q) == pytest.approx(np.percentile(v, 100 * q), rel=1e-12)
    assert A.exact_quantile(spark.createDataFrame([], "s double"), "s", 0.5) is None


def test_isolation_forest_flags_the_exact_share(spark):
    rng = np.random.default_rng(23)
    df = frame(spark, rng.normal(size=(4000, 2)))
    r = A.isolation_forest(df, ["a", "b"], 0.05).collect()
    s = np.array([x["score_anomalia"] for x in r])
    assert sum(x["anomalia"] == -1 for x in r) == int((s > np.percentile(s, 95)).sum())


def test_stratified_split_is_exact(spark):
    rng = np.random.default_rng(29)
    rows = [(i, ["a", "b", "c", None][int(k)]) for i, k in enumerate(rng.choice(4, 2000, p=[0.7, 0.2, 0.09, 0.01]))]
    df = spark.createDataFrame(rows, "occurrence_id long, y string")
    got = split(df, 0.2, stratify="y")
    again = split(df.repartition(9), 0.2, stratify="y")
    assert sorted(got.collect(), key=str) == sorted(again.collect(), key=str)
    n = {y: sum(1 for _, x in rows if x == y) for y in ("a", "b", "c", None)}
    for y, k in n.items():
        side = [r for r in got.collect() if r["y"] == y]
        assert len(side) == k and sum(r["conjunto"] == "teste" for r in side) == int(k * 0.2 + 0.5)


def test_standardize_population(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (5.0,), (9.0,)], "x double")
    z = [r[0] for r in standardize(df, ["x"]).select("z_x").collect()]
    v = np.array([1, 2, 5, 9.0])
    assert np.allclose(z, (v - v.mean()) / v.std())


def test_label_encode_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "v string")
    out = sorted((r["v"] or "", r["v_idx"]) for r in label_encode(df, "v").collect())
    assert out == [("", None), ("a", 0.0), ("a", 0.0), ("b", 1.0), ("c", 2.0)]


def test_split_deterministic_and_partition_free(spark):
    df = spark.range(5000).withColumnRenamed("id", "occurrence_id")
    a = {r[0]: r[1] for r in split(df).collect()}
    b = {r[0]: r[1] for r in split(df.repartition(13)).collect()}
    assert a == b
    share = sum(1 for v in a.values() if v == "teste") / len(a)
    assert 0.18 < share < 0.22
    f = fold_column(df, 5).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in f) == [0, 1, 2, 3, 4]


def test_classification_report_zero_division(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("C", "B")], "label string, prediction string")
    rep = {r["classe"]: r for r in EV.classification_report(df).collect()}
    assert rep["C"]["precision"] == 0.0 and rep["C"]["recall"] == 0.0 and rep["C"]["f1"] == 0.0
    assert rep["A"]["precision"] == 1.0 and rep["A"]["recall"] == 0.5
    assert rep["accuracy"]["f1"] == 0.5 and rep["accuracy"]["support"] == 4
    cm = EV.confusion_matrix_wide(df).collect()
    assert [r["label"] for r in cm] == ["A", "B", "C"] and cm[2]["B"] == 1 and cm[2]["C"] == 0


def test_fairness_flags(spark):
    rows = [("z1", "A", "A")] * 9 + [("z1", "A", "B")] + [("z2", "A", "B")] * 5 + [("z2", "A", "A")] * 5
    df = spark.createDataFrame(rows, "bairro string, label string, prediction string")
    out = {r["bairro"]: (r["erro"], r["vies"]) for r in EV.fairness_by_group(df).collect()}
    assert out == {"z2": (0.5, True), "z1": (0.1, False)}


def test_risk_model_end_to_end(spark):
    from sentinela.plans import fixtures as X
    occ = X.occ(spark, SF0001)
    r = M.train_risk_model(occ, "random_forest", cv_folds=3)
    pred = r.predictions.collect()
    assert len(pred) > 0 and all(p["prediction"] in (K.RISK_LOW, K.RISK_MID, K.RISK_HIGH) for p in pred)
    assert all(0.0 < p["confianca"] <= 100.0 for p in pred)
    assert r.cv_mean is not None and 0.0 <= r.cv_mean <= 1.0
    imp = M.feature_importance(r.model, M.risk_features(occ)).collect()
    assert 0 < len(imp) <= 10 and imp[0]["importance"] >= imp[-1]["importance"]
    scen = occ.select(K.ID, K.ZONE, K.TS).limit(5)
    p = M.predict(r.model, scen, "random_forest").collect()
    assert len(p) == 5 and all(x["previsao"] is not None for x in p)
    # scenario without timestamp: zone, ISO weekday, hour, month (unknown zone allowed)
    form = spark.createDataFrame([("NATION_3", 6, 23, 1), ("Nowhere", 2, 9, 5)], "bairro string, dow int, hora int, mes int")
    q = M.predict(r.model, form, "random_forest").collect()
    assert len(q) == 2 and all(x["previsao"] in (K.RISK_LOW, K.RISK_MID, K.RISK_HIGH) for x in q)
    with pytest.raises(ValueError):
        M.train_risk_model(occ, "svm")


def planted_classes(spark, n=600):
    """Three classes by two features, with noise; the third feature says nothing."""
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(21)
    x = rng.uniform(0, 1, (n, 3))
    y = np.where(rng.random(n) < 0.1, rng.integers(0, 3, n), (x[:, 0] > 0.5) + (x[:, 1] > 0.6) * (x[:, 0] > 0.5))
    df = spark.createDataFrame([(i, *map(float, v), float(c), int(i % 3)) for i, (v, c) in enumerate(zip(x, y))],
                               "occurrence_id long, a double, b double, c double, label_idx double, fold int")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).repartition(4).cache(), x, y.astype(int)


def test_grid_forest_prefixes_and_depths(spark):
    """The whole forest votes as Spark's model does; a prefix as the mean of its trees; a cut tree by its node's rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from sentinela.ml.grid import Forest, forest_nodes, hits
    df, x, y = planted_classes(spark)
    model = RandomForestClassifier(numTrees=12, maxDepth=6, seed=1, featuresCol="features", labelCol="label_idx").fit(df)
    nodes = forest_nodes(spark, model)
    votes = Forest(nodes).votes(x, (1, 5, 12), (6, 2, 0))
    whole = {r["occurrence_id"]: int(r["prediction"]) for r in model.transform(df).collect()}
    assert [whole[i] for i in range(len(x))] == votes[0, 2].tolist()
    from pyspark.ml.linalg import Vectors
    for i in range(0, 600, 60):
        raw = sum(t.predictProbability(Vectors.dense(x[i])).toArray() for t in model.trees[:5])
        assert votes[0, 1, i] == raw.argmax()
        share, by = np.zeros(3), nodes.set_index(["tree", "id"])
        for t in range(5):  # walk down two steps by hand
            at = by.loc[(t, 0)]
            for _ in range(2):
                if at.left >= 0:
                    at = by.loc[(t, at.left if x[i, at.feature] <= at.threshold else at.right)]
            share += np.array(at.stats) / sum(at.stats)
        assert votes[1, 1, i] == share.argmax()
    assert len(set(votes[2, 2])) == 1  # depth 0: the majority
    found = hits(model, df, (1, 12), (2, 6))
    assert found[6, 12] == (int((votes[0, 2] == y).sum()), 600) and found[2, 1] == (int((votes[1, 0] == y).sum()), 600)


def test_grid_scores_have_every_setting_and_the_best(spark):
    from sentinela.ml.grid import grid_scores
    df, _, _ = planted_classes(spark)
    rows = grid_scores(df, trees=(3, 6), depths=(1, 4, None), splits=(2, 10)).collect()
    assert {(r["n_estimators"], r["max_depth"], r["min_samples_split"]) for r in rows} == {
        (n, d, s) for n in (3, 6) for d in (1, 4, None) for s in (2, 10)} and len(rows) == 12
    best = [r for r in rows if r["escolhido"]]
    assert len(best) == 1 and best[0]["media"] == max(r["media"] for r in rows) > 0.85
    assert all(0 <= r["desvio"] < 0.2 for r in rows)
    assert len({r["media"] for r in rows}) > 2
    again = grid_scores(df, trees=(3, 6), depths=(1, 4, None), splits=(2, 10)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_grid_search_of_the_case_model(spark):
    from sentinela.plans import fixtures as X
    cases = X.occ(spark, SF0001)
    small = {"trees": (2, 4), "depths": (2, None), "splits": (2,)}
    rows = M.grid_search(cases, "gravidade", **small).collect()
    assert len(rows) == 4 and sum(r["escolhido"] for r in rows) == 1
    best = next(r for r in rows if r["escolhido"])
    r = M.train_case_model(cases, "gravidade", tune=True, grid=small)
    forest = r.model.stages[-1]
    assert forest.getNumTrees in (2, 4) and 0 < r.cv_mean <= 1 and best["media"] <= 1
    assert M.grid_search(cases.where("false"), "gravidade", **small).count() == 0


def test_one_hot_drop_first(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    from sentinela.ml.features import one_hot_stages
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "z string, x double")
    m = Pipeline(stages=one_hot_stages(df, ["z"], ["x"], "f", drop_first=True)).fit(df)
    out = {r["z"]: r["f"] for r in m.transform(df).select("z", vector_to_array("f").alias("f")).collect()}
    # 'a' (alphabetically first) is the dropped level: all-zero dummies
    assert out == {"a": [0.0, 0.0, 1.0], "b": [1.0, 0.0, 2.0], "c": [0.0, 1.0, 3.0]}
    unseen = spark.createDataFrame([("zz", 4.0), (None, 5.0)], "z string, x double")
    assert [r[0] for r in m.transform(unseen).select(vector_to_array("f")).collect()] == [[0.0, 0.0, 4.0], [0.0, 0.0, 5.0]]


def test_batch_pipeline_from_a_file(spark):
    """CSV without a key, with duplicate and incomplete rows: nothing is lost but duplicates and invalid rows."""
    import tempfile
    from datetime import datetime
    from sentinela.plans.batch import score_and_label
    from sentinela.plans import fixtures as X
    from sentinela.sources.io import read_incidents
    d = tempfile.mkdtemp(prefix="sentinela-csv-")
    occ = X.occ(spark, SF0001).drop(K.ID)
    some = occ.limit(50)
    part = occ.withColumn(K.ZONE, F.when(F.xxhash64(*occ.columns) % 9 != 0, F.col(K.ZONE)))
    part.unionByName(some.limit(20)).unionByName(some.limit(20)).write.option("header", True).csv(f"{d}/in")
    raw = read_incidents(spark, f"{d}/in")
    assert K.ID not in raw.columns
    lab, metrics, _ = score_and_label(raw, as_of=datetime(2024, 12, 31), n_init=1, model_type="random_forest", cv_folds=2)
    from sentinela.operators.clean import clean_and_validate
    assert lab.count() == clean_and_validate(raw, as_of=datetime(2024, 12, 31)).count() == metrics["rows"]
    assert lab.select(K.ID).distinct().count() == lab.count()


def test_batch_pipeline(spark):
    import os
    import tempfile
    from datetime import datetime
    from sentinela.plans.batch import score_and_label
    from sentinela.plans import fixtures as X
    from sentinela.sources.io import read_results
    d = tempfile.mkdtemp(prefix="sentinela-batch-")
    lab, metrics, res = score_and_label(X.occ(spark, SF0001), as_of=datetime(2024, 12, 31), n_init=2,
                                        model_type="random_forest", cv_folds=2, out_path=d)
    cols = set(lab.columns)
    assert {"cluster", "anomalia", "nivel_risco", "hora", "periodo_dia"} <= cols
    assert metrics["rows"] > 0 and metrics["cv_mean"] is not None
    t, m = read_results(spark, d)
    assert t.count() == metrics["rows"] and m.count() == 4
    assert os.path.isdir(os.path.join(d, "table"))


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))]
    nodes = spark.createDataFrame([(i,) for i in range(300)], "v long")
    e = spark.createDataFrame(edges, "a long, b long")
    got = {r["v"]: r["c"] for r in C._components(e, nodes).collect()}
    want = list(range(300))
    while True:
        before = list(want)
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
        if want == before:
            break
    assert got == dict(enumerate(want))


def test_case_model_and_scenarios(spark):
    from sentinela.plans import fixtures as X
    from sentinela.operators import filters
    occ = filters.filter_in(X.occ(spark, SF0001), K.TYPE, K.CASE_TYPES)
    r = M.train_case_model(occ, "gravidade", cv_folds=2)
    pred = r.predictions.collect()
    assert pred and all(p["prediction"] in ("Baixa", "Média", "Alta") for p in pred)
    assert r.cv_mean is not None
    scen = spark.createDataFrame([(1, -8.09, -34.9, 10, "NATION_1", 2), (2, -8.1, -34.91, 23, "Nowhere", 1)],
                                 "occurrence_id long, latitude double, longitude double, hora int, bairro string, "
                                 "quantidade_vitimas int")
    out = M.predict_case(r.model, scen).collect()
    assert len(out) == 2 and all(0 < x["confianca"] <= 100 for x in out)
    r2 = M.train_case_model(occ, K.WEAPON, cv_folds=None)
    assert r2.predictions.count() > 0
    with pytest.raises(ValueError):
        M.train_case_model(occ, "idade")
    with pytest.raises(ValueError):
        M.train_case_model(occ.limit(5), "gravidade")


def test_lof_exact_with_hot_area(spark):
    """A third of the points in a tiny square: the multi-resolution grid must
    stay exact (compared with brute force)."""
    rng = np.random.default_rng(11)
    X = np.vstack([rng.uniform(0, 0.01, (600, 2)), rng.uniform(0, 10, (1200, 2))])
    ids = np.arange(len(X))
    df = frame(spark, X)
    got = {r["occurrence_id"]: r["lof"] for r in A.lof_scores(df, ["a", "b"], 10, standardize_features=False).collect()}
    want = np_lof(X, 10, ids)
    assert max(abs(got[i] - want[i]) for i in ids) < 1e-9


def test_lof_partition_invariant(spark):
    rng = np.random.default_rng(21)
    X = np.vstack([rng.normal(0, 1, (300, 2)), X_dup := rng.normal(0, 1, (20, 2))])
    X = np.vstack([X, X_dup])
    df = frame(spark, X)
    a = {r[0]: r[1] for r in A.lof_scores(df, ["a", "b"], 15).collect()}
    b = {r[0]: r[1] for r in A.lof_scores(df.repartition(11).orderBy(F.rand(3)), ["a", "b"], 15).collect()}
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_case_dashboard_models_and_method_names(spark):
    from sentinela.plans import dashboards as D, fixtures as X
    base = D.case_base(X.occ(spark, SF0001))
    tabs = D.case_models(base)
    n = base.count()
    for tab in tabs.values():
        for df in tab.values():
            assert df.count() == n
    assert set(r[0] for r in tabs["agrupamento"]["kmeans"].select("cluster").distinct().collect()) == {0, 1, 2, 3}
    assert {r[0] for r in tabs["anomalias"]["lof"].select("anomalia").distinct().collect()} == {-1, 1}
    with pytest.raises(ValueError):
        C.cluster(base, "hdbscan")
    with pytest.raises(ValueError):
        A.detect_anomalies(base, "zscore")
