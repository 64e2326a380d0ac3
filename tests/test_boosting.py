"""The multiclass booster against a plain version, and its folds against separate fits."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from conftest import SF0001
from sentinela import constants as K
from sentinela.ml import boosting as B, classify as M


def planted(n=900, seed=31):
    """Three classes by two of four features with few values, 10 % of them at random."""
    rng = np.random.default_rng(seed)
    x = np.c_[rng.integers(0, 12, n), rng.integers(0, 7, n), rng.integers(0, 2, n), rng.integers(0, 5, n)].astype(float)
    y = np.where(x[:, 0] < 5, 0, np.where(x[:, 1] < 3, 1, 2))
    return x, np.where(rng.random(n) < 0.1, rng.integers(0, 3, n), y), rng.integers(0, 5, n)


def cells_of(spark, x, y, part):
    rows = spark.createDataFrame([(v.tolist(), int(p), int(c)) for v, p, c in zip(x, part, y)], "x array<double>, part int, y int")
    return rows.groupBy("x", "part", "y").agg(F.count(F.lit(1)).alias("n")).repartition(5).cache()


def plain_boost(x, y, classes, rounds, depth):
    """Row by row and cut by cut: class probabilities of the rows after each round."""
    n = len(x)
    start = np.log((np.bincount(y, minlength=classes) + 1) / (n + classes))
    z, hot, out = np.repeat(start[None, :], n, axis=0), np.eye(classes)[y], []
    cuts = [np.unique(c)[:-1] for c in x.T]

    def grow(rows, g, h, left):
        G, H = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        for f in range(x.shape[1]) if left else ():
            for c in cuts[f]:
                a = rows[x[rows, f] <= c]
                ga, ha = g[a].sum(), h[a].sum()
                if ha >= B.LEAST and H - ha >= B.LEAST:
                    gain = round(ga ** 2 / (ha + B.RIDGE) + (G - ga) ** 2 / (H - ha + B.RIDGE) - G ** 2 / (H + B.RIDGE), 9)
                    if gain > best[0]:
                        best = (gain, (f, c))
        if best[1] is None:
            return [(rows, B.RATE * G / (H + B.RIDGE))]
        f, c = best[1]
        return grow(rows[x[rows, f] <= c], g, h, left - 1) + grow(rows[x[rows, f] > c], g, h, left - 1)

    for _ in range(rounds):
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        step = np.zeros_like(z)
        for k in range(classes):
            for rows, value in grow(np.arange(n), hot[:, k] - p[:, k], 2 * p[:, k] * (1 - p[:, k]), depth):
                step[rows, k] = value
        z = z + step
        p = np.exp(z - z.max(axis=1, keepdims=True))
        out.append(p / p.sum(axis=1, keepdims=True))
    return out


def test_equals_the_plain_booster_and_lowers_the_loss(spark):
    x, y, _ = planted(400)
    plan = B.boost(cells_of(spark, x, y, np.zeros(len(x))), np.ones((1, 1)), 3, rounds=6, depth=3)
    want, losses = plain_boost(x, y, 3, 6, 3), []
    trees = plan.trees
    for r in range(1, 7):
        plan.trees = trees[:r]
        got = B.probabilities(plan, x)[0]
        assert got == pytest.approx(want[r - 1], abs=1e-7) and got.sum(axis=1) == pytest.approx(1)
        losses.append(-np.log(got[np.arange(len(y)), y]).mean())
    assert all(a > b for a, b in zip(losses, losses[1:]))


def test_both_ways_give_the_same_trees(spark):
    x, y, part = planted(300)
    cells, include = cells_of(spark, x, y, part % 2), np.array([[1.0, 1.0], [0.0, 1.0]])
    here, spread = (B.boost(cells, include, 3, rounds=12, depth=2, most=m) for m in (10**6, 0))
    for a, b in zip(here.trees, spread.trees):
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[2] == pytest.approx(b[2])


def test_folds_equal_separate_fits(spark):
    x, y, part = planted(500)
    cells = cells_of(spark, x, y, part)
    include = np.array([np.ones(5)] + [np.arange(5) != f for f in range(5)], float)
    held = np.array([np.zeros(5)] + [np.arange(5) == f for f in range(5)], float)
    plan = B.boost(cells, include, 3, rounds=8, depth=3)
    scores = B.fold_accuracies(cells, plan, held)
    assert len(scores) == 5
    for f in range(5):
        alone = B.boost(cells, include[[f + 1]], 3, rounds=8, depth=3)
        own = B.probabilities(alone, x[part == f])[0]
        assert own == pytest.approx(B.probabilities(plan, x[part == f])[f + 1])
        assert scores[f] == pytest.approx((own.argmax(axis=1) == y[part == f]).mean())
    assert np.mean(scores) > 0.85


def test_pipeline_stage_saves_and_finds_the_planted_features(spark, tmp_path):
    x, y, _ = planted()
    df = spark.createDataFrame([(*v.tolist(), float(c)) for v, c in zip(x, y)], "a double, b double, c double, d double, label_idx double")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features"), B.BoostedTrees(rounds=15, depth=3)])
    model = pipe.fit(df)
    found = model.transform(df).select("prediction", "probability", "label_idx").collect()
    assert np.mean([r.prediction == r.label_idx for r in found]) > 0.88
    assert all(abs(sum(r.probability) - 1) < 1e-9 and max(r.probability) == r.probability[int(r.prediction)] for r in found)
    top = np.argsort(model.stages[-1].importances)[::-1]
    assert set(top[:2]) == {0, 1} and model.stages[-1].importances.sum() == pytest.approx(1)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(df).select("prediction", "probability", "label_idx").collect()
    assert again == found


def test_risk_model_boosted_with_folds(spark):
    from sentinela.plans import fixtures as X
    occ = X.occ(spark, SF0001)
    r = M.train_risk_model(occ, "xgboost", cv_folds=5)
    assert 0 < r.cv_mean <= 1 and r.cv_std >= 0
    rows = r.predictions.collect()
    assert rows and all(100 / 3 - 1e-6 <= p["confianca"] <= 100 + 1e-6 for p in rows)
    # the tier follows from the zone, and the zone's dummies are features
    assert np.mean([p["label"] == p["prediction"] for p in rows]) > 0.9
    scored = M.predict(r.model, occ.select(K.ID, K.ZONE, K.TS).limit(50), "xgboost").collect()
    assert len(scored) == 50 and {s["previsao"] for s in scored} <= {K.RISK_LOW, K.RISK_MID, K.RISK_HIGH}
    assert M.feature_importance(r.model, M.risk_features(occ), top=3).first()["feature"].startswith("bairro")
