"""Risk classification (M10–M12, M15, M16, M19) with ``pyspark.ml``.

Target: the zone-density risk tier (A25).  Features: zone, hour, weekday,
month, period of day, weekend.  The original's boosted-tree libraries become
the multiclass booster of ``ml.boosting`` (Spark's own is binary), its random
forest ``RandomForestClassifier`` with balanced class weights.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.ml.boosting import BoostedTrees, BoostedTreesModel, boost, cell_counts, fold_accuracies
from sentinela.ml.features import one_hot_stages
from sentinela.ml.deep_forest import DEEPEST, DeepForest, counted, fold_scores, folds_job, prepared
from sentinela.ml.grid import grid_scores, leaf_rows
from sentinela.ml.split import fold_column, split
from sentinela.plans.hints import bounded_broadcast, ensure_parallelism, settled
from sentinela.operators.derive import derive_time_features
from sentinela.operators.risk import risk_tier

RISK_CATEGORICAL = [K.ZONE, "dia_semana", "periodo_dia"]
RISK_NUMERIC = ["hora", "mes", "fim_semana_n"]
BOOSTED = ("xgboost", "lightgbm", "gradient_boosting")
MODEL_TYPES = (*BOOSTED, "random_forest")
#: Most rows of a task of a forest, which keeps some 650 bytes of each (its bins and a weight for every tree).
TRAIN_ROWS = 250_000
#: Most bins of distinct rows from which the folds of the risk forest are grown in tasks.
COUNTED_BINS = 200_000_000


@dataclass
class RiskModelResult:
    model: PipelineModel
    predictions: DataFrame      # test rows: id, zone, label, prediction, confianca
    report: DataFrame           # M17 table on the test rows
    cv_mean: float | None
    cv_std: float | None
    feature_names: list[str]
    model_type: str


def risk_features(df: DataFrame, ts: str = K.TS) -> DataFrame:
    """Time features (P2–P5) plus the numeric weekend flag and the target.

    A scenario without a timestamp may give ``hora``, ``dow`` (ISO weekday)
    and ``mes`` instead; period and weekend are then derived from hour and
    weekday (D5), and the month is taken as given."""
    from sentinela.functions.scalar import time_period
    have = set(df.columns)
    if {"hora", "periodo_dia", "dia_semana", "mes", "fim_semana"} <= have:
        d = df
    elif ts in have:
        d = derive_time_features(df, ts)
    elif {"hora", "dow", "mes"} <= have:
        names = F.array(*[F.lit(n) for n in K.WEEKDAYS_LOWER])
        d = df.withColumns({"dia_semana": F.element_at(names, F.col("dow").cast("int")),
                            "periodo_dia": time_period("hora"), "fim_semana": F.col("dow") >= 6})
    else:
        raise ValueError("need a timestamp or hora, dow and mes")
    d = d.withColumn("fim_semana_n", F.col("fim_semana").cast("double"))
    return d if "nivel_risco" in d.columns else risk_tier(d)


def classifier(model_type: str = "xgboost", seed: int = 42, label: str = "label_idx",
               weight: str | None = None, num_trees: int = 100, max_depth: int | None = None):
    """The estimator for a model type; unknown types raise."""
    if model_type in BOOSTED:
        return BoostedTrees(rounds=num_trees, depth=max_depth or 6)
    if model_type == "random_forest":
        rf = RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth or 10, seed=seed,
                                    featuresCol="features", labelCol=label)
        if weight:
            rf = rf.setWeightCol(weight)
        return rf
    raise ValueError(f"unknown model type {model_type!r}; expected one of {MODEL_TYPES}")


def class_weights(df: DataFrame, label: str, out: str = "peso") -> DataFrame:
    """Balanced weights n / (k · n_class) of the given (training) rows, from one
    aggregation over the labels (k rows) broadcast back: a join by label would
    leave as many tasks as there are classes."""
    c = settled(df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc")))
    tot = c.agg(F.sum("__nc").alias("n"), F.count(F.lit(1)).alias("k")).first()
    c = c.withColumn(out, F.lit(float(tot["n"])) / (F.lit(float(tot["k"])) * F.col("__nc"))).drop("__nc")
    return df.join(bounded_broadcast(c), label, "left")


def build_pipeline(model_type: str, df: DataFrame, cat_cols=RISK_CATEGORICAL, num_cols=RISK_NUMERIC,
                   target: str = "nivel_risco", seed: int = 42, weight: str | None = None, **kw) -> Pipeline:
    """Label index → dummies (levels read from ``df``) → assembler →
    classifier.  The first level of every text feature is dropped, as the
    original does."""
    lab = StringIndexer(inputCol=target, outputCol="label_idx", stringOrderType="alphabetAsc")
    stages = one_hot_stages(df, cat_cols, num_cols, "features", drop_first=True)
    clf = classifier(model_type, seed, "label_idx", weight, **kw)
    return Pipeline(stages=[lab] + stages + [clf])


def with_label_text(model: PipelineModel, pred: DataFrame) -> DataFrame:
    labels = model.stages[0].labels
    return IndexToString(inputCol="prediction", outputCol="prediction_label", labels=labels).transform(pred)


def confidence(pred: DataFrame) -> DataFrame:
    """Highest class probability in percent."""
    return pred.withColumn("confianca", F.array_max(vector_to_array("probability")) * F.lit(100.0))


def feature_importance(model: PipelineModel, sample: DataFrame, top: int = 10) -> DataFrame:
    """(feature, importance) descending, top ``top``: the share of the gain
    of all cuts for boosted trees, Spark's measure for a forest.  Slot names
    come from the ML attribute metadata of the assembled column."""
    clf = model.stages[-1]
    mean = clf.importances if isinstance(clf, BoostedTreesModel) else clf.featureImportances.toArray()
    n = len(mean)
    meta = model.transform(sample.limit(1)).schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for group in meta.values() for a in group}
    rows = [(names.get(i, f"f{i}"), float(mean[i])) for i in range(n)]
    spark = sample.sparkSession
    out = spark.createDataFrame(rows, "feature string, importance double")
    return out.orderBy(F.col("importance").desc(), F.col("feature")).limit(top)


def cross_validate(pipeline: Pipeline, train: DataFrame, k: int = 5, seed: int = 42,
                   grid=None, parallelism: int = 4):
    """K-fold accuracy with a hash fold column (stable across runs);
    returns (CrossValidatorModel, mean, std) of the best setting."""
    ev = MulticlassClassificationEvaluator(labelCol="label_idx", predictionCol="prediction", metricName="accuracy")
    grid = grid or ParamGridBuilder().build()
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=ev, foldCol="fold", numFolds=k,
                        parallelism=parallelism, seed=seed)
    m = cv.fit(fold_column(train, k, seed))
    best = max(range(len(m.avgMetrics)), key=lambda i: m.avgMetrics[i])
    std = m.stdMetrics[best] if getattr(m, "stdMetrics", None) else None
    return m, float(m.avgMetrics[best]), (float(std) if std is not None else None)


def boosted_with_folds(pipeline: Pipeline, df: DataFrame, folds: int, seed: int = 42) -> tuple[PipelineModel, list[float]]:
    """The model of the training rows (``conjunto``) and the accuracies of ``folds`` models, each of all rows
    but those of its fold, on that fold; all grown in the same passes.  The encoders are fitted on all rows."""
    encoder = Pipeline(stages=pipeline.getStages()[:-1]).fit(df)
    k = max(folds, 1)
    part = F.when(F.col("conjunto") == "treino", 0).otherwise(k) + F.col("fold")
    cells = settled(cell_counts(encoder.transform(fold_column(df, k, seed)), part))
    of = np.arange(2 * k)
    include = np.array([of < k] + [of % k != f for f in range(folds)], float)
    booster = pipeline.getStages()[-1]
    plan = boost(cells, include, len(encoder.stages[0].labels), booster.getOrDefault(booster.rounds), booster.getOrDefault(booster.depth))
    held = np.array([of < 0] + [of % k == f for f in range(folds)], float)
    return PipelineModel(encoder.stages + [BoostedTreesModel.of(plan)]), fold_accuracies(cells, plan, held) if folds else []


def forest_folds(pipe: Pipeline, df: DataFrame, cols: Sequence[str], target: str, folds: int, seed: int = 42) -> tuple[float | None, float | None]:
    """Mean and deviation of the accuracies of ``folds`` forests with balanced weights, each of all rows but those of
    its fold, on that fold.  Equal rows are counted first, a tree draws each as often as its rows would be drawn, and all
    forests are grown at once.  The encoders are fitted on all rows.  Rows with too many distinct vectors are fitted fold
    by fold."""
    d = settled(fold_column(df, folds, seed).groupBy(*cols, target, "fold").agg(F.count(F.lit(1)).alias("n")))
    encoder = Pipeline(stages=pipe.getStages()[:-1]).fit(d)
    rows, edges = counted(encoder.transform(d), F.col("fold"))
    if not edges:
        return None, None
    if rows.count() * len(edges) > COUNTED_BINS:
        return cross_validate(pipe, class_weights(df, target), folds, seed)[1:]
    size = {r[target]: r["n"] for r in d.groupBy(target).agg(F.sum("n").alias("n")).collect()}
    labels, forest = encoder.stages[0].labels, pipe.getStages()[-1]
    job = folds_job(folds, forest.getNumTrees(), len(labels), len(edges), [forest.getMinInstancesPerNode()], seed, forest.getMaxDepth())
    job.weights = np.array([sum(size.values()) / (len(size) * size[c]) for c in labels])
    met = [right / n for right, n in fold_scores(rows, job, [job.depth]).values()]
    return (float(np.mean(met)), float(np.std(met))) if met else (None, None)


def evenly(df: DataFrame) -> DataFrame:
    """A settled frame dealt anew if a task would read many more than ``TRAIN_ROWS`` rows: as many partitions as
    are wanted do not say that the rows are spread over them (few row groups or zones leave most of them empty)."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return settled(df.repartition(-(-sum(sizes) // TRAIN_ROWS))) if sizes and max(sizes) > 1.1 * TRAIN_ROWS else df


def train_risk_model(df: DataFrame, model_type: str = "xgboost", test_size: float = 0.2, seed: int = 42,
                     cv_folds: int | None = 5, exclude_features: Sequence[str] = ()) -> RiskModelResult:
    """M10/M22 step: target A25, stratified hash split (M14), fit, report (M17), CV."""
    from sentinela.ml.evaluate import classification_report
    if model_type not in MODEL_TYPES:
        raise ValueError(f"unknown model type {model_type!r}")
    d = risk_features(df)
    cat = [c for c in RISK_CATEGORICAL if c not in exclude_features]
    num = [c for c in RISK_NUMERIC if c not in exclude_features]
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TRAIN_ROWS))
    d = settled(ensure_parallelism(split(d.select(K.ID, *{*cat, *num, K.ZONE, "nivel_risco"}), test_size, seed,
                                         stratify="nivel_risco"), tasks))
    if d.select("nivel_risco").where("nivel_risco is not null").isEmpty():
        raise ValueError("no rows to train on")
    d = evenly(d)
    test = d.where(F.col("conjunto") == "teste")
    cv_mean = cv_std = None
    if model_type in BOOSTED:
        model, scores = boosted_with_folds(build_pipeline(model_type, d, cat, num, seed=seed), d, cv_folds or 0, seed)
        if scores:
            cv_mean, cv_std = float(np.mean(scores)), float(np.std(scores))
    else:
        weighted = lambda x: class_weights(x, "nivel_risco")
        train = weighted(d.where(F.col("conjunto") == "treino"))
        pipe = build_pipeline(model_type, train, cat, num, seed=seed, weight="peso")
        model = pipe.fit(train)
        if cv_folds:  # over all rows, as the original does
            cv_mean, cv_std = forest_folds(pipe, d, [*cat, *num], "nivel_risco", cv_folds, seed)
    pred = confidence(with_label_text(model, model.transform(test)))
    pred = pred.select(K.ID, K.ZONE, F.col("nivel_risco").alias("label"),
                       F.col("prediction_label").alias("prediction"), "confianca")
    report = classification_report(pred)
    return RiskModelResult(model, pred, report, cv_mean, cv_std, cat + num, model_type)


def predict(model: PipelineModel, scenarios: DataFrame, model_type: str = "xgboost") -> DataFrame:
    """Score scenario rows (zone, timestamp) in batch: class and confidence."""
    d = risk_features(scenarios.withColumn("nivel_risco", F.lit(K.RISK_LOW))) \
        if "nivel_risco" not in scenarios.columns else risk_features(scenarios)
    out = confidence(with_label_text(model, model.transform(d)))
    return out.select(*scenarios.columns, F.col("prediction_label").alias("previsao"), "confianca")


# ------------------------------------------------------------------ second form (case dashboard)
CASE_TARGETS = ("gravidade", K.TYPE, K.WEAPON)


def case_features(df: DataFrame, target: str, ts: str = K.TS) -> tuple[DataFrame, list[str]]:
    """Target column (case gravity P16 derived when asked for) and the numeric
    features: position, hour, and the number of victims when present."""
    from sentinela.operators.derive import case_gravity
    if target not in CASE_TARGETS:
        raise ValueError(f"unknown target {target!r}; expected one of {CASE_TARGETS}")
    d = df if "hora" in df.columns else df.withColumn("hora", F.hour(ts))
    if target == "gravidade" and "gravidade" not in d.columns:
        d = case_gravity(d)
    num = [K.LAT, K.LON, "hora"] + ([K.VICTIMS] if K.VICTIMS in d.columns else [])
    return d, num


def build_case_pipeline(num_cols: Sequence[str], target: str, seed: int = 42, num_trees: int = 100,
                        max_depth: int = DEEPEST, min_split: int = 2) -> Pipeline:
    """Label index of the (text) target (D8: always indexed), alphabetical zone
    code as a numeric feature (M3), assembler, random forest.  The original's
    unlimited depth becomes Spark's maximum depth, 30."""
    from pyspark.ml.feature import VectorAssembler
    lab = StringIndexer(inputCol=target, outputCol="label_idx", stringOrderType="alphabetAsc")
    zone = StringIndexer(inputCol=K.ZONE, outputCol="bairro_encoded", stringOrderType="alphabetAsc",
                         handleInvalid="keep")
    asm = VectorAssembler(inputCols=list(num_cols) + ["bairro_encoded"], outputCol="features")
    rf = DeepForest(numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=leaf_rows(min_split), seed=seed)
    return Pipeline(stages=[lab, zone, asm, rf])


def complete_cases(df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    """Rows with target, zone and all numeric features, and the names of these."""
    d, num = case_features(df, target)
    return d.na.drop(subset=num + [target, K.ZONE]), num


def grid_search(df: DataFrame, target: str = "gravidade", seed: int = 42, folds: int = 3, **grid) -> DataFrame:
    """Accuracy over ``folds`` folds of the case model's forest for 50, 100 and 200 trees, depths 3, 5, 10 and
    unlimited, and least node sizes 2, 5 and 10 (36 settings): see ``ml.grid.grid_scores``.

    Rows without target, zone or a numeric feature take no part; without any
    row there are no settings.
    """
    d, num = complete_cases(df, target)
    d = settled(ensure_parallelism(fold_column(d.select(K.ID, *{*num, K.ZONE, target}), folds, seed)))
    if d.isEmpty():
        return grid_scores(d, 0, seed, **grid)
    encoded = Pipeline(stages=build_case_pipeline(num, target, seed).getStages()[:-1]).fit(d).transform(d)
    return grid_scores(settled(encoded.select("features", "label_idx", "fold")), folds, seed, **grid)


def case_folds(pipe: Pipeline, train: DataFrame, folds: int, seed: int = 42) -> tuple[float | None, float | None]:
    """Mean and deviation of the accuracies of ``folds`` forests, each of all rows but those of its fold, on that
    fold; all grown in the same passes.  The encoders are fitted on all rows."""
    d = fold_column(train, folds, seed)
    rows, edges = prepared(Pipeline(stages=pipe.getStages()[:-1]).fit(d).transform(d), F.col("fold"))
    forest = pipe.getStages()[-1]
    job = folds_job(folds, forest.value("numTrees"), rows.agg(F.max("y")).first()[0] + 1, len(edges), [forest.value("minInstancesPerNode")], seed,
                    forest.value("maxDepth"))
    met = [right / n for right, n in fold_scores(rows, job, [job.depth]).values()]
    return (float(np.mean(met)), float(np.std(met))) if met else (None, None)


def train_case_model(df: DataFrame, target: str = "gravidade", test_size: float = 0.2, seed: int = 42,
                     tune: bool = False, cv_folds: int | None = 5, min_rows: int = 10,
                     grid=None) -> RiskModelResult:
    """M10/M11 second form: forest on position, hour, zone code (and victims)
    predicting case gravity, incident type or weapon; optional grid search
    (M16) on the training rows, whose best setting is fitted; report on the
    test rows (M17); k-fold accuracy (M15)."""
    from sentinela.ml.evaluate import classification_report
    from sentinela.operators.filters import min_rows as has_rows
    d, num = complete_cases(df, target)
    if not has_rows(d, min_rows):
        raise ValueError(f"fewer than {min_rows} complete rows")
    d = settled(ensure_parallelism(split(d.select(K.ID, *{*num, K.ZONE, target}), test_size, seed, stratify=target)))
    train = d.where(F.col("conjunto") == "treino")
    test = d.where(F.col("conjunto") == "teste")
    cv_mean = cv_std = None
    if tune:
        best = grid_search(train, target, seed, **(grid or {})).where("escolhido").first()
        cv_mean, cv_std = best["media"], best["desvio"]
        pipe = build_case_pipeline(num, target, seed, best["n_estimators"], best["max_depth"] or DEEPEST, best["min_samples_split"])
    else:
        pipe = build_case_pipeline(num, target, seed)
        if cv_folds:
            cv_mean, cv_std = case_folds(pipe, train, cv_folds, seed)
    model = pipe.fit(train)
    pred = confidence(with_label_text(model, model.transform(test)))
    pred = pred.select(K.ID, K.ZONE, F.col(target).cast("string").alias("label"),
                       F.col("prediction_label").alias("prediction"), "confianca")
    return RiskModelResult(model, pred, classification_report(pred), cv_mean, cv_std,
                           num + ["bairro_encoded"], "random_forest")


def predict_case(model: PipelineModel, scenarios: DataFrame, target: str = "gravidade") -> DataFrame:
    """M19 second form: scenario rows (position, hour, zone, victims) → class
    and confidence.  The target column is filled with a known label only to
    satisfy the fitted label indexer; it is not used."""
    known = model.stages[0].labels[0]
    d = scenarios.withColumn(target, F.lit(known))
    out = confidence(with_label_text(model, model.transform(d)))
    return out.select(*scenarios.columns, F.col("prediction_label").alias("previsao"), "confianca")
