"""Registered queries: model operators.

Deterministic ones (LOF scores, cluster profile) have SQL oracles; the
fitted models (k-means, forests, boosting) depend on seeds and partitioning
and are checked by row counts here and by invariants in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.functions.scalar import round_half_up
from sentinela.ml import anomaly as A, classify as M, cluster as C
from sentinela.operators import filters
from sentinela.plans import fixtures as X
from sentinela.plans.oracle_base import pct, rhu, with_
from sentinela.plans.q_aggs import CASE_SCOPE
from sentinela.plans.q_rows import PERIOD_SQL, WD_SQL
from sentinela.plans.registry import query


def _scope(spark, d):
    return filters.filter_in(X.cal(spark, d), K.TYPE, K.CASE_TYPES)


@query("m4_kmeans")
def m4(spark, d):
    lab, _f, _m = C.kmeans(X.cal(spark, d), k=5, seed=42, n_init=10)
    return lab.select(K.ID, "cluster")


@query("m5_dbscan")
def m5(spark, d):
    """The batch job's form: all rows."""
    return C.dbscan(X.cal(spark, d), [K.LAT, K.LON, "hora"], eps=0.3, min_samples=10).select(K.ID, "cluster")


@query("m6_hierarchical")
def m6(spark, d):
    return C.hierarchical(X.cal(spark, d), [K.LAT, K.LON, "hora"], k=5).select(K.ID, "cluster")


@query("m7_silhouette")
def m7(spark, d):
    lab, _f, _m = C.kmeans(X.cal(spark, d), k=5, seed=42, n_init=10)
    return spark.createDataFrame([(C.silhouette(lab),)], "silhouette_sq double")


@query("m8_isolation_forest")
def m8(spark, d):
    return A.isolation_forest(X.cal(spark, d), [K.LAT, K.LON, "hora"], 0.05, 100, 256, 42) \
        .select(K.ID, "anomalia", "score_anomalia")


LOF_SQL = """pr AS (SELECT *, min(id) OVER (PARTITION BY a, b, c) AS rep FROM p),
d AS (SELECT p1.id AS p, p2.id AS q, p2.rep AS qrep,
             sqrt(((p1.a - p2.a) * (p1.a - p2.a) + (p1.b - p2.b) * (p1.b - p2.b)) + (p1.c - p2.c) * (p1.c - p2.c)) AS dist
      FROM pr p1 JOIN pr p2 ON p1.id <> p2.id),
nb AS (SELECT p, q, dist FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY dist, qrep, q) AS rk FROM d)
       WHERE rk <= {k}),
kd AS (SELECT p, max(dist) AS kd FROM nb GROUP BY p),
lrd AS (SELECT nb.p, 1.0 / (avg(greatest(kd.kd, nb.dist)) + 1e-10) AS lrd FROM nb JOIN kd ON kd.p = nb.q GROUP BY nb.p),
lf AS (SELECT nb.p, avg(l2.lrd) AS m FROM nb JOIN lrd l2 ON l2.p = nb.q GROUP BY nb.p)"""


@query("m9_local_outlier_factor")
def m9(spark, d):
    """The batch job's form: all rows, 20 neighbours."""
    r = A.lof_scores(X.cal(spark, d), [K.LAT, K.LON, "hora"], 20)
    return r.select(K.ID, round_half_up("lof", 6).alias("lof"))


@query("m9_lof_case_scope", with_("cal", extra=f"""p AS (SELECT occurrence_id AS id, latitude AS a, longitude AS b,
    CAST(hora AS DOUBLE) AS c FROM cal WHERE {CASE_SCOPE}),
""" + LOF_SQL.format(k=20)) + f"""
SELECT lf.p AS occurrence_id, {rhu("lf.m / lrd.lrd", 6)} AS lof FROM lf JOIN lrd USING (p)""")
def m9_scope(spark, d):
    """The case dashboard's rows (its types are the feature)."""
    s = _scope(spark, d).withColumn("h", F.col("hora").cast("double"))
    r = A.lof_scores(s, [K.LAT, K.LON, "h"], 20, standardize_features=False)
    return r.select(K.ID, round_half_up("lof", 6).alias("lof"))


@query("m9_lof_labels")
def m9c(spark, d):
    return A.local_outlier_factor(X.cal(spark, d), [K.LAT, K.LON, "hora"], 20, 0.05).select(K.ID, "anomalia", "lof")


@query("m10_train_risk_model")
def m10(spark, d):
    """Boosted trees with the batch job's defaults, five folds included."""
    return M.train_risk_model(X.occ(spark, d), "xgboost").predictions


@query("m11_random_forest")
def m11(spark, d):
    return M.train_risk_model(X.occ(spark, d), "random_forest", cv_folds=None).predictions


@query("m12_feature_importance")
def m12(spark, d):
    r = M.train_risk_model(X.occ(spark, d), "random_forest", cv_folds=None)
    return M.feature_importance(r.model, M.risk_features(X.occ(spark, d)))


@query("m13_cluster_profile", with_("lab", extra="""lg AS (SELECT cluster, 'tipo_crime' AS dimensao, tipo_crime AS valor FROM lab WHERE cluster <> -1
               UNION ALL SELECT cluster, 'bairro', bairro FROM lab WHERE cluster <> -1),
cnt AS (SELECT cluster, dimensao, valor, count(*) AS n FROM lg GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n) OVER (PARTITION BY cluster, dimensao) AS tot FROM cnt),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster, dimensao ORDER BY n DESC, valor) AS rk FROM t
      WHERE valor IS NOT NULL)""") + f"""
SELECT cluster, dimensao, valor, n, {pct("n", "tot", 1)} AS pct, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 5""")
def m13(spark, d):
    return C.cluster_profile(X.lab(spark, d))


@query("m15_cross_validate")
def m15(spark, d):
    r = M.train_risk_model(X.occ(spark, d), "random_forest", cv_folds=5)
    return spark.createDataFrame([(r.cv_mean, r.cv_std)], "cv_media double, cv_desvio double")


@query("m15_boosted_cross_validate")
def m15b(spark, d):
    """Mean and deviation of the five folds' accuracies of the boosted model, grown in the passes of the model itself."""
    r = M.train_risk_model(X.occ(spark, d), "xgboost")
    return spark.createDataFrame([(r.cv_mean, r.cv_std)], "cv_media double, cv_desvio double")


@query("m19_predict_boosted")
def m19b(spark, d):
    """Class and probability of the boosted model for every (zone, time) of the table."""
    occ = X.occ(spark, d)
    r = M.train_risk_model(occ, "xgboost", cv_folds=None)  # m15_boosted_cross_validate has the folds
    return M.predict(r.model, occ.select(K.ID, K.ZONE, K.TS), "xgboost").select(K.ID, "previsao", "confianca")


@query("m19_predict")
def m19(spark, d):
    occ = X.occ(spark, d)
    r = M.train_risk_model(occ, "random_forest", cv_folds=None)
    scen = occ.select(K.ID, K.ZONE, K.TS)   # batch of scenarios: every (zone, time) of the table
    return M.predict(r.model, scen, "random_forest").select(K.ID, "previsao", "confianca")


@query("m2_one_hot", with_("cal", extra=f"""f AS (SELECT occurrence_id, bairro, {WD_SQL} AS dia_semana, {PERIOD_SQL} AS periodo_dia,
    hora, mes, dow FROM cal WHERE hora IS NOT NULL AND mes IS NOT NULL AND dow IS NOT NULL),
lv AS (SELECT list_sort(list(DISTINCT bairro))[2:] AS z, list_sort(list(DISTINCT dia_semana))[2:] AS w,
              list_sort(list(DISTINCT periodo_dia))[2:] AS p FROM f)""") + """
SELECT occurrence_id, list_concat(list_concat(list_concat([CASE WHEN bairro = x THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR x IN lv.z],
    [CASE WHEN dia_semana = x THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR x IN lv.w]),
    [CASE WHEN periodo_dia = x THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR x IN lv.p]),
    [hora::DOUBLE, mes::DOUBLE, CASE WHEN dow >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END]) AS features
FROM f, lv""")
def m2(spark, d):
    """Dummies of zone, weekday and period (first level dropped) + numbers, as an array."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    from sentinela.ml.features import one_hot_stages
    c = X.cal(spark, d).withColumn("fim_semana_n", F.col("fim_semana").cast("double"))
    stages = one_hot_stages(c, M.RISK_CATEGORICAL, M.RISK_NUMERIC, "features", drop_first=True)
    out = Pipeline(stages=stages).fit(c).transform(c)
    return out.select(K.ID, vector_to_array("features").alias("features"))


@query("m10_case_model")
def m10b(spark, d):
    """Second form on the case scope: predict case gravity."""
    r = M.train_case_model(filters.filter_in(X.occ(spark, d), K.TYPE, K.CASE_TYPES), "gravidade")
    return r.predictions


@query("m16_grid_search")
def m16(spark, d):
    """36 settings of the case model's forest over three folds: mean and deviation of the accuracy, and the best."""
    return M.grid_search(filters.filter_in(X.occ(spark, d), K.TYPE, K.CASE_TYPES), "gravidade")
