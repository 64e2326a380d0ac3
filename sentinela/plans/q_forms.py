"""Registered queries: round trips of readers and writers (S1, S3–S7, F12, J6), the
batch job (M22), the case dashboard's model forms, and one-row checks of fitted
models whose labels no SQL can give."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.ml import anomaly as A, classify as M, cluster as C
from sentinela.ml.features import one_hot_stages
from sentinela.operators import filters
from sentinela.operators.joins import attach_predictions
from sentinela.plans import fixtures as X
from sentinela.plans.batch import score_and_label
from sentinela.plans.dashboards import CASE_ANOMALY, CASE_CLUSTER, with_codes
from sentinela.plans.hints import ensure_parallelism, settled
from sentinela.plans.oracle_base import with_
from sentinela.plans.q_aggs import CASE_SCOPE
from sentinela.plans.q_rows import AS_OF_EVENTS, CITY_SQL
from sentinela.plans.q_rules import SPLIT
from sentinela.plans.registry import query
from sentinela.schema import missing_columns
from sentinela.session import ensure_checkpoint_dir
from sentinela.sources import io

GEO = [K.LAT, K.LON, "hora"]


def _folder(spark, name: str) -> str:
    """A new place in the shared scratch folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- round trips ----
PLAIN = "SELECT occurrence_id, strftime(data_ocorrencia, '%Y-%m-%d %H:%M:%S') AS ts, tipo_crime, bairro, latitude, longitude, quantidade_vitimas FROM occ"


@query("s1_read_incidents", with_("occ") + PLAIN)
def s1(spark, d):
    """The incident table as CSV, with an alias and untidy header names, read back."""
    path = _folder(spark, "csv")
    X.occ(spark, d).withColumnRenamed(K.TYPE, f" {K.TYPE.upper()} ").write.option("header", True).csv(path)
    back = io.read_incidents(spark, path)
    return back.select(F.col(K.ID).cast("long").alias(K.ID), F.date_format(K.TS, "yyyy-MM-dd HH:mm:ss").alias("ts"),
                       K.TYPE, K.ZONE, K.LAT, K.LON, K.VICTIMS)


@query("s1_generated_key", with_("occ") + "SELECT count(*) AS linhas, count(*) AS chaves FROM "
       "(SELECT DISTINCT * EXCLUDE (occurrence_id) FROM occ)")
def s1_key(spark, d):
    """A table without a key: as many keys as different rows."""
    keyed = io.with_key(X.occ(spark, d).drop(K.ID).dropDuplicates())
    return keyed.agg(F.count(F.lit(1)).alias("linhas"), F.count_distinct(K.ID).alias("chaves"))


@query("s3_missing_columns", with_("occ") + "SELECT count(*) AS linhas, 'latitude,longitude' AS faltam FROM occ")
def s3(spark, d):
    df = X.occ(spark, d).drop(K.LAT, K.LON)
    missing = missing_columns(df, [K.TYPE, K.ZONE, K.LAT, K.LON, K.TS])
    return df.agg(F.count(F.lit(1)).alias("linhas"), F.lit(",".join(missing)).alias("faltam"))


@query("s4_read_results", with_("lab") + "SELECT ano, mes, count(*) AS n, sum(cluster) AS soma FROM lab GROUP BY ano, mes")
def s4(spark, d):
    path = _folder(spark, "results")
    io.write_results(X.lab(spark, d), path, {"a": 1.0})
    table, _ = io.read_results(spark, path)
    return table.groupBy(F.col("ano").cast("int").alias("ano"), F.col("mes").cast("int").alias("mes")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cluster").alias("soma"))


@query("s5_write_results", with_("lab") + """SELECT 'linhas' AS metric, CAST(count(*) AS DOUBLE) AS value FROM lab
UNION ALL SELECT 'anomalias', CAST(count(*) AS DOUBLE) FROM lab WHERE anomalia = -1""")
def s5(spark, d):
    path, lab = _folder(spark, "results"), X.lab(spark, d)
    row = lab.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("anomalia") == -1, 1)).alias("a")).first()
    io.write_results(lab, path, {"linhas": row["n"], "anomalias": row["a"]})
    return io.read_results(spark, path)[1].select("metric", "value")


@query("s6_export_csv", with_("occ") + "SELECT CAST(occurrence_id AS VARCHAR) AS occurrence_id, bairro, tipo_crime FROM occ")
def s6(spark, d):
    path = _folder(spark, "export")
    io.export_csv(X.occ(spark, d).select(K.ID, K.ZONE, K.TYPE), path)
    return spark.read.option("header", True).csv(path)


@query("s7_save_load_model", with_("cal") + "SELECT count(*) AS linhas, 0 AS diferentes, 'bairro' AS meta FROM cal")
def s7(spark, d):
    """A fitted feature pipeline saved and loaded: vectors that differ, and its metadata."""
    path, cal = _folder(spark, "model"), X.cal(spark, d)
    model = Pipeline(stages=one_hot_stages(cal, [K.ZONE], ["hora"])).fit(cal)
    io.save_model(model, path, {"features": [K.ZONE]})
    loaded, meta = io.load_model(spark, path)
    a = model.transform(cal).select(K.ID, vector_to_array("features").alias("a"))
    b = loaded.transform(cal).select(K.ID, vector_to_array("features").alias("b"))
    return a.join(b, K.ID).agg(F.count(F.lit(1)).alias("linhas"), F.count_if(F.col("a") != F.col("b")).cast("int").alias("diferentes"),
                               F.lit(meta["features"][0]).alias("meta"))


@query("f12_min_rows", with_("occ") + "SELECT count(*) AS linhas, count(*) >= 10 AS dez, count(*) >= 1000000000 AS bilhao FROM occ")
def f12(spark, d):
    df = X.occ(spark, d)
    return df.agg(F.count(F.lit(1)).alias("linhas"), F.lit(filters.min_rows(df, 10)).alias("dez"),
                  F.lit(filters.min_rows(df, 10**9)).alias("bilhao"))


@query("j6_attach_predictions", with_("pred") + """SELECT o.occurrence_id, o.tipo_crime, p.prediction
FROM occ o LEFT JOIN (SELECT * FROM pred WHERE occurrence_id % 3 <> 0) p USING (occurrence_id)""")
def j6(spark, d):
    """Predictions for two of three rows attached to all."""
    scored = X.pred(spark, d).where(F.col(K.ID) % 3 != 0).select(K.ID, "prediction")
    return attach_predictions(X.occ(spark, d).select(K.ID, K.TYPE), scored)


# ---------------------------------------------------------------- fitted models ----
@query("m4_kmeans_check", with_("cal") + "SELECT count(*) AS linhas, 0 AS sem_grupo, 5 AS grupos, 0 AS mal_postas FROM cal")
def m4_check(spark, d):
    """Rows, rows without a cluster, clusters, and rows that another centre is nearer to."""
    lab, _f, model = C.kmeans(X.cal(spark, d), k=5, seed=42)
    if model is None:
        return lab.agg(F.count(F.lit(1)).alias("linhas"), *[F.lit(0).alias(c) for c in ("sem_grupo", "grupos", "mal_postas")])
    v = vector_to_array("features")
    far = [F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)),
                       F.lit(0.0), lambda s, x: s + x) for c in model.clusterCenters()]
    lab = lab.select("cluster", F.array(*far).alias("far"))
    own = F.element_at("far", F.col("cluster") + 1)
    return lab.agg(F.count(F.lit(1)).alias("linhas"), F.count_if(F.col("cluster") < 0).cast("int").alias("sem_grupo"),
                   F.count_distinct("cluster").cast("int").alias("grupos"),
                   F.count_if(own > F.array_min("far") + 1e-6).cast("int").alias("mal_postas"))


@query("m6_hierarchical_check", with_("cal") + "SELECT count(*) AS linhas, 0 AS sem_grupo, 5 AS grupos FROM cal")
def m6_check(spark, d):
    lab = C.hierarchical(X.cal(spark, d), GEO, k=5)
    return lab.agg(F.count(F.lit(1)).alias("linhas"), F.count_if(F.col("cluster") < 0).cast("int").alias("sem_grupo"),
                   F.count_distinct("cluster").cast("int").alias("grupos"))


@query("m5_dbscan_check", with_("cal") + "SELECT count(*) AS linhas, 0 AS pequenos FROM cal")
def m5_check(spark, d):
    """Rows, and clusters of fewer rows than a core point needs."""
    sizes = C.dbscan(X.cal(spark, d), GEO, eps=0.3, min_samples=10).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("linhas"),
                     F.count_if((F.col("cluster") >= 0) & (F.col("n") < 10)).cast("int").alias("pequenos"))


@query("m8_isolation_forest_check", with_("cal") + "SELECT count(*) AS linhas, 0 AS fora, 0 AS discordam FROM cal")
def m8_check(spark, d):
    """Rows, scores out of range, and labels that disagree with the exact 95 % quantile of the scores."""
    lab = A.isolation_forest(X.cal(spark, d), GEO, 0.05, 100, 256, 42)
    cut = lab.agg(F.percentile("score_anomalia", 0.95)).scalar()
    score = F.col("score_anomalia")
    wrong = (F.col("anomalia") == -1) != (score > cut)
    return lab.agg(F.count(F.lit(1)).alias("linhas"), F.count_if((score <= 0) | (score > 1)).cast("int").alias("fora"),
                   F.count_if(wrong & (F.abs(score - cut) > 1e-9)).cast("int").alias("discordam"))


@query("m11_random_forest_check", with_("risk", extra=SPLIT) + "SELECT nivel_risco AS label, count(*) AS n, 0 AS fora FROM sp "
       "WHERE conjunto = 'teste' GROUP BY 1")
def m11_check(spark, d):
    """Test rows per class, and confidences out of range."""
    p = M.train_risk_model(X.occ(spark, d), "random_forest", cv_folds=None).predictions
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(
        (F.col("confianca") <= 0) | (F.col("confianca") > 100.000001)).cast("int").alias("fora"))


@query("m12_importance_check", "SELECT CAST(1.0 AS DOUBLE) AS soma, 0 AS negativas")
def m12_check(spark, d):
    r = M.train_risk_model(X.occ(spark, d), "random_forest", cv_folds=None)
    imp = M.feature_importance(r.model, M.risk_features(X.occ(spark, d)), top=10**6)
    return imp.agg(F.round(F.sum("importance"), 6).alias("soma"), F.count_if(F.col("importance") < 0).cast("int").alias("negativas"))


#: A risk level that follows from the hour alone, in SQL text for both engines.
PLANTED = f"CASE WHEN hora < 7 THEN '{K.RISK_LOW}' WHEN hora < 15 THEN '{K.RISK_MID}' ELSE '{K.RISK_HIGH}' END"


def _planted(spark, d):
    return X.cal(spark, d).withColumn("nivel_risco", F.expr(PLANTED))


@query("m12_planted_feature", with_("cal") + f"SELECT CASE WHEN count(DISTINCT {PLANTED}) > 1 THEN 'hora' END AS feature FROM cal")
def m12_planted(spark, d):
    """The most important feature of a forest where the level follows from the hour."""
    r = M.train_risk_model(_planted(spark, d), "random_forest", cv_folds=None)
    return M.feature_importance(r.model, M.risk_features(_planted(spark, d)), top=1).select("feature")


@query("m19_predict_planted", with_("cal") + f"""SELECT {PLANTED} AS nivel_risco, {PLANTED} AS previsao, count(*) AS n, 0 AS inseguras
FROM cal GROUP BY 1, 2""")
def m19_planted(spark, d):
    """Planted and predicted level of every row by the boosted model, and rows with less than 90 % confidence."""
    planted = _planted(spark, d)
    r = M.train_risk_model(planted, "xgboost", cv_folds=None)
    p = M.predict(r.model, planted.select(K.ID, K.ZONE, K.TS, "nivel_risco"), "xgboost")
    return p.groupBy("nivel_risco", "previsao").agg(F.count(F.lit(1)).alias("n"),
                                                    F.count_if(F.col("confianca") < 90).cast("int").alias("inseguras"))


@query("m19_predict_check", with_("occ") + "SELECT count(*) AS linhas, 0 AS sem_classe FROM occ")
def m19_check(spark, d):
    occ = X.occ(spark, d)
    r = M.train_risk_model(occ, "random_forest", cv_folds=None)
    p = M.predict(r.model, occ.select(K.ID, K.ZONE, K.TS), "random_forest")
    known = F.coalesce(F.col("previsao").isin(K.RISK_LOW, K.RISK_MID, K.RISK_HIGH), F.lit(False))
    return p.agg(F.count(F.lit(1)).alias("linhas"), F.count_if(~known).cast("int").alias("sem_classe"))


# ---------------------------------------------------------------- batch job ----
@query("m22_score_and_label", with_("occ", extra=f"""ok AS (SELECT DISTINCT * FROM occ WHERE {CITY_SQL}
  AND data_ocorrencia IS NOT NULL AND data_ocorrencia <= TIMESTAMP '2024-01-20 12:00:00' AND data_ocorrencia >= TIMESTAMP '2000-01-01 00:00:00'),
z AS (SELECT bairro, count(*) AS n FROM ok GROUP BY 1),
q AS (SELECT round(quantile_cont(CAST(n AS DOUBLE), 0.33), 9) AS q1, round(quantile_cont(CAST(n AS DOUBLE), 0.66), 9) AS q2 FROM z)""") + """
SELECT CASE WHEN z.n <= q.q1 THEN 'Baixo Risco' WHEN z.n <= q.q2 THEN 'Médio Risco' ELSE 'Alto Risco' END AS nivel_risco,
       count(*) AS n, 0 AS sem_rotulo FROM ok JOIN z USING (bairro) CROSS JOIN q GROUP BY 1""")
def m22(spark, d):
    """read (CSV without a key) → clean → derive → k-means (ten starts) → isolation forest → boosted risk model with
    five folds, the batch job's own settings: rows per risk level."""
    path = _folder(spark, "batch")
    X.occ(spark, d).write.option("header", True).csv(path)
    lab, _metrics, _r = score_and_label(io.read_incidents(spark, path), as_of=AS_OF_EVENTS)
    missing = F.col("cluster").isNull() | F.col("anomalia").isNull()
    return lab.groupBy("nivel_risco").agg(F.count(F.lit(1)).alias("n"), F.count_if(missing).cast("int").alias("sem_rotulo"))


# ---------------------------------------------------------------- case dashboard's forms ----
def _cases(spark, d):
    """Case types with alphabetical codes of type and zone."""
    return with_codes(filters.filter_in(X.cal(spark, d), K.TYPE, K.CASE_TYPES))


@query("m4_case_kmeans", with_("cal", extra="k AS (SELECT unnest(range(2, 9)) AS k)") + f"""
SELECT CAST(k AS INTEGER) AS k, n AS linhas, CAST(k AS INTEGER) AS grupos, true AS silhueta_valida
FROM k, (SELECT count(*) AS n FROM cal WHERE {CASE_SCOPE})""")
def m4_case(spark, d):
    """k = 2 … 8 on five encoded, scaled features: rows, clusters and a silhouette in range for each."""
    base, out = settled(ensure_parallelism(_cases(spark, d).select(K.ID, *CASE_CLUSTER))), None
    for k in range(2, 9):
        lab = C.cluster(base, "kmeans", k=k, n_init=1, cat_cols=[], num_cols=CASE_CLUSTER)
        s = C.silhouette(lab)
        row = lab.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("linhas"), F.count_distinct("cluster").cast("int").alias("grupos"),
                      F.lit(-1 <= s <= 1 and s != 0).alias("silhueta_valida"))
        out = row if out is None else out.unionByName(row)
    return out


@query("m5_case_dbscan", with_("cal") + f"SELECT count(*) AS linhas, 0 AS pequenos FROM cal WHERE {CASE_SCOPE}")
def m5_case(spark, d):
    """eps 0.5, 3 samples on the same features: rows, and clusters smaller than a core point needs."""
    sizes = C.cluster(_cases(spark, d), "dbscan", features=CASE_CLUSTER, eps=0.5, min_samples=3).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("linhas"), F.count_if((F.col("cluster") >= 0) & (F.col("n") < 3)).cast("int").alias("pequenos"))


@query("m7_silhouette_dbscan")
def m7_dbscan(spark, d):
    """Silhouette of the DBSCAN labels without noise, on the scaled features."""
    lab = C.cluster(_cases(spark, d), "dbscan", features=CASE_CLUSTER, eps=0.5, min_samples=3)
    return spark.range(1).select(F.lit(C.silhouette(C.with_vector(lab, CASE_CLUSTER))).alias("silhouette_sq"))


@query("m7_silhouette_hierarchical")
def m7_hier(spark, d):
    return spark.range(1).select(F.lit(C.silhouette(C.cluster(X.cal(spark, d), "hierarchical", features=GEO, k=5))).alias("silhouette_sq"))


@query("m7_silhouette_fixture", with_("lab", extra="""z AS (SELECT occurrence_id, cluster,
    [(latitude - avg(latitude) OVER ()) / stddev_pop(latitude) OVER (), (longitude - avg(longitude) OVER ()) / stddev_pop(longitude) OVER (),
     (CAST(hora AS DOUBLE) - avg(CAST(hora AS DOUBLE)) OVER ()) / stddev_pop(CAST(hora AS DOUBLE)) OVER ()] AS x FROM lab),
y AS (SELECT * FROM z WHERE cluster <> -1),
c AS (SELECT cluster, CAST(count(*) AS DOUBLE) AS n, [sum(x[1]), sum(x[2]), sum(x[3])] AS s, sum(list_dot_product(x, x)) AS q FROM y GROUP BY 1),
d AS (SELECT y.occurrence_id, y.cluster AS own, c.cluster AS other, c.n,
             c.n * list_dot_product(y.x, y.x) + c.q - 2 * list_dot_product(y.x, c.s) AS total FROM y CROSS JOIN c),
m AS (SELECT occurrence_id, max(CASE WHEN own = other THEN n END) AS n,
             max(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b
      FROM d GROUP BY 1)""") + """
SELECT round(avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette_sq FROM m""")
def m7_fixture(spark, d):
    """Silhouette (squared distances) of the labels given by a rule, noise left out, on scaled features."""
    s = C.silhouette(C.with_vector(X.lab(spark, d), GEO))
    return spark.createDataFrame([(round(s, 6),)], "silhouette_sq double")


@query("m8_case_isolation_forest", with_("cal") + f"SELECT count(*) AS linhas, 0 AS discordam FROM cal WHERE {CASE_SCOPE}")
def m8_case(spark, d):
    """10 % on six features."""
    lab = A.detect_anomalies(_cases(spark, d), "isolation_forest", features=CASE_ANOMALY, contamination=0.1)
    cut = lab.agg(F.percentile("score_anomalia", 0.9)).scalar()
    wrong = ((F.col("anomalia") == -1) != (F.col("score_anomalia") > cut)) & (F.abs(F.col("score_anomalia") - cut) > 1e-9)
    return lab.agg(F.count(F.lit(1)).alias("linhas"), F.count_if(wrong).cast("int").alias("discordam"))


@query("m9_case_lof", with_("cal") + f"SELECT count(*) AS linhas, 0 AS discordam FROM cal WHERE {CASE_SCOPE}")
def m9_case(spark, d):
    """10 neighbours, 10 % on six features."""
    lab = A.detect_anomalies(_cases(spark, d), "local_outlier_factor", features=CASE_ANOMALY, n_neighbors=10, contamination=0.1)
    cut = lab.agg(F.percentile("lof", 0.9)).scalar()
    wrong = ((F.col("anomalia") == -1) != (F.col("lof") > cut)) & (F.abs(F.col("lof") - cut) > 1e-9)
    return lab.agg(F.count(F.lit(1)).alias("linhas"), F.count_if(wrong).cast("int").alias("discordam"))
