"""Registered queries: rules, report, evaluation and SQL-expressible model
operators (R, S8, M1, M3, M14, M15, M17, M18, M20, M21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.functions import scalar as S
from sentinela.ml import evaluate as EV
from sentinela.ml.features import label_encode, standardize
from sentinela.ml.split import fold_column, split, split_counts
from sentinela.operators import derive, filters, insights as R
from sentinela.operators.report import report_tables
from sentinela.plans import fixtures as X
from sentinela.plans.oracle_base import AGEBAND, pct, rhu, with_
from sentinela.plans.q_aggs import CASE_SCOPE, SHARE_SQL, freq_sql, mode_sql
from sentinela.plans.q_rows import TOPT, TOPZ
from sentinela.plans.registry import query

RULE = "SELECT {rule} AS rule, CAST({subject} AS VARCHAR) AS subject, CAST({value} AS DOUBLE) AS value, {code} AS message_code"


def rule_sql(rule, subject, value, code):
    return RULE.format(rule=f"'{rule}'", subject=subject, value=value, code=code)


# ---------------------------------------------------------------- R ----
ZONE_TOP1 = f"""(SELECT bairro, n, {pct("n", "total", 1)} AS share FROM (
   SELECT bairro, count(*) AS n, sum(count(*)) OVER () AS total FROM {{src}} GROUP BY bairro) t
 WHERE bairro IS NOT NULL ORDER BY n DESC, bairro LIMIT 1)"""


@query("r1_report_insights", with_("cal") + f"""
{rule_sql("concentracao", "bairro", "share", "'ALTA_CONCENTRACAO'")} FROM {ZONE_TOP1.format(src="cal")} z WHERE share > 20.0
UNION ALL
SELECT * FROM ({rule_sql("resolucao", "NULL", "r", "CASE WHEN r < 70.0 THEN 'RESOLUCAO_BAIXA' WHEN r > 85.0 THEN 'RESOLUCAO_EXCELENTE' END")}
  FROM (SELECT {pct("count(*) FILTER (WHERE status_investigacao = 'Concluído')", "count(*)", 1)} AS r FROM cal) a)
  WHERE message_code IS NOT NULL
UNION ALL
{rule_sql("horario", "hora", "hora", "'PICO_NOTURNO'")} FROM (
  {freq_sql("hora", "cal")} ORDER BY n DESC, hora LIMIT 1) p WHERE hora >= 22 OR hora <= 6""")
def r1(spark, d):
    return R.report_insights(X.occ(spark, d))


@query("r1_report_insights_scope", with_("cal", extra="sc AS (SELECT * FROM cal WHERE " + CASE_SCOPE + ")") + f"""
{rule_sql("concentracao", "bairro", "share", "'ALTA_CONCENTRACAO'")} FROM {ZONE_TOP1.format(src="sc")} z WHERE share > 20.0
UNION ALL
SELECT * FROM ({rule_sql("resolucao", "NULL", "r", "CASE WHEN r < 70.0 THEN 'RESOLUCAO_BAIXA' WHEN r > 85.0 THEN 'RESOLUCAO_EXCELENTE' END")}
  FROM (SELECT {pct("count(*) FILTER (WHERE status_investigacao = 'Concluído')", "count(*)", 1)} AS r FROM sc) a)
  WHERE message_code IS NOT NULL
UNION ALL
{rule_sql("horario", "hora", "hora", "'PICO_NOTURNO'")} FROM (
  {freq_sql("hora", "sc")} ORDER BY n DESC, hora LIMIT 1) p WHERE hora >= 22 OR hora <= 6""")
def r1b(spark, d):
    return R.report_insights(filters.filter_in(X.occ(spark, d), K.TYPE, K.CASE_TYPES))


@query("r2_cluster_insights", with_("lab", extra="""cl AS (SELECT * FROM lab WHERE cluster <> -1),
zc AS (SELECT cluster, bairro, count(*) AS n FROM cl WHERE bairro IS NOT NULL GROUP BY 1, 2),
tt AS (SELECT cluster, count(*) AS t FROM cl GROUP BY 1),
tz AS (SELECT cluster, bairro, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, bairro) AS rk
                                      FROM zc) WHERE rk = 1)""") + f"""
SELECT * FROM ({rule_sql("cluster_horario", "cluster", rhu("h", 2),
                         "CASE WHEN h >= 22 OR h <= 6 THEN 'PADRAO_NOTURNO' WHEN h > 6 AND h <= 12 THEN 'PADRAO_MATINAL' END")}
  FROM (SELECT cluster, avg(hora) AS h FROM cl GROUP BY cluster) a) WHERE message_code IS NOT NULL
UNION ALL
{rule_sql("cluster_concentracao", "concat_ws(':', CAST(tz.cluster AS VARCHAR), tz.bairro)", pct("tz.n", "tt.t", 1),
          "'FOCO_GEOGRAFICO'")}
FROM tz JOIN tt USING (cluster) WHERE {pct("tz.n", "tt.t", 1)} > 70.0""")
def r2(spark, d):
    return R.cluster_insights(X.lab(spark, d))


ANOM_EXTRA = """an AS (SELECT * FROM lab WHERE anomalia = -1),
az AS (SELECT bairro, n, total FROM (SELECT bairro, count(*) AS n, sum(count(*)) OVER () AS total FROM an GROUP BY bairro)
       WHERE bairro IS NOT NULL ORDER BY n DESC, bairro LIMIT 1)"""


@query("r3_anomaly_alerts", with_("lab", extra=ANOM_EXTRA) + f"""
{rule_sql("alerta_noturno", "NULL", pct("k", "t", 1), "'ALERTA_NOTURNO'")}
FROM (SELECT count(*) FILTER (WHERE hora >= 22 OR hora <= 6) AS k, count(*) AS t FROM an) a WHERE k > t * 0.5
UNION ALL
{rule_sql("alerta_geografico", "bairro", pct("n", "total", 1), "'ALERTA_GEOGRAFICO'")} FROM az WHERE n > total * 0.3""")
def r3(spark, d):
    return R.anomaly_alerts(X.lab(spark, d))


@query("r3_anomaly_alerts_hot_zone", with_("lab", extra=ANOM_EXTRA.replace(
        "FROM lab", "FROM (SELECT * REPLACE (CASE WHEN occurrence_id % 40 = 0 THEN 'CENTRO' ELSE bairro END AS bairro) FROM lab)")) + f"""
{rule_sql("alerta_noturno", "NULL", pct("k", "t", 1), "'ALERTA_NOTURNO'")}
FROM (SELECT count(*) FILTER (WHERE hora >= 22 OR hora <= 6) AS k, count(*) AS t FROM an) a WHERE k > t * 0.5
UNION ALL
{rule_sql("alerta_geografico", "bairro", pct("n", "total", 1), "'ALERTA_GEOGRAFICO'")} FROM az WHERE n > total * 0.3""")
def r3h(spark, d):
    """Half of the anomalies are moved to one zone."""
    zone = F.when(F.col(K.ID) % 40 == 0, "CENTRO").otherwise(F.col(K.ZONE))
    return R.anomaly_alerts(X.lab(spark, d).withColumn(K.ZONE, zone))


@query("r3_anomaly_alerts_night_scope", with_("lab", extra=ANOM_EXTRA.replace(
        "WHERE anomalia = -1", "WHERE anomalia = -1 AND (hora >= 20 OR hora <= 7)")) + f"""
{rule_sql("alerta_noturno", "NULL", pct("k", "t", 1), "'ALERTA_NOTURNO'")}
FROM (SELECT count(*) FILTER (WHERE hora >= 22 OR hora <= 6) AS k, count(*) AS t FROM an) a WHERE k > t * 0.5
UNION ALL
{rule_sql("alerta_geografico", "bairro", pct("n", "total", 1), "'ALERTA_GEOGRAFICO'")} FROM az WHERE n > total * 0.3""")
def r3b(spark, d):
    lab = X.lab(spark, d)
    return R.anomaly_alerts(lab.where((F.col("hora") >= 20) | (F.col("hora") <= 7)))


@query("r4_statistics_insights", with_("lab") + f"""
{rule_sql("horarios_pico", "(SELECT string_agg(CAST(hora AS VARCHAR) || ':00', ', ' ORDER BY n DESC, hora) FROM (" +
          freq_sql("hora", "lab") + " ORDER BY n DESC, hora LIMIT 3))", "NULL", "'HORARIOS_PICO'")}
UNION ALL
{rule_sql("concentracao_top3", "NULL", pct("coalesce((SELECT sum(n) FROM (" + TOPZ.replace("SELECT bairro FROM", "SELECT n FROM").format(k=3).replace("FROM occ", "FROM lab") + ")), 0)", "(SELECT count(*) FROM lab)", 1), "'CONCENTRACAO_TOP3'")}
UNION ALL
{rule_sql("diversidade_media", "NULL", rhu("(SELECT avg(dv) FROM (SELECT bairro, count(DISTINCT tipo_crime) AS dv FROM lab WHERE bairro IS NOT NULL GROUP BY bairro))", 6), "'DIVERSIDADE'")}
UNION ALL
{rule_sql("taxa_anomalias", "NULL", "(SELECT " + pct("count(*) FILTER (WHERE anomalia = -1)", "count(*)", 2) + " FROM lab)", "'TAXA_ANOMALIAS'")}""")
def r4(spark, d):
    return R.statistics_insights(X.lab(spark, d))


@query("r5_method_insights", with_("occ", extra="""top AS (SELECT descricao_modus_operandi, n FROM (
    SELECT descricao_modus_operandi, count(*) AS n FROM occ WHERE descricao_modus_operandi IS NOT NULL GROUP BY 1)
  ORDER BY n DESC, descricao_modus_operandi LIMIT 1)""") + f"""
{rule_sql("metodo_dominante", "descricao_modus_operandi", "n", "'METODO_DOMINANTE'")} FROM top
UNION ALL
{rule_sql("bairro_do_metodo", "bairro", "n", "'BAIRRO_METODO'")} FROM (
  {mode_sql("bairro", "occ", "descricao_modus_operandi IN (SELECT descricao_modus_operandi FROM top)")})
UNION ALL
{rule_sql("n_metodos", "NULL", "(SELECT count(DISTINCT descricao_modus_operandi) FROM occ)", "'N_METODOS'")}""")
def r5(spark, d):
    return R.method_insights(X.occ(spark, d))


@query("r6_typical_profile", with_("occ", extra=f"b AS (SELECT *, {AGEBAND} AS faixa_etaria FROM occ)") + f"""
{rule_sql("sexo_mais_comum", "sexo_suspeito", "n", "'PERFIL_SEXO'")} FROM ({mode_sql("sexo_suspeito", "b")})
UNION ALL
{rule_sql("faixa_mais_comum", "faixa_etaria", "n", "'PERFIL_FAIXA'")} FROM ({mode_sql("faixa_etaria", "b")})
UNION ALL
{rule_sql("arma_mais_comum", "arma_utilizada", "n", "'PERFIL_ARMA'")} FROM ({mode_sql("arma_utilizada", "b")})
UNION ALL
{rule_sql("pct_masculino", "NULL", pct("m", "t", 1), "'PCT_MASCULINO'")} FROM (
  SELECT count(*) FILTER (WHERE sexo_suspeito = 'Masculino') AS m, count(sexo_suspeito) AS t FROM b) WHERE m > 0""")
def r6(spark, d):
    return R.typical_profile(derive.add_age_band(X.occ(spark, d)))


@query("r7_risk_recommendation", with_("pred") + """
SELECT occurrence_id, prediction, CASE WHEN contains(prediction, 'Alto') THEN 'ACOES_ALTO'
  WHEN contains(prediction, 'Médio') THEN 'ACOES_MEDIO' ELSE 'ROTINA' END AS recomendacao FROM pred""")
def r7(spark, d):
    return R.risk_recommendation(X.pred(spark, d)).select(K.ID, "prediction", "recomendacao")


@query("r8_zone_top10", with_("occ") + freq_sql(K.ZONE) + " ORDER BY n DESC, bairro LIMIT 10")
def r8(spark, d):
    return R.zone_statistics(X.occ(spark, d))[0]


@query("r8_zone_type_heat", with_("occ") + f"""
SELECT bairro, tipo_crime, count(*) AS n FROM occ
WHERE bairro IN ({TOPZ.format(k=5)}) AND tipo_crime IN ({TOPT.format(k=5)}) GROUP BY 1, 2""")
def r8b(spark, d):
    return R.zone_statistics(X.occ(spark, d))[1]


# ---------------------------------------------------------------- S8 ---
@query("s8_report_tables", with_("cal", extra="sc AS (SELECT * FROM cal WHERE " + CASE_SCOPE + ")") + f"""
SELECT 'total' AS secao, CAST(NULL AS VARCHAR) AS chave, count(*) AS n, CAST(NULL AS DOUBLE) AS pct FROM sc
UNION ALL
SELECT 'resolucao', NULL, count(*) FILTER (WHERE status_investigacao = 'Concluído'),
       {pct("count(*) FILTER (WHERE status_investigacao = 'Concluído')", "count(*)", 1)} FROM sc
UNION ALL
SELECT * FROM (SELECT 'hora_pico', CAST(hora AS VARCHAR), n, CAST(NULL AS DOUBLE) FROM ({freq_sql("hora", "sc")})
               ORDER BY n DESC, hora LIMIT 1)
UNION ALL
SELECT 'tipo', tipo_crime, n, pct FROM ({SHARE_SQL.format(col="tipo_crime", src="sc", p=pct("n", "total", 1))})
UNION ALL
SELECT * FROM (SELECT 'bairro_top5', bairro, n, pct FROM ({SHARE_SQL.format(col="bairro", src="sc", p=pct("n", "total", 1))})
               ORDER BY n DESC, bairro LIMIT 5)""")
def s8(spark, d):
    return report_tables(filters.filter_in(X.occ(spark, d), K.TYPE, K.CASE_TYPES))


# ---------------------------------------------------------------- M ----
@query("m1_standardize", with_("cal") + f"""
SELECT occurrence_id,
  {rhu("(latitude - avg(latitude) OVER ()) / stddev_pop(latitude) OVER ()", 6)} AS z_latitude,
  {rhu("(longitude - avg(longitude) OVER ()) / stddev_pop(longitude) OVER ()", 6)} AS z_longitude,
  {rhu("(hora - avg(hora) OVER ()) / stddev_pop(hora) OVER ()", 6)} AS z_hora
FROM cal""")
def m1(spark, d):
    z = standardize(X.cal(spark, d), [K.LAT, K.LON, "hora"])
    return z.select(K.ID, *[S.round_half_up(f"z_{c}", 6).alias(f"z_{c}") for c in (K.LAT, K.LON, "hora")])


@query("m3_label_encode", with_("occ") + """
SELECT occurrence_id, CAST(dense_rank() OVER (ORDER BY bairro) - 1 AS DOUBLE) AS bairro_idx FROM occ""")
def m3(spark, d):
    return label_encode(X.occ(spark, d), K.ZONE).select(K.ID, "bairro_idx")


HASH_U = "CAST(('0x' || substr(md5(CAST(occurrence_id AS VARCHAR) || ':42'), 1, 8)) AS BIGINT) / 4294967296.0"


SPLIT = f"""sp AS (SELECT occurrence_id, nivel_risco, CASE WHEN row_number() OVER (PARTITION BY nivel_risco ORDER BY {HASH_U}, occurrence_id)
    <= floor(count(*) OVER (PARTITION BY nivel_risco) * 0.2 + 0.5) THEN 'teste' ELSE 'treino' END AS conjunto FROM risk)"""


@query("m14_split", with_("risk", extra=SPLIT) + "SELECT occurrence_id, conjunto FROM sp")
def m14(spark, d):
    return split(X.risk(spark, d), stratify="nivel_risco").select(K.ID, "conjunto")


@query("m14_split_counts", with_("risk", extra=SPLIT) + "SELECT nivel_risco, conjunto, count(*) AS n FROM sp GROUP BY 1, 2")
def m14b(spark, d):
    return split_counts(split(X.risk(spark, d), stratify="nivel_risco"), "nivel_risco")


@query("m15_fold_column", with_("occ") + f"""
SELECT occurrence_id, CAST(floor({HASH_U.replace("':42'", "':42:fold'")} * 5.0) AS INTEGER) AS fold FROM occ""")
def m15f(spark, d):
    return fold_column(X.occ(spark, d)).select(K.ID, "fold")


@query("m17_classification_report", with_("pred", extra="""cells AS (SELECT label, prediction, count(*) AS n FROM pred GROUP BY 1, 2),
per AS (SELECT classe, sum(tp) AS tp, sum(sup) AS support, sum(pr) AS pred FROM (
    SELECT label AS classe, n AS sup, 0 AS pr, CASE WHEN label = prediction THEN n ELSE 0 END AS tp FROM cells
    UNION ALL SELECT prediction, 0, n, 0 FROM cells) WHERE classe IS NOT NULL GROUP BY classe),
pr AS (SELECT *, CASE WHEN pred > 0 THEN CAST(tp AS DOUBLE) / CAST(pred AS DOUBLE) ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / CAST(support AS DOUBLE) ELSE 0.0 END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
      FROM pr),
tot AS (SELECT sum(support) AS s, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
               sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM f)""") + f"""
SELECT classe, {rhu("precision", 6)} AS precision, {rhu("recall", 6)} AS recall, {rhu("f1", 6)} AS f1,
       CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'macro avg', {rhu("mp", 6)}, {rhu("mr", 6)}, {rhu("mf", 6)}, CAST(s AS BIGINT) FROM tot
UNION ALL SELECT 'weighted avg', {rhu("CASE WHEN s > 0 THEN wp / s ELSE 0.0 END", 6)},
                 {rhu("CASE WHEN s > 0 THEN wr / s ELSE 0.0 END", 6)}, {rhu("CASE WHEN s > 0 THEN wf / s ELSE 0.0 END", 6)},
                 CAST(s AS BIGINT) FROM tot
UNION ALL SELECT 'accuracy', NULL, NULL, {rhu("CASE WHEN s > 0 THEN CAST(tp AS DOUBLE) / CAST(s AS DOUBLE) ELSE 0.0 END", 6)},
                 CAST(s AS BIGINT) FROM tot""")
def m17(spark, d):
    return EV.classification_report(X.pred(spark, d))


@query("m18_confusion_matrix", with_("pred") + "SELECT label, prediction, count(*) AS n FROM pred GROUP BY 1, 2")
def m18(spark, d):
    return EV.confusion_matrix(X.pred(spark, d))


@query("m20_fairness_by_group", with_("pred", extra="""g AS (SELECT bairro, sum(CASE WHEN label <> prediction THEN 1 ELSE 0 END) AS e,
                  count(*) AS t FROM pred WHERE bairro IS NOT NULL GROUP BY bairro)""") + f"""
SELECT bairro, {rhu("CAST(e AS DOUBLE) / CAST(t AS DOUBLE)", 6)} AS erro,
       CAST(e AS DOUBLE) / CAST(t AS DOUBLE) > (CAST(sum(e) OVER () AS DOUBLE) / CAST(sum(t) OVER () AS DOUBLE)) * 1.5 AS vies
FROM g""")
def m20(spark, d):
    return EV.fairness_by_group(X.pred(spark, d))


@query("m21_anomaly_profile", with_("lab", extra="an AS (SELECT * FROM lab WHERE anomalia = -1)") + f"""
SELECT 'total' AS item, CAST(NULL AS VARCHAR) AS chave, count(*) FILTER (WHERE anomalia = -1) AS n,
       {pct("count(*) FILTER (WHERE anomalia = -1)", "count(*)", 1)} AS pct FROM lab
UNION ALL SELECT 'tipo_comum', tipo_crime, n, NULL FROM ({mode_sql("tipo_crime", "an")})
UNION ALL SELECT 'bairro_comum', bairro, n, NULL FROM ({mode_sql("bairro", "an")})
UNION ALL SELECT 'hora_comum', CAST(hora AS VARCHAR), n, NULL FROM ({mode_sql("hora", "an")})
UNION ALL SELECT * FROM (SELECT 'tipo_top3', tipo_crime, n, pct FROM (
    {SHARE_SQL.format(col="tipo_crime", src="an", p=pct("n", "total", 1))}) ORDER BY n DESC, tipo_crime LIMIT 3)""")
def m21(spark, d):
    return EV.anomaly_profile(X.lab(spark, d))
