"""Registered queries: aggregations, top-N and set operations (A, T, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.functions import scalar as S
from sentinela.operators import clean, crosstab as X6, derive, filters, geo, profile as P, risk
from sentinela.plans import fixtures as X
from sentinela.plans.oracle_base import AGEBAND, pct, rhu, with_
from sentinela.plans.q_rows import CITY_SQL, SPEC, SPEC_SQL, TOPZ
from sentinela.plans.hints import numbered
from sentinela.plans.registry import query

CASE_SCOPE = "tipo_crime IN ('Violência Doméstica', 'Estupro', 'Ameaça')"


def freq_sql(col: str, src: str = "occ", where: str = "TRUE") -> str:
    return f"SELECT {col}, count(*) AS n FROM {src} WHERE {col} IS NOT NULL AND {where} GROUP BY {col}"


# ---------------------------------------------------------------- A1 ---
for _col in (K.TYPE, K.ZONE, K.WEAPON, K.SEX, K.SUSPECTS, K.METHOD, K.STATUS, K.PRECINCT):
    def _mk(c):
        return lambda spark, d: P.frequency(X.occ(spark, d), c)
    query(f"a1_frequency_{_col}", with_("occ") + freq_sql(_col))(_mk(_col))


@query("a1_frequency_faixa_etaria", with_("occ") + f"""
SELECT faixa_etaria, count(*) AS n FROM (SELECT {AGEBAND} AS faixa_etaria FROM occ) t
WHERE faixa_etaria IS NOT NULL GROUP BY faixa_etaria""")
def a1_age(spark, d):
    return P.frequency(derive.add_age_band(X.occ(spark, d)), "faixa_etaria")


# ---------------------------------------------------------------- A2/A3/A4/A5 ---
@query("a2_hour_histogram", with_("cal") + freq_sql("hora", "cal"))
def a2(spark, d):
    return P.hour_histogram(X.occ(spark, d))


@query("a2_peak_hour", with_("cal") + freq_sql("hora", "cal") + " ORDER BY n DESC, hora ASC LIMIT 1")
def a2p(spark, d):
    return P.peak_hour(X.occ(spark, d))


WDAYS = ("(VALUES (1, 'segunda-feira'), (2, 'terça-feira'), (3, 'quarta-feira'), (4, 'quinta-feira'), "
         "(5, 'sexta-feira'), (6, 'sábado'), (7, 'domingo')) AS w(dow, dia_semana)")
WEEK_SQL = (f"SELECT w.dow, w.dia_semana, coalesce(c.n, 0) AS n FROM {WDAYS} "
            "LEFT JOIN (SELECT dow, count(*) AS n FROM cal WHERE {where} GROUP BY dow) c ON c.dow = w.dow")


@query("a3_weekday_histogram", with_("cal") + WEEK_SQL.format(where=CASE_SCOPE))
def a3(spark, d):
    return P.weekday_histogram(filters.filter_in(X.occ(spark, d), K.TYPE, K.CASE_TYPES))


@query("a3_peak_day", with_("cal") + WEEK_SQL.format(where="TRUE") + " ORDER BY n DESC, w.dow ASC LIMIT 1")
def a3p(spark, d):
    return P.peak_day(X.occ(spark, d))


@query("a4_monthly_trend", with_("ordi") + """
SELECT strftime(data_ocorrencia, '%Y-%m') AS mes_ano, count(*) AS n FROM ordi
WHERE data_ocorrencia IS NOT NULL GROUP BY 1""")
def a4(spark, d):
    return P.monthly_trend(X.ordi(spark, d))


@query("a5_hour_weekday_matrix", with_("cal") + """
SELECT g.hora, g.dow, coalesce(c.n, 0) AS n
FROM (SELECT CAST(i // 7 AS INTEGER) AS hora, CAST(i % 7 + 1 AS INTEGER) AS dow FROM range(0, 168) r(i)) g
LEFT JOIN (SELECT hora, dow, count(tipo_crime) AS n FROM cal GROUP BY hora, dow) c
  ON c.hora = g.hora AND c.dow = g.dow""")
def a5(spark, d):
    return X6.hour_weekday_matrix(X.occ(spark, d))


# ---------------------------------------------------------------- A6/A7/A8 ---
@query("a6_crosstab", with_("occ") + """
SELECT tipo_crime, sexo_suspeito, count(*) AS n FROM occ
WHERE tipo_crime IS NOT NULL AND sexo_suspeito IS NOT NULL GROUP BY 1, 2""")
def a6(spark, d):
    return X6.crosstab(X.occ(spark, d), K.TYPE, K.SEX)


@query("a6_crosstab_zone_method", with_("occ") + """
SELECT bairro, descricao_modus_operandi, count(*) AS n FROM occ
WHERE bairro IS NOT NULL AND descricao_modus_operandi IS NOT NULL GROUP BY 1, 2""")
def a6b(spark, d):
    return X6.crosstab(X.occ(spark, d), K.ZONE, K.METHOD)


@query("a6_crosstab_wide", with_("occ") + """
SELECT tipo_crime,
  count(*) FILTER (WHERE arma_utilizada = 'Arma Branca') AS "Arma Branca",
  count(*) FILTER (WHERE arma_utilizada = 'Arma de Fogo') AS "Arma de Fogo",
  count(*) FILTER (WHERE arma_utilizada = 'Faca') AS "Faca",
  count(*) FILTER (WHERE arma_utilizada = 'Outros') AS "Outros",
  count(*) FILTER (WHERE arma_utilizada = 'Sem Arma') AS "Sem Arma"
FROM occ WHERE tipo_crime IS NOT NULL GROUP BY tipo_crime""")
def a6w(spark, d):
    return X6.crosstab_wide(X.occ(spark, d), K.TYPE, K.WEAPON)


@query("a7_crosstab_pct", with_("occ") + f"""
SELECT tipo_crime, sexo_suspeito, n, {rhu("CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY tipo_crime) AS DOUBLE) * 100.0", 6)} AS pct
FROM (SELECT tipo_crime, sexo_suspeito, count(*) AS n FROM occ
      WHERE tipo_crime IS NOT NULL AND sexo_suspeito IS NOT NULL GROUP BY 1, 2) t""")
def a7(spark, d):
    return X6.crosstab_pct(X.occ(spark, d), K.TYPE, K.SEX)


@query("a7_crosstab_pct_flags", with_("occ") + f"""
SELECT multiplas_vitimas, arma_letal, n,
       {rhu("CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY multiplas_vitimas) AS DOUBLE) * 100.0", 6)} AS pct
FROM (SELECT quantidade_vitimas > 1 AS multiplas_vitimas, arma_utilizada IN ('Arma de Fogo', 'Faca') AS arma_letal,
             count(*) AS n FROM occ WHERE quantidade_vitimas IS NOT NULL AND arma_utilizada IS NOT NULL GROUP BY 1, 2) t""")
def a7b(spark, d):
    return X6.crosstab_pct(derive.add_flags(X.occ(spark, d)), "multiplas_vitimas", "arma_letal")


@query("a8_seasonality", with_("ordi") + """
SELECT m.mes, t.tipo_crime, coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT CAST(month(data_ocorrencia) AS INTEGER) AS mes FROM ordi WHERE data_ocorrencia IS NOT NULL AND tipo_crime IS NOT NULL) m
CROSS JOIN (SELECT DISTINCT tipo_crime FROM ordi WHERE data_ocorrencia IS NOT NULL AND tipo_crime IS NOT NULL) t
LEFT JOIN (SELECT CAST(month(data_ocorrencia) AS INTEGER) AS mes, tipo_crime, count(*) AS n FROM ordi
           WHERE data_ocorrencia IS NOT NULL AND tipo_crime IS NOT NULL GROUP BY 1, 2) c
  ON c.mes = m.mes AND c.tipo_crime = t.tipo_crime""")
def a8(spark, d):
    return X6.seasonality(X.ordi(spark, d))


# ---------------------------------------------------------------- A9–A13 ---
@query("a9_group_mean", with_("occ") + f"""
SELECT tipo_crime, {rhu("avg(idade_suspeito)", 2)} AS media_idade_suspeito
FROM occ WHERE tipo_crime IS NOT NULL GROUP BY tipo_crime HAVING avg(idade_suspeito) IS NOT NULL""")
def a9(spark, d):
    return P.group_mean(X.occ(spark, d), K.TYPE, K.AGE)


@query("a9_group_mean_severity_top10", with_("sev") + f"""
SELECT bairro, m AS media_indice_gravidade FROM (
  SELECT bairro, {rhu("avg(indice_gravidade)", 2)} AS m FROM sev WHERE bairro IS NOT NULL GROUP BY bairro)
ORDER BY m DESC, bairro ASC LIMIT 10""")
def a9b(spark, d):
    return P.group_mean(derive.severity_index(X.occ(spark, d)), K.ZONE, "indice_gravidade", k=10)


RATE_PRECINCT_SQL = f"""SELECT orgao_responsavel, count(status_investigacao) AS total,
  count(*) FILTER (WHERE status_investigacao = 'Concluído') AS casos,
  {pct("count(*) FILTER (WHERE status_investigacao = 'Concluído')", "count(status_investigacao)", 1)} AS taxa
FROM occ WHERE orgao_responsavel IS NOT NULL GROUP BY orgao_responsavel"""


@query("a10_conditional_rate", with_("occ") + RATE_PRECINCT_SQL)
def a10(spark, d):
    return P.conditional_rate(X.occ(spark, d), K.PRECINCT, F.col(K.STATUS) == K.STATUS_DONE, of=K.STATUS)


@query("a10_conditional_rate_type", with_("occ") + f"""
SELECT tipo_crime, count(*) AS total, count(*) FILTER (WHERE status_investigacao = 'Concluído') AS casos,
  {pct("count(*) FILTER (WHERE status_investigacao = 'Concluído')", "count(*)", 1)} AS taxa
FROM occ WHERE tipo_crime IS NOT NULL AND {CASE_SCOPE} GROUP BY tipo_crime""")
def a10b(spark, d):
    scope = filters.filter_in(X.occ(spark, d), K.TYPE, K.CASE_TYPES)
    return P.conditional_rate(scope, K.TYPE, F.col(K.STATUS) == K.STATUS_DONE)


@query("a11_best_worst", with_("occ", extra=f"r AS ({RATE_PRECINCT_SQL})") + """
SELECT * FROM (SELECT 'melhor' AS posicao, orgao_responsavel, taxa FROM r ORDER BY taxa DESC, orgao_responsavel LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'pior' AS posicao, orgao_responsavel, taxa FROM r ORDER BY taxa ASC, orgao_responsavel LIMIT 1)""")
def a11(spark, d):
    r = P.conditional_rate(X.occ(spark, d), K.PRECINCT, F.col(K.STATUS) == K.STATUS_DONE, of=K.STATUS)
    return P.best_worst(r, K.PRECINCT)


@query("a12_overall_rate", with_("lab") + f"""
SELECT {pct("count(*) FILTER (WHERE status_investigacao = 'Concluído')", "count(*)", 1)} AS resolvidos,
       {pct("count(*) FILTER (WHERE arma_utilizada = 'Arma de Fogo')", "count(*)", 1)} AS arma_fogo,
       {pct("count(*) FILTER (WHERE quantidade_vitimas > 1)", "count(*)", 1)} AS multiplas_vitimas,
       {pct("count(*) FILTER (WHERE quantidade_suspeitos > 1)", "count(*)", 1)} AS multiplos_suspeitos,
       {pct("count(*) FILTER (WHERE anomalia = -1)", "count(*)", 2)} AS anomalias
FROM lab""")
def a12(spark, d):
    return P.overall_rates(X.lab(spark, d), {
        "resolvidos": F.col(K.STATUS) == K.STATUS_DONE, "arma_fogo": F.col(K.WEAPON) == K.FIREARM,
        "multiplas_vitimas": F.col(K.VICTIMS) > 1, "multiplos_suspeitos": F.col(K.SUSPECTS) > 1,
        "anomalias": F.col("anomalia") == -1}, digits={"anomalias": 2})


@query("a13_distinct_counts", with_("lab") + """
SELECT count(DISTINCT bairro) AS n_bairro, count(DISTINCT tipo_crime) AS n_tipo_crime,
       count(DISTINCT orgao_responsavel) AS n_orgao_responsavel,
       count(DISTINCT descricao_modus_operandi) AS n_descricao_modus_operandi, count(DISTINCT cluster) AS n_cluster
FROM lab""")
def a13(spark, d):
    return P.distinct_counts(X.lab(spark, d), [K.ZONE, K.TYPE, K.PRECINCT, K.METHOD, "cluster"])


def mode_sql(col: str, src: str, where: str = "TRUE") -> str:
    return (f"SELECT {col}, n FROM (SELECT {col}, count(*) AS n FROM {src} WHERE {col} IS NOT NULL AND {where} "
            f"GROUP BY {col}) ORDER BY n DESC, {col} ASC LIMIT 1")


@query("a14_global_mode_weapon", with_("occ") + mode_sql(K.WEAPON, "occ"))
def a14(spark, d):
    return P.global_mode(X.occ(spark, d), K.WEAPON)


@query("a14_global_mode_sex", with_("occ") + mode_sql(K.SEX, "occ"))
def a14b(spark, d):
    return P.global_mode(X.occ(spark, d), K.SEX)


@query("a14_global_mode_anomaly_hour", with_("lab") + mode_sql("hora", "lab", "anomalia = -1"))
def a14c(spark, d):
    return P.global_mode(filters.only_anomalies(X.lab(spark, d)), "hora")


@query("a15_mode_by_group", with_("occ", extra=f"""base AS (SELECT tipo_crime, sexo_suspeito, {AGEBAND} AS faixa_etaria, arma_utilizada FROM occ
              WHERE tipo_crime IS NOT NULL)""") + """, long AS (SELECT tipo_crime, 'sexo_suspeito' AS c, sexo_suspeito AS v FROM base UNION ALL
         SELECT tipo_crime, 'faixa_etaria', faixa_etaria FROM base UNION ALL
         SELECT tipo_crime, 'arma_utilizada', arma_utilizada FROM base),
cnt AS (SELECT tipo_crime, c, v, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY 1, 2, 3),
best AS (SELECT tipo_crime, c, v FROM (SELECT *, row_number() OVER (PARTITION BY tipo_crime, c ORDER BY n DESC, v ASC) AS rk
                                      FROM cnt) WHERE rk = 1)
SELECT t.tipo_crime,
  (SELECT v FROM best b WHERE b.tipo_crime = t.tipo_crime AND c = 'sexo_suspeito') AS moda_sexo_suspeito,
  (SELECT v FROM best b WHERE b.tipo_crime = t.tipo_crime AND c = 'faixa_etaria') AS moda_faixa_etaria,
  (SELECT v FROM best b WHERE b.tipo_crime = t.tipo_crime AND c = 'arma_utilizada') AS moda_arma_utilizada
FROM (SELECT DISTINCT tipo_crime FROM base) t""")
def a15(spark, d):
    o = derive.add_age_band(X.occ(spark, d))
    return P.mode_by_group(o, K.TYPE, [K.SEX, "faixa_etaria", K.WEAPON])


@query("a16_risk_stats", with_("risk") + """
SELECT nivel_risco, count(*) AS n, count(DISTINCT bairro) AS bairros FROM risk
WHERE nivel_risco IS NOT NULL GROUP BY nivel_risco""")
def a16(spark, d):
    return risk.risk_stats(X.risk(spark, d))


@query("a17_mean_diversity", with_("occ") + f"""
SELECT {rhu("avg(dv)", 6)} AS diversidade_media FROM (
  SELECT bairro, count(DISTINCT tipo_crime) AS dv FROM occ WHERE bairro IS NOT NULL GROUP BY bairro)""")
def a17(spark, d):
    return P.mean_diversity(X.occ(spark, d))


@query("a18_concentration", with_("occ") + f"""
SELECT {pct("coalesce((SELECT sum(n) FROM (" + TOPZ.replace("SELECT bairro FROM", "SELECT n FROM").format(k=3) + ")), 0)", "(SELECT count(*) FROM occ)", 1)} AS concentracao""")
def a18(spark, d):
    return P.concentration(X.occ(spark, d), K.ZONE, 3)


@query("a19_kpis_general", with_("risk") + f"""
SELECT count(*) AS total, count(*) FILTER (WHERE {SPEC_SQL}) AS filtrado,
       count(*) FILTER (WHERE ({SPEC_SQL}) AND anomalia = -1) AS anomalias,
       count(DISTINCT CASE WHEN {SPEC_SQL} THEN cluster END) AS clusters,
       count(*) FILTER (WHERE ({SPEC_SQL}) AND nivel_risco = 'Alto Risco') AS alto_risco,
       count(DISTINCT CASE WHEN {SPEC_SQL} THEN bairro END) AS bairros,
       count(*) FILTER (WHERE {SPEC_SQL}) - count(*) AS diferenca
FROM risk""")
def a19(spark, d):
    r = X.risk(spark, d)
    return P.kpis_general(r, SPEC.predicate(r))


@query("a20_kpis_cases", with_("occ") + f"""
SELECT count(*) AS total, {pct("count(*) FILTER (WHERE status_investigacao = 'Concluído')", "count(*)", 1)} AS taxa_resolucao,
       count(*) FILTER (WHERE arma_utilizada = 'Arma de Fogo') AS arma_fogo,
       count(*) FILTER (WHERE quantidade_vitimas > 1) AS multiplas_vitimas,
       count(DISTINCT orgao_responsavel) AS delegacias
FROM occ WHERE {CASE_SCOPE}""")
def a20(spark, d):
    return P.kpis_cases(filters.filter_in(X.occ(spark, d), K.TYPE, K.CASE_TYPES))


@query("a21_summary", with_("occ") + """
SELECT count(*) AS total, count(DISTINCT bairro) AS bairros,
       CAST(floor((epoch_us(max(data_ocorrencia)) - epoch_us(min(data_ocorrencia))) / 86400000000) AS BIGINT) AS periodo_dias,
       count(DISTINCT tipo_crime) AS tipos FROM occ""")
def a21(spark, d):
    return P.summary(X.occ(spark, d))


@query("a21_summary_orders", with_("ordi") + """
SELECT count(*) AS total, count(DISTINCT bairro) AS bairros,
       CAST(floor((epoch_us(max(data_ocorrencia)) - epoch_us(min(data_ocorrencia))) / 86400000000) AS BIGINT) AS periodo_dias,
       count(DISTINCT tipo_crime) AS tipos FROM ordi""")
def a21b(spark, d):
    return P.summary(X.ordi(spark, d))


@query("a22_risk_indicators", with_("occ") + f"""
SELECT 'arma_fogo' AS indicador, count(*) FILTER (WHERE arma_utilizada = 'Arma de Fogo') AS n,
       {pct("count(*) FILTER (WHERE arma_utilizada = 'Arma de Fogo')", "count(*)", 1)} AS pct FROM occ
UNION ALL
SELECT 'multiplas_vitimas', count(*) FILTER (WHERE quantidade_vitimas > 1),
       {pct("count(*) FILTER (WHERE quantidade_vitimas > 1)", "count(*)", 1)} FROM occ
UNION ALL
SELECT 'multiplos_suspeitos', count(*) FILTER (WHERE quantidade_suspeitos > 1),
       {pct("count(*) FILTER (WHERE quantidade_suspeitos > 1)", "count(*)", 1)} FROM occ""")
def a22(spark, d):
    return P.risk_indicators(X.occ(spark, d))


@query("a23_geo_extent", with_("occ") + f"""
SELECT min(latitude) AS lat_min, max(latitude) AS lat_max, {rhu("avg(latitude)", 6)} AS lat_media,
       min(longitude) AS lon_min, max(longitude) AS lon_max, {rhu("avg(longitude)", 6)} AS lon_media
FROM occ WHERE {CITY_SQL}""")
def a23(spark, d):
    return geo.geo_extent(clean.clean_geo(X.occ(spark, d)))


@query("a24_group_count_quantiles", with_("occ") + f"""
SELECT {rhu("quantile_cont(CAST(n AS DOUBLE), 0.33)", 6)} AS q33, {rhu("quantile_cont(CAST(n AS DOUBLE), 0.66)", 6)} AS q66
FROM (SELECT bairro, count(*) AS n FROM occ WHERE bairro IS NOT NULL GROUP BY bairro)""")
def a24(spark, d):
    q = risk.group_count_quantiles(X.occ(spark, d))
    return q.select(*[S.round_half_up(c, 6).alias(c) for c in q.columns])


@query("a25_risk_tier", with_("risk") + "SELECT occurrence_id, bairro, nivel_risco FROM risk")
def a25(spark, d):
    return risk.risk_tier(X.occ(spark, d)).select(K.ID, K.ZONE, "nivel_risco")


@query("a26_top_patterns_over_time", with_("ordi") + """
SELECT strftime(data_ocorrencia, '%Y-%m') AS mes_ano, descricao_modus_operandi, count(*) AS n FROM ordi
WHERE descricao_modus_operandi IN (SELECT descricao_modus_operandi FROM (
    SELECT descricao_modus_operandi, count(*) AS n FROM ordi WHERE descricao_modus_operandi IS NOT NULL
    GROUP BY 1 ORDER BY n DESC, descricao_modus_operandi LIMIT 3))
  AND data_ocorrencia IS NOT NULL
GROUP BY 1, 2""")
def a26(spark, d):
    return X6.top_patterns_over_time(X.ordi(spark, d), 3)


@query("a27_cleaning_report", with_("occ") + f"""
SELECT count(*) AS linhas_entrada, count(*) FILTER (WHERE {CITY_SQL}) AS linhas_validas,
       count(*) - count(*) FILTER (WHERE {CITY_SQL}) AS linhas_removidas,
       {pct(f"count(*) - count(*) FILTER (WHERE {CITY_SQL})", "count(*)", 1)} AS pct_removidas FROM occ""")
def a27(spark, d):
    return clean.cleaning_report(X.occ(spark, d), clean.city_box_flag())


SHARE_SQL = """SELECT {col}, n, {p} AS pct FROM (
  SELECT {col}, count(*) AS n, sum(count(*)) OVER () AS total FROM {src} GROUP BY {col}) t
WHERE {col} IS NOT NULL"""


@query("a28_severity_distribution", with_("sev") + SHARE_SQL.format(
    col="nivel_gravidade", src="sevl", p=pct("n", "total", 1)))
def a28(spark, d):
    return P.share_table(derive.severity_index(X.occ(spark, d)), "nivel_gravidade")


@query("a29_anomalies_by_hour", with_("lab") + freq_sql("hora", "lab", "anomalia = -1"))
def a29(spark, d):
    return P.anomalies_by(X.lab(spark, d), "hora")


@query("a29_anomalies_by_type", with_("lab") + freq_sql(K.TYPE, "lab", "anomalia = -1"))
def a29b(spark, d):
    return P.anomalies_by(X.lab(spark, d), K.TYPE)


@query("a29_anomalies_by_zone", with_("lab") + freq_sql(K.ZONE, "lab", "anomalia = -1")
       + " ORDER BY n DESC, bairro ASC LIMIT 10")
def a29c(spark, d):
    return P.anomalies_by(X.lab(spark, d), K.ZONE, 10)


HEX_SQL = """p AS (SELECT longitude * CAST(110201.0 AS DOUBLE) AS x, latitude * CAST(111320.0 AS DOUBLE) AS y FROM occ
           WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
a AS (SELECT (x / sqrt(3.0) - y / 3.0) / 200.0 AS q, (2.0 / 3.0) * y / 200.0 AS r FROM p),
b AS (SELECT q, r, -q - r AS s, round(q) AS rq, round(r) AS rr, round(-q - r) AS rs FROM a),
c AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM b)
"""
HEX_SELECT = """SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS hex_q,
       CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS hex_r,
       count(*) AS n
FROM c GROUP BY 1, 2"""


@query("a30_hex_density", with_("occ", extra=HEX_SQL) + HEX_SELECT)
def a30(spark, d):
    return geo.hex_density(X.occ(spark, d))


@query("a31_heat_points", with_("occ") + """
SELECT CAST(floor(latitude * 10000.0) AS BIGINT) AS cel_lat, CAST(floor(longitude * 10000.0) AS BIGINT) AS cel_lon,
       count(*) AS n FROM occ WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2""")
def a31(spark, d):
    return geo.heat_points(X.occ(spark, d))


@query("a32_share_table", with_("occ") + SHARE_SQL.format(col=K.TYPE, src="occ", p=pct("n", "total", 1)))
def a32(spark, d):
    return P.share_table(X.occ(spark, d), K.TYPE)


@query("a32_share_table_top5_zones", with_("occ") + SHARE_SQL.format(col=K.ZONE, src="occ", p=pct("n", "total", 1))
       + " ORDER BY n DESC, bairro ASC LIMIT 5")
def a32b(spark, d):
    return P.share_table(X.occ(spark, d), K.ZONE, 5)


@query("a33_cluster_means", with_("lab") + f"""
SELECT cluster, {rhu("avg(hora)", 2)} AS hora_media, {rhu("avg(tipo_idx)", 2)} AS tipo_medio,
       {rhu("avg(bairro_idx)", 2)} AS bairro_medio
FROM (SELECT cluster, hora,
             CAST(dense_rank() OVER (ORDER BY tipo_crime) - 1 AS DOUBLE) AS tipo_idx,
             CAST(dense_rank() OVER (ORDER BY bairro) - 1 AS DOUBLE) AS bairro_idx FROM lab) t
GROUP BY cluster""")
def a33(spark, d):
    from sentinela.ml.cluster import cluster_means
    return cluster_means(X.lab(spark, d))


@query("a34_cluster_sizes", with_("lab") + "SELECT cluster, count(*) AS n FROM lab WHERE cluster <> -1 GROUP BY cluster")
def a34(spark, d):
    from sentinela.ml.cluster import cluster_sizes
    return cluster_sizes(X.lab(spark, d))


@query("a34_noise_and_count", with_("lab") + """
SELECT count(*) FILTER (WHERE cluster = -1) AS ruido, count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS clusters
FROM lab""")
def a34b(spark, d):
    from sentinela.ml.cluster import noise_and_count
    return noise_and_count(X.lab(spark, d))


@query("a35_scope_counts", with_("occ") + """
SELECT count(*) AS total, count(*) FILTER (WHERE tipo_crime = 'Violência Doméstica') AS n_0,
       count(*) FILTER (WHERE tipo_crime = 'Estupro') AS n_1, count(*) FILTER (WHERE tipo_crime = 'Ameaça') AS n_2
FROM occ""")
def a35(spark, d):
    return P.scope_counts(X.occ(spark, d))


# ---------------------------------------------------------------- T ----
@query("t1_top_n", with_("occ") + freq_sql(K.ZONE) + " ORDER BY n DESC, bairro ASC LIMIT 10")
def t1(spark, d):
    return P.top_n(X.occ(spark, d), K.ZONE, 10)


@query("t1_top_n_hours", with_("cal") + freq_sql("hora", "cal") + " ORDER BY n DESC, hora ASC LIMIT 3")
def t1b(spark, d):
    return P.top_n(X.cal(spark, d), "hora", 3)


@query("t2_latest", with_("lab") + """
SELECT occurrence_id, strftime(data_ocorrencia, '%Y-%m-%d %H:%M:%S') AS data_ocorrencia, tipo_crime, bairro,
       row_number() OVER (ORDER BY data_ocorrencia DESC NULLS LAST, occurrence_id) - 1 AS posicao
FROM lab WHERE anomalia = -1""")
def t2(spark, d):
    a = numbered(P.latest(filters.only_anomalies(X.lab(spark, d))), "posicao")
    return a.select(K.ID, F.date_format(K.TS, "yyyy-MM-dd HH:mm:ss").alias(K.TS), K.TYPE, K.ZONE, "posicao")


@query("t3_most_severe", with_("sev") + """
SELECT occurrence_id, indice_gravidade FROM sevl WHERE nivel_gravidade = 'Alta'
ORDER BY indice_gravidade DESC, occurrence_id ASC LIMIT 10""")
def t3(spark, d):
    return P.most_severe(derive.severity_index(X.occ(spark, d))).select(K.ID, "indice_gravidade")


@query("t4_sample_rows", with_("occ") + """
SELECT occurrence_id, tipo_crime, bairro FROM occ ORDER BY data_ocorrencia ASC NULLS LAST, occurrence_id LIMIT 10""")
def t4(spark, d):
    return P.sample_rows(X.occ(spark, d), 10).select(K.ID, K.TYPE, K.ZONE)


@query("t5_sort_by_key", with_("ordi") + """
SELECT strftime(data_ocorrencia, '%Y-%m') AS mes_ano, count(*) AS n, row_number() OVER (ORDER BY 1) - 1 AS posicao
FROM ordi WHERE data_ocorrencia IS NOT NULL GROUP BY 1""".replace("(ORDER BY 1)", "(ORDER BY strftime(data_ocorrencia, '%Y-%m'))"))
def t5(spark, d):
    return numbered(P.sort_by_key(P.monthly_trend(X.ordi(spark, d)), "mes_ano"), "posicao")


# ---------------------------------------------------------------- O ----
@query("o1_anomaly_only_types", with_("lab") + """
SELECT DISTINCT tipo_crime FROM lab WHERE anomalia = -1 AND tipo_crime IS NOT NULL
EXCEPT SELECT tipo_crime FROM lab WHERE anomalia = 1""")
def o1(spark, d):
    return P.anomaly_only_types(X.lab(spark, d))


@query("o1_anomaly_only_types_planted", with_("lab").rstrip() + """,
pl AS (SELECT anomalia, CASE WHEN occurrence_id % 40 = 0 THEN 'Sequestro' WHEN occurrence_id % 100 = 20 THEN 'Estupro'
                ELSE tipo_crime END AS t FROM lab)
SELECT DISTINCT t AS tipo_crime FROM pl WHERE anomalia = -1 AND t IS NOT NULL
EXCEPT SELECT t FROM pl WHERE anomalia = 1""")
def o1p(spark, d):
    """Two types that only anomalous rows have are planted in the table."""
    i = F.col(K.ID)
    planted = F.when(i % 40 == 0, "Sequestro").when(i % 100 == 20, "Estupro").otherwise(F.col(K.TYPE))
    return P.anomaly_only_types(X.lab(spark, d).withColumn(K.TYPE, planted))


@query("o1_anomaly_only_zones_in_box", with_("lab") + f"""
SELECT DISTINCT bairro FROM lab WHERE anomalia = -1 AND bairro IS NOT NULL AND {CITY_SQL}
EXCEPT SELECT bairro FROM lab WHERE anomalia = 1 AND {CITY_SQL}""")
def o1b(spark, d):
    return P.anomaly_only_types(clean.clean_geo(X.lab(spark, d)), K.ZONE)


@query("o2_dedupe", with_("occ") + "SELECT DISTINCT tipo_crime, bairro, arma_utilizada FROM occ")
def o2(spark, d):
    return clean.dedupe(X.occ(spark, d).select(K.TYPE, K.ZONE, K.WEAPON))


@query("o3_distinct_values", with_("occ") + "SELECT DISTINCT bairro FROM occ WHERE bairro IS NOT NULL")
def o3(spark, d):
    return P.distinct_values(X.occ(spark, d), K.ZONE)


@query("o3_distinct_list", with_("occ") + """
SELECT string_agg(v, ', ' ORDER BY v) AS lista_tipo_crime FROM (SELECT DISTINCT tipo_crime AS v FROM occ WHERE tipo_crime IS NOT NULL)""")
def o3b(spark, d):
    return P.distinct_list(X.occ(spark, d), K.TYPE)
