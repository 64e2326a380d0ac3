"""Registered queries: sources, projections, filters and joins (S, P, F, J)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.functions import scalar as S
from sentinela.operators import clean, derive, filters, geo, joins, risk
from sentinela.operators.crosstab import complete_calendar
from sentinela.operators.profile import hour_histogram
from sentinela.plans import fixtures as X
from sentinela.plans.oracle_base import AGEBAND, pct, rhu, with_
from sentinela.plans.registry import query
from sentinela.schema import normalize_columns
from sentinela.sources import dims

AS_OF_EVENTS = datetime(2024, 1, 20, 12, 0, 0)
AS_OF_ORDERS = datetime(2001, 6, 30, 0, 0, 0)
RETENTION_AS_OF = datetime(2001, 8, 1, 0, 0, 0)


# ---------------------------------------------------------------- S ----
@query("s2_normalize_columns", with_("occ") + "SELECT * FROM occ")
def s2(spark, d):
    o = X.occ(spark, d)
    messy = o.toDF(*[f"  {c.upper()} " for c in o.columns])
    return normalize_columns(messy)


# ---------------------------------------------------------------- P ----
@query("p1_parse_ts", with_("occ") + """
SELECT occurrence_id,
       strftime(TRY_CAST(CAST(data_ocorrencia AS VARCHAR) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts_texto,
       strftime(TRY_CAST(bairro AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts_invalido
FROM occ""")
def p1(spark, d):
    o = X.occ(spark, d).select(K.ID, F.col(K.TS).cast("string").alias("t"), F.col(K.ZONE).alias("b"))
    return o.select(K.ID, F.date_format(S.parse_ts("t"), "yyyy-MM-dd HH:mm:ss").alias("ts_texto"),
                    F.date_format(S.parse_ts("b"), "yyyy-MM-dd HH:mm:ss").alias("ts_invalido"))


@query("p2_add_calendar", with_("cal") + "SELECT occurrence_id, hora, mes, ano, dia_mes FROM cal")
def p2(spark, d):
    return derive.add_calendar(X.occ(spark, d)).select(K.ID, "hora", "mes", "ano", "dia_mes")


WD_SQL = ("CASE isodow(data_ocorrencia) WHEN 1 THEN 'segunda-feira' WHEN 2 THEN 'terça-feira' "
          "WHEN 3 THEN 'quarta-feira' WHEN 4 THEN 'quinta-feira' WHEN 5 THEN 'sexta-feira' "
          "WHEN 6 THEN 'sábado' WHEN 7 THEN 'domingo' END")


@query("p3_weekday_name", with_("cal") + f"SELECT occurrence_id, dow, {WD_SQL} AS dia_semana FROM cal")
def p3(spark, d):
    return derive.add_weekday(X.occ(spark, d)).select(K.ID, "dow", "dia_semana")


PERIOD_SQL = ("CASE WHEN hora >= 6 AND hora < 12 THEN 'Manhã' WHEN hora >= 12 AND hora < 18 THEN 'Tarde' "
              "WHEN hora >= 18 AND hora < 24 THEN 'Noite' ELSE 'Madrugada' END")


@query("p4_time_period", with_("cal") + f"SELECT occurrence_id, hora, {PERIOD_SQL} AS periodo_dia FROM cal")
def p4(spark, d):
    return derive.add_period(derive.add_calendar(X.occ(spark, d))).select(K.ID, "hora", "periodo_dia")


@query("p5_is_weekend", with_("cal") + "SELECT occurrence_id, coalesce(dow >= 6, false) AS fim_semana FROM cal")
def p5(spark, d):
    return derive.add_weekend(X.occ(spark, d)).select(K.ID, "fim_semana")


@query("p6_to_number", with_("occ") + """
SELECT occurrence_id, TRY_CAST(CAST(latitude AS VARCHAR) AS DOUBLE) AS latitude,
       TRY_CAST(bairro AS DOUBLE) AS bairro FROM occ""")
def p6(spark, d):
    o = X.occ(spark, d).select(K.ID, F.col(K.LAT).cast("string").alias(K.LAT), K.ZONE)
    return clean.to_numbers(o, [K.LAT, K.ZONE])


@query("p7_drop_null", with_("occ") + "SELECT occurrence_id, sexo_suspeito FROM occ WHERE sexo_suspeito IS NOT NULL")
def p7(spark, d):
    return clean.drop_null(X.occ(spark, d), [K.SEX]).select(K.ID, K.SEX)


@query("p8_fill_unknown", with_("occ") + """
SELECT occurrence_id, coalesce(bairro, 'Não Informado') AS bairro, coalesce(tipo_crime, 'Não Informado') AS tipo_crime,
       coalesce(descricao_modus_operandi, 'Não Informado') AS descricao_modus_operandi,
       coalesce(sexo_suspeito, 'Não Informado') AS sexo_suspeito FROM occ""")
def p8(spark, d):
    o = clean.fill_unknown(X.occ(spark, d), [K.ZONE, K.TYPE, K.METHOD, K.SEX])
    return o.select(K.ID, K.ZONE, K.TYPE, K.METHOD, K.SEX)


@query("p9_victim_gender", with_("occ") + """
SELECT occurrence_id, CASE WHEN sexo_suspeito = 'Feminino' THEN 'Masculino' ELSE 'Feminino' END AS genero_vitima
FROM occ""")
def p9(spark, d):
    return derive.add_victim_fields(X.occ(spark, d)).select(K.ID, "genero_vitima")


@query("p10_cut", with_("occ") + f"""
SELECT occurrence_id, idade_suspeito, {AGEBAND} AS faixa_etaria,
       CASE WHEN idade_suspeito > 0 AND idade_suspeito <= 18 THEN 0 WHEN idade_suspeito > 18 AND idade_suspeito <= 25 THEN 1
            WHEN idade_suspeito > 25 AND idade_suspeito <= 35 THEN 2 WHEN idade_suspeito > 35 AND idade_suspeito <= 50 THEN 3
            WHEN idade_suspeito > 50 AND idade_suspeito <= 100 THEN 4 END AS faixa_etaria_ord,
       CASE WHEN idade_suspeito > 0 AND idade_suspeito <= 18 THEN 'Menor de 18'
            WHEN idade_suspeito > 18 AND idade_suspeito <= 25 THEN '18-25'
            WHEN idade_suspeito > 25 AND idade_suspeito <= 35 THEN '26-35'
            WHEN idade_suspeito > 35 AND idade_suspeito <= 50 THEN '36-50'
            WHEN idade_suspeito > 50 AND idade_suspeito <= 100 THEN 'Acima de 50' END AS faixa_etaria_vitima
FROM occ""")
def p10(spark, d):
    o = derive.add_victim_fields(derive.add_age_band(X.occ(spark, d)))
    return o.select(K.ID, K.AGE, "faixa_etaria", "faixa_etaria_ord", "faixa_etaria_vitima")


@query("p11_alias_status", with_("occ") + "SELECT occurrence_id, status_investigacao AS status_caso FROM occ")
def p11(spark, d):
    return derive.add_victim_fields(X.occ(spark, d)).select(K.ID, "status_caso")


@query("p12_month_key", with_("ordi") + "SELECT occurrence_id, strftime(data_ocorrencia, '%Y-%m') AS mes_ano FROM ordi")
def p12(spark, d):
    return derive.add_month_key(X.ordi(spark, d)).select(K.ID, "mes_ano")


@query("p13_flags", with_("occ") + """
SELECT occurrence_id, quantidade_vitimas > 1 AS multiplas_vitimas,
       arma_utilizada IN ('Arma de Fogo', 'Faca') AS arma_letal FROM occ""")
def p13(spark, d):
    return derive.add_flags(X.occ(spark, d)).select(K.ID, "multiplas_vitimas", "arma_letal")


@query("p14_severity_index", with_("sev") + "SELECT occurrence_id, indice_gravidade FROM sev")
def p14(spark, d):
    return derive.severity_index(X.occ(spark, d)).select(K.ID, "indice_gravidade")


@query("p15_severity_level", with_("sev") + "SELECT occurrence_id, nivel_gravidade FROM sevl")
def p15(spark, d):
    return derive.severity_index(X.occ(spark, d)).select(K.ID, "nivel_gravidade")


@query("p16_case_gravity", with_("occ") + """
SELECT occurrence_id, gravidade_score,
       CASE WHEN gravidade_score > -1 AND gravidade_score <= 0 THEN 'Baixa'
            WHEN gravidade_score > 0 AND gravidade_score <= 2 THEN 'Média'
            WHEN gravidade_score > 2 AND gravidade_score <= 10 THEN 'Alta' END AS gravidade
FROM (SELECT occurrence_id, CAST(coalesce(CASE arma_utilizada WHEN 'Arma de Fogo' THEN 3 WHEN 'Faca' THEN 2 END, 0)
                                 + (quantidade_vitimas - 1) AS INTEGER) AS gravidade_score FROM occ) t""")
def p16(spark, d):
    return derive.case_gravity(X.occ(spark, d)).select(K.ID, "gravidade_score", "gravidade")


@query("p17_detail_view", with_("occ") + """
SELECT occurrence_id, strftime(data_ocorrencia, '%d/%m/%Y %H:%M') AS data_ocorrencia, tipo_crime, bairro,
       arma_utilizada, status_investigacao, orgao_responsavel FROM occ""")
def p17(spark, d):
    return derive.detail_view(X.occ(spark, d))


@query("p18_point_label", with_("occ") + """
SELECT occurrence_id, concat_ws(' | ', coalesce(tipo_crime, 'N/A'), coalesce(bairro, 'N/A'),
                                coalesce(strftime(data_ocorrencia, '%d/%m/%Y'), 'N/A')) AS rotulo FROM occ""")
def p18(spark, d):
    return derive.point_label(X.occ(spark, d)).select(K.ID, "rotulo")


@query("p19_percent_text", with_("occ") + f"""
SELECT orgao_responsavel, printf('%.1f%%', taxa) AS taxa_texto,
       TRY_CAST(regexp_replace(trim(printf('%.1f%%', taxa)), '%+$', '') AS DOUBLE) AS taxa_numero
FROM (SELECT orgao_responsavel,
             {pct("count(*) FILTER (WHERE status_investigacao = 'Concluído')", "count(status_investigacao)", 1)} AS taxa
      FROM occ WHERE orgao_responsavel IS NOT NULL GROUP BY orgao_responsavel) t""")
def p19(spark, d):
    from sentinela.operators.profile import conditional_rate
    r = conditional_rate(X.occ(spark, d), K.PRECINCT, F.col(K.STATUS) == K.STATUS_DONE, of=K.STATUS)
    r = r.select(K.PRECINCT, S.percent_text("taxa").alias("taxa_texto"))
    return r.withColumn("taxa_numero", S.parse_percent("taxa_texto"))


@query("p20_anonymize", with_("occ") + """
SELECT occurrence_id, CASE WHEN bairro IS NOT NULL THEN substr(md5(CAST(bairro AS VARCHAR)), 1, 8) END AS bairro,
       CASE WHEN sexo_suspeito IS NOT NULL THEN substr(md5(CAST(sexo_suspeito AS VARCHAR)), 1, 8) END AS sexo_suspeito
FROM occ""")
def p20(spark, d):
    return derive.anonymize(X.occ(spark, d), [K.ZONE, K.SEX, "coluna_ausente"]).select(K.ID, K.ZONE, K.SEX)


@query("p21_apply_retention", with_("ordi") + """
SELECT occurrence_id,
       CASE WHEN data_ocorrencia < TIMESTAMP '1996-08-01 00:00:00' THEN
            CASE WHEN bairro IS NOT NULL THEN substr(md5(bairro), 1, 8) END ELSE bairro END AS bairro,
       CASE WHEN data_ocorrencia < TIMESTAMP '1996-08-01 00:00:00' THEN
            CASE WHEN descricao_modus_operandi IS NOT NULL THEN substr(md5(descricao_modus_operandi), 1, 8) END
            ELSE descricao_modus_operandi END AS descricao_modus_operandi
FROM ordi""")
def p21(spark, d):
    o = derive.apply_retention(X.ordi(spark, d), RETENTION_AS_OF, [K.ZONE, K.METHOD], years=5)
    return o.select(K.ID, K.ZONE, K.METHOD)


@query("p22_round_pct", with_("occ") + f"""
SELECT tipo_crime, {rhu("avg(quantidade_vitimas)", 2)} AS media_quantidade_vitimas
FROM occ WHERE tipo_crime IS NOT NULL GROUP BY tipo_crime""")
def p22(spark, d):
    from sentinela.operators.profile import group_mean
    return group_mean(X.occ(spark, d), K.TYPE, K.VICTIMS)


@query("p23_cluster_colour", with_("lab") + """
SELECT occurrence_id, cluster, CAST(((cluster % 10) + 10) % 10 AS INTEGER) AS cor_slot FROM lab WHERE cluster <> -1""")
def p23(spark, d):
    return derive.cluster_colour(X.lab(spark, d)).select(K.ID, "cluster", "cor_slot")


@query("p24_type_colour", with_("occ") + """
SELECT occurrence_id, coalesce(CASE tipo_crime WHEN 'Estupro' THEN 'red' WHEN 'Violência Doméstica' THEN 'darkred'
       WHEN 'Ameaça' THEN 'orange' WHEN 'Lesão Corporal' THEN 'purple' WHEN 'Injúria' THEN 'blue' END, 'gray') AS cor
FROM occ""")
def p24(spark, d):
    return derive.type_colour(X.occ(spark, d)).select(K.ID, "cor")


# ---------------------------------------------------------------- F ----
@query("f1_filter_in", with_("occ") + """
SELECT occurrence_id, tipo_crime FROM occ WHERE tipo_crime IN ('Violência Doméstica', 'Estupro', 'Ameaça')""")
def f1(spark, d):
    return filters.filter_in(X.occ(spark, d), K.TYPE, K.CASE_TYPES).select(K.ID, K.TYPE)


@query("f2_filter_date_range", with_("occ") + """
SELECT occurrence_id FROM occ WHERE CAST(data_ocorrencia AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'""")
def f2(spark, d):
    return filters.filter_date_range(X.occ(spark, d), date(2024, 1, 8), date(2024, 1, 14)).select(K.ID)


@query("f3_filter_hour_range", with_("cal") + "SELECT occurrence_id, hora FROM cal WHERE hora BETWEEN 8 AND 17")
def f3(spark, d):
    return filters.filter_hour_range(X.cal(spark, d), 8, 17).select(K.ID, "hora")


SPEC = filters.FilterSpec(types=["Roubo", "Furto", "Ameaça"],
                          zones=[f"NATION_{i}" for i in range(10)],
                          date_range=(date(2024, 1, 5), date(2024, 1, 25)),
                          hour_range=(6, 22), weekdays=[1, 2, 3, 4, 5])
SPEC_SQL = """tipo_crime IN ('Roubo', 'Furto', 'Ameaça')
  AND bairro IN ('NATION_0','NATION_1','NATION_2','NATION_3','NATION_4','NATION_5','NATION_6','NATION_7','NATION_8','NATION_9')
  AND CAST(data_ocorrencia AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'
  AND hour(data_ocorrencia) BETWEEN 6 AND 22 AND isodow(data_ocorrencia) IN (1, 2, 3, 4, 5)"""


@query("f4_apply_filters", with_("occ") + f"SELECT occurrence_id FROM occ WHERE {SPEC_SQL}")
def f4(spark, d):
    return filters.apply_filters(X.occ(spark, d), SPEC).select(K.ID)


CITY_SQL = """coalesce(latitude BETWEEN CAST(-8.12 AS DOUBLE) AND CAST(-8.05 AS DOUBLE)
  AND longitude BETWEEN CAST(-34.95 AS DOUBLE) AND CAST(-34.85 AS DOUBLE), false)"""


@query("f5_in_city_box", with_("occ") + f"SELECT occurrence_id, {CITY_SQL} AS coord_valida FROM occ")
def f5(spark, d):
    return clean.in_city_box(X.occ(spark, d)).select(K.ID, "coord_valida")


ZONE_SQL = """coalesce(abs(o.latitude - b.lat_c) <= b.radius AND abs(o.longitude - b.lon_c) <= b.radius, false)"""


@query("f6_in_zone_box", with_("occ", "nbox") + f"""
SELECT o.occurrence_id, {ZONE_SQL} AS coord_valida FROM occ o LEFT JOIN nbox b ON o.bairro = b.zone""")
def f6(spark, d):
    return clean.in_zone_box(X.occ(spark, d), X.nbox(spark, d)).select(K.ID, "coord_valida")


@query("f7_clean_geo", with_("occ", "nbox") + f"""
SELECT o.occurrence_id, o.bairro FROM occ o LEFT JOIN nbox b ON o.bairro = b.zone WHERE {ZONE_SQL}""")
def f7(spark, d):
    return clean.clean_geo(X.occ(spark, d), X.nbox(spark, d)).select(K.ID, K.ZONE)


@query("f8_valid_datetime", with_("ordi") + """
SELECT occurrence_id, coalesce(data_ocorrencia IS NOT NULL AND data_ocorrencia <= TIMESTAMP '2001-06-30 00:00:00'
                               AND data_ocorrencia >= TIMESTAMP '2000-01-01 00:00:00', false) AS data_valida FROM ordi""")
def f8(spark, d):
    return clean.valid_datetime(X.ordi(spark, d), as_of=AS_OF_ORDERS).select(K.ID, "data_valida")


@query("f9_clean_and_validate", with_("occ") + f"""
SELECT DISTINCT * FROM occ WHERE {CITY_SQL}
  AND data_ocorrencia IS NOT NULL AND data_ocorrencia <= TIMESTAMP '2024-01-20 12:00:00'
  AND data_ocorrencia >= TIMESTAMP '2000-01-01 00:00:00'""")
def f9(spark, d):
    return clean.clean_and_validate(X.occ(spark, d), as_of=AS_OF_EVENTS)


@query("f10_only_anomalies", with_("lab") + "SELECT occurrence_id, tipo_crime, bairro FROM lab WHERE anomalia = -1")
def f10(spark, d):
    return filters.only_anomalies(X.lab(spark, d)).select(K.ID, K.TYPE, K.ZONE)


@query("f10_only_cluster", with_("lab") + "SELECT occurrence_id FROM lab WHERE cluster = 2")
def f10b(spark, d):
    return filters.only_cluster(X.lab(spark, d), 2).select(K.ID)


@query("f11_is_night", with_("cal") + "SELECT occurrence_id, (hora >= 22 OR hora <= 6) AS noturno FROM cal")
def f11(spark, d):
    return X.cal(spark, d).select(K.ID, S.is_night("hora").alias("noturno"))


@query("f13_filter_options", with_("occ") + """
SELECT DISTINCT filtro, valor FROM (
  SELECT 'tipo_crime' AS filtro, tipo_crime AS valor FROM occ UNION ALL
  SELECT 'bairro', bairro FROM occ UNION ALL
  SELECT 'arma_utilizada', arma_utilizada FROM occ UNION ALL
  SELECT 'status_investigacao', status_investigacao FROM occ UNION ALL
  SELECT 'orgao_responsavel', orgao_responsavel FROM occ) t WHERE valor IS NOT NULL""")
def f13(spark, d):
    return filters.filter_options(X.occ(spark, d), [K.TYPE, K.ZONE, K.WEAPON, K.STATUS, K.PRECINCT])


@query("f13_date_bounds", with_("occ") + """
SELECT strftime(min(data_ocorrencia), '%Y-%m-%d %H:%M:%S') AS data_min,
       strftime(max(data_ocorrencia), '%Y-%m-%d %H:%M:%S') AS data_max FROM occ""")
def f13b(spark, d):
    b = filters.date_bounds(X.occ(spark, d))
    return b.select(F.date_format("data_min", "yyyy-MM-dd HH:mm:ss").alias("data_min"),
                    F.date_format("data_max", "yyyy-MM-dd HH:mm:ss").alias("data_max"))


# ---------------------------------------------------------------- J ----
@query("j1_enrich_with_group_count", with_("occ") + """
SELECT o.occurrence_id, o.bairro, coalesce(z.n, 0) AS zona_n
FROM occ o LEFT JOIN (SELECT bairro, count(*) AS n FROM occ WHERE bairro IS NOT NULL GROUP BY bairro) z
  ON o.bairro = z.bairro""")
def j1(spark, d):
    return risk.enrich_with_group_count(X.occ(spark, d)).select(K.ID, K.ZONE, "zona_n")


@query("j2_write_back", with_("lab") + f"""
SELECT o.occurrence_id, coalesce(l.cluster, -1) AS cluster
FROM occ o LEFT JOIN (SELECT occurrence_id, cluster FROM lab WHERE {CITY_SQL}) l USING (occurrence_id)""")
def j2(spark, d):
    scored = X.lab(spark, d).where(clean.city_box_pred()).select(K.ID, "cluster")
    return joins.write_back(X.occ(spark, d), scored, "cluster", -1).select(K.ID, "cluster")


TOPZ = ("SELECT bairro FROM (SELECT bairro, count(*) AS n FROM occ WHERE bairro IS NOT NULL GROUP BY bairro "
        "ORDER BY n DESC, bairro ASC LIMIT {k})")
TOPT = ("SELECT tipo_crime FROM (SELECT tipo_crime, count(*) AS n FROM occ WHERE tipo_crime IS NOT NULL "
        "GROUP BY tipo_crime ORDER BY n DESC, tipo_crime ASC LIMIT {k})")


@query("j3_semi_top_n", with_("occ") + f"""
SELECT occurrence_id, bairro, tipo_crime FROM occ
WHERE bairro IN ({TOPZ.format(k=5)}) AND tipo_crime IN ({TOPT.format(k=3)})""")
def j3(spark, d):
    return joins.semi_top_n(X.occ(spark, d), K.ZONE, 5, K.TYPE, 3).select(K.ID, K.ZONE, K.TYPE)


@query("j4_zone_dimension_join", with_("occ", "nbox") + """
SELECT o.occurrence_id, o.bairro, b.lat_c, b.lon_c, b.radius FROM occ o JOIN nbox b ON o.bairro = b.zone""")
def j4(spark, d):
    return geo.zone_dimension_join(X.occ(spark, d), X.nbox(spark, d)).select(K.ID, K.ZONE, "lat_c", "lon_c", "radius")


@query("j5_weight_lookup", with_("sev") + """
SELECT occurrence_id,
  coalesce(CASE tipo_crime WHEN 'Homicídio' THEN 10 WHEN 'Latrocínio' THEN 9 WHEN 'Sequestro' THEN 8 WHEN 'Estupro' THEN 8
     WHEN 'Roubo' THEN 6 WHEN 'Extorsão' THEN 5 WHEN 'Furto' THEN 3 WHEN 'Estelionato' THEN 2 WHEN 'Ameaça' THEN 2 END, 1)
     AS peso_tipo,
  coalesce(CASE arma_utilizada WHEN 'Arma de Fogo' THEN 5 WHEN 'Arma Branca' THEN 3 WHEN 'Outros' THEN 2
     WHEN 'Sem Arma' THEN 1 END, 1) AS peso_arma
FROM occ""")
def j5(spark, d):
    o = X.occ(spark, d)
    o = joins.weight_lookup(o, dims.weight_table(spark, K.TYPE_WEIGHTS), K.TYPE, "peso_tipo")
    o = joins.weight_lookup(o, dims.weight_table(spark, K.WEAPON_WEIGHTS), K.WEAPON, "peso_arma")
    return o.select(K.ID, "peso_tipo", "peso_arma")


@query("j7_complete_calendar", with_("cal") + """
SELECT h.hora, coalesce(c.n, 0) AS n FROM range(0, 24) r(h0)
  CROSS JOIN LATERAL (SELECT CAST(r.h0 AS INTEGER) AS hora) h
  LEFT JOIN (SELECT hora, count(*) AS n FROM cal WHERE tipo_crime IN ('Violência Doméstica', 'Estupro', 'Ameaça')
               AND hora IS NOT NULL GROUP BY hora) c ON c.hora = h.hora""")
def j7(spark, d):
    scope = filters.filter_in(X.cal(spark, d), K.TYPE, K.CASE_TYPES)
    return complete_calendar(hour_histogram(scope), dims.hours(spark), "hora").select("hora", "n")
