"""The two dashboards of the original as table plans: each tab is a
dictionary of DataFrames computed by the operators (charts are not built).

The filtered base is settled once because every tab reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.ml import anomaly as A, cluster as C, evaluate as EV
from sentinela.ml.features import label_encode
from sentinela.operators import clean, crosstab as X6, derive, filters, geo, insights as R, profile as P
from sentinela.operators.report import report_tables
from sentinela.plans.hints import settled

#: Features of the case dashboard's clusterings and anomaly detectors (with codes of type and zone).
CASE_CLUSTER = [K.LAT, K.LON, "hora", "tipo_idx", "bairro_idx"]
CASE_ANOMALY = [K.LAT, K.LON, "hora", "tipo_idx", K.VICTIMS, K.SUSPECTS]


def general_base(prepared: DataFrame, spec: filters.FilterSpec | None = None) -> DataFrame:
    """Prepared (labelled) table → filtered base of the general dashboard."""
    d = prepared if "hora" in prepared.columns else derive.derive_time_features(prepared)
    return settled(filters.apply_filters(d, spec or filters.FilterSpec()))


def general_tabs(prepared: DataFrame, spec: filters.FilterSpec | None = None,
                 boxes: DataFrame | None = None) -> dict[str, dict[str, DataFrame]]:
    d = prepared if "hora" in prepared.columns else derive.derive_time_features(prepared)
    base = general_base(d, spec)
    has = set(base.columns)
    valid = clean.clean_geo(base, boxes)
    tabs: dict[str, dict[str, DataFrame]] = {
        "kpis": {"kpis": P.kpis_general(d, (spec or filters.FilterSpec()).predicate(d))},
        "filtros": {"opcoes": filters.filter_options(d), "datas": filters.date_bounds(d)},
        "geografico": {"extensao": geo.geo_extent(valid), "hexagonos": geo.hex_density(valid),
                       "calor": geo.heat_points(valid), "limpeza": clean.cleaning_report(
                           clean.geo_flag(base, boxes), F.col("coord_valida"))},
        "temporal": {"horas": P.hour_histogram(base), "pico_hora": P.peak_hour(base),
                     "dias": P.weekday_histogram(base), "pico_dia": P.peak_day(base),
                     "meses": P.monthly_trend(base), "hora_dia": X6.hour_weekday_matrix(base)},
        "estatisticas": {"resumo": P.summary(base), "top_tipos": P.top_n(base, K.TYPE, 10),
                         "top_bairros": P.top_n(base, K.ZONE, 10), "insights": R.statistics_insights(base)},
        "resolucao": {"por_delegacia": P.conditional_rate(base, K.PRECINCT, F.col(K.STATUS) == K.STATUS_DONE,
                                                          of=K.STATUS)},
    }
    tabs["resolucao"]["melhor_pior"] = P.best_worst(tabs["resolucao"]["por_delegacia"], K.PRECINCT)
    sev = derive.severity_index(base)
    tabs["gravidade"] = {"distribuicao": P.share_table(sev, "nivel_gravidade"),
                         "media_por_bairro": P.group_mean(sev, K.ZONE, "indice_gravidade", k=10),
                         "mais_graves": P.most_severe(sev)}
    prof = derive.add_age_band(base)
    tabs["perfil"] = {"sexo": P.frequency(prof, K.SEX), "faixa": P.frequency(prof, "faixa_etaria"),
                      "armas": P.top_n(prof, K.WEAPON, 8), "tipo_sexo": X6.crosstab(prof, K.TYPE, K.SEX),
                      "tipo_arma": X6.crosstab(prof, K.TYPE, K.WEAPON),
                      "por_tipo": P.mode_by_group(prof, K.TYPE, [K.SEX, "faixa_etaria", K.WEAPON]),
                      "perfil_tipico": R.typical_profile(prof)}
    tabs["modus"] = {"frequencia": P.top_n(base, K.METHOD, 8), "bairro_metodo": X6.crosstab(base, K.ZONE, K.METHOD),
                     "tendencia": X6.top_patterns_over_time(base, 3), "insights": R.method_insights(base)}
    if "cluster" in has:
        from sentinela.ml.cluster import cluster_profile, cluster_sizes, noise_and_count
        tabs["clusters"] = {"tamanhos": cluster_sizes(base), "ruido": noise_and_count(base),
                            "perfil": cluster_profile(base)}
    if "anomalia" in has:
        tabs["anomalias"] = {"perfil": EV.anomaly_profile(base), "por_tipo": P.anomalies_by(base, K.TYPE),
                             "por_bairro": P.anomalies_by(base, K.ZONE, 10),
                             "lista": P.latest(filters.only_anomalies(base)),
                             "so_anomalias": P.anomaly_only_types(base)}
    if "nivel_risco" in has:
        from sentinela.operators.risk import risk_stats
        tabs["risco"] = {"niveis": risk_stats(base)}
    return tabs


def case_base(df: DataFrame, spec: filters.FilterSpec | None = None) -> DataFrame:
    """Case dashboard input: the three case types, calendar fields with
    capitalised weekday names, victim gender, victim age band and case status."""
    d = filters.filter_in(df, K.TYPE, K.CASE_TYPES)
    d = derive.add_weekday(derive.add_calendar(d), names=K.WEEKDAYS_CAPITAL)
    d = derive.add_victim_fields(d)
    return settled(filters.apply_filters(d, spec or filters.FilterSpec()))


def with_codes(df: DataFrame) -> DataFrame:
    """Alphabetical codes of type and zone, which the case models read."""
    return label_encode(label_encode(df, K.TYPE, "tipo_idx"), K.ZONE, "bairro_idx")


def case_models(base: DataFrame, k: int = 4, eps: float = 0.5, min_samples: int = 3, contamination: float = 0.1,
                n_neighbors: int = 10) -> dict[str, dict[str, DataFrame]]:
    """The case dashboard's cluster and anomaly tabs: labelled tables of both
    clusterings and both detectors, on scaled features."""
    coded = settled(with_codes(base))
    features = [c for c in CASE_ANOMALY if c in coded.columns]
    return {
        "agrupamento": {"kmeans": C.cluster(coded, "kmeans", k=k, n_init=1, cat_cols=[], num_cols=CASE_CLUSTER),
                        "dbscan": C.cluster(coded, "dbscan", features=CASE_CLUSTER, eps=eps, min_samples=min_samples)},
        "anomalias": {"isolation_forest": A.detect_anomalies(coded, "isolation_forest", features=features,
                                                             contamination=contamination),
                      "lof": A.detect_anomalies(coded, "local_outlier_factor", features=features,
                                                n_neighbors=n_neighbors, contamination=contamination)},
    }


def case_tabs(df: DataFrame, spec: filters.FilterSpec | None = None) -> dict[str, dict[str, DataFrame]]:
    base = case_base(df, spec)
    flags = derive.add_flags(base)
    return {
        "escopo": {"contagens": P.scope_counts(df)},
        "kpis": {"kpis": P.kpis_cases(base)},
        "temporal": {"horas": P.hour_histogram(base), "dias": P.weekday_histogram(base, names=K.WEEKDAYS_CAPITAL),
                     "sazonalidade": X6.seasonality(base)},
        "vitimas": {"genero": P.frequency(base, "genero_vitima"), "faixa": P.frequency(base, "faixa_etaria_vitima"),
                    "tipo_genero": X6.crosstab_pct(base, K.TYPE, "genero_vitima")},
        "suspeitos": {"sexo": P.frequency(base, K.SEX), "idade_media": P.group_mean(base, K.TYPE, K.AGE),
                      "n_suspeitos": P.frequency(base, K.SUSPECTS)},
        "investigacao": {"status": P.frequency(base, "status_caso"),
                         "por_delegacia": P.conditional_rate(base, K.PRECINCT, F.col(K.STATUS) == K.STATUS_DONE),
                         "por_tipo": P.conditional_rate(base, K.TYPE, F.col(K.STATUS) == K.STATUS_DONE)},
        "risco": {"indicadores": P.risk_indicators(base),
                  "vitimas_arma": X6.crosstab_pct(flags, "multiplas_vitimas", "arma_letal"),
                  "arma_por_tipo": P.mode_by_group(base, K.TYPE, [K.WEAPON]),
                  "gravidade": derive.case_gravity(base).groupBy("gravidade").count()},
        "bairros": dict(zip(("top10", "calor"), R.zone_statistics(base))),
        "relatorio": {"tabelas": report_tables(base), "insights": R.report_insights(base)},
    }
