"""Hand-made edge tables (FIXTURES.md §4) for what the synthetic data lacks."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.functions import scalar as S
from sentinela.operators import clean, crosstab, derive, filters, geo, joins, profile as P, risk
from sentinela.schema import MissingColumnsError, missing_columns, normalize_columns, require
from sentinela.sources.dims import zone_boxes

SCHEMA = ("occurrence_id long, data_ocorrencia timestamp, tipo_crime string, bairro string, latitude double, "
          "longitude double, arma_utilizada string, sexo_suspeito string, idade_suspeito int, "
          "quantidade_vitimas int, quantidade_suspeitos int, status_investigacao string, orgao_responsavel string")


def inc(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = {"occurrence_id": i, "data_ocorrencia": datetime(2024, 1, 1, 10), "tipo_crime": "Roubo",
             "bairro": "Pina", "latitude": -8.09, "longitude": -34.9, "arma_utilizada": "Faca",
             "sexo_suspeito": "Masculino", "idade_suspeito": 30, "quantidade_vitimas": 1,
             "quantidade_suspeitos": 1, "status_investigacao": "Concluído", "orgao_responsavel": "D1"}
        d.update(r)
        full.append(tuple(d[c.split()[0]] for c in SCHEMA.split(", ")))
    return spark.createDataFrame(full, SCHEMA)


def col(df, c):
    return [r[c] for r in df.orderBy("occurrence_id").collect()]


# ---- nulls --------------------------------------------------------------
def test_null_keys_dropped_from_frequency(spark):
    df = inc(spark, [{"bairro": None}, {"bairro": "A"}, {"bairro": "A"}, {"bairro": "B"}])
    out = [(r["bairro"], r["n"]) for r in P.frequency(df, "bairro").collect()]
    assert out == [("A", 2), ("B", 1)]


def test_null_share_counts_in_total(spark):
    df = inc(spark, [{"bairro": None}, {"bairro": "A"}, {"bairro": "A"}, {"bairro": "B"}])
    out = {r["bairro"]: r["pct"] for r in P.share_table(df, "bairro").collect()}
    assert out == {"A": 50.0, "B": 25.0}


def test_null_coordinates_fail_city_box(spark):
    df = inc(spark, [{"latitude": None}, {"longitude": None}, {}])
    assert col(clean.in_city_box(df), "coord_valida") == [False, False, True]


def test_fill_unknown_and_drop_null(spark):
    df = inc(spark, [{"bairro": None, "tipo_crime": None}, {}])
    f = clean.fill_unknown(df)
    assert col(f, "bairro") == [K.UNKNOWN, "Pina"] and col(f, "tipo_crime") == [K.UNKNOWN, "Roubo"]
    assert clean.drop_null(df, ["bairro", "nao_existe"]).count() == 1


def test_victim_gender_null_goes_to_feminino(spark):
    df = inc(spark, [{"sexo_suspeito": None}, {"sexo_suspeito": "Feminino"}, {"sexo_suspeito": "Masculino"}])
    assert col(derive.add_victim_fields(df), "genero_vitima") == ["Feminino", "Masculino", "Feminino"]


def test_null_timestamp_invalid_and_weekend_false(spark):
    df = inc(spark, [{"data_ocorrencia": None}])
    assert col(clean.valid_datetime(df, as_of=datetime(2025, 1, 1)), "data_valida") == [False]
    assert col(derive.add_weekend(df), "fim_semana") == [False]


# ---- bad text ------------------------------------------------------------
def test_bad_text_parses_to_null(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05", "-8.1"), ("not a date", "x"), (None, None)], "t string, v string")
    out = df.select(S.parse_ts("t").alias("t"), S.to_number("v").alias("v")).collect()
    assert out[0]["t"] == datetime(2024, 1, 2, 3, 4, 5) and out[0]["v"] == -8.1
    assert out[1]["t"] is None and out[1]["v"] is None


def test_normalize_columns_and_missing(spark):
    df = spark.createDataFrame([(1, 2)], "` Data_Ocorrencia ` int, `BAIRRO  ` int")
    n = normalize_columns(df)
    assert n.columns == ["data_ocorrencia", "bairro"]
    assert missing_columns(n, ["bairro", "latitude"]) == ["latitude"]
    with pytest.raises(MissingColumnsError):
        require(n, ["latitude"])


# ---- bin edges -------------------------------------------------------------
def test_age_bins_right_closed(spark):
    ages = [0, 1, 18, 19, 25, 100, 101, None]
    df = inc(spark, [{"idade_suspeito": a} for a in ages])
    assert col(derive.add_age_band(df), "faixa_etaria") == [None, "<18", "<18", "18-25", "18-25", ">50", None, None]


def test_severity_bins(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0, 10, 11, 20, 21, 100, 101])],
                               "occurrence_id long, s int")
    out = col(df.withColumn("l", S.cut("s", K.SEVERITY_BINS, K.SEVERITY_LABELS)), "l")
    assert out == [None, "Baixa", "Média", "Média", "Alta", "Alta", None]


def test_severity_index_defaults(spark):
    df = inc(spark, [{"tipo_crime": "Homicídio", "arma_utilizada": "Arma de Fogo", "quantidade_vitimas": 2,
                      "quantidade_suspeitos": 3},
                     {"tipo_crime": "Desconhecido", "arma_utilizada": "Faca", "quantidade_vitimas": 1,
                      "quantidade_suspeitos": 1}])
    s = derive.severity_index(df)
    assert col(s, "indice_gravidade") == [10 + 5 + 4 + 3, 1 + 1 + 2 + 1]
    assert col(s, "nivel_gravidade") == ["Alta", "Baixa"]


def test_case_gravity(spark):
    df = inc(spark, [{"arma_utilizada": "Arma de Fogo", "quantidade_vitimas": 3},
                     {"arma_utilizada": "Faca", "quantidade_vitimas": 1},
                     {"arma_utilizada": "Outros", "quantidade_vitimas": 1}])
    g = derive.case_gravity(df)
    assert col(g, "gravidade_score") == [5, 2, 0] and col(g, "gravidade") == ["Alta", "Média", "Baixa"]


# ---- box edges -------------------------------------------------------------
def test_city_box_edges_inclusive(spark):
    pts = [(-8.12, -34.95), (-8.05, -34.85), (-8.121, -34.9), (-8.09, -34.849)]
    df = inc(spark, [{"latitude": a, "longitude": b} for a, b in pts])
    assert col(clean.in_city_box(df), "coord_valida") == [True, True, False, False]


def test_zone_box_unknown_zone_false(spark):
    df = inc(spark, [{"bairro": "Pina", "latitude": -8.088 + 0.0149, "longitude": -34.885},
                     {"bairro": "Pina", "latitude": -8.088 + 0.0151, "longitude": -34.885},
                     {"bairro": "Lugar Nenhum", "latitude": -8.088, "longitude": -34.885}])
    assert col(clean.in_zone_box(df, zone_boxes(spark)), "coord_valida") == [True, False, False]
    assert clean.clean_geo(df, zone_boxes(spark)).count() == 1


# ---- ties --------------------------------------------------------------------
def test_ties_break_by_key(spark):
    df = inc(spark, [{"bairro": "B"}, {"bairro": "A"}, {"bairro": "C"}, {"bairro": "C"}, {"bairro": "A"}])
    assert [r["bairro"] for r in P.top_n(df, "bairro", 2).collect()] == ["A", "C"]
    assert P.global_mode(df, "bairro").first()["bairro"] == "A"
    h = inc(spark, [{"data_ocorrencia": datetime(2024, 1, 1, h)} for h in (5, 3, 3, 5)])
    assert P.peak_hour(h).first()["hora"] == 3


def test_best_worst_tie(spark):
    r = spark.createDataFrame([("B", 50.0), ("A", 50.0), ("C", 10.0)], "k string, taxa double")
    out = {x["posicao"]: x["k"] for x in P.best_worst(r, "k").collect()}
    assert out == {"melhor": "A", "pior": "C"}


def test_mode_by_group_ties(spark):
    df = inc(spark, [{"tipo_crime": "T", "arma_utilizada": "Faca"}, {"tipo_crime": "T", "arma_utilizada": "Arma"},
                     {"tipo_crime": "U", "arma_utilizada": None}])
    out = {r["tipo_crime"]: r["moda_arma_utilizada"] for r in P.mode_by_group(df, "tipo_crime", ["arma_utilizada"]).collect()}
    assert out == {"T": "Arma", "U": None}


# ---- dates and hours ---------------------------------------------------------
def test_valid_datetime_bounds(spark):
    as_of = datetime(2024, 6, 1, 12, 0, 0)
    ts = [datetime(1999, 12, 31, 23, 59), datetime(2000, 1, 1), datetime(2024, 6, 1, 11, 59, 59),
          datetime(2024, 6, 1, 12, 0, 1)]
    df = inc(spark, [{"data_ocorrencia": t} for t in ts])
    assert col(clean.valid_datetime(df, as_of=as_of), "data_valida") == [False, True, True, False]


def test_date_range_inclusive_same_day(spark):
    ts = [datetime(2024, 1, 8, 0, 0), datetime(2024, 1, 8, 23, 59, 59), datetime(2024, 1, 9), datetime(2024, 1, 7, 23)]
    df = inc(spark, [{"data_ocorrencia": t} for t in ts])
    assert col(filters.filter_date_range(df, date(2024, 1, 8), date(2024, 1, 8)), "occurrence_id") == [0, 1]


def test_periods_and_night(spark):
    hours = [0, 5, 6, 11, 12, 17, 18, 21, 22, 23]
    df = inc(spark, [{"data_ocorrencia": datetime(2024, 1, 1, h)} for h in hours])
    d = derive.derive_time_features(df).withColumn("noite", S.is_night("hora"))
    assert col(d, "periodo_dia") == ["Madrugada", "Madrugada", "Manhã", "Manhã", "Tarde", "Tarde", "Noite",
                                     "Noite", "Noite", "Noite"]
    assert col(d, "noite") == [True, True, True, False, False, False, False, False, True, True]
    assert col(filters.filter_hour_range(d, 6, 17), "hora") == [6, 11, 12, 17]


def test_retention(spark):
    df = inc(spark, [{"data_ocorrencia": datetime(2019, 1, 1)}, {"data_ocorrencia": datetime(2020, 1, 2)}])
    r = derive.apply_retention(df, datetime(2025, 1, 1), ["bairro"], years=5)
    b = col(r, "bairro")
    assert b[0] != "Pina" and len(b[0]) == 8 and b[1] == "Pina"


def test_summary_span_floor(spark):
    df = inc(spark, [{"data_ocorrencia": datetime(2024, 1, 1, 12)}, {"data_ocorrencia": datetime(2024, 1, 3, 11)}])
    assert P.summary(df).first()["periodo_dias"] == 1


# ---- duplicates, sparse week, empty ----------------------------------------
def test_dedupe_full_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "x int, y string")
    assert clean.dedupe(df).count() == 2 and clean.dedupe(df, ["x"]).count() == 1


def test_sparse_week_is_completed(spark):
    df = inc(spark, [{"data_ocorrencia": datetime(2024, 1, 1)}, {"data_ocorrencia": datetime(2024, 1, 3)}])
    w = [(r["dow"], r["n"]) for r in P.weekday_histogram(df).collect()]
    assert w == [(1, 1), (2, 0), (3, 1), (4, 0), (5, 0), (6, 0), (7, 0)]
    m = crosstab.hour_weekday_matrix(df)
    assert m.count() == 168 and m.agg(F.sum("n")).first()[0] == 2


def test_empty_input(spark):
    df = inc(spark, [{}]).limit(0)
    assert P.frequency(df, "bairro").count() == 0
    assert P.overall_rates(df, {"x": F.col("bairro") == "A"}).first()["x"] == 0.0
    assert P.kpis_cases(df).first()["total"] == 0
    assert P.concentration(df, "bairro").first()["concentracao"] == 0.0
    assert risk.risk_tier(df).count() == 0
    assert geo.hex_density(df).count() == 0
    assert not filters.min_rows(df, 1)


def test_risk_tier_thresholds(spark):
    # zone counts 1, 2, 3, 4 → q33 = 1.99, q66 = 2.98
    rows = [{"bairro": z} for z, n in (("A", 1), ("B", 2), ("C", 3), ("D", 4)) for _ in range(n)]
    r = risk.risk_tier(inc(spark, rows))
    tiers = {x["bairro"]: x["nivel_risco"] for x in r.select("bairro", "nivel_risco").distinct().collect()}
    assert tiers == {"A": K.RISK_LOW, "B": K.RISK_MID, "C": K.RISK_HIGH, "D": K.RISK_HIGH}


def test_write_back_default(spark):
    df = inc(spark, [{}, {}, {}])
    labels = spark.createDataFrame([(0, 3), (2, 1)], "occurrence_id long, cluster int")
    assert col(joins.write_back(df, labels, "cluster", -1), "cluster") == [3, -1, 1]


def test_percent_text_round_trip(spark):
    df = spark.createDataFrame([(12.25,), (0.0,), (100.0,)], "x double")
    out = df.select(S.percent_text("x").alias("t")).withColumn("v", S.parse_percent("t")).collect()
    assert [r["t"] for r in out] == ["12.3%", "0.0%", "100.0%"] and [r["v"] for r in out] == [12.3, 0.0, 100.0]


def test_distinct_counts_exact_and_approximate(spark):
    df = spark.range(20000).selectExpr("id % 5000 AS bairro", "id % 7 AS tipo_crime")
    exact = P.distinct_counts(df, ["bairro", "tipo_crime"]).first()
    approx = P.distinct_counts(df, ["bairro", "tipo_crime"], exact=False, rsd=0.01).first()
    assert exact["n_bairro"] == 5000 and exact["n_tipo_crime"] == 7
    # HyperLogLog++: within three relative standard deviations
    assert abs(approx["n_bairro"] - 5000) / 5000 < 0.03 and approx["n_tipo_crime"] == 7


# queries that train a classifier say that there is nothing to train on
TRAINING = ("m10_train_risk_model", "m10_case_model", "m11_random_forest", "m11_random_forest_check", "m12_feature_importance",
            "m12_importance_check", "m12_planted_feature", "m15_cross_validate", "m15_boosted_cross_validate", "m19_predict",
            "m19_predict_boosted", "m19_predict_check", "m19_predict_planted", "m22_score_and_label")


def test_every_query_on_empty_tables(spark, tmp_path_factory):
    """All registered queries over tables without rows (the two dimensions keep theirs): none crashes."""
    import os

    import pyarrow.parquet as pq

    import __spark_entry__ as E
    from conftest import SF0001
    d = tmp_path_factory.mktemp("empty")
    for t in os.listdir(SF0001):
        x = pq.read_table(f"{SF0001}/{t}")
        pq.write_table(x if t in ("nation.parquet", "region.parquet") else x.slice(0, 0), d / t)
    for name, fn in E.queries().items():
        if name in TRAINING:
            with pytest.raises(ValueError):
                fn(spark, str(d))
        else:
            fn(spark, str(d)).collect()
