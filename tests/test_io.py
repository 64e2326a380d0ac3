"""Sources and sinks (S1, S4–S7) in a scratch directory."""

import os
import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from conftest import SF0001
from sentinela import constants as K
from sentinela.ml import classify as M
from sentinela.plans import fixtures as X
from sentinela.sources.io import export_csv, load_model, read_incidents, read_results, save_model, write_results


def scratch():
    return tempfile.mkdtemp(prefix="sentinela-test-")


def test_read_csv_coerces_and_normalises(spark):
    d = scratch()
    p = os.path.join(d, "in.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write(" Data_Ocorrencia ,TIPO_CRIME,bairro,Latitude,longitude,num_vitimas\n")
        f.write("2024-01-02 10:00:00,Roubo,Pina,-8.09,-34.9,2\n")
        f.write("not a date,Furto,Torre,abc,-34.9,x\n")
    df = read_incidents(spark, p)
    assert df.columns == [K.TS, K.TYPE, K.ZONE, K.LAT, K.LON, K.VICTIMS]
    rows = df.orderBy(K.TYPE).collect()
    assert rows[0][K.TS] is None and rows[0][K.LAT] is None and rows[0][K.VICTIMS] is None
    assert rows[1][K.TS] == datetime(2024, 1, 2, 10) and rows[1][K.LAT] == -8.09 and rows[1][K.VICTIMS] == 2


def test_every_csv_line_is_a_row_or_a_reject(spark):
    from sentinela.operators import clean
    from sentinela.sources.io import read_with_rejects
    d = scratch()
    good = ["2024-01-02 10:00:00,Roubo,Pina,-8.09,-34.9", 'not a date,"Furto, leve",Torre,abc,-34.9', ",,,,"]
    bad = ["2024-01-02 10:00:00,Roubo,Pina", "2024-01-02 10:00:00,Roubo,Pina,-8.09,-34.9,more,fields", "alone"]
    for i, lines in enumerate((good[:2] + bad[:1], bad[1:] + good[2:])):
        with open(os.path.join(d, f"{i}.csv"), "w", encoding="utf-8") as f:
            f.write("\n".join([" Data_Ocorrencia ,TIPO_CRIME,bairro,Latitude,longitude", *lines]) + "\n")
    df, rejects = read_with_rejects(spark, d)
    assert df.columns == [K.TS, K.TYPE, K.ZONE, K.LAT, K.LON]
    assert sorted(r.linha for r in rejects.collect()) == sorted(bad)
    assert rejects.count() + df.count() == len(good) + len(bad)
    assert {r[K.TYPE] for r in df.collect()} == {"Roubo", "Furto, leve", None}
    assert df.select(K.ZONE).where(f"{K.ZONE} = 'Pina'").count() == 1
    report = clean.cleaning_report(df, clean.city_box_flag(), rejects).first()
    assert (report.linhas_entrada, report.linhas_validas, report.linhas_rejeitadas) == (3, 1, 3)


def test_write_and_read_results_partitioned(spark):
    d = scratch()
    lab = X.lab(spark, SF0001)
    rid = write_results(lab, d, {"silhouette_sq": 0.5})
    table, metrics = read_results(spark, d)
    assert table.count() == lab.count()
    run, = os.listdir(os.path.join(d, "runs"))
    assert set(os.listdir(os.path.join(d, "runs", run, "table"))) >= {"ano=2024"}
    m = metrics.collect()
    assert m[0]["run_id"] == rid and m[0]["metric"] == "silhouette_sq" and m[0]["value"] == 0.5
    # month predicate prunes partitions
    plan = table.where(F.col("mes") == 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_results_are_one_run_or_the_run_before(spark):
    import pytest
    d = scratch()
    with pytest.raises(Exception):
        read_results(spark, d)
    first, second = (spark.range(n).withColumn("run", F.lit(n)) for n in (3, 5))
    write_results(first, d, {"a": 1.0}, "r1")
    broken = second.withColumn("run", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception):  # the table fails half-way
        write_results(broken, d, {"a": 2.0}, "r2")
    with pytest.raises(Exception):  # the table is written, its metrics fail
        write_results(second, d, {"a": "no number"}, "r2")
    table, metrics = read_results(spark, d)
    assert table.count() == 3 and [(r.run_id, r.value) for r in metrics.collect()] == [("r1", 1.0)]
    write_results(second, d, None, "r3")
    table, metrics = read_results(spark, d)
    assert table.count() == 5 and metrics.count() == 0
    assert read_results(spark, d, "r1")[0].count() == 3
    with pytest.raises(FileNotFoundError):
        read_results(spark, d, "r2")


def test_export_csv(spark):
    d = os.path.join(scratch(), "out")
    df = X.occ(spark, SF0001).select(K.ID, K.TYPE).limit(20)
    export_csv(df, d)
    back = spark.read.option("header", True).csv(d)
    assert back.columns == [K.ID, K.TYPE] and back.count() == 20


def test_save_and_load_model(spark):
    d = scratch()
    occ = X.occ(spark, SF0001)
    r = M.train_risk_model(occ, "random_forest", cv_folds=None)
    save_model(r.model, d, {"model_type": r.model_type, "features": r.feature_names})
    model, meta = load_model(spark, d)
    assert meta["model_type"] == "random_forest" and meta["features"] == r.feature_names
    a = M.predict(r.model, occ.select(K.ID, K.ZONE, K.TS), "random_forest").select(K.ID, "previsao")
    b = M.predict(model, occ.select(K.ID, K.ZONE, K.TS), "random_forest").select(K.ID, "previsao")
    assert sorted(a.collect()) == sorted(b.collect())


def test_upload_falls_back_without_required_columns(spark):
    from sentinela.sources.io import read_upload_or_default
    d = scratch()
    good = os.path.join(d, "good.csv")
    bad = os.path.join(d, "bad.csv")
    with open(good, "w", encoding="utf-8") as f:
        f.write("data_ocorrencia,tipo_crime,bairro,latitude,longitude\n2024-01-02 10:00:00,Roubo,Pina,-8.09,-34.9\n")
    with open(bad, "w", encoding="utf-8") as f:
        f.write("tipo_crime,bairro\nFurto,Torre\nFurto,Pina\n")
    df, miss = read_upload_or_default(spark, bad, good)
    assert miss == [K.TS, K.LAT, K.LON] and df.count() == 1
    df, miss = read_upload_or_default(spark, good, bad)
    assert miss == [] and df.count() == 1


def test_dashboard_plans_build_and_run(spark):
    from sentinela.plans import dashboards as D
    lab = X.risk(spark, SF0001)
    tabs = D.general_tabs(lab)
    assert {"temporal", "clusters", "anomalias", "risco", "perfil", "modus"} <= set(tabs)
    assert tabs["temporal"]["horas"].agg(F.sum("n")).first()[0] == lab.count()
    for tab in tabs.values():
        for df in tab.values():
            df.limit(1).collect()
    case = D.case_tabs(X.occ(spark, SF0001))
    for tab in case.values():
        for df in tab.values():
            df.limit(1).collect()
