"""Rule operators (R1–R8): insights as rows (rule, subject, value, message_code).

The input is scanned once, into counts per combination of the columns that the
rules read; each rule is evaluated on that table and the rule rows are unioned.
No frame is joined to another one-row frame (no cross joins).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.functions import scalar as S
from sentinela.operators import profile as P
from sentinela.operators._common import ensure_hour, n_rows
from sentinela.operators.crosstab import crosstab
from sentinela.operators.joins import semi_top_n
from sentinela.plans.hints import ROWS, precounted

RULE_SCHEMA = "rule string, subject string, value double, message_code string"


def _rule(rule: str, subject: Column | None, value: Column | None, code: Column | str) -> list[Column]:
    return [F.lit(rule).alias("rule"),
            (subject.cast("string") if subject is not None else F.lit(None).cast("string")).alias("subject"),
            (value.cast("double") if value is not None else F.lit(None).cast("double")).alias("value"),
            (F.lit(code) if isinstance(code, str) else code).alias("message_code")]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _top_with_share(df: DataFrame, col: str) -> DataFrame:
    """Most frequent value of ``col`` with its count and share of all rows (one row)."""
    t = P._with_total(df, col, "n")
    return t.orderBy(F.col("n").desc(), F.col(col).asc()).limit(1) \
        .withColumn("share", S.pct("n", "__total", 1))


def report_insights(df: DataFrame, ts: str = K.TS) -> DataFrame:
    """Top zone share > 20 %; resolution < 70 % or > 85 %; peak hour at night."""
    df = precounted(ensure_hour(df, ts), [K.ZONE, K.STATUS, "hora"])
    conc = _top_with_share(df, K.ZONE).where(F.col("share") > K.REPORT_TOP_ZONE_SHARE) \
        .select(*_rule("concentracao", F.col(K.ZONE), F.col("share"), "ALTA_CONCENTRACAO"))
    rate = df.agg(S.pct(n_rows(df, F.col(K.STATUS) == K.STATUS_DONE), n_rows(df), 1).alias("r"))
    code = F.when(F.col("r") < K.REPORT_RESOLUTION_LOW, "RESOLUCAO_BAIXA") \
        .when(F.col("r") > K.REPORT_RESOLUTION_HIGH, "RESOLUCAO_EXCELENTE")
    res = rate.select(*_rule("resolucao", None, F.col("r"), code)).where(F.col("message_code").isNotNull())
    hour = P.peak_hour(df, ts).where(S.is_night("hora")) \
        .select(*_rule("horario", F.col("hora"), F.col("hora"), "PICO_NOTURNO"))
    return _union([conc, res, hour])


def cluster_insights(df: DataFrame, cluster: str = "cluster", ts: str = K.TS) -> DataFrame:
    """R2: per cluster (noise excluded): night or morning pattern from the mean
    hour; top-zone share > 70 %."""
    d = precounted(ensure_hour(df, ts).where(F.col(cluster) != -1), [cluster, "hora", K.ZONE])
    known = F.when(F.col("hora").isNotNull(), F.col(ROWS))
    mh = d.groupBy(cluster).agg((F.sum(F.col("hora") * F.col(ROWS)) / F.sum(known)).alias("h"))
    code = F.when((F.col("h") >= K.NIGHT_FROM) | (F.col("h") <= K.NIGHT_TO), "PADRAO_NOTURNO") \
        .when((F.col("h") > 6) & (F.col("h") <= 12), "PADRAO_MATINAL")
    hours = mh.select(*_rule("cluster_horario", F.col(cluster), S.round_half_up("h", 2), code)) \
        .where(F.col("message_code").isNotNull())
    zc = d.where(F.col(K.ZONE).isNotNull()).groupBy(cluster, K.ZONE).agg(n_rows(d).alias("n"))
    tot = d.groupBy(cluster).agg(n_rows(d).alias("t"))
    top = zc.groupBy(cluster).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(K.ZONE).alias("z"))).alias("m"))
    top = top.join(tot, cluster)
    share = S.pct(-F.col("m.neg"), F.col("t"), 1)
    geo = top.where(share > K.CLUSTER_ZONE_SHARE).select(*_rule(
        "cluster_concentracao", F.concat_ws(":", F.col(cluster).cast("string"), F.col("m.z")), share,
        "FOCO_GEOGRAFICO"))
    return _union([hours, geo])


def anomaly_alerts(df: DataFrame, flag: str = "anomalia", ts: str = K.TS) -> DataFrame:
    """More than half of the anomalies at night; top zone holds more than
    30 % of the anomalies."""
    a = precounted(ensure_hour(df, ts).where(F.col(flag) == -1), ["hora", K.ZONE])
    night = a.agg(n_rows(a, S.is_night("hora")).alias("k"), n_rows(a).alias("t"))
    night = night.where(F.col("k") > F.col("t") * K.ANOMALY_NIGHT_SHARE) \
        .select(*_rule("alerta_noturno", None, S.pct("k", "t", 1), "ALERTA_NOTURNO"))
    z = P._with_total(a, K.ZONE, "n").orderBy(F.col("n").desc(), F.col(K.ZONE).asc()).limit(1)
    zone = z.where(F.col("n") > F.col("__total") * K.ANOMALY_ZONE_SHARE) \
        .select(*_rule("alerta_geografico", F.col(K.ZONE), S.pct("n", "__total", 1), "ALERTA_GEOGRAFICO"))
    return _union([night, zone])


def statistics_insights(df: DataFrame, ts: str = K.TS, flag: str = "anomalia") -> DataFrame:
    """Top-3 hours; top-3 zone concentration; mean type diversity; anomaly rate."""
    df = precounted(ensure_hour(df, ts), ["hora", K.ZONE, K.TYPE, flag])
    top = P.top_n(ensure_hour(df, ts), "hora", 3)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("a"),
                                                                        F.col("hora").alias("h")))),
                                    lambda x: F.concat(x["h"].cast("string"), F.lit(":00"))), ", ")
    hours = top.agg(text.alias("t")).select(*_rule("horarios_pico", F.col("t"), None, "HORARIOS_PICO"))
    conc = P.concentration(df, K.ZONE, 3).select(*_rule("concentracao_top3", None, F.col("concentracao"),
                                                        "CONCENTRACAO_TOP3"))
    div = P.mean_diversity(df).select(*_rule("diversidade_media", None, F.col("diversidade_media"), "DIVERSIDADE"))
    frames = [hours, conc, div]
    if flag in df.columns:
        frames.append(P.overall_rates(df, {"r": F.col(flag) == -1}, 2)
                      .select(*_rule("taxa_anomalias", None, F.col("r"), "TAXA_ANOMALIAS")))
    return _union(frames)


def method_insights(df: DataFrame, method: str = K.METHOD) -> DataFrame:
    """Dominant method and its count; zone where it is commonest; number of methods."""
    df = precounted(df, [method, K.ZONE])
    top = P.top_n(df, method, 1)
    dom = top.select(*_rule("metodo_dominante", F.col(method), F.col("n"), "METODO_DOMINANTE"))
    zone = P.global_mode(df.join(F.broadcast(top.select(method)), method, "left_semi"), K.ZONE) \
        .select(*_rule("bairro_do_metodo", F.col(K.ZONE), F.col("n"), "BAIRRO_METODO"))
    cnt = P.distinct_counts(df, [method]).select(*_rule("n_metodos", None, F.col(f"n_{method}"), "N_METODOS"))
    return _union([dom, zone, cnt])


def typical_profile(df: DataFrame, band: str = "faixa_etaria") -> DataFrame:
    """Modes of sex, age band and weapon; share of male suspects among known sex."""
    df = precounted(df, [K.SEX, band, K.WEAPON])
    frames = [P.global_mode(df, c).select(*_rule(r, F.col(c), F.col("n"), code)) for c, r, code in (
        (K.SEX, "sexo_mais_comum", "PERFIL_SEXO"), (band, "faixa_mais_comum", "PERFIL_FAIXA"),
        (K.WEAPON, "arma_mais_comum", "PERFIL_ARMA")) if c in df.columns]
    male = df.agg(n_rows(df, F.col(K.SEX) == "Masculino").alias("m"), n_rows(df, F.col(K.SEX).isNotNull()).alias("t"))
    frames.append(male.where(F.col("m") > 0).select(*_rule("pct_masculino", None, S.pct("m", "t", 1), "PCT_MASCULINO")))
    return _union(frames)


def risk_recommendation(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Predicted level → action set code."""
    p = F.col(prediction)
    return df.withColumn("recomendacao", F.when(p.contains("Alto"), "ACOES_ALTO")
                         .when(p.contains("Médio"), "ACOES_MEDIO").otherwise("ROTINA"))


def zone_statistics(df: DataFrame, k_zones: int = 5, k_types: int = 5) -> tuple[DataFrame, DataFrame]:
    """Top-10 zones, and the counts of the top zones × top types."""
    return P.top_n(df, K.ZONE, 10), crosstab(semi_top_n(df, K.ZONE, k_zones, K.TYPE, k_types), K.ZONE, K.TYPE)
