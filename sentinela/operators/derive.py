"""Derived columns (P2–P5, P9–P24).  All are projections: no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.functions import scalar as S
from sentinela.operators._common import dtype_of, ts_literal
from sentinela.schema import present


def add_calendar(df: DataFrame, ts: str = K.TS) -> DataFrame:
    """Hora, mes, ano, dia_mes."""
    return df.withColumns({
        "hora": F.hour(ts), "mes": F.month(ts), "ano": F.year(ts), "dia_mes": F.dayofmonth(ts)})


def add_weekday(df: DataFrame, ts: str = K.TS, names: Sequence[str] = K.WEEKDAYS_LOWER,
                name_col: str = "dia_semana") -> DataFrame:
    """ISO weekday number ``dow`` (key) and its name (label)."""
    return df.withColumns({"dow": S.iso_weekday(ts), name_col: S.weekday_name(ts, names)})


def add_period(df: DataFrame, hour: str = "hora") -> DataFrame:
    """periodo_dia from the hour."""
    return df.withColumn("periodo_dia", S.time_period(hour))


def add_weekend(df: DataFrame, ts: str = K.TS) -> DataFrame:
    """P5: fim_semana (NULL timestamp → false, like ``isin``)."""
    return df.withColumn("fim_semana", F.coalesce(S.is_weekend(ts), F.lit(False)))


def derive_time_features(df: DataFrame, ts: str = K.TS, names: Sequence[str] = K.WEEKDAYS_LOWER) -> DataFrame:
    """P2–P5 together, as the batch job does."""
    return add_weekend(add_period(add_weekday(add_calendar(df, ts), ts, names)), ts)


def add_victim_fields(df: DataFrame, sex: str = K.SEX, age: str = K.AGE,
                      status: str = K.STATUS) -> DataFrame:
    """P9, P10, P11 of the case dashboard: genero_vitima, faixa_etaria_vitima, status_caso."""
    cols = {}
    if sex in df.columns:
        cols["genero_vitima"] = S.victim_gender(sex)
    if age in df.columns:
        cols["faixa_etaria_vitima"] = S.cut(age, K.AGE_BINS, K.AGE_LABELS_VICTIM)
    if status in df.columns:
        cols["status_caso"] = F.col(status)
    return df.withColumns(cols)


def add_age_band(df: DataFrame, age: str = K.AGE, out: str = "faixa_etaria",
                 labels: Sequence[str] = K.AGE_LABELS) -> DataFrame:
    """P10: right-closed age bands plus an ordinal for sorting."""
    return df.withColumns({out: S.cut(age, K.AGE_BINS, labels),
                           out + "_ord": S.cut_ordinal(age, K.AGE_BINS)})


def add_month_key(df: DataFrame, ts: str = K.TS, out: str = "mes_ano") -> DataFrame:
    """P12."""
    return df.withColumn(out, S.month_key(ts))


def add_flags(df: DataFrame, victims: str = K.VICTIMS, weapon: str = K.WEAPON,
              lethal: Sequence[str] = K.LETHAL_WEAPONS) -> DataFrame:
    """multiplas_vitimas, arma_letal."""
    return df.withColumns({"multiplas_vitimas": F.col(victims) > 1,
                           "arma_letal": F.col(weapon).isin(list(lethal))})


def severity_index(df: DataFrame, type_col: str = K.TYPE, weapon: str = K.WEAPON,
                   victims: str = K.VICTIMS, suspects: str = K.SUSPECTS,
                   type_weights: dict = K.TYPE_WEIGHTS, weapon_weights: dict = K.WEAPON_WEIGHTS,
                   default: int = K.DEFAULT_WEIGHT) -> DataFrame:
    """P14 + P15: indice_gravidade and nivel_gravidade.

    The weight tables are tiny fixed dictionaries, compiled into the plan as
    map literals (no join at all); see ``operators.joins.weight_lookup`` for the
    join form used with user-supplied weight tables.
    """
    idx = (S.lookup(type_col, type_weights, default) + S.lookup(weapon, weapon_weights, default)
           + F.col(victims) * 2 + F.col(suspects)).cast("int")
    return df.withColumn("indice_gravidade", idx).withColumn(
        "nivel_gravidade", S.cut("indice_gravidade", K.SEVERITY_BINS, K.SEVERITY_LABELS))


def case_gravity(df: DataFrame, weapon: str = K.WEAPON, victims: str = K.VICTIMS) -> DataFrame:
    """3 for firearm, 2 for knife, + victims − 1; cut (−1,0], (0,2], (2,10]."""
    score = F.lit(0)
    if weapon in df.columns:
        score = score + S.lookup(weapon, K.CASE_WEAPON_POINTS, 0)
    if victims in df.columns:
        score = score + (F.col(victims) - 1)
    return df.withColumn("gravidade_score", score.cast("int")).withColumn(
        "gravidade", S.cut("gravidade_score", K.CASE_GRAVITY_BINS, K.CASE_GRAVITY_LABELS))


DETAIL_FIXED = [K.ID, K.TS, K.TYPE, K.ZONE]
DETAIL_OPTIONAL = [K.WEAPON, K.STATUS, K.PRECINCT, "cluster", "anomalia", "nivel_risco"]


def detail_view(df: DataFrame, optional: Iterable[str] = DETAIL_OPTIONAL,
                ts: str = K.TS, fmt: str = "dd/MM/yyyy HH:mm") -> DataFrame:
    """Fixed columns plus the optional ones present; timestamp as text."""
    cols = [c for c in DETAIL_FIXED if c in df.columns] + present(df, optional)
    out = df.select(*cols)
    return out.withColumn(ts, F.date_format(ts, fmt)) if ts in out.columns else out


def point_label(df: DataFrame, type_col: str = K.TYPE, zone: str = K.ZONE, ts: str = K.TS,
                out: str = "rotulo") -> DataFrame:
    """P18: 'type | zone | dd/MM/yyyy', missing parts → 'N/A'."""
    na = F.lit("N/A")
    return df.withColumn(out, F.concat_ws(
        " | ", F.coalesce(F.col(type_col), na), F.coalesce(F.col(zone), na),
        F.coalesce(F.date_format(ts, "dd/MM/yyyy"), na)))


def anonymize(df: DataFrame, cols: Iterable[str], n: int = 8) -> DataFrame:
    """P20: replace values by the first ``n`` hex digits of their MD5; absent columns skipped."""
    return df.withColumns({c: S.anonymize_col(c, n) for c in present(df, cols)})


def apply_retention(df: DataFrame, as_of: datetime, cols: Iterable[str], years: int = 5,
                    ts: str = K.TS) -> DataFrame:
    """Anonymise ``cols`` of rows older than ``years`` before ``as_of``."""
    try:
        cutoff = as_of.replace(year=as_of.year - years)
    except ValueError:  # 29 February
        cutoff = as_of.replace(year=as_of.year - years, day=28)
    old = F.col(ts) < ts_literal(cutoff, dtype_of(df, ts))
    return df.withColumns({c: F.when(old, S.anonymize_col(c)).otherwise(F.col(c))
                           for c in present(df, cols)})


def cluster_colour(df: DataFrame, cluster: str = "cluster", palette_size: int = 10) -> DataFrame:
    """Palette slot = cluster mod palette size; noise (−1) left out."""
    return df.where(F.col(cluster) != -1).withColumn("cor_slot", F.pmod(F.col(cluster), F.lit(palette_size)))


def type_colour(df: DataFrame, type_col: str = K.TYPE, colours: dict = K.TYPE_COLOURS,
                default: str = K.DEFAULT_COLOUR) -> DataFrame:
    """Fixed type → colour map, default grey."""
    return df.withColumn("cor", S.lookup(type_col, colours, default))
