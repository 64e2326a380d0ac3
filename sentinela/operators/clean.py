"""Cleaning and validation."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.functions import scalar as S
from sentinela.operators._common import dtype_of, ts_literal
from sentinela.plans.hints import bounded_broadcast
from sentinela.schema import present

MIN_DATE = datetime(2000, 1, 1)


def parse_timestamps(df: DataFrame, cols: Iterable[str] = (K.TS,), fmt: str | None = None) -> DataFrame:
    """Text columns → timestamp; bad text → NULL.  Already-typed columns pass."""
    out = {}
    for c in present(df, cols):
        if dtype_of(df, c).typeName() == "string":
            out[c] = S.parse_ts(c, fmt)
    return df.withColumns(out) if out else df


def to_numbers(df: DataFrame, cols: Iterable[str] = (K.LAT, K.LON)) -> DataFrame:
    """Coerce columns to double; bad text → NULL."""
    return df.withColumns({c: S.to_number(c) for c in present(df, cols)})


def drop_null(df: DataFrame, subset: Iterable[str]) -> DataFrame:
    """Remove rows with NULL in any of ``subset`` (columns present)."""
    sub = present(df, subset)
    return df.na.drop(subset=sub) if sub else df


def fill_unknown(df: DataFrame, cols: Iterable[str] = (K.ZONE, K.TYPE, K.METHOD),
                 value: str = K.UNKNOWN) -> DataFrame:
    """NULL category → 'Não Informado', only for columns present."""
    sub = present(df, cols)
    return df.na.fill({c: value for c in sub}) if sub else df


def city_box_flag(lat: str = K.LAT, lon: str = K.LON, lat_range=K.CITY_LAT, lon_range=K.CITY_LON) -> Column:
    """F5 as a flag column (NULL → false)."""
    return S.in_box(lat, lon, lat_range, lon_range)


def city_box_pred(lat: str = K.LAT, lon: str = K.LON, lat_range=K.CITY_LAT, lon_range=K.CITY_LON) -> Column:
    """F5 as a filter predicate (pushable; NULL rows are dropped by ``where``)."""
    return S.box_pred(lat, lon, lat_range, lon_range)


def in_city_box(df: DataFrame, lat: str = K.LAT, lon: str = K.LON, out: str = "coord_valida",
                lat_range=K.CITY_LAT, lon_range=K.CITY_LON) -> DataFrame:
    """flag column; NULL → false; bounds inclusive."""
    return df.withColumn(out, city_box_flag(lat, lon, lat_range, lon_range))


def in_zone_box(df: DataFrame, boxes: DataFrame, zone: str = K.ZONE, lat: str = K.LAT,
                lon: str = K.LON, out: str = "coord_valida") -> DataFrame:
    """Square test against the box of the row's zone; unknown zone → false.

    ``boxes`` has columns (zone, lat_c, lon_c, radius).  It is a dimension of
    zones, broadcast after a size check: the incident side is never shuffled.
    """
    b = bounded_broadcast(boxes.select(F.col("zone").alias("__zone"), F.col("lat_c").alias("__lat_c"),
                                       F.col("lon_c").alias("__lon_c"), F.col("radius").alias("__r")))
    j = df.join(b, F.col(zone) == F.col("__zone"), "left")
    ok = (F.abs(F.col(lat) - F.col("__lat_c")) <= F.col("__r")) & \
         (F.abs(F.col(lon) - F.col("__lon_c")) <= F.col("__r"))
    return j.withColumn(out, F.coalesce(ok, F.lit(False))).drop("__zone", "__lat_c", "__lon_c", "__r")


def geo_flag(df: DataFrame, boxes: DataFrame | None = None, zone: str = K.ZONE,
             out: str = "coord_valida") -> DataFrame:
    """F7 flag: zone boxes if a zone column and boxes exist, else the city box;
    without coordinates every row counts as valid."""
    if K.LAT not in df.columns or K.LON not in df.columns:
        return df.withColumn(out, F.lit(True))
    if boxes is not None and zone in df.columns:
        return in_zone_box(df, boxes, zone, out=out)
    return in_city_box(df, out=out)


def clean_geo(df: DataFrame, boxes: DataFrame | None = None, zone: str = K.ZONE) -> DataFrame:
    """keep rows with valid positions (see ``geo_flag``); the city-box
    form is a plain, pushable predicate."""
    if K.LAT in df.columns and K.LON in df.columns and (boxes is None or zone not in df.columns):
        return df.where(city_box_pred())
    return geo_flag(df, boxes, zone, "__ok").where(F.col("__ok")).drop("__ok")


def valid_datetime_pred(df: DataFrame, ts: str = K.TS, as_of: datetime | None = None,
                        min_date: datetime = MIN_DATE) -> Column:
    """F8 as a filter predicate: not NULL, not after ``as_of`` (default: now),
    not before ``min_date``.  A plain range on the raw column, so Parquet
    receives it as pushed filters (``year(ts) >= 2000`` or a ``coalesce``
    wrapper would not be pushed)."""
    t = dtype_of(df, ts)
    upper = ts_literal(as_of, t) if as_of is not None else F.current_timestamp().cast(t)
    c = F.col(ts)
    return c.isNotNull() & (c <= upper) & (c >= ts_literal(min_date, t))


def valid_datetime_flag(df: DataFrame, ts: str = K.TS, as_of: datetime | None = None,
                        min_date: datetime = MIN_DATE) -> Column:
    """F8 as a flag column (never NULL)."""
    return F.coalesce(valid_datetime_pred(df, ts, as_of, min_date), F.lit(False))


def valid_datetime(df: DataFrame, ts: str = K.TS, as_of: datetime | None = None,
                   out: str = "data_valida") -> DataFrame:
    return df.withColumn(out, valid_datetime_flag(df, ts, as_of))


def clean_and_validate(df: DataFrame, ts: str = K.TS, as_of: datetime | None = None) -> DataFrame:
    """city box, then timestamp parse + validity if the column exists, then
    full-row de-duplication (O2)."""
    out = df.where(city_box_pred())
    if ts in out.columns:
        out = parse_timestamps(out, [ts])
        out = out.where(valid_datetime_pred(out, ts, as_of))
    return dedupe(out)


def dedupe(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    """O2: drop fully equal rows (or rows equal on ``subset``)."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def cleaning_report(df: DataFrame, valid: Column, rejects: DataFrame | None = None) -> DataFrame:
    """Rows in, rows kept, rows removed, percent removed — one pass; with
    ``rejects`` (``io.read_with_rejects``) also the lines that are no rows."""
    agg = df.agg(F.count(F.lit(1)).alias("linhas_entrada"),
                 F.count(F.when(valid, 1)).alias("linhas_validas"))
    more = [] if rejects is None else [F.lit(rejects.count()).cast("long").alias("linhas_rejeitadas")]
    return agg.select(
        "linhas_entrada", "linhas_validas", *more,
        (F.col("linhas_entrada") - F.col("linhas_validas")).alias("linhas_removidas"),
        S.pct(F.col("linhas_entrada") - F.col("linhas_validas"), "linhas_entrada", 1).alias("pct_removidas"))
