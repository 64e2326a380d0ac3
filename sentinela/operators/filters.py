"""Filters (F1–F4, F10–F13).  Each returns a predicate or a filtered frame;
predicates are plain Column expressions so Catalyst can push them down."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.operators._common import dtype_of, ts_literal


def in_values(col: str, values: Sequence | None) -> Column | None:
    """F1 predicate: membership; empty or None → no restriction."""
    if not values:
        return None
    return F.col(col).isin(list(values))


def filter_in(df: DataFrame, col: str, values: Sequence | None) -> DataFrame:
    """F1."""
    p = in_values(col, values)
    return df if p is None else df.where(p)


def date_range_pred(df: DataFrame, start: date, end: date, ts: str = K.TS) -> Column:
    """F2 predicate: calendar dates ``start``…``end`` inclusive, as a half-open
    timestamp range on the raw column (pushed into the Parquet scan)."""
    t = dtype_of(df, ts)
    lo = datetime(start.year, start.month, start.day)
    hi = datetime(end.year, end.month, end.day) + timedelta(days=1)
    return (F.col(ts) >= ts_literal(lo, t)) & (F.col(ts) < ts_literal(hi, t))


def filter_date_range(df: DataFrame, start: date, end: date, ts: str = K.TS) -> DataFrame:
    """needs exactly two ends."""
    if start is None or end is None:
        raise ValueError("a date range needs a start and an end")
    return df.where(date_range_pred(df, start, end, ts))


def hour_range_pred(lo: int, hi: int, hour: str = "hora", ts: str = K.TS, df: DataFrame | None = None) -> Column:
    h = F.col(hour) if df is None or hour in df.columns else F.hour(ts)
    return h.between(lo, hi)


def filter_hour_range(df: DataFrame, lo: int, hi: int, hour: str = "hora", ts: str = K.TS) -> DataFrame:
    """inclusive hours."""
    return df.where(hour_range_pred(lo, hi, hour, ts, df))


@dataclass
class FilterSpec:
    """the dashboard's filter set; an empty list means no restriction."""

    types: list = field(default_factory=list)
    zones: list = field(default_factory=list)
    date_range: tuple | None = None
    hour_range: tuple | None = None
    weekdays: list = field(default_factory=list)        # ISO numbers 1..7
    victim_genders: list = field(default_factory=list)  # second form
    statuses: list = field(default_factory=list)        # second form

    def predicate(self, df: DataFrame, ts: str = K.TS) -> Column:
        preds = [in_values(K.TYPE, self.types), in_values(K.ZONE, self.zones)]
        if self.date_range is not None:
            preds.append(date_range_pred(df, self.date_range[0], self.date_range[1], ts))
        if self.hour_range is not None:
            preds.append(hour_range_pred(self.hour_range[0], self.hour_range[1], "hora", ts, df))
        if self.weekdays:
            dow = F.col("dow") if "dow" in df.columns else (F.weekday(ts) + 1)
            preds.append(dow.isin(list(self.weekdays)))
        if self.victim_genders and "genero_vitima" in df.columns:
            preds.append(in_values("genero_vitima", self.victim_genders))
        if self.statuses and "status_caso" in df.columns:
            preds.append(in_values("status_caso", self.statuses))
        out = F.lit(True)
        for p in preds:
            if p is not None:
                out = out & p
        return out


def apply_filters(df: DataFrame, spec: FilterSpec, ts: str = K.TS) -> DataFrame:
    """one ``where`` with the conjunction of all set filters."""
    return df.where(spec.predicate(df, ts))


def only_anomalies(df: DataFrame, col: str = "anomalia") -> DataFrame:
    """F10."""
    return df.where(F.col(col) == -1)


def only_normal(df: DataFrame, col: str = "anomalia") -> DataFrame:
    return df.where(F.col(col) == 1)


def only_cluster(df: DataFrame, k: int, col: str = "cluster") -> DataFrame:
    return df.where(F.col(col) == k)


def min_rows(df: DataFrame, n: int) -> bool:
    """True if ``df`` has at least ``n`` rows (reads at most n rows)."""
    return df.limit(n).count() >= n


def filter_options(df: DataFrame, cols: Iterable[str] = (K.TYPE, K.ZONE)) -> DataFrame:
    """sorted distinct values of each filter column, long form
    (filtro, valor).  One pass and one shuffle for all columns together."""
    cols = [c for c in cols if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("filtro"), F.col(c).cast("string").alias("valor")) for c in cols])
    return (df.select(F.explode(pairs).alias("p")).select("p.filtro", "p.valor")
            .where(F.col("valor").isNotNull()).distinct().orderBy("filtro", "valor"))


def date_bounds(df: DataFrame, ts: str = K.TS) -> DataFrame:
    """minimum and maximum timestamp (for the date picker)."""
    return df.agg(F.min(ts).alias("data_min"), F.max(ts).alias("data_max"))
