"""Small helpers shared by the operators."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinela import constants as K
from sentinela.plans.hints import ROWS


def ts_literal(value, like: T.DataType | None = None) -> Column:
    """A timestamp literal of the same kind as the column it is compared with.

    Comparing ``timestamp_ntz`` with a ``timestamp`` literal would cast the
    column; a literal of the column's own type keeps the predicate pushable.
    """
    if isinstance(value, datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, date):
        text = value.strftime("%Y-%m-%d 00:00:00")
    else:
        text = str(value)
    kind = "timestamp_ntz" if isinstance(like, T.TimestampNTZType) else "timestamp"
    return F.lit(text).cast(kind)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def ensure_hour(df: DataFrame, ts: str = K.TS, hour: str = "hora") -> DataFrame:
    return df if hour in df.columns else df.withColumn(hour, F.hour(ts))


def ensure_dow(df: DataFrame, ts: str = K.TS, dow: str = "dow") -> DataFrame:
    return df if dow in df.columns else df.withColumn(dow, (F.weekday(ts) + F.lit(1)).cast("int"))


def n_rows(df: DataFrame, when: Column | None = None) -> Column:
    """Aggregate: input rows (that match ``when``); in a pre-counted table the sum of its counts."""
    if ROWS not in df.columns:
        return F.count(F.lit(1) if when is None else F.when(when, 1))
    return F.coalesce(F.sum(F.col(ROWS) if when is None else F.when(when, F.col(ROWS))), F.lit(0))


def counted(df: DataFrame, keys: list[str], n: str = "n", dropna: bool = True) -> DataFrame:
    """``groupBy(keys).count()`` with pandas' default of dropping NULL keys."""
    if dropna:
        cond = None
        for k in keys:
            c = F.col(k).isNotNull()
            cond = c if cond is None else cond & c
        df = df.where(cond)
    return df.groupBy(*keys).agg(n_rows(df).alias(n))
