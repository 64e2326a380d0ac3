"""Canonical incident schema, column aliases and schema checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sentinela import constants as K

INCIDENT_SCHEMA = T.StructType([
    T.StructField(K.ID, T.LongType(), False),
    T.StructField(K.TS, T.TimestampType(), True),
    T.StructField(K.TYPE, T.StringType(), True),
    T.StructField(K.ZONE, T.StringType(), True),
    T.StructField(K.LAT, T.DoubleType(), True),
    T.StructField(K.LON, T.DoubleType(), True),
    T.StructField(K.METHOD, T.StringType(), True),
    T.StructField(K.WEAPON, T.StringType(), True),
    T.StructField(K.SEX, T.StringType(), True),
    T.StructField(K.AGE, T.IntegerType(), True),
    T.StructField(K.VICTIMS, T.IntegerType(), True),
    T.StructField(K.SUSPECTS, T.IntegerType(), True),
    T.StructField(K.STATUS, T.StringType(), True),
    T.StructField(K.PRECINCT, T.StringType(), True),
])

# Other spellings found in the two dashboards → canonical name.
ALIASES = {
    "genero_suspeito": K.SEX,
    "num_vitimas": K.VICTIMS,
    "num_suspeitos": K.SUSPECTS,
}

# Columns an uploaded table must have.
UPLOAD_REQUIRED = [K.TS, K.TYPE, K.ZONE, K.LAT, K.LON]


class MissingColumnsError(ValueError):
    """Raised when an operator's required columns are absent."""

    def __init__(self, missing: list[str]):
        super().__init__(f"missing columns: {', '.join(missing)}")
        self.missing = missing


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim and lower-case every column name (a projection, no data work)."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def apply_aliases(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rename alternative spellings to the canonical names if the canonical is absent."""
    aliases = ALIASES if aliases is None else aliases
    for src, dst in aliases.items():
        if src in df.columns and dst not in df.columns:
            df = df.withColumnRenamed(src, dst)
    return df


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """S3: the required columns that the frame lacks (driver-side schema check)."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def require(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Raise ``MissingColumnsError`` unless all ``required`` columns exist."""
    miss = missing_columns(df, required)
    if miss:
        raise MissingColumnsError(miss)
    return df


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """The subset of ``cols`` present in ``df`` (optional-column handling)."""
    have = set(df.columns)
    return [c for c in cols if c in have]
