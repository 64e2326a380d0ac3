"""Risk tiers from zone density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela import constants as K


def zone_counts(df: DataFrame, zone: str = K.ZONE) -> DataFrame:
    """Rows per zone (NULL zone dropped); partial aggregation absorbs hot zones."""
    return df.where(F.col(zone).isNotNull()).groupBy(zone).agg(F.count(F.lit(1)).alias("zona_n"))


def enrich_with_group_count(df: DataFrame, key: str = K.ZONE, out: str = "zona_n",
                            counts: DataFrame | None = None) -> DataFrame:
    """Each row's group size (missing → 0).

    groupBy + join back instead of ``count().over(partitionBy(key))``: the
    window would sort a hot group inside one task, the aggregation is
    pre-combined per task, and AQE broadcasts the per-key table (one row per
    key) when its measured size allows it.
    """
    c = counts if counts is not None else zone_counts(df, key)
    j = df.join(c.withColumnRenamed("zona_n", out), key, "left")
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("long"))


def group_count_quantiles(df: DataFrame, zone: str = K.ZONE, qs=K.RISK_QUANTILES) -> DataFrame:
    """Exact (interpolated) quantiles of the per-zone counts."""
    c = zone_counts(df, zone)
    return c.agg(*[F.percentile(F.col("zona_n").cast("double"), q).alias(f"q{int(round(q * 100))}") for q in qs])


def risk_thresholds(df: DataFrame, zone: str = K.ZONE, qs=K.RISK_QUANTILES) -> tuple[float, float]:
    """The two thresholds as numbers (one row of two doubles to the driver),
    rounded to 9 decimals to remove interpolation noise."""
    row = group_count_quantiles(df, zone, qs).first()
    vals = [row[i] for i in range(len(qs))]
    return tuple(round(v, 9) if v is not None else None for v in vals)  # type: ignore[return-value]


def risk_tier(df: DataFrame, zone: str = K.ZONE, out: str = "nivel_risco", qs=K.RISK_QUANTILES) -> DataFrame:
    """Zone count ≤ q33 → low, ≤ q66 → medium, else high, on every row
    (a row whose zone is NULL has count 0).

    The thresholds are Spark's exact ``percentile`` over the per-zone counts;
    the counts are then joined back.
    """
    q1, q2 = risk_thresholds(df, zone, qs)
    e = enrich_with_group_count(df, zone, "__zn")
    if q1 is None:
        return e.withColumn(out, F.lit(None).cast("string")).drop("__zn")
    tier = (F.when(F.col("__zn") <= F.lit(q1), K.RISK_LOW)
            .when(F.col("__zn") <= F.lit(q2), K.RISK_MID).otherwise(K.RISK_HIGH))
    return e.withColumn(out, tier).drop("__zn")


def risk_stats(df: DataFrame, level: str = "nivel_risco", zone: str = K.ZONE) -> DataFrame:
    """Rows and distinct zones per risk level."""
    return (df.where(F.col(level).isNotNull()).groupBy(level)
            .agg(F.count(F.lit(1)).alias("n"), F.count_distinct(zone).alias("bairros")).orderBy(level))
