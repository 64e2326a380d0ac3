"""Spark side of the test bindings and rule-labelled fixtures (see oracle_base)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.operators.derive import derive_time_features
from sentinela.operators.risk import risk_tier
from sentinela.sources.binding import nation_zone_boxes, occurrences, order_incidents


def occ(spark: SparkSession, d: str) -> DataFrame:
    return occurrences(spark, d)


def cal(spark: SparkSession, d: str) -> DataFrame:
    return derive_time_features(occurrences(spark, d))


def ordi(spark: SparkSession, d: str) -> DataFrame:
    return order_incidents(spark, d)


def label_rule(df: DataFrame) -> DataFrame:
    """Deterministic stand-in for model labels (cluster −1..4, 5 % anomalies)."""
    return df.withColumns({
        "cluster": (F.col(K.ID) % 6).cast("int") - 1,
        "anomalia": F.when(F.col(K.ID) % 20 == 0, F.lit(-1)).otherwise(F.lit(1)),
    })


def lab(spark: SparkSession, d: str) -> DataFrame:
    return label_rule(cal(spark, d))


def risk(spark: SparkSession, d: str) -> DataFrame:
    return risk_tier(lab(spark, d))


def pred(spark: SparkSession, d: str) -> DataFrame:
    """Prediction fixture: true label = risk tier, prediction shifted for every 7th id."""
    r = risk(spark, d)
    shifted = F.when(F.col("nivel_risco") == K.RISK_LOW, K.RISK_MID) \
        .when(F.col("nivel_risco") == K.RISK_MID, K.RISK_HIGH).otherwise(K.RISK_LOW)
    return r.select(K.ID, K.ZONE, F.col("nivel_risco").alias("label"),
                    F.when(F.col(K.ID) % 7 == 0, shifted).otherwise(F.col("nivel_risco")).alias("prediction"))


def nbox(spark: SparkSession, d: str) -> DataFrame:
    return nation_zone_boxes(spark, d)
