"""Small fixed dimension tables built from the constants (size known in advance)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sentinela import constants as K


def zone_boxes(spark: SparkSession, boxes=None) -> DataFrame:
    rows = boxes if boxes is not None else K.ZONE_BOXES
    schema = T.StructType([
        T.StructField("zone", T.StringType(), False),
        T.StructField("lat_c", T.DoubleType(), False),
        T.StructField("lon_c", T.DoubleType(), False),
        T.StructField("radius", T.DoubleType(), False),
    ])
    return spark.createDataFrame([(z, float(a), float(b), float(r)) for z, a, b, r in rows], schema)


def weight_table(spark: SparkSession, weights: dict, key: str = "key") -> DataFrame:
    schema = T.StructType([T.StructField(key, T.StringType(), False),
                           T.StructField("w", T.IntegerType(), False)])
    return spark.createDataFrame([(k, int(v)) for k, v in weights.items()], schema)


def weekdays(spark: SparkSession, names=None) -> DataFrame:
    names = names or K.WEEKDAYS_LOWER
    schema = T.StructType([T.StructField("dow", T.IntegerType(), False),
                           T.StructField("dia_semana", T.StringType(), False)])
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], schema)


def hours(spark: SparkSession) -> DataFrame:
    return spark.range(0, 24).selectExpr("CAST(id AS INT) AS hora")
