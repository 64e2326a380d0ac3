"""The original recomputes its pages on every interaction and has no
streaming code.  The stateless operators (validation, derivation, filters)
are plain column expressions, so they apply unchanged to a streaming
DataFrame; this module wires them onto ``readStream``.

Full-row de-duplication (O2) is stateful in a stream; it is done with
``dropDuplicatesWithinWatermark`` when a watermark is given.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinela import constants as K
from sentinela.operators.clean import city_box_pred, valid_datetime_pred
from sentinela.operators.derive import derive_time_features
from sentinela.operators.filters import FilterSpec, apply_filters


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def clean_derive_stream(sdf: DataFrame, as_of: datetime | None = None, spec: FilterSpec | None = None,
                        watermark: str | None = None, ts: str = K.TS) -> DataFrame:
    """F5 + F8 + P2–P5 (+ F4) on a stream; de-duplication within the watermark."""
    out = sdf.where(city_box_pred()).where(valid_datetime_pred(sdf, ts, as_of))
    if watermark:
        # a watermark needs a zone-aware timestamp; timestamp_ntz is cast for it
        if isinstance(sdf.schema[ts].dataType, T.TimestampNTZType):
            out = out.withColumn("__event_time", F.col(ts).cast("timestamp"))
            out = out.withWatermark("__event_time", watermark).dropDuplicatesWithinWatermark().drop("__event_time")
        else:
            out = out.withWatermark(ts, watermark).dropDuplicatesWithinWatermark()
    out = derive_time_features(out, ts)
    return apply_filters(out, spec) if spec else out
