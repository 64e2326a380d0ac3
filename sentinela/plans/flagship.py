"""Flagship query: the minimum slice of the build plan, end to end.

read (binding) → clean and validate (F9) → derive (P2–P5) → filter (F4)
→ hour histogram with peak flag (A2).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentinela.operators.clean import clean_and_validate
from sentinela.operators.derive import derive_time_features
from sentinela.operators.filters import FilterSpec, apply_filters
from sentinela.operators.profile import hour_histogram
from sentinela.sources.binding import occurrences

AS_OF = datetime(2024, 12, 31, 23, 59, 59)


def hour_profile(spark: SparkSession, sf_dir: str, spec: FilterSpec | None = None,
                 as_of: datetime = AS_OF) -> DataFrame:
    base = derive_time_features(clean_and_validate(occurrences(spark, sf_dir), as_of=as_of))
    filtered = apply_filters(base, spec or FilterSpec())
    h = hour_histogram(filtered)
    # 24 rows at most: a global window over the aggregated table is cheap
    top = F.max("n").over(Window.partitionBy())
    first = F.min(F.when(F.col("n") == top, F.col("hora"))).over(Window.partitionBy())
    return h.withColumn("pico", F.col("hora") == first).orderBy("hora")
