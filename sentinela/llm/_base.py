"""Shared pieces of the corpus operators: reading tables, scratch tables, global row numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentinela.session import ensure_checkpoint_dir, ship_package

#: Words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch handed to Python (texts can be long; Spark's default is 10,000).
ARROW_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def for_python(spark: SparkSession) -> None:
    """Ship this package to the executors and keep Arrow batches small."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and read it back.

    The lineage ends there: a lost executor costs a re-read, not a recomputation,
    and what follows sees one fixed version of the rows.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_index(df: DataFrame, order: list[Column], name: str = "_idx") -> DataFrame:
    """Add the 0-based position of every row in ascending ``order`` (ties in any order).

    A range shuffle and a sort inside partitions; only one count per partition
    meets in a single task, never the rows.
    """
    placed = stash(df.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("_mid", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("_mid", 33).alias("_part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return (placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_mid", "_part", "_before"))
