"""Join-strategy and evaluate-once helpers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinela.session import ensure_checkpoint_dir

# A dimension is broadcast only if it has at most this many rows.  Rows of our
# dimensions are a few dozen bytes, so this keeps a broadcast below ~10 MB.
MAX_BROADCAST_ROWS = 100_000

#: Column of a pre-counted table: input rows behind each of its rows.
ROWS = "__rows"


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only after checking it has ≤ ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows.  Above the bound the frame is
    returned unchanged and Spark plans a shuffle join (AQE may still convert
    it at run time from real statistics).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def fixed_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a frame built from a constant list in this package (size known)."""
    return F.broadcast(df)


def settled(df: DataFrame) -> DataFrame:
    """Evaluate a frame once, into a reliable checkpoint in the shared folder.

    For aggregated tables that several small queries read.  Nothing stays in
    executor memory, and a lost executor costs a re-read.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A frame as files in the shared folder, read back: for what a loop hands to its next round.

    A checkpoint hands on the estimated size of the plan behind it, and that of
    a join is the product of its sides: in a loop its digits double each round,
    until the planning takes longer than the work.  Files have their own size.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def precounted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per combination of ``cols`` (those present) with the number of input
    rows in ``ROWS``: one scan and one pre-aggregated shuffle of the input, after
    which every section of a report reads this table only."""
    keep = [c for c in dict.fromkeys(cols) if c in df.columns]
    return settled(df.groupBy(*keep).agg(F.count(F.lit(1)).alias(ROWS)))


def numbered(df: DataFrame, out: str) -> DataFrame:
    """0-based position of each row of a sorted frame: row numbers inside the sorted
    partitions, and the partitions' row counts (as many numbers as partitions)
    as offsets.  No rows meet in one task."""
    placed = settled(df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return (placed.join(F.broadcast(offsets), "__part")
            .withColumn(out, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).select(*df.columns, out))


def ranked(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """0-based position of each row in ascending ``order`` (a range shuffle)."""
    return numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), out)


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a frame that is about to be reused by many jobs (model
    iterations, Python scoring) over at least the cluster's default
    parallelism.  A large input already has more partitions and is returned
    unchanged, so this never adds a shuffle at scale."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
