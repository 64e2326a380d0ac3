"""Two-pass external shuffle into shards (DataFrame functions only).

Pass one scatters every record: its shard is the one with the largest seeded
hash of (key, shard) (rendezvous hashing, so the key and the shard count alone
decide, and one more shard takes rows only into itself), and a second seeded
hash spreads the records of a shard over buckets of a size that fits in memory.
Pass two takes one bucket at a time, puts it in a fixed order, shuffles it
(Spark's ``shuffle`` is a seeded Fisher-Yates) and numbers the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinela.llm._base import stash

#: Bytes of records in one bucket.
BUCKET_BYTES = 8 << 20


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Shard 0..shards-1 of a key; a null key has a shard like any other value."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)),
                        lambda s: F.struct(F.xxhash64(F.lit(seed), s, key).alias("draw"), s.alias("shard")))
    return F.array_max(draws)["shard"]


def shuffle_into_shards(df: DataFrame, key: str, shards: int, weight: Column, seed: int = 1,
                        bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``df`` in ``record``, with ``shard`` and ``slot`` (gapless from 0 in a shard).

    ``weight`` is a record's size in bytes. A null key counts as a value of its
    own, so its rows share a shard but not a bucket. Repeated rows stay, each
    with a slot of its own. An empty table gives no rows. A shard of any size is
    cut into enough buckets, so no task holds more than about ``bucket_bytes``,
    except for one oversized record or for more exact repeats of one row.
    Runs on the same rows and partition count agree.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    scattered = stash(df.select(
        record.alias("record"), shard_of(F.col(f"`{key}`"), shards, seed).alias("shard"),
        weight.cast("long").alias("bytes"), F.xxhash64(F.lit(seed + 1), record).alias("spread")), "scatter")
    totals = {r["shard"]: r["bytes"] or 0
              for r in scattered.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    buckets = F.array(*[F.lit(-(-totals.get(s, 0) // bucket_bytes) or 1) for s in range(shards)])
    rows = scattered.withColumn("bucket", F.pmod("spread", F.element_at(buckets, F.col("shard") + 1)))
    sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shuffled = (rows.repartition(parts, "shard", "bucket").groupBy("shard", "bucket")
                .agg(F.sort_array(F.collect_list(F.struct("spread", "record"))).alias("held"))
                .sortWithinPartitions("shard", "bucket")
                .select("shard", "bucket", F.posexplode(F.shuffle("held", F.lit(seed))).alias("at", "held")))
    return (shuffled.join(starts, ["shard", "bucket"])
            .select(F.col("held.record").alias("record"), "shard", (F.col("start") + F.col("at")).alias("slot")))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the records as Parquet, one folder per shard, each file in slot order."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .select("record.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
     .write.partitionBy("_shard").parquet(path))
